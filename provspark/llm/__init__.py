"""Operators for preparing training text: one module per operator, their queries in ``queries``."""

import sys

from pyspark import cloudpickle

# Tasks get the code below with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
