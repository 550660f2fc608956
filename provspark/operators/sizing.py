"""Size checks that decide whether a side of a join may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only below this many rows; the callers pass narrow key tables.
BROADCAST_ROWS = 500_000
# Tables with one short row per input file or input split may be larger: some 300 MB at most.
BROADCAST_FILES = 2_000_000


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``limit`` rows, else leave the join to Spark.

    ``rows`` is the known size; without it the rows are counted (partial counts per task).
    Beyond the limit the join shuffles on its keys and adaptive execution splits hot ones.
    """
    if rows is None:
        rows = df.count()
    return F.broadcast(df) if rows <= limit else df
