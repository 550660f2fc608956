"""Machine-learning data preparation on Spark whose tables remember where they came from."""

from provspark.operators.frame import TrackedFrame, join
from provspark.plans.run import load_run, run_pipeline
from provspark.sources.readers import read_csv, read_lines, read_parquet, read_tsv, track

__all__ = [
    "TrackedFrame",
    "join",
    "load_run",
    "read_csv",
    "read_lines",
    "read_parquet",
    "read_tsv",
    "run_pipeline",
    "track",
]
