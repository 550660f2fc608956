"""Provenance queries over a stored run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.functions.naming import SAMPLE_ID
from provspark.operators.frame import TrackedFrame, by_source_rows
from provspark.operators.split import SPLIT, TEST, TRAIN


def rows_originating_from(run, split: str, source: str, row_ids) -> DataFrame:
    """Samples of one split that stem from the given rows of a source."""
    samples = run.matrix(split).select(SAMPLE_ID, *run.key_cols)
    return by_source_rows(samples, run.prov_of(source), row_ids, "left_semi")


def train_rows_originating_from(run, source: str, row_ids) -> DataFrame:
    return rows_originating_from(run, TRAIN, source, row_ids)


def test_rows_originating_from(run, source: str, row_ids) -> DataFrame:
    return rows_originating_from(run, TEST, source, row_ids)


test_rows_originating_from.__test__ = False  # not a test case


def output_columns(run, source: str, column: str) -> list[str]:
    """Output columns computed from a source column."""
    wanted = f"{run.alias_of(source)}.{column}"
    known = run.document.get("source_columns")
    if known is not None and wanted not in known:
        raise ValueError(f"{wanted} is no column of this run's sources")
    return sorted(c for c, origin in run.document["column_provenance"].items() if wanted in origin)


def feature_ranges(run, columns: list[str]) -> list[tuple[int, int]]:
    """Half-open ranges of feature positions that the output columns influence."""
    return sorted((start, stop) for c, start, stop in run.document["matrix_provenance"] if c in columns)


def backward_rows(samples: DataFrame, source: TrackedFrame) -> DataFrame:
    """The source records behind samples: ``sample_id`` and the source's columns.

    ``samples`` needs ``sample_id`` and the source's provenance column.
    """
    (prov,) = source.prov_cols
    return samples.select(SAMPLE_ID, prov).join(source.df, prov).select(SAMPLE_ID, prov, *source.columns)


def record_usage(source: TrackedFrame, used: DataFrame, flag: str = "used") -> DataFrame:
    """All source records with a flag: does any row of ``used`` stem from the record?

    ``used`` needs the source's provenance column; a record behind many rows is reduced to
    one id inside each task, before the shuffle.
    """
    (prov,) = source.prov_cols
    ids = used.select(F.col(prov).alias("__id")).distinct()
    return (
        source.df.join(ids, F.col(prov) == F.col("__id"), "left")
        .withColumn(flag, F.col("__id").isNotNull())
        .drop("__id")
    )


__all__ = [
    "SPLIT", "backward_rows", "feature_ranges", "output_columns", "record_usage",
    "rows_originating_from", "test_rows_originating_from", "train_rows_originating_from",
]
