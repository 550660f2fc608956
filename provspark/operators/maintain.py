"""Incremental maintenance: delete values or records from all artifacts without a rerun.

Cost follows the files that hold affected rows: they are looked up in an index, and they alone are read
and written anew (see ``sources.tables``), whatever the size of the request. A request may ask for any
number of columns, records and sources; it is one version and one pass over those files. Labels and
encoder states stay as they were fitted.

A deletion applies to the latest version of the run's branch: if another one was faster, both are in
effect in the end. Deleted data stays in earlier versions until ``purge``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions.naming import SAMPLE_ID
from provspark.functions.vectors import is_sparse, zero_ranges, zero_sparse_ranges, zeroed
from provspark.operators import lineage
from provspark.operators.network import Network, gradient_sums, prediction, probability
from provspark.operators.split import SPLIT, TEST, TRAIN
from provspark.operators.storage import materialise, together
from provspark.sources.artifacts import Run, next_version
from provspark.sources.tables import REQUESTS, Requests, find_hits


# --- building blocks, usable on any table ---------------------------------------------------

def null_out(df: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """Set the columns to null, everywhere or on the rows where the condition holds."""
    for c in columns:
        value = F.lit(None) if where is None else F.when(~F.coalesce(where, F.lit(False)), F.col(f"`{c}`"))
        df = df.withColumn(c, value.cast(df.schema[c].dataType))
    return df


def patch_features(df: DataFrame, ranges, where: Column | None = None, column: str = "features") -> DataFrame:
    """Zero the ranges of the feature vector; rows outside ``where`` are not touched at all."""
    patched = zeroed(df, ranges, column)
    if where is not None:
        patched = F.when(where, patched).otherwise(F.col(column))
    return df.withColumn(column, patched)


def updates(samples: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """The patch list ``(sample_id, ranges)``: which positions become 0 in which sample."""
    literal = F.array(*[
        F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("stop")) for a, b in ranges
    ]).cast("array<struct<start:int,stop:int>>")
    return samples.select(SAMPLE_ID, literal.alias("ranges"))


def before_after(samples: DataFrame, ranges, column: str = "features") -> DataFrame:
    """Samples with the feature vector before and after the patch side by side."""
    return samples.withColumn("patched", zeroed(samples, ranges, column))


def unlearn_features(network: Network, pairs: DataFrame, rate: float = 1.0) -> Network:
    """First-order update for changed feature values.

    ``theta - rate * (mean gradient at the new values - mean gradient at the old values)``.
    """
    (old, new), n = gradient_sums(pairs, network, ("features", "patched"))
    if not n:
        return network
    return network.with_flat(network.flat - rate * (new - old) / n)


def unlearn_instances(network: Network, removed: DataFrame, rate: float = 1.0, sign: int = 1) -> Network:
    """First-order update for removed samples: one step that raises their loss.

    ``sign=-1`` steps the other way, for comparison with systems that do so.
    """
    (gradient,), n = gradient_sums(removed, network)
    if not n:
        return network
    return network.with_flat(network.flat + sign * rate * gradient / n)


# --- deletions on a stored run --------------------------------------------------------------

@dataclass(frozen=True)
class Target:
    """What a request asks for: to empty the impact of a source column, or to remove the sample."""

    columns: tuple[str, ...] = ()
    ranges: tuple[tuple[int, int], ...] = ()
    remove: bool = False

    @staticmethod
    def column(run: Run, source: str, column: str) -> "Target":
        columns = lineage.output_columns(run, source, column)
        return Target(tuple(columns), tuple(lineage.feature_ranges(run, columns)))


def _asked(targets: list[Target], condition) -> Column:
    """Whether a row is asked for any target that meets the condition."""
    numbers = [i for i, t in enumerate(targets) if condition(t)]
    if not numbers:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap("__targets", F.array(*[F.lit(i) for i in numbers])), F.lit(False))


def patched_by(df: DataFrame, targets: list[Target], column: str = "features") -> Column:
    """The feature vector with the ranges of all asked targets zeroed."""
    zero, vector = zero_sparse_ranges if is_sparse(df, column) else zero_ranges, F.col(column)
    for i, target in enumerate(targets):
        if target.ranges:
            asked = F.coalesce(F.array_contains("__targets", i), F.lit(False))
            vector = F.when(asked, zero(vector, list(target.ranges))).otherwise(vector)
    return vector


def apply_requests(run: Run, kind: str, requests: Requests, targets: list[Target], rate: float, sign: int) -> Run:
    """Apply a request to all artifacts, as one version; its targets are positions in ``targets``."""
    removed = _asked(targets, lambda t: t.remove)
    patching = _asked(targets, lambda t: t.ranges)
    columns = sorted({c for t in targets for c in t.columns})

    def relational(df: DataFrame) -> DataFrame:
        df = df.where(~removed)
        for c in columns:
            df = null_out(df, [c], _asked(targets, lambda t, c=c: c in t.columns))
        return df

    changes = {
        "relational": relational,
        "matrix": lambda df: df.where(~removed).withColumn("features", patched_by(df, targets)),
        "scores": lambda df: df.where(~removed),
    }
    if not any(t.remove for t in targets):
        del changes["scores"]
        if not any(t.ranges for t in targets):
            del changes["matrix"]

    def unlearned(run: Run, hits) -> Network:
        network = run.model()
        rows = hits.rows().where((F.col(SPLIT) == TRAIN) & F.col("__targets").isNotNull())
        moved = network.flat
        if any(t.ranges for t in targets):
            pairs = rows.where(patching & ~removed).withColumn("patched", patched_by(rows, targets))
            moved = moved + unlearn_features(network, pairs, rate).flat - network.flat
        if any(t.remove for t in targets):
            moved = moved + unlearn_instances(network, rows.where(removed), rate, sign).flat - network.flat
        return network.with_flat(moved)

    def make(run: Run):
        hits = find_hits([t for name, t in run.tables.items() if name in changes], requests)
        actions = [lambda h=h, c=changes[name]: h.replaced(c) for name, h in hits.items()]
        actions.append(lambda: hits["relational"].rows().where("__targets is not null").count() if hits["relational"].files else 0)
        actions.append(lambda: unlearned(run, hits["matrix"]) if "matrix" in hits and hits["matrix"].files else run.model())
        *written, changed, network = together(*actions)
        return dict(zip(hits, written, strict=True)), {name: h.files for name, h in hits.items()}, network, changed

    return next_version(run, kind, make)


def delete_features(
    run: Run, column_source: str, column: str, row_source: str, row_ids, rate: float = 1.0
) -> Run:
    """Delete the values of one source column for all samples from the given source rows.

    The output columns computed from it become null, the feature positions they influence 0,
    and the weights unlearn the old values. Returns the new version of the run. Sources are
    given by alias, path or parameter name.
    """
    target = Target.column(run, column_source, column)
    requests = Requests.of(run.spark, [(run.prov_of(row_source), row_ids, 0)])
    return apply_requests(run, "delete_features", requests, [target], rate, 1)


def delete_instances(run: Run, source: str, row_ids, rate: float = 1.0, sign: int = 1) -> Run:
    """Delete all samples from the given source rows; the weights unlearn those of training."""
    requests = Requests.of(run.spark, [(run.prov_of(source), row_ids, 0)])
    return apply_requests(run, "delete_instances", requests, [Target(remove=True)], rate, sign)


def delete_batch(run: Run, requests: DataFrame, rate: float = 1.0, sign: int = 1) -> Run:
    """Many requests as one version: a table ``(row_source, row_id, column_source, column)``.

    A row with a column asks for its values in all samples from the source row, one without for the
    samples themselves. Rows and vectors are the same as after the calls one by one; the weights
    take one step for all changed values and one for all removed samples, from the same point.
    """
    spark, names = run.spark, ("row_source", "column_source", "column")
    table = requests.select(*names, F.col("row_id").cast("long").alias("row_id")).where("row_id is not null")
    table = materialise(table.distinct(), "requests")
    targets, known = [], []
    # Different names only: as many as the sources have columns, and an unknown one is an error.
    for row in table.select(*names).distinct().toLocalIterator():
        target = Target(remove=True) if row.column is None else Target.column(run, row.column_source, row.column)
        if target not in targets:
            targets.append(target)
        known.append((row.row_source, row.column_source, row.column, run.prov_of(row.row_source), targets.index(target)))
    named = spark.createDataFrame(known, "s string, cs string, c string, prov string, target int")
    same = F.col("row_source").eqNullSafe(F.col("s")) & F.col("column_source").eqNullSafe(F.col("cs")) & F.col("column").eqNullSafe(F.col("c"))
    found = table.join(F.broadcast(named), same).select("prov", F.col("row_id").alias("id"), "target").distinct()
    found = materialise(found, "requests") if known else spark.createDataFrame([], REQUESTS)
    return apply_requests(run, "delete_batch", Requests.of_table(found), targets, rate, sign)


def rescore(run: Run) -> DataFrame:
    """Predictions of the current weights for the current test samples."""
    scored = run.matrix(TEST).select(SAMPLE_ID, "label", probability(run.model()).alias("probability"))
    return scored.select(SAMPLE_ID, "label", prediction(F.col("probability")).alias("prediction"))
