"""Seeded train/test splits.

Every sample has a pseudo-random rank, ``split_key`` (128 bits as hex text); a split is a
comparison with one threshold, so it is a map-only column whatever the size of the data.

* ``hash_threshold``: the threshold follows from the fraction alone. No pass over the data, and
  a sample keeps its side when others are deleted.
* ``exact_threshold``: exactly ``ceil(fraction * n)`` test samples, as the usual seeded split of
  an in-memory table gives. The threshold is the k-th smallest rank, found by counting ranks per
  prefix: a pass over that one column brings at most 65,536 counts to the driver and narrows the
  rank by 16 bits, until at most a few thousand candidates are left.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.functions.naming import SAMPLE_ID, split_key
from provspark.operators.storage import materialise

TRAIN, TEST = "train", "test"
SPLIT, SPLIT_KEY = "split", "split_key"
_DIGITS = 4
_FEW = 4096  # so many ranks may come to the driver to be sorted
_WIDTH = 32


def _exact_fraction(fraction: float) -> Fraction:
    value = Fraction(str(fraction))
    if not 0 <= value <= 1:
        raise ValueError("the test fraction must lie between 0 and 1")
    return value


def hash_threshold(fraction: float) -> str:
    """Largest rank of a test sample if ranks are uniform; empty text if there is none."""
    first_train = int(_exact_fraction(fraction) * 16**_WIDTH)
    return f"{first_train - 1:0{_WIDTH}x}" if first_train else ""


def exact_threshold(df: DataFrame, fraction: float, key: str = SPLIT_KEY) -> str:
    """Rank of the last of ``ceil(fraction * n)`` test samples; ``df`` should be a stored table."""
    ranks = df.select(F.col(key).alias("rank"))
    prefix, wanted = "", None
    while len(prefix) < _WIDTH:
        head = F.substring("rank", 1, len(prefix) + _DIGITS).alias("head")
        within = ranks.where(F.col("rank").startswith(prefix))
        counts = sorted((row["head"], row["count"]) for row in within.groupBy(head).count().collect())
        if wanted is None:
            wanted = math.ceil(_exact_fraction(fraction) * sum(n for _, n in counts))
        if wanted == 0:
            return ""
        for prefix, n in counts:
            if wanted <= n:
                break
            wanted -= n
        if wanted == n:  # the whole group is on the test side
            return prefix.ljust(_WIDTH, "f")
        if n <= _FEW:
            rest = ranks.where(F.col("rank").startswith(prefix)).collect()
            return sorted(row["rank"] for row in rest)[wanted - 1]
    return prefix


def split_column(threshold: str, key: str | Column = SPLIT_KEY) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key <= F.lit(threshold), TEST).otherwise(TRAIN)


def with_split_key(df: DataFrame, seed: int, sample: str = SAMPLE_ID) -> DataFrame:
    return df.withColumn(SPLIT_KEY, split_key(F.col(sample), seed))


def epoch_rank(epoch: int, sample: str = SAMPLE_ID) -> Column:
    return F.md5(F.concat(F.lit(f"{epoch}:"), F.col(sample)).cast("binary"))


def epoch_order(df: DataFrame, epoch: int, sample: str = SAMPLE_ID) -> DataFrame:
    """Seeded order of all samples, another one for each epoch, with the ``place`` of each from 0 on.

    Ranges of the rank are partitions, in order; the places follow from one count per partition.
    """
    return with_place(df, [epoch_rank(epoch, sample), F.col(sample)], "place")


def with_place(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rows stored in an order over all of them, with their position in it; no task sees more than a range."""
    keys = [f"__order_{i}" for i in range(len(order))]
    sorted_rows = df.withColumns(dict(zip(keys, order))).orderBy(*[F.asc_nulls_first(k) for k in keys])
    stored = materialise(sorted_rows.drop(*keys).withColumn("__id", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("__id", 33)
    counts = stored.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    # One row per task, as many as the shuffle has partitions.
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = stored.join(F.broadcast(counts), task == F.col("__task"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(out, place).drop("__id", "__task", "__before")
