"""How filters of a corpus act together: what each one removes in every order they could be applied in.

Every document gets a mask with one bit per filter it fails. Counts per mask are additive, so one row
per part and mask (at most 2^filters a part) holds all that is needed: what a filter removes after
others, finds already removed, or is alone to find, is a sum over masks.

All conditions but one are functions of a single text. The repeat condition compares texts across the
corpus, and a counting Bloom prepass keeps that from moving all of it: tasks count the hashes of their
texts in a sketch of saturating two-bit counters, the sketches are merged block by block, and a text one
of whose counters is 1 is certainly unique. Only possible repeats are shuffled, as whole texts, for the
smallest id of each text; copies meet inside the tasks first. The sketch is sized by the number of
documents up to ``MAX_COUNTERS`` (64 MB as it is broadcast, enough for some 50 million documents); beyond
that it clears fewer texts, and more of them are shuffled, with the same result.

Defined cases: a null text is an empty one, and empty texts are equal; a null part is one of its own;
rows without an id come after all others, so they repeat any text that stands under an id, and never
each other; rows with the same id and text are no repeats; a document counts as good or toxic if any
of its label rows says so; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import shared
from provspark.operators.sizing import broadcast_if_small
from provspark.operators.storage import materialise

PER_DOCUMENT = 16  # counters a document
HASHES = 3
BLOCK = 1 << 16
MAX_COUNTERS = 1 << 28
FLUSH = 1 << 20  # documents a task counts before it passes on what it has

# --- conditions: functions of the text and its words ---------------------------------------------

Condition = Callable[[Column, Column], Column]
REPEAT = "repeat"  # identical to the text of a smaller id


def words_of(text: Column) -> Column:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def few_words(least: int) -> Condition:
    return lambda text, words: F.size(words) < least


def repeated_words(percent: int) -> Condition:
    """Under so many per cent of the words are different ones."""
    return lambda text, words: 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def many_capitals(percent: int) -> Condition:
    """Over so many per cent of the characters are A-Z."""
    return lambda text, words: 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > percent * F.char_length(text)


def holds_any(characters: str) -> Condition:
    inside = "".join("\\" + c for c in characters)
    return lambda text, words: text.rlike(f"[{inside}]")


# --- counting Bloom prepass ----------------------------------------------------------------------

def _slots(h1: np.ndarray, h2: np.ndarray, counters: int) -> np.ndarray:
    """Counters of each text, one row per hash; of one text they may fall together."""
    h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64) | np.uint64(1)
    return np.stack([(h1 + np.uint64(i) * h2) & np.uint64(counters - 1) for i in range(HASHES)]).astype(np.int64)


def _touched(slots: np.ndarray) -> np.ndarray:
    """Slots by text, each once a text, so that one text adds 1 to a counter even if its hashes meet there."""
    slots = np.sort(slots, axis=0)
    fresh = np.ones(slots.shape, bool)
    fresh[1:] = slots[1:] != slots[:-1]
    return slots[fresh]


def _partial(counters: int) -> Callable:
    """Sketch of a task: per block the places it counts, each once or, if counted more often, twice."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        slots, often = np.unique(np.concatenate(held), return_counts=True)
        slots = np.repeat(slots, np.minimum(often, 2))
        blocks, at = np.unique(slots // BLOCK, return_index=True)
        places = np.split((slots % BLOCK).astype(np.uint16), at[1:])
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([p.tobytes() for p in places], pa.binary())], ["block", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_touched(_slots(batch.column("__h1").to_numpy(), batch.column("__h2").to_numpy(), counters)))
                n += batch.num_rows
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the blocks of a partition; counters stop at 2 and are packed four to a byte."""
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, places in zip(batch.column("block").to_pylist(), batch.column("places"), strict=True):
            counts = blocks.setdefault(block, np.zeros(BLOCK, np.uint8))
            counts += np.minimum(np.bincount(np.frombuffer(places.as_buffer(), np.uint16), minlength=BLOCK), 2).astype(np.uint8)
            np.minimum(counts, 2, out=counts)
    for block, counts in blocks.items():
        four = counts.reshape(-1, 4)
        packed = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["block", "packed"])


def possible_repeats(hashes: DataFrame, max_counters: int = MAX_COUNTERS) -> Callable[[Column, Column], Column]:
    """From the columns ``__h1``, ``__h2`` of all texts: a test that no repeated text fails."""
    spark, n = hashes.sparkSession, hashes.count()
    counters = min(max_counters, max(BLOCK, 1 << (PER_DOCUMENT * n - 1).bit_length())) if n else BLOCK
    parts = hashes.select("__h1", "__h2").mapInArrow(_partial(counters), "block int, places binary")
    tasks = max(1, min(counters // BLOCK, spark.sparkContext.defaultParallelism * 4))
    rows = parts.repartition(tasks, "block").mapInArrow(_merged, "block int, packed binary").collect()
    sketch = np.zeros((counters // BLOCK, BLOCK // 4), np.uint8)
    for row in rows:  # at most max_counters / 4 bytes
        sketch[row.block] = np.frombuffer(row.packed, np.uint8)
    get = shared(spark, sketch.ravel())

    @F.pandas_udf("boolean")
    def repeated(h1: pd.Series, h2: pd.Series) -> pd.Series:
        slots = _slots(h1.to_numpy(), h2.to_numpy(), counters)
        return pd.Series(((get()[slots >> 2] >> ((slots & 3) * 2).astype(np.uint8)) & 3 >= 2).all(axis=0))

    return repeated


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit("second"), text).alias("__h2")]


# --- masks ---------------------------------------------------------------------------------------

def with_masks(df: DataFrame, fails: dict[str, Condition | str], part: str, key: str = "doc_id", text: str = "text", max_counters: int = MAX_COUNTERS) -> DataFrame:
    """``(__key, __part, __mask)`` per document; bit i of the mask stands for the i-th condition."""
    texts = df.select(F.col(key).alias("__key"), F.col(part).alias("__part"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    words = texts.withColumn("__words", words_of(F.col("__text")))
    mask, repeat = F.lit(0), None
    for i, (_, fail) in enumerate(fails.items()):
        if fail == REPEAT:
            repeat = i
        else:
            mask = mask + F.when(fail(F.col("__text"), F.col("__words")), 1 << i).otherwise(0)
    flags = materialise(words.select("__key", "__part", mask.alias("__mask"), *_hashes(F.col("__text"))), "flags")
    if repeat is None:
        return flags.select("__key", "__part", "__mask")
    possible = possible_repeats(flags, max_counters)
    again = texts.select("__key", "__text", *_hashes(F.col("__text"))).where(possible("__h1", "__h2"))
    first = again.groupBy("__text", "__h1", "__h2").agg(F.min("__key").alias("__id"))
    first = materialise(first.select("__id", F.col("__h1").alias("__f1"), F.col("__h2").alias("__f2")), "first-ids")
    checked = flags.withColumn("__possible", possible("__h1", "__h2"))
    same = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__h1") == F.col("__f1")) & (F.col("__h2") == F.col("__f2"))
    found = checked.where("__possible").join(first.distinct(), same, "left")
    found = found.withColumn("__mask", F.col("__mask") + F.when(F.col("__f1").isNull(), 1 << repeat).otherwise(0))
    columns = ["__key", "__part", "__mask"]
    return materialise(checked.where("not __possible").select(columns).union(found.select(columns)), "masks")


def audit(
    df: DataFrame, fails: dict[str, Condition | str], part: str, labels: DataFrame, key: str = "doc_id", text: str = "text",
    max_counters: int = MAX_COUNTERS,
) -> DataFrame:
    """One row per part, order of all filters, and step, with what the filter of that step does there.

    Meant for a handful of filters, as there is a row for every order of them.
    """
    masks = with_masks(df, fails, part, key, text, max_counters)
    told = labels.select(F.col(key).alias("__key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    told = told.where("__key is not null and (good or toxic)").groupBy("__key")
    told = materialise(told.agg(*[F.coalesce(F.max(c), F.lit(False)).cast("long").alias(c) for c in ("good", "toxic")]), "labels")
    joined = masks.join(broadcast_if_small(told), "__key", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    counts = joined.groupBy("__part", "__mask").agg(F.count("*").alias("n"), *sums)
    by_part = counts.groupBy("__part").agg(F.collect_list(F.struct("__mask", "n", "good", "toxic")).alias("masks"))
    return _orders(by_part, list(fails)).withColumnRenamed("__part", part)


def _orders(by_part: DataFrame, letters: list[str]) -> DataFrame:
    """Expand the mask counts of each part to all orders and steps."""
    steps = []
    for order in itertools.permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"o": "".join(letters[j] for j in order), "s": step, "f": i, "b": before})
            before |= 1 << i
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<o: string, s: int, f: int, b: int>>")
    each = by_part.select("__part", "masks", F.inline(listed))
    bit = F.expr("shiftleft(1, f)")

    def total(condition: Callable[[Column], Column], value: str) -> Column:
        chosen = F.filter("masks", lambda m: condition(m["__mask"]))
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda a, m: a + m[value])

    fails = lambda m: m.bitwiseAND(bit) != 0
    earlier = lambda m: m.bitwiseAND(F.col("b")) != 0
    done = each.select(
        "__part", F.col("o").alias("filter_order"), F.col("s").alias("step"), "f",
        total(lambda m: ~fails(m) & ~earlier(m), "n").alias("kept"),
        total(lambda m: fails(m) & ~earlier(m), "n").alias("removed"),
        total(lambda m: fails(m) & earlier(m), "n").alias("redundant"),
        total(lambda m: m == bit, "n").alias("unique_fails"),
        total(lambda m: fails(m) & ~earlier(m), "good").alias("good_lost"),
        total(lambda m: fails(m) & ~earlier(m), "toxic").alias("toxic_lost"),
    )
    return done.withColumn("shapley", F.sum("removed").over(Window.partitionBy("__part", "f"))).drop("f")
