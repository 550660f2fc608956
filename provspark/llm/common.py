"""What several operators share: samples with a stated bound, connected components, words as Arrow arrays."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.operators.storage import delete_folder, materialise

EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls into the fold that no model learns from (null keys: never)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value with the code of its classes; a task that calls the result unpacks it once."""
    packed, here = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> object:
        if not here:
            here.append(pickle.loads(packed.value))
        return here[0]

    return get


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows of ``df``, all of them if it has no more; which ones is a function of the keys alone."""
    there = df.count()
    if there <= rows:
        return df
    draw = F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30))
    return df.where(draw < int((1 << 30) * rows / there))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, component)`` per node that has an edge.

    ``component`` is the smallest node that can be reached. Alternates large-star and small-star
    steps until the edges no longer change; each step is two shuffles whose sums start inside the
    tasks, and no step holds the neighbours of a node in one place, so hubs are no trouble.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        # Large star: every larger neighbour moves to the smallest one.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b"))
        large = large.where("a != b").distinct()
        # Small star: smaller neighbours and the node itself move to the smallest one.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", "low")).where("a != b")
        last, edges = edges, materialise(small.distinct(), "edges")
        state, before = _state(edges), state
        for folder in {f.rsplit("/", 1)[0] for f in last.inputFiles()}:
            delete_folder(edges.sparkSession, folder)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(xxhash64(b, a) >> 24)")).first()
    return tuple(row)


def text_slices(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text, so that work on it stays small."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        base = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield low, high
        low = high
    give_back()


def give_back() -> None:
    """Tasks share their machine's memory with the JVM and live on between stages: return what is free."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own counsel
        pass


def by_row(rows: DataFrame, operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operate(rows)`` for an operator whose ``key`` names a row, also where keys repeat.

    ``rows`` has the column ``key``, the result ``key``, ``component_id`` and others. Where a key stands in
    several rows, each gets a number of its own for the operator, and the component is again the smallest
    key that it reaches. Rows without a key are left as they are.
    """
    if rows.where("key is not null").groupBy("key").count().where("count > 1").isEmpty():
        return operate(rows)
    numbered = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    others = [c for c in rows.columns if c != "key"]
    found = operate(numbered.select(F.when(F.col("key").isNotNull(), F.col("__row")).alias("key"), *others))
    found = materialise(found, "by-row")
    named = found.where("key is not null").withColumnRenamed("key", "__row").join(numbered.select("__row", "key"), "__row")
    smallest = named.groupBy("component_id").agg(F.min("key").alias("__smallest"))
    named = named.join(smallest, "component_id").withColumn("component_id", F.col("__smallest"))
    return named.select(*found.columns).union(found.where("key is null"))


def flat_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts after each other, and where each text's words begin.

    Returns the words and ``n + 1`` offsets; null texts have no words. Only A-Z are lower-cased.
    """
    # A copy that begins at its buffers' start: text functions of Arrow misread some slices.
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        before = np.concatenate(([0], np.cumsum(real)))
        words, offsets = words.filter(pa.array(real)), before[offsets]
    return words, offsets.astype(np.int64)


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in lower case without punctuation at their ends; see ``flat_words``."""
    words, offsets = flat_words(pc.utf8_lower(pa.concat_arrays([pc.fill_null(texts, "")])), lower=False)
    words = pc.utf8_trim(words, EDGES)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(real)))
    return words.filter(pa.array(real)), before[offsets]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; the same in every process."""
    coded = words.dictionary_encode()
    return hash_texts(coded.dictionary)[coded.indices.to_numpy()]


def hash_texts(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text: the sum of one random number per byte and place."""
    texts = pa.concat_arrays([texts])
    if not len(texts):
        return np.zeros(0, np.uint64)
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[: len(texts) + 1].astype(np.int64)
    if ends[-1] == 0:
        return np.zeros(len(texts), np.uint64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: ends[-1]]
    lengths = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], lengths)
    values = mix((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(0x632BE59BD9B4E019))
    # Empty texts have no bytes to add up.
    sums, some = np.zeros(len(texts), np.uint64), lengths > 0
    sums[some] = np.add.reduceat(values, ends[:-1][some])
    return mix(sums)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; the order inside a run counts."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)] + np.uint64(i + 1))
    return out
