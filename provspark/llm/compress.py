"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, in integers.

Components become integers, vectors are cut into equal parts, and each part position has its own
codebook of a few entries, fitted to all vectors. Distances come from per-dimension value dictionaries:
vectors are stored in blocks, and for each dimension a block holds its different integers once and one
short code per vector. A round tabulates the squared differences of every integer of a dictionary to
all entries; the distance of a part to an entry is then one gather per dimension, and a sum.

A block is of bounded size, so are its dictionaries; the blocks are read once per round, in place. What a
round brings to the driver are the sums and counts of each entry: as many numbers as the codebooks have,
whatever the number of vectors. All arithmetic is exact, so the result depends on no order of rows.

Defined cases: rows whose vector is null or holds null or non-finite components are left out; shorter
vectors count as filled up with zeros to the width, which is the length of the longest vector rounded up
to a multiple of the parts; integers are held to a range in which all distances fit 64 bits
(``integer_limit``: 2^27 for 64 components, so only components beyond 32,768 are affected); equal ids
are ordered by their vectors, null ids come last; fewer vectors than entries give fewer entries; a label
error that does not fit 64 bits is null; repeated rows count each; no rows give no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.llm.common import shared
from provspark.operators.sizing import broadcast_if_small
from provspark.operators.storage import materialise

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
BLOCK_VALUES = 1 << 19  # components in a block


def integer_limit(width: int) -> int:
    return 1 << ((62 - max(1, width - 1).bit_length()) // 2 - 1)


def integers(vectors: list | np.ndarray, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, vector in enumerate(vectors):
        out[i, : len(vector)] = vector
    limit = integer_limit(width)
    return np.clip(np.floor(out * scale), -limit, limit).astype(np.int64)


def _blocks(width: int, scale: int, vector: str, carried: list[str], names: pa.Schema) -> Callable:
    """Vectors to blocks of dictionaries and codes."""
    rows = max(1, BLOCK_VALUES // max(1, width))

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        column = table.column(vector).combine_chunks()
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if len(set(lengths.tolist())) == 1 and lengths[0] == width:
            limit = integer_limit(width)
            values = np.clip(np.floor(flat.reshape(len(lengths), width) * scale), -limit, limit).astype(np.int64)
        else:
            values = integers(np.split(flat, np.cumsum(lengths)[:-1]), width, scale)
        dictionaries, codes = [], np.empty((width, len(values)), np.int32)
        for d in range(width):
            found, codes[d] = np.unique(values[:, d], return_inverse=True)
            dictionaries.append(found)
        sizes = [len(x) for x in dictionaries]
        kind = np.uint16 if max(sizes, default=0) <= 1 << 16 else np.int32
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), table.column(c).combine_chunks()) for c in carried]
        arrays += [
            pa.array([np.concatenate(dictionaries) if sizes else np.zeros(0, np.int64)], pa.list_(pa.int64())),
            pa.array([sizes], pa.list_(pa.int32())), pa.array([codes.astype(kind).tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                piece = batch.slice(low, min(rows, batch.num_rows - low))
                if held and n + piece.num_rows > rows:
                    yield block(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            yield block(held)

    return run


class Block:
    """Codes (dimension, vector) and the dictionary of each dimension."""

    def __init__(self, dictionary: np.ndarray, sizes: np.ndarray, codes: bytes, n: int):
        kind = np.uint16 if max(sizes, default=0) <= 1 << 16 else np.int32
        self.n = n
        self.dictionaries = np.split(dictionary, np.cumsum(sizes)[:-1]) if len(sizes) else []
        self.codes = np.frombuffer(codes, kind).reshape(len(sizes), n)

    def assign(self, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and its squared distance, per part and vector.

        ``codebooks[part, entry]`` are the components. Of equally near entries the first one wins.
        """
        parts, entries, size = codebooks.shape
        nearest, distance = np.zeros((parts, self.n), np.int64), np.zeros((parts, self.n), np.int64)
        for part in range(parts):
            sums = np.zeros((self.n, entries), np.int64)
            for i in range(size):
                d = part * size + i
                difference = self.dictionaries[d][:, None] - codebooks[part, :, i][None, :]
                sums += (difference * difference)[self.codes[d]]
            nearest[part] = sums.argmin(axis=1)
            distance[part] = sums[np.arange(self.n), nearest[part]]
        return nearest, distance

    def totals(self, nearest: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Per part and entry: number of its vectors, and the sums of their components.

        Counts how often each integer of a dictionary goes to each entry, then weighs the integers.
        """
        parts = len(nearest)
        size = len(self.dictionaries) // parts
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for part in range(parts):
            counts[part] = np.bincount(nearest[part], minlength=entries)
            for i in range(size):
                d = part * size + i
                values = self.dictionaries[d]
                joint = self.codes[d].astype(np.int64) * entries + nearest[part]
                often = np.bincount(joint, minlength=len(values) * entries).reshape(-1, entries)
                sums[part, :, i] = values @ often
        return counts, sums


def _read(batch: pa.RecordBatch, carried: str) -> Iterator[tuple[int, Block]]:
    for i in range(batch.num_rows):
        n = len(batch.column(carried)[i])
        dictionary = np.array(batch.column("__values")[i].values, np.int64)
        sizes = np.array(batch.column("__sizes")[i].values, np.int32)
        yield i, Block(dictionary, sizes, batch.column("__codes")[i].as_py(), n)


def _round(get: Callable[[], np.ndarray], key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = get()
        parts, entries, size = codebooks.shape
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            for _, block in _read(batch, key):
                more = block.totals(block.assign(codebooks)[0], entries)
                counts, sums = counts + more[0], sums + more[1]
        part, entry = (x.ravel() for x in np.indices(counts.shape))
        used = counts.ravel() > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[used], pa.int32()), pa.array(entry[used], pa.int32()), pa.array(counts.ravel()[used]),
             pa.array(list(sums.reshape(len(part), size)[used]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    return run


def moved(blocks: DataFrame, codebooks: np.ndarray, key: str) -> np.ndarray:
    """One round: assign all parts, replace every used entry by the floor of the mean of its parts."""
    spark, size = blocks.sparkSession, codebooks.shape[2]
    found = blocks.mapInArrow(_round(shared(spark, codebooks), key), "part int, entry int, n long, sums array<long>")
    # As many groups as the codebooks have entries; each task adds one row to a group at most.
    wide = [F.sum(F.get("sums", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    out = codebooks.copy()
    for row in found.groupBy("part", "entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *wide).collect():
        for i in range(size):
            out[row.part, row.entry, i] = int(row[f"s{i}"]) // int(row.n)
    return out


def _final(get: Callable[[], np.ndarray], key: str, label: str, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = get()
        for batch in batches:
            for i, block in _read(batch, key):
                nearest, distance = block.assign(codebooks)
                codes = pa.ListArray.from_arrays(
                    pa.array(np.arange(block.n + 1) * len(nearest), pa.int32()), pa.array(nearest.T.ravel(), pa.int32())
                )
                arrays = [batch.column(key)[i].values, batch.column(label)[i].values, codes, pa.array(distance.sum(axis=0))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """``(key, label, codes, error, label_error)`` per vector, and the codebooks ``[part, entry, place]``."""
    spark = df.sparkSession
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = df.select(key, label, vector).where(F.coalesce(sound, F.lit(False)))
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = kept.orderBy(F.asc_nulls_last(key), vector).select(vector).limit(entries).collect()
    start = integers([row[0] for row in first], width, scale)
    codebooks = np.ascontiguousarray(start.reshape(len(first), parts, width // parts).transpose(1, 0, 2))

    id_type, label_type = df.schema[key].dataType, df.schema[label].dataType
    result = T.StructType([
        T.StructField(key, id_type), T.StructField(label, label_type),
        T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType()),
    ])
    if not first:
        return spark.createDataFrame([], T.StructType([*result.fields, T.StructField("label_error", T.LongType())])), codebooks
    stored = T.StructType([
        T.StructField(key, T.ArrayType(id_type)), T.StructField(label, T.ArrayType(label_type)),
        T.StructField("__values", T.ArrayType(T.LongType())), T.StructField("__sizes", T.ArrayType(T.IntegerType())),
        T.StructField("__codes", T.BinaryType()),
    ])
    block = _blocks(width, scale, vector, [key, label], _arrow(stored))
    blocks = materialise(kept.mapInArrow(block, stored), "vector-blocks")
    for _ in range(rounds):
        codebooks = moved(blocks, codebooks, key)
    coded = blocks.mapInArrow(_final(shared(spark, codebooks), key, label, _arrow(result)), result)
    coded = materialise(coded, "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")
    labels = materialise(coded.groupBy(F.col(label).alias("__label")).agg(total), "label-errors")
    whole = coded.join(broadcast_if_small(labels), F.col(label).eqNullSafe(F.col("__label")))
    return whole.drop("__label"), codebooks


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def codebooks_text(codebooks: np.ndarray) -> str:
    """All integers by part, entry and position, in decimal."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(codebooks_text(codebooks).encode()).hexdigest()
