"""Near-duplicate documents by b-bit MinHash, confirmed on the full shingle sets.

Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its runs
of ``shingle`` words (the whole sequence if it has fewer). Documents link if the Jaccard similarity
of their sets reaches the threshold.

1. One pass computes ``BANDS * ROWS`` minima of each set. Bands of minima are the buckets; of every
   minimum the two low bits are kept, packed into bit planes. Documents with equal sets become one
   class. At similarity 0.8 a pair shares no bucket with probability (1 - 0.8^6)^40 = 5e-6.
2. Pairs of a bucket are candidates. The bit planes estimate their similarity, corrected for bits
   that agree by chance; pairs more than six standard deviations below the threshold go.
3. What is left is confirmed on the full sets (as 64-bit hashes of the shingles).

Buckets may be huge, so their pairs are never listed: first every member meets one member of its
bucket, drawn by hash; that joins groups of copies. Where different components still meet
in a bucket, their documents are compared in tiles, by bits and then by full sets, and a tile names one
link per document and component. So no link between components is lost, and nothing grows with the
square of a group but the work inside the tiles.

Defined cases: texts without words (null, empty) and rows without an id link with nothing and are
kept; rows that share an id are judged each by its text; repeated rows get the same component; no rows
give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import by_row, components, flat_words, hash_shingles, hash_words, mix, text_slices
from provspark.operators.sizing import broadcast_if_small
from provspark.operators.storage import materialise

BANDS, ROWS, CHUNK = 40, 6, 512
WORDS = -(-BANDS * ROWS // 64)
STARS = 1
TILE_ROWS, TILE_ITEMS = 512, 1 << 18
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
OFFSETS = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for low, high in text_slices(texts):
        words, offsets = flat_words(texts[low:high])
        hashes = hash_words(words)
        for start, end in zip(offsets[:-1], offsets[1:]):
            yield np.unique(hash_shingles(hashes[start:end], min(size, end - start))) if end > start else np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        values = FACTORS[:, None] * shingles[None, at : at + CHUNK] + OFFSETS[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return keys


def planes(low: np.ndarray) -> np.ndarray:
    """Two low bits of every minimum: ``WORDS`` longs of first bits, then ``WORDS`` of second ones."""
    kept = (low >> np.uint64(32)).astype(np.uint8)
    bits = np.zeros((2, WORDS * 64), np.uint8)
    bits[0, : len(low)], bits[1, : len(low)] = kept & 1, (kept >> 1) & 1
    return np.packbits(bits, axis=1).view(np.uint64).reshape(-1)


SIGNATURE = "key long, n_shingles long, set_a long, set_b long, bits array<long>, buckets array<long>"


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``SIGNATURE`` of ``docs(key, text)``; ``set_a, set_b`` are a 128-bit fingerprint of the whole set."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, bits, buckets = [], [], [], [], []
            for shingles in shingle_sets(batch.column(1), size):
                n.append(len(shingles))
                a.append(mix(shingles).sum(dtype=np.uint64))
                b.append(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                low = minima(shingles)
                bits.append(planes(low).view(np.int64))
                buckets.append(bands(low).view(np.int64) if len(shingles) else np.zeros(0, np.int64))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            lists = lambda x: pa.array(x, pa.list_(pa.int64()))
            names = ["key", "n_shingles", "set_a", "set_b", "bits", "buckets"]
            columns = [batch.column(0), pa.array(n, pa.int64()), longs(a), longs(b), lists(bits), lists(buckets)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(signed, SIGNATURE)


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Full sets ``(node, items)`` of the given documents."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in text_slices(batch.column(1)):
                part = batch.slice(low, high - low)
                sets = [np.sort(s.view(np.int64)) for s in shingle_sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])

    wanted = docs.join(broadcast_if_small(nodes.select(F.col("node").alias("key"))), "key", "left_semi")
    return wanted.select("key", "text").mapInArrow(listed, "node long, items array<long>")


def _estimate(a: str, b: str) -> Column:
    """Similarity from packed bits: the share of minima whose low bits agree, without those that agree by chance."""
    differ = F.lit(0)
    for i in range(WORDS):
        one, two = (F.get(F.col(a), F.lit(j)).bitwiseXOR(F.get(F.col(b), F.lit(j))) for j in (i, WORDS + i))
        differ = differ + F.bit_count(one.bitwiseOR(two))
    return ((1 - differ / (BANDS * ROWS)) - 0.25) / 0.75


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that link, from candidates ``(a, b)``."""
    least = _least(percent)
    bits = classes.select("node", "bits")
    near = pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    near = materialise(near.where(_estimate("bits_a", "bits_b") >= least).select("a", "b").distinct(), "candidates")
    nodes = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = materialise(_sets(docs, materialise(nodes, "nodes"), size), "sets")
    both = near.join(sets.toDF("a", "items_a"), "a").join(sets.toDF("b", "items_b"), "b")
    common = F.size(F.array_intersect("items_a", "items_b"))
    both = both.select("a", "b", common.alias("n"), (F.size("items_a") + F.size("items_b")).alias("total"))
    linked = both.where(100 * F.col("n") >= percent * (F.col("total") - F.col("n")))
    return materialise(linked.select("a", "b").distinct(), "links")


def _leftovers(placed: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components that still meet in a bucket of ``placed(bucket, node, label)``.

    A unit is the documents of all buckets with the same largest component. Its other documents are
    compared with those of that component and with each other, block by block.
    """
    meet = placed.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket")
    meet = meet.agg(F.max(F.struct("n", "label"))["label"].alias("unit"), F.count("*").alias("n")).where("n > 1")
    inside = placed.join(meet.select("bucket", "unit"), "bucket")
    inside = materialise(inside.select("unit", (F.col("label") == F.col("unit")).alias("main"), "node", "label").distinct(), "inside")
    nodes = materialise(inside.select("node").distinct(), "nodes")
    rows = classes.select("node", "bits").join(_sets(docs, nodes, size), "node")
    rows = inside.join(rows, "node")
    many = F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum(F.size("items")) / TILE_ITEMS)).cast("int")
    rows = materialise(rows, "unit-rows")
    blocks = materialise(rows.groupBy("unit", "main").agg(many.alias("blocks")), "unit-blocks")
    item = F.struct("node", "label", "bits", "items")
    dealt = rows.join(blocks, ["unit", "main"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = materialise(dealt.groupBy("unit", "main", "block").agg(F.collect_list(item).alias("rows")), "tiles")
    few, main = (blocks.where(F.col("main") == m).select("unit", F.sequence(F.lit(0), F.col("blocks") - 1).alias(c)) for m, c in ((False, "i"), (True, "j")))
    low = few.select("unit", F.explode("i").alias("i"), F.col("i").alias("all"))
    with_main = low.select("unit", "i").join(main, "unit").select("unit", "i", F.lit(True).alias("main"), F.explode("j").alias("j"))
    with_few = low.select("unit", "i", F.lit(False).alias("main"), F.explode(F.filter("all", lambda j: j >= F.col("i"))).alias("j"))
    left = dealt.where("not main").select("unit", F.col("block").alias("i"), F.col("rows").alias("left"))
    right = dealt.select("unit", "main", F.col("block").alias("j"), F.col("rows").alias("right"))
    pairs = with_main.union(with_few).join(left, ["unit", "i"]).join(right, ["unit", "main", "j"])
    least = _least(percent)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                links = tile_links(Block(a.values), Block(b.values), least, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

    found = pairs.select("left", "right").mapInArrow(compared, "a long, b long")
    return materialise(found.select(*_ordered(F.col("a"), F.col("b"))).distinct(), "links")


class Block:
    """Documents of a tile: nodes, component labels, bit planes and full sets."""

    def __init__(self, rows: pa.StructArray):
        nodes, labels, bits, items = rows.flatten()
        self.nodes, self.labels = nodes.to_numpy(), labels.to_numpy()
        self.bits = bits.flatten().to_numpy().view(np.uint64).reshape(len(rows), 2 * WORDS)
        self.items = items.flatten().to_numpy()
        self.ends = np.concatenate(([0], np.cumsum(items.value_lengths().to_numpy())))

    def set_of(self, i: int) -> np.ndarray:
        return self.items[self.ends[i] : self.ends[i + 1]]


def tile_links(few: Block, others: Block, least: float, percent: int) -> tuple[list[int], list[int]]:
    """Of each document of ``few`` one link to each other component among ``others``."""
    a, b = [], []
    sizes = np.diff(others.ends)
    for i in range(len(few.nodes)):
        both = few.bits[i] ^ others.bits
        differ = np.bitwise_count(both[:, :WORDS] | both[:, WORDS:]).sum(axis=1)
        near = ((1 - differ / (BANDS * ROWS)) - 0.25) / 0.75 >= least
        near = np.nonzero(near & (others.labels != few.labels[i]))[0]
        if not len(near):
            continue
        own = few.set_of(i)
        lengths = sizes[near]
        before = np.cumsum(lengths) - lengths
        items = others.items[np.repeat(others.ends[near] - before, lengths) + np.arange(lengths.sum())]
        hit = own[np.minimum(np.searchsorted(own, items), len(own) - 1)] == items
        common = np.add.reduceat(hit.astype(np.int64), before)
        linked = near[100 * common >= percent * (lengths + len(own) - common)]
        _, first = np.unique(others.labels[linked], return_index=True)
        for j in linked[first]:
            a.append(int(few.nodes[i]))
            b.append(int(others.nodes[j]))
    return a, b


def _least(percent: int) -> float:
    """The estimate that a pair at the threshold reaches but for one case in a billion."""
    same = 0.25 + 0.75 * percent / 100
    return percent / 100 - 6 * (same * (1 - same) / (BANDS * ROWS)) ** 0.5 / 0.75


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: ``key, n_shingles, component_id, kept``.

    ``component_id`` is the smallest key that links reach, ``kept`` whether that is the row's own.
    """
    rows = by_row(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), lambda rows: _near_duplicates(rows, shingle, percent))
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.lit(True))
    return rows.select(F.col("key").alias(key), "n_shingles", "component_id", kept.alias("kept"))


def _near_duplicates(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``(key, n_shingles, component_id)`` of ``docs(key, text)`` with different keys."""
    signed = materialise(signatures(docs, shingle), "signatures")
    full = signed.where("n_shingles > 0 and key is not null")
    classes = full.groupBy("set_a", "set_b").agg(F.min("key").alias("node"), F.first("bits").alias("bits"), F.first("buckets").alias("buckets"))
    classes = materialise(classes, "classes")
    members = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = materialise(members.join(shared, "bucket"), "members")

    labels = classes.select("node", F.col("node").alias("label")).limit(0)
    tested = links = None
    for turn in range(STARS + 1):
        placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        placed = materialise(placed, "placed") if turn else placed
        if turn == STARS:
            found = _leftovers(placed, classes, docs, shingle, percent)
        else:
            draw = F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "label")
            stars = placed.groupBy("bucket").agg(F.min(draw).alias("star"))
            pairs = placed.join(stars, "bucket").where("label != star.label")
            pairs = pairs.select(*_ordered(F.col("node"), F.col("star.node"))).where("a != b").distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = materialise(pairs, "pairs")
            tested = pairs if tested is None else tested.union(pairs)
            found = _confirmed(pairs, classes, docs, shingle, percent)
        links = found if links is None else links.union(found)
        if not found.isEmpty():
            labels = components(links).toDF("node", "label")

    reached = classes.select("set_a", "set_b", "node").join(labels, "node", "left")
    reached = reached.select("set_a", "set_b", F.coalesce("label", "node").alias("component_id"))
    joined = full.select("key", "n_shingles", "set_a", "set_b").join(reached, ["set_a", "set_b"])
    rest = signed.where("not (n_shingles > 0 and key is not null)").select("key", "n_shingles", F.col("key").alias("component_id"))
    return joined.select("key", "n_shingles", "component_id").union(rest)
