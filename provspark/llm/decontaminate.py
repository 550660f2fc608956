"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Words are white-space separated, lower-cased, without punctuation at their ends. Test items are cut
into overlapping segments of at most ``SEGMENT`` words, so long items stay cheap and no part of them
is left out. All runs of ``SEED`` words of a segment are its seeds, so a copy is found by any run that
it keeps, whichever words it lacks and however common the words or the item are.

Every document that holds a seed is aligned with the seed's segment around the place of the hit
(match +1, mismatch and gap -0.5 per word). The score is the alignment's, divided by the segment's
length; a segment counts from ``score`` on, or from an alignment of ``COPIED`` on, whatever its share:
so many words are a copy, also where they are an excerpt of a long item. As segments overlap by
``STRIDE`` words, an excerpt of that length lies in one of them. Places that cannot reach it are passed over: a word of the
document that the segment does not have costs any alignment across it at least 0.5, and the others
add at most 1, so the best sum of a stretch bounds the score.

All these are matches. Not all of them tell that the item was copied: ``telling`` says so from an
alignment of ``TELLING`` on, and below if words as common by chance are rare: with word frequencies
counted over all documents, the product for the item's commonest words, as many as the alignment, is
at most ``RARE``. Items of fewer than ``TELLING`` words must be there whole for that, and items of
fewer than ``SEED`` words never tell. Documents should be rejected for telling matches only.

Documents are read in place: one pass, two where items are short; no shuffle of text. The segments go to the tasks in blocks
of at most about ``BLOCK_WORDS`` words; a larger benchmark takes more passes, not more memory.

Defined cases: null or empty texts and items match nothing; items with fewer than ``SEED`` words
count only if their whole run of words occurs in order; rows with null ids are matched like others;
repeated items give one match per id; repeated documents get the same matches; empty tables are fine;
other columns are kept, except one named like the output, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import plain_words, shared, text_slices
from provspark.operators.storage import materialise

SEGMENT, STRIDE, SEED = 128, 64, 3
COPIED, TELLING, WHOLE, RARE = 30, 8, 5, 1e-8
BLOCK_WORDS = 1 << 19
HITS, ALIGNED = 1 << 16, 512
MISMATCH = GAP = 0.5
LEAKS = "array<struct<item_id:bigint,score:double,telling:boolean>>"


def segments(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """``(item_id, words)``: overlapping segments of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = plain_words(batch.column(1))
            words, ids, parts = words.to_pylist(), [], []
            for row, key in enumerate(batch.column(0).to_pylist()):
                start, end = offsets[row], offsets[row + 1]
                for at in range(start, max(start + 1, end - (SEGMENT - STRIDE)), STRIDE):
                    if part := words[at : min(at + SEGMENT, end)]:
                        ids.append(key)
                        parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.list_(pa.string()))], ["item_id", "words"])

    rows = benchmark.select(F.col(item).cast("long"), F.col(text))
    return rows.mapInArrow(cut, "item_id long, words array<string>").distinct()


class Block:
    """Segments of a block as word numbers, with the index of their seeds."""

    def __init__(self, rows: list):
        self.items = [r.item_id for r in rows]
        vocabulary = sorted({w for r in rows for w in r.words})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.vocabulary = pa.array(vocabulary, pa.large_string())
        self.parts = [np.array([number[w] for w in r.words], np.int64) for r in rows]

        self.lengths = np.array([len(p) for p in self.parts])
        self.set_seeds()
        self.chances: dict[int, np.ndarray] = {}
        # Which words a segment has, by hash: it may say yes to others, never no to its own.
        self.held = np.zeros(1 << (16 * int(self.lengths.sum())).bit_length(), bool)
        self.held[self.places(np.repeat(np.arange(len(self.parts)), self.lengths), np.concatenate(self.parts))] = True

    def places(self, segment: np.ndarray, words: np.ndarray) -> np.ndarray:
        keys = segment.astype(np.uint64) * np.uint64(len(self.vocabulary) + 1) + (words + 1).astype(np.uint64)
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.held).bit_length())

    def set_seeds(self) -> None:
        """Index all runs of ``SEED`` words."""
        keys, where = [], []
        for s, part in enumerate(self.parts):
            runs = self.keys(part, SEED)
            keys.append(runs)
            where.append(np.stack((np.full(len(runs), s), np.arange(len(runs))), axis=1))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        where = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
        order = np.argsort(keys, kind="stable")
        self.seeds, self.first, self.many = np.unique(keys[order], return_index=True, return_counts=True)
        self.where = where[order]
        self.short = {}
        for s, part in enumerate(self.parts):
            if len(part) < SEED:
                self.short.setdefault(tuple(part.tolist()), []).append(s)

    def short_items(self, least: float) -> bool:
        """Whether a match may be shorter than ``TELLING``, so that word frequencies are needed."""
        return bool((np.minimum(least * self.lengths, COPIED) < TELLING).any())

    def set_chances(self, frequency: np.ndarray, least: float) -> None:
        """Log chance of the commonest 1, 2, ... words of short segments. ``frequency``: of each word of the vocabulary."""
        logs = np.log(np.maximum(frequency, 1e-12))
        for s in np.nonzero(np.minimum(least * self.lengths, COPIED) < TELLING)[0]:
            self.chances[int(s)] = np.cumsum(np.sort(logs[self.parts[s]])[::-1])

    def telling(self, s: int, score: float) -> bool:
        if score >= TELLING:
            return True
        length = len(self.parts[s])
        if length < SEED or (length < TELLING and score < length):
            return False
        if length >= WHOLE and score >= length:
            return True
        return bool(self.chances[int(s)][int(np.ceil(score)) - 1] <= np.log(RARE))

    def keys(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """One number per run of words; below 2^63 for up to 2^20 words and runs of three."""
        out = np.zeros(max(0, len(numbers) - size + 1), np.int64)
        for i in range(size):
            out = out * (len(self.vocabulary) + 1) + numbers[i : i + len(out)]
        return out

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words, offsets = plain_words(texts)
        return pc.fill_null(pc.index_in(words, self.vocabulary), -1).to_numpy().astype(np.int64), offsets


def align(parts: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each part with its window (Smith-Waterman, rows of all pairs at once)."""
    best = np.zeros(len(parts), np.float32)
    height, width = max(map(len, parts)), max(map(len, windows))
    part = np.full((len(parts), height), -3, np.int64)
    window = np.full((len(parts), width), -2, np.int64)
    for i, (p, w) in enumerate(zip(parts, windows)):
        part[i, : len(p)], window[i, : len(w)] = p, w
    # Gaps along the window: the running maximum of score + GAP * position, less GAP * position.
    slope = (GAP * np.arange(width + 1)).astype(np.float32)
    above = np.zeros((len(parts), width + 1), np.float32)
    for row in range(height):
        here = np.zeros_like(above)
        step = np.where(window == part[:, row : row + 1], np.float32(1), np.float32(-MISMATCH))
        here[:, 1:] = np.maximum(above[:, :-1] + step, above[:, 1:] - np.float32(GAP))
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        np.maximum(best, here.max(axis=1), out=best)
        above = here
    return best


def leaks_in(texts: pa.Array, block: Block, least: float) -> list[dict]:
    """For each text ``(best score, telling)`` by item, of those that count; ``least``: the share that does."""
    found: list[dict] = [{} for _ in range(len(texts))]
    numbers, offsets = block.numbers(texts)
    document = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for size in {len(k) for k in block.short}:
        wanted = {int(block.keys(np.array(k), size)[0]): v for k, v in block.short.items() if len(k) == size}
        keys = block.keys(numbers, size)
        inside = document[: len(keys)] == document[size - 1 :]
        for at in np.nonzero(np.isin(keys, list(wanted)) & inside)[0]:
            if (numbers[at : at + size] >= 0).all():
                for s in wanted[int(keys[at])]:
                    found[document[at]][block.items[s]] = (1.0, False)
    known = numbers >= 0
    n = len(numbers) - SEED + 1
    if n <= 0 or not len(block.seeds):
        return found
    inside = document[:n] == document[SEED - 1 :]
    for i in range(SEED):
        inside &= known[i : i + n]
    at = np.nonzero(inside)[0]
    keys = block.keys(numbers, SEED)[at]
    seed = np.searchsorted(block.seeds, keys)
    hit = (seed < len(block.seeds)) & (block.seeds[np.minimum(seed, len(block.seeds) - 1)] == keys)
    at, seed = at[hit], seed[hit]
    pairs = np.cumsum(block.many[seed])
    low = 0
    while low < len(at):
        # At most about HITS pairs of hit and segment at a time.
        high = max(low + 1, int(np.searchsorted(pairs, (pairs[low - 1] if low else 0) + HITS, side="right")))
        align_hits(numbers, offsets, document, block, least, at[low:high], seed[low:high], found)
        low = high
    return found


def at_most(numbers: np.ndarray, block: Block, segment: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A bound of the alignment score of each segment with its window: the best sum of a stretch of the window."""
    place = start[:, None] + np.arange((end - start).max())
    words = numbers[np.minimum(place, len(numbers) - 1)]
    held = block.held[block.places(segment[:, None], words)] & (words >= 0) & (place < end[:, None])
    sums = np.cumsum(np.where(held, np.float32(1), np.float32(-MISMATCH)), axis=1, dtype=np.float32)
    before = np.minimum.accumulate(np.minimum(sums, 0), axis=1)
    return np.minimum((sums - before).max(axis=1), block.lengths[segment])


def align_hits(
    numbers: np.ndarray, offsets: np.ndarray, document: np.ndarray, block: Block, least: float, at: np.ndarray, seed: np.ndarray,
    found: list[dict],
) -> None:
    """Put into ``found`` what alignments around the hits ``at`` of the seeds reach."""
    many = block.many[seed]
    place = np.repeat(block.first[seed], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at, (segment, position) = np.repeat(at, many), block.where[place].T
    lengths = block.lengths
    enough = np.minimum(least * lengths, COPIED)
    pad = lengths // 4 + 4
    # Hits on about the same diagonal lie in one window.
    diagonal = (at - position) // pad[segment]
    windows = np.unique(np.stack((document[at], segment, diagonal), axis=1), axis=0)
    windows = windows[np.argsort(lengths[windows[:, 1]], kind="stable")]
    for low in range(0, len(windows), ALIGNED):
        some = windows[low : low + ALIGNED]
        start = np.maximum(some[:, 2] * pad[some[:, 1]] - pad[some[:, 1]], offsets[some[:, 0]])
        end = np.minimum((some[:, 2] + 2) * pad[some[:, 1]] + lengths[some[:, 1]], offsets[some[:, 0] + 1])
        able = at_most(numbers, block, some[:, 1], start, end) >= enough[some[:, 1]]
        some, start, end = some[able], start[able], end[able]
        if not len(some):
            continue
        scores = align([block.parts[s] for s in some[:, 1]], [numbers[a:b] for a, b in zip(start, end)])
        for (doc, s, _), score in zip(some, scores):
            if score >= enough[s]:
                item = block.items[s]
                found[doc][item] = _best(found[doc].get(item), (float(score / lengths[s]), block.telling(s, score)))


def _best(a: tuple | None, b: tuple) -> tuple:
    """The best score of two matches of an item, telling if one of them is."""
    return b if a is None else (max(a[0], b[0]), a[1] or b[1])


def _blocks(spark, benchmark: DataFrame, item: str, text: str) -> list[Block]:
    parts = materialise(segments(benchmark, item, text), "segments")
    words = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-words // BLOCK_WORDS)
    parts = parts.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(n, 1))))
    for i in range(n):
        # At most about BLOCK_WORDS words come to the driver at a time.
        if rows := parts.where(F.col("block") == i).orderBy("item_id", "words").collect():
            yield Block(rows)


def _frequencies(docs: DataFrame, text: str, block: Block) -> np.ndarray:
    """Share of each word of a block among all words of all documents; counted inside the tasks, then added."""
    held = shared(docs.sparkSession, block)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held()
        counts = np.zeros(len(block.vocabulary) + 1, np.int64)
        for batch in batches:
            for low, high in text_slices(batch.column(0)):
                numbers, _ = block.numbers(batch.column(0)[low:high])
                counts += np.bincount(numbers + 1, minlength=len(counts))
        some = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["word", "n"])

    rows = docs.select(text).mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(block.vocabulary) + 1)
    for r in rows:
        counts[r.word] = r.n
    return counts[1:] / max(1.0, counts.sum())


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    score: float = 0.5, out: str = "leaks",
) -> DataFrame:
    """Add ``out``: the test items a document holds, an array of ``(item_id, score, telling)`` ordered by item."""
    docs = docs.drop(out)
    spark, parts = docs.sparkSession, []
    for block in _blocks(spark, benchmark, item, item_text):
        if block.short_items(score):
            block.set_chances(_frequencies(docs, text, block), score)
        parts.append(_finder(shared(spark, block), score)(F.col(text)))
    if not parts:
        return docs.withColumn(out, F.array().cast(LEAKS))
    return docs.withColumn(out, parts[0] if len(parts) == 1 else _merged(F.concat(*parts)))


def telling_leaks(leaks: Column) -> Column:
    """Those matches that a document should be rejected for."""
    return F.filter(leaks, lambda x: x.telling)


def _merged(leaks: Column) -> Column:
    """The best score of each item; segments of one item may lie in several blocks."""

    @F.arrow_udf(LEAKS)
    def merged(leaks: pa.Array) -> pa.Array:
        rows = []
        for found in leaks.to_pylist():
            best: dict = {}
            for x in found:
                best[x["item_id"]] = _best(best.get(x["item_id"]), (x["score"], x["telling"]))
            rows.append(best)
        return _as_array(rows)

    return merged(leaks)


def _as_array(rows: list[dict]) -> pa.Array:
    order = lambda x: sorted(x.items(), key=lambda y: (y[0] is None, y[0]))
    return pa.array(
        [[{"item_id": i, "score": s, "telling": t} for i, (s, t) in order(x)] for x in rows],
        pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("telling", pa.bool_())])),
    )


def _finder(held, score: float):
    @F.arrow_udf(LEAKS)
    def leaks(texts: pa.Array) -> pa.Array:
        found = []
        for low, high in text_slices(texts):
            found += leaks_in(texts[low:high], held(), score)
        return _as_array(found)

    return leaks
