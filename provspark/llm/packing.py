"""Packing documents into sequences of a fixed number of tokens: linear grouping, then best fit.

A document is its token ids and one separator. Longer ones are cut into whole sequences; what is over
stands first and is packed like a short document. How pieces are put together follows the linear
grouping scheme for bin packing:

1. Large pieces are put into groups of equal number by length, and every length of a group is rounded
   up to the longest one, so that only a few sizes are left.
2. Which combinations of these sizes (configurations) fill a sequence best, and how often to use each,
   is a linear programme over the few sizes; its columns are made when they are needed, by a knapsack
   over the dual prices, and the numbers are rounded down.
3. Actual pieces take the places of the sizes, the longest of a group first; what they leave free of
   their rounded size becomes free space of the sequence. The last places of a configuration, its
   smallest, may stay open: a piece chosen by its true length fits there better than one by its group.
   How many do (``OPEN``) is tried out on the counts, and the plan with the fewest sequences is taken.
4. The large pieces without a place and all small ones go, the longest first, where the least space is
   left over.

Lengths are integers up to the capacity, so all of this is a function of how many pieces of each
length there are: ``plan_sequences`` sees at most ``capacity`` numbers, whatever the corpus, and treats
sequences of the same content as one row with a count. The corpus itself stays in Spark: texts are
tokenised once, in place, every piece gets its rank among the pieces of its length (a count inside the
task and one prefix sum over the tasks), and length and rank look their place up in the plan.

Defined cases: a null text is an empty one, which is the separator alone; repeated rows and rows with
equal or null ids are packed each; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.llm.common import shared, text_slices
from provspark.operators.sizing import broadcast_if_small
from provspark.operators.storage import materialise

GROUPS = 64  # sizes that large lengths are rounded up to
LARGE = 5  # pieces longer than this part of a sequence are large
OPEN = (0, 1, 2, 3, 4)  # places of a configuration that are left to the best fit
ROUNDS = 2_000  # columns that may enter the linear programme
CHUNK = 1 << 18  # characters that the tokenizer sees at once

# --- tokenizer --------------------------------------------------------------------------------

# The split of text into words that the vocabulary was built with (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(spark: SparkSession, path: str) -> str:
    """The document of a byte-level BPE tokenizer, read by Spark from wherever it lies."""
    return spark.read.text(path, wholetext=True).first()[0]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a tokenizer document; equal to those of the ``tokenizers`` library on that document.

    Merges of such a vocabulary are numbered in the order they apply, so the ids themselves rank them;
    the faster library works from these ranks. A text it gives up on goes to ``tokenizers``.
    """

    def __init__(self, document: str):
        import tiktoken

        self.document, self.slow = document, None
        parts = json.loads(document)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in parts["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("document", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        parts = [self._ids(chunk) for chunk in chunks(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # a very long run of white space
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_str(self.document)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """Cut a long text where no token can cross: before a space that follows something else than white space."""
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace()):
            cut += 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


# --- plan: from the number of pieces of each length to sequences --------------------------------

@dataclass
class Run:
    """``count`` sequences of the same lengths, in order."""

    count: int
    lengths: tuple[int, ...]
    free: int


def grouped(counts: np.ndarray, smallest: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Large pieces, the longest first, in groups of equal number: (rounded length, [(length, number)])."""
    lengths = np.nonzero(counts)[0][::-1]
    lengths = lengths[lengths >= smallest]
    total = int(counts[lengths].sum())
    size = max(1, -(-total // groups))
    out, room = [], 0
    for length in lengths.tolist():
        left = int(counts[length])
        while left:
            # A group that begins with the length of the one before it is no new size.
            if not room:
                room = size
                if not out or out[-1][0] != length:
                    out.append((length, []))
            taken = min(left, room)
            out[-1][1].append((length, taken))
            left, room = left - taken, room - taken
    return out


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits a sequence (unbounded knapsack)."""
    worth = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes, prices = sizes[order], prices[order]
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        n = fitting[c]
        options = worth[c - sizes[:n]] + prices[:n]
        best = int(options.argmax())
        if options[best] > worth[c - 1] + 1e-12:
            worth[c], last[c] = options[best], best
        else:
            worth[c] = worth[c - 1]
    found, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
            continue
        found[order[last[c]]] += 1
        c -= int(sizes[last[c]])
    return float(worth[capacity]), found


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Columns (one configuration each) and how often to use them: the linear programme of cutting stock."""
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    used = inverse @ demand
    for turn in range(rounds):
        if turn % 50 == 49:  # against rounding errors
            inverse = np.linalg.inv(basis)
            used = inverse @ demand
        prices = inverse.sum(axis=0)
        worth, column = best_configuration(sizes, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        basis[:, leaves] = column
        pivot = inverse[leaves] / change[leaves]
        inverse = inverse - np.outer(change, pivot)
        inverse[leaves] = pivot
        used = np.maximum(inverse @ demand, 0)
    return basis, used


def opened(columns: np.ndarray, places: int) -> np.ndarray:
    """Configurations without so many of their smallest places; the largest one stays."""
    out = columns.copy()
    for column in out.T:
        for _ in range(min(places, int(column.sum()) - 1)):
            column[np.nonzero(column)[0][-1]] -= 1
    return out


def substituted(groups: list, columns: np.ndarray, times: np.ndarray, capacity: int, left: np.ndarray) -> list[Run]:
    """Put actual pieces in the places of the sizes; takes them out of ``left``."""
    queues = [[list(x) for x in pieces] for _, pieces in groups]
    runs = []
    for column, count in zip(columns.T, times, strict=True):
        if not count:
            continue
        slots = []  # per place: [(length, number)], together count pieces
        for group in np.nonzero(column)[0]:
            for _ in range(int(column[group])):
                slot, missing, queue = [], int(count), queues[group]
                while missing and queue:
                    taken = min(missing, queue[0][1])
                    slot.append([queue[0][0], taken])
                    left[queue[0][0]] -= taken
                    missing -= taken
                    queue[0][1] -= taken
                    if not queue[0][1]:
                        queue.pop(0)
                if missing:  # rounding let a configuration ask for more than there is
                    slot.append([0, missing])
                slots.append(slot)
        while slots[0]:
            n = min(slot[0][1] for slot in slots)
            lengths = tuple(slot[0][0] for slot in slots if slot[0][0])
            runs.append(Run(n, lengths, capacity - sum(lengths)))
            for slot in slots:
                slot[0][1] -= n
                if not slot[0][1]:
                    slot.pop(0)
    return runs


def best_fit(runs: list[Run], left: np.ndarray, capacity: int) -> list[Run]:
    """Put what is left, the longest first, where the least space stays over; equal sequences at once."""
    by_free: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        by_free[run.free].append(run)
    spaces = np.zeros(capacity + 1, bool)
    spaces[list(by_free)] = True

    def put(run: Run) -> None:
        by_free[run.free].append(run)
        spaces[run.free] = True

    for length in range(capacity, 0, -1):
        number = int(left[length])
        while number:
            fits = np.nonzero(spaces[length:])[0]
            if len(fits):
                free = length + int(fits[0])
                run = by_free[free].pop()
                spaces[free] = bool(by_free[free])
            else:
                free = capacity
                run = Run(-(-number // (capacity // length)), (), capacity)
            # A sequence that took a piece is the best fit of the next one, until it is full.
            each = free // length
            whole = min(run.count, number // each)
            if whole:
                put(Run(whole, run.lengths + (length,) * each, free - each * length))
                number -= whole * each
            if whole < run.count and number and number < each:
                put(Run(1, run.lengths + (length,) * number, free - number * length))
                whole, number = whole + 1, 0
            if whole < run.count:
                put(Run(run.count - whole, run.lengths, free))
    return [run for same in by_free.values() for run in same if run.lengths]


def plan_sequences(counts: np.ndarray, capacity: int, groups: int = GROUPS, large: int = LARGE) -> list[Run]:
    """Sequences for ``counts[length]`` pieces of each length up to the capacity."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    whole = [Run(int(left[capacity]), (capacity,), 0)] if left[capacity] else []
    left[capacity] = 0
    sized = grouped(left, capacity // large + 1, groups)
    if not sized:
        return whole + best_fit([], left, capacity)
    sizes = np.array([size for size, _ in sized])
    demand = np.array([sum(n for _, n in pieces) for _, pieces in sized], float)
    columns, used = configurations(sizes, demand, capacity)
    times = np.floor(used + 1e-6).astype(np.int64)
    plans = []
    for places in OPEN:
        rest = left.copy()
        runs = substituted(sized, opened(columns, places), times, capacity, rest)
        plans.append(best_fit(runs, rest, capacity))
    return whole + min(plans, key=lambda runs: sum(run.count for run in runs))


@dataclass
class Places:
    """Where the pieces of each length go: sorted by ``key`` = length and first rank."""

    key: np.ndarray
    first: np.ndarray  # rank of the first piece in the row
    each: np.ndarray  # pieces of this length a sequence
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(runs: list[Run]) -> "Places":
        taken: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for run in runs:
            # Equal lengths of a sequence lie side by side, so that they are one row.
            lengths, offset = sorted(run.lengths, reverse=True), 0
            for length in dict.fromkeys(lengths):
                each = lengths.count(length)
                rows.append((length, taken[length], each, sequence, offset))
                taken[length] += run.count * each
                offset += each * length
            sequence += run.count
        length, first, each, sequences, offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        return Places(_key(length, first), first, each, sequences, offset)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, _key(length, rank), side="right") - 1
        place = rank - self.first[row]
        return self.sequence[row] + place // self.each[row], self.offset[row] + place % self.each[row] * length


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length.astype(np.int64) << 48) + rank


# --- the corpus ---------------------------------------------------------------------------------

def cut_pieces(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole sequences, and before them what is over."""
    over = n % capacity
    return ([over] if over else []) + [capacity] * (n // capacity)


def _pieces(get: Callable[[], str], text: str, key: str, capacity: int, separator: int) -> Callable:
    schema = pa.schema([
        ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("__task", pa.int64()), ("__rank", pa.int64()),
    ])
    made = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Encoder(get()))
        encoder, seen, task = made[0], defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(text)
            for low, high in text_slices(texts, 1 << 20):
                rows, parents = [], []
                for i, value in enumerate(pc.fill_null(texts[low:high], "").to_pylist(), low):
                    ids = np.append(encoder.ids(value), np.uint32(separator)).astype("<u4")
                    start = 0
                    for piece, length in enumerate(cut_pieces(len(ids), capacity)):
                        rows.append((piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, seen[length]))
                        parents.append(i)
                        seen[length] += 1
                        start += length
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(parents)), *arrays], [key, *schema.names])

    return run


def pack(
    df: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, key: str = "doc_id", text: str = "text", groups: int = GROUPS
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the document that ``load_tokenizer`` returns.
    """
    spark = df.sparkSession
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("piece", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "__task", "__rank")],
    ])
    cut = _pieces(shared(spark, tokenizer), text, key, capacity, separator)
    pieces = materialise(df.select(key, text).mapInArrow(cut, schema), "pieces")

    # At most ``capacity`` rows per task; a length that many documents have is many short rows.
    counts = materialise(pieces.groupBy("length", "__task").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[row.length] = row.n
    places = shared(spark, Places.of(plan_sequences(histogram, capacity, groups)))

    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    ranked = pieces.join(broadcast_if_small(bases, counts.count()), ["length", "__task"])

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places().find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    found = ranked.withColumn("__place", place("length", F.col("__rank") + F.col("__base")))
    return found.select(key, "piece", "start", "length", "ids_crc32", "__place.sequence_id", "__place.offset")
