"""SentencePiece encoding and decoding as a relational lattice.

A text gets one leading space and is cut into chunks (letters with their leading spaces, single
digits, other signs, spaces). The cuts are safe if no piece reaches over one, which is checked
against the piece table. For a chunk, all substrings of up to ``KEY`` signs are exploded and joined with
the piece table by equality (longer pieces by their first signs, then compared whole); the hits are edges of
the chunk's lattice, grouped by chunk and folded by a Spark ``aggregate`` into the best path (Viterbi): the
highest sum of scores, the longer last piece on ties. Pieces that shorter ones together beat are on no best
path and left out of the table. A sign without a piece of its own costs ten more than the worst piece and becomes its
UTF-8 bytes. This is what a unigram model computes; pieces of a merge-based file are used with the
scores in the file, so that the ids are the best path of these scores, not the order of merges. Sums
are in double precision (the public library adds in single, which rounds the large scores of some files).

All different chunks of all texts are solved that way, once each. Those most frequent in a sample,
``HOT_CHUNKS`` at most, become a dictionary of bounded size that every task holds. The texts are dealt by a
hash into parts of about ``PART_BYTES``; the other chunks go to the lattice once per part, and back to the
parts that have them, where each part meets its texts by a cogroup. So the results do not depend on the
dictionary, which only spares most chunks the way through the shuffles. Texts travel compressed, chunks come
back as their ids alone (which spell the chunk), and the shuffles before the lattice are removed after it.

Decoding joins the pieces and bytes and takes the leading space away: every text comes back, also
with runs of spaces, control signs or U+2581, which is treated as a sign without a piece.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; chunks longer
than ``LONG`` signs are never in the dictionary and are folded outside SQL (its arrays are copied at every
step of a fold);
repeated rows get equal ids; no rows give no rows; other columns are kept, except those named like
the outputs, which are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.llm.common import bounded_sample, give_back, shared, text_slices
from provspark.operators.storage import materialise, setting

CHUNK = r" *[\p{L}\p{M}]+|\p{Nd}| *[^\p{L}\p{M}\p{Nd} ]+| +"
CHUNKS, WORDS = regex.compile(CHUNK), regex.compile(" +[^ ]*")
OTHER, LETTER, DIGIT, SPACE = range(4)
KEY = 3
HOT_CHUNKS, SAMPLE_ROWS = 1 << 18, 10_000
LONG = 256
PART_BYTES, SLICE_BYTES = 4 << 20, 2 << 20
# So many chunks a task groups in memory before it sorts, and so many bytes of text go to one such task.
GROUPED_CHUNKS, TASK_BYTES = 1 << 15, 8 << 20
MOST_PIECES = 1 << 20
UNKNOWN_COST = 10.0
# Ids below this are written as three bytes; unknown signs have ids down to -0x110000.
LEAST_ID = -0x110000


class Pieces(NamedTuple):
    """A piece table: text (with spaces), id and score of each piece, and what single signs fall back to."""

    texts: list[str]
    ids: list[int]
    scores: list[float]
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float


def load_pieces(path: str) -> Pieces:
    """Read the piece table of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = model.get_piece_size()
    if count > MOST_PIECES:
        raise ValueError(f"{count} pieces; at most {MOST_PIECES} are broadcast")
    plain = [i for i in range(count) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    texts = [model.id_to_piece(i).replace("▁", " ") for i in plain]
    scores = [model.get_score(i) for i in plain]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        byte_ids = []
    return Pieces(texts, plain, scores, byte_ids, model.unk_id(), min(scores) - UNKNOWN_COST)


def unbeaten(pieces: Pieces) -> list[bool]:
    """Which pieces may be on a best path: all but those whose signs, as shorter pieces, have a higher sum of scores."""
    table = {t: (i, s) for t, i, s in zip(pieces.texts, pieces.ids, pieces.scores)}
    # Sums of whole numbers are exact; of others only what no rounding explains counts as higher.
    margin = 0.0 if all(float(s).is_integer() for s in pieces.scores) else 1e-9 * max(map(abs, pieces.scores))
    least = []
    for text, score in zip(pieces.texts, pieces.scores):
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end == len(text), end):
                single = pieces.unknown_score if end - start == 1 else float("-inf")
                best[end] = max(best[end], best[start] + table.get(text[start:end], (0, single))[1])
        least.append(best[-1] <= score + margin)
    return [len(t) == 1 or kept for t, kept in zip(pieces.texts, least)]


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """The table ``(piece, id, score)`` of the pieces that may be on a best path; its size is bounded by ``MOST_PIECES``."""
    table = pa.table({"piece": pieces.texts, "id": pa.array(pieces.ids, pa.int32()), "score": pieces.scores, "kept": unbeaten(pieces)})
    df = spark.createDataFrame(table)
    cut = df.where(F.size(F.regexp_extract_all("piece", F.lit(CHUNK), F.lit(0))) != 1)
    if not cut.isEmpty():
        raise ValueError(f"pieces reach over chunks: {[r.piece for r in cut.take(5)]}")
    return df.where("kept").drop("kept")


def chunks(text: Column) -> Column:
    """The chunks of a text with its leading space."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(CHUNK), F.lit(0)))


class Cut(NamedTuple):
    """Texts as words (spaces with what follows up to the next space) and the chunks of the different words.

    No chunk reaches over a word's end. ``words`` are indexes into the different ones, ``ends`` where each
    text's words begin and end; ``chunks`` of all different words after each other, by ``starts``.
    """

    words: np.ndarray
    ends: np.ndarray
    chunks: pa.Array
    starts: np.ndarray


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + lengths[i] - 1`` for all ``i``, after each other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of every sign, as ``CHUNK`` has them."""
    # One text of all signs, not an object for each: every task's Python has this table.
    kinds, signs = np.full(0x110000, OTHER, np.uint8), np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for kind, pattern in ((LETTER, r"[\p{L}\p{M}]+"), (DIGIT, r"\p{Nd}+"), (SPACE, " ")):
        for found in regex.finditer(pattern, signs):
            kinds[found.start() : found.end()] = kind
    return kinds


def cut(texts: pa.Array) -> Cut:
    """The same as ``chunks`` inside a task: only texts, not their chunks, go to Python."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")])
    # Where each space stands alone between two words a split is enough.
    odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
    lists = pc.split_pattern(pc.if_else(pc.or_(odd, pc.equal(texts, "")), None, texts), " ")
    plain, others = lists.flatten().dictionary_encode(), []
    starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    for i in np.nonzero(odd.to_numpy(zero_copy_only=False))[0]:
        found = WORDS.findall(" " + texts[int(i)].as_py())
        starts[i], lengths[i] = len(plain) + len(others), len(found)
        others += found
    more = pa.array(others, pa.string()).dictionary_encode()
    codes = np.concatenate((plain.indices.to_numpy(), more.indices.to_numpy() + len(plain.dictionary)))
    ends = np.concatenate(([0], np.cumsum(lengths)))
    if not len(codes):
        return Cut(codes, ends, pa.array([], pa.string()), np.zeros(1, np.int64))
    spaced = pc.binary_join_element_wise("", plain.dictionary, " ")
    different = pa.concat_arrays([spaced.cast(pa.string()), more.dictionary, pa.array([""])])
    _, places, data = different.buffers()
    places = np.frombuffer(places, np.int32)[: len(different)]
    signs = np.frombuffer(data, np.uint8)[: places[-1]]
    kinds = _kinds()[np.frombuffer(signs.tobytes().decode().encode("utf-32-le"), np.uint32)]
    signs = np.nonzero((signs & 0xC0) != 0x80)[0]
    # A chunk begins with each word, at a digit, and where the kind changes, unless from spaces to what they lead.
    first, before, here = np.zeros(len(signs), bool), kinds[:-1], kinds[1:]
    first[1:] = (here == DIGIT) | ((here != before) & (before != SPACE))
    first[np.searchsorted(signs, places[:-1])] = True
    begin = signs[first]
    found = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, places[-1]).astype(np.int32)), data)
    return Cut(codes[_runs(starts, lengths)], ends, found, np.searchsorted(begin, places))


def best_paths(df: DataFrame, pieces: Pieces, table: DataFrame) -> DataFrame:
    """``df`` with ``ids`` for its different ``chunk``: the lattice of every chunk and its best path.

    Unknown signs are edges too, with the id -1 - code point. A chunk beyond ``LONG`` signs has no edges but one
    to keep its row, and no ids. Other columns go along with the first edge only.
    """
    others, n = [c for c in df.columns if c != "chunk"], F.char_length("chunk")
    starts = df.select("*", F.explode(F.when(n <= LONG, F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))).alias("start"))
    parts = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(KEY), n - F.col("start")))).alias("signs"))
    parts = parts.withColumn("key", F.substring("chunk", F.col("start") + 1, F.col("signs")))
    table = table.select(F.left("piece", F.lit(KEY)).alias("key"), "piece", F.char_length("piece").alias("length"), "id", "score")
    whole = (F.col("length") == F.col("signs")) | (F.substring("chunk", F.col("start") + 1, F.col("length")) == F.col("piece"))
    edges = parts.join(F.broadcast(table), "key", "left").where(F.when(F.col("id").isNull(), F.col("signs") == 1).otherwise(whole))
    edges = edges.withColumn("end", F.col("start") + F.coalesce("length", F.lit(1)))
    code = F.when(F.col("id").isNull(), -1 - F.conv(F.right(F.hex(F.encode("key", "UTF-32")), F.lit(8)), 16, 10).cast("int"))
    edge = F.struct("end", "start", F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"), F.coalesce("id", code).alias("id"))
    along = [F.first(F.when(F.col("end") == 1, F.col(c)), ignorenulls=True).alias(c) for c in others]
    grouped = edges.groupBy("chunk").agg(F.sort_array(F.collect_list(edge)).alias("edges"), *along)

    # The best path into each position so far. Edges come by end, then start: the longer piece is first and stays on ties.
    nodes = "array<struct<score:double,ids:array<int>>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))).cast(nodes)

    def step(best: Column, e: Column) -> Column:
        origin = F.get(best, e.start)
        score = origin.score + e.score
        node = F.array(F.struct(score.alias("score"), F.concat(origin.ids, F.array(e.id)).alias("ids")))
        better = F.when(score > F.element_at(best, -1).score, F.concat(F.slice(best, F.lit(1), e.end), node)).otherwise(best)
        return F.when(F.size(best) == e.end, F.concat(best, node)).otherwise(better)

    path = F.aggregate("edges", first, step, lambda best: F.element_at(best, -1).ids)
    return grouped.select("chunk", *others, F.when(n <= LONG, path).alias("ids"))


def fold(chunk: str, pieces: dict[str, tuple[int, float]], longest: int, unknown_score: float) -> list[int]:
    """The same recurrence in plain Python, for chunks beyond ``LONG`` signs."""
    best, back = [0.0] + [float("-inf")] * len(chunk), [(0, 0)] * (len(chunk) + 1)
    for end in range(1, len(chunk) + 1):
        for start in range(max(0, end - longest), end):
            number, score = pieces.get(chunk[start:end], (None, None))
            if number is None:
                if end - start > 1:
                    continue
                number, score = -1 - ord(chunk[start]), unknown_score
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, (start, number)
    ids, at = [], len(chunk)
    while at:
        at, number = back[at]
        ids.append(number)
    return ids[::-1]


def solved_chunks(df: DataFrame, pieces: Pieces, table: DataFrame) -> DataFrame:
    """``df`` with ``ids`` for its different ``chunk``, of any length."""
    texts, longest, unknown = {t: (i, s) for t, i, s in zip(pieces.texts, pieces.ids, pieces.scores)}, max(map(len, pieces.texts)), pieces.unknown_score
    held = shared(df.sparkSession, texts)

    @F.arrow_udf("array<int>")
    def folded(long: pa.Array) -> pa.Array:
        return pa.array([c if c is None else fold(c, held(), longest, unknown) for c in long.to_pylist()], pa.list_(pa.int32()))

    solved = best_paths(df, pieces, table)
    long = F.when(F.char_length("chunk") > LONG, F.col("chunk"))
    return solved.withColumn("ids", F.coalesce("ids", folded(long)))


class Dictionary(NamedTuple):
    """Chunks with their ids after each other."""

    chunks: pa.Array
    ids: np.ndarray
    offsets: np.ndarray
    pieces: Pieces


def hot_dictionary(docs: DataFrame, key: str, pieces: Pieces, table: DataFrame, rows: int, most: int) -> Dictionary:
    """The best paths of the ``most`` most frequent chunks of about ``rows`` texts."""
    sample = bounded_sample(docs, rows, key, "text").where("text is not null")
    counted = sample.select(F.explode(chunks(F.col("text"))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
    counted = materialise(counted.where((F.col("n") > 1) & (F.char_length("chunk") <= LONG)), "chunk-counts")
    if (there := counted.count()) > most:
        # The count that leaves at most ``most`` chunks.
        by_count = counted.groupBy("n").agg(F.count("*").alias("m")).where("n <= 1000").orderBy("n").collect()
        least = 1
        for r in by_count:
            if there <= most:
                break
            there, least = there - r.m, r.n + 1
        counted = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "chunk").limit(most)
    got = best_paths(counted.select("chunk"), pieces, table).toArrow()
    got = got.combine_chunks()
    if not got.num_rows:
        return Dictionary(pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64), pieces)
    ids = pa.concat_arrays(got.column("ids").chunks)
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy())))
    return Dictionary(pa.concat_arrays(got.column("chunk").chunks), ids.flatten().to_numpy().astype(np.int32), offsets, pieces)


def _spread(ids: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Unknown signs (-1 - code point) become bytes; returns the ids and how many each entry gives."""
    many = np.ones(len(ids), np.int64)
    unknown = np.nonzero(ids < 0)[0]
    if not len(unknown):
        return ids, many
    if not pieces.byte_ids:
        return np.where(ids < 0, pieces.unknown_id, ids), many
    codes, at = np.unique(ids[unknown], return_inverse=True)
    spelt = [[pieces.byte_ids[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] for c in codes.tolist()]
    many[unknown] = np.array([len(s) for s in spelt])[at]
    out = np.repeat(ids, many)
    first = np.cumsum(many) - many
    for k, s in enumerate(spelt):
        places = first[unknown[at == k]]
        for j, number in enumerate(s):
            out[places + j] = number
    return out, many


def beyond(texts: pa.Array, held: Dictionary) -> pa.Array:
    """The different chunks of each text that the dictionary lacks."""
    there = cut(texts)
    lacks = pc.is_null(pc.index_in(there.chunks, held.chunks)).to_numpy(zero_copy_only=False)
    wanted = there.chunks.filter(pa.array(lacks)).dictionary_encode()
    # Where the lacking chunks of each word begin, then all pairs of a text and a chunk.
    before = np.concatenate(([0], np.cumsum(lacks)))[there.starts]
    many = np.diff(before)[there.words]
    rows = np.repeat(np.arange(len(texts)), np.diff(there.ends))
    size = max(1, len(wanted.dictionary))
    pairs = np.unique(np.repeat(rows, many) * size + wanted.indices.to_numpy()[_runs(before[there.words], many)])
    ends = np.searchsorted(pairs // size, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), wanted.dictionary.take(pa.array(pairs % size)))


def assemble(texts: pa.Array, held: Dictionary, names: pa.Array, more: pa.Array) -> pa.Array:
    """Ids of each text from its chunks; ``names`` and ``more`` are the chunks that the dictionary lacks and their ids."""
    there = cut(texts)
    code = pc.fill_null(pc.index_in(there.chunks, held.chunks), -1).to_numpy().astype(np.int64)
    missing = np.nonzero(code < 0)[0]
    at = pc.index_in(there.chunks.take(pa.array(missing)), names)
    if at.null_count:
        raise ValueError("a chunk is not among the solved ones")
    code[missing] = len(held.chunks) + at.to_numpy()
    ids = np.concatenate((held.ids, more.flatten().to_numpy().astype(np.int32)))
    starts = np.concatenate((held.offsets, held.offsets[-1] + np.cumsum(pc.list_value_length(more).to_numpy())))
    # The ids of every different word, then those of the texts.
    lengths = starts[code + 1] - starts[code]
    out, many = _spread(ids[_runs(starts[code], lengths)], held.pieces)
    spread = np.concatenate(([0], np.cumsum(many)))
    words = spread[np.concatenate(([0], np.cumsum(lengths)))[there.starts]]
    lengths = np.diff(words)[there.words]
    ends = np.concatenate(([0], np.cumsum(lengths)))[there.ends].astype(np.int32)
    missing_text = pc.is_null(texts).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out[_runs(words[there.words], lengths)]), mask=pa.array(missing_text))


def _narrow(ids: pa.Array) -> pa.Array:
    """Lists of ids, those of unknown signs too, as three bytes an id."""
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy()))).astype(np.int32)
    flat = (ids.flatten().to_numpy().astype(np.int32) - LEAST_ID).astype("<u4").view(np.uint8).reshape(-1, 4)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(3 * ends), pa.py_buffer(flat[:, :3].tobytes())])


def _wide(narrow: pa.Array) -> pa.Array:
    """The lists of ids that ``_narrow`` was given."""
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(narrow).to_numpy()))) // 3
    flat = np.zeros((ends[-1], 4), np.uint8)
    flat[:, :3] = np.frombuffer(b"".join(narrow.to_pylist()), np.uint8).reshape(-1, 3)
    flat = flat.view("<u4").ravel().astype(np.int32) + np.int32(LEAST_ID)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def spelling_of(ids: pa.Array, pieces: Pieces) -> pa.Array:
    """The chunks that lists of ids, with unknown signs as -1 - code point, come from."""
    flat = ids.flatten().to_numpy()
    unknown, at = np.unique(flat[flat < 0], return_inverse=True)
    place = np.zeros(max(pieces.ids) + 1, np.int64)
    place[pieces.ids] = np.arange(len(pieces.ids))
    places = place[np.maximum(flat, 0)]
    places[flat < 0] = len(pieces.ids) + at
    spelt = pa.array([*pieces.texts, *(chr(-1 - c) for c in unknown.tolist())], pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, spelt.take(pa.array(places))), "")


def _squeezed(texts: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", 3)
    return pa.array([codec.compress(t.as_buffer(), asbytes=True) if t.is_valid else None for t in texts], pa.binary())


def _unsqueezed(squeezed: pa.Array, sizes: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    texts = [None if t is None else codec.decompress(t, n, asbytes=True) for t, n in zip(squeezed.to_pylist(), sizes.to_pylist())]
    return pa.array(texts, pa.binary()).cast(pa.string())


def encode(
    docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", out: str = "ids",
    decoded: str | None = None, sample_rows: int = SAMPLE_ROWS, hot_chunks: int = HOT_CHUNKS, task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """Add ``out``: the piece ids of each text; with ``decoded`` also the text read back from the ids, in the same pass.

    With less ``task_bytes`` the lattice has more tasks, which take less memory and more time in all; the results are the same.
    """
    spark = docs.sparkSession
    docs = docs.drop(out, *([decoded] if decoded else []))
    whole, table = F.col(text), piece_table(spark, pieces)
    hot = hot_dictionary(docs.select(F.col(key).alias("key"), whole.alias("text")), "key", pieces, table, sample_rows, hot_chunks)
    held, spelt = shared(spark, hot), shared(spark, _spelling(pieces))

    @F.arrow_udf("array<string>")
    def lacking(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for low, high in text_slices(texts, SLICE_BYTES):
                yield beyond(texts[low:high], held())

    @F.arrow_udf("binary")
    def narrowed(ids: pa.Array) -> pa.Array:
        return _narrow(ids)

    @F.arrow_udf("binary")
    def squeezed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _squeezed(texts)
        give_back()

    # Copies of a text are dealt by their key, so that no part grows with them.
    part = "_part" + "_" * max(map(len, docs.columns))  # no column has this name
    size = docs.agg(F.sum(F.octet_length(whole))).first()[0] or 0
    dealt = docs.withColumn(part, F.pmod(F.xxhash64(key, whole), F.lit(size // PART_BYTES + 1)).cast("int"))
    pairs = dealt.select(F.col(part).alias("part"), F.explode(lacking.asNondeterministic()(whole)).alias("chunk"))
    pairs = pairs.repartition(size // task_bytes + 1, "chunk")
    with (
        setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPED_CHUNKS)),
        setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"),
    ):
        wanted = pairs.groupBy("chunk").agg(F.collect_set("part").alias("parts"))
        solved = materialise(solved_chunks(wanted, pieces, table).select("parts", "ids"), "solved")
    solved = solved.select("parts", narrowed("ids").alias("ids")).select(F.explode("parts").alias(part), "ids")

    fields = [f for f in dealt.schema.fields if f.name != part]
    dealt = dealt.withColumn(text, F.struct(F.octet_length(whole).alias("size"), squeezed(whole).alias("bytes")))
    fields.append(T.StructField(out, T.ArrayType(T.IntegerType())))
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))

    def assembled(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows, more = rows.drop_columns([part]), _wide(_array(known.column("ids")))
        names, packed = spelling_of(more, held().pieces), _array(rows.column(text))
        texts, done, read = _unsqueezed(packed.field("bytes"), packed.field("size")), [], []
        for low, high in text_slices(texts, SLICE_BYTES):
            done.append(assemble(texts[low:high], held(), names, more))
            if decoded:
                read.append(_joined(done[-1], spelt()))
        rows = rows.set_column(rows.column_names.index(text), text, texts)
        rows = rows.append_column(out, pa.chunked_array(done, pa.list_(pa.int32())))
        return rows.append_column(decoded, pa.chunked_array(read, pa.string())) if decoded else rows

    return dealt.groupBy(part).cogroup(solved.groupBy(part)).applyInArrow(assembled, T.StructType(fields))


def _array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _spelling(pieces: Pieces) -> pa.Array:
    spelt = {i: t.encode("utf-8", "surrogatepass") for t, i in zip(pieces.texts, pieces.ids)}
    spelt |= {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
    spelt.setdefault(pieces.unknown_id, " ⁇ ".encode())
    return pa.array([spelt.get(i, b"") for i in range(max(spelt) + 1)], pa.binary())


def _joined(ids: pa.Array, spelt: pa.Array) -> pa.Array:
    """The text of each list of ids without its leading space."""
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), spelt.take(ids.flatten())), b"")
    try:
        texts = pc.utf8_slice_codeunits(whole.cast(pa.string()), 1)
    except pa.ArrowInvalid:  # ids that no text has: bytes that are no sign
        texts = pa.array([t.decode("utf-8", "replace")[1:] for t in whole.to_pylist()], pa.string())
    return pc.if_else(ids.is_valid(), texts, None)


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the ids."""
    spelt = shared(df.sparkSession, _spelling(pieces))

    @F.arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        return _joined(ids, spelt())

    return df.withColumn(out, decoded(F.col(ids)))
