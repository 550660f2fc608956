"""Encoding against the public library's own unigram decoder on the same pieces, and exact round trips."""

import os
import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from provspark.llm import pieces
from provspark.llm.queries import PIECE_MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="vocabulary files not present")


@pytest.fixture(scope="module")
def model():
    return pieces.load_pieces(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    with open(PIECE_MODEL, "rb") as file:
        proto = file.read()
    # The trainer settings name the kind of model: 2 is merges, 1 is unigram.
    assert proto.count(b"\x12\x06tok_v0\x18\x02") == 1
    return sentencepiece.SentencePieceProcessor(model_proto=proto.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01"))


def texts():
    draw = random.Random(8)
    parts = ["the", "Haus", " ", "  ", "   ", "\n", "é", "ß", "12", "3.4", "²", "😀", "ﬁ", "\t", "a@b.c", "#", "…", "ing", "œuvre", ");", "مرحبا", "漢字", "é"]
    made = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(300)]
    made += ["x", " ", "     ", "a  b", "word " * 3000, "The quick brown fox, jumps over 13 dogs.\nAnd re-enters."]
    return made


def test_same_as_library(spark, model, library):
    # Words with a piece for their first letter: others cost 1e9, where the library's single precision rounds.
    draw = random.Random(9)
    parts = ["ther", "ing", "Haus", "keit", "éc", "o", "ß", "ed", "tion", ",", ".", "xq", "zw"]
    rows = [(i, " ".join("w" + "".join(draw.choice(parts) for _ in range(draw.randint(0, 5))) for _ in range(8))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.ids for r in pieces.encode(df, model).collect()}
    for i, text in rows:
        assert found[i] == library.encode(text), text


def test_chunks_give_the_best_path_of_the_text(spark, model):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    table = {t: (i, s) for t, i, s in zip(model.texts, model.ids, model.scores)}
    for hot in (1 << 19, 50):
        found = {r.doc_id: r.ids for r in pieces.encode(df, model, hot_chunks=hot).collect()}
        for i, text in rows:
            best = pieces.fold(" " + text, table, 16, model.unknown_score)
            spelt = [b for x in best for b in ([x] if x >= 0 else [model.byte_ids[c] for c in chr(-1 - x).encode()])]
            assert found[i] == spelt, text


def test_round_trip_and_cases(spark, model):
    longest = "".join(random.Random(1).choice("abcdeé") for _ in range(20_000))
    rows = [(0, None), (1, ""), (2, "▁ a ▁▁b"), (3, longest), (4, "a" * 300 + " b"), (5, "\x00\x01  x"), (None, "same"), (None, "same"), (7, "same"), (7, "same"), (7, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("old"))
    done = pieces.decode(pieces.encode(df, model, decoded="too"), model).collect()
    assert len(done) == len(rows) and all(r.too == r.decoded for r in done)
    for r in done:
        assert r.decoded == r.text
        assert (r.ids is None) == (r.text is None) and (r.text != "" or r.ids == [])
    assert pieces.encode(df.limit(0), model).count() == 0


def test_fold_is_the_best_path(model):
    table = {t: (i, s) for t, i, s in zip(model.texts, model.ids, model.scores)}
    longest = max(map(len, table))

    def brute(chunk):
        if not chunk:
            return 0.0
        cuts = (model.unknown_score + brute(chunk[1:]) if chunk[0] not in table else float("-inf"),)
        return max(*cuts, *[table[chunk[:n]][1] + brute(chunk[n:]) for n in range(1, len(chunk) + 1) if chunk[:n] in table], float("-inf"))

    score = {i: s for i, s in zip(model.ids, model.scores)}
    draw = random.Random(2)
    for _ in range(100):
        chunk = "".join(draw.choice(" thering") for _ in range(draw.randint(1, 9)))
        ids = pieces.fold(chunk, table, longest, model.unknown_score)
        assert sum(score[i] if i >= 0 else model.unknown_score for i in ids) == pytest.approx(brute(chunk))


def test_pieces_over_chunks_are_refused(spark, model):
    with pytest.raises(ValueError, match="reach over"):
        pieces.piece_table(spark, model._replace(texts=["ab.c", *model.texts[1:]]))


def test_all_chunks_go_through_the_lattice_of_spark(spark, model, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts()) if len(t) < 500] + [(1000, "x" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met, inner = set(), pieces.solved_chunks

    def seen(df, *rest):
        met.update(r.chunk for r in df.select("chunk").collect())
        return inner(df, *rest)

    monkeypatch.setattr(pieces, "solved_chunks", seen)
    assert all(r.text == r.decoded for r in pieces.encode(df, model, decoded="decoded", hot_chunks=5).collect())
    chunks = {c for _, t in rows for c in pieces.CHUNKS.findall(" " + t)}
    assert met <= chunks and len(chunks - met) <= 5


def test_chunks_go_back_once_for_each_part(spark, model, monkeypatch):
    rows = [(i, f"zqvorl {t}") for i, t in enumerate(texts()) if len(t) < 500] + [(1000 + i, "a copy xwjq") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met, inner = [], pieces.solved_chunks

    def seen(df, *rest):
        met.extend(df.select("chunk", "parts").collect())
        return inner(df, *rest)

    monkeypatch.setattr(pieces, "solved_chunks", seen)
    monkeypatch.setattr(pieces, "PART_BYTES", 3000)
    done = pieces.encode(df, model, decoded="decoded", hot_chunks=0).collect()
    assert sorted((r.doc_id, r.decoded) for r in done) == rows and all(r.text == r.decoded for r in done)
    parts = sum(len(t.encode()) for _, t in rows) // 3000 + 1
    assert 3 < parts < 100 and len({r.chunk for r in met}) == len(met)
    found = {r.chunk: r.parts for r in met}
    # Texts of one word lie in all parts; copies of a text do not make a part grow.
    assert sorted(found[" zqvorl"]) == sorted(found[" xwjq"]) == list(range(parts))


def test_cut_is_the_same_as_the_pattern():
    draw = random.Random(4)
    parts = ["the", " ", "  ", "\n", "é", "12", "0", "²", "😀", "#", "\t", "漢字", "."]
    for n in (0, 1, 30):
        rows = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(n)] + [None, "", " ", "a ", "  5"]
        there = pieces.cut(pieces.pa.array(rows, pieces.pa.string()))
        for text, low, high in zip(rows, there.ends[:-1], there.ends[1:]):
            found = [c for w in there.words[low:high] for c in there.chunks.to_pylist()[there.starts[w] : there.starts[w + 1]]]
            assert found == (pieces.CHUNKS.findall(" " + text) if text else [])


def test_beaten_pieces_are_left_out(spark, model):
    small = pieces.Pieces(["a", "b", " ", "ab", "aba", "bab", "abab"], [0, 1, 2, 3, 4, 5, 6], [-5.0, -5.0, -5.0, -3.0, -9.0, -8.0, -6.0], [], 9, -19.0)
    # aba (-9) is beaten by ab + a (-8); bab and abab only equal theirs, and the longer last piece stays on ties.
    kept = {r.piece for r in pieces.piece_table(spark, small).collect()}
    assert kept == {"a", "b", " ", "ab", "bab", "abab"}
    assert {r.piece for r in pieces.piece_table(spark, model).collect()} < set(model.texts)


def test_lattice_is_the_fold_with_all_pieces(spark, model):
    # Long pieces are found by their first signs: some chunks have all of one, others only these signs.
    draw = random.Random(6)
    long = draw.sample([t for t in model.texts if len(t) > pieces.KEY and " " not in t], 300)
    made = {w for t in long for w in (t, t[:-1] + "q", t + draw.choice(long), "é😀" + t)}
    made |= {"=" * n for n in range(1, 40)} | {" " * n for n in range(1, 40)}
    table = {t: (i, s) for t, i, s in zip(model.texts, model.ids, model.scores)}
    df = spark.createDataFrame([(c,) for c in made], "chunk string")
    done = pieces.best_paths(df, model, pieces.piece_table(spark, model)).collect()
    assert {r.chunk for r in done} == made
    for r in done:
        assert r.ids == pieces.fold(r.chunk, table, 16, model.unknown_score), r.chunk


def test_chunks_return_as_ids(model):
    rows = [[], [5, 260, 31999], [-1 - ord("😀"), -1 - 0x10FFFF, 0], [-1, 261]]
    ids = pieces.pa.array(rows, pieces.pa.list_(pieces.pa.int32()))
    assert pieces._wide(pieces._narrow(ids)).to_pylist() == rows
    table = {t: (i, s) for t, i, s in zip(model.texts, model.ids, model.scores)}
    chunks = sorted({c for t in texts() for c in pieces.CHUNKS.findall(" " + t) if len(c) < 300})
    paths = pieces.pa.array([pieces.fold(c, table, 16, model.unknown_score) for c in chunks], pieces.pa.list_(pieces.pa.int32()))
    assert pieces.spelling_of(pieces._wide(pieces._narrow(paths)), model).to_pylist() == chunks


def test_texts_travel_compressed_and_shuffles_before_the_lattice_go(spark, model, monkeypatch):
    draw = random.Random(5)
    words = ["".join(draw.choice("abdeiklnorstu") for _ in range(draw.randint(3, 9))) for _ in range(3000)]
    rows = [(i, " ".join(draw.choices(words, k=400))) for i in range(400)]
    size = sum(len(t) for _, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        there = files.getAllFiles().mkString("\n").split("\n")
        return {f: os.path.getsize(f) for f in there if re.search(r"shuffle_.*\.data$", f) and os.path.exists(f)}

    before, kept = set(shuffled()), []
    inner = pieces.materialise

    def seen(df, kind, *rest):
        done = inner(df, kind, *rest)
        if kind == "solved":
            kept.append({f: n for f, n in shuffled().items() if f not in before})
        return done

    monkeypatch.setattr(pieces, "materialise", seen)
    done = pieces.encode(df, model, decoded="decoded", sample_rows=10, hot_chunks=0)
    assert sorted((r.doc_id, r.decoded) for r in done.collect()) == rows
    moved = {f: n for f, n in shuffled().items() if f not in before and f not in kept[0]}
    assert sum(kept[0].values()) < 0.05 * size and 0 < sum(moved.values()) < 0.55 * size


def test_table_of_signs_takes_little_memory():
    pieces._kinds.cache_clear()
    tracemalloc.start()
    try:
        kinds = pieces._kinds()
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()
    assert [kinds[ord(c)] for c in "é7 .\ud800"] == [pieces.LETTER, pieces.DIGIT, pieces.SPACE, pieces.OTHER, pieces.OTHER]


def test_a_task_of_the_pipelines_lattice_groups_far_fewer_chunks_than_it_may(spark, monkeypatch):
    import corpus_pipeline

    class Seen(Exception):
        pass

    def name(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    def seen(df, *rest):
        counts = df.groupBy(F.spark_partition_id().alias("task")).count().collect()
        raise Seen(len(counts), max(r["count"] for r in counts), sum(r["count"] for r in counts))

    # A chunk of its own in 190 signs: natural texts of 0.5 GB have fewer.
    rows = [(i, " ".join(f"w{name(1000 * i + j)}" + " the" * 46 for j in range(1000))) for i in range(96)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"lang": F.lit("en"), "source": F.lit("x")})
    monkeypatch.setattr(pieces, "solved_chunks", seen)
    with pytest.raises(Seen) as found:
        corpus_pipeline.tokenise(spark, df, "")
    tasks, most, chunks = found.value.args
    assert chunks == 96_000 and tasks > 3 and most < 0.75 * pieces.GROUPED_CHUNKS
