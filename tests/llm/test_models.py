"""Toxicity, language, decontamination: gradients, brute force and held-out accuracy."""

import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provspark.llm import decontaminate, langid, queries, toxicity
from provspark.llm.common import EDGES, held_out
from provspark.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR_LLM", "/root/testdata/sf0.01")
LARGER = "/root/testdata/sf0.1"
data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


def test_gradients_of_the_network():
    draw = np.random.default_rng(1)
    words = toxicity.Vocabulary(["abc", "b", "für", "zz", "longer"])
    codes = draw.integers(0, 5, (3, toxicity.WINDOW))
    codes[0, 5:] = -1
    codes[1, 20:] = -1
    labels, model = np.array([1.0, 0.0, 1.0]), toxicity.new_model(3)
    _, grads = toxicity.gradients(model, words, codes, labels)
    for name, g in grads.items():
        flat, step = model[name].reshape(-1), 1e-6
        places = np.argsort(-np.abs(g.reshape(-1)))[:6]
        for at in places:
            old = flat[at]
            flat[at] = old + step
            up = toxicity.gradients(model, words, codes, labels)[0]
            flat[at] = old - step
            down = toxicity.gradients(model, words, codes, labels)[0]
            flat[at] = old
            assert (up - down) / (2 * step) == pytest.approx(g.reshape(-1)[at], rel=1e-4, abs=1e-8), name


def test_letter_trigrams():
    words = toxicity.Vocabulary(["ab", "cde", "f"])
    assert len(words.letter) == 6 and list(words.first) == [0, 2, 5]
    assert list(words.letter[2:5]) == list(toxicity.Vocabulary(["cde"]).letter)
    part = toxicity._subset(words, np.array([0, 2]))
    assert list(part.letter) == list(words.letter[[0, 1, 5]])


def test_windows_cover_every_word():
    offsets = np.array([0, 0, 1, 33, 66, 66 + 500])
    position, text, first = toxicity.windows_of(offsets)
    for t in range(5):
        seen = set(position[text == t].ravel()) - {-1}
        assert seen == set(range(offsets[t], offsets[t + 1]))
    assert (text == 0).sum() == 0 and (text == 3).sum() == 2


@data
def test_toxicity_held_out(spark):
    found = QUERIES["op6_toxicity"](spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.93
    assert hits >= 0.6 * sum(r.toxic for r in rows)


def test_toxicity_cases(spark):
    draw = random.Random(2)
    clean = [" ".join(draw.choice("red green blue black white grey".split()) for _ in range(draw.randint(1, 90))) for _ in range(150)]
    toxic = [c + " idiot! " + c for c in clean[:60]]
    rows = [(i, t) for i, t in enumerate(clean + toxic)] + [(500, None), (501, ""), (502, "..."), (503, "idiot"), (504, "red " * 50_000 + "idiot"), (None, "red"), (1, clean[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("old"))
    labels = spark.createDataFrame([(i, int(i >= 150)) for i in range(210)] + [(None, 1), (3, None), (900, 1)], "doc_id long, toxic int")
    scored = toxicity.with_toxicity(docs, toxicity.fit(docs.drop("toxicity"), labels)).collect()
    by_id = {r.doc_id: r.toxicity for r in scored}
    assert len(scored) == len(rows) and by_id[500] == by_id[501] == by_id[502] == 0
    assert by_id[503] > 0.5 and by_id[504] > 0.5 and by_id[None] < 0.5
    assert all(by_id[i] < 0.5 for i in range(150)) and all(by_id[i] > 0.5 for i in range(150, 210))
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert none is None and toxicity.with_toxicity(docs, none).agg(F.max("toxicity")).first()[0] == 0
    assert toxicity.fit(docs.limit(0), labels) is None


@data
def test_language_held_out(spark):
    found = QUERIES["op7_langid"](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    texts = {"en": "the house and the garden with that", "de": "das haus und der garten mit dem", "fr": "la maison et le jardin avec ce", "xx": "qoq zuz qaq"}
    rows = [(i, t, lang) for lang, t in texts.items() for i in range(20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 .,", "en"), (103, "the house", None), (104, "das haus " * 50_000, None), (105, "😀", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    model = langid.fit(docs.where("doc_id < 100"))
    assert model.languages == ["de", "en", "fr", "xx"] and model.families == ["germanic", "romance", "xx"]
    found = {(r.doc_id, r.lang): r for r in langid.with_language(docs, model).collect()}
    assert all(r.lang_pred == lang for (i, lang), r in found.items() if i < 100)
    assert [found[i, "en"].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and found[105, None].lang_pred == "und"
    assert found[103, None].lang_pred == "en" and found[104, None].lang_pred == "de"
    assert langid.with_language(docs, langid.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    one = langid.fit(docs.where("lang = 'en' and doc_id < 100"))
    assert {r.lang_pred for r in langid.with_language(docs, one).collect()} == {"en", "und"}


def test_features_do_not_mix_texts():
    texts = pa.array(["abc", "", "Äb c1d", None, "abc"], pa.string())
    x, some = langid.features(texts)
    assert list(some) == [True, False, True, False, True] and (x[0] == x[4]).all()
    for i, t in enumerate(texts):
        alone, _ = langid.features(pa.array([t.as_py()], pa.string()))
        assert np.allclose(alone[0], x[i])


def smith_waterman(part, window):
    best, above = 0.0, [0.0] * (len(window) + 1)
    for p in part:
        here = [0.0]
        for j, w in enumerate(window):
            here.append(max(0.0, above[j] + (1 if p == w else -0.5), above[j + 1] - 0.5, here[j] - 0.5))
        best, above = max(best, *here), here
    return best


def test_alignment():
    draw = random.Random(4)
    parts = [[draw.randint(0, 6) for _ in range(draw.randint(1, 30))] for _ in range(60)]
    windows = [[draw.randint(-1, 6) for _ in range(draw.randint(0, 40))] for _ in range(60)]
    found = decontaminate.align([np.array(p) for p in parts], [np.array(w, np.int64) for w in windows])
    assert found == pytest.approx([smith_waterman(p, w) for p, w in zip(parts, windows)])


def test_leaks(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(5000)] + ["the"] * 2000 + ["of"] * 1000
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, prose(draw.randint(20, 60))) for i in range(30)] + [(30, prose(900)), (31, None), (32, ""), (33, "one pair"), (None, prose(40))]

    def edited(text):
        return " ".join(draw.choice(words) if draw.random() < 0.2 else w for w in text.split())

    rows, expected = [(i, prose(draw.randint(0, 300))) for i in range(200)], set()
    for i in range(31):
        rows += [(1000 + i, f"{prose(50)} {items[i][1].upper()}. {prose(50)}"), (2000 + i, f"{prose(9)}\n{edited(items[i][1])}")]
        expected |= {(1000 + i, i), (2000 + i, i)}
    rows += [(3000, " ".join(items[30][1].split()[400:600])), (3001, None), (3002, ""), (3003, "has One, pair!"), (3004, items[34][1])]
    rows += [(3005, prose(30_000) + " " + items[5][1]), (None, items[6][1]), (3006, items[1][1] + " " + items[2][1]), (1000, rows[200][1])]
    expected |= {(3000, 30), (3003, 33), (3004, None), (3005, 5), (None, 6), (3006, 1), (3006, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaks", F.lit(0)).repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for words_per_block in (decontaminate.BLOCK_WORDS, 500):
        decontaminate.BLOCK_WORDS, old = words_per_block, decontaminate.BLOCK_WORDS
        try:
            done = decontaminate.with_leaks(docs, benchmark)
            found = [(r.doc_id, x.item_id) for r in done.collect() for x in r.leaks]
        finally:
            decontaminate.BLOCK_WORDS = old
        assert set(found) == expected and len(found) == len(expected) + 1
    assert decontaminate.with_leaks(docs, benchmark.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontaminate.with_leaks(docs.limit(0), benchmark).count() == 0


def test_leaks_of_an_item_that_many_documents_hold(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    own, common = [f"own{i}" for i in range(40)], [f"w{i}" for i in range(40)]
    rows = [(i, f"{prose(30)} {' '.join((own, common)[i % 2])} {prose(30)}") for i in range(100)]
    rows += [(100 + i, prose(100)) for i in range(50)] + [(200, " ".join(own[10:])), (201, " ".join(common[10:])), (202, f"{prose(9)} {' '.join(own[:30])}")]
    benchmark = spark.createDataFrame([(0, " ".join(own)), (1, " ".join(common))], "item_id long, text string")
    done = decontaminate.with_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    found = {r.doc_id: [(x.item_id, round(x.score, 6)) for x in r.leaks] for r in done if r.leaks}
    assert found == {**{i: [(i % 2, 1.0)] for i in range(100)}, 200: [(0, 0.75)], 201: [(1, 0.75)], 202: [(0, 0.75)]}


def test_short_item_that_many_documents_hold(spark):
    """A whole item of five words tells, however many copies of it there are."""
    draw = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    for copies in (1, 100):
        rows = [(i, f"{prose(20)} where did zorro hide gold {prose(20)}") for i in range(copies)] + [(1000 + i, prose(40)) for i in range(200)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        done = decontaminate.with_leaks(docs, spark.createDataFrame([(7, "Where did Zorro hide gold?")], "item_id long, text string"))
        told = {r.doc_id for r in done.select("doc_id", decontaminate.telling_leaks(done.leaks).alias("x")).where("size(x) > 0").collect()}
        assert told == set(range(copies))


def test_leaks_of_excerpts(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    some = lambda n: [draw.choice(words) for _ in range(n)]
    own, rows = some(300), []
    for n in (32, 50, 60, 63, 64):
        rows += [(1000 * n + at, " ".join(some(80) + own[at : at + n] + some(80))) for at in range(0, 301 - n, 23)]
    rows += [(at, " ".join(some(20) + [draw.choice(words) if i % 5 == 2 else w for i, w in enumerate(own[at : at + 85])])) for at in (0, 40, 120, 215)]
    others = [(500 + i, " ".join(some(60) + own[9 * i : 9 * i + 20] + some(60))) for i in range(30)]
    docs = spark.createDataFrame(rows + others, "doc_id long, text string")
    done = decontaminate.with_leaks(docs, spark.createDataFrame([(7, " ".join(own))], "item_id long, text string"))
    found = {r.doc_id: r.leaks[0] for r in done.where("size(leaks) > 0").collect()}
    assert set(found) == {i for i, _ in rows}
    assert all(x.item_id == 7 and 0.2 < x.score <= 1 for x in found.values())


def test_short_items_tell_only_if_whole_and_rare(spark, tmp_path):
    draw = random.Random(10)
    words = [f"w{i}" for i in range(5000)] + ["what"] * 100 + ["is"] * 400 + ["the"] * 700
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(0, "What is the capital of Zembla?"), (1, "yes"), (2, "the is"), (3, "is the what"), (4, "what is the long river that runs through Zembla")]
    rows = [(i, prose(100)) for i in range(100)]
    rows += [(200, prose(20) + " what is the matter"), (201, "yes"), (202, prose(9) + " is the what"), (203, prose(30) + " what is the capital of Zembla " + prose(30))]
    rows += [(204, "what is the long river that flows through Zembla"), (205, "what is the long walk")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    done = {r.doc_id: {x.item_id: x.telling for x in r.leaks} for r in decontaminate.with_leaks(docs, benchmark).collect()}
    assert done[200] == {0: False} and done[201] == {1: False} and done[202][3] is False
    assert done[203][0] is True and done[204][4] is True and done[205] == {0: False}
    assert {i for i in done if True in done[i].values()} == {203, 204}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {(r.doc_id, r.item_id) for r in queries.op5_decontaminate(spark, str(tmp_path)).collect()} == {(203, 0), (204, 4)}
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert {i for i, _ in rows} - {r.doc_id for r in kept.collect()} == {203, 204}


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", held_out("id", 5, 0).alias("h")).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)]


# --- whole scores against plain loops ----------------------------------------------------------------

def plain_gru(model, side, inputs):
    """States of one direction, one word at a time."""
    h, now, out = toxicity.HIDDEN, np.zeros(toxicity.HIDDEN), []
    for x in inputs if side == "f" else inputs[::-1]:
        a, s = x @ model[f"{side}_in"] + model[f"{side}_bias"], now @ model[f"{side}_state"]
        z, r = (1 / (1 + np.exp(-(a[i : i + h] + s[i : i + h]))) for i in (0, h))
        new = np.tanh(a[2 * h :] + r * s[2 * h :])
        now = z * now + (1 - z) * new
        out.append(now)
    return out if side == "f" else out[::-1]


def plain_score(model, text):
    words = [w.strip(EDGES) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]
    inputs = [toxicity.Vocabulary([w]).inputs(model)[0] for w in words if w.strip(EDGES)]
    if not inputs:
        return 0.0
    best, start = -math.inf, 0
    while True:
        window = inputs[start : start + toxicity.WINDOW]
        both = [np.concatenate(x) for x in zip(plain_gru(model, "f", window), plain_gru(model, "b", window))]
        weights = [math.exp(np.tanh(x @ model["look"]) @ model["weigh"]) for x in both]
        pooled = sum(w * x for w, x in zip(weights, both)) / sum(weights)
        best = max(best, pooled @ model["out"] + model["bias"][0])
        if start + toxicity.WINDOW >= len(inputs):
            break
        start += toxicity.STRIDE
    slope, offset = model["curve"]
    return 1 / (1 + math.exp(-(slope * best + offset)))


def test_toxicity_scores_window_by_window():
    draw = random.Random(14)
    model = {k: v * 2 for k, v in toxicity.new_model(5).items()} | {"curve": np.array([1.5, -0.2])}
    words = [f"word{i}" for i in range(50)] + ["«quoted»", "don't", "É", "...", "a-b", "x"]
    texts = [" ".join(draw.choice(words) for _ in range(n)) for n in (1, 2, 15, 16, 17, 31, 32, 33, 47, 48, 49, 64, 100, 333)]
    texts += ["", None, " ... ", "one\n\ttwo"]
    found = toxicity.scores(model, pa.array(texts))
    assert np.allclose(found, [plain_score(model, t or "") for t in texts], atol=1e-6)


def test_languages_pair_by_pair():
    """The family by all pairs of families, then the language by all pairs inside it."""
    draw = np.random.default_rng(15)
    names = np.array(["en", "de", "nl", "fr", "es", "it", "fi"])
    centres = draw.normal(size=(len(names), 30))
    x = (centres.repeat(20, axis=0) + draw.normal(size=(140, 30))).astype(np.float32)
    model = langid.Model(x, names.repeat(20))
    family, languages = {n: langid.FAMILY.get(n, n) for n in names}, sorted(names)
    rows = draw.normal(size=(60, 30)).astype(np.float32)

    def winner(row, options, pairs, weights):
        wins, sums, least = dict.fromkeys(options, 0), dict.fromkeys(options, 0.0), dict.fromkeys(options, math.inf)
        for (a, b), w in zip(pairs, weights):
            v = float(np.dot(row.astype(float), w[:-1].astype(float)) + w[-1])
            a, b = options[a], options[b]
            wins[a if v >= 0 else b] += 1
            for name, margin in ((a, v), (b, -v)):
                sums[name] += margin
                least[name] = min(least[name], margin)
        best = max(options, key=lambda n: (wins[n] + 1e-3 * math.tanh(sums[n]), -options.index(n)))
        return best, 1 / (1 + math.exp(-3 * min(least[best], 30)))

    found, scores = model.predict(rows)
    families = sorted(set(family.values()))
    for row, number, score in zip(rows, found, scores):
        own, chance = winner(row, families, *model.levels[0][1:])
        inside = [n for n in languages if family[n] == own]
        best, second = winner(row, inside, *model.levels[1 + families.index(own)][1:])
        assert model.languages[number] == best and abs(score - chance * second) < 1e-4
