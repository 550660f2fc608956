"""Filter interactions against a plain count over all orders."""

import itertools
import random
import re

from provspark.llm import interaction
from provspark.llm.queries import FAILS

SCHEMA = "doc_id long, text string, lang string, n_chars long, __mask string, masks string"


def brute(rows, labels):
    texts = [(i, t or "", lang or "") for i, t, lang, *_ in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    flags = []
    for i, t, lang in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        ids = [j for j, u, _ in texts if u == t and j is not None]
        repeat = bool(ids) and (i is None or i > min(ids))
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), repeat)
        flags.append((lang, {c for c, f in zip("ABCDE", fails) if f}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in flags}:
        rows_, shares = {}, dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            there = [f for f in flags if f[0] == part]
            gone = []
            for step, c in enumerate(order, 1):
                hit = [f for f in there if c in f[1]]
                there = [f for f in there if c not in f[1]]
                shares[c] += len(hit)
                rows_["".join(order), step] = (
                    len(there), len(hit), sum(c in f[1] for f in gone), sum(f[0] == part and f[1] == {c} for f in flags),
                    sum(f[2] for f in hit), sum(f[3] for f in hit),
                )
                gone += hit
        out |= {(part, *k): (*v, shares[k[0][k[1] - 1]]) for k, v in rows_.items()}
    return out


def made(n=300):
    draw = random.Random(5)
    words = ["alpha", "Beta", "beta", "GAMMA", "x$y", "a|b", "delta", "épée", " ", "z"]
    texts = [None, "", " ", "\t\n", "A" * 50, "same text", "same text", "#", "a\u000bb\u000cc\rd", " lead and trail "]
    for _ in range(n):
        sep = draw.choice([" ", "\n", "  ", "\t"])
        texts.append(sep.join(draw.choice(words[: draw.randint(3, 10)]) + (str(k) if draw.random() < 0.6 else "") for k in range(draw.choice([0, 1, 3, 199, 200, 201, 320]))))
    texts += draw.choices(texts, k=n // 2) + ["hot copy"] * (n // 2) + ["long " * 40_000]
    draw.shuffle(texts)
    rows = [(i if draw.random() < 0.95 else None, t, draw.choice(["en", "fr", "", None]), 1, "x", "y") for i, t in enumerate(texts)]
    return rows + rows[:3] + [(rows[5][0], "other text under a known id", "en", 1, "x", "y")]


def found(spark, rows, labels, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    docs = docs.selectExpr("doc_id", "text", "coalesce(lang, '') as part", "n_chars", "__mask", "masks")
    result = interaction.audit(docs, FAILS, "part", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **options)
    rows = result.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_all_orders(spark):
    rows, draw = made(), random.Random(6)
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, len(rows), 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0), (10**9, 1, 0)]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_full_sketch_changes_nothing(spark):
    """With far too few counters every text is a possible repeat, and the answer is the same."""
    rows = made(100)
    assert found(spark, rows, [], max_counters=interaction.BLOCK) == brute(rows, [])


def test_sketch_clears_unique_texts(spark):
    docs = spark.range(4000).selectExpr("id", "case when id % 4 = 0 then 'copy' else concat('text ', id) end as text").repartition(5)
    hashes = docs.select("id", "text", *interaction._hashes(docs.text))
    possible = interaction.possible_repeats(hashes)
    kept = hashes.where(possible("__h1", "__h2"))
    assert kept.where("text = 'copy'").count() == 1000
    assert kept.where("text != 'copy'").count() < 300


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, part string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(docs, FAILS, "part", labels).count() == 0
