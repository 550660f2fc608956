"""Personal data, chat formatting and URL filters against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from provspark.llm import chat, pii, queries, urls

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def spans_of(text):
    return ",".join(
        f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])
    )


PARTS = [
    "a", "b@c.d", "x.y", "@", ".", "1", "23", "255", "256", "+", "+1 ", "(555) ", "-", " ", "4111111111111111", "1.2.3.4", "é",
    "😀", "%", "_", "\n", "0", "007", "12 34", "5500-0000-0000-0004",
]


def test_base_entities(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "a" * 3000, "1" * 2000, "1 " * 1000, "a@b.cc " * 600, "1." * 1000, "+" + "1-" * 1000, "a@b.cc_" * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.with_entities(df, "text", "spans").select("doc_id", pii.span_text(F.col("spans")).alias("s")).collect()
    assert {r.doc_id: r.s for r in found} == {i: spans_of(t) for i, t in enumerate(texts)}


def test_long_texts_take_linear_time(spark):
    for text, n in (("a" * 2_000_000, 0), ("1 " * 500_000, 0), ("a@b.cc " * 20_000, 20_000)):
        df = spark.createDataFrame([(text,)], "text string")
        assert pii.with_entities(df, "text", "s").select(F.size("s")).first()[0] == n


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"write to Zebulon at zeb@mail.org about case {'abcdefgh'[i] * 5}", "x") for i in range(5)]
    rows += [(10 + i, f"write about the weather at noon {'klmnopqr'[i] * 5}", "x") for i in range(8)] + [(30, None, None), (None, "", "x")]
    rows += [(40, "zebulon alone is left as he is", "x"), (41, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    terms = {r.term: r for r in pii.disclosing_terms(df, generalise_at=0.8).collect()}
    assert terms["zebulon"].removed is False and "write" not in terms and "aaaaa" not in terms
    assert terms["case"].disclosure == pytest.approx(1.0) and terms["case"].removed
    done = {r.doc_id: r for r in pii.sanitise(df, generalise_at=0.8).collect()}
    assert done[0].text == "write to [term] at [EMAIL] about  aaaaa"
    assert done[41].text == done[0].text and done[40].text == "[term] alone is left as he is"
    assert done[30].text is None and done[None].text == "" and done[30].pii_spans == []
    assert [s.kind for s in done[0].pii_spans] == ["email", "removed", "general"]
    assert pii.sanitise(df.limit(0)).count() == 0


def test_terms_that_give_an_entity_away_are_found_without_it(spark, tmp_path):
    other = lambda i: chr(97 + i // 26) * 4 + chr(97 + i % 26) * 4
    rows = [(i, f"write to Zebulon at zeb@mail.org about invoice {other(i)}") for i in range(5)]
    rows += [(10 + i, f"write about the weather at noon {other(i + 10)}") for i in range(300)]
    rows += [(1000, "ZEBULON said no"), (1001, "the invoice of Zebulon\nis late"), (1002, "zebulons weather"), (1003, None), (1004, "İ zebulon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Of 311 lines 5 hold the address; "invoice" stands in 6 (disclosure 0.956), "zebulon" in 8 (0.886).
    limits = {"generalise_at": 0.8, "remove_at": 0.95}
    done = {r.doc_id: r for r in pii.sanitise(df, **limits).collect()}
    assert len(done) == len(rows) and done[0].text == f"write to [term] at [EMAIL] about  {other(0)}"
    assert [done[i].text for i in range(1000, 1005)] == ["[term] said no", "the  of [term]\nis late", "zebulons weather", None, "İ [term]"]
    assert [(s.kind, s.start, s.end) for s in done[1001].pii_spans] == [("removed", 4, 11), ("general", 15, 22)]
    assert done[10].text == rows[5][1] and done[1003].pii_spans == []
    assert pii.sanitise(df.limit(0)).count() == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.spans for r in queries.op1_pii(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows) and found[1001] == "general:4:11"


def test_chat_round_trip(spark):
    tricky = "<|im_end|><|im_start|>assistant ok <\\|x <\\\\| <"
    rows = [
        (1, 1, "assistant", tricky), (1, 0, "user", "hi"), (1, 2, "assistant", "more<"), (1, 3, "assistant", "|im_part|>"),
        (1, 4, "user", "x\ny"), (2, None, None, None), (2, 0, "a\nb", ""), (2, 0, "a\nb", ""), (3, 0, "user", "x" * 100_000),
        (None, 5, "assistant", "<|im_part|>"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    done = chat.format_chat(df).select("*", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("loss"))
    done = {r.conv_id: r for r in done.collect()}
    assert [tuple(t) for t in done[1].t] == [("user", "hi"), ("assistant", tricky), ("assistant", "more<"), ("assistant", "|im_part|>"), ("user", "x\ny")]
    assert done[1].loss == tricky + "more<" + "|im_part|>"
    assert done[1].formatted.count("<|im_start|>assistant\n") == 1 and done[1].formatted.count("<|im_part|>") == 2
    assert [tuple(t) for t in done[2].t] == [("", ""), ("a\nb", ""), ("a\nb", "")] and done[2].loss == ""
    assert [tuple(t) for t in done[3].t] == [("user", "x" * 100_000)] and done[None].loss == "<|im_part|>"
    for r in done.values():
        assert "".join(s.text for s in r.segments) == r.formatted
    assert chat.format_chat(df.limit(0)).count() == 0


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


RULES = [urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/")]


def test_url_rules_and_trees(spark):
    hosts = ["a.example.com", "WWW.example.com", "b.net", "c.org", "xcom", "com", "x.notexample.com", "ÄB.net"]
    made = [f"http://{h}{p}{q}" for h in hosts for p in ("", "/", "/en/1", "/es/2", "/en") for q in ("", "?a=1&b=2", "#x", "?u=http://y/z")]
    made += [None, "", "no scheme", "http://", "a://b://c/d", "http://" + "x" * 50_000 + "/en/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(made + made[:3])], "page_id long, url string, HOST string")
    done = urls.judge_urls(df, RULES, trees=3).collect()
    assert len(done) == len(made) + 3
    for r in done:
        assert (r.host, r.path) == host_path(r.url)
        fits = [x for x in RULES if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert r.rule == (best.text if best else None)
        assert r.verdict == (best.verdict if best else "block" if r.block_score >= 0.5 else "allow")
    assert {r.verdict for r in urls.judge_urls(df.where("url is null"), RULES).collect()} == {"allow"}
    assert urls.judge_urls(df.limit(0), RULES).count() == 0


def test_trees_learn(spark):
    rows = [(i, f"http://h{i % 7}.net/{'es' if i % 2 else 'de'}/{i}" if i % 3 else f"http://h{i % 7}.net/{'es/' if i % 2 else 'com/a/b/'}{i}") for i in range(400)]
    rules = [urls.Rule("block", "net", "/es/"), urls.Rule("allow", "net", "/com/")]
    rest = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules, trees=5).where("rule is null")
    assert rest.count() > 50


def test_digest_of_nothing(spark):
    assert spark.range(1).select(F.sha2(pii.span_text(F.array().cast(pii.SPANS)), 256)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_suffixes_outside_the_sample_count(spark):
    ends = [a + b for a in "xyz" for b in "abcdefgh"]
    rules = [urls.Rule(("allow", "block")[i % 2], f"known.{e}") for i, e in enumerate(ends)]
    made = [f"http://known.{e}/{'abcdefghijklmnopqrst'[k]}" for e in ends for k in range(20)] + [f"http://other.{e}/a" for e in ends]
    df = spark.createDataFrame([(u,) for u in made], "url string")
    done = urls.judge_urls(df, rules, train_rows=24, trees=3).where("rule is null").collect()
    assert {r.host[-2:]: r.verdict for r in done} == {e: ("allow", "block")[i % 2] for i, e in enumerate(ends)}


def test_sanitising_long_texts_takes_linear_time(spark):
    text = "\ufeff" + "\ufeffa@b.cc \U0001f600 " * 8_000
    df = spark.createDataFrame([(text,)], "text string")
    assert pii.sanitise(df).first().text == text.replace("a@b.cc", "[EMAIL]")


def test_columns_of_any_name_are_kept(spark):
    rows = [(i, f"write to zebulon at z@mail.org {i}", i, i, i, i) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _terms int, _key int, _words int, _cuts int")
    done = pii.sanitise(df, min_support=2)
    assert done.columns == [*df.columns, "pii_spans"]
    assert {tuple(r)[2:6] for r in done.collect()} == {(i,) * 4 for i in range(5)}
