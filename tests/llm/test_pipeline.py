"""The whole pipeline on the smallest tables, and its stages on rows of every kind."""

import os

import pytest

import corpus_pipeline
from provspark.llm.queries import PIECE_MODEL

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR) or not os.path.exists(PIECE_MODEL), reason="test tables not present")


def test_run(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    done = corpus_pipeline.run(spark, SF_DIR).collect()
    ids = [r.doc_id for r in done]
    assert len(set(ids)) == len(ids) and set(ids) < {r.doc_id for r in docs.collect()}
    assert len(ids) > 0.6 * docs.count() and all(len(r.ids) == r.n_ids for r in done)
    assert not any("@mail" in r.text for r in done)


def test_stages_keep_columns_and_rows_of_every_kind(spark):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first()
    own = "one two three four five six seven eight nine ten"
    rows = [
        (1, own, "en", "s", 1), (2, own, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "no id here", "en", "s", 1),
        (5, "twice", "en", "s", 1), (5, "twice", "en", "s", 1), (5, "twice other", "en", "s", 1), (6, f"x {benchmark.text} y", "en", "s", 1),
        (7, "mail me at some.one@mail.org today", "en", "s", 1), (8, "long " * 20_000 + "end", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF_DIR)
            if name != "sentencepiece":
                assert at.columns == docs.columns
        done = {r.doc_id: r for r in at.collect()}
        assert empty == (not done)
    assert set(done) == set()
    final = docs
    for _, stage in corpus_pipeline.STAGES:
        final = stage(spark, final, SF_DIR)
    final = final.collect()
    assert sorted(str(r.doc_id) for r in final) == sorted(map(str, [1, 3, 4, None, 5, 5, 7, 8]))
    assert sorted(r.text for r in final if r.doc_id == 5) == ["twice", "twice other"]
    final = {r.doc_id: r for r in final}
    assert final[7].text == "mail me at [EMAIL] today" and final[3].text is None
    assert final[8].text == "long " * 20_000 + "end"


def test_stages_keep_columns_with_odd_names(spark):
    names = ["_toxicity", "_leaks", "_terms", "_key", "_words", "_done", "_predicted", "_cuts", "_wide", "row", "doc", "pii"]
    rows = [(i, f"some words of text number {i} by a.b@mail.org", "en", "s", 1, *range(len(names))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    at = docs.union(docs.limit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF_DIR)
        assert at.columns == docs.columns and {tuple(r)[5:] for r in at.collect()} == {tuple(range(len(names)))}
    assert corpus_pipeline.tokenise(spark, at, SF_DIR).count() == at.count()
