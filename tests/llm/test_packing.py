"""Packing: ids against the tokenizers library, the plan against its bounds, and every piece in its place."""

import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from provspark.llm import packing
from provspark.llm.queries import BYTE_MODEL


@pytest.fixture(scope="module")
def document():
    with open(BYTE_MODEL, encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def encoder(document):
    return packing.Encoder(document)


@pytest.fixture(scope="module")
def tokenizer(document):
    return Tokenizer.from_str(document)


def ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_every_character(encoder, tokenizer):
    for low in range(0, sys.maxunicode + 1, 4096):
        for c in range(low, min(low + 4096, sys.maxunicode + 1), 7):
            if not 0xD800 <= c < 0xE000:
                s = chr(c)
                text = f"a{s}b 1{s}2 {s} {s}{s} ,{s}. '{s}s\n{s}"
                assert encoder.ids(text).tolist() == ids(tokenizer, text), hex(c)


def test_ids_of_odd_texts(encoder, tokenizer):
    for text in ("", " ", "\n\n", "a<|endoftext|> b", "<|endoftext|>", "x" * 5000, " " * 3000 + "y", "  　x", "don't  stop"):
        assert encoder.ids(text).tolist() == ids(tokenizer, text)


def test_long_texts_are_cut_where_no_token_crosses(encoder, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 40)
    draw = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "word", "Wörter", "12", "!?", "'s", "<|endoftext|>", " ", "日本"]
    for _ in range(300):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 200)))
        assert "".join(packing.chunks(text)) == text
        whole = ids(tokenizer, text)
        assert np.concatenate([encoder._ids(c) for c in packing.chunks(text, 40)]).tolist() == whole


def test_white_space_without_end(encoder, tokenizer):
    text = "a" + " " * 400_000 + "b"
    assert encoder.ids(text).tolist() == ids(tokenizer, text)


HISTOGRAMS = {
    "uniform": lambda r: r.integers(1, 2049, 5000),
    "large": lambda r: r.integers(400, 1500, 5000),
    "small": lambda r: r.integers(1, 60, 5000),
    "few": lambda r: r.integers(1, 2049, 9),
    "hot": lambda r: np.concatenate([np.full(40_000, 700), r.integers(1, 2049, 500)]),
    "one": lambda r: np.array([5]),
    "whole": lambda r: np.full(10, 2048),
    "none": lambda r: np.zeros(0, int),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_plan_places_every_length_once(name):
    lengths = HISTOGRAMS[name](np.random.default_rng(3)).astype(int)
    counts = np.bincount(lengths, minlength=2049)
    runs = packing.plan_sequences(counts, 2048)
    used = Counter()
    for run in runs:
        assert run.count > 0 and run.lengths and sum(run.lengths) + run.free == 2048 and run.free >= 0
        for length in run.lengths:
            used[length] += run.count
    assert used == {k: v for k, v in enumerate(counts.tolist()) if v}
    sequences = sum(run.count for run in runs)
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    best_fit = sum(run.count for run in packing.best_fit([], counts.copy(), 2048))
    assert least <= sequences <= 1.03 * best_fit + 1


def test_configurations_reach_the_bound_of_a_known_case():
    """Thirds and halves: 300 of 682 and 200 of 1,024 fill 200 sequences."""
    counts = np.bincount([682] * 300 + [1024] * 200, minlength=2049)
    assert sum(run.count for run in packing.plan_sequences(counts, 2048)) == 200


def test_plan_grows_with_lengths_not_with_documents():
    counts = np.bincount(np.random.default_rng(1).integers(1, 2049, 3000), minlength=2049)
    small, large = (len(packing.plan_sequences(counts * k, 2048)) for k in (1, 100_000))
    assert large < 4 * small + 2048


def packed(spark, document, texts, capacity, parts=5):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, piece string, start int")
    return packing.pack(df.repartition(parts), document, capacity=capacity).collect()


@pytest.mark.parametrize("capacity", [16, 2048])
def test_every_piece_has_its_place(spark, document, tokenizer, capacity):
    draw = random.Random(8)
    words = ["one", " two", " three", "\n", "ß", " 12"]
    texts = [(i, "".join(draw.choice(words) for _ in range(draw.choice([0, 1, 5, 14, 15, 16, 17, 60])))) for i in range(200)]
    texts += [(1000 + i, "hot text") for i in range(100)] + [(500, None), (501, ""), (502, "a" * 30_000), (None, "no id")]
    rows = packed(spark, document, texts, capacity)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == {i for i, _ in texts}
    for i, text in texts:
        every = [*ids(tokenizer, text or ""), 0]
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            piece = np.array(every[at : at + r.length], "<u4")
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(piece.tobytes()))
            assert r.length == capacity or n == 0
            at += r.length
        assert at == len(every) and len(by_doc[i]) == -(-len(every) // capacity)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_repeated_ids_and_no_rows(spark, document):
    rows = packed(spark, document, [(1, "same"), (1, "same"), (1, "other one")], 2048, parts=1)
    assert sorted((r.sequence_id, r.offset) for r in rows) == [(0, 0), (0, 2), (0, 4)] or sum(r.length for r in rows) == max(r.offset + r.length for r in rows)
    assert packed(spark, document, [], 2048) == []
