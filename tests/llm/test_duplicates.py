"""Near-duplicate documents and vectors against all pairs in plain Python."""

import random
import re

import numpy as np

from provspark.llm import embeddings, minhash
from provspark.llm.common import components


def component_of(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    draw = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(200, 500)] + [(draw.randint(600, 900), draw.randint(600, 900)) for _ in range(200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert found == component_of({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_documents(spark):
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[draw.choice(vocabulary) for _ in range(draw.randint(5, 120))] for _ in range(60)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(4):
            changed = [draw.choice(vocabulary) if draw.random() < 0.05 else w for w in b]
            texts.append("\t".join(changed).upper() if draw.random() < 0.3 else " \n".join(changed))
    # A chain: each is near the next, far from the rest.
    chain = [f"c{i}" for i in range(400)]
    texts += [" ".join(chain[8 * i : 8 * i + 120]) for i in range(30)]
    texts += [None, "", "  \x0b ", "One", "one", "a b", "b a", "É é", "é É", "x " * 30_000, texts[0], texts[0], "a\x85b", "a b"]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(6)
    for size in (2, 5):
        sets = [shingles(t, size) for t in texts]
        links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        low = component_of(range(len(texts)), links)
        expected = sorted([(i, len(sets[i]), low[i], i == low[i]) for i in range(len(texts))] + [(0, len(sets[0]), 0, True)])
        found = [tuple(r) for r in minhash.near_duplicates(df, shingle=size).collect()]
        assert sorted(r for r in found if r[0] is not None) == expected
        assert [r for r in found if r[0] is None] == [(None, len(sets[0]), None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_documents_that_share_an_id(spark):
    """Unlike texts under one id are documents of their own: their groups do not merge."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (4, c), (None, a), (2, c), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=2).collect() if r.doc_id is not None)
    # Groups: {1 a, 2 a}, {1 b, 3 b}, {4 c, 4 c, 2 c}, and the empty ones by themselves.
    expected = [(1, 59, 1, True), (1, 59, 1, True), (2, 60, 1, False), (3, 60, 1, False), (2, 59, 2, True), (4, 59, 2, False), (4, 59, 2, False)]
    assert found == sorted(expected + [(5, 0, 5, True)] * 2)


def test_vectors_that_share_an_id(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, x, 0), (1, y, 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (3, [0.01, 1.0], 0), (4, None, 0), (4, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = sorted(tuple(r) for r in embeddings.link_embeddings(df).collect())
    assert found == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (4, 0, 4, True)]


def test_large_group_of_near_copies(spark):
    draw = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"x{i}" if j == i % 200 else w for j, w in enumerate(base))) for i in range(400)]
    rows += [(1000 + i, " ".join(base[:60] + [f"y{draw.randint(0, 10**9)}" for _ in range(150)])) for i in range(200)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found if r.doc_id < 1000} == {0} and all(r.kept for r in found if r.doc_id >= 1000)


def test_bits_estimate_similarity():
    draw = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.8):
        common = draw.integers(0, 2**64, 1000, dtype=np.uint64)
        n = int(1000 * (1 - share) / (1 + share)) if share else 1000
        own = [np.concatenate((common[: int(1000 - n)] if share else common[:0], draw.integers(0, 2**64, n, dtype=np.uint64))) for _ in "ab"]
        a, b = (minhash.planes(minhash.minima(x)) for x in own)
        true = len(np.intersect1d(*own)) / len(np.union1d(*own))
        differ = sum(bin(int((a[i] ^ b[i]) | (a[i + 4] ^ b[i + 4]))).count("1") for i in range(4))
        assert abs(((1 - differ / 240) - 0.25) / 0.75 - true) < 0.17


def brute_vectors(rows):
    good = {}
    for key, v, label in rows:
        if key is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[key] = (label, np.array(v, np.float32).astype(float))
    links = []
    for a, (la, x) in good.items():
        for b, (lb, y) in good.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                links.append((a, b))
    return links


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE_ROWS", 64)
    draw = np.random.default_rng(3)
    rows = []
    for c in range(40):
        base = draw.normal(size=16)
        for _ in range(draw.integers(1, 12)):
            rows.append((base + draw.normal(size=16) * draw.choice([0.05, 0.15, 0.25])).tolist())
    rows = [(i, v, int(draw.integers(0, 2))) for i, v in enumerate(rows)]
    # Rows of a chain along an arc, equal vectors, and all kinds that link with nothing.
    rows += [(1000 + i, [float(np.cos(i * 0.2)), float(np.sin(i * 0.2))], 0) for i in range(20)]
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(2100, rows[0][1], None), (2101, None, 1), (2102, [], 1)]
    rows += [(2103, [0.0] * 16, 1), (2104, [float("nan")] + [1.0] * 15, 1), (2105, [float("inf")] * 16, 1), (2106, [None] + [1.0] * 15, 1)]
    rows += [(2107, [x * 1e30 for x in rows[0][1]], rows[0][2]), (2108, [1e-30] * 16, 5), (2109, [1e-30] * 16, 5), (None, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(5)
    links = brute_vectors(rows)
    keys = [r[0] for r in rows if r[0] is not None]
    low = component_of(keys, links)
    degree = {k: sum(k in e for e in links) for k in keys}
    found = [tuple(r) for r in embeddings.link_embeddings(df).collect()]
    assert sorted(r for r in found if r[0] is not None) == sorted((k, degree[k], low[k], low[k] == k) for k in keys)
    assert [r for r in found if r[0] is None] == [(None, 0, None, True)]
    assert embeddings.link_embeddings(df.limit(0)).count() == 0


def test_bounds_are_rigorous():
    draw = np.random.default_rng(2)
    x = np.concatenate((draw.normal(size=(150, 24)), draw.normal(size=(50, 24)) ** 5))
    y = x + draw.normal(size=x.shape) * 0.35 * np.abs(x).max(axis=1, keepdims=True) * draw.random((200, 1))
    a, b = (embeddings.Tile(np.arange(200), np.ones(200), v) for v in (x, y))
    exact = (a.unit[:, None, :] * b.unit[None, :, :]).sum(axis=2)
    for threshold in (0.3, 0.8, 0.93):
        assert (embeddings.links_of(a, b, threshold, False) == (exact >= threshold)).all()
