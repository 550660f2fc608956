"""Vector codes against plain Python integers."""

import math
import random

from provspark.llm import compress


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], []
    width = -(-max(len(r[1]) for r in kept) // parts) * parts
    limit = compress.integer_limit(width)
    ints = [[max(-limit, min(limit, math.floor(4096 * x))) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    size = width // parts
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for v in ints]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    done = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in v) for v in done]
    return [
        (r[0], r[2], [k for _, k in v], e, sum(f for s, f in zip(kept, errors) if s[2] == r[2]))
        for r, v, e in zip(kept, done, errors)
    ], books


def check(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, codes string, __label int, __values int").repartition(3)
    rows = [tuple(r) for r in df.collect()]  # as float stores them
    coded, books = compress.compress(df, **options)
    expected, expected_books = brute(rows, **options)
    assert sorted(map(repr, (tuple(r) for r in coded.select("vec_id", "label", "codes", "error", "label_error").collect()))) == sorted(map(repr, expected))
    assert books.tolist() == expected_books
    return books


def vectors(n, width, seed=1):
    draw = random.Random(seed)
    rows = [(draw.randrange(10_000), [draw.gauss(0, 0.2) for _ in range(width)], draw.choice([1, 2, None]), "x", 0, 0) for _ in range(n)]
    return rows + rows[: n // 4]


def test_codes(spark):
    check(spark, vectors(150, 16))


def test_odd_rows(spark):
    rows = vectors(40, 16)
    inf, nan = math.inf, math.nan
    rows += [(1, None, 1, "x", 0, 0), (2, [nan] * 16, 1, "x", 0, 0), (3, [inf] + [0.0] * 15, 1, "x", 0, 0), (4, [None] * 16, 1, "x", 0, 0), (5, [], 3, "x", 0, 0)]
    rows += [(None, [0.5] * 16, None, "x", 0, 0), (6, [0.25] * 3, 2, "x", 0, 0), (7, [1e30, -1e30] * 8, 2, "x", 0, 0), (8, [0.0] * 21, 2, "x", 0, 0)]
    rows += [(9, [0.1] * 16, 5, "x", 0, 0)] * 4  # ties
    check(spark, rows)


def test_double_and_negative_floor(spark):
    draw = random.Random(3)
    check(spark, [(i, [draw.choice([-1, 1]) * draw.randrange(5) / 8192 for _ in range(8)], i % 2, "x", 0, 0) for i in range(60)], kind="double")


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(compress, "BLOCK_VALUES", 64)
    check(spark, vectors(60, 16, seed=9))


def test_other_parameters_and_few_rows(spark):
    check(spark, vectors(5, 12), parts=4, entries=3, rounds=2)
    check(spark, vectors(2, 8))
    check(spark, [(1, [], 1, "x", 0, 0)])


def test_no_rows(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    for rows in (df, df.limit(0)):
        coded, books = compress.compress(rows)
        assert coded.columns == ["vec_id", "label", "codes", "error", "label_error"] and coded.count() == 0
        assert compress.codebooks_text(books) == ""
