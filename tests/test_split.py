import math

from pyspark.sql import functions as F

from provspark.operators import split as sp
from provspark.operators.split import TEST, exact_threshold, hash_threshold, split_column


def keyed(spark, n):
    return sp.with_split_key(spark.range(n).select(F.md5(F.col("id").cast("string").cast("binary")).alias("sample_id")), 7)


def test_exact_split_has_the_exact_size_and_the_smallest_ranks(spark, monkeypatch):
    for n, fraction in ((1, 0.2), (10, 0.2), (1003, 0.2), (1003, 0.0), (1003, 1.0), (777, 0.35)):
        df = keyed(spark, n)
        ranks = sorted(r[0] for r in df.select("split_key").collect())
        threshold = exact_threshold(df, fraction)
        test = sorted(r[0] for r in df.where(split_column(threshold) == TEST).select("split_key").collect())
        assert test == ranks[: math.ceil(round(fraction * n, 6))]


def test_exact_split_by_refinement_alone(spark, monkeypatch):
    monkeypatch.setattr(sp, "_DIGITS", 1)
    monkeypatch.setattr(sp, "_FEW", 0)
    df = keyed(spark, 500)
    assert df.where(split_column(exact_threshold(df, 0.2)) == TEST).count() == 100


def test_hash_split_is_stable_under_deletion(spark):
    threshold = hash_threshold(0.2)
    assert threshold == f"{16**32 // 5 - 1:032x}" and hash_threshold(0) == "" and hash_threshold(1) == "f" * 32
    df = keyed(spark, 5000)
    test = df.where(split_column(threshold) == TEST)
    assert 900 < test.count() < 1100
    kept = df.where("sample_id > '8'")
    assert kept.where(split_column(threshold) == TEST).count() == test.where("sample_id > '8'").count()


def test_epoch_orders_differ_and_repeat(spark):
    df = keyed(spark, 200)

    def order(epoch, tasks):
        placed = {r.place: r.sample_id for r in sp.epoch_order(df.repartition(tasks), epoch).select("place", "sample_id").collect()}
        assert sorted(placed) == list(range(200))
        return [placed[i] for i in range(200)]

    assert order(1, 1) == order(1, 7) != order(2, 3) and sorted(order(1, 2)) == sorted(order(2, 2))


def test_places_of_tied_and_null_rows(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (3,), (2,)], "x int").repartition(4)
    placed = sorted((r.place, r.x) for r in sp.with_place(df, [F.col("x")], "place").collect())
    assert placed == [(0, None), (1, 1), (2, 2), (3, 3), (4, 3)]
    assert sp.with_place(df.limit(0), [F.col("x")], "place").count() == 0
