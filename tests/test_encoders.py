import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.operators import encoders as en
from provspark.operators.encoders import (
    BatchEmbedding, CharCount, ColumnEncoders, FunctionEncoder, HashedText, Numeric, OneHot, StandardScaler,
    WideOneHot, WordCount, chain,
)


@pytest.fixture
def train(spark):
    data = [("a b", "DE", 1.0, 5.0), ("a  c ", "FR", 2.0, 5.0), ("", "DE", 6.0, 5.0), ("a a a", None, 3.0, 5.0)]
    return spark.createDataFrame(data, "text string, country string, x double, same double")


def vectors(encoders, df):
    return np.array([r[0] for r in encoders.transform(df).select("features").collect()])


def test_scaler_uses_population_deviation_and_keeps_constants(train):
    fitted = ColumnEncoders([("s", StandardScaler(), ["x", "same"])]).fit(train)
    x = np.array([1.0, 2.0, 6.0, 3.0])
    assert np.allclose(vectors(fitted, train)[:, 0], (x - x.mean()) / x.std())
    assert np.allclose(vectors(fitted, train)[:, 1], 0.0)


def test_one_hot_order_null_and_unknown(spark, train):
    fitted = ColumnEncoders([("c", OneHot(), ["country"])]).fit(train)
    assert vectors(fitted, train).tolist() == [[1, 0, 0], [0, 1, 0], [1, 0, 0], [0, 0, 1]]
    other = spark.createDataFrame([("ES",)], "country string")
    with pytest.raises(Exception, match="unknown category: ES"):
        vectors(fitted, other)
    lenient = ColumnEncoders([("c", OneHot(unknown="ignore"), ["country"])]).fit(train)
    assert vectors(lenient, other).tolist() == [[0, 0, 0]]
    no_null = ColumnEncoders([("c", OneHot(), ["country"])]).fit(train.where("country IS NOT NULL"))
    with pytest.raises(Exception, match="unknown category: null"):
        vectors(no_null, train)


def test_one_hot_with_many_categories(spark):
    for kind in ("long", "string"):
        df = spark.range(300).select(F.col("id").cast(kind).alias("c"))
        fitted = ColumnEncoders([("c", OneHot(), ["c"])]).fit(df)
        assert fitted.width == 300
        matrix = vectors(fitted, df)
        assert (matrix.sum(axis=0) == 1).all() and (matrix.sum(axis=1) == 1).all()


@pytest.mark.parametrize("kind", ["date", "decimal(12,3)", "timestamp", "double", "boolean"])
@pytest.mark.parametrize("n", [3, 65])
def test_one_hot_of_any_type_and_width(spark, kind, n):
    numbers = {
        "date": "date_add(date'2024-01-30', CAST(id AS INT))", "decimal(12,3)": "CAST(id / 4 AS DECIMAL(12,3))", "timestamp": "timestamp_micros(id * 500000)",
        "double": "CAST(id - 1 AS DOUBLE) / 3", "boolean": "id % 2 = 0",
    }
    df = spark.range(n).selectExpr("id", f"CAST(IF(id = 1, NULL, {numbers[kind]}) AS {kind}) AS c")
    fitted = ColumnEncoders([("c", OneHot(), ["c"])]).fit(df)
    assert fitted.width == df.select("c").distinct().count()
    restored = ColumnEncoders([("c", OneHot(), ["c"])]).with_saved_state(json.loads(json.dumps(fitted.state())))
    matrix = vectors(restored, df.orderBy("c"))
    assert (matrix.sum(axis=1) == 1).all() and (matrix.sum(axis=0) >= 1).all()


def test_one_hot_with_200_000_categories(spark):
    fitted = ColumnEncoders([("c", OneHot(unknown="ignore"), ["c"])]).fit(spark.range(200_000).selectExpr("CAST(id AS STRING) AS c"))
    encoded = fitted.transform(spark.createDataFrame([("7",), ("none",)], "c string"))
    assert [r[0] for r in encoded.selectExpr("aggregate(features, 0D, (a, x) -> a + x)").collect()] == [1.0, 0.0]


def test_mixed_types_in_one_fit(spark):
    df = spark.createDataFrame([("a", 1, True), ("b", 2, True)], "s string, n int, f boolean")
    fitted = ColumnEncoders([("all", OneHot(), ["s", "n", "f"])]).fit(df)
    assert vectors(fitted, df).tolist() == [[1, 0, 1, 0, 1], [0, 1, 0, 1, 1]]


def test_counts(train):
    counts = ColumnEncoders([("w", WordCount(), ["text"]), ("c", CharCount(), ["text"])])
    expected = [[len(t.split(" ")), len(t)] for t in ("a b", "a  c ", "", "a a a")]
    assert vectors(counts.fit(train), train).tolist() == expected


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_hashed_text(train, method):
    raw = vectors(ColumnEncoders([("t", HashedText(8, method, normalise=False), ["text"])]).fit(train), train)
    assert raw.sum(axis=1).tolist() == [2, 4, 1, 3]
    unit = vectors(ColumnEncoders([("t", HashedText(8, method), ["text"])]).fit(train), train)
    assert np.allclose((unit**2).sum(axis=1), 1.0)
    assert np.allclose(unit * np.sqrt((raw**2).sum(axis=1))[:, None], raw)


def test_pluggable_encoders(train):
    import pandas as pd

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series([[float(len(t)), 1.0] for t in text])

    parts = [
        ("e", BatchEmbedding(embed, 2), ["text"]),
        ("f", FunctionEncoder(lambda x: F.array(x, x * x), 2), ["x"]),
        ("n", Numeric(), ["x", "same"]),
    ]
    fitted = ColumnEncoders(parts).fit(train)
    assert vectors(fitted, train)[1].tolist() == [5.0, 1.0, 2.0, 4.0, 2.0, 5.0]
    assert fitted.matrix_provenance() == [("text", 0, 2), ("x", 2, 4), ("x", 4, 5), ("same", 5, 6)]


def test_ranges_partition_the_vector(train):
    fitted = ColumnEncoders([
        ("t", HashedText(4), ["text"]),
        ("w", chain(WordCount(), StandardScaler()), ["text"]),
        ("c", chain(OneHot()), ["country"]),
        ("s", StandardScaler(), ["x", "same"]),
        ("j", HashedText(3), ["text", "country"]),
    ]).fit(train)
    ranges = fitted.matrix_provenance()
    assert ("country", 5, 8) in ranges and ("x", 8, 9) in ranges
    assert ("text", 10, 13) in ranges and ("country", 10, 13) in ranges
    covered = sorted({i for _, a, b in ranges for i in range(a, b)})
    assert covered == list(range(fitted.width)) == list(range(13))
    assert vectors(fitted, train).shape == (4, 13)


def test_saved_state_restores_the_encoders(train):
    def fresh():
        return ColumnEncoders([
            ("w", chain(WordCount(), StandardScaler()), ["text"]), ("c", OneHot(), ["country"]),
        ])

    fitted = fresh().fit(train)
    restored = fresh().with_saved_state(json.loads(json.dumps(fitted.state())))
    assert np.array_equal(vectors(fitted, train), vectors(restored, train))


def test_missing_numbers_stay_visible(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert math.isnan(vectors(ColumnEncoders([("n", Numeric(), ["x"])]), df)[1, 0])


# --- several learning steps, wide blocks, encoders from their document ------------------------------

def test_chains_that_learn_at_every_level(train):
    parts = [
        ("twice", chain(StandardScaler(), StandardScaler()), ["x", "same"]),
        ("text", chain(HashedText(4), StandardScaler()), ["text"]),
        ("country", chain(OneHot(), StandardScaler(), StandardScaler()), ["country"]),
        ("words", chain(WordCount(), StandardScaler()), ["text"]),
        ("plain", OneHot(), ["country"]),
    ]
    fitted = ColumnEncoders(parts).fit(train)
    matrix = vectors(fitted, train)
    assert matrix.shape == (4, fitted.width) == (4, 2 + 4 + 3 + 1 + 3)
    x = np.array([1.0, 2.0, 6.0, 3.0])
    assert np.allclose(matrix[:, 0], (x - x.mean()) / x.std()) and np.allclose(matrix[:, 1], 0)
    hashed = vectors(ColumnEncoders([("t", HashedText(4), ["text"])]).fit(train), train)
    slots = vectors(ColumnEncoders([("c", OneHot(), ["country"])]).fit(train), train)
    for block, raw in ((matrix[:, 2:6], hashed), (matrix[:, 6:9], slots)):
        deviation = raw.std(axis=0)
        assert np.allclose(block, (raw - raw.mean(axis=0)) / np.where(deviation == 0, 1, deviation))
    assert np.allclose(matrix[:, 10:], slots)


def test_one_pass_a_level(train, monkeypatch):
    calls = []
    moments, categories = en._fit_moments, en._fit_categories
    monkeypatch.setattr(en, "_fit_moments", lambda df, c: calls.append(len(c)) or moments(df, c))
    monkeypatch.setattr(en, "_fit_categories", lambda df, c: categories(df, c))
    ColumnEncoders([
        ("a", chain(StandardScaler(), StandardScaler()), ["x"]), ("b", chain(OneHot(), StandardScaler()), ["country"]), ("c", StandardScaler(), ["same"]),
    ]).fit(train)
    assert calls == [2, 4]


def test_many_moments_are_rows(train, monkeypatch):
    parts = [("t", chain(HashedText(16), StandardScaler()), ["text"])]
    expected = vectors(ColumnEncoders(parts).fit(train), train)
    monkeypatch.setattr(en, "SCALARS", 3)
    assert np.allclose(vectors(ColumnEncoders(parts).fit(train), train), expected)


def test_ranges_through_chains(train):
    fitted = ColumnEncoders([
        ("h", chain(HashedText(2), StandardScaler()), ["text", "country"]), ("o", chain(OneHot(), StandardScaler()), ["country", "same"]),
    ]).fit(train)
    assert fitted.matrix_provenance() == [("text", 0, 2), ("country", 0, 2), ("country", 2, 5), ("same", 5, 6)]


def dense_of(rows, width):
    out = np.zeros((len(rows), width))
    for i, (positions, values) in enumerate(rows):
        out[i, positions] = values
    return out


def test_wide_blocks_equal_dense_ones(spark, train, monkeypatch):
    from provspark.operators import sizing

    parts = lambda kind: [("s", StandardScaler(), ["x"]), ("c", kind, ["country", "text"]), ("w", WordCount(), ["text"])]
    dense = vectors(ColumnEncoders(parts(OneHot())).fit(train), train)
    for limit in (500_000, 0):  # by a lookup, and by a shuffle
        monkeypatch.setattr(sizing.broadcast_if_small, "__defaults__", (None, limit))
        fitted = ColumnEncoders(parts(WideOneHot())).fit(train)
        assert fitted.sparse and fitted.width == dense.shape[1]
        assert fitted.matrix_provenance() == ColumnEncoders(parts(OneHot())).fit(train).matrix_provenance()
        rows = [tuple(r[0]) for r in fitted.transform(train).select("features").collect()]
        assert sorted(map(tuple, dense_of(rows, fitted.width))) == sorted(map(tuple, dense))
    other = spark.createDataFrame([("new", "ES", 1.0, 5.0)], "text string, country string, x double, same double")
    with pytest.raises(Exception, match="unknown category"):
        fitted.transform(other).collect()
    lenient = ColumnEncoders([("c", WideOneHot(unknown="ignore"), ["country"])]).fit(train)
    assert tuple(lenient.transform(other).first()["features"]) == ([], [])
    with pytest.raises(ValueError, match="last step"):
        chain(WideOneHot(), StandardScaler())


def test_wide_block_of_many_categories(spark):
    df = spark.range(50_000).selectExpr("id % 30000 AS c")
    fitted = ColumnEncoders([("c", WideOneHot(), ["c"])]).fit(df)
    assert fitted.width == 30_000
    wrong = fitted.transform(df).where("features.positions[0] != c or size(features.positions) != 1 or features.values[0] != 1")
    assert wrong.count() == 0


def test_too_many_dense_categories_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(en, "MOST_CATEGORIES", 10)
    with pytest.raises(ValueError, match="WideOneHot"):
        ColumnEncoders([("c", OneHot(), ["id"])]).fit(spark.range(11))


def test_sparse_ranges_are_taken_out(spark, train):
    from provspark.operators.maintain import patch_features

    fitted = ColumnEncoders([("s", StandardScaler(), ["x"]), ("c", WideOneHot(), ["country"]), ("w", WordCount(), ["text"])]).fit(train)
    encoded = fitted.transform(train)
    ranges = [(a, b) for c, a, b in fitted.matrix_provenance() if c in ("country", "x")]
    before = dense_of([tuple(r[0]) for r in encoded.select("features").collect()], fitted.width)
    after = dense_of([tuple(r[0]) for r in patch_features(encoded, ranges).select("features").collect()], fitted.width)
    before[:, 0:4] = 0
    assert np.allclose(before, after)
    assert encoded.schema["features"].dataType == patch_features(encoded, ranges).schema["features"].dataType


def test_encoders_from_their_document_alone(train):
    parts = [
        ("h", chain(HashedText(4, "md5"), StandardScaler()), ["text"]), ("o", OneHot(unknown="ignore"), ["country"]),
        ("n", chain(Numeric(), StandardScaler()), ["x"]), ("c", CharCount(), ["text"]),
    ]
    fitted = ColumnEncoders(parts).fit(train)
    again = ColumnEncoders.from_state(json.loads(json.dumps(fitted.state())))
    assert np.array_equal(vectors(fitted, train), vectors(again, train)) and again.parts == fitted.parts
    custom = ColumnEncoders([("f", FunctionEncoder(lambda x: F.array(x), 1), ["x"])]).fit(train)
    with pytest.raises(ValueError, match="pass the encoders"):
        ColumnEncoders.from_state(custom.state())
    assert np.array_equal(vectors(custom.with_saved_state(custom.state()), train)[:, 0], [1, 2, 6, 3])
    with pytest.raises(ValueError, match="does not belong"):
        ColumnEncoders([("h", OneHot(), ["text"])]).with_saved_state(fitted.state()[:1])


def test_embeddings_meet_a_bounded_amount_of_text(spark):
    import pandas as pd

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [float(len(text)), float(len(t))] for t in text])

    df = spark.range(2000).select("id", F.when(F.col("id") > 0, F.repeat(F.lit("abcdefghij"), 1000)).alias("text")).coalesce(1)
    done = ColumnEncoders([("v", BatchEmbedding(embed, 2), ["text"])]).fit(df).transform(df)
    features = {r.id: r.features for r in done.select("id", "features").collect()}
    assert len(features) == 2000 and all(features[i][1] == 10_000 and features[i][0] * 10_000 <= 8 << 20 for i in range(1, 2000))
