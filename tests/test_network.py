import numpy as np
import pytest
from pyspark.sql import functions as F

from provspark.operators import network as network_module
from provspark.operators.network import (
    Network, Trainer, gradient_sums, logistic, mean_loss, perceptron, prediction, probability,
)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] - 2 * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(float)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "features array<double>, label double")
    return x, y, df.repartition(3).persist()


def test_gradient_equals_finite_differences_and_a_single_pass(data):
    x, y, df = data
    network = perceptron(6, hidden=5, seed=1)
    (total,), n = gradient_sums(df, network)
    assert n == 600 and np.allclose(total, network.gradient_sum(x, y), atol=1e-9)
    flat, step = network.flat, 1e-5
    for i in range(0, flat.size, 7):
        up, down = flat.copy(), flat.copy()
        up[i] += step
        down[i] -= step
        slope = (network.with_flat(up).loss_sum(x, y) - network.with_flat(down).loss_sum(x, y)) / (2 * step)
        assert abs(slope - total[i]) < 1e-4


def test_no_rows_no_gradient(data):
    network = logistic(6)
    (total,), n = gradient_sums(data[2].limit(0), network)
    assert n == 0 and not total.any()


def test_scores_and_loss(data):
    x, y, df = data
    network = perceptron(6, seed=2)
    p = probability(network)
    rows = df.select("features", p.alias("p"), prediction(p).alias("c")).collect()
    expected = network.probability(np.array([r["features"] for r in rows]))
    assert np.allclose([r["p"] for r in rows], expected)
    assert [r["c"] for r in rows] == list((expected > 0.5).astype(float))
    assert abs(mean_loss(df, network).first()["loss"] - network.loss_sum(x, y) / 600) < 1e-9


def test_certain_mistakes_have_a_bounded_loss(spark):
    network = Network(((np.array([[1e6]]), np.zeros(1)),))
    df = spark.createDataFrame([([1.0], 0.0), ([-1.0], 1.0)], "features array<double>, label double")
    assert mean_loss(df, network).first()["loss"] == 100.0
    assert network.loss_sum(np.array([[1.0], [-1.0]]), np.array([0.0, 1.0])) == 200.0


@pytest.mark.parametrize("direct", [64 << 20, 0])
def test_training_is_a_function_of_data_and_seed(data, direct, monkeypatch):
    monkeypatch.setattr(network_module, "DIRECT_BYTES", direct)
    x, y, df = data
    trainer = Trainer(epochs=10, steps=4, learning_rate=0.05)
    trained = [trainer.fit(df.repartition(n), perceptron(6)).flat for n in (1, 3, 8)]
    for other in trained[1:]:
        assert np.allclose(trained[0], other, rtol=0, atol=1e-9)
    network = perceptron(6).with_flat(trained[0])
    assert ((network.probability(x) > 0.5) == y).mean() > 0.9
    share = y.mean()
    base_rate_loss = -(share * np.log(share) + (1 - share) * np.log(1 - share))
    assert network.loss_sum(x, y) / len(y) < 0.6 * base_rate_loss


def test_one_step_is_adam(spark):
    """The first Adam step moves every weight by the learning rate."""
    df = spark.createDataFrame([([1.0, -2.0], 1.0)], "features array<double>, label double")
    trained = Trainer(epochs=1, learning_rate=0.01).fit(df, logistic(2))
    assert np.allclose(trained.flat, [0.01, -0.01, 0.01], atol=1e-6)


def test_wrong_width_is_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0, 2.0, 3.0, 4.0], 0.0)], "features array<double>, label double")
    with pytest.raises(Exception, match="has not 3 positions"):
        gradient_sums(df.coalesce(1), logistic(3))


def test_weights_as_a_table(spark):
    network = perceptron(4, hidden=3, seed=5)
    stored = network.to_frame(spark)
    assert stored.columns == ["layer", "i", "j", "value"] and stored.count() == 4 * 3 + 3 + 3 + 1
    assert np.array_equal(Network.from_frame(stored.orderBy(F.rand())).flat, network.flat)


# --- sparse vectors -----------------------------------------------------------------------------

SPARSE = "features struct<positions: array<int>, values: array<double>>, label double"


def sparse_data(spark, n=200, width=40):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((n, width)) < 0.1, rng.normal(size=(n, width)), 0.0)
    x[0] = 0
    y = (rng.random(n) < 0.5).astype(float)
    rows = [((np.nonzero(r)[0].tolist(), r[np.nonzero(r)[0]].tolist()), float(v)) for r, v in zip(x, y)]
    dense = [(r.tolist(), float(v)) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, SPARSE).repartition(3), spark.createDataFrame(dense, "features array<double>, label double"), x, y


def test_sparse_vectors_give_what_dense_ones_give(spark, monkeypatch):
    sparse, dense, x, y = sparse_data(spark)
    for network in (perceptron(40, hidden=5, seed=1), logistic(40)):
        (total,), n = gradient_sums(sparse, network)
        assert n == len(y) and np.allclose(total, network.gradient_sum(x, y), atol=1e-9)
        assert abs(mean_loss(sparse, network).first()["loss"] - network.loss_sum(x, y) / len(y)) < 1e-9
    rows = [((r["positions"], r["values"]), v) for r, v in sparse.select("features", "label").collect()]
    fixed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "sample_id long, " + SPARSE)
    again = np.zeros((len(rows), 40))
    for i, ((at, values), _) in enumerate(rows):
        again[i, at] = values
    same = spark.createDataFrame([(i, r.tolist(), rows[i][1]) for i, r in enumerate(again)], "sample_id long, features array<double>, label double")
    trainer = Trainer(epochs=3, steps=2, learning_rate=0.05)
    assert np.allclose(trainer.fit(fixed, perceptron(40)).flat, trainer.fit(same, perceptron(40)).flat, atol=1e-6)
    monkeypatch.setattr(network_module, "SLICE", 16)  # blocks of zeros are not sent
    (total,), _ = gradient_sums(sparse, logistic(40))
    assert np.allclose(total, logistic(40).gradient_sum(x, y), atol=1e-9)


def test_sparse_positions_beyond_the_model_are_an_error(spark):
    df = spark.createDataFrame([(([7], [1.0]), 1.0)], SPARSE)
    with pytest.raises(Exception, match="has not 3 positions"):
        gradient_sums(df, logistic(3))


# --- epochs over all samples ---------------------------------------------------------------------

def test_an_epoch_visits_every_sample_once_in_its_order(spark, data, monkeypatch):
    from pyspark.sql import Window

    from provspark.operators.split import epoch_rank

    x, y, df = data
    ids = df.withColumn("sample_id", F.md5(F.array_join(F.transform("features", lambda v: v.cast("string")), ",")))
    seen = []
    gradient = network_module._batch_gradient
    monkeypatch.setattr(network_module, "_batch_gradient", lambda batch, *a: seen.append(sorted(bytes(r.x) for r in batch.collect())) or gradient(batch, *a))
    trained = Trainer(epochs=2, batch_size=64, learning_rate=0.05).fit(ids, logistic(6))
    sizes = [len(b) for b in seen]
    assert sizes == ([64] * 9 + [24]) * 2
    for epoch in (0, 1):
        place = F.row_number().over(Window.orderBy(epoch_rank(epoch + 1), "sample_id")) - 1
        by_batch = {}
        for r in ids.select("features", place.alias("place")).collect():
            by_batch.setdefault(r.place // 64, []).append(np.array(r.features, np.float32).tobytes())
        assert [sorted(by_batch[k]) for k in sorted(by_batch)] == seen[10 * epoch : 10 * epoch + 10]
    assert seen[:10] != seen[10:]
    other = Trainer(epochs=2, batch_size=64, learning_rate=0.05).fit(ids.repartition(7), logistic(6))
    assert np.allclose(trained.flat, other.flat, atol=1e-9)
    assert ((trained.probability(x) > 0.5) == y).mean() > 0.85
