"""Small feed-forward binary classifiers, trained, scored and differentiated by Spark jobs.

The training rows never leave the executors: a task streams its rows as Arrow batches and
returns sums of the size of the model. Only such sums and the weights reach the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions.naming import SAMPLE_ID
from provspark.functions.vectors import is_sparse
from provspark.operators.split import epoch_order
from provspark.operators.storage import delete_paths, made_folders, new_folder

# Tasks get the code below with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIRECT_BYTES = 64 * 2**20  # partial sums up to this size are added up without a shuffle
SLICE = 1 << 16  # numbers per block of a partial sum
LOG_FLOOR = -100.0  # a logarithm in the loss is never below this (fixed value)


@dataclass(frozen=True)
class Network:
    """Dense layers with ReLU between them and a sigmoid at the end; weights as numpy arrays.

    One layer is logistic regression; two layers are the multi-layer perceptron.
    """

    layers: tuple  # of (weights [n_in, n_out], bias [n_out])

    # --- weights as one vector, and as a table ------------------------------------------

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for layer in self.layers for p in layer])

    def with_flat(self, values: np.ndarray) -> "Network":
        layers, at = [], 0
        for weights, bias in self.layers:
            w = values[at:at + weights.size].reshape(weights.shape)
            at += weights.size
            b = values[at:at + bias.size]
            at += bias.size
            layers.append((w, b))
        return Network(tuple(layers))

    def rows(self) -> list[tuple[str, int, int, float]]:
        """``(layer, i, j, value)``; a bias has ``i = -1``."""
        result = []
        for n, (weights, bias) in enumerate(self.layers):
            for (i, j), value in np.ndenumerate(weights):
                result.append((f"layer{n}", int(i), int(j), float(value)))
            result += [(f"layer{n}", -1, j, float(v)) for j, v in enumerate(bias)]
        return result

    def to_frame(self, spark: SparkSession) -> DataFrame:
        layer, i, j, value = zip(*self.rows())
        table = pa.table({"layer": layer, "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": value})
        return spark.createDataFrame(table)

    @staticmethod
    def from_frame(df: DataFrame) -> "Network":
        pdf = df.toArrow().to_pandas()
        layers = []
        for _, part in sorted(pdf.groupby("layer"), key=lambda kv: int(kv[0][5:])):
            weights = np.zeros((part["i"].max() + 1, part["j"].max() + 1))
            bias = np.zeros(part["j"].max() + 1)
            inner, outer = part[part["i"] >= 0], part[part["i"] < 0]
            weights[inner["i"], inner["j"]] = inner["value"]
            bias[outer["j"]] = outer["value"]
            layers.append((weights, bias))
        return Network(tuple(layers))

    # --- the arithmetic on one batch ------------------------------------------------------

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Outputs of all layers; the last is the probability of class 1, shape ``[n]``."""
        outputs = [x]
        for weights, bias in self.layers[:-1]:
            outputs.append(np.maximum(outputs[-1] @ weights + bias, 0.0))
        weights, bias = self.layers[-1]
        outputs.append(_sigmoid((outputs[-1] @ weights + bias)[:, 0]))
        return outputs

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1]

    def gradient_sum(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sum over the rows of the gradient of the cross-entropy, as one flat vector."""
        outputs = self.forward(x)
        delta = (outputs[-1] - y)[:, None]
        parts = []
        for n in range(len(self.layers) - 1, -1, -1):
            parts.append((outputs[n].T @ delta, delta.sum(axis=0)))
            if n:
                delta = (delta @ self.layers[n][0].T) * (outputs[n] > 0)
        return np.concatenate([p.ravel() for layer in reversed(parts) for p in layer])

    def loss_sum(self, x: np.ndarray, y: np.ndarray) -> float:
        p = self.probability(x)
        with np.errstate(divide="ignore"):
            hit = np.maximum(np.log(p), LOG_FLOOR)
            miss = np.maximum(np.log1p(-p), LOG_FLOOR)
        return float(-(y * hit + (1 - y) * miss).sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def _random_layer(rng, n_in: int, n_out: int):
    bound = 1.0 / np.sqrt(n_in)
    return rng.uniform(-bound, bound, (n_in, n_out)), rng.uniform(-bound, bound, n_out)


def perceptron(num_features: int, hidden: int = 64, seed: int = 42) -> Network:
    """One hidden layer with random initial weights."""
    rng = np.random.default_rng(seed)
    return Network((_random_layer(rng, num_features, hidden), _random_layer(rng, hidden, 1)))


def logistic(num_features: int) -> Network:
    """No hidden layer, all weights 0."""
    return Network(((np.zeros((num_features, 1)), np.zeros(1)),))


# --- Spark jobs ---------------------------------------------------------------------------

class SparseRows:
    """Rows of a sparse matrix, as far as a layer needs it: times weights, and transposed times deltas."""

    def __init__(self, offsets: np.ndarray, positions: np.ndarray, values: np.ndarray, width: int):
        self.offsets, self.positions, self.values, self.width = offsets, positions, values, width
        self.transposed = False

    @property
    def T(self) -> "SparseRows":
        other = SparseRows(self.offsets, self.positions, self.values, self.width)
        other.transposed = not self.transposed
        return other

    def __matmul__(self, right: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        if self.transposed:
            out = np.zeros((self.width, right.shape[1]))
            np.add.at(out, self.positions, self.values[:, None] * right[rows])
        else:
            out = np.zeros((len(self.offsets) - 1, right.shape[1]))
            np.add.at(out, rows, self.values[:, None] * right[self.positions])
        return out


def _sparse(column: pa.StructArray, width: int) -> SparseRows:
    positions, values = column.flatten()
    offsets = positions.offsets.to_numpy()
    at = positions.flatten().to_numpy(zero_copy_only=False)
    if len(at) and not 0 <= at.min() <= at.max() < width:
        raise ValueError(f"a feature vector has not {width} positions")
    return SparseRows(offsets - offsets[0], at, values.flatten().to_numpy(zero_copy_only=False).astype(float), width)


def _matrix(column: pa.Array, width: int):
    """A list column with lists of one length as a matrix, without a copy per row; a sparse one as ``SparseRows``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_struct(column.type):
        return _sparse(column, width)
    if len(column) and not pc.all(pc.equal(pc.list_value_length(column), width)).as_py():
        raise ValueError(f"a feature vector has not {width} positions")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _packer(width: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each feature vector as one binary value of single-precision floats."""
        size = width * 4
        rows = max(1, 2**30 // size)  # the positions inside one binary column are 32-bit numbers
        for batch in batches:
            if pa.types.is_struct(batch.column(0).type):
                yield pa.RecordBatch.from_arrays([_packed_sparse(batch.column(0), width), *batch.columns[1:]], ["x", "y", "step"])
                continue
            matrix = _matrix(batch.column(0), width)
            for at in range(0, batch.num_rows, rows):
                values = np.ascontiguousarray(matrix[at:at + rows], dtype=np.float32)
                ends = np.arange(len(values) + 1, dtype=np.int32) * size
                x = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values)])
                rest = [batch.column(i).slice(at, rows) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([x, *rest], ["x", "y", "step"])

    return packed


def _packed_sparse(column: pa.StructArray, width: int) -> pa.Array:
    """Each sparse vector as its 32-bit positions followed by its single-precision values."""
    rows = _sparse(column, width)
    positions, values = rows.positions.astype(np.int32), rows.values.astype(np.float32)
    return pa.array([positions[a:b].tobytes() + values[a:b].tobytes() for a, b in zip(rows.offsets[:-1], rows.offsets[1:])], pa.binary())


def _unpacked_sparse(column: pa.Array, width: int) -> SparseRows:
    parts = column.to_pylist()
    counts = np.array([len(p) // 8 for p in parts], np.int64)
    positions = b"".join(p[: len(p) // 2] for p in parts)
    values = b"".join(p[len(p) // 2 :] for p in parts)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return SparseRows(offsets, np.frombuffer(positions, np.int32), np.frombuffer(values, np.float32).astype(float), width)


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as a matrix; a view, as long as the values lie one after another."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]]
    return values.view(np.float32).reshape(len(column), width)


def _vector(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


SUMS = "slice int, task int, part binary"


def _sum_rows(values: np.ndarray) -> pa.RecordBatch:
    """A partial sum as blocks of ``SLICE`` numbers; blocks of zeros say nothing."""
    starts = [at for at in range(0, len(values), SLICE) if values[at:at + SLICE].any()]
    parts = [values[at:at + SLICE].tobytes() for at in starts]
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([at // SLICE for at in starts], pa.int32()), pa.array([task] * len(parts), pa.int32()), pa.array(parts, pa.binary())],
        ["slice", "task", "part"],
    )


def _added(table: pa.Table) -> pa.Table:
    """One block for all blocks of a group; they come in the order of their tasks."""
    table = table.sort_by("task")
    total = sum(np.frombuffer(part, np.float64) for part in table["part"].to_pylist())
    return pa.table(
        {"slice": table["slice"][:1], "task": table["task"][:1], "part": pa.array([total.tobytes()], pa.binary())}
    )


def _summed(parts: DataFrame, size: int, tasks: int) -> np.ndarray:
    """Add up the vectors of all tasks; the result has the size of the model.

    Small sums come to the driver as they are. Others are added up in two levels, so that a group
    holds about the root of the number of tasks, as blocks of half a megabyte.
    """
    if tasks * size * 8 > DIRECT_BYTES:
        lanes = math.isqrt(tasks) + 1
        parts = parts.groupBy("slice", F.col("task") % lanes).applyInArrow(_added, SUMS)
        parts = parts.groupBy("slice").applyInArrow(_added, SUMS)
    total = np.zeros(size)
    for row in sorted(parts.collect(), key=lambda r: (r["slice"], r["task"])):
        at = row["slice"] * SLICE
        total[at:at + SLICE] += np.frombuffer(row["part"], np.float64)
    return total


def gradient_sums(samples: DataFrame, network: Network, columns=("features",), label="label"):
    """Per feature column the summed gradient over all samples, and the number of samples.

    All columns are handled in one pass: one partial sum per task, then one sum by position.
    """
    size, k, width = network.flat.size, len(columns), network.layers[0][0].shape[0]
    shared = samples.sparkSession.sparkContext.broadcast(network.layers)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, model = np.zeros(k * size + 1), Network(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _vector(batch.column(k))
            for i in range(k):
                total[i * size:(i + 1) * size] += model.gradient_sum(_matrix(batch.column(i), width), y)
            total[-1] += batch.num_rows
        if total[-1]:
            yield _sum_rows(total)

    picked = samples.select(*columns, F.col(label).cast("double"))
    total = _summed(picked.mapInArrow(partial, SUMS), k * size + 1, picked.rdd.getNumPartitions())
    shared.destroy()
    return [total[i * size:(i + 1) * size] for i in range(k)], int(total[-1])


def probability(network: Network, features: Column | str = "features") -> Column:
    """Probability of class 1 as a column."""
    width = network.layers[0][0].shape[0]

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(network.probability(_matrix(batch, width)), pa.float64())

    return F.arrow_udf(score, "double")(features)


def prediction(probability: Column) -> Column:
    return F.when(probability > 0.5, 1.0).otherwise(0.0)


def cross_entropy(probability: Column, label: Column) -> Column:
    """Loss of one row; a logarithm is never below -100."""
    hit = F.greatest(F.ln(F.greatest(probability, F.lit(1e-300))), F.lit(LOG_FLOOR))
    miss = F.greatest(F.ln(F.greatest(1 - probability, F.lit(1e-300))), F.lit(LOG_FLOOR))
    return -(label * hit + (1 - label) * miss)


def mean_loss(samples: DataFrame, network: Network, features="features", label="label") -> DataFrame:
    """Mean cross-entropy over the samples as a one-row table."""
    scored = samples.select(F.col(label).cast("double").alias("y"), probability(network, features).alias("p"))
    return scored.agg(F.avg(cross_entropy(F.col("p"), F.col("y"))).alias("loss"), F.count("*").alias("n"))


@dataclass(frozen=True)
class Trainer:
    """Synchronous Adam on large batches, one Spark job per step.

    Every sample belongs to one of ``steps`` batches, by a hash of its id (without an id: of its
    values); an epoch takes all batches once, in a seeded order. A step sums the gradients of its
    batch over all tasks and moves the weights once, on the driver. The trained weights are thus a
    function of the samples, the settings and the seed; tasks, files and cores only change the order
    in which numbers are added. The vectors are packed into binary values and stored by batch once,
    so that a step reads its own files and converts nothing.

    With ``batch_size`` an epoch visits all samples in an order of its own (``epoch_order``), so many
    at a step: batches are new ones in every epoch, and steps grow with the data. Each epoch then costs
    one sort of the packed samples by range.
    """

    epochs: int = 25
    steps: int = 8
    learning_rate: float = 0.01
    seed: int = 42
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    batch_size: int | None = None

    def _dealt(self, packed: DataFrame, epoch: int) -> tuple[DataFrame, int, list[str]]:
        """The packed samples by step, as this epoch visits them; how many steps, and the folders to drop afterwards."""
        spark = packed.sparkSession
        with made_folders() as made:
            placed = epoch_order(packed, epoch + 1, "id")
            steps = -(-placed.count() // self.batch_size)
            path = new_folder(spark, "epoch")
            step = F.floor(F.col("place") / self.batch_size).cast("int").alias("step")
            placed.select("x", "y", step).repartition("step").write.partitionBy("step").parquet(path)
        return spark.read.schema("x binary, y double, step int").parquet(path), steps, made

    def fit(self, train: DataFrame, network: Network, features="features", label="label") -> Network:
        spark, size = train.sparkSession, network.flat.size
        width = network.layers[0][0].shape[0]
        key = [SAMPLE_ID] if SAMPLE_ID in train.columns else [features, label]
        step = F.pmod(F.xxhash64(*key, F.lit(self.seed)), F.lit(self.steps)).cast("int")
        whole = self.batch_size is None
        sparse = is_sparse(train, features)
        third = step if whole else F.concat_ws(":", *[F.col(k).cast("string") for k in key])
        schema = "x binary, y double, " + ("step int" if whole else "id string")
        rows = train.select(features, F.col(label).cast("double"), third)
        path = new_folder(spark, "packed")
        packed = rows.mapInArrow(_packer(width), schema.replace("id string", "step string"))
        (packed.write.partitionBy("step") if whole else packed.withColumnRenamed("step", "id").write).parquet(path)
        made: list[str] = []
        try:
            stored = spark.read.schema(schema).parquet(path)
            steps = self.steps
            theta, first, second = network.flat, np.zeros(size), np.zeros(size)
            (b1, b2), moves, rng = self.betas, 0, np.random.default_rng(self.seed)
            for epoch in range(self.epochs):
                dealt = stored
                if not whole:
                    delete_paths(spark, made)
                    dealt, steps, made = self._dealt(stored, epoch)
                if not whole or not epoch:
                    batches = [dealt.where(F.col("step") == k).select("x", "y") for k in range(steps)]
                    tasks = [batch.rdd.getNumPartitions() for batch in batches]
                for k in rng.permutation(steps) if whole else range(steps):
                    total = _batch_gradient(batches[k], network.with_flat(theta), tasks[k], sparse)
                    if not total[-1]:
                        continue
                    g, moves = total[:-1] / total[-1], moves + 1
                    first = b1 * first + (1 - b1) * g
                    second = b2 * second + (1 - b2) * g * g
                    theta = theta - self.learning_rate * (first / (1 - b1**moves)) / (
                        np.sqrt(second / (1 - b2**moves)) + self.epsilon
                    )
            return network.with_flat(theta)
        finally:
            delete_paths(spark, [path, *made])


def _batch_gradient(batch: DataFrame, network: Network, tasks: int, sparse: bool = False) -> np.ndarray:
    """Summed gradient over packed samples, and their number."""
    width = network.layers[0][0].shape[0]
    shared = batch.sparkSession.sparkContext.broadcast(network.layers)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = Network(shared.value), None
        for batch in batches:
            if batch.num_rows:
                x = _unpacked_sparse(batch.column(0), width) if sparse else _unpacked(batch.column(0), width).astype(float)
                y = _vector(batch.column(1))
                part = np.append(model.gradient_sum(x, y), float(len(y)))
                total = part if total is None else total + part
        if total is not None:
            yield _sum_rows(total)

    total = _summed(batch.mapInArrow(partial, SUMS), network.flat.size + 1, max(1, tasks))
    shared.destroy()
    return total
