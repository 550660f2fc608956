"""Near-duplicate vectors: int8 tile products with rigorous bounds, full precision where they leave doubt.

Vectors of one label are compared all with all, in tiles. A unit vector x is stored as s*q + e with
8-bit q; for two of them

    | x.y - s*t*q.r |  <=  |sq||f| + |e||tr| + |e||f|,

with the norms of the real quantisation errors e and f. The integer product of two tiles therefore
decides most pairs; only those whose bounds hold the threshold between them are computed again in
double precision. A task gives per vector the number of links and one node of its local component, so
the output grows with the vectors, not with the pairs.

Equal vectors are one class with a count. Tiles have a bounded size, whatever the label; a label with
n classes needs about (n / tile)^2 / 2 tile products, which are spread evenly over the tasks.

Defined cases: null labels, and vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length never link; rows without an id have no
links and a null component and are kept; rows that share an id are vectors of their own; repeated rows count as vectors of their own; no rows give no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import by_row, components
from provspark.operators.storage import materialise

TILE_BYTES, TILE_ROWS = 1 << 20, 2048
EXACT_FLOAT32 = (1 << 24) // (127 * 127)
BATCH = 1 << 16


class Tile:
    """Unit vectors of a tile with their 8-bit form and the norms that bound its error."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, values: np.ndarray):
        self.nodes, self.copies = nodes, copies
        values = values / np.abs(values).max(axis=1, keepdims=True)
        self.unit = values / np.sqrt((values * values).sum(axis=1, keepdims=True))
        scale = np.abs(self.unit).max(axis=1, keepdims=True) / 127
        self.q = np.rint(self.unit / scale).astype(np.int8)
        self.scale = scale[:, 0]
        approximate = self.q * scale
        self.norm = np.sqrt((approximate * approximate).sum(axis=1))
        self.error = np.sqrt(((self.unit - approximate) ** 2).sum(axis=1))


def links_of(a: Tile, b: Tile, threshold: float, same: bool) -> np.ndarray:
    """Boolean matrix of the pairs of two tiles with cosine >= threshold; of a tile with itself, no diagonal."""
    kind = np.float32 if a.q.shape[1] <= EXACT_FLOAT32 else np.float64
    product = (a.q.astype(kind) @ b.q.astype(kind).T).astype(np.float64) * a.scale[:, None] * b.scale[None, :]
    bound = a.norm[:, None] * b.error[None, :] + a.error[:, None] * b.norm[None, :] + a.error[:, None] * b.error[None, :] + 1e-9
    linked = product - bound >= threshold
    i, j = np.nonzero((product + bound >= threshold) & ~linked)
    for at in range(0, len(i), BATCH):
        x, y = i[at : at + BATCH], j[at : at + BATCH]
        linked[x, y] = (a.unit[x] * b.unit[y]).sum(axis=1) >= threshold
    if same:
        np.fill_diagonal(linked, False)
    return linked


def local_roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the rows and columns of a bipartite graph (row numbers; columns without links: -1)."""
    i, j = np.nonzero(linked)
    by_j = np.argsort(j, kind="stable")
    rows, row_at = np.unique(i, return_index=True)
    columns, column_at = np.unique(j[by_j], return_index=True)
    left, right = np.arange(linked.shape[0]), np.full(linked.shape[1], -1)
    while True:
        right[columns] = np.minimum.reduceat(left[i[by_j]], column_at)
        low = np.minimum.reduceat(right[j], row_at)
        # Follow labels of labels, so that long chains need few turns.
        low = np.minimum(low, left[low])
        if (low == left[rows]).all():
            return left, right
        left[rows] = low


FOUND = "node long, n_links long, root long"


def _compared(threshold: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                dim, same = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                a, b = (Tile(*_unpacked(part, side, dim)) for side in (2, 5))
                linked = links_of(a, b, threshold, same)
                if not linked.any():
                    continue
                left, right = local_roots(linked)
                out = [(a.nodes, linked @ b.copies, a.nodes[left], linked.any(axis=1))]
                if not same:
                    out.append((b.nodes, a.copies @ linked, a.nodes[right], linked.any(axis=0)))
                else:
                    # A row and a column of the same number are one vector.
                    out.append((b.nodes, np.zeros(len(b.nodes), np.int64), a.nodes[right], linked.any(axis=0)))
                for nodes, n, roots, some in out:
                    yield pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in (nodes, n, roots)], ["node", "n_links", "root"])

    return compared


def _unpacked(part: pa.RecordBatch, at: int, dim: int):
    nodes, copies, values = (part.column(at + k) for k in range(3))
    flat = values.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return nodes.flatten().to_numpy(), copies.flatten().to_numpy(), flat.reshape(-1, dim)


def link_embeddings(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93
) -> DataFrame:
    """One row per row of ``vectors``: ``key, n_links, component_id, kept``."""
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    found = by_row(rows, lambda rows: _linked(rows, threshold))
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.lit(True))
    return found.select(F.col("key").alias(key), "n_links", "component_id", kept.alias("kept"))


def _linked(rows: DataFrame, threshold: float) -> DataFrame:
    """``(key, n_links, component_id)`` of ``rows(key, vector, label)`` with different keys."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("key").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
    good = good & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    clean = rows.where(good)
    classes = clean.groupBy("label", "vector").agg(F.min("key").alias("node"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("dim", F.size("vector")), "classes")
    most = F.least(F.lit(TILE_ROWS), F.greatest(F.lit(64), F.floor(F.lit(TILE_BYTES) / (4 * F.col("dim")))))
    tiles = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / most).cast("int"))
    tiles = materialise(tiles, "tiles")
    dealt = classes.join(tiles.select("label", "dim", "tiles"), ["label", "dim"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    blocks = dealt.groupBy("label", "dim", "tile").agg(F.collect_list(F.struct("node", "copies", "vector")).alias("items"))
    blocks = blocks.select("label", "dim", "tile", "items.node", "items.copies", "items.vector")
    blocks = materialise(blocks, "blocks")
    low = tiles.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = low.select("label", "dim", "i", F.explode(F.sequence("i", F.col("tiles") - 1)).alias("j"))
    side = lambda t: blocks.select("label", "dim", F.col("tile").alias(t), F.col("node").alias(f"node_{t}"), F.col("copies").alias(f"copies_{t}"), F.col("vector").alias(f"vector_{t}"))
    pairs = pairs.join(side("i"), ["label", "dim", "i"]).join(side("j"), ["label", "dim", "j"])
    columns = [F.col(f"{name}_{t}") for t in "ij" for name in ("node", "copies", "vector")]
    found = pairs.select("dim", (F.col("i") == F.col("j")).alias("same"), *columns).mapInArrow(_compared(threshold), FOUND)
    found = materialise(found, "tile-links")
    sums = found.groupBy("node").agg(F.sum("n_links").alias("linked"))
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = classes.join(sums, "node", "left").join(reached, "node", "left")
    classes = classes.select(
        "label", "vector", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    done = clean.join(classes, ["label", "vector"]).select("key", "n_links", "component_id")
    rest = rows.where(~good).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return done.union(rest)
