"""Feature encoders.

An encoder turns its input columns into one block of the feature vector, an ``array<double>`` column.
What it learns from the training rows (means, categories) is its state. A chain of encoders may learn at
several steps; all chains are then fitted level by level: one aggregation for the moments and one for
the categories of a level, over rows that have gone through the levels before.

Blocks with very many positions are sparse (``WideOneHot``): their categories are a table that is joined,
never a list on the driver. A feature vector with such a block is a struct of ``positions`` and ``values``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.util import PythonEvalType

from provspark.functions.text import char_count, tokens, word_count
from provspark.operators.sizing import broadcast_if_small
from provspark.operators.split import with_place
from provspark.operators.storage import materialise, new_folder, together

MOST_CATEGORIES = 1_000_000  # of dense one-hot blocks; more positions than that belong in a sparse one
SCALARS = 200  # up to so many moments are separate aggregates, more are rows of one
SLICE_BYTES = 4 << 20  # of a batch that a pandas UDF is given at a time
SPARSE = "struct<positions: array<int>, values: array<double>>"


class Encoder:
    """Base of all encoders: stateless, one position per input column.

    ``moments`` / ``categories`` name the column expressions whose mean and deviation, or whose
    distinct values, the encoder wants to learn; ``with_state`` returns the fitted encoder.
    ``tables`` names those whose values become a stored table, for ``with_tables``.
    """

    sparse = False

    def moments(self, inputs: list[Column]) -> list[Column]:
        return []

    def categories(self, inputs: list[Column]) -> list[Column]:
        return []

    def with_state(self, moments: list[tuple[float, float]], categories: list[list[Any]]) -> "Encoder":
        return self

    def tables(self, inputs: list[Column]) -> list[Column]:
        return []

    def with_tables(self, stored: list[dict]) -> "Encoder":
        return self

    def document(self) -> dict:
        """The encoder with its options and what it learned, ready for JSON."""
        options = {f.name: getattr(self, f.name) for f in fields(self)} if is_dataclass(self) else {}
        plain = {k: v for k, v in options.items() if k != "state" and isinstance(v, (str, int, float, bool, type(None)))}
        return {"type": type(self).__name__, "options": plain, "state": [_listed(s) for s in getattr(self, "state", ())]}

    def with_document(self, document: dict) -> "Encoder":
        """The same encoder with the state of a document."""
        if document["type"] != type(self).__name__:
            raise ValueError(f"saved state of {document['type']} does not belong to {type(self).__name__}")
        state = [tuple(s) if isinstance(s, list) else s for s in document["state"]]
        if not state:
            return self
        return self.with_tables(state) if self.sparse else self.with_state(state, state)

    def prepare(self, df: DataFrame, inputs: list[Column], target: str) -> DataFrame:
        """Add the encoded block as the column ``target``."""
        return df.withColumn(target, self.column(inputs))

    def column(self, inputs: list[Column]) -> Column:
        raise NotImplementedError

    def width(self, n_inputs: int) -> int:
        return n_inputs

    def ranges(self, n_inputs: int, start: int) -> list[tuple[int, int]]:
        """The positions each input column influences: by default the whole block."""
        return [(start, start + self.width(n_inputs))] * n_inputs


def _listed(state):
    return list(state) if isinstance(state, (list, tuple)) else state


def _as_text(value: Column) -> Column:
    """Categories of any atomic type are stored and compared as text; zero has one sign."""
    text = value.cast("string")
    return F.when(F.typeof(value).isin("float", "double") & (text == "-0.0"), "0.0").otherwise(text)


def _position(text: Column, known) -> Column:
    """Place of a category, by one lookup in a constant map; null if it is not known."""
    places = {k: i for i, k in enumerate(known) if k is not None}
    found = F.try_element_at(F.from_json(F.lit(json.dumps(places)), "map<string,int>"), text)
    return F.when(text.isNull(), F.lit(len(known) - 1 if None in known else None).cast("int")).otherwise(found)


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p + by)


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(float("nan")))


@dataclass(frozen=True)
class Numeric(Encoder):
    """The inputs as they are."""

    def column(self, inputs):
        return F.array(*[_number(c) for c in inputs])

    def ranges(self, n_inputs, start):
        return [(start + i, start + i + 1) for i in range(n_inputs)]


@dataclass(frozen=True)
class WordCount(Numeric):
    """Number of pieces between single spaces."""

    def column(self, inputs):
        return F.array(*[_number(word_count(c)) for c in inputs])


@dataclass(frozen=True)
class CharCount(Numeric):
    def column(self, inputs):
        return F.array(*[_number(char_count(c)) for c in inputs])


@dataclass(frozen=True)
class StandardScaler(Encoder):
    """(x - mean) / population deviation; a constant column is only centred."""

    state: tuple = ()

    def moments(self, inputs):
        return [c.cast("double") for c in inputs]

    def with_state(self, moments, categories):
        return replace(self, state=tuple(moments))

    def column(self, inputs):
        scaled = [
            (_number(c) - F.lit(mean)) / F.lit(std if std else 1.0)
            for c, (mean, std) in zip(inputs, self.state, strict=True)
        ]
        return F.array(*scaled)

    def ranges(self, n_inputs, start):
        return [(start + i, start + i + 1) for i in range(n_inputs)]


@dataclass(frozen=True)
class OneHot(Encoder):
    """One position per category in sorted order, for each input column.

    Null is a category of its own (the last) if it occurs in training. A value not seen in
    training raises, or with ``unknown="ignore"`` is all zeros.
    """

    unknown: str = "error"
    state: tuple = ()

    def categories(self, inputs):
        return list(inputs)

    def with_state(self, moments, categories):
        return replace(self, state=tuple(tuple(c) for c in categories))

    def column(self, inputs):
        blocks = []
        for value, known in zip(inputs, self.state, strict=True):
            text = _as_text(value)
            place = _position(text, known)
            if self.unknown == "error":
                message = F.concat(F.lit("unknown category: "), F.coalesce(text, F.lit("null")))
                place = F.coalesce(place, F.raise_error(message).cast("int"))
            # Zeros on both sides of the one place: no comparison per position.
            width = F.lit(len(known))
            there = F.concat(F.array_repeat(F.lit(0.0), place), F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), width - 1 - place))
            blocks.append(F.coalesce(there, F.array_repeat(F.lit(0.0), width)))
        return F.concat(*blocks)

    def width(self, n_inputs):
        return sum(len(c) for c in self.state)

    def ranges(self, n_inputs, start):
        result = []
        for known in self.state:
            result.append((start, start + len(known)))
            start += len(known)
        return result


@dataclass(frozen=True)
class WideOneHot(Encoder):
    """One position per category, as ``OneHot``, for any number of them: a sparse block.

    The categories are a stored table ``(category, position)`` in sorted order, null last, and rows meet it
    by a join on the value: a lookup inside the tasks while the table is small, else a shuffle.
    """

    unknown: str = "error"
    state: tuple = ()  # per input: {"path", "count"}
    sparse = True

    def tables(self, inputs):
        return list(inputs)

    def with_tables(self, stored):
        return replace(self, state=tuple(stored))

    def prepare(self, df, inputs, target):
        places, start = [], 0
        for i, (value, known) in enumerate(zip(inputs, self.state, strict=True)):
            text, place = f"__text_{i}", f"__place_{i}"
            table = df.sparkSession.read.schema("category string, position int").parquet(known["path"])
            table = broadcast_if_small(table.toDF(f"__category_{i}", place), known["count"])
            df = df.withColumn(text, _as_text(value)).join(table, F.col(text).eqNullSafe(F.col(f"__category_{i}")), "left")
            found = F.col(place) + start
            if self.unknown == "error":
                message = F.concat(F.lit("unknown category: "), F.coalesce(text, F.lit("null")))
                found = F.coalesce(found, F.raise_error(message).cast("int"))
            places.append(found)
            start += known["count"]
        positions = F.array_compact(F.array(*places))
        block = F.struct(positions.alias("positions"), F.transform(positions, lambda _: F.lit(1.0)).alias("values"))
        extra = [c for i in range(len(places)) for c in (f"__text_{i}", f"__place_{i}", f"__category_{i}")]
        return df.withColumn(target, block.cast(SPARSE)).drop(*extra)

    def width(self, n_inputs):
        return sum(known["count"] for known in self.state)

    def ranges(self, n_inputs, start):
        result = []
        for known in self.state:
            result.append((start, start + known["count"]))
            start += known["count"]
        return result


@dataclass(frozen=True)
class HashedText(Encoder):
    """Bag of tokens hashed into ``dimensions`` counts, scaled to unit length.

    ``hash="xxhash64"`` is several times cheaper; ``"md5"`` can be recomputed by any engine.
    Counting runs in the JVM on the token array of the row: no explode, no shuffle.
    """

    dimensions: int = 32
    hash: str = "xxhash64"
    normalise: bool = True

    def bucket(self, token: Column) -> Column:
        if self.hash == "xxhash64":
            return F.pmod(F.xxhash64(token), F.lit(self.dimensions))
        if self.hash == "md5":
            digits = F.substring(F.md5(token.cast("binary")), 1, 8)
            return F.conv(digits, 16, 10).cast("long") % self.dimensions
        raise ValueError(f"unknown hash {self.hash}")

    def prepare(self, df, inputs, target):
        pieces = F.concat(*[tokens(F.coalesce(c.cast("string"), F.lit(""))) for c in inputs])
        buckets = F.transform(pieces, lambda t: self.bucket(t).cast("string"))
        # The buckets are the whole vocabulary, so counting needs no fit.
        counter = CountVectorizerModel.from_vocabulary(
            [str(i) for i in range(self.dimensions)], inputCol="__buckets", outputCol="__counts"
        )
        df = counter.transform(df.withColumn("__buckets", buckets)).drop("__buckets")
        if self.normalise:
            df = Normalizer(p=2.0, inputCol="__counts", outputCol="__unit").transform(df).drop("__counts")
            return df.withColumn(target, vector_to_array("__unit")).drop("__unit")
        return df.withColumn(target, vector_to_array("__counts")).drop("__counts")

    def width(self, n_inputs):
        return self.dimensions


def _in_slices(udf):
    """The same pandas UDF, given some ``SLICE_BYTES`` of each batch at a time.

    A batch holds a number of rows, however long their texts are; as pandas objects they would all lie in the worker at once.
    """
    function, arrow_type = udf.func, to_arrow_type(udf.returnType)

    def series(column: pa.Array) -> pd.Series:
        values = column.to_pandas()
        zoned = pa.types.is_timestamp(column.type) and column.type.tz is not None
        return values.dt.tz_localize(None) if zoned else values

    @F.arrow_udf(udf.returnType)
    def sliced(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            rows, held = len(columns[0]), sum(c.nbytes for c in columns)
            step = max(1, rows * SLICE_BYTES // max(1, held))
            for low in range(0, rows, step):
                yield pa.Array.from_pandas(function(*[series(c.slice(low, step)) for c in columns]), type=arrow_type)
            pa.default_memory_pool().release_unused()

    return sliced if udf.deterministic else sliced.asNondeterministic()


@dataclass(frozen=True)
class BatchEmbedding(Encoder):
    """Vectors of a fixed width from a pandas UDF, such as a pretrained sentence encoder."""

    udf: Any
    dimensions: int

    def column(self, inputs):
        udf = _in_slices(self.udf) if getattr(self.udf, "evalType", None) == PythonEvalType.SQL_SCALAR_PANDAS_UDF else self.udf
        return udf(*inputs).cast("array<double>")

    def width(self, n_inputs):
        return self.dimensions


@dataclass(frozen=True)
class FunctionEncoder(Encoder):
    """Any function from the input Columns to an ``array<double>`` of a fixed width."""

    function: Any
    dimensions: int

    def column(self, inputs):
        return self.function(*inputs)

    def width(self, n_inputs):
        return self.dimensions


@dataclass(frozen=True)
class Sequential(Encoder):
    """Encoders in a row; each step reads the positions of the one before. Any of them may learn."""

    steps: tuple

    def __post_init__(self):
        if any(step.sparse for step in self.steps[:-1]):
            raise ValueError("a sparse block can only be the last step")

    @property
    def sparse(self):
        return self.steps[-1].sparse

    def document(self):
        return {"type": "Sequential", "steps": [step.document() for step in self.steps]}

    def with_document(self, document):
        if document["type"] != "Sequential" or len(document["steps"]) != len(self.steps):
            raise ValueError(f"saved state of {document['type']} does not belong to this chain")
        return Sequential(tuple(s.with_document(d) for s, d in zip(self.steps, document["steps"])))

    def prepare(self, df, inputs, target):
        df, inputs = through(df, self.steps[:-1], inputs, target)
        return self.steps[-1].prepare(df, inputs, target)

    def width(self, n_inputs):
        for step in self.steps:
            n_inputs = step.width(n_inputs)
        return n_inputs

    def ranges(self, n_inputs, start):
        spans, width = self.steps[0].ranges(n_inputs, 0), self.steps[0].width(n_inputs)
        for step in self.steps[1:]:
            # What the positions of a span influence, which is a span again.
            each = step.ranges(width, 0)
            spans = [(min(x for x, _ in each[a:b]), max(y for _, y in each[a:b])) if b > a else (0, 0) for a, b in spans]
            width = step.width(width)
        return [(start + a, start + b) for a, b in spans]


def through(df: DataFrame, steps, inputs: list[Column], name: str) -> tuple[DataFrame, list[Column]]:
    """Rows with the blocks of fitted steps, and the positions of the last one as columns."""
    for i, step in enumerate(steps):
        width = step.width(len(inputs))
        if isinstance(step, Numeric) and width == len(inputs):
            inputs = [F.get(step.column([c]), 0) for c in inputs]
        else:
            block = f"{name}_step_{i}"
            df = step.prepare(df, inputs, block)
            inputs = [F.get(F.col(block), j) for j in range(width)]
    return df, inputs


def chain(*steps: Encoder) -> Encoder:
    """Apply encoders one after another."""
    return Sequential(tuple(steps))


@dataclass(frozen=True)
class ColumnEncoders:
    """Encoders on column subsets, their blocks concatenated in the given order.

    ``parts`` is a list of ``(name, encoder, input columns)``; other columns are dropped.
    """

    parts: tuple = field(default=())

    def __init__(self, parts):
        object.__setattr__(self, "parts", tuple((n, e, tuple(c)) for n, e, c in parts))

    def fit(self, train: DataFrame, folder: str | None = None) -> "ColumnEncoders":
        """Learn all states from the training rows; category tables are stored below ``folder``.

        A level is the next step that learns in every chain that has one.
        """
        chains = [list(e.steps) if isinstance(e, Sequential) else [e] for _, e, _ in self.parts]
        done = [0] * len(chains)
        while True:
            df, level = train, []
            for i, (_, _, columns) in enumerate(self.parts):
                inputs = [F.col(f"`{c}`") for c in columns]
                while done[i] < len(chains[i]):
                    step = chains[i][done[i]]
                    df, read = through(df, chains[i][:done[i]], inputs, f"__fit_{i}_{done[i]}")
                    wants = step.moments(read), step.categories(read), step.tables(read)
                    if any(wants):
                        level.append((i, wants))
                        break
                    done[i] += 1
            if not level:
                break
            flat = [[c for _, wants in level for c in wants[k]] for k in range(3)]
            learned = together(
                lambda: _fit_moments(df, flat[0]), lambda: _fit_categories(df, flat[1]),
                lambda: [_fit_table(df, c, folder) for c in flat[2]],
            )
            for i, wants in level:
                own = [[learned[k].pop(0) for _ in wants[k]] for k in range(3)]
                step = chains[i][done[i]].with_state(own[0], own[1])
                chains[i][done[i]] = step.with_tables(own[2]) if own[2] else step
                done[i] += 1
        return ColumnEncoders([
            (name, Sequential(tuple(steps)) if isinstance(encoder, Sequential) else steps[0], columns)
            for (name, encoder, columns), steps in zip(self.parts, chains)
        ])

    @property
    def sparse(self) -> bool:
        return any(encoder.sparse for _, encoder, _ in self.parts)

    def transform(self, df: DataFrame, target: str = "features") -> DataFrame:
        """Add the feature vector."""
        kept, blocks, starts, start = df.columns, [], [], 0
        for i, (_, encoder, columns) in enumerate(self.parts):
            blocks.append(f"__block_{i}")
            starts.append(start)
            df = encoder.prepare(df, [F.col(f"`{c}`") for c in columns], blocks[-1])
            start += encoder.width(len(columns))
        if not self.sparse:
            vector = F.concat(*blocks)
        else:
            places, values = [], []
            for (_, encoder, _), block, first in zip(self.parts, blocks, starts):
                own = F.col(f"{block}.positions") if encoder.sparse else F.sequence(F.lit(0), F.size(block) - 1)
                places.append(_shifted(own, first))
                values.append(F.col(f"{block}.values") if encoder.sparse else F.col(block))
            vector = F.struct(F.concat(*places).alias("positions"), F.concat(*values).alias("values")).cast(SPARSE)
        others = [F.col(f"`{c}`") for c in kept if c != target]
        return df.select(*others, vector.alias(target))

    @property
    def width(self) -> int:
        return sum(encoder.width(len(columns)) for _, encoder, columns in self.parts)

    def matrix_provenance(self) -> list[tuple[str, int, int]]:
        """``(input column, start, stop)`` for every range of positions a column influences."""
        result, start = [], 0
        for _, encoder, columns in self.parts:
            for column, (a, b) in zip(columns, encoder.ranges(len(columns), start), strict=True):
                result.append((column, a, b))
            start += encoder.width(len(columns))
        return result

    def state(self) -> list[dict]:
        """All encoders with what they learned, ready for JSON."""
        return [{"name": name, "columns": list(columns), "encoder": encoder.document()} for name, encoder, columns in self.parts]

    def with_saved_state(self, saved: list[dict]) -> "ColumnEncoders":
        """The same encoders with states read back from a run."""
        fitted = []
        for (name, encoder, columns), entry in zip(self.parts, saved, strict=True):
            if entry["name"] != name or entry["columns"] != list(columns):
                raise ValueError(f"saved state {entry['name']} does not belong to {name}")
            fitted.append((name, encoder.with_document(entry["encoder"]), columns))
        return ColumnEncoders(fitted)

    @staticmethod
    def from_state(saved: list[dict]) -> "ColumnEncoders":
        """Encoders from a saved state alone; those with code of their own need ``with_saved_state``."""
        return ColumnEncoders([(e["name"], from_document(e["encoder"]), e["columns"]) for e in saved])


def from_document(document: dict) -> Encoder:
    if document["type"] == "Sequential":
        return Sequential(tuple(from_document(d) for d in document["steps"]))
    known = {c.__name__: c for c in (Numeric, WordCount, CharCount, StandardScaler, OneHot, WideOneHot, HashedText)}
    if document["type"] not in known:
        raise ValueError(f"the encoder {document['type']} has code of its own: pass the encoders of the run")
    return known[document["type"]](**document["options"]).with_document(document)


def _fit_moments(train: DataFrame, columns: list[Column]) -> list[tuple[float, float]]:
    if not columns:
        return []
    if len(columns) > SCALARS:
        each = train.select(F.posexplode(F.array(*columns)).alias("i", "x")).groupBy("i")
        rows = {r.i: r for r in each.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}
        return [((rows[i].m or 0.0, rows[i].s or 0.0) if i in rows else (0.0, 0.0)) for i in range(len(columns))]
    aggregates = []
    for i, c in enumerate(columns):
        aggregates += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    row = train.agg(*aggregates).first()
    return [(row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i in range(len(columns))]


def _fit_table(train: DataFrame, column: Column, folder: str | None) -> dict:
    """Store the distinct values of a column with their places in sorted order, null last."""
    spark = train.sparkSession
    path = new_folder(spark, "categories") if folder is None else f"{folder}/{uuid.uuid4().hex}"
    values = train.select(column.alias("value")).distinct()
    placed = with_place(values, [F.col("value").isNull(), F.col("value")], "position")
    table = materialise(placed.select(_as_text(F.col("value")).alias("category"), F.col("position").cast("int").alias("position")), "categories", path)
    return {"path": path, "count": table.count()}


def _fit_categories(train: DataFrame, columns: list[Column]) -> list[list[str | None]]:
    """Distinct values per column as text, in the order of the values, null last.

    Duplicates are dropped in each task before the shuffle. What comes to the driver is as large as
    the feature vector is wide, which is also what the model has weights for; more than
    ``MOST_CATEGORIES`` are an error, for ``WideOneHot`` keeps them in a table.
    """
    if not columns:
        return []
    one_of = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), *[
            (c if j == i else F.lit(None)).alias(f"v{j}") for j, c in enumerate(columns)
        ]) for i, c in enumerate(columns)])
    )
    found = train.select(one_of.alias("one")).select("one.*").distinct()
    texts = [_as_text(F.col(f"v{j}")).alias(f"t{j}") for j in range(len(columns))]
    rows = found.select("*", *texts).limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories: use WideOneHot")
    result = []
    for i in range(len(columns)):
        known = {row[f"t{i}"]: row[f"v{i}"] for row in rows if row["i"] == i}
        values = sorted((t for t, v in known.items() if v is not None), key=known.get)
        result.append(values + [None] * (None in known))
    return result


def range_table(spark, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """Ranges grouped by input column, each list in order of the start."""
    df = spark.createDataFrame(ranges, "input_column string, start int, stop int")
    return df.groupBy("input_column").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("ranges"))
