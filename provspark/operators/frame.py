"""Tracked frames: DataFrames with row and column provenance.

Row provenance is physical: one long column per source, carried through every operator.
Column provenance is a small map on the driver, ``output column -> {"source.column"}``.
Every operator returns a new, lazy frame; Catalyst sees one ordinary plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.functions.naming import POS_PREFIX, PROV_PREFIX, SAMPLE_ID, sample_id
from provspark.operators.sizing import broadcast_if_small
from provspark.operators.storage import materialise


LITERAL_IDS = 1000  # up to here a list of row ids is written into the predicate itself


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _folder(df: DataFrame):
    """How names are compared: Spark ignores case unless the session says otherwise."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    return (lambda name: name) if sensitive else str.lower


def _referenced(df: DataFrame, value: Column) -> set[str]:
    """Names of the columns of ``df`` that an expression reads."""
    found = df.select(value)._jdf.queryExecution().analyzed().references().toSeq()
    return {found.apply(i).name() for i in range(found.size())}


def _names(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


@dataclass(frozen=True)
class TrackedFrame:
    df: DataFrame
    prov_cols: tuple[str, ...]
    col_prov: dict[str, frozenset[str]]
    pos_cols: tuple[str, ...] = field(default=())
    # All columns of the sources as "source.column", also those that were projected away.
    sources: frozenset[str] = frozenset()

    def __post_init__(self):
        object.__setattr__(self, "sources", self.sources.union(*self.col_prov.values()))

    # --- views -------------------------------------------------------------------------

    @property
    def key_cols(self) -> tuple[str, ...]:
        """The columns that identify a row: its source rows and explode ordinals."""
        return self.prov_cols + self.pos_cols

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.key_cols]

    def data(self) -> DataFrame:
        """Without provenance."""
        return self.df.drop(*self.key_cols)

    def provenance(self) -> DataFrame:
        """Only provenance."""
        return self.df.select(*self.key_cols)

    def with_sample_id(self) -> DataFrame:
        """All columns with the key of each row in front."""
        return self.df.select(sample_id(self.key_cols).alias(SAMPLE_ID), "*")

    def count(self) -> int:
        return self.df.count()

    def __len__(self) -> int:
        return self.count()

    # --- filter ------------------------------------------------------------------------

    def filter(self, predicate: Column | str | Callable, columns=None, **params) -> "TrackedFrame":
        """Keep rows by a Column, an SQL string, or a Python predicate over ``columns``.

        Named markers in an SQL string are bound from keyword arguments:
        ``frame.filter("array_contains(:wanted, country)", wanted=["UK", "DE"])``.
        """
        if callable(predicate) and not isinstance(predicate, Column):
            if not columns:
                raise ValueError("a Python predicate needs the columns it reads")
            test = F.pandas_udf(predicate, "boolean")(*[_quoted(c) for c in columns])
            return replace(self, df=self.df.filter(test))
        if params:
            bound = self.df.sparkSession.sql(
                f"SELECT * FROM {{frame}} WHERE {predicate}", args=params, frame=self.df
            )
            return replace(self, df=bound)
        return replace(self, df=self.df.filter(predicate))

    # --- projections -------------------------------------------------------------------

    def project(self, target_column: str, source_columns: list[str], func, returns=None) -> "TrackedFrame":
        """Add or overwrite one computed column.

        ``func`` is a Column, an SQL expression, a pandas UDF, or a Python function of one
        pandas Series per source column (then ``returns`` names the type). Its provenance is
        the union of the provenance of the source columns.
        """
        if target_column in self.key_cols:
            raise ValueError(f"{target_column} is a provenance column")
        if isinstance(func, Column):
            value = func
        elif isinstance(func, str):
            value = F.expr(func)
        else:
            if not hasattr(func, "returnType"):
                if returns is None:
                    raise ValueError("a Python function needs its return type")
                func = F.pandas_udf(func, returns)
            value = func(*[_quoted(c) for c in source_columns])
        origin = frozenset().union(*[self.col_prov[c] for c in source_columns])
        undeclared = _referenced(self.df, value) - set(source_columns)
        if undeclared:
            raise ValueError(f"{target_column} reads columns that are not declared: {sorted(undeclared)}")
        return replace(
            self,
            df=self.df.withColumn(target_column, value),
            col_prov={**self.col_prov, target_column: origin},
        )

    def select(self, *columns: str) -> "TrackedFrame":
        """Keep the named columns and all provenance."""
        return replace(
            self,
            df=self.df.select(*[_quoted(c) for c in columns], *self.key_cols),
            col_prov={c: self.col_prov[c] for c in columns},
        )

    def __getitem__(self, columns) -> "TrackedFrame":
        return self.select(*_names(columns))

    def rename(self, columns: dict[str, str]) -> "TrackedFrame":
        targets = [columns.get(c, c) for c in self.df.columns]
        if len(set(map(_folder(self.df), targets))) != len(targets):
            raise ValueError("rename would produce duplicate column names")
        return replace(
            self,
            df=self.df.select(*[_quoted(c).alias(t) for c, t in zip(self.df.columns, targets)]),
            col_prov={columns.get(c, c): origin for c, origin in self.col_prov.items()},
        )

    def explode(self, target_column: str, source_columns: list[str], array: Column | str) -> "TrackedFrame":
        """One row per array element; the ordinal joins the row key, so keys stay unique."""
        position = f"{POS_PREFIX}{len(self.pos_cols)}"
        array = F.expr(array) if isinstance(array, str) else array
        origin = frozenset().union(*[self.col_prov[c] for c in source_columns])
        kept = [_quoted(c) for c in self.columns if c != target_column]
        # The outer form, because the optimizer would evaluate the array of the inner form twice:
        # once more in a filter for empty arrays. Those rows are dropped here instead.
        pieces = F.posexplode_outer(array).alias(position, target_column)
        df = self.df.select(*kept, *self.key_cols, pieces).where(F.col(position).isNotNull())
        return replace(
            self,
            df=df.withColumn(position, F.col(position).cast("long")),
            col_prov={**self.col_prov, target_column: origin},
            pos_cols=self.pos_cols + (position,),
        )

    # --- joins -------------------------------------------------------------------------

    def _without_collisions(self, other: "TrackedFrame") -> tuple["TrackedFrame", dict[str, str]]:
        """Give the columns of ``other`` that this frame has too the suffix ``_r``.

        A source that is already in this frame becomes a second instance with an alias of its
        own, also in the column provenance: ``people.email`` turns into ``people_r.email``.
        """
        same = _folder(self.df)
        taken = set(map(same, self.df.columns))
        renamed = {}
        for c in other.df.columns:
            new = c
            while same(new) in taken:
                new += "_r"
            taken.add(same(new))
            renamed[c] = new
        alias = {c[len(PROV_PREFIX):]: renamed[c][len(PROV_PREFIX):] for c in other.prov_cols}

        def instance(source: str) -> str:
            name = next(a for a in sorted(alias, key=len, reverse=True) if source.startswith(f"{a}."))
            return alias[name] + source[len(name):]

        return (
            TrackedFrame(
                other.df.select(*[_quoted(c).alias(new) for c, new in renamed.items()]),
                tuple(renamed[c] for c in other.prov_cols),
                {renamed[c]: frozenset(map(instance, origin)) for c, origin in other.col_prov.items()},
                tuple(renamed[c] for c in other.pos_cols),
                frozenset(map(instance, other.sources)),
            ),
            renamed,
        )

    def join(
        self,
        other: "TrackedFrame",
        left_on: str | list[str],
        right_on: str | list[str],
        null_safe: bool = False,
        salt: int = 1,
    ) -> "TrackedFrame":
        """Inner equi-join that carries the provenance of both sides.

        Keys of different names are both kept, keys of the same name once.
        Spark picks the strategy from the sizes and splits hot keys at run time. ``salt``
        spreads every key of the left side over that many tasks from the start (the right
        side is repeated ``salt`` times and never broadcast), for keys known to hold a large part of the rows.
        ``null_safe`` matches null with null.
        """
        left_on, right_on = _names(left_on), _names(right_on)
        right, renamed = self._without_collisions(other)
        left_df, right_df = self.df, right.df
        on, twice = F.lit(True), []
        for left_key, right_key in zip(left_on, right_on, strict=True):
            a, b = _quoted(left_key), _quoted(renamed[right_key])
            on = on & (a.eqNullSafe(b) if null_safe else a == b)
            if left_key == right_key:
                twice.append((left_key, renamed[right_key]))
        if salt > 1:
            spread = F.pmod(F.xxhash64(*self.key_cols), F.lit(salt)).cast("int")
            left_df = left_df.withColumn("__salt_l", spread)
            copies = F.explode(F.array(*[F.lit(i) for i in range(salt)]))
            # By a shuffle: Spark would take the copies for as small as one of them, and every task would hold them all.
            right_df = right_df.withColumn("__salt_r", copies).hint("merge")
            on = on & (F.col("__salt_l") == F.col("__salt_r"))
        joined = left_df.join(right_df, on, "inner").drop("__salt_l", "__salt_r")
        col_prov = {**self.col_prov, **right.col_prov}
        for kept, copy in twice:
            col_prov[kept] = col_prov[kept] | col_prov.pop(copy)
        return TrackedFrame(
            joined.drop(*[copy for _, copy in twice]),
            self.prov_cols + right.prov_cols,
            col_prov,
            self.pos_cols + right.pos_cols,
            self.sources | right.sources,
        )

    def join_latest(self, other: "TrackedFrame", left_on, right_on) -> "TrackedFrame":
        """Inner join with the last row per key of ``other`` (a lookup that is overwritten)."""
        return self.join(other.latest_by(right_on), left_on, right_on)

    def latest_by(self, key: str | list[str]) -> "TrackedFrame":
        """The last row per key in source order.

        Only keys and row ids are aggregated (combined before the shuffle); the wide rows are then
        looked up by the row ids found.
        """
        ids = [_quoted(c) for c in self.key_cols]
        last = F.max(ids[0]) if len(ids) == 1 else F.max(F.struct(*ids))
        found = self.df.groupBy(*[_quoted(c) for c in _names(key)]).agg(last.alias("__last")).select("__last")
        row = ids[0] if len(ids) == 1 else F.struct(*ids)
        return replace(self, df=self.df.join(found, row == F.col("__last"), "left_semi"))

    # --- selection by source row -------------------------------------------------------

    def originating_from(self, alias: str, row_ids) -> "TrackedFrame":
        """Rows that stem from the given source rows."""
        return replace(self, df=by_source_rows(self.df, self.prov_of(alias), row_ids, "left_semi"))

    def not_originating_from(self, alias: str, row_ids) -> "TrackedFrame":
        """Rows that do not stem from the given source rows."""
        return replace(self, df=by_source_rows(self.df, self.prov_of(alias), row_ids, "left_anti"))

    def prov_of(self, alias: str) -> str:
        name = alias if alias.startswith(PROV_PREFIX) else PROV_PREFIX + alias
        if name not in self.prov_cols:
            raise ValueError(f"no provenance of {alias}; known: {self.prov_cols}")
        return name


def join(left: TrackedFrame, right: TrackedFrame, left_on, right_on, **options) -> TrackedFrame:
    """``left.join(right, …)`` as a function."""
    return left.join(right, left_on, right_on, **options)


class StoredIds(NamedTuple):
    """A request that was evaluated: a stored table ``__id`` of different ids, and how many."""

    df: DataFrame
    rows: int


def ids_frame(spark, row_ids) -> DataFrame:
    """Row ids as a one-column table; accepts any iterable of ints, a DataFrame or ``StoredIds``."""
    if isinstance(row_ids, StoredIds):
        return row_ids.df
    if isinstance(row_ids, DataFrame):
        ids = row_ids.select(F.col(f"`{row_ids.columns[0]}`").cast("long").alias("__id"))
        return ids.where("__id IS NOT NULL")
    return spark.createDataFrame([(i,) for i in _settled(row_ids)], "__id long")


def _settled(row_ids) -> list[int]:
    """Different ids in order; a null id names no row."""
    return sorted({int(i) for i in row_ids if i is not None})


def by_source_rows(df: DataFrame, prov: str, row_ids, how: str) -> DataFrame:
    """Semi- or anti-join (``left_semi``, ``left_anti``) with source row ids.

    A request that is a table is evaluated once, here. A short one becomes a predicate that reaches
    the Parquet scan. Otherwise the ids are a table: looked up map-side while they are few, else joined by a shuffle.
    """
    row_ids = settled_ids(df.sparkSession, row_ids)
    if not isinstance(row_ids, StoredIds) and len(row_ids) <= LITERAL_IDS:
        found = F.coalesce(F.col(f"`{prov}`").isin(row_ids), F.lit(False))
        return df.where(found if how == "left_semi" else ~found)
    ids = ids_frame(df.sparkSession, row_ids)
    rows = row_ids.rows if isinstance(row_ids, StoredIds) else len(row_ids)
    return df.join(broadcast_if_small(ids, rows), df[prov] == ids["__id"], how)


def settled_ids(spark, row_ids):
    """Evaluate a request once: a sorted list if it is short, else a stored table of distinct ids."""
    if isinstance(row_ids, StoredIds):
        return row_ids
    if not isinstance(row_ids, DataFrame):
        return _settled(row_ids)
    stored = materialise(ids_frame(spark, row_ids).distinct(), "ids")
    rows = stored.count()
    if rows <= LITERAL_IDS:
        return sorted(row[0] for row in stored.collect())
    return StoredIds(stored, rows)
