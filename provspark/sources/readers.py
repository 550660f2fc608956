"""Tracked scans: every row gets its position in the source as row provenance.

Row ids are ``(ordinal of the file << 40) + position in the file``; for a source of one file that is
simply the 0-based position. Files are numbered in path order, or, with a registry, in the order in
which they were first seen: a file that comes later, wherever it sorts, moves no id (``file_registry``).

* Parquet knows the position (``_metadata.row_index``), so ids cost nothing and filters are
  still pushed down.
* Delimited text does not. It is parsed once and landed as Parquet together with the input
  split each record came from; one count per split then turns the order inside a split into
  the position in the file. Later actions read the Parquet copy, never the text again.
* Quoted fields may hold line breaks, and files stay splittable all the same: whether a line begins
  inside quotes depends on all lines before it, so every split is read under both assumptions at once,
  and a prefix pass over the splits, a row each, says which one holds. Lines are then put together to
  records, also across splits; only lines of records over several lines are shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.functions.naming import normalise_path, prov_column, source_name
from provspark.operators.frame import TrackedFrame
from provspark.operators.sizing import BROADCAST_FILES, broadcast_if_small
from provspark.operators.storage import create_exclusive, delete_folder, materialise, new_folder

# Tokens read as null by default: the public default list of pandas' CSV reader (fixed values).
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

EXTRA = "__extra_field"
FILE_BITS = 40  # positions below, file ordinals above

_LEFT_OUT: ContextVar[dict] = ContextVar("left_out", default={})


@contextmanager
def scans_without(alias: str, row_ids):
    """Within this block, tracked scans of the source leave the given rows out; the others keep their ids.

    Gives a list that holds the alias once for each scan that did.
    """
    met: list[str] = []
    token = _LEFT_OUT.set({**_LEFT_OUT.get(), alias: (row_ids, met)})
    try:
        yield met
    finally:
        _LEFT_OUT.reset(token)


def _scan(df: DataFrame, alias: str, columns: list[str]) -> TrackedFrame:
    frame = TrackedFrame(df, (prov_column(alias),), {c: frozenset({f"{alias}.{c}"}) for c in columns})
    if alias not in _LEFT_OUT.get():
        return frame
    row_ids, met = _LEFT_OUT.get()[alias]
    met.append(alias)
    return frame.not_originating_from(alias, row_ids)


def track(df: DataFrame, alias: str, row_id: Column) -> TrackedFrame:
    """Tracked frame over a table that already carries its own row ids."""
    prov = prov_column(alias)
    return _scan(df.withColumn(prov, row_id.cast("long")), alias, df.columns)


_REGISTRY: ContextVar[str | None] = ContextVar("registry", default=None)


@contextmanager
def file_registry(folder: str):
    """Within this block, scans number the files of each source as the registry in ``folder`` has them.

    A source's files keep their numbers for good; new ones get the next numbers, in path order.
    """
    token = _REGISTRY.set(folder)
    try:
        yield
    finally:
        _REGISTRY.reset(token)


def registered_files(spark: SparkSession, folder: str, source: str, files: list[str]) -> dict[str, int]:
    """Ordinals of the files of a source; files that are not in the registry yet are appended to it.

    The registry is a folder of numbered lists that are only ever added, each created exclusively: of two
    scans that meet new files at the same time one appends first, and the other reads what it wrote.
    """
    where = f"{folder}/{source}"
    while True:
        try:
            found = [json.loads(r[0]) for r in spark.read.text(where, wholetext=True).collect()]
        except AnalysisException:
            found = []
        known = [name for entry in sorted(found, key=lambda e: e["number"]) for name in entry["files"]]
        fresh = sorted(set(files) - set(known))
        if not fresh:
            return {name: i for i, name in enumerate(known)}
        number = 1 + max((e["number"] for e in found), default=-1)
        if create_exclusive(spark, f"{where}/{number}.json", json.dumps({"number": number, "files": fresh})):
            return {name: i for i, name in enumerate(known + fresh)}


def _source(alias: str, path: str) -> str:
    """A source in the registry: the same alias on another path is another source."""
    return f"{alias}-{source_name(path)}"


def _with_file_ordinal(df: DataFrame, path_column: str, files: list[str], source: str) -> tuple[DataFrame, Column]:
    """Join the ordinal of the file on, by a hash of its path; no join for a source of one file."""
    spark = df.sparkSession
    # The listing is what the driver already holds to plan the scan.
    listing = sorted({re.sub(r"^file:/+", "file:/", f) for f in files})
    if _REGISTRY.get() is not None:
        ordinals = registered_files(spark, _REGISTRY.get(), source, listing)
    else:
        ordinals = {f: i for i, f in enumerate(listing)}
    if len(listing) <= 1:
        return df, F.lit(ordinals[listing[0]] if listing else 0).cast("long")
    rows = spark.createDataFrame([(f, ordinals[f]) for f in listing], "__file string, __ordinal long")
    rows = rows.select(F.xxhash64("__file").alias("__file"), "__ordinal")
    if rows.groupBy("__file").count().where("count > 1").count():
        raise ValueError("two files of the source have the same hash")
    joined = df.join(
        broadcast_if_small(rows, len(listing), BROADCAST_FILES), F.xxhash64(path_column) == F.col("__file"), "left"
    ).drop("__file")
    missing = F.raise_error(F.concat(F.lit("file not in listing: "), F.col(path_column)))
    return joined, F.coalesce(F.col("__ordinal"), missing.cast("long"))


def read_parquet(spark: SparkSession, path: str, alias: str | None = None) -> TrackedFrame:
    """Tracked scan of a Parquet file or directory."""
    alias = alias or source_name(path)
    raw = spark.read.parquet(path)
    columns = raw.columns
    prov = prov_column(alias)
    df = raw.select(
        *columns,
        F.col("_metadata.row_index").alias(prov),
        F.col("_metadata.file_path").alias("__path"),
    )
    df, ordinal = _with_file_ordinal(df, "__path", raw.inputFiles(), _source(alias, path))
    position = F.col(prov) + F.shiftleft(ordinal, FILE_BITS)
    df = df.select(*columns, position.alias(prov))
    return _scan(df, alias, columns)


def _positions(raw: DataFrame, values: list[Column], files: list[str], alias: str, source: str, land: str | None) -> DataFrame:
    """Land parsed records and add their position; ``raw`` is a scan of splittable text."""
    path, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    landed = materialise(
        raw.select(
            *values,
            path.alias("__path"),
            start.alias("__start"),
            F.xxhash64(path, start).alias("__split"),
            # Increases in record order inside a split; comes from the one pass that lands
            # the rows, so it cannot disagree with another reading of the text.
            F.monotonically_increasing_id().alias("__order"),
        ),
        "landed",
        land,
    )
    names = [c for c in landed.columns if c not in ("__path", "__start", "__split", "__order")]
    # One row per input split: bounded by the splits the driver schedules, not by the records.
    splits = landed.groupBy("__split", "__path", "__start").agg(
        F.min("__order").alias("__first"), F.count("*").alias("__n")
    )
    splits, ordinal = _with_file_ordinal(splits, "__path", files, source)
    before = Window.partitionBy("__path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    same_hash = F.count("*").over(Window.partitionBy("__split"))
    shift = F.when(same_hash == 1, shift + F.shiftleft(ordinal, FILE_BITS)).otherwise(
        F.raise_error(F.lit("two input splits have the same hash")).cast("long")
    )
    splits = materialise(splits.select(F.col("__split").alias("__key"), shift.alias("__shift")), "splits")
    df = landed.join(broadcast_if_small(splits, limit=BROADCAST_FILES), F.col("__split") == F.col("__key"))
    return df.select(*names, (F.col("__order") + F.col("__shift")).alias(prov_column(alias)))


# --- quoted records over several lines and splits -------------------------------------------------

def _ends_in_quotes(line: Column, sep: str, begins_in_quotes: bool) -> Column:
    """Whether a line ends inside a quoted field, from whether it begins inside one.

    Goes from quote to quote. States: 0 in a plain field, 1 in quotes, 2 after a quote that ended them (or is
    the first of a doubled one), 3 at the start of a record. A quote opens a field only at its start.
    """
    parts = F.split(line, '"', -1)

    def step(state: Column, part: Column) -> Column:
        doubled, starts = (part == "") & state.isin(2, 3), part.endswith(sep)
        return F.when(state == 1, 2).when(doubled | starts, 1).otherwise(0)

    end = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(1 if begins_in_quotes else 3), step)
    return F.when(F.instr(line, '"') == 0, begins_in_quotes).otherwise(end == 1)


class Assumption:
    """Lines of a split in order, as they are if it begins inside quotes or not: state, record and place."""

    def __init__(self, quoted: bool):
        self.first = quoted
        self.reset()

    def reset(self) -> None:
        self.state, self.record, self.count = self.first, -1, 0

    def run(self, order: np.ndarray, from_out: np.ndarray, from_in: np.ndarray, blank: np.ndarray) -> list[np.ndarray]:
        """Whether each line begins in quotes, the order of its record's first line (-1: before the split), records so far, and whether it ends in quotes."""
        n = np.arange(len(order))
        # A line either sets the state, whatever it was, or turns it, or leaves it.
        swaps = np.cumsum(from_out & ~from_in)
        setter = np.maximum.accumulate(np.where(from_out == from_in, n, -1))
        at = np.maximum(setter, 0)
        end = np.where(setter >= 0, from_out[at] ^ ((swaps - swaps[at]) % 2 == 1), self.state ^ (swaps % 2 == 1))
        begin = np.concatenate(([self.state], end[:-1]))
        starts = ~begin & ~blank
        latest = np.maximum.accumulate(np.where(starts, n, -1))
        record = np.where(latest >= 0, order[np.maximum(latest, 0)], self.record)
        count = self.count + np.cumsum(starts)
        self.state, self.record, self.count = bool(end[-1]), int(record[-1]), int(count[-1])
        return [begin, record, count, end]


_SIDE = "begins: boolean, record: long, count: long, ends: boolean"
_LINE_STATES = f"struct<plain: struct<{_SIDE}>, quoted: struct<{_SIDE}>>"


def _line_states(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    sides, current = (Assumption(False), Assumption(True)), None
    for split, *columns in batches:
        split = split.to_numpy()
        order, *flags = (c.to_numpy(zero_copy_only=False) for c in columns)
        cuts = np.flatnonzero(np.diff(split)) + 1
        out = [[], []]
        for low, high in zip([0, *cuts], [*cuts, len(split)]):
            if low == high:
                continue
            if split[low] != current:
                current = split[low]
                for side in sides:
                    side.reset()
            for k, side in enumerate(sides):
                out[k].append(side.run(order[low:high], *(f[low:high] for f in flags)))
        arrays = []
        for parts in out:
            fields = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, bool), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)]
            arrays.append(pa.StructArray.from_arrays([pa.array(f) for f in fields], ["begins", "record", "count", "ends"]))
        yield pa.StructArray.from_arrays(arrays, ["plain", "quoted"])


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _records(spark: SparkSession, path: str, sep: str, header: bool, alias: str, one_file: bool = False) -> tuple[DataFrame, str, list[str]]:
    """``(__record, __path, __position)`` of all records of delimited text, and the folder that holds its lines.

    With ``one_file``, the files of a folder are one: the path is the folder's, and positions run on through its files.
    """
    raw = spark.read.text(path, lineSep="\n")
    file, start, line = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("value")
    lines = raw.select(
        line.alias("__line"), file.alias("__path"), start.alias("__start"), F.xxhash64(file, start).alias("__split"),
        F.monotonically_increasing_id().alias("__order"),
    )
    plain, quoted = (_ends_in_quotes(F.col("__line"), sep, q) for q in (False, True))
    blank = F.btrim(F.col("__line"), F.lit(" \t\r\x0b\x0c")) == ""
    states = F.arrow_udf(_line_states, _LINE_STATES)("__split", "__order", plain, quoted, blank)
    folder = new_folder(spark, "lines")
    lines = materialise(lines.withColumn("__s", states), "lines", folder)

    last = F.max_by(F.struct("__s.plain", "__s.quoted"), "__order")
    open_lines = [F.max(f"__s.{side}.ends").alias(f"__open_{side}") for side in ("plain", "quoted")]
    splits = lines.groupBy("__split", "__path", "__start").agg(last.alias("__end"), *open_lines)
    by_file = Window.partitionBy("__path").orderBy("__start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    end_plain, end_quoted = F.col("__end.plain.ends"), F.col("__end.quoted.ends")
    turns = F.sum(F.when(end_plain & ~end_quoted, 1).otherwise(0)).over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    splits = splits.withColumn("__turns", turns)
    sets = F.when(end_plain == end_quoted, F.struct(end_plain.alias("value"), "__turns"))

    def state(frame) -> Column:
        setter = F.last(sets, ignorenulls=True).over(frame)
        turned = F.coalesce(F.max("__turns").over(frame), F.lit(0)) - F.coalesce(setter["__turns"], F.lit(0))
        return (F.coalesce(setter.value.cast("int"), F.lit(0)) + turned) % 2 == 1

    splits = splits.withColumns({"__in": state(before), "__out": state(by_file.rowsBetween(Window.unboundedPreceding, 0))})
    held = F.when(F.col("__in"), F.col("__end.quoted")).otherwise(F.col("__end.plain"))
    splits = splits.withColumns({"__open": F.when(held.record >= 0, held.record), "__n": held["count"]})
    ahead = Window.partitionBy(_folder(F.col("__path"))).orderBy("__path", "__start").rowsBetween(Window.unboundedPreceding, -1) if one_file else before
    splits = splits.withColumns({
        "__open": F.last("__open", ignorenulls=True).over(before), "__before": F.coalesce(F.sum("__n").over(ahead), F.lit(0)),
        "__same": F.count("*").over(Window.partitionBy("__split")), "__last": F.lead("__start").over(by_file).isNull(),
        "__several": F.col("__in") | F.when(F.col("__in"), F.col("__open_quoted")).otherwise(F.col("__open_plain")),
    })
    splits = splits.select(F.col("__split").alias("__key"), "__path", "__in", "__out", "__open", "__before", "__same", "__last", "__several")
    splits = materialise(splits, "splits")
    unclosed = F.min(F.when(F.col("__last") & F.col("__out"), F.col("__path")))
    count, same, unclosed, any_several = splits.agg(F.count("*"), F.max("__same"), unclosed, F.max("__several")).first()
    if (same or 0) > 1 or unclosed is not None:
        raise ValueError("two input splits have the same hash" if unclosed is None else f"{unclosed} ends inside a quoted field")

    small = broadcast_if_small(splits.select("__key", "__in", "__open", "__before"), count, BROADCAST_FILES)
    lines = lines.join(small, F.col("__split") == F.col("__key"))
    side = F.when(F.col("__in"), F.col("__s.quoted")).otherwise(F.col("__s.plain"))
    lines = lines.select("__line", "__path", "__start", "__order", "__open", "__before", side.alias("__s"))
    place = F.col("__before") + F.col("__s.count") - 1
    whole = lines.where(~F.col("__s.begins") & ~F.col("__s.ends") & (F.btrim(F.col("__line"), F.lit(" \t\r\x0b\x0c")) != ""))
    records = whole.select(F.col("__line").alias("__record"), "__path", place.alias("__position"))
    parts = lines.where(F.col("__s.begins") | F.col("__s.ends"))
    number = F.when(F.col("__s.record") >= 0, F.col("__s.record")).otherwise(F.col("__open"))
    first = F.max(F.when(~F.col("__s.begins"), place))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__start", "__order", "__line"))), lambda x: x["__line"]), "\n")
    several = parts.groupBy(number.alias("__number"), "__path").agg(text.alias("__record"), first.alias("__position"))
    if any_several:
        records = records.unionByName(several.select("__record", "__path", "__position"))
    records = records.withColumn("__record", F.regexp_replace("__record", r"\r\z", ""))
    if header:
        records = records.where("__position > 0").withColumn("__position", F.col("__position") - 1)
    files = raw.inputFiles()
    if one_file:
        records, files = records.withColumn("__path", _folder(F.col("__path"))), [f.rsplit("/", 1)[0] for f in files]
    return records, folder, files


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | list[str],
    header: bool = False,
    sep: str = ",",
    na_values=NA_VALUES,
    alias: str | None = None,
    land: str | None = None,
    parts: bool = False,
) -> TrackedFrame:
    """Tracked scan of a delimited file.

    ``schema`` is a Spark schema, a DDL string, or a list of names (all read as strings).
    Values in ``na_values`` become null; pass ``()`` to keep them. A value that does not fit
    its type raises, and so does a record with more fields than the schema; missing fields are
    null. Records end at a line break that is not inside quotes; quotes inside a field are doubled, and
    a file that ends inside quotes raises. Blank lines between records are no records.
    ``land`` is the folder for the Parquet copy (default: the shared folder).
    With ``parts``, the files of a folder are one source file in parts, in the order of their names, as
    Spark writes them: they share an ordinal, and positions run on. Parts have no header.
    """
    if parts and header:
        raise ValueError("parts have no header")
    alias = alias or source_name(path)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if isinstance(schema, list):
        schema = T.StructType([T.StructField(name, T.StringType()) for name in schema])
    as_text = T.StructType([T.StructField(n, T.StringType()) for n in [*schema.fieldNames(), EXTRA]])
    records, folder, files = _records(spark, path, sep, header, alias, parts)
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "", "maxCharsPerColumn": "-1"}
    fields = F.from_csv("__record", as_text.simpleString()[len("struct<"):-1].replace(":", " "), options)
    values = []
    for field in schema.fields:
        value = F.col(f"`{field.name}`")
        if na_values:
            value = F.when(~value.isin(list(na_values)), value)
        else:
            value = F.coalesce(value, F.lit(""))
        values.append(value.cast(field.dataType).alias(field.name))
    message = F.concat(F.lit(f"a record has more than {len(schema)} fields, from: "), F.col(EXTRA))
    first = schema.fields[0]
    surplus = F.when(F.col(EXTRA).isNotNull(), F.raise_error(message).cast(first.dataType))
    values[0] = F.coalesce(surplus, values[0]).alias(first.name)
    prov = prov_column(alias)
    records, ordinal = _with_file_ordinal(records, "__path", files, _source(alias, path))
    position = F.col("__position") + F.shiftleft(ordinal, FILE_BITS)
    df = materialise(records.select(fields.alias("__fields"), position.alias(prov)).select("__fields.*", prov).select(*values, prov), "landed", land)
    delete_folder(spark, folder)
    return _scan(df, alias, schema.fieldNames())


def read_lines(
    spark: SparkSession,
    path: str,
    names: list[str],
    sep: str = ",",
    alias: str | None = None,
    land: str | None = None,
) -> TrackedFrame:
    """Tracked scan of plain lines, trimmed and split at every separator (no quoting).

    Lines with another number of fields keep what they have, are flagged in ``_field_count_error``
    and stand whole in ``_line``, so that nothing is lost.
    """
    alias = alias or source_name(path)
    raw = spark.read.text(path)
    parts = F.split(F.btrim(F.col("value"), F.lit(" \t\r\n\x0b\x0c")), "\\Q" + sep + "\\E", -1)
    wrong = F.size(parts) != len(names)
    values = [F.get(parts, i).alias(name) for i, name in enumerate(names)]
    values += [wrong.alias("_field_count_error"), F.when(wrong, F.col("value")).alias("_line")]
    df = _positions(raw, values, raw.inputFiles(), alias, _source(alias, path), land)
    return _scan(df, alias, [*names, "_field_count_error", "_line"])


# --- tab-separated intermediates -------------------------------------------------------

def _escaped(column: Column) -> Column:
    text = column.cast("string")
    for raw, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return F.coalesce(text, F.lit("\\N"))


def _unescaped(text: Column) -> Column:
    # Between escaped backslashes there are no others, so each piece can be restored by itself.
    pieces = F.split(F.when(text != F.lit("\\N"), text), r"\\\\", -1)

    def restored(piece: Column) -> Column:
        for code, raw in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            piece = F.replace(piece, F.lit(code), F.lit(raw))
        return piece

    return F.array_join(F.transform(pieces, restored), "\\")


def write_tsv(df: DataFrame, path: str) -> None:
    """One line per row; tabs and line breaks are escaped, null is ``\\N``."""
    df.select(F.concat_ws("\t", *[_escaped(F.col(f"`{c}`")) for c in df.columns])).write.text(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read what ``write_tsv`` wrote."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    parts = F.split(F.col("value"), "\t", -1)
    return spark.read.option("lineSep", "\n").text(path).select(
        *[_unescaped(F.get(parts, i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    )


__all__ = [
    "NA_VALUES", "normalise_path", "read_csv", "read_lines", "read_parquet", "read_tsv", "track",
    "write_tsv",
]
