"""Row tables as named sets of Parquet files, with an index from source rows to the files that hold them.

A version of a table is a manifest: which files it consists of. Changing rows replaces the files that
hold some and no others (copy on write); versions share all files that did not change. Which files
those are is looked up in an index: for every provenance column the pairs ``(source row, file)``,
sorted, so that a lookup of a few rows reads a few row groups, and one of many is a join of narrow
tables. Neither the request nor the table limits what this costs beyond the files with hits.

All paths are relative to the folder of the run; ``data/`` holds the rows, ``meta/`` manifests and
indexes. Reading a version hands Spark its list of files, which the driver holds for any scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.functions.naming import PROV_PREFIX
from provspark.operators import frame
from provspark.operators.sizing import BROADCAST_FILES, BROADCAST_ROWS, broadcast_if_small
from provspark.operators.split import SPLIT
from provspark.operators.storage import together

MANIFEST = "table string, part string, file string, rows long"
INDEX = "table string, prov string, id long, file string"
REQUESTS = "prov string, id long, target int"
MOST_INDEXES = 16  # so many indexes, one per version, are looked through before they are written as one
RELATIVE = r"((?:data|meta)/[^/]+/[0-9a-f]{32}/.*)$"


def relative_file() -> F.Column:
    """Path of the file a row comes from, relative to the run."""
    return F.regexp_extract(F.col("_metadata.file_path"), RELATIVE, 1)


@dataclass(frozen=True)
class FileTable:
    """One version of a row table. ``parts``: values of the split, if the table is stored by split."""

    spark: SparkSession
    root: str
    name: str
    schema: T.StructType
    manifest: str
    index: tuple[str, ...]
    parts: tuple[str, ...] = ()

    # --- files ---------------------------------------------------------------------------

    def files(self) -> DataFrame:
        """``(table, part, file, rows)`` of the files this version consists of."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{self.manifest}").where(F.col("table") == self.name)

    def _read(self, files: list) -> DataFrame:
        """Rows of some files; the split of a file is a constant, so asking for one prunes the others."""
        plain = T.StructType([f for f in self.schema.fields if f.name != SPLIT]) if self.parts else self.schema
        out = None
        for part in self.parts or (None,):
            paths = sorted(f"{self.root}/{row.file}" for row in files if part is None or row.part == part)
            if not paths:
                continue
            df = self.spark.read.schema(plain).parquet(*paths)
            if part is not None:
                df = df.withColumn(SPLIT, F.lit(part))
            df = df.select(*self.schema.fieldNames())
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], self.schema) if out is None else out

    def read(self, part: str | None = None) -> DataFrame:
        files = self.files()
        return self._read((files if part is None else files.where(F.col("part") == part)).collect())

    def rows_from(self, prov: str, row_ids) -> DataFrame:
        """Rows that stem from the given source rows; opens only files that hold some."""
        hits = find_hits([self], Requests.of(self.spark, [(prov, row_ids, 0)]))[self.name]
        return hits.rows().where("__targets is not null").drop("__targets")


@dataclass(frozen=True)
class Requests:
    """Source rows and what is asked for them: ``(prov, id, target)``, evaluated once.

    A short request is a list of ``(prov, target, ids)`` that goes into predicates; a longer one is a
    stored table that is joined, by a lookup inside the tasks while that is small enough to be sent there.
    """

    size: int
    literal: tuple[tuple[str, int, tuple[int, ...]], ...] | None = None
    table: DataFrame | None = None

    @staticmethod
    def of(spark: SparkSession, asked: list[tuple]) -> "Requests":
        """``asked`` has tuples of a provenance column, row ids (a list or a one-column table), and a target."""
        asked = [(prov, frame.settled_ids(spark, ids), target) for prov, ids, target in asked]
        short = not any(isinstance(ids, frame.StoredIds) for _, ids, _ in asked)
        if short and sum(len(ids) for _, ids, _ in asked) <= frame.LITERAL_IDS:
            literal = tuple((prov, target, tuple(ids)) for prov, ids, target in asked if ids)
            return Requests(sum(len(ids) for _, _, ids in literal), literal)
        table = None
        for prov, ids, target in asked:
            rows = frame.ids_frame(spark, ids).select(F.lit(prov).alias("prov"), F.col("__id").alias("id"), F.lit(target).alias("target"))
            table = rows if table is None else table.unionByName(rows)
        return Requests(table.count(), table=table)

    @staticmethod
    def of_table(table: DataFrame) -> "Requests":
        """From a stored table ``(prov, id, target)`` of different rows."""
        size = table.count()
        if size > frame.LITERAL_IDS:
            return Requests(size, table=table)
        ids: dict[tuple, list] = {}
        for row in table.collect():
            ids.setdefault((row.prov, row.target), []).append(row.id)
        return Requests(size, tuple((prov, target, tuple(sorted(i))) for (prov, target), i in sorted(ids.items())))

    def in_index(self, index: DataFrame) -> DataFrame:
        """Index rows of the request; a short one reaches the scan of the index, which is sorted."""
        if self.literal is None:
            asked = self.table.select("prov", "id").distinct()
            return index.join(broadcast_if_small(asked, self.size), ["prov", "id"], "left_semi")
        wanted = F.lit(False)
        for prov, _, ids in self.literal:
            wanted = wanted | ((F.col("prov") == prov) & F.col("id").isin(*ids))
        return index.where(wanted)

    def flagged(self, df: DataFrame) -> DataFrame:
        """Add ``__targets``: what is asked for a row, null where nothing is."""
        columns = df.columns
        if self.literal is not None:
            asked = [F.when(F.col(prov).isin(*ids), target) for prov, target, ids in self.literal]
            targets = F.array_compact(F.array_distinct(F.array(*asked))) if asked else F.array().cast("array<int>")
        else:
            flags = [F.array().cast("array<int>")]
            # One lookup per provenance column; there are as many as the run has sources.
            for i, prov in enumerate(c for c in columns if c.startswith(PROV_PREFIX)):
                ids = self.table.where(F.col("prov") == prov).groupBy(F.col("id").alias(f"__id{i}"))
                ids = ids.agg(F.collect_set("target").alias(f"__t{i}"))
                df = df.join(broadcast_if_small(ids, self.size), F.col(prov) == F.col(f"__id{i}"), "left")
                flags.append(F.coalesce(f"__t{i}", flags[0]))
            targets = F.array_distinct(F.concat(*flags))
        return df.select(*columns, F.when(F.size(targets) > 0, targets).alias("__targets"))


def find_hits(tables: list[FileTable], requests: Requests) -> dict[str, "Hits"]:
    """For tables of one version, the files that hold a row of the request: one lookup for all of them."""
    first = tables[0]
    files = {t.name: [] for t in tables}
    if requests.size:
        index = first.spark.read.schema(INDEX).parquet(*[f"{first.root}/{i}" for i in first.index])
        index = requests.in_index(index.where(F.col("table").isin(*files))).select("file").distinct()
        manifest = first.spark.read.schema(MANIFEST).parquet(f"{first.root}/{first.manifest}")
        for row in manifest.join(index, "file", "left_semi").collect():
            files[row.table].append(row)
    return {t.name: Hits(t, requests, files[t.name]) for t in tables}


@dataclass(frozen=True)
class Hits:
    """The files of a table that a request concerns."""

    table: FileTable
    requests: Requests
    files: list

    def rows(self) -> DataFrame:
        """All rows of these files; ``__targets`` says what is asked for, null where nothing is."""
        return self.requests.flagged(self.table._read(self.files))

    def replaced(self, change: Callable[[DataFrame], DataFrame]) -> "Written | None":
        """Write these files anew with the rows that ``change`` makes of theirs."""
        if not self.files:
            return None
        changed = change(self.rows()).drop("__targets")
        return write_files(changed, self.table.root, self.table.name, self.table.parts)


@dataclass(frozen=True)
class Written:
    """Files written for a table."""

    folder: str
    schema: T.StructType


def write_files(df: DataFrame, root: str, name: str, parts: tuple[str, ...] = (), cluster_by: str | None = None) -> Written:
    """Store rows below ``data/``; ``cluster_by`` brings the rows of a source row into one file."""
    folder = f"data/{name}/{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    if cluster_by is not None:
        df = df.repartition(F.col(cluster_by))
    writer = df.write.partitionBy(SPLIT) if parts else df.write
    writer.parquet(f"{root}/{folder}")
    return Written(folder, schema)


def _listed(spark: SparkSession, root: str, written: dict[str, Written], parts: dict[str, tuple]) -> tuple[list, DataFrame, list]:
    """Files just written, one ``(table, part, file, rows)`` each; index pairs ``(kind, id, place)``; the kinds.

    Reads the provenance columns only. The pairs are numbers until they are sorted: ``kind`` is the place of
    ``(table, prov)`` among the sorted kinds, ``place`` a hash of the file's path. ``_named`` puts the names back.
    """
    path, counts, pairs = F.col("_metadata.file_path"), None, None
    tables = {}
    for name, w in written.items():
        plain = T.StructType([f for f in w.schema.fields if not (parts[name] and f.name == SPLIT)])
        rows = spark.read.schema(plain).option("recursiveFileLookup", True).parquet(f"{root}/{w.folder}")
        tables[name] = rows, [c for c in plain.fieldNames() if c.startswith(PROV_PREFIX)]
    kinds = sorted((name, c) for name, (_, provs) in tables.items() for c in provs)
    for name, (rows, provs) in tables.items():
        counted = rows.groupBy(path.alias("path")).agg(F.count("*").alias("rows"))
        counted = counted.select(F.lit(name).alias("table"), F.regexp_extract("path", RELATIVE, 1).alias("file"), "rows", F.xxhash64("path").alias("place"))
        part = F.regexp_extract("file", f"/{SPLIT}=([^/]+)/", 1) if parts[name] else F.lit("")
        counted = counted.select("table", part.alias("part"), "file", "rows", "place")
        counts = counted if counts is None else counts.unionByName(counted)
        ids = F.array(*[F.struct(F.lit(kinds.index((name, c))).alias("kind"), F.col(c).alias("id")) for c in provs])
        found = rows.select(F.inline(ids), F.xxhash64(path).alias("place")).where("id is not null").distinct()
        pairs = found if pairs is None else pairs.unionByName(found)
    # One row per file, as the driver collects them whenever a table is read.
    files = counts.collect()
    if len({f.place for f in files}) < len(files):
        raise ValueError("two files have the same hash")
    return files, pairs, kinds


def _named(pairs: DataFrame, files: list, kinds: list) -> DataFrame:
    """Index rows ``(table, prov, id, file)``, in the order of the pairs."""
    spark = pairs.sparkSession
    places = spark.createDataFrame([(f.place, f.file) for f in files], "place long, file string")
    table, prov = (F.get(F.array(*[F.lit(k[i]) for k in kinds]), F.col("kind")) for i in (0, 1))
    pairs = pairs.join(broadcast_if_small(places, len(files), BROADCAST_FILES), "place")
    return pairs.select(table.alias("table"), prov.alias("prov"), "id", "file")


def commit_files(
    spark: SparkSession, root: str, tables: dict[str, FileTable | None], written: dict[str, Written | None],
    replaced: dict[str, list], parts: dict[str, tuple], whole: bool = False,
) -> dict[str, FileTable]:
    """Manifest and index of the next version of all tables.

    ``replaced[name]`` are the files of the version before that the written ones stand for; ``whole`` says
    that these are all of them.
    """
    written = {name: w for name, w in written.items() if w is not None}
    before = next((t for t in tables.values() if t is not None), None)
    manifest, index = f"meta/manifest/{uuid.uuid4().hex}", f"meta/index/{uuid.uuid4().hex}"
    old, gone = None, [row for files in replaced.values() for row in files]
    if before is not None:
        old = spark.read.schema(MANIFEST).parquet(f"{root}/{before.manifest}")
        names = [row.file for row in gone]
        if len(names) <= frame.LITERAL_IDS:
            old = old.where(~F.col("file").isin(*names)) if names else old
        else:
            named = spark.createDataFrame([(f,) for f in names], "file string")
            old = old.join(broadcast_if_small(named, len(names)), "file", "left_anti").select("table", "part", "file", "rows")
    actions, kept = [], () if before is None or whole else before.index
    if written:
        found, pairs, kinds = _listed(spark, root, written, parts)
        new = spark.createDataFrame([(f.table, f.part, f.file, f.rows) for f in found], MANIFEST)
        files = new if old is None else old.unionByName(new)
        order = ["kind", "id"]
        # Sorted as a whole; what was few rows before is one task, without sampling for ranges.
        few = before is not None and sum(row.rows for row in gone) <= BROADCAST_ROWS
        if len(kept) >= MOST_INDEXES:
            former = spark.read.schema(INDEX).parquet(*[f"{root}/{i}" for i in kept])
            live = broadcast_if_small(old.select("file"))
            pairs = _named(pairs, found, kinds)
            pairs = pairs.unionByName(former.join(live, "file", "left_semi").select(*pairs.columns))
            kept, few, order = (), False, ["table", "prov", "id"]
        pairs = (pairs.coalesce(1) if few else pairs.repartitionByRange(*order)).sortWithinPartitions(*order)
        if order[0] == "kind":
            pairs = _named(pairs, found, kinds)
        actions.append(lambda: pairs.write.parquet(f"{root}/{index}"))
    else:
        files = old
    actions.append(lambda: files.coalesce(1).write.parquet(f"{root}/{manifest}"))
    together(*actions)
    indexes = (*kept, *([index] if written else ()))
    out = {}
    for name, table in tables.items():
        if table is None:
            table = FileTable(spark, root, name, written[name].schema, manifest, indexes, parts[name])
        out[name] = replace(table, manifest=manifest, index=indexes)
    return out
