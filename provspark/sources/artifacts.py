"""Stored artifacts of a run.

Layout below ``<root>/<pipeline>/<run_id>/``:

=====================  ===================================================================
``data/relational/``   prepared rows: sample_id, split_key, provenance, output columns
``data/matrix/``       by split: sample_id, provenance, features, label
``data/scores/``       test samples: sample_id, provenance, label, prediction
``meta/``              manifests, indexes and weights, see ``sources.tables``
``column_provenance/`` JSON lines (output_column, sources)
``matrix_provenance/`` JSON lines (input_column, start, stop)
``run/``               JSON document: split threshold, encoder states, source paths, …
``versions/…``         one small JSON document per version, ``<branch>/<number>.json``
=====================  ===================================================================

The row tables carry the provenance columns, so no operator has to align one with another.

A version names the files of its tables; a deletion writes the files with affected rows anew, and all
others stay shared. It becomes visible by its document, which is written last and exclusively: of two
writers of one number exactly one succeeds, and the other starts again on the version it lost to. So an
interrupted run or deletion is never visible, and none gets lost.

``branch`` opens a line of versions of its own from any version, without copying. ``purge`` removes every
file that no version to be kept names; until then earlier versions can be opened.

``runs`` reads the documents of all runs and versions below a root.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provspark.functions.naming import PROV_PREFIX, SAMPLE_ID, source_name
from provspark.operators.encoders import ColumnEncoders
from provspark.operators.network import Network, prediction, probability
from provspark.operators.split import SPLIT, SPLIT_KEY, TEST, TRAIN, split_column
from provspark.operators.storage import (
    create_exclusive, delete_folder, delete_paths, read_json_document, shared_folder, together, write_json_document,
)
from provspark.sources.tables import MANIFEST, FileTable, commit_files, relative_file, write_files

MAIN = "main"
TABLES = {"relational": (), "matrix": (TRAIN, TEST), "scores": ()}
PATIENCE = 60  # seconds to wait for the document of a version that another writer has claimed

# What ``runs`` shows of a version's document.
RUNS_SCHEMA = (
    "run_id string, pipeline string, branch string, version int, kind string, "
    "changed_rows long, created_at timestamp, source_paths map<string,string>"
)


def default_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/provspark-runs"


class VersionTaken(Exception):
    """Another writer was first."""


@dataclass(frozen=True)
class Run:
    """One version of the artifacts of a pipeline run."""

    spark: SparkSession
    root: str
    pipeline: str
    run_id: str
    version: int
    document: dict
    tables: dict
    model_path: str
    branch_name: str = MAIN

    # --- paths and versions ----------------------------------------------------------------

    @property
    def path(self) -> str:
        return run_path(self.root, self.pipeline, self.run_id)

    def branch(self, name: str | None = None) -> "Run":
        """The same state as the first version of another line of versions; copies nothing."""
        other = replace(self, branch_name=name or uuid.uuid4().hex)
        publish(other, "branch", 0)
        return other

    def latest(self) -> "Run":
        return load_run(self.spark, self.pipeline, self.run_id, root=self.root, branch=self.branch_name)

    # --- row tables --------------------------------------------------------------------

    @property
    def relational_table(self) -> FileTable:
        return self.tables["relational"]

    @property
    def matrix_table(self) -> FileTable:
        return self.tables["matrix"]

    @property
    def key_cols(self) -> list[str]:
        return self.document["key_cols"]

    @property
    def output_cols(self) -> list[str]:
        return self.document["output_cols"]

    @property
    def split(self) -> Column:
        return split_column(self.document["threshold"])

    def samples(self) -> DataFrame:
        """Prepared rows with key, split and provenance."""
        return self.relational_table.read().withColumn(SPLIT, self.split)

    def relational(self, split: str | None = None) -> DataFrame:
        """Prepared rows as the user's code produced them, without provenance."""
        df = self.samples()
        return (df if split is None else df.where(F.col(SPLIT) == split)).select(*self.output_cols)

    def row_provenance(self, split: str | None = None) -> DataFrame:
        df = self.samples()
        df = df if split is None else df.where(F.col(SPLIT) == split)
        return df.select(SAMPLE_ID, SPLIT, *self.key_cols)

    def matrix(self, split: str | None = None) -> DataFrame:
        """Features and label; asking for one split reads only its files."""
        return self.matrix_table.read(split)

    def scores(self) -> DataFrame:
        """Predictions, as of training, for the test samples that are left."""
        return self.tables["scores"].read().select(SAMPLE_ID, "label", "prediction")

    def model(self) -> Network:
        return Network.from_frame(self.spark.read.parquet(self.model_path))

    # --- use on new rows ------------------------------------------------------------------

    def encoders(self, code: ColumnEncoders | None = None) -> ColumnEncoders:
        """The fitted encoders of the run; ``code`` is needed if some have functions of their own."""
        saved = self.document["encoders"]
        return ColumnEncoders.from_state(saved) if code is None else code.with_saved_state(saved)

    def predict(self, rows, code: ColumnEncoders | None = None) -> DataFrame:
        """Prepared rows (a table or tracked frame with the output columns) with ``probability`` and ``prediction``.

        The rows need not have been part of the run: encoders and weights are the stored ones.
        """
        df = rows if isinstance(rows, DataFrame) else rows.df
        names = [c for c in df.columns if c not in ("features", "probability", "prediction")]
        encoded = self.encoders(code).transform(df.select(*[F.col(f"`{c}`") for c in names]))
        scored = encoded.withColumn("probability", probability(self.model())).drop("features")
        return scored.withColumn("prediction", prediction(F.col("probability")))

    # --- provenance maps ----------------------------------------------------------------

    def column_provenance(self) -> DataFrame:
        return self.spark.read.schema("output_column string, sources array<string>").json(
            f"{self.path}/column_provenance"
        )

    def matrix_provenance(self) -> DataFrame:
        return self.spark.read.schema("input_column string, start int, stop int").json(
            f"{self.path}/matrix_provenance"
        )

    # --- sources ------------------------------------------------------------------------

    def alias_of(self, source: str) -> str:
        """Alias of a source given by its alias, its path, or its parameter name."""
        named = self.document["source_paths"].get(source, source)
        for alias in (source, source_name(source), source_name(named)):
            if PROV_PREFIX + alias in self.key_cols:
                return alias
        raise ValueError(f"{source} is no source of this run; known: {self.key_cols}")

    def prov_of(self, source: str) -> str:
        return PROV_PREFIX + self.alias_of(source)


def run_path(root: str, pipeline: str, run_id: str) -> str:
    return f"{root}/{pipeline}/{run_id}"


def write_maps(spark: SparkSession, path: str, col_prov: dict, ranges: list) -> None:
    """Column and matrix provenance as JSON lines; a few rows, one file each."""
    origins = [(c, sorted(origin)) for c, origin in col_prov.items()]
    tables = {
        "column_provenance": spark.createDataFrame(origins, "output_column string, sources array<string>"),
        "matrix_provenance": spark.createDataFrame(ranges, "input_column string, start int, stop int"),
    }
    together(*[lambda n=n, df=df: df.coalesce(1).write.json(f"{path}/{n}") for n, df in tables.items()])


def publish(run: Run, kind: str, changed_rows: int) -> None:
    """Make a version visible; raises ``VersionTaken`` if its number is in use."""
    tables = {
        name: {"schema": t.schema.json(), "manifest": t.manifest, "index": list(t.index), "parts": list(t.parts)}
        for name, t in run.tables.items()
    }
    document = {
        "run_id": run.run_id, "pipeline": run.pipeline, "branch": run.branch_name, "version": run.version, "kind": kind,
        "changed_rows": changed_rows, "created_at": datetime.datetime.now(datetime.timezone.utc).isoformat(),
        "source_paths": run.document["source_paths"], "tables": tables, "model": run.model_path.removeprefix(run.path + "/"),
    }
    path = f"{run.path}/versions/{run.branch_name}/{run.version}.json"
    if not create_exclusive(run.spark, path, json.dumps(document)):
        raise VersionTaken(path)


def runs(spark: SparkSession, root: str | None = None) -> DataFrame:
    """All runs and versions below a root, from their documents."""
    documents = spark.read.text(f"{root or default_root(spark)}/*/*/versions/*", wholetext=True)
    return documents.select(F.from_json("value", RUNS_SCHEMA).alias("run")).select("run.*").where("run_id is not null")


def version_documents(spark: SparkSession, path: str, branch: str | None = None) -> list[dict]:
    """Documents of the versions of a run that are visible."""
    folder = f"{path}/versions" if branch is None else f"{path}/versions/{branch}"
    try:
        texts = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).collect()
    except AnalysisException:
        return []
    return [json.loads(row[0]) for row in texts if row[0].rstrip().endswith("}")]


def load_run(
    spark: SparkSession, pipeline: str, run_id: str, version: int | None = None, root: str | None = None, branch: str = MAIN
) -> Run:
    """Open a stored run, by default in its latest version."""
    root = root or default_root(spark)
    path = run_path(root, pipeline, run_id)
    found = {d["version"]: d for d in version_documents(spark, path, branch)}
    if not found:
        raise ValueError(f"no run {run_id} of {pipeline}")
    version = max(found) if version is None else version
    if version not in found:
        raise ValueError(f"run {run_id} has no version {version}")
    return open_version(spark, root, pipeline, run_id, found[version])


def open_version(spark: SparkSession, root: str, pipeline: str, run_id: str, state: dict) -> Run:
    path = run_path(root, pipeline, run_id)
    tables = {
        name: FileTable(spark, path, name, T.StructType.fromJson(json.loads(t["schema"])), t["manifest"], tuple(t["index"]), tuple(t["parts"]))
        for name, t in state["tables"].items()
    }
    document = read_json_document(spark, f"{path}/run")
    return Run(spark, root, pipeline, run_id, state["version"], document, tables, f"{path}/{state['model']}", state["branch"])


def write_model(run_folder: str, network: Network, spark: SparkSession) -> str:
    path = f"{run_folder}/meta/model/{uuid.uuid4().hex}"
    network.to_frame(spark).coalesce(1).write.parquet(path)
    return path


def next_version(run: Run, kind: str, make) -> Run:
    """Commit a change on the latest version of the run's branch.

    ``make(run)`` returns ``(written, replaced, network, changed_rows)``. If another writer commits in
    the meantime, the files just written go and the change is made again on the version of the other.
    """
    while True:
        written, replaced_files, network, changed = make(run)
        parts = {name: t.parts for name, t in run.tables.items()}
        tables, model = together(
            lambda: commit_files(run.spark, run.path, run.tables, written, replaced_files, parts, whole=kind == "compact"),
            lambda: write_model(run.path, network, run.spark),
        )
        updated = replace(run, version=run.version + 1, tables=tables, model_path=model)
        try:
            publish(updated, kind, changed)
            return updated
        except VersionTaken:
            for part in written.values():
                if part is not None:
                    delete_folder(run.spark, f"{run.path}/{part.folder}")
            run = _newer(run)


def _newer(run: Run) -> Run:
    """The latest version of the branch, once it is later than ``run``."""
    until = time.monotonic() + PATIENCE
    while time.monotonic() < until:
        latest = run.latest()
        if latest.version > run.version:
            return latest
        time.sleep(0.2)
    raise TimeoutError(f"version {run.version + 1} of run {run.run_id} is claimed but was never written")


def compact(run: Run) -> Run:
    """Write all rows of the current state anew, in files of even size."""

    def make(run: Run):
        tables = run.tables
        written = together(*[lambda t=t: write_files(t.read(), run.path, t.name, t.parts) for t in tables.values()])
        files = {name: t.files().collect() for name, t in tables.items()}
        return dict(zip(tables, written, strict=True)), files, run.model(), 0

    return next_version(run, "compact", make)


# --- what may go ------------------------------------------------------------------------------

def file_references(run: Run) -> DataFrame:
    """``(table, file, versions)``: how many visible versions name each stored file."""
    manifests = sorted({t["manifest"] for d in version_documents(run.spark, run.path) for t in d["tables"].values()})
    named = [d["tables"]["relational"]["manifest"] for d in version_documents(run.spark, run.path)]
    uses = run.spark.createDataFrame([(m, named.count(m)) for m in manifests], "manifest string, uses long")
    rows = run.spark.read.schema(MANIFEST).parquet(*[f"{run.path}/{m}" for m in manifests])
    rows = rows.withColumn("manifest", F.regexp_extract(relative_file(), "^(meta/manifest/[0-9a-f]{32})", 1))
    return rows.join(F.broadcast(uses), "manifest").groupBy("table", "file").agg(F.sum("uses").alias("versions"))


def purge(run: Run, keep: list[Run] = ()) -> None:
    """Remove for good what only other versions hold: all rows, weights and copies that ``run`` and ``keep`` do not name.

    Other versions and branches stop to exist first, so none can be opened while its files go. Copies
    of text sources and intermediate tables that the run made go too; a frame that still reads them
    has to be made again. The sources themselves are not the run's and stay. What encoders learned
    (categories, means) stays as it is, as do the ids in the index.
    """
    spark, path = run.spark, run.path
    kept = {(r.branch_name, r.version) for r in (run, *keep)}
    states = version_documents(spark, path)
    missing = kept - {(d["branch"], d["version"]) for d in states}
    if missing:
        raise ValueError(f"no such versions: {sorted(missing)}")
    delete_paths(spark, [f"{path}/versions/{d['branch']}/{d['version']}.json" for d in states if (d["branch"], d["version"]) not in kept])
    states = [d for d in states if (d["branch"], d["version"]) in kept]
    meta = {d["model"] for d in states}
    for table in (t for d in states for t in d["tables"].values()):
        meta |= {table["manifest"], *table["index"]}
    live = spark.read.schema(MANIFEST).parquet(*sorted({f"{path}/{t['manifest']}" for d in states for t in d["tables"].values()}))
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/data", pathGlobFilter="*.parquet")
    stored = stored.select("path").withColumn("file", F.regexp_extract("path", r"(data/[^/]+/[0-9a-f]{32}/.*)$", 1))
    dead = stored.join(live.select("file").distinct(), "file", "left_anti").select("file")
    delete_paths(spark, [f"{path}/{row.file}" for row in dead.collect()])
    others = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/meta", pathGlobFilter="*.parquet")
    folders = others.select(F.regexp_extract("path", r"(meta/[^/]+/[0-9a-f]{32})/", 1).alias("f")).distinct().collect()
    delete_paths(spark, [f"{path}/{row.f}" for row in folders if row.f not in meta])
    delete_paths(spark, run.document.get("intermediates", []))


def export_csv(df: DataFrame, path: str) -> None:
    """Plain CSV copy of a table; vectors as comma-separated text, sparse ones as ``position:value``."""

    def plain(c: str, kind: str) -> Column:
        if kind.startswith("array"):
            return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
        if kind.startswith("struct<positions"):
            return F.concat_ws(",", F.zip_with(f"{c}.positions", f"{c}.values", lambda p, v: F.concat_ws(":", p, v)))
        return F.col(f"`{c}`")

    columns = [plain(c, kind).alias(c) for c, kind in df.dtypes]
    df.select(*columns).write.options(header=True, escape='"').csv(path)


__all__ = [
    "FileTable", "Run", "SPLIT_KEY", "TABLES", "TEST", "TRAIN", "commit_files", "compact", "default_root", "export_csv",
    "file_references", "load_run", "next_version", "open_version", "publish", "purge", "run_path", "runs",
    "version_documents", "write_files", "write_json_document", "write_maps", "write_model",
]
