"""Where intermediate tables go: the folder all executors share."""

from __future__ import annotations

import functools
import json
import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from py4j.protocol import Py4JJavaError

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROW_GROUP_BYTES = 16 << 20


@functools.cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="provspark-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


_MADE: ContextVar[list | None] = ContextVar("made", default=None)


def new_folder(spark: SparkSession, kind: str) -> str:
    path = f"{shared_folder(spark)}/provspark/{kind}-{uuid.uuid4().hex}"
    if _MADE.get() is not None:
        _MADE.get().append(path)
    return path


@contextmanager
def made_folders():
    """The list of folders that the code in this block asks for."""
    folders: list[str] = []
    token = _MADE.set(folders)
    try:
        yield folders
    finally:
        _MADE.reset(token)


def materialise(df: DataFrame, kind: str, path: str | None = None) -> DataFrame:
    """Write a table once and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, kind)
    # Small row groups: a task holds the one it writes in memory.
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """One of Spark's settings, for the jobs that run in this block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a stored folder, in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Remove files or folders, several at a time."""
    if paths:
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda p: delete_folder(spark, p), paths))


def create_exclusive(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless there is one; of several writers exactly one succeeds."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getUri().getScheme() == "file":
        # Hadoop's local file system looks before it creates, which is not one step; a link is.
        name = target.toUri().getPath()
        folder = os.path.dirname(name)
        os.makedirs(folder, exist_ok=True)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(draft, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    try:
        out = store.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a stored table that fits in fewer scan tasks; others stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    tasks = df.select(F.spark_partition_id().alias("task")).distinct().count()
    return df if tasks >= cores else df.repartition(cores, key)


def together(*actions):
    """Run independent actions as concurrent Spark jobs; returns their results in order."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(actions)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, inherit(a)) for a in actions]]


def write_json_document(spark: SparkSession, document: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(path)


def read_json_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
