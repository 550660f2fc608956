"""A whole run: prepare, split, encode, train, score, and store every artifact."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions.naming import PROV_PREFIX, SAMPLE_ID, source_name
from provspark.operators.audit import accuracy
from provspark.operators.frame import TrackedFrame
from provspark.operators.network import Trainer, cross_entropy, mean_loss, perceptron, prediction, probability
from provspark.operators.split import (
    SPLIT, SPLIT_KEY, TEST, TRAIN, exact_threshold, hash_threshold, split_column, with_split_key,
)
from provspark.operators.storage import made_folders, spread, together, write_json_document
from provspark.sources.readers import file_registry, scans_without
from provspark.sources.artifacts import (
    TABLES, Run, commit_files, default_root, load_run, publish, run_path, write_files, write_maps, write_model,
)

RESERVED = {SAMPLE_ID, SPLIT, SPLIT_KEY, "features", "label"}


def run_pipeline(
    spark: SparkSession,
    name: str,
    source_paths: dict[str, str],
    dataprep,
    encode_features,
    extract_label,
    create_network=perceptron,
    random_seed: int = 42,
    test_size: float = 0.2,
    split: str = "exact",
    trainer: Trainer | None = Trainer(),
    root: str | None = None,
    cluster_by: str | None = None,
) -> Run:
    """Run a supervised-learning preparation and return its stored artifacts (version 0).

    * ``dataprep(spark, **source_paths)`` returns a ``TrackedFrame``;
    * ``encode_features()`` returns ``ColumnEncoders``;
    * ``extract_label(df)`` returns the label as a Column (or is a Column);
    * ``create_network(num_features)`` returns a ``Network``; ``trainer=None`` leaves its
      weights as they are.

    ``split="exact"`` has exactly ``ceil(test_size * n)`` test samples; ``"hash"`` needs no
    pass over the data and keeps samples on their side when others are deleted.

    ``cluster_by`` names the source (by alias or parameter) whose records deletions will mostly be about:
    all samples of a record then lie in one file, for one shuffle of the prepared rows.
    """
    root = root or default_root(spark)
    run_id = str(uuid.uuid4())
    path = run_path(root, name, run_id)

    with made_folders() as intermediates, file_registry(f"{root}/{name}/sources"):
        prepared: TrackedFrame = dataprep(spark, **source_paths)
    clash = RESERVED & set(prepared.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    if cluster_by is not None:
        named = source_name(source_paths.get(cluster_by, cluster_by))
        cluster_by = next((c for c in prepared.prov_cols if c in (PROV_PREFIX + cluster_by, PROV_PREFIX + named)), None)
        if cluster_by is None:
            raise ValueError(f"cluster_by names no source; known: {prepared.prov_cols}")

    # The prepared rows are the relational artifact and the base of all later steps.
    rows = with_split_key(prepared.with_sample_id(), random_seed)
    written = {"relational": write_files(rows, path, "relational", cluster_by=cluster_by)}
    stored = spark.read.schema(written["relational"].schema).parquet(f"{path}/{written['relational'].folder}")
    if split == "exact":
        threshold = exact_threshold(stored, test_size)
    elif split == "hash":
        threshold = hash_threshold(test_size)
    else:
        raise ValueError(f"unknown split {split}")
    samples = spread(stored, SAMPLE_ID).withColumn(SPLIT, split_column(threshold))

    encoders = encode_features().fit(samples.where(F.col(SPLIT) == TRAIN), f"{path}/encoders")
    label = extract_label if isinstance(extract_label, Column) else extract_label(samples)
    encoded = encoders.transform(samples.withColumn("label", label.cast("double")))
    encoded = encoded.select(SAMPLE_ID, SPLIT, *prepared.key_cols, "features", "label")
    written["matrix"] = write_files(encoded, path, "matrix", TABLES["matrix"], cluster_by)
    matrix = spark.read.schema(written["matrix"].schema).parquet(f"{path}/{written['matrix'].folder}")

    write_maps(spark, path, prepared.col_prov, encoders.matrix_provenance())
    document = {
        "threshold": threshold,
        "split": split,
        "random_seed": random_seed,
        "test_size": test_size,
        "key_cols": list(prepared.key_cols),
        "output_cols": prepared.columns,
        "num_features": encoders.width,
        "source_columns": sorted(prepared.sources),
        "column_provenance": {c: sorted(origin) for c, origin in prepared.col_prov.items()},
        "matrix_provenance": encoders.matrix_provenance(),
        "encoders": encoders.state(),
        "source_paths": source_paths,
        "intermediates": intermediates,
    }
    write_json_document(spark, document, f"{path}/run")

    network = create_network(encoders.width)
    if trainer is not None:
        network = trainer.fit(matrix.where(F.col(SPLIT) == TRAIN), network)
    scored = score(matrix.where(F.col(SPLIT) == TEST), network, prepared.key_cols)
    model_path, written["scores"] = together(
        lambda: write_model(path, network, spark), lambda: write_files(scored, path, "scores", cluster_by=cluster_by)
    )
    nothing = dict.fromkeys(TABLES)
    tables = commit_files(spark, path, nothing, written, {}, TABLES)
    run = Run(spark, root, name, run_id, 0, document, tables, model_path)
    publish(run, "run", 0)
    return run


def score(samples: DataFrame, network, keys=()) -> DataFrame:
    """Class per sample at a threshold of one half."""
    scored = samples.select(SAMPLE_ID, *keys, "label", probability(network).alias("probability"))
    return scored.select(SAMPLE_ID, *keys, "label", prediction(F.col("probability")).alias("prediction"))


def summary(run: Run) -> dict:
    """Samples per split, number of features, and how the test samples are told apart.

    ``base_rate_loss`` is the loss of always giving the share of class 1 among the training samples:
    weights that learned something have a lower ``loss``.
    """
    share = run.matrix(TRAIN).agg(F.avg("label")).first()[0] or 0.0
    test = run.matrix(TEST)
    base = test.agg(F.avg(cross_entropy(F.lit(share), F.col("label")))).first()[0]
    counts = {row[SPLIT]: row["count"] for row in run.matrix().groupBy(SPLIT).count().collect()}
    return {
        "train_samples": counts.get(TRAIN, 0),
        "test_samples": counts.get(TEST, 0),
        "num_features": run.document["num_features"],
        "accuracy": accuracy(run.scores()).first()["accuracy"],
        "loss": mean_loss(test, run.model()).first()["loss"],
        "base_rate_loss": base,
    }


def retrain_without_rows(dataprep, alias: str, row_ids):
    """The same preparation as if the source rows had never existed: the costly alternative
    to incremental maintenance. Returns a function for ``run_pipeline``.

    The rows are taken out of the tracked scan, so that everything after it sees the reduced source.
    """

    def reduced(spark, **source_paths):
        with scans_without(alias, row_ids) as met:
            prepared = dataprep(spark, **source_paths)
        if not met:
            raise ValueError(f"no scan of the preparation has the alias {alias}; sources: {sorted(prepared.sources)}")
        return prepared

    return reduced


__all__ = ["load_run", "retrain_without_rows", "run_pipeline", "score", "summary"]
