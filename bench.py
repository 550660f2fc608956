"""Headline measurements on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``; prints one JSON line.

Queries are written to a no-op sink, best of two. The incremental part follows the published
protocol: one run on synthetic mails (ten per row of the customer table), then the deletion of
``mail_subject`` for five customers, against running everything again.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from provspark.operators import maintain  # noqa: E402
from provspark.operators.storage import new_folder  # noqa: E402
from provspark.plans import complaints, suite  # noqa: E402
from provspark.plans.run import run_pipeline, summary  # noqa: E402
from provspark.sources import synth  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "q_flagship_prep", "q_join_three", "q_join_last_wins", "q_record_usage", "q_rows_retained",
    "q_split_exact", "q_scaler", "q_onehot", "q_token_hash", "q_explode_lines", "q_sentiment_lexicon",
    "q_synthetic_mails",
)
DELETED_CUSTOMERS = [1, 3, 5, 7, 11]


def timed(action):
    start = time.perf_counter()
    result = action()
    return time.perf_counter() - start, result


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("provspark-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    for name in HEADLINE:
        def once():
            suite.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()

        times[name] = min(timed(once)[0] for _ in range(2))

    customers = spark.read.parquet(f"{SF_DIR}/customer.parquet")
    paths = synth.write_example(customers, new_folder(spark, "bench"), "c_custkey")

    def full_run():
        return run_pipeline(
            spark, "complaints", paths, complaints.dataprep, complaints.encode_features, complaints.extract_label
        )

    times["run_first"], run = timed(full_run)
    times["run_again"], _ = timed(full_run)
    times["delete_features"], changed = timed(
        lambda: maintain.delete_features(run, "mails_path", "mail_subject", "customers_path", DELETED_CUSTOMERS)
    )
    times["delete_instances"], _ = timed(
        lambda: maintain.delete_instances(changed, "customers_path", DELETED_CUSTOMERS[:2])
    )
    facts = summary(run)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "retrain_over_incremental": round(times["run_again"] / times["delete_features"], 2),
        "samples": facts["train_samples"] + facts["test_samples"],
        "accuracy": round(facts["accuracy"], 4),
        "loss": round(facts["loss"], 4),
        "base_rate_loss": round(facts["base_rate_loss"], 4),
    }))


if __name__ == "__main__":
    main()
