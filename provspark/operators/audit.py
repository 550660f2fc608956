"""Quality and fairness measures; each is one aggregation with partial sums in the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(scored: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """Share of correct predictions as a one-row table."""
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return scored.agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def false_negative_rates(scored: DataFrame, group: Column, label="label", prediction="prediction") -> DataFrame:
    """Per group the share of positive samples that were predicted negative."""
    positive = F.col(label) == 1
    missed = F.when(positive, (F.col(prediction) == 0).cast("double"))
    return scored.groupBy(group.alias("group")).agg(
        F.count(F.when(positive, 1)).alias("positives"), F.avg(missed).alias("fnr")
    )


def equal_opportunity_gap(scored: DataFrame, group: Column, **columns) -> DataFrame:
    """Largest difference of false negative rates between groups; 0 is fair."""
    rates = false_negative_rates(scored, group, **columns)
    return rates.agg((F.max("fnr") - F.min("fnr")).alias("gap"), F.count("fnr").alias("groups"))
