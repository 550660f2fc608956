"""The example run: will a mail be a complaint of a premium customer?

Two header-less CSV files, customers and mails, are filtered, joined by mail address and
encoded; the label is "negative mail from a premium customer".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions.text import contains_any, lexicon_sentiment, parse_date
from provspark.operators.encoders import ColumnEncoders, HashedText, OneHot, StandardScaler, WordCount, chain
from provspark.operators.frame import TrackedFrame
from provspark.sources.readers import read_csv
from provspark.sources.synth import TARGET_COUNTRIES

CUSTOMER_COLUMNS = ["customer_id", "customer_email", "bank", "country", "level"]
MAIL_COLUMNS = ["mail_id", "email", "raw_date", "mail_subject", "mail_text"]
USE_CASE = ("complaint", "bank account")


def prepare(customers: TrackedFrame, mails: TrackedFrame) -> TrackedFrame:
    """The declarative preparation on two tracked tables."""
    customers = (
        customers.filter(F.col("country").isin(list(TARGET_COUNTRIES)))
        .project("is_premium", ["level"], F.col("level") == "premium")
        .select("customer_email", "bank", "country", "is_premium")
    )
    mails = (
        mails.project("mail_date", ["raw_date"], parse_date(F.col("raw_date")))
        .filter("mail_date >= timestamp'2022-01-01'")
        .filter(contains_any(F.col("mail_text"), USE_CASE))
    )
    return (
        mails.join(customers, left_on="email", right_on="customer_email")
        .project("title", ["mail_subject"], F.lower("mail_subject"))
        .project("text", ["mail_text"], F.lower("mail_text"))
        .project("sentiment", ["mail_text"], lexicon_sentiment(F.col("mail_text")))
        .select("title", "text", "bank", "country", "sentiment", "is_premium")
    )


def dataprep(spark: SparkSession, customers_path: str, mails_path: str) -> TrackedFrame:
    return prepare(
        read_csv(spark, customers_path, CUSTOMER_COLUMNS),
        read_csv(spark, mails_path, MAIL_COLUMNS),
    )


def encode_features(dimensions: int = 64) -> ColumnEncoders:
    return ColumnEncoders([
        ("subject_embedding", HashedText(dimensions), ["title"]),
        ("text_embedding", HashedText(dimensions), ["text"]),
        ("subject_length", chain(WordCount(), StandardScaler()), ["title"]),
        ("country", OneHot(), ["country"]),
    ])


def extract_label(df: DataFrame) -> Column:
    return F.when((F.col("sentiment") == "negative") & F.col("is_premium"), 1.0).otherwise(0.0)
