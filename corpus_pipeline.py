"""From raw documents to clean, tokenised training text: five stages, each one operator of ``provspark.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read again as
the next one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm import decontaminate, minhash, pieces, pii, toxicity
from provspark.llm.queries import PIECE_MODEL, table
from provspark.operators.storage import materialise


# Executors come to the last stage with memory that the others took: a task of its lattice gets half of the usual text.
TASK_BYTES = 4 << 20


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that the documents do not have."""
    return name + "_" * max(map(len, docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go; it learns from the labelled documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = _unused("toxicity", docs)
    return toxicity.with_toxicity(docs, model, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Different texts that share an id are documents of their own; of equal ones in a group the first by
    their place stays. Rows without an id stay.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    numbered = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"))
    numbered = materialise(numbered, "numbered")
    known = numbered.where("doc.doc_id is not null").select("row", "doc.doc_id", "doc.text")
    found = minhash.near_duplicates(known, key="row").select("row", "component_id")
    first = F.min(F.struct("doc_id", "row"))["row"]
    stay = found.join(known.select("row", "doc_id"), "row").groupBy("component_id").agg(first.alias("row")).select("row")
    kept = numbered.join(stay, "row", "left_semi").unionByName(numbered.where("doc.doc_id is null"))
    return kept.select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, also an edited copy, go; those that merely share common words with a short one stay."""
    out = _unused("leaks", docs)
    leaks = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), out=out)
    return leaks.where(F.size(decontaminate.telling_leaks(F.col(out))) == 0).select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in all texts, whether or not they hold the data."""
    done = pii.sanitise(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return done.select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and the text read back from them."""
    model = pieces.load_pieces(PIECE_MODEL)
    done = pieces.encode(docs, model, decoded="decoded", task_bytes=TASK_BYTES)
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"), F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", hide_private),
    ("sentencepiece", tokenise),
]

# No stage but the fourth and fifth could be said in SQL: the first is a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
