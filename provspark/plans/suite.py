"""Registered queries: every operator on the given tables, with the same result in plain SQL.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame, ``ORACLES[name]`` the SQL. Floating-point
results are compared as integers in units of 1e-6 (columns ``…_micro``, or comma-separated text
for vectors), since sums of doubles depend on the order of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.functions import text as tx
from provspark.functions.naming import SAMPLE_ID, source_name_of
from provspark.functions.vectors import micro_text
from provspark.operators import audit, lineage, maintain
from provspark.operators.encoders import (
    BatchEmbedding, CharCount, ColumnEncoders, FunctionEncoder, HashedText, OneHot, StandardScaler, WideOneHot, WordCount, chain,
    range_table,
)
from provspark.operators.frame import TrackedFrame, join
from provspark.operators.network import (
    Network, Trainer, cross_entropy, gradient_sums, logistic, mean_loss, prediction, probability,
)
from provspark.operators.split import (
    SPLIT, SPLIT_KEY, TEST, TRAIN, epoch_order, exact_threshold, hash_threshold, split_column, with_split_key,
)
from provspark.operators.storage import materialise, new_folder, spread
from provspark.plans import complaints
from provspark.plans.run import retrain_without_rows, run_pipeline, score
from provspark.sources import synth
from provspark.sources.artifacts import Run, compact, export_csv, purge, runs
from provspark.sources.readers import read_csv, read_lines, read_parquet, read_tsv, write_tsv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register the decorated function under its name, with its SQL if there is one."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> TrackedFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", alias=name)


def micro(value: Column) -> Column:
    return F.round(value * 1e6).cast("long")


def visible(frame: TrackedFrame) -> DataFrame:
    """Data and provenance, the latter under plain names (``__prov_orders`` as ``prov_orders``)."""
    return frame.df.withColumnsRenamed({c: c.lstrip("_") for c in frame.key_cols})


# --- shared inputs ------------------------------------------------------------------------

SEED = 42
TEXT_DIMENSIONS = 16
HASH_LIMIT = hash_threshold(0.2)


def text_frame(spark: SparkSession, documents_path: str, labels_path: str) -> TrackedFrame:
    """documents with their labels: lower-cased text, language, quality flag."""
    documents = read_parquet(spark, documents_path, alias="documents")
    labels = read_parquet(spark, labels_path, alias="labels")
    labels = labels.project("is_premium", ["quality"], F.col("quality") == 1).rename({"doc_id": "labelled_id"})
    return (
        documents.join(labels, "doc_id", "labelled_id")
        .project("text", ["text"], F.lower("text"))
        .select("doc_id", "text", "lang", "is_premium", "toxic")
    )


def text_encoders() -> ColumnEncoders:
    return ColumnEncoders([
        ("words", chain(WordCount(), StandardScaler()), ["text"]),
        ("tokens", HashedText(TEXT_DIMENSIONS, hash="md5"), ["text"]),
        ("language", OneHot(), ["lang"]),
    ])


def toxic_label(df: DataFrame) -> Column:
    return F.when(F.col("is_premium") & (F.col("toxic") == 0), 1.0).otherwise(0.0)


def fixed_network(num_features: int) -> Network:
    """A single layer whose weights follow from their position."""
    j = np.arange(num_features)
    return Network(((((j * 7 % 11 - 5) / 10.0).reshape(-1, 1), np.array([0.1])),))


def sources(sf_dir: str) -> dict[str, str]:
    return {"documents_path": f"{sf_dir}/documents.parquet", "labels_path": f"{sf_dir}/labels.parquet"}


_RUNS: dict[tuple, Run] = {}


def text_run(spark: SparkSession, sf_dir: str) -> Run:
    """The stored run on documents and labels that the maintenance queries start from."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = run_pipeline(
            spark, "texts", sources(sf_dir), text_frame, text_encoders, toxic_label, fixed_network,
            random_seed=SEED, trainer=None,
        )
    return _RUNS[key]


def toxic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deletion request: the rows of ``documents`` whose label says toxic."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    toxic = labels.filter("toxic = 1").df.select(F.col("doc_id").alias("toxic_id"))
    return documents.df.join(toxic, F.col("doc_id") == F.col("toxic_id"), "left_semi").select("__prov_documents")


def order_frame(spark: SparkSession, sf_dir: str) -> TrackedFrame:
    """orders with their customers: the relational stand-in for mails and customers."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").project(
        "is_premium", ["c_mktsegment"], F.col("c_mktsegment") == "BUILDING"
    )
    return (
        orders.join(customers, "o_custkey", "c_custkey")
        .project("title", ["o_orderpriority"], F.lower("o_orderpriority"))
        .select("o_orderkey", "title", "c_nationkey", "is_premium")
    )


def premium_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").df.select("__prov_customer")


ORDER_ROWS = """
orders_prep AS (
  SELECT o_orderkey, lower(o_orderpriority) AS title, c_nationkey, c_mktsegment = 'BUILDING' AS is_premium,
         o_orderkey AS prov_orders, c_custkey AS prov_customer,
         md5(o_orderkey || ':' || c_custkey) AS sample_id
  FROM orders JOIN customer ON o_custkey = c_custkey),
orders_split AS (
  SELECT *, CASE WHEN md5('42:' || sample_id) <= '""" + HASH_LIMIT + """' THEN 'test' ELSE 'train' END AS split
  FROM orders_prep)
"""

TEXT_ROWS = """
lab AS (SELECT *, row_number() OVER () - 1 AS rid FROM labels),
prep AS (
  SELECT md5(d.doc_id || ':' || l.rid) AS sample_id, d.doc_id, l.rid AS prov_labels, lower(d.text) AS text,
         d.lang, l.quality = 1 AS is_premium, l.toxic
  FROM documents d JOIN lab l ON d.doc_id = l.doc_id),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || sample_id)) AS place, count(*) OVER () AS n FROM prep),
samples AS (
  SELECT *, CASE WHEN place <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split,
         CASE WHEN is_premium AND toxic = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS label,
         len(string_split(text, ' ')) AS words
  FROM ranked)
"""

FEATURE_ROWS = TEXT_ROWS + """,
moments AS (SELECT avg(words) AS m, stddev_pop(words) AS s FROM samples WHERE split = 'train'),
langs AS (SELECT list(DISTINCT lang ORDER BY lang) AS known FROM samples WHERE split = 'train'),
counts AS (
  SELECT sample_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 16 AS b, count(*) AS n
  FROM (SELECT sample_id, unnest(string_split(text, ' ')) AS t FROM samples) GROUP BY 1, 2),
norms AS (SELECT sample_id, sqrt(sum(n * n)) AS norm FROM counts GROUP BY 1),
dense AS (
  SELECT s.sample_id, list(coalesce(c.n, 0) / z.norm ORDER BY r.b) AS embedding
  FROM samples s CROSS JOIN (SELECT unnest(range(16)) AS b) r
  LEFT JOIN counts c ON c.sample_id = s.sample_id AND c.b = r.b
  JOIN norms z ON z.sample_id = s.sample_id GROUP BY 1),
matrix AS (
  SELECT s.*, list_concat([(words - m) / s], embedding,
                          list_transform(known, lambda x: CASE WHEN x = lang THEN 1.0 ELSE 0.0 END)) AS features
  FROM samples s JOIN dense USING (sample_id), moments, langs),
zeroed AS (
  SELECT *, list_transform(features, lambda x, i: CASE WHEN i <= 17 THEN 0.0 ELSE x END) AS patched FROM matrix),
scored AS (
  SELECT *,
    1 / (1 + exp(-(0.1 + list_sum(list_transform(features, lambda x, i: x * ((i - 1) * 7 % 11 - 5) / 10.0))))) AS p,
    1 / (1 + exp(-(0.1 + list_sum(list_transform(patched, lambda x, i: x * ((i - 1) * 7 % 11 - 5) / 10.0))))) AS p_new
  FROM zeroed)
"""


def micro_list(column: str) -> str:
    return f"list_aggregate(list_transform({column}, lambda x: round(x * 1e6)::BIGINT::VARCHAR), 'string_agg', ',')"


# --- sources --------------------------------------------------------------------------------

@query("SELECT doc_id, doc_id AS prov_documents FROM documents")
def q_scan_rowids(spark, sf_dir):
    return visible(table(spark, sf_dir, "documents")["doc_id"])


@query("""
WITH names AS (SELECT DISTINCT source FROM documents),
crc AS (
  SELECT source, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(source, ''), lambda c: ord(c)::BIGINT)),
    lambda state, byte: list_reduce(
      list_prepend(xor(state, byte), range(8)),
      lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS code
  FROM names)
SELECT doc_id, '0x' || lower(hex(code)) AS source_name FROM documents JOIN crc USING (source)
""")
def q_source_name(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.df.select("doc_id", source_name_of(F.col("source")).alias("source_name"))


@query("""
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal * 100)::BIGINT AS cents,
       c_mktsegment, c_custkey AS prov_customer FROM customer
""")
def q_csv_scan(spark, sf_dir):
    """The customer table written as one CSV file per task and scanned with row ids."""
    path = new_folder(spark, "csv")
    table(spark, sf_dir, "customer").data().write.csv(path)
    scanned = read_csv(
        spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        alias="customer",
    )
    return visible(scanned.project("cents", ["c_acctbal"], F.round(F.col("c_acctbal") * 100).cast("long")).select(
        "c_custkey", "c_name", "c_nationkey", "cents", "c_mktsegment"
    ))


@query("""
SELECT doc_id, text, n_chars,
       (dense_rank() OVER (ORDER BY lang) - 1) * 1099511627776 + row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS prov_documents
FROM documents
""")
def q_csv_breaks(spark, sf_dir):
    """Documents with their line breaks as CSV, a folder of parts per language, scanned in splits with row ids."""
    path = new_folder(spark, "csv")
    documents = table(spark, sf_dir, "documents").df.select("doc_id", "text", "n_chars", "lang", "__prov_documents")
    # Ranges, so that no task holds a language; parts are named in their order. Repeated or null ids spread by their place.
    order = ["lang", "doc_id", "__prov_documents"]
    by_part = documents.repartitionByRange(*order).sortWithinPartitions(*order).drop("__prov_documents")
    options = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    by_part.write.partitionBy("lang").options(**options).csv(path)
    scanned = read_csv(spark, path, "doc_id long, text string, n_chars long", alias="documents", na_values=(), parts=True)
    return visible(scanned)


@query("""
SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey,
       round(c_acctbal * 100)::BIGINT::VARCHAR AS cents, c_mktsegment, FALSE AS wrong_count, NULL::VARCHAR AS line,
       c_custkey AS prov_customer
FROM customer
""")
def q_lines_scan(spark, sf_dir):
    path = new_folder(spark, "lines")
    names = ["c_custkey", "c_name", "c_nationkey", "cents", "c_mktsegment"]
    customers = table(spark, sf_dir, "customer").data().withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("long"))
    customers.select(F.concat_ws(",", *names)).write.text(path)
    lines = visible(read_lines(spark, path, names, alias="customer"))
    return lines.withColumnsRenamed({"_field_count_error": "wrong_count", "_line": "line"})


@query("SELECT doc_id, text, lang, n_chars FROM documents")
def q_tsv_roundtrip(spark, sf_dir):
    """Documents with all their tabs and line breaks through a tab-separated intermediate."""
    path = new_folder(spark, "tsv")
    write_tsv(table(spark, sf_dir, "documents").data().select("doc_id", "text", "lang", "n_chars"), path)
    return read_tsv(spark, path, "doc_id long, text string, lang string, n_chars long")


# --- filters and projections ------------------------------------------------------------------

@query("""
SELECT d.doc_id AS mail_id, lower(d.text) AS title, d.lang AS country, l.quality = 1 AS is_premium,
       d.doc_id AS prov_documents, l.rid AS prov_labels
FROM documents d JOIN (SELECT *, row_number() OVER () - 1 AS rid FROM labels) l ON d.doc_id = l.doc_id
WHERE d.lang IN ('en', 'de', 'fr') AND (contains(d.text, 'the') OR contains(d.text, 'der'))
""")
def q_flagship_prep(spark, sf_dir):
    """Scan, filter, project, rename, join and select with provenance, end to end."""
    documents = (
        table(spark, sf_dir, "documents")
        .filter(F.col("lang").isin("en", "de", "fr"))
        .filter(tx.contains_any(F.col("text"), ["the", "der"]))
        .rename({"lang": "country", "doc_id": "mail_id"})
    )
    labels = table(spark, sf_dir, "labels").project("is_premium", ["quality"], F.col("quality") == 1)
    prepared = (
        documents.join(labels.select("doc_id", "is_premium"), "mail_id", "doc_id")
        .project("title", ["text"], F.lower("text"))
        .select("mail_id", "title", "country", "is_premium")
    )
    return visible(prepared)


@query("SELECT * REPLACE (lower(o_orderpriority) AS o_orderpriority), o_orderkey AS prov_orders FROM orders")
def q_project_overwrite(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return visible(orders.project("o_orderpriority", ["o_orderpriority"], "lower(o_orderpriority)"))


@query("SELECT o_orderkey, o_custkey, o_orderkey AS prov_orders FROM orders")
def q_select(spark, sf_dir):
    return visible(table(spark, sf_dir, "orders")[["o_orderkey", "o_custkey"]])


@query("SELECT * FROM orders")
def q_exclude(spark, sf_dir):
    return table(spark, sf_dir, "orders").data()


@query("SELECT o_orderkey AS prov_orders FROM orders")
def q_prov_only(spark, sf_dir):
    return table(spark, sf_dir, "orders").provenance().toDF("prov_orders")


@query("SELECT doc_id AS mail_id, lang AS country, n_chars, doc_id AS prov_documents FROM documents")
def q_rename(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").rename({"doc_id": "mail_id", "lang": "country"})
    return visible(documents.select("mail_id", "country", "n_chars"))


@query("""
SELECT doc_id, lines[i] AS line, doc_id AS prov_documents, i - 1 AS pos_0,
       md5(doc_id || ':' || (i - 1)) AS sample_id
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
""")
def q_explode_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").explode("line", ["text"], F.split("text", "\n", -1))
    frame = lines.select("doc_id", "line")
    return frame.with_sample_id().withColumnsRenamed({c: c.lstrip("_") for c in frame.key_cols})


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000")
def q_filter_expr(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 250000")
    return orders.select("o_orderkey", "o_orderstatus").data()


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND n_chars >= 500")
def q_filter_params(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").filter(
        "array_contains(:langs, lang) AND n_chars >= :least", langs=["de", "fr"], least=500
    )
    return documents.select("doc_id", "lang").data()


@query("SELECT doc_id FROM documents WHERE contains(text, 'complaint') OR contains(text, 'the')")
def q_filter_pred(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").filter(tx.contains_any(F.col("text"), ["complaint", "the"]))
    return documents["doc_id"].data()


@query("SELECT doc_id FROM documents WHERE contains(text, 'complaint') OR contains(text, 'the')")
def q_filter_python(spark, sf_dir):
    """The same predicate as a Python function over whole batches."""

    def matches(text):
        return text.str.contains("complaint", regex=False) | text.str.contains("the", regex=False)

    return table(spark, sf_dir, "documents").filter(matches, columns=["text"])["doc_id"].data()


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS year FROM orders WHERE year(o_orderdate) >= 1998")
def q_filter_year(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp'1998-01-01'")
    return orders.project("year", ["o_orderdate"], F.year("o_orderdate")).select("o_orderkey", "year").data()


@query("SELECT doc_id, len(string_split(text, ' ')) AS pieces, doc_id AS prov_documents FROM documents")
def q_project_python(spark, sf_dir):
    """A Python row function, re-expressed over batches of its declared source columns."""

    def pieces(text):
        return text.str.count(" ") + 1

    documents = table(spark, sf_dir, "documents").project("pieces", ["text"], pieces, returns="long")
    return visible(documents.select("doc_id", "pieces"))


# --- joins --------------------------------------------------------------------------------------

@query("""
SELECT o_orderkey, o_custkey, c_custkey, c_name, o_orderkey AS prov_orders, c_custkey AS prov_customer
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def q_join_prov(spark, sf_dir):
    joined = join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")
    return visible(joined.select("o_orderkey", "o_custkey", "c_custkey", "c_name"))


@query("""
SELECT o_orderkey, c_name, n_name, o_orderkey AS prov_orders, c_custkey AS prov_customer,
       n_nationkey::BIGINT AS prov_nation
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def q_join_three(spark, sf_dir):
    joined = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")
        .join(table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey")
    )
    return visible(joined.select("o_orderkey", "c_name", "n_name"))


@query("""
SELECT a.n_name, b.n_name AS n_name_r, a.n_nationkey::BIGINT AS prov_nation, b.n_nationkey::BIGINT AS prov_nation_r,
       c_custkey, c_custkey AS prov_customer FROM customer JOIN nation a ON c_nationkey = a.n_nationkey
JOIN nation b ON a.n_regionkey = b.n_nationkey
""")
def q_join_self(spark, sf_dir):
    """The same source twice: its columns and its provenance get a suffix."""
    nation = table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "customer").join(nation, "c_nationkey", "n_nationkey")
    joined = joined.join(nation, "n_regionkey", "n_nationkey").select("c_custkey", "n_name", "n_name_r")
    return visible(joined)


@query("""
SELECT event_id, c_name, event_id AS prov_events, c_custkey AS prov_customer
FROM events JOIN customer ON user_id = c_custkey
""")
def q_join_salted(spark, sf_dir):
    """Few users hold all events: every key is spread over eight tasks."""
    joined = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), "user_id", "c_custkey", salt=8)
    return visible(joined.select("event_id", "c_name"))


@query("""
SELECT c_custkey, event_id, event_type, c_custkey AS prov_customer, event_id AS prov_events
FROM customer JOIN (SELECT user_id, arg_max(event_id, event_id) AS event_id,
                           arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) e
  ON c_custkey = user_id
""")
def q_join_last_wins(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join_latest(table(spark, sf_dir, "events"), "c_custkey", "user_id")
    return visible(joined.select("c_custkey", "event_id", "event_type"))


# --- provenance of rows ----------------------------------------------------------------------------

def order_samples(spark, sf_dir) -> tuple[TrackedFrame, DataFrame]:
    frame = order_frame(spark, sf_dir)
    return frame, with_split_key(frame.with_sample_id(), SEED).withColumn(SPLIT, split_column(HASH_LIMIT))


_ORDER_RUNS: dict[tuple, Run] = {}


def order_run(spark: SparkSession, sf_dir: str) -> Run:
    """The stored run on orders and customers."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ORDER_RUNS:
        _ORDER_RUNS[key] = run_pipeline(spark, "orders", order_paths(sf_dir), order_dataprep, order_encoders, premium_label, **ORDER_OPTIONS)
    return _ORDER_RUNS[key]


def _from_source(hits: DataFrame) -> DataFrame:
    return hits.select(SAMPLE_ID, F.col("__prov_orders").alias("prov_orders"), F.col("__prov_customer").alias("prov_customer"))


ROWS_FROM_SOURCE = "WITH " + ORDER_ROWS + """
SELECT sample_id, prov_orders, prov_customer FROM orders_split
WHERE split = '{split}' AND prov_customer IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
"""


@query(ROWS_FROM_SOURCE.replace("{split}", "train"))
def q_rows_from_source_train(spark, sf_dir):
    return _from_source(lineage.train_rows_originating_from(order_run(spark, sf_dir), "customer", premium_customers(spark, sf_dir)))


@query(ROWS_FROM_SOURCE.replace("{split}", "test"))
def q_rows_from_source_test(spark, sf_dir):
    return _from_source(lineage.test_rows_originating_from(order_run(spark, sf_dir), "customer", premium_customers(spark, sf_dir)))


@query("WITH " + ORDER_ROWS + """
SELECT sample_id, split FROM orders_split
WHERE prov_customer NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def q_rows_retained(spark, sf_dir):
    frame, samples = order_samples(spark, sf_dir)
    kept = TrackedFrame(samples, frame.prov_cols, frame.col_prov).not_originating_from(
        "customer", premium_customers(spark, sf_dir)
    )
    return kept.df.select(SAMPLE_ID, SPLIT)


@query("WITH " + ORDER_ROWS + """
SELECT sample_id, prov_customer, c_custkey, c_name, c_mktsegment
FROM orders_split JOIN customer ON prov_customer = c_custkey WHERE split = 'test'
""")
def q_backward_rows(spark, sf_dir):
    _, samples = order_samples(spark, sf_dir)
    found = lineage.backward_rows(samples.where(F.col(SPLIT) == TEST), table(spark, sf_dir, "customer"))
    return found.select(
        SAMPLE_ID, F.col("__prov_customer").alias("prov_customer"), "c_custkey", "c_name", "c_mktsegment"
    )


@query("WITH " + ORDER_ROWS + """
SELECT c_custkey, EXISTS (SELECT 1 FROM orders_split WHERE split = 'train' AND prov_customer = c_custkey) AS used
FROM customer
""")
def q_record_usage(spark, sf_dir):
    _, samples = order_samples(spark, sf_dir)
    usage = lineage.record_usage(table(spark, sf_dir, "customer"), samples.where(F.col(SPLIT) == TRAIN))
    return usage.select("c_custkey", "used")


@query("WITH " + ORDER_ROWS + """
SELECT o_orderkey, o_orderkey IN (SELECT prov_orders FROM orders_split WHERE split = 'train') AS used FROM orders
""")
def q_record_usage_orders(spark, sf_dir):
    """The same for the other relation of the join."""
    _, samples = order_samples(spark, sf_dir)
    usage = lineage.record_usage(table(spark, sf_dir, "orders"), samples.where(F.col(SPLIT) == TRAIN))
    return usage.select("o_orderkey", "used")


# --- splits -----------------------------------------------------------------------------------------

@query("WITH " + TEXT_ROWS + "SELECT doc_id, sample_id, split FROM samples")
def q_split_exact(spark, sf_dir):
    keyed = with_split_key(text_frame(spark, **sources(sf_dir)).with_sample_id(), SEED)
    keyed = materialise(keyed.select("doc_id", SAMPLE_ID, SPLIT_KEY), "keys")
    threshold = exact_threshold(keyed, 0.2)
    return keyed.select("doc_id", SAMPLE_ID, split_column(threshold).alias(SPLIT))


@query("WITH " + ORDER_ROWS + "SELECT o_orderkey, split FROM orders_split")
def q_split_hash(spark, sf_dir):
    _, samples = order_samples(spark, sf_dir)
    return samples.select("o_orderkey", SPLIT)


@query("WITH " + ORDER_ROWS + """
SELECT sample_id, row_number() OVER (ORDER BY md5('1:' || sample_id), sample_id) - 1 AS place FROM orders_split WHERE split = 'train'
""")
def q_epoch_order(spark, sf_dir):
    """The place of every training sample in the order in which one epoch visits them."""
    _, samples = order_samples(spark, sf_dir)
    return epoch_order(samples.where(F.col(SPLIT) == TRAIN).select(SAMPLE_ID), epoch=1)


# --- scalar functions and encoders ---------------------------------------------------------------------

@query("SELECT doc_id, len(string_split(text, ' ')) AS words FROM documents")
def q_wordcount(spark, sf_dir):
    return table(spark, sf_dir, "documents").df.select(
        "doc_id", tx.word_count(F.col("text")).cast("long").alias("words")
    )


@query("SELECT doc_id, length(text) AS chars FROM documents")
def q_charlen(spark, sf_dir):
    return table(spark, sf_dir, "documents").df.select(
        "doc_id", tx.char_count(F.col("text")).cast("long").alias("chars")
    )


@query("""
SELECT o_orderkey, o_orderdate AS parsed, year(o_orderdate)::INTEGER AS year FROM orders
""")
def q_parse_date(spark, sf_dir):
    """Dates written in two notations and parsed back."""
    iso = F.col("o_orderkey") % 2 == 0
    raw = F.when(iso, F.col("o_orderdate").cast("string")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    orders = table(spark, sf_dir, "orders").project("raw_date", ["o_orderdate", "o_orderkey"], raw)
    parsed = tx.parse_date(F.col("raw_date"), ["dd.MM.yyyy"])
    orders = orders.project("parsed", ["raw_date"], parsed.cast("timestamp_ntz"))
    orders = orders.project("year", ["parsed"], F.year("parsed"))
    return orders.select("o_orderkey", "parsed", "year").data()


@query("SELECT doc_id, translate(text, ',' || chr(10) || chr(13), '   ') AS line FROM documents")
def q_one_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").df.select("doc_id", tx.one_line(F.col("text")).alias("line"))


# A lexicon of words that do occur in the test documents.
DOCUMENT_NEGATIVE = ("is", "was", "not", "der", "les")
DOCUMENT_POSITIVE = ("the", "of", "die", "la", "que")


@query(f"""
WITH hits AS (
  SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents),
score AS (
  SELECT doc_id, len(list_filter(w, lambda x: x IN {DOCUMENT_POSITIVE})) -
                 len(list_filter(w, lambda x: x IN {DOCUMENT_NEGATIVE})) AS s FROM hits)
SELECT doc_id, CASE WHEN s < 0 THEN 'negative' ELSE 'positive' END AS sentiment FROM score
""")
def q_sentiment_lexicon(spark, sf_dir):
    scorer = tx.lexicon_sentiment(F.col("text"), DOCUMENT_NEGATIVE, DOCUMENT_POSITIVE)
    documents = spread(table(spark, sf_dir, "documents").data(), "doc_id")
    return documents.select("doc_id", scorer.alias("sentiment"))


@query("WITH " + TEXT_ROWS + "SELECT doc_id, label FROM samples")
def q_label(spark, sf_dir):
    df = text_frame(spark, **sources(sf_dir)).data()
    return df.select("doc_id", toxic_label(df).alias("label"))


@query("""
WITH m AS (SELECT avg(len(string_split(text, ' '))) AS a, stddev_pop(len(string_split(text, ' '))) AS s FROM documents)
SELECT doc_id, round((len(string_split(text, ' ')) - a) / s * 1e6)::BIGINT AS scaled_micro FROM documents, m
""")
def q_scaler(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").data()
    encoders = ColumnEncoders([("words", chain(WordCount(), StandardScaler()), ["text"])]).fit(documents)
    return encoders.transform(documents).select("doc_id", micro(F.get("features", 0)).alias("scaled_micro"))


@query("""
WITH counts AS (
  SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 8 AS b, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents) GROUP BY 1, 2),
norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM counts GROUP BY 1),
slots AS (
  SELECT d.doc_id, r.b AS place, coalesce(c.n, 0) / norm AS x FROM (documents d JOIN norms USING (doc_id)) CROSS JOIN range(8) r(b)
  LEFT JOIN counts c ON c.doc_id = d.doc_id AND c.b = r.b
  UNION ALL SELECT doc_id, 8 + dense_rank() OVER (ORDER BY l.lang) - 1, CASE WHEN d.lang = l.lang THEN 1.0 ELSE 0.0 END
  FROM documents d, (SELECT DISTINCT lang FROM documents) l),
moments AS (SELECT place, avg(x) AS m, stddev_pop(x) AS s FROM slots GROUP BY place)
SELECT doc_id, place::INTEGER AS place, round((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END * 1e6)::BIGINT AS scaled_micro
FROM slots JOIN moments USING (place)
""")
def q_sequence_two_fits(spark, sf_dir):
    """Chains that learn at several steps: buckets and categories are scaled by what the step after them learns."""
    documents = table(spark, sf_dir, "documents").data()
    encoders = ColumnEncoders([
        ("tokens", chain(HashedText(8, hash="md5"), StandardScaler()), ["text"]), ("language", chain(OneHot(), StandardScaler()), ["lang"]),
    ]).fit(documents)
    slots = encoders.transform(documents).select("doc_id", F.posexplode("features").alias("place", "x"))
    return slots.select("doc_id", "place", micro(F.col("x")).alias("scaled_micro"))


WIDE_ROWS = """
known AS (SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS place FROM (SELECT DISTINCT o_custkey FROM orders)),
wide AS (SELECT o_orderkey, place, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS label FROM orders JOIN known USING (o_custkey))
"""


def wide_orders(spark, sf_dir) -> tuple[DataFrame, int]:
    """Orders with a position per customer, as sparse vectors, and the number of positions."""
    orders = table(spark, sf_dir, "orders").data()
    label = (F.col("o_orderstatus") == "F").cast("double").alias("label")
    encoders = ColumnEncoders([("customer", WideOneHot(), ["o_custkey"])]).fit(orders)
    return encoders.transform(orders).select("o_orderkey", label, "features"), encoders.width


@query("WITH " + WIDE_ROWS + "SELECT o_orderkey, place::INTEGER AS place, 1.0::DOUBLE AS value FROM wide")
def q_onehot_wide(spark, sf_dir):
    """A position per customer: the categories are a joined table, the vectors hold what is not zero."""
    wide, _ = wide_orders(spark, sf_dir)
    return wide.select("o_orderkey", F.inline(F.arrays_zip("features.positions", "features.values"))).toDF("o_orderkey", "place", "value")


@query("WITH " + WIDE_ROWS + """,
scored AS (SELECT place, label, 1 / (1 + exp(-(0.1 + (place * 7 % 11 - 5) / 10.0))) AS p FROM wide),
n AS (SELECT count(*) AS n FROM scored)
SELECT place AS position, round(sum(p - label) / any_value(n) * 1e9)::BIGINT AS value FROM scored, n GROUP BY place
UNION ALL SELECT count(DISTINCT place), round(avg(p - label) * 1e9)::BIGINT FROM scored
""")
def q_wide_gradient(spark, sf_dir):
    """Mean gradient of a linear model over sparse vectors, the bias last."""
    wide, width = wide_orders(spark, sf_dir)
    (total,), n = gradient_sums(wide, fixed_network(width))
    rows = [(j, int(round(v / n * 1e9))) for j, v in enumerate(total)]
    return spark.createDataFrame(rows, "position long, value long")


@query("""
WITH c AS (SELECT list(DISTINCT lang ORDER BY lang) AS known FROM documents)
SELECT doc_id, list_aggregate(list_transform(known, lambda x: CASE WHEN x = lang THEN '1000000' ELSE '0' END),
                              'string_agg', ',') AS slots FROM documents, c
""")
def q_onehot(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").data()
    encoders = ColumnEncoders([("language", OneHot(), ["lang"])]).fit(documents)
    return encoders.transform(documents).select("doc_id", micro_text(F.col("features")).alias("slots"))


@query("""
SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 16 AS bucket, count(*) AS n
FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents) GROUP BY 1, 2
""")
def q_token_hash(spark, sf_dir):
    documents = spread(table(spark, sf_dir, "documents").data(), "doc_id")
    encoders = ColumnEncoders([("tokens", HashedText(TEXT_DIMENSIONS, hash="md5", normalise=False), ["text"])])
    counts = encoders.transform(documents).select("doc_id", F.posexplode_outer("features").alias("bucket", "n"))
    return counts.where("n > 0").select("doc_id", F.col("bucket").cast("long"), F.col("n").cast("long"))


@query("WITH " + FEATURE_ROWS + f"SELECT doc_id, split, label, {micro_list('features')} AS features FROM matrix")
def q_compose(spark, sf_dir):
    """All encoders fitted on the training side and applied to both; read from the stored run."""
    run = text_run(spark, sf_dir)
    keys = run.samples().select(SAMPLE_ID, "doc_id")
    return keys.join(run.matrix(), SAMPLE_ID).select(
        "doc_id", SPLIT, "label", micro_text(F.col("features")).alias("features")
    )


@query("""
WITH m AS (SELECT avg(length(text)) AS a, stddev_pop(length(text)) AS s FROM documents)
SELECT doc_id, length(text)::BIGINT AS chars, round((length(text) - a) / s * 1e6)::BIGINT AS scaled_micro
FROM documents, m
""")
def q_charcount_encoder(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").data()
    encoders = ColumnEncoders([
        ("raw", CharCount(), ["text"]), ("scaled", chain(CharCount(), StandardScaler()), ["text"]),
    ]).fit(documents)
    return encoders.transform(documents).select(
        "doc_id", F.get("features", 0).cast("long").alias("chars"), micro(F.get("features", 1)).alias("scaled_micro")
    )


@query("""
SELECT doc_id, length(text)::BIGINT AS chars, len(string_split(text, ' ')) - 1 AS blanks FROM documents
""")
def q_batch_embedding(spark, sf_dir):
    """Vectors from a pandas UDF, where a pretrained model would be plugged in."""

    @F.pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series(list(np.column_stack([text.str.len(), text.str.count(" ")]).astype(float)))

    documents = spread(table(spark, sf_dir, "documents").data(), "doc_id")
    encoders = ColumnEncoders([("vectors", BatchEmbedding(embed, 2), ["text"])]).fit(documents)
    return encoders.transform(documents).select(
        "doc_id", F.get("features", 0).cast("long").alias("chars"), F.get("features", 1).cast("long").alias("blanks")
    )


@query("SELECT doc_id, n_chars * n_chars AS squared, doc_id + n_chars AS total FROM documents")
def q_function_encoder(spark, sf_dir):
    """An arbitrary function of two columns as an encoder."""
    documents = table(spark, sf_dir, "documents").data()
    both = FunctionEncoder(lambda n, i: F.array((n * n).cast("double"), (i + n).cast("double")), 2)
    encoded = ColumnEncoders([("both", both, ["n_chars", "doc_id"])]).fit(documents).transform(documents)
    return encoded.select(
        "doc_id", F.get("features", 0).cast("long").alias("squared"), F.get("features", 1).cast("long").alias("total")
    )


# --- provenance of features ---------------------------------------------------------------------------------

RANGES = """
lang_count AS (SELECT len(known) AS k FROM langs),
blocks AS (
  SELECT 'text' AS input_column, 0 AS start, 1 AS stop UNION ALL SELECT 'text', 1, 17
  UNION ALL SELECT 'lang', 17, (17 + k)::INTEGER FROM lang_count)
"""


@query("WITH " + FEATURE_ROWS + "," + RANGES + "SELECT * FROM blocks")
def q_matrix_ranges(spark, sf_dir):
    return text_run(spark, sf_dir).matrix_provenance()


@query("WITH " + FEATURE_ROWS + "," + RANGES + """
SELECT input_column, count(*) AS ranges, min(start) AS first, max(stop) AS last FROM blocks GROUP BY 1
""")
def q_range_merge(spark, sf_dir):
    rows = [tuple(r) for r in text_run(spark, sf_dir).matrix_provenance().collect()]
    merged = range_table(spark, rows)
    return merged.select(
        "input_column", F.size("ranges").cast("long").alias("ranges"),
        F.get("ranges", 0)["start"].alias("first"), F.element_at("ranges", -1)["stop"].alias("last"),
    )


@query("WITH " + FEATURE_ROWS + "," + RANGES + "SELECT start, stop FROM blocks WHERE input_column = 'lang'")
def q_feature_ranges(spark, sf_dir):
    run = text_run(spark, sf_dir)
    columns = lineage.output_columns(run, "documents", "lang")
    found = run.matrix_provenance().where(F.col("input_column").isin(columns))
    return found.select("start", "stop")


@query("WITH " + TEXT_ROWS + """
SELECT t.output_column, t.source, u.n FROM (VALUES ('doc_id', 'documents.doc_id'), ('text', 'documents.text'),
  ('lang', 'documents.lang'), ('is_premium', 'labels.quality'), ('toxic', 'labels.toxic')) t(output_column, source)
JOIN (UNPIVOT (SELECT count(doc_id) AS doc_id, count(CASE WHEN toxic = 0 THEN text END) AS text, count(lang) AS lang,
               count(is_premium) AS is_premium, count(toxic) AS toxic FROM samples)
      ON doc_id, text, lang, is_premium, toxic INTO NAME output_column VALUE n) u USING (output_column)
""")
def q_output_columns(spark, sf_dir):
    """Where the output columns come from, and how many values each has left after a deletion."""
    run = after_feature_deletion(spark, sf_dir)
    left = run.relational().agg(*[F.count(c).alias(c) for c in run.output_cols])
    left = left.unpivot([], run.output_cols, "output_column", "n")
    origins = run.column_provenance().select("output_column", F.explode("sources").alias("source"))
    return origins.join(left, "output_column")


# --- stored artifacts -------------------------------------------------------------------------------------------

@query("WITH " + TEXT_ROWS + "SELECT doc_id, text, lang, is_premium, toxic FROM samples WHERE split = 'train'")
def q_relational_train(spark, sf_dir):
    return text_run(spark, sf_dir).relational(TRAIN)


@query("WITH " + TEXT_ROWS + "SELECT doc_id, text, lang, is_premium, toxic FROM samples WHERE split = 'test'")
def q_relational_test(spark, sf_dir):
    return text_run(spark, sf_dir).relational(TEST)


@query("WITH " + TEXT_ROWS + """
SELECT sample_id, split, doc_id AS prov_documents, prov_labels FROM samples
""")
def q_row_provenance(spark, sf_dir):
    stored = text_run(spark, sf_dir).row_provenance()
    return stored.withColumnsRenamed({"__prov_documents": "prov_documents", "__prov_labels": "prov_labels"})


@query("""
SELECT 'layer0' AS layer, (j - 1)::INTEGER AS i, 0 AS j, round(((j - 1) * 7 % 11 - 5) / 10.0 * 1e6)::BIGINT AS value_micro
FROM (SELECT unnest(range(1, 18 + k)) AS j FROM (SELECT count(DISTINCT lang) AS k FROM documents))
UNION ALL SELECT 'layer0', -1, 0, 100000
""")
def q_model_table(spark, sf_dir):
    run = text_run(spark, sf_dir)
    stored = spark.read.parquet(run.model_path)
    return stored.select("layer", "i", "j", micro(F.col("value")).alias("value_micro"))


@query("WITH " + TEXT_ROWS + """
SELECT 'texts' AS pipeline, 0 AS version, 'run' AS kind, 2::BIGINT AS n_sources, count(*) AS n_rows, 0::BIGINT AS n_changed
FROM samples
UNION ALL SELECT 'texts', 1, 'delete_features', 2, count(*), count(*) FILTER (WHERE toxic = 1) FROM samples
""")
def q_run_registry(spark, sf_dir):
    """The registered versions with the rows they have and the rows they changed."""
    first, second = text_run(spark, sf_dir), after_feature_deletion(spark, sf_dir)
    entries = runs(spark, first.root).where((F.col("run_id") == first.run_id) & F.col("kind").isin("run", "delete_features"))
    sizes = [r.samples().agg(F.count("*").alias("n_rows")).withColumn("version", F.lit(r.version)) for r in (first, second)]
    return entries.join(sizes[0].unionByName(sizes[1]), "version").select(
        "pipeline", "version", "kind", F.size("source_paths").cast("long").alias("n_sources"), "n_rows",
        F.col("changed_rows").alias("n_changed"),
    )


@query("WITH " + TEXT_ROWS + """
SELECT doc_id::VARCHAR AS doc_id, lang, toxic::VARCHAR AS toxic, CASE WHEN toxic = 0 THEN text END AS text FROM samples
""")
def q_export_csv(spark, sf_dir):
    """The whole relation after a deletion as CSV, read back."""
    run, path = after_feature_deletion(spark, sf_dir), new_folder(spark, "export")
    export_csv(run.relational().select("doc_id", "lang", "toxic", "text"), path)
    return spark.read.options(header=True, multiLine=True, escape='"', lineSep="\n").csv(path)


# --- scoring, loss, gradients ---------------------------------------------------------------------------------

@query("WITH " + FEATURE_ROWS + """
SELECT sample_id, label, CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction FROM scored WHERE split = 'test'
""")
def q_score(spark, sf_dir):
    return text_run(spark, sf_dir).scores()


@query("SELECT count(*) AS n_rows FROM documents JOIN labels USING (doc_id)")
def q_count(spark, sf_dir):
    return text_frame(spark, **sources(sf_dir)).df.agg(F.count("*").alias("n_rows"))


@query("WITH " + FEATURE_ROWS + """
SELECT round(avg(CASE WHEN (p > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) * 1e6)::BIGINT AS accuracy_micro, count(*) AS n
FROM scored WHERE split = 'test'
""")
def q_accuracy(spark, sf_dir):
    measured = audit.accuracy(text_run(spark, sf_dir).scores())
    return measured.select(micro(F.col("accuracy")).alias("accuracy_micro"), "n")


@query("WITH " + FEATURE_ROWS + """
SELECT lang, count(*) FILTER (WHERE label = 1) AS positives,
       round(avg(CASE WHEN label = 1 THEN CASE WHEN p > 0.5 THEN 0.0 ELSE 1.0 END END) * 1e6)::BIGINT AS fnr_micro
FROM scored WHERE split = 'test' GROUP BY lang
""")
def q_equal_opportunity(spark, sf_dir):
    run = text_run(spark, sf_dir)
    tested = run.scores().join(run.samples().select(SAMPLE_ID, "lang"), SAMPLE_ID)
    rates = audit.false_negative_rates(tested, F.col("lang"))
    return rates.select(F.col("group").alias("lang"), "positives", micro(F.col("fnr")).alias("fnr_micro"))


@query("WITH " + FEATURE_ROWS + """,
rates AS (SELECT lang, avg(CASE WHEN label = 1 THEN CASE WHEN p > 0.5 THEN 0.0 ELSE 1.0 END END) AS fnr
          FROM scored WHERE split = 'test' GROUP BY lang)
SELECT round((max(fnr) - min(fnr)) * 1e6)::BIGINT AS gap_micro, count(fnr) AS groups FROM rates
""")
def q_opportunity_gap(spark, sf_dir):
    run = text_run(spark, sf_dir)
    tested = run.scores().join(run.samples().select(SAMPLE_ID, "lang"), SAMPLE_ID)
    gap = audit.equal_opportunity_gap(tested, F.col("lang"))
    return gap.select(micro(F.col("gap")).alias("gap_micro"), "groups")


@query("WITH " + FEATURE_ROWS + """
SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))) * 1e6)::BIGINT AS loss_micro, count(*) AS n
FROM scored WHERE split = 'train'
""")
def q_bce_loss(spark, sf_dir):
    run = text_run(spark, sf_dir)
    return mean_loss(run.matrix(TRAIN), run.model()).select(micro(F.col("loss")).alias("loss_micro"), "n")


def weights_table(spark, values) -> DataFrame:
    """One row per weight of a single-layer network, the bias last."""
    rows = [(j, int(round(v * 1e6))) for j, v in enumerate(np.asarray(values, dtype=float))]
    return spark.createDataFrame(rows, "position long, value_micro long")


GRADIENT = """
terms AS (
  SELECT unnest(range(len(features) + 1)) AS position, list_append(features, 1.0) AS old,
         list_append(patched, 1.0) AS new, p - label AS e, p_new - label AS e_new
  FROM scored WHERE split = 'train' {where}),
sums AS (
  SELECT position, avg(e * old[position + 1]) AS g, avg(e_new * new[position + 1]) AS g_new FROM terms GROUP BY position),
weights AS (
  SELECT position, g, g_new, CASE WHEN position = max(position) OVER () THEN 0.1
                                  ELSE (position * 7 % 11 - 5) / 10.0 END AS w FROM sums)
"""


@query("WITH " + FEATURE_ROWS + "," + GRADIENT.replace("{where}", "") + """
SELECT position, round(g * 1e6)::BIGINT AS value_micro FROM weights
""")
def q_gradient_linear(spark, sf_dir):
    """Mean gradient over all training samples: partial sums per task, one sum per weight."""
    run = text_run(spark, sf_dir)
    (total,), n = gradient_sums(run.matrix(TRAIN), run.model())
    return weights_table(spark, total / n)


def fixed_perceptron(num_features: int, hidden: int = 4) -> Network:
    """Two layers whose weights follow from their positions."""
    j, k = np.arange(num_features)[:, None], np.arange(hidden)[None, :]
    inner = ((j * 5 + k * 3) % 7 - 3) / 10.0, 0.05 * k[0] - 0.1
    outer = ((k.T * 2 % 5 - 2) / 10.0 + 0.05), np.array([0.1])
    return Network((inner, outer))


@query("WITH " + FEATURE_ROWS + """,
hidden AS (
  SELECT sample_id, label, features, k, (k * 2 % 5 - 2) / 10.0 + 0.05 AS w, greatest(0.0, 0.05 * k - 0.1 +
    list_sum(list_transform(features, lambda x, j: x * (((j - 1) * 5 + k * 3) % 7 - 3) / 10.0))) AS h
  FROM matrix, (SELECT unnest(range(4)) AS k) WHERE split = 'train'),
errors AS (SELECT sample_id, 1 / (1 + exp(-(0.1 + sum(h * w)))) - any_value(label) AS e FROM hidden GROUP BY sample_id),
parts AS (
  SELECT k, h, e, CASE WHEN h > 0 THEN e * w ELSE 0.0 END AS back, features FROM hidden JOIN errors USING (sample_id)),
inner_weights AS (
  SELECT j, k, avg(back * x) AS g FROM (
    SELECT k, back, unnest(features) AS x, unnest(range(len(features))) AS j FROM parts) GROUP BY j, k),
gradient AS (
  SELECT 'layer0' AS layer, j AS i, k AS j, g FROM inner_weights
  UNION ALL SELECT 'layer0', -1, k, avg(back) FROM parts GROUP BY k
  UNION ALL SELECT 'layer1', k, 0, avg(e * h) FROM parts GROUP BY k
  UNION ALL SELECT 'layer1', -1, 0, avg(e) FROM errors)
SELECT layer, i::INTEGER AS i, j::INTEGER AS j, round(g * 1e6)::BIGINT AS value_micro FROM gradient
""")
def q_gradient_mlp(spark, sf_dir):
    """Mean gradient of the two-layer network over all training samples."""
    run = text_run(spark, sf_dir)
    network = fixed_perceptron(run.document["num_features"])
    (total,), n = gradient_sums(run.matrix(TRAIN), network)
    gradient = network.with_flat(total / n).to_frame(spark)
    return gradient.select("layer", "i", "j", micro(F.col("value")).alias("value_micro"))


TRAINED_STEPS, TRAINED_RATE = 3, 0.01


def _adam_sql() -> str:
    """Full-gradient Adam steps of a logistic regression from zero weights, one pair of tables per step."""
    sql = """, tr AS (SELECT list_append(features, 1.0) AS x, label AS y FROM matrix WHERE split = 'train'),
    s0 AS (SELECT list_transform(x, lambda a: 0.0::DOUBLE) AS w, list_transform(x, lambda a: 0.0::DOUBLE) AS m,
                  list_transform(x, lambda a: 0.0::DOUBLE) AS v FROM tr LIMIT 1)"""
    for k in range(1, TRAINED_STEPS + 1):
        sql += f""",
    d{k} AS (SELECT x, 1 / (1 + exp(-list_sum(list_transform(x, lambda a, j: a * w[j])))) - y AS e FROM tr, s{k - 1}),
    g{k} AS (SELECT list(g ORDER BY i) AS g FROM (
      SELECT i, avg(e * a) AS g FROM (SELECT e, unnest(x) AS a, unnest(range(1, len(x) + 1)) AS i FROM d{k}) GROUP BY i)),
    u{k} AS (SELECT w, list_transform(m, lambda a, i: 0.9 * a + 0.1 * g[i]) AS m,
                    list_transform(v, lambda a, i: 0.999 * a + 0.001 * g[i] * g[i]) AS v FROM s{k - 1}, g{k}),
    s{k} AS (SELECT list_transform(w, lambda a, i: a - {TRAINED_RATE} * (m[i] / {1 - 0.9**k!r}) / (sqrt(v[i] / {1 - 0.999**k!r}) + 1e-8)) AS w,
                    m, v FROM u{k})"""
    return sql


@query("WITH " + FEATURE_ROWS + _adam_sql() + f"""
SELECT i::INTEGER AS position, round(a * 1e5)::BIGINT AS value FROM (
  SELECT unnest(range(len(w))) AS i, unnest(w) AS a FROM s{TRAINED_STEPS})
""")
def q_logistic_train(spark, sf_dir):
    """Weights of a logistic regression after three full-gradient steps over all training samples."""
    run = text_run(spark, sf_dir)
    trainer = Trainer(epochs=TRAINED_STEPS, steps=1, learning_rate=TRAINED_RATE)
    trained = trainer.fit(run.matrix(TRAIN), logistic(run.document["num_features"]))
    rows = [(i, float(w)) for i, w in enumerate(trained.flat)]
    weights = spark.createDataFrame(rows, "position int, w double")
    return weights.select("position", F.round(F.col("w") * 1e5).cast("long").alias("value"))


def _perceptron_sql() -> str:
    """Forward pass, backward pass and Adam of the two-layer network, in full-gradient steps."""
    sql = """, tr AS (SELECT sample_id, list_append(features, 1.0) AS x, label AS y FROM matrix WHERE split = 'train'),
    shape AS (SELECT len(x) AS n FROM tr LIMIT 1),
    p0 AS (SELECT k, list_transform(range(1, n + 1), lambda j: CASE WHEN j = n THEN 0.05 * k - 0.1 ELSE ((j - 1) * 5 + k * 3) % 7 / 10.0 - 0.3 END::DOUBLE) AS w,
                  list_transform(range(1, n + 1), lambda j: 0.0::DOUBLE) AS m, list_transform(range(1, n + 1), lambda j: 0.0::DOUBLE) AS v
           FROM shape, range(4) r(k)),
    q0 AS (SELECT list_append(list_transform(range(4), lambda k: ((k * 2 % 5 - 2) / 10.0 + 0.05)::DOUBLE), 0.1::DOUBLE) AS w,
                  [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0] AS m, [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0] AS v)"""
    moved = "list_transform({a}.w, lambda a, i: a - {rate} * (({mean}) / {c1!r}) / (sqrt({square}) / sqrt({c2!r}) + 1e-8))"
    for k in range(1, TRAINED_STEPS + 1):
        mean, square = "0.9 * {a}.m[i] + 0.1 * g[i]", "0.999 * {a}.v[i] + 0.001 * g[i] * g[i]"

        def update(a: str) -> str:
            own = mean.format(a=a), square.format(a=a)
            w = moved.format(a=a, rate=TRAINED_RATE, mean=own[0], square=own[1], c1=1 - 0.9**k, c2=1 - 0.999**k)
            return f"{w} AS w, list_transform(g, lambda x, i: {own[0]}) AS m, list_transform(g, lambda x, i: {own[1]}) AS v"

        sql += f""",
    h{k} AS (SELECT sample_id, x, y, k, greatest(0.0, list_sum(list_transform(x, lambda a, j: a * w[j]))) AS h FROM tr, p{k - 1}),
    o{k} AS (SELECT sample_id, any_value(y) AS y, list_append(list(h ORDER BY k), 1.0::DOUBLE) AS hs FROM h{k} GROUP BY sample_id),
    e{k} AS (SELECT sample_id, hs, 1 / (1 + exp(-list_sum(list_transform(hs, lambda a, i: a * w[i])))) - y AS e FROM o{k}, q{k - 1}),
    gq{k} AS (SELECT list(g ORDER BY i) AS g FROM (
      SELECT i, avg(e * a) AS g FROM (SELECT e, unnest(hs) AS a, unnest(range(1, 6)) AS i FROM e{k}) GROUP BY i)),
    gp{k} AS (SELECT k, list(g ORDER BY i) AS g FROM (
      SELECT k, i, avg(back * a) AS g FROM (
        SELECT k, CASE WHEN h > 0 THEN e * w[k + 1] ELSE 0.0 END AS back, unnest(x) AS a, unnest(range(1, len(x) + 1)) AS i
        FROM h{k} JOIN e{k} USING (sample_id), q{k - 1}) GROUP BY k, i) GROUP BY k),
    q{k} AS (SELECT {update(f'q{k - 1}')} FROM q{k - 1}, gq{k}),
    p{k} AS (SELECT k, {update(f'p{k - 1}')} FROM p{k - 1} JOIN gp{k} USING (k))"""
    return sql


@query("WITH " + FEATURE_ROWS + _perceptron_sql() + f""",
test AS (SELECT sample_id, label, list_append(features, 1.0) AS x FROM matrix WHERE split = 'test'),
inner_layer AS (
  SELECT sample_id, any_value(label) AS label, list_append(list(greatest(0.0, z) ORDER BY k), 1.0::DOUBLE) AS hs FROM (
    SELECT sample_id, label, k, list_sum(list_transform(x, lambda a, j: a * w[j])) AS z FROM test, p{TRAINED_STEPS}) GROUP BY sample_id),
outer_layer AS (
  SELECT sample_id, label, 1 / (1 + exp(-list_sum(list_transform(hs, lambda a, i: a * w[i])))) AS p FROM inner_layer, q{TRAINED_STEPS})
SELECT sample_id, label, CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction, round(p * 1e3)::BIGINT AS p_milli FROM outer_layer
""")
def q_mlp_train_score(spark, sf_dir):
    """Train the two-layer network in full-gradient steps over all training samples and score the test side."""
    run = text_run(spark, sf_dir)
    trainer = Trainer(epochs=TRAINED_STEPS, steps=1, learning_rate=TRAINED_RATE)
    network = trainer.fit(run.matrix(TRAIN), fixed_perceptron(run.document["num_features"]))
    scored = run.matrix(TEST).select(SAMPLE_ID, "label", probability(network).alias("p"))
    return scored.select(SAMPLE_ID, "label", prediction(F.col("p")).alias("prediction"), F.round(F.col("p") * 1e3).cast("long").alias("p_milli"))


@query("WITH " + FEATURE_ROWS + _perceptron_sql() + f""",
test AS (SELECT sample_id, label, list_append(features, 1.0) AS x FROM matrix WHERE split = 'test'),
inner_layer AS (
  SELECT sample_id, any_value(label) AS label, list_append(list(greatest(0.0, z) ORDER BY k), 1.0::DOUBLE) AS hs FROM (
    SELECT sample_id, label, k, list_sum(list_transform(x, lambda a, j: a * w[j])) AS z FROM test, p{TRAINED_STEPS}) GROUP BY sample_id)
SELECT sample_id, label, CASE WHEN list_sum(list_transform(hs, lambda a, i: a * w[i])) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction
FROM inner_layer, q{TRAINED_STEPS}
""")
def q_run_trained(spark, sf_dir):
    """A whole run with training: the stored predictions of its test samples."""
    trainer = Trainer(epochs=TRAINED_STEPS, steps=1, learning_rate=TRAINED_RATE)
    run = run_pipeline(
        spark, "trained", sources(sf_dir), text_frame, text_encoders, toxic_label, fixed_perceptron, random_seed=SEED, trainer=trainer,
    )
    return run.scores()


def _perceptron_gradient_sql(vector: str, name: str) -> str:
    """Tables ``{name}``: mean gradient of the fixed two-layer network over the toxic training samples."""
    return f"""
h_{name} AS (
  SELECT sample_id, label, {vector} AS x, k, (k * 2 % 5 - 2) / 10.0 + 0.05 AS w, greatest(0.0, 0.05 * k - 0.1 +
    list_sum(list_transform({vector}, lambda x, j: x * (((j - 1) * 5 + k * 3) % 7 - 3) / 10.0))) AS h
  FROM zeroed, (SELECT unnest(range(4)) AS k) WHERE split = 'train' AND toxic = 1),
e_{name} AS (SELECT sample_id, 1 / (1 + exp(-(0.1 + sum(h * w)))) - any_value(label) AS e FROM h_{name} GROUP BY sample_id),
b_{name} AS (SELECT k, h, e, CASE WHEN h > 0 THEN e * w ELSE 0.0 END AS back, x FROM h_{name} JOIN e_{name} USING (sample_id)),
{name} AS (
  SELECT 'layer0' AS layer, j AS i, k AS j, avg(back * a) AS g FROM (
    SELECT k, back, unnest(x) AS a, unnest(range(len(x))) AS j FROM b_{name}) GROUP BY j, k
  UNION ALL SELECT 'layer0', -1, k, avg(back) FROM b_{name} GROUP BY k
  UNION ALL SELECT 'layer1', k, 0, avg(e * h) FROM b_{name} GROUP BY k
  UNION ALL SELECT 'layer1', -1, 0, avg(e) FROM e_{name})"""


@query("WITH " + FEATURE_ROWS + "," + _perceptron_gradient_sql("features", "old") + "," + _perceptron_gradient_sql("patched", "new") + """
SELECT layer, i::INTEGER AS i, j::INTEGER AS j, round((old.g - new.g) * 1e6)::BIGINT AS emptied_micro, round(old.g * 1e6)::BIGINT AS removed_micro
FROM old JOIN new USING (layer, i, j)
""")
def q_unlearn_mlp(spark, sf_dir):
    """How the weights of a two-layer network move if the text of toxic documents is deleted, or the documents are."""
    run = text_run(spark, sf_dir)
    network = fixed_perceptron(run.document["num_features"])
    ranges = lineage.feature_ranges(run, lineage.output_columns(run, "documents", "text"))
    hits = run.matrix_table.rows_from("__prov_documents", toxic_rows(spark, sf_dir)).where(F.col(SPLIT) == TRAIN)
    emptied = maintain.unlearn_features(network, maintain.before_after(hits, ranges))
    removed = maintain.unlearn_instances(network, hits)
    moves = [network.with_flat(n.flat - network.flat).to_frame(spark) for n in (emptied, removed)]
    moves = [m.select("layer", "i", "j", micro(F.col("value")).alias(c)) for m, c in zip(moves, ("emptied_micro", "removed_micro"))]
    return moves[0].join(moves[1], ["layer", "i", "j"])


@query("WITH " + FEATURE_ROWS + """,
all_counts AS (
  SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 16 AS b, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents) GROUP BY 1, 2),
all_norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM all_counts GROUP BY 1),
all_dense AS (
  SELECT d.doc_id, list(coalesce(c.n, 0) / z.norm ORDER BY r.b) AS embedding
  FROM documents d CROSS JOIN (SELECT unnest(range(16)) AS b) r
  LEFT JOIN all_counts c ON c.doc_id = d.doc_id AND c.b = r.b
  JOIN all_norms z ON z.doc_id = d.doc_id GROUP BY 1),
all_rows AS (
  SELECT d.doc_id, list_concat([(len(string_split(lower(text), ' ')) - m) / s], embedding,
                               list_transform(known, lambda x: CASE WHEN x = lang THEN 1.0 ELSE 0.0 END)) AS features
  FROM documents d JOIN all_dense USING (doc_id), moments, langs),
all_scored AS (
  SELECT doc_id, 1 / (1 + exp(-(0.1 + list_sum(list_transform(features, lambda x, i: x * ((i - 1) * 7 % 11 - 5) / 10.0))))) AS p FROM all_rows)
SELECT doc_id, CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction, round(p * 1e6)::BIGINT AS p_micro FROM all_scored
""")
def q_predict_new_rows(spark, sf_dir):
    """The stored run on all documents, also those that no label made part of it."""
    run, documents = text_run(spark, sf_dir), table(spark, sf_dir, "documents")
    scored = run.predict(documents.project("text", ["text"], F.lower("text")).select("doc_id", "text", "lang"))
    return scored.select("doc_id", "prediction", micro(F.col("probability")).alias("p_micro"))


@query("WITH " + FEATURE_ROWS + """
SELECT sample_id, CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END AS prediction,
       round(-(label * ln(p) + (1 - label) * ln(1 - p)) * 1e6)::BIGINT AS loss_micro
FROM scored WHERE split = 'test'
""")
def q_sample_loss(spark, sf_dir):
    run = text_run(spark, sf_dir)
    p = probability(run.model())
    scored = run.matrix(TEST).select(SAMPLE_ID, "label", p.alias("p"))
    return scored.select(
        SAMPLE_ID, prediction(F.col("p")).alias("prediction"), micro(cross_entropy(F.col("p"), F.col("label"))).alias("loss_micro")
    )


# --- incremental maintenance -----------------------------------------------------------------------------------

_DELETED: dict[tuple, Run] = {}


def after_feature_deletion(spark, sf_dir) -> Run:
    """The run after deleting the text of all toxic documents."""
    key = (spark.sparkContext.applicationId, sf_dir, "features")
    if key not in _DELETED:
        run = text_run(spark, sf_dir).branch("features")
        _DELETED[key] = maintain.delete_features(run, "documents", "text", "documents", toxic_rows(spark, sf_dir))
    return _DELETED[key]


def after_instance_deletion(spark, sf_dir) -> Run:
    """The run after deleting all toxic documents."""
    key = (spark.sparkContext.applicationId, sf_dir, "instances")
    if key not in _DELETED:
        run = text_run(spark, sf_dir).branch("instances")
        _DELETED[key] = maintain.delete_instances(run, "documents", toxic_rows(spark, sf_dir))
    return _DELETED[key]


@query("WITH " + TEXT_ROWS + """
SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE text END AS text, lang, split FROM samples
""")
def q_del_features_rel(spark, sf_dir):
    return after_feature_deletion(spark, sf_dir).samples().select("doc_id", "text", "lang", SPLIT)


@query("WITH " + FEATURE_ROWS + f"""
SELECT sample_id, split, label,
       {micro_list('CASE WHEN toxic = 1 THEN patched ELSE features END')} AS features FROM zeroed
""")
def q_del_features_matrix(spark, sf_dir):
    matrix = after_feature_deletion(spark, sf_dir).matrix()
    return matrix.select(SAMPLE_ID, SPLIT, "label", micro_text(F.col("features")).alias("features"))


@query("WITH " + TEXT_ROWS + """
SELECT s.doc_id, CASE WHEN s.toxic = 1 THEN NULL ELSE s.text END AS text, CASE WHEN s.is_premium THEN s.lang END AS lang, s.is_premium, s.toxic
FROM samples s JOIN documents d USING (doc_id) WHERE d.n_chars <= 4000
""")
def q_del_batch(spark, sf_dir):
    """One version for three requests: texts of toxic documents, languages by label rows, and long documents as a whole."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    texts = toxic_rows(spark, sf_dir).selectExpr("'documents' AS row_source", "__prov_documents AS row_id", "'documents' AS column_source", "'text' AS column")
    languages = labels.filter("quality != 1").df.selectExpr("'labels'", "__prov_labels", "'documents'", "'lang'")
    long = documents.filter("n_chars > 4000").df.selectExpr("'documents'", "__prov_documents", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)")
    return maintain.delete_batch(text_run(spark, sf_dir).branch(), texts.union(languages).union(long)).relational()


@query("WITH " + TEXT_ROWS + "SELECT doc_id, text, lang, is_premium, toxic FROM samples WHERE toxic = 0")
def q_purge(spark, sf_dir):
    """Everything that is left on disk of the prepared rows after toxic documents were deleted and purged."""
    run = run_pipeline(
        spark, "purged", sources(sf_dir), text_frame, text_encoders, toxic_label, fixed_network, random_seed=SEED, trainer=None,
    )
    purge(maintain.delete_instances(run, "documents", toxic_rows(spark, sf_dir)))
    stored = spark.read.option("recursiveFileLookup", True).parquet(f"{run.path}/data/relational")
    return stored.select("doc_id", "text", "lang", "is_premium", "toxic")


@query("WITH " + TEXT_ROWS + """
SELECT sample_id, start, stop FROM samples, (VALUES (0, 1), (1, 17)) r(start, stop) WHERE toxic = 1
""")
def q_updates(spark, sf_dir):
    """The patch list of a feature deletion."""
    run = text_run(spark, sf_dir)
    ranges = lineage.feature_ranges(run, lineage.output_columns(run, "documents", "text"))
    hits = run.matrix_table.rows_from("__prov_documents", toxic_rows(spark, sf_dir))
    return maintain.updates(hits, ranges).select(SAMPLE_ID, F.explode("ranges").alias("r")).select(SAMPLE_ID, "r.*")


@query("WITH " + FEATURE_ROWS + f"""
SELECT sample_id, label, {micro_list('features')} AS before, {micro_list('patched')} AS after
FROM zeroed WHERE toxic = 1 AND split = 'train'
""")
def q_unlearn_pairs(spark, sf_dir):
    run = text_run(spark, sf_dir)
    ranges = lineage.feature_ranges(run, lineage.output_columns(run, "documents", "text"))
    hits = run.matrix_table.rows_from("__prov_documents", toxic_rows(spark, sf_dir)).where(F.col(SPLIT) == TRAIN)
    pairs = maintain.before_after(hits, ranges)
    return pairs.select(
        SAMPLE_ID, "label", micro_text(F.col("features")).alias("before"), micro_text(F.col("patched")).alias("after")
    )


@query("WITH " + FEATURE_ROWS + "," + GRADIENT.replace("{where}", "AND toxic = 1") + """
SELECT position, round((w - (g_new - g)) * 1e6)::BIGINT AS value_micro FROM weights
""")
def q_unlearn_features(spark, sf_dir):
    """Weights after the texts of all toxic documents were deleted."""
    return weights_table(spark, after_feature_deletion(spark, sf_dir).model().flat)


@query("WITH " + FEATURE_ROWS + "," + GRADIENT.replace("{where}", "AND toxic = 1") + """
SELECT position, round((w + g) * 1e6)::BIGINT AS value_micro FROM weights
""")
def q_unlearn_instances(spark, sf_dir):
    """Weights after all toxic documents were deleted."""
    return weights_table(spark, after_instance_deletion(spark, sf_dir).model().flat)


@query("WITH " + FEATURE_ROWS + f"""
SELECT sample_id, split, {micro_list('features')} AS features FROM matrix WHERE toxic = 0
""")
def q_del_instances(spark, sf_dir):
    matrix = after_instance_deletion(spark, sf_dir).matrix()
    return matrix.select(SAMPLE_ID, SPLIT, micro_text(F.col("features")).alias("features"))


@query("WITH " + TEXT_ROWS + "SELECT doc_id, text, lang, is_premium, toxic FROM samples WHERE toxic = 0")
def q_del_instances_rel(spark, sf_dir):
    return after_instance_deletion(spark, sf_dir).relational()


@query("WITH " + TEXT_ROWS + """
SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE text END AS text, is_premium FROM samples
""")
def q_compact(spark, sf_dir):
    """The same state after writing it out as a new base."""
    return compact(after_feature_deletion(spark, sf_dir)).relational().select("doc_id", "text", "is_premium")


@query("WITH " + FEATURE_ROWS + "," + GRADIENT.replace("{where}", "AND toxic = 1") + """,
moved AS (SELECT list(w - (g_new - g) ORDER BY position) AS w FROM weights),
fresh AS (
  SELECT sample_id, label, CASE WHEN toxic = 1 THEN patched ELSE features END AS x FROM zeroed WHERE split = 'test')
SELECT sample_id, label, CASE WHEN list_sum(list_transform(list_append(x, 1.0), lambda v, i: v * w[i])) > 0
                              THEN 1.0::DOUBLE ELSE 0.0 END AS prediction FROM fresh, moved
""")
def q_rescore(spark, sf_dir):
    return maintain.rescore(after_feature_deletion(spark, sf_dir))


def order_encoders() -> ColumnEncoders:
    return ColumnEncoders([
        ("title", HashedText(8), ["title"]),
        ("length", chain(WordCount(), StandardScaler()), ["title"]),
        ("nation", OneHot(unknown="ignore"), ["c_nationkey"]),
    ])


def order_dataprep(spark, orders_path, customer_path):
    return order_frame(spark, orders_path.rsplit("/", 1)[0])


def order_paths(sf_dir: str) -> dict[str, str]:
    return {"orders_path": f"{sf_dir}/orders.parquet", "customer_path": f"{sf_dir}/customer.parquet"}


def premium_label(df: DataFrame) -> Column:
    return F.col("is_premium").cast("double")


ORDER_OPTIONS = dict(create_network=fixed_network, random_seed=SEED, split="hash", trainer=None)


@query("WITH " + ORDER_ROWS + """
SELECT split, count(*) AS retrained, count(*) AS maintained, count(*) AS same FROM orders_split
WHERE NOT is_premium GROUP BY split
""")
def q_retrain_vs_ivm(spark, sf_dir):
    """Deleting customers from a stored run and rerunning without them give the same samples."""
    gone = premium_customers(spark, sf_dir)
    maintained = maintain.delete_instances(order_run(spark, sf_dir).branch(), "customer", gone).samples()
    reduced = retrain_without_rows(order_dataprep, "customer", gone)
    again = run_pipeline(spark, "orders", order_paths(sf_dir), reduced, order_encoders, premium_label, **ORDER_OPTIONS).samples()
    columns = [SAMPLE_ID, SPLIT, "o_orderkey", "title", "c_nationkey", "is_premium"]
    both = maintained.select(*columns, F.lit(1).alias("m")).unionByName(
        again.select(*columns, F.lit(2).alias("m"))
    ).groupBy(*columns).agg(F.sum("m").alias("m"))
    return both.groupBy(SPLIT).agg(
        F.count_if(F.col("m") >= 2).alias("retrained"),
        F.count_if(F.col("m") % 2 == 1).alias("maintained"),
        F.count_if(F.col("m") == 3).alias("same"),
    )


# --- the example on synthetic mails -----------------------------------------------------------------------------

def _sql_draw(digest: str, i: int) -> str:
    return f"(('0x' || substr({digest}, {1 + 8 * i}, 8))::BIGINT / 4294967296.0)"


def _sql_pick(values, draw: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][floor({draw} * {len(values)})::INTEGER + 1]"


SYNTHETIC = f"""
seeded AS (
  SELECT c_custkey AS customer_id, md5('place:{synth.SEED}:' || c_custkey) AS place,
         md5('status:{synth.SEED}:' || c_custkey) AS status FROM customer),
people AS (
  SELECT customer_id, 'user' || customer_id || '@example.org' AS customer_email,
    {_sql_pick(synth.BANKS, _sql_draw('status', 0))} || ' ' || {_sql_pick(synth.BANK_FORMS, _sql_draw('status', 1))} AS bank,
    CASE WHEN {_sql_draw('place', 0)} > 0.25 THEN {_sql_pick(synth.TARGET_COUNTRIES, _sql_draw('place', 1))}
         ELSE chr(65 + floor({_sql_draw('place', 2)} * 26)::INTEGER) || chr(65 + floor({_sql_draw('place', 3)} * 26)::INTEGER)
    END AS country,
    CASE WHEN {_sql_draw('status', 2)} > 0.9 THEN 'premium' ELSE 'standard' END AS level FROM seeded),
drawn AS (
  SELECT p.*, md5('mail:{synth.SEED}:' || customer_id || ':' || n) AS h, md5('more:{synth.SEED}:' || customer_id || ':' || n) AS g
  FROM people p, (SELECT unnest(range({synth.MAILS_PER_CUSTOMER})) AS n)),
mails AS (
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS mail_id,
    customer_email AS email,
    strftime(DATE '{synth.FIRST_DATE}' + floor({_sql_draw('h', 0)} * {synth.DAYS})::INTEGER, '%Y-%m-%d') AS raw_date,
    CASE WHEN {_sql_draw('h', 1)} > 0.6 THEN {_sql_pick(synth.NEGATIVE_SUBJECTS, _sql_draw('h', 2))} ||
      CASE WHEN country = 'DE' AND {_sql_draw('h', 3)} > 0.99
           THEN ' My credit card is ' || lpad((('0x' || substr(g, 9, 13))::BIGINT)::VARCHAR, 16, '4') ELSE '' END
      ELSE {_sql_pick(synth.POSITIVE_SUBJECTS, _sql_draw('h', 2))} END AS mail_subject,
    CASE WHEN {_sql_draw('h', 1)} > 0.6 THEN {_sql_pick(synth.NEGATIVE_TEXTS, _sql_draw('g', 0))}
         ELSE {_sql_pick(synth.POSITIVE_TEXTS, _sql_draw('g', 0))} END AS mail_text
  FROM drawn)
"""


@query("WITH " + SYNTHETIC + "SELECT * FROM people")
def q_synthetic_customers(spark, sf_dir):
    """One synthetic customer for every row of the customer table."""
    return synth.customers(table(spark, sf_dir, "customer").df, "c_custkey")


@query("WITH " + SYNTHETIC + "SELECT * FROM mails")
def q_synthetic_mails(spark, sf_dir):
    return synth.mails(synth.customers(table(spark, sf_dir, "customer").df, "c_custkey"))


@query("WITH " + SYNTHETIC + f""",
words AS (SELECT *, regexp_split_to_array(lower(mail_text), '[^a-z]+') AS w FROM mails)
SELECT lower(mail_subject) AS title, lower(mail_text) AS text, bank, country,
       CASE WHEN len(list_filter(w, lambda x: x IN {tx.POSITIVE_WORDS})) < len(list_filter(w, lambda x: x IN {tx.NEGATIVE_WORDS}))
            THEN 'negative' ELSE 'positive' END AS sentiment, level = 'premium' AS is_premium
FROM words JOIN people ON email = customer_email
WHERE country IN {synth.TARGET_COUNTRIES} AND year(raw_date::DATE) >= 2022
  AND (contains(mail_text, 'complaint') OR contains(mail_text, 'bank account'))
""")
def q_example_prep(spark, sf_dir):
    """The example preparation, from CSV files of synthetic mails to the prepared relation."""
    paths = synth.write_example(table(spark, sf_dir, "customer").df, new_folder(spark, "example"), "c_custkey")
    return complaints.dataprep(spark, **paths).data()
