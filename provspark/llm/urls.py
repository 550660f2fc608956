"""URL filters with DataFrame functions and Spark's own boosted trees; no Python runs in a task.

Rules come first: a rule names a host and a path prefix and holds for the host and all hosts below
it; of the rules that fit, the longest decides. All other URLs are judged by gradient-boosted trees
on lexical features (length, depth, digit ratio, entropy, parameter counts, statistics of the host
suffix), which learn from the URLs that a rule has labelled.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and is judged
by the trees like the rest; without labelled URLs of both kinds every URL without a rule gets
``default``; repeated rows stay; no rows give no rows; other columns are kept, except those named
like one of the five new ones, which are replaced.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import bounded_sample
from provspark.operators.sizing import broadcast_if_small
from provspark.operators.storage import materialise

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "n_url", "n_host", "n_path", "host_depth", "path_depth", "digit_ratio", "host_digit_ratio", "hyphens", "entropy",
    "host_entropy", "n_params", "n_query", "has_fragment", "suffix_rate", "suffix_share",
)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.char_length(F.col(url)))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def rule_of(rules: list[Rule]) -> Column:
    """The longest rule that fits ``host`` and ``path``; null if none does."""
    longest_first = sorted(rules, key=lambda r: len(r.text), reverse=True)
    fits = [
        F.when(((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path)), r.text)
        for r in longest_first
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def verdict_of(rules: list[Rule]) -> Column:
    verdicts = [F.when(F.col("rule") == r.text, r.verdict) for r in rules]
    return F.coalesce(*verdicts, F.lit(None).cast("string"))


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a text; 0 for an empty one."""
    n = F.char_length(text)
    shares = F.transform(
        F.array_distinct(F.split(text, "")), lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    )
    bits = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(n > 0, bits).otherwise(0.0)


def _share(text: Column, pattern: str) -> Column:
    n = F.char_length(text)
    return F.when(n > 0, (n - F.char_length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def with_lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    text, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    number = lambda c: c.cast("double")
    count = lambda t, c: F.char_length(t) - F.char_length(F.replace(t, F.lit(c), F.lit("")))
    return df.withColumns({
        "n_url": number(F.char_length(text)),
        "n_host": number(F.char_length(host)),
        "n_path": number(F.char_length(path)),
        "host_depth": number(count(host, ".")),
        "path_depth": number(count(path, "/")),
        "digit_ratio": _share(text, "[0-9]"),
        "host_digit_ratio": _share(host, "[0-9]"),
        "hyphens": number(count(host, "-")),
        "entropy": _entropy(text),
        "host_entropy": _entropy(host),
        "n_params": number(F.when(query == "", 0).otherwise(1 + count(query, "&"))),
        "n_query": number(F.char_length(query)),
        "has_fragment": number((F.instr(text, "#") > 0).cast("int")),
        "suffix": F.element_at(F.split(host, r"\."), -1),
    })


def judge_urls(
    pages: DataFrame, rules: list[Rule], url: str = "url", train_rows: int = 50_000, trees: int = 20, depth: int = 4,
    default: str = "allow", seed: int = 7,
) -> DataFrame:
    """Add ``host, path, rule, block_score, verdict`` (score of the trees: 0 to 1, 1 is block).

    The suffix statistics count all different URLs that a rule labels; the trees learn from a sample of
    about ``train_rows`` of them, drawn by a hash of the URL. Scoring is one pass, without a shuffle while
    the suffix table is small enough for a broadcast.
    """
    own = ("host", "path", "rule", "block_score", "verdict")
    columns = [c for c in pages.columns if c.lower() not in own]
    kept = [F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(columns)]
    judged = with_host_path(pages.select(*kept, F.col(url).alias("url")))
    judged = judged.withColumn("rule", rule_of(rules)).withColumn("by_rule", verdict_of(rules))
    label = (F.col("by_rule") == "block").cast("double")
    labelled = judged.where("by_rule is not null").select("url", "host", "path", label.alias("label")).distinct()
    labelled = materialise(labelled, "labelled")
    sample = with_lexical_features(bounded_sample(labelled, train_rows, "url"))
    drawn, blocked = sample.agg(F.count("*"), F.sum("label")).first()
    if drawn and 0 < blocked < drawn:
        counts = with_lexical_features(labelled).groupBy("suffix").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
        counts = materialise(counts, "suffixes")
        n, blocked = counts.agg(F.sum("n"), F.sum("blocked")).first()
        rate = blocked / n
        suffixes = counts.select(
            "suffix", ((F.col("blocked") + 10 * rate) / (F.col("n") + 10)).alias("suffix_rate"), (F.col("n") / n).alias("suffix_share"),
        )
        suffixes = broadcast_if_small(suffixes)
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")

        def prepared(df: DataFrame) -> DataFrame:
            df = df.join(suffixes, "suffix", "left")
            return vectors.transform(df.fillna({"suffix_rate": rate, "suffix_share": 0.0}))

        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=64).fit(
            prepared(sample).select("features", "label")
        )
        judged = model.transform(prepared(with_lexical_features(judged)))
        judged = judged.withColumn("block_score", vector_to_array("probability")[1])
    else:
        judged = judged.withColumn("block_score", F.lit(1.0 if default == "block" else 0.0))
    by_trees = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    names = [F.col(f"in_{i}").alias(c) for i, c in enumerate(columns)]
    return judged.select(*names, "host", "path", "rule", "block_score", F.coalesce("by_rule", by_trees).alias("verdict"))
