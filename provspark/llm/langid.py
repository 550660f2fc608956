"""Language identification in two steps: the family first, then one-versus-one linear machines within it.

A text is the square root of its counts of hashed runs of one to three letters (lower-cased; what is
no letter separates), scaled to length one. Linear support vector machines (squared hinge) separate
each pair of families, and each pair of languages within a family; the most wins decide, ties by the
sum of margins. ``FAMILIES`` says which languages are close; any other language is its own family.

Defined cases: a text that is null or holds no letter is ``und`` with score 0; without labelled rows
every text is ``und``; one learned language is predicted for every text with letters; repeated rows
count as often as they occur; no rows give no rows; other columns are kept, except those named like
the two new ones, which are replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provspark.llm.common import give_back, shared, text_slices

FEATURES = 1 << 12
TRAIN_ROWS_PER_LANGUAGE = 1000
# Families of closely related languages by their codes.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ca ro gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indo-aryan": "hi ur bn mr ne gu pa",
    "turkic": "tr az kk uz ky tt",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "semitic": "ar he am mt",
    "austronesian": "id ms tl jv",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of hashed letter runs, and which texts hold a letter."""
    lowered = [t.lower() if t else "" for t in texts.to_pylist()]
    lengths = np.array([len(t) for t in lowered]) + 1
    joined = (" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(joined, np.uint32)
    row = np.repeat(np.arange(len(lowered)), lengths)
    letter = _LETTERS[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    # One space between words.
    kept = letter | np.concatenate(([True], letter[:-1]))
    codes, row, letter = codes[kept], row[kept], letter[kept]
    counts = np.zeros(len(lowered) * FEATURES)
    run = np.zeros(len(codes), np.uint64)
    for size in (1, 2, 3):
        if len(codes) < size:
            break
        run = run[: len(codes) - size + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1 :] + np.uint64(size)
        middle = letter if size == 1 else letter[1 : len(run) + 1] if size == 3 else letter[:-1] | letter[1:]
        use = middle[: len(run)] & (row[: len(run)] == row[size - 1 :])
        bucket = ((run * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)).astype(np.int64)
        counts += np.bincount(row[: len(run)][use] * FEATURES + bucket[use], minlength=len(counts))
    matrix = np.sqrt(counts.reshape(len(lowered), FEATURES))
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    has_letter = np.bincount(row, weights=letter, minlength=len(lowered)) > 0
    return (matrix / np.maximum(norm, 1e-12)).astype(np.float32), has_letter


def fit_machine(x: np.ndarray, y: np.ndarray, turns: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps; y is -1 or 1."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate, t = 1 / (2 * 2.0 + penalty), 1.0
    for _ in range(turns):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - rate * (penalty * ahead - 2 * x.T @ (weight * y * slack))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = step + (t - 1) / after * (step - w), step, after
    return w


class Model:
    """Machines of all pairs of families, and of all pairs of languages of a family."""

    def __init__(self, x: np.ndarray, languages: np.ndarray):
        self.languages = sorted(set(languages))
        self.family_of = [FAMILY.get(code.lower(), code) for code in self.languages]
        self.families = sorted(set(self.family_of))
        family = np.array([FAMILY.get(code.lower(), code) for code in languages])
        self.levels = [(range(len(self.families)), *self._pairs(x, family, self.families))]
        for name in self.families:
            inside = [i for i, f in enumerate(self.family_of) if f == name]
            own = family == name
            self.levels.append((inside, *self._pairs(x[own], languages[own], [self.languages[i] for i in inside])))

    @staticmethod
    def _pairs(x, labels, names):
        pairs, weights = [], []
        for a, b in combinations(range(len(names)), 2):
            use = (labels == names[a]) | (labels == names[b])
            pairs.append((a, b))
            weights.append(fit_machine(x[use], np.where(labels[use] == names[a], 1, -1).astype(np.float32)))
        return pairs, np.array(weights, np.float32).reshape(len(pairs), x.shape[1] + 1)

    @staticmethod
    def _vote(x, n, pairs, weights):
        """The winner of each row and the chance of its win, from its smallest margin."""
        wins, margins = np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        total = np.zeros((len(x), n))
        if pairs:
            values = x @ weights[:, :-1].T + weights[:, -1]
            for k, (a, b) in enumerate(pairs):
                v = values[:, k]
                wins[:, a] += v >= 0
                wins[:, b] += v < 0
                total[:, a] += v
                total[:, b] -= v
                margins[:, a] = np.minimum(margins[:, a], v)
                margins[:, b] = np.minimum(margins[:, b], -v)
        best = (wins + 1e-3 * np.tanh(total)).argmax(axis=1)
        return best, 1 / (1 + np.exp(-3 * np.minimum(margins[np.arange(len(x)), best], 30)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the predicted languages, and scores."""
        family, score = self._vote(x, len(self.families), *self.levels[0][1:])
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.families)):
            own = family == k
            if own.any():
                inside, pairs, weights = self.levels[k + 1]
                best, chance = self._vote(x[own], len(inside), pairs, weights)
                out[own], score[own] = np.array(inside)[best], score[own] * chance
        return out, score


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS_PER_LANGUAGE) -> Model | None:
    """Learn from at most ``rows`` texts of each language, drawn by a hash of the row; whole texts, as vectors.

    Only the drawn vectors of fixed width come to the driver.
    """
    draw = F.xxhash64(*labelled.columns, F.lit("language"))
    texts = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), draw.alias("draw"))
    texts = texts.where("lang is not null and text is not null")
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(1.5 * rows) / F.col("n"))
    drawn = texts.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "lang")
    drawn = drawn.where(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30))
    order = Window.partitionBy("lang").orderBy("draw")
    drawn = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows)

    @F.arrow_udf("binary")
    def vector(texts: pa.Array) -> pa.Array:
        out = []
        for low, high in text_slices(texts, 1 << 21):
            x, some = features(texts[low:high])
            out += [v.astype(np.float16).tobytes() if s else None for v, s in zip(x, some)]
        return pa.array(out, pa.binary())

    got = drawn.select("lang", "draw", vector("text").alias("x")).where("x is not null").orderBy("lang", "draw").toArrow()
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(got.num_rows, FEATURES).astype(np.float32)
    model = Model(x, np.array(got.column("lang").to_pylist(), dtype=object))
    del x, got
    give_back()
    return model


def with_language(docs: DataFrame, model: Model | None, text: str = "text", out: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Add the predicted language and its score; one pass without a shuffle."""
    docs = docs.drop(out, score)
    if model is None:
        return docs.withColumns({out: F.lit("und"), score: F.lit(0.0)})
    held = shared(docs.sparkSession, model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for low, high in text_slices(texts, 1 << 21):
            part = texts[low:high]
            for at in range(0, len(part), 1024):
                x, some = features(part[at : at + 1024])
                best, chance = held().predict(x)
                langs += [held().languages[b] if s else "und" for b, s in zip(best, some)]
                scores.append(np.where(some, chance, 0.0))
        fields = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
        return pa.StructArray.from_arrays(fields, ["lang", "score"])

    found = "_predicted" + "_" * max(map(len, docs.columns))  # no column has this name
    docs = docs.withColumn(found, predicted(F.col(text)))
    return docs.withColumns({out: F.col(f"{found}.lang"), score: F.col(f"{found}.score")}).drop(found)
