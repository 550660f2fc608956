"""Toxicity by a bidirectional gated recurrent network with attention, over words and their letters.

A word's input is a hashed word embedding beside the mean of hashed embeddings of its letter trigrams.
Windows of ``WINDOW`` words that overlap by half cover the whole text; in each, two gated recurrent
layers (one per direction) are pooled by attention into a logit. A text's logit is that of its worst
window; a logistic curve fitted on texts kept apart turns it into the score.

The network is trained in numpy on a bounded sample (``TRAIN_ROWS`` labelled texts of at most
``TRAIN_CHARS`` characters, half of them toxic if there are as many, drawn by a hash of the key): a
toxic text teaches through its worst window, another through its worst and a random one. Scoring is
one pass without a shuffle; inputs are projected once per different word of a slice.

Defined cases: texts without words (null, empty) score 0; without labels of both kinds every text
scores 0; a key with several labels counts as toxic if one is; a key with several texts teaches by
the smallest; repeated rows get equal scores; no rows give no rows; other columns are kept, except
one named like the output, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import give_back, hash_texts, plain_words, shared, text_slices

WINDOW, STRIDE = 32, 16
WORD_BUCKETS, LETTER_BUCKETS = 1 << 16, 1 << 12
WORD_DIM, LETTER_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
TRAIN_ROWS, TRAIN_CHARS = 3000, 200_000
STEPS, RESELECT, BATCH, RATE = 600, 150, 128, 0.01
EMPTY = -30.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Buckets of the different words of some texts, and of their letter trigrams (one run per word)."""

    def __init__(self, words: list[str]):
        hashes = hash_texts(pa.array(words, pa.large_string()))
        self.word = (hashes >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
        codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths + 2)
        key = np.zeros(max(0, len(codes) - 2), np.uint64)
        for i in range(3):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(key)] + np.uint64(i)
        bucket = ((key * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)).astype(np.int64) % LETTER_BUCKETS
        # A word of n letters has n trigrams with its marks; those that reach into the next word go.
        use = np.ones(len(key), bool)
        for back in (2, 1):
            last = ends - back
            use[last[last < len(key)]] = False
        self.letter, self.n_letter = bucket[use], np.maximum(lengths, 1)
        self.first = np.concatenate(([0], np.cumsum(lengths)))[:-1]

    def inputs(self, model: dict) -> np.ndarray:
        if not len(self.word):
            return np.zeros((0, WORD_DIM + LETTER_DIM), model["word"].dtype)
        letters = np.add.reduceat(model["letter"][self.letter], self.first, axis=0) / self.n_letter[:, None]
        return np.hstack((model["word"][self.word], letters.astype(model["word"].dtype)))

    def give_back(self, grads: dict, d: np.ndarray) -> None:
        np.add.at(grads["word"], self.word, d[:, :WORD_DIM])
        share = (d[:, WORD_DIM:] / self.n_letter[:, None]).repeat(np.diff(np.append(self.first, len(self.letter))), axis=0)
        np.add.at(grads["letter"], self.letter, share)


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions ``(windows, WINDOW)`` (-1 beyond the text) of all overlapping windows, their text, and each text's first."""
    n = np.diff(offsets)
    many = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    first = np.cumsum(many) - many
    start = ((np.arange(len(text)) - first[text]) * STRIDE).astype(np.int32)
    position = start[:, None] + np.arange(WINDOW, dtype=np.int32)[None, :]
    beyond = position >= n[text].astype(np.int32)[:, None]
    position += offsets[text].astype(np.int32)[:, None]
    position[beyond] = -1
    return position, text, first


def codes_of(position: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Word numbers at the positions, -1 beyond the text."""
    codes = np.append(numbers, -1).astype(np.int32)
    return codes[position]


def new_model(seed: int = 11) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    normal = lambda *shape, scale: draw.normal(size=shape) * scale
    inputs = WORD_DIM + LETTER_DIM
    model = {"word": normal(WORD_BUCKETS, WORD_DIM, scale=0.1), "letter": normal(LETTER_BUCKETS, LETTER_DIM, scale=0.1)}
    for side in "fb":
        model[f"{side}_in"] = normal(inputs, 3 * HIDDEN, scale=0.3)
        model[f"{side}_state"] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
        model[f"{side}_bias"] = np.zeros(3 * HIDDEN)
    model |= {"look": normal(2 * HIDDEN, ATTENTION, scale=0.3), "weigh": normal(ATTENTION, scale=0.3)}
    return model | {"out": normal(2 * HIDDEN, scale=0.3), "bias": np.zeros(1)}


def _layer(model: dict, side: str, projected: np.ndarray, codes: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction, ``(WINDOW, windows, HIDDEN)``; code -1 leaves the state as it is."""
    state, h = model[f"{side}_state"], HIDDEN
    now = np.zeros((codes.shape[0], h), state.dtype)
    out = np.empty((WINDOW, codes.shape[0], h), state.dtype)
    order = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
    for t in order:
        x, s = projected[codes[:, t]], now @ state
        gates = 1 / (1 + np.exp(-(x[:, : 2 * h] + s[:, : 2 * h])))
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
        after = new + z * (now - new)
        padded = codes[:, t] < 0
        if padded.any():
            after[padded] = now[padded]
        if keep is not None:
            keep.append((t, now, z, r, new, s[:, 2 * h :]))
        now = after
        out[t] = now
    return out


def project(model: dict, inputs: np.ndarray) -> list[np.ndarray]:
    """What each word adds to the gates of either direction; the last row serves the code -1."""
    zero = np.zeros((1, 3 * HIDDEN), inputs.dtype)
    return [np.vstack((inputs @ model[f"{side}_in"] + model[f"{side}_bias"], zero)) for side in "fb"]


def forward(model: dict, projected: list[np.ndarray], codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows given as word numbers (-1 beyond the text)."""
    states, codes = [], codes.astype(np.intp)
    for side, own in zip("fb", projected):
        steps: list | None = None if keep is None else []
        states.append(_layer(model, side, own, codes, steps))
        if keep is not None:
            keep[side] = steps
    both = np.concatenate(states, axis=2)
    looked = np.tanh(both @ model["look"])
    weight = looked @ model["weigh"]
    weight = np.where(codes.T >= 0, weight, -np.inf)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * both).sum(axis=0)
    if keep is not None:
        keep |= {"both": both, "looked": looked, "weight": weight, "pooled": pooled}
    return pooled @ model["out"] + model["bias"][0]


def gradients(model: dict, words: Vocabulary, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean log loss of windows and its gradient for every parameter."""
    keep: dict = {}
    inputs = words.inputs(model)
    logits = forward(model, project(model, inputs), codes, keep)
    p = _sigmoid(logits)
    loss = float(np.mean(np.logaddexp(0, logits) - labels * logits))
    grads = {k: np.zeros_like(v) for k, v in model.items()}
    d_logit = (p - labels) / len(labels)
    both, looked, weight, pooled = (keep[k] for k in ("both", "looked", "weight", "pooled"))
    grads["out"], grads["bias"][0] = pooled.T @ d_logit, d_logit.sum()
    d_pooled = d_logit[:, None] * model["out"]
    d_both = weight[:, :, None] * d_pooled
    d_weight = (both * d_pooled).sum(axis=2)
    d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grads["weigh"] = np.einsum("twa,tw->a", looked, d_weight)
    d_looked = d_weight[:, :, None] * model["weigh"] * (1 - looked**2)
    grads["look"] = np.einsum("twh,twa->ha", both, d_looked)
    d_both += d_looked @ model["look"].T
    d_inputs = np.zeros((len(inputs) + 1, inputs.shape[1]))
    for k, side in enumerate("fb"):
        state, h = model[f"{side}_state"], HIDDEN
        d_states, d_next = d_both[:, :, k * h : (k + 1) * h], np.zeros((codes.shape[0], h))
        d_projected = np.zeros((len(inputs) + 1, 3 * h))
        for t, before, z, r, new, s_new in reversed(keep[side]):
            real = (codes[:, t] >= 0)[:, None]
            d_all = d_states[t] + d_next
            d = np.where(real, d_all, 0)
            d_new = d * (1 - z) * (1 - new**2)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * s_new * r * (1 - r)
            d_s = np.hstack((d_z, d_r, d_new * r))
            np.add.at(d_projected, codes[:, t], np.hstack((d_z, d_r, d_new)))
            grads[f"{side}_state"] += before.T @ d_s
            d_next = np.where(real, d * z + d_s @ state.T, d_all)
        d_projected = d_projected[:-1]
        grads[f"{side}_in"], grads[f"{side}_bias"] = inputs.T @ d_projected, d_projected.sum(axis=0)
        d_inputs[:-1] += d_projected @ model[f"{side}_in"].T
    words.give_back(grads, d_inputs[:-1])
    return loss, grads


def worst(model: dict, words: Vocabulary, codes: np.ndarray, text: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the highest window logit (``EMPTY`` without words) and the number of that window."""
    projected = project(model, words.inputs(model))
    logits = np.empty(len(codes), projected[0].dtype)
    for at in range(0, len(codes), 2048):
        logits[at : at + 2048] = forward(model, projected, codes[at : at + 2048])
    return _highest(logits, text, first, some)


def _highest(values: np.ndarray, text: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top, which = np.full(len(some), EMPTY, values.dtype), np.full(len(some), -1)
    if some.any():
        top[some] = np.maximum.reduceat(values, first[some])
        # The first window with the highest value.
        hits = np.nonzero(values == top[text])[0]
        which[text[hits][::-1]] = hits[::-1]
    return top.astype(np.float64), which


def _numbered(texts: list[str]) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    words, offsets = plain_words(pa.array(texts, pa.large_string()))
    coded = words.dictionary_encode()
    return Vocabulary(coded.dictionary.to_pylist()), coded.indices.to_numpy().astype(np.int64), offsets


def fit_network(texts: list[str], labels: np.ndarray, toxic_share: float, seed: int = 11) -> dict | None:
    """Train on texts and labels; a fifth of them is kept apart to fit the logistic curve of the score.

    ``toxic_share`` is the share of toxic texts among all labelled ones.
    """
    if len(set(labels.tolist())) < 2:
        return None
    draw = np.random.default_rng(seed)
    apart = np.zeros(len(texts), bool)
    for kind in (0, 1):
        own = draw.permutation(np.nonzero(labels == kind)[0])
        apart[own[: len(own) // 5]] = True
    words, numbers, offsets = _numbered(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    model = new_model(seed)
    # Words start from how much likelier toxic texts hold them.
    learn = ~apart[text_of]
    seen = np.unique(text_of[learn] * WORD_BUCKETS + words.word[numbers[learn]])
    held = [np.bincount((seen % WORD_BUCKETS)[labels[seen // WORD_BUCKETS] == k], minlength=WORD_BUCKETS) for k in (0, 1)]
    n = [max(1, ((labels == k) & ~apart).sum()) for k in (0, 1)]
    model["word"][:, 0] = np.clip(np.log((held[1] + 1) / (n[1] + 2)) - np.log((held[0] + 1) / (n[0] + 2)), -3, 3)
    model["word"][(held[0] + held[1]) == 0, 0] = 0
    position, text, first = windows_of(offsets)
    some = np.diff(offsets) > 0
    codes = codes_of(position, numbers)
    del position, numbers, seen, text_of, learn
    # At first the worst window is the one with the most telling word.
    lead = np.append(model["word"][words.word, 0], EMPTY).astype(np.float32)
    _, which = _highest(np.array([lead[c].max() for c in codes], np.float32), text, first, some)
    train = np.nonzero(some & ~apart)[0]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    clean = np.nonzero((labels[text] == 0) & ~apart[text])[0]
    chosen = train[:0]
    for step in range(1, STEPS + 1):
        if step % RESELECT == 0:
            _, which = worst(_single(model), words, codes, text, first, some)
            chosen = chosen[:0]
        if len(chosen) < BATCH:
            other = draw.choice(clean, min(len(clean), len(train) // 2), replace=False) if len(clean) else clean
            chosen = draw.permutation(np.concatenate((which[train], other)))
        part, chosen = chosen[:BATCH], chosen[BATCH:]
        used, local = np.unique(codes[part], return_inverse=True)
        local = local.reshape(len(part), WINDOW) - (used[0] < 0)
        _, grads = gradients(model, _subset(words, used[used >= 0]), local, labels[text[part]].astype(float))
        rate = RATE * (1 - step / STEPS) + 1e-4
        for k, g in grads.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            model[k] = model[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = _single(model)
    top, _ = worst(model, words, codes, text, first, some)
    use = apart & some if (apart & some).sum() >= 20 and len(set(labels[apart & some].tolist())) == 2 else some
    balance = np.where(labels == 1, toxic_share / max(labels.mean(), 1e-9), (1 - toxic_share) / max(1 - labels.mean(), 1e-9))
    return model | {"curve": _curve(top[use], labels[use].astype(float), balance[use])}


def _single(model: dict) -> dict:
    return {k: v.astype(np.float32) for k, v in model.items()}


def _subset(words: Vocabulary, numbers: np.ndarray) -> Vocabulary:
    own = Vocabulary([])
    lengths = np.diff(np.append(words.first, len(words.letter)))[numbers]
    own.word, own.n_letter = words.word[numbers], words.n_letter[numbers]
    own.first = np.cumsum(lengths) - lengths
    own.letter = words.letter[np.repeat(words.first[numbers] - own.first, lengths) + np.arange(lengths.sum())]
    return own


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic curve: damped Newton steps, with a small pull towards slope 1 and offset 0."""
    w = np.array([1.0, 0.0])
    design = np.stack((x, np.ones_like(x)), axis=1)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * ((w - [1, 0]) ** 2).sum())

    for _ in range(50):
        p = _sigmoid(design @ w)
        g = design.T @ (weight * (p - y)) + 0.1 * (w - [1, 0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step, rate = np.linalg.solve(hessian, g), 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
    return np.array([max(w[0], 0.05), w[1]])


def scores(model: dict, texts: pa.Array) -> np.ndarray:
    """Score of each text, 0 to 1."""
    words, offsets = plain_words(texts)
    coded = words.dictionary_encode()
    position, text, first = windows_of(offsets)
    codes, some = codes_of(position, coded.indices.to_numpy()), np.diff(offsets) > 0
    top, _ = worst(model, Vocabulary(coded.dictionary.to_pylist()), codes, text, first, some)
    slope, offset = model["curve"]
    return np.where(some, _sigmoid(slope * top + offset), 0.0)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", use: Column | None = None, rows: int = TRAIN_ROWS) -> dict | None:
    """Train on a bounded sample of the labelled documents; ``use`` tells which keys may teach."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    if use is not None:
        known = known.withColumnRenamed("key", key).where(use).withColumnRenamed(key, "key")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    draw = F.xxhash64("key", F.lit("toxicity"))
    toxic = min(counts[1], rows // 2)
    parts = [known.where(F.col("label") == k).orderBy(draw, "key").limit(n) for k, n in ((1, toxic), (0, rows - toxic))]
    sample = F.broadcast(parts[0].union(parts[1]))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.char_length("text") <= TRAIN_CHARS)
    texts = texts.join(sample, "key").groupBy("key").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    got = texts.orderBy("key").toArrow()
    if not got.num_rows:
        return None
    label, texts = np.array(got.column("label").to_pylist()), got.column("text").to_pylist()
    del got
    model = fit_network(texts, label, counts[1] / (counts[0] + counts[1]))
    del texts
    give_back()  # the driver has other work to do
    return model


def with_toxicity(docs: DataFrame, model: dict | None, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add the score of the whole text."""
    docs = docs.drop(out)
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    held = shared(docs.sparkSession, model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [scores(held(), texts[low:high]) for low, high in text_slices(texts, 1 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, scored(F.col(text)))
