"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are words after lower-casing A-Z; a chain is a sentence (or 256 tokens of a longer one). Each token is clean or toxic. Features of a token are its
hash and those of its first 4 to 8 bytes. Labelled documents label their tokens: a token of a toxic document counts as toxic if one of its features stands
in far more toxic than clean documents. Forward-backward passes give each token's probability; a logistic curve over their sum, maximum and density gives the document's.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` of each class), two thirds for the field and one third, which the field
has not seen, for the curve. Every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W

SAMPLE_ROWS = 1500
BITS = 18
CHAIN = 256
PREFIXES = (4, 5, 6, 7, 8)
OUTSIDE = W.byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SENTENCE_END = W.byte_set()
SENTENCE_END[list(b".!?\n")] = True


@dataclass
class Tokens:
    words: W.Words
    features: np.ndarray  # one row for each kind of feature
    chain_start: np.ndarray
    chain_length: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    low = W.FOLD[data]
    words = W.find_words(low, offsets, OUTSIDE)
    start, end = words.start, words.end
    ends = [end, *[np.minimum(start + k, end) for k in PREFIXES]]
    mask = np.uint64((1 << BITS) - 1)
    sums = W.running_bytes(low)
    features = np.stack([(sums.hashes(start, e) + np.uint64(i + 1)) & mask for i, e in enumerate(ends)]).astype(np.int32) if len(start) else np.zeros((len(ends), 0), np.int32)
    n = len(start)
    if not n:
        return Tokens(words, features, np.zeros(0, np.int64), np.zeros(0, np.int64))
    stops = np.concatenate([SENTENCE_END[data[np.minimum(end, len(data) - 1)]], [True]])[:n]
    new = np.ones(n, bool)
    new[1:] = stops[:-1] | (words.doc[1:] != words.doc[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, n))
    parts = -(-length // CHAIN)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start_at = np.repeat(begin, parts) + step * CHAIN
    return Tokens(words, features, start_at, np.minimum(CHAIN, np.repeat(begin + length, parts) - start_at))


def tokens_of(texts: pa.Array) -> Tokens:
    """Tokens of many texts, found run by run, so that the arrays over bytes stay small."""
    data, offsets = W.text_bytes(texts)
    parts, words, docs = [], 0, 0
    for lo, hi, piece, border in W.pieces(data, offsets):
        t = tokens(piece, border)
        w = t.words
        parts.append((w.start + offsets[lo], w.end + offsets[lo], w.doc + docs, w.first[1:] + words, t.features, t.chain_start + words, t.chain_length))
        words, docs = words + len(w.start), docs + hi - lo
    if not parts:
        return tokens(data, offsets)
    start, end, doc, first, features, chain_start, chain_length = zip(*parts, strict=True)
    whole = W.Words(np.concatenate(start), np.concatenate(end), np.concatenate(doc), np.concatenate([np.zeros(1, np.int64), *first]))
    return Tokens(whole, np.concatenate(features, 1), np.concatenate(chain_start), np.concatenate(chain_length))


def _summed(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Sum of the weights of each token's features, one kind of feature at a time."""
    out = np.zeros(features.shape[1])
    for row in features:
        out += weights[row]
    return out


def forward_backward(odds: np.ndarray, start: np.ndarray, length: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal probability of state 1 for each token; forward and backward odds, which also give the pair marginals.

    Both messages are kept as odds of state 1 over state 0. Chains run side by side, longest first, one position a step.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    ahead, behind = np.ones(len(odds)), np.ones(len(odds))
    now = None
    for t, k in enumerate(alive):
        at = start[:k] + t
        now = odds[at] if t == 0 else odds[at] * (pair[0, 1] + now[:k] * pair[1, 1]) / (pair[0, 0] + now[:k] * pair[1, 0])
        ahead[at] = now = np.clip(now, 1e-12, 1e12)
    for t in range(len(alive) - 2, -1, -1):
        at = start[:alive[t + 1]] + t
        later = odds[at + 1] * behind[at + 1]
        behind[at] = (pair[1, 0] + pair[1, 1] * later) / (pair[0, 0] + pair[0, 1] * later)
    both = ahead * behind
    return both / (1 + both), ahead, behind


@dataclass
class Model:
    """Weights of hashed features, log potentials of state pairs, and the curve over document figures."""

    weights: np.ndarray
    bias: float
    pair: np.ndarray
    curve: np.ndarray

    def marginals(self, t: Tokens) -> np.ndarray:
        x = np.clip(self.bias + _summed(self.weights, t.features), -20, 20)
        return forward_backward(np.exp(x), t.chain_start, t.chain_length, np.exp(self.pair))[0]

    def scores(self, t: Tokens, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_figures(t, m) @ self.curve, -30, 30)))


def _figures(t: Tokens, m: np.ndarray) -> np.ndarray:
    """1, log of the summed probabilities, the largest one, and log of their share of the words."""
    n = len(t.words.first) - 1
    total = np.bincount(t.words.doc, weights=m, minlength=n)
    count = np.diff(t.words.first)
    most = np.zeros(n)
    filled = np.flatnonzero(count)
    if len(filled):
        most[filled] = np.maximum.reduceat(m, t.words.first[filled])
    return np.stack([np.ones(n), np.log1p(total), most, np.log1p(200 * total / np.maximum(count, 1))], 1)


def label_tokens(t: Tokens, toxic: np.ndarray, least_odds: float = 1.7) -> np.ndarray:
    """Labels of tokens from labels of documents: log odds of document counts, for features with enough toxic documents."""
    size = 1 << BITS
    best = np.full(len(t.words.doc), -np.inf)
    for row in t.features:
        seen = np.unique(t.words.doc.astype(np.int64) * size + row)
        feature, doc = seen % size, seen // size
        bad = np.bincount(feature[toxic[doc] == 1], minlength=size)
        good = np.bincount(feature[toxic[doc] == 0], minlength=size)
        odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((1 - toxic).sum() + 1))
        odds[bad < max(3, 0.01 * toxic.sum())] = -np.inf
        best = np.maximum(best, odds[row])
    return (best >= least_odds) & (toxic[t.words.doc] == 1)


def fit_field(t: Tokens, y: np.ndarray, steps: int = 40, rate: float = 0.4, ridge: float = 1e-6) -> Model:
    """Penalised likelihood by adaptive gradient steps over all chains at once."""
    weights, bias, pair = np.zeros(1 << BITS), -3.0, np.zeros((2, 2))
    sums, sum_bias, sum_pair = np.full(1 << BITS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    n = max(1, len(y))
    inner = np.ones(len(y), bool)
    inner[t.chain_start] = False
    at = np.flatnonzero(inner)
    held = np.array([[((y[at - 1] == i) & (y[at] == j)).sum() for j in (0, 1)] for i in (0, 1)]) / n
    for _ in range(steps):
        odds = np.exp(np.clip(bias + _summed(weights, t.features), -20, 20))
        m, ahead, behind = forward_backward(odds, t.chain_start, t.chain_length, np.exp(pair))
        slope = (y - m) / n
        grad = -ridge * weights
        for row in t.features:
            grad += np.bincount(row, weights=slope, minlength=1 << BITS)
        before, after = ahead[at - 1], odds[at] * behind[at]
        e = np.exp(pair)
        total = e[0, 0] + e[0, 1] * after + e[1, 0] * before + e[1, 1] * before * after
        expected = np.array([[(e[0, 0] / total).sum(), (e[0, 1] * after / total).sum()], [(e[1, 0] * before / total).sum(), (e[1, 1] * before * after / total).sum()]])
        grad_pair = held - expected / n
        sums += grad**2
        sum_bias += slope.sum() ** 2
        sum_pair += grad_pair**2
        weights += rate * grad / np.sqrt(sums) * (np.abs(grad) > 1e-9)
        bias += rate * slope.sum() / np.sqrt(sum_bias)
        pair += 0.1 * grad_pair / np.sqrt(sum_pair)
    return Model(weights.astype(np.float32), float(bias), pair, np.zeros(4))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton steps, each halved until the penalised loss falls, so that it ends at the minimum whatever the weights."""
    weight = weight / weight.mean()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w + size * step
        if np.abs(grad).max() < 1e-6 * len(y):
            break
    return w


def fit(texts: pa.Array, toxic: np.ndarray, part: np.ndarray, share: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Model from texts with labels. ``part`` (0, 1, 2) deals texts to the field (0, 1) and the curve (2); ``share`` is what was sampled of clean and of toxic rows.

    Without texts of both classes nothing can be learnt, and every score is the share of toxic rows (0 for no rows).
    """

    def rows(which: np.ndarray) -> tuple[Tokens, np.ndarray]:
        at = np.flatnonzero(which)
        return tokens_of(texts.take(pa.array(at))), toxic[at]

    if len(set(toxic.tolist())) < 2:
        rate = float(np.clip(toxic.mean() if len(toxic) else 0.0, 1e-6, 1 - 1e-6))
        return Model(np.zeros(1 << BITS, np.float32), 0.0, np.zeros((2, 2)), np.array([np.log(rate / (1 - rate)), 0, 0, 0]))
    field = part < 2
    if len(set(toxic[field].tolist())) < 2 or len(set(toxic[~field].tolist())) < 2:
        field = np.ones(len(toxic), bool)
    t, y = rows(field)
    model = fit_field(t, label_tokens(t, y))
    seen, y = rows(~field) if not field.all() else (t, y)
    model.curve = fit_curve(_figures(seen, model.marginals(seen)), y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model from at most ``rows`` labelled documents of each class, those whose key has the smallest hash. Their texts are all that the driver gets."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("__label"))
    known = known.select("__key", "__label", F.xxhash64(F.col("__key").cast("string"), F.lit(9)).alias("__order"))
    counts = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    chosen = None
    for value in (0, 1):
        some = known.filter(F.col("__label") == value).orderBy("__order").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    picked = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__key").withColumn("__part", F.pmod(F.xxhash64("__key", F.lit(3)), F.lit(3)).cast("int"))
    got = picked.dropDuplicates(["__key"]).orderBy("__order").select("__text", "__label", "__part").toArrow().combine_chunks()
    column = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns]
    share = tuple(min(1.0, rows / max(1, counts.get(v, 0))) for v in (0, 1))
    return fit(column[0], np.asarray(column[1]), np.asarray(column[2]), share)


def tag(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", cut: float = 0.5) -> DataFrame:
    """One row per input row: the key, ``score``, and ``spans``: start and end of toxic runs, in code points of the text.

    A null text is an empty one; it gets the score of a text without tokens. Rows are scored one by one, so repeated rows get equal results. The
    weights, whose size is fixed (2**18 numbers), go to the tasks; no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for lo, hi, data, offsets in W.pieces(*W.text_bytes(batch.column(1))):
                t = tokens(data, offsets)
                m = model.marginals(t)
                hot = np.flatnonzero(m >= cut)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(hot) else np.zeros(1, np.int64)
                first = np.ones(len(hot), bool)
                first[1:] = (hot[1:] != hot[:-1] + 1) | (t.words.doc[hot[1:]] != t.words.doc[hot[:-1]])
                last = np.append(first[1:], True)[:len(hot)]
                doc = t.words.doc[hot[first]]
                base = points[offsets[doc]] if len(hot) else doc
                begin, end = (points[t.words.start[hot[first]]] - base, points[t.words.end[hot[last]]] - base) if len(hot) else (doc, doc)
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["start", "end"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.scores(t, m), pa.float64()), spans], names=[key, "score", "spans"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, score double, spans array<struct<start:long,end:long>>")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows whose score is below ``cut``, with all their columns. Scored where they are read; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.pieces(*W.text_bytes(batch.column(place))):
                t = tokens(data, offsets)
                yield batch.slice(lo, hi - lo).filter(pa.array(sent.value.scores(t, sent.value.marginals(t)) < cut))

    return docs.mapInArrow(run, docs.schema)
