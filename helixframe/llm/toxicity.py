"""Operator 9: toxicity by character n-grams, a linear classifier on features scaled by naive Bayes log-count ratios.

Texts are lower-cased and taken as characters (code points). A feature is the presence of a string of 3 to 7 of them. Its log-count
ratio compares its share among toxic and other training documents. Features whose ratio could be chance are dropped;
a logistic regression with an L2 penalty is trained on the ratios of those present. Training reads at most SAMPLE documents of each class,
those of the smallest hashes of their ids, and drops near copies among them; scoring reads every whole text.

Defined cases: null and empty texts have no feature and get the score of that; without labelled rows of both classes, or
without features, every score is 0; null doc_ids, repeated rows and empty tables are scored like others; null labels don't count; other
columns are not read.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ORDERS = range(3, 8)
#: Training documents of each class at most; bytes of texts of a class at most; a feature's documents at least; its z value at least.
#: The last two were chosen by threefold validation on the training rows of sf0.1 (area under the curve; toxic found at the threshold;
#: clean ones taken for toxic): z 5, 0.969, 0.830, 0.015; z 4, 0.985, 0.848, 0.014; z 3, 0.983, 0.854, 0.011; z 2, 0.974, 0.839, 0.008;
#: z 3 with 3 documents, 0.981, 0.848, 0.012; with 12, 0.971, 0.821, 0.022.
SAMPLE, SAMPLE_BYTES, LEAST_DOCS, LEAST_Z = 1500, 12_000_000, 6, 3.0
THRESHOLD, PENALTY, SMOOTHING = 0.3, 1.0, 1.0
_BITS, _BLOCK = 20, 1 << 18
_BASE = 0x9E3779B97F4A7C15


def grams(text: str):
    """(n, hashes of the n-grams of that length), by blocks of a long text."""
    data = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(1, len(data)), _BLOCK):
        x = (data[at : at + _BLOCK + ORDERS[-1] - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        h, power = np.zeros(len(x) + 1, np.uint64), 1
        for n in range(1, ORDERS[-1] + 1):
            if len(x) < n:
                break
            h = h[:-1] * np.uint64(_BASE) + x[n - 1 :]
            if n in ORDERS:
                yield n, h[: min(_BLOCK, len(h))] * np.uint64(2 * n + 1)


@dataclasses.dataclass
class Model:
    """Sorted feature hashes with their weights; an empty model scores 0."""

    features: np.ndarray
    weights: np.ndarray
    bias: float | None

    def __post_init__(self):
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.features >> np.uint64(64 - _BITS)] = True

    def present(self, text: str) -> np.ndarray:
        """Indexes of the features in a text, each once."""
        found = []
        for _, h in grams(text):
            h = h[self.seen[h >> np.uint64(64 - _BITS)]]
            if len(h):
                found.append(h)
        if not found or not len(self.features):
            return np.empty(0, np.int64)
        h = np.concatenate(found)
        i = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        return np.unique(i[self.features[i] == h])

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        z = self.bias + float(self.weights[self.present(text or "")].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


EMPTY = Model(np.empty(0, np.uint64), np.empty(0), None)


def _distinct(texts: list[str]) -> list[str]:
    """Without texts that share two or more of eight smallest 7-gram hashes with an earlier one."""
    seen: list[set[int]] = [set() for _ in range(8)]
    out = []
    for t in texts:
        h = [x for n, x in grams(t) if n == ORDERS[-1]]
        if not h:
            out.append(t)
            continue
        every = np.concatenate(h)
        marks = [int((every * np.uint64(2 * k + 3) ^ np.uint64(0x51ED2701 * (k + 1))).min()) for k in range(8)]
        if sum(m in s for m, s in zip(marks, seen, strict=True)) < 2:
            out.append(t)
            for m, s in zip(marks, seen, strict=True):
                s.add(m)
    return out


def train(toxic: list[str], other: list[str], share: float) -> Model:
    """share: the part of toxic documents among all labelled ones, for the bias."""
    toxic, other = _distinct(toxic), _distinct(other)
    if not toxic or not other:
        return EMPTY
    texts, n, m = [*toxic, *other], len(toxic), len(other)
    kept_h, kept_r = [], []
    for order in ORDERS:
        counted: dict[bool, tuple] = {}
        for which, group in ((True, toxic), (False, other)):
            runs = []
            for t in group:
                if own := [h for k, h in grams(t) if k == order]:
                    runs.append(np.unique(np.concatenate(own)))
            counted[which] = np.unique(np.concatenate(runs) if runs else np.empty(0, np.uint64), return_counts=True)
        (a, ca), (b, cb) = counted[True], counted[False]
        h = np.union1d(a[ca >= LEAST_DOCS], b[cb >= LEAST_DOCS])
        p, q = _counts(h, a, ca), _counts(h, b, cb)
        r = np.log((p + SMOOTHING) / (n + 2 * SMOOTHING)) - np.log((q + SMOOTHING) / (m + 2 * SMOOTHING))
        pool = (p + q) / (n + m)
        z = np.abs(p / n - q / m) / np.sqrt(pool * (1 - pool) * (1 / n + 1 / m) + 1e-12)
        good = z >= LEAST_Z
        kept_h.append(h[good])
        kept_r.append(r[good])
    h, r = np.concatenate(kept_h), np.concatenate(kept_r)
    order = np.argsort(h)
    model = Model(h[order], r[order], 0.0)
    rows = [model.present(t) for t in texts]
    weights, bias = _logistic(rows, model.weights, np.r_[np.ones(n), np.zeros(m)])
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(model.features, weights * model.weights, bias + float(np.log(share / (1 - share)) - np.log(n / m)))


def _counts(wanted: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[i] == wanted, counts[i], 0).astype(float)


def _logistic(rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights of features scaled by their ratios, by accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows) if len(at) else np.empty(0, np.int64)
    value = ratios[feature]
    rate = 4 / (1 + (max([1.0, *np.bincount(at, value**2, len(rows)).tolist()])))
    w, bias, old_w, old_b = np.zeros(len(ratios)), 0.0, np.zeros(len(ratios)), 0.0
    for k in range(steps):
        push = k / (k + 3)
        v, c = w + push * (w - old_w), bias + push * (bias - old_b)
        z = np.bincount(at, value * v[feature], len(rows)) + c
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        old_w, old_b = w, bias
        w = v - rate * (np.bincount(feature, value * g[at], len(ratios)) + PENALTY / len(rows) * v)
        bias = c - rate * g.sum()
    return w, float(bias)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labels (doc_id, toxic) of rows that are not held out; at most sample documents of each class reach the driver."""
    known = labels.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`toxic`").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    total = {r.toxic: r["count"] for r in known.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if len(total) < 2:
        return EMPTY
    texts: dict[int, list[str]] = {}
    for label in (1, 0):
        ids = known.where(F.col("toxic") == label).select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(sample)
        rows = docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").alias("text")).join(F.broadcast(ids), "doc_id")  # sample ids at most
        got = rows.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("h").alias("h")).select("h", "doc_id", F.octet_length("text").alias("n"), "text")
        held, out = 0, []
        for r in sorted(got.toLocalIterator(), key=lambda r: (r.h, r.doc_id)):
            held += r.n
            if out and held > SAMPLE_BYTES:
                break
            out.append(r.text)
        texts[label] = out
    return train(texts[1], texts[0], total[1] / (total[0] + total[1]))


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), scorer(model)(F.col("`text`").cast("string")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns."""
    (name,) = fresh(docs, "score")
    out = docs.withColumn(name, scorer(model)(F.col("`text`").cast("string"))).where(F.col(name) < THRESHOLD)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
