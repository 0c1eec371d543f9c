"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; the unlabelled set is web text as it comes, its labels
unseen. The class prior is estimated from the scores of all rows outside the held-out fold, counted
in fixed bins, and of held-aside positives (best-bin estimate: the least ratio of upper-tail
shares of unlabelled and held-aside positive scores), and a logistic scorer minimises the
non-negative unbiased risk  prior * R+(p) + max(0, R-(u) - prior * R-(p)); whenever the second part
turns negative, the step goes up on that part alone. Texts are described by byte-class shares,
word repetition and compressibility, all over the whole text.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, blobs, fold, share

#: Rows a fit may gather, for the positives and for the unlabelled texts each.
FIT_ROWS = 3000
THRESHOLD = 0.3
#: Bins of unsquashed scores from -REACH to REACH, in which all unlabelled rows are counted.
BINS, REACH = 4096, 32.0

_CLASSES = np.full(256, 9, np.int64)  # 9: other symbols
_CLASSES[[*b"abcdefghijklmnopqrstuvwxyz"]] = 0
_CLASSES[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASSES[[*b"0123456789"]] = 2
_CLASSES[[*b" \t"]] = 3
_CLASSES[[*b"\n\r\x0b\x0c"]] = 4
_CLASSES[[*b".,;:'\"-()"]] = 5
_CLASSES[[*b"!?"]] = 6
_CLASSES[0x80:0xC0] = 7
_CLASSES[0xC0:] = 8
N_CLASSES = 10
_WHITE = re.compile(rb"\s")
FEATURES = N_CLASSES + 8


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text in lists of bounded size (but for a longer word)."""
    at = 0
    while at < len(text):
        m = _WHITE.search(text, at + (1 << 20))
        end = m.start() if m else len(text)
        words = text[at:end].lower().split()
        if words:
            yield words
        at = end


def features(text: bytes) -> np.ndarray:
    """The description of one whole text; zeros for an empty one."""
    x = np.zeros(FEATURES)
    if not text:
        return x
    counts = np.zeros(N_CLASSES)
    packer, packed = zlib.compressobj(1), 0
    for at in range(0, len(text), 1 << 20):
        part = text[at : at + (1 << 20)]
        counts += np.bincount(_CLASSES[np.frombuffer(part, np.uint8)], minlength=N_CLASSES)
        packed += len(packer.compress(part))
    packed += len(packer.flush())
    letters = counts[0] + counts[1] + counts[8]
    x[:N_CLASSES] = np.sqrt(counts / len(text))
    n = again = single = 0
    seen: set[bytes] = set()
    last = None
    for lower in _words(text):
        n += len(lower)
        again += (lower[0] == last) + sum(map(operator.eq, lower, lower[1:]))
        single += sum(map((1).__eq__, map(len, lower)))
        seen.update(lower)
        last = lower[-1]
    n = max(1, n)
    again, fresh = again / n, len(seen) / n
    x[N_CLASSES:] = (
        counts[1] / max(1.0, letters),
        min(1.0, counts[9] / n),
        min(1.0, counts[6] / n),
        np.sqrt(again),
        max(0.0, 0.3 - fresh) if n > 30 else 0.0,
        max(0.0, 0.35 - packed / len(text)) if len(text) > 200 else 0.0,
        min(1.0, (len(text) / n) / 20),
        single / n,
    )
    return x


@dataclass
class Model:
    """Scaling, weights and the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _adam(x: np.ndarray, gradient, steps: int, rate: float) -> tuple[np.ndarray, float]:
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w[:-1], w[-1])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _grad(x: np.ndarray, slope: np.ndarray) -> np.ndarray:
    return np.append(x.T @ slope, slope.sum()) / max(1, len(x))


def estimate_prior(p: np.ndarray, u: np.ndarray, confidence: float = 1.0) -> float:
    """Share of positives among unlabelled scores u, given scores p of held-aside positives: the
    least upper bound over thresholds of the ratio of upper-tail shares."""
    if not len(p) or not len(u):
        return 0.5
    cut = np.unique(np.quantile(p, np.linspace(0, 0.9, 91)))
    tail_p, tail_u = (1 - np.searchsorted(np.sort(s), cut, "left") / len(s) for s in (p, u))
    slack = confidence * (np.sqrt(0.5 / len(p)) + np.sqrt(0.5 / len(u)))
    ok = tail_p > 0.05
    bound = (tail_u + slack) / tail_p
    best = np.flatnonzero(ok)[bound[ok].argmin()]
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def bins(z: np.ndarray) -> np.ndarray:
    """The bin of each unsquashed score."""
    return np.clip((z + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)


#: Counts by bin of the unsquashed scores of all unlabelled rows, given (mean, scale, weight, bias).
Counted = Callable[[np.ndarray, np.ndarray, np.ndarray, float], np.ndarray]


def binned_prior(p: np.ndarray, counts: np.ndarray, confidence: float = 1.0) -> float:
    """As estimate_prior, of unlabelled scores that are counted by bin; thresholds are edges of bins."""
    total = int(counts.sum())
    if not len(p) or not total:
        return 0.5
    mine = np.bincount(bins(p), minlength=BINS)
    tail_p, tail_u = np.cumsum(mine[::-1])[::-1] / len(p), np.cumsum(counts[::-1])[::-1] / total
    ok = np.flatnonzero(tail_p >= 0.1)
    bound = (tail_u[ok] + confidence * (np.sqrt(0.5 / len(p)) + np.sqrt(0.5 / total))) / tail_p[ok]
    best = ok[bound.argmin()]
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def train(p: np.ndarray, u: np.ndarray, steps: int = 600, rate: float = 0.05, ridge: float = 1e-3, counted: Counted | None = None) -> Model:
    """Fit on the features of positives and of unlabelled texts. Deterministic. The prior is that
    of all rows, if `counted` gives their scores, else that of half of u."""
    both = np.vstack([p, u])
    if not len(p) or not len(u):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.5)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = np.clip((p - mean) / scale, -8, 8), np.clip((u - mean) / scale, -8, 8)
    half = np.arange(len(p)) % 2 == 0
    fit_p, ask_p = p[half], p[~half]
    half = np.arange(len(u)) % 2 == 0
    fit_u, ask_u = u[half], u[~half]
    w, b = _adam(p, lambda w, b: _grad(fit_p, -_sigmoid(-(fit_p @ w + b))) + _grad(fit_u, _sigmoid(fit_u @ w + b)) + ridge * np.append(w, 0), 200, rate)
    prior = binned_prior(ask_p @ w + b, counted(mean, scale, w, float(b))) if counted else estimate_prior(ask_p @ w + b, ask_u @ w + b)

    def gradient(w: np.ndarray, b: float) -> np.ndarray:
        zp, zu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = _grad(u, _sigmoid(zu)) - prior * _grad(p, _sigmoid(zp))
        if negative < 0:
            return -g_negative
        return prior * _grad(p, -_sigmoid(-zp)) + g_negative + ridge * np.append(w, 0)

    w, b = _adam(p, gradient, steps, rate)
    return Model(mean, scale, w, float(b), prior)


def _describe(docs: DataFrame) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in blobs(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "good", "x"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("good").cast("boolean").alias("good"), F.col("text").cast("string").alias("text")), kernel, "doc_id long, good boolean, x array<double>")


def count_scores(docs: DataFrame, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """How many rows of docs (text) have a score in each bin."""
    held = docs.sparkSession.sparkContext.broadcast((mean, scale, weight, bias))  # a few dozen numbers

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, weight, bias = held.value
        for b in batches:
            x = np.array([features(t) for t in blobs(b.column(0))]).reshape(-1, FEATURES)
            yield pa.record_batch([pa.array(bins(np.clip((x - mean) / scale, -8, 8) @ weight + bias))], names=["bin"])

    out = np.zeros(BINS, np.int64)
    for r in arrow(docs.select(F.col("text").cast("string").alias("text")), kernel, "bin long").groupBy("bin").count().collect():
        out[r["bin"]] = r["count"]
    return out


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = FIT_ROWS) -> Model:
    """Fit on docs (doc_id, text) and labels (doc_id, quality) whose crc32(doc_id) mod folds is not
    0: about `most` positives and `most` texts taken as unlabelled, each chosen by a hash. The prior
    is estimated from the scores of all rows of docs outside that fold."""
    seen = docs.where("doc_id is not null").where(fold("doc_id", folds) != 0)
    good = labels.where("quality = 1").where(fold("doc_id", folds) != 0).select("doc_id").distinct()
    n_good, n_all = good.count(), seen.count()
    if n_good > most:
        good = good.where(share(F.col("doc_id"), 0.95 * most / n_good, 1))
    wild = seen if n_all <= most else seen.where(share(F.col("doc_id"), 0.95 * most / n_all, 2))
    # `good` has at most about `most` ids: the bound that lets it be broadcast.
    rows = seen.join(F.broadcast(good), "doc_id").select("doc_id", F.lit(True).alias("good"), "text").unionByName(wild.select("doc_id", F.lit(False).alias("good"), "text"))
    got = _describe(rows).toArrow().sort_by([("doc_id", "ascending"), ("good", "ascending")])
    x = np.array(got.column("x").to_pylist()).reshape(-1, FEATURES)
    mark = got.column("good").to_numpy(zero_copy_only=False).astype(bool)
    return train(x[mark], x[~mark], counted=lambda *scorer: count_scores(seen, *scorer))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1, higher: likelier good) and `predicted` (1 if score >= threshold).

    Only doc_id and text are read. Null and empty texts are scored from zero features; equal rows
    are all scored; an empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen numbers

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            x = np.array([features(t) for t in blobs(b.column(1))]).reshape(-1, FEATURES)
            s = m.score(x)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), kernel, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            x = np.array([features(t) for t in blobs(b.column(at))]).reshape(-1, FEATURES)
            yield b.filter(pa.array(m.score(x) >= threshold))

    return arrow(docs, kernel, docs.schema)
