"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit of the code a binary classifier on hashed byte n-grams
(1 to 3 bytes of the lower-cased text, white space folded) predicts that bit. A text's margins are
decoded to the codeword of least logistic loss, and a small gap between the best two flags the
text as ambiguous. With K languages of up to seven the code is exhaustive (2^(K-1)-1 bits); beyond,
it is the random dense code of largest minimum distance among a fixed number of draws.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, blobs, fold

BUCKETS = 1 << 13
#: Rows with a label that a fit may gather: bounds the driver's memory, not what is scored. A language
#: has a share of LEAST_ROWS at least, however many languages there are.
FIT_ROWS, LEAST_ROWS = 4000, 20
UNKNOWN = "und"
AMBIGUOUS = 0.2
_LETTER = regex.compile(r"\p{L}")
_SPACE = regex.compile(rb"[\s\d]+")
_PIECE = 1 << 16


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 / -1; any two rows differ in about half of the bits."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        cols = np.arange(1, bits + 1)
        return np.vstack([np.ones(bits), *(1 - 2 * ((cols >> i) & 1) for i in range(n - 1))]).astype(float)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, gap = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, length))
        distance = (length - code @ code.T) / 2
        np.fill_diagonal(distance, length)
        if distance.min() > gap and (np.abs(code.sum(0)) < n).all():
            best, gap = code, distance.min()
    return best


def profile(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Unit vector of damped hashed n-gram counts of a whole text; zero if it has none."""
    total = np.zeros(buckets)
    clean = b" " + _SPACE.sub(b" ", text.decode("utf-8", "replace").lower().encode()).strip() + b" "
    for at in range(0, len(clean) - 2, _PIECE):
        b = np.frombuffer(clean[at : at + _PIECE + 2], np.uint8).astype(np.uint32)
        for gram in (b[1:-1], b[:-1] | b[1:] << 8 | np.uint32(1 << 24), b[:-2] | b[1:-1] << 8 | b[2:] << 16 | np.uint32(2 << 24)):
            total += np.bincount(gram * np.uint32(2654435761) >> np.uint32(32 - int(buckets).bit_length() + 1), minlength=buckets)
    x = np.sqrt(total)
    norm = np.linalg.norm(x)
    return x / norm if norm else x


@dataclass
class Model:
    """Languages, their codewords, and one linear classifier for each bit."""

    names: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the loss-weighted vote, and the gap to the second, by row."""
        if not self.names:
            return np.zeros(len(x), int), np.zeros(len(x)), np.zeros(len(x))
        margin = x @ self.weight + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(2)
        vote = np.exp(loss.min(1, keepdims=True) - loss)
        vote /= vote.sum(1, keepdims=True)
        order = np.sort(vote, 1)
        gap = order[:, -1] - (order[:, -2] if vote.shape[1] > 1 else 0)
        return vote.argmax(1), vote.max(1), gap


def examples(text: bytes) -> list[np.ndarray]:
    """What a labelled text is learned by: its whole, and if it is long its first words too, so that
    short texts are met in training."""
    short = text[: 24 + 8 * (zlib.crc32(text) % 8)]
    return [profile(t).astype(np.float32) for t in ([text, short] if len(text) > 100 else [text])]


def train(x: np.ndarray, langs: list[str], steps: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> Model:
    """Fit the bit classifiers to profiles (rows of x, single precision). Deterministic."""
    names = sorted(set(langs))
    code = codewords(len(names))
    if not names:
        return Model([], code, np.zeros((BUCKETS, code.shape[1])), np.zeros(code.shape[1]))
    target = np.array([names.index(y) for y in langs])
    each = np.bincount(target, minlength=len(names))
    weight = (1.0 / each[target] / len(names)).astype(np.float32)[:, None]
    sign = code[target].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -weight * sign / (1 + np.exp(sign * (x @ w + b)))
        gw, gb = x.T @ g + ridge * w, g.sum(0)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-6)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-6)
    return Model(names, code, w.astype(np.float32), b)


def quota(counts: list[int], most: int) -> int:
    """Rows of each language that a fit may take: languages with fewer are taken whole, and what
    they leave goes to the others, up to `most` rows in all or LEAST_ROWS for each."""
    left = most
    for i, n in enumerate(sorted(counts)):
        share = left // (len(counts) - i)
        if n > share:
            return max(share, LEAST_ROWS)
        left -= n
    return max(counts, default=0)


def fit(labelled: DataFrame, most: int = FIT_ROWS) -> Model:
    """Fit on labelled (doc_id, text, lang), at most about `most` rows chosen by a hash of id and
    text. Every language is learned, rare ones from all their rows."""
    rows = labelled.where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    each = quota(list(counts.values()), most)
    large = {k: int(0.95 * each / n * 2**40) for k, n in counts.items() if n > each}
    if large:
        limit = F.create_map(*[F.lit(x) for kv in sorted(large.items()) for x in kv])[F.col("lang")]
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(0)), F.lit(1 << 40)) < F.coalesce(limit, F.lit(1 << 40)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts are described where they are: the driver gets at most BUCKETS numbers for an example.
        for b in batches:
            ids, texts, langs = b.column(0).to_pylist(), blobs(b.column(1)), b.column(2).to_pylist()
            for at in range(0, len(texts), 64):
                out = [(d, y, zlib.crc32(t), k, x) for d, t, y in zip(ids[at : at + 64], texts[at : at + 64], langs[at : at + 64], strict=True) for k, x in enumerate(examples(t))]
                some = [np.flatnonzero(r[4]) for r in out]
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int32()))]
                yield pa.record_batch([*columns, pa.array([i.astype(np.int16) for i in some], pa.list_(pa.int16())), pa.array([r[4][i] for r, i in zip(out, some, strict=True)], pa.list_(pa.float32()))], names=["doc_id", "lang", "crc", "k", "at", "x"])

    plain = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = arrow(plain, kernel, "doc_id long, lang string, crc long, k int, at array<smallint>, x array<float>").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("crc", "ascending"), ("lang", "ascending"), ("k", "ascending")])
    x = np.zeros((found.num_rows, BUCKETS), np.float32)
    row = 0
    for chunk in found.to_batches(max_chunksize=256):
        for places, values in zip(chunk.column("at"), chunk.column("x"), strict=True):
            x[row, places.values.to_numpy()] = values.values.to_numpy()
            row += 1
    return train(x, found.column("lang").to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row of docs (doc_id, text).

    A null text, or one without a letter, is `und` with score 0 and ambiguous; so is every text if
    no language was learned. Rows with equal texts or ids are all returned; an empty table gives
    an empty result; other columns (lang, source) are never read."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets: bounded

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids, texts = b.column(0)[at : at + 512], blobs(b.column(1)[at : at + 512])
                known = np.array([bool(m.names) and bool(_LETTER.search(x.decode("utf-8", "replace"))) for x in texts], bool)
                best, vote, gap = m.decode(np.vstack([profile(x) for x in texts]).astype(np.float32))
                names = [m.names[i] if ok else UNKNOWN for i, ok in zip(best, known, strict=True)]
                yield pa.record_batch([ids, pa.array(names, pa.string()), pa.array(np.where(known, np.clip(vote, 0, 1), 0.0), pa.float64()), pa.array(~known | (gap < AMBIGUOUS))], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), kernel, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, held_fold: int = 2, folds: int = 4, most: int = FIT_ROWS) -> DataFrame:
    """Learn from the rows of docs outside the held-out fold and predict every row."""
    model = fit(docs.where(fold("doc_id", folds) != held_fold).select("doc_id", "text", "lang"), most)
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", folds) == held_fold).alias("held_out"), "lang_pred", "score", "ambiguous")
