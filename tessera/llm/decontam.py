"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Every benchmark item has a SimHash of its word shingles. All windows of an item's size (in words)
that have enough shingles of the item to be similar are fingerprinted, by differences of running
sums over the bits of the shingle hashes. Fingerprints within the radius of an item's are found
through an index of blocks: of two 64-bit strings at most r bits apart, cut into m blocks, one block
differs by at most r div m bits. The windows found are verified by the exact similarity of their
weighted shingles (weight: how often a shingle occurs): twice the shared weight over the weight of
both.

At similarity 0.8 about 13 of 64 bits differ, so a radius that keeps such windows is far too wide
for blocks to select by; what selects is the count of shared shingles, which loses nothing. The
radius is set so wide that the index loses next to nothing either (tests measure its recall).

The benchmark is shipped to the workers in parts of a bounded size, with one pass over the
documents for each part; the corpus is never gathered.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, blobs
from .simhash import bit_sums

K, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
#: Bytes of benchmark text that a pass over the documents carries.
PART_BYTES = 32 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_QUOTES = re.compile(rb"\xe2\x80[\x80-\xaf]|\xc2[\xa0-\xbf]")


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of letters and digits; white space and signs part words."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
        text = _QUOTES.sub(b" ", text)
    return text.translate(_FOLD).split()


def shingles(w: list[bytes], k: int) -> list[bytes]:
    """The k-word shingles; of fewer than k words the whole sequence, of none nothing."""
    if len(w) < k:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)))


_PLACE = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in parts), np.uint64, len(parts))


def window_prints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of `size` of the shingle hashes h."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.vstack([np.zeros((1, 64), np.int32), bits.cumsum(0, dtype=np.int32)])
    return (_PLACE * (2 * (total[size:] - total[:-size]) > size)).sum(1, dtype=np.uint64)


class BlockIndex:
    """Fingerprints by blocks: near(x) is every item within the radius, and nothing else."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS) -> None:
        self.prints, self.radius, self.blocks = prints, radius, blocks
        self.width = -(-64 // blocks)
        values = np.arange(1 << self.width, dtype=np.uint64)
        self.tables = []
        for k in range(blocks):
            own = self._block(prints, k)
            differ = np.bitwise_count(values[:, None] ^ own[None, :]) <= radius // blocks
            self.tables.append(differ)

    def _block(self, x: np.ndarray, k: int) -> np.ndarray:
        return x >> np.uint64(k * self.width) & np.uint64((1 << self.width) - 1)

    def near(self, x: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in x, item, distance) of the pairs within the radius, for the items `of` or all."""
        of = np.arange(len(self.prints)) if of is None else of
        some = np.zeros((len(x), len(of)), bool)
        for k, t in enumerate(self.tables):
            some |= t[self._block(x, k)[:, None], of]
        i, j = np.nonzero(some)
        j = of[j]
        d = np.bitwise_count(x[i] ^ self.prints[j])
        ok = d <= self.radius
        return i[ok], j[ok], d[ok]


@dataclass
class Benchmark:
    """The items of one part: words, shingles and how to find them in a text."""

    k: int
    ids: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    bags: list[Counter] = field(default_factory=list)
    weights: list[int] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    owners: dict[int, dict[tuple[int, ...], list[int]]] = field(default_factory=dict)
    indexes: dict[int, tuple[list[int], BlockIndex]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.grams: dict[int, np.ndarray] = {}


_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def _gram(ids: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k word ids; equal runs have equal numbers."""
    n = len(ids) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ ids[i : i + n]) * _PRIMES[i % 5]
        out ^= out >> np.uint64(29)
    return out


def prepare(items: list[tuple[int, bytes]], k: int = K, radius: int = RADIUS) -> Benchmark:
    b = Benchmark(k)
    by_size: dict[int, list[int]] = defaultdict(list)
    prints = []
    for item_id, text in items:
        w = words(text)
        if not w:
            continue
        m = len(b.ids)
        parts = shingles(w, k)
        b.ids.append(item_id)
        b.sizes.append(len(w))
        b.bags.append(Counter(parts))
        b.weights.append(len(parts))
        by_size[len(w)].append(m)
        prints.append(int(_PLACE[2 * bit_sums(_hashes(parts)) > len(parts)].sum(dtype=np.uint64)))
        ids = np.array([b.vocabulary.setdefault(x, len(b.vocabulary) + 1) for x in w], np.uint64)
        n = min(k, len(w))
        at = b.owners.setdefault(n, {})
        for g in _gram(ids, n).tolist():
            owners = at.setdefault(g, [])
            if not owners or owners[-1] != m:  # items come in order
                owners.append(m)
    for n, at in b.owners.items():
        b.grams[n] = np.array(sorted(at), np.uint64)
    prints = np.array(prints, np.uint64)
    for size, members in by_size.items():
        b.indexes[size] = members, BlockIndex(prints[members], radius)
    return b


def matches(text: bytes, b: Benchmark, similarity: float = SIMILARITY) -> list[tuple[int, float, int, int]]:
    """(item, similarity, first word of the best window, its Hamming distance) for each item of
    which some window of the text, of the item's size, has at least the similarity. A text shorter
    than the item is one window."""
    w = words(text)
    if not w or not b.ids:
        return []
    get = b.vocabulary.get
    ids = np.array([get(x, 0) for x in w], np.uint64)
    if not ids.any():
        return []
    hits: dict[int, list[int]] = defaultdict(list)
    for n, known in b.grams.items():
        if len(ids) < n:
            continue
        whole = ids != 0
        if n > 1:
            run = np.concatenate(([0], np.cumsum(whole)))
            whole = run[n:] - run[:-n] == n
        place = np.flatnonzero(whole)
        if not len(place):
            continue
        g = _gram(ids, n)[place]
        at = np.minimum(np.searchsorted(known, g), len(known) - 1)
        for p, x in zip(place[known[at] == g].tolist(), g[known[at] == g].tolist(), strict=True):
            for m in b.owners[n][x]:
                hits[m].append(p)
    # Windows with as many shingles of an item as the similarity takes.
    by_size: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
    for m, places in hits.items():
        size = b.sizes[m]
        span = min(size, len(w))
        each = max(1, span - b.k + 1)
        need = max(1, math.ceil(similarity * (each + b.weights[m]) / 2 - 1e-9))
        if len(places) < need:
            continue
        run = np.zeros(len(w) + 1, np.int64)
        run[np.array(places) + 1] = 1
        run = np.cumsum(run)
        first = np.flatnonzero(run[each : each + len(w) - span + 1] - run[: len(w) - span + 1] >= need)
        if len(first):
            by_size[size][m] = first
    best: dict[int, tuple[float, int, int]] = {}
    for size, wanted in by_size.items():
        members, index = b.indexes[size]
        of = np.flatnonzero(np.isin(members, list(wanted)))
        span = min(size, len(w))
        k, each = min(b.k, span), max(1, span - b.k + 1)
        inside = np.unique(np.concatenate(list(wanted.values())))
        for part in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1):
            for at in range(0, len(part), 4096):
                first, last = int(part[at]), int(part[min(len(part), at + 4096) - 1])
                parts = shingles(w[first : last + span], k)
                prints = window_prints(_hashes(parts), each)
                for i, j, d in zip(*(x.tolist() for x in index.near(prints, of)), strict=True):
                    m = members[j]
                    bag = b.bags[m]
                    seen = Counter(x for x in parts[i : i + each] if x in bag)
                    shared = sum(min(c, bag[x]) for x, c in seen.items())
                    s = 2 * shared / (each + b.weights[m])
                    if s >= similarity and s > best.get(m, (0.0,))[0]:
                        best[m] = s, first + i, d
    return [(b.ids[m], *best[m]) for m in sorted(best)]


_PREPARED: dict[str, Benchmark] = {}


def _prepared(name: str, items, k: int, radius: int) -> Benchmark:
    """A part of the benchmark, prepared once for each worker; the last one is kept."""
    if name not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[name] = prepare(items.value, k, radius)
    return _PREPARED[name]


def _parts(items: DataFrame, most: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in parts of about `most` bytes, the same in every run."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most) or 1
    for i in range(n):
        some = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        t = some.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield list(zip(t.column("item_id").to_pylist(), blobs(t.column("text")), strict=True))


def contaminated(docs: DataFrame, items: DataFrame, k: int = K, similarity: float = SIMILARITY, radius: int = RADIUS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, hamming): a row for each document and item of which
    a window of the document has at least the similarity; the best window, the earliest of equals.

    Null and empty texts and items match nothing; repeated rows give repeated results; an empty
    table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for part in _parts(items, part_bytes):
        held, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex  # at most about part_bytes

        def kernel(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            b = _prepared(name, held, k, radius)
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), blobs(batch.column(1)), strict=True) for m in matches(t, b, similarity)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "hamming"])

        some = arrow(rows, kernel, "doc_id long, item_id long, similarity double, first_word int, hamming int")
        out = some if out is None else out.unionByName(some)
    return out


def clean(docs: DataFrame, items: DataFrame, k: int = K, similarity: float = SIMILARITY, radius: int = RADIUS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs, all columns, that match no item."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for part in _parts(items, part_bytes):
        held, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def kernel(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            b = _prepared(name, held, k, radius)
            for batch in batches:
                yield batch.filter(pa.array([not matches(t, b, similarity) for t in blobs(batch.column(at))], pa.bool_()))

        docs = arrow(docs, kernel, docs.schema)
    return docs
