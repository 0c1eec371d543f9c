"""Removal of long repeated substrings with logarithmic families of suffix arrays.

A string of `length` bytes that occurs twice has its least-hashed k-gram (its anchor) at the same
place in both occurrences. So each text is cut into contexts, one for each anchor: the windows of
`length` bytes that have this anchor, with the bytes they cover. Contexts meet only under equal
anchors, which deals the corpus to many machines without losing a match:

1. anchors that occur once in the corpus are dropped, after a count by anchor;
2. equal contexts are counted; all windows of a context that occurs twice are repeated;
3. where an anchor has several different contexts, their bytes are fetched and dealt by anchor.
   Each task keeps a family of suffix arrays: a batch of contexts gets its suffix array, which is
   merge-scanned against the arrays of the existing levels for suffixes that agree on `length`
   bytes; arrays of equal level are merged into one of the next level, so a task of n batches holds
   about log2(n) arrays;
4. an anchor with very many different contexts (the edge of a passage that everyone quotes) is not
   given to one task: equal windows have the anchor at the same place, so its contexts are parted by
   that place into ranges, and by the bytes that all windows of a range share. What meets after that
   has more bytes in common; what is still too many is parted again by narrower ranges, the last of
   which hold one window;
5. the repeated windows are carried back to every occurrence, and each text is cut once.

Contexts are told apart, in steps 2 and 4, by 128-bit digests under a 64-bit hash of their anchor,
texts by 128-bit digests; windows of different contexts by their bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, blobs, dropped, staged

LENGTH, GRAM, PIECE = 200, 24, 1 << 19
#: Different contexts of one anchor that are left together in a task (about 150 kB of them).
TOGETHER = 512
#: Places of the anchor in a range, for anchors with more.
RANGES = (24, 4, 1)
#: Bytes of contexts that get a suffix array at once, and that a task compares.
BATCH_BYTES, TASK_BYTES = 1 << 18, 1 << 21
#: Windows of an array that are held as strings at once, and bytes of a window that are kept beside its place.
SLICE, HEAD = 1 << 16, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
CONTEXT = ["key", "ctx", "ctx2"]


def _powers(x: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, x, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Anchors:
    """Cuts texts into contexts; keeps the tables of powers that rolling hashes need."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> None:
        self.length, self.piece = length, max(piece, 4 * length)
        self.gram = min(gram, max(1, length // 2))
        n = self.piece + length + 1
        self.power, self.inverse = _powers(_BASE, n), _powers(_INVERSE, n)
        self.low = np.uint64((1 << (n - 1).bit_length()) - 1)
        self.index = np.arange(n, dtype=np.uint64)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first window, windows, place of the anchor) of each context of a text, in order."""
        n = len(text)
        if n < self.length:
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
        found = []
        for at in range(0, n - self.length + 1, self.piece):
            found.append(self._piece(np.frombuffer(text, np.uint8, min(n, at + self.piece + self.length - 1) - at, at), at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]

    def _piece(self, b: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n, k = len(b), self.gram
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.inverse[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * self.power[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        m, w = len(h), self.length - k + 1
        # Least hash of each run of w grams; of equal hashes the first. The place is in the low bits.
        x = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        x[:m] = (h & ~self.low) | self.index[:m]
        rows = x.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, 1).reshape(-1)
        back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].reshape(-1)
        least = np.minimum(back[: m - w + 1], ahead[w - 1 : m])
        place = (least & self.low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        return h[place[first]], first + at, np.diff(first, append=len(place)), place[first] + at


class Level:
    """A suffix array: places in a text (one character for a byte) in the order of the `length`
    characters there, the first of these characters, and the name of each place."""

    def __init__(self, text: str, starts: np.ndarray, names: np.ndarray, heads: np.ndarray, length: int) -> None:
        self.text, self.starts, self.names, self.heads, self.length = text, starts, names, heads, length

    @classmethod
    def of(cls, data: bytes, starts: np.ndarray, names: np.ndarray, length: int) -> tuple[Level, np.ndarray]:
        """The suffix array of the places, and which of its windows equal another."""
        wide = min(HEAD, length)
        out = cls(str(data, "latin-1"), starts, names, np.zeros(0, f"S{wide}"), length)
        window = out.windows(np.arange(len(starts)))
        order = np.array(sorted(range(len(window)), key=window.__getitem__), np.int64)
        out.starts, out.names = starts[order], names[order]
        if len(starts):
            views = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), wide)
            out.heads = np.ascontiguousarray(views[out.starts]).view(f"S{wide}").reshape(-1)
        return out, _in_runs([window[i] for i in order.tolist()])

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, at: np.ndarray) -> list[str]:
        t, n = self.text, self.length
        return [t[s : s + n] for s in self.starts[at].tolist()]


def _in_runs(ordered: list[str]) -> np.ndarray:
    """For sorted strings, whether a neighbour is equal."""
    same = np.zeros(len(ordered) + 1, bool)
    same[1:-1] = np.fromiter(map(eq, ordered, islice(ordered, 1, None)), bool, max(0, len(ordered) - 1))
    return same[1:] | same[:-1]


def merge_scan(a: Level, b: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over two suffix arrays: how many windows of a come before each window of b when they
    are merged; which windows of a, and which of b, equal another. (Windows of one array that equal
    each other are marked when the array is made.)

    Heads of both arrays are merged first; only windows whose heads are in both are compared whole.
    Sorting two sorted runs, Python's sort merges them: linear in comparisons."""
    low, upper = np.searchsorted(a.heads, b.heads, "left"), np.searchsorted(a.heads, b.heads, "right")
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    tied = np.flatnonzero(low < upper)
    edge = np.zeros(len(a) + 1, np.int64)
    np.add.at(edge, low[tied], 1)
    np.add.at(edge, upper[tied], -1)
    mine_at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    other, done = b.windows(tied), 0
    for i in range(0, len(mine_at), SLICE):
        at = mine_at[i : i + SLICE]
        mine = a.windows(at)
        stop = len(other) if i + SLICE >= len(mine_at) else bisect_right(other, mine[-1], done)
        if stop == done:
            continue
        both = mine + other[done:stop]
        order = np.array(sorted(range(len(both)), key=both.__getitem__), np.int64)
        equal = _in_runs([both[k] for k in order.tolist()])
        from_b = order >= len(mine)
        # The last window of a before each of b: of the same head, or all of that head come after.
        before = np.cumsum(~from_b)[from_b] - 1
        last = np.where(before >= 0, at[before], mine_at[i - 1] if i else -1)
        upper[tied[done:stop]] = np.maximum(low[tied[done:stop]], last + 1)
        in_a[at] = equal[~from_b]
        in_b[tied[done:stop]] = equal[from_b]
        done = stop
    return upper, in_a, in_b


def merged(a: Level, b: Level, upper: np.ndarray) -> Level:
    """Two suffix arrays as one, given how many windows of a come before each of b."""
    from_b = np.zeros(len(a) + len(b), bool)
    from_b[upper + np.arange(len(b))] = True
    out = []
    for x, y in ((a.starts, b.starts + len(a.text)), (a.names, b.names), (a.heads, b.heads)):
        both = np.empty(len(from_b), x.dtype)
        both[from_b], both[~from_b] = y, x
        out.append(both)
    return Level(a.text + b.text, *out, a.length)


class Family:
    """Levels of suffix arrays; level j holds about 2^j batches."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.levels: dict[int, Level] = {}
        self.count = self.most_levels = self.merges = 0
        self.marks: list[np.ndarray] = []

    def add(self, data: bytes, starts: np.ndarray) -> None:
        """Index the windows of `length` bytes of data at starts, numbered on from those before.

        The new array is scanned against every level: against those that it is merged with as it is
        merged, against the others by itself."""
        names = np.arange(self.count, self.count + len(starts))
        self.count += len(starts)
        new, twice = Level.of(data, starts, names, self.length)
        self.marks.append(new.names[twice])
        j, grown = 0, new
        while j in self.levels:
            old = self.levels.pop(j)
            upper, old_hit, new_hit = merge_scan(old, grown)
            self.marks += [old.names[old_hit], grown.names[new_hit]]
            grown = merged(old, grown, upper)
            self.merges += 1
            j += 1
        for level in self.levels.values():
            _, old_hit, new_hit = merge_scan(level, new)
            self.marks += [level.names[old_hit], new.names[new_hit]]
        self.levels[j] = grown
        self.most_levels = max(self.most_levels, len(self.levels))

    def repeated(self) -> np.ndarray:
        """For each window number, whether it equals another window."""
        out = np.zeros(self.count, bool)
        for m in self.marks:
            out[m] = True
        return out


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): whole texts as bytes, null as empty, under their 128-bit digests."""
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(raw)).alias("th"), raw.alias("text"))


def _contexts(rows: DataFrame, length: int, gram: int, keys_only: bool) -> DataFrame:
    """Contexts of the texts; c: how many rows of a batch have this text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Anchors(length, gram)
        digest = xxhash.xxh3_128_digest
        for b in batches:
            times = Counter(t for t in blobs(b.column(1)) if len(t) >= length)
            if not times:
                continue
            of = dict(zip(blobs(b.column(1)), b.column(0).to_pylist(), strict=True))
            found = [(*cut(t), t) for t in times]
            key = np.concatenate([f[0] for f in found]).view(np.int64)
            each = [len(f[0]) for f in found]
            c = pa.array(np.repeat(np.fromiter(times.values(), np.int64), each))
            if keys_only:
                yield pa.record_batch([pa.array(key), c], names=["key", "c"])
                continue
            ctx = np.frombuffer(b"".join([digest(t[s:e]) for _, first, n, _, t in found for s, e in zip(first.tolist(), (first + n + length - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
            th = pa.array([of[t] for t in times], pa.binary()).take(pa.array(np.repeat(np.arange(len(found)), each)))
            s, n = (pa.array(np.concatenate([f[i] for f in found]).astype(np.int32)) for i in (1, 2))
            yield pa.record_batch([pa.array(key), pa.array(ctx[:, 0]), pa.array(ctx[:, 1]), c, th, s, n], names=[*CONTEXT, "c", "th", "s", "n"])

    return arrow(rows.select("th", "text"), kernel, "key long, c long" if keys_only else "key long, ctx long, ctx2 long, c long, th binary, s int, n int")


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    """Runs of true flags as {a, b}, both ends within."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
SPANS = "array<struct<a:int,b:int>>"


def _compare(length: int, batch_bytes: int):
    """The repeated windows of contexts (key, ctx, ctx2, x), by a family of suffix arrays for a task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(length)
        names: list[pa.RecordBatch] = []
        windows: list[np.ndarray] = []
        kept: list[bytes] = []
        size = 0

        def index() -> None:
            nonlocal kept, size
            sizes = np.array([len(x) for x in kept])
            n = sizes - length + 1
            base = np.repeat(np.cumsum(sizes) - sizes, n)
            family.add(b"".join(kept), base + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            windows.append(n)
            kept, size = [], 0

        for b in batches:
            names.append(b.select(CONTEXT))
            for x in blobs(b.column(3)):
                kept.append(x)
                size += len(x)
                if size >= batch_bytes:
                    index()
        if kept:
            index()
        flags, n = family.repeated(), np.concatenate(windows) if windows else np.zeros(0, np.int64)
        ends, at = np.cumsum(n), 0
        for b in names:
            spans = [_runs(flags[e - w : e]) for e, w in zip(ends[at : at + b.num_rows].tolist(), n[at : at + b.num_rows].tolist(), strict=True)]
            at += b.num_rows
            yield pa.record_batch([*b.columns, pa.array(spans, _SPANS)], names=[*CONTEXT, "spans"])

    return kernel


def _parted(length: int, gram: int, width: int):
    """Contexts (key, ctx, ctx2, x) parted by the place of the anchor: a row for each range of `width`
    places. All windows of a range hold the same bytes around the anchor, whose hash is the new key."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Anchors(length, gram)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            d = np.frombuffer(b"".join(columns[6]), np.int64).reshape(-1, 2)
            ints = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.int32()) for c in columns[3:5]]
            return pa.record_batch([*ints, pa.array(np.array(columns[5], np.uint64).view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(columns[7], pa.binary())], names=[*CONTEXT, "a", "n", "key2", "d1", "d2", "x"])

        for b in batches:
            for k, c1, c2, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                anchor = int(cut(x)[3][0])
                last = len(x) - length  # of the windows of x
                for r in range(max(0, anchor - last) // width, anchor // width + 1):
                    # Windows that have the anchor r * width to r * width + width - 1 bytes in.
                    low, high = max(0, anchor - (r + 1) * width + 1), min(last, anchor - r * width)
                    core = x[anchor - r * width : anchor - (r + 1) * width + 1 + length]
                    part = x[low : high + length]
                    out.append((k, c1, c2, low, high - low + 1, xxhash.xxh3_64_intdigest(core, (k + r) & 0xFFFFFFFFFFFFFFFF), xxhash.xxh3_128_digest(part), part))
                if len(out) >= 4096:
                    yield flush()
                    out.clear()
        if out:
            yield flush()

    return kernel


def _compared(contexts: DataFrame, length: int, gram: int, together: int, batch_bytes: int, task_bytes: int, widths: tuple[int, ...], made: list[DataFrame]) -> DataFrame:
    """(key, ctx, ctx2, spans): windows of contexts (key, ctx, ctx2, x, kinds: different contexts of
    the key) that equal a window of another context of their key. Tables it stages go to `made`."""
    few = contexts.where(F.col("kinds") <= together) if widths else contexts
    total = few.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    dealt = few.select(*CONTEXT, "x").repartition(max(1, -(-total // task_bytes)), "key")
    found = arrow(dealt, _compare(length, batch_bytes), f"key long, ctx long, ctx2 long, spans {SPANS}").where(F.size("spans") > 0)
    many = contexts.where(F.col("kinds") > together)
    if not widths or many.isEmpty():
        return found
    parts = staged(arrow(many.select(*CONTEXT, "x"), _parted(length, gram, widths[0]), "key long, ctx long, ctx2 long, a int, n int, key2 long, d1 long, d2 long, x binary"), "parts")
    kinds = staged(parts.groupBy("key2", "d1", "d2").agg(F.count("*").alias("c"), F.min("x").alias("x")), "part-kinds")
    again = kinds.groupBy("key2").agg(F.count("*").alias("kinds")).where("kinds > 1")
    left = staged(kinds.join(again, "key2").select(F.col("key2").alias("key"), F.col("d1").alias("ctx"), F.col("d2").alias("ctx2"), "x", "kinds"), "part-contexts")
    whole = kinds.where("c > 1").select(F.col("key2").alias("key"), F.col("d1").alias("ctx"), F.col("d2").alias("ctx2"), _whole(F.octet_length("x") - (length - 1)).alias("spans"))
    made += [parts, kinds, left]
    inner = _one_row(whole.unionByName(_compared(left, length, gram, together, batch_bytes, task_bytes, widths[1:], made)))
    inner = inner.select(F.col("key").alias("key2"), F.col("ctx").alias("d1"), F.col("ctx2").alias("d2"), "spans")
    back = parts.drop("x").join(inner, ["key2", "d1", "d2"]).select(*CONTEXT, _shifted("spans", "a").alias("spans"))
    return found.unionByName(back)


def _whole(n) -> F.Column:
    return F.array(F.struct(F.lit(0).alias("a"), (n - 1).cast("int").alias("b")))


def _shifted(spans: str, by: str) -> F.Column:
    return F.transform(spans, lambda q: F.struct((q["a"] + F.col(by)).alias("a"), (q["b"] + F.col(by)).alias("b")))


def _one_row(spans: DataFrame) -> DataFrame:
    """All spans of a context in one row."""
    return spans.groupBy(*CONTEXT).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, together: int = TOGETHER, batch_bytes: int = BATCH_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(th, spans): for each different text of docs with repeated bytes, spans of windows (a: start of
    the first, b: of the last) of `length` bytes that start elsewhere too. th is the digest of the
    text: rows of equal texts have equal spans, whatever their ids."""
    rows = _rows(docs)
    # Written out, so that the join below has a plain exchange on both sides, whose hot keys AQE splits.
    often = staged(_contexts(rows, length, gram, True).groupBy("key").agg(F.sum("c").alias("c")).where("c > 1").select("key"), "often")
    found = staged(_contexts(rows, length, gram, False).join(often, "key"), "contexts")
    kinds = staged(found.groupBy(*CONTEXT).agg(F.sum("c").alias("c"), F.min(F.struct("th", "s", "n")).alias("r")), "kinds")
    several = staged(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    twice = kinds.where("c > 1").select(*CONTEXT, _whole(F.col("r.n")).alias("spans"))

    # Bytes of one occurrence of each context that has to be compared, from one row of each text.
    asked = kinds.join(several, "key").select(*CONTEXT, "kinds", "r.*")
    by_text = asked.groupBy("th").agg(F.collect_list(F.struct(*CONTEXT, "kinds", "s", "n")).alias("asked"))
    texts = rows.where(F.octet_length("text") >= length).groupBy("th").agg(F.first("text").alias("text"))
    one = texts.join(by_text, "th").select("text", F.explode("asked").alias("q"))
    fetched = staged(one.select("q.key", "q.ctx", "q.ctx2", "q.kinds", F.expr(f"substring(text, q.s + 1, q.n + {length - 1})").alias("x")), "fetched")
    made: list[DataFrame] = []
    repeats = _compared(fetched, length, gram, together, batch_bytes, task_bytes, RANGES, made)
    verdict = staged(_one_row(twice.unionByName(repeats)), "verdict")
    placed = found.join(verdict, CONTEXT).select("th", _shifted("spans", "s").alias("q"))
    out = staged(placed.groupBy("th").agg(F.flatten(F.collect_set("q")).alias("spans")), "spans")
    for x in (often, found, kinds, several, fetched, verdict, *made):
        dropped(x)
    return out


def kept_pieces(n: int, spans: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], int, int]:
    """Kept ranges of a text of n bytes, removed bytes, and maximal removed runs."""
    keep, at, removed, count, end = [], 0, 0, 0, -1
    for a, b in sorted(spans):
        stop = b + length
        if a > end:
            if a > at:
                keep.append((at, a))
            count += 1
            removed += stop - a
        elif stop > end:
            removed += stop - end
        end = max(end, stop)
        at = end
    if at < n:
        keep.append((at, n))
    return keep, removed, count


def _spans_of(col: pa.Array) -> list[list[tuple[int, int]]]:
    return [[(q["a"], q["b"]) for q in x] if x else [] for x in col.to_pylist()]


def _with_spans(docs: DataFrame, rows: DataFrame, length: int, **options) -> DataFrame:
    spans = repeated_spans(docs, length, **options).select(F.col("th").alias("_th"), F.col("spans").alias("_spans"))
    return rows.join(spans, "_th", "left").drop("_th")


def removal(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row for each row of docs, as its text
    would be after every byte covered by a string of `length` bytes that also starts anywhere else,
    in this text or another, is removed. Strings are judged on the input.

    Null texts count as empty; repeated rows repeat each other's bytes; an empty table gives an
    empty result; other columns are ignored."""
    rows = _rows(docs).withColumnRenamed("th", "_th")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(blobs(b.column(1)), _spans_of(b.column(2)), strict=True):
                keep, removed, count = kept_pieces(len(t), spans, length)
                digest = hashlib.sha256()
                for a, e in keep:
                    digest.update(t[a:e])
                out.append((len(t), removed, count, digest.hexdigest()))
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow(_with_spans(docs, rows, length, **options).select("doc_id", "text", "_spans"), kernel, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """docs with the repeated bytes taken out of `text`, and `n_chars`, if there is one, counted
    anew. A character of which a byte is removed is removed whole; null texts stay null; all rows
    stay, empty texts too."""
    names = docs.columns
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    # The columns travel in a struct, whatever their names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("_row"), F.unhex(F.md5(raw)).alias("_th"))
    at = names.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column(at).to_pylist(), _spans_of(b.column(len(names))), strict=True):
                if spans:
                    raw = t.encode()
                    t = b"".join(raw[a:e] for a, e in kept_pieces(len(raw), spans, length)[0]).decode("utf-8", "ignore")
                out.append(t)
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(out, columns[at].type)
            yield pa.record_batch(columns, names=names)

    done = arrow(_with_spans(docs, rows, length, **options).select(*[F.col("_row")[f"c{i}"].alias(f"c{i}") for i in range(len(names))], "_spans"), kernel, docs.schema)
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind))).select(*names)
    return done
