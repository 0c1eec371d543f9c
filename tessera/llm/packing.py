"""Best-fit packing of documents into sequences of several permitted lengths.

Only lengths matter to the packing, so it is planned once, for all documents, on the histogram of
lengths (at most as many rows as the largest permitted length), and then dealt: a document's rank
among those of its length finds its slot. The plan is best-fit decreasing with counts in place of
items: the pieces of one length go, as many as fit, to the open bins with the least room that holds
them; when none does, bins are opened of the size whose cost, spread over what it can be expected
to hold, is least. At last each bin is cut down to the least permitted length that holds its
contents. Every upper limit on the sizes to be opened is tried, and the plan of least total cost is
kept: the sizes are chosen jointly.

Documents longer than the largest length are cut into full pieces and a rest; nothing is dropped.
Ranking is dealt by salted groups of bounded size, so a length that a third of all documents share
does not meet in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, staged

SIZES = (512, 1024, 2048, 4096)
#: Tokens that a bin costs beside its length (its own start, its slot in a batch).
BIN_COST = 16


@dataclass
class Group:
    """`count` equal bins: their room, their pieces so far as (length, number) and their size."""

    size: int
    room: int
    count: int
    content: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Plan:
    """cost and bins of a packing; slots hold, for each length in turn of ranks, where the pieces
    go: (length, first rank, ranks, first bin, pieces in a bin, offset in the bin)."""

    cost: int
    bins: int
    tokens: int
    capacity: int
    slots: np.ndarray
    sizes: np.ndarray  # (first bin, size) for each group of equal bins


def _open_size(length: int, sizes: list[int], mean: float) -> int:
    """Size with least cost for each token it is expected to hold: the piece, and as many pieces of
    mean length after it as fit."""
    best, price = sizes[-1], float("inf")
    for s in sizes:
        if s < length:
            continue
        held = length + (s - length) // max(1.0, mean) * max(1.0, mean)
        if (s + BIN_COST) / held < price - 1e-12:
            best, price = s, (s + BIN_COST) / held
    return best


def _fill(histogram: dict[int, int], sizes: list[int]) -> list[Group]:
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []  # sorted distinct rooms that may hold something
    import bisect

    left_n, left_t = sum(histogram.values()), sum(k * v for k, v in histogram.items())
    closed: list[Group] = []

    def put(g: Group) -> None:
        if g.room <= 0:
            closed.append(g)
            return
        if g.room not in by_room:
            by_room[g.room] = []
            bisect.insort(rooms, g.room)
        by_room[g.room].append(g)

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        left_n, left_t = left_n - n, left_t - n * length
        mean = left_t / left_n if left_n else length
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                size = _open_size(length, sizes, min(mean, length))
                g = Group(size, size, -(-n // (size // length)))
            else:
                g = by_room[rooms[at]].pop()
                if not by_room[rooms[at]]:
                    del by_room[rooms[at]]
                    rooms.pop(at)
            each = g.room // length
            full = min(g.count, n // each)
            if full:
                put(Group(g.size, g.room - each * length, full, [*g.content, (length, each)]))
                n -= full * each
            rest = g.count - full
            if rest and 0 < n < each:
                put(Group(g.size, g.room - n * length, 1, [*g.content, (length, n)]))
                rest, n = rest - 1, 0
            if rest:
                put(Group(g.size, g.room, rest, g.content))
    return closed + [g for k in rooms for g in by_room[k]]


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES) -> Plan:
    """The packing of the pieces of a histogram {length: count}; lengths 1 to max(sizes)."""
    permitted = sorted(set(sizes))
    histogram = {k: v for k, v in histogram.items() if v > 0}
    if histogram and (min(histogram) < 1 or max(histogram) > permitted[-1]):
        raise ValueError("a length is not within the permitted sizes")
    best: tuple[int, list[Group]] | None = None
    for top in range(1, len(permitted) + 1):
        allowed = permitted[:top]
        if histogram and allowed[-1] < max(histogram):
            # Longer pieces still need larger bins; the limit holds for the others.
            long = {k: v for k, v in histogram.items() if k > allowed[-1]}
            short = {k: v for k, v in histogram.items() if k <= allowed[-1]}
            groups = _fill(long, permitted) + _fill(short, allowed)
        else:
            groups = _fill(histogram, allowed)
        for g in groups:
            held = sum(length * n for length, n in g.content)
            g.size = next(s for s in permitted if s >= held)
        cost = sum(g.count * (g.size + BIN_COST) for g in groups)
        if best is None or cost < best[0]:
            best = cost, groups
    cost, groups = best
    slots, first, placed = [], 0, []
    rank: dict[int, int] = {}
    for g in sorted(groups, key=lambda g: (-g.size, g.content)):
        placed.append((first, g.size))
        offset = 0
        for length, n in g.content:
            r = rank.get(length, 0)
            slots.append((length, r, g.count * n, first, n, offset))
            rank[length] = r + g.count * n
            offset += length * n
        first += g.count
    order = sorted(slots)
    tokens = sum(k * v for k, v in histogram.items())
    return Plan(cost, first, tokens, sum(g.count * g.size for g in groups), np.array(order, np.int64).reshape(-1, 6), np.array(placed, np.int64).reshape(-1, 2))


def pack(lengths: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row for each piece of each document of lengths (doc_id, n_tokens): doc_id, piece (from
    0), start (token of the document), n_tokens, bin_id, bin_size, bin_offset.

    A document of no (or null) tokens gets one row without a bin (bin_id, bin_size, bin_offset
    null); equal doc_ids are packed as rows of their own; an empty table gives an empty result;
    other columns are ignored."""
    spark, top = lengths.sparkSession, max(sizes)
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    pieces = (
        lengths.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("all"))
        .select("doc_id", "all", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(all - 1) div {top}")).cast("int"))).alias("piece"))
        .select("doc_id", "piece", (F.col("piece").cast("long") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("all") - F.col("piece").cast("long") * top).cast("int").alias("n_tokens"))
    )
    # The row's place parts many rows of one id.
    pieces = staged(pieces.withColumn("place", F.monotonically_increasing_id()), "pieces")
    counts = {r["n_tokens"]: r["n"] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most `top` rows
    done = plan(counts, sizes)
    # Salts of bounded groups; at most lengths + 4 * partitions of them, so their counts are few.
    deal = max(512, sum(counts.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = np.ones(top + 1, np.int64)
    for k, c in counts.items():
        salts[k] = -(-c // deal)
    wide = F.lit(1)
    hot = {k: int(s) for k, s in enumerate(salts) if s > 1}
    if hot:
        wide = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col("n_tokens")), F.lit(1)) if len(hot) <= 512 else F.greatest(F.lit(1), F.element_at(F.lit(salts.tolist()), F.col("n_tokens") + 1).cast("int"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "place"), wide).cast("int"))
    base: dict[tuple[int, int], int] = {}
    run: dict[int, int] = {}
    for r in sorted(salted.where("n_tokens > 0").groupBy("n_tokens", "salt").agg(F.count("*").alias("n")).collect()):
        base[r[0], r[1]] = run.get(r[0], 0)
        run[r[0]] = run.get(r[0], 0) + r[2]
    place = salted.where("n_tokens > 0").withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece", "place")).cast("long") - 1)
    keys = np.array(sorted(base), np.int64).reshape(-1, 2)
    held = spark.sparkContext.broadcast((done.slots, done.sizes, keys[:, 0] << 32 | keys[:, 1], np.array([base[tuple(k)] for k in keys.tolist()], np.int64)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, bins, key, first = held.value
        # One sorted key for (length, rank): lengths and ranks are below 2^15 and 2^48.
        starts = slots[:, 0] << 48 | slots[:, 1]
        for b in batches:
            d, p, s, length, salt, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            length = length.astype(np.int64)
            rank = rank + first[np.searchsorted(key, length << 32 | salt)]
            x = slots[np.searchsorted(starts, length << 48 | rank, "right") - 1]
            k = rank - x[:, 1]
            number = x[:, 3] + k // x[:, 4]
            size = bins[np.searchsorted(bins[:, 0], number, "right") - 1, 1]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(length.astype(np.int32)), pa.array(number), pa.array(size.astype(np.int32)), pa.array((x[:, 5] + k % x[:, 4] * length).astype(np.int32))], names=["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_size", "bin_offset"])

    schema = "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_size int, bin_offset int"
    placed = arrow(place.select("doc_id", "piece", "start", "n_tokens", "salt", "rank"), kernel, schema)
    none = pieces.where("n_tokens <= 0").select("doc_id", "piece", "start", F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_size"), F.lit(None).cast("int").alias("bin_offset"))
    return placed.unionByName(none)
