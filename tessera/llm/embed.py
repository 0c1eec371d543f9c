"""Embedding near-duplicates by an epsilon-grid-order join.

A cosine of at least c between unit vectors is a distance of at most eps = sqrt(2 - 2c). Vectors
are turned onto their principal axes, ordered by the cells (width eps) of a grid on the leading
axes, and cut into sequence intervals of bounded length. Interval pairs are found by recursion over
groups of intervals: a pair of groups whose bounding boxes are farther apart than eps is skipped,
any other is replaced by the pairs of its children. Inside a pair of intervals the recursion goes
on over halves down to small blocks, whose cosines are computed exactly in double precision.

Neighbouring intervals make a side, as large as a task may hold and at least an eleventh of all; a
task gets two sides and joins all pairs of their intervals that were not skipped. So an interval
travels once for each side, not once for each pair: where boxes cannot skip anything (vectors
spread evenly over many axes), the volume is vectors x sides, with 11 sides up to 11 x SIDE_BYTES of
vectors, and grows with the square only beyond.

Equal vectors collapse first. A block pair returns counts by vector and a spanning forest of its
links, never the pairs, so a group of near copies costs no more rows than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, dropped, runs, spanning, staged, starts_of
from .components import connected_components

COSINE, INTERVAL, FANOUT, BLOCK, AXES = 0.95, 1024, 8, 256, 6
#: Sides that the sequence has at least, where it has so many intervals, and most bytes of one.
SIDES, SIDE_BYTES = 11, 32 << 20
#: Room for rounding when boxes are compared with eps; verification is exact.
SLACK = 1e-6


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): v the components as bytes, null if the vector cannot link."""
    dtype = _dtype(table)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col, out = b.column(1), []
            values, offsets = col.values.to_numpy(zero_copy_only=False).astype(dtype), col.offsets.to_numpy()
            ok = np.asarray(col.is_valid())
            for i in range(b.num_rows):
                x = values[offsets[i] : offsets[i + 1]] if ok[i] else values[:0]
                out.append(np.ascontiguousarray(x + x.dtype.type(0), dtype).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return arrow(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if dtype == "<f4" else "array<double>").alias("e")), kernel, "vec_id long, v binary")


def _dtype(table: DataFrame) -> str:
    """Single precision travels as such and is computed with in double precision."""
    return "<f4" if dict(table.dtypes)["embedding"] == "array<float>" else "<f8"


def _matrix(col: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(len(col), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(reps: DataFrame, dims: int, dtype: str = "<f8") -> np.ndarray:
    """Axes of the unit vectors, most variance first: a sum of dims x dims numbers, whatever the
    number of vectors."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                u = _unit(_matrix(b.column(0)[at : at + 4096], dtype))
                total += u.T @ u
        yield pa.record_batch([pa.array(np.arange(dims * dims)), pa.array(total.reshape(-1))], names=["i", "x"])

    rows = arrow(reps.select("v"), kernel, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    m = np.zeros(dims * dims)
    m[rows.column("i").to_numpy()] = rows.column("x").to_numpy()
    return np.linalg.eigh(m.reshape(dims, dims))[1][:, ::-1].copy()


def _intervals(reps: DataFrame, axes: np.ndarray, eps: float, rows: int, lead: int, dtype: str) -> DataFrame:
    """Table of sequence intervals: id (their place in the order), the packed vectors, ids and
    weights, and the box."""
    held = reps.sparkSession.sparkContext.broadcast(axes)
    lead = min(lead, axes.shape[1])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.floor(_unit(_matrix(b.column(2), dtype)) @ held.value[:, :lead] / eps).astype(np.int32) if b.num_rows else np.zeros((0, lead), np.int32)
            yield pa.record_batch([*b.columns, *(pa.array(z[:, k]) for k in range(lead))], names=["rep", "n", "v", *(f"g{k}" for k in range(lead))])

    grid = [f"g{k}" for k in range(lead)]
    with_cells = arrow(reps.select("rep", "n", "v"), cells, "rep long, n long, v binary, " + ", ".join(f"{g} int" for g in grid))
    ordered = with_cells.repartitionByRange(*grid, "rep").sortWithinPartitions(*grid, "rep")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))], names=["rep", "n", "v", "part", "i"])
            n += b.num_rows

    placed = staged(arrow(ordered.select("rep", "n", "v"), number, "rep long, n long, v binary, part int, i long"), "ordered")
    first, at = [], 0
    for r in sorted(placed.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        first.append((r["part"], at))
        at += r["n"]
    starts = reps.sparkSession.createDataFrame(first, "part int, first long")
    numbered = placed.join(F.broadcast(starts), "part").withColumn("i", F.col("first") + F.col("i")).withColumn("id", F.expr(f"i div {rows}"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "id", rows):
            ids = t.column("id").to_numpy()
            bounds = starts_of(ids)
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                some = t.slice(s, e - s)
                z = _unit(_matrix(some.column("v").combine_chunks(), dtype)) @ held.value
                yield pa.record_batch([pa.array(ids[s : s + 1]), pa.array([some.column("rep").to_numpy().tobytes()]), pa.array([some.column("n").to_numpy().tobytes()]), pa.array([b"".join(some.column("v").to_pylist())]), pa.array([z.min(0).tolist()], pa.list_(pa.float64())), pa.array([z.max(0).tolist()], pa.list_(pa.float64()))], names=["id", "reps", "ns", "vs", "lo", "hi"])

    dealt = numbered.select("id", "i", "rep", "n", "v").repartition(max(1, -(-at // rows)), "id").sortWithinPartitions("id", "i")
    out = staged(arrow(dealt.select("id", "rep", "n", "v"), cut, "id long, reps binary, ns binary, vs binary, lo array<double>, hi array<double>"), "intervals")
    dropped(placed)
    return out


def _apart(a: str, b: str) -> F.Column:
    """Squared distance of two boxes given by columns {a}lo, {a}hi, {b}lo, {b}hi."""
    return F.expr(
        f"aggregate(zip_with(arrays_zip({a}lo, {a}hi), arrays_zip({b}lo, {b}hi),"
        f" (p, q) -> power(greatest(0D, p.{a}lo - q.{b}hi, q.{b}lo - p.{a}hi), 2)), 0D, (s, p) -> s + p)"
    )


def _box(c: str, f: str) -> F.Column:
    return F.expr(f"aggregate(collect_list({c}), cast(null as array<double>), (s, x) -> if(s is null, x, zip_with(s, x, (p, q) -> {f}(p, q))))")


def near_pairs(intervals: DataFrame, eps: float, made: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(pa, pb), pa <= pb: the interval pairs whose boxes may hold vectors within eps; tables it stages
    go to `made`."""
    far = (eps + SLACK) ** 2
    count = intervals.count()
    spark = intervals.sparkSession
    levels = [intervals.select("id", "lo", "hi")]
    while count > fanout:
        count = -(-count // fanout)
        up = levels[-1].groupBy(F.expr(f"id div {fanout}").alias("id")).agg(_box("lo", "least").alias("lo"), _box("hi", "greatest").alias("hi"))
        levels.append(staged(up, "boxes"))
        made.append(levels[-1])

    def children(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        kids = F.sequence(F.lit(0), F.lit(fanout - 1))
        p = pairs.select(F.explode(F.transform(kids, lambda k: F.col("a") * fanout + k)).alias("a"), "b").select("a", F.explode(F.transform(kids, lambda k: F.col("b") * fanout + k)).alias("b")).where("a <= b")
        return kept(p, nodes)

    def kept(p: DataFrame, nodes: DataFrame) -> DataFrame:
        x = nodes.select(F.col("id").alias("a"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
        y = nodes.select(F.col("id").alias("b"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"))
        return p.join(x, "a").join(y, "b").where(_apart("x", "y") <= far).select("a", "b")

    # The top level has at most `fanout` nodes, so its pairs are listed outright.
    top = range(count)
    pairs = kept(spark.createDataFrame([(i, j) for i in top for j in top if i <= j] or [(0, 0)], "a long, b long"), levels[-1])
    for nodes in reversed(levels[:-1]):
        made.append(staged(pairs, "pairs"))
        pairs = children(made[-1], nodes)
    return pairs.select(F.col("a").alias("pa"), F.col("b").alias("pb"))


Boxes = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def boxes(z: np.ndarray, block: int) -> Boxes:
    """Bounding boxes of the rows of z, of their halves, and so on down to blocks."""
    found: Boxes = {}

    def go(s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        if e - s <= block:
            r = z[s:e].min(0), z[s:e].max(0)
        else:
            m = (s + e + 1) // 2
            p, q = go(s, m), go(m, e)
            r = np.minimum(p[0], q[0]), np.maximum(p[1], q[1])
        found[s, e] = r
        return r

    go(0, len(z))
    return found


def join_blocks(x: np.ndarray, y: np.ndarray, bx: Boxes, by: Boxes, same: bool, cosine: float, eps: float, block: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, links) of the blocks of two intervals (unit vectors x, y) that their boxes
    cannot rule out, by recursive halving; for an interval with itself, columns >= rows."""
    todo = [((0, len(x)), (0, len(y)))]
    while todo:
        p, q = todo.pop()
        if same and q[1] <= p[0]:
            continue
        gap = np.maximum(0, np.maximum(bx[p][0] - by[q][1], by[q][0] - bx[p][1]))
        if gap @ gap > (eps + SLACK) ** 2:
            continue
        if p[1] - p[0] <= block and q[1] - q[0] <= block:
            link = x[p[0] : p[1]] @ y[q[0] : q[1]].T >= cosine
            if link.any():
                yield p[0], q[0], link
            continue
        mp, mq = (p[0] + p[1] + 1) // 2, (q[0] + q[1] + 1) // 2
        ps = [(p[0], mp), (mp, p[1])] if p[1] - p[0] > block else [p]
        qs = [(q[0], mq), (mq, q[1])] if q[1] - q[0] > block else [q]
        todo += [(i, j) for i in ps for j in qs]


class Interval:
    """One interval in a task: its unit vectors, nodes, copies, boxes and what it links."""

    def __init__(self, reps: bytes, ns: bytes, vs: bytes, axes: np.ndarray, dtype: str, block: int) -> None:
        self.reps, self.copies = np.frombuffer(reps, np.int64), np.frombuffer(ns, np.int64)
        self.unit = _unit(np.frombuffer(vs, dtype).reshape(len(self.reps), -1).astype(np.float64))
        self.boxes = boxes(self.unit @ axes, block)
        self.links = np.zeros(len(self.reps), np.int64)

    def join(self, other: Interval, cosine: float, eps: float, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Adds the links between two intervals (or of one) to their counts; a spanning forest of them."""
        same = other is self
        us, vs = [self.reps[:0]], [self.reps[:0]]
        for s, t, link in join_blocks(self.unit, other.unit, self.boxes, other.boxes, same, cosine, eps, block):
            h, w = link.shape
            if same and s == t:
                np.fill_diagonal(link, False)
                self.links[s : s + h] += link @ self.copies[s : s + h]
            else:
                self.links[s : s + h] += link @ other.copies[t : t + w]
                other.links[t : t + w] += link.T @ self.copies[s : s + h]
            i, j = spanning(link)
            us.append(self.reps[s + i])
            vs.append(other.reps[t + j])
        return np.concatenate(us), np.concatenate(vs)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        some = self.links > 0
        return self.reps[some], self.links[some]


def _verify(axes, cosine: float, eps: float, block: int, dtype: str):
    """Links of the sides that meet in a task; rows come by task, the first side before the second,
    which is taken one interval at a time."""

    def rows(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(u), pa.array(v), pa.array(w)], names=["u", "v", "w"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                a, c, side, ra, na, va = (b.column(k)[i].as_py() for k in range(6))
                if (a, c) != task:
                    for x in held:
                        yield rows(*(z := x.counts()), z[1])
                    task, held = (a, c), []
                new = Interval(ra, na, va, axes.value, dtype, block)
                if a != c:
                    mates = held if side else []
                else:
                    mates = [*held, new]
                for x in mates:
                    # The lower interval of the sequence comes first.
                    u, v = x.join(new, cosine, eps, block)
                    yield rows(u, v, np.zeros(len(u), np.int64))
                if side:
                    yield rows(*(z := new.counts()), z[1])
                else:
                    held.append(new)
        for x in held:
            yield rows(*(z := x.counts()), z[1])

    return kernel


def _links(cut: DataFrame, pairs: DataFrame, count: int, bytes_each: int, axes, cosine: float, eps: float, block: int, dtype: str) -> DataFrame:
    """(u, v, w): links u, v of a spanning forest (w = 0), and parts w > 0 of the number of links of u."""
    per_side = max(1, min(SIDE_BYTES // bytes_each, -(-count // SIDES)))
    a, b = (F.expr(f"{p} div {per_side}") for p in ("pa", "pb"))
    wanted = pairs.select(a.alias("a"), b.alias("b"), F.inline(F.array(F.struct(F.col("pa").alias("id"), F.lit(0).alias("side")), F.struct(F.col("pb").alias("id"), F.when(a == b, 0).otherwise(1).alias("side"))))).distinct()
    sides = -(-count // per_side)
    dealt = wanted.join(cut.select("id", "reps", "ns", "vs"), "id").select("a", "b", "side", "reps", "ns", "vs", "id")
    dealt = dealt.repartition(sides * (sides + 1) // 2, "a", "b").sortWithinPartitions("a", "b", "side", "id")
    return arrow(dealt.drop("id"), _verify(axes, cosine, eps, block, dtype), "u long, v long, w long")


def near_duplicates(table: DataFrame, cosine: float = COSINE, interval: int = INTERVAL, block: int = BLOCK) -> DataFrame:
    """One row for each row of table (vec_id, embedding): vec_id, n_links (other vectors within the
    cosine), component_id (least vec_id reachable), kept (vec_id = component_id).

    Vectors that are null, empty, zero or have null or non-finite components link with nothing;
    vectors of different lengths never link; equal vectors link with each other; rows of one vec_id
    are linked by their vectors alone. A row with a null vec_id links like any other; its component_id
    is null if no row reachable has an id, and it is never kept. An empty table gives an empty
    result; further columns (label) are ignored."""
    spark, dtype = table.sparkSession, _dtype(table)
    width = int(dtype[-1])
    eps = float(np.sqrt(2 - 2 * cosine))
    members = staged(vectors(table), "vectors")
    # A node's number is its place in the table written here, so ids may be null or repeat.
    distinct = members.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    reps = staged(distinct.withColumn("rep", F.monotonically_increasing_id()), "reps")
    sizes = sorted(r[0] // width for r in reps.select(F.octet_length("v")).distinct().collect())  # lengths in use
    links, made = [], []
    for dims in sizes:
        some = reps if len(sizes) == 1 else reps.where(F.octet_length("v") == width * dims)
        axes = principal_axes(some, dims, dtype)
        cut = _intervals(some, axes, eps, interval, AXES, dtype)
        pairs = staged(near_pairs(cut, eps, made), "interval-pairs")
        links.append(staged(_links(cut, pairs, cut.count(), interval * dims * width, spark.sparkContext.broadcast(axes), cosine, eps, block, dtype), "links"))
        made += [cut, pairs]
    if not links:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    both = links[0]
    for x in links[1:]:
        both = both.unionByName(x)
    counts = both.where("w > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("w").alias("w"))
    roots = connected_components(both.where("w = 0").select("u", "v"))
    named = reps.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(counts, "rep", "left")
    named = staged(named.select("v", "least", (F.coalesce("w", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "named")
    lowest = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    by_vector = staged(named.join(lowest, "root").select("v", "n_links", "component_id"), "classes")
    for x in (*made, *links, reps, named, lowest):
        dropped(x)
    of_none = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = members.join(by_vector, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of_none.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
