"""Similarities of all pairs that a join on a key lists, worked on in blocks.

A join that sends each pair of texts to Python by itself spends most of its time on that. Here both
sides are dealt in chunks of a bounded number of rows of one key, and a task gets a chunk of each
side: rows travel once for each chunk of the other side, whatever the number of pairs, and a hot
key is many blocks. A block compares its distinct texts, many pairs at once, and lists every pair."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.strings import all_ratios, jaro_winkler, jaro_winkler_grid, ratio_grids
from ..functions.text import blank
from ..storage import arrow

#: Rows of a chunk of either side, pairs that a task compares at once, and pairs of a task.
LEFT, RIGHT, STRIP, TASK = 4096, 512, 1 << 15, 1 << 22


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up on the decimal digits of a number, as Spark rounds; close to a half by these digits."""
    scale = 10.0**digits
    t = x * scale
    low = np.floor(t)
    out = np.floor(t + 0.5) / scale
    at = np.flatnonzero(np.abs(t - low - 0.5).reshape(-1) < 1e-4)
    if len(at):
        values, of = np.unique(x.reshape(-1)[at], return_inverse=True)
        unit = Decimal(1).scaleb(-digits)
        out.reshape(-1)[at] = np.array([float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) for v in values])[of]
    return out


def grids(a: list[str], b: list[str], kinds: tuple[str, ...], digits: int) -> list[np.ndarray]:
    """The rounded similarities of each text of a with each of b, one grid for each kind."""

    def finish(x: np.ndarray) -> np.ndarray:
        return rounded(x, digits)

    if kinds == ("jaro_winkler",):
        found = jaro_winkler_grid(a, b)
        return [finish(np.array([[jaro_winkler(x, y) for y in b] for x in a]) if found is None else found)]
    found = ratio_grids(a, b, kinds, finish)
    return [finish(g) for g in np.moveaxis(np.array([[all_ratios(x, y, kinds) for y in b] for x in a]), 2, 0)] if found is None else found


def _distinct(texts: list[str]) -> tuple[list[str], np.ndarray]:
    place: dict[str, int] = {}
    at = np.array([place.setdefault(t, len(place)) for t in texts], np.int64)
    return list(place), at


def _block(kinds: tuple[str, ...], digits: int, names: list[str], one: tuple, two: tuple) -> Iterator[pa.RecordBatch]:
    (ids, texts), (others, other_texts) = one, two
    b, of = _distinct(other_texts)
    step = max(1, STRIP // len(other_texts))
    # Rows of equal texts are neighbours, so a strip has few texts.
    order = np.array(sorted(range(len(texts)), key=texts.__getitem__))
    for at in range(0, len(order), step):
        rows = order[at : at + step]
        a, mine = _distinct([texts[i] for i in rows])
        values = grids(a, b, kinds, digits)
        if len(a) < len(rows) or len(b) < len(other_texts):
            values = [g[mine[:, None], of[None, :]] for g in values]
        left = ids.take(pa.array(np.repeat(rows, len(of))))
        right = others.take(pa.array(np.tile(np.arange(len(of)), len(rows))))
        yield pa.record_batch([left, right, *(pa.array(g.reshape(-1)) for g in values)], names=names)


def _kernel(kinds: tuple[str, ...], digits: int, names: list[str]):
    """Rows (key, chunks of both sides, side, left id, right id, text) come by block, left ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                sides = [(pa.chunked_array([x[0] for x in h]).combine_chunks(), [t for x in h for t in x[1]]) for h in held]
                yield from _block(kinds, digits, names, *sides)

        for b in batches:
            key = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            edges = [0, *(i for i in range(1, b.num_rows) if key[i] != key[i - 1]), b.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if key[s][:3] != block:
                    yield from done()
                    block, held = key[s][:3], ([], [])
                side = key[s][3]
                held[side].append((b.column(4 + side).slice(s, e - s), b.column(6).slice(s, e - s).to_pylist()))
        yield from done()

    return run


def joined_similarities(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, left_text: str, right_text: str, kinds: tuple[str, ...], digits: int = 6) -> DataFrame:
    """(left_id, right_id, kinds): rounded similarities of each row of left with each of right of equal
    `on`; kinds are names of ratios, or jaro_winkler alone. A null text counts as empty; rows of a null
    key, or of a key that the other side lacks, have no pairs."""
    n = left.groupBy(on).agg(F.count("*").alias("_n")).join(right.groupBy(on).agg(F.count("*").alias("_m")), on)
    tasks = n.agg(F.sum(F.ceil(F.col("_n") / LEFT) * F.ceil(F.col("_m") / RIGHT)), F.sum(F.col("_n").cast("double") * F.col("_m") / TASK)).first()
    cores = left.sparkSession.sparkContext.defaultParallelism
    parts = min(tasks[0] or 1, max(2 * cores, int(tasks[1] or 0) + 1))
    size = n.select(on, F.ceil(F.col("_n") / LEFT).cast("int").alias("_n"), F.ceil(F.col("_m") / RIGHT).cast("int").alias("_m"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda i, c: F.pmod(F.xxhash64(i), F.col(c)).cast("int")
    kept = lambda d, i: d.schema[i].dataType
    none = lambda d, i: F.lit(None).cast(kept(d, i))
    one = left.join(size, on).select(on, mine(left_id, "_n").alias("_p"), every("_m").alias("_q"), F.lit(0).alias("_side"), F.col(left_id).alias("_a"), none(right, right_id).alias("_b"), blank(left_text).alias("_text"))
    two = right.join(size, on).select(on, every("_n").alias("_p"), mine(right_id, "_m").alias("_q"), F.lit(1).alias("_side"), none(left, left_id).alias("_a"), F.col(right_id).alias("_b"), blank(right_text).alias("_text"))
    rows = one.unionByName(two).repartition(parts, on, "_p", "_q").sortWithinPartitions(on, "_p", "_q", "_side")
    schema = StructType([StructField(left_id, kept(left, left_id)), StructField(right_id, kept(right, right_id)), *(StructField(k, DoubleType()) for k in kinds)])
    return arrow(rows, _kernel(kinds, digits, schema.names), schema)
