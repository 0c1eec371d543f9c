"""Shared pieces of the corpus operators: tables, shared folder, run readers, spanning links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import arrow, delete, dropped, give_back, new_path, shared_folder, staged

__all__ = ["arrow", "blobs", "delete", "dropped", "fold", "give_back", "new_path", "runs", "share", "shared_folder", "spanning", "staged", "starts_of", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")), F.lit(n))


def share(key: Column, fraction: float, salt: int = 0) -> Column:
    """True for that share of the keys, chosen by hash and so alike in every run."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000)) < F.lit(int(fraction * 1_000_000))


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from input sorted by key; a table is cut at the first
    run boundary after `most` rows, so memory is bounded by `most` plus the largest run."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k == k[-1], True)) if not (k == k[-1]).all() else 0
        if last:
            yield t.slice(0, last)
            rest = t.slice(last).combine_chunks().to_batches()
            held, n = rest, sum(b.num_rows for b in rest)
    if held:
        yield pa.Table.from_batches(held)


def starts_of(keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def spanning(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs of a spanning forest of the bipartite graph of a boolean matrix.
    At most rows + columns - 1 pairs, however many entries are true."""
    rows, cols = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
    if not len(rows):
        return rows, cols
    m = link[np.ix_(rows, cols)]
    left, free = np.ones(len(rows), bool), np.ones(len(cols), bool)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while left.any():
        front = np.array([int(np.argmax(left))])
        left[front] = False
        while len(front):
            hit = m[front] & free
            new = np.flatnonzero(hit.any(0))
            if not len(new):
                break
            a.append(rows[front[hit[:, new].argmax(0)]])
            b.append(cols[new])
            free[new] = False
            back = m[:, new] & left[:, None]
            front = np.flatnonzero(back.any(1))
            if len(front):
                a.append(rows[front])
                b.append(cols[new[back[front].argmax(1)]])
                left[front] = False
    return np.concatenate(a), np.concatenate(b)
