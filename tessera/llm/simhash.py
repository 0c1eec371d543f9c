"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most three bits agree, in one of their two 32-bit
segments, up to one bit. So every distinct segment value is indexed under its variants with one
wildcard (and under itself), the variants are joined by equality, and the few segment pairs that
meet are expanded to their fingerprints and verified on all 64 bits.

Skew: copies collapse to one fingerprint before anything is joined; the variant join runs on
distinct segment values, where a key has one value on each side; a segment that many fingerprints
share is dealt in chunks, and its pairs of chunks are verified in separate tasks that return a
spanning forest of the links they find, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, blobs, dropped, runs, spanning, staged, starts_of
from .components import connected_components

#: A-Z to a-z, other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SHINGLE, SEED, CHUNK = 3, 42, 512


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How often each of 64 bits (0: lowest) is set in an array of uint64."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            total += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[whole:].sum(0, dtype=np.int64)
    return total


_PLACE = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the k-word shingles of a text, repeats included; a bit is set if it is set in
    over half of the hashes. Texts shorter than k words are one shingle, those without words 0."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < k else map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in parts), np.uint64)
    return int(_PLACE[2 * bit_sums(h) > len(h)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x, k, seed) for x in blobs(b.column(1))), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), kernel, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _verify(radius: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "tile"):
            tile, side = t.column("tile").to_numpy(), t.column("side").to_numpy()
            fp = t.column("fp").to_numpy().view(np.uint64)
            at = starts_of(tile)
            us, vs = [], []
            for s, e in zip(at[:-1], at[1:], strict=True):
                x, one = fp[s:e], side[s:e] == 0
                a, b = x[one], x[~one]
                if not len(b):  # a chunk with itself
                    b = a
                link = _popcount(a[:, None] ^ b[None, :]) <= radius
                i, j = spanning(link)
                us.append(a[i])
                vs.append(b[j])
            u, v = (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.uint64),) * 2
            keep = u != v
            yield pa.record_batch([pa.array(u[keep].view(np.int64)), pa.array(v[keep].view(np.int64))], names=["u", "v"])

    return kernel


def fingerprint_links(fps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links that connect all fingerprints (column fp, distinct) within three bits of each
    other. Not all links: a spanning forest of those of each pair of chunks."""
    seg = fps.select("fp", F.posexplode(F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("seg", "value"))
    values = staged(seg.groupBy("seg", "value").agg(F.count("*").alias("n")), "segments")
    # Variant i >= 0 has bit i out; its key meets one value with that bit and one without it. Dealt
    # anew, as the written table may be few small files and each row makes 32.
    spread = values.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value")
    deleted = spread.select("seg", "value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    bit = F.expr("shiftleft(1L, i)")
    variants = deleted.select(
        F.expr("shiftleft(cast(seg * 32 + i as bigint), 32)").bitwiseOR(F.col("value").bitwiseAND(F.bitwise_not(bit))).alias("key"),
        (F.col("value").bitwiseAND(bit) != 0).cast("int").alias("set"),
    )
    met = variants.groupBy("key").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo < hi")
    low = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    pairs = met.select(F.expr("cast(shiftrightunsigned(key, 37) as int)").alias("seg"), low.alias("x"), low.bitwiseOR(F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 32) % 32 as int))")).alias("y"))
    same = values.where("n > 1").select("seg", F.col("value").alias("x"), F.col("value").alias("y"))
    size = values.select("seg", "value", F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    pairs = (
        pairs.unionByName(same)
        .join(size.select("seg", F.col("value").alias("x"), F.col("c").alias("cx")), ["seg", "x"])
        .join(size.select("seg", F.col("value").alias("y"), F.col("c").alias("cy")), ["seg", "y"])
    )
    tiles = pairs.select("seg", "x", "y", F.explode(F.sequence(F.lit(0), F.col("cx") - 1)).alias("p"), "cy").select("seg", "x", "y", "p", F.explode(F.sequence(F.lit(0), F.col("cy") - 1)).alias("q")).where("x <> y or p <= q")
    tiles = tiles.withColumn("tile", F.xxhash64("seg", "x", "y", "p", "q"))
    first = F.struct(F.col("x").alias("value"), F.col("p").alias("part"), F.lit(0).alias("side"))
    second = F.struct(F.col("y").alias("value"), F.col("q").alias("part"), F.lit(1).alias("side"))
    ends = tiles.select("tile", "seg", F.inline(F.when(F.expr("x = y and p = q"), F.array(first)).otherwise(F.array(first, second))))  # a chunk with itself is sent once
    members = seg.join(size, ["seg", "value"]).select("seg", "value", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int").alias("part"), "fp")
    dealt = ends.join(members, ["seg", "value", "part"]).select("tile", "side", "fp")
    return arrow(dealt.repartition("tile").sortWithinPartitions("tile"), _verify(3), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fp (signed long), component_id, the
    smallest doc_id reachable over links between fingerprints that differ in at most three bits.

    Null and empty texts have fingerprint 0 and link like any other; rows with equal texts, or
    equal doc_id, are all returned; an empty table gives an empty result; further columns of docs
    are ignored. A null doc_id is kept and gets the component of its fingerprint."""
    members = staged(fingerprints(docs, k, seed), "fingerprints")
    distinct = staged(members.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = fingerprint_links(distinct.select("fp"), chunk)
    roots = connected_components(links)
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "named")
    # Written out: the join has a plain exchange on both sides, so AQE can split a large component.
    lowest = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "lowest")
    by_fp = staged(named.join(lowest, "root").select("fp", "component_id"), "classes")
    for x in (distinct, named, lowest):
        dropped(x)
    return members.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
