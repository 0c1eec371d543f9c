"""Near-duplicates by the similarity of their texts: Jaccard similarity of the sets of five-word
shingles of at least 0.8.

First SimHash by deletion variants, as in simhash.py but of five-word shingles: fingerprints that differ
in at most three bits meet. The radius that SimHash needs for 0.8 is too wide for an index: at that
similarity about 15 % of its bits differ, whatever the width, so a segment that is sure to differ in at
most one bit has about nine bits. So what is beyond three bits is found by a second fingerprint, made of
48 min-hashes, in 8 segments of 6, and indexed as there:
each segment under its variants with one value deleted. Fingerprints that differ in at most 15 of
48 places agree in a segment up to one value for certain; at similarity 0.8 about 9.6 differ, and
0.345^8 = 0.02 % of such pairs agree in no segment (fewer above 0.8). Pairs that meet by either are
verified on their exact shingles.

Skew: texts with equal words collapse to one node first. A key's nodes are compared with its least
and greatest node, so a large group of near copies makes a number of pairs in proportion to its
size. What is not connected then, under a key that holds more than one part, is mostly texts that
share much but less than 0.8 (a common passage with a little around it), of which every pair meets.
Their pairs are not listed but found by an exact prefix filter: with the shingles of each text in one
order, the rarest first, a pair of similarity 0.8 has its first common shingle early in both, with
enough left after it. Shared passages stand late in that order, so they bring nothing together. Of
the texts that share such a shingle, each is compared first with the one whose shingles are the most
common (of near copies, the least changed), which connects most of what can be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow, blobs, dropped, staged
from .components import connected_components
from .simhash import LOWER, fingerprint, fingerprint_links

SHINGLE, SEGMENTS, VALUES = 5, 8, 6
#: Similarity of 4 / 5 at least, in whole numbers.
SHARED, UNITED = 5, 4

_rng = np.random.default_rng(20)
_TIMES = _rng.integers(0, 1 << 63, SEGMENTS * VALUES, np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, SEGMENTS * VALUES, np.uint64)
_PLACE = _rng.integers(0, 1 << 63, (SEGMENTS, VALUES), np.uint64)


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def shingles(text: bytes, k: int = SHINGLE) -> set[bytes]:
    """Texts shorter than k words are one shingle, those without words have none."""
    w = words(text)
    return {b" ".join(w)} if 0 < len(w) < k else set(map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)))


def node(text: bytes) -> int:
    """Names the words of a text: 0 if there are none."""
    w = words(text)
    return xxhash.xxh64_intdigest(b" ".join(w)) if w else 0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def minima(found: set[bytes]) -> np.ndarray:
    """The min-hashes of a set of shingles that is not empty."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    least = np.full(SEGMENTS * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        np.minimum(least, (part[None, :] * _TIMES[:, None] + _PLUS[:, None]).min(1), out=least)
    return least


def keys(least: np.ndarray) -> np.ndarray:
    """A key for each segment and each of its values that is deleted."""
    x = _mix(least.reshape(SEGMENTS, VALUES) ^ _PLACE)
    return _mix((x.sum(1, keepdims=True, dtype=np.uint64) - x) ^ _PLACE).reshape(-1)


def marked(docs: DataFrame, name: str = "_node") -> DataFrame:
    """docs with one more column, the node of each row's text as a signed long."""
    at = docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter(map(node, blobs(b.column(at))), np.uint64, b.num_rows)
            yield pa.record_batch([*b.columns, pa.array(n.view(np.int64))], names=[*b.schema.names, name])

    return arrow(docs, kernel, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _keyed(docs: DataFrame) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, found = [], []
            for t in blobs(b.column(0)):
                s = shingles(t)
                if s:
                    nodes.append(node(t))
                    found.append(keys(minima(s)))
            if nodes:
                k = np.concatenate(found).view(np.int64)
                yield pa.record_batch([pa.array(np.repeat(np.array(nodes, np.uint64).view(np.int64), SEGMENTS * VALUES)), pa.array(k)], names=["node", "key"])

    return arrow(docs.select(F.col("text").cast("string").alias("text")), kernel, "node long, key long")


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """(node, fp): the SimHash of the shingles of each text that has words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(n, fingerprint(t, SHINGLE)) for t in blobs(b.column(0)) if (n := node(t))]
            x = np.array(own, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["node", "fp"])

    return arrow(docs.select(F.col("text").cast("string").alias("text")), kernel, "node long, fp long")


def simhash_pairs(docs: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes of equal fingerprints (each with the least) and the least nodes of
    fingerprints that deletion variants link."""
    own = staged(_fingerprinted(docs).distinct(), "fingerprints")
    least = staged(own.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    same = own.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    one, two = (least.select(F.col("fp").alias(u), F.col("least").alias(a)) for u, a in (("u", "x"), ("v", "y")))
    near = fingerprint_links(least.select("fp")).join(one, "u").join(two, "v").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out = staged(same.unionByName(near).distinct(), "simhash-pairs")
    dropped(own)
    dropped(least)
    return out


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, mine = None, set()
    for b in batches:
        keep = []
        for a, x, y in zip(b.column(0).to_pylist(), blobs(b.column(2)), blobs(b.column(3)), strict=True):
            if a != last:
                last, mine = a, shingles(x)
            other = shingles(y)
            both = len(mine & other)
            keep.append(SHARED * both >= UNITED * (len(mine) + len(other) - both))
        yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").sortWithinPartitions("a"), _similar, "a long, b long")


def _tokens(texts: DataFrame) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({xxhash.xxh64_intdigest(x) - (1 << 63) for x in shingles(t)}) for t in blobs(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "tokens"])

    return arrow(texts.select("node", "text"), kernel, "node long, tokens array<long>")


def prefixes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(token, node, n, i, score): the first shingles of each node (node) of which another node has one
    too, in the order of how many have them: the size of the set, the place in the order, and how
    common the shingles of the node are. texts: (node, text).

    For sizes n <= m of two sets of similarity 0.8, the first common shingle is among the first
    n - 8n/9 + 1 of the smaller set and the first m - 4m/5 + 1 of the larger; the latter are listed."""
    own = staged(_tokens(texts.join(nodes, "node", "left_semi")), "tokens")
    each = own.select("node", F.explode("tokens").alias("token"))
    shared = staged(each.groupBy("token").agg(F.count("*").alias("f")).where("f > 1"), "token-counts")
    # A set in order: shingles of one text alone, then shared ones, the rarest first; only these are listed.
    listed = each.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("s"))
    sized = own.select("node", F.size("tokens").alias("n")).join(listed, "node").withColumns({"alone": F.col("n") - F.size("s"), "score": F.expr("aggregate(s, 0D, (t, x) -> t + x.f) / n")})
    first = F.expr("slice(s, 1, greatest(0, n - cast(ceil(4 * n / 5) as int) + 1 - alone))")
    rows = sized.select("node", "n", "alone", "score", F.posexplode(F.transform(first, lambda x: x["token"])).alias("p", "token"))
    out = staged(rows.select("token", "node", "n", (F.col("alone") + F.col("p")).alias("i"), "score"), "prefixes")
    dropped(own)
    dropped(shared)
    return out


def hub_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: each node (node, root) with the node of the most common shingles among those that
    have one of its first shingles, if their roots and sizes do not rule it out."""
    every = rows.join(nodes, "node")
    hub = every.groupBy("token").agg(F.max(F.struct("score", "node", "root", "n")).alias("h")).select("token", F.col("h.node").alias("hub"), F.col("h.root").alias("hroot"), F.col("h.n").alias("hn"))
    met = every.join(hub, "token").where("root <> hroot and 5 * least(n, hn) >= 4 * greatest(n, hn)")
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def prefix_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes (node, root) of different roots that can have similarity 0.8, none
    that has it left out: their first common shingle stands early in both, and after it there are as
    many left in both as the two must share, 4/9 of n + m."""
    every = staged(rows.join(nodes, "node").select("token", "node", "root", "n", "i"), "prefixes")
    small = every.where("i < n - cast(ceil(8 * n / 9) as int) + 1").select("token", *[F.col(c).alias(f"y{c}") for c in ("node", "root", "n", "i")])
    met = small.join(every, "token").where(
        "root <> yroot and (yn < n or yn = n and ynode < node) and 5 * yn >= 4 * n and 9 * least(yn - yi, n - i) >= 4 * (yn + n)"
    )
    out = staged(met.select(F.least("node", "ynode").alias("a"), F.greatest("node", "ynode").alias("b")).distinct(), "prefix-pairs")
    dropped(every)
    return out


def components(docs: DataFrame) -> DataFrame:
    """(node, root): one row for each node of docs (text) that is similar to another; nodes share
    a root exactly if links of similarity 0.8 that the indexes meet connect them."""
    close = simhash_pairs(docs)
    keyed = staged(_keyed(docs).distinct(), "keys")
    met = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    members = staged(keyed.join(met, "key"), "members")
    dropped(keyed)
    ends = members.select(F.explode(F.array("lo", "hi")).alias("end"), "node").where("end <> node")
    ends = ends.select(F.least("end", "node").alias("a"), F.greatest("end", "node").alias("b"))
    pairs = staged(ends.unionByName(close).distinct(), "pairs")
    asked = members.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = marked(docs.select(F.col("text").cast("string").alias("text")), "node").groupBy("node").agg(F.min("text").alias("text"))
    texts = staged(texts.join(asked, "node", "left_semi"), "texts")
    links = staged(_links(pairs, texts), "links")
    roots = connected_components(links, "a", "b")
    placed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = staged(placed.join(split, "key").select("node", "root").distinct(), "split")
    first = prefixes(left, texts)
    hubs = staged(hub_pairs(first, left).join(pairs, ["a", "b"], "left_anti"), "hubs")
    linked = staged(_links(hubs, texts), "links")
    # The parts that the hubs connect, named by their roots.
    at = left.select(F.col("node").alias("a"), F.col("root").alias("u")), left.select(F.col("node").alias("b"), F.col("root").alias("v"))
    wider = connected_components(linked.join(at[0], "a").join(at[1], "b"), "u", "v")
    now = left.join(wider.select(F.col("node").alias("root"), F.col("root").alias("wide")), "root", "left").select("node", F.coalesce("wide", "root").alias("root"))
    rest = staged(prefix_pairs(first, now).join(pairs, ["a", "b"], "left_anti").join(hubs, ["a", "b"], "left_anti"), "rest")
    more = staged(linked.unionByName(_links(rest, texts)), "links")
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more), "a", "b")
    for x in (close, members, pairs, texts, links, left, first, hubs, linked, wider, rest, more):
        dropped(x)
    return roots
