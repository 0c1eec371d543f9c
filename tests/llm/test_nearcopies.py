"""Near-duplicates of the pipeline's stage against all pairs."""

import random

import numpy as np

import corpus_pipeline
from tessera.llm import nearcopies
from tessera.llm.simhash import fingerprint

from .test_kernels import connected

rng = random.Random(5)
SCHEMA = "doc_id long, text string, lang string"


def texts():
    """Copies of some texts with words replaced: most pairs are on both sides of similarity 0.8."""
    out = [None, "", " \n", "one two", "One  two", "one two three four five", "é ü"]
    for n in (30, 60, 120, 400):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            out.append(" ".join(base))
            for _ in range(4):
                copy = list(base)
                for _ in range(rng.randrange(1, max(2, n // 30))):
                    copy[rng.randrange(n)] = f"v{rng.randrange(5000)}"
                out.append(" ".join(copy))
    return out


def similar(a, b):
    a, b = nearcopies.shingles((a or "").encode()), nearcopies.shingles((b or "").encode())
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stage_reaches_similarity(spark):
    rows = texts()
    group = connected(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(rows[i], rows[j])])
    want = {min(j for j in range(len(rows)) if group[j] == group[i]) for i in range(len(rows))}
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], SCHEMA)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_prefix_filter_is_exact_and_skips_common_passages(spark):
    some = [t for t in dict.fromkeys(texts()) if t and t.strip()]
    passage = " ".join(f"p{i}" for i in range(80))
    some += [f"{passage} " + " ".join(f"u{k}x{i}" for i in range(24)) for k in range(40)]
    rows = [(i, t) for i, t in enumerate(some)]
    nodes = spark.createDataFrame([(i, i) for i, _ in rows], "node long, root long")
    first = nearcopies.prefixes(nodes, spark.createDataFrame(rows, "node long, text string"))
    got = {tuple(r) for r in nearcopies.prefix_pairs(first, nodes).collect()}
    want = {(i, j) for j in range(len(some)) for i in range(j) if similar(some[i], some[j])}
    assert want <= got and all(a < b < len(some) - 40 for a, b in got)
    same = nodes.withColumn("root", nodes["root"] * 0)
    assert nearcopies.prefix_pairs(first, same).count() == 0 and nearcopies.hub_pairs(first, same).count() == 0
    assert 0 < nearcopies.hub_pairs(first, nodes).count() < first.count()


def test_deleted_value_meets():
    least = np.arange(nearcopies.SEGMENTS * nearcopies.VALUES, dtype=np.uint64)
    other = least + np.uint64(100)
    other[: nearcopies.VALUES] = least[: nearcopies.VALUES]
    other[2] = 99
    assert len(set(nearcopies.keys(least)) & set(nearcopies.keys(other))) == 1
    other[3] = 98
    assert not set(nearcopies.keys(least)) & set(nearcopies.keys(other))


def test_rows_of_one_id_in_different_groups_stay(spark):
    first, second, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(None, first, "en"), (None, second, "en"), (None, second, "de"), (7, third, "en"), (7, first + " end", "en"), (7, "other words", "en"), (8, "other words", "en")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("None", second), ("7", third), ("7", first + " end"), ("7", "other words")])


def test_simhash_by_deletion_variants_links_by_itself(spark, monkeypatch):
    rows = [t for t in texts() if t and t.strip()]
    names = {nearcopies.node(t.encode()): t for t in rows}
    prints = {n: fingerprint(t.encode(), nearcopies.SHINGLE) for n, t in names.items()}
    order = list(names)
    near = [(i, j) for i in range(len(order)) for j in range(i) if (prints[order[i]] ^ prints[order[j]]).bit_count() <= 3]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], SCHEMA)
    place = {n - (1 << 64) if n >> 63 else n: i for i, n in enumerate(order)}
    got = [(place[r["a"]], place[r["b"]]) for r in nearcopies.simhash_pairs(docs).collect()]
    groups = [connected(len(order), links) for links in (got, near)]
    assert near and len(set(zip(*groups, strict=True))) == len(set(groups[0])) == len(set(groups[1]))
    monkeypatch.setattr(nearcopies, "_keyed", lambda docs: spark.createDataFrame([], "node long, key long"))
    true = [(i, j) for i, j in got if similar(names[order[i]], names[order[j]])]
    roots = {r["node"]: r["root"] for r in nearcopies.components(docs).collect()}
    assert true and all(roots[a - (1 << 64) if a >> 63 else a] == roots[b - (1 << 64) if b >> 63 else b] for a, b in ((order[i], order[j]) for i, j in true))
    assert len(roots) == len({i for p in true for i in p})
