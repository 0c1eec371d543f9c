"""Retrieval against a plain definition of the cosines, and plans as they should be."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.operators import blocks, tfidf
from tessera.operators.tfidf import Block

ROWS = [
    ("S1-1", "red shoe shop", "en"), ("S1-2", "blue boat", "en"), ("S1-3", "", "en"), ("S1-4", "red boat", "fr"), ("S1-5", None, "en"),
    ("S2-1", "red shoe store", "en"), ("S2-2", "red red boat", "en"), ("S3-3", "blue shoe", "en"), ("S3-4", "red boat", "fr"), ("S2-5", "", "en"), ("S2-6", "blue boat", "en"),
]


def brute(queries, pool, b):
    out = {}
    by = defaultdict(list)
    for i, t, c in pool:
        by[c].append((i, Counter((t or "").split())))
    for c, rows in by.items():
        n = len(rows)
        df = Counter(w for _, tf in rows for w in tf)
        most = n * b.max_df if n > b.small_pool else n
        keep = {w for w, k in df.items() if min(b.min_df, n) <= k <= most} or set(df)
        idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in keep}

        def unit(tf):
            v = {w: (1 + math.log(k)) * idf[w] for w, k in tf.items() if w in idf}  # noqa: B023
            s = math.sqrt(sum(x * x for x in v.values()))
            return {w: x / s for w, x in v.items()} if s else {}

        vectors = [(i, unit(tf)) for i, tf in rows]
        for q, t, qc in queries:
            if qc != c:
                continue
            v = unit(Counter((t or "").split()))
            found = [(round(sum(x * w.get(k, 0) for k, x in v.items()), 6), i) for i, w in vectors]
            found = sorted([(s, i) for s, i in found if s > b.min_score], key=lambda x: (-x[0], x[1]))[: b.k]
            out |= {(q, i): (s, r) for r, (s, i) in enumerate(found, 1)}
    return out


def test_top_k(spark):
    d = spark.createDataFrame(ROWS, "entity_id string, text string, country string")
    for b in (Block("w", "text", 2, 0.5, min_df=1, small_pool=3), Block("w", "text", 5, 0.01), Block("w", "text", 3, 1.0, min_df=2)):
        got = {(r["q_id"], r["p_id"]): (r["score"], r["rank"]) for r in tfidf.top_k(d.where(blocks.is_source(1)), d.where(~blocks.is_source(1)), b).collect()}
        want = brute([r for r in ROWS if r[0][1] == "1"], [r for r in ROWS if r[0][1] != "1"], b)
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)


def test_empty_sides(spark):
    d = spark.createDataFrame(ROWS, "entity_id string, text string, country string")
    b = Block("w", "text", 2, 0.5)
    assert tfidf.top_k(d.limit(0), d, b).count() == 0
    assert tfidf.top_k(d, d.limit(0), b).count() == 0


def test_terms(spark):
    d = spark.createDataFrame([("a b c", "abcde"), ("a", "abc"), ("", "")], "w string, c string")
    got = [tuple(r) for r in d.select(tfidf.word_pairs(F.col("w")), tfidf.char_grams(4)(F.col("c"))).collect()]
    assert got == [(["a", "b", "c", "a b", "b c"], ["abcd", "bcde"]), (["a"], []), ([], [])]


def test_union_and_reverse(spark):
    d = spark.createDataFrame([(i, t, "12 road 7", c) for i, t, c in ROWS], "entity_id string, name string, address string, country string")
    p = blocks.prepare(d)
    pairs = blocks.retrieve(p)
    assert pairs.count() == pairs.select("s1_id", "cand_id").distinct().count()
    assert {c for c in pairs.columns if c.startswith("s_")} == {f"s_{b.name}" for b in blocks.BLOCKS}
    ranked = blocks.sources(pairs, tuple(b.name for b in blocks.BLOCKS))
    assert ranked.where("block_rank = 1").count() == ranked.select("s1_id").distinct().count()
    rev = blocks.reverse_search(p, 2)
    assert rev.groupBy("rec_id").count().agg(F.max("count")).first()[0] <= 2


def test_plan_prunes_and_limits(spark, tmp_path):
    d = spark.createDataFrame([(i, t, "x", c, 1) for i, t, c in ROWS], "entity_id string, text string, unused string, country string, n int")
    d.write.parquet(str(tmp_path / "t"))
    p = spark.read.parquet(str(tmp_path / "t"))
    plan = tfidf.top_k(p.where(blocks.is_source(1)), p.where(~blocks.is_source(1)), Block("w", "text", 2, 0.5))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "unused" not in plan.split("== Physical Plan ==")[1]


def test_vectors_travel_once(spark, monkeypatch):
    """A vector is written once, however many blocks the other side has, and equal ones together."""
    rows = [(f"S{1 + i % 2}-{i}", " ".join(f"w{(i * j) % 11}" for j in (1, 2, 3)) if i < 60 else "w1 w2", "en") for i in range(100)]
    monkeypatch.setattr(tfidf, "CHUNK", 16)
    monkeypatch.setattr(tfidf, "GROUP", 16)
    tables = {}

    def staged(df, name, *args, **options):
        tables[name] = write(df, name, *args, **options)
        return tables[name]

    write = tfidf.staged
    monkeypatch.setattr(tfidf, "staged", staged)
    d = spark.createDataFrame(rows, "entity_id string, text string, country string")
    b = Block("w", "text", 4, 1.0, min_df=1)
    out = tfidf.top_k(d.where(blocks.is_source(1)), d.where(~blocks.is_source(1)), b)
    assert "explode" not in out._jdf.queryExecution().toString()
    got = {(r["q_id"], r["p_id"]): (r["score"], r["rank"]) for r in out.collect()}
    want = brute([r for r in rows if r[0][1] == "1"], [r for r in rows if r[0][1] != "1"], b)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)
    pool = {tuple(sorted(Counter(t.split()).items())) for i, t, _ in rows if i[1] == "2"}
    assert tables["pool"].count() == len(pool) and len(tables["pool"].inputFiles()) > 1
    assert tables["pool"].agg(F.max(F.size("ids"))).first()[0] == 4


def test_ids_of_several_rows(spark):
    """Rows of one id are one text, as in the SQL."""
    d = spark.createDataFrame([("S1-1", "a b", "x"), ("S1-1", "a", "x"), ("S2-1", "a", "x"), ("S2-1", "b c", "x"), ("S2-2", "a c", "x")], "entity_id string, text string, country string")
    out = tfidf.top_k(d.where(blocks.is_source(1)), d.where(~blocks.is_source(1)), Block("w", "text", 5, 1.0, min_df=1))
    assert [(r["q_id"], r["p_id"], r["rank"]) for r in out.orderBy("rank").collect()] == [("S1-1", "S2-1", 1), ("S1-1", "S2-2", 2)]
