"""Queries of cutoffs, decisions, list features, metrics and error reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, features, metrics, models, reports
from .base import ORDER_TRUTH, SCORED, order_truth, query, r6, scored, table
from .similarity import ratio_tables

RANKED = f"{SCORED}, ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS INTEGER) AS block_rank, max(prob) OVER (PARTITION BY s1_id) AS best FROM scored)"
PICK = "s1_id, cand_id, prob"


def f_sql(pred: str) -> str:
    return f"""got AS (SELECT p.s1_id, count(*) AS n_cand, count(w.cand_id) AS tp FROM (SELECT DISTINCT s1_id, cand_id FROM {pred}) p LEFT JOIN want w ON w.s1_id = p.s1_id AND w.cand_id = p.cand_id GROUP BY 1),
per_s1 AS (SELECT t.s1_id, n_true, coalesce(n_cand, 0) AS n_cand, coalesce(tp, 0) AS tp FROM truth t LEFT JOIN got USING (s1_id)),
f AS (SELECT *, CASE WHEN n_true = 0 THEN CAST(n_cand = 0 AS DOUBLE) WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_cand) * (tp / n_true) / (0.25 * (tp / n_cand) + tp / n_true) END AS f05,
  CASE WHEN n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_true) / (0.25 + tp / n_true) END AS oracle FROM per_s1)"""


def rank_and_score(d):
    return decide.ranked(d).withColumn("block_score", F.col("prob"))


@query(f"WITH {RANKED} SELECT {PICK} FROM ranked WHERE block_rank <= 3 AND prob >= 0.2")
def select_candidates(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("prune_prob", F.col("prob"))
    return features.select_candidates(d, 3, 0.2).select("s1_id", "cand_id", "prob")


@query(f"WITH {RANKED} SELECT {PICK}, block_rank FROM ranked WHERE block_rank <= 1 OR (block_rank <= 4 AND prob >= 0.3 AND prob >= best * 0.6)")
def adaptive_cutoff(spark, sf_dir):
    return decide.adaptive_cutoff(scored(spark, sf_dir), 1, 0.3, 0.6, 4).select("s1_id", "cand_id", "prob", "block_rank")


@query(f"WITH {RANKED} SELECT 'topk' AS kind, {PICK} FROM ranked WHERE block_rank <= 3 UNION ALL SELECT 'gap', {PICK} FROM ranked WHERE prob >= best - 0.2 UNION ALL SELECT 'min_score', {PICK} FROM ranked WHERE prob >= 0.5 UNION ALL SELECT 'topk_gap', {PICK} FROM ranked WHERE block_rank <= 2 AND prob >= best - 0.4")
def list_cutoffs(spark, sf_dir):
    d = rank_and_score(scored(spark, sf_dir))
    out = None
    for kind, v in (("topk", 3), ("gap", 0.2), ("min_score", 0.5), ("topk_gap", (2, 0.4))):
        one = decide.cutoff(d, kind, v).select(F.lit(kind).alias("kind"), "s1_id", "cand_id", "prob")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {RANKED} SELECT {PICK} FROM ranked WHERE prob >= 0.7 OR (block_rank = 1 AND prob >= 0.5)")
def decide_first(spark, sf_dir):
    return decide.decide_first(scored(spark, sf_dir), 0.7, 0.5).select("s1_id", "cand_id", "prob")


@query(f"WITH {RANKED} SELECT {PICK} FROM ranked WHERE prob >= 0.7 OR (prob = best AND prob >= 0.5)")
def decide_threshold(spark, sf_dir):
    return decide.decide(scored(spark, sf_dir), 0.7, 0.5).select("s1_id", "cand_id", "prob")


EXCLUSIVE = f"{RANKED}, pred AS (SELECT {PICK} FROM ranked WHERE prob >= 0.7 OR (prob = best AND prob >= 0.5) QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) = 1)"


@query(f"WITH {EXCLUSIVE} SELECT * FROM pred")
def decide_exclusive(spark, sf_dir):
    return decide.decide(scored(spark, sf_dir), 0.7, 0.5, True).select("s1_id", "cand_id", "prob")


@query(f"WITH {RANKED} SELECT {PICK} FROM ranked WHERE prob >= CASE country WHEN 'F' THEN 0.9 ELSE 0.7 END OR (prob = best AND prob >= 0.5)")
def decide_country(spark, sf_dir):
    return decide.decide(scored(spark, sf_dir), decide.country_threshold(0.7, {"F": 0.9}), 0.5).select("s1_id", "cand_id", "prob")


@query(f"WITH {SCORED} SELECT s1_id, cand_id, count(*) OVER (PARTITION BY cand_id) AS n_claims FROM scored WHERE prob >= 0.9")
def claims(spark, sf_dir):
    return decide.claims(scored(spark, sf_dir).where("prob >= 0.9")).select("s1_id", "cand_id", "n_claims")


# ------------------------------------------------------------------ list features

FEATS = f"""{SCORED}, feats AS (SELECT s1_id, cand_id, prob AS prune_prob, name_ts, name_ts AS name_ratio, addr_ts, CASE WHEN house_sign <> 0 THEN addr_ts END AS num_jacc, CAST(house_sign AS DOUBLE) AS house_tol, name_ts AS skel_ratio FROM scored),
cut AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY prune_prob DESC, cand_id) AS INTEGER) AS block_rank FROM feats) WHERE block_rank <= 6)"""


def candidate_features(spark, sf_dir):
    d = scored(spark, sf_dir)
    d = d.select("s1_id", "cand_id", F.col("prob").alias("prune_prob"), "name_ts", F.col("name_ts").alias("name_ratio"), "addr_ts", F.when(F.col("house_sign") != 0, F.col("addr_ts")).alias("num_jacc"), F.col("house_sign").cast("double").alias("house_tol"), F.col("name_ts").alias("skel_ratio"))
    return features.select_candidates(d, 6, 0.0)


@query(
    f"""WITH {FEATS} SELECT s1_id, cand_id, block_rank AS prune_rank, round(max(prune_prob) OVER w - prune_prob, 6) AS prune_gap, count(*) OVER w AS n_final, CAST(count(*) FILTER (name_ts >= 0.9) OVER w AS BIGINT) AS n_name_hi,
 CAST(count(*) FILTER (house_tol = 1) OVER w AS BIGINT) AS n_house_eq, CAST(rank() OVER (PARTITION BY s1_id ORDER BY name_ts DESC NULLS LAST) AS INTEGER) AS name_ts_rank, CAST(rank() OVER (PARTITION BY s1_id ORDER BY addr_ts DESC NULLS LAST) AS INTEGER) AS addr_ts_rank,
 round(max(name_ts) OVER w - name_ts, 6) AS name_ts_gap, round(max(addr_ts) OVER w - addr_ts, 6) AS addr_ts_gap, round(max(num_jacc) OVER w - num_jacc, 6) AS num_jacc_gap, max(house_tol) OVER w - house_tol AS house_tol_gap FROM cut WINDOW w AS (PARTITION BY s1_id)"""
)
def list_features(spark, sf_dir):
    d = features.list_features(candidate_features(spark, sf_dir))
    return d.select("s1_id", "cand_id", "prune_rank", r6("prune_gap").alias("prune_gap"), "n_final", "n_name_hi", "n_house_eq", "name_ts_rank", "addr_ts_rank", *[r6(c).alias(c) for c in ("name_ts_gap", "addr_ts_gap", "num_jacc_gap")], "house_tol_gap")


PART_TEXT = "(SELECT p_partkey, lower(p_name) AS name_m, lower(p_type) AS addr, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS house FROM part)"


def part_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey"), F.lower("p_name").alias("name_m"), F.lower("p_type").alias("addr"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_size").cast("string")).alias("house"))


@query(
    f"""WITH {FEATS}, t AS (SELECT s1_id, cand_id, prune_prob, p.* FROM cut JOIN {PART_TEXT} p ON p.p_partkey = CAST(split_part(cand_id, '-', 2) AS BIGINT)),
s AS (SELECT a.s1_id, a.cand_id, b.prune_prob AS w, b.cand_id AS o, CASE WHEN a.house <> '' AND b.house <> '' THEN 1 ELSE 0 END AS has, CASE WHEN a.house <> '' AND a.house = b.house THEN 1 ELSE 0 END AS same, CAST(a.name_m = b.name_m AS INTEGER) AS eq
 FROM t a JOIN t b ON a.s1_id = b.s1_id AND a.cand_id <> b.cand_id)
SELECT s1_id, cand_id, round(sum(same * w) / nullif(sum(has * w), 0), 6) AS sib_house_w, arg_max(same, struct_pack(w := w, o := o)) AS sib_house_best, CAST(sum(eq) AS BIGINT) AS sib_same_name_n FROM s GROUP BY ALL"""
)
def sibling_house(spark, sf_dir):
    c = candidate_features(spark, sf_dir)
    texts = part_text(spark, sf_dir)
    ids = c.select(F.col("cand_id").alias("entity_id")).distinct().withColumn("p_partkey", F.split_part("entity_id", F.lit("-"), F.lit(2)).cast("long")).join(texts, "p_partkey").drop("p_partkey")
    d = features.sibling_features(c, ids).where("sib_same_name_n is not null")
    return d.select("s1_id", "cand_id", r6("sib_house_w").alias("sib_house_w"), "sib_house_best", "sib_same_name_n")


@query(
    f"""WITH {FEATS}, t AS (SELECT s1_id, cand_id, prune_prob, name_m, addr FROM cut JOIN {PART_TEXT} p ON p.p_partkey = CAST(split_part(cand_id, '-', 2) AS BIGINT)),
o AS (SELECT a.s1_id, a.cand_id, a.name_m AS ma, b.name_m AS mb, a.addr AS xa, b.addr AS xb, b.prune_prob AS w FROM t a JOIN t b ON a.s1_id = b.s1_id AND a.cand_id <> b.cand_id),
each_ AS (SELECT DISTINCT ma AS a, mb AS b FROM o UNION SELECT DISTINCT xa, xb FROM o), {ratio_tables("each_")},
x AS (SELECT o.*, n.token_set_ratio AS sn, z.token_set_ratio AS sa FROM o JOIN s n ON n.a = ma AND n.b = mb JOIN s z ON z.a = xa AND z.b = xb),
y AS (SELECT s1_id, cand_id, round(max(sn), 6) AS sib_name_max, round(sum(sn * w) / (sum(w) + 1e-6), 6) AS sib_name_w, round(max(sa), 6) AS sib_addr_max, round(sum(sa * w) / (sum(w) + 1e-6), 6) AS sib_addr_w, round(max(sn * sa * w), 6) AS sib_support FROM x GROUP BY ALL)
SELECT s1_id, cand_id, sib_name_max, sib_name_w, sib_addr_max, sib_addr_w, sib_support FROM cut LEFT JOIN y USING (s1_id, cand_id)"""
)
def sibling_support(spark, sf_dir):
    c = candidate_features(spark, sf_dir)
    ids = c.select(F.col("cand_id").alias("entity_id")).distinct().withColumn("p_partkey", F.split_part("entity_id", F.lit("-"), F.lit(2)).cast("long")).join(part_text(spark, sf_dir), "p_partkey").drop("p_partkey")
    d = features.sibling_features(c, ids)
    return d.select("s1_id", "cand_id", *[r6(x).alias(x) for x in ("sib_name_max", "sib_name_w", "sib_addr_max", "sib_addr_w", "sib_support")])


@query(
    f"""WITH {SCORED}, rev AS (SELECT * FROM (SELECT cand_id, s1_id, addr_ts AS score, CAST(row_number() OVER (PARTITION BY cand_id ORDER BY addr_ts DESC, s1_id) AS INTEGER) AS rank FROM scored) WHERE rank <= 10),
b AS (SELECT cand_id, max(score) AS best FROM rev GROUP BY 1)
SELECT s.s1_id, s.cand_id, CAST(r.rank AS DOUBLE) AS rev_rank, round(best - score, 6) AS rev_gap, CAST(best - score <= 0.02 AS DOUBLE) AS rev_n_close, name_ts AS orphan_prob FROM scored s LEFT JOIN rev r ON r.s1_id = s.s1_id AND r.cand_id = s.cand_id LEFT JOIN b ON b.cand_id = s.cand_id
 JOIN (SELECT cand_id, max(name_ts) AS name_ts FROM scored GROUP BY 1) o ON o.cand_id = s.cand_id""".replace("name_ts AS orphan_prob", "o.name_ts AS orphan_prob")
)
def extra_features(spark, sf_dir):
    from pyspark.sql import Window

    d = scored(spark, sf_dir)
    rev = d.select(F.col("cand_id").alias("rec_id"), "s1_id", F.col("addr_ts").alias("score"), F.row_number().over(Window.partitionBy("cand_id").orderBy(F.desc("addr_ts"), "s1_id")).alias("rank")).where("rank <= 10")
    orphans = d.groupBy(F.col("cand_id").alias("rec_id")).agg(F.max("name_ts").alias("orphan_prob"))
    out = features.extra_features(d, rev, orphans)
    return out.select("s1_id", "cand_id", F.col("rev_rank").cast("double").alias("rev_rank"), r6("rev_gap").alias("rev_gap"), F.col("rev_n_close").cast("double").alias("rev_n_close"), "orphan_prob")


@query(
    """WITH c AS (SELECT 'S1-' || l_orderkey AS s1_id, 'S2-' || l_partkey AS cand_id FROM lineitem GROUP BY ALL),
q AS (SELECT 'S1-' || o_orderkey AS s1_id, CASE WHEN o_orderpriority LIKE '%HIGH%' THEN NULL ELSE o_orderstatus END AS lq, round(o_totalprice / 1000000, 6) AS p_zero FROM orders), p AS (SELECT 'S2-' || p_partkey AS cand_id, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'F' ELSE 'O' END AS lp FROM part)
SELECT s1_id, cand_id, p_zero, CASE WHEN lq IS NOT NULL AND lp IS NOT NULL THEN CAST(lq = lp AS DOUBLE) END AS legal_eq, CAST((lq IS NOT NULL)::INT + (lp IS NOT NULL)::INT AS INTEGER) AS legal_n FROM c LEFT JOIN q USING (s1_id) LEFT JOIN p USING (cand_id)"""
)
def late_features(spark, sf_dir):
    ids = lambda s, c: F.concat(F.lit(s), F.col(c).cast("string"))
    c = table(spark, sf_dir, "lineitem").select(ids("S1-", "l_orderkey").alias("s1_id"), ids("S2-", "l_partkey").alias("cand_id")).distinct()
    o = table(spark, sf_dir, "orders")
    zero = o.select(ids("S1-", "o_orderkey").alias("s1_id"), r6(F.col("o_totalprice") / 1000000).alias("p_zero"))
    legal = o.select(ids("S1-", "o_orderkey").alias("entity_id"), F.when(~F.col("o_orderpriority").contains("HIGH"), F.col("o_orderstatus")).alias("legal_suffix")).unionByName(
        table(spark, sf_dir, "part").select(ids("S2-", "p_partkey").alias("entity_id"), F.when(F.col("p_size") % 3 == 1, "F").when(F.col("p_size") % 3 == 2, "O").alias("legal_suffix"))
    )
    return features.late_features(c, zero, legal).select("s1_id", "cand_id", "p_zero", F.col("legal_eq").cast("double").alias("legal_eq"), "legal_n")


# ------------------------------------------------------------------ metrics

ALL = f"{RANKED}, {ORDER_TRUTH}"
PRED = f"{ALL}, pred AS (SELECT {PICK}, country FROM ranked WHERE prob >= 0.7 OR (prob = best AND prob >= 0.5)), {f_sql('pred')}"


def predicted(spark, sf_dir):
    return decide.decide(scored(spark, sf_dir), 0.7, 0.5)


@query(f"WITH {PRED} SELECT round(avg(f05), 6) AS macro_f05, count(*) AS n_s1 FROM f")
def f05_macro(spark, sf_dir):
    return metrics.macro_f05(predicted(spark, sf_dir), order_truth(spark, sf_dir)).select(r6("macro_f05").alias("macro_f05"), "n_s1")


@query(f"WITH {PRED} SELECT s1_id, n_true, n_cand, tp, round(f05, 6) AS f05 FROM f")
def f05_records(spark, sf_dir):
    return metrics.scores(predicted(spark, sf_dir), order_truth(spark, sf_dir)).withColumn("f05", r6("f05"))


@query(f"WITH {PRED} SELECT o_orderpriority AS country, round(avg(f05), 6) AS macro_f05, count(*) AS n_s1 FROM f JOIN orders ON s1_id = 'S1-' || o_orderkey GROUP BY 1")
def f05_by_country(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("s1_id"), F.col("o_orderpriority").alias("country"))
    d = metrics.macro_f05_by(predicted(spark, sf_dir), order_truth(spark, sf_dir), c)
    return d.withColumn("macro_f05", r6("macro_f05"))


@query(f"WITH {PRED} SELECT s1_id, round(oracle, 6) AS oracle FROM f")
def oracle_ceiling(spark, sf_dir):
    d = metrics.per_record(predicted(spark, sf_dir), order_truth(spark, sf_dir))
    return d.select("s1_id", r6(metrics.oracle(F.col("tp"), F.col("n_true"))).alias("oracle"))


CANDS = f"{ALL}, pred AS (SELECT s1_id, cand_id FROM scored), {f_sql('pred')}"


@query(
    f"""WITH {CANDS}, n AS (SELECT count(*) AS pool_size FROM part), h AS (SELECT n_cand, sum(count(*)) OVER (ORDER BY n_cand) AS upto, sum(count(*)) OVER () AS a FROM f GROUP BY 1),
raw AS (SELECT 'S1-' || l_orderkey AS s1_id FROM lineitem)
SELECT count(*) AS n_s1, CAST(sum(n_cand) AS BIGINT) AS total_pairs, round(avg(n_cand), 6) AS mean_cands, median(n_cand) AS median_cands, max(n_cand) AS max_cands, count(*) FILTER (n_cand = 0) AS s1_zero_cands, round(sum(tp) / sum(n_true), 6) AS pair_recall, round(avg(oracle), 6) AS oracle_ceiling,
 (SELECT min(n_cand) FROM h WHERE upto > round((a - 1) * 0.95)) AS p95_cands, any_value(pool_size) AS pool_size, (SELECT count(*) FROM raw) - CAST(sum(n_cand) AS BIGINT) AS dup_pairs, 0::BIGINT AS ignored_pairs, round(1 - sum(n_cand) / (count(*) * any_value(pool_size)), 6) AS reduction_ratio FROM f, n"""
)
def blocking_total(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S1-"), F.col("l_orderkey").cast("string")).alias("s1_id"), F.concat(F.lit("S"), (F.col("l_partkey") % 2 + 2).cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("cand_id"))
    pool = table(spark, sf_dir, "part").agg(F.count("*").alias("pool_size"))
    out = metrics.blocking_total(d, order_truth(spark, sf_dir), pool)
    return out.withColumns({c: r6(c) for c in ("mean_cands", "pair_recall", "oracle_ceiling", "reduction_ratio")})


@query(
    f"""WITH {CANDS}, c AS (SELECT substring(cand_id, 1, 2) AS src, count(*) AS n_cand FROM scored GROUP BY 1), w AS (SELECT substring(w.cand_id, 1, 2) AS src, count(*) AS n_true, count(s.cand_id) AS tp FROM want w LEFT JOIN scored s ON s.s1_id = w.s1_id AND s.cand_id = w.cand_id GROUP BY 1)
SELECT src, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp, coalesce(n_cand, 0) AS n_cand, round(tp / nullif(n_true, 0), 6) AS pair_recall, round(n_cand / (SELECT count(*) FROM truth), 6) AS cands_per_s1 FROM w FULL JOIN c USING (src)"""
)
def blocking_by_source(spark, sf_dir):
    d = metrics.blocking_by_source(scored(spark, sf_dir), order_truth(spark, sf_dir))
    return d.withColumns({c: r6(c) for c in ("pair_recall", "cands_per_s1")})


@query(f"WITH {CANDS} SELECT o_orderstatus AS country, count(*) AS n_s1, round(avg(n_cand), 6) AS mean_cands, round(sum(tp) / nullif(sum(n_true), 0), 6) AS pair_recall, round(avg(oracle), 6) AS oracle FROM f JOIN orders ON s1_id = 'S1-' || o_orderkey GROUP BY 1")
def blocking_by_country(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("s1_id"), F.col("o_orderstatus").alias("country"))
    d = metrics.blocking_by(metrics.per_record(scored(spark, sf_dir), order_truth(spark, sf_dir)).join(c, "s1_id"), "country")
    return d.withColumns({x: r6(x) for x in ("mean_cands", "pair_recall", "oracle")})


@query(f"WITH {CANDS} SELECT least(n_true, 7) AS n_true_grp, count(*) AS n_s1, round(avg(n_cand), 6) AS mean_cands, round(sum(tp) / nullif(sum(n_true), 0), 6) AS pair_recall, round(avg(oracle), 6) AS oracle FROM f GROUP BY 1")
def blocking_by_ntrue(spark, sf_dir):
    d = metrics.by_match_count(scored(spark, sf_dir), order_truth(spark, sf_dir))
    return d.withColumns({x: r6(x) for x in ("mean_cands", "pair_recall", "oracle")})


_CUTS = (("all", None), ("topk", 5), ("topk", 3), ("topk", 1), ("gap", 0.2), ("min_score", 0.5), ("topk_gap", (2, 0.4)))
_CUT_SQL = {"all": "true", "topk=5": "block_rank <= 5", "topk=3": "block_rank <= 3", "topk=1": "block_rank <= 1", "gap=0.2": "prob >= best - 0.2", "min_score=0.5": "prob >= 0.5", "topk_gap=(2, 0.4)": "block_rank <= 2 AND prob >= best - 0.4"}
TRADE = f"""{ALL}, k AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT '{n}' AS cutoff, r.s1_id, r.cand_id FROM ranked r WHERE {w}" for n, w in _CUT_SQL.items())})),
g AS (SELECT cutoff, k.s1_id, count(*) AS n_cand, count(w.cand_id) AS tp FROM k LEFT JOIN want w ON w.s1_id = k.s1_id AND w.cand_id = k.cand_id GROUP BY ALL), a AS (SELECT unnest([{", ".join(f"'{n}'" for n in _CUT_SQL)}]) AS cutoff),
p AS (SELECT a.cutoff, t.s1_id, n_true, coalesce(n_cand, 0) AS n_cand, coalesce(tp, 0) AS tp FROM truth t CROSS JOIN a LEFT JOIN g ON g.cutoff = a.cutoff AND g.s1_id = t.s1_id),
trade AS (SELECT cutoff, round(avg(n_cand), 6) AS avg_cands, round(avg(CASE WHEN n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_true) / (0.25 + tp / n_true) END), 6) AS oracle, round(sum(tp) / sum(n_true), 6) AS pair_recall, CAST(sum(n_cand) AS BIGINT) AS total_pairs FROM p GROUP BY 1)"""


def trade(spark, sf_dir):
    d = metrics.tradeoff(rank_and_score(scored(spark, sf_dir)), order_truth(spark, sf_dir), _CUTS)
    return d.withColumns({x: r6(x) for x in ("avg_cands", "oracle", "pair_recall")})


@query(f"WITH {TRADE} SELECT * FROM trade")
def tradeoff(spark, sf_dir):
    return trade(spark, sf_dir)


@query(f"WITH {TRADE}, m AS (SELECT *, max(oracle) OVER (ORDER BY avg_cands, oracle DESC, cutoff ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM trade) SELECT * EXCLUDE (before) FROM m WHERE before IS NULL OR oracle > before")
def pareto_front(spark, sf_dir):
    return decide.pareto_front(trade(spark, sf_dir).select("cutoff", "avg_cands", "oracle", "pair_recall", "total_pairs"), "avg_cands", "oracle")


_TS, _T1S = (0.5, 0.6, 0.7, 0.8, 0.9), (0.3, 0.5, 0.7)
GRID = f"""{ALL}, g AS (SELECT t, u AS t1 FROM (SELECT unnest([{", ".join(map(str, _TS))}]::DOUBLE[]) AS t), (SELECT unnest([{", ".join(map(str, _T1S))}]::DOUBLE[]) AS u) WHERE u <= t),
d AS (SELECT t, t1, r.s1_id, count(*) AS n, count(w.cand_id) AS tp FROM g JOIN ranked r ON r.prob >= t OR (r.prob = best AND r.prob >= t1) LEFT JOIN want w ON w.s1_id = r.s1_id AND w.cand_id = r.cand_id GROUP BY ALL),
x AS (SELECT g.t, g.t1, n_true, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM g CROSS JOIN truth t LEFT JOIN d ON d.t = g.t AND d.t1 = g.t1 AND d.s1_id = t.s1_id)"""


@query(f"WITH {GRID} SELECT t, t1, round(avg(CASE WHEN n_true = 0 THEN CAST(n = 0 AS DOUBLE) WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n) * (tp / n_true) / (0.25 * (tp / n) + tp / n_true) END), 6) AS macro_f05 FROM x GROUP BY ALL")
def threshold_grid(spark, sf_dir):
    d = metrics.threshold_grid(scored(spark, sf_dir), order_truth(spark, sf_dir), list(_TS), list(_T1S))
    return d.withColumn("macro_f05", r6("macro_f05"))


OWNED = "(SELECT DISTINCT 'S' || (l_partkey % 2 + 2) || '-' || l_partkey AS cand_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40)"


@query(
    f"""WITH {ALL}, g AS (SELECT t, u AS t1 FROM (SELECT unnest([0.6, 0.8]::DOUBLE[]) AS t), (SELECT unnest([0.4, 0.6]::DOUBLE[]) AS u) WHERE u <= t),
d AS (SELECT t, t1, r.s1_id, count(w.cand_id) AS tp, sum(CASE WHEN w.cand_id IS NOT NULL THEN 0.0 WHEN o.cand_id IS NULL THEN 1.6 ELSE 1.0 END) AS fp FROM g JOIN ranked r ON r.prob >= t OR (r.prob = best AND r.prob >= t1)
 LEFT JOIN want w ON w.s1_id = r.s1_id AND w.cand_id = r.cand_id LEFT JOIN {OWNED} o ON o.cand_id = r.cand_id GROUP BY ALL),
x AS (SELECT g.t, g.t1, n_true, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp FROM g CROSS JOIN truth t LEFT JOIN d ON d.t = g.t AND d.t1 = g.t1 AND d.s1_id = t.s1_id)
SELECT t, t1, round(avg(CASE WHEN n_true = 0 THEN CAST(tp + fp = 0 AS DOUBLE) WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / (tp + fp)) * (tp / n_true) / (0.25 * (tp / (tp + fp)) + tp / n_true) END), 6) AS macro_f05 FROM x GROUP BY ALL"""
)
def tune_weighted(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 40")
    owned = d.select(F.concat(F.lit("S"), (F.col("l_partkey") % 2 + 2).cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("cand_id")).distinct()
    out = models.tune_weighted(scored(spark, sf_dir), order_truth(spark, sf_dir), owned, 1.6, [0.6, 0.8], [0.4, 0.6])
    return out.withColumn("macro_f05", r6("macro_f05"))


@query(
    f"""WITH {ALL}, l AS (SELECT country, prob, (w.cand_id IS NOT NULL)::BIGINT AS y FROM scored s LEFT JOIN want w ON w.s1_id = s.s1_id AND w.cand_id = s.cand_id),
r AS (SELECT *, rank() OVER (PARTITION BY country ORDER BY prob) + (count(*) OVER (PARTITION BY country, prob) - 1) / 2.0 AS r FROM l)
SELECT country, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM r GROUP BY 1"""
)
def auc_rank(spark, sf_dir):
    want = metrics.pairs_of(order_truth(spark, sf_dir)).withColumn("y", F.lit(1))
    d = scored(spark, sf_dir).join(want, ["s1_id", "cand_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return metrics.auc(d, "prob", "y", ["country"]).withColumn("auc", r6("auc"))


@query(
    f"""WITH RECURSIVE {SCORED}, h AS (SELECT prob AS p, count(*) AS n FROM scored GROUP BY 1),
em AS (SELECT 0 AS i, 0.25::DOUBLE AS s UNION ALL SELECT i + 1, sum(n * p * s / 0.25 / (p * s / 0.25 + (1 - p) * (1 - s) / 0.75)) / sum(n) FROM em, h WHERE i < 200 GROUP BY i, s) SELECT round(s, 6) AS share FROM em WHERE i = 200"""
)
def prior_shift_em(spark, sf_dir):
    share = metrics.prior_shift(scored(spark, sf_dir), "prob", 0.25)
    return spark.createDataFrame([(round(share, 6),)], "share double")


# ------------------------------------------------------------------ errors


@query(
    f"""WITH {ALL}, pred AS (SELECT {PICK} FROM ranked WHERE prob >= 0.7), c AS (SELECT {PICK} FROM ranked WHERE block_rank <= 2), r AS (SELECT {PICK} FROM ranked WHERE block_rank <= 4)
SELECT CASE WHEN p.cand_id IS NOT NULL THEN 'found' WHEN c.cand_id IS NOT NULL THEN 'model rejected' WHEN r.cand_id IS NOT NULL THEN 'pruner cut' ELSE 'retrieval missed' END AS kind, count(*) AS n
FROM want w LEFT JOIN pred p ON p.s1_id = w.s1_id AND p.cand_id = w.cand_id LEFT JOIN c ON c.s1_id = w.s1_id AND c.cand_id = w.cand_id LEFT JOIN r ON r.s1_id = w.s1_id AND r.cand_id = w.cand_id GROUP BY 1
UNION ALL SELECT 'false positive', count(*) FROM pred p WHERE NOT EXISTS (SELECT 1 FROM want w WHERE w.s1_id = p.s1_id AND w.cand_id = p.cand_id)"""
)
def error_decomposition(spark, sf_dir):
    d = decide.ranked(scored(spark, sf_dir))
    return reports.error_parts(d.where("prob >= 0.7"), d.where("block_rank <= 2"), d.where("block_rank <= 4"), order_truth(spark, sf_dir))


KIND = """CASE WHEN n_true = 0 AND n_cand = 0 THEN 'empty, rightly' WHEN n_true = 0 THEN 'false match of an unmatched record' WHEN n_cand = 0 THEN 'nothing predicted' WHEN tp = 0 THEN 'all wrong'
 WHEN tp = n_true AND n_cand = tp THEN 'perfect' WHEN tp = n_cand THEN 'only misses' WHEN tp = n_true THEN 'only false positives' ELSE 'both' END"""


@query(f"WITH {PRED} SELECT {KIND} AS kind, count(*) AS n_s1, round(sum(1 - f05), 4) AS loss, round(sum(1 - f05) / (SELECT sum(1 - f05) FROM f), 6) AS loss_share FROM f GROUP BY 1")
def outcome_kinds(spark, sf_dir):
    d = reports.outcomes(predicted(spark, sf_dir), order_truth(spark, sf_dir))
    return d.select("kind", "n_s1", F.round("loss", 4).alias("loss"), r6("loss_share").alias("loss_share"))


@query(f"WITH {PRED} SELECT least(n_true, 7) AS n_true_grp, count(*) AS n_s1, round(avg(f05), 6) AS f05, round(sum(1 - f05), 4) AS loss FROM f GROUP BY 1")
def loss_by_count(spark, sf_dir):
    d = reports.loss_by_count(predicted(spark, sf_dir), order_truth(spark, sf_dir))
    return d.select("n_true_grp", "n_s1", r6("f05").alias("f05"), F.round("loss", 4).alias("loss"))


REASONS = f"""{SCORED}, x AS (SELECT *, CAST(cand_id LIKE '%7' AS INTEGER) AS p_nonlatin, CAST(cand_id LIKE '%3' AS INTEGER) AS p_addr_missing, CAST(s1_id LIKE '%9' AS INTEGER) AS q_addr_missing, CASE house_sign WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE -1.0 END AS house_tol FROM scored)"""


def reason_frame(spark, sf_dir):
    return scored(spark, sf_dir).withColumns(
        {
            "p_nonlatin": F.col("cand_id").endswith("7").cast("int"),
            "p_addr_missing": F.col("cand_id").endswith("3").cast("int"),
            "q_addr_missing": F.col("s1_id").endswith("9").cast("int"),
            "house_tol": F.when(F.col("house_sign") == 1, 1.0).when(F.col("house_sign") == 0, 0.5).otherwise(-1.0),
        }
    )


@query(
    f"""WITH {REASONS} SELECT CASE WHEN p_nonlatin = 1 THEN 'cross-script name' WHEN p_addr_missing = 1 OR q_addr_missing = 1 THEN 'address missing' WHEN house_tol = -1 THEN 'house number differs (2+ edits)' WHEN house_tol = 0.5 THEN 'house number 1 edit'
 WHEN name_ts < 0.6 THEN 'name very different (<0.6)' WHEN addr_ts < 0.5 THEN 'address very different (<0.5)' WHEN name_ts < 0.85 THEN 'name partly different' ELSE 'name+address similar' END AS reason, count(*) AS pairs, round(avg(prob), 6) AS mean_prob, count(DISTINCT s1_id) AS s1 FROM x GROUP BY 1"""
)
def missed_reasons(spark, sf_dir):
    d = reason_frame(spark, sf_dir).groupBy(reports.missed_reason().alias("reason"))
    return d.agg(F.count("*").alias("pairs"), r6(F.avg("prob")).alias("mean_prob"), F.countDistinct("s1_id").alias("s1"))


@query(
    f"""WITH {REASONS} SELECT CASE WHEN p_nonlatin = 1 THEN 'cross-script name' WHEN name_ts >= 0.95 AND addr_ts >= 0.95 AND house_tol >= 0 THEN 'near-identical record (label noise?)' WHEN addr_ts >= 0.85 AND name_ts < 0.85 THEN 'same address, different name'
 WHEN name_ts >= 0.9 AND house_tol = -1 THEN 'same name, other house number' WHEN name_ts >= 0.9 AND house_tol = 0.5 THEN 'same name, house 1 edit' WHEN name_ts >= 0.9 AND addr_ts < 0.7 THEN 'same name, different address'
 WHEN p_addr_missing = 1 OR q_addr_missing = 1 THEN 'address missing' ELSE 'other' END AS reason, count(*) AS pairs, round(avg(prob), 6) AS mean_prob, count(DISTINCT s1_id) AS s1 FROM x GROUP BY 1"""
)
def false_reasons(spark, sf_dir):
    d = reason_frame(spark, sf_dir).groupBy(reports.false_reason().alias("reason"))
    return d.agg(F.count("*").alias("pairs"), r6(F.avg("prob")).alias("mean_prob"), F.countDistinct("s1_id").alias("s1"))


@query(f"WITH {ALL}, r AS (SELECT q.s1_id AS q_id, q.cand_id, addr_ts, prob, (w.cand_id IS NOT NULL)::BIGINT AS y FROM scored q LEFT JOIN want w ON w.s1_id = q.s1_id AND w.cand_id = q.cand_id), k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY addr_ts DESC, prob DESC, cand_id) AS r FROM r) SELECT q_id, CAST(sum(y) AS BIGINT) AS n_true, CAST(coalesce(sum(y) FILTER (r <= 3), 0) AS BIGINT) AS hits FROM k GROUP BY 1")
def rerank_pool(spark, sf_dir):
    want = metrics.pairs_of(order_truth(spark, sf_dir)).withColumn("is_true", F.lit(1))
    d = scored(spark, sf_dir).join(want, ["s1_id", "cand_id"], "left").select(F.col("s1_id").alias("q_id"), F.col("cand_id").alias("p_id"), F.col("prob").alias("retrieval"), F.col("addr_ts").alias("score"), F.coalesce("is_true", F.lit(0)).alias("is_true"))
    return reports.rerank(d, "score", 3)
