"""Queries of evaluation reports, checks of joins, and sinks of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, models, reports
from ..plans.normalize import kept_token_map, learn_token_map
from ..sources import outputs
from ..storage import new_path
from .base import RECORDS, order_truth, query, r6, records, scored, sql_values, table, values
from .decisions import ALL
from .similarity import ratio_tables
from .texts import VOTES

ORDER_COUNTRY = "c AS (SELECT 'S1-' || o_orderkey AS s1_id, o_orderstatus AS country FROM orders)"


def order_country(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("s1_id"), F.col("o_orderstatus").alias("country"))


@query(
    f"""WITH {ALL}, {ORDER_COUNTRY}, g AS (SELECT t, u AS t1 FROM (SELECT unnest([0.5, 0.7, 0.9]::DOUBLE[]) AS t), (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS u) WHERE u <= t),
d AS (SELECT t, t1, r.s1_id, count(*) AS n, count(w.cand_id) AS tp FROM g JOIN ranked r ON r.prob >= t OR (r.prob = best AND r.prob >= t1) LEFT JOIN want w ON w.s1_id = r.s1_id AND w.cand_id = r.cand_id GROUP BY ALL),
x AS (SELECT c.country, g.t, g.t1, n_true, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM g CROSS JOIN truth h JOIN c USING (s1_id) LEFT JOIN d ON d.t = g.t AND d.t1 = g.t1 AND d.s1_id = h.s1_id),
m AS (SELECT country, t, t1, avg(CASE WHEN n_true = 0 THEN CAST(n = 0 AS DOUBLE) WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n) * (tp / n_true) / (0.25 * (tp / n) + tp / n_true) END) AS f FROM x GROUP BY ALL)
SELECT country, t, t1, round(f, 6) AS macro_f05 FROM m QUALIFY row_number() OVER (PARTITION BY country ORDER BY round(f, 9) DESC, t, t1) = 1"""
)
def country_thresholds(spark, sf_dir):
    """The best thresholds of each country."""
    d = models.tune_by(scored(spark, sf_dir), order_truth(spark, sf_dir), order_country(spark, sf_dir), "country", [0.5, 0.7, 0.9], [0.3, 0.5, 0.7])
    return d.withColumn("macro_f05", r6("macro_f05"))


_COUNTS = "count(*) AS queries, count(*) FILTER (n_true > 0) AS positive_queries, CAST(sum(n_true) AS BIGINT) AS true_pairs, CAST(sum(got) AS BIGINT) AS retrieved_true_pairs, count(*) FILTER (got > 0) AS retrieval_hit_queries"
_TOPS = ", ".join(f"CAST(sum({v}{n}) AS BIGINT) AS {v}_top{n}_pairs, count(*) FILTER ({v}{n} > 0) AS {v}_top{n}_hit_queries" for v in ("raw", "core") for n in (1, 2))


@query(
    f"""WITH {ALL}, k AS (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_id) AS raw_rank, row_number() OVER (PARTITION BY s1_id ORDER BY name_ts DESC, cand_id) AS core_rank FROM ranked WHERE block_rank <= 4),
p AS (SELECT t.s1_id, any_value(n_true) AS n_true, count(w.cand_id) AS got, count(w.cand_id) FILTER (raw_rank <= 1) AS raw1, count(w.cand_id) FILTER (raw_rank <= 2) AS raw2, count(w.cand_id) FILTER (core_rank <= 1) AS core1, count(w.cand_id) FILTER (core_rank <= 2) AS core2
 FROM truth t LEFT JOIN k ON k.s1_id = t.s1_id LEFT JOIN want w ON w.s1_id = k.s1_id AND w.cand_id = k.cand_id GROUP BY t.s1_id),
s AS (SELECT {_COUNTS}, {_TOPS}, count(*) FILTER (core2 > 0 AND raw2 = 0) AS core_wins_top2_queries, count(*) FILTER (raw2 > 0 AND core2 = 0) AS core_losses_top2_queries FROM p)
SELECT *, {", ".join(f"round({c} / positive_queries, 6) AS {c}_rate" for c in ("retrieval_hit_queries", *(f"{v}_top{n}_hit_queries" for v in ("raw", "core") for n in (1, 2))))},
 {", ".join(f"round({c} / true_pairs, 6) AS {c}_recall" for c in ("retrieved_true_pairs", *(f"{v}_top{n}_pairs" for v in ("raw", "core") for n in (1, 2))))} FROM s"""
)
def rank_hits(spark, sf_dir):
    """Two rankings of the four best candidates of each order, at one and two places."""
    kept = decide.ranked(scored(spark, sf_dir)).where("block_rank <= 4").drop("block_rank")
    d = decide.ranked(decide.ranked(kept, "prob", "raw_rank"), "name_ts", "core_rank")
    out = reports.rank_hits(d, order_truth(spark, sf_dir), levels=(1, 2))
    return out.select(*[r6(c).alias(c) if c.endswith(("_rate", "_recall")) else c for c in out.columns])


@query(
    f"""WITH {ALL}, sub AS (SELECT DISTINCT 'S' || (p_partkey % 2 + 2) || '-' || p_partkey AS cand_id FROM part WHERE p_brand = 'Brand#1' OR p_type = 'ECONOMY'), d AS (SELECT w.* FROM want w JOIN truth USING (s1_id) JOIN sub USING (cand_id))
SELECT count(*) AS true_pairs, count(DISTINCT d.s1_id) AS positive_s1, count(a.cand_id) AS stage1_pairs, count(b.cand_id) AS top_pairs, round(count(a.cand_id) / count(*), 6) AS stage1_recall, round(count(b.cand_id) / count(*), 6) AS top_recall
FROM d LEFT JOIN (SELECT s1_id, cand_id FROM ranked WHERE block_rank <= 4) a ON a.s1_id = d.s1_id AND a.cand_id = d.cand_id LEFT JOIN (SELECT s1_id, cand_id FROM ranked WHERE block_rank <= 2) b ON b.s1_id = d.s1_id AND b.cand_id = d.cand_id"""
)
def transfer_diagnostic(spark, sf_dir):
    """Recall of the true pairs of some records after each step."""
    d = decide.ranked(scored(spark, sf_dir))
    sub = table(spark, sf_dir, "part").where("p_brand = 'Brand#1' or p_type = 'ECONOMY'").select(F.concat(F.lit("S"), (F.col("p_partkey") % 2 + 2).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("cand_id"))
    out = reports.subset_recall(order_truth(spark, sf_dir), sub, {"stage1": d.where("block_rank <= 4"), "top": d.where("block_rank <= 2")})
    return out.withColumns({c: r6(c) for c in ("stage1_recall", "top_recall")})


DEV_PAIRS = [
    ("S1-1", "shri ram traders", "shri ram traders", "श्री राम ट्रेडर्स", "shri ram traders"), ("S1-2", "ram motors", "ram motors", "राम मोटर्स", "raam motars"),
    ("S1-2", "ram motors", "ram motors", "राम abc", "raam abc"), ("S1-3", "one", "one", "one", "one"), ("S1-4", "two words", "two words", "एक", "एक"),
]
DEV_MAP = [("राम", "ram"), ("श्री", "shri")]


@query(
    f"""WITH {sql_values(DEV_PAIRS, "p", "s1_id, s1_core, s1_latin, cand_core, cand_latin")}, {sql_values(DEV_MAP, "m", "tok, new")}, tk AS (SELECT unnest(string_split(cand_core, ' ')) AS tok FROM p),
kn AS (SELECT count(*) AS devanagari_tokens, count(m.tok) AS mapped_tokens FROM tk LEFT JOIN m USING (tok) WHERE regexp_matches(tk.tok, '[\\x{{900}}-\\x{{97f}}]')),
each_ AS (SELECT DISTINCT s1_core AS a, cand_core AS b FROM p UNION SELECT DISTINCT s1_latin, cand_latin FROM p), {ratio_tables("each_")},
j AS (SELECT a, b, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS jac FROM each_)
SELECT count(*) AS pairs, count(DISTINCT s1_id) AS positive_s1, round(avg(CAST(s1_core = cand_core AS INTEGER)), 6) AS core_exact_rate, round(avg(CAST(s1_latin = cand_latin AS INTEGER)), 6) AS latin_exact_rate, round(avg(jc.jac), 6) AS core_jaccard_mean, round(avg(jl.jac), 6) AS latin_jaccard_mean,
 round(avg(100 * sc.weighted_ratio), 6) AS core_wratio_mean, round(avg(100 * sl.weighted_ratio), 6) AS latin_wratio_mean, count(*) FILTER (regexp_matches(cand_latin, '[\\x{{900}}-\\x{{97f}}]')) AS nonlatin_output_pairs,
 any_value(devanagari_tokens) AS devanagari_tokens, any_value(mapped_tokens) AS mapped_tokens, round(any_value(mapped_tokens / devanagari_tokens), 6) AS mapped_token_rate
FROM p CROSS JOIN kn JOIN s sc ON sc.a = s1_core AND sc.b = cand_core JOIN s sl ON sl.a = s1_latin AND sl.b = cand_latin JOIN j jc ON jc.a = s1_core AND jc.b = cand_core JOIN j jl ON jl.a = s1_latin AND jl.b = cand_latin"""
)
def translit_report(spark, sf_dir):
    d = values(spark, DEV_PAIRS, "s1_id string, s1_core string, s1_latin string, cand_core string, cand_latin string")
    out = reports.transliteration_report(d, values(spark, DEV_MAP, "tok string, new string"))
    return out.select(*[r6(c).alias(c) if c.endswith(("_rate", "_mean")) else c for c in out.columns])


@query("SELECT (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) AS rows_after, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) > 1)) AS keys_repeated")
def expansion_check(spark, sf_dir):
    """What a join of orders with their lines adds; a checked join with customers adds nothing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    checked = outputs.checked_join(o, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"])
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return outputs.expanded(checked, checked.join(lines, "o_orderkey", "left"), ["o_orderkey"])


@query("SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def metrics_json(spark, sf_dir):
    """Metrics written as JSON lines and read again."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))
    path = new_path(spark, "json")
    outputs.write_json(d, path)
    return spark.read.schema(d.schema).json(path)


@query(
    """WITH d AS (SELECT l_returnflag AS flag, count(*) AS n, avg(l_tax) AS mean FROM lineitem GROUP BY 1)
SELECT 1 AS line, '| flag | n | mean |' AS text UNION ALL SELECT 2, '|---|---|---|' UNION ALL SELECT CAST(2 + row_number() OVER (ORDER BY flag) AS INTEGER), '| ' || flag || ' | ' || n || ' | ' || printf('%.4f', mean) || ' |' FROM d"""
)
def metrics_markdown(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.avg("l_tax").alias("mean"))
    return outputs.markdown(d, ["flag"])


@query(f"WITH {RECORDS} SELECT entity_id, name, address FROM records WHERE starts_with(entity_id, 'S1-') AND country = 'en' OR starts_with(entity_id, 'S2-') AND country = 'de'")
def text_lookup(spark, sf_dir):
    """Raw texts of a set of ids over the sources."""
    d = records(spark, sf_dir)
    s = [d.where(F.col("entity_id").startswith(f"S{i}-")) for i in (1, 2, 3)]
    ids = s[0].where("country = 'en'").select("entity_id").unionByName(s[1].where("country = 'de'").select("entity_id"))
    return reports.texts_of(ids, *s)


@query(
    f"""WITH {sql_values(VOTES, "t", "id, latin_name, dev_name")}, p AS (SELECT string_split(dev_name, ' ') AS a, string_split(latin_name, ' ') AS b FROM t),
v AS (SELECT a[i] AS tok, b[i] AS new FROM p, unnest(range(1, len(a) + 1)) AS r(i) WHERE len(a) = len(b)), c AS (SELECT tok, new, count(*) AS votes FROM v GROUP BY 1, 2),
k AS (SELECT *, sum(votes) OVER (PARTITION BY tok) AS n, row_number() OVER (PARTITION BY tok ORDER BY votes DESC, new) AS r FROM c) SELECT tok, new, votes FROM k WHERE r = 1 AND votes >= 0.6 * n"""
)
def learned_map_kept(spark, sf_dir):
    """A learned token map is kept in a folder and read again, instead of being learned anew."""
    d = values(spark, VOTES, "id int, latin_name string, dev_name string")
    path = new_path(spark, "map")
    learn = lambda: learn_token_map(d, "dev_name", "latin_name")
    kept_token_map(spark, path, learn)
    return kept_token_map(spark, path, lambda: learn().limit(0)).select("tok", "new", "votes")
