"""Queries of learned stages. Labels: whether a part was returned; features of the order line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, decide, features, metrics, models
from ..operators.tfidf import Block
from ..plans import linkage
from ..plans.normalize import normalize
from ..storage import staged
from ..streaming.incremental import arrivals
from .base import RECORDS, order_truth, query, r6, records, scored, table, truth
from .decisions import ALL
from .retrieval import TRUTH, block_sql, blocks_sql
from .texts import BLOCK_VIEWS

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "month"]


def lines(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.select(
        F.concat(F.lit("S1-"), F.col("l_orderkey").cast("string")).alias("s1_id"),
        F.concat(F.lit("S2-"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")).alias("cand_id"),
        "l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"), "l_tax", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("month"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


@query()
def gbt_oof(spark, sf_dir):
    """Out-of-fold probabilities of boosted trees over three folds of orders."""
    d = models.out_of_fold(lines(spark, sf_dir), FEATURES, "s1_id", 3, rounds=5, depth=4)
    return d.select("s1_id", "cand_id", "y", r6("prob").alias("prob"))


@query()
def gbt_pruner_final(spark, sf_dir):
    """Two half models prune, a final one scores, a record goes to its best order."""
    d = lines(spark, sf_dir)
    pruners, scored_once = models.two_fold_pruner(d, FEATURES, rounds=5, depth=4)
    kept = decide.ranked(scored_once, "prune_prob").where("block_rank <= 3")
    cols = [*FEATURES, "prune_prob", "block_rank"]
    final = models.fit_trees(kept, cols, rounds=5, depth=4)
    out = models.predict(final, kept, cols)
    return decide.decide(out, 0.6, 0.4, True).select("s1_id", "cand_id", "y", r6("prob").alias("prob"))


@query()
def gbt_importance(spark, sf_dir):
    m = models.fit_trees(lines(spark, sf_dir), FEATURES, rounds=5, depth=4)
    return spark.createDataFrame([(f, round(g, 6)) for f, g in models.importance(m, FEATURES)], "feature string, gain double")


@query()
def gbt_transfer(spark, sf_dir):
    """Trained on one half of the label space's countries, measured on the other."""
    d = table(spark, sf_dir, "customer").select("c_custkey", F.pmod("c_nationkey", F.lit(2)).alias("country"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("s1_id"), F.col("o_custkey").alias("c_custkey"))
    x = lines(spark, sf_dir).join(o.join(d, "c_custkey"), "s1_id")
    m = models.fit_trees(x.where("country = 0"), FEATURES, rounds=5, depth=4)
    return metrics.auc(models.predict(m, x, FEATURES), "prob", "y", ["country"]).withColumn("auc", F.round("auc", 4))


# ------------------------------------------------------------------ the whole matcher

# Parts are records: name and kind, size and street, the brand is the country; a third of them is
# source 1. Records of one name and kind in a brand are true matches.


def part_records(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("S"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.when(F.col("p_size") % 4 == 0, "ltd")).alias("name"),
        F.concat_ws(" ", F.col("p_size").cast("string"), "p_name", F.lit("street")).alias("address"),
        F.col("p_brand").alias("country"),
    )


def part_truth(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.concat(F.lit("S"), (F.col("p_partkey") % 3 + 1).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("id"), "p_name", "p_type", "p_brand")
    s1 = d.where(F.col("id").startswith("S1-")).withColumnRenamed("id", "s1_id")
    rest = d.where(~F.col("id").startswith("S1-")).withColumnRenamed("id", "cand_id")
    # Listed by key before they are joined: equal keys share a list, and no pairs are made.
    key = ["p_name", "p_type", "p_brand"]
    lists = rest.groupBy(*key).agg(F.array_sort(F.collect_set("cand_id")).alias("matched_ids"))
    return s1.join(lists, key, "left").select("s1_id", F.coalesce("matched_ids", F.array().cast("array<string>")).alias("matched_ids"))


@query()
def link_v3(spark, sf_dir):
    """Records to decided matches by the last generation's features, weights and country thresholds."""
    d = linkage.link_v3(part_records(spark, sf_dir), part_truth(spark, sf_dir), thresholds={"Brand#1": 0.95}, rounds=3, depth=3)
    return d.select("country", "s1_id", "cand_id", r6("prob").alias("prob"))


@query()
def orphan_oof(spark, sf_dir):
    """Records that no list has, scored out of fold."""
    d, t = part_records(spark, sf_dir), part_truth(spark, sf_dir)
    reverse = staged(blocks.reverse_search(blocks.prepare(d)), "reverse")
    return linkage.orphan_scores(d, reverse, t, rounds=3, depth=3).select("rec_id", "y", r6("orphan_prob").alias("orphan_prob"))


@query()
def zero_oof(spark, sf_dir):
    """Source-1 records without a match, scored out of fold with the orphan scores."""
    d, t = part_records(spark, sf_dir), part_truth(spark, sf_dir)
    reverse = staged(blocks.reverse_search(blocks.prepare(d)), "reverse")
    orphans = linkage.orphan_scores(d, reverse, t, rounds=3, depth=3)
    return linkage.zero_scores(d, reverse, orphans, t, rounds=3, depth=3).select("s1_id", "y", r6("p_zero").alias("p_zero"))


@query()
def pair_features_parts(spark, sf_dir):
    """All pair features of the pairs that both matching views retrieve."""
    return linkage.pair_table(part_records(spark, sf_dir), linkage.PRESETS["v1"])


@query()
def compact_pairs(spark, sf_dir):
    """The compact features of the alternative pruner."""
    views = staged(blocks.prepare(part_records(spark, sf_dir)), "views")
    return features.compact_features(blocks.retrieve(views, ("word", "skel")), views)


@query()
def match_fields_latin(spark, sf_dir):
    """The first generation's matching fields, names in Latin letters."""
    return features.prepare_match_latin(normalize(records(spark, sf_dir)))


@query(
    f"""WITH {ALL}, top AS (SELECT * FROM ranked WHERE block_rank <= 3), p AS (SELECT t.s1_id, any_value(n_true) AS n_true, count(x.cand_id) AS n, count(w.cand_id) AS tp FROM truth t LEFT JOIN top x ON x.s1_id = t.s1_id LEFT JOIN want w ON w.s1_id = x.s1_id AND w.cand_id = x.cand_id GROUP BY t.s1_id),
s AS (SELECT count(*) AS n_s1, CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(tp) AS BIGINT) AS hits, round(sum(tp) / sum(n_true), 6) AS pair_recall, round(avg(CASE WHEN n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_true) / (0.25 + tp / n_true) END), 6) AS oracle FROM p),
g AS (SELECT t, u AS t1 FROM (SELECT unnest([0.5, 0.7, 0.8]::DOUBLE[]) AS t), (SELECT unnest([0.3, 0.5]::DOUBLE[]) AS u) WHERE u <= t),
d AS (SELECT t, t1, r.s1_id, count(*) AS n, count(w.cand_id) AS tp FROM g JOIN top r ON r.prob >= t OR (r.prob = best AND r.prob >= t1) LEFT JOIN want w ON w.s1_id = r.s1_id AND w.cand_id = r.cand_id GROUP BY ALL),
x AS (SELECT g.t, g.t1, n_true, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM g CROSS JOIN truth t LEFT JOIN d ON d.t = g.t AND d.t1 = g.t1 AND d.s1_id = t.s1_id),
m AS (SELECT t, t1, avg(CASE WHEN n_true = 0 THEN CAST(n = 0 AS DOUBLE) WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n) * (tp / n_true) / (0.25 * (tp / n) + tp / n_true) END) AS f FROM x GROUP BY ALL),
b AS (SELECT * FROM m ORDER BY round(f, 9) DESC, t, t1 LIMIT 1)
SELECT s.*, round(f.f, 6) AS f05_fixed, round(b.f, 6) AS f05_tuned, b.t, b.t1 FROM s, b, m f WHERE f.t = 0.7 AND f.t1 = 0.5"""
)
def scorer_report(spark, sf_dir):
    """Scored pairs of a model: the three best of each record, at fixed and at tuned thresholds."""
    out = linkage.score_report(scored(spark, sf_dir), order_truth(spark, sf_dir), 3, 0.7, 0.5, [0.5, 0.7, 0.8], [0.3, 0.5])
    return out.withColumns({c: r6(c) for c in ("pair_recall", "oracle", "f05_fixed", "f05_tuned")})


_LINES = """l AS (SELECT 'S1-' || l_orderkey AS s1_id, 'S2-' || l_partkey || '.' || l_linenumber AS cand_id, CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity FROM lineitem)"""


@query(f"""WITH {_LINES}, o AS (SELECT DISTINCT cand_id FROM l WHERE y = 1 AND l_quantity > 25), w AS (SELECT y, CASE WHEN y = 0 AND o.cand_id IS NULL THEN 1.6 ELSE 1.0 END::DOUBLE AS w FROM l LEFT JOIN o USING (cand_id))
SELECT y, w, count(*) AS n FROM w GROUP BY ALL""")
def orphan_weights(spark, sf_dir):
    d = lines(spark, sf_dir)
    owned = d.where("y = 1 and l_quantity > 25").select("cand_id")
    return models.orphan_weights(d, owned, 1.6).groupBy("y", "w").agg(F.count("*").alias("n"))


@query(
    f"""WITH {ALL}, g AS (SELECT t, u AS t1 FROM (SELECT unnest([0.5, 0.7, 0.9]::DOUBLE[]) AS t), (SELECT unnest([0.3, 0.5]::DOUBLE[]) AS u) WHERE u <= t),
d AS (SELECT t, t1, r.s1_id, count(*) AS n, count(w.cand_id) AS tp FROM g JOIN ranked r ON r.prob >= t OR (r.prob = best AND r.prob >= t1) LEFT JOIN want w ON w.s1_id = r.s1_id AND w.cand_id = r.cand_id GROUP BY ALL),
x AS (SELECT g.t, g.t1, n_true, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM g CROSS JOIN truth t LEFT JOIN d ON d.t = g.t AND d.t1 = g.t1 AND d.s1_id = t.s1_id),
m AS (SELECT t, t1, round(avg(CASE WHEN n_true = 0 THEN CAST(n = 0 AS DOUBLE) WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n) * (tp / n_true) / (0.25 * (tp / n) + tp / n_true) END), 6) AS macro_f05 FROM x GROUP BY ALL)
SELECT macro_f05, t, t1 FROM m ORDER BY macro_f05 DESC, t, t1 LIMIT 1"""
)
def tuned_thresholds(spark, sf_dir):
    best = models.tune(scored(spark, sf_dir), order_truth(spark, sf_dir), [0.5, 0.7, 0.9], [0.3, 0.5])
    return spark.createDataFrame([tuple(float(round(x, 6)) for x in best)], "macro_f05 double, t double, t1 double")


@query(
    f"""WITH {blocks_sql(("word", "namenum"))}, {TRUTH}, c AS (SELECT s1_id, cand_id, concat_ws('|', CASE WHEN s_word IS NOT NULL THEN 'word' END, CASE WHEN s_namenum IS NOT NULL THEN 'namenum' END) AS sources, greatest(s_word, s_namenum) AS block_score FROM pairs)
SELECT c.*, CAST(row_number() OVER (PARTITION BY c.s1_id ORDER BY block_score DESC, c.cand_id) AS INTEGER) AS block_rank, CAST(w.cand_id IS NOT NULL AS INTEGER) AS y FROM c LEFT JOIN want w ON w.s1_id = c.s1_id AND w.cand_id = c.cand_id"""
)
def word_candidates(spark, sf_dir):
    """The candidate pipeline on two blocks, labelled by the truth."""
    found = linkage.candidates(blocks.prepare(records(spark, sf_dir)), ("word", "namenum"))
    return linkage.labelled(found, truth(spark, sf_dir)).select("s1_id", "cand_id", "sources", "block_score", "block_rank", "y")


@query(f"WITH {RECORDS}, {BLOCK_VIEWS}, s1 AS (SELECT * FROM prepared WHERE starts_with(entity_id, 'S1-')), pool AS (SELECT * FROM prepared WHERE NOT starts_with(entity_id, 'S1-')), {block_sql(Block('word', 'text', 5, 0.01), 'pool', 's1', 'b')} SELECT * FROM b")
def arriving_records(spark, sf_dir):
    """Records of sources 2 and 3 as one arriving batch against source 1."""
    d = records(spark, sf_dir)
    return arrivals(d.where(~F.col("entity_id").startswith("S1-")), d.where(F.col("entity_id").startswith("S1-")), 5)
