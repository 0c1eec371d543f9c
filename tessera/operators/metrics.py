"""Quality of predictions and of candidate lists against the truth.

truth is (s1_id, matched_ids array<string>); an empty list means that the record has no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged


def pairs_of(truth: DataFrame) -> DataFrame:
    """(s1_id, cand_id) of a truth table; records without a match drop out."""
    return truth.select("s1_id", F.explode("matched_ids").alias("cand_id"))


def lists_of(pairs: DataFrame) -> DataFrame:
    """A truth table of (s1_id, cand_id) pairs, ids in order."""
    return pairs.where("cand_id is not null").groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("matched_ids"))


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one record; with nothing to find, 1 if nothing was predicted."""
    p, r = F.try_divide(tp, n_pred), F.try_divide(tp, n_true)
    return F.when(n_true == 0, (n_pred == 0).cast("double")).when(tp == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def oracle(tp: Column, n_true: Column) -> Column:
    """F0.5 of a perfect choice among the candidates."""
    r = F.try_divide(tp, n_true)
    return F.when(n_true == 0, 1.0).when(tp == 0, 0.0).otherwise(1.25 * r / (0.25 + r))


def per_record(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1_id, n_true, n_cand, tp) for every record of the truth; pairs count once, those of other
    records not at all."""
    p = pairs.select("s1_id", "cand_id").where("cand_id is not null").distinct().join(truth.select("s1_id"), "s1_id", "left_semi")
    right = pairs_of(truth).withColumn("_hit", F.lit(1))
    n = p.join(right, ["s1_id", "cand_id"], "left").groupBy("s1_id").agg(F.count("*").alias("n_cand"), F.count("_hit").alias("tp"))
    return truth.select("s1_id", F.size("matched_ids").cast("long").alias("n_true")).join(n, "s1_id", "left").na.fill(0, ["n_cand", "tp"])


def scores(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """per_record with the F0.5 of each record."""
    return per_record(pred, truth).withColumn("f05", f05(F.col("tp"), F.col("n_cand"), F.col("n_true")))


def macro_f05(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: mean F0.5 over all records of the truth."""
    return scores(pred, truth).agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("n_s1"))


def macro_f05_by(pred: DataFrame, truth: DataFrame, country: DataFrame) -> DataFrame:
    """Mean F0.5 by country; country is (s1_id, country)."""
    return scores(pred, truth).join(country, "s1_id", "left").groupBy("country").agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("n_s1"))


def value_quantile(d: DataFrame, c: str, q: float, name: str) -> DataFrame:
    """One row with the nearest-rank quantile of an integer-like column, from its distribution."""
    hist = d.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    # A row for each distinct value: counts, not the values themselves, meet in one task.
    run = hist.withColumn("upto", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(c))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return run.where(F.col("upto") > F.round((F.col("all") - 1) * q)).agg(F.min(c).alias(name))


def blocking_total(cands: DataFrame, truth: DataFrame, pool_size: DataFrame) -> DataFrame:
    """One row of overall measures; pool_size is a one-row table (pool_size)."""
    per = per_record(cands, truth).withColumn("oracle", oracle(F.col("tp"), F.col("n_true")))
    sums = per.agg(
        F.count("*").alias("n_s1"),
        F.sum("n_cand").alias("total_pairs"),
        F.avg("n_cand").alias("mean_cands"),
        F.median("n_cand").alias("median_cands"),
        F.max("n_cand").alias("max_cands"),
        F.count_if(F.col("n_cand") == 0).alias("s1_zero_cands"),
        F.try_divide(F.sum("tp"), F.sum("n_true")).alias("pair_recall"),
        F.avg("oracle").alias("oracle_ceiling"),
    )
    inside = cands.where("cand_id is not null").join(truth.select("s1_id"), "s1_id", "left_semi")
    rows = cands.where("cand_id is not null").agg(F.count("*").alias("_in")).crossJoin(inside.agg(F.count("*").alias("_kept"))).crossJoin(inside.select("s1_id", "cand_id").distinct().agg(F.count("*").alias("_once")))
    out = sums.crossJoin(value_quantile(per, "n_cand", 0.95, "p95_cands")).crossJoin(rows).crossJoin(pool_size)  # one row each
    return out.withColumns(
        {
            "dup_pairs": F.col("_kept") - F.col("_once"),
            "ignored_pairs": F.col("_in") - F.col("_kept"),
            "reduction_ratio": 1 - F.try_divide(F.col("total_pairs"), F.col("n_s1") * F.col("pool_size")),
        }
    ).drop("_in", "_kept", "_once")


def blocking_by_source(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """Recall and list length by the source of the candidate."""
    src = F.substring("cand_id", 1, 2).alias("src")
    c = cands.select("s1_id", "cand_id").distinct().join(truth.select("s1_id"), "s1_id", "left_semi")
    want = pairs_of(truth).join(c.withColumn("_hit", F.lit(1)), ["s1_id", "cand_id"], "left").groupBy(src).agg(F.count("*").alias("n_true"), F.count("_hit").alias("tp"))
    have = c.groupBy(src).agg(F.count("*").alias("n_cand"))
    n = truth.agg(F.count("*").alias("_n"))
    d = want.join(have, "src", "full").na.fill(0, ["n_true", "tp", "n_cand"]).crossJoin(n)  # one row
    return d.select("src", "n_true", "tp", "n_cand", F.try_divide("tp", "n_true").alias("pair_recall"), F.try_divide("n_cand", "_n").alias("cands_per_s1"))


def blocking_by(per: DataFrame, key: str) -> DataFrame:
    """List length, recall and ceiling by a column of per_record."""
    d = per.withColumn("oracle", oracle(F.col("tp"), F.col("n_true")))
    return d.groupBy(key).agg(F.count("*").alias("n_s1"), F.avg("n_cand").alias("mean_cands"), F.try_divide(F.sum("tp"), F.sum("n_true")).alias("pair_recall"), F.avg("oracle").alias("oracle"))


def by_match_count(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """blocking_by the number of true matches, seven and more together."""
    return blocking_by(per_record(cands, truth).withColumn("n_true_grp", F.least(F.col("n_true"), F.lit(7))), "n_true_grp")


#: Cutoffs that a trade-off table shows.
CUTOFFS = (("all", None), *(("topk", k) for k in (50, 30, 20, 15, 10, 8, 5, 3, 1)), *(("gap", g) for g in (0.3, 0.2, 0.1, 0.05)))


def tradeoff(cands: DataFrame, truth: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """One row for each cutoff: mean list length, ceiling, recall and pairs. All cutoffs are counted
    in one pass: a pair is exploded to the cutoffs that keep it."""
    best = F.max("block_score").over(Window.partitionBy("s1_id"))
    c = cands.join(truth.select("s1_id"), "s1_id", "left_semi").dropDuplicates(["s1_id", "cand_id"]).withColumn("_b", best)
    c = c.join(pairs_of(truth).withColumn("_hit", F.lit(1)), ["s1_id", "cand_id"], "left")

    def keeps(kind: str, v) -> Column:
        if kind == "all":
            return F.lit(True)
        if kind == "topk":
            return F.col("block_rank") <= v
        if kind == "gap":
            return F.col("block_score") >= F.col("_b") - v
        if kind == "min_score":
            return F.col("block_score") >= v
        if kind == "topk_gap":
            return (F.col("block_rank") <= v[0]) & (F.col("block_score") >= F.col("_b") - v[1])
        raise ValueError(f"unknown cutoff {kind!r}")

    names = [k if v is None else f"{k}={v}" for k, v in cutoffs]
    kept = F.filter(F.array(*[F.when(keeps(k, v), F.lit(n)) for (k, v), n in zip(cutoffs, names, strict=True)]), lambda x: x.isNotNull())
    per = c.select("s1_id", "_hit", F.explode(kept).alias("cutoff")).groupBy("cutoff", "s1_id").agg(F.count("*").alias("n_cand"), F.count("_hit").alias("tp"))
    t = truth.select("s1_id", F.size("matched_ids").cast("long").alias("n_true")).withColumn("cutoff", F.explode(F.array(*map(F.lit, names))))
    d = t.join(per, ["cutoff", "s1_id"], "left").na.fill(0, ["n_cand", "tp"]).withColumn("oracle", oracle(F.col("tp"), F.col("n_true")))
    return d.groupBy("cutoff").agg(F.avg("n_cand").alias("avg_cands"), F.avg("oracle").alias("oracle"), F.try_divide(F.sum("tp"), F.sum("n_true")).alias("pair_recall"), F.sum("n_cand").alias("total_pairs"))


def auc(scored: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at half; over distinct scores, so equal ones
    are counted before they meet."""
    by = by or []
    d = scored.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_n"))
    # Ranges of scores in order: each is summed in its own task, and only their totals meet.
    d = staged(d.repartitionByRange(*by, score).withColumn("_range", F.spark_partition_id()), "ranges")
    key = [*by, "_range"]
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = d.groupBy(*key).agg(F.sum("_n").alias("_all"))
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.coalesce(F.sum("_all").over(upto), F.lit(0)).alias("_before"))
    on = None
    for i, c in enumerate(key):
        one = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        on = one if on is None else on & one
    d = d.withColumn("_inside", inside).join(F.broadcast(totals), on)  # a row for each range
    d = d.withColumn("_won", F.col("_p") * (F.col("_before") + F.col("_inside") + F.col("_n") / 2))
    return d.groupBy(*by).agg(F.try_divide(F.sum("_won"), F.sum("_p") * F.sum("_n")).alias("auc"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))


def threshold_grid(scored: DataFrame, truth: DataFrame, ts: list[float], t1s: list[float]) -> DataFrame:
    """(t, t1, macro_f05) for all pairs t1 <= t, in one pass: a pair is exploded to the settings
    that accept it."""
    best = F.max("prob").over(Window.partitionBy("s1_id"))
    grid = [(t, u) for t in ts for u in t1s if u <= t]
    d = scored.join(truth.select("s1_id"), "s1_id", "left_semi").withColumn("_b", best).join(pairs_of(truth).withColumn("_hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    takes = [F.when((F.col("prob") >= t) | ((F.col("prob") == F.col("_b")) & (F.col("prob") >= u)), F.struct(F.lit(t).alias("t"), F.lit(u).alias("t1"))) for t, u in grid]
    taken = F.filter(F.array(*takes), lambda x: x.isNotNull())
    per = d.select("s1_id", "_hit", F.explode(taken).alias("g")).groupBy("g.t", "g.t1", "s1_id").agg(F.count("*").alias("n_cand"), F.count("_hit").alias("tp"))
    spark = scored.sparkSession
    settings = spark.createDataFrame(grid, "t double, t1 double")
    # Records that a setting takes nothing from score 1 if they have no match, else 0.
    n = truth.select("s1_id", F.size("matched_ids").cast("long").alias("n_true"))
    base = n.agg(F.count("*").alias("_all"), F.count_if(F.col("n_true") == 0).alias("_none"))
    got = per.join(n, "s1_id").withColumn("f", f05(F.col("tp"), F.col("n_cand"), F.col("n_true")))
    sums = got.groupBy("t", "t1").agg(F.sum("f").alias("_f"), F.count_if(F.col("n_true") == 0).alias("_spoilt"))
    out = settings.join(F.broadcast(sums), ["t", "t1"], "left").na.fill(0).crossJoin(base)
    return out.select("t", "t1", ((F.col("_f") + F.col("_none") - F.col("_spoilt")) / F.col("_all")).alias("macro_f05"))


def prior_shift(p: DataFrame, score: str, train_rate: float, steps: int = 200, bins: int = 10_000) -> float:
    """Class share under a shifted prior, by expectation maximisation over the posteriors. They are
    counted in bins first (each kept at its mean), so the loop runs on at most `bins` rows. A bin is
    1 / bins wide and its mean is kept, so what a step adds up is off by the curvature within a bin
    alone: for train rates and shares of 0.01 and more, by less than 1e-5."""
    rows = p.where(F.col(score).isNotNull()).groupBy(F.floor(F.col(score) * bins).alias("b")).agg(F.avg(score).alias("p"), F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in rows)
    if not total:
        return train_rate
    share = train_rate
    for _ in range(steps):
        up, down = share / train_rate, (1 - share) / (1 - train_rate)
        share = sum(r["n"] * r["p"] * up / (r["p"] * up + (1 - r["p"]) * down) for r in rows) / total
    return share
