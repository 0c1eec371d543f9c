"""Features of single records, for the models of records without a match, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .blocks import is_source

#: Words and signs in raw names.
WEB = r"(?iU)\.(com|in|net|org|fr)\b|www\."
IDENTIFIER = r"(?iU)\(id:|#\d{3,}"
TRADING_AS = r"(?iU)doing business as|\bdba\b|\bt/a\b"
LEGAL = r"(?iU)\b(private|limited|pvt|ltd|llc|l\.l\.c|llp|inc|corp|corporation|company|co\.|plc|sarl|sas|sasu|eurl|sa|sci|snc)\b"
JUNK = r"(?U)^\s*[-<>#*@._~]+"


def flags(records: DataFrame) -> DataFrame:
    """Records (entity_id, name, address, country) with what their raw texts look like."""
    name, addr = text.blank("name"), text.blank("address")
    clean = text.block_text("name")
    tokens = F.size(F.split(clean, " "))
    as_int = {
        "name_web": name.rlike(WEB), "name_phone": name.rlike(r"(?U)\d{7,}"), "name_id": name.rlike(IDENTIFIER),
        "name_dba": name.rlike(TRADING_AS), "name_junk": name.rlike(JUNK), "name_legal": name.rlike(LEGAL),
        "nonlatin": name.rlike(text.NON_LATIN), "name_blank": name.rlike(r"(?U)^\s*$"), "addr_blank": addr.rlike(r"(?U)^\s*$"),
        "addr_digit": addr.rlike(r"(?U)\d"), "house_compound": F.lower(addr).rlike("(?U)" + text.HOUSE_NUMBER), "name_one_token": tokens == 1,
    }
    return records.select(
        "entity_id",
        "country",
        clean.alias("cname"),
        F.array_join(F.array_sort(F.transform(text.numbers(addr), lambda x: F.regexp_replace(x, r"(?U)^0+(\d)", "$1"))), " ").alias("digits"),
        F.char_length(name).alias("name_len"),
        tokens.alias("name_tokens"),
        F.regexp_count(name, F.lit(r"(?U)\d")).alias("name_digits"),
        F.char_length(addr).alias("addr_len"),
        F.size(F.split(addr, ",")).alias("addr_parts"),
        F.regexp_count(addr, F.lit(r"(?U)\d")).alias("addr_digits"),
        *[c.cast("int").alias(n) for n, c in as_int.items()],
        F.col("entity_id").startswith("S3-").cast("int").alias("is_s3"),
    )


def twins(d: DataFrame, keys: list[str], name: str) -> DataFrame:
    """d with the number of other rows of equal keys: counted by key first, then joined back."""
    n = d.groupBy(*keys).agg((F.count("*") - 1).alias(name))
    k = [F.col(c).alias(f"_{c}") for c in keys]
    on = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = one if on is None else on & one
    return d.join(n.select(*k, name), on, "left").drop(*[f"_{c}" for c in keys])


def pool_frame(records: DataFrame) -> DataFrame:
    """Features of the records of sources 2 and 3: their texts, how known their tokens and names are
    in source 1, and how many share their name, or name and numbers."""
    d = flags(records.where(~is_source(1)))
    s1 = records.where(is_source(1)).select("country", text.block_text("name").alias("cname"))
    names = s1.groupBy("country", "cname").agg(F.count("*").alias("name_s1_count"))
    known = s1.select("country", F.explode(F.split("cname", " ")).alias("tok")).groupBy("country", "tok").agg(F.count("*").alias("tok_df"))
    tok = d.select("entity_id", "country", F.explode(F.split("cname", " ")).alias("tok")).join(known, ["country", "tok"], "left")
    share = tok.groupBy("entity_id").agg(F.avg(F.col("tok_df").isNotNull().cast("int")).alias("tok_in_s1_share"), F.min(F.coalesce("tok_df", F.lit(0))).alias("tok_min_s1_df"))
    d = d.join(share, "entity_id", "left").join(names, ["country", "cname"], "left").na.fill(0, ["name_s1_count"])
    d = d.withColumn("name_in_s1", (F.col("name_s1_count") > 0).cast("int"))
    d = twins(twins(d, ["country", "cname"], "pool_name_twins"), ["country", "cname", "digits"], "pool_key_twins")
    return d.withColumnRenamed("entity_id", "rec_id").drop("cname", "digits", "name_blank", "addr_digit")


def reverse_summary(reverse: DataFrame) -> DataFrame:
    """What the reverse list of a record says of it."""
    n = lambda c: F.count_if(c)
    d = reverse.groupBy("rec_id").agg(
        F.max("score").alias("rev_best"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("rev_second"),
        n(F.col("score") >= 0.5).alias("rev_n50"),
        n(F.col("score") >= 0.7).alias("rev_n70"),
        n(F.col("score") >= 0.9).alias("rev_n90"),
        F.max("s_word").alias("rev_best_word"),
        F.max("s_namenum").alias("rev_best_namenum"),
        F.count("*").alias("rev_n"),
    )
    return d.withColumn("rev_gap", F.col("rev_best") - F.coalesce("rev_second", F.lit(0.0)))


def s1_frame(records: DataFrame) -> DataFrame:
    """Features of source-1 records: their texts, equal names in source 1 and in the pool."""
    d = flags(records.where(is_source(1))).select("entity_id", "country", "cname", "name_len", "name_digits", "name_legal", "addr_len", "addr_parts", "addr_digits", "house_compound", "name_tokens")
    pool = records.where(~is_source(1)).select("country", text.block_text("name").alias("cname")).groupBy("country", "cname").agg(F.count("*").alias("pool_name_count"))
    d = twins(d, ["country", "cname"], "s1_name_twins").join(pool, ["country", "cname"], "left").na.fill(0, ["pool_name_count"])
    return d.withColumnRenamed("entity_id", "s1_id").drop("cname")


def s1_reverse(reverse: DataFrame, orphans: DataFrame) -> DataFrame:
    """What the reverse lists that hold an S1 say of it, and how likely orphans its first-rank
    records are. The second score is found by rank, not by listing the scores."""
    first = F.col("rank") == 1
    d = reverse.groupBy("s1_id").agg(
        F.count("*").alias("in_top10"),
        F.count_if(first).alias("in_rank1"),
        F.max("score").alias("in_best"),
        F.count_if(F.col("score") >= 0.7).alias("in_n70"),
        F.count_if(F.col("score") >= 0.9).alias("in_n90"),
        F.count_if(first & (F.col("score") >= 0.7)).alias("in_r1_n70"),
        F.max("s_namenum").alias("in_best_namenum"),
    )
    second = reverse.select("s1_id", "score", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "rec_id")).alias("_n")).where("_n <= 2").where("_n = 2").select("s1_id", F.col("score").alias("in_second"))
    r1 = reverse.where(first).select("rec_id", "s1_id").join(orphans, "rec_id", "left").groupBy("s1_id").agg(
        F.sum(1 - F.col("orphan_prob")).alias("r1_exp_matched"), F.min("orphan_prob").alias("r1_min_orphan"), F.count_if(F.col("orphan_prob") < 0.5).alias("r1_n_orphan_lt50")
    )
    return d.join(second, "s1_id", "left").join(r1, "s1_id", "left")


def prob_summary(p: DataFrame, score: str) -> DataFrame:
    """One row: mean, linear quantiles and shares of high probabilities."""
    q = F.percentile(score, F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    names = ("q10", "q25", "q50", "q75", "q90")
    d = p.agg(F.count(score).alias("n"), F.avg(score).alias("mean"), q.alias("_q"), F.avg((F.col(score) > 0.5).cast("int")).alias("share_gt_05"), F.avg((F.col(score) > 0.8).cast("int")).alias("share_gt_08"))
    return d.select("n", "mean", *[F.col("_q")[i].alias(x) for i, x in enumerate(names)], "share_gt_05", "share_gt_08")


#: Flags that a drift table shares out.
SHARES = ("addr_blank", "nonlatin", "house_compound", "addr_digit", "name_one_token", "name_web", "name_phone", "name_id", "name_dba", "name_junk", "name_blank")


def drift_table(records: DataFrame) -> DataFrame:
    """By country and side (s1, pool): rows, shares of flags, medians, and how names repeat."""
    d = flags(records).withColumn("side", F.when(F.substring("entity_id", 1, 2) == "S1", "s1").otherwise("pool"))
    sizes = d.groupBy("country", "side", "cname").agg(F.count("*").alias("g"))
    out = d.groupBy("country", "side").agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(c) for c in SHARES],
        F.median("addr_len").alias("addr_len_med"),
        F.median("addr_parts").alias("addr_parts_med"),
        F.avg("name_tokens").alias("name_tokens_mean"),
    )
    # A group of g equal names holds g rows: rows are weighed without listing them.
    names = sizes.groupBy("country", "side").agg(
        F.count("*").alias("distinct_names"),
        (F.sum(F.when(F.col("g") == 1, 1).otherwise(0)) / F.sum("g")).alias("name_unique_share"),
        (F.sum(F.when(F.col("g") >= 2, F.col("g")).otherwise(0)) / F.sum("g")).alias("name_shared_share"),
    )
    return out.join(names, ["country", "side"])


def drift_long(drift: DataFrame) -> DataFrame:
    """drift_table as (stat, country_side) -> value, one column for each country and side."""
    stats = [c for c in drift.columns if c not in ("country", "side")]
    d = drift.select(F.concat_ws("_", "country", "side").alias("who"), *[F.col(c).cast("double").alias(c) for c in stats])
    return d.unpivot("who", stats, "stat", "value")
