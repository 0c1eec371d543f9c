"""Error analysis, data checks, fill rates and evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scripts import has_devanagari
from ..functions.strings import similarity, token_jaccard
from .metrics import f05, pairs_of, per_record


#: Reasons by the condition on a pair's features, the first that holds.
MISSED = (
    ("cross-script name", "p_nonlatin = 1"),
    ("address missing", "p_addr_missing = 1 or q_addr_missing = 1"),
    ("house number differs (2+ edits)", "house_tol = -1"),
    ("house number 1 edit", "house_tol = 0.5"),
    ("name very different (<0.6)", "name_ts < 0.6"),
    ("address very different (<0.5)", "addr_ts < 0.5"),
    ("name partly different", "name_ts < 0.85"),
    ("name+address similar", "true"),
)
FALSE = (
    ("cross-script name", "p_nonlatin = 1"),
    ("near-identical record (label noise?)", "name_ts >= 0.95 and addr_ts >= 0.95 and house_tol >= 0"),
    ("same address, different name", "addr_ts >= 0.85 and name_ts < 0.85"),
    ("same name, other house number", "name_ts >= 0.9 and house_tol = -1"),
    ("same name, house 1 edit", "name_ts >= 0.9 and house_tol = 0.5"),
    ("same name, different address", "name_ts >= 0.9 and addr_ts < 0.7"),
    ("address missing", "p_addr_missing = 1 or q_addr_missing = 1"),
    ("other", "true"),
)


def first_reason(rules: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first rule (label, condition) that holds for a row."""
    return F.coalesce(*[F.when(F.expr(condition), F.lit(label)) for label, condition in rules])


def missed_reason() -> Column:
    """Why a true pair is hard to find."""
    return first_reason(MISSED)


def false_reason() -> Column:
    """Why a false pair looks true."""
    return first_reason(FALSE)


def error_parts(pred: DataFrame, cands: DataFrame, retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, n): false positives, and true pairs that the model rejected, the pruner cut, or
    retrieval missed, with those found."""
    key = ["s1_id", "cand_id"]
    mark = lambda d, n: d.select(*key).distinct().withColumn(n, F.lit(1))
    t = pairs_of(truth).join(mark(pred, "p"), key, "left").join(mark(cands, "c"), key, "left").join(mark(retrieved, "r"), key, "left")
    kind = F.when(F.col("p").isNotNull(), "found").when(F.col("c").isNotNull(), "model rejected").when(F.col("r").isNotNull(), "pruner cut").otherwise("retrieval missed")
    fp = pred.select(*key).distinct().join(pairs_of(truth), key, "left_anti").select(F.lit("false positive").alias("kind"))
    return t.select(kind.alias("kind")).unionByName(fp).groupBy("kind").agg(F.count("*").alias("n"))


def outcomes(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """By kind of outcome: records, and the share of all F0.5 lost."""
    d = per_record(pred, truth).withColumn("loss", 1 - f05(F.col("tp"), F.col("n_cand"), F.col("n_true")))
    kind = (
        F.when((F.col("n_true") == 0) & (F.col("n_cand") == 0), "empty, rightly")
        .when(F.col("n_true") == 0, "false match of an unmatched record")
        .when(F.col("n_cand") == 0, "nothing predicted")
        .when(F.col("tp") == 0, "all wrong")
        .when((F.col("tp") == F.col("n_true")) & (F.col("n_cand") == F.col("tp")), "perfect")
        .when(F.col("tp") == F.col("n_cand"), "only misses")
        .when(F.col("tp") == F.col("n_true"), "only false positives")
        .otherwise("both")
    )
    g = d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_s1"), F.sum("loss").alias("loss"))
    return g.withColumn("loss_share", F.coalesce(F.try_divide(F.col("loss"), F.sum("loss").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))


def loss_by_count(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean F0.5 and loss by the number of true matches, seven and more together."""
    d = per_record(pred, truth).withColumn("f", f05(F.col("tp"), F.col("n_cand"), F.col("n_true")))
    return d.groupBy(F.least("n_true", F.lit(7)).alias("n_true_grp")).agg(F.count("*").alias("n_s1"), F.avg("f").alias("f05"), F.sum(1 - F.col("f")).alias("loss"))


def fill_report(norm: DataFrame) -> DataFrame:
    """By country: rows and how many have each normalised field."""
    some = lambda c: F.count_if(text.blank(c) != "").alias(f"n_{c}")
    fields = [c for c in ("name_norm", "name_core", "legal_suffix", "name_latin", "addr_norm", "postcode", "city", "house_no") if c in norm.columns]
    return norm.groupBy("country").agg(F.count("*").alias("n"), *[some(c) for c in fields], F.count_if(F.col("script") != "latin").alias("n_other_script"))


def quality_summary(records: DataFrame) -> DataFrame:
    """By country and source: rows, blanks, non-Latin names, digits in names, repeated names."""
    name, addr = text.blank("name"), text.blank("address")
    blank = lambda c: c.rlike(r"(?U)^\s*$")
    src = F.substring("entity_id", 1, 2).alias("src")
    d = records.select("country", src, "entity_id", name.alias("n"), addr.alias("a"))
    out = d.groupBy("country", "src").agg(
        F.count("*").alias("rows"),
        F.count_if(blank(F.col("n"))).alias("blank_names"),
        F.count_if(blank(F.col("a"))).alias("blank_addresses"),
        F.count_if(F.col("n").rlike(text.NON_LATIN)).alias("non_latin_names"),
        F.count_if(F.col("n").rlike(r"(?U)\d")).alias("names_with_digits"),
        F.avg(F.char_length("n")).alias("mean_name_length"),
    )
    same = d.groupBy("country", "src", F.lower("n").alias("k")).agg(F.count("*").alias("c")).groupBy("country", "src").agg(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("rows_sharing_name"))
    return out.join(same, ["country", "src"])


def pair_agreement(pairs: DataFrame) -> DataFrame:
    """True pairs (country, cross_script, raw and core names, postcodes) summed overall, by country
    and by whether the scripts differ: one grouping with sets instead of three passes."""
    eq = lambda a, b: ((text.blank(a) == text.blank(b)) & (text.blank(a) != "")).cast("int")
    d = pairs.select("country", "cross_script", eq("s1_raw", "cand_raw").alias("raw_eq"), eq("s1_core", "cand_core").alias("core_eq"), eq("s1_postcode", "cand_postcode").alias("post_eq"), token_jaccard("s1_core", "cand_core").alias("jac"))
    d = d.groupingSets([[], [F.col("country")], [F.col("cross_script")]], "country", "cross_script").agg(
        F.grouping_id().alias("level"), F.count("*").alias("pairs"), F.avg("raw_eq").alias("raw_equal"), F.avg("core_eq").alias("core_equal"), F.avg("post_eq").alias("postcode_equal"), F.avg("jac").alias("core_jaccard")
    )
    return d


def joined_agreement(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """pair_agreement of the pairs that a join of two sides on a key would list, which it does not list.

    left (on, country, cross_script, raw, core, postcode) and right (on, raw, core, postcode). Equal
    names are counted before they meet: pairs by key, agreements by key and value, and the Jaccard sums by key and
    token, from the distinct sets of tokens that share one."""
    group = ["country", "cross_script"]
    left, right = (d.where(F.col(on).isNotNull()) for d in (left, right))
    sums = ("pairs", "raw", "core", "post", "jac")
    empty = lambda d, name, value: d.select(*group, *[(value.cast("double") if x == name else F.lit(0.0)).alias(x) for x in sums])

    def sides(*keys: Column) -> tuple[DataFrame, DataFrame]:
        """The rows of both sides, counted by the key and further values."""
        names = [f"_k{i}" for i in range(len(keys))]
        one = left.select(on, *group, *[k.alias(x) for k, x in zip(keys, names, strict=True)])
        two = right.select(on, *[k.alias(x) for k, x in zip(keys, names, strict=True)])
        return one.groupBy(on, *group, *names).agg(F.count("*").alias("_n")), two.groupBy(on, *names).agg(F.count("*").alias("_m"))

    def counted(name: str, *keys: Column) -> DataFrame:
        one, two = sides(*keys)
        for i in range(len(keys)):
            one, two = one.where(F.col(f"_k{i}") != ""), two.where(F.col(f"_k{i}") != "")
        return empty(one.join(two, [on, *[f"_k{i}" for i in range(len(keys))]]), name, F.col("_n") * F.col("_m"))

    # Sets of tokens that share one meet once for each shared token; only the first of these counts.
    tokens = F.array_sort(F.filter(F.array_distinct(F.split(text.blank("core"), " ")), lambda t: t != ""))
    one, two = sides(tokens)
    one = one.select(on, *group, F.col("_k0").alias("_x"), "_n", F.explode("_k0").alias("_t"))
    two = two.select(on, F.col("_k0").alias("_y"), "_m", F.explode("_k0").alias("_t"))
    both = F.array_intersect("_x", "_y")
    met = one.join(two, [on, "_t"]).where(F.element_at(both, 1) == F.col("_t"))
    jac = empty(met, "jac", F.col("_n") * F.col("_m") * F.size(both) / F.size(F.array_union("_x", "_y")))
    rows = counted("pairs")
    for name, column in (("raw", "raw"), ("core", "core"), ("post", "postcode")):
        rows = rows.unionByName(counted(name, text.blank(column)))
    rows = rows.unionByName(jac)
    total = lambda x: F.sum(x) / F.sum("pairs")
    d = rows.groupingSets([[], [F.col("country")], [F.col("cross_script")]], *group)
    return d.agg(
        F.grouping_id().alias("level"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"), total("raw").alias("raw_equal"), total("core").alias("core_equal"), total("post").alias("postcode_equal"), total("jac").alias("core_jaccard")
    )


def rerank(pool: DataFrame, score: str, k: int) -> DataFrame:
    """A fixed pool (q_id, p_id, retrieval, is_true, score) ranked anew by score, then retrieval, then
    id; (q_id, n_true, hits) counts the true ones among the first k."""
    order = Window.partitionBy("q_id").orderBy(F.desc(score), F.desc("retrieval"), "p_id")
    d = pool.withColumn("_r", F.row_number().over(order))
    return d.groupBy("q_id").agg(F.sum("is_true").alias("n_true"), F.sum(F.when(F.col("_r") <= k, F.col("is_true")).otherwise(0)).alias("hits"))


def match_histogram(truth: DataFrame) -> DataFrame:
    """Records by number of matches."""
    return truth.groupBy(F.size("matched_ids").alias("n_matches")).agg(F.count("*").alias("n_s1"))


def integrity(truth: DataFrame, records: DataFrame) -> DataFrame:
    """(rule, n): what a truth table and the records must not hold."""
    p = pairs_of(truth)
    ids = records.select(F.col("entity_id").alias("_id"))
    rule = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    rules = [
        rule(p.join(ids, F.col("cand_id") == F.col("_id"), "left_anti"), "match not among the records"),
        rule(truth.join(ids, F.col("s1_id") == F.col("_id"), "left_anti"), "record of the truth not among the records"),
        rule(truth.groupBy("s1_id").count().where("count > 1"), "record twice in the truth"),
        rule(p.groupBy("cand_id").agg(F.countDistinct("s1_id").alias("c")).where("c > 1"), "match of several records"),
        rule(records.groupBy("entity_id").count().where("count > 1"), "id twice among the records"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def label_free(pred: DataFrame, records: DataFrame, orphans: DataFrame, reverse: DataFrame, strong: DataFrame) -> DataFrame:
    """By country: what can be told of predictions without labels. strong is (s1_id, cand_id, strong),
    true where names and addresses are alike."""
    s1 = records.where(F.substring("entity_id", 1, 2) == "S1").select(F.col("entity_id").alias("s1_id"), "country")
    p = pred.select("s1_id", "cand_id").distinct().join(s1, "s1_id")
    n_claims = p.groupBy("cand_id").agg(F.count("*").alias("n_claims"))
    d = (
        p.join(n_claims, "cand_id")
        .join(orphans.select(F.col("rec_id").alias("cand_id"), "orphan_prob"), "cand_id", "left")
        .join(reverse.select(F.col("rec_id").alias("cand_id"), "s1_id", "rank"), ["s1_id", "cand_id"], "left")
        .join(strong, ["s1_id", "cand_id"], "left")
    )
    out = d.groupBy("country").agg(
        F.count("*").alias("pairs"),
        F.countDistinct("s1_id").alias("s1_matched"),
        F.countDistinct(F.when(F.col("n_claims") > 1, F.col("cand_id"))).alias("claimed_2plus"),
        F.avg("orphan_prob").alias("orphan_mean"),
        F.avg((F.col("orphan_prob") > 0.5).cast("int")).alias("orphan_gt_05"),
        F.avg(F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0))).alias("rev_rank1"),
        F.avg(F.col("rank").isNotNull().cast("int")).alias("rev_listed"),
        F.avg(F.coalesce(F.col("strong").cast("int"), F.lit(0))).alias("strong"),
    )
    return s1.groupBy("country").agg(F.count("*").alias("n_s1")).join(out, "country", "left").na.fill(0, ["pairs", "s1_matched", "claimed_2plus"]).withColumn("matches_per_s1", F.col("pairs") / F.col("n_s1"))


def rank_hits(ranked: DataFrame, truth: DataFrame, variants: tuple[str, ...] = ("raw", "core"), levels: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row that compares rankings of retrieved pairs (s1_id, cand_id, <variant>_rank): queries, true
    pairs retrieved, true pairs and queries with one among the first 5 and 10 of each ranking, their
    rates over queries with a match and over true pairs, and the queries that the second ranking wins
    or loses at the deepest level."""
    hits = ranked.join(pairs_of(truth).distinct(), ["s1_id", "cand_id"])
    names = [(v, n) for v in variants for n in levels]
    per = hits.groupBy("s1_id").agg(F.count("*").alias("retrieved"), *[F.count_if(F.col(f"{v}_rank") <= n).alias(f"{v}_top{n}") for v, n in names])
    d = truth.select("s1_id", F.size("matched_ids").alias("n_true")).join(per, "s1_id", "left").na.fill(0)
    last = levels[-1]
    one, two = (F.col(f"{v}_top{last}") > 0 for v in variants[:2])
    sums = d.agg(
        F.count("*").alias("queries"),
        F.count_if(F.col("n_true") > 0).alias("positive_queries"),
        F.sum("n_true").alias("true_pairs"),
        F.sum("retrieved").alias("retrieved_true_pairs"),
        F.count_if(F.col("retrieved") > 0).alias("retrieval_hit_queries"),
        *[F.sum(f"{v}_top{n}").alias(f"{v}_top{n}_pairs") for v, n in names],
        *[F.count_if(F.col(f"{v}_top{n}") > 0).alias(f"{v}_top{n}_hit_queries") for v, n in names],
        F.count_if(two & ~one).alias(f"{variants[1]}_wins_top{last}_queries"),
        F.count_if(one & ~two).alias(f"{variants[1]}_losses_top{last}_queries"),
    )
    rate = {f"{c}_rate": F.try_divide(c, "positive_queries") for c in ["retrieval_hit_queries", *(f"{v}_top{n}_hit_queries" for v, n in names)]}
    recall = {f"{c}_recall": F.try_divide(c, "true_pairs") for c in ["retrieved_true_pairs", *(f"{v}_top{n}_pairs" for v, n in names)]}
    return sums.withColumns(rate | recall)


def subset_recall(truth: DataFrame, subset: DataFrame, steps: dict[str, DataFrame]) -> DataFrame:
    """One row: true pairs whose record is in a subset (cand_id), their S1, and how many of the pairs
    each step (s1_id, cand_id) still has."""
    d = pairs_of(truth).distinct().join(subset.select("cand_id").distinct(), "cand_id", "left_semi")
    for name, pairs in steps.items():
        d = d.join(pairs.select("s1_id", "cand_id").distinct().withColumn(name, F.lit(1)), ["s1_id", "cand_id"], "left")
    out = d.agg(F.count("*").alias("true_pairs"), F.count_distinct("s1_id").alias("positive_s1"), *[F.count(n).alias(f"{n}_pairs") for n in steps])
    return out.withColumns({f"{n}_recall": F.try_divide(f"{n}_pairs", "true_pairs") for n in steps})


def transliteration_report(pairs: DataFrame, token_map: DataFrame) -> DataFrame:
    """One row on true pairs of a Latin S1 and a Devanagari record (s1_id, s1_core, s1_latin, cand_core,
    cand_latin): how equal and alike the names are before and after they are written in Latin, and how
    many of the Devanagari tokens the learned map (tok) knows."""
    eq = lambda a, b: ((text.blank(a) != "") & (text.blank(a) == text.blank(b))).cast("int")
    tokens = pairs.select(F.explode(F.split(text.blank("cand_core"), r"(?U)\s+")).alias("tok")).where(has_devanagari("tok"))
    known = tokens.join(token_map.select("tok").distinct().withColumn("_m", F.lit(1)), "tok", "left").agg(F.count("*").alias("devanagari_tokens"), F.count("_m").alias("mapped_tokens"))
    out = pairs.agg(
        F.count("*").alias("pairs"),
        F.count_distinct("s1_id").alias("positive_s1"),
        F.avg(eq("s1_core", "cand_core")).alias("core_exact_rate"),
        F.avg(eq("s1_latin", "cand_latin")).alias("latin_exact_rate"),
        F.avg(token_jaccard("s1_core", "cand_core")).alias("core_jaccard_mean"),
        F.avg(token_jaccard("s1_latin", "cand_latin")).alias("latin_jaccard_mean"),
        F.avg(100 * similarity("weighted_ratio", "s1_core", "cand_core")).alias("core_wratio_mean"),
        F.avg(100 * similarity("weighted_ratio", "s1_latin", "cand_latin")).alias("latin_wratio_mean"),
        F.count_if(has_devanagari(text.blank("cand_latin"))).alias("nonlatin_output_pairs"),
    )
    return out.crossJoin(known).withColumn("mapped_token_rate", F.try_divide("mapped_tokens", "devanagari_tokens"))  # one row each


def texts_of(ids: DataFrame, *sources: DataFrame) -> DataFrame:
    """(entity_id, name, address) of the ids asked for, from several sources."""
    every = sources[0]
    for s in sources[1:]:
        every = every.unionByName(s)
    return every.join(ids.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "name", "address")
