"""Queries of string similarity and pair features.

Short names: customers with the suppliers of their nation. Longer texts: a turn of a conversation
with the next one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.strings import similarities, token_jaccard
from ..operators import features
from ..operators.pairs import joined_similarities
from ..storage import spread
from .base import query, r6, table

NAMES = "names AS (SELECT c_custkey, s_suppkey, c_name AS a, s_name AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey)"
TURNS = """t AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS w FROM conversations WHERE text IS NOT NULL),
turns AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


def name_pairs(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return spread(c).join(s, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "s_suppkey", F.col("c_name").alias("a"), F.col("s_name").alias("b"))


def _name_similarities(spark, sf_dir, kinds):
    c, s = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation")
    return joined_similarities(c, s, "nation", "c_custkey", "s_suppkey", "c_name", "s_name", kinds)


def turn_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.plain_text("text").alias("a"))
    return t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])


@query(f"WITH {NAMES} SELECT c_custkey, s_suppkey, CAST(levenshtein(a, b) AS INTEGER) AS edits FROM names")
def levenshtein_pairs(spark, sf_dir):
    return name_pairs(spark, sf_dir).select("c_custkey", "s_suppkey", F.levenshtein("a", "b").alias("edits"))


@query(f"WITH {NAMES} SELECT c_custkey, s_suppkey, round(jaro_winkler_similarity(a, b), 6) AS jw FROM names")
def jaro_winkler_pairs(spark, sf_dir):
    return _name_similarities(spark, sf_dir, ("jaro_winkler",)).withColumnRenamed("jaro_winkler", "jw")


_TOK = "list_distinct(list_filter(string_split({c}, ' '), lambda x: x <> ''))"
A, B = _TOK.format(c="a"), _TOK.format(c="b")


@query(f"WITH {TURNS} SELECT conv_id, turn, round(CASE WHEN len({A}) + len({B}) = 0 THEN 0.0 ELSE len(list_intersect({A}, {B})) / len(list_distinct(list_concat({A}, {B}))) END, 6) AS jaccard FROM turns")
def token_jaccard_turns(spark, sf_dir):
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", r6(token_jaccard("a", "b")).alias("jaccard"))


RATIOS = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "weighted_ratio")


def _similarities(d, keys, kinds=RATIOS):
    d = d.withColumn("_s", similarities(kinds, "a", "b"))
    return d.select(*keys, *[r6(F.col(f"_s.{k}")).alias(k) for k in kinds])


# The oracle finds longest common subsequences by lists: a row holds those with each start of y, and is
# rewritten for each letter of x as a running maximum.


def _row(x: str, y: str) -> str:
    hits = f"list_transform(string_split({x}, ''), lambda c: list_transform(string_split({y}, ''), lambda d: CAST(c = d AS INTEGER)))"
    step = "list_transform(range(1, len(r) + 1), lambda t: greatest(r[t], (CASE WHEN t > 1 THEN r[t - 1] ELSE 0 END) + m[t]))"
    running = f"list_transform([{step}], lambda q: list_transform(range(1, len(q) + 1), lambda j: list_max(q[1:j])))[1]"
    return f"list_reduce({hits}, lambda r, m: {running}, list_transform(string_split({y}, ''), lambda d: 0))"


def _lcs(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = '' OR {y} = '' THEN 0 ELSE {_row(x, y)}[-1] END)"


def _ratio_sql(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = '' AND {y} = '' THEN 1.0 ELSE 2 * {_lcs(x, y)} / (length({x}) + length({y})) END)"


def _hang_sql(x: str, y: str) -> str:
    """Best ratio of x with the shorter starts of y."""
    return f"coalesce(list_max(list_transform([{_row(x, y)}], lambda z: list_transform(range(1, length({x})), lambda k: 2 * z[k] / (length({x}) + k)))[1]), 0.0)"


def _partial_sql(x: str, y: str) -> str:
    """x is not longer than y; neither is empty."""
    both = [(x, y), (f"reverse({x})", f"reverse({y})")]
    whole = f"list_max(list_transform(range(1, length({y}) - length({x}) + 2), lambda i: {_row(x, f'substring({y}, i, length({x}))')}[-1])) / length({x})"
    swapped = [f"CASE WHEN length({x}) = length({y}) THEN {_hang_sql(v, u)} ELSE 0.0 END" for u, v in both]
    return f"greatest({whole}, {', '.join(_hang_sql(u, v) for u, v in both)}, {', '.join(swapped)})"


def _ordered(x: str, y: str) -> str:
    """A partial ratio whichever text is longer."""
    return f"(CASE WHEN {x} = '' OR {y} = '' THEN CAST({x} = {y} AS DOUBLE) WHEN length({x}) <= length({y}) THEN {_partial_sql(x, y)} ELSE {_partial_sql(y, x)} END)"


def ratios_sql(pairs: str, keys: str) -> str:
    """The five ratios of a table of pairs (keys, a, b)."""
    return f"""{ratio_tables(pairs)} SELECT {keys}, {", ".join(f"round({k}, 6) AS {k}" for k in RATIOS)} FROM {pairs} JOIN s USING (a, b)"""


def ratio_tables(pairs: str) -> str:
    """Common tables that end in s (a, b and the five ratios) of the distinct pairs of a table."""
    tokens = "list_filter(string_split({c}, ' '), lambda v: v <> '')"
    return f"""d AS (SELECT DISTINCT a, b FROM {pairs}),
k AS (SELECT a, b, list_sort({tokens.format(c="a")}) AS ta, list_sort({tokens.format(c="b")}) AS tb FROM d),
w AS (SELECT a, b, array_to_string(ta, ' ') AS sa, array_to_string(tb, ' ') AS sb, array_to_string(list_sort(list_distinct(list_filter(ta, lambda v: list_contains(tb, v)))), ' ') AS both_,
 array_to_string(list_sort(list_distinct(list_filter(ta, lambda v: NOT list_contains(tb, v)))), ' ') AS oa, array_to_string(list_sort(list_distinct(list_filter(tb, lambda v: NOT list_contains(ta, v)))), ' ') AS ob FROM k),
n AS (SELECT *, length(both_) + CAST(both_ <> '' AS INTEGER) + length(oa) AS na, length(both_) + CAST(both_ <> '' AS INTEGER) + length(ob) AS nb, length(oa) + length(ob) - 2 * {_lcs("oa", "ob")} AS apart FROM w),
r AS (SELECT *, {_ratio_sql("a", "b")} AS ratio, {_ordered("a", "b")} AS partial_ratio, {_ratio_sql("sa", "sb")} AS token_sort_ratio,
 CASE WHEN sa = '' OR sb = '' THEN 0.0 WHEN both_ <> '' AND (oa = '' OR ob = '') THEN 1.0 WHEN both_ = '' THEN 1 - apart / (na + nb)
  ELSE greatest(1 - apart / (na + nb), 2 * length(both_) / (length(both_) + na), 2 * length(both_) / (length(both_) + nb)) END AS token_set_ratio,
 {_ordered("sa", "sb")} AS ps, CASE WHEN both_ <> '' THEN 1.0 ELSE {_ordered("oa", "ob")} END AS pt, greatest(length(a), length(b)) / least(length(a), length(b)) AS far FROM n),
s AS (SELECT *, CASE WHEN far < 1.5 THEN greatest(ratio, 0.95 * greatest(token_sort_ratio, token_set_ratio))
  ELSE greatest(ratio, CASE WHEN far <= 8 THEN 0.9 ELSE 0.6 END * partial_ratio, 0.95 * CASE WHEN far <= 8 THEN 0.9 ELSE 0.6 END * greatest(ps, pt)) END AS weighted_ratio FROM r)"""


@query(f"WITH {NAMES}, {ratios_sql('names', 'c_custkey, s_suppkey')}")
def ratio_names(spark, sf_dir):
    """Texts of one token and of equal lengths."""
    return _name_similarities(spark, sf_dir, RATIOS)


@query(f"WITH parts AS (SELECT a.p_partkey, lower(a.p_name) AS a, lower(b.p_name || ' ' || b.p_type) AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), {ratios_sql('parts', 'p_partkey')}")
def ratio_parts(spark, sf_dir):
    """Texts of several tokens, one longer than the other: a part with the next one and its type."""
    d = table(spark, sf_dir, "part")
    one = d.select("p_partkey", F.lower("p_name").alias("a"))
    two = d.select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("b"))
    return _similarities(one.join(two, "p_partkey"), ("p_partkey",))


@query()
def ratio_turns(spark, sf_dir):
    return _similarities(turn_pairs(spark, sf_dir), ("conv_id", "turn"), ("ratio", "token_sort_ratio", "token_set_ratio"))


NUMS = """x AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(a, '[a-z]*\\d+|t[a-z]+'))) AS q, list_sort(list_distinct(regexp_extract_all(b, '[a-z]*\\d+|t[a-z]+'))) AS p FROM turns)"""


@query(
    f"""WITH {TURNS}, {NUMS} SELECT conv_id, turn, round(CASE WHEN len(q) + len(p) > 0 THEN len(list_intersect(q, p)) / len(list_distinct(list_concat(q, p))) END, 6) AS num_jacc, CAST(len(q) AS INTEGER) AS num_q, CAST(len(p) AS INTEGER) AS num_p,
 CAST(len(list_filter(q, lambda v: NOT list_contains(p, v))) AS INTEGER) AS num_q_only, CAST(len(list_filter(p, lambda v: NOT list_contains(q, v))) AS INTEGER) AS num_p_only FROM x"""
)
def num_jaccard(spark, sf_dir):
    """The list features of numbers, on lists of t-words and numbers of both turns."""
    found = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[a-z]*\d+|t[a-z]+"), F.lit(0))))
    d = turn_pairs(spark, sf_dir).select("conv_id", "turn", found("a").alias("q_nums"), found("b").alias("p_nums")).withColumns(features.number_features())
    return d.select("conv_id", "turn", r6("num_jacc").alias("num_jacc"), "num_q", "num_p", "num_q_only", "num_p_only")


HOUSE = f"""{NAMES}, h AS (SELECT c_custkey, s_suppkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE regexp_replace(regexp_extract(a, '(\\d+)', 1), '^0+(\\d)', '\\1') END AS q, regexp_replace(regexp_extract(b, '(\\d+)', 1), '^0+(\\d)', '\\1') AS p FROM names)"""


@query(
    f"""WITH {HOUSE} SELECT c_custkey, s_suppkey, CAST(CASE WHEN q = '' OR p = '' THEN 0 WHEN q = p THEN 1 ELSE -1 END AS INTEGER) AS house_eq, CASE WHEN q = '' OR p = '' THEN 0.0 WHEN levenshtein(q, p) = 0 THEN 1.0 WHEN levenshtein(q, p) = 1 THEN 0.5 ELSE -1.0 END::DOUBLE AS house_tol,
 CAST(CASE WHEN q <> '' AND p <> '' THEN levenshtein(q, p) END AS DOUBLE) AS house_lev, CAST(CASE WHEN nullif(q, '') IS NULL OR nullif(p, '') IS NULL THEN 0 WHEN q = p THEN 1 ELSE -1 END AS INTEGER) AS house_full_eq FROM h"""
)
def house_agreement(spark, sf_dir):
    number = lambda c: F.regexp_replace(F.regexp_extract(c, r"(\d+)", 1), r"^0+(\d)", "$1")
    d = name_pairs(spark, sf_dir).select("c_custkey", "s_suppkey", F.when(F.col("c_custkey") % 10 == 0, "").otherwise(number("a")).alias("q_house"), number("b").alias("p_house"))
    d = d.withColumns({"q_house_full": text.null_if_empty("q_house"), "p_house_full": text.null_if_empty("p_house"), "q_pin": F.lit(None).cast("string"), "p_pin": F.lit(None).cast("string"), "q_nums": F.array("q_house"), "p_nums": F.array("p_house")})
    d = d.withColumns(features.house_features())
    return d.select("c_custkey", "s_suppkey", "house_eq", "house_tol", F.col("house_lev").cast("double").alias("house_lev"), "house_full_eq")


POOL = "pool AS (SELECT p_brand AS country, lower(p_name) AS name_skel, p_partkey FROM part)"


@query(
    f"""WITH {POOL}, n AS (SELECT country, count(*) AS n FROM pool GROUP BY 1), d AS (SELECT country, tok, count(*) AS df FROM (SELECT country, unnest(list_distinct(string_split(name_skel, ' '))) AS tok FROM pool) GROUP BY ALL),
idf AS (SELECT country, tok, ln((n + 1) / (df + 1)) AS idf FROM d JOIN n USING (country)),
pairs AS (SELECT a.country, a.p_partkey AS s1_id, b.p_partkey AS cand_id, string_split(a.name_skel, ' ') AS q, string_split(b.name_skel, ' ') AS p FROM pool a JOIN pool b ON a.country = b.country AND b.p_partkey = a.p_partkey + 25),
x AS (SELECT s1_id, cand_id, country, unnest(list_distinct(list_filter(q, lambda t: NOT list_contains(p, t)))) AS tok FROM pairs)
SELECT s1_id, cand_id, round(max(coalesce(idf, ln(n + 1))), 6) AS q_only_idf FROM x LEFT JOIN idf USING (country, tok) LEFT JOIN n USING (country) GROUP BY ALL"""
)
def idf_one_sided(spark, sf_dir):
    pool = table(spark, sf_dir, "part").select(F.col("p_brand").alias("country"), F.lower("p_name").alias("name_skel"), F.col("p_partkey").alias("entity_id"))
    idf, unseen = features.name_idf(pool)
    a = pool.select("country", F.col("entity_id").alias("s1_id"), F.split("name_skel", " ").alias("q"))
    b = pool.select("country", (F.col("entity_id") - 25).alias("s1_id"), F.col("entity_id").alias("cand_id"), F.split("name_skel", " ").alias("p"))
    pairs = a.join(b, ["country", "s1_id"]).withColumn("q_only", F.array_except("q", "p"))
    return features.one_sided_idf(pairs, "q_only", idf, unseen).select("s1_id", "cand_id", r6("q_only_idf").alias("q_only_idf"))


@query(
    """WITH r AS (SELECT p_partkey AS entity_id, p_brand AS country, lower(p_name) AS name_m FROM part), n AS (SELECT country, count(*) AS n FROM r GROUP BY 1),
d AS (SELECT country, tok, count(*) AS df FROM (SELECT country, unnest(list_distinct(string_split(name_m, ' '))) AS tok FROM r) GROUP BY ALL), i AS (SELECT country, tok, ln((n + 1) / (df + 1)) AS idf FROM d JOIN n USING (country)),
c AS (SELECT country, name_m, count(*) AS name_cnt FROM r GROUP BY ALL), t AS (SELECT entity_id, max(idf) AS hi, min(idf) AS lo FROM (SELECT entity_id, country, unnest(string_split(name_m, ' ')) AS tok FROM r) JOIN i USING (country, tok) GROUP BY 1)
SELECT entity_id, name_cnt, round(hi, 6) AS tok_maxidf, round(lo, 6) AS tok_minidf FROM r JOIN c USING (country, name_m) JOIN t USING (entity_id)"""
)
def record_token_stats(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("country"), F.lower("p_name").alias("name_m"), F.lower("p_name").alias("name_skel"))
    idf, unseen = features.name_idf(d)
    counts = d.groupBy("country", "name_m").agg(F.count("*").alias("name_cnt"))
    out = features.record_stats(d, idf, unseen, counts)
    return out.select("entity_id", "name_cnt", r6("tok_maxidf").alias("tok_maxidf"), r6("tok_minidf").alias("tok_minidf"))
