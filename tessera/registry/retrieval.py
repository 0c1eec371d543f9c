"""Queries of retrieval: TF-IDF blocks, their union, reverse search, exact cosines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks, metrics, tfidf
from ..operators.tfidf import Block
from ..storage import staged
from .base import RECORDS, query, r6, records, table, truth
from .texts import BLOCK_VIEWS

_PLAIN = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_NUMS = "array_to_string(regexp_extract_all({c}, '\\d+'), ' ')"
WORDS = "list_filter(string_split({c}, ' '), lambda t: t <> '')"
PAIRS = f"list_concat({WORDS}, list_transform(range(1, len({WORDS})), lambda i: {WORDS}[i] || ' ' || {WORDS}[i + 1]))"
CHAR4 = "CASE WHEN length({c}) >= 4 THEN list_transform(range(1, length({c}) - 2), lambda i: substring({c}, i, 4)) ELSE [] END"

VIEWS = f"""views AS (SELECT entity_id, country, {_PLAIN.format(c="name")} AS name, {_PLAIN.format(c="address")} AS addr FROM records),
prepared AS (SELECT *, trim(name || ' ' || addr) AS text, replace(name, ' ', '') AS name_key, trim(name || ' ' || {_NUMS.format(c="addr")}) AS namenum, addr = '' AS addr_empty FROM views)"""


def prepared(spark, sf_dir):
    """Plain text views of the records."""
    d = records(spark, sf_dir).select("entity_id", "country", text.plain_text("name").alias("name"), text.plain_text("address").alias("addr"))
    return d.withColumns({"text": F.trim(F.concat_ws(" ", "name", "addr")), "name_key": F.replace("name", F.lit(" "), F.lit("")), "namenum": text.name_numbers("name", "addr"), "addr_empty": F.col("addr") == ""})


def block_sql(b: Block, queries: str, pool: str, tag: str, terms: str = WORDS, keep_all: bool = True) -> str:
    """Common tables {tag} (country, q_id, p_id, score, rank) of one block, from the tables named."""
    where = f"WHERE {b.pool_filter}" if b.pool_filter else ""
    most = f"CASE WHEN n > {b.small_pool} THEN n * {b.max_df} ELSE n END"
    t = terms.format(c=b.text)
    kept = "QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY country)" if keep_all else "WHERE keep"
    return f"""{tag}_pt AS (SELECT country, entity_id AS id, unnest({t}) AS term FROM {pool} {where}),
{tag}_pc AS (SELECT country, id, term, count(*) AS tf FROM {tag}_pt GROUP BY ALL),
{tag}_qc AS (SELECT country, id, term, count(*) AS tf FROM (SELECT country, entity_id AS id, unnest({t}) AS term FROM {queries}) GROUP BY ALL),
{tag}_n AS (SELECT country, count(*) AS n FROM {pool} {where} GROUP BY 1),
{tag}_df AS (SELECT country, term, df, n, df >= least({b.min_df}, n) AND df <= {most} AS keep FROM (SELECT country, term, count(*) AS df FROM {tag}_pc GROUP BY ALL) JOIN {tag}_n USING (country)),
{tag}_idf AS (SELECT country, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM {tag}_df {kept}),
{tag}_pw AS (SELECT country, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY country, id)) AS w FROM (SELECT country, id, term, (1 + ln(tf)) * idf AS w FROM {tag}_pc JOIN {tag}_idf USING (country, term))),
{tag}_qw AS (SELECT country, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY country, id)) AS w FROM (SELECT country, id, term, (1 + ln(tf)) * idf AS w FROM {tag}_qc JOIN {tag}_idf USING (country, term))),
{tag} AS (SELECT * FROM (SELECT country, q_id, p_id, score, CAST(row_number() OVER (PARTITION BY country, q_id ORDER BY score DESC, p_id) AS INTEGER) AS rank FROM (
  SELECT q.country, q.id AS q_id, p.id AS p_id, round(sum(q.w * p.w), 6) AS score FROM {tag}_qw q JOIN {tag}_pw p ON q.country = p.country AND q.term = p.term GROUP BY ALL) WHERE score > {b.min_score}) WHERE rank <= {b.k})"""


SPLIT = """s1 AS (SELECT * FROM prepared WHERE starts_with(entity_id, 'S1-')), pool AS (SELECT * FROM prepared WHERE NOT starts_with(entity_id, 'S1-'))"""
HEAD = f"WITH {RECORDS}, {VIEWS}, {SPLIT}, "
WORD = blocks.block("word")
NAMENUM = blocks.block("namenum")
NOADDR = Block("noaddr", "name", 10, 0.05, pool_filter="addr_empty")
CHAR4_NAMES = Block("name", "name_key", 30, 0.02, min_score=0.01, terms=tfidf.char_grams(4), small_pool=0)


def split(d):
    return d.where(blocks.is_source(1)), d.where(~blocks.is_source(1))


@query(f"{HEAD}{block_sql(WORD, 's1', 'pool', 'b')} SELECT * FROM b")
def tfidf_word_topk(spark, sf_dir):
    return tfidf.top_k(*split(prepared(spark, sf_dir)), WORD)


@query(f"{HEAD}{block_sql(NAMENUM, 's1', 'pool', 'b')} SELECT * FROM b")
def tfidf_namenum_topk(spark, sf_dir):
    return tfidf.top_k(*split(prepared(spark, sf_dir)), NAMENUM)


@query(f"{HEAD}{block_sql(NOADDR, 's1', 'pool', 'b')} SELECT * FROM b")
def tfidf_filtered_pool(spark, sf_dir):
    return tfidf.top_k(*split(prepared(spark, sf_dir)), NOADDR)


@query(f"{HEAD}{block_sql(blocks.ADDR_WORDS, 's1', 'pool', 'b', PAIRS)} SELECT * FROM b")
def tfidf_addr_bigram_topk(spark, sf_dir):
    views = prepared(spark, sf_dir).select("entity_id", "country", "addr")
    return tfidf.top_k(*split(staged(views, "views", compression="zstd")), blocks.ADDR_WORDS)


PART_VIEWS = """prepared AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'S1-' ELSE 'S2-' END || p_partkey AS entity_id, p_brand AS country,
  replace(lower(p_name || ' ' || p_type), ' ', '') AS name_key FROM part)"""


def part_names(spark, sf_dir):
    """Short names: parts with their types, by brand."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.when(F.col("p_partkey") % 3 == 0, "S1-").otherwise("S2-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.col("p_brand").alias("country"),
        F.replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit(" "), F.lit("")).alias("name_key"),
    )


@query(f"WITH {PART_VIEWS}, {SPLIT}, {block_sql(CHAR4_NAMES, 's1', 'pool', 'b', CHAR4, True)} SELECT * FROM b")
def tfidf_char4_topk(spark, sf_dir):
    return tfidf.top_k(*split(part_names(spark, sf_dir)), CHAR4_NAMES)


TRIGRAMS = Block("concat", "concat3", 5, 0.05)
_JOINED = f"regexp_replace(regexp_replace(name, '\\b({text.JOINED_WITHOUT})\\b', ' ', 'g'), '\\s+', '', 'g')"
SHOP_VIEWS = f"""shop AS (SELECT 'S1-' || c_custkey AS entity_id, n_name AS country, lower(replace(c_name, '#', ' ')) AS name FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'S2-' || s_suppkey, n_name, lower(replace(s_name, '#', ' ')) FROM supplier JOIN nation ON n_nationkey = s_nationkey),
prepared AS (SELECT *, array_to_string(list_transform(range(1, greatest(length({_JOINED}) - 2, 1) + 1), lambda i: substring({_JOINED}, i, 3)), ' ') AS concat3 FROM shop)"""


def shops(spark, sf_dir):
    """Customers as source 1 and suppliers as source 2, by nation."""
    nation = table(spark, sf_dir, "nation")
    one = lambda t, s, p: table(spark, sf_dir, t).join(nation, F.col("n_nationkey") == F.col(f"{p}_nationkey")).select(F.concat(F.lit(s), F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}").cast("string")).alias("entity_id"), F.col("n_name").alias("country"), F.lower(F.replace(F.col(f"{p}_name"), F.lit("#"), F.lit(" "))).alias("name"))
    return one("customer", "S1-", "c").unionByName(one("supplier", "S2-", "s")).withColumn("concat3", text.char_trigrams(text.joined_name("name")))


@query(f"WITH {SHOP_VIEWS}, {SPLIT}, {block_sql(TRIGRAMS, 's1', 'pool', 'b')} SELECT * FROM b")
def tfidf_trigram_topk(spark, sf_dir):
    """Small pools (a few suppliers for each nation): the fallbacks of the fit are in use."""
    return tfidf.top_k(*split(shops(spark, sf_dir)), TRIGRAMS)


EVAL = Block("eval", "text", 50, 0.01)


@query(f"{HEAD}{block_sql(EVAL, 's1', 'pool', 'b')} SELECT * FROM b")
def tfidf_eval_pool(spark, sf_dir):
    return tfidf.top_k(*split(prepared(spark, sf_dir)), EVAL)


@query(f"{HEAD}{block_sql(WORD, 's1', 'pool', 'b')} SELECT country, term, round(idf, 6) AS idf FROM b_idf")
def idf_words(spark, sf_dir):
    _, pool = split(prepared(spark, sf_dir))
    p = tfidf.counts(pool, "entity_id", "text", tfidf.words, ["country"])
    return tfidf.idf_table(pool, p, WORD, ["country"]).select("country", "term", r6("idf").alias("idf"))


UNION_SQL = f"""{HEAD}{block_sql(WORD, "s1", "pool", "w")}, {block_sql(NAMENUM, "s1", "pool", "m")}, {block_sql(NOADDR, "s1", "pool", "o")},
u AS (SELECT country, q_id AS s1_id, p_id AS cand_id, 'word' AS block, score, rank FROM w UNION ALL SELECT country, q_id, p_id, 'namenum', score, rank FROM m UNION ALL SELECT country, q_id, p_id, 'noaddr', score, rank FROM o),
pairs AS (SELECT country, s1_id, cand_id, max(score) FILTER (block = 'word') AS s_word, max(rank) FILTER (block = 'word') AS r_word, max(score) FILTER (block = 'namenum') AS s_namenum, max(rank) FILTER (block = 'namenum') AS r_namenum,
  max(score) FILTER (block = 'noaddr') AS s_noaddr, max(rank) FILTER (block = 'noaddr') AS r_noaddr, CAST(count(*) AS INTEGER) AS n_blocks FROM u GROUP BY ALL)"""
UNION_BLOCKS = (WORD, NAMENUM, NOADDR)


def union_pairs(spark, sf_dir):
    q, p = split(staged(prepared(spark, sf_dir), "views"))
    return tfidf.union_blocks({b.name: tfidf.top_k(q, p, b) for b in UNION_BLOCKS}).withColumnsRenamed({"q_id": "s1_id", "p_id": "cand_id"})


@query(f"{UNION_SQL} SELECT * REPLACE (r_word::DOUBLE AS r_word, r_namenum::DOUBLE AS r_namenum, r_noaddr::DOUBLE AS r_noaddr) FROM pairs")
def block_union(spark, sf_dir):
    d = union_pairs(spark, sf_dir)
    return d.withColumns({c: F.col(c).cast("double") for c in ("r_word", "r_namenum", "r_noaddr")})


@query(
    f"""{UNION_SQL}, s AS (SELECT country, s1_id, cand_id, concat_ws('|', CASE WHEN s_word IS NOT NULL THEN 'word' END, CASE WHEN s_namenum IS NOT NULL THEN 'namenum' END, CASE WHEN s_noaddr IS NOT NULL THEN 'noaddr' END) AS sources,
  greatest(s_word, s_namenum, s_noaddr) AS block_score FROM pairs) SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY block_score DESC, cand_id) AS INTEGER) AS block_rank FROM s"""
)
def block_sources(spark, sf_dir):
    return blocks.sources(union_pairs(spark, sf_dir), tuple(b.name for b in UNION_BLOCKS))


REVERSE_SQL = f"""{HEAD}{block_sql(Block("word", "text", 10, 0.01), "pool", "s1", "w")}, {block_sql(Block("namenum", "namenum", 10, 0.05), "pool", "s1", "m")},
u AS (SELECT country, q_id AS rec_id, p_id AS s1_id, score AS s_word, NULL AS s_namenum FROM w UNION ALL SELECT country, q_id, p_id, NULL, score FROM m),
g AS (SELECT country, rec_id, s1_id, max(s_word) AS s_word, max(s_namenum) AS s_namenum, greatest(max(s_word), max(s_namenum)) AS score FROM u GROUP BY ALL),
rev AS (SELECT * FROM (SELECT country, rec_id, s1_id, score, s_word, s_namenum, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, s1_id) AS INTEGER) AS rank FROM g) WHERE rank <= 10)"""


@query(f"{REVERSE_SQL} SELECT * FROM rev")
def reverse_topk(spark, sf_dir):
    return blocks.reverse_search(prepared(spark, sf_dir))


@query(
    f"""{HEAD}{block_sql(WORD, "s1", "pool", "w")}, {block_sql(NAMENUM, "s1", "pool", "m")},
x AS (SELECT w.country, w.q_id, w.p_id, round(sum(q.w * p.w), 6) AS c FROM w JOIN m_qw q ON q.id = w.q_id AND q.country = w.country JOIN m_pw p ON p.id = w.p_id AND p.country = w.country AND p.term = q.term GROUP BY ALL)
SELECT w.country, w.q_id, w.p_id, w.score, coalesce(c, 0.0) AS cosine FROM w LEFT JOIN x USING (country, q_id, p_id)"""
)
def pair_cosine(spark, sf_dir):
    """The pairs of one block with their exact cosine under another."""
    q, p = split(prepared(spark, sf_dir))
    return tfidf.pair_cosine(tfidf.top_k(q, p, WORD).drop("rank"), q, p, NAMENUM)


#: The oracle's own copy of how each block retrieves.
_ALL = (
    Block("word", "text", 20, 0.01), Block("skel", "skel", 20, 0.01), Block("noaddr", "skel_name", 10, 0.05, pool_filter="addr_empty"),
    Block("namenum", "namenum", 10, 0.05), Block("concat", "concat3", 5, 0.05, pool_filter="domainlike"), Block("namehouse", "namehouse", 5, 0.05),
)


def blocks_sql(names: tuple[str, ...], queries: str = "s1", pool: str = "pool") -> str:
    """Common tables that end in pairs, the union of the named blocks on their own views."""
    some = [b for b in _ALL if b.name in names]
    rows = " UNION ALL ".join(f"SELECT country, q_id AS s1_id, p_id AS cand_id, '{b.name}' AS block, score, rank FROM b_{b.name}" for b in some)
    out = ", ".join(f"max(score) FILTER (block = '{b.name}') AS s_{b.name}, CAST(max(rank) FILTER (block = '{b.name}') AS DOUBLE) AS r_{b.name}" for b in some)
    return f"""{RECORDS}, {BLOCK_VIEWS}, s1 AS (SELECT * FROM prepared WHERE starts_with(entity_id, 'S1-') AND country IS NOT NULL), pool AS (SELECT * FROM prepared WHERE NOT starts_with(entity_id, 'S1-')),
{", ".join(block_sql(b, queries, pool, f"b_{b.name}") for b in some)}, u AS ({rows}), pairs AS (SELECT country, s1_id, cand_id, {out}, CAST(count(*) AS INTEGER) AS n_blocks FROM u GROUP BY ALL)"""


@query(f"WITH {blocks_sql(tuple(b.name for b in _ALL))} SELECT * FROM pairs")
def all_blocks(spark, sf_dir):
    """All six blocks on views with consonant keys and romanised tokens."""
    d = blocks.retrieve(blocks.prepare(records(spark, sf_dir)))
    return d.withColumns({f"r_{b.name}": F.col(f"r_{b.name}").cast("double") for b in blocks.BLOCKS})


TRUTH = """want AS (SELECT DISTINCT a.id AS s1_id, b.id AS cand_id FROM (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS id, lang, lower(text) AS t FROM documents) a
  JOIN (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS id, lang, lower(text) AS t FROM documents) b ON a.lang = b.lang AND a.t = b.t WHERE starts_with(a.id, 'S1-') AND NOT starts_with(b.id, 'S1-')),
truth AS (SELECT s.entity_id AS s1_id, count(cand_id) AS n_true FROM records s LEFT JOIN want ON s1_id = entity_id WHERE starts_with(entity_id, 'S1-') GROUP BY 1)"""


def f05_sql(pred: str) -> str:
    """Common tables per_s1 of predictions (s1_id, cand_id) against want and truth."""
    return f"""got AS (SELECT p.s1_id, count(*) AS n_cand, count(w.cand_id) AS tp FROM (SELECT DISTINCT s1_id, cand_id FROM {pred}) p LEFT JOIN want w ON w.s1_id = p.s1_id AND w.cand_id = p.cand_id GROUP BY 1),
per_s1 AS (SELECT t.s1_id, n_true, coalesce(n_cand, 0) AS n_cand, coalesce(tp, 0) AS tp FROM truth t LEFT JOIN got USING (s1_id)),
f AS (SELECT *, CASE WHEN n_true = 0 THEN CAST(n_cand = 0 AS DOUBLE) WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_cand) * (tp / n_true) / (0.25 * (tp / n_cand) + tp / n_true) END AS f05,
  CASE WHEN n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_true) / (0.25 + tp / n_true) END AS oracle FROM per_s1)"""


@query(f"{HEAD}{TRUTH}, {block_sql(WORD, 's1', 'pool', 'b')}, pred AS (SELECT q_id AS s1_id, p_id AS cand_id FROM b WHERE rank <= 5 AND score >= 0.9), {f05_sql('pred')} SELECT round(avg(f05), 6) AS macro_f05, round(avg(oracle), 6) AS oracle, count(*) AS n_s1 FROM f")
def retrieval_f05(spark, sf_dir):
    found = tfidf.top_k(*split(prepared(spark, sf_dir)), WORD).where("rank <= 5 and score >= 0.9").select(F.col("q_id").alias("s1_id"), F.col("p_id").alias("cand_id"))
    d = metrics.scores(found, truth(spark, sf_dir)).withColumn("oracle", metrics.oracle(F.col("tp"), F.col("n_true")))
    return d.agg(r6(F.avg("f05")).alias("macro_f05"), r6(F.avg("oracle")).alias("oracle"), F.count("*").alias("n_s1"))
