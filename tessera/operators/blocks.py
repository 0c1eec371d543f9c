"""Retrieval blocks of record linkage: the text views, the block list, union and reverse search."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scripts, text
from ..storage import at_once, staged
from .tfidf import Block, char_grams, top_k, union_blocks, word_pairs

#: How each block retrieves.
BLOCKS = (
    Block("word", "text", 20, 0.01),
    Block("skel", "skel", 20, 0.01),
    Block("noaddr", "skel_name", 10, 0.05, pool_filter="addr_empty"),
    Block("namenum", "namenum", 10, 0.05),
    Block("concat", "concat3", 5, 0.05, pool_filter="domainlike"),
    Block("namehouse", "namehouse", 5, 0.05),
)
NAME_CHAR4 = Block("name", "name_key", 30, 0.02, min_score=0.01, terms=char_grams(4), small_pool=0)
ADDR_WORDS = Block("addr", "addr", 30, 0.005, min_score=0.01, terms=word_pairs, small_pool=0)
PLAIN_WORDS = Block("plain", "text", 20, 0.01, small_pool=0)
REVERSE = ("word", "namenum")


def block(name: str) -> Block:
    return next(b for b in BLOCKS if b.name == name)


def prepare(records: DataFrame, token_map: DataFrame | None = None) -> DataFrame:
    """Text views of records (entity_id, name, address, country) for all blocks."""
    d = records.select(
        "entity_id",
        "country",
        text.block_text("name").alias("name"),
        text.block_text("address").alias("addr"),
        text.has_non_latin("name").alias("nonlatin"),
        text.house_tokens("address").alias("house"),
    )
    d = scripts.latinize(scripts.latinize(d, "name", token_map), "addr", token_map)
    joined = text.joined_name("name")
    return d.withColumns(
        {
            "text": F.trim(F.concat_ws(" ", "name", "addr")),
            "addr_empty": F.col("addr") == "",
            "namenum": text.name_numbers("name", "addr"),
            "skel_name": text.skeleton("name"),
            "skel": text.skeleton(F.trim(F.concat_ws(" ", "name", "addr"))),
            "concat3": text.char_trigrams(joined),
            "domainlike": text.domain_like("name"),
            "namehouse": F.trim(F.concat_ws(" ", "name", "house")),
        }
    ).drop("house")


def is_source(n: int):
    return F.col("entity_id").startswith(f"S{n}-")


def retrieve(prepared: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """(country, s1_id, cand_id, s_*, r_*, n_blocks): pairs of source-1 records with records of the
    other sources that any of the named blocks found. Records without a country ask for nothing."""
    prepared = staged(prepared, "views")  # six blocks read it
    queries = prepared.where(is_source(1) & F.col("country").isNotNull())
    pool = prepared.where(~is_source(1))
    some = [b for b in BLOCKS if names is None or b.name in names]
    found = at_once([partial(top_k, queries, pool, b) for b in some])
    return union_blocks({b.name: d for b, d in zip(some, found, strict=True)}).withColumnRenamed("q_id", "s1_id").withColumnRenamed("p_id", "cand_id")


def sources(pairs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Candidates (s1_id, cand_id, sources, block_score, block_rank): blocks that found a pair, its
    best score, and its rank among the pairs of its S1."""
    found = F.concat_ws("|", *[F.when(F.col(f"s_{n}").isNotNull(), n) for n in names])
    scores = [F.col(f"s_{n}") for n in names]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    d = pairs.select("country", "s1_id", "cand_id", found.alias("sources"), best.alias("block_score"))
    return d.withColumn("block_rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("block_score"), "cand_id")))


def reverse_search(prepared: DataFrame, k: int = 10) -> DataFrame:
    """(country, rec_id, s1_id, score, rank, s_word, s_namenum): for each record of the other sources
    its k nearest source-1 records by the better of two blocks fitted on source 1."""
    prepared = staged(prepared, "views")  # two blocks read it
    s1, pool = prepared.where(is_source(1)), prepared.where(~is_source(1))
    found = at_once([partial(top_k, pool, s1, Block(name, block(name).text, k, block(name).max_df)) for name in REVERSE])
    both = union_blocks(dict(zip(REVERSE, found, strict=True)))
    d = both.select("country", F.col("q_id").alias("rec_id"), F.col("p_id").alias("s1_id"), F.greatest("s_word", "s_namenum").alias("score"), "s_word", "s_namenum")
    order = Window.partitionBy("rec_id").orderBy(F.desc("score"), "s1_id")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
