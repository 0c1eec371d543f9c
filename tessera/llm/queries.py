"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embed, html, langid, packing, quality, simhash, suffix, tokcount, tokenbin
from .common import fold, table

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed vocabulary files of public tokenizers are."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.encode_table(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2)


def token_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): ids of each text, as op4_token_bin writes them, with the end id."""
    return tokenbin.lengths(docs, vocabulary_path())


def op5_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(token_lengths(table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_pu, op2_simhash_dedup, op3_decontaminate, op4_token_bin, op5_best_fit_pack, op6_suffix_dedup, op7_embedding_dedup, op8_html_text, op9_language_id, op10_token_counts)
}

#: Hashing, suffix arrays, models and tokenizers are beyond the oracle's SQL; these queries are
#: tested against brute force, exact round trips or held-out accuracy instead (tests/llm).
ORACLES: dict[str, str] = {}
