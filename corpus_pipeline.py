"""The corpus pipeline: quality filter, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage works on all that its predecessor kept and is written as Parquet in the folder that the
cluster shares (spark.checkpoint.dir), so a lost executor never costs more than its stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, nearcopies, packing, quality, suffix
from tessera.llm.common import staged, table
from tessera.llm.queries import token_lengths


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts.

    Null and empty texts are scored like any other; every row is judged by its own text, so repeated
    rows, and rows of one id or of a null id, stay or go by themselves. No rows give no rows; all
    columns stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 (five-word shingles) connect: the one
    with the smallest id.

    Documents are told apart by id and words, so rows of one id, or of a null id, that are in
    different groups all stay. Null ids come after all others; of a group with null ids only, one row
    stays. Texts without words (null, empty) are one group. No rows give no rows; all columns stay."""
    node, stay, kept = (_free(docs, x) for x in ("node", "stay", "kept"))
    roots = nearcopies.components(docs).select(F.col("node").alias(node), "root")
    named = staged(nearcopies.marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), node), "nodes")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(node).alias("node"))
    least = named.groupBy(node).agg(F.min(rank).alias("least"))
    lowest = least.join(roots, node, "left").groupBy(F.coalesce("root", node).alias("root")).agg(F.min("least").alias("least"))
    chosen = lowest.select(F.col("least.doc_id").alias(stay), F.col("least.node").alias(kept))
    rows = nearcopies.marked(docs, node)
    one = rows.join(chosen, F.expr(f"{node} = {kept} and cast(doc_id as bigint) <=> {stay}"), "left_semi")
    return one.dropDuplicates(["doc_id", node]).drop(node)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that occur more than once.

    All rows stay, with what is left of their texts; null texts stay null. Ids play no part, so they
    may be null or repeat. No rows give no rows; all columns stay, n_chars is counted anew."""
    return suffix.cut(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item.

    Null and empty texts match nothing and stay; every row is judged by its own text, whatever its id.
    No rows, or an empty benchmark, change nothing; all columns stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the packed sequences; lengths are those of the ids that
    the token files hold, with the end id.

    A null or empty text is one id, the end; rows of one id or of a null id are packed as rows of their
    own; no rows give no rows."""
    return packing.pack(token_lengths(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("simhash", near_dedup),
    ("suffix", passage_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Models, fingerprints and suffix arrays are beyond SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
