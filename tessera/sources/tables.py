"""Readers of source tables, truth and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import null_if_empty

SOURCE = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
CANDIDATES = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "candidate_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-parted text with a header, taken literally: quotes are data, no type is guessed, and an
    empty field is null."""
    d = spark.read.option("sep", "\t").option("quote", "").option("escape", "").option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return d.select([null_if_empty(c).alias(c) for c in d.columns])


def source_path(folder: str, split: str, source: int) -> str:
    return f"{folder}/{split}_source{source}.tsv"


def read_source(spark: SparkSession, folder: str, split: str, source: int, country: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """One source table, of one country and some columns if asked; both reach the scan."""
    d = read_tsv(spark, source_path(folder, split, source), SOURCE)
    if country is not None:
        d = d.where(F.col("country") == country)
    return d.select(*columns) if columns else d


def records(d: DataFrame) -> DataFrame:
    """A source table under the names that the operators use."""
    return d.select("entity_id", F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")


def id_list(c: str):
    """A comma list as an array of trimmed ids, blanks left out."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, matched_ids); an empty list means no match."""
    return truth_lists(read_tsv(spark, path, TRUTH))


def truth_lists(d: DataFrame) -> DataFrame:
    return d.select(F.col("source1_entity_id").alias("s1_id"), id_list("matched_entity_ids").alias("matched_ids"))


def read_matches(spark: SparkSession, path: str, schema: T.StructType = TRUTH) -> DataFrame:
    """A result file back as (s1_id, cand_id) pairs."""
    d = read_tsv(spark, path, schema)
    return d.select(F.col(d.columns[0]).alias("s1_id"), F.explode(id_list(d.columns[1])).alias("cand_id"))


def count_rows(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("n"))


def countries(s1: DataFrame) -> DataFrame:
    """Countries of source 1, for reports; the plans never loop over them."""
    return s1.select("country").where("country is not null").distinct()
