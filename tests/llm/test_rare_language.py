"""A language with few rows is learned, however many rows the others have."""

from pyspark.sql import functions as F

from tessera.llm import langid


def test_quota():
    assert langid.quota([10, 20], 100) == 20 and langid.quota([], 100) == 0
    assert langid.quota([10, 500, 500], 110) == 50
    assert langid.quota([1000] * 50, 100) == langid.LEAST_ROWS


def test_rare_language_is_learned(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") == 1234, "zeldzaam woord").otherwise(F.concat(F.lit("common text "), F.col("id").cast("string"))).alias("text"),
        F.when(F.col("id") == 1234, "nl").when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"),
    )
    assert langid.fit(docs, most=60).names == ["de", "en", "nl"]
