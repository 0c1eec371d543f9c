"""Normalisation of records: the plan that turns raw names and addresses into the fields that
retrieval and matching read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import address, names, scripts

COLUMNS = ("entity_id", "country", "name_raw", "address_raw", "name_norm", "name_core", "legal_suffix", "name_latin", "addr_norm", "postcode", "city", "house_no", "script")


def normalize(records: DataFrame, token_map: DataFrame | None = None) -> DataFrame:
    """records (entity_id, name, address[, country]) with the thirteen normalised columns, all
    strings. token_map (tok, new) holds learned Latin forms of Devanagari tokens."""
    for c in ("entity_id", "name", "address"):
        if c not in records.columns:
            raise ValueError(f"column {c!r} is missing")
    country = F.col("country") if "country" in records.columns else F.lit("")
    d = records.select(F.col("entity_id").cast("string").alias("entity_id"), country.cast("string").alias("country"), F.col("name").cast("string").alias("name_raw"), F.col("address").cast("string").alias("address_raw"))
    d = d.withColumns({"name_norm": names.normalize_name("name_raw"), "addr_norm": address.normalize_address("address_raw", "country"), "script": scripts.script("name_raw")})
    core, form = names.split_legal("name_norm", "country")
    d = d.withColumns({"name_core": core, "legal_suffix": form})
    code, city, house = address.address_fields("address_raw", "country")
    d = d.withColumns({"postcode": code, "city": city, "house_no": house})
    devanagari = F.col("script") == "devanagari"
    d = d.withColumn("name_latin", F.when(devanagari, F.col("name_core")))
    if token_map is not None:
        d = scripts.with_known_tokens(d, "name_latin", token_map)
    return d.withColumn("name_latin", F.when(devanagari, scripts.transliterate("name_latin")).otherwise(scripts.latin_core("name_core", "script"))).select(*COLUMNS)


def learn_token_map(pairs: DataFrame, of: str, to: str, min_votes: int = 1, min_share: float = 0.6, differ: bool = False) -> DataFrame:
    """(tok, new): for each token of column `of`, its most frequent partner at the same place in
    column `to`, over pairs of texts with as many tokens, if it has the votes and the share; of
    equals the first in the alphabet."""
    split = lambda c: F.filter(F.split(F.col(c), r"(?U)\s+"), lambda t: t != "")
    d = pairs.select(split(of).alias("a"), split(to).alias("b")).where((F.size("a") == F.size("b")) & (F.size("a") > 0))
    votes = d.select(F.inline(F.arrays_zip("a", "b"))).select(F.col("a").alias("tok"), F.col("b").alias("new"))
    if differ:
        votes = votes.where("tok <> new")
    n = votes.groupBy("tok", "new").agg(F.count("*").alias("v"))
    w = Window.partitionBy("tok")
    d = n.withColumns({"_all": F.sum("v").over(w), "_n": F.row_number().over(w.orderBy(F.desc("v"), "new"))})
    return d.where((F.col("_n") == 1) & (F.col("v") >= min_votes) & (F.col("v") >= min_share * F.col("_all"))).select("tok", "new", F.col("v").alias("votes"), F.round(F.col("v") / F.col("_all"), 6).alias("share"))


def kept_token_map(spark: SparkSession, path: str, learn: Callable[[], DataFrame]) -> DataFrame:
    """The token map kept at a path, learned and written there if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        learn().write.parquet(path)
    return spark.read.parquet(path)


def devanagari_pairs(norm: DataFrame, truth_pairs: DataFrame) -> DataFrame:
    """(latin_name, dev_name) of true pairs of a Latin S1 and a Devanagari record."""
    a = norm.where("script = 'latin'").select(F.col("entity_id").alias("s1_id"), F.col("name_norm").alias("latin_name"))
    b = norm.where("script = 'devanagari'").select(F.col("entity_id").alias("cand_id"), F.col("name_norm").alias("dev_name"))
    return truth_pairs.join(a, "s1_id").join(b, "cand_id").select("latin_name", "dev_name")
