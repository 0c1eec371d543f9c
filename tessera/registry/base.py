"""How queries are registered, and the tables that several of them share.

A record of the linkage is made of a document: its first line is the name, all that follows the
address, its language the country, and its id says which of three sources it belongs to. The truth
pairs source-1 records with records of the other sources that have the same text but for case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that says the same if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    """A double at six digits, so that sums in another order give the same value."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    cut = F.instr("text", "\n")
    return d.select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise(F.col("text")).alias("name"),
        F.when(cut > 0, F.substring("text", cut + 1, F.char_length("text"))).otherwise("").alias("address"),
        F.col("lang").alias("country"),
    )


RECORDS = """records AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || doc_id AS entity_id,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substring(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS name,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substring(text, strpos(text, chr(10)) + 1) ELSE '' END AS address,
  lang AS country FROM documents)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, matched_ids): all source-1 records, with the records of equal text and language."""
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("id"), "lang", F.lower("text").alias("t")
    )
    s1 = d.where(F.col("id").startswith("S1-")).select(F.col("id").alias("s1_id"), "lang", "t")
    rest = d.where(~F.col("id").startswith("S1-")).select(F.col("id").alias("cand_id"), "lang", "t")
    lists = s1.join(rest, ["lang", "t"]).groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("matched_ids"))
    return s1.select("s1_id").join(lists, "s1_id", "left").select("s1_id", F.coalesce("matched_ids", F.array().cast("array<string>")).alias("matched_ids"))


# Scored pairs for decisions and metrics: an order is a record, its parts are the candidates, the
# quantity of a part is its probability; returned parts are the true matches.


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S1-"), F.col("l_orderkey").cast("string")).alias("s1_id"),
        F.concat(F.lit("S"), (F.col("l_partkey") % 2 + 2).cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("cand_id"),
        F.round(F.col("l_quantity") / 50, 6).alias("prob"),
        F.round(F.col("l_tax") * 12.5, 6).alias("name_ts"),
        F.round(F.col("l_discount") * 10, 6).alias("addr_ts"),
        (F.pmod("l_suppkey", F.lit(3)) - 1).cast("int").alias("house_sign"),
        F.col("l_linestatus").alias("country"),
    )
    return d.groupBy("s1_id", "cand_id").agg(F.max("prob").alias("prob"), F.max("name_ts").alias("name_ts"), F.max("addr_ts").alias("addr_ts"), F.max("house_sign").alias("house_sign"), F.min("country").alias("country"))


SCORED = """scored AS (SELECT 'S1-' || l_orderkey AS s1_id, 'S' || (l_partkey % 2 + 2) || '-' || l_partkey AS cand_id,
  max(round(l_quantity / 50, 6)) AS prob, max(round(l_tax * 12.5, 6)) AS name_ts, max(round(l_discount * 10, 6)) AS addr_ts,
  max(CAST(l_suppkey % 3 - 1 AS INTEGER)) AS house_sign, min(l_linestatus) AS country FROM lineitem GROUP BY 1, 2)"""


def order_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, matched_ids) for every order; parts returned in it."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("s1_id"))
    d = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    d = d.groupBy(F.concat(F.lit("S1-"), F.col("l_orderkey").cast("string")).alias("s1_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("S"), (F.col("l_partkey") % 2 + 2).cast("string"), F.lit("-"), F.col("l_partkey").cast("string")))).alias("matched_ids"))
    return o.join(d, "s1_id", "left").select("s1_id", F.coalesce("matched_ids", F.array().cast("array<string>")).alias("matched_ids"))


ORDER_TRUTH = """want AS (SELECT DISTINCT 'S1-' || l_orderkey AS s1_id, 'S' || (l_partkey % 2 + 2) || '-' || l_partkey AS cand_id
  FROM lineitem WHERE l_returnflag = 'R'),
truth AS (SELECT o.s1_id, count(w.cand_id) AS n_true FROM (SELECT 'S1-' || o_orderkey AS s1_id FROM orders) o LEFT JOIN want w USING (s1_id) GROUP BY 1)"""


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def sql_values(rows: list[tuple], name: str, columns: str) -> str:
    """A VALUES list as a common table, for oracles."""

    def one(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII text in SQL, by the table of its polynomial."""
    table = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
    return f"list_transform([{table}], lambda crc: xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295), 4294967295))[1]"
