"""Writers of result files with their guards, and the validator of such files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLEAN_ID = r"^S[23]-[^\t,]+$"


def ensure(bad: DataFrame, what: str) -> None:
    """Raise if a table has rows; five of them are named."""
    some = [list(r) for r in bad.limit(5).collect()]
    if some:
        raise ValueError(f"{what}, e.g. {some}")


def id_lists(pairs: DataFrame, s1: DataFrame, name: str, order_by: str | None = None, descending: bool = False) -> DataFrame:
    """(source1_entity_id, <name>): for every S1 its distinct candidates joined by commas, in the
    order of order_by and then the id; an S1 without any has an empty list."""
    p = pairs.where("cand_id is not null")
    if order_by is None:
        best = p.groupBy("s1_id", "cand_id").agg(F.lit(0).alias("_o"))
    else:
        first = (F.max if descending else F.min)(order_by)
        best = p.groupBy("s1_id", "cand_id").agg((-first if descending else first).alias("_o"))
    lists = best.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "cand_id"))), lambda x: x["cand_id"]), ",").alias(name))
    return s1.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def checked_id_lists(pairs: DataFrame, s1: DataFrame, name: str, order_by: str | None = None, descending: bool = False) -> DataFrame:
    """id_lists after its guards: S1 once each, clean ids, no pair of an unknown S1."""
    ensure(s1.groupBy("s1_id").count().where("count > 1"), "s1 ids are repeated")
    p = pairs.where("cand_id is not null")
    ensure(p.where(~F.col("cand_id").rlike(CLEAN_ID)).select("cand_id"), "ids are not clean S2- or S3- ids")
    ensure(p.join(s1, "s1_id", "left_anti").select("s1_id").distinct(), "S1 ids are not in the list")
    return id_lists(pairs, s1, name, order_by, descending)


def write_tsv(d: DataFrame, path: str, one_file: bool = True) -> None:
    """Tab-parted text with a header, taken literally."""
    d = d.coalesce(1) if one_file else d
    d.write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").option("nullValue", "").option("header", True).csv(path)


def write_outputs(matches: DataFrame, cands: DataFrame, s1: DataFrame, folder: str) -> None:
    """Both result files, once it is sure that every match is a candidate."""
    missing = matches.where("cand_id is not null").select("s1_id", "cand_id").join(cands.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    ensure(missing, "matched pairs are not candidates")
    by = "prob" if "prob" in matches.columns else None
    rank = "block_rank" if "block_rank" in cands.columns else None
    write_tsv(checked_id_lists(matches, s1, "matched_entity_ids", by, True).orderBy("source1_entity_id"), f"{folder}/matching_results")
    write_tsv(checked_id_lists(cands, s1, "candidate_entity_ids", rank).orderBy("source1_entity_id"), f"{folder}/candidate_pairs")


def write_table(d: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet, zstd, replaced as a whole; by country (say) where readers prune by it."""
    w = d.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def validate(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """(rule, severity, n, example): the findings on id lists (s1_id, ids array<string>). required is
    (s1_id); known, if given, all valid ids (entity_id); others, the lists of candidates that matches
    should come from."""
    ids = lists.select("s1_id", F.explode("ids").alias("id"))
    found = [
        ("repeated row", "error", lists.groupBy("s1_id").count().where("count > 1").select(F.col("s1_id").alias("x"))),
        ("repeated id in a list", "error", lists.where(F.size("ids") > F.size(F.array_distinct("ids"))).select(F.col("s1_id").alias("x"))),
        ("self match", "error", ids.where(F.col("id").startswith("S1-")).select(F.col("id").alias("x")).distinct()),
        ("wrong prefix", "error", ids.where(~F.col("id").rlike("^S[123]-")).select(F.col("id").alias("x")).distinct()),
        ("required S1 missing", "error", required.select("s1_id").distinct().join(lists, "s1_id", "left_anti").select(F.col("s1_id").alias("x"))),
        ("unknown S1", "error", lists.select("s1_id").distinct().join(required, "s1_id", "left_anti").select(F.col("s1_id").alias("x"))),
    ]
    if known is not None:
        right = ids.where(F.col("id").rlike("^S[23]-")).select("id").distinct()
        found.append(("unknown id", "error", right.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti").select(F.col("id").alias("x"))))
    if others is not None:
        theirs = others.select("s1_id", F.explode("ids").alias("id"))
        found.append(("match is no candidate", "warning", ids.join(theirs, ["s1_id", "id"], "left_anti").select(F.col("s1_id").alias("x")).distinct()))
    out = None
    for name, severity, d in found:
        one = d.agg(F.count("*").alias("n"), F.min("x").alias("example")).select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "n", "example")
        out = one if out is None else out.unionByName(one)
    return out


def duplicates(d: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return d.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_by_hash(d: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of the key."""
    return d.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def expanded(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row on a join that should add no rows: rows before and after it, and keys that it repeated."""
    n = before.agg(F.count("*").alias("rows_before"))
    m = after.agg(F.count("*").alias("rows_after"))
    again = after.groupBy(*keys).agg(F.count("*").alias("a")).join(before.groupBy(*keys).agg(F.count("*").alias("b")), keys, "left").agg(F.count_if(F.col("a") > F.coalesce("b", F.lit(0))).alias("keys_repeated"))
    return n.crossJoin(m).crossJoin(again)  # one row each


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join that is refused if it would add rows to the left side."""
    again = duplicates(right, keys)
    if not again.isEmpty():
        raise ValueError(f"the right side repeats {keys}: {again.first().asDict()}")
    return left.join(right, keys, how)


def write_json(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def markdown(table: DataFrame, order: list[str], digits: int = 4) -> DataFrame:
    """(line, text): a table of results as the lines of a Markdown table, in the order of some columns.
    For tables of a report: a few hundred rows, numbered in one task."""
    cell = lambda c, t: F.format_number(F.col(c), digits) if t in ("double", "float") else F.col(c).cast("string")
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + 2
    body = table.select(number.alias("line"), row([F.coalesce(cell(c, t), F.lit("")) for c, t in table.dtypes]).alias("text"))
    head = table.sparkSession.createDataFrame([(1, "| " + " | ".join(table.columns) + " |"), (2, "|" + "---|" * len(table.columns))], "line int, text string")
    return head.unionByName(body)
