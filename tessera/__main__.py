"""Commands: python -m tessera <command> ...

    normalize  RECORDS OUT [--token-map MAP]     thirteen normalised columns, by country, and a fill report
    token-map  RECORDS TRUTH MAP                 learn Latin forms of Devanagari tokens from true pairs
    summary    RECORDS OUT                       what raw names and addresses look like, as JSON
    candidates RECORDS OUT [--blocks a,b]        candidates of the retrieval blocks
    reverse    RECORDS OUT [--k N]               nearest source-1 records of each other record
    link       RECORDS TRUTH OUT [--preset v3]   decided matches
    evaluate   MATCHES TRUTH OUT                 macro F0.5 and error kinds, as JSON

RECORDS is a Parquet folder (entity_id, name, address, country) or a folder of three tables
<split>_source1.tsv to <split>_source3.tsv, with --split. TRUTH and MATCHES are Parquet folders or
.tsv files. Runs on the session that spark-submit or the environment gives.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession


def read_records(spark: SparkSession, path: str, split: str | None) -> DataFrame:
    from .sources import tables

    if split is None:
        return spark.read.parquet(path)
    parts = [tables.records(tables.read_source(spark, path, split, i)) for i in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    from .sources import tables

    return tables.read_truth(spark, path) if path.endswith(".tsv") else spark.read.parquet(path)


def normalize(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import reports
    from .plans.normalize import normalize as plan
    from .sources import outputs

    known = spark.read.parquet(a.token_map) if a.token_map else None
    outputs.write_table(plan(read_records(spark, a.records, a.split), known), f"{a.out}/records", "country")
    done = spark.read.parquet(f"{a.out}/records")
    outputs.write_json(reports.fill_report(done.select("country", "name_norm", "addr_norm", "script")), f"{a.out}/fill")


def token_map(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import metrics
    from .plans import normalize as plans

    d = plans.normalize(read_records(spark, a.records, a.split))
    pairs = plans.devanagari_pairs(d, metrics.pairs_of(read_truth(spark, a.truth)))
    plans.kept_token_map(spark, a.out, lambda: plans.learn_token_map(pairs, "dev_name", "latin_name"))


def summary(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import reports
    from .sources import outputs

    outputs.write_json(reports.quality_summary(read_records(spark, a.records, a.split)), a.out)


def candidates(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import blocks
    from .plans import linkage
    from .sources import outputs

    names = tuple(a.blocks.split(",")) if a.blocks else linkage.ALL_BLOCKS
    outputs.write_table(linkage.candidates(blocks.prepare(read_records(spark, a.records, a.split)), names), a.out)


def reverse(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import blocks
    from .sources import outputs

    outputs.write_table(blocks.reverse_search(blocks.prepare(read_records(spark, a.records, a.split)), a.k), a.out)


def link(spark: SparkSession, a: argparse.Namespace) -> None:
    from .plans import linkage
    from .sources import outputs

    plan = linkage.link_v3 if a.preset == "v3" else linkage.link
    outputs.write_table(plan(read_records(spark, a.records, a.split), read_truth(spark, a.truth), linkage.PRESETS[a.preset], rounds=a.rounds), a.out)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import metrics, reports
    from .sources import outputs, tables

    pred = tables.read_matches(spark, a.matches) if a.matches.endswith(".tsv") else spark.read.parquet(a.matches)
    truth = read_truth(spark, a.truth)
    outputs.write_json(metrics.macro_f05(pred, truth), f"{a.out}/score")
    outputs.write_json(reports.outcomes(pred, truth), f"{a.out}/outcomes")


COMMANDS = {
    "normalize": (normalize, ["records", "out"]), "token-map": (token_map, ["records", "truth", "out"]), "summary": (summary, ["records", "out"]),
    "candidates": (candidates, ["records", "out"]), "reverse": (reverse, ["records", "out"]), "link": (link, ["records", "truth", "out"]), "evaluate": (evaluate, ["matches", "truth", "out"]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, places) in COMMANDS.items():
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        c.add_argument("--split")
        if name == "normalize":
            c.add_argument("--token-map")
        elif name == "candidates":
            c.add_argument("--blocks")
        elif name == "reverse":
            c.add_argument("--k", type=int, default=10)
        elif name == "link":
            c.add_argument("--preset", default="v3", choices=["v0", "v1", "v2", "v3"])
            c.add_argument("--rounds", type=int, default=20)
    a = p.parse_args(argv)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("tessera").getOrCreate(), a)


if __name__ == "__main__":
    main()
