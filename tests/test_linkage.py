"""Decisions, metrics, features, records, files and models on small tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import decide, features, metrics, models, records, reports
from tessera.plans import linkage
from tessera.sources import outputs, tables
from tessera.streaming import incremental


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame([("S1-1", ["S2-1", "S3-1"]), ("S1-2", ["S2-2"]), ("S1-3", []), ("S1-4", ["S2-4", "S2-5", "S3-4"])], "s1_id string, matched_ids array<string>")


@pytest.fixture(scope="module")
def cands(spark):
    rows = [("S1-1", "S2-1", 0.9), ("S1-1", "S3-9", 0.5), ("S1-2", "S2-2", 0.4), ("S1-2", "S2-1", 0.4), ("S1-3", "S2-7", 0.3), ("S1-4", "S2-4", 0.8), ("S1-4", "S3-4", 0.75), ("S1-9", "S2-1", 0.99), ("S1-1", "S2-1", 0.9)]
    return spark.createDataFrame(rows, "s1_id string, cand_id string, prob double")


def scores(truth, pred):
    return {r["s1_id"]: round(r["f05"], 6) for r in metrics.scores(pred, truth).collect()}


def test_f05(spark, truth, cands):
    got = scores(truth, cands)
    p, r = 1 / 2, 1 / 2
    assert got["S1-1"] == round(1.25 * p * r / (0.25 * p + r), 6)
    assert got["S1-3"] == 0 and set(got) == {"S1-1", "S1-2", "S1-3", "S1-4"}
    assert scores(truth, cands.limit(0)) == {"S1-1": 0, "S1-2": 0, "S1-3": 1, "S1-4": 0}
    perfect = metrics.pairs_of(truth)
    assert metrics.macro_f05(perfect, truth).first()["macro_f05"] == 1
    assert {tuple(r) for r in metrics.lists_of(perfect).select("s1_id", F.size("matched_ids")).collect()} == {("S1-1", 2), ("S1-2", 1), ("S1-4", 3)}


def test_blocking_report(spark, truth, cands):
    pool = spark.createDataFrame([(100,)], "pool_size long")
    r = metrics.blocking_total(cands, truth, pool).first()
    assert (r["n_s1"], r["total_pairs"], r["dup_pairs"], r["ignored_pairs"], r["s1_zero_cands"], r["max_cands"]) == (4, 7, 1, 1, 0, 2)
    assert abs(r["pair_recall"] - 4 / 6) < 1e-9 and abs(r["reduction_ratio"] - (1 - 7 / 400)) < 1e-12
    by = {x["src"]: x for x in metrics.blocking_by_source(cands, truth).collect()}
    assert by["S2"]["tp"] == 3 and by["S3"]["n_true"] == 2


def test_cutoffs(spark, truth, cands):
    c = decide.ranked(cands.distinct()).withColumn("block_score", F.col("prob"))
    t = {r["cutoff"]: r for r in metrics.tradeoff(c, truth, (("all", None), ("topk", 1), ("gap", 0.1))).collect()}
    assert t["all"]["total_pairs"] == 7 and t["topk=1"]["total_pairs"] == 4 and t["gap=0.1"]["total_pairs"] == 6
    assert decide.cutoff(c, "topk", 1).count() == 5
    with pytest.raises(ValueError):
        decide.cutoff(c, "none")
    kept = decide.adaptive_cutoff(cands.distinct(), 1, 0.5, 0.9, 3)
    assert kept.where("s1_id = 'S1-4'").count() == 2 and kept.where("s1_id = 'S1-1'").count() == 1


def test_decide(spark, cands):
    d = cands.distinct()
    assert decide.decide(d, 0.95, 0.35).where("s1_id = 'S1-2'").count() == 2  # a tie admits both
    ex = decide.decide(d, 0.35, 0.35, True)
    assert ex.count() == ex.select("cand_id").distinct().count()
    assert ex.where("cand_id = 'S2-1'").first()["s1_id"] == "S1-9"
    assert decide.decide(d.withColumn("country", F.lit("US")), decide.country_threshold(0.9, {"US": 1.1}), 2.0).count() == 0


def test_grid_matches_single_scores(spark, truth, cands):
    d = cands.distinct()
    grid = {(r["t"], r["t1"]): r["macro_f05"] for r in metrics.threshold_grid(d, truth, [0.5, 0.9], [0.3, 0.5]).collect()}
    assert len(grid) == 4
    for (t, u), f in grid.items():
        assert abs(metrics.macro_f05(decide.decide(d, t, u), truth).first()["macro_f05"] - f) < 1e-9
    assert models.tune(d, truth, [0.5, 0.9], [0.3, 0.5])[0] == max(grid.values())
    plain = {(r["t"], r["t1"]): r["macro_f05"] for r in models.tune_weighted(d, truth, d.select("cand_id"), 1.6, [0.5, 0.9], [0.3, 0.5]).collect()}
    assert all(abs(plain[k] - grid[k]) < 1e-9 for k in grid)  # all records are owned


def test_auc_and_prior(spark):
    d = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "p double, y int")
    assert metrics.auc(d, "p", "y").first()["auc"] == (2 + 1.5) / 4
    one_class = metrics.auc(d.where("y = 1"), "p", "y").first()
    assert one_class["auc"] is None
    q = spark.createDataFrame([(x,) for x in [0.9] * 80 + [0.1] * 20], "p double")
    assert metrics.prior_shift(q, "p", 0.5) > 0.8
    assert metrics.prior_shift(q.limit(0), "p", 0.3) == 0.3


def test_pareto(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.4), ("c", 3, 0.6), ("d", 3, 0.6)], "n string, cost int, gain double")
    assert {r["n"] for r in decide.pareto_front(d, "cost", "gain").collect()} == {"a", "c"}


def test_house_features(spark):
    rows = [("100", "10", ["100"], ["10"]), ("", "10", [], ["10"]), ("7", "7", ["7"], ["7", "8"]), ("229", "555", ["229"], ["555"])]
    d = spark.createDataFrame(rows, "q_house string, p_house string, q_nums array<string>, p_nums array<string>").withColumns({"q_house_full": F.col("q_house"), "p_house_full": F.lit(None).cast("string"), "q_pin": F.lit("1"), "p_pin": F.lit("1")})
    got = [tuple(r) for r in d.select(*[c.alias(n) for n, c in (features.house_features() | features.number_features()).items()]).select("house_eq", "house_tol", "house_lev", "house_full_eq", "pin_eq", "num_jacc", "num_p_only").collect()]
    assert got == [(-1, 0.5, 1, 0, 1, 0.0, 1), (0, 0.0, None, 0, 1, 0.0, 1), (1, 1.0, 0, 0, 1, 0.5, 1), (-1, -1.0, 3, 0, 1, 0.0, 1)]


RECORDS = [
    ("S1-1", "Acme Trading Pvt Ltd", "12 Main Road, Pune, Maharashtra", "india"), ("S1-2", "Blue Boat Company", "7 Lake Road, Delhi", "india"), ("S1-3", "Sunrise Motors", "100 Hill Street, Mumbai", "india"),
    ("S2-1", "Acme Trading Private Limited", "12 Main Rd, Pune", "india"), ("S3-1", "ACME TRADING", "12, Main Road, Pune, Maharashtra", "india"), ("S2-2", "Blue Boat Co", "7 Lake Rd, Delhi", "india"),
    ("S3-2", "Red Boat Company", "9 Lake Road, Delhi", "india"), ("S2-3", "Sunrise Motars", "10 Hill Street, Mumbai", "india"), ("S3-9", None, None, "india"),
]


def test_pair_and_list_features(spark):
    from tessera.operators.blocks import is_source
    d = spark.createDataFrame(RECORDS, "entity_id string, name string, address string, country string")
    match = linkage.match_table(d)
    assert match.count() == len(RECORDS)
    q, p = match.where(is_source(1)), match.where(~is_source(1))
    pairs = features.retrieve_pairs(q, p)
    f = features.pair_features(pairs, q, p)
    assert set(features.PAIR) <= set(f.columns) and f.count() == pairs.count()
    best = f.where("s1_id = 'S1-1' and cand_id = 'S3-1'").first()
    assert best["name_ratio"] == 1 and best["house_eq"] == 1
    c = features.select_candidates(f.withColumn("prune_prob", F.col("name_ratio")), 3, 0.0)
    out = features.sibling_features(features.list_features(c), match)
    assert out.count() == c.count() and {*features.LISTWISE, *features.SIBLING} <= set(out.columns)
    with pytest.raises(ValueError):
        features.extra_features(out, None, None)
    assert set(features.EXTRA) <= set(features.extra_features(out, None, None, True).columns)
    assert len(features.final_features(linkage.ALL_BLOCKS)) == len(set(features.final_features(linkage.ALL_BLOCKS))) == 85


def test_record_frames(spark):
    d = spark.createDataFrame(RECORDS + [("S2-8", "Acme Trading", "", None)], "entity_id string, name string, address string, country string")
    pool = records.pool_frame(d)
    assert pool.count() == 7
    r = {x["rec_id"]: x for x in pool.collect()}
    assert r["S3-1"]["tok_in_s1_share"] == 1 and r["S3-9"]["name_len"] == 0 and r["S3-9"]["addr_blank"] == 1
    assert records.s1_frame(d).count() == 3
    assert records.drift_table(d).where("side = 's1'").first()["n"] == 3


def test_link_end_to_end(spark):
    rows, want = [], []
    for i in range(24):
        rows += [(f"S1-{i}", f"Shop{i} Alpha{i} Traders", f"{i + 10} Road{i}, Town{i % 5}", "us"), (f"S2-{i}", f"Shop{i} Alpha{i} Trader", f"{i + 10} Road{i}, Town{i % 5}", "us"), (f"S3-{i}", f"Other{i} Beta{i % 3} Traders", f"{i + 50} Lane{i}, Town{i % 5}", "us")]
        want.append((f"S1-{i}", [f"S2-{i}"]))
    d = spark.createDataFrame(rows, "entity_id string, name string, address string, country string")
    t = spark.createDataFrame(want, "s1_id string, matched_ids array<string>")
    out = linkage.link(d, t, linkage.PRESETS["v1"], rounds=2)
    assert out.columns == ["country", "s1_id", "cand_id", "prob"]
    assert metrics.macro_f05(out, t).first()["macro_f05"] > 0.9


def test_equal_records_are_worked_on_once(spark, monkeypatch):
    rows, want = [], []
    for i in range(12):
        rows += [(f"S1-{i}.{j}", f"Shop{i} Alpha{i} Traders", f"{i + 10} Road{i}, Town{i % 5}", "us") for j in range(8)]
        rows += [(f"S2-{i}", f"Shop{i} Alpha{i} Trader", f"{i + 10} Road{i}, Town{i % 5}", "us"), (f"S3-{i}", f"Other{i} Beta{i % 3} Traders", f"{i + 50} Lane{i}, Town{i % 5}", None if i == 3 else "us")]
        want += [(f"S1-{i}.{j}", [f"S2-{i}"]) for j in range(7)]
    tables = {}
    write = linkage.staged
    monkeypatch.setattr(linkage, "staged", lambda df, name, *args, **options: tables.setdefault(name, write(df, name, *args, **options)))
    d = spark.createDataFrame(rows, "entity_id string, name string, address string, country string")
    t = spark.createDataFrame(want, "s1_id string, matched_ids array<string>")
    final = linkage.final_candidates(d, t, rounds=1, depth=2)
    pairs = tables["labelled"]
    # At most two halves of those with a truth, and the one without.
    assert pairs.select("s1_id").distinct().count() <= 12 * 4
    assert pairs.select("s1_id", "n").distinct().agg(F.sum("n")).first()[0] == 12 * 8
    got = final.candidates.groupBy("s1_id").agg(F.sum("y").alias("y"), F.countDistinct("cand_id").alias("n"), F.count("*").alias("all")).collect()
    assert len(got) == 12 * 8 and all(r["n"] == r["all"] for r in got)
    lists = {(r["s1_id"], r["cand_id"]): r["name_ratio"] for r in final.candidates.select("s1_id", "cand_id", "name_ratio").collect()}
    assert all(lists[f"S1-{i}.{j}", f"S2-{i}"] == lists[f"S1-{i}.0", f"S2-{i}"] for i in range(12) for j in range(8))


def test_equal_texts_are_worked_on_once(spark):
    cols = "entity_id string, name string, address string, country string"
    again = [(f"{i}.{j}", *rest) for j in range(3) for i, *rest in RECORDS]
    odd = [("S2-8", "", None, "india"), ("S2-9", None, "", "india"), ("S3-8", "Acme Trading", "", None), ("S1-8", "Acme Trading", "", None)]
    d = spark.createDataFrame(RECORDS + again + odd, cols)
    ids, texts = linkage.same_texts(d)
    assert ids.count() == len(RECORDS) * 4 + 4 and texts.count() == len(RECORDS) + 4
    as_set = lambda d: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.collect())
    assert as_set(linkage.for_all(texts, ids)) == as_set(d)
    match, fields = linkage.match_table(d), linkage.match_table(texts)
    assert as_set(linkage.for_all(fields, ids)) == as_set(match)
    want = linkage.pair_table(d, linkage.PRESETS["v1"], match)
    got = linkage.pair_table(d, linkage.PRESETS["v1"], match, features.Alike(ids, fields))
    assert got.columns == want.columns and want.count() and as_set(got) == as_set(want)


def test_files(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Joe\'s" "Diner\t\tUS\nS1-2\t NA \tx\t\n')
    got = [tuple(r) for r in tables.read_tsv(spark, str(p), tables.SOURCE).collect()]
    assert got == [("S1-1", '"Joe\'s" "Diner', None, "US"), ("S1-2", " NA ", "x", None)]
    t = tmp_path / "t.tsv"
    t.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,,\nS1-2\t\n")
    assert [tuple(r) for r in tables.read_truth(spark, str(t)).collect()] == [("S1-1", ["S2-1", "S3-2"]), ("S1-2", [])]


def test_writer(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-2",), ("S1-1",)], "s1_id string")
    m = spark.createDataFrame([("S1-1", "S2-1", 0.2), ("S1-1", "S3-2", 0.9), ("S1-1", "S2-0", 0.9), ("S1-1", "S2-1", 0.1)], "s1_id string, cand_id string, prob double")
    outputs.write_outputs(m, m, s1, str(tmp_path))
    text = next((tmp_path / "matching_results").glob("part-*.csv")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-0,S3-2,S2-1\nS1-2\t\n"
    with pytest.raises(ValueError, match="candidates"):
        outputs.write_outputs(m, m.where("cand_id = 'S2-1'"), s1, str(tmp_path))
    with pytest.raises(ValueError, match="not in the list"):
        outputs.checked_id_lists(m, s1.where("s1_id = 'S1-2'"), "x")
    with pytest.raises(ValueError, match="clean"):
        outputs.checked_id_lists(m.withColumn("cand_id", F.lit("S1-1")), s1, "x")
    with pytest.raises(ValueError, match="repeated"):
        outputs.checked_id_lists(m, s1.union(s1), "x")


def test_validator(spark):
    lists = spark.createDataFrame([("S1-1", ["S2-1", "S2-1", "S1-4", "X"]), ("S1-1", []), ("S1-7", ["S3-9"])], "s1_id string, ids array<string>")
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    got = {r["rule"]: (r["n"], r["example"]) for r in outputs.validate(lists, required, known, lists.limit(0)).collect()}
    assert got["repeated row"] == (1, "S1-1") and got["self match"] == (1, "S1-4") and got["wrong prefix"] == (1, "X")
    assert got["required S1 missing"] == (1, "S1-2") and got["unknown S1"] == (1, "S1-7") and got["unknown id"] == (1, "S3-9") and got["match is no candidate"][0] == 2


def test_models(spark):
    rows = [(f"S1-{i}", float(i % 7), None if i % 5 == 0 else float(i % 3), int(i % 7 > 3)) for i in range(200)]
    d = spark.createDataFrame(rows, "s1_id string, a double, b double, y int")
    out = models.out_of_fold(d, ["a", "b"], "s1_id", 2, rounds=2, depth=2)
    assert out.count() == 200 and metrics.auc(out, "prob", "y").first()["auc"] > 0.95
    fit = models.fit_trees(d, ["a", "b"], rounds=2, depth=2)
    assert models.importance(fit, ["a", "b"])[0][0] == "a"
    assert models.sample_by(d.withColumn("c", F.lit("x")), "s1_id", "c", 7).count() == 7


def test_reports(spark, truth, cands):
    d = cands.distinct()
    kinds = {r["kind"]: r["n"] for r in reports.error_parts(d.where("prob > 0.7"), d.where("prob > 0.45"), d, truth).collect()}
    assert kinds == {"found": 3, "pruner cut": 1, "retrieval missed": 2, "false positive": 1}
    assert sum(r["n_s1"] for r in reports.outcomes(d, truth).collect()) == 4
    ids = spark.createDataFrame([("S1-1",), ("S2-1",)], "entity_id string")
    assert {r["rule"]: r["n"] for r in reports.integrity(truth, ids).collect()}["match not among the records"] == 5


def test_stream(spark, tmp_path):
    cols = "entity_id string, name string, address string, country string"
    d = spark.createDataFrame(RECORDS, cols)
    d.where("not startswith(entity_id, 'S1-')").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
    q = incremental.link_stream(stream, d.where("startswith(entity_id, 'S1-')"), str(tmp_path / "out"), str(tmp_path / "cp"), 2)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    best = {r["q_id"]: r["p_id"] for r in out.where("rank = 1").collect()}
    assert best["S3-1"] == "S1-1"
