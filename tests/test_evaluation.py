"""Evaluation reports, checked joins, sinks and the last generation's plan on small tables."""

import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import decide, features, metrics, models, reports
from tessera.plans import linkage, normalize
from tessera.sources import outputs


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame([("S1-1", ["S2-1", "S3-1"]), ("S1-2", ["S2-2"]), ("S1-3", [])], "s1_id string, matched_ids array<string>")


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("S1-1", "S2-1", 0.9), ("S1-1", "S3-9", 0.5), ("S1-2", "S2-2", 0.4), ("S1-2", "S2-1", 0.4), ("S1-3", "S2-7", 0.3)]
    return spark.createDataFrame(rows, "s1_id string, cand_id string, prob double")


def test_thresholds_of_a_country_are_those_of_its_records(spark, truth, scored):
    by = spark.createDataFrame([("S1-1", "a"), ("S1-2", "b"), ("S1-3", "b")], "s1_id string, country string")
    got = {r["country"]: r for r in models.tune_by(scored, truth, by, "country", [0.35, 0.6, 0.9], [0.3, 0.35, 0.6]).collect()}
    for c in ("a", "b"):
        ids = by.where(F.col("country") == c).select("s1_id")
        f, t, u = models.tune(scored.join(ids, "s1_id"), truth.join(ids, "s1_id"), [0.35, 0.6, 0.9], [0.3, 0.35, 0.6])
        assert abs(got[c]["macro_f05"] - f) < 1e-9 and (got[c]["t"], got[c]["t1"]) == (t, u)


def test_rank_hits(spark, truth):
    d = spark.createDataFrame([("S1-1", "S2-1", 1, 6), ("S1-1", "S3-1", 7, 11), ("S1-2", "S2-2", 12, 2), ("S1-2", "S2-9", 1, 1)], "s1_id string, cand_id string, raw_rank int, core_rank int")
    r = reports.rank_hits(d, truth).first()
    assert (r["queries"], r["positive_queries"], r["true_pairs"], r["retrieved_true_pairs"]) == (3, 2, 3, 3)
    assert (r["raw_top5_pairs"], r["raw_top10_pairs"], r["core_top5_pairs"], r["core_top10_pairs"]) == (1, 2, 1, 2)
    assert r["core_wins_top10_queries"] == 1 and r["core_losses_top10_queries"] == 0 and r["core_top10_hit_queries_rate"] == 1


def test_subset_recall(spark, truth, scored):
    sub = spark.createDataFrame([("S2-1",), ("S3-1",)], "cand_id string")
    r = reports.subset_recall(truth, sub, {"all": scored, "top": scored.where("prob > 0.95")}).first()
    assert (r["true_pairs"], r["positive_s1"], r["all_pairs"], r["top_pairs"], r["all_recall"]) == (2, 1, 1, 0, 0.5)


def test_joins_that_must_not_grow(spark):
    left, right = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(1, "x"), (1, "y")]))
    with pytest.raises(ValueError, match="repeats"):
        outputs.checked_join(left, right, ["k"])
    assert outputs.checked_join(left, right.limit(1).withColumnRenamed("v", "w"), ["k"]).count() == 2
    r = outputs.expanded(left, left.join(right.withColumnRenamed("v", "w"), "k", "left"), ["k"]).first()
    assert tuple(r) == (2, 3, 1)


def test_markdown(spark):
    d = spark.createDataFrame([("b", 1, 0.5), ("a", 2, None)], "name string, n int, x double")
    assert [r["text"] for r in outputs.markdown(d, ["name"]).orderBy("line").collect()] == ["| name | n | x |", "|---|---|---|", "| a | 2 |  |", "| b | 1 | 0.5000 |"]


def test_token_map_is_learned_once(spark, tmp_path):
    path = "file://" + str(tmp_path / "map")
    one = spark.createDataFrame([("a", "b")], "tok string, new string")
    assert normalize.kept_token_map(spark, path, lambda: one).count() == 1
    assert normalize.kept_token_map(spark, path, lambda: 1 / 0).first()["new"] == "b"


def test_orphan_labels_and_owners(spark, truth):
    rows = [(f"S{i}-{k}", f"name {k}", f"{k} road", "us") for k in (1, 2) for i in (1, 2, 3)]
    records = spark.createDataFrame(rows, "entity_id string, name string, address string, country string")
    reverse = spark.createDataFrame([("us", "S2-1", "S1-1", 0.9, 1, 0.9, None)], "country string, rec_id string, s1_id string, score double, rank int, s_word double, s_namenum double")
    d, cols = linkage.orphan_frame(records, reverse, truth)
    got = {r["rec_id"]: (r["y"], r["owner"]) for r in d.collect()}
    assert got == {"S2-1": (0, "S1-1"), "S3-1": (0, "S1-1"), "S2-2": (0, "S1-2"), "S3-2": (1, "S3-2")}
    assert "rev_best" in cols and not {"rec_id", "country", "y", "owner"} & set(cols)


def test_pruned_scores_come_from_the_other_half(spark):
    """A feature that names its row lets a model know the rows it saw; the scores kept must not."""
    rows = [(f"S1-{i}", f"S2-{i}", "us", float(i), i % 2) for i in range(60)]
    pairs = spark.createDataFrame(rows, "s1_id string, cand_id string, country string, a double, y int")
    truth = pairs.select("s1_id", F.array("cand_id").alias("matched_ids")).where("s1_id <> 'S1-7'")
    got = linkage.pruned(pairs, truth, ["a"], linkage.Preset((), ("a",), 8, 0.0, 0.5, 0.5, False), rounds=3, depth=5)
    fit = models.predict(models.fit_trees(pairs, ["a"], rounds=3, depth=5), pairs, ["a"])
    assert got.count() == 60
    assert metrics.auc(fit, "prob", "y").first()["auc"] > metrics.auc(got, "prune_prob", "y").first()["auc"]


def test_scaled_rarity_is_within_one(spark):
    match = spark.createDataFrame([("S1-1", "us", "a b", "a b"), ("S2-1", "us", "a c", "a c"), ("S2-2", "us", "a", "a")], "entity_id string, country string, name_m string, name_skel string")
    pairs = spark.createDataFrame([("S1-1", "S2-1", "us", 1.0, 0.0)], "s1_id string, cand_id string, country string, q_only_idf double, p_only_idf double")
    r = features.scaled_idf(pairs, match, match.where("entity_id <> 'S1-1'")).first()
    assert all(0 <= r[c] <= 1 for c in ("q_only_idf", "p_only_idf", *features.RECORD)) and r["p_tok_maxidf"] > r["p_tok_minidf"] == 0


def test_country_thresholds_decide(spark):
    d = spark.createDataFrame([("us", "S1-1", "S2-1", 0.92), ("fr", "S1-2", "S2-2", 0.92), ("us", "S1-1", "S2-3", 0.93)], "country string, s1_id string, cand_id string, prob double")
    got = linkage.decided(d, linkage.PRESETS["v3"], {"us": 0.95})
    assert sorted(r["cand_id"] for r in got.collect()) == ["S2-2", "S2-3"]  # the best of an S1 needs t1 only
    assert decide.country_threshold(0.9, {}) is not None


def test_small_tables_are_dealt_and_cleared(spark):
    d = spark.range(10).coalesce(1)
    assert storage.spread(d).count() == 10
    storage.staged(d, "x")
    storage.clear(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(storage.app_folder(spark))
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_commands(spark, tmp_path):
    from tessera.__main__ import main

    rows = [("S1-1", "Acme Traders", "12 Main St, Pune", "india"), ("S2-1", "Acme Trader", "12 Main Street, Pune", "india"), ("S1-2", "राम Motors", "4 Road, Delhi", "india"), ("S3-2", "Ram Motors", "4 Road, Delhi", "india")]
    spark.createDataFrame(rows, "entity_id string, name string, address string, country string").write.parquet(str(tmp_path / "records"))
    truth = spark.createDataFrame([("S1-1", ["S2-1"]), ("S1-2", ["S3-2"])], "s1_id string, matched_ids array<string>")
    truth.write.parquet(str(tmp_path / "truth"))
    at = lambda x: str(tmp_path / x)
    main(["normalize", at("records"), at("norm")], spark)
    assert spark.read.parquet(at("norm") + "/records").count() == 4 and spark.read.json(at("norm") + "/fill").count() == 1
    main(["candidates", at("records"), at("cands"), "--blocks", "word,namenum"], spark)
    assert spark.read.parquet(at("cands")).where("s1_id = 'S1-1' and cand_id = 'S2-1'").count() == 1
    main(["reverse", at("records"), at("rev"), "--k", "1"], spark)
    assert spark.read.parquet(at("rev")).where("rank > 1").count() == 0
    metrics.pairs_of(truth).write.parquet(at("matches"))
    main(["evaluate", at("matches"), at("truth"), at("report")], spark)
    assert spark.read.json(at("report") + "/score").first()["macro_f05"] == 1
    main(["summary", at("records"), at("summary")], spark)
    assert spark.read.json(at("summary")).count() >= 1


def test_public_names():
    import tessera

    assert all(getattr(tessera, n) is not None for n in tessera.__all__)


def test_joined_agreement_lists_no_pairs(spark):
    """As the listed pairs on odd rows; 4 x 10^9 pairs of one key in no time."""
    names = [None, "", " ", "a", "a b", "b a", "a  a b", "c", "a c d", "d"]
    one = [(k, c, x, n, m, p) for i, (n, m) in enumerate((n, m) for n in names for m in names) for k, c, x, p in [(None if i % 11 == 0 else i % 3, [None, "fr", "in"][i % 3 - i % 2], [True, False, None][i % 3], names[i % 4])]]
    two = [(k, n, m, p) for k in (0, 1, None) for n, m, p in zip(names, names[3:] + names[:3], names[5:] + names[:5], strict=True)]
    left = spark.createDataFrame(one, "k int, country string, cross_script boolean, raw string, core string, postcode string")
    right = spark.createDataFrame(two, "k int, raw string, core string, postcode string")
    other = right.select("k", *[F.col(c).alias(f"cand_{c}") for c in ("raw", "core", "postcode")])
    pairs = left.join(other, "k").withColumnsRenamed({c: f"s1_{c}" for c in ("raw", "core", "postcode")})

    def rows(d):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect()), key=repr)

    want = rows(reports.pair_agreement(pairs))
    assert rows(reports.joined_agreement(left, right, "k")) == want and any(r[-1] for r in want)
    assert rows(reports.joined_agreement(left.limit(0), right, "k")) == rows(reports.pair_agreement(pairs.limit(0)))
    n = spark.range(1 << 16)
    big = reports.joined_agreement(n.selectExpr("1 as k", "'x' as country", "true as cross_script", "'a' as raw", "'a b' as core", "'' as postcode"), n.selectExpr("1 as k", "'a' as raw", "'a c' as core", "'' as postcode"), "k")
    assert {(r["pairs"], r["raw_equal"], r["core_equal"], round(r["core_jaccard"], 9)) for r in big.collect()} == {(1 << 32, 1.0, 0.0, round(1 / 3, 9))}
