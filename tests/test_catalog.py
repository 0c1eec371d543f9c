"""Every query with an oracle gives what the oracle gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def rows(d):
    d = d[sorted(d.columns)]

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is __import__("pandas").NA:
            return None
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else bool(v) if type(v).__name__ == "bool_" else float(v) if type(v).__module__ == "numpy" else v

    return sorted((tuple(map(plain, r)) for r in d.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = catalog.queries()[name](spark, FOLDER).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def within(d, *columns, lo=0, hi=1):
    return all(d[c].dropna().between(lo, hi).all() for c in columns)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def turns_hold(d, duck):
    t = duck.sql("SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS w FROM conversations WHERE text IS NOT NULL").df()
    words = {(r.conv_id, r.turn): r.w for r in t.itertuples()}
    some = d.sort_values(["conv_id", "turn"]).head(25)
    for r in some.itertuples():
        a, b = words[r.conv_id, r.turn], words[r.conv_id, r.turn + 1]
        sa, sb = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        assert abs(r.ratio - 2 * lcs(a, b) / (len(a) + len(b))) < 1e-5 and abs(r.token_sort_ratio - 2 * lcs(sa, sb) / (len(sa) + len(sb))) < 1e-5
    return within(d, "ratio", "token_sort_ratio", "token_set_ratio")


PARTS = "SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS id, p_name, p_type, p_brand FROM part"
OWNED = f"SELECT DISTINCT b.id FROM ({PARTS}) a JOIN ({PARTS}) b USING (p_name, p_type, p_brand) WHERE starts_with(a.id, 'S1-') AND NOT starts_with(b.id, 'S1-')"
n_rows = lambda duck, sql: duck.sql(f"SELECT count(*) AS n FROM ({sql})").df()["n"][0]

#: What must hold where no SQL can say the same.
HOLDS = {
    "ratio_turns": turns_hold,
    "normalize_records": lambda d, duck: len(d) == n_rows(duck, "SELECT * FROM documents") and all(core in norm for core, norm in zip(d["name_core"], d["name_norm"], strict=True)),
    "match_fields_latin": lambda d, duck: len(d) == n_rows(duck, "SELECT * FROM documents") and not d["name_key"].str.contains(" ").any() and (d["addr_missing"] == (d["addr_norm"] == "")).all(),
    "gbt_oof": lambda d, duck: len(d) == n_rows(duck, "SELECT * FROM lineitem") and within(d, "prob") and d["prob"].nunique() > 5,
    "gbt_pruner_final": lambda d, duck: d["cand_id"].is_unique and within(d, "prob", lo=0.4),
    "gbt_importance": lambda d, duck: len(d) == 5 and abs(d["gain"].sum() - 1) < 1e-4 and d["gain"].is_monotonic_decreasing,
    "gbt_transfer": lambda d, duck: len(d) == 2 and within(d, "auc") and (d["n_pos"] + d["n_neg"]).sum() == n_rows(duck, "SELECT * FROM lineitem"),
    "link_v3": lambda d, duck: d["cand_id"].is_unique and within(d, "prob", lo=0.55) and d["s1_id"].str.startswith("S1-").all() and not d["cand_id"].str.startswith("S1-").any(),
    "orphan_oof": lambda d, duck: set(d[d["y"] == 0]["rec_id"]) == set(duck.sql(OWNED).df()["id"]) and len(d) == n_rows(duck, f"{PARTS} WHERE p_partkey % 3 <> 0") and within(d, "orphan_prob"),
    "zero_oof": lambda d, duck: len(d) == n_rows(duck, f"{PARTS} WHERE p_partkey % 3 = 0") and within(d, "p_zero"),
    "pair_features_parts": lambda d, duck: not d.duplicated(["s1_id", "cand_id"]).any() and within(d, "name_ts", "name_ratio", "name_partial", "addr_ts", "num_jacc", "skel_ratio", "name_cos", "addr_cos", hi=1 + 1e-6)
    and (d["num_q"] - d["num_q_only"] == d["num_p"] - d["num_p_only"]).all() and (d.groupby("s1_id")["n_cands"].transform("size") == d["n_cands"]).all() and d["house_eq"].isin([-1, 0, 1]).all(),
    "compact_pairs": lambda d, duck: not d.duplicated(["s1_id", "cand_id"]).any() and within(d, "name_tsr", "name_ratio", "name_partial", "addr_tsr", hi=100) and within(d, "s_word_rel", "s_skel_rel", "num_jacc")
    and (d.groupby("s1_id")["n_cands"].transform("size") == d["n_cands"]).all(),
}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_holds(spark, duck, name):
    d = catalog.queries()[name](spark, FOLDER).toPandas()
    assert len(d) and HOLDS[name](d, duck)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
