"""Registered queries: their columns, held-out quality, and the pipeline against brute force."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import decontam, nearcopies, queries
from tessera.llm.common import table

from .test_kernels import brute_matches, connected, repeated

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
pytest.importorskip("public_tokenizers")

COLUMNS = {
    "op1_quality_pu": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op2_simhash_dedup": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op4_token_bin": ("documents", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "op6_suffix_dedup": ("documents", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    "op7_embedding_dedup": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op8_html_text": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op9_language_id": ("documents", ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]),
    "op10_token_counts": ("documents", ["doc_id", "n_tokens", "n_chars"]),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    of, columns = COLUMNS[name]
    d = entry.queries()[name](spark, FOLDER)
    assert d.columns == columns and d.count() == table(spark, FOLDER, of).count()


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    d = queries.op1_quality_pu(spark, folder).where("held_out").join(table(spark, folder, "labels"), "doc_id")
    assert d.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    d = queries.op9_language_id(spark, folder).where("held_out").join(table(spark, folder, "documents"), "doc_id")
    assert d.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_pipeline_stages(spark):
    """Each stage on what the one before it kept, against brute force."""
    docs = table(spark, FOLDER, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix", "decontaminate", "pack"]
    good = stages["quality"](spark, docs, FOLDER)
    assert good.columns == docs.columns
    labels = table(spark, FOLDER, "labels")
    kept = good.join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert kept > 0.97 and good.join(labels, "doc_id").count() > 0.9 * labels.where("quality = 1").count()
    one = stages["simhash"](spark, good, FOLDER).collect()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    # Five-word shingles of similarity 0.8, as the stage links them.
    found = [nearcopies.shingles(t.encode()) for _, t in rows]
    alike = [(i, j) for i, a in enumerate(found) for j, b in enumerate(found[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    group = connected(len(rows), alike)
    want = {min(rows[j][0] for j in range(len(rows)) if group[j] == group[i]) for i in range(len(rows))}
    assert sorted(r["doc_id"] for r in one) == sorted(want)
    once = spark.createDataFrame(one, docs.schema)
    cut = {r["doc_id"]: r["text"] for r in stages["suffix"](spark, once, FOLDER).collect()}
    raw = [r["text"].encode() for r in one]
    flags = repeated(raw, 200)
    assert cut == {r["doc_id"]: bytes(b for b, f in zip(t, fl, strict=True) if not f).decode("utf-8", "ignore") for r, t, fl in zip(one, raw, flags, strict=True)}
    items = [(r["item_id"], r["text"].encode()) for r in table(spark, FOLDER, "benchmark").collect()]
    found = decontam.prepare(items)
    clean = stages["decontaminate"](spark, once, FOLDER).collect()
    dirty = {r["doc_id"] for r in one} - {r["doc_id"] for r in clean}
    near = {r["doc_id"] for r in one if decontam.matches(r["text"].encode(), found)}
    assert dirty == near
    for r in one[:: max(1, len(one) // 15)]:
        if len(r["text"]) < 3000:
            assert bool(brute_matches(r["text"].encode(), items)) == (r["doc_id"] in dirty)


def test_pipeline_stages_keep_odd_rows(spark):
    """Null and repeated ids, null, empty, long and equal texts, further columns with clashing names,
    and no rows, in every stage that returns documents; the last gives each of them a place."""
    odd = [(None, None), (None, ""), (None, "one text"), (None, "another text"), (3, "a text of its own"), (3, "and a second one"), (4, "word " * 200), (5, "same text here"), (6, "same text here"), (7, " ".join(f"w{i}" for i in range(30000)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("_node", "root", "th", "fp", "key", "node", "score", "spans")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns and stage(spark, docs.limit(0), FOLDER).count() == 0, name
        kept = sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect())
        every = sorted((str(i), t or "") for i, t in odd)
        if name == "simhash":
            gone = [("6", "same text here"), ("None", "")]  # a copy, and one of two texts without words
            assert kept == [x for i, x in enumerate(every) if x not in gone or x == ("None", "") and i == every.index(x)], kept
        elif name == "suffix":
            assert len(kept) == len(every) and ("4", "") in kept  # "word " repeats itself
        elif name == "decontaminate":
            assert kept == every
        else:
            assert set(kept) <= set(every)
    placed = dict(corpus_pipeline.STAGES)["pack"](spark, docs, FOLDER)
    assert {r["doc_id"] for r in placed.collect()} == {None, 3, 4, 5, 6, 7}


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "bin_id", "bin_size", "bin_offset"} <= set(out.columns) and out.count() > 0
    assert "pipeline" in entry.queries()
