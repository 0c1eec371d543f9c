"""Corpus operators on small tables with nulls, empty and long texts, ties, repeats, no rows, and
further columns whose names clash with those the operators make."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, components, decontam, embed, html, langid, packing, quality, queries, simhash, suffix, tokcount, tokenbin

from .test_kernels import brute_matches, connected, repeated

pytest.importorskip("public_tokenizers")
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
PASSAGE = " ".join(rng.choice(WORDS) for _ in range(70))


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(120)
TEXTS = [None, "", " \n", "a", BASE, BASE, BASE + " end", BASE.upper(), prose(60) + " " + PASSAGE + " " + prose(30), PASSAGE, prose(10) + " " + PASSAGE + "\nüñï " + prose(5), "é" * 250, prose(4000), "x y " * 300, prose(3)]
ROWS = [(i, t, "en", "src0", 0 if t is None else len(t), 7) for i, t in enumerate(TEXTS)] + [(4, BASE, "en", "s", 1, 1), (None, "a null id", None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int"


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    # Names that the operators use inside.
    return d.withColumns({c: F.lit("clash") for c in ("fp", "th", "_spans", "ctx", "root", "n_tokens", "score", "held_out", "tile", "seg")})


def none(docs):
    return docs.limit(0)


def test_fold_is_crc32(spark):
    d = spark.range(50).withColumnRenamed("id", "doc_id")
    assert all(r[1] == zlib.crc32(str(r[0]).encode()) % 5 for r in d.select("doc_id", common.fold("doc_id", 5)).collect())


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (8, 9), (9, 8), (3, 1), *((i, i + 1) for i in range(20, 60)), *((100, i) for i in range(101, 160))]
    d = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(d).collect()}
    at = connected(200, links)
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert all((got[a] == got[b]) == (at[a] == at[b]) for a in got for b in got)
    assert components.connected_components(d.limit(0)).count() == 0


def test_runs_are_whole(spark):
    import pyarrow as pa

    b = [pa.record_batch([pa.array(x)], names=["k"]) for x in ([1, 1, 2], [2, 2], [], [2, 3], [3, 3, 3], [4])]
    parts = [t.column("k").to_pylist() for t in common.runs(iter(b), "k", 3)]
    assert sum(parts, []) == [1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4]
    assert all(a[-1] != c[0] for a, c in zip(parts, parts[1:], strict=False))


# ---------------------------------------------------------------- 2


def brute_simhash(rows):
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    fps = []
    for _, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", low(t))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    at = connected(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for (i, *_), r in zip(rows, at, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, f"{f:016x}", least.get(r)) for (i, *_), f, r in zip(rows, fps, at, strict=True)), key=repr)


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.as_hex("fp"), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_simhash(ROWS)
    assert simhash.near_duplicates(none(docs)).count() == 0


@pytest.mark.parametrize("chunk", [2, 512])
def test_fingerprint_links(spark, chunk):
    r = random.Random(2)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        fps |= {x} | {x ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 5))) for _ in range(12)}
    hot = r.getrandbits(32) << 32
    fps = sorted(fps | {hot | r.getrandbits(5) for _ in range(20)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), chunk).collect()
    at = {x: i for i, x in enumerate(signed)}
    got = connected(len(fps), [(at[a], at[b]) for a, b in links])
    assert all((fps[at[a]] ^ fps[at[b]]).bit_count() <= 3 for a, b in links)
    want = connected(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(len(fps)))


# ---------------------------------------------------------------- 6


def brute_removal(rows, length=200):
    raw = [(t or "").encode() for _, t, *_ in rows]
    out = []
    for (i, *_), t, f in zip(rows, raw, repeated(raw, length), strict=True):
        edge = np.concatenate(([False], f))
        out.append((i, len(t), int(f.sum()), int((edge[1:] & ~edge[:-1]).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~f].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("together", [1, 4, 512])
def test_suffix_removal(spark, docs, together):
    got = sorted(map(tuple, suffix.removal(docs, together=together, batch_bytes=3000, task_bytes=30000).collect()), key=repr)
    assert got == brute_removal(ROWS)
    assert suffix.removal(none(docs)).count() == 0


def test_suffix_edges_of_a_common_passage(spark):
    """One passage in many texts, cut off and continued at many places: hot anchors on every level."""
    r = random.Random(6)
    texts = [prose(3) + PASSAGE[r.randrange(40) : len(PASSAGE) - r.randrange(40)] + prose(r.randrange(4)) for _ in range(60)]
    rows = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts + texts[:3])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for together in (1, 8):
        got = sorted(map(tuple, suffix.removal(d, together=together, batch_bytes=4000, task_bytes=40000).collect()), key=repr)
        assert got == brute_removal(rows)


def test_suffix_cut_keeps_columns_and_rows(spark, docs):
    d = suffix.cut(docs)
    assert d.columns == docs.columns and d.count() == len(ROWS)
    got = {(r["doc_id"], r["source"]): (r["text"], r["n_chars"]) for r in d.collect()}
    assert got[0, "src0"] == (None, 0) and got[5, "src0"] == ("", 0) and got[3, "src0"] == ("a", 1)
    assert PASSAGE not in got[8, "src0"][0] and got[11, "src0"][0] == ""
    assert suffix.cut(none(docs)).count() == 0


# ---------------------------------------------------------------- 4, 5, 10


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    want, at = [], 0
    for i, x in sorted(((r[0] if r[0] is not None else -(2**63), (r[1] or "")) for r in ROWS)):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        want.append((None if i == -(2**63) else i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in tokenbin.encode_table(docs, queries.vocabulary_path()).orderBy("start").collect()]
    assert got == want
    assert tokenbin.encode_table(none(docs), queries.vocabulary_path()).count() == 0
    counted = tokenbin.lengths(docs, queries.vocabulary_path()).collect()
    assert sorted(map(tuple, counted), key=repr) == sorted(((d, n) for d, _, n, _ in want), key=repr)
    assert tokenbin.lengths(none(docs), queries.vocabulary_path()).count() == 0


def test_least_long_is_an_id(spark):
    d = spark.createDataFrame([(-(2**63), "a"), (None, "b c"), (None, ""), *((5, f"x{i}") for i in range(40))], "doc_id long, text string")
    got = [r["doc_id"] for r in tokenbin.encode_table(d, queries.vocabulary_path()).orderBy("start").collect()]
    assert got == [None, None, -(2**63), *[5] * 40]


def test_token_counts(spark, docs):
    got = {r["doc_id"]: r for r in tokcount.token_counts(docs, queries.vocabulary_path()).collect()}
    with open(queries.vocabulary_path(), encoding="utf-8") as f:
        pieces = set(json.load(f)["model"]["vocab"])
    letters = tokcount.byte_letters()

    def greedy(word):
        w, i, n = "".join(letters[b] for b in word.encode()) + "</w>", 0, 0
        while i < len(w):
            i, n = next((j, n + 1) for j in range(len(w), i, -1) if w[i:j] in pieces)
        return n

    want = {i: sum(map(greedy, tokcount.WORD.findall((t or "").lower()))) for i, t in enumerate(TEXTS)}
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == 0
    assert all(got[i]["n_tokens"] == want[i] and got[i]["n_chars"] == len(t or "") for i, t in enumerate(TEXTS))
    assert tokcount.token_counts(none(docs), queries.vocabulary_path()).count() == 0


def test_packing(spark):
    rows = [(i, n) for i, n in enumerate([5, 5, 5, 700, 4096, 4097, 9000, 0, None, 1, 513, 512, 5, 5])] + [(3, 700)] + [(100 + i, 33) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("salt", F.lit(1))
    out = packing.pack(d).collect()
    assert Counter((r["doc_id"], r["piece"]) for r in out)[3, 0] == 2
    total = Counter()
    for r in out:
        total[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for i, n in rows:
        want[i] += n or 0
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in want.items() if v}
    bins = {}
    for r in out:
        if r["bin_id"] is not None:
            bins.setdefault((r["bin_id"], r["bin_size"]), []).append((r["bin_offset"], r["n_tokens"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), v in bins.items():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= size
    assert {r["doc_id"] for r in out if r["bin_id"] is None} == {7, 8}
    assert packing.pack(d.limit(0)).count() == 0


# ---------------------------------------------------------------- 7


def test_embeddings(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(90, 16)).astype(np.float32)
    x[30:60] = x[0] + g.normal(scale=0.04, size=(30, 16))
    x[70] = x[71] = x[3]
    x[72] = 2 * x[3]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(90, None, 1), (91, [0.0] * 16, 1), (92, [None] + [1.0] * 15, 1), (93, [float("nan")] * 16, 1), (94, [float("inf")] + [0.0] * 15, 1), (95, [], 1), (96, [1.0, 2.0], 1), (97, [1.0, 2.0], 1)]
    # Null and repeated ids: copies of a vector of the group, a pair of its own, one alone, one that cannot link.
    rows += [(None, x[30].tolist(), 1), (None, (-x[5]).tolist(), 1), (None, (-x[5] * 3).tolist(), 1), (None, (-x[6]).tolist(), 1), (None, None, 1), (5, x[31].tolist(), 1), (7, (-x[7]).tolist(), 1)]
    ids = [r[0] for r in rows]
    ok = {k: np.array(v, float) for k, (_, v, _) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    near = {(a, b) for a in ok for b in ok if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95}
    at = connected(len(rows), near)
    least = [min((ids[j] for j in range(len(rows)) if at[j] == at[k] and ids[j] is not None), default=None) for k in range(len(rows))]
    want = sorted(((i, sum(a == k for a, _ in near), least[k], i is not None and i == least[k]) for k, i in enumerate(ids)), key=repr)
    for kind in ("float", "double"):
        d = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"v": F.lit(1), "n": F.lit(2), "rep": F.lit(3), "least": F.lit(4)})
        for interval in (8, 4096):
            got = embed.near_duplicates(d, interval=interval, block=4).collect()
            assert sorted(map(tuple, got), key=repr) == want
    assert embed.near_duplicates(d.limit(0)).count() == 0


# ---------------------------------------------------------------- 3, 8


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE, 0), (2, None, 0), (3, "", 0), (4, " ".join(BASE.split()[3:40]), 0), (5, prose(20), 0), (4, " ".join(BASE.split()[3:40]), 0)], "item_id long, text string, doc_id int")
    pairs = [(i, t.encode()) for i, t in [(1, PASSAGE), (4, " ".join(BASE.split()[3:40]))]]
    want = {(r[0], m) for r in ROWS if r[1] for m in brute_matches(r[1].encode(), pairs)}
    for part in (32 << 20, 100):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items, part_bytes=part).collect()}
        assert got == want and len(want) >= 7
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns
    assert left.count() == len(ROWS) - sum(r[0] in {d for d, _ in want} for r in ROWS)
    assert decontam.contaminated(docs, items.limit(0)).count() == 0 and decontam.contaminated(none(docs), items).count() == 0


def test_pages(spark):
    rows = [(1, "u", "<p>One &amp; two</p>", 0), (2, None, None, 0), (3, "u", "", 0), (None, "u", "<article><p>x" + " y" * 50_000 + "</article>", 0), (1, "u", "<p>One &amp; two</p>", 0)]
    got = [tuple(r) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()]
    assert got.count((1, "u", "One & two", 9)) == 2 and (2, None, "", 0) in got and (3, "u", "", 0) in got
    assert next(r for r in got if r[0] is None)[3] == 100_001


# ---------------------------------------------------------------- 1, 9


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4, 13)] + [(None, 1, 0), (2, 0, 0), (4, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    m = quality.fit(docs, labels)
    out = quality.score(docs, m).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert quality.accepted(docs, m).columns == docs.columns
    again = quality.fit(docs, labels)
    assert np.allclose(m.weight, again.weight) and m.prior == again.prior
    nothing = quality.fit(none(docs), labels.limit(0))
    assert quality.score(docs, nothing).count() == len(ROWS) and quality.score(none(docs), m).count() == 0


def test_language_edges(spark, docs):
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == "und" and out[4]["lang_pred"] in ("en", "und")
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items() if i is not None)
    assert langid.identify(none(docs)).count() == 0
    numbers = spark.createDataFrame([(1, "123 456", "en"), (2, "word", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(numbers).collect()}[1] == "und"
