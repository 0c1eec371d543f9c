"""Kernels of the corpus operators against brute force."""

import io
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontam, embed, html, langid, packing, quality, simhash, suffix, tokcount, tokenbin
from tessera.llm.common import spanning


def connected(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        p[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  Words\n\tAnd MORE, it's", "", " ", "é\r\nx" * 50, "😀 12345"]
    e, t = tokenbin.Encoder(path), Tokenizer.from_file(path)
    assert not e.by_chunk and tokenbin.Encoder(vocabulary()).by_chunk
    assert [x.tolist() for x in e.batch(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def least_cost(lengths, sizes):
    """Least cost of any packing, by trying all."""
    best = [10**9]

    def go(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(min(s for s in sizes if s >= b) + packing.BIN_COST for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= max(sizes) and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_packing_is_near_the_least_cost():
    rng = random.Random(9)
    sizes = (64, 128, 256)
    ratios = []
    for _ in range(150):
        lengths = sorted((rng.randrange(1, 257) for _ in range(rng.randrange(1, 8))), reverse=True)
        ratios.append(packing.plan(dict(Counter(lengths)), sizes).cost / least_cost(lengths, sizes))
    assert min(ratios) >= 1 and max(ratios) <= 1.5 and sum(ratios) / len(ratios) < 1.06


@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32))
def test_spanning_keeps_connection(h, w, seed):
    m = np.random.default_rng(seed).random((h, w)) < 0.2
    i, j = spanning(m)
    assert len(i) <= max(0, h + w - 1) and m[i, j].all()
    same = lambda links: connected(h + w, [(a, h + b) for a, b in links])
    a, b = same(zip(*np.nonzero(m), strict=True)), same(zip(i, j, strict=True))
    assert all((a[x] == a[y]) == (b[x] == b[y]) for x in range(h + w) for y in range(h + w))


# ---------------------------------------------------------------- SimHash


@pytest.mark.parametrize("text", [b"", b" \t\n", b"One", b"One two", b"a b c", b"A B\x0bC  d a b c", "É é \x1c x\xa0y".encode(), b"w " * 1000, b" ".join(b"%d" % i for i in range(700))])
def test_fingerprint(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text) == want


# ---------------------------------------------------------------- suffix arrays


def repeated(texts, length):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        f = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                f[i : i + length] = True
        out.append(f)
    return out


def test_family_finds_all_repeats():
    rng = random.Random(3)
    for length in (5, 8, 17, 40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(length, length + 30))) for _ in range(40)]
        texts += [texts[3], texts[7][:length] + b"zz"]
        family = suffix.Family(length)
        for at in range(0, len(texts), 3):
            some = texts[at : at + 3]
            starts, base = [], 0
            for t in some:
                starts += range(base, base + len(t) - length + 1)
                base += len(t)
            family.add(b"".join(some), np.array(starts))
        assert sorted(family.levels) == [1, 2, 3] and family.merges == 11  # 14 batches: 8 + 4 + 2
        for level in family.levels.values():
            w = level.windows(np.arange(len(level)))
            assert w == sorted(w)
        c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        want = [c[t[i : i + length]] > 1 for t in texts for i in range(len(t) - length + 1)]
        assert family.repeated().tolist() == want


@pytest.mark.parametrize("head", [1, 2, 16])
def test_merge_scan_in_slices(monkeypatch, head):
    monkeypatch.setattr(suffix, "SLICE", 3)
    monkeypatch.setattr(suffix, "HEAD", head)
    rng = random.Random(8)
    for _ in range(30):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(4, 40))) for _ in range(2)]
        a, b = (suffix.Level.of(t.encode(), np.arange(len(t) - 3), np.arange(len(t) - 3), 4) for t in parts)
        upper, in_a, in_b = suffix.merge_scan(a[0], b[0])
        x, y = (z[0].windows(np.arange(len(z[0]))) for z in (a, b))
        assert all(sum(p < q for p in x) <= u <= sum(p <= q for p in x) for u, q in zip(upper.tolist(), y, strict=True))
        assert (in_b | b[1]).tolist() == [q in x or y.count(q) > 1 for q in y]
        assert (in_a | a[1]).tolist() == [p in y or x.count(p) > 1 for p in x]
        both = suffix.merged(a[0], b[0], upper)
        assert both.windows(np.arange(len(both))) == sorted(x + y)


def test_anchors_are_in_step():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abcdef") for _ in range(90))
    cut = suffix.Anchors(20, 6, piece=64)
    pair = []
    for lead in (b"x" * 33, b"yz" * 40):
        t = lead + shared + b"q" * 11
        key, first, count, place = cut(t)
        assert ((place >= first + count - 1) & (place + 6 <= first + 20)).all()
        assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(t) - 19
        pair.append({t[s + i : s + i + 20]: k for k, s, n in zip(key.tolist(), first.tolist(), count.tolist(), strict=True) for i in range(n)})
    for i in range(len(shared) - 19):
        assert pair[0][shared[i : i + 20]] == pair[1][shared[i : i + 20]]


@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 10)), max_size=6))
def test_kept_pieces(found):
    n, length = 120, 20
    spans = [(a, min(a + d, n - length)) for a, d in found]
    flags = np.zeros(n + 2, bool)
    for a, b in spans:
        flags[a + 1 : b + length + 1] = True
    keep, removed, count = suffix.kept_pieces(n, spans, length)
    assert removed == flags.sum() and count == (flags[1:] & ~flags[:-1]).sum()
    assert sorted(i for a, e in keep for i in range(a, e)) == np.flatnonzero(~flags[1:-1]).tolist()


# ---------------------------------------------------------------- token files


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 31, 32])
def test_bits(bits):
    x = np.random.default_rng(bits).integers(0, 2**bits, 1003).astype(np.uint32)
    data = tokenbin.pack(x, bits)
    assert len(data) == -(-1003 * bits // 8) and (tokenbin.unpack(data, 1003, bits) == x).all()


def test_bits_for():
    assert [tokenbin.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


@pytest.mark.parametrize("bits", [11, 16])
def test_file_round_trip(bits):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 2**bits, n).astype(np.uint32) for n in (0, 1, 5000, 0, 64, 999, 64, 1, 0)]
    sink = io.BytesIO()
    w = tokenbin.Writer(sink, bits, block=64)
    for i, d in enumerate(docs):
        w.add(i - 3, d)
    w.close()
    r = tokenbin.Reader(io.BytesIO(sink.getvalue()))
    assert r.doc_ids.tolist() == [i - 3 for i in range(len(docs))]
    for most in (1, 70, 10**6):
        assert all((a == docs[k]).all() for k, a in r.documents(most)) and len(list(r.documents(most))) == len(docs)
    every = np.concatenate(docs)
    for a, b in ((0, 0), (1, 2), (63, 65), (4000, 6000), (0, len(every))):
        assert (r.ids(a, b) == every[a:b]).all()
    with pytest.raises(ValueError):
        w.add(9, np.array([2**bits], np.uint32))


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


ODD = ["", " ", "The cat. THE CAT's don't!", "İstanbul á Éx H̱", "I'LL 123 45%", "<|endoftext|> x<|startoftext|>y", "Ωσς ΣΑΣ \x1c b　c 中文 ﬁ ½", "ab\n\n\tc  d\r\n", "ÉTÉ été, Straße; œuvre...", "foo.bar***baz|| q", "a" * 300, "x'y 'S 're"]


def test_encoder_equals_the_library():
    e = tokenbin.Encoder(vocabulary())
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
    assert [x.tolist() for x in e.batch(ODD)] == want == [e(t).tolist() for t in ODD]


# ---------------------------------------------------------------- token counts


@settings(max_examples=300)
@given(st.lists(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=12), st.text("abc", max_size=12))
def test_automaton_is_greedy(pieces, word):
    known, i, n = set(pieces), 0, 0
    while i < len(word) and n >= 0:
        j = next((j for j in range(len(word), i, -1) if word[i:j] in known), None)
        n, i = (-1, i) if j is None else (n + 1, j)
    assert tokcount.build(pieces).count(word) == n


def test_counts_match_a_word_piece_model():
    from tokenizers import models

    count = tokcount.counter(vocabulary())
    import json

    vocab = json.load(open(vocabulary(), encoding="utf-8"))["model"]["vocab"]
    model = models.WordPiece(vocab, unk_token="!", max_input_chars_per_word=10_000, continuing_subword_prefix="")
    for w in ["hello", "unbelievable", "thntiohe", "été", "x" * 50, "123", "中文"]:
        assert count.word(w) == len(model.tokenize("".join(count_letter(b) for b in w.encode()) + "</w>"))
    assert count("") == 0 and count("a  a\n") == 2 * count("a")
    assert count("Hello, World!") == sum(map(count.word, ["hello", ",", "world", "!"]))


def count_letter(b):
    return tokcount.byte_letters()[b]


# ---------------------------------------------------------------- packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan(hist):
    p = packing.plan(hist, (16, 32, 64))
    bins = {}
    for length, _, n, first, each, offset in p.slots.tolist():
        for k in range(n):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    got = Counter(length for v in bins.values() for _, length in v)
    assert got == Counter(hist) and len(bins) == p.bins
    sizes = {b: int(p.sizes[np.searchsorted(p.sizes[:, 0], b, "right") - 1, 1]) for b in bins}
    for b, v in bins.items():
        end = 0
        for at, length in sorted(v):
            assert at == end
            end += length
        assert end <= sizes[b] and not any(end <= s < sizes[b] for s in (16, 32, 64))
    total = sum(hist.values())
    assert p.cost <= sum(n * (next(s for s in (16, 32, 64) if s >= k) + packing.BIN_COST) for k, n in hist.items()) or total == 0


def test_plan_guards():
    with pytest.raises(ValueError):
        packing.plan({99: 1}, (16, 64))
    assert packing.plan({}, (16,)).bins == 0


# ---------------------------------------------------------------- embeddings


def test_join_blocks_loses_nothing():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[100:160] = x[0] + rng.normal(scale=0.05, size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    z = x @ axes
    order = np.lexsort(np.floor(z[:, 2::-1] / 0.3).T)
    x, z = x[order], z[order]
    eps = np.sqrt(2 - 2 * 0.95)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if i < j}
    got = set()
    for s, t, link in embed.join_blocks(x, x, embed.boxes(z, 16), embed.boxes(z, 16), True, 0.95, eps, 16):
        got |= {(s + i, t + j) for i, j in zip(*np.nonzero(link), strict=True) if s + i < t + j}
    assert got == want
    a, b = np.arange(150), np.arange(150, 300)
    got = set()
    for s, t, link in embed.join_blocks(x[a], x[b], embed.boxes(z[a], 16), embed.boxes(z[b], 16), False, 0.95, eps, 16):
        got |= {(s + i, 150 + t + j) for i, j in zip(*np.nonzero(link), strict=True)}
    assert got == {(i, j) for i, j in want if i < 150 <= j}


# ---------------------------------------------------------------- decontamination


def test_block_index_has_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 30).astype(np.uint64)
    x = items[rng.integers(0, 30, 500)].copy()
    for i in range(500):
        for b in rng.choice(64, i % 30, replace=False):
            x[i] ^= np.uint64(1) << np.uint64(b)
    i, j, d = decontam.BlockIndex(items, 22).near(x)
    want = {(a, b) for a in range(500) for b in range(30) if int(x[a] ^ items[b]).bit_count() <= 22}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert all(int(x[a] ^ items[b]).bit_count() == c for a, b, c in zip(i.tolist(), j.tolist(), d.tolist(), strict=True))


def brute_matches(text, items, k=5, least=0.8):
    out = set()
    w = decontam.words(text)
    for item, t in items:
        v = decontam.words(t)
        if not v or not w:
            continue
        a, n = Counter(decontam.shingles(v, k)), min(len(v), len(w))
        for s in range(len(w) - n + 1):
            b = Counter(decontam.shingles(w[s : s + n], min(k, len(v))))
            if 2 * (a & b).total() / (a.total() + b.total()) >= least:
                out.add(item)
                break
    return out


def test_matches():
    rng = random.Random(5)
    word = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(word) for _ in range(rng.randrange(3, 40))).encode()) for i in range(30)]
    b = decontam.prepare(items)
    hits = 0
    for _ in range(120):
        doc = [rng.choice(word) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.8:
            p = decontam.words(rng.choice(items)[1])
            p = [x if rng.random() < 0.97 else b"zz" for x in p][: rng.choice([len(p), len(p) - 1, len(p) // 2])]
            at = rng.randrange(len(doc) + 1)
            doc[at:at] = [x.decode().upper() + "," for x in p]
        text = " ".join(doc).encode()
        got = {m[0] for m in decontam.matches(text, b)}
        assert got == brute_matches(text, items)
        hits += bool(got)
    assert hits > 20
    assert decontam.matches(b"", b) == [] and decontam.matches(b"w1", decontam.prepare([(1, b"")])) == []


def planted(rng, least=0.8, most=0.85):
    """An item and a text that holds a changed copy of it; similarity of the copy within the range."""
    word = [f"w{i}" for i in range(3000)]
    while True:
        v = [rng.choice(word) for _ in range(rng.randrange(20, 160))]
        p = list(v)
        if rng.random() < 0.4:
            n = rng.randrange(1, 1 + len(p) // 4)
            p = p[n:] + [rng.choice(word) for _ in range(n)]
        for _ in range(rng.randrange(0, 1 + len(p) // 20)):
            p[rng.randrange(len(p))] = "zz"
        a, b = (Counter(decontam.shingles([x.encode() for x in y], 5)) for y in (v, p))
        if least <= 2 * (a & b).total() / (a.total() + b.total()) < most:
            rest = [rng.choice(word) for _ in range(80)]
            at = rng.randrange(len(rest))
            return " ".join(v).encode(), " ".join(rest[:at] + p + rest[at:]).encode()


def test_matches_recall():
    """Of copies just above the similarity, the radius loses next to none."""
    rng = random.Random(12)
    found = [bool(decontam.matches(text, decontam.prepare([(1, item)]))) for item, text in (planted(rng) for _ in range(400))]
    assert sum(found) >= 399


# ---------------------------------------------------------------- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a}</style><script>var x="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>Real &amp; true</h1><p><b>Wo<i>rd</i> one.<br>Next&nbsp;&#233;t&eacute; line
 here.<p>Tiny<div class="ad">Buy now, it is cheap. Very cheap indeed.</div><form><label>Mail</label><input></form><ul><li>one</li><li>two</li></ul><p>a < b > c</article>
<aside>Related words, long enough to look like text. And more.</aside><section id="comments"><p>Great post, I liked it very much. Thanks a lot for it!</p></section><footer>(c)"""


def test_extract():
    assert html.extract(PAGE) == "Real & true Word one. Next été line here. Tiny one two a < b > c"


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<p>", "</p></p>", "<!-- x", "<script>", "<a><b></a></b>", '<p class="x>y', "&#xZZ;&bogus;"])
def test_broken_pages(page):
    assert isinstance(html.extract(page), str)


def test_pages_without_marks():
    assert html.extract("<p>Only this text.</p><p>x</p>") == "Only this text. x"
    assert html.extract("<main><p>In.</p></main><p>Outside of it.</p>") == "In."


LONG = "A sentence of the article that says something. And one more of them, as long as the first."


def test_class_words_are_no_verdict():
    assert html.extract(f'<div id="search-engines"><p>{LONG}</p><p>Short.</p></div>') == LONG + " Short."
    inner = f'<p class="search">{LONG}</p><ul class="related-work"><li>Smith 1999</li></ul><div class="notice-board">{LONG}</div><p hidden>Hid.</p><p style="display:none">Den.</p>'
    assert html.extract(f"<article>{inner}</article>") == f"{LONG} Smith 1999 {LONG} Hid. Den."
    assert html.extract(f'<div class="sidebar"><p>{LONG}</p></div>') == LONG  # all that the page has
    drop = '<div class="related-posts"><a href=x>More of this</a></div><div class="cookie-notice">We use them. Do you agree?</div><div class="ad-slot">Buy. Now.</div><div id="comment-list"><p>Nice text, I liked it.</p></div>'
    assert html.extract(f"<article><p>{LONG}</p>{drop}</article>") == LONG
    assert html.extract(f"<div class=content><p>{LONG}</p></div>{drop}") == LONG
    assert html.extract(f"<p>{LONG}</p><p hidden>Hid.</p>") == LONG


def test_weights_are_fitted():
    page = f"<nav><ul><li><a href=x>Home</a></li><li><a href=y>News of us</a></li></ul></nav><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article><footer><a href=z>Us</a></footer>"
    found = html.blocks(page)
    assert html._counts(found)[:, 0].sum(1).tolist() == [3, 3] and html._counts(html.blocks("<p>x</p>")).sum() == 0
    assert html.weights(html._counts(found)) is html.PLAIN
    fitted = html.weights(html._counts(found) * 30)
    bare = html.scores(html.blocks(f"<div><a href=x>Home</a></div><div>{LONG}</div>"), fitted)
    assert bare[0] < 0 < bare[1]


@pytest.mark.parametrize("bad", ['<a "', '<a href="x', "<!-", '<a b=">"', "<b>x<p>", "</x><div>", "<a b='>", "<![x", "<?", '<p class="a', "<hr>x<b>"])
def test_broken_marks_are_linear(bad):
    import time

    at = time.process_time()
    text = html.extract("<article><p>Text.</p>" + bad * 8000)
    assert text.startswith("Text.") and time.process_time() - at < 5


def test_tags_of_quotes_and_raw_text():
    assert html.extract('<p title="a>b">One</p><p title=\'c>d\' x=">">Two.</p>') == "One Two."
    assert html.extract('<p>It is "so" and it\'s</p><p alt="open>Three.</p><p>Four.</p>') == 'It is "so" and it\'s Three. Four.'


@given(st.lists(st.floats(-3, 3), min_size=1, max_size=7), st.integers(0, 2**32))
def test_min_cut_is_least(unary, seed):
    rng = random.Random(seed)
    unary = [round(u, 2) for u in unary]
    n = len(unary)
    edges = [(i, j, round(rng.random(), 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

    def cost(labels):
        return sum(abs(u) for u, x in zip(unary, labels, strict=True) if (u > 0) != x and u) + sum(w for i, j, w in edges if labels[i] != labels[j])

    assert abs(cost(html.min_cut(unary, edges)) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-6


# ---------------------------------------------------------------- models


def test_codewords():
    for n in (2, 3, 4, 7, 12):
        c = langid.codewords(n)
        d = (c.shape[1] - c @ c.T) / 2
        assert c.shape[0] == n and (d[~np.eye(n, dtype=bool)] >= max(1, c.shape[1] // 4)).all()


def test_language_model_small():
    texts = [f"the and of with {i} this that".encode() for i in range(30)] + [f"der und mit nicht {i} das eine".encode() for i in range(30)]
    m = langid.train(np.vstack([langid.examples(t)[0] for t in texts]), ["en"] * 30 + ["de"] * 30, steps=60)
    best, vote, _ = m.decode(np.vstack([langid.profile(b"with that of"), langid.profile(b"nicht eine und")]).astype(np.float32))
    assert [m.names[i] for i in best] == ["en", "de"] and ((0 <= vote) & (vote <= 1)).all()
    none = langid.train(np.zeros((0, langid.BUCKETS), np.float32), [])
    assert none.names == [] and none.decode(np.zeros((2, langid.BUCKETS), np.float32))[0].tolist() == [0, 0]
    one = langid.train(np.vstack(langid.examples(b"abc")), ["xx"], steps=3)
    assert len(langid.examples(b"abc " * 30)) == 2
    assert one.names == ["xx"] and one.decode(langid.profile(b"abc")[None].astype(np.float32))[0].tolist() == [0]


def test_positive_unlabelled_learning():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (2000, quality.FEATURES)), rng.normal(0, 1, (600, quality.FEATURES))
    bad[:, 3] += 4
    u = np.vstack([good[1000:], bad[:250]])
    m = quality.train(good[:1000], u)
    assert abs(m.prior - 0.8) < 0.2
    assert (m.score(good) >= 0.3).mean() > 0.95 and (m.score(bad[250:]) >= 0.3).mean() < 0.15
    empty = quality.train(np.zeros((0, quality.FEATURES)), np.zeros((0, quality.FEATURES)))
    assert empty.score(np.zeros((1, quality.FEATURES))).tolist() == [0.5]


def test_quality_features_cover_the_whole_text():
    a, b = quality.features(b"word " * 400_000), quality.features(b"word " * 400_000 + b"#" * 400_000)
    assert not np.allclose(a, b) and np.isfinite(quality.features(b"")).all() and np.isfinite(quality.features(b"\xff\x00")).all()
