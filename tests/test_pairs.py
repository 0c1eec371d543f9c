"""Similarities of joined sides in blocks against single pairs."""

import random

import numpy as np
import pytest

from tessera.functions import strings
from tessera.operators import pairs

KINDS = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "weighted_ratio")


def words(rng, n, low, high, letters="abcé"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 18, 32, 33, 64])
def test_grids_are_those_of_single_pairs(n):
    rng = random.Random(n)
    a, b = words(rng, 12, 1, n), words(rng, 9, 1, n, "bcdé")
    assert (strings.jaro_winkler_grid(a, b) == [[strings.jaro_winkler(x, y) for y in b] for x in a]).all()
    a, b = words(rng, 12, n, n), words(rng, 9, n, n, "ab")
    b.append(a[0])
    got = np.moveaxis(np.array(strings.ratio_grids(a, b, KINDS)), 0, 2)
    assert np.allclose(got, [[strings.all_ratios(x, y, KINDS) for y in b] for x in a], atol=1e-12)


def test_other_texts_are_left_to_single_pairs():
    assert strings.jaro_winkler_grid([""], ["a"]) is None and strings.jaro_winkler_grid(["a" * 65], ["a"]) is None
    assert all(strings.ratio_grids([x], ["ab"], KINDS) is None for x in ("", "a", "a ", "abc")) and strings.ratio_grids(["a" * 65], ["a" * 65], KINDS) is None


def test_rounds_half_up():
    assert pairs.rounded(np.array([[1 / 128, 0.0000005], [0.1234565, 0.4999994]]), 6).tolist() == [[0.007813, 0.000001], [0.123457, 0.499999]]


@pytest.mark.parametrize("kinds", [("jaro_winkler",), KINDS])
def test_joined_similarities(spark, monkeypatch, kinds):
    """Every pair of a join once: null and lone keys, null, empty, long and repeated texts, several chunks."""
    monkeypatch.setattr(pairs, "LEFT", 7)
    monkeypatch.setattr(pairs, "RIGHT", 3)
    rng = random.Random(3)
    some = [None, "", "a b", "x" * 70, *words(rng, 8, 5, 5), *words(rng, 4, 1, 9)]
    left = [(i, rng.choice([None, 1, 1, 2, 3]), rng.choice(some)) for i in range(60)]
    right = [(i, rng.choice([None, 1, 1, 2, 4]), rng.choice(some)) for i in range(40)]
    one, two = spark.createDataFrame(left, "l long, k int, s string"), spark.createDataFrame(right, "r int, k int, t string")
    got = pairs.joined_similarities(one, two, "k", "l", "r", "s", "t", kinds)
    assert got.dtypes[:2] == [("l", "bigint"), ("r", "int")]
    single = (lambda x, y: (strings.jaro_winkler(x, y),)) if kinds == ("jaro_winkler",) else (lambda x, y: strings.all_ratios(x, y, kinds))
    want = sorted((i, j, *single(s or "", t or "")) for i, k, s in left for j, h, t in right if k is not None and k == h)
    rows = sorted(map(tuple, got.collect()))
    assert [r[:2] for r in rows] == [r[:2] for r in want] and np.allclose([r[2:] for r in rows], [r[2:] for r in want], atol=1e-6)
    assert pairs.joined_similarities(one.limit(0), two, "k", "l", "r", "s", "t", kinds).count() == 0
