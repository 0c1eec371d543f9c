"""String similarity against slow definitions."""

from hypothesis import given
from hypothesis import strategies as st

from tessera.functions import strings as s

WORDS = st.text(alphabet="abc d", max_size=14)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(keep, row[j])
            last = keep
    return row[-1]


@given(WORDS, WORDS)
def test_lcs(a, b):
    assert s.lcs(a, b) == slow_lcs(a, b)


@given(WORDS, WORDS)
def test_partial(a, b):
    if not a or not b:
        return
    short, long = sorted((a, b), key=len)
    best = 0.0
    for x, y in ((short, long), (long, short)) if len(a) == len(b) else ((short, long),):
        for i in range(1 - len(x), len(y)):
            best = max(best, s.ratio(x, y[max(0, i) : i + len(x)]))
    assert abs(s.partial_ratio(a, b) - best) < 1e-12


@given(WORDS, WORDS)
def test_token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        assert s.token_set_ratio(a, b) == 0
        return
    both = " ".join(sorted(x & y))
    one, two = (" ".join(([both] if both else []) + ([r] if r else [])) for r in (" ".join(sorted(x - y)), " ".join(sorted(y - x))))
    got = s.token_set_ratio(a, b)
    assert 0 <= got <= 1
    if both:
        assert got >= max(s.ratio(both, one), s.ratio(both, two)) - 1e-12
    assert abs(got - s.token_set_ratio(b, a)) < 1e-12


def test_known_values():
    assert s.ratio("", "") == 1 and s.ratio("a", "") == 0
    assert round(s.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(s.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert s.token_sort_ratio("b a", "a b") == 1
    assert s.token_set_ratio("a b", "a b c") == 1
    assert s.weighted_ratio("", "x") == 0
    assert s.weighted_ratio("abc", "abc") == 1


def test_columns(spark):
    d = spark.createDataFrame([("a b", "b a"), (None, "x"), ("", "")], "a string, b string")
    got = [tuple(r) for r in d.select(s.similarity("token_sort_ratio", "a", "b"), s.token_jaccard("a", "b"), s.token_jaccard("a", "b", 1.0), s.agreement("a", "b")).collect()]
    assert got == [(1.0, 1.0, 1.0, -1), (0.0, 0.0, 0.0, 0), (1.0, 0.0, 1.0, 1)]
