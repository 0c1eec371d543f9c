"""String similarity on a scale of 0 to 1.

Ratios rest on the longest common subsequence (LCS), found with big integers as bit sets, so a pair
costs a few operations for each letter of the longer text. The public definitions are kept:

ratio         2 LCS / (both lengths); two empty texts are alike
partial       best ratio of the shorter text with a window of the longer one of its length
token sort    ratio of the texts with their tokens sorted
token set     of the shared tokens alone and with either rest, the best ratio; 0 if a text is empty
jaro-winkler  Jaro similarity, raised for a common start of up to four letters
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import blank, col


def letter_bits(b: str) -> dict[str, int]:
    """Where each letter stands in a text, as bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def lcs_row(where: dict[str, int], n: int, a: str) -> int:
    """A row of n bits for a text of n letters whose bits are given: the zeros among the first k are
    the LCS of `a` with the first k letters, for every k at once."""
    full = row = (1 << n) - 1
    get = where.get
    for ch in a:
        m = get(ch)
        if m:
            hit = row & m
            row = (row + hit | row - hit) & full
    return row


def lcs_bits(where: dict[str, int], n: int, a: str) -> int:
    """LCS of a text with one of n letters whose bits are given."""
    return n - lcs_row(where, n, a).bit_count()


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    return lcs_bits(letter_bits(b), len(b), a) if b else 0


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 1.0 if not n else 1.0 if a == b else 2 * lcs(a, b) / n


def _hanging(short: str, long: str, best: float) -> float:
    """Best ratio, if above `best`, of a text with the shorter starts of the other: one row has them all."""
    n = len(short)
    part = long[: n - 1]
    row = lcs_row(letter_bits(part), len(part), short)
    for k in range(len(part), 0, -1):
        if 2 * k / (n + k) <= best:
            break
        best = max(best, 2 * (k - (row & (1 << k) - 1).bit_count()) / (n + k))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with the windows of the longer one; windows that hang over
    either end count too. Texts of equal length are tried both ways round.

    The LCS of neighbouring windows differs by at most one, so windows that cannot beat the best
    are skipped; those that hang over an end are read off one row for each end."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 1.0
    n, where = len(a), letter_bits(a)
    most = i = 0
    while i <= len(b) - n:
        shared = lcs_bits(where, n, b[i : i + n])
        most = max(most, shared)
        i += most - shared + 1
    best = most / n
    for short, long in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        best = _hanging(short, long, best)
        best = _hanging(short[::-1], long[::-1], best)
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not only_x or not only_y):
        return 1.0
    gap = bool(shared)
    nx, ny = (len(shared) + gap + len(r) for r in (only_x, only_y))
    # The texts with their shared start differ by what their rests do not share.
    apart = len(only_x) + len(only_y) - 2 * lcs(only_x, only_y)
    best = 1 - apart / (nx + ny) if nx + ny else 0.0
    if shared:
        best = max(best, 2 * len(shared) / (len(shared) + nx), 2 * len(shared) / (len(shared) + ny))
    return best


def partial_token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 1.0
    return partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x)))


def weighted_ratio(a: str, b: str) -> float:
    """The best of ratio and weighted token and partial ratios; partial ones count where one text
    is at least half as long again as the other."""
    return all_ratios(a, b, ("weighted_ratio",))[0]


def all_ratios(a: str, b: str, kinds: tuple[str, ...]) -> tuple[float, ...]:
    """Several ratios of a pair; what one needs of another is computed once."""
    known: dict[str, float] = {}

    def get(kind: str) -> float:
        if kind not in known:
            known[kind] = weighted() if kind == "weighted_ratio" else _RATIOS[kind](a, b)
        return known[kind]

    def weighted() -> float:
        if not a or not b:
            return 0.0
        far = max(len(a), len(b)) / min(len(a), len(b))
        if far < 1.5:
            return max(get("ratio"), 0.95 * max(get("token_sort_ratio"), get("token_set_ratio")))
        scale = 0.9 if far <= 8 else 0.6
        sorted_tokens = partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
        return max(get("ratio"), scale * get("partial_ratio"), 0.95 * scale * max(sorted_tokens, partial_token_set(a, b)))

    return tuple(get(k) for k in kinds)


_RATIOS = {f.__name__: f for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio)}


def jaro_winkler(a: str, b: str, prefix: float = 0.1) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * start * (1 - jaro) if jaro > 0.7 else jaro


class Grid:
    """Texts of at most 64 letters (or as many as `bits` has) as numbers: for each place of a text its letter, and for each letter
    the places it has in each text, as bits. A letter that the other side lacks has number 0 and no places."""

    def __init__(self, texts: list[str], number: dict[str, int], bits: type) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        most = int(self.sizes.max(initial=0))
        letters = np.array(texts, f"U{most or 1}").view(np.uint32).reshape(len(texts), -1).T[:most]
        known = np.array(sorted(map(ord, number)), np.uint32)  # numbers go by letter
        at = np.searchsorted(known, letters)
        found = (np.append(known, 0)[at] == letters) & (at < len(known)) & (np.arange(most)[:, None] < self.sizes)
        self.codes = np.where(found, at + 1, 0)
        self.places = np.zeros((len(known) + 1, len(texts)), bits)
        for p, code in enumerate(self.codes):
            self.places[code, np.arange(len(texts))] |= bits(1 << p)
        self.places[0] = 0


def _numbered(a: list[str], b: list[str]) -> tuple[dict[str, int], type]:
    bits = np.uint32 if max(map(len, (*a, *b))) <= 32 else np.uint64
    return {ch: i + 1 for i, ch in enumerate(sorted(set("".join(a)) & set("".join(b))))}, bits


def lcs_rows(a: Grid, b: Grid) -> np.ndarray:
    """lcs_row of each text of b for each of a; bits beyond a text's length mean nothing."""
    row = np.full((len(a.sizes), len(b.sizes)), np.iinfo(b.places.dtype).max, b.places.dtype)
    for code in a.codes:
        hit = b.places[code]
        hit &= row
        rest = row - hit
        row += hit
        row |= rest
    return row


def ratio_grids(a: list[str], b: list[str], kinds: tuple[str, ...], finish: Callable[[np.ndarray], np.ndarray] = np.asarray) -> list[np.ndarray] | None:
    """all_ratios of each text of a with each of b, passed through finish, if all are one token of one
    length, at most 64; else None."""
    n = len(a[0])
    if not 0 < n <= 64 or any(len(t) != n or t.split() != [t] for t in (*a, *b)):
        return None
    number, bits = _numbered(a, b)
    x, y = Grid(a, number, bits), Grid(b, number, bits)
    rows = lcs_rows(x, y)
    shared = n - np.bitwise_count(rows & bits((1 << n) - 1))
    # Ratios by the length of the common subsequence.
    alike = np.array([2 * k / (2 * n) for k in range(n + 1)])
    sets = np.array([1 - (2 * n - 2 * k) / (2 * n) for k in range(n + 1)])
    weighted = np.array([max(p, 0.95 * max(p, q)) for p, q in zip(alike, sets, strict=True)])
    tables = {"ratio": alike, "token_sort_ratio": alike, "token_set_ratio": sets, "weighted_ratio": weighted}
    out = {k: finish(v)[shared] for k, v in tables.items() if k in kinds}
    if "partial_ratio" in kinds:
        back = [t[::-1] for t in a], [t[::-1] for t in b]
        u, v = Grid(back[0], number, bits), Grid(back[1], number, bits)
        best = shared / n
        for get in (lambda: rows, lambda: lcs_rows(y, x).T, lambda: lcs_rows(u, v), lambda: lcs_rows(v, u).T):
            least = best.min()
            row = get()
            for k in range(n - 1, 0, -1):
                if 2 * k / (n + k) <= least:
                    break
                value = np.array([2 * s / (n + k) for s in range(k + 1)])
                np.maximum(best, value[k - np.bitwise_count(row & bits((1 << k) - 1))], out=best)
        out["partial_ratio"] = finish(best)
    return [out[k] for k in kinds]


def jaro_winkler_grid(a: list[str], b: list[str], prefix: float = 0.1) -> np.ndarray | None:
    """jaro_winkler of each text of a with each of b, if none is empty or longer than 64 letters; else None."""
    if any(not 0 < len(t) <= 64 for t in (*a, *b)):
        return None
    number, bits = _numbered(a, b)
    x, y = Grid(a, number, bits), Grid(b, number, bits)
    la, lb = x.sizes[:, None], y.sizes[None, :]
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    one = bits(1)
    free = np.full((len(a), len(b)), np.iinfo(bits).max, bits)
    taken = np.zeros_like(free)
    same = np.ones(free.shape, bool)
    start = np.zeros(free.shape, np.uint8)
    ends = int(np.iinfo(bits).max)
    spans = {r: [bits(((1 << i + r + 1) - 1) & ~((1 << max(0, i - r)) - 1) & ends) for i in range(len(x.codes))] for r in np.unique(reach).tolist()}
    for i, code in enumerate(x.codes):
        where = y.places[code]
        if i < 4:
            same &= (where >> bits(i) & one).astype(bool)
            start += same
        if len(spans) == 1:
            where &= next(iter(spans.values()))[i]
        else:
            span = np.zeros(65, bits)
            for r, s in spans.items():
                span[r] = s[i]
            where &= span[reach]
        where &= free
        where &= bits(0) - where  # the first free place
        free ^= where
        taken |= (where != 0).astype(bits) << bits(i)
    left = ~free
    m = np.bitwise_count(left)
    swaps = np.zeros(free.shape, np.uint8)
    for i, code in enumerate(x.codes):
        low = bits(0) - left
        low &= left
        low *= taken >> bits(i) & one
        left ^= low
        met = y.places[code]
        met &= low
        swaps += met != low
    swaps //= 2
    m, swaps = m.astype(float), swaps.astype(float)
    jaro = np.where(m > 0, (m / la + m / lb + (m - swaps) / np.maximum(m, 1)) / 3, 0.0)
    return np.where(jaro > 0.7, jaro + prefix * start * (1 - jaro), jaro)


def _pairwise(f):
    @pandas_udf(DoubleType())
    def kernel(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(a, b, strict=True):
            if p not in known:
                known[p] = f(p[0] or "", p[1] or "")
            out.append(known[p])
        return pd.Series(out, dtype="float64")

    return kernel


_KERNELS = {f.__name__: _pairwise(f) for f in (ratio, partial_ratio, token_sort_ratio, token_set_ratio, weighted_ratio, jaro_winkler)}


def similarity(kind: str, a: str | Column, b: str | Column) -> Column:
    """A similarity of two columns, by the name of its function; null counts as empty."""
    return _KERNELS[kind](blank(a), blank(b))


def similarities(kinds: tuple[str, ...], a: str | Column, b: str | Column) -> Column:
    """A struct of several ratios of two columns, by the names of their functions; null counts as empty.
    A batch is worked on by distinct pairs, and ratios share what they have in common."""

    @pandas_udf(StructType([StructField(k, DoubleType()) for k in kinds]))
    def kernel(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple[float, ...]] = {}
        out = []
        for p in zip(x, y, strict=True):
            if p not in known:
                known[p] = all_ratios(p[0] or "", p[1] or "", kinds)
            out.append(known[p])
        return pd.DataFrame(out, columns=list(kinds), dtype="float64")

    return kernel(blank(a), blank(b))


def token_jaccard(a: str | Column, b: str | Column, both_empty: float = 0.0) -> Column:
    """Shared over all distinct tokens of two cleaned texts."""
    x, y = (F.filter(F.array_distinct(F.split(blank(c), " ")), lambda t: t != "") for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(x, y)) / union)


def agreement(a: str | Column, b: str | Column) -> Column:
    """1 equal, -1 different, 0 if either is null."""
    x, y = col(a), col(b)
    return F.when(x.isNull() | y.isNull(), 0).when(x == y, 1).otherwise(-1)
