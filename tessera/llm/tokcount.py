"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie; each node v has a failure link and the number of pieces popped on
taking it, so that scanning a word costs a number of steps linear in its length and the pieces are
never built. For node v with string s: if s is a piece, the link leads to the root and one piece is
popped; else the link leads to where the rest of s stands after its longest pieces are taken off.
(The definition of the link by the parent's is that of Song et al. 2021, "Fast WordPiece
Tokenization".)

Words are maximal runs of letters, single digits, or runs of other signs, lower-cased; a vocabulary
with an end-of-word mark has it appended to each word. A word that the vocabulary cannot cover
counts as one unknown token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, blobs

WORD = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
END = "</w>"
#: Distinct chunks a worker remembers before it forgets all, and letters of the longest of them.
REMEMBERED, LONGEST = 400_000, 64


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 bytes stand
    for themselves, the others are counted off from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass
class Automaton:
    """next[node] maps a letter to a node; fail and popped as described above (-1: no link)."""

    next: list[dict[str, int]]
    fail: list[int]
    popped: list[int]

    def count(self, word: str) -> int:
        """Pieces of the greedy longest-match cover of a word, -1 if there is none."""
        node, total = 0, 0
        step, fail, popped = self.next, self.fail, self.popped
        for ch in word:
            while ch not in step[node]:
                if fail[node] < 0:
                    return -1
                total += popped[node]
                node = fail[node]
            node = step[node][ch]
        while node:
            if fail[node] < 0:
                return -1
            total += popped[node]
            node = fail[node]
        return total


def build(pieces: list[str]) -> Automaton:
    """The automaton of a vocabulary; the empty string is no piece."""
    step: list[dict[str, int]] = [{}]
    is_piece = [False]
    for piece in pieces:
        node = 0
        for ch in piece:
            node = step[node].setdefault(ch, len(step))
            if node == len(step):
                step.append({})
                is_piece.append(False)
        is_piece[node] = bool(piece)
    fail, popped = [-1] * len(step), [0] * len(step)
    level = [0]
    while level:
        deeper = []
        for u in level:
            for ch, v in step[u].items():
                deeper.append(v)
                if is_piece[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                at, taken = fail[u], popped[u]
                while at >= 0 and ch not in step[at]:
                    taken += popped[at]
                    at = fail[at]
                if at >= 0:
                    fail[v], popped[v] = step[at][ch], taken
        level = deeper
    return Automaton(step, fail, popped)


def load(path: str) -> tuple[Automaton, bool]:
    """The automaton of a vocabulary file of the tokenizers library, and whether its words end in
    a mark."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return build(list(vocab)), any(v.endswith(END) for v in vocab)


_LETTERS = byte_letters()
_LOADED: dict[str, tuple[Automaton, bool]] = {}


class Counter:
    """Counts the pieces of whole texts, remembering the words it has met."""

    def __init__(self, automaton: Automaton, ends: bool) -> None:
        self.automaton, self.end = automaton, END if ends else ""
        self.chunks: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.automaton.count("".join([_LETTERS[b] for b in word.encode()]) + self.end)
        return 1 if n < 0 else n

    def __call__(self, text: str) -> int:
        """Pieces of a text. Chunks between spaces are counted once for each distinct chunk: no
        word crosses a space."""
        known = self.chunks
        chunks = text.lower().split()
        try:
            return sum([known[c] for c in chunks])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            total = 0
            for c in chunks:
                n = known.get(c)
                if n is None:
                    n = sum(map(self.word, WORD.findall(c)))
                    if len(c) <= LONGEST:
                        known[c] = n
                total += n
            return total


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = load(path)
    return Counter(*_LOADED[path])


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, n_chars): one row for each row of docs (doc_id, text).

    `vocabulary` is a path that every machine can open, as for any installed file. Null and empty
    texts have no token; equal rows are all returned; an empty table gives an empty result; other
    columns are ignored."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            texts = [x.decode("utf-8", "replace") for x in blobs(b.column(1))]
            n = np.fromiter(map(count, texts), np.int64, len(texts))
            yield pa.record_batch([b.column(0), pa.array(n), pa.array([len(x) for x in texts], pa.int64())], names=["doc_id", "n_tokens", "n_chars"])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), kernel, "doc_id long, n_tokens long, n_chars long")
