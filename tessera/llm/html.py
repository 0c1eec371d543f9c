"""Main-text extraction by minimum-cut labelling.

A page becomes a sequence of text blocks. A classifier gives a cost for calling a block content and
one for calling it boilerplate: the capacities of its edges to the two terminals. It adds where the
block stands (its elements, their classes and ids) and what it is like (length, links, sentences,
depth, place). The weights of the latter are fitted to the pages themselves, all of them: blocks of
marked articles against blocks of menus, footers, sidebars and forms, by counts of binned features
(naive Bayes), so that they judge the blocks of pages that mark nothing. Neighbouring blocks, more so under one parent, and siblings across what stands between
them are joined by smoothness edges. The minimum cut is the labelling of least total cost; blocks on
the content side are returned in page order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, blobs

#: Elements whose text is never text of the page.
SILENT = frozenset("script style noscript template svg canvas iframe object select option textarea button audio video title head datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Where a new element of this name closes an open one of these.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
CLOSES |= {x: {"p"} for x in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
SCOPES = frozenset("article section div main body table ul ol nav aside footer header form td th blockquote dl".split())
#: Elements that are furniture, and words of class, id or role that name it: surely, or where nothing speaks against.
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
SURE = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion
    banner banners sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar toolbar cookie
    cookies consent gdpr newsletter subscribe signup login comment comments commentlist replies disqus pager pagination
    contentinfo complementary""".split()
)
LIKELY = frozenset(
    """header footer notice notices alert alerts popup popups modal overlay discussion reply share sharing social related
    recommended recommendations widget widgets skip copyright legal disclaimer search""".split()
)
#: Words for a part of a page, which leave the meaning to the word before.
PARTS = frozenset(
    """area bar block blocks body bottom box button buttons container content entry form group head icon icons inner item items left
    link links list main outer page panel panels post posts right row section sections site slot text thread title top unit wrap wrapper""".split()
)
CONTENT_WORDS = frozenset("article content main post entry story body text".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What can end a tag or open a quoted value.
_STOP = re.compile(r"[<>]|=\s*+[\"']")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|style|aria-hidden|hidden)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.I)
_WORD = re.compile(r"[a-z]+")
_ENDS = ".!?…。"


def tokens(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name, attributes, whether it is an end tag) of each tag; comments and
    declarations have no name. Linear in the length: each look ahead is either part of what is
    returned or turns itself off."""
    at, size, quotes = 0, len(html), True
    while True:
        at = html.find("<", at)
        if at < 0:
            return
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = size if end < 0 else end + 3
            yield at, end, "", "", False
            at = end
            continue
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            if end < 0:
                return
            yield at, end + 1, "", "", False
            at = end + 1
            continue
        closing = html.startswith("</", at)
        m = _NAME.match(html, at + 1 + closing)
        if not m:
            at += 1
            continue
        begin = place = m.end()
        stop = -1
        while quotes:
            found = _STOP.search(html, place)
            if not found:
                quotes = False
            elif found[0] in "<>":
                stop = found.start()
                break
            else:
                place = html.find(found[0][-1], found.end()) + 1
                quotes = place > 0
        if stop < 0:
            # A quote that is never closed: from here on the next > ends a tag.
            stop = html.find(">", begin)
            if stop < 0:
                return
        end = stop + (html[stop] == ">")
        new = yield at, end, m[0].lower(), html[begin:stop], closing
        at = end if new is None else new


def furniture(classes: str) -> float:
    """How much a class, id or role says that an element is furniture: 1 for a sure word, less for a
    likely one, 0 for none. A name of several words counts by its last (a cookie notice is a notice,
    a notice board is none), or by its first before words for parts of a page."""
    most = 0.0
    for name in classes.lower().split():
        words = _WORD.findall(name)
        while len(words) > 1 and words[-1] in PARTS:
            words.pop()
        if words:
            last = words[-1]
            most = max(most, 1.0 if last in SURE or last in LIKELY and not SURE.isdisjoint(words) else 0.6 if last in LIKELY else 0.0)
    return most


class Element:
    """An open element: what its own and its parents' marks say."""

    __slots__ = ("block", "depth", "furniture", "hidden", "inside", "marks", "name", "number", "parent", "silent")

    def __init__(self, name: str, parent: Element | None, number: int = 0) -> None:
        self.name, self.parent, self.number = name, parent, number
        self.depth = parent.depth + 1 if parent else 0
        self.silent = name in SILENT or bool(parent and parent.silent)
        self.hidden = bool(parent and parent.hidden)
        self.inside = bool(parent and parent.inside)  # of the article
        self.furniture = parent.furniture if parent else 0.0  # by elements
        self.marks = parent.marks if parent else 0.0  # by classes
        #: The element that holds the text: this, or the one that an inline element is in.
        self.block: Element = parent.block if parent and name in INLINE else self


@dataclass
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _element(name: str, attrs: str, parent: Element, number: int) -> Element:
    e = Element(name, parent, number)
    classes = ""
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "style":
                e.hidden |= "display:none" in value.replace(" ", "")
            elif key == "hidden":
                e.hidden = True
            elif key == "aria-hidden":
                e.hidden |= value == "true"
            else:
                classes += " " + value
    if name in ("html", "body"):
        return e
    if name in ("article", "main"):
        e.inside, e.hidden = True, parent.hidden
        return e
    mark = furniture(classes) if classes else 0.0
    if name in FURNITURE or name == "header" and not parent.inside:
        # The head of the page goes; the head of an article holds its title.
        e.furniture += 6
    if e.inside:
        # In the article, its own text elements are rarely furniture, and hidden text is still its text.
        e.hidden = parent.hidden
        if name in INLINE or name == "header" or "header" in classes:
            mark = 0.0
        elif name in ("p", "li", "ul", "ol", "dl", "blockquote", "table", "pre", *HEADINGS) and mark < 1:
            mark /= 4
    elif not mark and not parent.furniture and not parent.marks and set(_WORD.findall(classes)) & CONTENT_WORDS:
        e.inside = True
    e.marks = max(parent.marks, 6 * mark)
    return e


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, white space folded; silent text is left out, and hidden
    text outside an article."""
    root = Element("#root", None)
    stack, out, current = [root], [], None
    opened: Counter[str] = Counter()
    at, number, links = 0, 0, 0

    def text(s: str) -> None:
        nonlocal current
        if not s:
            return
        top = stack[-1]
        if top.silent or top.hidden:
            return
        if "&" in s:
            s = unescape(s)
        if current is None:
            current = Block(top.block)
            out.append(current)
        current.parts.append(s)
        if links:
            current.linked += len(s)

    def close(to: int) -> None:
        nonlocal links
        for e in stack[to:]:
            links -= e.name == "a"
            opened[e.name] -= 1
        del stack[to:]

    def close_nearest(names: set[str] | frozenset[str], not_beyond: frozenset[str] = frozenset()) -> None:
        if any(opened[n] > 0 for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    close(k)
                    break
                if stack[k].name in not_beyond:
                    break

    size, folded = len(html), None
    tags = tokens(html)
    tag = next(tags, None)
    while tag:
        start, end, name, attrs, closing = tag
        text(html[at:start])
        at, skip = end, None
        if name and name not in INLINE:
            current = None
        if not name or name in VOID:
            pass
        elif closing:
            if opened[name] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        close(k)
                        break
                    # An inline end tag does not reach out of its block.
                    if name in INLINE and stack[k].name not in INLINE:
                        break
        else:
            shut = CLOSES.get(name)
            if shut:
                close_nearest(shut, SCOPES)
            if name in ("nav", "footer", "aside", "header", "article", "main", "section", "div", "form", "h1", "p"):
                # Inline elements left open end with their block.
                while len(stack) > 1 and stack[-1].name in INLINE:
                    close(len(stack) - 1)
            if name == "body":  # a head that was never closed
                close_nearest({"head"})
            if name in RAW:
                folded = folded if folded is not None else html.lower()
                last = (folded if len(folded) == size else html).find(f"</{name}", at)
                stop = html.find(">", last) if last >= 0 else -1
                at = skip = stop + 1 if stop >= 0 else size
            elif not attrs.rstrip().endswith("/"):
                number += 1
                stack.append(_element(name, attrs, stack[-1], number))
                opened[name] += 1
                links += name == "a"
        try:
            tag = tags.send(skip)
        except StopIteration:
            tag = None
    text(html[at:])
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


KINDS = {"p": 0, "li": 1, "dd": 1, "dt": 1, "td": 2, "th": 2, **dict.fromkeys(HEADINGS, 3)}
BINS = 16
#: Blocks of each side that a fit takes at least; else the weights below are used.
LEAST_BLOCKS = 50


def features(found: list[Block]) -> np.ndarray:
    """A row of bins (0 to BINS - 1) for each block: length, linked share, sentence ends, element,
    depth, place in the page."""
    out = []
    for i, b in enumerate(found):
        n = len(b.text)
        ends = sum(map(b.text.count, _ENDS))
        out.append(
            (
                min(BINS - 1, n.bit_length()),
                -(-8 * min(b.linked, n) // n),
                min(BINS - 1, ends and 1 + 200 * ends // (n + 100)),
                KINDS.get(b.parent.name, 4),
                min(BINS - 1, b.parent.depth),
                8 * i // len(found),
            )
        )
    return np.array(out, np.int64).reshape(-1, 6)


#: Log-odds by feature and bin where no pages have marks to fit to: longer, unlinked sentences are content.
PLAIN = np.zeros((6, BINS))
PLAIN[0] = np.minimum(1.2, 2.0 ** np.arange(BINS) / 250)
PLAIN[1, :9] = -2.5 * np.arange(9) / 8
PLAIN[2, 1:] = 0.8
PLAIN[3, 3] = 1.0


def _counts(found: list[Block]) -> np.ndarray:
    """Blocks by side (furniture, article), feature and bin, of a page that marks its article."""
    total = np.zeros((2, 6, BINS), np.int64)
    if any(b.parent.inside for b in found):
        x = features(found)
        side = np.array([1 if b.parent.inside and not b.parent.furniture and not b.parent.marks else 0 if b.parent.furniture else -1 for b in found])
        for k in (0, 1):
            for j in range(6):
                total[k, j] = np.bincount(x[side == k, j], minlength=BINS)
    return total


def weights(total: np.ndarray) -> np.ndarray:
    """Log-odds of each bin from the counts. Features are not independent, so half of their sum counts."""
    if total[:, 0].sum(1).min() < LEAST_BLOCKS:
        return PLAIN
    share = (total + 1.0) / (total.sum(2, keepdims=True) + BINS)
    return 0.5 * np.log(share[1] / share[0])


def fit(pages: DataFrame) -> np.ndarray:
    """The weights of the text features from all pages (html): 2 x 6 x BINS counts, whatever the
    number of pages."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 6, BINS), np.int64)
        for b in batches:
            for x in blobs(b.column(0)):
                total += _counts(blocks(x.decode("utf-8", "replace")))
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["i", "n"])

    rows = arrow(pages.select(F.col("html").cast("string").alias("html")), kernel, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(2 * 6 * BINS, np.int64)
    for r in rows:
        total[r["i"]] = r["n"]
    return weights(total.reshape(2, 6, BINS))


#: Most that the text of a block counts for, against its marks.
TEXT_LIMIT = 2.5


def scores(found: list[Block], fitted: np.ndarray = PLAIN) -> list[float]:
    """Log-odds that each block is content. What the page marks counts most; a mark by a class that
    holds most of the text of a page without an article is no mark."""
    marked = any(b.parent.inside for b in found)
    whole = sum(len(b.text) for b in found)
    by_class = sum(len(b.text) for b in found if b.parent.marks and not b.parent.furniture)
    believed = marked or 2 * by_class < whole
    text = np.clip(fitted[np.arange(6), features(found)].sum(1), -TEXT_LIMIT, TEXT_LIMIT)
    out = []
    for b, t in zip(found, text.tolist(), strict=True):
        e = b.parent
        out.append(0.2 + t + 4.0 * e.inside - 1.6 * (e.furniture + e.marks * believed) - 3.5 * (marked and not e.inside) + 0.5 * (e.name in HEADINGS))
    return out


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: node i pays unary[i] if it is labelled False and unary[i] > 0, or
    -unary[i] if it is labelled True and unary[i] < 0; an edge pays its weight if its ends differ.
    Shortest augmenting paths by levels (Dinic), on integers."""
    n = len(unary)
    if all(u >= 0 for u in unary):
        return [True] * n
    if all(u <= 0 for u in unary):
        return [False] * n
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, u in enumerate(unary):
        c = round(abs(u) * 1000)
        if u > 0:
            link(source, i, c, 0)
        else:
            link(i, sink, c, 0)
    for a, b, w in edges:
        link(a, b, round(w * 1000), round(w * 1000))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in out[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                # Go back to the tail of the first edge that is full.
                k = next(k for k, e in enumerate(path) if not cap[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            found = False
            while place[a] < len(out[a]):
                e = out[a][place[a]]
                if cap[e] and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    found = True
                    break
                place[a] += 1
            if found:
                continue
            if a == source:
                break
            level[a] = -1
            e = path.pop()
            a = to[e ^ 1]


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the text (closer in the tree: stronger) and between a block and
    the last one before its neighbour that has the same parent element's parent."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        up = b.parent.parent.number if b.parent.parent else -1
        if i:
            before = found[i - 1].parent
            near = before is b.parent or before.parent is b.parent.parent
            edges.append((i - 1, i, 0.6 if near else 0.1))
        if up in last and last[up] != i - 1:
            edges.append((last[up], i, 0.3))
        last[up] = i
    return edges


def extract(html: str, fitted: np.ndarray = PLAIN) -> str:
    """The main text of a page: content blocks joined by one space."""
    found = blocks(html)
    labels = min_cut(scores(found, fitted), smoothness(found)) if found else []
    return " ".join(b.text for b, keep in zip(found, labels, strict=True) if keep)


def main_text(pages: DataFrame, fitted: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of pages (page_id, url, html). The weights
    of text features are fitted to these pages unless they are given.

    A null or empty html, or one without content, gives an empty text of 0 characters; bytes that
    are not UTF-8 are replaced; equal rows are all returned; an empty table gives an empty result;
    other columns are ignored."""

    model = fit(pages) if fitted is None else fitted

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.decode("utf-8", "replace"), model) for x in blobs(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), kernel, "page_id long, url string, text string, n_chars long")
