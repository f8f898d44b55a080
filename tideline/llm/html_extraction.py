"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative,
and one linear scan finds the contiguous run with the largest sum: the content
region. What tags cost is learned from labelled pages (``html_labelled``), as is
which elements are boilerplate (by tag, role, class and id); words inside such
elements score nothing and never reach the text. The tags of content cost little,
so short first and last paragraphs pay for their tags.

Pages are independent of each other: one pass in Python workers, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_labelled import BOILERPLATE_MARK, PAGES

# Element names of HTML.
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg object select".split())
#: Without an end tag these reach to the end of the page.
_RAW_TO_END = frozenset(("script", "style", "xmp"))
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: A new one of these ends an open one of the same set.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_NAME = re.compile("</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_OF_OTHERS = frozenset(("has", "with", "no", "without"))
_UNQUOTED = re.compile(r"""([^"'>]++)|"[^"]*+"|'[^']*+'""")


@dataclass(slots=True)
class Element:
    name: str
    attributes: str
    start: int
    end: int = -1
    parent: int = -1
    closed: bool = False


@dataclass
class Page:
    """``runs``: raw texts between tags with their place among the tokens;
    ``tags``: (place, name) of every tag; ``elements``: what tags open."""

    runs: list[tuple[int, str, int]] = field(default_factory=list)
    tags: list[tuple[int, str]] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    size: int = 0


def parse(source: str) -> Page:
    """Tokens and elements of whole markup in one pass; broken markup never fails.

    Comments, doctypes and the content of scripts and the like are left out. A
    ``<`` that starts no tag is text. A tag may be of any length; one whose quotes
    never close, or that has no end outside quotes, ends at its first ``>``."""
    page = Page()
    stack: list[int] = []
    open_names: Counter = Counter()
    at, text_from, n, place = 0, 0, len(source), 0
    raw_ends: dict[str, bool] = {}
    # Places from which a tag has no end. A reader that fails passes them all unquoted, and one that starts at any of
    # them fails as it did. Two that start elsewhere differ in their quotes all along, so three at most fail anew.
    endless: bytearray | None = None

    def text(until: int) -> None:
        nonlocal place
        if until > text_from:
            page.runs.append((place, source[text_from:until], stack[-1] if stack else -1))
            place += 1

    def pop_to(depth: int, closed: bool) -> None:
        while len(stack) > depth:
            element = page.elements[stack.pop()]
            element.end = place
            element.closed = closed and len(stack) == depth
            open_names[element.name] -= 1

    while True:
        at = source.find("<", at)
        if at < 0 or at + 1 >= n:
            break
        c = source[at + 1]
        if c in "!?":
            text(at)
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                end = n if end < 0 else end + 3
            else:
                end = source.find(">", at)
                end = n if end < 0 else end + 1
            at = text_from = end
            continue
        m = None if endless and endless[at] else _TAG.match(source, at)
        if not m and not (endless and endless[at]) and _NAME.match(source, at):
            endless = endless or bytearray(n)
            step = at
            while part := _UNQUOTED.match(source, step):
                if part[1]:
                    endless[step : part.end()] = b"\1" * (part.end() - step)
                step = part.end()
        if m:
            end, slash, name, attributes = m.end(), m[1], m[2].lower(), m[3]
        elif c.isascii() and (c.isalpha() or c == "/" and source[at + 2 : at + 3].isalpha()):
            close = source.find(">", at)
            end = n if close < 0 else close + 1
            body = source[at + 1 : end].rstrip(">")
            slash = "/" if c == "/" else ""
            name, _, attributes = body.lstrip("/").partition(" ")
            name = name.lower()
        else:
            at += 1
            continue
        text(at)
        at = text_from = end
        if slash:
            page.tags.append((place, name))
            place += 1
            if open_names[name]:
                depth = len(stack) - 1
                while page.elements[stack[depth]].name != name:
                    depth -= 1
                pop_to(depth, True)
            continue
        if name in _BLOCK and open_names["p"] and name not in ("button", "option", "optgroup"):  # a block ends an open paragraph
            depth = len(stack) - 1
            while depth >= 0 and page.elements[stack[depth]].name not in _BLOCK:
                depth -= 1
            if depth >= 0 and page.elements[stack[depth]].name == "p":
                pop_to(depth, False)
        if name in _ENDS and stack and page.elements[stack[-1]].name in _ENDS[name]:
            pop_to(len(stack) - 1, False)
        page.tags.append((place, name))
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            place += 1
            continue
        page.elements.append(Element(name, attributes, place, parent=stack[-1] if stack else -1))
        stack.append(len(page.elements) - 1)
        open_names[name] += 1
        place += 1
        if name in _RAW:
            lower = f"</{name}"
            if raw_ends.get(name, True):
                m = re.compile(lower, re.IGNORECASE).search(source, at)
                raw_ends[name] = m is not None
                if m:
                    at = text_from = m.start()
            pop_to(len(stack) - 1, True)
            if raw_ends[name]:
                close = source.find(">", at)
                at = text_from = n if close < 0 else close + 1
            elif name in _RAW_TO_END:
                at = text_from = n  # any other one covers nothing without its end tag
    text(n)
    pop_to(0, False)
    page.size = place
    return page


def features(name: str, attributes: str) -> list[str]:
    """An element's features: its tag, role, and the words of its class and id,
    but for what such words say of other elements (``has-sidebar``)."""
    out = [f"<{name}>"]
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "")
        if kind.lower() == "role":
            out.append(f"role={value.strip().lower()}")
            continue
        for word in value.split():
            parts = [p.lower() for p in _PART.findall(word)]
            out += parts if not _OF_OTHERS.intersection(parts) else ["has"]
    return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Weights:
    """``tags``: the (negative) score of each tag, with ``other`` for tags never
    seen; ``elements``: log-odds that a feature speaks for content."""

    tags: dict[str, float]
    other: float
    elements: dict[str, float]
    bias: float

    def element(self, name: str, attributes: str) -> float:
        return self.bias + sum(self.elements.get(f, 0.0) for f in features(name, attributes))


def learn(pages: list[str], mark: str = BOILERPLATE_MARK, rounds: int = 3000, rate: float = 0.5, l2: float = 0.0005, bias: float = 1.0) -> Weights:
    """Weights from labelled pages, whose boilerplate elements bear the attribute
    ``mark``. Everything within these is boilerplate, and all else content.
    ``bias`` is fixed: an element of which nothing is known is content, and one
    page that shows a name in use is enough to learn it."""
    rows, labels = [], []
    plain = set()
    inside, outside = Counter(), Counter()
    for source in pages:
        page = parse(source)
        bad = np.zeros(len(page.elements), bool)
        for k, e in enumerate(page.elements):
            own = mark in e.attributes
            bad[k] = own or e.parent >= 0 and bad[e.parent]
            if own or not bad[k]:  # what lies within boilerplate says nothing of its own
                rows.append(features(e.name, e.attributes.replace(mark, "")))
                labels.append(not own)
                if not own:
                    plain.add(f"<{e.name}>")
        covered = np.zeros(page.size + 1, bool)
        for k, e in enumerate(page.elements):
            if bad[k]:
                covered[e.start : e.end + 1] = True
        for place, name in page.tags:
            (outside if covered[place] else inside)[name] += 1
    # Of tags that content uses too, only the words of class and id tell.
    rows = [[f for f in r if f not in plain] for r in rows]
    names = sorted({f for r in rows for f in r})
    number = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for k, r in enumerate(rows):
        x[k, [number[f] for f in r]] = 1
    y = np.array(labels, float)
    w = np.zeros(len(names))
    for _ in range(rounds):  # logistic regression; a kind is as heavy as the other
        p = 1 / (1 + np.exp(-(x @ w + bias)))
        g = (p - y) * np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        w -= rate * (x.T @ g / np.sqrt(np.maximum(x.sum(0), 1)) / 4 + l2 * w)
    n_in, n_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {t: np.log(((outside[t] + 1) / n_out) / ((inside[t] + 1) / n_in)) for t in {*inside, *outside}}
    tags = {t: -float(0.2 + max(0.0, v) / 2) for t, v in odds.items()}  # half of the odds for the tag that opens, half for the one that closes
    return Weights(tags, -1.0, dict(zip(names, w.tolist(), strict=True)), bias)


@cache
def default_weights() -> Weights:
    return learn(PAGES)


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """The contiguous run (start, end excluded) with the largest sum, in one
    linear scan; the first one on ties, and empty if no score is positive."""
    if not len(scores) or scores.max() <= 0:
        return 0, 0
    sums = np.r_[0.0, np.cumsum(scores)]
    lows = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - lows))
    start = int(np.flatnonzero(sums[:end] == lows[end])[0]) if end else 0
    return start, end


_NEVER_MAIN = frozenset(("aside", "nav", "footer", "head"))
_REPLIES = re.compile("comment|repl|response|disqus|teaser|related", re.IGNORECASE)


def _in_article(page: Page, element: int) -> bool:
    while element >= 0 and page.elements[element].name != "article":
        element = page.elements[element].parent
    return element >= 0


def _boilerplate(page: Page, weights: Weights, seen: dict) -> np.ndarray:
    """Whether each element is, or lies in, boilerplate."""
    n = len(page.elements)
    own = np.zeros(n, bool)
    for k, e in enumerate(page.elements):
        if e.name in _RAW or e.name == "head":
            own[k] = True
            continue
        key = (e.name, e.attributes)
        score = seen.get(key)
        if score is None:
            if len(seen) > 50_000:
                seen.clear()
            score = seen[key] = weights.element(e.name, e.attributes)
        own[k] = score < 0 and e.name != "h1"
    # An element around the page's main part is no boilerplate, whatever its name (a form around all, an article's header with its title).
    for k, e in enumerate(page.elements):
        if own[k] or e.name not in ("main", "article", "h1"):
            continue
        up = e.parent
        while up >= 0 and page.elements[up].name not in _NEVER_MAIN:
            around = page.elements[up]
            if own[up] and (_REPLIES.search(around.attributes) and e.name == "article" or around.name == "header" and not (e.name == "h1" and _in_article(page, up))):
                break
            own[up] = False
            up = around.parent
    out = own.copy()
    blocks = None
    for k, e in enumerate(page.elements):
        if own[k] and not e.closed and e.name in _BLOCK and e.name not in ("html", "body", "head"):
            # never closed: it reaches to the next block and no further
            if blocks is None:
                blocks = np.array([p for p, name in page.tags if name in _BLOCK], np.int64)
            after = np.searchsorted(blocks, e.start, side="right")
            e.end = min(e.end, int(blocks[after])) if after < len(blocks) else e.end
        if not out[k]:
            up = e.parent
            while up >= 0 and not (e.start < page.elements[up].end):
                up = page.elements[up].parent
            out[k] = up >= 0 and out[up]
    return out


def main_text(source: str | None, weights: Weights | None = None, seen: dict | None = None) -> str:
    """The main text of a page: its blocks in page order, joined by two newlines.

    Character references are decoded, white space within a block is one space. A
    null or empty page, and one without words outside boilerplate, gives ``""``.
    """
    if not source:
        return ""
    weights = weights or default_weights()
    page = parse(source)
    bad = _boilerplate(page, weights, {} if seen is None else seen)
    scores = np.zeros(page.size)
    for place, name in page.tags:
        scores[place] = weights.tags.get(name, weights.other)
    kept = []
    for place, raw, element in page.runs:
        up = element
        while up >= 0 and place >= page.elements[up].end >= 0:
            up = page.elements[up].parent
        if up < 0 or not bad[up]:
            words = len(html.unescape(raw).split())
            if words:
                scores[place] = words
            kept.append((place, raw))
    # Boilerplate is left out of the text, so it does not part what stands around it.
    edges_of = np.zeros(page.size + 1, np.int64)
    for k, e in enumerate(page.elements):
        if bad[k]:
            edges_of[e.start] += 1
            edges_of[e.end] -= 1
    scores[np.cumsum(edges_of[:-1]) > 0] = 0
    first, last = best_run(scores)
    if first == last:
        return ""
    breaks = sorted({p for p, name in page.tags if name in _BLOCK})
    spaces = {p for p, name in page.tags if name == "br"}
    blocks: list[str] = []
    parts: list[str] = []
    edge = 0

    def flush() -> None:
        if parts and (block := " ".join("".join(parts).split())):
            blocks.append(block)
        parts.clear()

    # Whole blocks: a region that starts inside one takes all of it.
    edges = np.array(breaks, np.int64)
    before = np.searchsorted(edges, first, side="right") - 1
    after = np.searchsorted(edges, last - 1)
    first = min(first, int(edges[before]) if before >= 0 else 0)
    last = max(last, int(edges[after]) if after < len(edges) else page.size)
    gaps = np.array(sorted(spaces), np.int64)
    gap = 0
    for place, raw in kept:
        if place < first:
            continue
        if place >= last:
            break
        while edge < len(edges) and edges[edge] < place:
            edge += 1
            if parts:
                flush()
        while gap < len(gaps) and gaps[gap] < place:
            gap += 1
            parts.append(" ")
        parts.append(html.unescape(raw))
    flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``html`` replaced by text and n_chars (its code points).

    A row per row; a null page gives the empty text; other columns stay as they
    are, but for any of the names text and n_chars, which are replaced; an empty
    table gives an empty result.
    """
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    weights = pages.sparkSession.sparkContext.broadcast(default_weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            texts = [main_text(x.as_py(), weights.value, seen) for x in batch.column(0)]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # a reference to half a surrogate pair is no character
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*others, "text", "n_chars"]
            )

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in others)
    return pages.select(F.col(html_col).cast("string"), *others).mapInArrow(run, f"{kinds}text string, n_chars long")
