"""Licence scans by conditional compression.

A candidate block is a stretch of words that holds every wording around a cue
whole, across blank lines. It is compressed with zstandard, once alone and once
for each licence with that licence's wordings as the raw dictionary; the licences
are ranked by how much their dictionary saves, and the first in that order that
its exact wording differences confirm has won: the words of a wording that the
block lacks and those that the block has more. Nothing is left out by its rank,
for a short notice may save no byte. What is confirmed leaves the block, and what
remains left and right of it is looked at again, so blocks with several licences
give them all.

Long texts (``license_texts.long_texts``) have blocks of their own: a text with
few differences has a stretch of words intact, so a block is where one of its
eight-word grams stands, as long as the text.

Long stretches with cues are cut into blocks that overlap by the longest wording,
so that none is cut in all of them. Documents are independent of each other: one
pass, without a shuffle. Documents without a cue never reach Python.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER
from .license_texts import LEADS, LICENSES, long_texts

#: Characters between cues of one block, and around them.
REACH = 400
#: Wrapped lines have at most so many characters, and of those that follow or precede a cue's so many belong to it.
WRAPPED = 200
FOLLOWING = 1_000
#: A longer block is cut into overlapping ones; in words for what is compared, in characters for what has no licence.
BLOCK_WORDS = 2_400
BLOCK = 16_384
OVERLAP = 4_096
#: Words of a gram of a long text, and the distance of those that are looked for; a stretch of GRAM + STEP - 1 words has one.
GRAM = 8
STEP = 4
#: Share of a whole text's words that may be missing or additional.
TOLERANCE = 0.08
CACHE_BLOCKS = 20_000

_LOWER = str.maketrans(UPPER, LOWER)
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: In a wording a star stands for other words; in a text it is none (comments have them at each line's begin).
_WORD_OR_STAR = re.compile(rf"\*|{_WORD.pattern}")
#: Words that a long text of another licence has.
_DECISIVE_IN_LONG = re.compile("lesser|affero|noncommercial|sharealike|noderivatives")
#: Words by which licences differ although most of their wording is the same.
_DECISIVE = re.compile(r".*\d|lesser|affero|by|sa|nc|nd|noncommercial|sharealike|noderivatives|neither|endorse")


@dataclass(frozen=True)
class Wording:
    """A whole licence text; ``counts``: of its words; ``gaps``: numbers of the words before which other
    words may stand."""

    words: tuple[str, ...]
    gaps: frozenset[int]
    counts: Counter = field(compare=False)

    @property
    def slack(self) -> int:
        """Additional words to look at on either side."""
        return len(self.words) // 5 + 40 * len(self.gaps) + 12


@dataclass
class License:
    """``notices``: what a notice says, word by word, as lead and name."""

    name: str
    texts: list[Wording]
    notices: frozenset[tuple[str, ...]]
    long: list[Wording]
    compressor: zstandard.ZstdCompressor = field(repr=False)
    #: With the long text as well.
    whole: zstandard.ZstdCompressor = field(repr=False)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def words_and_stars(text: str) -> list[str]:
    return _WORD_OR_STAR.findall(text.translate(_LOWER))


def _any_of(phrases: set[str]) -> str:
    """A pattern for the phrases' words with anything between them."""
    return "|".join(sorted({_BETWEEN.join(re.escape(w) for w in words_of(p)) for p in phrases}))


_BETWEEN = "[^a-zA-Z0-9]+"
#: Words that licences use, and every notice: a lead before a name. Leads or names alone are common words.
CUE = (
    r"(?i)licen[sc]|copyright|©|spdx|warrant|public domain|creative commons|cc[ -]by|cc0|gpl"
    rf"|(?:{_any_of(set(LEADS))}){_BETWEEN}(?:the{_BETWEEN})?(?:{_any_of({n for _, names in LICENSES.values() for n in names})})"
)
_CUE = re.compile(CUE)


def _wording(text: str) -> Wording:
    words, gaps = [], set()
    for w in words_and_stars(text):
        if w == "*":
            gaps.add(len(words))
        else:
            words.append(w)
    return Wording(tuple(words), frozenset(gaps), Counter(words))


def _long_wording(text: str) -> Wording:
    words = tuple(words_of(text))
    return Wording(words, frozenset(), Counter(words))


def _compressor(dictionary: bytes | None) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


@cache
def licenses() -> tuple[License, ...]:
    out, longs = [], long_texts()
    for name, (texts, names) in LICENSES.items():
        long = [longs[name]] if name in longs else []
        notices = frozenset(tuple(words_of(f"{lead} {the}{n}")) for n in names for lead in LEADS for the in ("", "the "))
        # nearer to the end is cheaper to refer to, so whole texts come last
        dictionary = "\n".join([f"{lead} {n}. {lead} the {n}." for n in names for lead in LEADS[:2]] + [" ".join(t.split()) for t in texts])
        whole = "\n".join([dictionary, *(" ".join(t.split()) for t in long)])
        out.append(License(name, [_wording(t) for t in texts], notices, [_long_wording(t) for t in long], _compressor(dictionary.encode()), _compressor(whole.encode())))
    return tuple(out)


@cache
def _plain() -> zstandard.ZstdCompressor:
    return _compressor(None)


def rank(block: str, whole: bool = False) -> list[tuple[int, License]]:
    """All licences by the bytes that their dictionary (with ``whole``, that of
    the long text as well) saves, most first; ties are in order of the licence
    list."""
    data = " ".join(block.split()).encode("utf-8", "replace")
    alone = len(_plain().compress(data))
    saved = [(alone - len((x.whole if whole else x.compressor).compress(data)), x) for x in licenses()]
    return sorted(saved, key=lambda s: -s[0])


@cache
def _starts() -> tuple[frozenset[str], list[int]]:
    notices = [n for x in licenses() for n in x.notices]
    return frozenset(n[0] for n in notices), sorted({len(n) for n in notices}, reverse=True)


def notice(found: License, words: list[str]) -> tuple[int, int] | None:
    """Where a notice of the licence first stands, the longest one there."""
    first, lengths = _starts()
    for k, word in enumerate(words):
        if word in first:
            for n in lengths:
                if k + n <= len(words) and tuple(words[k : k + n]) in found.notices:
                    return k, k + n
    return None


def differences(wording: Wording, words: list[str]) -> tuple[int, int, list[str], list[str], tuple[int, int]] | None:
    """Where ``wording`` stands best in ``words``: first and last place (end
    excluded), its words that are missing there, additional ones, and the place
    of the longest match."""
    n = len(wording.words)
    matcher = SequenceMatcher(None, wording.words, words, autojunk=False)
    anchor = matcher.find_longest_match()
    if anchor.size < 4:
        return None
    slack = wording.slack
    low = max(0, anchor.b - anchor.a - slack)
    near = words[low : anchor.b + n - anchor.a + slack]
    matches = [m for m in SequenceMatcher(None, wording.words, near, autojunk=False).get_matching_blocks() if m.size]
    missing, extra = [], []
    a, b = 0, matches[0].b
    for m in matches:
        missing += wording.words[a : m.a]
        if not any(a <= g <= m.a for g in wording.gaps) or m.a > a:
            extra += near[b : m.b]
        a, b = m.a + m.size, m.b + m.size
    missing += wording.words[a:]
    return low + matches[0].b, low + b, missing, extra, (anchor.b, anchor.b + anchor.size)


def confirm(found: License, words: list[str], long: bool = False) -> tuple[str, int, int, list[str], list[str]] | None:
    """Kind and place of what the words hold of the licence, if anything: a whole
    text with few differences of which none is decisive, or else a notice, which
    stands there word by word or not at all. With ``long`` it is the long text or
    nothing."""
    decisive = _DECISIVE_IN_LONG if long else _DECISIVE
    for wording in found.long if long else found.texts:
        parts = [(0, len(words))]
        while parts:
            low, high = parts.pop()
            part = words[low:high]
            if (wording.counts - Counter(part)).total() > TOLERANCE * len(wording.words):
                continue  # so many are missing wherever it may stand
            at = differences(wording, part)
            if at is None:
                continue
            first, last, missing, extra, (a, b) = at
            if len(missing) + len(extra) <= TOLERANCE * len(wording.words) and not any(decisive.fullmatch(w) for w in (*missing, *extra)):
                return "text", low + first, low + last, missing, extra
            parts += [(low + b, high), (low, low + a)]  # it may stand beside what is only like it
    at = None if long else notice(found, words)
    return at and ("notice", *at, [], [])


@dataclass(frozen=True)
class Finding:
    """``start`` and ``end`` are code points in the text; ``license`` is None for
    a block that no wording confirms, whose ``nearest`` is the best of the ranking."""

    start: int
    end: int
    license: str | None
    nearest: str | None
    wording: str | None
    saved_bytes: int
    missing: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()


def scan_block(block: str, long: bool = False) -> list[Finding]:
    """The confirmed licences of a block (with ``long``, of long texts)."""
    out: list[Finding] = []
    parts = [(0, len(block))]
    while parts:
        start, end = parts.pop()
        part = block[start:end]
        if not long and not _CUE.search(part):
            continue
        lower = part.translate(_LOWER)
        places = [m.span() for m in _WORD.finditer(lower)]
        words = [lower[a:b] for a, b in places]
        if long and len(words) < GRAM:
            continue
        won = next(((saved, x, got) for saved, x in rank(part, long) if (got := confirm(x, words, long))), None)
        if won is None:
            continue
        saved, candidate, (kind, first, last, missing, extra) = won
        a, b = start + places[first][0], start + places[last - 1][1]
        out.append(Finding(a, b, candidate.name, candidate.name, kind, saved, tuple(missing), tuple(extra)))
        parts += [(b, end), (start, a)]
    return sorted(out, key=lambda f: (f.start, f.end))


@cache
def reach() -> int:
    """Words that the longest wording takes at most."""
    return max(len(w.words) + w.slack for x in licenses() for w in x.texts)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of a whole text that hold every wording around a cue whole."""
    cues = [m.span() for m in _CUE.finditer(text)]
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))] if cues else []
    starts = [a for a, _ in places]
    joined: list[list[int]] = []
    for a, b in cues:
        first = max(0, bisect_right(starts, a) - 1 - reach())
        last = min(len(places), bisect_left(starts, b) + reach())
        if joined and first <= joined[-1][1]:
            joined[-1][1] = last
        elif first < last:
            joined.append([first, last])
    for first, last in joined:
        while last - first > BLOCK_WORDS:
            yield places[first][0], places[first + BLOCK_WORDS - 1][1]
            first += BLOCK_WORDS - reach()
        yield places[first][0], places[last - 1][1]


@cache
def _grams() -> dict[tuple[str, ...], list[tuple[int, int]]]:
    """Grams of the long texts, ``STEP`` words apart: (number of the text, place)."""
    out: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for number, w in enumerate(w for x in licenses() for w in x.long):
        for at in range(0, len(w.words) - GRAM + 1, STEP):
            out.setdefault(w.words[at : at + GRAM], []).append((number, at))
    return out


def long_windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of a text in which a long text may stand, from where its begin
    would be to where its end would."""
    lower = text.translate(_LOWER)
    places = [m.span() for m in _WORD.finditer(lower)]
    words = [lower[a:b] for a, b in places]
    known, longs = _grams(), [w for x in licenses() for w in x.long]
    found: dict[int, list[tuple[int, int]]] = {}
    for at, gram in enumerate(zip(*(words[k:] for k in range(GRAM)), strict=False)):
        for number, place in known.get(gram, ()):
            slack = longs[number].slack
            found.setdefault(number, []).append((at - place - slack, at - place + len(longs[number].words) + slack))
    stretches: set[tuple[int, int]] = set()
    for spans in found.values():
        first = last = None
        for a, b in sorted(spans):
            if last is not None and a <= last:
                last = max(last, b)
                continue
            if last is not None:
                stretches.add((first, last))
            first, last = a, b
        stretches.add((first, last))
    for a, b in sorted(stretches):
        yield places[max(a, 0)][0], places[min(b, len(places)) - 1][1]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Blocks around cues, at whole words or lines, that are findings of their
    own where no licence is confirmed."""
    n = len(text)
    start = end = -1

    def cut(a: int, b: int) -> Iterator[tuple[int, int]]:
        while b - a > BLOCK:
            yield a, a + BLOCK
            a += BLOCK - OVERLAP
        yield a, b

    def down(b: int) -> int:
        """To the end of the line and of the wrapped lines that follow it."""
        end = text.find("\n", b, b + REACH)
        if end < 0:
            end = n if b + REACH >= n else max(b, text.rfind(" ", b, b + REACH))
            return end
        while end < b + FOLLOWING:
            line = text.find("\n", end + 1, end + WRAPPED)
            if line < 0 and n - end <= WRAPPED:
                line = n
            if line < 0 or not text[end + 1 : line].strip():
                break
            end = line
        return end

    def up(a: int) -> int:
        start = text.rfind("\n", max(0, a - REACH), a)
        if start < 0:
            return 0 if a <= REACH else 1 + max(text.find(" ", a - REACH, a), a - REACH - 1)
        while start > 0 and start > a - FOLLOWING:
            line = text.rfind("\n", max(0, start - WRAPPED), start)
            if line < 0 and start > WRAPPED or not text[line + 1 : start].strip():
                break
            start = line
            if line < 0:
                break
        return start + 1

    for m in _CUE.finditer(text):
        a, b = up(m.start()), down(m.end())
        if start >= 0 and a <= end + REACH:
            end = max(end, b)
            continue
        if start >= 0:
            yield from cut(start, end)
        start, end = a, b
    if start >= 0:
        yield from cut(start, end)


def scan_text(text: str | None, known: dict[tuple[bool, str], list[Finding]] | None = None) -> list[Finding]:
    """All findings in a whole text, in order. Blocks without a confirmed licence
    are findings without one; a null or empty text has none."""
    text = text or ""
    out: list[Finding] = []
    has_cue = _CUE.search(text)
    for long, start, end in [*((False, *x) for x in windows(text)), *((True, *x) for x in (long_windows(text) if has_cue else ()))]:
        block = text[start:end]
        found = known.get((long, block)) if known is not None else None
        if found is None:
            found = scan_block(block, long)
            if known is not None:
                if len(known) >= CACHE_BLOCKS:
                    known.clear()
                known[long, block] = found
        for f in found:
            out.append(Finding(start + f.start, start + f.end, f.license, f.nearest, f.wording, f.saved_bytes, f.missing, f.extra))
    kept: list[Finding] = []
    for f in sorted(out, key=lambda f: (f.start, -f.end, f.license)):
        if not kept or f.start >= kept[-1].end:
            kept.append(f)
        elif f.end - f.start > kept[-1].end - kept[-1].start:  # cut in the window before
            kept[-1] = f
    ends = [f.end for f in kept]
    bare = []
    for start, end in blocks(text):
        k = bisect_right(ends, start)
        if k == len(kept) or kept[k].start >= end:
            top, nearest = rank(text[start:end])[0]
            bare.append(Finding(start, end, None, nearest.name if top > 0 else None, None, max(top, 0)))
    return sorted(kept + bare, key=lambda f: (f.start, f.end, f.license or ""))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per finding in ``docs (doc_id, text)``: doc_id, finding (from 0),
    license, nearest, wording (``text`` or ``notice``), start_char, n_chars,
    saved_bytes, n_missing, n_extra, differences, exact.

    A block that has cues and no confirmed licence is one row with a null
    license. Null and empty texts and texts without cues have no rows; rows that
    repeat are scanned each; other columns are ignored; an empty table gives an
    empty result.
    """
    names = ["doc_id", "finding", "license", "nearest", "wording", "start_char", "n_chars", "saved_bytes", "n_missing", "n_extra", "differences", "exact"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[bool, str], list[Finding]] = {}
        for batch in batches:
            rows, of = [], []
            for k, text in enumerate(batch.column(1)):
                for number, f in enumerate(scan_text(text.as_py(), known)):
                    of.append(k)
                    said = " ".join([*(f"-{w}" for w in f.missing), *(f"+{w}" for w in f.extra)])
                    exact = f.license is not None and not said
                    rows.append((number, f.license, f.nearest, f.wording, f.start, f.end - f.start, f.saved_bytes, len(f.missing), len(f.extra), said, exact))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, finding int, license string, nearest string, wording string, start_char long, n_chars long, saved_bytes long, n_missing long, n_extra long, differences string, exact boolean"
    return docs.select("doc_id", F.col("text").cast("string")).where(F.col("text").rlike(CUE)).mapInArrow(run, schema)
