"""Sequence packing by non-negative least squares over length patterns.

Lengths, not documents, are packed: patterns of up to three lengths that fill a
sequence exactly are enumerated, their repeat counts are fitted to the histogram
of lengths by non-negative least squares, rounded down, and what is left over is
packed best-fit, longest first, also on the histogram. The histogram has at most
``capacity`` bins, so this part, on the driver, is bounded whatever the corpus.

Documents then take the places of the plan: each piece gets its rank among the
pieces of its length (counts per salt, summed in order, plus the rank within a
salt, so that a length shared by a third of all rows is ranked in many tasks) and
looks up the place with that rank. Sequence and offset follow from the place, so
no second shuffle gathers sequences.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches, write_shared

CAPACITY = 2048
#: Parts of the fitted counts that plans are made with; 0 is best-fit alone.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.0)
#: Words whose ids a Python worker keeps; it starts afresh beyond that.
CACHE_WORDS = 200_000
#: Texts whose words are numbered together.
SLICE = 1_000
#: Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_END = "\0"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Arrow parts words at these too, the tokenizer's \s does not.
_SEPARATORS = r"[\x1c-\x1f]"


# The settings of a vocabulary that parts texts as WordTokenizer does.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class WordTokenizer(dict):
    """Ids of whole texts, word by word; itself the cache of words.

    Where the vocabulary's settings are those of ``_BY_WORD`` (``by_word``), its
    pre-tokenizer never joins characters across white space, so a text's ids are
    its white-space-separated words' ids in order, and words recur. A batch's
    words are numbered by Arrow, each distinct one is looked up once, and the ids
    are put together by Arrow. Texts with characters at which Arrow parts words
    and the tokenizer doesn't go to the tokenizer whole, as do all texts if the
    settings are others or added tokens hold white space.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        settings = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in settings.get("added_tokens", ())]
        self.by_word = {k: settings.get(k) for k in _BY_WORD} == _BY_WORD and not any(c.isspace() for t in added for c in t)
        self.stems: dict[str, bytes] = {}
        self.cache_words = cache_words

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        """A word's letters and the ASCII punctuation after them are pre-tokens of
        their own, whose ids are kept too; any other word goes to the tokenizer."""
        stem = word.rstrip(_PUNCTUATION)
        end = word[len(stem) :]
        if not stem.isascii():
            stem = "".join(c.lower() for c in unicodedata.normalize("NFC", stem)) if stem.isalpha() else ""
        if not stem.isalpha() or len(word) > 200:
            found = self.whole(word)
        else:
            found = self._stem(stem.lower() if stem.isascii() else stem)
            if end:
                found += self._end(end)
        if len(word) <= 200:
            if len(self) >= self.cache_words:
                self.clear()
            self[word] = found
        return found

    def _stem(self, stem: str) -> bytes:
        found = self.stems.get(stem)
        if found is None:
            if len(self.stems) >= 2 * self.cache_words:
                self.stems.clear()
            found = np.array([t.id for t in self.model.tokenize(stem.encode().decode("latin-1").translate(_BYTE_LEVEL))], "<u4").tobytes()
            self.stems[stem] = found
        return found

    def _end(self, end: str) -> bytes:
        found = self.stems.get(_END + end)
        if found is None:
            found = self.stems[_END + end] = self.whole(end)
        return found

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text (no nulls)."""
        if not self.by_word:
            yield from (self.whole(t) for t in texts.to_pylist())
            return
        odd = pc.match_substring_regex(texts, _SEPARATORS)
        words = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        numbered = words.flatten().dictionary_encode()
        known = pa.array(map(self.__getitem__, numbered.dictionary.to_pylist()), pa.binary(), size=len(numbered.dictionary))
        joined = known.take(numbered.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1) if len(joined) else np.zeros(1, np.int32)
        data = memoryview(joined.buffers()[2]) if len(joined) and joined.buffers()[2] else memoryview(b"")
        starts = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        for k, is_odd in enumerate(odd.to_pylist()):
            yield self.whole(texts[k].as_py()) if is_odd else bytes(data[starts[k] : starts[k + 1]])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and a
    final 0, cut into pieces of ``capacity`` only if it is longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            texts = batch.column(1).fill_null("")
            for k, ids in enumerate(x for at in range(0, len(texts), SLICE) for x in tokenizer.ids(texts.slice(at, SLICE))):
                ids += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (k, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            ids_of = batch.column(0).take(pa.array(rows[0], pa.int64()))
            rest = [pa.array(c, t) for c, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([ids_of, *rest], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(releasing(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@dataclass(frozen=True)
class Plan:
    """Sequences in groups: ``repeat`` sequences hold ``lengths`` each, in order.
    ``share``: how much of the fitted counts it takes (0: none of them);
    ``bound``: sequences that any plan needs at least."""

    groups: list[tuple[int, tuple[int, ...]]]
    share: float
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.groups)


def enumerate_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three of the lengths present that fill ``capacity``
    exactly, as rows of up to three lengths (0: none). There are about
    capacity ** 2 / 12 at most (350,000 at 2048)."""
    there = np.zeros(capacity + 1, bool)
    there[present] = True
    there[0] = False
    rows = []
    if there[capacity]:
        rows.append(np.array([[capacity, 0, 0]]))
    a = np.flatnonzero(there)
    two = a[(2 * a >= capacity) & (a < capacity)]
    two = two[there[capacity - two]]
    rows.append(np.stack([two, capacity - two, np.zeros_like(two)], 1))
    for x in a[(3 * a >= capacity) & (a < capacity - 1)]:
        y = a[(a <= x) & (2 * a >= capacity - x) & (a < capacity - x)]
        y = y[there[capacity - x - y]]
        rows.append(np.stack([np.full_like(y, x), y, capacity - x - y], 1))
    return np.concatenate(rows)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares: repeat counts whose use of lengths is nearest
    to the histogram, by accelerated projected gradients. A column of the matrix
    has three entries at most, so its products are gathers and bincounts."""
    if not len(patterns):
        return np.zeros(0)
    size = len(histogram)
    live = patterns > 0

    def used(x: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for k in range(3):
            out += np.bincount(patterns[:, k], np.where(live[:, k], x, 0), size)
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[patterns].sum(1)

    # Scaling each pattern by the crowding of its lengths bounds the step (the row sums of the normal matrix).
    scale = back(used(np.ones(len(patterns))))
    scale[scale == 0] = 1
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(used(y) - histogram) / scale)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on a histogram: equal sequences are one group."""
    spaces: dict[int, list[list]] = {}

    def put(space: int, n: int, lengths: tuple[int, ...]) -> None:
        if n:
            spaces.setdefault(space, []).append([n, lengths])

    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        while left:
            space = min((s for s in spaces if s >= length), default=0)
            if not space:
                each = capacity // length
                if full := left // each:
                    put(capacity - each * length, full, (length,) * each)
                if rest := left % each:
                    put(capacity - rest * length, 1, (length,) * rest)
                break
            n, lengths = spaces[space].pop()
            if not spaces[space]:
                del spaces[space]
            each = space // length
            if left >= each:
                take = min(n, left // each)
                put(space - each * length, take, lengths + (length,) * each)
                put(space, n - take, lengths)
                left -= take * each
            else:
                put(space - left * length, 1, lengths + (length,) * left)
                put(space, n - 1, lengths)
                left = 0
    return [(n, lengths) for groups in spaces.values() for n, lengths in groups]


def make_plan(histogram: np.ndarray, capacity: int = CAPACITY, shares: tuple[float, ...] = SHARES) -> Plan:
    """The fitted patterns, rounded down, with the rest packed best-fit. A part of
    the fitted counts, or none of them, are taken instead only where that gives
    fewer sequences; ``Plan.share`` says so."""
    histogram = np.asarray(histogram, np.int64)
    patterns = enumerate_patterns(np.flatnonzero(histogram), capacity)
    fitted = fit_counts(patterns, histogram.astype(float))
    order = np.argsort(-fitted, kind="stable")
    bound = -(-int((histogram * np.arange(len(histogram))).sum()) // capacity)
    best = None
    for share in shares:
        rest, groups = histogram.copy(), []
        for k in order:
            n = int(fitted[k] * share)
            if not n:
                break
            lengths = tuple(int(v) for v in patterns[k] if v)
            n = min(n, *(int(rest[v]) // lengths.count(v) for v in lengths))
            if n:
                groups.append((n, lengths))
                for v in lengths:
                    rest[v] -= n
        plan = Plan(groups + best_fit(rest, capacity), share, bound)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == bound:
            break
    return best


def _places(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of equal places: length, first rank, first sequence, offset
    of the place, sorted by length and rank; and per length the first run."""
    length, count, sequence, offset = [], [], [], []
    first = 0
    for n, lengths in plan.groups:
        at = 0
        for v in lengths:
            length.append(v)
            count.append(n)
            sequence.append(first)
            offset.append(at)
            at += v
        first += n
    a = [np.array(x, np.int64) for x in (length, count, sequence, offset)]
    order = np.argsort(a[0], kind="stable")
    length, count, sequence, offset = (x[order] for x in a)
    ends = np.cumsum(count)
    starts = ends - count
    first_of = starts[np.searchsorted(length, length)] if len(length) else starts
    return length, starts - first_of, sequence, offset, count


def pack(found: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = 1_000) -> DataFrame:
    """``found (doc_id, piece, length, ...)`` with ``sequence_id`` and ``offset``.

    Every row gets a place; rows that repeat, or have no id, are packed each. No
    column may have a name that starts with ``_tideline_``. An empty table gives
    an empty result.
    """
    columns = found.columns
    with small_batches(found.sparkSession):
        # Rows get a number of their own, so that salts part them whatever ids they have.
        found = write_shared(found.withColumn("_tideline_rid", F.monotonically_increasing_id()), "packing-pieces")
    by_length = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for k, n in by_length.items():
        histogram[k] = n
    length, first, sequence, offset, _ = _places(make_plan(histogram, capacity))
    key = length << 40 | first if len(length) else first

    # Every length has salts by its own count, so no task ranks much more than `rows_per_salt` rows of a common one.
    salts = F.array(*(F.lit(max(1, -(-int(n) // rows_per_salt))) for n in histogram))
    salted = found.withColumn("_tideline_salt", F.pmod(F.xxhash64("_tideline_rid"), F.get(salts, F.col("length").cast("int"))))
    before = salted.groupBy("length", "_tideline_salt").agg(F.count(F.lit(1)).alias("_tideline_n"))
    order = "rows between unbounded preceding and 1 preceding"
    before = before.select("length", "_tideline_salt", F.expr(f"coalesce(sum(_tideline_n) over (partition by length order by _tideline_salt {order}), 0)").alias("_tideline_before"))
    ranked = salted.withColumn("_tideline_rank", F.expr("row_number() over (partition by length, _tideline_salt order by _tideline_rid)"))
    ranked = ranked.join(before, ["length", "_tideline_salt"]).select(*columns, (F.col("_tideline_rank") - 1 + F.col("_tideline_before")).alias("_tideline_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_tideline_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            own = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(key, own << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                names=[*columns, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_tideline_rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    A null or empty text is the final id 0 alone. Documents longer than
    ``capacity`` ids are cut, no others. Sequences are numbered from 0 and filled
    gapless from offset 0. Other columns are ignored; an empty table gives an
    empty result.
    """
    found = pack(pieces(docs, tokenizer_path, capacity), capacity)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
