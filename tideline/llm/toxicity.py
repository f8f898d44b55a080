"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each category has a linear model
over the presence of words and character grams, and each model after the first
also sees the probabilities of the categories before it. In training those
probabilities come from models that did not see the document (out-of-fold), as
they will be when new documents are scored.

Training takes a bounded sample of labelled rows, in numpy on the driver. Scoring
is one pass over whole texts without a shuffle. The words of a slice of texts are
numbered and hashed together, so nothing is remembered between slices.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import FILE, ROW, slices, small_batches, with_place, without_keys, write_shared

#: Labelled rows that a model is fitted on at most, chosen by a hash of the id.
TRAIN_ROWS = 8000
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Grams a model uses at most, those with the strongest association.
FEATURES = 3000
FOLDS = 4
#: Texts that are looked at together, and their bytes; distinct words that are hashed together.
SLICE = 128
SLICE_BYTES = 1 << 19
_WORDS = 1 << 14

_WORD = re.compile(r"\w+")


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, hash bucket) of many words at once: each word itself
    and its grams of 4 and 5 bytes of UTF-8 between two end marks."""
    marked = [b"<%b>" % w.encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    numbers, buckets = [np.arange(len(marked))], [np.fromiter(map(zlib.crc32, marked), np.int64, len(marked)) & (BUCKETS - 1)]
    if len(data) >= 5:
        two = data[:-1] << np.uint64(8) | data[1:]
        four = two[:-2] << np.uint64(16) | two[2:]
        for n, code in ((4, four), (5, four[:-1] << np.uint64(8) | data[4:])):
            whole = word[: len(code)] == word[n - 1 :]
            # multiplicative hashing of the gram and its length
            hashed = (code[whole] * np.uint64(8) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)
            numbers.append(word[: len(code)][whole])
            buckets.append(hashed.astype(np.int64))
    return np.concatenate(numbers), np.concatenate(buckets)


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


def present(texts: list[str | None], number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the features that whole texts have, each once, sorted.
    ``number`` maps buckets to features (-1: none); without it they are buckets."""
    seen = _Numbers()
    own = [np.fromiter(map(seen.__getitem__, words), np.int64, len(words)) for words in (set(_WORD.findall((t or "").lower())) for t in texts)]
    distinct, parts = list(seen), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in range(0, len(distinct), _WORDS):
        of, ids = word_buckets(distinct[at : at + _WORDS])
        if number is not None:
            ids = number[ids]
            of, ids = of[ids >= 0], ids[ids >= 0]
        parts.append((of + at, ids))
    of, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(of, kind="stable")
    of, ids = of[order], ids[order].astype(np.int64)
    starts = np.searchsorted(of, np.arange(len(seen) + 1))
    words = np.concatenate(own) if own else np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(own)), [len(w) for w in own])
    counts = (starts[1:] - starts[:-1])[words]
    ends = np.cumsum(counts)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(starts[words], counts)
    key = np.unique(np.repeat(rows, counts) << 32 | ids[at])
    return key >> 32, key & 0xFFFFFFFF


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _group_sums(keys: np.ndarray, size: int):
    """A function that sums values by ``keys``, which are sorted."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    own = keys[cuts]

    def sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        if len(cuts):
            out[own] = np.add.reduceat(values, cuts)
        return out

    return sums


@dataclass
class Linear:
    """Logistic regression over present features and the chain's earlier
    probabilities."""

    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def logits(self, rows: np.ndarray, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.weights[ids], len(before)) + before @ self.chain + self.bias

    @staticmethod
    def fit(rows: np.ndarray, ids: np.ndarray, before: np.ndarray, y: np.ndarray, size: int, l2: float = 0.1, rounds: int = 150) -> Linear:
        """Accelerated gradients with a step per coordinate. ``rows`` are sorted;
        products with the matrix and its transpose are gathers and sums of groups."""
        n, extra = before.shape
        order = np.argsort(ids, kind="stable")
        rows_by_id = rows.take(order)
        by_row, by_id = _group_sums(rows, n), _group_sums(ids.take(order), size)
        del order
        share = min(max(y.mean() if n else 0.0, 1e-3), 1 - 1e-3)
        theta = np.zeros(size + extra + 1)
        theta[-1] = np.log(share / (1 - share))
        degree = np.bincount(rows, minlength=n) + before.sum(1) + 1.0
        scale = np.r_[np.bincount(ids, degree[rows], size), before.T @ degree, degree.sum()] / 4 + l2
        at, t = theta, 1.0
        for _ in range(rounds):
            r = _sigmoid(by_row(at.take(ids)) + before @ at[size:-1] + at[-1]) - y
            grad = np.r_[by_id(r.take(rows_by_id)), before.T @ r, r.sum()]
            grad[:-1] += l2 * at[:-1]
            new = at - grad / scale
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            at = new + (t - 1) / t_new * (new - theta)
            theta, t = new, t_new
        return Linear(theta[:size], theta[size:-1], float(theta[-1]))


@dataclass
class Chain:
    """A fitted chain: ``score`` gives a probability per category and text."""

    categories: list[str]
    number: np.ndarray
    models: list[Linear]
    thresholds: list[float]

    def score_column(self, texts: pa.Array) -> np.ndarray:
        """As ``score``, a slice at a time."""
        parts = [self.score(texts.slice(at, n).to_pylist()) for at, n in slices(texts, SLICE_BYTES, SLICE)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.models)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows, ids = present(texts, self.number)
        out = np.zeros((len(texts), len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = _sigmoid(model.logits(rows, ids, out[:, :k]))
        return out


def _select(docs: list[np.ndarray], labels: np.ndarray, most: int) -> np.ndarray:
    """Feature number of each bucket (-1: unused): the buckets whose presence is
    most strongly associated with any category, by the z-score of the log odds."""
    # How many texts of each label have a bucket, some texts at a time.
    counts = np.zeros((2, labels.shape[1], BUCKETS))
    some = 8 * SLICE
    for at in range(0, len(docs), some):
        part = docs[at : at + some]
        ids, sizes = np.concatenate(part), [len(x) for x in part]
        for k in range(labels.shape[1]):
            for y in (0, 1):
                counts[y, k] += np.bincount(ids[np.repeat(labels[at : at + some, k] == y, sizes)], minlength=BUCKETS)
    strength = np.zeros(BUCKETS)
    for k in range(labels.shape[1]):
        yes, no = labels[:, k] == 1, labels[:, k] == 0
        if not yes.any() or not no.any():
            continue
        a, b = counts[1, k] + 0.5, counts[0, k] + 0.5
        c, d = yes.sum() + 1 - a, no.sum() + 1 - b
        z = (np.log(a * d) - np.log(b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        z[(a + b) < 4] = 0
        # each category gets its share, whatever the strength of the others' words
        top = np.argsort(-np.abs(z), kind="stable")[: most // labels.shape[1]]
        strength[top] = np.maximum(strength[top], np.abs(z[top]))
    number = np.full(BUCKETS, -1, np.int32)
    used = np.flatnonzero(strength > 3)
    number[used] = np.arange(len(used))
    return number


def train_chain(docs: list[np.ndarray], labels: np.ndarray, categories: list[str], features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """``docs``: distinct buckets of each text; ``labels``: a column per category
    in chain order (nan: unknown). A category without both kinds of labels is
    never predicted (probability 0)."""
    number = _select(docs, labels, features)
    size = int(number.max(initial=-1)) + 1
    own = [n[n >= 0] for n in (number[d] for d in docs)]
    rows = np.repeat(np.arange(len(own), dtype=np.int32), [len(d) for d in own])
    ids = np.concatenate(own) if own else np.empty(0, np.int32)
    fold = np.arange(len(docs)) % folds
    before = np.zeros((len(docs), 0))
    models, thresholds = [], []
    for k in range(len(categories)):
        y = labels[:, k]
        known = ~np.isnan(y)
        if len(set(y[known])) < 2:
            models.append(Linear(np.zeros(size), np.zeros(k), -35.0))
            thresholds.append(1.0)
            before = np.c_[before, np.zeros(len(docs))]
            continue

        def fit(use: np.ndarray, before=before, y=y) -> Linear:
            place = np.cumsum(use, dtype=np.int32) - np.int32(1)
            keep = use[rows]
            return Linear.fit(place[rows[keep]], ids[keep], before[use], y[use], size)

        out_of_fold = np.zeros(len(docs))
        for f in range(folds):
            held = fold == f
            out_of_fold[held] = _sigmoid(fit(known & ~held).logits(rows, ids, before))[held]
        models.append(fit(known))
        thresholds.append(_threshold(out_of_fold[known], y[known]))
        before = np.c_[before, out_of_fold]
    return Chain(categories, number, models, thresholds)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities, half-way between
    the two probabilities it parts."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0
    k = int(np.argmax(f1))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + low) / 2)


def sample_labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int) -> DataFrame:
    """At most about ``most`` labelled documents, by a hash of the id, with a
    double column per category."""
    known = labels.select("doc_id", *(c.cast("double").alias(k) for k, c in categories.items())).where("doc_id is not null").distinct()
    n = known.count()
    if n > most:
        # a tenth less than the share, so that the exact bound below cuts nothing in practice
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < int(900_000 * most / n))
    return docs.select("doc_id", "text").join(F.broadcast(known.limit(most)), "doc_id")


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], train_rows: int = TRAIN_ROWS) -> Chain:
    """Fit a chain in the order of ``categories`` (name: 0/1 column of labels).

    A doc_id counts once: of several texts or labels of one, those with the least
    features in binary order are taken."""
    names = list(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column("text"), SLICE_BYTES // 4, SLICE // 4):
                part = batch.slice(at, n)
                rows, ids = present(part.column("text").to_pylist())
                found = [x.astype("<u4").tobytes() for x in np.split(ids, np.searchsorted(rows, np.arange(1, part.num_rows)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary()), *(part.column(c) for c in names)], names=["doc_id", "found", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = sample_labelled(docs, labels, categories, train_rows)
    with small_batches(docs.sparkSession):
        rows = sample.mapInArrow(run, f"doc_id {kind}, found binary, {', '.join(f'`{c}` double' for c in names)}")
        rows = rows.groupBy("doc_id").agg(F.min(F.struct("found", *names)).alias("x")).select("doc_id", "x.*").toArrow()
    if not rows.num_rows:
        return train_chain([], np.zeros((0, len(names))), names)
    order = pc.sort_indices(rows.column("doc_id")).to_pylist()
    found = [np.frombuffer(x.as_py(), "<u4") for x in rows.column("found")]
    y = np.stack([rows.column(c).to_numpy() for c in names], 1)[order]
    del rows  # fitting needs the memory
    return train_chain([found[k] for k in order], y.astype(float), names)


def score_toxicity(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """``docs`` with a double column ``p_<category>`` for each category and
    boolean ``toxic``: whether the last category's probability reaches its
    threshold. A null text is scored as the empty one. Columns of ``docs`` that
    have the name of one of these are replaced."""
    new = [*(prefix + c for c in chain.categories), "toxic"]
    docs = docs.drop(*(c for c in new if c != "text"))
    columns = docs.columns
    model = docs.sparkSession.sparkContext.broadcast(chain)
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            p = fitted.score_column(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= fitted.thresholds[-1])], names=[*columns, *new])

    schema = StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in new[:-1]), StructField("toxic", BooleanType())])
    return docs.mapInArrow(run, schema)


def label_categories() -> dict[str, Column]:
    """The categories that ``labels`` has, in chain order: whether a text is poor
    comes first, and its probability is a feature of toxicity."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the chain calls toxic. Texts go to Python
    and only the places of those rows come back; no shuffle, all columns."""
    chain = fit_toxicity(docs, labels, label_categories())
    placed = with_place(docs)
    with small_batches(docs.sparkSession):
        gone = write_shared(score_toxicity(placed.select(F.col("text").cast("string").alias("text"), FILE, ROW), chain).where("toxic").select(FILE, ROW), "toxicity-dropped")
    return without_keys(placed, gone, FILE, ROW).select(*docs.columns)
