"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its words' hashed character grams; a
linear softmax over that mean gives the language. Embeddings and softmax are
trained together by stochastic gradient descent in numpy. A temperature fitted on
texts kept out of the descent calibrates the probability, and a threshold chosen
on the same texts says which predictions to reject.

The softmax's scores are linear in the mean, so a word's grams contribute a fixed
vector of scores: workers remember that vector per word, and a whole text is a
sum over its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import small_batches

#: Texts that a model is fitted on at most, chosen by a hash of the id.
TRAIN_ROWS = 4000
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIM = 16
CACHE_WORDS = 300_000
UNKNOWN = "und"

_ALPHANUMERIC = re.compile(r"[^\W\d_]+")


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed grams of many words at once: (number of the word, bucket). A word's
    grams are those of 2 to 5 bytes of its UTF-8 between two end marks, so a
    short word is a gram of its own."""
    marked = [b"<%b>" % w.encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(marked), dtype=np.int64), [len(m) for m in marked])
    numbers, buckets = [], []
    code = data
    for n in (2, 3, 4, 5):
        code = (code[:-1] << np.uint64(8)) | data[n - 1 :]
        whole = word[: len(code)] == word[n - 1 :]
        # multiplicative hashing of the gram and its length
        hashed = ((code[whole] * np.uint64(8) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
        numbers.append(word[: len(code)][whole])
        buckets.append(hashed.astype(np.int64))
    return np.concatenate(numbers), np.concatenate(buckets)


def letters(text: str | None) -> list[str]:
    """The runs of letters (Unicode category L) of a whole text, in lower case."""
    found = _ALPHANUMERIC.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    # Numbers that are no digits (fractions, superscripts, numerals) part words.
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets, and the share of its grams that each has."""
    n = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(words), 1 << 16):
        n += np.bincount(word_grams(words[at : at + (1 << 16)])[1], minlength=BUCKETS)
    ids = np.flatnonzero(n)
    return ids, (n[ids] / n.sum()).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class LanguageModel:
    """``languages``; per bucket the scores it adds (embedding times softmax
    weights); bias; temperature; and the threshold below which a prediction is
    not to be trusted."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    _cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_cache": {}}

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each text, and whether it has letters."""
        width = len(self.languages) + 1
        words = self._cache.setdefault("number", {})
        table = self._cache.setdefault("table", np.zeros((4096, width), np.float32))
        out, has = np.zeros((len(texts), width - 1)), np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            found = letters(text)
            if not found:
                continue
            has[k] = True
            total = np.zeros(width)
            for at in range(0, len(found), 1 << 16):
                part = found[at : at + (1 << 16)]
                new = set(filterfalse(words.__contains__, part))
                if len(words) + len(new) > CACHE_WORDS:
                    words.clear()
                    new = set(part)
                if len(words) + len(new) > len(table):
                    table = np.concatenate([table, np.zeros((max(len(table), len(new)), width), np.float32)])
                    self._cache["table"] = table
                if new:
                    order, first = sorted(new), len(words)
                    number, grams = word_grams(order)
                    rows = table[first : first + len(order)]
                    for c in range(width - 1):
                        rows[:, c] = np.bincount(number, self.scores[grams, c], len(order))
                    rows[:, -1] = np.bincount(number, minlength=len(order))
                    words.update(zip(order, range(first, first + len(order)), strict=True))
                total += table[np.fromiter(map(words.__getitem__, part), np.int64, len(part))].sum(0, dtype=np.float64)
            out[k] = total[:-1] / total[-1]
        return out + self.bias, has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability, and whether it is to be trusted."""
        z, has = self.logits(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        p = _softmax(z / self.temperature)
        best = p.argmax(1)
        score = np.where(has, p[np.arange(len(texts)), best], 0.0)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        return names, score, has & (score >= self.threshold)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 4, rate: float = 0.5, seed: int = 0) -> LanguageModel:
    """Stochastic gradient descent over texts' bags; every fifth one is kept out,
    for the temperature and the threshold. With no texts every prediction is
    ``und``; with one language it is that one."""
    languages = sorted(set(langs))
    k = len(languages)
    if k == 0:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    y = np.array([languages.index(lang) for lang in langs])
    kept_out = np.arange(len(bags)) % 5 == 4 if len(bags) >= 50 else np.zeros(len(bags), bool)
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    weights, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    order = np.flatnonzero(~kept_out)
    steps, done = epochs * len(order), 0
    for _ in range(epochs):
        for d in rng.permutation(order):
            ids, share = bags[d]
            step = rate * (1 - done / steps)
            done += 1
            mean = share @ embed[ids]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            # A text's grams each hold a small share of it, so their steps are scaled up to matter.
            embed[ids] -= (20 * step) * np.outer(share, weights @ p)
            weights -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
    model = LanguageModel(languages, embed @ weights, bias)
    held = np.flatnonzero(kept_out)
    if len(held) and k > 1:
        z = np.stack([bags[d][1] @ model.scores[bags[d][0]] for d in held]) + bias
        choices = np.geomspace(0.02, 5, 60)
        losses = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in choices]
        model.temperature = float(choices[int(np.argmin(losses))])
        p = _softmax(z / model.temperature)
        model.threshold = _rejection(p.max(1), p.argmax(1) == y[held])
    return model


def _rejection(score: np.ndarray, right: np.ndarray, precision: float = 0.99) -> float:
    """The smallest threshold above which at least ``precision`` are right."""
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    return float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def _rates(counts: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's rows to take, so that about ``most`` are taken
    in all and no language gives more than it must: small ones are taken whole."""
    rates, left = {}, most
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        quota = left / (len(counts) - k)
        rates[lang] = min(1.0, quota / n)
        left -= n * rates[lang]
    return rates


def fit_languages(docs: DataFrame, use: Column, most: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on about ``most`` (never more) of the rows where ``use`` holds, lang is
    there and the text has letters, chosen by a hash of the id and language; each
    language has an equal share as far as it has rows. Whole texts become bags of
    grams on the executors; only these reach the driver."""
    pool = docs.where(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) > most:
        # a tenth less than the share, so that the exact bound below cuts nothing in practice
        rates = _rates(counts, 0.9 * most)
        below = F.create_map(*(x for lang, r in rates.items() for x in (F.lit(lang), F.lit(int(1_000_000 * r)))))
        pool = pool.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < below[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if words := letters(batch.column(2)[k].as_py()):
                    ids, share = bag(words)
                    one = [pa.array([ids.astype("<u4").tobytes()], pa.binary()), pa.array([share.astype("<f4").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *one], names=["doc_id", "lang", "ids", "share"])

    with small_batches(docs.sparkSession):
        rows = pool.mapInArrow(run, f"doc_id {pool.schema['doc_id'].dataType.simpleString()}, lang string, ids binary, share binary").limit(most).toArrow()
    # Rows that share an id come in order of their bags; the order of training is drawn anew anyway.
    rows = rows.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("ids", "ascending"), ("share", "ascending")])
    bags = [(np.frombuffer(a.as_py(), "<u4").astype(np.int64), np.frombuffer(b.as_py(), "<f4")) for a, b in zip(rows.column("ids"), rows.column("share"), strict=True)]
    return train(bags, rows.column("lang").to_pylist())


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and accepted, in one pass.

    lang_pred is a language of the model, or ``und`` (score 0, not accepted)
    where the text is null or has no letter. A doubtful prediction keeps its
    language and has accepted = false. Columns of ``docs`` stay as they are, but
    for those with the name of one of the three, which are replaced.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    columns, at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            names, score, sure = fitted.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(sure)], names=[*columns, "lang_pred", "score", "accepted"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])
    return docs.mapInArrow(run, schema)
