"""Language-model scores of texts by a log-bilinear neural model.

The model predicts a token from the two before it: the context's embeddings, each
through a matrix of its place, sum to a vector whose products with the output
vectors, plus biases, are the outputs' scores (log-bilinear). It is trained in
numpy with noise-contrastive estimation, and its log-probabilities are normalised
by batched matrix products over all outputs.

It learns from all training tokens. They are dealt into shards of about equal
size; in each pass every shard is learnt from on the executors, starting from the
same parameters, and the results are averaged there by tokens, first within a task. What
reaches the driver is the square root of the tasks, in averages of fixed size.

Outputs are the end of a text, the most frequent words, and classes (by their
last letters) of all other words. A word of a class gets the class's probability
times its share of the class's training tokens, from which ``DISCOUNT`` of an
occurrence is taken; words never seen share what is taken from the class's words.
So the probabilities of all known words, the end, and one unknown word per class
sum to 1.

Corpus counts cover all training texts and never leave the executors whole: the
words above a count, at most ``COMMON``, go to every worker, and the occurrences
of all others meet the count table in an equi-join on the word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty, write_shared

#: Words with an output of their own, and classes of the others.
SHORTLIST = 1_791
CLASSES = 256
#: Words whose counts every worker holds at most; the others are joined.
COMMON = 300_000
#: Training tokens of a shard, about, and the tokens that a row of one holds at most.
SHARD_TOKENS = 500_000
PART = 65_536
#: Occurrences taken from each known word of a class for its unknown ones.
DISCOUNT = 0.5
#: Passes over all training tokens.
EPOCHS = 2
DIM = 24
#: Words whose outputs a worker that codes texts remembers.
CODED = 500_000
_FLUSH = 300_000
#: Bytes of texts that are looked at together, and tokens whose vectors are held at once.
SLICE_BYTES = 4 << 20
_STEP = 1 << 14


def split_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of a slice of texts, all its words in order as numbers
    of these, and where each text's words begin (and the last one's end). Arrow
    numbers the words, so each distinct one is looked up once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    index, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    if b"" in words:  # at the ends of texts
        empty = words.index(b"")
        kept = index != empty
        bounds = np.r_[0, np.cumsum(kept)][bounds]
        index = index[kept]
        index = index - (index > empty)
        del words[empty]
    return words, index, bounds


def ending_class(word: bytes, classes: int = CLASSES) -> int:
    return zlib.crc32(word[-3:]) % classes


def count_words(docs: DataFrame) -> DataFrame:
    """``word (binary), c``: counts over all texts, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for at, n in slices(batch.column(0), SLICE_BYTES):
                words, index, _ = split_words(batch.column(0).slice(at, n))
                found = zip(words, np.bincount(index, minlength=len(words)).tolist(), strict=True)
                counts.update({w: n for w, n in found if n})
                if len(counts) > _FLUSH:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Coder(dict):
    """Outputs of words by ``output``; remembers those of many words."""

    def __init__(self, output: Callable[[bytes], int]) -> None:
        self.output = output

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CODED:
            self.clear()
        found = self[word] = self.output(word)
        return found


def _groups(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers in ``index`` (16 bits, which sort fastest), the order
    that sorts it, and where each number begins in that order."""
    order = np.argsort(index, kind="stable")
    own = index.take(order)
    first = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=first[1:])
    cuts = np.flatnonzero(first)
    return own.take(cuts), order, cuts


def _sums(values: np.ndarray, order: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of groups of rows of ``values`` (32 bits, an even width), two columns
    at a time: as complex numbers."""
    return np.add.reduceat(values.take(order, 0).view(np.complex64), cuts, axis=0).view(np.float32)


def _step(value: np.ndarray, squares: np.ndarray, grad: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
    """An AdaGrad step, of some rows or all."""
    seen = grad * grad
    if rows is None:
        squares += seen
        seen[...] = squares
    else:
        seen += squares.take(rows, 0)
        squares[rows] = seen
    np.sqrt(seen, out=seen)
    grad /= seen
    grad *= np.float32(rate)
    if rows is None:
        value -= grad
    else:
        value[rows] = value.take(rows, 0) - grad


@dataclass
class LogBilinear:
    """``context``: embeddings of outputs as context (and of the start, the last
    row); ``near`` and ``far``: matrices of the two places; ``out``, ``bias``."""

    context: np.ndarray
    near: np.ndarray
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray, dim: int = DIM, seed: int = 0) -> tuple[LogBilinear, LogBilinear]:
        """The untrained network, and the sums of its squared gradients."""
        rng = np.random.default_rng(seed)
        size = len(unigram)
        init = lambda *s: rng.standard_normal(s) * 0.1
        parts = init(size + 1, dim), np.eye(dim), np.eye(dim) * 0.5, init(size, dim), np.log(unigram)
        model = LogBilinear(*(x.astype(np.float32) for x in parts))
        return model, LogBilinear(*(np.full_like(x, 1e-6) for x in model.arrays()))

    @staticmethod
    def train(history: np.ndarray, target: np.ndarray, unigram: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, seed: int = 0) -> LogBilinear:
        model, seen = LogBilinear.start(unigram, dim, seed)
        for epoch in range(epochs):
            model.learn(seen, history, target, unigram, seed=(seed, epoch))
        return model

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.context, self.near, self.far, self.out, self.bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def filled(self, flat: np.ndarray) -> LogBilinear:
        """A network of the same shapes from what ``flat`` gave."""
        ends = np.cumsum([x.size for x in self.arrays()])[:-1]
        return LogBilinear(*(x.reshape(y.shape).copy() for x, y in zip(np.split(flat, ends), self.arrays(), strict=True)))

    def learn(self, seen: LogBilinear, history: np.ndarray, target: np.ndarray, unigram: np.ndarray, noise: int = 64, batch: int = 1024, rate: float = 0.1, seed: tuple[int, ...] = (0,)) -> None:
        """One pass of noise-contrastive estimation: tell each target from
        ``noise`` outputs drawn from the unigram distribution (one draw serves a
        whole batch, so that scores are matrix products), with AdaGrad steps over
        ``seen``. ``history``: (n, 2) far and near."""
        rng = np.random.default_rng(seed)
        size = len(unigram)
        log_noise = np.log(noise * unigram).astype(np.float32)
        cumulated = np.cumsum(unigram)
        order = rng.permutation(len(target))
        far_of, near_of, said = (x.astype(np.int16).take(order) for x in (history[:, 0], history[:, 1], target))
        draws = rng.random((-(-len(order) // batch), noise)) * cumulated[-1]
        draws = np.minimum(np.searchsorted(cumulated, draws), size - 1).astype(np.int16)
        join = np.concatenate
        with np.errstate(over="ignore"):  # of an exponential, whose inverse is then 0
            for k, drawn in zip(range(0, len(order), batch), draws, strict=True):
                f, h, w = far_of[k : k + batch], near_of[k : k + batch], said[k : k + batch]
                share = np.float32(1 / len(w))
                bias = self.bias - log_noise
                ef, eh = self.context.take(f, 0), self.context.take(h, 0)
                q = ef @ self.far
                q += eh @ self.near
                ow, od = self.out.take(w, 0), self.out.take(drawn, 0)
                # The probability that a draw is a target, in place: the largest array of the pass.
                g = q @ -od.T
                g -= bias.take(drawn)
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                gr = np.einsum("ij,ij->i", q, ow)
                gr += bias.take(w)
                np.exp(gr, out=gr)
                gr += 1
                np.divide(-share, gr, out=gr)
                gq = g @ od
                gq *= share
                gq += gr[:, None] * ow
                rows, order_of, cuts = _groups(join((w, drawn)))
                g_out = _sums(join((gr[:, None] * q, (g.T @ q) * share)), order_of, cuts)
                g_bias = np.add.reduceat(join((gr, g.sum(0) * share)).take(order_of), cuts)
                touched, order_of, cuts = _groups(join((f, h)))
                g_context = _sums(join((gq @ self.far.T, gq @ self.near.T)), order_of, cuts)
                _step(self.near, seen.near, eh.T @ gq, rate)
                _step(self.far, seen.far, ef.T @ gq, rate)
                _step(self.context, seen.context, g_context, rate, touched)
                _step(self.out, seen.out, g_out, rate, rows)
                _step(self.bias, seen.bias, g_bias, rate, rows)

    def normaliser(self, step: int = 256) -> np.ndarray:
        """log of the sum over outputs for every context (far, near). The scores
        are sums of the two places' parts, so the sums of their exponentials are
        products of two matrices, a batch of rows at a time."""
        out = self.out.astype(float)
        far, near = (self.context @ self.far) @ out.T, (self.context @ self.near) @ out.T + self.bias
        far_top, near_top = far.max(1), near.max(1)
        a, b = np.exp(far - far_top[:, None]), np.exp(near - near_top[:, None]).T
        logs = [np.log(a[at : at + step] @ b) + near_top + far_top[at : at + step, None] for at in range(0, len(a), step)]
        return np.concatenate(logs).astype(np.float32)


@dataclass
class TextModel:
    """All that a worker needs: the network, and the common words.

    ``output``, ``inside`` (log10 of a word's share of its output) and ``count``
    are by word number; number 0 is the end."""

    words: list[bytes]
    output: np.ndarray
    inside: np.ndarray
    count: np.ndarray
    network: LogBilinear
    log_z: np.ndarray
    total: int
    distinct: int
    classes: int
    shortlist: int

    def __post_init__(self) -> None:
        self._number: dict[bytes | None, int] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_number": None}

    @property
    def number(self) -> dict[bytes, int]:
        if self._number is None:
            self._number = {w: k + 1 for k, w in enumerate(self.words)}
            self._far = self.network.context @ self.network.far
            self._near = self.network.context @ self.network.near
            # Base score and share of a number, as one complex number that is looked up and summed at once. The last
            # one is for words that are not common: their part is added later.
            self._both = np.r_[self.base(self.count) + 1j * self.inside, 0.0]
            self._output = np.r_[self.output, -1].astype(np.int16)
        return self._number

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[list[bytes], np.ndarray, np.ndarray]]:
        """Of each text's words and its end: tokens, known tokens, base and model
        scores, all without the share that rare words have in their class; and the
        rare words of all texts, their occurrences, and where each text's begin."""
        number = self.number
        start = len(self.network.context) - 1
        words, index, bounds = split_words(texts)
        own = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
        own_output = self._output.take(own)
        rare = np.flatnonzero(own < 0)
        own_output[rare] = np.fromiter((self.shortlist + 1 + ending_class(words[k], self.classes) for k in rare.tolist()), np.int16, len(rare))

        ends = bounds[1:] + np.arange(1, len(texts) + 1)  # every text has its end as a token, number 0
        begins = np.r_[0, ends[:-1]]
        said = np.ones(len(index) + len(texts), bool)
        said[ends - 1] = False
        n, o = np.zeros(len(said), np.int32), np.zeros(len(said), np.int16)
        n[said], o[said] = own.take(index), own_output.take(index)
        near, far = np.empty_like(o), np.empty_like(o)
        near[1:], far[2:] = o[:-1], o[:-2]
        near[begins] = start
        far[begins] = start
        far[begins[ends - begins > 1] + 1] = start
        z = np.empty(len(o), np.float32)
        for at in range(0, len(o), _STEP):
            f, h, w = (x[at : at + _STEP] for x in (far, near, o))
            q = self._far.take(f, 0)
            q += self._near.take(h, 0)
            z[at : at + _STEP] = np.einsum("ij,ij->i", q, self.network.out.take(w, 0)) + self.network.bias.take(w) - self.log_z[f, h]
        both = np.add.reduceat(self._both.take(n), begins)
        known = np.add.reduceat(n > 0, begins, dtype=np.int64) + int(self.count[0] > 0)
        score = np.add.reduceat(z, begins, dtype=np.float64) / np.log(10) + both.imag

        missing = np.flatnonzero(own.take(index) < 0)
        of = np.searchsorted(bounds, missing, side="right") - 1
        pairs, times = np.unique(of * len(words) + index[missing], return_counts=True) if len(missing) else (missing, missing)
        found = [words[k] for k in (pairs % max(len(words), 1)).tolist()]
        return ends - begins, known, both.real, score, (found, times, np.searchsorted(pairs // max(len(words), 1), np.arange(len(texts) + 1)))


def shards_of(training: DataFrame, output: Callable[[bytes], int], start: int, shards: int) -> DataFrame:
    """``shard, parts``: all tokens of ``training (doc_id, text)`` as outputs, a
    row per shard. A part is two outputs of context (``start`` before a text) and
    at most ``PART`` tokens; parts are dealt by a hash of what they are, and a
    shard has them in order, so neither depends on how the table is stored."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(output).__getitem__
        for batch in batches:
            of, part, codes = [], [], []
            k = 0
            for first, size in slices(batch.column(1), SLICE_BYTES):
                words, index, bounds = split_words(batch.column(1).slice(first, size))
                outputs = np.fromiter(map(code, words), np.int16, len(words)).take(index)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    t = np.empty(b - a + 3, np.int16)
                    t[0] = t[1] = start
                    t[2:-1] = outputs[a:b]
                    t[-1] = 0
                    for number, at in enumerate(range(0, len(t) - 2, PART)):
                        of.append(k)
                        part.append(number)
                        codes.append(t[at : at + PART + 2].tobytes())
                    k += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(part, pa.int64()), pa.array(codes, pa.binary())], names=["doc_id", "part", "codes"])

    def gather(table: pa.Table) -> pa.Table:
        parts = table.sort_by([("doc_id", "ascending"), ("part", "ascending"), ("codes", "ascending")]).column("codes").to_pylist()
        return pa.table({"shard": table.column("shard").slice(0, 1), "parts": pa.array([parts], pa.list_(pa.binary()))})

    kind = training.schema["doc_id"].dataType.simpleString()
    rows = training.select("doc_id", "text").mapInArrow(coded, f"doc_id {kind}, part long, codes binary")
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", "codes"), F.lit(shards))).groupBy("shard").applyInArrow(gather, "shard long, parts array<binary>")


def examples_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """History (far, near) and targets of parts."""
    codes = [np.frombuffer(x, np.int16) for x in parts]
    return np.concatenate([np.stack([t[:-2], t[1:-1]], 1) for t in codes]), np.concatenate([t[2:] for t in codes])


def learn_network(training: DataFrame, output: Callable[[bytes], int], unigram: np.ndarray, shards: int, epochs: int = EPOCHS) -> LogBilinear:
    """The network that ``epochs`` passes over all of ``training`` give. With one
    shard these are plain passes; with more, parameters and squared gradients are
    averaged after each, weighted by tokens."""
    model, seen = LogBilinear.start(unigram)
    if not shards:
        return model
    spark = training.sparkSession
    held = write_shared(shards_of(training, output, len(unigram), shards), "lm-shards")

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        n = table.column("n").to_numpy()
        state = sum(np.frombuffer(x.as_py(), np.float32).astype(float) * k for x, k in zip(table.column("state"), n, strict=True)) / n.sum()
        return pa.table({"task": table.column("task").slice(0, 1), "n": pa.array([n.sum()], pa.int64()), "state": pa.array([state.astype(np.float32).tobytes()], pa.binary())})

    for epoch in range(epochs):
        now = spark.sparkContext.broadcast((model, seen))

        def learn(batches: Iterator[pa.RecordBatch], epoch: int = epoch, now=now) -> Iterator[pa.RecordBatch]:
            """The average over a task's shards, each learnt from apart."""
            n, state = 0, 0.0
            for batch in batches:
                for shard, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own, squares = (x.filled(x.flat()) for x in now.value)
                    history, target = examples_of(parts.as_py())
                    own.learn(squares, history, target, unigram, seed=(epoch, shard))
                    n, state = n + len(target), state + np.r_[own.flat(), squares.flat()].astype(float) * len(target)
            if n:
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([n], pa.int64()), pa.array([(state / n).astype(np.float32).tobytes()], pa.binary())], names=["task", "n", "state"])

        schema = "task long, n long, state binary"
        learnt = write_shared(held.mapInArrow(learn, schema), "lm-states")
        groups = math.isqrt(max(learnt.count() - 1, 0)) + 1
        means = learnt.groupBy(F.col("task") % groups).applyInArrow(mean, schema).toArrow()
        flat = np.frombuffer(mean(means).column("state")[0].as_py(), np.float32)
        half = len(flat) // 2
        model, seen = model.filled(flat[:half]), seen.filled(flat[half:])
    return model


def score_texts(docs: DataFrame, learn: Column, shortlist: int = SHORTLIST, classes: int = CLASSES, common: int = COMMON, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, learnt (``learn``),
    n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Learning uses all rows where ``learn`` holds. A null text is empty and has
    one token, its end. Rows that repeat count each. Without rows to learn from,
    all counts are 0, the base is uniform over nothing known, and the network is
    its untrained start. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(learn, F.lit(False)).alias("learnt"))
    training = docs.where("learnt")
    counts = write_shared(count_words(training), "lm-counts")
    ends = training.count()

    # The count from which on at most `common` words lie, from a histogram of bounded size.
    level = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 512)
    levels = sorted(((r["level"], r["n"], r["least"], r["tokens"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.sum("c").alias("tokens")).collect()), reverse=True)
    distinct, total = sum(x[1] for x in levels) + (ends > 0), sum(x[3] for x in levels) + ends
    least, held = None, 0
    for _, n, at, _ in levels:
        if held + n > common:
            break
        held += n
        least = at
    top = counts.where(F.col("c") >= least).toArrow() if least is not None else None
    words = top.column("word").to_pylist() if top is not None else []
    c = top.column("c").to_numpy().astype(np.int64) if top is not None else np.zeros(0, np.int64)
    order = sorted(range(len(words)), key=lambda k: (-c[k], words[k]))
    words, c = [words[k] for k in order], c[order]
    shortlist = short = min(shortlist, len(words))

    # Class totals over all words that are not in the shortlist.
    ending = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(classes)).cast("int")
    by_class = counts.groupBy(ending.alias("class")).agg(F.sum("c").alias("tokens"), F.count(F.lit(1)).alias("words")).collect()
    size, kinds_of = np.zeros(classes), np.zeros(classes)
    for r in by_class:
        size[r["class"]], kinds_of[r["class"]] = r["tokens"], r["words"]
    own = np.array([ending_class(w, classes) for w in words], np.int64)
    np.subtract.at(size, own[:short], c[:short])
    np.subtract.at(kinds_of, own[:short], 1)
    unseen = np.where(size > 0, DISCOUNT * kinds_of / np.maximum(size, 1), 1.0)
    outputs = 1 + shortlist + classes
    output = np.r_[0, 1 + np.arange(short), shortlist + 1 + own[short:]].astype(np.int64)
    share = -np.log10(np.maximum(size, 1))
    inside = np.r_[0.0, np.zeros(short), share[own[short:]] + np.log10(c[short:] - DISCOUNT)]
    unigram = np.full(outputs, 0.1)
    unigram[0] += ends
    unigram[1 : short + 1] += c[:short]
    unigram[shortlist + 1 :] += size
    unigram /= unigram.sum()

    number = {w: k + 1 for k, w in enumerate(words[:short])}
    network = learn_network(training, lambda w: number.get(w) or shortlist + 1 + ending_class(w, classes), unigram, -(-total // shard_tokens))
    model = TextModel(words, output, inside, np.r_[ends, c], network, network.normaliser(), total, distinct, classes, shortlist)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for at, size in slices(batch.column(3), SLICE_BYTES):
                *values, (words, n, bounds) = fitted.score(batch.column(3).slice(at, size))
                of = pa.array([ending_class(w, classes) for w in words], pa.int32())
                rare = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), of], names=["word", "n", "class"])
                values = [pa.array(x, t) for x, t in zip(values, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                keys = [batch.column(k).slice(at, size) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, *values, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rare)], names=["rid", "doc_id", "learnt", "n_tokens", "n_known", "base", "score", "rare"])

    placed = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "learnt", "text")
    schema = f"rid long, doc_id {kind}, learnt boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, n: bigint, class: int>>"
    scored = write_shared(placed.mapInArrow(run, schema), "lm-scored")

    # Rare words' counts: an equi-join on the word; a hot unknown word is split by adaptive execution.
    others = counts.where(F.col("c") < least) if least is not None else counts
    known_share = F.array(*(F.lit(float(x)) for x in share))
    new_share = F.array(*(F.lit(float(x)) for x in np.log10(unseen)))
    met = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.*").join(others, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = met.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / F.lit(total + 0.1 * (distinct + 1)))).alias("base_rare"),
        F.sum(F.col("n") * F.when(F.col("c") > 0, F.get(known_share, "class") + F.log10(F.greatest("c", F.lit(1)) - DISCOUNT)).otherwise(F.get(new_share, "class"))).alias("score_rare"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return scored.join(rest, "rid", "left").select(
        "doc_id",
        "learnt",
        "n_tokens",
        (F.col("n_known") + zero("known_rare")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_rare")).alias("base_score"),
        (F.col("score") + zero("score_rare")).alias("score"),
    )
