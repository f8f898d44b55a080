"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are compared in tiles: numpy exclusive-or of one tile's fingerprints
with another's, bit counts of the results, and tile pairs whose population counts
differ by more than the radius are skipped, for the counts' difference is a lower
bound of the distance.

Comparing all tiles of a large corpus with each other is quadratic, so which
tiles meet is decided without loss: cut the 64 bits into ``radius + 1`` blocks,
and two fingerprints at most ``radius`` bits apart agree in one block at least.
Tiles therefore hold distinct fingerprints with a common block, and only they are
compared. A block value that holds more than ``tile`` fingerprints is cut into
several tiles, and each pair of them is a group of its own, so no task gathers an
unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import ASCII_LOWER, FILE, ROW, small_batches, with_place, without_keys, write_shared
from .components import connected_components

RADIUS = 3
#: Fingerprints in a tile at most; a task holds two tiles.
TILE = 4096
_STEP = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).
    Texts with fewer words than a shingle are one shingle; none gives 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not parts:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(parts) < words:
        return int.from_bytes(digest(join(parts), 42), "big")
    n = len(parts) - words + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        rows = [digest(join(x), 42) for x in zip(*(parts[at + i : min(at + _STEP, n) + i] for i in range(words)), strict=True)]
        bits = np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (the unsigned 64 bits in a signed long) of whole texts, and
    the columns that ``carry`` names."""
    rows = docs.select(F.col("text").cast("string").alias("text"), "doc_id", *carry)
    names = [*rows.columns[1:], "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(0)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], names=names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], StructField("fp", LongType())]))


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int = RADIUS, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) with ``a[i]`` and ``b[j]`` at most ``radius`` bits apart.
    Both are cut into tiles in order of their population counts."""
    found_i, found_j = [], []
    pa_, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    for i in range(0, len(a), step):
        x = oa[i : i + step]
        low, high = pa_[x[0]] - radius, pa_[x[-1]] + radius
        for j in range(0, len(b), step):
            y = ob[j : j + step]
            if pb[y[-1]] < low or pb[y[0]] > high:
                continue
            near = np.bitwise_count(a[x][:, None] ^ b[y][None, :]) <= radius
            p, q = np.nonzero(near)
            found_i.append(x[p])
            found_j.append(y[q])
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (i, j): each node's smallest reachable node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _near_pairs(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within runs of equal ``key``. side: 0 and 1 for the two tiles
    of a pair of tiles, which are compared with each other only; 2 for a tile
    that is compared with itself."""
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[cuts, len(key)])
    found_i, found_j = [], []
    for start, size in zip(cuts[sizes > 48], sizes[sizes > 48], strict=True):
        own = np.arange(start, start + size)
        left, right = own[side[own] != 1], own[side[own] != 0]
        i, j = compare_tiles(fp[left], fp[right], radius)
        found_i.append(left[i])
        found_j.append(right[j])
    small = np.flatnonzero(np.repeat(sizes, sizes) <= 48)
    for by in range(1, 48):
        near = small[by:][key[small[by:]] == key[small[:-by]]] if len(small) > by else small[:0]
        if not len(near):
            break
        other = near - by
        # exclusive-or at a distance of `by` places compares one diagonal of all small tiles at once
        good = (np.bitwise_count(fp[near] ^ fp[other]) <= radius) & ((side[near] == 2) | (side[near] != side[other]))
        found_i.append(other[good])
        found_j.append(near[good])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``a, b`` between rows of ``fps (node, fp)``, whose ``fp`` are
    distinct. Fingerprints within the radius are connected by these edges, which
    are a spanning forest of each group of tiles and not all near pairs."""
    blocks = radius + 1
    edges_at = [round(64 * i / blocks) for i in range(blocks + 1)]
    values = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges_at, edges_at[1:], strict=False)]
    placed = fps.select("node", "fp", F.explode(F.array(*(F.struct(F.lit(k).alias("block"), v.alias("value")) for k, v in enumerate(values)))).alias("at"))
    placed = placed.select("node", "fp", "at.block", "at.value")
    # At most radius + 1 times 2 ** (64 / (radius + 1)) values exist (262,144 at radius 3), and of these only the large ones.
    large = placed.groupBy("block", "value").count().where(F.col("count") > tile).select("block", "value", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    dealt = placed.join(large, ["block", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    key = F.xxhash64("block", "value", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(key.alias("key"), side.cast("byte").alias("side"), "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def solve(x: list[np.ndarray]) -> pa.RecordBatch:
            i, j = _near_pairs(x[0], x[1], x[3].view(np.uint64), radius)
            label = _forest_in(len(x[0]), i, j)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(x[2][label[moved]]), pa.array(x[2][moved])], names=["a", "b"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            x = now if rest is None else [np.concatenate(p) for p in zip(rest, now, strict=True)]
            if not len(x[0]):
                continue
            cut = int(np.searchsorted(x[0], x[0][-1]))  # the last key may go on in the next batch
            if cut:
                yield solve([c[:cut] for c in x])
            rest = [c[cut:] for c in x]
        if rest is not None and len(rest[0]):
            yield solve(rest)

    kind = fps.schema["node"].dataType.simpleString()
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"a {kind}, b {kind}").where("a is not null and b is not null and a <> b")


def _forest_in(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """As _forest, over the nodes that have edges only."""
    label = np.arange(n)
    if len(i):
        used, back = np.unique(np.r_[i, j], return_inverse=True)
        label[used] = used[_forest(len(used), back[: len(i)], back[len(i) :])]
    return label


def _named(prints: DataFrame, who: Column, radius: int, tile: int) -> DataFrame:
    """``fp, least``: per fingerprint the least ``who`` of its component."""
    nodes = write_shared(prints.groupBy("fp").agg(F.min(who).alias("least")), "simhash-nodes")
    edges = write_shared(links(nodes.select(F.col("fp").alias("node"), "fp"), radius, tile), "simhash-links")
    found = connected_components(edges, "simhash-components")
    # Only fingerprints with links need their component's least one.
    linked = write_shared(nodes.join(found, F.col("fp") == F.col("node")).select("fp", "component", "least"), "simhash-linked")
    best = linked.groupBy("component").agg(F.min("least").alias("best"))
    moved = linked.select("fp", "component").join(best, "component").select(F.col("fp").alias("_fp"), "best")
    return nodes.join(moved, F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("best", "least").alias("least"))


def simhash_components(docs: DataFrame, radius: int = RADIUS, words: int = 3, tile: int = TILE) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits. Rows with equal fingerprints are one node, so any
    number of copies costs one comparison. A null text has no words and
    fingerprint zero, which links as any other. A row without a doc_id takes part
    through its fingerprint, links others and never names a component; one that
    holds only such rows has a null component_id. Further columns are ignored; an
    empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        prints = write_shared(fingerprints(docs, words), "simhash")
    named = _named(prints, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"), radius, tile)
    return prints.join(named, "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def hex_fp(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = 3, tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id,
    a null one last, and of rows that share it the first by file and position."""
    placed = with_place(docs)
    with small_batches(docs.sparkSession):
        prints = write_shared(fingerprints(placed, words, (FILE, ROW)), "simhash")
    named = _named(prints, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW), radius, tile)
    gone = prints.join(named, "fp").where((F.col(FILE) != F.col(f"least.{FILE}")) | (F.col(ROW) != F.col(f"least.{ROW}")))
    return without_keys(placed, write_shared(gone.select(FILE, ROW), "simhash-dropped"), FILE, ROW).select(*docs.columns)
