"""Benchmark decontamination by winnowing.

Both sides are fingerprinted: of every ``window`` consecutive words the smallest
hash among its ``gram``-word grams is kept. A shared window selects the same gram
on both sides, so joining documents' and items' fingerprints finds every shared
span of ``window`` words or more. Each hit is then extended word by word to the
left and right, as far as windows around its gram can reach, and counts only if
the words agree over a whole window, so hash collisions change nothing.

Only DataFrame functions run, in one pass over the texts. Arrays are shifted
against each other (``zip_with``), and whether a gram is kept is asked at its
place, so the work per word does not depend on a text's length. A document's fingerprints meet a bitmap of the items' fingerprints
in their row, and only those that may match leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, ascii_lower, with_place, without_keys, write_shared

WINDOW = 10
GRAM = 4
_NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_EMPTY = "cast(array() as array<bigint>)"


def words(text: Column) -> Column:
    """ASCII digits and letters (lower-cased) and all characters beyond ASCII
    make words; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_A_WORD), "")


def _shift(array: str, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _doubling(df: DataFrame, source: str, out: str, width: int, combine) -> DataFrame:
    """Column ``out``: at each place the combination of ``width`` neighbours from
    there on, in about log2(width) passes. The last ``width - 1`` places combine
    what is there (nulls where neighbours are missing)."""
    have, cover = source, 1
    while cover < width:
        by = min(cover, width - cover)
        df = df.withColumn(f"{out}_{cover}", F.zip_with(have, _shift(have, by), combine))
        have, cover = f"{out}_{cover}", cover + by
    return df.withColumn(out, F.col(have))


def with_hashes(df: DataFrame, gram: int, out: str = "_h") -> DataFrame:
    """Hashes of the ``gram``-word grams of ``_words``; none if it has fewer."""
    if gram == 1:
        df = df.withColumn("_g", F.transform("_words", lambda w: F.xxhash64(w)))
    else:
        parts = [1]
        while 2 * parts[-1] <= gram:
            parts.append(2 * parts[-1])
        have = "_words"
        for k, size in enumerate(parts[1:]):
            df = df.withColumn(f"_g{k}", F.zip_with(have, _shift(have, size // 2), lambda a, b: F.xxhash64(a, b)))
            have = f"_g{k}"
        if parts[-1] < gram:  # two overlapping grams cover the rest
            df = df.withColumn("_g", F.zip_with(have, _shift(have, gram - parts[-1]), lambda a, b: F.xxhash64(a, b)))
        else:
            df = df.withColumn("_g", F.col(have))
    return df.withColumn(out, F.slice("_g", 1, F.greatest(F.size("_words") - (gram - 1), F.lit(0))))


def with_minima(df: DataFrame, width: int, source: str = "_h", out: str = "_m") -> DataFrame:
    """At each place the smallest hash of ``width`` neighbouring grams from there on."""
    return _doubling(df, source, out, width, lambda a, b: F.least(a, b))


def _kept_places(test, width: int) -> Column:
    """Places (from 1) of the hashes for which ``test`` holds and that winnowing
    keeps: those that are the smallest of one of the ``width`` windows that they
    lie in."""

    def kept(at: Column) -> Column:
        first = F.greatest(at - (width - 1), F.lit(1))
        return F.exists(F.slice("_m", first, at - first + 1), lambda m: m == F.get("_h", at - 1))

    return F.filter(F.array_compact(F.transform("_h", lambda h, i: F.when(test(h), i + 1))), kept)


def _bits(count: int) -> int:
    """A power of two with 16 places a key, between 2**16 and 2**27 (16 MB)."""
    return min(27, max(16, (16 * max(count, 1) - 1).bit_length()))


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """One row: an array of longs with a bit set for each key's hash."""
    place = F.pmod(F.col("hash"), F.lit(1 << bits))
    set_ = keys.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).distinct()
    longs = set_.groupBy("at").agg(F.bit_or("bit").alias("long"))
    filled = keys.sparkSession.range(1 << (bits - 6)).join(longs, F.col("id") == F.col("at"), "left")
    return filled.groupBy(F.lit(0).alias("_one")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("long", F.lit(0).cast("long")).alias("long")))), lambda x: x["long"]).alias("_bitmap")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item; an item with fewer words
    is one window, and one without words has none. A document's word inside any
    occurrence of a window is hit. Null texts have no words; rows of an item that
    repeat or share an item_id count as that one item; repeated documents get a
    row each; empty tables give no rows, or documents without hits. An item
    without an id counts in n_hit and as one in n_items, and adds nothing to
    items_sha256. Other columns of both tables are ignored, but for those that
    ``carry`` names, which stand before the others.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("_words"))
    items = write_shared(items.where("size(_words) > 0").distinct(), "decontam-items")
    # The ways to look: windows by their winnowed grams; items that are shorter, by hashes of as many words as they have.
    short = sorted(r[0] for r in items.where(F.size("_words") < window).select(F.size("_words")).distinct().collect())
    anchors = _item_anchors(items, window, gram, short)
    anchors = write_shared(anchors, "decontam-anchors")
    keys = anchors.select("kind", "hash").distinct()
    counts = {r["kind"]: r["n"] for r in keys.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}

    base = docs.select(*carry, "doc_id", words(F.col("text")).alias("_words")).withColumn("_rid", F.monotonically_increasing_id())
    found = []
    for kind in sorted(counts):
        base = _with_candidates(base, spark, keys.where(F.col("kind") == kind), counts[kind], kind, window, gram)
        found.append(f"_found_{kind}")
    together = F.concat(*found) if found else F.expr("cast(array() as array<struct<kind: int, hash: bigint, at: int, first: int, words: array<string>>>)")
    scanned = write_shared(base.select(*carry, "_rid", "doc_id", F.size("_words").cast("long").alias("n_words"), together.alias("found")), "decontam-scan")

    met = scanned.select("_rid", F.explode("found").alias("f")).select("_rid", "f.*").join(anchors, ["kind", "hash"])
    spans = _extended(met, window, gram).distinct()
    hit = spans.groupBy("_rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("long")).alias("unnamed"))
    hit = hit.select(
        "_rid",
        F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))).cast("long").alias("n_hit"),
        (F.size("items") + F.col("unnamed")).alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
    )
    none = F.coalesce("n_hit", F.lit(0).cast("long"))
    return scanned.select(*carry, "_rid", "doc_id", "n_words").join(hit, "_rid", "left").select(
        *carry,
        "doc_id",
        "n_words",
        none.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (none > 0).alias("contaminated"),
    )


def _context(at: Column, n: int, reach: int) -> tuple[Column, Column]:
    """First word (from 1) and number of words around a gram at ``at``."""
    first = F.greatest(at - reach, F.lit(1))
    return first, at + n + reach - first


def _item_anchors(items: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """kind (0 for windows, else the length of the item), hash, item, and the
    words around with the gram's place: item_at, item_first, item_words."""
    parts = []
    for kind, of in [(0, items.where(F.size("_words") >= window)), *((m, items.where(F.size("_words") == m)) for m in short)]:
        n = kind or gram
        width = 1 if kind else window - gram + 1
        have = with_minima(with_hashes(of, n), width)
        at = _kept_places(lambda h: h.isNotNull(), width)
        placed = have.select("item", "_words", F.explode(F.transform(at, lambda at: F.struct(F.get("_h", at - 1).alias("hash"), at.alias("at")))).alias("x"))
        first, size = _context(F.col("x.at"), n, 0 if kind else window - gram)
        parts.append(
            placed.select(F.lit(kind).alias("kind"), "x.hash", "item", F.col("x.at").alias("item_at"), first.alias("item_first"), F.slice("_words", first, size).alias("item_words"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_candidates(base: DataFrame, spark, keys: DataFrame, count: int, kind: int, window: int, gram: int) -> DataFrame:
    """Column ``_found_<kind>``: the document's fingerprints that may be an
    item's, at all their places, with the words around."""
    n, bits, reach = kind or gram, _bits(count), 0 if kind else window - gram
    columns = base.columns
    width = 1 if kind else window - n + 1
    have = with_minima(with_hashes(base, n), width)
    have = have.select(*columns, "_h", "_m").withColumn("_one", F.lit(0)).join(F.broadcast(_bitmap(keys, bits)), "_one", "left")

    def maybe(h: Column) -> Column:
        place = F.pmod(h, F.lit(1 << bits))
        word = F.get("_bitmap", F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def around(at: Column) -> Column:
        first, size = _context(at, n, reach)
        return F.struct(F.lit(kind).alias("kind"), F.get("_h", at - 1).alias("hash"), at.alias("at"), first.alias("first"), F.slice("_words", first, size).alias("words"))

    have = have.withColumn("_at", _kept_places(maybe, width))
    return have.select(*columns, F.transform("_at", around).alias(f"_found_{kind}"))


def _extended(met: DataFrame, window: int, gram: int) -> DataFrame:
    """``_rid, item, start, end`` (document words from 0, end excluded) of the
    matches that reach over a whole window."""
    n = F.when(F.col("kind") > 0, F.col("kind")).otherwise(F.lit(gram))
    need = F.when(F.col("kind") > 0, F.col("kind")).otherwise(F.lit(window))
    # Both sides' words, aligned at the gram: what stands left of it, reversed, and what stands from it on.
    doc_left = F.reverse(F.expr("slice(words, 1, at - first)"))
    item_left = F.reverse(F.expr("slice(item_words, 1, item_at - item_first)"))
    doc_right = F.expr("slice(words, at - first + 1, size(words))")
    item_right = F.expr("slice(item_words, item_at - item_first + 1, size(item_words))")

    def run(a: Column, b: Column) -> Column:
        """Length of the common start."""
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        first_wrong = F.array_position(same, False)
        return F.when(first_wrong > 0, first_wrong - 1).otherwise(F.size(same)).cast("int")

    out = met.withColumn("left", run(doc_left, item_left)).withColumn("right", run(doc_right, item_right))
    return out.where((F.col("right") >= n) & (F.col("left") + F.col("right") >= need)).select(
        "_rid", "item", (F.col("at") - 1 - F.col("left")).alias("start"), (F.col("at") - 1 + F.col("right")).alias("end")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` without the rows that share a window with an item, whatever their
    ids: rows are told apart by their places in files."""
    placed = with_place(docs)
    found = decontaminate(placed, benchmark, window, gram, carry=(FILE, ROW))
    dropped = write_shared(found.where("contaminated").select(FILE, ROW), "decontam-dropped")
    return without_keys(placed, dropped, FILE, ROW).select(*docs.columns)
