import random

import xxhash
from pyspark.sql import functions as F

from tideline.llm.components import connected_components
from tideline.llm.simhash import drop_near_duplicates, fingerprint, hex_fp, simhash_components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    fps = [slow_fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, f"{fps[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(docs))


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 30, 300]))) for _ in range(n // 4)]
    out = []
    for k in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "other"
        out.append((k * 3 % n if n % 3 else k, " ".join(words)))
    return out + [(n + 1, None), (n + 2, ""), (n + 3, "  \n"), (n + 4, "É É É É"), (n + 5, "é é é é"), (n + 6, "A b\tC d"), (n + 7, "a B c\x0bD")]


def test_fingerprint_of_many_texts():
    for _, t in corpus():
        assert fingerprint(t) == slow_fingerprint(t)
    long = " ".join(str(k % 977) for k in range(70_000))
    assert fingerprint(long) == slow_fingerprint(long)


def test_components_match_brute_force(spark, rows):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for tile in (4096, 2):  # with a tile of two most groups are cut
        found = simhash_components(df, tile=tile).select("doc_id", hex_fp().alias("f"), "component_id")
        assert rows(found) == brute(docs)


def test_many_near_fingerprints_in_one_block(spark, rows):
    """Fingerprints that share all blocks but one, in chains of three bits."""
    from tideline.llm.simhash import links

    nodes = [(k, k) for k in range(1 << 9)]
    edges = links(spark.createDataFrame(nodes, "node long, fp long"), tile=50)
    found = connected_components(edges)
    assert {r["component"] for r in found.collect()} == {0} and found.count() == 512


def test_components_of_a_long_path(spark, rows):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 500), (700, 701), (None, 3)], "a long, b long")
    assert rows(connected_components(edges), "node", "component") == [(k, 0) for k in range(101)] + [(700, 700), (701, 700)]
    assert connected_components(edges.where("false")).count() == 0


def test_rows_without_ids_link_others(spark, rows):
    """Fingerprints in a chain whose middle one only rows without an id have."""
    from tideline.llm.simhash import _named

    prints = spark.createDataFrame([(5, 0), (None, 0b111), (None, 0b111), (9, 0b111111), (None, 255 << 40)], "doc_id long, fp long")
    named = _named(prints, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"), 3, 4096)
    assert rows(named, "fp", "least.doc_id") == [(0, 5), (0b111, 5), (0b111111, 5), (255 << 40, None)]
    alone = simhash_components(spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string"))
    assert [r["component_id"] for r in alone.collect()] == [None, None]


def test_survivors(spark, rows):
    docs = [(4, "one two three four five six"), (2, "one two three four five six"), (9, "something else entirely is here"), (None, "one two three four five six")]
    docs += [(2, "one two three four five six"), (9, "a text of its own which shares an id only"), (None, "nobody else says this at all"), (None, "nobody else says this at all")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fp string").withColumns({c: F.lit(1) for c in ("_maybe", "_bucket", "node", "least", "component")})
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id", "text") == [(2, docs[0][1]), (9, docs[5][1]), (9, docs[2][1]), (None, docs[6][1])]
    assert drop_near_duplicates(df.where("false")).count() == 0
