import hashlib
import random
import re

from pyspark.sql import functions as F

from conftest import SMALL
from oracle import assert_same
from tideline.llm.decontam import decontaminate, drop_contaminated
from tideline.llm.queries import ORACLE_SQL, op8_decontamination


def words(t):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(docs, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if ids := grams.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(spark, docs, items, **k):
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **k)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str) == brute(docs, items, k.get("window", 10))


def test_matches_brute_force(spark):
    rng = random.Random(4)
    text = lambda n, v=12: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    items = [(k, text(rng.choice([3, 9, 10, 11, 25]), 40)) for k in range(25)] + [(100, None), (101, "..."), (102, "solo"), (2, "shares an id with another item and has ten words now"), (103, "aa " * 14)]
    docs = []
    for k in range(60):
        part = rng.choice(items)[1] or ""
        cut = part.split()[rng.randrange(3) :]
        docs.append((k, f"{text(rng.randrange(30))}, {' '.join(cut)}! {text(rng.randrange(15))}"))
    docs += [(70, None), (71, ""), (72, "SOLO"), (73, "aa " * 40), (5, docs[5][1]), (None, docs[7][1]), (74, "é" * 5 + " wörter")]
    check(spark, docs, items)
    check(spark, docs, items, window=5, gram=2)


def test_long_text_and_repeats(spark):
    item = " ".join(f"q{k}" for k in range(30))
    check(spark, [(1, "z " * 20_000 + item + " z" * 9), (2, (item + " ") * 3)], [(1, item), (2, item)])


def test_wholly_matching_text(spark):
    """A long text all of whose words match, in time linear in its length."""
    rng = random.Random(9)
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(5_000))
    check(spark, [(1, item), (2, f"{item} {item}")], [(1, item)])


def test_items_without_id(spark):
    docs = [(1, "a b c d e"), (2, "a b x y"), (3, "x y")]
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(None, "a b"), (None, "c d"), (7, "x y")], "item_id long, text string"))
    assert sorted((r["doc_id"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in found.collect()) == [
        (1, 4, 1, hashlib.sha256(b"").hexdigest()),
        (2, 4, 2, hashlib.sha256(b"7").hexdigest()),
        (3, 2, 1, hashlib.sha256(b"7").hexdigest()),
    ]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(docs.where("false"), items).count() == 0
    assert decontaminate(docs, items.where("false")).first()["n_hit"] == 0


def test_survivors_keep_columns(spark, rows):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, "d e", 6), (None, "x", 7)], "doc_id long, text string, words int").withColumns({c: F.lit(1) for c in ("_maybe", "_words", "_rid", "found", "kind", "_one")})
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and rows(kept, "words") == [(6,), (7,)]
    shared = spark.createDataFrame([(1, "a b c", 5), (1, "d e", 6), (None, "b c", 7), (None, "x", 8)], "doc_id long, text string, words int")
    assert rows(drop_contaminated(shared, items), "words") == [(6,), (8,)]


def test_query(spark):
    assert_same(op8_decontamination(spark, SMALL), ORACLE_SQL["op8_decontamination"], SMALL)
