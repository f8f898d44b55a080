import random

from pyspark.sql import functions as F

from conftest import SMALL
from oracle import assert_same
from tideline.llm.chat import examples, format_chat, read_loss, read_turns
from tideline.llm.queries import ORACLE_SQL, op5_chat

PIECES = ["\\", "#", "##", "###", "\n### ", "User: ", "Assistant: ", " </turn>", "</turn", ">", ": ", " ", "a", "é", "\U0001f600", "\\### Assistant: </turn> ok", "\n"]


def conversations(n=40, seed=1):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            text = None if rng.random() < 0.1 else "".join(rng.choice(PIECES) for _ in range(rng.randrange(8)))
            out.append((c, t, rng.choice(["user", "assistant", "system", "tool: x", "User", "", None, "a###b"]), text))
    return out


def test_round_trip_and_loss(spark):
    rows = conversations() + [(99, 0, "assistant", "y"), (99, 0, "assistant", "y"), (99, None, "user", "first"), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    stored = format_chat(df)
    back = {r["conv_id"]: r for r in stored.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss().alias("loss")).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert back.keys() == want.keys()
    for c, turns in want.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [t[2:] for t in turns]
        assert back[c]["loss"] == "".join(t[3] for t in turns if t[2] == "assistant")


def test_examples_are_prefixes_with_one_reply(spark):
    df = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1 ###"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2")], "conv_id long, turn long, role string, text string")
    stored = format_chat(df)
    whole = stored.first()["formatted"]
    found = examples(stored).orderBy("example").collect()
    assert [r["text"][r["loss_from"] : r["loss_to"]] for r in found] == ["a1 \\###", "a2"]
    assert all(whole.startswith(r["text"]) for r in found) and found[1]["text"] == whole
    assert examples(format_chat(df.where("role = 'user'"))).count() == 0


def test_many_turns(spark):
    """Building the stored form is linear in the turns."""
    n = 30_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    stored = format_chat(df.repartition(4)).select("formatted", F.size("turns").alias("turns"), F.element_at("examples", -1).alias("last")).first()
    assert stored["turns"] == n and stored["last"]["end"] == len(stored["formatted"])
    assert stored["formatted"][stored["last"]["from"] : stored["last"]["to"]] == f"t{n - 1}"


def test_empty(spark):
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query(spark):
    assert_same(op5_chat(spark, SMALL), ORACLE_SQL["op5_chat"], SMALL)


def test_query_comes_from_the_examples(spark, monkeypatch):
    from tideline.llm import queries

    monkeypatch.setattr(queries, "examples", lambda stored: examples(stored).where("example = 0"))
    assert op5_chat(spark, SMALL).agg(F.max("n_examples")).first()[0] == 1
