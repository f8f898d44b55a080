r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its
context, and only that reply is trainable. The template marks turns,

    \n### Role: text </turn>

and escapes control strings inside texts reversibly: a backslash goes before each
backslash, each ``#`` that starts ``###`` and each ``<`` that starts ``</turn>``,
so neither marker can come from a text, and unescaping gives back every text.

An example of a conversation is a prefix of the whole conversation in this
template, so what is stored per conversation is its formatted text once, with a
span per turn and an end per example; that takes time linear in the turns.
``examples`` expands it to one row per example. The examples' texts grow with the
square of a conversation's turns, as prefixes do; the rows are made one at a time.

Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "\n### ", ": ", " </turn>"


def escape(text: Column) -> Column:
    r"""Backslashes are doubled; ``###`` and ``</turn>`` get one in front."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\###"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\</turn>"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: each backslash stands for what follows it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    """A role as the marker shows it: the three usual ones with a capital, any
    other after ``=``, escaped, and without the ``: `` that ends a role."""
    other = F.replace(escape(role), F.lit(MIDDLE), F.lit(":\\ "))
    return F.when(role.isin("user", "assistant", "system"), F.initcap(role)).otherwise(F.concat(F.lit("="), other))


def _role_back(shown: Column) -> Column:
    return F.when(shown.startswith("="), unescape(F.substr(shown, F.lit(2)))).otherwise(F.lower(shown))


def format_chat(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, turns, examples``.

    ``turns``: per turn in order its span in ``formatted`` (``start``, ``end``:
    code points, the marker included) and that of its escaped text (``from``,
    ``to``), and whether it is an assistant's. ``examples``: per assistant turn
    the length of its prefix of ``formatted`` (``end``) and its loss span
    (``from``, ``to``).

    Turns are ordered by turn; rows with the same turn by role, then text; a row
    that repeats is a turn of its own. A null turn comes first. A null text or
    role is empty. Rows with a null conv_id form one conversation. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(MIDDLE))).withColumn("body", escape(F.col("text")))
    # Where a turn ends is a running sum; the grouping takes over the window's partitioning. Ends grow, so they order the turns.
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(CLOSE)).withColumn("end", F.sum("size").over(in_order).cast("int"))
    turn = F.struct(
        "end",
        (F.col("end") - F.col("size")).alias("start"),
        (F.col("end") - len(CLOSE) - F.length("body")).alias("from"),
        (F.col("end") - len(CLOSE)).alias("to"),
        (F.col("role") == "assistant").alias("reply"),
        F.concat("head", "body", F.lit(CLOSE)).alias("shown"),
    )
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    out = grouped.select("conv_id", F.array_join(F.transform("t", lambda t: t["shown"]), "").alias("formatted"), F.transform("t", lambda t: t.dropFields("shown")).alias("turns"))
    return out.withColumn("examples", F.transform(F.filter("turns", lambda s: s["reply"]), lambda s: F.struct(s["end"].alias("end"), s["from"].alias("from"), s["to"].alias("to"))))


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example`` (from 0), ``text`` (all
    preceding turns and this one), ``loss_from`` and ``loss_to`` (code points)."""
    one = formatted.select("conv_id", "formatted", F.posexplode("examples").alias("example", "x"))
    return one.select("conv_id", "example", F.expr("substring(formatted, 1, x.end)").alias("text"), F.col("x.from").alias("loss_from"), F.col("x.to").alias("loss_to"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds, as structs of role and text.

    No regular expression over texts is needed: in a text a backslash stands
    before every ``</turn>`` and every ``###``, so the closing marker, which has
    a space there, occurs at the ends of turns only, and a role has no ``: ``.
    """
    turns = F.filter(F.split(formatted, rf"\Q{CLOSE}\E"), lambda t: t != "")

    def parts(t: Column) -> Column:
        shown = F.substr(F.substring_index(t, MIDDLE, 1), F.lit(len(OPEN) + 1))
        body = F.substr(t, F.length(shown) + len(OPEN) + len(MIDDLE) + 1)
        return F.struct(_role_back(shown).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, parts)


def read_loss(formatted: str = "formatted", examples: str = "examples") -> Column:
    """The unescaped text under the loss mask of all examples, in order."""
    spans = F.transform(examples, lambda x: unescape(F.substr(F.col(formatted), x["from"] + 1, x["to"] - x["from"])))
    return F.array_join(spans, "")
