"""The command language: one command a line, chosen by its first character.

    p KEY VALUE    put              g KEY      get
    d KEY          delete           r LO HI    range, LO included, HI excluded
    l "FILE"       load pairs       s          summary

A line that starts with white space is skipped. Integers are C's ``%i``, white
space between tokens may be missing, and what follows the last token is ignored.
The first line in error ends the script; what came before stands.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.integers import INT, parse_int
from ..operators.ordinals import with_ordinal
from ..operators.reads import asof_get, asof_range, render_ranges
from ..operators.runs import contents, label, layout, summary_levels
from .shared import write_shared

_ARGUMENTS = {"p": rf"^p\s*{INT}\s*{INT}", "g": rf"^g\s*{INT}", "d": rf"^d\s*{INT}", "r": rf"^r\s*{INT}\s*{INT}"}
_FILE = r'^l\s*"\s*([^\s"]*)(\S*)'
# The messages.
_MESSAGES = {
    "p": "Invalid insert command, two arguments are required",
    "g": "Invalid get command, one integer argument is required",
    "d": "Invalid delete command, one integer argument is required",
    "r": "Invalid range command, two arguments are required",
    "l": "Invalid load command, one filename argument in double quotes is required",
}
UNREADABLE = "Could not read from file "
UNKNOWN = "unknown command: "
_NAMES = {"p": "put", "g": "get", "d": "delete", "r": "range", "l": "load", "s": "summary"}
#: Positions that a line's loaded pairs may take.
_STEP = 1 << 32


def parse_commands(lines: DataFrame) -> DataFrame:
    """``ord, op, a, b, path, message`` of each row of ``lines (ord, line)`` that
    is no blank: op is put, get, delete, range, load, summary or error; ``a`` and
    ``b`` are its integers. A null line is blank; an integer outside 32 bits is an
    error."""
    first = F.substr(F.col("line"), F.lit(1), F.lit(1))

    def argument(k: int) -> Column:
        out = F.lit(None).cast("string")
        for c, pattern in _ARGUMENTS.items():
            if k == 1 or c in "pr":
                out = F.when(first == c, F.regexp_extract("line", pattern, k)).otherwise(out)
        return parse_int(out)

    rows = lines.where(F.col("line").isNotNull() & (F.col("line") != "") & ~F.col("line").rlike(r"^\s"))
    rows = rows.select("ord", "line", first.alias("c"), argument(1).alias("a"), argument(2).alias("b"), F.when(first == "l", F.regexp_extract("line", _FILE, 1)).alias("path"), F.regexp_extract("line", _FILE, 0).alias("load"))
    bad = F.when(F.col("c").isin("p", "r"), F.col("a").isNull() | F.col("b").isNull()).when(F.col("c").isin("g", "d"), F.col("a").isNull())
    bad = bad.when(F.col("c") == "l", (F.col("load") == "") | ~F.col("line").rlike(r'^l\s*"\s*\S')).when(F.col("c") == "s", F.lit(False)).otherwise(True)
    text = reduce(lambda w, x: w.when(F.col("c") == x[0], x[1]), list(_MESSAGES.items())[1:], F.when(F.col("c") == "p", _MESSAGES["p"])).otherwise(F.concat(F.lit(UNKNOWN), "line"))
    name = reduce(lambda w, x: w.when(F.col("c") == x[0], x[1]), list(_NAMES.items())[1:], F.when(F.col("c") == "p", "put"))
    return rows.withColumn("bad", bad).select(
        "ord",
        F.when(F.col("bad"), "error").otherwise(name).alias("op"),
        F.when(~F.col("bad"), F.col("a")).alias("a"),
        F.when(~F.col("bad"), F.col("b")).alias("b"),
        F.when(~F.col("bad"), F.col("path")).alias("path"),
        F.when(F.col("bad"), text).alias("message"),
    )


def is_malformed(output: str) -> bool:
    """Whether an output is the message of a malformed command."""
    return output in _MESSAGES.values()


def is_error(output: str) -> bool:
    """Whether an output ended its script."""
    return is_malformed(output) or output.startswith((UNKNOWN, UNREADABLE))


def first_error(parsed: DataFrame) -> int | None:
    """The place of the first line in error, if any."""
    return parsed.where("op = 'error'").agg(F.min("ord")).first()[0]


def run_script(spark: SparkSession, lines: DataFrame, flush_every: int = 1_000_000, ratio: int = 4, load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """``ord, output``: what each get, range, summary and the first error print.

    The writes are one log and the reads are answered together, each as of its
    line; only loads and summaries, which name files or print everything, are
    taken one by one. ``load`` gives ``key, value, seq`` of a pair file, or raises
    ``FileNotFoundError``: then the script ends there with a message.
    """
    commands = write_shared(parse_commands(lines), "script")
    stop = first_error(commands)
    if stop is not None:
        commands = commands.where(F.col("ord") <= stop)
    at = (F.col("ord") * _STEP).alias("seq")
    single = commands.where("op in ('load', 'summary')").select("ord", "op", "path").orderBy("ord").collect()
    loaded, failed = [], None
    for r in single:
        if r["op"] == "load":
            try:
                pairs = (load or partial(pairs_of, spark))(r["path"])
            except FileNotFoundError:
                failed = r
                break
            loaded.append(pairs.select((F.col("seq") + 1 + r["ord"] * _STEP).alias("seq"), "key", F.lit(False).alias("is_delete"), "value"))
    if failed is not None:
        commands = commands.where(F.col("ord") <= failed["ord"])
        single = [r for r in single if r["ord"] < failed["ord"]]
    writes = commands.where("op in ('put', 'delete')").select(at, F.col("a").alias("key"), (F.col("op") == "delete").alias("is_delete"), F.col("b").alias("value"))
    writes = reduce(DataFrame.unionByName, loaded, writes)
    gets = commands.where("op = 'get'").select(F.col("ord").alias("ticket"), at, F.col("a").alias("key"))
    ranges = commands.where("op = 'range'").select(F.col("ord").alias("ticket"), at, F.col("a").alias("lo"), F.col("b").alias("hi"))
    out = asof_get(writes, gets, _STEP << 20).select(F.col("ticket").alias("ord"), "output")
    out = out.unionByName(render_ranges(asof_range(writes, ranges, _STEP << 20), ranges).select(F.col("ticket").alias("ord"), F.col("line").alias("output")))
    out = out.unionByName(commands.where("op = 'error'").select("ord", F.col("message").alias("output")))
    if failed is not None:
        out = out.unionByName(commands.where(F.col("ord") == failed["ord"]).select("ord", F.concat(F.lit(UNREADABLE), "path").alias("output")))
    for r in single:
        if r["op"] == "summary":
            out = out.unionByName(summary(writes.where(F.col("seq") < r["ord"] * _STEP), flush_every, ratio).select(F.lit(r["ord"]).cast(lines.schema["ord"].dataType).alias("ord"), "output"))
    return out.orderBy("ord")


def summary(ops: DataFrame, flush_every: int, ratio: int) -> DataFrame:
    """``output``: the total, the counts per level, and the listing, as one text
    with a line for the buffer and each level."""
    dense = with_ordinal(ops, [], "seq", "_n").drop("seq").withColumnRenamed("_n", "seq")
    flushes = dense.count() // flush_every
    levels = layout(flushes, ratio)
    held = contents(dense, flush_every, ratio, flushes)
    total = held.agg(F.count_if(~F.col("is_delete")).alias("n"))
    counts = summary_levels(held, levels).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", F.concat("label", F.lit(": "), F.col("pairs").cast("string")).alias("text")))), lambda x: x["text"]), ", ").alias("counts"))
    shown = F.struct("level", (-F.col("run")).alias("run"), "key", F.concat("key", F.lit(":"), F.col("value").cast("string"), F.lit(":"), label(F.col("level")), F.lit(" ")).alias("text"))
    listed = held.where("not is_delete").agg(F.array_sort(F.collect_list(shown)).alias("rows"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(len(levels))), lambda k: F.array_join(F.transform(F.filter("rows", lambda x: x["level"] == k), lambda x: x["text"]), ""))
    return total.join(counts).join(listed).select(F.concat(F.lit("Total Pairs: "), F.col("n").cast("string"), F.lit("\n"), "counts", F.lit("\n"), F.array_join(lines, "\n")).alias("output"))


def pairs_of(spark: SparkSession, path: str) -> DataFrame:
    from .pairs import files_of, read_pairs

    files_of(path)  # raises where there is none
    return read_pairs(spark, path)
