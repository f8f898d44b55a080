"""Scripts whose output was derived by hand."""

import struct

import pytest

from tideline.sources.commands import run_script
from tideline.sources.config import Config, parse_config, resolve
from tideline.plans.catalogue import CONFIG_LINES

PUT, GET, DEL, RANGE = (
    "Invalid insert command, two arguments are required",
    "Invalid get command, one integer argument is required",
    "Invalid delete command, one integer argument is required",
    "Invalid range command, two arguments are required",
)
SCRIPTS = {
    "overwrite": (["p 1 10", "p 1 11", "g 1"], ["11"]),
    "miss": (["g 9"], [""]),
    "tombstone": (["p 2 20", "d 2", "g 2"], [""]),
    "revive": (["p 2 20", "d 2", "p 2 21", "g 2"], ["21"]),
    "half open": (["p 1 1", "p 2 2", "p 3 3", "r 1 3"], ["1:1 2:2 "]),
    "empty range": (["p 1 1", "r 5 5"], [""]),
    "negative keys": (["p -3 7", "p 2 8", "r -10 10"], ["-3:7 2:8 "]),
    "radix": (["p 0x10 010", "g 16"], ["8"]),
    "loose spacing": (["p10 5 junk", "g 10"], ["5"]),
    "leading blank": ([" p 1 2", "g 1"], [""]),
    "malformed": (["p 1"], [PUT]),
    "unknown": (["x"], ["unknown command: x"]),
    "empty summary": (["s"], ["Total Pairs: 0\n\n"]),
    "summary": (["p 1 10", "p 2 20", "d 2", "s"], ["Total Pairs: 1\nLVL1: 1\n1:10:L01 "]),
    "blind delete": (["d 5", "s"], ["Total Pairs: 0\n\n"]),
    "zero": (["p 1 0", "g 1"], ["0"]),
    "octal stops": (["p 08 1", "g 0"], ["8"]),
    "no backtracking": (["p 12"], [PUT]),
    "adjacent sign": (["p 1-2", "g 1"], ["-2"]),
    "stops at the first error": (["p 1 10", "g", "g 1"], [GET]),
    "delete twice": (["p 1 1", "d 1", "d 1", "r 0 9"], [""]),
    "reversed range": (["p 1 1", "r 9 0"], [""]),
    "reads see their place": (["g 1", "p 1 1", "g 1", "p 1 2", "g 1", "d 1", "g 1"], ["", "1", "2", ""]),
    "two summaries": (["p 1 1", "s", "p 2 2", "s", "d x"], ["Total Pairs: 1\nLVL1: 1\n1:1:L01 ", "Total Pairs: 2\nLVL1: 2\n1:1:L01 2:2:L01 ", DEL]),
    "bad range": (["r 1"], [RANGE]),
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_script(spark, name):
    script, want = SCRIPTS[name]
    lines = spark.createDataFrame(list(enumerate(script)), "ord int, line string")
    assert [r["output"] for r in run_script(spark, lines).collect()] == want


def test_summary_with_levels(spark):
    script = ["p 1 1", "p 2 2", "p 1 3", "d 2", "p 3 4", "s"]  # two operations a run
    lines = spark.createDataFrame(list(enumerate(script)), "ord int, line string")
    out = run_script(spark, lines, flush_every=2, ratio=2).collect()[0]["output"]
    assert out == "Total Pairs: 4\nLVL1: 1, LVL2: 3\n3:4:L01 \n1:3:L02 1:1:L02 2:2:L02 "


def test_load(spark, tmp_path):
    file = tmp_path / "p.bin"
    file.write_bytes(b"".join(struct.pack("<ii", *p) for p in [(1, 10), (2, 20), (1, 11), (-3, 7)]) + b"\0\0\0\0")
    script = ["p 1 1", f'l "{file}"', "g 1", "p 1 5", "g 1", "r -9 9", "s"]
    lines = spark.createDataFrame(list(enumerate(script)), "ord int, line string")
    assert [r["output"] for r in run_script(spark, lines).collect()] == ["11", "5", "-3:7 1:5 2:20 ", "Total Pairs: 3\nLVL1: 3\n-3:7:L01 1:5:L01 2:20:L01 "]


def test_unreadable_file_ends_the_script(spark):
    script = ["p 1 1", "g 1", 'l "missing"', "g 1", "p 1"]
    lines = spark.createDataFrame(list(enumerate(script)), "ord int, line string")
    assert [r["output"] for r in run_script(spark, lines).collect()] == ["1", "Could not read from file missing"]


def test_files_in_text_out(spark, tmp_path):
    from tideline.sources.driver import numbered_lines, printed, read_config

    script = tmp_path / "in.txt"
    script.write_text("".join(f"p {k} {k}\n" for k in range(500)) + "g 7\nr 1 3\ng 9999\np 1")
    config = tmp_path / "config"
    config.write_text("#x\nlsm.c0size=1000\n")
    assert read_config(spark, str(config)).flush_every == 800
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        found = numbered_lines(spark, str(script))
        assert found.rdd.getNumPartitions() >= 1
        assert [tuple(r) for r in found.orderBy("ord").collect()] == list(enumerate(script.read_text().split("\n")))
        said = list(printed(spark, str(script), str(config)))
        assert "".join(text for text, _ in said) == f"7\n1:1 2:2 \n\n{PUT}" and [e for _, e in said] == [False, False, False, True]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_program(spark, tmp_path, capsys):
    from tideline.__main__ import main

    (tmp_path / "good").write_text("p 1 2\ng 1\n")
    (tmp_path / "bad").write_text('g 1\nl "none"\ng 1\n')
    (tmp_path / "config").write_text("lsm.ratio=0\n")
    assert main(str(tmp_path / "good")) == 0 and capsys.readouterr().out == "2\n"
    assert main(str(tmp_path / "bad")) == 1 and capsys.readouterr().out == "\nCould not read from file none\n"
    assert main(str(tmp_path / "good"), str(tmp_path / "config")) == 1 and "ratio" in capsys.readouterr().err


def test_config(spark):
    got = parse_config("\n".join(CONFIG_LINES))
    assert got == Config(5, 1000, 4, 0.05)
    named = {r["name"]: r["value"] for r in resolve(spark.createDataFrame(list(enumerate(CONFIG_LINES)), "ord int, line string")).collect()}
    assert named == {"lsm.ratio": 5.0, "lsm.c0size": 1000.0, "lsm.threadCount": 4.0, "lsm.bloomFPRate": 0.05}
    assert parse_config("") == Config()
    for bad in ("lsm.ratio", "lsm.ratio=1", "lsm.c0size=x", "lsm.bloomFPRate=2"):
        with pytest.raises(ValueError):
            parse_config(bad)
