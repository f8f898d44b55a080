"""The registered queries over operation logs, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import indexes, oplog, reads, runs
from ..operators.ordinals import with_ordinal
from ..sources import commands, config, driver
from ..sources.adapters import events_log, ops_events, ops_lineitem, ops_orders, table
from ..sources.pairs import read_pairs, write_pairs
from ..sources.shared import new_path
from ..sources.store import Store
from ..streaming.latest import stream_latest

#: Operations per run, level ratio, and page size that suit the test tables.
FLUSH_EVERY, RATIO, PAGE_ROWS = 480, 2, 43
#: Entries that a run's Bloom filter is sized for, and its rate.
BLOOM_ENTRIES, BLOOM_RATE = 480, 0.01

_EVENTS = """SELECT event_id AS seq, CAST(user_id AS INTEGER) AS key, coalesce(event_type = 'error', false) AS is_delete,
    CASE WHEN NOT coalesce(event_type = 'error', false) THEN CAST(floor(value * 100) AS INTEGER) END AS value FROM events WHERE user_id IS NOT NULL"""
_NEWEST = "SELECT key, is_delete, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ops) WHERE rn = 1"
_OPS = f"ops AS ({_EVENTS}), newest AS ({_NEWEST})"
_STATUS = "CASE WHEN is_delete IS NULL THEN 'MISSING' WHEN is_delete THEN 'DELETED' ELSE 'FOUND' END AS status"
_OUTPUT = "CASE WHEN NOT is_delete THEN CAST(value AS VARCHAR) ELSE '' END AS output"
_RUNS = f"""{_OPS}, runs AS (SELECT run_id, key, is_delete, value FROM (SELECT seq // {FLUSH_EVERY} AS run_id, *,
    row_number() OVER (PARTITION BY seq // {FLUSH_EVERY}, key ORDER BY seq DESC) AS rn FROM ops) WHERE rn = 1)"""
_LEVELS = f"""{_OPS}, flushes AS (SELECT (max(seq) + 1) // {FLUSH_EVERY} AS n FROM ops),
    lv AS (SELECT 1 AS level, n, {2 * RATIO} AS cap, 1 AS unit FROM flushes WHERE n >= 1
           UNION ALL SELECT level + 1, (n - 1) // cap, {RATIO}, unit * cap FROM lv WHERE (n - 1) // cap >= 1),
    levels AS (SELECT level, unit, (n - 1) // cap * cap * unit AS first, n * unit AS last FROM lv)"""
_HELD = f"""{_LEVELS}, placed AS (SELECT ops.*, coalesce(level, 0) AS level, coalesce((seq // {FLUSH_EVERY}) // unit, 0) AS run
        FROM ops LEFT JOIN levels ON seq // {FLUSH_EVERY} >= first AND seq // {FLUSH_EVERY} < last),
    held AS (SELECT level, run, key, is_delete, value FROM (SELECT *, row_number() OVER (PARTITION BY level, run, key ORDER BY seq DESC) AS rn
        FROM placed) WHERE rn = 1)"""


def _numbers(spark: SparkSession, n: int, *columns: str) -> DataFrame:
    return spark.range(n).selectExpr("id as ticket", *columns)


def _top(ops: DataFrame) -> int:
    """The last position of a log (one small job)."""
    return ops.agg(F.max("seq")).first()[0] or 0


def kv_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.state(ops_events(spark, sf_dir))


def kv_latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.state(ops_orders(spark, sf_dir))


def kv_lineitem_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.state(ops_lineitem(spark, sf_dir))


def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.tombstones(ops_events(spark, sf_dir))


def kv_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.point_get(ops_events(spark, sf_dir), 7)


def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.multi_get(ops_events(spark, sf_dir), _numbers(spark, 200, "cast(id * 3 % 400 - 5 as int) as key"))


def kv_asof_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups as of places spread over the whole log."""
    ops = ops_events(spark, sf_dir)
    gets = _numbers(spark, 200, f"id * {_top(ops)} div 199 as seq", "cast(id * 7 % 160 as int) as key")
    return reads.asof_get(ops, gets)


def kv_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ordinal(reads.range_scan(ops_events(spark, sf_dir), 5, 90), [], "key")


def kv_range_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [(0, 10, 10), (1, 10, 11), (2, 60, 10), (3, -(1 << 31), 12), (4, 12, (1 << 31) - 1), (5, -5, 0), (6, 3, 9)]
    return reads.range_counts(ops_events(spark, sf_dir), spark.createDataFrame(edges, "ticket long, lo int, hi int"))


def _ranges(spark: SparkSession, top: int = 0) -> DataFrame:
    return _numbers(spark, 40, f"(id + 1) * {top} div 40 as seq", "cast(id * 4 - 8 as int) as lo", "cast(id * 4 - 3 + id % 7 * id as int) as hi")


def kv_multi_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.multi_range(ops_events(spark, sf_dir), _ranges(spark))


def kv_asof_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = ops_events(spark, sf_dir)
    return reads.asof_range(ops, _ranges(spark, _top(ops)))


def kv_range_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.render_ranges(reads.multi_range(ops_events(spark, sf_dir), _ranges(spark)), _ranges(spark))


def kv_blind_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes of keys that were never put: absent from the state, and present
    as records."""
    ops = ops_events(spark, sf_dir)
    blind = spark.range(1, 21).selectExpr("1000000000 + id as seq", "cast(-id as int) as key", "true as is_delete", "cast(null as int) as value")
    newest = oplog.latest(ops.unionByName(blind))
    return newest.agg(F.count_if(~F.col("is_delete")).alias("live_keys"), F.count_if("is_delete").alias("tombstones"), F.count_if((F.col("key") < 0) & F.col("is_delete")).alias("blind_tombstones"))


def kv_revive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.revived(ops_events(spark, sf_dir))


def _flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flushed(ops_events(spark, sf_dir), FLUSH_EVERY)


def kv_shadow_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.live(runs.shadowed_out(_flushed(spark, sf_dir)))


def run_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flushed(spark, sf_dir)


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_stats(_flushed(spark, sf_dir))


def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.merged(_flushed(spark, sf_dir))


def level_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = runs.flush_count(ops_events(spark, sf_dir), FLUSH_EVERY)
    return runs.with_level(spark.range(n).withColumnRenamed("id", "flush"), F.col("flush"), runs.layout(n, RATIO))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.contents(ops_events(spark, sf_dir), FLUSH_EVERY, RATIO)


def level_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir)


def summary_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summary_total(_held(spark, sf_dir))


def summary_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = ops_events(spark, sf_dir)
    n = runs.flush_count(ops, FLUSH_EVERY)
    return runs.summary_levels(runs.contents(ops, FLUSH_EVERY, RATIO, n), runs.layout(n, RATIO))


def summary_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a listing: levels from the buffer down, newest run first, by key."""
    found = with_ordinal(_held(spark, sf_dir).where("not is_delete"), ["level", "run"], "key", "place")
    sizes = found.groupBy("level", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("level", F.desc("run")).rowsBetween(Window.unboundedPreceding, -1))  # a row per run
    sizes = sizes.select("level", "run", F.coalesce(before, F.lit(0)).alias("before"))
    line = F.concat("key", F.lit(":"), F.col("value").cast("string"), F.lit(":"), runs.label(F.col("level")))
    return found.join(sizes, ["level", "run"]).select((F.col("before") + F.col("place")).alias("ord"), line.alias("line"))


def summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.summary_rollup(_held(spark, sf_dir))


def amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.amplification(_held(spark, sf_dir))


def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(n, p) for n in (1, 400, 480, 1_000_400) for p in (0.5, 0.1, 0.01, 0.001)], "entries int, rate double")
    return cases.select("entries", "rate", indexes.bloom_bits(F.col("entries"), F.col("rate")).alias("bits"), indexes.bloom_hashes(F.col("rate")).alias("hashes"))


def _bloom(spark: SparkSession):
    return indexes.bloom_bits(F.lit(BLOOM_ENTRIES), F.lit(BLOOM_RATE)), indexes.bloom_hashes(F.lit(BLOOM_RATE))


def bloom_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ops_events(spark, sf_dir).select("key").distinct()
    edges = spark.createDataFrame([(-1,), (-(1 << 31),), ((1 << 31) - 1,)], "key int")
    return indexes.bloom_positions(keys.unionByName(edges), *_bloom(spark)).select("key", "i", "bit")


def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _flushed(spark, sf_dir)
    probes = spark.range(0, 400, 3).selectExpr("cast(id as int) as key")
    # Pairs without a row are a certain "no".
    maybe = indexes.bloom_probe(indexes.bloom_filter(found, *_bloom(spark)), probes, *_bloom(spark))
    truth = found.select("run_id", "key", F.lit(True).alias("there"))
    return maybe.join(truth, ["run_id", "key"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def fence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.fence_pages(_flushed(spark, sf_dir), PAGE_ROWS)


def fence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = spark.range(0, 300, 7).selectExpr("cast(id - 3 as int) as key")
    return indexes.fence_lookup(indexes.fence_pages(_flushed(spark, sf_dir), PAGE_ROWS), probes, PAGE_ROWS)


def point_get_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.winning_run(_flushed(spark, sf_dir), _numbers(spark, 200, "cast(id * 3 % 400 - 5 as int) as key"))


#: A line, and what it is: op, a, b, path, message.
COMMAND_CASES = [
    ("p 1 10", "put", 1, 10, None, None),
    ("p10 5 junk", "put", 10, 5, None, None),
    ("p 0x10 010", "put", 16, 8, None, None),
    ("p -0x1F +7", "put", -31, 7, None, None),
    ("p 1-2", "put", 1, -2, None, None),
    ("p 08 1", "put", 0, 8, None, None),
    ("g 9", "get", 9, None, None, None),
    ("g -010", "get", -8, None, None, None),
    ("d\t5", "delete", 5, None, None, None),
    ("r -3 0x7fffffff", "range", -3, 2147483647, None, None),
    ("s", "summary", None, None, None, None),
    ("summary of all", "summary", None, None, None, None),
    ('l "data/a.bin"', "load", None, None, "data/a.bin", None),
    ('l "b.bin', "load", None, None, "b.bin", None),
    ("p 12", "error", None, None, None, "Invalid insert command, two arguments are required"),
    ("print 1", "error", None, None, None, "Invalid insert command, two arguments are required"),
    ("g", "error", None, None, None, "Invalid get command, one integer argument is required"),
    ("d x", "error", None, None, None, "Invalid delete command, one integer argument is required"),
    ("r 1", "error", None, None, None, "Invalid range command, two arguments are required"),
    ("l a.bin", "error", None, None, None, "Invalid load command, one filename argument in double quotes is required"),
    ("p 2147483648 1", "error", None, None, None, "Invalid insert command, two arguments are required"),
    ("x y", "error", None, None, None, "unknown command: x y"),
]
_BLANKS = [" p 1 2", "", "\t"]


def parse_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [(k, c[0]) for k, c in enumerate(COMMAND_CASES)] + [(100 + k, x) for k, x in enumerate(_BLANKS)]
    return commands.parse_commands(spark.createDataFrame(lines, "ord int, line string"))


CONFIG_LINES = ["#lsm.ratio=9", "lsm.ratio=3", "lsm.c0size=1000 pairs", "unknown=5", "", "lsm.bloomFPRate=0.05", "lsm.ratio=5", " lsm.threadCount=9"]


def config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.resolve(spark.createDataFrame(list(enumerate(CONFIG_LINES)), "ord int, line string"))


def load_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The puts of the events log, through pair files: the last pair of a key wins."""
    path = new_path(spark, "pairs")
    write_pairs(ops_events(spark, sf_dir).where("not is_delete"), path)
    return oplog.state(read_pairs(spark, path).withColumn("is_delete", F.lit(False)))


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(files).isDirectory():
        path = f"{sf_dir}/events.parque[t]"  # streams read folders and patterns
    return oplog.live(stream_latest(events_log(spark.readStream.schema(schema).parquet(path))))


def kv_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log as a command script, with a read after every tenth event."""
    ops = ops_events(spark, sf_dir)
    text = F.when(F.col("is_delete"), F.concat(F.lit("d "), "key")).otherwise(F.concat(F.lit("p "), "key", F.lit(" "), F.col("value").cast("string")))
    written = ops.select((F.col("seq") * 2).alias("ord"), text.alias("line"))
    asked = spark.range(0, _top(ops), 10).select(
        (F.col("id") * 2 + 1).alias("ord"),
        F.when(F.col("id") % 20 == 0, F.concat(F.lit("g "), (F.col("id") % 37).cast("string"))).otherwise(F.concat(F.lit("r "), (F.col("id") % 37).cast("string"), F.lit(" "), (F.col("id") % 37 + 9).cast("string"))).alias("line"),
    )
    return commands.run_script(spark, written.unionByName(asked))


#: A script that writes, reads, prints, and ends at a file that is not there.
FILE_SCRIPT = ["p 1 10", "p 2 20", "", "g 1", "d 2", "r 0 9", "s", "p 3 30", 'l "/no/such/file.bin"', "g 3"]


def script_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script and a configuration from files: two operations in, a flush."""
    root = new_path(spark, "script-file")
    files = [("script", FILE_SCRIPT), ("config", ["# settings", "lsm.ratio=2", "lsm.c0size=2"])]
    for name, lines in files:
        spark.createDataFrame(list(enumerate(lines)), "n int, value string").orderBy("n").coalesce(1).select("value").write.text(f"{root}/{name}")
    return driver.run_files(spark, f"{root}/script", f"{root}/config")


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the summary command prints of the whole log."""
    return commands.summary(ops_events(spark, sf_dir), FLUSH_EVERY, RATIO)


def store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a store that took the log in by batches, of which several fill
    its buffer, and merged its levels: files, filters and manifests."""
    ops = ops_events(spark, sf_dir)
    store = Store(spark, new_path(spark, "store"), config.Config(ratio=2), files_per_run=2, flush_every=2 * FLUSH_EVERY)
    top = _top(ops)
    for k in range(6):
        store.write(ops.where((F.col("seq") >= k * top // 6) & (F.col("seq") < ((k + 1) * top // 6 if k < 5 else top + 1))))
    return store.state()


def buffer_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that one half of the buffer holds, by its configured size."""
    return config.capacities(spark.range(1, 2_000_001, 799).select(F.col("id").alias("c0size")))


QUERIES = {
    "kv_latest_state": kv_latest_state,
    "kv_latest_orders": kv_latest_orders,
    "kv_lineitem_latest": kv_lineitem_latest,
    "kv_tombstones": kv_tombstones,
    "kv_point_get": kv_point_get,
    "kv_multi_get": kv_multi_get,
    "kv_asof_get": kv_asof_get,
    "kv_range": kv_range,
    "kv_range_boundaries": kv_range_boundaries,
    "kv_multi_range": kv_multi_range,
    "kv_asof_range": kv_asof_range,
    "kv_range_render": kv_range_render,
    "kv_blind_delete": kv_blind_delete,
    "kv_revive": kv_revive,
    "kv_shadow_antijoin": kv_shadow_antijoin,
    "kv_script": kv_script,
    "run_flush": run_flush,
    "run_stats": run_stats,
    "run_merge": run_merge,
    "level_layout": level_layout,
    "level_contents": level_contents,
    "summary_total": summary_total,
    "summary_levels": summary_levels,
    "summary_listing": summary_listing,
    "summary_rollup": summary_rollup,
    "amplification": amplification,
    "bloom_params": bloom_params,
    "bloom_hash": bloom_hash,
    "bloom_probe": bloom_probe,
    "fence_pages": fence_pages,
    "fence_lookup": fence_lookup,
    "point_get_runs": point_get_runs,
    "parse_commands": parse_commands,
    "script_file": script_file,
    "summary_text": summary_text,
    "store_state": store_state,
    "buffer_capacity": buffer_capacity,
    "config_parse": config_parse,
    "load_pairs": load_pairs,
    "stream_latest": stream_state,
}


def _literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


_ASKED = "asked AS (SELECT range AS ticket, CAST(range * 3 % 400 - 5 AS INTEGER) AS key FROM range(200))"
_RANGE_SQL = "ranges AS (SELECT range AS ticket, (range + 1) * (SELECT max(seq) FROM ops) // 40 AS seq, CAST(range * 4 - 8 AS INTEGER) AS lo, CAST(range * 4 - 3 + range % 7 * range AS INTEGER) AS hi FROM range(40))"
_LIVE = f"WITH {_OPS} SELECT key, value FROM newest WHERE NOT is_delete"
_BITS = f"2 * CAST(ceil(-({BLOOM_ENTRIES} * ln(CAST(CAST({BLOOM_RATE} AS FLOAT) AS DOUBLE))) / pow(ln(2), 2)) AS BIGINT)"
#: The hash, step by step; multiplications are exact in 128 bits.
_HASH = f"""h0 AS (SELECT key, i, CAST(key AS HUGEINT) & 4294967295 AS k FROM probes, (SELECT range AS i FROM range(7))),
    h1 AS (SELECT key, i, k * 3432918353 % 4294967296 AS k FROM h0),
    h2 AS (SELECT key, i, (k * 32768 % 4294967296 + k // 131072) * 461845907 % 4294967296 AS k FROM h1),
    h3 AS (SELECT key, i, xor(CAST(k AS BIGINT), i) AS h FROM h2),
    h4 AS (SELECT key, i, (CAST(h AS HUGEINT) * 8192 % 4294967296 + h // 524288) * 5 + 3864292196 AS h FROM h3),
    h5 AS (SELECT key, i, xor(CAST(h % 4294967296 AS BIGINT), 4) AS h FROM h4),
    h6 AS (SELECT key, i, CAST(xor(h, h // 65536) AS HUGEINT) * 2246822507 % 4294967296 AS h FROM h5),
    h7 AS (SELECT key, i, CAST(h AS BIGINT) AS h FROM h6),
    h8 AS (SELECT key, i, CAST(CAST(xor(h, h // 8192) AS HUGEINT) * 3266489909 % 4294967296 AS BIGINT) AS h FROM h7),
    bits AS (SELECT key, CAST(i AS INTEGER) AS i, xor(h, h // 65536) % ({_BITS}) AS bit FROM h8)"""

ORACLE_SQL = {
    "kv_latest_state": _LIVE,
    "kv_latest_orders": f"""WITH ops AS (SELECT o_orderkey AS seq, CAST(o_custkey AS INTEGER) AS key, o_orderstatus = 'F' AS is_delete,
        CAST(floor(o_totalprice) AS INTEGER) AS value FROM orders), newest AS ({_NEWEST}) SELECT key, value FROM newest WHERE NOT is_delete""",
    "kv_lineitem_latest": f"""SELECT key, value FROM (SELECT CAST(l_partkey AS INTEGER) AS key, CAST(floor(l_extendedprice) AS INTEGER) AS value, l_returnflag = 'R' AS is_delete,
        row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(f"{c} DESC" for c in "l_shipdate l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split())}) AS rn
        FROM lineitem) WHERE rn = 1 AND NOT is_delete""",
    "kv_tombstones": f"WITH {_OPS} SELECT key FROM newest WHERE is_delete",
    "kv_point_get": f"WITH {_OPS} SELECT 7 AS key, {_STATUS}, {_OUTPUT} FROM (SELECT 1) LEFT JOIN newest ON key = 7",
    "kv_multi_get": f"WITH {_OPS}, {_ASKED} SELECT ticket, key, {_STATUS}, {_OUTPUT} FROM asked LEFT JOIN newest USING (key)",
    "kv_asof_get": f"""WITH {_OPS}, asked AS (SELECT range AS ticket, range * (SELECT max(seq) FROM ops) // 199 AS seq, CAST(range * 7 % 160 AS INTEGER) AS key FROM range(200)),
        seen AS (SELECT ticket, asked.key, is_delete, value, row_number() OVER (PARTITION BY ticket ORDER BY ops.seq DESC) AS rn FROM asked LEFT JOIN ops ON ops.key = asked.key AND ops.seq <= asked.seq)
        SELECT ticket, key, {_STATUS}, {_OUTPUT} FROM seen WHERE rn = 1""",
    "kv_range": f"WITH {_OPS} SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS ord FROM newest WHERE NOT is_delete AND key >= 5 AND key < 90",
    "kv_range_boundaries": f"""WITH {_OPS}, asked(ticket, lo, hi) AS (VALUES (0, 10, 10), (1, 10, 11), (2, 60, 10), (3, -2147483648, 12), (4, 12, 2147483647), (5, -5, 0), (6, 3, 9))
        SELECT CAST(ticket AS BIGINT) AS ticket, count(key) AS n, min(key) AS min_key, max(key) AS max_key FROM asked LEFT JOIN (SELECT * FROM newest WHERE NOT is_delete) ON key >= lo AND key < hi GROUP BY ticket""",
    "kv_multi_range": f"""WITH {_OPS}, {_RANGE_SQL} SELECT ticket, row_number() OVER (PARTITION BY ticket ORDER BY key) - 1 AS ord, key, value
        FROM ranges JOIN newest ON key >= lo AND key < hi WHERE NOT is_delete""",
    "kv_asof_range": f"""WITH {_OPS}, {_RANGE_SQL}, seen AS (SELECT ticket, key, is_delete, value, row_number() OVER (PARTITION BY ticket, key ORDER BY ops.seq DESC) AS rn
            FROM ranges JOIN ops ON key >= lo AND key < hi AND ops.seq <= ranges.seq)
        SELECT ticket, row_number() OVER (PARTITION BY ticket ORDER BY key) - 1 AS ord, key, value FROM seen WHERE rn = 1 AND NOT is_delete""",
    "kv_range_render": f"""WITH {_OPS}, {_RANGE_SQL} SELECT ticket, coalesce(string_agg(key || ':' || value || ' ', '' ORDER BY key), '') AS line
        FROM ranges LEFT JOIN (SELECT * FROM newest WHERE NOT is_delete) ON key >= lo AND key < hi GROUP BY ticket""",
    "kv_blind_delete": f"WITH {_OPS} SELECT count(*) FILTER (NOT is_delete) AS live_keys, count(*) FILTER (is_delete) + 20 AS tombstones, CAST(20 AS BIGINT) AS blind_tombstones FROM newest",
    "kv_revive": f"""WITH {_OPS} SELECT key, any_value(newest.value) AS value, count(*) FILTER (ops.is_delete) AS n_deletes FROM newest JOIN ops USING (key)
        WHERE NOT newest.is_delete GROUP BY key HAVING count(*) FILTER (ops.is_delete) > 0""",
    "kv_shadow_antijoin": _LIVE,
    "kv_script": f"""WITH {_OPS}, asked AS (SELECT range AS place, range * 2 + 1 AS ord, CAST(range % 37 AS INTEGER) AS a FROM range(0, (SELECT max(seq) FROM ops), 10)),
        seen AS (SELECT ord, place, key, is_delete, value, a, row_number() OVER (PARTITION BY ord, key ORDER BY seq DESC) AS rn
            FROM asked LEFT JOIN ops ON seq <= place AND CASE WHEN place % 20 = 0 THEN key = a ELSE key >= a AND key < a + 9 END)
        SELECT ord, coalesce(string_agg(CASE WHEN place % 20 = 0 THEN CAST(value AS VARCHAR) ELSE key || ':' || value || ' ' END, '' ORDER BY key) FILTER (NOT is_delete), '') AS output
        FROM seen WHERE rn = 1 GROUP BY ord""",
    "run_flush": f"WITH {_RUNS} SELECT run_id, key, is_delete, value FROM runs",
    "run_stats": f"WITH {_RUNS} SELECT run_id, count(*) AS size, count(*) FILTER (is_delete) AS delete_count, min(key) AS min_key, max(key) AS max_key FROM runs GROUP BY run_id",
    "run_merge": f"WITH {_OPS} SELECT key, is_delete, value FROM newest",
    "level_layout": f"WITH RECURSIVE {_LEVELS} SELECT flush, level, flush // unit AS run FROM (SELECT unnest(range(n)) AS flush FROM flushes) JOIN levels ON flush >= first AND flush < last",
    "level_contents": f"WITH RECURSIVE {_HELD} SELECT level, run, key, is_delete, value FROM held",
    "summary_total": f"WITH RECURSIVE {_HELD} SELECT (SELECT count(*) FROM held WHERE NOT is_delete) AS physical_pairs, (SELECT count(*) FROM newest WHERE NOT is_delete) AS live_keys",
    "summary_levels": f"""WITH RECURSIVE {_HELD}, sums AS (SELECT level, count(*) FILTER (NOT is_delete) AS pairs FROM held GROUP BY level)
        SELECT level, 'LVL' || (level + 1) AS label, pairs FROM (SELECT level, pairs FROM sums WHERE level = 0 AND pairs > 0
        UNION ALL SELECT level, coalesce(pairs, 0) FROM levels LEFT JOIN sums USING (level))""",
    "summary_listing": f"""WITH RECURSIVE {_HELD} SELECT row_number() OVER (ORDER BY level, run DESC, key) - 1 AS ord, key || ':' || value || ':L' || lpad(CAST(level + 1 AS VARCHAR), 2, '0') AS line
        FROM held WHERE NOT is_delete""",
    "summary_rollup": f"WITH RECURSIVE {_HELD} SELECT level, run, count(*) FILTER (NOT is_delete) AS pairs, count(*) FILTER (is_delete) AS tombstones FROM held GROUP BY ROLLUP (level, run)",
    "amplification": f"WITH RECURSIVE {_HELD} SELECT key, count(*) AS n_runs, count(*) - 1 AS n_shadowed FROM held GROUP BY key",
    "bloom_params": """WITH c AS (SELECT entries, rate, CAST(CAST(rate AS FLOAT) AS DOUBLE) AS p FROM (SELECT unnest([1, 400, 480, 1000400]) AS entries), (SELECT unnest([0.5, 0.1, 0.01, 0.001]::DOUBLE[]) AS rate))
        SELECT entries, rate, 2 * CAST(ceil(-(entries * ln(p)) / pow(ln(2), 2)) AS BIGINT) AS bits, CAST(ceil(-(ln(p) / ln(2))) AS INTEGER) AS hashes FROM c""",
    "bloom_hash": f"WITH {_OPS}, probes AS (SELECT DISTINCT key FROM ops UNION ALL VALUES (-1), (-2147483648), (2147483647)), {_HASH} SELECT key, i, bit FROM bits",
    "bloom_probe": f"""WITH {_RUNS}, probes AS (SELECT DISTINCT CAST(range AS INTEGER) AS key FROM range(0, 400, 3) UNION SELECT key FROM runs), {_HASH},
        filters AS (SELECT DISTINCT run_id, bit FROM runs JOIN bits USING (key)),
        asked AS (SELECT DISTINCT key, bit FROM bits WHERE key IN (SELECT range FROM range(0, 400, 3))),
        need AS (SELECT key, count(*) AS n FROM asked GROUP BY key),
        met AS (SELECT key, run_id FROM asked JOIN filters USING (bit) JOIN need USING (key) GROUP BY key, run_id, n HAVING count(*) = n)
        SELECT key, met.run_id, EXISTS (SELECT 1 FROM runs WHERE runs.key = met.key AND runs.run_id = met.run_id) AS there FROM met""",
    "fence_pages": f"""WITH {_RUNS} SELECT run_id, CAST(place // {PAGE_ROWS} AS INTEGER) AS page, max(key) AS page_max
        FROM (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS place FROM runs) GROUP BY ALL""",
    "fence_lookup": f"""WITH {_RUNS}, pages AS (SELECT run_id, CAST(place // {PAGE_ROWS} AS INTEGER) AS page, max(key) AS page_max
            FROM (SELECT run_id, key, row_number() OVER (PARTITION BY run_id ORDER BY key) - 1 AS place FROM runs) GROUP BY ALL)
        SELECT run_id, key, min(page) FILTER (page_max >= key) AS page, CAST(min(page) FILTER (page_max >= key) AS BIGINT) * {PAGE_ROWS * 12} AS address
        FROM (SELECT CAST(range - 3 AS INTEGER) AS key FROM range(0, 300, 7)) CROSS JOIN pages GROUP BY run_id, key""",
    "point_get_runs": f"""WITH {_RUNS}, {_ASKED}, won AS (SELECT key, run_id, is_delete FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC) AS rn FROM runs) WHERE rn = 1)
        SELECT ticket, key, run_id, {_STATUS} FROM asked LEFT JOIN won USING (key)""",
    "parse_commands": "SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {', '.join(map(_literal, c[1:]))})" for k, c in enumerate(COMMAND_CASES))
    + ") AS t(ord, op, a, b, path, message)",
    "script_file": """SELECT CAST(ord AS BIGINT) AS ord, output FROM (VALUES (3, '10'), (5, '1:10 '), (6, 'Total Pairs: 1' || chr(10) || 'LVL1: 1' || chr(10) || '1:10:L01 '),
        (8, 'Could not read from file /no/such/file.bin')) AS t(ord, output)""",
    "store_state": _LIVE,
    "summary_text": f"""WITH RECURSIVE {_HELD.replace("SELECT event_id AS seq", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq")},
        sums AS (SELECT level, count(*) FILTER (NOT is_delete) AS pairs FROM held GROUP BY level),
        counts AS (SELECT level, pairs FROM sums WHERE level = 0 AND pairs > 0 UNION ALL SELECT level, coalesce(pairs, 0) FROM levels LEFT JOIN sums USING (level)),
        texts AS (SELECT level, coalesce(string_agg(key || ':' || value || ':L' || lpad(CAST(level + 1 AS VARCHAR), 2, '0') || ' ', '' ORDER BY run DESC, key) FILTER (NOT is_delete), '') AS line
            FROM (SELECT 0 AS level UNION ALL SELECT level FROM levels) LEFT JOIN held USING (level) GROUP BY level)
        SELECT 'Total Pairs: ' || (SELECT count(*) FROM held WHERE NOT is_delete) || chr(10) || coalesce((SELECT string_agg('LVL' || (level + 1) || ': ' || pairs, ', ' ORDER BY level) FROM counts), '')
            || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY level) FROM texts) AS output""",
    "buffer_capacity": "SELECT range AS c0size, 400 * ((range // 2 + 1) // 400 + 1) AS entries FROM range(1, 2000001, 799)",
    "config_parse": "SELECT name, CAST(value AS DOUBLE) AS value FROM (VALUES ('lsm.ratio', 5.0), ('lsm.c0size', 1000.0), ('lsm.threadCount', 4.0), ('lsm.bloomFPRate', 0.05)) AS t(name, value)",
    "load_pairs": f"WITH ops AS (SELECT * FROM ({_EVENTS}) WHERE NOT is_delete), newest AS ({_NEWEST}) SELECT key, value FROM newest",
    "stream_latest": _LIVE,
}
