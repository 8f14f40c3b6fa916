"""Queries over transcripts that Spark writes from `conversations`: readers, manifests and streams.

A conversation is a session; its turns are messages of the message provider and cumulative
snapshots of the counter provider, in files of 25 sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.usage import natural_key
from ..operators import changes as K
from ..operators import counter as C
from ..schema import COUNTERS
from ..sources import lines as N
from ..sources import transcripts as T
from ..sources.buckets import BucketStore
from ..sources.scratch import working_folder
from ..streaming import streams
from . import views as W
from .queries import query

_SESSIONS = 25
_PATTERN = "part-*"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = W.table(spark, sf, "conversations").withColumn("n", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    so_far = Window.partitionBy("conv_id").orderBy("turn")
    time = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return turns.withColumns({"total": F.sum("n").over(so_far), "time": time, "file": F.floor(F.col("conv_id") / F.lit(_SESSIONS))})


def _write(rows: DataFrame, value: Column, order: list[str], folder: str) -> str:
    text = rows.select("file", *order, value.alias("value")).repartition("file").sortWithinPartitions("file", *order)
    text.select("file", "value").write.partitionBy("file").text(folder)
    return folder


def message_files(spark: SparkSession, sf: str) -> str:
    usage = F.struct(F.col("n").alias("input_tokens"), (F.col("n") * 2).alias("cache_read_input_tokens"), F.lit(7).alias("cache_creation_input_tokens"), (F.col("turn") + 1).alias("output_tokens"))
    message = F.struct(F.concat_ws("-", F.lit("m"), "conv_id", F.floor(F.col("turn") / 2)).alias("id"), F.col("role").alias("model"), usage.alias("usage"))
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), F.col("time").alias("timestamp"), message.alias("message")))
    return _write(_turns(spark, sf), line, ["conv_id", "turn"], working_folder(spark, "messages"))


def counter_files(spark: SparkSession, sf: str) -> str:
    """One conversation a file would be many small files; here a file's sessions follow each other,
    so its totals fall where the next one starts."""
    usage = F.struct(F.col("total").alias("input_tokens"), F.floor(F.col("total") / 2).alias("cached_input_tokens"), (F.col("total") * 3).alias("output_tokens"))
    payload = F.struct(F.lit("token_count").alias("type"), F.struct(usage.alias("total_token_usage")).alias("info"))
    line = F.to_json(F.struct(F.col("time").alias("timestamp"), F.lit("event_msg").alias("type"), payload.alias("payload")))
    return _write(_turns(spark, sf), line, ["conv_id", "turn"], working_folder(spark, "counters"))


_TURNS = """
turns AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS n FROM conversations),
cum AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS total, conv_id // 25 AS file FROM turns),
water AS (SELECT *, coalesce(max(total) OVER (PARTITION BY file ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hw FROM cum),
deltas AS (SELECT file, CAST(greatest(0, (total - hw) - (total // 2 - hw // 2)) AS BIGINT) AS input, CAST(total // 2 - hw // 2 AS BIGINT) AS cached, CAST((total - hw) * 3 AS BIGINT) AS output FROM water WHERE total > hw)"""


def _file_of(path: str = "source_path") -> Column:
    return F.regexp_extract(path, r"file=(\d+)", 1).cast("long")


@query("WITH t AS (SELECT conv_id, turn // 2 AS m, max(turn) AS turn, max_by(coalesce(length(text), 0), turn) AS n, max_by(role, turn) AS model FROM conversations GROUP BY ALL) SELECT 's' || conv_id AS session_id, 'm-' || conv_id || '-' || m AS message_id, model, n AS input, n * 2 AS cached, CAST(7 AS BIGINT) AS cache_w5m, turn + 1 AS output FROM t")
def transcript_scan_message(spark, sf):
    rows = T.message_events(N.with_offsets(N.read_lines(spark, [message_files(spark, sf)], _PATTERN)), "source-1")
    return rows.select("session_id", "message_id", "model", "input", "cached", "cache_w5m", "output")


_NO_THREADS = "id string, path string, model string, parent_id string, is_subagent boolean"


@query(f"WITH {_TURNS} SELECT file, input, cached, output FROM deltas")
def transcript_scan_counter(spark, sf):
    lines = N.read_lines(spark, [counter_files(spark, sf)], _PATTERN)
    events, _ = T.counter_events(lines, "source-2", spark.createDataFrame([], _NO_THREADS), spark.createDataFrame([("unknown", 10**9)], "model string, lc_threshold bigint"))
    return events.select(_file_of().alias("file"), "input", "cached", "output")


@query(f"WITH {_TURNS} SELECT file, CAST(max_by(total - total // 2, (conv_id, turn)) AS BIGINT) AS input, CAST(max_by(total * 3, (conv_id, turn)) AS BIGINT) AS output FROM cum GROUP BY file")
def final_snapshot(spark, sf):
    last = T.final_snapshot(N.read_lines(spark, [counter_files(spark, sf)], _PATTERN), "source-2")
    return last.select(_file_of("path").alias("file"), "input", "output")


def plain_files(spark: SparkSession, sf: str, change: bool = False) -> str:
    """Lines `conversation:turn:role:length`, whose bytes SQL can count.  `change` gives a later
    state: of every three files one has its first conversation's lines rewritten, one has grown."""
    turns = _turns(spark, sf)
    kind = F.pmod("file", F.lit(3))
    mark = F.when(F.lit(change) & (kind == 0) & (F.pmod("conv_id", F.lit(_SESSIONS)) == 0), "x").otherwise("a")
    line = F.concat_ws(":", mark, "conv_id", "turn", "role", "n")
    if change:
        more = turns.where(kind == 1).withColumn("conv_id", F.col("conv_id") + 10**9)
        turns = turns.unionByName(more)
    return _write(turns, line, ["conv_id", "turn"], working_folder(spark, "plain"))


_PLAIN = """
plain AS (SELECT conv_id // 25 AS file, conv_id, turn, CAST(strlen(concat_ws(':', 'a', conv_id, turn, role, coalesce(length(text), 0))) + 1 AS BIGINT) AS bytes FROM conversations)"""


@query(f"WITH {_PLAIN} SELECT file, CAST(sum(bytes) AS BIGINT) AS size FROM plain GROUP BY file")
def file_listing(spark, sf):
    listing = N.file_listing(spark, [plain_files(spark, sf)], _PATTERN)
    return listing.select(_file_of("path").alias("file"), "size")


@query(f"WITH {_PLAIN} SELECT file, file % 3 <> 0 OR min(conv_id) % 25 <> 0 AS same_head, CAST(sum(bytes) AS BIGINT) AS parsed FROM plain GROUP BY file")
def content_guard(spark, sf):
    """Guards up to the first read's end, at that read and at a later one: files that grew keep
    theirs, files that were rewritten do not."""
    before, after = plain_files(spark, sf), plain_files(spark, sf, change=True)
    lines = N.read_lines(spark, [before], _PATTERN)
    ends = N.parsed_offset(lines, N.file_listing(spark, [before], _PATTERN)).select(_file_of("path").alias("file"), "parsed_offset")

    def guards(folder: str, name: str) -> DataFrame:
        placed = N.with_offsets(N.read_lines(spark, [folder], _PATTERN)).withColumn("file", _file_of("path")).join(ends, "file")
        return K.content_guard(placed, F.col("parsed_offset")).select(_file_of("path").alias("file"), F.col("head").alias(name))

    both = ends.join(guards(before, "head"), "file").join(guards(after, "later"), "file")
    return both.select("file", (F.col("head") == F.col("later")).alias("same_head"), F.col("parsed_offset").alias("parsed"))


def _fingerprint_sql(name: str, size: str) -> str:
    entry = f"md5(concat_ws(chr(31), c_name, {size}, 0))"
    return f"SELECT '{name}' AS version, CAST(coalesce(sum(CAST('0x' || substr({entry}, 1, 15) AS BIGINT)), 0) AS VARCHAR) AS fingerprint FROM customer"


@query(" UNION ALL ".join(_fingerprint_sql(*x) for x in (("first", "c_custkey"), ("reordered", "c_custkey"), ("changed", "c_custkey + 1"))))
def metadata_fingerprint(spark, sf):
    """The same in any order of listing, another one where a size has changed."""
    rows = W.table(spark, sf, "customer").select(F.col("c_name").alias("path"), F.col("c_custkey").alias("size"), F.lit(0).alias("modified"))
    versions = {"first": rows, "reordered": rows.orderBy(F.desc("path")), "changed": rows.withColumn("size", F.col("size") + 1)}
    found = [K.metadata_fingerprint(v).select(F.lit(name).alias("version"), "fingerprint") for name, v in versions.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"WITH {_PLAIN} SELECT file, conv_id, turn, CAST(sum(bytes) OVER (PARTITION BY file ORDER BY conv_id, turn) - bytes AS BIGINT) AS byte_offset FROM plain")
def line_offsets(spark, sf):
    placed = N.with_offsets(N.read_lines(spark, [plain_files(spark, sf)], _PATTERN))
    parts = F.split("value", ":")
    return placed.select(_file_of("path").alias("file"), parts[1].cast("long").alias("conv_id"), parts[2].cast("long").alias("turn"), "byte_offset")


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and read its sink."""
    spark = stream.sparkSession
    out, state = working_folder(spark, name), working_folder(spark, f"{name}-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT conv_id // 25 AS file, CAST(count(*) AS BIGINT) AS lines FROM conversations GROUP BY ALL")
def stream_ingest(spark, sf):
    lines = _drained(streams.stream_lines(spark, message_files(spark, sf)), "ingest")
    return lines.groupBy(_file_of("path").alias("file")).agg(F.count(F.lit(1)).alias("lines"))


_USED = ", ".join(f"CAST(use_{c} AS BIGINT) AS use_{c}" for c in COUNTERS)


@query(f"WITH {W.COUNTERS_SQL} SELECT path, seq AS byte_offset, coalesce(last_value(model IGNORE NULLS) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS active_model, status, decreased, explicit, {_USED} FROM classified")
def stream_counter_deltas(spark, sf):
    """Every snapshot's class and usage, where all transcripts grow by a third at a time and the
    stream goes on from its state."""
    rows = W.counters(spark, sf).withColumnRenamed("seq", "byte_offset").drop("ts")
    bounds = rows.agg(F.min("byte_offset").alias("low"), F.max("byte_offset").alias("high")).first()
    low, third = bounds.low or 0, ((bounds.high or 0) - (bounds.low or 0)) // 3 + 1
    folder, out, state = (working_folder(spark, f"counter-{x}") for x in ("segments", "classes", "state"))
    for k in range(3):
        rows.where(F.floor((F.col("byte_offset") - low) / third) == k).repartition("path").write.mode("append").parquet(folder)
        stream = streams.classified(spark.readStream.schema(rows.schema).parquet(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(streams.CLASSIFIED).parquet(out).select("path", "byte_offset", "active_model", "status", "decreased", "explicit", *[f"use_{c}" for c in COUNTERS])


@query(f"WITH {W.LEDGER_SQL} SELECT message_id AS id, max_by(byte_offset, ts) AS byte_offset FROM ledger GROUP BY ALL")
def stream_upsert(spark, sf):
    """The whole ledger by message, in two runs of the stream with ids repeated in and across them:
    the latest row of each stays."""
    rows = W.ledger(spark, sf).withColumn("id", F.col("message_id"))
    folder, state = working_folder(spark, "upserts"), working_folder(spark, "upsert-state")
    store = BucketStore(spark, working_folder(spark, "ledger"))
    table = store.table("ledger", rows.schema, "id", ("id",), buckets=16)
    for half in range(2):
        rows.where(F.pmod(F.xxhash64("source_path", "byte_offset"), F.lit(2)) == half).write.mode("append").parquet(folder)
        streams.upsert_buckets(spark.readStream.schema(rows.schema).parquet(folder), store, "ledger", state).awaitTermination()
    return table.read().select("id", "byte_offset")


@query(f"WITH {W.LEDGER_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, provider, model, CAST(count(*) AS BIGINT) AS events, CAST(sum(input + cached + cache_w5m + cache_w1h + output) AS BIGINT) AS tokens FROM ledger WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) FROM ledger) GROUP BY ALL")
def stream_daily(spark, sf):
    """Days that the watermark has closed; the last day stays open."""
    rows = W.ledger(spark, sf).select("ts", "provider", "model", "event_count", *COUNTERS)
    folder = working_folder(spark, "days")
    rows.write.parquet(folder)
    stream = streams.daily(spark.readStream.schema(rows.schema).parquet(folder), late="0 seconds")
    return _drained(stream, "daily").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {W.LEDGER_SQL} SELECT id FROM ledger WHERE ts >= TIMESTAMP '2024-01-19 13:45:00' AND ts < TIMESTAMP '2024-01-20 13:45:00'")
def moving_window(spark, sf):
    from .queries import NOW

    return streams.moving_window(W.ledger(spark, sf), NOW, 24).select("id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Thread-' || (c_custkey % 10) ELSE '/a/file' || c_custkey || '.jsonl' END AS shown FROM customer ORDER BY ALL")
def natural_keys(spark, sf):
    """Breakdown keys in natural order; the rows are the same in any order."""
    shown = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Thread-"), (F.col("c_custkey") % 10).cast("string"))).otherwise(F.concat(F.lit("/a/file"), F.col("c_custkey").cast("string"), F.lit(".jsonl")))
    return W.table(spark, sf, "customer").select("c_custkey", shown.alias("shown")).orderBy(natural_key(F.col("shown")), "c_custkey")


@query("""WITH p AS (SELECT '/root/subagents/c' || o_custkey || '.jsonl' AS path FROM orders UNION SELECT '/root/x/c' || o_custkey || '.jsonl' FROM orders UNION SELECT '/root/subagents/n' || o_custkey || '.jsonl' FROM orders),
t AS (SELECT '/root/x/c' || c_custkey || '.jsonl' AS path, 'c' || c_custkey || '.jsonl' AS name, 't' || c_custkey AS id, c_custkey % 3 = 0 AS child FROM customer)
SELECT p.path, t.id AS thread_id, coalesce(t.child, contains(p.path, '/subagents/')) AS is_subagent FROM p LEFT JOIN t ON string_split(p.path, '/')[-1] = t.name""")
def thread_lookup(spark, sf):
    """Paths of known threads, of files that have a known one's name, and of files that no thread has."""
    name = F.concat(F.col("o_custkey").cast("string"), F.lit(".jsonl"))
    orders = W.table(spark, sf, "orders")
    paths = orders.select(F.explode(F.array(*[F.concat(F.lit(root), name) for root in ("/root/subagents/c", "/root/x/c", "/root/subagents/n")])).alias("path")).distinct()
    key = F.col("c_custkey").cast("string")
    threads = W.table(spark, sf, "customer").select(F.concat(F.lit("t"), key).alias("id"), F.concat(F.lit("/root/x/c"), key, F.lit(".jsonl")).alias("path"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("parent_id"), (F.col("c_custkey") % 3 == 0).alias("is_subagent"))
    return C.thread_lookup(paths, threads).select("path", "thread_id", "is_subagent")
