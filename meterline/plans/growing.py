"""Queries over transcripts that grow: parts of files, the refresh, and both providers' scans.

Files of five conversations each are written by Spark under names that stay, in an earlier and a later
state.  Of seven files one is new in the later state, one gone, one rewritten, one as before; the others
have grown by their last conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import counter as C
from ..sources import byte_ranges as B
from ..sources import lines as N
from ..sources import refresh as R
from ..sources import transcripts as T
from ..sources.scratch import working_folder
from ..streaming import streams
from . import views as W
from .queries import query

_EACH = 5
_START = 1704067200
_THREADS = "id string, path string, model string, parent_id string, is_subagent boolean"


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    local = "://" not in uri or uri.startswith("file:")
    return (fs.LocalFileSystem(), B._bare(uri)) if local else fs.FileSystem.from_uri(uri)


def _write_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (folder, file, bytes) rows as one file each, which appears whole."""
    systems, name, out = {}, None, None

    def close() -> None:
        out.close()
        system, base = systems[name[0]]
        system.move(f"{base}/.{name[1]}", f"{base}/{name[1]}.jsonl")

    for b in batches:
        named = zip(b.column("folder").to_pylist(), b.column("file").to_pylist())
        for key, rows in groupby(zip(named, b.column("bytes").to_pylist()), itemgetter(0)):
            if key != name:
                if out:
                    close()
                if key[0] not in systems:
                    systems[key[0]] = _system(key[0])
                    systems[key[0]][0].create_dir(systems[key[0]][1], recursive=True)
                system, base = systems[key[0]]
                name, out = key, system.open_output_stream(f"{base}/.{key[1]}")
            out.write(b"".join(value for _, value in rows))
    if out:
        close()
    yield pa.RecordBatch.from_pydict({"file": pa.array([], pa.string())})


def _write_dealt(rows: DataFrame, order: list[str]) -> None:
    """`rows` (folder, file, value, and `order`), of which no two partitions share a file, as files, a line a
    row, or its bytes where `value` is binary; files that are there are replaced."""
    data = F.col("value") if dict(rows.dtypes)["value"] == "binary" else F.concat("value", F.lit("\n")).cast("binary")
    rows = rows.select("folder", F.col("file").cast("string").alias("file"), *order, data.alias("bytes")).sortWithinPartitions("folder", "file", *order)
    rows.select("folder", "file", "bytes").mapInArrow(_write_lines, "file string").count()


def _write(rows: DataFrame, order: list[str], folder: str) -> str:
    """`rows` (file, value, and `order`) as files below `folder`."""
    _write_dealt(rows.repartition("file").withColumn("folder", F.lit(folder)), order)
    return folder


def _remove(files: DataFrame) -> None:
    """Remove the `files` (folder, file) that are there, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, file in zip(b.column("folder").to_pylist(), b.column("file").to_pylist()):
                system, base = _system(folder)
                with suppress(FileNotFoundError):
                    system.delete_file(f"{base}/{file}.jsonl")
        yield pa.RecordBatch.from_pydict({"file": pa.array([], pa.string())})

    files.select("folder", F.col("file").cast("string").alias("file")).mapInArrow(run, "file string").count()


def _turns(spark: SparkSession, sf: str, later: bool) -> DataFrame:
    """The turns that stand in the files of a state."""
    turns = W.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))
    turns = turns.withColumn("file", F.floor(F.col("conv_id") / _EACH)).withColumn("kind", F.pmod("file", F.lit(7)))
    if later:
        return turns.where("kind <> 3")
    grown = F.col("kind").isin(1, 2, 4)
    return turns.where((F.col("kind") != 5) & ~(grown & (F.pmod("conv_id", F.lit(_EACH)) == _EACH - 1)))


def _gone(spark: SparkSession, sf: str) -> DataFrame:
    """The files (file) that the later state lacks."""
    return _turns(spark, sf, later=False).where("kind = 3").select("file").distinct()


def _plain(spark: SparkSession, sf: str, folder: str, later: bool) -> str:
    """Lines `mark:conversation:turn:role:length`, whose bytes SQL can count."""
    turns = _turns(spark, sf, later)
    mark = F.when((F.col("kind") == 6) & F.lit(later), "xx").otherwise("a")
    return _write(turns.withColumn("value", F.concat_ws(":", mark, "conv_id", "turn", "role", "n")), ["conv_id", "turn"], folder)


def _file(path: str = "path") -> Column:
    return F.regexp_extract(path, r"(\d+)\.jsonl$", 1).cast("long")


_STATES = f"""
plain AS (SELECT conv_id // {_EACH} AS file, conv_id // {_EACH} % 7 AS kind, conv_id, turn, conv_id % {_EACH} = {_EACH - 1} AS last,
  CAST(strlen(concat_ws(':', CASE WHEN conv_id // {_EACH} % 7 = 6 THEN 'xx' ELSE 'a' END, conv_id, turn, role, coalesce(length(text), 0))) + 1 AS BIGINT) AS bytes FROM conversations),
placed AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY file ORDER BY conv_id, turn) - bytes AS BIGINT) AS byte_offset FROM plain)"""


def _two_states(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """A folder in its later state, and the listing of its earlier one."""
    folder = _plain(spark, sf, working_folder(spark, "growing"), later=False)
    earlier = N.file_listing(spark, [folder])
    earlier = spark.createDataFrame(earlier.collect(), earlier.schema)  # as it is now: the folder will change
    _plain(spark, sf, folder, later=True)
    _remove(_gone(spark, sf).withColumn("folder", F.lit(folder)))
    return folder, earlier


@query(f"WITH {_STATES} SELECT file, conv_id, turn, byte_offset FROM placed WHERE kind IN (1, 2, 4) AND last")
def appended_lines(spark, sf):
    """Of files that have grown, the lines past their earlier size, and nothing else, at their true offsets."""
    folder, earlier = _two_states(spark, sf)
    grown = N.file_listing(spark, [folder]).join(earlier.select("path", F.col("size").alias("start")), "path").where((F.pmod(_file(), F.lit(7))).isin(1, 2, 4))
    lines = B.read_ranges(grown.select("path", "start", F.col("size").alias("stop")), split_bytes=64)
    parts = F.split("value", ":")
    return lines.select(_file().alias("file"), parts[1].cast("long").alias("conv_id"), parts[2].cast("long").alias("turn"), "byte_offset")


@query(f"WITH {_STATES} SELECT file, conv_id, turn, byte_offset FROM placed")
def split_file_lines(spark, sf):
    """All lines with their offsets, from files cut into many splits."""
    folder = working_folder(spark, "splits")
    turns = W.table(spark, sf, "conversations").withColumn("file", F.floor(F.col("conv_id") / _EACH))
    mark = F.when(F.pmod("file", F.lit(7)) == 6, "xx").otherwise("a")
    line = F.concat_ws(":", mark, "conv_id", "turn", "role", F.coalesce(F.length("text"), F.lit(0)))
    _write(turns.withColumn("value", line), ["conv_id", "turn"], folder)
    lines = B.read_ranges(B.whole_files(N.file_listing(spark, [folder])), split_bytes=50)
    parts = F.split("value", ":")
    return lines.select(_file().alias("file"), parts[1].cast("long").alias("conv_id"), parts[2].cast("long").alias("turn"), "byte_offset")


@query(f"WITH {_STATES} SELECT file, conv_id, turn, byte_offset FROM placed WHERE kind <> 6")
def stream_growing_lines(spark, sf):
    """The streaming source over both states, with a new run of the query from its checkpoint for the
    later one: every line once."""
    folder, out, state = (working_folder(spark, f"grow-{x}") for x in ("in", "out", "state"))
    for later in (False, True):
        turns = _turns(spark, sf, later).where("kind <> 6")  # what stands below a file's size does not change
        _write(turns.withColumn("value", F.concat_ws(":", F.lit("a"), "conv_id", "turn", "role", "n")), ["conv_id", "turn"], folder)
        stream = B.stream_growing(spark, [folder], split_bytes=100)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    parts = F.split("value", ":")
    return spark.read.schema(B.LINES).parquet(out).select(_file().alias("file"), parts[1].cast("long").alias("conv_id"), parts[2].cast("long").alias("turn"), "byte_offset")


_LIVE = f"""
turns AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, conv_id // {_EACH} AS file FROM conversations),
cum AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM turns WHERE file % 7 <> 6),
water AS (SELECT *, max(total) OVER (PARTITION BY file ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hw FROM cum)
SELECT file, 'm' || ((conv_id + turn) % 3) AS model, strftime(TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60), '%Y-%m-%d %H:%M:%S') AS at,
  CAST(greatest(0, (total - coalesce(hw, 0)) - (total // 2 - coalesce(hw, 0) // 2)) AS BIGINT) AS input, CAST((total - coalesce(hw, 0)) * 3 AS BIGINT) AS output FROM water WHERE total > coalesce(hw, 0)"""


@query(f"WITH {_LIVE}")
def stream_live_ledger(spark, sf):
    """Transcripts that grow, as a stream of requests upserted into a bucketed ledger: two runs of the
    query over an earlier and a later state of the files."""
    folder, state = working_folder(spark, "live-in"), working_folder(spark, "live-state")
    store = R.LedgerStore(spark, working_folder(spark, "live"), buckets=8)
    for later in (False, True):
        turns = _turns(spark, sf, later).where("kind <> 6")
        _transcripts(turns, later, folder, headers=False)
        rows = streams.live_ledger(B.stream_growing(spark, [folder]), "live")
        streams.upsert_buckets(rows, store, "ledger", state).awaitTermination()
    return store.ledger.read().select(_file("source_path").alias("file"), "model", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "input", "output")


# ---------------------------------------------------------------------- both providers


def _time(at: Column) -> Column:
    return F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _counter_values(turns: DataFrame, later: bool) -> tuple[DataFrame, list[Column]]:
    """`turns` dealt by file, and what a transcript has of each: a header (at its first one), a task (at
    a conversation's first), a turn context and a snapshot.  Of three files one is a fork made when its
    third conversation began, so the first three are inherited."""
    begun = F.lit(_START) + F.col("conv_id") * 3600
    # both windows keep to the files' exchange
    first = F.row_number().over(Window.partitionBy("file").orderBy("conv_id", "turn")) == 1
    tasks = turns.sparkSession.sparkContext.defaultParallelism * 4  # a turn here is few bytes, and its lines many
    turns = turns.repartition(tasks, "file").withColumns({"first": first, "total": F.sum("n").over(Window.partitionBy("file", "conv_id").orderBy("turn"))})
    # a rewritten file's earlier state has other numbers
    total = F.col("total") + F.when((F.col("kind") == 6) & F.lit(not later), 1).otherwise(0)
    usage = F.struct(total.alias("input_tokens"), F.floor(total / 2).alias("cached_input_tokens"), (total * 3).alias("output_tokens"))
    at = _time(begun + F.col("turn") * 60)
    snapshot = F.struct(at.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(usage.alias("total_token_usage")).alias("info")).alias("payload"))
    context = F.struct(at.alias("timestamp"), F.lit("turn_context").alias("type"), F.struct(F.concat(F.lit("m"), ((F.col("conv_id") + F.col("turn")) % 3).cast("string")).alias("model")).alias("payload"))
    task = F.struct(at.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("task_started").alias("type"), begun.alias("started_at")).alias("payload"))
    origin = F.when(F.pmod("file", F.lit(3)) == 1, F.concat(F.lit("o"), F.col("file").cast("string")))
    made = _time(F.lit(_START) + (F.col("file") * _EACH + 2) * 3600)
    header = F.struct(made.alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("h"), F.col("file").cast("string")).alias("id"), origin.alias("forked_from_id")).alias("payload"))
    return turns, [F.when(F.col("first"), F.to_json(header)), F.when(F.col("turn") == 0, F.to_json(task)), F.to_json(context), F.to_json(snapshot)]


def _message_value(later: bool) -> Column:
    """A turn's message; one of two turns is written twice, so its last copy counts."""
    n = F.col("n") + F.when((F.col("kind") == 6) & F.lit(not later), 1).otherwise(0)
    usage = F.struct(n.alias("input_tokens"), (F.col("n") * 2).alias("cache_read_input_tokens"), (F.col("turn") + 1).alias("output_tokens"))
    message = F.struct(F.concat_ws("-", F.lit("m"), "conv_id", F.floor(F.col("turn") / 2)).alias("id"), F.col("role").alias("model"), usage.alias("usage"))
    return F.to_json(F.struct(F.lit("assistant").alias("type"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sessionId"), _time(F.lit(_START) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("timestamp"), message.alias("message")))


def _lines(turns: DataFrame, values: list[Column]) -> DataFrame:
    """A row a value that is there: (file, conv_id, turn, rank, value), rank being its place in `values`."""
    return turns.select("file", "conv_id", "turn", F.posexplode(F.array(*values)).alias("rank", "value")).where("value is not null")


def _transcripts(turns: DataFrame, later: bool, folder: str, headers: bool = True) -> None:
    """The counter provider's files below `folder`."""
    turns, values = _counter_values(turns, later)
    _write_dealt(_lines(turns, values if headers else values[1:]).withColumn("folder", F.lit(folder)), _ORDER)


_ORDER = ["conv_id", "turn", "rank"]


def _folder(root: str, provider: Column) -> Column:
    """Odd files are in their provider's archive, the others live."""
    return F.concat_ws("/", F.lit(root), provider, F.when(F.pmod("file", F.lit(2)) == 1, "archived").otherwise("live"))


def _put(spark: SparkSession, sf: str, root: str, later: bool) -> None:
    """Both providers' files, out of one exchange of the turns."""
    turns, values = _counter_values(_turns(spark, sf, later), later)
    provider = F.when(F.col("rank") == len(values), "message").otherwise("counter")
    _write_dealt(_lines(turns, [*values, _message_value(later)]).withColumn("folder", _folder(root, provider)), _ORDER)


def _sources(spark: SparkSession, root: str) -> DataFrame:
    rows = [(f"{p}-source", p, [f"{root}/{p}/live", f"{root}/{p}/archived"], True) for p in ("counter", "message")]
    return spark.createDataFrame(rows, "source_id string, provider string, roots array<string>, enabled boolean")


_BOTH = f"""
turns AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS n, conv_id // {_EACH} AS file FROM conversations),
cum AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM turns WHERE file % 7 <> 3),
own AS (SELECT * FROM cum WHERE file % 3 <> 1 OR conv_id > file * {_EACH} + 2),
water AS (SELECT *, max(total) OVER (PARTITION BY file ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hw FROM own),
used AS (SELECT *, total - coalesce(hw, 0) AS d, total // 2 - coalesce(hw, 0) // 2 AS c FROM water WHERE total > coalesce(hw, 0) AND (hw IS NOT NULL OR file % 3 <> 1)),
counters AS (SELECT 'counter' AS provider, file, CASE WHEN file % 3 = 1 THEN 'h' || file ELSE CAST(file AS VARCHAR) END AS session_id,
  CASE WHEN file % 3 = 1 THEN 'o' || file END AS parent_session_id, 'm' || ((conv_id + turn) % 3) AS model, greatest(0, d - c) AS input, c AS cached, d * 3 AS output FROM used),
latest AS (SELECT conv_id, file, turn // 2 AS m, max(turn) AS turn, max_by(n, turn) AS n, max_by(role, turn) AS role FROM cum GROUP BY ALL),
messages AS (SELECT 'message', file, 's' || conv_id, NULL, role, n, n * 2, turn + 1 FROM latest),
both_ AS (SELECT * FROM counters UNION ALL SELECT * FROM messages)"""

_GROUPED = "SELECT provider, file, session_id, parent_session_id, model, CAST(count(*) AS BIGINT) AS events, CAST(sum(input) AS BIGINT) AS input, CAST(sum(cached) AS BIGINT) AS cached, CAST(sum(output) AS BIGINT) AS output FROM both_ GROUP BY ALL"


def _grouped(ledger: DataFrame) -> DataFrame:
    sums = [F.sum(c).cast("long").alias(c) for c in ("input", "cached", "output")]
    return ledger.groupBy("provider", _file("source_path").alias("file"), "session_id", "parent_session_id", "model").agg(F.count(F.lit(1)).alias("events"), *sums)


def _dimensions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], _THREADS), spark.createDataFrame([("m0", 10**9)], "model string, lc_threshold bigint")


@query(f"WITH {_BOTH} {_GROUPED}")
def scan_both_providers(spark, sf):
    """One scan of live and archived folders of both providers: headers, forks, tasks, changes of model."""
    root = working_folder(spark, "both")
    _put(spark, sf, root, later=True)
    threads, limits = _dimensions(spark)

    def lines(provider: str) -> DataFrame:
        return B.read_ranges(B.whole_files(N.file_listing(spark, [f"{root}/{provider}/live", f"{root}/{provider}/archived"])))

    counters, _ = T.counter_events(lines("counter"), "counter-source", threads, limits)
    return _grouped(T.scan_sources([T.message_events(lines("message"), "message-source"), counters]))


@query(
    f"WITH f AS (SELECT conv_id // {_EACH} AS file, max(conv_id) FILTER (conv_id > conv_id // {_EACH} * {_EACH} + 2) IS NOT NULL AS owns FROM conversations GROUP BY 1) "
    "SELECT file, CASE WHEN owns THEN 'found' ELSE 'none' END AS boundary FROM f WHERE file % 3 = 1 AND file % 7 <> 3"
)
def fork_boundary_from_end(spark, sf):
    """Forked files' own beginnings, read from their ends until inherited tasks are met; they are those
    that all lines give."""
    root = working_folder(spark, "forks")
    _transcripts(_turns(spark, sf, later=True), True, root)
    listing = N.file_listing(spark, [root])
    heads = T.scan_header(B.read_ranges(B.whole_files(listing)))  # of such short files, all lines
    forks = R.materialised(heads.join(listing.select("path", "size"), "path").select("path", "size", "header_id", "created"), "forks")
    ends = T.boundaries_from_end(forks, R.materialised, first_bytes=1000)
    tasks = T.scan_tasks(B.read_ranges(B.whole_files(listing))).join(forks.select("path", "header_id", "created"), "path")
    whole = C.fork_boundary(tasks.withColumn("ownership", C.task_ownership(F.col("started_at"), F.col("turn_id"), F.col("created"), F.col("header_id"))))
    both = ends.join(whole.select("path", F.col("boundary").alias("_b"), F.col("own_start").alias("_s")), "path")
    same = F.col("boundary").eqNullSafe(F.col("_b")) & F.col("own_start").eqNullSafe(F.col("_s"))
    return both.select(_file().alias("file"), F.when(same, F.col("boundary")).otherwise("differs").alias("boundary"))


@query(f"WITH {_BOTH} {_GROUPED}")
def refresh_ledger(spark, sf):
    """Two refreshes of one store, before and after the files have changed: the ledger is that of a scan
    of the later files."""
    root, store = working_folder(spark, "refresh"), R.LedgerStore(spark, working_folder(spark, "refreshed"), buckets=16)
    for later in (False, True):
        _put(spark, sf, root, later)
        if later:
            provider = F.explode(F.array(F.lit("counter"), F.lit("message")))
            _remove(_gone(spark, sf).select("file", provider.alias("provider")).select("file", _folder(root, F.col("provider")).alias("folder")))
        R.refresh(store, _sources(spark, root), *_dimensions(spark))
    return _grouped(store.ledger.read())


@query(
    f"WITH {_STATES}, sums AS (SELECT file, kind, CAST(sum(bytes) AS BIGINT) AS size, CAST(coalesce(sum(bytes) FILTER (NOT last), 0) AS BIGINT) AS before, bool_or(last) AS grew FROM placed GROUP BY ALL), "
    "named AS (SELECT *, CASE kind WHEN 5 THEN 'new' WHEN 3 THEN 'removed' WHEN 6 THEN 'changed' ELSE CASE WHEN kind IN (1, 2, 4) AND grew THEN 'appended' ELSE 'unchanged' END END AS state FROM sums) "
    "SELECT file, state, CASE WHEN state = 'appended' THEN before ELSE 0 END AS start, CASE state WHEN 'appended' THEN size - before WHEN 'new' THEN size WHEN 'changed' THEN size ELSE 0 END AS bytes FROM named"
)
def refresh_plan(spark, sf):
    """What a refresh does with each file after the change, and the bytes that it reads of it."""
    folder, store = working_folder(spark, "planned"), R.LedgerStore(spark, working_folder(spark, "store"), buckets=16)
    sources = spark.createDataFrame([("s", "message", [folder], True)], "source_id string, provider string, roots array<string>, enabled boolean")
    _plain(spark, sf, folder, later=False)
    R.refresh(store, sources, *_dimensions(spark))
    kept = _turns(spark, sf, later=True)
    mark = F.when(F.col("kind") == 6, "xx").otherwise("a")
    grew = F.max(F.pmod("conv_id", F.lit(_EACH)) == _EACH - 1).over(Window.partitionBy("file"))
    moved = kept.withColumn("grew", grew).where("kind in (5, 6) or (kind in (1, 2, 4) and grew)").withColumn("value", F.concat_ws(":", mark, "conv_id", "turn", "role", "n"))
    _write(moved, ["conv_id", "turn"], folder)
    _remove(_gone(spark, sf).withColumn("folder", F.lit(folder)))
    listing = N.file_listing(spark, [folder]).select(F.lit("s").alias("source_id"), F.lit("message").alias("provider"), "path", "size", "modified")
    planned = R.plan(store, listing, ["s"])
    reads = F.when(F.col("kind").isin("new", "changed", "appended"), F.col("size") - F.col("start")).otherwise(0)
    return planned.select(_file().alias("file"), F.col("kind").alias("state"), "start", reads.cast("long").alias("bytes"))
