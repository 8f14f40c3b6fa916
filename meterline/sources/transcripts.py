"""Transcript lines to ledger rows (SC2-SC5, SC9, SC11, C12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import usage as U
from ..operators import counter as C
from ..operators.attribution import attribute_accounts
from ..operators.dedup import dedup_file, dedup_scan
from ..schema import COUNTERS, LEDGER, LONG
from .byte_ranges import read_ranges
from .lines import candidates, with_offsets

_MESSAGE = """
type string, sessionId string, timestamp string, agentId string, isSidechain boolean,
message struct<id string, model string, usage struct<
  input_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint,
  cache_creation struct<ephemeral_5m_input_tokens bigint, ephemeral_1h_input_tokens bigint>,
  output_tokens bigint>>
"""
_COUNTERS = "struct<input_tokens bigint, cached_input_tokens bigint, cache_write_input_tokens bigint, cache_write_input_tokens_1h bigint, output_tokens bigint, reasoning_output_tokens bigint>"
_EVENT = f"""
timestamp string, type string, payload struct<
  type string, id string, forked_from_id string, parent_thread_id string, source string, model string,
  turn_id string, started_at bigint,
  info struct<total_token_usage {_COUNTERS}, last_token_usage {_COUNTERS}>>
"""
#: A counter's name in the transcripts.
_FIELDS = dict(zip(COUNTERS, ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "cache_write_input_tokens_1h", "output_tokens", "reasoning_output_tokens")))


def _source(source_id: str | Column) -> Column:
    return F.lit(source_id) if isinstance(source_id, str) else source_id


def _parsed(lines: DataFrame, schema: str, *keep: str | Column) -> DataFrame:
    """`keep` and j, the parsed value: made by a generator, as Spark would else copy the parser into
    every condition on j, and parse a line once for each."""
    return lines.select(*keep, F.explode(F.array(F.from_json("value", schema))).alias("j"))


def scan_message(lines: DataFrame, source_id: str | Column) -> DataFrame:
    """Ledger rows of per-message lines (path, byte_offset, value), the latest copy inside each file;
    `source_id` is a name or a column of the lines."""
    lines = lines.withColumn("source_id", _source(source_id))
    held = candidates(lines, '"usage"').where(F.contains("value", F.lit('"assistant"')))
    rows = _parsed(held, _MESSAGE, "path", "source_id", "byte_offset").where("j.type = 'assistant' and j.message.id is not null and j.sessionId is not null and j.message.usage is not null")
    u = "j.message.usage"

    def n(field: str) -> Column:
        return F.coalesce(F.col(f"{u}.{field}"), F.lit(0).cast("long"))

    w5m, w1h = n("cache_creation.ephemeral_5m_input_tokens"), n("cache_creation.ephemeral_1h_input_tokens")
    agent = F.coalesce("j.agentId", U.subagent_of_path(F.col("path")))
    child = F.coalesce("j.isSidechain", F.lit(False)) | agent.isNotNull() | F.contains("path", F.lit("/subagents/"))
    rows = rows.select(
        F.col("j.message.id").alias("message_id"),
        F.lit("message").alias("provider"),
        "source_id",
        U.effective_session(agent, F.col("j.sessionId")).alias("session_id"),
        F.when(child, F.col("j.sessionId")).alias("parent_session_id"),
        U.parse_instant(F.col("j.timestamp")).alias("ts"),
        F.coalesce("j.message.model", F.lit("unknown")).alias("model"),
        F.col("path").alias("source_path"),
        "byte_offset",
        child.alias("is_subagent"),
        n("input_tokens").alias("input"),
        n("cache_read_input_tokens").alias("cached"),
        U.five_minute_writes(w5m, w1h, n("cache_creation_input_tokens")).cast("long").alias("cache_w5m"),
        w1h.alias("cache_w1h"),
        n("output_tokens").alias("output"),
        F.lit(0).cast("long").alias("reasoning"),
    ).where("ts is not null")
    rows = rows.where(U.total_tokens() > 0)
    kind = F.when(F.col("is_subagent"), "sidechain").otherwise("main")
    rows = rows.withColumn("id", U.event_id(F.col("provider"), F.col("source_id"), F.col("source_path"), F.concat_ws(":", "session_id", kind, "message_id")))
    return dedup_file(rows)


def as_ledger(rows: DataFrame) -> DataFrame:
    """The ledger's columns, with defaults for those that `rows` lacks."""
    defaults = {"event_count": F.lit(1).cast("long"), "account_id": F.lit("unattributed"), "attribution_confidence": F.lit("source-only"), "attribution_basis": F.lit("none"), **{c: F.lit(0).cast("long") for c in LONG}}
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in LEDGER.fields])


def message_events(lines: DataFrame, source_id: str | Column, accounts: DataFrame | None = None, has_config: bool = False) -> DataFrame:
    """Ledger rows of a message source; `accounts` as of `attribution.session_accounts`."""
    rows = scan_message(lines, source_id)
    if accounts is not None:
        rows = attribute_accounts(rows, accounts, has_config)
    return as_ledger(rows)


def scan_counter(lines: DataFrame) -> DataFrame:
    """Counter lines (path, byte_offset, value, and `ended` where they have it): snapshots, and changes
    of model, which win where a line is both."""
    ended = F.col("ended") if "ended" in lines.columns else F.lit(True)
    rows = _parsed(candidates(lines, "token_count", "turn_context"), _EVENT, "path", "byte_offset", ended.alias("ended"))
    turn = F.col("j.type") == "turn_context"
    total, last = "j.payload.info.total_token_usage", "j.payload.info.last_token_usage"
    snapshot = ~turn & F.col(total).isNotNull()
    columns = [F.when(snapshot, F.coalesce(F.col(f"{total}.{f}"), F.lit(0))).cast("long").alias(f"tot_{c}") for c, f in _FIELDS.items()]
    columns += [F.when(snapshot & F.col(last).isNotNull(), F.coalesce(F.col(f"{last}.{f}"), F.lit(0))).cast("long").alias(f"last_{c}") for c, f in _FIELDS.items()]
    parsed = rows.select("path", "byte_offset", "ended", U.parse_instant(F.col("j.timestamp")).alias("ts"), F.when(turn, F.col("j.payload.model")).alias("model"), *columns, turn.alias("_turn"))
    return parsed.where(F.col("_turn") | (F.col("tot_input").isNotNull() & F.col("ts").isNotNull())).drop("_turn")


def scan_header(lines: DataFrame) -> DataFrame:
    """(path, header_id, origin_id, parent_id, is_spawned, created): the first line of each file, if
    it names the transcript that it was forked from."""
    first = lines.where("byte_offset = 0").select("path", "value")
    j = _parsed(first, _EVENT, "path", "value")
    spawned = F.get_json_object("value", "$.payload.source.subagent.thread_spawn.parent_thread_id")
    header = j.select("path", F.col("j.payload.id").alias("header_id"), F.col("j.payload.forked_from_id").alias("origin_id"), F.coalesce("j.payload.parent_thread_id", spawned, "j.payload.forked_from_id").alias("parent_id"), (F.col("j.payload.parent_thread_id").isNotNull() | spawned.isNotNull()).alias("is_spawned"), F.floor(F.unix_micros(U.parse_instant(F.col("j.timestamp"))) / 1000000).alias("created"))
    return header.where("origin_id is not null")


def scan_tasks(lines: DataFrame) -> DataFrame:
    """(path, byte_offset, started_at, turn_id) of task-started lines."""
    rows = _parsed(candidates(lines, "task_started"), _EVENT, "path", "byte_offset").where("j.payload.type = 'task_started'")
    return rows.select("path", "byte_offset", F.col("j.payload.started_at").alias("started_at"), F.col("j.payload.turn_id").alias("turn_id"))


def boundaries_from_end(forks: DataFrame, stored: Callable[[DataFrame, str], DataFrame], first_bytes: int = 1 << 20, meter: Accumulator | None = None) -> DataFrame:
    """(path, boundary, own_start) of forked files (path, size, header_id, created), from their ends.

    Rounds read the last `first_bytes` of every file, then twice as much before that, and so on; a file
    is done when a copied task is met, since the tasks before it are copied, too.  So what was inherited
    is not read but for the part around its end.  Where that holds the result is that of
    `counter.fork_boundary` over all tasks; a file of which a task before the last copied one is its own
    is ambiguous there, but found here if that task has not been read.
    """
    empty = forks.sparkSession.createDataFrame([], "path string, byte_offset bigint, ownership string")
    open_, seen, width = forks.withColumn("upto", F.col("size")), empty, first_bytes
    while not open_.isEmpty():
        start = F.greatest(F.col("upto") - width, F.lit(0))
        part = open_.select("path", start.cast("long").alias("start"), F.col("upto").alias("stop"))
        tasks = scan_tasks(read_ranges(part, meter=meter, aligned=False)).join(forks.select("path", "header_id", "created"), "path")
        owned = tasks.select("path", "byte_offset", C.task_ownership(F.col("started_at"), F.col("turn_id"), F.col("created"), F.col("header_id")).alias("ownership"))
        seen = stored(seen.unionByName(owned), "tasks-seen")
        copied = seen.where("ownership = 'copied'").select("path").distinct()
        open_ = stored(open_.withColumn("upto", start).where("upto > 0").join(copied, "path", "left_anti"), "forks-open")
        width *= 2
    found = C.fork_boundary(seen)
    return forks.select("path").join(found, "path", "left").withColumn("boundary", F.coalesce("boundary", F.lit("none")))


def counter_events(lines: DataFrame, source_id: str | Column, threads: DataFrame, thresholds: DataFrame, states: DataFrame | None = None, stored: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Ledger rows of a counter source, and its files' diagnostics and states.

    `lines` of read_lines or with byte_offset; `threads` (id, path, model, parent_id, is_subagent);
    `thresholds` (model, lc_threshold) of the card of today.  Of files in `states` (path, cursor, saved,
    as of the second result) `lines` holds only what lies past the cursor; such files are no forks.
    `stored` (frame, name) writes a frame and reads it back, so that both results share one pass.
    """
    placed = lines if "byte_offset" in lines.columns else with_offsets(lines)
    header = scan_header(placed)
    tasks = scan_tasks(placed).join(header.select("path", "header_id", "created"), "path")
    owned = tasks.withColumn("ownership", C.task_ownership(F.col("started_at"), F.col("turn_id"), F.col("created"), F.col("header_id")))
    own = C.exclude_inherited(scan_counter(placed), header, C.fork_boundary(owned))
    if states is not None:
        own = C.resume(own, states).withColumn("forked", F.coalesce("forked", F.lit(False)))
    named = placed.select("path", _source(source_id).alias("source_id")).distinct()
    files = _files(named, threads, header)
    rows = own.join(files, "path")
    order = ["byte_offset"]
    classified = C.classify(C.active_model(rows, order, F.col("thread_model")), order, F.col("forked"))
    if stored is not None:
        classified = stored(classified, "classified")
    used = C.long_context(C.requests(classified), thresholds)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    events = used.select(
        U.event_id(F.lit("counter"), F.col("source_id"), F.col("path"), F.col("byte_offset").cast("string")).alias("id"),
        F.lit("counter").alias("provider"),
        "source_id",
        F.coalesce("thread_id", "header_id", name).alias("session_id"),
        F.col("parent_id").alias("parent_session_id"),
        "ts",
        F.col("active_model").alias("model"),
        F.col("path").alias("source_path"),
        "byte_offset",
        "is_subagent",
        *COUNTERS,
        *LONG,
    )
    counts = files.select("path", "source_id", F.col("inherited").cast("long").alias("inherited"))
    # a last line without an end will be read again: the state stops before it
    states = C.state(classified.where(F.coalesce("ended", F.lit(True))), order)
    counted = counts.join(states, "path", "left").select("*", *C.saved_diagnostics(F.col(C.SAVED))).na.fill(0)
    return as_ledger(events), counted


def _files(paths: DataFrame, threads: DataFrame, header: DataFrame) -> DataFrame:
    """What is known of each file (path, source_id): its thread's and its header's parent and kind."""
    known = C.thread_lookup(paths, threads)
    named = header.select("path", "header_id", F.col("parent_id").alias("_parent"), "is_spawned", F.lit(True).alias("_forked"))
    joined = known.join(named, "path", "left")
    return joined.select("path", "source_id", "thread_id", "thread_model", "header_id", F.coalesce("parent_id", "_parent").alias("parent_id"), (F.col("is_subagent") | F.coalesce("is_spawned", F.lit(False))).alias("is_subagent"), F.coalesce("_forked", F.lit(False)).alias("inherited"))


def final_snapshot(lines: DataFrame, source_id: str) -> DataFrame:
    """One provisional row a file: its last cumulative counter, dated by the file where the line is not."""
    rows = scan_counter_any_time(lines)
    at = F.struct("block", "seq")
    last = rows.groupBy("path").agg(F.max_by(F.struct(*C.TOTALS, "ts", "modified"), at).alias("s"))
    picked = last.select("path", *[F.col(f"s.{t}").alias(c) for t, c in zip(C.TOTALS, COUNTERS)], F.coalesce("s.ts", "s.modified").alias("ts"))
    return picked.withColumn("input", U.uncached_input(F.col("input"), F.col("cached"))).withColumns({"source_id": F.lit(source_id), "provisional": F.lit(True)})


def scan_counter_any_time(lines: DataFrame) -> DataFrame:
    """Snapshots whether or not their line has a time."""
    total = "j.payload.info.total_token_usage"
    rows = _parsed(candidates(lines, "token_count"), _EVENT, "path", "block", "seq", "modified").where(F.col(total).isNotNull())
    return rows.select("path", "block", "seq", "modified", U.parse_instant(F.col("j.timestamp")).alias("ts"), *[F.coalesce(F.col(f"{total}.{f}"), F.lit(0)).cast("long").alias(f"tot_{c}") for c, f in _FIELDS.items()])


def scan_sources(scans: list[DataFrame]) -> DataFrame:
    """The union of both providers' scans, each message once."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return dedup_scan(out)
