"""Continuous ingest, counter deltas, upserts and day totals (ST1-ST5).

Spark's file stream never reads a file again that has grown, so it takes finished segments; files that
grow have a source of their own, `byte_ranges.stream_growing`.  Late rows count in the stored ledger, which is the source
of truth; the watermark of `daily` only bounds its state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.usage import event_id, total_tokens
from ..operators import counter
from ..schema import COUNTERS
from ..sources.buckets import BucketStore, delete
from ..sources.scratch import working_folder
from ..sources.store import VersionedLedger, filtered
from ..sources.transcripts import as_ledger, scan_counter

_TOTALS = list(counter.TOTALS)
_KEY = [*counter.TOTALS, *counter.LASTS]
_WATER = [f"hw_{c}" for c in COUNTERS]
CLASSIFIED = (
    "path string, byte_offset bigint, at bigint, active_model string, is_snapshot boolean, "
    + ", ".join(f"{c} bigint" for c in _TOTALS)
    + ", accepted boolean, decreased boolean, explicit boolean, status string, "
    + ", ".join(f"use_{c} bigint" for c in COUNTERS)
)
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_lines(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(path, value) of new segments below `folder`."""
    text = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).format("text").load(folder)
    return text.select(F.col("_metadata.file_path").alias("path"), "value")


class CounterState(StatefulProcessor):
    """Per transcript the component-wise high water, the last accepted snapshot and the model, from
    batch to batch.  A key is a group of transcripts: a batch's rows of all of them are handled at once,
    as arrays, and their states are one value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "states binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        names, models, numbers = _unpacked(self.seen.get()[0]) if self.seen.exists() else ([], [], np.empty((0, _WIDTH), np.int64))
        code, found = pd.factorize(batch["path"], use_na_sentinel=False)
        paths = [p if isinstance(p, str) else None for p in found]
        place = {p: i for i, p in enumerate(names)}
        for p in paths:
            place.setdefault(p, len(place))
        own = np.array([place[p] for p in paths])
        models = np.array(models + ["unknown"] * (len(place) - len(models)), object)
        numbers = np.vstack([numbers, np.full((len(place) - len(numbers), _WIDTH), _NONE)])

        order = np.lexsort((batch["byte_offset"].to_numpy(), code))
        batch, code = batch.iloc[order], code[order]
        first = np.searchsorted(code, np.arange(len(paths)))
        named = batch["model"].to_numpy(object)
        latest = np.maximum.accumulate(np.where(batch["model"].notna() & (batch["model"] != ""), np.arange(len(code)), -1))
        active = np.where(latest >= first[code], named[latest], models[own][code])
        models[own] = active[np.append(first[1:], len(code)) - 1]

        taken = batch["tot_input"].notna().to_numpy(bool)
        if taken.any():
            snapshots = batch[taken].assign(active_model=active[taken])
            out, numbers[own] = _classified(snapshots, code[taken], numbers[own])
            yield out
        self.seen.update((_packed(list(place), models, numbers),))

    def close(self) -> None:
        pass


#: A state's numbers: the high water, and the last accepted snapshot; what is null.
_WIDTH, _NONE = len(_WATER) + len(_KEY), -(1 << 62)


def _packed(paths: list, models: np.ndarray, numbers: np.ndarray) -> bytes:
    held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * _WIDTH), len(paths), [None, pa.py_buffer(numbers.tobytes())])
    states = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(models, pa.string()), held], ["path", "model", "numbers"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, states.schema) as out:
        out.write_batch(states)
    return sink.getvalue().to_pybytes()


def _unpacked(states: bytes) -> tuple[list, list, np.ndarray]:
    held = pa.ipc.open_stream(states).read_next_batch()
    numbers = np.frombuffer(held["numbers"].buffers()[1], np.int64)[: held.num_rows * _WIDTH]
    return held["path"].to_pylist(), held["model"].to_pylist(), numbers.reshape(-1, _WIDTH)


def _longs(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    out = np.full((len(rows), len(columns)), _NONE)
    for i, c in enumerate(columns):
        if c in rows:
            there = rows[c].notna().to_numpy(bool)
            out[there, i] = rows[c].to_numpy()[there].astype(np.int64)
    return out


def _classified(snapshots: pd.DataFrame, code: np.ndarray, states: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """The rules of `operators.counter.classify`, from the transcripts' states on, and their new states.

    `snapshots` are in the order of `code`, their transcript's place in `states`, and of their offsets.
    """
    n, width = len(states), len(_WATER)
    # each transcript's state stands before its snapshots
    of = np.concatenate([np.arange(n), code])
    order = np.argsort(of, kind="stable")
    of, row = of[order], np.flatnonzero(order >= n)
    keys = np.vstack([states[:, width:], _longs(snapshots, _KEY)])[order]
    totals = keys[:, :width].copy()
    totals[order < n] = states[:, :width]
    totals[row] = np.where(totals[row] == _NONE, 0, totals[row])
    water = pd.DataFrame(totals).groupby(of).cummax().to_numpy()

    now, before = totals[row], water[row - 1]
    first = before[:, 0] == _NONE
    before = np.where(first[:, None], now, before)
    accepted = (now > before).any(axis=1) | first
    marks = np.arange(len(of))
    marks[row[~accepted]] = 0
    last_accepted = np.maximum.accumulate(marks)

    forked = snapshots["forked"].eq(True).to_numpy(bool) if "forked" in snapshots else np.zeros(len(now), bool)
    limit = np.where(first[:, None], now, np.maximum(0, now - before))
    own, known = keys[row], keys[last_accepted[row - 1]]
    last = np.where(own[:, width:] == _NONE, 0, own[:, width:])
    fenced = np.minimum(np.maximum(0, last), limit)
    stated = (last > 0).any(axis=1)
    explicit = stated & ((fenced > 0).any(axis=1) | (first & forked))
    use = np.where((first & forked & ~stated)[:, None], 0, np.where(explicit[:, None], fenced, limit))
    same = (known == own).all(axis=1)
    at = snapshots["at"].astype("Int64") if "at" in snapshots else pd.Series([pd.NA] * len(now), dtype="Int64")
    out = pd.DataFrame({"path": snapshots["path"].to_numpy(), "byte_offset": snapshots["byte_offset"].to_numpy(), "at": at.to_numpy(), "active_model": snapshots["active_model"].to_numpy(), "is_snapshot": True}, index=range(len(now)))
    out[_TOTALS] = now
    out["accepted"], out["decreased"] = accepted, (now < before).any(axis=1)
    out["explicit"], out["status"] = explicit, np.select([accepted, same], ["accepted", "duplicate"], "stale")
    out[[f"use_{c}" for c in COUNTERS]] = use
    end = np.append(np.searchsorted(of, np.arange(1, n)), len(of)) - 1
    return out, np.hstack([water[end], keys[last_accepted[end]]])


def classified(rows: DataFrame, groups: int = 1024) -> DataFrame:
    """Streaming rows (path, byte_offset, model, tot_*, and where there are any last_*, forked and `at`,
    an instant in microseconds that is passed on) as classified snapshots: the columns that `counter.requests`, `counter.long_context` and
    `counter.diagnostics` read.

    Only new rows are handled, in offset order inside a batch; a batch must not hold rows before
    those of an earlier one.  A total that is null beside tot_input counts as zero; totals are below
    2^53.  Transcripts are dealt into `groups`, which stay as they are for a checkpoint.  Memory: one
    batch's rows of one group, which the source's maxFilesPerTrigger bounds, and some 200 bytes for each
    of its transcripts; so many groups that these are few.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("path"), F.lit(groups)))
    return dealt.groupBy("_group").transformWithStateInPandas(CounterState(), CLASSIFIED, "append", "none")


def counter_deltas(rows: DataFrame) -> DataFrame:
    """Streaming requests of snapshots: the accepted ones' stated usage within the progress over
    the high water, else the progress."""
    return counter.requests(classified(rows)).select("path", "byte_offset", F.col("active_model").alias("model"), *COUNTERS)


def live_ledger(lines: DataFrame, source_id: str) -> DataFrame:
    """Ledger rows of counter transcripts as they grow: streaming lines (path, byte_offset, value, of
    `byte_ranges.stream_growing`) to requests, by each transcript's state.

    A session is named by its file; forks' inherited parts are not told apart, nor long contexts, so the
    rows are those of files without a header, until a refresh puts its own in their place (their ids are
    the same).
    """
    used = counter.requests(classified(scan_counter(lines).withColumn("at", F.unix_micros("ts")).drop("ts", "ended")))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    rows = used.select(
        event_id(F.lit("counter"), F.lit(source_id), F.col("path"), F.col("byte_offset").cast("string")).alias("id"),
        F.lit("counter").alias("provider"),
        F.lit(source_id).alias("source_id"),
        name.alias("session_id"),
        F.timestamp_micros("at").alias("ts"),
        F.col("active_model").alias("model"),
        F.col("path").alias("source_path"),
        "byte_offset",
        F.lit(False).alias("is_subagent"),
        *COUNTERS,
    )
    return as_ledger(rows)


def upsert(rows: DataFrame, ledger: VersionedLedger, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each id across micro-batches; a batch that runs again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ledger.upsert(batch)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_buckets(rows: DataFrame, store: BucketStore, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key in a bucketed table: a micro-batch writes the buckets that its
    keys fall into, and notes its number with the same commit, so that one that runs again is passed
    over.  It is written down first, so that the stream's own steps run once a batch.  The checkpoint's
    name is the stream's."""
    stream = re.sub(r"\W", "_", checkpoint.rstrip("/").rsplit("/", 1)[-1])

    def write(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, working_folder(batch.sparkSession, "batch")
        batch.write.parquet(folder)
        store.upsert(table, spark.read.schema(batch.schema).parquet(folder), stream, number)
        delete(spark, folder)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily(ledger: DataFrame, late: str = "30 days") -> DataFrame:
    """Day totals as rows arrive."""
    days = ledger.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "provider", "model")
    return days.agg(F.sum("event_count").alias("events"), F.sum(total_tokens()).alias("tokens")).select(F.to_date("window.start").alias("day"), "provider", "model", "events", "tokens")


def moving_window(ledger: DataFrame, now, hours: int) -> DataFrame:
    """The stored ledger's rows of the last hours before `now`: run again with a new `now`, rows
    expire without new data."""
    return filtered(ledger, start=now - pd.Timedelta(hours=hours), end=now)
