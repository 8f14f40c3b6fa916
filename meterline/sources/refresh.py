"""The refresh of a ledger from its transcripts, as one job (I1-I8, SC9, SC12, SK4, SK5).

List the files of all sources, compare them with the manifest, tell appends from rewrites by hashes
before the cursor, read the new bytes of grown files and all of new and rewritten ones, once; put the
rows of the touched buckets and their manifest in place together.  Run again, it finds nothing to do.

A file that grew goes on from the state that the manifest holds, which gives the rows and diagnostics
of a read of the whole file; forked files are always read whole, since a later task may move their
boundary.  An append leaves its file `pending`: a full refresh reads such files from the start again,
as the hashes cover only what stands near the ends.  A last line without an end gives rows, but the
state stops before it, and the next read begins with it.  A file that holds bytes that are no UTF-8
keeps its rows and loses its cursor (its manifest entry has no size), so that the next refresh reads
it again.  A source of which no folder is there keeps all it has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import counter as C
from ..operators.attribution import enrich_threads, reattribute
from ..operators.dedup import latest
from ..schema import LEDGER, PROVIDERS
from .buckets import BucketStore, exists
from .byte_ranges import guards, read_ranges
from .lines import file_listing
from .scratch import working_folder
from .transcripts import counter_events, message_events

_long, _text = T.LongType(), T.StringType()
_TOTALS = T.StructType([T.StructField(c, _long) for c in C.TOTALS])
_KEY = T.StructType([T.StructField(c, _long) for c in (*C.TOTALS, *C.LASTS)])
STATE = T.StructType([T.StructField("water", _TOTALS), T.StructField("key", _KEY), T.StructField("last", _TOTALS), T.StructField("model", _text), T.StructField("decreased", T.BooleanType()), *[T.StructField(c, _long) for c in ("duplicates", "stale")]])
#: A row a file: how far it was read, the hashes before that place, and what a later read goes on from.
MANIFEST = T.StructType(
    [
        *[T.StructField(c, _text) for c in ("source_id", "provider", "path")],
        T.StructField("size", _long),
        T.StructField("modified", T.TimestampType()),
        *[T.StructField(c, _long) for c in ("parsed_offset", "head", "tail", "inherited")],
        *[T.StructField(c, T.BooleanType()) for c in ("forked", "pending")],
        T.StructField("saved", STATE),
    ]
)
ACCOUNTS = T.StructType([T.StructField(c, _text) for c in ("source_id", "session_id", "account_id", "confidence", "basis")])
THREADS = T.StructType([*[T.StructField(c, _text) for c in ("source_id", "path", "id", "model", "parent_id")], T.StructField("is_subagent", T.BooleanType())])
_MARKERS = ("token_count", "turn_context", "task_started", '"usage"')


class Refreshed(NamedTuple):
    """What a refresh did: files by kind, sources without a folder, bytes of transcripts read for rows
    and for hashes, and whether totals are provisional (appends wait for a full refresh)."""

    new: int = 0
    changed: int = 0
    appended: int = 0
    removed: int = 0
    unchanged: int = 0
    failed: int = 0
    missing_sources: tuple[str, ...] = ()
    line_bytes: int = 0
    guard_bytes: int = 0
    provisional: bool = False


class LedgerStore(BucketStore):
    """The ledger and its manifest, both in buckets of the transcript's path, and the metadata that was
    applied to it, a version a source."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        super().__init__(spark, root)
        self.ledger = self.table("ledger", LEDGER, "id", ("source_path",), buckets)
        self.manifest = self.table("manifest", MANIFEST, "path", ("path",), buckets)
        self.accounts = self.table("accounts", ACCOUNTS, "session_id", ("session_id",), 8)
        self.threads = self.table("threads", THREADS, "path", ("path",), 8)

    def cursors(self) -> DataFrame:
        """(source_id, path, state) of every file: `reconciled` after a whole read, `pending` after an
        append until a full refresh, `retry` where the last read failed."""
        state = F.when(F.col("size").isNull(), "retry").when(F.col("pending"), "pending").otherwise("reconciled")
        return self.manifest.read().select("source_id", "path", state.alias("state"))

    def provisional(self, source_ids: list[str] | None = None) -> DataFrame:
        """One row: whether a file of the sources (all: None) is pending."""
        rows = self.manifest.read()
        rows = rows if source_ids is None else rows.where(F.col("source_id").isin(source_ids))
        return rows.agg(F.coalesce(F.max("pending"), F.lit(False)).alias("provisional"))

    def remove_sources(self, source_ids: list[str]) -> None:
        """Drop all rows and cursors of sources."""
        self.recover()
        parts = {t.root: t.parts_of(t.read().where(F.col("source_id").isin(source_ids))) for t in self.tables.values()}
        self.commit({name: (t.read().where(F.lit(False)), parts[t.root]) for name, t in self.tables.items()})


def materialised(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the working folder and read back."""
    spark, folder = df.sparkSession, working_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _listed(spark: SparkSession, sources: DataFrame, pattern: str) -> tuple[DataFrame, tuple[str, ...], list[str]]:
    """(source_id, provider, path, size, modified) of the files of all enabled sources, the names of
    those whose folders are missing, and of those that were listed.  Sources are a short list of the user's."""
    listing, missing, there = None, [], []
    for s in sources.where("enabled").orderBy("source_id").collect():
        roots = [r for r in s.roots if exists(spark, r)]
        if not roots:
            missing.append(s.source_id)
            continue
        files = file_listing(spark, roots, pattern)
        there.append(s.source_id)
        own = files.select(F.lit(s.source_id).alias("source_id"), F.lit(s.provider).alias("provider"), "path", "size", "modified")
        listing = own if listing is None else listing.unionByName(own)
    if listing is None:
        listing = spark.createDataFrame([], "source_id string, provider string, path string, size bigint, modified timestamp")
    return listing, tuple(missing), there


def plan(store: LedgerStore, listing: DataFrame, listed: list[str], full: bool = False, meter=None) -> DataFrame:
    """What is to be done with each file of the sources `listed`: (source_id, provider, path, size,
    modified, kind, start, saved), kind being new, changed, appended, removed or unchanged."""
    old = store.manifest.read().where(F.col("source_id").isin(listed))
    known = old.select("source_id", "path", *[F.col(c).alias(f"_{c}") for c in ("provider", "size", "modified", "parsed_offset", "head", "tail", "forked", "pending", "saved")], F.lit(True).alias("_old"))
    both = listing.withColumn("_new", F.lit(True)).join(known, ["source_id", "path"], "full_outer")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified"))
    again = F.lit(full) & F.col("_pending")
    kind = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "new").when(again, "changed").when(same, "unchanged").otherwise("changed")
    grew = ~F.lit(full) & (F.col("size") > F.col("_size")) & (F.col("_parsed_offset") > 0) & ~F.col("_forked") & F.col("_head").isNotNull() & F.col("_tail").isNotNull()
    compared = materialised(both.withColumn("kind", kind).withColumn("_grew", (F.col("kind") == "changed") & F.coalesce(grew, F.lit(False))), "compared")
    asked = compared.where("_grew").select("source_id", "path", F.col("_parsed_offset").alias("upto"))
    now = guards(asked, meter=meter).select("source_id", "path", "head", "tail")
    checked = compared.join(now, ["source_id", "path"], "left")
    append = F.col("_grew") & (F.col("head") == F.col("_head")) & (F.col("tail") == F.col("_tail"))
    kind = F.when(F.coalesce(append, F.lit(False)), "appended").otherwise(F.col("kind"))
    start = F.when(F.col("kind") == "appended", F.col("_parsed_offset")).otherwise(0).cast("long")
    planned = checked.withColumn("kind", kind).withColumn("start", start)
    shown = ["source_id", F.coalesce("provider", "_provider").alias("provider"), "path", "size", "modified", "kind", "start", F.when(F.col("kind") == "appended", F.col("_saved")).alias("saved")]
    return materialised(planned.select(*shown), "plan")


def scan(planned: DataFrame, threads: DataFrame, thresholds: DataFrame, accounts: DataFrame | None = None, meter=None, providers: set[str] = frozenset(PROVIDERS)) -> tuple[DataFrame, DataFrame]:
    """The providers' ledger rows of the bytes to be read, and a row a file: parsed_offset, valid,
    inherited, forked and saved.  Every byte is read once; lines that matter stay as written files
    for the passes over them."""
    reading = planned.where(F.col("kind").isin("new", "changed", "appended"))
    lines = read_ranges(reading.select("source_id", "provider", "path", "start", F.col("size").alias("stop")), keep=("source_id", "provider"), meter=meter)
    matters = F.col("byte_offset") == 0
    for m in _MARKERS:
        matters = matters | F.contains("value", F.lit(m))
    end = F.when(F.col("ended"), F.col("byte_offset") + F.octet_length("value") + 1)
    lines = materialised(lines.select("source_id", "provider", "path", "byte_offset", "ended", "valid", end.alias("end"), F.when(matters, F.col("value")).alias("value")), "lines")
    ends = lines.groupBy("source_id", "path").agg(F.max("end").alias("_end"), F.min("valid").alias("valid"))

    held = lines.where("value is not null").drop("end", "valid")
    rows = [message_events(held.where("provider = 'message'"), F.col("source_id"), accounts)] if "message" in providers else []
    states = reading.where("kind = 'appended' and provider = 'counter' and saved is not null").select("path", F.col("start").alias("cursor"), "saved")
    if "counter" in providers:
        counters, files = counter_events(held.where("provider = 'counter'"), F.col("source_id"), threads, thresholds, states, materialised)
        rows.append(counters)
    else:
        files = reading.sparkSession.createDataFrame([], T.StructType([T.StructField("path", _text), T.StructField("source_id", _text), T.StructField("inherited", _long), T.StructField("saved", STATE)]))
    state = files.select("path", "source_id", "inherited", (F.col("inherited") > 0).alias("forked"), F.col("saved").alias("_saved"))
    per_file = reading.join(ends, ["source_id", "path"], "left").join(state, ["source_id", "path"], "left")
    per_file = per_file.select(
        "source_id", "provider", "path", "size", "modified", "kind", "start",
        F.greatest(F.coalesce("_end", "start"), F.col("start")).alias("parsed_offset"),
        F.coalesce("valid", F.lit(True)).alias("valid"),
        F.coalesce("inherited", F.lit(0)).cast("long").alias("inherited"),
        F.coalesce("forked", F.lit(False)).alias("forked"),
        F.coalesce("_saved", "saved").alias("saved"),
    )
    return reduce(DataFrame.unionByName, rows), per_file


def refresh(
    store: LedgerStore,
    sources: DataFrame,
    threads: DataFrame,
    thresholds: DataFrame,
    accounts: DataFrame | None = None,
    full: bool = False,
    pattern: str = "*.jsonl",
) -> Refreshed:
    """One refresh of `store` from `sources` (source_id, provider, roots, enabled).

    `threads` and `thresholds` as of `counter_events`, `accounts` as of `session_accounts`.  A `full` one
    also reads again what appends have left pending.  Files are known by source and path, so a path must
    not be below two sources of one provider.
    """
    spark = store.spark
    store.recover()
    line_bytes, guard_bytes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    listing, missing, listed = _listed(spark, sources, pattern)
    planned = plan(store, listing, listed, full, guard_bytes)
    found = planned.groupBy("kind", "provider").count().collect()
    kinds = Counter()
    for r in found:
        kinds[r.kind] += r["count"]
    touched = planned.where("kind <> 'unchanged'")
    failed = 0
    if kinds.keys() - {"unchanged"}:
        # where files have only gone, either provider's empty scan will do
        providers = {r.provider for r in found if r.kind in ("new", "changed", "appended")} or {"message"}
        rows, per_file = scan(planned, threads, thresholds, accounts, line_bytes, providers)
        per_file = materialised(per_file, "files")
        failed = per_file.where("not valid").count()
        paths = touched.select("source_id", F.col("path").alias("source_path"), "path", "kind", "start")
        good = per_file.where("valid").select("source_id", F.col("path").alias("source_path"))
        keys = ["source_id", "source_path"]

        parts = store.ledger.parts_of(paths)
        old = store.ledger.parts(parts).join(paths.join(per_file.where("not valid").select("source_id", "path"), ["source_id", "path"], "left_anti").drop("path"), keys, "left")
        # rows of whole reads leave; of an append those of a line that had no end when it was read
        kept = old.where("kind is null or (kind = 'appended' and byte_offset < start)").select(LEDGER.names)
        merged = latest(kept.unionByName(rows.join(good, keys, "left_semi").select(LEDGER.names)), ["id"], [F.desc("ts"), F.desc("byte_offset")])

        hashed = guards(per_file.where("valid").withColumn("upto", F.col("parsed_offset")), meter=guard_bytes)
        entries = hashed.withColumn("pending", F.col("kind") == "appended").select(MANIFEST.names)
        unread = {f.name: F.lit(None).cast(f.dataType) for f in MANIFEST if f.name in ("size", "modified", "parsed_offset", "head", "tail", "saved")}
        cursorless = per_file.where("not valid").withColumns(unread).withColumn("pending", F.lit(False)).select(MANIFEST.names)
        places = store.manifest.parts_of(touched)
        others = store.manifest.parts(places).join(touched.select("source_id", "path"), ["source_id", "path"], "left_anti")
        store.commit({"ledger": (merged, parts), "manifest": (others.unionByName(entries).unionByName(cursorless), places)})
    waiting = store.provisional().first().provisional
    counts = {k: kinds.get(k, 0) for k in ("new", "changed", "appended", "removed", "unchanged")}
    return Refreshed(**counts, failed=failed, missing_sources=missing, line_bytes=line_bytes.value, guard_bytes=guard_bytes.value, provisional=waiting)


def _differences(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key) of rows that only one side has, or that differ."""
    columns = [c for c in new.columns if c != key]
    a, b = (d.select(key, F.struct(*columns).alias(n)) for d, n in ((old, "_a"), (new, "_b")))
    return a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key).distinct()


def apply_accounts(store: LedgerStore, source_id: str, accounts: DataFrame, has_config: bool = False) -> int:
    """Make `accounts` (as of `session_accounts`) those of a message source: only rows of sessions whose
    entry differs from the stored version are attributed anew, only their buckets are written, and no
    transcript is read.  Gives the number of sessions that differ."""
    new = accounts.where("session_id is not null").select(F.lit(source_id).alias("source_id"), "session_id", "account_id", "confidence", "basis")
    base = F.coalesce("parent_session_id", "session_id")
    return _rewrite(store, source_id, "message", "accounts", new, base, lambda rows: reattribute(rows, accounts, has_config))


def apply_threads(store: LedgerStore, source_id: str, threads: DataFrame) -> int:
    """The same for `threads` (path, id, model, parent_id, is_subagent) of a counter source: rows of the
    paths whose thread differs."""
    known = threads.where("path is not null").groupBy("path").agg(F.max_by(F.struct("id", "model", "parent_id", "is_subagent"), "id").alias("t"))
    new = known.select(F.lit(source_id).alias("source_id"), "path", "t.*")
    return _rewrite(store, source_id, "counter", "threads", new, F.col("source_path"), lambda rows: enrich_threads(rows, threads))


def _rewrite(store: LedgerStore, source_id: str, provider: str, name: str, new: DataFrame, on: Column, change: Callable[[DataFrame], DataFrame]) -> int:
    """Put a new version of a metadata table in place, with `change` made to the source's rows for which
    `on` is a key that differs from the stored version."""
    store.recover()
    table, ledger = store.tables[name], store.ledger
    old = table.read().where(F.col("source_id") == source_id)
    changed = materialised(_differences(old, new, table.key), f"changed-{name}").withColumnRenamed(table.key, "_changed")
    n = changed.count()
    if n:
        mine = F.coalesce((F.col("source_id") == source_id) & (F.col("provider") == provider), F.lit(False))
        parts = ledger.parts_of(ledger.read().where(mine).join(changed, on == F.col("_changed"), "left_semi"))
        held = ledger.parts(parts)
        hit = held.where(mine).join(changed, on == F.col("_changed"), "left_semi")
        rest = held.where(~mine).unionByName(held.where(mine).join(changed, on == F.col("_changed"), "left_anti"))
        merged = rest.select(LEDGER.names).unionByName(change(hit.select(LEDGER.names)).select(LEDGER.names))
        # partitions are by source, so those of the metadata hold this source's entries only
        places = sorted({*table.parts_of(old), *table.parts_of(new)})
        store.commit({"ledger": (merged, parts), name: (new.select(table.schema.names), places)})
    return n
