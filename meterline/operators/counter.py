"""Requests rebuilt from cumulative counters.

Rows are one transcript's lines: `path`, the columns of `order` that give their place, and either a
snapshot (`tot_<counter>` and, where the line states the request itself, `last_<counter>`) or a
change of `model` (without totals).  All windows share one partitioning and order, so Spark
exchanges the rows once.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.usage import is_uuid7, uncached_input
from ..schema import COUNTERS, LONG

TOTALS = tuple(f"tot_{c}" for c in COUNTERS)
LASTS = tuple(f"last_{c}" for c in COUNTERS)
#: The column with what was known of a file when it was read up to its cursor.
SAVED = "saved"


def _any(flags) -> Column:
    return reduce(or_, flags)


def _key() -> Column:
    return F.struct(*TOTALS, *LASTS)


def high_water(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds hw_<counter>: each component's greatest earlier value, null before the first snapshot."""
    before = Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"hw_{c}": F.max(f"tot_{c}").over(before) for c in COUNTERS})


def positive_delta(counter: str) -> Column:
    return F.greatest(F.lit(0), F.col(f"tot_{counter}") - F.col(f"hw_{counter}"))


def clamped_last(counter: str, limit: Column) -> Column:
    """A stated request, but no more than the progress that the totals prove."""
    return F.least(F.greatest(F.lit(0), F.coalesce(F.col(f"last_{counter}"), F.lit(0))), limit)


def active_model(df: DataFrame, order: list[str], fallback: Column | None = None) -> DataFrame:
    """Adds active_model: the latest change of model up to the row, else `fallback`, else unknown."""
    upto = Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.last(F.when(F.col("model") != "", F.col("model")), ignorenulls=True).over(upto)
    return df.withColumn("active_model", F.coalesce(named, *([fallback] if fallback is not None else []), F.lit("unknown")))


def classify(df: DataFrame, order: list[str], forked: Column | None = None) -> DataFrame:
    """Adds status (accepted, duplicate or stale), decreased, explicit and use_<counter>.

    A snapshot without progress repeats the last accepted one (duplicate) or not (stale).  The
    request's usage is the stated one within the proven progress, else the progress.  The first
    snapshot counts as stated or whole; in a forked file (`forked`) only as stated.  Rows of `resume`
    that stand for what was read before give the start and are nothing themselves.
    """
    saved = SAVED in df.columns
    forked = F.lit(False) if forked is None else forked
    df = high_water(df, order).withColumn("is_snapshot", F.col("tot_input").isNotNull() & (F.col(SAVED).isNull() if saved else F.lit(True)))
    before = Window.partitionBy("path").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("hw_input").isNull()
    limit = {c: F.when(first, F.col(f"tot_{c}")).otherwise(positive_delta(c)) for c in COUNTERS}
    fenced = {c: clamped_last(c, limit[c]) for c in COUNTERS}
    progress = first | _any(positive_delta(c) > 0 for c in COUNTERS)
    stated = _any(F.coalesce(F.col(f"last_{c}"), F.lit(0)) > 0 for c in COUNTERS)
    explicit = stated & (_any(x > 0 for x in fenced.values()) | (first & forked))
    nothing = first & forked & ~stated
    df = df.withColumns(
        {
            "accepted": F.col("is_snapshot") & progress,
            "decreased": F.col("is_snapshot") & F.coalesce(_any(F.col(f"tot_{c}") < F.col(f"hw_{c}") for c in COUNTERS), F.lit(False)),
            "explicit": F.coalesce(explicit, F.lit(False)),
            **{f"use_{c}": F.when(nothing, 0).when(explicit, fenced[c]).otherwise(limit[c]).cast("long") for c in COUNTERS},
        }
    )
    accepted = F.when(F.col("accepted"), _key())
    known = F.last(F.coalesce(accepted, F.col(f"{SAVED}.key")) if saved else accepted, ignorenulls=True).over(before)
    status = F.when(F.col("accepted"), "accepted").when(_key().eqNullSafe(known), "duplicate").otherwise("stale")
    return df.withColumn("status", F.when(F.col("is_snapshot"), status))


def requests(classified: DataFrame) -> DataFrame:
    """The accepted snapshots with any usage; uncached input apart from cached."""
    used = classified.where(F.col("accepted") & _any(F.col(f"use_{c}") > 0 for c in COUNTERS))
    raw = used.withColumn("raw_input", F.col("use_input"))
    return raw.withColumns({"input": uncached_input(F.col("use_input"), F.col("use_cached")), **{c: F.col(f"use_{c}") for c in COUNTERS if c != "input"}})


def long_context(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds lc_<counter>: all counters of a stated request whose raw input passes the model's
    threshold (`thresholds`: model, lc_threshold), else zeros."""
    known = thresholds.select(F.col("model").alias("_model"), "lc_threshold").dropDuplicates(["_model"])
    joined = df.join(known, F.col("active_model") == F.col("_model"), "left")
    long = F.coalesce(F.col("explicit") & (F.col("raw_input") > F.col("lc_threshold")), F.lit(False))
    return joined.withColumns({lc: F.when(long, F.col(c)).otherwise(0).cast("long") for c, lc in zip(COUNTERS, LONG)}).drop("_model", "lc_threshold")


def diagnostics(classified: DataFrame, order: list[str]) -> DataFrame:
    """Per path: duplicates, stale, ambiguous_reset (a decrease that the last snapshot has not made up)."""
    at = F.struct(*order)
    last = F.max_by(F.struct(*TOTALS), F.when(F.col("is_snapshot"), at))
    most = F.struct(*[F.max(t).alias(t) for t in TOTALS])
    counts = [F.sum((F.col("status") == s).cast("long")).alias(a) for s, a in (("duplicate", "duplicates"), ("stale", "stale"))]
    found = classified.groupBy("path").agg(*counts, F.max("decreased").alias("_down"), last.alias("_last"), most.alias("_most"))
    reset = F.col("_down") & ~F.col("_last").eqNullSafe(F.col("_most"))
    return found.select("path", F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.coalesce("stale", F.lit(0)).alias("stale"), reset.cast("long").alias("ambiguous_resets"))


def state(classified: DataFrame, order: list[str]) -> DataFrame:
    """(path, saved) of classified rows: all that a later read needs to go on from here, and the
    diagnostics up to here.  saved: water, key (the last accepted snapshot), last (the last one's
    totals), model, decreased, duplicates, stale."""
    at = F.struct(*order)
    before = SAVED in classified.columns
    old = F.max(SAVED) if before else F.lit(None)

    def kept(new: Column, field: str) -> Column:
        return F.coalesce(new, F.col(f"_old.{field}")) if before else new

    snapshot = F.col("is_snapshot")
    found = classified.groupBy("path").agg(
        old.alias("_old"),
        F.struct(*[F.max(t).alias(t) for t in TOTALS]).alias("water"),
        F.max_by(_key(), F.when(F.col("accepted"), at)).alias("key"),
        F.max_by(F.struct(*TOTALS), F.when(snapshot, at)).alias("last"),
        F.nullif(F.max_by("active_model", at), F.lit("unknown")).alias("model"),
        F.coalesce(F.max("decreased"), F.lit(False)).alias("decreased"),
        *[F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(a) for s, a in (("duplicate", "duplicates"), ("stale", "stale"))],
    )
    fields = [
        "water",
        kept(F.col("key"), "key").alias("key"),
        kept(F.col("last"), "last").alias("last"),
        "model",
        (F.col("decreased") | F.coalesce("_old.decreased", F.lit(False)) if before else F.col("decreased")).alias("decreased"),
        *[(F.col(c) + F.coalesce(f"_old.{c}", F.lit(0)) if before else F.col(c)).alias(c) for c in ("duplicates", "stale")],
    ]
    return found.select("path", F.struct(*fields).alias(SAVED))


def saved_diagnostics(saved: Column) -> list[Column]:
    """duplicates, stale and ambiguous_resets of a state, as `diagnostics` gives them for whole files."""
    fell = saved["decreased"] & ~saved["last"].eqNullSafe(saved["water"])
    return [saved["duplicates"].alias("duplicates"), saved["stale"].alias("stale"), F.coalesce(fell, F.lit(False)).cast("long").alias("ambiguous_resets")]


def resume(rows: DataFrame, states: DataFrame) -> DataFrame:
    """`rows` past the cursors of `states` (path, cursor, saved), each file's preceded by a row for what
    was read before; ordered by byte_offset they classify as in a read of the whole file."""
    lasts = [F.lit(None).cast("long").alias(c) for c in LASTS]
    seeds = states.select("path", (F.col("cursor") - 1).alias("byte_offset"), F.col(f"{SAVED}.model").alias("model"), *[F.col(f"{SAVED}.water.{t}").alias(t) for t in TOTALS], *lasts, SAVED)
    return rows.unionByName(seeds, allowMissingColumns=True)


def task_ownership(started: Column, turn: Column, created: Column, child: Column) -> Column:
    """own, copied or ambiguous: by the second a task started against the fork's, a tie by the
    order of version-7 ids (copied where there are none)."""
    by_id = F.when(turn >= child, "own").otherwise("copied")
    has_ids = is_uuid7(child) & is_uuid7(turn)
    timed = F.when(started > created, "own").when(started < created, "copied").when(has_ids, by_id).otherwise("copied")
    return F.when(created.isNotNull() & started.isNotNull(), timed).when(has_ids, by_id).otherwise("ambiguous")


def fork_boundary(tasks: DataFrame) -> DataFrame:
    """Per path of `tasks` (path, byte_offset, ownership): found (with own_start), none or ambiguous.

    Own tasks must follow every copied one, and no task may be of unknown ownership.
    """

    def of(kind: str) -> Column:
        return F.when(F.col("ownership") == kind, F.col("byte_offset"))

    sums = tasks.groupBy("path").agg(F.min(of("own")).alias("own"), F.max(of("copied")).alias("copied"), F.max(of("ambiguous")).alias("odd"))
    unclear = F.col("odd").isNotNull() | F.coalesce(F.col("copied") > F.col("own"), F.lit(False))
    state = F.when(unclear, "ambiguous").when(F.col("own").isNull(), "none").otherwise("found")
    return sums.select("path", state.alias("boundary"), F.when(state == "found", F.col("own")).alias("own_start"))


def exclude_inherited(lines: DataFrame, forked: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Lines of forked files (`forked`: path) from their own start on; other files whole.

    Adds `forked`.  Forked files without a found boundary give no lines.
    """
    marked = forked.select("path").distinct().join(boundaries, "path", "left").select("path", F.lit(True).alias("forked"), F.coalesce("boundary", F.lit("ambiguous")).alias("boundary"), "own_start")
    joined = lines.join(marked, "path", "left")
    kept = F.col("forked").isNull() | ((F.col("boundary") == "found") & (F.col("byte_offset") >= F.col("own_start")))
    return joined.where(kept).withColumn("forked", F.coalesce("forked", F.lit(False))).drop("boundary", "own_start")


def thread_lookup(paths: DataFrame, threads: DataFrame) -> DataFrame:
    """`paths` (path) with thread_id, thread_model, parent_id and is_subagent of `threads` (id,
    path, model, parent_id, is_subagent): by path, else file name, else stem; by the path itself
    whether it is a subagent where no thread is known."""
    keyed = threads.select(F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("path").alias("k")), F.struct(F.lit(1).alias("rank"), F.element_at(F.split("path", "/"), -1).alias("k")), F.struct(F.lit(2).alias("rank"), F.col("id").alias("k")))).alias("x"), F.struct("id", "model", "parent_id", "is_subagent").alias("thread"))
    keyed = keyed.select("x.rank", "x.k", "thread").where("k is not null").groupBy("rank", "k").agg(F.max_by("thread", F.col("thread.id")).alias("thread"))
    name = F.element_at(F.split("path", "/"), -1)
    asked = paths.select("path", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("path").alias("k")), F.struct(F.lit(1).alias("rank"), name.alias("k")), F.struct(F.lit(2).alias("rank"), F.regexp_replace(name, r"\.[^.]*$", "").alias("k")))).alias("x")).select("path", "x.rank", "x.k")
    found = asked.join(keyed, ["rank", "k"]).groupBy("path").agg(F.min_by("thread", "rank").alias("thread"))
    by_path = F.contains(F.col("path"), F.lit("/subagents/"))
    return paths.join(found, "path", "left").select("*", F.col("thread.id").alias("thread_id"), F.col("thread.model").alias("thread_model"), F.col("thread.parent_id").alias("parent_id"), F.when(F.col("thread").isNull(), by_path).otherwise(F.coalesce("thread.is_subagent", F.lit(False))).alias("is_subagent")).drop("thread")
