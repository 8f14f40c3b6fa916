"""Stored day rows, and ranges answered from them.

A day row holds the sums of one UTC day, one set of keys and one rate period, and a sketch of its
sessions.  Sums add and sketches merge, so a range takes its whole days from the table and only the
cut days at its two ends from the ledger; money is computed last, from the card of today.  The table
is partitioned by day, and only days whose rows have changed are written again.

Day rows are made of deduplicated rows.  Sources in `coarse` have day rows only: a day of theirs counts
where its beginning is in the range, and a range that is not all time is then provisional.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COUNTS
from .pricing import MONEY, pricing_period, quote
from .summary import ACCOUNT_KEYS, regroup

KEYS = [*ACCOUNT_KEYS, "model", "is_subagent"]
_SESSION = ["provider", "source_id", "session_id"]
#: Log of the sketches' number of registers: a standard error of about 1.04 / 2^(12 / 2) = 1.6 %.
SKETCH_BITS = 12


def session_key() -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x1e")) for c in _SESSION])


def day_rows(ledger: DataFrame, card: DataFrame) -> DataFrame:
    """(day, period, keys, event_count, counters, sketch) of ledger rows; rows without a time have none."""
    keyed = ledger.where("ts is not null").withColumns({"day": F.to_date("ts"), "period": pricing_period(F.col("ts"), card)})
    sums = [F.sum(c).cast("long").alias(c) for c in ("event_count", *COUNTS)]
    return keyed.groupBy("day", "period", *KEYS).agg(*sums, F.hll_sketch_agg(session_key(), F.lit(SKETCH_BITS)).alias("sketch"))


def day_sessions(ledger: DataFrame) -> DataFrame:
    """(day, provider, source_id, session_id), each once: the exact way to count sessions of a range."""
    return ledger.where("ts is not null").select(F.to_date("ts").alias("day"), *_SESSION).distinct()


class DayTable:
    """Day rows, and the exact sessions beside them, below one folder, both partitioned by day."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, ledger: DataFrame, card: DataFrame, days: list[date] | None = None) -> None:
        """The rows of `days` (all: None) anew from the deduplicated ledger; other days' files stay.
        A day that has become empty keeps a row of nulls, which readers pass over."""
        rows = ledger if days is None else ledger.where(F.to_date("ts").isin(days))
        marks = self.spark.createDataFrame([(d,) for d in days or []], "day date")
        for name, made, order in (("sums", day_rows(rows, card), "provider"), ("sessions", day_sessions(rows), "session_id")):
            full = made.unionByName(marks, allowMissingColumns=True)
            full.hint("rebalance", "day").sortWithinPartitions("day", order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.root}/{name}")

    def sums(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/sums").where("event_count is not null")

    def sessions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/sessions").where("source_id is not null")


def whole_days(start: datetime | None, end: datetime | None) -> tuple[date | None, date | None]:
    """The first whole day of [start, end) and the first day after the last whole one; null is open."""
    first = None if start is None else start.date() + timedelta(days=start.time() != datetime.min.time())
    return first, None if end is None else end.date()


def _inside(column: Column, low, high) -> Column:
    held = F.lit(True)
    if low is not None:
        held = held & (column >= F.lit(low))
    return held if high is None else held & (column < F.lit(high))


def _parts(days: DataFrame, ledger: DataFrame, start: datetime | None, end: datetime | None) -> tuple[DataFrame, DataFrame]:
    """The day rows of the whole days, and the ledger rows of what is left of the range."""
    first, after = whole_days(start, end)
    in_range = _inside(F.col("ts"), start, end)
    if first is not None and after is not None and first >= after:
        return days.where(F.lit(False)), ledger.where(in_range)
    # each edge by its own bounds, so that Parquet's statistics by ts can pass over the rest
    cut = F.lit(False)
    if start is not None:
        cut = cut | _inside(F.col("ts"), start, datetime.combine(first, datetime.min.time()))
    if end is not None:
        cut = cut | _inside(F.col("ts"), datetime.combine(after, datetime.min.time()), end)
    return days.where(_inside(F.col("day"), first, after)), ledger.where(cut)


def _coarse_apart(days: DataFrame, coarse: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    if coarse is None:
        return days, None
    names = coarse.select("source_id").distinct()
    return days.join(names, "source_id", "left_anti").select(days.columns), days.join(names, "source_id", "left_semi").select(days.columns)


def range_rows(days: DataFrame, ledger: DataFrame, card: DataFrame, start: datetime | None, end: datetime | None, coarse: DataFrame | None = None) -> DataFrame:
    """Day rows for [start, end): whole days as stored, the cut ones from the ledger."""
    fine, only = _coarse_apart(days, coarse)
    whole, edges = _parts(fine, ledger, start, end)
    rows = whole.unionByName(day_rows(edges, card).select(whole.columns))
    return rows if only is None else rows.unionByName(only.where(_inside(F.col("day").cast("timestamp"), start, end)))


def range_summary(days: DataFrame, ledger: DataFrame, card: DataFrame, start: datetime | None, end: datetime | None, keys: list[str], coarse: DataFrame | None = None) -> DataFrame:
    """`summary.priced_by(keys)` of the range.  A day row is priced at the later one of its day's and
    its period's beginning, which lies in one rate period with all of its events as long as the card
    has not changed within the day (`stale_days`)."""
    rows = range_rows(days, ledger, card, start, end, coarse)
    at = F.greatest(F.col("day").cast("timestamp"), "period")
    return regroup(quote(rows.withColumn("_at", at), card, at="_at"), keys)


def range_compact(days: DataFrame, ledger: DataFrame, card: DataFrame, start: datetime | None, end: datetime | None, coarse: DataFrame | None = None) -> DataFrame:
    """`summary.compact` of the range."""
    return range_summary(days, ledger, card, start, end, ["provider"], coarse).select("provider", "events", "tokens", *MONEY, "unpriced")


def stale_days(days: DataFrame, card: DataFrame) -> DataFrame:
    """(day) of stored days within which the card changes at an instant that no row of theirs begins at:
    these are to be written again before they are priced by this card."""
    changes = card.select(F.col("valid_from").alias("change"), F.to_date("valid_from").alias("day")).where("change > cast(day as timestamp)").distinct()
    met = days.join(changes, "day").groupBy("day", "change").agg(F.max(F.col("period").eqNullSafe(F.col("change"))).alias("known"), F.max(F.col("period") >= F.col("change")).alias("later"))
    return met.where("not known").select("day").distinct()


def changed_days(before: DataFrame, after: DataFrame) -> list[date]:
    """Days whose sums or sessions differ between two deduplicated ledgers (rows with `id`)."""
    mark = lambda d: d.where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id", "ts", "session_id", "model", *ACCOUNT_KEYS, "is_subagent", "event_count", *COUNTS).cast("decimal(38,0)")).alias("h"))
    a, b = mark(before), mark(after).withColumnsRenamed({"n": "n2", "h": "h2"})
    differ = ~(F.col("n").eqNullSafe(F.col("n2")) & F.col("h").eqNullSafe(F.col("h2")))
    return [r.day for r in a.join(b, "day", "full_outer").where(differ).select("day").orderBy("day").collect()]


def range_sessions(sessions: DataFrame, ledger: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """The exact number of sessions of the range, from each day's distinct ones."""
    whole, edges = _parts(sessions, ledger, start, end)
    rows = whole.select(_SESSION).unionByName(edges.select(_SESSION))
    return rows.distinct().agg(F.count(F.lit(1)).alias("sessions"))


def range_sessions_estimate(days: DataFrame, ledger: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """An estimate of the same from the day rows' sketches."""
    whole, edges = _parts(days, ledger, start, end)
    rest = edges.groupBy(F.to_date("ts").alias("day")).agg(F.hll_sketch_agg(session_key(), F.lit(SKETCH_BITS)).alias("sketch"))
    sketches = whole.select("sketch").unionByName(rest.select("sketch"))
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False))), F.lit(0)).alias("sessions"))


def coarse_provisional(days: DataFrame, coarse: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """One row: whether the range has a bound and one of its sources has day rows only."""
    hit = days.join(coarse.select("source_id").distinct(), "source_id", "left_semi").limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("met")).select((F.col("met") & F.lit(start is not None or end is not None)).alias("provisional"))
