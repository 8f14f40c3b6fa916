"""Summaries of a ledger.

Every priced summary first sums the counters by its keys, provider, model and rate period, prices
those few rows, and sums again; only the first step sees the whole ledger, and Spark combines it
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import local_day
from ..functions.usage import natural_key, total_tokens
from ..schema import COUNTERS, COUNTS
from .pricing import MONEY, pricing_period, quote

ACCOUNT_KEYS = ["provider", "source_id", "account_id", "current_auth_account_id", "attribution_confidence", "attribution_basis"]


def _sums(columns) -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in columns]


def overview(ledger: DataFrame) -> DataFrame:
    """One row: events, subagent events, sessions and the six counters; nothing priced."""
    child = F.sum(F.when(F.col("is_subagent"), F.col("event_count")).otherwise(0)).cast("long")
    sessions = F.count_distinct(F.struct("provider", "source_id", "session_id"))
    return ledger.agg(F.coalesce(F.sum("event_count"), F.lit(0)).cast("long").alias("events"), F.coalesce(child, F.lit(0)).alias("subagent_events"), sessions.alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def fine(ledger: DataFrame, card: DataFrame, keys: list[str]) -> DataFrame:
    """Counters by keys, provider, model and rate period, priced."""
    by = list(dict.fromkeys([*keys, "provider", "model"]))
    summed = ledger.withColumn("period", pricing_period(F.col("ts"), card)).groupBy(*by, "period").agg(*_sums(("event_count", *COUNTS)))
    return quote(summed, card, at="period")


def regroup(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Priced rows summed by keys: events, counters, tokens, money, and events without a rate."""
    lacking = F.sum(F.when(F.col("priced"), 0).otherwise(F.col("event_count"))).cast("long")
    money = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in MONEY]
    aggs = [F.sum("event_count").cast("long").alias("events"), *_sums(COUNTERS), F.sum(total_tokens()).cast("long").alias("tokens"), *money, lacking.alias("unpriced")]
    return priced.groupBy(*keys).agg(*aggs) if keys else priced.agg(*[F.coalesce(a, F.lit(0)).alias(n) for a, n in zip(aggs, ["events", *COUNTERS, "tokens", *MONEY, "unpriced"])])


def priced_by(ledger: DataFrame, card: DataFrame, keys: list[str]) -> DataFrame:
    return regroup(fine(ledger, card, keys), keys)


def totals(ledger: DataFrame, card: DataFrame) -> DataFrame:
    return priced_by(ledger, card, [])


def by_model(ledger: DataFrame, card: DataFrame) -> DataFrame:
    return priced_by(ledger, card, ["provider", "model"])


def by_account(ledger: DataFrame, card: DataFrame) -> DataFrame:
    return priced_by(ledger, card, ACCOUNT_KEYS)


def by_day(ledger: DataFrame, card: DataFrame, tz: str = "UTC") -> DataFrame:
    """By the zone's calendar day; a day may hold two rate periods."""
    return priced_by(ledger.withColumn("day", local_day(F.col("ts"), tz)), card, ["day"])


def by_provider(ledger: DataFrame, card: DataFrame) -> DataFrame:
    return priced_by(ledger, card, ["provider"])


def by_period(ledger: DataFrame, card: DataFrame) -> DataFrame:
    return regroup(fine(ledger, card, []), ["period"])


def compact(ledger: DataFrame, card: DataFrame) -> DataFrame:
    """Per provider the events, tokens and money only."""
    return by_provider(ledger, card).select("provider", "events", "tokens", *MONEY, "unpriced")


def _child_keys() -> list[str]:
    return ["provider", "source_id", "session_id", "parent_session_id"]


def top_subagents(ledger: DataFrame, k: int) -> DataFrame:
    """The k child sessions (one at least) of most tokens; ties by their keys."""
    children = ledger.where("is_subagent").groupBy(*_child_keys()).agg(F.sum(total_tokens()).cast("long").alias("tokens"))
    return children.orderBy(F.desc("tokens"), *_child_keys()).limit(max(1, k))


def top_detail(ledger: DataFrame, k: int) -> DataFrame:
    """The rows of the top child sessions: an inner join on null-safe keys."""
    top = top_subagents(ledger, k).select(*[F.col(c).alias(f"_{c}") for c in _child_keys()])
    same = None
    for c in _child_keys():
        same = F.col(c).eqNullSafe(F.col(f"_{c}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ledger.where("is_subagent").join(top, same).select(*ledger.columns)


def by_subagent(ledger: DataFrame, card: DataFrame, k: int | None = None) -> DataFrame:
    rows = ledger.where("is_subagent") if k is None else top_detail(ledger, k)
    return priced_by(rows, card, _child_keys())


def attribution_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("attribution_confidence").agg(F.sum("event_count").cast("long").alias("events"))


def session_count(ledger: DataFrame, exact: bool = True) -> DataFrame:
    key = F.struct("provider", "source_id", "session_id")
    return ledger.agg((F.count_distinct(key) if exact else F.approx_count_distinct(key)).alias("sessions"))


def earliest(ledger: DataFrame) -> DataFrame:
    """Over the raw rows, before any dedup."""
    return ledger.agg(F.min("ts").alias("earliest"))


def full(ledger: DataFrame, card: DataFrame, tz: str = "UTC") -> dict[str, DataFrame]:
    """All breakdowns of one input, grouped again from the same finest priced groups, whose exchange
    Spark shares within a query."""
    keyed = ledger.withColumn("day", local_day(F.col("ts"), tz))
    base = fine(keyed, card, [*ACCOUNT_KEYS, "day", "session_id", "parent_session_id", "is_subagent"])
    return {
        "totals": regroup(base, []),
        "models": regroup(base, ["provider", "model"]),
        "accounts": regroup(base, ACCOUNT_KEYS),
        "days": regroup(base, ["day"]),
        "subagents": regroup(base.where("is_subagent"), _child_keys()),
        "attribution": base.groupBy("attribution_confidence").agg(F.sum("event_count").cast("long").alias("events")),
        "sessions": base.agg(F.count_distinct(F.struct("provider", "source_id", "session_id")).alias("sessions")),
    }


def direct(events: DataFrame, card: DataFrame, keys: list[str]) -> DataFrame:
    """Each event priced by itself and then summed: the check on the pre-aggregated path."""
    return regroup(quote(events, card), keys)


def diagnostics_total(per_file: DataFrame) -> DataFrame:
    """Sums of the files' counters, and whether each kind occurred."""
    names = [c for c in per_file.columns if c in ("duplicates", "stale", "inherited", "ambiguous_resets")]
    sums = per_file.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    return sums.withColumns({f"has_{c}": F.col(c) > 0 for c in names})


def is_provisional(sources: DataFrame, coarse: DataFrame, filtered: bool) -> DataFrame:
    """One row: whether a source (source_id, mode, pending) is in snapshot mode or waits for
    reconciliation, or a time filter meets coarse day rows of it (`coarse`: source_id)."""
    dim = sources.join(coarse.select("source_id").distinct().withColumn("_coarse", F.lit(True)), "source_id", "left")
    flag = (F.col("mode") == "snapshot") | F.col("pending") | (F.lit(filtered) & F.coalesce("_coarse", F.lit(False)))
    return dim.agg(F.coalesce(F.max(flag), F.lit(False)).alias("provisional"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], within: float = 0.005) -> DataFrame:
    """Keys of either side with `agrees`: both have them, equal within the tolerance."""
    one = F.lit(1).alias("_one")  # the key where there is none: one row each
    left, right = a.select(one, *keys, F.struct(*columns).alias("_a")), b.select(one, *keys, F.struct(*columns).alias("_b"))
    joined = left.join(right, ["_one", *keys], "full_outer")
    near = F.lit(True)
    for c in columns:
        near = near & (F.abs(F.col(f"_a.{c}") - F.col(f"_b.{c}")) <= within)
    return joined.select(*keys, F.coalesce(near, F.lit(False)).alias("agrees"))


def ordered(df: DataFrame, key: str) -> DataFrame:
    """Breakdown rows in natural order of a text key."""
    return df.orderBy(natural_key(F.col(key)), key)


def anonymise(df: DataFrame, column: str, prefix: str, order: list[str]) -> DataFrame:
    """Replaces a breakdown's ids by prefix-1, prefix-2, ... in order of first appearance;
    `unattributed`, `ambiguous` and nulls stay.  For breakdowns, which are small: the ordinals
    come from one ordered window over the distinct ids."""
    kept = F.col(column).isNull() | F.col(column).isin("unattributed", "ambiguous")
    seen = df.where(~kept).groupBy(column).agg(F.min(F.struct(*order)).alias("_at"))
    numbered = seen.select(F.col(column).alias("_id"), F.row_number().over(Window.orderBy("_at", column)).alias("_n"))
    joined = df.join(numbered, F.col(column) == F.col("_id"), "left")
    return joined.withColumn(column, F.when(kept, F.col(column)).otherwise(F.concat_ws("-", F.lit(prefix), F.col("_n")))).drop("_id", "_n")
