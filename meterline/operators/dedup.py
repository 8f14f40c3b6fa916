"""Keeping the latest copy of a message, and exact rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.usage import rollup_id
from ..schema import COUNTS

ROLLUP_KEYS = ("source_id", "source_path", "provider", "account_id", "current_auth_account_id", "attribution_confidence", "attribution_basis", "session_id", "parent_session_id", "model", "is_subagent")


def latest(df: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`; Spark limits the window's groups before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def dedup_file(df: DataFrame) -> DataFrame:
    """Inside a file: the latest row a session, kind and message; ties keep the larger offset."""
    return latest(df, ["source_path", "session_id", "is_subagent", "message_id"], [F.desc("ts"), F.desc("byte_offset")])


def dedup_messages(ledger: DataFrame) -> DataFrame:
    """The latest row a source, message and kind; the counter provider's rows pass through.

    Rows of the message provider without a message id drop out.  A time filter belongs after this:
    a message whose latest copy is outside the window counts nowhere.
    """
    own = ledger.where((F.col("provider") == "message") & F.col("message_id").isNotNull())
    newest = [F.desc("ts"), F.desc("byte_offset"), F.asc("source_path"), F.asc("id")]
    return ledger.where("provider = 'counter'").unionByName(latest(own, ["source_id", "message_id", "is_subagent"], newest))


def dedup_scan(events: DataFrame) -> DataFrame:
    """Across the files of a direct scan: by message and kind, or by id where a row has no message."""
    kind = F.when(F.col("is_subagent"), "sidechain").otherwise("main")
    key = F.coalesce(F.concat_ws(":", F.col("message_id"), F.when(F.col("message_id").isNotNull(), kind)), F.col("id"))
    keyed = events.withColumn("_key", F.when(F.col("message_id").isNotNull(), key).otherwise(F.col("id")))
    return latest(keyed, ["source_id", "_key"], [F.desc("ts"), F.desc("byte_offset"), F.asc("source_path"), F.asc("id")]).drop("_key")


def rollup_instant(ledger: DataFrame) -> DataFrame:
    """Rows equal in all keys and the exact instant become one, with counters and counts summed."""
    sums = [F.sum(c).alias(c) for c in ("event_count", *COUNTS)]
    rolled = ledger.groupBy(*ROLLUP_KEYS, "ts").agg(*sums)
    return rolled.withColumn("id", rollup_id([F.col(k) for k in ROLLUP_KEYS], F.col("ts")))
