"""Token arithmetic and identities of ledger rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def context_tokens(prefix: str = "") -> Column:
    return sum((F.col(prefix + c) for c in ("cached", "cache_w5m", "cache_w1h")), F.col(prefix + "input"))


def total_tokens(prefix: str = "") -> Column:
    """Context and output; reasoning is part of the output."""
    return context_tokens(prefix) + F.col(prefix + "output")


def uncached_input(raw: Column, cached: Column) -> Column:
    """Cumulative counters include cached tokens in their input."""
    return F.greatest(F.lit(0).cast("long"), raw - cached)


def five_minute_writes(w5m: Column, w1h: Column, unsplit: Column) -> Column:
    """The un-split total goes to five-minute writes only where both splits are zero."""
    return w5m + F.when((w5m == 0) & (w1h == 0), unsplit).otherwise(0)


def subagent_of_path(path: Column) -> Column:
    """The file's stem after the last `subagents` folder, else null."""
    found = F.regexp_extract(path, r"^.*/subagents/([^/]+?)(\.[^./]*)?$", 1)
    return F.when(found != "", found)


def effective_session(agent: Column, session: Column) -> Column:
    return F.coalesce(F.concat(F.lit("agent:"), agent), session)


def event_id(provider: Column, source: Column, path: Column, rest: Column) -> Column:
    return F.concat_ws(":", provider, source, path, rest)


def rollup_id(keys: list[Column], instant: Column) -> Column:
    """Identity of a compact row: its keys and instant, joined by a separator that no key has."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.concat(F.lit("rollup:"), F.concat_ws("\x1f", *parts, instant.cast("double").cast("string")))


def path_within(path: Column, scope: Column) -> Column:
    """Whether a path is a scope or lies below it."""
    return (path == scope) | F.startswith(path, F.concat(F.rtrim(scope, F.lit("/")), F.lit("/")))


def parse_instant(text: Column) -> Column:
    """ISO-8601 with a zone; bare dates and malformed strings are null."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT.*(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(text))


def is_uuid7(text: Column) -> Column:
    return F.coalesce((F.length(text) == 36) & (F.substring(text, 15, 1) == "7"), F.lit(False))


def source_key(provider: Column, root: Column) -> Column:
    return F.concat(F.lower(provider), F.lit(":"), root)


def natural_key(text: Column, width: int = 20) -> Column:
    """A sort key that puts "2" before "10": runs of digits padded with zeros."""
    padded = F.regexp_replace(F.lower(text), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")
