"""The usage ledger: column names, value lists and types."""

from __future__ import annotations

from pyspark.sql import types as T

#: The six token counters of a row; `reasoning` is part of `output` and never added or priced.
COUNTERS = ("input", "cached", "cache_w5m", "cache_w1h", "output", "reasoning")
#: The same counters of the share that fell under long-context pricing.
LONG = tuple(f"lc_{c}" for c in COUNTERS)
COUNTS = (*COUNTERS, *LONG)

PROVIDERS = ("counter", "message")
CONFIDENCES = ("session-verified", "parent-session", "current-auth-only", "current-config-only", "source-only", "ambiguous-sidechain", "ambiguous-account")
BASES = ("telemetry", "support-session", "current-auth", "current-config", "account-conflict", "parent-session", "none")

_string, _long, _time, _flag = T.StringType(), T.LongType(), T.TimestampType(), T.BooleanType()

LEDGER = T.StructType(
    [
        T.StructField("id", _string, False),
        *[T.StructField(c, _string) for c in ("message_id", "provider", "source_id", "account_id", "current_auth_account_id", "attribution_confidence", "attribution_basis", "session_id", "parent_session_id")],
        T.StructField("ts", _time),
        *[T.StructField(c, _string) for c in ("model", "source_path")],
        T.StructField("byte_offset", _long),
        T.StructField("is_subagent", _flag),
        T.StructField("event_count", _long),
        *[T.StructField(c, _long) for c in COUNTS],
    ]
)

RATE_CARD = T.StructType(
    [
        T.StructField("provider", _string),
        T.StructField("model", _string),
        T.StructField("valid_from", _time),
        T.StructField("valid_to", _time),
        *[T.StructField(c, T.DoubleType()) for c in ("input", "cached_read", "cache_w5m", "cache_w1h", "output", "credit_input", "credit_cached", "credit_output")],
        T.StructField("lc_threshold", _long),
        *[T.StructField(c, T.DoubleType()) for c in ("lc_input_multiplier", "lc_output_multiplier")],
    ]
)
