"""Ledgers, counters and dimensions derived from the driver's tables, in Spark and as SQL.

The derivation is integer arithmetic on `events` and its neighbours, so both engines agree exactly.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COUNTERS, LONG, RATE_CARD

# A card for the derived models, with a change on 2024-01-15; `error` has no rate.
CHANGE = datetime(2024, 1, 15)
CARD = [
    ("counter", "click", None, CHANGE, 5.0, 0.5, 6.25, 10.0, 25.0, 125.0, 12.5, 750.0, 40000, 2.0, 1.5),
    ("counter", "click", CHANGE, None, 4.0, 0.4, 5.0, 8.0, 20.0, 100.0, 10.0, 500.0, 40000, 2.0, 1.5),
    ("message", "click", None, None, 3.0, 0.25, 3.75, 6.0, 15.0, None, None, None, None, 1.0, 1.0),
    ("counter", "view", None, None, 2.0, 0.25, 2.5, 4.0, 12.0, 50.0, 5.0, 300.0, 30000, 2.0, 1.5),
    ("message", "view", None, CHANGE, 1.0, 0.5, 1.25, 2.0, 5.0, None, None, None, None, 1.0, 1.0),
    ("message", "view", CHANGE, None, 2.0, 0.5, 2.5, 4.0, 10.0, None, None, None, None, 1.0, 1.0),
    ("counter", "purchase", None, None, 10.0, 1.0, 12.5, 12.5, 50.0, 250.0, 25.0, 1250.0, None, 1.0, 1.0),
    ("message", "purchase", None, None, 15.0, 1.5, 18.75, 30.0, 75.0, None, None, None, None, 1.0, 1.0),
    ("counter", "signup", CHANGE, None, 0.5, 0.125, 0.25, 0.25, 1.5, 5.0, 0.5, 30.0, None, 1.0, 1.0),
    ("message", "signup", None, None, 0.75, 0.125, 1.0, 1.5, 4.0, None, None, None, None, 1.0, 1.0),
]

CONFIDENCE = ["session-verified", "parent-session", "source-only", "ambiguous-account"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rate_card(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CARD, RATE_CARD)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a ledger: 28 columns, times as instants in UTC."""
    k = F.get_json_object("props", "$.k").cast("long")
    child = F.col("event_type").isin("error", "signup")
    text = lambda c: F.col(c).cast("string")
    session = F.concat(text("user_id"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd"))
    spent = {"input": F.floor(F.col("value") * 100).cast("long"), "cached": F.col("k") * 17, "cache_w5m": F.pmod("event_id", F.lit(7)) * 10, "cache_w1h": F.pmod("event_id", F.lit(3)) * 5, "output": F.col("k") * 3, "reasoning": F.col("k")}
    long = (F.pmod("event_id", F.lit(4)) == 0) & (F.col("value") > 60)
    rows = table(spark, sf_dir, "events").withColumn("k", k)
    return rows.select(
        F.concat(F.lit("event-"), text("event_id")).alias("id"),
        F.concat(text("user_id"), F.lit("-"), text("k")).alias("message_id"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, "counter").otherwise("message").alias("provider"),
        F.concat(F.lit("source-"), F.pmod("user_id", F.lit(5)).cast("string")).alias("source_id"),
        F.when(F.pmod("user_id", F.lit(11)) == 0, "unattributed").otherwise(F.concat(F.lit("acct-"), F.pmod("user_id", F.lit(11)).cast("string"))).alias("account_id"),
        F.lit(None).cast("string").alias("current_auth_account_id"),
        F.element_at(F.array(*map(F.lit, CONFIDENCE)), (F.pmod("user_id", F.lit(4)) + 1).cast("int")).alias("attribution_confidence"),
        F.when(F.pmod("user_id", F.lit(4)) == 0, "telemetry").otherwise("none").alias("attribution_basis"),
        session.alias("session_id"),
        F.when(child & (F.pmod("event_id", F.lit(2)) == 0), F.concat(text("user_id"), F.lit(":2024-01-01"))).alias("parent_session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model"),
        F.concat(F.lit("/log/"), text("user_id"), F.lit(".jsonl")).alias("source_path"),
        (F.col("event_id") * 100).alias("byte_offset"),
        child.alias("is_subagent"),
        F.lit(1).cast("long").alias("event_count"),
        *[x.cast("long").alias(c) for c, x in spent.items()],
        *[F.when(long, spent[c]).otherwise(0).cast("long").alias(lc) for c, lc in zip(COUNTERS, LONG)],
    )


def _long_sql() -> str:
    own = {"input": "floor(value * 100)", "cached": "k * 17", "cache_w5m": "(event_id % 7) * 10", "cache_w1h": "(event_id % 3) * 5", "output": "k * 3", "reasoning": "k"}
    plain = ", ".join(f"CAST({x} AS BIGINT) AS {c}" for c, x in own.items())
    share = ", ".join(f"CAST(CASE WHEN event_id % 4 = 0 AND value > 60 THEN {x} ELSE 0 END AS BIGINT) AS lc_{c}" for c, x in own.items())
    return f"{plain}, {share}"


LEDGER_SQL = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type IN ('error', 'signup') AS child FROM events),
ledger AS (SELECT 'event-' || event_id AS id, user_id || '-' || k AS message_id,
  CASE WHEN user_id % 2 = 0 THEN 'counter' ELSE 'message' END AS provider, 'source-' || (user_id % 5) AS source_id,
  CASE WHEN user_id % 11 = 0 THEN 'unattributed' ELSE 'acct-' || (user_id % 11) END AS account_id,
  CAST(NULL AS VARCHAR) AS current_auth_account_id,
  ['session-verified', 'parent-session', 'source-only', 'ambiguous-account'][user_id % 4 + 1] AS attribution_confidence,
  CASE WHEN user_id % 4 = 0 THEN 'telemetry' ELSE 'none' END AS attribution_basis,
  user_id || ':' || strftime(ts, '%Y-%m-%d') AS session_id,
  CASE WHEN child AND event_id % 2 = 0 THEN user_id || ':2024-01-01' END AS parent_session_id,
  ts, event_type AS model, '/log/' || user_id || '.jsonl' AS source_path, event_id * 100 AS byte_offset, child AS is_subagent,
  CAST(1 AS BIGINT) AS event_count, {_long_sql()} FROM ev),
deduped AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, message_id, is_subagent
  ORDER BY ts DESC, byte_offset DESC, source_path, id) AS rn FROM ledger WHERE provider = 'message') WHERE rn = 1
  UNION ALL BY NAME SELECT * FROM ledger WHERE provider = 'counter')"""


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, datetime):
        return f"TIMESTAMP '{x}'"
    return f"'{x}'" if isinstance(x, str) else repr(x)


_CARD_COLUMNS = ", ".join(f"r_{f.name}" for f in RATE_CARD.fields)
CARD_SQL = f"card({_CARD_COLUMNS}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in CARD) + ")"


def priced_sql(source: str = "deduped") -> str:
    """A CTE `priced`: every row of `source` priced by itself."""
    share = lambda c: f"least(greatest(0, lc_{c}), {c})"
    cached = lambda t: f"{t('cached')} * r_cached_read + {t('cache_w5m')} * r_cache_w5m + {t('cache_w1h')} * r_cache_w1h"
    plain = lambda c: f"CAST({c} AS DOUBLE)"
    premium = lambda base, m: f"CASE WHEN r_lc_threshold IS NOT NULL THEN ({base}) * greatest(0.0, {m} - 1) ELSE 0 END"
    return f"""
quoted AS (SELECT l.*, c.r_model IS NOT NULL AS priced,
  (CAST(input AS DOUBLE) * r_input + {premium(share("input") + " * r_input", "r_lc_input_multiplier")}) / 1e6 AS usd_uncached,
  ({cached(plain)} + {premium(cached(share), "r_lc_input_multiplier")}) / 1e6 AS usd_cached,
  (CAST(output AS DOUBLE) * r_output + {premium(share("output") + " * r_output", "r_lc_output_multiplier")}) / 1e6 AS usd_output,
  (input * r_credit_input + cached * r_credit_cached + output * r_credit_output) / 1e6 AS credits,
  CASE WHEN ts >= TIMESTAMP '{CHANGE}' THEN TIMESTAMP '{CHANGE}' END AS period,
  input + cached + cache_w5m + cache_w1h + output AS total
  FROM {source} l LEFT JOIN card c ON l.provider = c.r_provider AND l.model = c.r_model
  AND (c.r_valid_from IS NULL OR l.ts >= c.r_valid_from) AND (c.r_valid_to IS NULL OR l.ts < c.r_valid_to)),
priced AS (SELECT *, usd_uncached + usd_cached + usd_output AS usd FROM quoted)"""


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as cumulative snapshots a user: totals that also fall, repeat and stand still."""
    k = F.get_json_object("props", "$.k").cast("long")
    n = F.floor(F.col("value") * 100).cast("long")
    grown = F.col("event_id") * 3
    tot = {"input": n + grown, "cached": F.least(n, k * 20) + F.col("event_id"), "cache_w5m": k * 0, "cache_w1h": k * 0, "output": k * 30 + grown, "reasoning": k}
    stated = F.pmod("event_id", F.lit(3)) == 0
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("path"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.pmod("event_id", F.lit(6)) == 0, F.col("event_type")).alias("model"),
        *[x.cast("long").alias(f"tot_{c}") for c, x in tot.items()],
        *[F.when(stated, F.pmod(x, F.lit(997))).cast("long").alias(f"last_{c}") for c, x in tot.items()],
    )


def _counters_sql() -> str:
    tot = {"input": "floor(value * 100) + event_id * 3", "cached": "least(floor(value * 100), k * 20) + event_id", "cache_w5m": "0", "cache_w1h": "0", "output": "k * 30 + event_id * 3", "reasoning": "k"}
    cast = {c: f"CAST({x} AS BIGINT)" for c, x in tot.items()}
    tots = ", ".join(f"{x} AS tot_{c}" for c, x in cast.items())
    lasts = ", ".join(f"CASE WHEN event_id % 3 = 0 THEN ({x}) % 997 END AS last_{c}" for c, x in cast.items())
    water = ", ".join(f"max(tot_{c}) OVER before AS hw_{c}" for c in COUNTERS)
    limit = {c: f"CASE WHEN hw_input IS NULL THEN tot_{c} ELSE greatest(0, tot_{c} - hw_{c}) END" for c in COUNTERS}
    pref = {c: f"least(greatest(0, coalesce(last_{c}, 0)), lim_{c})" for c in COUNTERS}
    key = ", ".join(f"tot_{c}, last_{c}" for c in COUNTERS)
    return f"""
raw AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS seq, ts, CASE WHEN event_id % 6 = 0 THEN event_type END AS model, {tots}, {lasts}
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
watered AS (SELECT *, {water} FROM raw WINDOW before AS (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
limited AS (SELECT *, {", ".join(f"{x} AS lim_{c}" for c, x in limit.items())},
  hw_input IS NULL OR {" OR ".join(f"tot_{c} > hw_{c}" for c in COUNTERS)} AS accepted,
  coalesce({" OR ".join(f"tot_{c} < hw_{c}" for c in COUNTERS)}, false) AS decreased FROM watered),
fenced AS (SELECT *, {", ".join(f"{x} AS pre_{c}" for c, x in pref.items())} FROM limited),
chosen AS (SELECT *, ({" OR ".join(f"coalesce(last_{c}, 0) > 0" for c in COUNTERS)}) AND ({" OR ".join(f"pre_{c} > 0" for c in COUNTERS)}) AS explicit FROM fenced),
used AS (SELECT *, {", ".join(f"CASE WHEN explicit THEN pre_{c} ELSE lim_{c} END AS use_{c}" for c in COUNTERS)},
  last_value(CASE WHEN accepted THEN row({key}) END IGNORE NULLS) OVER before AS known, row({key}) AS own FROM chosen
  WINDOW before AS (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
classified AS (SELECT * EXCLUDE (known, own), CASE WHEN accepted THEN 'accepted' WHEN own IS NOT DISTINCT FROM known THEN 'duplicate' ELSE 'stale' END AS status FROM used)"""


COUNTERS_SQL = _counters_sql()


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as task starts of forked transcripts: the customer is the file, the order's key the
    offset; the order's day is compared with the day in the middle."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("path"),
        F.col("o_orderkey").alias("byte_offset"),
        F.when(F.pmod("o_orderkey", F.lit(29)) != 0, F.pmod("o_orderkey", F.lit(1000))).alias("started_at"),
        F.lit(None).cast("string").alias("turn_id"),
        F.pmod("o_custkey", F.lit(1000)).alias("created"),
        F.lit(None).cast("string").alias("header_id"),
    )


TASKS_SQL = """
tasks AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS byte_offset,
  CASE WHEN o_orderkey % 29 = 0 THEN 'ambiguous' WHEN o_orderkey % 1000 > o_custkey % 1000 THEN 'own' ELSE 'copied' END AS ownership FROM orders),
sums AS (SELECT path, min(CASE WHEN ownership = 'own' THEN byte_offset END) AS own, max(CASE WHEN ownership = 'copied' THEN byte_offset END) AS copied,
  max(CASE WHEN ownership = 'ambiguous' THEN byte_offset END) AS odd FROM tasks GROUP BY path),
bounds AS (SELECT path, CASE WHEN odd IS NOT NULL OR coalesce(copied > own, false) THEN 'ambiguous' WHEN own IS NULL THEN 'none' ELSE 'found' END AS boundary,
  CASE WHEN odd IS NULL AND NOT coalesce(copied > own, false) THEN own END AS own_start FROM sums)"""


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Account candidates of sessions, one an order (telemetry for odd ones): the customer's own
    account, or for every third customer the order's priority, so that these conflict."""
    account = F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("acct-"), F.pmod("o_custkey", F.lit(11)).cast("string")))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(":2024-01-01")).alias("session_id"), account.alias("account_id"), "o_orderkey", "o_custkey")
    return rows.where("o_orderkey % 2 = 1"), rows.where("o_orderkey % 2 = 0")


ACCOUNTS_SQL = """
cand AS (SELECT o_custkey || ':2024-01-01' AS session_id, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE 'acct-' || (o_custkey % 11) END AS account_id, o_orderkey % 2 = 1 AS t FROM orders),
accounts AS (SELECT session_id, CASE WHEN min(account_id) = max(account_id) THEN min(account_id) ELSE 'ambiguous' END AS account_id,
  CASE WHEN min(account_id) = max(account_id) THEN 'session-verified' ELSE 'ambiguous-account' END AS confidence,
  CASE WHEN min(account_id) <> max(account_id) THEN 'account-conflict' WHEN bool_or(t) THEN 'telemetry' ELSE 'support-session' END AS basis FROM cand GROUP BY session_id)"""
