"""The registered queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions import usage as U
from ..functions import value as V
from ..operators import attribution as A
from ..operators import changes as K
from ..operators import counter as C
from ..operators import dedup as D
from ..operators import pricing as P
from ..operators import summary as S
from ..schema import COUNTERS, COUNTS
from . import views as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = datetime(2024, 1, 20, 13, 45)
_NOW = f"TIMESTAMP '{NOW}'"
L = f"WITH {W.LEDGER_SQL}"
LP = f"WITH {W.LEDGER_SQL}, {W.CARD_SQL}, {W.priced_sql()}"
CT = f"WITH {W.COUNTERS_SQL}"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def money(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 10) for c, t in df.dtypes if t == "double"})


def deduped(spark: SparkSession, sf: str) -> DataFrame:
    return D.dedup_messages(W.ledger(spark, sf))


def _sum(c: str, alias: str | None = None) -> str:
    return f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {alias or c}"


_COUNTS = ", ".join(_sum(c) for c in COUNTERS)
_MONEY = ", ".join(f"round(coalesce(sum({c}), 0), 10) AS {c}" for c in P.MONEY)
_ALL = f"{_sum('event_count', 'events')}, {_COUNTS}, {_sum('total', 'tokens')}, {_MONEY}, {_sum('CASE WHEN priced THEN 0 ELSE event_count END', 'unpriced')}"


def grouped_sql(keys: str, source: str = "priced") -> str:
    return f"{LP} SELECT {keys}, {_ALL} FROM {source} GROUP BY ALL"


# dedup and filters


@query(f"{L} SELECT id, message_id, provider, source_id, is_subagent, input, output FROM deduped")
def dedup_latest_message(spark, sf):
    return deduped(spark, sf).select("id", "message_id", "provider", "source_id", "is_subagent", "input", "output")


@query(f"{L} SELECT id, session_id, input FROM deduped WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def dedup_then_window(spark, sf):
    held = R.Bounds(F.lit(datetime(2024, 1, 10)), F.lit(datetime(2024, 1, 20)), moving=False).holds(F.col("ts"))
    return deduped(spark, sf).where(held).select("id", "session_id", "input")


@query(f"{L} SELECT message_id, count(DISTINCT source_id) AS sources, count(*) AS copies FROM (SELECT DISTINCT message_id, is_subagent, CASE WHEN byte_offset % 200 = 0 THEN 'source-x' ELSE source_id END AS source_id FROM ledger WHERE provider = 'message') GROUP BY message_id")
def dedup_source_isolation(spark, sf):
    rows = W.ledger(spark, sf).where("provider = 'message'").withColumn("source_id", F.when(F.col("byte_offset") % 200 == 0, "source-x").otherwise(F.col("source_id")))
    return D.dedup_messages(rows).groupBy("message_id").agg(F.count_distinct("source_id").alias("sources"), F.count(F.lit(1)).alias("copies"))


@query(f"{L} SELECT source_path, session_id, is_subagent, message_id, max(byte_offset) AS byte_offset FROM ledger GROUP BY ALL")
def dedup_in_file(spark, sf):
    return D.dedup_file(W.ledger(spark, sf)).select("source_path", "session_id", "is_subagent", "message_id", "byte_offset")


@query(f"{L} SELECT source_id, message_id, is_subagent, max(byte_offset) AS byte_offset FROM ledger GROUP BY ALL")
def dedup_direct_scan(spark, sf):
    return D.dedup_scan(W.ledger(spark, sf)).select("source_id", "message_id", "is_subagent", "byte_offset")


@query(f"{L} SELECT source_id, session_id, model, is_subagent, strftime(hr, '%Y-%m-%d %H:%M:%S.%f') AS at, event_count, {', '.join(COUNTS)} FROM (SELECT {', '.join(D.ROLLUP_KEYS)}, date_trunc('hour', ts) AS hr, {_sum('event_count')}, {', '.join(_sum(c) for c in COUNTS)} FROM ledger GROUP BY ALL)")
def rollup_instant(spark, sf):
    rows = W.ledger(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return D.rollup_instant(rows).select("source_id", "session_id", "model", "is_subagent", stamp("ts").alias("at"), "event_count", *COUNTS)


# priced summaries


@query(grouped_sql("provider, model"))
def cost_by_model(spark, sf):
    return money(S.by_model(deduped(spark, sf), W.rate_card(spark)))


@query(grouped_sql(", ".join(S.ACCOUNT_KEYS)))
def cost_by_account(spark, sf):
    return money(S.by_account(deduped(spark, sf), W.rate_card(spark)))


@query(grouped_sql("strftime(ts, '%Y-%m-%d') AS day"))
def cost_by_day(spark, sf):
    return money(S.by_day(deduped(spark, sf), W.rate_card(spark), "UTC")).withColumn("day", F.col("day").cast("string"))


@query(grouped_sql("provider"))
def cost_by_provider(spark, sf):
    return money(S.by_provider(deduped(spark, sf), W.rate_card(spark)))


@query(grouped_sql("provider, source_id, session_id, parent_session_id", "(SELECT * FROM priced WHERE is_subagent)"))
def cost_by_subagent(spark, sf):
    return money(S.by_subagent(deduped(spark, sf), W.rate_card(spark)))


@query(grouped_sql("strftime(period, '%Y-%m-%d') AS period"))
def cost_by_period(spark, sf):
    return money(S.by_period(deduped(spark, sf), W.rate_card(spark))).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


_SESSIONS = "count(DISTINCT (provider, source_id, session_id)) AS sessions"


@query(f"{L} SELECT {_sum('event_count', 'events')}, {_sum('CASE WHEN is_subagent THEN event_count ELSE 0 END', 'subagent_events')}, {_SESSIONS}, {_COUNTS} FROM deduped")
def overview_totals(spark, sf):
    return S.overview(deduped(spark, sf))


@query(f"{LP} SELECT {_ALL} FROM priced")
def headline_totals(spark, sf):
    return money(S.totals(deduped(spark, sf), W.rate_card(spark)))


@query(f"{L} SELECT {_SESSIONS} FROM deduped")
def session_count(spark, sf):
    return S.session_count(deduped(spark, sf))


@query(f"{L} SELECT attribution_confidence, {_sum('event_count', 'events')} FROM deduped GROUP BY ALL")
def attribution_counts(spark, sf):
    return S.attribution_counts(deduped(spark, sf))


@query(f"{L} SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS earliest FROM ledger")
def earliest_event(spark, sf):
    return S.earliest(W.ledger(spark, sf)).select(stamp("earliest").alias("earliest"))


@query(f"{LP} SELECT provider, model, {_sum('event_count', 'events')} FROM priced WHERE NOT priced GROUP BY ALL")
def unpriced_models(spark, sf):
    return P.unpriced(deduped(spark, sf), W.rate_card(spark)).withColumn("events", F.col("events").cast("long"))


@query(f"{LP} SELECT provider, {_sum('event_count', 'events')}, {_sum('total', 'tokens')}, {_MONEY}, {_sum('CASE WHEN priced THEN 0 ELSE event_count END', 'unpriced')} FROM priced GROUP BY ALL")
def compact_summary(spark, sf):
    return money(S.compact(deduped(spark, sf), W.rate_card(spark)))


def _both_sides(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], names: tuple[str, str]) -> DataFrame:
    """Whether two summaries agree, beside what each of them says."""
    out = S.reconcile(a, b, keys, columns)
    for side, name in zip((a, b), names):
        out = out.join(side.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("tokens", "usd")]), keys, "left")
    return money(out)


def _both_sql(keys: str, names: tuple[str, str]) -> str:
    said = ", ".join(f"{_sum('total', f'{n}_tokens')}, round(coalesce(sum(usd), 0), 10) AS {n}_usd" for n in names)
    return f"{LP} SELECT {keys}, true AS agrees, {said} FROM priced GROUP BY {keys}"


@query(_both_sql("provider", ("compact", "whole")))
def full_vs_compact_reconcile(spark, sf):
    rows, card = deduped(spark, sf), W.rate_card(spark)
    full = S.regroup(S.fine(rows, card, [*S.ACCOUNT_KEYS, "session_id"]), ["provider"])
    return _both_sides(S.compact(rows, card), full, ["provider"], ["usd_uncached", "usd_cached", "usd_output", "credits", "tokens"], ("compact", "whole"))


@query(_both_sql("provider, model", ("direct", "indexed")))
def direct_vs_indexed_reconcile(spark, sf):
    rows, card = deduped(spark, sf), W.rate_card(spark)
    return _both_sides(S.direct(rows, card, ["provider", "model"]), S.by_model(rows, card), ["provider", "model"], ["usd", "credits", "tokens"], ("direct", "indexed"))


_TOP = "SELECT provider, source_id, session_id, parent_session_id, CAST(sum(input + cached + cache_w5m + cache_w1h + output) AS BIGINT) AS tokens FROM deduped WHERE is_subagent GROUP BY ALL ORDER BY tokens DESC, provider, source_id, session_id, parent_session_id NULLS FIRST LIMIT 20"


@query(f"{L} {_TOP}")
def topk_subagents(spark, sf):
    return S.top_subagents(deduped(spark, sf), 20)


@query(f"{L}, top AS ({_TOP}) SELECT d.id, d.input FROM deduped d JOIN top t ON d.provider = t.provider AND d.source_id = t.source_id AND d.session_id = t.session_id AND d.parent_session_id IS NOT DISTINCT FROM t.parent_session_id WHERE d.is_subagent")
def topk_detail_nullsafe(spark, sf):
    return S.top_detail(deduped(spark, sf), 20).select("id", "input")


@query(f"{LP}, named AS (SELECT DISTINCT model FROM priced) SELECT model, row_number() OVER (ORDER BY lpad(regexp_extract(model || length(model), '[0-9]+'), 20, '0'), model) AS place FROM named")
def natural_order(spark, sf):
    named = deduped(spark, sf).select("model").distinct().withColumn("shown", F.concat(F.length("model").cast("string"), F.lit(" "), F.col("model")))
    from pyspark.sql import Window

    return named.select("model", F.row_number().over(Window.orderBy(U.natural_key(F.col("shown")), "model")).cast("long").alias("place"))


# pricing


@query(f"{LP} SELECT id, round(usd, 10) AS usd, abs(round(usd - (input * r + cached * cr + cache_w5m * r5 + cache_w1h * r1 + output * o) / 1e6, 10)) AS premium FROM (SELECT p.*, c.r_input AS r, c.r_cached_read AS cr, c.r_cache_w5m AS r5, c.r_cache_w1h AS r1, c.r_output AS o FROM priced p JOIN card c ON p.provider = c.r_provider AND p.model = c.r_model AND (c.r_valid_from IS NULL OR p.ts >= c.r_valid_from) AND (c.r_valid_to IS NULL OR p.ts < c.r_valid_to)) WHERE lc_input > 0")
def long_context_premium(spark, sf):
    rows, card = deduped(spark, sf).where("lc_input > 0"), W.rate_card(spark)
    plain = P.quote(rows.withColumns({f"lc_{c}": F.lit(0).cast("long") for c in COUNTERS}), card).select("id", F.col("usd").alias("plain"))
    return P.quote(rows, card).where("priced").join(plain, "id").select("id", F.round("usd", 10).alias("usd"), F.abs(F.round(F.col("usd") - F.col("plain"), 10)).alias("premium"))


@query(f"{LP} SELECT id, round(credits, 10) AS credits FROM priced WHERE credits IS NOT NULL")
def credit_cost(spark, sf):
    return P.quote(deduped(spark, sf), W.rate_card(spark)).where("credits is not null").select("id", F.round("credits", 10).alias("credits"))


@query(f"{LP} SELECT id, round(usd_uncached, 10) AS usd_uncached, round(usd_cached, 10) AS usd_cached, round(usd_output, 10) AS usd_output FROM priced WHERE priced")
def cost_buckets(spark, sf):
    return P.quote(deduped(spark, sf), W.rate_card(spark)).where("priced").select("id", *[F.round(c, 10).alias(c) for c in ("usd_uncached", "usd_cached", "usd_output")])


@query(f"{LP}, u AS (SELECT provider, coalesce(sum(usd), 0) AS usd FROM priced GROUP BY provider) SELECT provider, round(usd * CASE provider WHEN 'counter' THEN 0.4 ELSE 0.45 END, 6) AS low, round(usd * CASE provider WHEN 'counter' THEN 0.45 ELSE 0.525 END, 6) AS middle, round(usd * CASE provider WHEN 'counter' THEN 0.5 ELSE 0.6 END, 6) AS high FROM u")
def serving_cost_band(spark, sf):
    low, middle, high = P.serving_cost(F.col("usd"), F.col("provider"))
    rows = S.by_provider(deduped(spark, sf), W.rate_card(spark))
    return rows.select("provider", F.round(low, 6).alias("low"), F.round(middle, 6).alias("middle"), F.round(high, 6).alias("high"))


@query("""WITH m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Click' WHEN 1 THEN 'view-20250101[x]' WHEN 2 THEN 'purchase-2025-01-01' WHEN 3 THEN 'view-2' ELSE 'codex-auto-review' END AS model FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'view-2' ELSE 'gpt-5.3-codex' END AS canonical FROM m""")
def canonical_model(spark, sf):
    shown = F.element_at(F.array(*map(F.lit, ["Click", "view-20250101[x]", "purchase-2025-01-01", "view-2", "codex-auto-review"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return W.table(spark, sf, "part").select("p_partkey", P.canonical_model(shown, P.card_models(W.rate_card(spark))).alias("canonical"))


@query(f"{LP} SELECT provider, model, {_sum('total', 'tokens')}, 0.0::DOUBLE AS usd FROM priced GROUP BY ALL")
def withhold_provisional(spark, sf):
    return P.withhold_provisional(S.by_model(deduped(spark, sf), W.rate_card(spark)), F.lit(True)).select("provider", "model", "tokens", "usd")


# counters


@query(f"{CT} SELECT path, seq, {', '.join(f'CAST(use_{c} AS BIGINT) AS use_{c}' for c in COUNTERS)} FROM classified WHERE accepted AND ({' OR '.join(f'use_{c} > 0' for c in COUNTERS)})")
def counter_deltas(spark, sf):
    return C.requests(C.classify(W.counters(spark, sf), ["seq"])).select("path", "seq", *[f"use_{c}" for c in COUNTERS])


@query(f"{CT} SELECT path, seq, CAST(use_input AS BIGINT) AS use_input, CAST(use_output AS BIGINT) AS use_output FROM classified WHERE accepted AND explicit")
def counter_fenced_last(spark, sf):
    return C.classify(W.counters(spark, sf), ["seq"]).where("accepted and explicit").select("path", "seq", "use_input", "use_output")


@query(f"{CT} SELECT path, seq, status, decreased FROM classified")
def counter_classify(spark, sf):
    return C.classify(W.counters(spark, sf), ["seq"]).select("path", "seq", "status", "decreased")


_STRUCT = ", ".join(f"tot_{c}" for c in COUNTERS)
_MOST = ", ".join(f"max(tot_{c})" for c in COUNTERS)


@query(f"{CT} SELECT path, CAST(sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN status = 'stale' THEN 1 ELSE 0 END) AS BIGINT) AS stale, CAST(bool_or(decreased) AND arg_max(row({_STRUCT}), seq) IS DISTINCT FROM row({_MOST}) AS BIGINT) AS ambiguous_resets FROM classified GROUP BY path")
def counter_reset_files(spark, sf):
    return C.diagnostics(C.classify(W.counters(spark, sf), ["seq"]), ["seq"])


@query(f"{CT}, d AS (SELECT path, sum(CASE WHEN status = 'duplicate' THEN 1 ELSE 0 END) AS duplicates, sum(CASE WHEN status = 'stale' THEN 1 ELSE 0 END) AS stale, CAST(bool_or(decreased) AND arg_max(row({_STRUCT}), seq) IS DISTINCT FROM row({_MOST}) AS BIGINT) AS ambiguous_resets FROM classified GROUP BY path) SELECT {_sum('duplicates')}, {_sum('stale')}, {_sum('ambiguous_resets')}, sum(duplicates) > 0 AS has_duplicates, sum(stale) > 0 AS has_stale, sum(ambiguous_resets) > 0 AS has_ambiguous_resets FROM d")
def diagnostics_total(spark, sf):
    return S.diagnostics_total(C.diagnostics(C.classify(W.counters(spark, sf), ["seq"]), ["seq"]))


@query(f"{CT} SELECT path, seq, coalesce(last_value(model IGNORE NULLS) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS active_model FROM raw")
def active_model_ffill(spark, sf):
    return C.active_model(W.counters(spark, sf), ["seq"]).select("path", "seq", "active_model")


@query(f"{CT}, m AS (SELECT path, seq, coalesce(last_value(model IGNORE NULLS) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS model FROM raw) SELECT path, seq, CAST(CASE WHEN explicit AND use_input > t.limit_ THEN greatest(0, use_input - use_cached) ELSE 0 END AS BIGINT) AS lc_input FROM classified JOIN m USING (path, seq) LEFT JOIN (VALUES ('click', 300), ('view', 500)) t(model, limit_) ON m.model = t.model WHERE accepted AND ({' OR '.join(f'use_{c} > 0' for c in COUNTERS)})".replace("FROM classified JOIN", "FROM (SELECT * EXCLUDE (model) FROM classified) JOIN"))
def long_context_flag(spark, sf):
    rows = C.active_model(W.counters(spark, sf), ["seq"])
    limits = spark.createDataFrame([("click", 300), ("view", 500)], "model string, lc_threshold bigint")
    return C.long_context(C.requests(C.classify(rows, ["seq"])), limits).select("path", "seq", "lc_input")


@query("SELECT o_orderkey, greatest(0, o_custkey - o_orderkey) AS uncached FROM orders")
def normalize_counter(spark, sf):
    return W.table(spark, sf, "orders").select("o_orderkey", U.uncached_input(F.col("o_custkey"), F.col("o_orderkey")).alias("uncached"))


@query(f"{L} SELECT id, CAST(cache_w5m + CASE WHEN cache_w5m = 0 AND cache_w1h = 0 THEN cached ELSE 0 END AS BIGINT) AS w5m, input + cached + cache_w5m + cache_w1h AS context, input + cached + cache_w5m + cache_w1h + output AS total FROM ledger WHERE input + cached + cache_w5m + cache_w1h + output > 0")
def normalize_message(spark, sf):
    rows = W.ledger(spark, sf).where(U.total_tokens() > 0)
    return rows.select("id", U.five_minute_writes(F.col("cache_w5m"), F.col("cache_w1h"), F.col("cached")).cast("long").alias("w5m"), U.context_tokens().alias("context"), U.total_tokens().alias("total"))


@query(f"WITH {W.TASKS_SQL} SELECT * FROM bounds")
def fork_boundary(spark, sf):
    own = W.tasks(spark, sf).withColumn("ownership", C.task_ownership(F.col("started_at"), F.col("turn_id"), F.col("created"), F.col("header_id")))
    return C.fork_boundary(own)


@query(f"WITH {W.TASKS_SQL}, forked AS (SELECT CAST(c_custkey AS VARCHAR) AS path FROM customer WHERE c_custkey % 2 = 0) SELECT l.path, l.byte_offset, f.path IS NOT NULL AS forked FROM tasks l LEFT JOIN forked f ON l.path = f.path LEFT JOIN bounds b ON l.path = b.path WHERE f.path IS NULL OR (b.boundary = 'found' AND l.byte_offset >= b.own_start)")
def exclude_inherited(spark, sf):
    own = W.tasks(spark, sf).withColumn("ownership", C.task_ownership(F.col("started_at"), F.col("turn_id"), F.col("created"), F.col("header_id")))
    forked = W.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("path"))
    return C.exclude_inherited(own.select("path", "byte_offset"), forked, C.fork_boundary(own))


# attribution


@query(f"WITH {W.ACCOUNTS_SQL} SELECT * FROM accounts")
def account_attribution(spark, sf):
    return A.session_accounts(*W.candidates(spark, sf))


_CONF = "CASE WHEN conf = 'ambiguous-account' THEN 'ambiguous-account' WHEN is_subagent AND session_id = base THEN 'ambiguous-sidechain' WHEN is_subagent THEN 'parent-session' ELSE conf END"
_BASIS = "CASE WHEN conf = 'ambiguous-account' THEN 'account-conflict' WHEN is_subagent THEN 'parent-session' ELSE bas END"


@query(f"{L}, {W.ACCOUNTS_SQL}, j AS (SELECT l.id, l.session_id, l.is_subagent, coalesce(l.parent_session_id, l.session_id) AS base, coalesce(a.account_id, 'unattributed') AS account_id, coalesce(a.confidence, 'source-only') AS conf, coalesce(a.basis, 'none') AS bas FROM ledger l LEFT JOIN accounts a ON coalesce(l.parent_session_id, l.session_id) = a.session_id WHERE l.provider = 'message') SELECT id, account_id, {_CONF} AS attribution_confidence, {_BASIS} AS attribution_basis FROM j")
def sidechain_attribution(spark, sf):
    rows = W.ledger(spark, sf).where("provider = 'message'")
    return A.attribute_accounts(rows, A.session_accounts(*W.candidates(spark, sf))).select("id", "account_id", "attribution_confidence", "attribution_basis")


@query(f"{L}, {W.ACCOUNTS_SQL}, j AS (SELECT l.*, coalesce(l.parent_session_id, l.session_id) AS base, a.account_id AS acc, a.confidence AS c0, a.basis AS b0, l.attribution_confidence = 'session-verified' AS keeps FROM ledger l LEFT JOIN accounts a ON coalesce(l.parent_session_id, l.session_id) = a.session_id), k AS (SELECT *, coalesce(c0, CASE WHEN keeps THEN attribution_confidence ELSE 'source-only' END) AS conf, coalesce(b0, CASE WHEN keeps THEN attribution_basis ELSE 'none' END) AS bas FROM j) SELECT id, CASE WHEN provider = 'message' THEN coalesce(acc, CASE WHEN keeps THEN account_id ELSE 'unattributed' END) ELSE account_id END AS account_id, CASE WHEN provider = 'message' THEN {_CONF} ELSE attribution_confidence END AS attribution_confidence, CASE WHEN provider = 'message' THEN {_BASIS} ELSE attribution_basis END AS attribution_basis FROM k")
def reattribute_delta(spark, sf):
    return A.reattribute(W.ledger(spark, sf), A.session_accounts(*W.candidates(spark, sf))).select("id", "account_id", "attribution_confidence", "attribution_basis")


@query(f"{L}, t AS (SELECT '/log/' || c_custkey || '.jsonl' AS path, c_name AS tid, CAST(c_nationkey AS VARCHAR) AS parent, c_custkey % 3 = 0 AS child, c_mktsegment AS tmodel FROM customer) SELECT id, CASE WHEN provider = 'counter' THEN coalesce(tid, session_id) ELSE session_id END AS session_id, CASE WHEN provider = 'counter' AND path IS NOT NULL THEN parent ELSE parent_session_id END AS parent_session_id, CASE WHEN provider = 'counter' AND path IS NOT NULL THEN child ELSE is_subagent END AS is_subagent, CASE WHEN provider = 'counter' AND model = 'unknown' THEN coalesce(tmodel, model) ELSE model END AS model FROM (SELECT * REPLACE (CASE WHEN model = 'error' THEN 'unknown' ELSE model END AS model) FROM ledger) LEFT JOIN t ON source_path = path")
def thread_enrichment(spark, sf):
    threads = W.table(spark, sf, "customer").select(F.concat(F.lit("/log/"), F.col("c_custkey").cast("string"), F.lit(".jsonl")).alias("path"), F.col("c_name").alias("id"), F.col("c_mktsegment").alias("model"), F.col("c_nationkey").cast("string").alias("parent_id"), (F.col("c_custkey") % 3 == 0).alias("is_subagent"))
    rows = W.ledger(spark, sf).withColumn("model", F.when(F.col("model") == "error", "unknown").otherwise(F.col("model")))
    return A.enrich_threads(rows, threads).select("id", "session_id", "parent_session_id", "is_subagent", "model")


@query(f"{L}, s AS (SELECT DISTINCT session_id AS s FROM ledger) SELECT DISTINCT l.session_id, parent_session_id, s.s IS NOT NULL AS parent_known FROM ledger l LEFT JOIN s ON l.parent_session_id = s.s WHERE parent_session_id IS NOT NULL")
def session_tree(spark, sf):
    return A.session_tree(W.ledger(spark, sf))


# ranges and values


def _in_range(spark, sf, bounds: R.Bounds) -> DataFrame:
    rows = deduped(spark, sf)
    return S.overview(rows.where(bounds.clipped(F.lit(NOW)).holds(F.col("ts")))).select("events", "sessions", "input", "output")


def _range_sql(where: str) -> str:
    return f"{L} SELECT {_sum('event_count', 'events')}, {_SESSIONS}, {_sum('input')}, {_sum('output')} FROM deduped WHERE {where}"


@query(_range_sql(f"ts >= {_NOW} - INTERVAL 24 HOUR AND ts < {_NOW}"))
def range_last_24h(spark, sf):
    return _in_range(spark, sf, R.last_hours(F.lit(NOW), 24))


@query(_range_sql(f"ts >= {_NOW} - INTERVAL 168 HOUR AND ts < {_NOW}"))
def range_last_days(spark, sf):
    return _in_range(spark, sf, R.last_days(F.lit(NOW), 7))


@query(_range_sql(f"ts >= TIMESTAMP '2024-01-20' AND ts < {_NOW}"))
def range_current_day(spark, sf):
    return _in_range(spark, sf, R.current_day(F.lit(NOW), "UTC"))


@query(_range_sql(f"ts >= TIMESTAMP '2024-01-18' AND ts < {_NOW}"))
def range_week_cycle(spark, sf):
    return _in_range(spark, sf, R.current_week(F.lit(NOW), "UTC", 5))


@query(_range_sql(f"ts >= TIMESTAMP '2024-01-12' AND ts < {_NOW}"))
def range_month_cycle(spark, sf):
    return _in_range(spark, sf, R.current_month(F.lit(NOW), "UTC", 12))


@query(_range_sql(f"ts >= TIMESTAMP '2024-01-01' AND ts < {_NOW}"))
def range_ytd(spark, sf):
    return _in_range(spark, sf, R.year_to_date(F.lit(NOW), "UTC"))


@query(_range_sql("ts >= TIMESTAMP '2024-01-05 05:00:00' AND ts < TIMESTAMP '2024-01-13 05:00:00'"))
def range_custom(spark, sf):
    return _in_range(spark, sf, R.custom(F.lit("2024-01-12").cast("date"), F.lit("2024-01-05").cast("date"), "America/New_York"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey % 31 + 1 AS INTEGER) AS s FROM orders),
h AS (SELECT *, make_date(year(d), month(d), least(day(last_day(d)), s)) AS here, make_date(year(d - INTERVAL 1 MONTH), month(d - INTERVAL 1 MONTH), least(day(last_day(d - INTERVAL 1 MONTH)), s)) AS before, make_date(year(d + INTERVAL 1 MONTH), month(d + INTERVAL 1 MONTH), least(day(last_day(d + INTERVAL 1 MONTH)), s)) AS after FROM d)
SELECT o_orderkey, strftime(CASE WHEN d >= here THEN here ELSE before END, '%Y-%m-%d') AS first, strftime(CASE WHEN d >= here THEN after ELSE here END, '%Y-%m-%d') AS following FROM h""")
def billing_cycles(spark, sf):
    first, following = R.cycle(F.to_date("o_orderdate"), (F.col("o_custkey") % 31 + 1).cast("int"))
    return W.table(spark, sf, "orders").select("o_orderkey", first.cast("string").alias("first"), following.cast("string").alias("following"))


@query(f"{LP}, u AS (SELECT account_id, sum(usd) AS usd, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM priced GROUP BY account_id), c AS (SELECT *, 30.0 * greatest(1, abs(b - a) + 1) / 30 AS cost FROM u) SELECT account_id, round(cost, 4) AS cost, round(usd / cost, 6) AS multiple FROM c")
def prorated_value(spark, sf):
    rows = P.quote(deduped(spark, sf), W.rate_card(spark)).groupBy("account_id").agg(F.sum("usd").alias("usd"), F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    cost = V.prorated_cost(F.lit(30.0), F.col("a"), F.col("b"))
    return rows.select("account_id", F.round(cost, 4).alias("cost"), F.round(V.value_multiple(F.col("usd"), cost), 6).alias("multiple"))


@query(f"{LP} SELECT provider, round(sum(usd) / (CASE provider WHEN 'counter' THEN 20.0 / 7 ELSE 100.0 / (365.25 / 12) END * 8), 6) AS multiple FROM priced WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13' GROUP BY provider")
def range_multiple(spark, sf):
    a, b = F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date")
    rows = deduped(spark, sf).where(R.custom(a, b, "UTC").holds(F.col("ts")))
    counter = F.col("provider") == "counter"
    per_day = V.daily_spend(F.when(counter, 20.0).otherwise(100.0), F.when(counter, "weekly").otherwise("monthly"))
    multiple = V.range_multiple(F.col("usd"), per_day, R.range_days("custom", b, first=a, last=b))
    return S.by_provider(rows, W.rate_card(spark)).select("provider", F.round(multiple, 6).alias("multiple"))


@query(f"SELECT o_orderkey, CAST({' + '.join(f'CAST(o_totalprice / 2000 >= {t} AS INTEGER)' for t in V.TIERS)} AS INTEGER) AS tier FROM orders")
def value_tier(spark, sf):
    return W.table(spark, sf, "orders").select("o_orderkey", V.tier(F.col("o_totalprice") / 2000).cast("int").alias("tier"))


@query(f"{LP}, d AS (SELECT CAST(ts AS DATE) AS d, sum(usd) AS usd FROM priced GROUP BY 1), c AS (SELECT d, CAST(floor(round(sum(usd) OVER (ORDER BY d), 6) * 100 / 100) AS BIGINT) AS reached FROM d) SELECT strftime(d, '%Y-%m-%d') AS day, reached, reached > coalesce(lag(reached) OVER (ORDER BY d), 0) AS crossed FROM c")
def milestone_days(spark, sf):
    from pyspark.sql import Window

    days = S.by_day(deduped(spark, sf), W.rate_card(spark), "UTC")  # a row a day
    reached = V.milestone(F.round(F.sum("usd").over(Window.orderBy("day")), 6) * 100)
    steps = days.select("day", reached.alias("reached"))
    crossed = F.col("reached") > F.coalesce(F.lag("reached").over(Window.orderBy("day")), F.lit(0))
    return steps.select(F.col("day").cast("string").alias("day"), "reached", crossed.alias("crossed"))


# changes


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two loads of the ledger that share a third of the ids, with other numbers in the second."""
    rows = W.ledger(spark, sf)
    n = F.floor(F.col("byte_offset") / 100)
    second = rows.where(n % 3 != 0).withColumns({"input": F.col("input") + 1, "ts": F.when(n % 2 == 0, F.col("ts") - F.expr("interval 1 hour")).otherwise(F.col("ts"))})
    return rows.where(n % 3 != 1), second


_HALVES = f"{L}, numbered AS (SELECT *, byte_offset // 100 AS n FROM ledger), a AS (SELECT * EXCLUDE (n) FROM numbered WHERE n % 3 <> 1), b AS (SELECT * EXCLUDE (n) REPLACE (input + 1 AS input, CASE WHEN n % 2 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END AS ts) FROM numbered WHERE n % 3 <> 0)"


@query(f"{_HALVES} SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL OR b.ts >= a.ts THEN b.input ELSE a.input END AS input FROM a FULL JOIN b ON a.id = b.id")
def upsert_latest(spark, sf):
    return K.upsert_latest(*_halves(spark, sf)).select("id", "input")


@query(f"{_HALVES} SELECT id, {_sum('event_count')}, {_sum('input')}, {_sum('output')} FROM (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b) GROUP BY id")
def upsert_accumulate(spark, sf):
    return K.upsert_accumulate(*_halves(spark, sf)).select("id", "event_count", "input", "output")


@query(f"{_HALVES}, f AS (SELECT DISTINCT source_path FROM b WHERE source_id IN ('source-1', 'source-2')) SELECT id, input FROM a WHERE source_path NOT IN (SELECT source_path FROM f) UNION ALL SELECT id, input FROM b WHERE source_path IN (SELECT source_path FROM f)")
def replace_file(spark, sf):
    old, new = _halves(spark, sf)
    new = new.where(F.col("source_id").isin("source-1", "source-2"))
    return K.replace_files(old, new, new).select("id", "input")


@query(f"{L} SELECT id, source_id FROM ledger WHERE source_id NOT IN ('source-0', 'source-3')")
def remove_sources(spark, sf):
    rows = W.ledger(spark, sf)
    return K.remove_sources(rows, rows.where(F.col("source_id").isin("source-0", "source-3"))).select("id", "source_id")


def _listings(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = W.table(spark, sf, "orders").select(F.concat(F.lit("/f/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("size"), F.col("o_orderdate").cast("timestamp").alias("modified"), "o_orderkey")
    new = rows.where("o_orderkey % 10 <> 3").withColumn("size", F.when(F.col("o_orderkey") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return new, rows.where("o_orderkey % 10 <> 7")


@query("SELECT '/f/' || o_orderkey AS path, CASE WHEN o_orderkey % 10 = 7 THEN 'new' WHEN o_orderkey % 10 = 3 THEN 'removed' WHEN o_orderkey % 4 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM orders")
def manifest_diff(spark, sf):
    return K.diff_manifest(*_listings(spark, sf))


@query("SELECT '/f/' || o_orderkey AS path FROM orders WHERE o_orderkey % 10 = 3")
def stale_paths(spark, sf):
    seen, manifest = _listings(spark, sf)
    return K.stale_paths(manifest, seen)


@query(f"{L}, p AS (SELECT DISTINCT source_id || '/' || substr(session_id, 1, 1) || '/' || source_path AS path FROM ledger) SELECT path FROM p WHERE starts_with(path, 'source-1/') OR starts_with(path, 'source-2/1/')")
def scope_filter(spark, sf):
    paths = W.ledger(spark, sf).select(F.concat_ws("/", "source_id", F.substring("session_id", 1, 1), "source_path").alias("path")).distinct()
    scopes = spark.createDataFrame([("source-1",), ("source-2/1/",)], "scope string")
    return K.scope_filter(paths, scopes).select("path")


@query(f"{L} SELECT DISTINCT source_id, source_path FROM ledger WHERE provider = 'counter' AND (is_subagent AND input > 20000 OR model = 'click' AND ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-16')")
def reprice_selection(spark, sf):
    return K.reprice_selection(W.ledger(spark, sf), [F.lit(W.CHANGE)], F.col("model") == "click", F.col("is_subagent") & (F.col("input") > 20000))


@query(f"{L} SELECT provider, model, {_sum('event_count', 'events')}, {_sum('input')}, {_sum('output')} FROM deduped GROUP BY ALL")
def incremental_equals_full(spark, sf):
    rows = W.ledger(spark, sf)
    first, second = rows.where("ts < '2024-01-15'"), rows.where("ts >= '2024-01-12'")
    merged = D.dedup_messages(K.upsert_latest(first, second))
    return merged.groupBy("provider", "model").agg(F.sum("event_count").cast("long").alias("events"), F.sum("input").cast("long").alias("input"), F.sum("output").cast("long").alias("output"))


@query(f"{LP}, g AS ({grouped_sql('account_id').split(W.priced_sql())[-1].strip()}), n AS (SELECT account_id, row_number() OVER (ORDER BY tokens, account_id) AS n FROM g WHERE account_id <> 'unattributed') SELECT CASE WHEN g.account_id = 'unattributed' THEN g.account_id ELSE 'account-' || n.n END AS account_id, tokens FROM g LEFT JOIN n USING (account_id)")
def export_anonymised(spark, sf):
    rows = S.priced_by(deduped(spark, sf), W.rate_card(spark), ["account_id"])
    return S.anonymise(rows, "account_id", "account", ["tokens"]).select("account_id", "tokens")


@query(f"{L} SELECT bool_or(source_id IN ('source-1')) AS provisional FROM ledger")
def provisional_flag(spark, sf):
    sources = W.ledger(spark, sf).select("source_id").distinct().withColumns({"mode": F.when(F.col("source_id") == "source-1", "snapshot").otherwise("events"), "pending": F.lit(False)})
    return S.is_provisional(sources, sources.where("source_id = 'source-9'"), filtered=True)


@query(f"{L} SELECT id, source_id FROM deduped WHERE source_id IN ('source-2', 'source-4')")
def source_filter(spark, sf):
    from ..sources.store import filtered

    return filtered(deduped(spark, sf), source_ids=["source-2", "source-4"]).select("id", "source_id")


# the whole summary, names and paths, retention and appends


_PARTS = {"totals": [], "models": ["provider", "model"], "accounts": S.ACCOUNT_KEYS, "days": ["day"], "subagents": ["provider", "source_id", "session_id", "parent_session_id"]}
_FULL = ["events", "tokens", "usd", "credits", "unpriced"]


def _part_sql(part: str, keys: list[str]) -> str:
    key = " || '|' || ".join(f"coalesce(CAST({'CAST(ts AS DATE)' if k == 'day' else k} AS VARCHAR), '-')" for k in keys) or "''"
    sums = f"{_sum('event_count', 'events')}, {_sum('total', 'tokens')}, round(coalesce(sum(usd), 0), 10) AS usd, round(coalesce(sum(credits), 0), 10) AS credits, {_sum('CASE WHEN priced THEN 0 ELSE event_count END', 'unpriced')}"
    return f"SELECT '{part}' AS part, {key} AS key, {sums} FROM priced {'WHERE is_subagent' if part == 'subagents' else ''} GROUP BY ALL"


_ONLY = "NULL::BIGINT AS tokens, NULL::DOUBLE AS usd, NULL::DOUBLE AS credits, NULL::BIGINT AS unpriced"


@query(
    f"{LP} {' UNION ALL '.join(_part_sql(p, k) for p, k in _PARTS.items())}"
    f" UNION ALL SELECT 'attribution', attribution_confidence, CAST(sum(event_count) AS BIGINT), {_ONLY} FROM priced GROUP BY attribution_confidence"
    f" UNION ALL SELECT 'sessions', '', count(DISTINCT provider || '|' || source_id || '|' || session_id), {_ONLY} FROM priced"
)
def full_summary(spark, sf):
    """All breakdowns of the whole ledger in one result."""
    full = S.full(deduped(spark, sf), W.rate_card(spark))
    key = lambda keys: F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    rounded = lambda c: F.round(c, 10).alias(c) if c in ("usd", "credits") else F.col(c)
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(_FULL[1:], ("long", "double", "double", "long"))]
    out = full["attribution"].select(F.lit("attribution").alias("part"), F.col("attribution_confidence").alias("key"), "events", *none)
    out = out.unionByName(full["sessions"].select(F.lit("sessions").alias("part"), F.lit("").alias("key"), F.col("sessions").alias("events"), *none))
    for part, keys in _PARTS.items():
        out = out.unionByName(full[part].select(F.lit(part).alias("part"), key(keys).alias("key"), *map(rounded, _FULL)))
    return out


_SCOPES = ["/log/", "/log/1", "/log/12.jsonl"]


@query(f"{L} SELECT source_path, {', '.join(f"source_path = '{s}' OR starts_with(source_path, '{s.rstrip('/')}/') AS in_{i}" for i, s in enumerate(_SCOPES))} FROM (SELECT DISTINCT source_path FROM ledger)")
def paths_within(spark, sf):
    paths = W.ledger(spark, sf).select("source_path").distinct()
    return paths.select("source_path", *[U.path_within(F.col("source_path"), F.lit(s)).alias(f"in_{i}") for i, s in enumerate(_SCOPES)])


@query("SELECT c_custkey, lower(c_mktsegment) || ':/root/' || c_nationkey AS source_id FROM customer")
def source_keys(spark, sf):
    root = F.concat(F.lit("/root/"), F.col("c_nationkey").cast("string"))
    return W.table(spark, sf, "customer").select("c_custkey", U.source_key(F.col("c_mktsegment"), root).alias("source_id"))


@query(f"{L} SELECT id, concat_ws(':', provider, source_id, source_path, CAST(byte_offset AS VARCHAR)) AS event_id FROM ledger")
def event_ids(spark, sf):
    return W.ledger(spark, sf).select("id", U.event_id(F.col("provider"), F.col("source_id"), F.col("source_path"), F.col("byte_offset").cast("string")).alias("event_id"))


@query(f"{L} SELECT id, CASE WHEN is_subagent THEN 'a-' || byte_offset END AS agent, CASE WHEN is_subagent THEN 'agent:a-' || byte_offset ELSE session_id END AS session_id FROM ledger")
def subagent_sessions(spark, sf):
    rows = W.ledger(spark, sf)
    folder = F.when(F.col("is_subagent"), "/log/subagents/a-").otherwise("/log/")
    agent = U.subagent_of_path(F.concat(folder, F.col("byte_offset").cast("string"), F.lit(".jsonl")))
    return rows.withColumn("agent", agent).select("id", "agent", U.effective_session(F.col("agent"), F.col("session_id")).alias("session_id"))


@query(f"{L} SELECT '/log/' || c_custkey || '.jsonl' AS path FROM customer UNION SELECT source_path FROM ledger")
def known_paths(spark, sf):
    manifest = W.table(spark, sf, "customer").select(F.concat(F.lit("/log/"), F.col("c_custkey").cast("string"), F.lit(".jsonl")).alias("path"))
    return K.known_paths(manifest, W.ledger(spark, sf))


@query(f"{L} SELECT DISTINCT source_path FROM ledger WHERE source_path NOT IN (SELECT source_path FROM ledger WHERE model = 'error' AND byte_offset % 700 = 0)")
def retained_files(spark, sf):
    rows = W.ledger(spark, sf)
    failed = rows.where("model = 'error' and byte_offset % 700 = 0")
    return K.retained(rows, failed, rows)


@query("SELECT '/f/' || o_orderkey AS path FROM orders WHERE o_orderkey % 10 NOT IN (3, 7) AND o_orderkey % 4 = 0")
def appended_files(spark, sf):
    new, old = _listings(spark, sf)
    return K.appended(new.join(old.select("path", F.col("size").alias("was")), "path").withColumn("appended", F.col("size") > F.col("was")))


@query(
    f"{CT}, cursors AS (SELECT path, (min(seq) + max(seq)) // 2 AS c FROM raw GROUP BY path) SELECT path, seq, {', '.join(f'CAST(use_{c} AS BIGINT) AS use_{c}' for c in COUNTERS)}"
    f" FROM classified JOIN cursors USING (path) WHERE seq > c AND accepted AND ({' OR '.join(f'use_{c} > 0' for c in COUNTERS)})"
)
def append_after_cursor(spark, sf):
    """Only the rows past each file's cursor, seeded with what is saved of those before: the same
    requests as a replay of the whole file."""
    rows = W.counters(spark, sf)
    cursors = rows.groupBy("path").agg(F.floor((F.min("seq") + F.max("seq")) / 2).alias("c"))
    placed = rows.join(cursors, "path")
    totals, lasts = [f"tot_{c}" for c in COUNTERS], [F.lit(None).cast("long").alias(f"last_{c}") for c in COUNTERS]
    before = placed.where("seq <= c").groupBy("path").agg(F.max("seq").alias("seq"), F.max("ts").alias("ts"), F.max_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"), *[F.max(t).alias(t) for t in totals])
    grown = K.append_seed(placed.where("seq > c").select(*rows.columns), before.select("*", *lasts))
    return C.requests(C.classify(grown, ["seq"])).join(cursors, "path").where("seq > c").select("path", "seq", *[f"use_{c}" for c in COUNTERS])
