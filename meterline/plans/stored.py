"""Queries over stored tables: day rows, cursors, metadata versions, reports, and the parts of a refresh
that have no transcript of their own."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import usage as U
from ..operators import attribution as A
from ..operators import changes as K
from ..operators import counter as C
from ..operators import days as Y
from ..operators import dedup as D
from ..operators import summary as S
from ..sources import byte_ranges as B
from ..sources import lines as N
from ..sources import metadata as M
from ..sources import refresh as R
from ..sources import store
from ..sources.scratch import working_folder
from . import growing as G
from . import views as W
from .queries import _ALL, _BASIS, _CONF, L, LP, deduped, money, query

#: A range that cuts the days at both its ends and holds a change of rates.
_START, _END = datetime(2024, 1, 3, 7, 30), datetime(2024, 1, 22, 16, 20)
_RANGE = f"ts >= TIMESTAMP '{_START}' AND ts < TIMESTAMP '{_END}'"


def _day_table(spark, sf) -> tuple:
    rows, card = deduped(spark, sf), W.rate_card(spark)
    table = Y.DayTable(spark, working_folder(spark, "days"))
    table.write(rows, card)
    return table, rows, card


@query(f"{LP} SELECT provider, model, {_ALL} FROM priced WHERE {_RANGE} GROUP BY ALL")
def range_from_days(spark, sf):
    """A range from stored day rows and the ledger's rows of the two cut days."""
    table, rows, card = _day_table(spark, sf)
    return money(Y.range_summary(table.sums(), rows, card, _START, _END, ["provider", "model"]))


@query(f"{L} SELECT count(DISTINCT (provider, source_id, session_id)) AS sessions FROM deduped WHERE {_RANGE}")
def range_session_count(spark, sf):
    """The exact number of a range's sessions, from each day's distinct ones."""
    table, rows, _ = _day_table(spark, sf)
    return Y.range_sessions(table.sessions(), rows, _START, _END)


@query()
def range_session_estimate(spark, sf):
    """The same from the days' merged sketches: an estimate, so no SQL gives it; its error is tested."""
    table, rows, _ = _day_table(spark, sf)
    return Y.range_sessions_estimate(table.sums(), rows, _START, _END)


@query(
    f"{L}, split AS (SELECT *, ts >= TIMESTAMP '2024-01-15' AND event_id_ % 3 = 0 AS gone FROM (SELECT *, CAST(substr(id, 7) AS BIGINT) AS event_id_ FROM ledger)) "
    "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM split GROUP BY 1 HAVING bool_or(gone)"
)
def changed_days(spark, sf):
    """The days that are to be written again where rows have left the ledger."""
    rows = W.ledger(spark, sf)
    after = rows.where(~((F.col("ts") >= F.lit(datetime(2024, 1, 15))) & (F.substring("id", 7, 20).cast("long") % 3 == 0)))
    return spark.createDataFrame([(d.isoformat(),) for d in Y.changed_days(rows, after)], "day string")


@query(f"{L} SELECT provider, source_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('input', 'output'))} FROM deduped WHERE CASE WHEN source_id = 'source-3' THEN CAST(ts AS DATE) > DATE '2024-01-03' AND CAST(ts AS DATE) <= DATE '2024-01-22' ELSE {_RANGE} END GROUP BY ALL")
def range_with_coarse_days(spark, sf):
    """A source of which only day rows are left: its days count whole, where they begin in the range."""
    table, rows, card = _day_table(spark, sf)
    coarse = spark.createDataFrame([("source-3",)], "source_id string")
    got = Y.range_summary(table.sums(), rows.where("source_id <> 'source-3'"), card, _START, _END, ["provider", "source_id"], coarse)
    return got.select("provider", "source_id", "input", "output")


@query(f"{L} SELECT s AS source_id, s IN (SELECT source_id FROM deduped) AS provisional FROM (VALUES ('source-3'), ('source-9')) t(s)")
def coarse_probe(spark, sf):
    """Whether a bounded range is provisional, for a source with stored day rows and for one without."""
    table, _, _ = _day_table(spark, sf)
    flags = [Y.coarse_provisional(table.sums(), spark.createDataFrame([(s,)], "source_id string"), _START, _END).select(F.lit(s).alias("source_id"), "provisional") for s in ("source-3", "source-9")]
    return flags[0].unionByName(flags[1])


# cursors and metadata


@query(
    f"WITH {G._STATES}, files AS (SELECT file, kind, bool_or(last) AS grew FROM placed GROUP BY ALL), stages(stage) AS (VALUES (1), (2), (3)) "
    "SELECT file, stage, CASE WHEN stage = 2 AND kind IN (1, 2, 4) AND grew THEN 'pending' ELSE 'reconciled' END AS state FROM files, stages WHERE (kind <> 5 OR stage > 1) AND (kind <> 3 OR stage = 1)"
)
def cursor_states(spark, sf):
    """Every file's cursor after a first refresh, after one that met appends, and after a full one."""
    folder, kept = working_folder(spark, "cursors"), R.LedgerStore(spark, working_folder(spark, "store"), buckets=4)
    sources = spark.createDataFrame([("s", "message", [folder], True)], "source_id string, provider string, roots array<string>, enabled boolean")
    out = None
    for stage, later in ((1, False), (2, True), (3, True)):
        if stage < 3:
            turns = G._turns(spark, sf, later)
            mark = F.when((F.col("kind") == 6) & F.lit(later), "xx").otherwise("a")
            grew = F.max(F.pmod("conv_id", F.lit(5)) == 4).over(G.Window.partitionBy("file"))
            lines = turns.withColumns({"value": F.concat_ws(":", mark, "conv_id", "turn", "role", "n"), "grew": grew})
            lines = lines.where("kind in (5, 6) or (kind in (1, 2, 4) and grew)") if later else lines
            G._write(lines, ["conv_id", "turn"], folder)
            if later:
                G._remove(G._gone(spark, sf).withColumn("folder", F.lit(folder)))
        R.refresh(kept, sources, *G._dimensions(spark), full=stage == 3)
        states = kept.cursors().select(G._file().alias("file"), F.lit(stage).alias("stage"), "state")
        states = spark.createDataFrame(states.collect(), states.schema)  # as they are at this stage
        out = states if out is None else out.unionByName(states)
    return out


_MOVED = "moved AS (SELECT session_id, CASE WHEN hash_ % 5 = 0 AND confidence = 'session-verified' THEN 'acct-moved' ELSE account_id END AS account_id, confidence, basis FROM (SELECT *, CAST(split_part(session_id, ':', 1) AS BIGINT) AS hash_ FROM accounts))"


@query(
    f"{L}, {W.ACCOUNTS_SQL}, {_MOVED}, j AS (SELECT l.*, coalesce(l.parent_session_id, l.session_id) AS base, a.account_id AS acc, a.confidence AS c0, a.basis AS b0, l.attribution_confidence = 'session-verified' AS keeps FROM ledger l LEFT JOIN moved a ON coalesce(l.parent_session_id, l.session_id) = a.session_id WHERE provider = 'message' AND source_id = 'source-1'), "
    "k AS (SELECT *, acc IS NOT NULL AS known, coalesce(c0, attribution_confidence) AS conf, coalesce(b0, attribution_basis) AS bas FROM j) "
    f"SELECT id, coalesce(acc, account_id) AS account_id, CASE WHEN known THEN {_CONF} ELSE attribution_confidence END AS attribution_confidence, CASE WHEN known THEN {_BASIS} ELSE attribution_basis END AS attribution_basis FROM k"
)
def accounts_by_difference(spark, sf):
    """A store whose accounts are set, and set again with some moved: rows of sessions that differ are
    attributed anew, each time without a look at transcripts."""
    kept = R.LedgerStore(spark, working_folder(spark, "accounts"), buckets=16)
    rows = W.ledger(spark, sf).where("provider = 'message' and source_id = 'source-1'")
    kept.commit({"ledger": (rows, kept.ledger.parts_of(rows))})
    accounts = A.session_accounts(*W.candidates(spark, sf))
    moves = (F.split("session_id", ":")[0].cast("long") % 5 == 0) & (F.col("confidence") == "session-verified")
    R.apply_accounts(kept, "source-1", accounts)
    R.apply_accounts(kept, "source-1", accounts.withColumn("account_id", F.when(moves, "acct-moved").otherwise(F.col("account_id"))))
    return kept.ledger.read().select("id", "account_id", "attribution_confidence", "attribution_basis")


@query(
    f"{L}, t AS (SELECT '/log/' || c_custkey || '.jsonl' AS path, CASE WHEN c_custkey % 4 = 0 THEN c_name || '-renamed' ELSE c_name END AS tid, c_custkey % 3 = 0 AS child FROM customer) "
    "SELECT id, coalesce(tid, session_id) AS session_id, coalesce(child, is_subagent) AS is_subagent FROM ledger LEFT JOIN t ON source_path = path WHERE provider = 'counter' AND source_id = 'source-2'"
)
def threads_by_difference(spark, sf):
    """The same with threads, of which every fourth is renamed."""
    kept = R.LedgerStore(spark, working_folder(spark, "threads"), buckets=16)
    rows = W.ledger(spark, sf).where("provider = 'counter' and source_id = 'source-2'")
    kept.commit({"ledger": (rows, kept.ledger.parts_of(rows))})
    path = F.concat(F.lit("/log/"), F.col("c_custkey").cast("string"), F.lit(".jsonl"))
    threads = W.table(spark, sf, "customer").select(path.alias("path"), F.col("c_name").alias("id"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("parent_id"), (F.col("c_custkey") % 3 == 0).alias("is_subagent"), "c_custkey")
    R.apply_threads(kept, "source-2", threads)
    R.apply_threads(kept, "source-2", threads.withColumn("id", F.when(F.col("c_custkey") % 4 == 0, F.concat("id", F.lit("-renamed"))).otherwise(F.col("id"))))
    return kept.ledger.read().select("id", "session_id", "is_subagent")


@query(
    "WITH e AS (SELECT o_custkey AS k, max('p' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS parent FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) "
    "SELECT c_name AS id, '/log/' || c_custkey AS path, c_mktsegment AS model, parent AS parent_id, parent IS NOT NULL OR c_custkey % 7 = 0 AS is_subagent FROM customer LEFT JOIN e ON c_custkey = k WHERE c_custkey % 4 <> 1"
)
def thread_dimension(spark, sf):
    """Threads that have a path, with the greatest of their parents."""
    key = F.col("c_custkey")
    customers = W.table(spark, sf, "customer")
    threads = customers.select(F.col("c_name").alias("id"), F.when(key % 4 != 1, F.concat(F.lit("/log/"), key.cast("string"))).alias("rollout_path"), F.col("c_mktsegment").alias("model"), F.when(key % 7 == 0, "agent").alias("agent_path"))
    parent = F.concat(F.lit("p"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    edges = W.table(spark, sf, "orders").where("o_orderkey % 3 = 0").join(customers.select(key.alias("o_custkey"), "c_name"), "o_custkey").select(parent.alias("parent_thread_id"), F.col("c_name").alias("child_thread_id"))
    return M.read_threads(threads, edges)


def _documents(spark, sf, folder: str, value, where: str = "true") -> str:
    """JSON documents, an array of up to a hundred a file."""
    rows = W.table(spark, sf, "customer").where(where).groupBy(F.floor(F.col("c_custkey") / 100).alias("file")).agg(F.to_json(F.collect_list(value)).alias("value"))
    return G._write(rows, [], folder)


@query("SELECT 's' || c_custkey AS session_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'flat-' || c_name END AS account_id FROM customer WHERE c_custkey % 5 <> 0")
def account_telemetry(spark, sf):
    """Session and account of telemetry documents, nested in even ones and flat in odd ones; every fifth
    names no account."""
    key = F.col("c_custkey")
    session = F.concat(F.lit("s"), key.cast("string"))
    nested = F.struct(session.alias("session_id"), F.struct(F.when(key % 5 != 0, F.col("c_name")).alias("account_uuid")).alias("auth"))
    flat = F.struct(F.when(key % 5 != 0, F.concat(F.lit("flat-"), F.col("c_name"))).alias("account_uuid"))
    doc = F.struct(F.when(key % 2 == 0, nested).alias("event_data"), F.when(key % 2 == 1, session).alias("session_id"), F.when(key % 2 == 1, flat).alias("auth"))
    return M.read_account_telemetry(spark, _documents(spark, sf, working_folder(spark, "telemetry"), doc))


@query("SELECT 's' || c_custkey AS session_id, 'acct-' || (c_custkey % 3) AS account_id FROM customer")
def account_support(spark, sf):
    """Session and account of documents whose folder names the account."""
    root = working_folder(spark, "support")
    doc = F.struct(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("sessionId"))
    for k in range(3):
        _documents(spark, sf, f"{root}/sessions/acct-{k}", doc, f"c_custkey % 3 = {k}")
    return M.read_account_support(spark, f"{root}/sessions")


# reports, snapshots and small rules


@query(
    f"{LP}, a AS (SELECT provider, source_id, account_id, attribution_confidence AS confidence, attribution_basis AS basis, CAST(sum(event_count) AS BIGINT) AS events, CAST(sum(total) AS BIGINT) AS tokens FROM priced GROUP BY ALL), "
    "named AS (SELECT account_id AS acc, 'account-' || row_number() OVER (ORDER BY min((provider, source_id, account_id, confidence, basis))) AS shown FROM a WHERE account_id <> 'unattributed' GROUP BY 1), "
    "src AS (SELECT source_id AS sid, 'source-' || row_number() OVER (ORDER BY source_id) AS shown FROM (SELECT DISTINCT source_id FROM a)) "
    "SELECT provider, src.shown AS source_id, coalesce(named.shown, account_id) AS account_id, confidence, basis, events, tokens, (SELECT CAST(sum(tokens) AS BIGINT) FROM a) AS all_tokens FROM a JOIN src ON sid = source_id LEFT JOIN named ON acc = account_id"
)
def portable_report(spark, sf):
    """The accounts of the report's one nested document, read back from it."""
    rows, card, path = deduped(spark, sf), W.rate_card(spark), working_folder(spark, "report")
    sources = rows.select("source_id", F.lit("both").alias("provider"), F.lit(True).alias("enabled"), F.lit(20.0).alias("monthly_usd")).distinct()
    store.export_document(path, {"timezone": "UTC", "start": "2024-01-01"}, sources, S.totals(rows, card), accounts=S.by_account(rows, card), models=S.by_model(rows, card))
    doc = spark.read.json(path)
    a = doc.select("summary.totals.tokens", F.explode("summary.accounts").alias("a"))
    return a.select("a.provider", "a.source_id", "a.account_id", F.col("a.attribution_confidence").alias("confidence"), F.col("a.attribution_basis").alias("basis"), "a.events", "a.tokens", F.col("tokens").alias("all_tokens"))


@query(f"{L} SELECT 'same' AS asked, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('input', 'output'))} FROM deduped")
def headline_snapshot(spark, sf):
    """A saved headline comes back for the same sources and card only."""
    path = working_folder(spark, "headline")
    totals = S.overview(deduped(spark, sf)).select("input", "output")
    store.save_headline(totals, ["b", "a"], "2024-01-20", path)
    asked = {"same": (["a", "b"], "2024-01-20"), "fewer": (["a"], "2024-01-20"), "later": (["a", "b"], "2024-01-21")}
    found = [store.load_headline(spark, *key, path).select(F.lit(name).alias("asked"), "input", "output") for name, key in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"{L} SELECT id, source_id, input FROM deduped WHERE {_RANGE} AND source_id IN ('source-1', 'source-4')")
def stored_ledger(spark, sf):
    """The ledger written, and read back by time and sources."""
    path = working_folder(spark, "ledger")
    store.write_ledger(deduped(spark, sf), path)
    return store.read_ledger(spark, path, _START, _END, ["source-1", "source-4"]).select("id", "source_id", "input")


@query(f"{L}, stamped AS (SELECT ts, row_number() OVER (ORDER BY ts) AS place FROM ledger) SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, place FROM stamped")
def ordered_ledger(spark, sf):
    """The instants of the stored ledger in the order in which it is read."""
    from .queries import stamp

    path = working_folder(spark, "ordered")
    store.write_ledger(W.ledger(spark, sf), path)
    # read once: another run of the sort may draw other bounds between the partitions
    rows = R.materialised(store.read_ledger(spark, path).select(stamp("ts").alias("at"), F.monotonically_increasing_id().alias("read")), "read")
    # partitions follow each other in the range order of the sort: each one's rows, and those before it
    rows = rows.select("at", F.shiftright("read", 33).alias("part"), F.col("read").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    before, so_far = [], 0
    for r in sorted(rows.groupBy("part").count().collect()):
        before.append((r.part, so_far))
        so_far += r["count"]
    starts = spark.createDataFrame(before, "part bigint, start bigint")
    return rows.join(F.broadcast(starts), "part").select("at", (F.col("start") + F.col("nth") + 1).alias("place"))


@query(f"{L} SELECT id FROM ledger WHERE source_id IN ('source-0', 'source-2')")
def enabled_sources(spark, sf):
    sources = spark.createDataFrame([(f"source-{k}", k in (0, 2)) for k in range(5)], "source_id string, enabled boolean")
    return store.enabled(W.ledger(spark, sf), sources).select("id")


@query(
    f"{L} SELECT DISTINCT 'rollup:' || concat_ws(chr(31), {', '.join(f'coalesce(CAST({k} AS VARCHAR), {chr(39) * 2})' for k in D.ROLLUP_KEYS)}, epoch_us(date_trunc('hour', ts)) // 3600000000) AS id FROM ledger"
)
def rollup_ids(spark, sf):
    """The identities of compact rows, here of whole hours since 1970."""
    rows = W.ledger(spark, sf)
    return rows.select(F.regexp_replace(U.rollup_id([F.col(k) for k in D.ROLLUP_KEYS], F.floor(F.unix_timestamp("ts") / 3600)), r"\.0$", "").alias("id")).distinct()


@query("WITH s AS (SELECT DISTINCT unnest(['/a' || (c_custkey % 5), '/a' || (c_custkey % 8) || '/b' || (c_custkey % 3), '/a' || (c_custkey % 8) || '/b' || (c_custkey % 3) || '/c']) AS scope FROM customer WHERE c_custkey < 1000) SELECT scope FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE starts_with(o.scope, s.scope || '/'))")
def narrow_scopes(spark, sf):
    key = F.col("c_custkey")
    low = F.concat(F.lit("/a"), (key % 8).cast("string"), F.lit("/b"), (key % 3).cast("string"))
    scopes = F.array(F.concat(F.lit("/a"), (key % 5).cast("string")), low, F.concat(low, F.lit("/c")))
    return K.narrow_scopes(W.table(spark, sf, "customer").where("c_custkey < 1000").select(F.explode(scopes).alias("scope")))


@query(
    "WITH t AS (SELECT o_orderkey, '0190a7a0-0000-' || (CASE WHEN o_orderkey % 5 = 0 THEN '4' ELSE '7' END) || '000-8000-' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 12, '0') AS turn, '0190a7a0-0000-7000-8000-' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 12, '0') AS child, o_orderkey % 5 <> 0 AS ids FROM orders) "
    "SELECT o_orderkey, ids AS turn_has_id, CASE WHEN ids AND turn >= child THEN 'own' ELSE 'copied' END AS tied, CASE WHEN ids THEN CASE WHEN turn >= child THEN 'own' ELSE 'copied' END ELSE 'ambiguous' END AS untimed FROM t"
)
def ownership_by_id(spark, sf):
    """Tasks started in the second of the fork, and tasks without a time: version-7 ids decide."""
    version = F.when(F.col("o_orderkey") % 5 == 0, "4").otherwise("7")
    turn = F.concat(F.lit("0190a7a0-0000-"), version, F.lit("000-8000-"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 12, "0"))
    child = F.concat(F.lit("0190a7a0-0000-7000-8000-"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 12, "0"))
    at, none = F.lit(10).cast("long"), F.lit(None).cast("long")
    return W.table(spark, sf, "orders").select("o_orderkey", U.is_uuid7(turn).alias("turn_has_id"), C.task_ownership(at, turn, at, child).alias("tied"), C.task_ownership(none, turn, at, child).alias("untimed"))


@query("SELECT file FROM (SELECT DISTINCT conv_id // 5 AS file FROM conversations) ORDER BY CAST(file AS VARCHAR) || '.jsonl' LIMIT 3")
def limited_files(spark, sf):
    """The first three files by path."""
    turns = W.table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 5).alias("file"), "conv_id", "turn", F.lit("x").alias("value"))
    folder = G._write(turns, ["conv_id", "turn"], working_folder(spark, "limited"))
    return N.limit_files(N.file_listing(spark, [folder]), 3).select(G._file().alias("file"))


@query(
    "WITH t AS (SELECT conv_id // 5 AS file, CAST(sum(strlen(concat_ws(':', conv_id, turn, role)) + 1) AS BIGINT) AS whole FROM conversations GROUP BY 1) "
    "SELECT file, whole AS parsed, file % 3 <> 1 AS valid FROM t"
)
def invalid_tails(spark, sf):
    """Files that end in the middle of a line: of every three, one's last bytes are no UTF-8, and one's
    are a part of a line.  The next read begins at the end of the last whole line."""
    turns = W.table(spark, sf, "conversations").withColumn("file", F.floor(F.col("conv_id") / 5))
    lines = turns.select("file", "conv_id", "turn", F.concat(F.concat_ws(":", "conv_id", "turn", "role"), F.lit("\n")).cast("binary").alias("value"))
    kind = F.pmod("file", F.lit(3))
    tail = F.when(kind == 1, F.unhex(F.lit("61C3"))).when(kind == 2, F.lit("half a line").cast("binary"))
    tails = turns.select("file").distinct().select("file", F.lit(2**62).alias("conv_id"), F.lit(0).alias("turn"), tail.alias("value")).where("value is not null")
    folder = G._write(lines.unionByName(tails), ["conv_id", "turn"], working_folder(spark, "tails"))
    ends = B.parsed_ends(B.read_ranges(B.whole_files(N.file_listing(spark, [folder]))))
    return ends.select(G._file().alias("file"), F.col("parsed_offset").alias("parsed"), "valid")
