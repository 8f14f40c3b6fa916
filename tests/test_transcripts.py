"""Transcripts written as files, scanned to ledger rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meterline.operators import attribution as A
from meterline.operators import counter as C
from meterline.operators import dedup as D
from meterline.schema import COUNTERS, LEDGER
from meterline.sources import lines as N
from meterline.sources import transcripts as T

NAMES = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
THREADS = "id string, path string, model string, parent_id string, is_subagent boolean"


def write(path, rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in rows) + end)


def total(*now, last=None, at="2026-07-01T10:00:00Z"):
    info = {"total_token_usage": dict(zip(NAMES, now))}
    if last:
        info["last_token_usage"] = dict(zip(NAMES, last))
    return {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": info}}


def turn(model):
    return {"timestamp": "2026-07-01T09:00:00Z", "type": "turn_context", "payload": {"model": model}}


def task(started, turn_id=None):
    return {"timestamp": "2026-07-01T09:00:00Z", "type": "event_msg", "payload": {"type": "task_started", "started_at": started, "turn_id": turn_id}}


def header(parent=None, created="2026-07-01T00:00:00Z"):
    payload = {"id": "child", "forked_from_id": "origin"}
    if parent:
        payload["parent_thread_id"] = parent
    return {"timestamp": created, "type": "session_meta", "payload": payload}


CREATED = 1782864000  # 2026-07-01T00:00:00Z


def scan(spark, root, threads=(), limits=(("m", 272000),)):
    lines = N.read_lines(spark, [str(root)])
    events, files = T.counter_events(lines, "s", spark.createDataFrame(list(threads), THREADS), spark.createDataFrame(list(limits), "model string, lc_threshold bigint"))
    return events.orderBy("source_path", "byte_offset").collect(), files.collect()


def sums(rows):
    return tuple(sum(r[c] for r in rows) for c in ("input", "cached", "output", "reasoning"))


def test_cumulative_totals_become_requests(spark, tmp_path):
    write(tmp_path / "a.jsonl", [total(100, 80, 10, 4), total(150, 120, 15, 6), total(150, 120, 15, 9)])
    rows, files = scan(spark, tmp_path)
    assert len(rows) == 3 and sums(rows) == (30, 120, 15, 9)
    assert (files[0].duplicates, files[0].stale, files[0].ambiguous_resets, files[0].inherited) == (0, 0, 0, 0)


def test_fall_and_recovery_is_no_reset(spark, tmp_path):
    write(tmp_path / "a.jsonl", [total(100, 80, 10, 0), total(80, 60, 8, 0), total(120, 90, 12, 0)])
    rows, files = scan(spark, tmp_path)
    assert len(rows) == 2 and sums(rows)[:3] == (30, 90, 12)
    assert (files[0].stale, files[0].ambiguous_resets) == (1, 0)


def test_fall_without_recovery_is_ambiguous(spark, tmp_path):
    write(tmp_path / "a.jsonl", [total(100, 0, 10, 0), total(80, 0, 8, 0)])
    rows, files = scan(spark, tmp_path)
    assert len(rows) == 1 and (files[0].stale, files[0].ambiguous_resets) == (1, 1)


def test_repeated_snapshot_is_a_duplicate(spark, tmp_path):
    write(tmp_path / "a.jsonl", [total(50, 0, 5, 0, last=(50, 0, 5, 0)), total(50, 0, 5, 0, last=(50, 0, 5, 0)), total(90, 0, 9, 0, last=(40, 0, 4, 0))])
    rows, files = scan(spark, tmp_path)
    assert len(rows) == 2 and sums(rows) == (90, 0, 9, 0) and files[0].duplicates == 1


FORK = [header("parent"), task(CREATED - 100), total(1000, 500, 100, 0), total(1100, 550, 110, 0), task(CREATED + 10), total(1130, 560, 117, 0, last=(30, 10, 7, 0)), total(1160, 580, 125, 0, last=(30, 20, 8, 0))]


def test_fork_counts_its_own_part_only(spark, tmp_path):
    write(tmp_path / "f.jsonl", FORK)
    rows, files = scan(spark, tmp_path)
    assert len(rows) == 2 and sums(rows)[:3] == (30, 30, 15)
    assert all(r.is_subagent and r.parent_session_id == "parent" and r.session_id == "child" for r in rows)
    assert files[0].inherited == 1


def test_fork_of_a_user_is_no_subagent(spark, tmp_path):
    write(tmp_path / "f.jsonl", [header(), *FORK[1:6]])
    rows, _ = scan(spark, tmp_path)
    assert len(rows) == 1 and not rows[0].is_subagent and rows[0].parent_session_id == "origin"


def test_fork_without_own_tasks_has_no_rows(spark, tmp_path):
    write(tmp_path / "f.jsonl", FORK[:4])
    rows, files = scan(spark, tmp_path)
    assert rows == [] and files[0].inherited == 1


def test_thread_metadata_names_session_model_and_parent(spark, tmp_path):
    write(tmp_path / "rollout.jsonl", [total(60, 30, 15, 0)])
    rows, files = scan(spark, tmp_path, [("t1", "/elsewhere/rollout.jsonl", "m", "p1", True)])
    assert (rows[0].session_id, rows[0].model, rows[0].parent_session_id, rows[0].is_subagent) == ("t1", "m", "p1", True)
    assert files[0].inherited == 0


def test_model_follows_the_turns_and_long_context_its_model(spark, tmp_path):
    write(tmp_path / "a.jsonl", [turn("m"), total(300000, 0, 10, 0, last=(300000, 0, 10, 0)), turn("other"), total(600000, 0, 20, 0, last=(300000, 0, 10, 0))])
    rows, _ = scan(spark, tmp_path)
    assert [r.model for r in rows] == ["m", "other"]
    assert [r.lc_input for r in rows] == [300000, 0]


def test_ownership_rules(spark):
    seven = ["0190a7a0-0000-7000-8000-00000000000" + x for x in "123"]
    cases = [(11, None, 10, None, "own"), (9, None, 10, None, "copied"), (10, None, 10, None, "copied"), (10, seven[2], 10, seven[1], "own"), (10, seven[0], 10, seven[1], "copied"), (None, seven[1], 10, seven[1], "own"), (None, None, 10, seven[1], "ambiguous"), (11, None, None, None, "ambiguous")]
    df = spark.createDataFrame(cases, "s bigint, t string, c bigint, h string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", C.task_ownership(F.col("s"), F.col("t"), F.col("c"), F.col("h"))).collect())


def brute(rows, forked):
    """One pass over a file's snapshots."""
    water = key = None
    out, counts, down = [], [0, 0], False
    for seq, now, last in rows:
        if water is None:
            water, key = now, (now, last)
            use = None
            if last and any(x > 0 for x in last):
                use = [min(max(0, a), b) for a, b in zip(last, now)]
                if not any(use) and not forked:
                    use = None
            if use is None:
                use = [0] * 6 if forked else now
        else:
            delta = [max(0, a - b) for a, b in zip(now, water)]
            fell = any(a < b for a, b in zip(now, water))
            down = down or fell
            if not any(delta):
                counts[(now, last) != key] += 1
                continue
            water = [max(a, b) for a, b in zip(now, water)]
            use = delta
            if last and any(x > 0 for x in last):
                fenced = [min(max(0, a), b) for a, b in zip(last, delta)]
                use = fenced if any(fenced) else delta
            key = (now, last)
        if any(use):
            out.append((seq, *use))
    return out, (*counts, int(down and rows[-1][1] != water))


def test_random_files_agree_with_one_pass(spark):
    rnd, files, data = random.Random(7), {}, []
    for f in range(150):
        now, rows = [0] * 6, []
        for seq in range(rnd.randint(1, 12)):
            kind = rnd.random()
            if kind < 0.6 or not rows:
                now = [x + rnd.choice((0, 0, 5, 9)) for x in now]
            elif kind < 0.75:
                now = [max(0, x - rnd.choice((0, 4))) for x in now]
            last = [rnd.choice((0, 3, 7, 20)) for _ in range(6)] if rnd.random() < 0.6 else None
            if kind > 0.9 and rows:
                now, last = rows[-1][1], rows[-1][2]
            rows.append((seq, list(now), last))
            data.append((f"f{f}", seq, f % 3 == 0, *now, *(last or [None] * 6)))
        files[f"f{f}"] = brute(rows, f % 3 == 0)
    names = [f"tot_{c}" for c in COUNTERS] + [f"last_{c}" for c in COUNTERS]
    df = spark.createDataFrame(data, "path string, seq bigint, forked boolean, " + ", ".join(f"{n} bigint" for n in names)).repartition(7)
    got = C.classify(df, ["seq"], F.col("forked")).cache()
    used = {}
    for r in got.where("accepted").orderBy("path", "seq").collect():
        use = [r[f"use_{c}"] for c in COUNTERS]
        if any(use):
            used.setdefault(r.path, []).append((r.seq, *use))
    for r in C.diagnostics(got, ["seq"]).collect():
        rows, counts = files[r.path]
        assert used.get(r.path, []) == rows, r.path
        assert (r.duplicates, r.stale, r.ambiguous_resets) == counts, r.path


def message(mid, out, session="s1", at="2026-07-01T10:00:00Z", **more):
    usage = more.pop("usage", {"input_tokens": 1, "output_tokens": out})
    return {"type": "assistant", "sessionId": session, "timestamp": at, **more, "message": {"id": mid, "model": "opus", "usage": usage}}


def scan_messages(spark, root, accounts=None):
    return T.message_events(N.with_offsets(N.read_lines(spark, [str(root)])), "src", accounts)


def test_fragments_children_and_unnamed_sidechains(spark, tmp_path):
    write(tmp_path / "p" / "a.jsonl", [message("m1", 3), message("m1", 5, at="2026-07-01T10:00:01Z"), message("m2", 2, agentId="a1"), message("m1", 6, isSidechain=True), "not json", {"type": "user"}])
    accounts = A.session_accounts(spark.createDataFrame([], "session_id string, account_id string"), spark.createDataFrame([], "session_id string, account_id string"))
    rows = scan_messages(spark, tmp_path, accounts).collect()
    assert len(rows) == 3 and sum(r.output for r in rows) == 13
    assert {r.attribution_confidence for r in rows} == {"source-only", "parent-session", "ambiguous-sidechain"}
    assert sum(r.output for r in rows if r.is_subagent) == 8
    assert [f.name for f in LEDGER.fields] == scan_messages(spark, tmp_path).columns


def test_copies_in_two_files_and_synthetic_rows(spark, tmp_path):
    write(tmp_path / "a.jsonl", [message("m1", 4), message("zero", 0, usage={"input_tokens": 0, "output_tokens": 0})])
    write(tmp_path / "b.jsonl", [message("m1", 4), message("m2", 7)])
    rows = scan_messages(spark, tmp_path)
    assert rows.count() == 3
    assert D.dedup_messages(rows).agg(F.sum("output")).first()[0] == 11
    assert D.dedup_scan(rows).count() == 2


def test_cache_writes_split_by_age(spark, tmp_path):
    split = {"input_tokens": 1, "cache_creation_input_tokens": 9, "cache_creation": {"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 5}, "output_tokens": 1}
    whole = {"input_tokens": 1, "cache_creation_input_tokens": 9, "output_tokens": 1}
    write(tmp_path / "a.jsonl", [message("m1", 0, usage=split), message("m2", 0, usage=whole)])
    assert {(r.message_id, r.cache_w5m, r.cache_w1h) for r in scan_messages(spark, tmp_path).collect()} == {("m1", 4, 5), ("m2", 9, 0)}


def test_subagent_files(spark, tmp_path):
    write(tmp_path / "x" / "subagents" / "agent-7.jsonl", [message("m1", 1)])
    row = scan_messages(spark, tmp_path).first()
    assert row.session_id == "agent:agent-7" and row.parent_session_id == "s1" and row.is_subagent


def test_accounts_of_sessions(spark):
    schema = "session_id string, account_id string"
    telemetry = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "x")], schema)
    support = spark.createDataFrame([("c", "z"), ("d", "w"), ("d", "w"), (None, "q")], schema)
    got = {r.session_id: (r.account_id, r.confidence, r.basis) for r in A.session_accounts(telemetry, support).collect()}
    conflict = ("ambiguous", "ambiguous-account", "account-conflict")
    assert got == {"a": ("x", "session-verified", "telemetry"), "b": conflict, "c": conflict, "d": ("w", "session-verified", "support-session")}


def test_same_message_in_two_sources_counts_twice(spark, tmp_path):
    write(tmp_path / "a.jsonl", [message("m1", 4)])
    rows = scan_messages(spark, tmp_path)
    assert D.dedup_messages(rows.unionByName(rows.withColumn("source_id", F.lit("other")))).count() == 2


def test_offsets_and_the_unfinished_line(spark, tmp_path):
    write(tmp_path / "a.jsonl", ["first é", "second", "third"], end="")
    lines = N.read_lines(spark, [str(tmp_path)])
    assert [r.byte_offset for r in N.with_offsets(lines).orderBy("byte_offset").collect()] == [0, 9, 16]
    listing = N.file_listing(spark, [str(tmp_path)])
    assert N.parsed_offset(lines, listing.withColumn("path", F.concat(F.lit(""), "path"))).first().parsed_offset == 16
    (tmp_path / "b.jsonl").write_bytes(b"ok\na\xff\n")
    assert N.invalid_files(N.read_lines(spark, [str(tmp_path)])).count() in (0, 1)  # Spark may already have replaced the byte
    assert N.limit_files(N.file_listing(spark, [str(tmp_path)]), 1).count() == 1


def test_last_snapshot_of_each_file(spark, tmp_path):
    write(tmp_path / "a.jsonl", [total(10, 4, 1, 0), total(30, 10, 6, 0)])
    row = T.final_snapshot(N.read_lines(spark, [str(tmp_path)]), "s").first()
    assert (row.input, row.cached, row.output, row.provisional) == (20, 10, 6, True)


def test_rollup_sums_the_same_instant(spark, tmp_path):
    write(tmp_path / "a.jsonl", [message("m1", 1), message("m2", 2), message("m3", 3), message("m4", 9, at="2026-07-01T10:00:01Z")])
    rolled = D.rollup_instant(scan_messages(spark, tmp_path)).orderBy("ts").collect()
    assert [(r.event_count, r.output) for r in rolled] == [(3, 6), (1, 9)]
    assert len({r.id for r in rolled}) == 2


@pytest.mark.parametrize("limit, want", [(2, ["4", "5"]), (0, ["5"])])
def test_top_children(spark, limit, want):
    from meterline.operators import summary as S

    rows = spark.createDataFrame([(str(i), 10 * i, i > 0) for i in range(6)], "session_id string, input bigint, is_subagent boolean")
    rows = rows.withColumns({"provider": F.lit("message"), "source_id": F.lit("s"), "parent_session_id": F.lit(None).cast("string"), **{c: F.lit(0).cast("long") for c in ("cached", "cache_w5m", "cache_w1h", "output")}})
    assert sorted(r.session_id for r in S.top_subagents(rows, limit).collect()) == want
    assert sorted(r.session_id for r in S.top_detail(rows, limit).collect()) == want


def test_a_line_is_parsed_once(spark):
    """Conditions on what was parsed do not parse again."""
    lines = spark.createDataFrame([], "path string, byte_offset long, value string").repartition(2)
    for rows in (T.scan_message(lines, "s"), T.scan_counter(lines), T.scan_header(lines), T.scan_tasks(lines)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
