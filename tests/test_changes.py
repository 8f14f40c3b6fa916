"""Upserts, manifests, versions, exports and streams."""

from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterline.operators import attribution as A
from meterline.operators import changes as K
from meterline.operators import counter
from meterline.operators import summary as S
from meterline.schema import COUNTERS, LEDGER
from meterline.sources import lines as N
from meterline.sources import metadata as M
from meterline.sources import store
from meterline.sources.scratch import working_folder
from meterline.sources.transcripts import as_ledger
from meterline.streaming import streams

T0, T1 = datetime(2026, 7, 1), datetime(2026, 7, 2)


def ledger(spark, rows, columns="id string, ts timestamp, input bigint, source_path string, source_id string"):
    df = spark.createDataFrame(rows, columns)
    zeros = {c: F.lit(0).cast("long") for c in COUNTERS if c not in df.columns}
    return as_ledger(df.withColumns(zeros))


def test_upsert_keeps_the_later_row(spark):
    old = ledger(spark, [("a", T1, 1, "f", "s"), ("b", T0, 1, "f", "s"), ("c", T0, 1, "f", "s")])
    new = ledger(spark, [("a", T0, 2, "f", "s"), ("b", T0, 2, "f", "s"), ("d", T0, 2, "f", "s")])
    assert {(r.id, r.input) for r in K.upsert_latest(old, new).collect()} == {("a", 1), ("b", 2), ("c", 1), ("d", 2)}
    both = {r.id: (r.input, r.event_count) for r in K.upsert_accumulate(old, new).collect()}
    assert both == {"a": (3, 2), "b": (3, 2), "c": (1, 1), "d": (2, 1)}


def test_versions_replace_files_and_keep_failed_ones(spark, tmp_path):
    v = store.VersionedLedger(spark, f"file://{tmp_path}/ledger")
    assert v.read() is None
    first = ledger(spark, [("a", T0, 1, "f1", "s"), ("b", T0, 2, "f2", "s")])
    v.refresh(first, first.select("source_path"))
    second = ledger(spark, [("a2", T0, 5, "f1", "s"), ("x", T0, 9, "f2", "s")])
    for _ in range(2):  # running again changes nothing
        v.refresh(second, second.select("source_path"), failed=spark.createDataFrame([("f2",)], "source_path string"))
        assert {(r.id, r.input) for r in v.read().collect()} == {("a2", 5), ("b", 2)}
    removed = spark.createDataFrame([("f1",)], "source_path string")
    v.refresh(first.where("false"), removed)
    assert [r.id for r in v.read().collect()] == ["b"]


def test_manifest_and_guards(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("one\ntwo\n")
    (tmp_path / "b.jsonl").write_text("x\n")
    listing = N.file_listing(spark, [str(tmp_path)])
    before = spark.createDataFrame(listing.collect(), listing.schema)
    assert before.count() == 2
    guard = {r.path: r.head for r in K.content_guard(N.with_offsets(N.read_lines(spark, [str(tmp_path)])), F.lit(8)).collect()}
    with open(tmp_path / "a.jsonl", "a") as f:
        f.write("three\n")
    (tmp_path / "b.jsonl").unlink()
    (tmp_path / "c.jsonl").write_text("new\n")
    states = {r.path[-7:]: r.state for r in K.diff_manifest(N.file_listing(spark, [str(tmp_path)]), before).collect()}
    assert states == {"a.jsonl": "changed", "b.jsonl": "removed", "c.jsonl": "new"}
    again = {r.path: r.tail for r in K.content_guard(N.with_offsets(N.read_lines(spark, [str(tmp_path)])), F.lit(8)).collect()}
    path = next(p for p in guard if p.endswith("a.jsonl"))
    assert again[path] == guard[path]  # an append leaves what was before the cursor


def test_scopes(spark):
    scopes = spark.createDataFrame([("/a",), ("/a/b",), ("/c/",)], "scope string")
    assert sorted(r.scope for r in K.narrow_scopes(scopes).collect()) == ["/a/b", "/c/"]
    paths = spark.createDataFrame([("/a/b/x",), ("/a/bc",), ("/c/y",), ("/d",)], "path string")
    assert sorted(r.path for r in K.scope_filter(paths, K.narrow_scopes(scopes)).collect()) == ["/a/b/x", "/c/y"]


def test_empty_source_list_is_no_rows(spark):
    rows = ledger(spark, [("a", T0, 1, "f", "s")])
    assert store.filtered(rows, source_ids=[]).count() == 0
    assert store.filtered(rows).count() == 1
    assert store.filtered(rows, start=T0, end=T1).count() == 1 and store.filtered(rows, end=T0).count() == 0
    sources = spark.createDataFrame([("s", False)], "source_id string, enabled boolean")
    assert store.enabled(rows, sources).count() == 0


def test_threads_enrich_stored_rows(spark):
    rows = ledger(spark, [("a", T0, 1, "/f1", "s"), ("b", T0, 1, "/f2", "s")]).withColumns({"provider": F.lit("counter"), "model": F.lit("unknown"), "session_id": F.lit("old"), "is_subagent": F.lit(False)})
    threads = M.read_threads(spark.createDataFrame([("t1", "/f1", "sol", None), ("t2", None, "x", None)], "id string, rollout_path string, model string, agent_path string"), spark.createDataFrame([("p", "t1")], "parent_thread_id string, child_thread_id string"))
    got = {r.id: (r.session_id, r.parent_session_id, r.is_subagent, r.model) for r in A.enrich_threads(rows, threads).collect()}
    assert got == {"a": ("t1", "p", True, "sol"), "b": ("old", None, False, "unknown")}


def test_telemetry_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"event_data": {"session_id": "s1", "auth": {"account_uuid": "x"}}}')
    (tmp_path / "b.json").write_text('{"session_id": "s2", "auth": {"account_uuid": "y"}}')
    (tmp_path / "c.json").write_text('{"other": 1}')
    assert {tuple(r) for r in M.read_account_telemetry(spark, str(tmp_path)).collect()} == {("s1", "x"), ("s2", "y")}
    d = tmp_path / "sessions" / "acct-9"
    d.mkdir(parents=True)
    (d / "s.json").write_text('{"sessionId": "s3"}')
    assert [tuple(r) for r in M.read_account_support(spark, str(tmp_path / "sessions")).collect()] == [("s3", "acct-9")]


def test_export_hides_names(spark, tmp_path):
    accounts = spark.createDataFrame([("message", "src-a", "kim@x", None, 5), ("message", "src-a", "unattributed", "kim@x", 6)], "provider string, source_id string, account_id string, current_auth_account_id string, tokens bigint")
    models = spark.createDataFrame([("message", "opus", 11)], "provider string, model string, tokens bigint")
    store.export_report(accounts, models, str(tmp_path / "r"))
    text = "".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect())
    assert "kim" not in text and "src-a" not in text and all(x in text for x in ("source-1", "account-1", "current-auth-1", "unattributed"))


def test_headline_is_bound_to_its_sources(spark, tmp_path):
    store.save_headline(spark.createDataFrame([(5,)], "tokens bigint"), ["b", "a"], "2026-07-01", str(tmp_path / "h"))
    assert store.load_headline(spark, ["a", "b"], "2026-07-01", str(tmp_path / "h")).count() == 1
    assert store.load_headline(spark, ["a"], "2026-07-01", str(tmp_path / "h")).count() == 0
    assert store.load_headline(spark, ["a", "b"], "2026-07-02", str(tmp_path / "h")).count() == 0


def test_reattribution_keeps_verified_rows(spark):
    rows = ledger(spark, [("a", T0, 1, "f", "s"), ("b", T0, 1, "f", "s")]).withColumns({"provider": F.lit("message"), "session_id": F.col("id"), "is_subagent": F.lit(False), "account_id": F.lit("x"), "attribution_confidence": F.when(F.col("id") == "a", "session-verified").otherwise("source-only"), "attribution_basis": F.lit("telemetry")})
    none = A.session_accounts(*[spark.createDataFrame([], "session_id string, account_id string")] * 2)
    got = {r.id: (r.account_id, r.attribution_confidence) for r in A.reattribute(rows, none).collect()}
    assert got == {"a": ("x", "session-verified"), "b": ("unattributed", "source-only")}


def test_provisional_and_diagnostics(spark):
    sources = spark.createDataFrame([("a", "events", False), ("b", "events", False)], "source_id string, mode string, pending boolean")
    coarse = spark.createDataFrame([("a",)], "source_id string")
    assert S.is_provisional(sources, coarse, filtered=True).first()[0] and not S.is_provisional(sources, coarse, filtered=False).first()[0]
    files = spark.createDataFrame([(1, 0), (2, 0)], "duplicates bigint, stale bigint")
    assert tuple(S.diagnostics_total(files).first()) == (3, 0, True, False)


def test_stream_state_lives_between_runs(spark, tmp_path):
    schema = "path string, byte_offset bigint, model string, " + ", ".join(f"tot_{c} bigint" for c in COUNTERS)

    def segment(name, rows):
        spark.createDataFrame([("f", o, m, *t) for o, m, *t in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = streams.counter_deltas(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.byte_offset, r.model, r.input, r.output) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    segment("a", [(2, None, 20, 0, 0, 0, 2, 0), (1, "m", 10, 0, 0, 0, 1, 0)])
    assert run() == [(1, "m", 10, 1), (2, "m", 10, 1)]
    segment("b", [(3, None, 15, 0, 0, 0, 1, 0), (4, None, 50, 0, 0, 0, 2, 0)])
    assert run()[2:] == [(4, "m", 30, 0)]


def test_stream_classes_equal_the_batch_operator(spark, tmp_path):
    """Stated usage, duplicates, stale and falling snapshots, nulls, forks and lines that only name
    a model, in three runs of the stream against all rows at once."""
    rng = np.random.default_rng(5)
    schema = "path string, byte_offset bigint, model string, forked boolean, " + ", ".join(f"{c} bigint" for c in (*counter.TOTALS, *counter.LASTS))
    parts = ([], [], [])
    for path in ("a", "b", "fork"):
        total, offset = np.zeros(6, int), 0
        for at in range(60):
            part = parts[0 if at < 2 else 1 if at < 30 else 2]
            line = (path, [None, "", "m1", "m2"][rng.integers(4)], path == "fork", *[None] * 12)
            if at > 1 and rng.random() < 0.9:
                total = np.maximum(0, total + rng.integers(-3, 9, 6)) if rng.random() < 0.5 else total
                last = [None if rng.random() < 0.3 else int(x) for x in rng.integers(-1, 4, 6)] if rng.random() < 0.5 else [None] * 6
                line = (*line[:3], *total.tolist(), *last)
            for _ in range(2 if rng.random() < 0.3 else 1):
                part.append((path, offset, *line[1:]))
                offset += 7
    rows = [r for part in parts for r in part]
    whole = counter.active_model(counter.classify(spark.createDataFrame(rows, schema), ["byte_offset"], F.col("forked")), ["byte_offset"])
    shown = ["path", "byte_offset", "active_model", "status", "accepted", "decreased", "explicit", *[f"use_{c}" for c in COUNTERS]]
    want = sorted(map(tuple, whole.where("is_snapshot").select(shown).collect()))
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).repartition(2, "path").write.parquet(f"{tmp_path}/in/{k}")
        stream = streams.classified(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.select(shown).collect())) == want
    assert {r[3] for r in want} == {"accepted", "duplicate", "stale"} and any(r[5] for r in want) and any(r[6] for r in want)
    wanted, found = (sorted(map(tuple, counter.diagnostics(d, ["byte_offset"]).collect())) for d in (whole, got))
    assert found == wanted


def test_ledger_schema_round_trip(spark, tmp_path):
    rows = ledger(spark, [("a", T0, 1, "f", "s")])
    store.write_ledger(rows, str(tmp_path / "l"))
    back = store.read_ledger(spark, str(tmp_path / "l"), start=T0, source_ids=["s"])
    assert back.count() == 1 and set(back.columns) == {f.name for f in LEDGER.fields}


@pytest.mark.parametrize("name", ["cost_by_model", "counter_classify", "scope_filter"])
def test_registered_queries_run(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert name in e.oracle_sql()


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        working_folder(session, "x")


def test_many_transcripts_share_one_state():
    """A key's rows of many transcripts are handled at once, with one read and one write of the state,
    and give what each transcript gives by itself."""

    class Value:
        held, writes = None, 0

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held, self.writes = value, self.writes + 1

    def state():
        value, made = Value(), streams.CounterState()
        made.init(type("Handle", (), {"getValueState": lambda self, *_: value})())
        return made, value

    rng = np.random.default_rng(3)
    columns = [*counter.TOTALS, *counter.LASTS]
    rows = pd.DataFrame(rng.integers(0, 40, (2000, 12)).astype(float), columns=columns)
    rows.loc[rng.random(2000) < 0.1, columns] = np.nan
    rows["path"], rows["byte_offset"] = rng.integers(0, 50, 2000).astype(str), np.arange(2000)
    rows["model"] = rng.choice(["a", "b", "", None], 2000)
    batches = [rows[:700], rows[700:]]
    together, value = state()
    got = pd.concat([x for b in batches for x in together.handleInputRows((1,), iter([b[:100], b[100:]]), None)])
    assert value.writes == 2
    alone = []
    for path, _ in rows.groupby("path"):
        one, _ = state()
        alone += [x for b in batches for x in one.handleInputRows((1,), iter([b[b["path"] == path]]), None)]
    want = pd.concat(alone)
    order = ["path", "byte_offset"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))


def test_a_batch_is_worked_out_once(spark, tmp_path):
    """An upsert of a stream runs the steps before it once a batch, however often it reads the rows."""
    from meterline.sources.buckets import BucketStore

    rows = spark.range(100).selectExpr("cast(id as string) id", "timestamp '2024-01-01' ts", "id byte_offset", "'s' source_id")
    rows.write.parquet(f"{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    store = BucketStore(spark, f"file:{tmp_path}/store")
    table = store.table("rows", rows.schema, "id", ("id",), buckets=4)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in").mapInArrow(counted, rows.schema)
    streams.upsert_buckets(stream, store, "rows", f"{tmp_path}/state").awaitTermination()
    assert table.read().count() == 100 and seen.value == 100
