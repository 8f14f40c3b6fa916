"""Parts of files, the bucketed store and the refresh, against reads of everything from the start."""

import json
import os
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from meterline.plans import growing as G
from meterline.schema import LEDGER
from meterline.sources import byte_ranges as B
from meterline.sources import lines as N
from meterline.sources.buckets import BucketStore
from meterline.sources.refresh import LedgerStore, refresh

from .test_transcripts import FORK, message, total, turn

THREADS = "id string, path string, model string, parent_id string, is_subagent boolean"


def put(path, rows, end="\n", mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in rows) + end)


def parts(spark, *rows):
    return spark.createDataFrame(rows, "path string, start long, stop long")


@pytest.mark.parametrize("chunk,back", [(1, 1), (5, 3), (1000, 64)])
def test_lines_of_any_part(tmp_path, monkeypatch, chunk, back):
    """Every cut, with reads of few bytes: the parts' lines are the file's."""
    monkeypatch.setattr(B, "CHUNK", chunk)
    monkeypatch.setattr(B, "STEP_BACK", back)
    data = "a\n\nébc\n".encode() + b"longer line\nrest"
    (tmp_path / "a").write_bytes(data)
    want = [(0, b"a"), (2, b""), (3, "ébc".encode()), (8, b"longer line"), (20, b"rest")]
    for cut in range(len(data)):
        got = []
        for start, stop in ((0, cut), (cut, len(data))):
            for place, block, ended in B._Reader(str(tmp_path / "a")).lines(start, stop, start == 0, stop == len(data)):
                for line in (block[:-1] if ended else block).split(b"\n"):
                    got.append((place, line))
                    place += len(line) + 1
        assert got == want, cut


@pytest.mark.parametrize("split", [1, 7, 1000])
def test_any_cut_gives_each_line_once(spark, tmp_path, split):
    text = "".join(f"{'é' * (i % 4)}line{i}\n" for i in range(12)) + "\n\nlast"
    (tmp_path / "a").write_text(text)
    data, at, want = text.encode(), 0, []
    for line in data.split(b"\n"):
        want.append((at, line.decode(), at + len(line) < len(data)))
        at += len(line) + 1
    got = B.read_ranges(parts(spark, (f"file:{tmp_path}/a", 0, len(data)), (f"file:{tmp_path}/a", 0, 0)), split_bytes=split)
    assert sorted((r.byte_offset, r.value, r.ended) for r in got.collect()) == want
    assert all(r.valid for r in got.collect())


def test_small_splits_and_small_files_share_tasks(spark, tmp_path):
    """The tasks follow the bytes, not the number of splits or files."""
    for k in range(40):
        put(tmp_path / f"{k}.jsonl", [f"line {i}" for i in range(50)])
    sizes = {f"file:{f}": f.stat().st_size for f in tmp_path.iterdir()}
    got = B.read_ranges(parts(spark, *[(p, 0, n) for p, n in sizes.items()]), split_bytes=20)
    assert got.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert got.count() == got.select("path", "byte_offset").distinct().count() == 2000
    assert N.file_listing(spark, [str(tmp_path)]).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    reader = B._GrowingReader({"roots": "[]", "split_bytes": 20, "tasks": 4})
    planned = reader.partitions({}, sizes)
    assert len(planned) <= 5
    assert sum(b.num_rows for p in planned for b in reader.read(p)) == 2000


def test_small_files_share_batches(spark, tmp_path):
    """A batch of many files holds each one's lines at their own offsets, and what is kept of its part."""
    texts = ["one\ntwo\n", "\n", "no end", "", "\n\nlong é line\nx", "bad \udcff\nb\n"]
    for k, text in enumerate(texts):
        (tmp_path / str(k)).write_bytes(text.encode("utf-8", "surrogateescape"))
    files = [(f"file:{tmp_path}/{k}", 0, (tmp_path / str(k)).stat().st_size, str(k)) for k in range(len(texts))]
    got = B.read_ranges(spark.createDataFrame(files, "path string, start long, stop long, name string"), keep=("name",))
    want = []
    for k, text in enumerate(texts):
        data, at = text.encode("utf-8", "surrogateescape"), 0
        for line in data.split(b"\n"):
            if at < len(data):
                ok = line.decode("utf-8", "replace").encode() == line
                want.append((str(k), at, line.decode("utf-8", "replace"), at + len(line) < len(data), ok))
            at += len(line) + 1
    rows = got.collect()
    assert sorted((r.name, r.byte_offset, r.value, r.ended, r.valid) for r in rows) == sorted(want)
    assert all(r.path.endswith(f"/{r.name}") for r in rows)
    reader = B._GrowingReader({"roots": "[]", "tasks": 1})
    planned = reader.partitions({}, {path: n for path, _, n, _ in files})
    assert [len(list(reader.read(p))) for p in planned] == [1]


def test_batches_follow_their_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(B, "BATCH", 10)
    held, got = B._Blocks(), []
    for k in range(7):
        if held.add(k, str(k), 5 * k, b"a\nbc\n", True):
            got.append([c.to_pylist() for c in held.columns()])
    assert [len(g[0]) for g in got] == [4, 4, 4]
    assert got[1][:3] == [["2", "2", "3", "3"], [10, 12, 15, 17], ["a", "bc", "a", "bc"]]


def test_files_are_removed_in_tasks(spark, tmp_path):
    """Those that are not there are passed over."""
    for k in range(3):
        put(tmp_path / "a" / f"{k}.jsonl", ["x"])
        put(tmp_path / "b" / f"{k}.jsonl", ["x"])
    G._remove(spark.createDataFrame([(f"file://{tmp_path}/a", 1), (f"{tmp_path}/b", 2), (f"{tmp_path}/b", 9)], "folder string, file long"))
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.jsonl")) == ["a/0.jsonl", "a/2.jsonl", "b/0.jsonl", "b/1.jsonl"]


def test_both_providers_are_written_out_of_one_exchange(spark, tmp_path, monkeypatch):
    """Every file of a state in its folder, its lines in order, by one job of one shuffle."""
    turns = [(c, t, "user", "x" * (c + t)) for c in range(12) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    plans = []
    kept = G._write_dealt
    monkeypatch.setattr(G, "_write_dealt", lambda rows, order: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), kept(rows, order)))
    G._put(spark, str(tmp_path), f"file://{tmp_path}/out", later=True)
    assert len(plans) == 1 and plans[0].count("Exchange") == 1
    files = {str(f.relative_to(tmp_path / "out")): [json.loads(x) for x in f.read_text().splitlines()] for f in (tmp_path / "out").rglob("*.jsonl")}
    assert files.keys() == {f"{p}/{'archived' if k % 2 else 'live'}/{k}.jsonl" for p in ("counter", "message") for k in range(3)}
    assert [x["message"]["id"] for x in files["message/archived/1.jsonl"]] == [f"m-{c}-{t // 2}" for c in range(5, 10) for t in range(3)]
    kinds = [x["payload"].get("type", x["type"]) for x in files["counter/live/2.jsonl"]]
    assert kinds == ["session_meta", *(["task_started"] + ["turn_context", "token_count"] * 3) * 2]
    assert files["counter/archived/1.jsonl"][0]["payload"] == {"id": "h1", "forked_from_id": "o1"}


def test_only_the_part_is_read(spark, tmp_path):
    put(tmp_path / "a.jsonl", [f"line {i}" for i in range(10_000)])
    size = (tmp_path / "a.jsonl").stat().st_size
    put(tmp_path / "a.jsonl", [f"new {i}" for i in range(100)], mode="a")
    now = (tmp_path / "a.jsonl").stat().st_size
    meter = spark.sparkContext.accumulator(0)
    got = B.read_ranges(parts(spark, (str(tmp_path / "a.jsonl"), size, now)), meter=meter).collect()
    assert [r.value for r in sorted(got, key=lambda r: r.byte_offset)] == [f"new {i}" for i in range(100)]
    assert got and meter.value == now - size < 0.02 * now


def test_bad_bytes_and_parts_of_files_that_shrank(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"ok\na\xff\nfine\nx\xe4\xb8")
    path = str(tmp_path / "a")
    got = {r.byte_offset: (r.ended, r.valid) for r in B.read_ranges(parts(spark, (path, 0, 14))).collect()}
    assert got == {0: (True, True), 3: (True, False), 6: (True, True), 11: (False, False)}
    assert B.read_ranges(parts(spark, (path, 3, 500))).count() == 3
    ends = B.parsed_ends(B.read_ranges(parts(spark, (path, 0, 14)))).first()
    assert (ends.parsed_offset, ends.valid) == (11, False)


def test_offsets_of_split_files_come_from_several_tasks(spark, tmp_path):
    put(tmp_path / "a.jsonl", [f"{'x' * (i % 50)}{i}" for i in range(5000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = N.read_lines(spark, [str(tmp_path)])
        placed = N.with_offsets(lines)
        assert lines.select("block").distinct().count() > 5
        windows = re.findall(r"Window \[.*\], \[([^\]]*)\], \[([^\]]*)\]", placed._jdf.queryExecution().optimizedPlan().toString())
        # the lines by file and block, the sums of blocks by file
        assert sorted(re.sub(r"#\d+L?", "", " / ".join(w)) for w in windows) == ["path / block ASC NULLS FIRST", "path, block / seq ASC NULLS FIRST"]
        got = [(r.byte_offset, r.value) for r in placed.orderBy("byte_offset").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    data, at = (tmp_path / "a.jsonl").read_text().split("\n")[:-1], 0
    for (offset, value), line in zip(got, data):
        assert (offset, value) == (at, line)
        at += len(line) + 1
    assert len(got) == len(data)


def ledger_of(store):
    return sorted(str(tuple(r)) for r in store.ledger.read().select(LEDGER.names).collect())


def counts(store):
    return sorted((r.path, r.saved.duplicates, r.saved.stale, r.saved.decreased, r.saved.last == r.saved.water) for r in store.manifest.read().where("saved is not null").collect())


@pytest.fixture
def run(spark, tmp_path):
    sources = spark.createDataFrame(
        [("c", "counter", [f"{tmp_path}/c/live", f"{tmp_path}/c/archived"], True), ("m", "message", [f"{tmp_path}/m"], True), ("gone", "message", [f"{tmp_path}/nowhere"], True), ("off", "message", [f"{tmp_path}/off"], False)],
        "source_id string, provider string, roots array<string>, enabled boolean",
    )
    threads = spark.createDataFrame([], THREADS)
    limits = spark.createDataFrame([("m", 100)], "model string, lc_threshold bigint")

    def go(name="store", full=False):
        store = LedgerStore(spark, f"file://{tmp_path}/{name}", buckets=8)
        return refresh(store, sources, threads, limits, full=full), store

    return go


def test_refresh_equals_a_read_of_everything(spark, tmp_path, run):
    rng = random.Random(2)
    live, archived = tmp_path / "c" / "live", tmp_path / "c" / "archived"

    def some(n, base):
        rows = []
        for _ in range(n):
            base = [max(0, x + rng.choice((-2, 0, 5, 9))) for x in base]
            rows.append(total(*base, last=tuple(rng.choice((0, 3, 200)) for _ in range(4)) if rng.random() < 0.5 else None))
            if rng.random() < 0.3:
                rows.append(turn(rng.choice("mn")))
            if rng.random() < 0.2:
                rows.append(rows[-1])
        return rows, base

    base = {}
    for i in range(6):
        rows, base[i] = some(8, [10, 5, 5, 1])
        put(live / f"{i}.jsonl", rows)
    put(archived / "old.jsonl", some(3, [4, 1, 1, 0])[0])
    put(archived / "fork.jsonl", FORK[:4])
    put(tmp_path / "m" / "a.jsonl", [message("x", 3), message("y", 4)], end="")
    put(tmp_path / "m" / "b.jsonl", [message("x", 3)])
    put(tmp_path / "off" / "z.jsonl", [message("z", 1)])
    (tmp_path / "m" / "bad.jsonl").write_bytes(b'{"type"\xff\n')
    first, store = run()
    assert (first.new, first.failed, first.missing_sources, first.provisional) == (11, 1, ("gone",), False)
    assert first.line_bytes == sum(f.stat().st_size for d in (live, archived, tmp_path / "m") for f in d.iterdir())

    again, _ = run()  # the bad file is tried again, and nothing else
    assert (again.unchanged, again.changed, again.new, again.line_bytes) == (10, 1, 0, 9)
    put(tmp_path / "m" / "bad.jsonl", [message("w", 9)])
    mended, store = run()
    assert mended.changed == 1 and store.ledger.read().where("message_id = 'w'").count() == 1
    stamps = {f: os.stat(f).st_mtime_ns for f in (str(p) for p in (tmp_path / "store" / "ledger").rglob("part-*"))}
    quiet, store = run()
    assert quiet.unchanged == 11 and quiet.line_bytes == 0 and quiet == quiet._replace(new=0, changed=0, appended=0, removed=0)
    assert stamps == {f: os.stat(f).st_mtime_ns for f in (str(p) for p in (tmp_path / "store" / "ledger").rglob("part-*"))}

    more, base[0] = some(6, base[0])
    size = (live / "0.jsonl").stat().st_size
    put(live / "0.jsonl", more, mode="a", end="")  # a last line without an end
    text = (live / "1.jsonl").read_text()
    (live / "1.jsonl").write_text(text.replace('"input_tokens":', '"input_tokens":1', 1) + "\n")  # rewritten and longer
    (live / "2.jsonl").unlink()
    put(archived / "fork.jsonl", FORK[4:], mode="a")
    put(tmp_path / "m" / "a.jsonl", ["", message("x", 8, at="2026-07-01T11:00:00Z"), message("v", 2)], mode="a")
    put(tmp_path / "m" / "new.jsonl", [message("u", 1)])
    grown, store = run()
    assert (grown.appended, grown.changed, grown.removed, grown.new, grown.provisional) == (2, 2, 1, 1, True)
    whole = [live / "1.jsonl", archived / "fork.jsonl", tmp_path / "m" / "new.jsonl"]
    cursor = json.dumps(message("x", 3), separators=(",", ":"))
    parts_read = (live / "0.jsonl").stat().st_size - size + (tmp_path / "m" / "a.jsonl").stat().st_size - len(cursor) - 1
    assert grown.line_bytes == sum(f.stat().st_size for f in whole) + parts_read
    moved = [f for f, t in stamps.items() if not os.path.exists(f) or os.stat(f).st_mtime_ns != t]
    assert 0 < len(moved) < len(stamps)
    _, fresh = run("fresh")
    assert ledger_of(store) == ledger_of(fresh)

    put(live / "0.jsonl", [*[""], *some(5, base[0])[0]], mode="a")
    ended, store = run()
    assert ended.appended == 1
    _, fresh = run("fresh2")
    assert ledger_of(store) == ledger_of(fresh) and counts(store) == counts(fresh)

    final, store = run(full=True)  # appended files are read again
    assert final.changed == 2 and not final.provisional and ledger_of(store) == ledger_of(fresh)
    store.remove_sources(["m"])
    assert {r.source_id for r in store.ledger.read().select("source_id").distinct().collect()} == {"c"}
    assert store.manifest.read().where("source_id = 'm'").count() == 0


def test_a_run_that_dies_is_finished_or_undone(spark, tmp_path, run, monkeypatch):
    put(tmp_path / "m" / "a.jsonl", [message("x", 3)])
    put(tmp_path / "c" / "live" / "a.jsonl", [total(1, 0, 1, 0)])
    with monkeypatch.context() as m:
        m.setattr(BucketStore, "_apply", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            run()
    done, store = run()  # the marked commit is put in place first
    assert (done.unchanged, done.new) == (2, 0) and store.ledger.read().count() == 2
    put(tmp_path / "m" / "a.jsonl", [message("y", 4)], mode="a")
    with monkeypatch.context() as m:
        m.setattr("meterline.sources.buckets.json", SimpleNamespace(dumps=lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))))
        with pytest.raises(RuntimeError, match="lost"):
            run()
    assert store.ledger.read().count() == 2
    done, store = run()
    assert done.appended == 1 and store.ledger.read().count() == 3 and not any((tmp_path / "store" / "pending").iterdir())


def test_upsert_writes_touched_buckets_and_each_batch_once(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/t")
    schema = spark.createDataFrame([], "id string, source_id string, ts timestamp, v long").schema
    table = store.table("rows", schema, "id", ("id",), buckets=64)
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    first = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("source_id"), at.alias("ts"), F.lit(0).cast("long").alias("v"))
    assert store.upsert("rows", first, "stream", 0)
    stamps = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").rglob("part-*")}
    one = first.where("id = '7'").withColumn("v", F.lit(5).cast("long"))
    assert store.upsert("rows", one, "stream", 1)
    now = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t" / "rows").rglob("part-*")}
    assert len(now.items() - stamps.items()) == 1 and len(stamps) == 64
    assert not store.upsert("rows", one.withColumn("v", F.lit(6).cast("long")), "stream", 1)
    assert table.read().where("id = '7'").first().v == 5 and table.read().count() == 2000
    assert not store.upsert("rows", one.withColumn("v", F.lit(6).cast("long")), "stream", 0)


def test_growing_files_give_each_line_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/state"

    def drain():
        stream = B.stream_growing(spark, [str(folder)], split_bytes=40)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path[-7:], r.byte_offset, r.value) for r in spark.read.schema(stream.schema).parquet(out).collect())

    def whole():
        want = []
        for f in sorted(folder.iterdir()):
            at = 0
            for line in f.read_bytes().split(b"\n")[:-1]:
                want.append((f.name, at, line.decode()))
                at += len(line) + 1
        return sorted(want)

    put(folder / "a.jsonl", [f"first {i}" for i in range(20)], end="\nhal")
    put(folder / "b.jsonl", ["only"])
    assert drain() == whole()
    put(folder / "a.jsonl", ["f a line", *[f"second é {i}" for i in range(9)]], mode="a")
    put(folder / "a.jsonl", ["third"], mode="a")  # grew twice before the next trigger
    put(folder / "c.jsonl", ["new"], end="")
    assert drain() == whole()  # a new query from the checkpoint
    put(folder / "c.jsonl", [" and ended"], mode="a")
    assert drain() == whole()
    assert drain() == whole()


def files_of(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("part-*")}


def test_metadata_rewrites_only_what_differs(spark, tmp_path, run):
    from meterline.sources.refresh import apply_accounts, apply_threads

    for i in range(12):
        put(tmp_path / "m" / f"{i}.jsonl", [message(f"x{i}", 3, session=f"s{i}")])
    put(tmp_path / "c" / "live" / "rollout.jsonl", [total(60, 30, 15, 0)])
    put(tmp_path / "c" / "live" / "other.jsonl", [total(6, 3, 1, 0)])
    _, store = run()
    schema = "session_id string, account_id string, confidence string, basis string"
    rows = [(f"s{i}", "acct", "session-verified", "telemetry") for i in range(11)]
    assert apply_accounts(store, "m", spark.createDataFrame(rows, schema)) == 11
    before = files_of(tmp_path / "store" / "ledger")
    moved = [("s3", "moved", "session-verified", "telemetry"), *(r for r in rows if r[0] != "s3")]
    assert apply_accounts(store, "m", spark.createDataFrame(moved, schema)) == 1
    assert apply_accounts(store, "m", spark.createDataFrame(moved, schema)) == 0
    assert len(files_of(tmp_path / "store" / "ledger").items() - before.items()) == 1
    got = {r.session_id: r.account_id for r in store.ledger.read().where("source_id = 'm'").collect()}
    assert got == {f"s{i}": "moved" if i == 3 else "acct" if i < 11 else "unattributed" for i in range(12)}

    path = next(r.path for r in store.manifest.read().where("path like '%rollout%'").collect())
    threads = spark.createDataFrame([("t1", path, "sol", "p", True)], THREADS)
    assert apply_threads(store, "c", threads) == 1 and apply_threads(store, "c", threads) == 0
    got = {r.source_path[-9:]: (r.session_id, r.model, r.parent_session_id) for r in store.ledger.read().where("source_id = 'c'").collect()}
    assert got == {"out.jsonl": ("t1", "sol", "p"), "her.jsonl": ("other", "unknown", None)}
    quiet, _ = run()
    assert quiet.line_bytes == 0 and quiet.unchanged == 14


def test_cursors_wait_and_are_tried_again(spark, tmp_path, run):
    put(tmp_path / "m" / "a.jsonl", [message("x", 3)])
    (tmp_path / "m" / "b.jsonl").write_bytes(b"\xff\n")
    _, store = run()
    states = lambda: {r.path[-7:]: r.state for r in store.cursors().collect()}
    assert states() == {"a.jsonl": "reconciled", "b.jsonl": "retry"} and not store.provisional().first().provisional
    put(tmp_path / "m" / "a.jsonl", [message("y", 3)], mode="a")
    run()
    assert states()["a.jsonl"] == "pending" and store.provisional(["m"]).first().provisional and not store.provisional(["c"]).first().provisional
    run(full=True)
    assert states() == {"a.jsonl": "reconciled", "b.jsonl": "retry"}


def test_report_is_one_document(spark, tmp_path):
    from meterline.sources.store import export_document

    sources = spark.createDataFrame([("src-b", "message", True, 20.0), ("src-a", "counter", False, 0.0)], "source_id string, provider string, enabled boolean, monthly_usd double")
    accounts = spark.createDataFrame([("message", "src-b", "kim@x", None, 5), ("counter", "src-a", "unattributed", "kim@x", 6), ("message", "gone", "kim@x", None, 7)], "provider string, source_id string, account_id string, current_auth_account_id string, tokens bigint")
    totals = spark.createDataFrame([(18,)], "tokens bigint")
    export_document(f"{tmp_path}/r", {"timezone": "UTC"}, sources, totals, accounts=accounts, models=accounts.where("false").select("tokens"))
    (text,) = (r.value for r in spark.read.text(f"{tmp_path}/r").collect())
    doc = json.loads(text)
    assert "kim" not in text and "src-" not in text
    assert [s["id"] for s in doc["sources"]] == ["source-1", "source-2"] and [s["provider"] for s in doc["sources"]] == ["counter", "message"]
    assert doc["schema_version"] == 1 and doc["summary"]["totals"] == {"tokens": 18} and doc["summary"]["models"] == []
    assert [(a["source_id"], a["account_id"], a.get("current_auth_account_id")) for a in doc["summary"]["accounts"]] == [("source-1", "unattributed", "current-auth-1"), ("unknown-source", "account-1", None), ("source-2", "account-1", None)]


def test_boundaries_from_the_end_read_little(spark, tmp_path):
    from meterline.sources import transcripts as T
    from meterline.sources.refresh import materialised

    from .test_transcripts import CREATED, header, task

    old = [header("p"), *[x for i in range(8000) for x in (task(CREATED - 9000 + i), total(i, 0, i, 0))]]
    own = [x for i in range(6) for x in (task(CREATED + 5 + i), total(900 + i, 0, 900, 0))]
    put(tmp_path / "own.jsonl", [*old, *own])
    put(tmp_path / "none.jsonl", old)
    put(tmp_path / "all.jsonl", [header("p"), *own])
    put(tmp_path / "odd.jsonl", [*old, {"timestamp": "x", "payload": {"type": "task_started"}}, *own])
    put(tmp_path / "mixed.jsonl", [*old, *own, task(CREATED - 1)])
    listing = N.file_listing(spark, [str(tmp_path)])
    lines = B.read_ranges(B.whole_files(listing))
    forks = T.scan_header(lines).join(listing.select("path", "size"), "path").select("path", "size", "header_id", "created")
    meter = spark.sparkContext.accumulator(0)
    got = {r.path.rsplit("/", 1)[1]: (r.boundary, r.own_start) for r in T.boundaries_from_end(forks, materialised, 500, meter).collect()}
    start = lines.where("path like '%own.jsonl' and value like '%task_started%'").orderBy("byte_offset").collect()[8000].byte_offset
    assert got["own.jsonl"] == ("found", start) and got["none.jsonl"] == ("none", None)
    assert got["all.jsonl"][0] == "found" and got["odd.jsonl"] == ("ambiguous", None)
    assert got["mixed.jsonl"] == ("ambiguous", None)
    assert meter.value < 0.2 * sum(f.stat().st_size for f in tmp_path.iterdir())
