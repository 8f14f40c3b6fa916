"""Ranges from stored day rows against the direct path."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from meterline.operators import days as Y
from meterline.operators import dedup as D
from meterline.operators import summary as S
from meterline.plans import views as W

SF = "/root/testdata/sf0.001"
BOUNDS = [
    (datetime(2024, 1, 3, 7, 30), datetime(2024, 1, 22, 16, 20)),  # cuts two days, over a mid-month change
    (datetime(2024, 1, 3), datetime(2024, 1, 22)),
    (datetime(2024, 1, 5, 1), datetime(2024, 1, 5, 23)),  # inside a day
    (datetime(2024, 1, 5, 13), datetime(2024, 1, 6, 2)),  # no whole day
    (None, datetime(2024, 1, 9, 12)), (datetime(2024, 1, 20, 5), None), (None, None),
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows, card = D.dedup_messages(W.ledger(spark, SF)).cache(), W.rate_card(spark)
    table = Y.DayTable(spark, f"file://{tmp_path_factory.mktemp('days')}/t")
    table.write(rows, card)
    return rows, card, table


def shown(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("start,end", BOUNDS)
def test_ranges_equal_the_direct_path(stored, start, end):
    rows, card, table = stored
    held = F.lit(True) if start is None else F.col("ts") >= F.lit(start)
    held = held if end is None else held & (F.col("ts") < F.lit(end))
    direct = S.direct(rows.where(held), card, ["provider", "model"])
    assert shown(Y.range_summary(table.sums(), rows, card, start, end, ["provider", "model"])) == shown(direct)
    assert Y.range_sessions(table.sessions(), rows, start, end).first() == S.session_count(rows.where(held)).first()


def test_fewer_rows_are_read(stored):
    rows, card, table = stored
    whole, edges = Y._parts(table.sums(), rows, *BOUNDS[0])
    read = whole.count() + edges.count()
    direct = rows.where((F.col("ts") >= F.lit(BOUNDS[0][0])) & (F.col("ts") < F.lit(BOUNDS[0][1]))).count()
    assert edges.count() < 0.2 * direct and read < direct


def test_sketches_merge_within_their_error(spark, stored):
    rows, _, table = stored
    for start, end in BOUNDS:
        exact = Y.range_sessions(table.sessions(), rows, start, end).first().sessions
        assert abs(Y.range_sessions_estimate(table.sums(), rows, start, end).first().sessions - exact) <= max(2, 0.05 * exact)
    card = W.rate_card(spark)
    many = rows.limit(1).drop("session_id").crossJoin(spark.range(50_000).select(F.col("id").cast("string").alias("session_id"))).select(rows.columns)
    many = many.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("session_id").cast("long") % 20 * 86_400))
    estimate = Y.range_sessions_estimate(Y.day_rows(many, card), many, datetime(2024, 1, 2), datetime(2024, 1, 12)).first().sessions
    assert abs(estimate - 25_000) < 0.05 * 25_000


def test_only_changed_days_are_written(spark, stored, tmp_path):
    rows, card, _ = stored
    table = Y.DayTable(spark, f"file://{tmp_path}/t")
    table.write(rows, card)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*")}
    after = rows.where("to_date(ts) <> '2024-01-05'").withColumn("input", F.when(F.to_date("ts") == F.lit(date(2024, 1, 7)), F.col("input") + 1).otherwise(F.col("input")))
    days = Y.changed_days(rows, after)
    assert days == [date(2024, 1, 5), date(2024, 1, 7)]
    table.write(after, card, days)
    kept = {p: t for p, t in stamps.items() if p.exists() and p.stat().st_mtime_ns == t}
    assert {p.parent.name for p in stamps.keys() - kept.keys()} == {"day=2024-01-05", "day=2024-01-07"}
    assert shown(Y.range_summary(table.sums(), after, card, None, None, ["provider"])) == shown(S.direct(after, card, ["provider"]))
    assert Y.range_sessions(table.sessions(), after, None, None).first() == S.session_count(after).first()
    assert table.sums().where("day = '2024-01-05'").count() == 0


def test_new_rates(spark, stored):
    """A change at midnight prices stored days anew; one within a day asks for that day's rows."""
    rows, card, table = stored
    moved = datetime(2024, 1, 10)
    new = card.withColumn("valid_to", F.when((F.col("model") == "purchase"), F.lit(moved)).otherwise(F.col("valid_to")))
    later = card.where("model = 'purchase'").withColumns({"valid_from": F.lit(moved), "input": F.col("input") * 3})
    new = new.unionByName(later)
    assert Y.stale_days(table.sums(), new).count() == 0
    assert shown(Y.range_summary(table.sums(), rows, new, *BOUNDS[0], ["model"])) == shown(S.direct(rows.where((F.col("ts") >= F.lit(BOUNDS[0][0])) & (F.col("ts") < F.lit(BOUNDS[0][1]))), new, ["model"]))
    noon = new.withColumns({c: F.when(F.col(c) == F.lit(moved), F.lit(datetime(2024, 1, 10, 12))).otherwise(F.col(c)) for c in ("valid_from", "valid_to")})
    assert [r.day for r in Y.stale_days(table.sums(), noon).collect()] == [date(2024, 1, 10)]
    mended = Y.DayTable(spark, table.root)
    mended.write(rows, noon, [date(2024, 1, 10)])
    assert Y.stale_days(mended.sums(), noon).count() == 0
    assert shown(Y.range_summary(mended.sums(), rows, noon, None, None, ["model"])) == shown(S.direct(rows, noon, ["model"]))
    mended.write(rows, card, [date(2024, 1, 10)])


def test_coarse_sources(spark, stored):
    rows, card, table = stored
    coarse = spark.createDataFrame([("source-1",)], "source_id string")
    fine = rows.where("source_id <> 'source-1'")
    start, end = BOUNDS[0]
    got = Y.range_summary(table.sums(), fine, card, start, end, ["source_id"], coarse)
    days = rows.where("source_id = 'source-1'").where((F.to_date("ts") > F.lit(start.date())) & (F.to_date("ts") <= F.lit(end.date())))
    other = fine.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    assert shown(got) == shown(S.direct(other.unionByName(days), card, ["source_id"]))
    flag = lambda a, b: Y.coarse_provisional(table.sums(), coarse, a, b).first().provisional
    assert flag(start, end) and not flag(None, None)
    assert not Y.coarse_provisional(table.sums(), coarse.where("false"), start, end).first().provisional


def test_no_rows(spark, stored, tmp_path):
    rows, card, _ = stored
    table = Y.DayTable(spark, f"file://{tmp_path}/t")
    table.write(rows.where("false"), card, [date(2024, 1, 1)])
    assert Y.range_summary(table.sums(), rows.where("false"), card, *BOUNDS[0], ["provider"]).count() == 0
    assert Y.range_sessions_estimate(table.sums(), rows.where("false"), *BOUNDS[0]).first().sessions == 0


def test_places_of_an_order_over_several_partitions(spark):
    """Every instant has the place that the whole order gives it, where the sort has many partitions."""
    from meterline.plans.stored import ordered_ledger

    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.place, r.at) for r in ordered_ledger(spark, "/root/testdata/sf0.01").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert [p for p, _ in got] == list(range(1, 10_001))
    assert [at for _, at in got] == sorted(at for _, at in got)
