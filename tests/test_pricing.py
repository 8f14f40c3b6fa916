"""Pricing, ranges and values against known numbers."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from meterline.functions import ranges as R
from meterline.functions import usage as U
from meterline.functions import value as V
from meterline.operators import pricing as P
from meterline.operators import summary as S
from meterline.schema import COUNTS, RATE_CARD

CHANGE = datetime(2026, 8, 21)
ROWS = [
    ("counter", "sol", None, CHANGE, 5.0, 0.5, 6.25, 6.25, 30.0, 125.0, 12.5, 750.0, 272000, 2.0, 1.5),
    ("counter", "sol", CHANGE, None, 4.0, 0.4, 5.0, 5.0, 20.0, 100.0, 10.0, 500.0, 272000, 2.0, 1.5),
    ("counter", "astra", None, None, 10.0, 1.0, 12.5, 12.5, 50.0, 250.0, 25.0, 1250.0, 272000, 2.0, 1.5),
    ("message", "opus", None, None, 5.0, 0.5, 6.25, 10.0, 25.0, None, None, None, None, 1.0, 1.0),
]
M = 1_000_000


@pytest.fixture(scope="module")
def card(spark):
    return spark.createDataFrame(ROWS, RATE_CARD)


def usage(spark, rows):
    """Rows of (provider, model, ts, counters, long-context counters)."""
    names = ["provider", "model", "ts", "event_count", *COUNTS]
    return spark.createDataFrame([(p, m, t, 1, *a, *b) for p, m, t, a, b in rows], "provider string, model string, ts timestamp, event_count bigint, " + ", ".join(f"{c} bigint" for c in names[4:]))


NONE = (0,) * 6


def test_buckets_of_a_plain_card(spark, card):
    row = P.quote(usage(spark, [("message", "opus", CHANGE, (M, 2 * M, 3 * M, 4 * M, 5 * M, 0), NONE)]), card).first()
    assert (row.usd_uncached, row.usd_cached, row.usd_output, row.usd) == pytest.approx((5, 59.75, 125, 189.75))
    assert row.credits is None and row.priced


def test_long_context_premium_and_credits(spark, card):
    spent = (100_000, 200_000, 0, 0, 10_000, 0)
    row = P.quote(usage(spark, [("counter", "sol", CHANGE, spent, spent)]), card).first()
    assert (row.usd_uncached, row.usd_cached, row.usd_output, row.usd, row.credits) == pytest.approx((0.8, 0.16, 0.3, 1.26, 17))


def test_share_is_clamped_to_the_usage(spark, card):
    row = P.quote(usage(spark, [("counter", "sol", CHANGE, (M, 0, 0, 0, 0, 0), (9 * M, 5, 0, 0, 7, 0))]), card).first()
    assert row.usd == pytest.approx(8)


def test_all_classes_of_one_model(spark, card):
    spent = (M, M, M, M, M, 0)
    plain, long = P.quote(usage(spark, [("counter", "astra", CHANGE, spent, NONE), ("counter", "astra", CHANGE, spent, spent)]), card).orderBy("usd").collect()
    assert (plain.usd, long.usd, plain.credits, long.credits) == pytest.approx((86, 147, 1525, 1525))


def test_audited_chat(spark, card):
    row = P.quote(usage(spark, [("counter", "sol", datetime(2026, 7, 10), (69_080_659, 2_413_521_408, 0, 0, 6_283_102, 0), NONE)]), card).first()
    assert row.usd == pytest.approx(1740.657059, abs=1e-6) and row.credits == pytest.approx(43516.426475, abs=1e-6)


def test_change_is_at_the_instant(spark, card):
    times = [datetime(2026, 8, 20, 23, 59, 59), CHANGE]
    rows = usage(spark, [("counter", "sol", t, (M, 0, 0, 0, 0, 0), NONE) for t in times])
    assert sorted(r.usd for r in P.quote(rows, card).collect()) == [4, 5]
    # summaries by every path agree with the rows
    for keys in ([], ["model"], ["provider"]):
        assert S.priced_by(rows, card, keys).first().usd == pytest.approx(9)
    assert S.direct(rows, card, ["model"]).first().usd == pytest.approx(9)
    assert {r.period for r in S.by_period(rows, card).collect()} == {None, CHANGE}


def test_models_without_a_rate(spark, card):
    known = ["gpt-5", "gpt-5.3-codex", "sol"]
    names = ["SOL[1m]", "sol-20260801", "sol-2026-08-01", "sol-2", "codex-auto-review", "gpt-5.9", None]
    df = spark.createDataFrame([(n,) for n in names], "model string")
    assert [r[0] for r in df.select(P.canonical_model(F.col("model"), known)).collect()] == ["sol", "sol", "sol", "sol-2", "gpt-5.3-codex", "gpt-5.9", None]
    rows = usage(spark, [("counter", "new", CHANGE, (M, 0, 0, 0, 0, 0), NONE)])
    assert [tuple(r) for r in P.unpriced(rows, card).collect()] == [("counter", "new", 1)]
    total = S.totals(rows, card).first()
    assert total.usd == 0 and total.unpriced == 1


def test_empty_ledger(spark, card):
    empty = usage(spark, []).where("false")
    assert S.totals(empty, card).first().events == 0
    assert S.by_model(empty, card).count() == 0


def test_serving_cost(spark):
    df = spark.createDataFrame([("counter", 1000.0, None), ("message", 1000.0, None), ("counter", 1000.0, 0.3), ("counter", float("nan"), None), ("counter", -1.0, None)], "provider string, usd double, middle double")
    got = [tuple(r) for r in df.select(*P.serving_cost(F.col("usd"), F.col("provider"), F.col("middle"))).collect()]
    assert got == [pytest.approx(x) for x in [(400, 450, 500), (450, 525, 600), (250, 300, 350), (0, 0, 0), (0, 0, 0)]]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def bounds(spark, b):
    return one(spark, b.start), one(spark, b.end)


NY = "America/New_York"


def test_elapsed_windows_ignore_the_clock_change(spark):
    now = F.lit(datetime(2026, 11, 1, 18))
    a, b = bounds(spark, R.last_hours(now, 24))
    assert (b - a).total_seconds() == 86400
    a, b = bounds(spark, R.last_days(now, 7))
    assert (b - a).total_seconds() == 604800


def test_fall_back_day_has_25_hours(spark):
    day = F.lit(date(2026, 11, 1))
    a, b = bounds(spark, R.custom(day, day, NY))
    assert (b - a).total_seconds() == 25 * 3600


def test_custom_in_either_order_and_year_to_date(spark):
    a, b = F.lit(date(2026, 8, 3)), F.lit(date(2026, 8, 1))
    assert bounds(spark, R.custom(a, b, "UTC")) == (datetime(2026, 8, 1), datetime(2026, 8, 4))
    assert bounds(spark, R.year_to_date(F.lit(datetime(2026, 8, 3, 12)), "UTC")) == (datetime(2026, 1, 1), datetime(2026, 8, 4))


def test_billing_cycle_is_clamped_to_the_month(spark):
    got = bounds(spark, R.current_month(F.lit(datetime(2026, 2, 15)), "UTC", 31))
    assert got == (datetime(2026, 1, 31), datetime(2026, 2, 28))
    assert bounds(spark, R.current_month(F.lit(datetime(2026, 2, 28)), "UTC", 31)) == (datetime(2026, 2, 28), datetime(2026, 3, 31))


def test_week_starts_where_asked(spark):
    now = F.lit(datetime(2026, 8, 5, 9))  # a Wednesday
    assert bounds(spark, R.current_week(now, "UTC", 2))[0] == datetime(2026, 8, 3)
    assert bounds(spark, R.current_week(now, "UTC", 4))[0] == datetime(2026, 8, 5)
    assert bounds(spark, R.current_week(now, "UTC", 5))[0] == datetime(2026, 7, 30)


def test_window_is_half_open_and_rows_expire(spark):
    now = datetime(2026, 8, 5, 12)
    times = [datetime(2026, 8, 4, 11, 59, 59), datetime(2026, 8, 4, 12), datetime(2026, 8, 4, 18), datetime(2026, 8, 5, 0), datetime(2026, 8, 5, 11, 59, 59), now, datetime(2026, 8, 6)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp")
    assert df.where(R.last_hours(F.lit(now), 24).holds(F.col("ts"))).count() == 4
    assert df.where(R.last_hours(F.lit(datetime(2026, 8, 5, 12, 0, 1)), 24).holds(F.col("ts"))).count() == 4  # one expired, `now` entered
    assert df.where(R.all_time().holds(F.col("ts"))).count() == 7


def test_values(spark):
    a, b = F.lit(date(2026, 11, 1)), F.lit(date(2026, 11, 30))
    assert one(spark, R.calendar_days(b, a)) == 30
    assert one(spark, V.prorated_cost(F.lit(30.0), a, b)) == 30 == one(spark, V.prorated_cost(F.lit(30.0), b, a))
    assert one(spark, V.prorated_cost(F.lit(float("inf")), a, b)) == 0
    assert one(spark, V.value_multiple(F.lit(100.0), F.lit(20.0))) == 5
    assert one(spark, V.value_multiple(F.lit(100.0), F.lit(0.0))) is None
    assert [one(spark, V.tier(F.lit(x))) for x in (0.4, 0.5, 0.99, 1.0, 159.9, 160.0)] == [0, 1, 1, 2, 8, 9]
    assert one(spark, V.milestone(F.lit(399.99))) == 3
    assert one(spark, V.daily_spend(F.lit(70.0), F.lit("weekly"))) == 10
    assert one(spark, R.range_days("hours", a, 12)) == 0.5
    assert one(spark, R.range_days("year", b, first=a)) == 30


def test_instants_and_ids(spark):
    texts = ["2026-08-01T10:00:00Z", "2026-08-01T10:00:00.250+02:00", "2026-08-01", "nonsense", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(U.parse_instant(F.col("t"))).collect()]
    assert got == [datetime(2026, 8, 1, 10), datetime(2026, 8, 1, 8, 0, 0, 250000), None, None, None]
    ids = ["0190a7a0-0000-7000-8000-000000000000", "0190a7a0-0000-4000-8000-000000000000", "short", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in ids], "t string").select(U.is_uuid7(F.col("t"))).collect()] == [True, False, False, False]
    keys = spark.createDataFrame([("agent-10",), ("agent-2",), ("agent-1",)], "k string")
    assert [r.k for r in S.ordered(keys, "k").collect()] == ["agent-1", "agent-2", "agent-10"]


def test_default_card(spark):
    from meterline.plans.default_card import default_rate_card

    card = default_rate_card(spark)
    spent = (M, M, M, M, M, 0)
    jul, aug, sep = datetime(2026, 7, 29, 23, 59, 59), datetime(2026, 8, 20, 23, 59, 59), datetime(2026, 9, 1)
    cases = [
        ("gpt-6-astra", sep, spent, 86, 1525),
        ("gpt-5.6-sol", aug, (M, 0, 0, 0, 0, 0), 5, 125),
        ("gpt-5.6-sol-20260801", AUG := datetime(2026, 8, 21), (M, 0, 0, 0, 0, 0), 4, 100),
        ("gpt-5.6-luna", jul, (0, 0, 0, 0, M, 0), 6, 30),
        ("GPT-5.6-luna", AUG, (0, 0, 0, 0, M, 0), 1.2, 30),
        ("codex-auto-review", sep, (M, 0, 0, 0, 0, 0), 1.75, 43.75),
        ("gpt-5.3-codex-spark", sep, spent, None, None),
        ("gpt-5.9", sep, spent, None, None),
    ]
    rows = usage(spark, [("counter", m, t, s, NONE) for m, t, s, _, _ in cases])
    got = {(r.model, r.ts): (r.usd, r.credits) for r in P.quote(rows, card).collect()}
    assert len(got) == len(cases)
    for m, t, _, usd, credits in cases:
        assert got[m, t] == (usd if usd is None else pytest.approx(usd), credits if credits is None else pytest.approx(credits)), m
    assert P.quote(usage(spark, [("message", "claude-opus-4-5-20260101", sep, spent, NONE)]), card).first().usd == pytest.approx(46.75)
