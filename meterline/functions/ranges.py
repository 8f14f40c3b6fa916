"""Half-open date ranges as pairs of column expressions.

`now` is a timestamp column and `tz` a zone name; days, weeks, months and years are those of the
zone, also where its clock changes.  The session's zone must be UTC.  `Bounds.start` and `.end` are
instants; None is no bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    start: Column | None
    end: Column | None
    #: Whether the range moves with `now`, so that its end is clipped to it.
    moving: bool = True

    def clipped(self, now: Column) -> Bounds:
        return Bounds(self.start, F.least(self.end, now)) if self.moving and self.end is not None else self

    def holds(self, ts: Column) -> Column:
        inside = F.lit(True)
        if self.start is not None:
            inside = inside & (ts >= self.start)
        if self.end is not None:
            inside = inside & (ts < self.end)
        return inside


def local_day(ts: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def midnight(day: Column, tz: str) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def last_hours(now: Column, n: int) -> Bounds:
    """Elapsed hours, whatever the clock does in between."""
    return Bounds(now - F.make_dt_interval(hours=F.lit(max(1, n))), now)


def last_days(now: Column, n: int) -> Bounds:
    return last_hours(now, 24 * max(1, n))


def current_day(now: Column, tz: str) -> Bounds:
    day = local_day(now, tz)
    return Bounds(midnight(day, tz), midnight(F.date_add(day, 1), tz))


def week_start(day: Column, start_weekday: int) -> Column:
    """The first day of the week that starts on 1 = Sunday to 7 = Saturday."""
    return F.date_sub(day, F.pmod(F.dayofweek(day) - min(7, max(1, start_weekday)), F.lit(7)))


def current_week(now: Column, tz: str, start_weekday: int = 2) -> Bounds:
    first = week_start(local_day(now, tz), start_weekday)
    return Bounds(midnight(first, tz), midnight(F.date_add(first, 7), tz))


def _renewal(month: Column, start_day: Column) -> Column:
    """The cycle's day in the month that begins with `month`, or its last day."""
    return F.make_date(F.year(month), F.month(month), F.least(F.day(F.last_day(month)), start_day))


def cycle(day: Column, start_day: Column) -> tuple[Column, Column]:
    """First day of the billing cycle that holds `day`, and of the next one."""
    month = F.trunc(day, "MM")
    here, before, after = (_renewal(F.add_months(month, n), start_day) for n in (0, -1, 1))
    begun = day >= here
    return F.when(begun, here).otherwise(before), F.when(begun, after).otherwise(here)


def current_month(now: Column, tz: str, start_day: int = 1) -> Bounds:
    first, following = cycle(local_day(now, tz), F.lit(min(31, max(1, start_day))))
    return Bounds(midnight(first, tz), midnight(following, tz))


def year_to_date(now: Column, tz: str) -> Bounds:
    day = local_day(now, tz)
    return Bounds(midnight(F.trunc(day, "YEAR"), tz), midnight(F.date_add(day, 1), tz))


def custom(a: Column, b: Column, tz: str) -> Bounds:
    """Both days included, in either order."""
    return Bounds(midnight(F.least(a, b), tz), midnight(F.date_add(F.greatest(a, b), 1), tz), moving=False)


def all_time() -> Bounds:
    return Bounds(None, None, moving=False)


def calendar_days(a: Column, b: Column) -> Column:
    """Inclusive days between two dates, one at least."""
    return F.greatest(F.lit(1), F.abs(F.datediff(b, a)) + 1)


def range_days(kind: str, today: Column, n: int = 1, first: Column | None = None, last: Column | None = None) -> Column:
    """A range's length in days: a fraction for hours, elapsed days of a running cycle or year,
    inclusive days for a custom range, days since the earliest event for all time (null without).

    `first` is the cycle's, year's or custom range's first day, or the earliest event's day.
    """
    if kind == "hours":
        return F.lit(max(1, n) / 24)
    if kind in ("day", "days"):
        return F.lit(float(max(1, n)) if kind == "days" else 1.0)
    return (F.datediff(last, first) + 1 if kind == "custom" else F.datediff(today, first) + 1).cast("double")
