"""Column expressions shared by the plans: rates, half-open periods, calendar arithmetic.

Times are instants in UTC without a zone (TIMESTAMP_NTZ), so results do not depend on the session's zone; local
calendars are named by a zone argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Jerusalem"


def at(moment: str) -> Column:
    """A literal instant, written as UTC."""
    return F.lit(moment).cast("timestamp_ntz")


def ratio(part: Column, whole: Column, factor: float = 1.0) -> Column:
    """part / whole * factor, rounded to 2 places (half up); null where whole is 0 or null."""
    return F.round(part.cast("double") / F.nullif(whole, F.lit(0)) * factor, 2)


def pct(part: Column, whole: Column) -> Column:
    return ratio(part, whole, 100.0)


def active_at(t: Column, start: Column, end: Column) -> Column:
    """t in [start, end); a null end is open."""
    return (t >= start) & (end.isNull() | (t < end))


def live_at(t: Column, start: Column, end: Column) -> Column:
    """t strictly after the start, and before the end; differs from active_at where t = start."""
    return (start < t) & (end.isNull() | (end > t))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Two half-open periods share an instant; null ends are open."""
    return (other_end.isNull() | (start < other_end)) & (end.isNull() | (other_start < end))


def contained_in(start: Column, end: Column, outer_start: Column, outer_end: Column) -> Column:
    """The first period lies inside the second; an open period only inside an open one."""
    return (start >= outer_start) & (outer_end.isNull() | F.coalesce(end <= outer_end, F.lit(False)))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / 1e6


def month_start(t: Column) -> Column:
    """The first day of t's month, as a date."""
    return F.trunc(t.cast("date"), "MM")


def local_month(t: Column, zone: str = ZONE) -> Column:
    return month_start(F.convert_timezone(F.lit("UTC"), F.lit(zone), t))


def quarter_start(t: Column) -> Column:
    return F.trunc(t.cast("date"), "quarter")


def add_months(t: Column, months: Column | int) -> Column:
    """Calendar months later at the same time of day; a month's last days clamp."""
    n = F.lit(months) if isinstance(months, int) else months
    return t + F.make_interval(months=n)


def add_days(t: Column, days: Column | int) -> Column:
    n = F.lit(days) if isinstance(days, int) else days
    return t + F.make_interval(days=n)


def next_month(t: Column) -> Column:
    """The first instant of the month after t's."""
    return F.add_months(month_start(t), 1).cast("timestamp_ntz")


def month_end_snapshot(t: Column, months: Column | int) -> Column:
    """The last second of the month that lies ``months`` after t's."""
    return next_month(add_months(t, months)) - F.expr("INTERVAL 1 SECOND")


def month_label(month: Column) -> Column:
    return F.date_format(month, "MMM yyyy")


def month_sort(month: Column) -> Column:
    return F.year(month) * 100 + F.month(month)
