"""Scalar time functions. The clock is always an argument; local time is that of the ``zone`` argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZONE = "Asia/Shanghai"


def _utc(c: Column) -> Column:
    """A zone-less timestamp read as UTC."""
    return c.cast("timestamp")


def local_date(ts: Column, zone: str = DEFAULT_ZONE) -> Column:
    return F.from_utc_timestamp(_utc(ts), zone).cast("date")


def period_start(day: Column, unit: str) -> Column:
    if unit not in ("day", "week", "month"):
        raise ValueError(f"granularity {unit!r} is none of day, week, month")
    return F.date_trunc(unit, day).cast("date")


def period_end(day: Column, unit: str) -> Column:
    """The last day of the period, which belongs to it."""
    start = period_start(day, unit)
    return {"day": start, "week": F.date_add(start, 6), "month": F.last_day(start)}[unit]


def period_bounds_utc(start: Column, unit: str, zone: str = DEFAULT_ZONE) -> tuple[Column, Column]:
    """UTC bounds of a local period: days and weeks are multiples of 24 hours, months follow the calendar."""
    low = F.to_utc_timestamp(start.cast("timestamp"), zone)
    if unit == "month":
        return low, F.to_utc_timestamp(F.add_months(start, 1).cast("timestamp"), zone)
    return low, low + F.expr(f"INTERVAL {24 if unit == 'day' else 168} HOURS")


def spine(first: Column, last: Column, unit: str) -> Column:
    """All period starts from one day to another."""
    return F.sequence(period_start(first, unit), period_start(last, unit), F.expr(f"INTERVAL 1 {unit}"))


def partial_date(text: Column) -> Column:
    """A year, month, day or ISO instant as a timestamp; without a zone it is UTC; null for anything else."""
    t = F.trim(text)
    padded = F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01")))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"), t)
    return F.coalesce(padded, iso).try_cast("timestamp")


def civil_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """A date of its parts, null unless it exists."""
    y, m, d = (F.col(c) if isinstance(c, str) else c for c in (year, month, day))
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.between(1, 9999) & m.between(1, 12) & d.between(1, 31), text.try_cast("date"))


def time_precision(stated: Column, start: Column, end: Column) -> Column:
    p = F.lower(F.trim(F.coalesce(stated, F.lit(""))))
    known = F.when(start.isNull() & end.isNull(), F.lit("unknown")).otherwise(p)
    return F.when(known.isin("second", "day", "month", "year", "range", "unknown"), known).when(start.isNull(), "unknown").otherwise("day")


def widened_days(start: Column, end: Column, precision: Column) -> tuple[Column, Column]:
    """Day numbers of an interval, widened to the year or month that its precision names."""
    s, e, p = start.cast("date"), end.cast("date"), F.lower(F.trim(F.coalesce(precision, F.lit("unknown"))))
    first = F.when(p == "year", F.trunc(s, "year")).when(p == "month", F.trunc(s, "month")).otherwise(s)
    last = F.when(p == "year", F.date_add(F.add_months(F.trunc(s, "year"), 12), -1)).when(p == "month", F.last_day(s)).when(e >= s, e).otherwise(s)
    return F.unix_date(first), F.unix_date(last)


def published_at(info: Column) -> Column:
    """From provider JSON: an epoch second, else a day of eight digits."""
    seconds = F.coalesce(*[F.get_json_object(info, f"$.{k}").try_cast("long") for k in ("timestamp", "release_timestamp")])
    days = F.coalesce(*[F.try_to_date(F.when(F.trim(F.get_json_object(info, f"$.{k}")).rlike(r"^\d{8}$"), F.trim(F.get_json_object(info, f"$.{k}"))), "yyyyMMdd") for k in ("upload_date", "release_date")])
    return F.coalesce(F.timestamp_seconds(seconds), days.cast("timestamp"))


def recency_priority(ts: Column, now: Column, base: Column, zone: str = DEFAULT_ZONE, day: int = 20, week: int = 15) -> Column:
    """Raised for the last 24 hours, less for the rest of the local week; the future and the unknown keep the base."""
    low, high = period_bounds_utc(period_start(local_date(now, zone), "week"), "week", zone)
    t, n = _utc(ts), _utc(now)
    recent = t >= n - F.expr("INTERVAL 24 HOURS")
    return F.when(t.isNull() | (t > n), base).when(recent, F.greatest(base, F.lit(day))).when((t >= low) & (t < high), F.greatest(base, F.lit(week))).otherwise(base)


def recent_priority(ts: Column, now: Column, base: Column, hours: int = 72, raised: int = 10) -> Column:
    return F.when(_utc(ts) >= _utc(now) - F.expr(f"INTERVAL {hours} HOURS"), F.greatest(base, F.lit(raised))).otherwise(base)


def hash_jitter(seed: Column, most: int) -> Column:
    """0 to ``most``, fixed by the seed."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long") % (most + 1)


def backoff_seconds(attempt: Column, base: int = 10, cap: int = 600) -> Column:
    n = F.greatest(F.coalesce(attempt, F.lit(1)), F.lit(1))
    return F.least(F.lit(cap), base * F.pow(F.lit(2), F.least(n - 1, F.lit(30)))).cast("int")


def next_daily_run(now: Column, hour: int, minute: int, zone: str = DEFAULT_ZONE) -> Column:
    """The next time the local clock shows the given hour and minute, in UTC."""
    local = F.from_utc_timestamp(_utc(now), zone)
    today = F.date_trunc("day", local) + F.expr(f"INTERVAL {hour * 60 + minute} MINUTES")
    return F.to_utc_timestamp(F.when(today <= local, today + F.expr("INTERVAL 24 HOURS")).otherwise(today), zone)


def cooldown(now: Column, last_ready: Column, minutes: int) -> Column:
    n = _utc(now)
    return F.when(last_ready.isNull(), n).otherwise(F.greatest(n, _utc(last_ready) + F.expr(f"INTERVAL {minutes} MINUTES")))


def duration_timeout(base: int, seconds: Column, factor: float = 4.0, overhead: int = 300, cap: int | None = None) -> Column:
    """At least ``base``, else the duration divided by the factor plus an overhead, up to a cap."""
    estimated = F.ceil(seconds / F.lit(factor)) + overhead
    estimated = F.least(F.lit(cap), estimated) if cap else estimated
    return F.when(F.coalesce(seconds, F.lit(0)) <= 0, F.lit(base)).otherwise(F.greatest(F.lit(base), estimated)).cast("int")


def shift_period(day: Column, n: int, unit: str) -> Column:
    return F.add_months(day, n) if unit == "month" else F.date_add(day, n * (7 if unit == "week" else 1))


def period_difference(a: Column, b: Column, unit: str) -> Column:
    """Whole periods from b to a."""
    if unit == "month":
        return (F.year(a) * 12 + F.month(a) - F.year(b) * 12 - F.month(b)).cast("int")
    return F.floor(F.date_diff(period_start(a, unit), period_start(b, unit)) / (7 if unit == "week" else 1)).cast("int")


def rolling_day(ts: Column, now: Column) -> Column:
    """Within the last 24 hours, both ends included."""
    return _utc(ts).between(_utc(now) - F.expr("INTERVAL 24 HOURS"), _utc(now))
