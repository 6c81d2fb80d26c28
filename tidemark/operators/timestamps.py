"""Timestamps of many spellings and zones, normalised to microseconds since 1970 in UTC.

A text is rewritten to ``year|month|day|rest`` by anchored patterns, the rest is split into clock and zone, and the
parts are validated; all of it stays in JVM expressions. A wall time without an offset meets its zone by an as-of
join against exploded zone-offset intervals (``zone_intervals``), made for the zones and years that occur: two
intervals that cover it make it ambiguous, none makes it nonexistent, one gives the offset. The intervals are those of
the zone database for any year from 1 to 9999.

Rules: an ambiguous wall time is its earlier instant, a nonexistent one moves on by the length of the gap; a date
without time of day is 00:00 UTC; with dots the day comes first, with slashes and the year last the month; bare
digits are, by their count, a date or seconds, milliseconds or microseconds of the epoch; a zone of null is UTC.

Cases: null, blank, unknown words, partial or impossible dates, impossible clocks, unknown zones and unknown
abbreviations give null; digits of full width count as digits; blanks around a text do not matter, a text that is
longer without them than any timestamp gives null;
an empty table stays empty; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.zones import offset_intervals, zone_names
from tidemark.sources.tables import DAY_US

if TYPE_CHECKING:
    import pandas as pd

#: Characters of the longest text that the patterns accept, with outer and repeated blanks and digits of a second beyond
#: the sixth taken off: no zone has a name of 64, and the longest date, clock and offset together have fewer than 128.
LONGEST = 192

# Full-width forms of ASCII, other blanks and minus signs, and what they stand for.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + " 　   −‐‑–\t\r\n"
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + "     ----   "
# Months, and zone abbreviations with their offsets in minutes.
_MONTHS = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]
_ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "BRT": -180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}

_DATES = [
    (r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?!\d)", "$1|$3|$4|"),
    (r"^(\d{4}) ?年 ?(\d{1,2}) ?月 ?(\d{1,2}) ?日", "$1|$2|$3|"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\d)", "$3|$2|$1|"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?!\d)", "$3|$1|$2|"),
    (r"^(?:[A-Z]{3,9}\.?,? )?(\d{1,2})\.? ([A-Z]{3,9})\.?,? (\d{4}),?(?!\d)", "$3|$2|$1|"),
    (r"^(?:[A-Z]{3,9},? )?([A-Z]{3,9})\.? (\d{1,2}),? (\d{4}),?(?!\d)", "$3|$1|$2|"),
    (r"^(\d{4})(\d{2})(\d{2})(?=T|$)", "$1|$2|$3|"),
    (r"^(\d{4})-(\d{3})(?!\d)", "$1|@D|$2|"),
    (r"^(\d{4})-?W(\d{2})-?([1-7])(?!\d)", "$1|@W$2|$3|"),
]
_CLOCK = r"^(?:[T,]| )[ ,]?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)? ?([AP]M)? ?((?:[A-Z]{1,4})?(?:[+-]\d{1,2}(?::?\d{2})?)?)$"


def _int(c: Column) -> Column:
    return F.when(F.length(c) > 0, c.try_cast("int"))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Day number of a civil date, null unless it exists."""
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.between(1, 9999) & m.between(1, 12) & d.between(1, 31), F.unix_date(text.try_cast("date")))


def ordinal_days(y: Column, n: Column) -> Column:
    """Day number of the n-th day of a year, null unless it exists."""
    first, last = _days(y, F.lit(1), F.lit(1)), _days(y, F.lit(12), F.lit(31))
    return F.when((n >= 1) & (first + n - 1 <= last), first + n - 1)


def _week_days(y: Column, w: Column, d: Column) -> Column:
    """Day number of an ISO week date, null unless the year has that week."""
    def week_one(year: Column) -> Column:
        fourth = _days(year, F.lit(1), F.lit(4))
        return fourth - F.pmod(fourth + 3, F.lit(7))

    out = week_one(y) + (w - 1) * 7 + d - 1
    return F.when((w >= 1) & (out < week_one(y + 1)), out)


def parse(df: DataFrame, text: str) -> DataFrame:
    """Adds ts_us (the instant, or the wall time as if in UTC), ts_kind (``instant``, ``wall`` or null for no time)
    and ts_zone (the zone a wall time names itself)."""
    clean = F.regexp_replace(F.translate(F.col(text), _WIDE, _PLAIN), r"[​﻿‎‏]", "")
    clean = F.regexp_replace(F.trim(F.regexp_replace(clean, " {2,}", " ")), r"^(\d{9,10}[.,]\d{6})\d+$", "$1")
    clean = F.when(F.length(clean) <= LONGEST, clean)
    bracket, named = r" ?\[([A-Za-z0-9_+/-]+)\]$", r" ([A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)$"
    df = df.withColumn("_s", clean)
    own = F.coalesce(*[F.when(F.length(x) > 0, x) for x in (F.regexp_extract("_s", bracket, 1), F.regexp_extract("_s", named, 1))])
    body = F.upper(F.regexp_replace(F.regexp_replace("_s", bracket, ""), named, ""))
    df = df.withColumns({"_own": own, "_b": body})

    digits = F.regexp_replace("_b", r"^(\d+)[.,]\d+$", "$1")
    part = F.substring(F.rpad(F.regexp_extract("_b", r"^\d+[.,](\d+)$", 1), 6, "0"), 1, 6)
    n, size = digits.try_cast("long"), F.length(digits)
    bare = F.col("_b").rlike(r"^\d{9,16}([.,]\d+)?$")
    whole = F.col("_b").rlike(r"^\d+$")
    epoch = (
        F.when(size.isin(9, 10), n * 1_000_000 + F.coalesce(part.try_cast("long"), F.lit(0)))
        .when(whole & size.isin(12, 13), n * 1000)
        .when(whole & size.isin(15, 16), n)
    )

    dated = F.col("_b")
    for pattern, to in _DATES:
        dated = F.regexp_replace(dated, pattern, to)
    rest = F.regexp_replace(F.get(F.col("_p"), F.lit(3)), r"^T(\d{2})(\d{2})(\d{2})?(?![:\d])", "T$1:$2:$3")
    df = df.withColumns({"_epoch": F.when(bare, epoch), "_p": F.split(dated, r"\|", 4)}).withColumn("_r", F.regexp_replace(rest, r"^(T\d{2}:\d{2}):(?!\d)", "$1"))

    y, m, d = (F.get(F.col("_p"), F.lit(i)) for i in range(3))
    month = F.create_map(*[F.lit(x) for i, name in enumerate(_MONTHS, 1) for short in dict.fromkeys((name, name[:3])) for x in (short, i)], F.lit("SEPT"), F.lit(9))
    days = (
        F.when(m == "@D", ordinal_days(_int(y), _int(d)))
        .when(m.startswith("@W"), _week_days(_int(y), _int(F.substring(m, 3, 2)), _int(d)))
        .otherwise(_days(_int(y), F.coalesce(_int(m), F.element_at(month, m)), _int(d)))
    )
    df = df.withColumns({"_days": F.when(F.size("_p") == 4, days), "_c": F.when(F.col("_r").rlike(_CLOCK), F.split(F.regexp_replace("_r", _CLOCK, "$1|$2|$3|$4|$5|$6"), r"\|", 6))})

    hh, mi, ss, frac, half, zone = (F.get(F.col("_c"), F.lit(i)) for i in range(6))
    h, minute, second = _int(hh), _int(mi), F.coalesce(_int(ss), F.lit(0))
    twelve = F.when(h.between(1, 12), h % 12 + F.when(half == "PM", 12).otherwise(0))
    h = F.when(F.length(half) > 0, twelve).otherwise(h)
    us = F.coalesce(F.substring(F.rpad(frac, 6, "0"), 1, 6).try_cast("long"), F.lit(0))
    clock = F.when((h <= 23) & (minute <= 59) & (second <= 59), (h * 3600 + minute * 60 + second).cast("long") * 1_000_000 + us)
    sign, oh, om = (F.regexp_extract(zone, r"([+-])(\d{1,2}?)(?::?(\d{2}))?$", i) for i in (1, 2, 3))
    shift = F.coalesce(_int(oh), F.lit(0)) * 60 + F.coalesce(_int(om), F.lit(0))
    numeric = F.when((shift <= 18 * 60) & (F.coalesce(_int(om), F.lit(0)) <= 59), F.when(sign == "-", -shift).otherwise(shift))
    word = F.regexp_extract(zone, r"^[A-Z]*", 0)
    names = F.create_map(*[F.lit(x) for kv in _ABBREVIATIONS.items() for x in kv])
    minutes = (
        F.when((F.length(sign) > 0) & word.isin("", "UTC", "GMT"), numeric)
        .when(F.length(sign) == 0, F.element_at(names, word))
    )
    at = F.col("_days").cast("long") * DAY_US
    wall = at + F.col("_clock")
    df = df.withColumns({"_clock": clock, "_min": minutes, "_zone": zone})
    has_zone = F.length("_zone") > 0
    kind = (
        F.when(F.col("_epoch").isNotNull() | (F.col("_days").isNotNull() & (F.col("_r") == "")), "instant")
        .when(F.col("_days").isNotNull() & F.col("_clock").isNotNull(), F.when(~has_zone, "wall").when(F.col("_min").isNotNull(), "instant"))
    )
    value = F.when(F.col("_epoch").isNotNull(), F.col("_epoch")).when(F.col("_r") == "", at).when(has_zone, wall - F.col("_min").cast("long") * 60_000_000).otherwise(wall)
    df = df.withColumn("ts_kind", kind)
    df = df.withColumns({"ts_us": F.when(F.col("ts_kind").isNotNull(), value), "ts_zone": F.when(F.col("ts_kind") == "wall", F.col("_own"))})
    return df.drop("_s", "_own", "_b", "_epoch", "_p", "_r", "_days", "_c", "_clock", "_min", "_zone")


def asked_zones(parsed: DataFrame, zone: str) -> DataFrame:
    """The zones and years of the wall times of ``parsed``: zone, year, each once."""
    wall = parsed.where(F.col("ts_kind") == "wall")
    return wall.select(_zone(zone).alias("zone"), _year().alias("year")).where("year IS NOT NULL").distinct()


def zone_intervals(asked: DataFrame) -> DataFrame:
    """The local intervals of the zones and years in ``asked`` (zone, year): zone, year, spans (an array of lo_us, hi_us,
    offset_us in order, null at the open ends). Unknown zones have no row. At most 600 zones by 9,999 years."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        us = lambda s: None if s is None else s * 1_000_000
        for f in frames:
            rows = [(z, y, [{"lo_us": us(lo), "hi_us": us(hi), "offset_us": us(o)} for lo, hi, o in offset_intervals(z, y)]) for z, y in zip(f["zone"], f["year"]) if z in zone_names()]
            yield pd.DataFrame(rows, columns=["zone", "year", "spans"])

    return asked.select("zone", "year").mapInPandas(run, "zone string, year int, spans array<struct<lo_us:long,hi_us:long,offset_us:long>>")


def _zone(zone: str) -> Column:
    return F.coalesce(F.col("ts_zone"), F.col(zone), F.lit("UTC"))


def _year() -> Column:
    return F.year(F.date_from_unix_date(F.floor(F.col("ts_us") / DAY_US).cast("int")))


def resolve(parsed: DataFrame, zone: str, intervals: DataFrame) -> DataFrame:
    """Adds utc_us and wall_kind to the result of ``parse``; ``zone`` names the column with the zone of wall times that
    name none, ``intervals`` comes from ``zone_intervals`` and holds every zone and year that occurs.

    The as-of join is an equi join on (zone, year), one row a wall time; the intervals of that year that cover the local
    time are counted: one gives the offset, two make it ambiguous, none makes it nonexistent, and then the offset is that
    of the last interval that ended before it."""
    wall = F.col("ts_kind") == "wall"
    left = parsed.withColumns({"_z": F.when(wall, _zone(zone)), "_y": F.when(wall, _year())})
    i = intervals.select(*[F.col(c).alias(f"_i_{c}") for c in ("zone", "year", "spans")])
    joined = left.join(i, (F.col("_z") == F.col("_i_zone")) & (F.col("_y") == F.col("_i_year")), "left")
    ended = lambda x: F.coalesce(x["hi_us"] <= F.col("ts_us"), F.lit(False))
    begun = lambda x: F.coalesce(x["lo_us"] <= F.col("ts_us"), F.lit(True))
    cover = F.filter("_i_spans", lambda x: begun(x) & ~ended(x))
    n, over = F.size("_cover"), F.filter("_i_spans", ended)
    found = joined.withColumns({"_cover": cover, "_over": over})
    # Of two instants the earlier has the larger offset.
    offset = F.when(n > 0, F.array_max(F.transform("_cover", lambda x: x["offset_us"]))).otherwise(F.get(F.col("_over"), F.size("_over") - 1)["offset_us"])
    utc = F.when(F.col("ts_kind") == "instant", F.col("ts_us")).when(wall, F.col("ts_us") - offset)
    kind = F.when(wall & (n >= 0), F.when(n == 0, "nonexistent").when(n == 1, "plain").otherwise("ambiguous"))
    return found.select(*parsed.columns, utc.alias("utc_us"), kind.alias("wall_kind"))


def date_parts_us(year: Column, month: Column, day: Column) -> Column:
    """Incomplete date parts to microseconds: day of month, day of year, a whole date, or a day number.

    With a month the day is one of that month, without one a day of the year. A value beyond 366 is by itself a whole
    date (eight digits) or a number of days since 1970; one that is smaller and does not exist gives null."""
    whole = _days(F.floor(day / 10000).cast("int"), F.floor(day / 100).cast("int") % 100, day % 100)
    alone = F.when(day >= 10_000_000, whole).otherwise(day)
    own = F.when(month.isNotNull(), _days(year, month, day)).otherwise(ordinal_days(year, day))
    return F.when(day > 366, alone).when(year.isNotNull(), own).cast("long") * DAY_US
