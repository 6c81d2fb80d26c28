import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators import timestamps as T

UTC = timezone.utc


def us(*parts, **more):
    return int((datetime(*parts, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) + more.get("plus", 0)


CASES = [
    ("2025-06-23T06:52:45Z", None, us(2025, 6, 23, 6, 52, 45)), ("2024-09-11 09:17:02", None, us(2024, 9, 11, 9, 17, 2)), ("2024-09-11 09:17:02", "Asia/Tokyo", us(2024, 9, 11, 0, 17, 2)),
    ("20250731", "Asia/Tokyo", us(2025, 7, 31)), ("2026-06-28", "America/New_York", us(2026, 6, 28)), ("2025-08-25T10:57:18+01:00", "Asia/Tokyo", us(2025, 8, 25, 9, 57, 18)),
    ("1733805195", None, 1733805195 * 10**6), ("1740643307694", None, 1740643307694000), ("1776081016020241", None, 1776081016020241), ("1736010108.99", None, 1736010108990000),
    ("2025-05-30T11:27:02.447Z", None, us(2025, 5, 30, 11, 27, 2, 447000)), ("01.06.2024 11:01", None, us(2024, 6, 1, 11, 1)), ("2025-09-17 15:28:57,712", None, us(2025, 9, 17, 15, 28, 57, 712000)),
    ("2024/11/03 02:07:45", None, us(2024, 11, 3, 2, 7, 45)), ("20240909T040049Z", None, us(2024, 9, 9, 4, 0, 49)), ("11/03/2024 12:43 AM", "UTC", us(2024, 11, 3, 0, 43)), ("11/03/2024 12:43 PM", None, us(2024, 11, 3, 12, 43)),
    ("2025-W18-7", None, us(2025, 5, 4)), ("2026-W53-1", None, us(2026, 12, 28)), ("2025-W53-1", None, None), ("2024-366", None, us(2024, 12, 31)), ("2025-366", None, None), ("2025-000", None, None),
    ("2026-04-17T19:25:28+01", None, us(2026, 4, 17, 18, 25, 28)), ("2026年4月26日 13:38", "Asia/Shanghai", us(2026, 4, 26, 5, 38)), ("2024-07-20 18:44:04+0800", None, us(2024, 7, 20, 10, 44, 4)),
    ("2025-11-03 23:35:44 UTC+8", None, us(2025, 11, 3, 15, 35, 44)), ("2025-07-02 11:26:55 EDT", None, us(2025, 7, 2, 15, 26, 55)), ("2025-08-01T16:23:55[America/New_York]", "Asia/Tokyo", us(2025, 8, 1, 20, 23, 55)),
    ("2024-11-03 00:03:13 America/New_York", None, us(2024, 11, 3, 4, 3, 13)), ("1 November 2025, 23:18", None, us(2025, 11, 1, 23, 18)), ("Mar 15, 2024", None, us(2024, 3, 15)), ("Jan ３１, ２０２４", None, us(2024, 1, 31)),
    ("Fri, 23 Jan 2026 17:58:42 +0100", None, us(2026, 1, 23, 16, 58, 42)), ("24 Mar 2024 20:37:25 GMT", None, us(2024, 3, 24, 20, 37, 25)), ("\t2024-08-18T16:14:33Z  ", None, us(2024, 8, 18, 16, 14, 33)),
    ("2025-01-31t00:13:27z", None, us(2025, 1, 31, 0, 13, 27)), ("２０２４-０８-２１T０２:５０:３１Z", None, us(2024, 8, 21, 2, 50, 31)),
    ("1965-07-01 12:00", "America/New_York", us(1965, 7, 1, 16)), ("2060-07-01 12:00", "America/New_York", us(2060, 7, 1, 16)), ("1850-01-01 00:00:00", "Europe/Berlin", us(1849, 12, 31, 23, 6, 32)),
    (" " * 90 + "2024-01-01 00:00:00Z" + "\t" * 500, None, us(2024, 1, 1)), ("1736010108." + "9" * 400, None, 1736010108999999), ("Wednesday, 25 September 2024,  12:00:00.123456789 PM [America/Argentina/ComodRivadavia]", None, us(2024, 9, 25, 15, plus=123456)),
    ("9999-12-31 23:59:59", "Asia/Tokyo", us(9999, 12, 31, 14, 59, 59)), ("0001-01-01 12:00", "UTC", us(1, 1, 1, 12)),
    ("2024-03-10 02:30:00", "America/New_York", us(2024, 3, 10, 7, 30)), ("2024-11-03 01:30:00", "America/New_York", us(2024, 11, 3, 5, 30)), ("2025-10-26T02:30", "Europe/Berlin", us(2025, 10, 26, 0, 30)),
    ("2025-03-30T02:30", "Europe/Berlin", us(2025, 3, 30, 1, 30)), ("2024-10-06 02:10:00", "Australia/Sydney", us(2024, 10, 5, 16, 10)),
    *[(x, None, None) for x in (None, "", "  ", "null", "2026-02-29", "2026-13-05 13:36:30", "2025-03-23 40:43:00", "13/05/2026 11:26 PM", "00.07.2025 05:22", "2026", "2025-04", "Q1 2025", "August 2025", "3 days ago", "12345", "2025-01-01 00:00:60", "x" * 100_000, "2025-01-01 10:00 XYZ", "2025-01-01 13:00 PM", "2025-01-01 10:00:00[Mars/Olympus]")],
]


def resolve(spark, pairs):
    df = spark.createDataFrame([(i, t, z) for i, (t, z) in enumerate(pairs)], "i int, text string, zone string")
    parsed = T.parse(df, "text")
    out = T.resolve(parsed, "zone", T.zone_intervals(T.asked_zones(parsed, "zone"))).collect()
    return {r["i"]: r for r in out}


def test_spellings(spark):
    got = resolve(spark, [c[:2] for c in CASES])
    wrong = [(c, got[i]["utc_us"]) for i, c in enumerate(CASES) if got[i]["utc_us"] != c[2]]
    assert wrong == [] and len(got) == len(CASES)


def test_wall_kinds(spark):
    got = resolve(spark, [("2024-03-10 02:30:00", "America/New_York"), ("2024-11-03 01:30:00", "America/New_York"), ("2024-11-03 03:30:00", "America/New_York")])
    assert [got[i]["wall_kind"] for i in range(3)] == ["nonexistent", "ambiguous", "plain"]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Asia/Kathmandu", "Australia/Lord_Howe", "Africa/Casablanca", "America/Sao_Paulo"])
def test_wall_times_against_the_zone_database(spark, zone):
    rng, info, pairs, want = random.Random(7), ZoneInfo(zone), [], []
    for _ in range(400):
        wall = datetime(1975, 1, 1) + timedelta(seconds=rng.randrange(70 * 365 * 86400))
        pairs.append((wall.strftime("%Y-%m-%d %H:%M:%S"), zone))
        # fold 0 is the earlier of two instants, and for a gap the offset before it.
        want.append(int((wall.replace(tzinfo=info, fold=0).astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 10**6)
    got = resolve(spark, pairs)
    assert [got[i]["utc_us"] for i in range(len(pairs))] == want


def test_date_parts(spark):
    df = spark.createDataFrame([(2025, 2, 28), (2025, 2, 29), (2025, None, 366), (2024, None, 366), (2025, None, 20478), (None, None, 20250105), (None, None, 20250231), (2025, 10, 20251005), (None, 8, 4), (2025, 13, 5), (None, None, None), (2025, None, 0)], "y int, m int, d int")
    got = [r[0] for r in df.select(T.date_parts_us(F.col("y"), F.col("m"), F.col("d"))).collect()]
    day = 86_400_000_000
    assert got == [us(2025, 2, 28), None, None, us(2024, 12, 31), 20478 * day, us(2025, 1, 5), None, us(2025, 10, 5), None, None, None, None]


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "text string, zone string, year int, i string")
    parsed = T.parse(df, "text")
    out = T.resolve(parsed, "zone", T.zone_intervals(T.asked_zones(parsed, "zone")))
    assert out.count() == 0 and {"year", "i"} <= set(out.columns)


def test_every_zone_of_the_database_at_any_time():
    """The offsets that intervals give equal those of the zone database, also centuries away."""
    from tidemark.functions import zones as Z

    rng = random.Random(4)
    for zone in sorted(Z.zone_names()):
        info = ZoneInfo(zone)
        for _ in range(12):
            wall = datetime(rng.choice([1, 1850, 1900, 1940, 1965, 2000, 2024, 2037, 2060, 2399, 9990]) + rng.randrange(9), 1, 1) + timedelta(seconds=rng.randrange(365 * 86400))
            s = int((wall - datetime(1970, 1, 1)).total_seconds())
            spans = Z.offset_intervals(zone, wall.year)
            hit = [o for lo, hi, o in spans if (lo is None or lo <= s) and (hi is None or s < hi)]
            offset = max(hit) if hit else [o for _, hi, o in spans if hi is not None and hi <= s][-1]
            assert offset == wall.replace(tzinfo=info, fold=0).utcoffset().total_seconds(), (zone, wall)
