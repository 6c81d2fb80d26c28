"""The timestamp query over whole tables against an independent reading with strptime and the zone database."""

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd

from tidemark.plans.core_queries import p2_found
from tidemark.session import ship

FOLDER = "/root/testdata/sf0.01"
UTC = timezone.utc
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
HOURS = {"EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2, "GMT": 0, "UTC": 0, "Z": 0}
TIMED = ["%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S,%f", "%Y/%m/%d %H:%M:%S", "%d.%m.%Y %H:%M", "%m/%d/%Y %I:%M %p", "%Y年%m月%d日 %H:%M", "%d %B %Y, %H:%M", "%Y%m%dT%H%M%S", "%d %b %Y %H:%M:%S", "%a, %d %b %Y %H:%M:%S"]
DATED = [("%Y-%m-%d", r"\d{4}-\d\d-\d\d"), ("%Y%m%d", r"\d{8}"), ("%b %d, %Y", r"[A-Z].*"), ("%Y-%j", r"\d{4}-\d{3}"), ("%G-W%V-%u", r"\d{4}-W\d\d-\d")]


def read(form, text):
    try:
        return datetime.strptime(text, form)
    except ValueError:
        return None


def us(d):
    return (d - EPOCH) // timedelta(microseconds=1)


def instant(text, zone):
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", text).strip()
    if m := re.fullmatch(r"(\d{10})(?:\.(\d+))?", t):
        return int(m[1]) * 10**6 + int(((m[2] or "") + "000000")[:6])
    if re.fullmatch(r"\d{13}|\d{16}", t):
        return int(t) * (1000 if len(t) == 13 else 1)
    for form, shape in DATED:
        if re.fullmatch(shape, t) and (d := read(form, t)):
            return us(d.replace(tzinfo=UTC))
    shift = None
    if m := re.search(r"\[([^\]]+)\]$", t) or re.search(r" ([A-Za-z]+/[A-Za-z_]+)$", t):
        zone = m[1]
    elif m := re.search(r" (?:UTC|GMT)([+-]\d+)$", t):
        shift = timedelta(hours=int(m[1]))
    elif m := re.search(r"(?<=\d) ?([zZ]|EST|EDT|PST|PDT|CET|CEST|GMT|UTC)$", t):
        shift = timedelta(hours=HOURS[m[1].upper()])
    elif ":" in t and (m := re.search(r"(?<=\d) ?([+-])(\d\d):?(\d\d)?$", t)):
        shift = timedelta(hours=int(m[2]), minutes=int(m[3] or 0)) * (1 if m[1] == "+" else -1)
    body = (t[: m.start()] if m else t).strip()
    body = re.sub(r"^(\d{4}-\d\d-\d\d)t", r"\1T", body)
    for d in filter(None, (read(f, body) for f in TIMED)):
        return us(d.replace(tzinfo=UTC) - shift if shift is not None else d.replace(tzinfo=ZoneInfo(zone or "UTC"), fold=0).astimezone(UTC))
    return None


def from_parts(y, m, d):
    try:
        if d >= 10**7:
            day = date(d // 10_000, d // 100 % 100, d % 100)
        elif d > 366:
            day = date(1970, 1, 1) + timedelta(days=d)
        elif y and m is not None:
            day = date(y, m, d)
        elif y and d >= 1:
            day = date(y, 1, 1) + timedelta(days=d - 1)
            day = day if day.year == y else None
        else:
            return None
    except ValueError:
        return None
    return day and (day - date(1970, 1, 1)).days * 86_400 * 10**6


def test_whole_tables(spark):
    ship(spark)
    got = {(r["src"], r["rec_id"], r["field"]): r["utc_us"] for r in p2_found(spark, FOLDER).collect()}
    load = lambda t: pd.read_parquet(f"{FOLDER}/{t}.parquet").astype(object).where(lambda f: f.notna(), None)
    zones = dict(load("media")[["id", "time_zone"]].itertuples(index=False))
    owner = {k.strip().lower(): zones.get(m) for k, m in load("video")[["id", "media_id"]].itertuples(index=False)}
    want = {}
    for r in load("video_list").itertuples():
        for field in ("published_at", "content_published_at"):
            want["video_list", r.id, field] = instant(getattr(r, field), zones.get(r.media_id))
    for r in load("video_time_evidence").itertuples():
        want["video_time_evidence", r.id, "time_start"] = instant(r.time_start, owner.get((r.video_id or "").strip().lower()))
        if r.date_day is not None:
            whole = lambda x: None if x is None else int(x)
            want["video_time_evidence", r.id, "date_day"] = from_parts(whole(r.date_year), whole(r.date_month), int(r.date_day))
    assert got == {k: v for k, v in want.items() if v is not None}
