"""Offsets of time zones from the zone database: exact for any year, from its files' transitions and closing rules."""

from __future__ import annotations

import os
import re
import struct
import zoneinfo
from bisect import bisect_right
from datetime import date
from functools import cache
from importlib import resources

_EPOCH = date(1970, 1, 1).toordinal()
#: A closing rule: two names, offsets and dates, as in ``EST5EDT,M3.2.0,M11.1.0``.
_NAME, _TIME = r"(?:[A-Za-z]{3,}|<[^>]+>)", r"([+-]?\d+(?::\d+){0,2})"
_RULE = re.compile(rf"{_NAME}{_TIME}(?:{_NAME}{_TIME}?,([^,]+),([^,]+))?")


@cache
def zone_names() -> frozenset[str]:
    return frozenset(z for z in zoneinfo.available_timezones() if z != "localtime" and not z.startswith(("posix", "right")))


def _file(zone: str) -> bytes:
    for folder in zoneinfo.TZPATH:
        path = os.path.join(folder, *zone.split("/"))
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    return resources.files("tzdata.zoneinfo").joinpath(*zone.split("/")).read_bytes()


def _seconds(text: str) -> int:
    sign, parts = (-1 if text[0] == "-" else 1), text.lstrip("+-").split(":")
    return sign * sum(int(p) * 60 ** (2 - i) for i, p in enumerate(parts))


def _first_day(year: int) -> int:
    """Days from 1970 to the first of January, also of years that ``date`` does not know."""
    y = year - 1
    return y * 365 + y // 4 - y // 100 + y // 400 - (_EPOCH - 1)


def _local(rule: str, year: int) -> int:
    """Seconds since 1970, on the clock before the change, of a rule's date in a year."""
    day, _, at = rule.partition("/")
    start, leap = _first_day(year), _first_day(year + 1) - _first_day(year) == 366
    if day[0] == "M":
        month, week, weekday = map(int, day[1:].split("."))
        before = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365]
        first = start + before[month - 1] + (leap and month > 2)
        length = before[month] - before[month - 1] + (leap and month == 2)
        # 1970-01-01 was a Thursday, weekday 4.
        n = (weekday - first - 4) % 7 + (week - 1) * 7
        out = first + (n if n < length else n - 7)
    elif day[0] == "J":
        n = int(day[1:])
        out = start + n - 1 + (leap and n > 59)
    else:
        out = start + int(day)
    return out * 86400 + _seconds(at or "2")


@cache
def _read(zone: str) -> tuple[list[int], list[int], int, str]:
    """Transitions in UTC seconds, the offset after each, the offset before the first, and the closing rule."""
    data = _file(zone)

    def block(at: int, width: int):
        utc, std, leap, times, types, chars = struct.unpack(">6l", data[at + 20 : at + 44])
        return at + 44, times, types, times * (width + 1) + types * 6 + chars + leap * (width + 4) + std + utc

    at, times, types, size = block(0, 4)
    width = 4
    if data[4] >= ord("2"):
        width = 8
        at, times, types, size = block(at + size, 8)
    moments = list(struct.unpack(f">{times}{'q' if width == 8 else 'l'}", data[at : at + times * width]))
    which = data[at + times * width : at + times * (width + 1)]
    info = at + times * (width + 1)
    offsets = [struct.unpack(">l", data[info + 6 * i : info + 6 * i + 4])[0] for i in range(types)]
    summer = [data[info + 6 * i + 4] for i in range(types)]
    before = next((o for o, s in zip(offsets, summer) if not s), offsets[0] if offsets else 0)
    rule = data[at + size :].decode().strip("\n") if width == 8 else ""
    return moments, [offsets[i] for i in which], before, rule


def _closing(rule: str, year: int) -> list[tuple[int, int]]:
    """The changes of a closing rule in a year: UTC second, offset after it. Without changes, its one offset."""
    m = _RULE.fullmatch(rule)
    if not m:
        return []
    std = -_seconds(m[1])
    if not m[3]:
        return [(_first_day(year) * 86400, std)]
    dst = -_seconds(m[2]) if m[2] else std + 3600
    return sorted([(_local(m[3], year) - std, dst), (_local(m[4], year) - dst, std)])


def offset_intervals(zone: str, year: int) -> list[tuple[int | None, int | None, int]]:
    """The intervals of one offset that touch a year's local times: local start, local end, offset, all in seconds.

    The first interval has no start and the last no end. Where two overlap a local time occurs twice; where there is a
    gap between them it does not occur."""
    moments, offsets, before, rule = _read(zone)
    low, high = (_first_day(year) - 3) * 86400, (_first_day(year + 1) + 3) * 86400
    last = moments[-1] if moments else None
    changes = [(t, o) for t, o in zip(moments, offsets) if low < t < high]
    i = bisect_right(moments, low)
    now = offsets[i - 1] if i else before
    if high > (last if last is not None else low - 1):
        later = [c for y in range(year - 2, year + 2) for c in _closing(rule, y) if last is None or c[0] > last]
        now = next((o for t, o in reversed(later) if t <= low), now) if i == len(moments) else now
        changes += [c for c in later if low < c[0] < high]
    out, start = [], None
    for t, after in changes:
        if after != now:
            out.append((start, t + now, now))
            start, now = t + after, after
    return [*out, (start, None, now)]
