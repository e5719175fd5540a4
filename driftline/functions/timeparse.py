"""Time literals of both languages."""

from __future__ import annotations

import calendar
import re
import time

# Seconds of each unit.
UNITS = {"ms": 0.001, "s": 1, "m": 60, "min": 60, "h": 3600, "d": 86400, "w": 604800, "mon": 2592000, "M": 2592000, "y": 31536000}
_LONG = {"second": "s", "seconds": "s", "sec": "s", "minute": "min", "minutes": "min", "hour": "h", "hours": "h", "day": "d", "days": "d", "week": "w", "weeks": "w", "month": "mon", "months": "mon", "year": "y", "years": "y"}
_TERM = re.compile(r"\s*([+-]?)\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)")


def interval_seconds(text: str) -> int:
    """Seconds of a literal such as ``10``, ``90s``, ``5min``, ``1h``, ``2d``, ``1mon``, ``1y``; long unit names are allowed."""
    total, at = 0.0, 0
    text = str(text).strip()
    for m in _TERM.finditer(text):
        if m.start() != at:
            raise ValueError(f"not an interval: {text!r}")
        unit = _LONG.get(m[3], m[3]) or "s"
        if unit not in UNITS:
            raise ValueError(f"unknown unit in {text!r}")
        total += (-1 if m[1] == "-" else 1) * float(m[2]) * UNITS[unit]
        at = m.end()
    if at == 0 or text[at:].strip():
        raise ValueError(f"not an interval: {text!r}")
    return int(total)


def parse_time(text, now: int | None = None) -> int:
    """Epoch seconds of ``now``, ``now()-1h``, an integer, ``-1d`` (before now), ``HH:MM_YYYYMMDD`` (UTC), or a date string."""
    now = int(time.time()) if now is None else now
    text = str(text).strip().strip("'\"")
    if m := re.fullmatch(r"(\d{1,2}):(\d{2})_(\d{4})(\d{2})(\d{2})", text):
        return calendar.timegm((int(m[3]), int(m[4]), int(m[5]), int(m[1]), int(m[2]), 0))
    if m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?Z?", text):
        return calendar.timegm(tuple(int(x or 0) for x in m.groups()))
    if m := re.match(r"now(?:\(\))?", text):
        rest = text[m.end() :].strip()
        return now + (interval_seconds(rest) if rest else 0)
    if re.fullmatch(r"\d+", text):
        return int(text)
    seconds = interval_seconds(text)
    return now + seconds if text.startswith("-") else seconds
