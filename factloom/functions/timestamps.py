"""Readings of a timestamp text: every instant it can name, with the order of day and month each assumes.

``readings`` handles ISO forms, compact forms, Unix seconds and milliseconds, all-figure dates in either
order with the time before or after, dates with English or Vietnamese month words, 12-hour clocks, zone
offsets and common zone abbreviations. Text that does not name a full day, or that holds words which
are not part of a date, has no reading. A reading without zone is local to ``zone``; a local time that
occurs twice is the earlier one, one skipped by a clock change keeps the offset valid before it.

``interpretations`` adds what else a text could mean, at a cost: the later of two equal local times, and the other
zones that share an abbreviation. Where the source's own zone uses the abbreviation, its offset is the one without cost.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import UTC, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

FREE, DAY_FIRST, MONTH_FIRST = 0, 1, 2

# Month names, zone abbreviations in minutes from UTC, words that may stand beside a date.
MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
MONTHS |= {m[:3]: i for m, i in MONTHS.items()} | {"sept": 9}
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "ict": 420, "wib": 420, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630,
    "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "brt": -180,
}
# Further offsets in minutes of abbreviations that several zones share.
SHARED_ZONES = {
    "ist": (60, 120), "bst": (360,), "cst": (480, -300), "cdt": (-240,), "est": (600,), "edt": (660,), "mst": (480, 390), "pst": (480,), "msk": (240,),
}
UNLIKELY = 1.5
WORDS = set(
    "thứ hai ba tư năm sáu bảy chủ nhật ngày lúc vào at on cập đăng "
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun updated published posted uhr um".split()
)

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_HALF = r"(?:\s*(?P<half>am|pm|a\.m\.|p\.m\.|sa|ch)(?![\w]))?"
_ABBR = "|".join(sorted(ZONES, key=len, reverse=True))
_ZONE = rf"(?:\s*\(?\s*(?:(?P<abbr>{_ABBR})(?![a-z]))?\s*(?P<off>[+-]\d{{1,2}}(?::?\d{{2}})?)?(?!\d)\s*\)?)"
_CLOCK = re.compile(rf"(?<![\d:.]){_TIME}{_HALF}{_ZONE}")
_ISO_CLOCK = re.compile(rf"(?<=\d)t{_TIME}{_ZONE}")
_ISO = re.compile(r"(?<!\d)(?P<y>\d{4})([-/.])(?P<m>\d{1,2})\2(?P<d>\d{1,2})(?!\d)")
_COMPACT = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:t?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:\.(?P<f>\d+))?\s*(?P<z>z|[+-]\d{2}:?\d{2})?)?")
_FIGURES = re.compile(r"(?<![\d:])(?P<a>\d{1,2})([-/.])(?P<b>\d{1,2})\2(?P<y>\d{4}|\d{2})(?![\d:])")
_VIET = re.compile(r"(?<!\d)(?P<d>\d{1,2})\s+tháng\s+(?P<m>\d{1,2})\s*(?:,|năm)?\s*(?P<y>\d{4})(?!\d)")
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
_DMY_WORD = re.compile(rf"(?<!\d)(?P<d>\d{{1,2}})(?:st|nd|rd|th|\.)?[\s-]+(?P<mn>{_MONTH})\.?,?[\s-]+(?P<y>\d{{4}})(?!\d)")
_MDY_WORD = re.compile(rf"(?<![a-z])(?P<mn>{_MONTH})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?!\d)")
_ALONE = re.compile(rf"\(?\s*(?<![a-z])(?P<abbr>{_ABBR})(?![a-z])\s*(?P<off>[+-]\d{{1,2}}(?::?\d{{2}})?)?(?!\d)\s*\)?|\(?\s*(?P<off2>[+-]\d{{1,2}}(?::?\d{{2}})?)(?!\d)\s*\)?")
_EPOCH = re.compile(r"(?P<s>\d{10})(?:\.\d*)?|(?P<ms>\d{13})")
_LEFT = re.compile(r"[^\W\d_]+|\d+|[^\s\w,|()\-–.]")


@lru_cache(256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _minutes(offset: str) -> int | None:
    sign, digits = (-1 if offset[0] == "-" else 1), offset[1:].replace(":", "")
    hours, rest = (int(digits[:-2]), int(digits[-2:])) if len(digits) > 2 else (int(digits), 0)
    return sign * (hours * 60 + rest) if hours <= 15 and rest < 60 else None


def _instants(y: int, m: int, d: int, clock: tuple[int, int, int], offset: int | None, zone: str | None) -> list[int]:
    """The instants a local time names: one, two where it occurs twice (the earlier first), or none."""
    try:
        local = datetime(y + 2000 if y < 100 else y, m, d, *clock)
        if offset is not None:
            return [int(local.replace(tzinfo=timezone(timedelta(minutes=offset))).timestamp())]
        own = _zone(zone) if zone else None
        if own is None:
            return []
        first, second = (int(local.replace(tzinfo=own, fold=f).timestamp()) for f in (0, 1))
        return [first, second] if second > first else [first]
    except (ValueError, OverflowError):
        return []


def _offsets(abbr: str | None, more: int, zone: str | None, at: datetime) -> list[tuple[int, float]]:
    """(minutes, cost) of the offsets an abbreviation may stand for, ``more`` added; the source's own zone decides if it uses it."""
    every = [ZONES[abbr], *SHARED_ZONES.get(abbr, ())] if abbr else [0]
    likely = every[0]
    own = _zone(zone) if zone and len(every) > 1 else None
    if own is not None:
        local = at.replace(tzinfo=own)
        minutes = int(local.utcoffset().total_seconds()) // 60
        if (local.tzname() or "").lower() == abbr and minutes in every:
            likely = minutes
    return sorted(((o + more, 0.0 if o == likely else UNLIKELY) for o in every), key=lambda x: x[1])


def _clock_of(m: re.Match[str] | None) -> tuple[tuple[int, int, int], str | None, int | None] | None:
    """The time of day, the zone's abbreviation and the offset in figures of a match; None if it is no valid time."""
    if m is None:
        return (0, 0, 0), None, None
    g = m.groupdict()
    h, half = int(g["h"]), (g.get("half") or "").replace(".", "")
    if half:
        if not 1 <= h <= 12:
            if half in ("am", "sa") or h > 23:
                return None
        else:
            h = h % 12 + (12 if half in ("pm", "ch") else 0)
    more = None
    if g.get("off"):
        more = _minutes(g["off"])
        if more is None:
            return None
    return (h, int(g["mi"]), int(g["s"] or 0)), g.get("abbr"), more


def readings(raw: str | None, zone: str | None = None) -> list[tuple[int, int]]:
    """(order, Unix seconds) of each likely reading, fractions cut off; empty if the text names no instant."""
    return [(order, at) for order, at, cost in interpretations(raw, zone) if cost == 0]


def interpretations(raw: str | None, zone: str | None = None) -> list[tuple[int, int, float]]:
    """(order, Unix seconds, cost) of each reading, likely ones first."""
    if raw is None:
        return []
    text = unicodedata.normalize("NFKC", raw).strip().lower().replace("−", "-")
    if not text or not any(c.isdigit() for c in text):
        return []
    if e := _EPOCH.fullmatch(text):
        return [(FREE, int(e["s"]) if e["s"] else int(e["ms"]) // 1000, 0.0)]
    if c := _COMPACT.fullmatch(text):
        clock = (int(c["h"] or 0), int(c["mi"] or 0), int(c["s"] or 0))
        offset = None if not c["z"] else 0 if c["z"] == "z" else _minutes(c["z"])
        found = _instants(int(c["y"]), int(c["m"]), int(c["d"]), clock, offset, zone)
        return [(FREE, at, UNLIKELY * i) for i, at in enumerate(found)]
    for pattern in (_ISO, _VIET, _DMY_WORD, _MDY_WORD, _FIGURES):
        if found := pattern.search(text):
            break
    else:
        return []
    rest = text[: found.start()] + " \x00 " + text[found.end() :]
    timed = _ISO_CLOCK.search(text) or _CLOCK.search(rest)
    if timed and timed.re is _ISO_CLOCK:
        rest = text[: found.start()] + " " + text[timed.end() :] if timed.start() == found.end() else "?"
    elif timed:
        rest = rest[: timed.start()] + " " + rest[timed.end() :]
    parts = _clock_of(timed)
    rest = rest.replace("\x00", " ")
    if parts is None:
        return []
    clock, abbr, more = parts
    if abbr is None and more is None and (alone := _ALONE.search(rest)):
        offset, abbr = alone["off"] or alone["off2"], alone["abbr"]
        more = _minutes(offset) if offset else 0
        if more is None:
            return []
        rest = rest[: alone.start()] + " " + rest[alone.end() :]
    if any(w not in WORDS for w in _LEFT.findall(rest)):
        return []
    g = found.groupdict()
    if pattern is _FIGURES:
        a, b, y = int(g["a"]), int(g["b"]), int(g["y"])
        orders = [(DAY_FIRST, b, a), (MONTH_FIRST, a, b)] if a != b else [(FREE, a, b)]
    else:
        y = int(g["y"])
        orders = [(FREE, MONTHS[g["mn"]] if g.get("mn") else int(g["m"]), int(g["d"]))]
    out = []
    for order, month, day in orders:
        try:
            local = datetime(y + 2000 if y < 100 else y, month, day, *clock)
        except ValueError:
            continue
        ways = [(None, 0.0)] if abbr is None and more is None else _offsets(abbr, more or 0, zone, local)
        for offset, cost in ways:
            out += [(order, at, cost + UNLIKELY * i) for i, at in enumerate(_instants(y, month, day, clock, offset, zone))]
    return sorted(out, key=lambda x: x[2])


def as_text(seconds: int) -> str:
    """``yyyy-MM-ddTHH:mm:ssZ``."""
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
