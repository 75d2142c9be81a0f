"""A plain row-by-row reading of timestamp text, used only by tests."""

import re
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

ABBR = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420, "JST": 540, "AEST": 600, "AEDT": 660}
MON = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAY = "mon tue wed thu fri sat sun".split()
EPOCH = datetime(1970, 1, 1)


def micros(naive: datetime) -> int:
    return (naive - EPOCH) // timedelta(microseconds=1)


def read(text, zone, locale):
    if text is None:
        return None
    t = text.strip()
    if m := re.fullmatch(r"(\d+)(?:\.(\d+))?", t):
        n = len(m[1])
        if n == 8:
            t = f"{t[:4]}-{t[4:6]}-{t[6:]}"
        else:
            scale = 0 if n <= 11 else 3 if n <= 14 else 6
            return int(m[1]) * 10 ** (6 - scale) + (int((m[2] + "000000")[:6]) if m[2] else 0)
    if m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(.*)", t):
        t = f"{m[1]}-{m[2]}-{m[3]}T{m[4]}:{m[5]}:{m[6]}{m[7]}"
    bracket = None
    if m := re.fullmatch(r"(.*)\[(.*)\]", t):
        t, bracket = m[1], m[2]
    want_day = None
    if m := re.match(r"([A-Z][a-z]{2}), ", t):
        want_day, t = DAY.index(m[1].lower()), t[5:]
    offset = None
    if m := re.fullmatch(r"(.*?)\s*([+-])(\d\d):?(\d\d)", t) if ":" in t else None:
        t, offset = m[1], (int(m[3]) * 60 + int(m[4])) * (-1 if m[2] == "-" else 1)
    elif m := re.fullmatch(r"(.*\d)\s*([A-Za-z]{1,5})", t):
        if m[2].upper() not in ("AM", "PM"):
            if m[2].upper() not in ABBR:
                return None
            t, offset = m[1], ABBR[m[2].upper()]
    if m := re.fullmatch(r"(\d{4})-(\d\d?)-(\d\d?)(?:[T ](.*))?", t):
        y, mo, d, clock = m[1], m[2], m[3], m[4]
    elif m := re.fullmatch(r"(\d\d?)[/.](\d\d?)[/.](\d{4})(?:,? (.*))?", t):
        y, clock = m[3], m[4]
        mo, d = (m[1], m[2]) if locale == "en-US" else (m[2], m[1])
    elif m := re.fullmatch(r"(\d\d?) ([A-Z][a-z]{2}) (\d{4})(?: (.*))?", t):
        y, mo, d, clock = m[3], MON.index(m[2].lower()) + 1, m[1], m[4]
    else:
        return None
    h = mi = s = us = 0
    if clock:
        m = re.fullmatch(r"(\d\d?):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?: ([AP]M))?", clock)
        if not m:
            return None
        h, mi, s, us = int(m[1]), int(m[2]), int(m[3] or 0), int(((m[4] or "") + "000000")[:6])
        if m[5]:
            if not 1 <= h <= 12:
                return None
            h = h % 12 + (12 if m[5] == "PM" else 0)
    try:
        naive = datetime(int(y), int(mo), int(d), h, mi, s, us)
    except ValueError:
        return None
    if want_day is not None and date(naive.year, naive.month, naive.day).weekday() != want_day:
        return None
    if offset is not None:
        return micros(naive) - offset * 60_000_000
    z = ZoneInfo(bracket or zone or "UTC")
    # fold=0: the earlier of two; in a gap it uses the offset before the jump, i.e. forward.
    return micros(naive.replace(tzinfo=z, fold=0).astimezone(timezone.utc).replace(tzinfo=None))
