"""Dates named in natural language, against an explicit reference date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months and weekdays.
MONTH_NAMES = "january february march april may june july august september october november december".split()
DAY_NAMES = "monday tuesday wednesday thursday friday saturday sunday".split()
_MONTHS = "|".join(MONTH_NAMES + [m[:3] for m in MONTH_NAMES if len(m) > 3])
_DAYS = "|".join(DAY_NAMES + [d[:3] for d in DAY_NAMES])


def _safe_date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def _group(text: Column, pattern: str, n: int) -> Column:
    g = F.regexp_extract(text, pattern, n)
    return F.when(g != "", g)


def weekday_date(text: Column, reference: Column) -> Column:
    """The date of the first weekday that a text names: last, this or next one, else the most recent of a full name."""
    return _weekdays(F.lower(F.trim(text)), reference)


def _weekdays(low: Column, reference: Column) -> Column:
    day_no = lambda name: F.array_position(F.array(*[F.lit(d[:3]) for d in DAY_NAMES]), F.substring(name, 1, 3)).cast("int") - 1
    today = F.weekday(reference)
    back = lambda day: F.date_sub(reference, F.pmod(today - day, F.lit(7)))
    relative = rf"\b(last|this|next)\s+({_DAYS})\b"
    which, day = _group(low, relative, 1), day_no(_group(low, relative, 2))
    ahead = F.pmod(day - today, F.lit(7))
    found = (
        F.when(which == "this", back(day))
        .when(which == "last", F.date_sub(reference, F.when(F.pmod(today - day, F.lit(7)) == 0, 7).otherwise(F.pmod(today - day, F.lit(7)))))
        .when(which == "next", F.date_add(reference, F.when(ahead == 0, 7).otherwise(ahead)))
    )
    return F.coalesce(found, back(day_no(_group(low, rf"\b({'|'.join(DAY_NAMES)})\b", 1))))


def named_date(text: Column, reference: Column) -> Column:
    """struct(event_date, precision) of the first rule that applies, else null fields.

    In order: ISO date; numbers with slashes (month first unless the first is over
    12); month name with day (the reference's year unless given); today, yesterday,
    tomorrow; last / this / next weekday; a bare weekday (the most recent); this /
    last / next week, month, year.  A date that does not exist falls through.
    """
    low = F.lower(F.trim(text))
    iso = r"\b(\d{4})-(\d{2})-(\d{2})\b"
    iso_date = _safe_date(*[_group(text, iso, i).try_cast("int") for i in (1, 2, 3)])
    slash = r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b"
    a, b, y = (_group(text, slash, i).try_cast("int") for i in (1, 2, 3))
    year = F.when(y < 100, y + 2000).otherwise(y)
    slash_date = F.when(a > 12, _safe_date(year, b, a)).otherwise(_safe_date(year, a, b))
    month = rf"\b({_MONTHS})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?\b"
    number = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTH_NAMES]), F.substring(_group(low, month, 1), 1, 3)).cast("int")
    month_date = _safe_date(F.coalesce(_group(low, month, 3).try_cast("int"), F.year(reference)), number, _group(low, month, 2).try_cast("int"))
    unit = r"\b(this|last|next)\s+(week|month|year)\b"
    q, u = _group(low, unit, 1), _group(low, unit, 2)
    sign = F.when(q == "this", 0).when(q == "last", -1).otherwise(1)
    unit_date = F.when(u == "week", F.date_add(reference, sign * 7)).when(u == "month", F.add_months(F.trunc(reference, "month"), sign)).when(u == "year", F.add_months(F.trunc(reference, "year"), sign * 12))
    unit_date = F.when(sign == 0, reference).otherwise(unit_date)
    has = lambda w: low.rlike(rf"\b{w}\b")
    days = F.coalesce(
        iso_date, slash_date, month_date, F.when(has("today"), reference), F.when(has("yesterday"), F.date_sub(reference, 1)), F.when(has("tomorrow"), F.date_add(reference, 1)), _weekdays(low, reference)
    )
    return F.struct(F.coalesce(days, F.when(u.isNotNull(), unit_date)).alias("event_date"), F.when(days.isNotNull(), "day").when(u.isNotNull(), u).alias("precision"))
