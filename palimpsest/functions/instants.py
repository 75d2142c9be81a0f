"""Timestamp text to UTC instants, as JVM expressions only.

``with_candidates`` adds every valid reading of a text as an array of
``struct<prior double, fmt string, us long>``.  A reading's ``prior`` says how
far it departs from what the row's clock declares: 0 for the declared reading,
``RULED_OUT`` for one that the declaration rejects, ``SOFT`` for a second one
where nothing is declared.  ``with_instant`` keeps only the declared reading.

Rules: an offset, zone or epoch number means what it says; other text is wall
time of the given zone (a null or unknown zone: UTC).  A wall time that occurs
twice is the earlier instant, one that never occurs moves forward by the length
of the jump.  With the year last and both other parts numbers, en-US is month
first, any other locale day first.  Digits beyond microseconds are cut off,
missing smaller units are zero.  Text that names no existing date and time (a
null, an empty text, words, 30 February, a weekday that the date does not have,
an unknown zone) has no reading: an empty array, a null instant.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULED_OUT = 1e6
# More than a change of format, less than a jump back: only an order of events that it mends speaks for the second reading.
SOFT = 1.5
# Eight digits that form a date would be seconds of the year 1970: more than one jump back has to speak for it.
SOFT_EPOCH = 3.0

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000

# Zone abbreviations and their minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

_ZONE = r"(Z|z|[A-Z]{2,5}|(?:GMT|UTC)?[+-]\d{2}:?\d{2}|[+-]\d{2})?(?:\[([A-Za-z0-9_+/-]+)\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_DAYNAME = r"(?:([A-Za-z]{3})[a-z]*,?\s+)?"
# Every pattern is rewritten to kind|p1|p2|p3|hour|minute|second|fraction|meridiem|zone|bracket|weekday.
PATTERNS = {
    "iso": (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:[Tt]|\s+){_CLOCK}\s*{_ZONE})?$", "iso|$1|$3|$4|$5|$6|$7|$8||$9|$10|"),
    "compact": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?\s*{_ZONE})?$", "compact|$1|$2|$3|$4|$5|$6|$7||$8|$9|"),
    "epoch": (r"^([+-]?\d{1,19})(?:[.,](\d+))?$", "epoch|$1||||||$2||||"),
    "yearlast": (rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}})(?:(?:[Tt]|,?\s+){_CLOCK}\s*([AaPp][Mm])?\s*{_ZONE})?$", "yearlast|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|"),
    "named": (rf"^{_DAYNAME}(\d{{1,2}})[\s-]+([A-Za-z]{{3}})[a-z]*\.?,?[\s-]+(\d{{4}})(?:,?\s+{_CLOCK}\s*([AaPp][Mm])?\s*{_ZONE})?$", "named|$4|$3|$2|$5|$6|$7|$8|$9|$10|$11|$1"),
    "monthfirst": (rf"^{_DAYNAME}([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_CLOCK}\s*([AaPp][Mm])?\s*{_ZONE})?$", "named|$4|$2|$3|$5|$6|$7|$8|$9|$10|$11|$1"),
}

CANDIDATES = "array<struct<prior:double,fmt:string,us:bigint>>"


def _all_zones() -> list[str]:
    return sorted(zoneinfo.available_timezones())


def known_zone(zone: Column) -> Column:
    """The zone where it is an IANA name, else null."""
    return F.when(F.array_contains(F.array(*[F.lit(z) for z in _all_zones()]), zone), zone)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def _fields(text: Column) -> Column:
    t, out = text, F.lit(None).cast("string")
    for pattern, rewrite in reversed(PATTERNS.values()):
        out = F.when(t.rlike(pattern), F.regexp_replace(t, pattern, rewrite)).otherwise(out)
    return F.split(out, r"\|", -1)


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _to_utc(local: Column, zone: Column) -> Column:
    """Micros of a wall time to micros UTC: the earlier of two, forward over a gap."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone))


def _to_wall(us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def barrier(value: Column) -> Column:
    """The same value, from a projection that filters are not pushed through.

    A filter pushed through the stages below would have each stage's expressions
    written out inside the next one's, at every use: exponential in the stages.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _date_us(y: str, m: str, d: str) -> Column:
    """Microseconds of a date's midnight, null if there is no such date."""
    y, m, d = F.col(y), F.col(m), F.col(d)
    first = F.when(m.between(1, 12) & y.between(1, 9999), F.make_date(y, m, F.lit(1)))
    return F.when(d.between(1, 28) | d.between(1, F.dayofmonth(F.last_day(first))), F.unix_date(first).cast("long") + d - 1) * DAY_US


def _parsed(df: DataFrame, text: str, zone: Column, locale: Column, later: bool) -> tuple[DataFrame, list[str]]:
    """Add the working columns of one text; returns them by name too.

    ``__us`` is the declared reading and ``__us_alt`` that of the other order of
    day and month; with ``later``, ``__us_later`` and ``__us_alt_later`` are the
    second instants of wall times that occur twice.  Stages of plain columns keep
    every regular expression to one run and the generated code small.
    """
    f = lambda i: F.col("__f")[i]
    kind = F.col("__kind")
    position = lambda col, names: F.array_position(F.array(*[F.lit(x) for x in names]), F.lower(F.substring(col, 1, 3))).cast("int")
    frac = F.substring(F.rpad(f(7), 6, "0"), 1, 6).try_cast("long")
    zone_text = F.regexp_replace(f(9), "^(GMT|UTC)(?=[+-])", "")
    stages: list[dict[str, Column]] = [
        {"__t": _trim(F.col(text))},
        {"__f": _fields(F.col("__t")), "__in_zone": F.coalesce(zone, F.lit("UTC")), "__month_first": F.coalesce(locale == "en-US", F.lit(False))},
        {
            "__kind": f(0),
            "__n1": _int(f(1)),
            "__n2": F.when(f(0) == "named", position(f(2), MONTHS)).otherwise(_int(f(2))),
            "__n3": _int(f(3)),
            "__h": _int(f(4)),
            "__mi": F.coalesce(_int(f(5)), F.lit(0)),
            "__s": F.coalesce(_int(f(6)), F.lit(0)),
            "__frac": F.when(F.length(f(7)) > 0, frac).otherwise(F.lit(0).cast("long")),
            "__mer": F.lower(f(8)),
            "__z": F.when(f(9) != "", zone_text),
            "__bracket": F.when(f(10) != "", f(10)),
            "__wd": F.when(f(11) != "", F.coalesce(position(f(11), WEEKDAYS), F.lit(0))),
            "__whole": F.when(f(0) == "epoch", f(1).try_cast("decimal(20,0)").cast("long")).when(
                (f(0) == "compact") & (f(4) == ""), F.concat(f(1), f(2), f(3)).try_cast("long")
            ),
            # The number of digits tells seconds, milliseconds, microseconds or nanoseconds.
            "__width": F.length(F.regexp_replace(f(1), "[+-]", "")),
        },
        {
            "__main": F.when(kind != "yearlast", _date_us("__n1", "__n2", "__n3")),
            "__dm": F.when(kind == "yearlast", _date_us("__n3", "__n2", "__n1")),
            "__md": F.when(kind == "yearlast", _date_us("__n3", "__n1", "__n2")),
            "__hour": F.when(F.col("__mer") == "", F.coalesce(F.col("__h"), F.lit(0))).when(
                F.col("__h").between(1, 12), F.col("__h") % 12 + F.when(F.col("__mer") == "pm", 12).otherwise(0)
            ),
            "__zone_digits": F.when(F.col("__z").rlike("^[+-]"), F.regexp_replace(F.substring(F.col("__z"), 2, 6), ":", "")),
        },
        {
            "__clock": F.when(
                F.col("__hour").between(0, 23) & F.col("__mi").between(0, 59) & F.col("__s").between(0, 59),
                ((F.col("__hour").cast("long") * 60 + F.col("__mi")) * 60 + F.col("__s")) * 1_000_000 + F.col("__frac"),
            ),
            "__oh": F.substring("__zone_digits", 1, 2).try_cast("int"),
            "__om": F.coalesce(F.substring("__zone_digits", 3, 2).try_cast("int"), F.lit(0)),
            "__day": F.when(kind == "yearlast", F.when(F.col("__month_first"), F.col("__md")).otherwise(F.col("__dm"))).otherwise(F.col("__main")),
            "__day_alt": F.when(kind == "yearlast", F.when(F.col("__month_first"), F.col("__dm")).otherwise(F.col("__md"))),
            "__wall_zone": F.when(F.col("__bracket").isNotNull(), known_zone(F.col("__bracket"))).otherwise(F.col("__in_zone")),
        },
        {
            "__offset": F.when(F.col("__zone_digits").isNull(), F.element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), F.upper("__z"))).when(
                (F.col("__oh") <= 18) & (F.col("__om") <= 59), (F.col("__oh") * 60 + F.col("__om")) * F.when(F.col("__z").startswith("-"), -1).otherwise(1)
            ),
            "__local": F.when(F.col("__wd").isNull() | (F.col("__wd") == F.pmod(F.expr("__day div 86400000000") + 3, F.lit(7)) + 1), F.col("__day") + F.col("__clock")),
            "__local_alt": F.col("__day_alt") + F.col("__clock"),
            "__epoch": F.when(F.col("__width") <= 11, F.col("__whole") * 1_000_000 + F.when(f(1).startswith("-"), -F.col("__frac")).otherwise(F.col("__frac")))
            .when(F.col("__width") <= 14, F.col("__whole") * 1000 + F.expr("__frac div 1000"))
            .when(F.col("__width") <= 17, F.col("__whole"))
            .otherwise(F.expr("__whole div 1000")),
        },
    ]

    def instant(local: str) -> Column:
        local = F.col(local)
        return F.when(F.col("__z").isNotNull(), local - F.col("__offset").cast("long") * 60_000_000).when(F.col("__wall_zone") == "UTC", local).otherwise(_to_utc(local, F.col("__wall_zone")))

    def second(local: str, us: str) -> Column:
        again = lambda gap: F.when(_to_wall(F.col(us) + gap, F.col("__wall_zone")) == F.col(local), F.col(us) + gap)
        return F.when(F.col("__z").isNull() & (F.col("__wall_zone") != "UTC"), F.coalesce(again(HOUR_US), again(HOUR_US // 2)))

    in_range = lambda us: F.when(us.between(-62_135_596_800_000_000, 253_402_300_799_999_999), us)
    stages.append({"__us": in_range(F.when(kind == "epoch", F.col("__epoch")).otherwise(instant("__local")))})
    if later:
        stages[-1]["__us_alt"] = in_range(instant("__local_alt"))
        stages.append({"__us_later": second("__local", "__us"), "__us_alt_later": second("__local_alt", "__us_alt")})
    for stage in stages:
        df = df.withColumns(stage)
    return df, [c for stage in stages for c in stage]


def with_candidates(df: DataFrame, text: str, zone: Column, locale: Column, out: str = "candidates", infer: bool = False) -> DataFrame:
    """Add ``out``, all valid readings of column ``text``.

    ``zone`` and ``locale`` are what the row's clock declares.  With ``infer`` a
    null locale declares nothing: month first, and eight digits as epoch seconds,
    stay open beside day first and the date, at ``SOFT`` and ``SOFT_EPOCH``.  Otherwise a null locale
    is one that is not en-US, i.e. day first.
    """
    df, made = _parsed(df.withColumn("__open", locale.isNull() if infer else F.lit(False)), text, zone, locale, True)
    yearlast = F.col("__kind") == "yearlast"
    order = lambda first: F.when(first, "month/day").otherwise("day/month")
    fmt = F.when(yearlast, order(F.col("__month_first"))).when(F.col("__kind") == "epoch", F.concat(F.lit("epoch"), F.col("__width").cast("string"))).otherwise(F.col("__kind"))
    alt = order(~F.col("__month_first"))
    other = F.when(F.col("__open"), F.lit(SOFT)).otherwise(F.lit(RULED_OUT))
    reading = lambda prior, name, us: F.struct(prior.cast("double").alias("prior"), name.alias("fmt"), us.alias("us"))
    every = F.array(
        reading(F.lit(0.0), fmt, F.col("__us")),
        reading(F.lit(RULED_OUT), fmt, F.col("__us_later")),
        reading(other, alt, F.col("__us_alt")),
        reading(F.lit(2 * RULED_OUT), alt, F.col("__us_alt_later")),
        reading(F.when(F.col("__open"), F.lit(SOFT_EPOCH)).otherwise(F.lit(RULED_OUT)), F.lit("epoch8"), F.when(F.col("__kind") == "compact", F.col("__epoch"))),
    )
    single = F.coalesce("__us_later", "__us_alt", F.when(F.col("__kind") == "compact", F.col("__epoch"))).isNull() & F.col("__us").isNotNull()
    value = F.when(single, F.array(reading(F.lit(0.0), fmt, F.col("__us")))).otherwise(F.filter(every, lambda x: x["us"].isNotNull()))
    return df.withColumn(out, barrier(value.cast(CANDIDATES))).drop("__open", *made)


def with_instant(df: DataFrame, text: str, zone: Column, locale: Column, out: str) -> DataFrame:
    """Add ``out``, the declared instant of column ``text`` in epoch microseconds (null: none)."""
    df, made = _parsed(df, text, zone, locale, False)
    return df.withColumn(out, barrier(F.col("__us"))).drop(*made)
