"""Row filters as column expressions.  A null operand never matches unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIALOG_SOURCES = ["conversation", "honcho_message"]  # Fixed values: sources left out of dense search.


def still_valid(valid_until: Column, ref_us: int) -> Column:
    """No expiry, or a readable one after the reference time; at the boundary it is expired, unreadable is excluded."""
    return valid_until.isNull() | F.coalesce(F.unix_micros(F.try_to_timestamp(valid_until)) > ref_us, F.lit(False))


def in_scope(session: Column, scope: Column, wanted: str | None, channel: Column | None = None, wanted_channel: str | None = None, everywhere: bool = False) -> Column:
    if everywhere:
        return F.lit(True)
    hit = F.coalesce(session == wanted, F.lit(False)) | F.coalesce(scope == "global", F.lit(False))
    return hit | F.coalesce(channel == wanted_channel, F.lit(False)) if channel is not None else hit


def equal_to(**wanted: str | None) -> Column:
    """All given columns equal their values; a value of None asks nothing."""
    out = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            out = out & F.coalesce(F.col(name) == value, F.lit(False))
    return out


def between_dates(iso: Column, start: str | None, end: str | None) -> Column:
    """Inclusive by text: from T00:00:00 of the first day to T23:59:59 of the last."""
    out = F.lit(True)
    if start:
        out = out & (iso >= f"{start}T00:00:00")
    if end:
        out = out & (iso <= f"{end}T23:59:59")
    return out


def dense_eligible(source: Column, consolidated_at: Column | None = None) -> Column:
    ok = source.isNull() | ~source.isin(DIALOG_SOURCES)
    return ok & consolidated_at.isNull() if consolidated_at is not None else ok


def contains_any(columns: list[Column], needle: str) -> Column:
    """Case-insensitive substring in any of the columns; % and _ are ordinary characters."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return out


def same_nocase(a: Column, b: Column | str) -> Column:
    return F.lower(a) == (b.lower() if isinstance(b, str) else F.lower(b))


def json_member(json_array: Column, value: Column | str) -> Column:
    return F.coalesce(F.array_contains(F.from_json(json_array, "array<string>"), value), F.lit(False))


def csv_member(csv: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(F.split(csv, ","), value), F.lit(False))


def due_for_consolidation(pinned: Column, consolidated_at: Column, created_us: Column, cutoff_us: int) -> Column:
    return ~F.coalesce(pinned, F.lit(False)) & consolidated_at.isNull() & (created_us < cutoff_us)


def preview(content: Column, size: int = 500) -> Column:
    return F.substring(content, 1, size)


def allowed_columns(df: DataFrame, allow: list[str]) -> DataFrame:
    return df.select([c for c in allow if c in df.columns])


def flag_collision(query: str, content: Column) -> Column:
    """The query names a --flag and the content has only its bare word."""
    import re

    flags = list(dict.fromkeys(re.findall(r"(?<![\w-])--?[a-z0-9][\w-]*", query.lower())))
    if not flags:
        return F.lit(False)
    low = F.lower(content)
    literal, bare = F.lit(False), F.lit(False)
    for f in flags:
        literal = literal | F.contains(low, F.lit(f))
        bare = bare | low.rlike(r"\b" + re.escape(f.lstrip("-")) + r"\b")
    return F.coalesce(bare & ~literal, F.lit(False))


def long_fact(text: Column, least: int = 10) -> Column:
    return F.length(text) > least
