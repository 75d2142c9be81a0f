"""Batch ingest: one pass of column functions over new rows, and the rows derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import named_date
from palimpsest.functions.decay import clamp_veracity
from palimpsest.functions.media import sanitised
from palimpsest.functions.rules import memory_type
from palimpsest.functions.text import content_id, entities, secrets
from palimpsest.operators.patterns import emotion, gist, statements, time_scope

# How far each kind of source is trusted.
TRUST = {"user": "high", "conversation": "high", "document": "medium", "import": "medium", "insight": "medium", "tool": "low", "web": "low"}


def trust_tier(source: Column) -> Column:
    pairs = [F.lit(x) for kv in TRUST.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.trim(source))), F.lit("unverified"))


def enriched(rows: DataFrame) -> DataFrame:
    """New rows (id, content, source, veracity, created_at, ...) with sanitised content and derived columns.

    Rows without content are left out; a missing id is the hash of content and source.
    """
    clean = sanitised(F.col("content"))
    seen = rows.where("content is not null").withColumn("__clean", clean)
    named = named_date(F.col("content"), F.to_date("created_at"))
    return seen.withColumns(
        {
            "id": F.coalesce("id", content_id(F.col("content"), F.coalesce("source", F.lit("")))),
            "content": F.col("__clean.content"),
            "blob": F.col("__clean.sha256"),
            "trust_tier": trust_tier(F.col("source")),
            "veracity": clamp_veracity(F.col("veracity")),
            "memory_type": memory_type(F.col("content"))["type"],
            "event_date": named["event_date"],
            "date_precision": named["precision"],
            "secret_labels": secrets(F.col("content")),
            "gist": gist(F.col("content")),
            "emotion": emotion(F.col("content")),
            "time_scope": time_scope(F.col("content")),
        }
    ).drop("__clean")


def annotations(rows: DataFrame) -> DataFrame:
    """(memory_id, kind, value) of enriched rows: mentions, occurred_on, has_source; each once."""
    of = lambda kind, value: rows.select(F.col("id").alias("memory_id"), F.lit(kind).alias("kind"), value.alias("value"))
    out = of("mentions", F.explode(entities(F.col("content")))).unionByName(of("occurred_on", F.col("event_date").cast("string"))).unionByName(of("has_source", F.col("source")))
    return out.where("value is not null").distinct()


def statement_rows(rows: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, confidence) of the texts' plain statements."""
    s = rows.select("id", F.explode(statements(F.col("content"))).alias("s"))
    return s.select("id", "s.subject", "s.predicate", "s.object", F.lit(0.7).alias("confidence"))


def fact_id(subject: Column, predicate: Column, obj: Column) -> Column:
    """Content hash of length-prefixed parts, so that no two triples share a rendering."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.concat(F.lit("cf_"), F.substring(F.sha2(F.concat(part(subject), part(predicate), part(obj)), 256), 1, 24))
