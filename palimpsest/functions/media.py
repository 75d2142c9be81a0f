"""References to media, identities of their spans, and blobs inside text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import entropy

SIZE_CAP = 1_000_000
CHECK_FROM = 100_000
ENTROPY_LIMIT = 5.0


def normal_ref(kind: Column, value: Column) -> Column:
    """Digests in lower case, URLs with scheme and host in lower case, paths as they are."""
    k, v = F.lower(F.trim(kind)), F.trim(value)
    head = F.regexp_extract(v, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    url = F.concat(F.lower(head), F.substring(v, F.length(head) + 1, F.length(v)))
    return F.when(k.isin("sha256", "blob"), F.lower(v)).when(k == "url", url).otherwise(v)


def asset_id(kind: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lower(F.trim(kind)), normal_ref(kind, value)), 256), 1, 24)


def upserted(assets: DataFrame) -> DataFrame:
    """Assets (kind, ref, mime, at) once per identity: asset_id, ref in its normal form, the last known type and time."""
    seen = assets.withColumns({"asset_id": asset_id(F.col("kind"), F.col("ref")), "normal": normal_ref(F.col("kind"), F.col("ref"))})
    return seen.groupBy("asset_id").agg(F.min("normal").alias("ref"), F.max_by("mime", F.when(F.col("mime").isNotNull(), F.col("at"))).alias("mime"), F.max("at").alias("at"))


def guarded(moments: DataFrame, assets: DataFrame) -> DataFrame:
    """Moments whose asset exists."""
    return moments.join(assets.select("asset_id"), "asset_id", "left_semi")


def orphans(moments: DataFrame, assets: DataFrame) -> DataFrame:
    """Moments whose asset does not exist."""
    return moments.join(assets.select("asset_id"), "asset_id", "left_anti")


def span_key(kind: Column, start: Column, end: Column, box: Column | None = None, speaker: Column | None = None) -> Column:
    """v1:kind:payload[:spk=speaker]; an open time ends in 'na', an open page range is one page, a box has six decimals."""
    k = F.lower(F.trim(kind))
    s, e = start.cast("string"), end.cast("string")
    boxed = F.array_join(F.transform(box, lambda x: F.format_string("%.6f", x.cast("double"))), ",") if box is not None else F.lit(None).cast("string")
    payload = F.when(k == "time", F.concat_ws("-", s, F.coalesce(e, F.lit("na")))).when(k == "page", F.concat_ws("-", s, F.coalesce(e, s))).when(k == "char", F.concat_ws("-", s, e)).when(k == "box", boxed)
    # A whole asset has no payload; an unknown kind, or one without its numbers, has no key.
    key = F.when(k == "whole", F.lit("v1:whole")).when(payload.isNotNull() & (payload != ""), F.concat_ws(":", F.lit("v1"), k, payload))
    if speaker is None:
        return key
    slug = F.regexp_replace(F.lower(F.trim(speaker)), r"[^a-z0-9]+", "-")
    return F.when(F.coalesce(slug, F.lit("")) != "", F.concat(key, F.lit(":spk="), slug)).otherwise(key)


def sanitised(content: Column) -> Column:
    """struct(content, reason, sha256, size): data URIs, oversized and encoded-looking contents become a reference."""
    data = F.regexp_extract(content, r"^data:([\w/+.-]*);base64,([A-Za-z0-9+/=\s]+)$", 2)
    size = F.octet_length(content)
    raw = F.when(data != "", F.try_to_binary(F.regexp_replace(data, r"\s", ""), F.lit("base64")))
    # The entropy of short texts is never looked at.
    coded = F.when((size > CHECK_FROM) & (size <= SIZE_CAP), entropy(content) > ENTROPY_LIMIT).otherwise(False)
    reason = F.when(raw.isNotNull(), "data_uri").when(size > SIZE_CAP, "size_cap").when(coded, "high_entropy")
    digest = F.when(reason.isNotNull(), F.sha2(F.coalesce(raw, content.cast("binary")), 256))
    bytes_ = F.coalesce(F.octet_length(raw), size)
    return F.struct(F.when(reason.isNotNull(), F.concat(F.lit("[extracted: blob://sha256/"), digest, F.lit("]"))).otherwise(content).alias("content"), reason.alias("reason"), digest.alias("sha256"), bytes_.alias("size"))
