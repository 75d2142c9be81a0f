"""File sources and sinks: JSON export and import, foreign formats, snapshots, banks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.language import mime_of

MEMORY = "id string, content string, source string, timestamp string, session_id string, importance double, metadata map<string,string>, author_id string, author_type string, channel_id string"


def export_json(df: DataFrame, path: str) -> None:
    """One JSON document per row, written in parallel."""
    df.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: str = MEMORY) -> DataFrame:
    """Rows of a declared schema and ``unreadable``, the text of a document that has not this schema (null for the others): nothing is dropped unseen."""
    read = F.from_json("value", f"{schema}, unreadable string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"})
    return spark.read.text(path).where("trim(value) != ''").select(read.alias("r")).select("r.*")


def import_outcomes(imported: DataFrame, current: DataFrame) -> DataFrame:
    """outcome and its number: unreadable, without content, already there, or imported."""
    known = current.select(F.col("id").alias("__k")).distinct()
    seen = imported.join(known, F.col("id") == F.col("__k"), "left")
    outcome = F.when(F.col("unreadable").isNotNull(), "unreadable").when(F.trim(F.coalesce("content", F.lit(""))) == "", "without content").when(F.col("__k").isNotNull(), "already there").otherwise("imported")
    return seen.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


# Foreign formats: where each target column comes from, first non-empty first; then author and importance rules.
FORMATS: dict[str, dict] = {
    "flat": {"content": ["memory", "content", "text"], "timestamp": ["created_at", "timestamp"], "channel_id": ["app_id", "channel"], "session_id": ["run_id", "session_id"], "author": [("user_id", "human"), ("agent_id", "agent")]},
    "blocks": {"content": ["value", "text", "content"], "timestamp": ["created_at"], "channel_id": ["agent_id"], "session_id": ["label", "session_id"], "author": [("user_id", "human"), ("agent_id", "agent")]},
    "graph": {"content": ["fact", "summary", "content"], "timestamp": ["valid_at", "created_at"], "channel_id": ["group_id"], "session_id": ["session_id"], "author": [("user_id", "human")]},
    "nodes": {"content": ["text", "description", "content"], "timestamp": ["created_at", "updated_at"], "channel_id": ["dataset"], "session_id": ["document_id"], "author": [("user_id", "human")]},
    "peers": {"content": ["content", "observation"], "timestamp": ["created_at"], "channel_id": ["workspace_id"], "session_id": ["session_id"], "author": [("peer_id", "human")]},
    "recollections": {"content": ["text", "summary"], "timestamp": ["occurred_at", "mentioned_at"], "channel_id": ["bank_id"], "session_id": ["document_id"], "author": [("agent_id", "agent")]},
    "notes": {"content": ["memory", "chunk", "content"], "timestamp": ["createdAt", "created_at"], "channel_id": ["containerTag"], "session_id": ["documentId"], "author": [("userId", "human")]},
}


def normalise(df: DataFrame, fmt: str) -> DataFrame:
    """A foreign frame as memory rows; rows without content are dropped, missing importance is 0.5, all other fields go to metadata."""
    rule = FORMATS[fmt]
    have = set(df.columns)

    def first(names: list[str]) -> Column:
        present = [F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in have]
        return F.coalesce(*present, F.lit(None).cast("string"))

    author, kind = F.lit(None).cast("string"), F.lit("human")
    for name, who in reversed(rule["author"]):
        if name in have:
            author = F.when(F.col(name).isNotNull(), F.concat_ws(":", F.lit(fmt), F.lit(name), F.col(name).cast("string"))).otherwise(author)
            kind = F.when(F.col(name).isNotNull(), who).otherwise(kind)
    used = set(rule["content"]) | set(rule["timestamp"])
    rest = [n for n in df.columns if n not in used]
    meta = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in rest]), F.array(*[F.col(n).cast("string") for n in rest])), lambda k, v: v.isNotNull()) if rest else F.lit(None).cast("map<string,string>")
    importance = F.coalesce(F.col("importance").try_cast("double"), F.lit(0.5)) if "importance" in have else F.lit(0.5)
    content = first(rule["content"])
    ident = first(["id", "uuid"])
    return df.select(
        F.coalesce(ident, F.substring(F.sha2(F.coalesce(content, F.lit("")), 256), 1, 16)).alias("id"), content.alias("content"), F.lit(f"{fmt}_import").alias("source"), first(rule["timestamp"]).alias("timestamp"),
        first(rule["session_id"]).alias("session_id"), importance.alias("importance"), meta.alias("metadata"), author.alias("author_id"), kind.alias("author_type"), first(rule["channel_id"]).alias("channel_id"),
    ).where("content is not null")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: count and order-free checksum of all rows, to verify a snapshot."""
    text = lambda c, kind: F.coalesce((F.unix_micros(c) if kind == "timestamp" else F.col(c)).cast("string"), F.lit("\x00"))
    row = F.md5(F.concat_ws("\x1f", *[text(c, kind) for c, kind in df.dtypes]))
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long")).alias("checksum"))


def snapshot(df: DataFrame, root: str, name: str) -> str:
    """Write a snapshot; names sort by age, so rotation can go by name."""
    path = f"{root}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return path


def verified(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Whether a snapshot holds the rows of ``df``."""
    return fingerprint(df).first() == fingerprint(spark.read.parquet(path).select(*df.columns)).first()


def bank_path(root: str, bank: str) -> str:
    """A bank is a path prefix; its name has letters, digits, - and _, at most 64."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", bank):
        raise ValueError(f"not a bank name: {bank!r}")
    return f"{root}/{bank}"


BANK_NAME = r"^[A-Za-z0-9_-]{1,64}$"


def banks(spark: SparkSession, root: str) -> DataFrame:
    """bank and n_rows of every bank under a folder."""
    return spark.read.parquet(root).groupBy(F.col("bank").cast("string").alias("bank")).agg(F.count("*").alias("n_rows"))


def write_banks(df: DataFrame, root: str) -> None:
    """Rows into the bank that their column ``bank`` names; rows of an unfit name are refused."""
    df.where(F.col("bank").rlike(BANK_NAME)).write.mode("append").partitionBy("bank").parquet(root)


def listed(spark: SparkSession, root: str) -> list[str]:
    """Names under a folder, by way of the session's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def removed(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def rotated(spark: SparkSession, root: str, keep: int = 10) -> list[str]:
    """Snapshots left after all but the last ``keep`` by name were removed."""
    names = listed(spark, root)
    for name in names[: max(0, len(names) - keep)]:
        removed(spark, f"{root}/{name}")
    return names[-keep:] if keep else []


def blobs(sanitised: DataFrame, raw: str, digest: str) -> DataFrame:
    """The sink of content by its hash: sha256, bytes, size, each once."""
    kept = sanitised.where(F.col(digest).isNotNull()).select(F.col(digest).alias("sha256"), F.col(raw).alias("bytes"))
    return kept.groupBy("sha256").agg(F.first("bytes").alias("bytes")).withColumn("size", F.octet_length("bytes"))


def resolve_blob(refs: DataFrame, store: DataFrame) -> DataFrame:
    """Refs (id, ref) to size and type of what they name in a blob store; an unknown ref has neither."""
    digest = F.regexp_extract("ref", "^blob://sha256/([0-9a-f]{64})$", 1)
    return refs.join(store, digest == F.col("sha256"), "left").select("id", "size", mime_of(F.col("bytes")).alias("mime"))


def resolve_file(spark: SparkSession, path: str) -> DataFrame:
    """path, size and type of files, from their first bytes."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.col("length").alias("size"), mime_of(F.col("content")).alias("mime"))


# By the scheme of a reference.
RESOLVERS = {"blob": resolve_blob, "file": resolve_file}
