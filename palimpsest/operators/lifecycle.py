"""Consolidation, ageing, trimming and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.instants import DAY_US
from palimpsest.functions.language import key_sentences
from palimpsest.functions.rules import compact
from palimpsest.operators.ordered import beyond_newest, running
from palimpsest.operators.relational import ordered_chunks


def sleep_groups(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per group: number of rows, first and last time, mean importance (of decimals, so that the order of adding does not matter) and an id of the group's members.

    The member id is an order-free sum of hashes, so a hot group needs no list.
    """
    member = F.sum(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long"))
    mean = F.sum(F.col("importance").cast("decimal(18,9)")).cast("double") / F.count("importance")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.when(F.count("importance") > 0, mean).alias("importance"), member.alias("member_hash"))


def degraded_tier(tier: Column, created_us: Column, ref_us: int) -> Column:
    """Tier 1 becomes 2 after 30 days, tier 2 becomes 3 after 180 days."""
    age = F.lit(ref_us) - created_us
    t = F.coalesce(tier, F.lit(1))
    return F.when((t == 1) & (age > 30 * DAY_US), 2).when((t == 2) & (age > 180 * DAY_US), 3).otherwise(t)


def degrade(rows: DataFrame, ref_us: int, first: int = 100, second: int = 50, size: int = 800) -> DataFrame:
    """id, tier and content of the rows that move down a tier: the oldest ``first`` of tier 1 and ``second`` of tier 2 that are due.

    Tier 2 keeps ``size`` characters, tier 3 the key sentences.
    """
    due = rows.withColumn("to", degraded_tier(F.col("tier"), F.unix_micros("created_at"), ref_us)).where(F.col("to") > F.coalesce("tier", F.lit(1)))
    oldest = lambda to, n: due.where(F.col("to") == to).orderBy("created_at", "id").limit(n)
    shorter = F.when(F.col("to") == 2, F.substring("content", 1, size)).otherwise(key_sentences(F.col("content")))
    return oldest(2, first).unionByName(oldest(3, second)).select("id", F.col("to").alias("tier"), shorter.alias("content"))


def trimmed(rows: DataFrame, session: str, at: str, keep: int, ref_us: int, ttl_us: int) -> DataFrame:
    """Ids to trim: beyond the newest ``keep`` of their session, or older than the time to live."""
    marked = beyond_newest(rows, [session], [at, "id"], keep)
    return marked.where(F.col("__old") | (F.unix_micros(at) < ref_us - ttl_us)).drop("__old")


def due(rows: DataFrame, episodic: DataFrame, before_us: int, held_from: float = 0.9) -> DataFrame:
    """Rows (id, importance, created_at, ...) to consolidate: made before a time, not held back by their importance, and in no summary (``summary_of``) yet."""
    covered = episodic.select(F.explode(F.split("summary_of", ",")).alias("__c")).where("__c != ''").distinct()
    old = rows.where((F.unix_micros("created_at") < before_us) & F.coalesce(F.col("importance") < held_from, F.lit(True)))
    return old.join(covered, F.col("id") == F.col("__c"), "left_anti")


def consolidation_counts(rows: DataFrame, episodic: DataFrame) -> DataFrame:
    """state (done or open) and its number of rows (id) by whether a summary covers them."""
    covered = episodic.select(F.explode(F.split("summary_of", ",")).alias("__c")).distinct()
    state = F.when(F.col("__c").isNull(), "open").otherwise("done")
    return rows.join(covered, F.col("id") == F.col("__c"), "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def summaries(rows: DataFrame, groups: list[str], at: str, key: str, text: str, size: int) -> DataFrame:
    """groups, chunk, n, summary, members: ``size`` rows a summary, in order of time, their texts joined in the compact encoding.

    No group is ordered by one task (``relational.ordered_chunks``).
    """
    grouped = rows.withColumn("__g", F.struct(*groups))
    chunks = ordered_chunks(grouped, "__g", at, key, size, [text])
    return chunks.select(*[F.col(f"__g.{g}").alias(g) for g in groups], "chunk", F.size("rows").cast("bigint").alias("n"), compact(F.array_join(F.transform("rows", lambda x: x[text]), " | ")).alias("summary"), F.array_join(F.transform("rows", lambda x: x[key]), ",").alias("members"))


def contaminated(rows: DataFrame, least: float, n: int) -> DataFrame:
    """Rows (id, veracity, importance) of labels other than stated, from an importance on, the most important first."""
    label = F.coalesce(F.lower(F.trim("veracity")), F.lit("unknown"))
    return rows.where((label != "stated") & (F.col("importance") >= least)).orderBy(F.desc("importance"), "id").limit(n)


def cleaned(scored: DataFrame, archive_from: float) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) rows by their noise score."""
    return scored.where(F.col("score") < archive_from), scored.where(F.col("score") >= archive_from)


def restored(kept: DataFrame, archived: DataFrame) -> DataFrame:
    """Archived rows back among the others."""
    return kept.unionByName(archived)


def unsummarised(working: DataFrame, episodic: DataFrame, consolidated: Column) -> DataFrame:
    """Rows claimed as consolidated that no summary covers."""
    covered = episodic.select(F.explode(F.split("summary_of", ",")).alias("__c")).where("__c != ''").distinct()
    return working.where(consolidated).join(covered, F.col("id") == F.col("__c"), "left_anti")


def health(runs: DataFrame, at: str, failed: Column, ref_us: int, stale_hours: float = 24.0) -> DataFrame:
    """One row: runs, errors, hours since the last success and a status."""
    last = F.max(F.when(~failed, F.unix_micros(at)))
    out = runs.agg(F.count("*").alias("n_runs"), F.count_if(failed).alias("n_errors"), last.alias("last_us"))
    hours = (F.lit(ref_us) - F.col("last_us")) / 3.6e9
    status = F.when(F.col("last_us").isNull(), "never").when(hours > stale_hours, "stale").when(F.col("n_errors") > 0, "degraded").otherwise("healthy")
    return out.select("n_runs", "n_errors", F.round(hours, 3).alias("hours_since_success"), status.alias("status"))


def context(rows: DataFrame, session: str, limit: int) -> DataFrame:
    """Rows for a prompt: the global ones first, then the session's, each by importance, then time."""
    scoped = rows.where((F.col("scope") == "global") | (F.col("session_id") == session)).withColumn("branch", F.when(F.col("scope") == "global", 0).otherwise(1))
    return scoped.orderBy("branch", F.desc("importance"), F.desc("created_at"), "id").limit(limit)


def sandwich(rows: DataFrame, query: str, score: str) -> DataFrame:
    """Position of each row by the bands above 0.7 (3 rows), 0.3 to 0.7 (5) and the closing rest (3)."""
    band = F.when(F.col(score) > 0.7, 0).when(F.col(score) >= 0.3, 1).otherwise(2)
    banded = rows.withColumn("band", band).withColumn("n", F.row_number().over(W.partitionBy(query, "band").orderBy(F.desc(score), "id")))
    kept = banded.where(F.col("n") <= F.when(F.col("band") == 1, 5).otherwise(3))
    return kept.withColumn("position", F.row_number().over(W.partitionBy(query).orderBy("band", "n"))).drop("n")


def within_budget(rows: DataFrame, query: str, order: str, size: Column, budget: int) -> DataFrame:
    """Rows in order (of a text) until the first that would overflow the budget."""
    return running(rows, [query], F.substring(order, 1, 3), [order], size, "used").where(F.col("used") <= budget)
