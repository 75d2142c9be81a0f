"""Facts merged by trust, conflicts between them, votes over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.decay import VERACITY_WEIGHT, veracity_weight


def consolidate(mentions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Confidence per fact: 0.5 w of the first mention, each later one adds (1 - c) * w * 0.3.

    The closed form 1 - (1 - 0.5 w1) * prod(1 - 0.3 wi) needs only the first mention, so no ordered fold.
    """
    w = veracity_weight(F.col("veracity"))
    marked = mentions.withColumn("__w", w)
    first = F.min(F.struct(*order, F.col("__w").alias("w")))["w"]
    logs = F.sum(F.log(1 - 0.3 * F.col("__w")))
    agg = marked.groupBy(*keys).agg(F.count("*").alias("mention_count"), first.alias("w1"), logs.alias("logs"))
    confidence = 1 - (1 - 0.5 * F.col("w1")) * F.exp(F.col("logs") - F.log(1 - 0.3 * F.col("w1")))
    return agg.select(*keys, "mention_count", confidence.alias("confidence"))


def contradictions(facts: DataFrame, subject: str, predicate: str, obj: str, confidence: str) -> DataFrame:
    """Per (subject, predicate) with several objects: the best one and how many rivals it has; no pairs are spelled out."""
    best = F.max(F.struct(F.col(confidence), F.col(obj)))
    agg = facts.groupBy(subject, predicate).agg(best.alias("b"), F.count_distinct(obj).alias("n"))
    return agg.where("n > 1").select(subject, predicate, F.col(f"b.{obj}").alias("winner"), F.col(f"b.{confidence}").alias("winner_confidence"), (F.col("n") - 1).alias("n_rivals"))


def statistics(facts: DataFrame, subject: str, confidence: str, confident: float = 0.8) -> DataFrame:
    """One row: facts, subjects, mean confidence and confident facts."""
    return facts.agg(F.count("*").alias("n_facts"), F.count_distinct(subject).alias("n_subjects"), F.round(F.avg(confidence), 6).alias("mean_confidence"), F.count_if(F.col(confidence) >= confident).alias("n_confident"))


def superseded_facts(facts: DataFrame, subject: str, predicate: str, obj: str, least_mentions: int = 3) -> DataFrame:
    """Facts with a rival of the same subject and predicate that has enough mentions and more confidence."""
    w = W.partitionBy(subject, predicate)
    strong = F.max(F.when(F.col("mention_count") >= least_mentions, F.col("confidence"))).over(w)
    return facts.withColumn("strongest", strong).where(F.col("confidence") < F.col("strongest")).select(subject, predicate, obj, "confidence", "strongest")


def majority_label(rows: DataFrame, key: str, label: str) -> DataFrame:
    """The most frequent label; known before unknown, then of equals the less trusted."""
    counts = rows.groupBy(key, F.coalesce(F.when(F.col(label).isin(list(VERACITY_WEIGHT)), F.col(label)), F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))
    order = [(F.col("label") == "unknown").asc(), F.desc("n"), F.when(F.col("label").isNotNull(), veracity_weight(F.col("label"))).asc(), F.col("label")]
    return counts.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").select(key, "label", "n")
