"""Retrieval voices, bonuses and re-rankers around the linear blend."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import language as L
from palimpsest.functions import text as X
from palimpsest.functions import vectors as V
from palimpsest.functions.decay import recency
from palimpsest.operators.retrieval import query_tokens, ranked, reciprocal_ranks, with_lexical

CURRENT_WORDS = ["current", "currently", "now", "latest", "live", "today"]  # Fixed values.


def vector_voice(hits: DataFrame, k: int = 20) -> DataFrame:
    """Cosine hits (query_id, id, score) as similarity (cos + 1) / 2, the best per id, top k."""
    best = hits.groupBy("query_id", "id").agg(((F.max("score") + 1) / 2).alias("score"))
    return ranked(best, k)


def fact_voice(facts: DataFrame, query: str, least: float = 0.5) -> DataFrame:
    """Facts whose subject is a capitalised word of the query, by confidence."""
    import re

    names = sorted({n.lower() for n in re.findall(r"\b[A-Z][a-z]+\b", query)})
    hit = F.lower(F.regexp_replace("subject", r"^[a-z]+:", "")).isin(names) & (F.col("confidence") >= least)
    return ranked(facts.where(hit).select(F.lit("q").alias("query_id"), "id", F.col("confidence").alias("score")))


def graph_voice(reached: DataFrame, per_hop: float = 0.4) -> DataFrame:
    """Nodes reached from the query's entities (query_id, id, hops): 0.4 to the power of hops, summed over paths' seeds."""
    return ranked(reached.groupBy("query_id", "id").agg(F.sum(F.pow(F.lit(per_hop), F.col("hops"))).alias("score")))


def temporal_voice(rows: DataFrame, ref_us: int, k: int = 20, days: int = 7) -> DataFrame:
    """Rows of the last days by exp(-age in days / 7) times importance."""
    us = F.unix_micros("created_at")
    recent = rows.where((us >= ref_us - days * 86_400_000_000) & (us <= ref_us))
    score = F.exp(-(F.lit(ref_us) - us) / 8.64e10 / 7) * F.coalesce("importance", F.lit(0.5))
    return ranked(recent.select(F.lit("q").alias("query_id"), "id", score.alias("score")), k)


def polyphonic(voices: list[DataFrame], k: int) -> DataFrame:
    """Unweighted reciprocal rank fusion of the voices, top k."""
    return ranked(reciprocal_ranks(voices), k)


def current_bonus(query: str, tokens: Column) -> Column:
    if not set(query.lower().split()) & set(CURRENT_WORDS):
        return F.lit(0.0)
    return F.when(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in CURRENT_WORDS])), 0.04).otherwise(0.0)


def flag_bonus(query: str, content: Column) -> Column:
    import re

    flags = re.findall(r"(?<![\w-])--?[a-z0-9][\w-]*", query.lower())
    return F.when(F.arrays_overlap(X.leading_hyphen_fragments(content), F.array(*[F.lit(f) for f in flags])), 0.3).otherwise(0.0) if flags else F.lit(0.0)


def fact_bonus(n_matches: Column) -> Column:
    return F.least(n_matches * 0.04, F.lit(0.10))


def binary_bonus(distance: Column, dim: int) -> Column:
    return 0.08 * (1 - F.tanh(3 * distance / F.lit(float(dim))))


def capped_boost(score: Column, factor: float, hit: Column) -> Column:
    """Multiply hits and cap them at 1, even where the score was above 1 before."""
    return F.when(hit, F.least(score * factor, F.lit(1.0))).otherwise(score)


def linear_episodic(rows: DataFrame, query: str, ref_us: int, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """The episodic blend over (id, content, importance, created_us, tier, sim, norm): weights sum to one, recency over 168 h, tier weight."""
    total = sum(weights)
    vw, fw, iw = (w / total for w in weights)
    asked = query_tokens(query)
    sim, norm = F.coalesce("sim", F.lit(0.0)), F.coalesce("norm", F.lit(0.0))
    kept = with_lexical(rows, query).where((F.col("lex") >= X.minimum_relevance(len(asked))) | (sim >= 0.65))
    base = sim * vw + norm * fw + F.coalesce("importance", F.lit(0.5)) * iw
    score = F.greatest(base, 0.8 * F.col("lex")) * (0.7 + 0.3 * recency(F.col("created_us"), ref_us))
    tier = F.when(F.col("tier") == 2, 0.5).when(F.col("tier") == 3, 0.25).otherwise(1.0)
    return kept.withColumn("score", F.round(score, 4) * tier)


def coverage_rerank(results: DataFrame, query: str, k: int, gain: float = 0.06) -> DataFrame:
    """Greedy order by score plus 0.06 per query token not yet covered, over all results.

    Of the results of a query that hold the same query tokens the better one always
    goes first, so the first k of each such set decide.
    """
    asked = sorted(set(query_tokens(query)))
    words = F.split(F.lower(F.coalesce("content", F.lit(""))), r"(?U)[\s\x1c-\x1f]+")
    held = results.withColumn("__hits", F.array_intersect(F.array(*[F.lit(t) for t in asked]).cast("array<string>"), words))
    best_first = W.partitionBy("query_id", "__hits").orderBy(F.desc(F.round("score", 9)), "id")
    top = ranked(held.withColumn("__n", F.row_number().over(best_first)).where(F.col("__n") <= k).drop("__n"))

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        hits = [set(h) for h in pdf["__hits"]]
        seen: set[str] = set()
        scores = pdf.score.round(9)
        left, order = list(range(len(pdf))), []
        while left and len(order) < k:
            best = max(left, key=lambda i: (scores[i] + gain * len(hits[i] - seen), -i))
            seen |= hits[best]
            order.append(best)
            left.remove(best)
        return pd.DataFrame({"query_id": pdf.query_id[order], "id": pdf.id[order], "position": range(1, len(order) + 1)})

    kinds = dict(results.dtypes)
    return top.groupBy("query_id").applyInPandas(rerank, f"query_id {kinds['query_id']}, id {kinds['id']}, position int")


def cached_answers(cache: DataFrame, query: str, at_us: int, ttl_us: int = 3_600_000_000) -> DataFrame:
    """Live cache rows (cached_query, stored_us, ...) that answer a query: equal after normalising (tier 1) or sharing 70 % of its words, two at least (tier 2)."""
    norm = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    words = X.word_set(F.lit(query))
    shared = F.size(F.array_intersect(X.word_set(F.col("cached_query")), words))
    tier = F.when(norm(F.col("cached_query")) == norm(F.lit(query)), 1).when((shared >= 2) & (shared >= 0.7 * F.size(words)), 2)
    return cache.where(F.col("stored_us") > at_us - ttl_us).withColumn("cache_tier", tier).where("cache_tier is not null")


def cache_tiers(cache: DataFrame, asked: DataFrame, ttl_us: int) -> DataFrame:
    """Cached questions (id, content, stored_us, embedding) not older than the time to live that answer one asked (of the same columns), each with its tier.

    1: equal keys; 2: cosine of 0.88; 3: cosine of 0.78 and a word overlap of
    0.15; 4: 70 % of the asked words, two at least.
    """
    q = asked.select(F.col("content").alias("q_content"), F.col("stored_us").alias("q_us"), F.col("embedding").alias("q_vector"))
    # One row.
    both = cache.join(F.broadcast(q), (F.col("stored_us") > F.col("q_us") - ttl_us) & (F.col("stored_us") <= F.col("q_us")))
    words, wanted = X.word_set(F.col("content")), X.word_set(F.col("q_content"))
    shared, cos = F.size(F.array_intersect(words, wanted)), F.round(V.cosine(F.col("embedding"), F.col("q_vector")), 9)
    tier = (
        F.when(L.question_key(F.col("content")) == L.question_key(F.col("q_content")), 1)
        .when(cos >= 0.88, 2)
        .when((cos >= 0.78) & (X.jaccard(words, wanted) >= 0.15), 3)
        .when((shared >= 2) & (shared >= 0.7 * F.size(wanted)), 4)
    )
    return both.withColumn("cache_tier", tier).where("cache_tier is not null")


def cache_statistics(asked: DataFrame, ttl_us: int, size: int) -> DataFrame:
    """n_asked, n_hits (the same key was asked within the time to live), hit_rate and n_kept (keys that a cache of ``size`` holds) of questions (id, key, at)."""
    before = F.lag("at").over(W.partitionBy("key").orderBy("at", "id"))
    hit = asked.withColumn("__b", before).agg(F.count("*").alias("n_asked"), F.count_if(F.col("at") - F.col("__b") <= ttl_us).alias("n_hits"), F.least(F.count_distinct("key"), F.lit(size)).cast("bigint").alias("n_kept"))
    return hit.select("n_asked", "n_hits", F.round(F.try_divide(F.col("n_hits"), F.col("n_asked")), 6).alias("hit_rate"), "n_kept")


def formatted(rows: DataFrame, query: str, position: str, content: str) -> DataFrame:
    """One text per query: '- content' lines in order.  Meant for the final few rows of a query."""
    items = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(content))))
    return rows.groupBy(query).agg(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x[content])), "\n").alias("context"))


def associated(results: DataFrame, links: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows linked to a query's results that are not among them."""
    near = results.select("query_id", F.col("id").alias("src")).join(links, "src").select("query_id", F.col("dst").alias("id"), "weight")
    new = near.join(results.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.max("weight").alias("score"))
    return new.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)
