"""Whole recall over two tiers: text and vector candidates, gates, bonuses, boosts, trust, and a trace of every stage.

All of it works on candidates: at most ``text_n`` by text and ``vector_n`` by
vector per tier, so what is joined and scored is bounded by the asked k.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions import vectors as V
from palimpsest.functions.decay import TIER_WEIGHT, lookup, recency, temporal_boost, veracity_weight
from palimpsest.operators.retrieval import bm25, query_tokens, vector_topk, with_lexical
from palimpsest.operators.voices import binary_bonus, capped_boost, current_bonus, flag_bonus
from palimpsest.session import durable

WEIGHTS = (0.5, 0.3, 0.2)


def resolved_weights(vector: float | None, text: float | None, importance: float | None) -> tuple[float, float, float]:
    """Weights that add up to one: negative ones count as none; all zero, or none finite, are the defaults."""
    given = [d if w is None else w for w, d in zip((vector, text, importance), WEIGHTS)]
    if any(w != w or w in (float("inf"), float("-inf")) for w in given):
        return WEIGHTS
    given = [max(0.0, w) for w in given]
    total = sum(given)
    return tuple(w / total for w in given) if total > 0 else WEIGHTS  # type: ignore[return-value]


def query_entities(query: str) -> list[str]:
    """Capitalised words of a query, in lower case, without words of no meaning."""
    return sorted({n.lower() for n in re.findall(r"\b[A-Z][a-z]+\b", query)} - set(X.STOP_WORDS))


def candidates(rows: DataFrame, vectors: DataFrame, query: str, asked_vector: DataFrame, dim: int, text_n: int, vector_n: int) -> DataFrame:
    """id, norm (text score within the batch, 0 to 1), cos, d_rel (1 - distance over the batch's largest); either side may be missing."""
    batch = W.partitionBy()
    t = bm25(rows.select("id", "content"), {"q": query}, text_n).select("id", "score")
    low, high = F.min("score").over(batch), F.max("score").over(batch)
    # The best of a batch has 1; a batch of one too.
    t = t.select("id", (1 - (high - F.col("score")) / F.when(high > low, high - low).otherwise(1.0)).alias("norm"))
    v = vector_topk(vectors, asked_vector, vector_n, dim).select("id", F.col("score").alias("cos"))
    far = F.max(1 - F.col("cos")).over(batch)
    v = v.withColumn("d_rel", F.when(far == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (1 - F.col("cos")) / far)))
    # At most text_n + vector_n rows.
    return durable(t.join(v, "id", "full_outer"))


def working_scores(rows: DataFrame, found: DataFrame, query: str, ref_us: int, importance_weight: float = 0.2, temporal_weight: float = 0.0) -> DataFrame:
    """Scored working rows (id, content, importance, created_us, veracity) among the candidates: a row passes by its words alone, its vector only re-weights."""
    asked = query_tokens(query)
    n, iw = max(1, len(asked)), importance_weight
    # Repeated rows are dropped among the candidates, where they are few.
    hydrated = durable(with_lexical(rows.where("content is not null").join(F.broadcast(found), "id").distinct(), query, "lex", "matched"))
    gate = F.when((F.col("matched") >= 2) & F.lit(len(asked) >= 4), 1.0 / n).otherwise(X.minimum_relevance(len(asked)))
    by_text = F.col("norm").isNotNull()
    relevance = F.when(~by_text, F.col("lex")).when(F.col("lex") >= gate, F.greatest(F.col("lex"), 0.75 * F.col("lex") + 0.25 * F.col("norm"))).otherwise(0.0)
    kept = hydrated.withColumn("relevance", relevance).where(F.col("relevance") >= gate)
    rel, sim = F.col("relevance"), F.greatest(F.coalesce("cos", F.lit(0.0)), F.lit(0.0))
    base = rel * (1 - iw) * 0.6 + F.coalesce("importance", F.lit(0.5)) * iw + 0.08 * rel * rel
    base = F.when(sim > 0, 0.8 * base + 0.2 * sim).otherwise(base)
    rc = (1 - iw) * 0.4
    score = base * (rc + (1 - rc) * recency(F.col("created_us"), ref_us)) + current_bonus(query, X.tokens(F.col("content"))) + flag_bonus(query, F.col("content"))
    score = F.round(score * (1 + temporal_weight * temporal_boost(F.col("created_us"), ref_us)), 4)
    return kept.select("id", F.lit("working").alias("tier"), "content", (score * veracity_weight(F.col("veracity"))).alias("score"), "lex", "norm", sim.alias("sim"))


def mentions(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """id and name for every entity (name) that a row's words mention; by equality of words."""
    words = rows.where("content is not null").select("id", F.explode(F.array_distinct(X.tokens(F.col("content")))).alias("name"))
    return words.join(entities.select("name").distinct(), "name", "left_semi")


def knowledge_bonuses(rows: DataFrame, facts: DataFrame, query: str) -> DataFrame:
    """id, graph (0.02 per neighbour of the best connected entity mentioned, at most 0.08), fact (0.04 per fact of a mentioned entity that shares a word with the query, at most 0.10).

    ``facts`` has name, predicate, object.
    """
    asked = F.array(*[F.lit(t) for t in query_tokens(query)]).cast("array<string>")
    shares = F.arrays_overlap(X.expanded(X.tokens(F.col("object"))), asked)
    per_name = facts.where("name is not null and object is not null").groupBy("name").agg(F.count_distinct("object").alias("degree"), F.count_distinct(F.when(shares, F.struct("predicate", "object"))).alias("hits"))
    met = mentions(rows, per_name).join(per_name, "name")
    return met.groupBy("id").agg(F.least(F.max("degree") * 0.02, F.lit(0.08)).alias("graph"), F.least(F.sum("hits") * 0.04, F.lit(0.10)).alias("fact"))


def episodic_scores(rows: DataFrame, found: DataFrame, signs: DataFrame, facts: DataFrame, query: str, ref_us: int, dim: int, weights: tuple[float, float, float] = WEIGHTS, temporal_weight: float = 0.0) -> DataFrame:
    """Scored episodic rows (id, content, importance, created_us, tier, veracity) among the candidates.  ``signs`` has id and the sign distance to the query."""
    asked = query_tokens(query)
    vw, fw, iw = weights
    hydrated = rows.where("content is not null").withColumnRenamed("tier", "level").join(F.broadcast(found), "id").distinct()
    hydrated = durable(with_lexical(hydrated, query))
    sim, norm = F.coalesce("d_rel", F.lit(0.0)), F.coalesce("norm", F.lit(0.0))
    kept = hydrated.where((F.col("lex") >= X.minimum_relevance(len(asked))) | (sim >= 0.65))
    kept = kept.join(knowledge_bonuses(kept.select("id", "content"), facts, query), "id", "left").join(signs, "id", "left")
    base = sim * vw + norm * fw + F.coalesce("importance", F.lit(0.5)) * iw
    bonus = F.coalesce("graph", F.lit(0.0)) + F.coalesce("fact", F.lit(0.0)) + F.coalesce(binary_bonus(F.col("distance"), dim), F.lit(0.0))
    score = F.greatest(base, 0.8 * F.col("lex")) * (0.7 + 0.3 * recency(F.col("created_us"), ref_us)) + bonus + current_bonus(query, X.tokens(F.col("content"))) + flag_bonus(query, F.col("content"))
    score = F.round(score * (1 + temporal_weight * temporal_boost(F.col("created_us"), ref_us)), 4)
    score = score * lookup(TIER_WEIGHT, F.col("level"), 1.0) * veracity_weight(F.col("veracity"))
    return kept.select("id", F.lit("episodic").alias("tier"), "content", score.alias("score"), "lex", "norm", sim.alias("sim"))


def boosted(scored: DataFrame, names: list[str], facts: DataFrame) -> DataFrame:
    """Rows that mention an entity of the query times 1.3, then those that hold one of its facts' objects times 1.2, each capped at 1."""
    words = X.tokens(F.col("content"))
    wanted = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    own = facts.where(F.col("name").isin(names)).select(F.lower("object").alias("o")).distinct()
    held = scored.select("id", "tier", F.explode(F.array_distinct(words)).alias("o")).join(own, "o", "left_semi").select("id", "tier").distinct().withColumn("fact_hit", F.lit(True))
    s = scored.join(held, ["id", "tier"], "left").withColumn("score", capped_boost(F.col("score"), 1.3, F.arrays_overlap(words, wanted)))
    return s.withColumn("score", capped_boost(F.col("score"), 1.2, F.coalesce("fact_hit", F.lit(False)))).drop("fact_hit")


def injected_facts(facts: DataFrame, query: str, least: float = 0.35, n: int = 5) -> DataFrame:
    """Facts (id, name, predicate, object, confidence) as answers of their own: those whose words fit the query by ``least``, scored min(0.6, 0.6 relevance)."""
    text = F.concat_ws(" ", "name", "predicate", "object")
    told = facts.where("name is not null and object is not null").groupBy(text.alias("content")).agg(F.min("id").alias("id"))
    told = with_lexical(told, query).where(F.col("lex") >= least)
    best = told.orderBy(F.desc("lex"), "id").limit(n)
    null = F.lit(None).cast("double")
    return best.select(F.concat(F.lit("fact:"), F.col("id").cast("string")).alias("id"), F.lit("fact").alias("tier"), "content", F.least(F.lit(0.6), 0.6 * F.col("lex")).alias("score"), "lex", null.alias("norm"), null.alias("sim"))


def without_covered(results: DataFrame, covers: DataFrame) -> DataFrame:
    """Results (id, tier, score, lex) after summaries met the rows that they cover (``covers``: id, covered).

    A summary stays, and the rows it covers go, if it scores as high as each of
    them and none fits the query's words by 0.95; else the summary goes.
    """
    pairs = results.where("tier = 'episodic'").select("id", F.col("score").alias("own")).join(covers, "id")
    low = results.where("tier = 'working'").select(F.col("id").alias("covered"), F.col("score").alias("other"), F.col("lex").alias("kw"))
    met = pairs.join(low, "covered")
    won = met.groupBy("id").agg(((F.max("own") >= F.max("other")) & (F.max("kw") < 0.95)).alias("won"))
    gone = met.join(won, "id").select(F.when(F.col("won"), F.col("covered")).otherwise(F.col("id")).alias("id"), F.when(F.col("won"), "working").otherwise("episodic").alias("tier")).distinct()
    return results.join(gone, ["id", "tier"], "left_anti")


def top(results: DataFrame, k: int) -> DataFrame:
    """The k best with their rank; ties by tier, then id."""
    best = results.orderBy(F.desc(F.round("score", 9)), "tier", "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "tier", "id")))


def recalled(results: DataFrame, counts: DataFrame, at_us: int) -> DataFrame:
    """What a recall writes back: id, recall_count (one more than in ``counts``) and last_recalled_us."""
    return results.select("id").distinct().join(counts, "id", "left").select("id", (F.coalesce("recall_count", F.lit(0)) + 1).alias("recall_count"), F.lit(at_us).alias("last_recalled_us"))


def sign_distances(vectors: DataFrame, asked: list[float]) -> DataFrame:
    """id and the number of components whose sign differs from the query vector's."""
    q = F.array(*[F.lit(float(x)) for x in asked])
    return vectors.where(F.size("embedding") == len(asked)).select("id", V.hamming(F.col("embedding").cast("array<double>"), q).alias("distance"))
