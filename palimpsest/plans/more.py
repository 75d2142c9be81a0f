"""Queries for voices, bonuses, ingest and fact maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions import vectors
from palimpsest.operators import graph, ingest, relational, retrieval, voices
from palimpsest.plans.reference import _BM25, _HAMMING, EM, REF_US, TR, US, WM, _bm25, _edges, _hamming, em, tr, wm
from palimpsest.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"select id, round(exp(-({REF_US} - {US}) / 8.64e10 / 7) * coalesce(importance, 0.5), 6) as score from {WM} where {US} between {REF_US} - {30 * 86_400_000_000} and {REF_US} order by round(exp(-({REF_US} - {US}) / 8.64e10 / 7) * coalesce(importance, 0.5), 9) desc, id limit 20")
def r28_recent_by_importance(spark, d):
    return voices.temporal_voice(wm(spark, d, "id", "created_at", "importance"), REF_US, days=30).select("id", F.round("score", 6).alias("score"))


@query(f"select id, confidence as score, row_number() over (order by round(confidence, 9) desc, id) as rank from {TR} where lower(regexp_replace(subject, '^[a-z]+:', '')) in ('demutino', 'hogozope', 'hakugibi') and confidence >= 0.5")
def r27_fact_voice(spark, d):
    return voices.fact_voice(tr(spark, d, "id", "subject", "confidence"), "What do Demutino, Hogozope and Hakugibi use?").select("id", "score", "rank")


@query()
def r26_graph_voice(spark, d):
    e = _edges(spark, d)
    seeds = e.where("src like 'agent:%'").select(F.col("src").alias("node")).distinct()
    reached = graph.reachable(e, seeds, 2, 0.9).select(F.lit("q").alias("query_id"), F.col("node").alias("id"), "hops")
    return voices.graph_voice(reached).withColumn("score", F.round("score", 9))


@query()
def r24_polyphonic(spark, d):
    text = _bm25(spark, d, 20).where("query_id = 'q1'").withColumn("query_id", F.lit("q"))
    recent = voices.temporal_voice(em(spark, d, "id", "created_at", "importance"), REF_US, days=365)
    return voices.polyphonic([text, recent], 20).withColumn("score", F.round("score", 9))


@query()
def r13_episodic_recall(spark, d):
    norm = _bm25(spark, d, 100).where("query_id = 'q1'").select("id", (F.col("score") / 20).alias("norm"))
    rows = em(spark, d, "id", "content", "importance", "tier", "created_at").where("content is not null").select("id", "content", "importance", "tier", F.unix_micros("created_at").alias("created_us")).join(norm, "id", "left").withColumn("sim", F.lit(0.0))
    scored = voices.linear_episodic(rows, "vector index on the office server", REF_US)
    return retrieval.ranked(scored.withColumn("query_id", F.lit("q")), 40).select("id", "score", "rank")


@query()
def k5_coverage(spark, d):
    hits = _bm25(spark, d).drop("rank").join(em(spark, d, "id", "content"), "id")
    return voices.coverage_rerank(hits, "vector index office server grocery list monday", 10)


@query(f"{_HAMMING} select query_id, id, round(0.08 * (1 - (exp(6 * distance / 64.0) - 1) / (exp(6 * distance / 64.0) + 1)), 9) as bonus from r where rank <= 10")
def r18_binary_bonus_hits(spark, d):
    return _hamming(spark, d, 10).select("query_id", "id", F.round(voices.binary_bonus(F.col("distance"), 64), 9).alias("bonus"))


@query(_BM25 + f""", h as (select distinct r.query_id, rank, r.id, content from r join {EM} e on e.id = r.id where rank <= 20 and content is not null),
w as (select *, list_distinct(list_filter(regexp_split_to_array(lower(trim(content)), '\\s+'), lambda x: x <> '')) as w from h)
select a.query_id, a.id, b.id as other, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 9) as jaccard from w a join w b on a.query_id = b.query_id and a.id < b.id""")
def f16_hits_jaccard(spark, d):
    hits = _bm25(spark, d, 20).join(em(spark, d).where("content is not null").select("id", "content").distinct(), "id")
    w = hits.select("query_id", "id", X.word_set(F.col("content")).alias("w"))
    o = w.select("query_id", F.col("id").alias("other"), F.col("w").alias("v"))
    return w.join(o, "query_id").where("id < other").select("query_id", "id", "other", F.round(X.jaccard(F.col("w"), F.col("v")), 9).alias("jaccard"))


@query(_BM25 + f""", h as (select r.query_id, any_value(content) as content, rank from r join {EM} e on e.id = r.id where rank <= 5 group by r.query_id, r.id, rank)
select query_id, string_agg('- ' || content, chr(10) order by rank) as context from h group by query_id""")
def r32_context_text(spark, d):
    hits = _bm25(spark, d, 5).join(em(spark, d).select("id", "content").distinct(), "id")
    return voices.formatted(hits, "query_id", "rank", "content")


@query()
def l1_l2_ingest(spark, d):
    e = ingest.enriched(wm(spark, d))
    return e.select("id", "trust_tier", "veracity", "memory_type", "event_date", "date_precision", "gist", "emotion", "time_scope", F.array_join("secret_labels", ",").alias("secrets")).distinct()


@query()
def x1_g14_annotations(spark, d):
    return ingest.annotations(ingest.enriched(em(spark, d).select("id", "content", "source", "veracity", "created_at")))


@query(f"select distinct subject, predicate, object, 'cf_' || left(sha256(strlen(subject)::varchar || ':' || subject || strlen(predicate)::varchar || ':' || predicate || strlen(object)::varchar || ':' || object), 24) as fact_id from {TR} where subject is not null and predicate is not null and object is not null")
def g26_fact_ids(spark, d):
    t = tr(spark, d).where("subject is not null and predicate is not null and object is not null").select("subject", "predicate", "object").distinct()
    return t.withColumn("fact_id", ingest.fact_id(F.col("subject"), F.col("predicate"), F.col("object")))


@query(f"select source, bool_or(author_type = 'human') as any_human, epoch_us(min(created_at)) as first_us from {WM} group by source")
def a14_any_and_earliest(spark, d):
    return wm(spark, d, "id", "source", "author_type", "created_at").groupBy("source").agg(F.bool_or(F.col("author_type") == "human").alias("any_human"), F.unix_micros(F.min("created_at")).alias("first_us"))


@query(f"select id, least({REF_US}, {US} + 86400000000) as bumped_us from {WM} where created_at is not null")
def w15_bump(spark, d):
    us = F.unix_micros("created_at")
    return wm(spark, d, "id", "created_at").where("created_at is not null").select("id", F.least(F.lit(REF_US), us + 86_400_000_000).alias("bumped_us"))


@query(f"select subject, predicate, object, confidence from {TR} where confidence >= 0.9")
def g25_confident_facts_all(spark, d):
    return tr(spark, d, "id", "subject", "predicate", "object", "confidence").where("confidence >= 0.9").select("subject", "predicate", "object", "confidence")


@query("select id, event_id from (select distinct id from working_memory) w join (select memory_id, max(event_id) as event_id from memory_events group by 1) e on e.memory_id = w.id")
def j10_acknowledged(spark, d):
    e = table(spark, d, "memory_events").groupBy(F.col("memory_id").alias("id")).agg(F.max("event_id").alias("event_id"))
    return wm(spark, d).select("id").distinct().join(e, "id")


@query("select id, max(content) as content from (select id, content from working_memory union all select id, content from memories union all select id, content from episodic_memory) group by id")
def x25_every_memory(spark, d):
    one = lambda n: table(spark, d, n).select("id", "content")
    return one("working_memory").unionByName(one("memories")).unionByName(one("episodic_memory")).groupBy("id").agg(F.max("content").alias("content"))


@query("select coalesce(a.id, b.id) as id, coalesce(a.source, b.source) as source from (select id, any_value(source) as source from working_memory group by id) a full join (select id, any_value(source) as source from episodic_memory group by id) b on a.id = b.id")
def x21_hydrated(spark, d):
    one = lambda n: table(spark, d, n).groupBy("id").agg(F.max("source").alias("source"))
    return relational.upsert(one("episodic_memory"), one("working_memory"), "id", ["source"]).select("id", "source")
