"""Queries for embeddings of texts, similarity joins, clusters and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import conflicts as C
from palimpsest.plans.recall import query as _query
from palimpsest.plans.reference import _TOKENS
from palimpsest.plans.words import _list
from palimpsest.sources.tables import table

QUERIES: dict = {}
DIM = 64


def query(sql: str | None = None):
    add = _query(sql)

    def register(f):
        from palimpsest.plans import recall

        add(f)
        QUERIES[f.__name__] = recall.QUERIES.pop(f.__name__)
        return f

    return register


def _embedded(spark, d, name: str, *columns: str):
    t = table(spark, d, name).where("content is not null and id is not null").select("id", "content", *columns)
    return t.withColumn("embedding", C.hashed_embedding(DIM)(X.tokens(F.col("content"))))


_EMB = f"list_transform(range(0, {DIM}), i -> coalesce(list_sum(list_transform(list_filter(t, y -> ('0x' || left(md5(y), 4))::bigint % {DIM} = i), y -> case when ('0x' || md5(y)[5])::bigint % 2 = 0 then 1.0::double else -1.0::double end)), 0.0::double))"
_E = f"(select id, content, {_EMB} as v from (select id, content, {_TOKENS} as t from (select distinct id, content from episodic_memory where content is not null and id is not null)))"
_NORM = "sqrt(list_sum(list_transform({0}, x -> x * x)))"


@query(f"select id, round({_NORM.format('v')}, 6) as length, list_sum(list_transform(v, x -> case when x <> 0 then 1 else 0 end))::bigint as n_places from {_E}")
def s16_embeddings(spark, d):
    """Embeddings by the built-in embedder; another is another function of the tokens."""
    e = _embedded(spark, d, "episodic_memory")
    return e.select("id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"), F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("n_places")).distinct()


_CLS = f"(select v, min(id) as id from {_E} where len(list_filter(v, x -> x <> 0)) > 0 group by v)"
_COS = f"round(list_dot_product(a.v, b.v) / ({_NORM.format('a.v')} * {_NORM.format('b.v')}), 9)"
_LINKS = f"cls as {_CLS}, links as (select a.id as a, b.id as b, {_COS} as cosine from cls a join cls b on a.id < b.id where {_COS} >= 0.7)"


@query(f"with {_LINKS} select a, b, round(cosine, 6) as cosine from links")
def j14_similar_pairs(spark, d):
    """All pairs of different texts' vectors of cosine 0.7 and more; copies stand behind their first."""
    classes, _ = C.vector_classes(_embedded(spark, d, "episodic_memory").select("id", "embedding"))
    return C.similar_pairs(classes.select(F.col("class_id").alias("id"), "embedding"), 0.7, DIM).withColumn("cosine", F.round("cosine", 6))


@query(f"""with recursive {_LINKS}, w as (select a, b from links union all select b, a from links), r as (select id, id as node from cls union select r.id, w.b from r join w on w.a = r.node),
k as (select id, min(node) as cluster_id from r group by id), n as (select a, count(*) as n from w group by a)
select e.id, k.cluster_id, coalesce(n.n, 0)::bigint as n_links from {_E} e join cls on cls.v = e.v join k on k.id = cls.id left join n on n.a = cls.id""")
def g28_clusters(spark, d):
    """Every text's cluster and its number of links to other texts."""
    return C.clusters(_embedded(spark, d, "episodic_memory").select("id", "embedding"), 0.7, DIM)


@query(f"""with recursive {_LINKS}, w as (select a, b from links union all select b, a from links), r as (select id, id as node from cls union select r.id, w.b from r join w on w.a = r.node),
k as (select id, min(node) as cluster_id from r group by id), m as (select e.id, k.cluster_id, e.v, coalesce(s.importance, 0.5) as confidence from {_E} e join cls on cls.v = e.v join k on k.id = cls.id join (select id, max(importance) as importance from episodic_memory group by id) s on s.id = e.id),
x as (select cluster_id, i, avg(v) as c from (select cluster_id, unnest(v) as v, generate_subscripts(v, 1) as i from m) group by all), c as (select cluster_id, list(c order by i) as c from x group by cluster_id)
select cluster_id, count(*)::bigint as n_members, round(avg(list_dot_product(v, c) / ({_NORM.format('v')} * {_NORM.format('c')}) * confidence), 6) as score from m join c using (cluster_id) group by cluster_id""")
def g28_harmony(spark, d):
    """How well each cluster's texts stand for its centre, weighed by their importance."""
    rows = _embedded(spark, d, "episodic_memory", "importance").groupBy("id").agg(F.first("embedding").alias("embedding"), F.coalesce(F.max("importance"), F.lit(0.5)).alias("confidence"))
    rows = rows.join(C.clusters(rows.select("id", "embedding"), 0.7, DIM).select("id", "cluster_id"), "id")
    return C.harmony(rows, rows).select("cluster_id", "n_members", F.round("score", 6).alias("score"))


_SIG = f"list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z]{{3,}}'), w -> not list_contains({_list(C.SHARED_STOPS)}, w)))"
_W = f"(select id, source, at, content, {_EMB} as v, {_SIG} as words from (select id, source, at, content, {_TOKENS} as t from (select distinct id, source, epoch_us(created_at) as at, content from working_memory where content is not null and id is not null and created_at is not null)))"


@query(f"""with k as (select source, v, arg_min(id, id) as id, arg_min(at, id) as at, arg_min(words, id) as words from {_W} where len(list_filter(v, x -> x <> 0)) > 0 group by source, v)
select case when a.at < b.at then a.id else b.id end as older, case when a.at < b.at then b.id else a.id end as newer, round({_COS}, 6) as cosine from k a join k b on a.id < b.id and a.source is not distinct from b.source
where a.v <> b.v and {_COS} > 0.88 and abs(a.at - b.at) >= 3600000000 and len(list_intersect(a.words, b.words)) >= 2""")
def j13_near_conflicts(spark, d):
    """Rows of one source that say nearly the same at different times."""
    rows = _embedded(spark, d, "working_memory", "source", "created_at").withColumn("at_us", F.unix_micros("created_at"))
    return C.near_conflicts(rows, "source", DIM).withColumn("cosine", F.round("cosine", 6))


@query()
def l8_conflicts(spark, d):
    """The near conflicts that are no near copies by the edit ratio (for which SQL has no function)."""
    rows = _embedded(spark, d, "working_memory", "source", "created_at").withColumn("at_us", F.unix_micros("created_at"))
    return C.conflicts(rows, "source", DIM).withColumn("cosine", F.round("cosine", 6))
