"""Queries for whole recall and what surrounds it: traces, write-back, caches, vector tiers and voices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import language as L
from palimpsest.functions import text as X
from palimpsest.functions import vectors as V
from palimpsest.functions.decay import weibull
from palimpsest.operators import recall as R
from palimpsest.operators import relational, retrieval, voices
from palimpsest.plans.reference import _TOKENS, EM, REF_US, US, WM, em, tr, wm
from palimpsest.plans.words import _HEADS, _list, duck
from palimpsest.session import durable
from palimpsest.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    sql = duck(sql)

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


ASKED = "What does Kabebako block besides the vector index on the office server"
K, TEXT_N, VECTOR_N, DIM, ASKED_VECTOR = 10, 50, 30, 64, 7
TERMS = retrieval.query_tokens(ASKED)
NAMES = R.query_entities(ASKED)


# The frames: stored vectors are linked to episodic rows by number and to working rows by a hash of their id.


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _working_vectors(spark, d, *columns: str) -> DataFrame:
    rows = wm(spark, d, "id", *columns).where("id is not null").withColumn("vec_id", (F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("long") % 500))
    return rows.join(_vectors(spark, d), "vec_id").select("id", "embedding", *columns)


def _episodic_vectors(spark, d) -> DataFrame:
    return em(spark, d, "id", "row_id").join(_vectors(spark, d).withColumnRenamed("vec_id", "row_id"), "row_id").select("id", "embedding")


def _asked(spark, d) -> DataFrame:
    return _vectors(spark, d).where(F.col("vec_id") == ASKED_VECTOR).select(F.lit("asked").alias("id"), "embedding")


def _facts(spark, d) -> DataFrame:
    """What texts of working memory say blocks what."""
    said = F.explode(F.regexp_extract_all(F.col("content"), F.lit(r"[A-Z][a-z]+ blocks [A-Z][a-z]+"), 0))
    pairs = wm(spark, d).where("content is not null").select(said.alias("s")).select(F.lower(F.split("s", " ")[0]).alias("name"), F.lower(F.split("s", " ")[2]).alias("object")).distinct()
    return pairs.select(F.md5(F.concat_ws("|", "name", "object")).alias("id"), "name", F.lit("blocks").alias("predicate"), "object", F.lit(0.7).alias("confidence"))


def _rows(spark, d, name: str) -> DataFrame:
    columns = ["id", "content", "importance", "veracity", "created_at"] + (["tier"] if name == "episodic_memory" else [])
    t = table(spark, d, name).select(*columns)
    return t.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


def _scored(spark, d, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    asked, facts = _asked(spark, d), facts if facts is not None else _facts(spark, d)
    w, e = _rows(spark, d, "working_memory"), _rows(spark, d, "episodic_memory")
    ev = _episodic_vectors(spark, d)
    found_w = R.candidates(w, _working_vectors(spark, d), ASKED, asked, DIM, TEXT_N, VECTOR_N)
    found_e = R.candidates(e, ev, ASKED, asked, DIM, TEXT_N, VECTOR_N)
    one = asked.first()
    signs = R.sign_distances(ev.join(F.broadcast(found_e.select("id")), "id", "left_semi"), one.embedding if one else [0.0] * DIM)
    working = R.working_scores(w, found_w, ASKED, REF_US, temporal_weight=0.1)
    return working, R.episodic_scores(e, found_e, signs, facts, ASKED, REF_US, DIM, temporal_weight=0.1)


def _recalled(spark, d, k: int = K) -> DataFrame:
    """Both tiers boosted, summaries met with what they cover, facts injected, the k best."""
    # Read three times below.
    facts = durable(_facts(spark, d))
    working, episodic = _scored(spark, d, facts)
    both = durable(R.boosted(working.unionByName(episodic), NAMES, facts))
    covers = em(spark, d, "id", "summary_of").select("id", F.explode(F.split("summary_of", ",")).alias("covered"))
    return R.top(R.without_covered(both, covers).unionByName(R.injected_facts(facts, ASKED)), k)


# The same in SQL

_N = len(TERMS)
_NORM = "sqrt(list_sum(list_transform({0}, x -> x * x)))"
_VECS = "(select vec_id, embedding::double[] as v from embeddings where embedding is not null)"
_WV = f"(select w.id, v from (select distinct id, ('0x' || left(md5(id), 4))::bigint % 500 as vec_id from working_memory where id is not null) w join {_VECS} using (vec_id))"
_EV = f"(select e.id, v from (select distinct id, row_id from episodic_memory) e join {_VECS} x on x.vec_id = e.row_id)"
_QV = f"(select v as q from {_VECS} where vec_id = {ASKED_VECTOR})"
_EXP = r"list_distinct(list_concat(t, flatten(list_transform(t, y -> list_filter(regexp_split_to_array(y, '[_:/.-]+'), w -> length(w) >= 3 and not list_contains({0}, w) and not regexp_matches(w, '^\p{{N}}+$'))))))".format(_list(X.STOP_WORDS))


def lex_sql(terms: list[str], asked: str) -> str:
    """Relevance of a row with tokens x (expanded) and content."""
    part = []
    for t in terms:
        near = f"len(list_filter(x, c -> length(c) >= 4 and (contains(c, '{t}') or contains('{t}', c)))) > 0" if len(t) >= 4 else "false"
        like = f"len(list_intersect(x, {_list(X.SYNONYMS[t])})) > 0" if t in X.SYNONYMS else "false"
        part.append(f"case when list_contains(x, '{t}') then 1.0 when {like} then 0.75 when {near} then 0.4 else 0.0 end")
    return f"least(1.0, ({' + '.join(part)} + case when contains(lower(content), '{asked.lower()}') then 1.0 else 0.0 end)::double / {len(terms)})"


def bm25_sql(name: str, rows: str, n: int) -> str:
    return f"""{name}_t as (select id, {_TOKENS} as t from {rows}), {name}_s as (select count(*) as n, avg(len(t)) as avg from {name}_t), {name}_p as (select id, len(t) as dl, unnest(t) as term from {name}_t),
{name}_f as (select id, dl, term, count(*) as tf from {name}_p where list_contains({_list(TERMS)}, term) group by all), {name}_d as (select term, count(*) as df from {name}_f group by term),
{name}_c as (select id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg))) as score from {name}_f join {name}_d using (term), {name}_s group by id),
{name}_b as (select * from {name}_c order by round(score, 9) desc, id limit {n}),
{name}_n as (select id, 1 - (max(score) over () - score) / case when max(score) over () > min(score) over () then max(score) over () - min(score) over () else 1 end as norm from {name}_b)"""


def _found_sql(name: str, rows: str, vectors: str) -> str:
    return f"""{bm25_sql(name, rows, TEXT_N)}, {name}_v as (select id, round(list_dot_product(v, q) / ({_NORM.format('v')} * {_NORM.format('q')}), 9) as cos, q, v from {vectors}, {_QV}),
{name}_k as (select * from {name}_v order by cos desc, id limit {VECTOR_N}), {name}_r as (select *, case when max(1 - cos) over () = 0 then 1 else greatest(0, 1 - (1 - cos) / max(1 - cos) over ()) end as d_rel from {name}_k),
{name}_found as (select coalesce(a.id, b.id) as id, norm, cos, d_rel from {name}_n a full join {name}_r b on a.id = b.id)"""


_DECAY = "case when at is null then 0.5 else exp(-({ref} - at) / 3.6e9 / 168) end".format(ref=REF_US)
_BOOST = "(1 + 0.1 * case when at is null then 0 else exp(-greatest(0, ({ref} - at) / 3.6e9) / 24) end)".format(ref=REF_US)
_TRUSTW = "case coalesce(lower(trim(veracity)), '') when 'stated' then 1.0 when 'inferred' then 0.7 when 'imported' then 0.6 when 'tool' then 0.5 else 0.8 end"
_CUR = f"case when len(list_intersect(t, {_list(voices.CURRENT_WORDS)})) > 0 then 0.04 else 0 end" if set(ASKED.lower().split()) & set(voices.CURRENT_WORDS) else "0"
_FACTS = r"(select distinct md5(name || '|' || object) as id, name, 'blocks' as predicate, object from (select lower(string_split(s, ' ')[1]) as name, lower(string_split(s, ' ')[3]) as object from (select unnest(regexp_extract_all(content, '[A-Z][a-z]+ blocks [A-Z][a-z]+')) as s from working_memory where content is not null)))"
_GATE = X.minimum_relevance(_N)

_RECALL = f"""with {_found_sql('w', "(select distinct id, content from working_memory where content is not null)", _WV)}, {_found_sql('e', "(select distinct id, content from episodic_memory where content is not null)", _EV)},
facts as {_FACTS},
wr as (select id, content, any_value(importance) as importance, any_value(veracity) as veracity, any_value(epoch_us(created_at)) as at, {_TOKENS} as t from working_memory where content is not null group by id, content),
wx as (select *, {_EXP} as x from wr join w_found using (id)), wl as (select *, {lex_sql(TERMS, ASKED)} as lex, case when len(list_intersect(x, {_list(TERMS)})) >= 2 and {_N} >= 4 then 1.0 / {_N} else {_GATE} end as gate from wx),
wm1 as (select *, case when norm is null then lex when lex >= gate then greatest(lex, 0.75 * lex + 0.25 * norm) else 0 end as rel from wl), wm2 as (select *, greatest(0, coalesce(cos, 0)) as sim, rel * 0.8 * 0.6 + coalesce(importance, 0.5) * 0.2 + 0.08 * rel * rel as b0 from wm1 where rel >= gate),
wm3 as (select *, case when sim > 0 then 0.8 * b0 + 0.2 * sim else b0 end as base from wm2),
wscore as (select id, 'working' as tier, content, t, round((base * (0.32 + 0.68 * {_DECAY}) + {_CUR}) * {_BOOST}, 4) * {_TRUSTW} as score, lex, norm, sim from wm3),
er as (select id, content, any_value(importance) as importance, any_value(veracity) as veracity, any_value(tier) as level, any_value(epoch_us(created_at)) as at, {_TOKENS} as t from episodic_memory where content is not null group by id, content),
ex as (select *, {_EXP} as x from er join e_found using (id)), el as (select *, {lex_sql(TERMS, ASKED)} as lex, coalesce(d_rel, 0) as sim from ex), ek as (select * from el where lex >= {_GATE} or sim >= 0.65),
ft as (select *, {_TOKENS.replace('content', 'object')} as t from facts), fx as (select *, {_EXP} as x from ft), pn as (select name, count(distinct object) as degree, count(distinct case when len(list_intersect(x, {_list(TERMS)})) > 0 then object end) as hits from fx group by name),
bo as (select id, least(max(degree) * 0.02, 0.08) as graph, least(sum(hits) * 0.04, 0.10) as fact from (select distinct id, unnest(t) as name from ek) join pn using (name) group by id),
sg as (select id, list_sum(list_transform(list_zip(v, q), z -> case when (z[1] > 0) <> (z[2] > 0) then 1 else 0 end)) as h from e_v where id in (select id from e_found)),
eb as (select ek.*, coalesce(graph, 0) + coalesce(fact, 0) + coalesce(0.08 * (1 - (exp(6 * h / {DIM}.0) - 1) / (exp(6 * h / {DIM}.0) + 1)), 0) as bonus, sim * 0.5 + coalesce(norm, 0) * 0.3 + coalesce(importance, 0.5) * 0.2 as base from ek left join bo on bo.id = ek.id left join sg on sg.id = ek.id),
escore as (select id, 'episodic' as tier, content, t, round((greatest(base, 0.8 * lex) * (0.7 + 0.3 * {_DECAY}) + bonus + {_CUR}) * {_BOOST}, 4) * case level when 2 then 0.5 when 3 then 0.25 else 1.0 end * {_TRUSTW} as score, lex, norm, sim from eb),
both0 as (select * from wscore union all select * from escore), own as (select distinct object as o from facts where list_contains({_list(NAMES)}, name)),
both1 as (select *, case when len(list_intersect(t, {_list(NAMES)})) > 0 then least(score * 1.3, 1.0) else score end as s1, len(list_intersect(t, (select coalesce(list(o), []) from own))) > 0 as hit from both0), both2 as (select id, tier, content, case when hit then least(s1 * 1.2, 1.0) else s1 end as score, lex, norm, sim from both1),
cv as (select distinct id, unnest(string_split(summary_of, ',')) as covered from episodic_memory), met as (select e.id, w.id as covered, e.score as own, w.score as other, w.lex as kw from both2 e join cv on cv.id = e.id join both2 w on w.id = cv.covered and w.tier = 'working' where e.tier = 'episodic'),
won as (select id, max(own) >= max(other) and max(kw) < 0.95 as won from met group by id), gone as (select distinct case when won then covered else met.id end as id, case when won then 'working' else 'episodic' end as tier from met join won using (id)),
told as (select content, min(id) as id, {_TOKENS} as t from (select id, name || ' ' || predicate || ' ' || object as content from facts) group by content), tx as (select *, {_EXP} as x from told), tl as (select *, {lex_sql(TERMS, ASKED)} as lex from tx),
inj as (select 'fact:' || id as id, 'fact' as tier, content, least(0.6, 0.6 * lex) as score, lex, null::double as norm, null::double as sim from tl where lex >= 0.35 order by lex desc, id limit 5),
alls as (select * from both2 anti join gone using (id, tier) union all select * from inj), ranked as (select *, row_number() over (order by round(score, 9) desc, tier, id) as rank from alls)
"""
_SHOWN = "id, tier, round(score, 6) as score, round(lex, 6) as lex, round(norm, 6) as norm, round(sim, 6) as sim, rank"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "tier", *[F.round(c, 6).alias(c) for c in ("score", "lex", "norm", "sim")], F.col("rank").cast("bigint").alias("rank"))


@query(_RECALL + f"select {_SHOWN} from ranked where rank <= {K}")
def r13_r34_recall(spark, d):
    """One recall over text, vectors, graph and facts, with the columns that explain each score."""
    return _shown(_recalled(spark, d))


@query(_RECALL + f"select id, 1::bigint as recall_count, {REF_US}::bigint as last_recalled_us from ranked where rank <= {K}")
def r35_write_back(spark, d):
    counts = spark.createDataFrame([], "id string, recall_count bigint")
    return R.recalled(_recalled(spark, d), counts, REF_US).select("id", "recall_count", F.col("last_recalled_us").cast("bigint").alias("last_recalled_us"))


@query(_RECALL + """select 'working' as tier, (select count(*) from w_n)::bigint as n_text, (select count(*) from w_r)::bigint as n_vector, (select count(*) from w_found)::bigint as n_found, (select count(*) from wscore)::bigint as n_kept
union all select 'episodic', (select count(*) from e_n), (select count(*) from e_r), (select count(*) from e_found), (select count(*) from escore)""")
def r31_x16_trace(spark, d):
    """How many rows each stage of a recall found and kept, per tier."""
    asked = _asked(spark, d)
    out, scored = None, _scored(spark, d)
    for tier, name, vectors in (("working", "working_memory", _working_vectors(spark, d)), ("episodic", "episodic_memory", _episodic_vectors(spark, d))):
        rows = _rows(spark, d, name)
        found = R.candidates(rows, vectors, ASKED, asked, DIM, TEXT_N, VECTOR_N)
        kept = scored[tier == "episodic"].agg(F.count("*").alias("n_kept"))
        one = found.agg(F.count("norm").alias("n_text"), F.count("cos").alias("n_vector"), F.count("*").alias("n_found")).crossJoin(F.broadcast(kept)).select(F.lit(tier).alias("tier"), "n_text", "n_vector", "n_found", "n_kept")
        out = one if out is None else out.unionByName(one)
    return out


@query(_RECALL + f"select tier, count(*)::bigint as n from ranked where rank <= {K} group by tier")
def a22_hits_by_tier(spark, d):
    return _recalled(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query(_RECALL + f"select count(distinct term)::bigint as n_covered from (select unnest(x) as term from wl) where list_contains({_list(TERMS)}, term)")
def a20_token_coverage(spark, d):
    """How many words of the query any candidate of working memory has."""
    rows = _rows(spark, d, "working_memory")
    found = R.candidates(rows, _working_vectors(spark, d), ASKED, _asked(spark, d), DIM, TEXT_N, VECTOR_N)
    x = rows.where("content is not null").join(F.broadcast(found.select("id")), "id").select(F.explode(X.expanded(X.tokens(F.col("content")))).alias("term"))
    return x.where(F.col("term").isin(TERMS)).agg(F.count_distinct("term").alias("n_covered"))


_WB = f"case when at is null then 0.5 else exp(-greatest(0, ({REF_US} - at) / 3.6e9) / 168) end"


@query(_RECALL + f", p as (select * from ranked where rank <= {2 * K} and tier <> 'fact'), c as (select id, 'working' as tier, any_value(epoch_us(created_at)) as at from working_memory group by id union all select id, 'episodic', any_value(epoch_us(created_at)) from episodic_memory group by id) select id, tier, round(0.7 * score + 0.3 * {_WB}, 6) as score from p join c using (id, tier)")
def r20_blended(spark, d):
    """Enhanced recall before its re-ranking: twice as many rows, blended with their Weibull decay."""
    got = _recalled(spark, d, 2 * K).where("tier != 'fact'").select("id", "tier", "score")
    at = lambda name, tier: table(spark, d, name).groupBy("id").agg(F.min(F.unix_micros("created_at")).alias("at")).withColumn("tier", F.lit(tier))
    rows = at("working_memory", "working").unionByName(at("episodic_memory", "episodic"))
    return rows.join(F.broadcast(got), ["id", "tier"]).select("id", "tier", F.round(0.7 * F.col("score") + 0.3 * weibull(F.col("at"), REF_US, F.lit("general")), 6).alias("score"))


@query()
def r20_enhanced_recall(spark, d):
    """The blended rows re-ranked for relevance against redundance (greedy, so beyond plain SQL; tested against brute force)."""
    blended = r20_blended(spark, d)
    contents = _rows(spark, d, "working_memory").select("id", "content", F.lit("working").alias("tier")).unionByName(_rows(spark, d, "episodic_memory").select("id", "content", F.lit("episodic").alias("tier")))
    hits = contents.join(F.broadcast(blended), ["id", "tier"]).select(F.lit("q").alias("query_id"), "id", "score", "content")
    return retrieval.mmr(hits, K)


# Voices

_VOICES = f"""with {_found_sql('e', "(select distinct id, content from episodic_memory where content is not null)", _EV)}, facts as {_FACTS},
vv as (select id, row_number() over (order by round((cos + 1) / 2, 9) desc, id) as rank from e_r where true qualify rank <= 20),
h1 as (select distinct object as node from facts where list_contains({_list(NAMES)}, name) union select distinct name from facts where list_contains({_list(NAMES)}, object)),
h2 as (select distinct f.object as node from h1 join facts f on f.name = h1.node union select distinct f.name from h1 join facts f on f.object = h1.node),
hops as (select node, min(h) as h from (select node, 1 as h from h1 union all select node, 2 from h2) where not list_contains({_list(NAMES)}, node) group by node union all select unnest({_list(NAMES)}), 0),
er as (select id, {_TOKENS} as t from (select distinct id, content from episodic_memory where content is not null)), gv as (select id, row_number() over (order by round(sum(pow(0.4, h)), 9) desc, id) as rank from (select distinct id, unnest(t) as node from er) join hops using (node) group by id),
tv as (select id, row_number() over (order by round(exp(-({REF_US} - {US}) / 8.64e10 / 7) * coalesce(importance, 0.5), 9) desc, id) as rank from (select distinct id, created_at, importance from episodic_memory) where {US} between {REF_US} - {365 * 86_400_000_000} and {REF_US} qualify rank <= 20),
fv as (select 'fact:' || id as id, row_number() over (order by 'fact:' || id) as rank from facts where list_contains({_list(NAMES)}, name))"""


@query(_VOICES + " select id, round(sum(1.0 / (60 + rank)), 9) as score from (select * from vv union all select * from gv union all select * from tv union all select * from fv) group by id")
def r24_four_voices(spark, d):
    """Vector, graph, fact and temporal voice, fused by reciprocal ranks."""
    from palimpsest.operators import graph

    asked, facts = _asked(spark, d), _facts(spark, d)
    vector = voices.vector_voice(retrieval.vector_topk(_episodic_vectors(spark, d), asked, VECTOR_N, DIM).select(F.lit("q").alias("query_id"), "id", "score"), 20)
    seeds = spark.createDataFrame([(n,) for n in NAMES], "node string")
    reached = graph.reachable(facts.select(F.col("name").alias("src"), F.col("object").alias("dst"), F.lit(1.0).alias("weight")), seeds, 2).where(~F.col("node").isin(NAMES)).groupBy("node").agg(F.min("hops").alias("hops"))
    reached = reached.unionByName(seeds.withColumn("hops", F.lit(0))).withColumnRenamed("node", "name")
    met = R.mentions(_rows(spark, d, "episodic_memory"), reached).join(reached, "name")
    by_graph = voices.graph_voice(met.select(F.lit("q").alias("query_id"), "id", "hops"))
    recent = voices.temporal_voice(em(spark, d, "id", "created_at", "importance"), REF_US, days=365)
    told = retrieval.ranked(facts.where(F.col("name").isin(NAMES)).select(F.lit("q").alias("query_id"), F.concat(F.lit("fact:"), "id").alias("id"), F.lit(0.7).alias("score")))
    return retrieval.reciprocal_ranks([vector, by_graph, recent, told]).select("id", F.round("score", 9).alias("score"))


@query(f"with {_found_sql('e', '(select distinct id, content from episodic_memory where content is not null)', _EV)} select id, round((cos + 1) / 2, 6) as score, row_number() over (order by round((cos + 1) / 2, 9) desc, id)::int as rank from e_r qualify rank <= 20")
def r25_vector_voice(spark, d):
    hits = retrieval.vector_topk(_episodic_vectors(spark, d), _asked(spark, d), VECTOR_N, DIM).select(F.lit("q").alias("query_id"), "id", "score")
    return voices.vector_voice(hits, 20).select("id", F.round("score", 6).alias("score"), "rank")


@query(f"with facts as {_FACTS}, told as (select content, min(id) as id, {_TOKENS} as t from (select id, name || ' ' || predicate || ' ' || object as content from facts) group by content), x0 as (select *, {_EXP} as x from told), l as (select *, {lex_sql(TERMS, ASKED)} as lex from x0) select 'fact:' || id as id, round(least(0.6, 0.6 * lex), 6) as score from l where lex >= 0.1 order by lex desc, id limit 20")
def r19_injected_facts(spark, d):
    return R.injected_facts(_facts(spark, d), ASKED, 0.1, 20).select("id", F.round("score", 6).alias("score"))


_TOLD = f"(select lower(trim(subject)) || ' ' || predicate || ' ' || object as content, max(coalesce(confidence, 0.5)) as confidence, min(id) as id from triples where subject is not null and predicate is not null and object is not null group by 1)"


@query(f"""with t as (select *, {_TOKENS} as t from {_TOLD}), a as (select content, len(list_intersect(t, ['owns', 'status'])) / 2.0 * confidence as score from t where len(list_intersect(t, ['owns', 'status'])) > 0),
b as (select content, 0.85 * confidence as score from {_TOLD} where confidence >= 0.9 and (contains(content, 'owns') or contains(content, 'status'))),
u as (select content, max(score) as score from (select * from a union all select * from b) group by content)
select content, round(score, 6) as score from u order by round(score, 9) desc, content limit 30""")
def r29_fact_recall(spark, d):
    """Facts by the share of the query's words they have times confidence, with confident facts at 0.85 of theirs; one row a text."""
    wanted = ["owns", "status"]
    t = table(spark, d, "triples").where("subject is not null and predicate is not null and object is not null")
    told = t.groupBy(F.concat_ws(" ", F.lower(F.trim("subject")), "predicate", "object").alias("content")).agg(F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
    share = F.size(F.array_intersect(X.tokens(F.col("content")), F.array(*[F.lit(w) for w in wanted]))) / len(wanted)
    held = F.contains(F.col("content"), F.lit("owns")) | F.contains(F.col("content"), F.lit("status"))
    scored = told.withColumn("score", F.greatest(F.when(share > 0, share * F.col("confidence")), F.when((F.col("confidence") >= 0.9) & held, 0.85 * F.col("confidence"))))
    best = scored.where("score is not null").orderBy(F.desc(F.round("score", 9)), "content").limit(30)
    return best.select("content", F.round("score", 6).alias("score"))


# Vector tiers


@query(f"with v as (select id, v, source from {_WV} x join (select distinct id, source from working_memory) using (id) where source = 'insight') select id, round(greatest(0, list_dot_product(v, q) / ({_NORM.format('v')} * {_NORM.format('q')})), 6) as sim from v, {_QV} order by round(list_dot_product(v, q) / ({_NORM.format('v')} * {_NORM.format('q')}), 9) desc, id limit 10")
def r10_j3_filtered_vectors(spark, d):
    """Nearest rows among those that pass the filter: the filter comes before the similarity, so nothing is over-fetched."""
    rows = _working_vectors(spark, d, "source").where("source = 'insight'").select("id", "embedding")
    return retrieval.vector_topk(rows, _asked(spark, d), 10, DIM).select("id", F.round(F.greatest(F.lit(0.0), F.col("score")), 6).alias("sim"))


_I8 = "list_transform(embedding, x -> greatest(-127, least(127, round(x::double * 127)::int)))"


@query(f"with v as (select vec_id, {_I8} as b from embeddings), p as (select q.vec_id as query_id, v.vec_id as id, list_sum(list_transform(list_zip(q.b, v.b), z -> z[1] * z[2]))::bigint as dot from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0) select query_id, id, dot, row_number() over (partition by query_id order by dot desc, id)::int as rank from p qualify rank <= 10")
def r8_int8_topk(spark, d):
    """The nearest rows by the product of their bytes."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(V.int8(F.col("embedding").cast("array<double>")), lambda x: x.cast("double")).alias("embedding"))
    return retrieval.product_topk(v, v.where("id % 100 = 0"), 10, DIM).select("query_id", "id", F.col("score").cast("bigint").alias("dot"), "rank")


@query("select vec_id, len(embedding)::int as dim, list_sum(list_transform(embedding, x -> case when x > 0 then 1 else 0 end))::bigint as ones, round(sqrt(list_sum(list_transform(embedding::double[], x -> x * x))), 6) as magnitude from embeddings where vec_id % 10 <> 0")
def x20_x3_binary_store(spark, d):
    """A store of sign words and magnitudes after a tenth of its rows were deleted."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    stored = v.select("vec_id", F.size("e").alias("dim"), V.packed_signs(F.col("e")).alias("words"), V.norm(F.col("e")).alias("magnitude"))
    kept = relational.missing_from(stored, v.where("vec_id % 10 = 0"), "vec_id", "vec_id")
    return kept.select("vec_id", "dim", F.aggregate("words", F.lit(0), lambda s, w: s + F.bit_count(w)).cast("bigint").alias("ones"), F.round("magnitude", 6).alias("magnitude"))


@query(f"select (select count(*) from (select distinct id from working_memory))::bigint as n_rows, (select count(*) from {_WV})::bigint as n_vectors, (select count(*) from (select distinct row_id from episodic_memory) e where row_id not in (select vec_id from embeddings))::bigint as n_missing, (select count(*) from embeddings where vec_id not in (select row_id from episodic_memory))::bigint as n_orphans")
def l14_vector_coverage(spark, d):
    """Rows with and without vectors, and vectors without rows."""
    v = table(spark, d, "embeddings").select("vec_id")
    rows = em(spark, d, "row_id")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(wm(spark, d, "id"), "n_rows"), count(_working_vectors(spark, d), "n_vectors"), count(relational.missing_from(rows, v, "row_id", "vec_id"), "n_missing"), count(relational.missing_from(v, rows, "vec_id", "row_id"), "n_orphans")]
    out = parts[0]
    for p in parts[1:]:
        # One row each.
        out = out.crossJoin(F.broadcast(p))
    return out


@query("select e.id, v.vec_id from (select distinct id, row_id from episodic_memory) e join embeddings v on v.vec_id = e.row_id")
def j1_rows_with_vectors(spark, d):
    return em(spark, d, "id", "row_id").join(table(spark, d, "embeddings").select("vec_id"), F.col("row_id") == F.col("vec_id")).select("id", "vec_id")


# Caches

_KEY = f"array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(lower(trim({{0}}, ' ')), '\\s+'), w -> w <> '' and not list_contains({_list(L.QUESTION_STOPS)}, w)), w -> coalesce(map_extract(MAP {{{{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in _HEADS.items())}}}}}, w)[1], w)))), ' ')"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(trim({0}, ' ')), '\\s+'), w -> w <> ''))"


@query(f"""with c as (select id, content, epoch_us(created_at) as at, v from (select distinct id, content, created_at from working_memory where content is not null and created_at is not null) join {_WV} using (id)),
q as (select * from c order by at desc, id limit 1),
s as (select c.id, {_KEY.format('c.content')} = {_KEY.format('q.content')} as same, round(list_dot_product(c.v, q.v) / ({_NORM.format('c.v')} * {_NORM.format('q.v')}), 9) as cos, {_WORDS.format('c.content')} as w, {_WORDS.format('q.content')} as qw from c, q where c.at > q.at - {30 * 86_400_000_000} and c.at <= q.at),
t as (select id, case when same then 1 when cos >= 0.88 then 2 when cos >= 0.78 and len(list_intersect(w, qw)) / len(list_distinct(list_concat(w, qw))) >= 0.15 then 3 when len(list_intersect(w, qw)) >= 2 and len(list_intersect(w, qw)) >= 0.7 * len(qw) then 4 end::int as cache_tier from s)
select id, cache_tier from t where cache_tier is not null""")
def r33_cache_tiers(spark, d):
    """Cached questions that answer the latest one, by the first tier that fits: equal keys, near vectors, fairly near ones that share words, most words shared."""
    c = _working_vectors(spark, d, "content", "created_at").where("content is not null and created_at is not null").select("id", "content", F.unix_micros("created_at").alias("stored_us"), "embedding")
    latest = c.orderBy(F.desc("stored_us"), "id").limit(1)
    return voices.cache_tiers(c, latest, 30 * 86_400_000_000).select("id", "cache_tier")


@query(f"""with q as (select id, {_KEY.format('content')} as key, epoch_us(created_at) as at from (select distinct id, content, created_at from working_memory where content is not null and created_at is not null)),
h as (select *, lag(at) over (partition by key order by at, id) as before from q) select count(*)::bigint as n_asked, count(*) filter (before is not null and at - before <= {30 * 86_400_000_000})::bigint as n_hits, round(count(*) filter (before is not null and at - before <= {30 * 86_400_000_000}) / count(*)::double, 6) as hit_rate, (select count(*) from (select key, max(at) as at from q group by key order by at desc limit 1000))::bigint as n_kept from h""")
def x17_cache_stats(spark, d):
    """Were every text a question: how many had an answer not older than 30 days, and how many keys a cache of 1000 keeps."""
    q = wm(spark, d).where("content is not null and created_at is not null").select("id", L.question_key(F.col("content")).alias("key"), F.unix_micros("created_at").alias("at")).distinct()
    return voices.cache_statistics(q, 30 * 86_400_000_000, 1000)
