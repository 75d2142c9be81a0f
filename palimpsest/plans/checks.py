"""Oracle SQL for queries registered elsewhere without one, and the whole jobs beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dates, media
from palimpsest.functions import text as X
from palimpsest.operators import ingest, lifecycle, patterns
from palimpsest.plans import more, recall, reference, texts
from palimpsest.plans.recall import _EXP, lex_sql
from palimpsest.plans.reference import _BM25, _BOTH, _TOKENS, EM, REF_US, US, WM, em, wm
from palimpsest.plans.texts import _q, _type_sql
from palimpsest.plans.words import E, W, _list, duck
from palimpsest.operators.retrieval import query_tokens
from palimpsest.sources.tables import table

QUERIES: dict = {}


def query(sql: str | None = None):
    sql = duck(sql)

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def check(f, sql: str) -> None:
    """The oracle of a query that is registered elsewhere."""
    QUERIES[f.__name__] = (f, duck(sql))


# Patterns of plain letters meet no accented one; SQL's word borders do not know these, so they are letters of another kind there.
_FOLD = "regexp_replace({0}, '[À-ÖØ-öø-ɏ]', '_', 'g')"
_EF, _WF = f"(select id, {_FOLD.format('content')} as content from {E})", f"(select id, {_FOLD.format('content')} as content from {W})"

# Dates

_MONTHS, _DAYS = dates._MONTHS, dates._DAYS
_NAMES = "|".join(dates.DAY_NAMES)
_CAST = "try_cast(lpad({0}, 4, '0') || '-' || lpad({1}, 2, '0') || '-' || lpad({2}, 2, '0') as date)"
_NO = lambda x, words: f"list_position({_list([w[:3] for w in words])}, left({x}, 3))"
_BACK = "(ref - (((today - {0}) % 7 + 7) % 7)::int)"
_WEEKDAY = f"""case when rel.w = 'this' then {_BACK.format('rd')} when rel.w = 'last' then ref - (case when (today - rd) % 7 = 0 then 7 else ((today - rd) % 7 + 7) % 7 end)::int
when rel.w = 'next' then ref + (case when (rd - today) % 7 = 0 then 7 else ((rd - today) % 7 + 7) % 7 end)::int when bare <> '' then {_BACK.format(f"({_NO('bare', dates.DAY_NAMES)} - 1)")} end"""


def named_sql(rows: str) -> str:
    """SQL for rows (id, low, ref): id, event_date, precision."""
    return rf"""select id, coalesce(days, uday) as event_date, case when days is not null then 'day' when unit.u <> '' then unit.u end as precision from (
select *, coalesce({_CAST.format('iso.y', 'iso.m', 'iso.d')}, case when slash.y = '' then null when try_cast(slash.a as int) > 12 then {_CAST.format('yy', 'slash.b', 'slash.a')} else {_CAST.format('yy', 'slash.a', 'slash.b')} end,
case when mon.m <> '' then {_CAST.format("case when mon.y = '' then year(ref)::varchar else mon.y end", f"({_NO('mon.m', dates.MONTH_NAMES)})::varchar", 'mon.d')} end,
case when regexp_matches(low, '\btoday\b') then ref end, case when regexp_matches(low, '\byesterday\b') then ref - 1 end, case when regexp_matches(low, '\btomorrow\b') then ref + 1 end, {_WEEKDAY}) as days,
case when unit.q = 'this' then ref when unit.u = 'week' then ref + (7 * sign)::int when unit.u = 'month' then (date_trunc('month', ref) + to_months(sign))::date when unit.u = 'year' then (date_trunc('year', ref) + to_months(12 * sign))::date end as uday from (
select *, {_NO('rel.d', dates.DAY_NAMES)} - 1 as rd, isodow(ref) - 1 as today, case when try_cast(slash.y as int) < 100 then (try_cast(slash.y as int) + 2000)::varchar else slash.y end as yy, case when unit.q = 'last' then -1 else 1 end as sign from (
select id, low, ref, regexp_extract(low, '\b(\d{{4}})-(\d{{2}})-(\d{{2}})\b', ['y', 'm', 'd']) as iso, regexp_extract(low, '\b(\d{{1,2}})/(\d{{1,2}})/(\d{{2,4}})\b', ['a', 'b', 'y']) as slash,
regexp_extract(low, '\b({_MONTHS})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?\b', ['m', 'd', 'y']) as mon, regexp_extract(low, '\b(last|this|next)\s+({_DAYS})\b', ['w', 'd']) as rel,
regexp_extract(low, '\b({_NAMES})\b', 1) as bare, regexp_extract(low, '\b(this|last|next)\s+(week|month|year)\b', ['q', 'u']) as unit from {rows})))"""


_LOW = "(select distinct id, regexp_replace(lower(trim(content, ' ')), '[À-ÖØ-öø-ɏ]', '_', 'g') as low, created_at::date as ref from {0} where content is not null and created_at is not null)"
check(texts.f11_named_dates, f"select * from ({named_sql(_LOW.format('working_memory'))}) where event_date is not null")


@query(rf"select id, day from (select id, {_WEEKDAY} as day from (select *, {_NO('rel.d', dates.DAY_NAMES)} - 1 as rd, isodow(ref) - 1 as today from (select id, ref, regexp_extract(low, '\b(last|this|next)\s+({_DAYS})\b', ['w', 'd']) as rel, regexp_extract(low, '\b({_NAMES})\b', 1) as bare from {_LOW.format('working_memory')}))) where day is not null")
def f12_weekdays(spark, d):
    """The dates of the weekdays that notes name."""
    w = wm(spark, d).where("content is not null and created_at is not null")
    return w.select("id", dates.weekday_date(F.col("content"), F.to_date("created_at")).alias("day")).where("day is not null").distinct()


# Entities, participants, statements


def entity_sql(rows: str) -> str:
    found = ", ".join(f"regexp_extract_all(content, {_q(p)}, {g})" for p, g in X.ENTITY_PATTERNS)
    kept = f"list_distinct(list_filter(list_transform(flatten([{found}]), x -> trim(x, ' ')), x -> length(x) >= 2 and not list_contains({_list(X.STOP_WORDS)}, lower(x))))"
    return f"select distinct id, unnest(list_filter(kept, x -> len(list_filter(kept, y -> length(y) > length(x) and contains(y, x))) = 0)) as entity from (select id, {kept} as kept from {rows})"


check(texts.f19_x1_entities, entity_sql(_EF))
check(texts.g16_participants, rf"select id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(content, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b', 1), regexp_extract_all(content, '(?i)\b(I|you|we|they|he|she|it|me|us|them|him|her)\b', 1))))[:5], ',') as participants from {_EF}")


def _statement_sql() -> str:
    one = lambda n, v: f"list_transform(regexp_extract_all(content, '\\b[A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+)* {v} (?:a |an |the )?[a-zA-Z0-9]+'), x -> {{'subject': regexp_extract(x, '^(.+?) {v} ', 1), 'predicate': '{n}', 'object': regexp_extract(x, ' {v} (?:a |an |the )?([a-zA-Z0-9]+)$', 1)}})"
    every = ", ".join(one(n, v) for n, v in patterns.VERBS)
    good = f"length(x.subject) > 2 and length(x.object) > 2 and not list_contains({_list(patterns.NO_SUBJECTS)}, lower(string_split(x.subject, ' ')[1]))"
    return f"select distinct id, s.subject as subject, s.predicate as predicate, s.object as object from (select id, unnest(list_filter(flatten([{every}]), x -> {good})[:5]) as s from {_EF})"


check(texts.g17_statements, _statement_sql())


@query(rf"select id, nullif(regexp_extract(lower(content), '\b(office|home|work|school|hospital|store|restaurant|building|room)\b', 1), '') as location from {_EF}")
def g16_locations(spark, d):
    """The first place that a text names by its kind."""
    return em(spark, d).where("content is not null").select("id", patterns.location(F.col("content")).alias("location")).distinct()


# Scores and voices


def _lexed(terms, asked: str, rows: str) -> str:
    return f"(select *, {lex_sql(terms, asked)} as lex from (select *, {_EXP} as x from (select *, {_TOKENS} as t from {rows})))"


_R4 = "shared calendar of the office server"
check(texts.r4_lexical, f"select id, round(lex, 6) as relevance from {_lexed(query_tokens(_R4), _R4, E)} where round(lex, 6) > 0")

_R13 = "shared grocery list on the kitchen tablet"
_N13 = len(query_tokens(_R13))
_TRUSTS = "case coalesce(lower(trim(veracity)), '') when 'stated' then 1.0 when 'inferred' then 0.7 when 'imported' then 0.6 when 'tool' then 0.5 else 0.8 end"
_AGE = f"case when created_us is null then 0.5 else exp(-({REF_US} - created_us) / 3.6e9 / 168) end"
check(
    reference.r13_linear_recall,
    f"""with l as {_lexed(query_tokens(_R13), _R13, "(select distinct id, content, importance, veracity, epoch_us(created_at) as created_us from working_memory where content is not null)")},
s as (select id, round((lex * 0.8 * 0.6 + coalesce(importance, 0.5) * 0.2 + 0.08 * lex * lex) * (0.32 + 0.68 * {_AGE}) * (1 + 0.2 * case when created_us is null then 0 else exp(-greatest(0, ({REF_US} - created_us) / 3.6e9) / 24) end), 4) * {_TRUSTS} as score from l where lex >= {X.minimum_relevance(_N13)})
select 'q' as query_id, id, score, row_number() over (order by round(score, 9) desc, id)::int as rank from s qualify rank <= 40""",
)
_E13 = "vector index on the office server"
check(
    more.r13_episodic_recall,
    _BM25
    + f""", hits as (select id, score / 20 as norm from r where query_id = 'q1' and rank <= 100), l as {_lexed(query_tokens(_E13), _E13, "(select distinct id, content, importance, tier, epoch_us(created_at) as created_us from episodic_memory where content is not null)")},
scored as (select l.id, round(greatest(coalesce(norm, 0) * 0.3 + coalesce(importance, 0.5) * 0.2, 0.8 * lex) * (0.7 + 0.3 * {_AGE}), 4) * case tier when 2 then 0.5 when 3 then 0.25 else 1.0 end as score from l left join hits using (id) where lex >= {X.minimum_relevance(len(query_tokens(_E13)))})
select id, score, row_number() over (order by round(score, 9) desc, id)::int as rank from scored qualify rank <= 40""",
)
check(
    more.r24_polyphonic,
    _BM25
    + f""", recent as (select id, row_number() over (order by round(exp(-({REF_US} - {US}) / 8.64e10 / 7) * coalesce(importance, 0.5), 9) desc, id) as rank from {EM} where {US} between {REF_US} - {365 * 86_400_000_000} and {REF_US} qualify rank <= 20),
f as (select id, sum(1.0 / (60 + rank)) as score from (select id, rank from r where query_id = 'q1' and rank <= 20 union all select id, rank from recent) group by id)
select 'q' as query_id, id, round(score, 9) as score, row_number() over (order by round(score, 9) desc, id)::int as rank from f qualify rank <= 20""",
)
check(
    more.r26_graph_voice,
    f"""with s as (select distinct lower(trim(subject)) as seed from triples where lower(trim(subject)) like 'agent:%' and object is not null), h1 as (select distinct seed, dst as node from s join {_BOTH} b on b.src = seed),
h2 as (select distinct seed, b.dst as node from h1 join {_BOTH} b on b.src = h1.node where b.dst <> seed), m as (select seed, node, min(hops) as hops from (select seed, node, 1 as hops from h1 union all select seed, node, 2 from h2) where node <> seed group by all),
g as (select node as id, sum(pow(0.4, hops)) as score from m group by node) select 'q' as query_id, id, round(score, 9) as score, row_number() over (order by round(score, 9) desc, id)::int as rank from g""",
)

# Greedy re-rankings: a step of the recursion chooses one row of each query

_SPACE = r"[\s\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SET = f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '{_SPACE}'), x -> x <> ''))"
_HITS = f"""h as (select query_id, r.id, round(score, 9) as score, row_number() over (partition by query_id order by round(score, 9) desc, r.id) as n, {_SET} as w from r join (select distinct id, content from episodic_memory where content is not null) e on e.id = r.id{{0}})"""
_LIKE = "len(list_intersect({0}, {1})) / greatest(1, len(list_distinct(list_concat({0}, {1}))))::double"
_OUT = "select query_id, unnest(ids) as id, generate_subscripts(ids, 1)::int as position from (select query_id, arg_max(ids, len(ids)) as ids from st group by query_id)"


def _greedy(hits: str, value: str, grows: str, k: int = 10, rows: str | None = None) -> str:
    """Each step takes the row of the greatest value among those not taken; ``grows`` is what it adds to the state ``sets``.  ``rows`` is SQL with the rows h, in place of text hits."""
    best = f"list_max(list_transform(list_filter(c, y -> not list_contains(ids, y.id)), y -> {{'v': {value}, 'n': -y.n, 'id': y.id, 'w': y.w}}))"
    return (
        (rows or _BM25.replace("with t as", "with recursive t as", 1) + ", " + _HITS.replace("{0}", hits))
        + f", q as (select query_id, list({{'id': id, 'n': n, 'score': score, 'w': w}} order by n) as c from h group by query_id), "
        + f"st as (select query_id, c, []::varchar[] as ids, {grows.format('null')} as sets from q union all select query_id, c, list_append(ids, b.id), {grows.format('b')} from (select *, {best} as b from st where len(ids) < least({k}, len(c)))) "
        + _OUT
    )


def _mmr(hits: str, rows: str | None = None) -> str:
    value = f"round(0.7 * y.score - 0.3 * coalesce(list_max(list_transform(sets, z -> {_LIKE.format('y.w', 'z')})), 0), 12)"
    sql = _greedy(hits, value, "case when {0} is null then []::varchar[][] else list_append(sets, {0}.w) end", rows=rows)
    return sql.replace("case when null is null then []::varchar[][] else list_append(sets, null.w) end", "[]::varchar[][]").replace("case when b is null then []::varchar[][] else list_append(sets, b.w) end", "list_append(sets, b.w)")


check(reference.k6_mmr, _mmr(" where rank <= 20"))
check(
    recall.r20_enhanced_recall,
    _mmr(
        "",
        recall._RECALL.replace("with ", "with recursive ", 1)
        + f""", p20 as (select id, tier, score from ranked where rank <= {2 * recall.K} and tier <> 'fact'),
c20 as (select id, 'working' as tier, any_value(epoch_us(created_at)) as at, any_value(content) as content from working_memory group by id union all select id, 'episodic', any_value(epoch_us(created_at)), any_value(content) from episodic_memory group by id),
b20 as (select id, content, round(0.7 * score + 0.3 * {recall._WB}, 6) as score from p20 join c20 using (id, tier)), h as (select 'q' as query_id, id, score, row_number() over (order by round(score, 9) desc, id) as n, {_SET} as w from b20)""",
    ),
)
_K5 = query_tokens("vector index office server grocery list monday")
check(
    more.k5_coverage,
    _greedy("", f"round(y.score + 0.06 * len(list_filter(list_intersect(y.w, {_list(_K5)}), z -> not list_contains(sets, z))), 12)", "{0}").replace("null as sets", "[]::varchar[] as sets").replace("list_append(ids, b.id), b from", "list_append(ids, b.id), list_distinct(list_concat(sets, b.w)) from"),
)
check(
    reference.k7_diverse,
    _BM25.replace("with t as", "with recursive t as", 1)
    + f", {_HITS.replace("{0}", "")}, st as (select distinct query_id, 0::bigint as n, []::varchar[] as ids, []::varchar[][] as sets from h union all select query_id, n, case when ok then list_append(ids, id) else ids end, case when ok then list_append(sets, w) else sets end "
    + f"from (select h.query_id, h.n, h.id, h.w, st.ids, st.sets, len(st.ids) < 10 and len(list_filter(st.sets, z -> {_LIKE.format('h.w', 'z')} > 0.8)) = 0 as ok from st join h on h.query_id = st.query_id and h.n = st.n + 1)) "
    + _OUT,
)

# Similar names: over distinct names the oracle can afford all pairs

_SIM = """case when n = o then 1.0::double when starts_with(n, o) or starts_with(o, n) then case when least(length(n), length(o)) / greatest(length(n), length(o))::double < 0.3 then 0.0 else 0.7 + 0.3 * least(length(n), length(o)) / greatest(length(n), length(o))::double end
when contains(n, o) or contains(o, n) then 0.5 + 0.3 * least(length(n), length(o)) / greatest(length(n), length(o))::double else 1.0 - levenshtein(n, o) / greatest(length(n), length(o))::double end"""
check(
    texts.f17_f18_j18_similar_names,
    f"""with s as (select lower(trim(subject, ' ')) as n, count(*) as k from (select distinct subject from triples where subject is not null) group by 1),
p as (select a.n as n, b.n as o, case when a.n = b.n then a.k * (a.k - 1) // 2 else a.k * b.k end as n_links from s a join s b on a.n < b.n or (a.n = b.n and a.k > 1))
select n as name, o as other, round({_SIM}, 9) as similarity, n_links::bigint as n_links from p where {_SIM} >= 0.8""",
)

# Writes

_TRUST = "coalesce(case lower(trim(source)) " + " ".join(f"when '{k}' then '{v}'" for k, v in ingest.TRUST.items()) + " end, 'unverified')"
_SCOPE = "case " + " ".join(f"when regexp_matches(content, {_q('(?i)' + p)}) then '{n}'" for p, n in patterns.SCOPES) + " end"
_FEELING = "case " + " ".join("when " + " or ".join(f"contains(lower(content), '{w}')" for w in ws) + f" then '{n}'" for n, ws in patterns.EMOTIONS.items()) + " end"
_GIST = "case when length(string_split_regex(content, '[.!?]+')[1]) > 10 then left(trim(string_split_regex(content, '[.!?]+')[1], ' '), 100) else trim(left(content, 100), ' ') end"
_SECRETS = "array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(content, {_q(p)}) then '{n}' end" for n, p in X.SECRET_PATTERNS.items()) + "], x -> x is not null), ',')"
_ROWS = "(select distinct id, content, source, veracity, created_at from {0} where content is not null and id is not null)"


def _ingest_sql(name: str) -> str:
    rows = _ROWS.format(name)
    low = _LOW.format(name).replace("and created_at is not null", "and id is not null")
    return f"""select r.id, {_TRUST} as trust_tier, case when lower(trim(veracity)) in ('stated', 'unknown', 'inferred', 'imported', 'tool') then lower(trim(veracity)) else 'unknown' end as veracity, case when trim(content, ' ') = '' then 'unknown' else y.type end as memory_type,
n.event_date, n.precision as date_precision, {_GIST} as gist, {_FEELING} as emotion, {_SCOPE.replace('content', _FOLD.format('content'))} as time_scope, {_SECRETS} as secrets
from {rows} r left join ({_type_sql().replace(EM, rows)}) y on y.id = r.id left join ({named_sql(low)}) n on n.id = r.id"""


check(more.l1_l2_ingest, _ingest_sql("working_memory"))
check(
    more.x1_g14_annotations,
    f"""select id as memory_id, 'mentions' as kind, entity as value from ({entity_sql(_EF)}) union select id, 'has_source', source from episodic_memory where content is not null and source is not null
union select id, 'occurred_on', event_date::varchar from ({named_sql(_LOW.format('episodic_memory').replace("and created_at is not null", ""))}) where event_date is not null""",
)


# Patterns and statistics

_HOURS = "(select hour(created_at) as h, count(*) as n from (select distinct id, created_at from working_memory where created_at is not null) group by 1)"
_WD = "(select isodow(created_at) - 1 as h, count(*) as n from (select distinct id, created_at from working_memory where created_at is not null) group by 1)"


@query(f"""select * from (select 'hour' as kind, h::varchar as value, n::bigint as n, round(n / (sum(n) over ())::double, 6) as confidence from {_HOURS} order by n desc, h limit 3) union all
select * from (select 'weekday', h::varchar, n::bigint, round(n / (sum(n) over ())::double, 6) from {_WD} order by n desc, h limit 2) union all
select * from (select 'sequence', before || ' > ' || after, n::bigint, round(least(1.0, n / greatest(2, (select count(*) from {WM} where source is not null) - 1)::double), 6) from
(select before, after, count(*) as n from (select source as before, lead(source) over (partition by session_id order by created_at nulls first, id) as after from {WM}) where before is not null and after is not null group by all) order by n desc, before, after limit 3)""")
def f39_pattern_confidences(spark, d):
    """How sure the most frequent hours, weekdays and sequences of sources are."""
    return patterns.confidences(wm(spark, d, "id", "session_id", "source", "created_at"))


@query("select count(distinct src)::bigint as n_gists, count(distinct dst)::bigint as n_facts, count(*)::bigint as n_edges from (select distinct 'gist_' || id as src, 'fact_' || md5(s) as dst from (select id, unnest(regexp_extract_all(content, '[A-Z][a-z]+ blocks [A-Z][a-z]+')) as s from episodic_memory where content is not null))")
def g19_graph_statistics(spark, d):
    from palimpsest.operators import graph
    from palimpsest.plans.stores import g20_context_edges

    return graph.statistics(g20_context_edges(spark, d))


@query(f"select id from (select id, list_distinct(list_concat(regexp_extract_all(content, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)\\b', 1), [])) as p from {_EF}) where list_contains(p, 'Kabebako')")
def g19_by_participant(spark, d):
    """Texts in which someone takes part."""
    return em(spark, d).where("content is not null").where(F.array_contains(patterns.names(F.col("content")), "Kabebako")).select("id").distinct()


@query("select coalesce(a.id, b.id) as id, coalesce(a.content, b.content) as content from (select id, max(content) as content from working_memory group by id) a full join (select id, max(content) as content from episodic_memory group by id) b on a.id = b.id")
def x21_hydrated_contents(spark, d):
    """Contents by id, of the working row first."""
    one = lambda n, c: table(spark, d, n).groupBy(F.col("id").alias(f"i{c}")).agg(F.max("content").alias(c))
    both = one("working_memory", "a").join(one("episodic_memory", "b"), F.col("ia") == F.col("ib"), "full_outer")
    return both.select(F.coalesce("ia", "ib").alias("id"), F.coalesce("a", "b").alias("content"))


@query("""with c as (select distinct w.id, case when e.id is null then 'open' else 'done' end as state from (select distinct id from working_memory) w left join (select distinct unnest(string_split(summary_of, ',')) as id from episodic_memory) e using (id)) select state, count(*)::bigint as n from c group by state""")
def a2_consolidated_counts(spark, d):
    """Rows in a summary and rows in none."""
    return lifecycle.consolidation_counts(wm(spark, d, "id"), em(spark, d, "summary_of"))


_SPANS = "['v1:time:' || l_linenumber || '-na', 'v1:page:' || l_linenumber || '-' || l_linenumber, 'v1:char:' || l_linenumber || '-' || (l_linenumber + 9), 'v1:box:' || printf('%.6f', l_linenumber / 8.0) || ',0.500000', 'v1:whole']"


@query(f"select l_orderkey, l_linenumber, {_SPANS}[(l_orderkey % 5)::int + 1] || case when l_linenumber = 1 then ':spk=ann-b' else '' end as key from lineitem")
def f35_span_kinds(spark, d):
    """Keys of spans in time, pages, characters and pictures, and of whole assets."""
    line, n = table(spark, d, "lineitem"), F.col("l_linenumber")
    kind = F.get(F.array(*[F.lit(k) for k in ("time", "page", "char", "box", "whole")]), (F.col("l_orderkey") % 5).cast("int"))
    end = F.when(F.col("l_orderkey") % 5 == 2, n + 9)
    return line.select("l_orderkey", "l_linenumber", media.span_key(kind, n, end, F.array(n / 8.0, F.lit(0.5)), F.when(n == 1, " Ann & B ".strip()).otherwise("")).alias("key"))
