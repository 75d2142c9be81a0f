"""Queries for text, rule, media, event-window and pattern operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dates, media, predicates, rules
from palimpsest.functions import text as X
from palimpsest.operators import patterns, relational, retrieval
from palimpsest.plans.reference import _TOKENS, EM, ME, REF_US, TR, WM, em, me, tr, wm
from palimpsest.sources import files
from palimpsest.sources.tables import table
from palimpsest.streaming import events as streams

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _type_sql() -> str:
    parts = []
    for i, (pattern, kind, base) in enumerate(rules.TYPE_RULES):
        words = " + ".join(f"case when contains(low, {_q(b.lower())}) then 0.05 else 0 end" for b in rules.BOOSTERS.get(kind, [])) or "0"
        n = f"length(regexp_extract(low, {_q('(?i)' + pattern)}, 0))"
        confidence = f"least({base}::double + case when {n} > 20 then 0.1 when {n} > 10 then 0.05 else 0 end + {words}, 1.0)"
        parts.append(f"{{'score': case when {n} > 0 then round({confidence} * {1.0 + 0.1 * rules.TYPES.index(kind)}::double, 9) end, 'ord': {-i}, 'type': '{kind}', 'confidence': {confidence}}}")
    return f"""select id, coalesce(best.type, case when len(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda w: w <> '')) < 5 then 'fact' else 'context' end) as type, round(coalesce(best.confidence, 0.3), 6) as confidence
from (select id, content, list_max(list_filter([{", ".join(parts)}], lambda o: o.score is not null)) as best from (select id, content, lower(content) as low from {EM} where content is not null))"""


@query(_type_sql())
def f21_memory_types(spark, d):
    t = em(spark, d).where("content is not null").select("id", rules.memory_type(F.col("content")).alias("t")).distinct()
    return t.select("id", "t.type", F.round("t.confidence", 6).alias("confidence"))


def _compact_sql() -> str:
    out = "case " + " ".join(f"when starts_with(content, '{a}: ') then '{b}|' || substr(content, {len(a) + 3})" for a, b in rules.CATEGORY_CODES.items()) + " else content end"
    for a, b in sorted(rules.PHRASES.items(), key=lambda x: -len(x[0])):
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    for a, b in rules.SEPARATORS:
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return f"select id, replace(regexp_replace({out}, '\\(\\s*', '(', 'g'), ' )', ')') as compact from {EM} where content is not null"


@query(_compact_sql())
def f24_compact(spark, d):
    return em(spark, d).where("content is not null").select("id", rules.compact(F.col("content")).alias("compact")).distinct()


@query("select id, " + "array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(content, {_q(p)}) then '{n}' end" for n, p in X.SECRET_PATTERNS.items()) + f"], lambda x: x is not null), ',') as labels from {WM} where content is not null")
def f28_secrets(spark, d):
    return wm(spark, d).where("content is not null").select("id", F.array_join(X.secrets(F.col("content")), ",").alias("labels")).distinct()


@query()
def f19_x1_entities(spark, d):
    return em(spark, d).where("content is not null").select("id", F.explode(X.entities(F.col("content"))).alias("entity")).distinct()


@query()
def f17_f18_j18_similar_names(spark, d):
    return relational.similar_names(table(spark, d, "triples"), "subject").withColumn("similarity", F.round("similarity", 9))


_INTENT = ", ".join(
    "{'hits': " + " + ".join(f"case when regexp_matches(low, {_q(p)}) then 1 else 0 end" for p in ps) + f", 'ord': {-i}, 'name': '{n}'}}" for i, (n, ps) in enumerate(X.INTENTS.items())
)


@query(f"select id, case when best.hits > 0 then best.name else 'general' end as category, case when best.hits > 0 then least(1.0, 0.3 + 0.15 * best.hits)::double else 0.0::double end as confidence from (select id, list_max([{_INTENT}]) as best from (select id, lower(content) as low from {WM} where content is not null))")
def r21_intents(spark, d):
    i = wm(spark, d).where("content is not null").select("id", X.intent(F.col("content")).alias("i")).distinct()
    return i.select("id", "i.category", "i.confidence")


@query()
def f11_named_dates(spark, d):
    w = wm(spark, d).where("content is not null and created_at is not null")
    found = w.select("id", dates.named_date(F.col("content"), F.to_date("created_at")).alias("n")).distinct()
    return found.where("n.event_date is not null").select("id", "n.event_date", "n.precision")


@query("select id, " + "case " + " ".join("when " + " or ".join(f"contains(lower(content), '{w}')" for w in ws) + f" then '{n}'" for n, ws in patterns.EMOTIONS.items()) + f" end as emotion from {EM} where content is not null")
def g16_emotion(spark, d):
    return em(spark, d).where("content is not null").select("id", patterns.emotion(F.col("content")).alias("emotion")).distinct()


@query(f"select id, case when length(string_split_regex(content, '[.!?]+')[1]) > 10 then left(trim(string_split_regex(content, '[.!?]+')[1]), 100) else trim(left(content, 100)) end as gist from {EM} where content is not null")
def g16_gist(spark, d):
    return em(spark, d).where("content is not null").select("id", patterns.gist(F.col("content")).alias("gist")).distinct()


@query()
def g16_participants(spark, d):
    return em(spark, d).where("content is not null").select("id", F.array_join(patterns.participants(F.col("content")), ",").alias("participants")).distinct()


@query()
def g17_statements(spark, d):
    return em(spark, d).where("content is not null").select("id", F.explode(patterns.statements(F.col("content"))).alias("s")).select("id", "s.subject", "s.predicate", "s.object").distinct()


@query(
    "select id, fact_type, value, position from ("
    + " union all ".join(
        f"select id, '{n}' as fact_type, unnest(x) as value, unnest(range(1, len(x) + 1))::bigint as position from (select id, regexp_extract_all(content, {_q(p)}) as x from {WM} where content is not null)"
        for n, p in {
            "date": r"\b\d{4}-\d{2}-\d{2}\b",
            "version": r"\bv?\d+\.\d+(?:\.\d+)+\b",
            "measure": r"\b\d+(?:\.\d+)? ?(?:ms|seconds?|minutes?|hours?|days?|GB|MB|KB|%)",
            "negation": r"\b(?:never|not|cannot|nobody|nothing) \w+ \w+",
        }.items()
    )
    + ")"
)
def g1_extracted_facts(spark, d):
    return patterns.extract_facts(wm(spark, d).where("content is not null"), "id", "content").distinct()


@query(f"select word, count(*)::bigint as n from (select id, unnest(list_distinct({_TOKENS})) as word from {EM} where content is not null) group by word order by n desc, word limit 50")
def a17_frequent_words(spark, d):
    return patterns.frequent_words(em(spark, d, "id", "content").where("content is not null"), "content", 50)


_VOCAB = ["vector", "index", "grocery", "list", "shared", "calendar", "budget", "tool", "sheet", "travel"]


@query(f"with w as (select row, unnest(list_distinct(t)) as word from (select row_number() over () as row, {_TOKENS} as t from {EM} where content is not null)) select a.word as first, b.word as second, count(*)::bigint as n from w a join w b on a.row = b.row and a.word < b.word group by all order by n desc, first, second limit 50")
def a18_frequent_pairs(spark, d):
    return patterns.frequent_pairs(em(spark, d, "id", "content").where("content is not null"), "content", 50)


@query(f"with a as (select id, 1 as p from {WM} where contains(lower(content), 'vector index')), b as (select id, 2 as p from {WM} where contains(lower(content), 'grocery list')) select id, min(p)::int as pass from (from a union all from b) group by id order by pass, id limit 200")
def g5_passes(spark, d):
    w = wm(spark, d)
    has = lambda t: w.where(predicates.contains_any([F.col("content")], t))
    return patterns.best_pass([has("vector index"), has("grocery list")], "id", 200)


@query("select o_orderkey, 'v1:time:' || (o_custkey * 1000)::varchar || '-' || case when o_orderstatus = 'O' then 'na' else (o_custkey * 1000 + 500)::varchar end || ':spk=' || regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '-', 'g') as key from orders")
def f35_g30_span_keys(spark, d):
    o = table(spark, d, "orders")
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_custkey") * 1000 + 500)
    return o.select("o_orderkey", media.span_key(F.lit("time"), F.col("o_custkey") * 1000, end, speaker=F.col("o_orderpriority")).alias("key"))


@query("select c_custkey, 'https://' || lower(c_mktsegment) || '.example/' || c_name as ref from customer")
def f36_normal_refs(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", media.normal_ref(F.lit(" URL "), F.concat(F.lit("HTTPS://"), F.col("c_mktsegment"), F.lit(".EXAMPLE/"), F.col("c_name"))).alias("ref"))


@query(f"select id, content, null::varchar as reason, octet_length(encode(content))::bigint as size from {WM} where content is not null")
def s14_sanitised(spark, d):
    return wm(spark, d).where("content is not null").select("id", media.sanitised(F.col("content")).alias("s")).select("id", "s.content", "s.reason", F.col("s.size").cast("bigint").alias("size")).distinct()


@query("select coalesce(id, left(sha256(content), 16)) as id, content, 'flat_import' as source, timestamp, session_id, coalesce(importance, 0.5) as importance, 'human' as author_type from memories where trim(content) <> ''")
def s11a_flat_import(spark, d):
    return files.normalise(table(spark, d, "memories").drop("source", "created_at"), "flat").select("id", "content", "source", "timestamp", "session_id", "importance", "author_type")


@query("select count(*)::bigint as n_rows, sum(('0x' || left(md5(concat_ws(chr(31), coalesce(doc_id::varchar, chr(0)), coalesce(text, chr(0)), coalesce(lang, chr(0)), coalesce(source, chr(0)), coalesce(n_chars::varchar, chr(0)), coalesce(session_id, chr(0)), coalesce(epoch_us(created_at)::varchar, chr(0)))), 8))::bigint)::bigint as checksum from documents")
def s12_fingerprint(spark, d):
    return files.fingerprint(table(spark, d, "documents"))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*)::bigint as n from events group by all")
def t_windows_tumbling(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.windowed(e, "ts", ["event_type"], "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""with e as (select *, lag(ts) over (partition by user_id order by ts) as before from events), s as (select *, sum(case when before is null or epoch_us(ts) - epoch_us(before) > 3600000000 then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as g from e)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*)::bigint as n from s group by user_id, g""")
def t_windows_session(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(e, "ts", ["user_id"], "1 hour").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select event_id, event_type from events where event_type in ('error', 'purchase')")
def t2_listen(spark, d):
    return streams.listen(table(spark, d, "events"), ["error", "purchase"]).select("event_id", "event_type")


@query("select event_type, count(*)::bigint as n, round(avg(value), 6) as mean from events group by event_type")
def t14_metrics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"select id from {WM} where contains(lower(content), '--limit') is false and regexp_matches(lower(content), '\\blimit\\b')")
def op_p15_flag_collisions(spark, d):
    return wm(spark, d).where(predicates.flag_collision("what does --limit do", F.col("content"))).select("id").distinct()


@query(f"select id from {TR} where length(object) > 6")
def op_p20_long_facts(spark, d):
    return tr(spark, d, "id", "object").where(predicates.long_fact(F.col("object"), 6)).select("id")


@query(f"select event_id, parent from (select event_id, unnest(cast(json(parent_event_ids) as varchar[])) as parent from {ME} where parent_event_ids is not null)")
def x11_parents(spark, d):
    return me(spark, d, "parent_event_ids").select("event_id", F.explode(F.from_json("parent_event_ids", "array<string>")).alias("parent"))


@query("select distinct subject, replace(replace(replace(replace(replace(replace(replace(lower(subject), 'á', 'a'), 'é', 'e'), 'í', 'i'), 'ó', 'o'), 'ú', 'u'), 'ü', 'u'), 'ñ', 'n') as folded from triples where subject is not null")
def x32_folded(spark, d):
    return table(spark, d, "triples").where("subject is not null").select("subject").distinct().select("subject", X.folded(F.col("subject")).alias("folded"))


@query("select distinct len(embedding)::bigint as dim from embeddings")
def x4_dimensions(spark, d):
    return table(spark, d, "embeddings").select(F.size("embedding").cast("bigint").alias("dim")).distinct()


@query(f"select distinct id from {EM} where tier = 1 order by id limit 50 offset 10")
def k14_browse(spark, d):
    return em(spark, d).where("tier = 1").select("id").distinct().orderBy("id").offset(10).limit(50)


@query()
def r4_lexical(spark, d):
    asked = "shared calendar of the office server"
    e = retrieval.with_lexical(em(spark, d).where("content is not null").select("id", "content"), asked)
    return e.select("id", F.round("lex", 6).alias("relevance")).where("relevance > 0").distinct()


@query(f"select w1.session_id, w1.id from {WM} w1 where w1.created_at is not null and epoch_us(w1.created_at) >= {REF_US} - {7 * 86_400_000_000} order by w1.created_at desc, w1.id desc limit 20")
def r28_temporal_voice(spark, d):
    recent = wm(spark, d, "id", "session_id", "created_at").where(F.unix_micros("created_at") >= REF_US - 7 * 86_400_000_000)
    return relational.newest(recent, "created_at", "id", 20).select("session_id", "id")
