"""Queries for stores, writes, consolidation, facts and maintenance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import language as L
from palimpsest.functions import predicates, rules
from palimpsest.functions import text as X
from palimpsest.operators import conflicts, facts, history, lifecycle, patterns, relational, retrieval, stores
from palimpsest.plans.reference import _TOKENS, EM, ME, REF_US, TR, US, WM, em, me, tr, wm
from palimpsest.plans.reference import QUERIES as _REFERENCE
from palimpsest.plans.similar import _E as _TEXT_VECTORS
from palimpsest.plans.similar import _NORM as _LENGTH
from palimpsest.plans.texts import _compact_sql, _q, _type_sql
from palimpsest.plans.words import E as E_ROWS
from palimpsest.plans.words import W as W_ROWS
from palimpsest.plans.words import _list, duck
from palimpsest.sources.tables import table

QUERIES: dict = {}
DAY = 86_400_000_000


def query(sql: str | None = None):
    sql = duck(sql)

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# Counts, filters and sets


@query(f"select count(*)::bigint as n from (select distinct id, importance, created_at from working_memory) where {US} < {REF_US - 30 * DAY} and coalesce(importance < 0.9, true) and id not in (select distinct c from (select unnest(string_split(summary_of, ',')) as c from episodic_memory) where c is not null)")
def a3_due_rows(spark, d):
    """Rows due for consolidation: old enough, not held back, in no summary yet."""
    return lifecycle.due(wm(spark, d, "id", "importance", "created_at"), em(spark, d, "summary_of"), REF_US - 30 * DAY).agg(F.count("*").alias("n"))


@query("select least(count(*), 1000)::bigint as n from working_memory where importance >= 0.5")
def a21_bounded_count(spark, d):
    """A count that stops at its limit."""
    return table(spark, d, "working_memory").where("importance >= 0.5").select("id").limit(1000).agg(F.count("*").alias("n"))


@query("select memory_id, string_agg(distinct operation, ',' order by operation) as operations from memory_events where memory_id is not null group by memory_id")
def a23_distinct_concat(spark, d):
    e = table(spark, d, "memory_events").where("memory_id is not null").groupBy("memory_id").agg(F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"))
    return e


@query(f"select id, veracity, importance from (select distinct id, veracity, importance from working_memory where coalesce(lower(trim(veracity)), 'unknown') <> 'stated' and importance >= 0.2) order by importance desc, id limit 50")
def k10_l17_contaminated(spark, d):
    """Rows of labels that are not trusted, the most important first."""
    return lifecycle.contaminated(wm(spark, d, "id", "veracity", "importance"), 0.2, 50)


@query("select session_id, content, epoch_us(max(created_at)) as noted_us from memories where content is not null group by session_id, content order by max(created_at) desc nulls last, session_id nulls first, content limit 1000")
def k11_l18_u7_scratchpad(spark, d):
    return stores.scratchpad(table(spark, d, "memories").select("session_id", "content", "created_at"), "session_id", "content", "created_at").select("session_id", "content", F.unix_micros("created_at").alias("noted_us"))


@query("select distinct memory_id from memory_events where memory_id is not null and memory_id not in (select id from working_memory where id is not null union select id from episodic_memory where id is not null union select id from memories where id is not null)")
def u2_unknown_ids(spark, d):
    """Ids that events name and no table has."""
    ids = None
    for name in ("working_memory", "episodic_memory", "memories"):
        one = table(spark, d, name).select("id")
        ids = one if ids is None else ids.unionByName(one)
    return relational.missing_from(table(spark, d, "memory_events").where("memory_id is not null").select("memory_id").distinct(), ids, "memory_id", "id")


@query("select id from (select distinct id, content from memories where content is not null) where md5(content) not in (select md5(content) from working_memory where content is not null)")
def u4_new_by_content(spark, d):
    """Rows whose content no row of the other store has, by hash."""
    key = lambda n: table(spark, d, n).where("content is not null").select("id", F.unhex(F.md5("content")).alias("h")).distinct()
    return relational.missing_from(key("memories"), key("working_memory"), "h", "h").select("id")


@query("""select id, arg_max(importance, (at, new)) as importance, max(at) as at_us from (select id, any_value(importance) as importance, coalesce(epoch_us(any_value(created_at)), 0) as at, 0 as new from memories group by id
union all select id, any_value(importance), coalesce(epoch_us(any_value(created_at)), 0), 1 from working_memory group by id) where importance is not null group by id""")
def u6_replaced(spark, d):
    one = lambda n: table(spark, d, n).groupBy("id").agg(F.max("importance").alias("importance"), F.coalesce(F.unix_micros(F.max("created_at")), F.lit(0)).alias("at_us")).where("importance is not null")
    return stores.replaced(one("memories"), one("working_memory"), ["id"], "at_us")


@query(f"with n as (select id, lead(id) over (partition by lower(trim(subject)), predicate order by id) as superseded_by from {TR}) select id from n where superseded_by is null")
def op_p2_not_superseded(spark, d):
    t = tr(spark, d, "id", "subject", "predicate")
    later = F.lead("id").over(W.partitionBy(F.lower(F.trim("subject")), "predicate").orderBy("id"))
    return t.withColumn("superseded_by", later).where(F.col("superseded_by").isNull()).select("id")


@query(f"select distinct r.id from (select id, {_TOKENS} as t from {E_ROWS}) r join (select distinct id, source, veracity, timestamp from episodic_memory) e using (id) where list_contains(t, 'vector') and coalesce(e.source, '') <> 'import' and veracity in ('stated', 'inferred') and e.timestamp >= '2024-06-01T00:00:00'")
def op_p17_filters_after_fetch(spark, d):
    """The whole filter set applied to hits that another index found."""
    hits = retrieval.bm25(em(spark, d), {"q": "vector"}).select("id")
    rows = em(spark, d, "id", "source", "veracity", "timestamp").where(predicates.between_dates(F.col("timestamp"), "2024-06-01", None) & F.col("veracity").isin("stated", "inferred") & (F.coalesce("source", F.lit("")) != "import"))
    return rows.join(F.broadcast(hits), "id", "left_semi").select("id").distinct()


# Point operations and batches: one operation a row of the older store, told by its importance

_OPS = """(select row_number() over (order by id) as n, id, case when importance < 0.2 then 'forget' when importance < 0.4 then 'invalidate' when importance < 0.8 then 'update' when importance < 0.9 then 'remember' when importance is not null then 'replace' end as op,
case when importance < 0.7 then 'changed: ' || content end as content, case when importance >= 0.6 and importance < 0.65 then importance + 0.5 else importance end as importance, md5(id) as replacement from (select id, any_value(content) as content, max(importance) as importance from memories group by id))"""
_VALID = """case when op is null or op not in ('remember', 'update', 'forget', 'invalidate') then 'unknown operation' when op <> 'remember' and id is null then 'no id' when op = 'remember' and trim(coalesce(content, '')) = '' then 'no content'
when op = 'update' and content is null and importance is null then 'nothing to update' when importance is not null and not importance between 0 and 1 then 'importance out of range' end"""


def _operations(spark, d):
    m = table(spark, d, "memories").groupBy("id").agg(F.max("content").alias("content"), F.max("importance").alias("importance"))
    i = F.col("importance")
    op = F.when(i < 0.2, "forget").when(i < 0.4, "invalidate").when(i < 0.8, "update").when(i < 0.9, "remember").when(i.isNotNull(), "replace")
    return m.select(
        F.xxhash64("id").alias("n"), "id", op.alias("op"), F.when(i < 0.7, F.concat(F.lit("changed: "), "content")).alias("content"), F.when((i >= 0.6) & (i < 0.65), i + 0.5).otherwise(i).alias("importance"), F.md5("id").alias("replacement")
    )


@query(f"""with o as (select *, {_VALID} as reason from {_OPS}), s as (select * from o where reason is null and op <> 'remember'), r as (select id, any_value(content) as content, max(importance) as importance from working_memory group by id)
select r.id, case when s.op = 'update' and s.content is not null then s.content else r.content end as content, case when s.op = 'update' and s.importance is not null then s.importance else r.importance end as importance, case when s.op = 'invalidate' then s.replacement end as superseded_by
from r left join s on s.id = r.id where coalesce(s.op, '') <> 'forget'""")
def l3_point_operations(spark, d):
    """Working rows after updates, invalidations and removals."""
    rows = wm(spark, d).groupBy("id").agg(F.max("content").alias("content"), F.max("importance").alias("importance")).withColumn("superseded_by", F.lit(None).cast("string"))
    return stores.applied(rows, _operations(spark, d))


@query(f"""with o as (select *, {_VALID} as reason from {_OPS}), k as (select distinct id as k from working_memory)
select case when reason is not null then 'rejected: ' || reason when op <> 'remember' and k is null then 'not found' else op end as outcome, count(*)::bigint as n from o left join k on k.k = o.id group by 1""")
def l4_batch_dry_run(spark, d):
    return stores.dry_run(wm(spark, d, "id"), _operations(spark, d))


# Consolidation

_DUE = f"(select id, session_id, source, created_at, content, veracity, importance from (select id, any_value(session_id) as session_id, any_value(source) as source, any_value(created_at) as created_at, any_value(content) as content, any_value(veracity) as veracity, max(importance) as importance from working_memory group by id) where epoch_us(created_at) < {REF_US - 30 * DAY} and coalesce(importance < 0.9, true) and id not in (select distinct c from (select unnest(string_split(summary_of, ',')) as c from episodic_memory) where c is not null))"
_CHUNKS = f"(select *, (row_number() over (partition by session_id, source order by created_at, id) - 1) // 20 as chunk from {_DUE})"
_SUMMARY = _compact_sql().split(" as compact")[0].removeprefix("select id, ")


@query(f"select session_id, source, chunk, n, {_SUMMARY} as summary, members from (select session_id, source, chunk::bigint as chunk, count(*)::bigint as n, string_agg(left(coalesce(content, ''), 60), ' | ' order by created_at, id) as content, string_agg(id, ',' order by created_at, id) as members from {_CHUNKS} group by session_id, source, chunk)")
def l5_l7_sleep_summaries(spark, d):
    """New summaries of what is due: twenty rows each in order of time, per session and source, in the compact encoding."""
    rows = table(spark, d, "working_memory").select("id", "session_id", "source", "created_at", "importance", F.substring(F.coalesce("content", F.lit("")), 1, 60).alias("head")).distinct()
    due = lifecycle.due(rows, em(spark, d, "summary_of"), REF_US - 30 * DAY)
    return lifecycle.summaries(due, ["session_id", "source"], "created_at", "id", "head", 20)


@query(f"select id, {REF_US}::bigint as consolidated_us from {_DUE}")
def l5_claimed_rows(spark, d):
    """The rows that a sleep marks as consolidated; their texts stay."""
    return lifecycle.due(wm(spark, d, "id", "importance", "created_at"), em(spark, d, "summary_of"), REF_US - 30 * DAY).select("id", F.lit(REF_US).cast("bigint").alias("consolidated_us"))


_LABEL = "case when veracity in ('stated','unknown','inferred','imported','tool') then veracity else 'unknown' end"


@query(f"""with c as (select session_id, source, {_LABEL} as label, count(*)::bigint as n from {_DUE} group by all),
r as (select *, row_number() over (partition by session_id, source order by (label = 'unknown')::int, n desc, case label when 'stated' then 1.0 when 'inferred' then 0.7 when 'imported' then 0.6 when 'tool' then 0.5 else 0.8 end, label) as k from c)
select session_id, source, label as veracity from r where k = 1""")
def l6_summary_trust(spark, d):
    """The label that the summaries of each session and source take: the majority, the weaker one of equals."""
    due = lifecycle.due(wm(spark, d, "id", "session_id", "source", "veracity", "importance", "created_at"), em(spark, d, "summary_of"), REF_US - 30 * DAY)
    key = due.withColumn("__k", F.struct("session_id", "source"))
    return facts.majority_label(key, "__k", "veracity").select("__k.session_id", "__k.source", F.col("label").alias("veracity"))


@query(f"select event_id, seen from {ME} where operation = 'CONSOLIDATE' and seen is not null order by seen desc, event_id desc limit 100")
def x6_consolidation_log(spark, d):
    from palimpsest.operators import sync

    return sync.last_n(me(spark, d, "operation").where("seen is not null"), "seen", "event_id", 100, ["CONSOLIDATE"]).select("event_id", "seen")


# Maintenance


@query("""select 'working rows of no event' as problem, count(*)::bigint as n from (select distinct id from working_memory where id is not null and id not in (select memory_id from memory_events where memory_id is not null))
union all select 'summaries of unknown rows', count(*) from (select distinct unnest(string_split(summary_of, ',')) as c from episodic_memory) where c <> '' and c not in (select id from working_memory where id is not null)
union all select 'repeated ids', count(*) from (select id from working_memory group by id having count(*) > 1) union all select 'rows without content', count(distinct id) from working_memory where content is null
union all select 'ids in two stores', count(*) from (select distinct id from working_memory) join (select distinct id from memories) using (id)""")
def l16_integrity(spark, d):
    """What does not fit together, and how often."""
    w = table(spark, d, "working_memory")
    ids = w.select("id").distinct()
    covered = table(spark, d, "episodic_memory").select(F.explode(F.split("summary_of", ",")).alias("c")).where("c != ''").distinct()
    found = {
        "working rows of no event": relational.missing_from(ids.where("id is not null"), table(spark, d, "memory_events"), "id", "memory_id"),
        "summaries of unknown rows": relational.missing_from(covered, ids, "c", "id"),
        "repeated ids": w.groupBy("id").count().where("count > 1"),
        "rows without content": w.where("content is null").select("id").distinct(),
        "ids in two stores": ids.join(table(spark, d, "memories").select("id"), "id", "left_semi"),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select 'working_memory' as name, md5('id string,content string,source string,timestamp string,session_id string,importance double,metadata_json string,veracity string,author_id string,author_type string,channel_id string,created_at timestamp') as fingerprint")
def l16_schema_fingerprint(spark, d):
    fields = ",".join(f"{n} {t}" for n, t in table(spark, d, "working_memory").dtypes).replace("timestamp_ntz", "timestamp")
    return spark.range(1).select(F.lit("working_memory").alias("name"), F.md5(F.lit(fields)).alias("fingerprint"))


@query("select distinct id from working_memory where id is not null and id not in (select memory_id from memory_events where memory_id is not null)")
def x12_unlogged(spark, d):
    return relational.missing_from(wm(spark, d, "id").where("id is not null"), table(spark, d, "memory_events"), "id", "memory_id")


@query("""select coalesce(a.id, b.id) as id, case when b.id is null then 'drop' when a.id is null then 'embed' else 'refresh' end as action from (select id, md5(any_value(content)) as h from memories where content is not null group by id) a
full join (select id, md5(any_value(content)) as h from working_memory where content is not null group by id) b on a.id = b.id where a.h is distinct from b.h""")
def x5_stale_embeddings(spark, d):
    """Which vectors to make, make again or drop after contents changed."""
    h = lambda n, c: table(spark, d, n).where("content is not null").groupBy(F.col("id").alias(c)).agg(F.md5(F.max("content")).alias(f"h{c}"))
    both = h("memories", "a").join(h("working_memory", "b"), F.col("a") == F.col("b"), "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb")))
    return both.select(F.coalesce("a", "b").alias("id"), F.when(F.col("b").isNull(), "drop").when(F.col("a").isNull(), "embed").otherwise("refresh").alias("action"))


_CARRIED = ["id", "content", "source", "timestamp", "session_id", "importance", "metadata_json"]


@query("select 'working_memory' as name, count(*)::bigint as n_rows, 'author_id,author_type,channel_id,created_at,veracity' as left_out from working_memory union all select 'memories', count(*), 'created_at' from memories union all select 'episodic_memory', count(*), 'created_at,row_id,summary_of,tier,veracity' from episodic_memory")
def x26_export_report(spark, d):
    """Rows per table and the columns that the JSON export does not carry."""
    out = None
    for name in ("working_memory", "memories", "episodic_memory"):
        t = table(spark, d, name)
        one = t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(",".join(sorted(set(t.columns) - set(_CARRIED)))).alias("left_out"))
        out = one if out is None else out.unionByName(one)
    return out


_NOISE = "case when score >= 0.8 then 'delete' when score >= 0.5 then 'archive' else 'keep' end"


_FLAGGED = " or ".join(f"regexp_matches(content, {_q(p)})" for p in X.SECRET_PATTERNS.values())


@query(f"select source, case when flagged then 'flag' when score >= 0.8 then 'delete' when score >= 0.5 then 'archive' else 'keep' end as action, count(*)::bigint as n from (select s.id, s.score, w.source, {_FLAGGED} as flagged from ({_REFERENCE['f27_l15_noise'][1]}) s join (select distinct id, source, content from working_memory where content is not null) w using (id)) group by all")
def l15_x15_noise_summary(spark, d):
    """How many rows each suggested action would take, per source."""
    c = F.col("content")
    scored = wm(spark, d).where("content is not null").select("id", "source", X.suggested_action(X.noise_score(c, F.col("importance"), F.col("source")), X.secrets(c)).alias("action")).distinct()
    return scored.groupBy("source", "action").agg(F.count("*").alias("n"))


@query(f"select (select count(distinct id) from working_memory where content is not null)::bigint as n_before, (select count(distinct id) from working_memory where content is not null)::bigint as n_restored")
def l15_clean_and_restore(spark, d):
    """Noise moved to an archive and back: nothing is lost."""
    c = F.col("content")
    scored = wm(spark, d).where("content is not null").select("id", X.noise_score(c, F.col("importance"), F.col("source")).alias("score")).groupBy("id").agg(F.max("score").alias("score"))
    kept, archived = lifecycle.cleaned(scored, 0.5)
    whole = lifecycle.restored(kept, archived)
    return whole.agg(F.count_distinct("id").alias("n_before"), F.count("*").alias("n_restored"))


_ANNOTATED = ["prefers", "uses_tool"]


@query(f"select case when predicate in ('prefers', 'uses_tool') then 'annotation' else 'triple' end as moved_to, count(*)::bigint as n, count(distinct lower(trim(subject)))::bigint as n_subjects from {TR} group by 1")
def l20_split_triples(spark, d):
    """Predicates of many values become annotations, the others stay."""
    kept, moved = history.split_predicates(tr(spark, d, "id", "subject", "predicate"), _ANNOTATED)
    one = lambda df, name: df.groupBy(F.lit(name).alias("moved_to")).agg(F.count("*").alias("n"), F.count_distinct(F.lower(F.trim("subject"))).alias("n_subjects"))
    return one(moved, "annotation").unionByName(one(kept, "triple"))


@query("select session_id, sum(tokens)::bigint as tokens, round(sum(tokens * 3.0 / 1000000), 9)::double as cost from (select session_id, ceil(length(text) / 4.0)::bigint as tokens from documents where text is not null) group by session_id")
def x29_a9_costs(spark, d):
    """Cost entries of one call a document, added up by session."""
    entries = table(spark, d, "documents").where("text is not null").select("session_id", X.token_estimate(F.col("text")).alias("tokens"))
    return entries.groupBy("session_id").agg(F.sum("tokens").alias("tokens")).withColumn("cost", F.round(F.col("tokens") * 3.0 / 1_000_000, 9))


# Facts


@query(f"with c as (select *, lag(object) over w as before, row_number() over w as n from (select distinct id, lower(trim(subject)) as subject, predicate, object from triples where predicate <> 'status') window w as (partition by subject, predicate order by id)), k as (select * from c where n = 1 or object is distinct from before) select subject, predicate, object, row_number() over (partition by subject, predicate order by id)::int as version from k")
def g2_fact_versions(spark, d):
    """Versions of every fact but those of kinds that are never versioned."""
    t = tr(spark, d, "id", "subject", "predicate", "object").where("predicate != 'status'").withColumn("subject", F.lower(F.trim("subject")))
    return stores.remember_canonical(t, ["subject", "predicate"], "object", ["id"], "id").select("subject", "predicate", "object", "version")


@query(f"select id, case when p > 0 then substr(content, greatest(1, p - 60)::bigint, (p - greatest(1, p - 60) + 6 + 60)::bigint) end as snippet from (select *, instr(content, 'blocks') as p from {W_ROWS})")
def g3_snippets(spark, d):
    return wm(spark, d).where("content is not null").select("id", stores.snippet(F.col("content"), F.lit("blocks"), 60).alias("snippet")).distinct()


_ASKED = "Which 12 notes about Kabebako mention the database error of the index"
_PASSES = [r"\b12\b", r"\bKabebako\b", r"\b(db|datastore|bug|issue|fault|failure|crash|exception|traceback)\b", "index"]


@query(f"with r as (select id, case " + " ".join(f"when regexp_matches(content, '{p}') then {i}" for i, p in enumerate(_PASSES, 1)) + f" end as pass from {W_ROWS}) select id, pass::int as pass from r where pass is not null order by pass, id limit 200")
def g5_four_passes(spark, d):
    """Numbers of the question, its names, words of the same meaning, then its last word anywhere: each row by its first pass."""
    rows = wm(spark, d).where("content is not null").select("id", "content")
    return patterns.best_pass([rows.where(F.col("content").rlike(p)) for p in patterns.passes(_ASKED)], "id", 200)


_DATED = r"(select distinct id, unnest(regexp_extract_all(content, '\b\d{4}-\d{2}-\d{2}\b')) as day from working_memory where content is not null)"


@query(f"select day, id from {_DATED} where starts_with(day, '2025-0') order by day desc, id limit 100")
def g6_timeline(spark, d):
    """What happened in a month or year, the latest first."""
    days = wm(spark, d).where("content is not null").select("id", F.explode(F.regexp_extract_all("content", F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), 0)).alias("day")).distinct()
    return patterns.timeline(days, "2025-0", 100).select("day", "id")


@query(rf"select id from {W_ROWS} where regexp_matches(lower(content), '\b(never|not|cannot|nobody|nothing|don''t|won''t)\b') and contains(lower(content), 'index')")
def g7_negations(spark, d):
    return patterns.negations(wm(spark, d).where("content is not null"), ["index"]).select("id").distinct()


@query("select id, predicate, object from (select distinct id, subject, predicate, object from triples) where regexp_replace(lower(trim(subject)), '^[a-z]+:', '') in ('demutino', 'lifozove')")
def g8_g19_entity_facts(spark, d):
    return patterns.of_entities(tr(spark, d, "id", "subject", "predicate", "object"), ["Demutino", "lifozove"]).select("id", "predicate", "object")


@query(rf"select session_id, id, row_number() over (partition by session_id order by created_at, id)::int as step from (select distinct session_id, id, created_at, content from working_memory where content is not null and created_at is not null) where regexp_matches(lower(content), '\b(first|then|next|after|before|until|later|finally)\b')")
def g9_sequences(spark, d):
    """What came after what in each session."""
    rows = wm(spark, d).where("content is not null and created_at is not null").where(F.lower("content").rlike(patterns.ORDER_WORDS)).select("session_id", "id", "created_at").distinct()
    return rows.select("session_id", "id", F.row_number().over(W.partitionBy("session_id").orderBy("created_at", "id")).alias("step"))


@query(f"select id from (select distinct i.id, created_at from ({_type_sql()}) i join episodic_memory using (id) where type = 'instruction') order by created_at desc nulls last, id limit 50")
def g10_instructions(spark, d):
    """Rules that hold, the latest first."""
    t = em(spark, d).where("content is not null").select("id", "created_at", rules.memory_type(F.col("content"))["type"].alias("t")).where("t = 'instruction'").select("id", "created_at").distinct()
    return t.orderBy(F.desc_nulls_last("created_at"), "id").limit(50).select("id")


@query("select lower(trim(subject)) as subject, string_agg(object, ' -> ' order by id) as evolution, count(*)::bigint as n_versions from (select distinct id, subject, object from triples where predicate = 'prefers') group by 1")
def g11_preferences(spark, d):
    t = tr(spark, d, "id", "subject", "predicate", "object").where("predicate = 'prefers'").withColumn("subject", F.lower(F.trim("subject")))
    return history.evolution(t, ["subject"], "object", "id")


@query("select id from (select distinct id, subject, predicate, object from triples) t where id > (select min(id) from triples u where lower(trim(u.subject)) = lower(trim(t.subject)) and u.predicate = t.predicate and u.object = t.object)")
def g12_repeated_facts(spark, d):
    """Facts that another session had told before."""
    t = tr(spark, d, "id", "subject", "predicate", "object").where("subject is not null and predicate is not null and object is not null")
    return relational.beyond_first(t, [F.lower(F.trim("subject")), F.col("predicate"), F.col("object")], "id").select("id")


_ISO = "regexp_matches(valid_from, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')"


@query(f"select id, coalesce(valid_until, case when predicate = 'status' then '2025-01-01' end) as valid_until from {TR}")
def g13_x24_ended_triples(spark, d):
    """Every open status ended at a day."""
    t = tr(spark, d, "id", "subject", "predicate", "valid_until")
    ends = t.where("predicate = 'status'").select("subject", "predicate", F.lit("2025-01-01").alias("at"))
    open_null = t.where("subject is null and predicate = 'status'").withColumn("valid_until", F.coalesce("valid_until", F.lit("2025-01-01")))
    named = t.where("not (subject is null and predicate <=> 'status')")
    return stores.end_triple(named, ends.where("subject is not null")).unionByName(open_null).select("id", "valid_until")


@query(f"select id from {TR} where lower(trim(predicate)) = 'owns' and {_ISO} and valid_from <= '2023-06-15' and (valid_until is null or valid_until > '2023-06-15')")
def g13_x24_query_triples(spark, d):
    t = tr(spark, d, "id", "subject", "predicate", "object", "valid_from", "valid_until").where(F.col("valid_from").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    return stores.query_triples(t, predicate="OWNS", at="2023-06-15").select("id")


_SLOTS = "(select *, row_number() over (partition by subject, predicate order by id desc) as back from (select distinct id, lower(trim(subject)) as subject, predicate, object from triples where subject is not null))"


@query(f"select subject, predicate, object from {_SLOTS} where back = 1")
def g15_w6_x24_current_slots(spark, d):
    """What every slot holds now; writing the same again adds no version."""
    t = tr(spark, d, "id", "subject", "predicate", "object").where("subject is not null").withColumn("subject", F.lower(F.trim("subject")))
    slots = ["subject", "predicate"]
    return stores.recall_canonical(stores.remember_canonical(t, slots, "object", ["id"], "id"), slots).select("subject", "predicate", "object")


@query(f"select subject, string_agg('- ' || predicate || ': ' || object, chr(10) order by predicate, object) as card from {_SLOTS} where back = 1 and predicate is not null and object is not null group by subject")
def g15_model_cards(spark, d):
    current = g15_w6_x24_current_slots(spark, d).where("predicate is not null and object is not null")
    return stores.model_card(current, "subject", "predicate", "object")


@query("with g as (select distinct 'gist_' || id as src, id, unnest(regexp_extract_all(content, '[A-Z][a-z]+ blocks [A-Z][a-z]+')) as s from episodic_memory where content is not null) select distinct src, 'fact_' || md5(s) as dst, 'ctx' as edge_type from g")
def g20_context_edges(spark, d):
    """Edges from a text's gist to the facts it tells."""
    said = F.explode(F.regexp_extract_all(F.col("content"), F.lit(r"[A-Z][a-z]+ blocks [A-Z][a-z]+"), 0))
    rows = em(spark, d).where("content is not null").select("id", said.alias("s")).distinct()
    return rows.select(F.concat(F.lit("gist_"), "id").alias("src"), F.concat(F.lit("fact_"), F.md5("s")).alias("dst"), F.lit("ctx").alias("edge_type")).distinct()


@query("with g as (select distinct 'gist_' || id as src, unnest(regexp_extract_all(content, '[A-Z][a-z]+ blocks [A-Z][a-z]+')) as s from episodic_memory where content is not null) select substr(src, 6) as id, count(distinct s)::bigint as degree from g group by src")
def j19_degrees_by_id(spark, d):
    """Edges per memory, by the id inside the edge's source, with an equality instead of a substring test."""
    return g20_context_edges(spark, d).groupBy(F.regexp_replace("src", "^(gist|fact)_", "").alias("id")).agg(F.count("*").alias("degree"))


_CONF = "(select lower(trim(subject)) as subject, predicate, object, max(coalesce(confidence, 0.0)) as confidence from triples where object is not null group by all)"


@query(f"with b as (select subject, predicate, max(confidence) as confidence, arg_max(object, (confidence, object)) as winner from {_CONF} group by subject, predicate) select f.subject, f.predicate, winner, f.object as loser, b.confidence - f.confidence > 0.05 as resolved from {_CONF} f join b on f.subject = b.subject and f.predicate = b.predicate where f.object <> winner")
def g22_g23_conflicts(spark, d):
    """Conflicts of facts, each against the best of its slot, and whether confidence settles them."""
    f = tr(spark, d).where("object is not null").groupBy(F.lower(F.trim("subject")).alias("subject"), "predicate", "object").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return stores.conflict_list(f, 0.05)


@query(f"with f as (select lower(trim(subject)) as subject, predicate, object, count(*) as n, max(coalesce(confidence, 0.0)) as confidence from (select distinct id, subject, predicate, object, confidence from triples where subject is not null and predicate is not null and object is not null) group by all), w as (select subject, predicate, max(confidence) as best from f where n >= 2 group by all) select f.subject, f.predicate, f.object from f join w using (subject, predicate) where f.confidence < w.best")
def g24_superseded_facts(spark, d):
    """Facts that one told often enough and more surely supersedes."""
    t = tr(spark, d, "id", "subject", "predicate", "object", "confidence").where("subject is not null and predicate is not null and object is not null")
    f = t.groupBy(F.lower(F.trim("subject")).alias("subject"), "predicate", "object").agg(F.count("*").alias("mention_count"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return facts.superseded_facts(f, "subject", "predicate", "object", 2).select("subject", "predicate", "object")


@query(f"select count(*)::bigint as n_facts, count(distinct subject)::bigint as n_subjects, round(avg(confidence), 6) as mean_confidence, count(*) filter (confidence >= 0.8)::bigint as n_confident from {_CONF}")
def g25_fact_statistics(spark, d):
    f = tr(spark, d).where("object is not null").groupBy(F.lower(F.trim("subject")).alias("subject"), "predicate", "object").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return facts.statistics(f, "subject", "confidence", 0.8)


_KIND = f"(select i.id, type, importance, session_id, content from ({_type_sql()}) i join (select id, max(importance) as importance, any_value(session_id) as session_id, any_value(content) as content from episodic_memory group by id) using (id) where type in ('preference', 'instruction'))"


@query(f"select id, session_id from (select *, row_number() over (partition by session_id order by importance desc nulls last, id) as n from {_KIND}) where n = 1 and session_id not in (select session_id from memories where session_id is not null)")
def g27_persona_traits(spark, d):
    """The best preference or rule of each topic that was not promoted before."""
    return stores.persona(_persona_rows(spark, d), table(spark, d, "memories").where("session_id is not null"), "session_id")[0].select("id", "session_id")


def _persona_rows(spark, d):
    t = em(spark, d).where("content is not null").select("id", "session_id", "importance", "content", rules.memory_type(F.col("content"))["type"].alias("t")).where("t in ('preference', 'instruction')")
    return t.where("session_id is not null").groupBy("id").agg(F.max("importance").alias("importance"), F.max("session_id").alias("session_id"), F.max("content").alias("content"))


@query(f"with t as (select * from (select *, row_number() over (partition by session_id order by importance desc nulls last, id) as n from {_KIND} where session_id is not null) where n = 1 and session_id not in (select session_id from memories where session_id is not null)), b as (select * from t order by importance desc nulls last, id limit 20) select string_agg('- ' || left(content, 80), chr(10) order by coalesce(importance, 0) desc, id) as persona, count(*) >= 3 as due from b")
def g27_persona_text(spark, d):
    return stores.persona(_persona_rows(spark, d), table(spark, d, "memories").where("session_id is not null"), "session_id")[1]


_ACTS = f"(select memory_id as id, case operation when 'CREATE' then 'attest' when 'UPDATE' then 'update' when 'CONSOLIDATE' then 'invalidate' else 'delete' end as action, seen as at, event_id as n from {ME} where memory_id is not null and seen is not null)"


@query(f"select id, case arg_max(action, (at, n)) when 'delete' then 'deleted' when 'invalidate' then 'invalid' when 'update' then 'updated' else 'attested' end as state, least(count(*), 3)::bigint as n_kept from {_ACTS} group by id")
def g29_validations(spark, d):
    """What validation actions leave of each memory, with its last three remembered."""
    e = me(spark, d, "memory_id", "operation").where("memory_id is not null and seen is not null")
    action = F.when(F.col("operation") == "CREATE", "attest").when(F.col("operation") == "UPDATE", "update").when(F.col("operation") == "CONSOLIDATE", "invalidate").otherwise("delete")
    return stores.validation_state(e.select(F.col("memory_id").alias("id"), action.alias("action"), F.col("seen").alias("at"), F.col("event_id").alias("n")))


_PROPOSED = "(select memory_id as slot, event_id as n, json_extract_string(payload, '$.content') as body, least(greatest(coalesce(try_cast(json_extract_string(payload, '$.importance') as double), 0.5), 0), 1) as confidence from (select memory_id, event_id, any_value(payload) as payload from memory_events where memory_id is not null and operation = 'UPDATE' and json_valid(payload) group by all) where json_type(payload) = 'OBJECT')"


@query(f"select slot, n, confidence, case when confidence < 0.3 then 'rejected' when k = 1 and confidence >= 0.9 then 'applied' else 'pending' end as status from (select *, row_number() over (partition by slot order by confidence desc, n) as k from {_PROPOSED})")
def l19_x27_proposals(spark, d):
    """Proposed changes with their confidence made sound, and what becomes of each."""
    e = table(spark, d, "memory_events").where("memory_id is not null and operation = 'UPDATE'").groupBy("memory_id", "event_id").agg(F.min("payload").alias("payload"))
    p = e.where("schema_of_variant(try_parse_json(payload)) like 'OBJECT%'")
    read = p.select(F.col("memory_id").alias("slot"), F.col("event_id").alias("n"), F.get_json_object("payload", "$.content").alias("body"), stores.coerced(F.get_json_object("payload", "$.importance")).alias("confidence"))
    return stores.decided(read).select("slot", "n", "confidence", "status")


@query(f"select vec_id, round(c * conf, 6) as score from (select v.vec_id, round(list_dot_product(v.embedding::double[], q.embedding::double[]) / (sqrt(list_sum(list_transform(v.embedding::double[], x -> x * x))) * sqrt(list_sum(list_transform(q.embedding::double[], x -> x * x)))), 9) as c, (v.label + 1) / 10.0::double as conf from embeddings v, (select * from embeddings where vec_id = 7) q where v.vec_id <> 7) order by round(c * conf, 9) desc, vec_id limit 10")
def r30_beliefs(spark, d):
    """Beliefs by cosine times confidence (here a stored vector's label stands for it)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), ((F.col("label") + 1) / 10.0).alias("confidence"))
    return retrieval.weighted_topk(v, v.where("id = 7"), "confidence", 10, 64).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("select distinct id as memory_id, 'fact' as kind, s as value from (select id, unnest(regexp_extract_all(content, '[A-Z][a-z]+ blocks [A-Z][a-z]+')) as s from episodic_memory where content is not null) where length(s) > 10")
def x2_fact_annotations(spark, d):
    """Facts told in texts as annotations, each once; the extractor is a function of the text."""
    said = F.explode(F.regexp_extract_all(F.col("content"), F.lit(r"[A-Z][a-z]+ blocks [A-Z][a-z]+"), 0))
    new = em(spark, d).where("content is not null").select(F.col("id").alias("memory_id"), F.lit("fact").alias("kind"), said.alias("value")).where(predicates.long_fact(F.col("value"), 10))
    return stores.add_annotation(new.limit(0), new)


@query(f"select event_id, parent, n::int as n from (select event_id, unnest(p) as parent, generate_subscripts(p, 1) as n from (select event_id, cast(json(parent_event_ids) as varchar[]) as p from {ME} where json_valid(parent_event_ids)))")
def x23_tolerant_arrays(spark, d):
    """JSON arrays read from text that may have words around them."""
    e = me(spark, d, "parent_event_ids").withColumn("told", F.concat(F.lit("Here you are: "), "parent_event_ids", F.lit(" done.")))
    found = e.select("event_id", F.from_json(F.regexp_extract("told", r"(?s)(\[.*\])", 1), "array<string>").alias("p")).where("p is not null")
    return found.select("event_id", F.posexplode("p").alias("n", "parent")).select("event_id", "parent", (F.col("n") + 1).alias("n"))


@query("select memory_id, value from (select distinct id as memory_id, source as value from working_memory where source is not null) where value = 'insight'")
def g14_x24_query_annotations(spark, d):
    new = wm(spark, d, "id", "source").where("source is not null").select(F.col("id").alias("memory_id"), F.lit("has_source").alias("kind"), F.col("source").alias("value"))
    return stores.query_annotations(stores.add_annotation(new.limit(0), new), "has_source", "insight").select("memory_id", "value")


@query(f"""with e as {_TEXT_VECTORS} select q.id as src, v.id as dst, round(greatest(0.1, 1 - 0.2 * (row_number() over (partition by q.id order by round(list_dot_product(q.v, v.v) / greatest(1e-300, {_LENGTH.format('q.v')}) / greatest(1e-300, {_LENGTH.format('v.v')}), 9) desc, v.id) - 1)), 9)::double as weight
from e q join e v on q.id <> v.id where ('0x' || left(md5(q.id), 4))::int % 50 = 0 qualify row_number() over (partition by q.id order by round(list_dot_product(q.v, v.v) / greatest(1e-300, {_LENGTH.format('q.v')}) / greatest(1e-300, {_LENGTH.format('v.v')}), 9) desc, v.id) <= 5""")
def g21_similar_links(spark, d):
    """For each row whose hash is divisible by 50 the five most alike, of weight 1, 0.8, 0.6 ... (at least 0.1)."""
    t = em(spark, d).where("content is not null and id is not null").select("id", "content")
    rows = t.select("id", conflicts.hashed_embedding(64)(X.tokens(F.col("content"))).alias("embedding")).groupBy("id").agg(F.first("embedding").alias("embedding"))
    near = retrieval.vector_topk(rows, rows.where(F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 50 == 0), 5, 64)
    return near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.greatest(F.lit(0.1), F.round(1 - 0.2 * (F.col("rank") - 1), 9)).alias("weight"))
