"""Queries for the general operators over the test tables, named by the operator's id, each with oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import decay, predicates, vectors
from palimpsest.functions import text as X
from palimpsest.functions.instants import with_instant
from palimpsest.operators import facts, graph, history, lifecycle, relational, retrieval, sync
from palimpsest.plans.problems import duck_instant
from palimpsest.session import tuned
from palimpsest.sources.tables import table

REF = "2025-06-01 00:00:00"
REF_US = 1_748_736_000_000_000
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _of(name: str):
    def read(spark: SparkSession, d: str, *columns: str) -> DataFrame:
        """The table with only these columns, repeated rows once; without columns the plain table, repeats and all."""
        t = table(spark, d, name)
        return t.select(*columns).distinct() if columns else t

    return read


wm, em, tr = _of("working_memory"), _of("episodic_memory"), _of("triples")


def me(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct events with the named columns and their first arrival."""
    e = table(spark, d, "memory_events")
    return e.groupBy("event_id", *columns).agg(F.min(F.unix_micros("synced_at")).alias("seen"))


WM, EM, TR = "(select distinct * from working_memory)", "(select distinct * from episodic_memory)", "(select distinct * from triples)"
ME = "(select event_id, memory_id, operation, device_id, importance, parent_event_ids, min(epoch_us(synced_at)) as seen from memory_events group by all)"
US = "epoch_us(created_at)"


# Scans


@query(f"select id, {US} as at from {WM} order by created_at desc nulls last, id desc limit 500")
def s2_newest(spark, d):
    return relational.newest(wm(spark, d, "id", "created_at"), "created_at", "id", 500).select("id", F.unix_micros("created_at").alias("at"))


@query(f"select id from {WM} order by created_at desc nulls last, id desc limit 100 offset 200")
def s3_page_by_offset(spark, d):
    return relational.newest(wm(spark, d, "id", "created_at"), "created_at", "id", 100, 200).select("id")


@query(f"select id from {WM} where created_at < timestamptz '2025-03-01 00:00:00+00' or (created_at = timestamptz '2025-03-01 00:00:00+00' and id < 'x') order by created_at desc nulls last, id desc limit 100")
def s4_page_by_key(spark, d):
    at = F.to_timestamp(F.lit("2025-03-01T00:00:00Z"))
    return relational.page_after(wm(spark, d, "id", "created_at"), "created_at", "id", at, "x", 100).select("id")


@query(f"with n as (select *, row_number() over (order by seen nulls first, event_id) as r from {ME} where seen > 1742000000000000 or (seen = 1742000000000000 and event_id > '8')) select event_id, seen, (select count(*) from n) > 1000 as has_more from n where r <= 1000")
def s5_pull_changes(spark, d):
    return relational.pull_changes(me(spark, d), "seen", "event_id", (1_742_000_000_000_000, "8"), 1000).select("event_id", "seen", "has_more")


# Predicates

_VALID = "valid_until is null or coalesce(try_cast(valid_until as timestamptz) > timestamptz '2024-01-01 00:00:00+00', false)"


@query(f"select id from {TR} where {_VALID}")
def op_p1_still_valid(spark, d):
    return tr(spark, d, "id", "valid_until").where(predicates.still_valid(F.col("valid_until"), 1_704_067_200_000_000)).select("id")


@query(f"select id from {WM} where session_id = 'sess-main-0001' or channel_id = 'chan-jogofu'")
def op_p3_session_scope(spark, d):
    return wm(spark, d, "id", "session_id", "channel_id").where(predicates.in_scope(F.col("session_id"), F.lit("session"), "sess-main-0001", F.col("channel_id"), "chan-jogofu")).select("id")


@query(f"select id from {WM} where author_type = 'human' and channel_id = 'chan-gizidi'")
def op_p4_identity(spark, d):
    return wm(spark, d, "id", "author_type", "channel_id", "author_id").where(predicates.equal_to(author_type="human", channel_id="chan-gizidi", author_id=None)).select("id")


@query(f"select id from {EM} where timestamp >= '2024-11-01T00:00:00' and timestamp <= '2024-12-31T23:59:59'")
def op_p5_date_range(spark, d):
    return em(spark, d, "id", "timestamp").where(predicates.between_dates(F.col("timestamp"), "2024-11-01", "2024-12-31")).select("id")


@query(f"select id from {WM} where source = 'insight' and veracity = 'stated'")
def op_p6_p7_source_and_veracity(spark, d):
    return wm(spark, d, "id", "source", "veracity").where(predicates.equal_to(source="insight", veracity="stated")).select("id")


@query(f"select id from {WM} where source is null or source not in ('conversation', 'honcho_message')")
def op_p8_dense_sources(spark, d):
    return wm(spark, d, "id", "source").where(predicates.dense_eligible(F.col("source"))).select("id")


@query("select distinct e.id from episodic_memory e where exists (select 1 from working_memory w where w.session_id = e.session_id and w.source = 'insight')")
def op_p9_semijoin(spark, d):
    some = wm(spark, d).where("source = 'insight'").select("session_id")
    return em(spark, d).join(some, "session_id", "left_semi").select("id").distinct()


@query(f"select id from {WM} where contains(lower(content), 'vector index') or contains(lower(source), 'vector index')")
def op_p10_substring(spark, d):
    return wm(spark, d).where(predicates.contains_any([F.col("content"), F.col("source")], "Vector Index")).select("id").distinct()


@query(f"select id from {TR} where lower(subject) = 'agent:demutino' or lower(predicate) = 'prefers'")
def op_p11_nocase(spark, d):
    return tr(spark, d, "id", "subject", "predicate").where(predicates.same_nocase(F.col("subject"), "Agent:Demutino") | predicates.same_nocase(F.col("predicate"), "PREFERS")).select("id")


@query(f"select a.event_id, b.event_id as parent_id from {ME} a join {ME} b on b.memory_id = a.memory_id and list_contains(cast(json(a.parent_event_ids) as varchar[]), b.event_id)")
def op_p12_json_member(spark, d):
    e = me(spark, d, "memory_id", "parent_event_ids")
    b = e.select("memory_id", F.col("event_id").alias("parent_id"))
    return e.join(b, "memory_id").where(predicates.json_member(F.col("parent_event_ids"), F.col("parent_id"))).select("event_id", "parent_id")


@query(f"select e.id as summary_id, x.w as id from (select id, unnest(string_split(summary_of, ',')) as w from {EM}) x join {EM} e using (id) semi join working_memory on working_memory.id = x.w")
def op_p13_csv_member(spark, d):
    links = em(spark, d, "id", "summary_of").select(F.col("id").alias("summary_id"), F.explode(F.split("summary_of", ",")).alias("id"))
    return links.join(table(spark, d, "working_memory"), "id", "left_semi").select("summary_id", "id")


@query(f"select w.id from (select distinct id, importance, created_at from working_memory) w left join (select c, max(created_at) as done_at from (select unnest(string_split(summary_of, ',')) as c, created_at from episodic_memory) group by c) e on e.c = w.id where done_at is null and w.created_at < timestamptz '2025-01-01 00:00:00+00' and coalesce(importance < 0.9, true)")
def op_p14_due_for_sleep(spark, d):
    """Rows that are old enough, in no summary yet (the latest summary's time stands for the mark) and not pinned, as the most important are."""
    done = em(spark, d, "summary_of", "created_at").select(F.explode(F.split("summary_of", ",")).alias("c"), "created_at").groupBy("c").agg(F.max("created_at").alias("consolidated_at"))
    w = wm(spark, d, "id", "importance", "created_at").join(done, F.col("id") == F.col("c"), "left")
    due = predicates.due_for_consolidation(F.col("importance") >= 0.9, F.col("consolidated_at"), F.unix_micros("created_at"), 1_735_689_600_000_000)
    return w.where(due).select("id")


@query(f"select id, left(content, 60) as preview from {EM}")
def op_p16_preview(spark, d):
    return em(spark, d).select("id", predicates.preview(F.col("content"), 60).alias("preview")).distinct()


@query(f"select id, content, importance from {WM}")
def op_p18_allowed_columns(spark, d):
    return predicates.allowed_columns(wm(spark, d), ["id", "content", "importance", "no_such_column"]).distinct()


# Joins


@query("select w.id, m.importance as older from (select distinct id, session_id from working_memory) w join (select session_id, max(importance) as importance from memories group by session_id) m using (session_id)")
def j1_j2_inner(spark, d):
    m = table(spark, d, "memories").groupBy("session_id").agg(F.max("importance").alias("older"))
    return wm(spark, d).select("id", "session_id").distinct().join(m, "session_id").select("id", "older")


@query(f"select distinct memory_id from {ME} where memory_id is not null and memory_id not in (select id from working_memory where id is not null)")
def j4_j5_orphans(spark, d):
    return relational.missing_from(table(spark, d, "memory_events").where("memory_id is not null").select("memory_id").distinct(), wm(spark, d), "memory_id", "id")


@query(f"with c as (select distinct unnest(string_split(summary_of, ',')) as c from episodic_memory) select id from {WM} where source = 'conversation' and id not in (select c from c where c is not null)")
def j6_l10_unsummarised(spark, d):
    return lifecycle.unsummarised(wm(spark, d, "id", "source"), em(spark, d), F.col("source") == "conversation").select("id")


@query(f"select distinct a.event_id from {ME} a where a.operation = 'UPDATE' and not exists (select 1 from memory_events b where b.memory_id = a.memory_id and b.operation = 'DELETE')")
def j9_outbox(spark, d):
    e = me(spark, d, "memory_id", "operation")
    return relational.missing_from(e.where("operation = 'UPDATE' and memory_id is not null").select("event_id", "memory_id"), e.where("operation = 'DELETE'"), "memory_id", "memory_id").select("event_id").distinct()


_TRC = "(select lower(trim(subject)) as subject, predicate, object, max(coalesce(confidence, 0.0)) as confidence from triples group by all)"


@query(f"select subject, predicate, arg_max(object, (confidence, object)) as winner, max(confidence) as winner_confidence, count(distinct object)::bigint - 1 as n_rivals from {_TRC} where object is not null group by subject, predicate having count(distinct object) > 1")
def j11_contradictions(spark, d):
    t = tr(spark, d).where("object is not null").groupBy(F.lower(F.trim("subject")).alias("subject"), "predicate", "object").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return facts.contradictions(t, "subject", "predicate", "object", "confidence")


_SV = "(select distinct subject, object from triples where subject is not null and object is not null)"


@query(f"""with l as (select *, row_number() over (partition by object order by subject) as n from {_SV}),
p as (select a.subject as src, b.subject as dst, row_number() over (partition by a.subject, a.object order by b.n) as r from {_SV} a join l b using (object) where b.n <= 6 and a.subject <> b.subject)
select distinct src, dst from p where r <= 5""")
def j12_g21_shared_values(spark, d):
    return graph.shared_values(tr(spark, d, "subject", "object"), "subject", "object").select("src", "dst")


@query(f"select a.memory_id, a.event_id, count(distinct b.event_id)::bigint as n_concurrent from {ME} a join {ME} b on a.memory_id = b.memory_id and abs(a.seen - b.seen) <= 600000000 and a.event_id <> b.event_id group by all")
def j15_t10_concurrent(spark, d):
    e = me(spark, d, "memory_id").where("seen is not null")
    return sync.concurrent(e, e, "memory_id", "seen", "event_id", 600_000_000)


_FROM = duck_instant("select id, subject, predicate, object, valid_until, valid_from as t, 'UTC' as zone, null::varchar as locale from triples")
_UNTIL = duck_instant("select id, valid_until as t, 'UTC' as zone, null::varchar as locale from triples")
# Triples whose start states an instant; an end that states none, or none at all, is open.
_TRI = f"(select distinct f.id, lower(trim(subject)) as subject, predicate, object, f.us as valid_from, u.us as valid_until from ({_FROM}) f join (select id, any_value(us) as us from ({_UNTIL}) group by id) u using (id) where f.us is not null)"
JUNE_US = 1_686_787_200_000_000


def _dated(spark, d, *columns: str):
    """Triples with their instants in place of the texts, whatever form these have."""
    t = tr(tuned(spark), d, "id", "valid_from", "valid_until", *columns)
    utc, undeclared = F.lit("UTC"), F.lit(None).cast("string")
    t = with_instant(with_instant(t, "valid_from", utc, undeclared, "start_us"), "valid_until", utc, undeclared, "end_us").where("start_us is not null")
    return t.drop("valid_from", "valid_until").withColumnsRenamed({"start_us": "valid_from", "end_us": "valid_until"})


@query(f"select id from {_TRI} where valid_from <= {JUNE_US} and (valid_until is null or valid_until > {JUNE_US})")
def j16_as_of(spark, d):
    return history.as_of(_dated(spark, d), JUNE_US, "valid_from", "valid_until").select("id")


@query(f"select id, case coalesce(lower(trim(veracity)), '') when 'stated' then 1.0::double when 'inferred' then 0.7::double when 'imported' then 0.6::double when 'tool' then 0.5::double else 0.8::double end as weight from {WM}")
def j20_f23_trust_weight(spark, d):
    return wm(spark, d, "id", "veracity").select("id", decay.veracity_weight(F.col("veracity")).alias("weight"))


@query("select coalesce(a.session_id, b.session_id) as session_id, a.n as n_working, b.n as n_episodic from (select session_id, count(distinct id)::bigint as n from working_memory group by 1) a full join (select session_id, count(distinct id)::bigint as n from episodic_memory group by 1) b on a.session_id = b.session_id")
def j21_full_outer(spark, d):
    count = lambda df, name: df.groupBy("session_id").agg(F.count_distinct("id").alias(name))
    return count(table(spark, d, "working_memory"), "n_working").join(count(table(spark, d, "episodic_memory"), "n_episodic"), "session_id", "full_outer")


# Aggregates


@query(f"select count(*)::bigint as n, count(*) filter (importance >= 0.5)::bigint as n_important, count(distinct session_id)::bigint as n_sessions, epoch_us(max(created_at)) as latest_us from {WM}")
def a1_a4_a11_counts(spark, d):
    return wm(spark, d, "id", "importance", "session_id", "created_at").agg(F.count("*").alias("n"), F.count_if(F.col("importance") >= 0.5).alias("n_important"), F.count_distinct("session_id").alias("n_sessions"), F.unix_micros(F.max("created_at")).alias("latest_us"))


@query(f"select source, count(*)::bigint as n from {WM} group by source")
def a5_by_source(spark, d):
    return wm(spark, d, "id", "source").groupBy("source").agg(F.count("*").alias("n"))


@query(f"select session_id, count(*)::bigint as n, epoch_us(min(created_at)) as first_us from {WM} group by session_id")
def a6_sessions(spark, d):
    return wm(spark, d, "id", "session_id", "created_at").groupBy("session_id").agg(F.count("*").alias("n"), F.unix_micros(F.min("created_at")).alias("first_us"))


@query(f"select predicate, object, count(*)::bigint as n, max(id) as last_id from {TR} group by all having count(*) > 1")
def a7_having(spark, d):
    return tr(spark, d, "id", "predicate", "object").groupBy("predicate", "object").agg(F.count("*").alias("n"), F.max("id").alias("last_id")).where("n > 1")


@query("select min(id) as id, subject, predicate, object from triples group by subject, predicate, object")
def a8_first_of_duplicates(spark, d):
    return table(spark, d, "triples").groupBy("subject", "predicate", "object").agg(F.min("id").alias("id"))


@query(f"select predicate, round(avg(confidence), 6) as confidence, round(sum(confidence), 4) as total from {TR} group by predicate")
def a9_a10_averages(spark, d):
    return tr(spark, d, "id", "predicate", "confidence").groupBy("predicate").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.sum("confidence"), 4).alias("total"))


@query("select 'working_memory' as name, count(*)::bigint as n from working_memory union all select 'episodic_memory', count(*) from episodic_memory union all select 'triples', count(*) from triples union all select 'memory_events', count(*) from memory_events")
def a12_cardinalities(spark, d):
    out = None
    for name in ("working_memory", "episodic_memory", "triples", "memory_events"):
        one = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with c as (select session_id, case when veracity in ('stated','unknown','inferred','imported','tool') then veracity else 'unknown' end as label, count(*)::bigint as n from {WM} group by all),
r as (select *, row_number() over (partition by session_id order by (label = 'unknown')::int, n desc, case label when 'stated' then 1.0 when 'inferred' then 0.7 when 'imported' then 0.6 when 'tool' then 0.5 else 0.8 end, label) as k from c)
select session_id, label, n from r where k = 1""")
def a13_majority(spark, d):
    return facts.majority_label(wm(spark, d, "id", "session_id", "veracity"), "session_id", "veracity")


@query("select session_id, k as chunk, string_agg(id, ' | ' order by created_at nulls first, id) as members from (select *, (row_number() over (partition by session_id order by created_at nulls first, id) - 1) // 1000 as k from (select distinct id, session_id, created_at from episodic_memory)) group by session_id, k")
def a15_ordered_text_all(spark, d):
    chunks = relational.ordered_chunks(em(spark, d, "id", "session_id", "created_at"), "session_id", "created_at", "id")
    return chunks.select("session_id", "chunk", F.array_join(F.transform("rows", lambda x: x["id"]), " | ").alias("members"))


_W = "case coalesce(lower(trim(source)), '') when 'stated' then 1.0 when 'inferred' then 0.7 when 'imported' then 0.6 when 'tool' then 0.5 else 0.8 end"


@query(f"""with m as (select subject, predicate, object, {_W} as w, row_number() over (partition by subject, predicate, object order by id) as n from {TR})
select subject, predicate, object, count(*)::bigint as mention_count, round(1 - (1 - 0.5 * arg_min(w, n)) * coalesce(product(1 - 0.3 * w) filter (n > 1), 1), 6) as confidence from m group by all""")
def a16_g22_consolidate(spark, d):
    m = tr(spark, d, "id", "subject", "predicate", "object", "source").withColumn("veracity", F.col("source"))
    return facts.consolidate(m, ["subject", "predicate", "object"], ["id"]).withColumn("confidence", F.round("confidence", 6))


@query("select dayofweek(created_at)::bigint as weekday, count(*)::bigint as n from (select distinct id, created_at from working_memory) group by 1")
def a17_f39_weekdays(spark, d):
    return table(spark, d, "working_memory").select("id", "created_at").distinct().groupBy((F.dayofweek("created_at") - 1).cast("bigint").alias("weekday")).agg(F.count("*").alias("n"))


# Windows

@query(f"select id, coalesce(valid_until, lead(valid_from) over (partition by subject, predicate order by id)) as valid_until from {_TRI}")
def w7_supersession(spark, d):
    t = _dated(spark, d, "subject", "predicate").withColumn("subject", F.lower(F.trim("subject")))
    return history.close_superseded(t, ["subject", "predicate"], ["id"], "valid_from", "valid_until").select("id", "valid_until")


@query(f"""with c as (select *, lag(object) over w as before, row_number() over w as n from {_TRI} window w as (partition by subject, predicate order by valid_from, id)),
k as (select * from c where n = 1 or object is distinct from before)
select subject, predicate, object, row_number() over w as version, before as previous, valid_from, lead(valid_from) over w as valid_until from k window w as (partition by subject, predicate order by valid_from, id)""")
def w5_w6_versions(spark, d):
    t = _dated(spark, d, "subject", "predicate", "object").withColumn("subject", F.lower(F.trim("subject")))
    return history.versions(t, ["subject", "predicate"], "object", ["valid_from", "id"], "valid_from", 86_400_000_000)


@query("select subject, predicate, k as chunk, string_agg(object, ' -> ' order by id) as evolution, count(*)::bigint as n from (select *, (row_number() over (partition by subject, predicate order by id) - 1) // 1000 as k from (select distinct id, lower(trim(subject)) as subject, predicate, object from triples where object is not null)) group by subject, predicate, k")
def w8_evolution_all(spark, d):
    """How every slot's value changed, a thousand values to a text, so that a slot of many is not one row."""
    t = tr(spark, d, "id", "subject", "predicate", "object").where("object is not null").withColumn("subject", F.lower(F.trim("subject")))
    return history.evolution_chunks(t, ["subject", "predicate"], "object", "id")


@query(f"select event_id from (select event_id, row_number() over (partition by memory_id order by seen desc nulls last, event_id desc) as n from {ME}) where n <= 3")
def w9_latest_three(spark, d):
    return relational.latest_per_key(me(spark, d, "memory_id"), ["memory_id"], [F.desc_nulls_last("seen"), F.desc("event_id")], 3).select("event_id")


@query(f"select id, session_id from (select *, row_number() over (partition by session_id order by importance desc nulls last, id) as n from {WM}) where n = 1")
def w10_best_per_topic(spark, d):
    return relational.latest_per_key(wm(spark, d, "id", "session_id", "importance"), ["session_id"], [F.desc_nulls_last("importance"), F.col("id")]).select("id", "session_id")


@query(f"select id from (select id, created_at, row_number() over (partition by session_id order by created_at desc nulls last, id desc) as n from {WM}) where n > 20 or {US} < {REF_US} - {180 * 86_400_000_000}")
def w11_l11_trim(spark, d):
    return lifecycle.trimmed(wm(spark, d, "id", "session_id", "created_at"), "session_id", "created_at", 20, REF_US, 180 * 86_400_000_000).select("id")


@query(f"select before, after, count(*)::bigint as n from (select source as before, lead(source) over (partition by session_id order by created_at nulls first, id) as after from {WM}) where before is not null and after is not null group by all")
def w12_transitions(spark, d):
    return sync.transitions(wm(spark, d, "id", "session_id", "created_at", "source"), "session_id", ["created_at", "id"], "source")


@query(f"select id, used from (select id, sum(length(content)) over (partition by session_id order by id rows unbounded preceding)::bigint as used from {WM}) where used <= 1000")
def w13_budget(spark, d):
    return lifecycle.within_budget(wm(spark, d).select("id", "session_id", F.length("content").alias("size")).distinct(), "session_id", "id", F.col("size"), 1000).select("id", "used")


@query(f"select memory_id, arg_max(event_id, (seen, coalesce(importance, 0), device_id, event_id)) as event_id, max(seen) as seen from {ME} where memory_id is not null and seen is not null group by memory_id")
def w14_t8_winners(spark, d):
    return sync.winners(me(spark, d, "memory_id", "device_id", "importance").where("seen is not null"), "memory_id", "seen", "importance", "device_id", "event_id")


# Top k


@query(f"select id, importance from {WM} where importance is not null order by importance desc, id limit 50")
def k1_k10_top(spark, d):
    return wm(spark, d, "id", "importance").where("importance is not null").orderBy(F.desc("importance"), "id").limit(50).select("id", "importance")


_NORM = "sqrt(list_sum(list_transform({0}::double[], lambda x: x * x)))"
_COS = "round(list_dot_product(q.embedding::double[], v.embedding::double[]) / (" + _NORM.format("q.embedding") + " * " + _NORM.format("v.embedding") + "), 9)"


@query(f"""with p as (select q.vec_id as query_id, v.vec_id as id, {_COS} as score from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from p) select query_id, id, round(score, 6) as score, rank from r where rank <= 10""")
def k3_r9_vector_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.vector_topk(v, v.where("id % 100 = 0"), 10, 64).withColumn("score", F.round("score", 6))


@query(f"""with b as (select *, case when importance > 0.7 then 0 when importance >= 0.3 then 1 else 2 end as band from {WM} where importance is not null),
n as (select *, row_number() over (partition by session_id, band order by importance desc, id) as k from b)
select id, band, row_number() over (partition by session_id order by band, k) as position from n where k <= case band when 1 then 5 else 3 end""")
def k9_sandwich(spark, d):
    return lifecycle.sandwich(wm(spark, d, "id", "session_id", "importance").where("importance is not null"), "session_id", "importance").select("id", "band", "position")


@query(f"select id from {WM} where session_id = 'sess-main-0001' or source = 'insight' order by (source <> 'insight')::int, importance desc nulls last, created_at desc nulls last, id limit 100")
def k8_l12_context(spark, d):
    w = wm(spark, d, "id", "session_id", "source", "importance", "created_at").withColumn("scope", F.when(F.col("source") == "insight", "global").otherwise("session"))
    return lifecycle.context(w, "sess-main-0001", 100).select("id")


# Set operations


@query(f"select id, 'working' as tier, importance from {WM} union all select id, 'episodic', importance from {EM}")
def u1_tiers(spark, d):
    pick = lambda df, t: df.select("id", F.lit(t).alias("tier"), "importance")
    return pick(wm(spark, d, "id", "importance"), "working").unionByName(pick(em(spark, d, "id", "importance"), "episodic"))


@query("select distinct subject, predicate, object from triples")
def u5_g14_insert_or_ignore(spark, d):
    t = table(spark, d, "triples").select("subject", "predicate", "object")
    none = t.limit(0)
    return relational.insert_or_ignore(none, t, ["subject", "predicate", "object"])


@query(f"""select session_id, content, min(id) as id, max(importance) as importance, coalesce(arg_max(veracity, (coalesce(created_at, timestamptz '1900-01-01'), id)) filter (veracity <> 'unknown'), 'unknown') as veracity, count(*)::bigint as n_copies
from {WM} group by session_id, content""")
def u8_merge_duplicates(spark, d):
    return relational.merge_duplicates(wm(spark, d, "id", "session_id", "content", "importance", "veracity", "created_at"), ["session_id", "content"]).drop("created_at")


@query("""with a as (select id, any_value(content) as content, max(importance) as importance from memories group by id), b as (select id, any_value(content) as content, max(importance) as importance from working_memory group by id)
select coalesce(a.id, b.id) as id, coalesce(b.importance, a.importance) as importance, case when a.id is null then 'inserted' when b.id is null then 'kept' else 'updated' end as action from a full join b on a.id = b.id""")
def u10_t5_apply_delta(spark, d):
    one = lambda n: table(spark, d, n).groupBy("id").agg(F.max("importance").alias("importance"))
    return relational.upsert(one("memories"), one("working_memory"), "id", ["importance"])


@query("""with a as (select id, max(importance) as i from working_memory group by id), b as (select id, max(importance) as i from memories group by id)
select b.id, case when a.id is null then 'insert' when a.i is not distinct from b.i then 'skip' else 'conflict' end as outcome from b left join a on a.id = b.id""")
def u9_import_outcomes(spark, d):
    one = lambda n: table(spark, d, n).groupBy("id").agg(F.max("importance").alias("i"))
    return relational.merge_compare(one("working_memory"), one("memories"), "id")


@query("select distinct object from triples where predicate = 'prefers'")
def u11_distinct_values(spark, d):
    return table(spark, d, "triples").where("predicate = 'prefers'").select("object").distinct()


# Retrieval

_TOK = r"[\p{L}\p{N}][\p{L}\p{N}_]*(?:[_.:/+-]+[\p{L}\p{N}][\p{L}\p{N}_]*)*"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOKENS = rf"list_filter(regexp_extract_all(lower(content), '{_TOK}'), lambda x: length(x) >= 3 and not list_contains([{_STOP}], x) and not regexp_matches(x, '^\p{{N}}+$'))"
ASKED = {"q1": "vector index on the office server", "q2": "who reviewed the grocery list on Monday", "q3": "copie de secours du service du soir"}
_ASKED = " union all ".join(f"select '{q}' as query_id, '{t}' as term" for q, text in ASKED.items() for t in retrieval.query_tokens(text))
_BM25 = f"""with t as (select id, {_TOKENS} as t from {EM} where content is not null), s as (select count(*) as n, avg(len(t)) as avg from t),
p as (select id, len(t) as dl, unnest(t) as term from t), tf as (select id, dl, term, count(*) as tf from p where term in (select term from ({_ASKED})) group by all),
df as (select term, count(*) as df from tf group by term),
c as (select query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg))) as score from tf join df using (term) join ({_ASKED}) using (term), s group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from c)"""


def _bm25(spark, d, k=None):
    return retrieval.bm25(em(spark, d), ASKED, k)


@query(_BM25 + "select query_id, id, round(score, 6) as score, rank from r where rank <= 20")
def r1_r2_text_search(spark, d):
    return _bm25(spark, d, 20).withColumn("score", F.round("score", 6))


@query(_BM25 + "select query_id, id, round((score - mn) / case when mx > mn then mx - mn else 1 end, 6) as norm from (select *, min(score) over (partition by query_id) as mn, max(score) over (partition by query_id) as mx from r where rank <= 50)")
def w1_normalised_scores(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id")
    s = _bm25(spark, d, 50)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return s.select("query_id", "id", F.round((F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0), 6).alias("norm"))


@query(_BM25 + f""", i as (select query_id, id, row_number() over (partition by query_id order by importance desc, id) as rank from (select distinct query_id, r.id, coalesce(importance, 0) as importance from r join {EM} e on e.id = r.id))
select query_id, id, round(sum(1.0 / (60 + rank)), 9) as score from (select query_id, id, rank from r union all select query_id, id, rank from i) group by all""")
def r24_w3_fusion(spark, d):
    text = _bm25(spark, d)
    e = em(spark, d, "id", "importance").select("id", F.coalesce("importance", F.lit(0.0)).alias("score"))
    by_importance = retrieval.ranked(text.select("query_id", "id").join(e, "id").distinct())
    return retrieval.reciprocal_ranks([text, by_importance]).withColumn("score", F.round("score", 9))


@query()
def r13_linear_recall(spark, d):
    rows = wm(spark, d, "id", "content", "importance", "veracity", "created_at").select("id", "content", "importance", "veracity", F.unix_micros("created_at").alias("created_us"))
    scored = retrieval.linear_working(rows, "shared grocery list on the kitchen tablet", REF_US, temporal_weight=0.2)
    return retrieval.ranked(scored.withColumn("query_id", F.lit("q")), 40).select("query_id", "id", "score", "rank")


@query()
def k6_mmr(spark, d):
    hits = _bm25(spark, d, 20).drop("rank").join(em(spark, d, "id", "content"), "id")
    return retrieval.mmr(hits, 10)


@query()
def k7_diverse(spark, d):
    hits = _bm25(spark, d).drop("rank").join(em(spark, d, "id", "content"), "id")
    return retrieval.diverse(hits, 10)


@query(f"select id, coalesce(round(exp(-({REF_US} - {US}) / 3.6e9 / 168), 9), 0.5) as decay, case when created_at is null then 0 else round(exp(-greatest(0, ({REF_US} - {US}) / 3.6e9) / 24), 9) end as boost from {WM}")
def f7_f8_decay(spark, d):
    us = F.unix_micros("created_at")
    return wm(spark, d, "id", "created_at").select("id", F.round(decay.recency(us, REF_US), 9).alias("decay"), F.round(decay.temporal_boost(us, REF_US), 9).alias("boost"))


@query(f"select id, case when created_at is null then 0.5 else round(exp(-pow(greatest(0, ({REF_US} - {US}) / 3.6e9) / case source when 'fact' then 720 when 'preference' then 4380 when 'insight' then 168 else 168 end, case source when 'fact' then 0.8 when 'preference' then 0.4 else 1.0 end)), 9) end as w from {WM}")
def r23_weibull(spark, d):
    return wm(spark, d, "id", "created_at", "source").select("id", F.round(decay.weibull(F.unix_micros("created_at"), REF_US, F.when(F.col("source").isin("fact", "preference"), F.col("source")).otherwise("general")), 9).alias("w"))


@query(f"select doc_id, len(t)::bigint as n_tokens, list_aggregate(list_sort(list_distinct(t)), 'string_agg', ' ') as tokens from (select doc_id, {_TOKENS.replace('content', 'text')} as t from documents where text is not null) where len(t) > 0")
def f1_tokens(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", X.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("tokens"))


_HAMMING = """with h as (select q.vec_id as query_id, v.vec_id as id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: case when (z[1] > 0) <> (z[2] > 0) then 1 else 0 end))::bigint as distance from embeddings q join embeddings v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by distance, id)::int as rank from h)"""


def _hamming(spark, d, k):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.hamming_topk(v, v.where("id % 100 = 0"), k, 64)


@query(f"{_HAMMING} select query_id, id, distance, rank from r where rank <= 10")
def k4_hamming_topk(spark, d):
    return _hamming(spark, d, 10)


@query("select vec_id, list_sum(list_transform(embedding, lambda x: greatest(-127, least(127, round(x::double * 127)::int))))::bigint as total from embeddings")
def f15_int8(spark, d):
    q = vectors.int8(F.col("embedding").cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", F.aggregate(q, F.lit(0), lambda s, x: s + x).cast("bigint").alias("total"))


_HAS = lambda items: " or ".join(f"contains(low, '{x}')" for x in items)


@query(f"""select id, case when low = '' then 1.0::double else case when source in ('heartbeat','cron','debug','terminal') then greatest(held, 0.7) else held end end::double as score from (
select *, case when ({_HAS(X.VALUABLE)}) then least(rise, 0.3) else rise end as held from (
select *, greatest(case when length(low) < 15 and low in ({", ".join(f"'{x}'" for x in X.TRIVIAL)}) then 0.7 else 0 end, case when {_HAS(X.TERMINAL)} then 0.85 else 0 end, case when contains(low, 'traceback') then 0.85 else 0 end, case when importance < 0.2 then 0.5 else 0 end) as rise
from (select *, lower(trim(content)) as low from {WM} where content is not null)))""")
def f27_l15_noise(spark, d):
    w = wm(spark, d).where("content is not null")
    return w.select("id", X.noise_score(F.col("content"), F.col("importance"), F.col("source")).alias("score")).distinct()


@query("select id, length(content)::bigint as n, ceil(length(content) / 4.0)::bigint as tokens from (select distinct id, content from episodic_memory)")
def f33_token_estimate(spark, d):
    return table(spark, d, "episodic_memory").select("id", "content").distinct().select("id", F.length("content").cast("bigint").alias("n"), X.token_estimate(F.col("content")).alias("tokens"))


@query("select id, left(sha256(id || '|' || coalesce(content, '')), 16) as hash from (select distinct id, content from working_memory)")
def f34_content_id(spark, d):
    return table(spark, d, "working_memory").select("id", "content").distinct().select("id", X.content_id(F.col("id"), F.coalesce("content", F.lit(""))).alias("hash"))


# Graph and lifecycle

_EDGES = "(select distinct lower(trim(subject)) as src, object as dst, coalesce(confidence, 0.5) as weight from triples where subject is not null and object is not null)"


def _edges(spark, d):
    return table(spark, d, "triples").where("subject is not null and object is not null").select(F.lower(F.trim("subject")).alias("src"), F.col("object").alias("dst"), F.coalesce("confidence", F.lit(0.5)).alias("weight")).distinct()


_BOTH = f"(select distinct src, dst from (select src, dst, weight from {_EDGES} union all select dst, src, weight from {_EDGES}) where weight >= 0.9)"


@query(f"""with s as (select distinct lower(trim(subject)) as seed from triples where lower(trim(subject)) like 'agent:%'), h1 as (select distinct seed, dst as node from s join {_BOTH} b on b.src = seed),
h2 as (select distinct seed, b.dst as node from h1 join {_BOTH} b on b.src = h1.node where b.dst <> seed)
select seed, node, min(hops)::bigint as hops from (select seed, node, 1 as hops from h1 union all select seed, node, 2 from h2) where node <> seed group by all""")
def g18_j17_reachable_agents(spark, d):
    e = _edges(spark, d)
    seeds = e.where("src like 'agent:%'").select(F.col("src").alias("node")).distinct()
    return graph.reachable(e, seeds, 2, 0.9).withColumn("hops", F.col("hops").cast("bigint"))


@query(f"select src as node, count(*)::bigint as degree, least(count(*) * 0.02, 0.08)::double as graph_bonus from (select distinct src, dst from (select src, dst from {_EDGES} union all select dst, src from {_EDGES})) group by src")
def r16_g19_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"select id, (case when coalesce(tier, 1) = 1 and {REF_US} - {US} > {30 * 86_400_000_000} then 2 when tier = 2 and {REF_US} - {US} > {180 * 86_400_000_000} then 3 else coalesce(tier, 1) end)::int as tier from {EM}")
def l9_degrade(spark, d):
    return em(spark, d, "id", "tier", "created_at").select("id", lifecycle.degraded_tier(F.col("tier"), F.unix_micros("created_at"), REF_US).cast("int").alias("tier"))


@query(f"select session_id, source, count(*)::bigint as n, epoch_us(min(created_at)) as first_us, epoch_us(max(created_at)) as last_us, case when count(importance) > 0 then round(sum(importance::decimal(18,9))::double / count(importance), 6) end as importance, sum(('0x' || left(md5(id), 8))::bigint)::bigint as member_hash from {WM} where created_at < timestamptz '2025-05-01 00:00:00+00' group by session_id, source")
def l5_l6_sleep_groups(spark, d):
    g = lifecycle.sleep_groups(wm(spark, d, "id", "session_id", "source", "created_at", "importance").where(F.col("created_at") < F.to_timestamp(F.lit("2025-05-01T00:00:00Z"))), ["session_id", "source"], "created_at")
    return g.select("session_id", "source", "n", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), F.round("importance", 6).alias("importance"), "member_hash")


@query(f"select count(*)::bigint as n_runs, count(*) filter (event_type = 'error')::bigint as n_errors, round(({REF_US} - epoch_us(max(ts) filter (event_type <> 'error'))) / 3.6e9, 3) as hours_since_success, case when max(ts) filter (event_type <> 'error') is null then 'never' when ({REF_US} - epoch_us(max(ts) filter (event_type <> 'error'))) / 3.6e9 > 24 then 'stale' when count(*) filter (event_type = 'error') > 0 then 'degraded' else 'healthy' end as status from events")
def l13_health(spark, d):
    return lifecycle.health(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.col("event_type") == "error", REF_US)


# Sync


@query(f"with heads as (select * from {ME} where seen is not null and event_id not in (select unnest(cast(json(parent_event_ids) as varchar[])) from memory_events where parent_event_ids is not null)) select memory_id, arg_max(event_id, (seen, coalesce(importance, 0), device_id, event_id)) as event_id from heads where memory_id is not null group by memory_id")
def t9_chain_winners(spark, d):
    return sync.chain_winners(me(spark, d, "memory_id", "device_id", "importance", "parent_event_ids"), "memory_id", "seen", "importance", "device_id", "event_id", "parent_event_ids").select("memory_id", "event_id")


@query("""with a as (select id, any_value(content) as content, max(importance) as importance from memories group by id), b as (select id, any_value(content) as content, max(importance) as importance from working_memory group by id)
select coalesce(a.id, b.id) as id, case when a.id is null then 'CREATE' when b.id is null then 'DELETE' else 'UPDATE' end as operation from a full join b on a.id = b.id where a.id is null or b.id is null or a.importance is distinct from b.importance""")
def t12_mutations(spark, d):
    one = lambda n: table(spark, d, n).groupBy("id").agg(F.max("importance").alias("importance"))
    return sync.mutations(one("memories"), one("working_memory"), "id", ["importance"])


@query("select row_id, id from (select distinct row_id, id, created_at from episodic_memory) where row_id > 400 or created_at > timestamptz '2025-03-01 00:00:00+00'")
def t4_delta(spark, d):
    e = table(spark, d, "episodic_memory").select("row_id", "id", "created_at").distinct()
    return sync.delta(e, "row_id", "created_at", 400, F.to_timestamp(F.lit("2025-03-01T00:00:00Z"))).select("row_id", "id")


@query(f"select event_id from {ME} where operation in ('UPDATE', 'DELETE') order by seen desc nulls last, event_id desc limit 1000")
def t3_buffer(spark, d):
    return sync.last_n(me(spark, d, "operation"), "seen", "event_id", 1000, ["UPDATE", "DELETE"]).select("event_id")
