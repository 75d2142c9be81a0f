"""Queries p1, p2, p5 and p6 over the test tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.instants import with_instant
from palimpsest.operators.changes import present_state
from palimpsest.operators.intervals import OPEN_US, merge_intervals
from palimpsest.operators.late import count_state, period_counts, period_statistics
from palimpsest.operators.timestamps import normalise_timestamps
from palimpsest.session import tuned
from palimpsest.sources.tables import table, with_clock

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"
# From here on an end counts as open.
YEAR_9999_US = 253_370_764_800_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(tuned(spark), d, "triples").select(F.trim(F.lower("subject")).alias("subject"), "predicate", "valid_from", "valid_until")
    utc, undeclared = F.lit("UTC"), F.lit(None).cast("string")
    t = with_instant(t, "valid_from", utc, undeclared, "s")
    t = with_instant(t, "valid_until", utc, undeclared, "u")
    e = F.when(F.col("valid_until").isNull() | (F.col("u") >= YEAR_9999_US), F.lit(OPEN_US)).otherwise(F.col("u"))
    merged = merge_intervals(t.select("subject", "predicate", "s", e.alias("e")), ["subject", "predicate"], "s", "e")
    return merged.withColumn("end_us", F.when(F.col("end_us") >= OPEN_US, -1).otherwise(F.col("end_us")))


def _events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """memory_events with the declared instant of each copy."""
    t = table(tuned(spark), d, "memory_events").select("event_id", "device_id", "timestamp", *columns)
    t = with_clock(t, table(spark, d, "clocks"), "device_id")
    return with_instant(t, "timestamp", F.col("__zone"), F.col("__locale"), "instant_us").drop("__zone", "__locale", "timestamp")


def _value_counts(spark: SparkSession, d: str) -> DataFrame:
    """The value-count state of importance per device and hour, over distinct events."""
    e = _events(spark, d, "synced_at", "importance")
    e = e.groupBy("event_id", "device_id", "instant_us").agg(F.min(F.unix_micros("synced_at")).alias("arrived_us"), F.min("importance").alias("value"))
    return count_state(e.select(F.col("device_id").alias("key"), F.col("instant_us").alias("event_us"), "arrived_us", "value"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the same state that the medians, distinct counts and extremes come from."""
    return period_counts(_value_counts(spark, d)).where("n_final > n_first or n_dropped > 0").withColumnRenamed("key", "device_id")


def p2_corrected_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Of importance per device and hour: distinct values, extremes and median, as published and as corrected."""
    return period_statistics(_value_counts(spark, d)).withColumnRenamed("key", "device_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_present_state(spark, d).select("memory_id", "last_event_id", "content_event_id")


def p5_present_state(spark: SparkSession, d: str) -> DataFrame:
    """The whole present row of every live memory."""
    return present_state(_events(spark, d, "memory_id", "operation", "payload"))


def _instants(spark: SparkSession, d: str) -> DataFrame:
    """record_table, record_id, canonical, us, by_path of every record of the three tables, by the path over all readings.

    Where the clock declares its zone and locale their reading stands; records
    without a clock, and triples, declare nothing, so all their readings stay open.
    """
    spark = tuned(spark)
    parts = [
        ("working_memory", "id", "timestamp", "created_at", "channel_id"),
        ("memory_events", "event_id", "timestamp", "synced_at", "device_id"),
        ("triples", "id", "valid_from", "created_at", "source"),
    ]
    every = None
    for name, key, text, arrived, source in parts:
        clock = F.lit(None).cast("string") if name == "triples" else F.col(source)
        t = table(spark, d, name).where(F.col(key).isNotNull()).select(
            F.lit(name).alias("record_table"), F.col(key).cast("string").alias("id"), F.struct(F.unix_micros(arrived).alias("at"), F.col(text).alias("text"), F.col(source).alias("source"), clock.alias("clock")).alias("v")
        )
        every = t if every is None else every.unionByName(t)
    one = every.groupBy("record_table", "id").agg(F.min("v").alias("v"))
    one = one.select(
        F.concat_ws(":", "record_table", "id").alias("key"), "record_table", F.col("id").alias("record_id"), F.concat_ws(":", "record_table", "v.source").alias("source"),
        F.col("v.text").alias("text"), F.col("v.at").alias("arrived_us"), F.col("v.clock").alias("clock"), F.coalesce(F.col("v.text").rlike(CANONICAL), F.lit(False)).alias("canonical"),
    )
    one = with_clock(one, table(spark, d, "clocks"), "clock")
    return normalise_timestamps(one, F.col("__zone"), F.col("__locale"), ["record_table", "record_id", "canonical"], infer=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).where("not canonical and us is not null").select("record_table", "record_id", F.col("us").alias("utc_us"))


def p6_path_share(spark: SparkSession, d: str) -> DataFrame:
    """Per table the records that state an instant, and those of them whose reading only the path decides."""
    return _instants(spark, d).where("us is not null").groupBy("record_table").agg(F.count("*").alias("n"), F.count_if("by_path").alias("n_by_path"))


def duck_instant(relation: str) -> str:
    """Oracle SQL: relation(t, zone, locale, ...) with column us added, for the forms in the test tables."""
    clock = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
    zone = r"(Z|z|[A-Z]{3,4}|[+-]\d{2}:?\d{2})?(?:\[.+\])?"
    return rf"""
select * exclude (tt, iso, com, yl, nam, epo, k, local_ts, off, wall, u0), case
  when k = 'epoch' then case when length(epo.n) <= 11 then try_cast(epo.n as bigint) * 1000000 + coalesce(try_cast(rpad(epo.f, 6, '0')[:6] as bigint), 0)
       when length(epo.n) <= 14 then try_cast(epo.n as bigint) * 1000 else try_cast(epo.n as bigint) end
  when off is not null then epoch_us(local_ts) - off::bigint * 60000000
  when wall is null then null
  when timezone(zone, make_timestamptz(u0 - 3600000000)) = local_ts then u0 - 3600000000 else u0 end as us
from (select *, case when off is null then wall end as w2, epoch_us(timezone(zone, wall)) as u0 from (
select *, case when k = 'epoch' then null else local_ts end as wall,
  case when zz = '' then null when upper(zz) in ('Z', 'UTC', 'GMT') then 0 when upper(zz) = 'CET' then 60 when upper(zz) = 'CEST' then 120
       when upper(zz) = 'EST' then -300 when upper(zz) = 'EDT' then -240 when upper(zz) = 'PST' then -480 when upper(zz) = 'PDT' then -420
       when upper(zz) = 'JST' then 540 when upper(zz) = 'AEST' then 600 when upper(zz) = 'AEDT' then 660
       else (case when zz[1] = '-' then -1 else 1 end) * (try_cast(zz[2:3] as int) * 60 + try_cast(replace(zz, ':', '')[4:5] as int)) end as off
from (
select *, case k when 'iso' then iso.z when 'com' then com.z when 'yl' then '' when 'nam' then nam.z else '' end as zz,
  try_cast(case k
    when 'iso' then iso.y || '-' || iso.m || '-' || iso.d || ' ' || case when iso.h = '' then '00:00:00' else lpad(iso.h, 2, '0') || ':' || iso.mi || ':' || case when iso.s = '' then '00' else iso.s end || case when iso.f = '' then '' else '.' || iso.f[:6] end end
    when 'com' then com.y || '-' || com.m || '-' || com.d || ' ' || case when com.h = '' then '00:00:00' else com.h || ':' || com.mi || ':' || com.s end
    when 'yl' then yl.y || '-' || case when locale = 'en-US' then lpad(yl.a, 2, '0') || '-' || lpad(yl.b, 2, '0') else lpad(yl.b, 2, '0') || '-' || lpad(yl.a, 2, '0') end || ' ' ||
      case when yl.ap = '' then lpad(yl.h, 2, '0') else lpad(((try_cast(yl.h as int) % 12) + case when yl.ap = 'PM' then 12 else 0 end)::varchar, 2, '0') end || ':' || yl.mi || ':' || case when yl.s = '' then '00' else yl.s end
    when 'nam' then nam.y || '-' || case nam.mon when 'Jan' then '01' when 'Feb' then '02' when 'Mar' then '03' when 'Apr' then '04' when 'May' then '05' when 'Jun' then '06' when 'Jul' then '07' when 'Aug' then '08' when 'Sep' then '09' when 'Oct' then '10' when 'Nov' then '11' when 'Dec' then '12' end || '-' || lpad(nam.d, 2, '0') || ' ' || case when nam.h = '' then '00:00:00' else nam.h || ':' || nam.mi || ':' || nam.s end
    end as timestamp) as local_ts
from (
select *, case when iso.y <> '' then 'iso' when com.y <> '' then 'com' when epo.n <> '' then 'epoch' when yl.y <> '' then 'yl' when nam.y <> '' then 'nam' end as k
from (
select * replace (coalesce(zone, 'UTC') as zone), trim(t) as tt,
  regexp_extract(trim(t), '^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ]{clock}\s*{zone})?$', ['y','m','d','h','mi','s','f','z']) as iso,
  regexp_extract(trim(t), '^(\d{{4}})(\d{{2}})(\d{{2}})(?:T(\d{{2}})(\d{{2}})(\d{{2}})(Z))?$', ['y','m','d','h','mi','s','z']) as com,
  regexp_extract(trim(t), '^(\d+)(?:\.(\d+))?$', ['n','f']) as epo,
  regexp_extract(trim(t), '^(\d{{1,2}})[/.](\d{{1,2}})[/.](\d{{4}}),? {clock} ?(AM|PM)?$', ['a','b','y','h','mi','s','f','ap']) as yl,
  regexp_extract(trim(t), '^(?:[A-Z][a-z]+, )?(\d{{1,2}}) ([A-Z][a-z]+) (\d{{4}})(?: (\d{{2}}):(\d{{2}}):(\d{{2}}) ?{zone})?$', ['d','mon','y','h','mi','s','z']) as nam
from ({relation})))))) """


_EVENTS = duck_instant("select e.*, timestamp as t, zone_name as zone, locale from memory_events e left join clocks c on c.clock_id = e.device_id")
_ONE_EVENT = f"select event_id, any_value(device_id) as device_id, any_value(us) as us, min(epoch_us(synced_at)) as arrived, any_value(importance) as importance from ({_EVENTS}) group by event_id"

_P1 = f"""
with f as (select id, subject, predicate, valid_until, us as s from ({duck_instant("select *, valid_from as t, 'UTC' as zone, null::varchar as locale from triples")})),
u as (select id, us as e from ({duck_instant("select id, valid_until as t, 'UTC' as zone, null::varchar as locale from triples")}) group by all),
i as (select lower(trim(subject)) as subject, predicate, s, case when valid_until is null or e >= {YEAR_9999_US} then {OPEN_US} else e end as e from f join u using (id) where s is not null),
j as (select *, max(e) over (partition by subject, predicate order by s, e rows between unbounded preceding and 1 preceding) as m from i where e > s),
k as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by subject, predicate order by s, e rows unbounded preceding) as g from j),
p as (select subject, predicate, g, min(s) as s, max(e) as e from k group by subject, predicate, g)
select subject, predicate, 'period' as kind, s as start_us, case when e >= {OPEN_US} then -1 else e end as end_us from p
union all
select subject, predicate, 'gap', e, n from (select *, lead(s) over (partition by subject, predicate order by g) as n from p) where n is not null
"""

_P2_BASE = f"""
select device_id, us - us % 3600000000 as period_start_us, arrived - (us - us % 3600000000 + 3600000000) as delay, importance from ({_ONE_EVENT}) where us is not null and arrived is not null
"""
_P2 = f"""
select * from (select device_id, period_start_us, count(*) filter (delay <= 0)::bigint as n_first, count(*) filter (delay <= 86400000000)::bigint as n_final, count(*) filter (delay > 86400000000)::bigint as n_dropped
from ({_P2_BASE}) group by all) where n_final > n_first or n_dropped > 0
"""
_P2_STATS = f"""
select device_id, period_start_us, count(*) filter (delay <= 0)::bigint as n_first, count(*) filter (delay <= 86400000000)::bigint as n_final, count(*) filter (delay > 86400000000)::bigint as n_dropped,
""" + ", ".join(
    f"case when count(importance) > 0 then count(distinct importance) filter ({w})::bigint end as n_values_{n}, min(importance) filter ({w}) as min_{n}, max(importance) filter ({w}) as max_{n}, median(importance) filter ({w}) as median_{n}"
    for n, w in (("first", "delay <= 0"), ("final", "delay <= 86400000000"))
) + f" from ({_P2_BASE}) group by all"

_P5_BASE = f"""
with e0 as (select event_id, any_value(memory_id) as memory_id, any_value(operation) as op, any_value(device_id) as dev, any_value(us) as us, any_value(payload) as raw from ({_EVENTS}) group by event_id),
e1 as (select *, case when json_valid(raw) then case when json_type(raw) = 'VARCHAR' then json_extract_string(raw, '$') else raw end end as body from e0 where us is not null and memory_id is not null),
e2 as (select *, case when json_valid(body) then json_type(body) = 'OBJECT' else false end as readable from e1),
e3 as (select *, case when readable then json_extract_string(body, '$.content') end as content, case when readable then json_extract_string(body, '$.veracity') end as veracity,
  case when readable then json_extract_string(body, '$.source') end as source, case when readable then try_cast(json_extract_string(body, '$.importance') as double) end as importance,
  row_number() over (partition by memory_id order by us, dev nulls first, event_id) as n from e2 where op in ('DELETE', 'CONSOLIDATE') or coalesce(readable, false)),
e4 as (select *, max(case when op in ('CREATE', 'DELETE') then n end) over (partition by memory_id order by n) as b from e3),
e5 as (select *, max(b) over (partition by memory_id) as last_b from e4),
life as (select * from e5 where n >= last_b),
alive as (select memory_id from e5 where n = last_b and op = 'CREATE')
"""
_SET = "op in ('CREATE', 'UPDATE') and {0} is not null"
_P5 = _P5_BASE + f"select memory_id, arg_max(event_id, n) as last_event_id, arg_max(event_id, n) filter ({_SET.format('content')}) as content_event_id from life join alive using (memory_id) group by memory_id"
_P5_STATE = _P5_BASE + "select memory_id, arg_max(event_id, n) as last_event_id, arg_max(event_id, n) filter (" + _SET.format("content") + ") as content_event_id, bool_or(op = 'CONSOLIDATE') as consolidated, " + ", ".join(
    f"arg_max({c}, n) filter ({_SET.format(c)}) as {c}" for c in ("content", "importance", "veracity", "source")
) + " from life join alive using (memory_id) group by memory_id"

_P6 = "select record_table, record_id, us as utc_us from (" + " union all ".join(
    f"select '{name}' as record_table, id::varchar as record_id, us, t from ({duck_instant(rel)}) group by all"
    for name, rel in (
        ("working_memory", "select w.id, w.timestamp as t, zone_name as zone, locale from working_memory w left join clocks c on c.clock_id = w.channel_id"),
        ("memory_events", "select e.event_id as id, e.timestamp as t, zone_name as zone, locale from memory_events e left join clocks c on c.clock_id = e.device_id"),
        ("triples", "select id, valid_from as t, 'UTC' as zone, null::varchar as locale from triples"),
    )
) + r") where us is not null and not regexp_matches(t, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$')"

QUERIES = {
    "p1_found": (p1_found, _P1),
    "p2_found": (p2_found, _P2),
    "p2_corrected_statistics": (p2_corrected_statistics, _P2_STATS),
    "p5_found": (p5_found, _P5),
    "p5_present_state": (p5_present_state, _P5_STATE),
    "p6_found": (p6_found, _P6),
    "p6_path_share": (p6_path_share, None),
}
