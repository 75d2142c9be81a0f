"""Queries for sources and sinks, replication and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import media
from palimpsest.operators import relational, retrieval, sync
from palimpsest.plans.problems import _EVENTS, _events
from palimpsest.plans.reference import _BM25, _HAMMING, ASKED, ME, em, me, wm
from palimpsest.plans.words import duck
from palimpsest.session import shared_folder
from palimpsest.sources import files
from palimpsest.sources.tables import table
from palimpsest.streaming import events as streams

QUERIES: dict = {}


def query(sql: str | None = None):
    sql = duck(sql)

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# Files

_ONE = "(select id, any_value(content) as content, any_value(session_id) as session_id, max(importance) as importance, any_value(timestamp) as timestamp from memories group by id)"


def _older(spark, d):
    return table(spark, d, "memories").groupBy("id").agg(*[F.max(c).alias(c) for c in ("content", "session_id", "importance", "timestamp")])


@query(f"select id, content, session_id, importance from {_ONE}")
def s8_s9_json_round_trip(spark, d):
    """The older store exported as JSON and read again."""
    path = shared_folder(spark)
    files.export_json(_older(spark, d), path)
    return files.import_json(spark, path).where("unreadable is null").select("id", "content", "session_id", "importance")


@query(f"select case when left(id, 1) = '0' then 'unreadable' when content is null or trim(content) = '' then 'without content' when id in (select id from working_memory) then 'already there' else 'imported' end as outcome, count(*)::bigint as n from {_ONE} group by 1")
def s9_import_outcomes(spark, d):
    """What an import makes of every document, of which some are cut short."""
    path = shared_folder(spark)
    whole = F.to_json(F.struct("id", "content", "session_id", "importance"))
    _older(spark, d).select(F.when(F.substring("id", 1, 1) == "0", F.substring(whole, 1, 20)).otherwise(whole).alias("value")).write.text(path)
    return files.import_outcomes(files.import_json(spark, path), wm(spark, d, "id"))


_LAYOUTS = {
    "blocks": ("value", "agent_id", "created_at"), "graph": ("fact", "group_id", "valid_at"), "nodes": ("description", "dataset", "updated_at"), "peers": ("observation", "workspace_id", "created_at"),
    "notes": ("chunk", "containerTag", "createdAt"), "recollections": ("text", "bank_id", "occurred_at"),
}


@query(" union all ".join(f"select '{n}' as format, id, content, '{n}_import' as source, timestamp, session_id as channel_id, coalesce(importance, 0.5) as importance from {_ONE} where trim(content) <> ''" for n in _LAYOUTS))
def s10_s11_foreign_formats(spark, d):
    """Files in the layouts of other stores, each read as memory rows."""
    m, out = _older(spark, d), None
    for name, (content, channel, at) in _LAYOUTS.items():
        path = shared_folder(spark)
        files.export_json(m.select("id", F.col("content").alias(content), F.col("session_id").alias(channel), F.col("timestamp").alias(at), "importance"), path)
        one = files.normalise(spark.read.schema(f"id string, {content} string, {channel} string, {at} string, importance double").json(path), name).select(F.lit(name).alias("format"), "id", "content", "source", "timestamp", "channel_id", "importance")
        out = one if out is None else out.unionByName(one)
    return out


@query("select t.id, any_value(t.object) as content, string_agg(distinct lower(trim(s.subject)), ',' order by lower(trim(s.subject))) as entities from (select distinct id, object from triples where object is not null) t left join (select distinct object, subject from triples where predicate = 'owns' and subject is not null) s on s.object = t.object group by t.id")
def s11h_joined_import(spark, d):
    """A source of several tables: facts with the distinct entities that the joined table has for them."""
    t = table(spark, d, "triples")
    entities = t.where("predicate = 'owns' and subject is not null and object is not null").groupBy("object").agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("subject")))), ",").alias("entities"))
    return t.where("object is not null").groupBy("id").agg(F.max("object").alias("object")).join(entities, "object", "left").select("id", F.col("object").alias("content"), "entities")


@query("select count(*)::bigint as n_rows, true as verified, 2::int as n_kept from memories")
def s12_backup_rotation(spark, d):
    """Three snapshots of a table, the last one verified, all but two removed."""
    root, m = shared_folder(spark), table(spark, d, "memories")
    for name in ("20250101", "20250102", "20250103"):
        path = files.snapshot(m, root, name)
    same = files.verified(spark, m, path)
    kept = files.rotated(spark, root, 2)
    return spark.read.parquet(f"{root}/{kept[-1]}").agg(F.count("*").alias("n_rows"), F.lit(same).alias("verified"), F.lit(len(kept)).alias("n_kept"))


@query("select source as bank, count(*)::bigint as n_rows from working_memory where source is not null and regexp_matches(source, '^[A-Za-z0-9_-]{1,64}$') group by source")
def s13_x31_banks(spark, d):
    """Every source in a bank of its own, with the rows that each bank holds."""
    root = shared_folder(spark)
    files.write_banks(table(spark, d, "working_memory").where("source is not null").select("id", F.col("source").alias("bank")), root)
    return files.banks(spark, root)


_RAW = "(select distinct id, content from working_memory where content is not null and content <> '')"


@query(f"select sha256(content) as sha256, octet_length(encode(content))::bigint as size from {_RAW} where id < '8' group by content")
def s14_blob_sink(spark, d):
    """Bytes taken out of texts, each kept once by its hash."""
    rows = _with_data(spark, d)
    clean = rows.select("bytes", media.sanitised(F.col("told"))["sha256"].alias("sha256"))
    return files.blobs(clean, "bytes", "sha256").select("sha256", F.col("size").cast("bigint").alias("size"))


def _with_data(spark, d):
    w = wm(spark, d).where("content is not null and content != ''").select("id", "content")
    data = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("content", "UTF-8")))
    return w.select("id", F.encode("content", "UTF-8").alias("bytes"), F.when(F.col("id") < "8", data).otherwise(F.col("content")).alias("told"))


@query(f"select distinct id, octet_length(encode(content))::bigint as size, null::varchar as mime from {_RAW} where id < '8'")
def s17_resolved_blobs(spark, d):
    """References in texts resolved through the blob store."""
    rows = _with_data(spark, d)
    clean = rows.select("id", "bytes", media.sanitised(F.col("told")).alias("s")).where("s.reason is not null")
    refs = clean.select("id", F.regexp_extract("s.content", r"(blob://sha256/[0-9a-f]{64})", 1).alias("ref")).distinct()
    store = files.blobs(clean.select("bytes", F.col("s.sha256").alias("sha256")), "bytes", "sha256")
    return files.RESOLVERS["blob"](refs, store).select("id", F.col("size").cast("bigint").alias("size"), "mime")


@query("select md5(id || '|CREATE') as event_id, id as memory_id, 'CREATE' as operation from (select distinct id from working_memory where id is not null)")
def s15_appended_log(spark, d):
    """Events appended to a log; appending them again adds nothing."""
    new = table(spark, d, "working_memory").where("id is not null").select(F.md5(F.concat_ws("|", "id", F.lit("CREATE"))).alias("event_id"), F.col("id").alias("memory_id"), F.lit("CREATE").alias("operation"))
    log = relational.insert_or_ignore(new.limit(0), new, ["event_id"])
    return relational.insert_or_ignore(log, new, ["event_id"])


# Replication

_PUSH = f"(select event_id, any_value(memory_id) as memory_id, any_value(operation) as operation, any_value(us) as us, min(epoch_us(synced_at)) as arrived from ({_EVENTS}) group by event_id)"


@query(f"select case when memory_id is null then 'no memory' when operation is null or operation not in ('CREATE', 'UPDATE', 'DELETE', 'CONSOLIDATE') then 'unknown operation' when us is null then 'no instant' when us > arrived + 60000000 then 'from the future' else 'accepted' end as outcome, count(*)::bigint as n from {_PUSH} group by 1")
def t7_push_outcomes(spark, d):
    """What becomes of pushed events: each counted once, with a bound on clocks ahead."""
    e = _events(spark, d, "memory_id", "operation", "synced_at").groupBy("event_id").agg(F.min("memory_id").alias("memory_id"), F.min("operation").alias("operation"), F.min("instant_us").alias("instant_us"), F.min(F.unix_micros("synced_at")).alias("arrived_us"))
    return sync.push_outcomes(e, 60_000_000).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""with n as (select *, coalesce(abs(lag(seen) over w - seen) <= 600000000, false) or coalesce(abs(lead(seen) over w - seen) <= 600000000, false) as near from {ME} where memory_id is not null and seen is not null window w as (partition by memory_id order by seen, event_id))
select memory_id, count(*)::bigint as n_events, arg_max(event_id, (seen, coalesce(importance, 0), device_id, event_id)) as winner, case when count(distinct operation) = 1 then 'automatic' else 'manual' end as merge from n where near group by memory_id""")
def t11_merge_proposals(spark, d):
    return sync.proposals(me(spark, d, "memory_id", "operation", "importance", "device_id"), "memory_id", "seen", 600_000_000)


_ACKS = f"(select case when ('0x' || left(md5(event_id), 2))::int % 2 = 0 then 'east' else 'west' end as remote, event_id from {ME} where seen is not null)"
REMOTES = ["east", "west"]


def _acks(spark, d):
    half = F.conv(F.substring(F.md5("event_id"), 1, 2), 16, 10).cast("int") % 2
    return me(spark, d).where("seen is not null").select(F.when(half == 0, "east").otherwise("west").alias("remote"), "event_id")


@query(f"select r.remote, e.event_id from {ME} e, (select unnest(['east', 'west']) as remote) r where not exists (select 1 from {_ACKS} a where a.remote = r.remote and a.event_id = e.event_id)")
def j9_t13_outbox(spark, d):
    """What each remote has not acknowledged."""
    return sync.outbox(me(spark, d).select("event_id"), REMOTES, _acks(spark, d)).select("remote", "event_id")


@query(f"select a.remote, e.event_id, e.operation from {_ACKS} a join {ME} e using (event_id)")
def j10_acks_by_remote(spark, d):
    return sync.acknowledged(me(spark, d, "operation").select("event_id", "operation"), _acks(spark, d)).select("remote", "event_id", "operation")


@query(f"select remote, count(*)::bigint as n_acked, (select count(*) from {ME})::bigint - count(*)::bigint as n_waiting from {_ACKS} group by remote")
def t13_status(spark, d):
    acks = _acks(spark, d)
    acked = acks.groupBy("remote").agg(F.count("*").alias("n_acked"))
    waiting = sync.outbox(me(spark, d).select("event_id"), REMOTES, acks).groupBy("remote").agg(F.count("*").alias("n_waiting"))
    return acked.join(waiting, "remote", "full_outer").select("remote", F.coalesce("n_acked", F.lit(0)).alias("n_acked"), F.coalesce("n_waiting", F.lit(0)).alias("n_waiting"))


@query(f"select event_id, seen as back_us, event_id as back_event, seen as plain_us, '' as plain_event from {ME} where seen is not null")
def x10_cursors(spark, d):
    """Cursors written and read, in the present form and the older plain one."""
    e = me(spark, d).where("seen is not null")
    c = e.withColumns({"b": sync.decoded_cursor(sync.encoded_cursor(F.col("seen"), F.col("event_id"))), "p": sync.decoded_cursor(F.col("seen").cast("string"))})
    return c.select("event_id", F.col("b.timestamp").alias("back_us"), F.col("b.event_id").alias("back_event"), F.col("p.timestamp").alias("plain_us"), F.col("p.event_id").alias("plain_event"))


@query("select 'episodic_memory' as name, count(*)::bigint as n, max(row_id) as last_row, epoch_us(max(created_at)) as last_us from (select distinct row_id, id, created_at from episodic_memory) where row_id > 100 or created_at > timestamptz '2025-03-01 00:00:00+00'")
def x13_x14_envelopes(spark, d):
    """A delta's envelope, with the checkpoint kept as a file and read again."""
    e = em(spark, d, "row_id", "id", "created_at")
    first = spark.createDataFrame([("episodic_memory", 100, "2025-03-01 00:00:00")], "name string, last_row bigint, last_at string")
    path = shared_folder(spark)
    files.export_json(first, path)
    kept = spark.read.schema(first.schema).json(path).first()
    return sync.envelope(sync.delta(e, "row_id", "created_at", kept.last_row, F.to_timestamp(F.lit(kept.last_at))), "episodic_memory", "row_id", "created_at")


@query("select event_type, count(*)::bigint as n, event_type = 'error' as twice from events group by event_type union all select 'any', count(*), false from events")
def t1_emitted_events(spark, d):
    """Events streamed to callbacks by kind and of any kind, of which one always fails."""
    source, sink = shared_folder(spark), shared_folder(spark)
    e = table(spark, d, "events").select("event_id", "event_type")
    e.write.parquet(source)

    def fails(_):
        raise ValueError("no")

    kinds = [r[0] for r in e.select("event_type").distinct().limit(100).collect()]
    write = lambda name: lambda batch: batch.select("event_id", F.lit(name).alias("heard")).write.mode("append").parquet(sink)
    callbacks = {k: [fails, write(k)] + ([write(k)] if k == "error" else []) for k in kinds} | {"*": [write("any")]}
    streams.emit(spark.readStream.schema(e.schema).parquet(source), streams.calling(callbacks), shared_folder(spark)).awaitTermination()
    heard = spark.read.parquet(sink).groupBy("heard").agg(F.count("*").alias("heard_n"), F.count_distinct("event_id").alias("n"))
    return heard.select(F.col("heard").alias("event_type"), "n", (F.col("heard_n") == 2 * F.col("n")).alias("twice"))


# Ranks


@query(f"{_HAMMING} select query_id, id, round(greatest(0, 1 - distance / (max(distance) over (partition by query_id))::double), 6) as sim from r where rank <= 10")
def w2_relative_distance(spark, d):
    """Similarity by the farthest of a batch: 1 - distance / largest distance."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = retrieval.hamming_topk(v, v.where("id % 100 = 0"), 10, 64)
    return retrieval.relative_distance(hits).select("query_id", "id", F.round("sim", 6).alias("sim"))


@query(_BM25 + "select query_id, id, round(1 - (rank - 1) / (count(*) over (partition by query_id))::double, 6) as position_score from r where rank <= 50")
def w4_position_scores(spark, d):
    hits = retrieval.bm25(em(spark, d), ASKED, 50)
    return retrieval.position_scores(hits).select("query_id", "id", F.round("position_score", 6).alias("position_score"))


@query(_BM25 + "select query_id, count(*)::bigint as n_candidates from r where rank <= greatest(3 * 5, 20) group by query_id")
def k2_over_fetch(spark, d):
    """Candidates for five results: three times as many, at least twenty."""
    return retrieval.bm25(em(spark, d), ASKED, retrieval.over_fetch(5, 3, 20)).groupBy("query_id").agg(F.count("*").alias("n_candidates"))


# Media: assets are parts under 41, moments are order lines

_ASSETS = "(select left(sha256('url:https://files.example/' || p_partkey), 24) as asset_id, 'https://files.example/' || p_partkey as ref, p_partkey from part where p_size <= 40)"
_MOMENTS = "(select left(sha256('url:https://files.example/' || l_partkey), 24) as asset_id, l_orderkey, l_linenumber, 'v1:time:' || (l_linenumber * 1000) || '-' || (l_linenumber * 1000 + 500) as key from lineitem)"


def _assets(spark, d):
    p = table(spark, d, "part").where("p_size <= 40")
    same = p.select(F.explode(F.array(F.concat(F.lit("HTTPS://Files.Example/"), "p_partkey"), F.concat(F.lit(" https://files.example/"), "p_partkey"))).alias("ref"), "p_size")
    return media.upserted(same.select(F.lit("url").alias("kind"), "ref", F.lit(None).cast("string").alias("mime"), F.col("p_size").alias("at")))


def _moments(spark, d):
    line = table(spark, d, "lineitem")
    start = F.col("l_linenumber") * 1000
    return line.select(media.asset_id(F.lit("url"), F.concat(F.lit("https://files.example/"), "l_partkey")).alias("asset_id"), "l_orderkey", "l_linenumber", media.span_key(F.lit("time"), start, start + 500).alias("key"))


@query(f"select asset_id, ref from {_ASSETS}")
def g30_upserted_assets(spark, d):
    """Assets named in several spellings, each once."""
    return _assets(spark, d).select("asset_id", "ref")


@query(f"select count(*)::bigint as n_orphans from {_MOMENTS} where asset_id not in (select asset_id from {_ASSETS})")
def j7_orphan_moments(spark, d):
    return media.orphans(_moments(spark, d), _assets(spark, d)).agg(F.count("*").alias("n_orphans"))


@query(f"select asset_id, count(*)::bigint as n from {_MOMENTS} where asset_id in (select asset_id from {_ASSETS}) group by asset_id")
def j8_guarded_inserts(spark, d):
    """Moments per asset, of those that may be inserted because their asset exists."""
    return media.guarded(_moments(spark, d), _assets(spark, d)).groupBy("asset_id").agg(F.count("*").alias("n"))


@query(f"select asset_id, l_orderkey, l_linenumber, key, md5(asset_id || '|' || l_orderkey || '|' || key) as memory_id from (select *, row_number() over (partition by asset_id order by l_linenumber, l_orderkey) as n from {_MOMENTS} where asset_id in (select asset_id from {_ASSETS})) where n <= 3")
def x7_x8_moments(spark, d):
    """The first moments of every asset by ordinal, each bound to a memory."""
    kept = relational.latest_per_key(media.guarded(_moments(spark, d), _assets(spark, d)), ["asset_id"], [F.col("l_linenumber"), F.col("l_orderkey")], 3)
    return kept.select("asset_id", "l_orderkey", "l_linenumber", "key", F.md5(F.concat_ws("|", "asset_id", "l_orderkey", "key")).alias("memory_id"))
