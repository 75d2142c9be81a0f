"""Replication: deltas, conflicts, causal dominance, discovered mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.ordered import neighbour


def winners(events: DataFrame, key: str, at: str, importance: str, device: str, event: str) -> DataFrame:
    """The event that wins per key: latest, then most important, then greatest device and id.  Pre-aggregated, no window; events without a key or time are left out."""
    best = F.max(F.struct(F.col(at), F.coalesce(F.col(importance), F.lit(0.0)), F.col(device), F.col(event)))
    return events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key).agg(best.alias("b")).select(key, F.col("b")[event].alias(event), F.col("b")[at].alias(at))


def dominated(events: DataFrame, event: str, parents: str) -> DataFrame:
    """Ids of events that are an ancestor of another event, by closure over parent links.

    Every direct parent is dominated; ancestors further up are parents of some event
    too, unless that event is missing, so links through missing events end there.
    """
    links = events.select(F.explode(F.from_json(parents, "array<string>")).alias("parent"))
    return links.where("parent is not null").distinct().select(F.col("parent").alias(event))


def chain_winners(events: DataFrame, key: str, at: str, importance: str, device: str, event: str, parents: str) -> DataFrame:
    """Winners among events that no later event of theirs descends from."""
    heads = events.join(dominated(events, event, parents), event, "left_anti")
    return winners(heads, key, at, importance, device, event)


def concurrent(local: DataFrame, remote: DataFrame, key: str, at_us: str, event: str, window_us: int = 5_000_000) -> DataFrame:
    """Per local event the number of remote events (one row each) of the same key within the window, the event itself left out; events without any are left out.

    Counted over each key's order of time by a range of the window, so no pairs are
    made: what a busy key costs grows with its rows.
    """
    one = lambda df, is_local: df.select(F.col(key).alias("k"), F.col(at_us).alias("t"), F.col(event).alias("e"), F.lit(is_local).alias("local"))
    both = one(local, 1).unionByName(one(remote, 0)).where("k is not null and t is not null")
    w = W.partitionBy("k").orderBy("t").rangeBetween(-window_us, window_us)
    counted = both.withColumn("n", F.sum(1 - F.col("local")).over(w)).where("local = 1")
    itself = remote.select(F.col(key).alias("rk"), F.col(event).alias("re"), F.lit(1).alias("own")).distinct()
    hits = counted.join(itself, (F.col("k") == F.col("rk")) & (F.col("e") == F.col("re")), "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0)))
    return hits.where("n > 0").select(F.col("k").alias(key), F.col("e").alias(event), F.col("n").alias("n_concurrent"))


def proposals(events: DataFrame, key: str, at_us: str, window_us: int = 5_000_000) -> DataFrame:
    """Merge proposals: per key the events (event_id, operation, importance, device_id) that another one follows or precedes within the window, the winner, and how to merge.

    Neighbours in time decide, so no pairs are made.  Equal operations merge by
    themselves, others are for a person to decide.
    """
    w = W.partitionBy(key).orderBy(at_us, "event_id")
    near = lambda other: F.coalesce(F.abs(other - F.col(at_us)) <= window_us, F.lit(False))
    meeting = events.where(F.col(key).isNotNull() & F.col(at_us).isNotNull()).withColumn("__near", near(F.lag(at_us).over(w)) | near(F.lead(at_us).over(w))).where("__near")
    best = F.max(F.struct(F.col(at_us), F.coalesce("importance", F.lit(0.0)), "device_id", "event_id"))["event_id"]
    how = F.when(F.count_distinct("operation") == 1, "automatic").otherwise("manual")
    return meeting.groupBy(key).agg(F.count("*").alias("n_events"), best.alias("winner"), how.alias("merge"))


def acknowledged(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Events (event_id, ...) with the remote of every acknowledgement (remote, event_id)."""
    return events.join(acks.select("remote", "event_id").distinct(), "event_id")


def outbox(events: DataFrame, remotes: list[str], acks: DataFrame) -> DataFrame:
    """Events that a remote has not acknowledged, with that remote."""
    every = events.withColumn("remote", F.explode(F.array(*[F.lit(r) for r in remotes])))
    return every.join(acks.select("remote", "event_id").distinct(), ["remote", "event_id"], "left_anti")


def push_outcomes(events: DataFrame, skew_us: int = 300_000_000) -> DataFrame:
    """Events (event_id, memory_id, operation, instant_us, arrived_us; one row per event) with ``outcome``: accepted, or why not."""
    known = F.col("operation").isin("CREATE", "UPDATE", "DELETE", "CONSOLIDATE")
    outcome = (
        F.when(F.col("memory_id").isNull(), "no memory").when(~F.coalesce(known, F.lit(False)), "unknown operation").when(F.col("instant_us").isNull(), "no instant")
        .when(F.col("instant_us") > F.col("arrived_us") + skew_us, "from the future").otherwise("accepted")
    )
    return events.withColumn("outcome", outcome)


def encoded_cursor(at_us: Column, event: Column) -> Column:
    return F.to_json(F.struct(at_us.alias("timestamp"), event.alias("event_id")))


def decoded_cursor(cursor: Column) -> Column:
    """struct(timestamp, event_id); a plain number is a timestamp of the older form, with an empty event."""
    read = F.from_json(cursor, "timestamp bigint, event_id string")
    plain = cursor.try_cast("bigint")
    return F.struct(F.coalesce(plain, read["timestamp"]).alias("timestamp"), F.when(plain.isNotNull(), "").otherwise(read["event_id"]).alias("event_id"))


def envelope(rows: DataFrame, name: str, row_no: str, at: str) -> DataFrame:
    """One row for a delta: the table, how many rows, and the checkpoint that follows it."""
    return rows.agg(F.count("*").alias("n"), F.max(row_no).alias("last_row"), F.unix_micros(F.max(at)).alias("last_us")).select(F.lit(name).alias("name"), "n", "last_row", "last_us")


def delta(rows: DataFrame, row_no: str, at: str, last_row: int, last_at) -> DataFrame:
    """Rows added or touched since a checkpoint."""
    return rows.where((F.col(row_no) > last_row) | (F.col(at) > F.lit(last_at)))


def mutations(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """CREATE, UPDATE and DELETE between two states by fingerprint."""
    print_of = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    a = before.select(F.col(key).alias("a"), print_of.alias("fa"))
    b = after.select(F.col(key).alias("b"), print_of.alias("fb"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    op = F.when(F.col("a").isNull(), "CREATE").when(F.col("b").isNull(), "DELETE").when(F.col("fa") != F.col("fb"), "UPDATE")
    return both.select(F.coalesce("a", "b").alias(key), op.alias("operation")).where("operation is not null")


def last_n(events: DataFrame, at: str, event: str, n: int, kinds: list[str] | None = None, kind: str = "operation") -> DataFrame:
    """The buffer of the last n events, optionally of some kinds."""
    if kinds:
        events = events.where(F.col(kind).isin(kinds))
    return events.orderBy(F.desc(at), F.desc(event)).limit(n)


def transitions(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Counts of adjacent value pairs along each group's order."""
    # The first of the order is a time.
    follow = neighbour(rows.select(group, *order, value), [group], F.date_trunc("hour", order[0]), order, value, "next")
    return follow.where(f"next is not null and {value} is not null").groupBy(F.col(value).alias("before"), F.col("next").alias("after")).agg(F.count("*").alias("n"))

