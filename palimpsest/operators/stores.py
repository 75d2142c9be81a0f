"""Stores as frames: triples, slots, annotations, scratchpads, proposals, validations, personas; point operations and batches as frames of operations.

Every function returns the new state or the rows to write; nothing is changed in
place.  Null keys never match; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.history import as_of, versions
from palimpsest.operators.relational import insert_or_ignore, latest_per_key

# Triples


def add_triple(triples: DataFrame, new: DataFrame, supersede: bool = True) -> DataFrame:
    """Triples (id, subject, predicate, object, valid_from, valid_until) with new ones; open rows of the same subject and predicate end where the new one starts."""
    if not supersede:
        return triples.unionByName(new)
    starts = new.groupBy(F.col("subject").alias("s"), F.col("predicate").alias("p")).agg(F.min("valid_from").alias("closes"))
    on = (F.col("subject") == F.col("s")) & (F.col("predicate") == F.col("p"))
    kept = triples.join(starts, on, "left").withColumn("valid_until", F.coalesce("valid_until", F.greatest("closes", F.when(F.col("closes").isNotNull(), F.col("valid_from")))))
    return kept.select(*triples.columns).unionByName(new)


def end_triple(triples: DataFrame, ends: DataFrame) -> DataFrame:
    """Open triples of the named (subject, predicate) ended at ``at``; ended ones stay."""
    e = ends.groupBy(F.col("subject").alias("s"), F.col("predicate").alias("p")).agg(F.min("at").alias("at"))
    joined = triples.join(e, (F.col("subject") == F.col("s")) & (F.col("predicate") == F.col("p")), "left")
    return joined.withColumn("valid_until", F.coalesce("valid_until", "at")).select(*triples.columns)


def query_triples(triples: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None, at: str | None = None) -> DataFrame:
    """Triples that match, without regard to case, valid at a time if one is given."""
    out = triples
    for column, value in (("subject", subject), ("predicate", predicate), ("object", obj)):
        if value is not None:
            out = out.where(F.lower(F.trim(column)) == value.strip().lower())
    return as_of(out, at, "valid_from", "valid_until") if at else out


# Slots with versions


def remember_canonical(notes: DataFrame, slot: list[str], body: str, order: list[str], at: str) -> DataFrame:
    """All versions of every slot; writing an equal body again changes nothing."""
    return versions(notes, slot, body, order, at)


def recall_canonical(history: DataFrame, slot: list[str]) -> DataFrame:
    """The version of each slot that holds now."""
    return latest_per_key(history, slot, [F.desc("version")])


def forget_canonical(history: DataFrame, forgotten: DataFrame, slot: list[str]) -> DataFrame:
    """The history without the named slots."""
    return history.join(forgotten.select(*slot).distinct(), slot, "left_anti")


def model_card(current: DataFrame, owner: str, category: str, body: str, per_owner: int = 50) -> DataFrame:
    """owner, card: '- category: body' lines in order of category, at most ``per_owner`` of an owner."""
    n = F.row_number().over(W.partitionBy(owner).orderBy(category, body))
    lines = current.withColumn("__n", n).where(F.col("__n") <= per_owner)
    items = F.array_sort(F.collect_list(F.struct("__n", F.concat(F.lit("- "), F.col(category), F.lit(": "), F.col(body)).alias("line"))))
    return lines.groupBy(owner).agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("card"))


# Annotations


def add_annotation(current: DataFrame, new: DataFrame) -> DataFrame:
    """Annotations (memory_id, kind, value), each once."""
    return insert_or_ignore(current, new, ["memory_id", "kind", "value"])


def query_annotations(annotations: DataFrame, kind: str | None = None, value: str | None = None) -> DataFrame:
    out = annotations
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    return out.where(F.col("value") == value) if value is not None else out


# Upserts


def replaced(current: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Insert or replace: of all rows of a key the latest, of equal ones the new one."""
    both = current.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), F.col("__new"))).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def scratchpad(notes: DataFrame, owner: str, content: str, at: str, cap: int = 1000) -> DataFrame:
    """Notes once per owner and content with their last time, newest first, at most ``cap``."""
    merged = notes.where(F.col(content).isNotNull()).groupBy(owner, content).agg(F.max(at).alias(at))
    return merged.orderBy(F.desc_nulls_last(at), owner, content).limit(cap)


# Operations

OPERATIONS = ["remember", "update", "forget", "invalidate"]


def validated(operations: DataFrame) -> DataFrame:
    """Operations (n, op, id, content, importance) with ``reason``, null where an operation is sound."""
    again = F.row_number().over(W.partitionBy("id", "op").orderBy("n")) > 1
    reason = (
        F.when(F.col("op").isNull() | ~F.col("op").isin(OPERATIONS), "unknown operation")
        .when((F.col("op") != "remember") & F.col("id").isNull(), "no id")
        .when((F.col("op") == "remember") & (F.trim(F.coalesce("content", F.lit(""))) == ""), "no content")
        .when((F.col("op") == "update") & F.col("content").isNull() & F.col("importance").isNull(), "nothing to update")
        .when(F.col("importance").isNotNull() & ~F.col("importance").between(0, 1), "importance out of range")
        .when(F.col("id").isNotNull() & again, "repeated")
    )
    return operations.withColumn("reason", reason)


def applied(rows: DataFrame, operations: DataFrame) -> DataFrame:
    """Rows (id, content, importance, superseded_by) after sound operations, each id's in the order of n.

    Forgotten rows go, invalidated ones name their replacement, an update keeps
    what it does not set.  Column by column the last operation that sets it holds.
    """
    ops = validated(operations).where("reason is null and op != 'remember'")
    last = lambda value, when: F.max_by(value, F.when(when, F.col("n")))
    folded = ops.groupBy(F.col("id").alias("k")).agg(
        F.bool_or(F.col("op") == "forget").alias("gone"),
        last("content", (F.col("op") == "update") & F.col("content").isNotNull()).alias("c"),
        last("importance", (F.col("op") == "update") & F.col("importance").isNotNull()).alias("i"),
        last("replacement", F.col("op") == "invalidate").alias("r"),
        F.bool_or(F.col("op") == "invalidate").alias("void"),
    )
    both = rows.join(folded, F.col("id") == F.col("k"), "left").where(~F.coalesce("gone", F.lit(False)))
    return both.select("id", F.coalesce("c", "content").alias("content"), F.coalesce("i", "importance").alias("importance"), F.when(F.col("void"), F.coalesce("r", F.lit("invalidated"))).otherwise(F.col("superseded_by")).alias("superseded_by"))


def dry_run(rows: DataFrame, operations: DataFrame) -> DataFrame:
    """outcome and its number: what a batch would do, without doing it."""
    known = rows.select(F.col("id").alias("k")).distinct()
    seen = validated(operations).join(known, F.col("id") == F.col("k"), "left")
    outcome = F.when(F.col("reason").isNotNull(), F.concat(F.lit("rejected: "), "reason")).when((F.col("op") != "remember") & F.col("k").isNull(), "not found").otherwise(F.col("op"))
    return seen.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


# Proposals and validations


def coerced(confidence: Column) -> Column:
    """A confidence between 0 and 1; anything else reads as 0.5."""
    c = confidence.try_cast("double")
    return F.when(c.isNull() | F.isnan(c), 0.5).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def decided(proposals: DataFrame, apply_from: float = 0.9, reject_below: float = 0.3) -> DataFrame:
    """Proposals (slot, body, confidence, n) with status: the most confident of a slot is applied from ``apply_from``, weak ones are rejected, the rest waits."""
    n = F.row_number().over(W.partitionBy("slot").orderBy(F.desc("confidence"), "n"))
    status = F.when(F.col("confidence") < reject_below, "rejected").when((F.col("__n") == 1) & (F.col("confidence") >= apply_from), "applied").otherwise("pending")
    return proposals.withColumn("__n", n).withColumn("status", status).drop("__n")


def validation_state(actions: DataFrame, kept: int = 3) -> DataFrame:
    """id, state and n_kept of validation actions (id, action, at, n): the last of attest, update, invalidate and delete tells the state; the last ``kept`` are remembered."""
    last = F.max_by("action", F.struct("at", "n"))
    state = F.when(last == "delete", "deleted").when(last == "invalidate", "invalid").when(last == "update", "updated").otherwise("attested")
    return actions.where("id is not null").groupBy("id").agg(state.alias("state"), F.least(F.count("*"), F.lit(kept)).alias("n_kept"))


# Facts


def conflict_list(facts: DataFrame, margin: float = 0.0) -> DataFrame:
    """Per (subject, predicate) of several objects: winner, loser, and whether the winner's confidence leads by more than ``margin`` (resolved).

    One row a losing object, against the best: no pairs among losers.
    """
    best = facts.groupBy("subject", "predicate").agg(F.max(F.struct("confidence", "object")).alias("b"))
    both = facts.alias("f").join(best.alias("g"), (F.col("f.subject") == F.col("g.subject")) & (F.col("f.predicate") == F.col("g.predicate"))).where(F.col("f.object") != F.col("g.b.object"))
    return both.select("f.subject", "f.predicate", F.col("g.b.object").alias("winner"), F.col("f.object").alias("loser"), (F.col("g.b.confidence") - F.col("f.confidence") > margin).alias("resolved"))


def snippet(content: Column, needle: Column, width: int = 60) -> Column:
    """The text around the first place of a word, ``width`` characters to either side."""
    at = F.instr(content, needle)
    start = F.greatest(F.lit(1), at - width)
    return F.when(at > 0, F.substring(content, start, at - start + F.length(needle) + width))


# Personas


def persona(candidates: DataFrame, promoted: DataFrame, topic: str, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(traits: the most important new candidate of every topic; render: one row, text and whether enough traits justify one)."""
    best = latest_per_key(candidates, [topic], [F.desc_nulls_last("importance"), F.col("id")])
    new = best.join(promoted.select(topic).distinct(), topic, "left_anti")
    top = new.orderBy(F.desc_nulls_last("importance"), "id").limit(20)
    lines = F.array_sort(F.collect_list(F.struct((-F.coalesce("importance", F.lit(0.0))).alias("k"), "id", F.concat(F.lit("- "), F.substring("content", 1, 80)).alias("line"))))
    text = top.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("persona"), (F.count("*") >= least).alias("due"))
    return new, text
