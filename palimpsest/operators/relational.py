"""Scans, joins, set operations and upserts.  Null keys never join; ties are broken by the id."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import entity_similarity
from palimpsest.session import durable


def newest(df: DataFrame, order: str, key: str, n: int, skip: int = 0) -> DataFrame:
    """A page of rows, newest first."""
    page = df.orderBy(F.desc_nulls_last(order), F.desc(key))
    return page.offset(skip).limit(n) if skip else page.limit(n)


def page_after(df: DataFrame, order: str, key: str, last_order, last_key, n: int) -> DataFrame:
    """The next page before a (time, key) position, newest first."""
    before = (F.col(order) < F.lit(last_order)) | ((F.col(order) == F.lit(last_order)) & (F.col(key) < F.lit(last_key)))
    return newest(df.where(before), order, key, n)


def pull_changes(events: DataFrame, at: str, key: str, cursor: tuple | None, n: int) -> DataFrame:
    """The next n events after a cursor in (time, key) order, each with has_more."""
    if cursor:
        events = events.where((F.col(at) > F.lit(cursor[0])) | ((F.col(at) == F.lit(cursor[0])) & (F.col(key) > F.lit(cursor[1]))))
    first = events.orderBy(at, key).limit(n + 1)
    numbered = first.withColumn("__n", F.row_number().over(W.orderBy(at, key)))
    more = F.count("*").over(W.partitionBy()) > n
    return numbered.withColumn("has_more", more).where(F.col("__n") <= n).drop("__n")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows per key in the given order (WindowGroupLimit keeps hot keys cheap)."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def insert_or_ignore(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is new, once per key, added to ``current``."""
    new = incoming.dropDuplicates(keys).join(current.select(*keys).distinct(), keys, "left_anti")
    return current.unionByName(new, allowMissingColumns=True)


def upsert(current: DataFrame, incoming: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Full outer merge: allowed columns of an incoming row replace the current ones where they are not null; action tells which."""
    inc = incoming.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in update])
    both = current.join(inc, current[key] == inc["__k"], "full_outer")
    action = F.when(F.col(key).isNull(), "inserted").when(F.col("__k").isNull(), "kept").otherwise("updated")
    rest = [F.col(c) for c in current.columns if c != key and c not in update]
    return both.select(F.coalesce(key, "__k").alias(key), *[F.coalesce(f"__{c}", c).alias(c) for c in update], *rest, action.alias("action"))


def beyond_first(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """Rows of equal keys but the first; counted before anything is joined, so a key's rows are never brought together."""
    named = [c.alias(f"__k{i}") for i, c in enumerate(keys)]
    first = rows.groupBy(*named).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    on = keys[0] == F.col("__k0")
    for i, c in enumerate(keys[1:], 1):
        on = on & (c == F.col(f"__k{i}"))
    return rows.join(first, on).where(F.col(order) > F.col("__first")).select(*rows.columns)


def missing_from(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of ``df`` without a partner: orphans, rows to back-fill, unacknowledged rows."""
    return df.join(other.select(F.col(other_key).alias("__o")).distinct(), F.col(key) == F.col("__o"), "left_anti")


def merge_compare(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Per id whether an import inserts, skips an identical row or conflicts."""
    cols = [c for c in current.columns if c != key and c in incoming.columns]
    sig = lambda df: F.sha2(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}), 256)
    a = current.groupBy(key).agg(F.min(sig(current)).alias("a"))
    b = incoming.groupBy(F.col(key).alias("__k")).agg(F.min(sig(incoming)).alias("b"))
    both = b.join(a, F.col(key) == F.col("__k"), "left")
    return both.select(F.col("__k").alias(key), F.when(F.col("a").isNull(), "insert").when(F.col("a") == F.col("b"), "skip").otherwise("conflict").alias("outcome"))


def merge_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys folded: highest importance, first id, known veracity wins, latest creation, number of copies."""
    known = F.when(F.col("veracity") != "unknown", F.struct("created_at", "id", "veracity"))
    return rows.groupBy(*keys).agg(
        F.min("id").alias("id"),
        F.max("importance").alias("importance"),
        F.coalesce(F.max(known)["veracity"], F.lit("unknown")).alias("veracity"),
        F.max("created_at").alias("created_at"),
        F.count("*").alias("n_copies"),
    )


def ordered_chunks(rows: DataFrame, group: str, at: str, key: str, size: int = 1000, keep: list[str] | None = None) -> DataFrame:
    """group, chunk, rows: every group's rows in order of time (null first), then key, ``size`` of them to an array of key and the ``keep`` columns.

    No group is ordered by one task: rows are counted by hour, rows without a time
    by the head of their key, and numbered within these from the counts before.
    """
    keep = keep or []
    r = rows.select(group, at, key, *keep).withColumn("__hour", F.date_trunc("hour", at)).withColumn("__head", F.when(F.col(at).isNull(), F.substring(key, 1, 3)))
    part = [group, "__hour", "__head"]
    order = [F.asc_nulls_first("__hour"), F.asc_nulls_first("__head")]
    sizes = r.groupBy(*part).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(c).alias(f"o_{c}") for c in part], before.alias("__before"))
    local = r.withColumn("__i", F.row_number().over(W.partitionBy(*part).orderBy(F.asc_nulls_first(at), key)) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in part]
    placed = local.join(offsets, same[0] & same[1] & same[2]).withColumn("__i", F.col("__i") + F.col("__before"))
    members = F.array_sort(F.collect_list(F.struct("__i", key, *keep)))
    return placed.groupBy(group, F.floor(F.col("__i") / size).cast("bigint").alias("chunk")).agg(members.alias("rows"))


# Names over this length are not cut in two: what is left after deletions would be too many keys.
CUT_LENGTH = 29
# Names that the places of the cuts are chosen by; they decide the time, not the pairs.
CUT_SAMPLE = 20_000


def _edits(length: int, threshold: float) -> int:
    # One unit in the ninth digit: 0.2 * 15 must not fall below 3.
    return math.floor((1 - threshold) * length + 1e-9)


def _left(text: Column, n: int) -> Column:
    """What is left of a text after n deletions, each set of places once."""
    out = F.array(F.struct(text.alias("x"), F.lit(1).alias("i")))
    for _ in range(n):
        cut = lambda s: F.transform(F.filter(F.sequence(s["i"], F.greatest(s["i"], F.length(s["x"]))), lambda i: i <= F.length(s["x"])), lambda i: F.struct(F.concat(F.substring(s["x"], F.lit(1), i - 1), F.substring(s["x"], i + 1, F.length(s["x"]))).alias("x"), i.alias("i")))
        out = F.flatten(F.transform(out, cut))
    return F.array_distinct(F.transform(out, lambda s: s["x"]))


def _letters(text: Column) -> Column:
    """A bit per letter and its number among equal ones; an edit changes at most two."""
    letters = F.array_sort(F.split(text, ""))
    bits = F.transform(letters, lambda c, i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(c, i + 1 - F.array_position(letters, c)), F.lit(64)).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def _meetings(texts: list[str], most: int) -> list[list[float]]:
    """For parts of 0 to ``most`` letters from the left: how often a pair meets by what is left after 0, 1 and 2 deletions, as far as single letters tell."""
    agree = []
    for p in range(most + 1):
        c = Counter(t[:p] for t in texts)
        agree.append(sum(n * (n - 1) for n in c.values()) / max(1, len(texts) * (len(texts) - 1)))
    one, two, share, step, out = 0.0, 0.0, 1.0, 1.0, [[1.0] * 3]
    for p in range(1, most + 1):
        # Where no pair agrees any more, letters go on as they did.
        step = min(1.0, agree[p] / agree[p - 1]) if agree[p] else step
        share, more = share * step, 1 / step - 1
        one, two = one + more, two + one * more
        out.append([share, share * (p + one), share * (math.comb(p, 2) + one * (p - 1) + two)])
    return out


def name_cuts(sizes: dict[int, int], sample: list[str], threshold: float) -> list[tuple[int, int, int, int, int]]:
    """(l, m, side, letters, deletions): the keys of a name of l letters for pairs whose longer name has m.

    With e edits allowed, a name cut in two has at most f edits before or e - 1 - f
    behind the cut.  The cut and f are those with the fewest expected keys and candidates.
    """
    plan = []
    for m in sorted(sizes):
        e = _edits(m, threshold)
        if e < 1 or m > CUT_LENGTH:
            continue
        band = [n for n in sizes if m - e <= n <= m]
        if e == 1:
            plan += [(n, m, 0, m, 1) for n in band]
            continue
        near = [x for x in sample if m - e <= len(x) <= m]
        heads, tails, rows = _meetings(near, m), _meetings([x[::-1] for x in near], m), sum(sizes[n] for n in band)
        cost = lambda p, f: (rows * 4 * (math.comb(p, f) + math.comb(m - p, e - 1 - f)) + sizes[m] * rows * (heads[p][f] + tails[m - p][e - 1 - f]), p, f)  # noqa: E731, B023
        _, p, f = min(cost(p, f) for p in range(1, m) for f in range(max(0, e - 3), min(2, e - 1) + 1) if p > f and m - p > e - 1 - f)
        plan += [x for n in band for x in ((n, m, 0, p, f), (n, m, 1, m - p, e - 1 - f))]
    return plan


def similar_names(rows: DataFrame, name: str, threshold: float = 0.8) -> DataFrame:
    """name, other, similarity, n_links: all pairs of normalised names (name < other) whose entity similarity reaches the threshold.

    A name in several spellings also meets itself; n_links counts pairs of
    spellings.  Candidates are complete: for edits, names share what is left of their
    beginnings or of their ends after a few deletions (``name_cuts``; names over
    ``CUT_LENGTH`` meet all names of a possible length); for the prefix rule, names meet
    their own prefixes.  Substrings that are no prefix stay below 0.8.
    """
    assert threshold >= 0.8
    spark = rows.sparkSession
    n = F.lower(F.trim(name))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spelled = rows.where(F.col(name).isNotNull()).select(name).distinct().select(n.alias("n")).repartition(tasks, "n")
    names = durable(spelled.groupBy("n").agg(F.count("*").alias("k")).withColumn("l", F.length("n")).withColumn("bits", _letters(F.col("n"))))
    # One row per length, and a bounded number of short names.
    sizes = {r["l"]: r["c"] for r in names.where(F.col("l") <= CUT_LENGTH).groupBy("l").agg(F.count("*").alias("c")).collect()}
    every = max(1, sum(sizes.values()) // CUT_SAMPLE)
    sample = [r["n"] for r in names.where(F.col("l") <= CUT_LENGTH).where(F.pmod(F.xxhash64("n"), F.lit(every)) == 0).select("n").limit(2 * CUT_SAMPLE).collect()]
    cuts = ", ".join(map(str, name_cuts(sizes, sample, threshold) or [(-1, -1, 0, 0, 0)]))
    plan = spark.sql(f"select * from values {cuts} as t(l, m, side, size, f)")
    part = F.when(F.col("side") == 0, F.expr("left(n, size)")).otherwise(F.expr("right(n, size)"))
    # A name shorter than its part has lost letters already.
    parts = names.join(F.broadcast(plan), "l").withColumn("part", part).withColumn("f", F.col("f") - F.col("size") + F.length("part"))
    left = F.when(F.col("f") == 0, F.array("part")).when(F.col("f") == 1, _left(F.col("part"), 1)).when(F.col("f") == 2, _left(F.col("part"), 2))
    keyed = parts.select("n", "k", "l", "m", "bits", F.explode(F.transform(left, lambda x: F.xxhash64("m", "side", x))).alias("key"))
    edits = F.floor((1 - threshold) * F.col("m") + 1e-9).cast("int")
    a = keyed.where("l = m").select("key", "n", "k", "m", "bits", edits.alias("e"))
    b = keyed.select("key", F.col("n").alias("o"), F.col("k").alias("ko"), F.col("l").alias("lo"), F.col("bits").alias("bo"))
    near = a.join(b, "key").where("lo < m or n < o").where("bit_count(bits ^ bo) <= 2 * e - m + lo").where("levenshtein(n, o, e) >= 0").select("n", "k", "o", "ko")
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(threshold * F.col("l") - 1e-9).cast("int")), F.col("l"))
    far = names.select(F.col("n").alias("o"), F.col("k").alias("ko"), F.col("l").alias("lo"))
    long = names.where(F.col("l") > CUT_LENGTH).select("n", "k", F.explode(lengths).alias("lo")).join(far, "lo").where("n != o").select("n", "k", "o", "ko")
    least = F.greatest(F.lit(1), F.floor((threshold - 0.7) / 0.3 * F.col("l") - 1e-9).cast("int"))
    heads = names.where("l > 1").select("n", "k", F.explode(F.transform(F.sequence(least, F.col("l") - 1), lambda i: F.substring("n", F.lit(1), i))).alias("o"))
    head = heads.join(far.select("o", "ko"), "o").select("n", "k", "o", "ko")
    pair = [F.least("n", "o").alias("n"), F.greatest("n", "o").alias("o"), (F.col("k") * F.col("ko")).alias("n_links")]
    like = entity_similarity(F.col("n"), F.col("o"))
    met = near.unionByName(long.where(like >= threshold)).unionByName(head).select(*pair).distinct()
    same = names.where("k > 1").select("n", F.col("n").alias("o"), F.expr("k * (k - 1) div 2").alias("n_links"))
    linked = met.unionByName(same).select(F.col("n").alias("name"), F.col("o").alias("other"), like.alias("similarity"), "n_links")
    return linked.where(F.col("similarity") >= threshold)
