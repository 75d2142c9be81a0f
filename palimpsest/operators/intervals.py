"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Two levels, so that no entity is one task.

Level one clips every interval into time shards: its head in the shard of its
start, its tail in the shard of its end, and one range row for all whole shards
between.  Pieces are merged per (entity, shard).  Shards are 64 days wide; one
with more than ``dense`` starts of an entity is divided, again and again, down to
``LADDER``'s last width, at which it can hold only so many distinct starts.  An
island (merged run) with neighbours on both sides in its shard is a period as it
is, and the holes between neighbours are gaps, unless a range covers the shard.

Level two stitches what touches shard borders: per entity one row for the first
and one for the last island of every touched shard, and the ranges.

Null starts, and ends not after the start, cover nothing; null keys form groups
of their own; repeated and touching intervals coalesce; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.instants import DAY_US
from palimpsest.session import durable

# Widths of shards; each divides the one before.
LADDER = (64 * DAY_US, DAY_US, DAY_US // 64, DAY_US // 4096, DAY_US // 102_400)
DENSE = 500_000
# Stands for an end that is open; far past year 9999, and the start of a shard for any shard width.
OPEN_US = 4_000_000 * DAY_US


def _floor(c: Column, width: int) -> Column:
    return c - F.pmod(c, F.lit(width))


def _with_width(points: DataFrame, names: list[str], point: str, out: str, ladder: tuple[int, ...], crowded: list[DataFrame]) -> DataFrame:
    """Add ``out``, the width of the shard that holds ``point``."""
    points = points.withColumn(out, F.lit(ladder[0]).cast("long"))
    for width, finer, few in zip(ladder, ladder[1:], crowded):
        mark = few.select(*[F.col(n).alias(f"c_{n}") for n in names], F.col("lo").alias("c_lo"))
        same = [F.col(n).eqNullSafe(F.col(f"c_{n}")) for n in names] + [_floor(F.col(point), width) == F.col("c_lo")]
        on = same[0]
        for x in same[1:]:
            on = on & x
        points = points.join(mark, on, "left").withColumn(out, F.when(F.col("c_lo").isNotNull(), F.lit(finer).cast("long")).otherwise(F.col(out))).drop("c_lo", *[f"c_{n}" for n in names])
    return points


def merge_intervals(intervals: DataFrame, keys: list[str], start: str, end: str, ladder: tuple[int, ...] = LADDER, dense: int = DENSE) -> DataFrame:
    """Columns keys, kind ('period' or 'gap'), start_us, end_us; an end of ``OPEN_US`` or later is open.

    ``start`` and ``end`` are bigint microseconds.  The first width must divide ``OPEN_US``.
    """
    if OPEN_US % ladder[0] or any(a % b for a, b in zip(ladder, ladder[1:])):
        raise ValueError("each width must divide the one before, and the first OPEN_US")
    names = [f"k{i}" for i in range(len(keys))]
    base = intervals.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(start).alias("s"), F.least(F.col(end), F.lit(OPEN_US)).alias("e")).where("s < e")
    # Read for the counts and for the pieces: without the cut all texts would be parsed twice.
    base = durable(base)
    crowded: list[DataFrame] = []
    for width in ladder[:-1]:
        inside = base
        if crowded:
            mark = crowded[-1]
            on = [F.col(f"b.{n}").eqNullSafe(F.col(f"m.{n}")) for n in names] + [_floor(F.col("b.s"), ladder[len(crowded) - 1]) == F.col("m.lo")]
            whole = on[0]
            for x in on[1:]:
                whole = whole & x
            inside = base.alias("b").join(mark.alias("m"), whole, "left_semi")
        few = inside.groupBy(*names, _floor(F.col("s"), width).alias("lo")).count().where(F.col("count") > dense).drop("count")
        # As many rows as there are crowded shards.
        few = durable(few)
        if few.isEmpty():
            break
        crowded.append(few)
    base = _with_width(_with_width(base, names, "s", "ws", ladder, crowded), names, "e", "we", ladder, crowded)
    low = lambda p, w: F.col(p) - F.pmod(F.col(p), F.col(w))
    base = base.withColumns({"s_lo": low("s", "ws"), "e_lo": low("e", "we")})
    piece = lambda lo, hi, s, e, ranged: F.struct(lo.alias("lo"), hi.alias("hi"), s.alias("s"), e.alias("e"), F.lit(ranged).alias("ranged"))
    s, e, s_lo, e_lo, s_hi = F.col("s"), F.col("e"), F.col("s_lo"), F.col("e_lo"), F.col("s_lo") + F.col("ws")
    inside = piece(s_lo, s_hi, s, e, False)
    across = F.array(piece(s_lo, s_hi, s, s_hi, False), piece(s_hi, e_lo, s_hi, e_lo, True), piece(e_lo, e_lo + F.col("we"), e_lo, e, False))
    split = F.when(s_lo == e_lo, F.array(inside)).otherwise(F.filter(across, lambda x: x["s"] < x["e"]))
    pieces = base.select(*names, F.explode(split).alias("p")).select(*names, "p.*")
    # Partial aggregation removes repeats, and all tails in a shard but the longest, before the shuffle.
    shard = [*names, "ranged", "lo", "hi"]
    pieces = pieces.groupBy(*shard, "s").agg(F.max("e").alias("e"))
    local = W.partitionBy(*shard).orderBy("s")
    seen = F.max("e").over(local.rowsBetween(W.unboundedPreceding, -1))
    numbered = pieces.withColumn("new", (seen.isNull() | (F.col("s") > seen)).cast("int")).withColumn("island", F.sum("new").over(local.rowsBetween(W.unboundedPreceding, 0)))
    islands = numbered.groupBy(*shard, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    islands = islands.withColumns({"first": F.col("island") == 1, "next": F.lead("s").over(local)}).drop("island")
    islands = durable(islands)

    # Level two: ranges before islands that start with them.
    edge = islands.where("first or next is null").select(*names, "lo", "hi", "s", "e", "ranged", (~F.col("first")).alias("last"))
    along = W.partitionBy(*names).orderBy("s", F.desc("ranged"), "e")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    line = edge.withColumns({"reach": F.max("e").over(before), "ranged_to": F.max(F.when(F.col("ranged"), F.col("e"))).over(before)})
    line = line.withColumn("new", F.col("reach").isNull() | (F.col("s") > F.col("reach")))
    line = durable(line.withColumn("stretch", F.sum(F.col("new").cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0))))
    # Only a shard with a last island of its own has anything inside that a range can cover.
    covered = line.where("last and ranged_to >= hi").select(*[F.col(n).alias(f"c_{n}") for n in names], F.col("lo").alias("c_lo"))
    on = F.col("lo") == F.col("c_lo")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"c_{n}"))
    inner = islands.where("not ranged and not (first and next is null)").join(covered, on, "left_anti")
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start_us"), b.alias("end_us"))
    both = F.array(F.when(~F.col("first") & F.col("next").isNotNull(), row("period", F.col("s"), F.col("e"))), F.when(F.col("next").isNotNull(), row("gap", F.col("e"), F.col("next"))))
    inner = inner.select(*names, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select(*names, "x.*")
    # The hole before a last island was told by level one.
    outer = line.where("new and reach is not null and not last").select(*names, F.lit("gap").alias("kind"), F.col("reach").alias("start_us"), F.col("s").alias("end_us"))
    stretches = line.groupBy(*names, "stretch").agg(F.min("s").alias("start_us"), F.max("e").alias("end_us")).select(*names, F.lit("period").alias("kind"), "start_us", "end_us")
    out = stretches.unionByName(outer).unionByName(inner)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "kind", "start_us", "end_us")
