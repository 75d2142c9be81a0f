"""Late and out-of-order events: per-period aggregates, first as published and then as corrected.

The state is a multiset per (key, period): for each value the number of distinct
events, by arrival class (in time, late, too late).  Late records only add to
counts, states add up in any order, and exact medians, distinct counts and
extremes are re-derived from cumulative counts over the sorted values.

An event arrives when its first copy does.  Events that never arrived or have no
instant are left out.  A null value counts as an event but not in the value
statistics; null keys form a group; repeats of an event count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.instants import HOUR_US

CUTOFF_US = 24 * HOUR_US
CLASSES = ["n_first", "n_late", "n_dropped"]


def count_state(events: DataFrame, period_us: int = HOUR_US, cutoff_us: int = CUTOFF_US) -> DataFrame:
    """The value-count state of events (key, event_us, arrived_us, value), one row per event."""
    start = F.expr(f"event_us - pmod(event_us, {period_us})")
    delay = F.col("arrived_us") - (F.col("period_start_us") + period_us)
    when = lambda c: F.count_if(c)
    return (
        events.where("event_us is not null and arrived_us is not null")
        .withColumn("period_start_us", start)
        .groupBy("key", "period_start_us", "value")
        .agg(when(delay <= 0).alias("n_first"), when((delay > 0) & (delay <= cutoff_us)).alias("n_late"), when(delay > cutoff_us).alias("n_dropped"))
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """Add up states of disjoint sets of events, e.g. the kept state and one batch of late records."""
    every = states[0]
    for other in states[1:]:
        every = every.unionByName(other)
    return every.groupBy("key", "period_start_us", "value").agg(*[F.sum(c).alias(c) for c in CLASSES])


def period_counts(state: DataFrame) -> DataFrame:
    """n_first, n_final (n_first included) and n_dropped per key and period."""
    out = state.groupBy("key", "period_start_us").agg(*[F.sum(c).alias(c) for c in CLASSES])
    return out.select("key", "period_start_us", "n_first", (F.col("n_first") + F.col("n_late")).alias("n_final"), "n_dropped")


def period_statistics(state: DataFrame) -> DataFrame:
    """Counts, and of the values distinct count, minimum, maximum and median, as first published and as corrected.

    The median of an even number of values is the mean of the middle two.  A period
    without values has null statistics.
    """
    known = F.col("value").isNotNull()
    counted = state.withColumn("n_final", F.col("n_first") + F.col("n_late"))
    # A null value comes first and adds nothing to the ranks.
    order = W.partitionBy("key", "period_start_us").orderBy("value")
    whole = W.partitionBy("key", "period_start_us")
    aggs: list[Column] = []
    for name in ("first", "final"):
        n = F.when(known, F.col(f"n_{name}")).otherwise(0)
        counted = counted.withColumns({f"up_{name}": F.sum(n).over(order), f"all_{name}": F.sum(n).over(whole)})
        has = known & (F.col(f"n_{name}") > 0)
        # The value at rank r is the first whose cumulative count reaches r.
        at = lambda r, name=name, has=has: F.min(F.when(has & (F.col(f"up_{name}") >= r), F.col("value")))
        low, high = F.expr(f"(all_{name} + 1) div 2"), F.expr(f"all_{name} div 2 + 1")
        aggs += [
            F.when(F.count("value") > 0, F.count_if(has)).alias(f"n_values_{name}"),
            F.min(F.when(has, F.col("value"))).alias(f"min_{name}"),
            F.max(F.when(has, F.col("value"))).alias(f"max_{name}"),
            ((at(low) + at(high)) / 2).alias(f"median_{name}"),
        ]
    sums = [F.sum(n).alias(n) for n in ("n_first", "n_final", "n_dropped")]
    return counted.groupBy("key", "period_start_us").agg(*sums, *aggs)
