"""Orders within keys of any size, in two levels.

Rows of a key are cut into buckets that follow the order (hours of a time, spans
of a number, heads of an id).  What can be told inside a bucket is told there;
one small row per bucket carries the rest over the borders.  So no key is
ordered by one task, however large, as long as its rows spread over buckets.

``order`` are column names, ascending, nulls first; ``bucket`` must rise with them.
Null keys are a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _joined(rows: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is told of their bucket (``told``: keys, __b and more)."""
    named = told.select(*[F.col(k).alias(f"__o_{k}") for k in keys], F.col("__b").alias("__o_b"), *[c for c in told.columns if c not in (*keys, "__b")])
    on = F.col("__b").eqNullSafe(F.col("__o_b"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    return rows.join(named, on, "left").drop("__o_b", *[f"__o_{k}" for k in keys])


def running(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``, the sum of ``value`` over the rows of the same keys up to each row."""
    r = rows.withColumns({"__b": bucket, "__v": value})
    sums = r.groupBy(*keys, "__b").agg(F.sum("__v").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = r.withColumn("__c", F.sum("__v").over(W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    both = _joined(local, sums.select(*keys, "__b", before.alias("__before")), keys)
    return both.withColumn(out, F.col("__c") + F.col("__before")).drop("__b", "__v", "__c", "__before")


def neighbour(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str, ahead: bool = True) -> DataFrame:
    """Add ``out``, the value of the next row of the same keys (or the one before), null where there is none."""
    r = rows.withColumn("__b", bucket)
    w = W.partitionBy(*keys, "__b").orderBy(*order)
    shift, end = (F.lead, F.min) if ahead else (F.lag, F.max)
    edges = r.groupBy(*keys, "__b").agg(end(F.struct(*order, F.col(value).alias("__v"))).alias("__e"))
    across = edges.select(*keys, "__b", shift(F.struct(F.col("__e.__v").alias("v"))).over(W.partitionBy(*keys).orderBy("__b")).alias("__next"))
    local = r.withColumns({"__in": shift(F.struct(F.col(value).alias("v"))).over(w)})
    both = _joined(local, across, keys)
    return both.withColumn(out, F.coalesce("__in", "__next")["v"]).drop("__b", "__in", "__next")


def next_known(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``, the first value that is not null among the later rows of the same keys."""
    r = rows.withColumns({"__b": bucket, "__v": value})
    # Read backwards the frame only grows, so each row costs the same.
    later = W.partitionBy(*keys, "__b").orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, -1)
    firsts = r.groupBy(*keys, "__b").agg(F.min(F.when(F.col("__v").isNotNull(), F.struct(*order, "__v"))).alias("__e"))
    beyond = W.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)
    across = firsts.select(*keys, "__b", F.last(F.col("__e.__v"), ignorenulls=True).over(beyond).alias("__next"))
    both = _joined(r.withColumn("__in", F.last("__v", ignorenulls=True).over(later)), across, keys)
    return both.withColumn(out, F.coalesce("__in", "__next")).drop("__b", "__v", "__in", "__next")


def beyond_newest(rows: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """Rows with ``__old``, whether ``keep`` or more rows of the same keys come after them: told by the ``keep``-th last row alone, which needs no whole order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    last = rows.withColumn("__n", n).where(F.col("__n") <= keep).where(F.col("__n") == keep).select(*keys, F.struct(*order).alias("__last"), F.lit(1).alias("__b"))
    both = _joined(rows.withColumn("__b", F.lit(1)), last, keys)
    return both.withColumn("__old", F.coalesce(F.struct(*order) < F.col("__last"), F.lit(False))).drop("__b", "__last")
