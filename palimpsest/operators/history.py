"""Versions over time: superseded triples, as-of reads, slots with version chains, evolution texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.ordered import neighbour, next_known, running
from palimpsest.session import durable


# Rows of a key per bucket of a whole number that orders them.
SPAN = 100_000


def close_superseded(triples: DataFrame, keys: list[str], order: list[str], start: str, end: str, supersede: Column | None = None, span: int = SPAN) -> DataFrame:
    """Fill a null end with the start of the next superseding row of the same keys, in insertion order, which ``order`` (first a whole number) tells."""
    closes = F.when(supersede if supersede is not None else F.lit(True), F.col(start))
    return next_known(triples, keys, F.floor(F.col(order[0]) / span), order, closes, "__closed").withColumn(end, F.coalesce(end, "__closed")).drop("__closed")


def as_of(df: DataFrame, at, start: str, end: str) -> DataFrame:
    """Rows valid at a time, half-open; a null start never began, a null end is open."""
    return df.where((F.col(start) <= F.lit(at)) & (F.col(end).isNull() | (F.col(end) > F.lit(at))))


def versions(df: DataFrame, keys: list[str], value: str, order: list[str], at: str, span: int = SPAN) -> DataFrame:
    """Change points of a value per key: version from 1, previous value, valid_until; equal repeats change nothing.

    The first of ``order`` is a whole number (an instant, an id); keys are cut by spans of it.
    """
    bucket = F.floor(F.col(order[0]) / span)
    rows = df.select(*dict.fromkeys([*keys, value, *order, at]))
    seen = neighbour(rows.withColumn("__here", F.struct(F.col(value).alias("v"))), keys, bucket, order, "__here", "__before", ahead=False)
    changed = durable(seen.where(F.col("__before").isNull() | ~F.col(value).eqNullSafe(F.col("__before.v"))).withColumn("previous", F.col("__before.v")).drop("__here", "__before"))
    told = neighbour(running(changed, keys, bucket, order, F.lit(1), "version"), keys, bucket, order, at, "valid_until")
    return told.select(*keys, F.col(value), F.col("version").cast("int").alias("version"), "previous", F.col(at).alias("valid_from"), "valid_until")


def split_predicates(triples: DataFrame, many: list[str]) -> tuple[DataFrame, DataFrame]:
    """(triples that stay, rows that become annotations) by whether a predicate may have many values at once."""
    moved = F.coalesce(F.col("predicate").isin(many), F.lit(False))
    return triples.where(~moved), triples.where(moved)


def evolution_chunks(df: DataFrame, keys: list[str], value: str, order: str, size: int = 1000, span: int = 100_000) -> DataFrame:
    """keys, chunk, evolution, n: every key's values in order of a whole number, ``size`` of them to an 'a -> b -> c'.

    Rows are counted by ``span`` of the order and numbered within these from the counts before, so no key is ordered by one task.
    """
    r = df.select(*keys, order, value).withColumn("__part", F.floor(F.col(order) / span))
    sizes = r.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("__part").alias("o_part"), before.alias("__before"))
    local = r.withColumn("__i", F.row_number().over(W.partitionBy(*keys, "__part").orderBy(order, value)) - 1)
    on = F.col("__part").eqNullSafe(F.col("o_part"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    placed = local.join(offsets, on).withColumn("__i", F.col("__i") + F.col("__before"))
    ordered = F.array_sort(F.collect_list(F.struct("__i", value)))
    return placed.groupBy(*keys, F.floor(F.col("__i") / size).cast("bigint").alias("chunk")).agg(F.array_join(F.transform(ordered, lambda x: x[value]), " -> ").alias("evolution"), F.count("*").alias("n"))


def evolution(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """'a -> b -> c' per key from change points, with their number."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[value]), " -> ").alias("evolution"), F.count("*").alias("n_versions"))
