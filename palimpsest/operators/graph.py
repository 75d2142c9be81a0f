"""Weighted graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def undirected(edges: DataFrame, least_weight: float = 0.0) -> DataFrame:
    """src, dst, weight both ways; of parallel edges the heaviest."""
    e = edges.where((F.col("weight") >= least_weight) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, least_weight: float = 0.0) -> DataFrame:
    """seed, node and the fewest hops up to ``depth``, without the seeds themselves; one equi-join per hop."""
    e = undirected(edges, least_weight)
    seen = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, depth + 1):
        step = front.join(e, front.node == e.src).select("seed", F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        front = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours per node and the graph bonus min(0.02 * degree, 0.08)."""
    d = undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return d.withColumn("graph_bonus", F.least(F.col("degree") * 0.02, F.lit(0.08)))


def statistics(edges: DataFrame) -> DataFrame:
    """One row for edges (src, dst) from gists to facts: how many of each."""
    return edges.agg(F.count_distinct("src").alias("n_gists"), F.count_distinct("dst").alias("n_facts"), F.count("*").alias("n_edges"))


def shared_values(notes: DataFrame, key: str, value: str, per_value: int = 5) -> DataFrame:
    """Edges of weight 0.8 from each row to the first ``per_value`` others with the same value."""
    lead = notes.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct()
    firsts = lead.withColumn("n", F.row_number().over(W.partitionBy(value).orderBy(key))).where(F.col("n") <= per_value + 1).select(F.col(key).alias("dst"), F.col(value).alias("__v"), "n")
    pairs = lead.join(firsts, F.col(value) == F.col("__v")).where(F.col(key) != F.col("dst"))
    ranked = pairs.withColumn("r", F.row_number().over(W.partitionBy(key, value).orderBy("n"))).where(F.col("r") <= per_value)
    return ranked.select(F.col(key).alias("src"), "dst", F.lit(0.8).alias("weight")).distinct()
