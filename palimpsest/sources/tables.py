"""Reading of the named tables and of clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.instants import known_zone

# A clock table longer than this is joined by shuffle instead of broadcast.
CLOCK_BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_clock(df: DataFrame, clocks: DataFrame, key: str) -> DataFrame:
    """Add ``__zone`` and ``__locale`` of the row's clock (null key or unknown clock: null).

    The clock table is broadcast only when a counted limit shows that it is small.
    Repeated clock rows count once; of conflicting ones the smallest zone holds.
    """
    small = (
        clocks.where(F.col("clock_id").isNotNull())
        .groupBy(F.col("clock_id").alias("__clock"))
        .agg(F.min(F.struct(F.col("zone_name"), F.col("locale"))).alias("__c"))
        .select("__clock", known_zone(F.col("__c.zone_name")).alias("__zone"), F.col("__c.locale").alias("__locale"))
    )
    if clocks.limit(CLOCK_BROADCAST_ROWS + 1).count() <= CLOCK_BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, df[key] == F.col("__clock"), "left").drop("__clock")
