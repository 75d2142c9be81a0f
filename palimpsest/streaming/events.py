"""Event streams: filters, windows with late data, deduplication, upserts and value-count state by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.late import CLASSES


def listen(stream: DataFrame, kinds: list[str] | None = None, kind: str = "event_type") -> DataFrame:
    """Events of the given kinds, or all."""
    return stream.where(F.col(kind).isin(kinds)) if kinds else stream


def once(stream: DataFrame, event: str, at: str, delay: str) -> DataFrame:
    """Each event id once within the watermark, so the state stays bounded."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([event])


def windowed(stream: DataFrame, at: str, keys: list[str], size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per window and keys; later than the watermark is dropped.  An extension: tumbling or sliding windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, delay).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """Session windows that end after a gap.  An extension."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def emit(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to ``sink(batch, number)``; the checkpoint makes replays start where they ended."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def calling(callbacks: dict[str, list[Callable[[DataFrame], None]]], kind: str = "event_type", swallowed: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that hands every batch's events of a kind to that kind's callbacks, and all of them to those of ``*``.

    A failing callback stops neither the others nor the stream; what it said goes to ``swallowed``.
    """

    def sink(batch: DataFrame, number: int) -> None:
        for name, functions in callbacks.items():
            events = batch if name == "*" else batch.where(F.col(kind) == name)
            for f in functions:
                try:
                    f(events)
                except Exception as e:  # noqa: BLE001
                    if swallowed is not None:
                        swallowed.append(f"{number}: {name}: {e}")

    return sink


def keep_value_counts(stream: DataFrame, to_state: Callable[[DataFrame], DataFrame], root: str, checkpoint: str) -> StreamingQuery:
    """Late-event state as deltas: each micro-batch appends its value counts under its own number.

    A replayed batch overwrites its own delta, so counts stay exact; readers add up
    the deltas with ``read_value_counts``.
    """

    def sink(batch: DataFrame, number: int) -> None:
        to_state(batch).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return emit(stream, sink, checkpoint)


def read_value_counts(spark: SparkSession, root: str) -> DataFrame:
    """The state so far, all deltas added up."""
    return spark.read.parquet(root).groupBy("key", "period_start_us", "value").agg(*[F.sum(c).alias(c) for c in CLASSES])
