"""Event tables: order, expansion and stops as set operations, and a Structured Streaming feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.draws import uniform
from ..operators.schedule import PriorityType


def _order(seed: int | None, priority_range: tuple[float, float]) -> tuple[Column, Column]:
    """What orders the events of a tick, before order_idx.

    FIRST events come first and LAST ones last, by order_idx. Between them BY_PRIORITY events rise by priority, and RANDOM
    ones take a draw from priority_range as theirs, so that they fall anywhere among them.
    """
    kind = F.col("priority_type")
    low, high = priority_range
    drawn = uniform("order_idx", 0, 0, seed) * (high - low) + low
    group = F.when(kind == int(PriorityType.FIRST), 0).when(kind == int(PriorityType.LAST), 2).otherwise(1)
    value = F.when(kind == int(PriorityType.BY_PRIORITY), F.col("priority")).when(kind == int(PriorityType.RANDOM), drawn).otherwise(0.0)
    return group, value


def placed(events: DataFrame, keep: Callable[[DataFrame, str], DataFrame], seed: int | None = None, priority_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """events (at, priority_type, priority, order_idx) with place, that of an event within its tick, from 1.

    Events are sorted by ranges of (tick, order), which cut a crowded tick in several tasks, and numbered by what the ranges
    before hold of the same tick. keep(df, name) writes the sorted table, since numbers depend on its ranges.
    """
    group, value = _order(seed, priority_range)
    keys = ["at", "_group", "_value", "order_idx"]
    rows = events.withColumns({"_group": group, "_value": value})
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    rows = keep(rows.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "events")
    sizes = rows.groupBy("at", "_range").agg(F.count("*").alias("size"), F.min("_row").alias("first"))  # a row for each tick and range
    before = F.coalesce(F.sum("size").over(Window.partitionBy("at").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("at", "_range", "first", before.alias("before"))
    place = (F.col("before") + F.col("_row") - F.col("first") + 1).cast("int")
    return rows.join(starts, ["at", "_range"]).select(*events.columns, place.alias("place"))


def next_tick(events: DataFrame) -> DataFrame:
    """The smallest tick, -1 if there are no events."""
    return events.agg(F.coalesce(F.min("at"), F.lit(-1)).alias("tick"))


def current(events: DataFrame, tick: float) -> DataFrame:
    """Events that can still run at a tick: those before it are dropped."""
    return events.filter(F.col("at") >= tick)


def until_stop(events: DataFrame, stop_at: float) -> DataFrame:
    """What runs before a stop: the whole of its tick, nothing after."""
    return events.filter(F.col("at") <= stop_at)


def expand_repeating(spark: SparkSession, events: DataFrame, until: float) -> DataFrame:
    """(order_idx, at) for each time that events (order_idx, at, interval) come, up to and including `until`.

    Ticks are sums, one interval after the other, as a running schedule makes them. Intervals are positive.
    """
    steps = F.floor((F.lit(until) - F.col("at")) / F.col("interval")).cast("int") + 2
    listed = events.select("order_idx", "at", "interval", F.explode(F.sequence(F.lit(0), F.greatest(steps, F.lit(0)))).alias("i"))
    term = F.when(F.col("i") == 0, F.col("at").cast("double")).otherwise(F.col("interval"))
    so_far = Window.partitionBy("order_idx").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return listed.select("order_idx", F.sum(term).over(so_far).alias("at")).filter(F.col("at") <= until)


def tick_counts(events: DataFrame, lateness: str = "1 hour", tick: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by tick and type from a batch or a stream of (ts, event_type, value); on a stream, late ones are dropped.

    slide: how far apart ticks begin, if they overlap.
    """
    seen = events.withWatermark("ts", lateness) if events.isStreaming else events
    by = seen.groupBy(F.window("ts", tick, slide).alias("tick"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("tick.start").alias("at"), "event_type", "n", "total")


def start_feed(events: DataFrame, path: str, checkpoint: str, lateness: str = "1 hour") -> StreamingQuery:
    """Writes finished ticks of a stream of events as Parquet, each once, and ends when what is there has been read."""
    writer = tick_counts(events, lateness).writeStream.outputMode("append").format("parquet")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
