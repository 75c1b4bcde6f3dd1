"""Partial histograms, dummies, replay protection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.functions.text import DUMMY

#: ticks that one task merges
SPAN = 100_000


def drop_dummies(partials: DataFrame) -> DataFrame:
    """Partials that hold the reserved key, or are flagged, go as a whole."""
    flags = partials.groupBy("epoch", "producer_id").agg(F.max((F.col("key") == DUMMY).cast("int")).alias("_dummy"))
    return partials.join(flags.where("_dummy = 0").drop("_dummy"), ["epoch", "producer_id"], "left_semi")


def first_partials(partials: DataFrame, order_by: str) -> DataFrame:
    """One partial for each epoch and producer: the first to arrive."""
    first = partials.groupBy("epoch", "producer_id").agg(F.min(order_by).alias(order_by))
    return partials.join(first, ["epoch", "producer_id", order_by], "left_semi")


def completeness(partials: DataFrame, expected: int) -> DataFrame:
    return partials.groupBy("epoch").agg(F.countDistinct("producer_id").alias("received")).select("epoch", "received", F.lit(expected).cast("long").alias("expected"), (F.col("received") >= expected).alias("complete"))


def merge_partials(partials: DataFrame, expected: int | None = None) -> DataFrame:
    """Sum by epoch and key; with ``expected`` only epochs to which so many producers have reported."""
    if expected is not None:
        done = completeness(partials, expected).where("complete").select("epoch")
        partials = partials.join(done, "epoch", "left_semi")
    return partials.groupBy("epoch", "key").agg(F.sum("value").alias("value"))


def pending_epochs(partials: DataFrame, expected: int, order_by: str, most: int = 8) -> DataFrame:
    """(epoch, received, evicted) of the epochs that are not complete: an epoch is evicted once ``most`` newer ones have begun."""
    begun = partials.groupBy("epoch").agg(F.min(order_by).alias("_at"), F.countDistinct("producer_id").alias("received"))  # a row for each epoch
    newer = F.count("*").over(Window.partitionBy(F.lit(0)).orderBy("epoch").rowsBetween(1, Window.unboundedFollowing))
    return begun.withColumn("evicted", newer >= most).where(F.col("received") < expected).select("epoch", "received", "evicted")


def tick_releases(ticks: DataFrame, complete: DataFrame) -> DataFrame:
    """(tick, epoch, stale) of each tick that has anything to release: the newest complete epoch; stale if released before.
    Both tables are merged by time and the largest epoch so far is carried on: a running maximum, no join of all with all."""
    moments = complete.select(F.col("completed_tick").cast("long").alias("tick"), F.col("epoch").cast("long").alias("epoch"), F.lit(0).alias("_k"))
    moments = moments.unionByName(ticks.select(F.col("tick").cast("long").alias("tick"), F.lit(None).cast("long").alias("epoch"), F.lit(1).alias("_k")))
    # a span of ticks to a task: the running maximum within it, and the largest of the spans before it
    span = F.floor(F.col("tick") / SPAN)
    top = moments.where("_k = 0").groupBy(span.alias("_span")).agg(F.max("epoch").alias("_top"))
    spans = moments.select(span.alias("_span")).distinct().join(top, "_span", "left")  # a row for each span
    earlier = spans.select("_span", F.max("_top").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    order = Window.partitionBy("_span").orderBy("tick", "_k")
    run = F.greatest(F.col("_earlier"), F.max("epoch").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = moments.withColumn("_span", span).join(earlier, "_span").withColumn("_run", run).where("_k = 1 AND _run IS NOT NULL")
    edge = at.groupBy("_span").agg(F.max_by("_run", "tick").alias("_last"))
    before = edge.select("_span", F.lag("_last").over(Window.orderBy("_span")).alias("_before"))  # a row for each span
    previous = F.coalesce(F.lag("_run").over(Window.partitionBy("_span").orderBy("tick")), F.col("_before"))
    return at.join(before, "_span").withColumn("stale", F.coalesce(previous == F.col("_run"), F.lit(False))).select("tick", F.col("_run").cast("int").alias("epoch"), "stale")


def replay_filter(rows: DataFrame, producer: str, seq: str, arrival: list[str | Column], window: int = 128) -> DataFrame:
    """Rows that a sliding window of the last ``window`` numbers accepts: not negative, not too old, not seen before."""
    order = Window.partitionBy(producer).orderBy(*arrival)
    newest = F.max(seq).over(order.rowsBetween(Window.unboundedPreceding, -1))
    again = F.row_number().over(Window.partitionBy(producer, seq).orderBy(*arrival))
    kept = rows.withColumns({"_max": newest, "_n": again})
    return kept.where((F.col(seq) >= 0) & (F.col("_n") == 1) & (F.col("_max").isNull() | (F.col(seq) > F.col("_max") - window))).drop("_max", "_n")
