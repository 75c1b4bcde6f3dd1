"""Accuracy against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ground_truth(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count("*").alias("truth"))


def error_norms(released: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: keys released, keys positive, and the norms of the difference over the union of keys."""
    both = released.select("key", "value", F.lit(1).alias("_r")).join(truth, "key", "full_outer")
    d = F.abs(F.coalesce("value", F.lit(0)) - F.coalesce("truth", F.lit(0)))
    return both.agg(
        F.count("_r").alias("keys_released"), F.count(F.when(F.col("value") > 0, 1)).alias("keys_positive"), F.count("truth").alias("keys_true"),
        F.max(d).alias("l_inf"), F.sum(d).alias("l1"), F.sqrt(F.sum(d * d)).alias("l2"),
    )


def run_statistics(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population standard deviation over runs."""
    return runs.groupBy(*by).agg(*[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])
