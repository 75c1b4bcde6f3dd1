"""Synthetic contribution streams with Zipf-Mandelbrot users and keys."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.functions.noise import zipf_mandelbrot_cdf


def record_count(gb: float, bytes_per_record: int = 31) -> int:
    return max(1, math.ceil(gb * 2**30 / bytes_per_record))


def share(total: int, i: int, n: int) -> int:
    """Even split, the remainder to the first."""
    return total // n + (1 if i < total % n else 0)


def local_to_global(local: int, task: int, tasks: int) -> int:
    """Users are dealt to tasks in turn."""
    return local * tasks + task


def contributions(spark: SparkSession, users: int, keys: int, steps: int, limit: int = 32, seed: int = 42, user_law=(100_000, 26.0, 6.738), key_law=(1000.0, 1.4)) -> DataFrame:
    """(user, key, value, step): each user has min(Zipf, limit) records, each with a Zipf key and a uniform step. Every
    user's draws follow from the seed and the user alone, so the table is the same for any partitioning."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        per_user, per_key = zipf_mandelbrot_cdf(*user_law), zipf_mandelbrot_cdf(keys, *key_law)
        for pdf in it:
            n = np.minimum(np.searchsorted(per_user, pdf["u"].to_numpy(), side="left") + 1, limit)
            ids = np.repeat(pdf["id"].to_numpy(), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = _uniform(ids, at, 2 * seed), _uniform(ids, at, 2 * seed + 1)
            k = np.minimum(np.searchsorted(per_key, a, side="left") + 1, keys)
            yield pd.DataFrame({"user": ids, "key": k, "value": 1.0, "step": (b * steps).astype("int32")})

    base = spark.range(users).select("id", ((F.xxhash64(F.lit(seed), "id") / F.lit(2.0**64)) + 0.5).alias("u"))
    rows = base.mapInPandas(run, "user long, key long, value double, step int")
    return rows.select(F.col("user").cast("string").alias("user"), F.col("key").cast("string").alias("key"), "value", "step")


def budgets(spark: SparkSession, users: int, seed: int = 42, user_law=(100_000, 26.0, 6.738)) -> DataFrame:
    """(user, budget): how many records each user will give, by the Zipf-Mandelbrot law."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cdf = zipf_mandelbrot_cdf(*user_law)
        for pdf in it:
            yield pd.DataFrame({"user": pdf["id"], "budget": np.searchsorted(cdf, pdf["u"].to_numpy(), side="left") + 1})

    base = spark.range(users).select("id", ((F.xxhash64(F.lit(seed), "id") / F.lit(2.0**64)) + 0.5).alias("u"))
    return base.mapInPandas(run, "user long, budget long")


def with_refill(user_budgets: DataFrame, records: int, seed: int = 42) -> DataFrame:
    """(n, user): ``records`` records whose users are drawn in random order, each as often as its budget allows; when all budgets are
    spent they are filled anew. Rounds and users are exploded and ordered by a hash, so no user is probed for."""
    total = user_budgets.agg(F.sum("budget")).first()[0] or 0
    if not total:
        raise ValueError("no user has a budget")
    rounds = -(-records // total)
    each = user_budgets.select("user", F.explode(F.sequence(F.lit(0).cast("long"), F.col("budget") - 1)).alias("_i"))
    each = each.select("user", "_i", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_r"))
    order = each.orderBy("_r", F.xxhash64(F.lit(seed), "_r", "user", "_i"), "user", "_i").limit(records)
    return order.select(F.monotonically_increasing_id().alias("n"), "user")


class SyntheticStream:
    """A data source of a stream that never ends: ``spark.readStream.format("synthetic").options(users=, keys=, per_batch=, seed=)``.

    Each micro-batch draws ``per_batch`` records: a uniform user, dropped if the user's budget is spent, and a Zipf-Mandelbrot key.
    What a batch holds follows from its offset alone: a user's records are those of its draws that come first, and how many came
    before is recomputed from the offsets, so a batch that runs again is the same.
    """

    @staticmethod
    def register(spark: SparkSession) -> None:
        from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

        class Reader(SimpleDataSourceStreamReader):
            def __init__(self, options):
                o = {k.lower(): v for k, v in options.items()}
                self.users, self.keys, self.size, self.seed = (int(o.get(k, d)) for k, d in (("users", 1000), ("keys", 100), ("per_batch", 250), ("seed", 42)))
                self.key_cdf = zipf_mandelbrot_cdf(self.keys, 1000.0, 1.4)
                user_cdf = zipf_mandelbrot_cdf(100_000, 26.0, 6.738)
                self.budget = np.searchsorted(user_cdf, _uniform(np.arange(self.users), np.zeros(self.users), self.seed + 1), side="left") + 1

            def initialOffset(self):
                return {"at": 0}

            def _drawn(self, a: int, b: int) -> np.ndarray:
                return (_uniform(np.arange(a, b), np.zeros(b - a), self.seed + 2) * self.users).astype(np.int64)

            def readBetweenOffsets(self, start, end):
                a, b = start["at"], end["at"]
                before = np.zeros(self.users, np.int64)
                for s in range(0, a, 1 << 20):
                    before += np.bincount(self._drawn(s, min(a, s + (1 << 20))), minlength=self.users)
                user = self._drawn(a, b)
                order = np.argsort(user, kind="stable")
                place = np.empty(len(user), np.int64)
                sorted_ = user[order]
                place[order] = np.arange(len(user)) - np.searchsorted(sorted_, sorted_)
                live = before[user] + place < self.budget[user]
                key = np.minimum(np.searchsorted(self.key_cdf, _uniform(np.arange(a, b), np.ones(b - a), self.seed + 3), side="left") + 1, self.keys)
                return iter([(int(n), str(u), str(k), 1.0) for n, u, k, ok in zip(range(a, b), user, key, live, strict=True) if ok])

            def read(self, start):
                end = {"at": start["at"] + self.size}
                return self.readBetweenOffsets(start, end), end

            def commit(self, end):
                pass

        class Synthetic(DataSource):
            @classmethod
            def name(cls):
                return "synthetic"

            def schema(self):
                return "n long, user string, key string, value double"

            def simpleStreamReader(self, schema):
                return Reader(self.options)

        spark.dataSource.register(Synthetic)


def random_floats(spark: SparkSession, rows_per_second: int = 4) -> DataFrame:
    """An unbounded stream of uniform numbers in [0, 1)."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select("timestamp", F.rand().cast("float").alias("value"))


def _uniform(ids: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    u = np.uint64
    x = ids.astype(u) * u(0x9E3779B97F4A7C15) + at.astype(u) * u(0xC2B2AE3D27D4EB4F) + u(seed)
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> u(s))) * u(m)
    x ^= x >> u(31)
    return (x >> u(11)).astype(float) * 2.0**-53


def rate_replay(spark: SparkSession, dataset: DataFrame, index: str, size: int, rows_per_second: int = 4) -> DataFrame:
    """An unbounded stream of uniformly drawn entries of a numbered static dataset."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select("timestamp", F.pmod(F.xxhash64("value"), F.lit(size)).alias(index)).join(dataset, index)


def batch_plan(sizes: list[float], repetitions: int) -> list[tuple[int, float, int]]:
    """(batch, GB, records) of a micro-batch run."""
    return [(i, s, record_count(s)) for i, s in enumerate(s for s in sizes for _ in range(repetitions))]


def run_micro_batches(spark: SparkSession, plan: list[tuple[int, float, int]], process, users: int = 100_000, keys: int = 10_000, seed: int = 42, producers: int = 1) -> list[dict]:
    """Run ``process(rows, batch)`` over each batch of a plan, one after another, and return a row of measurements for each: the
    BEGIN and END of a batch are the moments before and after its action, which ends when every task has. ``process`` must run
    an action. Each batch has the plan's number of records."""
    import time

    out, parallelism = [], spark.sparkContext.defaultParallelism
    for batch, gb, records in plan:
        rows = with_refill(budgets(spark, users, seed + batch), records, seed + batch)
        rows = rows.select("n", F.col("user").cast("string").alias("user"), F.pmod(F.xxhash64("n", "user"), F.lit(keys)).cast("string").alias("key"), F.lit(1.0).alias("value"))
        begin = time.time_ns() // 1_000_000
        process(rows, batch)
        end = time.time_ns() // 1_000_000
        out.append({"run_id": 0, "parallelism": parallelism, "batch_id": batch, "size_gb": gb, "n_records": records, "bytes_per_tuple": 31, "duration_ms": end - begin, "t_begin_epoch_ms": begin, "t_end_epoch_ms": end, "producers": producers})
    return out


def completed_batches(markers: DataFrame, tasks: int) -> DataFrame:
    """(batch_id, t_begin, t_end, complete) from control markers (batch_id, task, kind, at): a batch is complete once each of its
    tasks has sent both BEGIN and END; it lasts from the first BEGIN to the last END."""
    each = markers.groupBy("batch_id", "task").agg(F.min(F.when(F.col("kind") == "BEGIN", F.col("at"))).alias("_b"), F.max(F.when(F.col("kind") == "END", F.col("at"))).alias("_e"))
    both = (F.col("_b").isNotNull() & F.col("_e").isNotNull()).cast("long")
    return each.groupBy("batch_id").agg(F.min("_b").alias("t_begin"), F.max("_e").alias("t_end"), (F.sum(both) >= tasks).alias("complete"))


def grouped(rows: DataFrame, kind: str, tasks: int, keys: list[str] | None = None) -> DataFrame:
    """How rows are dealt to tasks: ``fields`` (equal keys together), ``shuffle`` (in turn), ``local`` (as they lie, fewer tasks),
    ``global`` (one task: for small tables) or ``all`` (a broadcast: for tables that every task needs)."""
    if kind == "fields":
        return rows.repartition(tasks, *keys)
    return {"shuffle": lambda: rows.repartition(tasks), "local": lambda: rows.coalesce(tasks), "global": lambda: rows.coalesce(1), "all": lambda: F.broadcast(rows)}[kind]()


def parameter_grid(spark: SparkSession, lists: dict[str, list], floor_ms: int, hours_per_gb: float) -> DataFrame:
    """All combinations of the parameter lists (a few rows each) and a timeout that grows with the size."""
    from itertools import product

    rows = list(product(*lists.values()))
    df = spark.createDataFrame(rows, list(lists))
    return df.withColumn("timeout_ms", F.greatest(F.lit(floor_ms), F.col("size_gb") * hours_per_gb * 3.6e6))
