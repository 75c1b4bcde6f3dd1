"""The differentially private histogram over time steps.

The exact part (sums by key and step, distinct users, prefix sums) is plain aggregation. Key selection needs, for each key, how
many users a step brings that its current round has not seen. A user counts at a step if the key's last row of that user
is older than the round; so rows are aggregated to (key, step, last step of the same user) with a count and a sum. That is
at most steps x steps rows for a key, however many users it has: a hot key is pre-aggregated before it is dealt to a task,
and no user leaves the first shuffle. Each task then steps all keys of a batch through time at once, as arrays.
Released value = exact prefix + noise path, compared as such.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.functions.calibration import Calibration
from quietcount.functions.noise import generator, noise_paths, variances
from quietcount.functions.text import round_release


def step_sums(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.groupBy("step", "key").agg(F.sum(value).alias("total"))


def step_users(rows: DataFrame) -> DataFrame:
    return rows.groupBy("step", "key").agg(F.countDistinct("user").alias("users"))


def new_users(rows: DataFrame) -> DataFrame:
    """Users of a key who were not seen at an earlier step."""
    first = rows.groupBy("key", "user").agg(F.min("step").alias("step"))
    return first.groupBy("step", "key").agg(F.count("*").alias("new_users"))


def prefix_sums(sums: DataFrame) -> DataFrame:
    upto = Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("prefix", F.sum("total").over(upto))


def carry_forward(values: DataFrame, steps: int) -> DataFrame:
    """(step, key, value) for each step from a key's first release on: the last released value stays."""
    grid = values.groupBy("key").agg(F.min("step").alias("first")).select("key", F.explode(F.sequence("first", F.lit(steps - 1))).alias("step"))
    upto = Window.partitionBy("key").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(values, ["key", "step"], "left")
    return joined.select("step", "key", F.last("value", ignorenulls=True).over(upto).alias("value"))


def release_order(values: DataFrame, value: str = "value") -> DataFrame:
    return values.orderBy(F.desc(value), "key")


class Mechanism:
    """Steps keys through time; the noise of every tree follows from the secret, the key and the round."""

    def __init__(self, steps: int, mu: float, sigma_key: float, sigma_hist: float, quantile: float, secret: bytes):
        self.steps, self.mu, self.sigma_key, self.sigma_hist, self.secret = steps, mu, sigma_key, sigma_hist, secret
        self.bar = mu + np.sqrt(variances(steps, sigma_key)) * quantile

    def paths(self, keys: list[str], purpose: str, rounds: list[int]) -> np.ndarray:
        """The noise of each key's tree: a row for each key."""
        sigma = self.sigma_key if purpose == "key" else self.sigma_hist
        rngs = [generator(self.secret, k, purpose, r) for k, r in zip(keys, rounds, strict=True)] if sigma else [None] * len(keys)
        return noise_paths(self.steps, sigma, rngs)

    def due(self, noise: np.ndarray, count: np.ndarray, t: int) -> np.ndarray:
        """The first step after t at which each key's count will do, if no row comes before; -1: none."""
        if t + 1 >= self.steps or not len(count):
            return np.full(len(count), -1)
        ahead = count[:, None] + noise[:, t + 1 :] >= self.bar[t + 1 :]
        first = ahead.argmax(1)
        return np.where(ahead[np.arange(len(count)), first], t + 1 + first, -1)

    def replay(self, keys: list[str], key: np.ndarray, step: np.ndarray, before: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key number, step, noisy value) of every release. Rows: n users of ``key`` (its number) at ``step`` whose last row was at
        step ``before`` (-1: none), with the sum of their values."""
        k, hist = len(keys), np.full(len(keys), -1)
        count, buffer, released = np.zeros(k), np.zeros(k), np.zeros(k)
        start, due, rounds = np.full(k, -1), np.full(k, -1), np.zeros(k, np.int64)
        noise, hist_noise, used = np.zeros((k, self.steps)), np.zeros((k, self.steps)), 0
        order = np.argsort(step, kind="stable")
        bounds = np.searchsorted(step[order], np.arange(self.steps + 1))
        out: list[tuple] = []
        for t in range(self.steps):
            rows = order[bounds[t] : bounds[t + 1]]
            seen = np.unique(key[rows])
            np.add.at(buffer, key[rows], total[rows])
            fresh = seen[start[seen] < 0]  # a round begins
            if len(fresh):
                start[fresh], count[fresh] = t, 0
                noise[fresh] = self.paths([keys[i] for i in fresh], "key", rounds[fresh].tolist())
                rounds[fresh] += 1
            np.add.at(count, key[rows], n[rows] * (before[rows] < start[key[rows]]))
            active = np.union1d(seen, np.flatnonzero(due == t))
            goes = active[count[active] + noise[active, t] >= self.bar[t]]
            if len(goes):
                new = goes[hist[goes] < 0]
                hist[new] = np.arange(used, used + len(new))
                hist_noise[hist[new]] = self.paths([keys[i] for i in new], "hist", [0] * len(new))
                used += len(new)
                released[goes] += buffer[goes]
                out.append((goes, np.full(len(goes), t), released[goes] + hist_noise[hist[goes], t]))
                buffer[goes], start[goes], due[goes], count[goes] = 0, -1, -1, 0
            wait = np.setdiff1d(seen, goes, assume_unique=True)
            due[wait] = self.due(noise[wait], count[wait], t)
        join = lambda i, kind: np.concatenate([x[i] for x in out]).astype(kind) if out else np.zeros(0, kind)
        return join(0, np.int64), join(1, np.int32), join(2, np.float64)


def mechanism(steps: int, mu: float, c: Calibration | None, secret: bytes | None = None) -> Mechanism:
    """Without a calibration there is no noise and no threshold above mu: for tests and oracles only. The secret is drawn
    once, here, so that a task that runs again cannot draw other noise."""
    if c is None:
        return Mechanism(steps, mu, 0.0, 0.0, 0.0, b"")
    return Mechanism(steps, mu, c.sigma_key, c.sigma_hist, c.quantile, secret or os.urandom(32))


def user_gaps(rows: DataFrame) -> DataFrame:
    """(key, step, before, n, total): how many users of a key at a step had their last row for it at step ``before`` (-1: none),
    and the sum of their values."""
    each = rows.groupBy("key", "user", "step").agg(F.sum("value").alias("value"))
    before = F.coalesce(F.lag("step").over(Window.partitionBy("key", "user").orderBy("step")), F.lit(-1))
    return each.withColumn("before", before).groupBy("key", "step", "before").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("total"))


#: keys that a task steps through time at once, and rows at which it stops gathering keys
KEYS, ROWS = 2048, 1 << 20


def dp_releases(rows: DataFrame, m: Mechanism) -> DataFrame:
    """(key, step, noisy) for every release, from bounded and clamped (user, key, value, step) rows."""
    gaps = user_gaps(rows.where((F.col("step") >= 0) & (F.col("step") < m.steps)).withColumns({"key": F.col("key").cast("string"), "step": F.col("step").cast("int")}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def replay(table: pa.Table) -> pa.RecordBatch:
            names = table.column("key").combine_chunks().dictionary_encode()
            names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
            keys = names.dictionary.to_pylist()
            own = [np.asarray(table.column(c).combine_chunks()) for c in ("step", "before", "n", "total")]
            k, t, v = m.replay(keys, np.asarray(names.indices), *own)
            return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(k)), pa.array(t), pa.array(v)], ["key", "step", "noisy"])

        def split(table: pa.Table, whole: bool) -> tuple[list[pa.Table], pa.Table]:
            """Pieces of at most KEYS keys that are complete, and the rest."""
            key = table.column("key").combine_chunks()
            new = np.flatnonzero(np.concatenate([[True], np.asarray(key.slice(1).to_numpy(zero_copy_only=False) != key.slice(0, len(key) - 1).to_numpy(zero_copy_only=False))])) if len(key) else np.zeros(0, int)
            ends = [*new[KEYS::KEYS].tolist(), len(key) if whole else int(new[-1])] if len(new) else []
            pieces, at = [], 0
            for e in sorted(set(ends)):
                if e > at:
                    pieces.append(table.slice(at, e - at))
                at = e
            return pieces, table.slice(at)

        rows_held = 0
        for batch in batches:
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held >= ROWS:
                pieces, rest = split(pa.Table.from_batches(held), False)
                yield from (replay(p) for p in pieces)
                held, rows_held = rest.to_batches(), rest.num_rows
        if held:
            yield from (replay(p) for p in split(pa.Table.from_batches(held), True)[0])

    dealt = gaps.repartition("key").sortWithinPartitions("key", "step", "before")
    return dealt.mapInArrow(run, "key string, step int, noisy double")


def dp_histogram(rows: DataFrame, m: Mechanism) -> DataFrame:
    """The last histogram: (key, value), each key's last released value, rounded and never negative."""
    return dp_releases(rows, m).groupBy("key").agg(round_release(F.max_by("noisy", "step")).alias("value"))
