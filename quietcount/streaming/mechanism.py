"""The mechanism on a stream, as a stateful operator with typed state.

A step is a window of event time. For each key the state store holds one row of numbers and a map of the users that the current
round has seen, so a micro-batch touches only keys that have rows or whose release is due. A predicted release is an event-time
timer: it fires when the watermark has passed its step. After the last step a timer frees everything a key has. A
micro-batch that runs again after a failure starts from the same state and draws the same noise, so it releases the same.

The step count is a privacy budget: parameters and secret are persisted in the stream's folder, and other parameters on the
same folder are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quietcount.functions.text import DUMMY, round_release
from quietcount.operators.histogram import Mechanism

RELEASES = "key string, step int, noisy double"
_STATE = "count double, buffer double, released double, open boolean, rounds int, due int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Clock:
    """Steps of ``tick_ms`` from ``start_ms`` on."""

    tick_ms: int = 5_000
    start_ms: int = 0

    def end(self, step: int) -> int:
        return self.start_ms + (step + 1) * self.tick_ms


class KeySelection(StatefulProcessor):
    """One key through time: counts users, releases or predicts, and sleeps until its timer or its next row."""

    def __init__(self, m: Mechanism, clock: Clock):
        self.m, self.clock = m, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        self.users = handle.getMapState("users", "user string", "step int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf = pdf[(pdf["step"] >= 0) & (pdf["step"] < self.m.steps)]
        s, out = self._load(), []
        for t, own in pdf.groupby("step", sort=True):
            while s["due"] is not None and s["due"] < t:
                self._check(key[0], s, s["due"], out)
            if not s["open"]:
                s["open"], s["count"] = True, 0.0
                s["rounds"] += 1
                self.users.clear()
            s["buffer"] += float(own["value"].sum())
            for user in own["user"].unique():
                if not self.users.containsKey((user,)):
                    self.users.updateValue((user,), (int(t),))
                    s["count"] += 1
            if not self._check(key[0], s, int(t), out):
                due = self.m.due(self._noise(key[0], s), np.array([s["count"]]), int(t))[0]
                s["due"] = int(due) if due >= 0 else None
        self._save(s)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        now = expiredTimerInfo.getExpiryTimeInMs()
        while s["due"] is not None and self.clock.end(s["due"]) <= now:
            self._check(key[0], s, s["due"], out)
        if now >= self.clock.end(self.m.steps - 1):  # the budget is spent
            self.state.clear()
            self.users.clear()
        else:
            self._save(s)
        yield self._rows(out)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        names = ("count", "buffer", "released", "open", "rounds", "due")
        kept = self.state.get() if self.state.exists() else (0.0, 0.0, 0.0, False, 0, -1)
        s = dict(zip(names, kept, strict=True))
        return s | {"due": None if s["due"] < 0 else s["due"]}

    def _save(self, s: dict) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(self.clock.end(self.m.steps - 1))
        if s["due"] is not None:
            self.handle.registerTimer(self.clock.end(s["due"]))
        self.state.update((s["count"], s["buffer"], s["released"], s["open"], s["rounds"], -1 if s["due"] is None else s["due"]))

    def _noise(self, key: str, s: dict) -> np.ndarray:
        return self.m.paths([key], "key", [s["rounds"] - 1])

    def _check(self, key: str, s: dict, t: int, out: list) -> bool:
        s["due"] = None
        if s["count"] + self._noise(key, s)[0, t] < self.m.bar[t]:
            return False
        s["released"] += s["buffer"]
        out.append((key, t, s["released"] + self.m.paths([key], "hist", [0])[0, t]))
        s.update(buffer=0.0, open=False, count=0.0)
        self.users.clear()
        return True

    @staticmethod
    def _rows(out: list) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([x[0] for x in out], dtype=str), "step": pd.Series([x[1] for x in out], dtype="int32"), "noisy": pd.Series([x[2] for x in out], dtype="float64")})


def persisted(spark: SparkSession, folder: str, m: Mechanism) -> Mechanism:
    """The mechanism with the folder's secret, which is drawn once; other parameters than the folder's are refused."""
    public = f"{m.steps};{m.mu!r};{m.sigma_key!r};{m.sigma_hist!r}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/parameters")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        spark.createDataFrame([(public, m.secret)], "public string, secret binary").write.parquet(str(path))
    kept = spark.read.parquet(str(path)).first()
    if kept["public"] != public:
        raise ValueError("this folder's budget belongs to other parameters")
    out = Mechanism(m.steps, m.mu, m.sigma_key, m.sigma_hist, 0.0, bytes(kept["secret"]))
    out.bar = m.bar
    return out


def releases(stream: DataFrame, m: Mechanism, clock: Clock, time: str = "ts", late: str = "0 seconds") -> DataFrame:
    """(key, step, noisy) of every release over a stream of bounded and clamped (user, key, value, time) rows. Rows later than
    ``late`` go. Needs the RocksDB state store (``prepare``)."""
    step = F.floor((F.unix_millis(time) - F.lit(clock.start_ms)) / F.lit(clock.tick_ms)).cast("int")
    rows = stream.withWatermark(time, late).select(F.col("key").cast("string").alias("key"), F.col("user").cast("string").alias("user"), F.col("value").cast("double").alias("value"), step.alias("step"), time)
    return rows.groupBy("key").transformWithStateInPandas(KeySelection(m, clock), RELEASES, "Append", "EventTime")


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class StreamingHistogram:
    """Runs the mechanism over a stream; every release is appended to a table in ``folder``.

    ``processSnapshot`` and the like are hooks: ``on_release(rows, epoch)`` sees each micro-batch's releases, ``on_stale(epoch)`` each
    micro-batch without any. A micro-batch that runs again replaces its own rows.
    """

    def __init__(self, spark: SparkSession, folder: str, mechanism: Mechanism, clock: Clock = Clock(), on_release: Callable | None = None, on_stale: Callable | None = None):
        self.spark, self.folder, self.clock = spark, folder, clock
        self.mechanism = persisted(spark, folder, mechanism)
        self.on_release, self.on_stale = on_release, on_stale
        prepare(spark)

    def _sink(self, rows: DataFrame, epoch: int) -> None:
        path = f"{self.folder}/releases/epoch={epoch}"
        rows.write.mode("overwrite").parquet(path)
        kept = self.spark.read.parquet(path)
        if kept.limit(1).count():
            if self.on_release:
                self.on_release(kept, epoch)
        elif self.on_stale:
            self.on_stale(epoch)

    def start(self, stream: DataFrame, time: str = "ts", late: str = "0 seconds", **trigger) -> StreamingQuery:
        """trigger: processingTime="5 seconds" (the default), or availableNow=True."""
        sink = releases(stream, self.mechanism, self.clock, time, late).writeStream.foreachBatch(lambda df, n: self._sink(df, int(n)))
        return sink.option("checkpointLocation", f"{self.folder}/checkpoint").outputMode("append").trigger(**(trigger or {"processingTime": "5 seconds"})).start()

    def histogram(self, step: int | None = None) -> DataFrame:
        """(key, value) of every key ever released, as of a step; the last release counts."""
        r = self.spark.read.schema(RELEASES).parquet(f"{self.folder}/releases/epoch=*")
        r = r if step is None else r.where(F.col("step") <= step)
        return r.groupBy("key").agg(round_release(F.max_by("noisy", "step")).alias("value"))


def run_bounded(query: StreamingQuery, max_epochs: int = -1, poll_s: float = 0.2) -> int:
    """Wait until a query has finished ``max_epochs`` micro-batches, then stop it; -1: until it ends by itself. Returns how many ran."""
    if max_epochs < 0:
        query.awaitTermination()
    done = lambda: -1 if query.lastProgress is None else query.lastProgress["batchId"]
    while max_epochs >= 0 and query.isActive and done() + 1 < max_epochs:
        query.awaitTermination(poll_s)
    query.stop()
    return done() + 1


def dummy_partial(spark: SparkSession, epoch: int, producer: str) -> DataFrame:
    """Cover traffic: a partial that holds only the reserved key."""
    return spark.createDataFrame([(epoch, producer, DUMMY, 0)], "epoch int, producer_id string, key string, value long")


def with_cover(partials: DataFrame, ticks: DataFrame) -> DataFrame:
    """One partial, real or dummy, for each producer and tick from its first real one on: the traffic says nothing about the data.

    ``partials`` has (epoch, producer_id, key, value), ``ticks`` (epoch)."""
    first = partials.groupBy("producer_id").agg(F.min("epoch").alias("_first"))
    last = ticks.agg(F.max("epoch").alias("_last"))  # one row
    slots = first.join(F.broadcast(last)).select("producer_id", F.explode(F.sequence("_first", "_last")).alias("epoch"))
    empty = slots.join(partials.select("epoch", "producer_id").distinct(), ["epoch", "producer_id"], "left_anti")
    return partials.unionByName(empty.select("epoch", "producer_id", F.lit(DUMMY).alias("key"), F.lit(0).cast("long").alias("value")))
