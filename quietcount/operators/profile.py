"""Analytics over profiler rows and run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latency_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one row), count, least and most."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def final_counters(rows: DataFrame, by: list[str], task: str, total: str) -> DataFrame:
    """Each task's final (largest) total, summed over tasks."""
    return rows.groupBy(*by, task).agg(F.max(total).alias("_t")).groupBy(*by).agg(F.sum("_t").alias("total"), F.count("*").alias("tasks"))


def lag_difference(rows: DataFrame, by: list[str], order: str, value: str, name: str, first_is_own: bool = False) -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    d = F.col(value) - before
    return rows.withColumn(name, F.coalesce(d, F.col(value)) if first_is_own else d)


def rolling_std(rows: DataFrame, by: list[str], order: str, value: str, name: str, width: int = 5) -> DataFrame:
    """Sample deviation of up to ``width`` rows; one row alone has none."""
    return rows.withColumn(name, F.stddev_samp(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, 0)))


def compliance(rows: DataFrame, by: list[str], delta: str, tick: float, tolerance: float = 0.2) -> DataFrame:
    """How many intervals keep to the tick within the tolerance."""
    off = F.abs(F.col(delta) - tick) > tolerance * tick
    return rows.where(F.col(delta).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(off.cast("long")).alias("violations"), (1 - F.sum(off.cast("long")) / F.count("*")).alias("compliance"),
        F.avg(delta).alias("mean"), F.stddev_pop(delta).alias("std"), F.max(F.abs(F.col(delta) - tick)).alias("max_deviation"), (F.stddev_pop(delta) / tick).alias("irregularity"),
    )


def span_durations(starts: DataFrame, ends: DataFrame, on: list[str], at: str) -> DataFrame:
    return starts.withColumnRenamed(at, "_s").join(ends.withColumnRenamed(at, "_e"), on).select(*on, (F.col("_e") - F.col("_s")).alias("duration"))


def matched_pairs(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """Pairs with equal parameters, nulls being equal; ratio of right to left, null for a zero."""
    r = right.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(value).alias("_v"))
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(r, cond).select(*on, F.col(value).alias("base"), F.col("_v").alias("other"), (F.col("_v") / F.nullif(F.col(value), F.lit(0))).alias("ratio"))


def pivot_counts(rows: DataFrame, by: str, over: str, values: list) -> DataFrame:
    return rows.groupBy(by).pivot(over, values).count().na.fill(0)


def scaling_efficiency(rows: DataFrame, by: list[str], x: str, throughput: str) -> DataFrame:
    """Mean throughput over what the smallest x would give if it scaled in proportion."""
    mean = rows.groupBy(*by, x).agg(F.avg(throughput).alias("throughput"))
    w = Window.partitionBy(*by).orderBy(x)
    return mean.withColumn("efficiency", F.col("throughput") / (F.first("throughput").over(w) * F.col(x) / F.first(x).over(w)))


def relative_change(rows: DataFrame, by: list[str], mode: str, base: str, value: str) -> DataFrame:
    """Percent by which each mode differs from the base mode."""
    ref = rows.where(F.col(mode) == base).select(*by, F.col(value).alias("_b"))
    return rows.join(ref, by).select(*by, mode, value, (100 * (F.col(value) - F.col("_b")) / F.nullif(F.col("_b"), F.lit(0))).alias("change_pct"))


def outlier_cut(rows: DataFrame, by: list[str], value: str, q: float = 0.85) -> DataFrame:
    """Rows at or below their group's interpolated quantile."""
    cut = rows.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("cut"))
    return rows.join(cut, by).where(F.col(value) <= F.col("cut"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = rows.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def varying(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Which columns have more than one value, null being one."""
    n = lambda c: F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))
    one = rows.agg(*[n(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) > 1).alias("varies")) for c in columns])).alias("p")).select("p.*")


def emission_ratio(real: Column, dummy: Column) -> Column:
    return real / F.greatest(F.lit(1), real + dummy)


def idle_time(active: Column, accounted: Column) -> Column:
    return F.greatest(F.lit(0), active - accounted)


def running_total(rows: DataFrame, by: list[str], order: str, value: str, name: str = "running") -> DataFrame:
    """Cumulative total within each group; a window's statistics are reset after each dump, totals are kept."""
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def last_gauges(rows: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """A gauge is its last write."""
    return rows.groupBy(*by).agg(F.max_by(value, at).alias("gauge"))


def run_progress(rows: DataFrame, by: list[str], task: str, epoch: str) -> DataFrame:
    """Tasks that have reported, the newest epoch, and the epochs that every task has reached."""
    each = rows.groupBy(*by, task).agg(F.max(epoch).alias("_e"))
    return each.groupBy(*by).agg(F.count("*").alias("tasks"), F.max("_e").alias("max_epoch"), F.min("_e").alias("all_reached"))


def distinct_configs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The combinations of parameters that runs have, with the number of runs of each."""
    return rows.groupBy(*columns).agg(F.count("*").alias("runs"))


def report_average(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means over the runs of a configuration; a lone run has none."""
    return rows.groupBy(*by).agg(F.count("*").alias("runs"), *[F.avg(m).alias(m) for m in metrics]).where("runs > 1")


def pivot_values(rows: DataFrame, by: str, over: str, values: list, value: str, how: str = "mean") -> DataFrame:
    """A column for each of ``values`` with the mean or sum of ``value``."""
    return rows.groupBy(by).pivot(over, values).agg({"mean": F.avg, "sum": F.sum, "count": F.count}[how](value))


def quartiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Interpolated quartiles and the ends of a box plot's whiskers: the outermost values within 1.5 box lengths."""
    q = rows.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    low, high = F.col("_q")[0], F.col("_q")[2]
    inside = (F.col(value) >= low - 1.5 * (high - low)) & (F.col(value) <= high + 1.5 * (high - low))
    held = rows.join(q, by)
    return held.groupBy(*by).agg(F.first("_q").alias("_q"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high")).select(*by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "low", "high")


def discrete_quantiles(rows: DataFrame, by: list[str], value: str, shares=(0.5, 0.9, 0.99)) -> DataFrame:
    """Quantiles by index: the value at place floor(share x n) of the sorted values, the last at most. Equal values are counted
    first, so a group costs a row for each different value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    placed = counts.withColumns({"_upto": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    at = lambda p: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_all") * p), F.col("_all") - 1), F.col(value))).alias(f"p{round(p * 100)}")
    return placed.groupBy(*by).agg(*[at(p) for p in shares])


def verdict(ratio: Column, tolerance: float = 0.2) -> Column:
    """Whether a ratio to the expected value lies within the tolerance of one."""
    return F.when(F.abs(ratio - 1) <= tolerance, "OK").otherwise("OFF")


def first_markers(rows: DataFrame, by: list[str], epoch: str, at: str) -> DataFrame:
    """The earliest of repeated markers of an epoch."""
    return rows.groupBy(*by, epoch).agg(F.min(at).alias(at))


def sorted_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted by several keys; a null number stands as -1 and a null text as the empty one."""
    kinds = dict(rows.dtypes)
    return rows.orderBy(*[F.coalesce(F.col(c), F.lit("") if kinds[c] == "string" else F.lit(-1)) for c in keys])


def shared_parameters(rows: DataFrame, mode: str, modes: list[str], columns: list[str]) -> DataFrame:
    """Rows whose parameters, nulls being equal, occur in every one of ``modes``."""
    shared = rows.where(F.col(mode).isin(*modes)).groupBy(*columns).agg(F.countDistinct(mode).alias("_m")).where(F.col("_m") == len(modes))
    r = shared.select(*[F.col(c).alias(f"_{c}") for c in columns])
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.where(F.col(mode).isin(*modes)).join(r, cond, "left_semi")


def catalog_lookup(rows: DataFrame, index: str, catalog: list[str], name: str = "entry") -> DataFrame:
    """The catalog's entry at each row's index, from 0; null outside. The catalog is a list in the program, so it is a literal."""
    entries = F.array(*[F.lit(x) for x in catalog])
    return rows.withColumn(name, F.get(entries, F.col(index).cast("int")))


def elapsed(rows: DataFrame, at: str, by: list[str] | None = None, name: str = "elapsed_s") -> DataFrame:
    """Seconds since the first timestamp of the run (or of each group)."""
    millis = F.unix_millis(F.col(at).cast("timestamp"))
    if by:
        first = rows.groupBy(*by).agg(F.min(millis).alias("_first"))
        return rows.join(first, by).withColumn(name, (millis - F.col("_first")) / 1000.0).drop("_first")
    first = rows.agg(F.min(millis).alias("_first"))  # one row
    return rows.join(F.broadcast(first)).withColumn(name, (millis - F.col("_first")) / 1000.0).drop("_first")


def lifecycle(rows: DataFrame) -> DataFrame:
    """The lifecycle rows of a profile: (timestamp, component, taskId, event, epoch)."""
    return rows.where("type = 'lifecycle'").select("timestamp", "component", "taskId", F.col("name").alias("event"), F.col("total").alias("epoch"))


def selected(rows: DataFrame, **allowed: list | None) -> DataFrame:
    """Rows whose columns are in the lists given; None allows all."""
    for c, values in allowed.items():
        if values is not None:
            rows = rows.where(F.col(c).isin(*values))
    return rows


def run_summary(profile_rows: DataFrame, by: list[str], tick_ms: float) -> DataFrame:
    """One row for each component: progress, epoch and snapshot durations, waiting, active and idle time, latency, counters, gauges
    and how well emissions keep to the tick, from (component, taskId, type, name, total, sampled, avgMs, timestamp) rows.

    Lifecycle events pair up by task and epoch: ``epoch_start``, ``snapshot_start`` with ``snapshot_end``, ``barrier_wait`` with
    ``barrier_release`` and ``emit``. Timers weigh their mean by calls.
    """
    rows = profile_rows.withColumn("_ms", F.unix_millis(F.col("timestamp").cast("timestamp")))
    life = rows.where("type = 'lifecycle'").select(*by, "taskId", F.col("name").alias("event"), F.col("total").alias("epoch"), F.col("_ms").alias("at"))
    event = lambda name: life.where(F.col("event") == name).groupBy(*by, "taskId", "epoch").agg(F.min("at").alias("at"))
    mean = lambda df, c, name: df.groupBy(*by).agg(F.avg(c).alias(name))
    task = [*by, "taskId"]
    starts = lag_difference(event("epoch_start"), task, "epoch", "at", "gap")
    snapshots = span_durations(event("snapshot_start"), event("snapshot_end"), [*task, "epoch"], "at")
    waits = span_durations(event("barrier_wait"), event("barrier_release"), [*task, "epoch"], "at")
    emits = lag_difference(event("emit"), task, "epoch", "at", "gap")
    span = rows.groupBy(*task).agg((F.max("_ms") - F.min("_ms")).alias("active_ms"))
    timers = rows.where("type = 'timer'").withColumn("_w", F.col("avgMs") * F.col("sampled"))
    busy = timers.groupBy(*task).agg(F.sum("_w").alias("busy_ms"))
    time = span.join(busy, task, "left").groupBy(*by).agg(F.sum("active_ms").alias("active_ms"), F.sum(idle_time(F.col("active_ms"), F.coalesce("busy_ms", F.lit(0.0)))).alias("idle_ms"))
    latency = timers.groupBy(*by).agg((F.sum("_w") / F.nullif(F.sum("sampled"), F.lit(0))).alias("latency_ms"), F.sum("sampled").alias("calls"))
    counters = final_counters(rows.where("type = 'counter'"), [*by, "name"], "taskId", "total").groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "total")))).alias("counters"))  # a row for each name
    gauges = last_gauges(rows.where("type = 'gauge'"), [*by, "name"], "_ms", "total").groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "gauge")))).alias("gauges"))
    out = run_progress(life, by, "taskId", "epoch")
    for part in (mean(starts, "gap", "epoch_ms"), mean(snapshots, "duration", "snapshot_ms"), mean(waits, "duration", "wait_ms"), time, latency, counters, gauges, compliance(emits, by, "gap", tick_ms).select(*by, "compliance", "irregularity")):
        out = out.join(part, by, "left")
    return out


def tuple_sizes(rows: DataFrame) -> DataFrame:
    """Mean, least, most and quantiles by index (50, 90, 99 %) of the rows' serialised size in bytes, as compact JSON."""
    sizes = rows.select(F.octet_length(F.to_json(F.struct(*rows.columns))).alias("bytes"), F.lit(0).alias("_g"))
    whole = sizes.groupBy("_g").agg(F.avg("bytes").alias("mean"), F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    return whole.join(discrete_quantiles(sizes, ["_g"], "bytes"), "_g").drop("_g")
