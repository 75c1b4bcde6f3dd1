"""The library's queries over the driver's tables and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.functions import calibration, envelope, text
from quietcount.operators import bounding, histogram, merge, metrics, profile
from quietcount.params import CompositionMode, DPParams
from quietcount.sources import generator

STEPS = 30
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- inputs: the events table as a contribution stream and as profiler rows

_EV = """ev AS (SELECT event_id, ts, user_id AS "user", event_type, value AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  event_type || ':' || json_extract_string(props, '$.k') AS key, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS step, CAST(1 AS BIGINT) AS n FROM events)"""
_BOUND = """b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) AS rn FROM ev) WHERE rn <= 32)"""


def events(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", "ts", F.col("user_id").alias("user"), "event_type", F.col("value").alias("amount"), k.cast("long").alias("k"), F.concat_ws(":", "event_type", k).alias("key"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("step"), F.lit(1).cast("long").alias("n"))


def bounded(spark, sf_dir) -> DataFrame:
    return bounding.bound_records(events(spark, sf_dir), "user", ["ts", "event_id"], 32)


def stream(spark, sf_dir) -> DataFrame:
    return bounded(spark, sf_dir).select("user", "key", "step", F.col("n").alias("value"))


_PROF = """pr AS (SELECT event_type AS component, "user" % 4 AS task, step AS epoch, count(*) AS calls, max(event_id) AS total, min(event_id) AS low,
  CAST(epoch_us(min(ts)) // 1000 AS BIGINT) AS t0, CAST(epoch_us(max(ts)) // 1000 AS BIGINT) AS t1 FROM ev GROUP BY ALL)"""


def profiler(spark, sf_dir) -> DataFrame:
    """One row for each component, task and epoch."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("component"), (F.col("user") % 4).alias("task"), F.col("step").alias("epoch")).agg(
        F.count("*").alias("calls"), F.max("event_id").alias("total"), F.min("event_id").alias("low"), ms(F.min("ts")).alias("t0"), ms(F.max("ts")).alias("t1")
    )


def rnd(c, n: int = 6):
    return F.round(c, n)


# ---- bounding and clamping


@query(f"WITH {_EV}, {_BOUND} SELECT event_id, \"user\", key, step FROM b")
def bound_records(spark, d):
    return bounded(spark, d).select("event_id", "user", "key", "step")


@query(f"""WITH {_EV}, w AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY "user" ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ev WHERE k > 0)
SELECT event_id, "user", CAST(least(k, 500 - used) AS BIGINT) AS accepted FROM w WHERE used < 500""")
def bound_weighted(spark, d):
    return bounding.bound_weighted(events(spark, d), "user", "k", ["ts", "event_id"], 500).select("event_id", "user", F.col("accepted").cast("long").alias("accepted"))


@query("SELECT event_id, greatest(-100.0, least(100.0, value - 200)) AS clamped FROM events")
def clamp_signed(spark, d):
    return events(spark, d).select("event_id", text.clamp(F.col("amount") - 200, 100.0).alias("clamped"))


@query("SELECT event_id, greatest(0.0, least(100.0, value - 200)) AS clamped FROM events")
def clamp_nonneg(spark, d):
    return events(spark, d).select("event_id", text.clamp(F.col("amount") - 200, 100.0, False).alias("clamped"))


@query(f"WITH {_EV} SELECT \"user\", CAST(sum(n) AS BIGINT) AS total FROM ev GROUP BY \"user\"")
def user_counts(spark, d):
    return bounding.user_totals(events(spark, d), "user", "n")


# ---- text

_WORDS = "list_filter(list_transform(regexp_split_to_array(text, '\\W+'), lambda w: trim(lower(w), ' ')), lambda w: w <> '')"


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


@query(f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words, CAST(len(list_distinct({_WORDS})) AS BIGINT) AS n_distinct FROM documents")
def word_split(spark, d):
    w = text.words(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word")
def word_count(spark, d):
    return text.split_sentences(_docs(spark, d), "text", "source").groupBy("word").agg(F.sum("count").alias("n"))


@query("""WITH t AS (SELECT source, sum(len(regexp_extract_all(text, '\\w+'))) AS total FROM documents GROUP BY source)
SELECT round(quantile_cont(total, 0.99), 4) AS bound, CAST(min(total) AS BIGINT) AS least, CAST(max(total) AS BIGINT) AS most, round(avg(total), 4) AS mean FROM t""")
def user_word_percentile(spark, d):
    rows = _docs(spark, d).select("source", F.size(F.expr(r"regexp_extract_all(text, r'\w+', 0)")).cast("long").alias("w"))
    out = bounding.bound_estimate(rows, "source", "w")
    return out.select(rnd("bound", 4).alias("bound"), "least", "most", rnd("mean", 4).alias("mean"))


@query("SELECT DISTINCT user_id, sha256('user:' || user_id) AS user_key, sha256('word:' || event_type) AS word_key, event_type FROM events")
def routing_key_sha256(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type").distinct()
    return e.select("user_id", text.user_key(F.col("user_id")).alias("user_key"), text.word_key(F.col("event_type")).alias("word_key"), "event_type")


@query("""SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, false AS has_all FROM events""")
def json_required_fields(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", text.required_fields(F.col("props"), ("k",)).alias("has_k"), text.required_fields(F.col("props")).alias("has_all"))


@query("SELECT event_id, reverse(event_type) AS reversed, lower(event_type) AS name, printf('I just got %f as random value', value) AS message FROM events")
def demo_functions(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", text.reverse_message(F.col("event_type")).alias("reversed"), text.component_name(F.col("event_type")).alias("name"), text.random_message(F.col("value")).alias("message"))


@query("SELECT event_id, CAST(greatest(0, floor(value - 100 + 0.5)) AS BIGINT) AS released FROM events")
def release_round_clamp(spark, d):
    return events(spark, d).select("event_id", text.round_release(F.col("amount") - 100).alias("released"))


# ---- the exact part of the mechanism


@query(f"WITH {_EV}, {_BOUND} SELECT step, key, CAST(sum(n) AS BIGINT) AS total FROM b GROUP BY step, key")
def step_key_sum(spark, d):
    return histogram.step_sums(stream(spark, d))


@query(f"WITH {_EV}, {_BOUND} SELECT step, key, count(DISTINCT \"user\") AS users FROM b GROUP BY step, key")
def step_key_distinct_users(spark, d):
    return histogram.step_users(stream(spark, d))


@query(f"WITH {_EV}, {_BOUND} SELECT step, key, count(*) AS new_users FROM (SELECT key, \"user\", min(step) AS step FROM b GROUP BY key, \"user\") GROUP BY step, key")
def new_users_per_step(spark, d):
    return histogram.new_users(stream(spark, d))


_SUMS = f"{_EV}, {_BOUND}, s AS (SELECT step, key, CAST(sum(n) AS BIGINT) AS total FROM b GROUP BY step, key)"


@query(f"WITH {_SUMS} SELECT step, key, total, CAST(sum(total) OVER (PARTITION BY key ORDER BY step) AS BIGINT) AS prefix FROM s")
def prefix_sum(spark, d):
    return histogram.prefix_sums(histogram.step_sums(stream(spark, d)))


@query(f"WITH {_EV}, {_BOUND} SELECT key, CAST(count(*) AS BIGINT) AS value FROM b GROUP BY key")
def hist_zero_noise_mu0(spark, d):
    """The mechanism itself without noise and threshold: every key is released with its exact sum."""
    rows = stream(spark, d).select(F.col("user").cast("string").alias("user"), "key", F.col("value").cast("double").alias("value"), "step")
    return histogram.dp_histogram(rows, histogram.mechanism(STEPS, 0, None))


_MU = 4


@query(f"""WITH RECURSIVE {_EV}, {_BOUND}, c AS (SELECT DISTINCT key, "user", step FROM b),
r(key, from_step, pos) AS (
  SELECT key, 0, min(t) FROM (SELECT key, t, count(*) FILTER (WHERE first <= t) AS m FROM (SELECT key, "user", min(step) AS first FROM c GROUP BY key, "user") u JOIN (SELECT DISTINCT key AS k2, step AS t FROM c) s ON k2 = key GROUP BY key, t) WHERE m >= {_MU} GROUP BY key
  UNION ALL
  SELECT key, f, min(t) FROM (SELECT key, f, t, count(*) FILTER (WHERE first <= t) AS m FROM (SELECT r.key, r.pos + 1 AS f, "user", min(step) AS first FROM r JOIN c ON c.key = r.key AND c.step > r.pos GROUP BY r.key, r.pos, "user") u
    JOIN (SELECT DISTINCT key AS k2, step AS t FROM c) s ON k2 = key AND t >= f GROUP BY key, f, t) WHERE m >= {_MU} GROUP BY key, f)
SELECT key, CAST(count(*) AS BIGINT) AS value FROM b JOIN (SELECT key, max(pos) AS pos FROM r GROUP BY key) USING (key) WHERE step <= pos GROUP BY key""")
def hist_zero_noise_mu_n(spark, d):
    rows = stream(spark, d).select(F.col("user").cast("string").alias("user"), "key", F.col("value").cast("double").alias("value"), "step")
    return histogram.dp_histogram(rows, histogram.mechanism(STEPS, _MU, None))


@query(f"""WITH {_SUMS}, p AS (SELECT step, key, CAST(sum(total) OVER (PARTITION BY key ORDER BY step) AS BIGINT) AS value FROM s),
g AS (SELECT key, unnest(range(min(step), {STEPS})) AS step FROM p GROUP BY key)
SELECT CAST(g.step AS INT) AS step, g.key, (SELECT max(value) FROM p WHERE p.key = g.key AND p.step <= g.step) AS value FROM g""")
def carry_forward_snapshot(spark, d):
    values = histogram.prefix_sums(histogram.step_sums(stream(spark, d))).select("step", "key", F.col("prefix").alias("value"))
    return histogram.carry_forward(values, STEPS)


@query(f"WITH {_EV} SELECT key, count(*) AS value, row_number() OVER (ORDER BY count(*) DESC, key) AS place FROM ev GROUP BY key QUALIFY place <= 20")
def topk_release_order(spark, d):
    from pyspark.sql.window import Window

    top = histogram.release_order(metrics.ground_truth(events(spark, d)).withColumnRenamed("truth", "value")).limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "key")))  # twenty rows


@query(f"WITH {_EV} SELECT key, count(*) AS truth FROM ev GROUP BY key")
def ground_truth(spark, d):
    return metrics.ground_truth(events(spark, d))


@query(f"""WITH {_EV}, {_BOUND}, r AS (SELECT key, count(*) AS value FROM b GROUP BY key), t AS (SELECT key, count(*) AS truth FROM ev GROUP BY key),
j AS (SELECT value, truth, abs(coalesce(value, 0) - coalesce(truth, 0)) AS d FROM r FULL JOIN t USING (key))
SELECT count(value) AS keys_released, count(CASE WHEN value > 0 THEN 1 END) AS keys_positive, count(truth) AS keys_true, max(d) AS l_inf, CAST(sum(d) AS BIGINT) AS l1, round(sqrt(sum(d * d)), 6) AS l2 FROM j""")
def error_norms(spark, d):
    released = stream(spark, d).groupBy("key").agg(F.sum("value").alias("value"))
    out = metrics.error_norms(released, metrics.ground_truth(events(spark, d)))
    return out.withColumn("l2", rnd("l2"))


@query(f"WITH {_EV} SELECT event_type, step, round(avg(amount), 6) AS amount_mean, round(stddev_pop(amount), 6) AS amount_std FROM ev GROUP BY event_type, step")
def run_mean_std_pop(spark, d):
    out = metrics.run_statistics(events(spark, d), ["event_type", "step"], ["amount"])
    return out.select("event_type", "step", rnd("amount_mean").alias("amount_mean"), rnd("amount_std").alias("amount_std"))


# ---- partial histograms: producer = user modulo 3

_PART = f"""{_EV}, pt AS (SELECT step AS epoch, 'p' || ("user" % 3) AS producer_id, key, CAST(count(*) AS BIGINT) AS value FROM ev GROUP BY ALL)"""


def partials(spark, d) -> DataFrame:
    e = events(spark, d)
    return e.groupBy(F.col("step").alias("epoch"), F.concat(F.lit("p"), (F.col("user") % 3).cast("string")).alias("producer_id"), "key").agg(F.count("*").alias("value"))


@query(f"WITH {_PART}, c AS (SELECT epoch FROM pt GROUP BY epoch HAVING count(DISTINCT producer_id) >= 3) SELECT epoch, key, CAST(sum(value) AS BIGINT) AS value FROM pt SEMI JOIN c USING (epoch) GROUP BY epoch, key")
def partial_merge(spark, d):
    return merge.merge_partials(partials(spark, d), 3)


@query(f"WITH {_PART} SELECT epoch, key, CAST(sum(value) AS BIGINT) AS value FROM pt GROUP BY epoch, key")
def partial_merge_dedup(spark, d):
    p = partials(spark, d).withColumn("arrival", F.lit(0))
    again = p.where("producer_id = 'p1'").withColumns({"arrival": F.lit(1), "value": F.col("value") * 7})
    return merge.merge_partials(merge.first_partials(p.unionByName(again), "arrival"))


@query(f"WITH {_PART} SELECT epoch, count(DISTINCT producer_id) AS received, CAST(3 AS BIGINT) AS expected, count(DISTINCT producer_id) >= 3 AS complete FROM pt WHERE value > 1 GROUP BY epoch")
def epoch_completeness(spark, d):
    return merge.completeness(partials(spark, d).where("value > 1"), 3)


@query(f"WITH {_PART} SELECT epoch, producer_id, key, value FROM pt WHERE NOT (producer_id = 'p2' AND epoch % 2 = 0)")
def dummy_filter(spark, d):
    p = partials(spark, d)
    cover = p.where("producer_id = 'p2' AND epoch % 2 = 0").select("epoch", "producer_id").distinct().select("epoch", "producer_id", F.lit(text.DUMMY).alias("key"), F.lit(0).cast("long").alias("value"))
    return merge.drop_dummies(p.unionByName(cover))


@query(f"""WITH {_EV}, q AS (SELECT *, event_id % 300 - 2 AS seq, "user" % 4 AS producer FROM ev),
w AS (SELECT *, max(seq) OVER (PARTITION BY producer ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, row_number() OVER (PARTITION BY producer, seq ORDER BY ts, event_id) AS c FROM q)
SELECT event_id, producer, seq FROM w WHERE seq >= 0 AND c = 1 AND (newest IS NULL OR seq > newest - 128)""")
def replay_filter(spark, d):
    rows = events(spark, d).withColumns({"seq": F.col("event_id") % 300 - 2, "producer": F.col("user") % 4})
    return merge.replay_filter(rows, "producer", "seq", ["ts", "event_id"]).select("event_id", "producer", "seq")


@query(f"""WITH {_EV}, c AS (SELECT step AS epoch, step + step % 3 AS completed_tick FROM ev GROUP BY step), t AS (SELECT unnest(range(0, {STEPS})) AS tick),
a AS (SELECT tick, max(epoch) AS epoch FROM t JOIN c ON completed_tick <= tick GROUP BY tick)
SELECT tick, epoch, coalesce(lag(epoch) OVER (ORDER BY tick) = epoch, false) AS stale FROM a""")
def tick_release(spark, d):
    complete = events(spark, d).select(F.col("step").alias("epoch")).distinct().withColumn("completed_tick", F.col("epoch") + F.col("epoch") % 3)
    return merge.tick_releases(spark.range(STEPS).select(F.col("id").alias("tick")), complete)


# ---- profiler analytics


@query(f"WITH {_EV}, {_PROF} SELECT component, round(avg(calls), 6) AS mean, round(coalesce(stddev_samp(calls), 0), 6) AS std, count(calls) AS n, min(calls) AS least, max(calls) AS most FROM pr GROUP BY component")
def latency_stats(spark, d):
    out = profile.latency_stats(profiler(spark, d), ["component"], "calls")
    return out.withColumns({"mean": rnd("mean"), "std": rnd("std")})


@query(f"WITH {_EV}, {_PROF} SELECT component, CAST(sum(t) AS BIGINT) AS total, count(*) AS tasks FROM (SELECT component, task, max(total) AS t FROM pr GROUP BY ALL) GROUP BY component")
def counter_final_sum(spark, d):
    return profile.final_counters(profiler(spark, d), ["component"], "task", "total")


@query(f"WITH {_EV}, {_PROF} SELECT component, task, epoch, t0 - lag(t0) OVER (PARTITION BY component, task ORDER BY epoch) AS duration FROM pr")
def epoch_duration_lag(spark, d):
    return profile.lag_difference(profiler(spark, d), ["component", "task"], "epoch", "t0", "duration").select("component", "task", "epoch", "duration")


@query(f"WITH {_EV}, {_PROF} SELECT component, task, epoch, coalesce(total - lag(total) OVER (PARTITION BY component, task ORDER BY epoch), total) AS delta FROM pr")
def counter_delta(spark, d):
    return profile.lag_difference(profiler(spark, d), ["component", "task"], "epoch", "total", "delta", True).select("component", "task", "epoch", "delta")


@query(f"WITH {_EV}, {_PROF} SELECT component, task, epoch, round(stddev_samp(calls) OVER (PARTITION BY component, task ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS std FROM pr")
def rolling_std5(spark, d):
    out = profile.rolling_std(profiler(spark, d), ["component", "task"], "epoch", "calls", "std")
    return out.select("component", "task", "epoch", rnd("std").alias("std"))


_DAY = 86_400_000


@query(f"""WITH {_EV}, {_PROF}, l AS (SELECT component, task, CAST(t0 - lag(t0) OVER (PARTITION BY component, task ORDER BY epoch) AS DOUBLE) AS x FROM pr)
SELECT component, task, count(*) AS n, CAST(sum(CASE WHEN abs(x - {_DAY}) > 0.2 * {_DAY} THEN 1 ELSE 0 END) AS BIGINT) AS violations, round(1 - sum(CASE WHEN abs(x - {_DAY}) > 0.2 * {_DAY} THEN 1 ELSE 0 END) / count(*), 6) AS compliance,
  round(avg(x), 3) AS mean, round(max(abs(x - {_DAY})), 3) AS max_deviation, round(stddev_pop(x) / {_DAY}, 6) AS irregularity FROM l WHERE x IS NOT NULL GROUP BY component, task""")
def traffic_compliance(spark, d):
    rows = profile.lag_difference(profiler(spark, d), ["component", "task"], "epoch", "t0", "x")
    out = profile.compliance(rows, ["component", "task"], "x", float(_DAY))
    return out.select("component", "task", "n", "violations", rnd("compliance").alias("compliance"), rnd("mean", 3).alias("mean"), rnd(F.col("max_deviation").cast("double"), 3).alias("max_deviation"), rnd("irregularity").alias("irregularity"))


@query(f"WITH {_EV}, {_PROF} SELECT component, task, epoch, t1 - t0 AS duration FROM pr")
def snapshot_duration_join(spark, d):
    p = profiler(spark, d)
    on = ["component", "task", "epoch"]
    return profile.span_durations(p.select(*on, F.col("t0").alias("t")), p.select(*on, F.col("t1").alias("t")), on, "t")


_RUNS = f"""{_EV}, rn AS (SELECT CASE WHEN step % 2 = 0 THEN 'base' ELSE 'other' END AS mode, event_type, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 3 END AS p, CAST(count(*) AS DOUBLE) AS throughput FROM ev GROUP BY ALL)"""


def runs(spark, d) -> DataFrame:
    """Run results with a nullable parameter p."""
    e = events(spark, d)
    p = F.when(F.col("k") % 3 != 0, F.col("k") % 3)
    return e.groupBy(F.when(F.col("step") % 2 == 0, "base").otherwise("other").alias("mode"), "event_type", p.alias("p")).agg(F.count("*").cast("double").alias("throughput"))


@query(f"WITH {_RUNS} SELECT a.event_type, a.p, a.throughput AS base, b.throughput AS other, round(b.throughput / nullif(a.throughput, 0), 6) AS ratio FROM rn a JOIN rn b ON a.event_type = b.event_type AND a.p IS NOT DISTINCT FROM b.p WHERE a.mode = 'base' AND b.mode = 'other'")
def matched_pairs_nullsafe(spark, d):
    r = runs(spark, d)
    out = profile.matched_pairs(r.where("mode = 'base'"), r.where("mode = 'other'"), ["event_type", "p"], "throughput")
    return out.withColumn("ratio", rnd("ratio"))


_STATUS = "CASE WHEN k % 11 = 0 THEN 'No data' WHEN k % 7 = 0 THEN 'OOM' WHEN k % 5 = 0 THEN 'Timed out' ELSE 'Completed' END"


def _status():
    k = F.col("k")
    return text.status(F.lit(True), k % 5 == 0, k % 7 == 0, k % 11 != 0)


@query(f"WITH {_EV} SELECT event_id, {_STATUS} AS status FROM ev")
def status_case(spark, d):
    return events(spark, d).select("event_id", _status().alias("status"))


@query(f"""WITH {_EV} SELECT event_type, count(*) FILTER (WHERE {_STATUS} = 'Completed') AS "Completed", count(*) FILTER (WHERE {_STATUS} = 'Timed out') AS "Timed out", count(*) FILTER (WHERE {_STATUS} = 'OOM') AS "OOM", count(*) FILTER (WHERE {_STATUS} = 'No data') AS "No data" FROM ev GROUP BY event_type""")
def status_pivot(spark, d):
    return profile.pivot_counts(events(spark, d).withColumn("status", _status()), "event_type", "status", ["Completed", "Timed out", "OOM", "No data"])


@query(f"""WITH {_EV}, m AS (SELECT event_type, step + 1 AS x, avg(amount) AS t FROM ev GROUP BY ALL)
SELECT event_type, x, round(t, 6) AS throughput, round(t / (first(t) OVER w * x / first(x) OVER w), 6) AS efficiency FROM m WINDOW w AS (PARTITION BY event_type ORDER BY x)""")
def scaling_efficiency(spark, d):
    rows = events(spark, d).withColumn("x", F.col("step") + 1)
    return profile.scaling_efficiency(rows, ["event_type"], "x", "amount").select("event_type", "x", rnd("throughput").alias("throughput"), rnd("efficiency").alias("efficiency"))


@query(f"WITH {_RUNS}, s AS (SELECT mode, event_type, sum(throughput) AS throughput FROM rn GROUP BY ALL) SELECT a.event_type, a.mode, a.throughput, round(100 * (a.throughput - b.throughput) / nullif(b.throughput, 0), 6) AS change_pct FROM s a JOIN s b ON a.event_type = b.event_type AND b.mode = 'base'")
def relative_change(spark, d):
    r = runs(spark, d).groupBy("mode", "event_type").agg(F.sum("throughput").alias("throughput"))
    return profile.relative_change(r, ["event_type"], "mode", "base", "throughput").withColumn("change_pct", rnd("change_pct"))


@query(f"WITH {_EV} SELECT event_id, event_type, amount FROM ev JOIN (SELECT event_type, quantile_cont(amount, 0.85) AS cut FROM ev GROUP BY event_type) USING (event_type) WHERE amount <= cut")
def quantile_outliers(spark, d):
    return profile.outlier_cut(events(spark, d), ["event_type"], "amount").select("event_id", "event_type", "amount")


@query(f"""WITH {_EV} SELECT unnest(['amount', 'amount', 'amount', 'k', 'k', 'step']) AS a, unnest(['amount', 'k', 'step', 'k', 'step', 'step']) AS b, unnest([round(corr(amount, amount), 6), round(corr(amount, k), 6), round(corr(amount, step), 6), round(corr(k, k), 6), round(corr(k, step), 6), round(corr(step, step), 6)]) AS r FROM ev""")
def pearson_corr(spark, d):
    return profile.correlations(events(spark, d), ["amount", "k", "step"]).withColumn("r", rnd("r"))


@query("SELECT event_id, event_type, value, CAST(NULL AS VARCHAR) AS extra FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, NULL, 'x' FROM events WHERE event_id % 2 = 1")
def union_by_name(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    a, b = e.where("event_id % 2 = 0").select("event_id", "event_type", "value"), e.where("event_id % 2 = 1").select("event_type", "event_id", F.lit("x").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"WITH {_RUNS} SELECT event_type, p FROM rn WHERE mode = 'base' INTERSECT SELECT event_type, p FROM rn WHERE mode = 'other'")
def shared_configs_intersect(spark, d):
    r = runs(spark, d)
    return r.where("mode = 'base'").select("event_type", "p").intersect(r.where("mode = 'other'").select("event_type", "p"))


@query(f"WITH {_RUNS} SELECT unnest(['mode', 'p', 'c']) AS \"column\", unnest([count(DISTINCT mode) > 1, count(DISTINCT p) + max(CAST(p IS NULL AS INT)) > 1, false]) AS varies FROM rn")
def varying_parameters(spark, d):
    return profile.varying(runs(spark, d).withColumn("c", F.lit(1)), ["mode", "p", "c"])


@query(f"WITH {_EV}, {_PROF} SELECT component, epoch, round(sum(CASE WHEN task < 2 THEN calls ELSE 0 END) / greatest(1, sum(calls)), 6) AS real_share, CAST(greatest(0, max(t1 - t0) - sum(calls) * 1000) AS BIGINT) AS idle FROM pr GROUP BY component, epoch")
def emission_and_idle(spark, d):
    real, dummy = F.sum(F.when(F.col("task") < 2, F.col("calls")).otherwise(0)), F.sum(F.when(F.col("task") >= 2, F.col("calls")).otherwise(0))
    out = profiler(spark, d).groupBy("component", "epoch").agg(rnd(profile.emission_ratio(real, dummy)).alias("real_share"), profile.idle_time(F.max(F.col("t1") - F.col("t0")), F.sum("calls") * 1000).cast("long").alias("idle"))
    return out


@query("SELECT l_partkey % 50 AS key, count(DISTINCT o_custkey) AS users, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def lineitem_histogram(spark, d):
    li, o = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity"), spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy((F.col("l_partkey") % 50).alias("key")).agg(F.countDistinct("o_custkey").alias("users"), F.sum("l_quantity").cast("double").alias("total"))


# ---- without a SQL form: tested against reference models


@query()
def dp_histogram_noisy(spark, d):
    """The noisy histogram of part groups over order months, by customer; draws fresh noise for each call."""
    p = DPParams(mu=2, max_time_steps=128)
    li, o = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    month = F.months_between(F.trunc("o_orderdate", "month"), F.lit("1992-01-01").cast("date")).cast("int")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user"), (F.col("l_partkey") % 20).cast("string").alias("key"), F.lit(1.0).alias("value"), month.alias("step"), "l_orderkey", "l_linenumber")
    kept = bounding.bound_records(rows, "user", ["step", "l_orderkey", "l_linenumber"], p.max_contributions)
    return histogram.dp_histogram(kept.withColumn("user", F.col("user").cast("string")), histogram.mechanism(p.max_time_steps, p.mu, calibration.calibrate(p)))


@query("SELECT event_id, user_id, true AS same, true AS route_ok, true AS tamper_seen FROM events")
def aes_gcm_roundtrip(spark, d):
    key = F.unhex(F.lit("000102030405060708090A0B0C0D0E0F101112131415161718191A1B1C1D1E1F"))  # a test key
    e = spark.read.parquet(f"{d}/events.parquet")
    head = envelope.aad(F.lit("source"), F.lit("bounding"), {"producer_id": F.lit("p0"), "seq": F.col("event_id")})
    s = e.select("event_id", "user_id", envelope.seal(F.col("user_id").cast("string"), key, head).alias("s"))
    other = F.struct(F.lit("{}").cast("binary").alias("associatedData"), F.col("s.nonce").alias("nonce"), F.col("s.ciphertext").alias("ciphertext"))
    return s.select("event_id", "user_id", (envelope.unseal(F.col("s"), key) == F.col("user_id").cast("string")).alias("same"), envelope.valid_route(F.col("s"), "source", "bounding").alias("route_ok"), envelope.unseal(other, key).isNull().alias("tamper_seen"))


@query()
def zipf_generate(spark, d):
    return generator.contributions(spark, 500_000, 100_000, 100)


@query()
def calibration_table(spark, d):
    rows = []
    for mode in CompositionMode:
        for t in (100, 1000):
            c = calibration.calibrate(DPParams(mu=0, max_time_steps=t, composition=mode))
            rows.append((mode.value, t, c.eps_round, c.delta_round, c.sigma_key, c.sigma_hist, c.beta, c.quantile))
    return spark.createDataFrame(rows, "composition string, T int, eps_round double, delta_round double, sigma_key double, sigma_hist double, beta double, quantile double")


#: Published constants of the three modes (mode, steps, eps, delta, sigma of keys, of the histogram, beta, quantile).
_CONSTANTS = """('ZCDP_LINEAR', 100, '6.06350e-01', '2.08333e-11', '30.79013', '177.16957', '3.67596e-12', '6.8506'),
('ZCDP_LINEAR', 1000, '6.06350e-01', '2.08333e-11', '36.80125', '211.75813', '3.67596e-12', '6.8506'),
('DWORK_ANALYTICAL', 100, '7.52560e-02', '1.03149e-11', '215.58404', '177.16957', '2.48175e-12', '6.9066'),
('DWORK_ANALYTICAL', 1000, '7.52560e-02', '1.03149e-11', '257.67221', '211.75813', '2.48175e-12', '6.9066'),
('OPTIMAL_KOV', 100, '9.37500e-02', '2.08130e-11', '170.97643', '177.16957', '4.95952e-12', '6.8077'),
('OPTIMAL_KOV', 1000, '9.37500e-02', '2.08130e-11', '204.35592', '211.75813', '4.95952e-12', '6.8077')"""


@query(f"SELECT * FROM (VALUES {_CONSTANTS}) AS t(composition, T, eps_round, delta_round, sigma_key, sigma_hist, beta, quantile)")
def calibration_golden(spark, d):
    """The calibration's constants, to six digits, the quantile to five."""
    small, plain = (lambda c: F.format_string("%.5e", c).alias(c)), (lambda c: F.format_string("%.5f", c).alias(c))
    return calibration_table(spark, d).select("composition", "T", small("eps_round"), small("delta_round"), plain("sigma_key"), plain("sigma_hist"), small("beta"), F.format_string("%.4f", "quantile").alias("quantile"))


# ---- bounding service


@query(f"""WITH {_EV}, w AS (SELECT *, coalesce(sum(greatest(k, 0)) OVER (PARTITION BY "user" ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ev)
SELECT event_type, CAST(sum(CASE WHEN k > 0 AND used < 500 THEN 1 ELSE 0 END) AS BIGINT) AS forwarded, CAST(sum(CASE WHEN k > 0 AND used < 500 THEN 0 ELSE 1 END) AS BIGINT) AS dropped FROM w GROUP BY event_type""")
def bounding_counters(spark, d):
    return bounding.bound_with_counts(events(spark, d), "user", "k", ["ts", "event_id"], 500, ["event_type"])[1]


_CHAIN_KEY = "000102030405060708090A0B0C0D0E0F101112131415161718191A1B1C1D1E1F"  # a test key


def _sealed(spark, d, scheme):
    """(event_id, ts, user, word, count) sealed values; every seventh one names another route."""
    key = F.unhex(F.lit(_CHAIN_KEY))
    here = F.when(F.col("event_id") % 7 == 0, "elsewhere").otherwise("bounding")
    head = envelope.aad(F.lit("source"), here, {"producer_id": F.lit("p0"), "seq": F.col("event_id")})
    one = lambda c, name: envelope.seal(c.cast("string"), key, head, scheme).alias(name)
    return events(spark, d).select("event_id", "ts", one(F.col("user"), "user"), one(F.col("event_type"), "word"), one(F.col("k"), "count"))


def _bounding_service(spark, d, scheme):
    key, f = F.unhex(F.lit(_CHAIN_KEY)), envelope.Features(scheme=scheme)
    out = bounding.check_and_clamp(_sealed(spark, d, scheme), key, 500, 60.0, "source", "bounding", "perturbation", ["ts", "event_id"], f)
    opened = [envelope.unseal(F.col(c), key, scheme) for c in ("user", "word", "count")]
    ok = envelope.valid_route(F.col("user"), "bounding", "perturbation")
    return out.select("event_id", opened[0].alias("user_text"), opened[1].alias("word_text"), opened[2].cast("double").alias("value"), "routing_key", ok.alias("route_ok"))


_SERVICE = f"""WITH {_EV}, w AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY "user" ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ev WHERE k > 0 AND event_id % 7 <> 0)
SELECT event_id, CAST("user" AS VARCHAR) AS user_text, event_type AS word_text, CAST(least(60, least(k, 500 - used)) AS DOUBLE) AS value, sha256('word:' || event_type) AS routing_key, true AS route_ok FROM w WHERE used < 500"""


@query(_SERVICE)
def check_and_clamp(spark, d):
    return _bounding_service(spark, d, "AES_256_GCM")


@query(_SERVICE)
def check_and_clamp_chacha(spark, d):
    return _bounding_service(spark, d, "CHACHA20_POLY1305")


@query(f"WITH {_EV} SELECT event_id, event_type AS word, 'bounding' AS source, 'perturbation' AS destination FROM ev WHERE event_id % 7 <> 0")
def spout_reseal(spark, d):
    """A source's values are opened and sealed again for the next component."""
    key = F.unhex(F.lit(_CHAIN_KEY))
    out = envelope.reseal(_sealed(spark, d, "AES_256_GCM").select("event_id", "word"), ["word"], key, "source", "bounding", "perturbation")
    meta = envelope.parse_aad(F.col("word.associatedData"))
    return out.select("event_id", envelope.unseal(F.col("word"), key).alias("word"), meta["source"].alias("source"), meta["destination"].alias("destination"))


@query("SELECT * FROM (VALUES ('source', 'bounding'), ('bounding', 'perturbation'), ('perturbation', 'aggregation'), ('perturbation', 'log')) AS t(src, dst)")
def topology_edges(spark, d):
    return envelope.topology(spark, {"Source": ["Bounding"], "BOUNDING": ["perturbation"], "perturbation": ["Aggregation", "log", "LOG"]})


# ---- partials: cover traffic and pending epochs


@query(f"""WITH {_PART}, f AS (SELECT producer_id, min(epoch) AS e FROM pt WHERE epoch % 2 = 0 GROUP BY producer_id), g AS (SELECT producer_id, unnest(range(e, {STEPS})) AS epoch FROM f)
SELECT producer_id, count(*) FILTER (WHERE s.n IS NULL) AS dummies, count(*) FILTER (WHERE s.n IS NOT NULL) AS real FROM g LEFT JOIN (SELECT producer_id, epoch, count(*) AS n FROM pt WHERE epoch % 2 = 0 GROUP BY ALL) s USING (producer_id, epoch) GROUP BY producer_id""")
def cover_traffic(spark, d):
    from quietcount.streaming.mechanism import with_cover

    p = partials(spark, d).where("epoch % 2 = 0")
    out = with_cover(p, spark.range(STEPS).select(F.col("id").cast("int").alias("epoch"))).select("producer_id", "epoch", (F.col("key") == text.DUMMY).alias("dummy")).distinct()
    return out.groupBy("producer_id").agg(F.sum(F.col("dummy").cast("long")).alias("dummies"), F.sum((~F.col("dummy")).cast("long")).alias("real"))


@query(f"""WITH {_PART}, p AS (SELECT * FROM pt WHERE NOT (producer_id = 'p1' AND epoch % 5 = 0)), e AS (SELECT epoch, count(DISTINCT producer_id) AS received FROM p GROUP BY epoch)
SELECT epoch, received, (SELECT count(*) FROM e x WHERE x.epoch > e.epoch) >= 8 AS evicted FROM e WHERE received < 3""")
def pending_epochs(spark, d):
    p = partials(spark, d).where("NOT (producer_id = 'p1' AND epoch % 5 = 0)").withColumn("arrival", F.col("epoch"))
    return merge.pending_epochs(p, 3, "arrival")


# ---- profile analytics, continued


@query(f"WITH {_EV}, {_PROF} SELECT component, task, epoch, CAST(sum(calls) OVER (PARTITION BY component, task ORDER BY epoch) AS BIGINT) AS running FROM pr")
def profiler_running_total(spark, d):
    return profile.running_total(profiler(spark, d), ["component", "task"], "epoch", "calls").select("component", "task", "epoch", "running")


@query(f"WITH {_EV}, {_PROF} SELECT component, task, arg_max(calls, epoch) AS gauge FROM pr GROUP BY component, task")
def gauge_last_write(spark, d):
    return profile.last_gauges(profiler(spark, d), ["component", "task"], "epoch", "calls")


@query(f"WITH {_EV}, {_PROF}, e AS (SELECT component, task, max(epoch) AS e FROM pr GROUP BY ALL) SELECT component, count(*) AS tasks, max(e) AS max_epoch, min(e) AS all_reached FROM e GROUP BY component")
def run_progress(spark, d):
    return profile.run_progress(profiler(spark, d), ["component"], "task", "epoch")


@query(f"WITH {_RUNS} SELECT mode, p, count(*) AS runs FROM rn GROUP BY mode, p")
def distinct_configs(spark, d):
    return profile.distinct_configs(runs(spark, d), ["mode", "p"])


@query(f"WITH {_RUNS} SELECT event_type, p, count(*) AS runs, round(avg(throughput), 6) AS throughput FROM rn GROUP BY ALL HAVING count(*) > 1")
def report_average(spark, d):
    return profile.report_average(runs(spark, d), ["event_type", "p"], ["throughput"]).withColumn("throughput", rnd("throughput"))


@query(f"WITH {_RUNS} SELECT event_type, round(avg(throughput) FILTER (WHERE mode = 'base'), 6) AS base, round(avg(throughput) FILTER (WHERE mode = 'other'), 6) AS other FROM rn GROUP BY event_type")
def pivot_mean(spark, d):
    return profile.pivot_values(runs(spark, d), "event_type", "mode", ["base", "other"], "throughput").select("event_type", rnd("base").alias("base"), rnd("other").alias("other"))


@query(f"WITH {_RUNS} SELECT event_type, sum(throughput) FILTER (WHERE mode = 'base') AS base, sum(throughput) FILTER (WHERE mode = 'other') AS other FROM rn GROUP BY event_type")
def pivot_sum(spark, d):
    return profile.pivot_values(runs(spark, d), "event_type", "mode", ["base", "other"], "throughput", "sum")


@query(f"""WITH {_EV}, q AS (SELECT event_type, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS median, quantile_cont(amount, 0.75) AS q3 FROM ev GROUP BY event_type)
SELECT event_type, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, min(amount) FILTER (WHERE amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(amount) FILTER (WHERE amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high FROM ev JOIN q USING (event_type) GROUP BY event_type""")
def box_quartiles(spark, d):
    return profile.quartiles(events(spark, d), ["event_type"], "amount").withColumns({c: rnd(c) for c in ("q1", "median", "q3")})


_BYTES = "octet_length(encode(to_json({'event_id': event_id, 'event_type': event_type})))"


@query(f"""WITH s AS (SELECT {_BYTES} AS bytes FROM events), o AS (SELECT bytes, row_number() OVER (ORDER BY bytes) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT round(avg(bytes), 6) AS mean, min(bytes) AS least, max(bytes) AS most, min(bytes) FILTER (WHERE i >= least(floor(n * 0.5), n - 1)) AS p50, min(bytes) FILTER (WHERE i >= least(floor(n * 0.9), n - 1)) AS p90, min(bytes) FILTER (WHERE i >= least(floor(n * 0.99), n - 1)) AS p99 FROM o""")
def tuple_sizes(spark, d):
    out = profile.tuple_sizes(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"))
    return out.select(rnd("mean").alias("mean"), *[F.col(c).cast("long").alias(c) for c in ("least", "most", "p50", "p90", "p99")])


@query(f"WITH {_RUNS}, s AS (SELECT mode, event_type, sum(throughput) AS t FROM rn GROUP BY ALL) SELECT b.event_type, CASE WHEN abs(o.t / b.t - 1) <= 0.2 THEN 'OK' ELSE 'OFF' END AS verdict FROM s b JOIN s o ON b.event_type = o.event_type AND b.mode = 'base' AND o.mode = 'other'")
def baseline_verdict(spark, d):
    s = runs(spark, d).groupBy("event_type").pivot("mode", ["base", "other"]).agg(F.sum("throughput"))
    return s.select("event_type", profile.verdict(F.col("other") / F.col("base")).alias("verdict"))


@query(f"WITH {_EV}, {_PROF} SELECT component, epoch, min(t0) AS t0 FROM pr GROUP BY component, epoch")
def first_marker_of_epoch(spark, d):
    return profile.first_markers(profiler(spark, d), ["component"], "epoch", "t0")


@query(f"WITH {_RUNS} SELECT mode, event_type, p, row_number() OVER (ORDER BY coalesce(p, -1), mode, event_type) AS place FROM rn")
def nulls_first_order(spark, d):
    """The order itself is the result: each row's place in it. The table has a row for each configuration."""
    ordered = profile.sorted_by(runs(spark, d).select("mode", "event_type", "p"), ["p", "mode", "event_type"]).coalesce(1)
    return ordered.withColumn("place", F.monotonically_increasing_id() + 1)


@query(f"WITH {_RUNS}, b AS (SELECT event_type, p FROM rn GROUP BY ALL HAVING count(DISTINCT mode) = 2) SELECT mode, event_type, p, throughput FROM rn SEMI JOIN b ON rn.event_type = b.event_type AND rn.p IS NOT DISTINCT FROM b.p")
def semi_by_overlap(spark, d):
    return profile.shared_parameters(runs(spark, d), "mode", ["base", "other"], ["event_type", "p"])


@query(f"WITH {_EV} SELECT event_id, CASE k % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' END AS entry FROM ev")
def catalog_lookup(spark, d):
    return profile.catalog_lookup(events(spark, d).withColumn("i", F.col("k") % 4), "i", ["red", "green", "blue"]).select("event_id", "entry")


@query(f"WITH {_EV} SELECT event_id, k / 8.0 AS size_gb, round(k / 8.0 / nullif(event_id % 5000, 0) * 1000, 6) AS gb_per_s, round(n / 1e6 / nullif(event_id % 5000, 0) * 1000, 9) AS mrec_per_s, (event_id % 5000) / 1000 AS duration_s FROM ev")
def derived_metrics(spark, d):
    e = events(spark, d).select("event_id", F.when(F.col("k") % 2 == 0, F.col("k") / 8.0).alias("size_gb"), (F.col("k") / 8.0).alias("old_size"), F.col("n").alias("n_records"), (F.col("event_id") % 5000).alias("duration_ms"))
    out = text.derived_metrics(text.coalesced(e, "size_gb", "batch_size_gb", "old_size"))
    return out.select("event_id", "size_gb", rnd("gb_per_s").alias("gb_per_s"), rnd("mrec_per_s", 9).alias("mrec_per_s"), "duration_s")


@query(f"WITH {_EV} SELECT event_id, round((epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY event_type)) / 1000, 3) AS by_type_s, round((epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER ()) / 1000, 3) AS elapsed_s FROM ev")
def elapsed_time(spark, d):
    out = profile.elapsed(profile.elapsed(events(spark, d), "ts", ["event_type"], "by_type_s"), "ts")
    return out.select("event_id", rnd("by_type_s", 3).alias("by_type_s"), rnd("elapsed_s", 3).alias("elapsed_s"))


@query(f"WITH {_EV} SELECT event_id FROM ev WHERE event_type IN ('click', 'view', 'purchase') AND k IN (1, 2, 3)")
def membership_filters(spark, d):
    return profile.selected(events(spark, d), event_type=["click", "view", "purchase"], k=[1, 2, 3], user=None).select("event_id")


def _short(c: str) -> str:
    cut = lambda x: f"regexp_replace(printf('%.1f', {x}), '\\.0$', '')"
    return f"CASE WHEN {c} >= 1e6 THEN {cut(f'{c} / 1e6')} || 'M' WHEN {c} >= 1e3 THEN {cut(f'{c} / 1e3')} || 'K' ELSE {cut(f'CAST({c} AS DOUBLE)')} END"


@query(f"WITH {_EV} SELECT event_id, 't' || {_short('event_id * 1000')} || ' e' || {_short('k')} || CASE WHEN k % 2 = 0 THEN ' p8' ELSE '' END AS label FROM ev")
def run_labels(spark, d):
    label = text.run_label({"t": F.col("event_id") * 1000, "e": F.col("k"), "p": F.when(F.col("k") % 2 == 0, F.lit(8))})
    return events(spark, d).select("event_id", label.alias("label"))


_LIFE = f"""{_EV}, {_PROF},
s AS (SELECT component, task, epoch, t0 AS a, t1 AS z, calls FROM pr),
g AS (SELECT component, task, epoch, a, z, calls, a - lag(a) OVER (PARTITION BY component, task ORDER BY epoch) AS gap FROM s)"""


@query(f"""WITH {_LIFE},
t AS (SELECT component, task, max(z) - min(a) AS active, sum(calls * 7.0) AS busy FROM s GROUP BY component, task),
u AS (SELECT component, CAST(sum(active) AS BIGINT) AS active_ms, round(sum(greatest(0, active - busy)), 3) AS idle_ms FROM t GROUP BY component)
SELECT component, tasks, max_epoch, round(epoch_ms, 3) AS epoch_ms, round(snapshot_ms, 3) AS snapshot_ms, active_ms, idle_ms, latency_ms, calls, compliance FROM (
  SELECT component, count(DISTINCT task) AS tasks, CAST(max(epoch) AS BIGINT) AS max_epoch, avg(gap) AS epoch_ms, avg(z - a) AS snapshot_ms, 7.0 AS latency_ms, CAST(sum(calls) AS BIGINT) AS calls,
    round(1 - sum(CASE WHEN abs(gap - {_DAY}) > 0.2 * {_DAY} THEN 1 ELSE 0 END) / count(gap), 6) AS compliance FROM g GROUP BY component) JOIN u USING (component)""")
def run_summary(spark, d):
    """The events as a profile: an epoch starts with a task's first event of the day, its snapshot lasts until the last one."""
    pr = profiler(spark, d)
    none, at = F.lit(None), lambda c: F.timestamp_millis(F.col(c)).alias("timestamp")
    life = lambda name, c: pr.select(at(c), "component", F.col("task").alias("taskId"), F.lit("lifecycle").alias("type"), F.lit(name).alias("name"), F.col("epoch").cast("long").alias("total"), none.cast("long").alias("sampled"), none.cast("double").alias("avgMs"))
    timer = pr.select(at("t0"), "component", F.col("task").alias("taskId"), F.lit("timer").alias("type"), F.lit("handle").alias("name"), F.col("calls").alias("total"), F.col("calls").alias("sampled"), F.lit(7.0).alias("avgMs"))
    rows = timer
    for name, c in (("epoch_start", "t0"), ("snapshot_start", "t0"), ("snapshot_end", "t1"), ("emit", "t0")):
        rows = rows.unionByName(life(name, c))
    out = profile.run_summary(rows, ["component"], float(_DAY))
    return out.select("component", "tasks", "max_epoch", rnd("epoch_ms", 3).alias("epoch_ms"), rnd("snapshot_ms", 3).alias("snapshot_ms"), "active_ms", rnd("idle_ms", 3).alias("idle_ms"), rnd("latency_ms", 6).alias("latency_ms"), "calls", rnd("compliance").alias("compliance"))


# ---- sources


@query(f"WITH {_EV}, m AS (SELECT step AS batch_id, \"user\" % 4 AS task, min(ts) AS a, max(ts) AS z FROM ev GROUP BY ALL) SELECT batch_id, CAST(epoch_us(min(a)) // 1000 AS BIGINT) AS t_begin, CAST(epoch_us(max(z)) // 1000 AS BIGINT) AS t_end, count(*) >= 4 AS complete FROM m GROUP BY batch_id")
def batch_markers(spark, d):
    e = events(spark, d).groupBy(F.col("step").alias("batch_id"), (F.col("user") % 4).alias("task")).agg(F.unix_millis(F.min("ts").cast("timestamp")).alias("a"), F.unix_millis(F.max("ts").cast("timestamp")).alias("z"))
    markers = e.select("batch_id", "task", F.lit("BEGIN").alias("kind"), F.col("a").alias("at")).unionByName(e.select("batch_id", "task", F.lit("END").alias("kind"), F.col("z").alias("at")))
    return generator.completed_batches(markers, 4)


@query("SELECT CAST(2.0 AS DOUBLE) AS size_gb, CAST(ceil(2.0 * 1073741824 / 31) AS BIGINT) AS records, 3 AS share0, 2 AS share2, 11 AS global_user, round(h1 / h0 - 26, 6) AS mean_rank FROM (SELECT sum(pow(i + 26.0, -5.738)) AS h1, sum(pow(i + 26.0, -6.738)) AS h0 FROM range(1, 100001) r(i))")
def workload_arithmetic(spark, d):
    from quietcount.functions.noise import zipf_mandelbrot_mean

    row = (2.0, generator.record_count(2.0), generator.share(8, 0, 3), generator.share(8, 2, 3), generator.local_to_global(3, 2, 3), round(zipf_mandelbrot_mean(100_000, 26.0, 6.738), 6))
    return spark.createDataFrame([row], "size_gb double, records long, share0 int, share2 int, global_user int, mean_rank double")


@query()
def paper_workload(spark, d):
    """The private histogram at a tenth of the published scale: 1 M users, 100,000 keys, 100 steps, and how far it is from the truth."""
    return utility(spark, 1_000_000, 100_000, 100)


def utility(spark, users: int, keys: int, steps: int, mode: CompositionMode = CompositionMode.ZCDP_LINEAR) -> DataFrame:
    """One row: l0, l_inf, l1, l2 of the released histogram against the true one."""
    p = DPParams(mu=0, max_time_steps=steps, composition=mode)
    rows = generator.contributions(spark, users, keys, steps, p.max_contributions)
    released = histogram.dp_histogram(rows, histogram.mechanism(steps, p.mu, calibration.calibrate(p)))
    norms = metrics.error_norms(released, metrics.ground_truth(rows))
    return norms.select(F.lit(users).alias("users"), F.lit(keys).alias("keys"), F.lit(steps).alias("steps"), "keys_released", "keys_true", (F.col("keys_true") - F.col("keys_released")).alias("l0"), "l_inf", "l1", "l2")
