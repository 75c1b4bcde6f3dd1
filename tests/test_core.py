import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietcount.functions import text
from quietcount.functions.calibration import calibrate, round_budget
from quietcount.functions.noise import noise_path, variances
from quietcount.operators import bounding, histogram, merge
from quietcount.operators.histogram import Mechanism, dp_histogram, dp_releases, mechanism
from quietcount.params import CompositionMode, DPParams
from quietcount.plans import catalog
from quietcount.streaming.mechanism import Clock, StreamingHistogram, run_bounded

#: Mode, steps, eps, delta, sigma of keys, sigma of the histogram, beta, quantile.
GOLDEN = [
    ("ZCDP_LINEAR", 100, 6.063502e-01, 2.083333e-11, 30.790132, 177.169566, 3.675961e-12, 6.850643),
    ("ZCDP_LINEAR", 1000, 6.063502e-01, 2.083333e-11, 36.801247, 211.758134, 3.675961e-12, 6.850643),
    ("DWORK_ANALYTICAL", 100, 7.525603e-02, 1.031494e-11, 215.584038, 177.169566, 2.481748e-12, 6.906614),
    ("DWORK_ANALYTICAL", 1000, 7.525603e-02, 1.031494e-11, 257.672209, 211.758134, 2.481748e-12, 6.906614),
    ("OPTIMAL_KOV", 100, 9.375000e-02, 2.081299e-11, 170.976426, 177.169566, 4.959523e-12, 6.807674),
    ("OPTIMAL_KOV", 1000, 9.375000e-02, 2.081299e-11, 204.355916, 211.758134, 4.959523e-12, 6.807674),
]


@pytest.mark.parametrize("row", GOLDEN)
def test_calibration(row):
    c = calibrate(DPParams(mu=0, max_time_steps=row[1], composition=CompositionMode(row[0])))
    got = (c.eps_round, c.delta_round, c.sigma_key, c.sigma_hist, c.beta, c.quantile)
    assert got == pytest.approx(row[2:], rel=1e-6)


def test_one_step_is_refused():
    with pytest.raises(ValueError):
        DPParams(max_time_steps=1)


def test_noise_variance():
    rng = np.random.default_rng(1)
    x = np.stack([noise_path(100, 2.0, rng) for _ in range(4000)])
    assert np.allclose(x.var(0) / variances(100, 2.0), 1, atol=0.12) and np.abs(x.mean(0)).max() < 0.3


def by_hand(m, key, rows):
    """The mechanism for one key, step by step, with the users themselves. rows: (user, value, step)."""
    out, seen, start, due, count, buffer, released, rounds = [], set(), False, None, 0, 0.0, 0.0, 0
    hist = m.paths([key], "hist", [0])[0]
    for t in range(m.steps):
        own = [(u, v) for u, v, s in rows if s == t]
        if not own and due != t:
            continue
        if own and not start:
            start, seen, count, rounds = True, set(), 0, rounds + 1
        buffer += sum(v for _, v in own)
        count += len({u for u, _ in own} - seen)
        seen |= {u for u, _ in own}
        noise = m.paths([key], "key", [rounds - 1])[0]
        due = None
        if count + noise[t] >= m.bar[t]:
            released, buffer, start = released + buffer, 0.0, False
            out.append((key, t, released + hist[t]))
        elif own:
            due = next((x for x in range(t + 1, m.steps) if count + noise[x] >= m.bar[x]), None)
    return out


def rows_of(seed, users=14, keys=6, steps=12, n=400):
    rng = random.Random(seed)
    return [(f"u{rng.randrange(users)}", f"k{min(rng.randrange(keys), rng.randrange(keys))}", float(rng.randrange(1, 3)), rng.randrange(steps)) for _ in range(n)]


@pytest.mark.parametrize("seed,mu,sigma,quantile", [(1, 3, 0.0, 0.0), (2, 4, 1.5, 0.8), (3, 1, 4.0, 1.0), (4, 9, 2.0, 0.0)])
def test_mechanism_against_one_key_by_hand(spark, monkeypatch, seed, mu, sigma, quantile):
    rows = rows_of(seed)
    m = Mechanism(12, mu, sigma, sigma / 2, quantile, b"secret")
    want = sorted(x for k in {r[1] for r in rows} for x in by_hand(m, k, [(u, v, t) for u, key, v, t in rows if key == k]))
    df = spark.createDataFrame(rows, "user string, key string, value double, step int").repartition(5)
    assert sorted(map(tuple, dp_releases(df, m).collect())) == want


def test_mechanism_in_pieces(spark):
    """Keys that arrive in several batches are stepped whole."""
    rows = rows_of(7, keys=40, n=900)
    m = Mechanism(12, 2, 1.0, 1.0, 0.5, b"secret")
    df = spark.createDataFrame(rows, "user string, key string, value double, step int")
    want = sorted(map(tuple, dp_releases(df, m).collect()))
    old, old_rows = histogram.KEYS, histogram.ROWS
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        histogram.KEYS, histogram.ROWS = 2, 10
        assert sorted(map(tuple, dp_releases(df, m).collect())) == want
    finally:
        histogram.KEYS, histogram.ROWS = old, old_rows
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_zero_noise_cases(spark):
    say = lambda rows: spark.createDataFrame(rows, "user string, key string, value double, step int")
    rows = [(f"u{i}", "k", 1.0, 0) for i in range(20)] + [(f"v{i}", "k", 1.0, 1) for i in range(5)]
    assert [tuple(r) for r in dp_releases(say(rows), mechanism(16, 5, None)).orderBy("step").collect()] == [("k", 0, 20.0), ("k", 1, 25.0)]
    few = [(f"u{i}", "k", 10.0, 0) for i in range(5)]
    assert dp_releases(say(few), mechanism(16, 10, None)).count() == 0


def test_prediction_releases_on_noise_alone(spark):
    m = Mechanism(32, 3.0, 4.0, 1.0, 0.5, b"s")
    rows = [("u", f"k{k}", 1.0, 0) for k in range(60)]
    got = {r.key: r.step for r in dp_releases(spark.createDataFrame(rows, "user string, key string, value double, step int"), m).collect()}
    want = {k: x[0][1] for _, k, _, _ in rows if (x := by_hand(m, k, [("u", 1.0, 0)]))}
    assert got == want and any(t > 0 for t in want.values())


@pytest.mark.parametrize("window", [1, 5, 128])
def test_replay_against_a_window_model(spark, window):
    rng = random.Random(window)
    arrivals, at = [], 0
    for _ in range(400):
        at = max(-3, at + rng.choice((-2 * window, -window, -1, 0, 1, 1, 1, 2, window, 3 * window)))
        arrivals.append(at)
    seen, newest, want = set(), None, []
    for i, n in enumerate(arrivals):  # by hand: the numbers seen and the newest one accepted or not
        if n >= 0 and n not in seen and (newest is None or n > newest - window):
            want.append(i)
        seen.add(n)
        newest = n if newest is None else max(newest, n)
    rows = spark.createDataFrame([(i, "p", n) for i, n in enumerate(arrivals)], "i int, p string, s long")
    assert sorted(r.i for r in merge.replay_filter(rows, "p", "s", ["i"], window).collect()) == want


@pytest.mark.parametrize("mode", [CompositionMode.DWORK_ANALYTICAL, CompositionMode.OPTIMAL_KOV])
def test_one_contribution_has_the_whole_budget(mode):
    assert round_budget(mode, 3.0, 6.67e-10, 1) == (3.0, 6.67e-10)
    assert round_budget(mode, 0.0, 1e-9, 4) == (0.0, 2.5e-10)


def test_null_users(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "user string, i int")
    with pytest.raises(Exception, match="no user"):
        bounding.bound_records(rows, "user", ["i"], 1).collect()
    assert bounding.bound_records(rows, "user", ["i"], 1, event_level=True).count() == 2


def test_streaming_equals_bounded_and_restarts(spark, tmp_path):
    """Micro-batches of a file stream, stopped after some and started again, release what the bounded run does."""
    rows, clock = rows_of(2, steps=6, n=150), Clock(1000, 0)
    m = Mechanism(8, 2.0, 0.7, 0.5, 1.0, b"secret")
    df = spark.createDataFrame(rows, "user string, key string, value double, step int")
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    timed = df.withColumn("ts", F.timestamp_millis(F.col("step") * 1000 + 500))
    stream = spark.readStream.schema("user string, key string, value double, step int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    for t in range(3):
        timed.where(f"step = {t}").coalesce(1).write.mode("append").parquet(source)
    seen, stale = [], []
    run = lambda secret: StreamingHistogram(spark, str(tmp_path / "h"), Mechanism(8, 2.0, 0.7, 0.5, 1.0, secret), clock, lambda r, e: seen.append(e), stale.append)
    assert run_bounded(run(b"secret").start(stream, availableNow=True)) >= 3
    for t in range(3, 6):
        timed.where(f"step = {t}").coalesce(1).write.mode("append").parquet(source)
    end = spark.createDataFrame([("end", "end", 0.0, 99, 10**9)], "user string, key string, value double, step int, ms long")
    end.withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(source)
    s = run(b"other")  # the folder keeps its secret
    run_bounded(s.start(stream, availableNow=True))
    assert sorted(map(tuple, s.histogram().collect())) == sorted(map(tuple, dp_histogram(df, m).collect()))
    assert seen
    with pytest.raises(ValueError):
        StreamingHistogram(spark, str(tmp_path / "h"), Mechanism(9, 2.0, 0.7, 0.5, 1.0, b""))


def test_zipf_generate_has_the_reference_sizes(spark):
    users, last, keys = catalog.queries()["zipf_generate"](spark, "").selectExpr("count(DISTINCT user)", "max(int(user))", "max(int(key))").first()
    assert users == 500_000 and last == 499_999 and 90_000 < keys <= 100_000


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_without_the_llm_folder(tmp_path):
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "quietcount", tmp_path / "quietcount", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'word_count' in e.queries() and e.oracle_sql()"], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_labels_round_as_c_prints(spark):
    """1.15 is stored as 1.1499...: 1.1, where Java prints 1.2; a half goes to the even digit."""
    rng = random.Random(6)
    values = [0.0, -0.04, -1.15, 0.05, 0.25, 0.75, 0.95, 9.95, 99.95, 2.0**49 + 0.125] + [k / 100 for k in range(105, 1000, 10)] + [rng.randrange(1 << 20) / 8 for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in [*values, None, float("inf")]], "x double")
    got = [r[0] for r in rows.select(F.format_string("%.1f", text.one_decimal(F.col("x")))).collect()]
    assert got[:-2] == [f"{x:.1f}" for x in values] and got[-1] == "Infinity"
    numbers = spark.createDataFrame([(1_150_000,), (1_250_000,), (2_050_000,), (1_050,), (2_000,), (7,), (None,)], "n long")
    assert [r[0] for r in numbers.select(text.short_number(F.col("n"))).collect()] == ["1.1M", "1.2M", "2M", "1.1K", "2K", "7", None]
