"""Sources, sinks and the sealed envelope, each against what was written or a model by hand."""

import csv
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietcount.functions import chacha, envelope
from quietcount.functions.noise import zipf_mandelbrot_mean
from quietcount.operators import bounding, metrics, profile
from quietcount.sources import generator, readers
from quietcount.streaming.mechanism import run_bounded

KEY = "000102030405060708090A0B0C0D0E0F101112131415161718191A1B1C1D1E1F"


def key():
    return F.unhex(F.lit(KEY))


def test_chacha_fixed_vectors():
    """The test vectors of RFC 8439, sections 2.4.2, 2.5.2 and 2.8.2."""
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    assert chacha.poly1305(bytes.fromhex("85d6be7857556d337f4452fe42d506a80103808afb0db2fd4abff6af4149f51b"), b"Cryptographic Forum Research Group").hex() == "a8061dc1305136c6c22b8baf0c0127a9"
    k, nonce, data = bytes(range(0x80, 0xA0)), bytes.fromhex("070000004041424344454647"), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    sealed = chacha.seal_rows([text, b""], [k, k], [nonce, nonce], [data, b""])
    assert sealed[0][-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691" and sealed[0][12:28].hex() == "d31a8d34648e60db7b86afbc53ef7ec2"
    assert chacha.open_rows(sealed, [k, k], [data, b""]) == [text, b""]
    bad = bytearray(sealed[0])
    bad[20] ^= 1
    assert chacha.open_rows([bytes(bad), sealed[0], b"short"], [k] * 3, [data, b"other", b""]) == [None, None, None]


@pytest.mark.parametrize("scheme", envelope.SCHEMES)
def test_schemes_round_trip_and_refuse(spark, scheme):
    df = spark.createDataFrame([(1, "one"), (2, ""), (3, None)], "i int, t string")
    head = envelope.aad(F.lit("a"), F.lit("b"), {"producer_id": F.lit("p"), "seq": F.col("i")})
    sealed = df.select("i", "t", envelope.seal(F.col("t"), key(), head, scheme).alias("s"))
    assert [(r.t, r.u) for r in sealed.select("t", envelope.unseal(F.col("s"), key(), scheme).alias("u")).collect()] == [("one", "one"), ("", ""), (None, None)]
    if scheme != "NONE":
        other = F.unhex(F.lit(KEY[::-1]))
        assert sealed.where("t IS NOT NULL").select(envelope.unseal(F.col("s"), other, scheme).alias("u")).where("u IS NOT NULL").count() == 0
        nonces = [bytes(r.n) for r in sealed.where("t IS NOT NULL").select(F.col("s.nonce").alias("n")).collect()]
        assert len(set(nonces)) == 2 and all(len(n) == 12 for n in nonces)
    with pytest.raises(ValueError):
        envelope.seal(F.lit("x"), key(), F.lit("h"), "DES")
    with pytest.raises(ValueError):
        envelope.Features(scheme="DES")
    with pytest.raises(ValueError):
        envelope.aad(F.lit("a"), F.lit("b"), {"source": F.lit("x")})


def test_same_origin_and_error_policy(spark):
    head = lambda seq: envelope.aad(F.lit("s"), F.lit("b"), {"producer_id": F.lit("p"), "seq": seq})
    df = spark.createDataFrame([(1, 1), (2, 3)], "x long, y long")
    two = df.select("x", envelope.seal(F.lit("u"), key(), head(F.col("x"))).alias("user"), envelope.seal(F.lit("w"), key(), head(F.col("y"))).alias("word"), envelope.seal(F.lit("5"), key(), head(F.col("x"))).alias("count"))
    chain = lambda f: bounding.check_and_clamp(two, key(), 10, 3.0, "s", "b", "n", ["x"], f)
    assert [r.x for r in chain(envelope.Features()).select("x").collect()] == [1]
    assert chain(envelope.Features(replay=False)).count() == 2
    with pytest.raises(Exception, match="no valid"):
        chain(envelope.Features(isolate=False)).collect()


def test_topology(spark, tmp_path):
    edges = envelope.topology(spark, {"Spout": ["A", "B"], "a": ["Sink"], "b": ["sink"]})
    envelope.write_topology(edges, str(tmp_path / "t"), key())
    back = envelope.read_topology(spark, str(tmp_path / "t"), key())
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, edges.collect()))
    assert envelope.read_topology(spark, str(tmp_path / "t"), F.unhex(F.lit(KEY[::-1]))).count() == 0
    assert envelope.adjacency(edges).first().graph == '{"a":["sink"],"b":["sink"],"spout":["a","b"]}'
    assert envelope.the_route(edges, "A", True) == "spout"
    for component, upstream in (("spout", False), ("spout", True), ("sink", True)):
        with pytest.raises(ValueError):
            envelope.the_route(edges, component, upstream)


def test_service_refuses_null_answers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    assert envelope.service(lambda df: df.where("i = 1"), ("t",))(rows).count() == 1
    with pytest.raises(Exception, match="null t"):
        envelope.service(lambda df: df, ("t",))(rows).collect()


def test_sealed_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"body {i}", i % 3) for i in range(20)], "user_id int, body string, rating int").repartition(3)
    readers.write_sealed(rows, str(tmp_path / "s"), key(), "source", "next")
    back = readers.read_sealed(spark, str(tmp_path / "s"))
    opened = back.select(envelope.unseal(F.col("userId"), key()).alias("u"), envelope.unseal(F.col("payload"), key()).alias("p"))
    got = sorted((int(r.u), F_json(r.p)) for r in opened.collect())
    assert got == [(i, {"body": f"body {i}", "rating": i % 3}) for i in range(20)]
    (tmp_path / "lines.json").write_text('{"userId": null}\n')
    with pytest.raises(ValueError):
        readers.read_sealed(spark, str(tmp_path / "lines.json"))
    (tmp_path / "some.json").write_text('[{"userId": {"header": "h", "nonce": "AA==", "ciphertext": "AA=="}}, {"userId": {"header": "h", "nonce": "AA==", "ciphertext": "AA=="}, "payload": {"header": "h", "nonce": "AA==", "ciphertext": "AA=="}}]')
    assert readers.read_sealed(spark, str(tmp_path / "some.json")).count() == 1


def F_json(text):
    import json

    return json.loads(text)


def test_regenerate_numbers_without_gaps(spark):
    rows = [(i // 2, None if i == 4 else f"b{i}", "c", 1) for i in range(30)] + [(99, "  ", "c", 1), (None, "x", "c", 1)]
    df = spark.createDataFrame(rows, "id long, body string, category string, rating int").repartition(4)
    first, again = (sorted(map(tuple, readers.regenerate(x, 7).collect())) for x in (df, df.repartition(2)))
    assert [r[0] for r in first] == list(range(29)) and first == again
    assert {r[-1] for r in first} <= set(range(1, 8))


def test_reports_params_and_runs(spark, tmp_path):
    (tmp_path / "r.txt").write_text("# comment\n5,10,fresh,false,1,2,3,4,5,6\n\nbad\n12,20,fresh,true,9,2,3,4,5,6\n12,19,stale,true,7,2,3,4,5,6\n")
    r = readers.read_report(spark, str(tmp_path / "r.txt")).first()
    assert (r.tick, r.l0, r.steps) == ("12", 9.0, 100)
    for run in ("lab/t1/n=4/rep2", "lab/t2/rep1", "old/t3/n=8/rep3"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        readers.write_params({"epsilon": 6.5, "users": 100, "prove": "True", "note": "a=b"}, str(tmp_path / "runs" / run / "params.txt"))
    got = sorted((x.label, x.stamp, x.workers, x.repetition) for x in readers.discover_runs(spark, str(tmp_path / "runs")).collect())
    assert got == [("lab", "t1", 4, 2), ("lab", "t2", None, 1), ("old", "t3", 8, 3)]
    assert readers.discover_runs(spark, str(tmp_path / "runs"), ["old"]).count() == 1
    params = readers.read_params(spark, str(tmp_path / "runs"), ("users",), ("prove",), ("epsilon",))
    assert params.where("as_int = 100 OR as_bool OR as_float = 6.5").count() == 9
    wide = readers.params_table(params, ["users", "note"]).collect()
    assert len(wide) == 3 and {(x.users, x.note) for x in wide} == {("100", "a=b")}
    runs = readers.run_path(spark.createDataFrame([("/x/n=4/rep2/p.csv",)], "source_file string")).first()
    assert (runs.workers, runs.repetition, runs.run) == (4, 2, "/x/n=4/rep2")


def test_csv_and_sinks(spark, tmp_path):
    for k in range(2):
        (tmp_path / "c" / str(k)).mkdir(parents=True)
        (tmp_path / "c" / str(k) / "p.csv").write_text("a,b\n1,x\na,b\n2,y\n")
    assert sorted((r.a, r.b) for r in readers.read_csv(spark, str(tmp_path / "c"), "a string, b string").collect()) == [("1", "x"), ("1", "x"), ("2", "y"), ("2", "y")]
    values = spark.createDataFrame([("a", 3), ("b", 9), ("c", 3)], "key string, value long")
    readers.write_histogram(values, str(tmp_path / "h"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "h")).collect()]
    assert lines == ["key:value", "b:9", "a:3", "c:3"]
    truth = spark.createDataFrame([("a", 4), ("b", 9)], "key string, truth long")
    norms = metrics.error_norms(values, truth)
    for tick in (1, 2):
        readers.append_lines(readers.utility_report(norms, tick, "now", True, tick == 2), str(tmp_path / "u.csv"))
    with open(tmp_path / "u.csv") as f:
        rows = list(csv.reader(f))
    assert len(rows) == 3 and rows[0][:4] == ["tick", "timestamp", "freshness", "final"] and rows[2][3:8] == ["true", "1.0", "3.0", "4.0", str(math.sqrt(10))]
    timed = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 1.0)], "task int, ms double")
    out = readers.profile_rows(timed, "bolt", "execute", "ms", F.col("task"))
    readers.write_profile(out, str(tmp_path / "p"))
    readers.write_profile(out, str(tmp_path / "p"))
    assert readers.read_csv(spark, str(tmp_path / "p"), readers.PROFILE).groupBy("taskId").agg(F.sum("sampled").alias("n")).orderBy("taskId").collect()[0].n == 4
    rows, seen = readers.observed(spark.range(50).toDF("i"), "pass")
    assert rows.count() == 50 and seen.get["rows"] == 50


def test_budgets_and_refill(spark):
    b = {r.user: r.budget for r in generator.budgets(spark, 200, 7).collect()}
    assert min(b.values()) >= 1 and abs(np.mean(list(b.values())) - zipf_mandelbrot_mean(100_000, 26.0, 6.738)) < 2
    small = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "user long, budget long")
    drawn = [r.user for r in generator.with_refill(small, 14, 3).orderBy("n").collect()]
    for k in (0, 6):  # every round spends every budget
        assert sorted(drawn[k : k + 6]) == [1, 1, 1, 2, 3, 3]
    assert len(drawn) == 14
    with pytest.raises(ValueError):
        generator.with_refill(small.limit(0), 3)


def test_contributions_do_not_depend_on_partitions(spark):
    a = sorted(map(tuple, generator.contributions(spark, 300, 50, 10).collect()))
    b = sorted(map(tuple, generator.contributions(spark, 300, 50, 10).repartition(3).collect()))
    n = {}
    for u, *_ in a:
        n[u] = n.get(u, 0) + 1
    assert a == b and max(n.values()) <= 32 and {s for *_, s in a} <= set(range(10))


def test_synthetic_stream_keeps_budgets(spark, tmp_path):
    generator.SyntheticStream.register(spark)
    stream = spark.readStream.format("synthetic").options(users="20", keys="9", per_batch="60", seed="3").load()
    q = stream.writeStream.format("memory").queryName("synthetic_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    assert run_bounded(q, 6) >= 6
    rows = spark.table("synthetic_rows").collect()
    per_user = {}
    for r in rows:
        per_user[r.user] = per_user.get(r.user, 0) + 1
    assert len({r.n for r in rows}) == len(rows) and {int(r.key) for r in rows} <= set(range(1, 10))
    cdf = generator.zipf_mandelbrot_cdf(100_000, 26.0, 6.738)
    budget = np.searchsorted(cdf, generator._uniform(np.arange(20), np.zeros(20), 4), side="left") + 1
    assert all(n <= budget[int(u)] for u, n in per_user.items()) and any(n == budget[int(u)] for u, n in per_user.items())


def test_random_sources_and_replay(spark, tmp_path):
    static = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "i long, t string")
    for name, stream in (("floats", generator.random_floats(spark, 50)), ("replay", generator.rate_replay(spark, static, "i", 5, 50))):
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="1 second").start()
        run_bounded(q, 3)
    assert all(0 <= r.value < 1 for r in spark.table("floats").collect())
    assert {r.t for r in spark.table("replay").collect()} <= {f"t{i}" for i in range(5)}


def test_micro_batches(spark):
    plan = generator.batch_plan([1e-7, 2e-7], 2)
    seen = []
    out = generator.run_micro_batches(spark, [(b, g, n) for b, g, n in plan], lambda rows, b: seen.append((b, rows.count())), users=50, keys=5)
    assert seen == [(b, n) for b, _, n in plan] and all(r["t_end_epoch_ms"] - r["t_begin_epoch_ms"] == r["duration_ms"] >= 0 for r in out)
    assert generator.share(10, 0, 3) + generator.share(10, 1, 3) + generator.share(10, 2, 3) == 10
    users = sorted(generator.local_to_global(i, t, 3) for t in range(3) for i in range(4))
    assert users == list(range(12))
    grid = generator.parameter_grid(spark, {"size_gb": [1.0, 2.0], "p": [4, 8]}, 1000, 1.0)
    assert grid.count() == 4 and grid.agg(F.max("timeout_ms")).first()[0] == 7.2e6


def test_groupings(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    parts = generator.grouped(rows, "fields", 5, ["k"]).select("k", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == 7 and generator.grouped(rows, "shuffle", 6).rdd.getNumPartitions() == 6
    assert generator.grouped(rows, "global", 1).rdd.getNumPartitions() == 1 and generator.grouped(rows, "all", 1).count() == 100


def test_quantiles_by_index(spark):
    rng = random.Random(1)
    v = [rng.randrange(40) for _ in range(333)]
    got = profile.discrete_quantiles(spark.createDataFrame([(0, x) for x in v], "g int, x int"), ["g"], "x").first()
    assert (got.p50, got.p90, got.p99) == tuple(sorted(v)[min(int(333 * p), 332)] for p in (0.5, 0.9, 0.99))


def test_ticks_across_spans(spark, monkeypatch):
    from quietcount.operators import merge

    monkeypatch.setattr(merge, "SPAN", 3)
    complete = [(2, 0), (1, 4), (7, 5), (9, 11)]
    got = [tuple(r) for r in merge.tick_releases(spark.range(15).toDF("tick"), spark.createDataFrame([(e, t) for e, t in complete], "epoch int, completed_tick int")).orderBy("tick").collect()]
    want, last = [], None
    for tick in range(15):
        top = max((e for e, t in complete if t <= tick), default=None)
        if top is not None:
            want.append((tick, top, top == last))
            last = top
    assert got == want
