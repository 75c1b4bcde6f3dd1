"""Readers and writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quietcount.functions.envelope import aad, seal
from quietcount.functions.text import REQUIRED

_PART = "struct<header:string,nonce:string,ciphertext:string>"
PROFILE = "timestamp timestamp, component string, taskId int, type string, name string, total bigint, sampled bigint, avgMs double, minMs double, maxMs double"
MICROBATCH = "run_id int, parallelism int, batch_id int, size_gb double, n_records bigint, bytes_per_tuple bigint, duration_ms bigint, t_begin_epoch_ms bigint, t_end_epoch_ms bigint, producers int"
REPORT = "tick string, timestamp string, freshness string, final string, l0 double, l_inf double, l1 double, l2 double, dp_keys bigint, gt_keys bigint"
UTILITY = "T int, alpha double, composition string, mu bigint, run int, l0_mean double, l_inf_mean double, l1_mean double, l2_mean double, sec_per_run double, eps_round double, delta_round double, sigma_key double, sigma_hist double, beta double, threshold_quantile double, tau_at_last_step double"


def read_sealed(spark: SparkSession, path: str) -> DataFrame:
    """userId and payload of each entry of a JSON array, as sealed values; entries that lack a field are skipped. A file that
    is no array is an error."""
    heads = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1).alias("h"))
    if heads.where("h <> '['").limit(1).count():
        raise ValueError(f"{path} holds no JSON array")
    raw = spark.read.schema(f"userId {_PART}, payload {_PART}").option("multiLine", True).json(path)
    one = lambda c: F.struct(F.col(f"{c}.header").cast("binary").alias("associatedData"), F.unbase64(f"{c}.nonce").alias("nonce"), F.unbase64(f"{c}.ciphertext").alias("ciphertext"))
    whole = F.lit(True)
    for c in ("userId", "payload"):
        for f in ("header", "nonce", "ciphertext"):
            whole = whole & F.col(f"{c}.{f}").isNotNull()
    return raw.where(whole).select(one("userId").alias("userId"), one("payload").alias("payload"))


def write_sealed(rows: DataFrame, path: str, key, source: str, destination: str) -> None:
    """Seals user_id and the other fields apart, under one header."""
    head = aad(F.lit(source), F.lit(destination))
    rest = F.to_json(F.struct(*[c for c in rows.columns if c != "user_id"]))
    sealed = rows.select(seal(F.col("user_id").cast("string"), key, head).alias("u"), seal(rest, key, head).alias("p"))
    part = lambda c: F.struct(F.col(f"{c}.associatedData").cast("string").alias("header"), F.base64(f"{c}.nonce").alias("nonce"), F.base64(f"{c}.ciphertext").alias("ciphertext"))
    entries = sealed.select(F.to_json(F.struct(part("u").alias("userId"), part("p").alias("payload"))).alias("e"))
    # each part file is an array of its own, so that parts are written and read side by side
    entries.mapInPandas(_as_array, "value string").write.mode("overwrite").text(path)


def _as_array(parts):
    first = True
    for pdf in parts:
        for e in pdf["e"]:
            yield pd.DataFrame({"value": [("[" if first else ",") + e]})
            first = False
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def regenerate(rows: DataFrame, users: int = 500, seed: int = 42) -> DataFrame:
    """Drop records that lack a required field or have a blank body, renumber from 0, and give each a user by
    lognormal weight. Numbers come from a range sort and per-partition offsets, not from one task; rows of equal id are
    ordered by all their columns, and a row's draw follows from its number, so a task that runs again gives the same."""
    good = rows.dropna(subset=list(REQUIRED)).where(F.trim("body") != "")
    ordered = good.orderBy("id", *[c for c in good.columns if c != "id"]).withColumn("_u", F.monotonically_increasing_id())
    part = F.shiftright("_u", 33)
    counts = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    start = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))  # a row for each partition
    numbered = ordered.withColumn("_p", part).join(F.broadcast(start), "_p").withColumn("id", (F.col("_s") + F.col("_u").bitwiseAND((1 << 33) - 1)).cast("long"))
    import numpy as np

    w = np.random.default_rng(seed).lognormal(0, 1, users)
    cdf = F.array(*[F.lit(float(x)) for x in np.cumsum(w) / w.sum()])
    at = F.aggregate(cdf, F.lit(1), lambda acc, x: acc + (x < F.col("_r")).cast("int"))
    return numbered.withColumn("_r", F.xxhash64(F.lit(seed), "id") / F.lit(2.0**64) + 0.5).withColumn("user_id", F.least(at, F.lit(users))).drop("_u", "_p", "_s", "_r")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """All CSV files below a path, tagged with their file; repeated header rows go."""
    first = T._parse_datatype_string(schema).fields[0].name
    df = spark.read.schema(schema).option("header", header).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").csv(path)
    return df.withColumn("source_file", F.input_file_name()).where(F.col(first).isNotNull() & (F.col(first).cast("string") != first))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each report, by tick and time; malformed and commented lines go."""
    df = spark.read.schema(REPORT).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("mode", "DROPMALFORMED").csv(path).where(F.col("l0").isNotNull())
    df = df.withColumn("file", F.input_file_name())
    per = df.groupBy("file").agg(F.count("*").alias("rows"), F.max_by(F.struct(*[c for c in df.columns if c != "file"]), F.struct(F.expr("try_cast(tick AS bigint)"), "timestamp")).alias("last"))
    return per.select("file", "last.*", F.when(F.col("rows") > 200, 1000).otherwise(100).alias("steps"))


def read_params(spark: SparkSession, path: str, ints: tuple = (), bools: tuple = (), floats: tuple = ()) -> DataFrame:
    """(file, name, value, as_int, as_bool, as_float) of key=value files: one row for each line."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).withColumn("file", F.input_file_name())
    kv = F.split("value", "=", 2)
    rows = lines.where(F.col("value").contains("=")).select("file", F.trim(kv[0]).alias("name"), F.trim(kv[1]).alias("value"))
    return rows.select("*", F.when(F.col("name").isin(*ints), F.expr("try_cast(value AS bigint)")).alias("as_int"), F.when(F.col("name").isin(*bools), F.lower("value") == "true").alias("as_bool"), F.when(F.col("name").isin(*floats), F.expr("try_cast(value AS double)")).alias("as_float"))


def params_table(params: DataFrame, names: list[str]) -> DataFrame:
    """A row for each file with a column for each of ``names``; the last of repeated lines counts for nothing, the largest does."""
    return params.groupBy("file").pivot("name", names).agg(F.max("value"))


def run_path(rows: DataFrame, file: str = "source_file") -> DataFrame:
    """Workers and repetition from a run's path: ``n=`` and ``rep``."""
    number = lambda p: F.expr("try_cast(nullif({}, '') AS int)".format(f"regexp_extract({file}, '{p}', 1)"))
    return rows.withColumns({"workers": number(r"n=([0-9]+)"), "repetition": number(r"rep([0-9]+)"), "run": F.regexp_extract(file, r"^(.*)/[^/]*$", 1)})


def discover_runs(spark: SparkSession, root: str, labels: list[str] | None = None) -> DataFrame:
    """(label, stamp, workers, repetition, run) of each run that has a params.txt below ``root``, in either layout:
    label/timestamp/run or label/timestamp/n=N/run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "params.txt").load(root).select(F.regexp_replace("path", r"^file:/+", "/").alias("path"))
    base = root.rstrip("/").removeprefix("file:")
    below = files.select(F.regexp_extract("path", r"^(.*)/params\.txt$", 1).alias("run")).withColumn("_p", F.split(F.substring(F.col("run"), len(base) + 2, 1 << 20), "/"))
    number = lambda p, c: F.expr(f"try_cast(nullif(regexp_extract({c}, '{p}', 1), '') AS int)")
    out = below.where(F.size("_p").between(3, 4)).select(F.col("_p")[0].alias("label"), F.col("_p")[1].alias("stamp"), number("n=([0-9]+)", "run").alias("workers"), number("rep([0-9]+)", "run").alias("repetition"), "run")
    return out if labels is None else out.where(F.col("label").isin(*labels))


def write_histogram(values: DataFrame, path: str, header: str | None = "key:value") -> None:
    """A header line, then ``key:value`` lines, largest first. One file: a released histogram is small."""
    lines = values.select(F.lit(1).alias("_o"), F.col("value").alias("_v"), F.col("key").cast("string").alias("_k"), F.concat_ws(":", "key", F.col("value").cast("string")).alias("line"))
    if header is not None:
        first = values.sparkSession.createDataFrame([(0, header)], "_o int, line string").select("_o", F.lit(0).cast(lines.schema["_v"].dataType).alias("_v"), F.lit("").alias("_k"), "line")
        lines = first.unionByName(lines)
    lines.orderBy("_o", F.desc("_v"), "_k").select("line").coalesce(1).write.mode("overwrite").text(path)


def utility_report(norms: DataFrame, tick: int, timestamp: str, fresh: bool, final: bool | None = None) -> DataFrame:
    """One row of a utility report from ``error_norms``; without ``final`` the column is left out."""
    cols = [F.lit(tick).alias("tick"), F.lit(timestamp).alias("timestamp"), F.lit("fresh" if fresh else "stale").alias("freshness")]
    cols += [] if final is None else [F.lit(str(final).lower()).alias("final")]
    return norms.select(*cols, F.abs(F.col("keys_released") - F.col("keys_true")).cast("double").alias("l0"), F.col("l_inf").cast("double").alias("l_inf"), F.col("l1").cast("double").alias("l1"), F.col("l2").cast("double").alias("l2"), F.col("keys_released").alias("dp_keys"), F.col("keys_true").alias("gt_keys"))


def append_lines(rows: DataFrame, path: str, header: bool = True) -> None:
    """Append a few rows to one CSV file whose header stands once. For reports of the driver, a row or so at a time."""
    import csv
    import os

    fresh = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "a", newline="") as f:
        out = csv.writer(f)
        if fresh and header:
            out.writerow(rows.columns)
        out.writerows(rows.collect())


def profile_rows(rows: DataFrame, component: str, name: str, value: str, task=None) -> DataFrame:
    """Profiler rows of a timed column: for each task a window's count, mean, least and most, with its total."""
    task = F.spark_partition_id() if task is None else task
    return rows.groupBy(task.alias("taskId")).agg(F.count(value).alias("sampled"), F.avg(value).alias("avgMs"), F.min(value).cast("double").alias("minMs"), F.max(value).cast("double").alias("maxMs")).select(
        F.current_timestamp().alias("timestamp"), F.lit(component).alias("component"), "taskId", F.lit("timer").alias("type"), F.lit(name).alias("name"), F.col("sampled").alias("total"), "sampled", "avgMs", "minMs", "maxMs"
    )


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, object]:
    """``rows`` counted as they pass: (table, observation); the counts are there after the next action, at no extra pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(F.spark_partition_id()).alias("last_task")), seen


def write_profile(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Profiler rows, a folder for each component and task; ``csv`` or ``json``. Each dump is appended."""
    out = rows.withColumns({"part_component": F.col("component"), "part_task": F.col("taskId")}).write.mode("append").partitionBy("part_component", "part_task")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def log_sink(stream: DataFrame, every: str = "5 seconds"):
    """Shows each micro-batch of a stream in the driver's log."""
    return stream.writeStream.format("console").option("truncate", False).trigger(processingTime=every).start()


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def write_params(params: dict, path: str) -> None:
    with open(path, "w") as f:
        f.writelines(f"{k}={v}\n" for k, v in params.items())
