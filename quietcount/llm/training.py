"""Bounded training samples and a small regularised logistic regression, shared by the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.llm.kernel import stored


def training_rows(docs: DataFrame, labels: DataFrame, columns: list[str], limit: int, where=None, max_bytes: int = 32 << 20) -> DataFrame:
    """Whole texts of at most ``limit`` labelled documents and ``max_bytes`` in all, the same ones on every run: those whose ids hash
    lowest. A document's largest labels count; of rows that share an id the one of the shortest text, then lowest hash, is taken."""
    known = labels.where(F.col("doc_id").isNotNull())
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most ``limit`` rows of a few numbers
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select("doc_id", body.alias("text"), F.octet_length(body).alias("_n"), F.xxhash64(body).alias("_k")).join(F.broadcast(known), "doc_id"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("_n", "_k")).alias("_one"))  # a row for each of the known ids
    upto = F.sum("_one._n").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = one.withColumn("_upto", upto).where(F.col("_upto") <= max_bytes).select("doc_id", "_one._n", "_one._k")
    return rows.join(F.broadcast(some), ["doc_id", "_n", "_k"]).dropDuplicates(["doc_id"]).select("doc_id", "text", *columns)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights, the last for the constant, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]) if len(x) else np.zeros((0, x.shape[1] + 1))
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    if len(x) == 0:
        return w
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.5 * (ridge * w * w).sum()
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        now, share = loss(w), 1.0
        while share > 1e-3 and loss(w - share * step) > now:
            share /= 2
        w = w - share * step
        if np.abs(step).max() < 1e-5:
            break
    return w
