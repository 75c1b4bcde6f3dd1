"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own shape (length, letters, symbols, repeated words, words among the
commonest) and that of the lines before and after; a transition weight ties neighbours. Training lines take their
document's label. Forward-backward marginals, weighted by line length, give the document's score, which a fitted
logistic curve maps to the probability of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietcount.llm.kernel import Words, found, map_text, named_again, positional, slices
from quietcount.llm.training import logistic, sigmoid, training_rows

COMMON = 256
N_SHAPE = 11


@dataclass(frozen=True)
class Field:
    #: at most so many labelled documents are used for fitting
    sample: int = 4_000
    steps: int = 120
    rate: float = 0.08
    l2: float = 1e-4


@dataclass
class Model:
    common: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features for "good"; the last is the constant
    pull: np.ndarray  # 2 x 2 transition scores
    curve: tuple[float, float]


def _class(*codes: int) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(codes)] = 1
    return out


_UPPER = _class(*range(0x41, 0x5B))
_LETTER = _class(*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100))
_DIGIT = _class(*range(0x30, 0x3A))
_BLANK = _class(0x20, 0x09, 0x0D)
_STOP = _class(*b".!?:;,")
_ODD = 1 - np.maximum.reduce([_LETTER, _DIGIT, _BLANK, _STOP, _class(0x0A)])
_PIPE = _class(*b"|<>{}[]=")


def line_shapes(off: np.ndarray, data: np.ndarray, common: np.ndarray, words: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range of lines of each text, length of each line in bytes, features of each line). Every text has a line."""
    n = len(data)
    words = words or Words(off, data)
    breaks = np.flatnonzero(data == 0x0A) + 1
    text = np.searchsorted(off[1:], breaks - 1, "right")
    start = np.concatenate([off[:-1], breaks])
    order = np.lexsort((np.concatenate([np.zeros(len(off) - 1, np.int64), np.ones(len(breaks), np.int64)]), start, np.concatenate([np.arange(len(off) - 1), text])))
    start = start[order]
    lines = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(off) - 1) + 1)])
    end = np.concatenate([start[1:], [n]])
    byte = data if n else np.zeros(1, np.uint8)  # texts may all be empty
    broken = np.zeros(len(start), bool)
    broken[:-1] = (end[:-1] > start[:-1]) & (byte[np.maximum(end[:-1] - 1, 0)] == 0x0A) & (np.isin(np.arange(1, len(start)), lines[1:-1], invert=True))
    size = end - start - broken

    def count(table: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return (total[end] - total[start]).astype(float)

    def per_line(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[wb] - total[wa]).astype(float)

    wa, wb = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    h = words.hash
    same1, same2 = np.zeros(len(h), bool), np.zeros(len(h), bool)
    same1[1:] = h[1:] == h[:-1]
    same2[2:] = h[2:] == h[:-2]
    head = words.range[:-1][words.range[:-1] < len(h)]  # a text's first words repeat nothing
    same1[head], same2[head] = False, False
    same2[np.minimum(head + 1, len(h) - 1)] = False
    nw = np.maximum(wb - wa, 1).astype(float)
    size1 = np.maximum(size, 1).astype(float)
    letters = np.maximum(count(_LETTER), 1)
    last = np.where(size > 0, byte[np.maximum(start + size - 1, 0)], 0)
    f = np.stack(
        [
            np.log1p(size),
            np.minimum(count(_UPPER) / letters, 1),
            count(_ODD) / size1,
            count(_DIGIT) / size1,
            count(_BLANK) / size1,
            per_line(same1) / nw,
            per_line(same2) / nw,
            per_line(found(h, common)) / nw,
            np.isin(last, np.frombuffer(b".!?", np.uint8)).astype(float),
            count(_PIPE) / size1,
            np.log1p(count(_LETTER) / nw),
        ],
        1,
    )
    return lines, size, np.round(f, 9)  # the last digits of logarithms depend on a line's place in its slice


def with_neighbours(f: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, their clipped squares, those of the line before and after, and two edge flags."""
    first, last = np.zeros(len(f), bool), np.zeros(len(f), bool)
    first[lines[:-1]] = True
    last[lines[1:] - 1] = True
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first], after[last] = 0, 0
    return np.hstack([f, np.minimum(f * f, 16), before, after, first[:, None], last[:, None]])


def marginals(score: np.ndarray, lines: np.ndarray, pull: np.ndarray, pairs: np.ndarray | None = None):
    """P(good) of each line by forward-backward, all texts at once, line by line; with ``pairs``, a weight for each
    line, also the expected transitions, each by its second line's weight. score: log potential of good over bad."""
    count = np.diff(lines)
    order = np.argsort(-count, kind="stable")
    start, count = lines[:-1][order], count[order]
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), "left")
    e = np.stack([np.zeros(len(score)), score], 1)
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    for t in range(longest):
        at = start[: active[t]] + t
        if t == 0:
            alpha[at] = e[at]
        else:
            a = alpha[at - 1]
            alpha[at, 0] = e[at, 0] + np.logaddexp(a[:, 0] + pull[0, 0], a[:, 1] + pull[1, 0])
            alpha[at, 1] = e[at, 1] + np.logaddexp(a[:, 0] + pull[0, 1], a[:, 1] + pull[1, 1])
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        b = beta[at + 1] + e[at + 1]
        beta[at, 0] = np.logaddexp(pull[0, 0] + b[:, 0], pull[0, 1] + b[:, 1])
        beta[at, 1] = np.logaddexp(pull[1, 0] + b[:, 0], pull[1, 1] + b[:, 1])
    s = alpha + beta
    z = np.logaddexp(s[:, 0], s[:, 1])
    p = np.exp(s[:, 1] - z)
    if pairs is None:
        return p
    inner = np.ones(len(score), bool)
    inner[lines[:-1]] = False
    at = np.flatnonzero(inner)
    joint = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            joint[i, j] = (np.exp(alpha[at - 1, i] + pull[i, j] + e[at, j] + beta[at, j] - z[at]) * pairs[at]).sum()
    return p, joint


def document_scores(p: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    weight = size + 1.0
    total = lambda x: np.add.reduceat(x, lines[:-1]) if len(x) else np.zeros(0)
    return total(p * weight) / total(weight)


def fit(texts: list[str], quality: np.ndarray, params: Field = Field()) -> Model:
    """Fit on whole texts and their labels (1 good, 0 bad). Without texts the score is one half everywhere."""
    width = 4 * N_SHAPE + 2
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    total: dict[int, int] = {}
    for _, off, data in slices(batch, "text"):  # slice by slice: memory stays bounded by a slice
        every, n = np.unique(Words(off, data).hash, return_counts=True)
        some = np.argsort(-n, kind="stable")[: 16 * COMMON]
        for h, k in zip(every[some].tolist(), n[some].tolist(), strict=True):
            total[h] = total.get(h, 0) + k
    common = np.sort(np.array(sorted(total, key=lambda h: (-total[h], h))[:COMMON], np.uint64))
    if not texts:
        return Model(common, np.zeros(N_SHAPE), np.ones(N_SHAPE), np.zeros(width + 1), np.zeros((2, 2)), (0.0, 0.0))
    shapes = [line_shapes(off, data, common) for _, off, data in slices(batch, "text")]
    lines = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[0]) for x in shapes]))])
    size, f = np.concatenate([x[1] for x in shapes]), np.concatenate([x[2] for x in shapes])
    mean, scale = f.mean(0), f.std(0) + 1e-6
    x = with_neighbours(np.clip((f - mean) / scale, -6, 6), lines)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.repeat(quality.astype(float), np.diff(lines))
    n_lines = np.diff(lines)
    share = np.where(quality == 1, 0.5 / max(quality.sum(), 1), 0.5 / max((1 - quality).sum(), 1))  # classes weigh alike
    inner = np.ones(len(y), bool)
    inner[lines[:-1]] = False
    w, pull = np.zeros(x.shape[1]), np.zeros((2, 2))
    # one objective: each document's log likelihood by its weight, of features and transitions alike, and one penalty
    each = np.repeat(share / n_lines, n_lines) * 1.0
    seen = np.diag([(each * ((y == k) & inner)).sum() for k in (0, 1)])
    m = [np.zeros_like(w), np.zeros_like(pull)]
    v = [np.zeros_like(w), np.zeros_like(pull)]
    for step in range(1, params.steps + 1):
        p, joint = marginals(x @ w, lines, pull, each)
        grads = [x.T @ ((p - y) * each) + params.l2 * w, joint - seen + params.l2 * pull]
        for k, (g, target) in enumerate(zip(grads, (w, pull), strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            target -= params.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    raw = document_scores(marginals(x @ w, lines, pull), size, lines)
    curve = logistic(_logit(raw)[:, None], quality.astype(float), 1e-2)
    return Model(common, mean, scale, w, pull, (float(max(curve[0], 0.0)), float(curve[1])))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def score_quality(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of every row (all by default) and score, predicted, line_good (P(good) of each line).

    A null or empty text is one empty line; a text of any length is scored whole, its lines one after another. Repeated rows score
    alike, to nine decimals; a score of one half is predicted 1. An empty table gives an empty result; columns named like a new
    one, in any case, are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(off, data, part):
            lines, size, f = line_shapes(off, data, m.common)
            x = with_neighbours(np.clip((f - m.mean) / m.scale, -6, 6), lines)
            p = marginals(x @ m.weights[:-1] + m.weights[-1], lines, m.pull)
            s = np.round(sigmoid(m.curve[0] * _logit(document_scores(p, size, lines)) + m.curve[1]), 9)
            good = pa.ListArray.from_arrays(pa.array(lines, pa.int32()), pa.array(p.astype(np.float32)))
            return pa.array(s), pa.array((s >= 0.5).astype(np.int32)), good

        return work

    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("line_good", T.ArrayType(T.FloatType()))]
    return map_text(docs, text, docs.columns if carry is None else carry, new, make)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, params: Field = Field()) -> Model:
    rows = training_rows(docs, labels, ["quality"], params.sample, ~held_out()).toPandas().sort_values("doc_id")
    return fit(rows["text"].fillna("").tolist(), rows["quality"].to_numpy().astype(int), params)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_quality(docs, train_quality(docs, labels), carry=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, that are not rejected: nulls, empty and long texts, ties, repeated rows and empty
    tables as in ``score_quality``. Without labels every score is one half and all rows stay."""
    own, at = positional(docs)
    out = score_quality(own, train_quality(docs, labels), at["text"])
    return out.where("predicted = 1").select(*named_again(docs.columns, at))


SQL: dict[str, str] = {}
