"""Toxicity by classifier chains.

Categories are predicted one after another by linear models over the words, and word beginnings, of a text; the probability of each earlier
category is an input of the later models. For training those inputs come out of fold: a document's earlier probability
is given by a model that has not seen it, as it will be for new documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietcount.llm.kernel import U, Words, found, map_text, quoted
from quietcount.llm.training import logistic, sigmoid, training_rows

PREFIXES = (4, 5)
_BITS = U((1 << 20) - 1)


@dataclass(frozen=True)
class Chain:
    #: at most so many labelled documents are used for fitting
    sample: int = 5_000
    folds: int = 4
    features: int = 256
    l2: float = 1.0
    categories: tuple = (("unfit", "quality", 0), ("toxic", "toxic", 1))  # name, label column, its value


@dataclass
class Fitted:
    names: list[str] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)  # hashes, sorted, for each category
    weights: list[np.ndarray] = field(default_factory=list)  # of the words, of log length, of earlier categories, constant


def traits(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the words themselves and of the beginnings of longer ones, which inflected forms share."""
    parts = [(np.arange(len(words)), words.hash)] + [words.prefix(n) for n in PREFIXES]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _presence(bags: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bags), len(words)))
    for i, b in enumerate(bags):
        b = b[found(b, words)]
        out[i, np.searchsorted(words, b)] = 1
    return out


def select_words(bags: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """Words whose presence tells most about the class: by the likelihood ratio of the two-by-two table."""
    if not bags:
        return np.zeros(0, np.uint64)
    every, n = np.unique(np.concatenate(bags), return_counts=True)
    every = every[n >= 3]  # most words are too rare to tell anything
    pos, neg = np.zeros(len(every)), np.zeros(len(every))
    for b, k in zip(bags, y, strict=True):
        (pos if k else neg)[np.searchsorted(every, b[found(b, every)])] += 1
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    gain = np.zeros(len(every))
    for seen, rows in ((pos, n1), (neg, n0)):
        for some, all_ in ((seen, pos + neg), (rows - seen, n1 + n0 - pos - neg)):
            some = np.maximum(some, 0)
            gain += some * np.log(np.maximum(some, 1e-12) * (n1 + n0) / np.maximum(all_ * rows, 1e-12))
    best = np.argsort(-gain, kind="stable")[:most]
    return np.sort(every[best[gain[best] > 4.0]])



def fit_chain(bags: list[np.ndarray], sizes: np.ndarray, targets: list[np.ndarray], chain: Chain) -> Fitted:
    out, earlier = Fitted(), np.zeros((len(bags), 0))
    fold = np.arange(len(bags)) % chain.folds
    size = np.log1p(sizes)[:, None] / 8
    for (name, _, _), y in zip(chain.categories, targets, strict=True):
        held = np.zeros(len(bags))
        for f in range(chain.folds):
            tr, te = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            words = select_words([bags[i] for i in tr], y[tr], chain.features)
            x = np.hstack([_presence(bags, words), size, earlier])
            w = logistic(x[tr], y[tr], chain.l2)
            held[te] = sigmoid(x[te] @ w[:-1] + w[-1])
        words = select_words(bags, y, chain.features)
        out.names.append(name)
        out.words.append(words)
        out.weights.append(logistic(np.hstack([_presence(bags, words), size, earlier]), y, chain.l2))
        earlier = np.hstack([earlier, held[:, None]])
    return out


def _bags(docs: DataFrame, extra: list[str]) -> DataFrame:
    def make():
        def work(off, data, part):
            words = Words(off, data)
            at, value = traits(words)
            order = np.argsort(at, kind="stable")
            value, ends = value[order], np.searchsorted(at[order], words.range)
            out = [np.unique(value[a:b]).view(np.int64) for a, b in zip(ends, ends[1:], strict=False)]
            return pa.array(out, pa.list_(pa.int64())), pa.array(np.diff(words.range), pa.int64())

        return work

    return map_text(docs, "text", extra, [T.StructField("bag", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())], make)


def train_chain(docs: DataFrame, labels: DataFrame, chain: Chain = Chain(), where=None) -> Fitted:
    columns = list(dict.fromkeys(c for _, c, _ in chain.categories))
    rows = _bags(training_rows(docs, labels, columns, chain.sample, where), ["doc_id", *columns]).toPandas().sort_values("doc_id")
    targets = [(rows[c].to_numpy() == v).astype(float) for _, c, v in chain.categories]
    return fit_chain([np.asarray(b, np.int64).view(np.uint64) for b in rows.bag], rows["size"].to_numpy(float), targets, chain)


def _bitmaps(model: Fitted) -> list[np.ndarray]:
    out = []
    for words in model.words:
        b = np.zeros(int(_BITS) + 1, bool)
        b[(words & _BITS).astype(np.int64)] = True
        out.append(b)
    return out


def probabilities(m: Fitted, words: Words, n: int, bits: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Each category's probability of n texts, one category after another."""
    where, value = traits(words)
    low = (value & _BITS).astype(np.int64)
    size, earlier = np.log1p(np.diff(words.range)) / 8, []
    for own, bit, w in zip(m.words, bits or _bitmaps(m), m.weights, strict=True):
        at = np.flatnonzero(bit[low])
        at = at[found(value[at], own)]
        k = max(len(own), 1)
        pair = np.unique(words.text_of(where[at]) * k + np.searchsorted(own, value[at]))
        logit = np.bincount(pair // k, weights=w[pair % k], minlength=n)[:n] if len(pair) else np.zeros(n)
        logit = logit + size * w[len(own)] + w[-1]
        for j, p in enumerate(earlier):
            logit = logit + p * w[len(own) + 1 + j]
        earlier.append(sigmoid(logit))
    return earlier


def score_toxicity(docs: DataFrame, model: Fitted, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of every row (all by default) and p_<category> for each category of the chain.

    A null or empty text has no words and gets what the models give for that; a text of any length is scored whole. Without training
    rows every probability is one half. Repeated rows score alike. An empty table gives an empty result; columns named like a
    new one, in any case, are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        bits = _bitmaps(m)

        def work(off, data, part):
            return [pa.array(p) for p in probabilities(m, Words(off, data), len(off) - 1, bits)]

        return work

    new = [T.StructField(f"p_{n}", T.DoubleType()) for n in model.names]
    return map_text(docs, text, docs.columns if carry is None else carry, new, make)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_toxicity(docs, train_chain(docs, labels), carry=["doc_id"])
    return out.select(*[F.col(quoted(c)) for c in out.columns], (F.col("p_toxic") >= 0.5).alias("toxic"))


SQL: dict[str, str] = {}
