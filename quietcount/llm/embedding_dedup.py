"""Embedding near-dedup by product quantisation.

Vectors are compared within their label by cosine. Identical vectors are first collapsed to one representative with its
multiplicity. Coarse centroids (inverted lists) and residual codebooks are fitted on a bounded sample; every vector is
indexed, in its nearest centroid's list. A vector probes a foreign list when the list's radius allows a neighbour there and the plane
between both centroids is at most half the radius away. A pair is found from either side: the distances of its two vectors to
the plane between their centroids add up to no more than their own distance, so one of them lies within half the radius and no
link is missed, whatever the spread of the vectors.

In a probed list, table look-ups give asymmetric distances to the coded members; a member whose distance less
its own coding error exceeds the radius cannot be a neighbour; all others are ranked again by exact cosine in double precision.
A list's rows are cut into tiles of bounded size, however many share it. A tile returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietcount.llm.components import components
from quietcount.llm.kernel import cut, quoted


@dataclass(frozen=True)
class Quantiser:
    min_cosine: float = 0.93
    sample: int = 20_000
    per_list: int = 500
    max_lists: int = 1024
    subspaces: int = 8
    codes: int = 64
    tile: int = 2048
    seed: int = 7

    @property
    def radius(self) -> float:
        return float(np.sqrt(2 - 2 * self.min_cosine)) + 1e-7

    @property
    def margin(self) -> float:
        return self.radius / 2 + 1e-9


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, 1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


class Codebook:
    """Coarse centroids and residual codebooks for each dimensionality seen in the sample."""

    def __init__(self, unit: dict[int, np.ndarray], rows: int, q: Quantiser):
        rng = np.random.default_rng(q.seed)
        self.coarse, self.books, self.cuts = {}, {}, {}
        for dim, x in unit.items():
            self.coarse[dim] = _kmeans(x, min(q.max_lists, max(1, rows // q.per_list)), rng)
            rest = x - self.coarse[dim][_nearest(x, self.coarse[dim])]
            self.cuts[dim] = np.linspace(0, dim, min(q.subspaces, dim) + 1).astype(int)
            self.books[dim] = [_kmeans(rest[:, a:b], q.codes, rng) for a, b in zip(self.cuts[dim], self.cuts[dim][1:], strict=False)]

    def of(self, dim: int):
        if dim not in self.coarse:  # a dimensionality that the sample lacks: one list around the origin, one code
            self.coarse[dim], self.cuts[dim], self.books[dim] = np.zeros((1, dim)), np.array([0, dim]), [np.zeros((1, dim))]
        return self.coarse[dim], self.books[dim], self.cuts[dim]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, coding error and distance to the list's centroid."""
        coarse, books, cuts = self.of(x.shape[1])
        own = _nearest(x, coarse)
        rest = x - coarse[own]
        codes = np.stack([_nearest(rest[:, a:b], k) for k, a, b in zip(books, cuts, cuts[1:], strict=False)], 1).astype(np.uint8)
        back = np.concatenate([k[codes[:, j]] for j, k in enumerate(books)], 1)
        return own, codes, np.linalg.norm(rest - back, axis=1), np.linalg.norm(rest, axis=1)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List of each vector, distance to its centroid."""
        coarse = self.of(x.shape[1])[0]
        own = _nearest(x, coarse)
        return own, np.linalg.norm(x - coarse[own], axis=1)

    def plane(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Distance of each vector to the plane between its own centroid and another one."""
        coarse = self.of(x.shape[1])[0]
        a, b = coarse[own], coarse[other]
        return (((x - b) ** 2).sum(1) - ((x - a) ** 2).sum(1)) / (2 * np.maximum(np.linalg.norm(a - b, axis=1), 1e-12))

    def probes(self, x: np.ndarray, own: np.ndarray, reach: np.ndarray, q: Quantiser) -> tuple[np.ndarray, np.ndarray]:
        """(vector, foreign list) of every probe."""
        coarse = self.of(x.shape[1])[0]
        at, lists = [], []
        for s in range(0, len(x), 1024):
            d2 = np.maximum(1 - 2 * x[s : s + 1024] @ coarse.T + (coarse**2).sum(1)[None], 0)
            i, k = np.nonzero(np.sqrt(d2) <= reach[None] + q.radius + 1e-7)
            i, k = (i + s)[k != own[i + s]], k[k != own[i + s]]
            for c in range(0, len(i), 65536):
                ic, kc = i[c : c + 65536], k[c : c + 65536]
                near = self.plane(x[ic], own[ic], kc) <= q.margin
                at.append(ic[near])
                lists.append(kc[near])
        return (np.concatenate(at), np.concatenate(lists)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def table(self, x: np.ndarray, list_: int) -> list[np.ndarray]:
        """Squared distances from each query's residual to each code of each subspace."""
        coarse, books, cuts = self.of(x.shape[1])
        rest = x - coarse[list_]
        return [((rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ k.T + (k * k).sum(1)[None]) for k, a, b in zip(books, cuts, cuts[1:], strict=False)]


def _unit(raw: list, kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.Array, kind: type) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
    """The vectors' bytes, and (positions, unit vectors) for each dimensionality."""
    raw = [np.asarray(x, kind).tobytes() for x in column.to_pylist()]
    size = np.array([len(b) for b in raw])
    return raw, [(at, _unit([raw[i] for i in at], kind)) for n in np.unique(size) for at in [np.flatnonzero(size == n)]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as the links (a, b): each node and the smallest that it reaches here."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            break
        root = new
    out = root != np.arange(len(nodes))
    return nodes[out], nodes[root[out]]


def _tile_links(q: Quantiser, shared, kind: type):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        book, own = shared.value, int(pdf.list.iloc[0])
        x, ids, weight, home = _unit(list(pdf.vec), kind), pdf.rep.to_numpy(), pdf.n.to_numpy(), pdf.home.to_numpy()
        member, low, high = home == own, (pdf.spot == pdf.ti).to_numpy(), (pdf.spot == pdf.tj).to_numpy()
        counts, ea, eb = np.zeros(len(pdf), np.int64), [], []
        if not member.any():
            return pd.DataFrame({"rep": [], "other": [], "n": []}).astype("int64")
        codes = np.zeros((len(pdf), len(book.of(x.shape[1])[1])), np.uint8)
        codes[member] = np.stack([np.frombuffer(b, np.uint8) for b in pdf.codes[member]])
        far = (q.radius + pdf.err.fillna(0.0).to_numpy()) ** 2 + 1e-9

        def search(queries: np.ndarray, members: np.ndarray, once: bool) -> None:
            """``once``: these pairs come in this order alone. A foreign query's pair comes in the other order where the member probes its list."""
            if not len(queries) or not len(members):
                return
            y, c, f = x[members], codes[members], far[members]
            for s in range(0, len(queries), 512):
                part = queries[s : s + 512]
                d = sum(t[:, c[:, j]] for j, t in enumerate(book.table(x[part], own)))
                i, j = np.nonzero(d <= f[None])
                if len(i) > 0.1 * d.size:
                    near = (x[part] @ y.T)[i, j]
                else:
                    near = np.concatenate([np.einsum("ij,ij->i", x[part[i[k : k + 65536]]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
                i, j = part[i[near >= q.min_cosine]], members[j[near >= q.min_cosine]]
                i, j = i[i != j], j[i != j]
                if not len(i):
                    continue
                np.add.at(counts, i, weight[j])
                lone = np.full(len(i), once)
                for k in range(0, len(i), 65536):
                    foreign = np.flatnonzero(home[i[k : k + 65536]] != own) + k
                    lone[foreign] = book.plane(x[j[foreign]], home[j[foreign]], home[i[foreign]]) > q.margin
                np.add.at(counts, j[lone], weight[i[lone]])
                a, b = forest(ids[i], ids[j])
                ea.append(a)
                eb.append(b)

        rows = np.arange(len(pdf))
        if pdf.ti.iloc[0] == pdf.tj.iloc[0]:
            search(rows, rows[member], False)
        else:
            search(rows[low], rows[member & high], True)
            search(rows[high & ~member], rows[member & low], True)
        ea, eb = forest(np.concatenate(ea), np.concatenate(eb)) if ea else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        some = np.flatnonzero(counts)
        return pd.DataFrame({"rep": np.concatenate([ids[some], ea]).astype("int64"), "other": np.concatenate([np.full(len(some), -1), eb]).astype("int64"), "n": np.concatenate([counts[some], np.zeros(len(ea))]).astype("int64")})

    return links


def link_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", q: Quantiser = Quantiser()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows with a null id or label, or a vector that is null, empty, all zeros or holds null or non-finite numbers, link with nothing: no
    links, their own id as component, kept (a null id: null component, not kept). Vectors of different length never
    link. Rows that share an id are vectors of their own that share a component. Negative ids are fine. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    v = F.col("v")
    single_precision = rows.schema[vector].dataType.simpleString() == "array<float>"
    kind = np.float32 if single_precision else np.float64  # as stored; every computation is in double precision
    as_is = F.col(quoted(vector)) if single_precision else F.col(quoted(vector)).cast("array<double>")
    rows = rows.select(F.col(quoted(vec_id)).cast("long").alias("vec_id"), as_is.alias("v"), F.col(quoted(label)).alias("label"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    key = [F.xxhash64("label", "v").alias("k1"), F.hash("v", "label").alias("k2")]
    good = rows.where(fit)
    # one id may stand for several different vectors; each representative needs a number of its own
    reps = good.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v"), F.xxhash64(F.any_value("label").cast("string")).alias("label"))
    reps = cut(reps.withColumn("num", F.monotonically_increasing_id()))
    members = good.select("vec_id", *key)
    n_reps, n_labels = reps.agg(F.count("*"), F.count_distinct("label")).first()
    picked = reps.orderBy(F.xxhash64("k1", "k2")).limit(q.sample).select("v").collect()
    by_dim: dict[int, list] = {}
    for (x,) in picked:
        by_dim.setdefault(len(x), []).append(x)
    unit = {d: (m := np.array(x, float)) / np.linalg.norm(m, axis=1, keepdims=True) for d, x in by_dim.items()}
    book = spark.sparkContext.broadcast(Codebook(unit, n_reps // max(1, n_labels), q))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's lists with the largest distance to their centroids."""
        top: dict[tuple[int, int], float] = {}
        for b in batches:
            for _, x in _vectors(b.column("v"), kind)[1]:
                own, dist = book.value.lists(x)
                most = np.zeros(own.max() + 1)
                np.maximum.at(most, own, dist)
                for k in np.unique(own).tolist():
                    top[x.shape[1], k] = max(top.get((x.shape[1], k), 0.0), float(most[k]))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in top], pa.int32()), pa.array([k[1] for k in top], pa.int32()), pa.array(list(top.values()), pa.float64())], ["dim", "list", "dist"])

    radii = reps.select("v").mapInArrow(measure, "dim int, list int, dist double").groupBy("dim", "list").agg(F.max("dist")).collect()  # a row for each list: max_lists at most
    reach = spark.sparkContext.broadcast({(r[0], r[1]): r[2] for r in radii})
    layout = "rep long, label long, n long, dim int, list int, home int, codes binary, err double, vec binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as a coded member of its own list and as a query in each foreign list that it probes."""
        names = [x.split()[0] for x in layout.split(", ")]
        for b in batches:
            raw, by_size = _vectors(b.column("v"), kind)
            raw = pa.array(raw, pa.binary())
            for at, x in by_size:
                own, codes, err, _ = book.value.encode(x)
                far = np.array([reach.value.get((x.shape[1], k), -np.inf) for k in range(len(book.value.of(x.shape[1])[0]))])
                who, lists = book.value.probes(x, own, far, q)
                for part, to, member in ((np.arange(len(at)), own, True), (who, lists, False)):
                    for s in range(0, len(part), 10_000):
                        p, n = part[s : s + 10_000], len(part[s : s + 10_000])
                        pos = pa.array(at[p])
                        coded = [pa.array([codes[k].tobytes() for k in p] if member else [None] * n, pa.binary()), pa.array(err[p] if member else [None] * n, pa.float64())]
                        yield pa.RecordBatch.from_arrays([*[b.column(c).take(pos) for c in ("num", "label", "n")], pa.array(np.full(n, x.shape[1], np.int32)), pa.array(to[s : s + 10_000].astype(np.int32)), pa.array(own[p].astype(np.int32)), *coded, raw.take(pos)], names)

    placed = reps.select("num", "label", "n", "v").mapInArrow(place, layout)
    where = ["label", "dim", "list"]
    hot = cut(placed.groupBy(where).agg(F.count("*").alias("size")).where(F.col("size") > q.tile).select(*where, F.ceil(F.col("size") / q.tile).cast("int").alias("cuts")))
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot
    cuts = F.coalesce("cuts", F.lit(1))
    tiles = placed.join(hot, where, "left").withColumns({"spot": F.pmod(F.xxhash64("rep"), cuts).cast("int"), "with": F.explode(F.sequence(F.lit(0), cuts - 1))})
    tiles = tiles.withColumns({"ti": F.least("spot", "with"), "tj": F.greatest("spot", "with")}).drop("with", "cuts")
    found = cut(tiles.groupBy(*where, "ti", "tj").applyInPandas(_tile_links(q, book, kind), "rep long, other long, n long"))
    counts = found.where("other < 0").groupBy("rep").agg(F.sum("n").alias("n_links"))
    parts = components(found.where("other >= 0"), "rep", "other")
    ids = reps.select(F.col("num").alias("node"), "rep")
    least = parts.join(ids, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    placed = reps.select("k1", "k2", "num", F.col("rep").alias("own"), "n")
    placed = placed.join(parts.join(least, "component").select(F.col("node").alias("num"), "component_id"), "num", "left").join(counts.withColumnRenamed("rep", "num"), "num", "left")
    placed = placed.select("k1", "k2", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "own").alias("component_id"))
    linked = members.join(placed, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    single = rows.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = {
    "op6_embedding_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.v, x.v) > 0 AND list_dot_product(y.v, y.v) > 0 AND list_cosine_similarity(x.v, y.v) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) s ON s.a = vec_id"""
}
