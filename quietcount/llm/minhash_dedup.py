"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A text's five-word shingles weigh their count times their inverse document frequency. Document frequencies are counted over
all documents in a hashed table of fixed size, so that any corpus has a table that can be sent to every task. A bucket's count, less the
mean of all buckets (what collisions add on average), stands for its shingles' frequency; the inverse is kept in steps of an eighth.
Counted row by row, a large group of copies makes its own shingles frequent, so that they weigh less than the few a copy changed, and
the group falls apart, the more the larger it is. With ``copies_once``, as the query has it, a document frequency
counts groups: of texts that share a band of samples drawn by counts alone, the first by hash counts for all.
For each of bands x rows hash functions one shingle is drawn by consistent weighted sampling (two texts draw the
same one with the probability of their weighted Jaccard similarity). Texts that share a band are candidates; what counts
is the weighted Jaccard similarity itself.

No bucket is expanded into pairs. Its members are compared with its first member, the leader, in a join that adaptive execution can
split; those that are not linked with it are compared with a leader of their own, and so on, round by round. One minus
the similarity is a metric, so a member linked with a leader and one that is not can only be linked if their distances to it
differ by no more than a link's: the few that this leaves, and what is left after the last round, if it still lies in different
components, is compared in tiles of bounded size. No link is lost, and the common case is linear in the bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietcount.llm.components import components
from quietcount.llm.kernel import SLICE_BYTES, U, Words, cut, map_text, mix, named_again, positional, quoted, release, slices, utf8


@dataclass(frozen=True)
class MinHash:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 10
    rows: int = 3
    #: a limit on the inverse document frequency; none unless given
    max_idf: float | None = None
    buckets: int = 1 << 22
    #: document frequencies count a group of copies once; else every row
    copies_once: bool = False
    #: leaders that a bucket gets before the rest of it is compared in tiles
    rounds: int = 2
    tile: int = 512
    seed: int = 11


#: the query's
ONCE = MinHash(copies_once=True)
CHUNK = 1 << 14
#: as many numbers are sent to the texts, more are joined with them; as many edges are settled by one task
FEW = 100_000


def shingles(off: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range of each text's distinct shingles, their hashes, their counts). A text of fewer words is one shingle."""
    words, rows = Words(off, data), len(off) - 1
    grams = words.grams(n)
    text = words.text_of(np.arange(len(words)))
    whole = text[: len(grams)] == text[n - 1 :] if len(grams) else np.zeros(0, bool)
    hashes, owner = grams[whole], text[: len(grams)][whole]
    count = np.diff(words.range)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = []
        for k in short.tolist():
            value = U(0)
            for h in words.hash[words.range[k] : words.range[k + 1]]:
                value = U((int(value) * 0x9E3779B97F4A7C15 + int(h)) & 0xFFFFFFFFFFFFFFFF)
            own.append(value)
        hashes, owner = np.concatenate([hashes, mix(np.array(own, np.uint64))]), np.concatenate([owner, short])
    order = np.argsort(mix(hashes + owner.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    h, o = hashes[order], owner[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(head)
    tf = np.diff(np.append(at, len(h)))
    h, o = h[at], o[at]
    order = np.argsort(o.astype(np.uint16) if rows <= 65536 else o, kind="stable")
    return np.searchsorted(o[order], np.arange(rows + 1)), h[order], tf[order]


def _pack(counts: np.ndarray) -> bytes:
    """Byte planes, compressed: most counts are small."""
    return zlib.compress(np.ascontiguousarray(counts.view(np.uint8).reshape(len(counts), -1).T).tobytes(), 1)


def _unpack(row: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(row), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


IDF_STEP = 0.125


def idf_table(counts: np.ndarray, mean: float, n: int, m: MinHash) -> np.ndarray:
    """Inverse document frequency of each bucket in steps of an eighth, one byte each."""
    idf = np.log1p(n / np.maximum(counts - mean, 1))
    if m.max_idf is not None:
        idf = np.minimum(idf, m.max_idf)
    return np.clip(np.round(idf / IDF_STEP), 1, 255).astype(np.uint8)


def document_frequencies(docs: DataFrame, text: str, n: int, m: MinHash) -> np.ndarray:
    """The weight of each bucket's shingles: a table of ``buckets`` bytes, whatever the corpus. Each task counts its rows up and sends on
    compressed chunks of the table; each chunk's sum is kept in the shared folder, and only bytes reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(m.buckets, np.uint16), 0

        def chunks() -> Iterator[pa.RecordBatch]:
            for c in range(0, m.buckets, CHUNK):
                part = total[c : c + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int32()), pa.array([_pack(part)], pa.binary())], ["chunk", "counts"])

        for batch in batches:
            for _, off, data in slices(batch, text):
                if rows + len(off) > 60_000:  # a count stays within its two bytes
                    yield from chunks()
                    total[:], rows = 0, 0
                rows += len(off)
                _, h, _ = shingles(off, data, m.shingle)
                np.add.at(total, (h & U(m.buckets - 1)).astype(np.int64), 1)
        yield from chunks()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([int(own.sum())], pa.int64()), pa.array([_pack(own)], pa.binary())], ["chunk", "total", "counts"])

        for batch in batches:  # sorted by chunk
            for c, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != last:
                    if last is not None:
                        yield done()
                    last, own = c, np.zeros(min(CHUNK, m.buckets), np.int64)
                own += _unpack(row, np.uint16)
        if last is not None:
            yield done()

    parts = docs.select(quoted(text)).mapInArrow(count, "chunk int, counts binary")
    added = cut(parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, total long, counts binary"))
    mean = (added.agg(F.sum("total")).first()[0] or 0) / m.buckets

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [zlib.compress(idf_table(_unpack(r, np.int64), mean, n, m).tobytes(), 1) for r in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["chunk", "idf"])

    out = idf_table(np.zeros(1), mean, n, m).repeat(m.buckets)
    for c, row in added.mapInArrow(weigh, "chunk int, idf binary").collect():  # the table: ``buckets`` bytes
        own = np.frombuffer(zlib.decompress(row), np.uint8)
        out[c * CHUNK : c * CHUNK + len(own)] = own
    return out


class Weigher:
    """Without a table of frequencies, a shingle weighs its count."""

    def __init__(self, idf: np.ndarray | None, m: MinHash):
        self.m, self.idf = m, idf

    def weighted(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds, h, tf = shingles(off, data, self.m.shingle)
        if self.idf is None:
            return bounds, h, tf.astype(np.float32)
        return bounds, h, tf * (self.idf[(h & U(self.m.buckets - 1)).astype(np.int64)] * np.float32(IDF_STEP))


class Sampler:
    """Consistent weighted samples. The random triple (r, ln c, beta) of a shingle and hash function is drawn from a table
    of 65,536; ties go to the smaller shingle hash, so draws stay consistent."""

    def __init__(self, m: MinHash):
        rng = np.random.default_rng(m.seed)
        self.r = rng.gamma(2.0, 1.0, 65536).astype(np.float32)
        self.c = np.log(rng.gamma(2.0, 1.0, 65536)).astype(np.float32)
        self.b = rng.random(65536).astype(np.float32)
        self.rinv = (1 / self.r).astype(np.float32)
        self.odd = rng.integers(1 << 62, 1 << 63, m.bands * m.rows, dtype=np.uint64) * U(2) + U(1)

    def draw(self, bounds: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sampled shingle hash (32 bits) of each non-empty text for each function."""
        full = np.flatnonzero(np.diff(bounds))
        out = np.empty((len(self.odd), len(full)), np.uint64)
        if not len(full):
            return out
        lnw, low, head = np.log(w).astype(np.float32), mix(h) & U(0xFFFFFFFF), bounds[:-1][full]
        for k, odd in enumerate(self.odd):
            at = ((h * odd) >> U(48)).astype(np.int64)
            r, b = self.r[at], self.b[at]
            t = np.floor(lnw * self.rinv[at] + b)
            a = self.c[at] - r * (t - b) - r  # ln of c / (y e^r), y = e^(r (t - beta))
            bits = a.view(np.int32)
            order = np.where(bits < 0, ~bits, bits ^ np.int32(-0x80000000)).view(np.uint32)
            out[k] = np.minimum.reduceat((order.astype(np.uint64) << U(32)) | low, head) & U(0xFFFFFFFF)
        return out


def similarity(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard of two weighted sets, hashes sorted."""
    at = np.searchsorted(h2, h1)
    at[at == len(h2)] = 0
    same = h2[at] == h1 if len(h2) else np.zeros(len(h1), bool)
    both = np.minimum(w1[same], w2[at[same]]).sum(dtype=float)
    total = w1.sum(dtype=float) + w2.sum(dtype=float) - both
    return both / total if total else 0.0


def _sets(weigher: Weigher, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The weighted set of each text, slice by slice."""
    for _, off, data in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        bounds, h, w = weigher.weighted(off, data)
        for a, b in zip(bounds, bounds[1:], strict=False):
            order = np.argsort(h[a:b])
            yield h[a:b][order], w[a:b][order]


def _verify(shared, m: MinHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, tuple] | None = None
        for batch in batches:
            ta, tb = batch.column("ta"), batch.column("tb")
            size = np.cumsum(np.diff(utf8(ta)[0]) + np.diff(utf8(tb)[0]))
            keep, at = np.zeros(batch.num_rows), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
                for i, a, x, y in zip(range(at, end), batch.column("a").slice(at, end - at).to_pylist(), _firsts(shared.value, ta.slice(at, end - at), batch.column("a").slice(at, end - at)), _sets(shared.value, tb.slice(at, end - at)), strict=True):
                    if x is not None:
                        last = (a, x)
                    keep[i] = similarity(*last[1], *y)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep)], ["a", "b", "s"])

    return run


def _firsts(weigher: Weigher, texts: pa.Array, ids: pa.Array):
    """The sets of texts whose id differs from the row before; else nothing (the caller keeps the last)."""
    ids = np.asarray(ids)
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    sets = _sets(weigher, texts.filter(pa.array(new)))
    for fresh in new.tolist():
        yield next(sets) if fresh else None


def _compare_tile(shared, m: MinHash):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links that join components within the tile (one chunk) or across its two chunks."""
        pdf = pdf.drop_duplicates(["num", "side"]).reset_index(drop=True)
        sets = list(_sets(shared.value, pa.array(pdf.text, pa.string())))
        num, side, root = pdf.num.to_numpy(), pdf.side.to_numpy(), dict(zip(pdf.num, pdf.comp, strict=True))
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        total = np.array([w.sum(dtype=float) for _, w in sets])
        right = np.flatnonzero(side == side.max())
        h = np.concatenate([sets[i][0] for i in right]) if len(right) else np.zeros(0, np.uint64)
        w = np.concatenate([sets[i][1] for i in right]) if len(right) else np.zeros(0)
        who = np.repeat(right, [len(sets[i][0]) for i in right])
        order = np.argsort(h, kind="stable")
        h, w, who = h[order], w[order], who[order]
        a, b = [], []
        for i in np.flatnonzero(side == side.min()):
            hi, wi = sets[i]
            lo, hi_ = np.searchsorted(h, hi, "left"), np.searchsorted(h, hi, "right")
            n = hi_ - lo
            at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, int)
            both = np.bincount(who[at], weights=np.minimum(np.repeat(wi, n), w[at]), minlength=len(sets))
            for j in np.flatnonzero(both >= m.threshold * (total[i] + total - both)):
                x, y = top(root[num[i]]), top(root[num[j]])
                if total[i] and num[i] != num[j] and x != y:
                    parent[max(x, y)] = min(x, y)
                    a.append(num[i])
                    b.append(num[j])
        return pd.DataFrame({"a": a, "b": b}).astype("int64")

    return run


def _picked(texts: DataFrame, nums: DataFrame, few: bool) -> DataFrame:
    """The texts of some numbers: few are sent to the texts, many leave the choice to the join that follows."""
    return texts.join(F.broadcast(nums.distinct()), "num") if few else texts


def _linked(group: DataFrame, texts: DataFrame, weigher, m: MinHash) -> DataFrame:
    """(node, component) of the members of buckets, (band, bucket, num), that links connect."""
    bucket, slack = ["band", "bucket"], 1 - m.threshold
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    links, stars = [], []
    for k in range(m.rounds):
        # written before it is joined back, so that adaptive execution can split a hot bucket
        lead = cut(group.groupBy(*bucket).agg(F.min("num").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"))
        at = cut(group.join(lead, bucket))
        pairs = at.where("a <> num").select("a", F.col("num").alias("b")).distinct()
        few = False
        if k:  # the first round needs nearly all of the texts, the others few
            pairs = cut(pairs)
            few = pairs.count() <= FEW
        ta, tb = (_picked(texts, pairs.select(F.col(c).alias("num")), few).select(F.col("num").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        both = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").sortWithinPartitions("a")
        seen = cut(both.mapInArrow(_verify(weigher, m), "a long, b long, s double"))
        links.append(seen.where(F.col("s") >= m.threshold).select("a", "b"))
        star = at.where("a <> num").join(seen.withColumnRenamed("b", "num"), ["a", "num"]).select(*bucket, "a", "num", "s", F.lit(k).alias("round"))
        stars.append(cut(star))
        group = stars[-1].where(F.col("s") < m.threshold).select(*bucket, "num")
        del at, pairs, ta, tb, both, star
        release(texts.sparkSession)
        if not group.limit(1).count():
            break
    parts = components(union(links), few=FEW)
    release(texts.sparkSession)
    of = lambda rows, c, name: rows.join(parts.select(F.col("node").alias(c), F.col("component").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    # members that are not linked with a leader, but near enough to it to be linked with others that are, in another component
    star, where = union(stars), [*bucket, "round"]
    out = of(star.where((F.col("s") < m.threshold) & (F.col("s") >= 1 - 2 * slack)), "num", "comp")
    out = cut(of(out, "a", "home").where("comp <> home").select(*where, "num", "s", "comp"))
    # what no leader has claimed, where it lies in several components
    left = cut(of(group, "num", "comp"))
    open_ = left.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select(*bucket, "n")
    if not out.select(*bucket).limit(1).unionByName(open_.select(*bucket).limit(1)).count():
        return parts
    limit = cut(out.groupBy(*where).agg(F.max("s").alias("most"), F.count("*").alias("n1")))
    near = star.where(F.col("s") >= m.threshold).join(limit, where).where(F.col("s") <= F.col("most") + slack + 1e-9)
    near = cut(of(near, "num", "comp").select(*where, "num", "comp"))
    sizes = cut(limit.drop("most").join(near.groupBy(*where).agg(F.count("*").alias("n0")), where))
    tiles = lambda c: F.ceil(F.col(c) / m.tile).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("num"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # those near a leader against those further out; and what is left, every tile with itself and each other one
    first = near.join(sizes, where).select(*where, spot(tiles("n0")).alias("ti"), all_of(tiles("n1")).alias("tj"), F.lit(0).alias("side"), "num", "comp")
    second = out.join(sizes, where).select(*where, all_of(tiles("n0")).alias("ti"), spot(tiles("n1")).alias("tj"), F.lit(1).alias("side"), "num", "comp")
    third = left.join(cut(open_), bucket).select(*bucket, F.lit(m.rounds).alias("round"), spot(tiles("n")).alias("spot"), all_of(tiles("n")).alias("with"), "num", "comp")
    third = third.select(*where, F.least("spot", "with").alias("ti"), F.greatest("spot", "with").alias("tj"), (F.col("spot") > F.col("with")).cast("int").alias("side"), "num", "comp")
    todo = cut(union([first, second, third]))
    release(texts.sparkSession)
    held = todo.join(_picked(texts, todo.select("num"), todo.count() <= FEW), "num")
    more = cut(held.groupBy(*where, "ti", "tj").applyInPandas(_compare_tile(weigher, m), "a long, b long").distinct())
    del held
    release(texts.sparkSession)
    if not more.limit(1).count():
        return parts
    # a node and its component stand for the links that led to it
    return components(union([parts.select(F.col("node").alias("a"), F.col("component").alias("b")), more]), few=FEW)


KEY = ["k1", "k2"]


def _banded(rows: DataFrame, weigher: Callable[[], Weigher], m: MinHash) -> DataFrame:
    """(k1, k2, bands) of every text, once."""

    def make():
        sampler, own = Sampler(m), weigher()

        def work(off, data, part):
            bounds, h, w = own.weighted(off, data)
            s = sampler.draw(bounds, h, w)
            full = np.flatnonzero(np.diff(bounds))
            bands = np.empty((len(full), m.bands), np.int64)
            for b in range(m.bands):
                value = np.full(len(full), U(b + 1))
                for r in range(m.rows):
                    value = mix(value + s[b * m.rows + r] * U(0x9E3779B97F4A7C15))
                bands[:, b] = value.view(np.int64)
            n = np.zeros(len(off) - 1, np.int64)
            n[full] = m.bands
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(bands.ravel()))]

        return work

    return map_text(rows, "text", KEY, [T.StructField("bands", T.ArrayType(T.LongType()))], make).dropDuplicates(KEY)


def _once(rows: DataFrame, classes: DataFrame, m: MinHash) -> tuple[DataFrame, int]:
    """One row of each text that shares no band with a text of smaller hash, and how many those are. Any bucket is joined with its
    smallest hash only; nothing is compared in pairs."""
    bands = cut(_banded(rows, lambda: Weigher(None, m), m).select(*KEY, F.posexplode("bands").alias("band", "bucket")))
    first = cut(bands.groupBy("band", "bucket").agg(F.min("k1").alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"))
    later = cut(bands.join(first, ["band", "bucket"]).where("k1 > first").select(*KEY).distinct())
    # few texts are copies: those, and those of several rows, are marked; the rows of all others go by
    marked = classes.where("n > 1").select(*KEY, F.lit(True).alias("first")).unionByName(later.select(*KEY, F.lit(False).alias("first")))
    marked = cut(marked.groupBy(*KEY).agg(F.min("first").alias("first")))
    held = rows.join(F.broadcast(marked) if marked.count() <= FEW else marked, KEY, "left")
    alone, several = held.where("first IS NULL").select("text"), held.where("first").dropDuplicates(KEY).select("text")
    return alone.unionByName(several), classes.count() - later.count()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", m: MinHash = MinHash()) -> DataFrame:
    """(doc_id, text_key1, text_key2, class_id, kept) for every row of ``docs``.

    ``class_id`` is the smallest id over all texts that links (and equality) connect; ``kept`` marks the rows with
    that id. Texts without words (null and empty alike count as the empty text) link only with their equals. Rows
    with one id and one text are one document, kept together. Null ids count in a class but only represent one that has no
    other id. Of equal similarities none is preferred: a pair at the threshold links. Long texts are weighed whole, slice by slice. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("k1"), F.hash(body, F.length(body)).alias("k2"))
    key = KEY
    classes = cut(rows.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    classes = cut(classes.withColumn("num", F.monotonically_increasing_id()))
    n_rows = classes.agg(F.sum("n")).first()[0] or 0
    counted, n_counted = _once(rows, classes, m) if m.copies_once else (rows, n_rows)
    release(spark)
    weigher = spark.sparkContext.broadcast(Weigher(document_frequencies(counted, "text", n_counted, m), m))
    del counted
    bands = _banded(rows, lambda: weigher.value, m)
    bands = bands.join(classes.select(*key, "num"), key).select("num", F.posexplode("bands").alias("band", "bucket"))
    bands = cut(bands)
    buckets = bands.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1").select("band", "bucket")
    group = cut(bands.join(cut(buckets), ["band", "bucket"]))
    involved = group.select("num").distinct()
    texts = rows.join(classes.join(involved, "num").select(*key, "num", "rep"), key).where(F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = cut(texts.select("num", "text").dropDuplicates(["num"]))
    del bands, buckets, involved
    release(spark)
    parts = _linked(group, texts, weigher, m)
    del group, texts
    release(spark)
    own = classes.join(parts.withColumnRenamed("node", "num"), "num", "left").withColumn("component", F.coalesce("component", "num"))
    least = own.groupBy("component").agg(F.min("rep").alias("class_id"))
    own = own.join(least, "component").select(*key, "class_id")
    return rows.select("doc_id", *key).join(own, key).select("doc_id", F.col("k1").alias("text_key1"), F.col("k2").alias("text_key2"), "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), m=ONCE).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame, m: MinHash = MinHash()) -> DataFrame:
    """The rows of ``docs``, with their own columns, that stay: one document of each class, the one of smallest id. Its repeated rows stay
    together; nulls, empty and long texts, ties and empty tables as in ``near_duplicates``."""
    own, at = positional(docs)
    body = F.coalesce(F.col(at["text"]), F.lit(""))
    marked = near_duplicates(docs, m=m).where("kept").select(F.col("doc_id").alias("_d"), F.col("text_key1").alias("_k1"), F.col("text_key2").alias("_k2")).distinct()
    held = own.withColumns({"_k1": F.xxhash64(body), "_k2": F.hash(body, F.length(body))})
    on = held["_k1"].eqNullSafe(marked["_k1"]) & held["_k2"].eqNullSafe(marked["_k2"]) & held[at["doc_id"]].eqNullSafe(marked["_d"])
    return held.join(marked, on, "left_semi").select(*named_again(docs.columns, at))


SQL: dict[str, str] = {}
