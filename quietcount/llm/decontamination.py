"""Benchmark decontamination by winnowing.

Each text's words give 5-grams; in every window of six consecutive ones the smallest hash is kept (the rightmost on a
tie). Two texts that share ten words in a row share a whole window, so they share its kept fingerprint: no shared span
of that length can be missed. Kept document fingerprints are looked up among the benchmark's; each hit is extended to
the ten-word windows around it, which are compared by hash and then word by word.

The benchmark goes to the executors in blocks whose index takes at most ``INDEX_BYTES``; one block is the usual case, and a
benchmark of any size is matched block after block, each pass merging its hits into the rows. An index is a few sorted arrays:
window hashes with the places of the windows, whose words are compared in the benchmark's own bytes. Documents are neither
shuffled nor grouped, so a source, a passage or a group of copies of any size costs its own rows only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietcount.llm.kernel import Q, U, Words, cut, found, map_text, mix, named_again, others, positional, quoted, utf8

WINDOW = 10
GRAM = 5
KEPT_OF = WINDOW - GRAM + 1
INDEX_BYTES = 256 << 20
#: bytes of the index for each word of the benchmark, besides its text: hashes, places, spans and items
WORD_BYTES = 64
_BITS = U((1 << 20) - 1)

NEW = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def winnow(hashes: np.ndarray, of: int) -> np.ndarray:
    """Positions of the smallest hash, rightmost on a tie, of every ``of`` consecutive ones."""
    m = len(hashes) - of + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, of):
        less = hashes[j : j + m] <= best
        np.copyto(best, hashes[j : j + m], where=less)
        at[less] = j
    kept = np.zeros(len(hashes), bool)
    kept[at + np.arange(m)] = True
    return np.flatnonzero(kept)


class Index:
    """Fingerprints and windows of a block of benchmark items."""

    def __init__(self, rows: list[tuple]):
        texts = [(None if i is None else str(i), t) for i, t in rows if t]
        words = Words(*utf8(pa.array([t for _, t in texts], pa.string())))
        grams, whole = words.grams(GRAM), words.grams(WINDOW)
        self.names = sorted({i for i, _ in texts if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        item = np.array([number.get(i, -1) for i, _ in texts], np.int32)
        prints, at, size, hashes = [], [], [], []
        for k in range(len(texts)):
            a, b = int(words.range[k]), int(words.range[k + 1])
            n = b - a
            if n >= WINDOW:
                own = grams[a : b - GRAM + 1]
                prints.append(own[winnow(own, KEPT_OF)])
                at.append(np.arange(a, b - WINDOW + 1))
                hashes.append(whole[a : b - WINDOW + 1])
            elif n:  # an item of fewer words is one window
                at.append(np.array([a]))
                hashes.append(words.grams(n)[a : a + 1])
            size.append(np.full(len(at[-1]) if n else 0, min(n, WINDOW), np.int8))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        at, size, hashes = join(at, np.int32), join(size, np.int8), join(hashes, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.size = hashes[order], at[order], size[order]
        self.item = item[words.text_of(self.at)] if len(at) else np.zeros(0, np.int32)
        self.prints = np.unique(join(prints, np.uint64))
        self.short = {n: np.unique(self.hashes[self.size == n]) for n in range(1, WINDOW) if (self.size == n).any()}
        self.low, self.start, self.end = words.low, words.start.astype(np.int32), words.end.astype(np.int32)
        self.bits = {0: self._bits(self.prints)} | {n: self._bits(x) for n, x in self.short.items()}

    @property
    def nbytes(self) -> int:
        arrays = [self.hashes, self.at, self.size, self.item, self.prints, self.low, self.start, self.end, *self.short.values()]
        return sum(x.nbytes for x in arrays)

    @staticmethod
    def _bits(table: np.ndarray) -> np.ndarray:
        bits = np.zeros(int(_BITS) + 1, bool)
        bits[(table & _BITS).astype(np.int64)] = True
        return bits

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, item number or -1) of every occurrence of a window of each item."""
        spots = []
        if len(self.prints):
            grams = words.grams(GRAM)
            at = winnow(grams, KEPT_OF)
            at = at[self.bits[0][(grams[at] & _BITS).astype(np.int64)]]
            at = at[found(grams[at], self.prints)]
            if len(at):
                near = np.unique((at[:, None] - np.arange(KEPT_OF)).ravel())
                near = near[(near >= 0) & (near + WINDOW <= len(words))]
                value = words.hash[near].copy()
                for j in range(1, WINDOW):
                    value *= Q
                    value += words.hash[near + j]
                spots.append((WINDOW, near, mix(value)))
        for n, table in self.short.items():
            grams = words.grams(n)
            at = np.flatnonzero(self.bits[n][(grams & _BITS).astype(np.int64)])
            at = at[found(grams[at], table)]
            spots.append((n, at, grams[at]))
        out = [self._same(words, n, at, value) for n, at, value in spots if len(at)]
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))

    def _same(self, words: Words, n: int, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places whose n words are, byte by byte, those of a window of that hash."""
        inside = words.text_of(at) == words.text_of(at + n - 1)
        at, value = at[inside], value[inside]
        first, last = np.searchsorted(self.hashes, value, "left"), np.searchsorted(self.hashes, value, "right")
        many = last - first
        out: list[list[np.ndarray]] = [[], []]
        for s in range(0, len(at), 4096):  # a passage that many items have is compared with each of them, some places at a time
            m = many[s : s + 4096]
            place = np.repeat(at[s : s + 4096], m)
            to = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[s : s + 4096], m)
            ok = self.size[to] == n
            place, to = place[ok], to[ok]
            good = np.ones(len(place), bool)
            for j in range(n):  # word by word: lengths, then bytes
                a, b = words.start[place + j], self.start[self.at[to] + j].astype(np.int64)
                size = words.end[place + j] - a
                good &= size == self.end[self.at[to] + j] - b
                full = np.flatnonzero(good & (size > 0))
                if len(full):
                    w = size[full]
                    head = np.cumsum(w) - w
                    step = np.arange(w.sum()) - np.repeat(head, w)
                    equal = words.low[np.repeat(a[full], w) + step] == self.low[np.repeat(b[full], w) + step]
                    good[full] &= np.logical_and.reduceat(equal, head)
            out[0].append(place[good])
            out[1].append(self.item[to[good]])
        place = np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64)
        return place, np.full(len(place), n), np.concatenate(out[1]).astype(np.int64) if out[1] else np.zeros(0, np.int64)


def _matcher(shared, again: bool):
    def make():
        index = shared.value

        def work(off, data, part):
            words = Words(off, data)
            rows = len(off) - 1
            edge = np.zeros(len(words) + 1, np.int32)
            items: dict[int, set] = {}
            if again:
                for k, (spans, own) in enumerate(zip(part.column("hit_spans").to_pylist(), part.column("hit_items").to_pylist(), strict=True)):
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        edge[words.range[k] + a] += 1
                        edge[words.range[k] + b] -= 1
                    if own:
                        items.setdefault(k, set()).update(own)
            start, size, item = index.hits(words)
            if len(start):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
                pairs = np.unique(np.stack([words.text_of(start), item], 1)[item >= 0], axis=0)
                for k, i in pairs.tolist():
                    items.setdefault(k, set()).add(index.names[i])
            hit = np.cumsum(edge[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[words.range[1:]] - total[words.range[:-1]]
            spans: list[list[int]] = [[] for _ in range(rows)]
            for k in np.flatnonzero(n_hit).tolist():
                a, b = words.range[k], words.range[k + 1]
                own = np.concatenate([[False], hit[a:b], [False]])
                spans[k] = np.flatnonzero(own[1:] != own[:-1]).tolist()
            return (
                pa.array(np.diff(words.range), pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(spans, pa.list_(pa.int32())),
                pa.array([sorted(items.get(k, ())) for k in range(rows)], pa.list_(pa.string())),
            )

        return work

    return make


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: list[str] | None = None, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``carry`` columns of every row of ``docs`` (all by default) and n_words, n_hit, hit_spans (word positions, flat
    pairs of start and end, merged) and hit_items (distinct item ids as strings, sorted).

    A null or empty text has no words and no hits; a text of any length is matched whole. An item without words never
    matches; an item with a null id makes words hit but is not listed; items that share an id count once. Repeated rows of
    ``docs`` are judged each for itself. Columns of ``docs`` named like a new one, in any case, are replaced. An empty
    benchmark hits nothing; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(quoted(item_id)).alias("i"), F.col(quoted(item_text)).alias("t"))
    # no word is shorter than a byte and the blank after it, so this bounds the words from above
    words = F.size(F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    size = items.agg(F.sum(F.octet_length("t") + WORD_BYTES * words)).first()[0] or 0
    blocks = max(1, -(-size // index_bytes))
    carry = others(docs.columns if carry is None else carry, [f.name for f in NEW])
    docs, column = positional(docs)
    out, own = docs, [column[c] for c in carry]
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(Index([tuple(r) for r in rows.collect()]))
        keep = own if blocks == 1 else [*dict.fromkeys([*own, column[text]])]
        if k == 0:
            out = map_text(out, column[text], keep, NEW, _matcher(shared, False))
        else:
            out = _map_again(cut(out), column[text], keep, shared)
    return out.select(*named_again(carry, column), *[f.name for f in NEW])


def _map_again(out: DataFrame, text: str, keep: list[str], shared) -> DataFrame:
    """Another block's hits merged into the rows."""
    held = out.select(*keep, F.col("hit_spans").alias("_spans"), F.col("hit_items").alias("_items"))

    def make():
        work = _matcher(shared, True)()

        def renamed(off, data, part):
            names = [{"_spans": "hit_spans", "_items": "hit_items"}.get(x, x) for x in part.schema.names]
            return work(off, data, pa.RecordBatch.from_arrays(part.columns, names))

        return renamed

    return map_text(held, text, held.columns, NEW, make).drop("_spans", "_items")


def digest(matched: DataFrame) -> DataFrame:
    """The digest columns of each document."""
    return matched.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return digest(match_benchmark(docs, items, carry=["doc_id"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_hit_words: int = 0) -> DataFrame:
    """Keep the rows of ``docs``, with their own columns, that have at most ``max_hit_words`` hit words. Nulls, empty and long texts,
    repeated rows and empty tables as in ``match_benchmark``: a row without words stays."""
    own, at = positional(docs)
    matched = match_benchmark(own, benchmark, at["text"])
    return matched.where(F.col("n_hit") <= max_hit_words).select(*named_again(docs.columns, at))


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, s, x.n, item_id FROM (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM dw) x JOIN win USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""
}
