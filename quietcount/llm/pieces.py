"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut before every run of blanks: no piece of the vocabulary reaches over such a cut (this is checked when it is read; one with
such pieces gets no cuts), so the lattice of pieces falls apart there and each distinct part is filtered once a slice. It also falls
apart wherever no piece that occurs reaches over a place: all stretches between those places are filtered at once, and
a part without blanks is cut there, window by window. A stretch that stays long is filtered byte by byte, with a few numbers a byte
in memory. Forward filtering gives every byte position the log
sum of all ways to reach it; backward sampling draws the last piece, then the one before it, and so on, in
proportion to those sums. The random numbers come from a counter-based generator keyed by the row's key, so a row's
pieces are the same on every run, machine and partitioning.

No text is normalised. A blank is the vocabulary's meta symbol; bytes that no piece covers, and a literal meta symbol, are byte
pieces. Decoding concatenates the pieces' bytes and gives back every text.

A unigram vocabulary's scores are log probabilities and are used as they are. In a merge-based one (BPE) a score is minus
the merge's rank; there a piece's probability follows Zipf's law in that rank.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietcount.llm.kernel import P, P_INV, SLICE_BYTES, U, map_arrow, map_text, mix, named_again, others, positional, powers

MODEL = os.environ.get("QUIETCOUNT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
META = "▁"
SLICE = 1 << 18


@dataclass(frozen=True)
class Sampling:
    model: str = MODEL
    #: exponent of the piece probabilities: 0 makes all segmentations alike, large values tend to the likeliest one
    alpha: float = 1.0
    seed: int = 1


class Vocabulary:
    """Pieces as bytes, with log probabilities, and, when needed, the trie over them as dense rows of 256."""

    def __init__(self, path: str | None = None, pieces: list[tuple[str, float, str]] | None = None):
        merges = False
        if pieces is None:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"
            pieces = [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]
            scores = [s for _, s, k in pieces if k == "piece"]
            merges = all(float(s).is_integer() for s in scores[:1000])
        self.bytes: list[bytes] = []
        self.byte_id = np.full(256, -1, np.int32)
        score, own = [], {}
        for i, (name, s, kind) in enumerate(pieces):
            value = b""
            if kind == "byte":
                value = bytes([int(name[1:-1], 16)])
                self.byte_id[value[0]] = i
            elif kind == "piece":
                value = name.replace(META, " ").encode()
                own.setdefault(value, i)
            self.bytes.append(value)
            score.append(-np.log(2.7 + max(-s, 0)) if merges else s)
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte pieces: decoding would lose text")
        kept = np.array([score[i] for i in own.values()])
        total = np.log(np.exp(kept).sum()) if merges else 0.0
        self.logp = np.array(score) - total
        self.logp[self.byte_id] = kept.min() - total - 2.0
        self._own, self._trie = own, None
        self.longest = max((len(b) for b in own), default=1)
        #: whether no piece goes on with a blank after something else
        self.blank_cuts = not any(b" " in b.lstrip(b" ") for b in own)
        size = np.array([len(b) for b in self.bytes])
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    @property
    def trie(self) -> tuple[np.ndarray, np.ndarray]:
        """(next row by row and byte, piece that ends at each row); built when first needed: decoding does without."""
        if self._trie is None:
            self._trie = self._build()
        return self._trie

    def _build(self) -> tuple[np.ndarray, np.ndarray]:
        rows: list[dict[int, int]] = [{}]
        ends = [-1]
        for value, i in self._own.items():
            at = 0
            for b in value:
                if b not in rows[at]:
                    rows[at][b] = len(rows)
                    rows.append({})
                    ends.append(-1)
                at = rows[at][b]
            ends[at] = i
        step = np.zeros((len(rows), 256), np.int32)
        for at, row in enumerate(rows):
            if row:
                step[at, list(row)] = list(row.values())
        return step, np.array(ends, np.int32)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """Read once a process. The file must be at the same path on every executor."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


WINDOW = 1 << 16
#: stretches of more bytes are filtered byte by byte
LONG = 512


def matches(v: Vocabulary, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, bytes, piece) of every occurrence of a piece that starts at a byte of ``end`` and ends there at the latest."""
    at, state = np.arange(len(end)), np.zeros(len(end), np.int32)
    out: tuple[list, list, list] = ([], [], [])
    depth, (step_to, ends) = 0, v.trie
    while len(at):
        state = step_to[state, data[at + depth]]
        depth += 1
        ok = state > 0
        at, state = at[ok], state[ok]
        hit = ends[state] >= 0
        for x, y in zip(out, (at[hit], np.full(int(hit.sum()), depth), ends[state[hit]]), strict=True):
            x.append(y)
        more = end[at] > at + depth
        at, state = at[more], state[more]
    return tuple(np.concatenate(x or [np.zeros(0, int)]) for x in out)


def edges(v: Vocabulary, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``matches`` and byte pieces for every character that has no piece of its own."""
    froms, lens, ids = matches(v, data, end)
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    if len(data) and not lead[0]:  # a window may begin inside a character
        char += 1
    width = np.bincount(char) if len(data) else np.zeros(0, int)
    covered = np.zeros(len(width), bool)
    single = (width[char[froms]] == lens) & lead[froms]
    covered[char[froms[single]]] = True
    bare = np.flatnonzero(~covered[char[: len(end)]])
    return np.concatenate([froms, bare]), np.concatenate([lens, np.ones(len(bare), int)]), np.concatenate([ids, v.byte_id[data[bare]]])


def parts_of(v: Vocabulary, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Starts of the parts: at each text's first byte, before each run of blanks, and in what is long without one wherever no
    piece reaches over."""
    blank = data == 0x20
    first = blank & v.blank_cuts
    first[1:] &= ~blank[:-1]
    first[off[:-1][off[:-1] < len(data)]] = True
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(data)))
    for k in np.flatnonzero(size > LONG).tolist():
        a, b = int(start[k]), int(start[k] + size[k])
        reached = np.zeros(b - a + 1, np.int32)  # by how many pieces each place is passed
        for s in range(a, b, WINDOW):
            e = min(b, s + WINDOW)
            own = data[s : min(b, e + v.longest)]
            at, lens, _ = matches(v, own, np.full(e - s, len(own)))
            np.add.at(reached, at + 1 + s - a, 1)
            np.add.at(reached, at + lens + s - a, -1)
        free = np.cumsum(reached[:-1]) == 0
        free[0] = False
        first[a:b] |= free & ((data[a:b] & 0xC0) != 0x80)  # never inside a character
    return np.flatnonzero(first)


def distinct_parts(start: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one occurrence of each distinct part, which of them each part is). Parts of equal hash are compared by bytes."""
    end = np.append(start[1:], len(data))
    pw, inv = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * pw[: len(data)], out=sums[1:])
    _, one, which = np.unique(mix((sums[end] - sums[start]) * inv[start]), return_index=True, return_inverse=True)
    size = end - start
    same = (size == size[one[which]]).all()
    if same:
        shift = np.repeat(start[one[which]] - start, size)
        same = (data == data[np.arange(len(data)) + shift]).all()
    return (one, which) if same else (np.arange(len(start)), np.arange(len(start)))


class Lattice:
    """Edges of the distinct parts, filtered forward; each position's incoming edges with cumulated probabilities."""

    def __init__(self, v: Vocabulary, off: np.ndarray, data: np.ndarray, alpha: float):
        n = len(data)
        size = np.diff(off)
        node = off[:-1] + np.arange(len(size))  # position 0 of each part; it has size + 1 positions
        inside = np.repeat(np.arange(len(size)), size)
        froms, lens, ids = edges(v, data, np.repeat(off[1:], size))
        word = inside[froms]
        src = froms + word
        dst = src + lens
        step = dst - node[word]
        # unique keys: by step, position, then the longest piece first, so the order is the same in every slice
        order = np.argsort((step * np.int64(n + len(size) + 1) + dst) * np.int64(256) + (255 - lens))
        src, dst, ids, step = src[order], dst[order], ids[order], step[order]
        score = v.logp[ids] * alpha
        total = np.full(n + len(size), -np.inf)
        total[node] = 0
        logp = np.empty(len(src))
        bounds = np.searchsorted(step, np.arange(1, (int(step[-1]) if len(step) else 0) + 2))
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            x = total[src[a:b]] + score[a:b]
            d = dst[a:b]
            head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            top = np.maximum.reduceat(x, head)
            run = np.repeat(np.arange(len(head)), np.diff(np.append(head, b - a)))
            e = np.exp(x - top[run])
            s = np.add.reduceat(e, head)
            total[d[head]] = top + np.log(s)
            logp[a:b] = e / s[run]
        self.src, self.ids, p = src, ids.astype(np.int32), logp
        head = np.concatenate([[True], dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, bool)
        run = np.cumsum(p)
        base = (run - p)[head]
        group = np.cumsum(head) - 1
        self.upto = run - base[group] if len(p) else p
        self.first = np.zeros(n + len(size), np.int64)
        self.first[dst[head]] = np.flatnonzero(head)
        tail = np.append(head[1:], True) if len(head) else head
        self.upto[tail] = np.inf
        self.node, self.size = node, size


def encode_slice(v: Vocabulary, off: np.ndarray, data: np.ndarray, keys: np.ndarray, s: Sampling) -> tuple[np.ndarray, np.ndarray]:
    """(range of each text's pieces, piece ids)."""
    rows = len(off) - 1
    if not len(data):
        return np.zeros(rows + 1, np.int64), np.zeros(0, np.int32)
    start = parts_of(v, off, data)
    text = np.searchsorted(off[1:], start, "right")
    with np.errstate(over="ignore"):
        seed = mix(mix(keys.astype(np.uint64) + U(s.seed))[text] + (start - off[text]).astype(np.uint64) * P)
    steps, out, a = [], [], 0
    size = np.diff(np.append(start, len(data)))
    while a < len(start):  # parts are sampled apart, so a text of any length goes through in runs of bounded size
        if size[a] > LONG:
            ids = encode_long(v, data[start[a] : start[a] + size[a]], int(seed[a]), s)
            steps.append(np.array([len(ids)]))
            out.append(ids)
            a += 1
            continue
        b = max(a + 1, int(np.searchsorted(start, start[a] + SLICE, "right")) - 1) if start[a] + SLICE < len(data) else len(start)
        long = np.flatnonzero(size[a:b] > LONG)
        b = a + int(long[0]) if len(long) else b
        end = start[b] if b < len(start) else len(data)
        own = _encode_parts(v, start[a:b] - start[a], data[start[a] : end], seed[a:b], s)
        steps.append(own[0])
        out.append(own[1])
        a = b
    upto = np.concatenate([[0], np.cumsum(np.concatenate(steps))])
    return upto[np.searchsorted(start, off)], np.concatenate(out)


def encode_long(v: Vocabulary, data: np.ndarray, seed: int, s: Sampling) -> np.ndarray:
    """Piece ids of one part that falls apart nowhere: byte by byte, with a number for each byte and the edges of one window in memory."""
    n, back = len(data), max(v.longest, 4)
    sums = [0.0] * (n + 1)

    def window(a: int, b: int) -> tuple[list, list, list, list]:
        """Edges that end after a and up to b, by end and longest first: bounds for each end, starts, scores, pieces."""
        low, high = max(0, a - back), min(n, b + 3)
        froms, lens, ids = edges(v, data[low:high], np.full(high - low, high - low))
        src, dst = froms + low, froms + low + lens
        some = np.flatnonzero((dst > a) & (dst <= b))
        some = some[np.argsort(dst[some] * np.int64(256) + (255 - lens[some]))]
        bounds = np.searchsorted(dst[some], np.arange(a + 1, b + 2))
        return bounds.tolist(), src[some].tolist(), (v.logp[ids[some]] * s.alpha).tolist(), ids[some].tolist()

    for a in range(0, n, WINDOW):
        b = min(n, a + WINDOW)
        bounds, src, score, _ = window(a, b)
        for d in range(a + 1, b + 1):
            x = [sums[src[k]] + score[k] for k in range(bounds[d - a - 1], bounds[d - a])]
            if len(x) == 1:
                sums[d] = x[0]
            elif x:
                top = max(x)
                sums[d] = top + math.log(sum([math.exp(y - top) for y in x]))
            else:
                sums[d] = -math.inf  # inside a character
    out, d, step, drawn = [], n, 0, []
    for a in range((n - 1) // WINDOW * WINDOW, -1, -WINDOW):
        bounds, src, score, ids = window(a, min(n, a + WINDOW))
        while d > a:
            if step % 4096 == 0:
                with np.errstate(over="ignore"):
                    at = np.arange(step, step + 4096, dtype=np.uint64)
                    drawn = ((mix(U(seed) + at * P_INV) >> U(11)).astype(float) * 2.0**-53).tolist()
            u, last = drawn[step % 4096], bounds[d - a] - 1
            k, upto = bounds[d - a - 1], 0.0
            while True:
                upto += math.exp(sums[src[k]] + score[k] - sums[d])
                if k == last or upto > u:
                    break
                k += 1
            out.append(ids[k])
            d = src[k]
            step += 1
    return np.array(out[::-1], np.int32)


def _encode_parts(v: Vocabulary, start: np.ndarray, data: np.ndarray, seed: np.ndarray, s: Sampling) -> tuple[np.ndarray, np.ndarray]:
    """(how many pieces each part has, piece ids) of the parts that start at ``start`` and fill ``data``."""
    one, which = distinct_parts(start, data)
    end = np.append(start[1:], len(data))
    size = (end - start)[one]
    own_off = np.concatenate([[0], np.cumsum(size)])
    lat = Lattice(v, own_off, data[np.arange(own_off[-1]) + np.repeat(start[one] - own_off[:-1], size)], s.alpha)
    at = np.arange(len(start))
    node = lat.node[which] + lat.size[which]
    base = lat.node[which]
    steps, chosen = np.zeros(len(start), np.int64), []
    while len(at):
        with np.errstate(over="ignore"):
            u = (mix(seed[at] + steps[at].astype(np.uint64) * P_INV) >> U(11)).astype(float) * 2.0**-53
        e = lat.first[node]
        todo = np.flatnonzero(lat.upto[e] <= u)
        while len(todo):
            e[todo] += 1
            todo = todo[lat.upto[e[todo]] <= u[todo]]
        chosen.append((at, lat.ids[e]))
        steps[at] += 1
        node = lat.src[e]
        more = node > base
        at, node, base = at[more], node[more], base[more]
    upto = np.concatenate([[0], np.cumsum(steps)])
    out = np.empty(int(upto[-1]), np.int32)
    for k, (at, ids) in enumerate(chosen):
        out[upto[at + 1] - 1 - k] = ids
    return steps, out


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None, s: Sampling = Sampling()) -> DataFrame:
    """``carry`` columns of every row (all by default) and ``pieces``, the sampled ids.

    The key is a number; rows with equal keys and equal texts get equal pieces, and a null key counts as 0. A null or
    empty text has no pieces; one of any length goes through in runs of bounded size. Of equal scores no piece is preferred. An
    empty table gives an empty result. A column called ``pieces``, in any case, is replaced.
    """
    names = docs.columns if carry is None else carry
    docs, at = positional(docs)
    keyed = docs.withColumn("_key", F.coalesce(F.col(at[key]).cast("long"), F.lit(0)))

    def make():
        v = vocabulary(s.model)

        def work(off, data, part):
            keys = np.asarray(part.column(part.schema.get_field_index("_key"))).astype(np.int64).view(np.uint64)
            bounds, ids = encode_slice(v, off, data, keys, s)
            return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))]

        return work

    names = others(names, ["pieces"])
    out = map_text(keyed, at[text], [*[at[c] for c in names], "_key"], [T.StructField("pieces", T.ArrayType(T.IntegerType()))], make, SLICE)
    return out.select(*named_again(names, at), "pieces")


def decode(rows: DataFrame, pieces: str = "pieces", to: str = "decoded", model: str = MODEL) -> DataFrame:
    """All columns of ``rows`` and the text of ``pieces``; null pieces give a null text, none an empty one. Rows go through in slices of
    bounded bytes, or one by one; an empty table gives an empty result; a column called like ``to``, in any case, is replaced.
    """
    names = others(rows.columns, [to])
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField(to, T.StringType())])

    def run(batches):
        v = vocabulary(model)
        for big in batches:
            column = big.column(big.schema.get_field_index(pieces))
            bounds = np.asarray(column.offsets).astype(np.int64)
            values = np.asarray(column.values)[bounds[0] : bounds[-1]]
            upto = np.concatenate([[0], np.cumsum(v.start[values + 1] - v.start[values])])
            bounds -= bounds[0]
            cuts, at = upto[bounds], 0  # where each row's text begins
            while at < big.num_rows:
                end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SLICE_BYTES, "right")) - 1)
                own, ids = cuts[at : end + 1] - cuts[at], values[bounds[at] : bounds[end]]
                size = v.start[ids + 1] - v.start[ids]
                flat = v.flat[np.arange(own[-1]) + np.repeat(v.start[ids] - (np.cumsum(size) - size), size)]
                text = pa.StringArray.from_buffers(end - at, pa.py_buffer(own.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))
                part = big.slice(at, end - at)
                if column.null_count:
                    text = pc.if_else(column.slice(at, end - at).is_valid(), text, None)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], text], [*names, to])
                at = end

    return map_arrow(rows, run, schema)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decode(encode(docs))
    return out.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.size("pieces").cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("lossless"),
    )


def encode_stage(docs: DataFrame) -> DataFrame:
    """The documents with their own columns, ``pieces`` and ``n_pieces``; nulls, empty and long texts, ties, repeated rows and empty tables
    as in ``encode``: a row without text has no pieces and stays."""
    return encode(docs).withColumn("n_pieces", F.size("pieces").cast("long"))


SQL: dict[str, str] = {}
