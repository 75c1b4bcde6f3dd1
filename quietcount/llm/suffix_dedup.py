"""Suffix-array dedup of repeated byte strings.

Every byte covered by a string of ``span`` bytes that also starts earlier is found, over all texts. Positions are cut down
first: in every window of ``span`` bytes the gram with the smallest hash is the anchor, and windows with the same anchor
in a row make a block. Equal windows have equal anchors at equal places, so only suffixes at equal anchors are sorted.

1. Blocks are sorted by anchor, hash and position (a range sort, so that a hot anchor is spread over tasks). Of blocks of
   equal hash all but the first are taken for repeats of it. One document's repeats are joined to runs, and the
   bytes of every run are compared with those that it repeats: a hash collision stops the job, never changes a result.
2. The different blocks of an anchor are sorted as suffixes from the anchor on, and as prefixes before it: a mergesort that
   compares two suffixes by binary search for their common extension over polynomial prefix hashes, in a logarithmic
   number of steps. The common extensions of neighbours are verified byte by byte; a collision sorts anew under another
   hash. The two orders and their extensions tell which windows are equal; all but the first of them are repeats.
3. An anchor of more than ``crowd`` different blocks is split: by longer strings around it, which fewer windows share,
   and the same steps are applied to those, until single windows are left at the latest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietcount.llm.kernel import P, U, cut, found, map_text, mix, others, positional, powers, slices, stored


@dataclass(frozen=True)
class Repeats:
    span: int = 100
    gram: int = 32
    #: different blocks of an anchor that one task sorts at once
    crowd: int = 20_000
    #: as many crowded anchors are sent to every task; if there are more, the texts are shuffled to their blocks
    listed: int = 1 << 20
    seed: int = 0

    def __post_init__(self):
        if not 0 < self.span < 4096 or self.gram < 1:
            raise ValueError("span must lie between 1 and 4095 and gram above 0")

    @property
    def size(self) -> int:
        """Bytes of an anchor."""
        return min(self.gram, max(1, self.span * 8 // 25))

    @property
    def reach(self) -> int:
        """Windows that one anchor can have."""
        return self.span - self.size + 1


R = U(0xC2B2AE3D27D4EB4F)
SEGMENT = 1 << 20
_PLACE = U((1 << 21) - 1)
PIECE = 1 << 16
GONE, NEAR, OPEN, CROWD, SOURCE, CLAIM = range(6)
BLOCKS = "v long, x long, num long, at long"
MARKS = "kind byte, v long, x long, num long, at long, num0 long, at0 long"
RUNS = "num long, a long, n long, num0 long, a0 long"
CUTS = "v long, kind byte, num long, at long, bytes binary"


def prefix_sums(data: np.ndarray, seed: int) -> np.ndarray:
    """Sums of the bytes' random codes, which ``seed`` draws, times powers."""
    pw, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    code = mix((np.arange(256, dtype=np.uint64) + U(1)) * P + U(seed))
    np.cumsum(code[data] * pw[: len(data)], out=out[1:])
    return out


def string_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def pack(a: np.ndarray, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A block's first window, its windows and its anchor's place in the first one, in one number that sorts by the first."""
    return (a.astype(np.int64) << 24) | (c.astype(np.int64) << 12) | q.astype(np.int64)


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, (at >> 12) & 4095, at & 4095


def blocks(off: np.ndarray, data: np.ndarray, r: Repeats):
    """(prefix sums, anchor value, first window, windows, anchor's place, text) of each block."""
    n, k = len(data), r.size
    sums, m, none = prefix_sums(data, r.seed), len(data) - r.span + 1, np.zeros(0, np.int64)
    if m <= 0:
        return sums, np.zeros(0, np.uint64), none, none, none, none
    gram = mix((sums[k:] - sums[:-k]) * powers(n + 1)[1][: n - k + 1])
    low, width = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), 1  # of equal ones the leftmost
    while 2 * width <= r.reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < r.reach:
        low = np.minimum(low[: len(low) - (r.reach - width)], low[r.reach - width :])
    place = (low & _PLACE).astype(np.int64)
    last = np.repeat(off[1:], np.diff(off))[:m]
    ok = np.arange(m) + r.span <= last
    first = ok.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~ok[:-1] | (last[1:] != last[:-1])
    end = ok.copy()
    end[:-1] &= first[1:] | ~ok[1:]
    at = np.flatnonzero(first)
    return sums, gram[place[at]], at, np.flatnonzero(end) - at + 1, place[at] - at, np.searchsorted(off[1:], at, "right")


def _batches(columns: list[np.ndarray], names: list[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + rows]) for c in columns], names)


def _block_hash(sums: np.ndarray, a: np.ndarray, c: np.ndarray, r: Repeats) -> np.ndarray:
    return mix(string_hash(sums, a, a + c - 1 + r.span) + c.astype(np.uint64) * R)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)))


def _split(v, row, a, c, q, base, sums, r: Repeats, level: int):
    """Blocks cut at every ``width`` places of the anchor: (key, text, first window, windows, anchor's place) of the parts. A part is
    keyed by the string that all its possible windows share, which is longer the fewer those are."""
    width = -(-r.reach // (1 << level))
    low, high = (q - c + 1) // width, q // width
    n = high - low + 1
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    row, a, c, q = (np.repeat(y, n) for y in (row, a, c, q))
    most, least = np.minimum(k * width + width - 1, q), np.maximum(k * width, q - c + 1)
    anchor = base[row] + a + q
    key = string_hash(sums, anchor - k * width, anchor - (k * width + width - 1) + r.span)
    return mix(key + mix((k + 1).astype(np.uint64) * R + U(level))), row, a + q - most, most - least + 1, most


def _scan(r: Repeats, crowded: tuple = ()):
    """The blocks of every text; with ``crowded``, sorted anchors for each level so far, the parts of their blocks only. A text longer
    than a segment is scanned segment by segment, one window apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, off, data in slices(batch, "text", SEGMENT):
                num = _column(part, "num")
                for s in range(0, max(len(data), 1), SEGMENT) if part.num_rows == 1 else (0,):
                    own = data[s : s + SEGMENT + r.span - 1]
                    here = off if part.num_rows > 1 else np.array([0, len(own)])
                    sums, v, a, c, q, row = blocks(here, own, r)
                    a = a - here[:-1][row]
                    for level, anchors in enumerate(crowded, 1):
                        some = np.flatnonzero(found(v, anchors.value))
                        v, row, a, c, q = _split(v[some], *(y[some] for y in (row, a, c, q)), here[:-1], sums, r, level)
                    x = _block_hash(sums, here[:-1][row] + a, c, r)
                    yield from _batches([v.view(np.int64), x.view(np.int64), num[row], pack(a + s, c, q)], ["v", "x", "num", "at"])

    return run


def _mark(r: Repeats):
    """Over sorted blocks: all but the first of equal hash are gone, with a pointer to it; the others of an anchor with
    several go on. The first and last anchor of a partition may have more blocks elsewhere: they stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in MARKS.split(", ")]
        held: list[np.ndarray] = []  # columns of the unfinished last anchor's different blocks
        open_v: set = set()  # this partition's first anchor, and the last one that was too large to hold
        first_v = head = None

        def out(kind: np.ndarray, c: list[np.ndarray], to: list[np.ndarray] | None = None):
            none = np.zeros(len(kind), np.int64)
            return _batches([kind.astype(np.int8), *c, *(to or [none, none])], names, 1 << 20)

        for batch in batches:
            c = [np.asarray(x) for x in batch.columns]
            if not len(c[0]):
                continue
            v, x, num, at = c
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (x[1:] != x[:-1])
            new[0] = head is None or head[:2] != (v[0], x[0])
            source = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
            to = [np.where(source >= 0, y[source], 0 if head is None else head[2 + i]) for i, y in enumerate((num, at))]
            head = (v[-1], x[-1], to[0][-1], to[1][-1])
            if first_v is None:
                first_v = v[0]
                open_v = {first_v}
            gone = ~new
            if gone.any():
                none = np.zeros(int(gone.sum()), np.int64)
                yield from out(np.full(len(none), GONE), [none, none, num[gone], at[gone]], [y[gone] for y in to])
            c = [y[new] for y in c]
            if held:
                c = [np.concatenate([h, y]) for h, y in zip(held, c, strict=True)]
            if not len(c[0]):
                continue
            v = c[0]
            heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            done, held = [y[: heads[-1]] for y in c], [y[heads[-1] :] for y in c]
            if len(done[0]):
                size = np.repeat(np.diff(heads), np.diff(heads))
                kind = np.where(np.isin(done[0], list(open_v)), OPEN, np.where(size > r.crowd, CROWD, np.where(size > 1, NEAR, -1)))
                yes = kind >= 0
                yield from out(kind[yes], [y[yes] for y in done])
            if len(held[0]) > r.crowd:  # an anchor too large to hold stays open as a whole
                open_v = {first_v, held[0][0]}
                yield from out(np.full(len(held[0]), OPEN), held)
                held = [y[:0] for y in held]
        if held:
            yield from out(np.full(len(held[0]), OPEN), held)

    return run


def _level(rows: DataFrame, r: Repeats) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of blocks (v, x, num, at): the repeats with what they repeat, the different blocks of the other anchors, and those of
    crowded ones."""
    order = ["v", "x", "num", "at"]
    marks = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_mark(r), MARKS))
    opened = marks.where(F.col("kind") == OPEN).select(*order)
    # written before they are joined, so that adaptive execution can split a hot anchor
    first = cut(opened.groupBy("v", "x").agg(F.min(F.struct("num", "at")).alias("f")))
    several = cut(first.groupBy("v").agg(F.count("*").alias("m")).where("m > 1"))
    late = opened.join(first, ["v", "x"]).where(F.struct("num", "at") != F.col("f")).select("num", "at", F.col("f.num").alias("num0"), F.col("f.at").alias("at0"))
    more = first.join(several, "v").select(F.when(F.col("m") > r.crowd, CROWD).otherwise(NEAR).alias("kind"), "v", F.col("f.num").alias("num"), F.col("f.at").alias("at"))
    others_ = marks.where(F.col("kind").isin(NEAR, CROWD)).select(F.col("kind").cast("int").alias("kind"), "v", "num", "at").unionByName(more)
    gone = marks.where(F.col("kind") == GONE).select("num", "at", "num0", "at0").unionByName(late)
    return gone, others_.where(F.col("kind") == NEAR).drop("kind"), others_.where(F.col("kind") == CROWD).drop("kind")


def _asked(part: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row, fields) of a slice's lists of structs."""
    asked = part.column(part.schema.get_field_index("asked"))
    bounds = np.asarray(asked.offsets).astype(np.int64)
    flat = asked.values.slice(bounds[0], bounds[-1] - bounds[0]).flatten()
    return np.repeat(np.arange(part.num_rows), np.diff(bounds)), [np.asarray(x) for x in flat]


def _finer(r: Repeats, level: int):
    """The parts of the blocks that are asked of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, off, data in slices(batch, "text", SEGMENT):
                row, (at,) = _asked(part)
                sums = prefix_sums(data, r.seed)
                v, row, a, c, q = _split(None, row, *unpack(at), off[:-1], sums, r, level)
                x = _block_hash(sums, off[:-1][row] + a, c, r)
                yield from _batches([v.view(np.int64), x.view(np.int64), _column(part, "num")[row], pack(a, c, q)], ["v", "x", "num", "at"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over repeats sorted by position: those that follow each other, in the text and in what they repeat, become one."""
    names = [x.split(" ")[0] for x in RUNS.split(", ")]
    last = None
    for batch in batches:
        num, at, num0, at0 = (np.asarray(x) for x in batch.columns)
        if not len(num):
            continue
        (a, n, _), a0 = unpack(at), at0 >> 24
        rows = [num, a, n, num0, a0]
        if last is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(last, rows, strict=True)]
        num, a, n, num0, a0 = rows
        new = np.ones(len(num), bool)
        new[1:] = (num[1:] != num[:-1]) | (num0[1:] != num0[:-1]) | (a[1:] != a[:-1] + n[:-1]) | (a0[1:] != a0[:-1] + n[:-1])
        head = np.flatnonzero(new)
        rows = [num[head], a[head], np.add.reduceat(n, head), num0[head], a0[head]]
        last = [x[-1:] for x in rows]
        yield from _batches([x[:-1] for x in rows], names)
    if last is not None:
        yield from _batches(last, names)


def _cut_out(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum(size)])
    own = data[np.arange(cuts[-1]) + np.repeat(start - cuts[:-1], size)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(own.tobytes())])


class Collision(RuntimeError):
    """Different bytes of equal hash. Another seed draws another hash."""


def _emit(r: Repeats):
    """Cut out of each text what is asked of it: different blocks, and the runs to compare, in pieces of bounded size. Runs that
    repeat the same string are compared here, and one of them goes on from a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in CUTS.split(", ")]
        sent: dict[tuple, bytes] = {}
        room = 0
        for batch in batches:
            for part, off, data in slices(batch, "text", SEGMENT):
                row, (kind, v, at, n, num0, a0) = _asked(part)
                base = off[:-1][row]
                near = np.flatnonzero(kind == NEAR)
                for s in range(0, len(near), 20_000):
                    i = near[s : s + 20_000]
                    a, c, _ = unpack(at[i])
                    body = _cut_out(data, base[i] + a, c - 1 + r.span)
                    yield pa.RecordBatch.from_arrays([pa.array(v[i]), pa.array(kind[i]), pa.array(_column(part, "num")[row[i]]), pa.array(at[i]), body], names)
                rest = np.flatnonzero(kind != NEAR)
                if not len(rest):
                    continue
                size = n[rest] - 1 + r.span
                pieces = -(-size // PIECE)
                step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                i = np.repeat(rest, pieces)
                start, size = base[i] + at[i] + step * PIECE, np.minimum(np.repeat(size, pieces) - step * PIECE, PIECE)
                kind_, v_, of, place = kind[i], v[i], num0[i], a0[i] + step * PIECE
                order = np.lexsort((size, place, of, kind_))
                kind_, v_, of, place, start, size = (y[order] for y in (kind_, v_, of, place, start, size))
                again = np.zeros(len(of), bool)
                again[1:] = (kind_[1:] == kind_[:-1]) & (of[1:] == of[:-1]) & (place[1:] == place[:-1]) & (size[1:] == size[:-1])
                j = np.flatnonzero(again)
                for s in range(0, len(j), 4096):
                    own = j[s : s + 4096]
                    if not same_bytes(data, start[own - 1], start[own], size[own]).all():
                        raise Collision("blocks of equal hash differ")
                keep = []
                for t in np.flatnonzero(~again).tolist():
                    if kind_[t] == CLAIM:
                        key, own = (int(of[t]), int(place[t]), int(size[t])), data[start[t] : start[t] + size[t]].tobytes()
                        known = sent.get(key)
                        if known is not None:
                            if known != own:
                                raise Collision("blocks of equal hash differ")
                            continue
                        if room > SEGMENT * 8:
                            sent, room = {}, 0
                        sent[key] = own
                        room += len(own)
                    keep.append(t)
                for s in range(0, len(keep), 2048):
                    t = np.array(keep[s : s + 2048])
                    yield pa.RecordBatch.from_arrays([pa.array(v_[t]), pa.array(kind_[t]), pa.array(of[t]), pa.array(place[t]), _cut_out(data, start[t], size[t])], names)

    return run


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of ``size`` bytes at x and y are equal."""
    full = np.flatnonzero(size)
    out, size = np.ones(len(x), bool), size[full]
    if len(full):
        head = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(head, size)
        out[full] = np.logical_and.reduceat(data[np.repeat(x[full], size) + step] == data[np.repeat(y[full], size) + step], head)
    return out


class Suffixes:
    """Suffixes of one text's bytes, each up to its own length, compared by hashes of their first bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int):
        self.data, self.at, self.size = data, at, size
        self.sums, self.inv = prefix_sums(data, seed), powers(len(data) + 1)[1]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search."""
        a, b = self.at[x], self.at[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        base_a, base_b, inv_a, inv_b = self.sums[a], self.sums[b], self.inv[a], self.inv[b]
        while (low < high).any():
            mid = (low + high + 1) // 2
            equal = (self.sums[a + mid] - base_a) * inv_a == (self.sums[b + mid] - base_b) * inv_b
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; ``equal`` is the answer for equal ones."""
        n = self.common(x, y)
        ends_x, ends_y = n == self.size[x], n == self.size[y]
        top = len(self.data) - 1
        byte = self.data[np.minimum(self.at[x] + n, top)] < self.data[np.minimum(self.at[y] + n, top)]
        return np.where(ends_x & ends_y, equal, np.where(ends_x, True, np.where(ends_y, False, byte)))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Mergesort within each group (their members stand together), stable, all groups level by level."""
        n = len(group)
        order = np.arange(n)
        if not n:
            return order
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(head, n))
        begin, many = np.repeat(head, size), np.repeat(size, size)
        place, width = np.arange(n) - begin, 1
        while width < many.max():
            run = place // width
            to = (run ^ 1) * width
            e = np.flatnonzero((many > width) & (to < many))
            low = np.zeros(len(e), np.int64)
            high = np.minimum(width, many[e] - to[e])
            left, base, own = run[e] % 2 == 0, begin[e] + to[e], order[e]
            open_ = np.flatnonzero(low < high)
            while len(open_):  # how many of the other run come before each: a binary search of its own
                mid = (low[open_] + high[open_]) // 2
                before = self.less(order[base[open_] + mid], own[open_], ~left[open_])
                low[open_], high[open_] = np.where(before, mid + 1, low[open_]), np.where(before, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            new = order.copy()
            new[begin[e] + np.minimum(run[e], run[e] ^ 1) * width + place[e] % width + low] = own
            order, width = new, 2 * width
        return order

    def sorted_with_extensions(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The order and each one's common extension with the one before it in its group (-1: the first), verified byte by byte.
        None if a collision of hashes shows."""
        order = self.sort(group)
        ext = np.full(len(order), -1, np.int64)
        i = np.flatnonzero(group[1:] == group[:-1]) + 1
        x, y = order[i - 1], order[i]
        ext[i] = n = self.common(x, y)
        ends_x, ends_y, top = n == self.size[x], n == self.size[y], len(self.data) - 1
        rises = np.where(ends_x, True, np.where(ends_y, False, self.data[np.minimum(self.at[x] + n, top)] < self.data[np.minimum(self.at[y] + n, top)]))
        return (order, ext) if rises.all() and same_bytes(self.data, self.at[x], self.at[y], n).all() else None


def _sorted(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for seed in range(1, 100):
        got = Suffixes(data, at, size, seed).sorted_with_extensions(group)
        if got is not None:
            return got
    raise Collision("no hash sorted the suffixes")


def repeated_windows(group: np.ndarray, at: np.ndarray, size: np.ndarray, data: np.ndarray, r: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first window, windows) that an earlier block of the same anchor has too. Blocks come sorted by anchor and
    position, with their packed place and bytes."""
    a, c, q = unpack(at)
    start = np.cumsum(size) - size
    n = len(at)
    right, right_ext = _sorted(data, start + q, size - q, group)
    left, left_ext = _sorted(data[::-1], len(data) - (start + q), q, group)
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_r[right], rank_l[left] = np.arange(n), np.arange(n)
    places = np.arange(r.reach)
    stand = np.arange(n, dtype=np.int32)[:, None]
    # of the suffixes that agree so far with the one of each rank, the first one's rank
    class_r = np.maximum.accumulate(np.where(right_ext[:, None] < r.span - places, stand, 0), 0)
    class_l = np.maximum.accumulate(np.where(left_ext[:, None] < places, stand, 0), 0)
    i = np.repeat(np.arange(n), c)
    step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    place = q[i] - step  # bytes of the window before the anchor
    key = (class_r[rank_r[i], place].astype(np.int64) * n + class_l[rank_l[i], place]) * r.reach + place
    _, first = np.unique(key, return_index=True)
    gone = np.ones(len(key), bool)
    gone[first] = False
    new = gone.copy()
    new[1:] &= ~gone[:-1] | (i[1:] != i[:-1])
    end = gone.copy()
    end[:-1] &= ~gone[1:] | (i[1:] != i[:-1])
    new, end = np.flatnonzero(new), np.flatnonzero(end)
    return i[new], a[i[new]] + step[new], end - new + 1


def _resolve(r: Repeats):
    """Rows come sorted by v and kind: different blocks are sorted as suffixes anchor by anchor; runs are compared with what they
    repeat, which stands before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, source = 0, {}

        def near(table: pa.Table) -> Iterator[pa.RecordBatch]:
            col = lambda k: np.asarray(table.column(k).combine_chunks())
            body = table.column("bytes").combine_chunks().cast(pa.large_binary())
            _, off, data = body.buffers()
            off = np.frombuffer(off, np.int64)[body.offset : body.offset + len(body) + 1]
            i, a, n = repeated_windows(col("v"), col("at"), np.diff(off), np.frombuffer(data, np.uint8)[off[0] : off[-1]], r)
            yield from _batches([col("num")[i], a, n], ["num", "a", "n"])

        for batch in batches:
            kind = np.asarray(batch.column("kind"))
            own = batch.filter(pa.array(kind == NEAR))
            for row in batch.filter(pa.array(kind != NEAR)).to_pylist():
                key = (row["num"], row["at"], len(row["bytes"]))
                if row["kind"] == SOURCE:
                    source = {k: b for k, b in source.items() if b[0] == row["v"]} | {key: (row["v"], row["bytes"])}
                elif source[key][1] != row["bytes"]:
                    raise Collision("blocks of equal hash differ: take another seed")
            if own.num_rows:
                held.append(own)
                rows += own.num_rows
            if rows > max(r.crowd, 5_000):
                table = pa.Table.from_batches(held).combine_chunks()
                v = np.asarray(table.column("v").combine_chunks())
                end = int(np.flatnonzero(v != v[-1])[-1]) + 1 if (v != v[-1]).any() else 0
                if end:
                    yield from near(table.slice(0, end))
                held = table.slice(end).combine_chunks().to_batches()
                rows = table.num_rows - end
        if held:
            yield from near(pa.Table.from_batches(held).combine_chunks())

    return run


def _numbered(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, bool]:
    """``docs`` with ``num``, a number that orders documents, and whether no two rows share one. Ids that are unique and not
    null are used as they are; else the distinct pairs of id and text hash are range-sorted and numbered in that order."""
    unique = docs.groupBy(doc_id).agg(F.count("*").alias("n")).where(F.col(doc_id).isNull() | (F.col("n") > 1)).limit(1).count() == 0
    if unique:
        return docs.withColumn("num", F.col(doc_id).cast("long")).where(F.col("num").isNotNull()), True
    keyed = docs.withColumn("_k", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    order = keyed.select(F.col(doc_id).alias("_d"), F.col("_k").alias("_k2")).distinct().orderBy(F.col("_d").asc_nulls_last(), "_k2")
    order = cut(order.withColumn("num", F.monotonically_increasing_id()))
    return keyed.join(order, keyed[doc_id].eqNullSafe(order["_d"]) & (F.col("_k") == F.col("_k2"))).drop("_d", "_k", "_k2"), False


def _repeats(texts: DataFrame, r: Repeats) -> DataFrame:
    """(num, a, n): runs of windows of each text that also start earlier. ``texts`` has num, text and any other columns."""
    gone, near, known, level = [], [], [], 0
    rows = texts.select("num", "text").mapInArrow(_scan(r), BLOCKS)
    while True:
        g, n, crowded = _level(rows, r)
        gone.append(g)
        near.append(n)
        if r.reach <= 1 << level or not crowded.limit(1).count():
            break
        level += 1
        anchors = cut(crowded.select("v").distinct())
        if len(known) == level - 1 and anchors.count() <= r.listed:  # few enough to send to every task: the texts stay where they are
            known.append(texts.sparkSession.sparkContext.broadcast(np.sort(np.array([v for (v,) in anchors.collect()], np.int64).view(np.uint64))))
            rows = texts.select("num", "text").mapInArrow(_scan(r, tuple(known)), BLOCKS)
        else:
            asked = crowded.groupBy("num").agg(F.collect_list(F.struct("at")).alias("asked"))
            rows = texts.join(asked, "num").select("num", "text", "asked").mapInArrow(_finer(r, level), BLOCKS)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    runs = stored(union(gone).repartition("num").sortWithinPartitions("num", "at").mapInArrow(_runs, RUNS))
    key, none = F.xxhash64("num0", "a0", "n"), F.lit(0).cast("long")
    fields = lambda kind, at: F.struct(F.lit(kind).cast("byte").alias("kind"), key.alias("v"), F.col(at).alias("at"), "n", "num0", "a0")
    claims = runs.select("num", fields(CLAIM, "a").alias("s"))
    sources = runs.select("num0", "a0", "n").distinct().select(F.col("num0").alias("num"), fields(SOURCE, "a0").alias("s"))
    blocks_ = union(near).select("num", F.struct(F.lit(NEAR).cast("byte").alias("kind"), "v", "at", none.alias("n"), none.alias("num0"), none.alias("a0")).alias("s"))
    # a document is asked for its own blocks and runs, and for distinct stretches of its blocks: the corpus doesn't lengthen the list
    asked = union([claims, sources, blocks_]).groupBy("num").agg(F.collect_list("s").alias("asked"))
    settled = texts.join(asked, "num").mapInArrow(_emit(r), CUTS)
    settled = settled.repartition("v").sortWithinPartitions("v", "kind", "num", "at").mapInArrow(_resolve(r), "num long, a long, n long")
    return runs.select("num", "a", "n").unionByName(settled)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None, r: Repeats = Repeats()) -> DataFrame:
    """``carry`` columns of every row (all by default) and n_bytes, n_removed, n_spans (longs), kept (binary: the bytes that are left).

    A byte goes when a string of ``span`` bytes that covers it also starts earlier: in a document of smaller id or at a smaller
    position. A null text is empty. Rows that share id and text are one document and get the same result; rows that
    share only the id follow each other by a hash of the text; a null id comes last. An empty table gives an empty result.
    A text of any length is scanned segment by segment. Columns named like a new one, in any case, are replaced.
    """
    new = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())]
    carry = others(docs.columns if carry is None else carry, [f.name for f in new])
    docs, column = positional(docs)
    text, doc_id = column[text], column[doc_id]
    numbered, unique = _numbered(docs.select(*dict.fromkeys([*[column[c] for c in carry], doc_id, text])), text, doc_id)
    # both joins with the texts deal out the same columns, so that Spark shuffles them once
    numbered = numbered.select("num", F.col(text).alias("text"), *[F.col(column[c]).alias(f"_k{i}") for i, c in enumerate(carry)])
    gone = _repeats(numbered if unique else numbered.select("num", "text").dropDuplicates(["num"]), r)
    gone = gone.groupBy("num").agg(F.collect_list(F.struct("a", "n")).alias("asked"))  # one document's runs of windows

    def make():
        def work(off, data, part):
            row, (a, n) = _asked(part)
            edge = np.zeros(len(data) + 1, np.int32)
            at = off[:-1][row] + a
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n - 1 + r.span, -1)
            removed = np.cumsum(edge[:-1]) > 0
            begin = removed.copy()
            begin[1:] &= ~removed[:-1]
            heads = off[:-1][off[:-1] < len(data)]
            begin[heads] = removed[heads]
            total, spans = np.concatenate([[0], np.cumsum(removed)]), np.concatenate([[0], np.cumsum(begin)])
            left = data[~removed]
            stay = off - total[off]
            kept = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(stay.astype(np.int32).tobytes()), pa.py_buffer(left.tobytes())])
            return pa.array(np.diff(off)), pa.array(np.diff(total[off])), pa.array(np.diff(spans[off])), kept

        return work

    held = numbered.join(gone, "num", "left").withColumn("asked", F.coalesce("asked", F.array().cast("array<struct<a:long,n:long>>")))
    out = map_text(held, "text", [*[f"_k{i}" for i in range(len(carry))], "asked"], new, make)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(carry)], *[f.name for f in new])


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, carry=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL: dict[str, str] = {}
