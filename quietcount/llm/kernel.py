"""Byte-level text kernels shared by the Python-side operators of this subpackage.

Everything works on Arrow string columns as (offsets, bytes) pairs, in slices of bounded size, so that a
worker's memory depends on ``SLICE_BYTES`` and on the longest single text, never on the batch.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20

U = np.uint64
P = U(0x9E3779B97F4A7C15 | 1)
P_INV = U(pow(int(P), -1, 1 << 64))
Q = U(0xD6E8FEB86659FD93)

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x80:] = True
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _IS_WORD[_a : _b + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and its inverse for i in 0..n, modulo 2**64; kept and grown as needed."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((P, P_INV)):
            out = np.full(size + 1, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch so that each part has one row, or at most ``limit`` bytes of text."""
    off, data = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at), off[at : end + 1] - off[at], data[off[at] : off[end]]
        at = end


def map_text(df: DataFrame, text: str, carry: list[str], new: list[T.StructField], make: Callable, limit: int = SLICE_BYTES) -> DataFrame:
    """Add the columns ``new`` to ``carry``: ``make()`` gives, once a task, a function of (offsets, bytes, rows) that
    returns their Arrow arrays. Row by row: no shuffle, any number of rows. A carried column called like a new one,
    in any case, is replaced."""
    carry = others(carry, [f.name for f in new])
    schema = T.StructType([df.schema[c] for c in carry] + new)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part, off, data in slices(batch, text, limit):
                own = [part.column(part.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays(own + list(work(off, data, part)), names)

    return map_arrow(df.select(*[quoted(c) for c in dict.fromkeys([*carry, text])]), run, schema)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name, dots and all."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(pa.RecordBatch.from_arrays(b.columns, names) for b in batches)

    return df.toDF(*[f"_c{i}" for i in range(len(names))]).mapInArrow(named, schema)


def others(columns: list[str], new) -> list[str]:
    """The columns that no new one replaces."""
    new = {c.lower() for c in new}
    return [c for c in columns if c.lower() not in new]


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that clash with none of an operator's own, and which name stands for which column."""
    at = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*at.values()), at


def named_again(columns: list[str], at: dict[str, str]) -> list:
    return [F.col(at[c]).alias(c) for c in columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Words:
    """The words of some texts: lower-cased bytes, spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, off: np.ndarray, data: np.ndarray):
        self.low = low = LOWER[data]
        n = len(data)
        mask = _IS_WORD[data]
        first, last = mask.copy(), mask.copy()
        first[1:] &= ~mask[:-1]
        last[:-1] &= ~mask[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        first[inner] = mask[inner]
        last[inner - 1] = mask[inner - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.range = np.searchsorted(self.start, off)
        pw, inv = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + U(1)) * pw[:n], out=sums[1:])
        self._sums, self._inv = sums, inv
        self.hash = mix((sums[self.end] - sums[self.start]) * inv[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(words of more than n bytes, hash of their first n bytes: never a word's own hash)."""
        at = np.flatnonzero(self.end - self.start > n)
        start = self.start[at]
        return at, mix(mix((self._sums[start + n] - self._sums[start]) * self._inv[start]) + U(n))

    def key(self, at: int, n: int) -> bytes:
        """The words themselves: equal keys mean equal words."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.range, at, "right") - 1

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on, across texts; whoever uses it compares text_of both ends."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = self.hash[:m].copy()
        for j in range(1, n):
            out *= Q
            out += self.hash[j : j + m]
        return mix(out)


def found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table has."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in ``spark.checkpoint.dir``; a folder of our own only in local mode."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quietcount-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Shuffles and broadcasts that nothing refers to any more leave the disks now. Spark drops them only when the driver's heap is
    collected, which may be long after a cut made them useless."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver ends: lazy results may read it until then."""
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table, wherever it lies. A session that has ended can delete nothing any more."""
    if spark.sparkContext._jsc is None:
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame) -> DataFrame:
    """Written as a table to the shared folder and read again: later steps read only the columns they need."""
    path = folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
