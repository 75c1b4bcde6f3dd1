"""ChaCha20-Poly1305 (RFC 8439) over columns, as Arrow-batched functions: Spark has no built-in for it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of RFC 8439: the constant, the order of quarter rounds, the clamp and the prime.
_CONSTANT = np.frombuffer(b"expand 32-byte k", "<u4")
_ROUNDS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_CLAMP = 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
_PRIME = (1 << 130) - 5


def blocks(key: np.ndarray, counter: np.ndarray, nonce: np.ndarray) -> np.ndarray:
    """Key stream: 64 bytes for each row of (8 words, number, 3 words)."""
    n = len(counter)
    start = np.empty((16, n), np.uint32)
    start[:4] = _CONSTANT[:, None]
    start[4:12], start[12], start[13:] = key.T, counter, nonce.T
    x = start.copy()

    def mix(a: int, b: int, d: int, by: int) -> None:
        x[a] += x[b]
        v = x[d] ^ x[a]
        x[d] = (v << np.uint32(by)) | (v >> np.uint32(32 - by))

    for _ in range(10):
        for a, b, c, d in _ROUNDS:
            mix(a, b, d, 16)
            mix(c, d, b, 12)
            mix(a, b, d, 8)
            mix(c, d, b, 7)
    return np.ascontiguousarray((x + start).T).astype("<u4").view(np.uint8).reshape(n, 64)


def poly1305(one_time: bytes, message: bytes) -> bytes:
    r, s = int.from_bytes(one_time[:16], "little") & _CLAMP, int.from_bytes(one_time[16:32], "little")
    acc = 0
    for i in range(0, len(message), 16):
        acc = (acc + int.from_bytes(message[i : i + 16] + b"\1", "little")) * r % _PRIME
    return ((acc + s) & ((1 << 128) - 1)).to_bytes(16, "little")


def _streams(keys: list[bytes], nonces: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key streams of all rows end to end, a whole number of blocks each, and where each row's starts: its first block is the
    one-time key, the text begins at the second."""
    n = 1 + -(-sizes // 64)
    row = np.repeat(np.arange(len(sizes)), n)
    counter = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint32)
    k = np.frombuffer(b"".join(keys), "<u4").reshape(-1, 8)
    v = np.frombuffer(b"".join(nonces), "<u4").reshape(-1, 3)
    return blocks(k[row], counter, v[row]).ravel(), (np.cumsum(n) - n) * 64


def _authenticated(data: bytes, text: bytes) -> bytes:
    pad = lambda b: b + bytes(-len(b) % 16)
    return pad(data) + pad(text) + len(data).to_bytes(8, "little") + len(text).to_bytes(8, "little")


def seal_rows(plain: list[bytes], keys: list[bytes], nonces: list[bytes], data: list[bytes]) -> list[bytes]:
    """nonce, ciphertext and tag of each row."""
    sizes = np.array([len(p) for p in plain], np.int64)
    stream, start = _streams(keys, nonces, sizes)
    out = []
    for p, nonce, d, at in zip(plain, nonces, data, start.tolist(), strict=True):
        text = (np.frombuffer(p, np.uint8) ^ stream[at + 64 : at + 64 + len(p)]).tobytes()
        out.append(nonce + text + poly1305(stream[at : at + 32].tobytes(), _authenticated(d, text)))
    return out


def open_rows(packed: list[bytes], keys: list[bytes], data: list[bytes]) -> list[bytes | None]:
    """The text of each row; None where the tag does not fit."""
    sizes = np.array([max(0, len(p) - 28) for p in packed], np.int64)
    stream, start = _streams(keys, [p[:12].ljust(12, b"\0") for p in packed], sizes)
    out: list[bytes | None] = []
    for p, d, at in zip(packed, data, start.tolist(), strict=True):
        text, tag = p[12:-16], p[-16:]
        good = len(p) >= 28 and poly1305(stream[at : at + 32].tobytes(), _authenticated(d, text)) == tag
        out.append((np.frombuffer(text, np.uint8) ^ stream[at + 64 : at + 64 + len(text)]).tobytes() if good else None)
    return out


def _rows(*columns: pd.Series) -> tuple[pd.Series, list[list[bytes]]]:
    whole = pd.concat([c.notna() for c in columns], axis=1).all(axis=1)
    return whole, [[bytes(x) for x in c[whole]] for c in columns]


def _answer(whole: pd.Series, got: list) -> pd.Series:
    out = pd.Series([None] * len(whole), index=whole.index, dtype=object)
    out[whole] = pd.Series(got, index=whole.index[whole], dtype=object)
    return out


def chacha_seal(plain: Column, key: Column, nonce: Column, data: Column) -> Column:
    """nonce, ciphertext and tag; null if anything is null."""

    @F.pandas_udf("binary")
    def run(p: pd.Series, k: pd.Series, n: pd.Series, d: pd.Series) -> pd.Series:
        whole, rows = _rows(p, k, n, d)
        return _answer(whole, seal_rows(*rows))

    return run(plain, key, nonce, data)


def chacha_open(packed: Column, key: Column, data: Column) -> Column:
    """The text; null if key, data or text do not match."""

    @F.pandas_udf("binary")
    def run(p: pd.Series, k: pd.Series, d: pd.Series) -> pd.Series:
        whole, rows = _rows(p, k, d)
        return _answer(whole, open_rows(*rows))

    return run(packed, key, data)
