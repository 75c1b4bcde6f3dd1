import hashlib
import random

import pytest

import numpy as np

from quietcount.llm import suffix_dedup
from quietcount.llm.suffix_dedup import Repeats, Suffixes, remove_repeats


def brute(rows, span):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            if w in seen:
                gone[s : s + span] = b"\1" * span
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def texts(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "délta", "of", "the", "and", "zeta", "eta", "theta"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(n))
    passage, base = say(40), say(120)
    rows = []
    for i in range(90):
        t = say(rng.randrange(0, 60))
        if i % 3 == 0:
            t = t + passage + say(rng.randrange(0, 30))
        if i % 7 == 0:
            w = base.split(" ")
            w[rng.randrange(len(w))] = "edit%d" % i
            t = " ".join(w)
        if i % 11 == 0:
            t = base
        rows.append((i, t))
    return rows + [(100, None), (101, ""), (102, "x" * 900), (103, "ab" * 400 + passage), (104, passage * 3), (105, "é" * 99)]


@pytest.mark.parametrize("span,crowd,listed", [(100, 20_000, 0), (100, 1, 9999), (100, 1, 20), (50, 3, 0), (300, 2, 9999), (1, 9, 9)])
def test_against_brute_force(spark, span, crowd, listed):
    rows = texts(1)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, n_bytes string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(df, r=Repeats(span=span, crowd=crowd, listed=listed)).collect()}
    assert got == brute(rows, span)


def test_repeated_rows_and_null_ids(spark):
    p = "some words that repeat " * 10
    df = spark.createDataFrame([(1, p), (1, p), (2, p), (None, p), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in remove_repeats(df, carry=["doc_id"]).collect())
    first = brute([(1, p)], 100)[1]
    assert got == [(1, len(p), first[1])] * 2 + [(2, len(p), len(p)), (3, 0, 0), (99, len(p), len(p))]


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_longer_than_a_segment(spark):
    rng = random.Random(3)
    passage = "".join(chr(rng.randrange(97, 123)) for _ in range(260_000))
    rows = [(1, passage * 5 + "end"), (2, "start" + passage[5000:]), (3, "x" * 1_200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(df).collect()}
    assert got == brute(rows, 100)


def test_mergesort_of_suffixes():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    group = np.sort(rng.integers(0, 30, 700))
    at = rng.integers(0, 3900, 700)
    size = rng.integers(0, 90, 700)
    text = lambda i: data[at[i] : at[i] + size[i]].tobytes()
    order, ext = Suffixes(data, at, size, 1).sorted_with_extensions(group)
    assert order.tolist() == sorted(range(700), key=lambda i: (group[i], text(i), i))
    for k in range(1, 700):
        x, y = text(order[k - 1]), text(order[k])
        same = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
        assert ext[k] == (same if group[k] == group[k - 1] else -1)


def test_collisions_change_no_result(monkeypatch):
    """A hash of four values collides all the time: the sort sees it by the bytes and tries others, and never lies."""
    real, calls = suffix_dedup.prefix_sums, []

    def weak(data, seed):
        calls.append(seed)
        return real(data, seed) if seed >= 4 else np.concatenate([[0], np.cumsum(data & 1)]).astype(np.uint64) * np.uint64(0)

    monkeypatch.setattr(suffix_dedup, "prefix_sums", weak)
    data = np.frombuffer(b"banana bandana ananas", np.uint8)
    at = np.arange(len(data))
    order, _ = suffix_dedup._sorted(data, at, len(data) - at, np.zeros(len(data), int))
    assert order.tolist() == sorted(at.tolist(), key=lambda i: data[i:].tobytes()) and max(calls) == 4


def test_span_out_of_range_is_refused():
    with pytest.raises(ValueError):
        Repeats(span=5000)
