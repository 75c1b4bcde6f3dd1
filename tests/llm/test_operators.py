import glob
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietcount.llm import components, decontamination, embedding_dedup, kernel, line_dedup, minhash_dedup, pieces, quality, sharding, toxicity, url_filters

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", f"src{i % 7}", len(t or "")) for i, t in enumerate(texts)], DOC)


def say(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def words_of(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


@pytest.mark.parametrize("block", [1 << 26, 6000])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(3)
    items = [(i, say(rng, n, 60)) for i, n in enumerate((30, 12, 10, 9, 5, 3, 1, 40))] + [(8, None), (9, "..."), (1, say(rng, 11)), (None, say(rng, 15))]
    texts = [None, "", "...", "x" * 5000] + [say(rng, rng.randrange(1, 50), 60) for _ in range(40)]
    texts += [say(rng, 5) + ", " + items[k][1].upper() + "! " + say(rng, 4) for k in range(8)] + [items[0][1]] * 2
    got = {r.doc_id: r for r in decontamination.digest(decontamination.match_benchmark(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), index_bytes=block)).collect()}
    for d, t in enumerate(texts):
        w = words_of(t)
        hit, found = set(), set()
        for i, x in items:
            b = words_of(x)
            n = min(len(b), 10)
            wins = {tuple(b[s : s + n]) for s in range(max(len(b) - 9, 1))} if b else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= {str(i)} if i is not None else set()
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].items_sha256) == want


def test_decontamination_in_blocks_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "x", "y", "z")], "doc_id long, text string, _spans string, _ITEMS string, N_Hit string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "d", "q r", "b c d"])], "item_id long, text string")
    out = decontamination.match_benchmark(df, items, index_bytes=150)
    r = out.first().asDict()
    assert out.columns[:4] == ["doc_id", "text", "_spans", "_ITEMS"] and r["n_hit"] == 4 and r["hit_items"] == ["0", "1", "3"] and r["hit_spans"] == [0, 4]


def test_decontamination_index_is_bounded():
    rng = random.Random(1)
    rows = [(i, say(rng, 200, 90_000)) for i in range(500)]
    index = decontamination.Index(rows)
    assert index.nbytes <= sum(len(t) + decontamination.WORD_BYTES * 200 for _, t in rows)


def test_url_rules_and_odd_urls(spark):
    urls = ["http://a.net/x", "https://www.EXAMPLE.net/en/1?q", "http://example.com/de/1", "http://x.example.com/fr/", "http://y.org/fr/a", "net", None, "http://net", "ftp://notnet/", "http://a.net?x://b.org/fr/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "host string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages, none).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/1", "example.com/de/", "block")
    assert got[3] == ("x.example.com", "/fr/", None, "allow")
    assert got[4] == ("y.org", "/fr/a", "org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("net", "", None, "allow") and got[8] == ("notnet", "/", None, "allow")
    assert got[9] == ("a.net", "", None, "allow")
    seen = spark.createDataFrame([("bad.example.com", True)] * 40 + [("good.example.com", False)] * 40, "host string, bad boolean")
    two = spark.createDataFrame([(1, "http://bad.example.com/"), (2, "http://good.example.com/"), (3, "http://new.example.com/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filters.filter_urls(two, seen).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(5)
    texts = [None, ""] + [say(rng, rng.randrange(0, 80)) for _ in range(400)] + ["same text"] * 150
    rows = sharding.shard_documents(docs(spark, texts).repartition(3), 8).collect()
    assert len(rows) == len(texts)
    size = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(size) - min(size) <= 2 * max(r["size"] for r in rows)
    for s in range(8):
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard_documents(docs(spark, []), 8).count() == 0
    assert {r["shard"] for r in sharding.shard_documents(docs(spark, ["a"]), 8).collect()} <= set(range(8))
    assert len({r["shard"] for r in sharding.shard_documents(docs(spark, texts), None, 5000).collect()}) > 4


def kd_by_hand(points, weights, shards):
    """Rows in order of their number; each node is cut at its weighted median along its widest dimension."""
    reach = [max(max(x) - min(x), 1e-300) for x in zip(*points, strict=True)]
    out = {}

    def split(rows, first, k):
        if k == 1:
            out.update(dict.fromkeys(rows, first))
            return
        half = k // 2
        if len(rows) < 2:
            return split(rows, first, half)
        wide = max(range(len(reach)), key=lambda d: ((max(points[i][d] for i in rows) - min(points[i][d] for i in rows)) / reach[d], -d))
        rows = sorted(rows, key=lambda i: (points[i][wide], i))
        need, at = sum(weights[i] for i in rows) * half / k, 0
        while need > weights[rows[at]]:
            need -= weights[rows[at]]
            at += 1
        at += 2 * need >= weights[rows[at]]
        split(rows[:at], first, half)
        split(rows[at:], first + half, k - half)

    split(list(range(len(points))), 0, shards)
    return out


@pytest.mark.parametrize("shards,small", [(1, 9), (6, 1), (13, 50_000)])
def test_shards_against_a_tree_by_hand(spark, monkeypatch, shards, small):
    monkeypatch.setattr(sharding, "SMALL", small)
    rng = random.Random(shards)
    rows = [(i, float(rng.randrange(6)), rng.random() if i % 3 else None, float(i % 2), rng.randrange(1, 500)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, x double, y double, z double, w long").coalesce(1).sortWithinPartitions("i")
    got = {r.i: r["shard"] for r in sharding.kd_shards(df, {c: F.col(c) for c in "xyz"}, "w", shards).collect()}
    assert got == kd_by_hand([[v or 0.0 for v in r[1:4]] for r in rows], [r[4] for r in rows], shards)


def test_hot_lines_and_hosts_are_spread(spark):
    line = "this line stands on every site there is"
    texts = [f"{line}\n{line} {i} and some more" for i in range(3000)]
    with_conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in with_conf}
    for k, v in with_conf.items():
        spark.conf.set(k, v)
    lines = line_dedup._keyed(docs(spark, texts), "text", "source", "doc_id", line_dedup.Spread())
    hot = lines.groupBy("k1", "k2").count().where("count > 2000").select("k1", "k2")
    dealt = line_dedup._dealt(lines, lines.select("k1", "k2").distinct(), hot)
    sizes = [len(x) for x in dealt.select("salt").rdd.glom().collect()]
    for k, v in old.items():
        spark.conf.set(k, v)
    assert sum(sizes) == 6000 and max(sizes) < 2 * 6000 / 16


def test_url_ties_cases_and_empty_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "z"), (1, "http://a.org/x", "z"), (2, "http://b.com/", "y")], "page_id long, URL string, HOST string")
    both = [("block", "a.org", "/x"), ("allow", "org", "/x")]
    none = spark.createDataFrame([], "host string, bad boolean")
    same = [("block", "a.org", "/"), ("allow", "a.org", "/")]
    assert [r.verdict for r in url_filters.filter_urls(pages, none, url="URL", rules=both).collect()].count("block") == 2
    assert {r.verdict for r in url_filters.filter_urls(pages, none, url="URL", rules=same).where("page_id = 1").collect()} == {"block"}
    assert {r.verdict for r in url_filters.filter_urls(pages, none, url="URL", rules=same[::-1]).where("page_id = 1").collect()} == {"allow"}
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (2, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    seen = url_filters.labelled_pages(pages.withColumnRenamed("URL", "url"), labels).collect()
    assert [(r.host, r.bad) for r in seen] == [("b.com", True)]
    assert url_filters.filter_urls(pages.limit(0), none, url="URL").count() == 0


def test_line_dedup_keeps_the_first(spark):
    line = "this line stands on every site there is"
    texts = [f"start {i}\n{line}\nshort\nend {i}" for i in range(7)] + [None, "", line + "\n" + line]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].n_removed == 0
    assert all(got[i].text == f"start {i}\nshort\nend {i}" for i in range(1, 7))
    assert got[7].text is None and got[7].n_lines == 1 and got[8].text == "" and got[9].text == "" and got[9].n_removed == 2


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    v = np.concatenate([base[rng.integers(0, 30, 200)] + 0.12 * rng.normal(size=(200, 16)), base, base[:3]])
    rows = [(i, x.tolist(), int(i % 2)) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 0), (903, v[0].tolist(), None), (904, [1.0, None], 0), (905, [1.0, 0.0], 0)]
    q = embedding_dedup.Quantiser(per_list=10, tile=32, codes=8)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), q=q).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.arange(len(v))[:, None] % 2 == np.arange(len(v)) % 2)
    np.fill_diagonal(link, False)
    comp = np.arange(len(v))
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(v))])
        if (new == comp).all():
            break
        comp = new
    assert all(got[i] == (link[i].sum(), comp[i], comp[i] == i) for i in range(len(v)))
    assert all(got[i] == (0, i, True) for i in range(900, 906))


@pytest.mark.parametrize("rank", [2, 3, 6])
def test_embeddings_of_low_rank_lose_no_link(spark, rank):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, rank)) @ rng.normal(size=(rank, 64))
    q = embedding_dedup.Quantiser(per_list=20, codes=8)
    rows = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(rows, q=q).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert [got[i] for i in range(len(v))] == ((u @ u.T >= 0.93).sum(1) - 1).tolist()


@pytest.mark.parametrize("rounds,tile", [(1, 512), (3, 4)])
def test_minhash_against_brute_force(spark, rounds, tile):
    rng = random.Random(8)
    base = [say(rng, 150, 5000) for _ in range(12)]
    texts = [None, "", "one two", "one two", "..."]
    for t in base:
        for k in (0, 0, 1, 3, 6):
            w = t.split(" ")
            for _ in range(k):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
            texts.append(" ".join(w))
    for k in range(40):  # one bucket of many: copies of one text, each further from it
        w = base[0].split(" ")
        for _ in range(1 + k // 4):
            w[rng.randrange(len(w))] = f"other{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    m = minhash_dedup.MinHash(rounds=rounds, tile=tile, bands=24, rows=2)
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs(spark, texts), m=m).collect()}
    off, data = kernel.utf8(__import__("pyarrow").array(texts))
    df = np.zeros(m.buckets, int)
    bounds, h, _ = minhash_dedup.shingles(off, data, m.shingle)
    np.add.at(df, (h & np.uint64(m.buckets - 1)).astype(int), 1)
    b, h, w = minhash_dedup.Weigher(minhash_dedup.idf_table(df, df.mean(), len(texts), m), m).weighted(off, data)
    sets = [dict(zip(h[x:y].tolist(), w[x:y].tolist(), strict=True)) for x, y in zip(b, b[1:], strict=False)]
    comp = list(range(len(texts)))
    jac = lambda x, y: sum(min(v, y.get(k, 0)) for k, v in x.items()) / max(sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}), 1e-9)
    for _ in range(5):
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (texts[i] or "") == (texts[j] or "") or jac(sets[i], sets[j]) >= m.threshold:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert [got[i] for i in range(len(texts))] == comp


def test_minhash_finds_near_copies_in_a_large_group(spark, tmp_path):
    """Two words of 150 changed: a plain similarity to the text of 0.87, however many copies of it there are."""
    rng = random.Random(12)
    base, texts = say(rng, 150, 5000), [say(rng, 150, 5000) for _ in range(240)]
    near = [base] * 20
    for k in range(60):
        w = base.split(" ")
        w[10 + k], w[80 + k] = f"new{k}", f"other{k}"
        near.append(" ".join(w))
    docs(spark, near + texts).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash_dedup.op7_minhash_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: 0 if i < len(near) else i for i in range(len(near) + len(texts))}
    kept = {r.doc_id for r in minhash_dedup.keep_one(spark.read.parquet(f"{tmp_path}/documents.parquet"), minhash_dedup.ONCE).collect()}
    assert kept == {0, *range(len(near), len(near) + len(texts))}


@pytest.mark.parametrize("few", [0, 100_000])
def test_minhash_counts_a_group_of_copies_once(spark, monkeypatch, few):
    """A text on many rows, rows of one id among them, and its near copy are one; texts that share a third of their words are not."""
    monkeypatch.setattr(minhash_dedup, "FEW", few)
    rng = random.Random(13)
    common, base = say(rng, 40, 5000), say(rng, 150, 5000)
    own = [f"{common} {say(rng, 110, 5000)}" for _ in range(30)]
    texts = [base] * 9 + [base.replace(base.split(" ")[70], "changed")] + own
    rows = docs(spark, texts).unionByName(docs(spark, [base] * 5)).select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("k1"), F.hash("text", F.length("text")).alias("k2"))
    classes = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    counted, n = minhash_dedup._once(rows, classes, minhash_dedup.ONCE)
    left = [r.text for r in counted.collect()]
    assert len(left) == len(set(left)) == n and sum(t not in own for t in left) == 1 and 10 < n <= 31


@pytest.mark.parametrize("few", [0, 300, 100_000])
def test_components_of_few_edges_are_those_of_the_rounds(spark, few):
    rng = random.Random(14)
    pairs = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(90)] + [(5, 5), (None, 7), (7, None)]
    least = {x: x for a, b in pairs if None not in (a, b) and a != b for x in (a, b)}
    for _ in range(len(pairs)):
        for a, b in pairs:
            if a in least and b in least and a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(pairs, "a long, b long"), few=few).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(least.items())
    assert not components.components(spark.createDataFrame([(5, 5)], "a long, b long"), few=few).collect()


def test_minhash_leaves_no_used_shuffles(spark, tmp_path):
    """Of the files that it dealt out, only those of its last steps may stay on the disks."""
    rng = random.Random(15)
    near = say(rng, 150, 5000)
    texts = [say(rng, 60, 5000) for _ in range(40)] + [near.replace(near.split(" ")[k], f"new{k}") for k in range(20)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    at = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    there = lambda: {x for d in at for x in glob.glob(f"{d}/*/shuffle_*.data")}
    before = there()
    out = minhash_dedup.op7_minhash_dedup(spark, str(tmp_path))
    until = time.time() + 10  # Spark's cleaner works beside
    while len(there() - before) >= 10 and time.time() < until:
        time.sleep(0.2)
    assert len(there() - before) < 10
    assert {r.doc_id: r.class_id for r in out.collect()} == {i: min(i, 40) for i in range(60)}


def test_pieces_round_trip_and_repeat(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "  a  b\n\n▁ meta ▁▁", "naïve café 漢字 🙂 \x00\x01", "x" * 3000] + [say(rng, 60) for _ in range(20)]
    df = docs(spark, texts)
    out = {r.doc_id: r for r in pieces.decode(pieces.encode(df)).collect()}
    assert all(out[i].decoded == (t or "") for i, t in enumerate(texts))
    again = {r.doc_id: r.pieces for r in pieces.encode(df.repartition(7)).collect()}
    assert all(out[i].pieces == again[i] for i in out)
    v = pieces.Vocabulary(pieces=[(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)] + [("a", -1.0, "piece"), ("b", -1.5, "piece"), ("ab", -2.0, "piece")])
    off, data = kernel.utf8(__import__("pyarrow").array(["ab"] * 20000))
    bounds, ids = pieces.encode_slice(v, off, data, np.arange(20000, dtype=np.uint64), pieces.Sampling())
    share = (np.diff(bounds) == 1).mean()
    assert abs(share - np.exp(-2) / (np.exp(-2) + np.exp(-2.5))) < 0.02  # whole piece against two


def little_vocabulary(words):
    return pieces.Vocabulary(pieces=[(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)] + [(w, -1.0 - 0.3 * k, "piece") for k, w in enumerate(words)])


def segmentations(v, text):
    """Every way to make the text of pieces, with its probability: a character without a piece of its own is made of bytes."""
    by = {v.bytes[i]: i for i in range(256, len(v.bytes))}
    b = text.encode()
    found, chars = [], [c.encode() for c in text]

    def go(at, ids, logp):
        if at == len(b):
            found.append((tuple(ids), logp))
            return
        for n in range(1, len(b) - at + 1):
            i = by.get(b[at : at + n])
            if i is not None:
                go(at + n, [*ids, i], logp + v.logp[i])
        char = next(c for k, c in enumerate(chars) if sum(map(len, chars[:k])) == at)
        if char not in by:
            own = [int(v.byte_id[x]) for x in char]
            go(at + len(char), [*ids, *own], logp + sum(v.logp[i] for i in own))

    go(0, [], 0.0)
    total = sum(np.exp(x) for _, x in found)
    return {ids: np.exp(x) / total for ids, x in found}


@pytest.mark.parametrize("text", ["abab", "aab bab", "bé漢ab", "  ba", "ab▁c"])
def test_pieces_against_every_segmentation(text):
    v = little_vocabulary(["a", "b", "ab", "aba", "ba", " ", "  b", " b", "é", "bab"])
    want = segmentations(v, text)
    n = 30_000
    off, data = kernel.utf8(__import__("pyarrow").array([text] * n))
    bounds, ids = pieces.encode_slice(v, off, data, np.arange(n, dtype=np.uint64), pieces.Sampling())
    got = {}
    for a, b in zip(bounds, bounds[1:], strict=False):
        k = tuple(ids[a:b].tolist())
        got[k] = got.get(k, 0) + 1 / n
    assert set(got) <= set(want) and max(abs(got.get(k, 0) - p) for k, p in want.items()) < 0.015


def test_pieces_of_long_parts(monkeypatch):
    """Cut where nothing reaches over, or byte by byte in small windows: the same distribution's same draws, and lossless."""
    rng = random.Random(2)
    v = little_vocabulary(["a", "b", "ab", "aba", "ba", " ", "  b", "é", "bab", "cc", "ccc"])
    text = "".join(rng.choice(["a", "b", "ab", "é", "漢", "c", "ccc"]) for _ in range(700))
    own = np.frombuffer(text.encode(), np.uint8)
    whole = pieces._encode_parts(v, np.array([0]), own, np.array([77], np.uint64), pieces.Sampling())[1]
    monkeypatch.setattr(pieces, "WINDOW", 37)
    assert pieces.encode_long(v, own, 77, pieces.Sampling()).tolist() == whole.tolist()
    for long in (8, 100_000):
        monkeypatch.setattr(pieces, "LONG", long)
        _, ids = pieces.encode_slice(v, np.array([0, len(own)]), own, np.array([5], np.uint64), pieces.Sampling())
        assert b"".join(v.bytes[i] for i in ids).decode() == text


def test_pieces_that_cross_blanks_are_seen():
    v = little_vocabulary(["a", "b", "a b"])
    assert not v.blank_cuts and little_vocabulary(["a", " a", "  "]).blank_cuts
    off, data = kernel.utf8(__import__("pyarrow").array(["a b"] * 4000))
    bounds, _ = pieces.encode_slice(v, off, data, np.arange(4000, dtype=np.uint64), pieces.Sampling())
    assert (np.diff(bounds) == 1).any()


def test_quality_learns_nothing_held_out_and_follows_one_gradient(spark):
    import zlib

    texts = [f"Text number {i} has words." for i in range(300)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.training_rows(docs(spark, texts + texts[:20]), labels, ["quality"], 150, ~quality.held_out()).collect()
    assert len(rows) == 150 and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in rows)
    few = quality.training_rows(docs(spark, texts), labels, ["quality"], 150, ~quality.held_out(), max_bytes=1000).collect()
    assert 0 < sum(len(r.text) for r in few) <= 1000
    # the transitions' expected counts are the gradient of the log partition
    rng = np.random.default_rng(1)
    lines, weight = np.array([0, 4, 5, 9]), rng.random(3)
    score, pull, each = rng.normal(size=9), rng.normal(size=(2, 2)), np.repeat(weight, [4, 1, 4])

    def partition(pull):
        total = 0.0
        for k in range(3):
            e = score[lines[k] : lines[k + 1]]
            z = [sum(e[i] for i in range(len(e)) if y >> i & 1) + sum(pull[y >> i & 1, y >> i + 1 & 1] for i in range(len(e) - 1)) for y in range(1 << len(e))]
            total += weight[k] * np.log(np.exp(z).sum())
        return total

    joint = quality.marginals(score, lines, pull, each)[1]
    for i in (0, 1):
        for j in (0, 1):
            step = np.zeros((2, 2))
            step[i, j] = 1e-5
            assert abs((partition(pull + step) - partition(pull - step)) / 2e-5 - joint[i, j]) < 1e-6


def test_chain_against_one_by_hand():
    """Scores of a fitted chain, word by word in Python, and out-of-fold inputs from models that never saw the row."""
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "awful", "grim"]) for _ in range(rng.randrange(3, 12))) for _ in range(120)]
    y = [np.array([float("awful" in t) for t in texts]), np.array([float("awful" in t and "grim" in t) for t in texts])]
    bags = [np.unique(toxicity.traits(kernel.Words(*kernel.utf8(pa.array([t]))))[1]) for t in texts]
    sizes = np.array([len(t.split()) for t in texts], float)
    chain = toxicity.Chain()
    fitted = toxicity.fit_chain(bags, sizes, y, chain)
    assert fitted.names == ["unfit", "toxic"] and len(fitted.weights[1]) == len(fitted.words[1]) + 3  # words, size, earlier, constant
    p = []
    for words, w in zip(fitted.words, fitted.weights, strict=True):
        rows = []
        for k, (bag, n) in enumerate(zip(bags, sizes, strict=True)):
            z = w[-1] + w[len(words)] * np.log1p(n) / 8 + sum(w[np.searchsorted(words, h)] for h in bag if h in words)
            z += sum(w[len(words) + 1 + j] * q[k] for j, q in enumerate(p))
            rows.append(1 / (1 + np.exp(-z)))
        p.append(np.array(rows))
    assert np.mean((p[0] >= 0.5) == y[0]) > 0.95 and np.mean((p[1] >= 0.5) == y[1]) > 0.9
    one = kernel.utf8(pa.array(texts))
    want = [list(x) for x in zip(*p, strict=True)]
    assert toxicity.probabilities(fitted, kernel.Words(*one), len(texts)) == [pytest.approx([x[k] for x in want], abs=1e-9) for k in range(2)]


def test_trained_operators(spark):
    rng = random.Random(6)
    good = [". ".join(say(rng, 8).capitalize() for _ in range(3)) + ".\n" + say(rng, 9).capitalize() + "." for _ in range(120)]
    bad = ["\n".join("BUY!! " * rng.randrange(3, 9) for _ in range(3)) for _ in range(60)]
    texts = good + bad + [None, ""]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 120), int(i % 5 == 0)) for i in range(180)], "doc_id long, quality int, toxic int")
    df = df.selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 AND text <> '' THEN concat(text, ' awfulword') ELSE text END AS text", "lang", "source", "n_chars", "'z' AS score")
    scored = {r.doc_id: r for r in quality.score_quality(df, quality.train_quality(df, labels)).collect()}
    assert np.mean([scored[i].predicted == int(i < 120) for i in range(180)]) > 0.97
    assert all(0 <= r.score <= 1 for r in scored.values()) and len(scored) == 182
    tox = {r.doc_id: r.p_toxic for r in toxicity.score_toxicity(df, toxicity.train_chain(df, labels)).collect()}
    assert np.mean([(tox[i] >= 0.5) == (i % 5 == 0) for i in range(180)]) > 0.97 and len(tox) == 182
    empty = labels.limit(0)
    assert {r.score for r in quality.score_quality(df, quality.train_quality(df, empty)).collect()} == {0.5}
    assert {r.p_toxic for r in toxicity.score_toxicity(df, toxicity.train_chain(df, empty)).collect()} == {0.5}
