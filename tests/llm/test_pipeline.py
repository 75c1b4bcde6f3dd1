"""The whole pipeline against a brute-force model of each stage on a small fixture."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from quietcount.llm import kernel, line_dedup, minhash_dedup, pieces, quality


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t))


def good_by_hand(model, text):
    """Marginals by listing every labelling of the lines."""
    lines, size, f = quality.line_shapes(*kernel.utf8(pa.array([text])), model.common)
    e = quality.with_neighbours(np.clip((f - model.mean) / model.scale, -6, 6), lines) @ model.weights[:-1] + model.weights[-1]
    p, total = np.zeros(len(e)), 0.0
    for y in itertools.product((0, 1), repeat=len(e)):
        v = np.exp(sum(e[i] for i in range(len(y)) if y[i]) + sum(model.pull[a, b] for a, b in itertools.pairwise(y)) - np.maximum(e, 0).sum())
        total += v
        p += v * np.array(y)
    share = np.clip((p / total * (size + 1)).sum() / (size + 1).sum(), 1e-4, 1 - 1e-4)
    return 1 / (1 + np.exp(-(model.curve[0] * np.log(share / (1 - share)) + model.curve[1])))


def without_boilerplate(rows):
    p, where = line_dedup.Spread(), {}
    for d, t, s in sorted(rows):
        for at, line in enumerate(t.split("\n")):
            if len(line.strip(" ")) >= p.min_chars:
                where.setdefault(line.strip(" "), []).append((d, at, s))
    gone = {x[:2] for at in where.values() if len({s for *_, s in at}) >= p.min_sites for x in sorted(at)[1:]}
    return [(d, "\n".join(x for at, x in enumerate(t.split("\n")) if (d, at) not in gone)) for d, t, _ in rows]


def one_of_each_class(rows):
    m, texts = minhash_dedup.MinHash(), [t for _, t in rows]
    off, data = kernel.utf8(pa.array(texts))
    df = np.zeros(m.buckets, int)
    np.add.at(df, (minhash_dedup.shingles(off, data, m.shingle)[1] & np.uint64(m.buckets - 1)).astype(int), 1)
    b, h, w = minhash_dedup.Weigher(minhash_dedup.idf_table(df, df.mean(), len(texts), m), m).weighted(off, data)
    sets = [dict(zip(h[x:y].tolist(), w[x:y].tolist(), strict=True)) for x, y in itertools.pairwise(b)]
    comp = list(range(len(rows)))
    linked = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = sum(min(v, sets[j].get(k, 0)) for k, v in sets[i].items())
        if texts[i] == texts[j] or (both and both >= m.threshold * (sum(sets[i].values()) + sum(sets[j].values()) - both)):
            linked.append((i, j))
    for _ in rows:
        for i, j in linked:
            comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for k, (d, _) in enumerate(rows):
        least[comp[k]] = min(d, least.get(comp[k], d))
    return [r for k, r in enumerate(rows) if least[comp[k]] == r[0]]


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    sentence = lambda n: say(n).capitalize() + "."
    items = [(1, say(30)), (2, say(12)), (3, None)]
    shared = "This line stands on all of the sites."
    texts = []
    for i in range(90):
        t = [sentence(30), sentence(25), sentence(28)]
        if i % 5 == 0:
            t.insert(i % 3, shared)
        if i % 17 == 3:
            t.append("Then " + " ".join(items[i % 2][1].split(" ")[:11]) + ".")
        texts.append("\n".join(t))
    for i in range(0, 30, 3):
        w = texts[i].split(" ")
        w[40] = "changed"
        texts += [texts[i + 1], " ".join(w)]
    texts += ["\n".join("BUY!! NOW $$$ " * rng.randrange(2, 7) for _ in range(3)) for _ in range(40)]
    bad = {i for i, t in enumerate(texts) if "BUY" in t}
    rows = [(i, t, "en", f"src{i % 9}", len(t)) for i, t in enumerate(texts)]
    sf_dir = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")

    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    model = quality.train_quality(read("documents"), read("labels"))
    kept = [(d, t, s) for d, t, _, s, _ in rows if good_by_hand(model, t) >= 0.5]
    assert {d for d, *_ in kept} == set(range(len(texts))) - bad
    left = one_of_each_class(without_boilerplate(kept))
    assert 90 <= len(left) < len(kept) - 10
    windows = {tuple(w[k : k + 10]) for _, t in items if t for w in [words_of(t)] for k in range(len(w) - 9)}
    clean = {d: t for d, t in left if not any(tuple(words_of(t)[k : k + 10]) in windows for k in range(len(words_of(t))))}
    assert 3 < len(left) - len(clean) < 8

    got = pieces.decode(corpus_pipeline.run(spark, sf_dir)).collect()
    assert {r.doc_id: r.text for r in got} == clean and len(got) == len(clean)
    assert all(r.decoded == r.text and r.n_pieces == len(r.pieces) and r.n_chars == len(r.text) for r in got)
