"""Nulls in any column, empty and very long texts, repeated rows, empty tables, extra columns of clashing names."""

import pytest

import corpus_pipeline
from quietcount.llm import decontamination, embedding_dedup, line_dedup, minhash_dedup, pieces, quality, sharding, suffix_dedup, toxicity, url_filters

EXTRA = (
    "a.b", "n_words", "n_hit", "hit_spans", "score", "predicted", "pieces", "n_pieces", "shard", "slot", "host", "rule", "n_lines", "n_removed", "kept", "k1", "k2", "num", "line", "at",
    "doc", "first", "bag", "size", "p_toxic", "class_id", "rep", "n", "band", "site", "sites", "_gone", "i", "key", "r1", "bad", "n_bytes", "label", "v", "component_id", "component", "decoded", "t",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def odd(spark, empty=False, upper=False):
    long = "one very long text of few words " * 36_000  # over a slice of 1 MB
    line = "a line that stands on all of the sites\n"
    rows = [(1, "some text", "en", "s", 9), (1, "some text", "en", "s", 9), (1, "another text", None, None, None), (None, "some text", None, "s", None), (None, None, None, None, None)]
    rows += [(2, None, "en", "s", 0), (3, "", "en", None, 0), (4, "\n\n \n", "", "", 4), (5, long, "en", "s", len(long)), (6, "é" * 70_000, "fr", "t", None), (-7, "x y z", "en", "t", 5)]
    rows += [(10 + i, line + f"and then text number {i}", "en", f"s{i}", None) for i in range(6)] + [(None, line, "en", "s1", None)]
    out = spark.createDataFrame([] if empty else [(*r, *[("x" if k % 2 else None) for k in range(len(EXTRA))]) for r in rows], SCHEMA)
    return out.toDF(*out.columns[:5], *[c.upper() for c in out.columns[5:]]) if upper else out


def labels(spark, empty=False):
    rows = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (3, 0, None), (5, 1, 0), (6, 0, 1)]
    return spark.createDataFrame([] if empty else rows, "doc_id long, quality int, toxic int")


def benchmark(spark, empty=False):
    rows = [(1, "and then text number 3"), (1, None), (None, "x y z"), (2, ""), (3, "?!")]
    return spark.createDataFrame([] if empty else rows, "item_id long, text string")


OPERATORS = {
    "decontamination": lambda s, d, e: decontamination.match_benchmark(d, benchmark(s, e)),
    "suffix": lambda s, d, e: suffix_dedup.remove_repeats(d),
    "pieces": lambda s, d, e: pieces.decode(pieces.encode(d)),
    "toxicity": lambda s, d, e: toxicity.score_toxicity(d, toxicity.train_chain(d, labels(s, e))),
    "minhash": lambda s, d, e: minhash_dedup.near_duplicates(d),
    "quality": lambda s, d, e: quality.score_quality(d, quality.train_quality(d, labels(s, e))),
    "sharding": lambda s, d, e: sharding.shard_documents(d),
    "lines": lambda s, d, e: line_dedup.dedup_lines(d),
    "urls": lambda s, d, e: url_filters.filter_urls(d, s.createDataFrame([] if e else [("h", True), (None, False), ("h", None)], "host string, bad boolean"), url="text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_are_all_answered(spark, name):
    d = odd(spark)
    rows = OPERATORS[name](spark, d, False).collect()
    assert len(rows) == d.count()
    if name not in ("minhash", "sharding"):
        assert len(set(rows[0].asDict())) == len(rows[0]) and "a.b" in rows[0].asDict()  # other columns stay, none twice
    same = sorted([str(r) for r in rows if r.doc_id == 1 and "another" not in str(r)])
    if name not in ("minhash", "sharding"):
        assert len(same) == 2 and same[0] == same[1]  # repeated rows get one result


@pytest.mark.parametrize("name", OPERATORS)
def test_names_that_clash_in_another_case(spark, name):
    d = odd(spark, upper=True).where("doc_id IS NULL OR doc_id <> 5")
    out = OPERATORS[name](spark, d, False)
    assert out.count() == d.count() and len({c.lower() for c in out.columns}) == len(out.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, odd(spark, True), True).count() == 0
    assert OPERATORS[name](spark, odd(spark), True).count() == odd(spark).count()


def test_embeddings_empty_ties_and_extra_columns(spark):
    schema = "vec_id long, embedding array<float>, label int, a long, b long, list int, `x.y` string, v int, n_links int"
    assert embedding_dedup.link_vectors(spark.createDataFrame([], schema)).count() == 0
    rest = (None, 1, 2, "z", 3, 4)
    rows = [(1, [1.0, 0.0], 1, *rest), (1, [1.0, 0.0], 1, *rest), (2, [2.0, 0.0], 1, *rest), (3, [0.0, 1.0], 1, *rest), (None, [1.0, 0.0], 1, *rest), (4, [1.0, 0.0], None, *rest), (5, [], 1, *rest), (-6, [0.0, 3.0], 1, *rest), (7, [0.0, 3.0, 0.0], 1, *rest)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    want = [(1, 2, 1, True)] * 2 + [(2, 2, 1, False), (3, 1, -6, False), (None, 0, None, False), (4, 0, 4, True), (5, 0, 5, True), (-6, 1, -6, True), (7, 0, 7, True)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, tmp_path, empty):
    sf_dir = str(tmp_path)
    odd(spark, empty).write.parquet(f"{sf_dir}/documents.parquet")
    labels(spark, empty).write.parquet(f"{sf_dir}/labels.parquet")
    benchmark(spark, empty).write.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    assert {"pieces", "n_pieces"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns)
    assert corpus_pipeline.run(spark, sf_dir).count() <= docs.count()
