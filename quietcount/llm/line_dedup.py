"""Line dedup by distinct-site spread. Native: DataFrame functions only.

A line is keyed by two hashes, 128 bits, of its trimmed bytes; the keyed lines are written once. Lines that occur often enough to
reach ``min_sites`` get a HyperLogLog sketch of their sites: one for each salt of a hot line, which then merge by
aggregation, so a line that a third of all rows share is spread over tasks. Lines whose estimate lies near the threshold get an exact distinct count. Lines of enough sites are
boilerplate: their first occurrence (smallest document id, then line number) stays, all others are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietcount.llm.kernel import cut, others, positional, stored

#: a line is hot if it has more than one in so many of all occurrences; each is dealt to so many tasks
HOT_LINES = 2_000
SALTS = 64


@dataclass(frozen=True)
class Spread:
    min_sites: int = 5
    min_chars: int = 20
    lg_k: int = 11
    margin: float = 0.2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, text: str, site: str, doc_id: str, params: Spread) -> DataFrame:
    """(k1, k2, site, doc, at, r1, r2) of every line that is long enough to judge."""
    got = docs.select(F.col(site).alias("site"), F.col(doc_id).alias("doc"), F.xxhash64(doc_id, text).alias("r1"), F.hash(text, doc_id).alias("r2"), F.posexplode(_lines(F.col(text))).alias("at", "line"))
    got = got.withColumn("line", F.trim("line")).where(F.length("line") >= params.min_chars)
    return got.select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("second"), "line").alias("k2"), "site", "doc", "at", "r1", "r2")


def _dealt(lines: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """``lines`` joined with ``table``, a row for each of some lines. The occurrences of hot lines are salted and their row is repeated
    for each salt, so that no task gets more than a share of a line, whatever is aggregated after the join."""
    hot = F.broadcast(hot.select("k1", "k2", F.lit(True).alias("hot")))  # HOT_LINES rows at most
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("r1", "at"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    left = lines.join(hot, ["k1", "k2"], "left").withColumn("salt", salt).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    right = table.join(hot, ["k1", "k2"], "left").withColumn("salt", F.explode(salts)).drop("hot")
    return left.join(right, ["k1", "k2", "salt"])


def _judged(lines: DataFrame, params: Spread) -> tuple[DataFrame, DataFrame]:
    """The lines of at least ``min_sites`` sites, (k1, k2, n_sites, first), and the hot lines."""
    often = lines.groupBy("k1", "k2").agg(F.count("site").alias("n"), F.min(F.struct("doc", "at", "r1", "r2")).alias("first"))
    often = cut(often.where(F.col("n") >= params.min_sites))
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = cut(often.where(F.col("n") > total / HOT_LINES).select("k1", "k2"))  # fewer than HOT_LINES lines can have as many
    site = F.col("site")
    spread = _dealt(lines.where(site.isNotNull()).drop("doc"), often.select("k1", "k2"), hot)
    spread = spread.groupBy("k1", "k2", "salt").agg(F.hll_sketch_agg(site, F.lit(params.lg_k)).alias("sketch"))
    spread = spread.groupBy("k1", "k2").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites"))
    spread = cut(spread.where(F.col("sites") >= params.min_sites * (1 - params.margin)))
    near = F.col("sites") <= params.min_sites * (1 + params.margin)
    exact = _dealt(lines.where(site.isNotNull()).drop("doc"), spread.where(near).select("k1", "k2"), hot)
    exact = exact.select("k1", "k2", "site").distinct().groupBy("k1", "k2").agg(F.count("*").alias("sites")).where(F.col("sites") >= params.min_sites)
    known = often.join(spread.where(~near).unionByName(exact), ["k1", "k2"]).select("k1", "k2", F.col("sites").alias("n_sites"), "first")
    return cut(known), hot


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", params: Spread = Spread()) -> DataFrame:
    """(k1, k2, n_sites, first): the lines of at least ``min_sites`` sites and where each occurs first."""
    docs, column = positional(docs)
    return _judged(stored(_keyed(docs, column[text], column[site], column[doc_id], params)), params)[0]


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", params: Spread = Spread()) -> DataFrame:
    """Every row of ``docs`` with ``text`` less its boilerplate, and n_lines, n_removed (longs).

    Lines are cut at each newline and compared without the blanks around them; shorter ones than ``min_chars`` always
    stay. A null site belongs to no site; a null text has one, empty, line and stays null. Rows that share document id
    and text are one document: they keep, or lose, the same lines; of occurrences in rows that share only the id the one of
    smaller line number, then row hash, is the first, and a null id comes before all others. A text of any length is one
    row. An empty table gives an empty result. Columns called n_lines or n_removed, in any case, are replaced.
    """
    new = ["n_lines", "n_removed"]
    return _less(docs, text, site, doc_id, params, others(docs.columns, new), new)


def clean_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their own columns; ``text`` lost its boilerplate and ``n_chars``, if there is one, follows it.
    Nulls, empty and long texts, ties, repeated rows and empty tables as in ``dedup_lines``."""
    out = _less(docs, "text", "source", "doc_id", Spread(), docs.columns, [])
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def _less(docs: DataFrame, text: str, site: str, doc_id: str, params: Spread, keep: list[str], new: list[str]) -> DataFrame:
    docs, column = positional(docs)
    own_text, site, doc_id = column[text], column[site], column[doc_id]
    lines = stored(_keyed(docs, own_text, site, doc_id, params))
    known, hot = _judged(lines, params)
    own = F.struct("doc", "at", "r1", "r2")
    gone = _dealt(lines.drop("site"), known.select("k1", "k2", "first"), hot).where(~own.eqNullSafe(F.col("first")))
    gone = gone.groupBy("r1", "r2").agg(F.collect_set("at").alias("_gone"))  # one document's lines
    held = docs.select(*[column[c] for c in dict.fromkeys([*keep, text])], F.xxhash64(doc_id, own_text).alias("_r1"), F.hash(own_text, doc_id).alias("_r2"))
    held = held.join(gone.withColumnsRenamed({"r1": "_r1", "r2": "_r2"}), ["_r1", "_r2"], "left")
    split = _lines(F.col(own_text))
    left = F.array_join(F.filter(F.transform(split, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains(F.col("_gone"), s["i"]))["x"], "\n")
    cleaned = F.when(F.col("_gone").isNull(), F.col(own_text)).otherwise(left)
    counts = {"n_lines": F.size(split), "n_removed": F.coalesce(F.size("_gone"), F.lit(0))}
    return held.select(*[(cleaned if c == text else F.col(column[c])).alias(c) for c in keep], *[counts[c].cast("long").alias(c) for c in new])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_P = Spread()
SQL = {
    "op10_line_dedup": f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
b AS (SELECT trim(line, ' ') AS k, min(row(doc_id, pos)) AS first FROM l WHERE length(trim(line, ' ')) >= {_P.min_chars} GROUP BY 1 HAVING count(DISTINCT source) >= {_P.min_sites}),
m AS (SELECT doc_id, pos, line, coalesce(row(doc_id, pos) <> first, false) AS gone FROM l LEFT JOIN b ON trim(line, ' ') = k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
