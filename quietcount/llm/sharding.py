"""Sharding by a k-d tree over metadata. Native: DataFrame functions only.

Each node is split at a weighted median (weight: bytes) along the dimension in which its rows spread widest, until there
are as many leaves as shards, or until a leaf holds ``target_bytes``. Medians are found by histograms: all nodes of a
level share one aggregation of ``BINS`` bins a node, a window over a node's bins picks the one that holds its median, and that
bin is refined until it is one value; rows that tie there are split further by a unique row number, so a value of any
weight can be cut anywhere.

Nodes, bins and cuts are tables; the driver sees counts of nodes only. A level reads a narrow table of row number, weight and
dimensions, which is written anew with the rows' nodes at its end, so no level repeats an earlier one's joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.llm.kernel import others, quoted, stored

BINS = 1024
#: node tables of so many rows at most are broadcast; larger ones are joined by a shuffle
SMALL = 50_000


def _code(name: str) -> Column:
    """A label's place on the unit line; null is 0."""
    return F.coalesce((F.xxhash64(F.col(name)).cast("double") / F.lit(2.0**64)) + 0.5, F.lit(0.0)) if name else F.lit(0.0)


def kd_shards(rows: DataFrame, dims: dict, size: str, shards: int | None = None, target_bytes: int | None = None, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All columns of ``rows`` with ``shard`` (0 on) and ``slot`` (0 on without a gap, in each shard).

    ``dims`` maps dimension names to double columns; nulls and NaN count as 0. ``size`` is a positive long; null counts as 0.
    Either ``shards`` is given or it follows from ``target_bytes``. Shards differ by about a row's size at each split above
    them. Rows of equal value are cut by row number, so equal texts may part; repeated rows are rows of their own. An
    empty table gives an empty result; columns called like ``shard`` or ``slot``, in any case, are replaced.
    """
    plain = others(rows.columns, [shard, slot])
    place = lambda c: F.when(F.isnan(c.cast("double")), 0.0).otherwise(F.coalesce(c.cast("double"), F.lit(0.0)))
    base = stored(rows.select(*[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(plain)], F.coalesce(F.col(quoted(size)).cast("long"), F.lit(0).cast("long")).alias("_w"), F.array(*[place(c) for c in dims.values()]).alias("_d"), F.monotonically_increasing_id().alias("_uid")))
    spans = range(len(dims))
    d = lambda k: F.col("_d")[k]
    whole = base.agg(F.sum("_w").alias("w"), F.count("*").alias("n"), *[(F.max(d(k)) - F.min(d(k))).alias(f"r{k}") for k in spans]).first()
    if shards is None:
        shards = max(1, math.ceil((whole["w"] or 0) / target_bytes))
    reach = [max(whole[f"r{k}"] or 0.0, 1e-300) for k in spans]
    # the node is a column of the written table: a literal would fold away the joins on it
    tree = stored(base.select("_uid", "_w", "_d", F.lit(0).cast("long").alias("_node")))
    nodes = stored(base.sparkSession.range(1).select(F.lit(0).cast("long").alias("_node"), F.lit(0).alias("_first"), F.lit(shards).alias("_k")))
    for level in range(max(0, (shards - 1).bit_length())):
        many = 1 << level
        cuts = _cuts(tree, nodes.where("_k > 1"), reach, many)
        value = F.element_at("_d", F.col("_dim") + 1)
        right = (value > F.col("_v")) | ((value == F.col("_v")) & (F.col("_uid") > F.col("_u")))
        child = F.col("_node") * 2 + F.when(F.col("_dim").isNotNull() & right, 1).otherwise(0)
        tree = stored(tree.join(_small(cuts, many), "_node", "left").select("_uid", "_w", "_d", child.alias("_node")))
        half = F.floor(F.col("_k") / 2).cast("int")
        below = F.when(F.col("_k") > 1, F.array(F.struct((F.col("_node") * 2).alias("_node"), F.col("_first"), half.alias("_k")), F.struct((F.col("_node") * 2 + 1).alias("_node"), (F.col("_first") + half).alias("_first"), (F.col("_k") - half).alias("_k"))))
        below = below.otherwise(F.array(F.struct((F.col("_node") * 2).alias("_node"), F.col("_first"), F.col("_k"))))
        nodes = stored(nodes.select(F.explode(below).alias("x")).select("x.*"))
    placed = tree.join(_small(nodes.select("_node", F.col("_first").alias("_shard")), 1 << max(0, (shards - 1).bit_length())), "_node").select("_uid", "_shard", F.shiftright("_uid", 33).alias("_part"))
    counts = placed.groupBy("_shard", "_part").agg(F.count("*").alias("_n"))  # a row for each shard and input partition
    start = stored(counts.select("_shard", "_part", (F.sum("_n").over(Window.partitionBy("_shard").orderBy("_part")) - F.col("_n")).alias("_start")))
    rank = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy("_uid"))
    slots = placed.withColumn("_place", rank).join(start, ["_shard", "_part"]).select("_uid", F.col("_shard").cast("int").alias("_shard"), (F.col("_start") + F.col("_place") - 1).cast("long").alias("_slot"))
    return base.join(slots, "_uid").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(plain)], F.col("_shard").alias(shard), F.col("_slot").alias(slot))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` rows, broadcast where that is few."""
    return F.broadcast(table) if rows <= SMALL else table


def _cuts(tree: DataFrame, nodes: DataFrame, reach: list[float], many: int) -> DataFrame:
    """(_node, _dim, _v, _u): dimension, value and row number up to which rows of each of ``nodes``, ``many`` at most, go left."""
    spans = range(len(reach))
    low, high = (lambda k: F.col(f"l{k}")), (lambda k: F.col(f"h{k}"))
    stats = tree.groupBy("_node").agg(F.sum("_w").alias("w"), F.count("*").alias("n"), F.max("_uid").alias("u"), *[F.min(F.col("_d")[k]).alias(f"l{k}") for k in spans], *[F.max(F.col("_d")[k]).alias(f"h{k}") for k in spans])
    # the widest dimension, of equally wide ones the first
    wide = F.array_max(F.array(*[F.struct(((high(k) - low(k)) / F.lit(reach[k])).alias("reach"), F.lit(-k).alias("k")) for k in spans]))["k"] * -1
    of = lambda side: F.element_at(F.array(*[side(k) for k in spans]), F.col("_dim") + 1)
    state = stats.join(_small(nodes, many), "_node").withColumn("_dim", wide)
    lone = F.col("n") < 2
    state = stored(state.select("_node", "_dim", F.lit("v").alias("_by"), F.when(lone, float("inf")).otherwise(0.0).alias("_v"), F.when(lone, F.col("u")).alias("_u"), of(low).alias("_lo"), of(high).alias("_hi"), (F.col("w") * F.floor(F.col("_k") / 2) / F.col("_k")).alias("_need")))
    while state.where("_u IS NULL").limit(1).count():
        value = F.element_at("_d", F.col("_dim") + 1)
        seen = tree.join(_small(state.where("_u IS NULL").drop("_u"), many), "_node").withColumn("_x", F.when(F.col("_by") == "v", value).otherwise(F.col("_uid").cast("double")))
        seen = seen.where(F.col("_x").between(F.col("_lo"), F.col("_hi")) & ((F.col("_by") == "v") | (value == F.col("_v"))))
        spot = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)).otherwise(0)
        bins = seen.groupBy("_node", F.least(spot, F.lit(BINS - 1)).alias("_bin")).agg(
            F.sum("_w").alias("w"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.min("_uid").alias("u1"), F.max("_uid").alias("u2"),
            *[F.any_value(c).alias(c) for c in ("_dim", "_by", "_v", "_need")],
        )
        run, back = Window.partitionBy("_node").orderBy("_bin"), Window.partitionBy("_node").orderBy(F.desc("_bin"))
        bins = bins.withColumns({"upto": F.sum("w").over(run), "last": F.row_number().over(back) == 1}).where((F.col("upto") >= F.col("_need")) | F.col("last"))
        bins = bins.withColumn("first", F.row_number().over(run)).where("first = 1").withColumn("_need", F.col("_need") - F.col("upto") + F.col("w"))
        tied, one = F.col("lo") == F.col("hi"), F.col("u1") == F.col("u2")
        # one row goes to the side that it leaves nearer to its share
        up = F.when(one, F.when(F.col("_need") * 2 >= F.col("w"), F.col("u1")).otherwise(F.col("u1") - 1))
        by_row = tied & (F.col("_by") == "v") & ~one  # one value of several rows: cut between those
        step = bins.select(
            "_node", "_dim", F.when(by_row, "u").otherwise(F.col("_by")).alias("_by"), F.when((F.col("_by") == "v") & tied, F.col("lo")).otherwise(F.col("_v")).alias("_v"), up.alias("_u"),
            F.when(by_row, F.col("u1").cast("double")).otherwise(F.col("lo")).alias("_lo"), F.when(by_row, F.col("u2").cast("double")).otherwise(F.col("hi")).alias("_hi"), "_need",
        )
        state = stored(step.unionByName(state.where("_u IS NOT NULL")))
    return state.select("_node", "_dim", "_v", "_u")


def document_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _code("lang").alias("lang_at"), _code("source").alias("source_at"))


def shard_documents(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, lang_at, source_at, shard, slot) of every document: law ``bytes``. Equal texts may part.

    A null text has no bytes, size 1, and the checksum of the empty text; a null id, lang or source lies at 0 of its
    dimension. Of a long text only its size counts. Ties, repeated rows and empty tables as in ``kd_shards``.
    """
    rows = document_rows(docs)
    dims = {"doc_id": F.col("doc_id"), "size": F.log2(F.col("size")), "lang": F.col("lang_at"), "source": F.col("source_at")}
    return kd_shards(rows, dims, "size", shards, target_bytes)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL: dict[str, str] = {}
