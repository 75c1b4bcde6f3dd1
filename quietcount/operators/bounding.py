"""Contribution bounding. Arrival order is a total order given by the caller; nothing is kept beyond a user's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietcount.functions.envelope import Features, same_origin, seal, unseal, valid_route
from quietcount.functions.text import clamp, word_key


def bound_records(rows: DataFrame, user: str, order_by: list[str], limit: int, event_level: bool = False) -> DataFrame:
    """The first ``limit`` records of each user. Null users are an error unless ``event_level``: then all of theirs stay."""
    place = F.row_number().over(Window.partitionBy(user).orderBy(*order_by))
    if event_level:
        return rows.where(F.col(user).isNotNull()).withColumn("_n", place).where(F.col("_n") <= limit).drop("_n").unionByName(rows.where(F.col(user).isNull()))
    checked = rows.withColumn(user, F.when(F.col(user).isNull(), F.raise_error(F.lit("a record has no user"))).otherwise(F.col(user)))
    return checked.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")


def bound_weighted(rows: DataFrame, user: str, count: str, order_by: list[str], limit: int) -> DataFrame:
    """Rows with ``accepted`` = min(count, limit - used before); counts of zero or less are dropped without a refund."""
    before = F.coalesce(F.sum(count).over(Window.partitionBy(user).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = rows.where((F.col(count) > 0) & F.col(user).isNotNull())
    return live.withColumn("accepted", F.least(F.col(count), F.lit(limit) - before)).where(F.col("accepted") > 0)


def user_totals(rows: DataFrame, user: str, count: str) -> DataFrame:
    return rows.groupBy(user).agg(F.sum(count).alias("total"))


def bound_estimate(rows: DataFrame, user: str, count: str, percentile: float = 0.99) -> DataFrame:
    """Interpolated percentile, least, most and mean of the users' totals, to choose a limit by."""
    t = user_totals(rows, user, count)
    return t.agg(F.percentile("total", F.lit(percentile)).alias("bound"), F.min("total").alias("least"), F.max("total").alias("most"), F.avg("total").alias("mean"))


def bound_with_counts(rows: DataFrame, user: str, count: str, order_by: list[str], limit: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The accepted rows of ``bound_weighted``, and for each group of ``by`` how many rows were forwarded and dropped."""
    before = F.coalesce(F.sum(F.greatest(F.col(count), F.lit(0))).over(Window.partitionBy(user).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    accepted = F.when((F.col(count) > 0) & F.col(user).isNotNull(), F.greatest(F.lit(0), F.least(F.col(count), F.lit(limit) - before))).otherwise(0)
    judged = rows.withColumn("accepted", accepted)
    went = (F.col("accepted") > 0).cast("long")
    return judged.where("accepted > 0"), judged.groupBy(*by).agg(F.sum(went).alias("forwarded"), F.sum(1 - went).alias("dropped"))


def check_and_clamp(sealed: DataFrame, key, limit: int, clamp_to: float, source: str, here: str, next_: str, order_by: list[str], features: Features = Features()) -> DataFrame:
    """The whole bounding service over sealed (user, word, count) values: verify the route and the common origin, open, bound
    each user, clamp, and seal again for the next component, with the routing key of the word.

    A row that does not verify is dropped, or fails the query, as ``features.isolate`` says.
    """
    from quietcount.functions.envelope import aad, guarded

    parts = [F.col(c) for c in ("user", "word", "count")]
    ok = F.lit(True)
    if features.route:
        for c in parts:
            ok = ok & valid_route(c, source, here)
    if features.replay:
        ok = ok & same_origin(*parts)
    opened = [F.when(ok, unseal(c, key, features.scheme)) for c in parts]
    rows = guarded(sealed, dict(zip(("_user", "_word", "_count"), opened, strict=True)), features)
    bounded = bound_weighted(rows.withColumn("_count", F.col("_count").cast("long")), "_user", "_count", order_by, limit)
    head = aad(F.lit(here), F.lit(next_))
    value = clamp(F.col("accepted").cast("double"), clamp_to)
    kept = [c for c in sealed.columns if c not in ("user", "word", "count")]
    return bounded.select(*kept, seal(F.col("_user"), key, head, features.scheme).alias("user"), seal(F.col("_word"), key, head, features.scheme).alias("word"), seal(value.cast("string"), key, head, features.scheme).alias("count"), word_key(F.col("_word")).alias("routing_key"))
