"""Sealed values: ChaCha20-Poly1305, AES-256-GCM or none, with routing metadata as authenticated data. Keys come from configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.functions.chacha import chacha_open, chacha_seal

#: Names of the schemes and reserved metadata keys.
SCHEMES = ("CHACHA20_POLY1305", "AES_256_GCM", "NONE")
RESERVED = ("source", "destination")


@dataclass(frozen=True)
class Features:
    """What a service checks, how it seals, and what an error does: isolated, a row that fails is dropped; else the query fails."""

    route: bool = True
    replay: bool = True
    isolate: bool = True
    scheme: str = "AES_256_GCM"

    def __post_init__(self):
        if self.scheme not in SCHEMES:
            raise ValueError(f"no such scheme: {self.scheme}")


def guarded(rows: DataFrame, columns: dict[str, Column], features: Features) -> DataFrame:
    """``rows`` with the columns; a null among them is an error, which drops the row or fails the query."""
    if not features.isolate:
        columns = {k: F.coalesce(c, F.raise_error(F.lit(f"no valid {k.strip('_')}")).cast("string")) for k, c in columns.items()}
        return rows.withColumns(columns)
    return rows.withColumns(columns).dropna(subset=list(columns))


def aad(source: Column, destination: Column, extra: dict[str, Column] | None = None) -> Column:
    """Metadata as JSON with sorted keys. Extra keys may not be null or reserved."""
    extra = extra or {}
    if any(k is None or k in RESERVED for k in extra):
        raise ValueError("metadata keys may not be null or reserved")
    parts = {"source": source, "destination": destination, **extra}
    return F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]))


def parse_aad(data: Column) -> Column:
    return F.from_json(data.cast("string"), "source string, destination string, producer_id string, seq bigint, epoch int")


def seal(plain: Column, key: Column, data: Column, scheme: str = "AES_256_GCM") -> Column:
    """struct<associatedData, nonce, ciphertext>. NONE has a nonce of zeros and the text as it is."""
    if scheme == "NONE":
        return F.struct(data.cast("binary").alias("associatedData"), F.unhex(F.lit("00" * 12)).alias("nonce"), plain.cast("binary").alias("ciphertext"))
    nonce = F.unhex(F.substring(F.replace(F.uuid(), F.lit("-")), 1, 24))
    if scheme == "CHACHA20_POLY1305":
        packed = chacha_seal(plain.cast("binary"), key, nonce, data.cast("binary"))
        return F.struct(data.cast("binary").alias("associatedData"), F.substring(packed, 1, 12).alias("nonce"), F.substring(packed, 13, 1 << 30).alias("ciphertext"))
    if scheme != "AES_256_GCM":
        raise ValueError(f"no such scheme: {scheme}")
    packed = F.aes_encrypt(plain.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), nonce, data)
    return F.struct(data.cast("binary").alias("associatedData"), F.substring(packed, 1, 12).alias("nonce"), F.substring(packed, 13, 1 << 30).alias("ciphertext"))


def unseal(sealed: Column, key: Column, scheme: str = "AES_256_GCM") -> Column:
    """The text, or null if key, metadata or text do not match."""
    if scheme == "NONE":
        return sealed["ciphertext"].cast("string")
    packed = F.concat(sealed["nonce"], sealed["ciphertext"])
    if scheme == "CHACHA20_POLY1305":
        return chacha_open(packed, key, sealed["associatedData"]).cast("string")
    return F.try_aes_decrypt(packed, key, F.lit("GCM"), F.lit("DEFAULT"), sealed["associatedData"].cast("string")).cast("string")


def valid_route(sealed: Column, source: str, destination: str) -> Column:
    meta = parse_aad(sealed["associatedData"])
    return F.coalesce((F.lower(meta["source"]) == source.lower()) & (F.lower(meta["destination"]) == destination.lower()), F.lit(False))


def same_origin(*sealed: Column) -> Column:
    """All fields of a request carry the same producer and sequence number."""
    metas = [parse_aad(s["associatedData"]) for s in sealed]
    out = F.lit(True)
    for m in metas[1:]:
        out = out & m["producer_id"].eqNullSafe(metas[0]["producer_id"]) & m["seq"].eqNullSafe(metas[0]["seq"])
    return out


def routes(edges: DataFrame, component: str, upstream: bool) -> DataFrame:
    """Neighbours of a component in (src, dst) edges, names compared without case."""
    here, there = ("dst", "src") if upstream else ("src", "dst")
    return edges.where(F.lower(here) == component.lower()).select(F.lower(there).alias("component")).distinct()


def the_route(edges: DataFrame, component: str, upstream: bool) -> str:
    """The one neighbour of a component; none or several are refused."""
    found = sorted(r.component for r in routes(edges, component, upstream).limit(2).collect())
    if len(found) != 1:
        raise ValueError(f"{component} has {'no' if not found else 'more than one'} {'source' if upstream else 'destination'}")
    return found[0]


def topology(spark: SparkSession, links: dict[str, list[str]]) -> DataFrame:
    """(src, dst) edges, lower-cased, of a graph given as component -> components that it sends to."""
    rows = sorted({(s.lower(), d.lower()) for s, targets in links.items() for d in targets})
    return spark.createDataFrame(rows, "src string, dst string")


def adjacency(edges: DataFrame) -> DataFrame:
    """One row: the graph as JSON, {component: [components]}, keys and lists sorted."""
    each = edges.select(F.lower("src").alias("src"), F.lower("dst").alias("dst")).distinct().groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dst"))
    return each.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("src", "dst"))))).alias("graph"))


def write_topology(edges: DataFrame, path: str, key: Column) -> None:
    """The graph as one sealed value: nonce and ciphertext in base64."""
    sealed = adjacency(edges).select(seal(F.col("graph"), key, F.lit("topology")).alias("s"))
    sealed.select(F.regexp_replace(F.base64(F.concat("s.nonce", "s.ciphertext")), r"\s", "").alias("value")).write.mode("overwrite").text(path)


def read_topology(spark: SparkSession, path: str, key: Column) -> DataFrame:
    """(src, dst) edges of a sealed graph; a wrong key gives none."""
    raw = spark.read.text(path).select(F.unbase64("value").alias("p"))
    graph = F.try_aes_decrypt(F.col("p"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("topology")).cast("string")
    pairs = raw.select(F.explode(F.from_json(graph, "map<string,array<string>>")).alias("src", "dst"))
    return pairs.select("src", F.explode("dst").alias("dst"))


def reseal(sealed: DataFrame, columns: list[str], key: Column, source: str, here: str, next_: str, features: Features = Features()) -> DataFrame:
    """A source's preprocessing: verify each column's route, open it, and seal it for the next component."""
    opened = {f"_{c}": F.when(valid_route(F.col(c), source, here) if features.route else F.lit(True), unseal(F.col(c), key, features.scheme)) for c in columns}
    rows, head = guarded(sealed, opened, features), aad(F.lit(here), F.lit(next_))
    return rows.withColumns({c: seal(F.col(f"_{c}"), key, head, features.scheme) for c in columns}).drop(*opened)


def service(apply: Callable[[DataFrame], DataFrame], required: tuple[str, ...] = ()) -> Callable[[DataFrame], DataFrame]:
    """A component's body as DataFrame -> DataFrame, checked: a null in a required column of its answer is an error."""

    def run(rows: DataFrame) -> DataFrame:
        out = apply(rows)
        return out.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null {c} in a response")).cast(out.schema[c].dataType)).otherwise(F.col(c)) for c in required})

    return run
