"""URL filters by empirical-Bayes host reputation. Native: DataFrame functions only.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Each level's rate is shrunk
towards the posterior mean of the level above it through a beta-binomial prior whose strength (the intra-level
correlation) is estimated from all labelled pages by the method of moments. A host is blocked when the lower bound of
its posterior bad rate is above ``max_bad``. Explicit rules come first; the longest one that fits wins.

Only one row of sums for each of the three levels ever reaches the driver. Counts are pre-aggregated on both sides of
the shuffle. The hosts' reputation is checkpointed before it is joined back to pages: that join has a stage of its own,
where adaptive execution splits a hot host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietcount.llm.kernel import cut, others, quoted

#: The contract's rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Second-level labels under which names are registered, where the last label is a country's.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    max_bad: float = 0.5
    z: float = 1.6448536269514722
    least_rho: float = 1e-3
    most_rho: float = 0.999


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where a country's second level is open to registration."""
    two = F.substring_index(host, ".", -2)
    pair = (F.length(F.substring_index(host, ".", -1)) == 2) & F.substring_index(two, ".", 1).isin(*SECOND_LEVEL) & (two != host)
    return F.when(pair, two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more. A numeric address is its own domain."""
    labels = F.size(F.split(suffix_of(host), r"\."))
    return (
        F.when(host.rlike(r"^[0-9.]+(:[0-9]+)?$"), host)
        .when(labels == 2, F.substring_index(host, ".", -3))
        .otherwise(F.substring_index(host, ".", -2))
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits. Of equally long ones the first given wins."""
    rule = verdict = F.lit(None).cast("string")
    for said, name, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _strength(stats: DataFrame, params: Reputation) -> float:
    """Prior strength of a level from (n, bad, m): m is the mean above it. One row of sums is collected."""
    v = F.col("m") * (1 - F.col("m"))
    row = stats.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("m"), 2) - F.col("n") * v).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * v).alias("pairs"),
    ).first()
    rho = (row["over"] or 0.0) / row["pairs"] if row["pairs"] else params.least_rho
    rho = min(max(rho, params.least_rho), params.most_rho)
    return 1.0 / rho - 1.0


def host_reputation(hosts: DataFrame, labelled: DataFrame, params: Reputation = Reputation()) -> DataFrame:
    """Posterior of every distinct ``host`` of ``hosts``: bad_rate, bad_bound, n_labelled.

    ``labelled`` has (host, bad boolean); rows with a null count for nothing. A host that was never labelled gets the
    posterior of its domain, else of its suffix, else the overall rate. Without any labels the rate is one half and
    nothing can be blocked at the default threshold.
    """
    seen = labelled.where(F.col("host").isNotNull() & F.col("bad").isNotNull())
    seen = cut(seen.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")))
    levels = seen.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    total = seen.agg(F.sum("n"), F.sum("bad")).first()
    m0 = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    post = lambda k: (F.lit(k) * F.col("m") + F.col("bad")) / (F.lit(k) + F.col("n"))
    suffix = levels.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("m", F.lit(m0))
    k1 = _strength(suffix, params)
    suffix = cut(suffix.select("suffix", post(k1).alias("m")))
    domain = levels.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(suffix, "suffix")
    k2 = _strength(domain, params)
    domain = cut(domain.select("domain", post(k2).alias("m")))
    host = levels.join(domain, "domain")
    k3 = _strength(host, params)
    every = hosts.select("host").distinct().withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    every = every.join(suffix.withColumnRenamed("m", "m_s"), "suffix", "left").join(domain.withColumnRenamed("m", "m_d"), "domain", "left").join(seen, "host", "left")
    every = every.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("m_d", "m_s", F.lit(m0)).alias("m"))
    mean, strength = post(k3), F.lit(k3) + F.col("n")
    return every.select(
        "host", mean.alias("bad_rate"), (mean - F.lit(params.z) * F.sqrt(mean * (1 - mean) / (strength + 1))).alias("bad_bound"), F.col("n").alias("n_labelled")
    )


def filter_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", carry: list[str] | None = None, rules=RULES, params: Reputation = Reputation()) -> DataFrame:
    """``carry`` columns of every row (all by default) and host, path, rule, verdict, bad_rate, bad_bound.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is judged as the host "". A url of any
    length is one row. Repeated rows are judged each for itself; of equally long rules that fit the first given wins. An
    empty table gives an empty result; without labels nothing is blocked but by rules. Columns named like a new one, in
    any case, are replaced.
    """
    carry = others(pages.columns if carry is None else carry, ["host", "path", "rule", "verdict", "bad_rate", "bad_bound"])
    at = pages.select(*[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(carry)], host_of(F.col(quoted(url))).alias("host"), path_of(F.col(quoted(url))).alias("path"))
    rep = cut(host_reputation(at, labelled, params).drop("n_labelled"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bad_bound") > params.max_bad, "block").otherwise("allow")
    return at.join(rep, "host", "left").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "host", "path", rule.alias("rule"), F.coalesce(said, by_host).alias("verdict"), "bad_rate", "bad_bound")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of the pages whose id has a label: bad means low quality or toxic. A label row without either mark says nothing;
    of several rows for an id one bad one is enough, and the page counts once."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    return pages.select("page_id", host_of(F.col("url")).alias("host")).join(known, "page_id").select("host", "bad")


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_urls(pages, labelled_pages(pages, labels), carry=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


_P = Reputation()


def _sql() -> str:
    suffix = lambda h: f"CASE WHEN len(string_split({h}, '.')) > 2 AND len(string_split({h}, '.')[-1]) = 2 AND string_split({h}, '.')[-2] IN {SECOND_LEVEL} THEN array_to_string(string_split({h}, '.')[-2:], '.') ELSE string_split({h}, '.')[-1] END"
    domain = f"CASE WHEN regexp_full_match(host, '[0-9.]+(:[0-9]+)?') THEN host WHEN contains(suffix, '.') THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END"
    rho = lambda t: f"SELECT 1 / least(greatest(coalesce(sum(pow(bad - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), {_P.least_rho}), {_P.least_rho}), {_P.most_rho}) - 1 AS k FROM {t}"
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    says = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in RULES)
    return f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hs AS (SELECT host, suffix, {domain} AS domain FROM (SELECT DISTINCT host, {suffix('host')} AS suffix FROM p)),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
seen AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM p JOIN known ON page_id = doc_id GROUP BY host),
g AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m0 FROM seen),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m0) AS m FROM seen JOIN hs USING (host), g GROUP BY suffix),
ks AS ({rho('s')}), sp AS (SELECT suffix, (k * m + bad) / (k + n) AS m FROM s, ks),
d AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM seen JOIN hs USING (host) JOIN sp USING (suffix) GROUP BY domain),
kd AS ({rho('d')}), dp AS (SELECT domain, (k * m + bad) / (k + n) AS m FROM d, kd),
h AS (SELECT host, n, bad, m FROM seen JOIN hs USING (host) JOIN dp USING (domain)),
kh AS ({rho('h')}),
a AS (SELECT host, coalesce(n, 0) AS n, (k * coalesce(dp.m, sp.m, m0) + coalesce(bad, 0)) / (k + coalesce(n, 0)) AS r, k
  FROM hs LEFT JOIN sp USING (suffix) LEFT JOIN dp USING (domain) LEFT JOIN seen USING (host), kh, g),
r AS (SELECT page_id, host, path, CASE {fits} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {says} ELSE CASE WHEN r - {_P.z} * sqrt(r * (1 - r) / (k + n + 1)) > {_P.max_bad} THEN 'block' ELSE 'allow' END END AS verdict
FROM r JOIN a USING (host)"""


SQL = {"op3_url_filters": _sql()}
