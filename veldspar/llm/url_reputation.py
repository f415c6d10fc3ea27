"""URL filter: longest-match rules, and empirical-Bayes host reputation for the rest.

Native throughout: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Rules of the query: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of more than one label under which names are registered.
MULTI_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MIN_GOOD, Z = 0.5, 1.2815515655446004
MIN_RHO, MAX_RHO = 0.001, 0.999


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL_PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Last label without the port, or a known suffix of two labels."""
    bare = F.regexp_replace(host, r":\d*$", "")
    multi = F.array(*[F.lit(s) for s in MULTI_LABEL_SUFFIXES])
    two = F.substring_index(bare, ".", -2)
    return F.when(F.array_contains(multi, two), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label before it."""
    bare = F.regexp_replace(host, r":\d*$", "")
    return F.call_function("substring_index", bare, F.lit("."), -(F.size(F.split(suffix, r"\.")) + 1))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, of, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> float:
    """Prior strength of one level by moments of the beta-binomial; ``groups``: g, n and the parents' pg, pn."""
    m = F.col("pg") / F.col("pn")
    spread = F.col("n") * F.pow(F.col("g") / F.col("n") - m, F.lit(2)) / (m * (1 - m))
    x = groups.where("pg > 0 and pg < pn").agg(F.sum(spread).alias("s"), F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("d")).first()
    rho = (x.s - x.k) / x.d if x.d else MAX_RHO
    return 1 / min(max(rho, MIN_RHO), MAX_RHO) - 1


def reputation(hosts: DataFrame, outcomes: DataFrame, min_good: float = MIN_GOOD, z: float = Z) -> DataFrame:
    """(host, n_outcomes, mean, bound, verdict) for every row of ``hosts`` (host, distinct).

    ``outcomes`` holds (host, g, n): good and all labelled outcomes. A host's posterior is
    beta, its prior centred on the posterior mean of its registered domain, whose own prior
    is centred on its suffix, and that on the overall rate; the strength of each prior is
    the moment estimate for its level. Verdict: allow if the lower posterior bound (normal,
    ``z`` deviations) is at least ``min_good``. Without any outcome the overall rate is 0.5.
    """
    keyed = outcomes.where("n > 0").withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    by_host = keyed.groupBy("host", "domain", "suffix").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    total = by_suffix.agg(F.sum("g").alias("g"), F.sum("n").alias("n")).first()
    g, n = (total.g, total.n) if total.n else (1, 2)
    # three numbers, one for each level, come to the driver
    s_suffix = _strength(by_suffix.withColumn("pg", F.lit(g)).withColumn("pn", F.lit(n)))
    s_domain = _strength(by_domain.join(by_suffix.select("suffix", F.col("g").alias("pg"), F.col("n").alias("pn")), "suffix"))
    s_host = _strength(by_host.join(by_domain.select("domain", "suffix", F.col("g").alias("pg"), F.col("n").alias("pn")), ["domain", "suffix"]))

    def mean(g: Column, n: Column, prior: Column, s: float) -> Column:
        return (F.coalesce(g, F.lit(0)) + F.lit(s) * prior) / (F.coalesce(n, F.lit(0)) + F.lit(s))

    keyed = hosts.select("host").withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    with_host = keyed.join(by_host.select("host", F.col("g").alias("hg"), F.col("n").alias("hn")), "host", "left")
    with_domain = with_host.join(by_domain.select("domain", "suffix", F.col("g").alias("dg"), F.col("n").alias("dn")), ["domain", "suffix"], "left")
    all_levels = with_domain.join(by_suffix.select("suffix", F.col("g").alias("sg"), F.col("n").alias("sn")), "suffix", "left")
    on_suffix = mean(F.col("sg"), F.col("sn"), F.lit(g / n), s_suffix)
    on_domain = mean(F.col("dg"), F.col("dn"), on_suffix, s_domain)
    scored = all_levels.withColumn("n_outcomes", F.coalesce("hn", F.lit(0)).cast("long")).withColumn("mean", mean(F.col("hg"), F.col("hn"), on_domain, s_host))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n_outcomes") + F.lit(s_host + 1)))
    scored = scored.withColumn("bound", F.col("mean") - F.lit(z) * deviation)
    return scored.select("host", "n_outcomes", "mean", "bound", F.when(F.col("bound") >= min_good, "allow").otherwise("block").alias("verdict"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mean, bound): one row for each row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    wins. Where none fits, the host's reputation decides. Null urls, and urls without
    ``://``, have an empty host and path and are judged as that host. Repeated rows come
    back repeated; an empty table gives an empty result.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = reputation(parts.select("host").distinct(), outcomes).select("host", "mean", "bound", F.col("verdict").alias("_method"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    return parts.join(known, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.col("_method")).alias("verdict"), "mean", "bound")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, g, n) from labels: a page's url ends in the id of its document.

    A labelled page is good if its quality is 1 and it isn't toxic. Pages are counted for
    each host and document first, so no hot host or document is joined row by row.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    counted = pages.select(host_of(F.col("url")).alias("host"), number.try_cast("bigint").alias("doc_id")).where("doc_id is not null").groupBy("host", "doc_id").agg(F.count("*").alias("pages"))
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("long")).alias("good"))
    return counted.join(judged, "doc_id").groupBy("host").agg(F.sum(F.col("good") * F.col("pages")).alias("g"), F.sum("pages").alias("n"))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``; outcomes from ``labels``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))
    return found.select("page_id", "host", "path", "rule", "verdict")


_LEVEL = """SELECT coalesce(1.0 / least(greatest((sum(n * power(g / n - pg / pn, 2) / ((pg / pn) * (1 - pg / pn))) - count(*)) / nullif(sum(n - 1), 0), 0.001), 0.999) - 1,
  1.0 / 0.999 - 1) FROM ({}) WHERE pg > 0 AND pg < pn"""

OP10_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
keyed AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM parts),
suffixed AS (
  SELECT page_id, host, path, bare, CASE WHEN array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') IN ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'org.uk')
    THEN array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') ELSE string_split(bare, '.')[-1] END AS suffix FROM keyed),
named AS (
  SELECT page_id, host, path, suffix, array_to_string(list_slice(string_split(bare, '.'), -(len(string_split(suffix, '.')) + 1), -1), '.') AS domain,
    TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[a-z]+)?/?$', 1) AS BIGINT) AS doc_id FROM suffixed),
judged AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
by_host AS (SELECT host, domain, suffix, CAST(sum(good) AS DOUBLE) AS g, CAST(count(*) AS DOUBLE) AS n FROM named JOIN judged USING (doc_id) GROUP BY host, domain, suffix),
by_domain AS (SELECT domain, suffix, sum(g) AS g, sum(n) AS n FROM by_host GROUP BY domain, suffix),
by_suffix AS (SELECT suffix, sum(g) AS g, sum(n) AS n FROM by_domain GROUP BY suffix),
overall AS (SELECT coalesce(sum(g), 1.0) AS g, coalesce(sum(n), 2.0) AS n FROM by_suffix),
strength AS (SELECT
  ({_LEVEL.format("SELECT s.g, s.n, o.g AS pg, o.n AS pn FROM by_suffix s, overall o")}) AS s_suffix,
  ({_LEVEL.format("SELECT d.g, d.n, s.g AS pg, s.n AS pn FROM by_domain d JOIN by_suffix s USING (suffix)")}) AS s_domain,
  ({_LEVEL.format("SELECT h.g, h.n, d.g AS pg, d.n AS pn FROM by_host h JOIN by_domain d USING (domain, suffix)")}) AS s_host),
hosts AS (SELECT DISTINCT host, domain, suffix FROM named),
suffix_mean AS (SELECT h.*, (coalesce(s.g, 0) + t.s_suffix * (o.g / o.n)) / (coalesce(s.n, 0) + t.s_suffix) AS m FROM hosts h LEFT JOIN by_suffix s USING (suffix), overall o, strength t),
domain_mean AS (SELECT h.host, h.domain, h.suffix, (coalesce(d.g, 0) + t.s_domain * h.m) / (coalesce(d.n, 0) + t.s_domain) AS m FROM suffix_mean h LEFT JOIN by_domain d USING (domain, suffix), strength t),
host_mean AS (SELECT h.host, coalesce(b.n, 0) AS n, (coalesce(b.g, 0) + t.s_host * h.m) / (coalesce(b.n, 0) + t.s_host) AS m FROM domain_mean h LEFT JOIN by_host b USING (host), strength t),
method AS (SELECT host, CASE WHEN m - {Z} * sqrt(m * (1 - m) / (n + t.s_host + 1)) >= {MIN_GOOD} THEN 'allow' ELSE 'block' END AS said FROM host_mean, strength t),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE said END AS verdict
FROM ruled JOIN method USING (host)
"""
