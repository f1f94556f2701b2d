"""Operator 2, URL filters, with DataFrame functions only.

A rule is (host, path, action). It fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's. Every URL is expanded into host-suffix + path-prefix expressions, of the label counts and path lengths that rules
have; expressions meet rules on the first 32 bits of their SHA-256, then on the whole digest. Of the rules that fit, the longest
wins (ties: block before allow, then the greater string), else the default verdict holds.

While rules are few (counted, at most BROADCAST_RULES) they are broadcast, so a hot host needs no shuffle; else both sides are
dealt by short hash and a salt, with every rule once for each salt, so that a host with a third of all URLs spreads.
A null URL, or one without `://`, has an empty host and path and fits no rule. Repeated rules count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The rules that the query judges by.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BROADCAST_RULES = 100_000
SALTS = 32
#: Stands between host and path in an expression; neither can have it.
BETWEEN = "?"


def split_url(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def _digests(df: DataFrame, expression: Column) -> DataFrame:
    return df.withColumn("digest", F.sha2(expression, 256)).withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))


def url_verdicts(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(key, host, path, rule, verdict), a row for each row of `urls`."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("action")).where("r_host is not null and r_path is not null").distinct()
    forms = rules.agg(F.sort_array(F.collect_set(F.struct(F.size(F.split("r_host", r"\.")).alias("n"), F.length("r_path").alias("m")))).alias("f"), F.count("*").alias("n")).first()
    host, path = split_url(F.col(url))
    out = urls.select(F.col(key), host.alias("host"), path.alias("path"))
    if not forms["n"]:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rules = _digests(rules, F.concat("r_host", F.lit(BETWEEN), "r_path")).select("short", "digest", F.concat("r_host", "r_path").alias("rule"), "action")
    # label counts and path lengths that occur in rules: a few dozen pairs, however many rules there are
    kinds = F.array(*[F.struct(F.lit(x["n"]).alias("n"), F.lit(x["m"]).alias("m")) for x in forms["f"]])
    labels = F.split("host", r"\.")
    fitting = F.filter(kinds, lambda k: (k["n"] <= F.size(labels)) & (k["m"] <= F.length("path")) & (F.col("host") != ""))
    expressions = F.transform(fitting, lambda k: F.concat(F.array_join(F.slice(labels, -k["n"], k["n"]), "."), F.lit(BETWEEN), F.substring(F.col("path"), F.lit(1), k["m"])))
    few = forms["n"] <= broadcast_rules
    salts = 1 if few else SALTS
    rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).withColumnsRenamed({"short": "r_short", "digest": "r_digest", "salt": "r_salt"})
    wide = out.withColumn("row", F.monotonically_increasing_id()).select("*", F.explode_outer(F.array_distinct(expressions)).alias("expression"))
    wide = _digests(wide, F.col("expression")).withColumn("salt", F.pmod("row", F.lit(salts)))
    joined = wide.join(F.broadcast(rules) if few else rules, (F.col("short") == F.col("r_short")) & (F.col("salt") == F.col("r_salt")), "left")
    rank = F.when(F.col("digest") == F.col("r_digest"), F.struct(F.length("rule"), F.col("action") == "block", F.col("rule")))
    # a row's expressions are in one task, so the partial aggregation already leaves one row of them
    best = joined.groupBy("row").agg(*(F.first(c).alias(c) for c in dict.fromkeys([key, "host", "path"])), F.max_by(F.struct("rule", "action"), rank).alias("hit"))
    return best.select(key, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.action"), F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(("host", "path", "action"), r, strict=True))) for r in RULES])))
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, row_number() OVER () AS rn FROM pages
), rules(r_host, r_path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), hits AS (
  SELECT p.page_id, p.host, p.path, p.rn, r.r_host || r.r_path AS rule, r.action,
         row_number() OVER (PARTITION BY p.rn ORDER BY length(r.r_host || r.r_path) DESC NULLS LAST, action DESC, r.r_host || r.r_path DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM hits WHERE k = 1
"""
