"""Queries through the plug-in points: provider maps, encoders, patterns, fuzzy scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import plugins as U
from listingspark.plans.catalog import query
from listingspark.sources import files as S
from listingspark.tables import table


@query("provider_map_plugin", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider, 'V' || p_partkey AS vin, 2000 + p_size % 20 AS year, p_brand AS make, cast(p_retailprice AS DOUBLE) AS price FROM part")
def provider_map_plugin(spark, sf_dir):
    """The two known dialects and a third that is registered here, with its price in either of two places."""
    part, kind = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    vin, year = F.concat(F.lit("V"), F.col("p_partkey").cast("string")), 2000 + F.col("p_size") % 20
    alpha = F.to_json(F.struct(vin.alias("vin"), year.alias("year"), F.col("p_brand").alias("make"), F.struct(F.col("p_retailprice").alias("msrp")).alias("pricing")))
    beta = F.to_json(F.struct(vin.alias("VIN"), year.alias("ModelYear"), F.struct(F.col("p_brand").alias("Name")).alias("Make"), F.array(F.struct(F.col("p_retailprice").alias("Amount"))).alias("Prices")))
    odd = F.col("p_partkey") % 2 == 1
    gamma = F.to_json(F.struct(F.struct(vin.alias("id"), F.col("p_brand").alias("brand")).alias("car"), year.cast("string").alias("yr"), F.when(odd, F.col("p_retailprice")).alias("list"), F.when(~odd, F.struct(F.col("p_retailprice").alias("now"))).alias("offer")))
    providers = S.with_provider("gamma", {"vin": ["$.car.id"], "year": ["$.yr"], "make": ["$.car.brand"], "price": ["$.list", "$.offer.now"]})
    rows = part.select("p_partkey", F.when(kind == 0, "alpha").when(kind == 1, "beta").otherwise("gamma").alias("provider"), F.when(kind == 0, alpha).when(kind == 1, beta).otherwise(gamma).alias("payload"))
    return S.mapped(rows, "provider", "payload", ["p_partkey"], providers)


@query("encoder_plugin", "SELECT doc_id, length(coalesce(text, '')) AS n_chars, " + ", ".join(f"length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', '')) AS n_{c}" for c in "aeiou") + " FROM documents")
def encoder_plugin(spark, sf_dir):
    """Every document through a user's encoder, here by the shares of vowels; as counts, for shares of equal counts are equal in any arithmetic."""
    encode = U.encoder(U.letter_shares("aeiou"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), encode(F.col("text")).alias("v"))
    return rows.select("doc_id", "n_chars", *[F.round(F.get("v", F.lit(i)) * F.greatest(F.col("n_chars"), F.lit(1))).cast("long").alias(f"n_{c}") for i, c in enumerate("aeiou")])


PATTERNS = {"link": "https?://[a-z0-9.-]+", "paragraph": "<p[ >]", "dash": "[a-z]+-[a-z]+"}


@query(
    "pattern_udtf",
    " UNION ALL ".join(f"(SELECT page_id, '{k}' AS signal, len(m) AS n, strpos(html, m[1]) - 1 AS first_start, max(length(x)) AS longest FROM (SELECT page_id, html, regexp_extract_all(html, '{p}') AS m, unnest(regexp_extract_all(html, '{p}')) AS x FROM pages) GROUP BY ALL)" for k, p in PATTERNS.items()),
)
def pattern_udtf(spark, sf_dir):
    """All matches of three patterns in every page, summed up."""
    found = U.matches(table(spark, sf_dir, "pages"), "page_id", "html", PATTERNS)
    return found.groupBy("page_id", "signal").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"), F.max(F.col("end") - F.col("start")).cast("long").alias("longest"))


@query("token_set_ratio")
def token_set_ratio(spark, sf_dir):
    """Names of parts of one brand and size whose words are much alike (90 or more), with the numbers of their parts. A pair of names is scored once, however many blocks and parts have it."""
    names = table(spark, sf_dir, "part").groupBy("p_brand", "p_size", "p_name").agg(F.count("*").alias("n"))
    pairs = names.alias("a").join(names.alias("b"), (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.p_name") < F.col("b.p_name")))
    pairs = pairs.select("a.p_brand", "a.p_size", F.col("a.p_name").alias("a"), F.col("b.p_name").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
    scores = pairs.select("a", "b").distinct().withColumn("score", F.round(U.token_set_ratio("a", "b"), 4)).where("score >= 90")
    return pairs.join(scores, ["a", "b"]).select("p_brand", "p_size", "a", "b", "score", "n_a", "n_b")
