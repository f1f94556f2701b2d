"""Queries that filter, sort and page listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.operators import search as S
from listingspark.plans.catalog import query
from listingspark.plans.listing_rules import HOST_SQL, QUALITY_SQL, empty_sql, families_sql, missing_sql
from listingspark.tables import ARRIVAL, listings, table, with_listings

KEY = "vin, r_partkey, r_suppkey, r_quantity"
TIES = ["r_partkey", "r_suppkey", "r_quantity", "r_extendedprice"]


@query(
    "listing_search",
    with_listings(f"SELECT {KEY}, make, price FROM l WHERE coalesce(listing_active, true) AND lower(make) IN ('brand#1', 'brand#2', 'brand#12', 'brand#23') AND drivetrain IN ('AWD', 'FWD') AND year >= 1993 AND year <= 2000 AND (price IS NULL OR price <= 40000 OR price = 0) AND (mileage IS NULL OR mileage <= 40000 OR mileage = 0) AND len({missing_sql(True)}) = 0"),
)
def listing_search(spark, sf_dir):
    found = S.search(listings(spark, sf_dir), makes=["BRAND#1", "Brand#2", "brand#12", "brand#23"], drivetrains=["AWD", "FWD"], min_year=1993, max_year=2000, max_price=40000, max_mileage=40000)
    return found.select(*KEY.split(", "), "make", "price")


@query(
    "country_filter",
    with_listings(f"SELECT {KEY}, make FROM l WHERE lower(make) IN (SELECT lower(make) FROM mc WHERE lower(country) IN ('france', 'germany', 'nation_1', 'nation_2'))", "mc AS (SELECT DISTINCT p_brand AS make, n_name AS country FROM part JOIN nation ON n_nationkey = abs(p_size) % 25)"),
)
def country_filter(spark, sf_dir):
    """The make's countries are those of its parts' sizes."""
    countries = table(spark, sf_dir, "part").join(table(spark, sf_dir, "nation"), F.abs("p_size") % 25 == F.col("n_nationkey")).select(F.col("p_brand").alias("make"), F.col("n_name").alias("country")).distinct()
    return S.in_countries(listings(spark, sf_dir), countries, ["France", "Germany", "NATION_1", "NATION_2"]).select(*KEY.split(", "), "make")


@query("family_intersect", with_listings(f"SELECT {KEY} FROM l WHERE list_has_any({families_sql('exterior_color')}, ['red', 'blue']) AND list_has_any({families_sql('interior_color')}, ['black', 'tan'])"))
def family_intersect(spark, sf_dir):
    wanted = [x for x in S.search_predicates(exterior_families=["red", "blue"], interior_families=["black", "tan"])[1:]]
    return listings(spark, sf_dir).where(S.all_of(wanted)).select(*KEY.split(", "))


@query("displacement_range", "SELECT p_partkey, liters FROM (SELECT p_partkey, [2.0, 3.5, NULL, 6.2, NULL, NULL][p_partkey % 6 + 1]::DOUBLE AS liters FROM part) WHERE liters BETWEEN 2.0 AND 4.0")
def displacement_range(spark, sf_dir):
    from listingspark.plans.listing_rules import ENGINES

    text = F.element_at(F.array(*map(F.lit, ENGINES)), (F.col("p_partkey") % len(ENGINES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", R.liters_in(text).alias("liters")).where(F.col("liters").between(2.0, 4.0))


@query("text_contains", with_listings(f"SELECT {KEY}, model FROM l WHERE contains(lower(vin), 'd#1') OR contains(lower(make), 'd#1') OR contains(lower(title), 'd#1')"))
def text_contains(spark, sf_dir):
    return S.text_contains(listings(spark, sf_dir), ["vin", "make", "title"], "D#1").select(*KEY.split(", "), "model")


PROFILES = "SELECT 'p' || cast(s_suppkey AS {s}) AS profile, CASE WHEN s_suppkey % 10 = 0 THEN 'admin' ELSE 'staff' END AS role, CASE WHEN s_suppkey % 7 <> 0 THEN 'd' || cast(s_suppkey AS {s}) END AS dealer_id FROM supplier"


@query("tenant_scope", with_listings("SELECT profile, count(*) AS n, sum(CASE WHEN listing_active THEN 1 ELSE 0 END)::BIGINT AS active FROM l JOIN p USING (dealer_id) WHERE role = 'staff' GROUP BY profile", f"p AS ({PROFILES.format(s='VARCHAR')})"))
def tenant_scope(spark, sf_dir):
    profiles = table(spark, sf_dir, "supplier").selectExpr("'p' || cast(s_suppkey AS string) AS profile", "CASE WHEN s_suppkey % 10 = 0 THEN 'admin' ELSE 'staff' END AS role", "CASE WHEN s_suppkey % 7 <> 0 THEN 'd' || cast(s_suppkey AS string) END AS dealer_id")
    seen = S.tenant_scope(listings(spark, sf_dir), profiles)
    return seen.groupBy("profile").agg(F.count("*").alias("n"), F.count_if("listing_active").alias("active"))


@query(
    "backfill_candidates",
    with_listings(
        f"""SELECT * FROM (SELECT {KEY}, {empty_sql('transmission')} AS needs_transmission, coalesce(cylinders, 0) = 0 AND NOT coalesce(contains(lower(fuel_type), 'electric'), false) AS needs_cylinders, {empty_sql('drivetrain')} AS needs_drivetrain,
        {empty_sql('interior_color')} AND n_photos > 0 AS needs_vision FROM l) WHERE needs_transmission OR needs_cylinders OR needs_drivetrain OR needs_vision"""
    ),
)
def backfill_candidates(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumns(S.backfill_flags())
    return rows.where("needs_transmission or needs_cylinders or needs_drivetrain or needs_vision").select(*KEY.split(", "), *S.backfill_flags())


@query("url_policy", f"WITH h AS (SELECT page_id, lower(url) AS u, {HOST_SQL} AS host FROM pages) SELECT page_id, NOT regexp_matches(u, 'ads-track|casino|pills') AND (host = 'example.org' OR ends_with(host, '.example.org') OR regexp_matches(u, '/en/|inventory')) AS allowed FROM h")
def url_policy(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.url_allowed(R.url_host(F.col("url")), F.col("url"), ["ads-track", "casino", "pills"], "example.org", ["/en/", "inventory"]).alias("allowed"))


@query("facet_sanity", with_listings("SELECT make, transmission, count(*) AS n FROM l WHERE NOT regexp_matches(make, '^[0-9]+$') AND make IN (SELECT DISTINCT p_brand FROM part WHERE p_size > 3) AND NOT regexp_matches(transmission, '^[0-9-]+$') GROUP BY ALL"))
def facet_sanity(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_brand").alias("make")).distinct()
    rows = listings(spark, sf_dir).where(~F.col("make").rlike("^[0-9]+$") & ~F.col("transmission").rlike("^[0-9-]+$"))
    return rows.join(known, "make", "left_semi").groupBy("make", "transmission").agg(F.count("*").alias("n"))


@query("promotion_eligible", with_listings(f"SELECT {KEY}, NOT ({empty_sql('vin')} OR {empty_sql('title')} OR {empty_sql('make')} OR {empty_sql('model')}) AND year IS NOT NULL AND coalesce(price > 0, false) AND n_photos > 0 AS eligible FROM l"))
def promotion_eligible(spark, sf_dir):
    return listings(spark, sf_dir).select(*KEY.split(", "), S.promotion_eligible().alias("eligible"))


@query("price_sort", with_listings(f"SELECT {KEY}, price, row_number() OVER (ORDER BY CASE WHEN price > 0 THEN price END ASC NULLS LAST, vin, {', '.join(TIES)}) AS place FROM l ORDER BY place LIMIT 500"))
def price_sort(spark, sf_dir):
    """The first 500 of the order; a limit is the feature here. A sort with a limit keeps 500 rows in each task."""
    top = listings(spark, sf_dir).orderBy(*S.price_order("vin", *TIES)).limit(500)
    ranked = top.select(*KEY.split(", "), "price")
    from pyspark.sql import Window

    order = Window.orderBy(*S.price_order("vin", *[t for t in TIES if t in KEY]))
    return ranked.withColumn("place", F.row_number().over(order).cast("long"))


@query("quality_price_sort", with_listings(f"SELECT vin, r_partkey, score, price FROM (SELECT *, {QUALITY_SQL} AS score FROM l) ORDER BY score DESC, CASE WHEN price > 0 THEN price END ASC NULLS LAST, vin, {', '.join(TIES)} LIMIT 500"))
def quality_price_sort(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("score", R.quality_score(R.listing_checks()))
    return rows.orderBy(*S.quality_price_order("vin", *TIES)).limit(500).select("vin", "r_partkey", "score", "price")


@query("paged_listing", with_listings(f"SELECT vin, r_partkey, price, total FROM l, (SELECT count(*) AS total FROM l) ORDER BY price DESC NULLS LAST, vin DESC, {', '.join(ARRIVAL)} LIMIT 25 OFFSET 50"))
def paged_listing(spark, sf_dir):
    rows = S.page(listings(spark, sf_dir), "price", True, 3, 25, ARRIVAL)
    return rows.select("vin", "r_partkey", "price", "total")
