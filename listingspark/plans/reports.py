"""Counts and summaries over listings and the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.plans.catalog import query
from listingspark.plans.listing_rules import ISSUES_SQL, STALE_SQL, empty_sql, families_sql, issues, missing_sql, stale
from listingspark.tables import listings, table, with_listings


@query("dashboard_counts", with_listings(f"SELECT count(*) FILTER (listing_active) AS active, count(*) FILTER (NOT listing_active) AS inactive, count(*) FILTER ({STALE_SQL}) AS stale FROM l"))
def dashboard_counts(spark, sf_dir):
    """One pass; stale counts inactive rows too."""
    return listings(spark, sf_dir).agg(F.count_if("listing_active").alias("active"), F.count_if(~F.col("listing_active")).alias("inactive"), F.count_if(stale()).alias("stale"))


@query("dealer_rollup", with_listings("SELECT dealer_id, max(dealer_name) AS dealer_name, count(*) FILTER (listing_active) AS active_units, cast(max(scraped_at)::DATE AS VARCHAR) AS last_scrape FROM l GROUP BY dealer_id ORDER BY active_units DESC, dealer_id LIMIT 12"))
def dealer_rollup(spark, sf_dir):
    by = listings(spark, sf_dir).groupBy("dealer_id").agg(F.max("dealer_name").alias("dealer_name"), F.count_if("listing_active").alias("active_units"), F.max("scraped_at").cast("date").cast("string").alias("last_scrape"))
    return by.orderBy(F.desc("active_units"), "dealer_id").limit(12)


@query(
    "mode_row",
    """WITH g AS (SELECT l_shipmode, l_linenumber % 4 AS cyl, l_returnflag AS drive, l_linestatus AS trany, count(*) AS n, avg(l_quantity) AS city, avg(l_discount) AS hwy, min(cast(l_suppkey % 5 AS INTEGER)) AS category FROM (SELECT *, l_suppkey % 20 AS l_shipmode FROM lineitem) GROUP BY ALL)
    SELECT l_shipmode AS model, cast(cyl AS INTEGER) AS cyl, drive, trany, n, round(city, 6) AS city, round(hwy, 6) AS hwy, category FROM (SELECT *, row_number() OVER (PARTITION BY l_shipmode ORDER BY n DESC, cyl NULLS LAST, drive NULLS LAST, trany NULLS LAST) AS k FROM g) WHERE k = 1""",
)
def mode_row(spark, sf_dir):
    """The most frequent (cylinders, drive, transmission) of each model, with its averages; ties by the three ascending."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("model"), (F.col("l_linenumber") % 4).cast("int").alias("cyl"), F.col("l_returnflag").alias("drive"), F.col("l_linestatus").alias("trany"), "l_quantity", "l_discount", (F.col("l_suppkey") % 5).cast("int").alias("category"))
    groups = rows.groupBy("model", "cyl", "drive", "trany").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("city"), F.avg("l_discount").alias("hwy"), F.min("category").alias("category"))
    best = groups.groupBy("model").agg(F.min_by(F.struct("cyl", "drive", "trany", "n", "city", "hwy", "category"), F.struct(-F.col("n"), "cyl", "drive", "trany")).alias("x"))
    return best.select("model", "x.cyl", "x.drive", "x.trany", "x.n", F.round("x.city", 6).alias("city"), F.round("x.hwy", 6).alias("hwy"), "x.category")


@query("issue_kpis", with_listings(f"SELECT code, count(*) AS n FROM (SELECT unnest({ISSUES_SQL} || CASE WHEN {STALE_SQL} THEN ['stale_price'] ELSE [] END) AS code FROM l) GROUP BY code"))
def issue_kpis(spark, sf_dir):
    codes = F.concat(issues(), F.when(stale(), F.array(F.lit("stale_price"))).otherwise(F.array().cast("array<string>")))
    return listings(spark, sf_dir).select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("missing_summary", with_listings(f"SELECT code, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM m WHERE len(x) > 0), 1)::DOUBLE AS pct FROM (SELECT unnest(x) AS code FROM m) GROUP BY code", f"m AS (SELECT {missing_sql(False)} AS x FROM l)"))
def missing_summary(spark, sf_dir):
    """Counts by code, and their share of incomplete listings, in one aggregation of flags."""
    flags = R.missing_conditions()
    any_of = reduce(lambda a, b: a | b, flags.values())
    counts = listings(spark, sf_dir).agg(F.count_if(any_of).alias("total"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    rows = counts.unpivot("total", list(flags), "code", "n").where("n > 0")
    return rows.select("code", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


@query("photo_histogram", with_listings("SELECT CASE WHEN n_photos = 0 THEN '0' WHEN n_photos = 1 THEN '1' WHEN n_photos <= 4 THEN '2-4' ELSE '5+' END AS bin, count(*) AS n FROM l GROUP BY bin"))
def photo_histogram(spark, sf_dir):
    n = R.https_photos(F.array_distinct("gallery"))
    return listings(spark, sf_dir).groupBy(F.when(n == 0, "0").when(n == 1, "1").when(n <= 4, "2-4").otherwise("5+").alias("bin")).agg(F.count("*").alias("n"))


@query("duplicate_groups", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_orderkey, l_linenumber, l_returnflag, l_linestatus LIMIT 50")
def duplicate_groups(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *keys).limit(50)


@query("coverage_stats", "SELECT min(year(o_orderdate))::INTEGER AS first_year, max(year(o_orderdate))::INTEGER AS last_year, count(*) FILTER (o_orderpriority LIKE '1%') AS external, count(*) FILTER (NOT o_orderpriority LIKE '1%') AS other FROM orders")
def coverage_stats(spark, sf_dir):
    external = F.col("o_orderpriority").startswith("1")
    return table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"), F.count_if(external).alias("external"), F.count_if(~external).alias("other"))


FACETS = ["make", "transmission", "drivetrain", "fuel_type"]


@query("facet_values", with_listings(" UNION ALL ".join(f"(SELECT DISTINCT '{c}' AS facet, trim({c}) AS value FROM l WHERE NOT {empty_sql(c)})" for c in FACETS) + f" UNION ALL (SELECT DISTINCT 'exterior_family', unnest({families_sql('exterior_color')}) FROM l)"))
def facet_values(spark, sf_dir):
    """Distinct clean values of each facet: one unpivot and one distinct of raw values, whatever the number of facets; only these few are cleaned."""
    columns = [*FACETS, "exterior_color"]
    raw = listings(spark, sf_dir).select(F.inline(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("raw")) for c in columns]))).distinct()
    families = raw.where("facet = 'exterior_color'").select(F.lit("exterior_family").alias("facet"), F.explode(R.color_families(F.col("raw"))).alias("value"))
    plain = raw.where("facet <> 'exterior_color'").select("facet", R.clean_text(F.col("raw")).alias("value"))
    return plain.where("value is not null").unionAll(families).distinct()


SELECTED = {"make": ["Brand#1", "Brand#2", "Brand#3"], "transmission": ["Automatic"], "drivetrain": ["AWD"], "fuel_type": ["Gasoline", "Diesel"]}


@query(
    "facet_cascade",
    with_listings(
        " UNION ALL ".join(
            f"(SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM l WHERE {' AND '.join(f'{k} IN ({str(v)[1:-1]})' for k, v in SELECTED.items() if k != c)} GROUP BY ALL)" for c in FACETS
        )
    ),
)
def facet_cascade(spark, sf_dir):
    """For each facet the values that fit all other selections: a row counts for a facet if it fails no other. One pass."""
    ok = {c: F.coalesce(F.col(c).isin(SELECTED[c]), F.lit(False)) for c in FACETS}
    failed = sum((F.when(ok[c], 0).otherwise(1) for c in FACETS), F.lit(0))
    rows = listings(spark, sf_dir).withColumn("failed", failed)
    entries = F.array(*[F.when((F.col("failed") == 0) | ((F.col("failed") == 1) & ~ok[c]), F.struct(F.lit(c).alias("facet"), F.col(c).alias("value"))) for c in FACETS])
    return rows.select(F.inline(F.array_compact(entries))).groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("facet_combos", "SELECT p_brand, p_type, grouping_id(p_brand, p_type)::BIGINT AS level, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)")
def facet_combos(spark, sf_dir):
    return table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@query("field_fill_counts", with_listings(" UNION ALL ".join(f"(SELECT '{c}' AS field, count(*) FILTER (NOT {empty_sql(c)}) AS filled, count(*) FILTER ({empty_sql(c)}) AS skipped FROM l)" for c in FACETS)))
def field_fill_counts(spark, sf_dir):
    entries = F.array(*[F.struct(F.lit(c).alias("field"), (~R.is_empty(F.col(c))).alias("ok")) for c in FACETS])
    return listings(spark, sf_dir).select(F.inline(entries)).groupBy("field").agg(F.count_if("ok").alias("filled"), F.count_if(~F.col("ok")).alias("skipped"))


@query("intake_stats", "SELECT count(*) AS n_rows, count(DISTINCT c_name) AS n_names, count(*) FILTER (c_acctbal < 0) AS insufficient, count(*) FILTER (c_acctbal >= 0 AND c_acctbal < 1000) AS partial, count(*) FILTER (c_acctbal >= 1000) AS usable, count(*) FILTER (c_mktsegment IS NULL) AS no_segment FROM customer")
def intake_stats(spark, sf_dir):
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("n_rows"), F.countDistinct("c_name").alias("n_names"), F.count_if(balance < 0).alias("insufficient"), F.count_if((balance >= 0) & (balance < 1000)).alias("partial"), F.count_if(balance >= 1000).alias("usable"), F.count_if(F.col("c_mktsegment").isNull()).alias("no_segment"))


@query(
    "run_summary",
    "SELECT 'type' AS metric, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'hour', cast(hour(ts) AS VARCHAR), count(*) FROM events GROUP BY hour(ts) UNION ALL SELECT 'high', cast(value > 50 AS VARCHAR), count(*) FROM events GROUP BY value > 50",
)
def run_summary(spark, sf_dir):
    entry = lambda metric, value: F.struct(F.lit(metric).alias("metric"), value.cast("string").alias("value"))
    rows = table(spark, sf_dir, "events").select(F.inline(F.array(entry("type", F.col("event_type")), entry("hour", F.hour("ts")), entry("high", F.col("value") > 50))))
    return rows.groupBy("metric", "value").agg(F.count("*").alias("n"))


@query("top_counters", "WITH h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) SELECT host, count(*) AS n FROM h GROUP BY host ORDER BY n DESC, host LIMIT 50")
def top_counters(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(50)


@query(
    "evidence_patterns",
    "WITH h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/([a-z]+)', 1) AS kind, contains(url, 'utm_') AS tracked FROM pages) SELECT host, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, bool_or(tracked) AS any_tracked, count(*) AS n FROM h GROUP BY host",
)
def evidence_patterns(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "://[^/?#]*/([a-z]+)", 1).alias("kind"), F.contains("url", F.lit("utm_")).alias("tracked"))
    return rows.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.bool_or("tracked").alias("any_tracked"), F.count("*").alias("n"))
