"""Queries that make the next version of a table: upserts, soft deletes, patches, keyed merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.operators import merge as M
from listingspark.plans.catalog import query
from listingspark.plans.listing_rules import QUALITY_SQL, empty_sql, missing_sql
from listingspark.tables import ARRIVAL, listings, table, with_listings

COLUMNS = {"title": "overwrite", "price": "overwrite", "trim": "keep_if_null", "fuel_type": "keep_if_blank", "interior_color": "keep_if_blank", "image_url": "http_wins", "dealer_id": "overwrite", "first_seen_at": "sticky"}
LAST = f"(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY {', '.join(a + ' DESC' for a in ARRIVAL)}) AS k FROM l WHERE r_partkey % 2 = {{}}) WHERE k = 1)"
POLICY_SQL = {
    "overwrite": "n.{c}", "keep_if_null": "coalesce(n.{c}, o.{c})", "keep_if_blank": "coalesce(nullif(trim(n.{c}), ''), o.{c})",
    "http_wins": "CASE WHEN n.{c} LIKE 'http%' THEN n.{c} WHEN o.{c} LIKE 'http%' THEN o.{c} ELSE n.{c} END", "sticky": "coalesce(o.{c}, n.{c})",
}


def _two(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return tuple(M.last_wins(rows.where(F.col("r_partkey") % 2 == k), "vin", ARRIVAL) for k in (0, 1))


@query(
    "snapshot_upsert",
    with_listings(
        "SELECT coalesce(n.vin, o.vin) AS vin, " + ", ".join(f"CASE WHEN o.vin IS NOT NULL AND n.vin IS NOT NULL THEN {POLICY_SQL[p].format(c=c)} WHEN n.vin IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}" for c, p in COLUMNS.items() if c != "first_seen_at")
        + ", cast(CASE WHEN o.vin IS NOT NULL AND n.vin IS NOT NULL THEN coalesce(o.first_seen_at, n.first_seen_at) WHEN n.vin IS NOT NULL THEN n.first_seen_at ELSE o.first_seen_at END::DATE AS VARCHAR) AS first_seen_at, CASE WHEN o.vin IS NULL THEN 'inserted' WHEN n.vin IS NOT NULL THEN 'updated' ELSE 'kept' END AS action, "
        + f"cast(CASE WHEN n.vin IS NOT NULL AND (o.vin IS NULL OR o.price IS DISTINCT FROM n.price) THEN n.scraped_at ELSE o.scraped_at END::DATE AS VARCHAR) AS last_change FROM {LAST.format(0)} o FULL JOIN {LAST.format(1)} n ON o.vin = n.vin"
    ),
)
def snapshot_upsert(spark, sf_dir):
    """Even parts are the stored snapshot, odd ones the batch; of both the last row of a VIN counts."""
    stored, batch = _two(spark, sf_dir)
    out = M.snapshot_upsert(stored, batch, "vin", COLUMNS, "price", "scraped_at")
    return out.withColumns({c: F.col(c).cast("date").cast("string") for c in ("first_seen_at", "last_change")})


SCANS = "(SELECT dealer_id, count(*) AS rows, count(*) FILTER (length(vin) = 17) AS valid, dealer_id LIKE '%3' AS failed FROM {b} GROUP BY dealer_id)"


@query(
    "reconcile_soft_delete",
    with_listings(
        f"""SELECT o.vin, o.dealer_id, o.active AND NOT (coalesce(s.outcome = 'ok', false) AND n.vin IS NULL) AS active, s.outcome FROM (SELECT vin, dealer_id, bool_or(listing_active) AS active FROM l GROUP BY ALL) o
        LEFT JOIN (SELECT dealer_id, CASE WHEN dealer_id LIKE '%3' THEN 'failed' WHEN count(*) < 8 THEN 'below_min_rows' WHEN count(*) FILTER (length(vin) = 17) = 0 THEN 'no_valid_scraped_vins' ELSE 'ok' END AS outcome FROM l WHERE r_partkey % 2 = 1 GROUP BY dealer_id) s USING (dealer_id)
        LEFT JOIN (SELECT DISTINCT dealer_id, vin FROM l WHERE r_partkey % 2 = 1) n ON n.dealer_id = o.dealer_id AND n.vin = o.vin"""
    ),
)
def reconcile_soft_delete(spark, sf_dir):
    """All dealers in one job: a gate for each, then what a valid scan didn't see goes inactive."""
    rows = listings(spark, sf_dir)
    stored = rows.groupBy("vin", "dealer_id").agg(F.bool_or("listing_active").alias("active"))
    seen = rows.where("r_partkey % 2 = 1")
    scans = seen.groupBy("dealer_id").agg(F.count("*").alias("rows"), F.count_if(R.scanner_vin(F.col("vin")).isNotNull()).alias("valid"), F.bool_and(F.col("dealer_id").endswith("3")).alias("failed"))
    return M.soft_delete(stored, seen, scans, "vin", "dealer_id").select("vin", "dealer_id", "active", "outcome")


@query("stale_vin_anti", with_listings("SELECT DISTINCT dealer_id, vin FROM l WHERE listing_active AND r_partkey % 2 = 0 AND (dealer_id, vin) NOT IN (SELECT dealer_id, vin FROM l WHERE r_partkey % 2 = 1)"))
def stale_vin_anti(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return rows.where("listing_active and r_partkey % 2 = 0").select("dealer_id", "vin").distinct().join(rows.where("r_partkey % 2 = 1").select("dealer_id", "vin").distinct(), ["dealer_id", "vin"], "left_anti")


@query(
    "patch_apply",
    """WITH p AS (SELECT l_partkey AS p_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'p_brand' WHEN 1 THEN 'p_size' ELSE 'p_name' END AS field, CASE l_linenumber % 3 WHEN 0 THEN 'Patched' WHEN 1 THEN cast(l_linenumber AS VARCHAR) ELSE 'no' END AS value, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_returnflag = 'R'),
    w AS (SELECT p_partkey, max_by(value, seq) FILTER (field = 'p_brand') AS b, max_by(value, seq) FILTER (field = 'p_size') AS z FROM p GROUP BY p_partkey)
    SELECT p_partkey, coalesce(b, p_brand) AS p_brand, coalesce(try_cast(z AS INTEGER), p_size) AS p_size, p_name FROM part LEFT JOIN w USING (p_partkey)""",
)
def patch_apply(spark, sf_dir):
    """Patches (of returned lines) of two allowed fields; the field p_name isn't allowed and stays."""
    kind = F.col("l_linenumber") % 3
    patches = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("p_partkey"), F.when(kind == 0, "p_brand").when(kind == 1, "p_size").otherwise("p_name").alias("field"),
        F.when(kind == 0, F.lit("Patched")).when(kind == 1, F.col("l_linenumber").cast("string")).otherwise("no").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return M.apply_patches(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name"), patches, "p_partkey", ["p_brand", "p_size"])


DEALERS = """SELECT c_custkey AS id, 'Store ' || cast(c_nationkey AS {s}) || ' ' || c_mktsegment AS dealer_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'store' || cast(c_custkey % 11 AS {s}) || '.example.com' END AS domain,
CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lpad(cast(c_custkey % 17 AS {s}), 5, '0') END AS zip, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '555' || lpad(cast(c_custkey % 19 AS {s}), 7, '0') END AS phone, CASE WHEN c_acctbal < 0 THEN '' ELSE 'City' || cast(c_nationkey AS {s}) END AS city FROM customer"""
SPARK_DEALERS, DUCK_DEALERS = DEALERS.format(s="string"), DEALERS.format(s="VARCHAR")
NAME_SQL = "lower(regexp_replace(trim(dealer_name), '[^A-Za-z0-9]+', ' ', 'g'))"
QUALITY = "CASE WHEN dealer_name <> '' AND city <> '' AND domain <> '' THEN 'usable' WHEN dealer_name <> '' THEN 'partial' ELSE 'insufficient' END"
KEYED_SQL = f"""SELECT *, CASE WHEN domain <> '' AND zip <> '' THEN 'd:' || domain || '|z:' || zip || '|BMW' WHEN row_quality <> 'usable' THEN 'p:' || left(sha256(name || '|' || city || '|' || zip || '|' || phone || '|BMW'), 24)
WHEN name <> '' AND zip <> '' THEN 'n:' || name || '|z:' || zip || '|BMW' WHEN name <> '' AND phone <> '' THEN 'n:' || name || '|p:' || phone || '|BMW' ELSE 'h:' || left(sha256(name || '|' || city || '|BMW'), 24) END AS dedupe_key,
CASE WHEN name <> '' AND zip <> '' THEN 'ps:nz:' || name || '|' || zip || '|BMW' WHEN name <> '' AND phone <> '' THEN 'ps:np:' || name || '|' || phone || '|BMW' WHEN domain <> '' THEN 'ps:d:' || domain || '|BMW' ELSE 'ps:h:' || left(sha256(name || '|' || city || '|BMW'), 24) END AS partial_key
FROM (SELECT *, {NAME_SQL} AS name, {QUALITY} AS row_quality FROM ({DUCK_DEALERS}))"""


def _dealers(spark, sf_dir):
    """Dealer records planted from customers, with keys and quality."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer_records")
    rows = spark.sql(SPARK_DEALERS.replace("FROM customer", "FROM customer_records"))
    rows = rows.withColumn("name", F.lower(F.regexp_replace(F.trim("dealer_name"), "[^A-Za-z0-9]+", " "))).withColumn("row_quality", F.expr(QUALITY))
    hashed = lambda prefix, *cs: F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *cs, F.lit("BMW")).cast("binary"), 256), F.lit(24)))
    join = lambda prefix, *cs: F.concat(F.lit(prefix), F.concat_ws("|", *cs, F.lit("BMW")))
    has = lambda c: F.col(c) != ""
    z, p = F.concat(F.lit("z:"), "zip"), F.concat(F.lit("p:"), "phone")
    dedupe = F.when(has("domain") & has("zip"), join("d:", "domain", z)).when(F.col("row_quality") != "usable", hashed("p:", "name", "city", "zip", "phone")).when(has("name") & has("zip"), join("n:", "name", z)).when(has("name") & has("phone"), join("n:", "name", p)).otherwise(hashed("h:", "name", "city"))
    partial = F.when(has("name") & has("zip"), join("ps:nz:", "name", "zip")).when(has("name") & has("phone"), join("ps:np:", "name", "phone")).when(has("domain"), join("ps:d:", "domain")).otherwise(hashed("ps:h:", "name", "city"))
    return rows.withColumns({"dedupe_key": dedupe, "partial_key": partial})


@query("dedupe_key_build", f"SELECT id, dedupe_key, partial_key, row_quality FROM ({KEYED_SQL})")
def dedupe_key_build(spark, sf_dir):
    return _dealers(spark, sf_dir).select("id", "dedupe_key", "partial_key", "row_quality")


MERGED_SQL = "SELECT {k}, count(*) AS n, first(dealer_name ORDER BY id DESC) AS dealer_name, first(phone ORDER BY length(phone) DESC, id DESC) AS phone, first(domain ORDER BY length(domain) DESC, id DESC) AS domain, max(row_quality) AS row_quality, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM ({s}) WHERE {w} GROUP BY {k}"


def _merged(rows, key):
    """Longest texts win, the latest of equals; the best quality (usable after partial after insufficient in the alphabet); all ids."""
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.max_by("dealer_name", "id").alias("dealer_name"), M.longest("phone", F.col("id")).alias("phone"), M.longest("domain", F.col("id")).alias("domain"),
        F.max("row_quality").alias("row_quality"), F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("ids"),
    )


@query("oem_merge", MERGED_SQL.format(k="dedupe_key", s=KEYED_SQL, w="row_quality = 'usable'"))
def oem_merge(spark, sf_dir):
    return _merged(_dealers(spark, sf_dir).where("row_quality = 'usable'"), "dedupe_key")


@query("partial_staging_merge", MERGED_SQL.format(k="partial_key", s=KEYED_SQL, w="row_quality <> 'usable'"))
def partial_staging_merge(spark, sf_dir):
    return _merged(_dealers(spark, sf_dir).where("row_quality <> 'usable'"), "partial_key")


@query("replay_normalize", f"WITH k AS ({KEYED_SQL}) SELECT 'usable' AS target, count(*) AS n_rows, count(DISTINCT dedupe_key) AS n_keys FROM k WHERE row_quality = 'usable' UNION ALL SELECT 'partial', count(*), count(DISTINCT partial_key) FROM k WHERE row_quality <> 'usable'")
def replay_normalize(spark, sf_dir):
    """The whole intake rebuilt from raw rows, as counts of its two targets."""
    rows = _dealers(spark, sf_dir)
    usable = F.col("row_quality") == "usable"
    return rows.groupBy(F.when(usable, "usable").otherwise("partial").alias("target")).agg(F.count("*").alias("n_rows"), F.countDistinct(F.when(usable, F.col("dedupe_key")).otherwise(F.col("partial_key"))).alias("n_keys"))


@query("coverage_upsert", "SELECT coalesce(n.p_brand, o.p_brand) AS p_brand, coalesce(n.p_type, o.p_type) AS p_type, coalesce(n.source, o.source) AS source, CASE WHEN n.p_brand IS NULL THEN o.years ELSE n.years END AS years FROM (SELECT p_brand, p_type, max(p_name) AS source, count(*) AS years FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL) o FULL JOIN (SELECT p_brand, p_type, CASE WHEN count(*) % 2 = 0 THEN max(p_name) END AS source, count(*) AS years FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL) n ON o.p_brand = n.p_brand AND o.p_type = n.p_type")
def coverage_upsert(spark, sf_dir):
    key = lambda df: df.withColumn("k", F.struct("p_brand", "p_type"))
    part = table(spark, sf_dir, "part")
    stored = key(part.where("p_partkey % 2 = 0").groupBy("p_brand", "p_type").agg(F.max("p_name").alias("source"), F.count("*").alias("years")))
    batch = key(part.where("p_partkey % 2 = 1").groupBy("p_brand", "p_type").agg(F.when(F.count("*") % 2 == 0, F.max("p_name")).alias("source"), F.count("*").alias("years")))
    return M.snapshot_upsert(stored, batch, "k", {"source": "keep_if_null", "years": "overwrite"}).select("k.*", "source", "years")


@query("replace_by_external_id", "SELECT p_brand, p_type, p_name FROM part WHERE p_partkey % 3 <> 0 AND (p_brand, p_type) NOT IN (SELECT p_brand, p_type FROM part WHERE p_partkey % 3 = 0 AND p_size < 10) UNION ALL SELECT p_brand, p_type, 'new ' || p_name FROM part WHERE p_partkey % 3 = 0 AND p_size < 10")
def replace_by_external_id(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    batch = part.where("p_partkey % 3 = 0 and p_size < 10").select("p_brand", "p_type", F.concat(F.lit("new "), "p_name").alias("p_name"))
    return M.replace_by_key(part.where("p_partkey % 3 <> 0").select("p_brand", "p_type", "p_name"), batch, ["p_brand", "p_type"])


@query("get_or_create_key", "WITH o AS (SELECT row_number() OVER (ORDER BY p_brand) AS id, p_brand FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 3)), f AS (SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM o)) SELECT * FROM o UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM o) + row_number() OVER (ORDER BY p_brand), p_brand FROM f")
def get_or_create_key(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_size")
    stored = M.numbered_keys(spark.createDataFrame([], "id long, p_brand string"), part.where("p_size < 3"), ["p_brand"])
    return M.numbered_keys(stored, part, ["p_brand"])


@query("incomplete_index", with_listings(f"SELECT vin, array_to_string(m, ',') AS missing FROM (SELECT vin, {missing_sql(True)} AS m FROM {LAST.format(0).replace('WHERE r_partkey % 2 = 0', '')}) WHERE len(m) > 0"))
def incomplete_index(spark, sf_dir):
    rows = M.last_wins(listings(spark, sf_dir), "vin", ARRIVAL).withColumn("m", R.missing_fields(public=True))
    return rows.where(F.size("m") > 0).select("vin", F.array_join("m", ",").alias("missing"))


@query("provenance_merge", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'new' ELSE 'old' END AS drivetrain, CASE WHEN l_linenumber % 2 = 0 AND l_linenumber % 3 = 0 THEN 'new' WHEN l_linenumber % 3 = 0 THEN 'old' END AS cylinders FROM lineitem")
def provenance_merge(spark, sf_dir):
    three = F.col("l_linenumber") % 3 == 0
    entry = lambda v: F.when(three, F.create_map(F.lit("drivetrain"), F.lit(v), F.lit("cylinders"), F.lit(v))).otherwise(F.create_map(F.lit("drivetrain"), F.lit(v)))
    merged = M.provenance_merge(entry("old"), F.when(F.col("l_linenumber") % 2 == 0, entry("new")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", merged.alias("m")).select("l_orderkey", "l_linenumber", "l_partkey", F.try_element_at("m", F.lit("drivetrain")).alias("drivetrain"), F.try_element_at("m", F.lit("cylinders")).alias("cylinders"))


@query("response_cache", "SELECT upper(trim(' k' || cast(o_custkey AS VARCHAR))) AS k, count(*) AS asked, max(c_name) AS body, max(c_name) IS NULL AS needs_fetch FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0 GROUP BY 1")
def response_cache(spark, sf_dir):
    """Cached bodies by upper-cased key; keys without one are the list to fetch."""
    cache = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("k"), F.col("c_name").alias("body"))
    asked = table(spark, sf_dir, "orders").groupBy(F.upper(F.trim(F.concat(F.lit(" k"), F.col("o_custkey").cast("string")))).alias("k")).agg(F.count("*").alias("asked"))
    return asked.join(cache, "k", "left").select("k", "asked", "body", F.col("body").isNull().alias("needs_fetch"))


@query("score_refresh", with_listings(f"SELECT vin, {QUALITY_SQL} AS score FROM {LAST.format(1)}"))
def score_refresh(spark, sf_dir):
    """Scores of the batch's rows only."""
    return M.last_wins(listings(spark, sf_dir).where("r_partkey % 2 = 1"), "vin", ARRIVAL).select("vin", R.quality_score(R.listing_checks()).alias("score"))


@query("first_seen_backfill", with_listings("SELECT vin, r_partkey, cast(coalesce(first_seen_at, scraped_at)::DATE AS VARCHAR) AS first_seen, first_seen_at IS NULL AS filled FROM l"))
def first_seen_backfill(spark, sf_dir):
    return listings(spark, sf_dir).select("vin", "r_partkey", F.coalesce("first_seen_at", "scraped_at").cast("date").cast("string").alias("first_seen"), F.col("first_seen_at").isNull().alias("filled"))


MANIFEST_SQL = """WITH o AS (SELECT 'd' || s_suppkey AS dealer_id, s_name AS name, 'https://s' || s_suppkey || '.example/' AS url, CASE WHEN s_suppkey % 4 = 0 THEN 'Brand#' || s_nationkey ELSE '' END AS brand FROM supplier WHERE s_nationkey < 12),
b AS (SELECT CASE WHEN s_acctbal < 0 THEN 'Bad Id' WHEN s_suppkey % 5 = 0 THEN 'x' || s_suppkey ELSE 'd' || s_suppkey END AS dealer_id, CASE WHEN s_suppkey % 7 = 0 THEN ' n/a' ELSE s_name || ' 2' END AS name, 'HTTPS://S' || s_suppkey || '.example' AS url, s_suppkey FROM supplier WHERE s_acctbal < 7000),
g AS (SELECT *, CASE WHEN name = ' n/a' THEN 'no_name' WHEN dealer_id = 'Bad Id' THEN 'bad_dealer_id' END AS fault FROM b),
m AS (SELECT g.dealer_id, o.dealer_id AS old_id, o.brand FROM g JOIN o ON o.dealer_id = 'd' || s_suppkey WHERE fault IS NULL)
SELECT g.dealer_id, trim(g.name) AS name, url, nullif(brand, '') AS brand, CASE WHEN old_id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM g LEFT JOIN m ON m.dealer_id = g.dealer_id WHERE fault IS NULL
UNION ALL SELECT dealer_id, name, url, brand, 'kept' FROM o WHERE dealer_id NOT IN (SELECT old_id FROM m) UNION ALL SELECT dealer_id, trim(name), url, fault, 'rejected' FROM g WHERE fault IS NOT NULL"""


@query("manifest_upsert", MANIFEST_SQL)
def manifest_upsert(spark, sf_dir):
    """A stored manifest (suppliers of some nations) and a batch that comes under the same ids, or under new ids with the same web sites."""
    rows, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    stored = rows.where("s_nationkey < 12").select(F.concat(F.lit("d"), key).alias("dealer_id"), F.col("s_name").alias("name"), F.concat(F.lit("https://s"), key, F.lit(".example/")).alias("url"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string"))).otherwise("").alias("brand"))
    batch = rows.where("s_acctbal < 7000").select(
        F.when(F.col("s_acctbal") < 0, "Bad Id").when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("x"), key)).otherwise(F.concat(F.lit("d"), key)).alias("dealer_id"),
        F.when(F.col("s_suppkey") % 7 == 0, " n/a").otherwise(F.concat("s_name", F.lit(" 2"))).alias("name"), F.concat(F.lit("HTTPS://S"), key, F.lit(".example")).alias("url"),
    )
    return M.manifest_upsert(stored, batch)


@query("enrichment_writeback", f"SELECT id, dedupe_key, CASE WHEN row_quality = 'usable' THEN 'group ' || cast(o.n AS VARCHAR) END AS dealer_group, CASE WHEN row_quality = 'usable' AND o.n IS NOT NULL THEN 'assigned' WHEN row_quality = 'usable' THEN 'unknown' END AS status FROM ({KEYED_SQL}) LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = id")
def enrichment_writeback(spark, sf_dir):
    """Attribution results (planted as order counts) written to usable rows."""
    results = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    usable = F.col("row_quality") == "usable"
    rows = _dealers(spark, sf_dir).join(results, "id", "left")
    return rows.select("id", "dedupe_key", F.when(usable & F.col("n").isNotNull(), F.concat(F.lit("group "), F.col("n").cast("string"))).alias("dealer_group"), F.when(usable, F.when(F.col("n").isNotNull(), "assigned").otherwise("unknown")).alias("status"))


@query("fingerprint_append", "SELECT fp, count(*) AS n, min(id) AS first_id FROM (SELECT c_custkey AS id, sha256('BMW' || '|' || 'Seg ' || c_mktsegment || '|' || cast(c_nationkey AS VARCHAR)) AS fp FROM customer) GROUP BY fp HAVING bool_and(id % 7 <> 0)")
def fingerprint_append(spark, sf_dir):
    """New fingerprints (those of no stored row, every seventh) with their first row."""
    fp = F.sha2(F.concat_ws("|", F.lit("BMW"), F.concat(F.lit("Seg "), "c_mktsegment"), F.col("c_nationkey").cast("string")).cast("binary"), 256)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fp.alias("fp"))
    new = rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return new.join(rows.where("id % 7 = 0").select("fp").distinct(), "fp", "left_anti")
