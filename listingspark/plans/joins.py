"""Queries that join listings and the driver's tables to reference data."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.operators import fuzzy as Z
from listingspark.plans.catalog import query
from listingspark.plans.listing_rules import HOST_SQL, empty_sql
from listingspark.tables import listings, table, with_listings


@query(
    "flat_reference_export",
    """SELECT p_partkey, p_brand, p_name, s_name, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linenumber)), ';') AS options, count(*) AS n
    FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""",
)
def flat_reference_export(spark, sf_dir):
    """Parts with their supplier and an ordered list of options, in one aggregation instead of a query for each part."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    option = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    return rows.groupBy("p_partkey", "p_brand", "p_name", "s_name").agg(F.array_join(F.array_sort(F.collect_set(option)), ";").alias("options"), F.count("*").alias("n"))


@query("listing_dealer_left", with_listings("SELECT l.vin, l.r_partkey, s_name AS city, n_name AS state FROM l LEFT JOIN (SELECT 'd' || s_suppkey AS dealer_id, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0) d USING (dealer_id)"))
def listing_dealer_left(spark, sf_dir):
    dealers = table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    dealers = dealers.select(F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("dealer_id"), F.col("s_name").alias("city"), F.col("n_name").alias("state"))
    return listings(spark, sf_dir).select("vin", "r_partkey", "dealer_id").join(dealers, "dealer_id", "left").select("vin", "r_partkey", "city", "state")


@query(
    "model_specs_fill",
    with_listings(
        f"""SELECT vin, r_partkey, CASE WHEN {empty_sql('transmission')} THEN s.t ELSE transmission END AS transmission, CASE WHEN {empty_sql('drivetrain')} THEN s.d ELSE drivetrain END AS drivetrain, CASE WHEN coalesce(cylinders, 0) = 0 AND NOT contains(lower(fuel_type), 'electric') THEN s.c ELSE cylinders END AS cylinders
        FROM l LEFT JOIN (SELECT lower(p_brand) AS mk, lower(p_type) AS md, max(CASE WHEN p_size % 2 = 0 THEN '8-Speed' ELSE 'CVT' END) AS t, min(CASE WHEN p_size % 3 = 0 THEN 'AWD' ELSE 'FWD' END) AS d, max(p_size % 9)::INTEGER AS c FROM part GROUP BY ALL) s ON lower(make) = mk AND lower(model) = md"""
    ),
)
def model_specs_fill(spark, sf_dir):
    """Default specs of (make, model), in any case, fill only what a listing lacks."""
    size = F.col("p_size")
    specs = table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("mk"), F.lower("p_type").alias("md")).agg(F.max(F.when(size % 2 == 0, "8-Speed").otherwise("CVT")).alias("t"), F.min(F.when(size % 3 == 0, "AWD").otherwise("FWD")).alias("d"), F.max((size % 9).cast("int")).alias("c"))
    rows = listings(spark, sf_dir).join(specs, (F.lower("make") == F.col("mk")) & (F.lower("model") == F.col("md")), "left")
    fill = lambda c, d: F.when(R.is_empty(F.col(c)), F.col(d)).otherwise(F.col(c)).alias(c)
    no_cylinders = (F.coalesce("cylinders", F.lit(0)) == 0) & ~F.lower("fuel_type").contains("electric")
    return rows.select("vin", "r_partkey", fill("transmission", "t"), fill("drivetrain", "d"), F.when(no_cylinders, F.col("c")).otherwise(F.col("cylinders")).alias("cylinders"))


@query(
    "epa_tiered_lookup",
    """WITH q AS (SELECT DISTINCT p_brand, p_type, p_size % 5 AS y FROM part WHERE p_partkey % 3 = 0), e AS (SELECT p_partkey AS id, p_brand, p_type, p_size % 5 AS y FROM part WHERE p_partkey % 3 <> 0),
    c AS (SELECT q.p_brand, q.p_type, q.y, e.id, CASE WHEN e.p_type = q.p_type THEN 1 WHEN starts_with(e.p_type, split_part(q.p_type, ' ', 1)) THEN 2 ELSE 3 END AS tier FROM q JOIN e ON e.p_brand = q.p_brand AND e.y = q.y)
    SELECT p_brand, p_type, y, tier, count(*) AS n, min(id) AS first_id FROM (SELECT *, min(tier) OVER (PARTITION BY p_brand, p_type, y) AS best FROM c) WHERE tier = best GROUP BY ALL""",
)
def epa_tiered_lookup(spark, sf_dir):
    """Candidates of the same brand and year get a tier number; the lowest tier of each query holds. No fallback query runs twice."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 5).alias("y"))
    asked = part.where("p_partkey % 3 = 0").select("p_brand", "p_type", "y").distinct()
    specs = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_type").alias("e_type"), "y")
    tier = F.when(F.col("e_type") == F.col("p_type"), 1).when(F.startswith("e_type", F.split_part("p_type", F.lit(" "), F.lit(1))), 2).otherwise(3)
    found = asked.join(specs, ["p_brand", "y"]).groupBy("p_brand", "p_type", "y", tier.alias("tier")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return found.groupBy("p_brand", "p_type", "y").agg(F.min(F.struct("tier", "n", "first_id")).alias("x")).select("p_brand", "p_type", "y", "x.*")


@query(
    "registry_link",
    f"""WITH p AS (SELECT page_id, url, regexp_replace({HOST_SQL}, '^www[.]', '') AS host FROM pages), r AS (SELECT host, min(page_id) AS registry FROM p WHERE page_id % 4 = 0 GROUP BY host), x AS (SELECT url, min(page_id) AS registry FROM p WHERE page_id % 4 = 0 GROUP BY url)
    SELECT p.page_id, coalesce(x.registry, r.registry) AS registry, CASE WHEN x.registry IS NOT NULL THEN 'exact' WHEN r.registry IS NOT NULL THEN 'host' ELSE 'unmatched' END AS how FROM p LEFT JOIN x ON x.url = p.url LEFT JOIN r ON r.host = p.host""",
)
def registry_link(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", R.bare_host(R.url_host(F.col("url"))).alias("host"))
    known = pages.where("page_id % 4 = 0")
    hosts, urls = (known.groupBy(c).agg(F.min("page_id").alias(f"by_{c}")) for c in ("host", "url"))
    rows = pages.join(urls, "url", "left").join(hosts, "host", "left")
    return rows.select("page_id", F.coalesce("by_url", "by_host").alias("registry"), F.when(F.col("by_url").isNotNull(), "exact").when(F.col("by_host").isNotNull(), "host").otherwise("unmatched").alias("how"))


MILES = 3958.8
#: Pairs that a task of geo_radius looks at, and the share of all pairs that meet in a cell: both about.
GEO_TASK, GEO_SHARE = 10_000_000, 0.005
PLACES = "SELECT {k} AS id, ({k} * 7919 % 140000) / 1000.0 - 70 AS lat, ({k} * 104729 % 360000) / 1000.0 - 180 AS lon FROM {t}"


@query(
    "geo_radius",
    f"""WITH c AS (SELECT c_custkey AS id, (c_custkey * 7919 % 140000)::DOUBLE / 1000.0::DOUBLE - 70 AS lat, (c_custkey * 104729 % 360000)::DOUBLE / 1000.0::DOUBLE - 180 AS lon FROM customer),
    s AS (SELECT s_suppkey AS sid, (s_suppkey * 7919 % 140000)::DOUBLE / 1000.0::DOUBLE - 70 AS slat, (s_suppkey * 104729 % 360000)::DOUBLE / 1000.0::DOUBLE - 180 AS slon FROM supplier),
    d AS (SELECT id, sid, 2 * {MILES} * asin(sqrt(pow(sin(radians(slat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(slat)) * pow(sin(radians(slon - lon) / 2), 2))) AS miles FROM c, s) SELECT id, sid, round(miles, 1) AS miles FROM d WHERE miles <= 300""",
)
def geo_radius(spark, sf_dir):
    """Pairs within 300 miles: both sides meet in grid cells (a place joins with its cell and all cells that the radius can reach), then the exact distance decides.

    Pairs grow with the product of both tables, so cells are dealt over as many partitions as give each some GEO_TASK pairs to look at.
    """
    radius = 300.0
    place = lambda df, k: df.select(F.col(k).alias("id"), ((F.col(k) * 7919 % 140000) / 1000.0 - 70).alias("lat"), ((F.col(k) * 104729 % 360000) / 1000.0 - 180).alias("lon"))
    near, far = place(table(spark, sf_dir, "customer"), "c_custkey"), place(table(spark, sf_dir, "supplier"), "s_suppkey").withColumnsRenamed({"id": "sid", "lat": "slat", "lon": "slon"})
    degrees = 2 * 57.29577951308232 * radius / MILES / 2  # of latitude
    cell = 2.5
    parts = max(16, int(near.count() * far.count() * GEO_SHARE / GEO_TASK))
    rows = lambda c: F.floor((c + 90) / cell)
    # a circle around a point spans more degrees of longitude towards the poles; where it holds a pole, all of them
    half = F.asin(F.least(F.lit(1.0), F.sin(F.lit(radius / MILES)) / F.cos(F.radians("slat")))) * 57.29577951308232
    half = F.when(F.abs("slat") + degrees >= 90, 180.0).otherwise(half)
    columns = int(360 / cell)
    across = F.sequence(F.floor((F.col("slon") + 180 - half) / cell), F.least(F.floor((F.col("slon") + 180 + half) / cell), F.floor((F.col("slon") + 180 - half) / cell) + columns - 1))
    cells = far.withColumn("row", F.explode(F.sequence(rows(F.col("slat") - degrees), rows(F.col("slat") + degrees)))).withColumn("c", F.explode(across)).withColumn("col", F.pmod("c", F.lit(columns)))
    here = near.withColumns({"row": rows(F.col("lat")), "col": F.pmod(F.floor((F.col("lon") + 180) / cell), F.lit(columns))})
    arc = F.pow(F.sin(F.radians(F.col("slat") - F.col("lat")) / 2), 2) + F.cos(F.radians("lat")) * F.cos(F.radians("slat")) * F.pow(F.sin(F.radians(F.col("slon") - F.col("lon")) / 2), 2)
    here, cells = (df.repartition(parts, "row", "col") for df in (here, cells))
    return here.join(cells.hint("merge"), ["row", "col"]).withColumn("miles", 2 * MILES * F.asin(F.sqrt(arc))).where(F.col("miles") <= radius).select("id", "sid", F.round("miles", 1).alias("miles"))


@query("orphan_checks", "SELECT 'line_without_order' AS problem, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def orphan_checks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*").alias("n"))
    return lines.select(F.lit("line_without_order").alias("problem"), "n").unionByName(orders.select(F.lit("order_without_customer").alias("problem"), "n"))


@query("option_gap_anti", "SELECT o_orderpriority AS series, count(*) AS n, count(*) FILTER (NOT a AND NOT b AND NOT c) AS lacks_all, count(*) FILTER (NOT a OR NOT b OR NOT c) AS lacks_any FROM (SELECT o_orderpriority, coalesce(bool_or(l_returnflag = 'A'), false) AS a, coalesce(bool_or(l_returnflag = 'N'), false) AS b, coalesce(bool_or(l_returnflag = 'R'), false) AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority) GROUP BY o_orderpriority")
def option_gap_anti(spark, sf_dir):
    """Which kinds of children an order has, in one aggregation of the children and one left join."""
    flag = lambda f: F.bool_or(F.col("l_returnflag") == f)
    kinds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(flag("A").alias("a"), flag("N").alias("b"), flag("R").alias("c"))
    rows = table(spark, sf_dir, "orders").join(kinds, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(False, ["a", "b", "c"])
    return rows.groupBy(F.col("o_orderpriority").alias("series")).agg(F.count("*").alias("n"), F.count_if(~F.col("a") & ~F.col("b") & ~F.col("c")).alias("lacks_all"), F.count_if(~F.col("a") | ~F.col("b") | ~F.col("c")).alias("lacks_any"))


@query("series_year_gap", "SELECT p_brand, array_to_string(list_sort(list(y)), ',') AS missing FROM (SELECT p_brand, unnest(range(min(p_size), max(p_size) + 1)) AS y FROM part GROUP BY p_brand) WHERE (p_brand, y) NOT IN (SELECT p_brand, p_size FROM part WHERE p_partkey % 5 = 0) GROUP BY p_brand")
def series_year_gap(spark, sf_dir):
    """Each series spans its own first to last value, exploded in place; what exists is taken off by an anti join."""
    part = table(spark, sf_dir, "part")
    spans = part.groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    wanted = spans.select("p_brand", F.explode(F.sequence("low", "high")).alias("y"))
    have = part.where("p_partkey % 5 = 0").select("p_brand", F.col("p_size").alias("y")).distinct()
    return wanted.join(have, ["p_brand", "y"], "left_anti").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("y")).cast("array<string>"), ",").alias("missing"))


#: Rules in order: keyword, name, language wildcard or code.
CATALOG = [("apache license", "Apache", "*"), ("mit license", "MIT", "*"), ("general public", "GPL", "en"), ("cc by", "CC", "*"), ("general public", "GPL (other)", "*")]


@query("keyword_catalog_match", "WITH r(k, word, name, lang) AS (VALUES " + ", ".join(f"({i}, '{w}', '{n}', '{x}')" for i, (w, n, x) in enumerate(CATALOG)) + ") SELECT doc_id, min_by(name, k) AS name FROM documents d JOIN r ON contains(lower(text), word) AND (r.lang = '*' OR r.lang = d.lang) GROUP BY doc_id")
def keyword_catalog_match(spark, sf_dir):
    """The first rule that fits; rules are a short parameter, so they are an expression and no join."""
    fits = lambda w, x: F.contains(F.lower("text"), F.lit(w)) & (F.lit(x == "*") | (F.col("lang") == x))
    name = F.coalesce(*[F.when(fits(w, x), n) for w, n, x in CATALOG])
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).where("name is not null")


@query("known_packages", "SELECT p_partkey, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ',') AS packages FROM (SELECT p_partkey, coalesce(a, []) || coalesce(b, []) AS u FROM part LEFT JOIN (SELECT p_brand, list_sort(list(DISTINCT p_size % 3)) AS a FROM part GROUP BY p_brand) USING (p_brand) LEFT JOIN (SELECT p_brand, p_type, list_sort(list(DISTINCT p_size % 7)) AS b FROM part GROUP BY ALL) USING (p_brand, p_type))")
def known_packages(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    by_make = part.groupBy("p_brand").agg(F.array_sort(F.collect_set(F.col("p_size") % 3)).alias("a"))
    by_model = part.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set(F.col("p_size") % 7)).alias("b"))
    rows = part.join(by_make, "p_brand", "left").join(by_model, ["p_brand", "p_type"], "left")
    return rows.select("p_partkey", F.array_join(F.array_union("a", "b").cast("array<string>"), ",").alias("packages"))


@query("candidate_restrict", "WITH c AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings) SELECT p_partkey, p_brand, rank FROM c JOIN part ON p_partkey = vec_id WHERE rank <= 100")
def candidate_restrict(spark, sf_dir):
    """The hundred best candidates with their ranks; a sort with a limit, then numbers for its hundred rows."""
    top = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].alias("x")).orderBy(F.desc("x"), "vec_id").limit(100)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("x")).alias("m"), "vec_id"))).alias("all")).select(F.posexplode("all").alias("pos", "v"))
    return ranked.select((F.col("pos") + 1).cast("long").alias("rank"), F.col("v.vec_id").alias("p_partkey")).join(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_brand", "rank")


@query("site_manifest_match", "WITH m AS (SELECT regexp_replace(url, '[?#].*$', '') AS root, min(page_id) AS id FROM pages WHERE page_id % 3 = 0 GROUP BY 1) SELECT p.page_id, coalesce(a.id, b.id) AS manifest_id FROM pages p LEFT JOIN m a ON a.root = p.url LEFT JOIN m b ON b.root = regexp_replace(p.url, '[?#].*$', '')")
def site_manifest_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("url", r"[?#].*$", "").alias("final"))
    manifest = pages.where("page_id % 3 = 0").groupBy(F.col("final").alias("root")).agg(F.min("page_id").alias("id"))
    rows = pages.join(manifest.withColumnsRenamed({"root": "url", "id": "by_root"}), "url", "left").join(manifest.withColumnsRenamed({"root": "final", "id": "by_final"}), "final", "left")
    return rows.select("page_id", F.coalesce("by_root", "by_final").alias("manifest_id"))


@query(
    "geocode_dim",
    """WITH p AS (SELECT 'City' || (s_suppkey % 20) AS city, 'N' || s_nationkey AS state, s_acctbal AS lat FROM supplier), e AS (SELECT city, state, median(lat) AS lat FROM p GROUP BY ALL), a AS (SELECT city, median(lat) AS lat FROM p GROUP BY city)
    SELECT c_custkey, round(coalesce(e.lat, a.lat), 6) AS lat, CASE WHEN e.lat IS NOT NULL THEN 'exact' WHEN a.lat IS NOT NULL THEN 'city' END AS how FROM (SELECT c_custkey, 'City' || (c_custkey % 25) AS city, 'N' || c_nationkey AS state FROM customer) c LEFT JOIN e USING (city, state) LEFT JOIN a USING (city)""",
)
def geocode_dim(spark, sf_dir):
    """Median of the places of city and state, else of the city."""
    name = lambda k, n: F.concat(F.lit("City"), (F.col(k) % n).cast("string"))
    places = table(spark, sf_dir, "supplier").select(name("s_suppkey", 20).alias("city"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("state"), "s_acctbal")
    exact = places.groupBy("city", "state").agg(F.median("s_acctbal").alias("by_state"))
    city = places.groupBy("city").agg(F.median("s_acctbal").alias("by_city"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name("c_custkey", 25).alias("city"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("state"))
    rows = rows.join(exact, ["city", "state"], "left").join(city, "city", "left")
    return rows.select("c_custkey", F.round(F.coalesce("by_state", "by_city"), 6).alias("lat"), F.when(F.col("by_state").isNotNull(), "exact").when(F.col("by_city").isNotNull(), "city").alias("how"))


@query("dummy_purge", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL")
def dummy_purge(spark, sf_dir):
    bad = table(spark, sf_dir, "supplier").where("s_acctbal < 0")
    return table(spark, sf_dir, "lineitem").join(bad, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(
    "fuzzy_duplicates",
    """WITH n AS (SELECT c_custkey AS id, c_nationkey AS block, ['store', (c_custkey % 40) || '', lower(c_mktsegment)] AS x FROM customer),
    p AS (SELECT a.id AS a, b.id AS b, list_intersect(a.x, b.x) AS same, a.x AS x, b.x AS y FROM n a JOIN n b ON a.block = b.block AND a.id < b.id)
    SELECT b AS id, min(a) AS duplicate_of FROM p WHERE 200.0 * length(array_to_string(same, '')) / (length(array_to_string(x, '')) + length(array_to_string(y, ''))) >= 88 GROUP BY b""",
)
def fuzzy_duplicates(spark, sf_dir):
    """Records of one nation whose names' token sets are alike to 88 %; a record points to the least one that it resembles."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("block"), F.concat(F.lit("store "), (F.col("c_custkey") % 40).cast("string"), F.lit(" "), F.lower("c_mktsegment")).alias("name"))
    return Z.duplicates(rows, "id", ["block"], "name", 88)
