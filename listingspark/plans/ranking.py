"""Queries that pick, fold and rank rows of a key, and merge arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.operators import merge as M
from listingspark.plans.catalog import query
from listingspark.plans.listing_rules import QUALITY_SQL, empty_sql, families_sql, missing_sql
from listingspark.tables import ARRIVAL, listings, table, with_listings

ORDER = ", ".join(ARRIVAL)
FOLDED = {"trim": "text", "transmission": "text", "drivetrain": "text", "fuel_type": "text", "interior_color": "text", "exterior_color": "text", "cylinders": "positive", "msrp": "positive", "year": "positive", "mileage": "known", "price": "positive"}
OK = {"text": lambda c: f"NOT {empty_sql(c)}", "positive": lambda c: f"coalesce({c} > 0, false)", "known": lambda c: f"{c} IS NOT NULL"}


@query("last_wins_dedupe", with_listings(f"SELECT vin, price, mileage, dealer_id FROM (SELECT *, row_number() OVER (PARTITION BY trim(vin) ORDER BY {', '.join(a + ' DESC' for a in ARRIVAL)}) AS k FROM l) WHERE k = 1"))
def last_wins_dedupe(spark, sf_dir):
    return M.last_wins(listings(spark, sf_dir), "vin", ARRIVAL).select("vin", "price", "mileage", "dealer_id")


@query("fill_merge", with_listings(f"SELECT vin, count(*) AS n_rows, {', '.join(f'first({c} ORDER BY {OK[k](c)} DESC, {ORDER}) AS {c}' for c, k in FOLDED.items())} FROM l GROUP BY vin"))
def fill_merge(spark, sf_dir):
    return M.fill_merge(listings(spark, sf_dir), "vin", ARRIVAL, FOLDED)


@query("standard_config", "SELECT p_brand, p_type, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END, p_size, p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1")
def standard_config(spark, sf_dir):
    rank = F.struct(F.when(F.col("p_size") % 4 == 0, 1).otherwise(0).alias("tier"), "p_size", (-F.col("p_retailprice")).alias("mpg"), "p_partkey")
    best = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min(rank).alias("x"))
    return best.select("p_brand", "p_type", "x.p_partkey", "x.p_size")


@query(
    "visit_budget_queue",
    with_listings(
        f"""SELECT dealer_id, vin, r_partkey, need FROM (SELECT *, row_number() OVER (PARTITION BY dealer_id ORDER BY need DESC, md5(dealer_id || '|' || vin), {ORDER}) AS k FROM
        (SELECT *, CASE WHEN n_photos < 3 THEN 100 ELSE 0 END + CASE WHEN {empty_sql('transmission')} THEN 10 ELSE 0 END + CASE WHEN {empty_sql('drivetrain')} THEN 10 ELSE 0 END + CASE WHEN {empty_sql('interior_color')} THEN 10 ELSE 0 END AS need FROM l)) WHERE k <= 10"""
    ),
)
def visit_budget_queue(spark, sf_dir):
    """Ten listings for each dealer, by need; ties turn with a hash, so that other listings come up for other days' salts."""
    need = F.when(F.col("n_photos") < 3, 100).otherwise(0) + sum((F.when(R.is_empty(F.col(c)), 10).otherwise(0) for c in ("transmission", "drivetrain", "interior_color")), F.lit(0))
    rows = listings(spark, sf_dir).withColumn("need", need)
    window = Window.partitionBy("dealer_id").orderBy(F.desc("need"), F.md5(F.concat("dealer_id", F.lit("|"), "vin").cast("binary")), *ARRIVAL)
    return rows.withColumn("k", F.row_number().over(window)).where("k <= 10").select("dealer_id", "vin", "r_partkey", "need")


@query(
    "sibling_reinforce",
    """WITH s AS (SELECT page_id, regexp_extract(url, '://(?:[a-z]+[.])?([a-z-]+[.][a-z]+[.][a-z]+|[a-z-]+[.][a-z]+)', 1) AS family, regexp_extract(url, '://([^/?#]*)', 1) AS label, page_id % 3 > 0 AS assigned FROM pages),
    f AS (SELECT family, count(*) FILTER (assigned) AS n, first(label ORDER BY length(label) DESC, label) FILTER (assigned) AS best FROM s GROUP BY family)
    SELECT page_id, family, CASE WHEN assigned AND n >= 2 THEN best ELSE label END AS label, assigned AND n >= 2 AS reinforced FROM s JOIN f USING (family)""",
)
def sibling_reinforce(spark, sf_dir):
    """Assigned sites of a family with two or more take its longest label (ties: the least). Families join back as one row each."""
    family = F.regexp_extract("url", r"://(?:[a-z]+[.])?([a-z-]+[.][a-z]+[.][a-z]+|[a-z-]+[.][a-z]+)", 1)
    sites = table(spark, sf_dir, "pages").select("page_id", family.alias("family"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("label"), (F.col("page_id") % 3 > 0).alias("assigned"))
    best = sites.where("assigned").groupBy("family").agg(F.count("*").alias("n"), F.min_by("label", F.struct(-F.length("label"), "label")).alias("best"))
    strong = F.coalesce(F.col("assigned") & (F.col("n") >= 2), F.lit(False))
    return sites.join(best, "family", "left").select("page_id", "family", F.when(strong, F.col("best")).otherwise(F.col("label")).alias("label"), strong.alias("reinforced"))


@query(
    "best_candidate",
    """WITH c AS (SELECT l_orderkey AS site, l_suppkey % 7 AS canonical, round(l_discount * (0.35 + 0.65 * l_tax * 10), 6) AS score FROM lineitem), k AS (SELECT site, canonical, max(score) AS score, count(*) AS n FROM c GROUP BY ALL)
    SELECT site, canonical, score, n FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, canonical) AS r FROM k) WHERE r = 1""",
)
def best_candidate(spark, sf_dir):
    score = F.round(F.col("l_discount") * (0.35 + 0.65 * F.col("l_tax") * 10), 6)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), (F.col("l_suppkey") % 7).alias("canonical"), score.alias("score"))
    by = rows.groupBy("site", "canonical").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    return by.groupBy("site").agg(F.max_by(F.struct("canonical", "score", "n"), F.struct("score", -F.col("canonical"))).alias("x")).select("site", "x.*")


@query(
    "price_hint_pick",
    with_listings(
        """SELECT vin, coalesce(max(CASE WHEN price > 0 THEN price END), first(x.h ORDER BY x.p DESC, x.h DESC) FILTER (x.h BETWEEN 500 AND 2500000)) AS price FROM (SELECT vin, price, unnest([{'p': 2, 'h': msrp * 10}, {'p': 1, 'h': r_extendedprice}, {'p': 3, 'h': r_tax * 1000}]) AS x FROM l) GROUP BY vin"""
    ),
)
def price_hint_pick(spark, sf_dir):
    """A listing's own price, else its most trusted plausible hint."""
    hint = lambda p, c: F.struct(F.lit(p).alias("p"), c.cast("double").alias("h"))
    rows = listings(spark, sf_dir).select("vin", "price", F.explode(F.array(hint(2, F.col("msrp") * 10), hint(1, F.col("r_extendedprice")), hint(3, F.col("r_tax") * 1000))).alias("x"))
    plausible = F.col("x.h").between(500, 2500000)
    return rows.groupBy("vin").agg(F.coalesce(F.max(F.when(F.col("price") > 0, F.col("price"))), F.max(F.when(plausible, F.col("x")))["h"]).alias("price"))


@query("history_url_pick", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, first(url ORDER BY (CASE WHEN contains(url, 'utm_') THEN 0 ELSE 2 END + CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END) DESC, length(url) DESC, url) AS url FROM pages GROUP BY host")
def history_url_pick(spark, sf_dir):
    score = F.when(F.contains("url", F.lit("utm_")), 0).otherwise(2) + F.when(F.col("url").startswith("https"), 1).otherwise(0)
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.min_by("url", F.struct(-score, -F.length("url"), "url")).alias("url"))


@query("total_count_pick", "SELECT user_id, first(value ORDER BY (value > 0) DESC, length(props) DESC, value DESC, event_id DESC) AS total FROM events GROUP BY user_id")
def total_count_pick(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct((F.col("value") > 0).alias("has"), F.length("props").alias("n"), "value", "event_id")).alias("total"))


@query("recovery_ranking", with_listings(f"SELECT vin, r_partkey, points FROM (SELECT *, 100 - 10 * len({missing_sql(False)}) + CASE WHEN n_photos > 0 THEN 5 ELSE 0 END AS points, len({missing_sql(False)}) AS m FROM l) WHERE m > 0 AND points >= 60 ORDER BY points DESC, vin, {ORDER} LIMIT 200"))
def recovery_ranking(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("m", F.size(R.missing_fields()))
    rows = rows.withColumn("points", 100 - 10 * F.col("m") + F.when(F.col("n_photos") > 0, 5).otherwise(0)).where("m > 0 and points >= 60")
    return rows.orderBy(F.desc("points"), "vin", *ARRIVAL).limit(200).select("vin", "r_partkey", "points")


@query("vision_image_pick", with_listings("SELECT vin, r_partkey, CASE WHEN n_photos >= 3 THEN gallery[3] WHEN n_photos > 0 THEN gallery[1] END AS image FROM l"))
def vision_image_pick(spark, sf_dir):
    """The first image whose name ends with 2.jpg, else the first."""
    hit = F.get(F.filter("gallery", lambda u: u.rlike(r"/2\.jpg$")), F.lit(0))
    return listings(spark, sf_dir).select("vin", "r_partkey", F.coalesce(hit, F.get("gallery", F.lit(0))).alias("image"))


@query(
    "fragment_priority_merge",
    with_listings(
        f"""SELECT vin, first(value ORDER BY q DESC, priority DESC, value) FILTER (field = 'transmission') AS transmission, first(value ORDER BY q DESC, priority DESC, value) FILTER (field = 'fuel_type') AS fuel_type FROM
        (SELECT vin, x.f AS field, x.v AS value, CASE WHEN {empty_sql('x.v')} THEN 0 ELSE length(x.v) END AS q, r_suppkey % 3 AS priority FROM (SELECT vin, r_suppkey, unnest([{{'f': 'transmission', 'v': transmission}}, {{'f': 'fuel_type', 'v': fuel_type}}]) AS x FROM l)) GROUP BY vin"""
    ),
)
def fragment_priority_merge(spark, sf_dir):
    """For each VIN and field the value of the best text, then of the most trusted source."""
    rank = lambda c: F.struct(-F.when(R.is_empty(F.col(c)), 0).otherwise(F.length(c)), -(F.col("r_suppkey") % 3), F.col(c))
    return listings(spark, sf_dir).groupBy("vin").agg(*[F.min_by(c, rank(c)).alias(c) for c in ("transmission", "fuel_type")])


@query(
    "gallery_merge",
    with_listings(
        f"""SELECT vin, r_partkey, array_to_string(CASE WHEN n_photos < 3 THEN CASE WHEN m >= n_photos THEN b ELSE gallery END ELSE gallery || list_filter(b, lambda u: NOT list_contains(gallery, u)) END, ',') AS merged
        FROM (SELECT *, (r_suppkey % 4)::INTEGER AS m, list_transform(range(r_suppkey % 4), lambda i: 'https://img.example/' || vin || '/' || (i * 2) || '.jpg') AS b FROM l)"""
    ),
)
def gallery_merge(spark, sf_dir):
    new = F.expr("transform(filter(array(0, 1, 2), i -> i < r_suppkey % 4), i -> 'https://img.example/' || vin || '/' || cast(i * 2 as string) || '.jpg')")
    return listings(spark, sf_dir).select("vin", "r_partkey", F.array_join(M.merge_galleries(F.col("gallery"), new), ",").alias("merged"))


@query("bucket_union", with_listings(f"SELECT vin, r_partkey, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ',') AS families FROM (SELECT vin, r_partkey, {families_sql('exterior_color')} || {families_sql('interior_color')} AS u FROM l)"))
def bucket_union(spark, sf_dir):
    return listings(spark, sf_dir).select("vin", "r_partkey", F.array_join(R.allowed_union(R.color_families(F.col("exterior_color")), R.color_families(F.col("interior_color"))), ",").alias("families"))


@query("ordered_unique_keys", with_listings("SELECT vin, cast(min(scraped_at)::DATE AS VARCHAR) AS first_seen FROM l GROUP BY vin"))
def ordered_unique_keys(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("vin").agg(F.min("scraped_at").cast("date").cast("string").alias("first_seen"))


CONTACTS = "SELECT c_custkey AS id, 'Dealer ' || c_nationkey AS name, lpad(c_custkey % 97 || '', 5, '0') AS zip5, '555' || lpad(c_custkey % 13 || '', 7, '0') AS phone FROM customer"


@query("record_union_dedupe", f"SELECT name, zip5, phone, min(id) AS id FROM ({CONTACTS} WHERE c_custkey % 2 = 0 UNION ALL {CONTACTS} WHERE c_custkey % 3 = 0) GROUP BY ALL")
def record_union_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey AS id", "'Dealer ' || cast(c_nationkey AS string) AS name", "lpad(cast(c_custkey % 97 AS string), 5, '0') AS zip5", "'555' || lpad(cast(c_custkey % 13 AS string), 7, '0') AS phone")
    both = rows.where("c_custkey % 2 = 0").unionByName(rows.where("c_custkey % 3 = 0"))
    return both.groupBy("name", "zip5", "phone").agg(F.min("id").alias("id"))


@query("image_url_dedupe", with_listings("SELECT vin, r_partkey, array_to_string(list_transform(range(n_photos), lambda i: 'https://img.example/' || vin || '/' || i || '.jpg?w=1600'), ',') AS images FROM l"))
def image_url_dedupe(spark, sf_dir):
    """Each image comes in two sizes, plain http and https; the first place of each host and path keeps its largest https form."""
    variants = F.flatten(F.transform("gallery", lambda u: F.array(F.concat(F.regexp_replace(u, "^https", "http"), F.lit("?w=320")), F.concat(u, F.lit("?w=1600")))))
    rows = listings(spark, sf_dir).select("vin", "r_partkey", variants.alias("urls"))
    path = lambda u: F.regexp_replace(F.regexp_replace(u, "^https?://", ""), r"\?.*$", "")
    width = lambda u: F.regexp_extract(u, r"[?&]w=(\d+)", 1).try_cast("int")
    keys = F.array_distinct(F.transform("urls", path))
    best = F.transform(keys, lambda k: F.array_max(F.transform(F.filter("urls", lambda u: path(u) == k), lambda u: F.struct(width(u).alias("w"), u.alias("u"))))["u"])
    return rows.select("vin", "r_partkey", F.array_join(F.slice(best, 1, 48), ",").alias("images"))
