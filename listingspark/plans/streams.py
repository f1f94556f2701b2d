"""Queries that drive the streaming jobs over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.operators import merge as M
from listingspark.operators.runs import staged
from listingspark.plans.catalog import query
from listingspark.plans.listing_rules import empty_sql
from listingspark.streaming import ingest as I
from listingspark.streaming import jobs as J
from listingspark.tables import described, listing_rows, listings, repeated_orders, table, with_copies, with_listings


def events(spark, sf_dir):
    return J.file_stream(spark, f"{sf_dir}/events.parquet", "ts")


@query("raw_dedupe_stream", "SELECT user_id, event_type, count(DISTINCT (floor(value), date_trunc('day', ts))) AS n FROM events GROUP BY ALL")
def raw_dedupe_stream(spark, sf_dir):
    """Fingerprints of user, type, day and whole value, once each; a fingerprint's state goes two days after it came."""
    rows = events(spark, sf_dir).select("ts", "user_id", "event_type", F.floor("value").alias("whole"), F.to_date("ts").cast("string").alias("day"))
    rows = rows.withColumn("fp", F.sha2(F.concat_ws("|", "user_id", "event_type", "whole", "day").cast("binary"), 256))
    return J.run_to_table(J.deduped(rows, ["fp"], "ts", "2 days"), "dedupe").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "scan_ingest_stream",
    with_listings(
        """SELECT vin, arg_max_null(price, b) AS price, arg_max_null(mileage, b) AS mileage, arg_max(trim, b) FILTER (trim IS NOT NULL) AS trim, arg_max(transmission, b) FILTER (transmission IS NOT NULL) AS transmission, arg_max(fuel_type, b) FILTER (fuel_type IS NOT NULL) AS fuel_type,
           arg_max(stock, b) FILTER (stock IS NOT NULL) AS stock_number, min(b)::INTEGER AS first_batch, max(b)::INTEGER AS last_batch, CASE WHEN max(b) < 2 THEN 'kept' WHEN min(b) = 2 THEN 'inserted' ELSE 'updated' END AS action FROM last GROUP BY vin""",
        "p AS (SELECT *, r_partkey % 3 AS b, dealer_id || '/' || year AS k, row_number() OVER (PARTITION BY r_partkey % 3, dealer_id, year ORDER BY vin, r_partkey, r_quantity, r_extendedprice, r_discount, r_tax) AS pos FROM l)",
        "n AS (SELECT b, k FROM p GROUP BY b, k HAVING count(*) >= 3)",
        f"last AS (SELECT vin, b, price, mileage, trim, transmission, fuel_type, stock FROM (SELECT vin, b, CASE WHEN price > 0 THEN round(price) END AS price, CASE WHEN mileage > 0 THEN mileage END AS mileage, trim, CASE WHEN NOT {empty_sql('transmission')} THEN transmission END AS transmission, CASE WHEN NOT {empty_sql('fuel_type')} THEN fuel_type END AS fuel_type, CASE WHEN r_partkey % 2 = 0 THEN 'S' || r_partkey END AS stock, row_number() OVER (PARTITION BY vin, b ORDER BY k DESC, pos DESC) AS r FROM p JOIN n USING (b, k)) WHERE r = 1)",
    ),
)
def scan_ingest_stream(spark, sf_dir):
    """Three days of captured payloads (of a dealer and year, in two dialects) folded into a snapshot, each day by a run of its own that goes on from the folder's checkpoint."""
    # no field of a payload asks for an order; an order's key that comes twice makes two of a row, which counts in how many vehicles a payload has
    items = with_copies(table(spark, sf_dir, "lineitem"), staged(repeated_orders(spark, sf_dir), "repeated"))
    rows = described(listing_rows(spark, sf_dir, items)).withColumn("b", F.col("r_partkey") % 3)
    field = lambda name, c: c.alias(name)
    # rows move once each, in the order of their first columns; the dialect's names come to them in the payload
    car = F.struct("vin", "r_partkey", "r_quantity", "r_extendedprice", "r_discount", "r_tax", F.round("price").cast("long").alias("price"), "mileage", "trim", "transmission", "fuel_type")
    cars = rows.groupBy("b", "dealer_id", "year").agg(F.sort_array(F.collect_list(car)).alias("cars"))
    stock = lambda c: F.when(c["r_partkey"] % 2 == 0, F.concat(F.lit("S"), c["r_partkey"].cast("string")))
    com = lambda c: F.struct(field("vin", c["vin"]), field("stockNumber", stock(c)), field("pricing", F.struct(c["price"].alias("finalPrice"))), field("odometer", c["mileage"]), field("trimName", c["trim"]), field("transmissionType", c["transmission"]), field("fuelType", c["fuel_type"]))
    on = lambda c: F.struct(field("VIN", c["vin"]), field("stock", stock(c)), field("internetPrice", c["price"]), field("miles", c["mileage"]), field("trim", c["trim"]), field("transmission", c["transmission"]), field("fuel_type", c["fuel_type"]))
    odd = F.col("year") % 2 == 1
    page = lambda named: F.to_json(F.struct(F.struct(F.struct(F.transform("cars", named).alias("vehicles"), F.lit(3).alias("total")).alias("inventory")).alias("data"), F.array(F.struct(F.lit("/a").alias("href"))).alias("links")))
    payloads = cars.select("b", F.concat_ws("/", "dealer_id", F.col("year").cast("string")).alias("k"), F.when(odd, "on").otherwise("com").alias("provider"), F.when(odd, page(on)).otherwise(page(com)).alias("payload"))
    source, folder = J.scratch(spark, "payloads"), J.scratch(spark, "ingest")
    for day in range(3):
        payloads.where(F.col("b") == day).drop("b").write.mode("append").json(source)
        snapshot = I.ingested(spark, source, folder, day)
    return snapshot.select("vin", "price", "mileage", "trim", "transmission", "fuel_type", "stock_number", "first_batch", "last_batch", "action")


@query("price_change_state", "SELECT user_id AS key, count(*) AS changes FROM (SELECT user_id, v IS DISTINCT FROM lag(v) OVER (PARTITION BY user_id ORDER BY ts, v) AS moved FROM (SELECT user_id, ts, round(value / 25) AS v FROM events)) WHERE moved GROUP BY user_id")
def price_change_state(spark, sf_dir):
    """How often each key's value (in steps of 25) changed."""
    rows = events(spark, sf_dir).withColumn("v", F.round(F.col("value") / 25))
    return J.run_to_table(J.price_changes(rows, "user_id", "ts", "v"), "prices").groupBy("key").agg(F.count("*").alias("changes"))


@query("rate_limit_window")
def rate_limit_window(spark, sf_dir):
    """Two events in six hours for each user; sequential by nature, so tests hold it against a loop."""
    return J.run_to_table(J.allowed_events(events(spark, sf_dir), "user_id", "ts", "event_id", 2, 6 * 3600), "limits")


@query("rate_count_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_count_window(spark, sf_dir):
    """The batch companion of the limit: all events of the user in the six hours up to each."""
    from pyspark.sql import Window

    window = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3600 * 1_000_000, 0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.count("*").over(window).alias("n"))


@query("run_log_stream", "SELECT cast(date_trunc('day', ts) AS VARCHAR) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY ALL")
def run_log_stream(spark, sf_dir):
    """Daily counts by type; the last day may still change and isn't emitted."""
    out = J.run_to_table(J.window_counts(events(spark, sf_dir), "ts", "1 day", "0 seconds", "event_type"), "log")
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.date_trunc("day", F.max(F.col("ts").cast("timestamp"))).alias("last"))
    closed = out.join(F.broadcast(last), F.lit(True)).where(F.col("start") < F.col("last"))
    return closed.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n")


STALE = with_listings(
    """SELECT o.vin, o.dealer_id, o.active AND NOT (coalesce(s.outcome = 'ok', false) AND n.vin IS NULL AND m.dealer_id IS NOT NULL) AS active, m.dealer_id IS NOT NULL AS scanned FROM (SELECT vin, dealer_id, bool_or(listing_active) AS active FROM l GROUP BY ALL) o
    LEFT JOIN (SELECT dealer_id, CASE WHEN dealer_id LIKE '%3' THEN 'failed' WHEN count(*) < 8 THEN 'below_min_rows' WHEN count(*) FILTER (length(vin) = 17) = 0 THEN 'no_valid_scraped_vins' ELSE 'ok' END AS outcome FROM l WHERE r_partkey % 2 = 1 GROUP BY dealer_id) s USING (dealer_id)
    LEFT JOIN (SELECT DISTINCT dealer_id, vin FROM l WHERE r_partkey % 2 = 1) n ON n.dealer_id = o.dealer_id AND n.vin = o.vin
    LEFT JOIN (SELECT DISTINCT 'd' || cast(user_id AS VARCHAR) AS dealer_id FROM events WHERE value > 50) m ON m.dealer_id = o.dealer_id"""
)


@query("stale_unlist_stream", STALE)
def stale_unlist_stream(spark, sf_dir):
    """Each batch of scan-complete markers (events above 50 of the user with the dealer's number) unlists what these dealers' scans didn't see."""
    rows = listings(spark, sf_dir)
    first = rows.groupBy("vin", "dealer_id").agg(F.bool_or("listing_active").alias("active")).withColumn("scanned", F.lit(False))
    seen = rows.where("r_partkey % 2 = 1")
    scans = seen.groupBy("dealer_id").agg(F.count("*").alias("rows"), F.count_if(R.scanner_vin(F.col("vin")).isNotNull()).alias("valid"), F.bool_and(F.col("dealer_id").endswith("3")).alias("failed"))

    def step(batch, before):
        marked = batch.where("value > 50").select(F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("dealer_id")).distinct()
        done = M.soft_delete(first if before is None else before, seen.join(marked, "dealer_id", "left_semi"), scans.join(marked, "dealer_id", "left_semi"), "vin", "dealer_id").drop("outcome")
        return done.join(marked.withColumn("_now", F.lit(True)), "dealer_id", "left").select("vin", "dealer_id", "active", (F.col("scanned") | F.coalesce("_now", F.lit(False))).alias("scanned"))

    return J.run_by_batch(events(spark, sf_dir), "unlist", step)
