"""The driver's tables, and the listing view that the inventory operators run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The clock of every rule that needs one; nothing reads the real time.
AS_OF = "2001-09-01 00:00:00"

#: Arrival order of listing rows.
ARRIVAL = ["scraped_at", "r_partkey", "r_suppkey", "r_quantity", "r_extendedprice", "r_discount", "r_tax"]

#: Listing columns whose expressions read alike in Spark SQL and DuckDB.
SHARED = {
    "vin": "'V' || lpad(cast(l_orderkey as string), 12, '0') || lpad(cast(l_linenumber as string), 4, '0')",
    "make": "p_brand",
    "model": "p_type",
    "title": "p_name",
    "trim": "split_part(p_name, ' ', 2)",
    "price": "case when l_discount >= 0.09 then null when l_discount < 0.01 then cast(0 as double) else l_extendedprice end",
    "msrp": "p_retailprice",
    "mileage": "cast(l_quantity * 1000 as int)",
    "year": "cast(year(l_shipdate) as int)",
    "exterior_color": "split_part(p_name, ' ', 1)",
    "interior_color": "case l_returnflag when 'A' then 'N/A' when 'N' then 'Jet Black' else 'Cognac leather' end",
    "transmission": "case when p_size % 7 = 0 then '--' when p_size % 2 = 0 then 'Automatic' else 'CVT' end",
    "drivetrain": "case when p_size % 5 = 0 then 'unknown' when p_size % 3 = 0 then 'AWD' else 'FWD' end",
    "cylinders": "cast(p_size % 9 as int)",
    "fuel_type": "case when p_size % 11 = 0 then '' when p_size % 4 = 0 then 'Diesel' else 'Gasoline' end",
    "body_style": "p_type",
    "n_photos": "cast(l_linenumber % 5 as int)",
    "dealer_id": "'d' || cast(l_suppkey as string)",
    "dealer_name": "s_name",
    "country": "n_name",
    "listing_active": "l_linestatus = 'O'",
    "scraped_at": "l_shipdate",
    "first_seen_at": "o_orderdate",
    "r_partkey": "l_partkey",
    "r_suppkey": "l_suppkey",
    "r_quantity": "l_quantity",
    "r_extendedprice": "l_extendedprice",
    "r_discount": "l_discount",
    "r_tax": "l_tax",
}
#: Columns of the tables that listings are made of, and the order of arrival by them.
READ = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "p_brand", "p_type", "p_name", "p_size", "p_retailprice", "s_name", "n_name", "o_orderdate"]
ARRIVED = [SHARED[c] for c in ARRIVAL]
PHOTOS = "transform(filter(array(0, 1, 2, 3, 4), i -> i < n_photos), i -> 'https://img.example/' || vin || '/' || cast(i as string) || '.jpg')"
PHOTOS_SQL = "list_transform(range(n_photos), lambda i: 'https://img.example/' || vin || '/' || i || '.jpg')"

LISTING_SQL = (
    "SELECT *, CASE WHEN n_photos > 0 THEN gallery[1] ELSE '/static/placeholder.svg' END AS image_url FROM (SELECT *, " + PHOTOS_SQL + " AS gallery FROM (SELECT "
    + ", ".join(f"{e.replace('as string', 'as varchar')} AS {c}" for c, e in SHARED.items())
    + " FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey LEFT JOIN orders ON o_orderkey = l_orderkey))"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing_rows(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """(vin, READ): line items, joined to part, supplier, nation and order. They are narrow: steps that take one row of a VIN (by ARRIVED) move these and have them described afterwards.
 Small sides are left to Spark's size estimates.
    Orders come first: line items are narrow then, and names of parts and suppliers, which come last, don't move to the orders.

    With `items` (line items, or some of them) the orders aren't joined and rows have no o_orderdate: for steps that don't ask for the first sight of a listing.
    An order gives nothing else but copies of a row, where its key comes more than once (see with_copies()).
    """
    dated = items is None
    if items is None:
        items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = (
        items.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return rows.selectExpr(f"{SHARED['vin']} as vin", *[c for c in READ if dated or c != "o_orderdate"])


def with_copies(items: DataFrame, repeated: DataFrame) -> DataFrame:
    """Line items, as often as their order comes: repeated (o_orderkey, copies) has the orders that come more than once."""
    rows = items.join(repeated, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select(*items.columns, F.explode(F.array_repeat(F.lit(True), F.coalesce("copies", F.lit(1)).cast("int"))).alias("_copy")).drop("_copy")


def repeated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, copies) of the order keys that come more than once, none as a rule."""
    return table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count("*").alias("copies")).where("copies > 1")


def described(rows: DataFrame, *more: str) -> DataFrame:
    """Listings of listing_rows(), and more of their columns. Rows without an order's date have no first_seen_at."""
    shared = {c: e for c, e in SHARED.items() if e != "o_orderdate" or e in rows.columns}
    rows = rows.selectExpr(*[c if c == "vin" else f"{e} as {c}" for c, e in shared.items()], *more).withColumn("gallery", F.expr(PHOTOS))
    return rows.withColumn("image_url", F.when(F.col("n_photos") > 0, F.get("gallery", F.lit(0))).otherwise("/static/placeholder.svg"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item that has a part and a supplier."""
    return described(listing_rows(spark, sf_dir))


def with_listings(sql: str, *more: str) -> str:
    """DuckDB SQL with the listing view as l; `more` are further common table expressions."""
    return f"WITH {', '.join([f'l AS ({LISTING_SQL})', *more])} {sql}"
