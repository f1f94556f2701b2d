"""Mechanical specs from the HTML of a vehicle's page: JSON-LD first, then header and value cells of tables and lists by their place, then texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {"cylinders": "int", "transmission": "string", "drivetrain": "string", "mpg_city": "int", "mpg_highway": "int"}
#: Levels of a JSON-LD block in which vehicles are looked for.
DEPTH = 4
# Labels, and patterns of what they stand beside.
MPG_LABEL, ENGINE_LABEL, SHIFT_LABEL, DRIVE_LABEL = r"mpg|fuel\s+economy", "cyl|engine", "trans", "drive"
PAIR = r"(\d{1,2})\s*[/|–-]\s*(\d{1,2})"
MPG_TEXT = r"(?i)(?:mpg|fuel\s+economy|fuel\s+economy\s*est)[^\d]{0,16}(\d{1,2})\s*[/|–-]\s*(\d{1,2})"
CITY_TEXT, HIGHWAY_TEXT = r"""(?i)city_?fuel_?economy['"]?\s*[:=]\s*['"]?(\d{1,2})""", r"""(?i)highway_?fuel_?economy['"]?\s*[:=]\s*['"]?(\d{1,2})"""
CYLINDERS = r"(?i)(?:^|[^\d])(\d)\s*[-\s]?(?:cyl|cylinder| cyl)"
ELECTRIC = r"\bEV\b|ELECTRIC|BEV\b|KWH"
LAYOUT = r"(?i)\b(V6|V8|V10|V12|I4|I6|I3)\b"
VEHICLE = "vehicle|car|automobile|product"
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
# End of the fixed values.


def text_of(html: Column) -> Column:
    """What a piece of HTML shows, blanks collapsed."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, sign in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def cylinders(engine: Column) -> Column:
    """The cylinders that an engine's text tells; 0 for an electric one."""
    number = F.nullif(F.regexp_extract(engine, CYLINDERS, 1), F.lit("")).cast("int")
    layout = F.nullif(F.regexp_extract(engine, LAYOUT, 1), F.lit(""))
    return F.coalesce(number, F.when(F.upper(engine).rlike(ELECTRIC), 0), F.substring(layout, 2, 2).cast("int"))


def pairs(html: Column) -> Column:
    """array<struct<label, value>> of a page's lists and tables, in order.

    A table whose first row has header cells only, and further rows, gives each header with the cell below it; of other rows the first cell is the second's label.
    """
    cell = lambda row: F.regexp_extract_all(row, F.lit(r"(?is)<t[hd](?:\s[^>]*)?>(.*?)</t[hd]>"), F.lit(1))
    pair = lambda label, value: F.struct(text_of(label).alias("label"), text_of(value).alias("value"))
    lists = F.regexp_extract_all(html, F.lit(r"(?is)<dt(?:\s[^>]*)?>.*?</dt>\s*<dd(?:\s[^>]*)?>.*?</dd>"), F.lit(0))
    terms = F.transform(lists, lambda x: pair(F.regexp_extract(x, "(?is)<dt(?:\\s[^>]*)?>(.*?)</dt>", 1), F.regexp_extract(x, "(?is)<dd(?:\\s[^>]*)?>(.*?)</dd>", 1)))
    tables = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<table(?:\s[^>]*)?>(.*?)</table>"), F.lit(1)), lambda t: F.regexp_extract_all(t, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"), F.lit(1)))
    headed = lambda rows: (F.size(rows) > 1) & ~F.get(rows, F.lit(0)).rlike("(?i)<td")
    below = lambda rows: F.flatten(F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda r: F.transform(cell(r), lambda c, i: pair(F.get(cell(F.get(rows, F.lit(0))), i), c))))
    beside = lambda rows: F.transform(F.filter(rows, lambda r: F.size(cell(r)) >= 2), lambda r: pair(F.get(cell(r), F.lit(0)), F.get(cell(r), F.lit(1))))
    found = F.concat(terms, F.flatten(F.transform(tables, lambda rows: F.when(headed(rows), below(rows)).otherwise(beside(rows)))))
    return F.filter(found, lambda p: (F.coalesce(p["label"], F.lit("")) != "") & (p["value"] != "") & (F.length(p["label"]) < 80) & (F.length(p["value"]) < 400))


def by_label(found: Column) -> dict[str, Column]:
    """The specs of (label, value) pairs; the first label that tells one wins, the last value of a label that comes twice."""
    label, value = lambda p: F.lower(p["label"]), lambda p: p["value"]
    held = F.transform(found, lambda p: F.struct(p["label"].alias("label"), F.element_at(F.filter(found, lambda o: o["label"] == p["label"]), -1)["value"].alias("value")))
    first = lambda fits, take: F.get(F.filter(F.transform(F.filter(held, fits), take), lambda x: x.isNotNull()), F.lit(0))
    mpg = lambda p: label(p).rlike(MPG_LABEL) & value(p).rlike(PAIR)
    return {
        "cylinders": first(lambda p: label(p).rlike(ENGINE_LABEL) & ~label(p).contains("mpg"), lambda p: cylinders(value(p))), "transmission": first(lambda p: label(p).rlike(SHIFT_LABEL) & (F.length(value(p)) < 200), value),
        "drivetrain": first(lambda p: label(p).rlike(DRIVE_LABEL) & (F.length(value(p)) < 120), value),
        "mpg_city": first(mpg, lambda p: F.regexp_extract(value(p), PAIR, 1).cast("int")), "mpg_highway": first(mpg, lambda p: F.regexp_extract(value(p), PAIR, 2).cast("int")),
    }


def linked_data(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, cylinders, transmission, drivetrain) of the vehicles in pages' JSON-LD blocks, the first that tells each; blocks that don't parse are passed over."""
    spark = pages.sparkSession
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    level = pages.select(F.col(key).alias("k"), F.posexplode(blocks).alias("n", "j")).select("k", F.format_string("%04d", "n").alias("path"), F.try_parse_json(F.trim("j")).alias("v")).where("v IS NOT NULL")
    levels = [level]
    for _ in range(DEPTH):  # only pages with such blocks have rows
        level = spark.sql("SELECT k, path || format_string('/%04d', e.pos) AS path, e.value AS v FROM {level}, LATERAL variant_explode(v) AS e", level=level)
        levels.append(level)
    get = lambda p: F.expr(f"nullif(trim(try_variant_get(v, '{p}', 'string')), '')")
    named = lambda n: F.coalesce(F.when(F.expr(f"schema_of_variant(try_variant_get(v, '$.{n}', 'variant'))") == "STRING", get(f"$.{n}")), get(f"$.{n}.name"), get(f"$.{n}.value"), get(f"$.{n}.description"))
    kinds = F.lower(F.expr("""coalesce(to_json(try_variant_get(v, '$["@type"]', 'variant')), '')"""))
    nodes = reduce(DataFrame.unionByName, levels).where(kinds.rlike(VEHICLE) | get("$.vehicleIdentificationNumber").isNotNull() | get("$.vin").isNotNull())
    told = nodes.select("k", "path", cylinders(F.left(named("vehicleEngine"), F.lit(500))).alias("cylinders"), F.left(F.coalesce(named("vehicleTransmission"), named("transmission")), F.lit(200)).alias("transmission"), F.left(named("driveWheelConfiguration"), F.lit(120)).alias("drivetrain"))
    return told.groupBy(F.col("k").alias(key)).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("path"))).alias(c) for c in ("cylinders", "transmission", "drivetrain")])


def page_specs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, FIELDS, price): specs of each page, from the surest source that tells them, and the first price in its text."""
    page = F.col(html)
    labels = by_label(F.col("_pairs"))
    number = lambda p, g=1: F.nullif(F.regexp_extract(page, p, g), F.lit("")).cast("int")
    seen = pages.select(key, html, pairs(page).alias("_pairs")).select(key, html, *[c.alias(f"_{n}") for n, c in labels.items()])
    city = F.coalesce("_mpg_city", number(MPG_TEXT))
    rows = seen.select(
        F.col(key), "_cylinders", "_transmission", "_drivetrain", F.coalesce(city, number(CITY_TEXT)).alias("mpg_city"), F.coalesce("_mpg_highway", F.when(F.col("_mpg_city").isNull(), number(MPG_TEXT, 2)), number(HIGHWAY_TEXT)).alias("mpg_highway"),
        F.replace(F.regexp_extract(text_of(page), r"\$\s*([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("long").alias("price"),
    )
    data = linked_data(pages, key, html).withColumnRenamed(key, "_key")
    joined = rows.join(data, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in ("cylinders", "transmission", "drivetrain")], "mpg_city", "mpg_highway", "price")
