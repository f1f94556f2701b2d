"""Queries that read and write feed files. The files are written from the driver's tables first, then read as a feed would be."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.plans.catalog import query
from listingspark.plans.listing_rules import HOST_SQL, ISSUES_SQL, empty_sql, issues
from listingspark.sources import files as S
from listingspark.sources import mapping as T
from listingspark.streaming.jobs import scratch
from listingspark.tables import listings, table, with_listings


def _written(df, name, kind, **options):
    path = scratch(df.sparkSession, name)
    df.write.options(**options).format(kind).save(path)
    return path


@query("csv_alias_scan", "SELECT p_partkey AS id, p_size AS year, p_brand AS make, p_type AS model, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE cast(p_retailprice AS DOUBLE) END AS price FROM part WHERE p_partkey % 7 <> 0")
def csv_alias_scan(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    feed = part.select(F.col("p_partkey").alias("﻿ID"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("Model Year"), F.col("p_brand").alias("MAKE"), F.col("p_type").alias("modelName"), F.when(F.col("p_partkey") % 10 == 0, "call").otherwise(F.col("p_retailprice").cast("string")).alias("Price"))
    path = _written(feed, "alias", "csv", header=True)
    aliases = {"id": ([], "long"), "year": (["Model Year", "yr"], "int"), "make": ([], "string"), "model": (["modelName"], "string"), "price": ([], "double")}
    return S.csv_by_alias(spark, path, aliases, ["year", "make", "model"])


@query("csv_manifest_ingest", "SELECT p_partkey AS id, p_size AS model_year, CASE WHEN p_partkey % 3 = 0 THEN 'row' ELSE 'file' END AS source, CASE WHEN p_size BETWEEN 5 AND 40 THEN 'ok' ELSE 'year_outside_manifest' END AS outcome FROM part")
def csv_manifest_ingest(spark, sf_dir):
    feed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Part"), F.col("p_size").alias("Yr"), F.when(F.col("p_partkey") % 3 == 0, "row").alias("Src"))
    good, bad = S.csv_by_manifest(spark, _written(feed, "manifest", "csv", header=True), {"id": "Part", "model_year": "Yr", "source": "Src"}, "model_year", (5, 40), "file")
    both = good.withColumn("outcome", F.lit("ok")).unionByName(bad.withColumnRenamed("reason", "outcome"))
    return both.select(F.col("id").cast("long").alias("id"), "model_year", "source", "outcome")


@query("json_bundle_normalize", "SELECT l_orderkey AS order_key, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS sort_order, l_partkey AS part FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)")
def json_bundle_normalize(spark, sf_dir):
    """Orders as nested JSON, one a line; the place in the array is the sort order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    nested = lines.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("packages"))
    rows = S.json_bundles(spark, _written(nested, "bundles", "json"), "order_key long, packages array<struct<l_linenumber:int,l_partkey:long,l_suppkey:long>>")
    return rows.select("order_key", F.posexplode_outer("packages").alias("sort_order", "p")).select("order_key", "sort_order", F.col("p.l_partkey").alias("part"))


@query("payload_list_pick", "SELECT l_orderkey AS k, count(*) AS n, min('V' || l_partkey) AS first_vin FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3")
def payload_list_pick(spark, sf_dir):
    """Payloads with a decoy list of links beside a deeper list of vehicles."""
    by = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("vin"))).alias("vehicles"), F.collect_list(F.struct(F.col("l_suppkey").alias("href"))).alias("links"))
    payloads = by.select("k", F.to_json(F.struct(F.struct(F.struct("vehicles").alias("inventory")).alias("data"), "links")).alias("payload"))
    return S.largest_vehicle_lists(payloads, "k", "payload").groupBy("k").agg(F.count("*").alias("n"), F.min("vin").alias("first_vin"))


# ---------------------------------------------------------------- dialects by a table of paths

VALUES = {
    "vin": "'V' || p_partkey", "stock_number": "'S' || p_partkey", "year": "2000 + p_size % 20", "make": "p_brand", "model": "p_type", "trim": "split_part(p_name, ' ', 2)", "price": "1000 + p_partkey % 5000", "msrp": "2000 + p_size",
    "mileage": "p_size * 1000", "exterior_color": "split_part(p_name, ' ', 1)", "interior_color": "'Cognac ' || p_size", "body_style": "p_type", "fuel_type": "CASE WHEN p_size % 2 = 0 THEN 'Gasoline' ELSE 'Diesel' END", "transmission": "'Automatic ' || p_size",
    "drivetrain": "CASE WHEN p_size % 3 = 0 THEN 'AWD' ELSE 'FWD' END", "cylinders": "p_size % 9", "image_url": "'https://img.example/' || p_partkey", "zip_code": "10000 + p_partkey % 80000", "history_url": "'https://history.example/' || p_partkey",
    "engine_description": "p_size || ' cylinders of steel'", "condition": "CASE WHEN p_size % 2 = 0 THEN 'Used' ELSE 'New' END", "mpg_city": "15 + p_size % 20", "mpg_highway": "20 + p_size % 20",
}


def payload_text(fields: dict[str, list[str]]) -> str:
    """An SQL text of a vehicle's JSON, alike in both dialects of SQL: each field under two of its places, by the part's number; the first holds junk for every fifth part."""
    once = Counter(path.partition(".")[0] for paths in fields.values() for path in paths if not path.startswith("@"))
    groups: dict[str, list[str]] = {"": [], "@": []}
    for i, (field, paths) in enumerate(fields.items()):
        own = [p for p in paths if p.startswith("@") or "." in p or once[p] == 1]
        for second in range(min(2, len(own))):
            name = f"split_part('{'|'.join(own)}', '|', cast((p_partkey + {i + second}) % {len(own)} as int) + 1)"
            value = f"cast({VALUES[field]} AS string)" if second else f"CASE WHEN (p_partkey + {i}) % 5 = 0 THEN ' N/A ' ELSE cast({VALUES[field]} AS string) END"
            outer = {p.rpartition(".")[0] if not p.startswith("@") else "@" for p in own}
            for group in outer:
                here = {"": f"{name} NOT LIKE '@%' AND {name} NOT LIKE '%.%'", "@": f"{name} LIKE '@%'"}.get(group, f"{name} LIKE '{group}.%'")
                leaf = name if group == "" else f"substring({name}, {len(group) + (group != '@') + 1})"
                made = f"""'{{"name": "' || upper({leaf}) || ' ", "value": "' || {value} || '"}}'""" if group == "@" else f"""'"' || {leaf} || '": "' || {value} || '"'"""
                groups.setdefault(group, []).append(made if outer == {""} else f"CASE WHEN {here} THEN {made} END")
    parts = groups.pop("")
    attributes = groups.pop("@")
    if attributes:
        parts.append("""'"trackingAttributes": [' || concat_ws(', ', """ + ", ".join(attributes) + ") || ']'")
    parts += [f"""nullif('"{name}": {{' || concat_ws(', ', {", ".join(members)}) || '}}', '"{name}": {{}}')""" for name, members in groups.items()]
    return "'{' || concat_ws(', ', " + ", ".join(parts) + ") || '}'"


PAYLOADS = {provider: payload_text(fields) for provider, fields in T.DIALECTS.items()}
PAYLOAD_TEXT = f"CASE p_partkey % 3 WHEN 0 THEN {PAYLOADS['com']} WHEN 1 THEN {PAYLOADS['on']} ELSE '{{\"vin\": \"unknown\"}}' END"


def _field_sql(field: str, paths: list[str]) -> str:
    picks = []
    for path in paths:
        if path.startswith("@"):
            nk = "regexp_replace(lower(x->>'$.name'), '[^a-z0-9]+', '', 'g')"
            found = f"""list_transform(list_filter(json_extract(j, '$.trackingAttributes[*]'), lambda x: contains({nk}, '{path[1:]}') OR (length({nk}) >= 5 AND contains('{path[1:]}', {nk}))), lambda x: trim(x->>'$.value'))"""
            picks.append(f"list_filter({found}, lambda v: {_usable_sql(field, 'v')})[1]")
        else:
            place = "$." + ".".join(f'"{n}"' for n in path.split("."))
            value = f"nullif(trim(json_extract_string(j, '{place}')), '')"
            picks.append(f"CASE WHEN json_type(j, '{place}') NOT IN ('OBJECT', 'ARRAY') AND {_usable_sql(field, value)} THEN {value} END")
    return "coalesce(" + ", ".join(picks) + ")"


def _number_sql(v: str) -> str:
    return f"try_cast(nullif(regexp_replace({v}, '[^0-9.]', '', 'g'), '') AS DOUBLE)"


def _usable_sql(field: str, v: str) -> str:
    return f"{_number_sql(v)} > 0" if field in T.WHOLE + T.DECIMAL else f"NOT {empty_sql(v)}"


def _column_sql(field: str, provider: str) -> str:
    paths = T.DIALECTS[provider].get(field)
    text = _field_sql(field, paths) if paths else "NULL"
    return f"{_number_sql(text)}::INTEGER" if field in T.WHOLE and paths else f"{_number_sql(text)}" if field in T.DECIMAL and paths else text


@query(
    "vehicle_json_map",
    f"WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'on' ELSE 'gone' END AS provider, ({PAYLOAD_TEXT})::JSON AS j FROM part) SELECT p_partkey, provider, "
    + ", ".join(f"CASE WHEN provider = 'com' THEN {_column_sql(f, 'com')} ELSE {_column_sql(f, 'on')} END AS {f}" for f in T.fields_of(T.DIALECTS)) + " FROM r WHERE provider <> 'gone'",
)
def vehicle_json_map(spark, sf_dir):
    """Vehicles of two dialects, each field under some of its names, to listing columns; an unknown provider gives nothing."""
    part, kind = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    texts = {"com": F.expr(PAYLOADS["com"]), "on": F.expr(PAYLOADS["on"]), "gone": F.lit('{"vin": "unknown"}')}
    feeds = [part.where(kind == i).select("p_partkey", F.lit(name).alias("provider"), text.alias("payload")) for i, (name, text) in enumerate(texts.items())]
    return T.mapped_by_table(feeds[0].unionByName(feeds[1]).unionByName(feeds[2]), "p_partkey", "provider", "payload")


#: Names under which pages' scripts assign their state, in the order in which they are tried.
STATES = [r"__PRELOADED_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>", r"InventoryData\s*=\s*(\{.*?\})\s*;?\s*</script>", r"__INITIAL_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>", r"vehicleList\s*=\s*(\[.*?\])\s*;?\s*</script>", r'<script[^>]*id="__NEXT_DATA__"[^>]*>(\{.*?\})\s*</script>']
#: Scripts planted into pages by number: each kind, one that doesn't parse before one that does, and none.
SCRIPTS = [
    '<script>window.__PRELOADED_STATE__ = {J};</script>', '<script>var InventoryData={J}</script>', '<script>window.__INITIAL_STATE__ = {J} ;</script>', '<script>let vehicleList = [{J}];</script>', '<script id="__NEXT_DATA__" type="application/json">{J}</script>',
    '<script>window.__PRELOADED_STATE__ = {broken: };</script><script>var InventoryData = {J};</script>', "",
]
STATE_TEXT = "replace(html, '</body>', replace(element_at({array}, cast(page_id % 7 + 1 as int)), '{{J}}', '{{\"item\": ' || page_id || ', \"vin\": \"p' || page_id || '\", \"words\": ' || length(html) || '}}') || '</body>')"


def _embedded_sql() -> str:
    scripts = "[" + ", ".join(f"'{x}'" for x in SCRIPTS) + "]"
    page = STATE_TEXT.format(array="").replace("element_at(, cast(page_id % 7 + 1 as int))", f"{scripts}[page_id % 7 + 1]")
    found = [f"nullif(regexp_extract(page, '(?is){p}', 1), '')" for p in STATES]
    state = "coalesce(" + ", ".join(f"CASE WHEN json_valid({f}) THEN {f} END" for f in found) + ")"
    return f"SELECT page_id, CASE WHEN starts_with(state, '[') THEN 'list' WHEN state IS NOT NULL THEN 'object' END AS kind, coalesce(state->>'$.item', state->>'$[0].item')::BIGINT AS item, coalesce(state->>'$.vin', state->>'$[0].vin') AS vin, coalesce(state->>'$.words', state->>'$[0].words')::BIGINT AS words FROM (SELECT page_id, {state} AS state FROM (SELECT page_id, {page} AS page FROM pages))"


@query("html_embedded_json", _embedded_sql())
def html_embedded_json(spark, sf_dir):
    """State that a page's script assigns; the first of five patterns whose JSON parses wins."""
    page = F.expr(STATE_TEXT.format(array="array(" + ", ".join(f"'{x}'" for x in SCRIPTS) + ")"))
    found = [F.nullif(F.regexp_extract("page", f"(?is){p}", 1), F.lit("")) for p in STATES]
    rows = table(spark, sf_dir, "pages").select("page_id", page.alias("page")).select("page_id", F.coalesce(*[F.when(F.try_parse_json(f).isNotNull(), f) for f in found]).alias("state"))
    get = lambda n: F.coalesce(F.get_json_object("state", f"$.{n}"), F.get_json_object("state", f"$[0].{n}"))
    return rows.select("page_id", F.when(F.startswith("state", F.lit("[")), "list").when(F.col("state").isNotNull(), "object").alias("kind"), get("item").cast("long").alias("item"), get("vin").alias("vin"), get("words").cast("long").alias("words"))


@query("geojson_records", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS name, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 90)::DOUBLE END AS lat, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 180)::DOUBLE END AS lon, nullif(concat_ws(',', CASE WHEN s_suppkey % 4 = 0 THEN 'no_name' END, CASE WHEN s_suppkey % 7 = 0 THEN 'no_coordinates' END), '') AS reason FROM supplier")
def geojson_records(spark, sf_dir):
    """Features under one of two names for the name, some without a name or a place; what can't be read says why. A collection holds some hundred features, however many there are."""
    rows, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    files = max(1, rows.count() // 100)
    place = F.when(key % 7 > 0, F.array((key % 180).cast("double"), (key % 90).cast("double")))
    name = F.when(key % 4 > 0, F.col("s_name"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(place.alias("coordinates")).alias("geometry"), F.struct(key.alias("id"), F.when(key % 2 == 0, name).alias("name"), F.when(key % 2 == 1, name).alias("dealerName")).alias("properties"))
    collections = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(files)).alias("file")).agg(F.collect_list(feature).alias("features")).select(F.lit("FeatureCollection").alias("type"), "features")
    schema = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<id:long,name:string,dealerName:string>>>"
    read = S.json_bundles(spark, _written(collections, "geojson", "json"), schema).select(F.explode("features").alias("f"))
    p, at = F.col("f.properties"), F.col("f.geometry.coordinates")
    named = F.coalesce(p["name"], p["dealerName"])
    reason = F.array_join(F.array_compact(F.array(F.when(R.is_empty(named), "no_name"), F.when(~F.coalesce(F.size(at) == 2, F.lit(False)), "no_coordinates"))), ",")
    return read.select(p["id"].alias("id"), named.alias("name"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lon"), F.nullif(reason, F.lit("")).alias("reason"))


@query("distinct_roots", f"SELECT DISTINCT 'https://' || {HOST_SQL} AS root FROM pages")
def distinct_roots(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(R.url_root(F.col("url")).alias("root")).where("root is not null").distinct()


@query("inventory_export", with_listings(f"SELECT dealer_id, make, model, vin, price::VARCHAR IS NOT NULL AS has_price, array_to_string({ISSUES_SQL}, ';') AS issues FROM l WHERE listing_active"))
def inventory_export(spark, sf_dir):
    """Active rows with their issues as CSV, read back."""
    rows = listings(spark, sf_dir).where("listing_active").select("dealer_id", "make", "model", "vin", F.col("price").isNotNull().alias("has_price"), F.array_join(issues(), ";").alias("issues"))
    path = _written(rows.sortWithinPartitions("dealer_id", "make", "model", "vin"), "export", "csv", header=True, emptyValue="", nullValue="\\N")
    return spark.read.schema(rows.schema).options(header=True, emptyValue="", nullValue="\\N").csv(path).fillna("", ["issues"])


@query("run_artifact_sink", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, max(event_type) AS last_type FROM events GROUP BY user_id")
def run_artifact_sink(spark, sf_dir):
    """Nested results as JSON lines, read back and flattened."""
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("event_type").alias("last_type"))
    nested = by.select("user_id", F.struct("n", F.struct("total", "last_type").alias("detail")).alias("summary"))
    back = S.json_bundles(spark, _written(nested, "artifact", "json"), "user_id long, summary struct<n:long,detail:struct<total:double,last_type:string>>")
    return back.select("user_id", "summary.n", "summary.detail.total", "summary.detail.last_type")


@query("review_queue_sink", "SELECT event_id, user_id, event_type FROM events WHERE value > 50 ORDER BY ts DESC, event_id DESC LIMIT 100")
def review_queue_sink(spark, sf_dir):
    """Two appends to a queue of JSON lines and a broken line; the newest hundred are read, without what can't be."""
    rows = table(spark, sf_dir, "events").where("value > 50").select("event_id", "user_id", "event_type", F.col("ts").cast("string").alias("ts"))
    path = scratch(spark, "queue")
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).write.mode("append").json(path)
    rows.limit(1).select(F.lit('{"event_id": broken').alias("value")).write.mode("append").text(path)
    back = spark.read.schema("event_id long, user_id long, event_type string, ts string").option("mode", "DROPMALFORMED").json(path)
    return back.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")


@query("scan_run_log", "SELECT event_id, user_id, event_type AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id % 5 <> 0) WHERE k <= 3")
def scan_run_log(spark, sf_dir):
    """Outcomes with a JSON summary, appended by day; rows without a dealer (every fifth) are skipped; the three newest of each."""
    rows = table(spark, sf_dir, "events").withColumn("dealer", F.when(F.col("user_id") % 5 != 0, F.col("user_id"))).where("dealer is not null")
    log = rows.select("event_id", "dealer", "ts", F.to_json(F.struct(F.col("event_type").alias("outcome"), "value")).alias("summary"), F.to_date("ts").alias("day"))
    path = scratch(spark, "runs")
    log.write.partitionBy("day").parquet(path)
    back = spark.read.parquet(path)
    place = F.row_number().over(Window.partitionBy("dealer").orderBy(F.desc("ts"), F.desc("event_id")))
    newest = back.withColumn("k", place).where("k <= 3")  # three rows of a dealer leave each task
    return newest.select("event_id", F.col("dealer").alias("user_id"), F.get_json_object("summary", "$.outcome").alias("outcome"))


@query("row_audit_artifact", "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'insufficient' WHEN c_acctbal < 1000 THEN 'partial' ELSE 'usable' END AS quality, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_nationkey % 5 = 0 THEN 'no_location' END) AS reasons FROM customer")
def row_audit_artifact(spark, sf_dir):
    balance = F.col("c_acctbal")
    audit = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(balance < 0, "insufficient").when(balance < 1000, "partial").otherwise("usable").alias("quality"), F.array_compact(F.array(F.when(balance < 0, "negative_balance"), F.when(F.col("c_nationkey") % 5 == 0, "no_location"))).alias("reasons"))
    back = S.json_bundles(spark, _written(audit, "audit", "json"), "id long, quality string, reasons array<string>")
    return back.select("id", "quality", F.array_join("reasons", ",").alias("reasons"))


EPA_SQL = """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS year, p_brand AS make, p_type AS name, p_size AS city, p_size + 8 AS hwy FROM part)
SELECT make, CASE WHEN year IS NULL THEN 'no_year' WHEN year < 3 THEN 'before_first_year' ELSE 'inserted' END AS outcome, CASE WHEN year >= 3 THEN split_part(name, ' ', 1) END AS series, count(*) AS n, min(CASE WHEN year >= 3 THEN trim(substr(name, length(split_part(name, ' ', 1)) + 2)) END) AS first_variant,
max(CASE WHEN year >= 3 THEN city || ' City / ' || hwy || ' Hwy' END) AS mpg, min(CASE WHEN year >= 3 THEN 'fuel-economy file, row ' || lpad(cast(p_partkey AS VARCHAR), 9, '0') END) AS provenance FROM r GROUP BY ALL"""


@query("epa_reference_load", EPA_SQL)
def epa_reference_load(spark, sf_dir):
    """A fuel-economy file, written and read as CSV: rows without a year, or before the first year wanted, are skipped and counted; names part into series and variant; each row keeps where it came from."""
    feed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Row"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("Year"), F.col("p_brand").alias("Make"), F.col("p_type").alias("Model"), F.col("p_size").alias("City"), (F.col("p_size") + 8).alias("Hwy"))
    aliases = {"row": ([], "long"), "year": ([], "int"), "make": ([], "string"), "name": (["Model"], "string"), "city": ([], "int"), "hwy": ([], "int")}
    rows = S.csv_by_alias(spark, _written(feed, "economy", "csv", header=True), aliases, ["row", "make", "name"])
    outcome = F.when(F.col("year").isNull(), "no_year").when(F.col("year") < 3, "before_first_year").otherwise("inserted")
    series = F.split_part("name", F.lit(" "), F.lit(1))
    kept = lambda c: F.when(F.col("outcome") == "inserted", c)
    rows = rows.withColumn("outcome", outcome).select(
        "make", "outcome", kept(series).alias("series"), kept(F.trim(F.substr("name", F.length(series) + 2))).alias("variant"),
        kept(F.format_string("%d City / %d Hwy", "city", "hwy")).alias("mpg"), kept(F.concat(F.lit("fuel-economy file, row "), F.lpad(F.col("row").cast("string"), 9, "0"))).alias("provenance"),
    )
    return rows.groupBy("make", "outcome", "series").agg(F.count("*").alias("n"), F.min("variant").alias("first_variant"), F.max("mpg").alias("mpg"), F.min("provenance").alias("provenance"))
