"""Projections over the listing view: cleaning, classification, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.functions import trims as TR
from listingspark.plans.catalog import query
from listingspark.tables import AS_OF, listings, table, with_listings

JUNK_SQL = "('', 'n/a', 'na', 'null', 'none', 'unknown', 'undefined', '-', '—', '--', '---', 'tbd', 'not specified', 'unspecified')"


def empty_sql(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN {JUNK_SQL})"


CLEANED = ["title", "make", "model", "trim", "exterior_color", "interior_color", "transmission", "drivetrain", "fuel_type", "body_style", "dealer_id", "dealer_name", "image_url"]


@query(
    "placeholder_null",
    with_listings("SELECT 'x' AS column_name, 0::BIGINT AS n_replaced WHERE false " + " ".join(f"UNION ALL SELECT '{c}', count(*) FILTER ({empty_sql(c)} AND {c} IS NOT NULL) FROM l" for c in CLEANED)),
)
def placeholder_counts(spark, sf_dir):
    """How many junk tokens each text column loses, in one pass."""
    found = listings(spark, sf_dir).agg(*[F.count_if(R.is_empty(F.col(c)) & F.col(c).isNotNull()).alias(c) for c in CLEANED])
    return found.unpivot([], CLEANED, "column_name", "n_replaced")


@query(
    "clean_rows",
    with_listings(
        f"""SELECT vin, r_partkey, CASE WHEN {empty_sql('transmission')} THEN NULL ELSE trim(transmission) END AS transmission, CASE WHEN {empty_sql('drivetrain')} THEN NULL ELSE trim(drivetrain) END AS drivetrain,
        CASE WHEN {empty_sql('fuel_type')} THEN NULL ELSE trim(fuel_type) END AS fuel_type, CASE WHEN {empty_sql('interior_color')} THEN NULL ELSE trim(interior_color) END AS interior_color,
        CASE WHEN image_url LIKE 'http%' THEN image_url END AS image_url, CASE WHEN cylinders >= 0 THEN cylinders END AS cylinders FROM l"""
    ),
)
def clean_rows(spark, sf_dir):
    text = {c: R.clean_text(F.col(c)).alias(c) for c in ("transmission", "drivetrain", "fuel_type", "interior_color")}
    return listings(spark, sf_dir).select("vin", "r_partkey", *text.values(), R.clean_url(F.col("image_url")).alias("image_url"), R.int_floor(F.col("cylinders"), 0).alias("cylinders"))


#: VINs as feeds write them, planted by line number.
VINS = "CASE l_linenumber WHEN 1 THEN 'VIN' || cast(l_partkey AS {s}) WHEN 2 THEN 'VINXXX' || cast(l_suppkey AS {s}) WHEN 3 THEN 'unknown-' || cast(l_orderkey AS {s}) WHEN 4 THEN ' ' || lower({v}) || ' ' ELSE {v} END"


def planted_vins(kind: str) -> str:
    return VINS.format(s=kind, v=f"('V' || lpad(cast(l_orderkey AS {kind}), 12, '0') || lpad(cast(l_linenumber AS {kind}), 4, '0'))")


@query(
    "vin_classify",
    f"""WITH v AS (SELECT {planted_vins('VARCHAR')} AS raw FROM lineitem), u AS (SELECT raw, upper(trim(raw)) AS u FROM v)
    SELECT raw, CASE WHEN regexp_matches(u, '^[A-Z0-9]{{17}}$') AND NOT starts_with(u, 'UNKNOWN') THEN u END AS scanner_vin, regexp_matches(u, '^[A-HJ-NPR-Z0-9]{{17}}$') AS decodable,
    contains(u, 'VINXXX') OR (length(u) < 17 AND regexp_matches(u, '^VIN([0-9]+|X+)$')) AS dummy, starts_with(lower(raw), 'unknown') AS unknown FROM u""",
)
def vin_classify(spark, sf_dir):
    raw = F.col("raw")
    rows = table(spark, sf_dir, "lineitem").selectExpr(f"{planted_vins('STRING')} AS raw")
    return rows.select("raw", R.scanner_vin(raw).alias("scanner_vin"), R.is_decodable_vin(raw).alias("decodable"), R.is_dummy_vin(raw).alias("dummy"), F.lower(raw).startswith("unknown").alias("unknown"))


HOST_SQL = "regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':[0-9]+$', '')"


@query(
    "url_normalize",
    f"""WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), b AS (SELECT *, regexp_replace(host, '^www[.]', '') AS bare FROM h), p AS (SELECT *, string_split(trim(bare, '.'), '.') AS parts FROM b)
    SELECT page_id, CASE WHEN host <> '' THEN 'https://' || host END AS root, bare AS bare_host,
    CASE WHEN len(parts) < 2 THEN trim(bare, '.') WHEN len(parts) >= 3 AND length(parts[-1]) = 2 AND parts[-2] IN ('co', 'com', 'net', 'org') THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
    regexp_replace(bare, '[^a-z0-9]+', '-', 'g') AS slug FROM p""",
)
def url_normalize(spark, sf_dir):
    host = R.url_host(F.col("url"))
    bare = R.bare_host(host)
    return table(spark, sf_dir, "pages").select("page_id", R.url_root(F.col("url")).alias("root"), bare.alias("bare_host"), R.registrable_domain(host).alias("domain"), F.regexp_replace(bare, "[^a-z0-9]+", "-").alias("slug"))


#: Spec texts in feed spellings, dealt over parts.
SPELLINGS = {
    "transmission": ["auto", "Stick", "8-speed automatic", "x-tronic cvt", "N/A"],
    "drivetrain": ["all-wheel drive", "xDrive", "4x4", "front-wheel", "rwd", "part time", "--"],
    "body_style": ["SAV", "sedan", "suv", "crew cab", "unknown"],
    "fuel_type": ["premium unleaded", "Regular Unleaded", "Turbo Diesel", "electric motor", "flex fuel", ""],
}


def spelled(duck: bool) -> list[str]:
    pick = lambda v: f"[{v}][p_partkey % {v.count(chr(44)) + 1} + 1]" if duck else f"element_at(array({v}), cast(p_partkey % {v.count(chr(44)) + 1} + 1 as int))"
    return [f"{pick(', '.join(map(repr, v)))} AS {k}" for k, v in SPELLINGS.items()]


def title_sql(c: str) -> str:
    return f"array_to_string(list_transform(regexp_split_to_array(trim({c}), '\\s+'), lambda w: CASE WHEN w = lower(w) THEN upper(w[1:1]) || w[2:] ELSE w END), ' ')"


@query(
    "spec_vocab_normalize",
    f"""WITH s AS (SELECT p_partkey, {', '.join(spelled(True))} FROM part)
    SELECT p_partkey,
    CASE WHEN {empty_sql('transmission')} THEN NULL WHEN lower(transmission) IN ('automatic', 'auto') THEN 'Automatic' WHEN lower(transmission) IN ('manual', 'stick', 'mt') THEN 'Manual' WHEN contains(lower(transmission), 'cvt') THEN 'CVT' ELSE {title_sql('transmission')} END AS transmission,
    CASE WHEN {empty_sql('drivetrain')} THEN NULL WHEN regexp_matches(lower(drivetrain), 'all-wheel|xdrive|^awd$') THEN 'AWD' WHEN regexp_matches(lower(drivetrain), 'four-wheel|4-wheel|4x4|4 wd|^4wd$') THEN '4WD' WHEN regexp_matches(lower(drivetrain), 'front-wheel|^fwd$|^2wd$') THEN 'FWD' WHEN regexp_matches(lower(drivetrain), 'rear-wheel|^rwd$') THEN 'RWD' ELSE {title_sql('drivetrain')} END AS drivetrain,
    CASE WHEN {empty_sql('body_style')} THEN NULL WHEN lower(body_style) = 'sav' THEN 'SUV' WHEN lower(body_style) IN ('suv', 'van') THEN upper(body_style) ELSE {title_sql('body_style')} END AS body_style,
    CASE WHEN {empty_sql('fuel_type')} THEN NULL WHEN contains(lower(fuel_type), 'premium') AND contains(lower(fuel_type), 'unlead') THEN 'Premium Unleaded' WHEN contains(lower(fuel_type), 'unlead') AND contains(lower(fuel_type), 'regular') THEN 'Regular Unleaded' WHEN contains(lower(fuel_type), 'diesel') THEN 'Diesel' WHEN contains(lower(fuel_type), 'electric') THEN 'Electric' ELSE {title_sql('fuel_type')} END AS fuel_type
    FROM s""",
)
def spec_vocab_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", *spelled(False))
    return rows.select("p_partkey", R.norm_transmission(F.col("transmission")).alias("transmission"), R.norm_drivetrain(F.col("drivetrain")).alias("drivetrain"), R.norm_body_style(F.col("body_style")).alias("body_style"), R.norm_fuel(F.col("fuel_type")).alias("fuel_type"))


@query("first_positive_price", with_listings("SELECT vin, r_partkey, cast(round(coalesce(CASE WHEN price > 0 THEN price END, CASE WHEN msrp > 0 THEN msrp END)) AS BIGINT) AS price FROM l"))
def first_positive_price(spark, sf_dir):
    return listings(spark, sf_dir).select("vin", "r_partkey", R.first_positive(F.col("price"), F.col("msrp")).alias("price"))


PRICE_TEXT = "CASE WHEN o_orderkey % 5 = 0 THEN 'call us' WHEN o_orderkey % 3 = 0 THEN '$' || cast(cast(floor(o_totalprice / 1000) AS bigint) AS {s}) || ',' || lpad(cast(cast(floor(o_totalprice) AS bigint) % 1000 AS {s}), 3, '0') ELSE cast(cast(floor(o_totalprice) AS bigint) AS {s}) END"


@query("number_parse", f"SELECT o_orderkey, coalesce(try_cast(regexp_replace(t, '[$,]', '', 'g') AS DOUBLE), 0) AS price FROM (SELECT o_orderkey, {PRICE_TEXT.format(s='VARCHAR')} AS t FROM orders)")
def number_parse(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{PRICE_TEXT.format(s='STRING')} AS t").select("o_orderkey", R.number(F.col("t")).alias("price"))


def families_sql(c: str) -> str:
    phrases = sorted(R.LEXICON.items(), key=lambda x: -len(x[0]))
    found = " || ".join(f"CASE WHEN contains(lower(trim({c})), '{p}') THEN {f} ELSE [] END" for p, f in phrases)
    # list_distinct keeps no order: a value stays where it occurs first
    return f"CASE WHEN {empty_sql(c)} THEN [] WHEN len({found}) = 0 THEN ['other'] ELSE list_filter({found}, lambda x, i: list_position({found}, x) = i) END"


@query("color_families", f"SELECT p_partkey, array_to_string({families_sql('p_name')}, ',') AS families FROM part")
def color_families(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(R.color_families(F.col("p_name")), ",").alias("families"))


QUALITY_SQL = (
    "round_even(("
    + " + ".join(
        [f"CASE WHEN NOT {empty_sql(c)} THEN {w} ELSE 0 END" for c, w in {"vin": 12, "title": 10, "make": 8, "model": 8, "trim": 6, "transmission": 6, "drivetrain": 6, "fuel_type": 5, "exterior_color": 4, "interior_color": 4}.items()]
        + ["CASE WHEN year IS NOT NULL THEN 8 ELSE 0 END", "CASE WHEN price > 0 THEN 8 ELSE 0 END", "CASE WHEN mileage >= 0 THEN 5 ELSE 0 END", "CASE WHEN n_photos > 0 THEN 5 ELSE 0 END", "CASE WHEN cylinders <> 0 THEN 4 ELSE 0 END"]
    )
    + ") * 100.0::DOUBLE / 108, 2)"
)


@query("quality_score", with_listings(f"SELECT vin, r_partkey, {QUALITY_SQL} AS score FROM l"))
def quality_score(spark, sf_dir):
    return listings(spark, sf_dir).select("vin", "r_partkey", R.quality_score(R.listing_checks()).alias("score"))


def missing_sql(public: bool) -> str:
    codes = {c: empty_sql(c) for c in ("title",)} | {"images": "n_photos = 0", "price": "NOT coalesce(price, 0) > 0 AND NOT coalesce(msrp, 0) > 0", "year": "year IS NULL"}
    codes |= {c: empty_sql(c) for c in ("make", "model", "trim", "transmission", "drivetrain", "body_style", "fuel_type")} | {"cylinders": "cylinders IS NULL"} | {c: empty_sql(c) for c in ("exterior_color", "interior_color", "vin")}
    return "list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in codes.items() if not public or k in R.PUBLIC_FIELDS) + "], lambda x: x IS NOT NULL)"


@query("missing_fields", with_listings(f"SELECT vin, r_partkey, array_to_string({missing_sql(False)}, ',') AS missing, array_to_string({missing_sql(True)}, ',') AS missing_public FROM l"))
def missing_fields(spark, sf_dir):
    return listings(spark, sf_dir).select("vin", "r_partkey", F.array_join(R.missing_fields(), ",").alias("missing"), F.array_join(R.missing_fields(public=True), ",").alias("missing_public"))


ISSUES_SQL = """list_filter([CASE WHEN price IS NULL THEN 'no_price' WHEN price <= 0 THEN 'price_zero' END, CASE WHEN n_photos = 0 THEN 'empty_gallery' WHEN n_photos < 3 THEN 'low_photo_count' END,
CASE WHEN trim IS NULL OR trim(trim) = '' THEN 'missing_trim' END, CASE WHEN exterior_color IS NULL OR trim(exterior_color) = '' THEN 'missing_exterior_color' END,
CASE WHEN interior_color IS NULL OR trim(interior_color) = '' THEN 'missing_interior_color' END], lambda x: x IS NOT NULL)"""
STALE_SQL = f"coalesce(price > 0 AND date_diff('second', coalesce(first_seen_at, scraped_at), timestamp '{AS_OF}') / 86400.0 >= 45, false)"


def issues():
    return R.merch_issues(F.col("price"), R.https_photos(F.col("gallery")), F.col("trim"), F.col("exterior_color"), F.col("interior_color"))


def stale():
    return R.is_stale(F.col("price"), F.coalesce("first_seen_at", "scraped_at"), AS_OF)


@query(
    "merch_issues",
    with_listings(
        f"""SELECT vin, r_partkey, array_to_string(i, ',') AS issues, NOT list_has_any(i, ['no_price', 'price_zero']) AS has_price, NOT list_has_any(i, ['empty_gallery', 'low_photo_count']) AS has_photos,
        NOT list_contains(i, 'missing_trim') AS has_trim, NOT list_has_any(i, ['missing_exterior_color', 'missing_interior_color']) AS has_colors, NOT stale AS not_stale FROM (SELECT *, {ISSUES_SQL} AS i, {STALE_SQL} AS stale FROM l)"""
    ),
)
def merch_issues(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("i", issues())
    lacks = lambda *codes: ~F.arrays_overlap("i", F.array(*map(F.lit, codes)))
    return rows.select(
        "vin", "r_partkey", F.array_join("i", ",").alias("issues"), lacks("no_price", "price_zero").alias("has_price"), lacks("empty_gallery", "low_photo_count").alias("has_photos"),
        lacks("missing_trim").alias("has_trim"), lacks("missing_exterior_color", "missing_interior_color").alias("has_colors"), (~stale()).alias("not_stale"),
    )


@query(
    "price_provenance",
    with_listings(
        """SELECT vin, r_partkey, x.label AS label, x.value AS value, x.source AS source FROM (SELECT vin, r_partkey, unnest(list_filter([CASE WHEN price > 0 THEN {'label': 'Internet / list price', 'value': price, 'source': 'inventory_feed'} END,
        CASE WHEN msrp > 0 THEN {'label': 'MSRP', 'value': msrp, 'source': 'feed_or_vdp'} END], lambda x: x IS NOT NULL)) AS x FROM l)"""
    ),
)
def price_provenance(spark, sf_dir):
    entry = lambda label, c, source: F.when(F.col(c) > 0, F.struct(F.lit(label).alias("label"), F.col(c).alias("value"), F.lit(source).alias("source")))
    found = F.array_compact(F.array(entry("Internet / list price", "price", "inventory_feed"), entry("MSRP", "msrp", "feed_or_vdp")))
    return listings(spark, sf_dir).select("vin", "r_partkey", F.inline(found))


@query("listing_age", with_listings(f"SELECT vin, r_partkey, round_even(date_diff('second', coalesce(first_seen_at, scraped_at), timestamp '{AS_OF}') / 86400.0::DOUBLE, 1) AS days, {STALE_SQL} AS stale FROM l"))
def listing_age(spark, sf_dir):
    return listings(spark, sf_dir).select("vin", "r_partkey", F.bround(R.age_days(F.coalesce("first_seen_at", "scraped_at"), AS_OF), 1).alias("days"), stale().alias("stale"))


DOCUMENT_SQL = f"""left(concat_ws(' ', concat_ws(' ', cast(year AS VARCHAR), make, model, trim) || '.', CASE WHEN NOT {empty_sql('exterior_color')} THEN 'Exterior color: ' || exterior_color || '.' END, CASE WHEN NOT {empty_sql('interior_color')} THEN 'Interior color: ' || interior_color || '.' END,
        CASE WHEN NOT {empty_sql('transmission')} THEN 'Transmission: ' || transmission || '.' END, CASE WHEN NOT {empty_sql('drivetrain')} THEN 'Drivetrain: ' || drivetrain || '.' END, CASE WHEN NOT {empty_sql('fuel_type')} THEN 'Fuel: ' || fuel_type || '.' END,
        'Dealer: ' || dealer_name || ', ' || country || '.'), 8000)"""


@query(
    "listing_document",
    with_listings(
        f"SELECT vin, r_partkey, {DOCUMENT_SQL} AS document FROM l"
    ),
)
def listing_document(spark, sf_dir):
    return listings(spark, sf_dir).select("vin", "r_partkey", listing_text().alias("document"))


def listing_text():
    """What a listing says of itself, in a few sentences."""
    say = lambda label, c: F.when(~R.is_empty(F.col(c)), F.concat(F.lit(f"{label}: "), F.col(c), F.lit(".")))
    head = F.concat(F.concat_ws(" ", F.col("year").cast("string"), "make", "model", "trim"), F.lit("."))
    parts = [say("Exterior color", "exterior_color"), say("Interior color", "interior_color"), say("Transmission", "transmission"), say("Drivetrain", "drivetrain"), say("Fuel", "fuel_type")]
    return F.left(F.concat_ws(" ", head, *parts, F.concat(F.lit("Dealer: "), "dealer_name", F.lit(", "), "country", F.lit("."))), F.lit(8000))


@query(
    "price_vs_valuation",
    with_listings(
        """SELECT vin, r_partkey, CASE WHEN price > 0 AND r_partkey % 2 = 0 THEN CASE WHEN price < msrp * 10 THEN 'below' WHEN price > msrp * 30 THEN 'above' ELSE 'within' END
        WHEN price > 0 AND msrp > 0 THEN CASE WHEN price < msrp * 20 * 0.97 THEN 'below' WHEN price > msrp * 20 * 1.03 THEN 'above' ELSE 'within' END END AS position FROM l"""
    ),
)
def price_vs_valuation(spark, sf_dir):
    """Valuation ranges are planted from the part's retail price: a range for even parts, a fair price for all."""
    even = F.col("r_partkey") % 2 == 0
    return listings(spark, sf_dir).select("vin", "r_partkey", R.price_position(F.col("price"), F.when(even, F.col("msrp") * 10), F.when(even, F.col("msrp") * 30), F.col("msrp") * 20).alias("position"))


#: Words of names, dealt over parts by number, size and brand so that they meet in all ways; the title begins with the part's own name.
NAME_PARTS = {
    "make": ("BMW|MINI|Mazda|Mercedes-Benz|Ford|Audi|BMW|Kia", "p_partkey"), "model": ("330|X5|i4|X7|M340i|540i|7 Series|E-Class|C-Class|CX-5|MAZDA3|MX-5|F-150|Ranger|Explorer|A4|430i|M3|Z4|3", "(p_partkey - p_partkey % 8) / 8"),
    "trim": ("330i xDrive|xDrive40i|eDrive40|M60i|330e|sDrive30i|40 xDrive|750i|E 450 4MATIC|C 300|AMG 63|Touring AWD|XLT 4x4|quattro|hatchback FWD 6MT|Gran Coupe|S|M40i", "p_partkey * 7 + p_size"),
    "tail": ("|9-Speed Automatic|TEN-SPEED AUTOMATIC|CVT|electric|8 spd auto trans|manual", "p_size"),
}


def _dealt(name: str) -> str:
    words, number = NAME_PARTS[name]
    return f"split_part('{words}', '|', cast(({number}) % {words.count('|') + 1} as int) + 1)"


def _rules_sql() -> str:
    """DuckDB's run of the rule table: rules join names, and of each group the least number wins."""
    q = lambda v: "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {', '.join(q(v) for v in (r.group, r.value, r.brand, r.on, r.pattern, r.also_on, r.also, r.unless_on, r.unless, r.needs))})" for i, r in enumerate(TR.RULES))
    pick = lambda on: f"CASE {on} WHEN 'name' THEN name WHEN 'model' THEN model_u ELSE words END"
    fits = f"(brand = '' OR regexp_matches(make_u, brand)) AND (pattern = '' OR regexp_matches({pick('onto')}, pattern)) AND (also = '' OR regexp_matches({pick('also_on')}, also)) AND (unless = '' OR NOT regexp_matches({pick('unless_on')}, unless))"
    return f"""WITH rules(id, grp, value, brand, onto, pattern, also_on, also, unless_on, unless, needs) AS (VALUES {values}),
    r AS (SELECT p_partkey, {_dealt('make')} AS make, {_dealt('model')} AS model, {_dealt('trim')} AS trim, trim(p_name || ' ' || {_dealt('tail')}) AS title FROM part),
    t AS (SELECT *, upper(make) AS make_u, upper(model) AS model_u, upper(title || ' ' || trim || ' ' || model) AS name, upper(trim || ' ' || title) AS words FROM r),
    m AS (SELECT p_partkey, split_part(arg_min(value, id), '|', 1)::INTEGER AS cylinders, nullif(split_part(arg_min(value, id), '|', 2), '') AS fuel_hint FROM t JOIN rules ON grp = 'motor' AND {fits} GROUP BY p_partkey),
    f AS (SELECT t.p_partkey, grp, arg_min(value, id) AS value FROM t LEFT JOIN m USING (p_partkey) JOIN rules ON grp <> 'motor' AND {fits} AND (needs = '' OR CASE needs WHEN 'electric' THEN coalesce(cylinders = 0, false) WHEN 'burning' THEN NOT coalesce(cylinders = 0, false) ELSE coalesce(cylinders > 0, false) END) GROUP BY ALL),
    g AS (SELECT p_partkey, max(value) FILTER (grp = 'drivetrain') AS drivetrain, max(value) FILTER (grp = 'body') AS body_hint, max(value) FILTER (grp = 'shift') AS shift FROM f GROUP BY p_partkey),
    s AS (SELECT t.*, m.cylinders, m.fuel_hint, g.drivetrain, g.body_hint, g.shift, try_cast(nullif(regexp_extract(name, '{TR.SPEEDS}', 1), '') AS INTEGER) AS told FROM t LEFT JOIN m USING (p_partkey) LEFT JOIN g USING (p_partkey))
    SELECT p_partkey, make, model, trim, title, cylinders, coalesce(told, CASE WHEN shift = '10-Speed Automatic' THEN 10 END) AS gears, drivetrain, fuel_hint, body_hint, replace(shift, '{{gears}}', coalesce(told::VARCHAR, '')) AS transmission_hint FROM s"""


@query("trim_decode", _rules_sql())
def trim_decode(spark, sf_dir):
    """Mechanics from the names of all parts, by the rule table."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_dealt('make')} AS make", f"{_dealt('model')} AS model", f"{_dealt('trim')} AS trim", f"trim(p_name || ' ' || {_dealt('tail')}) AS title")
    return rows.withColumn("d", TR.decoded(F.col("make"), F.col("model"), F.col("trim"), F.col("title"))).select("p_partkey", "make", "model", "trim", "title", "d.*")


ENGINES = ["2.0L Turbo I4", "3.5-L V6", "Electric Motor", "V8 6.2L", "", "1.5 liter"]


@query("engine_liters", "SELECT p_partkey, [2.0, 3.5, NULL, 6.2, NULL, NULL][p_partkey % 6 + 1]::DOUBLE AS liters, CASE WHEN p_size % 9 = 0 THEN 'Electric' WHEN p_partkey % 6 IN (0, 1, 3) THEN ['2.0', '3.5', '', '6.2'][p_partkey % 6 + 1] END AS engine_l FROM part")
def engine_liters(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ENGINES)), (F.col("p_partkey") % len(ENGINES) + 1).cast("int"))
    liters = R.liters_in(text)
    label = F.when(F.col("p_size") % 9 == 0, "Electric").otherwise(F.format_string("%.1f", liters))
    return table(spark, sf_dir, "part").select("p_partkey", liters.alias("liters"), F.when((F.col("p_size") % 9 == 0) | liters.isNotNull(), label).alias("engine_l"))


TRANY = ["Automatic (S8)", "Automatic (AM-S7)", "Automatic (variable gear ratios)", "Manual 6-spd", "Automatic 10-spd", "n/a"]


@query("transmission_format", "SELECT p_partkey, ['8-Speed Automatic', '7-Speed DCT', 'CVT', '6-Speed Manual', '10-Speed Automatic', NULL][p_partkey % 6 + 1] AS display, [8, 7, NULL, 6, 10, NULL][p_partkey % 6 + 1]::INTEGER AS gears FROM part")
def transmission_format(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, TRANY)), (F.col("p_partkey") % len(TRANY) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", R.transmission_display(text).alias("display"), R.gears(text).alias("gears"))


@query(
    "pii_redact",
    r"""SELECT doc_id, count(*) AS n_emails, min(left(e, 1) || '***@' || split_part(e, '@', 2)) AS first_redacted FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS e FROM documents) GROUP BY doc_id""",
)
def pii_redact(spark, sf_dir):
    """E-mail addresses of documents, as first letter and domain."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("e"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_emails"), F.min(F.concat(F.left("e", F.lit(1)), F.lit("***@"), F.split_part("e", F.lit("@"), F.lit(2)))).alias("first_redacted"))


@query(
    "address_phone_extract",
    r"""SELECT doc_id, nullif(regexp_extract(text, '\(?([2-9][0-9]{2})\)?[-. ]([0-9]{3})[-. ]([0-9]{4})'), '') AS phone, nullif(regexp_extract(text, '[^0-9]([0-9]{5})(-[0-9]{4})?[^0-9]', 1), '') AS zip FROM documents""",
)
def address_phone_extract(spark, sf_dir):
    text = F.col("text")
    phone = F.regexp_extract(text, r"\(?([2-9][0-9]{2})\)?[-. ]([0-9]{3})[-. ]([0-9]{4})", 0)
    code = F.regexp_extract(text, r"[^0-9]([0-9]{5})(-[0-9]{4})?[^0-9]", 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(phone, F.lit("")).alias("phone"), F.nullif(code, F.lit("")).alias("zip"))
