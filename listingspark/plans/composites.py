"""Further projections, and enrichment jobs made of several rules. Inputs are planted from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from listingspark.functions import conditions as K
from listingspark.functions import rules as R
from listingspark.operators import merge as M
from listingspark.operators import valuation as V
from listingspark.plans.catalog import query
from listingspark.plans.listing_rules import _dealt, empty_sql
from listingspark.plans.vectors import NEAR_SQL, catalog_neighbours
from listingspark.sources import mapping as T
from listingspark.tables import ARRIVAL, listings, table, with_listings

#: What is planted into parts' titles and URLs; most rows have no condition.
TITLES = "Used |New |Certified |CPO |BMW Certified |a certified pre-owned ||Pre-owned and certified "
URLS = "x.example/new-inventory/1|x.example/used-inventory/2|x.example/certified/3|x.example/cpo-inventory/4|x.example/5|x.example/new/6|x.example/pre-owned/7|x.example/newinventory/8|"
LISTED = [
    f"{_dealt('make')} AS make", f"split_part('{TITLES}', '|', cast(p_partkey % {TITLES.count('|') + 1} as int) + 1) || p_name AS title", f"'https://' || split_part('{URLS}', '|', cast((p_partkey + p_size * 3) % {URLS.count('|') + 1} as int) + 1) AS url",
    "p_partkey % 11 = 0 AS cpo", "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE p_size * 100 END AS mileage", "2019 + p_size % 9 AS year", "CASE WHEN p_partkey % 13 = 0 THEN 'Used' WHEN p_partkey % 3 = 0 THEN 'n/a' END AS condition",
]


def _condition_sql() -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {', '.join(map(q, r))})" for i, r in enumerate(K.RULES))
    return f"""WITH rules(id, value, brand, place, pattern, needs) AS (VALUES {values}), r AS (SELECT p_partkey, {", ".join(LISTED)} FROM part), t AS (SELECT *, lower(trim(title)) AS low, lower(url) AS low_url FROM r),
    h AS (SELECT p_partkey, arg_min(value, id) AS condition FROM t JOIN rules ON (brand = '' OR (brand = 'bmw') = (upper(make) = 'BMW')) AND (pattern = '' OR regexp_matches(CASE place WHEN 'title' THEN low ELSE low_url END, pattern))
      AND (needs = '' OR coalesce(CASE needs WHEN 'cpo' THEN cpo WHEN 'driven' THEN mileage > 0 WHEN 'undriven' THEN mileage = 0 WHEN 'old' THEN year < {K.FIRST_RECENT} ELSE year >= {K.FIRST_RECENT} END, false)) WHERE {empty_sql('t.condition')} GROUP BY p_partkey)
    SELECT p_partkey, make, title, url, h.condition FROM r LEFT JOIN h USING (p_partkey)"""


@query("condition_infer", _condition_sql())
def condition_infer(spark, sf_dir):
    """The condition to store for rows that have none, by the rule table; a row's own condition stays."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", *LISTED)
    told = K.inferred(*map(F.col, ("make", "title", "url", "cpo", "mileage", "year")))
    return rows.select("p_partkey", "make", "title", "url", F.when(R.is_empty(F.col("condition")), told).alias("condition"))


@query("engine_display", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '3.0L TwinPower Turbo' WHEN p_size % 9 = 0 THEN 'Electric' WHEN p_size % 9 IN (4, 6, 8) THEN '2.5L ' || CASE p_size % 9 WHEN 4 THEN 'I4' ELSE 'V' || (p_size % 9) END ELSE '—' END AS engine FROM part")
def engine_display(spark, sf_dir):
    """Rich text, else Electric for no cylinders, else litres and layout, else a dash."""
    cylinders = F.col("p_size") % 9
    rich = F.when(F.col("p_size") % 5 == 0, "3.0L TwinPower Turbo")
    layout = F.when(cylinders == 4, "I4").when(cylinders.isin(6, 8), F.concat(F.lit("V"), cylinders.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(rich, F.when(cylinders == 0, "Electric"), F.concat(F.lit("2.5L "), layout), F.lit("—")).alias("engine"))


@query("epa_text_fields", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN p_size * 2 || ' MPGe' WHEN p_size % 7 = 0 THEN p_size || ' City MPG' ELSE p_size || ' City / ' || (p_size + 5) || ' Hwy' END AS mpg, CASE WHEN regexp_matches(p_type, 'SMALL|MEDIUM') THEN 'Sedan' WHEN regexp_matches(p_type, 'LARGE') THEN 'SUV' ELSE 'Other' END AS body FROM part WHERE p_size > 0")
def epa_text_fields(spark, sf_dir):
    n = F.col("p_size")
    mpg = F.when(n % 10 == 0, F.format_string("%d MPGe", n * 2)).when(n % 7 == 0, F.format_string("%d City MPG", n)).otherwise(F.format_string("%d City / %d Hwy", n, n + 5))
    body = F.when(F.col("p_type").rlike("SMALL|MEDIUM"), "Sedan").when(F.col("p_type").rlike("LARGE"), "SUV").otherwise("Other")
    return table(spark, sf_dir, "part").where(n > 0).select("p_partkey", mpg.alias("mpg"), body.alias("body"))


@query("make_model_sanitize", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN split_part(p_name, ' ', 1) WHEN p_size % 4 = 1 THEN p_brand ELSE p_brand END AS make, CASE WHEN p_size % 4 = 0 THEN split_part(p_name, ' ', 2) ELSE p_type END AS model FROM part")
def make_model_sanitize(spark, sf_dir):
    """Numeric makes come from the title; known swapped pairs are turned back (every fourth of each is planted)."""
    kind = F.col("p_size") % 4
    make = F.when(kind == 0, F.lit("330")).when(kind == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    model = F.when(kind == 0, F.lit("")).when(kind == 1, F.col("p_brand")).otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", make.alias("make"), model.alias("model"), "p_name")
    numeric, swapped = F.col("make").rlike("^[0-9]+$"), F.col("model").startswith("Brand#")
    return rows.select("p_partkey", F.when(numeric, F.split_part("p_name", F.lit(" "), F.lit(1))).when(swapped, F.col("model")).otherwise(F.col("make")).alias("make"), F.when(numeric, F.split_part("p_name", F.lit(" "), F.lit(2))).when(swapped, F.col("make")).otherwise(F.col("model")).alias("model"))


@query("attr_array_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS flag, l_linestatus AS status FROM lineitem")
def attr_array_lookup(spark, sf_dir):
    """A value of an array of names and values, by exact name or by part of the normalised one."""
    entry = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).alias("value"))
    attrs = F.array(entry("other", "l_linestatus"), entry("Return Flag", "l_returnflag"), entry("vehicle_line-status", "l_linestatus"))
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    exact = F.get(F.filter(attrs, lambda a: a["name"] == "Return Flag"), F.lit(0))["value"]
    part = F.get(F.filter(attrs, lambda a: norm(a["name"]).contains("linestatus")), F.lit(0))["value"]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", exact.alias("flag"), part.alias("status"))


def _overlay_text() -> str:
    """An SQL text of an overlay: every field under three of its names, by the part's number, beside `ep` or within it; some values are junk."""
    names: dict[str, list[str]] = {f: [f] for f in T.OVERLAY_FIELDS}
    for alias, field in T.ALIASES:
        names[field].append(alias)
    beside, within = [], []
    for i, (field, own) in enumerate(names.items()):
        for k, name in enumerate(own):
            value = lambda junk: f"""'"{name}": "' || CASE WHEN (p_partkey + {i + k}) % {junk} = 0 THEN 'n/a' ELSE '{field[:4]}{k} ' || p_size END || '"'"""  # noqa: B023, E731
            beside.append(f"CASE WHEN (p_partkey + {k}) % 4 < 2 OR {len(own)} = 2 THEN {value(3)} END")
            within.append(f"CASE WHEN (p_partkey * 3 + {k + i}) % 5 = 0 THEN {value(2)} END")
    return "'{' || concat_ws(', ', " + ", ".join(beside) + """, CASE WHEN p_partkey % 2 = 0 THEN '"ep": {' || concat_ws(', ', """ + ", ".join(within) + ") || '}' END) || '}'"


OVERLAY_TEXT = _overlay_text()


def _overlay_sql(field: str) -> str:
    picks = []
    for name in [field, *(a for a, f in T.ALIASES if f == field)]:
        value = f"""CASE WHEN json_exists(j, '$.ep."{name}"') THEN j->>'$.ep."{name}"' ELSE j->>'$."{name}"' END"""
        picks.append(f"CASE WHEN NOT {empty_sql(value)} THEN {value} END")
    return "coalesce(" + ", ".join(picks) + f") AS {field}"


@query("alias_coalesce", f"SELECT p_partkey, {', '.join(map(_overlay_sql, T.OVERLAY_FIELDS))} FROM (SELECT p_partkey, ({OVERLAY_TEXT})::JSON AS j FROM part)")
def alias_coalesce(spark, sf_dir):
    """The fields of an overlay under 47 aliases, some of them within `ep`, by a table of names."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")  # parts lie in few files, and texts take their time
    return T.overlay_fields(part.select("p_partkey", F.expr(OVERLAY_TEXT).alias("payload")), "p_partkey", "payload")


@query("vin_decode_patch", "SELECT p_partkey, 1990 + p_size % 30 AS year, CASE WHEN p_size % 4 = 0 THEN p_size % 9 END AS cylinders, concat_ws(' ', '2.0L', CASE WHEN p_size % 4 = 0 THEN 'V' || (p_size % 9) END, CASE WHEN p_size % 3 = 0 THEN 'Turbo' END) AS engine FROM part")
def vin_decode_patch(spark, sf_dir):
    """Cached decoder responses (text to text) to listing columns and an engine text."""
    cache = F.create_map(F.lit("ModelYear"), (1990 + F.col("p_size") % 30).cast("string"), F.lit("EngineCylinders"), F.when(F.col("p_size") % 4 == 0, (F.col("p_size") % 9).cast("string")).otherwise(""), F.lit("DisplacementL"), F.lit("2.0"), F.lit("Turbo"), F.when(F.col("p_size") % 3 == 0, "Yes").otherwise("No"))
    rows = table(spark, sf_dir, "part").select("p_partkey", cache.alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    cylinders = get("EngineCylinders").try_cast("int")
    return rows.select("p_partkey", get("ModelYear").try_cast("int").alias("year"), cylinders.alias("cylinders"), F.concat_ws(" ", F.concat(get("DisplacementL"), F.lit("L")), F.concat(F.lit("V"), cylinders.cast("string")), F.when(get("Turbo") == "Yes", "Turbo")).alias("engine"))


@query("display_serialize", with_listings(f"SELECT vin, r_partkey, CASE WHEN {empty_sql('transmission')} THEN '—' ELSE transmission END AS transmission, CASE WHEN {empty_sql('fuel_type')} THEN '—' ELSE fuel_type END AS fuel_type, CASE WHEN price > 0 THEN '$' || cast(round(price)::BIGINT AS VARCHAR) ELSE 'Call' END AS price FROM l WHERE listing_active"))
def display_serialize(spark, sf_dir):
    dash = lambda c: F.when(R.is_empty(F.col(c)), "—").otherwise(F.col(c)).alias(c)
    price = F.when(F.col("price") > 0, F.concat(F.lit("$"), F.round("price").cast("long").cast("string"))).otherwise("Call")
    return listings(spark, sf_dir).where("listing_active").select("vin", "r_partkey", dash("transmission"), dash("fuel_type"), price.alias("price"))


@query("detail_url_candidates", "SELECT page_id, CASE WHEN regexp_matches(url, '/[0-9]+[.]html') THEN url END AS explicit, CASE WHEN NOT regexp_matches(url, '/[0-9]+[.]html') THEN array_to_string(list_transform(['new', 'used', 'certified'], lambda s: 'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/' || s || '/' || page_id), ' ') END AS candidates FROM pages")
def detail_url_candidates(spark, sf_dir):
    explicit = F.col("url").rlike("/[0-9]+[.]html")
    built = F.transform(F.array(*map(F.lit, ("new", "used", "certified"))), lambda s: F.concat(F.lit("https://"), F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("/"), s, F.lit("/"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", F.when(explicit, F.col("url")).alias("explicit"), F.when(~explicit, F.array_join(built, " ")).alias("candidates"))


@query("history_highlights", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'One Owner,Clean,size: ' || p_size ELSE 'One Owner,size: ' || p_size END AS highlights FROM part")
def history_highlights(spark, sf_dir):
    """Badges and attributes, once each in any case, in order."""
    raw = F.array_compact(F.array(F.lit("One Owner"), F.when(F.col("p_size") % 2 == 0, "Clean"), F.lit("one owner"), F.concat(F.lit("size: "), F.col("p_size").cast("string"))))
    low = F.transform(raw, lambda x: F.lower(x))
    kept = F.filter(raw, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(kept, ",").alias("highlights"))


@query("media_harvest", "SELECT page_id, 3 AS n, 'https://img.example/' || page_id || '/0.jpg' AS first_image FROM pages")
def media_harvest(spark, sf_dir):
    """Image-like URLs anywhere in a JSON payload, in order of place."""
    image = lambda i, s: F.concat(F.lit("https://img.example/"), F.col("page_id").cast("string"), F.lit(f"/{i}{s}"))
    payload = F.to_json(F.struct(F.array(F.struct(image(0, ".jpg").alias("url")), F.struct(image(1, ".png").alias("url"))).alias("media"), F.struct(image(2, ".webp").alias("hero"), image(3, ".html").alias("link")).alias("page")))
    found = F.array_distinct(F.regexp_extract_all(payload, F.lit(r'https?://[^"]+?\.(?:jpg|jpeg|png|webp)'), F.lit(0)))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first_image"))


def _model_trim_sql() -> str:
    motor = "(NOT contains(m, ' ') AND NOT regexp_matches(upper(m), '^[XZ]\\d') AND NOT regexp_matches(m, '^[iI][Xx\\d]') AND (regexp_matches(m, '^M\\d\\d{2}[iI]$') OR regexp_matches(m, '^[2-8]\\d{2}[eEiI]+$')))"
    tail = R.MODEL_TAIL
    return f"""WITH r AS (SELECT p_partkey, {_dealt('make')} AS make, {_dealt('model')} || CASE WHEN p_size % 3 = 0 THEN ' xDrive' ELSE '' END AS m, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE {_dealt('trim')} END AS t, p_name || ' ' || {_dealt('model')} || CASE WHEN p_partkey % 2 = 0 THEN ' M Sport' ELSE '' END AS title FROM part),
    a AS (SELECT *, {motor} AS motor, regexp_extract(m, '{tail}', 1) AS base, regexp_extract(m, '{tail}', 2) AS tail FROM r),
    b AS (SELECT *, CASE WHEN base <> '' THEN trim(base) WHEN motor THEN regexp_extract(m, '(\\d)', 1) || ' Series' ELSE m END AS model, nullif(trim(t), '') AS own FROM a),
    c AS (SELECT *, CASE WHEN tail <> '' THEN concat_ws(' / ', own, trim(tail)) ELSE own END AS t1 FROM b),
    d AS (SELECT *, CASE WHEN motor AND base = '' AND {empty_sql('t1')} THEN m ELSE t1 END AS t2, trim(string_split(upper(title), upper(model))[-1]) AS up FROM c),
    e AS (SELECT *, CASE WHEN length(model) >= 2 AND contains(upper(title), upper(model)) AND length(up) >= 2 AND (regexp_matches(up, '{R.DRIVE_WORDS}') OR regexp_matches(up, '^[A-Za-z0-9][A-Za-z0-9\\s\\-]{{1,60}}$')) THEN left(right(title, length(up)), 80) END AS from_title FROM d),
    f AS (SELECT *, CASE WHEN {empty_sql('t2')} THEN coalesce(from_title, t2) ELSE t2 END AS t3 FROM e)
    SELECT p_partkey, CASE WHEN make <> 'BMW' THEN CASE WHEN {empty_sql('m')} THEN '—' ELSE m END WHEN {empty_sql('model')} THEN '—' ELSE model END AS model,
      CASE WHEN make <> 'BMW' THEN CASE WHEN {empty_sql('t')} THEN '—' ELSE t END WHEN {empty_sql('t3')} THEN '—' ELSE regexp_replace(trim(t3), '{R.SERIES_DIGIT}', '\\1') END AS trim FROM f"""


@query("model_trim_display", _model_trim_sql())
def model_trim_display(spark, sf_dir):
    """Series and trim of all parts' names: motor codes give both, a model's tail joins the trim, a title fills it."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", f"{_dealt('make')} AS make", f"{_dealt('model')} || CASE WHEN p_size % 3 = 0 THEN ' xDrive' ELSE '' END AS model", f"CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE {_dealt('trim')} END AS trim",
        f"p_name || ' ' || {_dealt('model')} || CASE WHEN p_partkey % 2 = 0 THEN ' M Sport' ELSE '' END AS title",
    )
    return R.model_and_trim(rows).select("p_partkey", F.col("shown_model").alias("model"), F.col("shown_trim").alias("trim"))


@query("discrepancy_check", "WITH t AS (SELECT p_brand, p_type, max(p_size % 9)::INTEGER AS c, max(CASE WHEN p_size % 3 = 0 THEN 'AWD' ELSE 'FWD' END) AS d FROM part GROUP BY ALL) SELECT p_partkey, x.f AS field, x.o AS ours, x.e AS expected, x.o = x.e AS ok FROM (SELECT p_partkey, unnest([{'f': 'cylinders', 'o': (p_size % 9)::VARCHAR, 'e': c::VARCHAR}, {'f': 'drivetrain', 'o': CASE WHEN p_size % 2 = 0 THEN 'AWD' ELSE 'FWD' END, 'e': d}]) AS x FROM part JOIN t USING (p_brand, p_type))")
def discrepancy_check(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    truth = part.groupBy("p_brand", "p_type").agg(F.max((F.col("p_size") % 9).cast("int")).alias("c"), F.max(F.when(F.col("p_size") % 3 == 0, "AWD").otherwise("FWD")).alias("d"))
    entry = lambda name, ours, want: F.struct(F.lit(name).alias("field"), ours.alias("ours"), want.alias("expected"))
    rows = part.join(truth, ["p_brand", "p_type"]).select("p_partkey", F.inline(F.array(entry("cylinders", (F.col("p_size") % 9).cast("string"), F.col("c").cast("string")), entry("drivetrain", F.when(F.col("p_size") % 2 == 0, "AWD").otherwise("FWD"), F.col("d")))))
    return rows.withColumn("ok", F.col("ours") == F.col("expected"))


#: Valuation payloads of parts: measures under several names and depths, repeated, as numbers and as texts, some beyond what is plausible.
VALUES_TEXT = """'{"data": {"values": [{"usedCarFairPurchasePrice": ' || (p_size * 900) || ', "rank": 7}, {"Fair Purchase": "$' || p_size || ',250"}, {"nested": {"deeper": [{"fair_market_range_low": ' || (p_size * 1000) || ', "fairMarketRangeHigh": 30000}, {"Fair Market Max": "' || (20000 + p_size * 500) || ' USD"}]}}]'
  || CASE p_partkey % 4 WHEN 0 THEN ', "privatePartyValue": ' || (p_partkey % 3000) WHEN 1 THEN ', "Private_Party": "n/a", "private party high": "' || p_size || '.5k ' || p_size || '00"' WHEN 2 THEN ', "privatePartyGood": -9000, "certified": true' ELSE '' END
  || '}, "trade-in": ' || (p_size * 700) || CASE WHEN p_partkey % 3 = 0 THEN ', "TradeIn_Value": "' || (p_size * 800) || '", "typicalListingUsed": 45000' ELSE ', "fairMarketLow": 2000000' END || '}'"""


def _valuation_sql() -> str:
    fits = lambda m: " OR ".join("(" + " AND ".join(f"contains(n, '{x}')" for x in parts) + ")" for name, _, parts in V.MEASURES if name == m)
    columns = ", ".join(f"{next(how for n, how, _ in V.MEASURES if n == m)}(x) FILTER ({fits(m)}) AS {m}" for m in dict.fromkeys(m for m, _, _ in V.MEASURES))
    return f"""WITH j AS (SELECT p_partkey, {VALUES_TEXT} AS j FROM part), e AS (SELECT p_partkey, unnest(regexp_extract_all(j, '"[^"]+": *(?:"[^"]*"|-?[0-9.]+|true)')) AS e FROM j),
    v AS (SELECT p_partkey, lower(regexp_replace(regexp_extract(e, '^"([^"]+)"', 1), '[ _]', '', 'g')) AS n, regexp_extract(e, '": *(.*)$', 1) AS t FROM e),
    x AS (SELECT p_partkey, n, CASE WHEN starts_with(t, '"') THEN try_cast(nullif(regexp_replace(t, '[^0-9.]', '', 'g'), '') AS DOUBLE) ELSE try_cast(t AS DOUBLE) END AS x FROM v),
    g AS (SELECT p_partkey, {columns} FROM x WHERE x BETWEEN 500 AND 1500000 GROUP BY p_partkey)
    SELECT p_partkey, fair_purchase, CASE WHEN range_high < range_low THEN range_high ELSE range_low END AS range_low, CASE WHEN range_high < range_low THEN range_low ELSE range_high END AS range_high, private_party, trade_in FROM part LEFT JOIN g USING (p_partkey)"""


@query("valuation_extract", _valuation_sql())
def valuation_extract(spark, sf_dir):
    """Five measures from nested payloads of all parts, by what their keys say."""
    return V.valuations(table(spark, sf_dir, "part").select("p_partkey", F.expr(VALUES_TEXT).alias("payload")), "p_partkey", "payload")


@query(
    "verified_specs",
    with_listings(
        f"""SELECT vin, r_partkey, CASE WHEN cylinders > 0 THEN cylinders ELSE c END AS cylinders, coalesce(d, CASE WHEN NOT {empty_sql('drivetrain')} THEN drivetrain END) AS drivetrain, CASE WHEN cylinders > 0 THEN 'dealer' WHEN c IS NOT NULL THEN 'reference' END AS cylinders_source
        FROM l LEFT JOIN (SELECT p_brand AS make, p_type AS model, max(p_size % 9)::INTEGER AS c, CASE WHEN count(*) > 12 THEN min(CASE WHEN p_size % 3 = 0 THEN 'AWD' ELSE 'FWD' END) END AS d FROM part GROUP BY ALL) r USING (make, model)"""
    ),
)
def verified_specs(spark, sf_dir):
    """The dealer's cylinders come before the reference's, the reference's drivetrain before the dealer's."""
    reference = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("make"), F.col("p_type").alias("model")).agg(F.max((F.col("p_size") % 9).cast("int")).alias("c"), F.when(F.count("*") > 12, F.min(F.when(F.col("p_size") % 3 == 0, "AWD").otherwise("FWD"))).alias("d"))
    rows = listings(spark, sf_dir).join(reference, ["make", "model"], "left")
    own = F.col("cylinders") > 0
    return rows.select("vin", "r_partkey", F.when(own, F.col("cylinders")).otherwise(F.col("c")).alias("cylinders"), F.coalesce("d", R.placeholder_null(F.col("drivetrain"))).alias("drivetrain"), F.when(own, "dealer").when(F.col("c").isNotNull(), "reference").alias("cylinders_source"))


@query(
    "spec_backfill",
    f"""WITH {NEAR_SQL}, a AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 2) END AS v FROM part), b AS (SELECT query_id AS p_partkey, p_type AS v FROM near JOIN part ON p_partkey = vec_id WHERE distance <= 0.4),
    c AS (SELECT page_id AS p_partkey, nullif(trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)), '') AS v FROM pages)
    SELECT p.p_partkey, coalesce(a.v, b.v, c.v) AS value, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 END AS tier, CASE WHEN a.v IS NOT NULL THEN 'trim' WHEN b.v IS NOT NULL THEN 'catalog' WHEN c.v IS NOT NULL THEN 'page' END AS source
    FROM part p LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_partkey) LEFT JOIN c USING (p_partkey)""",
)
def spec_backfill(spark, sf_dir):
    """Values of three tiers in one long table: the trim's, the nearest catalog row's if near enough, the page's; the first tier of each row wins."""
    part = table(spark, sf_dir, "part")
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title>([^<]*)</title>", 1)), F.lit(""))
    tiers = [
        part.where("p_size % 3 = 0").select("p_partkey", F.lit(1).alias("tier"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("value"), F.lit("trim").alias("source")),
        catalog_neighbours(spark, sf_dir).where("distance <= 0.4").join(part.select(F.col("p_partkey").alias("vec_id"), F.col("p_type").alias("value")), "vec_id").select(F.col("query_id").alias("p_partkey"), F.lit(2).alias("tier"), "value", F.lit("catalog").alias("source")),
        table(spark, sf_dir, "pages").select(F.col("page_id").alias("p_partkey"), F.lit(3).alias("tier"), title.alias("value"), F.lit("page").alias("source")).where("value is not null"),
    ]
    best = reduce(lambda a, b: a.unionByName(b), tiers).groupBy("p_partkey").agg(F.min(F.struct("tier", "value", "source")).alias("x"))
    return part.select("p_partkey").join(best, "p_partkey", "left").select("p_partkey", "x.value", "x.tier", "x.source")


@query("package_panel", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT lower(title)))[1:4], ';') AS packages FROM (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'Pack ' || l_returnflag ELSE 'PACK ' || l_returnflag END || (l_suppkey % 3) AS title FROM lineitem) GROUP BY l_orderkey")
def package_panel(spark, sf_dir):
    title = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "Pack ").otherwise("PACK "), "l_returnflag", (F.col("l_suppkey") % 3).cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set(F.lower(title))), 1, 4), ";").alias("packages"))
