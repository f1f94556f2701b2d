"""Jobs over documents and pages: cleaning, links, profiles, triage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.operators import pagespecs as P
from listingspark.plans.catalog import query
from listingspark.plans.listing_rules import HOST_SQL, families_sql
from listingspark.tables import table

BOILERPLATE = r"(?i)licensed under|released under|e-mail|click here|all rights reserved"


@query(
    "description_clean",
    f"""SELECT doc_id, sha256(c) AS digest, length(c) AS n FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '<[^>]*>', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '{BOILERPLATE}')), chr(10)) AS c FROM documents)""",
)
def description_clean(spark, sf_dir):
    """Tags off, blanks collapsed, boilerplate lines dropped."""
    lines = F.transform(F.split(F.regexp_replace("text", "<[^>]*>", " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    clean = F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(BOILERPLATE)), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("c")).select("doc_id", F.sha2(F.col("c").cast("binary"), 256).alias("digest"), F.length("c").cast("long").alias("n"))


@query("description_colors", f"SELECT p_partkey, regexp_extract(t, '(?i)interior(?: colou?r)?: *([A-Za-z ]+)[.]', 1) AS interior, array_to_string({families_sql('regexp_extract(t, $$(?i)interior(?: colou?r)?: *([A-Za-z ]+)[.]$$, 1)')}, ',') AS families FROM (SELECT p_partkey, 'Nice. Interior color: ' || p_name || '. Call.' AS t FROM part)")
def description_colors(spark, sf_dir):
    hint = F.regexp_extract(F.concat(F.lit("Nice. Interior color: "), "p_name", F.lit(". Call.")), r"(?i)interior(?: colou?r)?: *([A-Za-z ]+)[.]", 1)
    return table(spark, sf_dir, "part").select("p_partkey", hint.alias("interior"), F.array_join(R.color_families(hint), ",").alias("families"))


@query(
    "package_blocks",
    """WITH x AS (SELECT doc_id, generate_subscripts(b, 1) AS pos, unnest(b) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents)), n AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM x)
    SELECT doc_id, block::BIGINT AS block, min_by(left(line, 40), pos) AS heading, count(*) AS n_lines FROM n WHERE block > 0 GROUP BY ALL""",
)
def package_blocks(spark, sf_dir):
    """Short lines head blocks; a running count of headings numbers the block of each line of a document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("block", F.sum(F.when(F.length("line") < 60, 1).otherwise(0)).over(order)).where("block > 0")
    return lines.groupBy("doc_id", "block").agg(F.min_by(F.left("line", F.lit(40)), "pos").alias("heading"), F.count("*").alias("n_lines"))


MERGE_SQL = """WITH p AS (SELECT doc_id, text, list_distinct(regexp_extract_all(lower(coalesce(text, '')), 'licensed under [a-z]+')) AS found, lower(coalesce(text, '')) AS low FROM documents),
q AS (SELECT *, len(found) * 0.3 + CASE WHEN contains(low, 'license') THEN 0.25 ELSE 0 END AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'unchanged' WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN len(found) > 0 THEN 'parsed' ELSE 'no_match' END AS reason FROM p)
SELECT reason, count(*) AS n, sum(CASE WHEN reason = 'parsed' THEN len(list_distinct(list_concat(['licensed under the'], found))) ELSE 1 END)::BIGINT AS n_packages, count(*) FILTER (reason = 'parsed' AND confidence >= 0.5 AND doc_id % 2 = 0) AS n_filled FROM q GROUP BY reason"""


@query("description_merge", MERGE_SQL)
def description_merge(spark, sf_dir):
    """Parses of changed texts into stored packages.

    Texts whose stored fingerprint (planted for every third) still holds are skipped. What others say joins the packages, once each; a
    parse of 0.5 or more confidence also fills an empty field (planted for even keys). Counts by reason.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("fp", F.sha2(F.col("text").cast("binary"), 256)).withColumn("packages", F.array(F.lit("licensed under the")))
    stored = docs.where("doc_id % 3 = 0").select("doc_id", F.col("fp").alias("old"))
    rows = docs.join(stored, "doc_id", "left").withColumn("low", F.lower("text"))
    rows = rows.withColumn("found", F.array_distinct(F.regexp_extract_all("low", F.lit("licensed under [a-z]+"), F.lit(0))))
    confidence = F.size("found") * F.lit(0.3) + F.when(F.contains(F.col("low"), F.lit("license")), 0.25).otherwise(0.0)
    reason = F.when(F.col("old") == F.col("fp"), "unchanged").when(F.trim("text") == "", "empty").when(F.size("found") > 0, "parsed").otherwise("no_match")
    rows = rows.select("doc_id", reason.alias("reason"), F.when(reason == "parsed", F.array_union("packages", "found")).otherwise(F.col("packages")).alias("packages"), ((reason == "parsed") & (confidence >= 0.5) & (F.col("doc_id") % 2 == 0)).alias("fills"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.size("packages")).alias("n_packages"), F.count_if("fills").alias("n_filled"))


TEXT_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


def page_body(html):
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


@query("page_text", f"SELECT page_id, length({TEXT_SQL}) AS n_body, sha256({TEXT_SQL}) AS body, length({TEXT_SQL.replace('html,', chr(114) + 'egexp_extract(html, $$(?is)<footer[^>]*>(.*?)</footer>$$, 1),')}) AS n_footer FROM pages")
def page_text(spark, sf_dir):
    body, footer = page_body(F.col("html")), page_body(F.regexp_extract("html", r"(?is)<footer[^>]*>(.*?)</footer>", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.length(body).cast("long").alias("n_body"), F.sha2(body.cast("binary"), 256).alias("body"), F.length(footer).cast("long").alias("n_footer"))


@query(
    "link_extract",
    """WITH x AS (SELECT page_id, generate_subscripts(h, 1) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"#]+)"', 1) AS h FROM pages)), f AS (SELECT page_id, href, min(pos) AS pos FROM x GROUP BY ALL), k AS (SELECT *, starts_with(href, 'http') AS outside FROM f)
    SELECT page_id, href, outside FROM (SELECT *, row_number() OVER (PARTITION BY page_id, outside ORDER BY pos) AS r FROM k) WHERE r <= CASE WHEN outside THEN 6 ELSE 16 END""",
)
def link_extract(spark, sf_dir):
    """The first 16 links inside and 6 outside of each page, once each."""
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1))).alias("pos", "href"))
    links = links.groupBy("page_id", "href").agg(F.min("pos").alias("pos")).withColumn("outside", F.col("href").startswith("http"))
    order = Window.partitionBy("page_id", "outside").orderBy("pos")
    return links.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.when(F.col("outside"), 6).otherwise(16)).select("page_id", "href", "outside")


@query("url_mining", "SELECT page_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' ') AS urls FROM (SELECT page_id, list_transform(regexp_extract_all(html, 'https?://[A-Za-z0-9./_-]+'), lambda x: regexp_replace(x, '/$', '')) AS u FROM pages)")
def url_mining(spark, sf_dir):
    found = F.transform(F.regexp_extract_all("html", F.lit("https?://[A-Za-z0-9./_-]+"), F.lit(0)), lambda u: F.regexp_replace(u, "/$", ""))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_distinct(found), " ").alias("urls"))


TECH = {"article": "<article", "nav": "<nav", "ads": 'class="ad"', "track": "track(", "table": "<table", "list": "<li>"}


@query(
    "site_profile",
    "SELECT page_id, array_to_string(t, ',') AS tech, left(sha256(array_to_string(list_sort(t), ',')), 12) AS fingerprint, len(regexp_extract_all(html, '<script')) AS n_scripts, regexp_extract(html, '&copy;[ ]*([A-Za-z0-9.-]+)', 1) AS owner FROM (SELECT *, list_filter(["
    + ", ".join(f"CASE WHEN contains(html, '{v}') THEN '{k}' END" for k, v in TECH.items()) + "], lambda x: x IS NOT NULL) AS t FROM pages)",
)
def site_profile(spark, sf_dir):
    tech = F.array_compact(F.array(*[F.when(F.contains("html", F.lit(v)), k) for k, v in TECH.items()]))
    rows = table(spark, sf_dir, "pages").withColumn("t", tech)
    return rows.select(
        "page_id", F.array_join("t", ",").alias("tech"), F.left(F.sha2(F.array_join(F.array_sort("t"), ",").cast("binary"), 256), F.lit(12)).alias("fingerprint"),
        F.size(F.regexp_extract_all("html", F.lit("<script"), F.lit(0))).cast("long").alias("n_scripts"), F.regexp_extract("html", "&copy;[ ]*([A-Za-z0-9.-]+)", 1).alias("owner"),
    )


@query("site_metadata", f"SELECT page_id, coalesce(nullif(regexp_extract(html, 'og:site_name\" content=\"([^\"]+)', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), nullif(regexp_extract(html, '&copy;[ ]*([A-Za-z0-9.-]+)', 1), '')) AS name, regexp_replace({HOST_SQL}, '[^a-z0-9]+', '-', 'g') AS dealer_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def site_metadata(spark, sf_dir):
    pick = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    name = F.coalesce(pick('og:site_name" content="([^"]+)'), pick("<title>([^<]*)</title>"), pick("&copy;[ ]*([A-Za-z0-9.-]+)"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.regexp_replace(R.url_host(F.col("url")), "[^a-z0-9]+", "-").alias("dealer_id"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


NOISE, SIGNAL = ["password", "token", "lorem"], ["license", "version", "public", "example.com"]


@query("response_triage", "SELECT bucket, count(*) AS n, sum(hits)::BIGINT AS hits FROM (SELECT " + " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in SIGNAL) + " AS hits, CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in NOISE) + " THEN 'noise' WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in SIGNAL) + " THEN 'relevant' ELSE 'ambiguous' END AS bucket FROM documents) GROUP BY bucket")
def response_triage(spark, sf_dir):
    low = F.lower("text")
    found = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    rows = table(spark, sf_dir, "documents").select(found(SIGNAL).alias("hits"), F.when(found(NOISE) > 0, "noise").when(found(SIGNAL) > 0, "relevant").otherwise("ambiguous").alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))


#: What is planted into pages of parts, by page number: data in a graph beside a table that it outdoes, cells beside and below their headers, a list, texts, data that doesn't parse.
SPECS = [
    """'<script type="application/ld+json">{"@graph": [{"@type": "BreadcrumbList", "vehicleTransmission": "no"}, {"@type": ["Car", "Product"], "vehicleTransmission": {"name": "' || shift || '"}, "driveWheelConfiguration": "' || drive || '", "vehicleEngine": {"name": "2.0L ' || cyl || '-cyl"}}]}</script><table class="s"><tr><td>Engine</td><td>V12</td></tr><tr><td>MPG</td><td>' || city || '/' || hwy || '</td></tr></table>'""",
    """'<table><tr><th>Engine:</th><td>Turbo <b>' || cyl || ' cylinder</b></td><td>x</td></tr><tr><th>Drive&nbsp;type</th><td> ' || drive || '</td></tr><tr><td>Fuel Economy</td><td>' || city || ' / ' || hwy || ' est.</td></tr><tr><td>alone</td></tr></table><p>Now $' || p_size || ',500</p>'""",
    """'<table id="t"><tr><th>Transmission</th><th>Cylinders</th><th>Drivetrain</th><th>MPG</th></tr><tr><td>' || shift || '</td><td>V6</td><td>' || drive || '</td><td>' || city || '-' || hwy || '</td></tr></table>'""",
    """'<dl><dt>Engine</dt><dd>Electric ' || p_size || ' kWh</dd> <dt>Transmission</dt> <dd>one</dd><dt>Transmission</dt><dd>' || shift || '</dd></dl>'""",
    """'<p>Fuel economy est. of ' || city || '/' || hwy || ' for $ ' || p_size || '</p><script>var d = {"highwayFuelEconomy": "' || hwy || '"}</script>'""",
    """'<script type="application/ld+json">{"@type": "Car", broken</script><script type="application/ld+json">[{"vin": "1", "transmission": "' || shift || '", "vehicleEngine": "I4 turbo"}]</script><script>city_fuel_economy = ' || city || '</script>'""",
]
SPEC_TEXT = "replace(html, '</body>', CASE page_id % 6 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(SPECS)) + " END || '</body>')"
SPEC_VALUES = {"shift": "cast(p_size % 10 as string) || '-Speed'", "drive": "CASE WHEN p_partkey % 2 = 0 THEN 'AWD' ELSE 'FWD' END", "cyl": "cast(p_size % 9 as string)", "city": "cast(12 + p_size % 20 as string)", "hwy": "cast(20 + p_size % 20 as string)"}


def _spec_sql() -> str:
    def text(h):
        out = f"regexp_replace({h}, '<[^>]*>', ' ', 'g')"
        for entity, sign in P.ENTITIES.items():
            out = f"replace({out}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
        return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"

    def cyl(e):
        return f"coalesce(try_cast(nullif(regexp_extract({e}, '{P.CYLINDERS}', 1), '') AS INTEGER), CASE WHEN regexp_matches(upper({e}), '{P.ELECTRIC}') THEN 0 END, try_cast(nullif(substr(regexp_extract({e}, '{P.LAYOUT}', 1), 2), '') AS INTEGER))"

    cell = "regexp_extract_all({}, '(?is)<t[hd](?:\\s[^>]*)?>(.*?)</t[hd]>', 1)"
    pair = lambda a, b: f"{{'label': {text(a)}, 'value': {text(b)}}}"
    first = lambda fits, take: f"list_filter(list_transform(list_filter(ps, lambda p: {fits}), lambda p: {take}), lambda x: x IS NOT NULL)[1]"
    mpg = f"regexp_matches(lower(p.label), '{P.MPG_LABEL}') AND regexp_matches(p.value, '{P.PAIR}')"
    q = lambda v: v.replace("'", "''")
    number = lambda p, g=1: f"try_cast(nullif(regexp_extract(page, '{q(p)}', {g}), '') AS INTEGER)"
    return f"""WITH src AS (SELECT page_id, {SPEC_TEXT} AS page FROM (SELECT *, {", ".join(f"{e} AS {n}" for n, e in SPEC_VALUES.items())} FROM pages JOIN part ON p_partkey = page_id % 200)),
    a AS (SELECT page_id, page, list_transform(regexp_extract_all(page, '(?is)<dt(?:\\s[^>]*)?>.*?</dt>\\s*<dd(?:\\s[^>]*)?>.*?</dd>'), lambda x: {pair("regexp_extract(x, '(?is)<dt(?:\\s[^>]*)?>(.*?)</dt>', 1)", "regexp_extract(x, '(?is)<dd(?:\\s[^>]*)?>(.*?)</dd>', 1)")}) AS terms,
      list_transform(regexp_extract_all(page, '(?is)<table(?:\\s[^>]*)?>(.*?)</table>', 1), lambda t: regexp_extract_all(t, '(?is)<tr(?:\\s[^>]*)?>(.*?)</tr>', 1)) AS tables FROM src),
    b AS (SELECT page_id, page, list_filter(list_concat(terms, flatten(list_transform(tables, lambda rs: CASE WHEN len(rs) > 1 AND NOT regexp_matches(rs[1], '(?i)<td') THEN flatten(list_transform(rs[2:], lambda r: list_transform({cell.format('r')}, lambda c, i: {pair(cell.format('rs[1]') + '[i]', 'c')})))
      ELSE list_transform(list_filter(rs, lambda r: len({cell.format('r')}) >= 2), lambda r: {pair(cell.format('r') + '[1]', cell.format('r') + '[2]')}) END))), lambda p: p.label <> '' AND p.value <> '' AND length(p.label) < 80 AND length(p.value) < 400) AS raw FROM a),
    c AS (SELECT page_id, page, list_transform(raw, lambda p: {{'label': p.label, 'value': list_filter(raw, lambda o: o.label = p.label)[-1].value}}) AS ps FROM b),
    l AS (SELECT page_id, unnest(regexp_extract_all(page, '(?is)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>', 1)) AS t FROM src),
    n AS (SELECT page_id, unnest(list_concat([j], coalesce(json_extract(j, '$[*]'), []), coalesce(json_extract(j, '$."@graph"[*]'), []))) AS v FROM (SELECT page_id, t::JSON AS j FROM l WHERE json_valid(t))),
    d AS (SELECT page_id, {cyl("coalesce(v->>'$.vehicleEngine.name', v->>'$.vehicleEngine')")} AS cyl, coalesce(v->>'$.vehicleTransmission.name', v->>'$.vehicleTransmission', v->>'$.transmission') AS shift, v->>'$.driveWheelConfiguration' AS drive FROM n WHERE regexp_matches(lower(coalesce((v->'$."@type"')::VARCHAR, '')), '{P.VEHICLE}') OR v->>'$.vin' IS NOT NULL)
    SELECT page_id, coalesce(d.cyl, {first(f"regexp_matches(lower(p.label), '{P.ENGINE_LABEL}') AND NOT contains(lower(p.label), 'mpg')", cyl('p.value'))}) AS cylinders, coalesce(d.shift, {first(f"regexp_matches(lower(p.label), '{P.SHIFT_LABEL}') AND length(p.value) < 200", 'p.value')}) AS transmission,
      coalesce(d.drive, {first(f"regexp_matches(lower(p.label), '{P.DRIVE_LABEL}') AND length(p.value) < 120", 'p.value')}) AS drivetrain, coalesce({first(mpg, f"regexp_extract(p.value, '{P.PAIR}', 1)::INTEGER")}, {number(P.MPG_TEXT)}, {number(P.CITY_TEXT)}) AS mpg_city,
      coalesce({first(mpg, f"regexp_extract(p.value, '{P.PAIR}', 2)::INTEGER")}, {number(P.MPG_TEXT, 2)}, {number(P.HIGHWAY_TEXT)}) AS mpg_highway, try_cast(replace(regexp_extract({text('page')}, '[$]\\s*([0-9][0-9,]*)', 1), ',', '') AS BIGINT) AS price FROM c LEFT JOIN d USING (page_id)"""


@query("page_spec_extract", _spec_sql())
def page_spec_extract(spark, sf_dir):
    """Specs of vehicles from the HTML of all pages, each with a block of its own kind beside its text."""
    rows = table(spark, sf_dir, "pages").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("page_id") % 200)
    html = rows.selectExpr("*", *[f"{e} AS {n}" for n, e in SPEC_VALUES.items()]).selectExpr("page_id", f"{SPEC_TEXT} AS page")
    return P.page_specs(html, "page_id", "page")


@query(
    "redirect_check",
    f"""WITH h AS (SELECT page_id, {HOST_SQL} AS host FROM pages), p AS (SELECT a.page_id, a.host AS o, b.host AS f FROM h a JOIN h b ON b.page_id = a.page_id + 1),
    d AS (SELECT *, regexp_extract(o, '([^.]+[.][^.]+)$', 1) = regexp_extract(f, '([^.]+[.][^.]+)$', 1) AS same_site, list_has_any(list_filter(regexp_extract_all(o, '[a-z]{{3,}}'), lambda x: x NOT IN ('com', 'net', 'org', 'www', 'example', 'blog')), list_filter(regexp_extract_all(f, '[a-z]{{3,}}'), lambda x: x NOT IN ('com', 'net', 'org', 'www', 'example', 'blog'))) AS tokens FROM p)
    SELECT page_id, o <> f AS redirected, o <> f AND NOT (same_site OR (NOT regexp_matches(f, 'casino|pills|bets') AND tokens)) AS mismatch FROM d""",
)
def redirect_check(spark, sf_dir):
    """Each page is taken to redirect to the next one's host."""
    pages = table(spark, sf_dir, "pages").select("page_id", R.url_host(F.col("url")).alias("o"))
    rows = pages.join(pages.select((F.col("page_id") - 1).alias("page_id"), F.col("o").alias("f")), "page_id")
    generic = ["com", "net", "org", "www", "example", "blog"]
    tokens = lambda c: F.filter(F.regexp_extract_all(c, F.lit("[a-z]{3,}"), F.lit(0)), lambda x: ~x.isin(generic))
    related = (R.registrable_domain(F.col("o")) == R.registrable_domain(F.col("f"))) | (~F.col("f").rlike("casino|pills|bets") & F.arrays_overlap(tokens("o"), tokens("f")))
    moved = F.col("o") != F.col("f")
    return rows.select("page_id", moved.alias("redirected"), (moved & ~related).alias("mismatch"))


@query("card_link_pick", """SELECT page_id, list_filter(u, lambda x: NOT regexp_matches(x, 'facebook|maps[.]'))[1] AS website, list_filter(u, lambda x: contains(x, 'maps.'))[1] AS map FROM (SELECT page_id, [ 'https://facebook.com/' || page_id, 'https://maps.example.com/' || page_id, url ] AS u FROM pages)""")
def card_link_pick(spark, sf_dir):
    page = F.col("page_id").cast("string")
    links = F.array(F.concat(F.lit("https://facebook.com/"), page), F.concat(F.lit("https://maps.example.com/"), page), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.get(F.filter(links, lambda x: ~x.rlike("facebook|maps[.]")), F.lit(0)).alias("website"), F.get(F.filter(links, lambda x: x.contains("maps.")), F.lit(0)).alias("map"))
