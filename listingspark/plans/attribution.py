"""Attribution of stores to groups: names, scores, statuses, adjudication. Inputs are planted from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingspark.functions import orgs as O
from listingspark.functions import rules as R
from listingspark.operators import attribution as A
from listingspark.operators.runs import commit, latest
from listingspark.plans.catalog import query
from listingspark.plans.listing_rules import HOST_SQL
from listingspark.plans.text_jobs import TEXT_SQL, page_body
from listingspark.streaming.jobs import scratch
from listingspark.tables import table

def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(text: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w))) > 0"


def bare_sql(c: str) -> str:
    return f"trim(regexp_replace(trim({c}), '{O.ARTICLES}', ''))"


def normalized_sql(c: str) -> str:
    ends = O.ENDS.replace("'", "''")
    out = f"regexp_replace(regexp_replace({bare_sql(c)}, '{ends}', '', 'g'), '\\s+', ' ', 'g')"
    for glued, parted in (("groupplaywright", "Group"), ("automotivegroup", "Automotive Group"), ("autogroup", "Auto Group")):
        out = f"regexp_replace({out}, '(?i){glued}', '{parted}', 'g')"
    return f"trim({out})"


def reason_sql(c: str) -> str:
    """DuckDB's expression of orgs.reason()."""
    s = bare_sql(c)
    words = f"regexp_extract_all(lower({s}), '[a-z]+')"
    entity, family = f"list_has_any({words}, {_list(O.ENTITY)})", _any(f"lower({s})", O.FAMILIES)
    stop = f"CASE WHEN len({words}) = 0 THEN 1 ELSE len(list_filter({words}, lambda w: list_contains({_list(O.STOPWORDS)}, w))) / len({words})::DOUBLE END"
    parts = f"regexp_extract_all({s}, '[A-Za-z][a-z]+|[A-Z]{{2,}}')"
    title = f"(len({parts}) >= 2 AND len(list_filter({parts}, lambda p: regexp_matches(p, '^[A-Z]'))) >= greatest(1, len({parts}) // 2))"
    return f"""CASE WHEN {s} = '' THEN 'empty' WHEN length({s}) < 4 THEN 'too_short' WHEN length({s}) > 120 THEN 'too_long' WHEN length({s}) - length(replace({s}, ' ', '')) > 14 THEN 'too_many_words'
    WHEN list_contains({_list(O.GENERIC_START)}, string_split(lower({s}), ' ')[1]) THEN 'generic_start' WHEN {_any(f"lower({s})", O.NEGATIVE)} THEN 'negative_phrase' WHEN ({stop}) > 0.42 AND NOT {entity} THEN 'too_many_stopwords'
    WHEN length({s}) - length(replace({s}, ',', '')) >= 2 THEN 'comma_clause' WHEN regexp_matches(lower({s}), '\\b(?:{'|'.join(O.CLAUSES)})\\b') THEN 'subordinate_clause'
    WHEN NOT {entity} AND NOT {family} AND NOT {title} THEN 'not_entity_shaped' WHEN NOT {entity} AND NOT {family} AND len(regexp_extract_all(lower({s}), '[a-z0-9]+')) > 8 THEN 'long_without_entity_word' ELSE 'ok' END"""


#: Three texts of each document: its first 60 characters, as they are and in capitalised words with an entity word, and its first line.
NAMES_SQL = "SELECT doc_id, 0 AS k, left(text, 60) AS name FROM documents UNION ALL SELECT doc_id, 1, 'The ' || array_to_string(list_transform(regexp_extract_all(left(text, 60), '[A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), ' ') || CASE WHEN doc_id % 3 = 0 THEN ' Motors' ELSE '' END FROM documents UNION ALL SELECT doc_id, 2, string_split(text, chr(10))[1] FROM documents"


@query("org_plausibility", f"SELECT doc_id, k, {reason_sql('name')} AS reason FROM (SELECT doc_id, k, coalesce(trim(regexp_replace(name, '[ \t\r\n]+', ' ', 'g')), '') AS name FROM ({NAMES_SQL}))")
def org_plausibility(spark, sf_dir):
    """Whether parts of real documents are names of organisations, and why not."""
    text = F.col("text")
    title = F.transform(F.regexp_extract_all(F.left(text, F.lit(60)), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 20))))
    names = F.array(F.left(text, F.lit(60)), F.concat(F.lit("The "), F.array_join(title, " "), F.when(F.col("doc_id") % 3 == 0, " Motors").otherwise("")), F.get(F.split(text, "\n"), F.lit(0)))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(names).alias("k", "name"))
    name = F.coalesce(F.trim(F.regexp_replace("name", r"[ \t\r\n]+", " ")), F.lit(""))
    return rows.select("doc_id", "k", O.reason(name).alias("reason"))


def composite(raw: Column, specificity: Column, multiplier: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * (0.35 + 0.65 * specificity) * multiplier * penalty))


SCORE_SQL = "greatest(0, least(1, (l_quantity / 50) * (0.35 + 0.65 * (l_discount * 10)) * (1 + l_tax) * CASE WHEN l_linenumber = 7 THEN 0.5 ELSE 1 END))"


def _scored(spark, sf_dir):
    score = composite(F.col("l_quantity") / 50, F.col("l_discount") * 10, 1 + F.col("l_tax"), F.when(F.col("l_linenumber") == 7, 0.5).otherwise(1.0))
    return table(spark, sf_dir, "lineitem").withColumn("score", score)


@query("candidate_score", f"SELECT CASE WHEN s >= 0.8 THEN 'strong' WHEN s >= 0.4 THEN 'medium' ELSE 'weak' END AS tier, count(*) AS n, round(avg(s), 6) AS mean FROM (SELECT {SCORE_SQL} AS s FROM lineitem) GROUP BY tier")
def candidate_score(spark, sf_dir):
    s = F.col("score")
    return _scored(spark, sf_dir).groupBy(F.when(s >= 0.8, "strong").when(s >= 0.4, "medium").otherwise("weak").alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(
    "status_assign",
    f"""WITH b AS (SELECT l_orderkey AS site, max({SCORE_SQL}) AS c, max(l_suppkey) AS name FROM lineitem GROUP BY l_orderkey)
    SELECT site, CASE WHEN site % 11 = 0 THEN 'fetch_failed' WHEN site % 13 = 0 THEN 'manual_review' WHEN site % 17 = 0 THEN 'unknown' WHEN c >= 0.8 THEN 'assigned' WHEN c >= 0.55 THEN 'manual_review' WHEN name % 2 = 0 THEN 'manual_review_low_confidence' ELSE 'unknown' END AS status FROM b""",
)
def status_assign(spark, sf_dir):
    """Fetch, redirect and vendor flags (planted by site number) come before the confidence."""
    best = _scored(spark, sf_dir).groupBy(F.col("l_orderkey").alias("site")).agg(F.max("score").alias("c"), F.max("l_suppkey").alias("name"))
    site = F.col("site")
    out = F.when(site % 11 == 0, "fetch_failed").when(site % 13 == 0, "manual_review").when(site % 17 == 0, "unknown").otherwise(O.status(F.col("c"), F.col("name") % 2 == 0))
    return best.select("site", out.alias("status"))


@query(
    "adjudication_merge",
    """WITH r AS (SELECT o_orderkey AS site, least(1, o_totalprice / 300000) AS rc, CASE WHEN o_orderkey % 5 <> 0 THEN 'g' || (o_custkey % 3) END AS rn FROM orders), a AS (SELECT l_orderkey AS site, max(l_discount) * 10 AS ac, 'g' || (max(l_suppkey) % 3) AS an FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey),
    j AS (SELECT r.site, rc, rn, ac, an, an IS NOT NULL AND rn IS NOT NULL AND an <> rn AND greatest(rc, ac) >= 0.35 AS disagree, greatest(rc, ac * 0.92) AS best FROM r LEFT JOIN a USING (site)),
    k AS (SELECT site, CASE WHEN an IS NULL THEN rn WHEN disagree THEN CASE WHEN ac >= rc THEN an ELSE rn END WHEN rc >= 0.8 AND rn IS NOT NULL THEN rn ELSE coalesce(an, rn) END AS name,
    CASE WHEN an IS NULL THEN rc WHEN disagree THEN least(rc, ac) * 0.85 WHEN rc >= 0.8 AND rn IS NOT NULL THEN rc ELSE least(1, best) END AS confidence, CASE WHEN an IS NULL OR (NOT disagree AND rc >= 0.8 AND rn IS NOT NULL) THEN 'rules_only' WHEN disagree THEN 'hybrid_disagree' ELSE 'ai' END AS source FROM j)
    SELECT site, name, round(confidence, 4) AS confidence, source, CASE WHEN source = 'hybrid_disagree' THEN 'manual_review' WHEN confidence >= 0.8 THEN 'assigned' WHEN confidence >= 0.55 THEN 'manual_review' WHEN name IS NOT NULL THEN 'manual_review_low_confidence' ELSE 'unknown' END AS status FROM k""",
)
def adjudication_merge(spark, sf_dir):
    """Rule results joined to a table of model results: they disagree, or the rule is sure, or the better of both counts."""
    rules = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site"), F.least(F.lit(1.0), F.col("o_totalprice") / 300000).alias("rc"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("g"), (F.col("o_custkey") % 3).cast("string"))).alias("rn"))
    model = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("site")).agg((F.max("l_discount") * 10).alias("ac"), F.concat(F.lit("g"), (F.max("l_suppkey") % 3).cast("string")).alias("an"))
    rc, rn, ac, an = map(F.col, ("rc", "rn", "ac", "an"))
    alone = an.isNull()
    disagree = F.coalesce((an != rn) & (F.greatest(rc, ac) >= 0.35), F.lit(False))
    sure = (rc >= 0.8) & rn.isNotNull()
    rows = rules.join(model, "site", "left").select(
        "site", F.when(alone, rn).when(disagree, F.when(ac >= rc, an).otherwise(rn)).when(sure, rn).otherwise(F.coalesce(an, rn)).alias("name"),
        F.when(alone, rc).when(disagree, F.least(rc, ac) * 0.85).when(sure, rc).otherwise(F.least(F.lit(1.0), F.greatest(rc, ac * 0.92))).alias("confidence"),
        F.when(alone | (~disagree & sure), "rules_only").when(disagree, "hybrid_disagree").otherwise("ai").alias("source"),
    )
    final = F.when(F.col("source") == "hybrid_disagree", "manual_review").otherwise(O.status(F.col("confidence"), F.col("name").isNotNull()))
    return rows.select("site", "name", F.round("confidence", 4).alias("confidence"), "source", final.alias("status"))


@query("snippet_provenance", "SELECT kind, count(*) AS n, count(DISTINCT host) AS hosts FROM (SELECT CASE WHEN contains(url, '.html') THEN 'cross_domain:' ELSE '' END || regexp_extract(url, '://[^/?#]*/([a-z]+)', 1) AS kind, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) GROUP BY kind")
def snippet_provenance(spark, sf_dir):
    kind = F.concat(F.when(F.contains("url", F.lit(".html")), "cross_domain:").otherwise(""), F.regexp_extract("url", "://[^/?#]*/([a-z]+)", 1))
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("hosts"))


# ---------------------------------------------------------------- candidates from pages and documents

#: Sentences planted into pages by their number; {N} is a word of the page's host. Every kind of signal and of rejection is among them.
PLANTS = [
    "Our store is part of the {N} Automotive Group. Visit us.", "{N} Cars is owned by {N} Holdings LLC. Call today.", "We are a member of the {N} Motors family.", "Copyright 2019-2024 {N} Auto Partners Inc | All rights reserved.",
    "It is operated by the {N} Family and friends.", "Ask the Collision Group of the town for repairs.", "This site is owned by Dealer Inspire Group of vendors.", "We are part of the Tuttle-Click Automotive Group. Welcome.",
    "Tuttle Click Automotive Group runs this store.", "Sonic Automotive runs this store, says the parent company. Review specials Group.", "Nothing is said here about owners.", "The {N} and {N} Auto Group, part of Penske Auto Holdings Corp. Thanks.",
    "A family of dealerships: {N} Motors, and {N} Group. More.",
]
NAME_SQL = f"(SELECT page_id, url, html, regexp_extract({HOST_SQL}, '([a-z-]+)[.][a-z]+[.][a-z]+$', 1) AS word FROM pages)"
KIND_SQL = "CASE WHEN contains(lower(url), 'collision') THEN 'company' " + " ".join(f"WHEN contains(lower(url), '{k}') THEN '{k}'" for k in ("about", "privacy", "terms", "legal", "careers")) + " ELSE 'homepage' END"
#: Pages by host; a few are read as careers or about pages, failed or led elsewhere. Documents by source, as homepages.
BLOBS_SQL = f"""blobs AS (
  SELECT {HOST_SQL.replace('url', 'p.url')} AS site, page_id AS page, url, CASE page_id % 4 WHEN 1 THEN 'about' WHEN 2 THEN 'footer' WHEN 3 THEN {KIND_SQL} ELSE 'company' END AS kind, false AS "cross",
    CASE WHEN page_id % 7 = 0 THEN 504 WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS fetch_status, page_id % 29 = 0 AS mismatch,
    {TEXT_SQL.replace('html,', "replace(html, '<footer>', '<p>' || replace(" + _list(PLANTS) + f"[page_id % {len(PLANTS)} + 1], '{{N}}', upper(word[1]) || word[2:]) || '</p><footer>'),")} AS text FROM {NAME_SQL} p
  UNION ALL SELECT source, -1 - doc_id, '', 'homepage', false, 200, false, trim(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g')) FROM documents
)"""


def blobs(spark, sf_dir):
    """(site, page, url, kind, cross, fetch_status, mismatch, text): page texts with planted sentences, and the documents."""
    pages, page, host = table(spark, sf_dir, "pages"), F.col("page_id"), R.url_host(F.col("url"))
    word = F.regexp_extract(host, "([a-z-]+)[.][a-z]+[.][a-z]+$", 1)
    plant = F.replace(F.element_at(F.array(*map(F.lit, PLANTS)), (page % len(PLANTS) + 1).cast("int")), F.lit("{N}"), F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 1 << 20)))
    low = F.lower("url")
    by_url = F.when(low.contains("collision"), "company")
    for k in ("about", "privacy", "terms", "legal", "careers"):
        by_url = by_url.when(low.contains(k), k)
    html = F.replace(F.col("html"), F.lit("<footer>"), F.concat(F.lit("<p>"), plant, F.lit("</p><footer>")))
    web = pages.select(
        host.alias("site"), page.alias("page"), "url", F.when(page % 4 == 1, "about").when(page % 4 == 2, "footer").when(page % 4 == 3, by_url.otherwise("homepage")).otherwise("company").alias("kind"), F.lit(False).alias("cross"),
        F.when(page % 7 == 0, 504).when(page % 11 == 0, 404).otherwise(200).alias("fetch_status"), (page % 29 == 0).alias("mismatch"), page_body(html).alias("text"),
    )
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\n]+", " "))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("site"), (-1 - F.col("doc_id")).alias("page"), F.lit("").alias("url"), F.lit("homepage").alias("kind"), F.lit(False).alias("cross"), F.lit(200).alias("fetch_status"), F.lit(False).alias("mismatch"), text.alias("text"))
    return web.unionByName(docs)


def _values(patterns) -> str:
    return ", ".join(f"({n}, '{how}', '{signal}', {base!r}::DOUBLE, '{pattern if how != 'anchor' else '(?i)(' + pattern.removeprefix('(?i)') + ')'}', {first if first is not None else 'NULL'}, {last}, {before}, {after})".replace("[A-Za-z0-9'", "[A-Za-z0-9''").replace(r"\s,'\-", r"\s,''\-").replace(r"\.&'\-", r"\.&''\-") for n, how, signal, base, pattern, first, last, before, after in patterns)


def _found_sql(name: str, source: str, patterns) -> str:
    """DuckDB's org_candidates before judging: every pattern's matches by the pieces between them, then names in windows."""
    shaped, known = (p.replace("'", "''") for p in (O.SHAPED, O.KNOWN))
    return f"""{name}_p(number, how, signal, base, rx, first, last, before, after) AS (VALUES {_values(patterns)}),
    {name}_m AS (SELECT b.*, p.*, string_split_regex(text, rx) AS s, regexp_extract_all(text, rx) AS m, regexp_extract_all(text, rx, 1) AS g FROM {source} b JOIN {name}_p p ON regexp_matches(text, rx)),
    {name}_i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
    {name}_e AS (SELECT *, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM {name}_i),
    {name}_w AS (SELECT *, (start + length(m[i]))::BIGINT AS stop, CASE WHEN first IS NULL THEN start + length(m[i]) ELSE greatest(0, start - first) END::BIGINT AS wfrom FROM {name}_e),
    {name}_x AS (SELECT *, trim(text[wfrom + 1:stop + last]) AS w, text[greatest(0, start - before)::BIGINT + 1:stop + after] AS snippet FROM {name}_w),
    {name}_y AS (SELECT *, left(CASE WHEN regexp_extract(w, '(?s)^(.*?[.!?])\\s', 1) <> '' THEN regexp_extract(w, '(?s)^(.*?[.!?])\\s', 1) ELSE w END, {A.WINDOW}) AS cut FROM {name}_x),
    {name}_z AS (SELECT *, CASE WHEN how <> 'anchor' THEN [trim(g[i])] WHEN length(cut) < 4 THEN []::VARCHAR[] ELSE list_concat(list_transform(regexp_extract_all(cut, '{shaped}', 1), lambda n: trim(n)),
      list_filter(list_transform(regexp_extract_all(cut, '{known}', 1), lambda n: trim(n)), lambda n: length(n) >= 8 AND NOT {_any('lower(n)', O.NEGATIVE)})) END AS every FROM {name}_y),
    {name}_n AS (SELECT *, list_filter(every, lambda n, j: list_position(list_transform(every, lambda o: lower(o)), lower(n)) = j) AS names FROM {name}_z),
    {name}_u AS (SELECT * EXCLUDE (names), generate_subscripts(names, 1) - 1 AS spot, unnest(names) AS raw FROM {name}_n),
    {name}_f AS (SELECT site, page, url, kind, "cross", number, signal, base, start::BIGINT AS start, snippet, spot, {normalized_sql('raw')} AS name FROM {name}_u)"""


def _judged_sql(name: str, by: str) -> str:
    return f"""{name}_d AS (SELECT *, CASE WHEN length(name) < 4 AND signal <> 'copyright' THEN 'too_short_after_norm' WHEN {_department_sql('name')} AND NOT list_contains({_list(O.STRONG)}, signal) THEN 'generic_business_unit'
      WHEN ({reason_sql('name')}) <> 'ok' THEN {reason_sql('name')} WHEN {_any('lower(name)', O.VENDORS)} THEN 'vendor' END AS reason FROM {name}_f WHERE signal <> 'copyright' OR length(name) <= 100),
    {name}_r AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {by}, lower(name), signal, reason IS NULL ORDER BY page, number, start, spot) AS k FROM {name}_d) WHERE k = 1 OR reason IS NOT NULL)"""


def _department_sql(c: str) -> str:
    return f"(list_contains({_list(O.UNITS)}, lower(trim({c}))) OR " + " OR ".join(f"ends_with(lower(trim({c})), ' {d}')" for d in O.DEPARTMENTS) + ")"


WEIGHT_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in O.PAGE_WEIGHT.items()) + f" ELSE {O.OTHER_WEIGHT} END::DOUBLE"
ABOUT_SQL = "lower(concat_ws(' ', url, kind))"
CANDIDATES_SQL = f"""{_found_sql('a', "(SELECT * FROM blobs WHERE fetch_status = 200 AND length(text) >= 20)", A.FIRST_PASS)}, {_judged_sql('a', 'site, page')},
    bare AS (SELECT * FROM blobs WHERE fetch_status = 200 AND length(text) >= 40 AND site NOT IN (SELECT site FROM a_r WHERE reason IS NULL AND site IS NOT NULL) AND {_any(f"concat_ws(' ', {ABOUT_SQL}, lower(text))", O.SECOND_WORDS)}),
    {_found_sql('b', 'bare', A.SECOND_PASS)}, {_judged_sql('b', 'site')},
    candidates AS (SELECT *, 1 AS pass, least(0.8, base * {WEIGHT_SQL} * CASE WHEN signal <> 'copyright' THEN 1 WHEN kind = 'footer' THEN 0.88 ELSE 0.72 END::DOUBLE)::DOUBLE AS score FROM a_r
      UNION ALL SELECT *, 2, least(0.8, base * {WEIGHT_SQL} * CASE WHEN {_any(ABOUT_SQL, O.BOOST_WORDS)} THEN 1.06 ELSE 1 END::DOUBLE)::DOUBLE FROM b_r)"""


@query("org_candidates", f"WITH {BLOBS_SQL}, {CANDIDATES_SQL} SELECT site, page, pass, signal, name, reason, count(*) AS n, round(max(score), 6) AS score, min(length(snippet)) AS snippet FROM candidates GROUP BY ALL")
def org_candidates(spark, sf_dir):
    """Names after ownership anchors, standing alone and in copyright lines, of pages and documents; a second pass over sites without any; rejections with reasons."""
    rows = A.org_candidates(blobs(spark, sf_dir).where("fetch_status = 200"))
    return rows.groupBy("site", "page", "pass", "signal", "name", "reason").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("score"), F.min(F.length("snippet")).cast("long").alias("snippet"))


# ---------------------------------------------------------------- the whole run

KEY_SQL = "lower(trim(regexp_replace(replace({c}, '-', ' '), '\\s+', ' ', 'g')))"


def key_sql(c: str) -> str:
    return KEY_SQL.format(c=bare_sql(c))


def canonical_sql(c: str) -> str:
    k = key_sql(c)
    return f"CASE {k} " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in O.ALIASES.items()) + f" ELSE CASE WHEN contains({k}, 'tuttle') AND contains({k}, 'click') THEN 'Tuttle-Click Automotive Group' WHEN contains({k}, 'sonic') AND contains({k}, 'automotive') THEN 'Sonic Automotive' ELSE trim({c}) END END"


def distinctive_sql(c: str) -> str:
    tokens = f"regexp_extract_all(lower({c}), '[a-z0-9]+(?:''[a-z]+)?')"
    return f"({_any(f'lower({c})', O.FAMILIES)} OR regexp_matches({c}, '[A-Za-z]+-[A-Za-z]+') OR (len({tokens}) >= 2 AND len(list_filter({tokens}, lambda t: NOT list_contains({_list(O.GENERIC_TOKENS)}, t) AND length(t) > 1)) >= 2))"


def specificity_sql(c: str) -> str:
    unit, own = _department_sql(c), distinctive_sql(c)
    return f"CASE WHEN trim({c}) = '' THEN 0 WHEN {unit} AND NOT {own} THEN 0.15 WHEN {_any(f'lower({c})', O.FAMILIES)} THEN 0.95 WHEN {_any(f'lower({c})', O.GROUP_WORDS)} THEN 0.85 WHEN {own} AND NOT {unit} THEN 0.72 WHEN {unit} THEN 0.42 ELSE 0.55 END::DOUBLE"


TIER_SQL = "CASE WHEN contains(signal, 'part_of') AND kind IN ('homepage', 'about', 'footer') THEN 'strong' WHEN signal IN ('owned_by', 'parent_company', 'member_of_the', 'sonic_corporate', 'known_family_group') THEN 'strong' WHEN kind = 'company' THEN 'weak' ELSE 'medium' END"
STATUS_SQL = "CASE WHEN {c} >= 0.8 THEN 'assigned' WHEN {c} >= 0.55 THEN 'manual_review' WHEN {n} IS NOT NULL THEN 'manual_review_low_confidence' ELSE 'unknown' END"
FAMILY_SQL = f"CASE WHEN contains({key_sql('grp')}, 'tuttle') AND contains({key_sql('grp')}, 'click') THEN 'tuttle_click' WHEN contains({key_sql('grp')}, 'sonic') THEN 'sonic' WHEN contains({key_sql('grp')}, 'hendrick') THEN 'hendrick' WHEN contains({key_sql('grp')}, 'penske') THEN 'penske' END"
ENRICHMENT_SQL = f"""WITH {BLOBS_SQL}, {CANDIDATES_SQL},
scored AS (SELECT *, {TIER_SQL} AS tier, {specificity_sql('name')} AS spec, list_contains({_list(O.STRONG)}, signal) AS strong, {_any('lower(snippet)', O.OWNERSHIP)} AS told FROM candidates),
ranked AS (SELECT *, greatest(0, least(1, score * (0.35::DOUBLE + 0.65::DOUBLE * spec) * greatest(0.35, least(1.35, CASE tier WHEN 'strong' THEN 1.18 WHEN 'medium' THEN 1 ELSE 0.82 END::DOUBLE * CASE WHEN kind <> 'company' THEN 1 WHEN told OR strong THEN 1.05 ELSE 0.72 END::DOUBLE))
  * CASE WHEN NOT {_department_sql('name')} THEN 1 WHEN strong THEN 0.72 WHEN told AND {distinctive_sql('name')} THEN 0.55 ELSE 0.06 END::DOUBLE)) AS composite FROM scored),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY composite DESC, CASE tier WHEN 'strong' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, spec DESC, page, number, start, spot) AS k FROM ranked WHERE reason IS NULL) WHERE k = 1),
counts AS (SELECT site, count(DISTINCT {key_sql(canonical_sql('name'))}) FILTER (reason IS NULL) AS n_names, count(*) FILTER (reason IS NOT NULL) AS n_rejected FROM ranked GROUP BY site),
fetched AS (SELECT site, bool_or(fetch_status = 200) AS loaded, 'http_' || max(fetch_status) FILTER (fetch_status <> 200) AS error, bool_or(fetch_status = 200 AND mismatch) AS mismatch, count(*) FILTER (fetch_status = 200) AS n_pages FROM blobs GROUP BY site),
sites AS (SELECT f.*, b.name, coalesce(b.composite, 0) AS rc, coalesce(c.n_names, 0) AS n_names, coalesce(c.n_rejected, 0) AS n_rejected FROM fetched f LEFT JOIN best b USING (site) LEFT JOIN counts c USING (site)),
asked AS (SELECT *, CASE WHEN NOT loaded THEN 'fetch_failed' WHEN mismatch THEN 'manual_review' WHEN {_any('lower(name)', O.VENDORS)} THEN 'unknown' ELSE {STATUS_SQL.format(c='rc', n='name')} END AS rule_status,
  CASE WHEN NOT loaded THEN 'insufficient_evidence' WHEN mismatch THEN 'redirect_mismatch' WHEN rc >= 0.8 AND name IS NOT NULL THEN 'strong_rule_reject' WHEN n_names = 0 AND (n_pages <= 1 OR n_rejected < 3) THEN CASE WHEN n_pages > 1 THEN 'low_signal_pages_only' ELSE 'no_plausible_candidates' END END AS skip,
  CASE WHEN length(site) % 3 = 0 THEN (length(site) * 7 % 10) / 10.0 END::DOUBLE AS ac, CASE WHEN length(site) % 3 = 0 AND length(site) % 2 = 0 THEN 'Model Auto Group' WHEN length(site) % 3 = 0 THEN upper(regexp_extract(site, '([a-z-]+)[.][a-z]+[.][a-z]+$', 1)[1]) || regexp_extract(site, '([a-z-]+)[.][a-z]+[.][a-z]+$', 1)[2:] || ' Automotive Group' END AS an FROM sites),
told AS (SELECT *, skip IS NULL AND ac IS NOT NULL AS used, coalesce(skip IS NULL AND ac IS NOT NULL AND lower(trim(name)) <> lower(trim(an)) AND greatest(rc, ac) >= 0.35, false) AS differ FROM asked),
merged AS (SELECT *, CASE WHEN NOT used THEN 'rules_only' WHEN differ THEN 'hybrid_disagree' ELSE 'ai' END AS source, CASE WHEN NOT used THEN name WHEN differ THEN CASE WHEN ac >= rc THEN an ELSE name END ELSE coalesce(an, name) END AS merged,
  CASE WHEN NOT used THEN rc WHEN differ THEN least(rc, ac) * 0.85::DOUBLE WHEN coalesce(an, name) IS NULL THEN 0 ELSE least(1, greatest(rc, ac * 0.92::DOUBLE)) END AS mc FROM told),
final AS (SELECT *, CASE source WHEN 'rules_only' THEN rule_status WHEN 'hybrid_disagree' THEN 'manual_review' ELSE {STATUS_SQL.format(c='mc', n='merged')} END AS status, {canonical_sql('merged')} AS grp FROM merged),
families AS (SELECT *, {FAMILY_SQL} AS family FROM final),
longest AS (SELECT family, min_by(grp, (-length(grp), grp)) AS longest FROM families WHERE status = 'assigned' AND family IS NOT NULL GROUP BY family HAVING count(*) >= 2),
done AS (SELECT f.*, coalesce(status = 'assigned' AND longest <> grp, false) AS sibling, CASE WHEN status = 'assigned' AND longest <> grp THEN longest ELSE grp END AS final_group FROM families f LEFT JOIN longest USING (family)),
store AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 19 > 0 THEN {HOST_SQL} END AS root, c_acctbal > 0 AS ready, CASE WHEN c_custkey % 5 = 0 THEN 'Old ' || c_mktsegment END AS dealer_group FROM customer LEFT JOIN pages ON page_id = c_custkey % 500)
SELECT id, root, coalesce(final_group, dealer_group) AS dealer_group, round(mc, 6) AS confidence, d.status, CASE WHEN d.site IS NOT NULL THEN 'run-1' END AS run_id,
  CASE WHEN coalesce(trim(root), '') = '' THEN 'no_website' WHEN NOT ready THEN 'not_ready' WHEN d.site IS NULL THEN 'not_crawled' WHEN d.status = 'fetch_failed' THEN 'fetch_failed:' || error ELSE skip END AS why, coalesce(sibling, false) AS sibling, source, n_names, n_rejected
FROM store LEFT JOIN done d ON root = d.site AND ready AND trim(root) <> ''"""


@query("oem_enrichment", ENRICHMENT_SQL)
def oem_enrichment(spark, sf_dir):
    """Ready dealers with a website take the group that their site's pages tell: a stored version, one run, one commit; failed sites stay, with a reason.

    Dealers (customers) have the hosts of pages as websites; the model's answers are a table by host.
    """
    pages, customers = table(spark, sf_dir, "pages").select("page_id", R.url_host(F.col("url")).alias("host")), table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    store = customers.join(pages, key % 500 == F.col("page_id"), "left").select(
        key.alias("id"), F.when(key % 19 > 0, F.col("host")).alias("root"), (F.col("c_acctbal") > 0).alias("ready"), F.when(key % 5 == 0, F.concat(F.lit("Old "), "c_mktsegment")).alias("dealer_group"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("run_id"),
    )
    folder = scratch(spark, "dealers")
    commit(store, folder)
    rows = blobs(spark, sf_dir)
    size, word = F.length("site"), F.regexp_extract("site", "([a-z-]+)[.][a-z]+[.][a-z]+$", 1)
    named = F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 1 << 20), F.lit(" Automotive Group"))
    model = rows.select("site").distinct().where(size % 3 == 0).select("site", F.when(size % 2 == 0, "Model Auto Group").otherwise(named).alias("ai_name"), ((size * 7 % 10) / 10).alias("ai_confidence"))
    A.enrichment_run(folder, rows, model, "run-1")
    return latest(spark, folder).select("id", "root", "dealer_group", F.round("confidence", 6).alias("confidence"), "status", "run_id", "why", "sibling", "source", "n_names", "n_rejected")
