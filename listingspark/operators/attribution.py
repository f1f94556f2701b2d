"""Attribution of sites to the groups that own them: candidates from page texts, the best of a site, statuses, the write-back.

Patterns are matched by expressions: the places of all matches of a pattern follow from the pieces between them. A page makes rows for its
matches only, and its text isn't carried along. Names are ranked within a site; a site with any number of pages keeps one row for each name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingspark.functions import orgs as O
from listingspark.operators.runs import commit, latest, staged

WINDOW = 200
CAP = 0.80


def matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, size, raw>>: every match of a pattern, its place and length in characters and one of its groups."""
    pieces, found, raw = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    length = lambda array, n: F.aggregate(F.slice(array, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    places = F.transform(found, lambda m, i: F.struct((length(pieces, i + 1) + length(found, i)).alias("start"), F.length(m).alias("size"), F.get(raw, i).alias("raw")))
    return F.when(text.rlike(pattern), places).otherwise(F.array().cast("array<struct<start:int,size:int,raw:string>>"))


def part(text: Column, start: Column, end: Column) -> Column:
    """Characters from start up to end; a start before the text is its start."""
    first = F.greatest(F.lit(0), start)
    return F.substring(text, first + 1, end - first)


def names_in(window: Column) -> Column:
    """The names in the first sentence of a window, once each."""
    w = F.trim(window)
    sentence = F.regexp_extract(w, r"(?s)^(.*?[.!?])\s", 1)
    w = F.left(F.when(sentence != "", sentence).otherwise(w), F.lit(WINDOW))
    known = F.filter(F.transform(F.regexp_extract_all(w, F.lit(O.KNOWN), F.lit(1)), lambda x: F.trim(x)), lambda n: (F.length(n) >= 8) & ~O.has_any(F.lower(n), O.NEGATIVE))
    names = F.concat(F.transform(F.regexp_extract_all(w, F.lit(O.SHAPED), F.lit(1)), lambda x: F.trim(x)), known)
    low = F.transform(names, F.lower)
    return F.when(F.length(w) >= 4, F.filter(names, lambda n, i: F.array_position(low, F.lower(n)) == i + 1)).otherwise(F.array().cast("array<string>"))


def _found(pages: DataFrame, patterns: list[tuple]) -> DataFrame:
    """A row for each name at each match of (number, how, signal, base, pattern, from, to, before, after): windows for anchors, the group itself for others."""
    text, low, hits = F.col("text"), F.col("_low"), []
    pages = pages.withColumn("_low", F.lower("text"))
    none = F.array().cast("array<struct<start:int,size:int,raw:string>>")
    for number, how, signal, base, pattern, first, last, before, after in patterns:
        every = matches(text, pattern, int(how != "anchor"))
        every = F.when(low.contains(O.NEEDED[signal]), every).otherwise(none) if signal in O.NEEDED else every  # looked for before the pattern is
        hits.append(F.transform(every, lambda m: F.struct(  # noqa: B023
            F.lit(number).alias("number"), F.lit(signal).alias("signal"), F.lit(base).alias("base"), m["start"].alias("start"),  # noqa: B023
            (part(text, m["start"] - first if first is not None else m["start"] + m["size"], m["start"] + m["size"] + last) if how == "anchor" else m["raw"]).alias("window"),  # noqa: B023
            part(text, m["start"] - before, m["start"] + m["size"] + after).alias("snippet"), F.lit(how == "anchor").alias("anchored"),  # noqa: B023
        )))
    rows = pages.select("site", "page", "url", "kind", "cross", F.explode(F.concat(*hits)).alias("h")).select("site", "page", "url", "kind", "cross", "h.*")
    names = F.when(F.col("anchored"), names_in(F.col("window"))).otherwise(F.array(F.trim("window")))
    return rows.select("site", "page", "url", "kind", "cross", "number", "signal", "base", "start", "snippet", F.posexplode(names).alias("at", "raw")).withColumn("name", O.normalized(F.col("raw")))


def _judged(rows: DataFrame) -> DataFrame:
    name, signal = F.col("name"), F.col("signal")
    own = O.reason(name)
    why = F.when((F.length(name) < 4) & (signal != "copyright"), "too_short_after_norm").when(O.is_department(name) & ~signal.isin(O.STRONG), "generic_business_unit").when(own != "ok", own).when(O.has_any(F.lower(name), O.VENDORS), "vendor")
    return rows.where((signal != "copyright") | (F.length(name) <= 100)).withColumn("reason", why)


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """Accepted names once for each signal, as first found; all rejections."""
    order = F.struct("page", "number", "start", "at")
    good = rows.where("reason is null").groupBy(*by, F.lower("name"), "signal").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return good.unionByName(rows.where("reason is not null"))


FIRST_PASS = [
    *((i, "anchor", signal, base, pattern, None, WINDOW, 30, 80) for i, (signal, base, pattern) in enumerate(O.ANCHORS)),
    *((20 + i, "group", signal, base, pattern, None, 0, 40, 40) for i, (signal, base, pattern) in enumerate(O.STANDALONE)),
    (40, "group", *O.COPYRIGHT, None, 0, 40, 40),
]
SECOND_PASS = [
    *((50 + i, "anchor", signal, base, pattern, 40, 180, 35, 100) for i, (signal, base, pattern) in enumerate(O.SECOND)),
    *((70 + i, "group", signal, base * 0.92, pattern, None, 0, 40, 40) for i, (signal, base, pattern) in enumerate(O.STANDALONE)),
]


def org_candidates(pages: DataFrame) -> DataFrame:
    """(site, page, kind, cross, pass, signal, name, score, snippet, reason, number, start, at) of pages (site, page, url, kind, cross, text with single blanks).

    A reason tells why a name was rejected. Sites where nothing was accepted are read again for weaker signs.
    """
    pages = staged(pages, "pages")  # texts are made once; else each filter and pattern of both passes makes them again
    weight, signal = O.page_weight(F.col("kind")), F.col("signal")
    footing = F.when(signal == "copyright", F.when(F.col("kind") == "footer", 0.88).otherwise(0.72)).otherwise(1.0)
    cued = F.lower("text").rlike(O.CUES)  # most texts have none, and needn't meet every pattern
    found = staged(_found(pages.where((F.length("text") >= 20) & cued), FIRST_PASS), "found")  # a few rows for each page that matched; both passes read them
    first = _first(_judged(found), "site", "page").withColumn("score", F.least(F.lit(CAP), F.col("base") * weight * footing))
    bare = pages.where(F.length("text") >= 40).join(first.where("reason is null").select("site").distinct(), "site", "left_anti")
    about = F.lower(F.concat_ws(" ", "url", "kind"))
    told = O.has_any(F.concat_ws(" ", about, F.lower("text")), O.SECOND_WORDS)
    boost = F.when(O.has_any(about, O.BOOST_WORDS), 1.06).otherwise(1.0)
    second = _first(_judged(_found(bare.where(told), SECOND_PASS)), "site").withColumn("score", F.least(F.lit(CAP), F.col("base") * weight * boost))
    both = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
    return both.select("site", "page", "kind", "cross", "pass", "signal", "name", "score", "snippet", "reason", "number", "start", "at")


def best_names(candidates: DataFrame) -> DataFrame:
    """(site, name, canonical, confidence, specificity, tier, signal, n_names, n_rejected, cross): the best name of each site with any candidate."""
    good = F.col("reason").isNull()
    rows = candidates.withColumn("composite", O.composite(F.col("score"), F.col("name"), F.col("kind"), F.col("signal"), F.col("snippet"), F.col("cross")))
    rows = rows.withColumns({"tier": O.tier(F.col("kind"), F.col("signal"), F.col("cross")), "specificity": O.specificity(F.col("name"))})
    rank = F.struct(-F.col("composite"), F.when(F.col("tier") == "strong", 0).when(F.col("tier") == "medium", 1).otherwise(2), -F.col("specificity"), "page", "number", "start", "at")
    key = O.lookup_key(O.canonical(F.col("name")))
    names = rows.where(good).groupBy("site", key.alias("key")).agg(F.min_by(F.struct("name", "composite", "tier", "signal"), rank).alias("x"), F.min(rank).alias("rank"), F.bool_or("cross").alias("cross"))
    best = names.groupBy("site").agg(F.min_by("x", "rank").alias("x"), F.count("*").alias("n_names"), F.bool_or("cross").alias("cross"))
    rejected = rows.where(~good).groupBy("site").agg(F.count("*").alias("n_rejected"))
    out = best.select("site", "x.*", "n_names", "cross").join(rejected, "site", "full_outer")
    return out.select("site", "name", O.canonical(F.col("name")).alias("canonical"), F.coalesce("composite", F.lit(0.0)).alias("confidence"), O.specificity(O.canonical(F.col("name"))).alias("specificity"), "tier", "signal", F.coalesce("n_names", F.lit(0)).alias("n_names"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), F.coalesce("cross", F.lit(False)).alias("cross"))


def adjudicated(sites: DataFrame, model: DataFrame) -> DataFrame:
    """Sites with their rule results (loaded, mismatch, name, canonical, confidence, n_pages, ...) and the model's (site, ai_name, ai_confidence): merged name, confidence, status, source and skip reason.

    A model is asked only where the rules leave a doubt; where it wasn't, `skip` says why.
    """
    rc, rn, ac, an = map(F.col, ("confidence", "name", "ai_confidence", "ai_name"))
    vendor = F.coalesce(O.has_any(F.lower("canonical"), O.VENDORS), F.lit(False))
    rule = F.when(~F.col("loaded"), "fetch_failed").when(F.col("mismatch"), "manual_review").when(vendor, "unknown").otherwise(O.status(rc, rn.isNotNull()))
    sure = (rc >= CAP) & rn.isNotNull()
    silent = F.col("n_names") == 0
    skip = (
        F.when(~F.col("loaded"), "insufficient_evidence").when(F.col("mismatch"), "redirect_mismatch").when(sure, "strong_rule_reject")
        .when(silent & ((F.col("n_pages") <= 1) | (F.col("n_rejected") < 3)), F.when(F.col("n_pages") > 1, "low_signal_pages_only").otherwise("no_plausible_candidates"))
    )
    rows = sites.withColumns({"rule_status": rule, "skip": skip}).join(model, "site", "left")
    asked = F.col("skip").isNull() & ac.isNotNull()
    differ = F.coalesce(asked & (F.lower(F.trim(rn)) != F.lower(F.trim(an))) & (F.greatest(rc, ac) >= 0.35), F.lit(False))
    merged = F.coalesce(an, rn)
    both = F.when(merged.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(rc, ac * 0.92)))
    source = F.when(~asked, "rules_only").when(differ, "hybrid_disagree").otherwise("ai")
    final = F.when(F.col("source") == "rules_only", F.col("rule_status")).when(F.col("source") == "hybrid_disagree", "manual_review").otherwise(O.status(F.col("merged_confidence"), F.col("merged").isNotNull()))
    return rows.withColumns({
        "source": source, "merged": F.when(~asked, rn).when(differ, F.when(ac >= rc, an).otherwise(rn)).otherwise(merged), "merged_confidence": F.when(~asked, rc).when(differ, F.least(rc, ac) * 0.85).otherwise(both),
    }).withColumn("status", final)


def reinforced(sites: DataFrame) -> DataFrame:
    """`group` as the longest canonical label of a known family where two or more of its sites are assigned (ties: the least); `sibling` marks those that changed."""
    rows = sites.withColumn("group", O.canonical(F.col("merged"))).withColumn("family", O.family_key(F.col("merged")))
    best = rows.where("status = 'assigned' AND family IS NOT NULL").groupBy("family").agg(F.count("*").alias("n"), F.min_by("group", F.struct(-F.length("group"), "group")).alias("longest")).where("n >= 2")
    changed = F.coalesce((F.col("status") == "assigned") & (F.col("longest") != F.col("group")), F.lit(False))
    return rows.join(F.broadcast(best.select("family", "longest")), "family", "left").withColumns({"sibling": changed, "group": F.when(changed, F.col("longest")).otherwise(F.col("group"))})  # four families at most


def crawled(pages: DataFrame) -> DataFrame:
    """(site, loaded, error, mismatch, n_pages): what fetching left of each site, from pages (site, page, fetch_status, mismatch)."""
    good = F.col("fetch_status") == 200
    worst = F.max(F.when(~good, F.col("fetch_status")))
    rows = pages.groupBy("site").agg(F.bool_or(good).alias("loaded"), F.concat(F.lit("http_"), worst.cast("string")).alias("error"), F.bool_or(good & F.col("mismatch")).alias("mismatch"), F.count_if(good).alias("n_pages"))
    return rows


def attributed(pages: DataFrame, model: DataFrame) -> DataFrame:
    """Every site of pages (site, page, url, kind, cross, text, fetch_status, mismatch) with its group, confidence, status and diagnostics; the model's answers are a table.

    Stages: fetch outcome, candidates of what was loaded, the best name, rules and model together, families.
    """
    candidates = staged(org_candidates(pages.where("fetch_status = 200")), "candidates")
    sites = crawled(pages).join(best_names(candidates), "site", "left").fillna({"confidence": 0.0, "n_names": 0, "n_rejected": 0})
    return reinforced(adjudicated(sites, model))


def enriched(store: DataFrame, sites: DataFrame, run: str) -> DataFrame:
    """The next version of the store (id, root, ready, dealer_group, confidence, status, run_id, ...): results replace what is stored unless they're null; status and run always do.

    `why` tells what kept a dealer out, or a site from a sure name; dealers that weren't sent keep all they have.
    """
    told = ["group", "merged_confidence", "status", "skip", "error", "sibling", "source", "n_names", "n_rejected"]
    results = sites.select(F.col("site").alias("_site"), *[F.col(c).alias(f"_{c}") for c in told])
    rooted = F.coalesce(F.trim("root") != "", F.lit(False))
    ready = F.coalesce("ready", F.lit(False))
    rows = store.join(results, rooted & ready & (F.col("root") == F.col("_site")), "left")
    here = F.col("_site").isNotNull()
    new = {
        "dealer_group": F.coalesce("_group", "dealer_group"), "confidence": F.coalesce("_merged_confidence", "confidence"),
        "status": F.when(here, F.col("_status")).otherwise(F.col("status")), "run_id": F.when(here, F.lit(run)).otherwise(F.col("run_id")),
    }
    why = F.when(~rooted, "no_website").when(~ready, "not_ready").when(~here, "not_crawled").when(F.col("_status") == "fetch_failed", F.concat(F.lit("fetch_failed:"), "_error")).otherwise(F.col("_skip"))
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in store.columns], why.alias("why"), F.coalesce("_sibling", F.lit(False)).alias("sibling"), F.col("_source").alias("source"), F.col("_n_names").alias("n_names"), F.col("_n_rejected").alias("n_rejected"))


def enrichment_run(folder: str, pages: DataFrame, model: DataFrame, run: str) -> int:
    """Reads the newest version of the dealer store in the folder and commits the next one, enriched, in one write. Diagnostics are columns of it."""
    spark = pages.sparkSession
    store = latest(spark, folder)
    store = store.drop("why", "sibling", "source", "n_names", "n_rejected")
    return commit(enriched(store, attributed(pages, model), run), folder)
