"""Names of organisations: what makes a text one, how it is written, and how much a finding says."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, phrases, patterns and weights that results depend on.
NEGATIVE = [
    "privacy policy", "terms of use", "terms of service", "cookie policy", "highlight the best aspects", "charlotte community", "the charlotte community", "posting updates and changes",
    "all rights reserved", "schedule service", "view inventory", "parts center", "model lineup", "contact us", "reviews", "specials", "payment calculator", "this privacy policy", "the terms of use",
    "these terms", "our job to", "your information", "we collect", "we may", "you agree",
]
ENTITY = "automotive auto group motors motorcars holdings family corporation corp inc llc lp company dealerships dealership dealers enterprises".split()
FAMILIES = [
    "hendrick", "penske", "lithia", "sonic", "autonation", "group 1", "group1", "asbury", "tuttle-click", "tuttle click", "fletcher jones", "morgan", "holman", "galpin", "sewell", "bermuda", "ken garff",
    "larry h miller", "priority", "flow",
]
GENERIC_START = "this these that our your we you their its".split()
STOPWORDS = """
the a an and or but if in on at to for of as is was are were be been being with by from that this these those we you our your they their its not no so such any all each both few more most other some than too
very can will just also only own same when while which who whom how about into through during before after above below between under again further then once here there where why
""".split()
CLAUSES = "which that because although while where".split()
DEPARTMENTS = ["collision group", "collision center", "service center", "finance center", "parts center"]
UNITS = [*DEPARTMENTS, "body shop", "detail center"]
GENERIC_TOKENS = "group center centre automotive auto collision service finance parts body motor motors dealership dealerships no 1".split()
GROUP_WORDS = ["automotive group", "auto group", "motorcars", "holdings", "dealerships"]
VENDORS = ["dealer.com", "dealeron", "dealer on", "shift digital", "cdk global", "cdk ", "reynolds and reynolds", "reynolds & reynolds", "dealer inspire", "team velocity", "foxdealer", "sincro"]
OWNERSHIP = ["part of ", "owned by ", "member of ", "parent company", "affiliated with ", "subsidiary of "]
#: Signals that prove ownership by themselves; the second pass has only some of its own.
STRONG = [
    "explicit_is_part_of_the", "part_of_the", "member_of_the", "owned_by", "parent_company", "part_of", "operated_by", "family_dealerships", "automotive_group", "auto_group", "known_family_group", "sonic_corporate",
    "copyright", "second_pass_partof", "second_pass_member", "second_pass_owned",
]
PAGE_WEIGHT = {"about": 1.0, "privacy": 0.55, "terms": 0.55, "legal": 0.6, "careers": 0.65, "footer": 0.5, "homepage": 0.42, "company": 0.72, "cross_domain_legal": 0.82, "cross_domain_group": 0.78}
OTHER_WEIGHT = 0.4
#: (signal, base score, pattern); what follows an anchor is read for names.
ANCHORS = [
    ("explicit_is_part_of_the", 0.96, r"(?i)\bis\s+part\s+of\s+the\b"), ("member_of_the", 0.94, r"(?i)\b(?:a\s+)?member\s+of\s+the\s+\S"), ("part_of_the", 0.93, r"(?i)\bpart\s+of\s+the\s+\S"),
    ("owned_by", 0.92, r"(?i)\bowned\s+by\b"), ("parent_company", 0.88, r"(?i)\bparent\s+company\b"), ("part_of", 0.88, r"(?i)\b(?:part of|a member of|member of)\b"),
    ("operated_by", 0.86, r"(?i)\b(?:operated|managed)\s+by\b"), ("family_dealerships", 0.65, r"(?i)\b(?:a\s+)?family\s+of\s+dealerships?\b"),
]
STANDALONE = [
    ("automotive_group", 0.8, r"\b([A-Z][A-Za-z0-9'\-]*(?:\s+[A-Z][A-Za-z0-9'\-]*){0,4}\s+Automotive\s+Group)\b"), ("auto_group", 0.76, r"\b([A-Z][A-Za-z0-9'\-]*(?:\s+[A-Z][A-Za-z0-9'\-]*){0,4}\s+Auto\s+Group)\b"),
    ("known_family_group", 0.85, r"(?i)\b((?:Hendrick|Penske|Lithia|Sonic|Asbury|AutoNation|Group\s+1|Tuttle-Click|Tuttle Click|Fletcher Jones|Holman|Morgan)\b[A-Za-z0-9\s,'\-]{0,50}?(?:\s+Automotive\s+)?Group)\b"),
    ("sonic_corporate", 0.86, r"(?i)\b(Sonic\s+Automotive(?:\s+Group)?)\b"),
]
COPYRIGHT = ("copyright", 0.48, r"(?i)(?:©|Copyright|&copy;)\s*(?:[0-9]{4}-[0-9]{4}|[0-9]{4})?\s*\.?\s*([A-Za-z0-9\s,\.&'\-]{1,120}?)(?:\||All rights|$)")
SECOND = [
    ("second_pass_sonic", 0.84, r"(?i)\bsonic\s+automotive(?:\s+group)?\b"), ("second_pass_auto_group", 0.62, r"(?i)\b(?:automotive|auto)\s+group\b"), ("second_pass_collision", 0.64, r"(?i)\bcollision\s+group\b"),
    ("second_pass_family", 0.62, r"(?i)\bfamily\s+of\s+dealerships?\b"), ("second_pass_parent", 0.62, r"(?i)\bparent\s+company\b"), ("second_pass_owned", 0.62, r"(?i)\bowned\s+by\b"),
    ("second_pass_partof", 0.62, r"(?i)\b(?:is\s+)?part\s+of\b"), ("second_pass_member", 0.62, r"(?i)\bmember\s+of\b"),
]
SECOND_WORDS = [" group", "collision", "automotive", "holdings", "company", "family", "owned", "part of", "member of", "sonic", "dealership", "corporation"]
BOOST_WORDS = ["privacy", "about", "terms", "legal", "careers", "company", "collision", "employment", "staff", "sonic"]
#: Words of which every pattern of the first pass needs one.
CUES = "part|member|owned|parent|operated|managed|family|group|sonic|©|copyright|&copy;"
#: A piece in lower case that every match of a signal's pattern has; signals without one aren't listed.
NEEDED = {
    "explicit_is_part_of_the": "part", "member_of_the": "member", "part_of_the": "part", "owned_by": "owned", "parent_company": "parent", "part_of": " of", "family_dealerships": "family",
    "automotive_group": "automotive", "auto_group": "auto", "known_family_group": "group", "sonic_corporate": "sonic", "second_pass_sonic": "sonic", "second_pass_auto_group": "group", "second_pass_collision": "collision",
    "second_pass_family": "family", "second_pass_parent": "parent", "second_pass_owned": "owned", "second_pass_partof": "part", "second_pass_member": "member",
}
#: Names within a window: shaped like an organisation, or beginning with a known family.
SHAPED = r"(?i)\b([A-Z][A-Za-z0-9'\-\.]*(?:\s+[&]\s+[A-Z][A-Za-z0-9'\-\.]*)*(?:\s+[A-Z][A-Za-z0-9'\-\.]*){0,5}\s*(?:Automotive\s+|Auto\s+)?(?:Group|Motors|Holdings|Family|Corporation|Corp\.?|Inc\.?|LLC|LP)\b)"
KNOWN = r"(?i)\b((?:Hendrick|Penske|Lithia|Sonic|Asbury|AutoNation|Tuttle-Click|Tuttle\s+Click|Fletcher\s+Jones|Holman|Morgan)\s+[A-Za-z0-9'\-\s]{0,40}?)"
#: Lookup key (lower case, hyphens as blanks) to the name that is shown.
ALIASES = {
    "tuttle click": "Tuttle-Click Automotive Group", "tuttle click automotive group": "Tuttle-Click Automotive Group", "tuttle click automotive": "Tuttle-Click Automotive Group",
    "tuttle click auto group": "Tuttle-Click Automotive Group", "sonic automotive": "Sonic Automotive", "sonic automotive group": "Sonic Automotive", "sonic": "Sonic Automotive",
}
# End of the fixed values.

ARTICLES = r"(?i)^(?:(?:the|a|an) +)+"
ENDS = r"^[\s\-|:;,.]+|[\s\-|:;,.]+$"


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the phrases: one pattern, so that plans stay small."""
    return text.rlike("|".join(map(re.escape, words)))


def bare(raw: Column) -> Column:
    """Without leading articles."""
    return F.trim(F.regexp_replace(F.trim(raw), ARTICLES, ""))


def normalized(raw: Column) -> Column:
    """Without articles and punctuation at its ends, blanks collapsed, words that page layout glued together parted."""
    text = F.regexp_replace(F.regexp_replace(bare(raw), ENDS, ""), r"\s+", " ")
    for glued, parted in (("groupplaywright", "Group"), ("automotivegroup", "Automotive Group"), ("autogroup", "Auto Group")):
        text = F.regexp_replace(text, f"(?i){glued}", parted)
    return F.trim(text)


def _words(text: Column, pattern: str = "[a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def is_department(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return low.isin(UNITS) | low.rlike(f" (?:{'|'.join(DEPARTMENTS)})$")


def of_known_family(name: Column) -> Column:
    return has_any(F.lower(name), FAMILIES)


def reason(raw: Column) -> Column:
    """ok, or why a text is no organisation's name; the first rule that fits."""
    s = bare(raw)
    low, words = F.lower(s), _words(s)
    entity, family = F.arrays_overlap(words, F.array(*map(F.lit, ENTITY))), of_known_family(s)
    stop = F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.filter(words, lambda w: w.isin(STOPWORDS))) / F.size(words))
    parts = F.regexp_extract_all(s, F.lit("[A-Za-z][a-z]+|[A-Z]{2,}"), F.lit(0))
    capitals = F.size(F.filter(parts, lambda p: p.rlike("^[A-Z]")))
    title = (F.size(parts) >= 2) & (capitals >= F.greatest(F.lit(1), F.floor(F.size(parts) / 2)))
    count = lambda c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    return (
        F.when(s == "", "empty").when(F.length(s) < 4, "too_short").when(F.length(s) > 120, "too_long").when(count(" ") > 14, "too_many_words").when(F.get(F.split(low, " "), F.lit(0)).isin(GENERIC_START), "generic_start")
        .when(has_any(low, NEGATIVE), "negative_phrase").when((stop > 0.42) & ~entity, "too_many_stopwords").when(count(",") >= 2, "comma_clause").when(low.rlike(rf"\b(?:{'|'.join(CLAUSES)})\b"), "subordinate_clause")
        .when(~entity & ~family & ~title, "not_entity_shaped").when(~entity & ~family & (F.size(_words(s, "[a-z0-9]+")) > 8), "long_without_entity_word").otherwise("ok")
    )


def lookup_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.replace(bare(name), F.lit("-"), F.lit(" ")), r"\s+", " ")))


def canonical(name: Column) -> Column:
    """The name that is shown for all spellings of it."""
    key = lookup_key(name)
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    wide = F.when(key.contains("tuttle") & key.contains("click"), "Tuttle-Click Automotive Group").when(key.contains("sonic") & key.contains("automotive"), "Sonic Automotive")
    return F.coalesce(F.try_element_at(known, key), wide, F.trim(name))


def family_key(name: Column) -> Column:
    key = lookup_key(canonical(name))
    return F.when(key.contains("tuttle") & key.contains("click"), "tuttle_click").when(key.contains("sonic"), "sonic").when(key.contains("hendrick"), "hendrick").when(key.contains("penske"), "penske")


def is_distinctive(name: Column) -> Column:
    """A known family, a hyphenated name, or two words that any dealer might not have."""
    tokens = _words(name, "[a-z0-9]+(?:'[a-z]+)?")
    own = F.filter(tokens, lambda t: ~t.isin(GENERIC_TOKENS) & (F.length(t) > 1))
    return of_known_family(name) | name.rlike("[A-Za-z]+-[A-Za-z]+") | ((F.size(tokens) >= 2) & (F.size(own) >= 2))


def specificity(name: Column) -> Column:
    unit, own = is_department(name), is_distinctive(name)
    return F.when(F.trim(name) == "", 0.0).when(unit & ~own, 0.15).when(of_known_family(name), 0.95).when(has_any(F.lower(name), GROUP_WORDS), 0.85).when(own & ~unit, 0.72).when(unit & own, 0.42).otherwise(0.55)


def tier(kind: Column, signal: Column, cross: Column) -> Column:
    """strong, medium or weak evidence."""
    return (
        F.when(cross & (kind.startswith("cross_domain") | kind.contains("legal") | kind.contains("privacy")), "strong")
        .when(signal.contains("part_of") & kind.isin("homepage", "about", "footer"), "strong").when(signal.isin("owned_by", "parent_company", "member_of_the", "sonic_corporate", "known_family_group"), "strong")
        .when((kind == "company") | kind.contains("collision"), "weak").otherwise("medium")
    )


def composite(raw: Column, name: Column, kind: Column, signal: Column, snippet: Column, cross: Column) -> Column:
    """How much a finding says: its score by the name's specificity, its source and what is against units of a store."""
    strong, told = signal.isin(STRONG), has_any(F.lower(snippet), OWNERSHIP)
    level = tier(kind, signal, cross)
    source = F.when(level == "strong", 1.18).when(level == "medium", 1.0).otherwise(0.82)
    source = source * F.when((kind == "company") | kind.contains("collision"), F.when(told | strong, 1.05).otherwise(0.72)).otherwise(1.0)
    source = source * F.when(cross & kind.contains("cross_domain_legal"), 1.06).otherwise(1.0)
    unit = F.when(~is_department(name), 1.0).when(strong, 0.72).when(told & is_distinctive(name), 0.55).otherwise(0.06)
    bounded = F.greatest(F.lit(0.35), F.least(F.lit(1.35), source))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * (F.lit(0.35) + F.lit(0.65) * specificity(name)) * bounded * unit))


def page_weight(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PAGE_WEIGHT.items() for x in pair]), kind), F.lit(OTHER_WEIGHT))


def status(confidence: Column, has_name: Column) -> Column:
    return F.when(confidence >= 0.80, "assigned").when(confidence >= 0.55, "manual_review").when(has_name, "manual_review_low_confidence").otherwise("unknown")
