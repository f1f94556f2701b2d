"""The condition of a vehicle whose row has none: an ordered table of rules over title, URL, CPO flag, mileage and year, and one fold over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CPO = "Certified Pre-Owned"
# Fixed values: (condition, brand, where, pattern, what else must hold), in the order in which they are tried; brand `bmw`, `other` or any.
# A rule without a pattern asks for its last part only.
HINTS = [("title", r"\bcpo\b"), ("title", "certified pre-owned|certified preowned|mazda certified"), ("title", "(?:^| )certified .*pre-owned|pre-owned.* certified(?: |$)"), ("title", "^certified "), ("url", "/certified|cpo-inventory|-cpo-|certified_inventory|certified-inventory")]
RULES = [
    (CPO, "bmw", "", "", "cpo"), (CPO, "bmw", "title", "bmw certified|bmw cpo|certified pre-owned|certified preowned", ""), (CPO, "bmw", "url", "certified-inventory|certified_inventory|/certified/|/cpo/|certifiedused|bmw-certified|-cpo-|cpo-inventory|certified.*inventory|inventory.*certified", ""),
    ("Used", "bmw", "title", "^used ", ""), ("New", "bmw", "title", "^new ", ""),
    (CPO, "other", "title", r"certified pre-owned|certified preowned|mazda certified|\bcpo\b", ""), ("Certified", "other", "title", "(?:^| )certified(?: |$)", ""), ("Used", "other", "title", "^used ", ""), ("New", "other", "title", "^new ", ""),
    (CPO, "", "", "", "cpo"), *((CPO, "", where, pattern, "") for where, pattern in HINTS),
    ("Used", "", "", "", "driven"), ("New", "", "url", "/new-inventory|/new/|new[-_]*inventory", "undriven"), ("New", "", "title", "^new ", "undriven"),
    ("Pre-Owned", "", "", "", "old"), ("Used", "", "url", "used-inventory|used_inventory|pre-owned|preowned|/used/", "recent"), ("New", "", "url", "new[-_]*inventory|/new/", "recent"),
]
FIRST_RECENT = 2024
# End of the fixed values.


def inferred(make: Column, title: Column, url: Column, cpo: Column, mileage: Column, year: Column) -> Column:
    """The condition that the first fitting rule tells, or null."""
    texts = {"title": F.lower(F.trim(F.coalesce(title, F.lit("")))), "url": F.lower(F.coalesce(url, F.lit("")))}
    bmw = F.upper(F.trim(F.coalesce(make, F.lit("")))) == "BMW"
    held = {"cpo": cpo, "driven": mileage > 0, "undriven": mileage == 0, "old": year < FIRST_RECENT, "recent": year >= FIRST_RECENT}
    out = None
    for value, brand, where, pattern, needs in RULES:
        asked = F.lit(True)
        if brand:
            asked = bmw if brand == "bmw" else ~bmw
        if pattern:
            asked = asked & texts[where].rlike(pattern)
        if needs:
            asked = asked & F.coalesce(held[needs], F.lit(False))
        out = F.when(asked, value) if out is None else out.when(asked, value)
    return out
