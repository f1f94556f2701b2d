"""What a vehicle's name says of its mechanics: an ordered table of rules and one fold over it.

A rule asks for a brand, for one or two patterns in some text of the name, for none of another, and may need what the motor rules found. Of each
group the first rule that fits gives the value. The table is data: a query and its twin in SQL both run it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    group: str
    value: str
    brand: str = ""
    on: str = "name"  # name: title, trim and model; model; words: trim and title
    pattern: str = ""
    also_on: str = "name"
    also: str = ""
    unless_on: str = "name"
    unless: str = ""
    needs: str = ""  # electric, burning (anything but electric) or cylinders


# Brands, patterns and what they stand for, in the order in which they are tried.
BMW, MAZDA, MERCEDES, FORD = "BMW|^MINI$", "^MAZDA$", "MERCEDES", "^FORD$"
THIRTY = r"\d30I\b|(?:XDRIVE|SDRIVE)30I\b|\b30\s+(?:XDRIVE|SDRIVE)\b"
FORTY = r"\d40I\b|\D40I\b|\bM50\s+(?:XDRIVE|SDRIVE)\b|\b40\s+(?:XDRIVE|SDRIVE)\b"
LARGE = r"^X[3-7]\b|\bX5\b|\bX7\b|\b5\s+SERIES\b|\b7\s+SERIES\b|^[57]$"
COMPACT = r"^MAZDA\s*3\b|^3$"
SPEEDS = r"\b(\d{1,2})\s*[-]?\s*(?:SPEED|SPD)\b"
RULES = [
    Rule("motor", "0|Electric", BMW, pattern=r"\b(I4|I5|I7|IX)\b|\bI\s*PERFORMANCE\b|\bELECTRIC\b"),
    Rule("motor", "8|", BMW, pattern=r"\b(M50I|M60I)\b"),
    Rule("motor", "8|", BMW, pattern=r"\d60I\b"),
    Rule("motor", "8|", BMW, pattern=r"\d50I\b"),
    Rule("motor", "6|Gas / Mild Hybrid", BMW, "model", LARGE, also=rf"{FORTY}|\bM40I\b"),
    Rule("motor", "4|Plug-In Hybrid", BMW, pattern=r"\b(230E|330E|430E|530E|630E)\b"),
    Rule("motor", "4|", BMW, pattern=rf"{THIRTY}|\b(230I|330I|430I|530I|630I|730I)\b"),
    Rule("motor", "6|Gas / Mild Hybrid", BMW, pattern=rf"{FORTY}|\bM40I\b"),
    Rule("motor", "8|", MERCEDES, pattern=r"\b(580|600|63\s|AMG\s*63)\b"),
    Rule("motor", "6|", MERCEDES, pattern=r"\b450\b"),
    Rule("motor", "4|", MERCEDES, pattern=r"\b300\b|\b350\b"),
    Rule("drivetrain", "AWD", MAZDA, pattern=r"\b(AWD|I-ACTIV\s*AWD)\b"),
    Rule("drivetrain", "FWD", MAZDA, pattern=r"\bFWD\b"),
    Rule("drivetrain", "AWD", pattern=r"\b(XDRIVE|4MATIC)\b|(?:XDRIVE|4MATIC)\d"),
    Rule("drivetrain", "AWD", pattern=r"\bQUATTRO\b"),
    Rule("drivetrain", "AWD", pattern=r"\bALL[\s-]?WHEEL\b"),
    Rule("drivetrain", "AWD", pattern=r"\b(AWD|4WD|4X4|SH-AWD|INTELLIGENT AWD)\b"),
    Rule("drivetrain", "RWD", on="words", pattern=r"\bSDRIVE\d"),
    Rule("drivetrain", "RWD", pattern=r"\bSDRIVE(?:30|40|50)I\b"),
    Rule("drivetrain", "AWD", BMW, pattern=r"\bM50\b|\bM60\b", needs="electric"),
    Rule("drivetrain", "RWD", BMW, pattern=r"\bEDRIVE\d|\bEDRIVE\b", needs="electric"),
    Rule("drivetrain", "RWD", BMW, pattern=rf"\b(230I|330I|430I|530I|630I|730I|230E|330E|430E|530E|630E|M240I|M340I|M440I|540I|640I|740I|840I)\b|{THIRTY}|{FORTY}", unless_on="model", unless="^I?X", needs="burning"),
    Rule("drivetrain", "RWD", BMW, "model", r"^M\d{3}[EI]\b", needs="burning"),
    Rule("body", "Gran Coupe", BMW, pattern=r"\bI4\b", needs="electric"),
    Rule("body", "Sedan", BMW, pattern=r"\b(I7|I5)\b", needs="electric"),
    Rule("body", "SUV", BMW, pattern=r"\bIX\b", needs="electric"),
    Rule("body", "SUV", BMW, "model", r"^X\d", needs="burning"),
    Rule("body", "Roadster", BMW, "model", r"^Z\d", needs="burning"),
    Rule("body", "Gran Coupe", BMW, "model", ".", also="GRAN *COUPE", needs="burning"),
    Rule("body", "Sedan", BMW, "model", r"^M\d{3}I\b", needs="burning"),
    Rule("body", "Coupe", BMW, "model", r"^M[234]\b", unless="GRAN", needs="burning"),
    Rule("body", "Coupe", BMW, "model", r"^[24]\d{2}", needs="burning"),
    Rule("body", "Sedan", BMW, "model", r"^[3567]\d{2}[EI]", needs="burning"),
    Rule("body", "SUV", MAZDA, "model", r"^CX-\d"),
    Rule("body", "Hatchback", MAZDA, "model", COMPACT, also="HATCH"),
    Rule("body", "Sedan", MAZDA, "model", COMPACT),
    Rule("body", "Convertible", MAZDA, "model", r"^MX-\d"),
    Rule("body", "Truck", FORD, "model", r"\bF[-\s]?(150|250|350|450|550|650)\b|^F[-\s]?(150|250|350)|\bRANGER\b"),
    Rule("body", "SUV", FORD, "model", r"\b(EXPLORER|ESCAPE|EDGE|BRONCO|EXPEDITION|EXCURSION)\b"),
    Rule("shift", "8-Speed Automatic", BMW, needs="cylinders"),
    Rule("shift", "Manual", MAZDA, pattern=r"\b(MANUAL|6MT|6-SPEED\s*MANUAL)\b"),
    Rule("shift", "Automatic", MAZDA),
    Rule("shift", "10-Speed Automatic", pattern=r"\bTEN[\s-]*SPEED\s+AUTOMATIC\b"),
    Rule("shift", "{gears}-Speed Automatic", pattern=r"\b(AUTOMATIC|AUTO\.?\s*TRANS)\b", also=SPEEDS),
    Rule("shift", "CVT", pattern=r"\bCVT\b"),
]
# End of the fixed values.


def decoded(make: Column, model: Column, trim: Column, title: Column) -> Column:
    """Struct of cylinders, gears, drivetrain, fuel_hint, body_hint and transmission_hint."""
    text = lambda *cs: F.upper(F.concat_ws(" ", *[F.coalesce(F.trim(c), F.lit("")) for c in cs]))
    texts = {"name": text(title, trim, model), "model": text(model), "words": text(trim, title)}
    brand = text(make)

    def first(group: str, needs: dict[str, Column]) -> Column:
        out = None
        for r in (r for r in RULES if r.group == group):
            asked = [brand.rlike(r.brand)] if r.brand else []
            asked += [texts[on].rlike(p) for on, p in ((r.on, r.pattern), (r.also_on, r.also)) if p]
            asked += [~texts[r.unless_on].rlike(r.unless)] if r.unless else []
            asked += [needs[r.needs]] if r.needs else []
            fits = asked[0]
            for a in asked[1:]:
                fits = fits & a
            out = F.when(fits, r.value) if out is None else out.when(fits, r.value)
        return out

    motor = first("motor", {})
    cylinders = F.split_part(motor, F.lit("|"), F.lit(1)).try_cast("int")
    needs = {"electric": F.coalesce(cylinders == 0, F.lit(False)), "burning": ~F.coalesce(cylinders == 0, F.lit(False)), "cylinders": F.coalesce(cylinders > 0, F.lit(False))}
    told = F.nullif(F.regexp_extract(texts["name"], SPEEDS, 1), F.lit("")).cast("int")
    shift = F.replace(first("shift", needs), F.lit("{gears}"), F.coalesce(told.cast("string"), F.lit("")))
    gears = F.coalesce(told, F.when(shift == "10-Speed Automatic", 10))
    return F.struct(
        cylinders.alias("cylinders"), gears.alias("gears"), first("drivetrain", needs).alias("drivetrain"), F.nullif(F.split_part(motor, F.lit("|"), F.lit(2)), F.lit("")).alias("fuel_hint"), first("body", needs).alias("body_hint"), shift.alias("transmission_hint"),
    )
