"""Search texts to filters. Numbers and cues are read by patterns; names meet their vocabulary by deletion neighbourhoods.

Two words are at most one edit apart only if they, or they less one character each, agree. So words and terms are expanded by what is left
without each of their characters and meet in an equi-join; the distance of what meets is then computed. Only distinct words of all texts meet terms. What met, and the vocabulary,
are written: Spark then knows how small they are and doesn't broadcast the words of all texts to them. Joins by the texts' keys are merged, for
their sides grow with the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingspark.operators.runs import staged

# Patterns, cues and words of the texts.
PRICES = [r"\b(?:under|below|less\s+than|max(?:imum)?|at\s+most)\s*(?:\$?\s*)?[0-9,]+(?:\.[0-9]+)?\s*(?:k|thousand)?\b", r"\$\s*[0-9,]+(?:\.[0-9]+)?\s*(?:k|thousand)?\b", r"\b[0-9,]+(?:\.[0-9]+)?\s*k\b(?:\s*miles)?"]
MILES = r"\b(?:under|below|less\s+than|max)\s*([0-9,]+)\s*(k?)\s*miles?\b"
YEAR, NEWER = r"\b((?:19|20)[0-9]{2})\b", r"\b((?:19|20)[0-9]{2})\s*or\s*newer\b"
DRIVETRAINS = [("AWD,4WD", r"\b(?:awd|4wd|4x4|four[\s-]?wheel|all[\s-]?wheel|xdrive|quattro|4matic)\b"), ("FWD", r"\b(?:fwd|front[\s-]?wheel)\b"), ("RWD", r"\b(?:rwd|rear[\s-]?wheel)\b")]
BODIES = [
    ("suv", r"\b(?:suv|crossovers?|cuv|sport\s+utility)\b"), ("sedan", r"\b(?:sedan|saloon)\b"), ("coupe", r"\bcoupe\b"), ("convertible", r"\b(?:convertible|roadster|spyder|cabrio|cabriolet)\b"), ("hatchback", r"\b(?:hatchback|hatch)\b"),
    ("wagon", r"\b(?:wagon|estate|avant)\b"), ("truck", r"\b(?:truck|pickup|pick-up|crew\s+cab)\b"), ("minivan", r"\b(?:minivan|mini\s*van|mpv)\b"), ("van", r"\bvan\b"), ("gran coupe", r"\b(?:gran\s+coupe|4[-\s]?door\s+coupe)\b"),
]
COLORS = "white black silver gray grey red blue green brown beige gold orange yellow tan charcoal pearl metallic midnight sonic oxford rapid polar mythos jet granite carbon frozen mineral bernina atomic".split()
INSIDE = ["interior", "inside", "cabin", "upholstery", "seats", "leather trim"]
# End of the fixed values.

WORDS = r"[^\p{L}\p{N}_#]+"
#: Shorter words and terms must agree; a name of three letters is one edit from too many.
FUZZY_LENGTH = 4


def amounts(text: Column, pattern: str) -> Column:
    """The numbers of all matches, thousands written out; matches that end with miles aren't prices."""
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: ~m.endswith("miles"))
    number = lambda m: F.replace(F.regexp_extract(m, r"([0-9,]+(?:\.[0-9]+)?)[^0-9]*$", 1), F.lit(","), F.lit("")).try_cast("double")
    return F.transform(found, lambda m: number(m) * F.when(m.rlike("(?:k|thousand)$"), 1000).otherwise(1))


def numbers(text: Column) -> dict[str, Column]:
    """Price, mileage and years that a text in lower case asks for."""
    prices = F.array_min(F.concat(*[amounts(text, p) for p in PRICES]))
    miles = F.replace(F.regexp_extract(text, MILES, 1), F.lit(","), F.lit("")).try_cast("double") * F.when(F.regexp_extract(text, MILES, 2) == "k", 1000).otherwise(1)
    years = F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))
    newer = F.regexp_extract(text, NEWER, 1).try_cast("int")
    return {"max_price": F.bround(prices).cast("long"), "max_mileage": miles.cast("long"), "min_year": F.coalesce(newer, F.array_min(years)), "max_year": F.when(newer.isNull(), F.array_max(years))}


def drivetrain(text: Column) -> Column:
    return reduce(lambda c, d: c.when(text.rlike(d[1]), d[0]), DRIVETRAINS[1:], F.when(text.rlike(DRIVETRAINS[0][1]), DRIVETRAINS[0][0]))


def neighbourhood(word: Column) -> Column:
    """The word and what is left of it without each of its characters; the word alone where it is short."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) < FUZZY_LENGTH, F.array(word)).otherwise(F.array_distinct(F.concat(F.array(word), less)))


def within_one_edit(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(word, kind, term, edits) of distinct words and (kind, term) rows: pairs that agree or are one edit apart."""
    a = words.select("word").distinct().select("word", F.explode(neighbourhood(F.col("word"))).alias("v"))
    b = terms.select("kind", "term").distinct().select("kind", "term", F.explode(neighbourhood(F.col("term"))).alias("v"))
    met = a.join(b, "v").select("word", "kind", "term").distinct()
    return met.withColumn("edits", F.levenshtein("word", "term")).where("edits <= 1")


def parsed(texts: DataFrame, pairs: DataFrame, styles: DataFrame, colors: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Filters of each (key, text): numbers, drivetrain, body_style (those of `styles` that are named or hinted at, joined), colours, make and model.

    pairs: (make, model) of the inventory; styles: (style); colors: (place, color) with place `in` or `out`; synonyms: (word, other), slang for makes' words.
    Make and model are the vocabulary's with the fewest edits, then the longest, then the first in the text; a model must be one of the make, and one without
    a make brings the least make that has it. A null text asks for nothing.
    """
    low = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    rows = texts.select("key", low.alias("low")).repartition("key")  # every later step on texts goes by key
    named = styles.select(F.trim("style").alias("style")).where("style <> ''").distinct().agg(F.array_sort(F.collect_set("style")).alias("styles"))  # a facet's values
    padded = F.concat(F.lit(" "), F.regexp_replace("low", WORDS, " "), F.lit(" "))
    cues = F.array_compact(F.array(*[F.when(F.col("low").rlike(p), s) for s, p in BODIES]))
    styled = rows.join(F.broadcast(named), F.lit(True)).select(
        "key", "low", F.array_join(F.filter(F.coalesce("styles", F.array().cast("array<string>")), lambda s: F.contains(padded, F.concat(F.lit(" "), F.lower(s), F.lit(" "))) | F.array_contains(cues, F.lower(s))), ",").alias("body_style"),
    )
    out = styled.select("key", *[c.alias(n) for n, c in numbers(F.col("low")).items()], drivetrain(F.col("low")).alias("drivetrain"), F.nullif("body_style", F.lit("")).alias("body_style"), F.col("low").rlike("|".join(INSIDE)).alias("inside"))

    # words in order; slang becomes its makes' word
    words = rows.select("key", F.posexplode(F.split("low", WORDS)).alias("at", "word")).where("word <> ''")
    hints = words.where(F.col("word").isin(COLORS) | (F.length("word") >= 4))
    rest = reduce(lambda t, p: F.regexp_replace(t, p, " "), [*PRICES, MILES, NEWER, YEAR, *(p for _, p in DRIVETRAINS), *(p for _, p in BODIES)], F.col("low"))
    names = rows.select("key", F.posexplode(F.filter(F.split(rest, WORDS), lambda w: (w != "") & ~w.isin(COLORS))).alias("at", "word"))
    names = names.join(synonyms.withColumnRenamed("word", "slang"), F.col("word") == F.col("slang"), "left").select("key", "at", F.coalesce("other", "word").alias("word"))
    after = F.lead("word").over(Window.partitionBy("key").orderBy("at"))
    plain = ~F.col("word").rlike("^[0-9]+$")
    grams = names.withColumn("next", after).select("key", "at", F.explode(F.array_compact(F.array(F.when(plain & (F.length("word") >= 2), F.col("word")), F.when(plain & ~F.col("next").rlike("^[0-9]+$"), F.concat_ws(" ", "word", "next"))))).alias("word"))

    lower = pairs.select("make", "model", F.lower(F.trim("make")).alias("l_make"), F.lower(F.trim("model")).alias("l_model")).distinct()
    lower = staged(lower, "vocabulary")
    terms = lower.select(F.lit("make").alias("kind"), F.col("l_make").alias("term")).unionByName(lower.select(F.lit("model").alias("kind"), F.col("l_model").alias("term"))).where("term <> ''")
    terms = terms.unionByName(colors.select(F.col("place").alias("kind"), F.lower("color").alias("term")))
    every = grams.select("word").unionByName(hints.select("word"))
    alike = staged(within_one_edit(every, terms), "alike")
    place = F.struct("edits", -F.length("term"), "at", "term")
    hits = grams.join(alike.where("kind IN ('make', 'model')"), "word").groupBy("key", "kind", "term").agg(F.min(place).alias("rank"))
    make = hits.where("kind = 'make'").groupBy("key").agg(F.min_by("term", "rank").alias("l_make"))
    made = make.join(lower.groupBy("l_make").agg(F.min("make").alias("make")), "l_make")
    models = hits.where("kind = 'model'").select("key", F.col("term").alias("l_model"), "rank")
    own = models.join(made.hint("merge"), "key", "left").join(lower.select(F.col("l_model"), F.col("l_make").alias("of_make"), F.col("make").alias("pair_make"), "model"), "l_model")
    own = own.where(F.col("l_make").isNull() | (F.col("l_make") == F.col("of_make"))).groupBy("key").agg(F.min_by(F.struct("model", F.col("pair_make").alias("make")), F.struct("rank", "pair_make")).alias("m"))
    tint = hints.join(alike.where("kind IN ('in', 'out')"), "word").groupBy("key").agg(*[F.min_by(F.when(F.col("kind") == k, F.col("term")), F.when(F.col("kind") == k, F.struct("at", "edits", "term"))).alias(k) for k in ("in", "out")])
    for found in (made.select("key", "make"), own, tint):
        out = out.join(found.hint("merge"), "key", "left")
    return out.select(
        "key", "max_price", "max_mileage", "min_year", "max_year", "drivetrain", "body_style", F.when(F.col("inside"), F.col("in")).alias("interior_color"), F.col("out").alias("exterior_color"),
        F.coalesce("make", "m.make").alias("make"), F.col("m.model").alias("model"),
    )
