"""Valuation figures from JSON of any shape: measures are known by their keys, wherever in the payload they stand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingspark.operators.runs import staged

# Measures, how several figures of one make one, and the parts of a key that tell it (all of a set; blanks and underscores aside).
MEASURES = [
    ("fair_purchase", "max", ["fairpurchase"]), ("fair_purchase", "max", ["typicallisting", "used"]), ("range_low", "min", ["fairmarket", "low"]), ("range_low", "min", ["fairmarket", "min"]), ("range_high", "max", ["fairmarket", "high"]),
    ("range_high", "max", ["fairmarket", "max"]), ("private_party", "max", ["privateparty"]), ("trade_in", "max", ["tradein"]), ("trade_in", "max", ["trade-in"]),
]
PLAUSIBLE = (500, 1_500_000)
# End of the fixed values.


def keyed_values(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(k, name, v): every member of every object of each payload, at any depth, as a variant. Levels are walked until one has no entries; each is written once."""
    spark = payloads.sparkSession
    level = payloads.select(F.col(key).alias("k"), F.try_parse_json(payload).alias("v"))
    found = []
    while True:
        level = staged(spark.sql("SELECT k, e.key AS name, e.value AS v FROM {level}, LATERAL variant_explode(v) AS e", level=level), "values")
        if level.isEmpty():
            break
        found.append(level)
        level = level.select("k", "v")
    return reduce(DataFrame.unionByName, found, level.select("k", F.lit(None).cast("string").alias("name"), "v")).where("name IS NOT NULL")


def valuations(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, a column for each measure): the greatest plausible figure of a measure, of the low end of a range the least; a range that stands the wrong way round is turned. Every key has a row."""
    rows = keyed_values(payloads, key, payload)
    name, text = F.lower(F.regexp_replace("name", "[ _]", "")), F.expr("try_variant_get(v, '$', 'string')")
    written = F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")
    kind = F.expr("schema_of_variant(v)")
    number = F.when(kind == "STRING", written).when(kind.isin("BOOLEAN", "VOID"), None).otherwise(F.expr("try_variant_get(v, '$', 'double')"))
    rows = rows.select("k", name.alias("name"), number.alias("n")).where(F.col("n").between(*PLAUSIBLE))
    tells = lambda parts: reduce(lambda a, b: a & b, [F.contains("name", F.lit(p)) for p in parts])
    measures = dict.fromkeys(m for m, _, _ in MEASURES)
    figures = []
    for m in measures:
        fits = reduce(lambda a, b: a | b, [tells(parts) for n, _, parts in MEASURES if n == m])
        fold = F.min if any(how == "min" for n, how, _ in MEASURES if n == m) else F.max
        figures.append(fold(F.when(fits, F.col("n"))).alias(m))
    found = rows.groupBy("k").agg(*figures)
    low, high = F.col("range_low"), F.col("range_high")
    turned = {"range_low": F.when(low.isNotNull() & high.isNotNull(), F.least(low, high)).otherwise(low), "range_high": F.when(low.isNotNull() & high.isNotNull(), F.greatest(low, high)).otherwise(high)}
    every = payloads.select(F.col(key).alias("_key"))
    return every.join(found, F.col("_key").eqNullSafe(F.col("k")), "left").select(F.col("_key").alias(key), *[turned.get(m, F.col(m)).alias(m) for m in measures])
