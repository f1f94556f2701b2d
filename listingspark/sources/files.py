"""Readers and writers of feed files: CSV under aliases or a manifest, JSON bundles and payloads, exports, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.streaming.jobs import scratch


def csv_by_alias(spark: SparkSession, path: str, aliases: dict[str, tuple[list[str], str]], required: list[str]) -> DataFrame:
    """Columns by the first alias that the file has, in any case and without a byte order mark, cast to their types; rows without the required ones go.

    aliases: name -> (header aliases, type). All values are read as text, so one bad value doesn't fail the load.
    """
    raw = spark.read.option("header", True).csv(path)
    have = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    out = []
    for name, (others, kind) in aliases.items():
        found = next((have[a.lower()] for a in (name, *others) if a.lower() in have), None)
        out.append((F.trim(F.col(f"`{found}`")).try_cast(kind) if found else F.lit(None).cast(kind)).alias(name))
    rows = raw.select(*out)
    for name in required:
        rows = rows.where(F.col(name).isNotNull())
    return rows


def csv_by_manifest(spark: SparkSession, path: str, columns: dict[str, str], year: str, span: tuple[int, int], source: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a reason) of a CSV under a manifest: logical names of headers, the years it covers, its source unless a row has one."""
    raw = spark.read.option("header", True).csv(path)
    rows = raw.select(*[F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")).alias(n) for n, h in columns.items()])
    rows = rows.withColumn(year, F.col(year).try_cast("int"))
    rows = rows.withColumn("source", F.coalesce("source", F.lit(source)) if "source" in columns else F.lit(source))
    reason = F.when(F.col(year).isNull(), "no_year").when(~F.col(year).between(*span), "year_outside_manifest")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def json_bundles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


#: Keys of an object under which its VIN may be.
VIN_AT = ["$.vin", "$.VIN", "$.vehicle.vin"]
#: How many levels a payload is walked in its row before it is looked at again.
LEVELS = 4


def walked_lists(payloads: DataFrame, payload: str) -> DataFrame:
    """`payloads` (JSON text) ready for walk(): `best` is the payload's best list so far, `pending` what is still to be searched, `told` a bound of its VINs.

    told: how often a VIN's key is written. Keys in escapes (\\u) don't show, so such a payload has no bound.
    """
    often = lambda word: ((F.octet_length(payload) - F.octet_length(F.replace(F.col(payload), F.lit(word), F.lit("")))) / len(word)).cast("int")
    whole = F.array(F.struct(F.lit("$").alias("path"), F.try_parse_json(payload).alias("v")))
    none = F.lit(None).cast("struct<rank:struct<with_vin:int,n:int,path:string>,items:array<variant>>")
    return payloads.withColumns({"told": F.when(F.contains(payload, F.lit("\\u")), F.lit(1 << 30)).otherwise(often('"vin"') + often('"VIN"')), "best": none, "pending": whole})


def walk(rows: DataFrame, least: int = 3, levels: int = LEVELS) -> DataFrame:
    """Rows of walked_lists() after some more levels; a row without `pending` is done: its `best` is the list with the most objects that have a VIN (at least `least`; ties: the longest, then the path).

    Every VIN stands for one item of one list at most. So once a list has more than half of those told, none that is left can come before it, and its items aren't searched.
    """
    get = F.try_variant_get
    has_vin = lambda e: F.coalesce(*[get(e, p, "string") for p in VIN_AT]).isNotNull()
    entry = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    for _ in range(levels):
        rows = rows.withColumn("_open", F.transform("pending", lambda p: F.struct(p["path"].alias("path"), p["v"].alias("v"), get(p["v"], "$", "array<variant>").alias("items"))))
        ranked = F.transform(F.filter("_open", lambda o: o["items"].isNotNull()), lambda o: F.struct(F.struct((-F.size(F.filter(o["items"], has_vin))).alias("with_vin"), (-F.size(o["items"])).alias("n"), o["path"].alias("path")).alias("rank"), o["items"].alias("items")))
        rows = rows.withColumn("_lists", F.filter(ranked, lambda x: x["rank"]["with_vin"] <= -least))
        rows = rows.withColumn("_first", F.array_min(F.transform(F.concat("_lists", F.array_compact(F.array("best"))), lambda x: x["rank"])))
        # least ranks come first; the earlier best holds if it has it
        rows = rows.withColumn("best", F.when(F.col("_first") == F.col("best.rank"), F.col("best")).otherwise(F.get(F.filter("_lists", lambda x: x["rank"] == F.col("_first")), F.lit(0))))
        items = lambda o: F.transform(o["items"], lambda v, i: entry(F.concat(o["path"], F.lit("["), i.cast("string"), F.lit("]")), v))
        fields = lambda o: F.transform(F.map_entries(get(o["v"], "$", "map<string,variant>")), lambda e: entry(F.concat(o["path"], F.lit("."), e["key"]), e["value"]))
        below = F.flatten(F.filter(F.transform("_open", lambda o: F.when(o["items"].isNotNull(), items(o)).otherwise(fields(o))), lambda x: x.isNotNull()))
        settled = F.coalesce(F.col("best.rank.with_vin") * -2 > F.col("told"), F.lit(False))
        rows = rows.withColumn("pending", F.when(~settled, below).otherwise(F.slice("pending", 1, 0))).drop("_open", "_lists", "_first")
    return rows


def all_walked(rows: DataFrame, least: int = 3) -> DataFrame:
    """Rows of walked_lists() walked to the end, in rounds of some levels; each round is written to a scratch folder, and the next reads those that aren't done."""
    spark, done = rows.sparkSession, None
    while True:
        rows, folder = walk(rows, least), scratch(rows.sparkSession, "levels")
        rows.write.parquet(folder)
        rows = spark.read.schema(rows.schema).parquet(folder)
        ended = rows.where("size(pending) = 0")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.where("size(pending) > 0")
        if rows.isEmpty():
            return done


def largest_vehicle_lists(payloads: DataFrame, key: str, payload: str, least: int = 3) -> DataFrame:
    """(key, path, at, vehicle, vin): the items of each payload's array with the most objects that have a VIN, see walk(). payload: JSON text; those without a key give nothing."""
    rows = all_walked(walked_lists(payloads.where(F.col(key).isNotNull()).select(key, payload), payload).drop(payload), least)
    items = rows.select(key, F.col("best.rank.path").alias("path"), F.posexplode("best.items").alias("at", "v")).withColumn("vehicle", F.to_json("v"))
    return items.select(key, "path", "at", "vehicle", F.coalesce(*[F.get_json_object("vehicle", p) for p in VIN_AT]).alias("vin"))


#: Where each provider's payload keeps a listing's columns; new providers are further entries.
PROVIDERS: dict[str, dict[str, list[str]]] = {
    "alpha": {"vin": ["$.vin"], "year": ["$.year"], "make": ["$.make"], "price": ["$.pricing.internet", "$.pricing.msrp"]},
    "beta": {"vin": ["$.VIN"], "year": ["$.ModelYear"], "make": ["$.Make.Name"], "price": ["$.Prices[0].Amount"]},
}


def with_provider(name: str, paths: dict[str, list[str]]) -> dict[str, dict[str, list[str]]]:
    """The known providers and one more; a known name or a missing column is an error."""
    wanted = set(next(iter(PROVIDERS.values())))
    if name in PROVIDERS or set(paths) != wanted:
        raise ValueError(f"{name} must be a new provider with {sorted(wanted)}")
    return PROVIDERS | {name: paths}


def mapped(payloads: DataFrame, provider: str, payload: str, keep: list[str], providers: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """Listing columns of the rows of each known provider; rows of unknown ones give nothing."""
    parts = []
    for name, paths in (providers or PROVIDERS).items():
        columns = [F.coalesce(*[F.get_json_object(payload, p) for p in ps]).alias(c) for c, ps in paths.items()]
        parts.append(payloads.where(F.col(provider) == name).select(*keep, provider, *columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"year": F.col("year").try_cast("int"), "price": F.col("price").try_cast("double")})
