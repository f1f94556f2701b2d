"""Captured payload files into a snapshot of listings: lists of vehicles are found in each payload, mapped by its dialect and merged by policy, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.operators import merge as M
from listingspark.operators.runs import staged
from listingspark.sources import files as S
from listingspark.sources import mapping as T
from listingspark.streaming.jobs import run_by_batch

PAYLOADS = "k string, provider string, payload string"
#: How a field of a known listing changes when it is seen again.
POLICIES = {"price": "overwrite", "mileage": "overwrite", "trim": "keep_if_blank", "transmission": "keep_if_blank", "fuel_type": "keep_if_null", "stock_number": "keep_if_blank", "first_batch": "sticky", "last_batch": "overwrite"}
FIELDS = [c for c in POLICIES if not c.endswith("_batch")]


def vehicles(payloads: DataFrame) -> DataFrame:
    """(vin, the dialects' other fields): the last of each VIN among the vehicles of all payloads (k, provider, payload), by k and place.

    Payloads are read, searched and mapped in their rows, in one pass, which writes what was found; only those whose lists lie deeper than that pass looks are read again.
    """
    payloads = payloads.where("k IS NOT NULL")

    def mapped(lists: DataFrame) -> DataFrame:
        cars = lists.select("k", "provider", (F.size("pending") > 0).alias("deep"), F.posexplode_outer("best.items").alias("at", "vehicle"))
        return T.mapped_rows(cars, "provider", "vehicle", fields=["vin", *FIELDS]).drop("provider")

    ready = lambda df: S.walked_lists(df, "payload").drop("payload")
    rows = staged(mapped(S.walk(ready(payloads))), "vehicles")
    deep = rows.where("deep").select("k").distinct()
    if not deep.isEmpty():
        again = staged(mapped(S.all_walked(ready(payloads.join(deep, "k", "left_semi")))), "vehicles")
        rows = rows.join(deep, "k", "left_anti").unionByName(again)
    return M.last_wins(rows.where("vin IS NOT NULL"), "vin", ["k", "at"]).drop("k", "at", "deep")


def ingested(spark: SparkSession, source: str, folder: str, number: int) -> DataFrame:
    """Takes the payload files of `source` that the folder's checkpoint hasn't seen into the folder's next version, and returns it. `number` tells the run."""
    stream = spark.readStream.schema(PAYLOADS).json(source)

    def step(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        new = vehicles(batch).withColumns({"first_batch": F.lit(number), "last_batch": F.lit(number)}).select("vin", *POLICIES)
        if before is None:
            return new.withColumn("action", F.lit("inserted"))
        return M.snapshot_upsert(before.drop("action"), new, "vin", POLICIES)

    return run_by_batch(stream, "ingest", step, folder)
