"""Structured Streaming jobs. Sources are folders of files; each job runs what is there (availableNow) and keeps its place in a checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that spark.checkpoint.dir names, or under the warehouse where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streams"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, time: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files, with its time column as a zoned timestamp, which watermarks need."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn(time, F.col(time).cast("timestamp")) if time else rows


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there into Parquet files and reads these."""
    spark = df.sparkSession
    out = scratch(spark, name)
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/place")
    writer.format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of a folder's whole versions, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    named = [str(x.getPath().getName()) for x in files.listStatus(path)]
    whole = [n for n in named if n.startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in whole)


def run_by_batch(df: DataFrame, name: str, step: Callable[[DataFrame, DataFrame | None], DataFrame], folder: str | None = None) -> DataFrame:
    """Folds micro-batches into versions of a table: step(batch, previous version) gives the next.

    Batch N writes version N from the greatest whole version below N, found in the folder by name. So a batch that is repeated, also by
    a new process that goes on from the folder's checkpoint, writes the same version again from the same one before it.
    """
    spark = df.sparkSession
    out = folder or scratch(spark, name)

    def fold(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        before = [v for v in versions(own, out) if v < number]
        stored = own.read.parquet(f"{out}/version={before[-1]}") if before else None
        step(batch, stored).write.mode("overwrite").parquet(f"{out}/version={number}")

    df.writeStream.foreachBatch(fold).trigger(availableNow=True).option("checkpointLocation", f"{out}/place").start().awaitTermination()
    return spark.read.parquet(f"{out}/version={versions(spark, out)[-1]}")


def deduped(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Drops repeats of a key that come within `late` of each other's time."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def in_order(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """A key's rows of this micro-batch over all its Arrow frames, in order. The batch's size, which the source sets, bounds them."""
    return pd.concat([f[columns] for f in frames]).sort_values(columns).itertuples(index=False)


def price_changes(df: DataFrame, key: str, time: str, price: str) -> DataFrame:
    """(key, at, old, new) of each change of a key's price; rows older than the state are ignored."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last = state.get if state.exists else (None, None)
        out = []
        for t, p in in_order(frames, [time, price]):
            moment = int(t.value)
            if at is not None and moment < at:
                continue
            if at is None or p != last:
                out.append((k[0], t, last, p))
            at, last = moment, float(p)
        state.update((at, last))
        yield pd.DataFrame(out, columns=["key", "at", "old", "new"])

    rows = df.select(F.col(key).cast("long").alias(key), time, F.col(price).cast("double").alias(price))
    return rows.groupBy(key).applyInPandasWithState(step, "key long, at timestamp, old double, new double", "at long, price double", "append", GroupStateTimeout.NoTimeout)


def allowed_events(df: DataFrame, key: str, time: str, event: str, most: int, seconds: int) -> DataFrame:
    """(key, event, allowed): an event passes while fewer than `most` passed in the `seconds` before it. What was refused doesn't count."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = list(state.get[0]) if state.exists else []
        out = []
        for t, e in in_order(frames, [time, event]):
            moment = int(t.value)
            passed = [p for p in passed if p > moment - seconds * 1_000_000_000]
            ok = len(passed) < most
            if ok:
                passed.append(moment)
            out.append((k[0], e, ok))
        state.update((passed,))
        yield pd.DataFrame(out, columns=["key", "event", "allowed"])

    rows = df.select(F.col(key).cast("long").alias(key), time, F.col(event).cast("long").alias(event))
    return rows.groupBy(key).applyInPandasWithState(step, "key long, event long, allowed boolean", "passed array<long>", "append", GroupStateTimeout.NoTimeout)


def window_counts(df: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Counts of tumbling windows, emitted when a window can't change any more."""
    counts = df.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), *by, "n")
