"""Operator 5, document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k least distinct 64-bit hashes of a text's word shingles (five words, A-Z in lower case; a shorter text is one
shingle, one without words has none), ascending. Sketches of parts merge to that of the whole. Two sketches estimate
resemblance, containment and distinct shingle count; while both hold all their shingles the figures are exact.

Null and empty texts have empty sketches; two empty sketches have resemblance 1. Equal texts have equal sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listingspark.llm.arrays import in_small_batches, pieces, shingle_sets

WORDS, K = 5, 256
FIRST = -(1 << 63)


def sketches(texts: pa.Array, k: int = K, words: int = WORDS) -> list[np.ndarray]:
    return [s[:k] for _, _, data, offsets in pieces(texts) for s in shingle_sets(data, offsets, words)]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both inputs together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Shared over all distinct shingles, estimated from the k least of both together."""
    if not len(a) and not len(b):
        return 1.0
    both = merged(a, b, k)
    if len(a) == k or len(b) == k:  # what lies above a full sketch's last hash isn't known of it
        both = both[both <= min(x[-1] for x in (a, b) if len(x) == k)]
    return len(np.intersect1d(np.intersect1d(a, b, True), both, True)) / len(both)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / distinct_count(a, k))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """(key, sketch): the sketch of each text as a binary column of little-endian unsigned 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype("<u8").tobytes() for s in sketches(batch.column(1), k, words)], pa.binary())], names=[key, "sketch"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, sketch binary")


def merge_sketches(df: DataFrame, by: str, sketch: str = "sketch", k: int = K, parts: int = 64) -> DataFrame:
    """(by, sketch): one sketch for each value of `by`, merged in two steps so that a hot value is spread over `parts` tasks first.

    Hashes meet as numbers, so that each step keeps at most k of them for each group: aggregation needs no Python.
    """
    hashes = df.select(by, F.explode(F.transform(F.sequence(F.lit(0), (F.length(sketch) / 8 - 1).cast("int")), lambda i: F.substring(F.col(sketch), i * 8 + 1, F.lit(8)))).alias("h")).where(F.length("h") == 8)
    reverse = F.reverse(F.hex("h"))  # little-endian bytes; as hex text, pairs of digits are turned back below
    order = F.regexp_replace(reverse, "(.)(.)", "$2$1")
    hashes = hashes.select(by, order.alias("o")).distinct().withColumn("part", F.pmod(F.xxhash64("o"), F.lit(parts)))
    for keys in ([by, "part"], [by]):  # by sorting, which spills: no buffer holds a group's hashes
        least = F.row_number().over(Window.partitionBy(*keys).orderBy("o"))
        hashes = hashes.withColumn("least", least).where(F.col("least") <= k)
    packed = hashes.groupBy(by).agg(F.sort_array(F.collect_list("o")).alias("os"))
    turned = F.transform("os", lambda o: F.regexp_replace(F.reverse(o), "(.)(.)", "$2$1"))
    return packed.select(by, F.unhex(F.array_join(turned, "")).alias("sketch"))


def _ordered(key: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """(key, sig) as strings of 16 bytes in the same order."""
    out = np.empty((len(key), 2), ">u8")
    out[:, 0], out[:, 1] = (x.view(np.uint64) ^ np.uint64(1 << 63) for x in (key, sig))
    return out.view("S16").ravel()


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = 24 << 20) -> DataFrame:
    """(bucket, ahead, id, text): each partition is one bucket in order of descending key, then text hash; its row with `ahead` is a copy of the next bucket's first, after the last bucket's rows that of the first bucket.

    Texts move once. Buckets are ranges of (key, text hash), so that rows without a key, or with a shared one, spread too; only equal
    rows stay together. Spark's range partitioning of these pairs finds the bounds; the driver sees one pair for each bucket
    (16 bytes for each `bucket_bytes` of text), which tasks get as a broadcast array: the plan's size is the same for any input.
    """
    spark = df.sparkSession
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST)).alias("key"), F.xxhash64(whole).alias("sig"), F.col(key).cast("long").alias("id"), whole.alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = rows.select("key", "sig").repartitionByRange(max(1, -(-size // bucket_bytes)), "key", "sig")
    heads = [r["head"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.max(F.struct("key", "sig")).alias("head")).collect()]
    bounds = spark.sparkContext.broadcast(np.sort(_ordered(*(np.array([h[i] for h in heads], np.int64) for i in range(2)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = _ordered(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            bucket = np.searchsorted(bounds.value, pair).astype(np.int32)
            head = np.flatnonzero(bounds.value[bucket] == pair)
            head = head[np.unique(bucket[head], return_index=True)[1]]  # of equal rows one will do
            before = ((bucket[head] + 1) % len(bounds.value)).astype(np.int32)  # descending: the rows before a head are in the bucket above
            copies = batch.take(pa.array(head))
            for number, ahead, part in ((bucket, False, batch), (before, True, copies)):
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.full(len(number), ahead)), *part.columns], names=["bucket", "ahead", "key", "sig", "id", "text"])

    numbered = rows.mapInArrow(deal, "bucket int, ahead boolean, key long, sig long, id long, text string")
    return numbered.repartitionById(max(1, len(heads)), "bucket").sortWithinPartitions("bucket", "ahead", F.desc("key"), F.desc("sig")).select("bucket", "ahead", "id", "text")


def edited_text(text: str, following: str) -> str:
    """The text with its last third of code points (rounded down) replaced by the first as many, or all, of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


@in_small_batches
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def finish(held: list[tuple]) -> pa.RecordBatch:
        """All but the last of these consecutive rows."""
        texts = [x[1] for x in held]
        edits = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
        own, new = sketches(pa.array(texts, pa.string())), sketches(pa.array(edits, pa.string()))
        show = lambda s: base64.b64encode(s.astype(">u8").tobytes()).decode()
        last = len(edits)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in held[:last]], pa.int64()), pa.array([len(t) for t in texts[:last]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits], pa.string()),
                pa.array([show(s) for s in own[:last]], pa.string()), pa.array([show(s) for s in new], pa.string()),
                pa.array([resemblance(a, b) for a, b in zip(own, new)], pa.float64()), pa.array([resemblance(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            names=[f.split()[0] for f in fields.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket, closed = None, False
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for b, ahead, doc, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    if b != bucket:
                        if len(held) > 1:
                            yield finish(held)
                        held, bucket, closed = [], b, False
                    if not closed:
                        held.append((doc, text))
                        closed = ahead
                if len(held) > 256:
                    yield finish(held)
                    held = held[-1:]
        if len(held) > 1:
            yield finish(held)

    return rows.mapInArrow(run, fields)
