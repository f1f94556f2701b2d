"""Vectorised text kernels and small Spark helpers that several operators share.

Texts reach Python as Arrow batches. The kernels work on one uint8 buffer with row offsets, cut into pieces of a
quarter of a megabyte, so that a task's memory doesn't depend on the size of its partition (only on its longest text).
"""

from __future__ import annotations

import contextlib
import functools
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 18


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets (one more than rows, from 0); nulls are empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with at most `most` bytes, or of one longer row."""
    data, offsets = utf8(column)
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        high = min(high, rows)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


# ---------------------------------------------------------------- hashes of words and shingles

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
#: Numbers of bytes for a second hash that doesn't depend on the first.
SECOND = mix(np.arange(257, 513, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray, numbers: np.ndarray = _BYTE) -> np.ndarray:
    """h with h[j] - h[i], times the inverse power i, a hash of bytes i..j-1."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(numbers[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the row of the maximal runs of bytes that are no separators; rows part words too."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    first[at] = inside[at]
    at = offsets[1:][full] - 1
    last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z in lower case, and the word counts as row offsets."""
    low = _LOWER[data]
    start, end, row = word_spans(low, offsets, separator)
    hashes = span_hash(prefix_hash(low), start, end)
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(row, minlength=len(offsets) - 1), out=bounds[1:])
    return hashes, bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the ascending distinct hashes of its n-word shingles; fewer words make one shingle, none an empty set."""
    words, bounds = word_hashes(data, offsets)
    joined = words.copy()
    for k in range(1, n):
        joined[: len(words) - k] = joined[: len(words) - k] * np.uint64(_BASE) + words[k:]
    joined = mix(joined + np.uint64(n))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(joined[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            h = 0
            for w in words[a:b].tolist():
                h = (h * _BASE + w) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([(h + b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(words[:0])
    return out


# ---------------------------------------------------------------- sums of long vectors over all partitions

BLOCK = 1 << 16
VECTOR = "name string, block int, part int, payload binary"


def _pack(v: np.ndarray) -> bytes:
    kind = "<u4" if v.max(initial=0) < 1 << 32 else "<i8"
    return kind.encode() + zlib.compress(v.astype(kind).tobytes(), 1)


def _unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(payload[3:]), payload[:3].decode()).astype(np.int64)


def vector_rows(name: str, vector: np.ndarray, part: int) -> pa.RecordBatch:
    """A task's share of a vector of counts, in blocks without those of zeros only."""
    blocks = [(k, v) for k, i in enumerate(range(0, len(vector), BLOCK)) if (v := vector[i : i + BLOCK]).any()]
    return pa.RecordBatch.from_pydict({
        "name": pa.array([name] * len(blocks), pa.string()),
        "block": pa.array([k for k, _ in blocks], pa.int32()),
        "part": pa.array([part] * len(blocks), pa.int32()),
        "payload": pa.array([_pack(v) for _, v in blocks], pa.binary()),
    })


def vector_sum(rows: DataFrame) -> DataFrame:
    """(name, block, payload): the sums of the shares, in two steps, so that no task reads a share of every task."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(_unpack(payload.as_py()) for payload in table["payload"])
        return pa.table({"name": table["name"][:1], "block": table["block"][:1], "part": table["part"][:1], "payload": pa.array([_pack(total)], pa.binary())})

    rows = rows.withColumn("part", F.pmod("part", F.lit(64)))
    if rows.rdd.getNumPartitions() > 256:
        rows = rows.groupBy("name", "block", "part").applyInArrow(add, VECTOR)
    return rows.groupBy("name", "block").applyInArrow(add, VECTOR).select("name", "block", "payload")


def gathered(rows: DataFrame, length: int) -> dict[str, np.ndarray]:
    """vector_sum's rows on the driver. Their size is length times the number of names, whatever the input."""
    out: dict[str, np.ndarray] = {}
    with shuffles_removed(rows.sparkSession):
        found = rows.collect()
    for name, block, payload in found:
        v = _unpack(payload)
        out.setdefault(name, np.zeros(length, np.int64))[block * BLOCK : block * BLOCK + len(v)] = v
    return out


# ---------------------------------------------------------------- sets of hashes as bitmaps


@dataclass
class Bitmap:
    """A set of 64-bit hashes by their leading bits: it has all of them, and others by chance."""

    bits: int
    packed: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def bitmap_bits(items: int, spread: int = 16, least: int = 20, most: int = 29) -> int:
    """Bits for `spread` places an item; at most 2^most places (64 MB), beyond which the bitmap lets more through."""
    return min(most, max(least, math.ceil(math.log2(max(1, items) * spread))))


def hash_bitmap(hashes: DataFrame, bits: int) -> Bitmap:
    """The bitmap of the long column k. It is built in blocks by tasks; the driver gets 2^bits / 8 bytes, whatever the number of rows.

    Rows are shuffled once, to their blocks, and not made distinct before: one k in very many rows should be thinned out where it is made.
    """
    bits = max(bits, 17)

    def build(table: pa.Table) -> pa.Table:
        flags = np.zeros(BLOCK, bool)
        flags[table["i"].to_numpy()] = True
        return pa.table({"block": table["block"][:1], "payload": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    index = F.shiftrightunsigned("k", 64 - bits)
    rows = hashes.select(F.shiftright(index, 16).cast("int").alias("block"), index.bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("i"))
    packed = np.zeros(1 << (bits - 3), np.uint8)
    with shuffles_removed(hashes.sparkSession):
        found = rows.groupBy("block").applyInArrow(build, "block int, payload binary").collect()
    for block, payload in found:
        packed[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(payload, np.uint8)
    return Bitmap(bits, packed)


def id_bitmap(ids: DataFrame, bits: int) -> Bitmap:
    """The bitmap of the first column, a long without nulls; of a batch's equal ones, one is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(np.unique(batch.column(0).to_numpy()).view(np.uint64)).view(np.int64))], names=["k"])

    return hash_bitmap(ids.mapInArrow(run, "k long"), bits)


def rows_of(rows: DataFrame, wanted) -> DataFrame:
    """The rows whose first column, a long without nulls, is in the broadcast bitmap, and by chance a few others; without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.value.has(mix(batch.column(0).to_numpy().view(np.uint64)))))

    return rows.mapInArrow(run, rows.schema)


# ---------------------------------------------------------------- tables in the shared folder

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(query):
    """A query or stage (spark, ...) whose rows go to Python by the megabyte, unless the session says otherwise.

    The setting stays in the session, for the query's result is read later. By default a batch is ten thousand rows, whatever their
    size, and both sides of the pipe hold several.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        if spark.conf.get(BATCH_BYTES, None) is None:
            spark.conf.set(BATCH_BYTES, "2m")
        return query(spark, *args)

    return run


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is set, as in tests, one under the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here go with its end: for results that are read once."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: a cut of the lineage that outlives lost executors.

    The shuffle files of the write are removed with its end, for nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, key: str, text: str, name: str) -> tuple[DataFrame, bool]:
    """(docs with a long column `name` that no two rows share, whether it is the key itself).

    Where each key stands once and none is null, the numbers are the keys. Else rows are numbered in order of key (nulls last), then
    text hash, and written to the shared folder, for such numbers hold for one reading only.
    """
    own = F.col(key).cast("long")
    twice = docs.select(own.alias("k")).groupBy("k").agg(F.count("*").alias("c")).where("c > 1 or k is null")
    if twice.isEmpty():
        return docs.withColumn(name, own), True
    # the last key of the order only spreads equal rows
    ordered = docs.orderBy(own.asc_nulls_last(), F.xxhash64(F.col(text).cast("string")), F.monotonically_increasing_id())
    return staged(ordered.withColumn(name, F.monotonically_increasing_id()), "numbered"), False
