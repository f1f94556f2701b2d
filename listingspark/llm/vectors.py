"""Whole-number vectors in tiles, exact products and mergeable heaps, for the operators on embeddings.

Component x becomes floor(256 * x), x as double, held within +-2^62. Null vectors and those with a null or non-finite component
take no part. Shorter vectors count as ended by zeros, so vectors of several lengths, and empty ones, have products too.

A tile is one row with some hundred vectors, so that rows reach numpy as matrices. Tiles are written to the shared folder once:
(tile, place in it) then names a row for good, whatever keys are null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
MOST = 1 << 62
#: Below every score; scores are held above it.
LOW = -(1 << 63) + 1
TILE_ROWS = 512
#: Anchors or queries to a tile.
ROWS_TILE = 256
VECTORS = "dim int, vectors binary"
#: Anchors or queries up to so many bytes (measured) are broadcast; beyond, both sides are dealt by key and salt.
BROADCAST_BYTES = 64 << 20
SALTS = 16


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that take part, their whole-number components padded with zeros as an int64 matrix)."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    keep = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (odd[ends] == odd[ends - lengths]))
    dim = max(1, int(lengths[keep].max(initial=0)))
    out = np.zeros((len(keep), dim))
    place = np.arange(dim) < lengths[keep, None]
    out[place] = flat[np.isin(np.repeat(np.arange(len(lengths)), lengths), keep)]
    return keep, np.clip(np.floor(out * SCALE), -MOST, MOST).astype(np.int64)


def packed(matrix: np.ndarray) -> bytes:
    """The matrix in the least of two, four or eight bytes a component."""
    top = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return b"%d" % width + matrix.astype(f"<i{width}").tobytes()


def unpacked(payload, dim: int) -> np.ndarray:
    raw = memoryview(payload)
    return np.frombuffer(raw[1:], f"<i{chr(raw[0])}").reshape(-1, dim).astype(np.int64)


def padded(matrix: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The matrix with zeros below and to the right."""
    if matrix.shape == (rows, columns):
        return matrix
    out = np.zeros((rows, columns), matrix.dtype)
    out[: matrix.shape[0], : matrix.shape[1]] = matrix
    return out


def largest_product(a: np.ndarray, b: np.ndarray) -> int:
    """No inner product of rows, nor any part of its sum, is further from zero."""
    top = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    return top(a) * top(b) * a.shape[1]


def as_scores(product: np.ndarray) -> np.ndarray:
    """Products as longs; those that no long holds become the nearest."""
    return product if product.dtype == np.int64 else np.clip(product, LOW + 1, -LOW).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of a and b, exactly: by floating-point blocks where every sum is a whole number below 2^53."""
    dim = max(a.shape[1], b.shape[1])
    a, b = padded(a, len(a), dim), padded(b, len(b), dim)
    top = largest_product(a, b)
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return as_scores(a @ b.T if top < -LOW else a.astype(object) @ b.astype(object).T)


class Heaps:
    """For each of some rows the first k candidates by score (descending), then key (ascending, nulls last). Two merge into one."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score = np.full((rows, k), LOW)
        self.key = np.zeros((rows, k), np.int64)
        self.null = np.ones((rows, k), bool)

    def merge(self, at: np.ndarray, score: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        """Further candidates of the rows `at`, a row of each array for each of them."""
        score, key, null = (np.concatenate([own[at], new], axis=1) for own, new in ((self.score, score), (self.key, key), (self.null, null)))
        first = np.lexsort((key, null, -score), axis=-1)[:, : self.k]
        for own, new in ((self.score, score), (self.key, key), (self.null, null)):
            own[at] = np.take_along_axis(new, first, axis=1)

    def push(self, score: np.ndarray, allowed: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        """Scores of every row against candidates in ascending order of key; of equal scores the first counts, so ties cost nothing."""
        allowed = allowed & (score >= self.score[:, -1:])
        at = np.flatnonzero(allowed.any(axis=1))
        if not len(at):
            return
        work, line = np.where(allowed[at], score[at], LOW), np.arange(len(at))
        found = np.zeros((len(at), min(self.k, score.shape[1])), np.int64)
        best = np.empty_like(found)
        for j in range(found.shape[1]):
            found[:, j] = place = work.argmax(axis=1)
            best[:, j] = work[line, place]
            work[line, place] = LOW
        self.merge(at, best, key[found], null[found])

    def push_lines(self, lines: np.ndarray, score: np.ndarray, allowed: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        """push() for some of the rows."""
        part = Heaps(0, self.k)
        part.score, part.key, part.null = self.score[lines], self.key[lines], self.null[lines]
        part.push(score, allowed, key, null)
        self.score[lines], self.key[lines], self.null[lines] = part.score, part.key, part.null

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(row, place in the heap, key, score) of what is held."""
        row, place = np.nonzero(self.score > LOW)
        return row, place, pa.array(self.key[row, place], mask=self.null[row, place]), self.score[row, place]


def keyed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A long column's values (0 for nulls) and where it is null."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def one_list(values: pa.Array) -> pa.ListArray:
    """A column of one row that holds all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def listed(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return keyed(cell.values)


def tiles(rows: DataFrame, size: int = TILE_ROWS) -> DataFrame:
    """(keys, labels, dim, vectors, tile) from (key, label, vector) rows: at most `size` of a partition's rows to a tile, by key (nulls last)."""
    fields = f"keys array<long>, labels array<long>, {VECTORS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                keep, matrix = whole(part.column(2))
                if not len(keep):
                    continue
                order = np.lexsort(tuple(x[keep] for x in keyed(part.column(0))))
                part = part.take(pa.array(keep[order]))
                yield pa.RecordBatch.from_arrays([one_list(part.column(0)), one_list(part.column(1)), pa.array([matrix.shape[1]], pa.int32()), pa.array([packed(matrix[order])], pa.binary())], names=["keys", "labels", "dim", "vectors"])

    return rows.mapInArrow(run, fields).withColumn("tile", F.monotonically_increasing_id())


def picked_rows(cells: DataFrame, every: int) -> DataFrame:
    """(key, label, tile, place, dim, vector): the rows of the tiles whose key is divisible by `every`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                key, null = listed(batch.column(0)[i])
                at = np.flatnonzero(~null & (key % every == 0))
                dim, tile = batch.column(2)[i].as_py(), batch.column(4)[i].as_py()
                matrix = unpacked(batch.column(3)[i].as_buffer(), dim)[at]
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), batch.column(1)[i].values.take(pa.array(at)), pa.array([tile] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array([dim] * len(at), pa.int32()), pa.array([packed(m[None]) for m in matrix], pa.binary())], names=["key", "label", "tile", "place", "dim", "vector"])

    return cells.select("keys", "labels", "dim", "vectors", "tile").mapInArrow(run, "key long, label long, tile long, place int, dim int, vector binary")


def row_tiles(rows: DataFrame, size: int = ROWS_TILE) -> DataFrame:
    """(a, keys, labels, tiles, places, dim, vectors): the rows of each partition, `size` to a tile; no two tiles share a."""
    fields = f"keys array<long>, labels array<long>, tiles array<long>, places array<int>, {VECTORS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            full = len(table) - len(table) % size
            yield from (made(table.slice(at, size)) for at in range(0, full, size))
            held = table.slice(full).to_batches()
        if held:
            yield made(pa.Table.from_batches(held).combine_chunks())

    def made(table: pa.Table) -> pa.RecordBatch:
        dims = table["dim"].to_pylist()
        matrix = np.concatenate([padded(unpacked(v.as_buffer(), d), 1, max(dims)) for v, d in zip(table["vector"], dims, strict=True)])
        lists = [one_list(table[name].combine_chunks()) for name in ("key", "label", "tile", "place")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([matrix.shape[1]], pa.int32()), pa.array([packed(matrix)], pa.binary())], names=[f.split()[0] for f in fields.split(", ")])

    return rows.mapInArrow(run, fields).withColumn("a", F.monotonically_increasing_id())


def ranked(rows: DataFrame, by: list[str], key: Column, score: Column, k: int) -> DataFrame:
    """The first k rows of each group, with rank from 1; Spark keeps k rows of a group in each task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), key.asc_nulls_last()))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def met(many: DataFrame, few: DataFrame, key: str, small: bool, salt: str) -> DataFrame:
    """The rows of both with one key: the few broadcast while they are small (measured by the caller), else both dealt by key and a salt of `many`'s rows."""
    if small:
        return many.join(F.broadcast(few), key)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")
