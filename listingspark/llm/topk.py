"""Operator 13, exact top-k search by inner product: an index of pivots and distances.

Every vector is keyed by its nearest pivot and its distance to it and stored in that order, in blocks (annuli) that know their least and
greatest distance and greatest norm. For a query q at distance d of a pivot, a vector x of an annulus [lo, hi] of that pivot is at least
gap = max(0, d - hi, lo - d) away from q by the triangle inequality, so q.x <= (|q|^2 + |x|^2 - gap^2) / 2. A query opens its annuli in
order of that bound, in waves, and stops where the bound falls under the k-th score it has; blocks of an opened annulus are tested once more
by their own bound. What opens is multiplied exactly. Bounds only skip what can't reach the k-th score: results don't depend on pivots.

Pivots are fitted on a bounded sample: of each of SAMPLE hash buckets of vectors the least, of these the first `pivots`; every vector is
indexed. Per pivot, `rings` quantiles of distance make the directory that queries see: pivots x rings rows, whatever the input.

Queries are the rows whose key is divisible by `every`; each meets all rows but itself. Higher scores come first, ties by smaller key (nulls
last). Null vectors and those with a null or non-finite component take no part; a null key is no query but may be found; each of repeated
rows is a query and a candidate of its own. A table with fewer than k other rows gives all of them; one without queries gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listingspark.llm.arrays import in_small_batches, staged
from listingspark.llm.vectors import BROADCAST_BYTES, LOW, ROWS_TILE, TILE_ROWS, VECTORS, Heaps, keyed, listed, met, one_list, packed, padded, picked_rows, products, ranked, row_tiles, unpacked, whole

PIVOTS, RINGS = 32, 16
SAMPLE = 4096
#: Annuli that a query has opened at most after each wave but the last, which opens all that its bound doesn't rule out.
WAVES = (4, 128)
#: Of the squares in a bound; rounding of distances stays below.
SLACK = 1e-6


def squares(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return np.einsum("ij,ij->i", m, m)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of a from all rows of b."""
    dim = max(a.shape[1], b.shape[1])
    a, b = (padded(m, len(m), dim).astype(np.float64) for m in (a, b))
    return np.sqrt(np.maximum(0, squares(a)[:, None] + squares(b) - 2 * (a @ b.T)))


def most(norm: np.ndarray, away: np.ndarray, low: np.ndarray, high: np.ndarray, top: np.ndarray) -> np.ndarray:
    """No inner product of a query (its squared norm, its distance of a pivot) with a vector of the annulus (squared norms up to top) is greater."""
    gap = np.maximum(0, np.maximum(away - high, low - away))
    bound = np.minimum((norm + top - gap * gap) / 2, np.sqrt(norm * top))  # the second: the same inequality about the origin
    return bound + SLACK * (norm + top) + 1


def pivots_of(rows: DataFrame, count: int) -> np.ndarray:
    """The pivots, from (key, vector) rows: at most SAMPLE vectors reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, matrix = whole(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([matrix.shape[1]] * len(matrix), pa.int32()), pa.array([packed(m[None]) for m in matrix], pa.binary())], names=["dim", "vectors"])

    hashed = rows.select("vector").mapInArrow(run, VECTORS).select(F.xxhash64("vectors").alias("h"), "dim", "vectors")
    least = hashed.groupBy(F.pmod("h", F.lit(SAMPLE)).alias("b")).agg(F.min(F.struct("h", "dim", "vectors")).alias("v"))
    found = least.orderBy("v.h").limit(count).select("v.dim", "v.vectors").collect()
    dim = max([1, *(r["dim"] for r in found)])
    return np.concatenate([np.zeros((0, dim), np.int64), *(padded(unpacked(r["vectors"], r["dim"]), 1, dim) for r in found)])


def indexed(rows: DataFrame, pivots, rings: int, size: int = TILE_ROWS) -> DataFrame:
    """(keys, labels, dim, vectors, tile, pivot, ring, low, high, top): all vectors in blocks, by pivot and distance."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, matrix = whole(batch.column(1))
            if len(keep):
                away = distances(matrix, pivots.value)
                near = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near]), pa.array([matrix.shape[1]] * len(keep), pa.int32()), pa.array([packed(m[None]) for m in matrix], pa.binary())], names=["key", "pivot", "distance", "dim", "vector"])

    placed = staged(rows.mapInArrow(place, "key long, pivot int, distance double, dim int, vector binary"), "placed")
    shares = [i / rings for i in range(1, rings)]
    cuts = {r["pivot"]: np.array(r["cuts"]) for r in placed.groupBy("pivot").agg(F.percentile_approx("distance", shares, 1000).alias("cuts")).collect()}  # a row for each pivot

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, away = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            ring = np.array([np.searchsorted(cuts[p], d) for p, d in zip(pivot.tolist(), away.tolist(), strict=True)], np.int64)
            starts = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (ring[1:] != ring[:-1])]))
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                yield from (made(batch.slice(i, min(size, b - i)), ring[a]) for i in range(a, b, size))

    def made(part: pa.RecordBatch, ring: int) -> pa.RecordBatch:
        part = part.take(pa.array(np.lexsort(keyed(part.column(0)))))
        dims, away = part.column(3).to_pylist(), part.column(2).to_numpy()
        matrix = np.concatenate([padded(unpacked(v.as_buffer(), d), 1, max(dims)) for v, d in zip(part.column(4), dims, strict=True)])
        numbers = [pa.array([x]) for x in (away.min(), away.max(), squares(matrix).max())]
        return pa.RecordBatch.from_arrays([one_list(part.column(0)), one_list(pa.nulls(len(part), pa.int64())), pa.array([matrix.shape[1]], pa.int32()), pa.array([packed(matrix)], pa.binary()), part.column(1)[:1], pa.array([ring], pa.int32()), *numbers], names=["keys", "labels", "dim", "vectors", "pivot", "ring", "low", "high", "top"])

    # the last key of the order only spreads equal rows
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(partitions, "pivot", "distance", "any").sortWithinPartitions("pivot", "distance")
    blocks = ordered.select("key", "pivot", "distance", "dim", "vector").mapInArrow(block, f"keys array<long>, labels array<long>, {VECTORS}, pivot int, ring int, low double, high double, top double")
    return staged(blocks.withColumn("tile", F.monotonically_increasing_id()), "index")


def top_products(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, pivots: int = PIVOTS, rings: int = RINGS, waves: tuple[int, ...] = WAVES, broadcast_bytes: int = BROADCAST_BYTES, opened: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score); a list given as `opened` gets the share of the directory's rows that each wave opened."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    centres = spark.sparkContext.broadcast(pivots_of(rows, pivots))
    blocks = indexed(rows, centres, rings)
    cell = F.col("pivot") * rings + F.col("ring")
    directory = np.array([tuple(r) for r in blocks.groupBy("pivot", "ring").agg(F.min("low"), F.max("high"), F.max("top")).orderBy("pivot", "ring").collect()]).reshape(-1, 5)
    asked = staged(picked_rows(blocks, every), "queries")
    count = asked.count()
    queries = staged(row_tiles(asked.repartitionByRange(max(1, -(-count // ROWS_TILE)), "tile", "place")), "query-tiles")
    centre, ring = directory[:, 0].astype(np.int64), directory[:, 1].astype(np.int64)
    index = blocks.select(cell.alias("cell"), "keys", F.col("dim").alias("c_dim"), F.col("vectors").alias("c_vectors"), "tile", "pivot", "low", "high", "top")
    names = ["a", "lines", "floors", "tiles", "places", "dim", "vectors", "keys", "c_dim", "c_vectors", "tile", "pivot", "low", "high", "top"]

    def wave(first: int, last: int, floors: DataFrame) -> DataFrame:
        """(cell, a, lines, floors, ...): the annuli that stand from `first` to `last` in a query's order and may reach its k-th score."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    x = dict(zip(("a", "tiles", "places", "dim", "vectors", "floors"), (c[i] for c in batch.columns), strict=True))
                    matrix, dim = unpacked(x["vectors"].as_buffer(), x["dim"].as_py()), x["dim"].as_py()
                    floor = np.full(len(matrix), LOW)
                    if x["floors"].is_valid:
                        line, score = (keyed(x["floors"].values.field(j))[0] for j in range(2))
                        floor[line] = score
                    away = distances(matrix, centres.value)[:, centre]
                    bound = most(squares(matrix)[:, None], away, *directory[:, 2:].T)
                    place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1, kind="stable")
                    wanted = (place >= first) & (place < last) & (bound >= floor[:, None])
                    for c in np.flatnonzero(wanted.any(axis=0)):
                        at = np.flatnonzero(wanted[:, c])
                        lists = [one_list(pa.array(v)) for v in (at.astype(np.int32), floor[at], keyed(x["tiles"].values)[0][at], keyed(x["places"].values)[0][at])]
                        yield pa.RecordBatch.from_arrays([pa.array([int(centre[c] * rings + ring[c])], pa.int32()), pa.array([x["a"].as_py()]), *lists, pa.array([dim], pa.int32()), pa.array([packed(matrix[at])], pa.binary())], names=["cell", *names[:7]])

        few = queries.join(floors, "a", "left").select("a", "tiles", "places", "dim", "vectors", "floors")
        return few.mapInArrow(run, f"cell int, a long, lines array<int>, floors array<long>, tiles array<long>, places array<int>, {VECTORS}")

    def opened_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, Heaps] = {}

        def sent(a: int) -> pa.RecordBatch:
            line, _, found, score = heaps.pop(a).rows()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(line), a)), pa.array(line.astype(np.int32)), found, pa.array(score)], names=["a", "line", "key", "score"])

        for batch in batches:
            for i in range(len(batch)):
                x = dict(zip(names, (c[i] for c in batch.columns), strict=True))
                a, line = x["a"].as_py(), keyed(x["lines"].values)[0]
                if a not in heaps:
                    if len(heaps) == 64:  # the heaps that a task holds at once
                        yield sent(next(iter(heaps)))
                    heaps[a] = Heaps(ROWS_TILE, k)
                heap, mine = heaps[a], unpacked(x["vectors"].as_buffer(), x["dim"].as_py())
                floor = np.maximum(keyed(x["floors"].values)[0], heap.score[line, -1])
                away = distances(mine, centres.value[x["pivot"].as_py()][None])[:, 0]
                at = np.flatnonzero(most(squares(mine), away, *(x[n].as_py() for n in ("low", "high", "top"))) >= floor)
                if not len(at):
                    continue
                score = products(mine[at], unpacked(x["c_vectors"].as_buffer(), x["c_dim"].as_py()))
                allowed = score >= floor[at, None]
                own = np.flatnonzero(keyed(x["tiles"].values)[0][at] == x["tile"].as_py())
                allowed[own, keyed(x["places"].values)[0][at][own]] = False
                heap.push_lines(line[at], score, allowed, *listed(x["keys"]))
        for a in list(heaps):
            yield sent(a)

    best = spark.createDataFrame([], "a long, line int, key long, score long, rank int")
    for first, last in zip((0, *waves), (*waves, len(directory)), strict=True):
        if first >= len(directory):
            break
        floors = best.where(F.col("rank") == k).groupBy("a").agg(F.collect_list(F.struct("line", "score")).alias("floors"))  # at most a tile's rows
        few = staged(wave(first, last, floors), "opened")
        size, pairs = few.agg(F.coalesce(F.sum(F.length("vectors")), F.lit(0)), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
        if opened is not None:
            opened.append(pairs / max(1, count * len(directory)))
        if not pairs:
            break
        scores = met(index, few, "cell", size <= broadcast_bytes, "tile").select(*names).mapInArrow(opened_scores, "a long, line int, key long, score long")
        best = staged(ranked(best.drop("rank").unionByName(scores), ["a", "line"], F.col("key"), F.col("score"), k), "best")
    of = queries.select("a", F.posexplode("keys").alias("line", "query_id"))
    return best.join(of, ["a", "line"]).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("vec_id"), "score")


@in_small_batches
def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of embeddings for each row whose vec_id is divisible by 50."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH whole AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.rn ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id NULLS LAST, c.rn)::INTEGER AS rank, c.vec_id,
       list_inner_product(q.v, c.v)::BIGINT AS score
FROM whole q JOIN whole c ON q.rn <> c.rn WHERE q.vec_id % 50 = 0
QUALIFY rank <= 5
"""
