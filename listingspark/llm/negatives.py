"""Operator 12, hard-negative mining: Strassen products of anchor and candidate tiles, then mergeable heaps.

Anchors are a stated set of rows; each meets every candidate once for positives and once more for negatives, tile by tile. Scores
are integer inner products. Strassen's recursion works on int64 tiles padded with zeros to even sides; its additions are exact (sums
that leave 64 bits come back modulo 2^64 when the product itself fits; products that might not are computed with whole numbers of any
size). A task folds the tiles it sees into heaps of k, and heaps of all tasks merge by rank.

Positives of an anchor: the first `positives` other rows of its label. Negatives of an anchor and positive: the first `negatives` rows of another
label whose score lies between `low` percent of the positive's and the positive's. Higher scores come first, ties by smaller key (nulls last).
Rows with a null label or vector, or a null or non-finite component, take no part. A null key is no anchor but may be found; each of
repeated rows is an anchor and a candidate of its own. No row, no anchor, no positive or none within the window: no rows come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.arrays import in_small_batches, staged
from listingspark.llm.vectors import BROADCAST_BYTES, LOW, ROWS_TILE, Heaps, as_scores, keyed, largest_product, listed, met, padded, picked_rows, ranked, row_tiles, tiles, unpacked

LEAF = 32
#: Anchor tiles whose heaps a task holds at once; beyond, it sends them on and begins anew.
HELD = 64


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b by seven products of quarters, down to sides of `leaf`."""
    m, k, n = len(a), a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    x, y, z = (-(-s // 2) for s in (m, k, n))
    a, b = padded(a, 2 * x, 2 * y), padded(b, 2 * y, 2 * z)
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * x, 2 * z), a.dtype)
    out[:x, :z] = p1 + p4 - p5 + p7
    out[:x, z:] = p3 + p5
    out[x:, :z] = p2 + p4
    out[x:, z:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def tile_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both as longs."""
    dim = max(a.shape[1], b.shape[1])
    a, b = padded(a, len(a), dim), padded(b, len(b), dim)
    if largest_product(a, b) >= -LOW:
        a, b = a.astype(object), b.astype(object)
    return as_scores(strassen(a, b.T))


def window_low(positive: np.ndarray, low: int) -> np.ndarray:
    """The least score with 100 * score >= low * positive, without leaving 64 bits."""
    whole, rest = np.divmod(positive, 100)
    return whole * low - (-rest * low) // 100


def hard_negatives(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label", every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are rows whose key is divisible by `every`."""
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(key).cast("long").alias("key"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")).where("label is not null")
    cells = staged(tiles(rows), "tiles")
    rows = staged(picked_rows(cells, every), "anchors")
    groups = -(-rows.count() // ROWS_TILE)
    anchors = staged(row_tiles(rows.repartition(max(1, groups))), "anchor-tiles").withColumn("g", F.pmod(F.xxhash64("a"), F.lit(max(1, groups))))
    size = anchors.agg(F.coalesce(F.sum(F.length("vectors")), F.lit(0))).first()[0]
    # every candidate tile meets every group of anchor tiles: the stated set of anchors, in blocks, against all rows
    many = cells.select("keys", "labels", F.col("dim").alias("c_dim"), F.col("vectors").alias("c_vectors"), "tile")
    many = many.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")) if groups else F.array().cast("array<long>")))
    names = ["a", "keys", "labels", "c_dim", "c_vectors", "tile", "a_keys", "a_labels", "tiles", "places", "dim", "vectors", "wanted"]
    own = anchors.withColumnsRenamed({"keys": "a_keys", "labels": "a_labels"})

    def mined(few: DataFrame, push, lines: int, k: int) -> DataFrame:
        """Heaps of `lines` lines for each anchor over all candidates, as (a, line, key, score) rows; push adds a tile's scores to them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heaps: dict[int, Heaps] = {}

            def sent(a: int) -> pa.RecordBatch:
                line, _, found, score = heaps.pop(a).rows()
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(line), a)), pa.array(line.astype(np.int32)), found, pa.array(score)], names=["a", "line", "key", "score"])

            for batch in batches:
                for i in range(len(batch)):
                    x = dict(zip(names, (c[i] for c in batch.columns), strict=True))
                    a = x["a"].as_py()
                    mine, theirs = unpacked(x["vectors"].as_buffer(), x["dim"].as_py()), unpacked(x["c_vectors"].as_buffer(), x["c_dim"].as_py())
                    if a not in heaps:
                        if len(heaps) == HELD:
                            yield sent(next(iter(heaps)))
                        heaps[a] = Heaps(len(mine) * lines, k)
                    push(heaps[a], tile_scores(mine, theirs), x)
            for a in list(heaps):
                yield sent(a)

        return met(many, few, "g", size <= broadcast_bytes, "tile").select(*names).mapInArrow(run, "a long, line int, key long, score long")

    def same_label(heaps: Heaps, score: np.ndarray, x: dict) -> None:
        allowed = keyed(x["a_labels"].values)[0][:, None] == keyed(x["labels"].values)[0]
        mine = np.flatnonzero(keyed(x["tiles"].values)[0] == x["tile"].as_py())
        allowed[mine, keyed(x["places"].values)[0][mine]] = False  # an anchor isn't its own positive
        heaps.push(score, allowed, *listed(x["keys"]))

    def in_window(heaps: Heaps, score: np.ndarray, x: dict) -> None:
        wanted = x["wanted"].values
        line, top = (keyed(wanted.field(i))[0] for i in range(2))
        at = line // positives
        differ = keyed(x["a_labels"].values)[0][:, None] != keyed(x["labels"].values)[0]
        full = np.zeros((len(heaps.score), score.shape[1]), bool)
        full[line] = differ[at] & (score[at] <= top[:, None]) & (score[at] >= window_low(top, low)[:, None])
        heaps.push(np.repeat(score, positives, axis=0), full, *listed(x["keys"]))

    by_line = ["a", "line"]
    none = F.lit(None).cast("array<struct<line:int,score:long>>").alias("wanted")
    found = staged(ranked(mined(own.withColumn("wanted", none), same_label, 1, positives), by_line, F.col("key"), F.col("score"), positives), "positives")
    found = found.select("a", (F.col("line") * positives + F.col("rank") - 1).cast("int").alias("line"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
    wanted = found.groupBy("a").agg(F.collect_list(F.struct("line", F.col("positive_score").alias("score"))).alias("wanted"))  # at most positives x ROWS_TILE
    out = ranked(mined(own.join(wanted, "a"), in_window, positives, negatives), by_line, F.col("key"), F.col("score"), negatives)
    names_of = own.select("a", F.posexplode("a_keys").alias("i", "anchor_id"))
    out = out.join(found, by_line).withColumn("i", F.floor(F.col("line") / positives).cast("int")).join(names_of, ["a", "i"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


@in_small_batches
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of embeddings; labels of rows whose vec_id is divisible by 7 are moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


WHOLE = """
whole AS (
  SELECT row_number() OVER () AS rn, vec_id, {label} AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""
ORACLE = f"""
WITH {WHOLE.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")}, named AS (SELECT * FROM whole WHERE label IS NOT NULL
), scores AS (
  SELECT a.rn AS a, a.vec_id AS anchor_id, b.rn AS b, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM named a JOIN named b ON a.rn <> b.rn WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST, s.b)::INTEGER AS rank, s.vec_id AS negative_id,
       p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.a = p.a AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
