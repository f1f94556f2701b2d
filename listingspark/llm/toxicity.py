"""Operator 6, toxicity by the nearest labelled examples.

A text is a vector over all its words (runs of letters, A-Z in lower case), hashed to 2^PLACES places: (1 + log tf) * idf * relevance,
of unit length. So a long text with one telling word is far from the texts that consist of such words.

- Document frequencies count every document. Relevance comes from all labelled rows: the lower end of a place's share of toxic rows
  (Wilson, Z deviations, so that rare words don't count by chance), above the share p of all rows: max(FLOOR, (low - p) / (1 - p)).
- Near copies of one text would make all its words look telling, so of the labelled rows with the same least 5-word shingle
  hash and the same label one is kept (the one with the smallest key).
- Examples are at most EXAMPLES labelled rows, half of each label while both suffice, chosen by a hash of the key. This documented
  bound is the only one: it keeps the index that is broadcast within some tens of megabytes.

Scoring: the K nearest examples by exact cosine, found in an inverted index whose postings lie in blocks of BLOCK alike examples with
each place's greatest weight. The blocks with the highest bounds are opened, then all whose bound reaches the K-th cosine so far.
Votes weigh with the square of the cosine and with the number of labelled rows that an example of its label stands for, smoothed by
p: (sum w y + S p) / (sum w + S). Examples vote on each other too, each without itself; a logistic curve fitted to these votes and
their labels, by the same numbers of rows, turns votes into calibrated scores. Evidence is the voters' keys.

Ties at equal cosine go to the example with the smaller key. A text without words has no neighbour, so its vote is p. Rows with a null
label or key teach nothing; without any, all scores are 0. Rows that share a key are scored each by its own text.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.arrays import bitmap_bits, gathered, id_bitmap, in_small_batches, mix, pieces, shingle_sets, staged, vector_rows, vector_sum, word_hashes

PLACES, Z, FLOOR, EXAMPLES, BLOCK, COMMON, K, SMOOTH = 20, 4.0, 0.05, 4096, 64, 0.1, 15, 1.0
THRESHOLD = 0.7

#: Letters are A-Z, a-z and every byte of a character beyond ASCII.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[65:91] = _SEPARATOR[97:123] = _SEPARATOR[128:] = False


def word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, places, counts): row i has the distinct places bounds[i] to bounds[i + 1], ascending, with the words counted there."""
    hashes, bounds = word_hashes(data, offsets, _SEPARATOR)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(bounds))
    pair = np.sort((row << np.uint64(PLACES)) | (hashes >> np.uint64(64 - PLACES)))
    head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    pair, counts = pair[head], np.diff(np.append(head, len(pair)))
    return np.searchsorted(pair >> np.uint64(PLACES), np.arange(len(offsets), dtype=np.uint64)), (pair & np.uint64((1 << PLACES) - 1)).astype(np.int32), counts


def unit(places: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * weight[places]
    return w / max(float(np.sqrt(w @ w)), 1e-300)


class BlockMaxIndex:
    """Unit vectors of examples as postings, by blocks of alike examples with each place's greatest weight; mass: the rows that an example stands for.

    Places that many examples have (COMMON of them) stand in full rows instead, for there every block would be opened: their part of
    each example's cosine is computed first, and a block's bound is its greatest such part and the sum of its other places' greatest weights.
    """

    def __init__(self, places: list[np.ndarray], weights: list[np.ndarray], keys: np.ndarray, labels: np.ndarray, mass: np.ndarray):
        # examples with the same heaviest place share blocks, so that bounds are tight
        top = np.array([p[np.argmax(w)] if len(p) else -1 for p, w in zip(places, weights, strict=True)], np.int64)
        order = np.lexsort((keys, top, labels))
        self.keys, self.labels, self.mass = keys[order], labels[order], mass[order]
        place = np.concatenate([places[i] for i in order] or [np.zeros(0, np.int32)])
        weight = np.concatenate([weights[i] for i in order] or [np.zeros(0)])
        example = np.repeat(np.arange(len(order)), [len(places[i]) for i in order])
        by_place = np.argsort(place, kind="stable")  # and by example, so by block
        place, weight, example = place[by_place], weight[by_place], example[by_place].astype(np.int32)
        self.terms, number, count = np.unique(place, return_inverse=True, return_counts=True)
        often = count > max(COMMON * len(keys), BLOCK)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        full = often[number]
        self.rows = np.zeros((int(often.sum()), len(keys)))
        self.rows[self.row[number[full]], example[full]] = weight[full]
        number, self.weight, self.example = number[~full], weight[~full], example[~full]
        block = self.example // BLOCK
        head = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (block[1:] != block[:-1])])) if len(number) else np.zeros(0, np.int64)
        self.start = np.append(head, len(number))
        self.block = block[head]
        self.greatest = np.maximum.reduceat(self.weight, head) if len(head) else np.zeros(0)
        self.first = np.searchsorted(number[head], np.arange(len(self.terms) + 1))
        self.heads = np.arange(0, len(keys), BLOCK)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each (places, weights) the (examples, cosines) of the k nearest by (cosine falling, key), without those at cosine 0 and the example with its key in `without`."""
        out = []
        for low in range(0, len(queries), BLOCK):  # full rows are multiplied for some queries at once
            some = [self._known(*q) for q in queries[low : low + BLOCK]]
            weights = np.zeros((len(some), len(self.rows)))
            for i, (at, w) in enumerate(some):
                often = self.row[at] >= 0
                weights[i, self.row[at[often]]] = w[often]
                some[i] = at[~often], w[~often]
            common = weights @ self.rows
            out += [self._nearest(*q, common[i], k, without[low + i] if without else None) for i, q in enumerate(some)]
        return out

    def _known(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.terms, places)
        hit = at < len(self.terms)
        hit[hit] = self.terms[at[hit]] == places[hit]
        return at[hit], weights[hit]

    def _nearest(self, at: np.ndarray, weights: np.ndarray, common: np.ndarray, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0)
        size = self.first[at + 1] - self.first[at]
        cell = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        mine, block, blocks = np.repeat(weights, size), self.block[cell], len(self.heads)
        bound = np.maximum.reduceat(common, self.heads) + np.bincount(block, mine * self.greatest[cell], blocks)
        best, cosine = np.zeros(0, np.int64), np.zeros(0)
        opened = np.zeros(blocks, bool)
        for last in (False, True):
            if last:
                opening = bound >= (cosine[k - 1] - 1e-8 if len(cosine) >= k else 1e-300)
            else:
                opening = np.zeros(blocks, bool)
                opening[np.argsort(-bound, kind="stable")[: -(-2 * k // BLOCK) + 1]] = True
            opening &= ~opened & (bound > 0)
            if not opening.any():
                continue
            opened |= opening
            some = opening[block]
            low, high = self.start[cell[some]], self.start[cell[some] + 1]
            n = high - low
            posting = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            score = common + np.bincount(self.example[posting], np.repeat(mine[some], n) * self.weight[posting], len(self.keys))
            score = np.round(np.where(np.repeat(opening, BLOCK)[: len(score)], score, 0.0), 9)
            found = np.flatnonzero(score > 0)
            if without is not None:
                found = found[self.keys[found] != without]
            if len(found) > 4 * k:
                found = found[score[found] >= np.partition(score[found], -k)[-k]]
            best, cosine = np.concatenate([best, found]), np.concatenate([cosine, score[found]])
            order = np.lexsort((self.keys[best], -cosine))[:k]
            best, cosine = best[order], cosine[order]
        return best, cosine


@dataclass
class Model:
    """What a score needs. It travels with the examples' words and counts (packed), some bytes a word; each worker makes the index of them once."""

    weight: np.ndarray
    packed: bytes
    rate: float
    curve: tuple[float, float] = (1.0, 0.0)

    @cached_property
    def index(self) -> BlockMaxIndex:
        sizes, steps, n, keys, labels, mass = pickle.loads(zlib.decompress(self.packed))
        edges = np.cumsum(sizes)[:-1]
        places = [np.cumsum(s, dtype=np.int32) for s in np.split(steps, edges)]
        weights = [unit(p, c, self.weight) for p, c in zip(places, np.split(n.astype(np.int64), edges), strict=True)]
        return BlockMaxIndex(places, weights, keys, labels, mass)

    def votes(self, data: np.ndarray, offsets: np.ndarray, without: list[int] | None = None) -> list[tuple[float, np.ndarray]]:
        """(vote, keys of the examples that voted) of each row"""
        bounds, places, n = word_counts(data, offsets)
        queries = [(places[a:b], unit(places[a:b], n[a:b], self.weight)) for a, b in zip(bounds, bounds[1:])]
        out = []
        for at, cosine in self.index.nearest(queries, without=without):
            w = cosine * cosine * self.index.mass[at]
            out.append((float((w @ self.index.labels[at] + SMOOTH * self.rate) / (w.sum() + SMOOTH)), self.index.keys[at]))
        return out

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * _logit(votes) + self.curve[1], -50, 50)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fitted_curve(votes: np.ndarray, labels: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve over the votes' log-odds with the greatest likelihood; targets are drawn in a little, and the slope isn't negative."""
    positive, negative = mass @ labels, mass @ (1 - labels)
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([_logit(votes), np.ones(len(votes))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        step = np.linalg.solve((x * (mass * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (mass * (target - p)) - 1e-3 * (beta - [1.0, 0.0]))
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def _frequencies(rows: DataFrame, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Rows of each place. rows: (text), or (text, y) for the counts of all rows and those with y = 1; the last counter is of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((1 << PLACES) + 1, np.int64) for _ in names]
        for batch in batches:
            marks = [None, batch.column(1).to_numpy() == 1][: len(names)] if len(names) > 1 else [None]
            for low, high, data, offsets in pieces(batch.column(0)):
                bounds, places, _ = word_counts(data, offsets)
                for total, mark in zip(totals, marks, strict=True):
                    chosen = slice(None) if mark is None else np.repeat(mark[low:high], np.diff(bounds))
                    np.add.at(total, places[chosen], 1)
                    total[-1] += high - low if mark is None else int(mark[low:high].sum())
        for name, total in zip(names, totals, strict=True):
            yield vector_rows(name, total, TaskContext.get().partitionId())

    found = gathered(vector_sum(rows.mapInArrow(run, "name string, block int, part int, payload binary")), (1 << PLACES) + 1)
    return {name: found.get(name, np.zeros((1 << PLACES) + 1, np.int64)) for name in names}


def relevance(n: np.ndarray, t: np.ndarray, p: float) -> np.ndarray:
    """The lower end of the share t / n above the rate p, as a share of 1 - p; FLOOR at least."""
    n = np.maximum(n, 1)
    share, zz = t / n, Z * Z
    low = (share + zz / (2 * n) - Z * np.sqrt((share * (1 - share) + zz / (4 * n)) / n)) / (1 + zz / n)
    return np.maximum(FLOOR, (low - p) / max(1 - p, 1e-9))


def learn(labelled: DataFrame, corpus: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> Model | None:
    """labelled: (key, text, label 0/1); corpus: (text). None without labelled rows."""
    labels = labelled.where(F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    return learn_from(labelled.select(key, text), labels, corpus, key, text, examples)


def learn_from(texts: DataFrame, labels: DataFrame, corpus: DataFrame, key: str = "doc_id", text: str = "text", examples: int = EXAMPLES) -> Model | None:
    """texts: (key, text); labels: (key, y), one row for each key.

    Texts meet labels without moving at first: a bitmap of the labelled keys drops most other texts, and only the texts of the rows
    that are kept (one of each set of near copies with one label) are joined, once.
    """
    share = texts.sparkSession.sparkContext.broadcast
    labels = labels.where("key is not null and y is not null")
    bits = bitmap_bits(labels.count(), 64)
    mine = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def of(batch: pa.RecordBatch, wanted) -> pa.RecordBatch:
        return batch.filter(pa.array(wanted.value.has(mix(batch.column(0).to_numpy().view(np.uint64)))))

    known = share(id_bitmap(labels.select("key"), bits))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = of(batch, known)
            found = [int(s[0]) >> 1 if len(s) else -1 for _, _, data, offsets in pieces(batch.column(1)) for s in shingle_sets(data, offsets, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["key", "least"])

    found = mine.mapInArrow(least, "key long, least long").join(labels, "key")
    chosen = staged(found.groupBy("least", "y").agg(F.min("key").alias("key")).select("key", "y").distinct(), "chosen")
    picked = share(id_bitmap(chosen.select("key"), bits))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield of(batch, picked)

    labelled = staged(mine.mapInArrow(some, mine.schema).join(chosen, "key"), "labelled")
    known.destroy()
    picked.destroy()
    counts = _frequencies(labelled.select("text", "y"), ("n", "t"))
    rows, positive = int(counts["n"][-1]), int(counts["t"][-1])
    if not rows:
        return None
    rate = positive / rows
    df = _frequencies(corpus.select(F.col(text).cast("string")), ("df",))["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    weight = (idf * relevance(counts["n"][:-1], counts["t"][:-1], rate)).astype(np.float32)
    kept = [labelled.where(F.col("y") == y).select("key").orderBy(F.xxhash64("key"), "key").limit(examples // 2) for y in (0, 1)]
    kept = staged(labelled.join(F.broadcast(kept[0].unionAll(kept[1])), "key"), "examples")
    del counts, df, idf

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                bounds, places, n = word_counts(data, offsets)
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (places, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(2)[low:high], *lists], names=["key", "y", "places", "n"])

    # at most `examples` rows, by the bound above: one task packs their words, and the driver only passes them on
    def packed(table: pa.Table) -> pa.Table:
        places, n = ([np.asarray(x.values, np.int32) for x in table[c]] for c in ("places", "n"))
        steps = np.concatenate([np.diff(p, prepend=np.int32(0)) for p in places])
        y = table["y"].to_numpy().astype(np.float64)
        mass = [share / max(1e-9, float((y == k).mean())) for k, share in ((0, 1 - rate), (1, rate))]
        made = np.array([len(p) for p in places], np.int32), steps, np.concatenate(n), table["key"].to_numpy(), y, np.where(y > 0, mass[1], mass[0])
        return pa.table({"examples": pa.array([zlib.compress(pickle.dumps(made), 1)], pa.binary()), "clean": [mass[0]], "toxic": [mass[1]]})

    found = kept.select("key", "text", "y").mapInArrow(words, "key long, y int, places array<int>, n array<int>")
    made = found.groupBy().applyInArrow(packed, "examples binary, clean double, toxic double").first()
    mass_of = made["clean"], made["toxic"]
    model = Model(weight, bytes(made["examples"]), rate)
    judged = share(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for low, high, data, offsets in pieces(batch.column(1)):
                out += [vote for vote, _ in judged.value.votes(data, offsets, batch.column(0)[low:high].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column(2)], names=["vote", "y"])

    spread = kept.select("key", "text", "y").repartition(max(8, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    own = np.array([tuple(r) for r in spread.mapInArrow(votes, "vote double, y int").collect()], float).reshape(-1, 2)
    judged.destroy()
    model.curve = fitted_curve(own[:, 0], own[:, 1], np.where(own[:, 1] > 0, mass_of[1], mass_of[0]))
    return model


def toxicity_columns(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`df` with toxic_score and toxic_evidence (keys of the examples that voted) in place of columns of these names."""
    keep = [c for c in df.columns if c not in ("toxic_score", "toxic_evidence")]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["toxic_score double", "toxic_evidence array<long>"])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, evidence = np.zeros(len(batch)), [[] for _ in range(len(batch))]
            if model:
                for low, _, data, offsets in pieces(batch.column(batch.schema.get_field_index(text))):
                    for i, (vote, keys) in enumerate(model.votes(data, offsets), low):
                        scores[i], evidence[i] = vote, keys
                scores = model.calibrated(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], names=[*keep, "toxic_score", "toxic_evidence"])

    return df.select(*keep).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _model(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learnt from labelled rows that aren't held out."""
    known = labels.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max("toxic").cast("int").alias("y"))
    return learn_from(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text"), known, docs.select("text"))


@in_small_batches
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores for every document, learnt from labelled rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = _model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity_columns(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_evidence")


@in_small_batches
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score under the threshold."""
    model = _model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_columns(docs, model).where(F.col("toxic_score") < THRESHOLD).select(*docs.columns)
