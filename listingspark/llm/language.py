"""Operator 7, language identification as a mixture of languages.

Learning counts hashed byte trigrams (A-Z in lower case, other ASCII as blanks) of every learning text by language. A document
is cut into segments of SEGMENT words; each segment has a likelihood under each language. Expectation-maximisation estimates
the document's language proportions; among the one, two, ... all likeliest languages the set with the greatest penalised
likelihood (half the log of the segment count for each further language) is kept, and its largest proportion is the prediction.

A text that is null or has no letter is `und` with score 0, as is every text where nothing was learnt. Ties go to the
alphabetically first language. Rows with a null language teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.arrays import gathered, in_small_batches, pieces, vector_rows, vector_sum, word_spans

BITS, SEGMENT, ROUNDS = 16, 8, 8
UNKNOWN = "und"
#: Each trigram's log-likelihood counts as a third, for each byte is in three of them.
WEIGHT = 1 / 3

_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
_BLANK = _CLASS == 0
_LETTER = regex.compile(r"\p{L}")


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The hashed trigram that ends at each byte; the first two begin with blanks."""
    c = _CLASS[data]
    code = np.empty(len(c) + 2, np.uint32)
    code[:2], code[2:] = 0, c
    mixed = (code[:-2] * np.uint32(155) + code[1:-1]) * np.uint32(155) + code[2:]
    return (mixed * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Log-probabilities of trigrams for each language of the rows, from all rows. The table's size is fixed by the number of languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for low, high, data, offsets in pieces(batch.column(0)):
                grams, here = _trigrams(data), langs[low:high]
                sizes = np.diff(offsets)
                for one in set(here):
                    counts = np.bincount(grams[np.repeat(here == one, sizes)], minlength=1 << BITS)
                    total[one] = total[one] + counts if one in total else counts
        part = TaskContext.get().partitionId()
        for one, counts in total.items():
            yield vector_rows(one, counts, part)

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string"))
    counts = gathered(vector_sum(rows.mapInArrow(run, "name string, block int, part int, payload binary")), 1 << BITS)
    return {k: np.log((v + 0.5) / (v.sum() + 0.5 * len(v))).astype(np.float32) for k, v in sorted(counts.items())}


def mixtures(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, size of the chosen language set) of each row; table: trigrams x languages. Rows without words have proportions 0."""
    docs, langs = len(offsets) - 1, table.shape[1]
    start, end, row = word_spans(data, offsets, _BLANK)
    if not len(start):
        return np.zeros((docs, langs)), np.zeros(docs, int)
    first_word = np.searchsorted(row, np.arange(docs))
    nth = np.arange(len(row)) - first_word[row]
    heads = np.flatnonzero(nth % SEGMENT == 0)
    doc, begin = row[heads], start[heads]
    stop = end[np.append(heads[1:], len(row)) - 1]
    bounds = np.empty(2 * len(begin), np.int64)
    bounds[::2], bounds[1::2] = begin, np.minimum(stop + 1, offsets[doc + 1])
    grams = _trigrams(data)
    bounds[1::2] = np.maximum(bounds[1::2], begin + 1)
    edge = bounds.copy()
    total = np.empty((len(begin), langs), np.float32)
    for k in range(langs):
        values = np.append(table[grams, k], np.float32(0))
        total[:, k] = np.add.reduceat(values, edge)[::2]
    total *= WEIGHT
    like = np.exp(total - total.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    sizes = np.bincount(doc, minlength=docs)
    have = sizes > 0
    at = np.flatnonzero(have)
    starts = np.concatenate([[0], np.cumsum(sizes[at])[:-1]])
    local = np.repeat(np.arange(len(at)), sizes[at])
    n = sizes[at][:, None]

    def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            weighted = like * share[local]
            weighted /= weighted.sum(axis=1, keepdims=True)
            share = np.add.reduceat(weighted, starts, axis=0) / n
        return share, np.add.reduceat(np.log((like * share[local]).sum(axis=1)), starts)

    share, _ = fit(np.ones((len(at), langs)))
    order = np.argsort(-share, axis=1, kind="stable")
    best, best_score, chosen = None, None, np.ones(len(at), int)
    for size in range(1, langs + 1):
        allowed = np.zeros_like(share)
        np.put_along_axis(allowed, order[:, :size], 1.0, axis=1)
        s, score = fit(allowed)
        score = score - 0.5 * (size - 1) * np.log(n[:, 0] + 1)
        if best is None:
            best, best_score = s, score
        else:
            better = score > best_score + 1e-9
            best[better], chosen[better] = s[better], size
            best_score = np.maximum(score, best_score)
    out, n_langs = np.zeros((docs, langs)), np.zeros(docs, int)
    out[at], n_langs[at] = best, chosen
    return out, n_langs


def language_columns(df: DataFrame, model: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with lang_pred, lang_score (its proportion) and lang_shares (the chosen set's proportions) in place of columns of these names."""
    names = list(model)
    table = df.sparkSession.sparkContext.broadcast(np.stack(list(model.values()), axis=1) if names else np.zeros((1 << BITS, 0), np.float32))
    keep = [c for c in df.columns if c not in ("lang_pred", "lang_score", "lang_shares")]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "lang_score double", "lang_shares map<string,double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            predicted, scores, shares = [], [], []
            column = batch.column(batch.schema.get_field_index(text))
            for low, high, data, offsets in pieces(column):
                out, _ = mixtures(data, offsets, table.value) if names else (np.zeros((high - low, 1)), None)
                letters = np.zeros(len(data) + 1, np.int64)
                np.cumsum((_CLASS[data] > 0) & (data < 128), out=letters[1:])
                ascii_letter = letters[offsets[1:]] > letters[offsets[:-1]]
                for i in range(high - low):
                    known = names and (ascii_letter[i] or _LETTER.search(column[low + i].as_py() or ""))
                    p = out[i] if known else out[i] * 0
                    top = int(p.argmax())
                    predicted.append(names[top] if p[top] > 0 else UNKNOWN)
                    scores.append(min(1.0, float(p[top])))
                    shares.append([(names[k], float(p[k])) for k in np.flatnonzero(p > 1e-6)])
            made = [pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*keep, "lang_pred", "lang_score", "lang_shares"])

    return df.select(*keep).mapInArrow(run, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@in_small_batches
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for every document, learnt from the four fifths that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = language_columns(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_shares")


def _lettered(docs: DataFrame) -> DataFrame:
    """The documents with a letter, by the same test as language_columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([bool(_LETTER.search(t.as_py() or "")) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@in_small_batches
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter: those whose language could be told, or all of them where nothing was learnt. The language column isn't changed."""
    model = learn(docs)
    if not model:
        return _lettered(docs)
    return language_columns(docs, model).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)
