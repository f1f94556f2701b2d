"""Operator 4, packing of token pieces into sequences by a grouping genetic algorithm on islands.

Texts become ids with an end id each; only texts of more than CAPACITY ids are cut. Full pieces are sequences of their own. The
others are dealt by hash into blocks of about BLOCK pieces, and several islands evolve packings of each block apart:

- A chromosome is a list of bins. First ones come from best-fit decreasing under slightly shuffled orders.
- Crossover injects whole well-filled bins of one parent into the other, removes the bins that hold duplicates of their pieces, and
  best-fits the displaced pieces, longest first. Every other child, by chance, has a few bins dissolved and filled anew. Fitness is
  few bins, then the sum of squared fills.
- After each epoch an island's elite migrates to the next island of its block, which takes it into its population.

Where the first chromosome already has the least possible number of bins (the sizes' sum over CAPACITY), nothing can be better and the
island is done; that is common for many small pieces. Pieces of a quarter to a half of CAPACITY are hard for best-fit, and evolution
saves bins there.

The best chromosome of each block's islands is taken. Bins that are filled to CLOSED stay; pieces of the others are pooled, dealt into
fewer blocks and packed again, which takes back what block borders cost; the last round keeps all its bins.

Blocks are bounded, so no task's work depends on the corpus. Random choices are seeded by block and island: a recomputed task
gives the same packing. A null text is empty and is packed as its end id. Repeated rows are packed each.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.arrays import in_small_batches, staged
from listingspark.llm.bpe import printable_bytes

CAPACITY, BLOCK, ISLANDS, EPOCHS, POPULATION, BIRTHS, CLOSED, ROUNDS = 2048, 4096, 4, 3, 6, 24, 0.995, 3
CACHE, CACHED_CHARS = 1_000_000, 64
#: The vocabulary's pre-token pattern, and its white space.
SPACE = r"\t-\r\x20\x85\xa0"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r\x20a-z0-9]+"
#: Texts that may hold what the short way doesn't cover: special tokens, a letter whose lower case is two, or characters beyond U+024F.
OTHER = re.compile("<\\||\u0130|[^\\u0000-\\u024f]")


class CachedTokenizer:
    """Ids of the tokenizers library for a vocabulary that drops white space, with the ids of recent pre-tokens kept.

    Texts of Latin letters are lower-cased and cut by the vocabulary's own pattern here; each new pre-token is encoded by the
    library's model. Any other text is cut at ASCII white space, which no token crosses, and its strings are encoded by the library.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.words = regex.compile(WORDS).findall
        self.ascii_words = re.compile(ASCII_WORDS).findall
        self.bytes = {b: c for c, b in printable_bytes().items()}
        self.cache: dict[str, bytes] = {}

    def cut(self, text: str) -> tuple[list[str], bool]:
        """The strings to encode, and whether they are pre-tokens."""
        if text.isascii():
            if "<|" not in text:
                return self.ascii_words(text.lower()), True
        elif not OTHER.search(text):
            return self.words(text.lower()), True
        return [x.decode() for x in text.encode().split()], False

    def _new(self, word: str, alone: bool) -> bytes:
        if alone:
            # the model knows bytes by printable characters; control characters have others than their own
            ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.bytes))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        out = np.array(ids, "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        words, alone = self.cut(text)
        found = list(map(self.cache.get, words))
        if None in found:
            for i, f in enumerate(found):
                if f is None:
                    found[i] = self.cache.get(words[i]) or self._new(words[i], alone)
        return b"".join(found)


@lru_cache(maxsize=1)
def _tokenizer(source: bytes) -> CachedTokenizer:
    """One for each Python worker, whose tasks share what it keeps."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    return CachedTokenizer(source.decode())


def token_pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(key, row, piece, start, length, ids_crc32) of every text's pieces, with ids of the tokenizers library and an end id."""
    with open(vocabulary, "rb") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(source.value)
        last = np.array([end], "<u4").tobytes()
        for whole in batches:
            for low in range(0, len(whole), 128):
                batch = whole.slice(low, 128)
                keys, rows, numbers, starts, lengths, sums = [], [], [], [], [], []
                blobs = [tokenizer.encode(t or "") for t in batch.column(2).to_pylist()]
                for k, row, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs, strict=True):
                    blob += last
                    for i, at in enumerate(range(0, len(blob), 4 * capacity)):
                        part = blob[at : at + 4 * capacity]
                        keys.append(k)
                        rows.append(row)
                        numbers.append(i)
                        starts.append(at // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["key", "row", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "key long, row long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of pieces (numbers into sizes) with a way to the bin whose free space fits a piece best."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] = ()):  # type: ignore[assignment]
        self.sizes, self.capacity, self.mask = sizes, capacity, 0
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        for b in bins:
            self._put(len(self.bins), capacity - sum([sizes[i] for i in b]), b)

    def _put(self, number: int, free: int, content: list[int] | None = None) -> None:
        if content is not None:
            self.bins.append(content)
            self.free.append(free)
        self.free[number] = free
        stack = self.by_free.setdefault(free, [])
        if not stack:
            self.mask |= 1 << free
        stack.append(number)

    def add(self, piece: int) -> None:
        size = self.sizes[piece]
        room = self.mask >> size
        if not room:
            self._put(len(self.bins), self.capacity - size, [piece])
            return
        free = size + (room & -room).bit_length() - 1
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.mask &= ~(1 << free)
        self.bins[number].append(piece)
        self._put(number, free - size)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.bins), sum([(self.capacity - f) ** 2 for f in self.free])


def crossed(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """a with some of b's best filled bins."""
    ranked = sorted(range(len(b.bins)), key=b.free.__getitem__)
    good = ranked[: max(1, len(ranked) // 2)]
    injected = [b.bins[i] for i in rng.sample(good, max(1, len(good) // 2))]
    taken = {i for x in injected for i in x}
    kept, displaced = [list(x) for x in injected], []
    for x in a.bins:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    child = Packing(a.sizes, a.capacity, kept)
    for i in sorted(displaced, key=a.sizes.__getitem__, reverse=True):
        child.add(i)
    return child


def mutated(p: Packing, rng: random.Random) -> Packing:
    """p after its emptiest bins and some others are dissolved and their pieces put back in any order."""
    n = len(p.bins)
    some = max(1, n // 20)
    gone = {*sorted(range(n), key=p.free.__getitem__, reverse=True)[:some], *rng.sample(range(n), min(n, some + rng.randrange(3)))}
    child = Packing(p.sizes, p.capacity, [list(x) for i, x in enumerate(p.bins) if i not in gone])
    loose = [i for k in sorted(gone) for i in p.bins[k]]
    rng.shuffle(loose)
    for i in loose:
        child.add(i)
    return child


def decreasing(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> Packing:
    p = Packing(sizes, capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random())):
        p.add(i)
    return p


def evolved(sizes: list[int], capacity: int, seed: str, given: list[list[list[int]]] = (), population: int = POPULATION, births: int = BIRTHS) -> Packing:  # type: ignore[assignment]
    """The best packing after some crossovers, starting from the given bins and best-fit decreasing. It stops at the least possible count."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    pool = [Packing(sizes, capacity, [list(x) for x in bins]) for bins in given]
    while len(pool) < population:
        pool.append(decreasing(sizes, capacity, rng, 0.0 if not pool else 0.3 * rng.random()))
        if len(pool[-1].bins) <= least:
            return pool[-1]
    for _ in range(births):
        pool.sort(key=Packing.fitness, reverse=True)
        if len(pool[0].bins) <= least:
            break
        a, b = rng.sample(range(min(population, len(pool))), 2)
        child = crossed(pool[a], pool[b], rng)
        pool.append(mutated(child, rng) if rng.random() < 0.5 else child)
        pool = sorted(pool, key=Packing.fitness, reverse=True)[:population]
    return max(pool, key=Packing.fitness)


def _bins_of(places: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(places.max()) + 1)]
    for i, b in enumerate(places.tolist()):
        out[b].append(i)
    return out


STATE = "block long, island int, sizes binary, elite binary, bins int"


def _epoch(states: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One row for each island with its own elite and, but in the first epoch, the one that migrated to it (`guest`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                sizes = np.frombuffer(r.sizes, "<u2").tolist()
                given = [_bins_of(np.frombuffer(x, "<u4")) for x in (r.elite, r.guest) if x]
                best = evolved(sizes, capacity, f"{r.block} {r.island} {epoch}", given)
                places = np.empty(len(sizes), "<u4")
                for k, b in enumerate(best.bins):
                    places[b] = k
                out.append((r.block, r.island, r.sizes, places.tobytes(), len(best.bins)))
            yield pd.DataFrame(out, columns=["block", "island", "sizes", "elite", "bins"])

    return states.select("block", "island", "sizes", "elite", "guest").repartition("block", "island").mapInPandas(run, STATE)


def packed_round(items: DataFrame, blocks: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """items: (row, piece, length). (row, piece, length, block, bin, offset, fill)"""
    dealt = items.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)).alias("block"))
    # one array for each block: about BLOCK pieces, longest first
    grouped = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("m"), "row", "piece"))).alias("items"))
    grouped = staged(grouped, "blocks")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [(-np.array(x.as_py(), np.int64)).astype("<u2").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arrays, pa.binary())], names=["block", "sizes"])

    nothing = F.lit(None).cast("binary")
    states = grouped.select("block", F.col("items.m")).mapInArrow(sizes, "block long, sizes binary")
    states = states.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "sizes", nothing.alias("elite"), nothing.alias("guest"))
    states = staged(_epoch(states, capacity, 0), "islands")
    for epoch in range(1, epochs):
        guests = states.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
        states = staged(_epoch(states.join(guests, ["block", "island"]), capacity, epoch), "islands")
    best = states.groupBy("block").agg(F.min_by("elite", F.struct("bins", "island")).alias("elite"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.frombuffer(x.as_py(), "<u4").astype(np.int64).tolist() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins, pa.list_(pa.int64()))], names=["block", "items", "bins"])

    item = "array<struct<m:long,row:long,piece:int>>"
    rows = grouped.join(best, "block").select("block", "items", "elite").mapInArrow(places, f"block long, items {item}, bins array<long>")
    rows = rows.select("block", F.explode(F.arrays_zip("items", "bins")).alias("x")).select("block", F.col("x.items.row").alias("row"), F.col("x.items.piece").alias("piece"), (-F.col("x.items.m")).alias("length"), F.col("x.bins").alias("bin"))
    # a bin has at most `capacity` pieces
    bins = rows.groupBy("block", "bin").agg(F.sort_array(F.collect_list(F.struct("row", "piece", "length"))).alias("in"), F.sum("length").alias("fill"))
    before = F.transform(F.sequence(F.lit(1), F.size("in")), lambda k: F.aggregate(F.slice("in", 1, k - 1), F.lit(0).cast("long"), lambda a, x: a + x["length"]))
    bins = bins.select("block", "bin", "fill", F.explode(F.arrays_zip("in", before.alias("offset"))).alias("x"))
    return bins.select(F.col("x.in.row").alias("row"), F.col("x.in.piece").alias("piece"), F.col("x.in.length").alias("length"), "block", "bin", F.col("x.offset").alias("offset"), "fill")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, rounds: int = ROUNDS, closed: float = CLOSED) -> DataFrame:
    """pieces: (row, piece, length). (row, piece, sequence_id, offset)"""
    full = F.col("length") == capacity
    # sequence numbers: below 0 for full pieces, else by round, block and bin
    out = pieces.where(full).select("row", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.where(~full).select("row", "piece", "length")
    count = left.count()
    for k in range(rounds):
        if not count:
            break
        blocks = -(-count // block)
        made = staged(packed_round(left, blocks, capacity, islands, epochs), "bins")
        last = k == rounds - 1 or blocks == 1
        done = F.lit(True) if last else F.col("fill") >= closed * capacity
        out = out.unionAll(made.where(done).select("row", "piece", (F.lit(k << 58) + F.col("block") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset"))
        left = made.where(~done).select("row", "piece", "length")
        count = 0 if last else left.count()
    return out


def packed_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row."""
    pieces = staged(token_pieces(docs, vocabulary), "pieces")
    placed = pack(pieces)
    return pieces.join(placed, ["row", "piece"]).select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@in_small_batches
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


@in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
