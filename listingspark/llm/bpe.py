"""Operator 10, BPE encoding and decoding by a contiguous rank array.

A pre-token's bytes start as one part each. An array holds the parts, a second one the rank of every adjacent pair; the least
rank (leftmost of equals) is merged by deleting a boundary and refreshing the two neighbouring ranks, until no pair has a rank.
The scan is short because words are; pre-tokens of over LONG bytes go through a heap of (rank, place) instead, which merges in
the same order. Recent pre-tokens are kept with their ids, at most CACHE of them.

The vocabulary file is read once, on the driver, from a path that is a parameter, and broadcast (a fixed few megabytes).
A null text is empty and has no ids. Special tokens found in a text become their ids, as the tokenizers library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.arrays import in_small_batches

LONG, CACHE, CACHED_CHARS = 128, 200_000, 48
#: White space and the pre-token pattern of the byte-level vocabulary.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}


class RankArrayBPE:
    """Byte-level BPE of one vocabulary file."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        chars, vocab = printable_bytes(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.single = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.words = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def word(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if len(data) > LONG:
            return self._heap(data)
        none = len(self.rank)
        parts = [self.single[b] for b in data]
        get = self.rank.get
        pairs = [get(p, (none, 0)) for p in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low[0] == none:
                break
            i = pairs.index(low)
            parts[i] = low[1]
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get((parts[i], parts[i + 1]), (none, 0))
            if i:
                pairs[i - 1] = get((parts[i - 1], parts[i]), (none, 0))
        return parts

    def _heap(self, data: bytes) -> list[int]:
        parts, n = [self.single[b] for b in data], len(data)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r[0], i, parts[i], parts[i + 1], r[1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := self.rank.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (r[0], x, parts[x], parts[y], r[1]))
        return [p for p in parts if p >= 0]

    def _missing(self, word: str) -> bytes:
        ids = np.array(self.word(word.encode()), "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        get, missing = self.cache.get, self._missing
        return b"".join([get(w) or missing(w) for w in self.words(text)])

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        out = [np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self.cut.split(text) if p]
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters."""
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(source: bytes) -> RankArrayBPE:
    return RankArrayBPE(source)


def bpe_codes(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): ids of each text as a binary column of little-endian unsigned 32-bit integers, and the text they decode to.

    One narrow pass without a shuffle.
    """
    with open(vocabulary, "rb") as file:
        source = df.sparkSession.sparkContext.broadcast(file.read())
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(source.value)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids = [bpe.encode(x.as_py() or "") for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], names=[key, "ids", "decoded"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {key_type}, ids binary, decoded string")


@in_small_batches
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codes = bpe_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return codes.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.tobytes()).hexdigest()
