"""Operator 8, removal of repeated passages by sorting suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller document, or in the same one further left.

Each LENGTH-byte window has one anchor: its least GRAM-byte hash, leftmost of equals. It depends on the window's bytes alone, so
equal windows have equal anchors, and neighbouring windows mostly share one: a run. The steps:

1. Runs are counted by anchor in a sketch of fixed size. Anchors in places that hold far more than others count as frequent.
2. Each run sends a record (anchor hash, content hash, document, first window, number of windows), without bytes, to the task of its
   anchor; records of frequent anchors are dealt by content too. In that order all but the earliest record of a content are
   repeated, whatever their anchor's number of records. Contents that a task meets often are settled before they are sent.
3. Only the earliest records of anchors with several contents need a comparison. Their documents are read once more for their
   bytes. In each task the windows' suffixes are ordered, deep-shallow: a multikey sort, eight bytes a step, to SHALLOW bytes, which
   drops all suffixes that stand alone, then blind tries order the groups of equal SHALLOW-byte heads to LENGTH bytes. Neighbours
   with LENGTH equal bytes are one string; all but its earliest place are repeated. An anchor with over CROWD contents sends a
   record for each window instead, dealt by the window's hash as in step 2, so that a passage in very many contexts spreads over tasks.
4. Repeated ranges are gathered by document and cut from the text.

Every step works on sorted or bounded runs of records, so memory doesn't follow the size of a key. Step 2 takes contents with two
equal 64-bit hashes, made from different tables, as equal: of n records of one anchor, two different contents meet with odds of
n^2 / 2^65 (for a million, 3 in 10^8), and windows of crowded anchors are told apart by both hashes. Step 3 compares bytes.

Null texts are empty. Rows with one doc_id and text are one document; rows with one doc_id and different texts are documents of their
own in the order of a hash of their text. Rows without a doc_id come last, each a document of its own. Texts are whole bytes;
text_kept may split a character, so it is binary. Long texts are read in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.arrays import SECOND, gathered, hash_bitmap, in_small_batches, numbered, pieces, prefix_hash, span_hash, staged, vector_rows, vector_sum

LENGTH, GRAM, SHALLOW, CROWD = 100, 20, 32, 8192
#: Bytes of text, and windows of records, that are worked on at once: these bound a task's memory.
PIECE, WINDOWS = 1 << 18, 200_000
#: Places of the sketch of anchors; a place is frequent from FREQUENT records on, if it has eight times the mean.
PLACES, FREQUENT = 20, 32_768
#: Records dealt to a task.
DEALT = 400_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first window, number of windows, prefix hashes): runs of neighbouring windows of a row with the same anchor place."""
    n = len(data)
    prefix = prefix_hash(data)
    if n < length:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, prefix)
    grams = np.arange(n - gram + 1)
    hashes = span_hash(prefix, grams, grams + gram)
    low = np.uint64(0xFFFFFFFF)  # half of the hash orders grams, the place breaks ties: both depend on the window alone
    keyed = (hashes & ~low) | grams.astype(np.uint64)
    # least of each run of `wide` keys: minima from block starts and to block ends
    wide = length - gram + 1
    pad = -len(keyed) % wide
    blocks = np.concatenate([keyed, np.full(pad, ~np.uint64(0))]).reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows])
    place = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[:windows]
    inside = np.arange(windows) + length <= offsets[row + 1]
    cut = np.empty(windows, bool)
    cut[0] = True
    cut[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(cut & inside)
    # windows that cross a row's end stand at the end of the row's runs
    fit = np.concatenate([[0], np.cumsum(inside)])
    end = np.append(np.flatnonzero(cut), windows)
    stop = end[np.searchsorted(end, first, side="right")]
    return hashes[place[first]], row[first], first, fit[stop] - fit[first], prefix


class BlindTrie:
    """A trie of distinct byte strings of one length that keeps only where strings part, not the skipped bytes."""

    __slots__ = ("root", "strings")

    def __init__(self, first: bytes):
        self.strings = [first]
        self.root: list | int = 0  # a leaf is the number of a string; a node is [depth, {byte: child}]

    def add(self, s: bytes) -> None:
        node = self.root
        while not isinstance(node, int):  # blind: bytes between branches aren't looked at
            node = node[1].get(s[node[0]], next(iter(node[1].values())))
        other = self.strings[node]
        differ = int.from_bytes(s) ^ int.from_bytes(other)
        if not differ:
            return
        depth = len(s) - (differ.bit_length() + 7) // 8
        number = len(self.strings)
        self.strings.append(s)
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = number
            return
        new = [depth, {s[depth]: number, other[depth]: node}]
        if above is None:
            self.root = new
        else:
            above[1][s[above[0]]] = new

    def ordered(self) -> list[bytes]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(self.strings[node])
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte leading."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    return out


def repeated_suffixes(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of starts in suffix order, class of each) of the suffixes whose first `length` bytes aren't alone; equal classes are equal strings.

    data must have `length` bytes from every start on.
    """
    words = _words(data)
    alive, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, shallow, 8):
        if not len(alive):
            break
        key = words[starts[alive] + depth]
        order = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
        alive, key, group = alive[order], key[order], group[order]
        new = np.ones(len(alive), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        alive, group = alive[several], group[several]
    if not len(alive):
        return alive, group
    # deep: equal strings of a group become one, found by hash and then compared; tries order those that differ
    raw = data.tobytes()
    prefix = prefix_hash(data)
    at = starts[alive]
    rest = span_hash(prefix, at + shallow, at + length)
    for _ in range(2):
        order = np.lexsort((rest, group))
        alive, group, rest = alive[order], group[order], rest[order]
        new = np.ones(len(alive), bool)
        new[1:] = (rest[1:] != rest[:-1]) | (group[1:] != group[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(alive)), 0))
        at, lead = starts[alive], starts[alive[head]]
        same = np.ones(len(alive), bool)
        for depth in (*range(shallow, length - 8, 8), length - 8):
            same &= words[at + depth] == words[lead + depth]
        if same.all():
            break
        # two strings with one hash: number the strings themselves
        numbers: dict[bytes, int] = {}
        rest = np.array([numbers.setdefault(raw[a + shallow : a + length], len(numbers)) for a in at.tolist()])
    kinds = np.flatnonzero(new)
    of_group = group[kinds]
    edge = np.flatnonzero(np.diff(of_group, prepend=-1, append=-1))
    rank = np.arange(len(kinds))
    sizes = np.diff(edge)
    for a, b in zip(edge[:-1][sizes > 1].tolist(), edge[1:][sizes > 1].tolist(), strict=True):
        strings = [raw[s + shallow : s + length] for s in starts[alive[kinds[a:b]]].tolist()]
        trie = BlindTrie(strings[0])
        for s in strings[1:]:
            trie.add(s)
        position = {s: k for k, s in enumerate(trie.ordered())}
        rank[a:b] = [a + position[s] for s in strings]
    kind = rank[np.cumsum(new) - 1]
    order = np.argsort(kind, kind="stable")
    alive, kind = alive[order], kind[order]
    several = np.bincount(kind)[kind] > 1
    return alive[several], kind[several]


def _settle(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Flags of the rows that aren't the earliest of their key."""
    order = np.lexsort((start, doc, key))
    k, d, s = key[order], doc[order], start[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    late = np.zeros(len(k), bool)
    late[order] = (d > d[head]) | (s > s[head])
    return late


def _ranges(doc: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int) -> pa.RecordBatch:
    """The bytes of these windows; neighbouring and overlapping ones of a document together."""
    order = np.lexsort((start, doc))
    doc, start, windows = doc[order], start[order], windows[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + windows[:-1])
    head = np.flatnonzero(new)
    end = np.maximum.reduceat(start + windows, head) if len(head) else start[:0]
    return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(start[head]), pa.array(end - 1 + length)], names=["doc", "low", "high"])


RECORDS = "place long, k long, c long, doc long, start long, windows int"
RANGES = "doc long, low long, high long"
NAMES = [f.split()[0] for f in RECORDS.split(", ")]


class Frequent:
    """Contents that a task has met several times, with their earliest place so far. It is bounded: what it forgets is settled later."""

    def __init__(self, most: int = 1 << 16):
        self.most = most
        self.k, self.c = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.doc, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def late(self, k: np.ndarray, c: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Flags of the records whose content has an earlier place among these or those before."""
        old = len(self.k)
        k, c, doc, start = (np.concatenate(x) for x in ((self.k, k), (self.c, c), (self.doc, doc), (self.start, start)))
        order = np.lexsort((start, doc, c, k))
        ks, cs, ds, ss = k[order], c[order], doc[order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = (ks[1:] != ks[:-1]) | (cs[1:] != cs[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        late = np.zeros(len(order), bool)
        late[order] = (ds > ds[head]) | (ss > ss[head])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        known = np.maximum.reduceat(order < old, first) if len(first) else first.astype(bool)
        keep = first[(size > 1) | known]
        if len(keep) > self.most:
            keep = first[size > 1][: self.most]
        self.k, self.c, self.doc, self.start = ks[keep], cs[keep], ds[keep], ss[keep]
        return late[old:]


def _parts(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, bytes of the row before these) of pieces of a column; a long row's pieces overlap by length - 1 bytes."""
    for low, _, data, offsets in pieces(column, PIECE):
        if len(data) <= PIECE + length:
            yield low, data, offsets, 0
        else:
            for at in range(0, len(data) - length + 1, PIECE):
                part = data[at : at + PIECE + length - 1]
                yield low, part, np.array([0, len(part)]), at


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[tuple[np.ndarray, ...], pa.RecordBatch]]:
    """(k, c, doc, start, windows) of the runs of (doc, text) rows, and the ranges of those settled here."""
    frequent = Frequent()
    for batch in batches:
        docs = batch.column(0).to_numpy()
        for low, data, offsets, before in _parts(batch.column(1), length):
            k, row, first, count, _ = anchors(data, offsets, length)
            c = span_hash(prefix_hash(data, SECOND), first, first + count - 1 + length)
            doc, start = docs[low + row], first - offsets[row] + before
            late = frequent.late(k, c, doc, start)
            yield tuple(x[~late] for x in (k, c, doc, start, count)), _ranges(doc[late], start[late], count[late], length)


def _many(rows: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """Packed flags of the sketch's places with frequent anchors, and the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PLACES, np.int64)
        for (k, *_), _ in _runs(batches, length):
            np.add.at(total, (k >> np.uint64(64 - PLACES)).astype(np.int64), 1)
        yield vector_rows("runs", total, TaskContext.get().partitionId())

    counts = gathered(vector_sum(rows.mapInArrow(run, "name string, block int, part int, payload binary")), 1 << PLACES)
    counts = counts.get("runs", np.zeros(1 << PLACES, np.int64))
    return np.packbits(counts >= max(FREQUENT, 8 * counts.mean())), int(counts.sum())


def _records(rows: DataFrame, many, length: int) -> DataFrame:
    """A record for each run, and those settled already: their k is null, their bytes are start..start + windows - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, c, doc, start, count), done in _runs(batches, length):
            at = (k >> np.uint64(64 - PLACES)).astype(np.int64)
            flagged = (many.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            place = np.where(flagged, k ^ c, k)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (place, k, c)), pa.array(doc), pa.array(start), pa.array(count.astype(np.int32))], names=NAMES)
            if len(done):
                d, low, high = (done.column(i).to_numpy() for i in range(3))
                spread = (d * 31 + low) * 0x9E3779B97F4A7C1  # they only pass through: any place will do
                none = pa.nulls(len(d), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(spread), none, none, pa.array(d), pa.array(low), pa.array((high - low).astype(np.int32))], names=NAMES)

    return rows.mapInArrow(run, RECORDS)


def _settled(records: DataFrame, parts: int, many, length: int) -> DataFrame:
    """(k, doc, start, windows, open): repeated windows, or if open the earliest records of contents of anchors with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

        def out(k, doc, start, windows, is_open) -> pa.RecordBatch:
            arrays = (k.astype(np.int64), doc, start, windows.astype(np.int32), np.full(len(k), is_open))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, kind, strict=True)], names=["k", "doc", "start", "windows", "open"])

        held, held_open = None, False  # the last content's first record, and whether it has been told already
        for batch in batches:
            settled = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            if settled.any():  # these come first: null keys
                done = batch.filter(pa.array(settled))
                doc, start, size = (done.column(i).to_numpy() for i in (3, 4, 5))
                yield out(np.zeros(len(doc)), doc, start, size - length + 1, False)
                batch = batch.filter(pa.array(~settled))
            if not len(batch):
                continue
            k, c, doc, start, windows = (batch.column(i).to_numpy() for i in range(1, 6))
            told = np.zeros(len(k), bool)
            if held is not None:
                k, c, doc, start, windows = (np.concatenate([[a], b]) for a, b in zip(held, (k, c, doc, start, windows), strict=True))
                told = np.concatenate([[held_open], told])
            new_key = np.ones(len(k), bool)
            new_key[1:] = k[1:] != k[:-1]
            new = new_key.copy()
            new[1:] |= c[1:] != c[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            late = (doc > doc[head]) | (start > start[head])
            yield out(np.zeros(late.sum()), doc[late], start[late], windows[late], False)
            number = np.cumsum(new_key) - 1
            several = np.bincount(number, new) > 1
            at = (k.view(np.uint64) >> np.uint64(64 - PLACES)).astype(np.int64)
            several = several[number] | told[np.flatnonzero(new_key)][number] | ((many.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0)
            lead = np.flatnonzero(new & several & ~told)
            yield out(k[lead], doc[lead], start[lead], windows[lead], True)
            last = head[-1]
            held, held_open = [x[last] for x in (k, c, doc, start, windows)], bool(several[-1])

    dealt = records.repartition(parts, "place").sortWithinPartitions(F.col("k").asc_nulls_first(), "c", "doc", "start")
    return dealt.mapInArrow(run, "k long, doc long, start long, windows int, open boolean")


def _asked(rows: DataFrame, leads: DataFrame, length: int) -> DataFrame:
    """(place, k, c, doc, start, windows, bytes): the bytes of leads, or for crowded anchors a record for each window, without bytes."""
    crowded = leads.groupBy("k").agg(F.count("*").alias("c")).where(F.col("c") > CROWD)
    # beside crowded anchors it may have a few others, for which either way gives the same
    apart = leads.sparkSession.sparkContext.broadcast(hash_bitmap(crowded.select("k"), 24))
    wanted = leads.groupBy("doc").agg(F.collect_list(F.struct("k", "start", "windows")).alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*NAMES, "bytes"]
        for batch in batches:
            asks = batch.column(2)
            ends, flat = asks.offsets.to_numpy(), asks.values
            k, start, windows = (flat.field(i).to_numpy() for i in range(3))
            crowd = apart.value.has(k.view(np.uint64))
            for i, text in enumerate(batch.column(1)):
                raw, doc = text.as_buffer(), batch.column(0)[i].as_py()
                data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
                mine = np.arange(ends[i], ends[i + 1])
                for z in np.split(mine[~crowd[mine]], range(20_000, len(mine), 20_000)):
                    parts = [data[a : a + n + length - 1].tobytes() for a, n in zip(start[z].tolist(), windows[z].tolist(), strict=True)]
                    if len(z):
                        yield pa.RecordBatch.from_arrays([pa.array(k[z]), pa.array(k[z]), pa.nulls(len(z), pa.int64()), pa.array(np.full(len(z), doc)), pa.array(start[z]), pa.array(windows[z]), pa.array(parts, pa.binary())], names=names)
                for z in mine[crowd[mine]].tolist():
                    own = data[start[z] : start[z] + windows[z] + length - 1]
                    n = np.arange(windows[z])
                    one, two = (span_hash(prefix_hash(own, *table), n, n + length).view(np.int64) for table in ((), (SECOND,)))
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(one), pa.array(two), pa.array(np.full(len(n), doc)), pa.array(start[z] + n), pa.array(np.ones(len(n), np.int32)), pa.nulls(len(n), pa.binary())], names=names)

    return rows.join(wanted, "doc").select("doc", F.col("text").cast("binary"), "asks").mapInArrow(run, RECORDS + ", bytes binary")


def _compared(k: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray, texts: list[bytes], length: int) -> pa.RecordBatch:
    """The repeated windows of some whole anchors' records."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(size) - size
    n = windows.astype(np.int64)
    owner = np.repeat(np.arange(len(k)), n)
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    alive, kind = repeated_suffixes(data, base[owner] + shift, length)
    again = alive[_settle(kind.astype(np.uint64), doc[owner[alive]], start[owner[alive]] + shift[alive])]
    return _ranges(doc[owner[again]], start[owner[again]] + shift[again], np.ones(len(again), np.int64), length)


def _repeats(asked: DataFrame, parts: int, length: int) -> DataFrame:
    """The ranges of repeated windows of _asked's records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        windows, last, first = 0, None, None
        for batch in batches:
            single = batch.column(6).is_null().to_numpy(zero_copy_only=False)
            if single.any():  # windows of crowded anchors, by both hashes; equal ones follow one another, the earliest first
                one = batch.filter(pa.array(single))
                k, c, doc, start = (one.column(i).to_numpy() for i in range(1, 5))
                if first is not None:
                    k, c, doc, start = (np.concatenate([[a], b]) for a, b in zip(first, (k, c, doc, start), strict=True))
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
                late = (doc > doc[head]) | (start > start[head])
                yield _ranges(doc[late], start[late], np.ones(late.sum(), np.int64), length)
                first = [x[head[-1]] for x in (k, c, doc, start)]
                batch = batch.filter(pa.array(~single))
            if not len(batch):
                continue
            k, doc, start, n = (batch.column(i).to_numpy() for i in (1, 3, 4, 5))
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            values = batch.column(6).to_pylist()
            for a, b in zip(edge, np.append(edge[1:], len(k)), strict=True):
                if windows >= WINDOWS and k[a] != last:
                    yield _compared(*map(np.concatenate, zip(*held, strict=True)), texts, length)
                    held, texts, windows = [], [], 0
                held.append((k[a:b], doc[a:b], start[a:b], n[a:b]))
                texts += values[a:b]
                windows, last = windows + int(n[a:b].sum()), k[a]
        if held:
            yield _compared(*map(np.concatenate, zip(*held, strict=True)), texts, length)

    return asked.repartition(parts, "place").sortWithinPartitions("k", "c", "doc", "start").mapInArrow(run, RANGES)


def repeated_ranges(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """rows: (doc, text), one row for each doc. (doc, low, high): ranges of bytes to remove; they may overlap."""
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flags, records = _many(rows, length)
    many = spark.sparkContext.broadcast(flags)
    settled = staged(_settled(_records(rows, many, length), max(least, records // DEALT), many, length), "settled")
    leads = settled.where("open").drop("open")
    done = settled.where("not open").select("doc", F.col("start").alias("low"), (F.col("start") + F.col("windows") - 1 + length).alias("high"))
    found = _repeats(_asked(rows, leads, length), max(least, 2 * leads.count() // DEALT), length)
    return done.unionAll(staged(found, "ranges"))


def _union(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with text_kept (binary, the bytes that stay) and removed (array of (low, high), maximal ranges) in place of columns of these names."""
    keep = [c for c in docs.columns if c not in ("text_kept", "removed")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["text_kept binary", "removed array<struct<low:long,high:long>>"])
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs, single = numbered(docs.select(*keep), key, text, "_row")
    rows = docs.select(F.col("_row").alias("doc"), whole.alias("text"))
    if not single:  # of equal rows with a key the first stands for all
        same = F.col(key).cast("long").alias("_key"), F.xxhash64(whole).alias("_sig")
        first = docs.where(F.col(key).isNotNull()).select(*same, "_row").groupBy("_key", "_sig").agg(F.min("_row").alias("_first"))
        docs = docs.select("*", *same).join(first, ["_key", "_sig"], "left").withColumn("_row", F.coalesce("_first", "_row")).select(*keep, "_row")
        rows = rows.join(first.select(F.col("_first").alias("doc")), "doc", "left_semi").unionAll(docs.where(F.col(key).isNull()).select("_row", whole))
    found = repeated_ranges(rows, length).groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("_ranges"))
    joined = docs.join(found, docs["_row"] == found["doc"], "left").select(*(docs[c] for c in keep), "_ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), 512):
                batch = whole_batch.slice(at, 512)
                kept, removed = [], []
                for value, ranges in zip(batch.column(batch.schema.get_field_index(text)), batch.column(len(keep)).to_pylist(), strict=True):
                    raw = (value.as_py() or "").encode()
                    spans = _union(ranges)
                    edges = [0, *(x for s in spans for x in s), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    removed.append([{"low": a, "high": b} for a, b in spans])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], names=[*keep, "text_kept", "removed"])

    return joined.mapInArrow(cut, schema)


@in_small_batches
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["high"] - r["low"])
    return out.select("doc_id", (F.length("text_kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("text_kept", 256).alias("kept_sha256"))


@in_small_batches
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated passages; n_chars follows. A character of which a part was removed goes with it; a document of which nothing is left has an empty text."""
    out = without_repeats(docs)
    text = F.expr("try_validate_utf8(cast(text_kept as string))")
    valid = F.coalesce(text, F.expr("decode(encode(replace(make_valid_utf8(cast(text_kept as string)), '\uFFFD', ''), 'UTF-8'), 'UTF-8')"))
    new = F.when(F.size("removed") > 0, valid).otherwise(F.col("text"))
    return out.withColumn("text", new).withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)
