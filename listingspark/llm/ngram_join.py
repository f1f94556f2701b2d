"""Operator 3, exact n-gram Jaccard join by a token-group matrix.

Texts become sets of word shingles (64-bit hashes). Two documents link when inter / union >= NUM / DEN. The steps:

1. Every shingle is counted in a fixed-size sketch over all texts. Shingles in heavy places come last in one order of all
   shingles, so that a document's first shingles are rare ones. Any order gives the same result; this one gives few candidates.
2. A set of size s keeps the prefix of s - ceil(s NUM / DEN) + l shingles, l = 1 + s // 32: linked sets share at least l prefix
   shingles of the smaller l. Equal sets become one vertex. Sets with fewer than l shingles that another prefix has too link with
   nothing. For the others the order is refined twice: shingles found in several prefixes move behind all others, which pushes
   passages that unlike documents share out of the prefixes.
3. Groups: sets with the same most frequent shared shingle, dealt by hash into groups of about GROUP. Inside a group, sets are compared unless
   joined already; the least document of the shingle, a member of each of its groups, ties these together. Then sets are compared
   with a few pivots of each of their shingles that lie in other components (stars, not all pairs), twice. Before each of these
   passes and before step 4, shingles whose sets all lie in one component go, and sets left with too few shingles to link.
4. Token-group matrix: the union of the prefix shingles of all groups with one most frequent shingle as rows (shingle, that one), with
   sizes. A query set meets these on its prefix shingles; the number met bounds its overlap with every member, and only where at
   least l are met (and sizes can fit) are the groups opened, one by one: their members of later components are compared. A family
   of very many groups so costs a query a row for each shingle it meets, not for each of its groups.
5. Links between components are joined by alternating large-star and small-star steps.

Wherever sets are to be compared, their signatures meet first: flags of the places that a set's hashes have, two to four places a
shingle. What one signature has and another lacks bounds the overlap from above, so only pairs that can link are left, and only the sets
of these travel: they are told by a bitmap where they are read.

Hot keys: equal sets and near copies are contracted before step 4, and shingles whose sets all lie in one component are dropped,
so a group of thousands of copies makes thousands of rows, not their square. No cap is set anywhere: bounds only skip sets that can't link.

Python steps follow one another only across written tables, so that a task needs one worker; a bitmap is destroyed when the last
table made with it is written.

Null, empty and wordless texts have an empty set and link with nothing. Texts with fewer words than n are one shingle. Rows that
share a doc_id are one document, linked as any of them is; each has the set size of its own text. Where keys repeat or are null, rows
are numbered first and each distinct set is compared once, however many rows have it. A row without a doc_id is a document of its
own and has the least doc_id that it reaches, or null.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.arrays import bitmap_bits, gathered, hash_bitmap, id_bitmap, in_small_batches, mix, numbered, pieces, rows_of, shingle_sets, staged, vector_rows, vector_sum

SKETCH_BITS, HEAVY, GROUP, REFINEMENTS, STARS, PIVOTS = 22, 64, 128, 2, 2, 6


def least_overlap(size: int, num: int, den: int) -> int:
    return -(-size * num // den)


def slack(size):
    return 1 + size // 32


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if den * small < num * large:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * shared >= num * (small + large - shared)


def signature(s: np.ndarray) -> bytes:
    """Packed flags of the places that the hashes of a set have."""
    bits = max(6, (2 * len(s) - 1).bit_length())
    flags = np.zeros(1 << bits, bool)
    flags[(s >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def folded(sign: np.ndarray, width: int) -> np.ndarray:
    """A signature of fewer places: `width` bytes."""
    while len(sign) > width:
        sign = np.packbits(np.unpackbits(sign).reshape(-1, 2).any(axis=1))
    return sign


def may_link(size: int, sign: np.ndarray, sizes: np.ndarray, signs: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether a set can link with others, by their sizes and signatures (rows) of one width: False only where it can't."""
    shared = np.minimum(size - np.bitwise_count(sign & ~signs).sum(-1, dtype=np.int64), sizes - np.bitwise_count(signs & ~sign).sum(-1, dtype=np.int64))
    return den * shared >= num * (size + sizes - shared)


def _partners(sizes: np.ndarray, column: pa.ChunkedArray, asks: np.ndarray, members: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For the row numbers `asks`, the rows among `members` with which a link isn't ruled out: (row, rows), a few times for a row."""
    signs = [np.frombuffer(v.as_py(), np.uint8) for v in column]
    widths = np.array([len(s) for s in signs], np.int64)
    for width in np.unique(widths).tolist():
        rows = members[widths[members] >= width]
        if not len(rows):
            continue
        table = np.stack([folded(signs[r], width) for r in rows])
        short = widths[rows] == width
        parts = {True: (rows, table), False: (rows[short], table[short])}
        for i in asks[widths[asks] >= width].tolist():
            rest, flags = parts[bool(widths[i] == width)]
            yield i, rest[may_link(sizes[i], folded(signs[i], width), sizes[rest], flags, num, den)]


def _heavy(rows: DataFrame, n: int) -> np.ndarray:
    """Packed flags of the sketch's places that hold many shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            total[:] += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            held.clear()

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                held += shingle_sets(data, offsets, n)
                if sum(map(len, held)) > 1_000_000:
                    add()
        if held:
            add()
        yield vector_rows("n", total, TaskContext.get().partitionId())

    counts = gathered(vector_sum(rows.select("text").mapInArrow(run, "name string, block int, part int, payload binary")), 1 << SKETCH_BITS)
    counts = counts.get("n", np.zeros(1 << SKETCH_BITS, np.int64))
    return np.packbits(counts >= max(HEAVY, 4 * counts.mean()))


def _profiles(rows: DataFrame, n: int, num: int, den: int, heavy) -> DataFrame:
    """(doc, n, sig_a, sig_b, mark, prefix); mark is the hash by which bitmaps know the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = heavy.value
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column(1)):
                sets = shingle_sets(data, offsets, n)
                sizes = np.array([len(s) for s in sets], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                at = (flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                late = (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                have = sizes > 0
                sums = [np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)]
                if len(flat):
                    for k in range(2):
                        sums[k][have] = np.add.reduceat(mix(flat + np.uint64(k + 1)), bounds[:-1][have])
                prefixes = []
                for s, a, b in zip(sets, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    size = b - a
                    take = min(size, size - least_overlap(size, num, den) + slack(size))
                    rare = s[~late[a:b]][:take]
                    if len(rare) < take:
                        rare = np.concatenate([rare, s[late[a:b]][: take - len(rare)]])
                    prefixes.append(rare)
                ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                values = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(sizes.astype(np.int32)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), _marks(batch.column(0)[low:high]), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))],
                    names=["doc", "n", "sig_a", "sig_b", "mark", "prefix"],
                )

    return rows.mapInArrow(run, "doc long, n int, sig_a long, sig_b long, mark long, prefix array<long>")


def _marks(docs: pa.Array) -> pa.Array:
    return pa.array(mix(docs.to_numpy().view(np.uint64)).view(np.int64))


def _of(profiles: DataFrame, wanted) -> DataFrame:
    """(prefix) of the documents in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(wanted.value.has(batch.column(0).to_numpy().view(np.uint64))))], names=["prefix"])

    return profiles.select("mark", "prefix").mapInArrow(run, "prefix array<long>")


def _shared(column: pa.ListArray, bitmap, least: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The rows with at least `least` tokens in the bitmap, and these tokens."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(np.uint64)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    hit = bitmap.has(flat)
    total = np.concatenate([[0], np.cumsum(hit)])
    rows = np.flatnonzero(total[ends[1:]] - total[ends[:-1]] >= least)
    return pa.array(rows), pa.array([flat[a:b][hit[a:b]].view(np.int64) for a, b in zip(ends[rows], ends[rows + 1], strict=True)], pa.list_(pa.int64()))


def _active(placed: DataFrame, comps: DataFrame, bits: int, num: int, den: int) -> DataFrame:
    """Placed sets and their comp, with the tokens that sets of several components have; only sets with enough of them to link with another component."""
    named = staged(placed.join(comps, "doc").select(*(c for c in placed.columns if c != "tokens"), "comp", "tokens"), "named")
    mixed = named.select("comp", F.explode("tokens").alias("k")).groupBy("k").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    mixed = named.sparkSession.sparkContext.broadcast(hash_bitmap(mixed.select("k"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the smaller of two sets that link may be smaller than this one by num / den
            some, tokens = _shared(batch.column("tokens"), mixed.value, slack(batch.column("n").to_numpy().astype(np.int64) * num // den))
            yield pa.RecordBatch.from_arrays([*(c.take(some) for c in batch.columns[:-1]), tokens], schema=batch.schema)

    active = staged(named.mapInArrow(run, named.schema), "active")
    mixed.destroy()
    return active


def _kept(profiles: DataFrame, shared, wanted=None) -> DataFrame:
    """Sets (of the documents in the bitmap `wanted`) with the prefix shingles that another set has too, where there are enough of them: (doc, n, mark, tokens)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.value.has(batch.column(3).to_numpy().view(np.uint64))))
            some, tokens = _shared(batch.column(2), shared.value, slack(batch.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), batch.column(3).take(some), tokens], names=["doc", "n", "mark", "tokens"])

    return profiles.select("doc", "n", "prefix", "mark").mapInArrow(run, "doc long, n int, mark long, tokens array<long>")


def _refined(sets: DataFrame, marks: list, num: int, den: int) -> DataFrame:
    """(doc, n, mark, prefix) with shingles ordered by the number of bitmaps that have them, then by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = []
            for value in batch.column(2):
                s = np.frombuffer(value.as_py(), np.uint64)
                level = sum(m.value.has(s).astype(np.int8) for m in marks)
                take = min(len(s), len(s) - least_overlap(len(s), num, den) + slack(len(s)))
                prefixes.append(s[np.argsort(level, kind="stable")[:take]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _marks(batch.column(0)), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc", "n", "mark", "prefix"])

    return sets.select("doc", "n", "set").mapInArrow(run, "doc long, n int, mark long, prefix array<long>")


def _repeated(prefixes: DataFrame) -> DataFrame:
    return prefixes.select(F.explode("prefix").alias("k")).groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")


def _sets(rows: DataFrame, n: int, wanted) -> DataFrame:
    """(doc, n, sign, set) of the documents in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = mix(batch.column(0).to_numpy().view(np.uint64))
            at = np.flatnonzero(wanted.value.has(ids))
            chosen = batch.take(pa.array(at))
            for low, high, data, offsets in pieces(chosen.column(1)):
                sets = shingle_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([chosen.column(0)[low:high], pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "n", "sign", "set"])

    return rows.mapInArrow(run, "doc long, n int, sign binary, set binary")


def _near(num: int, den: int):
    """The rows of a group that may link with another of its documents."""

    def run(table: pa.Table) -> pa.Table:
        docs, rows, keep = table["doc"].to_numpy(), np.arange(len(table)), np.zeros(len(table), bool)
        for i, others in _partners(table["n"].to_numpy().astype(np.int64), table["sign"], rows, rows, num, den):
            keep[i] |= bool((docs[others] != docs[i]).any())
            keep[others] |= docs[others] != docs[i]
        return table.select(["first", "chunk", "doc", "n"]).filter(pa.array(keep))

    return run


def _inside(num: int, den: int):
    """Components of one group's sets: (doc, comp), comp the least document."""

    def run(table: pa.Table) -> pa.Table:
        docs = table["doc"].to_numpy()
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        column = table["set"]
        sets = [np.frombuffer(column[i].as_py(), np.uint64) for i in order.tolist()]
        parent = list(range(len(docs)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(1, len(docs)):
            for j in range(i):
                a, b = root(i), root(j)
                if a != b and (docs[i] == docs[j] or linked(sets[i], sets[j], num, den)):
                    parent[max(a, b)] = min(a, b)
        return pa.table({"doc": docs, "comp": docs[[root(i) for i in range(len(docs))]]})

    return run


def _open(num: int, den: int):
    """The queries and members of a group that may link with a member of a later, a query of an earlier component."""

    def run(table: pa.Table) -> pa.Table:
        comps, asks, keep = table["comp"].to_numpy(), table["asks"].to_numpy(), np.zeros(len(table), bool)
        for i, others in _partners(table["n"].to_numpy().astype(np.int64), table["sign"], np.flatnonzero(asks), np.flatnonzero(~asks), num, den):
            later = others[comps[others] > comps[i]]
            keep[i] |= len(later) > 0
            keep[later] = True
        return table.select(["doc", "n", "comp", "g_first", "g_chunk", "asks"]).filter(pa.array(keep))

    return run


def _opened(num: int, den: int):
    """Links between components that an opened group's queries and members show: (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        found: set[tuple[int, int]] = set()
        rows = [(comp, np.frombuffer(data.as_py(), np.uint64)) for comp, data in zip(table["comp"].to_pylist(), table["set"], strict=True)]
        asks = table["asks"].to_pylist()
        members = sorted((r for r, a in zip(rows, asks, strict=True) if not a), key=lambda r: r[0])
        for comp, s in (r for r, a in zip(rows, asks, strict=True) if a):
            for other, m in members[bisect.bisect_right(members, comp, key=lambda r: r[0]) :]:
                if (comp, other) not in found and linked(s, m, num, den):
                    found.add((comp, other))
        pairs = sorted(found)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _dealt(queries: DataFrame, members: DataFrame, sets: DataFrame, column: str):
    """Queries (doc, n, comp, g_first, g_chunk) and members, likewise, of the groups that they open, with a column of sets; a group's queries are dealt into parts, of which each has all members."""
    keys = ["g_first", "g_chunk"]
    asked = queries.groupBy(*keys).agg(F.count("*").alias("q"))
    deals = F.ceil(F.col("q") / GROUP).cast("int")
    one, columns = sets.select("doc", "n", column), ["doc", "n", "comp", *keys, "deal", "asks", column]
    asking = queries.select("doc", "n", "comp", *keys, F.lit(True).alias("asks"))
    both = asking.unionAll(members.select("doc", "n", "comp", *keys, F.lit(False).alias("asks"))).join(asked, keys)
    to = F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("doc"), deals).cast("int"))).otherwise(F.sequence(F.lit(0), deals - 1))
    # sets are met once, before a member is dealt to all parts
    return both.withColumn("to", to).join(one, ["doc", "n"]).withColumn("deal", F.explode("to")).select(*columns).groupBy(*keys, "deal")


def _likely(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of documents whose signatures don't rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
                width = min(len(x), len(y))
                hit.append(bool(may_link(n, folded(x, width), m, folded(y, width), num, den)))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    one = sets.select("doc", "n", "sign")
    joined = pairs.join(one.withColumnsRenamed({"doc": "a", "n": "a_n", "sign": "x"}), "a").join(one.withColumnsRenamed({"doc": "b", "n": "b_n", "sign": "y"}), "b")
    return joined.select("a", "b", "a_n", "b_n", "x", "y").mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of documents whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), num, den) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    one = sets.select("doc", "set")
    joined = pairs.join(one.withColumnsRenamed({"doc": "a", "set": "x"}), "a").join(one.withColumnsRenamed({"doc": "b", "set": "y"}), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _renamed(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps after links between them."""
    joined = components(links)
    return comps.join(joined.withColumnRenamed("comp", "to"), comps["comp"] == joined["v"], "left").select("doc", F.coalesce("to", "comp").alias("comp"))


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex of the edges (a, b) has one b, or is one: then no step changes them."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("tail"), F.lit(0).alias("head")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("tail").alias("tail"), F.max("head").alias("head")).where("tail > 1 or tail = head").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of the edges (a, b) but the least of each component, which is comp.

    Alternating large-star and small-star steps until only stars are left, which is looked at before each round; every round is written
    to the shared folder. Stars are cut by minima, so a vertex with many neighbours costs rows, not pairs.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(edges.groupBy("a").agg(F.min("b").alias("b"))).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        edges = staged(down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("comp"))


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id) of every row: component_id is the least key reachable by links."""
    rows, single = numbered(docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)), key, text, "_row")
    found = row_components(rows.select(F.col("_row").alias("doc"), F.coalesce(text, F.lit("")).alias("text")), n, num, den)
    if single:
        return found.select(F.col("doc").alias(key), "n_shingles", F.col("comp").alias("component_id"))
    found = staged(rows.select(F.col("_row").alias("doc"), F.col(key).alias("key")).join(found, "doc"), "rows")
    # rows of a key are one document
    least = found.where("key is not null").groupBy("key").agg(F.min("comp").alias("b"))
    joined = components(found.join(least, "key").select(F.col("comp").alias("a"), "b"))
    found = found.join(joined.select(F.col("v").alias("comp"), F.col("comp").alias("to")), "comp", "left").withColumn("comp", F.coalesce("to", "comp"))
    names = found.groupBy("comp").agg(F.min("key").alias("component_id"))
    return found.join(names, "comp").select(F.col("key").alias(key), "n_shingles", "component_id")


def row_components(rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """rows: (doc, text) without nulls, one row for each doc. (doc, n_shingles, comp): comp is the least doc reachable by links."""
    spark = rows.sparkSession
    share = spark.sparkContext.broadcast
    heavy = share(_heavy(rows, n))
    profiles = staged(_profiles(rows, n, num, den, heavy), "profiles")
    heavy.destroy()
    some = profiles.where("n > 0")
    vertices = staged(some.groupBy("sig_a", "sig_b", "n").agg(F.min("doc").alias("rep"), F.min_by("mark", "doc").alias("mark")), "vertices")
    bits = bitmap_bits(vertices.count(), 64)
    # one row of each vertex, and by chance a few of its copies, which do no harm
    reps = share(hash_bitmap(vertices.select(F.col("mark").alias("k")), bits))
    size = bitmap_bits(some.agg(F.sum(F.size("prefix"))).first()[0] or 0, 4)
    marks = [share(hash_bitmap(_repeated(_of(some, reps)), size))]
    wanted = share(hash_bitmap(_kept(some, marks[0], reps).select(F.col("mark").alias("k")), bits))
    reps.destroy()
    sets = staged(_sets(rows, n, wanted).where("n > 0"), "sets")
    wanted.destroy()
    for _ in range(REFINEMENTS):
        prefixes = staged(_refined(sets, marks, num, den), "prefixes")
        marks.append(share(hash_bitmap(_repeated(prefixes), size)))
    kept = staged(_kept(prefixes, marks[-1]).drop("mark"), "kept")
    for mark in marks:
        mark.destroy()
    # groups of alike sets: those with the same most frequent shared shingle
    owned = kept.select("doc", "n", F.explode("tokens").alias("k"))
    often = owned.join(owned.groupBy("k").agg(F.count("*").alias("df")), "k").groupBy("doc", "n").agg(F.max_by("k", F.struct("df", "k")).alias("first"))
    kept = staged(kept.join(often, ["doc", "n"]), "kept")
    per = kept.groupBy("first").agg(F.count("*").alias("c"), F.min("doc").alias("pivot"))
    placed = kept.join(per, "first").withColumn("chunk", F.pmod(F.xxhash64("doc"), F.ceil(F.col("c") / GROUP)).cast("int"))
    placed = staged(placed.select("doc", "n", "first", "chunk", "c", "pivot", "tokens"), "placed")
    crowded = placed.where("c > 1")
    seats = crowded.select("doc", "n", "first", "chunk")
    pivots = crowded.where("doc = pivot").select("doc", "n", "first", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("c") / GROUP) - 1).cast("int"))).alias("chunk"))
    seats = seats.unionAll(pivots).distinct()
    near = staged(seats.join(sets.select("doc", "n", "sign"), ["doc", "n"]).groupBy("first", "chunk").applyInArrow(_near(num, den), "first long, chunk int, doc long, n int"), "near")
    whole = sets.select("doc", "n", "set")
    wanted = share(id_bitmap(near.select("doc"), bits))
    inside = near.join(rows_of(whole, wanted), ["doc", "n"]).groupBy("first", "chunk").applyInArrow(_inside(num, den), "doc long, comp long")
    # the pivot is the least document of its groups, so what holds it has its name everywhere
    comps = staged(placed.select("doc").distinct().join(inside.groupBy("doc").agg(F.min("comp").alias("comp")), "doc", "left").select("doc", F.coalesce("comp", "doc").alias("comp")), "comps")
    wanted.destroy()
    # stars: sets against a few pivots of each of their shingles, chosen by one hash order of all documents, so that the sets of
    # a large group of near copies meet the same few pivots
    fewest = (1 + F.floor(F.col("n") / 32)).cast("int")
    room = bitmap_bits(placed.agg(F.sum(F.size("tokens"))).first()[0] or 0, 8)
    for star in range(STARS):
        active = _active(placed, comps, room, num, den)
        placed = active.drop("comp")
        tokens = active.select("doc", "n", "comp", F.explode("tokens").alias("k"))
        order = [F.min(F.struct(F.hash("doc", F.lit(star * PIVOTS + i)).alias("h"), F.col("doc"), F.col("n"), F.col("comp"))) for i in range(PIVOTS)]
        pivots = tokens.groupBy("k").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.array_distinct(F.array(*order)).alias("p")).where("low < high")
        pivots = pivots.select("k", F.explode("p").alias("p")).select("k", F.col("p.doc").alias("b"), F.col("p.n").alias("b_n"), F.col("p.comp").alias("b_comp")).distinct()
        met = tokens.join(pivots, "k").where((F.col("comp") != F.col("b_comp")) & (F.col("n") * num <= F.col("b_n") * den) & (F.col("b_n") * num <= F.col("n") * den))
        pairs = met.groupBy("doc", "n", "b", "b_n").agg(F.count("*").alias("met")).where(F.col("met") >= F.least(fewest, (1 + F.floor(F.col("b_n") / 32)).cast("int")))
        pairs = staged(_likely(pairs.select(F.col("doc").alias("a"), "b"), sets, num, den), "pairs")
        if pairs.isEmpty():
            break
        wanted = share(id_bitmap(pairs.select("a").unionAll(pairs.select("b")), bits))
        hits = _compared(pairs, rows_of(whole, wanted), num, den)
        named = lambda c: comps.withColumnsRenamed({"doc": c, "comp": f"{c}_comp"})
        links = staged(hits.join(named("a"), "a").join(named("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct(), "stars")
        wanted.destroy()
        if links.isEmpty():
            break
        comps = staged(_renamed(comps, links), "comps")
    active = _active(placed, comps, room, num, den)
    tokens = active.select("doc", "n", "first", "chunk", "c", "comp", F.explode("tokens").alias("k"))
    reach = [F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max("comp").alias("c_high")]
    fits = (F.col("comp") < F.col("c_high")) & (F.col("n") * num <= F.col("n_high") * den) & (F.col("n_low") * num <= F.col("n") * den)
    matrix = tokens.groupBy("k", F.col("first").alias("g_first")).agg(*reach)
    met = tokens.join(matrix, "k").where(fits & ((F.col("first") != F.col("g_first")) | (F.col("c") > GROUP)))
    met = met.groupBy("doc", "n", "comp", "first", "chunk", "g_first").agg(F.count("*").alias("met"), F.min("n_low").alias("n_low"))
    met = met.where(F.col("met") >= F.least(fewest, (1 + F.floor(F.col("n_low") / 32)).cast("int"))).drop("n_low")
    members = active.select("doc", "n", "comp", F.col("first").alias("g_first"), F.col("chunk").alias("g_chunk"))
    groups = members.groupBy("g_first", "g_chunk").agg(*reach)
    met = met.join(groups, "g_first").where(fits & ((F.col("first") != F.col("g_first")) | (F.col("chunk") != F.col("g_chunk"))))
    met = staged(met.select("doc", "n", "comp", "g_first", "g_chunk"), "met")
    opened = _dealt(met, members, sets, "sign").applyInArrow(_open(num, den), "doc long, n int, comp long, g_first long, g_chunk int, asks boolean")
    opened = staged(opened.distinct(), "opened")
    if not opened.isEmpty():
        wanted = share(id_bitmap(opened.select("doc"), bits))
        asking, there = (opened.where(F.col("asks") == side).drop("asks") for side in (True, False))
        links = staged(_dealt(asking, there, rows_of(whole, wanted), "set").applyInArrow(_opened(num, den), "a long, b long").distinct(), "links")
        wanted.destroy()
        if not links.isEmpty():
            comps = _renamed(comps, links)
    vertices = vertices.join(comps.withColumnRenamed("doc", "rep"), "rep", "left").select("sig_a", "sig_b", "n", F.coalesce("comp", "rep").alias("comp"))
    out = profiles.select("doc", "n", "sig_a", "sig_b").join(vertices, ["sig_a", "sig_b", "n"], "left")
    return out.select("doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "doc").alias("comp"))


@in_small_batches
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100)


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near duplicates (five words, 0.8): the one with the least doc_id, nulls last.

    Every row is a vertex of its own, so rows that share a doc_id, or have none, go only where their own texts link. Of rows with
    one doc_id and one text without words, which links with nothing, one stays; without a doc_id all of them do.
    """
    text = F.col("text").cast("string")
    # numbers follow doc_id, so the least number of a component is its first row
    rows, _ = numbered(docs, "doc_id", "text", "near_row")
    found = row_components(rows.select(F.col("near_row").alias("doc"), F.coalesce(text, F.lit("")).alias("text")), 5, 80, 100)
    dropped = found.where("comp <> doc").select(F.col("doc").alias("near_row"))
    wordless = F.col("doc_id").isNotNull() & ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = rows.where(~wordless).join(dropped, "near_row", "left_anti").select(*docs.columns)
    return kept.unionAll(rows.where(wordless).select(*docs.columns).dropDuplicates(["doc_id", "text"]))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id AND r.c < e.b
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
