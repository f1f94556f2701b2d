"""Operator 11, conversation structure repair: a generalised LR parser of the role grammar with weighted repairs.

The grammar of role initials is C -> s P | P | nothing, P -> P u a | u a. The parser's stacks share their parts (a graph); each row is a token
that may be kept, reroled to user or assistant, or deleted, and empty-text tokens may be inserted anywhere, each action at its cost. Stacks
with equal tops merge: the least (cost, audit) stays, audit being the initials of the edits in order. Audits are compared by rank: an
audit after n rows is a row of words I* then K, R or D, none a prefix of another, so the order of two audits never changes when the same or
other words follow. What one row does to a set of stacks depends on their tops, cost differences and ranks only, so it is worked out once
and looked up then.

Faults, the first counting: blank (no character but 0x20 and 0x09 to 0x0D), duplicate (role and text stood earlier in the conversation),
truncated (the last such character is none of . ! ?). Blank and duplicate rows must be deleted; a truncated row that stays costs more.

Rows of a conversation are ordered by turn (nulls first), of one turn by role and text as they were read. Null roles and texts are one space; a
role that is empty or has another initial than s, u, a can't be kept. A null conv_id is a conversation of its own. Repeated rows are rows of
their own. A conversation without rows has zeros and an empty audit; an empty table gives no rows.

No task needs a whole conversation. Rows are sorted over all conversations and cut into segments of at most SEGMENT rows of one
conversation. A segment is parsed from every stack that the grammar has, without texts; what it makes of each is a small table, and the
tables of a conversation are folded in order: only costs and ranks meet, for the order of two audits is that of their first segments that
differ. Each segment then gets the stack it begins with and its part of the audit, and is repaired on its own. The query's digest of a whole
repaired conversation is a hash over its text in order, so for that alone its rows pass one task, as a stream of which nothing is held.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.llm.arrays import in_small_batches, staged

#: The costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The LR automaton: 0 start, 1 after s, 2 and 6 after u, 3 and 7 after a, 4 after P, 5 after s P.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (4, "u"): 6, (5, "u"): 6, (6, "a"): 7}
REDUCE = {3: 2, 7: 3}
GOTO = {0: 4, 1: 5}
ACCEPT = {0, 4, 5}
#: Two symbols lead from every top to every other that insertion can reach.
INSERTS = 2
#: Rows after which the audit of each top becomes one string.
CHUNK = 256
#: Bits of a row's place that count within a block; a segment is what a conversation has of a block.
BLOCK = 12
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, CUT, GONE = "-", "b", "d", "t", "g"
SPACES = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}


def shifted(stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
    """The stack after a symbol and the reductions that follow, or None where the grammar has no such symbol there."""
    state = SHIFT.get((stack[-1], symbol))
    if state is None:
        return None
    stack = (*stack, state)
    while (length := REDUCE.get(stack[-1])) is not None:
        stack = stack[:-length]
        stack = (*stack, GOTO[stack[-1]])
    return stack


@functools.cache
def inserted(stack: tuple[int, ...]) -> tuple[tuple[str, tuple[int, ...]], ...]:
    """The stack and those that insertions make of it, with their part of the audit."""
    out = [("", stack)]
    for _ in range(INSERTS):
        word, last = out[-1]
        out.append((word + "I", next(s for r in ROLES if (s := shifted(last, r)))))
    return tuple(out)


START = (((0,), 0),)
#: Every stack that the grammar can leave between two rows.
STACKS = ((0,), (0, 1), (0, 2), (0, 1, 2), (0, 4), (0, 1, 5), (0, 4, 6), (0, 1, 5, 6))


@functools.lru_cache(1 << 16)
def step(stacks: tuple[tuple[tuple[int, ...], int], ...], initial: str, fault: str) -> tuple[tuple, int, tuple[tuple[int, str], ...]]:
    """What a row makes of (stack, cost over the least) pairs in order of audit: the new pairs, the rise of the least cost, and for each new pair the old one and the word it adds."""
    tops: dict[int, tuple] = {}
    for rank, (old, cost) in enumerate(stacks):
        for word, stack in inserted(old):
            paid = cost + INSERT * len(word)
            moves = [("D", stack, DELETE)]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                moves += [("K", shifted(stack, initial), more), *(("R", shifted(stack, r), REROLE + more) for r in ROLES)]
            for letter, new, price in moves:
                if new and ((found := (paid + price, rank, word + letter, new)) < tops.get(new[-1], (1 << 62,))):
                    tops[new[-1]] = found
    merged = sorted(tops.values(), key=lambda x: x[1:3])
    least = min(x[0] for x in merged)
    return tuple((x[3], x[0] - least) for x in merged), least, tuple(x[1:3] for x in merged)


class Parser:
    """The stacks of one conversation, row by row. A top's audit is a chain of (the chain before, words, whether it begins a chunk)."""

    def __init__(self, stacks: tuple = START):
        self.stacks, self.cost, self.audits, self.rows = stacks, 0, [(None, "", True)], 0

    def row(self, initial: str, fault: str) -> None:
        self.stacks, rise, words = step(self.stacks, initial, fault)
        self.cost += rise
        self.audits = [(self.audits[i], word, False) for i, word in words]
        self.rows += 1
        if self.rows % CHUNK == 0:
            self.audits = [self._chunk(a) for a in self.audits]

    @staticmethod
    def _chunk(audit: tuple) -> tuple:
        words = []
        while not audit[2]:
            words.append(audit[1])
            audit = audit[0]
        return audit, "".join(reversed(words)), True

    def audit(self, rank: int) -> str:
        words, audit = [], self.audits[rank]
        while audit:
            words.append(audit[1])
            audit = audit[0]
        return "".join(reversed(words))

    def result(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair."""
        cost, rank, word = cheapest(self.stacks)
        return self.cost + cost, self.audit(rank) + word


def cheapest(stacks: tuple) -> tuple[int, int, str]:
    """(cost, rank, insertions that end it) of the cheapest stack that the grammar accepts."""
    return min((cost + INSERT * len(word), rank, word) for rank, (old, cost) in enumerate(stacks) for word, stack in inserted(old) if stack[-1] in ACCEPT)


def transfer(initials: str, faults: str) -> list[list[tuple[int, int]]]:
    """For each of STACKS the (number of the stack, cost) pairs that rows make of it, in order of audit."""
    out = []
    for stack in STACKS:
        parser = ((stack, 0),), 0
        for initial, fault in zip(initials, faults, strict=True):
            stacks, rise, _ = step(parser[0], initial, fault)
            parser = stacks, parser[1] + rise
        out.append([(STACKS.index(s), cost + parser[1]) for s, cost in parser[0]])
    return out


def folded(stacks: tuple, table: list) -> tuple[tuple, list[tuple[int, int]]]:
    """The (stack, cost) pairs after a segment, in order of audit, and for each the rank of the one before and the place in its row of the segment's table."""
    tops: dict[int, tuple] = {}
    for rank, (stack, cost) in enumerate(stacks):
        for place, (number, more) in enumerate(table[STACKS.index(stack)]):
            new = STACKS[number]
            if (found := (cost + more, rank, place, new)) < tops.get(new[-1], (1 << 62,)):
                tops[new[-1]] = found
    merged = sorted(tops.values(), key=lambda x: x[1:3])
    return tuple((x[3], x[0]) for x in merged), [x[1:3] for x in merged]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text) as the contract damages them; `by_role` and `by_text` are as read, `gone` marks dropped rows."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(show("conv_id"), F.lit(":"), show("turn"))) % 20
    role, text = F.col("by_role"), F.col("by_text")
    return (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), show("role").alias("by_role"), show("text").alias("by_text"))
        .withColumn("hit", fault)
        .select("*", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
        .withColumns({"gone": F.col("hit") == 0, "role": F.when(F.col("hit") == 4, "user").otherwise(role), "text": F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate(text, ".!?", "")).otherwise(text)})
        .drop("hit")
    )


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, gone), staged: the rows of (conv_id, turn, role, text, by_role, by_text, copy, gone) with their places in the order of all.

    Ranges part by the first characters of a text, for their bounds pass the driver; only rows that agree so far stay together.
    """
    turn = F.col("turn").asc_nulls_first()
    dealt = rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), turn, "by_role", F.substring("by_text", 1, 32)).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), turn, "by_role", "by_text", "copy")
    return staged(dealt.select("conv_id", F.monotonically_increasing_id().alias("place"), "turn", "role", F.when(~F.col("gone"), F.col("text")).alias("text"), "gone"), "turns")


def faulty(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, initial, fault) of turns()'s rows. Equal texts of a role meet by SHA-256, reduced to their first place before they move."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    firsts = rows.where(~F.col("gone")).groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    cut = ~F.substring(stripped, -1, 1).isin(".", "!", "?")
    marks = rows.select("conv_id", "place", "turn", F.substring("role", 1, 1).alias("initial"), F.when(F.col("gone"), GONE).when(stripped == "", BLANK).when(cut, CUT).otherwise(FINE).alias("mark"))
    fault = F.when(F.col("mark").isin(GONE, BLANK), F.col("mark")).when(F.col("first"), F.col("mark")).otherwise(DUPLICATE)
    return marks.join(firsts, "place", "left").select("conv_id", "place", "turn", "initial", fault.alias("fault"))


SEGMENTS = "conv_id long, block long, initials string, faults string, illegal long, first_turn long, last_turn long, turns long, transfer string"
NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _table(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names = [f.split() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(names)], names=[n for n, _ in names])


def segments(rows: DataFrame) -> DataFrame:
    """A row of SEGMENTS for each segment of faulty()'s rows. Rows meet by block, at most 2^BLOCK of them."""
    block = F.shiftright("place", BLOCK)
    read = rows.select("conv_id", block.alias("block"), "place", "turn", "initial", "fault").repartition("block").sortWithinPartitions("block", "place")

    def made(key: tuple, held: list[tuple]) -> tuple:
        held = [x for x in held if x[2] != GONE]
        initials, faults = "".join(x[1][:1] or " " for x in held), "".join(x[2] for x in held)
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        known = [x[0] for x in held if x[0] is not None]
        ends = (known[0], known[-1]) if known else (None, None)
        return (*key, initials, faults, illegal, *ends, len(set(known)), json.dumps(transfer(initials, faults)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []
        for batch in batches:
            for conv, blk, turn, initial, fault in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if key != (conv, blk):
                    if key:
                        done.append(made(key, held))
                    key, held = (conv, blk), []
                held.append((turn, initial, fault))
            yield _table(done, SEGMENTS)
            done = []
        if key:
            yield _table([made(key, held)], SEGMENTS)

    return read.mapInArrow(run, SEGMENTS)


CHOICES = "conv_id long, block long, entry int, exit int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def choices(parts: DataFrame) -> DataFrame:
    """A row of CHOICES for each of segments()'s rows: the stack that it begins with, the place of the audit that is its own in its table's row of that stack, what
    ends the audit; the last segment of a conversation also has the conversation's numbers."""
    read = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    class Conversation:
        def __init__(self, conv):
            self.conv, self.stacks, self.path = conv, START, []
            self.counts, self.illegal, self.before = Counter(), 0, ""
            self.first = self.last = None
            self.turns = 0

        def add(self, block, initials, faults, illegal, first, last, turns, table):
            stacks, chosen = folded(self.stacks, json.loads(table))
            self.path.append((block, [STACKS.index(s) for s, _ in self.stacks], chosen))
            self.stacks = stacks
            self.counts.update(faults)
            if initials:
                self.illegal += illegal + bool(self.before and self.before + initials[0] not in LEGAL)
                self.before = initials[-1]
            if turns:
                self.turns += turns - (first == self.last)  # turns ascend
                self.first, self.last = first if self.first is None else self.first, last

        def rows(self):
            cost, rank, word = cheapest(self.stacks)
            gaps = self.last - self.first + 1 - self.turns if self.turns else 0
            more = (min(gaps, (1 << 63) - 1), self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, cost)
            for block, entries, chosen in reversed(self.path):
                rank, place = chosen[rank]
                yield (self.conv, block, entries[rank], place, word, *more)
                word, more = "", (None,) * len(NUMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done: list[tuple] = []
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    if now:
                        done += now.rows()
                    now = Conversation(conv)
                now.add(*rest)
            yield _table(done, CHOICES)
        if now:
            yield _table(list(now.rows()), CHOICES)

    return read.mapInArrow(run, CHOICES)


def audits(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, block, audit, before): each segment's part of the audit and the initial that stands before it."""
    other = chosen.select(F.col("conv_id").alias("of"), "block", "entry", "exit", "tail")
    read = parts.join(other, (parts["block"] == other["block"]) & parts["conv_id"].eqNullSafe(other["of"])).select("conv_id", parts["block"], "initials", "faults", "entry", "exit", "tail")
    fields = "conv_id long, block long, audit string, before string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for conv, block, initials, faults, entry, place, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parser = Parser(((STACKS[entry], 0),))
                for initial, fault in zip(initials, faults, strict=True):
                    parser.row(initial, fault)
                done.append((conv, block, parser.audit(place) + tail, "u" if STACKS[entry][-1] in (2, 6) else ""))
            yield _table(done, fields)

    return read.mapInArrow(run, fields)


def repaired(rows: DataFrame, edits: DataFrame, by: str = "block") -> DataFrame:
    """(conv_id, edit, role, text): what becomes of turns()'s rows, in order within a segment, or by="conv_id" within a conversation; deleted rows keep their role and text.

    A segment's audit stands before its rows as a row of its own, so that the rows pass once.
    """
    head = edits.select("conv_id", "block", F.lit(-1).cast("long").alias("place"), F.col("audit").alias("role"), F.col("before").alias("text"))
    body = rows.where(~F.col("gone")).select("conv_id", F.shiftright("place", BLOCK).alias("block"), "place", "role", "text")
    ordered = head.unionByName(body).repartition(by).sortWithinPartitions("conv_id", "block", "place")
    fields = "conv_id long, edit string, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, before = None, "", 0, ""
        out: list[tuple] = []

        def emit(edit, role, text):
            nonlocal before
            if edit != "D":
                role = role if edit == "K" else ROLES["a" if before == "u" else "u"]
                before = role[:1]
            out.append((conv, edit, role, text))

        def inserts():
            nonlocal at
            while audit[at : at + 1] == "I":
                emit("I", None, "")
                at += 1

        for batch in batches:
            for c, place, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                inserts()
                if place < 0:
                    conv, audit, at, before = c, role, 0, text
                else:
                    emit(audit[at], role, text)
                    at += 1
            yield _table(out, fields)
            out.clear()
        inserts()
        yield _table(out, fields)

    return ordered.mapInArrow(run, fields)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired()'s rows, which stand in order: `role:text` of what isn't deleted, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda done: pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1].hexdigest() for x in done], pa.string())], names=["conv_id", "repaired_sha256"])
        now, done = None, []
        for batch in batches:
            for conv, edit, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        done.append(now)
                    now, more = (conv, hashlib.sha256()), ""
                if edit != "D":
                    now[1].update(f"{more}{role}:{text}".encode())
                    more = "\n"
            if done:
                yield made(done)
                done = []
        if now:
            yield made([now])

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, edits) of turns()'s rows: (conv_id, NUMBERS, audit) and audits()'s rows, both staged in part."""
    parts = staged(segments(faulty(rows)), "segments")
    chosen = staged(choices(parts), "choices")
    edits = staged(audits(parts, chosen), "edits")
    whole = edits.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit")).withColumnRenamed("conv_id", "of")
    found = chosen.where("cost is not null").select("conv_id", *NUMBERS)
    return found.join(whole, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of"), edits


@in_small_batches
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, the cheapest repair and the digest of what it leaves, for each conversation of the damaged table."""
    rows = turns(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    found, edits = repairs(rows)
    sums = digests(repaired(rows, edits, by="conv_id")).withColumnRenamed("conv_id", "of")
    return found.join(sums, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS by_role, coalesce(text, ' ') AS by_text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, t FROM conversations, crc
), hits AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS hit FROM named
), copied AS (
  SELECT c, turn, by_role, by_text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN hit = 4 THEN 'user' ELSE by_role END AS role,
         CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN translate(by_text, '.!?', '') ELSE by_text END AS text FROM hits WHERE hit <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, by_role, by_text, copy) AS place, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped FROM copied
), faulty AS (
  SELECT *, CASE WHEN stripped = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 THEN 'd' WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY c ORDER BY place), 1) AS before FROM placed
), sums AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c
), inserts(q, word, q2, price, lines) AS (
  VALUES (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''), (0, 'I', 2, 3, chr(10) || 'user:'), (1, 'I', 2, 3, chr(10) || 'user:'), (2, 'I', 3, 3, chr(10) || 'assistant:'),
         (3, 'I', 2, 3, chr(10) || 'user:'), (0, 'II', 3, 6, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 'II', 3, 6, chr(10) || 'user:' || chr(10) || 'assistant:')
), edits(q, letter, initial, q2, price) AS (
  VALUES (0, 'D', '', 0, 4), (1, 'D', '', 1, 4), (2, 'D', '', 2, 4), (3, 'D', '', 3, 4), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
         (0, 'R', 'u', 2, 3), (1, 'R', 'u', 2, 3), (2, 'R', 'a', 3, 3), (3, 'R', 'u', 2, 3)
), dp AS (
  SELECT c, 0 AS n, 0 AS q, 0 AS cost, '' AS audit, '' AS lines FROM (SELECT DISTINCT c FROM hits)
  UNION ALL
  SELECT c, n, q, cost, audit, lines FROM (
    SELECT d.c, d.n + 1 AS n, e.q2 AS q, d.cost + i.price + e.price + CASE WHEN e.letter <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END AS cost, d.audit || i.word || e.letter AS audit,
           d.lines || i.lines || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || CASE e.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text END AS lines,
           row_number() OVER (PARTITION BY d.c, e.q2 ORDER BY d.cost + i.price + e.price + CASE WHEN e.letter <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END, d.audit || i.word || e.letter) AS k
    FROM dp d JOIN faulty f ON f.c = d.c AND f.place = d.n + 1 JOIN inserts i ON i.q = d.q JOIN edits e ON e.q = i.q2 AND (e.letter <> 'K' OR e.initial = f.initial) AND (e.letter = 'D' OR f.fault NOT IN ('b', 'd'))
  ) WHERE k = 1
), ends AS (
  SELECT d.c, d.cost + i.price AS cost, d.audit || i.word AS audit, d.lines || i.lines AS lines,
         row_number() OVER (PARTITION BY d.c ORDER BY d.cost + i.price, d.audit || i.word) AS k
  FROM dp d LEFT JOIN sums s ON s.c = d.c JOIN inserts i ON i.q = d.q AND i.q2 IN (0, 3) WHERE d.n = coalesce(s.n, 0)
)
SELECT DISTINCT h.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
       e.cost::BIGINT AS cost, e.audit, sha256(substr(e.lines, 2)) AS repaired_sha256
FROM hits h JOIN ends e ON e.c = h.c AND e.k = 1 LEFT JOIN sums s ON s.c = h.c
"""
