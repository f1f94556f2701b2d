"""Conversation repair against an enumeration of all repairs, and the query against DuckDB on rough tables."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from listingspark.llm import conversations as c
from listingspark.llm import registry

GOOD = re.compile(r"(s?(ua)+)?")


def repairs_of(rows):
    """(cost, audit, initials) of every repair with at most two insertions at each place."""
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    edits = []
    for initial, fault in rows:
        own = [("D", "", 4)]
        if fault not in (c.BLANK, c.DUPLICATE):
            more = 3 if fault == c.CUT else 0
            own += [("K", initial or "?", more), ("R", "u", 3 + more), ("R", "a", 3 + more)]
        edits.append(own)
    for chosen in itertools.product(*edits):
        for holes in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(x[2] for x in chosen) + 3 * sum(map(len, holes))
            audit, initials = "", ""
            for hole, edit in itertools.zip_longest(holes, chosen):
                audit, initials = audit + "I" * len(hole), initials + "".join(hole)
                if edit:
                    audit, initials = audit + edit[0], initials + edit[1]
            if GOOD.fullmatch(initials):
                yield cost, audit


def parsed(rows):
    p = c.Parser()
    for initial, fault in rows:
        p.row(initial, fault)
    return p.result()


def test_every_repair_of_short_conversations():
    rng = random.Random(8)
    for n in (0, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 4, 4):
        rows = [(rng.choice("suuaa" + "t ") if rng.random() < 0.95 else "", rng.choice([c.FINE, c.FINE, c.BLANK, c.DUPLICATE, c.CUT])) for _ in range(n)]
        assert parsed(rows) == min(repairs_of(rows)), rows


def test_long_conversations_keep_whole_audits():
    """By a plain table of (cost, audit) strings for each state of the grammar's automaton."""
    rng = random.Random(9)
    move = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    def closed(best):
        out = dict(best)
        for _ in range(2):
            for q, (cost, audit) in list(out.items()):
                new = (cost + 3, audit + "I")
                out[after[q]] = min(out.get(after[q], new), new)
        return out

    for n in (3 * c.CHUNK + 5, 40):
        rows = [(rng.choice("suuuaa"), rng.choice([c.FINE, c.FINE, c.FINE, c.BLANK, c.CUT])) for _ in range(n)]
        best = {0: (0, "")}
        for initial, fault in rows:
            new = {}
            for q, (cost, audit) in closed(best).items():
                more = 3 if fault == c.CUT else 0
                for letter, to, price in [("D", q, 4)] + ([] if fault == c.BLANK else [("K", move.get((q, initial)), more), ("R", after[q], 3 + more)]):
                    if to is not None:
                        x = (cost + price, audit + letter)
                        new[to] = min(new.get(to, x), x)
            best = new
        assert parsed(rows) == min(v for q, v in closed(best).items() if q in (0, 3))


@pytest.fixture(scope="module")
def rough(spark, tmp_path_factory):
    """Null keys, turns, roles and texts, shared turns, repeated rows, odd roles, spaces of all kinds, a conversation with half of all rows, clashing columns."""
    rng = random.Random(10)
    texts = ["Yes.", "No!", "why", "", " \t\n", "Fine. \n", "gut\xa0", "so?\x0b", None, "é漢.", "x" * 5000]
    rows = []
    for i in range(500):
        conv = rng.choice([None, *range(40)]) if i % 2 else 1000
        rows.append((conv, rng.choice([None, *range(9)]) if conv != 1000 else rng.randrange(60), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown"]), rng.choice(texts), "own", 1, "own"))
    rows += rows[:20] + [(2000, t, r, x, "own", 1, "own") for t, r, x in ((1, "user", "a."), (9, "assistant", "b."), (-(1 << 63), "user", "c."), ((1 << 63) - 1, "user", "d."))]
    rows += [(3000 + i, 0, "user", "Alone.", "own", 1, "own") for i in range(40)]  # some are dropped whole
    d = str(tmp_path_factory.mktemp("talk"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, place int, fault string").repartition(4).write.parquet(f"{d}/conversations.parquet")
    return d


def compared(spark, d, where="true"):
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{d}/conversations.parquet{'' if d.startswith('/root') else '/*.parquet'}' where {where}")
    want, got = duck.sql(registry.oracle_sql()["op11_conversation_repair"]).fetchall(), registry.queries()["op11_conversation_repair"](spark, d)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return [sorted(x, key=repr) for x in ([tuple(r) for r in got.select(*names).collect() if where == "true" or r.conv_id != 2000], want)]


def test_rough_table(spark, rough):
    got, want = compared(spark, rough, "conv_id is distinct from 2000")  # SQL's longs don't hold that one's gaps
    assert got == want and len(got) > 60
    assert any(x[7] == "" and x[8] == hashlib.sha256(b"").hexdigest() and x[0] and x[0] >= 3000 for x in got)


def test_widest_gap(spark, rough):
    rows = registry.queries()["op11_conversation_repair"](spark, rough).where("conv_id = 2000").collect()
    assert len(rows) == 1 and rows[0].gaps >= 0


def test_repaired_rows_are_real(spark, rough, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 3)  # segments of eight rows at most
    rows = c.turns(c.damaged(spark.read.parquet(f"{rough}/conversations.parquet")))
    found, edits = c.repairs(rows)
    out: dict = {}
    for r in c.repaired(rows, edits, by="conv_id").collect():
        out.setdefault(r.conv_id, []).append(r)
    found = found.collect()
    for f in found:
        mine = out.get(f.conv_id, [])
        assert "".join(r.edit for r in mine) == f.audit and GOOD.fullmatch("".join(r.role[:1] for r in mine if r.edit != "D"))
    spread = sorted((r.conv_id, r.edit, r.role, r.text) for r in c.repaired(rows, edits).where("conv_id is not null").collect())
    assert spread == sorted((k, r.edit, r.role, r.text) for k, v in out.items() for r in v if k is not None)
    monkeypatch.setattr(c, "BLOCK", 12)
    whole, _ = c.repairs(rows)
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_segments_fold_to_the_whole():
    rng = random.Random(11)
    for _ in range(200):
        rows = [(rng.choice("suuaax"), rng.choice([c.FINE, c.FINE, c.BLANK, c.DUPLICATE, c.CUT])) for _ in range(rng.randint(0, 12))]
        cuts = sorted(rng.choices(range(len(rows) + 1), k=3))
        stacks, path = c.START, []
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            initials, faults = "".join(x[0] for x in rows[a:b]), "".join(x[1] for x in rows[a:b])
            before = stacks
            stacks, chosen = c.folded(stacks, c.transfer(initials, faults))
            path.append((initials, faults, before, chosen))
        cost, rank, audit = c.cheapest(stacks)
        for initials, faults, before, chosen in reversed(path):
            rank, place = chosen[rank]
            parser = c.Parser(((before[rank][0], 0),))
            for x in zip(initials, faults):
                parser.row(*x)
            audit = parser.audit(place) + audit
        assert (cost, audit) == parsed(rows)


def test_twin(spark):
    got, want = compared(spark, "/root/testdata/sf0.001")
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert registry.queries()["op11_conversation_repair"](spark, str(tmp_path)).count() == 0
