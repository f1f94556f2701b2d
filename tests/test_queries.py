"""Every registered listing query against its DuckDB twin at the smallest scale, and the flagship."""

import json
import math
import numbers
import os
import re
import tempfile
from collections import Counter
from itertools import combinations

import duckdb
import pandas as pd
import pytest

from listingspark.operators.vectors import hashed_tfidf
from listingspark.plans import registry
from listingspark.sources.files import largest_vehicle_lists
from listingspark.tables import listings

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return connection


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    want, got = duck.sql(ORACLES[name]).df(), QUERIES[name](spark, DATA).toPandas()
    assert sorted(want) == sorted(got)
    assert rows(got, sorted(want)) == rows(want, sorted(want))


def test_every_query_without_twin_is_known():
    assert set(QUERIES) - set(ORACLES) == {"rate_limit_window", "token_set_ratio"}


def common(a, b):
    """The length of the longest common subsequence, by trying the shorter text's subsequences, longest first."""
    a, b = sorted((a, b), key=len)
    inside = lambda x: all(c in rest for rest in [iter(b)] for c in x)
    return next(n for n in range(len(a), -1, -1) if any(inside(x) for x in combinations(a, n)))


def test_token_set_ratio(spark):
    from listingspark.functions.plugins import alike, set_ratio

    assert set_ratio("new york mets", "mets new york city") == 100 and set_ratio("", "a") == 0 == set_ratio("abc", "xyz")
    assert alike("abcd", "acd") == 200 * 3 / 7 and alike("", "") == 100

    def score(x, y):
        x, y = set(x.split()), set(y.split())
        both, one, two = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
        one, two = (f"{both} {w}".strip() for w in (one, two))
        likeness = lambda p, q: 200 * common(p, q) / (len(p) + len(q))
        return max([likeness(one, two)] + [likeness(both, w) for w in (one, two) if both])

    part = pd.read_parquet(f"{DATA}/part.parquet")
    part["p_brand"], part["p_size"] = "B", part["p_size"] % 3  # larger blocks than the table has
    names = [" ".join(n.split() + (["large"] if i % 3 == 0 else [])) for i, n in enumerate(part.p_name)]
    part["p_name"] = names
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    part.to_parquet(f"{folder}/part.parquet")
    got = {(r.p_size, r.a, r.b): (r.score, r.n_a, r.n_b) for r in QUERIES["token_set_ratio"](spark, folder).collect()}
    counts = Counter(zip(part.p_size, part.p_name))
    want = {}
    for (size, x), (other, y) in combinations(sorted(counts), 2):
        if size == other and (s := round(score(x, y), 4)) >= 90:
            want[size, x, y] = (s, counts[size, x], counts[size, y])
    assert got == want and want


def test_versions_go_on_after_a_restart(spark, tmp_path):
    """A second run from the same folder folds new files into the version that the first left."""
    from listingspark.streaming import jobs as J

    schema = "k long, v long"
    def step(batch, before):
        rows = batch if before is None else batch.unionByName(before)
        return rows.groupBy("k").sum("v").selectExpr("k", "`sum(v)` AS v")
    for n in range(3):
        spark.createDataFrame([(1, 10**n), (n + 2, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = J.run_by_batch(stream, "t", step, f"file://{tmp_path}/out")
        assert {r.k: r.v for r in out.collect()} == {1: int("1" * (n + 1))} | {i + 2: 1 for i in range(n + 1)}
    assert len(J.versions(spark, f"file://{tmp_path}/out")) >= 3


def test_price_changes_over_unordered_frames(spark, tmp_path):
    """A key's rows are ordered over all Arrow frames of a batch."""
    from listingspark.streaming import jobs as J

    rows = [(1, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=(i * 37) % 100)).to_pydatetime(), float((i * 37) % 100 // 10)) for i in range(100)]
    spark.createDataFrame(rows, "k long, ts timestamp, p double").coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = J.run_to_table(J.price_changes(J.file_stream(spark, f"{tmp_path}/in"), "k", "ts", "p"), "changes").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r.new, r.old) for r in out) == [(0.0, None)] + [(float(i), float(i - 1)) for i in range(1, 10)]


def test_rate_limit(spark):
    events = pd.read_parquet(f"{DATA}/events.parquet").sort_values(["ts", "event_id"])
    want, passed = {}, {}
    for e in events.itertuples():
        recent = [t for t in passed.get(e.user_id, []) if t > e.ts - pd.Timedelta(hours=6)]
        want[e.event_id] = len(recent) < 2
        passed[e.user_id] = recent + [e.ts] * want[e.event_id]
    assert {r.event: r.allowed for r in QUERIES["rate_limit_window"](spark, DATA).collect()} == want


def test_export_has_every_active_row(spark, duck):
    want, got = duck.sql(ORACLES["inventory_export"]).df(), QUERIES["inventory_export"](spark, DATA).toPandas()
    assert len(got) == listings(spark, DATA).where("listing_active").count() and rows(got, sorted(want)) == rows(want, sorted(want))


def test_deep_vehicle_lists_are_found(spark):
    cars = [{"vin": f"V{i}"} for i in range(4)]
    deep = {"inventory": {"vehicles": cars}}
    for _ in range(9):
        deep = {"data": deep}
    payloads = [(1, json.dumps({"props": {"pageProps": {"data": {"inventory": {"vehicles": cars}}}}})), (2, json.dumps({"decoy": cars[:3], **deep})), (3, "7"), (4, "no json"), (5, None)]
    found = largest_vehicle_lists(spark.createDataFrame(payloads, "k long, payload string"), "k", "payload").collect()
    assert sorted((r.k, r.vin) for r in found) == [(k, f"V{i}") for k in (1, 2) for i in range(4)]


def test_hashed_tfidf_is_brute_force(spark):
    texts = {1: "Schön schon, SCHÖN", 2: "слово 漢字 слово", 3: "", 4: None, 5: "a b c a", 6: "!?", 7: "schon a"}
    words = {k: re.findall(r"\w+", (t or "").lower()) for k, t in texts.items()}
    places = {r.w: r.p for r in spark.createDataFrame([(w,) for w in {x for ws in words.values() for x in ws}], "w string").selectExpr("w", "pmod(xxhash64(w), 16) p").collect()}
    tf = {k: Counter(places[w] for w in ws) for k, ws in words.items()}
    got = {r.k: r.vector for r in hashed_tfidf(spark.createDataFrame(list(texts.items()), "k long, t string"), "k", "t", 16).collect()}
    assert set(got) == set(texts)
    for k, counts in tf.items():
        want = [counts[p] * math.log((len(texts) + 1) / (sum(p in c for c in tf.values()) + 1)) for p in range(16)]
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert all(abs(x - y / norm) < 1e-5 for x, y in zip(got[k], want, strict=True)), k


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count() > 0
