"""Hard negatives and top-k search against brute force: nulls, ties, repeated rows, several lengths, very large components, a hot vector, empty tables."""

import math
import random

import duckdb
import numpy as np
import pytest

from listingspark.llm import negatives, registry, topk, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, score long, rank int, tile long, key string, a int"


def table(seed: int, n: int = 260) -> list[tuple]:
    rng = random.Random(seed)
    hot = [rng.uniform(-1, 1) for _ in range(6)]
    out = []
    for i in range(n):
        kind = i % 17
        v = hot if rng.random() < 0.35 else [rng.choice([-1.0, -0.5, 0.25, 0.3, 1.0]) for _ in range(rng.choice([6, 6, 6, 4, 9]))]
        v = {0: None, 1: [], 2: [None, 1.0], 3: [math.nan, 1.0], 4: [math.inf]}.get(kind if rng.random() < 0.4 else 9, v)
        out.append((None if rng.random() < 0.05 else rng.choice([i, i, 100, 50]), v, None if rng.random() < 0.05 else rng.randint(0, 3), 1, 1, 1, "own", 7))
    return out + out[:5]


def valid(rows, labelled=False):
    out = []
    for key, v, label, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and (label is not None or not labelled):
            out.append((key, [math.floor(256 * x) for x in v], (label + 1) % 10 if label is not None and key is not None and key % 7 == 0 else label))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def order(x):
    return (-x[0], x[1] is None, x[1] or 0)


def brute_negatives(rows):
    rows, out = valid(rows, True), []
    for i, (key, v, label) in enumerate(rows):
        if key is None or key % 100:
            continue
        scores = [(product(v, w), k, m) for j, (k, w, m) in enumerate(rows) if j != i]
        for top, positive, _ in sorted((x for x in scores if x[2] == label), key=order)[:5]:
            found = sorted((x for x in scores if x[2] != label and 80 * top <= 100 * x[0] <= 100 * top), key=order)[:5]
            out += [(key, positive, n, k, top, s) for n, (s, k, _) in enumerate(found, 1)]
    return sorted(out, key=repr)


def brute_topk(rows, every, k):
    rows, out = valid(rows), []
    for i, (key, v, _) in enumerate(rows):
        if key is not None and key % every == 0:
            out += [(key, n, x[1], x[0]) for n, x in enumerate(sorted(((product(v, w), q) for j, (q, w, _) in enumerate(rows) if j != i), key=order)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rough(spark, tmp_path_factory):
    found = {}
    for seed, n in ((1, 260), (2, 3)):
        d = str(tmp_path_factory.mktemp("vectors"))
        spark.createDataFrame(table(seed, n), SCHEMA).repartition(3).write.parquet(f"{d}/embeddings.parquet")
        found[d] = table(seed, n)
    return found


def test_negatives_by_brute_force(spark, rough):
    for d, rows in rough.items():
        got = registry.queries()["op12_hard_negatives"](spark, d)
        assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
        assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr) == brute_negatives(rows)


def test_negatives_without_broadcast(spark, rough):
    d, rows = next(iter(rough.items()))
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    label = negatives.F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    assert sorted(map(tuple, negatives.hard_negatives(df, label=label, broadcast_bytes=-1).collect()), key=repr) == brute_negatives(rows)


def test_topk_by_brute_force(spark, rough):
    for d, rows in rough.items():
        got = registry.queries()["op13_topk_search"](spark, d)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_topk(rows, 50, 5)


def test_topk_waves_and_salts(spark, rough):
    d, rows = next(iter(rough.items()))
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    for waves, size in (((1, 2, 5), -1), ((), 1 << 20)):
        assert sorted(map(tuple, topk.top_products(df, every=10, k=3, pivots=5, rings=3, waves=waves, broadcast_bytes=size).collect()), key=repr) == brute_topk(rows, 10, 3)


def test_annuli_stay_closed_where_vectors_form_clusters(spark):
    g = np.random.default_rng(4)
    centres = g.normal(size=(20, 16))
    vectors_ = [(i, (centres[i % 20] / np.linalg.norm(centres[i % 20]) + g.normal(size=16) * 0.02).tolist(), 0) for i in range(1500)]
    opened: list = []
    got = topk.top_products(spark.createDataFrame(vectors_, "vec_id long, embedding array<double>, label int"), opened=opened)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_topk(vectors_, 50, 5)
    assert sum(opened) < 0.5, opened  # the rest is ruled out by the triangle inequality


def test_huge_components(spark):
    rows = [(i, [1e30 * (i % 3 - 1), 1e12, 1e5 * i], 0, 1, 1, 1, "", 1) for i in range(0, 300, 25)]
    held = [(k, [max(-(1 << 62), min(1 << 62, math.floor(256 * x))) for x in v]) for k, v, *_ in rows]
    want = []
    for i, (key, v) in enumerate(held):
        if key % 50 == 0:
            exact = sorted(((-max(vectors.LOW + 1, min(-vectors.LOW, product(v, w))), k) for j, (k, w) in enumerate(held) if j != i))[:5]
            want += [(key, n, k, -s) for n, (s, k) in enumerate(exact, 1)]
    assert sorted(map(tuple, topk.top_products(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op12_hard_negatives", "op13_topk_search"):
        assert registry.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_topk_search"])
def test_twins(spark, name):
    d = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as from '{d}/embeddings.parquet'")
    want, got = duck.sql(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, d).toPandas()
    columns = sorted(want)
    assert columns == sorted(got) and sorted(got[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))


def test_strassen():
    g = np.random.default_rng(5)
    for shape in ((1, 1, 1), (3, 70, 5), (65, 33, 129), (40, 64, 7), (100, 100, 100)):
        a, b = g.integers(-(1 << 28), 1 << 28, shape[:2]), g.integers(-(1 << 28), 1 << 28, shape[1:])
        assert (negatives.strassen(a, b, 4) == a @ b).all() and (negatives.strassen(a, b, 16).astype(object) == a.astype(object) @ b.astype(object)).all()


def test_window_low():
    for p in [*range(-300, 300), 10**15 + 7, (1 << 62) + 3]:
        s = int(negatives.window_low(np.array([p]), 80)[0])
        assert 100 * s >= 80 * p > 100 * (s - 1)


def test_heaps_merge():
    g = np.random.default_rng(6)
    score, keys, null = g.integers(-3, 3, (4, 60)), np.sort(g.integers(0, 30, 60)), np.zeros(60, bool)
    one, parts = vectors.Heaps(4, 5), vectors.Heaps(4, 5)
    one.push(score, np.ones(score.shape, bool), keys, null)
    for at in (slice(40, 60), slice(0, 10), slice(10, 40)):
        parts.push(score[:, at], np.ones((4, 60), bool)[:, at], keys[at], null[at])
    assert (one.score == parts.score).all() and (one.key == parts.key).all()
