"""What the n-gram join moves between tasks: few of the sets that can't link."""

import random
import time

import numpy as np

from listingspark.llm import ngram_join


def test_signatures_rule_out_no_link():
    pick, ruled_out = np.random.default_rng(3), 0
    for k in range(600):
        size = int(pick.integers(1, 400))
        a = np.unique(pick.integers(0, 1 << 64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[pick.random(len(a)) < pick.choice([0.1, 0.8, 0.9, 0.95, 1])], pick.integers(0, 1 << 64, int(pick.integers(0, 1 + size // 8)), dtype=np.uint64)]))
        if not len(b):
            continue
        x, y = (np.frombuffer(ngram_join.signature(s), np.uint8) for s in (a, b))
        width = min(len(x), len(y))
        x, y = ngram_join.folded(x, width), ngram_join.folded(y, width)
        assert np.array_equal(x if len(a) <= len(b) else y, np.frombuffer(ngram_join.signature(min(a, b, key=len)), np.uint8)) or len(a) == len(b)
        may = bool(ngram_join.may_link(len(a), x, np.array([len(b)]), y[None], 85, 100)[0])
        assert may or not ngram_join.linked(a, b, 85, 100), k
        ruled_out += not may
    assert ruled_out > 100


def test_unlike_sets_with_shared_passages_stay_where_they_are(spark):
    """Texts of shared passages meet often and link never: their sets aren't sent, beside them near copies are found."""
    pick = random.Random(8)
    fresh = lambda n: " ".join(f"{pick.getrandbits(40):x}" for _ in range(n))
    passages = [fresh(60) for _ in range(80)]
    texts = [" ".join(pick.sample(passages, 13)) for _ in range(600)]
    copies = [texts[7 * k] + " tail" for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string").repartition(4).cache()
    docs.count()
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        time.sleep(1)
        return store.executorSummary("driver").totalShuffleWrite()

    before = written()
    found = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs, n=4, num=85, den=100).collect()}
    moved = written() - before
    assert found == {k: k if k < 600 else 7 * (k - 600) for k in range(620)}
    print("moved", moved)
    assert moved < 3 * 620 * 800 * 8


def test_stars_are_told_without_a_round(spark, monkeypatch):
    """Edges that are stars already are written once, and a path of stars only as often as there are rounds."""
    written, staged = [], ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", lambda df, name: written.append(name) or staged(df, name))
    make = lambda pairs: {r.v: r.comp for r in ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert make([(k, k % 5) for k in range(100)]) == {k: k % 5 for k in range(5, 100)}
    assert len(written) == 1
    assert make([(9, 5), (9, 7), (7, 3), (12, 11)]) == {5: 3, 7: 3, 9: 3, 12: 11}
    assert len(written) < 6


def test_a_bitmap_takes_one_shuffle(spark):
    from listingspark.llm import arrays

    ids = spark.range(3000).selectExpr("id % 1000 as id").repartition(4).cache()
    ids.count()
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("bitmap", "bitmap")
    made = arrays.id_bitmap(ids, 20)
    spark.sparkContext.setJobGroup("", "")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap") for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    wrote = [s for s in stages if store.lastStageAttempt(s).shuffleWriteBytes() > 0]
    hashes = arrays.mix(np.arange(1000, dtype=np.uint64))
    assert made.has(hashes).all() and int(np.unpackbits(made.packed).sum()) == len(np.unique(hashes >> np.uint64(44)))
    assert len(wrote) == 1
