"""Plans and steps whose cost must not grow faster than their input."""

import hashlib
import json
import math
import random
import re

from pyspark.sql import functions as F

from listingspark import tables
from listingspark.functions import orgs
from listingspark.operators import attribution, querytext, repair, runs, vectors
from listingspark.plans import joins, repairs
from listingspark.plans import vectors as plan_vectors
from listingspark.sources import files, mapping
from listingspark.streaming import ingest


def broadcast_rows(df):
    """The rows of each table that a run of df broadcast."""
    plan, found = df._jdf.queryExecution(), []
    plan.toRdd().count()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            found.append(node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children().iterator()
        while children.hasNext():
            walk(children.next())

    walk(plan.executedPlan())
    return found


def test_parsed_texts_are_not_broadcast(spark):
    texts = spark.range(5000).select(F.col("id").alias("key"), F.format_string("find a borsa ring under $%dk in black", F.col("id") % 50 + 1).alias("text"))
    pairs, styles = spark.createDataFrame([("borsa", "ring"), ("celto", "bolt")], "make string, model string"), spark.createDataFrame([("Coupe",)], "style string")
    colors, slang = spark.createDataFrame([("in", "black"), ("out", "black")], "place string, color string"), spark.createDataFrame([("bory", "borsa")], "word string, other string")
    got = querytext.parsed(texts, pairs, styles, colors, slang)
    assert max(broadcast_rows(got), default=0) < 100
    assert [tuple(r) for r in got.groupBy("make", "model", "exterior_color").count().collect()] == [("borsa", "ring", "black", 5000)]


def test_nearest_by_blocks(spark):
    pick = random.Random(4)
    rows = [(i, [pick.uniform(-1, 1) for _ in range(6)], i % 3) for i in range(90)]
    rows += [(100 + i, rows[i % 5][1], i % 3) for i in range(60)] + [(200, None, 0), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (202, [1.0, 2.0], 2), (203, [0.0] * 6, 0), (204, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").cache()
    exact = {r.vec_id: r.embedding for r in frame.collect()}

    def distance(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(1 - sum(x * y for x, y in zip(a, b)) / norm, 5) + 0.0 if norm else math.nan

    def place(pair):
        return (2, 0.0, pair[1]) if pair[0] is None else (1, 0.0, pair[1]) if math.isnan(pair[0]) else (0, *pair)

    for same in ([], ["label"]):
        asked = frame.where("vec_id % 4 = 0 OR vec_id > 200")
        got = vectors.nearest(asked, frame, 7, same=same, queries_at_once=9, rows_at_once=20).collect()
        for q, _, label in [r for r in rows if r[0] % 4 == 0 or r[0] > 200]:
            met = [] if same and label is None else [(distance(exact[q], exact[r]), r) for r, _, other in rows if not same or other == label]
            want = [(r, i + 1, str(d)) for i, (d, r) in enumerate(sorted(met, key=place)[:7])]
            assert sorted((x.vec_id, x["rank"], str(x.distance)) for x in got if x.query_id == q) == sorted(want)


def test_geo_radius_deals_more_pairs_over_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(400).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(300).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    few = joins.geo_radius(spark, str(tmp_path))
    monkeypatch.setattr(joins, "GEO_TASK", 10)
    many = joins.geo_radius(spark, str(tmp_path))
    assert few.rdd.getNumPartitions() <= 16 and many.rdd.getNumPartitions() >= 60
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) != []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlays_are_read_row_by_row(spark):
    rows = [(1, '{"ep": {"driveType": null}, "driveType": "x", "driveLine": "AWD"}'), (1, '{"driveline": "n/a", "drive_train": "4WD"}'), (2, '{"ep": "FWD", "driveTrain": 7}'), (3, "[1]"), (4, "{"), (None, None)]
    got = mapping.overlay_fields(spark.createDataFrame(rows, "id int, j string"), "id", "j")
    assert "Exchange" not in plan_of(got)
    assert [(r.id, r.drive_train) for r in got.collect()] == [(1, "AWD"), (1, "4WD"), (2, "7"), (3, None), (4, None), (None, None)]


def test_listings_meet_orders_before_names_join_them(spark):
    plan = tables.listings(spark, "/root/testdata/sf0.001").select("vin", "title", "dealer_name")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"l_partkey#\d+L = p_partkey", plan).start() < plan.index("LeftOuter")  # inner joins are above the orders'


def test_merges_read_the_listings_once(spark):
    for query in (repairs.overlay_merge, repairs.observation_merge):
        plan = plan_of(query(spark, "/root/testdata/sf0.001"))
        assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) <= 1


def test_scans_meet_their_rows_in_one_pass(spark, monkeypatch):
    plans = []

    def kept(df, folder):
        plans.append(plan_of(df))
        return runs.commit(df, folder)

    monkeypatch.setattr(repairs, "commit", kept)
    assert repairs.post_scan_pipeline(spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 2 and "l_orderkey" not in plans[1]  # the second stage needs no line items and moves no listing
    wide = [line for line in plans[1].splitlines() if "Exchange hashpartitioning(vin" in line]
    assert not wide


def test_index_runs_meet_documents_once(spark, tmp_path):
    schema = "kind string, key string, text string"
    docs = spark.createDataFrame([("a", "1", "red car"), ("a", "2", None)], schema)
    vectors.stored_model(docs, f"file://{tmp_path}/model", 8)
    name, encode = vectors.tfidf_encoder(spark, f"file://{tmp_path}/model")
    vectors.index_run(f"file://{tmp_path}/index", docs, name, encode)
    upsert = vectors.index_upsert(runs.latest(spark, f"file://{tmp_path}/index"), docs.withColumn("n_words", F.size(vectors.words(F.col("text")))), name, encode)
    assert upsert._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r.key, r.action, r.n_words) for r in upsert.collect()) == [("1", "kept", 2), ("2", "kept", 0)]


def test_index_reads_the_listings_once(spark, monkeypatch):
    plans = []
    for module, name in ((vectors, "commit"), (plan_vectors, "staged")):
        kept = getattr(runs, name)
        monkeypatch.setattr(module, name, lambda df, folder, kept=kept: (plans.append(plan_of(df)), kept(df, folder))[1], raising=False)
    plans.append(plan_of(plan_vectors.embedding_index(spark, "/root/testdata/sf0.001")))
    assert sum(p.count("FileScan parquet [l_orderkey") > 0 for p in plans) == 1


def test_payloads_are_searched_in_their_rows(spark):
    car = '{"vin": "1abcdefgh23456789", "year": 2001, "make": " m ", "extra": {"a": [1]}, "model": null}'
    deep = '{"data": {"items": [{"x": 1}, [%s]]}, "cars": [%s, {"vin": "short", "items": [%s]}]}' % (car, car.replace("2001", "2002"), car.replace("1abc", "2abc"))
    rows = [(1, deep, "s", 0), (2, "[[%s], 3, null]" % car, "s", 0), (3, "{", "s", 0), (4, None, "s", 0), (5, car, "s", 0)]
    got = repair.vehicles_of(spark.createDataFrame(rows, "k int, j string, s string, r int"), "k", "j", "s", "r")
    plan = plan_of(got)
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(map(tuple, got.collect())) == [(1, "1ABCDEFGH23456789", 2002, "m", None, "s"), (2, "1ABCDEFGH23456789", 2001, "m", None, "s")]


def test_page_texts_are_made_once(spark, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = plan_of(df)
        return runs.staged(df, name)

    monkeypatch.setattr(attribution, "staged", kept)
    text = F.concat(F.lit("We are part of the Valley Automotive Group. "), F.col("id").cast("string"))
    pages = spark.range(3).select(F.lit("a").alias("site"), F.col("id").alias("page"), F.lit("").alias("url"), F.lit("about").alias("kind"), F.lit(False).alias("cross"), text.alias("text"))
    assert "Valley Automotive Group" in {r.name for r in attribution.org_candidates(pages).collect()}
    assert "We are" not in plans["found"]


def test_needed_pieces_lose_no_match():
    texts = ["IS  Part\nof the X", "a MEMBER of the X", "Part Of the X", "Owned\tby", "PARENT  company", "part of", "operated  by", "A Family of Dealership", "Big Automotive Group", "Big Auto Group", "HOLMAN Valley group", "SONIC automotive", "collision GROUP", "member of", "© 2001 Big|"]
    for signal, _, pattern in (*orgs.ANCHORS, *orgs.STANDALONE, orgs.COPYRIGHT, *orgs.SECOND):
        met = [t for t in texts if re.search(pattern, t)]
        assert met and all(orgs.NEEDED.get(signal, "") in t.lower() for t in met)


def test_vehicles_are_found_and_mapped_in_their_rows(spark):
    cars = [{"VIN": f"V{i}", "internetPrice": "$1,%d00" % i, "trim": {"a": 1} if i == 1 else '{"a"', "stock": "x"} for i in range(4)]
    deep = {"inventory": {"vehicles": [{"vin": "W"}] + cars}}
    for _ in range(9):
        deep = {"data": deep}
    tied = {"b": cars[:3], "a": [{"vehicle": {"vin": f"T{i}"}} for i in range(3)], "z": [1, {"vin": None}]}
    rows = [("k1", "on", json.dumps({"data": {"vehicles": cars}})), ("k2", "on", json.dumps({"decoy": cars[1:], **deep})), ("k3", "on", json.dumps(tied)), ("k4", "gone", json.dumps(cars)), (None, "on", json.dumps(cars)), ("k5", "on", "{")]
    payloads = spark.createDataFrame(rows, ingest.PAYLOADS)
    lists = files.walk(files.walked_lists(payloads, "payload"))
    assert {r.k for r in lists.select("k", F.size("pending").alias("n")).collect() if r.n > 0} == {"k2", "k3"}  # what is settled isn't searched further
    found = mapping.mapped_rows(lists.select("k", "provider", F.explode("best.items").alias("v")), "provider", "v")
    assert "Exchange" not in plan_of(found) and "Join" not in plan_of(found)
    assert sorted((r.vin, r.price, r.trim) for r in ingest.vehicles(payloads).collect()) == [(f"V{i}", 1.0 * (1000 + 100 * i), None if i == 1 else '{"a"') for i in range(4)] + [("W", None, None)]
    assert [(r.k, r.path, r.n) for r in files.largest_vehicle_lists(payloads, "k", "payload").groupBy("k", "path").agg(F.count("*").alias("n")).orderBy("k").collect()] == [("k1", "$.data.vehicles", 4), ("k2", "$" + ".data" * 9 + ".inventory.vehicles", 5), ("k3", "$.a", 3), ("k4", "$", 4)]


def test_items_of_repeated_orders(spark):
    items = spark.createDataFrame([(1, 7), (2, 8), (None, 9)], "l_orderkey long, l_partkey long")
    assert sorted(r.l_partkey for r in tables.with_copies(items, spark.createDataFrame([(2, 3)], "o_orderkey long, copies long")).collect()) == [7, 8, 8, 8, 9]
    rows = tables.listing_rows(spark, "/root/testdata/sf0.001", tables.table(spark, "/root/testdata/sf0.001", "lineitem"))
    assert "o_orderkey" not in plan_of(rows) and rows.count() == tables.listing_rows(spark, "/root/testdata/sf0.001").count()


def test_observations_meet_their_rows_without_joins(spark):
    plan = plan_of(repairs.observation_merge(spark, "/root/testdata/sf0.001"))
    assert "Generate" not in plan and "o_orderkey" not in plan
    assert plan.count("Exchange hashpartitioning(vin") <= 1 and "gallery" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_observed_rows_are_the_joined_ones(spark):
    texts = ["interior_color", "exterior_color", "engine_description", "transmission", "drivetrain", "fuel_type"]
    numbers = ["cylinders", "mpg_city", "mpg_highway", "msrp"]
    schema = "vin string, " + ", ".join(f"{c} string" for c in texts) + ", " + ", ".join(f"{c} double" for c in numbers) + ", packages array<string>, gallery array<string>"
    rows = spark.createDataFrame([("a", *[None] * 6, *[0.0] * 4, ["Tow"], ["u/1", "u/2", None]), ("b", *["x"] * 6, *[1.0] * 4, None, ["u/3"]), (None, *[""] * 6, *[None] * 4, [], None)], schema)
    observed = spark.createDataFrame([("a", 0.6, "Tan", ["brown"], "Navy", " High", ["tow ", "Roof"])], "vin string, confidence double, interior string, families array<string>, exterior string, exterior_confidence string, features array<string>")
    stickers = spark.createDataFrame([("b", *["s"] * 4, *[2.0] * 4, ["Tow"])], "vin string, " + ", ".join(f"{c} string" for c in texts[2:]) + ", " + ", ".join(f"{c} double" for c in numbers) + ", options array<string>")
    classes = spark.createDataFrame([("u/1", "Logo", None), ("u/3", "", "no")], "url string, category string, keep string")
    want = repair.observation_merge(rows, observed, stickers, classes, "vin")
    # the same results beside the rows
    beside = rows.join(observed.withColumnsRenamed({c: f"_{c}" for c in observed.columns[1:]}), "vin", "left").join(stickers.withColumnsRenamed({c: f"_s_{c}" for c in stickers.columns[1:]}), "vin", "left")
    told = lambda u: F.when(u == "u/1", "Logo"), lambda u: F.when(u == "u/3", "no")
    beside = beside.withColumn("gallery", F.filter("gallery", lambda u: repair.stays(told[0](u), told[1](u))))
    got = sorted(map(tuple, repair.observed_rows(beside, rows.columns).collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str) and {r[0]: r[-3:-1] for r in got}["a"] == (["u/2", None], ["interior_color", "exterior_color"])


def test_places_are_counted_by_the_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BATCH", 3)
    texts = ["Red car, RED", "", None, "schöne 漢字 _x 1", "red " * 50, "!?", "a b c d e f g", "red car"]
    docs = spark.createDataFrame([("a", str(i), t) for i, t in enumerate(texts)], "kind string, key string, text string").coalesce(1)
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8
    counts = [[sum(place(w) == p for w in ws) for p in range(8)] for ws in words]
    idf = [math.log((len(texts) + 1) / (sum(c[p] > 0 for c in counts) + 1)) for p in range(8)]
    assert [(r.place, r.df, round(r.idf, 12)) for r in vectors.idf_model(docs, places=8).orderBy("place").collect()] == [(p, sum(c[p] > 0 for c in counts), round(idf[p], 12)) for p in range(8)]
    vectors.stored_model(docs, f"file://{tmp_path}/model", 8)
    _, encode = vectors.tfidf_encoder(spark, f"file://{tmp_path}/model")
    rows = docs.select("key", encode(F.col("text")).alias("v"), vectors.n_words(F.col("text")).alias("n")).orderBy("key").collect()
    got = [r.v for r in rows]
    assert [r.n for r in rows] == [len(w) for w in words]
    for t, c, v in zip(texts, counts, got, strict=True):
        weights = [n * i for n, i in zip(c, idf)]
        norm = math.sqrt(sum(w * w for w in weights)) or 1.0
        assert v is None if t is None else all(abs(a - b / norm) < 1e-12 for a, b in zip(v, weights, strict=True))


def test_index_texts_need_no_orders_and_one_sort(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(plan_vectors, "staged", lambda df, name: (plans.append(plan_of(df)), runs.staged(df, name))[1])
    assert plan_vectors.embedding_index(spark, "/root/testdata/sf0.001").count() > 0
    assert "o_orderkey" not in plans[0] and len(re.findall(r"Sort \[vin", plans[0])) == 1
