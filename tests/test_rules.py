"""Gold rows of the listing rules, and properties of the merges."""

from pyspark.sql import functions as F

from listingspark.functions import rules as R
from listingspark.operators import merge as M


def one(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_colors(spark):
    assert one(spark, ["Cognac leather", None, "zzzz-unknown-upholstery", "Black", "Titanium", "N/A"], R.color_families) == [["brown", "tan"], [], ["other"], ["black"], ["gray", "silver", "tan"], []]


def test_junk(spark):
    assert one(spark, ["--", "—", "-", "N/A", "na", " ", "unknown", "TBD", "Gas", None], R.placeholder_null) == [None] * 8 + ["Gas", None]
    assert one(spark, ["see  manufacturer specs", " ok "], R.clean_text) == [None, "ok"]


def test_vins(spark):
    assert one(spark, ["VIN001", "VINXXX", "1VINXXX9", "WBA12345678901234", "VIN12345678901234", None], R.is_dummy_vin) == [True, True, True, False, False, None]
    assert one(spark, [" wba12345678901234 ", "short", "unknown-123456789", "WBA1234567890123-"], R.scanner_vin) == ["WBA12345678901234", None, None, None]


def test_numbers(spark):
    assert one(spark, ["$1,234.5", "call", None], R.number) == [1234.5, 0.0, 0.0]
    assert one(spark, ["1,200", "-3", "x"], lambda c: R.int_floor(c, 0)) == [1200, None, None]


def test_domains(spark):
    assert one(spark, ["a.b.co.uk", "www.x.example.com", "localhost", "shop.dealer.com"], R.registrable_domain) == ["b.co.uk", "example.com", "localhost", "dealer.com"]


LISTINGS = "vin string, seq int, color string, price double, miles int, gallery array<string>"
ROWS = [("A", 1, "", 0.0, 0, ["a"]), ("A", 2, "Red", 9.0, 5, ["b", "a"]), ("A", 3, "Blue", 8.0, 7, ["c"]), ("B", 1, None, None, None, [])]


def test_fill_merge(spark):
    rows = spark.createDataFrame(ROWS, LISTINGS)
    kinds = {"color": "text", "price": "positive", "miles": "known"}
    out = {r.vin: r for r in M.fill_merge(rows, "vin", ["seq"], kinds, ["gallery"]).collect()}
    assert (out["A"].color, out["A"].price, out["A"].miles, out["A"].gallery, out["A"].n_rows) == ("Red", 9.0, 0, ["a", "b", "c"], 3)
    assert (out["B"].color, out["B"].price, out["B"].gallery) == (None, None, [])
    again = M.fill_merge(rows.repartition(3), "vin", ["seq"], kinds, ["gallery"]).collect()
    assert sorted(again, key=lambda r: r.vin) == sorted(out.values(), key=lambda r: r.vin)


def test_upsert_is_idempotent(spark):
    schema = "vin string, price double, trim string, at int"
    stored = spark.createDataFrame([("A", 5.0, "x", 1), ("B", None, "y", 1)], schema)
    batch = spark.createDataFrame([("A", 5.0, None, 2), ("B", 3.0, "z", 2), ("C", 1.0, None, 2)], schema)
    step = lambda s: M.snapshot_upsert(s, batch, "vin", {"price": "overwrite", "trim": "keep_if_null", "at": "overwrite"}, "price", "at")
    first = {r.vin: (r.price, r.trim, r.action, r.last_change) for r in step(stored).collect()}
    assert first == {"A": (5.0, "x", "updated", 1), "B": (3.0, "z", "updated", 2), "C": (1.0, None, "inserted", 2)}
    second = step(step(stored).select("vin", "price", "trim", "at"))
    assert {r.vin: (r.price, r.trim) for r in second.collect()} == {k: v[:2] for k, v in first.items()}


def test_soft_delete_leaves_other_tenants(spark):
    stored = spark.createDataFrame([("A", "d1", True), ("B", "d1", True), ("C", "d2", True)], "vin string, dealer string, active boolean")
    seen = spark.createDataFrame([("A", "d1")], "vin string, dealer string")
    scans = spark.createDataFrame([("d1", 9, 9, False), ("d2", 9, 9, True)], "dealer string, rows int, valid int, failed boolean")
    out = {r.vin: (r.active, r.outcome) for r in M.soft_delete(stored, seen, scans, "vin", "dealer").collect()}
    assert out == {"A": (True, "ok"), "B": (False, "ok"), "C": (True, "failed")}


def test_gallery_never_shrinks(spark):
    rows = spark.createDataFrame([(["https://a", "https://b"], ["https://c"]), (["https://a"], ["https://c", "http://d", "https://c"]), (None, ["https://x"]), (["https://1", "https://2", "https://3"], ["https://2", "https://4"])], "a array<string>, b array<string>")
    assert [r.x for r in rows.select(M.merge_galleries(F.col("a"), F.col("b")).alias("x")).collect()] == [["https://a", "https://b"], ["https://c"], ["https://x"], ["https://1", "https://2", "https://3", "https://4"]]
