"""Operators of the listing side on small tables, against loops and gold rows."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from listingspark.functions import orgs, trims
from listingspark.operators import attribution, fuzzy, pagespecs, querytext, runs, vectors
from listingspark.sources import mapping


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- runs


def test_commits_make_versions_and_broken_ones_dont_count(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    assert runs.commit(spark.range(3), folder) == 0 and runs.commit(spark.range(5), folder) == 1
    broken = tmp_path / "store" / "version=2"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    assert runs.latest(spark, folder).count() == 5
    assert runs.commit(runs.latest(spark, folder).where("id > 2"), folder) == 2 and runs.latest(spark, folder).count() == 2


def test_observed_stages_count_in_the_job_that_reads_them(spark, tmp_path):
    run = runs.Run(spark)
    first = run.observed(spark.range(10), "first", rows=F.count("*"))
    second = run.observed(first.where("id % 2 = 0"), "second", rows=F.count("*"), sum=F.sum("id"))
    runs.commit(second, f"file://{tmp_path}/x")
    assert sorted(map(tuple, run.statistics().collect())) == [("first", "rows", 10), ("second", "rows", 5), ("second", "sum", 20)]


# ---------------------------------------------------------------- names of organisations

NAMES = {
    "the Tuttle-Click Automotive Group": "ok", "Penske Motors": "ok", "Hi": "too_short", "": "empty", "A" * 121: "too_long", " ".join("abcdefghijklmnopq"): "too_many_words", "our company and friends": "generic_start",
    "See the Privacy Policy Group": "negative_phrase", "where is it that they were": "too_many_stopwords", "Red, Green, Blue Motors": "comma_clause", "Holman Auto Group which sells": "subordinate_clause", "lower case words": "not_entity_shaped",
    "Big Red Green Blue Black White Grey Pink Brown": "long_without_entity_word", "John Smith": "ok", "a the an Sonic": "ok",
}


def test_names_of_organisations(spark):
    got = frame(spark, [(n,) for n in NAMES], "name string").select("name", orgs.reason(F.col("name"))).collect()
    assert {r[0]: r[1] for r in got} == NAMES
    shown = {"tuttle click auto group": "Tuttle-Click Automotive Group", "The Sonic": "Sonic Automotive", "Sonic Automotive of Ohio": "Sonic Automotive", " Holman ": "Holman"}
    rows = frame(spark, list(shown.items()), "name string, want string").select("want", orgs.canonical(F.col("name")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_specificity_and_departments(spark):
    want = {"Collision Group": 0.15, "Smith-Jones Collision Center": 0.42, "Penske": 0.95, "Valley Auto Group": 0.85, "Green Valley Motors": 0.72, "Motors": 0.55, "": 0.0}
    got = frame(spark, [(n,) for n in want], "name string").select("name", orgs.specificity(F.col("name"))).collect()
    assert {r[0]: r[1] for r in got} == want


def test_matches_tell_places(spark):
    text = "ab x1 ab x22 ab"
    got = frame(spark, [(text,), ("none",), ("",), (None,)], "t string").select(attribution.matches(F.col("t"), "x([0-9]+)", 1)).collect()
    assert [[tuple(m) for m in r[0] or []] for r in got] == [[(3, 2, "1"), (9, 3, "22")], [], [], []]


def test_attribution_of_sites(spark):
    pages = [
        ("a", 1, "http://a/about", "about", False, "It is part of the Valley Automotive Group. Call us now.", 200, False), ("a", 2, "http://a/x", "homepage", False, "Our collision group is fine and we like it here.", 200, False),
        ("b", 3, "http://b/", "homepage", False, "This text says nothing of owners, nothing at all.", 200, False), ("c", 4, "http://c/", "homepage", False, "owned by Penske Motors. Really.", 504, False),
        ("d", 5, "http://d/", "about", False, "This store is owned by Penske Motors. Really.", 200, True), ("e", 6, "http://e/", "about", False, None, 200, False),
        ("f", 7, "http://f/", "about", False, "We are part of the Tuttle-Click Automotive Group. Yes we are.", 200, False), ("g", 8, "http://g/", "about", False, "It is part of the Tuttle Click Automotive Group. Yes it is.", 200, False),
    ]
    df = frame(spark, pages, "site string, page long, url string, kind string, cross boolean, text string, fetch_status int, mismatch boolean")
    model = frame(spark, [("b", "Somebody Group", 0.9), ("a", "Other Auto Group", 0.99)], "site string, ai_name string, ai_confidence double")
    sites = {r.site: r for r in attribution.attributed(df, model).collect()}
    assert sites["a"].status == "assigned" and sites["a"].group == "Valley Automotive Group" and sites["a"].source == "rules_only" and sites["a"].skip == "strong_rule_reject"
    assert sites["b"].status == "unknown" and sites["b"].skip == "no_plausible_candidates" and sites["b"].group is None
    assert sites["c"].status == "fetch_failed" and sites["c"].error == "http_504" and not sites["c"].loaded
    assert sites["d"].status == "manual_review" and sites["d"].skip == "redirect_mismatch" and sites["d"].group == "Penske Motors"
    assert sites["e"].status == "unknown"
    assert {sites[s].group for s in "fg"} == {"Tuttle-Click Automotive Group"}
    store = frame(spark, [(1, "a", True, None, None, None, None), (2, "c", True, "Old", 0.5, "assigned", "run-0"), (3, "a", False, "Old", None, None, None), (4, None, True, "Old", None, None, None), (5, "zz", True, None, None, None, None), (6, " ", None, None, None, None, None)], "id int, root string, ready boolean, dealer_group string, confidence double, status string, run_id string")
    out = {r.id: r for r in attribution.enriched(store, attribution.attributed(df, model), "run-1").collect()}
    assert len(out) == 6 and out[1].dealer_group == "Valley Automotive Group" and out[1].run_id == "run-1"
    assert (out[2].dealer_group, out[2].status, out[2].why) == ("Old", "fetch_failed", "fetch_failed:http_504")
    assert (out[3].dealer_group, out[3].run_id, out[3].why) == ("Old", None, "not_ready")
    assert [out[i].why for i in (4, 5, 6)] == ["no_website", "not_crawled", "no_website"]


# ---------------------------------------------------------------- the stored index


def test_upsert_is_a_rebuild_and_encodes_changes_only(spark, tmp_path):
    folder = f"file://{tmp_path}"
    schema = "kind string, key string, text string"
    one = frame(spark, [("a", "1", "red car"), ("a", "2", "blue car"), ("b", "1", "schöne rote Worte"), ("b", "3", None)], schema)
    two = frame(spark, [("a", "1", "red car"), ("a", "2", "green car"), ("b", "1", "schöne rote Worte"), ("b", "4", "red"), ("c", "5", "")], schema)
    vectors.stored_model(one, f"{folder}/model", 16)
    name, encode = vectors.tfidf_encoder(spark, f"{folder}/model")
    vectors.index_run(f"{folder}/index", one, name, encode)
    zeros = lambda text: F.array(F.length(text).cast("double") * 0)  # noqa: E731  marks what the encoder was given
    marked = {(r.kind, r.key): (r.action, len(r.vector)) for r in vectors.index_upsert(runs.latest(spark, f"{folder}/index"), two, name, zeros).collect()}
    assert marked == {("a", "1"): ("kept", 16), ("b", "1"): ("kept", 16), ("a", "2"): ("changed", 1), ("b", "4"): ("new", 1), ("c", "5"): ("new", 1)}
    vectors.index_run(f"{folder}/index", two, name, encode)
    rebuilt = {(r.kind, r.key): (r.fingerprint, r.vector) for r in vectors.encoded(two, name, encode).collect()}
    assert {(r.kind, r.key): (r.fingerprint, r.vector) for r in runs.latest(spark, f"{folder}/index").collect()} == rebuilt
    vectors.stored_model(two, f"{folder}/model", 16)
    newer, again = vectors.tfidf_encoder(spark, f"{folder}/model")
    assert newer != name
    vectors.index_run(f"{folder}/index", two, newer, again)  # another model: nothing may stay
    assert {r.action for r in runs.latest(spark, f"{folder}/index").collect()} == {"changed"}


# ---------------------------------------------------------------- search texts


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_deletion_neighbourhoods_find_every_pair(spark):
    rng = random.Random(3)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(150)} | {"", "schön", "schon"}
    terms = {"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(80)} | {"schön"}
    got = {(r.word, r.term): r.edits for r in querytext.within_one_edit(frame(spark, [(w,) for w in words], "word string"), frame(spark, [("make", t) for t in terms], "kind string, term string")).collect()}
    want = {(w, t): e for w, t in itertools.product(words, terms) if (e := edits(w, t)) <= 1 and (not e or max(len(w), len(t)) >= querytext.FUZZY_LENGTH)}
    assert got == want


def test_search_texts(spark):
    texts = [
        (1, "Toyta Camry under $25k with less than 40,000 miles"), (2, "bimmer x5 2019 or newer, awd suv"), (3, "red honda civc 2015 to 2018 with black seats"), (4, None), (5, ""), (6, "max 30k miles camry"), (7, "a 4-door coupe or hatch at most 9.5 thousand"),
    ]
    pairs = frame(spark, [("Toyota", "Camry"), ("BMW", "X5"), ("Honda", "Civic"), ("Honda", "Accord")], "make string, model string")
    styles = frame(spark, [("SUV",), ("Hatchback",), ("Gran Coupe",), ("Coupe",), (" ",)], "style string")
    colors = frame(spark, [(p, c) for p in ("in", "out") for c in ("red", "black")], "place string, color string")
    out = {r.key: r for r in querytext.parsed(frame(spark, texts, "key int, text string"), pairs, styles, colors, frame(spark, [("bimmer", "bmw")], "word string, other string")).collect()}
    assert len(out) == 7
    assert (out[1].make, out[1].model, out[1].max_price, out[1].max_mileage) == ("Toyota", "Camry", 25000, 40000)
    assert (out[2].make, out[2].model, out[2].min_year, out[2].max_year, out[2].drivetrain, out[2].body_style) == ("BMW", "X5", 2019, None, "AWD,4WD", "SUV")
    assert (out[3].make, out[3].model, out[3].min_year, out[3].max_year, out[3].exterior_color, out[3].interior_color) == ("Honda", "Civic", 2015, 2018, "red", "red")
    assert all(out[k][c] is None for k in (4, 5) for c in ("max_price", "make", "model", "body_style", "exterior_color"))
    assert (out[6].max_mileage, out[6].make, out[6].model) == (30000, "Toyota", "Camry")
    assert out[7].max_price == 9500 and out[7].body_style == "Coupe,Gran Coupe,Hatchback"


# ---------------------------------------------------------------- alike names


def test_rare_prefixes_lose_no_pair(spark):
    rng = random.Random(5)
    words = ["store", *("".join(rng.choices("abcdefg", k=rng.randint(1, 8))) for _ in range(14))]
    names = sorted({" ".join(dict.fromkeys(["store", *rng.choices(words, k=rng.randint(0, 5))])) for _ in range(160)})
    rows = [(b, n, n.split()) for b in (None, 1) for n in names]
    score = lambda a, b: 200 * sum(map(len, set(a.split()) & set(b.split()))) / (len(a.replace(" ", "")) + len(b.replace(" ", "")))
    for least in (60, 88):
        got = [(r.block, r.name, r.other) for r in fuzzy.alike_names(frame(spark, rows, "block int, name string, tokens array<string>"), ["block"], least).collect()]
        want = {(b, x, y) for b in (None, 1) for x in names for y in names if x < y and score(x, y) >= least}
        assert len(got) == len(set(got)) and set(got) == want and want
    met = fuzzy.prefixes(frame(spark, rows, "block int, name string, tokens array<string>"), ["block"], 88).where("token = 'store' AND size(tokens) > 3").count()
    assert met == 0  # what all names share isn't met


def test_duplicates_point_to_the_least(spark):
    rows = [(5, 1, "big store red"), (3, 1, "big store red"), (9, 1, "store big red"), (4, 2, "big store red"), (7, 1, None), (8, 1, None), (2, 1, "")]
    got = {r.id: r.duplicate_of for r in fuzzy.duplicates(frame(spark, rows, "id int, b int, name string"), "id", ["b"], "name", 88).collect()}
    assert got == {5: 3, 9: 3, 8: 7}


# ---------------------------------------------------------------- payloads by a table of paths


def test_mapped_payloads(spark):
    com = {"VIN": "V1", "pricing": {"finalPrice": "$12,500"}, "trackingAttributes": [{"name": "Vehicle Interior-Color ", "value": "Tan"}, {"name": "odometer", "value": "n/a"}], "mileage": "1,200", "exterior_color": " ", "bodyType": "SUV", "year": 0, "modelYear": 2020}
    on = {"vin": "V2", "price": 0, "sellingPrice": 9000, "fuelEconomy": {"city": 0, "mpgCity": 21}, "color": "Blue", "isCertified": True, "attributes": [{"key": "Engine Type", "text": "V6"}]}
    rows = [(1, "com", json.dumps(com)), (2, "on", json.dumps(on)), (3, "gone", json.dumps(on)), (4, "com", "no json"), (5, "on", None), (None, "on", '{"vin": "V3"}')]
    out = {r.id: r for r in mapping.mapped_by_table(frame(spark, rows, "id int, p string, j string"), "id", "p", "j").collect()}
    assert set(out) == {1, 2, 4, 5, None}
    assert (out[1].vin, out[1].price, out[1].interior_color, out[1].mileage, out[1].exterior_color, out[1].body_style, out[1].year) == ("V1", 12500.0, "Tan", 1200, None, "SUV", 2020)
    assert (out[2].vin, out[2].price, out[2].mpg_city, out[2].exterior_color, out[2].condition, out[2].engine_description) == ("V2", 9000.0, 21, "Blue", "true", "V6")
    assert out[4].vin is None and out[5].vin is None and out[None].vin == "V3"


def test_overlay_aliases(spark):
    rows = [(1, '{"driveType": "AWD", "drive_train": "n/a", "ep": {"fuelType": "Gas", "driveType": ""}, "seatColor": "Tan", "trim_color": "Red"}'), (2, '{"drivetrain": "FWD", "driveLine": "RWD"}'), (3, "[]"), (4, None)]
    out = {r.id: r for r in mapping.overlay_fields(frame(spark, rows, "id int, j string"), "id", "j").collect()}
    assert len(out) == 4 and len(mapping.ALIASES) == 47
    assert (out[1].drive_train, out[1].fuel_type, out[1].interior_color) == (None, "Gas", "Tan") and out[2].drive_train == "RWD"


# ---------------------------------------------------------------- pages and names


def test_page_specs(spark):
    html = {
        1: '<script type="application/ld+json">{"@type":"Car","vehicleTransmission":{"name":"CVT"},"vehicleEngine":"V6"}</script><table><tr><th>Engine</th><td>4 cyl</td></tr></table>',
        2: "<TABLE><TR><TH>Transmission</TH><TH>Drive</TH></TR><TR><TD>Auto&nbsp;8</TD><TD>AWD</TD></TR></TABLE>", 3: "<dl><dt>Engine</dt>\n<dd>Electric</dd></dl>", 4: "<tr><td>Engine</td><td>V8</td></tr>", 5: None, 6: "", 7: "<p>Fuel economy: 21/30 and $1,234</p>",
        8: '<script type="application/ld+json">{broken</script><table><tr><td>City MPG</td><td>no</td></tr><tr><td>MPG</td><td>18 | 25</td></tr></table>',
    }
    out = {r.k: r for r in pagespecs.page_specs(frame(spark, list(html.items()), "k int, h string"), "k", "h").collect()}
    assert len(out) == 8
    assert (out[1].cylinders, out[1].transmission) == (6, "CVT") and (out[2].transmission, out[2].drivetrain) == ("Auto 8", "AWD") and out[3].cylinders == 0
    assert out[4].cylinders is None and out[5].cylinders is None and (out[7].mpg_city, out[7].mpg_highway, out[7].price) == (21, 30, 1234) and (out[8].mpg_city, out[8].mpg_highway) == (18, 25)


TRIMS = [
    ("BMW", "330", "330i xDrive", "3 Series sedan", (4, None, "AWD", None, None, "8-Speed Automatic")), ("BMW", "X5", "xDrive40i", "X5 SAV", (6, None, "AWD", "Gas / Mild Hybrid", "SUV", "8-Speed Automatic")),
    ("BMW", "i4", "eDrive40", "i4 Gran Coupe", (0, None, "RWD", "Electric", "Gran Coupe", None)), ("BMW", "X7", "M60i", "X7", (8, None, None, None, "SUV", "8-Speed Automatic")), ("BMW", "330", "330e", "Plug-in", (4, None, "RWD", "Plug-In Hybrid", None, "8-Speed Automatic")),
    ("BMW", "M340i", "M340i", "M340i", (6, None, "RWD", "Gas / Mild Hybrid", "Sedan", "8-Speed Automatic")), ("Mercedes-Benz", "E-Class", "E 450 4MATIC", "E 450", (6, None, "AWD", None, None, None)),
    ("Mercedes-Benz", "C-Class", "C 300", "C 300 9-Speed Automatic", (4, 9, None, None, None, "9-Speed Automatic")), ("Mazda", "CX-5", "Touring AWD", "CX-5", (None, None, "AWD", None, "SUV", "Automatic")), ("Mazda", "Mazda3", "6MT", "hatch", (None, None, None, None, "Hatchback", "Manual")),
    ("Ford", "F-150", "XLT 4x4", "TEN-SPEED AUTOMATIC", (None, 10, "AWD", None, "Truck", "10-Speed Automatic")), ("Audi", "A4", "quattro", "A4 CVT", (None, None, "AWD", None, None, "CVT")), (None, None, None, None, (None,) * 6),
]


def test_trims(spark):
    got = frame(spark, [t[:4] for t in TRIMS], "make string, model string, trim string, title string").coalesce(1).select(trims.decoded(*map(F.col, ("make", "model", "trim", "title"))).alias("d")).collect()
    assert [tuple(r.d) for r in got] == [t[4] for t in TRIMS]


@pytest.mark.parametrize("days", [1, 3])
def test_ingest_goes_on_from_its_folder(spark, tmp_path, days):
    """One run over all files of a day, or a run after each file: the snapshot has the same listings."""
    from listingspark.streaming import ingest

    folder, source = f"file://{tmp_path}/out", f"file://{tmp_path}/in"
    car = lambda n, p, t: {"VIN": f"V{n}", "internetPrice": p, "trim": t}
    files = [[car(1, 10, "a"), car(2, 20, "b"), car(3, 30, "c")], [car(1, 0, ""), car(2, 21, "b2"), car(4, 40, "d")], [car(5, 1, "x")] * 2]
    for k, cars in enumerate(files):
        frame(spark, [(f"k{k}", "on", json.dumps({"data": {"vehicles": cars}}))], ingest.PAYLOADS).coalesce(1).write.mode("append").json(source)
        if days == 3 or k == 2:
            out = ingest.ingested(spark, source, folder, k)
    rows = {r.vin: (r.price, r.trim) for r in out.collect()}
    assert rows == {"V1": (None, "a" if days == 3 else None), "V2": (21.0, "b2"), "V3": (30.0, "c"), "V4": (40.0, "d")}
