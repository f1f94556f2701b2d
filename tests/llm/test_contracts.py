"""Each query over a table with nulls, empty and long texts, ties, repeated rows and further columns, over empty tables, and the DuckDB twins."""

import os
import random
import zlib

import duckdb
import pytest

from listingspark.llm import registry

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
rng = random.Random(3)
WORDS = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(200)]
COLUMNS = {
    "op1_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op2_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op5_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op9_license_scan": {"page_id": "bigint", "license_id": "string", "origin": "string"},
    "op10_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


def prose(n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def rough(spark, tmp_path_factory):
    """Documents, labels and pages with everything that may be odd; columns that the operators make come with values of their own."""
    base = prose(150)
    texts = [None, "", " ", "one", base, base, base + " end", prose(9000), "\x00\x1f\x7f é漢\U0001f600", *(prose(40) for _ in range(30)), "fool " + prose(20), "fool fool"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else "s", len(t or ""), "own", "own", 1.0, 1) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (4, "other text of the key", "en", "s", 21, "own", "own", 1.0, 1), *((None, t, "en", "s", None, "own", "own", 1.0, 1) for t in (None, base, base, prose(30)))]
    d = str(tmp_path_factory.mktemp("rough"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc string, row string, toxic_score double, piece int").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*((i, 1, int((texts[i] or "").startswith("fool"))) for i in range(len(texts))), (4, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    urls = ["http://a.example.org/es/x", None, "", "nothing", "http://org/LICENSE", "http://org/a/b?c#d", "HTTP://ORG/", "http://org/" + "p/" * 2000]
    pages = [(i, u, f"<p>{prose(20)}</p>", "own", 1) for i, u in enumerate(urls)] + [(None, "http://org/x", None, "own", 1), (4, "http://org/LICENSE", "<p>Released under the MIT License.</p>", "own", 1), (4, "http://org/LICENSE", "<p>Released under the MIT License.</p>", "own", 1)]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string, row int").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def nothing(spark, rough, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nothing"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{rough}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rough_and_empty_tables(spark, rough, nothing, name):
    query = registry.queries()[name]
    out = query(spark, rough)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = out.collect()
    table = spark.read.parquet(f"{rough}/{'pages' if 'page_id' in kinds else 'documents'}.parquet")
    if name == "op4_packing":
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and len([r for r in rows if r.piece == 0]) == table.count()
    else:
        assert len(rows) == table.count()
    key = table.columns[0]
    assert {r[key] for r in rows} == {r[0] for r in table.select(key).collect()}
    by_text = {}
    if name in ("op1_media_columns", "op5_fingerprints", "op10_bpe"):
        mark = {"op1_media_columns": "media_sha256", "op5_fingerprints": "fingerprint", "op10_bpe": "ids_sha256"}[name]
        for r in rows:
            by_text.setdefault(r[key], set()).add(r[mark])
        assert by_text[4] >= by_text[5] and len(by_text[4]) == 2 and by_text[0] == by_text[1]
    if "held_out" in kinds:
        third = 3 if name == "op6_toxicity" else 5
        rest = 1 if name == "op6_toxicity" else 0
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % third == rest) for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op7_language":
        assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    empty = query(spark, nothing)
    assert dict(empty.dtypes) == kinds and empty.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        duck.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    want, got = duck.sql(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want)
    assert columns == sorted(got)
    plain = lambda f: sorted((tuple(None if v is None or v != v else v for v in r) for r in f[columns].itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)
