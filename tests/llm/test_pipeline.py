"""The pipeline's stages on a small corpus with planted copies, passages and toxic texts."""

import os
import random
import tempfile

import pytest
from test_operators import brute_components, brute_removed

public_tokenizers = pytest.importorskip("public_tokenizers")
rng = random.Random(11)
WORDS = {k: ["".join(rng.choices(a, k=rng.randint(2, 8))) for _ in range(500)] for k, a in {"en": "abcdefghij", "fr": "opqrstuvéè"}.items()}


@pytest.fixture(scope="module")
def folder(spark):
    text = lambda k, n: " ".join(rng.choices(WORDS[k], k=n))
    rows, labels = [], []
    passage = text("en", 60)
    for i in range(600):
        lang = "en" if i % 3 else "fr"
        body = text(lang, 80)
        toxic = i % 6 == 1
        if toxic:
            body += " " + rng.choice(["blockhead", "nitwit"])
        elif i % 20 == 4:
            body = text(lang, 30) + " " + passage + " " + text(lang, 30)
        rows.append((i, body, lang, "src0", len(body)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + k, rows[k * 6][1], rows[k * 6][2], "src1", rows[k * 6][4]) for k in range(5)]
    rows += [(2000, "12 34 !", "en", "src1", 7), (2001, None, "en", "src1", 0), (2002, "", None, None, None)]
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    import corpus_pipeline
    from listingspark.llm.arrays import staged

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = staged(out, name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(range(600)) <= set(kept["language"]) and not {2000, 2001, 2002} & set(kept["language"])
    toxic = {i for i in range(600) if i % 6 == 1}
    assert len(toxic & set(kept["toxicity"])) <= 2 and len(set(range(600)) - toxic - set(kept["toxicity"])) <= 2
    assert not {1000 + k for k in range(5)} & set(kept["near_duplicates"]) and {k * 6 for k in range(5)} <= set(kept["near_duplicates"])
    with_passage = [i for i in range(600) if i % 20 == 4 and i % 6 != 1]
    sizes = [len(kept["repeated_passages"][i]) for i in with_passage if i in kept["repeated_passages"]]
    assert max(sizes[1:]) < sizes[0]
    # each stage against brute force on what the one before it kept
    comps = brute_components(list(kept["toxicity"].items()), 5, 80, 100)
    assert set(kept["near_duplicates"]) == {i for i, (_, c) in comps.items() if c == i}
    gone = brute_removed(list(kept["near_duplicates"].items()), 100)
    assert kept["repeated_passages"] == {i: raw.decode(errors="ignore") for i, (raw, _) in gone.items()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept["repeated_passages"].items()}
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip([(None, 0, 0), *places], places))
    assert len({p[0] for p in places}) == -(-sum(lengths.values()) // 2048)


def test_run(spark, folder):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and os.path.isdir(folder)


@pytest.mark.parametrize("empty", ["documents", "labels"])
def test_run_over_empty_tables(spark, folder, tmp_path, empty):
    """No documents give no rows; without labels nothing is toxic."""
    import corpus_pipeline

    for t in ("documents", "labels"):
        rows = spark.read.parquet(f"{folder}/{t}.parquet")
        (rows.limit(0) if t == empty else rows.where("doc_id < 60 or doc_id >= 2000")).write.parquet(f"{tmp_path}/{t}.parquet")
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == (set() if empty == "documents" else set(range(60)))


def test_a_text_that_repeats_as_a_whole_is_emptied(spark):
    from listingspark.llm.suffix_dedup import repeats_stage

    text = "é".join(str(k) for k in range(100, 160))
    docs = spark.createDataFrame([(1, "before " + text, 5), (2, text, 7), (3, None, None)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in repeats_stage(spark, docs, "").collect()}
    assert out == {1: ("before " + text, 5), 2: ("", 0), 3: (None, None)}
