"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from listingspark.llm import arrays, bpe, fingerprints, language, licenses, media, ngram_join, packing, suffix_dedup, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
rng = random.Random(7)
WORDS = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(rng.choices(WORDS, k=n))


@cache
def corpus() -> list[tuple[int | None, str | None, str]]:
    """(doc_id, text, a column with a clashing name)"""
    base, passage = prose(120), prose(40)
    rows: list[str | None] = [None, "", "   \n", "one", "two words", "one", "ÄÖ ü 漢字 \U0001f600", "a" * 3000, base, base, "x " + base, base + " tail", base.upper(), base.replace(" ", "\t", 3)]
    rows += [prose(30) + " " + passage + " " + prose(25) for _ in range(6)] + [passage, prose(4000), prose(3), "ab" * 200, "1 2 3 4"]
    for k in range(8):
        words = base.split()
        words[k * 9] = "changed"
        rows.append(" ".join(words))
    return [(i * 3, t, "own") for i, t in enumerate(rows)]


SCHEMA = "doc_id long, text string, doc string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame(rows + [rows[8]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None, n: int) -> set:
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("kinds", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)])
@pytest.mark.parametrize("channels", [1, 3])
def test_png_round_trip(kinds, channels):
    for rows in (1, 2, 37):
        raw = bytes(rng.choices(range(256), k=rows * 12)) if rows > 1 else b"abcdefghijkl"
        samples, found = media.png_decode(media.png_encode(raw, 12 // channels, channels, kinds))
        assert samples.tobytes() == raw and found == channels


def test_png_damage_is_found():
    good = media.png_encode(b"q" * 192 * 4, 64)
    for at in (3, 20, len(good) // 2, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(media.MediaError):
            media.png_decode(bytes(bad))
    with pytest.raises(media.MediaError):
        media.png_decode(good[:-12])


def test_media_columns(docs, empty):
    rows = media.media_columns(docs).collect()
    texts = dict((i, t) for i, t, _ in corpus())
    assert len(rows) == docs.count()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert r.n_bytes == len(raw) and bytes(r.read_back) == payload and len(payload) % 192 == 0 and len(r.image_hash) == 8
    assert media.media_columns(empty).count() == 0


# ---------------------------------------------------------------- 2

URLS = ["http://a.b.Example.org/en/1", "https://example.org/es/x?q#f", "http://example.org", "http://com/fr/", "http://xcom/fr/", "http://www.com/de", "no url", None, "", "http://org?x://y/", "ftp://EXAMPLE.ORG/EN/1", "http://notexample.org/es/"]


@pytest.mark.parametrize("limit", [100, 0])
def test_url_verdicts(spark, limit):
    rules = [*url_filter.RULES, ("ORG", "/", "allow"), (None, "/", "block")]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    for r in url_filter.url_verdicts(pages, table, broadcast_rules=limit).collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", URLS[r.page_id % len(URLS)] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), a == "block", h + p, a) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((max(fits)[2], max(fits)[3]) if fits else (None, "allow"))


def test_a_rule_s_path_is_no_part_of_a_host(spark):
    rules = spark.createDataFrame([("b.c", "d/", "block"), ("x.org", "/a", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://b.cd/"), (2, "http://x.org/ab"), (None, "http://" + "s." * 300 + "x.org/a" + "b" * 50_000)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, rules).collect()} == {1: "allow", 2: "block", None: "block"}


def test_url_verdicts_without_rules_or_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.url_verdicts(pages, rules).first().verdict == "allow"
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0


# ---------------------------------------------------------------- 3


def brute_components(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t, *_ in rows}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if comp[i] < comp[j] and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    comp[j] = comp[i]
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in ids}


@pytest.mark.parametrize(("n", "num", "den", "repeated"), [(4, 85, 100, True), (5, 80, 100, False)])
def test_ngram_components(docs, spark, n, num, den, repeated):
    want = brute_components(corpus(), n, num, den)
    if not repeated:
        docs = spark.createDataFrame(corpus(), SCHEMA)
    rows = ngram_join.ngram_components(docs, n=n, num=num, den=den).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r


def test_ngram_chain_and_nulls(spark, monkeypatch):
    """A chain of near copies, whose ends don't link, is one component also when groups hold few sets."""
    monkeypatch.setattr(ngram_join, "GROUP", 4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        words[k] = f"v{k}"
        rows.append((k, " ".join(words)))
    rows += [(None, "lone words here"), (None, None)]
    found = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n=2, num=90, den=100).collect()}
    want = brute_components(rows[:-2], 2, 90, 100)
    assert {k: v for k, v in found.items() if k is not None} == {k: v[1] for k, v in want.items()}
    assert found[None] is None


def test_ngram_empty(empty):
    assert ngram_join.ngram_components(empty).count() == 0


def test_near_duplicates_of_rows_without_an_own_id(spark):
    """Rows with a null or shared doc_id go only where their own texts link."""
    a, b, c, d, e, f = (prose(60) for _ in range(6))
    kept = [(3, a), (7, b), (7, c), (None, d), (None, e), (9, " "), (9, None), (None, ""), (None, ""), (12, f)]
    dropped = [(None, a + " tail"), (None, b + " tail"), (None, d), (8, c + " tail"), (3, a), (9, " "), (None, f)]
    docs = spark.createDataFrame([(*r, "own") for r in kept + dropped], "doc_id long, text string, source string").repartition(3)
    out = ngram_join.near_duplicate_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(kept, key=repr)


def test_star_components(spark):
    pairs = [(i + 1, i) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {r.v: r.comp for r in ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 31)) and all(found[i] == 100 for i in range(101, 140))


def test_thousands_of_rows_of_one_key(spark):
    """Rows of a key are one document with all their links; rows without a key are documents of their own."""
    base, other, third = prose(60), prose(60), prose(60)
    rows = [(5, base)] * 12_000 + [(7, base + " end"), (5, other), (3, other + " end"), (None, third), (None, third), (2, third), (None, prose(60)), (None, None)]
    out = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    assert {r.component_id for r in out if r.doc_id in (3, 5, 7)} == {3}
    assert sorted((r.n_shingles, r.component_id or -1) for r in out if r.doc_id is None) == [(0, -1), (56, -1), (56, 2), (56, 2)]


# ---------------------------------------------------------------- 4


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.packed_documents(docs, path).collect()
    texts = {i: t for i, t, _ in corpus()}
    pieces = {}
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        part = ids[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append(r.length)
        assert r.length == 2048 or r.start + r.length == len(ids)
    assert set(pieces) == set(texts)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in rows) // 2048)
    assert packing.packed_documents(empty, path).count() == 0


def test_cached_ids_are_the_library_s(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    alphabet = [*"abcABC 019'!é\t\n\x0b\x0c\x1c\x85  　漢İſ", "́", "'s", "'RE", "<|endoftext|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    rows = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(tokenizer.encode(texts[r.key], add_special_tokens=False).ids + [0], "<u4").tobytes()), texts[r.key]


def test_control_characters_have_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, own = Tokenizer.from_file(path), packing.CachedTokenizer(open(path).read())
    for text in [*map(chr, range(256)), "a \x1b[0m b", "x\x00\x7fy", "\x1f\x1fé"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_crossover_keeps_every_piece():
    r = random.Random(3)
    sizes = [r.randint(1, 100) for _ in range(300)]
    a, b = (packing.decreasing(sizes, 100, r, 0.3) for _ in range(2))
    for p in (a, b, packing.crossed(a, b, r), packing.evolved(sizes, 100, "x")):
        assert sorted(i for x in p.bins for i in x) == list(range(300))
        assert all(sum(sizes[i] for i in x) == 100 - f for x, f in zip(p.bins, p.free))


def least_bins(sizes: list[int], capacity: int) -> int:
    """By trying every assignment."""
    best = len(sizes)

    def put(i: int, free: list[int]) -> None:
        nonlocal best
        if len(free) >= best:
            return
        if i == len(sizes):
            best = len(free)
            return
        for f in sorted({f for f in free if f >= sizes[i]}):
            k = free.index(f)
            put(i + 1, free[:k] + [f - sizes[i]] + free[k + 1 :])
        put(i + 1, [*free, capacity - sizes[i]])

    put(0, [])
    return best


def test_packing_of_few_pieces_is_best():
    for seed in range(25):
        g = random.Random(seed)
        sizes = sorted((g.randint(180, 520) for _ in range(10)), reverse=True)
        assert len(packing.evolved(sizes, 1000, f"s{seed}", births=400).bins) == least_bins(sizes, 1000), sizes


def triplets(n: int, g: random.Random) -> list[int]:
    """Sizes of n bins that three pieces fill exactly."""
    out = []
    for _ in range(n):
        a, b = g.randint(520, 760), g.randint(520, 760)
        out += [a, b, 2048 - a - b]
    return sorted(out, reverse=True)


def test_crossover_and_migration_save_bins(spark):
    sizes = triplets(80, random.Random(4))
    first = len(packing.decreasing(sizes, 2048, random.Random(0), 0.0).bins)
    one = packing.evolved(sizes, 2048, "one")
    assert 80 <= len(one.bins) < first
    # an island goes on from its elite and its guest, and never gets worse
    other = packing.evolved(sizes, 2048, "two")
    both = packing.evolved(sizes, 2048, "three", [one.bins, other.bins])
    assert len(both.bins) <= min(len(one.bins), len(other.bins))
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "row long, piece int, length long")
    alone, several = (packing.pack(pieces, islands=k, epochs=e, rounds=1).select("sequence_id").distinct().count() for k, e in ((1, 1), (4, 3)))
    assert several <= alone < first


# ---------------------------------------------------------------- 5


def test_fingerprints_of_edits(docs, spark):
    rows = sorted(corpus(), key=lambda r: -r[0])
    texts = [t or "" for _, t, _ in rows]
    assert fingerprints.edited_text("abcdefg", "XY") == "abcdeXY" and fingerprints.edited_text("abcdefghi", "X") == "abcdefX"
    dealt = fingerprints.with_next(spark.createDataFrame(corpus(), SCHEMA), bucket_bytes=2000)
    seen = {}
    for part in dealt.rdd.glom().collect():
        by = {}
        for r in part:
            by.setdefault(r.bucket, []).append(r)
        for content in by.values():
            for a, b in zip(content, content[1:]):
                if not a.ahead:
                    seen[a.id] = b.id
    assert seen == {a[0]: b[0] for a, b in zip(rows, [*rows[1:], rows[0]])}
    assert len(set(r.bucket for r in dealt.collect())) > 5
    own = fingerprints.sketches(pa.array(texts))
    for i, j in [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(150)]:
        a, b = shingles(texts[i], 5), shingles(texts[j], 5)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(fingerprints.resemblance(own[i], own[j]) - true) < (0.12 if max(len(a), len(b)) > 256 else 1e-9)


def test_neighbours_of_repeated_and_null_keys(spark):
    """Rows follow one another by descending key, nulls last, then by a hash of their text; each has one follower, the last the first."""
    rows = [(None, prose(5)) for _ in range(40)] + [(3, "same")] * 30 + [(3, prose(4)) for _ in range(20)] + [(9, None), (9, "")]
    dealt = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket_bytes=150)
    pairs = []
    for part in dealt.rdd.glom().collect():
        closed = False
        for a, b in zip(part, part[1:]):
            assert a.bucket == b.bucket
            if not closed:
                pairs.append(((a.id, a.text), (b.id, b.text)))
            closed = closed or b.ahead
    assert len(pairs) == len(rows) and sorted(map(str, (a for a, _ in pairs))) == sorted(str((i, t or "")) for i, t in rows) == sorted(map(str, (b for _, b in pairs)))
    assert {a for (a, _), (b, _) in pairs if a != b} == {9, 3, None}
    assert fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_merge(spark):
    whole = prose(3000).split()
    parts = [" ".join(whole[:1700]), " ".join(whole[1696:])]
    a, b = fingerprints.sketches(pa.array(parts))
    assert np.array_equal(fingerprints.merged(a, b), fingerprints.sketches(pa.array([" ".join(whole)]))[0])
    assert abs(fingerprints.distinct_count(fingerprints.merged(a, b)) / 2996 - 1) < 0.25
    df = fingerprints.fingerprints(spark.createDataFrame([(1, parts[0], "g"), (2, parts[1], "g"), (3, None, "h")], "doc_id long, text string, g string"))
    merged = fingerprints.merge_sketches(df.selectExpr("'g' as g", "sketch"), "g").first()
    assert np.array_equal(np.frombuffer(merged.sketch, "<u8"), fingerprints.merged(a, b))


def test_merging_holds_no_group_in_a_buffer(spark):
    sets = [np.sort(np.random.default_rng(i).integers(0, 1 << 63, 256).astype("<u8")) for i in range(60)]
    df = spark.createDataFrame([("hot", s.tobytes()) for s in sets] + [("cold", sets[0].tobytes())], "g string, sketch binary")
    merged = fingerprints.merge_sketches(df, "g", parts=2)
    want = {"hot": np.unique(np.concatenate(sets))[:256], "cold": sets[0]}
    assert {r.g: np.frombuffer(r.sketch, "<u8").tolist() for r in merged.collect()} == {g: w.tolist() for g, w in want.items()}
    assert "collect_set" not in merged._jdf.queryExecution().toString()


# ---------------------------------------------------------------- 6


def by_scan(vectors: np.ndarray, keys: np.ndarray, query: np.ndarray, k: int = 15) -> list[tuple[int, float]]:
    score = np.round(vectors @ query, 9)
    return [(keys[i], score[i]) for i in np.lexsort((keys, -score)) if score[i] > 0][:k]


def test_block_max_is_exact():
    g = np.random.default_rng(5)
    vectors = g.random((700, 40)) * (g.random((700, 40)) < np.where(np.arange(40) % 2, 0.25, 0.06))
    vectors = vectors[vectors.any(axis=1)]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[50:90] = vectors[40]
    keys = g.permutation(len(vectors)).astype(np.int64)
    places = [np.flatnonzero(v).astype(np.int32) * 3 for v in vectors]
    index = toxicity.BlockMaxIndex(places, [v[v > 0] for v in vectors], keys, g.random(len(vectors)), np.ones(len(vectors)))
    assert len(set(index.block)) > 8 and 0 < len(index.rows) < 40
    for n in (1, 3, 40):
        for _ in range(30):
            query = np.zeros(40)
            query[g.choice(40, n, replace=False)] = g.random(n)
            query /= np.linalg.norm(query)
            ((at, cosine),) = index.nearest([((np.flatnonzero(query) * 3).astype(np.int32), query[query > 0])])
            want = by_scan(vectors, keys, query)
            assert np.allclose(cosine, [c for _, c in want]) and np.mean(index.keys[at] == [k for k, _ in want]) > 0.9
    ((at, _),) = index.nearest([(places[5], vectors[5][vectors[5] > 0])], without=[int(keys[5])])
    assert keys[5] not in index.keys[at]
    assert len(index.nearest([(np.array([1], np.int32), np.ones(1))])[0][0]) == 0


def test_block_max_is_exact_in_small_blocks(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    test_block_max_is_exact()


@pytest.fixture(scope="module")
def judged():
    """(doc_id, text, toxic): a toxic text has an insult in twenty words."""
    rows = []
    for i in range(600):
        words = prose(40).split()
        if i % 5 == 0:
            for at in (3, 30):
                words[at] = rng.choice(["blockhead", "Nitwit!", "dunce"])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_toxicity_by_full_scan(spark, judged):
    docs = spark.createDataFrame([*judged, (600, None, None), (601, "", None)], "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.where("doc_id % 2 = 0"), docs, examples=150)
    assert len(model.index.keys) == 75 + 60  # half of each label at most
    rows = toxicity.toxicity_columns(docs, model).collect()
    texts = {i: t or "" for i, t, *_ in judged} | {600: "", 601: ""}

    def vector(text):
        raw = text.encode()
        _, places, n = toxicity.word_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        out = np.zeros(1 << toxicity.PLACES)
        out[places] = toxicity.unit(places, n, model.weight) if len(n) else 0
        return out

    matrix = np.stack([vector(texts[k]) for k in model.index.keys.tolist()])
    labels = dict(zip(model.index.keys.tolist(), zip(model.index.labels, model.index.mass)))
    for r in rng.sample(rows, 60):
        near = by_scan(matrix, model.index.keys, vector(texts[r.doc_id]))
        votes = [(c * c * labels[k][1], labels[k][0]) for k, c in near]
        vote = (sum(w * y for w, y in votes) + toxicity.SMOOTH * model.rate) / (sum(w for w, _ in votes) + toxicity.SMOOTH)
        assert abs(r.toxic_score - model.calibrated(np.array([vote]))[0]) < 1e-6


def test_toxicity_held_out(spark, judged):
    docs = spark.createDataFrame([*judged, *judged[:20], (600, None, None), (601, "", None), (None, "dunce", 1)], "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.where("doc_id % 2 = 0"), docs)
    # a clashing column gives way to the operator's own
    out = toxicity.toxicity_columns(docs.selectExpr("*", "'own' as toxic_score"), model).collect()
    assert len(out) == 623 and all(0 <= r.toxic_score <= 1 for r in out)
    held = [r for r in out if r.doc_id and r.doc_id % 2 and r.doc_id < 600]
    assert sum((r.toxic_score >= 0.7) == (r.toxic == 1) for r in held) / len(held) > 0.98
    assert len({r.toxic_score for r in out if r.doc_id in (600, 601)}) == 1 and all(r.toxic_score < 0.3 for r in out if r.doc_id in (600, 601))
    # one word doesn't make a long text toxic, and many do
    few, many = prose(3000) + " dunce", " ".join(prose(20) + " dunce" for _ in range(100))
    scores = {r.doc_id: r.toxic_score for r in toxicity.toxicity_columns(spark.createDataFrame([(0, few), (1, many)], "doc_id long, text string"), model).collect()}
    assert scores[0] < 0.3 and scores[1] > 0.7
    assert toxicity.learn(docs.where("false"), docs) is None
    assert toxicity.toxicity_columns(docs, None).agg({"toxic_score": "max"}).first()[0] == 0


def test_the_driver_passes_on_some_bytes_a_word(spark, judged):
    """The examples travel as words and counts; the index that workers make of them is that of their weights."""
    docs = spark.createDataFrame(judged, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs, docs)
    texts = {i: t.encode() for i, t, _ in judged}
    vectors = [toxicity.word_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1:] for raw in map(texts.get, model.index.keys.tolist())]
    n_words = sum(len(p) for p, _ in vectors)
    assert len(model.packed) < 6 * n_words
    made = toxicity.BlockMaxIndex([p for p, _ in vectors], [toxicity.unit(p, n, model.weight) for p, n in vectors], model.index.keys, model.index.labels, model.index.mass)
    assert all(np.array_equal(x, getattr(model.index, k)) for k, x in vars(made).items())


def test_votes_are_calibrated():
    g = np.random.default_rng(3)
    true = g.random(4000)
    labels = (g.random(4000) < true).astype(float)
    distorted = true**2
    a, b = toxicity.fitted_curve(distorted, labels, np.ones(4000))
    p = 1 / (1 + np.exp(-(a * toxicity._logit(distorted) + b)))
    for low in (0.2, 0.4, 0.6):
        some = (p >= low) & (p < low + 0.2)
        assert abs(labels[some].mean() - p[some].mean()) < 0.06


# ---------------------------------------------------------------- 7


def test_language_mixture(spark):
    alphabets = {"aa": "abcdefgh", "bb": "stuvwxyz", "cc": "äöüßéèàç"}
    word = lambda k: "".join(rng.choices(alphabets[k], k=rng.randint(2, 7)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(list(alphabets) * 30)]
    model = language.learn(spark.createDataFrame(rows + [(900, "zz", None), (901, None, "aa")], "doc_id long, text string, lang string"))
    assert list(model) == ["aa", "bb", "cc"]
    asked = [(0, text("aa", 50)), (1, text("bb", 5)), (2, text("cc", 200)), (3, text("aa", 60) + " " + text("bb", 20)), (4, None), (5, ""), (6, "123 !?"), (7, "漢字")]
    out = {r.doc_id: r for r in language.language_columns(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [out[i].lang_pred for i in range(3)] == ["aa", "bb", "cc"] and out[0].lang_score == 1
    assert out[3].lang_pred == "aa" and abs(out[3].lang_score - 0.75) < 0.08 and set(out[3].lang_shares) == {"aa", "bb"}
    assert all(out[i].lang_pred == "und" and out[i].lang_score == 0 for i in (4, 5, 6)) and out[7].lang_pred != "und"
    nothing = language.language_columns(spark.createDataFrame(asked, "doc_id long, text string"), {})
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_texts_in_four_languages(spark):
    alphabets = {"aa": "abcdefgh", "bb": "stuvwxyz", "cc": "äöüßéèàç", "dd": "ijklmnop"}
    text = lambda k, n: " ".join("".join(rng.choices(alphabets[k], k=rng.randint(2, 7))) for _ in range(n))
    model = language.learn(spark.createDataFrame([(i, text(k, 60), k) for i, k in enumerate(list(alphabets) * 30)], "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(0, " ".join(text(k, n) for k, n in zip(alphabets, (64, 48, 48, 40), strict=True)))], "doc_id long, text string")
    shares = language.language_columns(mixed, model).first().lang_shares
    assert set(shares) == set(alphabets) and all(abs(shares[k] - n / 200) < 0.08 for k, n in zip(alphabets, (64, 48, 48, 40), strict=True))


def test_mixtures_by_brute_force():
    """The same shares and sets as plain loops over segments and languages give."""
    g = np.random.default_rng(9)
    table = np.log(g.dirichlet(np.ones(1 << language.BITS) * 0.01, 3)).clip(-30).T.astype(np.float32)
    texts = [prose(n) for n in (1, 7, 8, 9, 40, 200)] + ["", "1 2", "a"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    got, chosen = language.mixtures(np.frombuffer(b"".join(raw), np.uint8), offsets, table)
    grams = language._trigrams(np.frombuffer(b"".join(raw), np.uint8))
    for i, text in enumerate(texts):
        words = [(m.start(), m.end()) for m in re.finditer("[a-z]+", text)]
        segments = [words[k : k + language.SEGMENT] for k in range(0, len(words), language.SEGMENT)]
        if not segments:
            assert not got[i].any()
            continue
        like = []
        for s in segments:
            a, b = offsets[i] + s[0][0], min(offsets[i] + s[-1][1] + 1, offsets[i + 1])
            total = np.array([sum(float(table[x, k]) for x in grams[a:b]) for k in range(3)]) * language.WEIGHT
            like.append(np.exp(total - total.max()) + 1e-12)

        def fit(allowed):
            share = [1 / len(allowed) if k in allowed else 0.0 for k in range(3)]
            for _ in range(language.ROUNDS):
                parts = [[x[k] * share[k] for k in range(3)] for x in like]
                share = [sum(p[k] / sum(p) for p in parts) / len(like) for k in range(3)]
            return share, sum(np.log(sum(x[k] * share[k] for k in range(3))) for x in like)

        order = np.argsort(-np.array(fit([0, 1, 2])[0]), kind="stable").tolist()
        scores = [fit(order[:n])[1] - 0.5 * (n - 1) * np.log(len(like) + 1) for n in (1, 2, 3)]
        best = max(range(3), key=lambda n: (scores[n] - (1e-9 * n), -n))
        assert chosen[i] == best + 1 and np.allclose(got[i], fit(order[: best + 1])[0], atol=1e-3), text


def test_language_stage_where_nothing_is_learnt(spark):
    rows = [(0, "some words", None), (1, "漢字", None), (2, "12 !", None), (3, "", None), (None, "é", None), (4, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.language_stage(spark, docs, "")
    assert out.columns == docs.columns and {r.text for r in out.collect()} == {"some words", "漢字", "é"}


# ---------------------------------------------------------------- 8


def brute_removed(rows, length):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(b for b, g in zip(raw, gone) if not g), sum(gone)
    return out


@pytest.mark.parametrize(("crowd", "frequent"), [(4096, 4096), (2, 4096), (4096, 2), (2, 2)])
def test_repeats(docs, monkeypatch, crowd, frequent):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1500)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 3000)
    want = brute_removed(corpus(), 100)
    rows = suffix_dedup.without_repeats(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (bytes(r.text_kept), sum(x.high - x.low for x in r.removed)) == want[r.doc_id], r.doc_id


def test_repeats_of_none(empty):
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_repeats_of_nameless_and_shared_keys(spark):
    """Equal rows with a key are one document; other rows of a key, and rows without one, are documents of their own."""
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(5, a), (5, a), (5, b), (None, c), (None, c), (None, b), (7, a + b), (1, None)]
    found = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", sum(x.high - x.low for x in r.removed)) for r in found)
    assert len(found) == len(rows)
    assert [g for g in gone if g[:2] == (False, 5)] == sorted([(False, 5, a, 0), (False, 5, a, 0), (False, 5, b, 0)])
    assert sorted(g[3] for g in gone if g[0] and g[2] == c) == [0, len(c)] and [g[3] for g in gone if g[0] and g[2] == b] == [len(b)]
    assert [g[3] for g in gone if g[1] == 7] == [len(a + b)] or [g[3] for g in gone if g[1] == 7] == [len(a) + len(b)]


@pytest.mark.parametrize("collide", [False, True])
def test_suffix_order(monkeypatch, collide):
    if collide:
        monkeypatch.setattr(suffix_dedup, "span_hash", lambda prefix, start, end: np.zeros(len(start), np.uint64))
    data = np.frombuffer(bytes(rng.choices(b"ab", k=900)) + b"c" * 300, np.uint8)
    starts = np.arange(1100)
    order, kind = suffix_dedup.repeated_suffixes(data, starts, length=40, shallow=16)
    strings = [data[s : s + 40].tobytes() for s in starts]
    assert [strings[i] for i in order] == sorted(strings[i] for i in order)
    alone = {s for s in set(strings) if strings.count(s) == 1}
    assert set(order.tolist()) == {i for i, s in enumerate(strings) if s not in alone}
    assert len({(strings[i], k) for i, k in zip(order, kind)}) == len({strings[i] for i in order})


def test_blind_trie():
    strings = [bytes(rng.choices(b"abc", k=12)) for _ in range(300)]
    trie = suffix_dedup.BlindTrie(strings[0])
    for s in strings[1:]:
        trie.add(s)
    assert trie.ordered() == sorted(set(strings))


# ---------------------------------------------------------------- 9


MIT_BODY = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the &quot;Software&quot;), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


def test_license_scan(spark):
    mit, gpl = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0-only"][0]
    rows = [
        (1, "http://h.org/a/LICENSE", f"<p>{mit}</p>"), (2, "http://h.org/a/b/c.html", "<p>words</p>"), (3, "http://h.org/a/b/", f"<div>{gpl}</div>"), (4, "http://h.org/x.html", "<p>none</p>"),
        (5, "http://other.org/a/b/c", None), (6, None, f"<p>{mit}</p>"), (7, "http://h.org/a/d", ""), (8, "http://h.org/a/b", "<p>nothing here</p>"), (9, "http://h.org/a/e", f"<p>{gpl} {prose(30)}</p>"), (10, "http://h.org/ab/c", "x"),
        (11, "http://i.org/p/LICENSE", f"<pre>{MIT_BODY}</pre>"), (12, "http://i.org/p/q/r", "x"), (13, "http://i.org/s/t.js", f"<pre>{APACHE_HEADER}</pre>"), (14, "http://i.org/u", f"<p>{prose(9)}. This project is released under the MIT License. See the LICENSE file.</p>"),
        (15, "http://i.org/v", "<h1>Apache License</h1><h2>Version 2.0, January 2004</h2>"), (16, "http://i.org/w", f"<p>{prose(3000)}</p>"), (16, "http://i.org/w", f"<p>{prose(3000)}</p>"), (None, "http://j.org/COPYING", f"<p>{gpl}</p>"), (None, "http://j.org/k", "<p>x</p>"),
    ]
    found = licenses.license_scan(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    out = {r.page_id: (r.license_id, r.origin, r.license_directory) for r in found}
    assert len(found) == len(rows)
    assert out[1] == ("MIT", "header", None) and out[3] == ("GPL-3.0-only", "header", None) and out[6] == ("MIT", "header", None)
    assert out[2] == ("GPL-3.0-only", "inherited", "h.org/a/b/") and out[8] == ("GPL-3.0-only", "inherited", "h.org/a/b/") and out[7] == ("MIT", "inherited", "h.org/a/")
    assert out[9] == ("GPL-3.0-only", "header", None)
    assert out[4][0] is out[5][0] is out[10][0] is out[16][0] is None
    assert out[11] == ("MIT", "header", None) and out[12] == ("MIT", "inherited", "i.org/p/")
    assert out[13][0] == "Apache-2.0" and out[14] == ("MIT", "header", None)
    assert sorted(r.origin for r in found if r.page_id is None) == ["header", "inherited"]
    assert licenses.license_scan(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(("name", "license_id"), [("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("GPL-3", "GPL-3.0-only"), ("LGPL-3", "LGPL-3.0-only"), ("MPL-2.0", "MPL-2.0")])
def test_whole_licence_files(spark, name, license_id):
    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("no licence texts here")
    rows = [(1, "http://a.org/LICENSE", f"<pre>{open(path).read()}</pre>"), (2, "http://a.org/b", "<p>x</p>")]
    rows += [(3 + i, f"http://c.org/{i}", f"<p>{prose(40)}</p>") for i in range(30)]
    out = {r.page_id: r.license_id for r in licenses.license_scan(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == out[2] == license_id and set(list(out.values())[2:]) == {None}


# ---------------------------------------------------------------- 10


def test_bpe_is_the_library_s():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own = Tokenizer.from_file(path), bpe.RankArrayBPE(open(path, "rb").read())
    alphabet = [*"abcdeABC  019'!\t\néß　漢\x85\x1c Ⅷ²\U0001f600", "'s", "'ll", "<|endoftext|>", "hello", "  "]
    for k in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40))) + ("xyz" * rng.randint(60, 120) if k % 50 == 0 else "")
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids and own.decode(np.array(ids)) == tokenizer.decode(ids, skip_special_tokens=False)
    word = "".join(rng.choices("etaoin", k=100)).encode()
    assert own.word(word) == own._heap(word)


def test_bpe_codes(docs, empty):
    rows = bpe.bpe_codes(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    texts = {i: t for i, t, _ in corpus()}
    assert all(r.decoded == (texts[r.doc_id] or "") for r in rows) and len(rows) == docs.count()
    assert bpe.bpe_codes(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# ---------------------------------------------------------------- helpers


def test_bitmap(spark):
    hashes = arrays.mix(np.arange(1, 5000, dtype=np.uint64))
    found = arrays.hash_bitmap(spark.createDataFrame([(int(x),) for x in hashes[:2000].view(np.int64)], "k long"), 20)
    assert found.has(hashes[:2000]).all() and found.has(hashes[2000:]).mean() < 0.01


def test_digest():
    assert bpe.digest(np.array([1, 2], "<u4")) == hashlib.sha256(b"\1\0\0\0\2\0\0\0").hexdigest()


def test_license_pages_are_cleaned_once(spark, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return df

    monkeypatch.setattr(licenses, "staged", kept)
    pages = spark.createDataFrame([(1, "http://a.example/LICENSE", "<p>MIT License</p>")], "page_id long, url string, html string")
    assert [r.license_id for r in licenses.license_scan(pages).collect()] == ["MIT"]
    assert plans["units"].count("<script") == 1
