"""Joins, fingerprints, urls and the pipeline against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerwing.llm import op2_url_filter as op2
from ledgerwing.llm import op6_jaccard_join as op6
from ledgerwing.llm import op9_fingerprint as op9
from ledgerwing.llm.common import maybe_in, shingles, word_hashes

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_sets(rows, n):
    out = {}
    for r in rows:
        w = (r["text"] or "").translate(LOW).encode().split()
        out[r["doc_id"]] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def brute_components(sets, num, den):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            A, B = sets[a], sets[b]
            if A and B and den * len(A & B) >= num * len(A | B):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("n", "num", "den", "hot", "block"), [(3, 90, 100, 64, 1024), (3, 60, 100, 2, 3), (5, 80, 100, 1, 1)])
def test_components_of_links(near_docs, n, num, den, hot, block):
    sets = brute_sets(near_docs.collect(), n)
    want = brute_components(sets, num, den)
    rows = op6.jaccard_components(near_docs, n, num, den, hot=hot, block=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want and len(rows) == len(want)
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(want)


def test_join_odd_rows(spark, odd, empty):
    more = spark.createDataFrame([(None, "one"), (None, None), (13, "other text of the same id"), (40, "OTHER text of the same id")], "doc_id long, text string")
    rows = op6.jaccard_components(odd.select("doc_id", "text").union(more), 3, 90, 100).collect()
    assert len(rows) == odd.count() + 4
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r["component_id"])
    assert got[None] == [None, None] and got[14] == [13, 13] and got[40] == [13] and got[10] == [10] and got[12] == [12]
    assert op6.jaccard_components(empty).count() == 0


def test_bands_hold_all_links():
    for num, den in ((90, 100), (80, 100), (50, 100)):
        bands = op6.Bands(num, den)
        for a in range(1, 400):
            k = bands.band(a)
            assert bands.limit(k) >= a and (k == 0 or bands.limit(k - 1) < a)
            for b in range(a, min(400, den * a // num) + 1):
                shared = a  # the closest that two sets of these sizes can be
                if bands.linked(shared, a, b):
                    assert bands.band(b) - k in (0, 1)
                    least = next(s for s in range(a + 1) if bands.linked(s, a, b))
                    assert a + b - 2 * least <= bands.difference(bands.band(b))


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        other = np.unique(np.concatenate([base[rng.integers(0, 10) :], rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)]))
        base = np.unique(base)
        apart = int(np.bitwise_count(op6.bit_sketch(base, 3) ^ op6.bit_sketch(other, 3)).sum())
        assert apart <= len(np.setxor1d(base, other))
        bands = op6.Bands(90, 100)
        keys = [op6.segment_keys(s, 20, bands) for s in (base, other)]
        assert op6.folded(op6.bit_sketch(base, 4), 1).tolist() == op6.bit_sketch(base, 1).tolist()
        assert len(np.setdiff1d(keys[0], keys[1])) <= len(np.setxor1d(base, other))


def test_linked_sets_share_a_key():
    """At the largest difference allowed, for all sizes, in more keys than either set can spare."""
    rng = np.random.default_rng(6)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        bands = op6.Bands(num, den)
        for size in [*range(1, 60), *range(60, 900, 37)] * 3:
            base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            other = base
            for drop in range(size, -1, -1):  # the fewest shared shingles that still link
                cut = base[drop:]
                grown = np.unique(np.concatenate([cut, rng.integers(0, 2**63, rng.integers(0, 2), dtype=np.uint64)]))
                if len(cut) and bands.linked(len(cut), len(base), len(grown)):
                    other = grown
                    break
            top = max(bands.band(len(base)), bands.band(len(other)))
            a, b = (op6.segment_keys(s, top, bands) for s in (base, other))
            assert np.intersect1d(a, b).size >= max(1, op6.spare_keys(base, bands), op6.spare_keys(other, bands)), (num, size)


def test_few_sets_leave_too_many_segments_empty():
    """Only by rare chance has a set of some size keys that don't come from its shingles."""
    rng = np.random.default_rng(8)
    for num, den in ((90, 100), (80, 100)):
        bands = op6.Bands(num, den)
        for size in (20, 40, 60, 200):
            sets = [np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) for _ in range(300)]
            assert sum(op6.spare_keys(s, bands) == 0 for s in sets) <= 3, (num, size)


def test_many_unlinked_near_copies_give_few_pairs():
    """A unit gives at most a pair for each class at first, and all pairs in the end."""
    rng, bands, n = np.random.default_rng(9), op6.Bands(80, 100), 60
    base = np.unique(rng.integers(0, 2**63, 140, dtype=np.uint64))
    bits = op6.bit_sketch(base, bands.sketch_words(140)).tobytes()
    node = np.arange(n)
    one = lambda v: np.full(n, v)
    rows = pa.table({"key": one(7), "x": one(0), "y": one(0), "z": one(0), "node": node, "label": node, "size": one(140), "root": node, "bits": pa.array([bits] * n, pa.binary())})
    given = lambda most: np.concatenate(list(op6._pairs(rows, most, bands)), 1)
    first, last = given(1), given(n)
    assert 0 < (first[2] == 0).sum() <= n and set(first[1][first[2] == 1]) == set(node[1:]) and set(first[0][first[2] == 1]) == {7}
    assert {tuple(p) for p in last[:2, last[2] == 0].T} == {(a, b) for b in range(n) for a in range(b)} and not (last[2] == 1).any()


def test_sketches_tell_sets_a_little_too_far_apart():
    rng, bands = np.random.default_rng(10), op6.Bands(80, 100)
    for size in (50, 140, 600):
        most, refuted = bands.difference(bands.band(size)), 0
        for _ in range(50):
            base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            other = np.concatenate([base[most * 5 // 8 :], rng.integers(0, 2**63, most * 5 // 8, dtype=np.uint64)])
            apart = np.bitwise_count(op6.bit_sketch(base, bands.sketch_words(size)) ^ op6.bit_sketch(other, bands.sketch_words(size))).sum()
            refuted += int(apart) * 180 > 20 * 2 * size
        assert refuted >= 45, size


def test_short_texts_share_few_keys(spark):
    """Many unlike short texts give few candidates: the work grows with the rows, not with their square."""
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randint(0, 50_000)}" for _ in range(rng.randint(1, 40)))) for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands = op6.Bands(80, 100)
    shared = op6.shared_keys(op6.class_keys(docs.select("text"), 5, bands), op6.classes_of(docs, 5, bands), op6.HOT)
    assert shared.count() < 200


def test_common_passages_are_no_candidates(spark):
    """A passage in all texts is a hot key that they can spare; copies are found all the same."""
    rng = random.Random(2)
    common = [f"c{k}" for k in range(30)]
    texts = []
    for _ in range(300):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(150, 250))]
        texts.append(own[:50] + common + own[50:])
    rows = [(k, " ".join(t)) for k, t in enumerate([*texts, *[[*t[:-3], "x", "y", "z"] for t in texts[:40]]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands = op6.Bands(80, 100)
    shared = op6.shared_keys(op6.class_keys(docs.select("text"), 5, bands), op6.classes_of(docs, 5, bands), 16)
    assert shared.groupBy("key").count().agg(F.max("count")).first()[0] <= 16
    got = {r["doc_id"]: r["component_id"] for r in op6.jaccard_components(docs, hot=16).collect()}
    assert got == {k: k if k < 300 else k - 300 for k in range(340)}


def test_keys_of_the_same_classes_are_one(spark):
    """Texts that share a long passage meet in one key for each set of classes, and what is compared carries no sketches."""
    rng = random.Random(4)
    common = [f"c{k}" for k in range(150)]
    rows = [(k, " ".join(common + [f"w{rng.randint(0, 10**6)}" for _ in range(40 + k)])) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bands = op6.Bands(80, 100)
    classes = op6.classes_of(docs, 5, bands)
    shared = op6.shared_keys(op6.class_keys(docs.select("text"), 5, bands), classes, op6.HOT)
    keys = shared.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.max("alike").alias("alike")).collect()
    assert len({tuple(r["nodes"]) for r in keys}) == len(keys) and sum(r["alike"] for r in keys) > len(keys) > 0
    units = op6.comparisons(shared, classes.select("node", F.col("node").alias("label")), 2)
    assert units.count() and "bits" not in units.columns


def test_membership_filter(spark):
    ids = spark.createDataFrame([(k * 7,) for k in range(3000)] + [(None,)], "i long")
    rows = spark.range(21_000).selectExpr("id", "nullif(id, 14) AS x").withColumn("hit", maybe_in(ids)("x"))
    got = {r["id"]: r["hit"] for r in rows.collect()}
    assert all(got[k] for k in range(0, 21_000, 7) if k != 14) and not got[14]
    assert sum(got.values()) < 3400


def test_word_hashes_are_the_words_own():
    texts = ["a b  c", "", " \n", "c b", "xé yü\u00a0z " + "q" * 50, "B"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, offs = word_hashes(data, at)
    flat = [w for t in raw for w in t.split()]
    assert offs.tolist() == np.cumsum([0, *(len(t.split()) for t in raw)]).tolist()
    assert len(set(h.tolist())) == len(set(flat))
    for w, x in zip(flat, h, strict=True):
        assert word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0].tolist() == [x]
    assert word_hashes(data, at, lower=True)[0][-1] == h[1]
    long = ("ab " * 2_500_000 + "x" * 5_000_000 + " end").encode()
    h, offs = word_hashes(np.frombuffer(long, np.uint8), np.array([0, len(long)]))
    assert offs.tolist() == [0, 2_500_002] and len(set(h.tolist())) == 3


def plain_sketch(text, k=op9.K):
    w = text.encode().split()
    one = [word_hashes(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0][0] for x in w]
    return np.unique(shingles(np.array(one, np.uint64), 5))[:k]


def test_fingerprints_of_next(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id > 19").union(odd.select("doc_id", "text").dropDuplicates(["doc_id"]))
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_contains double, n_shingles_est double"
    got = {r["doc_id"]: r for r in op9.with_next(docs.repartition(5), op9._Compare(), schema).collect()}
    assert len(got) == len(texts)
    for k, (doc, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + after[:quarter]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = plain_sketch(text), plain_sketch(changed), plain_sketch(after)
        assert op9.unpack(r["fingerprint"]).tolist() == a.tolist() and op9.unpack(r["edited_fingerprint"]).tolist() == b.tolist()
        assert r["near_edited"] == op9.resemblance(a, b) and r["near_next"] == op9.resemblance(a, c)
        assert r["edited_contains"] == op9.containment(a, b) and r["n_shingles_est"] == op9.distinct_count(a)


def test_fingerprint_edges(spark, odd, empty):
    schema = "a long, b string, c string"
    use = lambda i, t, n: (i, t, n)
    assert op9.with_next(empty, use, schema).count() == 0
    assert [tuple(r) for r in op9.with_next(spark.createDataFrame([(7, "x")], "doc_id long, text string"), use, schema).collect()] == [(7, "x", "x")]
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a"), (None, "n"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, op9.with_next(rows, use, schema).collect()), key=str) == sorted([(None, "n", "a"), (1, "a", "a"), (1, "a", "b"), (2, "b", ""), (3, "", "n")], key=str)
    prints = op9.fingerprints(odd).collect()
    assert len(prints) == odd.count() and len({r["fingerprint"] for r in prints if r["doc_id"] in (10, 11, 12)}) == 1


def test_estimates():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 2**64, 30_000, dtype=np.uint64))
    a, b = pool[rng.permutation(len(pool))[:20_000]], pool[rng.permutation(len(pool))[:9_000]]
    x, y = op9.bottom(a, 1024), op9.bottom(b, 1024)
    shared = len(np.intersect1d(a, b))
    assert op9.resemblance(x, y, 1024) == pytest.approx(shared / len(np.union1d(a, b)), abs=0.06)
    assert op9.containment(y, x, 1024) == pytest.approx(shared / len(b), abs=0.12)
    assert op9.distinct_count(x, 1024) == pytest.approx(20_000, rel=0.1)
    assert op9.merge(x, y, 1024).tolist() == op9.bottom(np.concatenate([a, b]), 1024).tolist()


URLS = [
    None, "", "no-scheme.org/x", "http://Org/", "https://a.B.example.ORG/es/x?q=/en/1", "https://example.org/en/12#t", "https://x.example.org/en/2", "http://x.com/fr/", "http://x.com/fr",
    "http://x.com/de/a", "http://xcom/de/", "http://com/de/", "ftp://casino.net/", "http://x.net/casino-game", "http://x.net/hot-hot", "http://x.net/hot-win", "http://x.net/hotwin", "http://x.net/adulthood",
    "http://u:p@h.net:80/p?x=://y.com/fr/", "://?", "http://é.net/xxxé", "http://x.net/XXX", "a://b://c.org/",
]


def test_urls_against_sql(spark):
    import duckdb

    pages = spark.createDataFrame([(k, u, "h", k) for k, u in enumerate(URLS)], "page_id long, url string, html string, host long")
    got = sorted(map(tuple, op2.url_filter(pages).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    assert got == sorted(con.sql(op2.ORACLE_SQL).fetchall())
    verdict = {r[0]: r[3:5] for r in got}
    at = URLS.index
    assert verdict[at("https://a.B.example.ORG/es/x?q=/en/1")] == ("example.org/es/", "block")
    assert verdict[at("https://example.org/en/12#t")] == ("example.org/en/1", "block")
    assert verdict[at("https://x.example.org/en/2")] == ("org/", "allow")
    assert verdict[at("http://x.com/fr")] == (None, "allow") and verdict[at("http://xcom/de/")] == (None, "allow")
    assert [verdict[at(u)][1] for u in ("http://x.net/casino-game", "http://x.net/hot-hot", "http://x.net/hot-win", "http://x.net/hotwin", "http://x.net/adulthood")] == ["block", "allow", "block", "allow", "allow"]
    assert op2.url_filter(pages.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = cp.saved(cp.quality_classifier(spark, docs, sf))
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert sum((q == 1) == (i in left) for i, q in labels.items()) >= 0.97 * len(labels)
    ruled = cp.saved(cp.quality_rules(spark, kept, sf))
    assert ruled.columns == docs.columns and ruled.count() <= kept.count()
    texts = {r["doc_id"]: r for r in ruled.collect()}
    single = cp.saved(cp.near_copies(spark, ruled, sf))
    assert single.columns == docs.columns
    roots = brute_components(brute_sets(list(texts.values()), 5), 80, 100)
    assert {r["doc_id"] for r in single.collect()} == set(roots.values())
    pieces = cp.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("want")).collect()
    assert {r["doc_id"] for r in pieces} == set(roots.values()) and all(r["n"] == r["want"] for r in pieces)


#: Columns under the names that stages use inside, or give.
CLASH = ("node", "_node", "_node0", "stays", "keeper", "score", "_score", "score0", "kept", "distance", "n_words", "base_failed", "id", "_d", "_g", "_w", "in_text", "sequence_id", "n_tokens", "start")


def test_pipeline_odd_rows(spark, odd):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names, empty tables: in every stage."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    rows = docs.union(spark.createDataFrame([(None, "one", "en", "a", 3)], docs.schema))
    rows = rows.select("*", *[F.lit(f"v {c}").alias(c) for c in CLASH])
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, rows, sf)
        assert got.columns == rows.columns, name
        assert all(r[c] == f"v {c}" for r in got.collect() for c in CLASH), name
    kept = [r["doc_id"] for r in cp.near_copies(spark, rows, "").collect()]
    assert sorted(x for x in kept if x is not None) == [10, 11, 12, 13, 15, 16, 17, 18, 19] and kept.count(None) == 1
    assert {r["doc_id"] for r in cp.quality_rules(spark, rows, sf).collect()} == set()
    pieces = cp.packing(spark, rows, "").collect()
    assert sorted({r["doc_id"] for r in pieces if r["doc_id"] is not None}) == list(range(10, 20))
    for _, stage in cp.STAGES:
        assert stage(spark, rows.limit(0), sf).count() == 0


def test_near_copies_lose_no_text(spark):
    """Rows of one id with unlike texts are judged each for itself; of equal rows one stays."""
    import corpus_pipeline as cp

    rng = random.Random(4)
    a, b, c = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (9, b), (7, b), (7, c), (7, c), (None, c), (8, ""), (8, ""), (8, None), (2, a.upper() + "!")]
    kept = cp.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(2, a.upper() + "!"), (5, b), (7, c), (None, c), (8, ""), (8, ""), (8, None)], key=str)


def test_long_texts_are_merged_from_parts():
    rng = random.Random(8)
    for n in (4095, 4096, 4099, 4100, 4101, 9000):
        text = " ".join(f"w{rng.randrange(500)}" for _ in range(n))
        assert op9.sketch(text.encode()).tolist() == plain_sketch(text).tolist()
