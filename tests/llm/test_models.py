"""Operators that learn: held-out accuracy, brute-force sums, odd rows."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwing.llm import op3_language_id as op3
from ledgerwing.llm import op4_quality as op4
from ledgerwing.llm import op7_quality_rules as op7
from ledgerwing.llm import op10_lm as op10

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op3.op3_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark, odd, empty):
    model = op3.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = collections.defaultdict(list)
    for r in op3.predict(odd, model).collect():
        got[r["doc_id"]].append(r["lang_pred"])
    assert got[10] == got[11] == got[12] == ["und"] and len(got[14]) == 2
    assert all(p != "und" for k, v in got.items() if k > 12 for p in v)
    assert op3.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in op3.predict(odd, op3.fit(empty)).collect()} == {"und"}


def test_language_windows_brute():
    texts = ["Ab c", "", "é", "xyz!"]
    raw = [t.encode() for t in texts]
    points, at = op3.code_points(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert "".join(map(chr, points)) == "ab céxyz "
    assert at.tolist() == [0, 4, 4, 5, 9]
    for order in op3.ORDERS:
        h = op3.windows(points, at, order)
        for a, b in zip(at, at[1:], strict=False):
            assert [(x < op3.BUCKETS) for x in h[a:b]] == [k + order <= b for k in range(a, b)]
    assert op3.windows(points, at, 2)[0] == op3.windows(*op3.code_points(np.frombuffer(b"zAB", np.uint8), np.array([0, 3])), 2)[1]


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op4.op4_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert rows and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_odd_rows(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 7, 0)], labels.schema)
    model = op4.fit(docs, labels.union(extra))
    rows = op4.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0].asDict().keys() == {*odd.columns, "score"}
    assert op4.score(empty, model).count() == 0
    assert {r["score"] for r in op4.score(odd, op4.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r["score"] for r in op4.score(odd, op4.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(3)
    d = len(op4.FEATURES)
    data = {k: rng.normal(k, 1 + k, (400, d)) for k in (0, 1)}
    model = op4.Discriminant({k: (float(len(x)), x.sum(0), x.T @ x) for k, x in data.items()})
    covs = {k: np.cov(x.T, bias=True) for k, x in data.items()}
    pooled = sum(covs.values()) / 2
    x = rng.normal(0.5, 1, (20, d))
    log = {}
    for k in (0, 1):
        cov = 0.9 * covs[k] + 0.05 * pooled + 0.05 * np.diag(np.diag(covs[k])) + op4.FLOOR * np.eye(d)
        diff = x - data[k].mean(0)
        log[k] = -0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(log[1] - log[0], -40, 40))))


def brute_rules(text):
    w = words(text)
    found = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if found[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_counts(spark, odd, empty):
    more = [(30, "a b c d e a b c d e x\n\nq\nq\n q", None, "z"), (31, "a a a a a a a", "en", "z"), (32, "# *|* <b>$\x0b%\x0c&\r1", "en", None)]
    docs = odd.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    rows = op7.quality_rules(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        want = brute_rules(texts[r["doc_id"]])
        assert tuple(r[c] for c in op7.COUNTS) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"])  # groups this small reject nothing
    assert op7.quality_rules(empty).count() == 0


def test_rules_outliers(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = op7.op7_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_mcd_against_numpy(spark):
    """Distances of one contaminated group follow the clean part's mean and covariance."""
    rng = np.random.default_rng(1)
    clean = rng.normal(0, 1, (900, 6)) @ np.diag([1, 2, 3, 1, 2, 3]) + 5
    clean[:, 1] += clean[:, 0]
    far = rng.normal(40, 1, (100, 6))
    x = np.concatenate([clean, far])
    rows = [(k, "en", "s", True, *map(float, v)) for k, v in enumerate(x)]
    stats = spark.createDataFrame(rows, "id int, lang string, source string, ok boolean, " + ", ".join(f"{f} double" for f in op7.FEATURES))
    got = {r["id"]: r["distance"] for r in op7.mcd_distances(stats, "ok").collect()}
    d = np.array([got[k] for k in range(len(x))])
    diff = x - clean.mean(0)
    want = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(np.cov(clean.T)), diff)
    assert np.corrcoef(d[:900], want[:900])[0, 1] > 0.95
    assert d[900:].min() > op7.CUTOFF > np.quantile(d[:900], 0.999)


def brute_lm(rows):
    tok = [(r["doc_id"], zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 7 == 2, words((r["text"] or "").translate(LOW)) + [None]) for r in rows]
    count = collections.Counter(w for _, held, t in tok if not held for w in t)
    n, v = sum(count.values()), len(count)
    return sorted(((d is not None, d or 0, held, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for d, held, t in tok), key=str)


@pytest.mark.parametrize("which", ["odd", "empty", "table", "null_id"])
def test_lm_base(spark, odd, empty, which):
    docs = {"odd": odd, "empty": empty, "table": spark.read.parquet(f"{SF}/documents.parquet")}.get(which)
    if docs is None:
        docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "B c")], "doc_id long, text string")
    got = op10.score(docs.withColumn("held_out", op10.held_out("doc_id", 7, 2))).collect()
    assert all(math.isfinite(r["score"]) for r in got)
    mine = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str)
    assert len(mine) == len(want := brute_lm(docs.collect()))
    for a, b in zip(mine, want, strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], rel=1e-9, abs=1e-5)


def test_lm_learns_order(spark):
    train = [(k, "the cat sat on the mat and the dog ran") for k in range(40)]
    docs = spark.createDataFrame([*train, (500, "the cat sat on the mat"), (501, "mat the on sat cat the")], "doc_id long, text string").withColumn("held_out", F.col("doc_id") >= 500)
    rows = {r["doc_id"]: r for r in op10.score(docs).collect()}
    assert rows[500]["base_score"] == pytest.approx(rows[501]["base_score"])
    assert rows[500]["score"] > rows[500]["base_score"] > rows[501]["score"]


def test_automaton_sums_to_one():
    """Every state's probabilities over the vocabulary and the rest add up to 1."""
    rng = np.random.default_rng(2)
    seq = rng.integers(0, 6, 3000).tolist()
    counts = np.bincount(seq, minlength=6)
    uni = counts / (counts.sum() + 50)  # what is left is the other words'
    two = collections.Counter((a << 20 | b) for a, b in zip(seq, seq[1:], strict=False))
    three = collections.Counter((a << 40 | b << 20 | c) for a, b, c in zip(seq, seq[1:], seq[2:], strict=False))
    auto = op10.Automaton(np.arange(6, dtype=np.uint64), counts, uni, {2: {k: n for k, n in two.items() if n > 70}, 3: {k: n for k, n in three.items() if n > 15}})
    assert auto.arcs and len(auto.fail) > 7
    logs = np.log10(uni).tolist()
    other = 1 - uni.sum()
    for a in range(6):
        for b in range(6):
            before = auto.walk([a, b], [logs[a], logs[b]])
            total = sum(10 ** (auto.walk([a, b, c], [logs[a], logs[b], logs[c]]) - before) for c in range(6))
            total += 10 ** (auto.walk([a, b, -1], [logs[a], logs[b], math.log10(other)]) - before)
            assert total == pytest.approx(1, abs=0.02)


@pytest.mark.parametrize("which", ["rare", "odd", "table"])
def test_lm_takes_every_gram(spark, odd, which):
    """Grams of rare words count, and scores are those of the automaton over all words."""
    rare = [(k, f"w{k} filler{k % 7} " * 800) for k in range(60)] + [(100, "seldom seen"), (101, "seldom seen"), (102, "seldom seen"), (103, "so seldom seen")]
    docs = {"rare": spark.createDataFrame(rare, "doc_id long, text string"), "odd": odd, "table": spark.read.parquet(f"{SF}/documents.parquet")}[which].select("doc_id", "text")
    docs = docs.withColumn("held_out", op10.held_out("doc_id", 7, 2))
    texts = [(r["doc_id"], r["held_out"], [*words((r["text"] or "").translate(LOW)), ""]) for r in docs.collect()]
    train = [t for _, held, t in texts if not held]
    count = collections.Counter(w for t in train for w in t)
    place = {w: k for k, w in enumerate(sorted(count))}
    counts = np.array([count[w] for w in place], np.int64)
    uni = (counts + 1) / (counts.sum() + len(counts) + 1)
    ids = [[place[w] for w in t] for t in train]
    two = collections.Counter(a << 20 | b for t in ids for a, b in zip(t, t[1:], strict=False))
    three = collections.Counter(a << 40 | b << 20 | c for t in ids for a, b, c in zip(t, t[1:], t[2:], strict=False))
    auto = op10.Automaton(np.arange(len(counts), dtype=np.uint64), counts, uni, {k: {g: n for g, n in grams.items() if n >= 2} for k, grams in ((2, two), (3, three))})
    logs = {w: math.log10((count[w] + 1) / (counts.sum() + len(counts) + 1)) for _, _, t in texts for w in t}
    want = sorted((d, auto.walk([place.get(w, -1) for w in t], [logs[w] for w in t])) for d, _, t in texts)
    got = sorted((r["doc_id"], r["score"]) for r in op10.score(docs).collect())
    assert [d for d, _ in got] == [d for d, _ in want]
    for (_, a), (_, b) in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-6)


STATS = "id int, lang string, source string, ok boolean, " + ", ".join(f"{f} double" for f in op7.FEATURES)


def brute_mcd(x, share, starts=60):
    """Mean and covariance of the subset with the least determinant, by random starts."""
    rng, best = np.random.default_rng(5), None
    h = int(np.ceil(share * len(x)))
    for _ in range(starts):
        own = x[rng.permutation(len(x))[: x.shape[1] + 2]]
        for _ in range(30):
            m, c = own.mean(0), np.cov(own.T, bias=True) + 1e-9 * np.eye(x.shape[1])
            own = x[np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))[:h]]
        det = np.linalg.slogdet(np.cov(own.T, bias=True))[1]
        if best is None or det < best[0]:
            best = det, own.mean(0), np.cov(own.T, bias=True)
    return best


def test_mcd_of_groups_against_brute_force(spark):
    """Two groups of unlike shape, a fifth of one contaminated: each follows its own least determinant."""
    rng = np.random.default_rng(11)
    groups = {}
    for k, (lang, source) in enumerate((("en", "a"), ("de", "b"))):
        mix = rng.normal(0, 1, (6, 6)) + 2 * np.eye(6)
        clean = rng.normal(0, 1, (800 + 400 * k, 6)) @ mix * (0.5 + k) + 3 * k
        bad = rng.normal(0, 0.4, (200 * (1 - k), 6)) + clean.mean(0) + 9
        groups[lang, source] = np.concatenate([clean, bad]) / 10
    rows = [(k * 10_000 + i, lang, source, True, *map(float, v)) for k, ((lang, source), x) in enumerate(groups.items()) for i, v in enumerate(x)]
    stats = spark.createDataFrame(rows, STATS)
    tiny = (1e-4,) * 6
    fit = stats.select(F.concat("lang", "source").alias("g"), *op7.FEATURES)
    found = {r["g"]: r for r in op7.mcd(fit, op7.FEATURES, tiny).collect()}
    for (lang, source), x in groups.items():
        r = found[lang + source]
        mean = np.array([r[f"mu_{i}"] for i in range(6)])
        cov = np.array([[r[f"s_{max(i, j)}_{min(i, j)}"] for j in range(6)] for i in range(6)])
        det, want_mean, want_cov = brute_mcd(x, op7.SUPPORT)
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        want = np.einsum("ij,jk,ik->i", x - want_mean, np.linalg.inv(want_cov), x - want_mean)
        own = x[np.argsort(d)[: int(np.ceil(op7.SUPPORT * len(x)))]]
        assert np.linalg.slogdet(np.cov(own.T, bias=True))[1] <= det + 0.05
        assert np.corrcoef(np.log(d), np.log(want))[0, 1] > 0.99 and abs(np.median(d) / op7.CHI2_MEDIAN - 1) < 0.05
        assert (d[1000 if lang == "de" else 800 :][:200] > op7.CUTOFF).all() or lang == "de"
    got = {r["id"]: r["distance"] for r in op7.mcd_distances(stats, "ok", floors=tiny).collect()}
    assert all(got[i] > op7.CUTOFF for i in range(800, 1000)) and sum(got[i] <= op7.CUTOFF for i in range(800)) >= 796


def test_chi_square_points():
    assert op7.chi_square_point(0.025, 6) == pytest.approx(14.449, abs=1e-3) and op7.CHI2_MEDIAN == pytest.approx(5.348, abs=1e-3)


def test_rules_judge_small_groups(spark):
    """A few rows of rare languages are judged by their parents' estimates; a whole small table isn't."""
    rng = np.random.default_rng(4)
    rows = [(k, "en", "s", True, *map(float, v)) for k, v in enumerate(rng.normal(0, 1, (300, 6)))]
    rows += [(1000, "xx", "t", True, *[0.0] * 6), (1001, "yy", "t", True, *[40.0] * 6), (1002, None, None, True, *[0.0] * 6), (1003, "en", None, False, *[90.0] * 6)]
    got = {r["id"]: r["distance"] for r in op7.mcd_distances(spark.createDataFrame(rows, STATS), "ok").collect()}
    assert len(got) == 304 and got[1000] < op7.CUTOFF < got[1001] and got[1002] < op7.CUTOFF and got[1003] is None
    assert {r["distance"] for r in op7.mcd_distances(spark.createDataFrame(rows[-20:], STATS), "ok").collect()} == {None}


def test_rules_take_clashing_columns(spark, odd):
    docs = odd.select("*", *[F.lit(f"v {c}").alias(c) for c in (*op7.OUTPUTS[:1], "kept", "distance", "_w", "in_text", "g", "_levels")])
    got = op7.quality_rules(docs, keep=("doc_id", "n_words", "kept", "g", "in_text"))
    assert got.columns[:5] == ["doc_id", "in_n_words", "in_kept", "g", "in_text"] and all(r["in_kept"] == "v kept" and r["g"] == "v g" for r in got.collect())


def test_scores_take_clashing_columns(spark, odd):
    docs = odd.withColumns({"score": F.lit("mine"), "lang_pred": F.lit("mine")})
    rows = op4.score(docs, op4.fit(docs, spark.createDataFrame([(15, 1), (16, 0)], "doc_id long, quality int"))).collect()
    assert all(r["in_score"] == "mine" and 0 <= r["score"] <= 1 for r in rows)
    rows = op3.predict(docs, op3.fit(docs), keep=("score", "lang_pred", "text")).collect()
    assert all(r["in_score"] == r["in_lang_pred"] == "mine" and 0 <= r["score"] <= 1 for r in rows) and "text" in rows[0].asDict()


def test_language_scores_against_plain_bayes(spark):
    """The posterior of a plain multinomial naive Bayes over the same windows, in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("lang IS NOT NULL")
    train, test = docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 3 = 1")
    langs, matrix = op3.fit(train)
    counts, prior = {x: collections.Counter() for x in langs}, collections.Counter()

    def buckets(text):
        raw = (text or "").encode()
        points, at = op3.code_points(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return [int(b) for order in op3.ORDERS for b in op3.windows(points, at, order) if b < op3.BUCKETS]

    for r in train.collect():
        counts[r["lang"]].update(buckets(r["text"]))
        prior[r["lang"]] += 1
    total = {x: sum(c.values()) + op3.SMOOTHING * op3.BUCKETS for x, c in counts.items()}
    got = {r["doc_id"]: r for r in op3.predict(test, (langs, matrix)).collect()}
    for r in test.limit(25).collect():
        seen = collections.Counter(buckets(r["text"]))
        logs = {x: math.log(prior[x] / sum(prior.values())) + sum(n * math.log((counts[x][b] + op3.SMOOTHING) / total[x]) for b, n in seen.items()) for x in langs}
        best = max(logs, key=logs.get)
        soft = min(1, op3.SOFTEN / max(1, sum(seen.values())))
        want = 1 / sum(math.exp((v - logs[best]) * soft) for v in logs.values())
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["score"] == pytest.approx(want, rel=1e-6)


def test_quality_statistics_against_plain_python():
    texts = ["One two, two two. Ünd so!! 12% # x\n# \n a,b; c", "", "A", "x x x x", "ÀÉ é Zz 9 <b> <b>"]
    raw = [t.encode() for t in texts]
    got = op4.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, row in zip(texts, got, strict=True):
        b, w = t.encode(), t.encode().split()
        n, size = len(w), max(1, sum(map(len, w)))
        upper, lower = sum(c.isupper() for c in t), sum(c.islower() for c in t)
        pairs = len(set(zip([None, *w], w, strict=False))) if w else 0
        want = {
            "log_words": math.log1p(n), "log_word_bytes": math.log(size / max(n, 1)), "upper": math.sqrt(upper / max(1, upper + lower)), "exclaim": math.sqrt((t.count("!") + t.count("?")) / size),
            "digits": math.sqrt(sum(c in "0123456789" for c in t) / size), "distinct_words": math.log1p(len(set(w))) / math.log1p(max(n, 1)), "same_as_before": math.sqrt(sum(x == y for x, y in zip(w, w[1:], strict=False)) / max(n, 1)),
            "distinct_pairs": math.sqrt(pairs / max(n, 1)), "symbols": math.sqrt(sum(c in b"#*$%&|<>=+~^_{}[]\\/@" for c in b) / size), "bare_symbols": math.sqrt(sum(len(x) == 1 and x in b"#*$%&|<>=+~^_{}[]\\/@" for x in w) / max(n, 1)),
            "stops": math.sqrt(sum(x[-1:] in (b".", b",", b";", b":") for x in w) / max(n, 1)),
        }
        for name, v in want.items():
            if not (name == "stops" and t.endswith(".")):
                assert row[op4.FEATURES.index(name)] == pytest.approx(v, abs=1e-9), (t, name)


def test_walk_in_pieces(monkeypatch):
    """However texts are cut into pieces, the walk gives the same arcs, states and sums."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, n).clip(max=40)) for n in (0, 1, 2, 3, 7, 90, 400, 1300)]
    h, at = op10._tokens(pa.array(texts))
    two, three, has_two, has_three = op10._grams(h, at, 0)
    flags = [np.full(len(k), g) for k, g in ((h, False), (two[has_two], True), (three[has_three], True))]
    keys, n, gram = op10._distinct(np.concatenate([h, two[has_two], three[has_three]]), np.ones(sum(map(len, flags)), int), np.concatenate(flags))
    rows = []
    for d, s in op10._dealt(keys, 7):
        first = op10._words_first(gram[s])
        some = (~gram[s] | (n[s] >= 2))[first]
        rows.append((d, len(some), op10._squeezed(np.packbits(some).tobytes()), op10._numbers(2 * n[s][first][some])))
    want = None
    for piece in (1, 2, 3, 50, 10_000):
        monkeypatch.setattr(op10, "PIECE", piece)
        block = op10.Block(rows, [(h, at)], 1e6, 0, 7)
        block.add(pa.array(range(len(texts))), pa.array([False] * len(texts)), 0)
        ids, flags, n_tokens, known, base, part, uses = block.docs[0]
        now = (part.round(9).tolist(), [sorted(u.tolist()) for u in uses])
        want = want or now
        assert now == want
