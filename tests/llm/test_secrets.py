"""Secret scans against regular expressions and sums in plain Python."""

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerwing.llm import op13_secrets as op13

SF = "/root/testdata/sf0.001"
LETTERS = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
NAMES = "|".join(LETTERS(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
PATTERNS = [(re.compile(rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6), (re.compile(r"AKIA[A-Z0-9]+"), 0, 20), (re.compile(r"[0-9a-f]+"), 0, 24)]


def ratio(run, table):
    codes = [op13.ALPHABET.find(c) + 1 for c in run]
    return sum(table[a * op13.SIZE + b] for a, b in zip([0, *codes], codes, strict=False))


def plain(text, table):
    text = text or ""
    spans = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(PATTERNS) for m in p.finditer(text) if len(m[g]) >= n]
    counts = [sum(s[1] == k for s in spans) for k in range(3)]
    at, rest = 0, []
    for m in [*PATTERNS[0][0].finditer(text), None]:
        rest.append((at, text[at : m.start() if m else len(text)]))
        at = m.end() if m else at
    more = [(at + m.start(), 3, at + m.end()) for at, part in rest for m in re.finditer(r"[A-Za-z0-9_+/-]{16,}={0,2}", part)
            if not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", m[0]) and ratio(m[0], table) >= 1000 * op13.THRESHOLD]
    write = lambda x: ",".join(f"{op13.KINDS[k]}:{s}:{e}" for s, k, e in sorted(x))
    return (*counts, len(more), hashlib.sha256(write(spans).encode()).hexdigest(), write([*spans, *more]))


def drawn(rng, n, chars="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    return "".join(rng.choice(chars) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark):
    return op13.train(op13.samples(spark.read.parquet(f"{SF}/documents.parquet")))


def texts():
    rng = random.Random(8)
    bits = ["password", "PassWd", "token", "Secret", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "\n", "é", "😀", ".", "K", "ſecret", "the "]
    out = [None, "", " ", "secret=token:abcdefgh", "token=secret=abcdef", "password=abcde password=abcdef", "x" * 40_000, "AKIA" * 9, "İ" * 50 + " token = 'a.b.c.d'"]
    for _ in range(300):
        own = [*bits, drawn(rng, rng.randint(3, 30), "0123456789abcdef"), drawn(rng, rng.randint(10, 30), "ABCDEFGHIJ0123456789"), drawn(rng, rng.randint(3, 40)), "anotherordinaryname"]
        out.append("".join(rng.choice(own) for _ in range(rng.randint(1, 40))))
    return out


def test_secrets_plain(spark, table):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, spans string, id int").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in op13.scan(df, table).collect()}
    for k, t in rows:
        assert got[k] == plain(t, table), repr(t)[:300]


def test_secrets_query(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in op13.op13_secrets(spark, SF).collect()}
    assert got == {r["doc_id"]: plain(r["text"], table) for r in docs}


def test_secrets_many_matches(spark, table):
    """Places stay right over many blocks of matches."""
    rng = random.Random(9)
    text = " ".join(f"é password={drawn(rng, rng.randint(4, 9))} {drawn(rng, 25, '0123456789abcdef')}" for _ in range(700))
    assert tuple(op13.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), table).first())[1:] == plain(text, table)


def test_secrets_held_out(spark, table):
    """Random strings that no sample had are found, ordinary names are left."""
    rng = random.Random(10)
    strange = [drawn(rng, 32) for _ in range(200)] + [base64.b64encode(rng.randbytes(30)).decode() for _ in range(200)] + [drawn(rng, 23, "0123456789abcdef") for _ in range(200)]
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    words = [w for t in docs for w in re.findall("[a-z]{4,}", t or "") if not re.search("[0-9]", w)]
    names = [rng.choice("_-/").join(rng.sample(words, 4)) for _ in range(300)] + ["".join(w.title() for w in rng.sample(words, 4)) for _ in range(300)]
    of = lambda runs: [r[0] for r in spark.createDataFrame([(r,) for r in runs], "r string").select(op13.ratio(F.col("r"), table)).collect()]
    assert sum(v >= 1000 * op13.THRESHOLD for v in of(strange)) >= 0.98 * len(strange)
    assert sum(v >= 1000 * op13.THRESHOLD for v in of(names)) <= 0.005 * len(names)
    same = [c * 30 for c in "-_/+=aZ0"]
    assert all(v < 1000 * op13.THRESHOLD for v in of(same))


def test_secrets_odd(spark, table, odd, empty):
    got = op13.scan(odd, table).collect()
    assert len(got) == odd.count() and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert op13.scan(empty, table).count() == 0
    none = op13.train(op13.samples(empty))
    assert not any(none) and op13.scan(odd, none).agg(F.sum("n_random")).first()[0] == 0


def test_before(spark):
    lens = [random.Random(3).randint(0, 9) for _ in range(300)]
    got = spark.createDataFrame([(lens[:n],) for n in (1, 63, 64, 65, 300)], "l array<bigint>").select(op13.before(F.col("l")).alias("p"), "l").collect()
    for r in got:
        assert r["p"] == [sum(r["l"][:i]) for i in range(len(r["l"]))]
