"""Alignment against whole-text encodings and a plain comparison of all byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerwing.llm import op12_alignment as op12
from ledgerwing.llm.tokens import byte_alphabet

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(text, sides):
    """[(id, start, end)] of both sides, or two empty lists."""
    tok, model = sides
    if not text:
        return [], []
    alphabet = byte_alphabet()
    a = [(k, bytes(alphabet[c] for c in tok.id_to_token(k))) for k in tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(k, bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode()) for k in model.encode(text) for p in [model.id_to_piece(k)]]
    if any(b"".join(t for _, t in x) != (" " + text).encode() for x in (a, b)):
        return [], []
    out = []
    for x in (a, b):
        ends = np.cumsum([len(t) for _, t in x])
        out.append([(k, int(e) - len(t), int(e)) for (k, t), e in zip(x, ends, strict=True)])
    return tuple(out)


def plain(texts, sides):
    docs = [plain_tokens(t, sides) for t in texts]
    links = [[(i, j) for i, s, e in a for j, p, q in b if p < e and s < q] for a, b in docs]
    count = Counter(x for own in links for x in own)
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    rows = []
    for (a, b), own in zip(docs, links, strict=True):
        cuts, parts, last = sorted({e for _, _, e in a} & {e for _, _, e in b}), [], 0
        for c in cuts:
            parts.append("|".join(",".join(str(k) for k, s, _ in x if last <= s < c) for x in (a, b)))
            last = c
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(cuts), len(own), sum(count[x] == most[x[1]] for x in own), sum(count[x] for x in own), digest))
    return rows


def test_alignment_plain(spark, sides):
    rng = random.Random(2)
    bits = ["a", "the", "ing", " ", " ", "  ", "\n", "é", "　", ".", "'s", "中", "한국", "12", "\t", "E", "-", "😀", "<s>", "<|endoftext|>", "\x00", "́"]
    texts = [None, "", " ", "  ", "a ", " a", "x▁y", "<|endoftext|>", "</s> <unk>", "\n", "é", "same text", "same text"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_a long, key string").repartition(3)
    got = {r["doc_id"]: tuple(r[n] for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in op12.alignment(df, A, B).collect()}
    assert [got[k] for k in range(len(texts))] == plain(texts, sides)


def test_alignment_query(spark, sides):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 1500").collect()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    small = op12.alignment(df, A, B, chunk=50, block_links=1000)  # many chunks and blocks
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in small.collect()}
    assert [got[r["doc_id"]] for r in docs] == plain([r["text"] for r in docs], sides)
    whole = op12.op12_alignment(spark, SF)
    assert whole.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and whole.where("n_links <> n_a + n_b - n_groups").count() == 0


def test_alignment_odd(spark, odd, empty):
    got = op12.alignment(odd, A, B).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and (r["groups_sha256"] == "") == (r["n_a"] == 0)
    assert op12.alignment(empty, A, B).count() == 0
    named = odd.selectExpr("cast(doc_id AS string) AS doc_id", "text")
    assert sorted(r["n_links"] for r in op12.alignment(named, A, B).collect()) == sorted(r["n_links"] for r in got)


def test_sweep_in_chunks():
    """Any cut of the token streams into chunks gives the same groups and links."""
    rng = random.Random(6)
    a, b = op12.Lengths([b"x", b"xx", b"xxx"]), op12.Lengths([b"x", b"xx", b"xxxx"])
    for _ in range(200):
        ids = [np.array([rng.randrange(3) for _ in range(rng.randint(1, 40))]) for _ in range(2)]
        total = [int(s.bytes[x].sum()) for s, x in zip((a, b), ids, strict=True)]
        low = int(np.argmin(total))
        ids[low] = np.concatenate([ids[low], np.zeros(abs(total[0] - total[1]), int)])
        seen = set()
        for _ in range(4):
            sweep = op12.Sweep(a, b)
            parts = [(int(s.bytes[x[:k]].sum()), n, x[k : k + w]) for n, (s, x, w) in enumerate(zip((a, b), ids, (rng.randint(1, 50), rng.randint(1, 50)), strict=True)) for k in range(0, len(x), w)]
            for _, n, x in sorted(parts, key=lambda p: p[:2]):
                sweep.push(n, x)
            keys, times = sweep.pairs()
            assert times.sum() == sweep.links == len(ids[0]) + len(ids[1]) - sweep.groups and not len(sweep.ids[0]) and not len(sweep.ids[1])
            seen.add((sweep.groups, sweep.digest.hexdigest(), tuple(keys), tuple(times)))
        assert len(seen) == 1


def test_tally():
    rng = np.random.default_rng(1)
    tally, want = op12.Tally(), Counter()
    for _ in range(60):
        keys = np.unique(rng.integers(0, 90_000, 40_000))
        tally.add(keys, np.ones(len(keys), np.int64))
        want.update(keys.tolist())
    keys, times = tally.total()
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == want
