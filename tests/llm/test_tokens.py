import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerwing.llm import op1_token_binary as op1
from ledgerwing.llm import op5_bpe as op5
from ledgerwing.llm import op8_packing as op8
from ledgerwing.llm import tokens
from ledgerwing.llm.tokens import Encoder, tokenizer

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ALPHABET = st.sampled_from([*"aAbeszEÉéñ'.,!?*|&$%#<>-_ \n\t\r  12", " ", "　", " ", "́", "×", "÷", "ß", "☃", "😀", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "'s", "'re", " the", "\x1c", "\x85"])
TEXTS = st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=6)


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize(("path", "fold", "made"), [(BYTE, False, Encoder), (WORD, True, Encoder), (BYTE, False, op5.Bpe)])
def test_encodes_as_the_library(path, fold, made):
    own = made(path, fold) if made is Encoder else made(path)
    lib = tokenizer(path)

    @given(TEXTS)
    @settings(max_examples=300, deadline=None)
    def check(texts):
        ids, at = own.block(*buffer(texts))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)

    check()


def test_decodes_as_the_library():
    own, lib, rng = op5.Bpe(BYTE), tokenizer(BYTE), random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, np.uint32)).decode() == lib.decode(ids, skip_special_tokens=False)


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
@settings(max_examples=200, deadline=None)
def test_codec_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = op1.pack_ranks(ranks)
    assert len(control) == -(-len(ranks) // 4)
    assert op1.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)).tolist() == values


def brute(rows, path, end):
    lib, start = tokenizer(path), 0
    for doc, text in sorted(((r["doc_id"], r["text"] or "") for r in rows), key=lambda x: x[0]):
        ids = lib.encode(text, add_special_tokens=False).ids + [end]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files_hold_all_ids_in_order(spark, odd):
    target, manifest = op1.token_files(odd, BYTE, 0)
    got = op1.digest(op1.read_files(spark, target), manifest).orderBy("start").collect()
    want = list(brute(odd.collect(), BYTE, 0))
    assert [tuple(r) for r in got] == want
    by_rank = np.fromfile(f"{target}/ranks.bin", "<u4")
    assert len(set(by_rank.tolist())) == len(by_rank)


def test_small_files_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "c"), (1, "the cat sat on the mat"), (2, None)], "doc_id long, text string")
    encoded = op1.staged(op1.encode_documents(docs, BYTE, 0))
    target = op1.shared_dir(spark)
    manifest = op1.write_files(encoded, target, file_tokens=3)
    rows = op1.digest(op1.read_files(spark, target), manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3]
    assert [r["start"] for r in rows] == [0, 3, 10, 11]
    assert manifest.count() > 2


def test_no_documents(spark, empty):
    target, manifest = op1.token_files(empty, BYTE, 0)
    assert manifest.count() == 0
    assert op8.pack(empty, WORD, 1).count() == op5.encode(empty, BYTE).count() == 0


def test_bpe_round_trip(spark, odd):
    rows = op5.decode(op5.encode(odd, BYTE), BYTE).collect()
    want = {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    assert len(rows) == odd.count()
    assert {(r["doc_id"], r["text"]) for r in rows} == want
    lib = tokenizer(BYTE)
    for r in rows:
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert lib.decode(ids, skip_special_tokens=False) == r["text"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = sorted((r["doc_id"], r["n_tokens"], sha(",".join(map(str, np.frombuffer(r["ids"], "<u4")))), sha(r["text"])) for r in rows)
    assert sorted(map(tuple, op5.round_trip(odd, BYTE).collect())) == digests


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=100, deadline=None)
def test_packing_wastes_nothing(sizes):
    got = op8.assign(np.array(sizes, np.int64))
    filled = {}
    for d, start, n, seq, offset in got:
        assert n > 0 and start + n <= sizes[d]
        filled.setdefault(seq, []).append((offset, n))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    for d, size in enumerate(sizes):
        at = 0
        for start, n in sorted((s, n) for k, s, n, _, _ in got if k == d):
            assert start == at
            at += n
        assert at == size


def test_packing_keeps_every_id(spark, odd):
    rows = op8.pack(odd, WORD, 1, fold=True, group_docs=4, with_ids=True).collect()
    want = sorted((d, n, c) for d, _, n, c in brute(odd.collect(), WORD, 1))
    whole, got = {}, []
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for (doc, n), parts in whole.items():
        copies = sum(s == 0 for s, _ in parts)
        body = b"".join(dict(parts)[s] for s in sorted(dict(parts)))
        got += [(doc, n, zlib.crc32(body))] * copies
    assert sorted(got) == want
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_vocabularies_that_span_cuts_are_refused():
    from tokenizers import Tokenizer, models

    tokens.check_cuts(tokens.token_texts(Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2}, [("a", "b")]))))
    with pytest.raises(ValueError):
        tokens.check_cuts(tokens.token_texts(Tokenizer(models.BPE({"a": 0, ".": 1, "b": 2, "a.": 3, "a.b": 4}, [("a", "."), ("a.", "b")]))))
