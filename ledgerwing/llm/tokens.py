"""Encoding whole texts with a public tokenizer file, distinct pieces once.

The vocabularies served here never form a token across a single white-space
character between two other characters, nor from a letter to following
punctuation.  So a text may be cut there without changing its ids: the cuts are
found with numpy on the raw buffer, Arrow dictionary-encodes the pieces, and the
tokenizers library encodes each distinct piece once per worker.  Where a
neighbour might be a multi-byte white-space character no cut is made.  A vocabulary with
a token that spans a cut is refused when it is loaded.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from .common import LOWER, doc_blocks

CACHE_PIECES = 450_000
ENCODE_BYTES = 12 << 20
#: Below it, letters are letters in every version of the tables, and composed already.
PLAIN = "\u0250"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_BYTES = {b: c for c, b in byte_alphabet().items()}

_WS = np.zeros(256, bool)
_WS[[*range(9, 14), *range(0x1C, 0x21)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_PUNCT[0x27] = False
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def pieces(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...] = ()) -> np.ndarray:
    """Sorted cut positions, 0 and the end included; every document edge is one.
    No cut falls within the added tokens in ``whole``."""
    n = len(data)
    if n == 0:
        return np.zeros(1, np.int64)
    gap = np.zeros(n, bool)
    b1, b2 = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # one and two bytes before
    b1[1:], b2[2:] = data[:-1], data[:-2]
    b3 = np.zeros(n, np.uint8)
    b3[3:] = data[:-3]
    nxt = np.zeros(n, np.uint8)
    nxt[:-1] = data[1:]
    tail = (b1 >= 0x80) & ((b2 == 0xC2) | _WIDE[b3])
    inner = np.ones(n, bool)
    inner[offsets[:-1][offsets[:-1] < n]] = False
    last = offsets[1:] - 1
    inner[last[last >= 0]] = False
    single = inner & ((data == 32) | (data == 10)) & ~_WS[b1] & ~_WS[nxt] & ~_WIDE[nxt] & ~tail
    letter = _LETTER[b1] | ((b2 == 0xC3) & (b1 >= 0x80) & (b1 != 0x97) & (b1 != 0xB7))
    gap = single | (letter & _PUNCT[data])
    after = np.zeros(n, bool)
    after[1:] = single[:-1] & (data[:-1] == 10)
    gap |= after
    raw = data.tobytes() if whole else b""
    for token in whole:
        at = raw.find(token)
        while at >= 0:
            gap[at + 1 : at + len(token)] = False
            at = raw.find(token, at + 1)
    gap[offsets[:-1][offsets[:-1] < n]] = True
    gap[0] = True
    return np.append(np.flatnonzero(gap), n)


def check_cuts(tokens: list[bytes]) -> None:
    """An error if there is a place in some token where ``pieces`` cuts: then pieces wouldn't give the ids of whole texts."""
    docs = [b"a" + t + b"a" for t in tokens]
    at = np.cumsum([0, *map(len, docs)])
    cuts = pieces(np.frombuffer(b"".join(docs), np.uint8), at)[:-1]
    doc = np.searchsorted(at, cuts, "right") - 1
    inside = (cuts - at[doc] > 1) & (at[doc + 1] - cuts > 1)
    if inside.any():
        raise ValueError(f"texts can't be cut for this vocabulary: it has the token {tokens[doc[inside][0]]!r}")


def token_texts(tok) -> list[bytes]:
    """The bytes of a vocabulary's own tokens, without what marks the end of a word."""
    suffix, alphabet = getattr(tok.model, "end_of_word_suffix", None) or "", byte_alphabet()
    added = {t.content for t in tok.get_added_tokens_decoder().values()}
    words = [w.removesuffix(suffix) for w in tok.get_vocab(with_added_tokens=False) if w not in added]
    return [bytes(alphabet[c] for c in w) if all(c in alphabet for c in w) else w.encode() for w in words]


class Encoder:
    """Ids of whole documents; one per Python worker, with a bounded cache of pieces."""

    def __init__(self, path: str, fold: bool = False, most: int = CACHE_PIECES):
        """fold: the vocabulary lower-cases and drops white space; most: pieces that are kept."""
        self.tok, self.fold, self.most = tokenizer(path), fold, most
        check_cuts(token_texts(self.tok))
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.model = self.tok.model
        self.added = tuple(t.content.encode() for t in self.tok.get_added_tokens_decoder().values())

    def _fill(self, words: list[str]) -> None:
        cache, fold, ask = self.cache, self.fold, self.model.tokenize
        if len(cache) > self.most // 2:  # the pieces not met again are let go
            self.old, self.cache = cache, {}
            cache = self.cache
        old, odd = self.old, []
        for w in words:
            if w in cache:
                continue
            if w in old:
                cache[w] = old[w]
                continue
            spaced = w[:1] == " "
            word = w[1:] if spaced else w
            if word.isascii():
                plain = word.isalpha() and (not fold or word.islower())
            else:
                word = word.lower() if fold else word
                plain = word.isalpha() and max(word) < PLAIN
            if plain:  # one pre-token: the model alone is asked
                mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
                cache[w] = array("I", [t.id for t in ask("\u0120" + mapped if spaced and not fold else mapped)]).tobytes()
            else:
                odd.append(w)
        for k in range(0, len(odd), 10_000):
            part = odd[k : k + 10_000]
            for w, e in zip(part, self.tok.encode_batch(part, add_special_tokens=False), strict=True):
                cache[w] = array("I", e.ids).tobytes()

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all documents of a block, and n + 1 offsets."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.fold and b"<|" not in data.tobytes():  # added tokens are matched before the text is lower-cased
            data = LOWER[data]
        cuts, words, codes = distinct_pieces(data, offsets, self.added)
        self._fill(words)
        return spread([self.cache[w] for w in words], codes, cuts, offsets)


def distinct_pieces(data: np.ndarray, offsets: np.ndarray, whole: tuple[bytes, ...]) -> tuple[np.ndarray, list[str], pa.Array]:
    """Cut positions of a block, its distinct pieces, and each piece's place among them."""
    parts = [pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], whole)[:-1] + offsets[i] for i, j in doc_blocks(offsets) if offsets[j] > offsets[i]]
    cuts = np.append(np.concatenate(parts), len(data))
    chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    try:
        words = coded.dictionary.cast(pa.large_string()).to_pylist()
    except pa.ArrowInvalid:  # not UTF-8
        words = [w.decode("utf-8", "replace") for w in coded.dictionary.to_pylist()]
    return cuts, words, coded.indices


def spread(values: list[bytes], codes: pa.Array, cuts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces in order, and where each document's begin."""
    flat = pa.array(values, pa.large_binary()).take(codes)
    _, at, raw = flat.buffers()
    at = np.frombuffer(at, np.int64)[: len(flat) + 1]
    ids = np.frombuffer(raw, np.uint32, int(at[-1]) // 4) if raw is not None else np.zeros(0, np.uint32)
    return ids, at[np.searchsorted(cuts, offsets)] // 4


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, fold: bool = False, most: int = CACHE_PIECES) -> Encoder:
    if (path, fold) not in _ENCODERS:
        _ENCODERS[path, fold] = Encoder(path, fold, most)
    return _ENCODERS[path, fold]
