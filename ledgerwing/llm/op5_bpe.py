"""Byte-level BPE encoding and decoding with a pair occurrence index.

A block of a partition is cut into pieces (see ``tokens``), the pieces into
pre-tokens, and the distinct pre-tokens not seen before are merged together:
their bytes form one linked sequence, an index maps the rank of each mergeable
pair to all its positions, and the active ranks are applied in ascending order;
each merge unlinks a symbol and enters the two pairs it makes into the lists of
their ranks.  A merge's result only occurs in later merges (checked when the
vocabulary is loaded), so ascending order is the order of the reference
definition.  Ids of pre-tokens are kept in a bounded cache of the worker.

Nulls: a null text is an empty one, with no ids; a null doc_id stays null.
Text that isn't UTF-8 is read with replacement characters, as the library does.
Repeated rows are all kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_blocks, text_buffer, tidy
from .tokens import byte_alphabet, check_cuts, distinct_pieces, spread

#: Pieces, and pre-tokens, that each of two generations of a worker's caches holds.
CACHE_ENTRIES = 120_000

# Fixed values of the public byte-level scheme: its white space and its pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class Vocabulary:
    """Merges, token bytes and added tokens of a tokenizers file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = token.encode() if token in self.added else bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merges: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if max(made.get(left, -1), made.get(right, -1)) >= rank:
                raise ValueError("a merge uses a symbol made later")
            target = vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            made.setdefault(target, rank)
            self.merges[left << 32 | right] = (rank, target)
        order = np.argsort(np.array(list(self.merges), np.int64), kind="stable")
        self.keys = np.array(list(self.merges), np.int64)[order]
        self.key_rank = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.by_rank = [(k >> 32, k & 0xFFFFFFFF, t) for k, (_, t) in self.merges.items()]
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.heads = {t[0] for t in self.added if t}
        own = set(self.added.values())
        check_cuts([t for i, t in enumerate(self.token_bytes) if i not in own])
        self.decimal = [str(i) for i in range(len(self.token_bytes))]


class PairIndex:
    """The linked symbols of many pre-tokens, and the positions of every mergeable
    pair by rank: long lists are handled as arrays, short ones one by one."""

    LONG = 24

    def __init__(self, texts: list[bytes], vocab: Vocabulary):
        self.vocab = vocab
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        place = np.arange(len(raw)) + np.repeat(np.arange(len(texts)), sizes)
        n = len(raw) + len(texts)
        self.sym = np.full(n, -1, np.int64)  # -1 keeps pre-tokens apart, -2 is a symbol merged away
        self.sym[place] = np.array(vocab.byte_id, np.int64)[raw]
        self.nxt, self.prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.few: dict[int, list[int]] = {}
        self.many: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.enter(np.arange(n - 1), self.sym[:-1], self.sym[1:])

    def enter(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Add the pairs that start at ``at`` to the lists of their ranks."""
        real = (left >= 0) & (right >= 0)
        at, key = at[real], left[real] << 32 | right[real]
        if not len(at):
            return
        keys = self.vocab.keys
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        real = keys[found] == key
        at, rank = at[real], self.vocab.key_rank[found[real]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        edges = np.flatnonzero(np.diff(rank)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
            if a == b:
                continue
            r = int(rank[a])
            if r not in self.few:
                self.few[r] = []
                heapq.heappush(self.active, r)
            if b - a < self.LONG:
                self.few[r] += at[a:b].tolist()
            else:
                self.many.setdefault(r, []).append(at[a:b])

    def run(self) -> None:
        while self.active:
            rank = heapq.heappop(self.active)
            few, many = self.few.pop(rank), self.many.pop(rank, None)
            left, right, made = self.vocab.by_rank[rank]
            if left != right and (many or len(few) >= self.LONG):
                self._merge_many(np.unique(np.concatenate([*(many or []), np.array(few, np.int64)])), left, right, made)
            else:
                for part in many or []:
                    few += part.tolist()
                self._merge_few(sorted(few), left, right, made)

    def _merge_many(self, at: np.ndarray, left: int, right: int, made: int) -> None:
        sym, nxt, prv = self.sym, self.nxt, self.prv
        at = at[sym[at] == left]
        j = nxt[at]
        real = sym[j] == right
        at, j = at[real], j[real]
        k = nxt[j]
        sym[at], sym[j] = made, -2
        nxt[at], prv[k] = k, at
        here = np.full(len(at), made)
        self.enter(at, here, sym[k])
        p = prv[at]
        p = p[p >= 0]
        self.enter(p, sym[p], sym[nxt[p]])

    def _merge_few(self, at: list[int], left: int, right: int, made: int) -> None:
        sym, nxt, prv = memoryview(self.sym), memoryview(self.nxt), memoryview(self.prv)
        get, few, active = self.vocab.merges.get, self.few, self.active
        for i in at:
            if sym[i] != left:
                continue
            j = nxt[i]
            if sym[j] != right:
                continue
            sym[i], sym[j] = made, -2
            k = nxt[j]
            nxt[i], prv[k] = k, i
            p = prv[i]
            for start, a, b in ((i, made, sym[k]), (p, sym[p] if p >= 0 else -1, made)):
                if a >= 0 and b >= 0 and (m := get(a << 32 | b)):
                    if m[0] in few:
                        few[m[0]].append(start)
                    else:
                        few[m[0]] = [start]
                        heapq.heappush(active, m[0])

    def ids(self) -> list[np.ndarray]:
        """The symbols left of each pre-token."""
        kept = self.sym[self.sym != -2]
        ends = np.flatnonzero(kept == -1)
        kept = kept.astype(np.uint32)
        return [kept[a + 1 : b] for a, b in zip([-1, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []


def merge_all(texts: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each pre-token, all merged together through the pair occurrence index."""
    index = PairIndex(texts, vocab)
    index.run()
    return index.ids()


class Bpe:
    """Ids of whole documents; one per Python worker, with bounded caches."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.added = tuple(t.encode() for t in self.vocab.added)
        self.decode_table = pa.array(self.vocab.token_bytes, pa.large_binary())

    def _fill(self, chunks: list[str]) -> None:
        for name in ("chunks", "words"):  # what isn't met again is let go
            if len(getattr(self, name)) > CACHE_ENTRIES:
                setattr(self, f"old_{name}", getattr(self, name))
                setattr(self, name, {})
        vocab, words, old = self.vocab, self.words, self.old_words
        cut: dict[str, list] = {}
        for c in chunks:
            if c in self.old_chunks:
                self.chunks[c] = self.old_chunks[c]
            elif c not in self.chunks:
                parts = vocab.special.split(c) if vocab.special and not vocab.heads.isdisjoint(c) else [c]
                cut[c] = [x for part in parts if part for x in ([vocab.added[part]] if part in vocab.added else vocab.split.findall(part))]
        new = list(dict.fromkeys(x for parts in cut.values() for x in parts if isinstance(x, str) and x not in words and x not in old))
        words.update((x, old[x]) for parts in cut.values() for x in parts if isinstance(x, str) and x in old)
        words.update(zip(new, (x.tobytes() for x in merge_all([x.encode() for x in new], vocab)), strict=True))
        for c, parts in cut.items():
            self.chunks[c] = b"".join(np.uint32(x).tobytes() if isinstance(x, int) else words[x] for x in parts)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all documents of a block, and n + 1 offsets."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cuts, words, codes = distinct_pieces(data, offsets, self.added)
        self._fill(words)
        return spread([self.chunks[w] for w in words], codes, cuts, offsets)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids, as valid UTF-8."""
        if not len(ids):
            return b""
        out = self.decode_table.take(pa.array(ids))
        _, at, raw = out.buffers()
        data = raw.to_pybytes()[: np.frombuffer(at, np.int64)[len(out)]] if raw is not None else b""
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()


_BPE: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _BPE:
        _BPE[path] = Bpe(path)
    return _BPE[path]


BLOCK_BYTES = 4 << 20


def _encoded(batches, path: str):
    """(doc_id, n_tokens, ids) batches of (doc_id, text) batches."""
    engine = bpe(path)
    for batch in batches:
        data, offs = text_buffer(batch.column(1))
        for i, j in doc_blocks(offs, BLOCK_BYTES):
            ids, at = engine.block(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            raw = ids.astype("<u4").tobytes()
            yield pa.record_batch([
                batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array([raw[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)], pa.binary()),
            ], names=["doc_id", "n_tokens", "ids"])


def _decoded(batches, path: str):
    """(doc_id, n_tokens, ids, text) batches of encoded ones."""
    engine = bpe(path)
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            text = pa.array([engine.decode(np.frombuffer(x.as_buffer(), "<u4")).decode() for x in part.column(2)], pa.string())
            yield pa.record_batch([*part.columns, text], names=["doc_id", "n_tokens", "ids", "text"])


def _digested(batches, path: str):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) batches of decoded ones."""
    decimal = bpe(path).vocab.decimal
    for batch in batches:
        ids = [hashlib.sha256(",".join(map(decimal.__getitem__, np.frombuffer(x.as_buffer(), "<u4").tolist())).encode()).hexdigest() for x in batch.column(2)]
        text = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(3)]
        yield pa.record_batch([*batch.columns[:2], pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(lambda b: _encoded(b, tokenizer_path)), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of what ``encode`` gave."""
    return encoded.mapInArrow(tidy(lambda b: _decoded(b, tokenizer_path)), "doc_id long, n_tokens long, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so that a
    worker holds one vocabulary."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(lambda b: _digested(_decoded(_encoded(b, tokenizer_path), tokenizer_path), tokenizer_path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
