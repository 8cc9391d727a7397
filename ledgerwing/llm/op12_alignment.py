"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

1. Every text is encoded by both tokenizers.  Their end events travel as chunks of ids (a token's end follows from
   the lengths of its vocabulary's tokens): A's and B's chunks are one union of rows (document, side, start, ids).
2. Rows are dealt by document and sorted within partitions by offset, and stream through ``Sweep``, whose state is
   the tokens of the group that is still open.  Where both sides end, a group closes.
   Between two neighbouring ends lies exactly one pair of tokens that overlap, so each distinct end is one link.
3. Links are counted by id pair within blocks of documents, then over the corpus.  The counts a block asks for come back to it
   by a join on the pair (a pair that very many blocks ask for is split) and meet its documents in one more sorted stream.

Nothing is kept whole: a task holds one block's distinct pairs, at most ``BLOCK_LINKS`` of them beyond a document's own, and
the only broadcasts are pairs' ``heavy`` keys (under 10,000) and one row for each id of B.

Texts that are null or empty, and those whose bytes either vocabulary does not give back (such as one with U+2581 in it),
have no tokens: zeros and an empty digest.  Ids may be of any type, null or repeated: every row is aligned for
itself.  A group without a common end takes memory in proportion to its tokens.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stores import heavy_join, saved
from .common import doc_blocks, text_buffer, tidy
from .tokens import Encoder, byte_alphabet, spread

TEXT_BYTES = 4 << 20
CHUNK = 1 << 16
BLOCK_LINKS = 2 << 20
SPACE = "▁"
CACHE_UNITS = 300_000
LONG_UNIT = 64
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class ByteSide(Encoder):
    """Byte-level vocabulary A; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        self.added = ()
        alphabet, names = byte_alphabet(), self.tok.get_vocab()
        self.tokens = [b""] * (1 + max(names.values()))
        for name, k in names.items():
            self.tokens[k] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()


class PieceSide:
    """Vocabulary B of pieces, which adds a space to a text.  A unit from one single space to the next is encoded once: no
    piece of the vocabulary spans the place before a space (checked), so units and whole texts give the same ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        across = [x for x in names if re.search(f"[^{SPACE}]{SPACE}", x)]
        if across:
            raise ValueError(f"texts can't be cut for this vocabulary: it has the piece {across[0]!r}")
        self.tokens = [bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace(SPACE, " ").encode() for k, x in enumerate(names)]
        self.cache: dict[bytes, bytes] = {}

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Document starts, and single spaces between other bytes; the end is the last.  Documents begin with a space each, so
        a text's last byte is never such a space."""
        gap = np.zeros(len(data) + 1, bool)
        other = data != 32
        gap[1:-2] = ~other[1:-1] & other[:-2] & other[2:]
        gap[offsets] = True
        return np.flatnonzero(gap)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all documents of a block, each with its leading space, and n + 1 offsets."""
        cuts = self.cuts(data, offsets)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        units = coded.dictionary.to_pylist()
        if len(self.cache) > CACHE_UNITS:
            self.cache = {}
        fresh = [u for u in units if u not in self.cache]
        known = {}
        for k in range(0, len(fresh), 5000):
            part = fresh[k : k + 5000]
            for u, ids in zip(part, self.model.encode([u[1:].decode("utf-8", "replace") for u in part], num_threads=1), strict=True):
                (self.cache if len(u) <= LONG_UNIT else known)[u] = np.array(ids, np.uint32).tobytes()
        return spread([known[u] if u in known else self.cache[u] for u in units], coded.indices, cuts, offsets)


_SIDES: dict[str, ByteSide | PieceSide] = {}


def side(path: str) -> ByteSide | PieceSide:
    if path not in _SIDES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _SIDES[path] = PieceSide(path) if path.endswith(".model") else ByteSide(path)
    return _SIDES[path]


class Lengths:
    """Token bytes of a side as arrays."""

    def __init__(self, tokens: list[bytes]):
        self.n = len(tokens)
        self.kind = np.uint16 if self.n <= 1 << 16 else np.uint32
        self.bytes = np.array([len(t) for t in tokens], np.int64)
        self.table = pa.array(tokens, pa.large_binary())

    def joined(self, ids: np.ndarray) -> np.ndarray:
        flat = self.table.take(pa.array(ids))
        _, at, raw = flat.buffers()
        return np.frombuffer(raw, np.uint8)[: np.frombuffer(at, np.int64)[len(flat)]] if len(flat) else np.zeros(0, np.uint8)


def with_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer with a space before each document that isn't empty."""
    lead = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][lead], 32), offsets + np.concatenate([[0], np.cumsum(lead)])


def given_back(lengths: Lengths, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each document's tokens join to its bytes."""
    got, sizes = lengths.joined(ids), np.concatenate([[0], np.cumsum(lengths.bytes[ids])])[at]
    if np.array_equal(sizes, offsets) and np.array_equal(got, data):
        return np.ones(len(offsets) - 1, bool)
    return np.array([np.array_equal(got[a:b], data[c:d]) for a, b, c, d in zip(sizes, sizes[1:], offsets, offsets[1:], strict=False)], bool)


def events(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """(doc, id, side, start, ids): chunks of both sides' tokens, in order of their first byte; each document has a row at least."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        a, b = side(path_a), side(path_b)
        sides = [(a, Lengths(a.tokens)), (b, Lengths(b.tokens))]
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw, at = text_buffer(batch.column(1))
            for i, j in doc_blocks(at, TEXT_BYTES):
                data, offsets = with_spaces(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                tokens = [s.block(data, offsets) if len(data) else (np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)) for s, _ in sides]
                whole = np.logical_and.reduce([given_back(n, *t, data, offsets) for (_, n), t in zip(sides, tokens, strict=True)])
                rows = []
                for k in range(j - i):
                    for s, (ids, cut) in enumerate(tokens):
                        own = ids[cut[k] : cut[k + 1]] if whole[k] else ids[:0]
                        start = 0
                        for c in range(0, len(own) or 1 - s, chunk):
                            part = own[c : c + chunk]
                            rows.append((number + k, i + k, s, start, part.astype(sides[s][1].kind).tobytes()))
                            start += int(sides[s][1].bytes[part].sum())
                number += j - i
                doc, place, which, start, ids = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(doc, pa.int64()), batch.column(0).take(pa.array(place)), pa.array(which, pa.int32()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc", "id", "side", "start", "ids"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(tidy(run), f"doc long, id {kind}, side int, start long, ids binary")


class Sweep:
    """One pass over the end events of a document: groups and links as they come."""

    def __init__(self, a: Lengths, b: Lengths):
        self.sides = (a, b)
        digits = [str(k) for k in range(max(a.n, b.n))]
        self.written = pa.array([s + d for d in digits for s in ("", ",", "|", ";")], pa.large_string())
        self.begin()

    def begin(self) -> None:
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.last, self.done = [0, 0], 0
        self.n, self.groups, self.links = [0, 0], 0, 0
        self.digest, self.keys = hashlib.sha256(), []

    def push(self, side: int, ids: np.ndarray) -> None:
        if not len(ids):
            return
        ids = ids.astype(np.int64)
        ends = np.cumsum(self.sides[side].bytes[ids]) + self.last[side]
        self.last[side] = int(ends[-1])
        self.n[side] += len(ids)
        self.ids[side] = np.concatenate([self.ids[side], ids]) if len(self.ids[side]) else ids
        self.ends[side] = np.concatenate([self.ends[side], ends]) if len(self.ends[side]) else ends
        self.advance()

    def advance(self) -> None:
        """All up to where both sides are known."""
        (a, b), (ea, eb), upto = self.ids, self.ends, min(self.last)
        if upto <= self.done:
            return
        new = [e[np.searchsorted(e, self.done, "right") : np.searchsorted(e, upto, "right")] for e in (ea, eb)]
        at = np.union1d(*new)
        ia, ib = np.searchsorted(ea, at), np.searchsorted(eb, at)
        self.keys.append(a[ia] * self.sides[1].n + b[ib])
        self.links += len(at)
        self.done = int(upto)
        both = at[(ea[ia] == at) & (eb[ib] == at)]
        if len(both):
            self.close(np.searchsorted(ea, both, "right"), np.searchsorted(eb, both, "right"))

    def close(self, ca: np.ndarray, cb: np.ndarray) -> None:
        """Groups that end after ca[k] tokens of A and cb[k] of B are written and let go."""
        na, nb, k = int(ca[-1]), int(cb[-1]), np.arange(len(ca))
        fa, fb = np.concatenate([[0], ca[:-1]]), np.concatenate([[0], cb[:-1]])  # each group's first tokens
        mark_a, mark_b = np.ones(na, np.int64), np.ones(nb, np.int64)
        mark_a[fa], mark_b[fb] = 3, 2
        if not self.groups:
            mark_a[0] = 0
        code = np.empty(na + nb, np.int64)
        code[np.arange(na) + np.repeat(fb, ca - fa)] = self.ids[0][:na] * 4 + mark_a
        code[np.arange(nb) + np.repeat(ca, cb - fb)] = self.ids[1][:nb] * 4 + mark_b
        flat = self.written.take(pa.array(code))
        _, at, raw = flat.buffers()
        self.digest.update(memoryview(raw)[: int(np.frombuffer(at, np.int64)[len(flat)])])
        self.groups += len(k)
        self.ids, self.ends = [self.ids[0][na:], self.ids[1][nb:]], [self.ends[0][na:], self.ends[1][nb:]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct id pairs of the document's links (a * size of B + b), ascending, and how often each occurs."""
        return np.unique(np.concatenate(self.keys), return_counts=True) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Tally:
    """Counts of keys that come in pieces, added up now and then."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.parts.append((keys, times))
        self.size += len(keys)
        if len(self.parts) > 1 and self.size > 1 << 20:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0]) // 2  # so that a large table isn't added up again for every piece

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
        return (keys[first], np.add.reduceat(times, first)) if len(keys) else (keys, times)


def swept(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, chunk: int = CHUNK, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Rows of kind 1, one for each document with its counts and pairs, and of kind 0, the pairs of each block of documents."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        a, b = Lengths(side(path_a).tokens), Lengths(side(path_b).tokens)
        sweep, tally, links = Sweep(a, b), Tally(), 0
        block, now, own, out = TaskContext.get().partitionId() << 32, None, None, []

        def finish():
            nonlocal links
            keys, times = sweep.pairs()
            tally.add(keys, times)
            links += sweep.links
            out.append((1, block, own, *sweep.n, sweep.groups, sweep.links, sweep.digest.hexdigest() if sweep.links else "", keys, times))

        def flush(end: bool):
            nonlocal out, tally, links, block
            if end or links >= block_links:
                keys, times = tally.total()
                out += [(0, block, None, 0, 0, 0, 0, "", keys[k : k + CHUNK], times[k : k + CHUNK]) for k in range(0, len(keys), CHUNK)]
                tally, links, block = Tally(), 0, block + 1
            if out:
                cols = list(zip(*out, strict=True))
                ids = pa.array(cols[2], id_type)
                lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int32), pa.array(np.concatenate(c), t)) for c, t in ((cols[8], pa.int64()), (cols[9], pa.int64()))]
                yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), ids, *[pa.array(c, pa.int64()) for c in cols[3:7]], pa.array(cols[7], pa.string()), *lists], names=names)
            out = []

        id_type = pa.null()
        for batch in batches:
            id_type = batch.schema.field(1).type
            docs_, sides_ = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for k, (doc, s, ids) in enumerate(zip(docs_, sides_, batch.column(4), strict=True)):
                if doc != now:
                    if now is not None:
                        finish()
                        if links >= block_links or len(out) >= 2000:
                            yield from flush(False)
                    now, own = doc, batch.column(1)[k].as_py()
                    sweep.begin()
                sweep.push(s, np.frombuffer(ids.as_buffer(), sweep.sides[s].kind))
        if now is not None:
            finish()
            yield from flush(True)

    names = ["kind", "block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"]
    schema = f"kind int, block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<long>"
    dealt = events(docs, id_col, text_col, path_a, path_b, chunk).repartition("doc").sortWithinPartitions("doc", "start", "side")
    return dealt.mapInArrow(tidy(run), schema)


def pair_counts(asked: DataFrame, n_b: int) -> DataFrame:
    """(key, n, n_blocks, best): links of each id pair over the corpus, and whether none of its B id has more."""
    counts = saved(asked.groupBy("key").agg(F.sum("times").alias("n"), F.count("*").alias("n_blocks")))
    b = F.pmod("key", F.lit(n_b)).alias("b")
    most = F.broadcast(counts.groupBy(b).agg(F.max("n").alias("most")))  # a row for each id of B at most
    return counts.withColumn("b", b).join(most, "b").select("key", "n", "n_blocks", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, block_links: int = BLOCK_LINKS) -> DataFrame:
    """(id, ``RESULTS``) of each row of ``docs``; chunk, block_links: tokens of a row of events, links of a block."""
    n_b = len(side(path_b).tokens)
    rows = saved(swept(docs, id_col, text_col, path_a, path_b, chunk, block_links))
    asked = rows.where("kind = 0").select("block", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("block", "p.*").withColumnRenamed("keys", "key")
    pairs = pair_counts(asked, n_b)
    total = pairs.agg(F.sum("n_blocks")).first()[0] or 0
    told = heavy_join(asked.select("block", "key"), pairs, "key", "block", total, "n_blocks")
    told = told.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("key", "n", "best"))).alias("told"))
    kind = docs.schema[id_col].dataType.simpleString()
    own = rows.where("kind = 1").withColumn("told", F.lit(None).cast("array<struct<key: bigint, n: bigint, best: boolean>>"))
    both = own.unionByName(told.withColumn("kind", F.lit(0)), allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    names = ["id", *RESULTS]

    def run(batches):
        keys = counts = best = None
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            sums = []
            for k, what in enumerate(cols["kind"].to_pylist()):
                if what == 0:
                    part = cols["told"][k].values
                    keys, counts, best = (x.to_numpy(zero_copy_only=False) for x in part.flatten())
                    continue
                own, times = (cols[n][k].values.to_numpy(zero_copy_only=False) for n in ("keys", "times"))
                if len(own):
                    at = np.searchsorted(keys, own)
                    sums.append((k, int(times[best[at]].sum()), int((times * counts[at]).sum())))
                else:
                    sums.append((k, 0, 0))
            if sums:
                place, n_best, total = zip(*sums, strict=True)
                place = pa.array(place)
                yield pa.record_batch([*[cols[n].take(place) for n in ("id", "n_a", "n_b", "n_groups", "n_links")], pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), cols["groups_sha256"].take(place)], names=names)

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return both.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
