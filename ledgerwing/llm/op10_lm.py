"""Language-model scoring with a weighted backoff automaton.

Tokens are the lower-case (A-Z) words of a text and one end token.  Every word has a
smoothed unigram probability from its exact count in all training texts.  All
2- and 3-grams with a count of ``MIN_COUNT`` or more, of whatever words, are arcs of the
automaton.  Its states are the contexts that have arcs; a state's failure arc leads to
its longest proper suffix and carries the backoff weight, the discounted mass over the
mass that the suffix leaves, so each state's probabilities sum to one.  ``Automaton``
is the plain form for small vocabularies; ``score`` gives the same sums without ever
holding the whole automaton, which grows with the corpus.

Documents form blocks (ranges of ids, of about ``BLOCK_TEXT`` bytes; beyond ``MOST_RANGES`` ranges, parts of ranges).  Each block asks for the total counts of its own
distinct words and grams, and a shuffle by key brings them back.  A block then builds its part of the automaton,
every state, arc and failure arc that its texts can use, and walks the texts: one traversal from left to right that carries
the state and adds the arcs' log-probabilities.  The failure arcs it took are weighed at the end: the first block that asks
for a gram adds it to its context's sums, and a second shuffle by context brings back the backoff weights.
Keys travel as sorted, compressed arrays, a row for each block and range of keys; what comes back is a bit for each
key and the counts of the known ones, as a block tells its keys from its texts.

Words are told apart by 64-bit hashes, grams by as many bits as ``GUARD_BITS`` asks for.  Nulls: a null text is an empty one (its end token is
scored); a null id is in the first block and counts as the empty string in the hold-out
rule.  Without training rows N is 0, and every token has the base probability 1
of V = 0 words.  Repeated rows are all counted and scored; an empty table gives an empty
result.
"""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stores import saved as staged
from .common import mix, text_buffer, tidy, word_hashes
from .op3_language_id import held_out
from .op9_fingerprint import in_range, ranges

MIN_COUNT = 2
DISCOUNT = 0.5
END = np.uint64(0x5F3759DF5F3759DF)
BLOCK_TEXT, LEAST_BLOCKS = 8 << 20, 8
FLUSH = 8_000_000
#: Bits of a gram's key beyond those of the number of bytes of all texts: a gram shares its key with another
#: of the corpus with a chance under 1 to 2 ** GUARD_BITS, whatever its size.
GUARD_BITS = 18
PACK_BYTES = 16 << 20
MOST_RANGES = 1 << 16
#: Counts are gathered in so many rounds, each of an equal range of keys: the texts are read as often, and the shuffle is that much smaller.
ROUNDS = 2


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each document, and the offsets."""
    h, at = word_hashes(*text_buffer(texts), lower=True)
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def _grams(h: np.ndarray, at: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, but for their ``drop`` last bits, of the 2- and 3-gram that end at each token, and whether the document has them."""
    two, three = np.zeros_like(h), np.zeros_like(h)
    two[1:] = mix(mix(h[:-1]) + h[1:])
    three[2:] = mix(mix(two[1:-1]) + h[2:] * np.uint64(0x9E3779B97F4A7C15))
    place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    cut = np.uint64(drop)
    return two >> cut << cut, three >> cut << cut, place >= 1, place >= 2


def _planes(x: np.ndarray) -> bytes:
    """Integers from 0 on, low bytes first, byte by byte: the first byte is their width."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], n).T
    return out.view("<u8").ravel()


def _diffs(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, after the first."""
    return keys[:1].tobytes() + _planes(np.diff(keys)) if len(keys) else b""


def _undiffs(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1), _unplanes(raw[8:], n - 1)]), dtype=np.uint64)


def _squeezed(raw: bytes) -> bytes:
    return struct.pack("<I", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _loose(raw: bytes) -> bytes:
    return pa.decompress(raw[4:], struct.unpack("<I", raw[:4])[0], codec="zstd", asbytes=True)


def _words_first(gram: np.ndarray) -> np.ndarray:
    """The order of packed keys: words, then grams, each ascending."""
    return np.argsort(gram, kind="stable")


def _packed(keys: np.ndarray, gram: np.ndarray, drop: int) -> bytes:
    """Sorted keys, words before grams; of grams without the ``drop`` bits that are 0."""
    words = _diffs(keys[~gram])
    return _squeezed(struct.pack("<II", int((~gram).sum()), len(words)) + words + _diffs(keys[gram] >> np.uint64(drop)))


def _unpacked(raw: bytes, n: int, drop: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and which are grams."""
    raw = _loose(raw)
    words, cut = struct.unpack("<II", raw[:8])
    gram = np.zeros(n, bool)
    gram[words:] = True
    return np.concatenate([_undiffs(raw[8 : 8 + cut], words), _undiffs(raw[8 + cut :], n - words) << np.uint64(drop)]), gram


def _numbers(x: np.ndarray) -> bytes:
    return _squeezed(_planes(x))


def _dest(keys: np.ndarray, n_dest: int) -> np.ndarray:
    """The range that each key lies in."""
    return ((keys >> np.uint64(32)) * np.uint64(n_dest) >> np.uint64(32)).astype(np.int64)


def _dealt(keys: np.ndarray, n_dest: int):
    """(dest, slice) of the ranges of keys among sorted ones."""
    dest = _dest(keys, n_dest)
    edges = [0, *(np.flatnonzero(np.diff(dest)) + 1).tolist(), len(keys)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield int(dest[a]), slice(a, b)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _distinct(keys: np.ndarray, n: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of n; a word and a gram are never the same."""
    sides = [(*_summed(keys[gram == g], n[gram == g].astype(np.int64)), g) for g in (False, True)]
    keys, n = (np.concatenate([side[k] for side in sides]) for k in (0, 1))
    gram = np.repeat([False, True], [len(side[0]) for side in sides])
    order = np.lexsort((gram, keys))
    return keys[order], n[order], gram[order]


def _runs(batches, column: int):
    """(value, piece) of runs of equal values in a column, batch by batch."""
    for batch in batches:
        value = batch.column(column).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield int(value[a]), batch.slice(a, b - a)


def _groups(batches, column: int):
    """(value, pieces) of whole runs of equal values."""
    at, held = None, []
    for value, piece in _runs(batches, column):
        if value != at and held:
            yield at, held
            held = []
        at = value
        held.append(piece)
    if held:
        yield at, held


ASKED = "dest long, block long, size long, keys binary, nums binary"


def asked(docs: DataFrame, n_dest: int, drop: int, part: int = 0, parts: int = 1) -> DataFrame:
    """``ASKED`` of ``docs`` (block, held_out, text): the distinct words and grams of each block as
    a task saw them; nums has the count in training rows.  Of ``parts`` equal ranges of keys, a power of two, only one is asked for."""
    share = np.uint64(65 - parts.bit_length())

    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def flush():
            for block, parts in held.items():
                keys, n, gram = _distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                cut = [(d, s) for d, s in _dealt(keys, n_dest)]
                for k in range(0, len(cut), 64):
                    own = cut[k : k + 64]
                    yield pa.record_batch([
                        pa.array([d for d, _ in own], pa.int64()), pa.array([block] * len(own), pa.int64()), pa.array([s.stop - s.start for _, s in own], pa.int64()),
                        pa.array([_packed(keys[s], gram[s], drop) for _, s in own], pa.binary()), pa.array([_numbers(n[s][_words_first(gram[s])]) for _, s in own], pa.binary()),
                    ], names=["dest", "block", "size", "keys", "nums"])
            held.clear()

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                for block, piece in _runs([batch.slice(k, 1000)], 0):
                    h, at = _tokens(piece.column(2))
                    two, three, has_two, has_three = _grams(h, at, drop)
                    train = np.repeat(~np.asarray(piece.column(1).to_pylist(), bool), np.diff(at)).astype(np.int32)
                    for keys, n, gram in ((h, train, 0), (two[has_two], train[has_two], 1), (three[has_three], train[has_three], 1)):
                        if parts > 1:
                            own = keys >> share == part
                            keys, n = keys[own], n[own]
                        keys, n = _summed(keys, n)
                        held.setdefault(block, []).append((keys, n, np.full(len(keys), gram, bool)))
                        size += len(keys)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(tidy(run), ASKED)


KNOWN = "dest long, block long, size long, keys binary, nums binary, n_tokens long, n_words long"


def totals(rows: DataFrame, drop: int) -> DataFrame:
    """``KNOWN`` of ``ASKED``: for each block and range of keys one row: of the block's ``size`` distinct words, then grams, in
    order, a bit for each that is known (grams with ``MIN_COUNT`` or more, words with any); nums has twice their total, and 1 more
    where the block is the first that asks for a gram.  A block can tell its keys from its texts, so they aren't sent back.
    Each range's tokens and words are on one row."""

    def run(batches):
        for dest, pieces in _groups(batches, 0):
            asked_by: dict[int, list] = {}
            for p in pieces:
                for block, n, raw, num in zip(*(p.column(k).to_pylist() for k in range(1, 5)), strict=True):
                    asked_by.setdefault(block, []).append((*_unpacked(raw, n, drop), _unplanes(_loose(num), n).astype(np.int64)))
            own = {}
            for block, parts in asked_by.items():
                keys, gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                own[block] = _distinct(keys, n, gram)
            flat, num, grams = (np.concatenate(x) for x in zip(*own.values(), strict=True))
            del asked_by
            order = np.lexsort((grams, flat))  # stable, so of equal keys the first block's comes first
            new = np.concatenate([[True], (flat[order][1:] != flat[order][:-1]) | (grams[order][1:] != grams[order][:-1])])
            first = np.flatnonzero(new)
            total = np.add.reduceat(num[order], first)
            gram = grams[order[first]]
            of = np.empty(len(flat), np.int64)
            of[order] = np.cumsum(new) - 1
            owner = np.zeros(len(flat), np.int64)
            owner[order[first[gram]]] = 1
            kept = np.where(gram, total >= MIN_COUNT, total > 0)
            sums = [int(total[~gram].sum()), int((total[~gram] > 0).sum())]
            at = 0
            for block, (keys, _, own_gram) in own.items():
                s = slice(at, at + len(keys))
                at += len(keys)
                place = _words_first(own_gram)
                some = kept[of[s]][place]
                values = (2 * total[of[s]] + owner[s])[place][some]
                if some.any() or sums[0]:
                    yield pa.record_batch([
                        pa.array([dest], pa.int64()), pa.array([block], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([_squeezed(np.packbits(some).tobytes())], pa.binary()),
                        pa.array([_numbers(values)], pa.binary()), pa.array(sums[:1], pa.int64()), pa.array(sums[1:], pa.int64()),
                    ], names=["dest", "block", "size", "keys", "nums", "n_tokens", "n_words"])
                    sums = [0, 0]

    return rows.mapInArrow(tidy(run), KNOWN)


def packed(docs: DataFrame) -> DataFrame:
    """(block, kind, size, keys, nums) of ``docs`` (block, id, held_out, text): rows of one block as compressed Arrow streams in ``keys``."""

    def run(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        size = 0

        def flush():
            for block, parts in held.items():
                rows = pa.Table.from_batches(parts).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows)
                yield pa.record_batch([
                    pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([rows.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, pa.binary()),
                ], names=["block", "kind", "size", "keys", "nums"])
            held.clear()

        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            for k in range(0, batch.num_rows, 500):
                for block, piece in _runs([batch.slice(k, 500)], 0):
                    held.setdefault(block, []).append(piece.select(["id", "held_out", "text"]))
                    size += int(text_buffer(piece.column("text"))[1][-1])
                if size > PACK_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(tidy(run), "block long, kind int, size long, keys binary, nums binary")


class Automaton:
    """States, arcs and failure arcs over a sorted vocabulary.

    ``arcs[state << 20 | word]`` is (log10 probability, next state); ``fail[state]`` is
    (log10 backoff weight, state); ``enter[word]`` is the state after a word
    that was scored as a unigram.  State 0 has no context.
    """

    def __init__(self, vocab: np.ndarray, counts: np.ndarray, uni: np.ndarray, grams: dict[int, dict[int, int]]):
        """counts, uni: training count and unigram probability of each vocabulary word."""
        self.vocab = vocab
        two, three = grams.get(2, {}), grams.get(3, {})
        children: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for g, n in two.items():
            children.setdefault((g >> 20,), []).append((g & 0xFFFFF, n))
        for g, n in three.items():
            if g >> 20 in two and g & 0xFFFFFFFFFF in two:
                children.setdefault((g >> 40, g >> 20 & 0xFFFFF), []).append((g & 0xFFFFF, n))
        contexts = sorted(children, key=lambda c: (len(c), c))
        state = {c: k + 1 for k, c in enumerate(contexts)}
        self.enter = [state.get((w,), 0) for w in range(len(vocab))]
        self.fail = [(0.0, 0)]
        self.arcs: dict[int, tuple[float, int]] = {}
        prob: dict[int, float] = {}
        for c in contexts:
            s, total = state[c], int(counts[c[0]]) if len(c) == 1 else two[c[0] << 20 | c[1]]
            lower = state.get(c[1:], 0) if len(c) > 1 else 0
            kept = given = 0.0
            for w, n in children[c]:
                p = (n - DISCOUNT) / total
                kept += p
                given += self._lower(prob, lower, w, uni)
                prob[s << 20 | w] = p
                nxt = state.get((c[-1], w)) or state.get((w,), 0)
                self.arcs[s << 20 | w] = (float(np.log10(p)), nxt)
            weight = max(1 - kept, 1e-12) / max(1 - given, 1e-12)
            self.fail.append((float(np.log10(weight)), lower))

    def _lower(self, prob: dict[int, float], s: int, w: int, uni: np.ndarray) -> float:
        """Probability of w in state s, through failure arcs."""
        factor = 1.0
        while s:
            if s << 20 | w in prob:
                return factor * prob[s << 20 | w]
            weight, s = self.fail[s]
            factor *= 10.0**weight
        return factor * float(uni[w])

    def walk(self, ids: list[int], logs: list[float]) -> float:
        """Sum over the tokens of a text: places in the vocabulary (-1: another
        word) and their unigram log-probabilities."""
        arcs, fail, enter = self.arcs.get, self.fail, self.enter
        total, s = 0.0, 0
        for w, uni in zip(ids, logs, strict=True):
            if w < 0:
                while s:
                    weight, s = fail[s]
                    total += weight
                total += uni
                continue
            while s:
                arc = arcs(s << 20 | w)
                if arc is not None:
                    break
                weight, s = fail[s]
                total += weight
            if s:
                total += arc[0]
                s = arc[1]
            else:
                total += uni
                s = enter[w]
        return total


HALF = "kind int, dest long, block long, size long, id long, held_out boolean, n_tokens long, n_known long, base double, part double, keys binary, nums binary"
HALF_NAMES = [c.split()[0] for c in HALF.split(", ")]


#: Tokens of a text that one column of a walk takes; a later piece is entered by walking the two tokens before it, which
#: are all that a state can know.
PIECE = 512


class Block:
    """One block's part of the automaton, all that its texts can use, and what its documents leave to the contexts' weights.

    A state is the place of its context among the known keys: a word's for one word, a 2-gram's for two (-1: none).  An arc is
    a known gram; ``source`` is the state that it leaves, ``target`` the one it leads to, ``fail`` a state's failure arc.
    """

    def __init__(self, rows: list[tuple[int, int, bytes, bytes]], texts: list[tuple[np.ndarray, np.ndarray]], below: float, drop: int, n_dest: int):
        """rows: (dest, size, bits, nums) of ``KNOWN``; texts: tokens and offsets of all batches, from which the keys are told."""
        h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in texts)])
        self.at = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(np.diff(at) for _, at in texts)]))
        two, three, has_two, has_three = _grams(h, self.at, drop)
        words, w = np.unique(h, return_inverse=True)
        n_two = int(has_two.sum())
        grams, g = np.unique(np.concatenate([two[has_two], three[has_three]]), return_inverse=True)
        del h, two, three
        sides = words, grams
        edges = [np.searchsorted(_dest(x, n_dest), np.arange(n_dest + 1)) for x in sides]
        values = [np.full(len(x), -1, np.int64) for x in sides]
        for d, size, bits, nums in rows:
            own = [slice(e[d], e[d + 1]) for e in edges]
            cut = own[0].stop - own[0].start
            if cut + own[1].stop - own[1].start != size:
                raise ValueError(f"range {d} has {size} keys, and its block other ones")
            some = np.unpackbits(np.frombuffer(_loose(bits), np.uint8), count=size).astype(bool)
            got = np.full(size, -1, np.int64)
            got[some] = _unplanes(_loose(nums), int(some.sum())).astype(np.int64)
            values[0][own[0]], values[1][own[1]] = got[:cut], got[cut:]
        kept = [v >= 0 for v in values]
        keys = np.concatenate([x[k] for x, k in zip(sides, kept, strict=True)])
        gram = np.repeat([False, True], [int(k.sum()) for k in kept])
        nums = np.concatenate([v[k] for v, k in zip(values, kept, strict=True)])
        order = np.lexsort((gram, keys))
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.arange(len(keys), dtype=np.int32)
        place = [np.full(len(x), -1, np.int32) for x in sides]
        place[0][kept[0]], place[1][kept[1]] = np.split(rank, [int(kept[0].sum())])
        #: Of each token the places of its word and of the grams that end with it, -1 for unknown ones.
        self.w, self.two, self.three = place[0][w], np.full(len(w), -1, np.int32), np.full(len(w), -1, np.int32)
        self.two[has_two], self.three[has_three] = place[1][g[:n_two]], place[1][g[n_two:]]
        self.known, self.gram, self.drop = keys[order], gram[order], drop
        self.n, self.owed = nums[order] >> 1, nums[order] & 1 == 1
        self.below, self.docs = below, []
        self.used = np.zeros(len(self.known), bool)
        self.sums: list[tuple[np.ndarray, ...]] = []
        #: One more entry at the end, for place -1.
        self.source, self.target, self.fail = (np.full(len(self.known) + 1, -1, np.int64) for _ in range(3))
        self.log = np.zeros(len(self.known) + 1)
        self.enter = np.append(np.where(~self.gram & (self.n >= MIN_COUNT), np.arange(len(self.known)), -1), -1)

    def _states(self, w: np.ndarray, two: np.ndarray, three: np.ndarray, w0: np.ndarray, two0: np.ndarray):
        """Arcs and failure arcs of the grams that a batch of texts has."""
        for gram, context, target in ((two, w0, two), (three, two0, two)):
            own = np.flatnonzero(gram >= 0)
            self.source[gram[own]] = context[own]
            self.target[gram[own]] = target[own]
            self.log[gram[own]] = np.log10((self.n[gram[own]] - DISCOUNT) / self.n[context[own]])
        own = np.flatnonzero(two >= 0)
        self.fail[two[own]] = self.enter[w[own]]
        self.source[-1] = -2  # no arc at place -1 leaves any state

    def walk(self, w: np.ndarray, two: np.ndarray, three: np.ndarray, at: np.ndarray, uni: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One traversal from left to right, a token a step, of all texts side by side: each token's log-probability but for the
        weights of failure arcs, and the states (two at most) whose failure arcs it took."""
        total, failed = np.zeros(len(w)), np.full((len(w), 2), -1, np.int64)
        n = np.diff(at)
        pieces = -(-n // PIECE)
        doc = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = at[:-1][doc] + nth * PIECE
        end = np.minimum(first + PIECE, at[1:][doc])
        begin = np.where(nth > 0, first - 2, first)
        order = np.argsort(begin - end, kind="stable")  # the longest first
        first, begin, end = first[order], begin[order], end[order]
        length, state = end - begin, np.full(len(order), -1, np.int64)
        active = len(order)
        for k in range(int(length[0]) if len(length) else 0):
            while length[active - 1] <= k:
                active = int(np.searchsorted(-length, -k, "left"))
            t, s = begin[:active] + k, state[:active]
            arc = three[t]
            by_three = self.source[arc] == s
            wide = ~by_three & (s >= 0)
            wide[wide] = self.gram[s[wide]]
            low = np.where(wide, self.fail[s], s)
            mid = two[t]
            by_two = ~by_three & (self.source[mid] == low)
            none = ~(by_three | by_two)
            own = t >= first[:active]
            total[t[own]] = np.where(by_three, self.log[arc], np.where(by_two, self.log[mid], uni[t]))[own]
            a, b = own & wide, own & none & (low >= 0)
            failed[t[a], 0], failed[t[b], 1] = s[a], low[b]
            state[:active] = np.where(by_three, self.target[arc], np.where(by_two, self.target[mid], self.enter[w[t]]))
        return total, failed

    def _owe(self, gram: np.ndarray, context: np.ndarray, lower: np.ndarray, whole: np.ndarray, base: np.ndarray):
        """Adds each gram that this block answers for, once, to its context: twice the
        discounted count, twice the lower state's, and what they are shares of."""
        ok = np.flatnonzero(gram >= 0)
        ok = ok[self.owed[gram[ok]]]
        own, at = np.unique(gram[ok], return_index=True)
        at = ok[at]
        self.owed[own] = False
        self.sums.append((context[at], 2 * self.n[own] - 1, lower[at], whole[at], base[at]))

    def add(self, ids: pa.Array, flags: pa.Array, first: int):
        """Documents from the block's ``first`` on."""
        at = self.at[first : first + len(ids) + 1]
        w, two, three = (x[at[0] : at[-1]].astype(np.int64) for x in (self.w, self.two, self.three))
        at = at - at[0]
        nth = np.arange(len(w)) - np.repeat(at[:-1], np.diff(at))
        has_two, has_three = nth >= 1, nth >= 2
        count = lambda x: np.where(x >= 0, self.n[x], 0) if len(self.n) else np.zeros(len(x), np.int64)
        n1, n2 = count(w), count(two)
        w0, two0 = np.concatenate([[-1], w[:-1]]), np.concatenate([[-1], two[:-1]])
        w0[~has_two], two0[~has_three] = -1, -1
        c1, c2 = count(w0), count(two0)
        self._owe(two, w0, 2 * (n1 + 1), c1, np.zeros_like(c1))
        self._owe(three, two0, 2 * n2 - 1, c2, c1)
        base = np.log10((n1 + 1) / self.below)
        self._states(w, two, three, w0, two0)
        part, uses = self.walk(w, two, three, at, base)
        self.used[uses[uses >= 0]] = True
        starts, total = at[:-1], lambda x: np.add.reduceat(x, at[:-1])
        per = [u[u >= 0].astype(np.uint32) for u in (uses[a:b].ravel() for a, b in zip(starts, at[1:], strict=True))]
        self.docs.append((ids, flags, np.diff(at), total((n1 > 0).astype(np.int64)), total(base), total(part), per))

    def rows(self, block: int, n_dest: int):
        """``HALF``: kind 0 asks for contexts' weights and brings sums, kind 1 are documents."""
        none = lambda n, kind: pa.nulls(n, kind)
        context, *sums = (np.concatenate(x) for x in zip(*self.sums, strict=True)) if self.sums else [np.zeros(0, np.int64)] * 5
        _, held, low = _summed(context, *sums[:2])
        at, first = np.unique(context, return_index=True)
        need = self.used.copy()
        need[at] = True
        values = np.zeros((4, len(need)), np.int64)
        values[:, at] = held, low, sums[2][first], sums[3][first]
        dest = _dest(self.known, n_dest)
        order = np.lexsort((self.known, self.gram, dest))  # the order in which weights come back
        own = np.flatnonzero(need)
        keys, gram, want, values = self.known[own], self.gram[own], self.used[own], values[:, own]
        for d, s in _dealt(keys, n_dest):
            first = _words_first(gram[s])
            nums = _squeezed(b"".join(_planes(x[first]) for x in (2 * values[0, s] + want[s], values[1, s], values[2, s], values[3, s])))
            one = [pa.array([x], pa.int64()) for x in (d, block, s.stop - s.start)]
            yield pa.record_batch([pa.array([0], pa.int32()), *one, none(1, pa.int64()), none(1, pa.bool_()), none(1, pa.int64()), none(1, pa.int64()), none(1, pa.float64()), none(1, pa.float64()),
                                   pa.array([_packed(keys[s], gram[s], self.drop)], pa.binary()), pa.array([nums], pa.binary())], names=HALF_NAMES)
        rank = np.zeros(len(self.known), np.int64)
        rank[order[self.used[order]]] = np.arange(int(self.used.sum()))
        for ids, flags, n, seen, base, part, per in self.docs:
            k = len(n)
            uses = pa.array([_planes(np.diff(np.sort(rank[u]), prepend=0)) for u in per], pa.binary())
            yield pa.record_batch([pa.array(np.ones(k, np.int32)), none(k, pa.int64()), pa.array(np.full(k, block, np.int64)), pa.array([len(u) for u in per], pa.int64()), ids, flags,
                                   pa.array(n), pa.array(seen), pa.array(base), pa.array(part), none(k, pa.binary()), uses], names=HALF_NAMES)


def half_scored(rows: DataFrame, below: float, n_dest: int, drop: int) -> DataFrame:
    """``HALF`` of (block, kind, dest, size, keys, nums) sorted by block and kind: totals, then ``packed`` texts."""

    def run(batches):
        at, got, held = None, [], []

        def finish():
            made = Block(got, [tokens for _, _, tokens in held], below, drop, n_dest)
            first = 0
            for ids, flags, _ in held:
                made.add(ids, flags, first)
                first += len(ids)
            yield from made.rows(at, n_dest)

        for batch in batches:
            for block, run_of in _runs([batch], 0):
                if block != at:
                    if held:
                        yield from finish()
                    at, got, held = block, [], []
                for kind, piece in _runs([run_of], 1):
                    if kind == 0:
                        got.extend(zip(*(piece.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True))
                        continue
                    for raw in piece.column(4):
                        for some in pa.ipc.open_stream(raw.as_buffer()).read_all().to_batches(max_chunksize=500):
                            held.append((some.column(0), some.column(1), _tokens(some.column(2))))
        if held:
            yield from finish()

    return rows.mapInArrow(tidy(run), HALF)


def weights(rows: DataFrame, below: float, drop: int) -> DataFrame:
    """(block, dest, size, nums): the log10 backoff weights of the contexts each block wants, in packed
    order (0 without arcs); of (dest, block, size, keys, nums)."""

    def run(batches):
        for dest, pieces in _groups(batches, 0):
            parts = []
            for p in pieces:
                for block, n, raw, num in zip(*(p.column(k).to_pylist() for k in range(1, 5)), strict=True):
                    values, at, num = [], 0, _loose(num)
                    for _ in range(4):
                        end = at + 1 + num[at] * n
                        values.append(_unplanes(num[at:end], n).astype(np.int64))
                        at = end
                    parts.append((block, _unpacked(raw, n, drop)[0], values))
            flat = np.concatenate([k for _, k, _ in parts])
            held, low, whole, base = (np.concatenate([v[k] for _, _, v in parts]) for k in range(4))
            keys, of = np.unique(flat, return_inverse=True)
            add = lambda x: np.bincount(of, weights=x, minlength=len(keys))
            most = lambda x: np.maximum.reduceat(x[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of)) - np.bincount(of)).astype(np.float64)
            has, under = most(whole), most(base)
            kept = add(held >> 1) / 2 / np.maximum(has, 1)
            given = add(low) / 2 / np.where(under > 0, under, below)
            log = np.where(has > 0, np.log10(np.maximum(1 - kept, 1e-12) / np.maximum(1 - given, 1e-12)), 0.0)
            at = 0
            for block, own, values in parts:
                mine = log[of[at : at + len(own)]][values[0] & 1 == 1]
                at += len(own)
                if len(mine):
                    yield pa.record_batch([pa.array([block], pa.int64()), pa.array([dest], pa.int64()), pa.array([len(mine)], pa.int64()), pa.array([mine.astype("<f8").tobytes()], pa.binary())], names=["block", "dest", "size", "nums"])

    return rows.mapInArrow(tidy(run), "block long, dest long, size long, nums binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag_col: str = "held_out") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): rows with
    ``flag_col`` are scored but not learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(flag_col).alias("held_out"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bounds = ranges(rows, "id", "text", BLOCK_TEXT, LEAST_BLOCKS, MOST_RANGES)
    rows = rows.withColumn("block", in_range(F.col("id"), bounds))
    split = -(-size // (BLOCK_TEXT * MOST_RANGES)) or 1  # blocks of a range, where there are more than the most ranges
    if split > 1:
        rows = rows.withColumn("block", F.col("block") * split + F.pmod(F.xxhash64("id", "text"), F.lit(split)))
    n_blocks = split * (len(bounds) + 1)
    n_dest = ROUNDS * -(-n_blocks // ROUNDS)  # so that each range of keys lies in one round
    drop = max(0, 64 - GUARD_BITS - (n_blocks * BLOCK_TEXT - 1).bit_length())
    texts_of = rows.select("block", "held_out", "text")
    counted = [staged(totals(asked(texts_of, n_dest, drop, k, ROUNDS).repartitionById(n_dest, F.col("dest").cast("int")).sortWithinPartitions("dest", "block"), drop)) for k in range(ROUNDS)]
    known = reduce(DataFrame.union, counted)
    tokens, distinct = known.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    below = float(tokens + distinct + 1)

    texts = packed(rows.select("block", "id", "held_out", F.coalesce("text", F.lit("")).alias("text")))
    found = known.select("block", F.lit(0).alias("kind"), "dest", "size", "keys", "nums")
    texts = texts.select("block", "kind", F.lit(None).cast("long").alias("dest"), "size", "keys", "nums")
    half = staged(half_scored(found.union(texts).repartitionById(n_blocks, F.col("block").cast("int")).sortWithinPartitions("block", "kind"), below, n_dest, drop))

    contexts = half.where("kind = 0").select("dest", "block", "size", "keys", "nums")
    back = weights(contexts.repartitionById(n_dest, F.col("dest").cast("int")).sortWithinPartitions("dest", "block"), below, drop)
    nulls = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("held_out", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("part", "double"))]
    parts = half.where("kind = 1").select("block", "kind", "dest", "size", "nums", "id", "held_out", "n_tokens", "n_known", "base", "part")
    dealt = back.select("block", F.lit(0).alias("kind"), "dest", "size", "nums", *nulls).union(parts).repartitionById(n_blocks, F.col("block").cast("int")).sortWithinPartitions("block", "kind", "dest")

    def run(batches):
        at, got, table = None, [], None
        for block, run_of in _runs(batches, 0):
            if block != at:
                at, got, table = block, [], None
            for kind, piece in _runs([run_of], 1):
                if kind == 0:
                    got.extend(np.frombuffer(x, "<f8") for x in piece.column(4).to_pylist())
                    continue
                if table is None:
                    table, got = np.concatenate([*got, np.zeros(1)]), []
                add = [table[np.cumsum(_unplanes(raw, n).astype(np.int64))].sum() for raw, n in zip(piece.column(4).to_pylist(), piece.column(3).to_pylist(), strict=True)]
                full = piece.column(10).to_numpy() + np.array(add)
                yield pa.record_batch([
                    piece.column(5), piece.column(6), piece.column(7), piece.column(8), pa.array(np.full(piece.num_rows, tokens, np.int64)), piece.column(9), pa.array(full, pa.float64()),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out("doc_id", 7, 2)))
