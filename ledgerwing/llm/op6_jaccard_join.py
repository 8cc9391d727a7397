"""Exact n-gram Jaccard join with parity sketches.

A document's set holds the distinct n-word shingles of its lower-cased (A-Z)
words, as 64-bit hashes.  A parity sketch gives each shingle one segment and toggles
it there, so two sketches differ in at most as many places as the sets do.

1. Documents with equal sets become one class (a 64-bit digest, its ``node``).
2. Sizes fall into bands whose limits grow by 1 / threshold, so linked sets lie in the same or
   neighbouring bands, and a pair is compared in the larger one's band.  A band's
   largest possible symmetric difference D is known: of the segments that a set
   fills, linked sets agree in all but D (pigeonhole).  A class emits each filled
   segment's parity (the XOR of its shingles' hashes, a linear digest of the
   segment's bits) as a join key, for its own band and the next.
3. A key of more than ``HOT`` classes (a passage that many documents share) is given up by
   every class that fills more segments than D and its hot keys together: a linked
   class still meets it in another key.  Classes that can't spare their hot
   keys, such as those of large groups of near copies, keep them.
4. Each class is compared with one other of another component, of the outermost classes of its keys the
   one it shares most keys with: by bit sketches, whose Hamming distance is a lower bound of the
   symmetric difference, and if that allows a link, on the texts' sets.  ``ROUNDS`` such rounds
   connect nearly all copies.
5. Keys whose classes are still in several components are compared by bit sketches: a small
   key in one unit, a larger one in blocks of ``BLOCK``, where only what lies outside the
   key's largest component meets all blocks.  Pairs that may be
   linked are verified best first, and those that turn out connected meanwhile are left out, until none is left.

No pairs of a group are listed: only pairs that no verified link connects and that
the sketches can't refute.  All steps are exact, whatever ``HOT``, ``ROUNDS`` and ``BLOCK`` are.

Nulls: a null or empty text has no shingles and links with nothing; a null id
gets no component and takes no part.  Equal rows share a class; an empty table
gives an empty result.  Columns other than id and text play no part; ``one_of_each``
passes them on under whatever names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..stores import heavy, saved
from .common import maybe_in, mix, shingles, text_buffer, tidy, word_hashes

HOT = 64
BLOCK = 1024
ROUNDS = 4
#: Pairs that are compared at a time.
PAIRS = 500_000


class Bands:
    """Size bands of a join at ``num / den``: linked means den * |A & B| >= num * |A | B|."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def band(self, size: int) -> int:
        """The band of a size: band k ends at ``limit(k)``."""
        k = max(0, int(math.log(size) / math.log(self.den / self.num)) - 1)
        while self.limit(k) < size:
            k += 1
        while k and self.limit(k - 1) >= size:
            k -= 1
        return k

    def limit(self, k: int) -> int:
        """Largest size in band k; a set linked to one of band k is in k - 1, k or k + 1."""
        return int((self.den / self.num) ** (k + 1) * (1 + 1e-9))

    def difference(self, k: int) -> int:
        """Largest symmetric difference of linked sets, the larger in band k."""
        return 2 * self.limit(k) * (self.den - self.num) // (self.den + self.num)

    def segments(self, k: int) -> int:
        """Segments of band k's sketches: the least number at which the smallest sets that are
        compared in the band fill a fifth more than ``difference(k)``, and with a chance of
        some 1e-4 to the contrary (four standard deviations) more than ``difference(k)``.

        What a set fills beyond ``difference(k)`` is the number of hot keys it can spare;
        a set that fills no more has keys of its own kind (``segment_keys``).
        """
        least = self.difference(k)
        low = max(1, math.ceil(self.limit(max(k - 1, 0)) * self.num / self.den))
        for n in range(least + 1, 4 * (least + 4)):
            p1, p2 = (1 - 1 / n) ** low, (1 - 2 / n) ** low
            filled = n * (1 - p1)
            spread = max(0.0, n * (n - 1) * p2 + n * p1 - (n * p1) ** 2)
            if filled >= least * 6 / 5 + 1 and filled - 4 * math.sqrt(spread) > least:
                return n
        return 4 * (least + 4)

    def sketch_words(self, size: int) -> int:
        """64-bit words of a bit sketch: a power of 2 with at least 16 bits for each
        element of the largest difference, so that few meet in a bit and sets a little too far apart show it."""
        return 1 << (max(1, -(-16 * self.difference(self.band(size)) // 64)) - 1).bit_length()

    def linked(self, shared: int, a: int, b: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = word_hashes(*text_buffer(texts), lower=True)
    return [np.unique(shingles(words[a:b], n)) for a, b in zip(at, at[1:], strict=False)]


def _segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(segments)).astype(np.int64)


def spare_keys(hashes: np.ndarray, bands: Bands) -> int:
    """How many keys, of both bands together, a set can do without: what it fills beyond the largest
    difference, in the band where that is less."""
    band = bands.band(len(hashes))
    return max(0, min(int((np.bincount(_segment_of(hashes, bands.segments(b))) > 0).sum()) - bands.difference(b) for b in (band, band + 1)))


def segment_keys(hashes: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """Join keys of one set in one band.

    A key is a hash of band, segment and the segment's parity.  Two linked sets that both fill
    no more segments than the largest difference might agree in empty ones alone; such a set also
    has a key for each size, from its own on, that a set linked to it can have.
    """
    segments, apart = bands.segments(band), bands.difference(band)
    of = _segment_of(hashes, segments)
    order = np.argsort(of, kind="stable")
    present, starts = np.unique(of[order], return_index=True)
    parity = np.bitwise_xor.reduceat(hashes[order], starts)
    keys = mix(parity ^ mix(present.astype(np.uint64) + np.uint64(band << 32 | 1)))
    if len(present) <= apart:
        sizes = np.arange(len(hashes), bands.den * len(hashes) // bands.num + 1, dtype=np.uint64)
        keys = np.concatenate([keys, mix(sizes ^ mix(np.array([band << 33 | 1 << 32], np.uint64)))])
    return keys.view(np.int64)


def bit_sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parity bits of a set: each shingle toggles one of ``64 * words`` bits (words: a power of 2)."""
    bits = np.bincount((mix(hashes ^ np.uint64(0xA5A5A5A5)) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch with ``words`` words of the same set."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def class_node(hashes: np.ndarray) -> int:
    """The number of a set's class: a 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches, n: int):
    """Pieces of the batches with the shingle sets of their last column."""
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            piece = batch.slice(k, 1000)
            yield piece, shingle_sets(piece.column(piece.num_columns - 1), n)


def classes_of(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """(doc_id, n_shingles, node, bits, spare) of (doc_id, text) rows; empty sets have no node."""

    def run(batches):
        for piece, sets in _sets(batches, n):
            nodes = [class_node(s) if len(s) else None for s in sets]
            bits = [bit_sketch(s, bands.sketch_words(len(s))).tobytes() if len(s) else None for s in sets]
            spare = [spare_keys(s, bands) if len(s) else None for s in sets]
            yield pa.record_batch([
                piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), pa.array(spare, pa.int64()),
            ], names=["doc_id", "n_shingles", "node", "bits", "spare"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, node long, bits binary, spare long")


def class_keys(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """(key, node): the join keys of (text) rows' classes, each class once for every batch it is in."""

    def run(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, sets in _sets([batch], n):
                nodes, keys = [], []
                for s in sets:
                    if len(s) and (node := class_node(s)) not in seen:
                        seen.add(node)
                        band = bands.band(len(s))
                        for b in (band, band + 1):
                            keys.append(segment_keys(s, b, bands))
                            nodes.append(np.full(len(keys[-1]), node, np.int64))
                if keys:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in (keys, nodes)], names=["key", "node"])

    return docs.mapInArrow(tidy(run), "key long, node long")


def shared_keys(keys: DataFrame, classes: DataFrame, hot: int) -> DataFrame:
    """(key, node, alike): keys that several classes have, without the hot keys that classes (node, spare) can do without.

    Keys of the very same classes, as those of a passage that two texts share, say the same: one stays and has their number as ``alike``.
    """
    own = Window.partitionBy("key")
    many = keys.withColumns({"_low": F.min("node").over(own), "_top": F.max("node").over(own), "_n": F.count("*").over(own)})
    many = saved(many.where("_low <> _top").drop("_low", "_top").distinct())
    own_hot = many.where(F.col("_n") > hot).groupBy("node").agg(F.count("*").alias("_h"))
    spared = own_hot.join(classes.select("node", "spare"), "node").where("_h < spare").select("node")
    kept = many.where(F.col("_n") > hot).join(spared, "node", "left_anti")
    rows = saved(many.where(F.col("_n") <= hot).select("key", "node").union(kept.select("key", "node")))
    sets = rows.groupBy("key").agg(F.count("*").alias("_n"), *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"_x{k}") for k in range(2)])
    one = sets.groupBy("_n", "_x0", "_x1").agg(F.min("key").alias("key"), F.count("*").alias("alike"))
    return rows.join(one.where("_n > 1").select("key", "alike"), "key")


def plausible(pairs: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose sketches (node, size, bits) allow a link."""
    of = lambda c: sketches.select(F.col("node").alias(c), F.struct("size", "bits").alias(f"_{c}"))

    @F.pandas_udf("boolean")
    def allowed(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = np.zeros(len(a), bool)
        for k, (m, x, n, y) in enumerate(zip(a["size"], a["bits"], b["size"], b["bits"], strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            words = min(len(x), len(y))
            apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
            out[k] = bands.den * min(m, n) >= bands.num * max(m, n) and apart * (bands.den + bands.num) <= (bands.den - bands.num) * (m + n)
        return pd.Series(out)

    return pairs.join(of("a"), "a").join(of("b"), "b").where(allowed("_a", "_b")).select("a", "b")


def verified(pairs: DataFrame, ids: DataFrame, rows: DataFrame, n: int, bands: Bands) -> DataFrame:
    """The pairs (a, b) that are linked, of distinct pairs of classes.

    ids: (node, doc_id), a document of each class; rows: (doc_id, text).  The set of a is
    held while those of its partners pass; a class with very many partners is held by several tasks.
    """
    pairs = saved(pairs)
    big = F.broadcast(heavy(pairs.groupBy("a").agg(F.count("*").alias("n")), "a", pairs.count()))
    dealt = pairs.join(big, "a", "left").withColumn("piece", F.pmod(F.xxhash64("b"), F.coalesce("pieces", F.lit(1))).cast("int"))
    wanted = dealt.select("a", "piece", F.lit(0).alias("role"), F.col("a").alias("node")).distinct().union(dealt.select("a", "piece", F.lit(1).alias("role"), F.col("b").alias("node")))
    wanted = saved(wanted.join(ids, "node"))
    texts = rows.where(maybe_in(wanted.select("doc_id"))("doc_id"))
    members = wanted.hint("merge").join(texts, "doc_id").select("a", "piece", "role", "node", "text")

    def run(batches):
        at, held = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                out = []
                heads = zip(*(piece.column(c).to_pylist() for c in range(4)), strict=True)
                for (a, part, role, node), s in zip(heads, shingle_sets(piece.column(4), n), strict=True):
                    if (a, part) != at:
                        at, held = (a, part), None
                    if class_node(s) != node:  # an id may have other texts too
                        continue
                    if not role:
                        held = s
                    elif bands.linked(len(np.intersect1d(held, s, assume_unique=True)), len(held), len(s)):
                        out.append((a, node))
                yield pa.record_batch([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(members.repartition(parts, "a", "piece").sortWithinPartitions("a", "piece", "role").mapInArrow(tidy(run), "a long, b long").distinct())


def comparisons(shared: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """(key, x, y, z, node, label): units (key, x, y) of what is to be compared of the keys
    whose classes have several labels.

    A key of up to ``block`` classes is one unit.  Of a larger one, classes outside its most common
    label form blocks of their own and meet all blocks; the others meet only those.
    """
    named = saved(shared.select("key", "node").join(labels, "node"))
    sums = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
    sums = sums.agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    whole = F.col("n") <= block
    cut = lambda c: F.ceil(c / F.lit(block)).cast("int")
    sums = sums.select("key", F.when(~whole, F.col("top.label")).alias("top"), F.when(whole, 1).otherwise(cut(F.col("n") - F.col("top.n"))).alias("few"), F.when(whole, 0).otherwise(cut(F.col("top.n"))).alias("most"))
    rows = named.join(saved(sums), "key")
    rows = rows.withColumn("minor", ~F.col("label").eqNullSafe(F.col("top")))
    z = F.when(F.col("minor"), F.pmod(F.xxhash64("node"), "few")).otherwise(F.col("few") + F.pmod(F.xxhash64("node"), F.greatest("most", F.lit(1)))).cast("int")
    last = F.when(F.col("minor"), F.col("few") + F.col("most")).otherwise(F.col("few")) - 1
    rows = rows.withColumn("z", z).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("key", F.least("z", "other").alias("x"), F.greatest("z", "other").alias("y"), "z", "node", "label")


def close_pairs(units: DataFrame, now: DataFrame, most: int, bands: Bands) -> DataFrame:
    """(a, b, key, node): of each unit pairs (a, b) that the sketches in ``now`` (node, root, size, bits) allow to be linked and that its roots don't
    connect, at most ``most`` for a class and for two labels; and the classes (key, node) that have others behind.
    A task gives each pair once for about every million it finds."""

    def pieces(batches):
        """Whole units, as many as have ``PAIRS`` pairs together, or one."""
        rest = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            got = got if rest is None else pa.concat_tables([rest, got])
            key, x, y = (got.column(c).to_numpy() for c in range(3))
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            size = np.diff(np.append(starts, len(key)))[:-1]
            load, first = 0, 0
            for k, n in enumerate(size.tolist()):
                if load and load + n * n // 2 > PAIRS:
                    yield got.slice(starts[first], starts[k] - starts[first])
                    load, first = 0, k
                load += n * n // 2
            if load:
                yield got.slice(starts[first], starts[len(size)] - starts[first])
            rest = got.slice(starts[-1])
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches):
        held, size = [], 0
        for piece in pieces(batches):
            for got in _pairs(piece, most, bands):
                held.append(got)
                size += got.shape[1]
            if size > 1_000_000:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.join(now, "node").select("key", "x", "y", "z", "node", "label", "size", "root", "bits")
    return rows.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y", "node").mapInArrow(tidy(run), "a long, b long, key long, node long")


def _batch(held: list[np.ndarray]) -> pa.RecordBatch:
    x, y, behind = np.unique(np.concatenate(held, 1), axis=1)
    mask = lambda x, none: pa.array(x, pa.int64(), mask=none)
    return pa.record_batch([mask(x, behind != 0), mask(y, behind != 0), mask(x, behind == 0), mask(y, behind == 0)], names=["a", "b", "key", "node"])


def _sketches(column: pa.ChunkedArray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sketches, each folded to its number of words, and where each starts."""
    flat, at = text_buffer(column.cast(pa.large_binary()))
    flat, at = np.ascontiguousarray(flat).view(np.uint64), at // 8
    start = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), np.uint64)
    to = np.arange(len(out)) - np.repeat(start, words)
    for fold in range(int((np.diff(at) // words).max())):
        own = np.repeat(np.diff(at) > fold * words, words)
        out[own] ^= flat[(np.repeat(at[:-1] + fold * words, words) + to)[own]]
    return out, start


def _places(*columns: np.ndarray) -> np.ndarray:
    """Each row's place, from 0, among those that are equal in all columns but the last two, in the order of these."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns[:-2]])
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return out


def _pairs(rows: pa.Table, most: int, bands: Bands):
    """The pairs of whole units, rows of (key, x, y, z, node, label, size, root, bits): columns of (a, b, 0), and of
    (key, node, 1) for classes with more."""
    key, x, y, z, node, label, size, root = (rows.column(c).to_numpy() for c in range(8))
    unit = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))])
    across = x != y
    length = np.diff(text_buffer(rows.column(8).cast(pa.large_binary()))[1]) // 8
    words = np.minimum.reduceat(length, np.flatnonzero(np.diff(unit, prepend=-1)))[unit]
    bits, start = _sketches(rows.column(8), words)
    found = []
    for step in range(1, len(unit)):  # rows that lie ``step`` apart in one unit
        i = np.flatnonzero(unit[step:] == unit[:-step])
        if not len(i):
            break
        j = i + step
        ok = (root[i] != root[j]) & ~(across[i] & (z[i] == z[j])) & (bands.den * np.minimum(size[i], size[j]) >= bands.num * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        n = words[i]
        cell = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        apart = np.add.reduceat(np.bitwise_count(bits[np.repeat(start[i], n) + cell] ^ bits[np.repeat(start[j], n) + cell]).astype(np.int64), np.cumsum(n) - n)
        both = size[i] + size[j]
        spare = (bands.den - bands.num) * both - apart * (bands.den + bands.num)
        ok = spare >= 0
        if ok.any():
            found.append(np.stack([i[ok], j[ok], spare[ok] * 1000 // both[ok]]))
    if not found:
        return
    i, j, spare = np.concatenate(found, 1)
    a, b, far = np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), -spare
    own = _places(np.concatenate([i, j]), np.concatenate([far, far]), node[np.concatenate([j, i])])  # a row lies in one unit
    of_two = _places(unit[i], np.minimum(root[i], root[j]), np.maximum(root[i], root[j]), far, a ^ b)
    place = np.maximum(np.minimum(own[: len(i)], own[len(i) :]), of_two)
    now = place < most
    yield np.stack([a[now], b[now], np.zeros(int(now.sum()), np.int64)])
    behind = np.unique(np.concatenate([i[~now], j[~now]]))
    yield np.stack([key[behind], node[behind], np.ones(len(behind), np.int64)])


def partners(named: DataFrame, tested: DataFrame | None) -> DataFrame:
    """(a, b): for each class of (key, node, label, alike) the class under another label that it shares most keys with, of the outermost
    two labels of each key; not in ``tested`` (a, b)."""
    end = F.struct("label", "node")
    ends = named.groupBy("key").agg(F.min(end).alias("lo"), F.max(end).alias("hi")).where("lo.label <> hi.label")
    other = F.when(F.col("label") != F.col("lo.label"), F.col("lo.node")).otherwise(F.col("hi.node"))
    counted = named.join(ends, "key").groupBy("node", other.alias("other")).agg(F.sum("alike").alias("n"))
    counted = counted.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "node", "n")
    if tested is not None:
        counted = counted.join(tested, ["a", "b"], "left_anti")
    return counted.groupBy("node").agg(F.max(F.struct("n", "a", "b")).alias("m")).select("m.a", "m.b").distinct()


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the labels that ``links`` (a, b) connect made one."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    merged = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), "root")
    return saved(labels.join(merged, "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def linked_classes(rows: DataFrame, n: int, bands: Bands, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, text) rows: (doc_id, n_shingles, node, bits, spare) of each, and (node, rep, n_rows, component_id)
    of each class: its least id, its rows, and the least id of all linked classes."""
    known = saved(classes_of(rows, n, bands))
    mine = known.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node")
    classes = saved(mine.agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows"), F.min("n_shingles").alias("size"), F.min("bits").alias("bits"), F.min("spare").alias("spare")))
    ids, sketches = classes.select("node", F.col("rep").alias("doc_id")), classes.select("node", "size", "bits")

    shared = saved(shared_keys(class_keys(rows.where("doc_id IS NOT NULL").select("text"), n, bands), classes, hot))
    labels, tested = saved(shared.select("node", F.col("node").alias("label")).distinct()), None
    for _ in range(ROUNDS):  # each class with its likeliest partner
        pairs = saved(partners(saved(shared.join(labels, "node").select("key", "node", "label", "alike")), tested))
        found = verified(plausible(pairs, sketches, bands), ids, rows, n, bands)
        if found.isEmpty():
            break
        labels = relabelled(labels, found)
        tested = saved(pairs if tested is None else tested.union(pairs))
    units = saved(comparisons(shared, labels, block))
    most = 1
    while not units.isEmpty():
        found = saved(close_pairs(units, labels.select("node", F.col("label").alias("root")).join(sketches, "node"), most, bands))
        pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
        pairs = saved(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        labels = relabelled(labels, verified(pairs, ids, rows, n, bands))
        units = saved(units.join(found.where("key IS NOT NULL").select("key", "node").distinct(), ["key", "node"], "left_semi"))
        tested, most = pairs if tested is None else tested.union(pairs), 4 * most

    of = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = of.groupBy("label").agg(F.min("rep").alias("component_id"))
    return known, saved(of.join(least, "label").select("node", "rep", "n_rows", "component_id"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    known, classes = linked_classes(_rows(docs, id_col, text_col), n, Bands(num, den), hot, block)
    out = known.select("doc_id", "n_shingles", "node").join(classes.select("node", "component_id"), "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of linked rows: that with the least id.

    Rows without an id or without words all stay, and rows of one id with unlike texts are
    judged each for itself.  Of rows with equal id and equal set the least, by all columns' hash, stays.
    Only rows that have copies are shuffled.
    """
    bands = Bands(num, den)
    _, classes = linked_classes(_rows(docs, id_col, text_col), n, bands, hot, block)
    groups = classes.groupBy("component_id").agg(F.sum("n_rows").alias("_rows"), F.min(F.struct("rep", "node")).alias("_first"))
    groups = groups.where("_rows > 1").select("component_id", F.col("_first.node").alias("keeper"))
    touched = saved(classes.join(groups, "component_id").select("node", "component_id", F.col("node").eqNullSafe(F.col("keeper")).alias("stays")))

    used = set(docs.columns)
    node, stays, least, nth = (next(c for c in (f"_{name}{k}" for k in range(len(used) + 1)) if c not in used) for name in ("node", "stays", "least", "nth"))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                piece = batch.slice(k, 1000)
                nodes = [class_node(s) if len(s) else None for s in shingle_sets(piece.column(at), n)]
                yield pa.record_batch([*piece.columns, pa.array(nodes, pa.int64())], names=[*piece.schema.names, node])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(tidy(run), f"{schema}, `{node}` long")
    unsure = F.coalesce(maybe_in(touched.select("node"))(F.when(F.col(id_col).isNotNull(), F.col(node))), F.lit(False))
    known = touched.select(F.col("node").alias(node), F.col("component_id").alias(least), F.col("stays").alias(stays))
    judged = rows.where(unsure).join(known.hint("merge"), node, "left")
    judged = judged.where(F.col(stays).isNull() | (F.col(stays) & (F.col(id_col).cast("long") == F.col(least))))
    order = Window.partitionBy(node, least).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    once = judged.withColumn(nth, F.row_number().over(order)).where(F.col(stays).isNull() | (F.col(nth) == 1))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.where(~unsure).select(*names).union(once.select(*names))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, num=90, den=100)
