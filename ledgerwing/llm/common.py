"""What the corpus operators share: Arrow text buffers, word hashing, membership filters.

Text is handled as the raw UTF-8 buffer of an Arrow column.  A word is a maximal
run of bytes outside ``\\x20 \\x09-\\x0D``; those bytes never occur inside a
multi-byte character, so the byte view and the character view give the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS_REGEX = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 2 << 20


# --- Arrow text buffers ----------------------------------------------------

def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole documents with about ``limit`` bytes (one at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


# --- word hashes -----------------------------------------------------------

_MULT = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("p", _MULT), ("q", pow(_MULT, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _POW[key] = np.cumprod(steps, dtype=np.uint64)
    return _POW["p"], _POW["q"]


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a block, and each document's place among them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    edge = solid[1:-1]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(edge & (~solid[:-2] | cut[:-1]))
    ends = np.flatnonzero(edge & (~solid[2:] | cut[1:])) + 1
    p, q = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of whole documents, and the n + 1 offsets of the
    documents in that array.

    Memory stays near ``BLOCK_BYTES`` times 40: a longer document is hashed in
    parts that end at white space (a single longer word stays whole).
    """
    parts, counts = [], [np.zeros(1, np.int64)]
    for i, j in doc_blocks(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        block = data[lo:hi]
        if lower:
            block = LOWER[block]
        if hi - lo <= 2 * BLOCK_BYTES:
            h, at = _words_of(block, offsets[i : j + 1] - lo)
            parts.append(h)
            counts.append(np.diff(at))
            continue
        done = 0
        at = 0
        while at < len(block):
            end = min(at + BLOCK_BYTES, len(block))
            while end < len(block) and not _SPACE[block[end]]:
                step = np.flatnonzero(_SPACE[block[end : end + BLOCK_BYTES]])
                end = end + int(step[0]) if len(step) else min(end + BLOCK_BYTES, len(block))
            h, _ = _words_of(block[at:end], np.array([0, end - at]))
            parts.append(h)
            done += len(h)
            at = end
        counts.append(np.array([done]))
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return hashes, np.cumsum(np.concatenate(counts))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one document, in order; with fewer words
    the whole sequence is one shingle; no words, no shingles."""
    k = len(words)
    if k == 0:
        return words
    size = min(n, k)
    out = np.full(k - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[i : k - size + 1 + i]
        out ^= out >> np.uint64(29)
    return mix(out)


# --- memory of workers -----------------------------------------------------

def tidy(run):
    """A partition function that hands what it freed back to the system at its end, so that waiting workers stay small."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


# --- names ------------------------------------------------------------------

def clear_of(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with a column that has one of ``names``, which an operator gives, renamed to ``in_<name>``."""
    for name in names:
        other = f"in_{name}"
        while name in docs.columns and other in docs.columns:
            other = f"in_{other}"
        docs = docs.withColumnRenamed(name, other)
    return docs


# --- bounded membership filters ---------------------------------------------

#: Bits of a filter: 16 for each id, within these bounds (the larger is 32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def maybe_in(ids: DataFrame):
    """A condition on an id column that holds for all of ``ids`` (one long column)
    and for few others: a Bloom filter, built by a grouped bit-wise OR.

    It only spares a shuffle the rows that can't match; an exact join follows, so with
    more ids than the largest filter serves, more rows take part in that join.
    """
    spark = ids.sparkSession
    name = ids.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, ids.count()) - 1).bit_length()))
    places = F.array(*[F.pmod(F.xxhash64(F.col(name).cast("long"), F.lit(k)), F.lit(bits)) for k in (1, 2)])
    words = ids.where(F.col(name).isNotNull()).select(F.explode(places).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("v"))
    table = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    table[got.column("w").to_numpy()] = got.column("v").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def held(a: pd.Series, b: pd.Series) -> pd.Series:
        out = a.notna().to_numpy()
        for p in (a, b):
            at = p.fillna(0).to_numpy(np.int64)
            out = out & ((shared.value[at >> 6] >> (at & 63)) & 1).astype(bool)
        return pd.Series(out)

    def condition(col) -> Column:
        col = F.col(col) if isinstance(col, str) else col
        return held(*[F.when(col.isNotNull(), F.pmod(F.xxhash64(col.cast("long"), F.lit(k)), F.lit(bits))) for k in (1, 2)])

    return condition
