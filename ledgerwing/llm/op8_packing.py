"""Cost-balanced packing of documents into token sequences.

A document's ids (with an end id) are cut into pieces of at most ``length``;
full pieces are sequences of their own.  The rest of each document is packed in
groups of up to ``GROUP_DOCS`` consecutive documents of a partition: a piece of
n ids costs ``n + n * n / length`` (linear work plus attention within the
piece), and pieces in descending size each go to the lowest-cost sequence
with room.  A group opens just as many sequences as its tokens fill; what is
left over fills sequences of powers of two, which need no padding.  A piece that
no sequence has room for is cut at the sequence with the most room.

Groups are formed and packed where the documents are read, so no ids are
shuffled; the partition's number is the high part of ``sequence_id``.

Nulls: a null text is an empty document (the end id alone); a null doc_id stays
null.  Ties in size keep the order of reading.  Repeated rows are packed each for itself; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_blocks, text_buffer, tidy
from .tokens import ENCODE_BYTES, encoder

LENGTH = 2048
GROUP_DOCS = 4096
CACHE_PIECES = 200_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(sizes: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with ``sizes`` ids."""
    out, made = [], 0
    rest = []
    for d, n in enumerate(sizes.tolist()):
        for start in range(0, n - length + 1, length):
            out.append((d, start, length, made, 0))
            made += 1
        if n % length:
            rest.append((n % length, d, n - n % length))
    total = sum(r for r, _, _ in rest)
    room = [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if total % length >> b & 1]
    if not room:
        return out
    room = np.array(room)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    rest.sort(key=lambda x: -x[0])
    for n, d, start in rest:
        while n:
            fits = room - used >= n
            if fits.any():
                s, k = int(np.where(fits, cost, np.inf).argmin()), n
            else:
                s = int((room - used).argmax())
                k = int(room[s] - used[s])
            out.append((d, start, k, made + s, int(used[s])))
            used[s] += k
            cost[s] += k + k * k / length
            start, n = start + k, n - k
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, fold: bool = False, length: int = LENGTH, group_docs: int = GROUP_DOCS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece (``SCHEMA``); ``with_ids`` adds its ids, little-endian u32."""

    def run(batches):
        enc, base, made = encoder(tokenizer_path, fold, CACHE_PIECES), TaskContext.get().partitionId() << 40, 0
        held: list[tuple[int | None, np.ndarray]] = []

        def flush():
            nonlocal made
            got = assign(np.array([len(x) for _, x in held], np.int64), length)
            cols = [[], [], [], [], [], [], []]
            raw = []
            for d, start, n, seq, offset in got:
                doc, ids = held[d]
                part = ids[start : start + n].astype("<u4").tobytes()
                for c, v in zip(cols, (doc, start, n, zlib.crc32(part), len(ids), base + made + seq, offset), strict=True):
                    c.append(v)
                if with_ids:
                    raw.append(part)
            made += 1 + max((x[3] for x in got), default=-1)
            held.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols] + ([pa.array(raw, pa.binary())] if with_ids else [])
            return pa.record_batch(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

        end, size = np.array([end_id], np.uint32), 0
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            names = batch.column(0).to_pylist()
            for i, j in doc_blocks(offs, ENCODE_BYTES):
                flat, at = enc.block(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for k in range(j - i):
                    held.append((names[i + k], np.concatenate([flat[at[k] : at[k + 1]], end])))
                    size += len(held[-1][1])
                    if len(held) >= group_docs or size >= group_docs * length:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), SCHEMA + ", ids binary" * with_ids)


def pack_words(docs: DataFrame) -> DataFrame:
    """``docs`` packed with the lower-case word tokenizer and end id 1."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, fold=True)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
