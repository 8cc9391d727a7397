"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

File layout (little endian)::

    b"FRVB" u32 version=1  u64 n_docs  u64 n_tokens  u64 n_data_bytes
    n_docs x i64 doc_id    n_docs x u8 doc_id is null    n_docs x u64 tokens of the document
    ceil(n_tokens / 4) control bytes: four 2-bit byte lengths (less 1), first id lowest
    n_data_bytes data bytes: the ranks, each in 1 to 4 bytes

Rank 0 is the most frequent id of the whole corpus (ties: the smaller id), so
nearly all ids take one byte.  ``ranks.bin`` (u32 ids by rank) lies beside the
files.  Files hold documents in ascending doc_id (null first; equal ids in order
of their content) and never more than ``file_tokens`` ids unless one document does.

Nulls: a null text is an empty document (the end id alone); a null doc_id is
kept and reads back as null.  Repeated rows are all kept.  An empty table gives
no file.  Other columns are not read.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stores import saved as staged
from ..stores import shared_dir
from .common import doc_blocks, text_buffer, tidy
from .tokens import ENCODE_BYTES, encoder

MAGIC = b"FRVB"
FILE_TOKENS = 4_000_000

#: By control byte: where each of its four values starts, their masks, and the bytes of all four.
_LEN = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
_START = np.concatenate([np.zeros((256, 1), np.int64), np.cumsum(_LEN, 1)[:, :3]], 1)
_KEEP = ((np.uint64(1) << (8 * _LEN).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
_TOTAL = _LEN.sum(1)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 ranks."""
    n = len(ranks)
    length = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = length - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = np.ascontiguousarray(ranks, "<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4) < length[:, None]].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks, by table lookup on control bytes; a bounded number at a time."""
    out = np.empty(n, np.uint32)
    at = 0
    for g in range(0, len(control), 1 << 18):
        c = control[g : g + (1 << 18)]
        ends = np.cumsum(_TOTAL[c])
        used = int(ends[-1])
        raw = np.zeros(used + 4, np.uint8)
        part = data[at : at + used]
        raw[: len(part)] = part
        pos = (ends - _TOTAL[c])[:, None] + _START[c]
        value = raw[pos].astype(np.uint32)
        for k in (1, 2, 3):
            value |= raw[np.minimum(pos + k, used + 3)].astype(np.uint32) << np.uint32(8 * k)
        value &= _KEEP[c]
        k = min(4 * len(c), n - 4 * g)
        out[4 * g : 4 * g + k] = value.ravel()[:k]
        # the unused slots of the last control byte are coded as one byte that isn't there
        at += used
    return out


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian u16 where they fit the
    vocabulary, else u32; read at ``width`` bytes."""

    def run(batches):
        enc = encoder(tokenizer_path)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            for i, j in doc_blocks(offs, ENCODE_BYTES):
                flat, at = enc.block(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                docs_ids = [np.concatenate([flat[at[k] : at[k + 1]], end]) for k in range(j - i)]
                yield pa.record_batch([
                    batch.column(0).slice(i, j - i).cast(pa.int64()),
                    pa.array([len(x) for x in docs_ids], pa.int64()),
                    pa.array([int(x.max(initial=0)) > 0xFFFF for x in docs_ids], pa.bool_()),
                    pa.array([x.astype("<u4" if x.max(initial=0) > 0xFFFF else "<u2").tobytes() for x in docs_ids], pa.binary()),
                ], names=["doc_id", "n_tokens", "wide", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, wide boolean, ids binary")


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.uint32)


def token_counts(encoded: DataFrame) -> DataFrame:
    """(token, n) over all documents; at most a row per id from each task."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw, wide in zip(batch.column(0), batch.column(1), strict=True):
                got = np.bincount(_ids(raw.as_py(), wide.as_py()))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], names=["token", "n"])

    return encoded.select("ids", "wide").mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_files(encoded: DataFrame, target: str, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the ids of ``encoded`` (a staged table) below ``target`` in ascending
    doc_id; the manifest: (file, n_docs, n_tokens, base), base being all ids before.

    The ranking is collected: its size is the vocabulary's, never the corpus's.
    A file appears under its name only when whole, so a task may run twice.
    """
    from pyarrow import fs as pafs

    spark = encoded.sparkSession
    rows = token_counts(encoded).orderBy(F.desc("n"), "token").toPandas()
    by_rank = rows["token"].to_numpy(np.uint32) if len(rows) else np.zeros(0, np.uint32)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    fs, root = pafs.FileSystem.from_uri(target)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(by_rank.astype("<u4").tobytes())
    ranks = spark.sparkContext.broadcast(rank_of)
    total = int(rows["n"].sum()) if len(rows) else 0

    def run(batches):
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(target)
        part, made = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal held, size, made
            name = f"part-{part:06d}-{made:05d}.frvb"
            ids = np.concatenate([x for _, x in held])
            control, data = pack_ranks(ranks.value[ids])
            temp = f"{root}/_{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as out:
                out.write(MAGIC + np.array([1], "<u4").tobytes() + np.array([len(held), len(ids), len(data)], "<u8").tobytes())
                out.write(np.array([d or 0 for d, _ in held], "<i8").tobytes())
                out.write(np.array([d is None for d, _ in held], np.uint8).tobytes())
                out.write(np.array([len(x) for _, x in held], "<u8").tobytes())
                out.write(control)
                out.write(data)
            fs.move(temp, f"{root}/{name}")
            row = pa.record_batch([pa.array([x]) for x in (name, len(held), len(ids), part, made)], names=["file", "n_docs", "n_tokens", "part", "nth"])
            held, size, made = [], 0, made + 1
            return row

        for batch in batches:
            for doc, wide, raw in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ids = _ids(raw.as_py(), wide.as_py())
                if held and size + len(ids) > file_tokens:
                    yield flush()
                held.append((doc.as_py(), ids))
                size += len(ids)
        if held:
            yield flush()

    parts = max(1, -(-total // file_tokens))
    ordered = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", F.xxhash64("ids")).select("doc_id", "wide", "ids")
    manifest = staged(ordered.mapInArrow(tidy(run), "file string, n_docs long, n_tokens long, part long, nth long"))
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # one row a file


def read_files(spark: SparkSession, target: str) -> DataFrame:
    """(file, doc_id, local_start, n_tokens, ids u32 little endian) of every file below ``target``."""
    from pyarrow import fs as pafs

    fs, root = pafs.FileSystem.from_uri(target)
    with fs.open_input_stream(f"{root}/ranks.bin") as f:
        by_rank = spark.sparkContext.broadcast(np.frombuffer(f.read(), "<u4"))

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                docs, n_ids, lens, ids = decode_file(raw, by_rank.value)
                ends = np.cumsum(lens)
                name = os.path.basename(path.as_py())
                for k in range(0, len(docs), 2000):
                    s = slice(k, k + 2000)
                    yield pa.record_batch([
                        pa.array([name] * len(docs[s])),
                        pa.array(docs[s], pa.int64(), mask=n_ids[s].astype(bool)),
                        pa.array((ends - lens)[s], pa.int64()),
                        pa.array(lens[s], pa.int64()),
                        pa.array([ids[e - n : e].tobytes() for e, n in zip(ends[s], lens[s], strict=True)], pa.binary()),
                    ], names=["file", "doc_id", "local_start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.frvb").load(target)
    return files.select("path", "content").mapInArrow(tidy(run), "file string, doc_id long, local_start long, n_tokens long, ids binary")


def decode_file(raw: np.ndarray, by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their null flags, token counts and all ids of one file."""
    if raw[:4].tobytes() != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_tokens, n_data = (int(x) for x in raw[8:32].view("<u8"))
    at = 32
    docs = raw[at : at + 8 * n_docs].view("<i8")
    at += 8 * n_docs
    null = raw[at : at + n_docs]
    at += n_docs
    lens = raw[at : at + 8 * n_docs].copy().view("<u8").astype(np.int64)
    at += 8 * n_docs
    n_control = -(-n_tokens // 4)
    ids = by_rank[unpack_ranks(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data], n_tokens)].astype("<u4")
    return docs, null, lens, ids


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None, target: str | None = None) -> tuple[str, DataFrame]:
    """Encode, write and index ``docs``; the folder and its manifest."""
    target = target or shared_dir(docs.sparkSession)
    encoded = staged(encode_documents(docs, tokenizer_path, end_id))
    return target, write_files(encoded, target)


def digest(read: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents read from files."""

    rows = read.withColumn("ids_crc32", F.crc32("ids"))
    return rows.join(manifest.select("file", "base"), "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target, manifest = token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return digest(read_files(spark, target), manifest)
