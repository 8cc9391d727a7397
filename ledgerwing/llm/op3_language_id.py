"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text becomes lower-case code points with every non-letter as a space; the windows
of 1 to 3 code points are hashed into ``BUCKETS`` buckets.  Training counts the
buckets by language; the log-probability matrix (languages x buckets, a size
that does not grow with the corpus) is broadcast, and a batch is scored by
gathering its windows' entries and summing them by document.

The fit reads at most about ``TRAIN_DOCS`` documents of each language (chosen by
a hash of the id); class shares come from all training rows.

Nulls: a null text, or one without a letter, gives ``und`` with score 0; a null
language is not learned from; a null id counts as the empty string in the
hold-out rule.  Empty texts are ``und``.  Ties go to the first language in
alphabetical order.  Repeated rows are all kept; an empty table, or one without
training rows, gives ``und`` with score 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear_of, doc_blocks, text_buffer, tidy

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
TRAIN_DOCS = 8_000
SMOOTHING = 0.1
SOFTEN = 40.0
_TABLE: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Lower-case letters of the basic plane; everything else a space."""
    if not _TABLE:
        table = np.full(0x10000, 32, np.uint32)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _TABLE.append(table)
    return _TABLE[0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of whole documents and their offsets."""
    raw = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    at = heads[offsets]
    if at[-1] != len(raw):  # not UTF-8: decode document by document
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) for a, b in zip(offsets, offsets[1:], strict=False)]
        raw, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    out = _fold()[np.minimum(raw, 0xFFFF)]
    for k in np.flatnonzero(raw > 0xFFFF):
        out[k] = raw[k] if chr(raw[k]).isalpha() else 32
    return out, at


def windows(points: np.ndarray, offsets: np.ndarray, order: int, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of the window at each code point; ``buckets`` where it would leave its document."""
    h = points * np.uint32(0x9E3779B1)
    for k in range(1, order):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
        h[:-k] += points[k:] * np.uint32(0xC2B2AE3D)
    h = ((h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F) >> np.uint32(9)).astype(np.int64) % buckets
    for k in range(1, order):
        last = offsets[1:] - k
        h[last[last >= offsets[:-1]]] = buckets
    return h


def held_out(id_col: str, mod: int, rest: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == rest


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_lang: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray] | None:
    """Languages in order and their log-probabilities: (languages, buckets + 2);
    the last two columns are 0 (for windows that don't count) and the log share."""
    train = train.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    shares = train.groupBy("lang").count().orderBy("lang").collect()
    if not shares:
        return None
    langs = [r["lang"] for r in shares]
    keep = F.create_map(*[F.lit(x) for r in shares for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    some = train.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < keep[F.col("lang")] * (1 << 20))

    def run(batches):
        total = np.zeros(len(langs) * (BUCKETS + 1))
        place = {lang: k for k, lang in enumerate(langs)}
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            codes = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for i, j in doc_blocks(offs):
                points, at = code_points(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                of = np.repeat(codes[i:j], np.diff(at)) * (BUCKETS + 1)
                for order in ORDERS:
                    total += np.bincount(windows(points, at, order) + of, minlength=len(total))
        table = total.reshape(len(langs), -1)[:, :BUCKETS]
        lang, bucket = np.nonzero(table)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[lang, bucket].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = some.select("lang", "text").mapInArrow(tidy(run), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    table[counts["lang"], counts["bucket"]] += counts["n"]
    share = np.array([r["count"] for r in shares], float)
    return langs, np.concatenate([np.log(table / table.sum(1, keepdims=True)), np.zeros((len(langs), 1)), np.log(share / share.sum())[:, None]], 1)


def score_block(points: np.ndarray, offsets: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods (documents x languages), counted windows, and whether a document has a letter."""
    n = len(offsets) - 1
    logs, used = np.zeros((n, len(matrix))), np.zeros(n)
    full = np.flatnonzero(np.diff(offsets))
    letter = np.zeros(n, bool)
    if len(full):
        starts = offsets[:-1][full]
        letter[full] = np.add.reduceat((points != 32).astype(np.int64), starts) > 0
        for order in ORDERS:
            h = windows(points, offsets, order)
            used[full] += np.add.reduceat((h < BUCKETS).astype(np.int64), starts)
            for k, row in enumerate(matrix):
                logs[full, k] += np.add.reduceat(row[h], starts)
    return logs + matrix[:, -1], used, letter


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score) for each row; score is the softened posterior.  A kept column named
    like one of these comes back as ``in_<name>``."""
    spark = docs.sparkSession
    langs, matrix = model or (["und"], np.zeros((1, BUCKETS + 2)))
    shared = spark.sparkContext.broadcast(matrix)
    cols = clear_of(docs.select(id_col, *[F.col(f"`{c}`") for c in keep]), "lang_pred", "score")
    cols = docs.select(*[F.col(f"`{old}`").alias(new) for old, new in zip((id_col, *keep), cols.columns, strict=True)], F.col(text_col).alias("_text"))

    def run(batches):
        matrix = shared.value
        for batch in batches:
            data, offs = text_buffer(batch.column(batch.num_columns - 1))
            pred, score = [], []
            for i, j in doc_blocks(offs):
                logs, used, letter = score_block(*code_points(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), matrix)
                best = logs.argmax(1)
                soft = np.exp((logs - logs.max(1, keepdims=True)) * np.minimum(1, SOFTEN / np.maximum(used, 1))[:, None])
                top = 1 / soft.sum(1)
                letter &= model is not None
                pred += [langs[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                score.append(np.where(letter, top, 0.0))
            yield pa.record_batch([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0))], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])
    return cols.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out("doc_id", 3, 1).alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=("held_out",))
