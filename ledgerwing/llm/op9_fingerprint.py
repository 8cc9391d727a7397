"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint holds the ``K`` least distinct 64-bit hashes of a text's 5-word
shingles.  Two merge by taking the least ``K`` of their union, which is the
fingerprint of the parts' shingles together; two together estimate resemblance
and containment, one alone the number of distinct shingles (exact below ``K``).
Written as base64 of the little-endian hashes; no shingles give the empty string.

``with_next`` brings each document together with its successor by ascending id
without a global sort in one task: documents are dealt to ranges of ids, each
range is sorted, and the first document of a range is also sent to the range before it
(the first of all to the last).

A long text is fingerprinted in parts of ``PART_WORDS`` words, which are merged.  ``edited_contains`` estimates the share of a text's
shingles that its edited text has, ``n_shingles_est`` their number.

Nulls: a null text is an empty one.  Texts without words have likeness 1 to each
other and 0 to others.  A null id sorts first; rows with equal ids are ordered
by text, and all are kept (if their range starts with them, each of that id
is sent on, and the first is used).  An empty table gives an empty result; a
single document is its own successor.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shingles, tidy, word_hashes

K = 128
SHINGLE = 5
PART_WORDS = 4096
RANGE_BYTES = 4 << 20
MIN_RANGES = 16


def sketch(text: bytes, k: int = K, n: int = SHINGLE) -> np.ndarray:
    """The fingerprint of a text: of a long one the merged fingerprints of its parts, which share n - 1 words."""
    words, _ = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    out = bottom(shingles(words[: PART_WORDS + n - 1], n), k)
    for at in range(PART_WORDS, len(words) - n + 1, PART_WORDS):
        out = merge(out, bottom(shingles(words[at : at + PART_WORDS + n - 1], n), k), k)
    return out


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct hashes, ascending."""
    if len(hashes) > 8 * k:  # most texts repeat few shingles: look at the least 2k first
        low = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard index: the shared part of the union's least k."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return float(min(1.0, both / distinct_count(a, k)))


def pack(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, n: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, n_shingles_est) of each whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = [sketch((x.as_py() or "").encode(), k, n) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(map(pack, got), pa.string()), pa.array([distinct_count(x, k) for x in got], pa.float64())], names=["id", "fingerprint", "n_shingles_est"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(tidy(run), f"id {kind}, fingerprint string, n_shingles_est double").withColumnRenamed("id", id_col)


def ranges(docs: DataFrame, id_col: str, text_col: str, target: int = RANGE_BYTES, least: int = MIN_RANGES, most: int = 1 << 16) -> list[int]:
    """Bounds that cut the ids into ranges of about ``target`` bytes of text, larger ones
    where that would make more than ``most``."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(least, min(most, size // target))
    cuts = docs.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)], max(10_000, 4 * n))).first()[0] or []
    return sorted(set(cuts))


def in_range(col: Column, bounds: list[int]) -> Column:
    """The number of bounds that are at most the id (0 for null), as a long."""
    edges = np.array(bounds, np.int64)
    places = F.pandas_udf(lambda s: pd.Series(np.where(s.isna(), 0, np.searchsorted(edges, s.fillna(0).astype("int64"), "right"))), "long")
    return places(col.cast("long"))


def with_next(docs: DataFrame, use, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that ``use(doc_id, text, next_text)`` gives for every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = ranges(rows, "id", "text")
    spark = docs.sparkSession
    rows = rows.withColumn("range", in_range(F.col("id"), bounds))
    # one row for each range that has documents; its number is bounded by the bounds'
    heads = {r["range"]: r["head"] for r in rows.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("there"), "id")).alias("head")).collect()}
    order = sorted(heads)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    head_list = [(b, before[b], heads[b]["id"]) for b in order]
    firsts = spark.createDataFrame(head_list or [(0, 0, None)], "range long, to long, first long")
    own = rows.select("range", F.lit(0).alias("extra"), "id", "text")
    sent = rows.join(F.broadcast(firsts), (rows["range"] == firsts["range"]) & rows["id"].eqNullSafe(firsts["first"])).select(F.col("to").alias("range"), F.lit(1).alias("extra"), "id", "text")

    def run(batches):
        held, at, out = None, None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                for rng, extra, doc, text in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True):
                    if rng != at:
                        at, held = rng, None
                    if held is not None:
                        out.append(use(*held, text))
                    held = None if extra else (doc, text)  # the first row sent here ends the range
                if out:
                    yield as_batch(out)
                    out = []

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def as_batch(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    both = own.union(sent).repartitionById(len(bounds) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "extra", F.asc_nulls_first("id"), "text")
    return both.mapInArrow(tidy(run), schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


class _Compare:
    """Fingerprints of successive documents; each text's is made once as the walk goes on."""

    def __init__(self):
        self.text, self.sketch = None, None

    def __call__(self, doc_id, text: str, following: str):
        own = self.sketch if self.text == text and self.sketch is not None else sketch(text.encode())
        after = sketch(following.encode())
        self.text, self.sketch = following, after
        changed = edited(text, following)
        other = sketch(changed.encode())
        return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), pack(own), pack(other), resemblance(own, other), resemblance(own, after), containment(own, other), distinct_count(own)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_contains double, n_shingles_est double"
    return with_next(docs, _Compare(), schema)
