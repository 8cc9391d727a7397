"""Quality classifier: regularised quadratic discriminant on document statistics.

Each whole text becomes ``len(FEATURES)`` transformed statistics, computed with numpy on
the Arrow buffer.  Training gathers count, sum and outer product by class (as
summed rows, so their number depends on the statistics alone), and shrinks each class
covariance towards the pooled one and towards its diagonal.  The score is the
logistic of the difference of the class log-densities, each from the
Mahalanobis distance under a Cholesky factor that is inverted once and
broadcast.

The fit reads at most about ``TRAIN_DOCS`` labelled rows of each class (chosen by a
hash of the id; the labels' ids are broadcast, which this bounds).

Nulls: a null text is scored as an empty one; null or other labels are not
learned from; a null id counts as the empty string in the hold-out rule. Two labels of one
document count as the lower.  Repeated rows are all kept.  Without training rows
every score is 0.5, with one class only that class's; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, clear_of, doc_blocks, text_buffer, tidy, word_hashes
from .op3_language_id import held_out

FEATURES = ("log_words", "log_word_bytes", "symbols", "upper", "exclaim", "digits", "distinct_words", "same_as_before", "distinct_pairs", "bare_symbols", "stops")
TRAIN_DOCS = 12_000
THRESHOLD = 0.3
SHRINK_POOLED, SHRINK_DIAGONAL, FLOOR = 0.05, 0.05, 1e-3


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*chars.encode()]] = True
    return out


_SYMBOL, _BANG, _DIGIT = _table("#*$%&|<>=+~^_{}[]\\/@"), _table("!?"), _table("0123456789")
_UPPER, _LOWER, _STOP = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table(".,;:")


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _distinct(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct values of each document."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, of))
    v, o = values[order], of[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(offsets) - 1).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The transformed statistics of whole documents: (documents, features)."""
    words, at = word_hashes(data, offsets)
    n = np.diff(at).astype(float)
    one = np.maximum(n, 1)
    prev = np.zeros(len(data), np.uint8)
    prev[1:] = data[:-1]
    wide = prev == 0xC3
    solid = ~_SPACE[data]
    size = np.maximum(_sums(solid, offsets), 1)
    upper = _sums(_UPPER[data] | (wide & (data >= 0x80) & (data <= 0x9E)), offsets)
    lower = _sums(_LOWER[data] | (wide & (data >= 0x9F)), offsets)
    symbol = _SYMBOL[data]
    nxt = np.full(len(data), 32, np.uint8)
    nxt[:-1] = data[1:]
    bare = symbol & _SPACE[nxt] & (_SPACE[prev] | (np.arange(len(data)) == 0))
    pairs = words.copy()
    pairs[1:] ^= words[:-1] * np.uint64(0x9E3779B97F4A7C15)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    first = at[:-1][np.diff(at) > 0]
    same[first] = False
    pairs[first] = 0
    share = lambda x: np.sqrt(x / size)
    return np.stack([
        np.log1p(n), np.log(size / one), share(_sums(symbol, offsets)), np.sqrt(upper / np.maximum(upper + lower, 1)), share(_sums(_BANG[data], offsets)),
        share(_sums(_DIGIT[data], offsets)), np.log1p(_distinct(words, at)) / np.log1p(one), np.sqrt(_sums(same, at) / one), np.sqrt(_distinct(pairs, at) / one),
        np.sqrt(_sums(bare, offsets) / one), np.sqrt(_sums(_STOP[data] & _SPACE[nxt], offsets) / one),
    ], 1)


def _rows(batches, text_at: int):
    """Each batch with the statistics of its texts."""
    for batch in batches:
        data, offs = text_buffer(batch.column(text_at))
        parts = [statistics(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in doc_blocks(offs)]
        yield batch, np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


class Discriminant:
    """Two Gaussians with shrunken covariances and their cached Cholesky inverses."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.only = None if len(moments) == 2 else next(iter(moments), None)
        if len(moments) < 2:
            return
        covs = {k: o / n - np.outer(s / n, s / n) for k, (n, s, o) in moments.items()}
        total = sum(n for n, _, _ in moments.values())
        pooled = sum(moments[k][0] / total * c for k, c in covs.items())
        self.means, self.inverses, self.offset = {}, {}, {}
        for k, (n, s, _) in moments.items():
            cov = (1 - SHRINK_POOLED - SHRINK_DIAGONAL) * covs[k] + SHRINK_POOLED * pooled
            cov = cov + SHRINK_DIAGONAL * np.diag(np.diag(covs[k])) + FLOOR * np.eye(len(s))
            factor = np.linalg.cholesky(cov)
            self.means[k], self.inverses[k] = s / n, np.linalg.inv(factor)
            self.offset[k] = np.log(n / total) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not hasattr(self, "means"):
            return np.full(len(x), 0.5 if self.only is None else float(self.only))
        log = {k: self.offset[k] - 0.5 * (((x - self.means[k]) @ self.inverses[k].T) ** 2).sum(1) for k in (0, 1)}
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = TRAIN_DOCS) -> Discriminant:
    """Fit on the documents that ``labels`` (id, label 0 or 1) covers."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not sizes:
        return Discriminant({})
    keep = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_class / n))])
    some = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < keep[F.col("label")] * (1 << 20))
    d = len(FEATURES) + 1

    def run(batches):
        total = np.zeros((2, d, d))
        for batch, x in _rows(batches, 1):
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            label = batch.column(0).to_numpy()
            for k in (0, 1):
                total[k] += x[label == k].T @ x[label == k]
        k, i, j = np.nonzero(total)
        yield pa.record_batch([pa.array(a.astype(np.int32)) for a in (k, i, j)] + [pa.array(total[k, i, j])], names=["k", "i", "j", "v"])

    rows = docs.select(id_col, text_col).join(F.broadcast(some), id_col).select("label", text_col)
    sums = rows.mapInArrow(tidy(run), "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, d, d))
    for r in sums:
        total[r["k"], r["i"], r["j"]] = r["v"]
    return Discriminant({k: (total[k, 0, 0], total[k, 0, 1:], total[k, 1:, 1:]) for k in (0, 1) if total[k, 0, 0] > 0})


def score(docs: DataFrame, model: Discriminant, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in the last column ``name`` (an input column of that name
    comes back as ``in_<name>``)."""
    docs = clear_of(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch, x in _rows(batches, at):
            yield pa.record_batch([*batch.columns, pa.array(shared.value.score(x))], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{schema}, `{name}` double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0)).select("doc_id", "quality")
    out = score(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), fit(docs, labels))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
