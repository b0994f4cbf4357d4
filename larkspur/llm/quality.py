"""Quality classifier: regularised quadratic discriminant analysis.

A document becomes a vector of transformed statistics of its whole text. Class
means and covariances come from sums over all labelled training rows, which
Spark adds up; the covariances shrink towards their pooled diagonal. Scores are
the logistic of the Mahalanobis log-density difference, with the Cholesky
factor of each class made once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE, lean, mix, staged, text_chunks, without_rows, word_hashes, words_of

SHRINKAGE = 0.1
FLOOR = 1e-3  # added to each variance of the standardised features
FEATURES = (
    "log_words", "log_bytes", "word_length", "upper", "digits", "symbols", "bangs", "bars", "punctuation", "spaces",
    "lines", "distinct", "adjacent_repeats", "odd_word_ends", "shouted_words", "long_words", "short_words", "wide_bytes",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _BANG, _BAR, _MARK = _table("0123456789"), _table("!?"), _table("|"), _table(".,;:'\"()-")
_SYMBOL = _table("#$%&*+/<=>@[\\]^_`{}~")
_WIDE = (np.arange(256) >= 0x80).astype(np.int64)
_NEWLINE = _table("\n")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document; an empty text gives the values of no words."""
    n = np.diff(offsets).astype(float)
    count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets]).astype(float)
    start, end, bounds = words_of(data, offsets)
    words = np.diff(bounds).astype(float)
    w, b = np.maximum(words, 1), np.maximum(n, 1)
    doc = np.repeat(np.arange(len(n)), np.diff(bounds))
    each = lambda values: np.bincount(doc, weights=values, minlength=len(n))
    size = (end - start).astype(float)
    hashes = word_hashes(data, start, end)
    keyed = mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keyed, return_index=True)
    fresh = np.zeros(len(doc))
    fresh[first] = 1
    again = np.zeros(len(doc))
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    own = letters[end] - letters[start]
    shout = (own >= 2) & (caps[end] - caps[start] == own)
    last = data[end - 1] if len(end) else data[:0]
    odd = (_SYMBOL[last] + _BANG[last] + _BAR[last]).astype(float)
    upper, letter = count(_UPPER), np.maximum(count(_LETTER), 1)
    root = lambda x: np.sqrt(np.maximum(x, 0))
    columns = [
        np.log1p(words), np.log1p(n), np.log1p(each(size) / w), root(upper / letter), root(count(_DIGIT) / b), root(count(_SYMBOL) / b),
        root(count(_BANG) / b), root(count(_BAR) / b), root(count(_MARK) / b), root(count(SPACE.astype(np.int64)) / b), root(count(_NEWLINE) / w),
        each(fresh) / np.sqrt(w) / np.log1p(w), root(each(again) / w), root(each(odd) / w), root(each(shout) / w), root(each(size > 12) / w), root(each(size <= 2) / w), root(count(_WIDE) / b),
    ]
    return np.stack(columns, axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch, "text"):
            x = statistics(data, offsets)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), flat], names=["doc_id", "copy", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy, x array<double>), one row for each row of docs; copy is a hash of the text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text")).mapInArrow(_features, "doc_id long, copy long, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log densities at the mean, of classes 0 and 1."""

    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        logs = [self.constant[k] - 0.5 * (((x / self.scale - self.means[k]) @ self.inverse[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _sums(centre: np.ndarray, products: bool):
    """Of each class: rows, and sums of x - centre and, with products, of its products, of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(FEATURES)
        total = np.zeros((2, 1 + d + d * d * products))
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d) - centre
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                part = x[y == k]
                total[k] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel() if products else []])
        k = np.repeat([0, 1], total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(np.tile(np.arange(total.shape[1], dtype=np.int32), 2)), pa.array(total.ravel())], names=["label", "at", "value"])

    return run


def _total(labelled: DataFrame, centre: np.ndarray, products: bool) -> np.ndarray:
    d = len(FEATURES)
    rows = labelled.select(F.col("label").cast("int"), "x").mapInArrow(_sums(centre, products), "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, 1 + d + d * d * products))
    for r in rows:
        sums[r["label"], r["at"]] = r["value"]
    return sums


def train(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """labelled(label 0 or 1, x): all rows count, only their sums reach the driver. A class without rows gets the pooled values.

    Products are summed about the mean of all rows, in a second pass, so that
    features that hardly vary lose no precision; a constant one has scale 1.
    """
    d = len(FEATURES)
    plain = _total(labelled, np.zeros(d), False)
    centre = plain[:, 1:].sum(0) / max(1, plain[:, 0].sum())
    sums = _total(labelled, centre, True)
    n = sums[:, 0]
    safe = np.maximum(n, 1)
    whole = sums.sum(0) / max(1, n.sum())
    second_all = whole[1 + d :].reshape(d, d)
    variance = np.diag(second_all) - whole[1 : 1 + d] ** 2
    scale = np.sqrt(np.where(variance > 1e-12 * (1 + centre**2), variance, 1))
    offsets = np.where(n[:, None] > 0, sums[:, 1 : 1 + d] / safe[:, None], 0) / scale
    covariances = []
    for k in (0, 1):
        second = (sums[k, 1 + d :].reshape(d, d) / safe[k] if n[k] else second_all) / np.outer(scale, scale)
        covariances.append(second - np.outer(offsets[k], offsets[k]))
    pooled = np.diag(np.maximum(np.diag((n[0] * covariances[0] + n[1] * covariances[1]) / max(1, n.sum())), 0))
    inverse, constant = [], []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * covariances[k] + shrinkage * pooled + FLOOR * np.eye(d))
        inverse.append(np.linalg.inv(factor))
        constant.append(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(scale, offsets + centre / scale, np.array(inverse), np.array(constant))


def _score(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], names=["doc_id", "copy", "score"])

    return run


def in_training(id_col) -> F.Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    lean(docs.sparkSession)
    x = staged(features(docs, id_col, text_col), "features")
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where("label in (0, 1)").where(in_training(F.col("doc_id")))
    model = train(staged(own.join(x.select("doc_id", "x"), "doc_id").select("label", "x"), "labelled"))
    return x.mapInArrow(_score(model), "doc_id long, copy long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score), one row for each row of docs.

    The model learns from labels (doc_id, quality) whose crc32(doc_id) mod 5 is
    not 0. Null and empty texts have the statistics of no words and a score.
    Labels that are null or neither 0 nor 1, or of unknown documents, do not
    count; repeated ones count each time, and one of rows that share an id
    counts for each of them. A null doc_id is not held out. Other columns are
    ignored. Without labels every score is 0.5; labels of one class only, or of
    one same text, still give a score.
    """
    scored = _scored(docs, labels, id_col, text_col, label_col)
    return scored.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score")


CUT = 0.3


def of_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs with a score of `cut` or more, with all columns; each row is judged by its own text, with an id or without."""
    return without_rows(docs, _scored(docs, labels, "doc_id", "text", "quality").where(F.col("score") < cut))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all of documents; 1 is predicted from 0.3 on."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out = quality_scores(read("documents"), read("labels"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
