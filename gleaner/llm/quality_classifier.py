"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over the statistics. Its covariance is drawn towards the pooled one and towards a multiple of
the identity, so that it can be inverted on few rows; its Cholesky factor is computed once and shipped with the model.
A score is the logistic of the difference of the classes' log densities, that is of two squared Mahalanobis lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import cut

#: Share of the pooled covariance, share of the identity, and the score from which a document is predicted good.
POOLED, IDENTITY, THRESHOLD = 0.1, 0.02, 0.3
#: Labelled rows that good_documents() fits its model on, about and at most; their ids are broadcast.
TRAINING = 200_000
STATISTICS = ["words", "word_length", "symbols", "upper", "digits", "punctuation", "non_ascii", "exclaims", "distinct", "stutters", "repeats", "repeated_lines", "entropy", "lines"]

CLASSES = np.full(256, 5, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\t\n\v\f\r ", b".,;:!?'\"()-")):
    CLASSES[list(_chars)] = _k
CLASSES[128:] = 6


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text; null is empty. Shares are logarithms, smoothed so that short texts lie near the middle."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    kinds = np.bincount(CLASSES, weights=counts, minlength=7)
    solid, total = kinds.sum() - kinds[3], max(1, counts.sum())
    words = text.split()
    n = len(words)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    runs = hashes[:-3] * np.uint64(3) + hashes[1:-2] * np.uint64(5) + hashes[2:-1] * np.uint64(7) + hashes[3:] * np.uint64(11) if n > 3 else hashes[:0]
    lines = [x for x in text.split("\n") if x.strip()]
    shares = counts[counts > 0] / total
    part = lambda a, b: float(np.log((a + 2.0) / (b + 100.0)))
    return [
        float(np.log1p(n)),
        float(np.log((solid + 50.0) / (n + 10.0))),
        part(kinds[5], solid),
        part(kinds[1], solid),
        part(kinds[2], solid),
        part(kinds[4], solid),
        part(kinds[6], solid),
        part(counts[33] + counts[63], solid),
        float(np.log((len(np.unique(hashes)) + 20.0) / (n + 20.0))),
        part((hashes[1:] == hashes[:-1]).sum(), n),
        part(len(runs) - len(np.unique(runs)), len(runs)),
        part(len(lines) - len(set(lines)), len(lines)),
        float(-(shares * np.log(shares)).sum()) if len(shares) else 0.0,
        part(len(lines), n),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts], dtype=object)


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class QuadraticModel:
    """Scale of the statistics; of each class (0, 1) the mean, the inverse of the Cholesky factor and the log weight."""

    middle: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    weights: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.middle) / self.scale
        logs = [w - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, w in zip(self.means, self.factors, self.weights, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of each class its count, sum and sum of outer products, from rows (label, statistics): two partial rows a task, summed by Spark."""
    d = len(STATISTICS)

    def partial(batches):
        sums = {}
        for batch in batches:
            labels, x = batch.column(0).to_numpy(zero_copy_only=False), _rows(batch.column(1))
            for k in (0, 1):
                own = x[labels == k]
                sums[k] = sums.get(k, 0) + np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["label", "at", "value"])

    found = rows.mapInArrow(partial, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    out = {}
    for k in (0, 1):
        v = np.zeros(1 + d + d * d)
        for r in found:
            if r.label == k:
                v[r.at] = r.value
        out[k] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def fit(rows: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> QuadraticModel | None:
    """The model of rows (label 0 or 1, statistics), from all of them; None unless both classes have rows."""
    sums = moments(rows)
    if min(n for n, _, _ in sums.values()) < 1:
        return None
    total = sum(n for n, _, _ in sums.values())
    middle = sum(s for _, s, _ in sums.values()) / total
    spread = np.diag(sum(q for _, _, q in sums.values())) / total - middle**2
    scale = np.sqrt(np.where(spread > 1e-9 * (1 + middle**2), spread, 1.0))  # a constant statistic's is rounding error
    means, spreads = [], []
    for k in (0, 1):
        n, s, q = sums[k]
        mean = s / n
        means.append((mean - middle) / scale)
        spreads.append((q / n - np.outer(mean, mean)) / np.outer(scale, scale))
    shared = sum(sums[k][0] / total * spreads[k] for k in (0, 1))
    factors, weights = [], []
    for k in (0, 1):
        spread = (1 - pooled) * spreads[k] + pooled * shared
        spread = (1 - identity) * spread + identity * max(np.trace(spread) / len(spread), 1e-3) * np.eye(len(spread))
        factor = np.linalg.cholesky(spread)
        factors.append(np.linalg.inv(factor))
        weights.append(float(np.log(sums[k][0] / total) - np.log(np.diag(factor)).sum()))
    return QuadraticModel(middle, scale, means, factors, weights)


def held_out(doc_id):
    """Whether a row is kept from the fit: crc32(doc_id as text) mod 5 is 0; a null doc_id has no label and is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """Rows (_id, label): 0 or 1 for each document that has a majority of labels."""
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").alias("label")).where(F.col("label").isin(0, 1))
    return known.groupBy("_id").agg(F.avg("label").alias("label")).where("label != 0.5").withColumn("label", F.round("label").cast("int"))


def learned(training: DataFrame) -> tuple[QuadraticModel | None, float]:
    """The model of rows (label, statistics), and the score for want of one."""
    model, share = fit(training), None
    if model is None:
        share = training.agg(F.avg("label")).first()[0]
    return model, 0.5 if share is None else float(share)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    The model learns from all labelled rows whose crc32(doc_id as text) mod 5 is not 0; the others (and no row with a
    null doc_id) are held out. A document with several labels has their majority, with a tie none; labels other than 0
    and 1 are ignored. A null text is scored as an empty one; without labels of both classes every score is the share
    of good labels (0.5 without any); repeated rows are scored one by one; other columns are not read; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), statistics_of(F.col(f"`{text}`")).alias("statistics"))
    rows = cut(rows.withColumn("held_out", held_out(F.col("doc_id"))))
    known = known_labels(labels, doc_id, label)
    model, share = learned(rows.where(~F.col("held_out")).join(known, F.col("doc_id") == F.col("_id")).select("label", "statistics"))

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    scored = rows.withColumn("score", score("statistics") if model else F.lit(share))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, training: int = TRAINING) -> DataFrame:
    """The rows of ``docs`` that ``quality_scores`` predicts good, with their columns, whatever their names.

    No text moves, and none is parsed twice but those that the model is fitted on: all labelled documents that are not
    held out, or a sample of them by hash where there are more than ``training``, whose ids are broadcast.
    """
    known = known_labels(labels, doc_id, label).where(~held_out(F.col("_id")))
    n = known.count()
    if n > training:
        known = known.where(F.pmod(F.xxhash64("_id", F.lit("training")), F.lit(n)) < int(0.98 * training))
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fitted = texts.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("label", statistics_of("text").alias("statistics"))
    model, share = learned(fitted)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts])) if len(texts) else np.zeros(0))

    return docs.where((score(F.col(f"`{text}`")) if model else F.lit(share)) >= threshold)
