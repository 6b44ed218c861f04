"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the covariance of both classes together and that one's diagonal.
A text's score is the logistic of the difference of its log densities, each a Mahalanobis distance by a cached Cholesky
factor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm._words import batch_words

ACCEPT = 0.7
STATISTICS = ("words", "word_size", "word_spread", "letters", "digits", "upper", "marks", "odd_marks", "stops", "no_letter_words", "distinct_words", "top_word", "lines", "line_repeats", "start_upper")
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 letter, 2 digit, 3 capital, 4 sentence mark, 5 any other mark
_CLASS[128:] = 1
for _c in range(33, 127):
    _CLASS[_c] = 1 if chr(_c).islower() else 2 if chr(_c).isdigit() else 3 if chr(_c).isupper() else 4 if chr(_c) in ".,;:!?'\"-()" else 5


def _share(x, n):
    """Log odds of a share, held away from 0 and 1 by half a unit."""
    return np.log((x + 0.5) / (np.maximum(n - x, 0) + 0.5))


def statistics(batches):
    """(id, text) -> id, transformed statistics."""
    for b in batches:
        rows = []
        for w in batch_words(b.column(1)):
            kinds = _CLASS[w.data]
            for d in range(w.docs):
                a, z = w.offsets[d], w.offsets[d + 1]
                n = z - a
                if not n:
                    rows.append(np.zeros(len(STATISTICS)))
                    continue
                lo, hi = w.start[a], w.end[z - 1]
                k = np.bincount(kinds[lo:hi], minlength=6)
                ink = max(1, k[1:].sum())
                size = w.end[a:z] - w.start[a:z]
                letter = np.append(0, np.cumsum((kinds[lo:hi] == 1) | (kinds[lo:hi] == 3)))
                bare = (letter[w.end[a:z] - lo] == letter[w.start[a:z] - lo]).sum()
                _, times = np.unique(w.hash[a:z], return_counts=True)
                last = w.data[w.end[a:z] - 1]
                breaks = w.data[lo:hi] == 10
                cut = np.searchsorted(w.start[a:z] - lo, np.flatnonzero(breaks))
                lines = np.diff(np.concatenate([[0], cut, [n]]))
                edge = np.concatenate([[0], cut, [n]])
                sums = np.append(np.uint64(0), np.cumsum(w.hash[a:z], dtype=np.uint64))
                of_line = (sums[edge[1:]] - sums[edge[:-1]])[lines > 0]
                caps = kinds[w.start[a:z]] == 3
                rows.append(np.array([np.log1p(n), np.log(size.mean()), np.log1p(size.std()), _share(k[1] + k[3], ink), _share(k[2], ink), _share(k[3], ink), _share(k[4], ink), _share(k[5], ink), _share(np.isin(last, (46, 33, 63)).sum(), n), _share(bare, n), _share(len(times), n), _share(times.max(), n), _share(len(of_line), n), _share(len(of_line) - len(np.unique(of_line)), len(of_line)), _share(caps.sum(), n)]))
        flat = np.concatenate(rows) if rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(flat), len(STATISTICS)).cast(pa.list_(pa.float64()))], names=["doc_id", "stats"])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats (see STATISTICS) of every whole text; zeros for texts without a word."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(statistics, f"doc_id {dict(docs.dtypes)[id_col]}, stats array<double>")


def _class_sums(batches):
    """Count, sums and sums of products by class, one row for each class and task."""
    k = len(STATISTICS)
    total = {0: np.zeros((k + 1, k + 1)), 1: np.zeros((k + 1, k + 1))}
    for b in batches:
        x = b.column(0).combine_chunks() if isinstance(b.column(0), pa.ChunkedArray) else b.column(0)
        x = np.column_stack([np.ones(len(x)), x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), k)])
        y = b.column(1).to_numpy()
        for c in (0, 1):
            total[c] += x[y == c].T @ x[y == c]
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], names=["label", "sums"])


@dataclass
class QualityModel:
    means: np.ndarray
    factors: list[np.ndarray]  # inverse Cholesky factors of the covariances
    offsets: np.ndarray  # log determinant and prior of each class

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = [np.square((x - m) @ f.T).sum(1) for m, f in zip(self.means, self.factors, strict=True)]
        d = (z[0] - z[1]) / 2 + self.offsets[1] - self.offsets[0]
        return 1 / (1 + np.exp(-np.clip(d, -50, 50)))

    def scorer(self):
        def run(batches):
            for b in batches:
                x = b.column(1).combine_chunks() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1)
                x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(self.scores(x))], names=["doc_id", "score"])

        return run


def train(stats: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.05) -> QualityModel:
    """Fit on all labelled rows: stats (doc_id, stats) joined to labels (doc_id, label 0 or 1); null labels are ignored.

    shrink: weight of the covariance of all rows in each class's; ridge: weight of its diagonal in the result. With fewer
    than two labelled texts of a class (or none at all) there is no covariance, and every text's score is the share of label 1
    with one text added to each class. Ids that are null match no label; several labels of an id count each.
    """
    k = len(STATISTICS)
    rows = stats.join(labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int")), "doc_id").select("stats", "label").mapInArrow(_class_sums, "label int, sums array<double>")
    parts = rows.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("v")).toPandas()
    total = [parts[parts.label == c].sort_values("pos").v.to_numpy().reshape(k + 1, k + 1) if (parts.label == c).any() else np.zeros((k + 1, k + 1)) for c in (0, 1)]
    if min(t[0, 0] for t in total) < 2:
        count = np.array([t[0, 0] for t in total]) + 1
        return QualityModel(np.zeros((2, k)), [np.zeros((k, k))] * 2, np.log(count / count.sum()))
    count, means = np.array([t[0, 0] for t in total]), np.array([t[0, 1:] / t[0, 0] for t in total])
    own = [t[1:, 1:] / t[0, 0] - np.outer(m, m) for t, m in zip(total, means, strict=True)]
    pooled = (count[0] * own[0] + count[1] * own[1]) / count.sum()
    spread = np.diag(np.maximum(np.diag(pooled), 1e-4))
    covariances = [(1 - ridge) * ((1 - shrink) * c + shrink * pooled) + ridge * spread for c in own]
    lower = [np.linalg.cholesky(c) for c in covariances]
    offsets = np.array([np.log(n / count.sum()) - np.log(np.diag(f)).sum() for n, f in zip(count, lower, strict=True)])
    return QualityModel(means, [np.linalg.inv(f) for f in lower], offsets)


def score(stats: DataFrame, model: QualityModel, accept: float = ACCEPT) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= accept) of every row of stats.

    Null and empty texts have zero statistics and are scored as those; texts are read whole, whatever their length. Repeated
    rows and null ids are scored each; a score of exactly `accept` is label 1; other columns are ignored; an empty table gives
    no rows.
    """
    return stats.select("doc_id", "stats").mapInArrow(model.scorer(), f"doc_id {dict(stats.dtypes)['doc_id']}, score double").withColumn("predicted", (F.col("score") >= accept).cast("int"))
