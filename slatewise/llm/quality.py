"""Quality classifier: a regularised quadratic discriminant over transformed statistics of a document.

Each class has a mean and a covariance, shrunk towards its own variances and the pooled ones; a text's score is the
difference of the two log densities, Mahalanobis distances taken through Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.llm.common import map_rows, stored
from slatewise.llm.language import held_out

FOLDS, HELD_OUT = 3, 1
#: Share of the pooled diagonal in a class covariance, and what is added to every variance.
SHRINKAGE = 0.1
RIDGE = 1e-3
#: Words of ordinary text that every share is smoothed by.
PRIOR_WORDS = 10

FEATURES = (
    "log_words", "word_length", "letters", "upper", "digits", "commas", "shouts", "symbols", "other_marks",
    "distinct", "repeats", "repeat_lines", "sentence", "short_words", "capitals", "entropy",
)

_SETS = {"commas": b".,;:", "shouts": b"!?", "symbols": b"#*$%&|<>", "digits": b"0123456789"}
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[b for b in range(256) if b >= 0xC0 or chr(b).isascii() and chr(b).islower()]] = 1
_CLASS[[b for b in range(65, 91)]] = 2
for _i, _set in enumerate(_SETS.values()):
    _CLASS[list(_set)] = 3 + _i
_CLASS[[32, *range(9, 14)]] = 7
_CLASS[range(0x80, 0xC0)] = 8


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES, each transformed to be roughly symmetric. Null and empty texts have defined ones too."""
    data = (text or "").encode("utf-8", "replace")
    codes = np.frombuffer(data, np.uint8)
    marks, lower, upper, commas, shouts, symbols, digits, spaces, inner = np.bincount(_CLASS[codes], minlength=9).tolist()
    words = data.split()
    n, chars = len(words), max(1, len(data) - inner)
    # Shares are those of the text and of PRIOR_WORDS ordinary words more, so that a few words say little either way.
    share = lambda count, of, usual=0.0, per=1: float(np.sqrt((count + usual * PRIOR_WORDS * per) / (of + PRIOR_WORDS * per)))
    lines = [line for line in data.split(b"\n") if line.strip()]
    histogram = np.bincount(codes, minlength=256) / max(1, len(data))
    histogram = histogram[histogram > 0]
    return [
        np.log1p(n),
        np.log1p((chars - spaces + 5 * PRIOR_WORDS) / (n + PRIOR_WORDS)),
        share(lower + upper, chars, 0.8, 6),
        share(upper, lower + upper, 0.03, 5),
        share(digits, chars, 0.0, 6),
        share(commas, n, 0.15),
        share(shouts, n),
        share(symbols, n),
        share(marks, n),
        float(np.log1p(len(set(words))) / np.log1p(max(1, n))),
        share(sum(map(bytes.__eq__, words, words[1:])), n),
        share(len(lines) - len(set(lines)), len(lines)),
        np.log1p(n / (1 + data.count(b".") + data.count(b"!") + data.count(b"?"))),
        share(sum(1 for w in words if len(w) <= 3), n, 0.45),
        share(sum(1 for w in words if 65 <= w[0] <= 90), n, 0.15),
        float(-(histogram * np.log2(histogram)).sum()) / min(4.3, np.log2(len(data))) if len(data) > 1 else 1.0,
    ]


class Discriminant:
    """Means and Cholesky factors of both classes. Where a class has too few rows, every score is the share of label 1."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        d = len(FEATURES)
        counts = {label: moments[label][0] if label in moments else 0 for label in (0, 1)}
        total = sum(counts.values())
        self.share = counts[1] / total if total else 0.5
        self.usable = min(counts.values()) >= 2
        if not self.usable:
            return
        means = {k: moments[k][1] / counts[k] for k in (0, 1)}
        covariances = {k: moments[k][2] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)}
        pooled = sum(counts[k] * covariances[k] for k in (0, 1)) / total
        self.parts = []
        for k in (0, 1):
            shrink = max(SHRINKAGE, min(1.0, d / counts[k]))
            own = (1 - shrink) * covariances[k] + shrink * np.diag(np.diag(pooled)) + RIDGE * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.parts.append((means[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(counts[k] / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, above a half where class 1 is likelier; the log-density difference is divided by the number of
        features, so that sure cases still differ."""
        if not self.usable:
            return np.full(len(x), self.share)
        density = []
        for mean, inverse, log_det, prior in self.parts:
            z = (x - mean) @ inverse.T
            density.append(prior - 0.5 * ((z**2).sum(axis=1) + log_det))
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / x.shape[1], -500, 500)))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and a column for each of FEATURES, stored."""

    def make():
        return lambda ids, out, texts: [(i, h, *statistics(t)) for i, h, t in zip(ids, out, texts)]

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(FOLDS, HELD_OUT), F.lit(False)).alias("held_out"), "text")
    return stored(map_rows(chosen, "doc_id bigint, held_out boolean, " + ", ".join(f"{f} double" for f in FEATURES), make), "statistics")


def fit_quality(statistics_table: DataFrame, labels: DataFrame) -> Discriminant:
    """Moments of both classes over all labelled rows that are not held out, summed by Spark.

    Labels other than 0 and 1, and documents with contradicting labels, do not count; a repeated label counts once.
    """
    sure = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    rows = statistics_table.filter("NOT held_out").join(sure.filter("label = other").drop("other"), "doc_id")
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    first = [F.sum(f).alias(f"s_{i}") for i, f in enumerate(FEATURES)]
    second = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p_{i}_{j}") for i, j in pairs]
    moments = {}
    for row in rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), *first, *second).collect():  # two rows
        square = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            square[i, j] = square[j, i] = row[f"p_{i}_{j}"]
        moments[int(row["label"])] = (float(row["rows"]), np.array([row[f"s_{i}"] for i in range(len(FEATURES))]), square)
    return Discriminant(moments)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted, one row per row of ``docs``.

    Null text scores as empty. A row without doc_id is not held out and has no label. Other columns are ignored.
    """
    rows = document_statistics(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(rows, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]).reshape(-1, len(FEATURES))
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(document_statistics(docs), labels))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        rows = np.array([statistics(t) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.value.score(rows) >= 0.5)

    return docs.filter(good("text"))
