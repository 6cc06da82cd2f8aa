"""Quality of documents by regularised quadratic discriminant analysis.

Whole texts become a dozen statistics, transformed to be nearly normal within a class. Each
class has a mean and a covariance, shrunk towards the diagonal of the pooled one; a score is
the difference of the two Mahalanobis log densities with the class weights, as a
probability. The Cholesky factors are computed once and travel with the function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storygraph.llm.columns import fold
from storygraph.session import materialize

STATISTICS = (
    "words",
    "word_length",
    "upper",
    "symbols",
    "sentence_marks",
    "digits",
    "repeated_neighbours",
    "repeated_words",
    "top_word",
    "repeated_lines",
    "line_words",
    "capitalised",
    "bars",
    "marked_words",
)
SHRINKAGE = 0.3
CODES = np.arange(256)
UPPER = (CODES >= 65) & (CODES <= 90)
LETTER = UPPER | ((CODES >= 97) & (CODES <= 122)) | (CODES >= 128)
DIGIT = (CODES >= 48) & (CODES <= 57)
SPACE = (CODES == 32) | ((CODES >= 9) & (CODES <= 13))
MARK = np.isin(CODES, list(b".,;:?'\"-()"))
SYMBOL = ~(LETTER | DIGIT | SPACE | MARK) & (CODES >= 32)
MARKS_END = tuple(b"!#*%&$|=<>~^")


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text, in the order of ``STATISTICS``; finite for any text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    letters = int(seen[LETTER].sum())
    shown = max(1, int(seen[~SPACE].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    top = max(counts.values(), default=0)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marked = sum(w[-1] in MARKS_END for w in words)
    capital = sum(65 <= w[0] <= 90 for w in words)

    def share(part: float, whole: float) -> float:
        """Log of a share above a floor of 2 %, drawn to 2 % by five counts: short texts lie where long clean ones do."""
        return float(np.log(0.02 + (part + 0.1) / (whole + 5)))

    return np.array(
        [
            np.log1p(n),
            np.log1p(letters / max(1, n)),
            share(int(seen[UPPER].sum()), letters),
            share(int(seen[SYMBOL].sum()), shown),
            share(int(seen[MARK].sum()), shown),
            share(int(seen[DIGIT].sum()), shown),
            share(same, max(0, n - 1)),
            share(n - len(counts), n),
            share(max(0, top - 1), n),
            share(len(lines) - len(set(lines)), len(lines)),
            np.log1p(n / max(1, len(lines))),
            share(capital, n),
            share(int(seen[124]), n),
            share(marked, n),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Per class the mean, the inverse Cholesky factor, and the log of weight and volume."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray
    scale: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of class 1, for rows of statistics."""
        x = x / self.scale
        logs = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offsets, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit_discriminant(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant | None:
    """From each class's count, sum and sum of outer products; None where a class has no row."""
    if min(counts) <= 0:
        return None
    means = sums / counts[:, None]
    inside = squares - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = np.diag(inside.sum(axis=0)) / counts.sum()
    scale = np.sqrt(np.maximum(pooled, 1e-6))
    whiten, offsets = [], []
    for n, scatter in zip(counts, inside, strict=True):
        covariance = scatter / n / np.outer(scale, scale)
        # A class of few rows leans on the pooled variances more.
        a = max(shrinkage, len(scale) / (len(scale) + n))
        covariance = (1 - a) * covariance + a * np.eye(len(scale))
        factor = np.linalg.cholesky(covariance)
        whiten.append(np.linalg.inv(factor))
        offsets.append(np.log(n / counts.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means / scale, np.array(whiten), np.array(offsets), scale)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) with the statistics of every row; no shuffle."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], ["id", "x"])

    return rows.mapInArrow(measure, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


def class_moments(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products per class of rows (label, x); summed where the rows are."""
    d = len(STATISTICS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = np.array(batch.column(1).to_pylist()).reshape(-1, d)
            for c in (0, 1):
                part = x[label == c]
                total[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "v"])

    sums = labelled.select(F.col("label").cast("int"), "x").mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(2 * (1 + d + d * d))
    total[sums["at"].to_numpy()] = sums["v"].to_numpy()
    total = total.reshape(2, -1)
    return total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    threshold: float = 0.3,
    shrinkage: float = SHRINKAGE,
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Learns from all labelled rows whose fold is not 0; a null id trains nowhere and null
    labels are left out. ``score`` is the probability of label 1, also for null and empty
    texts; without a row of either class it is 0.5. Repeated rows score alike. Columns
    besides id and text are no input; an empty table gives an empty result.
    """
    measured, _ = materialize(document_statistics(docs, id_col, text_col))
    held_out = fold(F.col("id"), folds) == 0
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).filter(F.col("label").isNotNull() & ~held_out)
    model = fit_discriminant(*class_moments(measured.join(known, "id").select("label", "x")), shrinkage)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(STATISTICS))
            p = np.full(len(x), 0.5) if model is None else model.probability(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["id", "score"])

    scored = measured.mapInArrow(score, f"id {measured.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
