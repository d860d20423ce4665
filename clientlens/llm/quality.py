"""Quality by regularised quadratic discriminant analysis of document statistics.

Each class has a mean and a shrunk covariance over transformed statistics; a
document's score is the logistic of the difference of the two log densities,
each a Mahalanobis distance by the class's cached Cholesky factor.

Training reads only sums: every task adds up counts, sums and products of its
rows, Spark adds the tasks' sums, and the driver receives one number per class
and pair of statistics however many rows are labelled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.llm.common import map_batches

STATISTICS = ("words", "word_length", "upper", "symbols", "bars", "exclaims", "adjacent", "distinct", "alphabetic",
              "stops", "lines", "digits")
SHRINKAGE = 0.1
THRESHOLD = 0.7
_SYMBOLS = re.compile(r"[#*$%&<>]")
_DIGITS = re.compile(r"[0-9]")


def statistics_of(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; an empty or null text has zeros."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    per_word = np.sqrt(np.array([
        sum(map(str.isupper, words)), len(_SYMBOLS.findall(text)), text.count("|"), text.count("!"),
        sum(map(eq, words, words[1:])), n - len(set(words)), sum(map(str.isalpha, words)),
        text.count(".") + text.count(",") + text.count(";"), text.count("\n"), len(_DIGITS.findall(text))], float) / n)
    return [float(np.log1p(n)), float(np.log(len(text) / n)), *per_word.tolist()]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of every document's whole text."""
    def run(batches) -> Iterable:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.column(0).to_pylist(), [statistics_of(t) for t in part.column(1).to_pylist()]

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Means and Cholesky factors of rejected (0) and accepted (1) documents, over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    bias: float
    only: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        z = (x - self.centre) / self.scale
        distance = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            white = np.linalg.solve(factor, (z - mean).T)
            distance.append(np.einsum("ij,ij->j", white, white) / 2)
        margin = np.clip(distance[0] - distance[1] + self.bias, -500, 500)
        return 1 / (1 + np.exp(-margin))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = SHRINKAGE) -> Model:
    """Fit on the documents of ``stats`` that ``labels`` marks 0 or 1.

    Null labels and ids are not used; a document marked more than once counts as
    the majority says and not at all at a tie. Without rows of both classes the
    model gives the same score to all: the one class's label, or 0.5.
    """
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id")
              .agg(F.avg(label).alias("y")).where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).alias("y")))
    d = len(STATISTICS)

    def sums(batches) -> Iterable:
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            y = np.array(batch.column(0).to_pylist(), bool)
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(y), d)
            x = np.hstack([np.ones((len(y), 1)), x])
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        cells = total.reshape(-1)
        yield np.arange(len(cells)).tolist(), cells.tolist()

    rows = (map_batches(stats.join(marked, "doc_id").select("y", "x"), sums, "cell int, total double")
            .groupBy("cell").agg(F.sum("total").alias("total")).collect())
    total = np.zeros(2 * (d + 1) ** 2)
    for row in rows:
        total[row["cell"]] = row["total"]
    total = total.reshape(2, d + 1, d + 1)
    n = total[:, 0, 0]
    if not n.all():
        return Model(*[np.zeros(0)] * 4, 0.0, only=0.5 if not n.any() else float(n[1] > 0))
    centre = total[:, 0, 1:].sum(0) / n.sum()
    spread = np.diag(total[:, 1:, 1:].sum(0)) / n.sum() - centre ** 2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means, factors, bias = [], [], float(np.log(n[1] / n[0]))
    for k in (0, 1):
        mean = total[k, 0, 1:] / n[k]
        covariance = (total[k, 1:, 1:] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale)
        covariance = (1 - shrinkage) * covariance + shrinkage * np.eye(d)
        factor = np.linalg.cholesky(covariance)
        means.append((mean - centre) / scale)
        factors.append(factor)
        bias += (1 if k == 0 else -1) * float(np.log(np.diag(factor)).sum())
    return Model(centre, scale, np.array(means), np.array(factors), bias)


def score_statistics(model: Model) -> Column:
    """The score as a function of the column ``x`` of ``statistics``."""
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_list()).astype(float))) if len(x) else pd.Series([], dtype=float)

    return score("x")


def score_text(model: Model) -> Column:
    """The score as a function of the column ``text``."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics_of(t) for t in text], float).reshape(-1, len(STATISTICS))))

    return score("text")
