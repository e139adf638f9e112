"""Quality classifier: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fold, staged, table

THRESHOLD = 0.3
SHRINKAGE = 0.1
_RARE = 1e-3
FEATURES = (
    "log words", "log word length", "log longest word", "capitals", "exclamation and question marks", "bars", "symbols", "digits",
    "stops and commas", "line ends", "distinct words", "repeated words", "other bytes",
)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text, in the order of FEATURES. Null counts as empty."""
    text = text or ""
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words = text.split()
    n, n_bytes = len(words), max(1, int(count.sum()))
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[128:].sum()))
    rate = lambda c, of=n_bytes: float(np.log(_RARE + c / of))
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(n_bytes / (n + 1))), float(np.log1p(max(map(len, words), default=0))),
        rate(count[65:91].sum(), letters), rate(count[33] + count[63]), rate(count[124]), rate(count[35:39].sum() + count[42] + count[64] + count[94:97].sum() + count[126]),
        rate(count[48:58].sum()), rate(count[44] + count[46]), rate(count[10]), float(np.log((len(set(words)) + 1) / (n + 1))),
        rate(again, max(1, n)), rate(count[128:].sum(), letters),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(text: pd.Series) -> pd.Series:
    return text.map(statistics)


@dataclass(frozen=True)
class Discriminant:
    """Class means, the inverses of the shrunk covariances' Cholesky factors and log determinants: all that a score needs."""

    means: np.ndarray
    whiten: np.ndarray
    offset: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        z = np.einsum("cij,cnj->cni", self.whiten, x[None] - self.means[:, None])
        log_density = self.offset[:, None] - 0.5 * (z**2).sum(axis=2)
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0], -700, 700)))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of (1, x) by label: a bounded number of rows from each batch."""
    for rows in batches:
        for label, own in rows.groupby("label"):
            x = np.column_stack([np.ones(len(own)), np.array(own["f"].tolist())])
            yield pd.DataFrame({"label": int(label), "k": range(x.shape[1] ** 2), "v": (x.T @ x).ravel()})


def fit(stats: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant | float:
    """Fit on all rows of ``stats`` (doc_id, f) that ``labels`` (doc_id, quality) marks 0 or 1. Only sums over the rows reach the driver.

    A document with several label rows counts once for each. Without rows of both classes there is no discriminant: the score is then
    the share of label 1 (0.5 without labels).
    """
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    sums = stats.select("doc_id", "f").join(marked, "doc_id").select("label", "f").mapInPandas(_moments, "label int, k int, v double")
    d = len(FEATURES) + 1
    total = np.zeros((2, d * d))
    for r in sums.groupBy("label", "k").agg(F.sum("v").alias("v")).collect():
        total[r.label, r.k] = r.v
    total = total.reshape(2, d, d)
    n = total[:, 0, 0]
    if n.min() < 2:
        return float(n[1] / n.sum()) if n.sum() else 0.5
    means = total[:, 0, 1:] / n[:, None]
    cov = total[:, 1:, 1:] / n[:, None, None] - np.einsum("ci,cj->cij", means, means)
    pooled = np.diag((cov * n[:, None, None]).sum(axis=0).diagonal() / n.sum() + 1e-6)
    factors = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * pooled)
    offset = np.log(n / n.sum()) - np.log(factors.diagonal(axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(means, np.linalg.inv(factors), offset)


def score(model: Discriminant | float, f: Column) -> Column:
    """The score of a column of statistics: 0 to 1, higher where label 1 is likelier."""
    if isinstance(model, float):
        return F.lit(model)

    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist()))) if len(rows) else pd.Series([], dtype="float64")

    return of(f)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, held_out, score, predicted. The label rows of one fold in five, by the id's checksum, are held out.

    Null and empty texts have statistics like any other and get a score. A null id is not held out and has no label. Repeated rows get
    equal scores. Only doc_id and text are read.
    """
    bound_batches(docs.sparkSession)
    stats = staged(docs.select("doc_id", features("text").alias("f")), "statistics")
    model = fit(stats.where(fold(F.col("doc_id")) != 0), labels)
    scored = stats.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score(model, F.col("f")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold`` by a model fitted on all labels."""
    bound_batches(docs.sparkSession)
    marked = docs.select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    model = fit(marked.select("doc_id", features("text").alias("f")), labels)
    return docs.where(score(model, features("text")) >= threshold)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
