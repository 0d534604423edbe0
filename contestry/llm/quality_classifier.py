"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from one Spark aggregate over all training rows. Each covariance is shrunk towards
the pooled one and a scaled identity; its Cholesky factor is kept, and a score is the logistic of the difference of
two Mahalanobis log-densities, written as Spark expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import fold, table, written
from contestry.llm.textstats import with_stats

THRESHOLD = 0.3

#: Added to each denominator, so that a short text's ratios lie near zero instead of at extremes.
FEW_WORDS, FEW_CHARS, FEW_LINES = 10, 60, 6


def damped(a: str, b: str, more: int) -> Column:
    return F.sqrt(F.col(a).cast("double") / (F.col(b) + more))


#: Statistics, brought near a normal shape.
FEATURES = {
    "x0": lambda: F.log1p(F.col("n_words").cast("double")),
    "x1": lambda: F.log1p((F.col("word_chars") + 5.0 * FEW_WORDS) / (F.col("n_words") + FEW_WORDS)),
    "x2": lambda: damped("n_symbols", "n_words", FEW_WORDS),
    "x3": lambda: damped("n_upper", "word_chars", FEW_CHARS),
    "x4": lambda: damped("n_shouts", "n_words", FEW_WORDS),
    "x5": lambda: damped("n_stops", "n_words", FEW_WORDS),
    "x6": lambda: damped("n_dup_lines", "n_lines", FEW_LINES),
    "x7": lambda: F.log1p(F.col("n_distinct").cast("double") + FEW_WORDS) / F.log1p(F.col("n_words").cast("double") + FEW_WORDS),
    "x8": lambda: damped("n_digits", "word_chars", FEW_CHARS),
}


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, inverse Cholesky factor, half log-determinant and log prior. None: a class is missing."""

    means: list[np.ndarray] | None
    factors: list[np.ndarray] | None
    half_logdets: list[float] | None
    log_priors: list[float] | None

    def score(self) -> Column:
        """Probability of class 1 from the columns in FEATURES."""
        if self.means is None:
            return F.lit(0.5)
        logs = []
        for c in (0, 1):
            centred = [F.col(x) - F.lit(float(m)) for x, m in zip(FEATURES, self.means[c], strict=True)]
            rows = [reduce(lambda a, b: a + b, [F.lit(float(w)) * z for w, z in zip(row[: i + 1], centred, strict=False)]) for i, row in enumerate(self.factors[c])]
            logs.append(F.lit(self.log_priors[c] - self.half_logdets[c]) - 0.5 * reduce(lambda a, b: a + b, [r * r for r in rows]))
        gap = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), logs[1] - logs[0]))
        return 1.0 / (1.0 + F.exp(-gap))


def fit(rows: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.02) -> Discriminant:
    """rows: FEATURES and y (0 or 1), all of them counted. to_pooled, to_identity: the shares of shrinkage."""
    names = list(FEATURES)
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    got = rows.groupBy("y").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s_{x}") for x in names], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q_{i}_{j}") for i, j in pairs]
    )
    by = {r["y"]: r for r in got.collect()}
    if len(by) < 2 or min(r["n"] for r in by.values()) < d + 2:
        return Discriminant(None, None, None, None)
    means, covs, sizes = [], [], [by[c]["n"] for c in (0, 1)]
    for c in (0, 1):
        r, n = by[c], by[c]["n"]
        m = np.array([r[f"s_{x}"] for x in names]) / n
        q = np.zeros((d, d))
        for i, j in pairs:
            q[i, j] = q[j, i] = r[f"q_{i}_{j}"] / n
        means.append(m)
        covs.append(q - np.outer(m, m))
    pooled = (sizes[0] * covs[0] + sizes[1] * covs[1]) / sum(sizes)
    factors, half = [], []
    for s in covs:
        s = (1 - to_pooled) * s + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * np.diag(np.diag(pooled) + 1e-4)
        chol = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(chol))
        half.append(float(np.log(np.diag(chol)).sum()))
    return Discriminant(means, factors, half, [float(np.log(n / sum(sizes))) for n in sizes])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return with_stats(docs, id_col, text_col).select("doc_id", *[f().alias(x) for x, f in FEATURES.items()])


def train(feats: DataFrame, labels: DataFrame) -> Discriminant:
    """From the rows of feats whose fold of five is not 0 and whose id has quality 0 or 1 (several: the lowest)."""
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"))
    return fit(feats.filter(fold("doc_id", 5) != 0).join(marked, "doc_id"))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document; null and empty texts are scored as texts of no words."""
    feats = written(features(docs, id_col, text_col), "quality-features")
    scored = feats.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), train(feats, labels).score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; null and empty texts are judged as texts of no words.

    The texts stay where they are: labels meet statistics, not texts, and each text is judged in place by the fitted expressions.
    """
    model = train(features(docs), labels)
    kept = ["id_", "text_", "row_"]
    rows = docs.select(F.struct(*docs.columns).alias("row_"), F.col("doc_id").alias("id_"), F.col("text").alias("text_"))
    stats = with_stats(rows.select(F.struct(*kept).alias("all_"), "text_"), "all_", "text_")
    judged = stats.select(F.col("doc_id.row_").alias("row_"), *[f().alias(x) for x, f in FEATURES.items()])
    return judged.filter(model.score() >= THRESHOLD).select("row_.*")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
