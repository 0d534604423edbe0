"""What stands around a model: imputation, mirrored scores, calibration. Scores p lie between 0 and 1, y is 0 or 1."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from itertools import product
from pathlib import Path

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.scalar import scheduled_rounds
from contestry.operators.history import walk_forward
from contestry.operators.metrics import auc
from contestry.sources.staged import staged


#: Half the share of a column's values, around the middle, that are counted to tell its median, and the accuracy of the bounds that are told first.
AROUND, BOUNDS = 0.002, 1_000


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column, as percentile gives it; None where nothing is known.

    Bounds around the middle are told first, then what lies below them is counted and the few values between them are ordered, so no task holds
    a column's values. Where bounds miss the middle, that column is taken whole.
    """
    if not columns:
        return {}
    at = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    whole = range(len(columns))
    told = at.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in whole], *[F.percentile_approx(f"c{i}", [0.5 - AROUND, 0.5 + AROUND], BOUNDS).alias(f"b{i}") for i in whole]).first()
    known = [i for i in whole if told[f"n{i}"]]
    low, high = ({i: told[f"b{i}"][k] for i in known} for k in (0, 1))
    least = at.agg(F.lit(0).alias("z"), *[F.count_if(F.col(f"c{i}") < low[i]).alias(f"c{i}") for i in known]).first()
    cells = [F.when(F.col(f"c{i}").between(low[i], high[i]), F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("v"))) for i in known]
    got = {}
    if known:
        # Places from 0 of the one or two middle values, among those between the bounds.
        first, last = ({i: (told[f"n{i}"] - k) // 2 - least[f"c{i}"] for i in known} for k in (1, 0))
        place = lambda of: F.element_at(F.create_map(*[F.lit(x) for i in known for x in (i, of[i])]), F.col("i"))
        few = at.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*").groupBy("i", "v").agg(F.count("*").alias("n"))
        few = few.withColumn("to", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
        got = {r["i"]: r for r in few.groupBy("i").agg(F.min(F.when(F.col("to") > place(first), F.col("v"))).alias("a"), F.min(F.when(F.col("to") > place(last), F.col("v"))).alias("b")).collect()}  # a row for each column
    out = dict.fromkeys(columns)
    for i in known:
        r = got.get(i)
        if r and first[i] >= 0 and r["a"] is not None and r["b"] is not None:
            out[columns[i]] = r["a"] if r["a"] == r["b"] else 0.5 * r["a"] + 0.5 * r["b"]
        else:
            out[columns[i]] = at.agg(F.percentile(f"c{i}", F.lit(0.5))).first()[0]
    return out


def imputer(train: DataFrame, columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A function that replaces missing values by train's exact medians."""
    m = medians(train, columns)
    return lambda rows: rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m[c])) for c in columns})


def median_impute(rows: DataFrame, columns: list[str], fitted_on: str) -> DataFrame:
    """rows with missing values replaced by the exact median of the rows where fitted_on holds."""
    return imputer(rows.filter(fitted_on), columns)(rows)


def symmetrised(scores: DataFrame, key: str, mirrored: str) -> DataFrame:
    """key and p = (p(x) + 1 - p(mirror of x)) / 2 from rows of both orientations, in one aggregation."""
    return scores.groupBy(key).agg(F.avg(F.when(F.col(mirrored), 1 - F.col("p")).otherwise(F.col("p"))).alias("p"))


def calibrated(train: DataFrame, rows: DataFrame, method: str) -> DataFrame:
    """rows with calibrated_: isotonic, or sigmoid on the log-odds, fitted on train's p and y."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    ready = VectorAssembler(inputCols=["z_"], outputCol="x_")
    with_z = lambda df: df.withColumn("z_", F.ln(p / (1 - p)) if method == "sigmoid" else F.col("p"))
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="calibrated_").fit(train.select(F.col("p").cast("double"), F.col("y").cast("double")))
        return model.transform(rows)
    fit = ready.transform(with_z(train)).select("x_", F.col("y").cast("double"))
    model = LogisticRegression(featuresCol="x_", labelCol="y", maxIter=100).fit(fit)
    a, b = float(model.coefficients[0]), float(model.intercept)
    return with_z(rows).withColumn("calibrated_", 1 / (1 + F.exp(-(F.col("z_") * a + b)))).drop("z_")


def choose_calibration(rows: DataFrame, key: str, folds: int = 5) -> tuple[str, dict[str, float]]:
    """The method with the least out-of-fold Brier score, and both scores; a row's fold is a hash of its key."""
    part = rows.withColumn("fold_", F.pmod(F.xxhash64(key), F.lit(folds)))
    loss = {}
    for method in ("isotonic", "sigmoid"):
        out = [calibrated(part.filter(F.col("fold_") != k), part.filter(F.col("fold_") == k), method).select("calibrated_", "y") for k in range(folds)]
        whole = out[0]
        for more in out[1:]:
            whole = whole.unionByName(more)
        loss[method] = whole.agg(F.avg((F.col("calibrated_") - F.col("y")) ** 2)).first()[0]
    return min(loss, key=lambda m: (loss[m], m)), loss


#: The grid of settings (three depths, three counts of trees, three rates, two shares of rows, two least leaves).
GRID = {"maxDepth": (2, 3, 4), "maxIter": (20, 40, 80), "stepSize": (0.03, 0.05, 0.1), "subsamplingRate": (0.8, 1.0), "minInstancesPerNode": (1, 5)}
FEWEST_PRIOR = 3


def settings(grid: dict[str, tuple]) -> list[dict]:
    """Every combination, the first name varying slowest."""
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def with_vector(rows: DataFrame, features: list[str], scaled: str | None = None) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=scaled or "x_").transform(rows)


def fitted(train: DataFrame, features: list[str], setting: dict, label: str = "y", seed: int = 42) -> GBTClassificationModel:
    return GBTClassifier(featuresCol="x_", labelCol="y_", seed=seed, **setting).fit(with_vector(train, features).select("x_", F.col(label).cast("double").alias("y_")))


def boosted(train: DataFrame, features: list[str], setting: dict, label: str = "y", seed: int = 42) -> Callable[[DataFrame, str], DataFrame]:
    """Boosted trees on train; gives a function that adds their probability of 1 to rows under a name. Features must be known."""
    model = fitted(train, features, setting, label, seed)
    return lambda rows, name: model.transform(with_vector(rows, features)).withColumn(name, vector_to_array("probability")[1]).drop("x_", "rawPrediction", "probability", "prediction")


def search(rows: DataFrame, features: list[str], order: list[str], folds: int = 3, grid: dict[str, tuple] | None = None) -> list[tuple[dict, float]]:
    """Each setting of the grid with its mean AUC over expanding folds (a fold trains on what lies before it), the best first.

    The loop over settings is the driver's, each fit and score is Spark's. Rows are dealt into folds once.
    """
    dealt = walk_forward(rows, order, folds).cache()
    out = []
    try:
        for setting in settings(grid or GRID):
            scores = []
            for k in range(1, folds + 1):
                train, test = (dealt.filter((F.col("fold") == k) & (F.col("role") == role)) for role in ("train", "validate"))
                scores.append(auc(boosted(train, features, setting)(test, "p").select("p", "y")).first()["auc"])
            known = [s for s in scores if s is not None]
            out.append((setting, sum(known) / len(known) if known else 0.0))
    finally:
        dealt.unpersist()
    return sorted(out, key=lambda x: -x[1])


def method_model(train: DataFrame, features: list[str], classes: list[str], setting: dict, regularisation: float = 0.1) -> Callable[[DataFrame], DataFrame]:
    """Half boosted trees (one against the rest for each class, normalised), half a multinomial logistic model on scaled features;
    gives a function that adds p_<class>. y: a class's number."""
    trees = [boosted(train.withColumn("is_", (F.col("y") == i).cast("int")), features, setting, "is_") for i in range(len(classes))]
    scaler = StandardScaler(inputCol="v_", outputCol="x_", withMean=True, withStd=True).fit(with_vector(train, features, "v_"))
    flat = LogisticRegression(featuresCol="x_", labelCol="y_", family="multinomial", regParam=regularisation, maxIter=100).fit(scaler.transform(with_vector(train, features, "v_")).select("x_", F.col("y").cast("double").alias("y_")))

    def score(rows: DataFrame) -> DataFrame:
        at = rows
        for i, tree in enumerate(trees):
            at = tree(at, f"t{i}_")
        total = sum((F.col(f"t{i}_") for i in range(len(classes))), F.lit(0.0))
        lin = flat.transform(scaler.transform(with_vector(at, features, "v_"))).withColumn("l_", vector_to_array("probability"))
        return lin.select(*rows.columns, *[((F.col(f"t{i}_") / total + F.col("l_")[i]) / 2).alias(f"p_{c}") for i, c in enumerate(classes)])

    return score


def mirrored(rows: DataFrame, diffs: list[str]) -> DataFrame:
    """rows with both corners swapped: every difference is negated, NULL stays."""
    return rows.withColumns({c: F.lit(0.0) - F.col(c) for c in diffs})


def variants(holdout: DataFrame, rows: DataFrame, key: str, diffs: list[str], score: Callable[[DataFrame, str], DataFrame], method: str | None = None) -> DataFrame:
    """key, y and the four probabilities raw, symmetrised, raw_calibrated and symmetrised_calibrated of rows; the calibration is fitted on
    holdout's raw scores, by the better method there unless one is given. score imputes what is missing, in either orientation."""
    own = staged(score(holdout, "p").select(key, "y", "p"), "calibration-scores")
    method = method or choose_calibration(own, key)[0]
    own = own.select("p", "y")
    both = score(rows, "p").select(key, "y", "p").join(score(mirrored(rows, diffs), "q").select(key, "q"), key)
    forward = calibrated(own, both, method).withColumnRenamed("calibrated_", "cp")
    back = calibrated(own, forward.withColumnsRenamed({"p": "p0", "q": "p"}), method)
    return back.select(key, "y", F.col("p0").alias("raw"), ((F.col("p0") + 1 - F.col("p")) / 2).alias("symmetrised"), F.col("cp").alias("raw_calibrated"), ((F.col("cp") + 1 - F.col("calibrated_")) / 2).alias("symmetrised_calibrated"))


def matchups(asked: DataFrame, bouts: DataFrame, as_of: Column) -> DataFrame:
    """asked (red_id, blue_id) with the context of the meeting: the latest undecided bout of the two, else their latest, else as_of with the
    class of either's latest bout, three rounds and an unknown title.

    bouts: bout_id, event_date, winner_id, red_id, blue_id, weight_class, scheduled, title.
    """
    pair = lambda df: df.withColumn("k_", F.array_sort(F.array("red_id", "blue_id")))
    own = F.struct(F.col("winner_id").isNull(), "event_date", "bout_id")
    met = pair(bouts).groupBy("k_").agg(F.max_by(F.struct("bout_id", "event_date", "weight_class", "scheduled", "title"), own).alias("m_"))
    last = bouts.select(F.explode(F.array("red_id", "blue_id")).alias("id"), F.struct("event_date", "bout_id", "weight_class").alias("b_")).groupBy("id").agg(F.max("b_").alias("l_"))
    at = pair(asked).join(met, "k_", "left")
    for c in ("red", "blue"):
        at = at.join(last.select(F.col("id").alias(f"{c}_id"), F.col("l_").alias(f"{c}_l")), f"{c}_id", "left")
    return at.select(
        "red_id", "blue_id", F.col("m_.bout_id").alias("bout_id"), F.coalesce("m_.event_date", as_of).alias("day"), F.when(F.col("m_").isNotNull(), F.col("m_.weight_class")).otherwise(F.greatest("red_l", "blue_l")["weight_class"]).alias("weight_class"),
        scheduled_rounds(F.col("m_.scheduled")).alias("rounds"), F.col("m_.title").alias("title"),
    )


def low_confidence(red_prior: Column, blue_prior: Column) -> Column:
    """A side without a summary, or with fewer than FEWEST_PRIOR bouts before."""
    return F.coalesce((red_prior < FEWEST_PRIOR) | (blue_prior < FEWEST_PRIOR) | red_prior.isNull() | blue_prior.isNull(), F.lit(True))


def response(probability: Column, features: list[str], red_prior: Column, blue_prior: Column, context: Column) -> Column:
    """What is served, as JSON: both probabilities, the feature values in order (NULL ones too), the context and the flag."""
    values = F.struct(*[F.col(c) for c in features])
    body = F.struct((1 - probability).alias("blueProbability"), context.alias("context"), values.alias("featureValues"), low_confidence(red_prior, blue_prior).alias("lowConfidence"), probability.alias("redProbability"))
    return F.to_json(body, {"ignoreNullFields": "false"})


def rewrite_section(path: str, title: str, body: str) -> None:
    """Puts body under the heading of a report, in place of what stood there or behind all; twice gives the same file, and a reader
    sees the old file or the new one."""
    old = Path(path).read_text(encoding="utf-8") if Path(path).exists() else ""
    section = f"## {title}\n\n{body.strip()}\n"
    found = re.search(rf"(?ms)^## {re.escape(title)}\n.*?(?=^## |\Z)", old)
    new = old[: found.start()] + section + ("\n" if found.end() < len(old) else "") + old[found.end() :] if found else (old.rstrip("\n") + "\n\n" if old.strip() else "") + section
    temporary = Path(f"{path}.{uuid.uuid4().hex}")
    temporary.write_text(new, encoding="utf-8")
    temporary.replace(path)
