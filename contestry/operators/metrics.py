"""Evaluation of scored outcomes as SQL aggregates: rows have p (probability) and y (0 or 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_metrics(rows: DataFrame, by: str) -> DataFrame:
    """Accuracy, Brier score and observed rate by segment; a missing segment is 'Unknown'."""
    return rows.groupBy(F.coalesce(F.col(by), F.lit("Unknown")).alias("segment")).agg(
        F.count("*").alias("n"),
        F.round(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")), 6).alias("accuracy"),
        F.round(F.avg((F.col("p") - F.col("y")) ** 2), 6).alias("brier"),
        F.round(F.avg("y"), 6).alias("observed"),
    )


def bin_of(p: Column, bins: int) -> Column:
    """The equal bin [a, b) of p, the last one closed, by comparison with the same doubles that split 0 to 1 into bins."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return sum((F.when(p >= e, 1).otherwise(0) for e in edges), F.lit(0))


def calibration_table(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins [a, b) of p, empty ones too."""
    spark = rows.sparkSession
    got = rows.groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("observed"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").na.fill(0, ["n"])


def log_loss(p: Column, y: Column) -> Column:
    """Of one row; p is kept off 0 and 1."""
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def binary_metrics(rows: DataFrame) -> DataFrame:
    """One row: n, accuracy, brier, log_loss, the confusion counts, precision, recall and f1 at 0.5 (NULL: nothing to divide by)."""
    hit = (F.col("p") >= 0.5).cast("int")
    counts = {k: F.count_if((hit == a) & (F.col("y") == b)) for k, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))}
    got = rows.agg(F.count("*").alias("n"), *[c.alias(k) for k, c in counts.items()], F.avg((F.col("p") - F.col("y")) ** 2).alias("b"), F.avg(log_loss(F.col("p"), F.col("y"))).alias("l"))
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return got.select("n", "tp", "fp", "fn", "tn", F.round(share(tp + F.col("tn"), F.col("n")), 6).alias("accuracy"), F.round("b", 6).alias("brier"), F.round("l", 6).alias("log_loss"),
        F.round(share(tp, tp + fp), 6).alias("precision"), F.round(share(tp, tp + fn), 6).alias("recall"), F.round(share(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def multiclass_metrics(rows: DataFrame, classes: list[str]) -> DataFrame:
    """class, n, hits, log_loss (of the class's own rows) and auc (one against the rest) of rows with y (a class's number) and a
    probability p_<class> each. The first of the highest probabilities is the prediction."""
    p = F.array(*[F.col(f"p_{c}") for c in classes])
    guess = F.array_position(p, F.array_max(p)).cast("int") - 1
    each = rows.select("y", guess.alias("g"), *[f"p_{c}" for c in classes])
    out = None
    for i, c in enumerate(classes):
        own = each.filter(F.col("y") == i).agg(F.lit(c).alias("class"), F.count("*").alias("n"), F.count_if(F.col("g") == i).alias("hits"), F.round(F.avg(log_loss(F.col(f"p_{c}"), F.lit(1))), 6).alias("log_loss"))
        against = auc(each.select(F.col(f"p_{c}").alias("p"), (F.col("y") == i).cast("int").alias("y"))).select("auc")
        one = own.crossJoin(against)  # one row by one row
        out = one if out is None else out.unionByName(one)
    return out


def baselines(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: the majority class of train's y (ties: the smaller), its accuracy on test, the Brier score of a constant half and
    the log-loss of train's rate of ones as a constant."""
    t = train.agg(F.mode("y", True).alias("majority"), F.avg("y").alias("rate"))
    hit = (F.col("y") == F.col("majority")).cast("int")
    return test.select("y").crossJoin(F.broadcast(t)).groupBy("majority").agg(  # t is one row
        F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg((F.lit(0.5) - F.col("y")) ** 2), 6).alias("brier_half"), F.round(F.avg(log_loss(F.col("rate"), F.col("y"))), 6).alias("prior_log_loss"))


def against_baselines(rows: DataFrame, forms: list[str], train: DataFrame) -> DataFrame:
    """model, n, accuracy, log_loss, brier and auc of each form (a column of rows with a probability) and of two constants: baseline, the rate of ones of
    train's y, and majority, whose accuracy is that of train's majority class (ties: the smaller) and whose probability is a half."""
    t = train.agg(F.mode("y", True).alias("majority"), F.avg("y").alias("rate")).first()
    hit = lambda p: (p >= 0.5).cast("int")
    told = [(f, F.col(f), hit(F.col(f))) for f in forms] + [("baseline", F.lit(t["rate"]), hit(F.lit(t["rate"]))), ("majority", F.lit(0.5), F.lit(t["majority"]))]
    out = None
    for name, p, guess in told:
        each = rows.select("y", p.cast("double").alias("p"), guess.alias("g"))
        own = each.agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.avg((F.col("g") == F.col("y")).cast("int")).alias("accuracy"), F.avg(log_loss(F.col("p"), F.col("y"))).alias("log_loss"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
        one = own.crossJoin(auc(each.select("p", "y")).select("auc"))  # one row by one row
        out = one if out is None else out.unionByName(one)
    return out


def below(ties: DataFrame, buckets: int = 256) -> DataFrame:
    """ties (distinct p, n) with below, the sum of n of smaller p: ranks within ranges of p, plus the sums of the ranges before."""
    edges = sorted(set(ties.approxQuantile("p", [k / buckets for k in range(1, buckets)], 0.1 / buckets)))
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("p"))) if edges else F.lit(0)
    dealt = ties.withColumn("range_", at)
    sums = dealt.groupBy("range_").agg(F.sum("n").alias("all_"))
    before = sums.select("range_", (F.sum("all_").over(Window.orderBy("range_")) - F.col("all_")).alias("before_"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("range_").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("own_", own).join(F.broadcast(before), "range_").withColumn("below", F.col("before_") + F.col("own_")).drop("own_", "before_")


def auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve by the rank sum with mid-ranks; scores are grouped before they are ranked."""
    ties = rows.groupBy("p").agg(F.sum("y").cast("bigint").alias("pos"), F.count("*").alias("n"))
    ranked = below(ties).withColumn("mid", F.col("below") + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum(F.col("pos") * F.col("mid")).alias("r"), F.sum("pos").alias("a"), F.sum(F.col("n") - F.col("pos")).alias("b"))
    return s.select(F.round(F.try_divide(F.col("r") - F.col("a") * (F.col("a") + 1) / 2, (F.col("a") * F.col("b")).cast("double")), 6).alias("auc"), F.col("a").alias("positives"), F.col("b").alias("negatives"))
