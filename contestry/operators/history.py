"""Rows in order of time: their places, chronological splits and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with at_, their place from 1 in the total order: a count for each value of its first column, then places within one."""
    first = order[0]
    days = rows.groupBy(F.col(first).alias("day_")).agg(F.count("*").alias("n_"))
    before = days.withColumn("before_", F.sum("n_").over(Window.orderBy("day_")) - F.col("n_")).drop("n_")
    return rows.withColumn("i_", F.row_number().over(Window.partitionBy(first).orderBy(*order))).join(before, F.col(first).eqNullSafe(F.col("day_"))).withColumn("at_", F.col("before_") + F.col("i_")).drop("before_", "i_", "day_")


def chronological_split(rows: DataFrame, order: list[str], test: float = 0.2, least_test: int = 40, calibration: float = 0.2) -> DataFrame:
    """rows with split: the first part train, then calibration, then test, by position."""
    n = rows.count()
    edge = min(max(int(n * (1 - test)), least_test), max(n - 1, 0))
    first = int(edge * (1 - calibration))
    return positions(rows, order).withColumn("split", F.when(F.col("at_") <= first, "train").when(F.col("at_") <= edge, "calibration").otherwise("test")).drop("at_")


def walk_forward(rows: DataFrame, order: list[str], folds: int) -> DataFrame:
    """rows once for each fold they take part in: with folds + 1 equal blocks, fold k trains on blocks up to k and validates on the next."""
    n = rows.count()
    edges = [n * k // (folds + 1) for k in range(folds + 2)]
    block = sum((F.when(F.col("at_") > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(1))
    each = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda k: k >= F.col("block_") - 1)
    return positions(rows, order).withColumn("block_", block).withColumn("fold", F.explode(each)).withColumn("role", F.when(F.col("block_") <= F.col("fold"), "train").otherwise("validate")).drop("at_", "block_")
