"""Live sample series: what changes is kept, a reading belongs to the state before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_samples(samples: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """Samples that differ from the one before them of the same key, null-safely; the first always stays."""
    w = Window.partitionBy(key).orderBy(*order)
    return samples.withColumns({"b_": F.lag(F.struct(*value)).over(w), "i_": F.row_number().over(w)}).filter((F.col("i_") == 1) | ~F.col("b_").eqNullSafe(F.struct(*value))).drop("b_", "i_")


def as_of(readings: DataFrame, states: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """readings with the value of the last state of their key at or before them: a union and one running frame, no range join."""
    both = readings.select(key, ts, F.lit(1).alias("r_"), F.struct(*readings.columns).alias("row_"), F.lit(None).cast(states.schema[value].dataType).alias("v_")).unionByName(
        states.select(key, ts, F.lit(0).alias("r_"), F.lit(None).cast(readings.select(F.struct(*readings.columns)).schema[0].dataType).alias("row_"), F.col(value).alias("v_"))
    )
    w = Window.partitionBy(key).orderBy(ts, "r_").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("v_", F.last("v_", ignorenulls=True).over(w)).filter("r_ = 1").select("row_.*", F.col("v_").alias(value))
