"""Isotonic calibration by pooled blocks that merge: scores are cut into ranges, each range pools its own, and neighbours' blocks are pooled again.

Pooling adjacent violators gives the same blocks however a sequence is first cut, so no task sees more than a few ranges until
few blocks are left. Blocks are whole numbers (rows, and rows of class 1), so means are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.sources.staged import staged

#: Scores are rounded to PLACES, so a model has 10**PLACES + 1 steps at most. Ranges of scores, and how many neighbours are pooled in a round.
PLACES, RANGES, NEIGHBOURS = 6, 256, 8
BLOCKS = "range bigint, lo double, hi double, ones bigint, n bigint"


def pooled(lo: list[float], hi: list[float], ones: list[int], n: list[int]) -> list[tuple[float, float, int, int]]:
    """Blocks in ascending order of scores, whose means don't fall."""
    out: list[tuple[float, float, int, int]] = []
    for a, b, s, m in zip(lo, hi, ones, n, strict=True):
        while out and out[-1][2] * m >= s * out[-1][3]:  # equal means are one block
            a, _, s0, m0 = out.pop()
            s, m = s + s0, m + m0
        out.append((a, b, s, m))
    return out


def pool(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("lo")
    got = pooled(*[rows.column(c).to_pylist() for c in ("lo", "hi", "ones", "n")])
    columns = list(zip(*got, strict=True))
    return pa.table({"range": pa.array([key[0].as_py()] * len(got), pa.int64()), **{c: pa.array(columns[i], pa.float64() if i < 2 else pa.int64()) for i, c in enumerate(("lo", "hi", "ones", "n"))}})


def fit(rows: DataFrame) -> DataFrame:
    """lo, hi, ones and n of the blocks of rows (p between 0 and 1, y 0 or 1); rows without p or y count for nothing."""
    known = rows.filter(F.col("p").isNotNull() & F.col("y").isNotNull()).select(F.round("p", PLACES).alias("p"), F.col("y").cast("bigint").alias("y"))
    ties = known.groupBy("p").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
    now = ties.select(F.floor(F.col("p") * RANGES).alias("range"), F.col("p").alias("lo"), F.col("p").alias("hi"), "ones", "n")
    width = 1
    while True:
        now = staged(now.withColumn("range", F.floor(F.col("range") / F.lit(NEIGHBOURS if width > 1 else 1))).groupBy("range").applyInArrow(pool, BLOCKS), "blocks")
        width *= NEIGHBOURS
        if width > RANGES * NEIGHBOURS * NEIGHBOURS:
            return now.drop("range")


def calibrated(rows: DataFrame, blocks: DataFrame, name: str = "calibrated") -> DataFrame:
    """rows with the value at p: a block's mean within it, a straight line between blocks, the ends' values beyond them; NULL for NULL or without blocks.

    The blocks, 10**PLACES + 1 at most, go to every task.
    """
    steps = blocks.orderBy("lo").toPandas()
    x = np.stack([steps["lo"], steps["hi"]], axis=1).ravel() if len(steps) else np.zeros(0)
    v = np.repeat(steps["ones"].to_numpy() / np.maximum(steps["n"].to_numpy(), 1), 2) if len(steps) else np.zeros(0)
    shared = rows.sparkSession.sparkContext.broadcast((x, v))
    columns, kinds = rows.columns, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value = shared.value
        for b in batches:
            p = b.column(columns.index("p")).cast(pa.float64())
            got = np.interp(p.fill_null(0.0).to_numpy(zero_copy_only=False), at, value) if len(at) else np.zeros(b.num_rows)
            missing = np.asarray(p.is_null()) | (len(at) == 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64(), mask=missing)], [*columns, name])

    return rows.mapInArrow(run, f"{kinds}, `{name}` double")
