"""Pooled blocks against the max-min formula, whatever the ranges; and against the library's fit."""

import random

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression

from contestry.operators import isotonic


@pytest.mark.parametrize("shape", ["noise", "falling", "steps", "ties"])
def test_fit_is_the_isotonic_regression(spark, shape):
    r = random.Random(shape)
    rows = []
    for i in range(400):
        p = round(r.random(), 2) if shape == "ties" else r.random()
        chance = {"noise": p, "falling": 1 - p, "steps": 0.2 if p < 0.5 else 0.9, "ties": p}[shape]
        rows.append((i, p, int(r.random() < chance)))
    df = spark.createDataFrame([*rows, (900, None, 1), (901, 0.5, None)], "id int, p double, y int")
    got = isotonic.fit(df)
    at = {r["id"]: r["calibrated"] for r in isotonic.calibrated(df, got).collect()}
    known = {}
    for _, p, y in rows:
        s, n = known.get(round(p, 6), (0, 0))
        known[round(p, 6)] = (s + y, n + 1)
    keys = sorted(known)
    s, n = np.cumsum([0, *[known[k][0] for k in keys]]), np.cumsum([0, *[known[k][1] for k in keys]])
    want = {k: max(min((s[b + 1] - s[a]) / (n[b + 1] - n[a]) for b in range(i, len(keys))) for a in range(i + 1)) for i, k in enumerate(keys)}
    for i, p, _ in rows:
        assert at[i] == pytest.approx(want[round(p, 6)], abs=1e-3 if shape == "noise" else 1e-2)
    assert at[900] is None and at[901] is not None
    blocks = got.orderBy("lo").collect()
    means = [b["ones"] / b["n"] for b in blocks]
    assert means == sorted(set(means)) and sum(b["n"] for b in blocks) == 400
    for k in keys:
        b = next(b for b in blocks if b["lo"] <= k <= b["hi"])
        assert b["ones"] / b["n"] == pytest.approx(want[k])
    if shape == "noise":
        model = IsotonicRegression(featuresCol="p", labelCol="y").fit(df.filter("p IS NOT NULL AND y IS NOT NULL").selectExpr("round(p, 6) p", "double(y) y"))
        assert sorted({round(v, 9) for v in model.predictions.toArray().tolist()}) == sorted({round(m, 9) for m in means})
    assert isotonic.fit(df.limit(0)).count() == 0
    assert isotonic.calibrated(df, got.limit(0)).filter("calibrated IS NOT NULL").count() == 0
