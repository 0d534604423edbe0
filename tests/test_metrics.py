"""Metrics on small cases: ranks of continuous scores."""

import random

from contestry.operators import metrics


def test_auc_ranks_in_ranges(spark):
    r = random.Random(4)
    rows = [(r.random() ** 9 if i % 3 else (i % 7) / 7, int(r.random() < 0.4)) for i in range(1500)]
    df = spark.createDataFrame(rows, "p double, y int")
    pos, neg = ([p for p, y in rows if y == k] for k in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.auc(df).first()["auc"] == round(want, 6)
    got = metrics.below(df.groupBy("p").agg({"y": "count"}).withColumnRenamed("count(y)", "n")).collect()
    assert {x["p"]: x["below"] for x in got} == {p: sum(q < p for q, _ in rows) for p, _ in rows}
    ranges = [x["range_"] for x in got]
    assert max(map(ranges.count, set(ranges))) < 0.05 * len(ranges)
    assert metrics.auc(df.limit(0)).first()["auc"] is None
