"""Plans that are applied or refused, and merges over tables with chains, collisions and circles."""

import uuid

import pytest
from pyspark.sql import functions as F

from contestry.operators import applying, merging


@pytest.fixture
def stored(spark):
    name = f"t_{uuid.uuid4().hex}"
    applying.create(spark.createDataFrame([(i, f"v{i}", None if i % 3 else float(i)) for i in range(100)], "k bigint, v string, x double"), name, "k", 8)
    yield name
    spark.sql(f"DROP TABLE {name}")


def held(spark, name):
    return sorted(tuple(r) for r in applying.stored(spark, name).collect())


def test_dry_run_and_apply_agree(spark, stored):
    before = held(spark, stored)
    new = applying.stored(spark, stored).filter("k < 90").withColumn("x", F.when(F.col("k") == 7, 1.5).when(F.col("k") == 9, None).otherwise(F.col("x")))
    new = new.unionByName(spark.createDataFrame([(1000, None, None)], new.schema))
    plan = applying.planned(spark, stored, new, "k", 8)
    assert plan.summary() == {"insert": 1, "delete": 10, "update": 2} and held(spark, stored) == before
    want = sorted(tuple(r) for r in new.collect())
    assert applying.apply(spark, plan) == plan.summary() and held(spark, stored) == want
    again = applying.planned(spark, stored, applying.stored(spark, stored), "k", 8)
    assert again.summary() == {} and applying.apply(spark, again) == {} and held(spark, stored) == want


def test_conflicts_are_refused(spark, stored):
    plan = applying.planned(spark, stored, applying.stored(spark, stored).withColumn("v", F.when(F.col("k") == 5, "mine").otherwise(F.col("v"))), "k", 8)
    other = applying.planned(spark, stored, applying.stored(spark, stored).withColumn("v", F.when(F.col("k") == 5, "theirs").otherwise(F.col("v"))), "k", 8)
    applying.apply(spark, other)
    now = held(spark, stored)
    with pytest.raises(applying.Conflict):
        applying.apply(spark, plan)
    assert held(spark, stored) == now and (5, "theirs", None) in now


def test_a_failed_apply_leaves_the_table(spark, stored):
    before = held(spark, stored)
    bad = applying.stored(spark, stored).withColumn("v", F.when(F.col("k") == 5, "x").otherwise(F.col("v")))
    plan = applying.planned(spark, stored, bad, "k", 8)
    broken = applying.Plan(plan.table, plan.key, plan.buckets, plan.rows.withColumn("v", F.when(F.col("k") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))), plan.changes, plan.version)
    with pytest.raises(Exception, match="lost"):
        applying.apply(spark, broken)
    assert held(spark, stored) == before
    assert applying.apply(spark, plan) == {"update": 1}
    assert applying.apply(spark, applying.planned(spark, stored, bad.limit(0), "k", 8)) == {"delete": 100} and held(spark, stored) == []


def test_chains_are_contracted_and_circles_refused(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 40), (200, 201)]
    got = merging.contracted(spark.createDataFrame(links, "loser int, keeper int"))
    assert {r["loser"]: r["keeper"] for r in got.collect()} == {**{i: 40 for i in range(1, 40)}, 100: 40, 200: 201}
    for circle in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1), (7, 8)], [(5, 5)]):
        with pytest.raises(ValueError, match="circle"):
            merging.contracted(spark.createDataFrame(circle, "loser int, keeper int"))
    assert merging.contracted(spark.createDataFrame([], "loser int, keeper int")).count() == 0


def test_merge_over_tables(spark):
    people = spark.createDataFrame([(1, None, "a"), (2, "x", None), (3, None, "c"), (4, "y", "d")], "id int, nick string, town string")
    bouts = spark.createDataFrame([(10, 1, 4, "d1"), (11, 2, 4, "d1"), (12, 3, 4, "d1"), (13, 2, 4, None), (14, 1, 4, None), (15, 4, 1, "d2"), (16, 4, 4, "d9"), (17, 4, 4, "d9")], "bout int, red int, blue int, day string")
    stats = spark.createDataFrame([(100, 10), (101, 11), (102, 12), (103, 12), (104, None)], "stat int, bout int")
    registry = [merging.Reference("bouts", "red", "people", "bout", ("red", "blue", "day")), merging.Reference("bouts", "blue", "people", "bout", ("red", "blue", "day")), merging.Reference("stats", "bout", "bouts", "stat", ("bout",))]
    assert merging.order_of(registry, "people") == ["bouts", "stats"]
    merged = spark.createDataFrame([(1, 2), (2, 3)], "loser int, keeper int")
    got = {t: sorted(tuple(r) for r in df.collect()) for t, df in merging.merged_everywhere({"people": people, "bouts": bouts, "stats": stats}, "people", "id", merged, registry).items()}
    assert got["people"] == [(3, "x", "c"), (4, "y", "d")]
    # 12 is the keeper's own bout and stays; 10 and 11 moved onto it. Unknown days collide with nothing, rows that didn't move never go.
    assert [b[0] for b in got["bouts"]] == [12, 13, 14, 15, 16, 17] and all(b[1] in (3, 4) and b[2] in (3, 4) for b in got["bouts"])
    assert got["stats"] == [(102, 12), (103, 12), (104, None)]
    with pytest.raises(ValueError, match="circle"):
        merging.order_of([merging.Reference("a", "x", "r", "k"), merging.Reference("a", "y", "b", "k"), merging.Reference("b", "z", "a", "k")], "r")
