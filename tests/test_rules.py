"""Rules that have no query of their own: thin runs prune nothing, guarded names, values that are overwritten, old rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from contestry.operators import entity, merge

NOW = dt.datetime(2026, 1, 10, 12)


def test_a_thin_run_prunes_nothing(spark):
    rows = spark.createDataFrame([(1, NOW), (2, NOW - dt.timedelta(hours=3)), (3, NOW + dt.timedelta(minutes=1)), (4, None)], "id int, updated_at timestamp")
    start = F.lit(NOW)
    assert {r["id"] for r in merge.pruned(rows, start, 100).collect()} == {1, 3}
    assert {r["id"] for r in merge.pruned(rows, start, 99).collect()} == {1, 2, 3, 4}
    assert {r["id"] for r in merge.pruned(rows, start, 5, least=5).collect()} == {1, 3}
    assert {r["id"] for r in merge.younger_than(rows, start, 2).collect()} == {1, 3}


def test_the_guard_compares_first_words_and_lengths(spark):
    names = spark.createDataFrame([("Jonathan Martinez",), ("Jonatan Martinez",), ("Rafael dos Anjos",), ("Rafael dos Anjoss",), ("X",)], "name string")
    known = spark.createDataFrame([(1, "Jonathan Martinez"), (2, "Rafael dos Anjos")], "id int, name string")
    loose = {r["name"]: (r["id"], r["tier"]) for r in entity.tiered_match(names, known, "name", "id", 0.9).collect()}
    tight = {r["name"]: (r["id"], r["tier"]) for r in entity.tiered_match(names, known, "name", "id", 0.9, guarded=True).collect()}
    assert loose == {"Jonathan Martinez": (1, "exact"), "Jonatan Martinez": (1, "similar"), "Rafael dos Anjos": (2, "exact"), "Rafael dos Anjoss": (2, "similar")}
    assert tight == {k: v for k, v in loose.items() if k != "Jonatan Martinez"}


@pytest.mark.parametrize(("rule", "want"), [("incoming", [None, 5.5, 9.0]), ("incoming_unless_null", [1.5, 5.5, 9.0]), ("first_writer", [1.5, 2.5, 9.0]), ("new_wins_if_present", [1.5, 5.5, 9.0]), ("stored_wins", [1.5, 2.5, 9.0]), ("monotonic", [1.5, 5.5, 9.0])])
def test_rules_keep_types(spark, rule, want):
    stored = spark.createDataFrame([(1, 1.5), (2, 2.5), (3, None), (4, 7.0)], "k int, x double")
    incoming = spark.createDataFrame([(1, None), (2, 5.5), (3, 9.0), (5, 1.0)], "k int, x double")
    got = merge.merge_upsert(stored, incoming, ["k"], {"x": rule})
    assert dict(got.dtypes)["x"] == "double"
    rows = {r["k"]: (r["x"], r["change"]) for r in got.collect()}
    assert [rows[k][0] for k in (1, 2, 3)] == want and rows[4] == (7.0, "keep") and rows[5] == (1.0, "insert")


def test_maps_merge_key_by_key(spark):
    kinds = "k int, m map<string,struct<a:int>>"
    stored = spark.createDataFrame([(1, {"x": (1,), "y": (2,)}), (2, None), (3, {"x": (1,)}), (4, None)], kinds)
    incoming = spark.createDataFrame([(1, {"y": (5,), "z": (6,)}), (2, {"x": (9,)}), (3, None), (4, None)], kinds)
    got = {r["k"]: r["m"] and {k: v["a"] for k, v in r["m"].items()} for r in merge.merge_upsert(stored, incoming, ["k"], {"m": "key_merge"}).collect()}
    assert got == {1: {"x": 1, "y": 5, "z": 6}, 2: {"x": 9}, 3: {"x": 1}, 4: None}
