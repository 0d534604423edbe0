"""Training on small rows: the search over expanding folds, the three-class blend, the four variants, the report."""

import random

import pytest
from pyspark.sql import functions as F

from contestry.operators import metrics, models


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    out = []
    for i in range(600):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        out.append((i, f"2020-{1 + i // 60:02d}-01", a, b, int(a + 0.3 * r.gauss(0, 1) > 0), 0 if a > 0.7 else 1 if b > 0.3 else 2))
    return spark.createDataFrame(out, "id int, day string, a double, b double, y int, c int").cache()


def test_medians_are_those_of_percentile(spark, monkeypatch):
    """Odd and even counts, ties, NULLs, nothing known, and bounds that miss the middle; no exact aggregate holds a whole column."""
    r = random.Random(2)
    pick = lambda: (r.choice((None, r.gauss(0, 1))), float(r.randint(0, 2)), r.choice((None, None, r.random())), None, float(r.random() < 0.5))
    for n in (0, 1, 2, 9, 5001):
        rows = spark.createDataFrame([pick() for _ in range(n)], "a double, b double, c double, d double, e double")
        want = rows.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in rows.columns]).first().asDict()
        assert models.medians(rows, rows.columns) == want
    with monkeypatch.context() as m:
        m.setattr(F, "percentile", None)
        assert models.medians(rows, rows.columns) == want
    monkeypatch.setattr(models, "AROUND", -0.3)
    assert models.medians(rows, rows.columns) == want


def test_grid_has_all_settings():
    got = models.settings(models.GRID)
    assert len(got) == 108 and len({tuple(x.items()) for x in got}) == 108


def test_search_finds_what_tells(rows):
    got = models.search(rows.select("id", "day", "a", "b", "y"), ["a", "b"], ["day", "id"], 2, {"maxDepth": (1, 2), "maxIter": (3,)})
    assert len(got) == 2 and got[0][1] >= got[1][1] > 0.9


def test_method_blend(rows):
    train, test = rows.filter("id < 400").withColumn("y", rows["c"]), rows.filter("id >= 400").withColumn("y", rows["c"])
    classes = ["ko", "sub", "dec"]
    got = models.method_model(train, ["a", "b"], classes, {"maxDepth": 2, "maxIter": 5})(test)
    assert got.selectExpr("max(abs(p_ko + p_sub + p_dec - 1))").first()[0] < 1e-9
    by = {r["class"]: r for r in metrics.multiclass_metrics(got, classes).collect()}
    assert all(by[c]["auc"] > 0.85 for c in classes)


def test_variants_are_corner_symmetric(rows):
    train, hold, test = rows.filter("id < 300"), rows.filter("id >= 300 AND id < 450"), rows.filter("id >= 450")
    score = models.boosted(train, ["a", "b"], {"maxDepth": 2, "maxIter": 5})
    one = {r["id"]: r for r in models.variants(hold, test, "id", ["a", "b"], score, "sigmoid").collect()}
    two = {r["id"]: r for r in models.variants(hold, models.mirrored(test, ["a", "b"]), "id", ["a", "b"], score, "sigmoid").collect()}
    for i in one:
        assert one[i]["symmetrised"] + two[i]["symmetrised"] == pytest.approx(1)
        assert one[i]["symmetrised_calibrated"] + two[i]["symmetrised_calibrated"] == pytest.approx(1)
        assert 0 <= one[i]["raw"] <= 1 and 0 <= one[i]["raw_calibrated"] <= 1


def test_missing_differences_are_imputed_after_the_swap(rows):
    """A pairing and its mirror have probabilities that add up to 1, where a difference is missing too; the better calibration is taken."""
    gaps = rows.withColumn("b", F.when(F.col("id") % 3 > 0, F.col("b") + 2))
    impute = models.imputer(gaps.filter("id < 300"), ["a", "b"])
    trees = models.boosted(impute(gaps.filter("id < 300")).withColumn("y", F.when(F.col("b") > 1.5, F.col("y")).otherwise(1 - F.col("y"))), ["a", "b"], {"maxDepth": 2, "maxIter": 5})
    score = lambda df, name: trees(impute(df), name)
    hold, test = gaps.filter("id >= 300 AND id < 450"), gaps.filter("id >= 450")
    one = {r["id"]: r for r in models.variants(hold, test, "id", ["a", "b"], score).collect()}
    two = {r["id"]: r for r in models.variants(hold, models.mirrored(test, ["a", "b"]), "id", ["a", "b"], score).collect()}
    assert len(one) == 150
    for i in one:
        assert one[i]["symmetrised"] + two[i]["symmetrised"] == pytest.approx(1)
        assert one[i]["symmetrised_calibrated"] + two[i]["symmetrised_calibrated"] == pytest.approx(1)
    method = models.choose_calibration(score(hold, "p").select("id", "y", "p"), "id")[0]
    given = {r["id"]: r for r in models.variants(hold, test, "id", ["a", "b"], score, method).collect()}
    assert all(given[i]["raw_calibrated"] == pytest.approx(one[i]["raw_calibrated"]) for i in one)


def test_forms_stand_beside_both_baselines(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.2), (0, 0.4, 0.7), (1, 0.6, 0.6), (0, 0.1, 0.6)], "y int, good double, bad double")
    train = spark.createDataFrame([(1,), (1,), (0,), (0,), (0,)], "y int")
    got = {r["model"]: r for r in metrics.against_baselines(rows, ["good", "bad"], train).collect()}
    assert set(got) == {"good", "bad", "baseline", "majority"} and all(r["n"] == 4 for r in got.values())
    assert (got["good"]["auc"], got["good"]["accuracy"], got["good"]["brier"]) == (1.0, 1.0, pytest.approx((0.01 + 0.16 + 0.16 + 0.01) / 4))
    assert got["bad"]["auc"] == pytest.approx(0.125) and got["baseline"]["auc"] == got["majority"]["auc"] == 0.5
    assert (got["majority"]["accuracy"], got["majority"]["brier"], got["baseline"]["brier"]) == (0.5, 0.25, pytest.approx((2 * 0.36 + 2 * 0.16) / 4))


def test_report_section_is_replaced(tmp_path):
    path = str(tmp_path / "r.md")
    models.rewrite_section(path, "One", "a")
    models.rewrite_section(path, "Two", "b")
    models.rewrite_section(path, "One", "c")
    once = open(path).read()
    models.rewrite_section(path, "One", "c")
    assert open(path).read() == once == "## One\n\nc\n\n## Two\n\nb\n"
    assert [p.name for p in tmp_path.iterdir()] == ["r.md"]
