"""Each pipeline stage on nulls, empty texts, repeated ids, columns with clashing names and empty tables; op4 and op5 against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contestry.llm import quality_classifier, quality_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, places string, rest_ int, y int, n_words int, x0 double, id_ int, bucket int, component_id int, end int"
R = np.random.default_rng(3)


def prose(n, words=400):
    return " ".join(f"w{i}" for i in R.integers(0, words, n))


GOOD, SHARED = [prose(120) + "." for _ in range(60)], prose(60)
TEXTS = [None, "", *GOOD, "BUY NOW ### $$$ " * 30, f"{prose(80)} {SHARED} {prose(80)}", f"{prose(80)} {SHARED} {prose(80)}"]
EXTRA = ("en", "s", 7, "k", "p", 1, 2, 3, 4.0, 5, 6, 7, 8)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *EXTRA) for i, t in enumerate(TEXTS)] + [(2, GOOD[0], *EXTRA), (2, prose(100), *EXTRA), (None, GOOD[1], *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    bad = [(i, 0) for i in range(1000, 1040)]
    spark.createDataFrame([(i, 1) for i in range(2, 62)] + bad + [(5, None)], "doc_id bigint, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, GOOD[7]), (2, None), (3, "w1")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    (at / "none").mkdir()
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{at}/none/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{at}/none/benchmark.parquet")
    return f"{at}"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_takes_everything(spark, docs, folder, name, stage):
    got = stage(spark, docs, folder)
    if name != "tokens":
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        cells = got.drop("text", "n_chars").distinct().select("lang", "key", "places", "rest_", "y", "n_words", "x0", "id_", "bucket", "component_id", "end").distinct().collect()
        assert len(cells) <= 1
    rows = got.collect()
    ids = [r["doc_id"] for r in rows]
    if name == "near_duplicates":
        # Of the rows of one id the smallest by their other columns stays; null and empty texts are copies; a null id stays.
        repeated = [r["text"] for r in docs.filter("doc_id = 2").collect()]
        assert len(repeated) == 3 and [r["text"] for r in rows if r["doc_id"] == 2] == [min(repeated)]
        assert None in ids and 0 in ids and 1 not in ids
    elif name == "substrings":
        assert len(rows) == docs.count()
        by = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] not in (2, None)}
        assert SHARED not in by[len(TEXTS) - 1] and SHARED not in by[len(TEXTS) - 2] and by[0] is None and by[1] == "" and by[5] == TEXTS[5]
    elif name == "decontamination":
        assert 9 not in ids and len(rows) == docs.count() - 1
    elif name == "tokens":
        assert len(rows) == docs.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    nothing = docs.limit(0)
    assert stage(spark, nothing, folder).count() == 0
    assert stage(spark, docs, f"{folder}/none").count() <= docs.count()


def test_discriminant_is_the_formula(spark):
    names = list(quality_classifier.FEATURES)
    d = len(names)
    x = R.normal(size=(80, d)) + np.repeat([[0.0], [1.0]], 40, axis=0)
    y = np.repeat([0, 1], 40)
    rows = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(y, x, strict=True)], "y int, " + ", ".join(f"{n} double" for n in names))
    model = quality_classifier.fit(rows)
    got = [r["s"] for r in rows.select(*names, model.score().alias("s")).collect()]
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (cov[0] + cov[1]) / 2
    logs = []
    for c in (0, 1):
        s = 0.9 * cov[c] + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.diag(np.diag(pooled) + 1e-4)
        z = x - x[y == c].mean(axis=0)
        logs.append(math.log(0.5) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    want = 1 / (1 + np.exp(-(logs[1] - logs[0])))
    assert np.allclose(sorted(got), sorted(want), atol=1e-9)


def test_base_rules_by_hand(spark, tmp_path):
    texts = ["w " * 19, " ".join(f"a{i}" for i in range(20)), "same eight words in a row and on " * 6, None, "", " ".join(f"b{i}" for i in range(40))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_rules.op4_quality_rules(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        again = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        assert got[i]["base_failed"] == failed and (not failed or not got[i]["kept"])
