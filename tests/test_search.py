"""Attributions against all subsets of features, trigram search against all pairs, summaries on any day against those of bouts."""

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestry.operators import attributions, career, models, trigrams
from contestry.sources.proxy import full_bouts

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    r = random.Random(4)
    names = [f"f{i}" for i in range(6)]
    rows = [(i, *(x := [r.gauss(0, 1) for _ in names]), int(x[0] * x[1] + x[2] > 0.2 * r.gauss(0, 1))) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names) + ", y int").cache()
    return df, names, models.fitted(df, names, {"maxDepth": 4, "maxIter": 6})


def known_only(trees, x, known):
    """The log-odds with the features in known; a leaf's share stands for the others."""
    return sum(t.value * np.prod([(lo < x[f] <= hi) if f in known else z for f, lo, hi, z in zip(t.features, t.low, t.high, t.share)]) for t in trees)


def test_parts_are_shapley_values(spark, fitted):
    df, names, model = fitted
    trees = attributions.leaves(model, spark)
    rows = df.limit(12).collect()
    x = np.array([[r[c] for c in names] for r in rows])
    got = attributions.parts(trees, x)
    n = len(names)
    for i in range(len(rows)):
        value = {s: known_only(trees, x[i], s) for k in range(n + 1) for s in combinations(range(n), k)}
        for f in range(n):
            want = sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (value[tuple(sorted((*s, f)))] - value[s]) for s in value if f not in s)
            assert got[i, f] == pytest.approx(want, abs=1e-9)
    told = models.with_vector(df, names)
    margins = {r["id"]: r["rawPrediction"][1] * 2 for r in model.transform(told).collect()}
    summed = attributions.attributed(df.select("id", *names), names, trees).collect()
    assert max(abs(attributions.base(trees) + sum(r["parts"]) - margins[r["id"]]) for r in summed) < 1e-9


def test_symmetrised_parts(spark, fitted):
    df, names, model = fitted
    trees = attributions.leaves(model, spark)
    some = df.limit(40).cache()
    one = {r["id"]: r["parts"] for r in attributions.symmetrised_parts(some, "id", names, trees).collect()}
    two = {r["id"]: r["parts"] for r in attributions.symmetrised_parts(models.mirrored(some, names), "id", names, trees).collect()}
    assert all(a == pytest.approx(-b) for i in one for a, b in zip(one[i], two[i]))
    top = attributions.top_features(attributions.symmetrised_parts(some, "id", names, trees), "id", names).collect()
    assert len(top) == 5 * len(one)
    for r in top:
        assert r["contribution"] == one[r["id"]][names.index(r["name"])] and r["direction"] == ("red" if r["contribution"] >= 0 else "blue")
        assert sorted(map(abs, one[r["id"]]), reverse=True)[r["rank"] - 1] == abs(r["contribution"])
    assert attributions.symmetrised_parts(df.limit(0), "id", names, trees).count() == 0


def grams(t):
    return {p[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() for p in [f"  {w} "] for i in range(len(p) - 2)}


@pytest.mark.parametrize("postings", [20_000, 3])
def test_trigram_search(spark, postings):
    r = random.Random(9)
    words = ["ana", "anna", "hanna", "joe", "joes", "smith", "smyth", "de la cruz", "o'neil", "li"]
    names = [" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(150)] + [None, "", "?!", "x", "Ana ANA", "ana"]
    known = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    asked = known.filter("id % 4 = 0 OR id > 148").withColumnRenamed("id", "q")
    for least in (0.3, 0.55, 1.0):
        want = {}
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                if (i % 4 == 0 or i > 148) and a and b and (x := grams(a)) and (y := grams(b)) and len(x & y) / len(x | y) >= least:
                    want[i, j] = len(x & y) / len(x | y)
        got = trigrams.similar_names(asked, known, "q", "id", least=least, postings=postings).collect()
        assert {(g["q"], g["id"]): g["similarity"] for g in got} == pytest.approx(want) and len(got) == len(want)
    accents = spark.createDataFrame([(1, "José Núñez")], "id int, name string")
    plain = spark.createDataFrame([(2, "JOSE NUNEZ")], "q int, name string")
    assert trigrams.similar_names(plain, accents, "q", "id").first()["similarity"] == 1.0


def test_both_drivers_agree(spark):
    """Asked for on a bout's own day, the summary is the bout's."""
    bouts = full_bouts(spark, D).cache()
    own = career.summaries(bouts)
    asked = own.select("bout_id", "event_date", "side", "fighter_id", "opponent_id")
    free = career.summaries_at(bouts, asked)
    keys = ["bout_id", "side", "fighter_id", "event_date", "has_summary", *career.FIELDS]
    assert own.count() == free.count()
    assert own.select(*keys).exceptAll(free.select(*keys)).count() == 0
    # Many may ask on one day, participants without a bout too, and they change nothing for each other.
    more = asked.unionByName(asked).withColumn("bout_id", F.col("bout_id") + 10_000_000).unionByName(asked).unionByName(asked.limit(1).withColumns({"fighter_id": F.lit(-1).cast("bigint"), "bout_id": F.lit(-1).cast("bigint")}))
    crowd = career.summaries_at(bouts, more)
    assert own.select(*keys).exceptAll(crowd.filter("bout_id < 10000000").select(*keys)).count() == 0
    alone = crowd.filter("bout_id = -1").first()
    assert not alone["has_summary"] and alone["n_prior"] is None
