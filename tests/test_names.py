"""Tiered matching and calibration, which have no SQL twin, on small cases."""

from difflib import SequenceMatcher

from contestry.functions.text import similarity
from contestry.operators import entity, models


def test_tiers(spark):
    known = spark.createDataFrame([(1, "Ana María Souza"), (2, "Bo Lee"), (3, "bo lee"), (4, "Jean-Paul Ferreira")], "id int, name string")
    asked = spark.createDataFrame([("ana maría souza",), ("Ana Maria Souza",), ("Ana Maria Sousa",), ("Bo Lee",), ("Jean Paul Ferreira",), (None,), ("",)], "asked string")
    got = {r["asked"]: (r["id"], r["tier"]) for r in entity.tiered_match(asked, known, "asked", "id").collect()}
    assert got == {"ana maría souza": (1, "exact"), "Ana Maria Souza": (1, "folded"), "Ana Maria Sousa": (1, "similar"), "Jean Paul Ferreira": (4, "folded")}


def test_similar_tier_is_all_pairs(spark):
    """Against every pair of names: slips at any place, missing and extra words, keys owned by two, short names."""
    import random

    r = random.Random(3)
    words = ["silva", "souza", "pereira", "jones", "lee", "van", "dos", "anjos", "almeida", "kovac"]
    known = [(i, " ".join(r.sample(words, r.randint(1, 4)))) for i in range(150)] + [(900, "twice owned name"), (901, "twice owned name")]
    asked = {"twice ownd name", "x", ""}
    for _, name in known:
        at = r.randrange(len(name))
        asked |= {name[:at] + name[at + 1 :], name[:at] + "q" + name[at:], name + " jr"}
    owners = {}
    for i, name in known:
        owners.setdefault(name, set()).add(i)
    once = {name: min(ids) for name, ids in owners.items() if len(ids) == 1}
    fold = lambda x: " ".join(x.split())
    want = {}
    for a in asked:
        if fold(a) in once:
            want[a] = once[fold(a)]
        elif fold(a):
            best = max(((SequenceMatcher(None, fold(a), name).ratio(), -i) for name, i in once.items()), default=(0, 0))
            if best[0] >= 0.92:
                want[a] = -best[1]
    rows = entity.tiered_match(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame(known, "id int, name string"), "asked", "id").collect()
    assert {r["asked"]: r["id"] for r in rows} == want and len(rows) == len(want)


def test_similarity(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("xy", "yx"), (None, "a")]
    got = [r["s"] for r in spark.createDataFrame(pairs, "a string, b string").select(similarity("a", "b").alias("s")).collect()]
    assert got == [None if a is None else SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_calibration_helps(spark):
    rows = spark.createDataFrame([(i, (i % 100) / 100, int((i * 37 % 100) < (i % 100) ** 2 / 100)) for i in range(2000)], "id int, p double, y int")
    method, loss = models.choose_calibration(rows, "id", 3)
    raw = rows.selectExpr("avg(pow(p - y, 2))").first()[0]
    assert loss[method] == min(loss.values()) < raw
