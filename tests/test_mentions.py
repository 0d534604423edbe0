"""Mentions against a search for every name in every text, in one block and in many."""

import random
import re

import pytest

from contestry.operators.mentions import mentions


def key(t):
    return re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()


@pytest.mark.parametrize("letters", [4_000_000, 12])
def test_mentions(spark, letters):
    r = random.Random(6)
    words = ["ana", "an", "lee", "leeds", "o'neil", "ST-PIERRE", "é", "b", "22"]
    people = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 2)))) for i in range(60)] + [(60, None), (61, "?"), (None, "ana"), (5, "ana")]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(50)] + [(50, None), (51, "banana leeds"), (52, "ana " * 50_000)]
    got = {x["id"]: x["names"] for x in mentions(spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame(people, "id bigint, name string"), letters=letters).collect()}
    known = sorted((i, n) for i, n in people if i is not None and key(n))
    want = {i: found for i, t in texts if (found := [n for _, n in known if key(n) in key(t)][:4])}
    assert got == want and 51 in got
    assert mentions(spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame([], "id bigint, name string")).count() == 0
