"""Rows that a lookup meets grow with its input, not with its square; ages count fractions of a second."""

import datetime as dt
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from contestry.operators import entity, lookups, quality, trigrams


def joined_rows(df, spark):
    """Rows that the plan's joins gave, as it ran."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if p.nodeName().endswith("QueryStage"):
            return walk(p.plan())
        if "Join" in p.nodeName():
            out.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(out)


def broadcast_rows(df):
    """Rows of the largest table that the plan sent to every task, as it ran."""
    df.collect()
    out = [0]

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if p.nodeName().endswith("QueryStage"):
            return walk(p.plan())
        if p.nodeName().startswith("BroadcastExchange"):
            out.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return max(out)


def test_verdicts_count_fractions_of_a_second(spark):
    now = dt.datetime(2024, 1, 3, 0, 0, 0, 900_000)
    rows = [(k, 1, now - dt.timedelta(seconds=86401, microseconds=us) if i else now - dt.timedelta(days=9)) for k, us in ((1, 800_000), (2, 0), (3, 1)) for i in (0, 1)]
    samples = spark.createDataFrame(rows, "k int, period int, ts timestamp_ntz")
    at = F.lit("2024-01-03 00:00:00.9").cast("timestamp")
    got = {r["k"]: r["verdict"] for r in quality.live_verdict(samples, "k", "ts", at, 86401).collect()}
    assert got == {1: "stale", 2: "growing", 3: "stale"}


def test_a_start_meets_one_event_a_day(spark):
    events = spark.range(1000).select(F.col("id").alias("event_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 2).cast("int")).alias("event_date"))
    starts = spark.range(100).select(F.col("id").alias("start_id"), F.lit("2024-01-02 02:00:00").cast("timestamp").alias("start"))
    got = lookups.event_on_either_day(events, starts)
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(100)}
    assert joined_rows(got, spark) <= 200


def test_an_incoming_pair_meets_one_stored_bout_a_key(spark):
    bouts = lambda n, first: spark.range(first, first + n).select("id", F.lit(1).alias("red_id"), F.lit(2).alias("blue_id"), F.lit("A").alias("red_name"), F.lit("B").alias("blue_name"))
    got = lookups.same_pairs(bouts(500, 7), bouts(100, 1000))
    assert {tuple(r) for r in got.collect()} == {(i, 7) for i in range(1000, 1100)}
    assert joined_rows(got, spark) <= 200


def test_first_answers_are_found_once_a_text(spark):
    """2,000 rows of four names, a tenth of them asked: three answers each, from far fewer joined rows than pairs."""
    words = F.element_at(F.array(*map(F.lit, ("red bolt", "red bolts", "blue ring", "Réd bolt"))), (F.col("id") % 4 + 1).cast("int"))
    known = spark.range(2000).select(F.col("id").alias("known_id"), words.alias("name"))
    asked = known.filter("known_id % 10 = 0").withColumnRenamed("known_id", "asked_id")
    got = trigrams.most_similar(asked, known, "asked_id", "known_id", 3)
    pairs = trigrams.similar_names(asked, known, "asked_id", "known_id").collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-r["similarity"], r["known_id"])):
        want.setdefault(r["asked_id"], []).append((r["known_id"], r["similarity"]))
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, *x) for a, own in want.items() for x in own[:3])
    assert joined_rows(got, spark) < 2000 < len(pairs)


def test_no_postings_are_broadcast(spark, tmp_path):
    """A file of distinct names looks far smaller than their trigrams, which must not go to every task."""
    spark.range(3000).select("id", F.format_string("Name#%09d", F.col("id") * 7919).alias("name")).write.parquet(str(tmp_path / "names"))
    known = spark.read.parquet(str(tmp_path / "names"))
    asked = known.filter("id % 2 = 0").withColumnRenamed("id", "asked_id")
    got = trigrams.similar_names(asked, known, "asked_id", "id", least=0.7)
    assert broadcast_rows(got) < 1000
    assert got.filter("asked_id = id AND similarity = 1").count() == 1500


def test_first_answers_need_no_broadcast(spark, tmp_path):
    """Three answers for each of 1,500 names, while 3,000 distinct ones with thousands of postings are known."""
    spark.range(3000).select("id", F.format_string("Name#%09d", F.col("id") * 7919).alias("name")).write.parquet(str(tmp_path / "names"))
    known = spark.read.parquet(str(tmp_path / "names"))
    got = trigrams.most_similar(known.filter("id % 2 = 0").withColumnRenamed("id", "asked_id"), known, "asked_id", "id", 3, least=0.7)
    assert broadcast_rows(got) < 1000
    assert got.filter("asked_id = id AND similarity = 1").count() == 1500
    assert got.groupBy("asked_id").count().agg(F.max("count")).first()[0] == 3


def test_similar_texts_are_candidates_and_few_others(spark):
    """Names of few letters, slipped names of all lengths: every pair that is similar is found, and few others go on to be compared."""
    r = random.Random(5)
    parts = list("aeinorst")
    names = ["".join(r.choice(parts) + (" " if r.random() < 0.1 else "") for _ in range(r.randint(1, 30))).strip() for _ in range(250)]
    slips = [n[:i] + r.choice(("", "x", "er")) + n[i + r.randint(0, 2) :] for n in names for i in [r.randrange(len(n))]]
    texts = lambda own, c: spark.createDataFrame([(x,) for x in sorted(set(own))], f"{c} string")
    for least in (0.92, 0.8):
        got = entity.similar_candidates(texts(slips, "a"), texts(names, "b"), "a", "b", least)
        want = {(a, b) for a in slips for b in names if SequenceMatcher(None, a, b).ratio() >= least}
        assert want <= {tuple(x) for x in got.collect()}
    got = entity.similar_candidates(texts(slips, "a"), texts(names, "b"), "a", "b", 0.92)
    assert got.count() < 1_500


def test_names_of_few_words_meet_by_their_letters(spark):
    """A few words make all names, so many share two grams: bits of their letters tell which are compared, no keys go to every task."""
    r = random.Random(8)
    words = ["".join(r.choice("aeinorstdl") for _ in range(6)) for _ in range(12)]
    names = sorted({" ".join(r.choice(words) for _ in range(4)) for _ in range(400)})
    texts = lambda own, c: spark.createDataFrame([(x,) for x in own], f"{c} string")
    slips = sorted({n[:i] + n[i + 1 :] for n in names for i in [r.randrange(len(n))]})
    got = entity.similar_candidates(texts(slips, "a"), texts(names, "b"), "a", "b", 0.92)
    assert broadcast_rows(got) < 1000
    assert {(a, b) for a in slips for b in names if SequenceMatcher(None, a, b).ratio() >= 0.92} <= {tuple(x) for x in got.collect()}
    bits = {x["t"]: x["b"] for x in texts(slips + names, "t").withColumn("b", entity.letters(F.col("t"))).collect()}
    changed = [(bits[a] ^ bits[b]) & (1 << 64) - 1 for n in names for a, b in [(n, n[:i] + n[i + 1 :]) for i in range(len(n))] if b in bits]
    assert changed and all(c.bit_count() <= 1 for c in changed)


def test_a_pairing_makes_only_what_is_read(spark):
    """Whether a summary saw the future needs no sums of statistics and no rank."""
    from contestry.plans import careers

    plan = careers.leak_check(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "s_td_landed" not in plan and "rank_position" not in plan and "last_" in plan


def test_events_match_without_pairs(spark):
    """Names of few and of many tokens against plain Python; a day's names don't all meet."""
    r = random.Random(3)
    day = dt.date(2026, 1, 1)
    event = lambda i: (i, " ".join(r.sample("abcdefghijklmnopqrtu", r.choice((1, 3, 5, 14)))), day, r.choice((None, "x", "y")), 1)
    stored = [event(i) for i in range(1000, 1300)]
    asked = [event(i) for i in range(60)] + [(100 + i, *s[1:]) for i, s in enumerate(stored[:40])]
    table = lambda rows: spark.createDataFrame(rows, "id int, name string, event_date date, location string, promotion_id int")
    want = set()
    for i, name, _, place, _ in asked:
        found = [(10**6 if (n, p) == (name, place) else len({*n.split()} & {*name.split()}), -k) for k, n, _, p, _ in stored]
        if max(found)[0] >= 2:
            want.add((i, -max(found)[1]))
    assert {tuple(x) for x in entity.event_match(table(asked), table(stored)).collect()} == want
    few = table([x for x in asked if len(x[1]) < 12]), table([x for x in stored if len(x[1]) < 12])
    assert joined_rows(entity.event_match(*few), spark) < few[0].count() * few[1].count() / 3


def test_sets_of_tokens_are_not_broadcast(spark):
    """300 names of eight tokens have 74,100 sets of two or more; none of them goes to every task."""
    r = random.Random(7)
    rows = lambda first: [(first + i, " ".join(r.sample("abcdefghijklmnopqrtu", 8)), dt.date(2026, 1, 1), None, 1) for i in range(300)]
    one, two = rows(0), rows(1000)
    table = lambda x: spark.createDataFrame(x, "id int, name string, event_date date, location string, promotion_id int")
    got = entity.event_match(table(one), table(two))
    assert broadcast_rows(got) < 1000
    want = {(i, -max((len({*n.split()} & {*name.split()}), -k) for k, n, *_ in two)[1]) for i, name, *_ in one}
    assert {tuple(x) for x in got.collect()} == want
