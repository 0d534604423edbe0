"""Queries that resolve names, events and winners, over cases written out beside what each must give."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from contestry.operators import entity
from contestry.plans.cases import literal
from contestry.plans.registry import query
from contestry.sources.proxy import table


D1, D2 = dt.date(2026, 1, 3), dt.date(2026, 1, 10)
EVENTS_IN = [(1, "League 300: Pereira vs Hill", D1, "Las Vegas", 1), (2, "UFC Fight Night: Procházka vs. Hill", D1, "Apex", 1), (3, "UFC Fight Night", D1, "Apex", 1), (4, "UFC on ESPN: Silva vs Costa", D2, None, 1), (5, "UFC on ESPN: Silva vs Costa", D2, None, 2)]
EVENTS_HELD = [(11, "League 300: Pereira vs Hill", D1, "Las Vegas", 1), (12, "UFC on ABC: Prochazka vs Hill", D1, "Nevada", 1), (13, "UFC: Hill vs Prochazka", D1, "Nevada", 1), (14, "UFC: Silva vs Jones", D2, None, 1), (15, "Silva vs Costa", D2, None, 2)]
EVENT_KINDS = "id bigint, name string, event_date date, location string, promotion_id int"
MATCHED = [(1, 11), (2, 12), (5, 15)]


def events(spark, d, rows):
    groups = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("g"))
    at = spark.createDataFrame(rows, EVENT_KINDS).crossJoin(F.broadcast(groups))  # five rows
    return at.select((F.col("id") + F.col("g") * 100).alias("id"), "name", F.date_add("event_date", (F.col("g") * 30).cast("int")).alias("event_date"), "location", "promotion_id")


def shifted(rows: list[tuple], columns: str, keys: tuple[str, ...]) -> str:
    names = columns.split(", ")
    return "SELECT " + ", ".join(f"CAST({c} + r_regionkey * 100 AS BIGINT) {c}" if c in keys else c for c in names) + f" FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) x({columns}), region"


@query(shifted(MATCHED, "in_id, event_id", ("in_id", "event_id")))
def matched_events(spark, d):
    return entity.event_match(events(spark, d, EVENTS_IN), events(spark, d, EVENTS_HELD))


@query(shifted([(3,), (4,)], "id", ("id",)))
def events_to_import(spark, d):
    index = events(spark, d, EVENTS_IN)
    twice = index.unionByName(index.filter("id % 2 = 0")).withColumn("url", F.concat(F.lit("/e/"), F.col("id").cast("string")))
    return entity.missing_events(twice, events(spark, d, EVENTS_HELD), F.lit("2030-01-01").cast("date")).select("id")


def grouped(spark, d, rows, schema, keys):
    groups = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("g"))
    at = spark.createDataFrame(rows, schema).crossJoin(F.broadcast(groups))  # five rows
    return at.withColumns({k: F.col(k) + F.col("g") * 100 for k in keys}).drop("g")


PAGES = [(1, 1, "Jose Delgado", "Austin Bashi"), (2, 1, "Zach Reese", "Sedriques Dumas"), (3, 2, "Bo Lee", "Cy Li"), (4, 2, "Bo Lee Jr", "Cy Li Jr"), (5, 3, "A Nother", "B Nother")]
BOUTS = [(11, 1, "Austin Bashi", "Jose Miguel Delgado"), (12, 1, "Zachary Reese", "Sedriques Dumas"), (13, 2, "Cy Li", "Bo Lee"), (14, 3, "C Else", "B Nother"), (15, 4, "X Y", "Z W")]


@query(shifted([(11, 1), (12, 2), (13, 3)], "bout_id, page_id", ("bout_id", "page_id")))
def pages_of_bouts(spark, d):
    return entity.bout_of_page(grouped(spark, d, BOUTS, "bout_id bigint, event_id bigint, red_name string, blue_name string", ["bout_id", "event_id"]), grouped(spark, d, PAGES, "page_id bigint, event_id bigint, name_1 string, name_2 string", ["page_id", "event_id"]))


PRICES = [(1, 1, "Jon Jones", "Tom Aspinall"), (2, 1, "Tom Aspinal", "John Jones"), (3, 1, "Jiří Procházka", "Alex Pereira"), (4, 2, "No Body", "Some One")]
PRICED = [(21, 1, "Tom Aspinall", "Jon Jones"), (22, 1, "Alex Pereira", "Jiri Prochazka"), (23, 2, "Entirely Other", "People Here")]


@query("SELECT price_id, bout_id, round(score, 4) score, swapped FROM (" + shifted([(1, 21, 1.0, True), (3, 22, 1.0, True)], "price_id, bout_id, score, swapped", ("price_id", "bout_id")) + ")")
def priced_bouts(spark, d):
    got = entity.priced_pairs(grouped(spark, d, PRICES, "price_id bigint, day bigint, first_name string, second_name string", ["price_id", "day"]), grouped(spark, d, PRICED, "bout_id bigint, day bigint, red_name string, blue_name string", ["bout_id", "day"]))
    return got.withColumn("score", F.round("score", 4))


CARDS_SEEN = [(1, "/a", "X", "/b", "Y"), (2, None, "Jose Delgado", None, "Austin Bashi"), (3, None, "Bruno Silva", None, "Bruno Silva"), (4, "/d", "A", "/c", "B"), (5, None, "Q", None, "W")]
CARDS_HELD = [(1, "/a", "Other", "/b", "Names"), (2, None, "Austin Bashi", "/z", "Jose Miguel Delgado"), (3, None, "Bruno Silva", None, "Bruno Silva"), (4, "/c", "A", "/d", "B"), (5, None, "N", None, "M")]


@query(shifted([(1, True), (2, False), (3, None), (4, False), (5, None)], "bout_id, first_is_red", ("bout_id",)))
def card_orientations(spark, d):
    return entity.card_orientation(grouped(spark, d, CARDS_SEEN, "bout_id bigint, src_1 string, name_1 string, src_2 string, name_2 string", ["bout_id"]), grouped(spark, d, CARDS_HELD, "bout_id bigint, red_src string, red_name string, blue_src string, blue_name string", ["bout_id"]))


@query("""WITH b AS (SELECT o_orderkey bout_id, o_orderkey % 20 red_id, 20 + o_custkey % 20 blue_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 20 END winner_id FROM orders WHERE o_orderkey % 7 > 0),
  s AS (SELECT bout_id, CASE bout_id % 5 WHEN 0 THEN 'draw_nc' WHEN 1 THEN 'unclear' ELSE 'decided' END st, CASE bout_id % 4 WHEN 0 THEN red_id WHEN 1 THEN blue_id WHEN 2 THEN 99 END w FROM b),
  o AS (SELECT bout_id, b.*, CASE WHEN st = 'decided' AND w IS NULL THEN 'winner_unknown' WHEN st = 'decided' AND w = 99 THEN 'winner_not_in_bout' WHEN st = 'decided' THEN 'decided' WHEN st = 'draw_nc' THEN 'draw_nc' ELSE 'undetermined' END outcome, w FROM b JOIN s USING (bout_id))
  SELECT bout_id, blue_id red_id, red_id blue_id, CASE outcome WHEN 'decided' THEN w WHEN 'draw_nc' THEN NULL ELSE winner_id END winner_id, outcome FROM o""")
def planned_winners(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    red, blue = k % 20, 20 + c % 20
    src = lambda i: F.concat(F.lit("s"), F.lpad((100 - i).cast("string"), 3, "0"))
    o = table(spark, d, "orders")
    bouts = o.select(k.alias("bout_id"), k.cast("string").alias("source_id"), red.alias("red_id"), src(red).alias("red_src"), blue.alias("blue_id"), src(blue).alias("blue_src"), F.when(k % 3 == 0, red).alias("winner_id"))
    scraped = o.filter("o_orderkey % 7 > 0").select(k.cast("string").alias("source_id"), F.when(k % 5 == 0, "draw_nc").when(k % 5 == 1, "unclear").otherwise("decided").alias("status"), F.when(k % 4 == 0, src(red)).when(k % 4 == 1, src(blue)).when(k % 4 == 2, src(F.lit(99))).otherwise("nobody").alias("winner_src"))
    people = spark.range(100).select("id", src(F.col("id")).alias("src"))
    return entity.winner_plan(bouts, scraped, people)


@query("""SELECT o_orderkey bout_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 2 WHEN o_orderkey % 4 = 2 THEN 1 END winner_id, CASE WHEN o_orderkey % 6 = 0 THEN 'mismatch' WHEN o_orderkey % 4 IN (1, 2) THEN 'updated' ELSE 'no_winner' END outcome FROM orders""")
def repaired_winners(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    bouts = o.select(k.alias("bout_id"), F.lit(1).alias("red_id"), F.lit(2).alias("blue_id"), F.lit(None).cast("int").alias("winner_id"))
    pages = o.select(k.alias("bout_id"), F.when(k % 6 == 0, 3).otherwise(2).alias("id_1"), F.lit(1).alias("id_2"), F.when(k % 4 == 1, "W").when(k % 4 == 2, "l").otherwise("d").alias("status_1"), F.when(k % 4 == 1, "L").when(k % 4 == 2, "w").otherwise("d").alias("status_2"))
    return entity.winner_repair(bouts, pages)


@query("""WITH s AS (SELECT o_custkey event_id, o_orderkey % 4 bout_order, o_orderkey id, CASE WHEN o_orderkey % 3 = 0 THEN 'cancelled' END status FROM orders WHERE o_orderkey % 4 > 0)
  SELECT event_id, bout_order, count(*) n, count(*) FILTER (status IS NULL) active, count(*) FILTER (status = 'cancelled') cancelled, array_to_string(list_sort(list(id)), ',') ids FROM s GROUP BY ALL HAVING count(*) > 1""")
def crowded_slots(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("event_id"), F.when(k % 4 > 0, k % 4).alias("bout_order"), k.alias("id"), F.when(k % 3 == 0, "cancelled").alias("status"))
    return entity.phantoms(rows).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("SELECT o_orderkey id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def deletable_bouts(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "bout_id")
    return entity.childless(table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id")), [lines.filter("l_quantity > 30"), lines.filter("l_returnflag = 'A'")])
