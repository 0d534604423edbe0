"""JSON documents as typed rows. A text that can't be read gives no rows; unreadable() counts such texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOREBOARD = """events array<struct<id:string, name:string, date:string, competitions:array<struct<id:string,
  competitors:array<struct<id:string, winner:boolean, athlete:struct<displayName:string>>>, details:array<struct<type:struct<text:string>>>,
  status:struct<displayClock:string, period:int, type:struct<name:string, state:string, completed:boolean, detail:string, shortDetail:string>>>>>>"""
#: Fixed value: what a detail begins with that tells a winner before the result is official.
UNOFFICIAL = "unofficial winner"
STATISTICS = "splits struct<categories:array<struct<stats:array<struct<name:string, value:double>>>>>"


def scoreboard(docs: DataFrame, text: str) -> DataFrame:
    """A row for each competition of two competitors or more: its event with name and start (UTC), both sides' ids and names, clock, period, state,
    the status's name and detail, the text of the first detail that tells an unofficial winner, and the winner, where exactly one of the two is marked.
    What a document doesn't say, or says with nothing, is NULL."""
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    events = docs.select(F.explode(F.from_json(text, SCOREBOARD)["events"]).alias("e"))
    bouts = events.select(F.col("e.id").alias("event_id"), said(F.col("e.name")).alias("event_name"), F.coalesce(F.try_to_timestamp(F.col("e.date"), F.lit("yyyy-MM-dd'T'HH:mmX")), F.try_to_timestamp(F.col("e.date"))).alias("start"), F.explode("e.competitions").alias("c")).filter(F.size("c.competitors") >= 2)
    two = F.slice("c.competitors", 1, 2)
    won = F.filter(two, lambda x: x["winner"])
    told = F.filter("c.details", lambda x: F.lower(F.trim(x["type"]["text"])).startswith(UNOFFICIAL))
    kind = lambda c: F.col(f"c.status.type.{c}")
    return bouts.select(
        "event_id", "event_name", "start", F.col("c.id").alias("bout_id"), *[x for i, side in enumerate(("red", "blue")) for x in (two[i]["id"].alias(f"{side}_id"), said(two[i]["athlete"]["displayName"]).alias(f"{side}_name"))],
        said(F.col("c.status.displayClock")).alias("clock"), F.col("c.status.period").alias("period"), kind("state").alias("state"), F.coalesce(kind("completed"), F.lit(False)).alias("completed"), said(kind("name")).alias("status"),
        F.coalesce(said(kind("shortDetail")), said(kind("detail"))).alias("status_detail"), F.lower(F.trim(F.try_element_at(told, F.lit(1))["type"]["text"])).alias("unofficial"), F.when(F.size(won) == 1, won[0]["id"]).alias("winner_id"),
    )


def statistics(text: Column, sums: dict[str, tuple[str, ...]] | None = None) -> Column:
    """name -> whole number over all categories, the last of a name staying; sums adds names whose value is the sum of those
    known of others. NULL where nothing is usable."""
    stats = F.filter(F.flatten(F.transform(F.from_json(text, STATISTICS)["splits"]["categories"], lambda c: c["stats"])), lambda s: s["name"].isNotNull() & s["value"].isNotNull())
    whole = F.aggregate(stats, F.create_map().cast("map<string,double>"), lambda m, s: F.map_concat(F.map_filter(m, lambda k, v: k != s["name"]), F.create_map(s["name"], F.rint(s["value"]))))
    for name, parts in (sums or {}).items():
        known = F.filter(F.array(*[F.try_element_at(whole, F.lit(p)) for p in parts]), lambda v: v.isNotNull())
        total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v))
        whole = F.when(total.isNull(), whole).otherwise(F.map_concat(whole, F.create_map(F.lit(name), total)))
    return F.when(F.cardinality(whole) > 0, whole)


def unreadable(docs: DataFrame, text: str, schema: str = SCOREBOARD) -> DataFrame:
    """How many texts were read and how many of them are not JSON of the schema; none stops the job."""
    got = F.from_json(text, schema + ", corrupt_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_"})
    return docs.select(got["corrupt_"].alias("bad_")).agg(F.count("*").alias("n"), F.count("bad_").alias("unreadable"))
