"""Contests read from the generic tables: an order with two or more suppliers is a bout between the least and greatest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = {"1-URGENT": "KO/TKO", "2-HIGH": "SUB choke", "3-MEDIUM": "U-DEC", "4-NOT SPECIFIED": "Other", "5-LOW": "S-DEC"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bout and participant: what the participant landed, attempted and earned (in cents)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.sum("l_quantity").cast("bigint").alias("attempted"),
        F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0)).cast("bigint").alias("landed"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
    )
    return lines.select(F.col("l_orderkey").alias("bout_id"), F.col("l_suppkey").alias("fighter_id"), "attempted", "landed", "cents")


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide form, one row per bout. Sides go by id, never by the result; equal cents are a draw (winner NULL)."""
    each = sides(spark, sf_dir).groupBy("bout_id").agg(
        F.min(F.struct("fighter_id", "attempted", "landed", "cents")).alias("red"), F.max(F.struct("fighter_id", "attempted", "landed", "cents")).alias("blue"), F.count("*").alias("n")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bout_id"), F.to_date("o_orderdate").alias("event_date"), F.col("o_orderpriority").alias("p"))
    method = F.element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), F.col("p"))
    red, blue = F.col("red.cents"), F.col("blue.cents")
    winner = F.when(red > blue, F.col("red.fighter_id")).when(blue > red, F.col("blue.fighter_id"))
    return each.filter("n >= 2").join(orders, "bout_id").select(
        "bout_id", "event_date", method.alias("method"), winner.alias("winner_id"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("red", "blue") for c in ("fighter_id", "attempted", "landed")]
    )


CLASSES = ("Lightweight", "Women's Strawweight", "Light Heavyweight", "Catch Weight", "Women’s Flyweight", "Heavyweight")


def stat_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bout and participant with seven statistics, all of which lack in one row of five, and one for one participant of seven."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    # Dealt by bout once, for this aggregation and those by bout that follow.
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("bout_id"), F.col("l_suppkey").alias("fighter_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("sig_attempted"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0)).cast("bigint").alias("sig_landed"),
        F.sum("l_linenumber").cast("bigint").alias("td_attempted"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).otherwise(0)).cast("bigint").alias("td_landed"),
        cents("l_tax").alias("sub_attempts"), (cents("l_discount") * 10).alias("control"), F.sum((F.col("l_returnflag") == "A").cast("bigint")).alias("knockdowns"), cents("l_extendedprice").alias("cents"),
    )
    gone = (F.col("bout_id") + F.col("fighter_id")) % 5 == 0
    known = {c: F.when(~gone, F.col(c)) for c in ("sig_landed", "sig_attempted", "td_landed", "td_attempted", "control", "knockdowns")}
    return lines.withColumns({**known, "sub_attempts": F.when(~gone & (F.col("fighter_id") % 7 != 0), F.col("sub_attempts"))})


def full_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide bouts with all statistics, rounds, clocks (some unreadable), classes and titles (some unknown)."""
    stats = ("sig_landed", "sig_attempted", "td_landed", "td_attempted", "sub_attempts", "control", "knockdowns")
    ends = [by(c, "fighter_id").alias(f"{s}_{c}") for s, by in (("red", F.min_by), ("blue", F.max_by)) for c in ("fighter_id", "cents", *stats)]
    each = stat_sides(spark, sf_dir).groupBy("bout_id").agg(*ends, F.count("*").alias("n"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select(
        k.alias("bout_id"), F.to_date("o_orderdate").alias("event_date"), F.element_at(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv]), F.col("o_orderpriority")).alias("method"),
        F.when(k % 11 != 0, 1 + k % 5).cast("int").alias("end_round"), F.when(k % 13 == 0, "?").otherwise(F.format_string("%d:%02d", F.floor(k % 301 / 60), k % 301 % 60)).alias("clock"),
        F.element_at(F.array(*map(F.lit, CLASSES)), (c % 6 + 1).cast("int")).alias("weight_class"), F.when(c % 3 == 0, "5").when(c % 3 == 1, "x").alias("scheduled"), F.when(k % 19 != 0, (k % 17 == 0).cast("int")).alias("title"),
    )
    red, blue = F.col("red_cents"), F.col("blue_cents")
    winner = F.when(red > blue, F.col("red_fighter_id")).when(blue > red, F.col("blue_fighter_id"))
    return each.filter("n >= 2").join(orders, "bout_id").select(*orders.columns, winner.alias("winner_id"), *[f"{s}_{x}" for s in ("red", "blue") for x in ("fighter_id", *stats)])


def fighters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("fighter_id"), F.when(s % 9 != 0, (150 + s % 50).cast("double")).alias("height_cm"), F.when(s % 8 != 0, (155 + s % 45).cast("double")).alias("reach_cm"),
        F.when(s % 10 != 0, F.date_add(F.lit("1960-01-01").cast("date"), (s * 37 % 9000).cast("int"))).alias("birth_date"),
    )
