"""Checks on stored contests as plain aggregates; each gives the rows that are wrong, or a reason for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mirrored_cards(cards: DataFrame, bouts: DataFrame) -> DataFrame:
    """Bouts whose cards (bout_id, red, blue) mostly name the loser: more cards for the other side than for the winner."""
    sides = bouts.select("bout_id", "winner_id", "red_fighter_id", "blue_fighter_id").filter("winner_id IS NOT NULL")
    for_winner = F.when(F.col("winner_id") == F.col("red_fighter_id"), F.col("red") - F.col("blue")).otherwise(F.col("blue") - F.col("red"))
    votes = cards.join(sides, "bout_id").groupBy("bout_id").agg(F.count_if(for_winner > 0).alias("right"), F.count_if(for_winner < 0).alias("wrong"))
    return votes.filter("wrong > right")


def rounds_refused(rounds: DataFrame, totals: DataFrame, value: str) -> DataFrame:
    """bout_id, fighter_id and refusal_reason (NULL: the rounds may replace what is stored) of each participant with rounds.

    totals: bout_id, fighter_id, end_round and the stored total. Reasons in order: a stranger to the bout, rounds other
    than 1 to end_round once each, a missing number, a sum other than the total.
    """
    n = rounds.groupBy("bout_id", "fighter_id").agg(
        F.count("*").alias("n_"), F.countDistinct("round").alias("k_"), F.min("round").alias("a_"), F.max("round").alias("z_"), F.count(value).alias("known_"), F.sum(value).alias("sum_")
    )
    t = totals.select("bout_id", "fighter_id", "end_round", F.col(value).alias("total_"), F.lit(True).alias("stored_"))
    exact = (F.col("a_") == 1) & (F.col("z_") == F.col("end_round")) & (F.col("n_") == F.col("end_round")) & (F.col("k_") == F.col("n_"))
    reason = F.when(F.col("stored_").isNull(), "stranger").when(~F.coalesce(exact, F.lit(False)), "rounds").when(F.col("known_") < F.col("n_"), "missing").when(~F.col("sum_").eqNullSafe(F.col("total_")), "total")
    return n.join(t, ["bout_id", "fighter_id"], "left").select("bout_id", "fighter_id", reason.alias("refusal_reason"))


def live_verdict(samples: DataFrame, key: str, ts: str, now, fresh_seconds: int) -> DataFrame:
    """key, n, newest and verdict of samples with period of 1 or more: idle (one at most), stale (older than fresh_seconds, fractions
    of a second count), or growing."""
    started = samples.filter("period >= 1").groupBy(key).agg(F.count("*").alias("n"), F.max(ts).alias("newest"))
    late = F.unix_micros(now) - F.unix_micros(F.col("newest").cast("timestamp")) > fresh_seconds * 1_000_000
    return started.withColumn("verdict", F.when(F.col("n") <= 1, "idle").when(late, "stale").otherwise("growing"))


def phantom_pairs(bouts: DataFrame, event: str) -> DataFrame:
    """event, a, b, n and keeper of pairs that meet twice or more at one event, whichever side each is on."""
    a, b = F.least("red_fighter_id", "blue_fighter_id").alias("a"), F.greatest("red_fighter_id", "blue_fighter_id").alias("b")
    return bouts.groupBy(event, a, b).agg(F.count("*").alias("n"), F.min("bout_id").alias("keeper")).filter("n > 1")


def duplicate_names(rows: DataFrame, key: str, entity: str, told_apart_by: str) -> DataFrame:
    """key, n, keeper (smallest id), homonyms (two values of told_apart_by) and ids in order of keys that occur twice or more."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(entity).alias("keeper"), (F.countDistinct(told_apart_by) > 1).alias("homonyms"), F.sort_array(F.collect_list(entity)).alias("ids")).filter("n > 1")
