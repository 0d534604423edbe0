"""Reviews and monitors over stored contests: what is wrong, missing or stale, each row with a severity. Days are counted from an
as_of that the caller gives, so that a review gives the same rows again.

events: event_id, event_date, status; bouts: bout_id, event_id, bout_order, status, winner_id, method, end_round, referee.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.scalar import has_result, within_days

CRITICAL, WARNING, INFO = "CRITICAL", "WARNING", "INFO"
#: Methods that a later source is to refine.
PROVISIONAL = ("Decision", "Submission", "KO/TKO")


def live(status: str = "status") -> Column:
    return ~F.col(status).eqNullSafe(F.lit("cancelled"))


def decided() -> Column:
    return has_result(F.col("winner_id"), F.col("method"))


def exit_code(findings: DataFrame) -> DataFrame:
    """One row: how many findings of each severity, and code 2 with a critical one, 1 with a warning, else 0."""
    n = findings.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in (CRITICAL, WARNING, INFO)])
    return n.withColumn("code", F.when(F.col("critical") > 0, 2).when(F.col("warning") > 0, 1).otherwise(0))


def duplicate_slots(ranks: DataFrame, slot: list[str]) -> DataFrame:
    """Rank slots held twice."""
    return ranks.groupBy(*slot).agg(F.count("*").alias("n")).filter("n > 1").withColumn("severity", F.lit(CRITICAL))


def empty_events(events: DataFrame, bouts: DataFrame, as_of: Column, days: int = 21) -> DataFrame:
    """Events of the next days without a bout."""
    soon = events.filter(within_days(F.col("event_date"), as_of, 0, days))
    return soon.join(bouts.select("event_id").distinct(), "event_id", "left_anti").select("event_id", "event_date", F.lit(CRITICAL).alias("severity"))


def main_event_resolved(bouts: DataFrame) -> DataFrame:
    """event_id and resolved: whether the first live bout in order has a result; a draw has one."""
    at = bouts.filter(live() & F.col("bout_order").isNotNull())
    return at.groupBy("event_id").agg(F.max_by(decided(), F.struct(-F.col("bout_order"), decided())).alias("resolved"))


def ghosts(events: DataFrame, bouts: DataFrame, as_of: Column, days: int = 10) -> DataFrame:
    """Bouts neither resolved nor cancelled at recent events whose main event is over."""
    over = main_event_resolved(bouts).filter("resolved").select("event_id")
    past = events.filter(within_days(F.col("event_date"), as_of, days, -1)).join(over, "event_id", "left_semi")
    return bouts.filter(live() & ~decided()).join(past.select("event_id", "event_date"), "event_id").select("bout_id", "event_id", "event_date", F.lit(CRITICAL).alias("severity"))


def complete_rounds(rounds: DataFrame) -> DataFrame:
    """bout_id and n, the rounds for which both participants have a row; bouts with rounds but no complete one have 0."""
    each = rounds.groupBy("bout_id", "round").agg(F.countDistinct("fighter_id").alias("k"))
    return each.groupBy("bout_id").agg(F.count_if(F.col("k") >= 2).alias("n"))


def data_gaps(events: DataFrame, bouts: DataFrame, stats: DataFrame, rounds: DataFrame, as_of: Column, grace: int = 3, window: int = 30, days: int = 60) -> DataFrame:
    """For each recent event with resolved bouts that lack something: how many lack a referee, statistics or rounds, and whether that
    is young (within grace: INFO), being filled (CRITICAL) or too old to be filled (WARNING)."""
    past = events.filter(within_days(F.col("event_date"), as_of, days, -1)).select("event_id", "event_date")
    at = bouts.filter(live() & decided()).join(past, "event_id").join(stats.select("bout_id").distinct().withColumn("s_", F.lit(True)), "bout_id", "left").join(complete_rounds(rounds), "bout_id", "left")
    partly = F.coalesce(F.col("n") < F.col("end_round"), F.lit(False))
    got = at.groupBy("event_id", "event_date").agg(F.count_if(F.col("referee").isNull()).alias("no_referee"), F.count_if(F.col("s_").isNull()).alias("no_stats"), F.count_if(partly).alias("partly")).filter("no_referee + no_stats + partly > 0")
    age = F.datediff(as_of, "event_date")
    return got.withColumn("age", age).withColumn("severity", F.when(F.col("age") < grace, INFO).when(F.col("age") > window, WARNING).otherwise(CRITICAL))


def unclosed(events: DataFrame, as_of: Column, days: int = 60) -> DataFrame:
    """Past events still called upcoming; a day's delay is a warning."""
    late = F.datediff(as_of, "event_date")
    return events.filter(within_days(F.col("event_date"), as_of, days, -1) & (F.col("status") == "upcoming")).select("event_id", late.alias("days"), F.when(late <= 1, WARNING).otherwise(CRITICAL).alias("severity"))


def unrefined(events: DataFrame, bouts: DataFrame, as_of: Column, grace: int = 3, days: int = 60) -> DataFrame:
    """Bouts whose method is still provisional after the days of grace."""
    past = events.filter(within_days(F.col("event_date"), as_of, days, -grace)).select("event_id")
    return bouts.filter(live() & F.col("method").isin(*PROVISIONAL)).join(past, "event_id", "left_semi").select("bout_id", "method", F.lit(WARNING).alias("severity"))


def events_to_fill(events: DataFrame, bouts: DataFrame, rounds: DataFrame, as_of: Column, window: int = 30) -> DataFrame:
    """event_id and reason of past events within the window that need results (a live bout without one), rounds (a decided bout with
    fewer complete rounds than its end round), or bouts (none at all)."""
    past = events.filter(within_days(F.col("event_date"), as_of, window, -1)).select("event_id")
    done = bouts.filter(live()).join(complete_rounds(rounds), "bout_id", "left")
    got = done.groupBy("event_id").agg(F.count("*").alias("k"), F.count_if(~decided()).alias("open"), F.count_if(decided() & (F.coalesce("n", F.lit(0)) < F.col("end_round"))).alias("short"))
    reason = F.when(F.col("k").isNull(), "bouts").when(F.col("open") > 0, "results").when(F.col("short") > 0, "rounds")
    return past.join(got, "event_id", "left").select("event_id", reason.alias("reason")).filter("reason IS NOT NULL")


def watchdog(events: DataFrame, samples: DataFrame, bouts: DataFrame, beats: DataFrame, now: Column, fresh_minutes: int = 15, stale_after: int = 10) -> DataFrame:
    """event_id and state (OK, DOWN or ENDED) of events that have begun: by resolved bouts first, then by fresh samples and the
    heartbeat, which may only add red. samples: event_id, ts; beats: event_id, ts (the last counts)."""
    from contestry.functions.scalar import night_status

    minutes = lambda c: (F.unix_seconds(now) - F.unix_seconds(c)) / 60
    fresh = samples.groupBy("event_id").agg(F.count_if(minutes(F.col("ts")) <= fresh_minutes).alias("fresh"))
    beat = beats.groupBy("event_id").agg(minutes(F.max("ts")).alias("beat"))
    active = bouts.filter(live()).groupBy("event_id").agg(F.count("*").alias("active"), F.count_if(decided()).alias("resolved"))
    at = events.select("event_id").join(active, "event_id", "left").join(fresh, "event_id", "left").join(beat, "event_id", "left").fillna(0, ["active", "resolved", "fresh"])
    return at.select("event_id", night_status(F.col("fresh"), F.col("active"), F.col("resolved"), F.col("beat"), stale_after).alias("state"))


def checkpoint(bouts: DataFrame, people: DataFrame, cards: DataFrame, stats: DataFrame) -> DataFrame:
    """Each bout with its names (of the participants, else as scraped), counts of scorecards and statistics, and whether it is whole."""
    from contestry.operators.lookups import with_count, with_name

    at = bouts
    for side in ("red", "blue"):
        at = with_name(at, people, f"{side}_id", f"{side}_scraped").withColumnRenamed("name", side)
    at = with_count(with_count(at, cards, "bout_id", "cards"), stats, "bout_id", "stats")
    whole = decided() & F.col("referee").isNotNull() & (F.col("stats") >= 2)
    return at.select("bout_id", "red", "blue", "cards", "stats", F.coalesce(whole, F.lit(False)).alias("whole"))


def gaps_on_cards(people: DataFrame, bouts: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """id and gap, one row for each flag that holds of a participant on a card: an explode of both corners, no OR-join."""
    on_card = bouts.select(F.explode(F.array("red_id", "blue_id")).alias("id")).filter("id IS NOT NULL").distinct()
    missing = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return people.join(on_card, "id", "left_semi").select("id", F.explode(missing).alias("gap"))


def unlinked_slots(bouts: DataFrame) -> DataFrame:
    """bout_id, side and anchor_id of corners without a participant whose opposite has one."""
    side = lambda own, other: F.struct(F.lit(own).alias("side"), F.col(f"{own}_id").alias("own_"), F.col(f"{other}_id").alias("anchor_id"))
    return bouts.select("bout_id", F.explode(F.array(side("red", "blue"), side("blue", "red"))).alias("s")).filter("s.own_ IS NULL AND s.anchor_id IS NOT NULL").select("bout_id", "s.side", "s.anchor_id")


def sampled_rate(rows: DataFrame, right: Column, n: int, seed: int) -> DataFrame:
    """One row: n rows at most, drawn by the MD5 of the seed and their values, how many are right, and their share. The same rows again."""
    drawn = rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in rows.columns]))).limit(n)
    return drawn.agg(F.count("*").alias("n"), F.count_if(right).alias("right")).withColumn("rate", F.round(F.try_divide(F.col("right").cast("double"), F.col("n").cast("double")), 6))


def loop_health(passes: DataFrame) -> DataFrame:
    """One row of a loop's passes (failed, written, unresolved): counts, and whether to warn (a failure, or unresolved rows) or to fail
    (all passes failed, or none wrote)."""
    n = passes.agg(F.count("*").alias("passes"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("written"), F.lit(0)).alias("written"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"))
    bad = (F.col("failed") == F.col("passes")) | (F.col("written") == 0)
    return n.withColumn("verdict", F.when(bad, "fail").when((F.col("failed") > 0) | (F.col("unresolved") > 0), "warn").otherwise("ok"))


def match_rate(listed: DataFrame, known: DataFrame, key: str, by: str) -> DataFrame:
    """by, listed and mapped of listed rows whose key is known, and their share."""
    at = listed.join(known.select(key).distinct().withColumn("k_", F.lit(True)), key, "left")
    return at.groupBy(by).agg(F.count("*").alias("listed"), F.count("k_").alias("mapped")).withColumn("rate", F.round(F.col("mapped") / F.col("listed"), 6))


def photo_report(sides: DataFrame) -> DataFrame:
    """One row of corners' photo sources (bout_id, side, source, mirror): counts by kind, and bouts where one corner has a picture and
    the other has none."""
    kinds = {"exact": F.col("source") == "exact", "mirrored": F.coalesce(F.col("mirror"), F.lit(False)), "none": F.col("source").isNull()}
    per = sides.groupBy("bout_id").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()], F.count("*").alias("corners"))
    return per.agg(*[F.sum(k).alias(k) for k in kinds], F.count_if((F.col("none") > 0) & (F.col("none") < F.col("corners"))).alias("discordant"))


def name_hygiene(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key and problem (long, keyword, mojibake) of names that can't be right; the first that holds."""
    from contestry.functions.text import LONG_NAME, suspicious_name

    n = F.col(name)
    problem = F.when(F.length(n) > LONG_NAME, "long").when(suspicious_name(n), "keyword").when(n.rlike("Ã.|Â.|�"), "mojibake")
    return rows.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def caption_matches(name: Column, caption: Column, least: float = 0.87) -> Column:
    """Whether a picture's caption is alike to the participant's name, both folded."""
    from contestry.functions.text import fold_name, similarity

    return similarity(fold_name(name), fold_name(caption)) >= least
