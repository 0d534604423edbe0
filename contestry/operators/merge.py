"""Upserts as one full outer join with a rule for each column; the result is the planned table, nothing is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = {
    "incoming": lambda old, new: F.when(F.col("_in"), new).otherwise(old),
    "incoming_unless_null": lambda old, new: F.coalesce(new, old),
    "stored_wins": lambda old, new: F.coalesce(old, new),
    "stored_text_wins": lambda old, new: F.coalesce(F.nullif(old, F.lit("")), new),
    "monotonic": lambda old, new: F.greatest(old, new),
    # Keys that come replace stored ones of the same name, the others stay; values of any type. NULL where neither side has a map.
    "key_merge": lambda old, new: F.coalesce(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new), new, old),
}


def sticky(terminal: str):
    return lambda old, new: F.when(old == terminal, old).otherwise(F.coalesce(new, old))


def merge_upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], policy: dict) -> DataFrame:
    """policy: for each other column a name in RULES, or a function of the old and the new column. Keys must be unique."""
    a = stored.select(*keys, F.struct(*policy).alias("_old"), F.lit(True).alias("_was"))
    b = incoming.select(*keys, F.struct(*policy).alias("_new"), F.lit(True).alias("_is"))
    both = a.join(b, keys, "full_outer").withColumn("_in", F.col("_is").isNotNull())
    rule = lambda c: RULES[policy[c]] if isinstance(policy[c], str) else policy[c]
    cell = lambda c: F.when(F.col("_was").isNull(), F.col(f"_new.{c}")).otherwise(rule(c)(F.col(f"_old.{c}"), F.col(f"_new.{c}")))
    change: Column = F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "keep").otherwise("update")
    return both.select(*keys, *[cell(c).alias(c) for c in policy], change.alias("change"))


def total(parts: list[Column]) -> Column:
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))


RULES |= {
    # Written once: a stored value stays whatever comes, an empty text counts as none.
    "first_writer": lambda old, new: F.coalesce(F.when(old.cast("string") != "", old), new),
    # A value that comes replaces the stored one; none leaves it.
    "new_wins_if_present": lambda old, new: F.coalesce(F.when(new.cast("string") != "", new), old),
    # A flag once set stays set.
    "any_of": lambda old, new: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
}


def grows(record: list[str]):
    """Rules for the columns of a record that go together: the incoming ones only if their sum is larger and none is negative."""

    def rule(c: str):
        old, new = ([F.col(f"{side}.{x}") for x in record] for side in ("_old", "_new"))
        sound = F.lit(True)
        for x in new:
            sound &= F.coalesce(x, F.lit(0)) >= 0
        return lambda a, b: F.when(sound & (total(new) > total(old)), b).otherwise(a)

    return {c: rule(c) for c in record}


def replace_snapshot(stored: DataFrame, incoming: DataFrame, keys: list[str], slot: list[str]) -> DataFrame:
    """stored with the snapshots that incoming brings in place of its own (rows of the same keys); a snapshot that holds a slot twice
    isn't taken, and the stored one stays."""
    broken = incoming.groupBy(*keys, *slot).agg(F.count("*").alias("n_")).filter("n_ > 1").select(*keys).distinct()
    sound = incoming.join(broken, keys, "left_anti")
    return stored.join(sound.select(*keys).distinct(), keys, "left_anti").unionByName(sound)


def cancel_missing(bouts: DataFrame, seen: DataFrame, source: str) -> DataFrame:
    """bouts with status 'cancelled' where the source's event was seen without them; a bout with a result never changes, one that is
    seen again is live again. seen: bout_id, event_id of the latest card."""
    events = seen.select("event_id").distinct().withColumn("read_", F.lit(True))
    at = bouts.join(events, "event_id", "left").join(seen.select("bout_id").distinct().withColumn("here_", F.lit(True)), "bout_id", "left")
    gone = F.col("read_") & F.col("here_").isNull() & (F.col("source") == source) & F.col("winner_id").isNull() & F.col("method").isNull()
    status = F.when(F.col("here_"), F.lit(None).cast("string")).when(F.coalesce(gone, F.lit(False)), "cancelled").otherwise(F.col("status"))
    return at.withColumn("status", status).select(*bouts.columns)


def complete_dropped(events: DataFrame, listed: DataFrame, as_of: Column) -> DataFrame:
    """events with status 'completed' for upcoming ones that are no longer listed and lie in the past: dropping off alone proves nothing."""
    at = events.join(listed.select("event_id").distinct().withColumn("here_", F.lit(True)), "event_id", "left")
    over = (F.col("status") == "upcoming") & F.col("here_").isNull() & (F.col("event_date") < as_of)
    return at.withColumn("status", F.when(over, "completed").otherwise(F.col("status"))).select(*events.columns)


def pruned(rows: DataFrame, run_start: Column, kept: int, least: int = 100) -> DataFrame:
    """rows without those not touched since run_start, if the run kept `least` rows or more; a thin run prunes nothing."""
    return rows.filter(F.col("updated_at") >= run_start) if kept >= least else rows


def younger_than(rows: DataFrame, now: Column, hours: int = 48, ts: str = "updated_at") -> DataFrame:
    return rows.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def denser_series(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """For each key the series with more rows; the stored one of equals."""
    n = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    sizes = n(stored, "old_").join(n(incoming, "new_"), key, "full_outer").fillna(0, ["old_", "new_"])
    take = sizes.filter("new_ > old_").select(key)
    return stored.join(take, key, "left_anti").unionByName(incoming.join(take, key, "left_semi"))
