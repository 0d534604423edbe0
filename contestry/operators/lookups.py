"""Joins and lookups on stored contests: names, ids of sources, siblings, pairs in any order, latest rows, candidate dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.sources.staged import staged


def with_roles(bouts: DataFrame, facts: DataFrame, roles: tuple[str, ...] = ("red", "blue"), keys: tuple[str, str] = ("bout_id", "fighter_id")) -> DataFrame:
    """bouts with facts' other columns for each role, by bout and the role's participant; what isn't known is NULL.

    facts are aligned once on their bout and picked by participant, so two roles don't mean two joins.
    """
    bout, who = keys
    cells = [c for c in facts.columns if c not in keys]
    at = facts.groupBy(bout).agg(F.map_from_entries(F.collect_list(F.struct(who, F.struct(*cells)))).alias("all_"))  # a bout has two participants
    both = bouts.join(at, bout, "left")
    return both.select(*bouts.columns, *[F.try_element_at("all_", F.col(f"{r}_{who}"))[c].alias(f"{r}_{c}") for r in roles for c in cells])


def with_name(rows: DataFrame, people: DataFrame, key: str, scraped: str, scraped_first: bool = False) -> DataFrame:
    """rows with name: the people's name of the id, or the scraped one, whichever goes first and isn't NULL."""
    at = rows.join(people.select(F.col("id").alias(key), F.col("name").alias("own_")), key, "left")
    order = (F.col(scraped), F.col("own_")) if scraped_first else (F.col("own_"), F.col(scraped))
    return at.withColumn("name", F.coalesce(*order)).drop("own_")


def plain_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def across_sources(people: DataFrame, source: str, other: str) -> DataFrame:
    """name_key, id and other_id of people of one source whose name, spacing and case aside, is also in the other."""
    at = people.withColumn("name_key", plain_key(F.col("name")))
    a = at.filter(F.col("source") == source).select("name_key", "id")
    return a.join(at.filter(F.col("source") == other).select("name_key", F.col("id").alias("other_id")), "name_key")


def source_index(people: DataFrame, ranked: list[str]) -> DataFrame:
    """source_id and id of people, from several columns of source ids; the earlier column wins where two own one id, then the
    smaller id."""
    each = people.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.col(c).cast("string").alias("source_id")) for i, c in enumerate(ranked)])).alias("x")).select("id", "x.*")
    return each.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.min(F.struct("r", "id")).alias("b")).select("source_id", F.col("b.id").alias("id"))


def sibling(rows: DataFrame, group: list[str], entity: str) -> DataFrame:
    """rows with sibling_id, the smallest other id of the group; NULL for a row alone. One aggregation for each group."""
    ends = rows.groupBy(*group).agg(F.min(entity).alias("a_"))
    second = rows.join(ends, group).filter(F.col(entity) > F.col("a_")).groupBy(*group).agg(F.min(entity).alias("b_"))
    return rows.join(ends, group).join(second, group, "left").withColumn("sibling_id", F.when(F.col(entity) == F.col("a_"), F.col("b_")).otherwise(F.col("a_"))).drop("a_", "b_")


def pair_key(a: Column, b: Column) -> Column:
    """The same for both orders of a pair; NULL if either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("|", F.least(a, b), F.greatest(a, b)))


def same_pairs(stored: DataFrame, incoming: DataFrame, placeholder: str = "tbd") -> DataFrame:
    """in_id and bout_id (the smallest) of incoming bouts whose two participants, in any order, are those of a stored one: by ids, or by
    folded names if no name is the placeholder. Both: id, red_id, blue_id, red_name, blue_name."""
    def keyed(df: DataFrame) -> DataFrame:
        ids = pair_key(F.col("red_id").cast("string"), F.col("blue_id").cast("string"))
        name = lambda c: F.when(plain_key(F.col(c)) != placeholder, plain_key(F.col(c)))
        keys = F.array(F.concat(F.lit("id "), ids), F.concat(F.lit("name "), pair_key(name("red_name"), name("blue_name"))))
        return df.select("id", F.explode(F.array_compact(keys)).alias("k"))

    first = keyed(stored).groupBy("k").agg(F.min("id").alias("bout_id"))  # so an incoming bout meets one row a key
    met = keyed(incoming).withColumnRenamed("id", "in_id").join(first, "k")
    return met.groupBy("in_id").agg(F.min("bout_id").alias("bout_id"))


def opposite_by_anchor(slots: DataFrame, board: DataFrame) -> DataFrame:
    """slot_id and source_id for each slot whose other corner is known: the opposite in the one board bout where that one stands.

    slots: slot_id, anchor_id; board: bout_id, red_id, blue_id. An anchor in no or in several bouts gives nothing.
    """
    corners = board.select("bout_id", F.explode(F.array(F.struct(F.col("red_id").alias("anchor_id"), F.col("blue_id").alias("other")), F.struct(F.col("blue_id").alias("anchor_id"), F.col("red_id").alias("other")))).alias("c")).select("bout_id", "c.*")
    once = corners.groupBy("anchor_id").agg(F.count("*").alias("n_"), F.min("other").alias("source_id")).filter("n_ = 1")
    return slots.join(once, "anchor_id").select("slot_id", "source_id")


def with_count(rows: DataFrame, facts: DataFrame, key: str, name: str = "n") -> DataFrame:
    """rows with how many facts have their key, 0 for none: counted first, then joined."""
    n = facts.groupBy(key).agg(F.count("*").alias(name))
    return rows.join(n, key, "left").fillna(0, [name])


def latest_snapshot_rows(rows: DataFrame, day: str) -> DataFrame:
    """The rows of the newest day; one row of the maximum goes to every task."""
    newest = rows.agg(F.max(day).alias("newest_"))
    return rows.join(F.broadcast(newest), F.col(day) == F.col("newest_")).drop("newest_")


def latest_row(rows: DataFrame, key: str, updated: str, entity: str) -> DataFrame:
    """The row of each key that was updated last (NULL counts as earliest), of two the one with the larger id."""
    order = F.struct(F.col(updated).isNotNull(), F.col(updated), F.col(entity))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r_")).select(key, "r_.*")


def event_on_either_day(events: DataFrame, starts: DataFrame) -> DataFrame:
    """start_id and event_id: the event on the start's day in the east of the US, else on its UTC day; the smallest id of a day's.

    events: event_id, event_date; starts: start_id, start (UTC timestamp).
    """
    local = F.to_date(F.from_utc_timestamp("start", "America/New_York"))
    days = F.array_distinct(F.array(local, F.to_date("start")))
    asked = starts.select("start_id", F.posexplode(days).alias("r_", "event_date"))
    first = events.groupBy("event_date").agg(F.min("event_id").alias("event_id"))  # so a start meets one row a day
    return asked.join(first, "event_date").groupBy("start_id").agg(F.min(F.struct("r_", "event_id")).alias("m_")).select("start_id", F.col("m_.event_id").alias("event_id"))


def by_priority(people: DataFrame, ranked: DataFrame, on_card: DataFrame) -> DataFrame:
    """people with place: ranked now go first, then those on an upcoming card, then those with a photo, then by name and id.

    Only ids flag; places are counted within ranges of the order, not in one task.
    """
    flag = lambda ids, name: ids.select("id").distinct().withColumn(name, F.lit(True))
    at = people.join(flag(ranked, "ranked_"), "id", "left").join(flag(on_card, "card_"), "id", "left")
    group = F.when(F.col("ranked_"), 0).when(F.col("card_"), 1).when(F.col("photo").isNotNull(), 2).otherwise(3)
    order = ("group", "name", "id")
    parts = int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = at.withColumn("group", group).repartitionByRange(parts, *order).select(F.spark_partition_id().alias("part_"), *order)
    dealt = staged(dealt, "priority")  # its ranges are fixed with it
    before = dealt.groupBy("part_").agg(F.count("*").alias("n_")).withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).drop("n_")  # a row for each range
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return dealt.withColumn("own_", own).join(F.broadcast(before), "part_").select("id", "group", (F.col("before_") + F.col("own_")).alias("place"))


def key_counts(bouts: DataFrame, keys: tuple[str, str] = ("red_fighter_id", "blue_fighter_id")) -> DataFrame:
    """id and n, how often it stands in either corner."""
    return bouts.select(F.explode(F.array(*keys)).alias("id")).filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"))


def sum_if_seen(rows: DataFrame, by: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Sums of landed and attempted where a row has both; NULL where none has, which is not 0."""
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    return rows.groupBy(by).agg(*[F.sum(F.when(both(a, b), F.col(c))).alias(c) for a, b in pairs for c in (a, b)])


def source_report(people: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """source, n and how many rows each flag holds for, in one aggregation; a missing source is '(none)'."""
    return people.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def with_parent(children: DataFrame, parents: DataFrame, keys: list[str], parent: str) -> DataFrame:
    """children all of whose keys (NULL ones aside) have a parent; the others are orphans that a clean-up drops."""
    ids = parents.select(F.col(parent).alias("p_")).distinct()
    out = children
    for k in keys:
        lost = out.filter(F.col(k).isNotNull()).select(F.col(k).alias("p_")).distinct().join(ids, "p_", "left_anti")
        out = out.join(lost, out[k] == lost["p_"], "left_anti")
    return out


def childless(parents: DataFrame, parent: str, children: DataFrame, key: str) -> DataFrame:
    """Parents that no child refers to."""
    return parents.join(children.select(F.col(key).alias(parent)).distinct(), parent, "left_anti")


def homonym_free(people: DataFrame, name: str) -> DataFrame:
    """People whose name, case aside, no other has; one window, no self join."""
    return people.withColumn("n_", F.count("*").over(Window.partitionBy(F.lower(name)))).filter("n_ = 1").drop("n_")


def nearest_event(events: DataFrame, day: str, key: str, as_of: Column, before: int = 1, after: int = 7) -> DataFrame:
    """The earliest event from `before` days before as_of to `after` behind it; of a day's the smallest id."""
    return events.filter(F.col(day).between(F.date_sub(as_of, before), F.date_add(as_of, after))).orderBy(day, key).limit(1)


def freshness(samples: DataFrame, key: str, ts: str, as_of: Column) -> DataFrame:
    """key, newest, age in whole seconds and n of each key's samples."""
    return samples.groupBy(key).agg(F.max(ts).alias("newest"), F.count("*").alias("n")).withColumn("age", F.unix_seconds(as_of) - F.unix_seconds(F.col("newest").cast("timestamp")))


def differences(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, with only_a and only_b."""
    left, right = (df.select(*key).distinct().withColumn(c, F.lit(True)) for df, c in ((a, "a_"), (b, "b_")))
    both = left.join(right, key, "full_outer").filter("a_ IS NULL OR b_ IS NULL")
    return both.select(*key, F.col("b_").isNull().alias("only_a"), F.col("a_").isNull().alias("only_b"))


def pair_groups(rows: DataFrame, ids: tuple[str, str], names: tuple[str, str], least: int = 2) -> DataFrame:
    """lo, hi and n of pairs, by id or, without one, by lower-case name, that occur `least` times in either order. Where one side is
    unknown the other stands for both, as LEAST and GREATEST pass over NULL."""
    one, two = (F.coalesce(F.col(i).cast("string"), F.lower(n)) for i, n in zip(ids, names, strict=True))
    return rows.groupBy(F.least(one, two).alias("lo"), F.greatest(one, two).alias("hi")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def counts_where(rows: DataFrame, by: str, flags: dict[str, Column], distinct: dict[str, str]) -> DataFrame:
    """by, how many rows each flag holds for, and how many different values each column has, in one aggregation."""
    return rows.groupBy(by).agg(*[F.count_if(c).alias(k) for k, c in flags.items()], *[F.countDistinct(c).alias(k) for k, c in distinct.items()])
