"""Merges of duplicate entities over all tables that refer to them: chains contracted, children moved, keepers filled.

A registry says which table refers to which, so tables are walked parents first: a child that moves onto a keeper's child of the
same unique key goes, and what refers to it is moved in turn. Everything is planned; nothing is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.sources.staged import staged


@dataclass(frozen=True)
class Reference:
    """Column of a table that holds a parent's key. unique: columns of the table of which two rows may not have the same values, all known (none: ()
    ); key: the table's own key."""

    table: str
    column: str
    parent: str
    key: str
    unique: tuple[str, ...] = ()


def contracted(merged: DataFrame) -> DataFrame:
    """loser and keeper with chains contracted, so that no keeper is a loser: each round doubles the length of the chains that it has dealt with.

    A loser has one keeper. Merges in a circle raise a ValueError, as no one would be left.
    """
    now = staged(merged.select("loser", "keeper").distinct(), "merged")
    rounds = now.count().bit_length() + 1
    for _ in range(rounds):
        step = now.select(F.col("loser").alias("keeper"), F.col("keeper").alias("next"))
        on = now.join(step, "keeper", "left").select("loser", F.coalesce("next", "keeper").alias("keeper"), F.col("next").isNotNull().alias("moved"))
        on = staged(on, "merged")
        now = on.select("loser", "keeper")
        if on.filter("moved").isEmpty():
            return now
    raise ValueError(f"merges in a circle: {now.join(now.select(F.col('loser').alias('keeper')), 'keeper', 'left_semi').first()}")


def filled_keepers(entities: DataFrame, key: str, merged: DataFrame) -> DataFrame:
    """entities without losers; what a keeper doesn't know comes from its losers, column by column, the smallest id first."""
    at = entities.join(merged.select(F.col("loser").alias(key), F.col("keeper").alias("to_")), key, "left").withColumns({"moved_": F.col("to_").isNotNull(), "to_": F.coalesce("to_", key)})
    place = F.struct("moved_", key)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    kept = at.groupBy("to_").agg(F.min("moved_").alias("gone_"), *[first(c) for c in entities.columns if c != key])
    return kept.filter("NOT gone_").select(*[F.col("to_").alias(key) if c == key else c for c in entities.columns])


def order_of(registry: list[Reference], root: str) -> list[str]:
    """The tables below root, each after all its parents; a circle raises a ValueError."""
    below = {root}
    while more := {r.table for r in registry if r.parent in below} - below:
        below |= more
    out, left = [], below - {root}
    while left:
        free = sorted(t for t in left if not any(r.table == t and r.parent in left for r in registry))
        if not free:
            raise ValueError(f"tables that refer to each other in a circle: {sorted(left)}")
        out += free
        left -= set(free)
    return out


def moved(rows: DataFrame, references: list[Reference], losers: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """rows that refer to keepers only, and loser and keeper of rows that went because a keeper's row, or one that moved there with a
    smaller key, has their unique values. Rows that didn't move never go."""
    key, at, went = references[0].key, rows, F.lit(False)
    for i, r in enumerate(references):
        at = at.join(losers[r.parent].select(F.col("loser").alias(r.column), F.col("keeper").alias(f"to_{i}")), r.column, "left")
        went = went | F.col(f"to_{i}").isNotNull()
    at = at.withColumn("moved_", went).withColumns({r.column: F.coalesce(f"to_{i}", r.column) for i, r in enumerate(references)}).select(*rows.columns, "moved_")
    first: Column = F.lit(None).cast(rows.schema[key].dataType)
    for unique in {r.unique for r in references if r.unique}:
        known = F.lit(True)
        for c in unique:
            known &= F.col(c).isNotNull()
        same = Window.partitionBy(*unique, F.when(~known, F.col(key))).orderBy("moved_", key)
        first = F.coalesce(first, F.when(F.col("moved_") & (F.row_number().over(same) > 1), F.first(key).over(same)))
    at = staged(at.withColumn("first_", first), "moved")
    return at.filter("first_ IS NULL").select(*rows.columns), at.filter(F.col("first_") != F.col(key)).select(F.col(key).alias("loser"), F.col("first_").alias("keeper"))


def merged_everywhere(tables: dict[str, DataFrame], root: str, key: str, merged: DataFrame, registry: list[Reference]) -> dict[str, DataFrame]:
    """The planned form of root and of every table below it. merged: loser and keeper, chains allowed."""
    losers = {root: contracted(merged)}
    out = {root: filled_keepers(tables[root], key, losers[root])}
    for t in order_of(registry, root):
        out[t], gone = moved(tables[t], [r for r in registry if r.table == t and r.parent in losers], losers)
        losers[t] = contracted(gone)
    return out
