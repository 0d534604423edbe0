"""Plans that are applied: staged, checked against the version that they were made on, swapped in by partition.

A table is a catalog table whose partitions are buckets of its key. A plan holds what a table is to become and a fingerprint of
each bucket that changes; apply() refuses if any of those is another by now, and otherwise replaces those buckets in one commit,
so readers see the old rows or the new ones, and a run that fails leaves the old.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.sources.staged import staged

BUCKET = "bucket_"


class Conflict(RuntimeError):
    """The table is no longer what the plan was made on."""


@dataclass(frozen=True)
class Plan:
    """table and key; rows: what the buckets that change are to hold; changes: key and change (insert, update, delete); version: count and hash by bucket."""

    table: str
    key: str
    buckets: int
    rows: DataFrame
    changes: DataFrame
    version: dict[int, tuple[int, int]]

    def summary(self) -> dict[str, int]:
        """What a dry run tells: how many rows of each change."""
        return {r["change"]: r["count"] for r in self.changes.groupBy("change").count().collect()}


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def digest(columns: list[str]) -> Column:
    """A hash of a row's columns that tells NULL from anything else."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def create(rows: DataFrame, table: str, key: str, buckets: int = 16) -> None:
    """rows as a table that plans can be applied to; the column of the bucket is the last one."""
    rows.withColumn(BUCKET, bucket(key, buckets)).write.partitionBy(BUCKET).format("parquet").saveAsTable(table)


def stored(spark: SparkSession, table: str) -> DataFrame:
    spark.catalog.refreshTable(table)
    return spark.table(table).drop(BUCKET)


def version(spark: SparkSession, table: str, only: list[int] | None = None) -> dict[int, tuple[int, int]]:
    """Count of rows and sum of their hashes by bucket: as many numbers as the table has partitions. The bucket's rows in any order give the same."""
    spark.catalog.refreshTable(table)
    rows = spark.table(table)
    at = rows.filter(F.col(BUCKET).isin(only)) if only is not None else rows
    each = at.groupBy(BUCKET).agg(F.count("*").alias("n"), F.sum(digest(rows.columns).cast("decimal(38,0)")).alias("h")).collect()
    return {r[BUCKET]: (r["n"], int(r["h"])) for r in each}


def planned(spark: SparkSession, table: str, rows: DataFrame, key: str, buckets: int = 16) -> Plan:
    """The plan that makes rows (unique keys, none null) of the table. The version is taken first, so a write while the plan is made is a conflict."""
    seen = version(spark, table)
    old = stored(spark, table)
    columns = old.columns
    new = staged(rows.select(*columns), "planned")
    both = old.select(key, digest(columns).alias("old_")).join(new.select(key, digest(columns).alias("new_")), key, "full_outer")
    change = F.when(F.col("old_").isNull(), "insert").when(F.col("new_").isNull(), "delete").when(F.col("old_") != F.col("new_"), "update")
    changes = staged(both.select(key, change.alias("change"), bucket(key, buckets).alias(BUCKET)).filter("change IS NOT NULL"), "changes")
    touched = [r[0] for r in changes.select(BUCKET).distinct().collect()]
    return Plan(table, key, buckets, new.withColumn(BUCKET, bucket(key, buckets)).filter(F.col(BUCKET).isin(touched)), changes.drop(BUCKET), {b: seen.get(b, (0, 0)) for b in touched})


def overwrite(spark: SparkSession, rows: DataFrame, table: str) -> None:
    """Replaces the partitions that rows has, in one commit. An insert into a catalog table takes its mode from the session, which has it back afterwards."""
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)


def apply(spark: SparkSession, plan: Plan) -> dict[str, int]:
    """Replaces the buckets that the plan changes and gives the plan's summary; raises Conflict, with nothing changed, if one isn't what it was."""
    touched = sorted(plan.version)
    now = version(spark, plan.table, touched)
    if other := [b for b in touched if now.get(b, (0, 0)) != plan.version[b]]:
        raise Conflict(f"{plan.table}: buckets {other[:5]} are not what the plan was made on")
    if touched:
        overwrite(spark, plan.rows.select(*spark.table(plan.table).columns), plan.table)
        left = {r[0] for r in plan.rows.select(BUCKET).distinct().collect()}
        for b in touched:
            if b not in left:  # nothing replaces a bucket that is to be empty
                spark.sql(f"ALTER TABLE {plan.table} DROP IF EXISTS PARTITION ({BUCKET} = {b})")
        spark.catalog.refreshTable(plan.table)
    return plan.summary()
