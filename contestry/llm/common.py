"""What the text operators share: reading, folds, and tables written between steps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this package, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"


#: Rows, and bytes of rows, that pass to Python at once; a row may be a very long text.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold no more than ROWS_AT_ONCE rows and BYTES_AT_ONCE bytes, or one row."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_AT_ONCE)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where nothing is set and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Bytes of a row group of rows that are megabytes each. A task holds a group as it writes, and all of it decoded as it reads; by
#: default a group's size is looked at only after 100 rows.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def written(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read back. large: its rows are megabytes each.

    It cuts the lineage, is computed once however often it is read, and outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.options(**LARGE_ROWS) if large else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that join_hot() broadcasts at most.
MOST_HOT = 4096


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows with the columns of their group; groups has one row for each combination of keys, which are not null, and its count of rows.

    The MOST_HOT largest groups are broadcast, so no task gets all rows of one of them; any other group has at most one
    MOST_HOT-th of the rows and is joined by a shuffle.
    """
    hot = groups.orderBy(F.desc(size), *keys).limit(MOST_HOT)
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("hot_"))), keys, "left")
    # Names of the broadcast side end in "_" so that both forms have the same columns in the same order.
    named = hot.select(*[F.col(k) if k in keys else F.col(k).alias(f"{k}_") for k in groups.columns])
    near = rows.join(F.broadcast(named), keys).select(*rows.columns, *[F.col(f"{k}_").alias(k) for k in groups.columns if k not in keys])
    far = marked.filter("hot_ IS NULL").drop("hot_").join(groups, keys).select(*rows.columns, *[k for k in groups.columns if k not in keys])
    return near.unionByName(far)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; rows with a null id go to fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % n, F.lit(0))


def give_back() -> None:
    """Return memory that a worker holds but doesn't use to the system: workers live on when a task ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
