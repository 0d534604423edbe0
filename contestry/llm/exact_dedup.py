"""Exact deduplication by 128-bit content hashes, with bytes compared inside groups; built-in expressions only.

Every row gets the MD5 of its normalised text. Rows with one hash are a group; the row that stays is the first in a fixed
order. The texts themselves are grouped by hash and bytes, each task sending a text that it has many times once; a hash
that more than one text has is a collision, and its rows are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.llm.common import SPACE, join_hot, table, written

Hash = Callable[[Column], Column]


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{SPACE}+", "")


def collisions(docs: DataFrame, text_col: str, content_hash: Hash) -> DataFrame:
    """hash and text of the normalised texts whose hash another text has too."""
    texts = docs.select(normalised(F.col(text_col)).alias("t")).select(content_hash(F.col("t")).alias("hash"), "t").groupBy("hash", "t").agg(F.lit(1).alias("one"))
    shared = written(texts.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "collided")
    if shared.isEmpty():
        return shared.withColumn("t", F.lit(None).cast("string"))
    return written(texts.join(shared, "hash", "left_semi").select("hash", "t"), "collisions")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Hash = md5_bytes) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, and the SHA-256 of the normalised text.

    Texts are equal if they are the same bytes without white space; null and empty texts, and those of white space alone,
    are equal. Of equal texts the one with the most characters before normalising stays, then the smallest doc_id, null after
    all others; of rows that repeat a doc_id with one text exactly one stays. Other columns of docs are left out; an empty
    table gives an empty one.
    """
    clash = collisions(docs, text_col, content_hash)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("size"), normalised(F.col(text_col)).alias("t")
    ).withColumns({"hash": content_hash(F.col("t")), "sha": F.unhex(F.sha2(F.col("t").cast("binary"), 256))})
    if clash.isEmpty():
        rows = rows.withColumn("variant", F.lit(0))
    else:
        variants = clash.withColumn("variant", F.row_number().over(Window.partitionBy("hash").orderBy("t")))
        rows = rows.join(variants, ["hash", "t"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))
    # From here on rows are some hundred bytes; a row's number is fixed with this table.
    rows = written(rows.select("row", "doc_id", "size", "hash", "variant", "sha"), "exact-rows")
    first = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = written(rows.groupBy("hash", "variant").agg(F.count("*").alias("group_size"), first.alias("first")), "exact-groups")
    out = join_hot(rows, groups.select("hash", "variant", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")), ["hash", "variant"], "group_size")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, by the rule of exact_copies() and with all its columns."""
    numbered = written(docs.withColumn("row_", F.monotonically_increasing_id()), "numbered")
    # The number stands in for the id, so rows that repeat an id are told apart; ids still decide as the second key.
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("row_").alias("row"))
    kept = exact_copies(numbered.select(key.alias("doc_id"), F.col(text_col).alias("text"))).filter("kept").select(F.col("doc_id.row").alias("row_"))
    return numbered.join(kept, "row_", "left_semi").drop("row_")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    return exact_copies(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH r AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM r WINDOW w AS (PARTITION BY t ORDER BY size DESC, doc_id)
"""
