"""Queries on merges over all tables, and on plans that are applied."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contestry.operators import applying, merge, merging
from contestry.plans.registry import query
from contestry.sources.proxy import table

REGISTRY = [merging.Reference("orders", "custkey", "customer", "orderkey", ("custkey", "day")), merging.Reference("lines", "orderkey", "orders", "line", ("orderkey", "partkey"))]


@query("""WITH m AS (SELECT c_custkey loser, c_custkey - c_custkey % 10 + 3 keeper FROM customer WHERE c_custkey % 10 IN (1, 2)),
  c AS (SELECT c_custkey id, CASE WHEN c_custkey % 20 <> 3 THEN c_mktsegment END phone, CASE WHEN c_custkey % 10 <> 3 AND c_custkey % 30 <> 1 THEN c_name END AS name FROM customer),
  kept AS (SELECT coalesce(keeper, id) id, arg_min(phone, (keeper IS NOT NULL, id)) FILTER (phone IS NOT NULL) phone, arg_min(name, (keeper IS NOT NULL, id)) FILTER (name IS NOT NULL) AS name FROM c LEFT JOIN m ON loser = id GROUP BY 1),
  o AS (SELECT o_orderkey id, coalesce(keeper, o_custkey) ck, keeper IS NOT NULL moved, date_trunc('month', o_orderdate) AS day FROM orders LEFT JOIN m ON loser = o_custkey),
  o2 AS (SELECT *, row_number() OVER w i, first_value(id) OVER w f FROM o WINDOW w AS (PARTITION BY ck, day ORDER BY moved, id)),
  l AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) id, CASE WHEN moved AND i > 1 THEN f ELSE l_orderkey END ok, moved AND i > 1 AS went, l_partkey FROM lineitem JOIN o2 ON o2.id = l_orderkey),
  l2 AS (SELECT *, row_number() OVER (PARTITION BY ok, l_partkey ORDER BY went, id) j FROM l)
  SELECT 'customer' AS tbl, id::VARCHAR AS id, NULL::BIGINT AS ref, coalesce(phone, '-') || '|' || coalesce(name, '-') AS said FROM kept
  UNION ALL SELECT 'orders', id::VARCHAR, ck, '' FROM o2 WHERE NOT (moved AND i > 1) UNION ALL SELECT 'lines', id, ok, '' FROM l2 WHERE NOT (went AND j > 1)""")
def merged_everywhere(spark, d):
    """Customers merged in chains of three, their orders (one a customer and month where a merge moves one) and the lines of those."""
    k = F.col("c_custkey")
    customers = table(spark, d, "customer").select(k.alias("custkey"), F.when(k % 20 != 3, F.col("c_mktsegment")).alias("phone"), F.when((k % 10 != 3) & (k % 30 != 1), F.col("c_name")).alias("name"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.date_trunc("month", "o_orderdate").alias("day"))
    lines = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line"), F.col("l_orderkey").alias("orderkey"), F.col("l_partkey").alias("partkey")).distinct()
    chain = table(spark, d, "customer").filter(k % 10 < 3).filter(k % 10 > 0).select(k.alias("loser"), (k + 1).alias("keeper"))
    got = merging.merged_everywhere({"customer": customers, "orders": orders, "lines": lines}, "customer", "custkey", chain, REGISTRY)
    none = F.lit(None).cast("bigint")
    said = F.concat(F.coalesce("phone", F.lit("-")), F.lit("|"), F.coalesce("name", F.lit("-")))
    rows = got["customer"].select(F.lit("customer").alias("tbl"), F.col("custkey").cast("string").alias("id"), none.alias("ref"), said.alias("said"))
    rows = rows.unionByName(got["orders"].select(F.lit("orders").alias("tbl"), F.col("orderkey").cast("string").alias("id"), F.col("custkey").alias("ref"), F.lit("").alias("said")))
    return rows.unionByName(got["lines"].select(F.lit("lines").alias("tbl"), F.col("line").alias("id"), F.col("orderkey").alias("ref"), F.lit("").alias("said")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 2 THEN 'new' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 7 <> 0
  UNION ALL SELECT c_custkey, 'added' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0""")
def applied_plan(spark, d):
    """A table after a plan with inserts, updates and deletes was applied to it."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    name, k = f"customers_{uuid.uuid4().hex}", F.col("c_custkey")
    applying.create(c.filter(k % 5 > 0), name, "c_custkey")
    changed = c.filter((k % 5 > 0) & (k % 7 != 0)).withColumn("segment", F.when(k % 7 == 2, "new").otherwise(F.col("segment"))).unionByName(c.filter((k % 5 == 0) & (k % 2 == 0)).withColumn("segment", F.lit("added")))
    applying.apply(spark, applying.planned(spark, name, changed, "c_custkey"))
    return applying.stored(spark, name)


@query("""WITH s AS (SELECT c_custkey k, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END n, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END b, c_custkey % 3 m FROM customer WHERE c_custkey % 7 > 0),
  i AS (SELECT c_custkey k, CASE WHEN c_custkey % 2 > 0 THEN c_nationkey + 100 END n, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal + 1 END b, c_custkey % 2 m FROM customer WHERE c_custkey % 6 > 0)
  SELECT coalesce(s.k, i.k) k, CASE WHEN i.k IS NULL THEN s.n ELSE i.n END overwritten, coalesce(s.n, i.n) first_n, coalesce(i.b, s.b) new_b,
    CASE WHEN s.k IS NULL THEN CASE WHEN i.m = 0 THEN 'a=1.5;c=' || i.k ELSE '' END WHEN i.k IS NULL THEN CASE WHEN s.m > 0 THEN 'a=' || s.k || ';b=0.5' ELSE '' END
      WHEN s.m > 0 AND i.m = 0 THEN 'a=1.5;b=0.5;c=' || s.k WHEN s.m > 0 THEN 'a=' || s.k || ';b=0.5' WHEN i.m = 0 THEN 'a=1.5;c=' || s.k ELSE '' END merged
  FROM s FULL JOIN i USING (k)""")
def typed_rules(spark, d):
    """Rules that keep the column's type: overwrite even by NULL, first writer, new wins if present, maps key by key."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    text = k.cast("string")
    side = lambda n, b, m: c.select(k.alias("k"), n.alias("overwritten"), n.alias("first_n"), b.alias("new_b"), m.alias("merged"))
    one = F.when(k % 3 > 0, F.create_map(F.lit("a"), text, F.lit("b"), F.lit("0.5")))
    two = F.when(k % 2 == 0, F.create_map(F.lit("c"), text, F.lit("a"), F.lit("1.5")))
    stored = side(F.when(k % 4 > 0, F.col("c_nationkey")), F.when(k % 5 > 0, F.col("c_acctbal")), one).filter("k % 7 > 0")
    incoming = side(F.when(k % 2 > 0, F.col("c_nationkey") + 100), F.when(k % 3 > 0, F.col("c_acctbal") + 1), two).filter("k % 6 > 0")
    got = merge.merge_upsert(stored, incoming, ["k"], {"overwritten": "incoming", "first_n": "first_writer", "new_b": "new_wins_if_present", "merged": "key_merge"})
    pairs = F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return got.select("k", "overwritten", "first_n", "new_b", F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias("merged"))
