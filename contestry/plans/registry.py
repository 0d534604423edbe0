"""All registered queries outside the training-data subpackage, by name, with their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contestry.functions import names
from contestry.functions import scalar as sc
from contestry.functions import text
from contestry.operators import audit, career, entity, history, lookups, merge, metrics, models, quality, series
from contestry.sources import documents
from contestry.sources.proxy import bouts, sides, table
from contestry.streaming import changes

BOUTS_SQL = """
side AS (SELECT l_orderkey bout_id, l_suppkey fighter_id, CAST(sum(l_quantity) AS BIGINT) attempted,
  CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) landed,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) cents FROM lineitem GROUP BY ALL),
ends AS (SELECT bout_id, min(fighter_id) r, max(fighter_id) b FROM side GROUP BY bout_id HAVING count(*) >= 2),
bouts AS (SELECT e.bout_id, CAST(o_orderdate AS DATE) event_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'KO/TKO' WHEN '2-HIGH' THEN 'SUB choke' WHEN '3-MEDIUM' THEN 'U-DEC' WHEN '4-NOT SPECIFIED' THEN 'Other' WHEN '5-LOW' THEN 'S-DEC' END AS method,
  CASE WHEN x.cents > y.cents THEN r WHEN y.cents > x.cents THEN b END winner_id,
  r red_fighter_id, x.attempted red_attempted, x.landed red_landed, b blue_fighter_id, y.attempted blue_attempted, y.landed blue_landed
  FROM ends e JOIN side x ON x.bout_id = e.bout_id AND x.fighter_id = r JOIN side y ON y.bout_id = e.bout_id AND y.fighter_id = b JOIN orders ON o_orderkey = e.bout_id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def same_sql(name: str, tables: str, sql: str) -> None:
    """A query that both engines read alike: Spark plans it over the tables' files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(re.sub(rf"(?<=FROM )({'|'.join(tables.split())})\b|(?<=JOIN )({'|'.join(tables.split())})\b", lambda m: "{" + m[0] + "}", sql), **{t: table(spark, sf_dir, t) for t in tables.split()})

    run.__name__ = name
    query(sql)(run)


@query(f"WITH {BOUTS_SQL} SELECT * FROM bouts")
def bouts_wide(spark, d):
    return bouts(spark, d)


@query(f"""WITH {BOUTS_SQL}, n AS (SELECT count(*) n, greatest(CAST(floor(count(*) * 0.8) AS BIGINT), 40) e0 FROM bouts), e AS (SELECT least(e0, greatest(n - 1, 0)) e FROM n),
  o AS (SELECT bout_id, row_number() OVER (ORDER BY event_date, bout_id) i FROM bouts)
  SELECT CASE WHEN i <= floor(e * 0.8) THEN 'train' WHEN i <= e THEN 'calibration' ELSE 'test' END AS split, count(*) n, min(bout_id) first_id FROM o, e GROUP BY ALL""")
def chronological_split(spark, d):
    return history.chronological_split(bouts(spark, d).select("bout_id", "event_date"), ["event_date", "bout_id"]).groupBy("split").agg(F.count("*").alias("n"), F.min("bout_id").alias("first_id"))


SNAP_SQL = """snaps AS (SELECT l_suppkey fighter_id, n_name division, CAST(date_trunc('month', l_shipdate) AS DATE) snapshot_date,
  row_number() OVER (PARTITION BY date_trunc('month', l_shipdate), n_name ORDER BY sum(CAST(round(l_extendedprice * 100) AS BIGINT)) DESC, l_suppkey) rank_position
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY l_suppkey, n_name, date_trunc('month', l_shipdate))"""


@query(f"""WITH {BOUTS_SQL}, {SNAP_SQL}, a AS (SELECT DISTINCT red_fighter_id fighter_id, n_name division, event_date anchor_date FROM bouts JOIN nation ON n_nationkey = red_fighter_id % 25),
  x AS (SELECT a.*, rank_position, row_number() OVER (PARTITION BY a.fighter_id, a.division, anchor_date ORDER BY (lower(s.division) = lower(a.division)) DESC, snapshot_date DESC, rank_position) i
  FROM a LEFT JOIN snaps s ON s.fighter_id = a.fighter_id AND snapshot_date < anchor_date) SELECT fighter_id, division, anchor_date, rank_position ranking_position FROM x WHERE i = 1""")
def ranking_as_of(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    cents = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("fighter_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("snapshot_date")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    home = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("fighter_id"), F.col("n_name").alias("division"))
    rank = F.row_number().over(Window.partitionBy("snapshot_date", "division").orderBy(F.desc("cents"), "fighter_id"))
    snaps = cents.join(home, "fighter_id").withColumn("rank_position", rank.cast("bigint"))
    anchors = bouts(spark, d).join(F.broadcast(nation), F.col("red_fighter_id") % 25 == F.col("n_nationkey")).select(F.col("red_fighter_id").alias("fighter_id"), F.col("n_name").alias("division"), F.col("event_date").alias("anchor_date")).distinct()
    return career.latest_rank(anchors, snaps).withColumnRenamed("ranking", "ranking_position")


@query(f"""WITH {BOUTS_SQL} SELECT bout_id, method, CASE WHEN lower(method) LIKE '%ko%' THEN 'KO' WHEN lower(method) LIKE 'sub%' THEN 'SUB' WHEN lower(method) LIKE '%-dec%' THEN 'DEC' END method_class FROM bouts""")
def method_classes(spark, d):
    return bouts(spark, d).select("bout_id", "method", sc.method_class(F.col("method")).alias("method_class"))


@query("""WITH s AS (SELECT o_orderkey k, o_orderstatus st, CAST(round(o_totalprice * 100) AS BIGINT) cents, nullif(o_orderpriority, '5-LOW') pr FROM orders WHERE o_orderkey % 3 <> 0),
  i AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 4 = 0 THEN 'F' ELSE NULL END st, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE -5 END cents, o_orderpriority pr FROM orders WHERE o_orderkey % 3 <> 1)
  SELECT k, CASE WHEN s.k IS NULL THEN i.st WHEN s.st = 'F' THEN 'F' ELSE coalesce(i.st, s.st) END st, CASE WHEN s.k IS NULL THEN i.cents ELSE greatest(s.cents, i.cents) END cents,
  CASE WHEN s.k IS NULL THEN i.pr ELSE coalesce(s.pr, i.pr) END pr, CASE WHEN s.k IS NULL THEN 'insert' WHEN i.k IS NULL THEN 'keep' ELSE 'update' END change FROM s FULL JOIN i USING (k)""")
def merge_policies(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), F.col("o_orderpriority").alias("pr"))
    stored = o.filter("k % 3 <> 0").withColumn("pr", F.nullif("pr", F.lit("5-LOW")))
    incoming = o.filter("k % 3 <> 1").withColumns({"st": F.when(F.col("k") % 4 == 0, "F"), "cents": F.col("cents") + F.when(F.col("k") % 2 == 0, 5).otherwise(-5)})
    return merge.merge_upsert(stored, incoming, ["k"], {"st": merge.sticky("F"), "cents": "monotonic", "pr": "stored_wins"})


SCORED_SQL = "scored AS (SELECT d.doc_id, lang, quality y, (n_chars % 1000) / 1000.0::DOUBLE p FROM documents d JOIN labels USING (doc_id))"


def scored(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("p"))


@query(f"WITH {SCORED_SQL} SELECT coalesce(lang, 'Unknown') segment, count(*) n, round(avg(CASE WHEN (p >= 0.5)::INT = y THEN 1 ELSE 0 END), 6) accuracy, round(avg((p - y) ** 2), 6) brier, round(avg(y), 6) observed FROM scored GROUP BY ALL")
def segment_metrics(spark, d):
    return metrics.segment_metrics(scored(spark, d), "lang")


@query(f"WITH {SCORED_SQL} SELECT CAST(b.i AS INTEGER) bin, count(p) n, round(avg(p), 6) mean_p, round(avg(y), 6) observed FROM range(10) b(i) LEFT JOIN scored ON len(list_filter([0.1, 0.2, 0.1 * 3::DOUBLE, 0.4, 0.5, 0.1::DOUBLE * 6, 0.1::DOUBLE * 7, 0.8, 0.9]::DOUBLE[], lambda e: p >= e)) = b.i GROUP BY b.i")
def calibration_table(spark, d):
    return metrics.calibration_table(scored(spark, d))


@query(f"WITH {SCORED_SQL}, c AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) w FROM scored a, scored b WHERE a.y = 1 AND b.y = 0), t AS (SELECT CAST(sum(y) AS BIGINT) a, CAST(count(*) - sum(y) AS BIGINT) b FROM scored) SELECT round(w / (a * b), 6) auc, a positives, b negatives FROM c, t")
def auc_midranks(spark, d):
    return metrics.auc(scored(spark, d))


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w p, row_number() OVER w i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE i = 1 OR p IS DISTINCT FROM event_type""")
def changed_samples(spark, d):
    return series.changed_samples(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query("""WITH r AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'click'), s AS (SELECT user_id, ts, max(event_id) state_id FROM events WHERE event_type = 'click' GROUP BY ALL)
  SELECT event_id, r.user_id, r.ts, (SELECT max_by(state_id, s.ts) FROM s WHERE s.user_id = r.user_id AND s.ts <= r.ts) state_id FROM r""")
def capture_as_of(spark, d):
    e = table(spark, d, "events")
    states = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("state_id"))
    return series.as_of(e.filter("event_type <> 'click'").select("event_id", "user_id", "ts"), states, "user_id", "ts", "state_id")


@query(f"WITH {BOUTS_SQL} SELECT DISTINCT s_suppkey fighter_id, s_name AS name FROM supplier JOIN bouts ON s_suppkey = red_fighter_id OR s_suppkey = blue_fighter_id")
def or_join(spark, d):
    either = bouts(spark, d).select(F.explode(F.array("red_fighter_id", "blue_fighter_id")).alias("s_suppkey")).distinct()
    return table(spark, d, "supplier").join(either, "s_suppkey", "left_semi").select(F.col("s_suppkey").alias("fighter_id"), F.col("s_name").alias("name"))


@query("""SELECT CAST(l_orderkey AS BIGINT) bout_id, count(DISTINCT l_linenumber) done FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2) GROUP BY ALL""")
def completeness(spark, d):
    full = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_suppkey").alias("n")).filter("n >= 2")
    return full.groupBy(F.col("l_orderkey").alias("bout_id")).agg(F.count("*").alias("done"))


@query("""WITH c AS (SELECT e.event_id id, trim(regexp_replace(lower(event_type || ' / ' || c_name), '[^a-z0-9]+', ' ', 'g')) AS key, e.user_id % 5 AS b FROM events e JOIN customer ON c_custkey = user_id)
  SELECT key, count(*) n, min(id) keeper, count(DISTINCT b) > 1 homonyms, array_to_string(list_sort(list(id)), ',') ids FROM c GROUP BY ALL HAVING count(*) > 1""")
def duplicate_names(spark, d):
    e = table(spark, d, "events").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("user_id"))
    c = e.select(F.col("event_id").alias("id"), sc.alnum_name(F.concat_ws(" / ", "event_type", "c_name")).alias("key"), (F.col("user_id") % 5).alias("b"))
    return quality.duplicate_names(c, "key", "id", "b").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


same_sql("not_in_null_aware", "customer orders", "SELECT 'with null' AS list, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders WHERE o_orderkey % 50 = 0 OR o_custkey = 1) UNION ALL SELECT 'without' AS list, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark, d):
    return lookups.childless(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 5 > 0 LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 7 > 0 WHERE (l_suppkey % 10 = 0 OR s_suppkey IS NOT NULL) AND o_orderkey IS NOT NULL")
def cleaned_orphans(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 10 > 0, F.col("l_suppkey")).alias("s"))
    owned = lookups.with_parent(lines, table(spark, d, "orders").filter("o_orderkey % 7 > 0"), ["l_orderkey"], "o_orderkey")
    return lookups.with_parent(owned, table(spark, d, "supplier").filter("s_suppkey % 5 > 0"), ["s"], "s_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT event_id, k FROM (SELECT event_id, upper(event_type) || user_id % 400 || event_id % 5 k, count(*) OVER (PARTITION BY lower(event_type || user_id % 400 || event_id % 5)) n FROM events) WHERE n = 1")
def unique_names(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.upper("event_type"), (F.col("user_id") % 400).cast("string"), (F.col("event_id") % 5).cast("string")).alias("k"))
    return lookups.homonym_free(e, "k")


same_sql("main_line_done", "lineitem", "SELECT l_orderkey, min(l_linenumber) AS main_line, min(lpad(CAST(l_linenumber AS STRING), 9, '0') || l_returnflag) AS flag FROM lineitem WHERE l_linestatus <> 'F' GROUP BY l_orderkey")
same_sql("null_safe_filter", "orders", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'")
@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 1000) AS big, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority")
def conditional_counts(spark, d):
    return lookups.counts_where(table(spark, d, "orders"), "o_orderpriority", {"f": F.col("o_orderstatus") == "F", "big": F.col("o_totalprice") > 1000}, {"customers": "o_custkey"})


@query("SELECT user_id, count(*) n, CAST(epoch(TIMESTAMP '2024-03-01 00:00:00') - floor(epoch(max(ts))) AS BIGINT) age FROM events GROUP BY user_id")
def freshness(spark, d):
    return lookups.freshness(table(spark, d, "events"), "user_id", "ts", F.lit("2024-03-01").cast("timestamp")).drop("newest")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, 'CRITICAL' severity FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_slots(spark, d):
    return audit.duplicate_slots(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH p AS (SELECT coalesce(CAST(CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 40 END AS VARCHAR), CASE WHEN l_partkey % 2 = 0 THEN lower('N' || l_suppkey) END) a, coalesce(CAST(CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey END AS VARCHAR), lower('N' || l_suppkey)) b FROM lineitem) SELECT least(a, b) lo, greatest(a, b) hi, count(*) n FROM p GROUP BY ALL HAVING count(*) > 1")
def pair_groups(spark, d):
    p, k = F.col("l_partkey"), F.col("l_suppkey")
    name = F.concat(F.lit("N"), k.cast("string"))
    rows = table(spark, d, "lineitem").select(F.when(p % 3 > 0, p % 40).alias("a"), F.when(k % 4 > 0, k).alias("b"), F.when(p % 2 == 0, name).alias("x"), name.alias("y"))
    return lookups.pair_groups(rows, ("a", "b"), ("x", "y"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-09' ORDER BY CAST(o_orderdate AS DATE), o_orderkey LIMIT 1")
def nearest_event(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return lookups.nearest_event(o, "day", "o_orderkey", F.lit("1998-01-02").cast("date")).select("o_orderkey")


same_sql("key_sets", "orders customer", "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
@query("WITH a AS (SELECT DISTINCT least(o_orderkey % 30, o_custkey % 30) lo, greatest(o_orderkey % 30, o_custkey % 30) hi FROM orders), b AS (SELECT DISTINCT least(l_partkey % 30, l_suppkey % 30) lo, greatest(l_partkey % 30, l_suppkey % 30) hi FROM lineitem WHERE l_quantity > 25) SELECT lo, hi, b.f IS NULL only_a, a.f IS NULL only_b FROM (SELECT *, 1 f FROM a) a FULL JOIN (SELECT *, 1 f FROM b) b USING (lo, hi) WHERE a.f IS NULL OR b.f IS NULL")
def readiness_diff(spark, d):
    pair = lambda df, a, b: df.select(F.least(F.col(a) % 30, F.col(b) % 30).alias("lo"), F.greatest(F.col(a) % 30, F.col(b) % 30).alias("hi"))
    return lookups.differences(pair(table(spark, d, "orders"), "o_orderkey", "o_custkey"), pair(table(spark, d, "lineitem").filter("l_quantity > 25"), "l_partkey", "l_suppkey"), ["lo", "hi"])


@query("""SELECT l_orderkey AS bout_id, CAST(sum(l_quantity) AS BIGINT) total, max(l_linenumber) last_round, count(DISTINCT l_linenumber) = max(l_linenumber) whole FROM lineitem GROUP BY ALL""")
def rounds_reconcile(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("bout_id")).agg(F.sum("l_quantity").cast("bigint").alias("total"), F.max("l_linenumber").alias("last_round"), F.array_sort(F.collect_set("l_linenumber")).alias("r")).select("bout_id", "total", "last_round", (F.size("r") == F.col("last_round")).alias("whole"))


@query(f"WITH {BOUTS_SQL} SELECT bout_id, count(*) sides, CAST(sum(attempted) AS BIGINT) attempted FROM side SEMI JOIN bouts USING (bout_id) GROUP BY ALL")
def career_totals(spark, d):
    return sides(spark, d).join(bouts(spark, d).select("bout_id"), "bout_id", "left_semi").groupBy("bout_id").agg(F.count("*").alias("sides"), F.sum("attempted").alias("attempted"))


@query(f"""WITH {BOUTS_SQL}, o AS (SELECT bout_id, row_number() OVER (ORDER BY event_date, bout_id) i, count(*) OVER () n FROM bouts),
  f AS (SELECT *, unnest([1, 2, 3]) fold FROM o)
  SELECT fold, CASE WHEN i <= n * fold // 4 THEN 'train' ELSE 'validate' END AS role, count(*) n, min(bout_id) first_id FROM f WHERE i <= n * (fold + 1) // 4 GROUP BY ALL""")
def walk_forward_folds(spark, d):
    folds = history.walk_forward(bouts(spark, d).select("bout_id", "event_date"), ["event_date", "bout_id"], 3)
    return folds.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("bout_id").alias("first_id"))


@query("""SELECT c_mktsegment || ' ' || CAST(round(c_acctbal) AS BIGINT) k, min(c_custkey) c_custkey FROM customer WHERE c_acctbal IS NOT NULL GROUP BY ALL HAVING count(DISTINCT c_custkey) = 1""")
def unambiguous_index(spark, d):
    c = table(spark, d, "customer").withColumn("k", F.concat_ws(" ", "c_mktsegment", F.round("c_acctbal").cast("bigint")))
    return entity.unambiguous_index(c.filter("c_acctbal IS NOT NULL"), "k", "c_custkey")


@query("""WITH p AS (SELECT l_orderkey, l_suppkey, max(CAST(round(l_discount * 100) AS BIGINT)) score FROM lineitem GROUP BY ALL),
  r AS (SELECT *, row_number() OVER w i, lead(score) OVER w s2 FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_suppkey DESC))
  SELECT l_orderkey, l_suppkey, score FROM r WHERE i = 1 AND score >= 5 AND (s2 IS NULL OR s2 < 5 OR score - s2 >= 2)""")
def best_unambiguous(spark, d):
    scored_pairs = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_discount") * 100).cast("bigint").alias("score"))
    return entity.best_unambiguous(scored_pairs, "l_orderkey", "l_suppkey", "score", 5, 2)


KEEPER_SQL = """e AS (SELECT s_suppkey id, s_nationkey * 10 + s_suppkey % 10 k, CAST(round(s_acctbal * 100) AS BIGINT) cents, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 3 END born FROM supplier),
  g AS (SELECT k, arg_min(id, (-cents, id)) keeper FROM e GROUP BY k HAVING count(*) > 1 AND count(DISTINCT born) <= 1),
  m AS (SELECT id loser, keeper FROM e JOIN g USING (k) WHERE id <> keeper)"""


def duplicate_suppliers(spark, d):
    s = F.col("s_suppkey")
    e = table(spark, d, "supplier").select(s.alias("id"), (F.col("s_nationkey") * 10 + s % 10).alias("k"), F.round(F.col("s_acctbal") * 100).cast("bigint").alias("cents"), F.when(s % 4 != 0, s % 3).alias("born"))
    return entity.keepers(e, "k", "id", [F.col("cents")], ["born"])


@query(f"WITH {KEEPER_SQL} SELECT * FROM m")
def duplicate_keepers(spark, d):
    return duplicate_suppliers(spark, d)


@query(f"""WITH {KEEPER_SQL}, c AS (SELECT l_orderkey, l_suppkey, l_linenumber, coalesce(keeper, l_suppkey) s2, keeper IS NOT NULL moved FROM lineitem LEFT JOIN m ON loser = l_suppkey)
  SELECT l_orderkey, s2 l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, s2 ORDER BY moved, l_linenumber) i FROM c) WHERE i = 1""")
def merge_children(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    return entity.repoint(lines, "l_suppkey", duplicate_suppliers(spark, d), ["l_orderkey", "l_suppkey"], ["l_linenumber"])


@query("""WITH n AS (SELECT c_custkey, lower(n_name) || ' ' || lower(c_mktsegment) || CASE c_custkey % 3 WHEN 0 THEN ' jr' WHEN 1 THEN '' ELSE ' x' END a,
    CASE c_custkey % 2 WHEN 0 THEN substr(lower(n_name), 1, 4) ELSE lower(n_name) END || ' ' || lower(c_mktsegment) b FROM customer JOIN nation ON n_nationkey = c_nationkey),
  t AS (SELECT *, string_split(a, ' ') x, string_split(b, ' ') y FROM n)
  SELECT c_custkey, (len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 OR len(list_filter(y, lambda v: NOT list_contains(x, v))) = 0)
      AND len(list_distinct(list_filter(x, lambda v: list_contains(y, v) AND length(v) >= 2 AND v NOT IN ('al','da','das','de','del','der','di','do','dos','du','el','ii','iii','jr','la','le','los','sr','st','van','von')))) >= 2 is_subset,
    len(x) = len(y) AND len(x) >= 2 AND x[2:] = y[2:] AND x[1] <> y[1] AND (starts_with(x[1], y[1]) OR starts_with(y[1], x[1])) AND least(length(x[1]), length(y[1])) >= 4 is_diminutive FROM t""")
def name_matches(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k, segment = F.col("c_custkey"), F.lower("c_mktsegment")
    a = F.concat("nation", F.lit(" "), segment, F.when(k % 3 == 0, " jr").when(k % 3 == 1, "").otherwise(" x"))
    b = F.concat(F.when(k % 2 == 0, F.substring("nation", 1, 4)).otherwise(F.col("nation")), F.lit(" "), segment)
    return c.select("c_custkey", names.subset_match(a, b).alias("is_subset"), names.diminutive_match(a, b).alias("is_diminutive"))


@query("""SELECT o_orderkey, CAST(round((4 + o_orderkey % 3) * 30.48 + (o_orderkey % 12) * 2.54, 2) AS DOUBLE) cm, CAST(round((100 + o_custkey % 200) * 453.59237) AS BIGINT) grams,
  CAST(o_orderkey % 31 AS INTEGER) wins, CAST(o_custkey % 17 AS INTEGER) losses FROM orders""")
def unit_parsing(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    height, weight, record = F.format_string("%d' %d\"", 4 + k % 3, k % 12), F.format_string("%d lbs.", 100 + c % 200), F.format_string("Record: %d-%d-0 (1 NC)", k % 31, c % 17)
    parts = names.record_parts(record)
    return table(spark, d, "orders").select("o_orderkey", names.height_cm(height).alias("cm"), names.weight_grams(weight).alias("grams"), parts["wins"].alias("wins"), parts["losses"].alias("losses"))


@query(ORACLE_SQL["changed_samples"])
def stream_changed_samples(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern, as a stream's plain path has to be a folder
    return changes.replay(changes.changed(stream, "user_id", ["ts", "event_id"], "event_type")).select("event_id", "user_id", "event_type")


@query("SELECT c_custkey, strip_accents(c_name || ' Žižka Ærø Núñez') AS name FROM customer")
def accents_stripped(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.strip_accents(F.concat("c_name", F.lit(" Žižka Ærø Núñez"))).alias("name"))


@query("""WITH t AS (SELECT o_orderkey k, o_orderkey % 301 s, o_custkey % 301 l, 1 + o_custkey % 5 r, o_orderpriority = '3-MEDIUM' decision FROM orders)
  SELECT k o_orderkey, (r - 1) * 300 + s duration, (r - 1) * 300 + 300 - l axis, CASE WHEN decision THEN 300 WHEN abs(300 - s - l) <= abs(s - l) THEN s ELSE 300 - s END end_s FROM t""")
def clocks(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 301).alias("s"), (F.col("o_custkey") % 301).alias("l"), (1 + F.col("o_custkey") % 5).alias("r"), F.when(F.col("o_orderpriority") == "3-MEDIUM", "Decision - Unanimous").otherwise("U-DEC").alias("m"))
    clock = lambda c: F.format_string("%d:%02d", F.floor(F.col(c) / 60), F.col(c) % 60)
    return o.select("o_orderkey", sc.duration_seconds(F.col("r"), clock("s")).alias("duration"), sc.sample_axis(F.col("r"), F.col("l")).alias("axis"), sc.end_seconds(clock("s"), F.col("m"), clock("l")).cast("bigint").alias("end_s"))


@query("""WITH r AS (SELECT o_orderkey k, [o_orderkey % 9, o_custkey % 5, o_orderkey % 2] a, [o_orderkey % 9 + o_custkey % 3, o_custkey % 5, (o_orderkey + o_custkey) % 2] b FROM orders)
  SELECT k o_orderkey, b[1] >= a[1] AND b[2] >= a[2] AND b[3] >= a[3] AND list_sum(b) - list_sum(a) BETWEEN 1 AND 2 safe FROM r""")
def safe_changes(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", sc.safe_record_change([k % 9, c % 5, k % 2], [k % 9 + c % 3, c % 5, (k + c) % 2], 2).alias("safe"))


@query("""SELECT CAST(o_custkey AS VARCHAR) event_id, 'Card ' || o_custkey event_name, strftime(o_orderdate, '%Y-%m-%d') || ' 22:30' AS start, CAST(o_orderkey AS VARCHAR) bout_id, o_orderkey || 'b' red_id, o_orderkey || 'r' blue_id, CASE WHEN o_orderkey % 3 > 0 THEN 'N ' || o_custkey END red_name, NULL::VARCHAR blue_name,
  (o_orderkey % 5) || ':30' clock, CAST(1 + o_orderkey % 3 AS INTEGER) period, CASE WHEN o_orderstatus = 'F' THEN 'post' ELSE 'in' END state, o_orderstatus = 'F' completed, 'STATUS_' || o_orderstatus status, CASE o_orderkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'long' END status_detail,
  CASE WHEN o_orderkey % 4 = 1 THEN 'unofficial winner kotko' END unofficial, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 > 0 THEN CAST(o_orderkey AS VARCHAR) || 'r' END winner_id FROM orders WHERE o_orderkey % 11 > 0""")
def scoreboard_rows(spark, d):
    """Competitions of one competitor aren't read; two marked winners are none."""
    o = table(spark, d, "orders")
    key, k, done = F.col("o_orderkey"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus") == "F"
    kind = F.struct(F.concat(F.lit("STATUS_"), "o_orderstatus").alias("name"), F.when(done, "post").otherwise("in").alias("state"), done.alias("completed"), F.when(key % 3 == 0, "short").when(key % 3 == 1, "").alias("shortDetail"), F.when(key % 3 < 2, "long").alias("detail"))
    status = F.struct(F.concat(key % 5, F.lit(":30")).alias("displayClock"), (1 + key % 3).alias("period"), kind.alias("type"))
    athlete = F.struct(F.when(key % 3 > 0, F.concat(F.lit("N "), F.col("o_custkey").cast("string"))).alias("displayName"))
    side = lambda letter, won, who: F.struct(F.concat(k, F.lit(letter)).alias("id"), won.alias("winner"), who.alias("athlete"))
    sides = F.array(side("b", done & (key % 7 == 0), athlete), side("r", done, F.lit(None).cast("struct<displayName:string>")))
    details = F.array(F.struct(F.struct(F.lit("Round 1").alias("text")).alias("type")), F.struct(F.struct(F.when(key % 4 == 1, " Unofficial Winner Kotko ").otherwise("x").alias("text")).alias("type")))
    event = F.struct(F.col("o_custkey").cast("string").alias("id"), F.concat(F.lit(" Card "), "o_custkey").alias("name"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T22:30Z")).alias("date"), F.array(F.struct(k.alias("id"), F.slice(sides, F.lit(1), F.when(key % 11 == 0, 1).otherwise(2)).alias("competitors"), details.alias("details"), status.alias("status"))).alias("competitions"))
    return documents.scoreboard(o.select(F.to_json(F.struct(F.array(event).alias("events"))).alias("doc")), "doc").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 7 AS DOUBLE) landed, CASE WHEN o_custkey % 4 > 0 THEN CAST(o_custkey % 4 AS DOUBLE) END missed, CAST(o_orderkey % 7 + o_custkey % 4 AS DOUBLE) thrown FROM orders""")
def statistics_map(spark, d):
    stat = lambda name, c: F.struct(F.lit(name).alias("name"), c.alias("value"))
    categories = F.array(F.struct(F.array(stat("landed", F.col("o_orderkey") % 7)).alias("stats")), F.struct(F.array(stat("missed", F.nullif(F.col("o_custkey") % 4, F.lit(0)))).alias("stats")))
    docs = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.struct(categories.alias("categories")).alias("splits"))).alias("doc"))
    m = docs.select("o_orderkey", documents.statistics(F.col("doc"), {"thrown": ("landed", "missed")}).alias("m"))
    return m.select("o_orderkey", *[F.try_element_at("m", F.lit(x)).alias(x) for x in ("landed", "missed", "thrown")])


@query("""SELECT count(*) n, count(*) FILTER (o_orderkey % 10 = 0) unreadable FROM orders""")
def unreadable_documents(spark, d):
    return documents.unreadable(table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 10 == 0, '{"events": [').otherwise('{"events": []}').alias("doc")), "doc")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END x FROM customer)
  SELECT c_custkey, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM c WHERE c_custkey % 10 < 8)), 4) x FROM c""")
def median_imputed(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")).alias("x"))
    return models.median_impute(c, ["x"], "c_custkey % 10 < 8").withColumn("x", F.round("x", 4))


@query("""SELECT o_orderkey, round(((o_custkey % 100) / 100.0 + 1 - (o_orderkey % 100) / 100.0) / 2, 6)::DOUBLE p FROM orders""")
def symmetrised_scores(spark, d):
    o = table(spark, d, "orders")
    both = F.array(F.struct(F.lit(False).alias("m"), (F.col("o_custkey") % 100 / 100).alias("p")), F.struct(F.lit(True).alias("m"), (F.col("o_orderkey") % 100 / 100).alias("p")))
    return models.symmetrised(o.select("o_orderkey", F.explode(both).alias("s")).select("o_orderkey", "s.*"), "o_orderkey", "m").withColumn("p", F.round("p", 6))


@query()
def calibrated_scores(spark, d):
    """Calibration by the better method, fitted on the even documents; model-based, so without a twin."""
    rows = scored(spark, d)
    fit = rows.filter("doc_id % 2 = 0")
    method, _ = models.choose_calibration(fit, "doc_id")
    return models.calibrated(fit, rows, method).select("doc_id", "y", "p", F.round("calibrated_", 6).alias("calibrated"))


@query()
def tiered_names(spark, d):
    """Names made of the first words of documents, found again in another case, with an accent, or with a slip anywhere; tested against plain Python."""
    words = F.slice(F.filter(F.split("text", r"[^\p{L}]+"), lambda w: F.length(w) > 2), 1, 4)
    n = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(words, " ").alias("name")).filter(F.length("name") > 12)
    k, at = F.col("id") % 5, (F.col("id") % F.length("name") + 1).cast("int")
    slip = F.concat(F.substring(F.col("name"), F.lit(1), at - 1), F.substring(F.col("name"), at + 1, F.length("name")))
    asked = n.select(F.when(k == 0, F.upper("name")).when(k == 1, F.concat("name", F.lit("\u0301"))).otherwise(slip).alias("asked"))
    return entity.tiered_match(asked, n, "asked", "id")


@query(f"""WITH {BOUTS_SQL}, c AS (SELECT l_orderkey bout_id, CAST(l_quantity AS BIGINT) red, l_partkey % 50 blue FROM lineitem),
  v AS (SELECT bout_id, count(*) FILTER ((red - blue) * CASE WHEN winner_id = red_fighter_id THEN 1 ELSE -1 END > 0) AS "right", count(*) FILTER ((red - blue) * CASE WHEN winner_id = red_fighter_id THEN 1 ELSE -1 END < 0) wrong
  FROM c JOIN bouts USING (bout_id) WHERE winner_id IS NOT NULL GROUP BY bout_id) SELECT * FROM v WHERE wrong > "right" """)
def mirrored_cards(spark, d):
    cards = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bout_id"), F.col("l_quantity").cast("bigint").alias("red"), (F.col("l_partkey") % 50).alias("blue"))
    return quality.mirrored_cards(cards, bouts(spark, d))


@query("""WITH r AS (SELECT l_orderkey bout_id, l_suppkey % 3 fighter_id, l_linenumber round, CASE WHEN l_partkey % 9 > 0 THEN CAST(l_quantity AS BIGINT) END q FROM lineitem),
  s AS (SELECT bout_id, fighter_id, count(*) n, count(DISTINCT round) k, min(round) a, max(round) z, count(q) known, sum(q) total FROM r GROUP BY ALL),
  t AS (SELECT l_orderkey bout_id, l_suppkey % 3 fighter_id, max(l_linenumber) end_round, CAST(sum(l_quantity) AS BIGINT) - CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END q FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY l_orderkey, l_suppkey % 3)
  SELECT s.bout_id, s.fighter_id, CASE WHEN end_round IS NULL THEN 'stranger' WHEN NOT (a = 1 AND z = end_round AND n = end_round AND k = n) THEN 'rounds' WHEN known < n THEN 'missing' WHEN total IS DISTINCT FROM q THEN 'total' END refusal_reason
  FROM s LEFT JOIN t ON t.bout_id = s.bout_id AND t.fighter_id = s.fighter_id""")
def rounds_refused(spark, d):
    li = table(spark, d, "lineitem").withColumns({"bout_id": F.col("l_orderkey"), "fighter_id": F.col("l_suppkey") % 3, "round": F.col("l_linenumber")})
    rounds = li.select("bout_id", "fighter_id", "round", F.when(F.col("l_partkey") % 9 > 0, F.col("l_quantity").cast("bigint")).alias("q"))
    stored = li.filter("fighter_id > 0").groupBy("bout_id", "fighter_id").agg(F.max("round").alias("end_round"), (F.sum("l_quantity").cast("bigint")).alias("q"))
    return quality.rounds_refused(rounds, stored.withColumn("q", F.col("q") - F.when(F.col("bout_id") % 2 == 0, 1).otherwise(0)), "q")


@query("""WITH s AS (SELECT user_id, count(*) n, max(ts) newest FROM events WHERE event_id % 4 >= 1 GROUP BY user_id)
  SELECT *, CASE WHEN n <= 1 THEN 'idle' WHEN epoch((SELECT max(ts) FROM events)) - epoch(newest) > 86401 THEN 'stale' ELSE 'growing' END verdict FROM s""")
def live_verdicts(spark, d):
    e = table(spark, d, "events").withColumn("period", F.col("event_id") % 4)
    now = e.agg(F.max("ts")).scalar()
    return quality.live_verdict(e, "user_id", "ts", now.cast("timestamp"), 86401)


@query(f"WITH {BOUTS_SQL} SELECT event_date, least(red_fighter_id, blue_fighter_id) a, greatest(red_fighter_id, blue_fighter_id) b, count(*) n, min(bout_id) keeper FROM bouts GROUP BY ALL HAVING count(*) > 1")
def phantom_pairs(spark, d):
    return quality.phantom_pairs(bouts(spark, d), "event_date")
