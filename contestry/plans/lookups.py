"""Queries on joins, lookups and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.functions import scalar as sc
from contestry.operators import lookups as lk
from contestry.operators import metrics
from contestry.operators.mentions import mentions
from contestry.plans.careers import FULL_SQL
from contestry.plans.registry import SCORED_SQL, query, scored
from contestry.sources.proxy import full_bouts, stat_sides, table


def people(spark, d):
    """Suppliers as people of two sources, with spellings that differ in case and spacing."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit(" Person  "), (k % 40 / 2).cast("int").cast("string"))).otherwise(F.concat(F.lit("PERSON "), (k % 40 / 2).cast("int").cast("string"))).alias("name"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, "a").otherwise("b").alias("source"), F.when(k % 3 == 0, (k % 7).cast("string")).alias("new_id"), F.when(k % 4 != 0, (k % 11).cast("string")).alias("old_id"), F.when(k % 6 == 0, "x").alias("photo"),
    )


PEOPLE_SQL = """people AS (SELECT s_suppkey id, CASE WHEN s_suppkey % 2 = 0 THEN ' Person  ' ELSE 'PERSON ' END || (s_suppkey % 40 // 2) AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END source,
  CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 7 AS VARCHAR) END new_id, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 11 AS VARCHAR) END old_id, CASE WHEN s_suppkey % 6 = 0 THEN 'x' END photo FROM supplier)"""


@query(f"WITH {FULL_SQL} SELECT b.bout_id, r.knockdowns red_knockdowns, x.knockdowns blue_knockdowns FROM bouts b LEFT JOIN (SELECT * FROM side WHERE bout_id % 3 <> 0) r ON r.bout_id = b.bout_id AND r.fighter_id = red_id LEFT JOIN (SELECT * FROM side WHERE bout_id % 3 <> 0) x ON x.bout_id = b.bout_id AND x.fighter_id = blue_id")
def two_role_facts(spark, d):
    b = full_bouts(spark, d).select("bout_id", "red_fighter_id", "blue_fighter_id")
    return lk.with_roles(b, stat_sides(spark, d).filter("bout_id % 3 <> 0").select("bout_id", "fighter_id", "knockdowns")).drop("red_fighter_id", "blue_fighter_id")


@query(f"WITH {PEOPLE_SQL}, r AS (SELECT o_orderkey k, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END id, CASE WHEN o_custkey % 4 > 0 THEN 'scraped ' || o_custkey END scraped FROM orders) SELECT k, coalesce(name, scraped) AS known, coalesce(scraped, name) AS seen FROM r LEFT JOIN people USING (id)")
def names_by_precedence(spark, d):
    c = F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(c % 3 > 0, c).alias("id"), F.when(c % 4 > 0, F.concat(F.lit("scraped "), c.cast("string"))).alias("scraped"))
    first = lk.with_name(rows, people(spark, d), "id", "scraped").select("k", F.col("name").alias("known"))
    second = lk.with_name(rows, people(spark, d), "id", "scraped", scraped_first=True).select("k", F.col("name").alias("seen"))
    return first.join(second, "k")


@query(f"WITH {PEOPLE_SQL}, p AS (SELECT *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) name_key FROM people) SELECT a.name_key, a.id, b.id other_id FROM p a JOIN p b USING (name_key) WHERE a.source = 'a' AND b.source = 'b'")
def same_name_across_sources(spark, d):
    return lk.across_sources(people(spark, d), "a", "b")


@query(f"WITH {PEOPLE_SQL}, e AS (SELECT new_id source_id, id, 0 r FROM people UNION ALL SELECT old_id, id, 1 FROM people) SELECT source_id, arg_min(id, (r, id)) id FROM e WHERE source_id IS NOT NULL GROUP BY ALL")
def ids_by_source(spark, d):
    return lk.source_index(people(spark, d), ["new_id", "old_id"])


@query("SELECT o_orderkey, (SELECT min(x.o_orderkey) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderpriority = o.o_orderpriority AND x.o_orderkey <> o.o_orderkey) sibling_id FROM orders o")
def lowest_sibling(spark, d):
    return lk.sibling(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_orderkey", "sibling_id")


def cards(spark, d, test: str):
    k, a, b = F.col("o_orderkey"), F.col("o_custkey") % 9, F.col("o_orderkey") % 7
    name = lambda x: F.when(x == 4, "TBD").otherwise(F.concat(F.lit("N "), x.cast("string")))
    return table(spark, d, "orders").filter(test).select(k.alias("id"), F.when(a != 2, a).alias("red_id"), F.when(b != 3, b).alias("blue_id"), name(a).alias("red_name"), name(b).alias("blue_name"))


CARDS_SQL = "cards AS (SELECT o_orderkey id, nullif(o_custkey % 9, 2) red_id, nullif(o_orderkey % 7, 3) blue_id, CASE o_custkey % 9 WHEN 4 THEN NULL ELSE 'N ' || o_custkey % 9 END red_name, CASE o_orderkey % 7 WHEN 4 THEN NULL ELSE 'N ' || o_orderkey % 7 END blue_name FROM orders)"


@query(f"""WITH {CARDS_SQL} SELECT i.id in_id, min(s.id) bout_id FROM cards i JOIN cards s ON i.id % 10 = 1 AND s.id % 10 = 2
  AND ((i.red_id = s.red_id AND i.blue_id = s.blue_id) OR (i.red_id = s.blue_id AND i.blue_id = s.red_id) OR (i.red_name = s.red_name AND i.blue_name = s.blue_name) OR (i.red_name = s.blue_name AND i.blue_name = s.red_name)) GROUP BY ALL""")
def pairs_in_any_order(spark, d):
    return lk.same_pairs(cards(spark, d, "o_orderkey % 10 = 2"), cards(spark, d, "o_orderkey % 10 = 1"))


@query(f"WITH {FULL_SQL}, c AS (SELECT red_id a, blue_id o FROM bouts WHERE event_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-05' UNION ALL SELECT blue_id, red_id FROM bouts WHERE event_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-05') SELECT s_suppkey slot_id, min(o) source_id FROM supplier JOIN c ON a = s_suppkey GROUP BY s_suppkey HAVING count(*) = 1")
def bridged_slots(spark, d):
    board = full_bouts(spark, d).filter("event_date BETWEEN DATE'1996-03-01' AND DATE'1996-03-05'").select("bout_id", F.col("red_fighter_id").alias("red_id"), F.col("blue_fighter_id").alias("blue_id"))
    return lk.opposite_by_anchor(table(spark, d, "supplier").select(F.col("s_suppkey").alias("slot_id"), F.col("s_suppkey").alias("anchor_id")), board)


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000) n FROM customer")
def counted_facts(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 1000").select(F.col("o_custkey").alias("c_custkey"))
    return lk.with_count(table(spark, d, "customer").select("c_custkey"), o, "c_custkey")


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def newest_day(spark, d):
    return lk.latest_snapshot_rows(table(spark, d, "events").withColumn("day", F.to_date("ts")), "day").select("event_id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC) i FROM orders) WHERE i = 1")
def latest_per_entity(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("at"))
    return lk.latest_row(o, "o_custkey", "at", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""WITH e AS (SELECT DISTINCT o_custkey event_id, DATE '2024-01-01' + CAST(o_custkey % 9 AS INT) * 3 event_date FROM orders), s AS (SELECT event_id start_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' l, ts u FROM events)
  SELECT start_id, coalesce((SELECT min(event_id) FROM e WHERE event_date = CAST(l AS DATE)), (SELECT min(event_id) FROM e WHERE event_date = CAST(u AS DATE))) event_id FROM s
  WHERE EXISTS (SELECT 1 FROM e WHERE event_date = CAST(l AS DATE) OR event_date = CAST(u AS DATE))""")
def event_by_local_day(spark, d):
    c = F.col("o_custkey")
    e = table(spark, d, "orders").select(c.alias("event_id"), F.date_add(F.lit("2024-01-01").cast("date"), (c % 9 * 3).cast("int")).alias("event_date")).distinct()
    return lk.event_on_either_day(e, table(spark, d, "events").select(F.col("event_id").alias("start_id"), F.col("ts").alias("start")))


@query(f"""WITH {PEOPLE_SQL}, g AS (SELECT id, name, CASE WHEN id % 7 = 0 THEN 0 WHEN id % 4 = 0 THEN 1 WHEN photo IS NOT NULL THEN 2 ELSE 3 END AS "group" FROM people) SELECT id, "group", row_number() OVER (ORDER BY "group", name, id) place FROM g""")
def priority_order(spark, d):
    p = people(spark, d)
    return lk.by_priority(p, p.filter("id % 7 = 0"), p.filter("id % 4 = 0"))


@query(f"WITH {FULL_SQL} SELECT id, count(*) n FROM (SELECT red_id id FROM bouts UNION ALL SELECT blue_id FROM bouts) GROUP BY ALL")
def corner_counts(spark, d):
    return lk.key_counts(full_bouts(spark, d))


@query(f"WITH {FULL_SQL} SELECT fighter_id, CAST(sum(sub_attempts) FILTER (control IS NOT NULL) AS BIGINT) sub_attempts, CAST(sum(control) FILTER (sub_attempts IS NOT NULL) AS BIGINT) AS control FROM side GROUP BY ALL")
def sums_if_seen(spark, d):
    return lk.sum_if_seen(stat_sides(spark, d), "fighter_id", [("sub_attempts", "control")])


@query(f"WITH {PEOPLE_SQL} SELECT coalesce(source, '(none)') source, count(*) n, count(photo) with_photo, count(*) FILTER (new_id IS NOT NULL AND old_id IS NOT NULL) both_ids FROM people GROUP BY ALL")
def coverage_by_source(spark, d):
    return lk.source_report(people(spark, d), {"with_photo": F.col("photo").isNotNull(), "both_ids": F.col("new_id").isNotNull() & F.col("old_id").isNotNull()})


@query("SELECT CASE WHEN y <= 1992 THEN '1990-1992' ELSE '1993+' END half, count(*) n, min(y) first_year FROM (SELECT year(o_orderdate) y FROM orders) GROUP BY ALL")
def rows_by_half(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").groupBy(F.when(y <= 1992, "1990-1992").otherwise("1993+").alias("half")).agg(F.count("*").alias("n"), F.min(y).cast("bigint").alias("first_year"))


@query("SELECT CASE WHEN y <= 2004 THEN '1995-2004' WHEN y <= 2009 THEN '2005-2009' WHEN y <= 2014 THEN '2010-2014' WHEN y <= 2019 THEN '2015-2019' WHEN y <= 2024 THEN '2020-2024' ELSE '2025+' END era, count(*) n FROM (SELECT 1995 + o_custkey % 40 y FROM orders) GROUP BY ALL")
def bouts_by_era(spark, d):
    return table(spark, d, "orders").groupBy(sc.era(F.lit(1995) + F.col("o_custkey") % 40).alias("era")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS name, round(avg(l_extendedprice), 4) price, count(*) n FROM lineitem GROUP BY ALL")
def consensus_price(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("name")).agg(F.round(F.avg("l_extendedprice"), 4).alias("price"), F.count("*").alias("n"))


@query("SELECT coalesce(nullif(split_part(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '/', 1), ''), '(blank)') AS domain, count(*) n FROM pages GROUP BY ALL")
def domains(spark, d):
    return table(spark, d, "pages").groupBy(sc.url_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"""WITH {SCORED_SQL}, t AS (SELECT * FROM scored WHERE doc_id % 3 > 0), m AS (SELECT CASE WHEN sum(y) > count(*) - sum(y) THEN 1 ELSE 0 END majority, avg(y) rate FROM t)
  SELECT majority, round(avg((y = majority)::INT), 6) accuracy, round(avg((0.5 - y) ** 2), 6) brier_half, round(avg(-CASE WHEN y = 1 THEN ln(rate) ELSE ln(1 - rate) END), 6) prior_log_loss FROM scored, m WHERE doc_id % 3 = 0 GROUP BY ALL""")
def baseline_scores(spark, d):
    rows = scored(spark, d)
    return metrics.baselines(rows.filter("doc_id % 3 > 0"), rows.filter("doc_id % 3 = 0"))


@query(f"""WITH {SCORED_SQL}, h AS (SELECT y, p, p >= 0.5 g, greatest(least(p, 1 - 1e-15), 1e-15) q FROM scored), c AS (SELECT count(*) n, count(*) FILTER (g AND y = 1) tp, count(*) FILTER (g AND y = 0) fp, count(*) FILTER (NOT g AND y = 1) fn, count(*) FILTER (NOT g AND y = 0) tn, avg((p - y) ** 2) b, avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END) l FROM h)
  SELECT n, tp, fp, fn, tn, round((tp + tn) / n::DOUBLE, 6) accuracy, round(b, 6) brier, round(l, 6) log_loss, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) f1 FROM c""")
def binary_scores(spark, d):
    return metrics.binary_metrics(scored(spark, d))


@query("""WITH s AS (SELECT l_orderkey, CAST(l_linenumber % 3 AS INT) y, 1 + l_orderkey % 5 a, 1 + l_suppkey % 4 b, 1 + l_partkey % 3 c FROM lineitem), p AS (SELECT y, a / (a + b + c)::DOUBLE x0, b / (a + b + c)::DOUBLE x1, c / (a + b + c)::DOUBLE x2 FROM s),
  g AS (SELECT *, CASE WHEN x0 >= x1 AND x0 >= x2 THEN 0 WHEN x1 >= x2 THEN 1 ELSE 2 END g FROM p), e AS (SELECT unnest([0, 1, 2]) i, y, g, unnest([x0, x1, x2]) p FROM g), r AS (SELECT i, y, p, rank() OVER (PARTITION BY i ORDER BY p) + (count(*) OVER (PARTITION BY i, p) - 1) / 2.0 k FROM e)
  SELECT CASE i WHEN 0 THEN 'ko' WHEN 1 THEN 'sub' ELSE 'dec' END AS class, (SELECT count(*) FROM g WHERE y = i) n, (SELECT count(*) FROM g WHERE y = i AND g = i) hits, (SELECT round(avg(-ln(p)), 6) FROM e x WHERE x.i = r.i AND y = x.i) log_loss,
  round((sum(k) FILTER (y = i) - count(*) FILTER (y = i) * (count(*) FILTER (y = i) + 1) / 2.0) / (count(*) FILTER (y = i) * count(*) FILTER (y <> i)), 6) auc FROM r GROUP BY i""")
def class_scores(spark, d):
    a, b, c = 1 + F.col("l_orderkey") % 5, 1 + F.col("l_suppkey") % 4, 1 + F.col("l_partkey") % 3
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("y"), *[(x / (a + b + c)).alias(f"p_{k}") for k, x in (("ko", a), ("sub", b), ("dec", c))])
    return metrics.multiclass_metrics(rows, ["ko", "sub", "dec"])


KEY_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT doc_id who, substring(text, 1, 9) AS name, {KEY_SQL.format("substring(text, 1, 9)")} AS k FROM documents WHERE doc_id % 10 = 0), t AS (SELECT doc_id id, {KEY_SQL.format("text")} AS t FROM documents),
  h AS (SELECT t.id, n.who, name FROM t JOIN n ON k <> '' AND contains(t, k)) SELECT id, array_to_string(list(name ORDER BY who)[1:4], '|') AS names FROM h GROUP BY ALL""")
def people_mentioned(spark, d):
    """The beginnings of some documents, looked for in all of them."""
    docs = table(spark, d, "documents")
    people = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), F.substring("text", 1, 9).alias("name"))
    return mentions(docs.select(F.col("doc_id").alias("id"), "text"), people).select("id", F.array_join("names", "|").alias("names"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '%high%' OR regexp_matches(o_orderpriority, '(?i)\\burgent\\b')")
def case_blind_matches(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderpriority").ilike("%high%") | F.col("o_orderpriority").rlike(r"(?i)\burgent\b")).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal ASC NULLS LAST, c_custkey LIMIT 20 OFFSET 5")
def page_of_rows(spark, d):
    return table(spark, d, "customer").orderBy(F.asc_nulls_last("c_acctbal"), "c_custkey").offset(5).limit(20).select("c_custkey", "c_name")
