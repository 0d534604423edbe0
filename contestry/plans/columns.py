"""Scalar functions and matches over columns of the tables; their twins compute the values another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.functions import names
from contestry.functions import scalar as sc
from contestry.functions import text
from contestry.operators import entity
from contestry.plans.registry import query
from contestry.sources.proxy import table


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.to_timestamp("o_orderdate").alias("t"))


@query("""WITH t AS (SELECT o_orderkey k, o_orderdate + to_seconds(o_orderkey % 86400) AS t FROM orders) SELECT k, CASE k % 5 WHEN 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(t - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(t + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(t, '%Y-%m-%d %H:%M:%S') END AS said FROM t""")
def publication_dates(spark, d):
    """Order dates written as feeds write them, with zones, Spanish months and no date at all."""
    o = orders(spark, d).withColumn("t", F.col("t") + F.make_dt_interval(secs=F.col("k") % 86400))
    spanish = F.element_at(F.array(*map(F.lit, "ene feb mar abr may jun jul ago sep oct nov dic".split())), F.month("t"))
    zone = F.when(F.col("k") % 5 == 1, "+0200").when(F.col("k") % 5 == 2, "-0300").otherwise("GMT")
    plain = F.concat(F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss "), zone)
    said = F.when(F.col("k") % 5 == 4, "soon").when(F.col("k") % 5 == 3, F.concat(F.lit("sáb, "), F.dayofmonth("t"), F.lit(" "), spanish, F.date_format("t", " yyyy HH:mm:ss"), F.lit(" +0000"))).otherwise(plain)
    return o.select("k", F.date_format(sc.published_at(said), "yyyy-MM-dd HH:mm:ss").alias("said"))


@query("SELECT o_orderkey k, CAST(o_orderdate AS DATE) AS said FROM orders")
def dates_of_labels(spark, d):
    """Labels of the night before a UTC start, some across the turn of a year."""
    o = orders(spark, d)
    return o.select("k", sc.label_date(F.concat(F.date_format("t", "EEE, MMM d"), F.lit(" / 8:00 PM EST")), F.col("t") + F.make_dt_interval(days=F.lit(1), hours=F.lit(1))).alias("said"))


@query("SELECT o_orderkey k, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS said FROM orders")
def dates_of_pages(spark, d):
    o = orders(spark, d)
    said = F.element_at(F.array(F.date_format("t", "MMM d, yyyy"), F.date_format("t", "MMMM dd, yyyy"), F.date_format("t", "yyyy-MM-dd"), F.date_format("t", "d MMM yyyy")), (F.col("k") % 4 + 1).cast("int"))
    return o.select("k", names.any_date(said).alias("said"))


@query("""SELECT c_custkey k, CASE WHEN c_custkey % 3 < 2 THEN round(((4 + c_custkey % 3) * 12 + c_custkey % 12) * 2.54::DOUBLE, 2) END height, CASE WHEN c_custkey % 5 > 0 THEN round((60 + c_custkey % 25) * 2.54::DOUBLE, 2) END reach, CASE WHEN c_custkey % 4 > 0 THEN CAST(round((115 + c_custkey % 150) * 453.59237::DOUBLE) AS BIGINT) END grams,
  CAST(c_custkey % 30 AS INTEGER) wins, CAST(c_custkey % 11 AS INTEGER) losses, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 ELSE 0 END AS INTEGER) draws, c_custkey % 40 landed, c_custkey % 90 attempted, CASE WHEN c_custkey % 7 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 3600 ELSE 0 END + c_custkey % 60 * 60 + c_custkey % 59 END control FROM customer""")
def measures_of_profiles(spark, d):
    """Heights, reaches, weights, records, tries and clocks as profiles write them."""
    k, s = F.col("c_custkey"), lambda x: x.cast("string")
    mark = F.when(k % 2 == 0, F.lit("' ")).otherwise(F.lit("’ "))
    height = F.when(k % 3 < 2, F.concat(s(4 + k % 3), mark, s(k % 12), F.lit('"'))).otherwise("--")
    reach, pounds = F.when(k % 5 > 0, F.concat(s(60 + k % 25), F.lit('"'))).otherwise("--"), F.when(k % 4 > 0, F.concat(s(115 + k % 150), F.lit(" lbs.")))
    record = F.concat(F.lit("Record: "), s(k % 30), F.lit("-"), s(k % 11), F.when(k % 2 == 0, F.concat(F.lit("-"), s(k % 3))).otherwise(""), F.lit(" (1 NC)"))
    clock = F.when(k % 7 > 0, F.concat(F.when(k % 2 == 0, "1:").otherwise(""), F.lpad(s(k % 60), 2, "0"), F.lit(":"), F.lpad(s(k % 59), 2, "0"))).otherwise("--")
    rows = table(spark, d, "customer").select(k.alias("k"), height.alias("h"), reach.alias("r"), pounds.alias("p"), record.alias("w"), F.concat(s(k % 40), F.lit(" OF "), s(k % 90)).alias("l"), clock.alias("c"))
    parts, tries = names.record_parts(F.col("w")), names.landed_attempted(F.col("l"))
    return rows.select("k", names.height_cm(F.col("h")).alias("height"), names.reach_cm(F.col("r")).alias("reach"), names.weight_grams(F.col("p")).alias("grams"), *[parts[c].alias(c) for c in ("wins", "losses", "draws")], *[tries[c].cast("bigint").alias(c) for c in ("landed", "attempted")], names.control_seconds(F.col("c")).cast("bigint").alias("control"))


@query("""SELECT o_orderkey k, o_orderkey % 3 = 0 OR o_custkey % 4 = 0 has, CAST(o_orderdate AS DATE) BETWEEN DATE '1996-12-22' AND DATE '1997-01-11' near, CASE WHEN o_orderkey % 5 = o_custkey % 6 AND o_custkey % 5 = o_orderkey % 6 THEN o_orderkey % 5 ELSE o_orderkey % 6 END corner,
  CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 7 ELSE 3 END rounds, round((DATE '2026-01-01' - CAST(o_orderdate AS DATE)) / 365.25::DOUBLE, 4) age FROM orders""")
def rules_of_bouts(spark, d):
    """Known results, days near a date, swapped corners, scheduled rounds and ages."""
    k, c = F.col("k"), F.col("c")
    day = lambda x: F.lit(x).cast("date")
    kept = sc.kept_corner(k % 5, c % 5, k % 6, c % 6)
    rounds = sc.scheduled_rounds(F.when(c % 7 > 0, (c % 7).cast("string")).otherwise(F.when(k % 2 == 0, "x").otherwise("-1")))
    return orders(spark, d).select("k", sc.has_result(F.when(k % 3 == 0, c), F.when(c % 4 == 0, "Draw")).alias("has"), sc.within_days(F.to_date("t"), day("1997-01-01"), 10, 10).alias("near"), kept.alias("corner"), rounds.cast("bigint").alias("rounds"), sc.age_years(F.to_date("t"), day("2026-01-01")).alias("age"))


@query("""WITH n AS (SELECT doc_id, substring(text, 1, 24) AS n FROM documents), f AS (SELECT doc_id, replace(lower(n), 'ß', 'ss') l FROM n)
  SELECT doc_id, trim(regexp_replace(regexp_replace(l, '[.\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS normal, trim(regexp_replace(l, '\\s+', ' ', 'g')) casefolded, trim(regexp_replace(regexp_replace(strip_accents(l), '[.\\-]', ' ', 'g'), '\\s+', ' ', 'g')) folded, trim(regexp_replace(strip_accents(l), '\\s+', ' ', 'g')) AS key FROM f""")
def keys_of_documents(spark, d):
    """The name keys of the documents' beginnings, in four languages."""
    n = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 24).alias("n"))
    a = F.col("n")
    return n.select("doc_id", text.normal_name(a).alias("normal"), text.casefold_name(a).alias("casefolded"), text.fold_name(a).alias("folded"), text.duplicate_key(a).alias("key"))


@query(f"""WITH e AS (SELECT doc_id id, substring(text, 1, 60) AS name, doc_id % 10 AS day, source AS location, lang FROM documents), w AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(strip_accents(name)), '[a-z0-9]+')), lambda x: NOT list_contains([{', '.join(f"'{w}'" for w in sc.EVENT_WORDS)}], x)) AS w FROM e),
  m AS (SELECT a.id in_id, b.id event_id, CASE WHEN a.name = b.name AND a.location IS NOT DISTINCT FROM b.location THEN 1000000 ELSE len(list_intersect(a.w, b.w)) END s FROM w a JOIN w b ON a.day = b.day AND a.lang = b.lang AND a.id % 4 = 0 AND b.id % 4 > 0)
  SELECT in_id, arg_max(event_id, (s, -event_id)) event_id FROM m WHERE s >= 2 GROUP BY in_id""")
def events_by_tokens(spark, d):
    """The documents' beginnings as event names: those of every fourth id are matched with the others of their day and language."""
    e = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("name"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 10).cast("int")).alias("event_date"), F.col("source").alias("location"), F.col("lang").alias("promotion_id"))
    return entity.event_match(e.filter("id % 4 = 0"), e.filter("id % 4 > 0"))


@query("""WITH p AS (SELECT c_custkey id, CASE WHEN c_custkey % 3 = 0 THEN 'main' ELSE 'other' || c_custkey % 2 END source, '/' || c_custkey AS source_id, 'name ' || c_custkey % 700 AS k FROM customer),
  i AS (SELECT '/' || (c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000 END) source_id, 'name ' || (c_custkey * 3) % 900 AS k FROM customer WHERE c_custkey % 6 < 5),
  o AS (SELECT k, min(id) AS one, count(*) n FROM p WHERE source <> 'main' GROUP BY k)
  SELECT i.source_id, coalesce(m.id, CASE WHEN n = 1 THEN one END) id, CASE WHEN m.id IS NOT NULL THEN 'resolved' WHEN n = 1 THEN 'adopted' ELSE 'create' END action FROM i LEFT JOIN p m ON m.source = 'main' AND m.source_id = i.source_id LEFT JOIN o ON o.k = i.k""")
def resolved_or_created(spark, d):
    """Customers that a source brings, by its id, by an only namesake of another source, or new."""
    k, s = F.col("c_custkey"), lambda x: x.cast("string")
    c = table(spark, d, "customer")
    people = c.select(k.alias("id"), F.concat(F.lit("Name  "), s(k % 700)).alias("name"), F.when(k % 3 == 0, "main").otherwise(F.concat(F.lit("other"), s(k % 2))).alias("source"), F.concat(F.lit("/"), s(k)).alias("source_id"))
    incoming = c.filter(k % 6 < 5).select(F.concat(F.lit("/"), s(k + F.when(k % 2 == 0, 0).otherwise(1_000_000))).alias("source_id"), F.concat(F.lit(" NAME "), s(k * 3 % 900)).alias("name"))
    return entity.resolve_or_create(incoming, people, "main")
