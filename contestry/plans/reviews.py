"""Queries that review and monitor stored contests, and write policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.functions import scalar as sc
from contestry.functions import text
from contestry.operators import audit, merge
from contestry.plans.lookups import PEOPLE_SQL, people
from contestry.plans.registry import query
from contestry.sources.proxy import table


def order_key():
    return F.col("o_orderkey")


def customer_key():
    return F.col("o_custkey")


def as_of():
    return F.lit("2026-02-01").cast("date")


DAY0 = "DATE '2026-01-01'"


def events(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("event_id"), F.date_add(F.lit("2026-01-01").cast("date"), (k % 60).cast("int")).alias("event_date"), F.when(k % 4 == 0, "upcoming").otherwise("completed").alias("status"))


def bouts(spark, d):
    return table(spark, d, "orders").filter("o_custkey % 5 > 0").select(
        order_key().alias("bout_id"), customer_key().alias("event_id"), F.when(order_key() % 9 > 0, order_key() % 6).cast("int").alias("bout_order"), F.when(order_key() % 7 == 0, "cancelled").alias("status"), F.when(order_key() % 3 == 0, order_key() % 20).alias("winner_id"),
        F.when(order_key() % 4 == 0, "Decision").when(order_key() % 4 == 1, "U-DEC").alias("method"), F.when(order_key() % 4 < 2, 1 + order_key() % 3).cast("int").alias("end_round"), F.when(order_key() % 5 > 0, "r").alias("referee"),
    )


def rounds(spark, d):
    line = table(spark, d, "lineitem")
    return line.select(F.col("l_orderkey").alias("bout_id"), (F.col("l_linenumber") % 3 + 1).alias("round"), F.col("l_suppkey").alias("fighter_id"))


def stats(spark, d):
    return table(spark, d, "lineitem").filter("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("bout_id"), F.col("l_suppkey").alias("fighter_id"))


SQL = f"""events AS (SELECT c_custkey event_id, {DAY0} + CAST(c_custkey % 60 AS INT) event_date, CASE WHEN c_custkey % 4 = 0 THEN 'upcoming' ELSE 'completed' END status FROM customer),
b0 AS (SELECT o_orderkey bout_id, o_custkey event_id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 6 END bout_order, CASE WHEN o_orderkey % 7 = 0 THEN 'cancelled' END status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 20 END winner_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'Decision' WHEN 1 THEN 'U-DEC' END AS method, CASE WHEN o_orderkey % 4 < 2 THEN 1 + o_orderkey % 3 END end_round, CASE WHEN o_orderkey % 5 > 0 THEN 'r' END referee FROM orders WHERE o_custkey % 5 > 0),
bouts AS (SELECT *, status IS DISTINCT FROM 'cancelled' live, winner_id IS NOT NULL OR method IS NOT NULL decided FROM b0),
full_rounds AS (SELECT bout_id, count(*) FILTER (k >= 2) n FROM (SELECT l_orderkey bout_id, l_linenumber % 3 r, count(DISTINCT l_suppkey) k FROM lineitem GROUP BY ALL) GROUP BY ALL),
first_bout AS (SELECT event_id, min(bout_order) o FROM bouts WHERE live AND bout_order IS NOT NULL GROUP BY ALL),
resolved AS (SELECT event_id, bool_or(decided) resolved FROM bouts JOIN first_bout USING (event_id) WHERE live AND bout_order = o GROUP BY ALL)"""


@query(f"WITH {SQL} SELECT * FROM resolved")
def main_events(spark, d):
    return audit.main_event_resolved(bouts(spark, d))


@query(f"WITH {SQL} SELECT bout_id, event_id, event_date, 'CRITICAL' severity FROM bouts JOIN events USING (event_id) JOIN resolved USING (event_id) WHERE resolved AND live AND NOT decided AND event_date BETWEEN DATE '2026-01-22' AND DATE '2026-01-31'")
def ghost_bouts(spark, d):
    return audit.ghosts(events(spark, d), bouts(spark, d), as_of())


@query(f"""WITH {SQL}, s AS (SELECT DISTINCT l_orderkey bout_id, true has FROM lineitem WHERE l_orderkey % 4 > 0), g AS (SELECT event_id, event_date, count(*) FILTER (referee IS NULL) no_referee, count(*) FILTER (has IS NULL) no_stats, count(*) FILTER (n < end_round) partly
  FROM bouts JOIN events USING (event_id) LEFT JOIN s USING (bout_id) LEFT JOIN full_rounds USING (bout_id) WHERE live AND decided AND event_date BETWEEN DATE '2026-02-01' - 60 AND DATE '2026-01-31' GROUP BY ALL)
  SELECT *, CAST(DATE '2026-02-01' - event_date AS INT) age, CASE WHEN DATE '2026-02-01' - event_date < 3 THEN 'INFO' WHEN DATE '2026-02-01' - event_date > 30 THEN 'WARNING' ELSE 'CRITICAL' END severity FROM g WHERE no_referee + no_stats + partly > 0""")
def missing_data(spark, d):
    return audit.data_gaps(events(spark, d), bouts(spark, d), stats(spark, d), rounds(spark, d), as_of())


@query(f"WITH {SQL} SELECT event_id, CAST(DATE '2026-02-01' - event_date AS INT) AS days, CASE WHEN event_date = DATE '2026-01-31' THEN 'WARNING' ELSE 'CRITICAL' END severity FROM events WHERE event_date < DATE '2026-02-01' AND status = 'upcoming'")
def unclosed_events(spark, d):
    return audit.unclosed(events(spark, d), as_of())


@query(f"WITH {SQL} SELECT bout_id, method, 'WARNING' severity FROM bouts JOIN events USING (event_id) WHERE live AND method = 'Decision' AND event_date <= DATE '2026-01-29'")
def unrefined_methods(spark, d):
    return audit.unrefined(events(spark, d), bouts(spark, d), as_of())


@query(f"""WITH {SQL}, g AS (SELECT event_id, count(bout_id) k, count(*) FILTER (NOT decided) o, count(*) FILTER (decided AND coalesce(n, 0) < end_round) s FROM events e LEFT JOIN (SELECT * FROM bouts LEFT JOIN full_rounds USING (bout_id) WHERE live) b USING (event_id)
  WHERE event_date BETWEEN DATE '2026-01-02' AND DATE '2026-01-31' GROUP BY ALL) SELECT event_id, CASE WHEN k = 0 THEN 'bouts' WHEN o > 0 THEN 'results' ELSE 'rounds' END reason FROM g WHERE k = 0 OR o > 0 OR s > 0""")
def events_needing_data(spark, d):
    return audit.events_to_fill(events(spark, d), bouts(spark, d), rounds(spark, d), as_of())


@query(f"WITH {SQL} SELECT event_id, event_date, 'CRITICAL' severity FROM events WHERE event_date BETWEEN DATE '2026-02-01' AND DATE '2026-02-22' AND event_id NOT IN (SELECT event_id FROM bouts)")
def imminent_empty_events(spark, d):
    return audit.empty_events(events(spark, d), bouts(spark, d), as_of())


@query(f"""WITH {SQL}, s AS (SELECT user_id event_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-02 00:00:00') fresh, max(ts) FILTER (event_type = 'error') beat FROM events_t GROUP BY ALL), a AS (SELECT event_id, count(*) active, count(*) FILTER (decided) res FROM bouts WHERE live GROUP BY ALL)
  SELECT e.event_id, CASE WHEN coalesce(active, 0) > 0 AND res >= active THEN 'ENDED' WHEN epoch(TIMESTAMP '2024-01-02 00:15:00') - epoch(beat) > 600 OR coalesce(fresh, 0) = 0 THEN 'DOWN' ELSE 'OK' END state FROM events e LEFT JOIN s USING (event_id) LEFT JOIN a USING (event_id)""".replace("events_t", "main.events"))
def night_watch(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    now = F.lit("2024-01-02 00:15:00").cast("timestamp")
    return audit.watchdog(events(spark, d), e.filter(F.col("ts") <= now + F.expr("INTERVAL 1000 DAYS")), bouts(spark, d), e.filter("event_type = 'error'"), now)


@query(f"""WITH {PEOPLE_SQL}, b AS (SELECT o_orderkey bout_id, o_custkey % 30 red_id, o_orderkey % 30 blue_id, CASE WHEN o_orderkey % 3 = 0 THEN 1 END w, CASE WHEN o_orderkey % 5 > 0 THEN 'r' END referee FROM orders),
  n AS (SELECT l_orderkey bout_id, count(*) FILTER (l_returnflag = 'R') cards, count(*) FILTER (l_returnflag = 'A') stats FROM lineitem GROUP BY ALL)
  SELECT bout_id, coalesce(x.name, 'red ' || red_id) AS red, coalesce(y.name, 'blue ' || blue_id) AS blue, coalesce(cards, 0) cards, coalesce(stats, 0) stats, w IS NOT NULL AND referee IS NOT NULL AND coalesce(stats, 0) >= 2 whole
  FROM b LEFT JOIN people x ON x.id = red_id LEFT JOIN people y ON y.id = blue_id LEFT JOIN n USING (bout_id)""")
def bout_checkpoint(spark, d):
    red, blue = customer_key() % 30, order_key() % 30
    b = table(spark, d, "orders").select(order_key().alias("bout_id"), red.alias("red_id"), blue.alias("blue_id"), F.concat(F.lit("red "), red.cast("string")).alias("red_scraped"), F.concat(F.lit("blue "), blue.cast("string")).alias("blue_scraped"), F.when(order_key() % 3 == 0, 1).alias("winner_id"), F.lit(None).cast("string").alias("method"), F.when(order_key() % 5 > 0, "r").alias("referee"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bout_id"), "l_returnflag")
    return audit.checkpoint(b, people(spark, d), lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'"))


@query(f"WITH {PEOPLE_SQL}, c AS (SELECT DISTINCT unnest([o_custkey % 30, o_orderkey % 25]) id FROM orders WHERE o_orderkey % 10 = 0), g AS (SELECT id, unnest([CASE WHEN photo IS NULL THEN 'photo' END, CASE WHEN source IS NULL THEN 'source' END]) gap FROM people WHERE id IN (SELECT id FROM c)) SELECT * FROM g WHERE gap IS NOT NULL")
def card_gaps(spark, d):
    b = table(spark, d, "orders").filter("o_orderkey % 10 = 0").select((customer_key() % 30).alias("red_id"), (order_key() % 25).alias("blue_id"))
    return audit.gaps_on_cards(people(spark, d), b, {"photo": F.col("photo").isNull(), "source": F.col("source").isNull()})


@query("WITH b AS (SELECT o_orderkey bout_id, nullif(o_orderkey % 5, 2) r, nullif(o_custkey % 4, 1) l FROM orders) SELECT bout_id, 'red' side, l anchor_id FROM b WHERE r IS NULL AND l IS NOT NULL UNION ALL SELECT bout_id, 'blue', r FROM b WHERE l IS NULL AND r IS NOT NULL")
def slots_without_link(spark, d):
    return audit.unlinked_slots(table(spark, d, "orders").select(order_key().alias("bout_id"), F.when(order_key() % 5 != 2, order_key() % 5).alias("red_id"), F.when(customer_key() % 4 != 1, customer_key() % 4).alias("blue_id")))


@query("SELECT count(*) n, count(*) FILTER (o_orderkey % 3 = 0) AS \"right\", round(count(*) FILTER (o_orderkey % 3 = 0) / count(*)::DOUBLE, 6) rate FROM (SELECT * FROM orders ORDER BY md5('7|' || o_orderkey) LIMIT 50)")
def sampled_check(spark, d):
    return audit.sampled_rate(table(spark, d, "orders").select("o_orderkey"), order_key() % 3 == 0, 50, 7)


@query("WITH g AS (SELECT user_id, count(*) passes, count(*) FILTER (event_type = 'error') failed, CAST(sum(event_id % 3) AS BIGINT) written, 0::BIGINT unresolved FROM events GROUP BY ALL) SELECT count(*) passes, count(*) FILTER (failed > passes / 2) failed, CAST(sum(written) AS BIGINT) written, CAST(sum(unresolved) AS BIGINT) unresolved, CASE WHEN count(*) FILTER (failed > passes / 2) = count(*) OR sum(written) = 0 THEN 'fail' WHEN count(*) FILTER (failed > passes / 2) > 0 OR sum(unresolved) > 0 THEN 'warn' ELSE 'ok' END verdict FROM g")
def loop_counters(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") > F.count("*") / 2).alias("failed"), F.sum(F.col("event_id") % 3).alias("written"), F.lit(0).cast("bigint").alias("unresolved"))
    return audit.loop_health(g)


@query("SELECT o_orderpriority p, count(*) listed, count(c_custkey) mapped, round(count(c_custkey) / count(*)::DOUBLE, 6) rate FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey GROUP BY ALL")
def mapped_rate(spark, d):
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return audit.match_rate(table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("p")), known, "o_custkey", "p")


@query("""WITH s AS (SELECT o_orderkey bout_id, unnest([o_orderkey % 4, o_custkey % 4]) x FROM orders), b AS (SELECT bout_id, count(*) FILTER (x = 0) e, count(*) FILTER (x = 1) m, count(*) FILTER (x = 3) n FROM s GROUP BY ALL)
  SELECT CAST(sum(e) AS BIGINT) AS exact, CAST(sum(m) AS BIGINT) mirrored, CAST(sum(n) AS BIGINT) AS none, count(*) FILTER (n = 1) discordant FROM b""")
def photo_counts(spark, d):
    each = table(spark, d, "orders").select(order_key().alias("bout_id"), F.explode(F.array(order_key() % 4, customer_key() % 4)).alias("x"))
    pick = sc.corner_photo("L", F.when(F.col("x") == 0, "l"), F.when(F.col("x") == 1, "r"), F.when(F.col("x") == 2, "s"), F.lit(None).cast("string"))
    return audit.photo_report(each.select("bout_id", pick["source"].alias("source"), pick["mirror"].alias("mirror")))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'keyword' ELSE 'mojibake' END problem FROM customer WHERE c_custkey % 4 < 3")
def bad_names(spark, d):
    k = F.col("c_custkey") % 4
    rows = table(spark, d, "customer").select("c_custkey", F.when(k == 0, F.repeat(F.lit("ab "), 20)).when(k == 1, "Free Download").when(k == 2, "JosÃ© Aldo").otherwise("José Aldo").alias("name"))
    return audit.name_hygiene(rows, "c_custkey", "name")


@query("WITH f AS (SELECT CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END s FROM events) SELECT count(*) FILTER (s = 'CRITICAL') critical, count(*) FILTER (s = 'WARNING') warning, count(*) FILTER (s = 'INFO') info, CASE WHEN count(*) FILTER (s = 'CRITICAL') > 0 THEN 2 WHEN count(*) FILTER (s = 'WARNING') > 0 THEN 1 ELSE 0 END code FROM f")
def severities(spark, d):
    e = F.col("event_type")
    return audit.exit_code(table(spark, d, "events").select(F.when(e == "error", "CRITICAL").when(e == "view", "WARNING").otherwise("INFO").alias("severity")))


STORE_SQL = """s AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'old' END END a, CASE WHEN o_orderkey % 5 > 0 THEN 'old' END b, o_custkey % 7 w, o_custkey % 3 l, o_orderkey % 2 = 0 f FROM orders WHERE o_orderkey % 3 <> 0),
  i AS (SELECT o_orderkey k, 'new' a, CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE 'new' END END b, o_orderkey % 7 w, o_orderkey % 3 - 1 l, o_orderkey % 5 = 0 f FROM orders WHERE o_orderkey % 3 <> 1)"""


@query(f"""WITH {STORE_SQL} SELECT k, CASE WHEN s.k IS NULL THEN i.a ELSE coalesce(nullif(s.a, ''), i.a) END a, CASE WHEN s.k IS NULL THEN i.b ELSE coalesce(nullif(i.b, ''), s.b) END b,
  CASE WHEN s.k IS NULL OR (i.k IS NOT NULL AND i.l >= 0 AND i.w + i.l > s.w + s.l) THEN i.w ELSE s.w END w, CASE WHEN s.k IS NULL OR (i.k IS NOT NULL AND i.l >= 0 AND i.w + i.l > s.w + s.l) THEN i.l ELSE s.l END l,
  CASE WHEN s.k IS NULL THEN i.f ELSE coalesce(s.f, false) OR coalesce(i.f, false) END f, CASE WHEN s.k IS NULL THEN 'insert' WHEN i.k IS NULL THEN 'keep' ELSE 'update' END change FROM s FULL JOIN i USING (k)""")
def write_rules(spark, d):
    o = table(spark, d, "orders")
    s = o.filter("o_orderkey % 3 <> 0").select(order_key().alias("k"), F.when(order_key() % 4 == 1, "").when(order_key() % 4 > 1, "old").alias("a"), F.when(order_key() % 5 > 0, "old").alias("b"), (customer_key() % 7).alias("w"), (customer_key() % 3).alias("l"), (order_key() % 2 == 0).alias("f"))
    i = o.filter("o_orderkey % 3 <> 1").select(order_key().alias("k"), F.lit("new").alias("a"), F.when(order_key() % 4 == 1, "").when(order_key() % 4 > 1, "new").alias("b"), (order_key() % 7).alias("w"), (order_key() % 3 - 1).alias("l"), (order_key() % 5 == 0).alias("f"))
    return merge.merge_upsert(s, i, ["k"], {"a": "first_writer", "b": "new_wins_if_present", **merge.grows(["w", "l"]), "f": "any_of"})


@query("""WITH s AS (SELECT o_custkey % 20 AS day, o_orderkey slot, 'old' v FROM orders WHERE o_custkey % 20 < 15), i AS (SELECT o_custkey % 20 AS day, CASE WHEN o_custkey % 20 = 12 THEN 1 ELSE o_orderkey END slot, 'new' v FROM orders WHERE o_custkey % 20 >= 10),
  ok AS (SELECT day FROM i GROUP BY day HAVING count(*) = count(DISTINCT slot)) SELECT * FROM s WHERE day NOT IN (SELECT day FROM ok) UNION ALL SELECT * FROM i WHERE day IN (SELECT day FROM ok)""")
def replaced_snapshots(spark, d):
    o = table(spark, d, "orders")
    s = o.filter("o_custkey % 20 < 15").select((customer_key() % 20).alias("day"), order_key().alias("slot"), F.lit("old").alias("v"))
    i = o.filter("o_custkey % 20 >= 10").select((customer_key() % 20).alias("day"), F.when(customer_key() % 20 == 12, 1).otherwise(order_key()).alias("slot"), F.lit("new").alias("v"))
    return merge.replace_snapshot(s, i, ["day"], ["slot"])


@query(f"WITH {SQL} SELECT bout_id, CASE WHEN event_id % 3 = 0 AND bout_id % 2 = 0 THEN NULL WHEN event_id IN (SELECT event_id FROM bouts WHERE event_id % 3 = 0 AND bout_id % 2 = 0) AND NOT decided THEN 'cancelled' ELSE status END status FROM bouts")
def cancelled_by_absence(spark, d):
    b = bouts(spark, d).withColumn("source", F.lit("main"))
    return merge.cancel_missing(b, b.filter("event_id % 3 = 0 AND bout_id % 2 = 0").select("bout_id", "event_id"), "main").select("bout_id", "status")


@query(f"WITH {SQL} SELECT event_id, CASE WHEN status = 'upcoming' AND event_id % 8 > 0 AND event_date < DATE '2026-02-01' THEN 'completed' ELSE status END status FROM events")
def completed_by_absence(spark, d):
    e = events(spark, d)
    return merge.complete_dropped(e, e.filter("event_id % 8 = 0"), as_of()).select("event_id", "status")


@query("WITH a AS (SELECT l_orderkey k, l_linenumber n FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT l_orderkey k, l_linenumber n FROM lineitem WHERE l_linestatus = 'F'), t AS (SELECT k FROM orders JOIN (SELECT o_orderkey k FROM orders) USING (k)), ca AS (SELECT k, count(*) c FROM a GROUP BY ALL), cb AS (SELECT k, count(*) c FROM b GROUP BY ALL), w AS (SELECT cb.k FROM cb LEFT JOIN ca USING (k) WHERE cb.c > coalesce(ca.c, 0)) SELECT k, n, 'old' v FROM a WHERE k NOT IN (SELECT k FROM w) UNION ALL SELECT k, n, 'new' FROM b WHERE k IN (SELECT k FROM w)".replace("t AS (SELECT k FROM orders JOIN (SELECT o_orderkey k FROM orders) USING (k)), ", ""))
def denser_series_kept(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_returnflag", "l_linestatus")  # noqa: E741
    return merge.denser_series(l.filter("l_returnflag <> 'R'").select("k", "n", F.lit("old").alias("v")), l.filter("l_linestatus = 'F'").select("k", "n", F.lit("new").alias("v")), "k")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 48 HOUR")
def young_rows(spark, d):
    return merge.younger_than(table(spark, d, "events"), F.lit("2024-01-10").cast("timestamp"), 48, "ts").select("event_id")
