"""Queries on live passes, replayed as a stream; their twins work a bout's passes off one by one in a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.plans.registry import query
from contestry.sources.proxy import table
from contestry.sources.staged import new_path
from contestry.streaming import live, metering, ordered
from contestry.streaming.changes import replay

PASS_SQL = """p AS (SELECT user_id bout_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, CASE event_id % 10 WHEN 0 THEN 'pre' WHEN 8 THEN 'post' WHEN 9 THEN 'post' ELSE 'in' END st,
    event_type = 'error' AND event_id % 3 < 2 cancelled, event_id % 3 = 1 suspended, CAST(event_id % 4 AS INT) period, CAST(floor(value) AS INT) || 's' clock,
    CASE WHEN event_id % 3 > 0 THEN 'a' || event_id % 5 END sa, CASE WHEN event_id % 4 <> 1 THEN 'b' || event_id % 3 END sb, user_id % 5 > 0 wants_b FROM events)"""
WALK_SQL = f"""WITH RECURSIVE {PASS_SQL}, r AS (
  SELECT bout_id, 0::BIGINT i, NULL::TIMESTAMP ts, false alive, NULL::VARCHAR st, NULL::INT period, NULL::VARCHAR clock, NULL::VARCHAR sa, NULL::VARCHAR sb, false fin, NULL::TIMESTAMP upd, NULL::VARCHAR smp, false wrote, false sampled, false dropped, false cut FROM (SELECT DISTINCT bout_id FROM p)
  UNION ALL
  SELECT bout_id, i, ts, CASE WHEN cancelled THEN false WHEN ok THEN true ELSE alive END, CASE WHEN cancelled THEN NULL WHEN ok THEN nst ELSE ost END, CASE WHEN cancelled THEN NULL WHEN ok THEN nperiod ELSE operiod END, CASE WHEN cancelled THEN NULL WHEN ok THEN nclock ELSE oclock END,
    CASE WHEN cancelled THEN NULL WHEN ok THEN nsa ELSE osa END, CASE WHEN cancelled THEN NULL WHEN ok THEN nsb ELSE osb END, CASE WHEN cancelled THEN false WHEN ok THEN nfin ELSE fin END, CASE WHEN cancelled THEN NULL WHEN ok THEN ts ELSE upd END,
    CASE WHEN cancelled AND suspended THEN smp WHEN cancelled THEN NULL WHEN ok AND has AND seen IS DISTINCT FROM smp THEN seen ELSE smp END, ok, ok AND has AND seen IS DISTINCT FROM smp, cancelled, cancelled AND NOT suspended
  FROM (SELECT *, concat_ws('|', nst, coalesce(CAST(nperiod AS VARCHAR), '-'), nclock, coalesce(nsa, '-'), coalesce(nsb, '-')) seen, (nsa IS NOT NULL OR nsb IS NOT NULL) AND nperiod >= 1 has FROM (
    SELECT p.bout_id, p.i, p.ts, p.cancelled, p.suspended, r.alive, r.st ost, r.period operiod, r.clock oclock, r.sa osa, r.sb osb, r.fin, r.upd, r.smp,
      NOT p.cancelled AND p.st <> 'pre' AND NOT (r.alive AND r.fin AND p.ts - r.upd <= INTERVAL 2 HOUR) ok, CASE WHEN r.st = 'post' THEN 'post' ELSE p.st END nst, p.period nperiod, p.clock nclock, coalesce(p.sa, r.sa) nsa, coalesce(p.sb, r.sb) nsb,
      r.fin OR (p.st = 'post' AND p.sa IS NOT NULL AND (NOT wants_b OR p.sb IS NOT NULL)) nfin
    FROM r JOIN p ON p.bout_id = r.bout_id AND p.i = r.i + 1)))"""


def passes(spark, d, stream=None):
    if stream is None:
        stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # a pattern, as a stream's plain path has to be a folder
    k = F.col("event_id")
    error = F.col("event_type") == "error"
    return stream.select(
        F.col("user_id").alias("bout_id"), F.col("ts").cast("timestamp").alias("ts"), k.alias("place"), F.when(k % 10 == 0, "pre").when(k % 10 >= 8, "post").otherwise("in").alias("state"),
        F.when(error & (k % 3 == 0), "STATUS_CANCELED").when(error & (k % 3 == 1), "STATUS_SUSPENDED").otherwise("STATUS_X").alias("status"), (k % 4).cast("int").alias("period"), F.concat(F.floor("value").cast("int").cast("string"), F.lit("s")).alias("clock"),
        F.when(k % 3 > 0, F.concat(F.lit("a"), (k % 5).cast("string"))).alias("stats_a"), F.when(k % 4 != 1, F.concat(F.lit("b"), (k % 3).cast("string"))).alias("stats_b"), F.lit(True).alias("wants_a"), (F.col("user_id") % 5 > 0).alias("wants_b"),
    )


def replayed(spark, d):
    return replay(live.live_rows(passes(spark, d)))


def second(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"{WALK_SQL} SELECT bout_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, unnest(list_filter([CASE WHEN dropped THEN 'drop' END, CASE WHEN cut THEN 'drop_series' END, CASE WHEN wrote THEN 'write' END, CASE WHEN sampled THEN 'sample' END], lambda k: k IS NOT NULL)) kind, st state, period, clock, sa stats_a, sb stats_b, fin is_final FROM r WHERE i > 0")
def live_log(spark, d):
    return replayed(spark, d).withColumn("at", second("ts")).drop("ts")


@query(f"{WALK_SQL}, z AS (SELECT bout_id, arg_max(alive, i) alive, max(i) n FROM r GROUP BY ALL) SELECT bout_id, st state, period, clock, sa stats_a, sb stats_b, fin is_final, strftime(upd, '%Y-%m-%d %H:%M:%S') AS at FROM r JOIN z USING (bout_id) WHERE i = n AND r.alive")
def live_states(spark, d):
    return live.latest(replayed(spark, d)).withColumn("at", second("updated_at")).drop("updated_at")


@query(f"{WALK_SQL}, c AS (SELECT bout_id, max(i) FILTER (cut) i0 FROM r GROUP BY ALL) SELECT bout_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, st state, period, clock, sa stats_a, sb stats_b FROM r JOIN c USING (bout_id) WHERE sampled AND (i0 IS NULL OR i > i0)")
def live_series(spark, d):
    return live.series(replayed(spark, d)).withColumn("at", second("ts")).drop("ts")


#: The walk in which a row that nobody wrote for two days is gone before the next pass.
GONE = "(r.alive AND p.ts > r.upd + INTERVAL 48 HOUR)"
WALK_ENDING_SQL = WALK_SQL
for _old, _new in (
    ("r.alive, r.st ost, r.period operiod, r.clock oclock, r.sa osa, r.sb osb, r.fin, r.upd, r.smp,", f"r.alive AND NOT {GONE} alive, " + ", ".join(f"CASE WHEN NOT coalesce({GONE}, false) THEN r.{c} END {n}" for c, n in (("st", "ost"), ("period", "operiod"), ("clock", "oclock"), ("sa", "osa"), ("sb", "osb"))) + f", r.fin AND NOT coalesce({GONE}, false) fin, r.upd, CASE WHEN NOT coalesce({GONE}, false) THEN r.smp END smp,"),
    ("CASE WHEN r.st = 'post' THEN", f"CASE WHEN r.st = 'post' AND NOT coalesce({GONE}, false) THEN"),
    ("coalesce(p.sa, r.sa) nsa, coalesce(p.sb, r.sb) nsb", f"coalesce(p.sa, CASE WHEN NOT coalesce({GONE}, false) THEN r.sa END) nsa, coalesce(p.sb, CASE WHEN NOT coalesce({GONE}, false) THEN r.sb END) nsb"),
    ("r.fin OR (p.st", f"(r.fin AND NOT coalesce({GONE}, false)) OR (p.st"),
):
    assert _old in WALK_ENDING_SQL
    WALK_ENDING_SQL = WALK_ENDING_SQL.replace(_old, _new)


def ordered_replay(spark, d):
    """The events as passes in a folder of three files, none of which is in order, replayed a file a batch."""
    at = passes(spark, d, table(spark, d, "events"))
    folder = new_path(spark, "passes")
    at.withColumn("place", F.col("place").cast("bigint")).repartition(3, F.xxhash64("place")).write.parquet(folder)
    return ordered.replay_folder(spark, folder, 1, delay="400 days")  # the files hold all times each, so everything waits for the last one


@query(f"""{WALK_ENDING_SQL}, w AS (SELECT *, lead(ts) OVER (PARTITION BY bout_id ORDER BY i) nts FROM r WHERE wrote OR dropped)
  SELECT bout_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, unnest(list_filter([CASE WHEN dropped THEN 'drop' END, CASE WHEN cut THEN 'drop_series' END, CASE WHEN wrote THEN 'write' END, CASE WHEN sampled THEN 'sample' END], lambda k: k IS NOT NULL)) kind, st state, period, clock, sa stats_a, sb stats_b, fin is_final FROM r WHERE i > 0
  UNION ALL SELECT bout_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S'), 'reseal_due', st, period, clock, sa, sb, fin FROM w WHERE wrote AND fin AND (nts IS NULL OR nts > ts + INTERVAL 2 HOUR)
  UNION ALL SELECT bout_id, strftime(ts + INTERVAL 48 HOUR, '%Y-%m-%d %H:%M:%S'), 'expired', st, period, clock, sa, sb, fin FROM w WHERE wrote AND (nts IS NULL OR nts > ts + INTERVAL 48 HOUR)""")
def ordered_live_log(spark, d):
    return ordered_replay(spark, d).withColumn("at", second("ts")).drop("ts")


@query("""SELECT unnest(['rows', 'live', 'over', 'cancelled', 'fresh']) metric, unnest([count(*), count(*) FILTER (event_id % 10 BETWEEN 1 AND 7), count(*) FILTER (event_id % 10 >= 8), count(*) FILTER (event_type = 'error' AND event_id % 3 < 2), count(*) FILTER (event_id % 3 > 0 OR event_id % 4 <> 1)]) AS value FROM events""")
def loop_metrics(spark, d):
    """What a replayed stream's observed counts add up to."""
    state = F.col("state")
    counted = metering.observed(passes(spark, d), "passes", {"live": state == "in", "over": state == "post", "cancelled": live.is_cancelled(F.col("status")), "fresh": F.col("stats_a").isNotNull() | F.col("stats_b").isNotNull()})
    meter = metering.Meter(spark, new_path(spark, "metrics"))
    spark.streams.addListener(meter)
    try:
        replay(counted.select("bout_id", "ts", "state"))
        metering.await_listeners(spark)
    finally:
        spark.streams.removeListener(meter)
    meter.flush()
    return metering.totals(spark, meter.path, "passes")
