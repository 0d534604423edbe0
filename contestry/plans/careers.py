"""Queries on whole careers: summaries, features of pairings, ranks, totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from contestry.operators import career
from contestry.plans.registry import SNAP_SQL, query
from contestry.sources.proxy import fighters, full_bouts, stat_sides, table
from contestry.sources.staged import staged

STATS = career.STATS


def exact(a: str, b: str) -> str:
    """a / b rounded half up at the sixth place in whole numbers."""
    return f"((2000000 * ({a}) + {b}) // nullif(2 * {b}, 0) / 1000000.0::DOUBLE)"


FULL_SQL = f"""
raw_side AS (SELECT l_orderkey bout_id, l_suppkey fighter_id, CAST(sum(l_quantity) AS BIGINT) sig_attempted, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) sig_landed,
  CAST(sum(l_linenumber) AS BIGINT) td_attempted, CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber ELSE 0 END) AS BIGINT) td_landed, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) sub_attempts,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) * 10 AS BIGINT) control, count(*) FILTER (l_returnflag = 'A') knockdowns, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) cents FROM lineitem GROUP BY ALL),
side AS (SELECT bout_id, fighter_id, cents, {', '.join(f"CASE WHEN (bout_id + fighter_id) % 5 <> 0 {'AND fighter_id % 7 <> 0' if c == 'sub_attempts' else ''} THEN {c} END {c}" for c in STATS)} FROM raw_side),
ends AS (SELECT bout_id, min(fighter_id) r, max(fighter_id) b FROM side GROUP BY bout_id HAVING count(*) >= 2),
bouts AS (SELECT e.bout_id, CAST(o_orderdate AS DATE) event_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'KO/TKO' WHEN '2-HIGH' THEN 'SUB choke' WHEN '3-MEDIUM' THEN 'U-DEC' WHEN '4-NOT SPECIFIED' THEN 'Other' WHEN '5-LOW' THEN 'S-DEC' END AS method,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'KO' WHEN '2-HIGH' THEN 'SUB' WHEN '3-MEDIUM' THEN 'DEC' WHEN '5-LOW' THEN 'DEC' END AS class,
  CASE WHEN o_orderkey % 11 <> 0 THEN 1 + o_orderkey % 5 END end_round, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 301 END secs, o_custkey % 6 cls, o_custkey % 3 sch, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderkey % 17 = 0 AS INT) END title,
  CASE WHEN x.cents > y.cents THEN r WHEN y.cents > x.cents THEN b END winner_id, r red_id, b blue_id, {', '.join(f'x.{c} red_{c}, y.{c} blue_{c}' for c in STATS)}
  FROM ends e JOIN side x ON x.bout_id = e.bout_id AND x.fighter_id = r JOIN side y ON y.bout_id = e.bout_id AND y.fighter_id = b JOIN orders ON o_orderkey = e.bout_id),
long AS ({' UNION ALL '.join(f"SELECT bout_id, event_date, class, end_round, (end_round - 1) * 300 + secs AS took, '{a}' AS side, {a}_id fighter_id, {b}_id opponent_id, CASE WHEN winner_id = {a}_id THEN 'win' WHEN winner_id = {b}_id THEN 'loss' ELSE 'other' END result, {', '.join(f'{a}_{c} {c}' for c in STATS)}, {', '.join(f'{b}_{c} opp_{c}' for c in career.OPPONENT)} FROM bouts" for a, b in (('red', 'blue'), ('blue', 'red')))}),
rated AS (SELECT a.bout_id, a.side, avg(CASE WHEN h.result = 'win' THEN 1.0 WHEN h.result IS NOT NULL THEN 0.0 END) prior_rate
  FROM long a LEFT JOIN long h ON h.fighter_id = a.fighter_id AND (h.event_date, h.bout_id) < (a.event_date, a.bout_id) GROUP BY ALL),
hist AS (SELECT l.*, o.prior_rate opponent_rate, ({' OR '.join(f'l.{c} IS NOT NULL' for c in STATS)}) known FROM long l JOIN rated o ON o.bout_id = l.bout_id AND o.side <> l.side),
asks AS (SELECT bout_id, event_date, side, fighter_id, opponent_id, result FROM long),
agg AS (SELECT a.bout_id, a.side, count(h.bout_id) n_prior, count(*) FILTER (h.known) n_stats, CAST(sum(coalesce(h.end_round, 0)) FILTER (h.bout_id IS NOT NULL) AS BIGINT) rounds,
  {', '.join(f'sum(coalesce(h.{c}, 0)) FILTER (h.known) s_{c}' for c in (*STATS, *[f'opp_{c}' for c in career.OPPONENT]))},
  count(*) FILTER (h.result = 'win') wins, count(*) FILTER (h.result = 'loss') losses, count(h.class) classified, count(*) FILTER (h.class = 'DEC') decided,
  {', '.join(f"count(*) FILTER (h.class = '{c}' AND h.result = 'win') w_{c}, count(*) FILTER (h.class = '{c}' AND h.result = 'loss') l_{c}" for c in ('KO', 'SUB', 'DEC'))},
  sum(h.took) took, count(h.took) n_took, avg(h.opponent_rate) opponents_win_rate, max(h.event_date) last_date, list(h.result = 'win' ORDER BY h.event_date DESC, h.bout_id DESC) FILTER (h.bout_id IS NOT NULL) results
  FROM asks a LEFT JOIN hist h ON h.fighter_id = a.fighter_id AND h.event_date < a.event_date GROUP BY ALL),
summary AS (SELECT a.bout_id, a.event_date, a.side, a.fighter_id, a.opponent_id, a.result, n_prior > 0 AND n_stats > 0 has_summary,
  CASE WHEN n_stats > 0 THEN n_prior END n_prior, CASE WHEN n_stats > 0 THEN g.rounds END rounds, CASE WHEN n_stats > 0 THEN n_stats END n_stats,
  {', '.join(f"{exact(f's_{c}', 'n_stats')} {k}" for k, c in career.PER_BOUT.items())},
  {exact('s_sig_landed', 's_sig_attempted')} sig_accuracy, {exact('s_td_landed', 's_td_attempted')} td_accuracy,
  {exact('s_opp_sig_attempted - s_opp_sig_landed', 's_opp_sig_attempted')} sig_defence, {exact('s_opp_td_attempted - s_opp_td_landed', 's_opp_td_attempted')} td_defence,
  CASE WHEN n_stats > 0 THEN round(opponents_win_rate, 6) END opponents_win_rate,
  CASE WHEN n_stats > 0 THEN CAST(CASE WHEN list_position(results, false) > 0 THEN list_position(results, false) - 1 ELSE len(results) END AS BIGINT) END win_streak,
  CASE WHEN n_stats > 0 THEN CAST(len(list_filter(results[1:5], lambda v: v)) AS BIGINT) END wins_last_5,
  {', '.join(f'CASE WHEN n_stats > 0 THEN {exact(f"w_{c}", "wins")} END {k}_win_share' for c, k in (('KO', 'ko'), ('SUB', 'sub'), ('DEC', 'dec')))},
  {', '.join(f'CASE WHEN n_stats > 0 THEN {exact(f"l_{c}", "losses")} END {k}_loss_share' for c, k in (('KO', 'ko'), ('SUB', 'sub')))},
  CASE WHEN n_stats > 0 THEN {exact('decided', 'classified')} END distance_share, CASE WHEN n_stats > 0 THEN {exact('took', 'n_took')} END duration,
  CASE WHEN n_stats > 0 THEN CAST(a.event_date - last_date AS BIGINT) END days_since, CASE WHEN n_stats > 0 THEN last_date END last_date
  FROM asks a JOIN agg g USING (bout_id, side)),
people AS (SELECT s_suppkey fighter_id, CASE WHEN s_suppkey % 9 <> 0 THEN 150.0 + s_suppkey % 50 END height_cm, CASE WHEN s_suppkey % 8 <> 0 THEN 155.0 + s_suppkey % 45 END reach_cm,
  CASE WHEN s_suppkey % 10 <> 0 THEN DATE '1960-01-01' + CAST(s_suppkey * 37 % 9000 AS INT) END birth FROM supplier)"""

RANK_SQL = f"""{SNAP_SQL}, homes AS (SELECT s_suppkey fighter_id, n_name division FROM supplier JOIN nation ON n_nationkey = s_suppkey % 25),
ranked AS (SELECT a.bout_id, a.side, rank_position ranking, row_number() OVER (PARTITION BY a.bout_id, a.side ORDER BY (lower(s.division) = lower(h.division)) DESC, snapshot_date DESC, rank_position) i
  FROM asks a JOIN homes h USING (fighter_id) LEFT JOIN snaps s ON s.fighter_id = a.fighter_id AND snapshot_date < a.event_date),
side_rows AS (SELECT s.*, p.height_cm, p.reach_cm, round((s.event_date - p.birth) / 365.25::DOUBLE, 4) age, r.ranking FROM summary s JOIN people p USING (fighter_id) JOIN ranked r ON r.bout_id = s.bout_id AND r.side = s.side AND i = 1)"""
DIFF_SQL = ", ".join(f"round(CAST(r.{c} AS DOUBLE) - b.{c}, 6) {c}_diff" for c in career.DIFFS)
SUM_SQL = ", ".join(f"round(CAST(r.{c} AS DOUBLE) + b.{c}, 6) {c}_sum" for c in career.SUMS)
LACK_SQL = " OR ".join(f"{x}.{c} IS NULL" for x in "rb" for c in career.NEEDED)
JOIN_SQL = "FROM side_rows r JOIN side_rows b ON r.bout_id = b.bout_id AND r.side = 'red' AND b.side = 'blue'"


def snapshots(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    cents = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("fighter_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("snapshot_date")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    home = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("fighter_id"), F.col("n_name").alias("division"))
    rank = F.row_number().over(Window.partitionBy("snapshot_date", "division").orderBy(F.desc("cents"), "fighter_id"))
    return cents.join(home, "fighter_id").withColumn("rank_position", rank.cast("bigint"))


def ranks_of(spark, d, sides):
    """The rank of each side (bout_id, event_date, side, fighter_id) at its day, in the division that its number gives it."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("n_"), F.col("n_name").alias("division"))
    asked = sides.select("bout_id", F.col("event_date").alias("anchor_date"), "side", "fighter_id").join(F.broadcast(nation), F.col("fighter_id") % 25 == F.col("n_")).drop("n_")  # 25 nations
    return career.latest_rank(asked, snapshots(spark, d)).select("bout_id", "side", "ranking")


def as_pairings(bouts):
    return bouts.select("bout_id", "event_date", F.col("red_fighter_id").alias("red_id"), F.col("blue_fighter_id").alias("blue_id"))


def pairings(spark, d, bouts=None, ranked=True):
    """bouts is given where a query needs it elsewhere too; it is written once and read by all that follows. ranked: false where no
    column that a query gives depends on a rank; everyone is unranked then."""
    bouts = staged(full_bouts(spark, d), "bouts") if bouts is None else bouts
    return career.pairs(bouts, fighters(spark, d), ranks_of(spark, d, career.both_sides(as_pairings(bouts))) if ranked else None)


@query(f"WITH {FULL_SQL} SELECT * FROM summary")
def career_summaries(spark, d):
    return career.summaries(full_bouts(spark, d))


@query(f"WITH {FULL_SQL}, {RANK_SQL} SELECT bout_id, side, ranking FROM ranked WHERE i = 1")
def ranks_at_bouts(spark, d):
    return ranks_of(spark, d, career.both_sides(as_pairings(full_bouts(spark, d))))


@query(f"""WITH {FULL_SQL}, {RANK_SQL} SELECT r.bout_id, r.event_date, CASE r.result WHEN 'win' THEN 1 WHEN 'loss' THEN 0 END target, CASE WHEN r.result = 'other' THEN 'no_target'
  WHEN NOT (r.has_summary AND b.has_summary) THEN 'no_history' WHEN {LACK_SQL} THEN 'no_stats' END exclusion_reason, {DIFF_SQL} {JOIN_SQL}""")
def winner_dataset(spark, d):
    return career.winner_rows(pairings(spark, d))


@query(f"""WITH {FULL_SQL}, {RANK_SQL} SELECT r.bout_id, r.event_date, CASE class WHEN 'KO' THEN 0 WHEN 'SUB' THEN 1 WHEN 'DEC' THEN 2 END target, CASE WHEN class IS NULL THEN 'no_method'
  WHEN NOT (r.has_summary AND b.has_summary) THEN 'no_history' WHEN {LACK_SQL} THEN 'no_stats' END exclusion_reason, {DIFF_SQL}, {SUM_SQL}, CASE sch WHEN 0 THEN 5 ELSE 3 END scheduled_rounds,
  list_extract([70.3, 52.2, 93.0, NULL, 56.7, 120.2]::DOUBLE[], (cls + 1)::INT) weight_kg, CASE WHEN cls IN (1, 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END is_female, title::DOUBLE is_title {JOIN_SQL} JOIN bouts o ON o.bout_id = r.bout_id""")
def method_dataset(spark, d):
    bouts = staged(full_bouts(spark, d), "bouts")
    return career.method_rows(pairings(spark, d, bouts), bouts)


@query(f"""WITH {FULL_SQL}, {RANK_SQL} SELECT coalesce(CASE WHEN r.result = 'other' THEN 'no_target' WHEN NOT (r.has_summary AND b.has_summary) THEN 'no_history' WHEN {LACK_SQL} THEN 'no_stats' END, 'kept') reason, count(*) n {JOIN_SQL} GROUP BY ALL""")
def exclusion_counters(spark, d):
    return career.winner_rows(pairings(spark, d, ranked=False)).groupBy(F.coalesce("exclusion_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


#: For each customer a meeting that nobody fought: two suppliers of its lines, a week after its last order; that may be any day.
ASKED_SQL = """wished AS (SELECT o_custkey bout_id, CAST(max(o_orderdate) AS DATE) + 7 event_date, arg_min(l_suppkey, (l_partkey, l_orderkey, l_linenumber)) red_id, arg_max(l_suppkey, (l_partkey, l_orderkey, l_linenumber)) blue_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
pairing AS (SELECT * FROM wished WHERE red_id <> blue_id), """
FREE_SQL = FULL_SQL.replace("asks AS (SELECT bout_id, event_date, side, fighter_id, opponent_id, result FROM long)", f"""{ASKED_SQL}
asks AS (SELECT bout_id, event_date, 'red' AS side, red_id fighter_id, blue_id opponent_id, NULL::VARCHAR result FROM pairing UNION ALL SELECT bout_id, event_date, 'blue', blue_id, red_id, NULL FROM pairing)""")


def wished(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    place = F.struct("l_partkey", "l_orderkey", "l_linenumber")
    each = lines.groupBy(F.col("o_custkey").alias("bout_id")).agg(F.date_add(F.max(F.to_date("o_orderdate")), 7).alias("event_date"), F.min_by("l_suppkey", place).alias("red_id"), F.max_by("l_suppkey", place).alias("blue_id"))
    return each.filter("red_id <> blue_id")


@query(f"WITH {FREE_SQL} SELECT bout_id, event_date, side, fighter_id, opponent_id, {', '.join(career.FIELDS)}, has_summary FROM summary")
def summaries_on_any_day(spark, d):
    """The summary of a participant on a day without a bout."""
    return career.summaries_at(full_bouts(spark, d), career.both_sides(wished(spark, d))).drop("result")


@query(f"WITH {FREE_SQL}, {RANK_SQL} SELECT r.bout_id, r.event_date, r.fighter_id red_id, b.fighter_id blue_id, r.has_summary AND b.has_summary known, {DIFF_SQL} {JOIN_SQL}")
def hypothetical_pairings(spark, d):
    """The features of meetings that nobody fought, by the expressions of the dataset."""
    bouts, asked = staged(full_bouts(spark, d), "bouts"), staged(wished(spark, d), "wished")
    rows = career.pairs(bouts, fighters(spark, d), ranks_of(spark, d, career.both_sides(asked)), asked)
    return rows.join(asked, ["bout_id", "event_date"]).select("bout_id", "event_date", "red_id", "blue_id", (F.col("red.has_summary") & F.col("blue.has_summary")).alias("known"), *career.diffs())


@query(f"WITH {FULL_SQL} SELECT bout_id, event_date FROM bouts WHERE false")
def leak_check(spark, d):
    return career.leaks(pairings(spark, d, ranked=False))


@query(f"WITH {FULL_SQL} SELECT r.bout_id, r.event_date FROM summary r JOIN summary b ON r.bout_id = b.bout_id AND r.side = 'red' AND b.side = 'blue' WHERE r.has_summary AND b.has_summary ORDER BY r.event_date DESC, r.bout_id DESC LIMIT 5")
def latest_spot_checks(spark, d):
    return career.spot_checks(pairings(spark, d, ranked=False))


@query(f"""WITH {FULL_SQL}, t AS (SELECT fighter_id, count(*) n, {', '.join(f'coalesce(sum({c}), 0)::DOUBLE {c}' for c in STATS)} FROM side GROUP BY ALL)
  SELECT p.fighter_id, coalesce(n, 0) total_bouts, round(coalesce(sig_landed, 0) / greatest(coalesce(n, 0), 1), 6) sig_per_bout, round(coalesce(sig_landed / nullif(sig_attempted, 0), 0), 6) sig_accuracy, round(coalesce(knockdowns, 0) / greatest(coalesce(n, 0), 1), 6) knockdowns_per_bout,
  round(coalesce(td_landed, 0) / greatest(coalesce(n, 0), 1), 6) td_per_bout, round(coalesce(td_landed / nullif(td_attempted, 0), 0), 6) td_accuracy, round(coalesce(sub_attempts, 0) / greatest(coalesce(n, 0), 1), 6) subs_per_bout, round(coalesce(control, 0) / greatest(coalesce(n, 0), 1), 6) control_per_bout
  FROM people p LEFT JOIN t USING (fighter_id)""")
def participant_totals(spark, d):
    return career.career_totals(fighters(spark, d).select("fighter_id"), stat_sides(spark, d))
