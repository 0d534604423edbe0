"""Queries on names by their trigrams, and on what a model's features add."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.operators import attributions, career, isotonic, metrics, models, trigrams
from contestry.plans.careers import pairings
from contestry.plans.registry import SCORED_SQL, query, scored
from contestry.sources.proxy import full_bouts, table
from contestry.sources.staged import staged

NAMES = (("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"))
TRIGRAM_SQL = f"""WITH n AS ({' UNION ALL '.join(f"SELECT '{t}-' || {k} AS id, {k} % 100 = 0 AS asks, {c} AS name FROM {t}" for t, k, c in NAMES)}),
  w AS (SELECT id, asks, '  ' || unnest(list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) || ' ' AS w FROM n),
  g AS (SELECT id, asks, list(DISTINCT g) AS g FROM (SELECT id, asks, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2])) AS g FROM w) GROUP BY ALL),
  p AS (SELECT a.id AS asked_id, b.id AS known_id, len(list_intersect(a.g, b.g)) AS common, len(a.g) + len(b.g) AS n FROM g a, g b WHERE a.asks)
  SELECT asked_id, known_id, common / (n - common)::DOUBLE AS similarity FROM p WHERE common / (n - common)::DOUBLE >= """


def names(spark, d):
    out = None
    for t, k, c in NAMES:
        rows = table(spark, d, t).select(F.concat(F.lit(f"{t}-"), F.col(k)).alias("id"), (F.col(k) % 100 == 0).alias("asks"), F.col(c).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"{TRIGRAM_SQL} 0.7")
def similar_names(spark, d):
    """Names of all three tables that are alike, for every id that is divisible by 100."""
    every = names(spark, d)
    return trigrams.similar_names(every.filter("asks").withColumnRenamed("id", "asked_id"), every.withColumnRenamed("id", "known_id"), "asked_id", "known_id", least=0.7)


@query(f"SELECT asked_id, known_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY similarity DESC, known_id) i FROM ({TRIGRAM_SQL} 0.3) WHERE asked_id LIKE 'part%') WHERE i <= 5")
def names_searched(spark, d):
    """A search's first five answers among all names: the most similar, then the first id."""
    every = names(spark, d)
    asked = every.filter("asks AND id LIKE 'part%'").withColumnRenamed("id", "asked_id")
    return trigrams.most_similar(asked, every.withColumnRenamed("id", "known_id"), "asked_id", "known_id", 5)


#: Each fitted score's value is the greatest, over the scores at or before it, of the least mean from there to any score at or after it.
@query(f"""WITH {SCORED_SQL}, t AS (SELECT p, sum(y)::BIGINT s, count(*) n, row_number() OVER (ORDER BY p) i FROM scored WHERE doc_id % 2 = 0 GROUP BY p), c AS (SELECT *, sum(s) OVER (ORDER BY i) cs, sum(n) OVER (ORDER BY i) cn FROM t),
  m AS (SELECT a.i a, b.i b, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)::DOUBLE m FROM c a JOIN c b ON b.i >= a.i), l AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) least FROM m),
  f AS (SELECT p, max(least) v FROM l JOIN t ON t.i = l.b GROUP BY p), x AS (SELECT s.doc_id, s.p, (SELECT max(p) FROM f WHERE f.p <= s.p) lo, (SELECT min(p) FROM f WHERE f.p >= s.p) hi FROM scored s)
  SELECT doc_id, x.p, round(CASE WHEN lo IS NULL THEN h.v WHEN hi IS NULL OR lo = hi THEN g.v ELSE (h.v - g.v) / (hi - lo) * (x.p - lo) + g.v END, 6) calibrated FROM x LEFT JOIN f g ON g.p = lo LEFT JOIN f h ON h.p = hi""")
def isotonic_scores(spark, d):
    """Every score calibrated by an isotonic fit to the documents of even ids."""
    rows = scored(spark, d).select("doc_id", "p", "y")
    return isotonic.calibrated(rows, isotonic.fit(rows.filter("doc_id % 2 = 0"))).select("doc_id", "p", F.round("calibrated", 6).alias("calibrated"))


def split_rows(spark, d):
    """The features' names, winner rows that may be used, with the first four fifths of the days (fits) and the last tenth (late), and a function that imputes by
    the medians of what fits."""
    names_ = [f"{c}_diff" for c in career.DIFFS]
    rows = staged(career.winner_rows(pairings(spark, d)).filter("exclusion_reason IS NULL").withColumnRenamed("target", "y"), "winner-rows")
    cut = rows.select(F.percentile(F.unix_date("event_date"), F.array(F.lit(0.8), F.lit(0.9))).alias("c")).first()["c"] or [0, 0]
    day = F.unix_date("event_date")
    rows = rows.withColumns({"fits": day <= cut[0], "late": day > cut[1]})
    impute = models.imputer(rows.filter("fits"), names_)
    return names_, rows, lambda df: impute(df).na.fill(0.0, names_)


@query()
def held_out_variants(spark, d):
    """The four forms of the boosted trees' probability on the last tenth of the days, and the baselines there: accuracy, log loss, Brier score and AUC.

    A missing difference is imputed after the corners are swapped, and stays what it was. The calibration is the better of isotonic and sigmoid by
    out-of-fold Brier score on the tenth before. baseline: the rate of red wins in what was fitted; majority: its more frequent class for accuracy, a
    half as probability. The trees' settings are fixed; no search is made.
    """
    names_, rows, impute = split_rows(spark, d)
    fits = rows.filter("fits")
    trees = models.boosted(impute(fits), names_, {"maxDepth": 3, "maxIter": 10})
    got = models.variants(rows.filter("NOT fits AND NOT late"), rows.filter("late"), "bout_id", names_, lambda df, name: trees(impute(df), name))
    return metrics.against_baselines(staged(got, "variants"), ["raw", "symmetrised", "raw_calibrated", "symmetrised_calibrated"], fits)


@query()
def held_out_methods(spark, d):
    """The three-class blend on the last tenth of the days: each class's scores beside the classes' own shares."""
    names_ = [f"{c}_diff" for c in career.DIFFS] + [f"{c}_sum" for c in career.SUMS]
    bouts = staged(full_bouts(spark, d), "bouts")
    rows = staged(career.method_rows(pairings(spark, d, bouts), bouts).filter("exclusion_reason IS NULL").withColumnRenamed("target", "y"), "method-rows")
    cut = rows.select(F.percentile(F.unix_date("event_date"), F.lit(0.9)).alias("c")).first()["c"] or 0
    rows = models.median_impute(rows.withColumn("fits", F.unix_date("event_date") <= cut), names_, "fits").na.fill(0.0, names_)
    classes = ["ko", "sub", "dec"]
    score = models.method_model(rows.filter("fits"), names_, classes, {"maxDepth": 3, "maxIter": 5})
    told = score(rows.filter("NOT fits")).select("y", *[f"p_{c}" for c in classes])
    return metrics.multiclass_metrics(staged(told, "method-scores"), classes)  # each row is scored once


@query()
def attributed_predictions(spark, d):
    """The five features that told most for either side of every pairing, by boosted trees fitted on the first four fifths of the days."""
    names_, rows, impute = split_rows(spark, d)
    rows = impute(rows)
    trees = attributions.leaves(models.fitted(rows.filter("fits"), names_, {"maxDepth": 3, "maxIter": 10}), spark)
    return attributions.top_features(attributions.symmetrised_parts(rows, "bout_id", names_, trees), "bout_id", names_)
