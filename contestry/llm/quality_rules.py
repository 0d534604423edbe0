"""Quality rules as a learned decision list.

Sequential covering over labelled statistics: each rule is a conjunction of thresholds, grown on two thirds of the
labelled rows for the greatest information gain, then pruned on the other third; the rows it covers leave and the next
rule is grown. All counts are Spark aggregates over binned statistics, and the list is one ordered CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import fold, table, written
from contestry.llm.textstats import with_stats

#: Ratios that rules may test, each defined (zero) for an empty text.
RATIOS = {
    "words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: ratio("n_symbols", "n_words"),
    "upper_per_char": lambda: ratio("n_upper", "word_chars"),
    "shouts_per_word": lambda: ratio("n_shouts", "n_words"),
    "stops_per_word": lambda: ratio("n_stops", "n_words"),
    "digits_per_char": lambda: ratio("n_digits", "word_chars"),
    "dup_lines": lambda: ratio("n_dup_lines", "n_lines"),
    "distinct_words": lambda: ratio("n_distinct", "n_words"),
    "repeated_words": lambda: ratio("n_repeat_words", "n_words"),
}


def ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


@dataclass(frozen=True)
class Test:
    """One threshold: column > value, or column <= value."""

    column: str
    above: bool
    value: float

    def expr(self) -> Column:
        c = F.col(self.column)
        return c > self.value if self.above else c <= self.value

    def __str__(self) -> str:
        return f"{self.column} {'>' if self.above else '<='} {self.value:.6g}"


def both(tests: Sequence[Test]) -> Column:
    return reduce(lambda a, b: a & b, (t.expr() for t in tests), F.lit(True))


def learn(
    rows: DataFrame, columns: Sequence[str], bins: int = 24, max_rules: int = 8, max_tests: int = 3, min_precision: float = 0.75, min_cover: float = 0.002
) -> list[list[Test]]:
    """Rules that find rows with bad = true. rows: the columns, bad boolean and grow boolean, any number of rows.

    Empty input, or input of one class, gives no rules. Ties go to the column that comes first, then to the lower
    threshold, so that the same rows always give the same list.
    """
    levels = [i / bins for i in range(1, bins)]
    cuts_row = rows.select(*[F.percentile_approx(F.when(F.col("bad") == b, F.col(c)), levels, 10000).alias(f"{c}_{b}") for c in columns for b in (True, False)]).first()
    cuts = {c: sorted({float(x) for b in (True, False) for x in cuts_row[f"{c}_{b}"] or ()}) for c in columns}
    # A value's bin is the number of cuts below it, so "> cut k" is "bin > k".
    place = lambda c: reduce(lambda a, b: a + b, [(F.col(c) > x).cast("int") for x in cuts[c]], F.lit(0))
    rows = rows.select("bad", "grow", *columns, F.array(*[F.struct(F.lit(i).alias("c"), place(c).alias("b")) for i, c in enumerate(columns)]).alias("at"))
    rows = written(rows, "quality-binned")
    counts = lambda df: df.agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
    rules: list[list[Test]] = []
    left = rows
    all_bad = rows.agg(F.count_if(F.col("bad") & F.col("grow"))).first()[0]
    while len(rules) < max_rules:
        tests: list[Test] = []
        pool = left.filter("grow")
        p0, n0 = counts(pool)
        if p0 < max(5, min_cover * all_bad):
            break
        while len(tests) < max_tests and n0 > 0:
            seen = pool.filter(both(tests)).select(F.explode("at").alias("x"), "bad").groupBy("x.c", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            best = (0.0, None, 0, 0)
            for i, c in enumerate(columns):
                at = {r["b"]: (r["p"], r["n"]) for r in seen if r["c"] == i}
                for k, cut in enumerate(cuts[c]):
                    low = [sum(v[j] for b, v in at.items() if b <= k) for j in (0, 1)]
                    for above, (p, n) in ((False, low), (True, [p0 - low[0], n0 - low[1]])):
                        if p >= max(3, min_cover * all_bad):
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, Test(c, above, cut), p, n)
            if best[1] is None:
                break
            tests.append(best[1])
            p0, n0 = best[2], best[3]
        if not tests:
            break
        # Prune: the prefix with the best (p - n) / (p + n) on rows that did not grow it.
        held = left.filter(~F.col("grow"))
        got = held.agg(*[F.count_if(both(tests[: k + 1]) & (F.col("bad") == b)).alias(f"{k}_{b}") for k in range(len(tests)) for b in (True, False)]).first()
        worth = [((got[f"{k}_True"] + 1) / (got[f"{k}_True"] + got[f"{k}_False"] + 2), -k) for k in range(len(tests))]
        best_k = max(range(len(tests)), key=lambda k: worth[k])
        if worth[best_k][0] < min_precision:
            break
        rules.append(tests[: best_k + 1])
        left = left.filter(~both(rules[-1]))
    return rules


def verdict(rules: Sequence[Sequence[Test]], yes: str = "bad") -> Column:
    """The list as one CASE: the number of the first rule that holds, from 1; 0 where none does."""
    out = F
    for i, tests in enumerate(rules, 1):
        out = out.when(both(tests), F.lit(i))
    return (out.otherwise(F.lit(0)) if rules else F.lit(0)).alias(yes)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[list[Test]]]:
    """Statistics of every document with the number of the rule that rejects it, and the rules.

    Rules are learned from documents with quality 0 or 1 in labels (several labels of one id: the lowest counts);
    crc32 of the id decides which third prunes. Without labels of both kinds nothing is rejected.
    """
    stats = written(with_stats(docs, id_col, text_col, windows=True), "quality-stats")
    stats = stats.withColumns({c: f() for c, f in RATIOS.items()})
    marked = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.join(marked, "doc_id").select(*RATIOS, (F.col("quality") == 0).alias("bad"), (fold("doc_id", 3) != 0).alias("grow"))
    rules = learn(known, list(RATIOS))
    return stats.withColumn("rule", verdict(rules)), rules


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("rule") == 0)).alias("kept"), "rule"
    )
