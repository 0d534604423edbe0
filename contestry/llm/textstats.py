"""Statistics of whole texts as built-in Spark expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestry.llm.common import SPACE

#: Punctuation that is rare in prose.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", windows: bool = False) -> DataFrame:
    """One row per document: its id and counts of words, characters, lines and repeats.

    A null text counts as empty, and an empty one has zero everywhere. Other columns are left out, so that
    clashing names can't matter. Repeated ids give repeated rows. With windows, n_repeat_words counts the words
    in windows of eight words that occur twice or more in the text, the first occurrence included.
    """
    step = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    step = step.select(
        "doc_id",
        "t",
        F.array_remove(F.split("t", f"{SPACE}+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    step = step.select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length("t").cast("long").alias("n_chars"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"[!?]")).cast("long").alias("n_shouts"),
        F.regexp_count("t", F.lit(r"[.,;:]")).cast("long").alias("n_stops"),
        F.regexp_count("t", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    )
    if not windows:
        return step.drop("w")
    keep = [c for c in step.columns if c != "w"]
    hashes = F.when(F.size("w") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("w") - WINDOW + 1), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))
    )
    step = step.select(*keep, hashes.alias("h"))
    # Only texts with a repeat sort their windows: those of equal hash are then neighbours.
    placed = F.when(
        F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    )
    step = step.select(*keep, placed.alias("p"))
    same = lambda a, b: F.get("p", a)["h"] == F.get("p", b)["h"]
    again = F.transform(
        F.filter("p", lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))), lambda x: x["at"]
    )
    step = step.select(*keep, F.sort_array(again).alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return step.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
