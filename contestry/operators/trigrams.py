"""Search for similar names by their trigrams, with an inverted index instead of all pairs.

A text's trigrams are those of its words (letters and digits, accents and case aside), each word with two spaces before it and one
behind; two texts are as similar as the share of trigrams that both have among those that either has. For a similarity of s
or more a text must share one of its rarest trigrams with its partner: of n, all but the ceil(s * n) - 1 most frequent. Only those are
indexed. A trigram that very many texts index is split, so none of its postings meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestry.functions.text import strip_accents
from contestry.sources.staged import staged

#: Postings of a trigram that stay together.
POSTINGS = 20_000
#: The most trigrams whose numbers are broadcast.
OFTEN = 1 << 16


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text whose accents are stripped; NULL of NULL, none of a text without letters or digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))


def similarity(a: Column, b: Column) -> Column:
    """The share of common trigrams (arrays of distinct ones) among all; 0 where neither has any."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def least_common(least: float, n: Column) -> Column:
    """How many of n trigrams a text shares at least with one as similar as least."""
    return F.greatest(F.ceil(n * F.lit(least) - 1e-9).cast("int"), F.lit(1))


def packed(gram: Column) -> Column:
    """A trigram as one number: its three code points of 21 bits."""
    at = lambda i: F.ascii(F.substring(gram, i, 1)).cast("bigint")
    return F.shiftleft(at(1), 42).bitwiseOR(F.shiftleft(at(2), 21)).bitwiseOR(at(3))


def similar_texts(asked: DataFrame, known: DataFrame, text: str = "name", least: float = 0.3, postings: int = POSTINGS) -> DataFrame:
    """asked_, known_ (texts without accents, each once) and similarity of all pairs as similar as least or more (above 0).

    Work grows with the postings that meet; they are the rarest trigrams of each text. Rows that are exploded look as small as what they come from,
    so their joins are sorted merges; only counts of bounded number are broadcast.
    """
    side = lambda df, asks: df.filter(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.lit(asks).alias("asks"), F.lit(not asks).alias("has"))
    once = lambda df: df.groupBy("t").agg(F.max("asks").alias("asks"), F.max("has").alias("has"))
    each = once(once(side(asked, True).unionByName(side(known, False))).withColumn("t", strip_accents("t")))
    each = staged(each.withColumn("g", F.transform(trigrams(F.col("t")), packed)), "trigram-texts").filter(F.size("g") > 0)
    # Any one order of the trigrams will do: those of a 65536th of all postings or more by their number, before them the others, which are rare.
    every = each.agg(F.sum(F.size("g"))).first()[0] or 0
    often = each.select(F.explode("g").alias("g")).groupBy("g").agg(F.count("*").alias("f")).filter(F.col("f") * OFTEN >= every)
    flat = each.select("t", "asks", "has", F.explode("g").alias("g")).join(F.broadcast(often), "g", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    ranked = flat.groupBy("t", "asks", "has").agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("all"))  # as many as the text has trigrams
    ranked = staged(ranked.select("t", "asks", "has", F.transform("all", lambda x: x["g"]).alias("grams")), "trigram-ranked")
    n = F.size("grams")
    rare = ranked.select("t", "asks", "has", "grams", F.posexplode(F.slice("grams", F.lit(1), n - least_common(least, n) + 1)).alias("i", "g"))
    # The texts of a hot trigram meet in cells of some known and some that ask; the cells lie in different tasks.
    wide = max(postings // 10, 1)
    parts = lambda c, size: F.ceil(F.count_if(c) / F.lit(size)).cast("int")
    hot = rare.groupBy("g").agg(parts("has", postings).alias("rows"), parts("asks", wide).alias("columns")).filter("rows > 0 AND columns > 0 AND rows + columns > 2")
    dealt = rare.join(F.broadcast(hot), "g", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("rows", "columns")})  # one for each so many postings
    cells = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.hash("t"), F.col(c))
    index = dealt.filter("has").select("g", own("rows").alias("row"), cells("columns").alias("column"), F.col("t").alias("known_"), F.col("grams").alias("h"), F.col("i").alias("j"))
    ask = dealt.filter("asks").select("g", cells("rows").alias("row"), own("columns").alias("column"), F.col("t").alias("asked_"), "grams", "i")
    a, b = F.size("grams"), F.size("h")
    # At the first trigram that a pair has in common, what is left of either must be enough.
    fits = (F.least(a, b) >= F.greatest(a, b) * least - 1e-9) & (F.least(a - F.col("i"), b - F.col("j")) >= (a + b) * (least / (1 + least)) - 1e-9)
    met = ask.hint("merge").join(index.hint("merge"), ["g", "row", "column"]).filter(fits)
    return met.select("asked_", "known_", similarity(F.col("grams"), F.col("h")).alias("similarity")).filter(F.col("similarity") >= least).distinct()


def named(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key and the text without accents, of rows with a text."""
    return rows.filter(F.col(text).isNotNull()).select(key, strip_accents(F.col(text)).alias(name))


def similar_names(asked: DataFrame, known: DataFrame, asked_id: str, known_id: str, text: str = "name", least: float = 0.3, postings: int = POSTINGS) -> DataFrame:
    """asked_id, known_id and similarity of all pairs as similar as least or more (above 0); ids are unique, and rows without text meet nobody.

    Texts that are equal are compared once. The sides with ids are never broadcast: files of repeated texts are small, their rows aren't.
    """
    near = similar_texts(asked, known, text, least, postings)
    return named(asked, asked_id, text, "asked_").hint("merge").join(near.hint("merge"), "asked_").join(named(known, known_id, text, "known_").hint("merge"), "known_").select(asked_id, known_id, "similarity")


def most_similar(asked: DataFrame, known: DataFrame, asked_id: str, known_id: str, n: int, text: str = "name", least: float = 0.3, postings: int = POSTINGS) -> DataFrame:
    """The first n rows of similar_names of each asked_id: the most similar, then the smallest known_id.

    Of equal known texts the n smallest ids are enough, and equal asked texts have one answer, so rows never multiply by copies. The sides with
    ids are never broadcast, however small their files look.
    """
    near = similar_texts(asked, known, text, least, postings)
    firsts = named(known, known_id, text, "known_")
    place = F.row_number().over(Window.partitionBy("known_").orderBy(known_id))
    firsts = firsts.withColumn("i_", place).filter(F.col("i_") <= n).drop("i_")  # Spark limits each group before the shuffle as well
    answers = near.join(firsts.hint("merge"), "known_").select("asked_", known_id, "similarity")
    best = F.row_number().over(Window.partitionBy("asked_").orderBy(F.desc("similarity"), known_id))
    answers = answers.withColumn("i_", best).filter(F.col("i_") <= n).drop("i_")
    return named(asked, asked_id, text, "asked_").hint("merge").join(answers, "asked_").select(asked_id, known_id, "similarity")
