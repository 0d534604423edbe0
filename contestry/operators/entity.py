"""Entity resolution on keys: unambiguous indexes, best candidates, keepers of duplicate groups and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions.names import corner_of
from contestry.functions.scalar import event_tokens
from contestry.functions.text import casefold_name, fold_name, similarity, strip_accents
from contestry.operators.lookups import plain_key
from contestry.sources.staged import staged


def unambiguous_index(entities: DataFrame, key: str, entity: str) -> DataFrame:
    """key and the one entity that owns it. A key of two or more entities matches nobody; null keys are left out."""
    ends = entities.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(entity).alias(entity), F.max(entity).alias("last_"))
    return ends.filter(F.col(entity) == F.col("last_")).drop("last_")


def best_unambiguous(candidates: DataFrame, key: str, entity: str, score: str, least: float, margin: float) -> DataFrame:
    """For each key the entity of the best score, if that is at least `least` and no other entity that reaches `least` itself is
    nearer to it than `margin`.

    Two aggregations: the best score of each pair, then the two best entities of each key as a fold over one struct, so no
    key's candidates are ever gathered or sorted in one task.
    """
    pairs = candidates.groupBy(key, entity).agg(F.max(score).alias(score)).filter(F.col(score) >= least)
    best = pairs.groupBy(key).agg(F.max(F.struct(F.col(score).alias("s"), F.col(entity).alias("e"))).alias("top_"))
    rest = pairs.join(best, key).filter(F.col(entity) != F.col("top_.e")).groupBy(key).agg(F.max(score).alias("next_"))
    clear = F.col("next_").isNull() | (F.col("top_.s") - F.col("next_") >= margin)
    return best.join(rest, key, "left").filter(clear).select(key, F.col("top_.e").alias(entity), F.col("top_.s").alias(score))


def keepers(entities: DataFrame, key: str, entity: str, rank: list[Column], told_apart_by: list[str]) -> DataFrame:
    """loser, keeper for each entity that shares its key with a better one; rank is lexicographic, then the smaller id.

    Groups that hold two different known values in a column of told_apart_by are namesakes and stay as they are.
    """
    same = F.lit(True)
    for c in told_apart_by:
        same &= F.min(c).eqNullSafe(F.max(c))
    groups = entities.groupBy(key).agg(F.max(F.struct(*rank, (-F.col(entity)).alias("id_"))).alias("best_"), F.count("*").alias("n_"), same.alias("same_"))
    kept = groups.filter("n_ > 1 AND same_").select(key, (-F.col("best_.id_")).alias("keeper"))
    return entities.select(key, F.col(entity).alias("loser")).join(kept, key).filter("loser <> keeper").select("loser", "keeper")


def repoint(children: DataFrame, entity: str, merged: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """children with losers' ids replaced by their keepers'; of rows that then share `unique`, the keeper's own stays, else the first by order.

    merged is joined without a hint, so Spark broadcasts it only where its size allows.
    """
    at = children.join(merged.select(F.col("loser").alias(entity), F.col("keeper").alias("keeper_")), entity, "left")
    moved = F.col("keeper_").isNotNull()
    at = at.withColumns({entity: F.coalesce("keeper_", entity), "moved_": moved}).drop("keeper_")
    return at.groupBy(*unique).agg(F.min(F.struct("moved_", *order, *[c for c in children.columns if c not in order])).alias("row_")).select(*[F.col(f"row_.{c}").alias(c) for c in children.columns])


def grams(text: Column, q: int) -> Column:
    """The runs of q neighbouring letters, each with its number among equal ones, so that sets of them count repeats; none in a shorter text."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (q - 1), F.lit(1))), lambda i: F.substring(text, i, q))
    return F.when(F.length(text) >= q, F.transform(each, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(each, 1, i), lambda h: h == g)).cast("string")))).otherwise(F.array().cast("array<string>"))


def lost_grams(n: int, q: int, least: float) -> int:
    """The most grams of a text of n letters that a text similar by least can lack: of a similarity of s, with d letters only in the one and e only in
    the other, (2 - s) * d + s * e <= 2 * (1 - s) * n; each of d takes q grams at most, each of e one less."""
    room = 2 * (1 - least) * n + 1e-9
    return max(q * d + (q - 1) * int((room - (2 - least) * d) / least) for d in range(int(room / (2 - least)) + 1))


#: Lengths whose bounds are told one by one; beyond, the bound is the line that they lie under.
LENGTHS = 400


#: The most grams whose numbers are broadcast, and the texts of a key on either side that meet in one task.
OFTEN, MEETING = 1 << 16, 4_000


def gram_keys(texts: DataFrame, q: int, least: float) -> DataFrame:
    """texts (t_ and more, t_ unique) with k_, hashes of two of t_'s rarest grams: of those that are left when all are lost that may be lost, a text
    shows two to each text that is similar. Any one order of the grams will do: the frequent ones are counted, the others are before them."""
    own = texts.columns
    each = texts.select(*own, F.explode(grams(F.col("t_"), q)).alias("g_"))
    every = texts.agg(F.sum(F.greatest(F.length("t_") - (q - 1), F.lit(0)))).first()[0] or 0
    often = each.groupBy("g_").agg(F.count("*").alias("f_")).filter(F.col("f_") * OFTEN >= every)
    counted = each.join(F.broadcast(often), "g_", "left")
    ranked = counted.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f_", F.lit(0)).alias("f_"), "g_"))).alias("all_"))  # as many as the text has letters
    n = F.length("t_")
    slope = 2 * (1 - least) * max(q / (2 - least), (q - 1) / least)
    lost = F.when(n < LENGTHS, F.array(*[F.lit(lost_grams(i, q, least)) for i in range(LENGTHS)])[F.least(n, F.lit(LENGTHS - 1))]).otherwise(F.ceil(n * slope).cast("int"))
    rare = ranked.select(*own, F.transform(F.slice("all_", F.lit(1), lost + 2), lambda x: x["g_"]).alias("r_"))
    two = F.flatten(F.transform("r_", lambda x, i: F.transform(F.slice("r_", i + 2, F.size("r_")), lambda y: F.xxhash64(x, y))))
    return rare.select(*own, F.explode(two).alias("k_"))


def letters(text: Column) -> Column:
    """64 bits of which letters (in 32 classes) a text has at least once and twice: a letter more or less changes one bit at most."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: 2 * F.pmod(F.ascii(F.substring(text, i, 1)), F.lit(32)))
    return F.aggregate(at, F.lit(0).cast("bigint"), lambda have, i: have.bitwiseOR(F.when(have.bitwiseAND(bit(i)) == 0, bit(i)).otherwise(bit(i + 1))))


def similar_candidates(asked: DataFrame, known: DataFrame, text: str, other: str, least: float) -> DataFrame:
    """Pairs of asked and known whose similarity can reach least: every such pair is among them.

    Texts are met once, whatever rows have them, by two common grams of three letters among each one's rarest (two rare ones together are far rarer
    than one); texts too short to be sure of two are met by letters, as are those that such a text may be similar to. Of what meets, those
    go on whose letters and then whose edit distance leave enough in common. What meets still grows faster than the texts where their words
    are few, so it is told by numbers and bits, the texts are joined to what is left. least: over 2 / 3.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least must lie over 2 / 3: of texts less alike two common letters aren't sure")
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda df, c, asks: df.select(F.col(c).alias("t_"), F.lit(asks).alias("asks_"), F.lit(not asks).alias("has_")).filter("t_ IS NOT NULL")
    each = side(asked, text, True).unionByName(side(known, other, False)).groupBy("t_").agg(F.max("asks_").alias("asks_"), F.max("has_").alias("has_"))
    each = staged(each, "similar-texts").repartition(parts, "t_")  # a small file would be one task's
    each = staged(each.withColumns({"i_": F.xxhash64("t_"), "s_": letters(F.col("t_")), "n_": F.length("t_")}), "similar-texts")
    # From this length on two grams of three are sure; where that isn't so at LENGTHS, all texts are met by letters.
    first = next((i + 1 for i in range(LENGTHS - 1, -1, -1) if i - 2 - lost_grams(i, 3, least) < 2), 0)
    first = first if first < LENGTHS else 1 << 30
    reach = int(first * (2 - least) / least) + 1
    keys = gram_keys(each.filter(F.col("n_") >= first), 3, least).unionByName(gram_keys(each.filter(F.col("n_") <= reach), 1, least))
    keys = staged(keys.unionByName(each.withColumn("k_", F.xxhash64(F.lit(""), "t_"))).drop("t_"), "similar-keys")
    # The texts of a hot key meet in cells of some that ask and some known; the cells lie in different tasks.
    size = lambda c: F.ceil(F.count_if(c) / F.lit(MEETING)).cast("int")
    hot = keys.groupBy("k_").agg(size("has_").alias("rows_"), size("asks_").alias("columns_")).filter("rows_ > 0 AND columns_ > 0 AND rows_ + columns_ > 2")
    dealt = keys.join(F.broadcast(hot), "k_", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("rows_", "columns_")})  # one for each so many texts
    cells, own = (lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))), (lambda c: F.pmod(F.col("i_"), F.col(c)).cast("int"))
    left = dealt.filter("asks_").select("k_", cells("rows_").alias("row_"), own("columns_").alias("column_"), *[F.col(c).alias(f"a{c}") for c in ("i_", "s_", "n_")])
    right = dealt.filter("has_").select("k_", own("rows_").alias("row_"), cells("columns_").alias("column_"), *[F.col(c).alias(f"b{c}") for c in ("i_", "s_", "n_")])
    n = F.col("an_") + F.col("bn_")
    room = F.floor((1 - least) * n + 1e-9).cast("int")
    met = left.hint("merge").join(right.hint("merge"), ["k_", "row_", "column_"])
    met = met.filter((2 * F.least("an_", "bn_") >= least * n - 1e-9) & (F.bit_count(F.col("as_").bitwiseXOR(F.col("bs_"))) <= room)).select("ai_", "bi_", room.alias("room_")).distinct()
    for c in ("a", "b"):
        met = met.hint("merge").join(each.select(F.col("i_").alias(f"{c}i_"), F.col("t_").alias(f"{c}_")).hint("merge"), f"{c}i_")
    near = met.filter(F.levenshtein("a_", "b_") <= F.col("room_")).select("a_", "b_").distinct()
    return asked.hint("merge").join(near.hint("merge"), asked[text] == near["a_"]).drop("a_").join(known.hint("merge"), F.col("b_") == known[other]).drop("b_")


def tiered_match(names: DataFrame, entities: DataFrame, name: str, entity: str, least: float = 0.92, guarded: bool = False) -> DataFrame:
    """name, entity and tier of names found by exact form (case and spacing aside), else by folded form, else by similarity of
    least or more: the best, and of equals the smallest id.

    Each tier takes what the one before left. Keys of two entities match nobody, in no tier. guarded: the last tier compares
    only names of one first word and number of words.
    """
    asked = names.select(name).filter(F.col(name).isNotNull()).distinct()
    asked = staged(asked.withColumns({"exact_": casefold_name(F.col(name)), "folded_": fold_name(F.col(name))}), "names-asked")
    known = entities.select(F.col("name").alias("name_"), entity).filter("name_ IS NOT NULL")
    known = staged(known.withColumns({"exact_": casefold_name(F.col("name_")), "folded_": fold_name(F.col("name_"))}), "names-known")
    exact, folded = (unambiguous_index(known, k, entity) for k in ("exact_", "folded_"))
    first = asked.join(exact, "exact_").select(name, entity, F.lit("exact").alias("tier"))
    left = asked.join(first, name, "left_anti")
    second = left.join(folded, "folded_").select(name, entity, F.lit("folded").alias("tier"))
    left = left.join(second, name, "left_anti").filter("folded_ <> ''").select(name, "folded_")
    left, folded = staged(left, "names-left"), staged(folded, "names-folded")
    pairs = similar_candidates(left, folded.withColumnRenamed("folded_", "other_"), "folded_", "other_", least)
    if guarded:
        guard = lambda c: F.struct(F.split_part(c, F.lit(" "), F.lit(1)), F.size(F.split(c, " ")))
        pairs = pairs.filter(guard(F.col("folded_")) == guard(F.col("other_")))
    best = pairs.withColumn("s_", similarity("folded_", "other_")).filter(F.col("s_") >= least).groupBy(name).agg(F.max(F.struct("s_", (-F.col(entity)).alias("e_"))).alias("b_"))
    return first.unionByName(second).unionByName(best.select(name, (-F.col("b_.e_")).cast(entities.schema[entity].dataType).alias(entity), F.lit("similar").alias("tier")))


def priced_pairs(prices: DataFrame, bouts: DataFrame, least: float = 0.85) -> DataFrame:
    """price_id, bout_id, score and swapped: the bout of the day whose two names are nearest to the priced pair in either
    orientation (score: the less similar of the two sides), the smaller id of equals; each bout goes to its first price_id.

    prices: price_id, day, first_name, second_name; bouts: bout_id, day, red_name, blue_name. Names are compared folded.
    """
    p = prices.withColumns({"a_": fold_name(F.col("first_name")), "b_": fold_name(F.col("second_name"))})
    q = bouts.withColumns({"r_": fold_name(F.col("red_name")), "l_": fold_name(F.col("blue_name"))}).drop("red_name", "blue_name")
    met = p.join(q, "day")  # the bouts of one day
    scored = met.select("price_id", "bout_id", similarity("a_", "r_").alias("ar"), similarity("b_", "l_").alias("bl"), similarity("a_", "l_").alias("al"), similarity("b_", "r_").alias("br"))
    straight, crossed = F.least("ar", "bl"), F.least("al", "br")
    best = scored.select("price_id", "bout_id", F.greatest(straight, crossed).alias("score"), (crossed > straight).alias("swapped")).filter(F.col("score") >= least)
    top = best.groupBy("price_id").agg(F.max(F.struct("score", (-F.col("bout_id")).alias("b_"), "swapped")).alias("t_"))
    claims = top.select("price_id", (-F.col("t_.b_")).alias("bout_id"), "t_.score", "t_.swapped")
    return claims.groupBy("bout_id").agg(F.min(F.struct("price_id", "score", "swapped")).alias("c_")).select("c_.price_id", "bout_id", "c_.score", "c_.swapped")


def bout_of_page(bouts: DataFrame, pages: DataFrame) -> DataFrame:
    """bout_id and page_id: the page whose two names are the bout's, folded and in any order; else the only page whose names
    belong to different corners of the bout.

    bouts: bout_id, event_id, red_name, blue_name; pages: page_id, event_id, name_1, name_2.
    """
    met = bouts.join(pages, "event_id")  # the bouts and pages of one event
    key = lambda a, b: F.array_sort(F.array(fold_name(F.col(a)), fold_name(F.col(b))))
    one, two = (corner_of(F.col(c), F.col("red_name"), F.col("blue_name")) for c in ("name_1", "name_2"))
    judged = met.select("bout_id", "page_id", (key("red_name", "blue_name") == key("name_1", "name_2")).alias("exact_"), one.alias("one_"), two.alias("two_")).withColumn("corners_", F.coalesce(F.col("one_") != F.col("two_"), F.lit(False)))
    by = judged.groupBy("bout_id").agg(F.max(F.when(F.col("exact_"), F.col("page_id"))).alias("same_"), F.count_if("corners_").alias("n_"), F.max(F.when(F.col("corners_"), F.col("page_id"))).alias("only_"))
    found = F.coalesce(F.col("same_"), F.when(F.col("n_") == 1, F.col("only_")))
    return by.select("bout_id", found.alias("page_id")).filter("page_id IS NOT NULL")


#: Telling tokens up to which the sets of a name's tokens are listed: 2**MOST_LISTED at most.
MOST_LISTED = 10


def event_match(incoming: DataFrame, stored: DataFrame, least: int = 2) -> DataFrame:
    """in_id and event_id of incoming events (id, name, event_date, location, promotion_id): the stored one with the same name,
    date, place and promotion, else of those of the date and promotion the one that shares most telling tokens of its name, least
    or more; the smaller id of equals. A date alone tells nothing.

    No pairs are made: what two names share is a set of tokens, so each date and promotion keeps the least stored id of every set of
    least tokens or more, and an incoming name takes the largest of its own sets that is kept. Tokens that only one side has, or only one name
    of the stored, are left out before; names that still have more than MOST_LISTED tokens meet the others by two tokens each.
    What is exploded looks as small as what it comes from, so it is joined by sorted merges and dealt to many tasks before.
    """
    both = ["event_date", "promotion_id"]
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = lambda df, own: staged(df.select(F.col("id").alias(own), "name", F.col("location").alias("place"), *both, event_tokens(strip_accents(F.col("name"))).alias("w_")).filter("name IS NOT NULL AND event_date IS NOT NULL AND promotion_id IS NOT NULL"), "event-names")
    a, b = named(incoming, "in_id"), named(stored, "event_id")
    same = b.groupBy("name", "place", *both).agg(F.min("event_id").alias("event_id"))
    at = a.alias("a").hint("merge").join(same.alias("b").hint("merge"), F.expr("a.name = b.name AND a.place <=> b.place AND a.event_date = b.event_date AND a.promotion_id = b.promotion_id"))
    exact = at.select("in_id", "b.event_id", F.lit(1_000_000).alias("s_"))
    # Tokens of both sides; names of the same remaining tokens are one.
    each = lambda df, own: df.select(own, *both, F.col("w_").alias("all_"), F.explode("w_").alias("t_"))
    tokens = each(a, "in_id").select(*both, "t_").distinct().hint("merge").join(each(b, "event_id").select(*both, "t_").distinct(), [*both, "t_"])
    left = lambda df, own: each(df, own).hint("merge").join(tokens.hint("merge"), [*both, "t_"]).groupBy(own, *both, "all_").agg(F.sort_array(F.collect_set("t_")).alias("w_")).filter(F.size("w_") >= least)
    asks = staged(left(a, "in_id"), "event-asks")
    kinds = staged(asks.select(*both, F.col("w_").alias("v_")).distinct(), "event-kinds").repartition(parts, *both, "v_")
    known = staged(left(b, "event_id").groupBy(*both, "w_").agg(F.min("event_id").alias("event_id")), "event-known").repartition(parts, *both, "w_")
    few = lambda c: F.size(c) <= MOST_LISTED
    # The sets by bits of a number: which tokens of the name are in.
    held = lambda c: F.filter(F.transform(F.sequence(F.lit(0), F.lit((1 << MOST_LISTED) - 1)), lambda m: F.when(F.bit_count(m) >= least, m)), lambda m: m.isNotNull() & (m < F.pow(F.lit(2), F.size(c))))
    of = lambda c: F.transform(held(c), lambda m: F.array_join(F.filter(c, lambda _, i: F.expr("0") != m.bitwiseAND(F.pow(F.lit(2), i).cast("int"))), " "))
    kept = known.filter(few("w_")).select(*both, "event_id", F.explode(of(F.col("w_"))).alias("k_")).groupBy(*both, "k_").agg(F.min("event_id").alias("event_id"))
    own = kinds.filter(few("v_")).select(*both, "v_", F.explode(of(F.col("v_"))).alias("k_"))
    listed = own.hint("merge").join(kept.hint("merge"), [*both, "k_"]).select(*both, "v_", "event_id", (F.size(F.split("k_", " "))).alias("s_"))
    # Names of many tokens, on either side.
    two = lambda c: F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: F.concat(x, F.lit(" "), y)))) if least > 1 else c
    pairs = lambda df, c, *more: df.select(*both, c, *more, F.explode(two(F.col(c))).alias("k_"))
    many = lambda x, y: pairs(x, "v_").hint("merge").join(pairs(y, "w_", "event_id").hint("merge"), [*both, "k_"]).drop("k_").distinct()
    met = many(kinds.filter(~few("v_")), known).unionByName(many(kinds.filter(few("v_")), known.filter(~few("w_"))))
    met = met.select(*both, "v_", "event_id", F.size(F.array_intersect("v_", "w_")).alias("s_"))
    best = listed.unionByName(met).filter(F.col("s_") >= least).groupBy(*both, "v_").agg(F.max(F.struct("s_", (-F.col("event_id")).alias("e_"))).alias("b_"))
    told = asks.hint("merge").join(best.hint("merge"), (asks["w_"] == best["v_"]) & (asks["event_date"] == best["event_date"]) & (asks["promotion_id"] == best["promotion_id"]))
    told = told.select("in_id", (-F.col("b_.e_")).alias("event_id"), F.col("b_.s_").alias("s_"))
    return exact.unionByName(told).groupBy("in_id").agg(F.max(F.struct("s_", (-F.col("event_id")).alias("e_"))).alias("b_")).select("in_id", (-F.col("b_.e_")).cast(stored.schema["id"].dataType).alias("event_id"))


def winner_plan(bouts: DataFrame, scraped: DataFrame, people: DataFrame) -> DataFrame:
    """bout_id, red_id, blue_id (by ascending source id), winner_id and outcome for every bout that was scraped.

    bouts: bout_id, source_id, red_id, red_src, blue_id, blue_src, winner_id; scraped: source_id, status (decided, draw_nc or
    other), winner_src; people: id, src. A stored winner goes only by a confirmed draw.
    """
    at = bouts.join(scraped, "source_id").join(people.select(F.col("src").alias("winner_src"), F.col("id").alias("w_")), "winner_src", "left")
    swap = F.col("red_src") > F.col("blue_src")
    decided = F.col("status") == "decided"
    inside = F.coalesce((F.col("w_") == F.col("red_id")) | (F.col("w_") == F.col("blue_id")), F.lit(False))
    outcome = F.when(decided & F.col("w_").isNull(), "winner_unknown").when(decided & ~inside, "winner_not_in_bout").when(decided, "decided").when(F.col("status") == "draw_nc", "draw_nc").otherwise("undetermined")
    winner = F.when(F.col("outcome") == "decided", F.col("w_")).when(F.col("outcome") == "draw_nc", F.lit(None)).otherwise(F.col("winner_id"))
    both = at.withColumn("outcome", outcome)
    return both.select("bout_id", F.when(swap, F.col("blue_id")).otherwise(F.col("red_id")).alias("red_id"), F.when(swap, F.col("red_id")).otherwise(F.col("blue_id")).alias("blue_id"), winner.alias("winner_id"), "outcome")


def winner_repair(bouts: DataFrame, pages: DataFrame) -> DataFrame:
    """bout_id, winner_id and outcome: a page (bout_id, id_1, id_2, status_1, status_2) names the winner only if its two
    participants are the bout's (bout_id, red_id, blue_id, winner_id) as a set and one is marked w and the other l."""
    at = bouts.join(pages, "bout_id")
    same = F.coalesce(F.array_sort(F.array("red_id", "blue_id")) == F.array_sort(F.array("id_1", "id_2")), F.lit(False))
    won = F.when((F.lower("status_1") == "w") & (F.lower("status_2") == "l"), F.col("id_1")).when((F.lower("status_1") == "l") & (F.lower("status_2") == "w"), F.col("id_2"))
    outcome = F.when(~same, "mismatch").when(won.isNull(), "no_winner").otherwise("updated")
    return at.select("bout_id", F.when(same & won.isNotNull(), won).otherwise(F.col("winner_id")).alias("winner_id"), outcome.alias("outcome"))


def missing_events(index: DataFrame, stored: DataFrame, today: Column) -> DataFrame:
    """Events of an index (url, id, name, event_date, location, promotion_id) that lie in the past and match no stored one, each url
    once; the oldest first is an order of event_date and id."""
    once = index.groupBy("url").agg(F.min_by(F.struct(*[c for c in index.columns if c != "url"]), "id").alias("r_")).select("url", "r_.*")
    past = once.filter(F.col("event_date") <= today)
    return past.join(event_match(past, stored).select(F.col("in_id").alias("id")), "id", "left_anti")


def resolve_or_create(incoming: DataFrame, people: DataFrame, source: str) -> DataFrame:
    """source_id, id and action: a known source id resolves; else the only namesake under another source is adopted; with none or
    several a participant is to be created (id NULL). incoming: source_id, name; people: id, name, source, source_id."""
    own = people.filter(F.col("source") == source).select("source_id", F.col("id").alias("known_"))
    others = people.filter(F.col("source") != source).groupBy(plain_key(F.col("name")).alias("k_")).agg(F.min("id").alias("one_"), F.count("*").alias("n_"))
    at = incoming.withColumn("k_", plain_key(F.col("name"))).join(own, "source_id", "left").join(others, "k_", "left")
    action = F.when(F.col("known_").isNotNull(), "resolved").when(F.col("n_") == 1, "adopted").otherwise("create")
    return at.select("source_id", F.coalesce("known_", F.when(F.col("n_") == 1, F.col("one_"))).alias("id"), action.alias("action"))


def card_orientation(persons: DataFrame, bouts: DataFrame, least: float = 0.92) -> DataFrame:
    """bout_id and first_is_red: whether a page's first person is the red corner, by source ids, else by names that are alike to one
    corner only; the second person counts where the first tells nothing; NULL where neither does.

    persons: bout_id, src_1, name_1, src_2, name_2; bouts: bout_id, red_src, red_name, blue_src, blue_name.
    """
    at = persons.join(bouts, "bout_id")
    alike = lambda a, b: F.coalesce(similarity(fold_name(F.col(a)), fold_name(F.col(b))) >= least, F.lit(False))
    said = at.select("bout_id", *[F.col(c) for c in ("src_1", "src_2", "red_src", "blue_src")], *[alike(f"name_{i}", f"{c}_name").alias(f"{c}_{i}") for i in (1, 2) for c in ("red", "blue")])
    one = lambda i, here: F.when(F.col(f"src_{i}") == F.col("red_src"), here).when(F.col(f"src_{i}") == F.col("blue_src"), ~here).when(F.col(f"red_{i}") != F.col(f"blue_{i}"), F.when(F.col(f"red_{i}"), here).otherwise(~here))
    return said.select("bout_id", F.coalesce(one(1, F.lit(True)), one(2, F.lit(False))).alias("first_is_red"))


def phantoms(bouts: DataFrame) -> DataFrame:
    """event_id, bout_order, n, active, cancelled and ids of slots with two bouts or more (the first signature of a phantom)."""
    live = ~F.col("status").eqNullSafe(F.lit("cancelled"))
    at = bouts.filter("bout_order IS NOT NULL").groupBy("event_id", "bout_order")
    return at.agg(F.count("*").alias("n"), F.count_if(live).alias("active"), F.count_if(~live).alias("cancelled"), F.sort_array(F.collect_list("id")).alias("ids")).filter("n > 1")


def childless(candidates: DataFrame, children: list[DataFrame], key: str = "id") -> DataFrame:
    """Candidates that no child table refers to: only these may be deleted."""
    out = candidates
    for c in children:
        out = out.join(c.select(F.col("bout_id").alias(key)).distinct(), key, "left_anti")
    return out
