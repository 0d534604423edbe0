"""Comparing names and reading measures. Missing or unreadable input gives NULL unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contestry.functions.text import fold_name

#: Particles that are no evidence that two names are of one person.
PARTICLES = ("al", "da", "das", "de", "del", "der", "di", "do", "dos", "du", "el", "ii", "iii", "jr", "la", "le", "los", "sr", "st", "van", "von")
CM_AN_INCH, GRAMS_A_POUND = 2.54, 453.59237
SHORTEST_DIMINUTIVE = 4
#: Thresholds of similarity: one person's identity, names in general, both sides of a priced bout.
IDENTITY, GENERAL, BOTH_SIDES = 0.92, 0.87, 0.85
#: How sources write that they don't know.
UNKNOWN = ("", "--", "---")


def split_name(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: t != "")


def subset_match(a: Column, b: Column) -> Column:
    """One name's tokens all occur in the other, with two or more shared ones that have two letters and are no particles."""
    x, y = split_name(fold_name(a)), split_name(fold_name(b))
    telling = F.filter(F.array_intersect(x, y), lambda t: (F.length(t) >= 2) & ~t.isin(*PARTICLES))
    return ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)) & (F.size(telling) >= 2)


def diminutive_match(a: Column, b: Column) -> Column:
    """As many tokens, two at least, all but the first equal; of two different first ones the shorter has four letters and
    begins the other."""
    x, y = split_name(fold_name(a)), split_name(fold_name(b))
    p, q = F.try_element_at(x, F.lit(1)), F.try_element_at(y, F.lit(1))
    tail = F.slice(x, 2, F.greatest(F.size(x), F.lit(1))) == F.slice(y, 2, F.greatest(F.size(y), F.lit(1)))
    begins = (p != q) & (p.startswith(q) | q.startswith(p)) & (F.least(F.length(p), F.length(q)) >= SHORTEST_DIMINUTIVE)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce((F.size(x) == F.size(y)) & (F.size(x) >= 2) & tail & begins, F.lit(False)))


def clean_text(text: Column) -> Column:
    """Single spaces, none at the ends; NULL for nothing and for marks of the unknown."""
    t = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    return F.when(~t.isin(*UNKNOWN), t)


def number_at(text: Column, pattern: str, i: int = 1) -> Column:
    """The i-th group of the pattern's first match as a whole number."""
    return F.regexp_extract(clean_text(text), pattern, i).try_cast("bigint")


def whole_number(text: Column) -> Column:
    """The first whole number, signed; N/A is none."""
    return F.when(clean_text(text) != "N/A", number_at(text, r"(-?\d+)"))


FEET = r"^(\d+)\s*['′’]\s*(\d+)"


def height_cm(text: Column) -> Column:
    """Feet and inches (straight, curly or prime marks; the inch mark may lack) in centimetres, to two places."""
    return F.round((number_at(text, FEET) * 12 + number_at(text, FEET, 2)) * F.lit(CM_AN_INCH), 2)


def reach_cm(text: Column) -> Column:
    """The first number, as inches, in centimetres."""
    return F.round(number_at(text, r"(\d+)") * F.lit(CM_AN_INCH), 2)


def weight_grams(text: Column) -> Column:
    """The first whole number, as pounds, in whole grams."""
    return F.round(number_at(text, r"(\d+)") * F.lit(GRAMS_A_POUND)).cast("bigint")


def record_parts(text: Column) -> Column:
    """Struct of wins, losses and draws of W-L-D or W-L; zeros where there is neither."""
    three, two = r"(\d+)\s*-\s*(\d+)\s*-\s*(\d+)", r"(\d+)\s*-\s*(\d+)"
    part = lambda i: F.coalesce(number_at(text, three, i), number_at(text, two, i) if i < 3 else F.lit(0), F.lit(0)).cast("int")
    return F.struct(part(1).alias("wins"), part(2).alias("losses"), part(3).alias("draws"))


def landed_attempted(text: Column) -> Column:
    """Struct of landed and attempted of 'x of y'."""
    p = r"(?i)(\d+)\s+of\s+(\d+)"
    return F.struct(number_at(text, p).alias("landed"), number_at(text, p, 2).alias("attempted"))


def control_seconds(text: Column) -> Column:
    """Seconds of [H:]M:SS, which must begin the text and end it."""
    p = r"^(?:(\d+):)?(\d+):(\d+)$"
    return F.coalesce(number_at(text, p), F.lit(0)) * 3600 + number_at(text, p, 2) * 60 + number_at(text, p, 3)


def any_date(text: Column) -> Column:
    """A date written as Jan 5, 2024, January 5, 2024 or 2024-01-05."""
    t = clean_text(text)
    return F.coalesce(*[F.try_to_date(t, f) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-M-d")])


def known_measure(value: Column) -> Column:
    """Zero stands for unknown."""
    return F.nullif(value, F.lit(0).cast("double"))


def corner_of(name: Column, red: Column, blue: Column) -> Column:
    """'red' or 'blue', the corner a name belongs to: equal when folded, else its tokens are a subset of one corner's alone,
    else a diminutive of one corner's alone. A subset of both is nobody's."""
    own, r, b = fold_name(name), fold_name(red), fold_name(blue)
    subset = [F.coalesce(subset_match(name, x), F.lit(False)) for x in (red, blue)]
    short = [F.coalesce(diminutive_match(name, x), F.lit(False)) for x in (red, blue)]
    one = lambda pair: F.when(pair[0] & ~pair[1], "red").when(pair[1] & ~pair[0], "blue")
    return F.when(own == r, "red").when(own == b, "blue").when(subset[0] | subset[1], one(subset)).otherwise(one(short))
