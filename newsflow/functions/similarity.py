"""Token Jaccard, character n-gram profiles and cosine, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JACCARD, COSINE, BOTH_JACCARD, BOTH_COSINE = 0.55, 0.75, 0.40, 0.45
GRAM = 4


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct tokens; 0 if either has none."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / union).otherwise(F.lit(0.0))


def grams(text: Column, n: int = GRAM) -> Column:
    """Character n-grams of the text between single spaces; a shorter one is its own gram."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    last = F.greatest(F.char_length(text) + 3 - n, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(n)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def profile_of(each: Column) -> Column:
    """map<gram, count> of grams."""
    count = lambda g: F.struct(g.alias("gram"), (F.size(each) - F.size(F.array_remove(each, g))).alias("count"))
    return F.map_from_entries(F.transform(F.array_distinct(each), count))


def profile(text: Column, n: int = GRAM) -> Column:
    """map<gram, count>."""
    return bound(grams(text, n), profile_of)


def magnitude(counts: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(counts), F.lit(0.0), lambda acc, c: acc + c.cast("double") * c))


def dot(a: Column, b: Column) -> Column:
    """Of two profiles."""
    def of(p):
        # looking a key up walks a map, so only common keys are
        common = F.array_intersect(F.map_keys(p["a"]), F.map_keys(p["b"]))
        return F.aggregate(common, F.lit(0.0), lambda acc, g: acc + F.try_element_at(p["a"], g).cast("double") * F.try_element_at(p["b"], g))

    return bound(F.struct(a.alias("a"), b.alias("b")), of)


def cosine(a: Column, b: Column) -> Column:
    """Of two profiles."""
    size = magnitude(a) * magnitude(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def text_cosine(a: Column, b: Column, n: int = GRAM) -> Column:
    """Of two texts; blank ones have none."""
    return F.when((F.trim(a) == "") | (F.trim(b) == ""), F.lit(0.0)).otherwise(cosine(profile(a, n), profile(b, n)))


def duplicates(j: Column, c: Column) -> Column:
    """Whether two titles tell the same story."""
    return (j >= JACCARD) | (c >= COSINE) | ((j >= BOTH_JACCARD) & (c >= BOTH_COSINE))
