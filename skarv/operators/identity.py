"""Whether a page, profile or title speaks of the entity asked for: ordered evidence, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.functions.text import fold, name_tokens, organisation_numbers, overlap, tokens

#: Phrases of pages that stand for no site yet.
PARKED = (
    "domain is for sale", "domain for sale", "hugedomains", "parked at", "miss hosting",
    "her flytter snart en ny gjest", "has been informing visitors",
    "find the best information and most relevant links on all topics related to",
)
#: Words that may stand before a company's name in a headline about it.
BEFORE_A_NAME = ("av", "for", "fra", "hos", "i", "med", "om", "på", "til", "og", "kjøper", "velger")


def names_number(text: Column, number: Column) -> Column:
    """Whether the number stands in the text by itself, in threes or together."""
    return F.coalesce(F.array_contains(organisation_numbers(text), number), F.lit(False))


def site_confidence(name: Column, number: Column, text: Column) -> Column:
    """How surely a page's text is a company's own: ``struct(confidence, reason)``.

    In this order: a parked page 0.1; its number 1.0; all of at least two
    telling words 0.95; one word on a page with text 0.95 where it is the
    whole name; three quarters of the words 0.85, half 0.65, else 0.3. A null
    name or text gives 0.3.
    """
    words, seen = F.array_distinct(name_tokens(name)), F.array_distinct(tokens(text))
    share = overlap(words, seen)
    parked = F.lit(False)
    for phrase in PARKED:
        parked = parked | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(phrase))
    grade = lambda value, why: F.struct(F.lit(value).alias("confidence"), F.lit(why).alias("reason"))
    return (
        F.when(parked, grade(0.1, "parked"))
        .when(names_number(text, number), grade(1.0, "number"))
        .when((F.size(words) >= 2) & (share == 1), grade(0.95, "all words"))
        .when((F.size(words) == 1) & (share == 1) & (F.length(text) >= 100), grade(0.95, "only word"))
        .when((F.size(words) >= 2) & (share >= 0.75), grade(0.85, "most words"))
        .when((F.size(words) >= 2) & (share >= 0.5), grade(0.65, "half the words"))
        .otherwise(grade(0.3, "weak"))
    )


def profile_confidence(name: Column, handle: Column) -> Column:
    """How surely a profile's handle is a company's: the whole name within it 0.98, most words 0.9, else 0.3."""
    words = F.array_distinct(name_tokens(name))
    compact = F.regexp_replace(fold(F.coalesce(handle, F.lit(""))), "[^a-z0-9]", "")
    inside = F.size(F.filter(words, lambda w: F.contains(compact, w)))
    whole = F.array_join(name_tokens(name), "")
    return (
        F.when((F.length(whole) > 0) & F.contains(compact, whole), 0.98)
        .when((F.size(words) == 1) & (inside == 1), 0.95)
        .when((F.size(words) >= 2) & (inside / F.size(words) >= 0.75) & (inside >= 2), 0.9)
        .otherwise(0.3)
    )


def in_title(name: Column, title: Column) -> Column:
    """Whether the name's words stand together in the title, at its start or after one of ``BEFORE_A_NAME``.

    What follows the last `` - `` of a title names its publisher.
    """
    split = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9æøå]+"), 0)
    words, heads = split(name), split(F.regexp_replace(title, r" - (?:(?! - ).)*$", ""))
    n = F.size(words)
    places = F.sequence(F.lit(1), F.greatest(F.size(heads) - n + 1, F.lit(1)))
    stands = F.exists(places, lambda i: (F.slice(heads, i, F.greatest(n, F.lit(1))) == words) & ((i == 1) | F.coalesce(F.try_element_at(heads, i - 1).isin(*BEFORE_A_NAME), F.lit(False))))
    return F.coalesce((n > 0) & (F.size(heads) >= n) & stands, F.lit(False))


def search_score(name: Column, number: Column, title: Column, snippet: Column, host: Column, place: Column) -> Column:
    """A search result's score: number 0.75, all words in the title 0.45 or in all of it 0.25, name in the host 0.3, place 0.1; at most 1."""
    words = F.array_distinct(name_tokens(name))
    everything = F.concat_ws(" ", title, snippet, host)
    compact = F.regexp_replace(fold(F.coalesce(host, F.lit(""))), "[^a-z0-9]", "")
    whole = F.array_join(name_tokens(name), "")
    named = F.when((F.size(words) > 0) & (overlap(words, tokens(title)) == 1), 0.45).when((F.size(words) > 0) & (overlap(words, tokens(everything)) == 1), 0.25).otherwise(0.0)
    score = (
        F.when(names_number(everything, number), 0.75).otherwise(0.0) + named + F.when((F.length(whole) > 0) & F.contains(compact, whole), 0.3).otherwise(0.0)
        + F.when(F.contains(fold(everything), fold(F.coalesce(place, F.lit("-")))), 0.1).otherwise(0.0)
    )
    return F.bround(F.least(score, F.lit(1.0)), 3)


def choose(candidates: DataFrame, key: str, score: str, order: list[str], least: float) -> DataFrame:
    """The best candidate of each key by score, then ``order``; none where the best falls short or is tied in all."""
    good = candidates.where(F.col(score) >= least)
    others = [c for c in good.columns if c != key]
    best = good.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("_s"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*others).alias("_row"))).alias("_best"))
    return best.select(key, "_best._row.*")
