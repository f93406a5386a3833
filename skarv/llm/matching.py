"""Places and companies that share no number, matched by a cascade of rules.

Successive passes join exactly on weaker and weaker combinations of noisy
attributes (name, website, phone, location); what a pass resolves is
anti-joined from the next. Rules that compare names alike make one pass, in
which the first rule holds, so that each pass is one table of keys and one
join. A rule's confidence is its labelled precision, smoothed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarv.llm.addresses import fold, locate, near, town_names
from skarv.session import cut, release

#: Words of a name that tell no company from another.
LEGAL_FORMS = frozenset("as asa ans da enk nuf sa sti stiftelsen iks ba ks kf sf og avd avdeling filial".split())


@dataclass(frozen=True)
class Rule:
    """A pass: the attributes joined on, and how the names have to agree.

    ``names`` is ``same`` (one normalised form is equal, part of the join),
    ``related`` (a word is equal but for one letter, part of the join, and one
    name is the other shortened or misspelt) or ``any``.
    """

    name: str
    on: tuple[str, ...]
    names: str


RULES = (
    Rule("website, phone and name", ("host", "phone"), "same"),
    Rule("website, location and name", ("host", "location"), "same"),
    Rule("phone, location and name", ("phone", "location"), "same"),
    Rule("website and name", ("host",), "same"),
    Rule("phone and name", ("phone",), "same"),
    Rule("location and name", ("location",), "same"),
    Rule("website and phone", ("host", "phone"), "any"),
    Rule("website and location", ("host", "location"), "any"),
    Rule("website and similar name", ("host",), "related"),
    Rule("phone and similar name", ("phone",), "related"),
    Rule("location and similar name", ("location",), "related"),
    Rule("phone and location", ("phone", "location"), "any"),
    Rule("website", ("host",), "any"),
)
ATTRIBUTES = ("host", "phone", "location")
#: Longer words are compared by halves.
WHOLE = 40


def host(url: Column) -> Column:
    """The host of a website, in lower case and without ``www.``; null if there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z]+://)?(?:www\.)?([^/?#:\s@]+\.[^/?#:\s@]+)", 1)
    return F.nullif(found, F.lit(""))


def phone(number: Column) -> Column:
    """The last eight digits of a number of at least eight, less the country's code; null otherwise."""
    digits = F.regexp_replace(F.regexp_replace(number, r"[^0-9]", ""), r"^(0047|47(?=[0-9]{8}$))", "")
    return F.when(F.length(digits) >= 8, F.right(digits, F.lit(8)))


def name_words(name: str | None, towns: frozenset[str]) -> list[str]:
    """The telling words of a name or title: what follows a comma or bar, legal forms and towns are left off."""
    if not name:
        return []
    head = re.split(r",|\||\s[–—-]\s", name)[0] or name
    words = [w for w in re.findall(r"[^\W_]+", fold(head)) if w not in LEGAL_FORMS]
    return [w for w in words if w not in towns] or words


def name_forms(words: list[str]) -> list[str]:
    """Normalised forms under which names are the same: words in any order, run together, first and last."""
    if not words:
        return []
    forms = {"".join(sorted(words)), "".join(words)}
    if len(words) > 2:
        forms |= {"".join(sorted((words[0], words[-1]))), words[0] + words[-1]}
    return sorted(forms)


def word_forms(words: list[str]) -> list[str]:
    """Each word, run-together name and what they share with all that are one letter away.

    Words of up to ``WHOLE`` letters become what is left without any of them;
    of longer ones a slip leaves the first half or the last half as it is.
    Words of fewer than five letters are told apart by each letter.
    """
    out = set()
    for word in {*words, "".join(words)}:
        out.add(word)
        if 5 <= len(word) <= WHOLE + 1:
            out |= {word[:i] + word[i + 1 :] for i in range(len(word))}
        if len(word) >= WHOLE:
            halves = {(len(word) + d) // 2 for d in (-1, 0, 1)}
            out |= {f"<{word[:k]}" for k in halves} | {f">{word[-k:]}" for k in halves}
    return sorted(out - {""})


def related(a: list[str], b: list[str]) -> bool:
    """Whether one name is the other with words left out, misspelt a little, or both."""
    if not a or not b:
        return False
    slips = 1 if min(len("".join(a)), len("".join(b))) < 10 else 2
    if near("".join(a), "".join(b), slips) or near("".join(sorted(a)), "".join(sorted(b)), slips):
        return True
    short, long = sorted((a, b), key=len)
    left = list(long)
    for word in short:
        found = next((w for w in left if w == word or (len(word) > 4 and near(w, word, 1 if len(word) < 8 else 2))), None)
        if found is None:
            joined = "".join(short)
            return len(long) > 1 and any(near(joined, form, 1) for form in name_forms(long))
        left.remove(found)
    # What is left off may not be the word that tells it from its sisters alone.
    return short[0] == long[0] or near(short[0], long[0], 2) or len(short) > 1 or len(short) == len(long)


@F.pandas_udf(T.BooleanType())
def _related(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([related(list(x), list(y)) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _name_forms(words: pd.Series) -> pd.Series:
    return pd.Series([name_forms(list(w)) for w in words])


_name_forms = _name_forms.asNondeterministic()  # lest an explosion of it compute it twice


@F.pandas_udf(T.ArrayType(T.StringType()))
def _word_forms(words: pd.Series) -> pd.Series:
    return pd.Series([word_forms(list(w)) for w in words])


_word_forms = _word_forms.asNondeterministic()


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else " ".join(re.findall(r"[^\W\d_]+", fold(n))) for n in names], dtype=object)


def _described(places: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as ``key, words, host, phone, location``, one row for each captured combination."""
    address = F.col("forretningsadresse")
    towns = town_names(companies.select(address["postnummer"].alias("code"), _folded(address["poststed"]).alias("town")))
    single = frozenset(t for t in towns.values() if " " not in t)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(names: pd.Series) -> pd.Series:
        return pd.Series([name_words(n, single) for n in names])

    none = F.lit(None).cast("string")
    left = places.where("place_id is not null").select(F.concat(F.lit("p"), F.col("row_id")).alias("_row"), F.col("place_id").alias("key"), words("title").alias("words"), host(F.col("web_site")).alias("host"), F.array(phone(F.col("phone"))).alias("phones"), "address", none.alias("code"), none.alias("town"))
    right = companies.where("organisasjonsnummer is not null").select(
        F.concat(F.lit("c"), F.col("row_id")).alias("_row"), F.col("organisasjonsnummer").alias("key"), words("navn").alias("words"), host(F.col("hjemmeside")).alias("host"),
        F.array(phone(F.col("telefon")), phone(F.col("mobil"))).alias("phones"), address["adresse"].alias("address"), address["postnummer"].alias("code"), address["poststed"].alias("town"),
    )
    both = cut(left.unionByName(right))
    located = locate(both, "_row", "address", "code", "town")
    full = both.join(located, "_row", "left").select("_row", "key", "words", "host", "location", F.explode_outer(F.array_compact("phones")).alias("phone"))
    full = full.withColumn("side", F.substring("_row", 1, 1)).drop("_row").distinct()
    # A word of a title that stands in no company's name (a trade in another
    # language, an advertisement) tells nothing, unless it is the first.
    taken = full.where("side = 'c'").select(F.explode("words").alias("word")).distinct()
    word = full.where("side = 'p'").select("key", F.col("words").alias("title"), F.posexplode("words").alias("at", "word")).distinct()
    kept = word.join(taken.withColumn("_taken", F.lit(True)), "word", "left").where("_taken or at = 0").groupBy("key", "title").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).getField("word").alias("_kept"))
    kept = kept.select(F.lit("p").alias("side"), "key", F.col("title").alias("words"), "_kept")
    full = full.join(kept, ["side", "key", "words"], "left").select("key", F.coalesce("_kept", "words").alias("words"), "host", "location", "phone", "side")
    full = cut(full)
    release(both)
    return full.where("side = 'p'").drop("side"), full.where("side = 'c'").drop("side")


def _passes(rules: tuple[Rule, ...]) -> list[list[tuple[int, Rule]]]:
    """The rules with their numbers, those side by side that compare names alike together."""
    return [list(group) for _, group in groupby(enumerate(rules), key=lambda r: r[1].names)]


def _keyed(rows: DataFrame, group: list[tuple[int, Rule]]) -> DataFrame:
    """``key, words, host, rule, _a, _b``: two hashes of each combination that a rule of the pass joins on, none of it null."""
    names = group[0][1].names
    if names != "any":
        rows = rows.withColumn("_form", F.explode((_name_forms if names == "same" else _word_forms)("words")))
    made = []
    for number, rule in group:
        columns = [*rule.on, *(["_form"] if names != "any" else [])]
        given = F.lit(True)
        for c in rule.on:
            given = given & F.col(c).isNotNull()
        made.append(F.when(given, F.struct(F.lit(number).alias("rule"), F.xxhash64(F.lit(number), *columns).alias("_a"), F.hash(F.lit(number), *columns).alias("_b"))))
    return rows.select("key", "words", "host", F.inline(F.array_compact(F.array(*made))))


def _pass(places: DataFrame, companies: DataFrame, group: list[tuple[int, Rule]]) -> DataFrame:
    """``place_id, organisation_number, rule, _support`` that the rules of a pass join.

    A combination that several companies share tells none of them, so each
    side of the join is one company a key, and a building, phone or name that
    a third of all rows share joins no more rows than there are places. What
    a shared combination leaves open those of more attributes tell.
    """
    one = _keyed(companies, group).groupBy("rule", "_a", "_b").agg(F.min("key").alias("organisation_number"), F.max("key").alias("_last")).where("organisation_number = _last").drop("_last")
    same = ["place_id", "organisation_number", "rule", "words", "host"]
    pairs = _keyed(places, group).join(one, ["rule", "_a", "_b"]).withColumnRenamed("key", "place_id").groupBy(*same).agg(F.count("*").alias("_n"))
    names = group[0][1].names
    vetoed = [number for number, rule in group if names == "any" and "host" not in rule.on]
    if names == "related" or vetoed:
        # A company may have several names and websites; one of them has to agree.
        variants = companies.select(F.col("key").alias("organisation_number"), F.col("words").alias("_words"), F.col("host").alias("_host")).distinct()
        met = pairs if names == "related" else pairs.where(F.col("rule").isin(vetoed))
        met = met.join(variants, "organisation_number")
        if names == "related":
            met = met.where(_related("words", "_words"))
        else:
            # Two shared attributes don't stand against a website of one's own.
            met = met.where(F.col("host").isNull() | F.col("_host").isNull() | (F.col("host") == F.col("_host")))
        met = met.select(*same, "_n").dropDuplicates(same)
        pairs = met if names == "related" else met.unionByName(pairs.where(~F.col("rule").isin(vetoed)))
    return pairs.groupBy("place_id", "organisation_number", "rule").agg(F.sum("_n").alias("_support"))


def _first(pairs: DataFrame) -> DataFrame:
    """Of each place the company of the first rule; of several under one rule the one that more captures join, then the smaller number."""
    rank = F.struct(-F.col("rule"), F.col("_support"), F.translate("organisation_number", "0123456789", "9876543210"))
    return pairs.groupBy("place_id").agg(F.max_by(F.struct("organisation_number", "rule"), rank).alias("_best")).select("place_id", "_best.*")


def resolve(left: DataFrame, right: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``place_id, organisation_number, rule`` of described places and companies: the cascade.

    The first rule that resolves one capture of a place holds for the place;
    ``rule`` is its number. Each pass writes only what it resolves.
    """
    done: DataFrame | None = None
    for group in _passes(rules):
        open_places = left if done is None else left.join(done.select("place_id"), left["key"] == F.col("place_id"), "left_anti")
        best = cut(_first(_pass(open_places, right, group)))
        done = best if done is None else done.unionByName(best)
    return done


def pairs(places: DataFrame, companies: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``place_id, organisation_number``: at most one company a place; see ``match``."""
    return resolve(*_described(places, companies), rules).select("place_id", "organisation_number")


def match(places: DataFrame, companies: DataFrame, labels: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``place_id, organisation_number, rule, confidence``: at most one company a place.

    * All captures of a place count.
    * ``labels`` (``place_id, organisation_number, is_match``) are known
      cases. Without them all pairs that a rule joins over all places count
      as labelled where an attribute that the rule doesn't use is given on
      both sides, and as a match where one of these agrees. ``confidence`` is
      ``(right + a) / (labelled + a + b)`` with ``prior`` ``(a, b)``.
    * Nulls in any attribute join nothing; a place without id and a company
      without number are left out; repeated rows change nothing.
    """
    left, right = _described(places, companies)
    joined: DataFrame | None = None
    for group in _passes(rules):
        part = _pass(left, right, group)
        joined = part if joined is None else joined.unionByName(part)
    joined = cut(joined)
    # Companies are never taken out, so what the cascade resolves is of all that its rules join the first.
    resolved = _first(joined)
    names = F.element_at(F.array(*(F.lit(r.name) for r in rules)), F.col("rule") + 1)
    told = resolved.join(F.broadcast(_confidence(joined, left, right, labels, rules, prior)), "rule")
    return told.select("place_id", "organisation_number", names.alias("rule"), "confidence")


def _attributes(rows: DataFrame, name: str, tag: str) -> DataFrame:
    """All values each side gives of each attribute, in one row a key."""
    long = None
    for attribute in ATTRIBUTES:
        part = rows.select(F.col("key").alias(name), F.lit(attribute).alias("attribute"), F.col(attribute).cast("string").alias("value"))
        long = part if long is None else long.unionByName(part)
    forms = rows.select(F.col("key").alias(name), F.lit("name").alias("attribute"), F.explode(_name_forms("words")).alias("value"))
    return long.unionByName(forms).where("value is not null").distinct().withColumnRenamed("value", f"{tag}value")


def _confidence(joined: DataFrame, left: DataFrame, right: DataFrame, labels: DataFrame | None, rules: tuple[Rule, ...], prior: tuple[float, float]) -> DataFrame:
    """``rule, confidence``, one row for each of ``rules``, of all pairs that they join."""
    if labels is not None:
        told = joined.join(labels, ["place_id", "organisation_number"]).select("rule", F.col("is_match").cast("int").alias("_right"))
    else:
        used = F.lit(False)
        for number, rule in enumerate(rules):
            mine = [*rule.on] + ["name"] * (rule.names != "any")
            used = used | ((F.col("rule") == number) & F.col("attribute").isin(mine))
        both = joined.join(_attributes(left, "place_id", "a_"), "place_id").where(~used).join(_attributes(right, "organisation_number", "b_"), ["organisation_number", "attribute"])
        told = both.groupBy("place_id", "organisation_number", "rule").agg(F.max((F.col("a_value") == F.col("b_value")).cast("int")).alias("_right"))
    counts = told.groupBy("rule").agg(F.sum("_right").alias("_right"), F.count("*").alias("_all"))
    every = left.sparkSession.createDataFrame([(n,) for n in range(len(rules))], "rule int")
    a, b = prior
    return every.join(counts, "rule", "left").select("rule", ((F.coalesce("_right", F.lit(0)) + a) / (F.coalesce("_all", F.lit(0)) + a + b)).alias("confidence"))
