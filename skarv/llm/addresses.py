"""Postal addresses that denote one location, however they are written.

Each address is expanded into all plausible normalised forms of its street
(abbreviations and accents undone, with and without the words that qualify its
name, as many letters left out anywhere as may be slips), each form is hashed
together with the town, the hashes are exploded and joined, and spellings that
share one are compared; of spellings that are one street, equal house numbers
and letters are linked, others are rejected. What is linked is one location.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarv.llm.linking import components
from skarv.session import cut, release

#: How a kind of street is written, the longest forms first.
KINDS = {
    "veien": ("veien", "vegen", "veg", "vei", "vn", "v"),
    "gata": ("gaten", "gata", "gate", "gt", "g"),
    "bakken": ("bakken", "bakke", "bakk", "bk"),
    "alleen": ("alleen", "alle", "al"),
    "svingen": ("svingen", "sving", "svg", "sv"),
    "plassen": ("plassen", "plass", "pl"),
    "stien": ("stien", "sti"),
    "torget": ("torget", "torg"),
}
_WRITTEN = sorted(((form, kind) for kind, forms in KINDS.items() for form in forms), key=lambda x: -len(x[0]))
#: Words before the name of a street that tell it from others of that name.
QUALIFIERS = frozenset("ovre nedre indre ytre midtre nordre sondre vestre ostre store lille gamle nye gml".split())
#: An ending that may be short for one kind, or for another after an s of the stem.
EITHER = "sv"
_LONG = [(forms[0], kind) for kind, forms in KINDS.items()] + [("vegen", "veien"), ("gaten", "gata")]
_SPLIT_KIND = frozenset(form for form, _ in _WRITTEN if len(form) > 2 or form in ("gt", "vn"))
#: Two spellings are two streets if either has at least this many house numbers
#: in the town and neither this many times as many as the other.
ESTABLISHED, OUTNUMBERED = 3, 4
#: Stems of fewer letters may have one slip, others two.
TWO_SLIPS = 8
#: A town written this many times as often as one that is nearly it is meant by it.
RARE = 10

#: Letters that are also written as two become one, whichever way they are written.
_FOLD = (("æ", "e"), ("ä", "e"), ("ae", "e"), ("ø", "o"), ("ö", "o"), ("oe", "o"), ("å", "a"), ("aa", "a"), ("é", "e"), ("ô", "o"), ("ü", "u"))
_COUNTRY = re.compile(r"(?:^|[\s,;/|-])(?:norway|norge|noreg|no|nor|n)\s*$")
#: A person or firm up to the next separator; where none follows before a number, one word.
_CARE = re.compile(r"\bc/o\b(?:[^,;\n|]*?forvaltning|[^,;\n|/\d]*?(?=\s[/-]\s|[,;\n|]|$)|\s*\S+)|(?:^|(?<=[\s,;/|]))(?:v/|attn?\b\.?)(?:[^,;/\n|\d]*?(?=\s[/-]\s|[,;/\n|])|\s*\S+)")
_UNIT = re.compile(
    r"\b\d{1,2}\s*\.?\s*(?:etasje|etg|et|etasj)\b\.?|\b(?:etasje|etg)\b\.?\s*\d{1,2}\b|\b[hluk]\d{4}\b"
    r"|\b(?:inngang|oppgang|bygg|bygning|lokale|seksjon|leilighet|leil|rom|enhet|hus|blokk|port)\b\.?\s*(?:nr\.?\s*)?(?:\d{1,3}[a-z]?|[a-z])\b"
)
_BOX = re.compile(r"\b(?:postboks|postb|p\.?\s?b|p\.?\s?o\.?\s?box|po\s?box|boks|box)\b\.?\s*(?:nr\b\.?|no\b\.?|#)?\s*(\d+)\b")
_CODE = re.compile(r"(?<![\d#])(?:\b(?:no|n)\s*[- ]?\s*)?(?<!\d)(\d{4})(?!\d)")
_NUMBER_WORD = re.compile(r"\b(?:nr|no|nummer)\b\.?\s*(?=\d)|#\s*(?=\d)")
_HOUSE = re.compile(r"(?<![\w])(\d{1,5})\s*-?\s*([a-z])?(?!\w)")
#: More digits are no number of a house or box.
_DIGITS = 9
_TOKEN = re.compile(r"[^\W\d_][^\W\d_.'-]*\.?|\d+")


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).casefold()
    for a, b in _FOLD:
        text = text.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _kind(street: str) -> tuple[str, str, int]:
    """``(stem, kind, letters the kind is told by)`` of a street in one word; the kind is empty if it can't be told."""
    for form, kind in _WRITTEN:
        if street.endswith(form) and len(street) >= len(form) + 3:
            return street[: -len(form)], form if form == EITHER else kind, len(form)
    for form, kind in _LONG:  # a slip within the ending
        for length in (len(form), len(form) - 1, len(form) + 1):
            if len(street) > length + 2 and near(street[-length:], form, 1):
                return street[:-length], kind, len(form)
    return street, "", 0


def near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` letters are changed, left out, put in or swapped with the next."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row2 = row, [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row2[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row2.append(d)
        if min(row2) > most:
            return False
        before, row = last, row2
    return row[-1] <= most


def _code(text: str, given: str | None) -> re.Match | None:
    """The postal code in ``text``: marked as one, else the last number of four digits that isn't a street's.

    A number right behind the name of a street is its house number, if another
    one can be the code or the code is given, or if it begins with no zero and
    no other number is left for the house.
    """
    found = list(_CODE.finditer(text))
    free = []
    for m in found:
        if not m[0][0].isdigit():
            return m
        word = re.search(r"([^\W\d_]+)\.?\s*$", text[: m.start()])
        if not word or not _kind(word[1])[2] > 1:
            free.append(m)
    if free:
        return free[-1]
    if not found or given or (not found[-1][1].startswith("0") and not re.search(r"\d", _CODE.sub("", text))):
        return None
    return found[-1]


def parse(address: str | None, code: str | None = None, town: str | None = None) -> tuple | None:
    """``(form, stem, kind, number, letter, code, town, ahead)``, all folded; ``form`` is street or box.

    ``ahead`` are words before the name of the street that may be of it. Null
    if there is neither a numbered street nor a numbered box.
    """
    if not address or not address.strip():
        return None
    text = fold(address).replace(" ", " ")
    text = re.sub(r"[ \t]+", " ", text).strip(" ,;/|-\n.")
    text = _CARE.sub(" , ", text)
    while (shorter := _COUNTRY.sub("", text).rstrip(" ,;/|-\n")) != text:
        text = shorter
    text = _UNIT.sub(" , ", text)
    boxed = _BOX.search(text)
    if boxed and len(boxed[1]) > _DIGITS:
        return None
    if boxed:
        text = text[: boxed.start()] + " , " + text[boxed.end() :]
    given = code if code and re.fullmatch(r"\s*\d{4}\s*", code) else None
    found = _code(text, given)
    if found:
        code = code or found.group(1)
        text = text[: found.start()] + " , " + text[found.end() :]
    code = code.strip() if code and re.fullmatch(r"\s*\d{4}\s*", code) else None
    text = _NUMBER_WORD.sub("", text)
    stem = kind = letter = ahead_of = ""
    number = None
    if boxed:
        number = int(boxed.group(1))
    else:
        for house in _HOUSE.finditer(text):
            left = re.split(r"[,;/\n|]| - ", text[: house.start()])[-1]
            right = re.split(r"[,;/\n|]| - ", text[house.end() :])[0]
            best = None
            for ahead, part in ((True, left), (False, right)):
                words = [w for w in (w.strip(".'-") for w in re.findall(r"[^\W\d_]+\.?", part)) if w]
                if not words:
                    continue
                many = 2 if len(words) > 1 and (words[-1] if ahead else words[1]) in _SPLIT_KIND else 1
                told = _kind("".join(words[-many:] if ahead else words[:many]))
                # Ahead of the number, unless what follows it is a street more plainly.
                if best is None or (told[2] > 2 and best[1][2] <= 2):
                    best = ahead, told, words[:-many] if ahead else words[many:], many
            if best is None:
                continue
            ahead, (stem, kind, _), rest, many = best
            number, letter = int(house.group(1)), house.group(2) or ""
            left_cut = text[: house.start() - len(left)] if ahead else text[: house.start()]
            right_cut = text[house.end() :] if ahead else text[house.end() + len(right) :]
            if ahead and rest:
                # Of "Karl Johans gate" the name goes on before it, of "Øvre Storgata" by known words only.
                begin = 0 if many == 2 and stem.endswith("s") else len(rest)
                while begin > 0 and rest[begin - 1] in QUALIFIERS:
                    begin -= 1
                ahead_of = " ".join(rest[begin:])
                rest = rest[:begin]
            text = left_cut + " , " + " ".join(rest) + " , " + right_cut
            break
        if number is None:
            return None
    if not town:
        names = [" ".join(re.findall(r"[^\W\d_]+", s)) for s in re.split(r"[,;/\n|]| - ", text)]
        names = [n for n in names if len(n) > 2]
        town = max(names, key=len) if names else ahead_of or None
    else:
        town = " ".join(re.findall(r"[^\W\d_]+", fold(town))) or None
    return ("box" if boxed else "street", stem, kind, number, letter, code, town, ahead_of)


_PARSED = T.StructType(
    [
        T.StructField("form", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("number", T.IntegerType()),
        T.StructField("letter", T.StringType()), T.StructField("code", T.StringType()), T.StructField("town", T.StringType()), T.StructField("ahead", T.StringType()),
    ]
)


def parsed(address: Column, code: Column, town: Column) -> Column:
    @F.pandas_udf(_PARSED)
    def run(addresses: pd.Series, codes: pd.Series, towns: pd.Series) -> pd.DataFrame:
        rows = [parse(a, c, t) or (None,) * 8 for a, c, t in zip(addresses, codes, towns)]
        return pd.DataFrame(rows, columns=[f.name for f in _PARSED.fields]).astype({"number": "Int32"})

    return run.asNondeterministic()(address, code.cast("string"), town.cast("string"))  # lest a filter behind it parse twice


def town_names(rows: DataFrame) -> dict[str, str]:
    """Postal code to the town most rows write with it, over all rows.

    What reaches the driver is one row a postal code of four digits, so never
    more than 10,000 whatever the size of the table.
    """
    counts = rows.where(F.col("code").rlike(r"^[0-9]{4}$") & F.col("town").isNotNull()).groupBy("code", "town").agg(F.count("*").alias("n"))
    most = counts.groupBy("code").agg(F.max_by("town", F.struct("n", "town")).alias("town"), F.max("n").alias("n"))
    known = {r.code: (r.town, r.n) for r in most.collect()}
    often: dict[str, int] = {}
    for town, n in known.values():
        often[town] = often.get(town, 0) + n
    usual = [t for t in often if often[t] >= RARE]
    meant = {t: next((u for u in usual if often[u] >= RARE * often[t] and near(t, u, 2)), t) for t in often}
    return {code: meant[town] for code, (town, _) in known.items()}


def place_in_town(code: Column, town: Column, known: dict[str, str]) -> Column:
    """The town: by the postal code where it is known, else by the name, one or two slips allowed, else the code itself."""
    names = sorted(set(known.values()))
    exact = frozenset(names)

    @F.pandas_udf(T.StringType())
    def run(codes: pd.Series, towns: pd.Series) -> pd.Series:
        seen: dict = {}

        def by_name(name):
            if name is None or name in exact:
                return name
            if name not in seen:
                for most in (1, 2):
                    close = [n for n in names if near(name, n, most)]
                    if close:
                        break
                seen[name] = close[0] if len(close) == 1 else None
            return seen[name]

        return pd.Series([known[c] if c in known else by_name(t) or (c and f"code {c}") for c, t in zip(codes, towns)], dtype=object)

    return run.asNondeterministic()(code, town)


def _forms(stem: Column) -> Column:
    """The stem and all it becomes with one letter left out."""
    places = F.sequence(F.lit(1), F.length(stem))
    shorter = F.transform(places, lambda i: F.concat(F.substring(stem, F.lit(1), i - 1), stem.substr(i + 1, F.length(stem))))
    return F.array_distinct(F.concat(F.array(stem), F.when(F.length(stem) > 3, shorter).otherwise(F.array().cast("array<string>"))))


@F.pandas_udf(T.BooleanType())
def _one_street(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x, y, 1 if min(len(x), len(y)) < TWO_SLIPS else 2) for x, y in zip(a, b)], dtype=bool)


def _settled(placed: DataFrame) -> DataFrame:
    """``placed`` with each ``EITHER`` read as the kind that other records of the town have, and the stem qualified by the words ahead.

    Both plausible forms are expanded; the one that more records write out
    holds, by the whole stem or else by its last four letters.
    """
    # The town may stand ahead of its street.
    own = F.trim(F.when(F.startswith(F.concat("ahead", F.lit(" ")), F.concat("place", F.lit(" "))), F.expr("substring(ahead, length(place) + 1)")).otherwise(F.col("ahead")))
    placed = placed.withColumn("_own", F.coalesce(F.replace(own, F.lit(" "), F.lit("")), F.lit("")))
    clear, open_ = placed.where(F.col("kind") != EITHER), placed.where(F.col("kind") == EITHER)
    whole = clear.where("form = 'street'").groupBy("place", "stem", "kind").agg(F.count("*").alias("n"))
    roots = whole.withColumn("stem", F.right("stem", F.lit(4))).groupBy("place", "stem", "kind").agg(F.sum("n").alias("n"))
    spellings = open_.select("place", "stem").distinct()
    both = spellings.select("place", "stem", F.inline(F.array(F.struct(F.col("stem").alias("as_stem"), F.lit("svingen").alias("as_kind")), F.struct(F.concat("stem", F.lit("s")).alias("as_stem"), F.lit("veien").alias("as_kind")))))
    told = both.join(whole.select("place", F.col("stem").alias("as_stem"), F.col("kind").alias("as_kind"), F.col("n").alias("_whole")), ["place", "as_stem", "as_kind"], "left")
    told = told.withColumn("_root", F.right("as_stem", F.lit(4))).join(roots.select("place", F.col("stem").alias("_root"), F.col("kind").alias("as_kind"), F.col("n").alias("_roots")), ["place", "_root", "as_kind"], "left")
    rank = F.struct(F.coalesce("_whole", F.lit(0)), F.coalesce("_roots", F.lit(0)), F.col("as_kind"))
    best = told.groupBy("place", "stem").agg(F.max_by(F.struct("as_stem", "as_kind"), rank).alias("_best"))
    every = clear.unionByName(open_.join(best, ["place", "stem"]).withColumn("stem", F.col("_best.as_stem")).withColumn("kind", F.col("_best.as_kind")).drop("_best").select(clear.columns))
    return every.withColumn("bare", F.col("stem")).withColumn("stem", F.concat("_own", "stem"))


def locate(rows: DataFrame, key: str, address: str = "address", code: str | None = None, town: str | None = None) -> DataFrame:
    """``key`` and ``location``, a hash that the records of one location share.

    * A location is a street, house number and letter in a postal town, or a
      numbered post box in one. Floors, units, entrances, c/o lines and the
      country don't matter.
    * Records without address, or whose address has no number or no town that
      can be told, have no location and are left out. Repeated records share
      theirs. Addresses are read whole.
    * Only spellings of streets are compared, each once however many records
      write it; spellings that are two streets by ``ESTABLISHED`` aren't taken for one
      another.
    """
    none = F.lit(None).cast("string")
    texts = rows.select(F.col(key).alias("_key"), F.col(address).alias("_address"), (F.col(code) if code else none).alias("_code"), (F.col(town) if town else none).alias("_town")).where("_address is not null")
    read = texts.withColumn("_p", parsed(F.col("_address"), F.col("_code"), F.col("_town"))).where("_p.form is not null")
    read = cut(read.select("_key", "_p.*"))
    known = town_names(read)
    placed = read.withColumn("place", place_in_town(F.col("code"), F.col("town"), known)).where("place is not null")
    spot = ["place", "form", "stem", "kind", "number", "letter"]
    settled = cut(placed.select("_key", *spot, "ahead"))
    placed = cut(_settled(settled).select("_key", *spot, "bare"))
    release(read, settled)

    spelled = placed.groupBy(*spot, "bare").agg(F.count("*").alias("n"))
    houses = spelled.groupBy("place", "form", "stem", "kind").agg(F.count_distinct("number", "letter").alias("_houses"))
    # Spellings are compared as streets of a town, whatever houses they were written for.
    streets = houses.where("form = 'street'").select("place", "kind", "stem", "_houses")
    slips = F.when(F.length("stem") >= TWO_SLIPS, F.array_distinct(F.flatten(F.transform(_forms(F.col("stem")), _forms)))).otherwise(_forms(F.col("stem")))
    hashed = streets.select("place", "kind", "stem", "_houses", F.explode(slips).alias("_form")).select("place", "kind", "stem", "_houses", F.xxhash64("place", "kind", "_form").alias("_hash"))
    a, b = hashed.alias("a"), hashed.alias("b")
    fewer, more = F.least("a._houses", "b._houses"), F.greatest("a._houses", "b._houses")
    two_streets = (fewer >= ESTABLISHED) & (fewer * OUTNUMBERED > more)
    alike = (F.col("a._hash") == F.col("b._hash")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.kind") == F.col("b.kind"))
    pairs = a.join(b, alike & (F.col("a.stem") < F.col("b.stem")) & ~two_streets)
    pairs = pairs.select("a.place", "a.kind", F.col("a.stem").alias("stem"), F.col("b.stem").alias("_other")).distinct().where(_one_street("stem", "_other"))
    # A name without what qualifies it is the town's only street of that name.
    qualified = spelled.where("form = 'street' and stem <> bare").groupBy("place", "kind", "bare").agg(F.min("stem").alias("stem"), F.max("stem").alias("_last")).where("stem = _last")
    pairs = pairs.unionByName(qualified.select("place", "kind", F.col("bare").alias("stem"), F.col("stem").alias("_other")))
    spots = spelled.where("form = 'street'").select(*spot)
    ids = spots.select(F.xxhash64(*spot).alias("b"))
    other = [F.col("_other") if c == "stem" else F.col(c) for c in spot]
    links = spots.join(pairs, ["place", "kind", "stem"]).select(F.xxhash64(*spot).alias("a"), F.xxhash64(*other).alias("b")).join(ids, "b", "left_semi").select("a", "b")
    classes = components(links)
    located = placed.withColumn("_id", F.xxhash64(*spot)).join(classes, F.col("_id") == F.col("node"), "left")
    return located.select(F.col("_key").alias(key), F.coalesce("component", "_id").alias("location"))


#: Records of a location that one task pairs with all others.
TOGETHER = 1000


def same_location(located: DataFrame, key: str = "record") -> DataFrame:
    """All pairs ``record_a < record_b`` of one location, each once.

    A location's records are paired in blocks of about ``TOGETHER``, so that a
    building with very many is the work of many tasks. Those who don't need
    all pairs have the locations themselves.
    """
    rows = located.select(F.col(key).alias("_k"), "location").distinct()
    sizes = rows.groupBy("location").agg(F.ceil(F.count("*") / TOGETHER).alias("_blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(sizes, "location")
    a = rows.select("location", F.col("_k").alias("record_a"), F.pmod(F.xxhash64("_k"), "_blocks").alias("_block"))
    b = rows.select("location", F.col("_k").alias("record_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_block"))
    return a.join(b, ["location", "_block"]).where("record_a < record_b").select("record_a", "record_b")
