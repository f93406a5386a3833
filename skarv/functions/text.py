"""Names and passages, as Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Small Latin letters with an accent or stroke and what they fold to, in the same order.
_FOLDED = {c: unicodedata.normalize("NFKD", c)[0] for c in map(chr, range(0xE0, 0x180)) if c.islower() and unicodedata.normalize("NFKD", c)[0] in "abcdefghijklmnopqrstuvwxyz"}
_FOLDED |= dict(zip("øłħıŧ", "olhit"))
ACCENTED, PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())
#: Words of a company's name that don't tell it from another.
STOP_WORDS = ("as", "asa", "ans", "da", "enk", "iks", "sa", "sam", "sti", "stiftelsen", "nuf", "ab", "b", "v", "limited", "ltd", "inc", "plc", "the", "og", "and")
#: Legal forms that end a name.
LEGAL_FORMS = ("as", "asa", "ans", "da", "enk", "nuf", "sa", "ab", "ltd")


def fold(text: Column) -> Column:
    """Lower case without accents; ``æ`` as ``ae``, ``œ`` as ``oe``, ``ß`` as ``ss``."""
    lowered = F.lower(text)
    for letter, letters in (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th"), ("ð", "d")):
        lowered = F.replace(lowered, F.lit(letter), F.lit(letters))
    return F.translate(lowered, ACCENTED, PLAIN)


def tokens(text: Column, stop: tuple[str, ...] = (), least: int = 1) -> Column:
    """Folded words of letters and digits, in order, without ``stop`` and shorter than ``least``; never null."""
    words = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    keep = lambda w: (F.length(w) >= least) & (~w.isin(*stop) if stop else F.lit(True))
    return F.filter(words, keep)


def name_tokens(name: Column) -> Column:
    return tokens(name, STOP_WORDS, 2)


def name_key(name: Column) -> Column:
    """The order-free key of a name: its telling words, sorted and joined."""
    return F.array_join(F.array_sort(F.array_distinct(name_tokens(name))), " ")


def place_tokens(text: Column) -> Column:
    """The telling words of a place's title: of at least three letters, or with a digit."""
    return F.filter(tokens(text), lambda t: (F.length(t) >= 3) | t.rlike("[0-9]"))


def slug(text: Column) -> Column:
    return F.array_join(tokens(text), "-")


def without_legal_form(name: Column) -> Column:
    """The folded name less legal forms at its end."""
    return F.regexp_replace(F.array_join(tokens(name), " "), "( (" + "|".join(LEGAL_FORMS) + "))+$", "")


def squeezed(text: Column) -> Column:
    """One spelling of dashes, quotes and white space, in lower case, for containment tests."""
    unified = F.translate(text, "‐‑‒–—―−“”„«»‘’‚ ", "-------\"\"\"\"\"''' ")
    return F.trim(F.regexp_replace(F.lower(unified), r"\s+", " "))


def contains_span(text: Column, span: Column) -> Column:
    """Whether ``span`` stands in ``text``, layout and typography aside; null spans stand nowhere."""
    return F.coalesce(F.contains(squeezed(text), squeezed(span)) & (F.length(F.trim(span)) > 0), F.lit(False))


def numbers(text: Column) -> Column:
    """The distinct runs of digits, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+)"), F.lit(1))))


def supported_by(claim: Column, span: Column) -> Column:
    """Whether all words and numbers of ``claim`` stand in ``span``."""
    return F.size(F.array_except(tokens(claim), tokens(span))) == 0


def overlap(a: Column, b: Column) -> Column:
    """The share of the words ``a`` that stand in ``b``; 0 without words."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_distinct(a)), F.lit(0)), F.lit(0.0))


def organisation_numbers(text: Column) -> Column:
    """Nine digits that stand alone, in threes or together; distinct, sorted, without separators."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?<![0-9])([0-9]{3}[ .\\u00a0]?[0-9]{3}[ .\\u00a0]?[0-9]{3})(?![0-9])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", ""))))


def email_domains(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9._%+-]+@([a-z0-9-]+(?:\.[a-z0-9-]+)+)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def decoded_email(hexed: Column) -> Column:
    """An address hidden as hexadecimal, each byte xor-ed with the first; null if it isn't one."""
    byte = lambda i: F.conv(hexed.substr(i, F.lit(2)), 16, 10).try_cast("int")
    places = F.sequence(F.lit(3), F.length(hexed) - 1, F.lit(2))
    text = F.array_join(F.transform(places, lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1))))), "")
    return F.when(hexed.rlike(r"^([0-9a-fA-F]{2}){2,}$"), text)


#: Month names, Norwegian and English, by their first letters.
MONTHS = (("jan", 1), ("feb", 2), ("mar", 3), ("apr", 4), ("mai", 5), ("may", 5), ("jun", 6), ("jul", 7), ("aug", 8), ("sep", 9), ("okt", 10), ("oct", 10), ("nov", 11), ("des", 12), ("dec", 12))


def explicit_dates(text: Column, first_year: int = 1995, last: Column | None = None) -> Column:
    """The distinct days a text names, sorted: ISO, ``day.month.year``, ``day month year``.

    A day that doesn't exist, lies before ``first_year`` or after ``last`` is
    left out; nothing is guessed.
    """
    text = F.lower(F.coalesce(text, F.lit("")))
    iso = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"), F.lit(1))
    dotted = F.regexp_extract_all(text, F.lit(r"(?<![0-9.])([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])"), F.lit(1))
    written = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{1,2}\.? (?:" + "|".join(m for m, _ in MONTHS) + r")[a-z]* [0-9]{4})(?![0-9])"), F.lit(1))
    month = F.create_map(*(F.lit(x) for m, n in MONTHS for x in (m, f"{n:02d}")))

    def from_dotted(x):
        p = F.split(x, r"\.")
        return F.concat_ws("-", p[2], F.lpad(p[1], 2, "0"), F.lpad(p[0], 2, "0"))

    def from_written(x):
        p = F.split(x, " ")
        return F.concat_ws("-", p[2], F.try_element_at(month, F.substring(p[1], 1, 3)), F.lpad(F.replace(p[0], F.lit("."), F.lit("")), 2, "0"))

    days = F.transform(F.concat(iso, F.transform(dotted, from_dotted), F.transform(written, from_written)), lambda x: x.try_cast("date"))
    kept = F.filter(days, lambda d: d.isNotNull() & (F.year(d) >= first_year) & ((d <= last) if last is not None else F.lit(True)))
    return F.array_sort(F.array_distinct(kept))


#: Titles and the office they name.
OFFICES = {
    "ceo": "ceo", "chief executive officer": "ceo", "daglig leder": "ceo", "administrerende direktør": "ceo", "adm dir": "ceo", "adm direktør": "ceo", "managing director": "ceo", "konsernsjef": "ceo",
    "styreleder": "chair", "styrets leder": "chair", "chairman": "chair", "chair": "chair", "chairman of the board": "chair", "styremedlem": "board_member", "board member": "board_member",
    "cfo": "cfo", "chief financial officer": "cfo", "økonomisjef": "cfo", "finansdirektør": "cfo", "cto": "cto", "chief technology officer": "cto", "teknisk direktør": "cto",
    "coo": "coo", "chief operating officer": "coo", "driftsdirektør": "coo", "gründer": "founder", "grunnlegger": "founder", "founder": "founder", "co founder": "founder", "medgründer": "founder",
    "eier": "owner", "owner": "owner", "innehaver": "owner",
}


def office(title: Column, proposed: Column) -> Column:
    """``struct(office, method)``: by the table, else as proposed where that is an office."""
    key = F.array_join(F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}]+"), 0), " ")
    told = F.try_element_at(F.create_map(*(F.lit(x) for pair in OFFICES.items() for x in pair)), key)
    given = F.lower(F.trim(proposed))
    return F.when(told.isNotNull(), F.struct(told.alias("office"), F.lit("table").alias("method"))).when(given.isin(*sorted(set(OFFICES.values()))), F.struct(given.alias("office"), F.lit("proposed").alias("method"))).otherwise(F.struct(F.lit(None).cast("string").alias("office"), F.lit("invalid").alias("method")))


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Texts in compatible form (NFKC), for ``plain``."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def plain(text: Column) -> Column:
    """Compatible form, lower case, one kind of dash and quotation mark, one space between words."""
    folded = F.lower(compatible(text))
    for marks, one in (("[\u2010-\u2015\u2212]", "-"), ("[\u2018\u2019\u201a\u201b\u2032]", "'"), ('[\u201c\u201d\u201e\u201f\u2033]', '"')):
        folded = F.regexp_replace(folded, marks, one)
    return F.trim(F.regexp_replace(folded, r"\s+", " "))
