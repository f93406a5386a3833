"""Text that was read in a wrong character encoding: found, and restored where it still can be.

The sequences that every pair of encodings makes of every letter are computed
once and matched by a multi-pattern automaton; only the matched spans are
replaced, so that correct text around them stays as it is. Text that was
misread several times, each time in any encoding, is restored level by level.

A sequence of several characters (UTF-8 read in a one-byte encoding) is damage
wherever it stands; of scripts and signs that the table of sequences doesn't
list one by one, where two stand side by side. A single character (one one-byte encoding
read in another, or seven-bit national letters) may also be meant; it counts
where it stands against a letter, the letter it would have been fits the case
of its neighbours, and the three trigrams around that letter are written in
this corpus, by statistics over all of it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings that text is read in by mistake, and in which it may have been written.
READ_AS = ("cp1252", "latin-1", "iso8859-15", "cp437", "cp850", "cp852", "cp865", "cp866", "mac_roman", "cp1250", "iso8859-2", "cp1251", "iso8859-5", "koi8-r", "cp1253", "iso8859-7", "cp1254", "cp1257", "iso8859-4", "iso8859-10")
WRITTEN_IN = ("cp1252", "latin-1", "cp850", "cp865", "mac_roman")
#: Text may have been misread this often in a row; what is deeper isn't complete.
DEPTH = 5
#: The letters that stand for code positions of ASCII in NS 4551-1.
SEVEN_BIT = {"[": "Æ", "\\": "Ø", "]": "Å", "{": "æ", "|": "ø", "}": "å"}
LETTERS = "æøåÆØÅéèêëóòôöäüãñçîïáàíúõÉÈÊËÓÒÔÖÄÜÃÑÇÎÏÁÀÍÚÕßðþÐÞýÿ"
#: Characters whose misread UTF-8 is looked for: Latin, Greek and Cyrillic letters, and usual signs.
RANGES = ((0xA0, 0x250), (0x370, 0x460), (0x1E00, 0x1F00), (0x2010, 0x2040), (0x20A0, 0x20C0), (0x2120, 0x2124))
#: Letters and signs that meet in correct text, as in «Østfold», and then show nothing.
MEANT = frozenset("æøåÆØÅéèêôòàüÉ«»–—…“”„‘’§°©®½¼¾·€£\xa0")
#: A trigram counts as written here if it stands in this share of the values that
#: have any, and in at least as many.
SHARE, WRITTEN = 1e-5, 2
#: A letter is replaced if what it would have been is written this many times as often.
AS_WRITTEN = 4
#: Values with fewer spaces are names, in which a question mark before a space ends no sentence.
NAME_WORDS = 5

_DAMAGE = T.StructType(
    [
        T.StructField("damaged", T.BooleanType()),
        T.StructField("restored", T.StringType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("encodings", T.ArrayType(T.StringType())),
    ]
)


def _decode(raw: bytes, encoding: str) -> str | None:
    """What ``raw`` reads as; bytes an encoding leaves open pass as the controls they are elsewhere."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=1)
def _images() -> dict[str, dict[str, int]]:
    """Of each encoding the characters beyond ASCII and their bytes."""
    return {encoding: {_decode(bytes([b]), encoding): b for b in range(0x80, 0x100)} for encoding in READ_AS}


@lru_cache(maxsize=1)
def _sequences() -> tuple[dict[str, tuple[str, str]], dict[str, tuple[str, str]]]:
    """Garbled sequence to original and pair of encodings, for all sequences of several characters: those that show damage wherever they stand, and those that might be meant.

    Originals are those of ``RANGES`` and all that an encoding may make of a
    byte, so that what was misread twice is met twice.
    """
    known: dict[str, tuple[str, str]] = {}
    originals = {chr(c) for low, high in RANGES for c in range(low, high) if unicodedata.category(chr(c)) != "Cn"} | {c for image in _images().values() for c in image}
    for encoding in READ_AS:
        for original in sorted(originals):
            garbled = _decode(original.encode("utf-8"), encoding)
            if garbled.isascii():
                continue
            told = original, f"utf-8 as {encoding}"
            before = known.setdefault(garbled, told)[0]
            # Of several originals the one that is a letter of these languages, æ, ø and å first.
            if unicodedata.category(before) == "Cc" != unicodedata.category(original) or original in LETTERS and (before not in LETTERS or (LETTERS.index(original) < 6 <= LETTERS.index(before) and garbled.isalpha() and not any(c in "ÃÂÅÄ" for c in garbled))):
                known[garbled] = told
    # Letters of a script don't show damage by standing beside one another.
    known = {g: v for g, v in known.items() if not MEANT.issuperset(g)}
    plain = {g: v for g, v in known.items() if not all(unicodedata.category(c)[0] == "L" for c in g) or any(c in "ÃÂÅÄ" for c in g) or (len(g) > 2 and max(g) < "\u0250")}
    open_ = {g: v for g, v in known.items() if g not in plain and (not v[0].isalpha() or v[0] < "\u0250" and any(c.lower() not in _PLAIN for c in g))}
    for group in (plain, open_):
        for garbled, (original, pair) in list(group.items()):
            lowered = garbled.lower()
            if lowered != garbled and original.isalpha() and original.lower() in _PLAIN and len(lowered) == len(garbled) and lowered not in plain:
                group.setdefault(lowered, (original.lower(), pair + ", then lower case"))
    return plain, open_


def garbled_sequences() -> dict[str, tuple[str, str]]:
    """Those that show damage wherever they stand."""
    return _sequences()[0]


@lru_cache(maxsize=1)
def garbled_letters() -> dict[str, dict[str, tuple[str, ...]]]:
    """Single garbled character to its possible originals, each with the pairs of encodings."""
    known: dict[str, dict[str, tuple[str, ...]]] = {}
    for written in WRITTEN_IN:
        for read in READ_AS:
            for letter in LETTERS:
                try:
                    raw = letter.encode(written)
                except UnicodeEncodeError:
                    continue
                garbled = _decode(raw, read)
                if garbled != letter and len(garbled) == 1 and not garbled.isascii():
                    of = known.setdefault(garbled, {})
                    of[letter] = (*of.get(letter, ()), f"{written} as {read}")
    for garbled, letter in SEVEN_BIT.items():
        known[garbled] = {letter: ("ns_4551-1 as ascii",)}
    return known


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for garbled, (original, pair) in garbled_sequences().items():
        found.add_word(garbled, (garbled, original, pair))
    for garbled in garbled_letters():
        if not found.exists(garbled):
            found.add_word(garbled, (garbled, None, None))
    for lost in "�?":
        found.add_word(lost, (lost, None, None))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def open_automaton():
    """The sequences of letters that only their context tells."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for garbled, (original, pair) in _sequences()[1].items():
        found.add_word(garbled, (garbled, original, pair))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def far_automaton():
    """How sequences begin that the tables don't list: their first two characters, with the encodings."""
    import ahocorasick

    begins: dict[str, list[str]] = {}
    listed = {g[:2] for group in _sequences() for g in group if len(g) == 2}
    for encoding, image in _images().items():
        shown = {b: c for c, b in image.items()}
        for lead in range(0xC2, 0xF5):
            for second in range(0x80, 0xC0):
                begin = shown.get(lead, "") + shown.get(second, "")
                if len(begin) == 2 and (lead >= 0xE0 or begin not in listed):
                    begins.setdefault(begin, []).append(encoding)
    found = ahocorasick.Automaton()
    for begin, encodings in begins.items():
        found.add_word(begin, encodings)
    found.make_automaton()
    return found


def _far(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, original, pair)`` of characters of any script, misread as sequences side by side.

    Letters of one script beyond Latin side by side may be a word, and one
    sequence alone may be letters and signs that meet by chance, unless it is
    of four.
    """
    found: dict[str, dict[int, tuple[int, str]]] = {}
    for last, encodings in far_automaton().iter(text):
        start = last - 1
        for encoding in encodings:
            image = _images()[encoding]
            lead = image[text[start]]
            end = start + (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            raw = [image.get(c, 0) for c in text[start:end]]
            if text[start:end].isalpha() and all(c > "\u036f" for c in text[start:end]):
                continue
            try:
                original = bytes(raw).decode("utf-8")
            except (UnicodeDecodeError, ValueError):
                continue
            if len(original) == 1 and unicodedata.category(original) not in ("Cn", "Cc", "Co", "Cs"):
                found.setdefault(encoding, {})[start] = end, original
    runs: list[tuple[int, int, list]] = []
    for encoding, at in found.items():
        inside: set[int] = set()
        for start in sorted(at):
            if start in inside:
                continue
            run, place = [], start
            while place in at:
                end, original = at[place]
                run.append((place, end, original, f"utf-8 as {encoding}"))
                inside.update(range(place, end))
                place = end
            if len(run) > 1 or run[0][1] - run[0][0] == 4:
                runs.append((place - start, -start, run))
    out: list[tuple[int, int, str, str]] = []
    taken: set[int] = set()
    for _, _, run in sorted(runs, key=lambda r: r[:2], reverse=True):
        if run[0][0] not in taken and run[-1][1] - 1 not in taken:
            taken.update(range(run[0][0], run[-1][1]))
            out += run
    return out


_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz" + LETTERS.lower())
_OTHER = re.compile("[^" + "".join(sorted(_PLAIN)) + "]+")


def trigrams(text: str) -> set[str]:
    """The trigrams of ``text`` in lower case that hold one of ``LETTERS``; a run of anything but letters is one space."""
    lowered = _OTHER.sub(" ", f" {text.lower()} ")
    return {t for i in range(len(lowered) - 2) if not (t := lowered[i : i + 3]).isascii()}


def written_trigrams(texts: DataFrame) -> dict[str, int]:
    """In how many values of the one column ``texts`` each trigram stands.

    Counted over all values and combined before the shuffle. The result has a
    bound whatever the size of ``texts``: three letters out of ``_PLAIN``.
    """

    def count(batches):
        for frame in batches:
            counts: Counter = Counter()
            for text in frame.iloc[:, 0]:
                if text and not text.isascii():
                    counts.update(trigrams(text))
                    counts[""] += 1
            yield pd.DataFrame({"trigram": list(counts), "n": list(counts.values())}, columns=["trigram", "n"])

    rows = texts.mapInPandas(count, "trigram string, n long").groupBy("trigram").agg(F.sum("n").alias("n")).where(F.col("n") >= WRITTEN)
    counts = {r.trigram: r.n for r in rows.collect()}
    least = max(WRITTEN, SHARE * counts.pop("", 0))
    return {t: n for t, n in counts.items() if n >= least}


def _around(text: str, i: int, letter: str) -> tuple[str, str] | None:
    """The letters beside ``letter`` at ``i``; null if its case doesn't fit them."""
    left = re.search(r"[^\W\d_]{0,2}$", text[max(0, i - 2) : i])[0]
    right = re.match(r"[^\W\d_]{0,2}", text[i + 1 : i + 3])[0]
    if letter.isupper():
        if left[-1:].islower() or (left and right[:1].islower()):
            return None
    elif right[:1].isupper() or (left[-1:].isupper() and (len(left) == 2 and left.isupper() and not right)):
        return None
    return left, right


def _score(text: str, i: int, letter: str, written) -> int:
    """In how many values all trigrams around ``letter`` at ``i`` are written; 0 if its case doesn't fit its neighbours."""
    beside = _around(text, i, letter)
    if beside is None:
        return 0
    left, right = beside
    around = (left + right).lower()
    if any(c not in _PLAIN for c in around):
        return 0
    word = " " * (len(left) < 2) + left.lower() + letter.lower() + right.lower() + " " * (len(right) < 2)
    return min(written.get(word[k : k + 3], 0) for k in range(len(word) - 2))


def _misread(text: str, free: list[bool], spans: list[tuple[int, int, str]], known, written) -> list[tuple[int, int, str, str]]:
    """``(start, end, original, pair)`` of the sequences of letters that their context shows to be damage.

    A sequence of another script is damage against a Latin letter, unless it
    also stands against a letter of that script. Any sequence is where the
    pair of encodings is ``known`` from this value, or where the trigrams
    around its original are written; of another script, only if the value has
    no further letters beyond Latin.
    """
    met = [(start, end, original, pair) for start, end, original, pair in _met(open_automaton(), text) if all(free[start:end])]
    if not met:
        return []
    # A sign is made of letters only where it was made along with others.
    ends, sides = {start for start, *_ in spans}, {end for _, end, _ in spans}
    met = [m for m in met if m[2].isalpha() or (m[3] in known and (m[0] in sides or m[1] in ends))]
    inside = {i for start, end, *_ in met for i in range(start, end)}
    latin_only = not any(c.isalpha() and c > "\u024f" and i not in inside for i, c in enumerate(text))
    read, places, place, at = [], {}, 0, 0  # the value with every original in place, for the trigrams that run over several
    for start, end, original in sorted([m[:3] for m in met] + spans):
        read.append(text[at:start])
        place += start - at
        places[start] = place
        read.append(original)
        place, at = place + len(original), end
    whole = "".join(read) + text[at:]
    out = []
    for start, end, original, pair in met:
        around = [text[i] for i in (start - 1, end) if 0 <= i < len(text) and text[i].isalpha() and i not in inside]
        latin = any(c <= "\u024f" for c in around)
        other = text[start] > "\u024f"
        if pair in known or (other and latin and all(c <= "\u024f" for c in around)):
            out.append((start, end, original, pair))
        elif (latin_only or not other) and original.lower() in _PLAIN and _score(whole, places[start], original, written):
            out.append((start, end, original, pair))
    return out


def _met(found, text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, original, pair)`` of the matches of an automaton, none over another: the first, of those the longest."""
    every = sorted(((end - len(garbled) + 1, -end - 1, original, pair) for end, (garbled, original, pair) in found.iter(text)), key=lambda m: m[:2])
    out, at = [], 0
    for start, end, original, pair in every:
        if start >= at:
            out.append((start, -end, original, pair))
            at = -end
    return out


_LETTERS = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\x00-\x7FæøåÆØÅ]")
_BRACKETED = re.compile(r"[\w .,&-]*")


def _foreign(text: str, singles: list[tuple[int, str]]) -> set[int]:
    """Which single letters of another script stand in words of that script."""
    asked = [i for i, c in singles if c.isalpha() and c > "\u024f"]
    if not asked:
        return set()
    known, out, k = garbled_letters(), set(), 0
    for word in _LETTERS.finditer(text):
        while k < len(asked) and asked[k] < word.end():
            if k == 0 or asked[k - 1] < word.start():  # counts of the word, once
                beyond = sum(c > "\u024f" for c in word[0])
                strange = sum(c > "\u024f" and c not in known for c in word[0])
            if strange - (text[asked[k]] not in known) > 0 or (len(word[0]) > 1 and beyond == len(word[0])):
                out.add(asked[k])
            k += 1
    return out


def _paired(text: str) -> set[int]:
    """The places of brackets around something, as in ``{B}`` and ``[A]``."""
    out = set()
    for open_ in re.finditer(r"[\[{]", text):
        i = open_.start()
        close = _BRACKETED.match(text, i + 1).end()
        if text[close : close + 1] == ("]" if open_[0] == "[" else "}") and not (i and text[i - 1].isalpha()) and not text[close + 1 : close + 2].isalpha():
            out |= {i, close}
    return out


def _level(text: str, written, first: bool) -> tuple[list[tuple[int, int, str]], bool, bool, Counter]:
    """One level of damage: ``(spans and originals, lost, unexplained, pairs of encodings)``.

    Single characters and lost ones are told of the ``first`` level only, as
    the text was found; below, what is left are sequences.
    """
    spans, lost, pairs = [], False, Counter()
    letters = garbled_letters()
    singles: list[tuple[int, str]] = []
    free = [True] * len(text)

    def take(start: int, end: int, original: str, pair: str):
        spans.append((start, end, original))
        pairs[pair] += 1
        free[start:end] = [False] * (end - start)

    if len(_ODD.findall(text)) > 1:
        for found in _far(text):
            take(*found)
    for start, end, original, pair in _met(automaton(), text):
        if not all(free[start:end]):
            continue
        if original is not None:
            take(start, end, original, pair)
        else:
            singles.append((start, text[start]))
    for found in _misread(text, free, list(spans), pairs, written):
        take(*found)
    if not first:
        return spans, False, False, pairs
    singles = [(i, c) for i, c in singles if free[i]]
    foreign, paired = _foreign(text, singles), _paired(text) if any(c in SEVEN_BIT for _, c in singles) else set()
    short = text.count(" ") < NAME_WORDS
    fitting: list[tuple[int, list[str], bool]] = []
    for i, c in singles:
        before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        opens, closes = not before or before.isspace(), not after or after.isspace()
        if c == "\ufffd":
            lost = True
        elif c == "?":
            inside = before.isalpha() and after.isalpha() and not (before.islower() and after.isupper())
            runs_on = re.match(r" [^\W_A-ZÆØÅ]", text[i + 1 : i + 3]) is not None or (after == " " and short)
            start = after.isalpha() and (opens or before in "(-/«\"")
            if inside or ((start or (runs_on and (before.isalpha() or opens))) and any(_score(text, i, x, written) for x in LETTERS)):
                lost = True
        else:
            alone = not before.isalnum() and not after.isalnum() and (c.isalpha() or (opens and closes))
            if not (before.isalpha() or after.isalpha() or alone) or i in paired or i in foreign:
                continue
            as_is = _score(text, i, c, written) if c.lower() in _PLAIN else 0
            # Whether it is hardly meant where it stands.
            strange = not as_is and c not in SEVEN_BIT and c not in "æøåÆØÅ" and before.isalpha() and after.isalpha()
            fitting.append((i, [x for x in letters[c] if (not alone or c.isalpha() or x in "åÅ") and _score(text, i, x, written) > AS_WRITTEN * as_is], strange))
    # Of several originals that of the pair of encodings that explains most of this value.
    support = Counter(pair for i, found_here, _ in fitting for x in found_here for pair in letters[text[i]][x])
    unexplained = False
    for i, found_here, strange in fitting:
        c = text[i]
        if not found_here and not strange and c not in SEVEN_BIT:
            continue
        if not found_here:  # what else the same pair of encodings made
            beside = text[max(0, i - 1) : i] + text[i + 1 : i + 2]
            found_here = [x for x in letters[c] if any(b.isalpha() for b in beside) and any(support[pair] for pair in letters[c][x]) and _around(text, i, x) is not None]
        if found_here:
            letter = max(found_here, key=lambda x: (max(support[pair] for pair in letters[c][x]), x.isupper() == c.isupper(), -LETTERS.index(x)))
            take(i, i + 1, letter, max(letters[c][letter], key=lambda pair: support[pair]))
        else:
            unexplained |= strange and not (c.isalpha() and c < "\u0250")
    lost = lost or any(0x80 <= ord(c) <= 0x9F and free[i] for i, c in enumerate(text))
    return spans, lost, unexplained, pairs


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, original in sorted(spans):
        out += [text[at:start], original]
        at = end
    return "".join(out) + text[at:]


def repair(text: str | None, written) -> tuple[bool, str | None, bool, list[str]]:
    """``(damaged, restored, complete, pairs of encodings)``.

    ``complete`` is false where characters are lost for good (``?`` or U+FFFD
    in their place), where one that can't be meant, or a control character,
    shows damage that no pair explains, and where the outcome still holds a
    garbled sequence.
    """
    if not text:
        return False, text, True, []
    out, complete, levels = text, True, Counter()
    for level in range(DEPTH + 1):
        spans, lost, unexplained, pairs = _level(out, written, not level)
        if level == 0:
            if not spans and not lost:
                return False, text, True, []
            complete = not lost and not unexplained
        if not spans or level == DEPTH:
            complete &= not spans
            break
        levels.update(pairs.keys())
        out = _replaced(out, spans)
    complete &= not any(0x80 <= ord(c) <= 0x9F for c in out)
    return True, out, complete, sorted(pair + f" {n} times" * (n > 1) for pair, n in levels.items())


def find_damage(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``key, column_name, value, restored, complete, encodings``: one row a damaged value.

    * Null and empty values aren't damaged. Repeated rows come out once a row.
      Values of any length are read whole. An empty table has no damage.
    * ``restored`` has every restorable span replaced; ``complete`` tells
      whether that is all.
    * Values of ASCII and æ, ø and å alone without a suspect sign aren't damaged;
      they leave the JVM for their trigrams only.
    """
    long = None
    for c in columns:
        part = rows.select(F.col(key), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        long = part if long is None else long.unionByName(part)
    written = written_trigrams(long.select("value").where(F.col("value").rlike(r"[^\x00-\x7F]")))
    long = long.where(F.col("value").rlike(r"[^\x00-\x7FæøåÆØÅ]|[\[\]\\{}|?]"))

    @F.pandas_udf(_DAMAGE)
    def damage(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(v, written) for v in values], columns=["damaged", "restored", "complete", "encodings"])

    told = long.withColumn("_damage", damage.asNondeterministic()("value")).where("_damage.damaged")
    return told.select(key, "column_name", "value", F.col("_damage.restored").alias("restored"), F.col("_damage.complete").alias("complete"), F.col("_damage.encodings").alias("encodings"))
