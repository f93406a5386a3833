"""Splitting of oversized texts at natural boundaries, with overlap.

Recursive bisection: a text is cut at the strongest boundary near its middle,
and so are the halves that still exceed the limit less the overlap; then every
piece but the first is extended backwards by the overlap.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarv.llm.tokens import VOCABULARY, encoding, tokenize

#: Boundaries from the strongest to the weakest: before a heading or page
#: break, after a blank line, a line, a sentence, a clause, a word. Lines,
#: clauses and words are told by the characters on either side of a token.
HEADING = re.compile(r"\f|\n(?=#{1,6} )|\n[ \t]*\n(?=[^\n]{1,80}\n[ \t]*\n)")
BLANK = re.compile(r"\n[ \t]*(?:\n[ \t]*)+")
SENTENCE = re.compile(r"[.!?…][\"'»”’)\]]*(?=\s)")
CLAUSE_ENDS = np.array([ord(c) for c in ";:,–—"], dtype=np.uint32)
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
#: The part of a segment, around its middle, in which a cut is looked for.
NEAR = 0.5

_PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("length", T.IntegerType()),
            T.StructField("shared_tokens", T.IntegerType()),
            T.StructField("tokens", T.IntegerType()),
        ]
    )
)


def _token_starts(text: str, ids: np.ndarray, vocabulary: str) -> np.ndarray:
    """The character at which each token starts, and the end; -1 inside a character."""
    ends = np.cumsum(encoding(vocabulary)[1][ids])
    starts = np.concatenate(([0], ends))
    if text.isascii():
        return starts
    lead = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
    place = np.append(np.where(lead, np.cumsum(lead) - 1, -1), len(text))
    return place[starts]


def _levels(text: str, starts: np.ndarray) -> np.ndarray:
    """The strength of the boundary before each token; 0 where there is none, -1 where no cut is possible."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass") + b" \0\0\0", dtype=np.uint32)
    place = np.maximum(starts, 0)
    before = codes[np.maximum(place - 1, 0)]
    word = np.isin(codes[place], SPACES) & ~np.isin(before, SPACES)
    level = word.astype(np.int8)
    level[word & np.isin(before, CLAUSE_ENDS)] = 2
    strong = np.zeros(len(codes), dtype=np.int8)
    for strength, pattern in ((3, SENTENCE), (5, BLANK), (6, HEADING)):
        strong[[m.end() for m in pattern.finditer(text)]] = strength
    level = np.maximum(level, np.where(before == 10, np.int8(4), np.int8(0)))
    return np.where(starts >= 0, np.maximum(level, strong[place]), -1)


def pieces(text: str | None, limit: int = 2048, overlap: int = 128, vocabulary: str = VOCABULARY) -> list[tuple[int, int, int, int]]:
    """``(start, length, shared_tokens, tokens)`` of each piece, in characters.

    A text within the limit is one piece, a null or empty one none. Without
    its overlap the pieces follow one another without gap.
    """
    if not text:
        return []
    ids = tokenize(text, vocabulary)
    n = len(ids)
    if n <= limit:
        return [(0, len(text), 0, n)]
    starts = _token_starts(text, ids, vocabulary)
    levels = _levels(text, starts)
    most = max(1, limit - overlap - 3)  # 3: an overlap begins with a whole character
    leaves, todo = [], [(0, n)]
    while todo:
        i, j = todo.pop()
        if j - i <= most:
            leaves.append(i)
            continue
        middle, reach = (i + j) // 2, max(1, int((j - i) * NEAR / 2))
        low, high = max(i + 1, middle - reach), min(j, middle + reach + 1)
        near = levels[low:high]
        best = near.max()
        if best < 0:  # no whole character begins near the middle
            low, high = i + 1, j
            near = levels[low:high]
            best = near.max() if len(near) else -1
            if best < 0:
                leaves.append(i)
                continue
        cuts = np.flatnonzero(near == best) + low
        cut = int(cuts[np.abs(cuts - middle).argmin()])
        todo += [(cut, j), (i, cut)]
    out = []
    for k, i in enumerate(leaves):
        j = leaves[k + 1] if k + 1 < len(leaves) else n
        b = max(0, i - overlap) if k else i
        while starts[b] < 0:
            b -= 1
        out.append((int(starts[b]), int(starts[j] - starts[b]), i - b, j - b))
    return out


def split(documents: DataFrame, text: str = "text", limit: int = 2048, overlap: int = 128, vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` with one row a piece: ``piece_no, n_pieces, piece_start, piece_length, shared_tokens, piece_tokens, piece_text``.

    * ``piece_no`` counts from 1, ``piece_start`` in characters from 0; the
      first ``shared_tokens`` tokens repeat the end of the piece before.
    * A null or empty text has no pieces. Repeated documents are split alike,
      one by one; there is no shuffle. Other columns stay as they are, but for
      those named as above, which are replaced.
    * A text of no more than ``limit`` UTF-8 bytes can't have more tokens, so
      it passes by in the JVM; its ``piece_tokens`` is null.
    """

    @F.pandas_udf(_PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces(t, limit, overlap, vocabulary) for t in texts])

    kept = [c for c in documents.columns if c not in ("piece_no", "n_pieces", "piece_start", "piece_length", "shared_tokens", "piece_tokens", "piece_text")]
    whole = F.octet_length(F.col(text)) <= limit
    long = documents.select(*kept).where(~whole).withColumn("__pieces", cut.asNondeterministic()(F.col(text)))  # lest a filter behind it cut twice
    long = long.select(*kept, F.size("__pieces").alias("n_pieces"), F.posexplode("__pieces").alias("__at", "__piece"))
    long = long.select(
        *kept, (F.col("__at") + 1).alias("piece_no"), "n_pieces", F.col("__piece.start").alias("piece_start"), F.col("__piece.length").alias("piece_length"), F.col("__piece.shared_tokens").alias("shared_tokens"), F.col("__piece.tokens").alias("piece_tokens"),
        F.substring(F.col(text), F.col("__piece.start") + 1, F.col("__piece.length")).alias("piece_text"),
    )
    short = documents.select(*kept).where(whole & (F.length(F.col(text)) > 0))
    short = short.select(*kept, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_start"), F.length(F.col(text)).alias("piece_length"), F.lit(0).alias("shared_tokens"), F.lit(None).cast("int").alias("piece_tokens"), F.col(text).alias("piece_text"))
    return long.unionByName(short)


def oversized(documents: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The keys of the documents that came out in more than one piece."""
    return split(documents, **options).where("piece_no = 1 and n_pieces > 1").select(key)
