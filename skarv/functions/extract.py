"""Values taken out of nested documents and running text."""

from __future__ import annotations

import difflib
import json
from urllib.parse import quote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def leaves(text: str | None) -> list[tuple[str, str, str | None]]:
    """``(path, kind, value)`` of every scalar of a JSON document, in its order; none if it isn't JSON."""
    try:
        todo, out = [("", json.loads(text))] if text else [], []
    except (ValueError, RecursionError):
        return []
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict):
            todo += [(f"{path}/{k}", v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            todo += [(f"{path}/{i}", v) for i, v in reversed(list(enumerate(node)))]
        else:
            kind = "null" if node is None else "boolean" if isinstance(node, bool) else "number" if isinstance(node, (int, float)) else "text"
            out.append((path or "/", kind, None if node is None else node if kind == "text" else json.dumps(node)))
    return out


@F.pandas_udf(_LEAVES)
def json_leaves(texts: pd.Series) -> pd.Series:
    return pd.Series([leaves(t) for t in texts])


json_leaves = json_leaves.asNondeterministic()  # lest an explosion of it compute it twice


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters by the length of both, matching blocks found longest first; null for a null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def _ascii(url: str | None) -> str | None:
    if url is None:
        return None
    try:
        parts = urlsplit(url.strip())
        name = parts.hostname.encode("idna").decode() if parts.hostname else ""
        port = f":{parts.port}" if parts.port else ""
        return urlunsplit((parts.scheme, name + port, quote(parts.path, safe="/%:@!$&'()*+,;=~-._"), quote(parts.query, safe="/%:@!$&'()*+,;=~-._?"), ""))
    except (ValueError, UnicodeError):
        return None


@F.pandas_udf(T.StringType())
def ascii_url(urls: pd.Series) -> pd.Series:
    """The address in ASCII: the host by IDNA, the rest percent-encoded, no fragment; null if it can't be."""
    return pd.Series([_ascii(u) for u in urls], dtype=object)


def fenced_json(text: Column) -> Column:
    """The JSON object of an answer that is one, or holds one between code fences; null otherwise."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    candidate = F.trim(F.when(inner != "", inner).otherwise(text))
    return F.when(candidate.startswith("{") & F.try_parse_json(candidate).isNotNull(), candidate)


def plain_number(text: Column) -> Column:
    """A number written with spaces, points or commas between thousands; null if it isn't one."""
    squeezed = F.regexp_replace(text, r"(?<=[0-9])[ .,  ](?=[0-9]{3}(?![0-9]))", "")
    return F.regexp_extract(F.replace(squeezed, F.lit(","), F.lit(".")), r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$", 1).try_cast("double")


def by_priority(text: Column, patterns: list[str], unless: str | None = None) -> Column:
    """What the first pattern that matches captures; null where its matches differ.

    ``patterns`` stand in order of trust, each with one group. Lines that match
    ``unless`` aren't read.
    """
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    kept = F.array_join(F.filter(lines, lambda x: ~x.rlike(unless)) if unless else lines, "\n")
    found = [F.array_distinct(F.regexp_extract_all(kept, F.lit(p), F.lit(1))) for p in patterns]
    out = F.when(F.size(found[0]) > 0, F.when(F.size(found[0]) == 1, F.get(found[0], F.lit(0))))
    for hits in found[1:]:
        out = out.when(F.size(hits) > 0, F.when(F.size(hits) == 1, F.get(hits, F.lit(0))))
    return out
