"""JSON brought to one spelling, so that equal values have equal text.

Two values are the same if they are the same JSON, whatever the order of
object keys and list members, white space, escapes, and 1 or 1.0.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MISSING = object()


def _text(node) -> str:
    if isinstance(node, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_text(v)}" for k, v in sorted(node.items())) + "}"
    if isinstance(node, list):
        return "[" + ",".join(sorted(map(_text, node))) + "]"
    if isinstance(node, float) and node == node and abs(node) < 1e15 and node == int(node):
        return str(int(node))
    return json.dumps(node, ensure_ascii=False)


def canonical_json(text: str | None) -> str | None:
    """Null stays null; text that isn't JSON stands for itself, marked so that it equals no JSON."""
    if text is None:
        return None
    try:
        return _text(json.loads(text))
    except (ValueError, RecursionError):
        return "!" + text.strip()


def _mapped(values: pd.Series, make) -> pd.Series:
    known: dict = {}
    out = []
    for value in values:
        if value is None or value != value:
            out.append(None)
            continue
        made = known.get(value, _MISSING)
        if made is _MISSING:
            if len(known) > 100_000:
                known.clear()
            made = known[value] = make(value)
        out.append(made)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def canonical(values: pd.Series) -> pd.Series:
    return _mapped(values, canonical_json)


#: The same where a filter on the result follows, which would else compute it twice.
canonical_once = F.pandas_udf(T.StringType())(canonical.func).asNondeterministic()


@F.pandas_udf(T.BinaryType())
def value_hash(values: pd.Series) -> pd.Series:
    """The first 16 bytes of SHA-256 over the canonical text."""
    return _mapped(values, lambda v: hashlib.sha256(canonical_json(v).encode("utf-8", "surrogatepass")).digest()[:16])


def canonical_sql(value: str, depth: int = 4) -> str:
    """The same for DuckDB, for JSON nested at most ``depth`` deep."""
    if depth == 0:
        return f"CAST({value} AS VARCHAR)"
    k, x = f"k{depth}", f"x{depth}"
    member = canonical_sql(f"json_extract({value}, '$.\"' || {k} || '\"')", depth - 1)
    item = canonical_sql(x, depth - 1)
    return (
        f"CASE json_type({value}) WHEN 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(json_keys({value})), lambda {k}: '\"' || {k} || '\":' || {member}), ',') || '}}' "
        f"WHEN 'ARRAY' THEN '[' || array_to_string(list_sort(list_transform(CAST({value} AS JSON[]), lambda {x}: {item})), ',') || ']' "
        f"WHEN 'VARCHAR' THEN '\"' || json_extract_string({value}, '$') || '\"' ELSE CAST({value} AS VARCHAR) END"
    )
