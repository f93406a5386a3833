"""Query and SQL side by side, compared as the driver does: columns by name, rows without order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_cell, v))
    if isinstance(v, dict):
        return tuple((k, _cell(x)) for k, x in v.items())
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def differences(spark_df, con, sql: str) -> list[str]:
    got = spark_df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} and {sorted(names)}"]
    order = sorted(names)
    want = Counter(tuple(_cell(r[names.index(c)]) for c in order) for r in cur.fetchall())
    have = Counter(tuple(_cell(r[c]) for c in order) for r in got)
    return [f"only SQL: {r}" for r in list((want - have).elements())[:5]] + [f"only Spark: {r}" for r in list((have - want).elements())[:5]]
