"""Queries of the general evidence problems (2, 4 and 5), each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarv.functions.canon import canonical_sql
from skarv.operators import history, malformed, snapshots
from skarv.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_as_delivered(table(spark, sf_dir, "evidence")).drop("value")


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions with their values, in canonical JSON."""
    return history.history_as_delivered(table(spark, sf_dir, "evidence"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, sf_dir, "bulk_evidence"))


def p4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that came, went or changed, by field and snapshot."""
    return p4_found(spark, sf_dir).groupBy("field", "snapshot", "change").agg(F.count("*").alias("records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.failed(table(spark, sf_dir, "input_rows")).select("row_id", "reason")


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.loaded(table(spark, sf_dir, "input_rows")).select("row_id", "organisation_number", "errors")


QUERIES = {"p2_found": p2_found, "p2_history": p2_history, "p4_found": p4_found, "p4_summary": p4_summary, "p5_found": p5_found, "p5_loaded": p5_loaded}

_DAY = r"(CASE WHEN regexp_matches(trim({0}), '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN TRY_CAST(trim({0}) AS DATE) WHEN regexp_matches(trim({0}), '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}.*(Z|[+-]\d{{2}}:?\d{{2}})$') THEN CAST(timezone('UTC', TRY_CAST(trim({0}) AS TIMESTAMPTZ)) AS DATE) WHEN regexp_matches(trim({0}), '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}') THEN CAST(TRY_CAST(trim({0}) AS TIMESTAMP) AS DATE) END)"
_EUROPEAN = r"CAST(try_strptime(trim({0}), '%d.%m.%Y') AS DATE)"

_HISTORY = f"""
WITH speaking AS (
  SELECT row_id, source_row_key, field, retrieved_at,
    CASE WHEN status = 'available' THEN {canonical_sql("CAST(coalesce(value, 'null') AS JSON)")} END AS value,
    coalesce({_DAY.format("effective_at")}, {_DAY.format("as_of")}, {_EUROPEAN.format("as_of")}, CAST(retrieved_at AS DATE)) AS day
  FROM evidence WHERE status IN ('available', 'not_found') AND source_row_key IS NOT NULL AND field IS NOT NULL),
held AS (SELECT * FROM speaking WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_row_key, field, day ORDER BY retrieved_at DESC, row_id DESC) = 1),
turns AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY source_row_key, field ORDER BY day) = 1 OR value IS DISTINCT FROM lag(value) OVER (PARTITION BY source_row_key, field ORDER BY day)),
ended AS (SELECT *, lead(day) OVER (PARTITION BY source_row_key, field ORDER BY day) AS until FROM turns)
SELECT source_row_key, field, <VALUE> strftime(day, '%Y-%m-%d') AS valid_from, coalesce(strftime(until, '%Y-%m-%d'), '') AS valid_to
FROM ended WHERE value IS NOT NULL"""

_CHANGES = f"""
WITH told AS (
  SELECT row_id, regexp_replace(source_row_key, '[^0-9]', '', 'g') AS k, field, retrieved_at, coalesce({_DAY.format("as_of")}, {_EUROPEAN.format("as_of")}) AS day,
    CASE WHEN status = 'available' THEN coalesce({canonical_sql("CAST(value AS JSON)")}, 'none') END AS v
  FROM bulk_evidence WHERE field IS NOT NULL),
held AS (SELECT * FROM told WHERE length(k) = 9 AND day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, field, day ORDER BY retrieved_at DESC NULLS LAST, row_id DESC NULLS LAST) = 1),
days AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM told WHERE day IS NOT NULL)),
pairs AS (
  SELECT coalesce(a.k, b.k) AS k, coalesce(a.field, b.field) AS field, coalesce(b.day, c.day) AS day, a.k IS NOT NULL AS old, b.k IS NOT NULL AS new, a.v AS was, b.v AS now
  FROM (SELECT h.*, n FROM held h JOIN days USING (day)) a FULL JOIN (SELECT h.*, n FROM held h JOIN days USING (day)) b ON a.k = b.k AND a.field = b.field AND a.n = b.n - 1
  LEFT JOIN days c ON c.n = a.n + 1
  WHERE b.n IS NULL OR b.n > 1)
SELECT k AS source_row_key, field, strftime(day, '%Y-%m-%d') AS snapshot, CASE WHEN NOT old THEN 'added' WHEN NOT new THEN 'removed' ELSE 'changed' END AS change
FROM pairs WHERE day IS NOT NULL AND (NOT old OR NOT new OR was <> now)"""


def _csv(delimiter: str, pattern: str) -> str:
    return pattern.replace("<D>", delimiter)


_WELL = r'''^(?:"(?:[^"]|"")*"|[^"<D>]*)(?:<D>(?:"(?:[^"]|"")*"|[^"<D>]*))*$'''
_ONE = r'''<D>("(?:[^"]|"")*"|[^"<D>]*)'''


def _per_delimiter(make) -> str:
    return "CASE d WHEN ';' THEN " + make(";") + " WHEN ',' THEN " + make(",") + " ELSE " + make("\\t") + " END"


def _cells(raw: str) -> str:
    return _per_delimiter(lambda d: f"regexp_extract_all(concat(d, {raw}), '{_csv(d, _ONE)}', 1, 's')")


def _cell(name: str, *names: str) -> str:
    at = "coalesce(" + ", ".join(f"list_position(names, '{n.lower()}')" for n in names) + ")"
    text = f"cells[{at}]"
    csv = f"CASE WHEN starts_with({text}, '\"') THEN replace(substring({text}, 2, length({text}) - 2), '\"\"', '\"') ELSE {text} END"
    js = "coalesce(" + ", ".join(f"json_extract_string(j, '$.{n}')" for n in names) + ")"
    return f"CASE WHEN fmt = 'csv' THEN {csv} WHEN json_type(j) = 'OBJECT' THEN {js} END AS {name}"


_INPUT = rf"""
WITH heads AS (
  SELECT batch_id AS b, ltrim(arg_min(raw, row_id), chr(65279)) AS head FROM input_rows WHERE fmt = 'csv' AND input_position = 0 GROUP BY ALL),
signs AS (SELECT *, CASE WHEN len(string_split(head, ';')) >= greatest(len(string_split(head, ',')), len(string_split(head, chr(9)))) THEN ';' WHEN len(string_split(head, ',')) >= len(string_split(head, chr(9))) THEN ',' ELSE chr(9) END AS d FROM heads),
named AS (SELECT b, d, list_transform({_cells("head")}, lambda x: lower(trim(trim(x, '"')))) AS names FROM signs),
raws AS (SELECT row_id, fmt, input_position, coalesce(CASE WHEN input_position = 0 THEN ltrim(raw, chr(65279)) ELSE raw END, '') AS raw, d, names FROM input_rows LEFT JOIN named ON fmt = 'csv' AND batch_id = b
  WHERE NOT (fmt = 'csv' AND input_position = 0)),
cut AS (SELECT *, fmt = 'csv' AND NOT ({_per_delimiter(lambda d: f"regexp_matches(raw, '{_csv(d, _WELL)}', 's')")}) AS bad_quoting,
  CASE WHEN fmt = 'csv' THEN {_cells("raw")} END AS cells, CASE WHEN fmt = 'jsonl' AND json_valid(raw) AND NOT regexp_matches(raw, ',\s*[}}\]]\s*$') THEN CAST(raw AS JSON) END AS j FROM raws),
got AS (SELECT *, {_cell("o", "organisation_number", "organisasjonsnummer")}, {_cell("e", "employees", "antallAnsatte")}, {_cell("f", "founded_date", "stiftelsesdato")}, {_cell("k", "bankrupt", "konkurs")} FROM cut),
digits AS (SELECT *, regexp_replace(coalesce(CASE WHEN fmt = 'csv' OR json_type(j) = 'OBJECT' THEN o WHEN fmt = 'jsonl' THEN CASE WHEN json_type(j) <> 'ARRAY' THEN json_extract_string(j, '$') END ELSE raw END, ''), '[^0-9]', '', 'g') AS n FROM got),
summed AS (SELECT *, CASE WHEN length(n) = 9 THEN {" + ".join(f"{w} * CAST(n[{i + 1}] AS INT)" for i, w in enumerate((3, 2, 7, 6, 5, 4, 3, 2)))} END % 11 AS r FROM digits),
told AS (SELECT row_id, n, CASE WHEN bad_quoting THEN 'broken_quoting' WHEN fmt = 'jsonl' AND j IS NULL THEN 'broken_json' WHEN fmt = 'csv' AND len(cells) IS DISTINCT FROM len(names) THEN 'wrong_column_count'
  WHEN length(n) <> 9 OR (CASE WHEN r = 0 THEN 0 ELSE 11 - r END) <> CAST(n[9] AS INT) THEN 'invalid_organisation_number'
  WHEN (coalesce(e, '') <> '' AND NOT regexp_full_match(e, '[0-9]+')) OR (coalesce(f, '') <> '' AND (NOT regexp_full_match(f, '\d{{4}}-\d{{2}}-\d{{2}}') OR TRY_CAST(f AS DATE) IS NULL)) OR (coalesce(k, '') <> '' AND lower(k) NOT IN ('true', 'false')) THEN 'invalid_value' END AS reason FROM summed)
"""



def malformed_sql() -> str:
    """The common table ``told(row_id, n, reason)`` of the raw records, to be continued."""
    return _INPUT.rstrip()


SQL = {
    "p2_found": _HISTORY.replace("<VALUE>", ""),
    "p2_history": _HISTORY.replace("<VALUE>", "value,"),
    "p4_found": _CHANGES,
    "p4_summary": f"SELECT field, snapshot, change, count(*) AS records FROM ({_CHANGES}) GROUP BY ALL",
    "p5_found": _INPUT + "SELECT row_id, reason FROM told WHERE reason IS NOT NULL",
    "p5_loaded": _INPUT + "SELECT row_id, n AS organisation_number, '[]' AS errors FROM told WHERE reason IS NULL",
}
