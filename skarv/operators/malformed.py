"""Rows that fail to parse, apart from the valid ones and with the reason.

Raw records are read permissively under an explicit schema that keeps the raw
text of those it can't hold; these are then reclassified by quoting, count and
cast checks. Nothing is dropped and nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarv.functions.ids import mod11_valid, only_digits

#: The names a field has in the registry's and in English headers.
NAMES = {
    "organisation_number": ("organisation_number", "organisasjonsnummer"),
    "employees": ("employees", "antallAnsatte"),
    "founded_date": ("founded_date", "stiftelsesdato"),
    "bankrupt": ("bankrupt", "konkurs"),
}
#: The reasons, in the order in which they apply.
REASONS = ("broken_quoting", "broken_json", "wrong_column_count", "invalid_organisation_number", "invalid_value")
STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
JSON_SCHEMA = ", ".join(f"`{n}` string" for names in NAMES.values() for n in names)
DELIMITERS = (";", ",", "\t")
SALTS = 32


def _field(delimiter: str) -> str:
    """One csv field; possessive throughout, so that Java neither backtracks nor recurses on long records."""
    return f'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{delimiter}]*+)'


def _quoted_well(raw: Column, delimiter: str) -> Column:
    return raw.rlike(rf"\A{_field(delimiter)}(?:{delimiter}{_field(delimiter)})*+\z")


def _fields(raw: Column, delimiter: str) -> Column:
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), raw), F.lit(f"{delimiter}({_field(delimiter)})"), F.lit(1))
    return F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def _by_delimiter(delimiter: Column, make) -> Column:
    out = F.when(delimiter == DELIMITERS[0], make(DELIMITERS[0]))
    for d in DELIMITERS[1:]:
        out = out.when(delimiter == d, make(d))
    return out


def one_json_value(raw: Column) -> Column:
    """``raw`` as an array of the one JSON value it is, as text; null if it isn't one.

    Spark's parser ignores what follows a value. Nothing can follow it both in
    a list and in an object, so ``raw`` has to be read in either.
    """
    listed = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>", STRICT)
    kept = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string, _corrupt_record string", STRICT)
    return F.when((F.size(listed) == 1) & kept.isNotNull() & kept.getField("_corrupt_record").isNull(), listed)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns``, each computed once a row.

    Neighbouring projections are merged, and an expression used five times
    would then be computed five times; they aren't merged across a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _headers(rows: DataFrame) -> DataFrame:
    """One row a csv batch: its delimiter, number of columns and the position of each known field."""
    first = rows.where((F.col("fmt") == "csv") & (F.col("input_position") == 0)).groupBy("batch_id").agg(F.min_by("raw", "row_id").alias("_head"))
    head = F.regexp_replace(F.coalesce("_head", F.lit("")), "^﻿", "")
    many = [F.length(head) - F.length(F.replace(head, F.lit(d))) for d in DELIMITERS]
    best = F.greatest(*many)
    first = first.select(F.col("batch_id").alias("_batch"), head.alias("_head"), F.when(many[0] == best, DELIMITERS[0]).when(many[1] == best, DELIMITERS[1]).otherwise(DELIMITERS[2]).alias("_delimiter"))
    names = F.transform(_by_delimiter(F.col("_delimiter"), lambda d: _fields(F.col("_head"), d)), lambda x: F.lower(F.trim(x)))
    first = first.select("_batch", "_delimiter", names.alias("_names"))
    place = [F.coalesce(*(F.nullif(F.array_position("_names", n.lower()), F.lit(0)) for n in names)).cast("int").alias(f"_at_{f}") for f, names in NAMES.items()]
    return first.select("_batch", "_delimiter", F.size("_names").alias("_columns"), *place)


def read_permissively(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_organisation_number, _employees, _founded_date, _bankrupt`` as text and the structural flags.

    ``_corrupt`` keeps the raw text of a record that the schema can't hold: a
    csv record whose quoting or number of columns is off, or a jsonl record
    that isn't one JSON value; its fields are null.
    """
    rows = rows.select(*joined_columns(rows))
    heads = _headers(rows).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    is_csv = F.col("fmt") == "csv"
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(heads, is_csv & (F.col("batch_id") == F.col("_batch")) & (salted["_salt"] == heads["_salt"]), "left").drop(heads["_salt"])

    raw = F.coalesce(F.col("raw"), F.lit(""))
    raw = F.when(F.col("input_position") == 0, F.regexp_replace(raw, "^﻿", "")).otherwise(raw)
    delimiter = F.coalesce(F.col("_delimiter"), F.lit(DELIMITERS[0]))
    joined = _once(joined, _raw=raw)
    joined = _once(joined, _bad_quoting=is_csv & ~_by_delimiter(delimiter, lambda d: _quoted_well(F.col("_raw"), d)), _json=F.when(F.col("fmt") == "jsonl", one_json_value(F.col("_raw"))))
    csv = F.when(is_csv & ~F.col("_bad_quoting"), _by_delimiter(delimiter, lambda d: _fields(F.col("_raw"), d)))
    shape = F.substring(F.ltrim("_raw"), 1, 1)
    parsed = _once(joined, _fields=csv, _object=F.when(shape == "{", F.from_json(F.get("_json", F.lit(0)), JSON_SCHEMA, STRICT)))
    bare = F.when(shape == "[", F.lit("")).otherwise(F.get("_json", F.lit(0)))

    def value(field: str) -> Column:
        own, norwegian = NAMES[field]
        from_json = F.coalesce(F.col(f"_object.{own}"), F.col(f"_object.{norwegian}"))
        from_csv = F.get(F.col("_fields"), F.col(f"_at_{field}") - 1)
        alone = F.when(F.col("fmt") == "jsonl", bare).otherwise(F.col("_raw")) if field == "organisation_number" else F.lit(None).cast("string")
        return F.when(is_csv, from_csv).when(F.col("_object").isNotNull(), from_json).otherwise(alone)

    parsed = parsed.withColumn("_bad_json", (F.col("fmt") == "jsonl") & F.col("_json").isNull())
    parsed = parsed.withColumn("_bad_count", is_csv & ~F.col("_bad_quoting") & ~F.size("_fields").eqNullSafe(F.col("_columns")))
    read = _once(parsed, **{f"_{f}": value(f) for f in NAMES})
    corrupt = F.when(F.col("_bad_quoting") | F.col("_bad_json") | F.col("_bad_count"), F.col("raw"))
    return read.select(*joined_columns(rows), "_bad_quoting", "_bad_json", "_bad_count", *(f"_{f}" for f in NAMES), corrupt.alias("_corrupt"))


def joined_columns(rows: DataFrame) -> list[str]:
    return [c for c in ("row_id", "batch_id", "input_position", "fmt", "raw", "received_at") if c in rows.columns]


def classify(rows: DataFrame) -> DataFrame:
    """``row_id, batch_id, input_position, fmt, raw, received_at, organisation_number, errors, reason``; headers aside.

    * ``reason`` is null for a record that loads; then ``organisation_number``
      holds its nine digits and ``errors`` is ``[]``. Otherwise
      ``organisation_number`` is null and ``errors`` a JSON list with the reason.
    * The first reason of ``REASONS`` that applies counts. Empty and missing
      optional values are fine, and so are repeated numbers and rows.
    * A null ``raw`` is an empty record. A csv batch without header has no
      number of columns, so all its records have a wrong one. A format other
      than csv and jsonl is read as txt.
    * What an earlier load left in ``organisation_number`` and ``errors`` is
      ignored, and so is any further column.

    Rows meet their batch's header by a join salted ``SALTS`` ways, so one
    batch may hold a third of all rows. All checks run in the JVM.
    """
    read = read_permissively(rows)
    number, given = only_digits(F.col("_organisation_number")), lambda f: F.coalesce(F.col(f), F.lit("")) != ""
    day = F.col("_founded_date")
    wrong = (
        (given("_employees") & ~F.col("_employees").rlike(r"\A[0-9]+\z"))
        | (given("_founded_date") & ~(day.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & day.try_cast("date").isNotNull() & ~day.startswith("0000")))
        | (given("_bankrupt") & ~F.lower("_bankrupt").isin("true", "false"))
    )
    reason = (
        F.when(F.col("_bad_quoting"), REASONS[0])
        .when(F.col("_bad_json"), REASONS[1])
        .when(F.col("_bad_count"), REASONS[2])
        .when(~mod11_valid(F.coalesce(number, F.lit(""))), REASONS[3])
        .when(wrong, REASONS[4])
    )
    out = read.where(~((F.col("fmt") == "csv") & (F.col("input_position") == 0)) | F.col("fmt").isNull() | F.col("input_position").isNull())
    out = _once(out, reason=reason).withColumn("organisation_number", F.when(F.col("reason").isNull(), number))
    out = out.withColumn("errors", F.when(F.col("reason").isNull(), "[]").otherwise(F.concat(F.lit('[{"code":"'), F.col("reason"), F.lit('","stage":"input"}]'))))
    return out.select(*joined_columns(rows), "organisation_number", "errors", "reason")


def failed(rows: DataFrame) -> DataFrame:
    return classify(rows).where("reason is not null")


def loaded(rows: DataFrame) -> DataFrame:
    return classify(rows).where("reason is null").drop("reason")
