"""Sources: registry deliveries, tolerant input lists, JSON lines and captured responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarv.functions.ids import mod11_valid, only_digits
from skarv.operators.malformed import one_json_value

#: The names a registry field has in the two headers it comes with.
REGISTRY_NAMES = {
    "organisation_number": ("organisasjonsnummer", "Organisasjonsnummer"),
    "name": ("navn", "Navn"),
    "legal_form": ("organisasjonsform.kode", "Organisasjonsform"),
    "employees": ("antallAnsatte", "Antall ansatte"),
    "website": ("hjemmeside", "Hjemmeside"),
    "municipality": ("forretningsadresse.kommune", "Kommune"),
    "industry": ("naeringskode1.kode", "Næringskode 1"),
    "bankrupt": ("konkurs", "Konkurs"),
    "latest_accounts": ("sisteInnsendteAarsregnskap", "Siste innsendte årsregnskap"),
}


def is_gzip(spark: SparkSession, path: str) -> bool:
    """Whether a file is compressed whatever its name says: by its first two bytes."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.open(hadoop)
    try:
        return (stream.read(), stream.read()) == (0x1F, 0x8B)
    finally:
        stream.close()


def delimiter_of(header: str) -> str:
    return max((";", ",", "\t"), key=header.count)


def _header(spark: SparkSession, path: str) -> str:
    """The first line, of compressed files too, without byte order mark."""
    if not is_gzip(spark, path):
        return spark.read.text(path).limit(1).collect()[0][0].lstrip("\ufeff")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark._jvm.java.util.zip.GZIPInputStream(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(hadoop))
    try:
        return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine().lstrip("\ufeff")
    finally:
        stream.close()


def read_delivery(spark: SparkSession, path: str) -> DataFrame:
    """A registry delivery in csv, all columns as text: plain or gzip, with or without byte order mark.

    What a row is doesn't hang on how the file is packed or named: a quoted
    field may hold line breaks in all of them. A file that is compressed but
    not named so is unpacked as a stream, row by row; all others go through
    the csv source. A compressed file is the work of one task, as its format
    can't be read from the middle.
    """
    header = _header(spark, path)
    delimiter = delimiter_of(header)
    names = [n.strip().strip('"') for n in header.split(delimiter)]
    schema = ", ".join(f"`{n}` string" for n in names)
    if not is_gzip(spark, path) or path.endswith(".gz"):
        return spark.read.schema(schema).csv(path, header=True, sep=delimiter, escape='"', multiLine=True, enforceSchema=True)

    def unpack(batches):
        import csv
        import gzip
        import io
        from itertools import islice

        import pandas as pd

        for frame in batches:
            for content in frame["content"]:
                rows = csv.reader(io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(content)), "utf-8-sig", newline=""), delimiter=delimiter)
                next(rows, None)
                while part := list(islice(rows, 10_000)):
                    cut = [[c if c != "" else None for c in (row + [None] * len(names))[: len(names)]] for row in part if row]
                    yield pd.DataFrame(cut, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, schema)


def given(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def normalised_registry(rows: DataFrame) -> DataFrame:
    """Registry rows under one set of names and types, whichever header they came with; nine-character numbers only.

    A number of employees that isn't one is null, never 0; a flag is true only
    where it says so.
    """
    have = set(rows.columns)
    column = lambda field: given(*[F.col(f"`{n}`").cast("string") for n in REGISTRY_NAMES[field] if n in have] or [F.lit(None).cast("string")])
    out = rows.select(
        *(column(f).alias(f) for f in ("organisation_number", "name", "legal_form", "website", "municipality", "industry", "latest_accounts")),
        column("employees").try_cast("int").alias("employees"), F.coalesce(F.lower(column("bankrupt")) == "true", F.lit(False)).alias("bankrupt"),
    )
    return out.where(F.length("organisation_number") == 9)


def input_lines(spark: SparkSession, path: str) -> DataFrame:
    """``position, raw`` of a text or JSON lines file, blank lines left out."""
    files = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("position", "raw"))
    return files.where(F.trim("raw") != "")


def json_inputs(spark: SparkSession, path: str) -> DataFrame:
    """``position, raw`` of a JSON file that is a list, or an object with a list of ``organisation_numbers``; numbers, texts and objects are members alike."""
    whole = spark.read.text(path, wholetext=True)
    named = F.coalesce(F.get_json_object("value", "$.organisation_numbers"), F.get_json_object("value", "$"))
    return whole.select(F.posexplode(F.from_json(named, "array<string>")).alias("position", "raw"))


def tolerant_inputs(lines: DataFrame) -> DataFrame:
    """``position, raw, organisation_number, errors`` of a list of organisation numbers, one row an input line.

    A line is a number, a JSON string or an object with the number under its
    English or Norwegian name; what isn't JSON is text. ``errors`` has
    ``invalid_organisation_number`` (not nine digits), ``checksum_mismatch``
    and ``duplicate_input`` with the position of the first line for the
    number. No line is dropped and none raises.
    """
    named = F.coalesce(F.get_json_object("raw", "$.organisation_number"), F.get_json_object("raw", "$.organisasjonsnummer"))
    read = F.coalesce(F.when(one_json_value(F.col("raw")).isNotNull(), named), F.col("raw"))
    rows = lines.select("position", "raw", only_digits(read).alias("_digits"))
    number = F.when(F.length("_digits") == 9, F.col("_digits"))
    rows = rows.select("position", "raw", number.alias("organisation_number"))
    firsts = rows.where("organisation_number is not null").groupBy("organisation_number").agg(F.min("position").alias("_first"))
    rows = rows.join(firsts, "organisation_number", "left")
    error = lambda test, code, detail: F.when(test, F.struct(F.lit(code).alias("code"), detail.cast("string").alias("detail")))
    none = F.lit(None)
    errors = F.array_compact(
        F.array(
            error(F.col("organisation_number").isNull(), "invalid_organisation_number", none),
            error(F.col("organisation_number").isNotNull() & ~mod11_valid(F.col("organisation_number")), "checksum_mismatch", none),
            error(F.col("_first") < F.col("position"), "duplicate_input", F.col("_first")),
        )
    )
    return rows.select("position", "raw", "organisation_number", errors.alias("errors"))


def strict_inputs(lines: DataFrame) -> DataFrame:
    """``organisation_number`` of a list in which any error fails the job with its code."""
    rows = tolerant_inputs(lines)
    checked = F.when(F.size("errors") > 0, F.raise_error(F.concat(F.get("errors", F.lit(0)).getField("code"), F.lit(" at line "), F.col("position").cast("string")))).otherwise(F.col("organisation_number"))
    return rows.select(checked.alias("organisation_number"))


def wanted_from_delivery(delivery: DataFrame, wanted: DataFrame, key: str = "organisation_number") -> DataFrame:
    """The delivery's rows for the wanted keys; Spark broadcasts the list only if it is small."""
    return delivery.join(wanted.select(key).distinct(), key, "left_semi")


def missing_from_delivery(delivery: DataFrame, wanted: DataFrame, key: str = "organisation_number") -> DataFrame:
    return wanted.select(key).distinct().join(delivery, key, "left_anti")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are left out, broken ones kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    at = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def replay(requests: DataFrame, captured: DataFrame) -> DataFrame:
    """Requested urls with what was captured for them: ``url, status, body, content_sha256, error``.

    A url that wasn't captured has status 0 and says so; the hash is of the body.
    """
    kept = captured.select("url", F.col("status").alias("_status"), F.col("body").alias("_body"))
    got = requests.select("url").join(kept, "url", "left")
    return got.select("url", F.coalesce("_status", F.lit(0)).alias("status"), F.col("_body").alias("body"), F.sha2(F.col("_body").cast("binary"), 256).alias("content_sha256"), F.when(F.col("_status").isNull(), "not captured").alias("error"))


def outcome(status: Column) -> Column:
    """What a response's status says of its source."""
    return F.when(status == 200, "available").when(status.isin(404, 410), "not_found").otherwise("source_error")
