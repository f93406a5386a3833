"""The general evidence problems: history, snapshot changes, malformed rows."""

import csv
import datetime
import io
import json
import random
import re

import pytest

from skarv.functions.canon import canonical_json
from skarv.operators import history, malformed, snapshots
from skarv.plans import evidence_queries
from tests.oracle import differences

EVIDENCE = "row_id long, source_row_key string, field string, status string, retrieved_at timestamp_ntz, value string, as_of string, effective_at string"


@pytest.mark.parametrize("name", sorted(evidence_queries.SQL))
def test_against_sql(spark, con, sf, name):
    assert differences(evidence_queries.QUERIES[name](spark, sf), con, evidence_queries.SQL[name]) == []


def test_canonical_json():
    assert canonical_json('{"b": [2, 1.0], "a": "\\u00e5"}') == canonical_json('{"a":"å","b":[1,2]}')
    assert canonical_json("true") != canonical_json("1")
    assert canonical_json("[[1,2],[3]]") == canonical_json("[[3],[2,1]]")
    assert canonical_json(None) is None
    assert canonical_json("{broken") == "!{broken"
    assert canonical_json("[" * 100_000) .startswith("!")


def at(day, hour=0):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=day - 1)


def versions(df):
    return sorted((r.source_row_key, r.field, r.value, r.valid_from, r.valid_to) for r in df.collect())


def test_history_versions(spark):
    rows = [
        (1, "a", "f", "available", at(9), '"x"', None, "2024-01-01T00:30:00+02:00"),  # 31 December in UTC
        (2, "a", "f", "available", at(9, 1), '"x"', "05.01.2024", "ukjent"),
        (3, "a", "f", "source_error", at(9, 2), '"q"', "2024-01-06", None),
        (4, "a", "f", "available", at(7), '"y"', None, None),
        (5, "a", "f", "available", at(8), '"z"', None, "2024-01-07"),  # same day, retrieved later
        (6, "a", "f", "not_found", at(10), None, None, ""),
        (7, "a", "f", "available", at(11), '"z"', None, "n/a"),
        (7, "a", "f", "available", at(11), '"z"', None, "n/a"),
        (8, "b", "f", "not_found", at(1), None, None, None),
        (9, None, "f", "available", at(1), "1", None, None),
        (10, "c", "f", "available", at(1), None, None, None),
        (11, "c", "f", "available", at(2), "null", None, None),
    ]
    df = spark.createDataFrame(rows, EVIDENCE).withColumnRenamed("row_id", "row_id")
    want = [
        ("a", "f", '"x"', "2023-12-31", "2024-01-07"),
        ("a", "f", '"z"', "2024-01-07", "2024-01-10"),
        ("a", "f", '"z"', "2024-01-11", ""),
        ("c", "f", "null", "2024-01-01", ""),
    ]
    assert versions(history.build_chains(df)) == want
    for late in (0, 3, 400):
        assert versions(history.history_as_delivered(df, late)) == want
    assert versions(history.build_chains(df.limit(0))) == []
    assert versions(history.history_as_delivered(df.limit(0))) == []


def test_history_keeps_utc_in_other_zones(spark):
    df = spark.createDataFrame([(1, "a", "f", "available", at(3), "1", None, "2024-01-02T23:30:00Z")], EVIDENCE)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert versions(history.build_chains(df)) == [("a", "f", "1", "2024-01-02", "")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_chain_store_replaces_touched_chains(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"k{rng.randrange(12)}", "f", "available", at(1 + i), str(rng.randrange(3)), None, f"2024-01-{1 + rng.randrange(28):02d}") for i in range(200)]
    log = spark.createDataFrame(rows, EVIDENCE)
    store = history.ChainStore(spark, str(tmp_path / "store"), buckets=4)
    assert store.apply(log.where("row_id < 150"), log.where("row_id < 150")) == 1
    before = versions(store.read())
    assert before == versions(history.build_chains(log.where("row_id < 150")))
    late = log.where("row_id >= 150 and source_row_key in ('k1', 'k2')")
    assert store.apply(log.where("row_id < 150").union(late), late) == 2
    assert versions(store.read()) == versions(history.build_chains(log.where("row_id < 150").union(late)))
    assert versions(store.read(1)) == before  # the old manifest still reads whole
    assert store.apply(log, log.limit(0)) == 2


def test_chain_store_after_lost_and_second_writers(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", "f", "available", at(1), "1", None, "2024-01-01")], EVIDENCE)
    store = history.ChainStore(spark, str(tmp_path / "store"), buckets=2)
    assert store.apply(log, log) == 1
    want = versions(store.read())
    # A writer lost between its data and its manifest leaves both of these.
    (tmp_path / "store" / "data-000000002").mkdir()
    (tmp_path / "store" / "draft-lost").write_text('{"0": "')
    assert store.version() == 1 and versions(store.read()) == want
    assert store.apply(log, log) == 2 and versions(store.read()) == want
    with pytest.raises(Exception):
        store._commit(2, "{}")
    assert store.version() == 2 and versions(store.read()) == want
    assert [p.name for p in (tmp_path / "store").glob("draft-*")] == ["draft-lost"]


def test_snapshot_changes(spark):
    schema = "row_id long, source_row_key string, field string, status string, retrieved_at timestamp_ntz, value string, as_of string, _key string"
    days = ["2025-01-31", "2025-02-28T00:00:00Z", "31.03.2025", "2025-04-30"]
    rows = [
        (1, "NO 111 111 111 MVA", "f", "available", at(1), '{"a":1,"b":[1,2]}', days[0], "x"),
        (2, "111111111", "f", "available", at(2), '{"b":[2,1],"a":1}', days[1], "x"),
        (3, "111111111", "f", "blocked", at(3), None, days[2], "x"),
        (4, "111111111", "f", "available", at(4), '{"a":2}', days[3], "x"),
        (5, "222222222", "f", "available", at(1), "1", days[0], "x"),
        (6, "222222222", "f", "available", at(4), "2", days[3], "x"),
        (7, "333333333", "f", "available", at(1), "1", days[2], "x"),
        (8, "333333333", "f", "available", at(2), "2", days[2], "x"),
        (9, "333333333", "f", "available", at(2), "1", days[3], "x"),
        (10, None, "f", "available", at(1), "1", days[1], "x"),
        (11, "44", "f", "available", at(1), "1", days[1], "x"),
        (12, "444444444", "f", "available", at(1), "1", "soon", "x"),
    ]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, snapshots.snapshot_changes(df).collect()))
    assert got == [
        ("222222222", "f", "2025-02-28", "removed"),
        ("222222222", "f", "2025-04-30", "added"),
        ("333333333", "f", "2025-03-31", "added"),
        ("333333333", "f", "2025-04-30", "changed"),
    ]
    assert sorted(map(tuple, snapshots.snapshot_changes(df.union(df)).collect())) == got
    assert snapshots.snapshot_changes(df.limit(0)).collect() == []


INPUT = "row_id long, batch_id string, input_position long, fmt string, raw string, organisation_number string, errors string, _salt string"


def reasons(spark, rows):
    df = spark.createDataFrame([(i, b, p, f, r, "left", "over", "x") for i, (b, p, f, r) in enumerate(rows)], INPUT)
    return {r.row_id: r.reason for r in malformed.classify(df).collect()}


def test_malformed_reasons(spark):
    head = "﻿navn;organisasjonsnummer;antallAnsatte;stiftelsesdato;konkurs"
    rows = [
        ("a", 0, "csv", head),
        ("a", 1, "csv", 'A;"414 028 683";"";;'),
        ("a", 2, "csv", 'A "B";414028683;1;2020-01-01;TRUE'),
        ("a", 3, "csv", '"A ""B""\nC;D";414028683;1;2020-02-29;False'),
        ("a", 4, "csv", '"A;414028683;1;2020-01-01;true'),
        ("a", 5, "csv", "A;414028683;1;2020-01-01"),
        ("a", 6, "csv", "A;414028684;1;2020-01-01;true"),
        ("a", 7, "csv", "A;NO 414028683 MVA;x;2020-01-01;true"),
        ("a", 8, "csv", "A;414028683;1;2021-02-29;true"),
        ("a", 9, "csv", "A;414028683;1;2020-01-01;ja"),
        ("a", 10, "csv", None),
        ("a", 11, "csv", '"' + '""' * 200_000 + '";414028683;;;'),
        ("b", 1, "csv", "414028683"),
        ("j", 0, "jsonl", '{"organisation_number": 414028683, "employees": 3, "bankrupt": true, "founded_date": null}'),
        ("j", 1, "jsonl", '"414028683"'),
        ("j", 2, "jsonl", '{"organisation_number": "414028683"}}'),
        ("j", 3, "jsonl", "414028683] [1"),
        ("j", 4, "jsonl", '{"organisation_number": "414028683",}'),
        ("j", 5, "jsonl", '{"name": "x"}'),
        ("j", 6, "jsonl", '{"organisasjonsnummer": "414028683", "antallAnsatte": -3}'),
        ("j", 7, "jsonl", None),
        ("t", 0, "txt", "414 028 683"),
        ("t", 1, "txt", None),
        (None, None, None, "414028683"),
    ]
    got = reasons(spark, rows)
    want = [None, "broken_quoting", None, "broken_quoting", "wrong_column_count", "invalid_organisation_number", "invalid_value", "invalid_value", "invalid_value", "wrong_column_count", None, "wrong_column_count",
            None, None, "broken_json", "broken_json", "broken_json", "invalid_organisation_number", "invalid_value", "broken_json", None, "invalid_organisation_number", None]
    assert [got[i] for i in range(1, len(rows))] == want
    assert 0 not in got
    assert malformed.classify(spark.createDataFrame([], INPUT)).collect() == []


def brute(raw, delimiter):
    """Fields, or None if the quoting is broken, read character by character."""
    out, i = [], 0
    while True:
        if raw[i : i + 1] == '"':
            end = i + 1
            while True:
                end = raw.find('"', end)
                if end < 0:
                    return None
                if raw[end + 1 : end + 2] == '"':
                    end += 2
                    continue
                break
            out.append(raw[i + 1 : end].replace('""', '"'))
            i = end + 1
            if i < len(raw) and raw[i] != delimiter:
                return None
        else:
            end = raw.find(delimiter, i)
            end = len(raw) if end < 0 else end
            if '"' in raw[i:end]:
                return None
            out.append(raw[i:end])
            i = end
        if i >= len(raw):
            return out
        i += 1


def test_csv_against_brute_force(spark):
    rng = random.Random(7)
    records = ["".join(rng.choice(['"', '"', ";", "a", "\n"]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    rows = [("a", 0, "csv", "organisation_number;b;c")] + [("a", i + 1, "csv", r) for i, r in enumerate(records)]
    got = reasons(spark, rows)
    for i, record in enumerate(records):
        fields = brute(record, ";")
        want = "broken_quoting" if fields is None else "wrong_column_count" if len(fields) != 3 else "invalid_organisation_number"
        assert got[i + 1] == want, record


def test_read_by_the_csv_module_too(spark):
    out = io.StringIO()
    csv.writer(out, delimiter=",", lineterminator="").writerow(['q "x", y', "414028683"])
    assert reasons(spark, [("a", 0, "csv", "name,organisation_number"), ("a", 1, "csv", out.getvalue())]) == {1: None}


def test_loaded_rows_have_empty_errors(spark, sf):
    for r in evidence_queries.p5_loaded(spark, sf).collect():
        assert json.loads(r.errors) == [] and re.fullmatch(r"\d{9}", r.organisation_number)
