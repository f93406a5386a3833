"""The queries of the problems: columns as stated, all of them run over the smallest tables."""

import pytest

COLUMNS = {
    "p1_found": [("page_id", "bigint"), ("line_no", "bigint")],
    "p3_found": [("organisation_number", "string"), ("place_id", "string")],
    "p6_found": [("record_a", "bigint"), ("record_b", "bigint")],
    "p7_found": [("claim_id", "bigint"), ("column_name", "string")],
    "p8_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p9_found": [("source", "string")],
    "p10_found": [("doc_id", "bigint")],
}


def names():
    from skarv.llm.queries import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, sf, name):
    from skarv.llm.queries import QUERIES

    frame = QUERIES[name](spark, sf)
    if name in COLUMNS:
        assert frame.dtypes == COLUMNS[name]
        rows = frame.collect()
        assert len(rows) == len(set(rows)) and all(v is not None for r in rows for v in r)
    else:
        frame.count()
