"""Every query of the core against its SQL, or for rows where it has none."""

import html
import re
from collections import Counter

import pytest

from skarv.plans import claims_queries, company_queries, document_queries, observation_queries, relational_queries, stream_queries
from tests.oracle import differences

MODULES = (relational_queries, company_queries, stream_queries, claims_queries, observation_queries, document_queries)
CASES = [(m, name) for m in MODULES for name in m.QUERIES if name in m.SQL]
#: Queries without SQL, each with a test of its own below or in another file.
PLAIN = {"drawn_sample", "page_signals", "priority_links", "site_identity"}


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, con, sf, module, name):
    assert differences(module.QUERIES[name](spark, sf), con, module.SQL[name]) == []


def test_queries_without_sql_are_known():
    assert {name for m in MODULES for name in m.QUERIES if name not in m.SQL} == PLAIN


def test_signals_of_pages_against_their_markup(spark, con, sf):
    got = {r.page_id: r for r in company_queries.page_signals(spark, sf).collect()}
    pages = con.execute("SELECT page_id, html FROM page_contents").fetchall()
    assert set(got) == {page for page, _ in pages}
    for page, markup in pages:
        title = re.search(r"(?is)<title[^>]*>(.*?)</title>", markup or "")
        if title:
            assert got[page].title == " ".join(html.unescape(title[1]).split())


def test_links_of_pages_are_few_and_their_own(spark, con, sf):
    hosts = dict(con.execute("SELECT page_id, regexp_extract(lower(source_url), '^https?://(?:www[.])?([^/]+)', 1) FROM page_contents").fetchall())
    rows = company_queries.priority_links(spark, sf).collect()
    assert rows and max(Counter(r.page_id for r in rows).values()) <= 4
    for r in rows:
        assert hosts[r.page_id] in r.url.lower() and 0 <= r.rank < len(company_queries.PRIORITY_TERMS)


def test_identity_of_sites_against_their_text(spark, con, sf):
    rows = company_queries.site_identity(spark, sf).collect()
    pages = {page: (number, shown or "") for page, number, shown in con.execute("SELECT page_id, organisation_number, text FROM page_contents").fetchall()}
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        number, shown = pages[r.page_id]
        stands = number is not None and re.search(r"(?<!\d)" + r"[ .\u00a0]?".join((number[:3], number[3:6], number[6:])) + r"(?!\d)", shown)
        if r.reason != "parked":
            assert (r.reason == "number") is bool(stands) and (r.confidence == 1.0) is bool(stands)


def test_entry_lists_them_all(spark):
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert {n for _, n in CASES} <= set(names) and set(sql) <= set(names)
    assert entry.entry(spark).count() > 0
