"""Functions, readers, sinks and expressions on literals."""

import datetime
import gzip
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skarv.functions import html, ids, text, url
from skarv.operators import aggregates, claims, identity, refresh, relational
from skarv.plans import screening
from skarv.sources import readers, sinks
from skarv.streaming import events


def values(spark, column, *inputs, names="abcdef"):
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    width = len(rows[0]) - 1
    schema = "n int, " + ", ".join(f"{c} string" for c in names[:width])
    return [r[0] for r in spark.createDataFrame(rows, schema).orderBy("n").select(column).collect()]


def test_fold_and_keys(spark):
    a = F.col("a")
    assert values(spark, text.fold(a), "Ærlig ØST Årø ß Łódź", None) == ["aerlig ost aro ss lodz", None]
    assert values(spark, text.name_key(a), "Nord & Sør AS", "SØR NORD", None, "") == ["nord sor", "nord sor", "", ""]
    assert values(spark, text.slug(a), "Å, Fjell og Dal!") == ["a-fjell-og-dal"]
    assert values(spark, text.without_legal_form(a), "Fjell AS", "As Fjell ASA AS") == ["fjell", "as fjell"]


def test_text_evidence(spark):
    a = F.col("a")
    assert values(spark, text.organisation_numbers(a), "Org.nr. 987 654 321, 123456789.", "1234567890 12345678", None) == [["123456789", "987654321"], [], []]
    assert values(spark, text.email_domains(a), "Skriv til Post@Firma.example eller a@b.co.example") == [["b.co.example", "firma.example"]]
    hidden = "42" + "".join(f"{ord(c) ^ 0x42:02x}" for c in "a@b.no")
    assert values(spark, text.decoded_email(a), hidden, "zz", None, "4") == ["a@b.no", None, None, None]
    day = datetime.date
    assert values(spark, text.explicit_dates(a), "2024-02-30, 2024-02-29, 1. mars 2023 og 24.12.2022; 3 Oct 2021, 1.1.1980", None) == [[day(2021, 10, 3), day(2022, 12, 24), day(2023, 3, 1), day(2024, 2, 29)], []]
    assert values(spark, text.contains_span(a, F.col("b")), ("En  «stor»\nby", '"STOR" by'), ("x", None), (None, "x"), ("x", "")) == [True, False, False, False]
    assert values(spark, text.supported_by(a, F.col("b")), ("12 ansatte", "vi har 12 ansatte"), ("13 ansatte", "vi har 12 ansatte")) == [True, False]


def test_urls(spark):
    a = F.col("a")
    assert values(spark, url.homepage(a), "Firma.example/Om;x?q#f", "ftp://x.no", "http://u:p@A.no", None, "ikke noe") == ["https://firma.example/Om", None, "http://a.no/", None, None]
    assert values(spark, url.host(a), "https://www.A.no:80/x", "b.no", "") == ["a.no", "b.no", None]
    assert values(spark, url.registered_domain(a), "x.y.no", "x.y.co.uk", "no", None) == ["y.no", "y.co.uk", "no", None]
    assert values(spark, url.host_suffixes(a), "a.b.c") == [["a.b.c", "b.c", "c"]]
    got = values(spark, url.profile(a), "https://www.facebook.com/firma/posts", "facebook.com/sharer.php", "linkedin.com/company/x/about", "linkedin.com/in/x", "https://twitter.com/home", "https://firma.no/x", None)
    assert [g and (g.platform, g.url) for g in got] == [("facebook", "https://facebook.com/firma/posts"), None, ("linkedin", "https://linkedin.com/company/x"), None, None, None, None]
    assert values(spark, url.web_address(a), "https://a.no/x", "https://u:p@a.no", "a.no", None) == [True, False, False, False]


def test_mod11(spark):
    assert values(spark, ids.mod11_valid(F.col("a")), "414028683", "414028684", "41402868", "abc", None) == [True, False, False, False, False]


def test_html(spark):
    page = """<html><head><title>Firma &amp; Co</title><meta name="description" content="Om oss"><script type="application/ld+json">{"@graph":[{"@type":["Organization","X"],"name":"F","sameAs":["https://x.com/f"],"member":{"@type":"Person"}}]}</script></head>
    <body><h1>Vel<b>kommen</b></h1><a href="/om#x">Om</a><a href="/om">igjen</a><a href="mailto:A@b.no?s=1">e</a><a href="javascript:x">j</a><script>var x="<p>"</script><footer>Bunn</footer></body>"""
    df = spark.createDataFrame([(page, "https://f.no/"), (None, None), ("<", "")], "h string, u string")
    rows = df.select(html.page_signals("h").alias("s"), html.page_links("h", "u").alias("l"), html.linked_data("h").alias("d")).collect()
    s = rows[0].s
    assert (s.title, s.description, s.heading, s.footer, s.emails) == ("Firma & Co", "Om oss", "Velkommen", "Bunn", ["a@b.no"]) and "var x" not in s.text
    assert [(x.url, x.label) for x in rows[0].l] == [("https://f.no/om", "Om")]
    assert [(d.type, d.name, d.same_as) for d in rows[0].d] == [("Organization", "F", ["https://x.com/f"]), ("X", "F", ["https://x.com/f"]), ("Person", None, [])]
    assert rows[1].l == [] and rows[1].d == []
    feed = "<?xml version='1.0'?><rss><channel><item><title>T</title><link>u</link><pubDate>d</pubDate></item></channel></rss>"
    got = values(spark, html.feed_items("a"), feed, "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A</title><link href='v'/><updated>e</updated></entry></feed>", "<!DOCTYPE x><rss/>", "no", None)
    assert [[tuple(i) for i in g] for g in got] == [[("T", "u", "d")], [("A", "v", "e")], [], [], []]


def test_delivery_plain_gzip_and_misnamed(spark, tmp_path):
    content = "﻿organisasjonsnummer;navn;antallAnsatte;konkurs\n414028683;\"A; B\";3;TRUE\n987654321;C;x;false\n12;D;;\n".encode()
    paths = [tmp_path / "a.csv", tmp_path / "b.csv.gz", tmp_path / "c.csv"]
    paths[0].write_bytes(content)
    paths[1].write_bytes(gzip.compress(content))
    paths[2].write_bytes(gzip.compress(content))
    for p in paths:
        rows = readers.normalised_registry(readers.read_delivery(spark, str(p))).orderBy("organisation_number").collect()
        assert [(r.organisation_number, r.name, r.employees, r.bankrupt, r.website) for r in rows] == [("414028683", "A; B", 3, True, None), ("987654321", "C", None, False, None)]


def test_inputs(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"organisation_number": "414 028 683"}\n\n414028683\n"{broken\n{"organisasjonsnummer": 414028684}\n')
    rows = readers.tolerant_inputs(readers.input_lines(spark, str(tmp_path / "in.jsonl"))).orderBy("position").collect()
    assert [(r.position, r.organisation_number, [e.code for e in r.errors]) for r in rows] == [(0, "414028683", []), (2, "414028683", ["duplicate_input"]), (3, None, ["invalid_organisation_number"]), (4, "414028684", ["checksum_mismatch"])]
    with pytest.raises(PySparkException):
        readers.strict_inputs(readers.input_lines(spark, str(tmp_path / "in.jsonl"))).collect()
    (tmp_path / "rows.jsonl").write_text('{"k":"a","v":1}\n{"k":"a","v":2}\n{bad\n')
    read = readers.read_json_lines(spark, str(tmp_path / "rows.jsonl"), "k string, v int").cache()
    assert read.where("_corrupt_record is not null").count() == 1
    assert [tuple(r) for r in readers.last_wins(read.where("k is not null"), "k", "v").select("k", "v").collect()] == [("a", 2)]


def test_replay(spark):
    captured = spark.createDataFrame([("u", 200, "x"), ("v", 404, None)], "url string, status int, body string")
    got = {r.url: r for r in readers.replay(spark.createDataFrame([("u",), ("v",), ("w",)], "url string"), captured).withColumn("outcome", readers.outcome(F.col("status"))).collect()}
    assert (got["u"].outcome, got["v"].outcome, got["w"].outcome, got["w"].error) == ("available", "not_found", "source_error", "not captured")
    assert got["u"].content_sha256 == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


def test_sinks(spark, tmp_path):
    df = spark.range(100).select((99 - F.col("id")).alias("n"))
    sinks.write_json_lines(df, str(tmp_path / "out"), ["n"])
    lines = [json.loads(x)["n"] for p in sorted((tmp_path / "out").glob("part-*.json")) for x in p.read_text().splitlines()]
    assert lines == list(range(100))
    contents = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "content string")
    for _ in range(2):
        sinks.store_contents(contents, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    kept = sinks.append_history(df, spark.createDataFrame([(500,)], "n long"), "n", 3)
    assert sorted(r.n for r in kept.collect()) == [98, 99, 500]
    assert sinks.report(spark.createDataFrame([(1, None)], "a int, b int")).collect()[0][0] == '{"a":1}'


def test_identity(spark):
    name, number = F.lit("Nord og Sør Bygg AS"), F.lit("414028683")
    page = lambda t: values(spark, identity.site_confidence(name, number, F.col("a")), t)[0].confidence
    assert [page(t) for t in ("This domain is for sale 414028683", "Org 414 028 683", "Velkommen til Nord Sør Bygg", "Nord Bygg", "Helt annet", None)] == [0.1, 1.0, 0.95, 0.65, 0.3, 0.3]
    assert values(spark, identity.profile_confidence(name, F.col("a")), "nordogsorbygg", "nordsorbygg", "nordsor", "x", None) == [0.9, 0.98, 0.3, 0.3, 0.3]
    assert values(spark, identity.in_title(F.lit("Nord Bygg"), F.col("a")), "Nord Bygg vokser", "Ny sjef hos Nord Bygg", "Store Nord Bygg", "Nord", None) == [True, True, False, False, False]
    score = identity.search_score(name, number, F.col("a"), F.col("b"), F.col("c"), F.lit("Oslo"))
    assert values(spark, score, ("Nord Sør Bygg", "414028683 i Oslo", "nordsorbygg.no"), ("x", None, None)) == [1.0, 0.0]
    rows = spark.createDataFrame([("a", 0.9, "u2"), ("a", 0.9, "u1"), ("b", 0.2, "u3")], "k string, s double, u string")
    assert [tuple(r) for r in identity.choose(rows, "k", "s", ["u"], 0.5).select("k", "u").collect()] == [("a", "u1")]


def test_claims_and_refresh(spark):
    schema = "organisation_number string, category string, field string, value string, status string, source_url string, content_sha256 string, retrieved_at string"
    rows = [("1", "c", "f", "0", "available", "u", "s", "t"), ("1", "c", "f", "0", "available", "v", "s", "t"), ("1", "c", "g", "x", "blocked", "u", "s", "t"), ("1", "c", "h", "x", "available", None, "s", "t")]
    told = claims.cited(spark.createDataFrame(rows, schema))
    assert [(r.field, r.value) for r in told.collect()] == [("f", "0")]
    made = claims.envelopes(spark.createDataFrame([(1, "1"), (2, "1"), (3, "9")], "position int, organisation_number string"), told).orderBy("position").collect()
    assert [(r.n_claims, r.n_fields, r.found) for r in made] == [(1, 1, True), (1, 1, True), (0, 0, False)]
    assert claims.dangling(told, told.limit(0)).count() == 1 and claims.dangling(told, told).count() == 0
    pages = spark.createDataFrame([(1, "https://a.no", "0" * 64, "t", "x"), (2, "a.no", None, None, "y")], "k int, source_url string, content_sha256 string, retrieved_at string, body string")
    assert sorted((r.k, r.code) for r in claims.findings(pages, "k", content="body").collect()) == [(1, "content_changed"), (2, "invalid_hash"), (2, "invalid_time"), (2, "invalid_url")]
    a = spark.createDataFrame([("1", '{"a":[1,2]}', "x", "available"), ("2", "1", "x", "available"), ("3", "1", None, "available"), ("4", "1", "x", "available")], "k string, v string, w string, s string")
    b = spark.createDataFrame([("1", '{"a":[2,1]}', "x", "available"), ("2", "2", "x", "blocked"), ("3", "1", '"y"', "available"), ("5", "1", "x", "available")], "k string, v string, w string, s string")
    got = refresh.diff(a, b, "k", ["v", "w"], "s").collect()
    assert [(r.k, r.field, r.old_value, r.new_value) for r in got] == [("3", "w", None, '"y"')]
    assert refresh.diff(a, a, "k", ["v", "w"], "s").collect() == []
    assert tuple(refresh.same_keys(a, b, "k").collect()[0]) == (1, 1)
    assert [r.k for r in refresh.only_in(a, b, "k").collect()] == ["4"]


def test_samples_do_not_depend_on_order(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    again = rows.repartition(7).orderBy(F.rand(3))
    pick = lambda df: sorted(r.id for r in df.collect())
    assert pick(relational.hash_sample(rows, "id", 20, "s")) == pick(relational.hash_sample(again, "id", 20, "s"))
    assert pick(relational.stratified_sample(rows, ["g"], "id", 5, 1)) == pick(relational.stratified_sample(again, ["g"], "id", 5, 1))
    hosts = rows.withColumn("host", F.concat(F.lit("h"), F.col("id") % 20))
    got = relational.first_per_host(hosts, "host", "id", 15, 1, hosts.where("id < 2").select("host").distinct()).collect()
    assert len(got) == 15 and len({r.host for r in got}) == 15 and not {"h0", "h1"} & {r.host for r in got}
    assert relational.hash_sample(rows.limit(0), "id", 5, 1).collect() == []


def test_as_of_and_range_against_brute_force(spark):
    import random

    rng = random.Random(2)
    left = [(i, rng.randrange(3), rng.randrange(50)) for i in range(60)]
    right = [(k, t, t * 10 + k) for k, t in {(rng.randrange(3), rng.randrange(50)) for _ in range(40)}]
    for width in (3.0, 1000.0):
        got = relational.as_of_join(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, at int, v int"), "k", "t", "at", ["v"], width).collect()
        for r in got:
            before = [(at, v) for k, at, v in right if k == r.k and at <= r.t]
            assert r.v == (max(before)[1] if before else None)
        assert len(got) == 60
    ranges = [(j, float(a), float(a + rng.randrange(1, 20))) for j, a in enumerate(rng.randrange(-30, 40) for _ in range(15))]
    points = [(i, rng.uniform(-35, 60)) for i in range(80)]
    held = relational.range_join(spark.createDataFrame(points, "i int, p double"), spark.createDataFrame(ranges, "j int, a double, b double"), "p", "a", "b", 7.0)
    assert sorted((r.i, r.j) for r in held.collect()) == sorted((i, j) for i, p in points for j, a, b in ranges if a <= p < b)


def test_rates_over_nothing(spark):
    empty = spark.createDataFrame([], "k string")
    assert tuple(aggregates.precision_recall(empty, empty, ["k"]).collect()[0]) == (0, 0, 0, 1.0, 1.0)
    assert tuple(aggregates.latency_summary(spark.createDataFrame([], "v double"), "v").collect()[0]) == (0, None, None, None)
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None)], "g string, p string")
    got = {r.label: (r.support, round(r.precision, 3), round(r.recall, 3)) for r in aggregates.label_quality(rows, "g", "p").collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (1, 0.5, 1.0), "c": (1, 0.0, 0.0)}


@pytest.mark.parametrize(
    "question,filters,order,runs",
    [
        ("AS companies in Oslo top 10 by revenue", [("municipality", "eq", "OSLO"), ("legal_form", "eq", "AS")], ("revenue", True), True),
        ("revenue over 1,5 million and profitable with a website", [("revenue", ">", 1.5e6), ("annual_result", ">", 0.0), ("website", "present", None)], None, True),
        ("companies in oslo with legal form asa", [("municipality", "eq", "OSLO"), ("legal_form", "eq", "ASA")], None, True),
        ("at most 20 employees in Bergen", [("municipality", "eq", "BERGEN"), ("employees", "<=", 20.0)], None, True),
        ("employees = 7", [("employees", "=", 7.0)], None, True),
        ("more than 5 registered employees having annual accounts", [("employees", ">", 5.0)], None, True),
        ('loss-making, industry contains "bygg"', [("annual_result", "<", 0.0), ("industry", "contains", "bygg")], None, True),
        ("top 500 by employees", [], ("employees", True), True),
        ("companies in Oslo with positive sentiment", [("municipality", "eq", "OSLO")], None, False),
        ("companies in Oslo without a website", [("municipality", "eq", "OSLO")], None, False),
        ("good glassdoor reviews", [], None, False),
        ("hello", [], None, False),
    ],
)
def test_screening_plans(question, filters, order, runs):
    plan = screening.parse(question)
    assert [(f.field, f.operator, f.value) for f in plan.filters] == filters and plan.order == order and plan.executable is runs
    assert (plan.reason is None) is runs
    assert plan.limit is None or plan.limit <= 100


def test_screening_unknown_values_do_not_fit(spark):
    rows = spark.createDataFrame([("1", None, "Oslo"), ("2", 5, "oslo"), ("3", 1, "Oslo")], "organisation_number string, employees int, municipality string")
    assert [r[0] for r in screening.screen(rows, "in Oslo with more than 2 employees").collect()] == ["2"]
    assert [r[0] for r in screening.screen(rows, "in Oslo top 3 by employees").collect()] == ["2", "3", "1"]
    assert screening.screen(rows, "profitable companies in Oslo").collect() == []  # no such field
    assert screening.screen(rows, "companies in Oslo with good reviews").collect() == []
    told = screening.outcome(rows, "companies in Oslo with good reviews").collect()[0]
    assert told.abstained and told.result_count == 0 and "review data" in told.reason
    assert screening.outcome(rows, "hello").collect()[0].reason == screening.NOTHING_KNOWN


def test_screening_gives_all_that_fit(spark):
    rows = spark.range(250).selectExpr("cast(id as string) as organisation_number", "'Oslo' as municipality", "cast(id as int) as employees")
    assert screening.screen(rows, "companies in Oslo").count() == 250
    assert screening.outcome(rows, "companies in Oslo").collect()[0].result_count == 250
    assert screening.screen(rows, "in Oslo top 200 by employees").count() == 100


def test_screening_cites_its_evidence(spark):
    rows = spark.createDataFrame([("1", "Oslo", 5.0)], "organisation_number string, municipality string, revenue double")
    seen = [("1", "registry", 1, "https://a", "t1", "h1"), ("1", "registry", 2, "https://b", "t2", "h2"), ("2", "registry", 3, "https://c", "t3", "h3")]
    evidence = spark.createDataFrame(seen, "organisation_number string, module string, row_id long, source_url string, retrieved_at string, content_sha256 string")
    plan = screening.parse("companies in Oslo with revenue over 2 top 5 by revenue")
    got = screening.cited(screening.run(rows, plan), evidence, plan).collect()
    assert [(r.module, r.source_url) for r in sorted(got, key=lambda r: r.module)] == [("financials", None), ("registry", "https://b")]


def test_profiles_on_platforms(spark):
    urls = ["https://facebook.com/profile.php?id=1", "https://www.youtube.com/watch?v=x", "https://tiktok.com/foo", "https://x.com/a/status/1", "https://linkedin.com/showcase/x/y", "https://youtube.com/channel/UC1/videos", "https://youtube.com/@firma/about", "https://m.facebook.com/firma", "https://twitter.com/firma", "https://tiktok.com/@firma", "https://youtu.be/abc", "https://linkedin.com/company/firma/about/", "https://fb.com/a/b"]
    got = values(spark, url.profile(F.col("a")), *urls)
    want = [None, None, None, None, None, "https://youtube.com/channel/UC1", "https://youtube.com/@firma", "https://facebook.com/firma", "https://x.com/firma", "https://tiktok.com/@firma", None, "https://linkedin.com/company/firma", "https://facebook.com/a/b"]
    assert [g and g.url for g in got] == want


def test_names_in_titles(spark):
    df = spark.createDataFrame([("Aneo AS", t) for t in ("Endring på Aneo AS", "Equinor kjøper Aneo AS", "Deal with Aneo AS", "Aneo AS vokser - Avisen", "Nytt - Aneo AS", "Aneo AS - vekst - Avisen")], "n string, t string")
    assert [r[0] for r in df.select(identity.in_title(F.col("n"), F.col("t"))).collect()] == [True, True, False, True, False, True]


def test_deliveries_with_line_breaks_in_quotes(spark, tmp_path):
    import gzip

    content = '"organisasjonsnummer";"navn"\r\n"1";"to\nlinjer"\r\n"2";"med ""sitat"" og \u2028"\r\n"3";\r\n'.encode()
    for name, data in (("a.csv", content), ("b.csv.gz", gzip.compress(content)), ("c.csv", gzip.compress(content)), ("d.bin", gzip.compress(b"\xef\xbb\xbf" + content))):
        (tmp_path / name).write_bytes(data)
        got = [tuple(r) for r in readers.read_delivery(spark, str(tmp_path / name)).orderBy("organisasjonsnummer").collect()]
        assert got == [("1", "to\nlinjer"), ("2", 'med "sitat" og \u2028'), ("3", None)], name


def test_late_rows_and_windows_on_a_stream(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    batches = [[(1, at(1), "a"), (2, at(1, 30), "a"), (2, at(1, 30), "a")], [(3, at(6), "b"), (4, at(1, 10), "late")], [(7, at(7), "b")], [(8, at(8), "b")], [(5, at(9), "a"), (6, at(1, 20), "late")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id int, ts timestamp_ntz, kind string").coalesce(1).write.parquet(str(tmp_path / f"{i}"))
    (tmp_path / "in").mkdir()
    for i in range(len(batches)):
        part = next((tmp_path / f"{i}").glob("part-*.parquet"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
    stream = events.timed(spark.readStream.schema("event_id int, ts timestamp_ntz, kind string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in")))
    got = events.materialise(events.tumbling_counts(stream, ["kind"], "1 hour"), "append").collect()
    told = {(r.window_start.hour, r.kind): r.events for r in got}
    assert told[(1, "a")] == 3 and told.get((1, "late"), 0) <= 1  # the last late row comes after the watermark
    once = events.materialise(events.distinct_events(stream, ["event_id"]).select("event_id"), "append").collect()
    assert sorted(r.event_id for r in once)[:3] == [1, 2, 3]
    feed = events.materialise(events.change_feed(stream, "kind", "ts", "event_id", idle="1 day"), "append").collect()
    assert ("a", "1", "2") in {(r.key, r.old_value, r.new_value) for r in feed}


def test_freshness(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-02-20 00:00:00"), (3, "2024-03-02 00:00:00")], "n int, t string")
    assert [r.n for r in events.freshness(rows, "t", "2024-03-01", 45).collect()] == [2]


def test_extraction(spark):
    from skarv.functions import extract

    a = F.col("a")
    got = values(spark, extract.json_leaves(a), '{"b":[1,{"c":"x"}],"d":null,"e":true}', "no", None, "[" * 100_000, "5")
    assert [[tuple(x) for x in g] for g in got] == [[("/b/0", "number", "1"), ("/b/1/c", "text", "x"), ("/d", "null", None), ("/e", "boolean", "true")], [], [], [], [("/", "number", "5")]]
    assert values(spark, extract.sequence_ratio(a, F.col("b")), ("abcd", "bcde"), (None, "x"), ("", "")) == [0.75, None, 1.0]
    assert values(spark, extract.ascii_url(a), "https://blåbær.no/øl?q=å#x", "http://[", None) == ["https://xn--blbr-roah.no/%C3%B8l?q=%C3%A5", None, None]
    assert values(spark, extract.fenced_json(a), 'Svar: ```json\n{"a":1}\n```', ' {"b":2} ', "nei", None) == ['{"a":1}', '{"b":2}', None, None]
    assert values(spark, extract.plain_number(a), "1 234 567", "1.234", "12,5", "-3", "x", None) == [1234567.0, 1234.0, 12.5, -3.0, None, None]
    rule = extract.by_priority(a, [r"ansatte: (\d+)", r"(\d+) ansatte"], unless="konsern")
    assert values(spark, rule, "12 ansatte\nansatte: 9", "12 ansatte og 13 ansatte", "konsernet: 99 ansatte\n5 ansatte", None) == ["9", None, "5", None]
    assert values(spark, url.domain_guesses(text.name_tokens(a)), "Nord Sør AS", "Fjellet", "Ab", None) == [["nordsor.no", "nord-sor.no"], ["fjellet.no"], [], []]


def test_registry_documents(spark):
    from skarv.operators import documents

    entity = '{"organisasjonsnummer":"414028683","navn":"A","organisasjonsform":{"kode":"AS"},"antallAnsatte":0,"stiftelsesdato":"2020-02-30","forretningsadresse":{"adresse":["","Vei 1"],"land":""},"postadresse":{"adresse":[],"land":""},"aktivitet":["x","y"]}'
    accounts = '[{"regnskapsperiode":{"fraDato":"2024-01-01","tilDato":"2024-12-31"},"valuta":"NOK","resultatregnskapResultat":{"aarsresultat":-5,"driftsresultat":{"driftsinntekter":{"sumDriftsinntekter":0}}}},{},{},{}]'
    roles = '{"rollegrupper":[{"sistEndret":"2024-01-01","roller":[{"type":{"kode":"DAGL"},"person":{"navn":{"fornavn":"A","mellomnavn":"","etternavn":"B"}}},{"type":{"kode":"REVI"},"fratraadt":true,"enhet":{"organisasjonsnummer":"1","navn":["R","AS"]}}]},{"roller":[]}]}'
    units = '{"_embedded":{"underenheter":[{"organisasjonsnummer":"9","postadresse":{"adresse":["P 1"]}}]}}'
    df = spark.createDataFrame([(1, entity, accounts, roles, units), (2, None, None, None, None), (3, "x", "x", "x", "x")], "k int, e string, a string, r string, u string")
    e = {r.k: r for r in documents.entities(df, "k", "e").collect()}
    assert (e[1].legal_form, e[1].employees, e[1].founded, e[1].business_address.line, e[1].postal_address, e[1].activity, e[1].purpose) == ("AS", 0, None, "Vei 1", None, "x y", None) and e[2].name is None and e[3].name is None
    a = documents.accounts(df, "k", "a").orderBy("position").collect()
    assert [(r.k, r.position, r.revenue, r.net_result) for r in a] == [(1, 1, 0.0, -5.0), (1, 2, None, None), (1, 3, None, None)]
    r = documents.roles(df, "k", "r").collect()
    assert sorted((x.role, x.holder, x.left_office) for x in r) == [("DAGL", "A B", False), ("REVI", "R AS", True)]
    assert [(x.unit_number, x.address.line) for x in documents.locations(df, "k", "u").collect()] == [("9", "P 1")]
    assert values(spark, documents.in_period(F.col("a"), F.col("b"), F.col("c")), ("2024-01-01", "2024-12-31", "2024"), ("2024-01-01", "2023-12-31", "2024"), ("2024-01-01", "2024-12-31", None), (None, "2024", "2024")) == [True, False, None, False]
    made = documents.with_reasons(spark.createDataFrame([(1, None), (2, "x")], "n int, v string"), {"empty": F.col("v") != "", "small": F.col("n") > 1}).orderBy("n").collect()
    assert [r.reasons for r in made] == [["empty", "small"], []]


def test_positions_and_draws(spark):
    import random

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n")).repartition(9)
    assert all(r.n == r.position for r in relational.numbered(rows, ["n"]).collect())
    got = {r.draw: r.n for r in relational.drawn_sample(rows, ["n"], 10, 5).collect()}
    assert [got[i] for i in range(10)] == random.Random(5).sample(range(1000), 10)
    assert relational.numbered(rows.limit(0), ["n"]).collect() == []


def test_lists_of_inputs_in_json(spark, tmp_path):
    for name, content in {"a.json": '["974760673", 1, {"organisation_number": "x"}, null]', "b.json": '{"organisation_numbers": ["974760673",\n 1, {"organisation_number": "x"}, null]}'}.items():
        (tmp_path / name).write_text(content)
        got = readers.json_inputs(spark, str(tmp_path / name)).orderBy("position").collect()
        assert [(r.position, r.raw) for r in got] == [(0, "974760673"), (1, "1"), (2, '{"organisation_number":"x"}'), (3, None)]
        assert [r.organisation_number for r in readers.tolerant_inputs(readers.json_inputs(spark, str(tmp_path / name))).orderBy("position").collect()] == ["974760673", None, None, None]


def test_ranges_of_very_different_lengths(spark):
    import random

    rng = random.Random(3)
    points = [(i, rng.uniform(-1e6, 1e6)) for i in range(300)]
    ranges = [(0, -1e6, 1e6), (1, 5.0, 5.0), (2, None, 3.0), (3, 9.0, 1.0), *((j, a, a + 10 ** rng.uniform(-2, 6)) for j, a in ((j, rng.uniform(-1e6, 1e6)) for j in range(4, 60)))]
    got = relational.range_join(spark.createDataFrame(points, "i int, p double"), spark.createDataFrame(ranges, "j int, a double, b double"), "p", "a", "b", 7.0)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, p in points for j, a, b in ranges if a is not None and a <= p < b)
    assert relational.range_join(spark.createDataFrame(points, "i int, p double"), spark.createDataFrame([], "j int, a double, b double"), "p", "a", "b", 7.0).collect() == []
