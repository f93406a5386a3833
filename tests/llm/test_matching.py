"""Addresses, places and pages."""

import itertools

import pytest

from skarv.llm import addresses, boilerplate, linking, matching

SAME = [
    ("Beverfossveien 42C", "3831", "HESLFOSSEN"),
    ("H0607,Beverfossv. 42 c, N-3831 heslfossen, NORGE", None, None),
    ("3831 Heslfossen / Beverfoss vei 42-C / c/o Bratnakil Forvaltning", None, None),
    ("nr 42 C Beverfossvegen\n3831", None, None),
    ("Heslfossen - Bveerfossveien 42C - 3. etasje - 3831", None, None),
    ("Beverfossveien 42C att. driftsavdelingen 3831 Heslfossen", None, None),
]
APART = [
    ("Beverfossveien 42, 3831 Heslfossen", None, None),
    ("Beverfossveien 42B, 3831 Heslfossen", None, None),
    ("Beverfossgata 42C, 3831 Heslfossen", None, None),
    ("Beverfossveien 42C, 2235 Bryndfossen", None, None),
    ("Postboks 42, 3831 Heslfossen", None, None),
    ("Makrellveien 42C, 3831 Heslfossen", None, None),
]
BOX = [("Pb. 1234, 2235 Bryndfossen", None, None), ("P.O. Box 1234", "2235", None), ("  POSTB.  1234  ,  BRYNDFOSSEN", None, None)]
FOUR = "record long, address string, code string, town string"


def locations(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FOUR)
    return {r.record: r.location for r in addresses.locate(df, "record", "address", "code", "town").collect()}


def test_one_location(spark):
    rows = SAME + APART + BOX + [(None, "3831", "Heslfossen"), ("", None, None), ("uten tall, 3831 Heslfossen", None, None), ("9" * 100_000, None, None)]
    got = locations(spark, rows)
    assert len({got[i] for i in range(len(SAME))}) == 1
    apart = [got[len(SAME) + i] for i in range(len(APART))]
    assert len(set(apart)) == len(APART) and got[0] not in apart
    assert len({got[len(SAME) + len(APART) + i] for i in range(len(BOX))}) == 1
    assert all(i not in got for i in range(len(rows) - 4, len(rows)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(SAME + SAME[:1])], FOUR)
    located = addresses.locate(df, "record", "address", "code", "town")
    pairs = sorted(map(tuple, addresses.same_location(located.union(located)).collect()))
    assert pairs == list(itertools.combinations(range(len(SAME) + 1), 2))
    assert locations(spark, []) == {}


def test_streets_that_words_ahead_tell_apart(spark):
    rows = [
        ("Øvre Slottsgate 3", "0157", "Oslo"), ("Nedre Slottsgate 3, 0157 Oslo", None, None), ("ØVRE SLOTTSGT. 3, 0157 Oslo", None, None), ("Slottsgata 3", "0157", "OSLO"),
        ("Karl Johans gate 31", "0159", "Oslo"), ("Oslo Karl Johans gt 31, 0159", None, None), ("Sven Johans gate 31, 0159 Oslo", None, None),
        ("Øvre Torvgate 9", "7010", "Trondheim"), ("Torvgata 9, 7010 Trondheim", None, None),
    ]
    got = locations(spark, rows)
    assert got[0] == got[2] and len({got[0], got[1], got[3]}) == 3
    assert got[4] == got[5] != got[6]
    assert got[7] == got[8]


def test_numbers_of_four_digits(spark):
    rows = [("Elveveien 1200", "8630", "Storforshei"), ("Elveveien 1200, 8630 Storforshei", None, None), ("8630 Storforshei, Elvevn. 1200", None, None), ("Elveveien 120", "8630", "Storforshei"), ("Elveveien 1200B", "8630", "Storforshei"), ("Postboks 123456, 8630 Storforshei", None, None), ("Postboks 123457, 8630 Storforshei", None, None)]
    got = locations(spark, rows)
    assert set(got) == set(range(len(rows))) and got[0] == got[1] == got[2]
    assert len({got[i] for i in (0, 3, 4, 5, 6)}) == 5


def test_a_building_with_very_many_records(spark):
    many = 2 * addresses.TOGETHER + 500
    located = spark.range(many).selectExpr("id as record", "'one' as location").union(spark.createDataFrame([(many, "two"), (many + 1, "two"), (many + 2, "three")], "record long, location string"))
    pairs = addresses.same_location(located)
    assert pairs.count() == pairs.distinct().count() == many * (many - 1) // 2 + 1


def test_near():
    assert addresses.near("bever", "bvere", 1) is False and addresses.near("bever", "bveer", 1)
    assert addresses.near("abc", "abd", 1) and addresses.near("abc", "ab", 1) and not addresses.near("abc", "a", 1)


def test_components_against_union_find(spark):
    import random

    rng = random.Random(5)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (7, 8), (7, 8)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert linking.components(spark.createDataFrame([], "a long, b long")).collect() == []


PLACE = "row_id long, place_id string, title string, address string, phone string, web_site string"
COMPANY = "row_id long, organisasjonsnummer string, navn string, hjemmeside string, telefon string, mobil string, forretningsadresse struct<adresse string, postnummer string, poststed string>"


def test_match(spark):
    companies = [
        (1, "111111111", "NORDVIK OG SÆTRE KAFÉ AS", "www.nordvikkafe.example", "12 34 56 78", None, ("Storgata 1", "3831", "HESLFOSSEN")),
        (2, "111111111", "Nordvik og Sætre Kafé AS", None, None, None, None),
        (3, "222222222", "BLÅMYR RØR AS", None, "(+47) 11 11 11 11", None, ("Storgata 1", "3831", "HESLFOSSEN")),
        (4, "333333333", "BLÅMYR SPORT AS", None, None, None, ("Storgata 1", "3831", "HESLFOSSEN")),
        (5, "444444444", "LURVIK TAKST AS", None, "13 13 13 13", None, ("Elvegata 5", "3832", "HESLFOSSEN")),
        (6, None, None, None, None, None, None),
        (7, "555555555", "TVILLING BYGG", None, "14141414", None, ("Nygata 9", "3831", "HESLFOSSEN")),
        (9, "777777777", "FJELLET HOTELL AS", None, None, None, None),
        (8, "666666666", "TVILLING BYGG", None, "14141414", None, ("Nygata 9", "3831", "HESLFOSSEN")),
    ]
    places = [
        (1, "a", "Nordvik Kafé, din lokale ekspert", "Annetsted 4, 2235 Bryndfossen", "0047 12345678", None),
        (2, "b", "Helt Annet Navn", None, "+47 1234 5678", "http://nordvikkafe.example/om"),
        (3, "c", "Rør Blåmyr", "Storgt. 1, Heslfossen", None, None),
        (4, "d", "Nordvik Hotell", "Storgata 1, 3831 Heslfossen", None, None),  # a building only
        (5, "e", "Ukjent Firma", "Sjøgata 2, 3831 Heslfossen", "13131313", None),  # a phone only
        (6, "f", "Lurvik Takst", "Sjøgata 3, 2235 Bryndfossen", "15151515", "lurvik-bryndfossen.example"),  # a name only
        (7, "g", "Tvilling Bygg", "Nygata 9, 3831 Heslfossen", "14141414", None),  # two companies alike
        (8, "h", None, None, None, None),
        (9, None, "Blåmyr Rør", "Storgata 1, 3831 Heslfossen", "11111111", None),
        (10, "c", None, None, None, None),
    ]
    left, right = spark.createDataFrame(places, PLACE), spark.createDataFrame(companies, COMPANY)
    got = {r.place_id: r for r in matching.match(left, right).collect()}
    assert {k: r.organisation_number for k, r in got.items()} == {"a": "111111111", "b": "111111111", "c": "222222222"}
    assert all(0 < r.confidence < 1 for r in got.values())
    again = matching.pairs(left.union(left), right.union(right)).collect()
    assert sorted((r.place_id, r.organisation_number) for r in again) == [("a", "111111111"), ("b", "111111111"), ("c", "222222222")]
    labels = spark.createDataFrame([("a", "111111111", True), ("c", "222222222", False)], "place_id string, organisation_number string, is_match boolean")
    told = {r.place_id: r.confidence for r in matching.match(left, right, labels).collect()}
    assert told["a"] > told["c"]
    assert matching.pairs(left.limit(0), right).collect() == [] and matching.pairs(left, right.limit(0)).collect() == []


def test_names():
    assert matching.related(["blamyr", "ror"], ["blamyr"]) and not matching.related(["ror"], ["blamyr", "ror", "x"])
    assert matching.related(["frotbuner", "energi"], ["frostbuner", "energi"]) and not matching.related(["lomvik", "energi"], ["tarnes", "energi"])


PAGE = "page_id long, source_url string, html string, text string, box string"


def page(n, host="firma.example", sidebar=True, body=None, name=None):
    body = body if body is not None else [f"Overskrift {n}", f"Dette er et eget avsnitt nummer {n} om virksomheten.", f"Enda et avsnitt {n} som bare står her."]
    name = name or (body[0] if body else "Firma AS")
    menu, foot = ["Hjem", "Om oss", "Kontakt"], ["© 2024 Firma AS", "Personvern"]
    box = ["Les også", f"Sak {n}", f"Et sammendrag av sak {n} som … Les mer"]
    lines = menu + (["Arkiv", "Godta alle"] if sidebar else []) + body + box + foot
    html = f"<html><head><title>{name} | Firma AS</title><script>var p='<p>x</p>'</script></head><body><nav>" + "".join(f"<a href='/'>{m}</a><br>" for m in menu) + "</nav>"
    html += "<div class='s'><p>Arkiv<p>Godta alle</div>" if sidebar else ""
    html += "<main>" + (f"<h1>{body[0]}</h1>" + "".join(f"<p>{b}</p>" for b in body[1:]) if body else "") + "</main>"
    html += f"<div class='b'><h3>{box[0]}</h3><h4>{box[1]}</h4><p>{box[2]}</p></div><footer>" + "".join(f"<div>{f}</div>" for f in foot) + "</footer></body></html>"
    return (n, f"https://www.{host}/sider/overskrift{n}", html, "\n".join(lines), "x"), [lines.index(b) + 1 for b in body]


def test_bodies(spark):
    made = [page(n) for n in range(1, 8)] + [page(n, f"annet{n}.example") for n in range(20, 24)] + [page(30, body=[]), page(31, f"en.example", sidebar=False)]
    rows = [m[0] for m in made]
    want = {m[0][0]: m[1] for m in made}
    flat, lines = page(40)
    rows += [(40, flat[1], None, flat[3], "x"), (41, None, None, None, None), (42, "http://[broken", "<p>", "", ""), (43, None, "<<<>&#xD800; <p" * 50, "løs tekst", None)]
    want[40] = lines
    repeat = page(1)[0]
    rows.append((50, *repeat[1:]))
    want[50] = want[1]
    got = {}
    df = spark.createDataFrame(rows, PAGE)
    for r in boilerplate.body_lines(df).collect():
        got.setdefault(r.page_id, []).append(r.line_no)
    got = {k: sorted(v) for k, v in got.items()}
    assert {k: v for k, v in got.items() if k < 41 or k == 50} == {k: v for k, v in want.items() if v}
    assert 41 not in got and 42 not in got
    assert boilerplate.body_lines(df.limit(0)).collect() == []


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "tekst" + "</div>" * 5000
    assert boilerplate.read_page(deep, "tekst", None)["line_no"] == [1]
    many = "\n".join(f"linje {i}" for i in range(20_000))
    assert len(boilerplate.read_page("".join(f"<p>linje {i}</p>" for i in range(20_000)), many, None)["line_no"]) == 20_000


@pytest.mark.parametrize("html", [None, "", "   ", "<![if>", "<a <b <c"])
def test_odd_markup(html):
    assert boilerplate.read_page(html, "a\n\nb", "http://h.example/x")["line_no"] == [1, 3]


def test_two_slips_at_different_places_are_one_street(spark):
    rows = [(1, "Norelysgrend 34A", "7777"), (2, "Nordlysgrnnd 34A", "7777"), (3, "Norelysgrend 35", "7777"), (4, "Nordlysgrnnd 36", "7777"), (5, "Hjorneeggveien 50", "7777"), (6, "Hjoteeggveien 50", "7777")]
    df = spark.createDataFrame([(k, a, c, "Strandvik") for k, a, c in rows], "record long, address string, code string, town string")
    got = addresses.same_location(addresses.locate(df, "record", "address", "code", "town")).collect()
    assert {(r.record_a, r.record_b) for r in got} == {(1, 2), (5, 6)}


def test_lines_behind_a_long_hidden_run_are_placed():
    html = "<body><ul>" + "".join(f"<li>valg {i}</li>" for i in range(80)) + "</ul><div><h1>Om oss</h1><p>Vi bygger.</p></div></body>"
    page = boilerplate.read_page(html, "Om oss\nVi bygger.", "https://a.example/om-oss")
    assert page["line_no"] == [1, 2] and min(page["element"]) > 0


PLACE = "row_id long, place_id string, title string, address string, phone string, web_site string"
COMPANY = "row_id long, organisasjonsnummer string, navn string, hjemmeside string, telefon string, mobil string, forretningsadresse struct<adresse:string, postnummer:string, poststed:string>"


def test_shared_combinations_and_other_names(spark):
    address = ("Storgata 1", "1000", "Fjellvik")
    right = [(1, "900", "Fjell AS", None, "11111111", None, address), (2, "901", "Fjell AS", None, "11111111", None, ("Storgata 2", "1000", "Fjellvik")), (3, "902", "Strand AS", "https://a.example", "12222222", None, address), (4, "902", "Havn AS", "https://b.example", "12222222", None, address)]
    left = [(1, "p1", "Fjell", "Storgata 2, 1000 Fjellvik", "1111 1111", None), (2, "p2", "Havnn", None, "12222222", None), (3, "p3", "Strannd", None, "12222222", None), (4, "p4", "Fjell", None, "11111111", None)]
    got = {r.place_id: r.organisation_number for r in matching.pairs(spark.createDataFrame(left, PLACE), spark.createDataFrame(right, COMPANY)).collect()}
    assert got == {"p1": "901", "p2": "902", "p3": "902"}


def test_words_one_letter_apart_share_a_form():
    for word in ("fjell", "strandkanten", "x" * 39 + "y", "ab" * 30, "kontor" * 20):
        for other in (word[:-1], word[1:], word[:3] + "q" + word[4:], word + "q", word[: len(word) // 2] + word[len(word) // 2 + 1 :]):
            assert set(matching.word_forms([word])) & set(matching.word_forms([other])), (word, other)
    assert sum(map(len, matching.word_forms(["lang" * 50_000]))) < 2_000_000


def test_confidence_is_the_labelled_precision(spark):
    """Rules whose precision is known: a website is right in 90 of 100 cases, a phone with a like name in 60 of 100."""
    right, left, labels = [], [], []
    for i in range(200):
        number, word = f"{900_000_000 + i}", "".join(chr(97 + int(d)) for d in f"{i:05d}") + "fjord"
        right.append((i, number, f"{word} AS", f"https://h{i}.example", f"1{i:07d}", None, (None, None, None)))
        by_site = i < 100
        left.append((i, f"p{i}", "Noe helt annet" if by_site else f"{word}x", None, None if by_site else f"1{i:07d}", f"http://www.h{i}.example/x" if by_site else None))
        labels.append((f"p{i}", number, i % 10 != 0 if by_site else i % 5 < 3))
    frames = spark.createDataFrame(left, PLACE), spark.createDataFrame(right, COMPANY)
    truth = spark.createDataFrame(labels, "place_id string, organisation_number string, is_match boolean")
    sample, held = truth.where("hash(place_id) % 2 = 0"), truth.where("hash(place_id) % 2 <> 0")
    told = matching.match(*frames, sample).join(held, ["place_id", "organisation_number"]).collect()
    assert {r.rule for r in told} == {"website", "phone and similar name"}
    for rule in ("website", "phone and similar name"):
        mine = [r for r in told if r.rule == rule]
        assert abs(mine[0].confidence - sum(r.is_match for r in mine) / len(mine)) < 0.2
    assert {round(r.confidence, 1) for r in told if r.rule == "website"} <= {0.8, 0.9}
