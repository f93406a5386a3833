"""Tokens, splitting, mixing, encodings and leaks."""

import random

import pytest
from pyspark.sql import functions as F

from skarv.llm import encoding, leakage, mixing, splitting
from skarv.llm.tokens import token_count, tokenize

LONG = "\n\n".join(f"Avsnitt {i}. " + "Styret legger vekt på en trygg drift og ser ingen grunn til å endre kursen nå. " * 6 for i in range(40))
HARD = ["å" * 9000, " " * 9000, "\n" * 9000, "日本語" * 3000, "👩‍👩‍👧" * 2000, "x. " * 3000 + "y" * 9000]


@pytest.mark.parametrize("text", [LONG, *HARD])
def test_pieces_cover_the_text(text):
    found = splitting.pieces(text, 512, 64)
    assert len(found) > 1
    at = 0
    for k, (start, length, shared, tokens) in enumerate(found):
        assert tokens <= 512 and start <= at and (shared >= 64 if k else shared == 0) and shared <= 67
        at = start + length
    assert at == len(text)
    own = [text[s : s + n] for s, n, _, _ in found]
    assert all(a[-1:] for a in own)


def test_cuts_are_natural():
    found = splitting.pieces(LONG, 512, 0)
    for start, length, _, _ in found[:-1]:
        assert LONG[start + length - 1] == "\n"


def test_pieces_of_short_texts():
    assert splitting.pieces(None) == [] and splitting.pieces("") == []
    assert splitting.pieces("ett to") == [(0, 6, 0, 2)]
    text = "ord " * 2047 + "ord"
    assert len(tokenize(text)) == 2048 and len(splitting.pieces(text)) == 1
    assert len(splitting.pieces(text + " ord")) > 1


def test_split_frame(spark):
    rows = [(1, LONG, "a"), (1, LONG, "b"), (2, "kort", "c"), (3, None, None), (4, "", "d")]
    out = splitting.split(spark.createDataFrame(rows, "doc_id long, text string, piece_no string"))
    got = out.collect()
    assert {r.doc_id for r in got} == {1, 2} and sum(r.doc_id == 1 for r in got) % 2 == 0
    assert all(len(tokenize(r.piece_text)) <= 2048 for r in got)
    first = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.piece_no)
    assert first[0].piece_text == LONG[: first[0].piece_length]
    assert [r.doc_id for r in splitting.oversized(out.select("doc_id", F.col("piece_text").alias("text")).limit(0)).collect()] == []


def test_token_count(spark):
    df = spark.createDataFrame([(LONG,), (None,), ("",), ("<|endoftext|>",)], "text string")
    got = [r[0] for r in df.select(token_count(F.col("text"))).collect()]
    assert got[0] == len(tokenize(LONG)) and got[1:3] == [0, 0] and got[3] > 1


def test_tempering():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1, "d": 0.0}
    assert mixing.tempered(shares, 1.0) == pytest.approx(shares)
    even = mixing.tempered(shares, 0.0)
    assert even["a"] == pytest.approx(1 / 3) and even["d"] == 0
    for exponent in (0.2, 1.0, 3.0):
        wanted = mixing.entropy(mixing.tempered(shares, exponent))
        assert mixing.bisect_exponent(shares, wanted) == pytest.approx(exponent, abs=1e-6)
    limit = mixing.bisect_exponent(shares, fits=lambda w: w["a"] >= 0.5)
    assert mixing.tempered(shares, limit)["a"] == pytest.approx(0.5, abs=1e-6)


def test_plan_reaches_shares_and_limits():
    tokens = {"a": 1000, "b": 100, "c": 10}
    targets = {"a": (0.5, 2), "b": (0.3, 10), "c": (0.1, 3), "gone": (0.1, 5)}
    got = {b.source: b for b in mixing.plan(tokens, targets)}
    assert {s for s, b in got.items() if not b.reachable} == {"c", "gone"}
    assert sum(b.budget for b in got.values()) == pytest.approx(1110)
    assert got["c"].budget == 30 and got["gone"].budget == 0
    assert got["a"].budget >= 0.5 * 1110 and got["b"].budget >= 0.3 * 1110
    assert all(b.budget <= b.tokens * b.max_repeats + 1e-6 for b in got.values())
    assert mixing.plan({}, {"a": (1.0, 2)})[0].budget == 0 and mixing.plan({}, {}) == []


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "ord " * rng.randrange(1, 60)) for i in range(600)] + [(900, "a", None), (901, "z", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 5), ("c", 0.15, 3), ("d", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats long")
    used = mixing.mix(docs, targets, blocks=16).collect()
    plan = {b.source: b for b in mixing.budgets(docs, targets)}
    for source in "abc":
        got = sum(r.tokens * r.uses for r in used if r.source == source)
        assert abs(got - plan[source].budget) <= 60
        assert max(r.uses for r in used if r.source == source) <= plan[source].max_repeats
        uses = {r.uses for r in used if r.source == source}
        assert max(uses) - min(uses) <= 1
    assert all(r.doc_id not in (900, 901) for r in used)
    report = {r.source: r for r in mixing.report(docs, targets, blocks=16).collect()}
    assert set(report) == {"a", "b", "c", "d"} and report["d"].actual_share == 0
    assert [s for s, r in sorted(report.items()) if not r.reachable] == [r.source for r in mixing.unreachable(docs, targets).orderBy("source").collect()]
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert mixing.mix(docs.limit(0), targets).collect() == []
    assert [r.source for r in mixing.unreachable(docs.limit(0), targets).collect()] == []


CLEAN = ["Kjøp og salg på Åsen", "Øvrig drift på Østlandet", "Rør og båt", "RØR OG BÅT", "Kafé på kaia", "KAFÉ", "Ære være", "Å gå på tur", "Blåbær og øl på båt", "Årets kjøp", "Østfold", "Åsen", "ØSTFOLD ÅSEN ÆRE", "KJØP SALG"]


@pytest.fixture(scope="module")
def written():
    counts: dict = {}
    for text in CLEAN * 3:
        for t in encoding.trigrams(text):
            counts[t] = counts.get(t, 0) + 1
    return counts


@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman"])
def test_misread_utf8_is_restored(written, read_as):
    for text in CLEAN:
        garbled = "Før: " + encoding._decode(text.encode(), read_as)
        if garbled == "Før: " + text:
            continue
        assert encoding.repair(garbled, written)[:3] == (True, "Før: " + text, True)
        twice = encoding._decode(encoding._decode(text.encode(), read_as).encode(), read_as)
        assert encoding.repair(twice, written)[:2] == (True, text)


@pytest.mark.parametrize("pair", [("latin-1", "cp850"), ("latin-1", "cp437"), ("latin-1", "mac_roman"), ("latin-1", "cp1250"), ("latin-1", "cp1251"), ("cp850", "latin-1")])
def test_misread_single_bytes_are_restored(written, pair):
    for text in CLEAN[:4]:
        assert encoding.repair(encoding._decode(text.encode(pair[0]), pair[1]), written)[:2] == (True, text)


@pytest.mark.parametrize("text", [*CLEAN, "São-kaffe og crème fraîche", "Señor Größe", "Чайка Import", "Łąka Bygg", "Žaba Sport", "Œuvre Kunst", "ÂME Interiør", "¡Olé! Mat", "5° og µm", "½ av «uten tull»", "©2024", "Se kode [A] \\ {B}", "Bøker|Kaffe", "Æ&Ø [Drift]", "Hva? Design", "Hvorfor ikke?Spør oss.", "", None, "plain"])
def test_meant_characters_stay(written, text):
    assert encoding.repair(text, written)[:2] == (False, text)


@pytest.mark.parametrize("read_as", ["cp1251", "iso8859-5", "cp1250", "iso8859-2", "cp1253", "iso8859-7", "cp1257"])
def test_letters_of_other_scripts_in_a_word_are_misread_utf8(written, read_as):
    for text in ("Rør og båt", "Blåbær", "på tur"):
        assert encoding.repair(encoding._decode(text.encode(), read_as), written)[:2] == (True, text)
    for text in ("Гёте Бюро", "Γέφυρα", "Чайка ГҐ Импорт"):
        assert encoding.repair(text, written)[0] is False


@pytest.mark.parametrize("chain", [("cp1252", "cp850"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman", "cp1252"), ("latin-1", "cp850", "cp437")])
def test_encodings_misread_one_after_the_other(written, chain):
    for text in ("Blåbær og øl på båt", "KJØP SALG", "Kafé på kaia"):
        garbled = text
        for read_as in chain:
            garbled = encoding._decode(garbled.encode(), read_as)
        damaged, restored, complete, _ = encoding.repair(garbled, written)
        assert damaged and (restored == text or not complete)
        assert restored == text


@pytest.mark.parametrize("text", ["東京タワー", "日本語のテキスト", "مرحبا بالعالم", "שלום", "Fest 🎉 i kveld", "한국어"])
@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "mac_roman"])
def test_other_scripts_misread(written, text, read_as):
    assert encoding.repair(encoding._decode(text.encode(), read_as), written)[:3] == (True, text, True)
    assert encoding.repair(text, written)[:2] == (False, text)


def test_signs_that_meet_letters_by_chance_stay(written):
    for text in ("Vi går på…» sa hun", "Øl fra «Ø»", "«Ærlig» og «Åpen»", "så…” og nå…”", "é¿ og à¡", "работа и её «смысл…»"):
        assert encoding.repair(text, written)[:2] == (False, text)


def test_what_one_pair_of_encodings_made_is_restored_throughout(written):
    assert encoding.repair("R¯r og b‚t", {**written, "b‚t": 9})[0]
    assert encoding.repair("Kj¯p p y¯xw", written)[:3] == (True, "Kjøp p yøxw", True)
    assert encoding.repair("Kj¯p q≈w", written)[:3] == (True, "Kjøp q≈w", False)


def test_lost_characters_are_found(written):
    for text in ("B�t", "R?r og b?t", "Kj?p p? nett"):
        damaged, _, complete, _ = encoding.repair(text, written)
        assert damaged and not complete
    assert encoding.repair("R|r og b}t", written)[:2] == (True, "Rør og båt")


def test_find_damage(spark):
    rows = [(i, t, None) for i, t in enumerate(CLEAN * 3)] + [(900, "BÃ¥t og rÃ¸r", "på " * 100_000 + "bÃ¥t"), (901, None, ""), (902, "Båt", None), (902, "Båt", None)]
    df = spark.createDataFrame(rows, "claim_id long, name string, value string").withColumnRenamed("value", "purpose").withColumn("restored", F.lit("x"))
    got = {(r.claim_id, r.column_name): r for r in encoding.find_damage(df, "claim_id", ("name", "purpose")).collect()}
    assert set(got) == {(900, "name"), (900, "purpose")}
    assert got[(900, "name")].restored == "Båt og rør" and got[(900, "purpose")].restored.endswith("på båt")
    assert encoding.find_damage(df.limit(0), "claim_id", ("name",)).collect() == []


ITEM = "Regn ut hvor mye gjelden i Marpidokil Malermester passerte 69,6 millioner, selv om svaret finnes to steder. Sensor noterte 1997 og ingenting annet. Sammenlign omtalene av hvordan lageret i Gjestnesset rommet 5 paller, til tross for at ingen har rettet opp prosjektledelse."
OTHER = "Undersøk om pantet på 11,3 millioner ble slettet, enda begge sider er enige; øvre grense er blandet, mest på grunn av massetransport. Si hvem som mener at tilbudet på driftsovervåking gjaldt entreprenører."
FILL = "Styret legger vekt på en trygg drift og ser ingen grunn til å endre kursen nå. Varelageret utgjorde 75,6 millioner kroner. "


def brute_share(item, text):
    """The longest common subsequence of words, by the textbook; an upper bound of what passages carry."""
    a, b = leakage.words(item), leakage.words(text)
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / len(a)


def test_leaks(spark):
    w = ITEM.split()
    edited = w[:]
    for i in range(4, len(w), 7):
        edited[i] = "endret"
    texts = {
        1: FILL * 3 + ITEM + FILL,
        2: FILL + ITEM.upper().replace(",", " ,").replace("Å", "å"),
        3: FILL + "\n".join(w).replace("millioner", "millio-\nner"),
        4: FILL + " ".join(edited) + FILL,
        5: FILL + " ".join(w[: len(w) * 7 // 10]) + FILL,
        6: " ".join(w[:14]) + " " + FILL * 2 + " ".join(w[14:28]) + FILL,
        7: FILL + " ".join(w[: len(w) // 4]) + FILL,
        8: FILL * 40,
        9: None,
        10: "",
        11: FILL * 3000 + ITEM,
        12: " ".join(reversed(w)),
        13: ITEM + " " + OTHER,
        14: "?! … --",
    }
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, "")], "item_id long, text string")
    for block in (4096, 1):
        got = {(r.doc_id, r.item_id): r.share for r in leakage.find_leaks(docs, items, block).collect()}
        assert set(got) == {(k, 1) for k in (1, 2, 3, 4, 5, 6, 11, 13)} | {(13, 2)}
    for (doc, item), share in got.items():
        assert 0.5 <= share <= brute_share({1: ITEM, 2: OTHER}[item], texts[doc] if doc != 11 else texts[1]) + 1e-9
    assert leakage.find_leaks(docs.limit(0), items).collect() == [] and leakage.find_leaks(docs, items.limit(0)).collect() == []


def scattered(item, share, parts):
    """The first of ``share`` of the item's words of each of ``parts`` stretches, with other text between."""
    w = leakage.words(item)
    each = -(-len(w) * share // (100 * parts))
    cuts = [len(w) * k // parts for k in range(parts + 1)]
    return FILL.join([""] + [" ".join(w[a : min(a + each, b)]) + " " for a, b in zip(cuts, cuts[1:])] + [""])


def test_half_leaks_in_a_few_passages_are_found():
    items = {k: " ".join(f"{ITEM if k % 2 else OTHER}".split()[k % 5 :]) for k in range(10)}
    index = leakage.Index(list(items.items()))
    for share, parts in ((52, 3), (60, 3), (60, 4)):
        for k, item in items.items():
            texts = [[index.vocabulary.get(w, 0) for w in leakage.words(scattered(item, share, parts))]]
            assert k in {i for _, i, _ in index.leaks(texts)}, (share, parts, k)


def test_items_of_a_few_words_are_found():
    items = {1: "Bratt", 2: "Bratt fjell", 3: "Hva koster melk", 4: "Hvem skrev den korte boken", 5: " ".join(ITEM.split()[:9])}
    index = leakage.Index(list(items.items()))
    for k, item in items.items():
        ids = [[index.vocabulary.get(w, 0) for w in leakage.words(t)] for t in (FILL + item + " " + FILL, FILL)]
        assert (0, k) in {(n, i) for n, i, _ in index.leaks(ids)} and 1 not in {n for n, _, _ in index.leaks(ids)}


def test_long_damaged_texts_take_linear_time(written):
    text = "b?t {x} R|r [y] Kjшp " * 20_000
    damaged, restored, complete, _ = encoding.repair(text, written)
    assert damaged and not complete and restored.count("Kjøp") == 20_000
