import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import clauses, language, links, nested, parse, sanitize, text
from quern.operators import normalize
from quern.sources import pages, scopes

RULES = clauses.ClauseRules(
    kinds={"milk": (("milk", "cream"), ("milk",)), "meat": (("ham",), ("chicken", "beef")), "egg": ((), ("egg", "mayo"))},
    bases={"milk": ("coconut", "oat", "soy", "almond")},
)
GROUPS = [
    ["Παστίτσιο", "pastitsio", "PASTITSIO"],
    ["χταπόδι", "xtapodi", "htapodi", "chtapodi"],
    ["ντολμάς", "ntolmas", "dolmas"],
    ["μπουρέκι", "mpoureki", "boureki", "bureki"],
    ["ψωμί", "psomi"],
    ["αυγά", "avga", "auga"],
]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_title_keys_agree(spark):
    rows = spark.createDataFrame([(k, w) for k, g in enumerate(GROUPS) for w in g], "g int, w string")
    keys = rows.groupBy("g").agg(F.count_distinct(text.title_key(F.col("w"))).alias("n")).collect()
    assert {r["n"] for r in keys} == {1}


@pytest.mark.parametrize("raw, token", [("Ψωμάς", "ψωμασ"), ("ΔΎΟ  αυγά!", "δυο αυγα"), ("Pâté façon Noël", "pate facon noel"), ("Straße", "strasse"), ("", ""), (None, "")])
def test_search_token(spark, raw, token):
    assert one(spark, raw, text.search_token) == token == text.exact_search_token(raw)
    assert one(spark, raw, text.exact_search_token_udf) == token


def test_whole_words_and_beginnings(spark):
    f = lambda c: F.struct(text.contains_words(c, ["ring"]), text.starts_words(c, ["ri"]), text.contains_all(c, ["in", "g b"]))
    assert tuple(one(spark, "a ring bolt", f)) == (True, True, True)
    assert tuple(one(spark, "spring bolt", f)) == (False, False, True)


def test_neighbourhood_reaches_three_each_way(spark):
    rows = one(spark, ["a", "b", "c", "d", "e"], lambda c: text.neighbourhood(c), "array<string>")
    assert [r["near"] for r in rows][0] == ["a", "b", "c", "d"]
    assert [r["near"] for r in rows][4] == ["b", "c", "d", "e"]
    assert [r["previous"] for r in rows] == [None, "a", "b", "c", "d"]


def test_ordered_distinct_keeps_the_first(spark):
    assert one(spark, ["Β b", "B B", "ä", "A"], lambda c: text.ordered_distinct(c, text.search_token), "array<string>") == ["Β b", "B B", "ä"]


@pytest.mark.parametrize("raw, key", [("123", None), ("abc", None)])
def test_stable_key(spark, raw, key):
    import hashlib

    assert one(spark, raw, parse.stable_key) == pytest.approx(int.from_bytes(hashlib.sha256(raw.encode()).digest()[:8], "big") / 2**64, abs=0)


def test_ease_bands(spark):
    rows = spark.createDataFrame([(0, 0), (3, 1), (0, 10), (1, 5), (2, 5), (None, 3), (1, 6)], "p int, s int")
    assert [r[0] for r in rows.select(parse.ease(F.col("p"), F.col("s"))).collect()] == ["unknown", "involved", "involved", "easy", "moderate", "easy", "moderate"]


def test_numbers_and_times(spark):
    assert [one(spark, x, parse.safe_number) for x in ("1,5", "-3", "x", None)] == [1.5, 0.0, 0.0, 0.0]
    assert one(spark, "2024-01-01T00:00:00Z", parse.epoch_millis) == 1704067200000
    assert one(spark, "2024-01-01 00:00:00", parse.epoch_millis) == 0
    assert one(spark, "not here at all", lambda c: parse.shortened(c, 10)) == "not here…"


def test_sections(spark):
    rows = spark.createDataFrame([([{"t": "a", "steps": ["x", "y"]}, {"t": "b", "steps": ["z"]}],)], "s array<struct<t:string,steps:array<string>>>")
    r = rows.select(nested.nested_count(F.col("s"), "steps").alias("n"), nested.positions(F.col("s"), "steps").alias("p")).first()
    assert r["n"] == 3 and [(x["number"], x["item"]) for x in r["p"]] == [(1, "x"), (2, "y"), (3, "z")]


def test_canonical_json_leaves_defaults_out(spark):
    df = spark.createDataFrame([(1, "", "b")], "z int, y string, a string")
    assert df.select(nested.without_defaults(df, {"y": ""})).first()[0] == '{"a":"b","z":1}'


def test_page_text_and_data():
    source = '<html lang="el"><head><title>T</title><script type="application/ld+json">{"@graph":[{"@type":"http://schema.org/Recipe","name":"x"}]}</script></head><body><p>a &amp;amp; b<br>c<script>no</script></p></body></html>'
    assert pages.page_text(source) == "T\na & b\nc"
    assert pages.nodes_of(json.loads('{"@graph":[{"@type":["Thing","http://s/Recipe"],"name":"x"}]}'), "Recipe")[0]["name"] == "x"


def test_reference_table_stops_at_cycles():
    assert pages.resolved([{"a": 1, "b": 2}, "x", [0, 1]]) == {"a": "x", "b": [None, "x"]}


def test_parsed_pages(spark):
    df = spark.createDataFrame([(1, '<html lang="en"><a href="/x">y</a>'), (2, None)], "page_id long, html string")
    assert [(r["lang"], r["n_links"], r["text"], r["data"]) for r in pages.parsed_pages(df).orderBy("page_id").collect()] == [("en", 1, "y", "[]"), ("", 0, "", "[]")]


@pytest.mark.parametrize("raw, minutes", [("PT1H30M", 90), ("P1DT2H", 1560), ("PT45S", 1), ("PT0.5H", 30), ("soon", None), ("P", None), ("PT", None), ("pt20m", 20), ("PT5M3H", None), ("P1H", None), ("PT1D", None), ("P2D", 2880), (None, None), ("", None), ("PT1H1H", None)])
def test_durations(spark, raw, minutes):
    assert one(spark, raw, parse.iso_minutes) == minutes


@pytest.mark.parametrize("raw, minutes", [("2 hours and 15 minutes", 135), ("1,5 ώρες", 90), ("about 40", 40), ("none", 0), ("1 day", 1440), ("", 0), ("ΔΥΟ 2 ΩΡΕΣ", 2), ("3 ΏΡΕΣ", 180)])
def test_waits(spark, raw, minutes):
    assert one(spark, raw, parse.wait_minutes) == minutes


@pytest.mark.parametrize("raw, parts", [
    ("2 cups flour, sifted", ("2", "cups", "flour", "sifted")), ("1/2 kg sugar", ("1/2", "kg", "sugar", "")), ("3 eggs", ("3", "", "eggs", "")), ("salt", ("", "", "salt", "")), ("2 x 400 g tins", ("", "", "2 x 400 g tins", "")),
    ("1 ½ l milk, warm", ("1 ½", "l", "milk", "warm")), ("500 γρ. αλεύρι, κοσκινισμένο", ("500", "γρ", "αλεύρι", "κοσκινισμένο")), ("2-3 κουταλιές λάδι", ("2-3", "κουταλιές", "λάδι", "")), ("1 1/2 cup water", ("1 1/2", "cup", "water", "")), ("200 g", ("", "", "200 g", "")), ("2 large onions", ("2", "", "large onions", "")), (None, ("", "", "", "")), ("½ lemon", ("½", "", "lemon", "")),
])
def test_measured_lines(spark, raw, parts):
    assert tuple(one(spark, raw, parse.measured)) == parts


@pytest.mark.parametrize("raw, minutes", [("30-45 min", 45), ("1 hour, 30 minutes", 90), ("30 min or so", 0), ("soon", 0)])
def test_strict_minutes(spark, raw, minutes):
    assert one(spark, raw, parse.strict_minutes) == minutes


def test_addresses(spark):
    raw = ["http://www.example.com/a", "https://user:pw@example.com/a", "https://example.com:8080/a", "https://WWW.Example.com/a/b/?q=1#f", "https://example.com", "ftp://x", None]
    assert [one(spark, x, parse.canonical_url) for x in raw] == [None, None, None, "https://example.com/a/b", "https://example.com", None, None]
    assert one(spark, raw[3], lambda c: parse.canonical_url(c, ("other.org",))) is None
    assert [one(spark, x, parse.page_key) for x in raw] == ["example.com/a", "example.com/a", "example.com/a", "example.com/a/b", "example.com", None, None]


@pytest.mark.parametrize("raw", ["Ș ș Ț", "Tiếng Việt", "ﬁn ﬂat", "ＦＵＬＬ ｗｉｄｔｈ", "x² ½ cup", "ǅ ĳ", "Ω Ά ΐ"])
def test_folding_is_the_full_decomposition(spark, raw):
    assert one(spark, raw, text.search_token) == text.exact_search_token(raw)


def test_every_letter_folds_as_its_decomposition(spark):
    letters = [chr(c) for c in range(0xA0, 0x2000) if unicodedata.category(chr(c)) in ("Ll", "Lo", "Nd", "No") and unicodedata.normalize("NFKD", chr(c)) != chr(c)]
    df = spark.createDataFrame([(c,) for c in letters], "x string").select("x", text.search_token(F.col("x")).alias("t"))
    wrong = {r["x"]: r["t"] for r in df.collect() if r["t"] != text.exact_search_token(r["x"]) and " " not in text.exact_search_token(r["x"])}
    assert not wrong


@pytest.mark.parametrize("clause, animal", [("chicken breast", True), ("coconut milk", False), ("oat milk or cream", True), ("sauce without eggs", False), ("vegan mayonnaise", False), ("2 eggs", True), (None, False)])
def test_clauses(spark, clause, animal):
    assert one(spark, clause, lambda c: clauses.unqualified(c, RULES)) is animal


@pytest.mark.parametrize("steps, total, n", [(["Mix. Leave for 2 hours.", "Serve"], 60, 1), (["You can leave it for 2 hours."], 60, 0), (["Bake 30 minutes."], 60, 0), (["Chill overnight."], 20, 1), (["Leave for 2 hours."], 0, 0)])
def test_timing(spark, steps, total, n):
    df = spark.createDataFrame([(steps, total)], "s array<string>, t int")
    assert len(df.select(clauses.timing_contradictions(F.col("s"), F.col("t"))).first()[0]) == n


def test_document_ids(spark):
    assert [one(spark, x, lambda c: parse.document_id(F.lit("x"), c)) for x in ("12", "a-1")] == ["12", "x_a-1"]


def test_media_and_links(spark):
    same = ["https://www.youtube.com/watch?t=3&v=abcdefghijk", "https://youtu.be/abcdefghijk?si=1", "https://m.youtube.com/shorts/abcdefghijk", "https://www.youtube-nocookie.com/embed/abcdefghijk"]
    assert {one(spark, x, links.media_identity) for x in same} == {"video:abcdefghijk"}
    assert one(spark, "https://www.I.org/p/a-640x480.JPG?w=2", links.media_identity) == "image:i.org/p/a.jpg"
    assert one(spark, "https://x.org/r/a_1?x#y", lambda c: links.shared_id(c, "https://x.org/r")) == "a_1" and one(spark, "https://evil.org/r/a", lambda c: links.shared_id(c, "https://x.org/r")) is None


def test_language_gates(spark):
    assert [one(spark, x, lambda c: language.declared(c, "el")) for x in ("el", "EL_gr", " el-GR", "ell", None)] == [True, True, True, False, False]
    greek = "\\p{InGreek}"
    assert [one(spark, x, lambda c: language.substantive(c, greek, "a-z")) for x in ("Μια συνταγή", "ab αβ", "α")] == [True, False, False]


@pytest.mark.parametrize("raw, clean", [
    ('{"b":1,"a":[true,null,"x"]}', '{"a":[true,null,"x"],"b":1}'), ('{"a":1,"a":2}', None), ('{"":1}', None), ('{"a":NaN}', None), ('{"a":1e999}', None), ('{"a":9223372036854775808}', None), ('{"a":-9223372036854775808}', '{"a":-9223372036854775808}'),
    ("[" * 32 + "]" * 32, "[" * 32 + "]" * 32), ("[" * 40 + "]" * 40, None), ("oops", None), (None, None), ("[" * 5000, None),
])
def test_sanitized(spark, raw, clean):
    assert sanitize.sanitized(raw) == clean and one(spark, raw, sanitize.sanitized_json) == clean


@pytest.mark.parametrize("sentence, total, n", [("Bake for half an hour.", 20, 1), ("Bake for half an hour.", 45, 0), ("Simmer two hours.", 60, 1), ("Rest 1/2 hour.", 20, 1), ("Rest 1/0 hour.", 20, 0), ("Cook 10 minutes or 2 hours.", 60, 0), ("Cook for 2 hours.", 60, 1), ("Bake 20 to 90 minutes.", 30, 0), ("Bake twenty minutes.", 30, 0)])
def test_timing_in_words(spark, sentence, total, n):
    df = spark.createDataFrame([([sentence], total)], "s array<string>, t int")
    assert len(df.select(clauses.timing_contradictions(F.col("s"), F.col("t"))).first()[0]) == n


def test_scopes():
    page = '<div class="a b"><p>one<div class="a">two</div></p></div><img><div class="ab">no</div><div class="a">three<script>x</script>'
    assert scopes.scoped_texts(page, {"a": ("div", "a"), "p": ("p", "")}) == {"a": ["onetwo", "three"], "p": ["onetwo"]}
    assert scopes.scoped_texts(None, {"a": ("div", "")}) == {"a": []}


def test_anchors(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], ["a b", "c"]), (["a", "b"], ["a"]), (["a"], ["x"]), ([], []), (["a", "b", "c", "d", "e"], ["a b c d e"])], "s array<string>, a array<string>")
    assert [r[0] for r in rows.select(normalize.anchored(F.col("s"), F.col("a"))).collect()] == [[[0, 1], [2]], None, None, [], None]
