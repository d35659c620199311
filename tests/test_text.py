from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import inline
from lexweave.functions import text as X
from lexweave.model import CLOSING, OPENING, STANDALONE, code, text
from lexweave.operators import segmentation
from lexweave.sources import markup


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).head()[0]


def test_trim_leaves_other_blanks(spark):
    assert one(spark, " \t\n\x00a b\u00a0 ", X.trim) == "a b\u00a0"
    assert one(spark, "\u00a0", X.is_empty) is False
    assert one(spark, " \x0b", X.is_empty) is True
    assert one(spark, None, X.trim) is None


def test_graphemes_and_words(spark):
    assert [one(spark, s, X.grapheme_length) for s in ("hello", "", "कित", "नमस्ते")] == [5, 0, 2, 4]
    assert [one(spark, s, X.count_words) for s in ("", "  ", "a b\u00a0c", " one ")] == [0, 0, 3, 1]


def test_normalised_forms(spark):
    df = spark.createDataFrame([("  Cafe\u0301  AU\u00a0Lait\n",), (None,), ("",)], "s string")
    assert [r.n for r in X.with_normalized(df, "s", "n").collect()].count("café au lait") == 1


def test_distance_over_graphemes(spark):
    df = spark.createDataFrame([("नमस्ते", "नमस्त"), ("café", "cafe"), ("", "hello"), ("cat", "dog")], "a string, b string")
    e = X.graphemes_as_code_points(df, ["a", "b"]).select(F.levenshtein("a", "b").alias("d"))
    assert [r.d for r in e.collect()] == [1, 1, 5, 3]


def test_labels_and_languages(spark):
    assert one(spark, "<ns:B/>", X.tag_label) == "B" and one(spark, "x", X.tag_label) == "?" and one(spark, "<B class='x'>", X.tag_name) == "b"
    assert one(spark, "ar-EG", X.is_rtl) and not one(spark, "hi-IN", X.is_latin) and one(spark, "pt-BR", X.mt_target_language) == "PT-BR"
    assert one(spark, "a\\n\\\\n\\t\\\"", X.unescape_po) == 'a\n\\n\t"'


def sentences(spark, s, lang):
    return spark.createDataFrame([(s, lang)], "s string, l string").select(segmentation.sentences(F.col("s"), F.col("l"))).head()[0]


def test_sentences(spark):
    assert sentences(spark, "Hello world. This is a test.", "en-US") == ["Hello world. ", "This is a test."]
    assert len(sentences(spark, "Mr. Smith is here. He called today.", "en")) == 2
    assert len(sentences(spark, "यह पहला वाक्य है। यह दूसरा वाक्य है।", "hi-IN")) == 2
    assert len(sentences(spark, "یہ پہلا جملہ ہے۔ یہ دوسرا جملہ ہے۔", "ur")) == 2
    assert sentences(spark, "  ", "en") == ["  "] and sentences(spark, None, "en") is None
    assert sentences(spark, "One. Two.", "xq") == ["One. ", "Two."] and sentences(spark, "One. Two.", None) == ["One. ", "Two."]


def test_rules_of_srx(spark):
    source = """<srx version="2.0"><body><languagerules><languagerule languagerulename="A"><rule break="no"><beforebreak>x</beforebreak><afterbreak>;</afterbreak></rule>
    <rule><beforebreak>;</beforebreak><afterbreak>\\s</afterbreak></rule></languagerule></languagerules><maprules><languagemap languagepattern="EN.*" languagerulename="A"/></maprules></body></srx>"""
    rules = segmentation.parse_srx(source)
    assert [r.breaks for r in rules.for_language("en-gb")] == [False, True] and rules.for_language("fr") == ()


def test_spanning_code_is_isolated():
    es = [code("1", OPENING, "<b>"), text("Bold text. Also bold."), code("1", CLOSING, "</b>")]
    a, b = segmentation.distribute_codes(es, ["Bold text. ", "Also bold."])
    for part in (a, b):
        codes = [e for e in part if e["kind"] == "c"]
        assert len(codes) == 2 and all(c["is_isolated"] for c in codes)


ELEMENTS = st.lists(st.one_of(st.text("ab <&", min_size=1, max_size=5).map(text), st.sampled_from([code("p", STANDALONE, "<br>"), code("q", STANDALONE, "<x>")])), max_size=6)


@settings(max_examples=50, deadline=None)
@given(ELEMENTS)
def test_placeholders_round_trip(es):
    s, tags = inline.serialize_elements(es)
    back = inline.deserialize_elements(s, tags)
    assert "".join(e["text"] for e in back if e["kind"] == "t") == "".join(e["text"] for e in es if e["kind"] == "t")
    assert [e["data"] for e in back if e["kind"] == "c"] == [e["data"] for e in es if e["kind"] == "c"]


def test_placeholder_text():
    es = [text("Click "), code("a", OPENING, "<b>"), text("here"), code("a", CLOSING, "</b>"), text(".")]
    s, tags = inline.serialize_elements(es)
    assert s == "Click {1}here{/1}." and [t["type"] for t in tags] == ["open", "close"]
    assert inline.deserialize_elements("{9}", [])[0]["data"] == ""


def test_machine_translation_codes(spark):
    codes = {"1": code("a", STANDALONE, "<br>")}
    assert [e["kind"] for e in inline.decode_mt_text('x <x id="1"/> y<x id="7"/>', codes)] == ["t", "c", "t", "t"]
    assert inline.decode_mt_text('x <x id="1"> & y', codes) == [text("x  & y")]


@settings(max_examples=50, deadline=None)
@given(st.text("ab\n \t.", max_size=40))
def test_plain_text_round_trip(s):
    segments, skeleton = markup.parse_plain(s.encode())
    assert markup.rebuild_plain(skeleton, {x["id"]: x["elements"] for x in segments}, "") == s.encode()


def test_html_blocks():
    body = '<html><body><div>lost<p>Hi <b>you</b> &amp; me<br></p><ul><li><a href="x">one</a></li></ul></div></body></html>'
    segments, skeleton = markup.parse_html(body.encode())
    assert [s["plain"] for s in segments] == ["Hi you & me", "one"]
    assert [e["code_type"] for e in segments[0]["elements"] if e["kind"] == "c"] == [OPENING, CLOSING, STANDALONE]
    assert markup.rebuild_html(skeleton, {s["id"]: s["elements"] for s in segments}, "").decode() == body


def test_xml_and_po():
    segments, skeleton = markup.parse_xml(b"<r><s>Hello <b>world</b></s><t><u>A</u><u> </u></t></r>")
    assert [s["plain"] for s in segments] == ["Hello world", "A"]
    assert b"<s>Hello <b>world</b></s>" in markup.rebuild_xml(skeleton, {s["id"]: s["elements"] for s in segments}, "")
    po = 'msgid ""\nmsgstr "head"\n\n#, fuzzy\nmsgid "f"\nmsgstr ""\n\nmsgid "One item"\nmsgid_plural "%d items"\nmsgstr[0] ""\nmsgstr[1] ""\n\nmsgid "a"\n"\\tb"\nmsgstr "old"\n"er"\n'
    segments, skeleton = markup.parse_po(po.encode())
    assert [s["plain"] for s in segments] == ["One item", "a\tb"]
    out = markup.rebuild_po(skeleton, {"seg-1": [text("Un")], "seg-2": [text('x"')]}, "").decode()
    assert 'msgstr[0] "Un"\nmsgstr[1] ""' in out and 'msgstr "x\\""' in out
