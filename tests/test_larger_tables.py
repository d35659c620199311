"""What the queries' plans and functions must keep to on tables larger than these tests': no file is parsed twice, none travels,
batches are bounded by bytes."""

import io
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.functions import arrow, sketch
from lexweave.functions import text as X
from lexweave.operators import memory
from lexweave.plans import catalogue
from lexweave.plans.round_trips import MAKERS
from lexweave.sources import exchange, files, markup, office

from .comparing import same, views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [*(f"{f}_targets" for f in MAKERS), "html_rebuild", "plain_rebuild"])
def test_files_are_rebuilt_where_they_lie(spark, name):
    p = plan(catalogue.QUERIES[name](spark, SF))
    assert "Join" not in p and "Exchange" not in p
    assert p.count("ArrowEvalPython") <= 4  # made, parsed, rebuilt, parsed


@pytest.mark.parametrize("name", [*(f"{f}_lines" for f in MAKERS), "html_segments", "plain_units"])
def test_files_are_parsed_once(spark, name):
    p = plan(catalogue.QUERIES[name](spark, SF))
    assert p.count("ArrowEvalPython") == (1 if name in ("html_segments", "plain_units") else 2)


def test_rebuilding_from_a_table_of_segments_broadcasts_none(spark):
    d = spark.createDataFrame([(1, b"a\n\nb"), (2, b""), (3, b"c")], "k long, content binary")
    x = files.extract(d, format="plaintext")
    s = files.segments_of(x, "k").select("k", "id", F.col("elements").alias("source_elements"), F.when(F.col("seg_no") == 1, F.transform("elements", lambda e: e.withField("text", F.upper(e["text"])))).alias("target_elements"))
    again = files.rebuild(x.select("k", "skeleton"), s, "plaintext", "k")
    assert "BroadcastHashJoin" not in plan(again)
    assert {r.k: bytes(r.content) for r in again.collect()} == {1: b"A\n\nb", 2: b"", 3: b"C"}


def test_pieces_are_bounded_by_bytes():
    a = pa.array(["x" * 1000] * 5000)
    parts = [p for (p,) in arrow.pieces((a,), 100_000)]
    assert max(map(len, parts)) <= 100 and pa.concat_arrays(parts).equals(a)


def test_values_of_nested_slices():
    kind = pa.list_(pa.struct([("a", pa.string()), ("m", pa.map_(pa.string(), pa.int32())), ("b", pa.bool_())]))
    rows = [[{"a": "x", "m": [("k", 1)], "b": True}, None], None, [], [{"a": None, "m": None, "b": None}, {"a": "é", "m": [], "b": False}]]
    a = pa.array(rows, kind)
    assert arrow.values(a) == rows and arrow.values(a.slice(1)) == rows[1:] and arrow.values(a.slice(3, 1)) == rows[3:] and arrow.values(a.slice(4)) == []


def test_plain_units_have_blank_chunks_as_the_sql_has(spark, tmp_path):
    texts = ["", " ", "a\n\nb", "\n\na", "a\n\n", "a\n\n \n\nb", "a\r\n\r\n\r\nb", "\x0b", "\n", "a\n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = views(SF)
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(catalogue.plain_units(spark, str(tmp_path)), con.sql(catalogue.ORACLE_SQL["plain_units"]))
    assert [s["plain"] for s in markup.parse_plain(b"\n\na\n\n \n\nb")[0]] == ["a", "b"]


def test_archives_written_here_are_archives():
    parts = {"a/é.xml": "ü".encode() * 1000, "b.bin": b"", "c": b"\x00" * 10}
    with zipfile.ZipFile(io.BytesIO(office.write_zip(parts, lambda n: n == "c"))) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == parts
        assert [i.compress_type for i in z.infolist()] == [zipfile.ZIP_DEFLATED, zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED]


def test_texts_are_split_once(spark):
    p = plan(catalogue.sentence_split(spark, SF))
    assert p.count(r"(?U)\S") == 1


def test_texts_are_normalised_as_before(spark):
    texts = ["\u00a0A  b\u2003c ", "e\u0301 X", "\t\x0b\x00É\n", "", "Å"]
    got = [r.n for r in X.with_normalized(spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1), "t", "n").sort("i").collect()]
    assert got == ["a b c", "é x", "é", "", "å"]


def test_units_are_sorted_by_a_hash_first(spark):
    first = [line.split("Sort [")[1].split("#")[0] for line in plan(memory.upsert(catalogue.units(spark, SF))).split("\n") if "Sort [" in line]
    assert first and all(x in ("_h", "_groupingexpression") for x in first)


def test_at_a_least_score_of_1_only_the_key_is_joined(spark):
    u = memory.prepared(spark.createDataFrame([(1, "en", "xx", "A b", "t1"), (2, "en", "xx", "a c", "t2")], "tu_id long, src_lang string, tgt_lang string, source_text string, target_text string"))
    q = memory.prepared(spark.createDataFrame([(7, "en", "xx", "a  B"), (8, "en", "xx", "")], "query_id long, src_lang string, tgt_lang string, source_text string"))
    found = memory.fuzzy(q, u, 1.0)
    assert "levenshtein" not in plan(found) and [(r.query_id, r.tu_id, r.score) for r in found.collect()] == [(7, 1, 1.0)]


def test_sketches_of_pieces_are_those_of_the_whole():
    texts = ["abc" * 50, "", None, "xyz" * 900, "ü", "w" * 5000, ""]
    whole, most = sketch.bits([t or "" for t in texts]), sketch.MOST_CHARS
    try:
        for sketch.MOST_CHARS in (1, 100, 3000, 10**6):
            assert (sketch._sketch.func(pd.Series(texts)).to_numpy() == whole).all()
        assert len(sketch._sketch.func(pd.Series([], dtype=object))) == 0
    finally:
        sketch.MOST_CHARS = most


def test_large_xliff_files_are_written_unit_by_unit(spark, tmp_path):
    units = spark.range(2000).select((F.col("id") % 3).alias("file_id"), F.col("id").alias("seg_no"), exchange.trans_unit(F.col("id").cast("string"), F.lit(False), F.lit("translated"), F.concat(F.lit("s "), "id"), F.lit("t")).alias("unit"))
    heads = spark.range(4).select(F.col("id").alias("file_id"), F.concat(F.lit("f & "), "id").alias("original"), F.lit("en").alias("src_lang"), F.lit("xx").alias("tgt_lang"), F.lit("text/plain").alias("mime"), F.lit("x").alias("skeleton_href"))
    exchange.write_xliff_units(units, heads, f"file://{tmp_path}/x")
    docs = [ET.fromstring(p.read_text()) for p in (tmp_path / "x").glob("part-*") if p.stat().st_size]
    local = lambda e, n: [x for x in e.iter() if x.tag.endswith("}" + n)]
    found = {}
    for f in (f for d in docs for f in local(d, "file")):
        found.setdefault(f.get("original"), []).append([int(u.get("id")) for u in local(f, "trans-unit")])
    assert {k: sorted(i for part in v for i in part) for k, v in found.items()} == {f"f & {k}": [i for i in range(2000) if k < 3 and i % 3 == k] for k in range(4)}
    assert all(part == sorted(part) for v in found.values() for part in v)
    assert exchange.read_xliff(spark, f"file://{tmp_path}/x").count() == 2000


def test_identifiers_of_codes_are_made_once_for_all_elements(spark):
    e = F.col("elements")
    d = spark.range(1).select(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text"), F.lit(i).alias("code_id"), F.lit(ct).alias("code_type"), F.lit("<b>").alias("data"), F.lit(False).alias("is_isolated")) for k, t, i, ct in (("c", None, "7", "opening"), ("t", "x", None, None), ("c", None, "7", "closing"), ("c", None, "3", "standalone"))]).alias("elements"))
    out = d.select(exchange.tmx_content(e).alias("x"), exchange.tmx_content(F.when(F.lit(False), e)).alias("n"))
    assert (out.head().x, out.head().n) == ('<bpt i="1">&lt;b&gt;</bpt>x<ept i="1">&lt;b&gt;</ept><ph i="2">&lt;b&gt;</ph>', None)
    made = exchange.tmx_content(e)._jc.toString()
    assert made.index("array_distinct") < made.index("array_join")


def test_placeholders_are_made_once_in_bounded_batches(spark):
    spark.conf.unset(arrow.BATCH)
    p = plan(catalogue.QUERIES["placeholders"](spark, SF))
    assert p.count("ArrowEvalPython") == 1 and spark.conf.get(arrow.BATCH, None) == str(arrow.BATCH_BYTES)
