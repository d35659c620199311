import pytest
from pyspark.sql import functions as F

from lexweave.functions import sketch
from lexweave.functions import text as X
from lexweave.operators import memory, translate
from lexweave.plans import workflow
from lexweave.sources import exchange
from lexweave.streaming import stream

SCHEMA = "src_lang string, tgt_lang string, source_text string, target_text string, ord long"


def rows(spark, *texts, first=0):
    return spark.createDataFrame([("en", "xx", t, f"{t} {i}", first + i) for i, t in enumerate(texts)], SCHEMA)


def test_stream_upserts_touched_buckets_and_counts_a_repeated_batch_once(spark, tmp_path):
    src, table = f"{tmp_path}/in", f"file://{tmp_path}/memory"
    parts = [("a", "b", "c"), ("b", "d"), ("a", "e", "a")]
    for i, p in enumerate(parts):
        rows(spark, *p, first=10 * i).coalesce(1).write.mode("append").parquet(src)
        stream.start(stream.documents(spark, src, SCHEMA), table, lambda b: b, f"file://{tmp_path}/state").start().awaitTermination()
    want = memory.upsert(memory.prepared(spark.read.schema(SCHEMA).parquet(src)))
    key = lambda d: sorted((r.source_norm, r.target_text) for r in d.collect())
    assert key(stream.current(spark, table)) == key(want) and len(key(want)) == 5
    # The last batch once more: as after a failure.
    stream.upsert_into(table, lambda b: b)(rows(spark, *parts[2], first=20), 2)
    assert key(stream.current(spark, table)) == key(want)
    stream.upsert_into(table, lambda b: b)(rows(spark), 3)
    assert key(stream.current(spark, table)) == key(want)


def test_rows_delivered_again_are_dropped(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:00:30")], "doc_id long, t string").withColumn("t", F.to_timestamp("t"))
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = stream.once(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), "t")
    s.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.doc_id for r in spark.table("seen").collect()) == [1, 2]


def test_xliff_keeps_texts_with_colons_and_prefixes():
    unit = '<trans-unit id="1"><source>see note:abc and <ph id="1" q:equiv-text="x:y">&lt;br/&gt;</ph> mailto:bob</source><target state="final">a &lt;b:c&gt; d:e</target></trans-unit>'
    r = exchange.parse_trans_unit(unit)
    assert (r["source_text"], r["target_text"], r["status"]) == ("see note:abc and  mailto:bob", "a <b:c> d:e", "approved")
    assert r["source_elements"][1]["display_text"] == "x:y"


def test_each_tmx_file_has_its_own_source_language_and_is_imported_in_order(spark, tmp_path):
    for name, lang, texts in (("a", "en", ("one", "two", "one")), ("b", "fr", ("trois",))):
        other = {"en": "fr", "fr": "en"}[lang]
        body = "".join(f'<tu tuid="{i}"><tuv xml:lang="{other}"><seg>{t} {i}</seg></tuv><tuv xml:lang="{lang}"><seg>{t}</seg></tuv></tu>\n' for i, t in enumerate(texts))
        (tmp_path / f"{name}.tmx").write_text(f'<?xml version="1.0"?>\n<tmx version="1.4"><header srclang="{lang}"/><body>{body}</body></tmx>')
    read = exchange.read_tmx(spark, f"file://{tmp_path}")
    assert sorted((r.src_lang, r.tgt_lang, r.source_text) for r in read.collect()) == [("en", "fr", "one"), ("en", "fr", "one"), ("en", "fr", "two"), ("fr", "en", "trois")]
    empty = memory.prepared(spark.createDataFrame([], "tu_id long, src_lang string, tgt_lang string, source_text string, target_text string"))
    got = {r.source_norm: r.target_text for r in memory.imported(empty, read).collect()}
    assert got == {"one": "one 2", "two": "two 1", "trois": "trois 0"}


def test_sketches_lose_nothing():
    import random

    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(300):
        a = "".join(rng.choices("abcdeéß \U0001f600", k=rng.randrange(0, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choices("abxyz", k=rng.randrange(2))
        b = "".join(b)
        one, two = sketch.bits([a, b])
        unlike = lambda names: sum(bin((int(x) ^ int(y)) & (1 << 64) - 1).count("1") for x, y in zip(one[names], two[names], strict=True))
        d = distance(a, b)
        assert unlike(slice(0, sketch.ONE)) <= 2 * d - abs(len(a) - len(b)) and unlike(slice(sketch.ONE, None)) <= 4 * d - abs(len(a) - len(b))


def test_setting_elements_sets_the_text(spark):
    e = F.array(F.struct(F.lit("t").alias("kind"), F.lit("x").alias("text")), F.struct(F.lit("c").alias("kind"), F.lit(None).cast("string").alias("text")))
    assert X.with_elements(spark.range(1), e).head()["plain"] == "x"


@pytest.fixture(scope="module")
def project(spark):
    null = {k: None for k in ("code_id", "code_type", "data", "display_text", "is_isolated")}
    t = lambda s: {"kind": "t", "text": s, **null}
    c = lambda kind: {"kind": "c", "text": None, "code_id": "1", "code_type": kind, "data": "<b>", "display_text": None, "is_isolated": False}
    segments = [(1, i, f"seg-{i}", [c("opening"), t(s), c("closing")], s, "en", "xx") for i, s in enumerate(("alpha beta", "gamma delta", "alpha beta"), 1)]
    schema = "file_id long, seg_no int, id string, elements array<struct<kind:string,text:string,code_id:string,code_type:string,data:string,display_text:string,is_isolated:boolean>>, plain string, src_lang string, tgt_lang string"
    units = spark.createDataFrame([(7, "en", "xx", "alpha beta", "A B", [t("A B")])], "tu_id long, src_lang string, tgt_lang string, source_text string, target_text string, target_elements " + schema.split("elements ")[1].split(", plain")[0])
    return spark.createDataFrame(segments, schema), memory.prepared(units)


def test_workflow_checks_the_target_s_own_codes_and_writes_back_in_order(spark, project):
    segments, units = project
    r = workflow.process(segments, units, provider=translate.StubProvider(), options=workflow.Options(mt_fill=0.5, write_back=True))
    pairs = {p.seg_no: p for p in r.pairs.collect()}
    assert [pairs[i].origin for i in (1, 2, 3)] == ["exact", "mt", "exact"]
    assert [x.code_type for x in pairs[2].target_elements if x.kind == "c"] == ["opening", "closing"]
    missing = {(i.seg_no, i.check_id) for i in r.issues.collect()}
    assert (1, "tag_consistency") in missing and (3, "tag_consistency") in missing and (2, "tag_consistency") not in missing
    back = {m.source_norm: m.target_text for m in r.memory.collect()}
    assert back["alpha beta"] == "A B" and set(back) == {"alpha beta", "gamma delta"}
    assert "<bpt" in r.xliff.head()["xliff"].split("<target")[2]
    r.release()
