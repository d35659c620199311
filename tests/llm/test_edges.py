"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexweave.llm import bpe_count, decontaminate, kneser_ney, mixing, near_dup, pitman_yor, rules, sstable, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over a lazy dog again " * 8000
CLEAN = "one two three four five six seven eight nine ten"
ROWS = [
    (1, CLEAN, "en", "a", len(CLEAN)),
    (2, CLEAN, "en", "a", len(CLEAN)),
    (2, CLEAN, "en", "a", len(CLEAN)),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (None, CLEAN, "en", "b", None),
    (None, None, None, None, None),
    (5, LONG, "fr", "b", len(LONG)),
    (6, " \n\t", "fr", "b", 3),
    (7, "\x00́\U0001f600 ", "de", "c", 4),
    (8, "x", "de", "c", 1),
    (8, "y other text of this id", "de", "c", 1),
]


@pytest.fixture(scope="module", params=["rows", "clashing", "empty"])
def docs(spark, request):
    d = spark.createDataFrame([] if request.param == "empty" else ROWS, SCHEMA)
    if request.param == "clashing":
        for n in ("_d", "_n", "key", "root", "a", "copy_no", "c0", "_gone", "digest", "_k", "score", "`q.r`".strip("`")):
            d = d.withColumn(n, F.lit("z"))
        d = d.select("*", F.col("text").alias("TEXT"), F.lit(1).alias("Doc_ID"))
    return d


@pytest.fixture(scope="module", params=["some", "empty"])
def labels(spark, request):
    rows = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, 1, 0), (None, 1, 1), (99, 0, 1), (8, None, None)]
    return spark.createDataFrame(rows if request.param == "some" else [], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module", params=["some", "empty"])
def bench(spark, request):
    rows = [(0, "Three FOUR, five six seven eight nine TEN"), (1, None), (2, ""), (3, "too short"), (None, CLEAN)]
    return spark.createDataFrame(rows if request.param == "some" else [], "item_id long, text string")


def n(df):
    return len(df.collect())


def test_toxicity(docs, labels):
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == n(docs) and not any(r.is_toxic for r in out)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and n(kept) == n(docs)


def test_near_duplicates(docs):
    out = {(r.doc_id, r.group_id, r.keep) for r in near_dup.near_duplicates(docs).collect()}
    kept = near_dup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r[0] for r in kept.collect()), key=lambda x: (x is None, x))
    if n(docs):
        assert out == {(1, 1, True), (2, 1, False)} and ids == [1, 3, 4, 5, 6, 7, 8, None, None]
        assert [r[1] for r in kept.collect() if r[0] == 8] == ["x"]
    else:
        assert not out and not ids


def test_quality(docs, labels):
    out = kneser_ney.quality(docs, labels).collect()
    assert len(out) == n(docs) and all(r.keep for r in out if r.perplexity is None)
    assert all(r.perplexity is None for r in out if r.n_bytes == 0)


def test_shards(docs):
    out = sstable.token_shards(docs, shard_bytes=100).collect()
    stored = [(i, x) for r in out for i, x in sstable.Reader(bytes(r.sst)).items()]
    assert len(stored) == sum(r[0] is not None for r in docs.collect())
    if n(docs):
        assert sorted(i for i, _ in stored) == [1, 2, 2, 3, 4, 5, 6, 7, 8, 8]
        assert [x for i, x in stored if i in (3, 4)] == [[], []]


def test_token_counts(docs):
    out = bpe_count.token_counts(docs).collect()
    assert len(out) == n(docs) and all(r.n_tokens == 0 for r in out if r.doc_id in (3, 4)) and all(r.n_tokens > 0 for r in out if r.doc_id in (1, 2, 5))


def test_decontamination(docs, bench):
    spans = {tuple(r) for r in decontaminate.contaminated_spans(docs, bench).collect()}
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns and n(out) == n(docs)
    if n(docs) and n(bench):
        assert {i for i, _, _ in spans} == {1, 2, None} and all((x, y) == (0, len(CLEAN)) for _, x, y in spans)
        assert all(r[1] == "" and r[4] == 0 for r in out.collect() if r[0] in (1, 2))
    else:
        assert not spans
    assert [r[1] for r in out.collect() if r[0] == 5] == [LONG] * (n(docs) > 0)


def test_warc(spark):
    rows = [(1, "http://a/ b\n", "<p>x</p>"), (1, "http://a/ b\n", "<p>x</p>"), (None, None, "<p>x</p>"), (2, "u", None), (3, "u", ""), (4, None, "é" * 3_000_000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"offset": F.lit(1), "digest": F.lit("z")})
    out = sorted((str(r.page_id), r.url, len(r.html)) for r in warc.archive_and_read(p, warc.first_captures).collect())
    assert out == [("3", "u", 0), ("4", None, 3_000_000), ("None", None, 8)]
    assert n(warc.archive_and_read(p)) == 5
    assert n(warc.archive_and_read(p.limit(0))) == 0


def test_rules(docs):
    out = rules.quality_rules(docs).collect()
    assert len(out) == n(docs) and all(r.failed == "length" for r in out if r.doc_id in (3, 4, 6))


def test_language_model(docs):
    out = pitman_yor.language_model_scores(docs).collect()
    assert len(out) == n(docs) and all((r.n_bytes, r.log_prob, r.perplexity) == (0, 0, None) for r in out if r.doc_id in (3, 4))
    assert all(1 < r.perplexity < 300 for r in out if r.n_bytes)


def test_mixing(docs):
    out = mixing.mix_sources(docs)
    name = "copy_no_2" if "copy_no" in docs.columns else "copy_no"
    assert out.columns == [*docs.columns, name]
    assert abs(n(out) - n(docs)) <= 4
    assert n(mixing.mix_sources(docs, {})) == 0
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mix_sources(docs, {"a": bad})
        with pytest.raises(ValueError):
            mixing.mix_sources(docs, epochs=bad)
    with pytest.raises(ValueError):
        sstable.token_shards(docs, shard_bytes=0)


def test_pipeline_stages(spark, docs, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        assert n(out) <= n(d) + 4
    assert n(corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path))) == (n(d) > 0)
