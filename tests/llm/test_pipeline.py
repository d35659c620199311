import corpus_pipeline
from lexweave.llm import decontaminate, mixing, near_dup, sstable, tokenizers, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_apply_what_the_operators_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_shards"]
    rows = lambda d: sorted(map(tuple, d.collect()))

    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("is_toxic").collect()}
    one = stage["toxicity"](spark, docs, SF)
    assert rows(one) == [r for r in rows(docs) if r[0] not in toxic]

    gone = {r.doc_id for r in near_dup.near_duplicates(one).where("NOT keep").collect()}
    two = stage["near_duplicates"](spark, one, SF)
    assert gone and rows(two) == [r for r in rows(one) if r[0] not in gone]

    three = stage["decontamination"](spark, two, SF)
    spans = {}
    for r in decontaminate.contaminated_spans(two, bench).collect():
        spans.setdefault(r.doc_id, []).append((r.span_start, r.span_end))
    for a, b in zip(rows(two), rows(three), strict=True):
        t = a[1]
        for x, y in sorted(spans.get(a[0], []), reverse=True):
            t = t[:x] + t[y:]
        assert b == (*a[:1], t, *a[2:4], len(t))

    four = stage["mixing"](spark, three, SF)
    assert rows(four) == rows(mixing.mix_sources(three).drop("copy_no"))

    enc = tokenizers.encoding(tokenizers.DEFAULT_VOCABULARY)
    stored = sorted((i, x) for r in stage["token_shards"](spark, four, SF).collect() for i, x in sstable.Reader(bytes(r.sst)).items())
    assert stored == sorted((r[0], enc.encode_ordinary(r[1])) for r in rows(four))

    assert sorted((i, x) for r in corpus_pipeline.run(spark, SF).collect() for i, x in sstable.Reader(bytes(r.sst)).items()) == stored
