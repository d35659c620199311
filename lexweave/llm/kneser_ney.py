"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams of trusted text, thresholds by language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType

from .bytegrams import ORDER, Tally, pieces, scored
from .work import drop, pruned, saved

#: One in so many trusted documents of a language is held out of the counts and sets the threshold.
HELD_OUT = 5
QUANTILE = 0.98
#: What a document may exceed the quantile by: log perplexity, and per square root of its bytes (short texts scatter).
SLACK, SHORT_SLACK = 0.12, 4.0


#: n-grams that a task of the counting holds at most, over all languages, before they leave.
ROWS = 8_000_000
#: Bits of the filter that thins out documents before they are shuffled: so many an identifier, and 2 to that power at most.
FILTER_BITS, FILTER_MOST = 16, 28


def likely(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS, most: int = FILTER_MOST) -> DataFrame:
    """docs without most rows whose doc_id is not in the written table ids(doc_id); none of the others is lost. A bitmap of hashes, in
    broadcast blocks of 4096 bits. Identifiers of two types, which may hash apart, are left as they are."""
    kind = docs.schema["doc_id"].dataType
    if kind != ids.schema["doc_id"].dataType or kind not in (LongType(), IntegerType(), StringType()):
        return docs
    mask = (1 << min(most, max(12, (bits * ids.count()).bit_length()))) - 1
    slot = F.xxhash64("doc_id").bitwiseAND(mask)
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 12).alias("block"), F.shiftright("s", 6).bitwiseAND(63).alias("i"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("w")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"))
    blocks = words.select("block", F.transform(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>"), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("w"))
    own = docs.withColumn("_s", slot)
    there = F.getbit(F.get("w", F.shiftright("_s", 6).bitwiseAND(63).cast("int")), F.col("_s").bitwiseAND(63).cast("int")) == 1
    return own.join(F.broadcast(blocks), (F.shiftright("_s", 12) == F.col("block")) & there, "left_semi").drop("_s")


def at_ranks(rows: DataFrame, cell: Column, ranks: Column) -> DataFrame:
    """(lang, c, r, v): of the written rows(lang, v) the values v at the ranks r (from 1) in the array `ranks`, which may
    depend on a language's number of rows, c. Exact: `cell` is an integer that never falls as v grows; its counts tell where a
    rank lies, and only the rows of those cells are sorted, those of each cell in a task."""
    own = rows.withColumn("cell", cell)
    w = Window.partitionBy("lang")
    n = own.groupBy("lang", "cell").agg(F.count("*").alias("n"))
    n = n.withColumn("before", F.sum("n").over(w.orderBy("cell")) - F.col("n")).withColumn("c", F.sum("n").over(w))
    hit = n.withColumn("ranks", F.filter(ranks, lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("n")))).where(F.size("ranks") > 0)
    found = own.join(F.broadcast(hit.select("lang", "cell", "before", "c", "ranks")), ["lang", "cell"])  # a few rows a language
    found = found.withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("lang", "cell").orderBy("v")))
    return found.where(F.array_contains("ranks", F.col("r"))).select("lang", "c", "r", "v")


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, h, held): every document with a text that labels trust, once each."""
    good = pruned(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("q"))
    good = saved(good.where("q = 1").select("doc_id"), "good")
    rows = likely(pruned(docs, "doc_id", "text", "lang").where("text IS NOT NULL"), good).join(good, "doc_id", "left_semi")
    once = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x"))
    once = saved(once.select("doc_id", "x.text", F.coalesce("x.lang", F.lit("")).alias("lang"), F.xxhash64("doc_id", F.lit(1)).alias("h")), "trusted")
    drop(good)
    # The fifth of a language that has the least hashes, and the least of one that has two to four.
    last = F.when(F.col("c") > 1, F.greatest(F.floor(F.col("c") / HELD_OUT), F.lit(1))).otherwise(0)
    last = at_ranks(once.select("lang", F.col("h").alias("v")), F.shiftright("v", 50), F.array(last)).select("lang", F.col("v").alias("last"))
    out = once.join(F.broadcast(last), "lang", "left").withColumn("held", F.coalesce(F.col("h") <= F.col("last"), F.lit(False))).drop("last")  # one row a language
    out._lexweave_path = once._lexweave_path
    return out


def gram_counts(texts: DataFrame, rows: int = ROWS) -> DataFrame:
    """(lang, code, n): how often each n-gram occurs in texts(text, lang); counts of a partition are added up before they move
    (in several lots where it has many)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Tally] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for i, part in pieces(b.column(0)):
                if sum(t.held() for t in by.values()) > rows:
                    yield from counted(by)
                    by = {}
                own = langs[i : i + len(part)]
                for k in {x for x in own}:
                    by.setdefault(k, Tally()).add([t for t, x in zip(part, own, strict=True) if x == k])
        yield from counted(by)

    def counted(by: dict[str, Tally]) -> Iterator[pa.RecordBatch]:
        for k, tally in by.items():
            code, n = tally.result()
            for i in range(0, len(code), 1 << 16):
                c = code[i : i + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(c)), pa.array(c), pa.array(n[i : i + (1 << 16)].astype(np.int64))], names=["lang", "code", "n"])

    return texts.select("text", "lang").mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def kneser_ney_tables(counts: DataFrame) -> DataFrame:
    """The model as back-off tables, from counts(lang, code, n) of n-grams of ORDER bytes.

    Counts below the highest order are continuation counts (distinct bytes before). Each level's counts are joined with
    its contexts' totals and with the level below, sharded by language and n-gram. Discounts are Chen and Goodman's three.
    """
    level = {ORDER - 1: counts}
    for m in range(ORDER - 2, -1, -1):
        mask = (1 << 8 * (m + 1)) - 1
        level[m] = saved(level[m + 1].groupBy("lang", F.col("code").bitwiseAND(mask).alias("code")).agg(F.count("*").alias("n")), f"counts{m}")
    out, below = None, None
    for m in range(ORDER):
        c = level[m]
        n = c.groupBy("lang").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        discount = lambda k, n=n: F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.05), F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))).otherwise(0.5)  # noqa: B023, E731
        d = n.select("lang", *[F.least(discount(k), F.lit(k - 0.05)).alias(f"d{k}") for k in (1, 2, 3)])
        gram = c.withColumn("ctx", F.shiftrightunsigned("code", 8)).join(F.broadcast(d), "lang")  # one row a language
        gram = gram.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        w = Window.partitionBy("lang", "ctx")
        gram = gram.withColumn("total", F.sum("n").over(w)).withColumn("gamma", F.sum("d").over(w) / F.col("total"))
        if m == 0:
            full = gram.withColumn("p", (F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") / 256)
            unseen = gram.groupBy("lang").agg(F.max(F.col("gamma") / 256).alias("p"), F.collect_set("code").alias("s"))
            rest = unseen.select("lang", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(255)).cast("array<bigint>"), "s")).alias("code"), "p")
        else:
            suffix = F.col("code").bitwiseAND((1 << 8 * m) - 1)
            low = below.select(F.col("lang").alias("lang"), F.col("code").alias("suffix"), F.col("p").alias("p_low"))
            full = gram.withColumn("suffix", suffix).join(low, ["lang", "suffix"]).withColumn("p", (F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("p_low"))
            rest = None
        below = saved(full.select("lang", "code", "ctx", "p", "gamma"), f"level{m}")
        rows = below.select("lang", F.lit(m).alias("level"), F.lit(False).alias("is_context"), "code", F.log("p").alias("value"))
        if rest is not None:
            rows = rows.unionByName(rest.select("lang", F.lit(m).alias("level"), F.lit(False).alias("is_context"), "code", F.log("p").alias("value")))
        contexts = below.groupBy("lang", "ctx").agg(F.max("gamma").alias("g")).select("lang", F.lit(m).alias("level"), F.lit(True).alias("is_context"), F.col("ctx").alias("code"), F.log("g").alias("value"))
        rows = rows.unionByName(contexts)
        out = rows if out is None else out.unionByName(rows)
    return saved(out.coalesce(8), "kneser-ney")


def perplexities(docs: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, lang, n_bytes, log_perplexity) of docs(doc_id, lang, text), per byte; null where the language has no model or
    the text no bytes."""
    found = scored(docs, tables, ["doc_id", "lang"], "lang")
    return found.select("doc_id", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("log_prob") / F.col("n_bytes")).alias("log_perplexity"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, keep) for every row of docs(doc_id, text, lang).

    All documents that labels(doc_id, quality) trust are used: the model is trained on four fifths of each language's; all the
    rest (one document where a language has two to four) give the language's threshold: the `quantile` of their perplexities,
    exactly. No document is on both sides, since the model has seen what it is trained on.
    A language with a single trusted document has a model but no threshold, and is kept. A document is kept up to the threshold, plus a
    little that shrinks with its length. perplexity is per byte. An empty or null text, and one whose language (a null
    one is a language too) has no trusted text, has no perplexity and is kept; no labels keep all. A null doc_id
    stays null, repeated rows are scored each, other columns are not read. One pass over the texts beyond the fit;
    tables of up to bytegrams.WORKER_MB are loaded by each worker, larger ones are joined with the documents' n-grams.
    """
    base = pruned(docs, "doc_id", "text", "lang")
    trusted = _trusted(docs, labels)
    counts = saved(gram_counts(trusted.where("NOT held")), "counts")
    tables = kneser_ney_tables(counts)
    judged = perplexities(trusted.where("held"), tables).where("log_perplexity IS NOT NULL")
    slack = lambda: F.lit(SLACK) + F.lit(SHORT_SLACK) / F.sqrt("n_bytes")
    judged = saved(judged.select("lang", (F.col("log_perplexity") - F.lit(SHORT_SLACK) / F.sqrt("n_bytes")).alias("v")), "judged")
    # Between the two values around the quantile, as SQL's percentile.
    spot = (F.col("c") - 1) * F.lit(quantile)
    around = at_ranks(judged, F.floor(F.col("v") * 1024), F.array_distinct(F.array(F.floor(spot) + 1, F.ceil(spot) + 1)))
    between = F.min("v") + (F.max("v") - F.min("v")) * F.max(spot - F.floor(spot))
    limits = {r["lang"]: float(r["limit"]) for r in around.groupBy("lang").agg(between.alias("limit")).collect()}  # one number a language
    drop(judged)
    drop(trusted)
    drop(counts)
    limit = F.lit(None).cast("double")
    for k, v in limits.items():
        limit = F.when(F.coalesce("lang", F.lit("")) == k, F.lit(v)).otherwise(limit)
    limit = limit + slack()
    return perplexities(base, tables).select("doc_id", "lang", "n_bytes", F.exp("log_perplexity").alias("perplexity"), F.exp(limit).alias("threshold"), F.coalesce(F.col("log_perplexity") <= limit, F.lit(True)).alias("keep"))
