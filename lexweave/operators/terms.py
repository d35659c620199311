"""Terminology: recognition, lookup, concept pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

_RUN = r"([\p{L}\p{N}]+)"


def _folded(c: Column, lang: Column) -> Column:
    return F.when(X.is_latin(lang), F.lower(c)).otherwise(c)


def recognize(segments: DataFrame, terms: DataFrame, keep: tuple[str, ...] = ("seg_id",)) -> DataFrame:
    """(keep..., term_id, source_term, target_term, forbidden, offset, length): every occurrence of a term of the segment's
    languages that has word boundaries, overlapping ones too. Offsets are code points of the (for Latin scripts lower-cased) text.

    A match begins with a run of letters and digits unless the term doesn't, so segments' runs are joined with the terms' first
    runs by equality and the rest is compared at the run's place. Terms that begin otherwise are few; their occurrences are
    searched for in each segment of their languages. Empty terms match nothing.
    """
    t = terms.withColumn("_n", _folded(F.col("source_term"), F.col("src_lang"))).where("_n <> ''")
    t = t.withColumn("_first", F.regexp_extract("_n", r"^[\p{L}\p{N}]+", 0))
    s = segments.withColumn("_h", _folded(F.col("plain"), F.col("src_lang")))
    out = [*keep, "term_id", "source_term", "target_term", "forbidden"]
    # Runs and where each begins: the pieces between runs and the runs add up to the text.
    runs = s.withColumn("_runs", F.regexp_extract_all("_h", F.lit(_RUN), F.lit(1))).withColumn("_gaps", F.split("_h", r"[\p{L}\p{N}]+"))
    placed = runs.select("*", F.posexplode("_runs").alias("_i", "_run"))
    at = F.length(F.array_join(F.slice("_gaps", 1, F.col("_i") + 1), "")) + F.length(F.array_join(F.slice("_runs", 1, F.col("_i")), ""))
    joined = placed.join(t.where("_first <> ''").withColumnRenamed("_first", "_run"), ["_run", "src_lang", "tgt_lang"]).withColumn("offset", at)
    n = F.length("_n")
    hit = (F.substring(F.col("_h"), F.col("offset") + 1, n) == F.col("_n")) & ~X.is_word_char(F.substring(F.col("_h"), F.col("offset") + n + 1, F.lit(1)))
    usual = joined.where(hit).select(*out, "offset", n.alias("length"))
    odd = s.join(t.where("_first = ''"), ["src_lang", "tgt_lang"]).where("instr(_h, _n) > 0")
    places = F.filter(F.sequence(F.lit(1), F.length("_h") - n + 1), lambda p: F.substring(F.col("_h"), p, n) == F.col("_n"))
    odd = odd.select("*", F.explode(places).alias("_p")).withColumn("offset", F.col("_p") - 1).where(X.is_word_boundary(F.col("_h"), F.col("offset"), n))
    return usual.unionByName(odd.select(*out, "offset", n.alias("length")))


def lookup(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms equal to the query once both are normalised, for one pair of languages."""
    q = X.with_normalized(queries, "term", "_n")
    t = X.with_normalized(terms, "source_term", "_n")
    return q.join(t, ["_n", "src_lang", "tgt_lang"]).drop("_n")


def pair_concepts(terms: DataFrame) -> DataFrame:
    """Directed entries from (concept_id, set_no, lang, term, definition, domain, forbidden): within a concept every term of one
    language with every term of another. Of several sets of one language the last counts. Definition and domain come from the
    source, else the target; an entry is forbidden if either term is. Concepts of one language give none.

    One shuffle: the concept's terms are gathered and paired in place (a concept is small by nature)."""
    row = F.struct("lang", "set_no", "term_no", "term", "definition", "domain", "forbidden")
    c = terms.groupBy("concept_id").agg(F.collect_list(row).alias("x"))
    last = F.filter("x", lambda a: ~F.exists("x", lambda b: (b["lang"] == a["lang"]) & (b["set_no"] > a["set_no"])))
    c = c.select("concept_id", last.alias("x")).select("concept_id", "x", F.explode("x").alias("s"))
    p = c.select("concept_id", "s", F.explode("x").alias("t")).where("s.lang <> t.lang")
    return p.select(
        "concept_id",
        F.col("s.term").alias("source_term"),
        F.col("t.term").alias("target_term"),
        F.col("s.lang").alias("src_lang"),
        F.col("t.lang").alias("tgt_lang"),
        F.coalesce("s.definition", "t.definition").alias("definition"),
        F.coalesce("s.domain", "t.domain").alias("domain"),
        (F.col("s.forbidden") | F.col("t.forbidden")).alias("forbidden"),
    )


def is_forbidden(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin("deprecatedterm", "supersededterm"), F.lit(False))


def added(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Entries have no unique key: adding appends."""
    return terms.unionByName(new, allowMissingColumns=True)
