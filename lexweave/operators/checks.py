"""Quality checks: each takes pairs (file_id, seg_no, id, source, target, ...) and returns issues of one schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

ISSUE = ("file_id", "seg_no", "check_id", "severity", "message", "offset", "length")


def _issues(df: DataFrame, check: str, severity: str | Column, message: Column, offset: Column | None = None, length: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("int")
    return df.select(
        "file_id",
        "seg_no",
        F.lit(check).alias("check_id"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        message.alias("message"),
        (null if offset is None else offset.cast("int")).alias("offset"),
        (null if length is None else length.cast("int")).alias("length"),
    )


def empty_translation(pairs: DataFrame) -> DataFrame:
    bad = pairs.where(~X.is_empty(F.col("source")) & F.coalesce(X.is_empty(F.col("target")), F.lit(True)))
    return _issues(bad, "empty_translation", "error", F.lit("Segment has source text but no translation."))


def tag_consistency(pairs: DataFrame) -> DataFrame:
    """Codes of one side whose id the other lacks, once for each id. Needs source_codes and target_codes (arrays of codes); a pair
    without target is not judged."""
    ids = lambda c: F.array_distinct(F.transform(c, lambda x: x["code_id"]))
    judged = pairs.where(F.col("target").isNotNull())

    def missing(one: str, other: str, message: Callable[[Column], Column]) -> DataFrame:
        rows = judged.withColumn("_id", F.explode(F.array_except(ids(F.col(one)), ids(F.col(other)))))
        shown = F.filter(F.col(one), lambda c: (c["code_id"] == F.col("_id")) & c["display_text"].isNotNull())
        label = F.coalesce(F.try_element_at(shown, F.lit(1))["display_text"], F.concat(F.lit("{"), F.col("_id"), F.lit("}")))
        return _issues(rows, "tag_consistency", "error", message(label))

    lost = missing("source_codes", "target_codes", lambda t: F.concat(F.lit("Tag "), t, F.lit(" from source is missing in target.")))
    extra = missing("target_codes", "source_codes", lambda t: F.concat(F.lit("Tag "), t, F.lit(" in target has no match in source.")))
    return lost.unionByName(extra)


#: Decimal and grouping marks by base language; other languages are read like English.
SEPARATORS = {"de": (",", "."), "es": (",", "."), "fr": (",", "   ")}


def numbers(c: Column, lang: Column) -> Column:
    """Values of the number-like pieces of a text, in order and with repeats, as the language writes numbers."""
    tokens = F.transform(F.regexp_extract_all(c, F.lit(r"([+\-]?[0-9][0-9.,\s]*)"), F.lit(1)), X.trim)

    def value(t: Column, decimal: str, group: str) -> Column:
        t = F.translate(t, group, "")
        t = F.replace(t, F.lit(decimal), F.lit("\x00"))
        t = F.replace(F.regexp_extract(t, "^[+\\-]?[0-9]*(?:\x00[0-9]*)?", 0), F.lit("\x00"), F.lit("."))
        return t.try_cast("double")

    def values(decimal: str, group: str) -> Column:
        return F.transform(tokens, lambda t: value(t, decimal, group))

    base = X.base_language(lang)
    out = values(".", ",")
    for k, marks in SEPARATORS.items():
        out = F.when(base == k, values(*marks)).otherwise(out)
    return F.filter(out, lambda x: x.isNotNull())


def shown(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))


def number_mismatch(pairs: DataFrame) -> DataFrame:
    """Every number of the source whose value the target lacks. Needs src_lang and tgt_lang."""
    judged = pairs.where("target <> ''")
    both = judged.withColumns({"_s": numbers(F.col("source"), F.col("src_lang")), "_t": numbers(F.col("target"), F.col("tgt_lang"))})
    rows = both.select("*", F.explode(F.filter("_s", lambda x: ~F.array_contains(F.col("_t"), x))).alias("_v"))
    return _issues(rows, "number_mismatch", "warning", F.concat(F.lit('Number "'), shown(F.col("_v")), F.lit('" from source not found in target (may be intentionally localized).')))


def whitespace_mismatch(pairs: DataFrame) -> DataFrame:
    judged = pairs.where("target <> ''")
    count = lambda f, c: F.length(F.col(c)) - F.length(f(F.col(c)))

    def side(name: str, f: Callable[[Column], Column], offset: Column | None) -> DataFrame:
        rows = judged.withColumns({"_s": count(f, "source"), "_t": count(f, "target")}).where("_s <> _t")
        message = F.concat(F.lit(f"{name} whitespace mismatch: source has "), F.col("_s"), F.lit(" space(s), target has "), F.col("_t"), F.lit("."))
        return _issues(rows, "whitespace_mismatch", "warning", message, offset)

    return side("Leading", X.ltrim, F.lit(0)).unionByName(side("Trailing", X.rtrim, None))


def double_space(pairs: DataFrame) -> DataFrame:
    rows = pairs.where(F.instr("target", "  ") > 0)
    return _issues(rows, "double_space", "info", F.lit("Target contains consecutive spaces."), F.instr("target", "  ") - 1, F.length(F.regexp_extract("target", " {2,}", 0)))


def terminology_violation(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """`found`: terms recognised in the sources (file_id, seg_no, target_term, source_term, forbidden, ...), a row each occurrence."""
    judged = pairs.where("target <> ''").select("file_id", "seg_no", "target").join(found, ["file_id", "seg_no"])
    there = F.contains(F.lower("target"), F.lower("target_term"))
    used = judged.where(F.col("forbidden") & there)
    absent = judged.where(~F.col("forbidden") & ~there)
    forbidden = F.concat(F.lit('Forbidden term "'), F.col("target_term"), F.lit('" used in translation.'))
    approved = F.concat(F.lit('Approved term "'), F.col("target_term"), F.lit('" (for "'), F.col("source_term"), F.lit('") not found in translation.'))
    return _issues(used, "terminology_violation", "warning", forbidden).unionByName(_issues(absent, "terminology_violation", "info", approved))


def segment_consistency(pairs: DataFrame) -> DataFrame:
    """Sources that agree once trimmed but have different targets within a file: an issue for each of their segments, with the
    targets in the order they are first seen."""
    judged = pairs.where("target <> ''").withColumn("_k", X.trim(F.col("source")))
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "target"))), lambda x: x["target"]))
    groups = judged.groupBy("file_id", "_k").agg(texts.alias("_t")).where(F.size("_t") > 1)
    rows = judged.join(groups, ["file_id", "_k"])
    quoted = F.array_join(F.transform("_t", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " | ")
    return _issues(rows, "segment_consistency", "warning", F.concat(F.lit('Source "'), F.col("_k"), F.lit('" has inconsistent translations: '), quoted, F.lit('. This segment: "'), F.col("target"), F.lit('".')))


PAIR_CHECKS: tuple[Callable[[DataFrame], DataFrame], ...] = (empty_translation, tag_consistency, number_mismatch, whitespace_mismatch, double_space)
DOCUMENT_CHECKS: tuple[Callable[[DataFrame], DataFrame], ...] = (segment_consistency,)


def run(pairs: DataFrame, checks: Sequence[Callable[[DataFrame], DataFrame]] = PAIR_CHECKS, documents: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """The issues of all given checks, with check_no in the order given; `orderBy('file_id', 'seg_no', 'check_no')` lists them."""
    out = None
    for i, check in enumerate([*checks, *documents]):
        one = check(pairs).withColumn("check_no", F.lit(i))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no checks given")
    return out


class GateError(Exception):
    """An issue as severe as the gate allows no more."""


def gate(issues: DataFrame, threshold: str) -> None:
    """Raises on the first issue (by file, segment, check) at or above the threshold; one row comes to the driver."""
    level = X.severity_level(F.lit(threshold))
    first = issues.where(X.severity_level(F.col("severity")) >= level).orderBy("file_id", "seg_no", *(["check_no"] if "check_no" in issues.columns else [])).limit(1).collect()
    if first:
        raise GateError(f"{first[0]['severity']}: {first[0]['check_id']} in segment {first[0]['seg_no']}: {first[0]['message']}")

