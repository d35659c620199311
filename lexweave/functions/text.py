"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The characters that the trimming used throughout removes: ASCII blanks and NUL, not U+00A0.
BLANKS = " \t\n\r\0\x0b"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def ltrim(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def plain_text(elements: Column) -> Column:
    return F.array_join(F.transform(F.filter(elements, lambda e: e["kind"] == "t"), lambda e: e["text"]), "")


def with_elements(df: DataFrame, elements: Column, to: str = "elements", plain: str = "plain") -> DataFrame:
    """Sets a segment's elements, and its plain text with them."""
    return df.withColumn(to, elements).withColumn(plain, plain_text(F.col(to)))


def inline_codes(elements: Column) -> Column:
    return F.filter(elements, lambda e: e["kind"] == "c")


def is_empty(plain: Column) -> Column:
    return trim(plain) == ""


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Evaluated once, where it stands: else the optimizer would repeat it in what is made of it.
_nfc = _nfc.asNondeterministic()


def with_nfc(df: DataFrame, source: str, to: str) -> DataFrame:
    """Adds the NFC form, in one pass: of rows without a character from U+0300 on, which are in it already, only a null goes through Python."""
    c = F.col(source)
    return df.withColumn(to, F.coalesce(_nfc(F.when(c.rlike("[^\\x00-\\u02FF]"), c)), c))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


#: After NFC: the default normalisers of memory and terms, in order; a caller may give others.
NORMALIZERS: tuple[Callable[[Column], Column], ...] = (F.lower, collapse, trim)


def with_normalized(df: DataFrame, source: str, to: str, normalizers: Sequence[Callable[[Column], Column]] = NORMALIZERS) -> DataFrame:
    out = with_nfc(df, source, to)
    c = F.col(to)
    for f in normalizers:
        c = f(c)
    return out.withColumn(to, c)


def grapheme_length(c: Column) -> Column:
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_count(c, F.lit("\\X"))).otherwise(F.length(c))


def clusters(c: Column) -> Column:
    """Distinct grapheme clusters of several code points."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"(\X)"), F.lit(1)), lambda x: F.length(x) > 1))


#: Supplementary private-use code points stand for clusters, so that a distance over code points is one over graphemes.
_PRIVATE = 0xF0000


def graphemes_as_code_points(df: DataFrame, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Replaces in each column every cluster of several code points by one private code point; rows that `where` rules out
    are known to have none.

    The dictionary is made per row from the row's own columns, so it needs neither a broadcast nor a join: equal clusters of
    one row get equal code points, which is all that comparing the row's columns asks for."""
    many = F.array_distinct(F.flatten(F.array(*[clusters(F.col(c)) for c in columns])))
    many = many if where is None else F.when(where, many).otherwise(F.array().cast("array<string>"))

    def encoded(c: str) -> Column:
        parts = F.regexp_extract_all(F.col(c), F.lit(r"(\X)"), F.lit(1))
        return F.array_join(F.transform(parts, lambda g: F.when(F.length(g) > 1, F.decode(F.unhex(F.lpad(F.hex(F.array_position(F.col("_many"), g) + F.lit(_PRIVATE)), 8, "0")), "UTF-32")).otherwise(g)), "")

    tagged = df.withColumn("_many", many)
    return tagged.withColumns({c: F.when(F.size("_many") > 0, encoded(c)).otherwise(F.col(c)) for c in columns}).drop("_many")


def similarity(a: Column, b: Column, distance: Column) -> Column:
    """1 for equal texts, else 1 - distance / the longer's length (not below 0); lengths are in code points, so texts with
    longer clusters have to be encoded first."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - distance / longest))


def count_words(c: Column) -> Column:
    t = trim(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def escape_xml(c: Column, quotes: bool = False, apostrophe: str = "&apos;") -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(c, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit(apostrophe)) if quotes else c


def escape_po(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_po(c: Column) -> Column:
    """One pass from the left: a backslash takes the character after it along."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\.|[^\\]+|\\)"), F.lit(1))
    one = lambda x: F.when(x == "\\n", "\n").when(x == "\\t", "\t").when(x == '\\"', '"').when(x == "\\\\", "\\").otherwise(x)
    return F.array_join(F.transform(parts, one), "")


def tag_name(data: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(data, r"<(\w+)", 1)), F.lit("")), F.lit("span"))


def tag_label(data: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(data, r"</?([a-zA-Z][a-zA-Z0-9:]*)(/?)", 1), r"^[^:]*:", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("?"))


def base_language(c: Column) -> Column:
    return F.lower(F.split(c, "-")[0])


RTL = ("ar", "dv", "fa", "he", "ps", "sd", "ur", "yi")
NOT_LATIN = tuple("am ar bn fa gu he hi hy ja ka km kn ko lo ml my pa si ta te th ti ur zh".split())


def is_rtl(lang: Column) -> Column:
    return base_language(lang).isin(*RTL)


def is_latin(lang: Column) -> Column:
    return ~base_language(lang).isin(*NOT_LATIN)


#: Target codes of one translation service where they aren't just the upper-case tag.
TARGET_CODES = {
    **{k: "EN-GB" for k in ("en", "en-gb")},
    "en-us": "EN-US",
    **{k: "PT-PT" for k in ("pt", "pt-pt")},
    "pt-br": "PT-BR",
    **{k: "ZH-HANS" for k in ("zh", "zh-hans")},
    **{k: "ZH-HANT" for k in ("zh-hk", "zh-hant", "zh-tw")},
}


def mt_source_language(lang: Column) -> Column:
    base = F.upper(F.split(lang, "-")[0])
    return F.when(base == "UR", F.raise_error(F.lit("source language not supported: ur"))).otherwise(base)


def mt_target_language(lang: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in sorted(TARGET_CODES.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(lang)), F.upper(lang))


def is_word_char(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def is_word_boundary(haystack: Column, start: Column, length: Column) -> Column:
    """Whether neither neighbour of haystack[start : start + length] (from 0) is a letter or digit."""
    before = F.substring(haystack, start, F.lit(1))
    after = F.substring(haystack, start + length + 1, F.lit(1))
    return ((start == 0) | ~is_word_char(before)) & ~is_word_char(after)


def severity_level(c: Column) -> Column:
    return F.when(c == "error", 2).when(c == "warning", 1).otherwise(0)


def deterministic_id(*parts: Column) -> Column:
    """An identifier made from the row's natural key, the same in every attempt of a task."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256).substr(1, 32)
