"""File sources and sinks: every format's parser behind one pair of DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import bounded, by_row
from ..model import ELEMENTS, SEGMENTS
from . import markup, office


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    mime: str
    parse: Callable[[bytes], tuple[list[dict], str | bytes]]
    rebuild: Callable[[str | bytes, dict[str, list[dict]], str], bytes]
    binary: bool = False


FORMATS = {
    f.name: f
    for f in (
        Format("plaintext", ("txt",), "text/plain", markup.parse_plain, markup.rebuild_plain),
        Format("plaintext-all", (), "text/plain", partial(markup.parse_plain, blank=True), markup.rebuild_plain),
        Format("html", ("html", "htm"), "text/html", markup.parse_html, markup.rebuild_html),
        Format("xml", ("xml",), "text/xml", markup.parse_xml, markup.rebuild_xml),
        Format("po", ("po",), "text/x-gettext-translation", markup.parse_po, markup.rebuild_po),
        Format("docx", ("docx",), office.DOCX_MIME, office.parse_docx, office.rebuild_docx, True),
        Format("xlsx", ("xlsx",), office.XLSX_MIME, office.parse_xlsx, office.rebuild_xlsx, True),
        Format("pptx", ("pptx",), office.PPTX_MIME, office.parse_pptx, office.rebuild_pptx, True),
    )
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files, listed and read in parallel."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def format_of(path: Column) -> Column:
    """The format's name by extension; a path that no format claims raises an error when it is evaluated."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.raise_error(F.concat(F.lit("no format for "), path)).cast("string")
    for f in [f for f in reversed(FORMATS.values()) if f.extensions]:
        out = F.when(ext.isin(*f.extensions), f.name).otherwise(out)
    return out


def extract(files: DataFrame, content: str = "content", format: str | None = None) -> DataFrame:
    """files and, of each, `segments` (array) and `skeleton` (binary). The format is the given one, or that of the path.

    Malformed files fail the query, with the path in the message."""
    bounded(files.sparkSession)

    def parse(data, name: str, path: str) -> dict:
        if data is None:
            return {"segments": None, "skeleton": None}
        try:
            segments, skeleton = FORMATS[name].parse(data if isinstance(data, bytes) else data.encode())
        except Exception as e:
            raise ValueError(f"{name} file {path} can't be read: {e}") from e
        segments = [{**s, "context": list(s["context"].items())} for s in segments]
        return {"segments": segments, "skeleton": skeleton if isinstance(skeleton, bytes) else skeleton.encode()}

    returns = f"struct<segments:array<struct<{_struct()}>>,skeleton:binary>"
    if "path" in files.columns or not format:
        made = by_row(parse, returns)(F.col(content), F.lit(format) if format else format_of(F.col("path")), F.col("path") if "path" in files.columns else F.lit(""))
    else:  # of one argument, so that it runs in the worker that made the content
        made = by_row(lambda data: parse(data, format, ""), returns)(F.col(content))
    return files.withColumn("_x", made).select(*files.columns, "_x.segments", "_x.skeleton")


def _struct() -> str:
    return ", ".join(part.replace(" ", ":", 1) for part in ("seg_no int", "id string", f"elements {ELEMENTS.simpleString()}", "plain string", "context map<string,string>"))


def segments_of(extracted: DataFrame, *keep: str) -> DataFrame:
    """A row for each segment: the kept columns, seg_no, id, elements, plain, context."""
    return extracted.select(*keep, F.inline("segments"))


def _build(format: str, lang: str):
    """A file from a struct of its skeleton and its segments (id, elements)."""
    f = FORMATS[format]

    def build(x: dict) -> bytes | None:
        if x["skeleton"] is None:
            return None
        by_id = {s["id"]: s["e"] or [] for s in x["by"] or []}
        return f.rebuild(x["skeleton"] if f.binary else x["skeleton"].decode(), by_id, lang)

    return by_row(build, "binary")


def rebuilt(extracted: DataFrame, elements: Callable[[Column], Column], format: str, lang: str = "", to: str = "content") -> DataFrame:
    """`extracted` with files built from its own skeletons and segments, each with the elements that are made of it (a struct with
    seg_no, id, elements): row by row, nothing is shuffled."""
    bounded(extracted.sparkSession)
    by = F.transform("segments", lambda s: F.struct(s["id"].alias("id"), elements(s).alias("e")))
    return extracted.withColumn(to, _build(format, lang)(F.struct("skeleton", by.alias("by"))))


def rebuild(skeletons: DataFrame, segments: DataFrame, format: str, key: str = "path", lang: str = "") -> DataFrame:
    """(key, content): files built from skeletons(key, skeleton) and segments(key, id, source_elements, target_elements): the target
    where there is one, else the source. One shuffle of the segments to their files, which are never broadcast; where segments
    still lie with their file, `rebuilt` does without."""
    bounded(skeletons.sparkSession)
    chosen = F.coalesce("target_elements", "source_elements")
    ready = segments.groupBy(key).agg(F.collect_list(F.struct("id", chosen.alias("e"))).alias("by"))
    joined = skeletons.join(ready.hint("merge"), key, "left")
    return joined.select(key, _build(format, lang)(F.struct("skeleton", "by")).alias("content"))


__all__ = ["FORMATS", "SEGMENTS", "Format", "extract", "format_of", "read_files", "rebuild", "rebuilt", "segments_of"]
