"""Functions of arrays of elements: runs, placeholders, encodings for exchange."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CLOSING, ELEMENTS, OPENING, STANDALONE, TAG, code, text
from .arrow import by_row
from .text import escape_xml

RUN = "struct<rpr:string,text:string>"


def merge_runs(runs: Column) -> Column:
    """Adjacent runs of one format become one."""
    none = F.array().cast(f"array<{RUN}>")
    last = lambda a: F.element_at(a, -1)

    def step(a: Column, r: Column) -> Column:
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(r["rpr"].alias("rpr"), F.concat(last(a)["text"], r["text"]).alias("text"))))
        same = (F.size(a) > 0) & F.coalesce(F.try_element_at(a, F.lit(-1))["rpr"] == r["rpr"], F.lit(False))
        return F.when(same, joined).otherwise(F.concat(a, F.array(F.struct(r["rpr"].alias("rpr"), r["text"].alias("text")))))

    return F.aggregate(runs, none, step)


def base_format(runs: Column) -> Column:
    """The format with most code points; of equals, the one that comes first."""
    formats = F.array_distinct(F.transform(runs, lambda r: r["rpr"]))
    size = lambda f: F.aggregate(F.filter(runs, lambda r: r["rpr"] == f), F.lit(0), lambda a, r: a + F.length(r["text"]))
    ranked = F.transform(formats, lambda f, i: F.struct((-size(f)).alias("n"), i.alias("i"), f.alias("f")))
    return F.array_min(ranked)["f"]


def ordinals(items: Column, counted: Callable[[Column], Column]) -> Column:
    """For each item how many up to and with it are counted: one fold, however long the array."""
    start = F.array().cast("array<int>")
    return F.aggregate(items, start, lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + counted(x).cast("int"))))


def is_code(e: Column) -> Column:
    return e["kind"] == "c"


def runs_to_elements(runs: Column) -> Column:
    """Runs of the base format are plain text; each other run is wrapped in a pair of codes numbered from 1."""
    null, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")

    def element(kind: str, t: Column = null, i: Column = null, ct: Column = null, data: Column = null, shown: Column = null, isolated: Column = no) -> Column:
        return F.struct(F.lit(kind).alias("kind"), t.alias("text"), i.alias("code_id"), ct.alias("code_type"), data.alias("data"), shown.alias("display_text"), isolated.alias("is_isolated"))

    def elements(x: Column) -> Column:  # of (runs, base), which a lambda evaluates once
        other = lambda r: r["rpr"] != x["base"]

        def one(r: Column, i: Column) -> Column:
            n = i.cast("string")
            mark = lambda a: F.concat(F.lit(a), n, F.lit("}"))
            body = element("t", r["text"])
            opening = element("c", null, n, F.lit(OPENING), r["rpr"], mark("{"), F.lit(False))
            closing = element("c", null, n, F.lit(CLOSING), r["rpr"], mark("{/"), F.lit(False))
            return F.when(other(r), F.array(opening, body, closing)).otherwise(F.array(body))

        return F.flatten(F.zip_with(x["runs"], ordinals(x["runs"], other), one))

    return F.element_at(F.transform(F.array(F.struct(runs.alias("runs"), base_format(runs).alias("base"))), elements), 1)


def elements_to_runs(elements: list[dict], base: str) -> list[tuple[str, str]]:
    """The way back: text inside a pair has the pair's format; a standalone code only ends a run."""
    out: list[tuple[str, str]] = []
    stack, now = [base], ""

    def flush() -> None:
        nonlocal now
        if now:
            out.append((stack[-1], now))
            now = ""

    for e in elements:
        if e["kind"] == "t":
            now += e["text"]
            continue
        flush()
        if e["code_type"] == OPENING:
            stack.append(e["data"])
        elif e["code_type"] == CLOSING and len(stack) > 1:
            stack.pop()
    flush()
    return out


def serialize_elements(elements: list[dict]) -> tuple[str, list[dict]]:
    """Text with {n}, {/n} and {n/}, and what each stands for. A closing code has the number of its opening one."""
    parts, tags, numbers, n = [], [], {}, 0
    for e in elements:
        if e["kind"] == "t":
            parts.append(e["text"])
            continue
        if e["code_type"] == CLOSING and numbers.get(e["code_id"]):
            k = numbers[e["code_id"]].pop()
        else:
            n += 1
            k = n
            if e["code_type"] == OPENING:
                numbers.setdefault(e["code_id"], []).append(k)
        kind, mark = {OPENING: ("open", f"{{{k}}}"), CLOSING: ("close", f"{{/{k}}}")}.get(e["code_type"], ("self", f"{{{k}/}}"))
        parts.append(mark)
        tags.append({"id": k, "type": kind, "data": e["data"], "display_text": e["display_text"]})
    return "".join(parts), tags


def deserialize_elements(s: str, tags: list[dict]) -> list[dict]:
    known = {(t["id"], t["type"]): t for t in tags or []}
    out = []
    for piece in re.split(r"(\{/?\d+/?\})", s):
        m = re.fullmatch(r"\{(/?)(\d+)(/?)\}", piece)
        if m:
            kind, t = ("close", CLOSING) if m[1] else ("self", STANDALONE) if m[3] else ("open", OPENING)
            tag = known.get((int(m[2]), kind), {"data": "", "display_text": None})
            out.append(code(m[2], t, tag["data"], tag["display_text"]))
        elif piece:
            out.append(text(piece))
    return out


def decode_mt_text(s: str, codes: dict[str, dict]) -> list[dict]:
    """Elements of a translation that keeps <x id="n"/> for codes; an unknown one becomes {n}, malformed markup loses its tags."""
    try:
        root = ET.fromstring(f"<seg>{s}</seg>")
    except ET.ParseError:
        return [text(re.sub(r"<x[^>]*>", "", s))]
    out = [text(root.text)] if root.text else []
    for x in root:
        i = x.get("id", "")
        out.append(codes[i] if x.tag == "x" and i in codes else text(f"{{{i}}}"))
        if x.tail:
            out.append(text(x.tail))
    return out


def _dicts(x) -> list[dict]:
    return [] if x is None else [dict(e.asDict() if hasattr(e, "asDict") else e) for e in x]


def _serialize(elements: list[dict] | None) -> dict:
    s, tags = (None, None) if elements is None else serialize_elements(elements)
    return {"text": s, "tags": tags}


def serialize(elements: Column) -> Column:
    """STRUCT<text, tags>; null for null."""
    return by_row(_serialize, f"struct<text:string,tags:array<{TAG}>>")(elements)


def _deserialize(s: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in s:
        yield pd.Series([None if t is None else deserialize_elements(t, _dicts(g)) for t, g in zip(a, b, strict=True)])


def deserialize(s: str, tags: str) -> Column:
    return F.pandas_udf(ELEMENTS.simpleString(), F.PandasUDFType.SCALAR_ITER)(_deserialize)(F.col(s), F.col(tags))


def _decode(s: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in s:
        out = []
        for t, e in zip(a, b, strict=True):
            codes = [x for x in _dicts(e) if x["kind"] == "c"]
            out.append(None if t is None else decode_mt_text(t, {str(i + 1): c for i, c in enumerate(codes)}))
        yield pd.Series(out)


def decode_mt(translated: Column, elements: Column) -> Column:
    return F.pandas_udf(ELEMENTS.simpleString(), F.PandasUDFType.SCALAR_ITER)(_decode)(translated, elements)


def encode_mt(elements: Column) -> Column:
    """Text escaped for XML, the n-th code as <x id="n"/>."""
    one = lambda e, i: F.when(is_code(e), F.concat(F.lit('<x id="'), i, F.lit('"/>'))).otherwise(escape_xml(e["text"]))
    return F.array_join(F.zip_with(elements, ordinals(elements, is_code), one), "")


def to_json(elements: Column) -> Column:
    return F.to_json(elements)


def from_json(s: Column) -> Column:
    return F.from_json(s, ELEMENTS)
