"""Schemas and fixed values: an ordered list of segment pairs, each side a list of text and inline codes."""

from __future__ import annotations

from pyspark.sql import types as T

#: One element of a segment: kind 't' (text) or 'c' (inline code).
ELEMENT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("code_id", T.StringType()),
        T.StructField("code_type", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("display_text", T.StringType()),
        T.StructField("is_isolated", T.BooleanType()),
    ]
)
ELEMENTS = T.ArrayType(ELEMENT)
TAG = "struct<id:int,type:string,data:string,display_text:string>"
#: What a source yields for each segment of a file.
SEGMENTS = f"seg_no int, id string, elements {ELEMENTS.simpleString()}, plain string, context map<string,string>"

OPENING, CLOSING, STANDALONE = "opening", "closing", "standalone"
STATUSES = ("untranslated", "draft", "translated", "reviewed", "approved", "rejected")
MATCH_TYPES = ("exact", "exact_text", "fuzzy", "mt")
SEVERITIES = {"error": 2, "warning": 1, "info": 0}


def text(s: str) -> dict:
    return {"kind": "t", "text": s, "code_id": None, "code_type": None, "data": None, "display_text": None, "is_isolated": None}


def code(code_id: str, code_type: str, data: str, display_text: str | None = None, is_isolated: bool = False) -> dict:
    return {"kind": "c", "text": None, "code_id": code_id, "code_type": code_type, "data": data, "display_text": display_text, "is_isolated": is_isolated}


def plain(elements: list[dict]) -> str:
    return "".join(e["text"] for e in elements if e["kind"] == "t")
