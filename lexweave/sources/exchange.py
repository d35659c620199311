"""Exchange formats: TMX 1.4, XLIFF 1.2, TBX v2. Reading is parallel by record through Spark's XML source; writing renders each
record as a Column and joins a file's records in order."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.arrow import bounded, pieces
from ..functions.inline import is_code, ordinals
from ..functions.text import escape_xml
from ..model import CLOSING, ELEMENTS, OPENING, STANDALONE, code, plain, text
from .scratch import drop, written

LANG = "{http://www.w3.org/XML/1998/namespace}lang"
_TAG, _PREFIX = re.compile(r"<[^<>]*>"), re.compile(r"(?:^</?|\s)([A-Za-z_][\w.-]*):(?=[A-Za-z_])")


def fragment(source: str) -> ET.Element:
    """An element cut out of a file: prefixes that the file declared further up are declared around it; its text stays as it is."""
    used = {p for t in _TAG.findall(source) for p in _PREFIX.findall(t)} - {"xml", "xmlns"}
    declared = "".join(f' xmlns:{p}="urn:prefix:{p}"' for p in sorted(used))
    return ET.fromstring(f"<r{declared}>{source}</r>")[0]

# Inline codes


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def parse_inline(e: ET.Element | None) -> list[dict] | None:
    """Elements of a source, target or seg: bpt, ept, ph and it are codes; other elements are left out with their text."""
    if e is None:
        return None
    out = [text(e.text)] if e.text else []
    for c in e:
        kind = {"bpt": OPENING, "ept": CLOSING, "ph": STANDALONE, "it": OPENING if c.get("pos") in ("open", "begin") else CLOSING}.get(_local(c))
        if kind:
            shown = next((v for k, v in c.attrib.items() if k.rpartition("}")[2] == "equiv-text"), None)
            out.append(code(c.get("rid") or c.get("i") or c.get("id") or "", kind, "".join(c.itertext()), shown, _local(c) == "it"))
        if c.tail:
            out.append(text(c.tail))
    return out


def resolve_languages(langs: list[str], source: str) -> tuple[int, int]:
    """Which variants are source and target: the source by its tag (without case), else by its base language, `*all*` the first; the
    target is the first other language."""
    low = [x.lower() for x in langs]
    if source.lower() in ("", "*all*"):
        s = 0
    else:
        s = next((i for i, x in enumerate(low) if x == source.lower()), None)
        if s is None:
            base = source.lower().split("-")[0]
            s = next((i for i, x in enumerate(low) if x.split("-")[0] == base), 0)
    t = next((i for i, x in enumerate(low) if i != s and x != low[s]), None)
    if t is None:
        raise ValueError(f"a unit needs two languages, it has {langs}")
    return s, t


def language_pair(langs: Column, source: Column) -> Column:
    """`resolve_languages` of an array column: STRUCT<src, tgt>, null without a second language."""
    base = lambda c: F.lower(F.split(c, "-")[0])
    exact = F.filter(langs, lambda x: F.lower(x) == F.lower(source))
    near = F.filter(langs, lambda x: base(x) == base(source))
    s = F.when(F.lower(source) == "*all*", F.try_element_at(langs, F.lit(1))).otherwise(F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(near, F.lit(1)), F.try_element_at(langs, F.lit(1))))
    t = F.try_element_at(F.filter(langs, lambda x: F.lower(x) != F.lower(s)), F.lit(1))
    return F.when(t.isNotNull(), F.struct(s.alias("src"), t.alias("tgt")))


def _when(s: str | None) -> datetime | None:
    if not s:
        return None
    return datetime.strptime(s, "%Y%m%dT%H%M%SZ").replace(tzinfo=timezone.utc).replace(tzinfo=None)


UNIT = (
    f"tuid string, src_lang string, tgt_lang string, source_text string, target_text string, source_elements {ELEMENTS.simpleString()}, "
    f"target_elements {ELEMENTS.simpleString()}, created_at timestamp, created_by string, last_used_at timestamp, metadata map<string,string>, notes array<string>"
)


def parse_tu(source: str, srclang: str) -> dict:
    """One <tu> as a row of UNIT."""
    e = fragment(source)
    tuvs = [x for x in e if _local(x) == "tuv"]
    langs = [x.get(LANG) or x.get("lang") or "" for x in tuvs]
    s, t = resolve_languages(langs, srclang)
    sides = [parse_inline(next((y for y in tuvs[i] if _local(y) == "seg"), None)) or [] for i in (s, t)]
    props = {x.get("type", ""): x.text or "" for x in e if _local(x) == "prop"}
    used = props.pop("x-lastUsedAt", None)
    return {
        "tuid": e.get("tuid"),
        "src_lang": langs[s],
        "tgt_lang": langs[t],
        "source_text": plain(sides[0]),
        "target_text": plain(sides[1]),
        "source_elements": sides[0],
        "target_elements": sides[1],
        "created_at": _when(e.get("creationdate")),
        "created_by": e.get("creationid"),
        "last_used_at": _when(used),
        "metadata": props,
        "notes": [x.text or "" for x in e if _local(x) == "note"],
    }


def _records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(x, file, at): each <tag> of the files as XML of its own, read in parallel: files are cut at the records, never held whole.
    Within a file `at` follows the records' order."""
    bounded(spark)
    rows = spark.read.format("text").option("lineSep", f"</{tag}>").load(path)
    placed = rows.select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    own = placed.where(F.col("value").rlike(f"<{tag}[\\s>]"))
    return own.select(F.concat(F.regexp_extract("value", rf"(?s)(<{tag}[\s>].*)\z", 1), F.lit(f"</{tag}>")).alias("x"), "file", "at")


def source_languages(spark: SparkSession, path: str) -> DataFrame:
    """(file, srclang) from the headers of TMX files, which are read tag by tag."""
    tags = spark.read.format("text").option("lineSep", ">").load(path).select("value", F.col("_metadata.file_path").alias("file"))
    return tags.where(F.col("value").contains("<header")).groupBy("file").agg(F.first(F.regexp_extract("value", r"""srclang\s*=\s*["']([^"']*)["']""", 1)).alias("srclang"))


def read_tmx(spark: SparkSession, path: str, srclang: str | None = None) -> DataFrame:
    """The units of TMX files with their file and place; srclang is that of each file's own header unless given. A unit with
    fewer than two languages raises."""
    units = _records(spark, path, "tu")
    if srclang is None:
        units = units.join(source_languages(spark, path), "file", "left").withColumn("srclang", F.coalesce(F.nullif("srclang", F.lit("")), F.lit("*all*")))
    else:
        units = units.withColumn("srclang", F.lit(srclang))

    kind = DataType.fromDDL(UNIT + ", file string, block bigint, row bigint")
    out = units.select("x", "srclang", "file", "at.*").mapInArrow(_parsed(lambda b: [{**(t := parse_tu(x, g)), "metadata": list(t["metadata"].items()), "file": f, "block": k, "row": r} for x, g, f, k, r in zip(*(c.to_pylist() for c in b.columns), strict=True)], kind), kind)
    return out.withColumn("at", F.struct("block", "row")).drop("block", "row")


def _parsed(rows: Callable[[pa.RecordBatch], list[dict]], kind: DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of the rows that are made of each piece of a batch."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(tuple(b.columns)):
                made = rows(pa.RecordBatch.from_arrays(list(part), b.schema.names))
                if made:
                    yield pa.RecordBatch.from_struct_array(pa.array(made, arrow))

    return run


def _names(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in schema + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return out


TRANS_UNIT = f"id string, is_locked boolean, state string, status string, source_elements {ELEMENTS.simpleString()}, target_elements {ELEMENTS.simpleString()}, source_text string, target_text string"


def parse_trans_unit(source: str) -> dict:
    e = fragment(source)
    find = lambda n: next((x for x in e if _local(x) == n), None)
    s, t = parse_inline(find("source")) or [], parse_inline(find("target"))
    state = (find("target").get("state") if find("target") is not None else None) or "new"
    t = t or None
    return {
        "id": e.get("id"),
        "is_locked": e.get("translate") == "no",
        "state": state,
        "status": STATUS_OF.get(state, "untranslated"),
        "source_elements": s,
        "target_elements": t,
        "source_text": plain(s),
        "target_text": None if t is None else plain(t),
    }


def read_xliff(spark: SparkSession, path: str) -> DataFrame:
    """The trans-units of XLIFF 1.2 files: empty targets are null, translate="no" means locked."""

    kind = DataType.fromDDL(TRANS_UNIT)
    return _records(spark, path, "trans-unit").select("x").mapInArrow(_parsed(lambda b: [parse_trans_unit(x) for x in b["x"].to_pylist()], kind), kind)


# States and types

STATE_OF = {"untranslated": "new", "draft": "new", "translated": "translated", "reviewed": "signed-off", "approved": "final", "rejected": "needs-translation"}
STATUS_OF = {"new": "untranslated", "translated": "translated", "signed-off": "reviewed", "final": "approved", "needs-translation": "rejected"}
DATATYPE_OF = {"text/plain": "plaintext", "text/html": "html"}


def _lookup(c: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def xliff_state(status: Column) -> Column:
    return _lookup(status, STATE_OF, "new")


def status_of_state(state: Column) -> Column:
    return _lookup(state, STATUS_OF, "untranslated")


def datatype(mime: Column) -> Column:
    return _lookup(mime, DATATYPE_OF, "x-unknown")


def mime_of(kind: Column) -> Column:
    return _lookup(kind, {v: k for k, v in DATATYPE_OF.items()}, "application/octet-stream")


# Rendering


def _esc(c: Column) -> Column:
    return escape_xml(c, quotes=True)


def xliff_content(elements: Column) -> Column:
    """Inline content: text escaped, codes as bpt, ept, ph or it, numbered within the segment."""

    def one(e: Column, i: Column) -> Column:
        n = i.cast("string")
        shown = F.when(e["display_text"].isNotNull(), F.concat(F.lit(' lw:equiv-text="'), _esc(e["display_text"]), F.lit('"'))).otherwise("")
        tag = F.when(e["is_isolated"], "it").when(e["code_type"] == OPENING, "bpt").when(e["code_type"] == CLOSING, "ept").otherwise("ph")
        pos = F.when(~e["is_isolated"], "").when(e["code_type"] == OPENING, ' pos="open"').otherwise(' pos="close"')
        made = F.concat(F.lit("<"), tag, F.lit(' id="'), n, F.lit('"'), pos, F.lit(' rid="'), _esc(e["code_id"]), F.lit('"'), shown, F.lit(">"), _esc(e["data"]), F.lit("</"), tag, F.lit(">"))
        return F.when(e["kind"] == "c", made).otherwise(_esc(e["text"]))

    return F.array_join(F.zip_with(elements, ordinals(elements, is_code), one), "")


def tmx_content(elements: Column) -> Column:
    """As for XLIFF, but both codes of a pair carry one number, as the format means it."""
    codes = F.filter(elements, lambda e: e["kind"] == "c")
    ids = F.array_distinct(F.transform(codes, lambda e: e["code_id"]))

    def one(e: Column, ids: Column) -> Column:
        n = F.array_position(ids, e["code_id"]).cast("string")
        tag = F.when(e["is_isolated"], "it").when(e["code_type"] == OPENING, "bpt").when(e["code_type"] == CLOSING, "ept").otherwise("ph")
        pos = F.when(~e["is_isolated"], "").when(e["code_type"] == OPENING, ' pos="begin"').otherwise(' pos="end"')
        return F.when(e["kind"] == "c", F.concat(F.lit("<"), tag, F.lit(' i="'), n, F.lit('"'), pos, F.lit(">"), _esc(e["data"]), F.lit("</"), tag, F.lit(">"))).otherwise(_esc(e["text"]))

    # A lambda gets the identifiers as a value: named inside the other one they would be made again for each element.
    return F.element_at(F.transform(F.array(F.struct(elements.alias("all"), ids.alias("ids"))), lambda x: F.array_join(F.transform(x["all"], lambda e: one(e, x["ids"])), "")), 1)


def trans_unit(id: Column, locked: Column, status: Column, source: Column, target: Column) -> Column:
    """One <trans-unit>; source and target are content that is rendered already."""
    return F.concat(
        F.lit('      <trans-unit id="'), _esc(id), F.lit('" translate="'), F.when(locked, "no").otherwise("yes"), F.lit('">\n        <source>'), source,
        F.lit('</source>\n        <target state="'), xliff_state(status), F.lit('">'), F.coalesce(target, F.lit("")), F.lit("</target>\n      </trans-unit>\n"),
    )


_XLIFF = '<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="1.2" xmlns="urn:oasis:names:tc:xliff:document:1.2" xmlns:lw="urn:lexweave">\n'


def _xliff_head() -> Column:
    """A <file> up to its units, of the columns of `files`."""
    return F.concat(
        F.lit('  <file original="'), _esc(F.col("original")), F.lit('" source-language="'), _esc(F.col("src_lang")), F.lit('" target-language="'), _esc(F.col("tgt_lang")), F.lit('" datatype="'),
        datatype(F.col("mime")), F.lit('">\n    <header>\n      <skl><external-file href="'), _esc(F.col("skeleton_href")), F.lit('"/></skl>\n    </header>\n    <body>\n'),
    )


def xliff_files(units: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, xliff) from units(file_id, seg_no, unit) and files(file_id, original, src_lang, tgt_lang, mime, skeleton_href): each
    file as one text. Files that may outgrow a row are written by `write_xliff_units`."""
    body = units.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "unit"))), lambda x: x["unit"]), "").alias("body"))
    return files.join(body, "file_id", "left").select("file_id", F.concat(F.lit(_XLIFF), _xliff_head(), F.coalesce("body", F.lit("")), F.lit("    </body>\n  </file>\n</xliff>\n")).alias("xliff"))


def write_xliff(files: DataFrame, path: str) -> None:
    """Writes files(xliff), a part of the folder for each partition: each file is a document of its own."""
    files.select(F.regexp_replace("xliff", r"\n\z", "").alias("value")).write.text(path)


def write_xliff_units(units: DataFrame, files: DataFrame, path: str) -> None:
    """Writes what `xliff_files` makes, unit by unit: no file is ever held whole, however many units it has. Each part of the folder is
    an XLIFF document of consecutive units; a file that spans parts has a <file> of the same name in each. Files without units have
    an empty one."""
    bounded(units.sparkSession)
    units = written(units.select("file_id", "seg_no", "unit"), "units")  # rendered once: sampling for the ranges reads its keys only
    heads = files.select("file_id", F.lit(None).cast(units.schema["seg_no"].dataType).alias("seg_no"), _xliff_head().alias("head"), F.lit(None).cast("string").alias("unit"))
    rows = units.join(heads.select("file_id", "head"), "file_id").select("file_id", "seg_no", "head", "unit")
    rows = rows.unionByName(heads.join(units.select("file_id").distinct(), "file_id", "left_anti"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, "    </body>\n  </file>"
        for b in batches:
            out = []
            for key, head, unit in zip(b["file_id"].to_pylist(), b["head"].to_pylist(), b["unit"].to_pylist(), strict=True):
                if now is None or now[0] != key:
                    out += [_XLIFF.rstrip("\n") if now is None else end, head.rstrip("\n")]
                    now = (key,)
                if unit is not None:
                    out.append(unit.rstrip("\n"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end, "</xliff>"], pa.string())], ["value"])

    rows.repartitionByRange("file_id", "seg_no").sortWithinPartitions("file_id", "seg_no").mapInArrow(wrap, "value string").write.text(path)
    drop(units)


def tmx_time(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")


def tmx_unit(tuid: Column, created: Column, by: Column, src_lang: Column, source: Column, tgt_lang: Column, target: Column, props: Column | None = None, notes: Column | None = None, used: Column | None = None) -> Column:
    """One <tu>; source and target are content that is rendered already."""
    tuv = lambda lang, seg: F.concat(F.lit('      <tuv xml:lang="'), _esc(lang), F.lit('">\n        <seg>'), seg, F.lit("</seg>\n      </tuv>\n"))
    prop = lambda k, v: F.concat(F.lit('      <prop type="'), k, F.lit('">'), v, F.lit("</prop>\n"))
    none = F.lit("")
    each = none if props is None else F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(props)), lambda x: prop(_esc(x["key"]), _esc(x["value"]))), ""), none)
    note = none if notes is None else F.coalesce(F.array_join(F.transform(notes, lambda x: F.concat(F.lit("      <note>"), _esc(x), F.lit("</note>\n"))), ""), none)
    last = none if used is None else F.when(used.isNotNull(), prop(F.lit("x-lastUsedAt"), tmx_time(used))).otherwise("")
    author = F.when(by.isNotNull(), F.concat(F.lit(' creationid="'), _esc(by), F.lit('"'))).otherwise("")
    return F.concat(F.lit('    <tu tuid="'), _esc(tuid), F.lit('" creationdate="'), tmx_time(created), F.lit('"'), author, F.lit(">\n"), each, note, last, tuv(src_lang, source), tuv(tgt_lang, target), F.lit("    </tu>\n"))


def write_tmx(units: DataFrame, path: str, srclang: str, order: str = "tu_id") -> None:
    """Writes units(order, unit) as TMX part files, each a document of its own of consecutive units: written in parallel."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4">\n  <header creationtool="lexweave" creationtoolversion="1" segtype="sentence" o-tmf="lexweave" adminlang="en" srclang="{html.escape(srclang)}" datatype="plaintext"/>\n  <body>'

    bounded(units.sparkSession)

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if b.num_rows:
                lines = ([head] if first else []) + [u.rstrip("\n") for u in b["unit"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                first = False
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array(["  </body>\n</tmx>"], pa.string())], ["value"])

    units = written(units.select(order, "unit"), "units")  # rendered once: sampling for the ranges reads its keys only
    units.repartitionByRange(order).sortWithinPartitions(order).select("unit").mapInArrow(wrap, "value string").write.text(path)
    drop(units)


# TBX

CONCEPT = "concept_id string, set_no int, term_no int, lang string, term string, definition string, domain string, forbidden boolean"
_FORBIDDEN = {"deprecatedterm", "supersededterm"}


def parse_concept(source: str) -> list[dict]:
    """The terms of one termEntry (or conceptEntry), a row each."""
    e = fragment(source)
    value = lambda x, kind: next((y.text for y in x.iter() if _local(y) in ("descrip", "termNote", "admin") and y.get("type") == kind), None)
    own = lambda x, kind: next((y.text for y in x if _local(y) == "descrip" and y.get("type") == kind), None)
    out = []
    for n, s in enumerate([x for x in e if _local(x) in ("langSet", "langSec")]):
        groups = [x for x in s if _local(x) in ("tig", "termSec", "ntig")]
        for k, g in enumerate(groups):
            term = next((y.text for y in g.iter() if _local(y) == "term"), None)
            if not term or not term.strip():
                continue
            status = (value(g, "administrativeStatus") or "").lower()
            out.append(
                {
                    "concept_id": e.get("id"), "set_no": n, "term_no": k, "lang": s.get(LANG) or s.get("lang"), "term": term.strip(),
                    "definition": value(g, "definition") or own(s, "definition") or own(e, "definition"), "domain": value(g, "subjectField") or own(s, "subjectField") or own(e, "subjectField"),
                    "forbidden": any(status.replace("-admn-sts", "") == f for f in _FORBIDDEN),
                }
            )
    return out


def read_tbx(spark: SparkSession, path: str) -> DataFrame:
    """A row for each term of TBX files; terms.pair_concepts makes directed entries of them."""

    kind = DataType.fromDDL(CONCEPT)
    old, new = (_records(spark, path, t) for t in ("termEntry", "conceptEntry"))
    return old.select("x").unionByName(new.select("x")).mapInArrow(_parsed(lambda b: [r for x in b["x"].to_pylist() for r in parse_concept(x)], kind), kind)
