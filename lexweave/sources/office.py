"""Office Open XML: word-processing, spreadsheet and presentation files. A skeleton is the archive itself, with a token in each
place a segment came from."""

from __future__ import annotations

import io
import itertools
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterable

from ..functions.inline import elements_to_runs
from ..model import CLOSING, OPENING, code, plain, text

_OOX = "http://schemas.openxmlformats.org"
W = "{%s/wordprocessingml/2006/main}" % _OOX
S = "{%s/spreadsheetml/2006/main}" % _OOX
A = "{%s/drawingml/2006/main}" % _OOX
P = "{%s/presentationml/2006/main}" % _OOX
R = "{%s/officeDocument/2006/relationships}" % _OOX
REL = "{%s/package/2006/relationships}" % _OOX
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
_BASE = "application/vnd.openxmlformats-officedocument."
DOCX_MIME, XLSX_MIME, PPTX_MIME = (_BASE + x for x in ("wordprocessingml.document", "spreadsheetml.sheet", "presentationml.presentation"))
RTL = {"ar", "dv", "fa", "he", "ps", "sd", "ur", "yi"}
_TOKEN = re.compile(r"\{\{SEG:(\d+)\}\}")
_NUMERIC = re.compile(r"\s*[\d.,\-+\s%$€£¥₹]+\s*")


def is_rtl(lang: str) -> bool:
    return lang.split("-")[0].lower() in RTL


def read_zip(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {i.filename: z.read(i) for i in z.infolist()}


def write_zip(parts: dict[str, bytes], stored: Callable[[str], bool] = lambda n: False) -> bytes:
    """The archive with fixed times, so that equal parts give equal bytes. Written here: zipfile's own writer takes most of the time
    of a small archive. Archives beyond its plain format are left to it."""
    if len(parts) > 60_000 or sum(map(len, parts.values())) > 1 << 30:
        return _write_large_zip(parts, stored)
    out, index, at = [], [], 0
    for name, data in parts.items():
        ascii_ = name.isascii()
        raw = name.encode("ascii" if ascii_ else "utf-8")
        if stored(name):
            method, body = zipfile.ZIP_STORED, data
        else:
            z = zlib.compressobj(-1, zlib.DEFLATED, -15)
            method, body = zipfile.ZIP_DEFLATED, z.compress(data) + z.flush()
        #: Needed version, flags, method, time, date (1980-01-01), checksum, sizes, length of the name, no extra field.
        common = struct.pack("<HHHHHLLLHH", 20, 0 if ascii_ else 0x800, method, 0, 33, zlib.crc32(data), len(body), len(data), len(raw), 0)
        index.append(b"PK\x01\x02" + struct.pack("<H", 0x314) + common + struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at) + raw)
        out += [b"PK\x03\x04" + common, raw, body]
        at += 30 + len(raw) + len(body)
    size = sum(map(len, index))
    return b"".join([*out, *index, b"PK\x05\x06" + struct.pack("<HHHHLLH", 0, 0, len(index), len(index), size, at, 0)])


def _write_large_zip(parts: dict[str, bytes], stored: Callable[[str], bool]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            z.writestr(info, data, zipfile.ZIP_STORED if stored(name) else zipfile.ZIP_DEFLATED)
    return out.getvalue()


_PREFIX_OF = ET.register_namespace._namespace_map
_FORMATS: dict[tuple, str] = {}


def _key(e: ET.Element) -> tuple:
    return e.tag, tuple(e.attrib.items()), e.text, tuple([(_key(c), c.tail) for c in e])


def _format(rpr: ET.Element | None) -> str:
    """A run's properties as XML; those seen before, under the prefixes registered now, aren't written again."""
    if rpr is None:
        return ""
    key = (_key(rpr), rpr.tail)
    if key not in _FORMATS:
        if len(_FORMATS) >= 10_000:
            _FORMATS.clear()
        _FORMATS[key] = ET.tostring(rpr, encoding="unicode").strip()
    return _FORMATS[key]


def _parse(data: bytes) -> ET.Element:
    """The root, in one pass; prefixes are registered on the way."""
    events = ET.iterparse(io.BytesIO(data), events=["start-ns"])
    for _, (prefix, uri) in events:
        if _PREFIX_OF.get(uri) != prefix and not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
            _FORMATS.clear()
    return events.root


def _dump(e: ET.Element) -> bytes:
    return b"<?xml version='1.0' encoding='UTF-8'?>\n" + ET.tostring(e, encoding="unicode").encode("utf-8", "xmlcharrefreplace")


def merge(runs: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for rpr, t in runs:
        if out and out[-1][0] == rpr:
            out[-1] = (rpr, out[-1][1] + t)
        else:
            out.append((rpr, t))
    return out


def base_of(runs: list[tuple[str, str]]) -> str:
    size: dict[str, int] = {}
    for rpr, t in runs:
        size[rpr] = size.get(rpr, 0) + len(t)
    return max(size, key=size.get) if size else ""


def to_elements(runs: list[tuple[str, str]], base: str) -> list[dict]:
    out, n = [], 0
    for rpr, t in runs:
        if rpr == base:
            out.append(text(t))
            continue
        n += 1
        out += [code(str(n), OPENING, rpr, f"{{{n}}}"), text(t), code(str(n), CLOSING, rpr, f"{{/{n}}}")]
    return out


class _Kind:
    """What differs between word-processing and drawing paragraphs."""

    def __init__(self, ns: str):
        self.p, self.r, self.t, self.rpr, self.ppr = (ns + x for x in ("p", "r", "t", "rPr", "pPr"))
        self.word = ns == W


WORD, DRAWING = _Kind(W), _Kind(A)


def _runs(p: ET.Element, k: _Kind) -> list[tuple[ET.Element, str, str]]:
    out = []
    for r in p.iter(k.r):
        s = "".join(t.text or "" for t in r.findall(k.t))
        if s:
            out.append((r, _format(r.find(k.rpr)), s))
    return out


def _take_paragraphs(root: ET.Element, k: _Kind, out: list[dict], context: dict[str, str]) -> None:
    parents: dict | None = None
    for p in root.iter(k.p):
        found = _runs(p, k)
        nested = next(itertools.islice(p.iter(k.p), 1, None), None) is not None
        if parents is None and (nested or len(p.findall(k.r)) < sum(1 for _ in p.iter(k.r))):
            parents = {c: a for a in root.iter() for c in a}
        if nested:
            found = [x for x in found if next((a for a in _up(x[0], parents) if a.tag == k.p), None) is p]
        if not "".join(s for _, _, s in found).strip():
            continue
        runs = merge((rpr, s) for _, rpr, s in found)
        base = base_of(runs)
        n = len(out) + 1
        elements = to_elements(runs, base)
        out.append({"seg_no": n, "id": f"seg-{n}", "elements": elements, "plain": plain(elements), "context": context})
        first, *rest = [r for r, _, _ in found]
        for r in rest:
            (p if parents is None else parents[r]).remove(r)
        _set_run(first, k, base, f"{{{{SEG:{n:03d}}}}}")


def _up(e: ET.Element, parents: dict) -> Iterable[ET.Element]:
    while e in parents:
        e = parents[e]
        yield e


def _set_run(r: ET.Element, k: _Kind, rpr: str, s: str) -> None:
    for c in list(r):
        r.remove(c)
    if rpr:
        r.append(ET.fromstring(rpr))
    t = ET.SubElement(r, k.t)
    t.text = s
    if k.word and s != s.strip():
        t.set(SPACE, "preserve")


def _put_paragraphs(root: ET.Element, k: _Kind, by_id: dict[str, list[dict]], lang: str) -> None:
    parents = {c: p for p in root.iter() for c in p}
    for r in list(root.iter(k.r)):
        m = _TOKEN.fullmatch("".join(t.text or "" for t in r.findall(k.t)))
        if not m or f"seg-{int(m[1])}" not in by_id:
            continue
        base = _format(r.find(k.rpr))
        parent = parents[r]
        at = list(parent).index(r)
        parent.remove(r)
        new = []
        for form, s in elements_to_runs(by_id[f"seg-{int(m[1])}"], base):
            run = ET.Element(k.r)
            _set_run(run, k, form, s)
            if is_rtl(lang):
                _rtl_run(run, k)
            new.append(run)
        for i, run in enumerate(new):
            parent.insert(at + i, run)
        if is_rtl(lang):
            p = next((a for a in [parent, *_up(parent, parents)] if a.tag == k.p), None)
            if p is not None:
                _rtl_paragraph(p, k)


def _rtl_run(r: ET.Element, k: _Kind) -> None:
    if k.word:
        rpr = r.find(k.rpr)
        if rpr is None:
            rpr = ET.Element(k.rpr)
            r.insert(0, rpr)
        if rpr.find(W + "rtl") is None:
            ET.SubElement(rpr, W + "rtl")


def _rtl_paragraph(p: ET.Element, k: _Kind) -> None:
    ppr = p.find(k.ppr)
    if ppr is None:
        ppr = ET.Element(k.ppr)
        p.insert(0, ppr)
    if not k.word:
        ppr.set("rtl", "1")
    elif ppr.find(W + "bidi") is None:
        ET.SubElement(ppr, W + "bidi")


def _docx_parts(parts: dict[str, bytes]) -> list[str]:
    names = ["document", *(f"header{i}" for i in range(1, 11)), *(f"footer{i}" for i in range(1, 11)), "footnotes", "endnotes"]
    return [n for n in (f"word/{x}.xml" for x in names) if n in parts]


def parse_docx(data: bytes) -> tuple[list[dict], bytes]:
    parts, out = read_zip(data), []
    for name in _docx_parts(parts):
        root = _parse(parts[name])
        _take_paragraphs(root, WORD, out, {"part": name})
        parts[name] = _dump(root)
    return out, write_zip(parts)


def rebuild_docx(skeleton: bytes, by_id: dict[str, list[dict]], lang: str) -> bytes:
    parts = read_zip(skeleton)
    for name in _docx_parts(parts):
        root = _parse(parts[name])
        _put_paragraphs(root, WORD, by_id, lang)
        parts[name] = _dump(root)
    return write_zip(parts)


def relations(parts: dict[str, bytes], of: str) -> dict[str, tuple[str, str]]:
    """id -> (kind, part) of a part's relationships."""
    folder, name = posixpath.split(of)
    rels = parts.get(f"{folder}/_rels/{name}.rels")
    if rels is None:
        return {}
    path = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], path(r.get("Target", ""))) for r in ET.fromstring(rels).iter(REL + "Relationship")}


def _slides(parts: dict[str, bytes]) -> Iterable[tuple[str, str, ET.Element]]:
    """(part, kind, root) of shown slides in order, each followed by its notes."""
    of = "ppt/presentation.xml"
    rels = relations(parts, of)
    for s in ET.fromstring(parts[of]).iter(P + "sldId"):
        _, name = rels.get(s.get(R + "id"), ("", ""))
        if name not in parts or (root := _parse(parts[name])).get("show") == "0":
            continue
        yield name, "slide", root
        for kind, n in relations(parts, name).values():
            if kind == "notesSlide" and n in parts:
                yield n, "notes", _parse(parts[n])


def parse_pptx(data: bytes) -> tuple[list[dict], bytes]:
    parts, out = read_zip(data), []
    for name, kind, root in _slides(parts):
        _take_paragraphs(root, DRAWING, out, {"part": name, "source": kind})
        parts[name] = _dump(root)
    return out, write_zip(parts)


def rebuild_pptx(skeleton: bytes, by_id: dict[str, list[dict]], lang: str) -> bytes:
    parts = read_zip(skeleton)
    for name, _, root in _slides(parts):
        _put_paragraphs(root, DRAWING, by_id, lang)
        parts[name] = _dump(root)
    return write_zip(parts)


# Spreadsheets


def translatable(s: str) -> bool:
    return bool(s.strip()) and not _NUMERIC.fullmatch(s)


def _sheets(parts: dict[str, bytes]) -> list[str]:
    key = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    return sorted((n for n in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=key)


def _rich(e: ET.Element) -> list[tuple[str, str]]:
    rs = e.findall(S + "r")
    if not rs:
        return [("", "".join(t.text or "" for t in e.findall(S + "t")))]
    out = []
    for r in rs:
        out.append((_format(r.find(S + "rPr")), "".join(t.text or "" for t in r.findall(S + "t"))))
    return [x for x in merge(out) if x[1]]


def _set_rich(e: ET.Element, runs: list[tuple[str, str]]) -> None:
    for c in list(e):
        if c.tag in (S + "r", S + "t"):
            e.remove(c)

    def put(parent: ET.Element, s: str) -> None:
        t = ET.SubElement(parent, S + "t")
        t.text = s
        if s != s.strip():
            t.set(SPACE, "preserve")

    if len(runs) <= 1 and not (runs and runs[0][0]):
        put(e, runs[0][1] if runs else "")
        return
    for rpr, s in runs:
        r = ET.SubElement(e, S + "r")
        if rpr:
            r.append(ET.fromstring(rpr))
        put(r, s)


def _cells(parts: dict[str, bytes]) -> tuple[ET.Element | None, set[int], dict[str, ET.Element]]:
    shared = _parse(parts["xl/sharedStrings.xml"]) if "xl/sharedStrings.xml" in parts else None
    sheets = {n: _parse(parts[n]) for n in _sheets(parts)}
    used = {int(v.text) for s in sheets.values() for c in s.iter(S + "c") if c.get("t") == "s" and (v := c.find(S + "v")) is not None and v.text}
    return shared, used, sheets


def parse_xlsx(data: bytes) -> tuple[list[dict], bytes]:
    """Shared strings that a cell refers to, once each by ascending index, then inline strings in the order of sheets."""
    parts, out = read_zip(data), []
    shared, used, sheets = _cells(parts)

    def take(e: ET.Element, **context: str) -> None:
        runs = _rich(e)
        if not translatable("".join(s for _, s in runs)):
            return
        base, n = base_of(runs), len(out) + 1
        elements = to_elements(runs, base)
        out.append({"seg_no": n, "id": f"seg-{n}", "elements": elements, "plain": plain(elements), "context": context})
        _set_rich(e, [(base, f"{{{{SEG:{n:03d}}}}}")])

    if shared is not None:
        for i, si in enumerate(shared.findall(S + "si")):
            if i in used:
                take(si, source="shared", index=str(i))
        parts["xl/sharedStrings.xml"] = _dump(shared)
    for name, root in sheets.items():
        for c in root.iter(S + "c"):
            if c.get("t") == "inlineStr" and (e := c.find(S + "is")) is not None:
                take(e, source="inline", part=name, cell=c.get("r", ""))
        parts[name] = _dump(root)
    return out, write_zip(parts)


def rebuild_xlsx(skeleton: bytes, by_id: dict[str, list[dict]], lang: str) -> bytes:
    """The workbook without its calculation chain, which Excel makes anew."""
    parts = read_zip(skeleton)
    parts.pop("xl/calcChain.xml", None)
    for name in [n for n in ("xl/sharedStrings.xml", *_sheets(parts)) if n in parts]:
        root = _parse(parts[name])
        for e in [x for x in root.iter() if x.tag in (S + "si", S + "is")]:
            runs = _rich(e)
            m = _TOKEN.fullmatch("".join(s for _, s in runs))
            if m and f"seg-{int(m[1])}" in by_id:
                _set_rich(e, elements_to_runs(by_id[f"seg-{int(m[1])}"], runs[0][0]))
        parts[name] = _dump(root)
    return write_zip(parts)
