"""Parsers of text formats: bytes -> (segments, skeleton), and back. A skeleton holds {{SEG:001}} where segment 1 stood."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from xml.sax.saxutils import escape as xml_escape

from ..model import CLOSING, OPENING, STANDALONE, code, plain, text

BLANKS = " \t\n\r\0\x0b"
TOKEN = re.compile(r"\{\{SEG:(\d+)\}\}")


def token(n: int) -> str:
    return f"{{{{SEG:{n:03d}}}}}"


def segment(n: int, elements: list[dict], **context: str) -> dict:
    return {"seg_no": n, "id": f"seg-{n}", "elements": elements, "plain": plain(elements), "context": {k: str(v) for k, v in context.items()}}


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def fill(skeleton: str, by_id: dict[str, list[dict]], render) -> str:
    return TOKEN.sub(lambda m: render(by_id[f"seg-{int(m[1])}"]) if f"seg-{int(m[1])}" in by_id else m[0], skeleton)


# Plain text: chunks between blank lines.


def parse_plain(data: bytes, blank: bool = False) -> tuple[list[dict], str]:
    """A chunk is a segment unless it is blank; with `blank` it is one in any case, also where a text begins or ends with blank lines or is empty."""
    body = decode(data).replace("\r\n", "\n").replace("\r", "\n")
    out, skeleton = [], ""
    for i, part in enumerate(re.split(r"(\n{2,})", body)):
        if part.strip(BLANKS) or blank and i % 2 == 0:
            out.append(segment(len(out) + 1, [text(part)]))
            skeleton += token(len(out))
        else:
            skeleton += part
    return out, skeleton


def rebuild_plain(skeleton: str, by_id: dict[str, list[dict]], lang: str) -> bytes:
    return fill(skeleton, by_id, plain).encode()


# HTML


BLOCKS = set("blockquote caption dd div dt figcaption h1 h2 h3 h4 h5 h6 li p td th".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Which open elements a start tag ends.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
_ENDS_P = BLOCKS | set("article aside dl footer form header hr main nav ol pre section table ul".split())
_SCOPE = set("ul ol dl table div article section blockquote body td th".split())


class Node:
    __slots__ = ("tag", "raw", "end", "children", "parent")

    def __init__(self, tag: str, raw: str, parent: Node | None):
        self.tag, self.raw, self.end, self.children, self.parent = tag, raw, "", [], parent


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = self.now = Node("", "", None)

    def _open(self, tag: str, raw: str) -> Node:
        node = Node(tag, raw, self.now)
        self.now.children.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        at = self.now
        while ends and at.parent is not None:
            if at.tag in ends:
                self.now = at.parent
                break
            if at.tag in _SCOPE:
                break
            at = at.parent
        node = self._open(tag, self.get_starttag_text())
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self._open(tag, self.get_starttag_text())

    def handle_endtag(self, tag):
        at = self.now
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            at.end = f"</{tag}>"
            self.now = at.parent

    def _add(self, s: str, escaped: bool) -> None:
        self.now.children.append((s, escaped))

    def handle_data(self, data):
        self._add(data, self.now.tag not in ("script", "style"))

    def handle_entityref(self, name):
        self._add(f"&{name};", True)

    def handle_charref(self, name):
        self._add(f"&#{name};", True)

    def handle_comment(self, data):
        self._add(f"<!--{data}-->", False)

    def handle_decl(self, decl):
        self._add(f"<!{decl}>", False)

    def handle_pi(self, data):
        self._add(f"<?{data}>", False)


def _has_block(node: Node) -> bool:
    return any(isinstance(c, Node) and (c.tag in BLOCKS or _has_block(c)) for c in node.children)


def _inline(node: Node, seq: list[int]) -> list[dict]:
    out: list[dict] = []
    for c in node.children:
        if isinstance(c, tuple):
            if c[1]:
                s = html.unescape(c[0])
                if out and out[-1]["kind"] == "t":
                    out[-1]["text"] += s
                else:
                    out.append(text(s))
        elif c.tag not in BLOCKS:  # a block inside inline content is left out
            seq[0] += 1
            name = f"{c.tag}{seq[0]}"
            if c.tag in VOID:
                out.append(code(name, STANDALONE, c.raw, f"<{c.tag}/>"))
            else:
                inner = _inline(c, seq)
                out += [code(name, OPENING, c.raw, f"<{c.tag}>"), *inner, code(name, CLOSING, f"</{c.tag}>", f"</{c.tag}>")]
    return out


def parse_html(data: bytes) -> tuple[list[dict], str]:
    """Each block without blocks inside is a segment; of a block with blocks inside only element children count."""
    tree = _Tree()
    tree.feed(decode(data))
    tree.close()
    out: list[dict] = []

    def walk(node: Node, inside: bool) -> str:
        if inside and node.tag in BLOCKS and not any(isinstance(c, Node) and (c.tag in BLOCKS or _has_block(c)) for c in node.children):
            elements = _inline(node, [0])
            if plain(elements).strip(BLANKS):
                out.append(segment(len(out) + 1, elements))
                return node.raw + token(len(out)) + node.end
        inside = inside or node.tag == "body"
        body = "".join(c[0] if isinstance(c, tuple) else walk(c, inside) for c in node.children)
        return node.raw + body + node.end

    has_body = any(isinstance(c, Node) for c in tree.root.children) and "<body" in decode(data).lower()
    return out, walk(tree.root, not has_body)


def _escape_html(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&apos;")


def rebuild_html(skeleton: str, by_id: dict[str, list[dict]], lang: str) -> bytes:
    return fill(skeleton, by_id, lambda es: "".join(_escape_html(e["text"]) if e["kind"] == "t" else e["data"] for e in es)).encode()


# XML


def _start(e: ET.Element) -> str:
    return "<" + e.tag + "".join(f' {k}="{xml_escape(v, {chr(34): "&quot;"})}"' for k, v in e.attrib.items()) + ">"


def parse_xml(data: bytes) -> tuple[list[dict], str]:
    """An element with text of its own that isn't blank is a segment, its children inside are codes; malformed XML raises."""
    root = ET.fromstring(data)
    out: list[dict] = []

    def codes(e: ET.Element, seq: list[int]) -> list[dict]:
        es = [text(e.text)] if e.text else []
        for c in e:
            seq[0] += 1
            name = f"{c.tag}{seq[0]}"
            inner = codes(c, seq)
            es += [code(name, OPENING, _start(c), f"<{c.tag}>"), *inner, code(name, CLOSING, f"</{c.tag}>", f"</{c.tag}>")]
            if c.tail:
                es.append(text(c.tail))
        return es

    def walk(e: ET.Element) -> str:
        if any(t and t.strip(BLANKS) for t in (e.text, *(c.tail for c in e))):
            out.append(segment(len(out) + 1, codes(e, [0])))
            return f"{_start(e)}{token(len(out))}</{e.tag}>"
        inner = xml_escape(e.text or "") + "".join(walk(c) + xml_escape(c.tail or "") for c in e)
        return f"{_start(e)}{inner}</{e.tag}>"

    return out, '<?xml version="1.0" encoding="UTF-8"?>\n' + walk(root) + "\n"


def rebuild_xml(skeleton: str, by_id: dict[str, list[dict]], lang: str) -> bytes:
    esc = lambda s: xml_escape(s, {'"': "&quot;", "'": "&apos;"})
    return fill(skeleton, by_id, lambda es: "".join(esc(e["text"]) if e["kind"] == "t" else e["data"] for e in es)).encode()


# PO


_PO_LINE = re.compile(r'^\s*(?:(msgctxt|msgid_plural|msgid|msgstr(?:\[\d+\])?)\s+)?"(.*)"\s*$')
_UNESCAPE = {"\\n": "\n", "\\t": "\t", '\\"': '"', "\\\\": "\\"}


def unescape_po(s: str) -> str:
    return re.sub(r"\\.", lambda m: _UNESCAPE.get(m[0], m[0]), s)


def escape_po(s: str) -> str:
    return re.sub(r'[\\"\n\t]', lambda m: {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t"}[m[0]], s)


def parse_po(data: bytes) -> tuple[list[dict], str]:
    """msgid of each entry that is neither the header nor fuzzy; of plural entries the singular."""
    out: list[dict] = []
    parts = re.split(r"(\n[ \t]*\n)", decode(data).replace("\r\n", "\n"))
    for i in range(0, len(parts), 2):
        values: dict[str, str] = {}
        lines, now = parts[i].split("\n"), None
        if any(x.startswith("#,") and "fuzzy" in x for x in lines):
            continue
        where: dict[str, list[int]] = {}
        for k, line in enumerate(lines):
            m = _PO_LINE.match(line)
            if not m or line.lstrip().startswith("#"):
                continue
            if m[1]:
                now = m[1]
                values[now] = ""
                where[now] = []
            if now:
                values[now] += unescape_po(m[2])
                where[now].append(k)
        slots = [k for k in values if k.startswith("msgstr")]
        if not values.get("msgid") or not slots:
            continue
        out.append(segment(len(out) + 1, [text(values["msgid"])]))
        for j, slot in enumerate(sorted(slots)):
            first, *more = where[slot]
            lines[first] = f'{slot} "{token(len(out)) if j == 0 else ""}"'
            for k in more:
                lines[k] = None
        parts[i] = "\n".join(x for x in lines if x is not None)
    return out, "".join(parts)


def rebuild_po(skeleton: str, by_id: dict[str, list[dict]], lang: str) -> bytes:
    return fill(skeleton, by_id, lambda es: escape_po(plain(es))).encode()
