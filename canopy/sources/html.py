"""A tolerant HTML reader: void elements, raw text, implied html/head/body, and implied end tags."""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser

from canopy.model import Node, number
from canopy.sources.xml import Parsed

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# An opening tag first closes these open elements, up to the scope that holds them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.document = self.at = Node("document")
        self.errors: list[tuple[str, str, int, int]] = []
        self.doctype: str | None = None

    def open_names(self) -> list[str]:
        names, node = [], self.at
        while node.kind == "element":
            names.append(node.local)
            node = node.parent
        return names

    def error(self, code: str, message: str) -> None:
        line, column = self.getpos()
        self.errors.append((code, message, line, column + 1))

    def push(self, tag: str, attributes=()) -> None:
        node = Node("element", tag)
        for k, v in attributes:
            if node.get(k) is None:
                node.set(k, v if v is not None else "")
        self.at = self.at.append(node)

    def pop_to(self, tag: str) -> None:
        while self.at.kind == "element":
            name, self.at = self.at.local, self.at.parent
            if name == tag:
                return

    def need_place(self, tag: str) -> None:
        """Implied html, head and body."""
        names = self.open_names()
        if "html" not in names and tag != "html":
            self.push("html")
            names = ["html"]
        if tag in ("html", "head", "body", "frameset") or "body" in names:
            return
        if tag in HEAD:
            if "head" not in names and not any(c.local == "body" for c in self.at.elements()):
                self.push("head")
            return
        if "head" in names:
            self.pop_to("head")
        if self.at.local == "html":
            self.push("body")

    def handle_starttag(self, tag, attributes):
        names = self.open_names()
        if tag in ("html", "body") and tag in names:
            for k, v in attributes:
                node = self.at
                while node.local != tag:
                    node = node.parent
                if node.get(k) is None:
                    node.set(k, v or "")
            return
        self.need_place(tag)
        if tag == "body" and "head" in self.open_names():
            self.pop_to("head")
        if tag in BLOCK and "p" in self.open_names():
            self.pop_to("p")
        if tag in CLOSES:
            close, scope = CLOSES[tag]
            for name in self.open_names():
                if name in scope:
                    break
                if name in close:
                    self.pop_to(name)
        self.push(tag, attributes)
        if tag in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        names = self.open_names()
        if tag in VOID or tag not in names:
            self.error("orphan-end", f"</{tag}> closes nothing")
            return
        if names[0] != tag:
            self.error("misnested", f"</{tag}> closes {names[0]}")
        self.pop_to(tag)

    def handle_data(self, data):
        names = self.open_names()
        if names and names[0] in ("script", "style", "title", "textarea"):
            pass
        elif data.strip():
            self.need_place("#text")
        elif "body" not in names:
            return
        last = self.at.children[-1] if self.at.children else None
        if last is not None and last.kind == "text":
            last.value += data
        else:
            self.at.append(Node("text", value=data))

    def handle_comment(self, data):
        self.at.append(Node("comment", value=data))

    def handle_decl(self, decl):
        self.doctype = decl


def parse_html(text: str | bytes | None) -> Parsed:
    """A document from any text; errors list what had to be repaired."""
    reader = _Reader()
    if isinstance(text, bytes):
        text = text.decode(sniff_encoding(text), "replace")
    reader.feed(text or "")
    reader.close()
    for name in reader.open_names():
        if name not in ("html", "body", "p", "li", "td", "tr", "th", "tbody", "option", "dd", "dt"):
            reader.error("unclosed", f"<{name}> is not closed")
    parsed = Parsed(number(reader.document), reader.errors)
    parsed.dtd["doctype"] = reader.doctype
    return parsed


def quirks_mode(doctype: str | None) -> bool:
    """Whether a page without this doctype, or with an old one, is laid out in quirks mode."""
    return doctype is None or not re.match(r"(?i)doctype\s+html\s*($|system|public\s+[\"']-//w3c//dtd (x?html 1\.|html 4\.0[1])[^\"']*strict)", doctype)


def sniff_encoding(data: bytes, override: str | None = None) -> str:
    """Override, byte order mark, a meta element in the first 1024 bytes, else windows-1252."""
    if override:
        return override
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name
    said = re.search(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9._-]+)""", data[:1024], re.I)
    if said:
        try:
            return codecs.lookup(said[1].decode()).name
        except LookupError:
            pass
    return "windows-1252"
