"""XML sources: a strict expat reader, a recovering reader, and parsing of columns into the node table.

Nothing is ever loaded from the network or the file system on behalf of a document. Malformed rows never fail a task:
they give an error in the ``errors`` column, and with ``recover`` the nodes of a best-effort tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.model import NODE_FIELDS, Node, number, rows

ERROR_TYPE = "array<struct<code: string, message: string, line: int, col: int>>"


@dataclass(frozen=True)
class Options:
    """What changes the result of a parse."""

    namespaces: bool = True
    recover: bool = False
    keep_blanks: bool = True
    keep_comments: bool = True
    keep_pis: bool = True
    keep_cdata: bool = False
    namespace_nodes: bool = False
    entity_bytes: int = 10_000_000
    depth: int = 4096


@dataclass
class Parsed:
    """A document, its errors and what its DTD declares."""

    document: Node
    errors: list[tuple[str, str, int, int]] = field(default_factory=list)
    dtd: dict = field(default_factory=lambda: {"elements": {}, "attributes": {}, "entities": {}, "unparsed": {}, "doctype": None})


class Limit(Exception):
    """A budget was exceeded."""


def detect_encoding(data: bytes) -> str:
    """Byte order mark, then the patterns of the XML declaration, then the declaration itself."""
    for mark, name in ((b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name
    for mark, name in ((b"<\0\0\0", "utf-32-le"), (b"\0\0\0<", "utf-32-be"), (b"<\0?\0", "utf-16-le"), (b"\0<\0?", "utf-16-be"), (b"\x4c\x6f\xa7\x94", "cp037")):
        if data.startswith(mark):
            head = data[:400].decode(name, "replace") if name == "cp037" else ""
            said = re.search(r"""encoding\s*=\s*["']([A-Za-z0-9._-]+)""", head)
            return {"ibm500": "cp500", "ibm1140": "cp1140"}.get(said[1].lower(), name) if said else name
    said = re.match(rb"""<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)""", data[:400])
    return said[1].decode() if said else "utf-8"


def decode(data: bytes) -> str:
    """Text of a document, without its byte order mark."""
    return data.decode(detect_encoding(data)).removeprefix("﻿")


class _Builder:
    """Builds a tree from start, end, text and other events."""

    def __init__(self, options: Options):
        self.options = options
        self.document = self.at = Node("document")
        self.depth = 0

    def start(self, name: str, attributes: list[tuple[str, str]]) -> None:
        self.depth += 1
        if self.depth > self.options.depth:
            raise Limit("elements are nested too deeply")
        at = self.at
        scope = at.ns_map
        declared = {}
        if self.options.namespaces:
            for k, v in attributes:
                if k.startswith("xmlns") and (k == "xmlns" or k[5] == ":"):
                    declared[k[6:]] = v
            if declared:
                scope = scope | declared
        node = Node("element")
        node.ns_map, node.declared = scope, declared
        if ":" in name:
            node.prefix, node.local, node.ns = self.resolve(name, scope, True)
        else:
            node.local = name
            if self.options.namespaces:
                node.ns = scope.get("", "")
        plain = not declared
        for k, v in attributes:
            if ":" in k:
                plain = False
                break
        if plain:  # a reader has refused repeated names
            for k, v in attributes:
                a = Node("attribute", k, "", "", v)
                a.parent = node
                node.attributes.append(a)
        else:
            for k, v in attributes:
                if self.options.namespaces and (k == "xmlns" or k.startswith("xmlns:")):
                    continue
                prefix, local, ns = self.resolve(k, scope, False)
                node.set(local, v, ns, prefix)
        node.parent = at
        at.children.append(node)
        self.at = node

    def resolve(self, name: str, scope: dict[str, str], element: bool) -> tuple[str, str, str]:
        if not self.options.namespaces:
            return "", name, ""
        prefix, colon, local = name.rpartition(":")
        if not colon:
            return "", name, scope.get("", "") if element else ""
        if prefix not in scope and not self.options.recover:
            raise Limit(f"unbound prefix {prefix}")
        return prefix, local, scope.get(prefix, "")

    def end(self, name: str = "") -> None:
        self.depth -= 1
        if not self.options.keep_blanks:
            self.tidy()
        self.at = self.at.parent or self.document

    def text(self, data: str, kind: str = "text") -> None:
        siblings = self.at.children
        if siblings and siblings[-1].kind == kind == "text":
            siblings[-1].value += data
        else:
            node = Node(kind, "", "", "", data)
            node.parent = self.at
            siblings.append(node)

    def tidy(self) -> None:
        self.at.children = [c for c in self.at.children if c.kind != "text" or c.value.strip(" \t\r\n")]

    def other(self, kind: str, local: str, value: str) -> None:
        if (kind == "comment" and self.options.keep_comments) or (kind == "processing-instruction" and self.options.keep_pis):
            self.at.append(Node(kind, local, value=value))


def parse(text: str | bytes | None, options: Options = Options()) -> Parsed:
    """A document from text; the errors are empty if it is well-formed."""
    if text is None:
        return Parsed(Node("document"), [("empty", "no document", 0, 0)])
    try:
        source = decode(text) if isinstance(text, bytes) else text.removeprefix("﻿")
    except (UnicodeError, LookupError) as e:
        return Parsed(Node("document"), [("encoding", str(e)[:200], 0, 0)])
    parsed = _strict(source, options)
    if parsed.errors and options.recover:
        return Parsed(_recovered(source, options, parsed.errors), parsed.errors, parsed.dtd)
    return parsed


def _strict(text: str, options: Options) -> Parsed:
    build = _Builder(options)
    out = Parsed(build.document)
    reader = expat.ParserCreate(encoding="utf-8")
    reader.ordered_attributes = True
    reader.buffer_text = True
    reader.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    cdata, expanded, most = False, 0, len(text) + options.entity_bytes
    dtd, add = out.dtd, build.text

    def characters(data: str) -> None:
        nonlocal expanded
        expanded += len(data)
        if expanded > most:
            raise Limit("entities expand to more than their budget")
        add(data, "cdata" if cdata and options.keep_cdata else "text")

    def in_cdata(now: bool) -> None:
        nonlocal cdata
        cdata = now

    def attlist(element: str, name: str, kind: str, default: str | None, required: bool) -> None:
        dtd["attributes"].setdefault(element, {})[name] = (kind, default, bool(required))

    def entity(name: str, parameter: bool, value: str | None, base, system, public, notation) -> None:
        if notation:
            dtd["unparsed"][name] = system
        elif not parameter and value is not None:
            dtd["entities"][name] = value

    reader.StartElementHandler = lambda name, a, start=build.start: start(name, list(zip(a[::2], a[1::2])) if a else a)
    reader.EndElementHandler = build.end
    reader.CharacterDataHandler = characters
    reader.CommentHandler = lambda data: build.other("comment", "", data)
    reader.ProcessingInstructionHandler = lambda target, data: build.other("processing-instruction", target, data)
    reader.StartCdataSectionHandler = lambda: in_cdata(True)
    reader.EndCdataSectionHandler = lambda: in_cdata(False)
    reader.ElementDeclHandler = lambda name, model: dtd["elements"].update({name: model})
    reader.AttlistDeclHandler = attlist
    reader.EntityDeclHandler = entity
    reader.StartDoctypeDeclHandler = lambda name, system, public, internal: dtd.update(doctype=(name, system, public))
    try:
        if text.startswith("<?xml"):
            text = re.sub(r"""^(<\?xml[^>]*?)\s+encoding\s*=\s*("[^"]*"|'[^']*')""", r"\1", text, count=1)
        reader.Parse(text.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        out.errors.append(("syntax", expat.ErrorString(e.code), e.lineno, e.offset + 1))
    except Limit as e:
        out.errors.append(("limit", str(e), reader.CurrentLineNumber, reader.CurrentColumnNumber + 1))
    number(out.document)
    return out


_TOKEN = re.compile(r"<!--(.*?)-->|<!\[CDATA\[(.*?)\]\]>|<\?([A-Za-z_:][^\s?]*)\s*(.*?)\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>|</\s*([A-Za-z_:][^\s>/]*)[^>]*>|<([A-Za-z_:][^\s>/]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][^\s=/>]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def unescape(text: str) -> str:
    """Decodes the five predefined entities and character references; others stay as they are."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name.startswith("#"):
            code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 and code else m[0]
        return _ENTITIES.get(name, m[0])

    return re.sub(r"&(#[0-9]{1,8}|#[xX][0-9A-Fa-f]{1,7}|[A-Za-z][A-Za-z0-9]*);", one, text)


def _recovered(text: str, options: Options, errors: list) -> Node:
    """Best effort: open elements close at the end, end tags close what they match or are dropped, stray markup is text."""
    build = _Builder(options)
    at = 0
    text = re.sub(r"^\s*<\?xml[^>]*\?>", "", text)
    while at < len(text):
        m = _TOKEN.search(text, at)
        plain = text[at : m.start() if m else len(text)]
        if plain and (build.at.kind != "document" or plain.strip()):
            build.text(unescape(plain))
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            build.other("comment", "", m[1])
        elif m[2] is not None:
            build.text(m[2], "cdata" if options.keep_cdata else "text")
        elif m[3] is not None:
            build.other("processing-instruction", m[3], m[4])
        elif m[5] is not None:
            open_, node = [], build.at
            while node.kind == "element":
                open_.append(node.name)
                node = node.parent
            if m[5] in open_:
                for _ in range(open_.index(m[5]) + 1):
                    build.end()
            else:
                errors.append(("orphan-end", f"</{m[5]}> closes nothing", 0, 0))
        elif m[6] is not None:
            attributes = {k: unescape(next((v for v in vs if v), "")) for k, *vs in _ATTRIBUTE.findall(m[7])}
            build.start(m[6], list(attributes.items()))
            if m[8]:
                build.end()
    while build.at.kind == "element":
        build.end()
    return number(build.document)


def well_formed(text: str | bytes | None) -> bool:
    """Whether a text is a well-formed document."""
    return not parse(text).errors


def parsed_column(df: DataFrame, id_col: str, text_col: str, options: Options = Options(), html: bool = False) -> DataFrame:
    """(doc_id, nodes array, errors) of every row; rows are parsed in Arrow batches, one document at a time."""
    fields = [f.strip().split() for f in NODE_FIELDS.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def read(batches):
        for batch in batches:
            ids, nodes, errors = [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                if html:
                    from canopy.sources.html import parse_html

                    found = parse_html(text.as_py())
                else:
                    found = parse(text.as_py(), options)
                ids.append(key.as_py())
                nodes.append([dict(zip((n for n, _ in fields), r)) for r in rows(found.document, options.namespace_nodes)] if options.recover or html or not found.errors else [])
                errors.append([{"code": e[0], "message": e[1], "line": e[2], "col": e[3]} for e in found.errors])
            node = pa.struct([(n, kinds[k]) for n, k in fields])
            error = pa.struct([("code", pa.string()), ("message", pa.string()), ("line", pa.int32()), ("col", pa.int32())])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(node)), pa.array(errors, pa.list_(error))], names=["doc_id", "nodes", "errors"])

    struct = ", ".join(f"{n}: {k}" for n, k in fields)
    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(read, f"doc_id long, nodes array<struct<{struct}>>, errors {ERROR_TYPE}")


def parse_nodes(df: DataFrame, id_col: str, text_col: str, options: Options = Options(), html: bool = False) -> DataFrame:
    """The node table of a text column."""
    return parsed_column(df, id_col, text_col, options, html).select("doc_id", F.inline("nodes"))


def lint(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ok, errors) of every row."""
    return parsed_column(df, id_col, text_col).select("doc_id", (F.size("errors") == 0).alias("ok"), "errors")


def events(df: DataFrame, id_col: str, text_col: str, options: Options = Options()) -> DataFrame:
    """Pull-reader events (doc_id, seq, event, name, content, path, depth) of every row."""

    def walk(document: Node):
        stack: list = [(c, "", 1) for c in document.children[::-1]]
        while stack:
            node, above, depth = stack.pop()
            if depth < 0:
                yield "end", node.name, None, above, -depth
                continue
            path = f"{above}/{node.name}" if node.kind == "element" else above
            if node.kind == "element":
                yield "start", node.name, None, path, depth
                stack.append((node, path, -depth))
                stack.extend((c, path, depth + 1) for c in node.children[::-1])
            else:
                yield node.kind, node.name, node.value, path, depth

    def read(batches):
        for batch in batches:
            out = [[key.as_py(), i, *e] for key, text in zip(batch.column(0), batch.column(1)) for i, e in enumerate(walk(parse(text.as_py(), options).document))]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "seq", "event", "name", "content", "path", "depth"])

    return df.select(F.col(id_col).cast("long"), text_col).mapInArrow(read, "doc_id long, seq int, event string, name string, content string, path string, depth int")
