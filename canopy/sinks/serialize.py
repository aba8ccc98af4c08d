"""Documents as text: XML, HTML and text output, and canonical XML."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from canopy.model import XML_NS, Node
from canopy.sources.html import VOID

BOOLEAN_ATTRIBUTES = frozenset("async autofocus checked compact controls declare defer disabled hidden ismap loop multiple muted nohref noresize noshade nowrap open readonly required reversed selected".split())


@dataclass
class Output:
    """Properties of an output."""

    method: str = "xml"
    declaration: bool = False
    encoding: str = "UTF-8"
    indent: bool = False
    doctype_public: str = ""
    doctype_system: str = ""
    cdata_elements: frozenset[str] = frozenset()
    character_map: dict[str, str] = field(default_factory=dict)
    standalone: str = ""
    ascii_only: bool = False


def escape_text(s: str, ascii_only: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")
    return "".join(c if ord(c) < 128 else f"&#{ord(c)};" for c in s) if ascii_only else s


def escape_attribute(s: str, ascii_only: bool = False) -> str:
    return escape_text(s, ascii_only).replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#9;")


def _mapped(s: str, out: Output, escape) -> str:
    if not out.character_map:
        return escape(s, out.ascii_only)
    return "".join(out.character_map[c] if c in out.character_map else escape(c, out.ascii_only) for c in s)


def _namespaces(node: Node) -> list[tuple[str, str]]:
    """Declarations that an element needs against its parent."""
    above = node.parent.ns_map if node.parent is not None and node.parent.kind == "element" else {"xml": XML_NS}
    return sorted((p, u) for p, u in node.ns_map.items() if above.get(p, "") != u and p != "xml") + [("", "")] * bool(above.get("") and "" not in node.ns_map)


def serialize(node: Node, out: Output | None = None) -> str:
    """Text of a document or any node."""
    out = out or Output()
    if out.method == "text":
        return _mapped(node.string(), out, lambda s, _: s)
    parts: list[str] = []
    if out.declaration and out.method in ("xml", "xhtml"):
        parts.append(f'<?xml version="1.0" encoding="{out.encoding}"' + (f' standalone="{out.standalone}"' if out.standalone else "") + "?>" + "\n" * out.indent)
    root = next((c for c in node.children if c.kind == "element"), None) if node.kind == "document" else node
    if (out.doctype_system or out.doctype_public) and root is not None:
        public = f' PUBLIC "{out.doctype_public}"' if out.doctype_public else " SYSTEM" if out.doctype_system else ""
        parts.append(f"<!DOCTYPE {root.name}{public}" + (f' "{out.doctype_system}"' if out.doctype_system else "") + ">\n")
    _write(node, out, parts, 0)
    return "".join(parts)


def _write(node: Node, out: Output, parts: list[str], depth: int) -> None:
    kind = node.kind
    if kind == "document":
        for i, c in enumerate(node.children):
            if out.indent and i:
                parts.append("\n")
            _write(c, out, parts, depth)
    elif kind in ("text", "cdata"):
        raw = out.method == "html" and node.parent is not None and node.parent.local in ("script", "style")
        if kind == "cdata" or node.parent is not None and node.parent.name in out.cdata_elements:
            parts.append("<![CDATA[" + node.value.replace("]]>", "]]]]><![CDATA[>") + "]]>")
        else:
            parts.append(node.value if raw or node.prefix == "raw" else _mapped(node.value, out, escape_text))
    elif kind == "comment":
        parts.append(f"<!--{node.value}-->")
    elif kind == "processing-instruction":
        parts.append(f"<?{node.local} {node.value}".rstrip() + (">" if out.method == "html" else "?>"))
    elif kind == "attribute":
        parts.append(f'{node.name}="{escape_attribute(node.value)}"')
    elif kind == "element":
        _element(node, out, parts, depth)


def _element(node: Node, out: Output, parts: list[str], depth: int) -> None:
    html = out.method == "html" and not node.ns
    parts.append(f"<{node.name}")
    for prefix, uri in [] if html else _namespaces(node):
        parts.append(f' xmlns{":" + prefix if prefix else ""}="{escape_attribute(uri)}"')
    for a in node.attributes:
        short = html and a.local.lower() in BOOLEAN_ATTRIBUTES and a.value.lower() in ("", a.local.lower())
        value = _mapped(a.value, out, escape_attribute)
        parts.append(f" {a.name}" if short else f' {a.name}="{value.replace("&lt;", "<") if html else value}"')
    if html and node.local.lower() in VOID:
        parts.append(">")
        return
    if not node.children:
        parts.append(f"></{node.name}>" if html or out.method == "xhtml" and node.local not in VOID else " />" if out.method == "xhtml" else "/>")
        return
    parts.append(">")
    mixed = any(c.kind in ("text", "cdata") and c.value.strip() for c in node.children)
    pretty = out.indent and not mixed and node.get("space", XML_NS) != "preserve"
    for c in node.children:
        if pretty and c.kind == "text":
            continue
        if pretty:
            parts.append("\n" + "  " * (depth + 1))
        _write(c, out, parts, depth + 1)
    if pretty:
        parts.append("\n" + "  " * depth)
    parts.append(f"</{node.name}>")


def canonicalize(node: Node, exclusive: bool = False, comments: bool = False, inclusive_prefixes: frozenset[str] = frozenset()) -> str:
    """Canonical XML 1.0, or exclusive canonical XML."""
    parts: list[str] = []

    def text(s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#xD;")

    def attribute(s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;").replace("\t", "&#x9;").replace("\n", "&#xA;").replace("\r", "&#xD;")

    def write(n: Node, shown: dict[str, str]) -> None:
        if n.kind in ("text", "cdata"):
            parts.append(text(n.value))
        elif n.kind == "comment" and comments:
            parts.append(f"<!--{n.value}-->")
        elif n.kind == "processing-instruction":
            parts.append(f"<?{n.local}{' ' + n.value if n.value else ''}?>")
        elif n.kind == "element":
            scope = {p: u for p, u in n.ns_map.items() if p != "xml"}
            if exclusive:
                used = {n.prefix} | {a.prefix for a in n.attributes if a.prefix} | {p for p in inclusive_prefixes if p in scope}
                scope = {p: u for p, u in scope.items() if p in used}
            new = {p: u for p, u in scope.items() if shown.get(p, "") != u}
            if shown.get("") and not scope.get("") and (not exclusive or not n.prefix):
                new[""] = ""
            parts.append(f"<{n.name}")
            parts.extend(f' xmlns{":" + p if p else ""}="{attribute(u)}"' for p, u in sorted(new.items()))
            parts.extend(f' {a.name}="{attribute(a.value)}"' for a in sorted(n.attributes, key=lambda a: (a.ns, a.local)))
            parts.append(">")
            inner = shown | new
            for c in n.children:
                write(c, inner)
            parts.append(f"</{n.name}>")

    if node.kind == "document":
        kept = [c for c in node.children if c.kind in ("element", "processing-instruction") or c.kind == "comment" and comments]
        root = next((i for i, c in enumerate(kept) if c.kind == "element"), 0)
        for i, c in enumerate(kept):
            parts.append("\n" if i > root else "")
            write(c, {})
            parts.append("\n" if i < root else "")
    else:
        write(node, {})
    return "".join(parts)


def canonical_bytes(node: Node, **options) -> bytes:
    return canonicalize(node, **options).encode("utf-8")


def squeeze(text: str) -> str:
    """White space between tags removed, for comparisons."""
    return re.sub(r">\s+<", "><", text.strip())
