"""The tree model: nodes in one document (for row-local work) and the node table (for relational work)."""

from __future__ import annotations

from collections.abc import Iterator

#: One row a node, in document order; namespace nodes and attributes come between their element and its first child.
NODE_FIELDS = (
    "pre long, size long, level int, parent long, kind string, name string, prefix string, local string, ns string, "
    "value string, sib int, elem_sib int, owner long, path string"
)
NODE_SCHEMA = f"doc_id long, {NODE_FIELDS}"
XML_NS = "http://www.w3.org/XML/1998/namespace"


_XML_ONLY: dict[str, str] = {"xml": XML_NS}
_NOTHING: dict[str, str] = {}


class Node:
    """A tree node; ``ns_map`` holds an element's in-scope prefixes."""

    __slots__ = ("attributes", "children", "kind", "local", "ns", "ns_map", "order", "parent", "prefix", "value", "declared", "root_key")

    def __init__(self, kind: str, local: str = "", ns: str = "", prefix: str = "", value: str = ""):
        self.kind = kind
        self.local = local
        self.ns = ns
        self.prefix = prefix
        self.value = value
        self.children: list[Node] = []
        self.attributes: list[Node] = []
        self.parent: Node | None = None
        self.ns_map = _XML_ONLY  # replaced, never changed
        self.declared = _NOTHING
        self.order = self.root_key = 0

    @property
    def name(self) -> str:
        return f"{self.prefix}:{self.local}" if self.prefix else self.local

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def set(self, local: str, value: str, ns: str = "", prefix: str = "") -> Node:
        for a in self.attributes:
            if (a.local, a.ns) == (local, ns):
                a.value = value
                return a
        a = Node("attribute", local, ns, prefix, value)
        a.parent = self
        self.attributes.append(a)
        return a

    def get(self, local: str, ns: str = "") -> str | None:
        for a in self.attributes:
            if a.local == local and a.ns == ns:
                return a.value
        return None

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == "element"]

    def descendants(self) -> Iterator[Node]:
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack += node.children[::-1]

    def root(self) -> Node:
        node = self
        while node.parent is not None:
            node = node.parent
        return node

    def string(self) -> str:
        if self.kind not in ("element", "document"):
            return self.value
        if len(self.children) == 1 and self.children[0].kind == "text":
            return self.children[0].value
        parts, stack = [], self.children[::-1]
        while stack:
            node = stack.pop()
            if node.children:
                stack += node.children[::-1]
            elif node.kind in ("text", "cdata"):
                parts.append(node.value)
        return "".join(parts)


def namespace_nodes(element: Node) -> list[Node]:
    """One namespace node for each prefix in scope."""
    found = []
    for prefix, uri in sorted(element.ns_map.items()):
        if uri:
            node = Node("namespace", prefix, "", "", uri)
            node.parent = element
            found.append(node)
    return found


def number(document: Node, key: int = 0) -> Node:
    """Gives every node its place in document order."""
    at, stack = 0, [document]
    while stack:
        node = stack.pop()
        node.order = at
        node.root_key = key
        at += 1
        if node.kind == "element":
            at += len(node.ns_map)
        for a in node.attributes:
            a.order = at
            a.root_key = key
            at += 1
        if node.children:
            stack += node.children[::-1]
    return document


def path_name(ns: str, local: str) -> str:
    """An element's step in a stored path: its local name, after its namespace in braces if it has one."""
    return f"{{{ns.replace('%', '%25').replace('/', '%2F').replace('@', '%40')}}}{local}" if ns else local


def rows(document: Node, namespaces: bool = False) -> list[list]:
    """Node-table rows (NODE_FIELDS) of a document, in order; without recursion."""
    out: list[list] = []

    def add(node: Node, level: int, parent: int | None, path: str, sib: int, elem_sib: int, owner: int | None) -> int:
        pre = len(out)
        value = node.value if node.kind not in ("element", "document") else None
        out.append([pre, 0, level, parent, node.kind, node.name, node.prefix, node.local, node.ns, value, sib, elem_sib, owner, path])
        return pre

    # (node, level, parent's pre, parent's path, sib, elem_sib) or the pre of an element that ends
    stack: list = [(document, 0, None, "", 0, 0)]
    while stack:
        item = stack.pop()
        if isinstance(item, int):
            out[item][1] = len(out) - 1 - item
            continue
        node, level, parent, above, sib, elem_sib = item
        step = {"document": "", "element": f"/{path_name(node.ns, node.local)}", "processing-instruction": "/processing-instruction()"}.get(node.kind, f"/{'text' if node.kind == 'cdata' else node.kind}()")
        path = above + step
        pre = add(node, level, parent, path, sib, elem_sib, None)
        if node.kind in ("element", "document"):
            for extra in namespace_nodes(node) if namespaces and node.kind == "element" else ():
                add(extra, level + 1, pre, f"{path}/namespace::{extra.local}", 0, 0, pre)
            for i, a in enumerate(node.attributes):
                add(a, level + 1, pre, f"{path}/@{a.name}", i + 1, i + 1, pre)
            stack.append(pre)
            kids, n_elem = [], 0
            for i, child in enumerate(node.children):
                n_elem += child.kind == "element"
                kids.append((child, level + 1, pre, path, i + 1, n_elem))
            stack.extend(kids[::-1])
    return out
