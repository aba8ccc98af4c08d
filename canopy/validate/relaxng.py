"""RELAX NG by derivatives of patterns (XML syntax)."""

from __future__ import annotations

from functools import lru_cache

from canopy.model import Node
from canopy.sources.xml import parse

RNG = "http://relaxng.org/ns/structure/1.0"
EMPTY, NOT_ALLOWED, TEXT = ("empty",), ("notAllowed",), ("text",)


class Grammar:
    """A compiled schema; patterns are tuples and references are looked up by name."""

    def __init__(self, source: str):
        parsed = parse(source)
        if parsed.errors:
            raise ValueError(parsed.errors[0][1])
        root = parsed.document.elements()[0]
        self.defines: dict[str, tuple] = {}
        self.start = NOT_ALLOWED
        if root.local == "grammar":
            self.grammar(root)
        else:
            self.start = self.pattern(root)
        self.nullable = lru_cache(maxsize=None)(self._nullable)

    def grammar(self, root: Node) -> None:
        for n in root.elements():
            if n.local == "div":
                self.grammar(n)
                continue
            body = self.group([c for c in n.elements() if c.ns == RNG])
            old = self.start if n.local == "start" else self.defines.get(n.get("name") or "")
            if old not in (None, NOT_ALLOWED):
                body = interleave(old, body) if n.get("combine") == "interleave" else choice(old, body)
            if n.local == "start":
                self.start = body
            elif n.local == "define":
                self.defines[n.get("name") or ""] = body

    def group(self, nodes: list[Node]) -> tuple:
        made = EMPTY
        for n in nodes[::-1]:
            made = group(self.pattern(n), made)
        return made

    def inherited(self, node: Node, name: str) -> str:
        at: Node | None = node
        while at is not None and at.kind == "element":
            if (said := at.get(name)) is not None:
                return said
            at = at.parent
        return ""

    def pattern(self, n: Node) -> tuple:
        kids = [c for c in n.elements() if c.ns == RNG]
        kind = n.local
        if kind in ("element", "attribute"):
            name = self.qname(n.get("name"), n, kind == "element") if n.get("name") else self.name_class(kids.pop(0), kind == "element")
            return (kind, name, self.group(kids) if kids or kind == "element" else TEXT)
        if kind == "ref" or kind == "parentRef":
            return ("ref", n.get("name"))
        if kind in ("empty", "notAllowed", "text"):
            return (kind,)
        if kind == "value":
            return ("value", n.get("type") or "token", n.string())
        if kind == "data":
            params = tuple((p.get("name"), p.string()) for p in kids if p.local == "param")
            excepted = next((self.pattern(e.elements()[0]) for e in kids if e.local == "except"), NOT_ALLOWED)
            return ("data", n.get("type"), params, excepted)
        body = self.group(kids)
        if kind == "choice":
            made = NOT_ALLOWED
            for c in kids:
                made = choice(made, self.pattern(c))
            return made
        if kind == "interleave":
            made = EMPTY
            for c in kids:
                made = interleave(made, self.pattern(c))
            return made
        if kind == "mixed":
            return interleave(TEXT, body)
        if kind == "optional":
            return choice(body, EMPTY)
        if kind == "oneOrMore":
            return one_or_more(body)
        if kind == "zeroOrMore":
            return choice(one_or_more(body), EMPTY)
        if kind == "list":
            return ("list", body)
        if kind == "group":
            return body
        if kind == "grammar":
            self.grammar(n)
            return self.start
        raise ValueError(f"unknown pattern {kind}")

    def qname(self, name: str, n: Node, element: bool) -> tuple:
        prefix, colon, local = name.strip().rpartition(":")
        return ("name", n.ns_map.get(prefix, "") if colon else self.inherited(n, "ns") if element or n.get("ns") else "", local)

    def name_class(self, n: Node, element: bool) -> tuple:
        if n.local == "name":
            return self.qname(n.string(), n, element)
        excepted = tuple(self.name_class(c, element) for e in n.elements() if e.local == "except" for c in e.elements())
        if n.local == "choice":
            return ("any-of", tuple(self.name_class(c, element) for c in n.elements()))
        return ("ns-name", self.inherited(n, "ns"), excepted) if n.local == "nsName" else ("any-name", excepted)

    # --- matching ---

    def _nullable(self, p: tuple) -> bool:
        kind = p[0]
        if kind in ("empty", "text"):
            return True
        if kind == "choice":
            return self.nullable(p[1]) or self.nullable(p[2])
        if kind in ("group", "interleave"):
            return self.nullable(p[1]) and self.nullable(p[2])
        if kind == "oneOrMore":
            return self.nullable(p[1])
        if kind == "ref":
            return self.nullable(self.defines[p[1]])
        return False

    def derive(self, p: tuple, leaf) -> tuple:
        """Derivative under a leaf function, which handles elements, attributes, text, data, values and lists."""
        kind = p[0]
        if kind == "choice":
            return choice(self.derive(p[1], leaf), self.derive(p[2], leaf))
        if kind == "interleave":
            return choice(interleave(self.derive(p[1], leaf), p[2]), interleave(p[1], self.derive(p[2], leaf)))
        if kind == "group":
            first = group(self.derive(p[1], leaf), p[2])
            both = leaf.__name__ == "attribute_leaf"
            return choice(first, group(p[1], self.derive(p[2], leaf))) if both else choice(first, self.derive(p[2], leaf)) if self.nullable(p[1]) else first
        if kind == "oneOrMore":
            return group(self.derive(p[1], leaf), choice(p, EMPTY))
        if kind == "ref":
            return self.derive(self.defines[p[1]], leaf)
        return leaf(p)

    def validate(self, document: Node) -> list[dict]:
        issues: list[dict] = []
        root = document.elements()[0] if document.kind == "document" else document
        after = self.derive(self.start, self.element_leaf(root, f"/{root.name}", issues))
        if not issues and not self.nullable(after):
            issues.append({"path": f"/{root.name}", "kind": "Other", "message": "the document does not match"})
        return issues if not self.nullable(after) else []

    def element_leaf(self, node: Node, path: str, issues: list):
        cache: dict[tuple, bool] = {}

        def element_leaf(p: tuple) -> tuple:
            if p[0] != "element" or not in_class(p[1], node.ns, node.local):
                return NOT_ALLOWED
            if p not in cache:
                cache[p] = self.content(node, p[2], path, issues)
            return EMPTY if cache[p] else NOT_ALLOWED

        return element_leaf

    def content(self, node: Node, p: tuple, path: str, issues: list) -> bool:
        for a in node.attributes:

            def attribute_leaf(q: tuple, a=a) -> tuple:
                return EMPTY if q[0] == "attribute" and in_class(q[1], a.ns, a.local) and self.text_fits(q[2], a.value) else NOT_ALLOWED

            p = self.derive(p, attribute_leaf)
            if p == NOT_ALLOWED:
                issues.append({"path": f"{path}/@{a.name}", "kind": "UnexpectedAttribute", "message": f"attribute {a.name} does not match"})
                return False
        p = self.close(p)
        if p == NOT_ALLOWED:
            issues.append({"path": path, "kind": "MissingRequiredAttribute", "message": "an attribute is missing"})
            return False
        kids = [c for c in node.children if c.kind in ("element", "text", "cdata")]
        if not any(c.kind == "element" for c in kids):
            value = node.string()
            fits = self.text_fits(p, value) or not value.strip() and self.nullable(p)
            if not fits:
                issues.append({"path": path, "kind": "TypeMismatch" if value.strip() else "MissingRequiredElement", "message": "the content does not match"})
            return fits
        seen: dict[str, int] = {}
        for c in kids:
            if c.kind == "element":
                seen[c.name] = seen.get(c.name, 0) + 1
                at = f"{path}/{c.name}[{seen[c.name]}]"
                before = len(issues)
                p = self.derive(p, self.element_leaf(c, at, issues))
                if p == NOT_ALLOWED:
                    if len(issues) == before:
                        issues.append({"path": at, "kind": "UnexpectedElement", "message": f"{c.name} is not expected here"})
                    return False
            elif c.value.strip():

                def text_leaf(q: tuple) -> tuple:
                    return TEXT if q == TEXT else NOT_ALLOWED

                p = self.derive(p, text_leaf)
                if p == NOT_ALLOWED:
                    issues.append({"path": path, "kind": "Other", "message": "text is not allowed here"})
                    return False
        if not self.nullable(p):
            issues.append({"path": path, "kind": "MissingRequiredElement", "message": "content is incomplete"})
            return False
        return True

    def close(self, p: tuple) -> tuple:
        """The pattern without attributes that are still asked for."""
        kind = p[0]
        if kind == "attribute":
            return NOT_ALLOWED
        if kind in ("choice", "group", "interleave"):
            return {"choice": choice, "group": group, "interleave": interleave}[kind](self.close(p[1]), self.close(p[2]))
        if kind == "oneOrMore":
            return one_or_more(self.close(p[1]))
        return self.close(self.defines[p[1]]) if kind == "ref" else p

    def text_fits(self, p: tuple, value: str) -> bool:
        kind = p[0]
        if kind == "text":
            return True
        if kind == "empty":
            return not value.strip()
        if kind == "choice":
            return self.text_fits(p[1], value) or self.text_fits(p[2], value)
        if kind == "ref":
            return self.text_fits(self.defines[p[1]], value)
        if kind == "value":
            return p[2] == value if p[1] == "string" else p[2].split() == value.split()
        if kind == "data":
            from canopy.validate.xsd import Simple

            facets = [(n, [v] if n == "pattern" else int(v) if n in ("length", "minLength", "maxLength", "totalDigits", "fractionDigits") else v) for n, v in p[2]]
            return Simple(p[1], facets).problem(value) is None and not self.text_fits(p[3], value)
        if kind == "list":
            q = p[1]
            for token in value.split():

                def token_leaf(x: tuple, token=token) -> tuple:
                    return EMPTY if x[0] in ("value", "data") and self.text_fits(x, token) else TEXT if x == TEXT else NOT_ALLOWED

                q = self.derive(q, token_leaf)
            return self.nullable(q)
        if kind in ("group", "interleave"):
            return self.text_fits(p[1], value) and self.nullable(p[2]) or self.text_fits(p[2], value) and self.nullable(p[1])
        return kind == "oneOrMore" and self.text_fits(p[1], value)


def choice(a: tuple, b: tuple) -> tuple:
    return b if a == NOT_ALLOWED or a == b else a if b == NOT_ALLOWED else ("choice", a, b)


def group(a: tuple, b: tuple) -> tuple:
    return NOT_ALLOWED if NOT_ALLOWED in (a, b) else b if a == EMPTY else a if b == EMPTY else ("group", a, b)


def interleave(a: tuple, b: tuple) -> tuple:
    return NOT_ALLOWED if NOT_ALLOWED in (a, b) else b if a == EMPTY else a if b == EMPTY else ("interleave", a, b)


def one_or_more(p: tuple) -> tuple:
    return p if p in (NOT_ALLOWED, EMPTY) else ("oneOrMore", p)


def in_class(c: tuple, ns: str, local: str) -> bool:
    if c[0] == "name":
        return c[1:] == (ns, local)
    if c[0] == "any-of":
        return any(in_class(x, ns, local) for x in c[1])
    excepted = c[2] if c[0] == "ns-name" else c[1]
    return (c[0] == "any-name" or c[1] == ns) and not any(in_class(x, ns, local) for x in excepted)
