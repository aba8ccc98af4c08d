"""Schematron: phases, abstract patterns and rules, variables, assertions and reports with messages."""

from __future__ import annotations

import re

from canopy.model import Node
from canopy.plans.rowlocal import Context, atomize, evaluate, in_document_order, to_text, truth
from canopy.plans.xslt import expression, matches
from canopy.sinks.serialize import escape_attribute, escape_text
from canopy.sources.xml import parse


class Schematron:
    """A compiled schema."""

    def __init__(self, source: str, loader: dict[str, str] | None = None):
        parsed = parse(source)
        if parsed.errors:
            raise ValueError(parsed.errors[0][1])
        self.root = parsed.document.elements()[0]
        for n in [x for x in self.root.descendants() if x.local == "include"]:
            included = parse((loader or {})[n.get("href") or ""]).document.elements()[0]
            n.parent.children[n.parent.children.index(n)] = included
            included.parent = n.parent
        self.namespaces = {n.get("prefix") or "": n.get("uri") or "" for n in self.root.elements() if n.local == "ns"}
        self.abstract = {n.get("id"): n for n in self.root.descendants() if n.get("abstract") == "true"}

    def patterns(self, phase: str | None) -> list[Node]:
        found = [n for n in self.root.elements() if n.local == "pattern" and n.get("abstract") != "true"]
        phase = phase or self.root.get("defaultPhase") or "#ALL"
        if phase != "#ALL":
            active = {a.get("pattern") for n in self.root.elements() if n.local == "phase" and n.get("id") == phase for a in n.elements() if a.local == "active"}
            found = [n for n in found if n.get("id") in active]
        return found

    def rules(self, pattern: Node) -> list[tuple[Node, dict[str, str]]]:
        if not pattern.get("is-a"):
            return [(r, {}) for r in pattern.elements() if r.local == "rule" and r.get("abstract") != "true"]
        params = {p.get("name") or "": p.get("value") or "" for p in pattern.elements() if p.local == "param"}
        return [(r, params) for r in self.abstract[pattern.get("is-a")].elements() if r.local == "rule"]

    def checks(self, rule: Node) -> list[Node]:
        out = []
        for c in rule.elements():
            out += self.checks(self.abstract[c.get("rule")]) if c.local == "extends" else [c]
        return out

    def run(self, document: Node, phase: str | None = None) -> list[dict]:
        """Findings (pattern, role, path, test, kind, message): failed assertions and successful reports. Of the rules of a pattern the first that fits a node counts."""
        base = Context(item=document, namespaces=self.namespaces, compat=False)
        base = self.lets(self.root, base, {})
        nodes = [document, *(x for e in document.descendants() for x in [e, *e.attributes])]
        out: list[dict] = []
        for pattern in self.patterns(phase):
            inner = self.lets(pattern, base, {})
            done: set[int] = set()
            for rule, params in self.rules(pattern):
                tree = expression(_filled(rule.get("context") or "", params))
                options = [tree]
                while any(o[0] == "binary" and o[1] == "union" for o in options):
                    options = [x for o in options for x in (o[2:] if o[0] == "binary" and o[1] == "union" else [o])]
                for node in in_document_order([n for n in nodes if id(n) not in done and any(matches(n, t, inner) for t in options)]):
                    done.add(id(node))
                    self.apply(pattern, rule, params, inner.focus(node), node, out)
        return out

    def lets(self, holder: Node, ctx: Context, params: dict[str, str]) -> Context:
        for n in holder.elements():
            if n.local == "let":
                ctx = ctx.bind(n.get("name") or "", evaluate(expression(_filled(n.get("value") or n.string(), params)), ctx))
        return ctx

    def apply(self, pattern: Node, rule: Node, params: dict[str, str], ctx: Context, node: Node, out: list[dict]) -> None:
        for c in self.checks(rule):
            if c.local == "let":
                ctx = ctx.bind(c.get("name") or "", evaluate(expression(_filled(c.get("value") or "", params)), ctx))
            elif c.local in ("assert", "report"):
                test = _filled(c.get("test") or "", params)
                if truth(evaluate(expression(test), ctx)) == (c.local == "report"):
                    said = "".join(self.said(x, ctx, node) for x in c.children)
                    out.append({"pattern": pattern.get("id") or "", "role": c.get("role") or rule.get("role") or "", "path": path_of(node), "test": test, "kind": c.local, "message": " ".join(said.split())})

    def said(self, n: Node, ctx: Context, node: Node) -> str:
        if n.kind != "element":
            return n.value
        if n.local == "value-of":
            return " ".join(to_text(x) for x in atomize(evaluate(expression(n.get("select") or "."), ctx)))
        if n.local == "name":
            found = evaluate(expression(n.get("path")), ctx) if n.get("path") else [node]
            return found[0].name if found and isinstance(found[0], Node) else to_text(found[0]) if found else ""
        return n.string()

    def svrl(self, document: Node, phase: str | None = None) -> str:
        """The findings as an SVRL report."""
        parts = ['<svrl:schematron-output xmlns:svrl="http://purl.oclc.org/dsdl/svrl">']
        for f in self.run(document, phase):
            tag = "failed-assert" if f["kind"] == "assert" else "successful-report"
            parts.append(f'<svrl:{tag} location="{escape_attribute(f["path"])}" test="{escape_attribute(f["test"])}"><svrl:text>{escape_text(f["message"])}</svrl:text></svrl:{tag}>')
        return "".join(parts) + "</svrl:schematron-output>"


def _filled(s: str, params: dict[str, str]) -> str:
    for name in sorted(params, key=len, reverse=True):
        s = re.sub(rf"\${re.escape(name)}\b", lambda m, n=name: params[n], s)
    return s


def path_of(node: Node) -> str:
    """Path with ordinals of a node."""
    parts: list[str] = []
    at: Node | None = node
    while at is not None and at.kind != "document":
        if at.kind == "attribute":
            parts.append(f"@{at.name}")
        else:
            same = [s for s in at.parent.children if s.kind == at.kind and s.name == at.name] if at.parent is not None else [at]
            parts.append(f"{at.name or at.kind + '()'}[{next(i for i, s in enumerate(same, 1) if s is at)}]")
        at = at.parent
    return "/" + "/".join(parts[::-1])
