"""XSLT: a stylesheet is compiled on the driver and applied to each document inside Arrow batches.

Stylesheets that only iterate, group, sort and merge have set-oriented counterparts in ``canopy.operators``; this interpreter covers recursion.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cmp_to_key
from typing import Any

from canopy.functions.library import compile_regex, text
from canopy.functions.numbering import format_sequence
from canopy.model import Node, number
from canopy.plans.rowlocal import Array, Context, Function, Map, Untyped, atomize, evaluate, in_document_order, map_key, name_test, numeric, tests_item, to_number, to_text, truth
from canopy.plans.xpath import XPathError, compile_xpath
from canopy.sinks.serialize import Output, serialize
from canopy.sources.xml import parse

XSL = "http://www.w3.org/1999/XSL/Transform"
MAX_DEPTH = 400


class XSLTError(ValueError):
    """A static error of a stylesheet, or a terminated transformation."""


@dataclass
class Template:
    """A template rule or named template."""

    node: Node
    steps: list[tuple] = field(default_factory=list)
    name: str = ""
    mode: str = ""
    priority: float = 0.5
    precedence: int = 0
    position: int = 0


@dataclass
class Stylesheet:
    """What a transformation needs."""

    templates: list[Template] = field(default_factory=list)
    named: dict[str, Template] = field(default_factory=dict)
    variables: list[Node] = field(default_factory=list)
    keys: dict[str, list[Node]] = field(default_factory=dict)
    functions: dict[tuple[str, int], Node] = field(default_factory=dict)
    attribute_sets: dict[str, list[Node]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    formats: dict[str, dict[str, str]] = field(default_factory=dict)
    maps: dict[str, dict[str, str]] = field(default_factory=dict)
    accumulators: dict[str, Node] = field(default_factory=dict)
    output: Output = field(default_factory=Output)
    strip: list[str] = field(default_factory=list)
    preserve: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    version: str = "1.0"
    expand_text: bool = False
    default_namespaces: dict[int, str] = field(default_factory=dict)
    ranked: dict[str, list[Template]] = field(default_factory=dict)

    def rules(self, mode: str) -> list[Template]:
        """The template rules of a mode, the first choice first."""
        found = self.ranked.get(mode)
        if found is None:
            found = [t for t in self.templates if t.mode in (mode, "#all")]
            found = self.ranked[mode] = sorted(found, key=lambda t: (-t.precedence, -t.priority, -t.position))
        return found


_compiled: dict[str, tuple] = {}


def expression(s: str) -> tuple:
    if s not in _compiled:
        if len(_compiled) > 10_000:
            _compiled.clear()
        _compiled[s] = compile_xpath(s)
    return _compiled[s]


def compile_stylesheet(source: str, loader: dict[str, str] | None = None, static: dict[str, list] | None = None) -> Stylesheet:
    """A stylesheet from text; ``loader`` maps the hrefs of includes and imports to their texts."""
    sheet = Stylesheet()
    counter = [0]
    _load(source, sheet, loader or {}, counter, 0, (), static or {})
    return sheet


def _load(source: str, sheet: Stylesheet, loader: dict[str, str], counter: list[int], precedence: int, above: tuple, static: dict) -> int:
    parsed = parse(source)
    if parsed.errors:
        raise XSLTError(f"stylesheet: {parsed.errors[0][1]}")
    root = parsed.document.elements()[0]
    _tidy(root)
    if root.ns != XSL:  # a literal result element as stylesheet
        wrapped = Template(root, _alternatives("/", root), precedence=precedence)
        sheet.templates.append(wrapped)
        return precedence
    if not above:
        sheet.version, sheet.expand_text = root.get("version") or "1.0", root.get("expand-text") == "yes"
    for node in root.elements():
        if node.ns == XSL and node.local in ("import", "include"):
            href = node.get("href") or ""
            if href in above:
                raise XSLTError(f"{href} includes itself")
            if href not in loader:
                raise XSLTError(f"no stylesheet {href}")
            if node.local == "import":
                precedence = _load(loader[href], sheet, loader, counter, precedence, (*above, href), static) + 1
            else:
                _load(loader[href], sheet, loader, counter, precedence, (*above, href), static)
    for node in root.elements():
        when = node.get("use-when") if node.ns == XSL else node.get("use-when", XSL)
        if when and not truth(evaluate(expression(when), Context(variables=static, compat=False))):
            continue
        if node.ns == XSL:
            _declare(node, sheet, counter, precedence)
    return precedence


def _tidy(root: Node) -> None:
    """Drops white-space-only text outside xsl:text, comments and instructions."""
    for n in [root, *root.descendants()]:
        if n.kind == "element" and not (n.ns == XSL and n.local == "text"):
            n.children = [c for c in n.children if c.kind in ("element", "cdata") or c.kind == "text" and c.value.strip(" \t\r\n")]


def _declare(node: Node, sheet: Stylesheet, counter: list[int], precedence: int) -> None:
    kind = node.local
    if kind == "template":
        counter[0] += 1
        base = {"node": node, "mode": node.get("mode") or "", "precedence": precedence, "position": counter[0], "name": node.get("name") or ""}
        if base["name"]:
            sheet.named[base["name"]] = Template(**base)
        for alternative in _alternatives(node.get("match"), node) if node.get("match") else []:
            said = node.get("priority")
            for mode in base["mode"].split() or [""]:
                sheet.templates.append(Template(**base | {"mode": mode if mode != "#default" else "", "steps": [alternative], "priority": float(said) if said else _priority(alternative)}))
    elif kind in ("variable", "param"):
        sheet.variables = [v for v in sheet.variables if v.get("name") != node.get("name")] + [node]
    elif kind == "key":
        sheet.keys.setdefault(node.get("name") or "", []).append(node)
    elif kind == "function":
        name = _expanded(node.get("name") or "", node)
        sheet.functions[name, len([p for p in node.elements() if p.ns == XSL and p.local == "param"])] = node
    elif kind == "attribute-set":
        sheet.attribute_sets.setdefault(node.get("name") or "", []).append(node)
    elif kind == "mode":
        sheet.modes[node.get("name") or ""] = node.get("on-no-match") or "text-only-copy"
    elif kind == "decimal-format":
        sheet.formats[node.get("name") or ""] = {a.local: a.value for a in node.attributes if a.local != "name"}
    elif kind == "character-map":
        made = {c.get("character") or "": c.get("string") or "" for c in node.elements()}
        for used in (node.get("use-character-maps") or "").split():
            made = sheet.maps.get(used, {}) | made
        sheet.maps[node.get("name") or ""] = made
    elif kind == "accumulator":
        sheet.accumulators[node.get("name") or ""] = node
    elif kind in ("strip-space", "preserve-space"):
        (sheet.strip if kind == "strip-space" else sheet.preserve).extend((node.get("elements") or "").split())
    elif kind == "namespace-alias":
        one = lambda p: node.ns_map.get("" if p == "#default" else p, "")
        sheet.aliases[one(node.get("stylesheet-prefix") or "")] = one(node.get("result-prefix") or "")
    elif kind == "output":
        out, get = sheet.output, node.get
        yes = lambda name, old: old if get(name) is None else get(name) in ("yes", "true", "1")
        sheet.output = replace(
            out, method=get("method") or out.method, declaration=not yes("omit-xml-declaration", not out.declaration) if get("omit-xml-declaration") else out.declaration, indent=yes("indent", out.indent), encoding=get("encoding") or out.encoding,
            doctype_public=get("doctype-public") or out.doctype_public, doctype_system=get("doctype-system") or out.doctype_system, cdata_elements=out.cdata_elements | frozenset((get("cdata-section-elements") or "").split()), standalone=get("standalone") or out.standalone,
        )
        for name in (get("use-character-maps") or "").split():
            sheet.output.character_map |= sheet.maps.get(name, {})
    elif kind in ("import-schema", "use-package", "package", "expose", "accept"):
        raise XSLTError(f"xsl:{kind} is not supported: packages and schema-aware processing are not built")
    elif kind not in ("import", "include", "global-context-item", "function-library"):
        raise XSLTError(f"xsl:{kind} is not supported at the top level")


def _expanded(name: str, node: Node) -> str:
    prefix, colon, local = name.rpartition(":")
    return f"{{{node.ns_map.get(prefix, '')}}}{local}" if colon else name


# --- patterns ---


def _alternatives(pattern: str, node: Node) -> list[tuple]:
    """Each alternative of a match pattern as a path tree."""
    tree = expression(pattern)
    found, stack = [], [tree]
    while stack:
        t = stack.pop()
        if t[0] == "binary" and t[1] == "union":
            stack += [t[3], t[2]]
        else:
            found.append(t)
    return found


def _priority(tree: tuple) -> float:
    if tree[0] == "path" and tree[1] == ("context",) and len(tree[2]) == 1 and tree[2][0][0] == "axis" and not tree[2][0][3]:
        test = tree[2][0][2]
        if test[0] == "kind":
            return 0.0 if test[2] else -0.5
        return -0.5 if test[1] is None and test[2] == "*" else -0.25 if test[2] == "*" or test[1] == "*" else 0.0
    return -0.5 if tree == ("root",) else 0.5


_upward: dict[int, tuple[tuple, list[tuple] | None]] = {}


def upward(tree: tuple) -> list[tuple] | None:
    """The steps of a pattern from its last to its first, if a node's ancestors and itself alone decide about it: child and attribute steps whose predicates ask for no position."""
    known = _upward.get(id(tree))
    if known is not None and known[0] is tree:
        return known[1]
    steps = None
    if tree[0] == "path" and tree[1] in (("context",), ("root",)) and tree[2]:
        fits = all(s[0] == "axis" and s[1] in ("child", "attribute") and s[2] != ("kind", "document-node", None) and all(tests_item(p) for p in s[3]) for s in tree[2])
        steps = tree[2][::-1] if fits else None
    if len(_upward) > 10_000:
        _upward.clear()
    _upward[id(tree)] = tree, steps
    return steps


def matches(node: Node, tree: tuple, ctx: Context) -> bool:
    """Whether a node is selected by the pattern from some ancestor-or-self."""
    if tree == ("root",):
        return node.kind == "document"
    if tree[0] == "path" and tree[1] == ("context",) and len(tree[2]) == 1:
        step = tree[2][0]
        if step[0] == "axis" and not step[3]:  # the common case needs no evaluation
            if node.kind == "attribute" and step[1] != "attribute" or node.kind == "document" and step[2] != ("kind", "document-node", None):
                return False
            return name_test(step[2], step[1], ctx)(node)
    steps = upward(tree)
    if steps is not None:
        at: Node | None = node
        for _, axis, test, predicates in steps:
            if at.parent is None or at.kind == "namespace" or (at.kind == "attribute") != (axis == "attribute") or not name_test(test, axis, ctx)(at):
                return False
            if predicates:
                inner = ctx.focus(at)
                for p in predicates:
                    if not truth(evaluate(p, inner)):
                        return False
            at = at.parent
        return tree[1] == ("context",) or at.parent is None
    start: Node | None = node.parent if tree[0] == "path" and tree[1] == ("context",) else node.root()
    while start is not None:
        if any(x is node for x in evaluate(tree, ctx.focus(start))):
            return True
        start = start.parent if tree[0] == "path" and tree[1] == ("context",) else None
    return False


# --- the run ---


class _Break(Exception):
    pass


class _Next(Exception):
    pass


class Terminated(XSLTError):
    """xsl:message terminate="yes"."""


class Transformation:
    """One stylesheet on one document."""

    def __init__(self, sheet: Stylesheet, document: Node, params: dict[str, Any] | None = None, documents: dict[str, Node] | None = None, texts: dict[str, str] | None = None):
        self.sheet, self.document, self.params = sheet, document, params or {}
        self.messages: list[str] = []
        self.results: dict[str, Node] = {}
        self.depth = 0
        self.keys_built: dict[tuple[str, int], dict[str, list[Node]]] = {}
        for i, d in enumerate((documents or {}).values(), 1):
            number(d, i)
        self.strip(document)
        number(document)
        functions: dict[tuple[str, int], Callable] = {("key", 2): self.key, ("key", 3): self.key, ("accumulator-before", 1): self.accumulated, ("accumulator-after", 1): self.accumulated}
        for name in ("current-group", "current-grouping-key", "current-merge-group", "current-merge-key", "regex-group"):
            functions[name, -1] = self.current_value(name)
        for (name, arity), node in sheet.functions.items():
            functions[name, arity] = self.user_function(node)
        self.extra = {"formats": sheet.formats, "texts": texts or {}, "instructions": frozenset(f"xsl:{n}" for n in INSTRUCTIONS)}
        self.context = Context(item=document, functions=functions, documents=documents or {}, compat=sheet.version.startswith("1"), extra=self.extra)
        self.globals()

    def strip(self, document: Node) -> None:
        if not self.sheet.strip:
            return
        for n in [document, *document.descendants()]:
            if n.kind == "element" and (n.name in self.sheet.strip or "*" in self.sheet.strip and n.name not in self.sheet.preserve):
                n.children = [c for c in n.children if c.kind != "text" or c.value.strip(" \t\r\n")]

    def globals(self) -> None:
        values: dict[str, Any] = {}

        def lazy(node: Node, name: str):
            state: list = []

            def get():
                if not state:
                    state.append(None)
                    state[0] = self.binding(node, self.context.focus(self.document))
                if state[0] is None:
                    raise XPathError("XTDE0640", f"variable {name} depends on itself")
                return state[0]

            return get

        for node in self.sheet.variables:
            name = node.get("name") or ""
            if node.local == "param" and name in self.params:
                given = self.params[name]
                values[name] = given if isinstance(given, list) else [given]
            elif node.local == "param" and node.get("required") == "yes":
                raise XSLTError(f"parameter {name} is required")
            else:
                values[name] = lazy(node, name)
        self.context.variables.update(values)

    def scope(self, node: Node, ctx: Context) -> Context:
        inner = ctx.twin()
        inner.namespaces = node.ns_map
        inner.default_namespace = self.default_ns(node)
        return inner

    def default_ns(self, node: Node) -> str:
        """The default namespace of paths in a node of the stylesheet, whose nodes live as long as it."""
        known = self.sheet.default_namespaces.get(id(node))
        if known is None:
            known = self.sheet.default_namespaces[id(node)] = self.said_default_ns(node)
        return known

    def said_default_ns(self, node: Node) -> str:
        at: Node | None = node
        while at is not None and at.kind == "element":
            said = at.get("xpath-default-namespace") if at.ns == XSL else at.get("xpath-default-namespace", XSL)
            if said is not None:
                return said
            at = at.parent
        return ""

    def value(self, node: Node, attribute: str, ctx: Context) -> list:
        inner = self.scope(node, ctx)
        inner.extra = {**ctx.extra, "current": [ctx.item] if ctx.item is not None else []}
        return evaluate(expression(node.get(attribute) or ""), inner)

    def template_text(self, s: str, node: Node, ctx: Context) -> str:
        """An attribute value template."""
        if "{" not in s and "}" not in s:
            return s
        out, i = "", 0
        while i < len(s):
            if s[i : i + 2] in ("{{", "}}"):
                out, i = out + s[i], i + 2
            elif s[i] == "{":
                depth, j, quote = 1, i + 1, ""
                while j < len(s) and depth:
                    c = s[j]
                    if quote:
                        quote = "" if c == quote else quote
                    elif c in "'\"":
                        quote = c
                    else:
                        depth += (c == "{") - (c == "}")
                    j += 1
                extra = dict(ctx.extra) | {"current": [ctx.item]}
                value = evaluate(expression(s[i + 1 : j - 1]), self.scope(node, ctx).changed(extra=extra))
                out += to_text(value[0]) if ctx.compat and value else " ".join(to_text(x) for x in atomize(value))
                i = j
            else:
                out, i = out + s[i], i + 1
        return out

    def avt(self, node: Node, attribute: str, ctx: Context, default: str = "") -> str:
        said = node.get(attribute)
        return default if said is None else self.template_text(said, node, ctx)

    # --- output ---

    def body(self, nodes: list[Node], ctx: Context) -> list:
        """Items that a sequence constructor gives."""
        out: list = []
        at = 0
        while at < len(nodes):
            node = nodes[at]
            if node.kind != "element":
                said = self.template_text(node.value, node.parent, ctx) if self.sheet.expand_text and node.kind == "text" else node.value
                out.append(Node("text", value=said))
            elif node.ns == XSL and node.local in ("variable", "param"):
                name = node.get("name") or ""
                if node.local == "variable" or name not in ctx.variables or "#param" not in ctx.extra:
                    ctx = ctx.bind(name, self.binding(node, ctx))
            elif node.ns == XSL and node.local == "on-empty":
                if not any(self.populated(x) for x in out):
                    return self.sequence(node, ctx)
            elif node.ns == XSL and node.local == "on-non-empty":
                rest = self.body([n for n in nodes[at + 1 :] if not (n.ns == XSL and n.local in ("on-empty", "on-non-empty"))], ctx)
                if any(self.populated(x) for x in out + rest):
                    out += self.sequence(node, ctx)
            elif node.ns == XSL:
                out += self.instruction(node, ctx)
            else:
                out.append(self.literal(node, ctx))
            at += 1
        return out

    def populated(self, x: Any) -> bool:
        if isinstance(x, Node):
            return bool(x.children) if x.kind in ("element", "document") else bool(x.value)
        return to_text(x) != ""

    def sequence(self, node: Node, ctx: Context) -> list:
        return self.value(node, "select", ctx) if node.get("select") is not None else self.body(node.children, ctx)

    def binding(self, node: Node, ctx: Context) -> list:
        """Value of a variable, parameter or with-param."""
        if node.get("select") is not None:
            return self.value(node, "select", ctx)
        if not node.children:
            return [""] if not node.get("as") else []
        made = self.body(node.children, ctx)
        if node.get("as"):
            return made
        document = Node("document")
        self.fill(document, made)
        return [number(document, 1_000_000 + id(document) % 1_000_000)]

    def fill(self, parent: Node, items: list) -> Node:
        """Content of a node from items: attributes first, adjacent atomic values with spaces between."""
        atomic_before = False
        for x in items:
            if isinstance(x, Array):
                x = " ".join(to_text(y) for y in atomize([x]))
            if isinstance(x, Node):
                atomic_before = False
                if x.kind == "document":
                    for c in x.children:
                        self.attach(parent, copy(c))
                elif x.kind == "attribute":
                    if parent.kind == "element" and not parent.children:
                        parent.set(x.local, x.value, x.ns, x.prefix)
                elif x.kind == "namespace":
                    parent.ns_map = parent.ns_map | {x.local: x.value}
                else:
                    self.attach(parent, x if x.parent is None else copy(x))
            elif isinstance(x, (Map, Function)):
                raise XPathError("XTDE0450", "maps and functions can't be content")
            else:
                self.attach(parent, Node("text", value=(" " if atomic_before else "") + to_text(x)))
                atomic_before = True
        return parent

    def attach(self, parent: Node, child: Node) -> None:
        last = parent.children[-1] if parent.children else None
        if child.kind == "text" and child.prefix != "raw":
            if not child.value:
                return
            if last is not None and last.kind == "text" and last.prefix != "raw":
                last.value += child.value
                return
        if child.kind == "element" and parent.kind == "element":
            child.ns_map = {k: v for k, v in parent.ns_map.items() if k} | ({"": ""} if "" in parent.ns_map and not child.ns_map.get("") else {}) | child.ns_map
        parent.append(child)

    def string_of(self, items: list, separator: str = "") -> str:
        document = self.fill(Node("document"), items) if not separator else None
        return document.string() if document is not None else separator.join(to_text(x) for x in atomize(items))

    def literal(self, node: Node, ctx: Context) -> Node:
        alias = self.sheet.aliases
        made = Node("element", node.local, alias.get(node.ns, node.ns), node.prefix)
        excluded = set()
        at: Node | None = node
        while at is not None and at.kind == "element":
            said = (at.get("exclude-result-prefixes") if at.ns == XSL else at.get("exclude-result-prefixes", XSL)) or ""
            excluded |= set(at.ns_map) if said == "#all" else {"" if p == "#default" else p for p in said.split()}
            at = at.parent
        used = {node.prefix} | {a.prefix for a in node.attributes if a.prefix}
        made.ns_map = {p: alias.get(u, u) for p, u in node.ns_map.items() if u != XSL and (p in used and (p or made.ns) or p not in excluded)}
        for name in (node.get("use-attribute-sets", XSL) or "").split():
            self.fill(made, self.attribute_set(name, ctx))
        for a in node.attributes:
            if a.ns != XSL:
                made.set(a.local, self.template_text(a.value, node, ctx), alias.get(a.ns, a.ns), a.prefix)
        return self.fill(made, self.body(node.children, ctx))

    def attribute_set(self, name: str, ctx: Context) -> list:
        out: list = []
        for node in self.sheet.attribute_sets.get(name, []):
            for inner in (node.get("use-attribute-sets") or "").split():
                out += self.attribute_set(inner, ctx)
            out += self.body(node.children, ctx)
        return out

    # --- templates ---

    def rules(self, node: Node, mode: str, ctx: Context) -> list[Template]:
        return [t for t in self.sheet.rules(mode) if matches(node, t.steps[0], self.scope(t.node, ctx))]

    def apply(self, items: list, mode: str, ctx: Context, params: dict[str, list], tunnel: dict[str, list]) -> list:
        out: list = []
        for i, item in enumerate(items, 1):
            inner = ctx.focus(item, i, len(items))
            rules = self.rules(item, mode, inner) if isinstance(item, Node) else []
            out += self.call(rules[0], rules[1:], mode, inner, params, tunnel) if rules else self.built_in(item, mode, inner, params, tunnel)
        return out

    def call(self, rule: Template, others: list[Template], mode: str, ctx: Context, params: dict[str, list], tunnel: dict[str, list]) -> list:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise XPathError("LIMIT", "templates are nested too deeply")
        try:
            inner = ctx.twin()
            inner.variables = dict(self.context.variables)
            inner.extra = {**ctx.extra, "others": others, "mode": mode, "params": params, "tunnel": tunnel, "rule": rule}
            content = rule.node.children
            while content and content[0].kind == "element" and content[0].ns == XSL and content[0].local in ("param", "context-item"):
                p, content = content[0], content[1:]
                name = p.get("name") or ""
                if p.local == "param":
                    source = tunnel if p.get("tunnel") == "yes" else params
                    if name not in source and p.get("required") == "yes":
                        raise XPathError("XTDE0700", f"parameter {name} is required")
                    inner = inner.bind(name, source[name] if name in source else self.binding(p, inner))
            return self.body(content, inner)
        finally:
            self.depth -= 1

    def built_in(self, item: Any, mode: str, ctx: Context, params: dict, tunnel: dict) -> list:
        action = self.sheet.modes.get(mode, "text-only-copy")
        if not isinstance(item, Node):
            return [item]
        if action == "fail":
            raise XPathError("XTDE0555", f"no rule for {item.name or item.kind}")
        if action == "deep-copy":
            return [copy(item)]
        if action == "deep-skip":
            return self.apply(item.children, mode, ctx, params, tunnel) if item.kind == "document" else []
        if action == "shallow-copy":
            if item.kind == "element":
                made = Node("element", item.local, item.ns, item.prefix)
                made.ns_map = item.ns_map
                return [self.fill(made, self.apply([*item.attributes, *item.children], mode, ctx, params, tunnel))]
            return self.apply(item.children, mode, ctx, params, tunnel) if item.kind == "document" else [copy(item)]
        if item.kind in ("element", "document"):
            return self.apply(([*item.attributes] if action == "shallow-skip" else []) + item.children, mode, ctx, params, tunnel)
        return [Node("text", value=item.value)] if item.kind in ("text", "cdata", "attribute") and action == "text-only-copy" else []

    def with_params(self, node: Node, ctx: Context) -> tuple[dict[str, list], dict[str, list]]:
        params: dict[str, list] = {}
        tunnel = dict(ctx.extra.get("tunnel", {}))
        for p in node.elements():
            if p.ns == XSL and p.local == "with-param":
                (tunnel if p.get("tunnel") == "yes" else params)[p.get("name") or ""] = self.binding(p, ctx)
        return params, tunnel

    def instruction(self, node: Node, ctx: Context) -> list:
        run = INSTRUCTIONS.get(node.local)
        if run is None:
            fallback = [c for c in node.elements() if c.ns == XSL and c.local == "fallback"]
            if fallback:
                return [x for f in fallback for x in self.body(f.children, ctx)]
            raise XPathError("XTDE1450", f"xsl:{node.local} is not supported")
        return run(self, node, ctx)

    # --- keys, accumulators, functions ---

    def key(self, ctx: Context, name: list, value: list, top: list | None = None) -> list:
        root = (top[0] if top else ctx.item).root()
        cached = self.keys_built.get((text(name), id(root)))
        if cached is None:
            cached = {}
            for node in self.sheet.keys.get(text(name), []):
                scoped = self.scope(node, self.context)
                for n in [root, *(x for e in [root, *root.descendants()] for x in ([e] if e is not root else []) + e.attributes)]:
                    if any(matches(n, t, scoped) for t in _alternatives(node.get("match") or "", node)):
                        used = self.value(node, "use", self.context.focus(n)) if node.get("use") else self.body(node.children, self.context.focus(n))
                        for v in {_key_text(x) for x in atomize(used)}:
                            cached.setdefault(v, []).append(n)
            self.keys_built[text(name), id(root)] = cached
        return in_document_order([n for v in {_key_text(x) for x in atomize(value)} for n in cached.get(v, [])])

    def current_value(self, name: str):
        def get(ctx: Context, *args):
            if name == "regex-group":
                groups, at = ctx.extra.get("regex-group", ()), int(to_number(atomize(args[0])[0]))
                return [groups[at] or "" if at < len(groups) else ""]
            return ctx.extra.get(name, [])

        return get

    def user_function(self, node: Node):
        names = [p.get("name") or "" for p in node.elements() if p.ns == XSL and p.local == "param"]
        content = [c for c in node.children if not (c.ns == XSL and c.local == "param")]

        def call(ctx: Context, *args):
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise XPathError("LIMIT", "functions are nested too deeply")
            try:
                made = self.body(content, ctx.changed(item=None, variables=dict(self.context.variables) | dict(zip(names, args))))
            finally:
                self.depth -= 1
            kind = (node.get("as") or "").rstrip("?*+")
            if kind.startswith("xs:"):
                from canopy.functions.library import cast

                return [y for x in atomize(made) for y in cast([x], kind[3:])]
            return made

        return call

    def accumulated(self, ctx: Context, name: list) -> list:
        node = self.sheet.accumulators[text(name)]
        rules = [c for c in node.elements() if c.local == "accumulator-rule"]
        state = self.value(node, "initial-value", self.context.focus(ctx.item.root()))
        target, after = ctx.item, False
        before: list = state

        def visit(n: Node, phase: str, value: list) -> list:
            for r in rules[::-1]:
                if (r.get("phase") or "start") == phase and any(matches(n, t, self.scope(r, self.context)) for t in _alternatives(r.get("match") or "", r)):
                    return self.value(r, "select", self.context.focus(n).changed(variables=dict(self.context.variables) | {"value": value})) if r.get("select") else self.body(r.children, self.context.focus(n).bind("value", value))
            return value

        stack: list = [(target.root(), "start")]
        while stack:
            n, phase = stack.pop()
            state = visit(n, phase, state)
            if phase == "start":
                if n is target:
                    before = state
                stack.append((n, "end"))
                stack += [(c, "start") for c in n.children[::-1]]
            elif n is target:
                after = True
                break
        return state if after and ctx.extra.get("accumulator-after") else before

    # --- entry ---

    def run(self, initial_template: str = "", mode: str = "") -> Node:
        result = Node("document")
        if initial_template:
            made = self.call(self.sheet.named[initial_template], [], mode, self.context, {}, {})
        else:
            made = self.apply([self.document], mode, self.context, {}, {})
        return number(self.fill(result, made))


def copy(node: Node) -> Node:
    made = Node(node.kind, node.local, node.ns, node.prefix, node.value)
    made.ns_map = node.ns_map
    for a in node.attributes:
        made.set(a.local, a.value, a.ns, a.prefix)
    for c in node.children:
        made.append(copy(c))
    return made


def _key_text(x: Any) -> str:
    return to_text(float(x)) if numeric(x) else to_text(x)


# --- instructions ---


def _sorted(t: Transformation, items: list, node: Node, ctx: Context) -> list:
    keys = [c for c in node.elements() if c.ns == XSL and c.local == "sort"]
    if not keys:
        return items
    rows = []
    for i, item in enumerate(items, 1):
        inner = ctx.focus(item, i, len(items)) if not isinstance(item, Group) else item.context(ctx)
        values = []
        for k in keys:
            found = atomize(t.value(k, "select", inner) if k.get("select") else t.body(k.children, inner) or ([item] if not isinstance(item, Group) else []))
            values.append(found[0] if found else None)
        rows.append((values, i, item))
    rules = [(t.avt(k, "order", ctx, "ascending") == "descending", t.avt(k, "data-type", ctx), "html-ascii" in t.avt(k, "collation", ctx)) for k in keys]

    def order(a, b):
        for x, y, (down, kind, fold) in zip(a[0], b[0], rules):
            if kind == "number" or not kind and numeric(x) and numeric(y):
                p, q = (math.nan if v is None else to_number(v) for v in (x, y))
                if math.isnan(p) or math.isnan(q):
                    if math.isnan(p) != math.isnan(q):
                        return -1 if math.isnan(p) else 1
                    continue
            elif x is not None and y is not None and not isinstance(x, str) and type(x) is type(y) and not isinstance(x, bool):
                p, q = x, y
            else:
                p, q = ("" if v is None else to_text(v) for v in (x, y))
                if fold:
                    p, q = (re.sub("[A-Z]", lambda m: m[0].lower(), v) for v in (p, q))
            if p != q:
                return (-1 if p < q else 1) * (-1 if down else 1)
        return a[1] - b[1]

    return [r[2] for r in sorted(rows, key=cmp_to_key(order))]


@dataclass
class Group:
    """Members and key of a group."""

    members: list
    key: list
    names: tuple[str, str] = ("current-group", "current-grouping-key")

    def context(self, ctx: Context, position: int = 1, size: int = 1) -> Context:
        inner = ctx.focus(self.members[0] if self.members else None, position, size)
        return inner.changed(extra=dict(ctx.extra) | {self.names[0]: self.members, self.names[1]: self.key})


def _content(node: Node, *skip: str) -> list[Node]:
    return [c for c in node.children if not (c.kind == "element" and c.ns == XSL and c.local in skip)]


def _apply_templates(t, node, ctx):
    items = t.value(node, "select", ctx) if node.get("select") is not None else ctx.item.children
    mode = node.get("mode") or ""
    mode = ctx.extra.get("mode", "") if mode == "#current" else "" if mode == "#default" else mode
    return t.apply(_sorted(t, items, node, ctx), mode, ctx, *t.with_params(node, ctx))


def _next_match(t, node, ctx):
    others = ctx.extra.get("others", [])
    if node.local == "apply-imports":
        others = [o for o in others if o.precedence < ctx.extra["rule"].precedence]
    params, tunnel = t.with_params(node, ctx)
    params = ctx.extra.get("params", {}) | params
    mode = ctx.extra.get("mode", "")
    return t.call(others[0], others[1:], mode, ctx, params, tunnel) if others else t.built_in(ctx.item, mode, ctx, params, tunnel)


def _call_template(t, node, ctx):
    rule = t.sheet.named.get(node.get("name") or "")
    if rule is None:
        raise XPathError("XTSE0650", f"no template {node.get('name')}")
    params, tunnel = t.with_params(node, ctx)
    return t.call(rule, ctx.extra.get("others", []), ctx.extra.get("mode", ""), ctx, params, tunnel)


def _choose(t, node, ctx):
    for c in node.elements():
        if c.local == "otherwise" or truth(t.value(c, "test", ctx)):
            return t.body(c.children, ctx)
    return []


def _for_each(t, node, ctx):
    items = _sorted(t, t.value(node, "select", ctx), node, ctx)
    content = _content(node, "sort")
    return [y for i, x in enumerate(items, 1) for y in t.body(content, ctx.focus(x, i, len(items)))]


def _for_each_group(t, node, ctx):
    items = t.value(node, "select", ctx)
    groups: list[Group] = []
    size = len(items)
    if node.get("group-by") is not None:
        found: dict[str, Group] = {}
        for i, x in enumerate(items, 1):
            for k in {_key_text(v): v for v in atomize(t.value(node, "group-by", ctx.focus(x, i, size)))}.items():
                found.setdefault(k[0], Group([], [k[1]])).members.append(x)
        groups = list(found.values())
    elif node.get("group-adjacent") is not None:
        for i, x in enumerate(items, 1):
            k = atomize(t.value(node, "group-adjacent", ctx.focus(x, i, size)))
            if len(k) != 1:
                raise XPathError("XTTE1100", "group-adjacent needs one key")
            if groups and _key_text(groups[-1].key[0]) == _key_text(k[0]):
                groups[-1].members.append(x)
            else:
                groups.append(Group([x], k))
    else:
        starting = node.get("group-starting-with")
        patterns = _alternatives(starting or node.get("group-ending-with") or "", node)
        ended = True
        for x in items:
            hit = isinstance(x, Node) and any(matches(x, p, t.scope(node, ctx)) for p in patterns)
            if starting and (hit or not groups) or not starting and ended:
                groups.append(Group([x], []))
            else:
                groups[-1].members.append(x)
            ended = hit
    groups = _sorted(t, groups, node, ctx)
    content = _content(node, "sort")
    return [y for i, g in enumerate(groups, 1) for y in t.body(content, g.context(ctx, i, len(groups)))]


def _merge(t, node, ctx):
    rows: list[tuple[list, Any]] = []
    for source in node.elements():
        if source.local == "merge-source":
            keys = [c for c in source.elements() if c.local == "merge-key"]
            for x in t.value(source, "select", ctx):
                rows.append(([(atomize(t.value(k, "select", ctx.focus(x))) or [""])[0] for k in keys], x))
    down = [k.get("order") == "descending" for s in node.elements() if s.local == "merge-source" for k in s.elements() if k.local == "merge-key"]
    found: dict[tuple, Group] = {}
    for key, x in rows:
        found.setdefault(tuple(_key_text(k) for k in key), Group([], key, ("current-merge-group", "current-merge-key"))).members.append(x)

    def order(a: Group, b: Group) -> int:
        for i, (x, y) in enumerate(zip(a.key, b.key)):
            if x != y:
                return (-1 if x < y else 1) * (-1 if i < len(down) and down[i] else 1)
        return 0

    groups = sorted(found.values(), key=cmp_to_key(order))
    action = next(c for c in node.elements() if c.local == "merge-action")
    return [y for i, g in enumerate(groups, 1) for y in t.body(action.children, g.context(ctx, i, len(groups)))]


def _iterate(t, node, ctx):
    items = t.value(node, "select", ctx)
    params = [c for c in node.elements() if c.ns == XSL and c.local == "param"]
    done = next((c for c in node.elements() if c.ns == XSL and c.local == "on-completion"), None)
    state = {p.get("name") or "": t.binding(p, ctx) for p in params}
    content, out = _content(node, "param", "on-completion"), []
    for i, x in enumerate(items, 1):
        control: dict = {}
        inner = ctx.focus(x, i, len(items)).changed(variables=ctx.variables | state, extra=dict(ctx.extra) | {"iterate": control})
        out += t.body(content, inner)
        state |= control.get("next", {})
        if "break" in control:
            return out + control["break"]
    return out + (t.sequence(done, ctx.changed(variables=ctx.variables | state)) if done is not None else [])


def _next_iteration(t, node, ctx):
    ctx.extra["iterate"]["next"] = t.with_params(node, ctx)[0]
    return []


def _break(t, node, ctx):
    ctx.extra["iterate"]["break"] = t.sequence(node, ctx) if node.get("select") or node.children else []
    return []


def _value_of(t, node, ctx):
    if node.get("select") is None:
        return [Node("text", value=t.string_of(t.body(node.children, ctx), t.avt(node, "separator", ctx)))]
    items = t.value(node, "select", ctx)
    if ctx.compat and node.get("separator") is None:
        items = items[:1]
    said = t.avt(node, "separator", ctx, " ").join(to_text(x) for x in atomize(items))
    return [Node("text", prefix="raw" if node.get("disable-output-escaping") == "yes" else "", value=said)]


def _copy(t, node, ctx):
    items = t.value(node, "select", ctx) if node.get("select") is not None else [ctx.item]
    out = []
    for x in items:
        if not isinstance(x, Node):
            out.append(x)
        elif x.kind == "element":
            made = Node("element", x.local, x.ns, x.prefix)
            made.ns_map = x.ns_map
            for name in (node.get("use-attribute-sets") or "").split():
                t.fill(made, t.attribute_set(name, ctx))
            out.append(t.fill(made, t.body(node.children, ctx.focus(x))))
        elif x.kind == "document":
            out += t.body(node.children, ctx.focus(x))
        else:
            out.append(copy(x))
    return out


def _element(t, node, ctx):
    name = t.avt(node, "name", ctx)
    prefix, _, local = name.rpartition(":")
    if not re.fullmatch(r"[^\W\d][\w.\-]*", local):
        raise XPathError("XTDE0820", f"{name!r} is no element name")
    ns = t.avt(node, "namespace", ctx) if node.get("namespace") is not None else node.ns_map.get(prefix, "")
    made = Node("element", local, ns, prefix)
    made.ns_map = {"xml": made.ns_map["xml"]} | ({prefix: ns} if ns or prefix else {})
    for used in (node.get("use-attribute-sets") or "").split():
        t.fill(made, t.attribute_set(used, ctx))
    return [t.fill(made, t.body(node.children, ctx))]


def _attribute(t, node, ctx):
    name = t.avt(node, "name", ctx)
    prefix, _, local = name.rpartition(":")
    ns = t.avt(node, "namespace", ctx) if node.get("namespace") is not None else node.ns_map.get(prefix, "") if prefix else ""
    items = t.sequence(node, ctx)
    separator = t.avt(node, "separator", ctx, " " if node.get("select") is not None else "")
    value = separator.join(to_text(x) for x in atomize(items)) if node.get("select") is not None else t.string_of(items)
    return [Node("attribute", local, ns, prefix, value)]


def _number(t, node, ctx):
    picture = t.avt(node, "format", ctx, "1")
    options = {"separator": t.avt(node, "grouping-separator", ctx), "size": int(t.avt(node, "grouping-size", ctx, "0") or 0), "ordinal": t.avt(node, "ordinal", ctx) not in ("", "no")}
    start = int(t.avt(node, "start-at", ctx, "1"))
    if node.get("value") is not None:
        numbers = [int(math.floor(to_number(x) + 0.5)) + start - 1 for x in atomize(t.value(node, "value", ctx))]
        return [Node("text", value=format_sequence(numbers, picture, **options))]
    target = t.value(node, "select", ctx)[0] if node.get("select") else ctx.item
    scoped = t.scope(node, ctx)
    fits = lambda n, a: any(matches(n, p, scoped) for p in _alternatives(node.get(a), node))
    counted = (lambda n: fits(n, "count")) if node.get("count") else (lambda n: (n.kind, n.local, n.ns) == (target.kind, target.local, target.ns))
    level = node.get("level") or "single"
    chain, at = [], target
    while at is not None:
        chain.append(at)
        at = at.parent
    if level == "any":
        total = 0
        for n in [target.root(), *target.root().descendants()]:
            if node.get("from") and fits(n, "from"):
                total = 0
            total += counted(n)
            if n is target:
                break
        numbers = [total] if total else []
    else:
        if node.get("from"):
            stop = next((i for i, n in enumerate(chain) if i and fits(n, "from")), None)
            chain = chain[:stop] if stop is not None else chain
        found = [n for n in chain if counted(n)]
        found = found[:1] if level == "single" else found
        numbers = [1 + sum(counted(s) for s in n.parent.children[: next(i for i, s in enumerate(n.parent.children) if s is n)]) for n in found[::-1] if n.parent is not None]
    return [Node("text", value=format_sequence([n + start - 1 for n in numbers], picture, **options))] if numbers else []


def _message(t, node, ctx):
    said = t.string_of(t.sequence(node, ctx) if node.get("select") is not None else t.body(node.children, ctx))
    t.messages.append(said)
    if t.avt(node, "terminate", ctx) in ("yes", "true", "1"):
        raise Terminated(said)
    return []


def _map(t, node, ctx):
    made = Map()
    for x in t.body(node.children, ctx):
        if isinstance(x, Map):
            if made.keys() & x.keys():
                raise XPathError("XTDE3365", "duplicate key")
            made.update(x)
    return [made]


def _analyze_string(t, node, ctx):
    value = text(t.value(node, "select", ctx))
    pattern = compile_regex(t.avt(node, "regex", ctx), t.avt(node, "flags", ctx))
    if pattern.search("") is not None and ctx.compat:
        raise XPathError("XTDE1150", "the pattern matches an empty string")
    parts, at = [], 0
    for m in pattern.finditer(value):
        if m.start() > at:
            parts.append((False, value[at : m.start()], ()))
        parts.append((True, m[0], (m[0], *m.groups())))
        at = m.end()
    if at < len(value):
        parts.append((False, value[at:], ()))
    bodies = {c.local: c for c in node.elements()}
    out = []
    for i, (hit, said, groups) in enumerate(parts, 1):
        chosen = bodies.get("matching-substring" if hit else "non-matching-substring")
        if chosen is not None:
            inner = ctx.focus(said, i, len(parts)).changed(extra=dict(ctx.extra) | {"regex-group": groups})
            out += t.body(chosen.children, inner)
    return out


def _try(t, node, ctx):
    handlers = [c for c in node.elements() if c.ns == XSL and c.local == "catch"]
    try:
        return t.value(node, "select", ctx) if node.get("select") is not None else t.body(_content(node, "catch"), ctx)
    except (XPathError, Terminated) as e:
        code = getattr(e, "code", "XTMM9000")
        for h in handlers:
            if any(c == "*" or c.rpartition(":")[2] in ("*", code) for c in (h.get("errors") or "*").split()):
                return t.sequence(h, ctx.bind("err:code", [code]).bind("err:description", [getattr(e, "message", str(e))]))
        raise


def _result_document(t, node, ctx):
    made = number(t.fill(Node("document"), t.body(node.children, ctx)))
    href = t.avt(node, "href", ctx)
    if not href:
        return [made]
    if href in t.results:
        raise XPathError("XTDE1490", f"{href} is written twice")
    t.results[href] = made
    return []


def _evaluate(t, node, ctx):
    source = text(t.value(node, "xpath", ctx))
    item = t.value(node, "context-item", ctx)[0] if node.get("context-item") else None
    return evaluate(expression(source), t.scope(node, ctx).changed(item=item, variables=t.with_params(node, ctx)[0]))


def _source_document(t, node, ctx):
    href = t.avt(node, "href", ctx)
    if href not in ctx.documents:
        raise XPathError("FODC0002", f"no document {href}")
    return t.body(node.children, ctx.focus(ctx.documents[href]))


def _where_populated(t, node, ctx):
    return [x for x in t.body(node.children, ctx) if t.populated(x)]


INSTRUCTIONS: dict[str, Callable] = {
    "apply-templates": _apply_templates, "apply-imports": _next_match, "next-match": _next_match, "call-template": _call_template, "choose": _choose, "if": lambda t, n, c: t.body(n.children, c) if truth(t.value(n, "test", c)) else [],
    "for-each": _for_each, "for-each-group": _for_each_group, "merge": _merge, "iterate": _iterate, "next-iteration": _next_iteration, "break": _break, "value-of": _value_of, "copy": _copy,
    "copy-of": lambda t, n, c: [copy(x) if isinstance(x, Node) else x for x in t.value(n, "select", c)], "sequence": lambda t, n, c: t.sequence(n, c), "element": _element, "attribute": _attribute,
    "text": lambda t, n, c: [Node("text", prefix="raw" if n.get("disable-output-escaping") == "yes" else "", value=t.template_text(n.string(), n, c) if t.sheet.expand_text else n.string())],
    "comment": lambda t, n, c: [Node("comment", value=re.sub("-(?=-|$)", "- ", t.string_of(t.sequence(n, c))))], "processing-instruction": lambda t, n, c: [Node("processing-instruction", t.avt(n, "name", c), value=t.string_of(t.sequence(n, c)).lstrip())],
    "namespace": lambda t, n, c: [Node("namespace", t.avt(n, "name", c), value=t.string_of(t.sequence(n, c)))], "document": lambda t, n, c: [number(t.fill(Node("document"), t.body(n.children, c)))], "number": _number, "message": _message,
    "map": _map, "map-entry": lambda t, n, c: [Map({map_key(atomize(t.value(n, "key", c))[0]): t.sequence(n, c)})], "analyze-string": _analyze_string, "perform-sort": lambda t, n, c: _sorted(t, t.value(n, "select", c) if n.get("select") else t.body(_content(n, "sort"), c), n, c),
    "try": _try, "result-document": _result_document, "evaluate": _evaluate, "source-document": _source_document, "fork": lambda t, n, c: t.body(n.children, c), "where-populated": _where_populated, "fallback": lambda t, n, c: [],
}


def transform(source: str, sheet: Stylesheet | str, params: dict[str, Any] | None = None, documents: dict[str, str] | None = None, texts: dict[str, str] | None = None, initial_template: str = "", mode: str = "") -> tuple[str, dict[str, str], list[str]]:
    """(output, secondary outputs by href, messages) of a stylesheet on a document's text."""
    sheet = compile_stylesheet(sheet) if isinstance(sheet, str) else sheet
    parsed = parse(source)
    if parsed.errors:
        raise XSLTError(f"source: {parsed.errors[0][1]}")
    given = {k: Untyped(v) if isinstance(v, str) else v for k, v in (params or {}).items()}
    run = Transformation(sheet, parsed.document, given, {k: parse(v).document for k, v in (documents or {}).items()}, texts)
    run.extra["unparsed"] = parsed.dtd["unparsed"]
    result = run.run(initial_template, mode)
    out = sheet.output
    root = next((c for c in result.children if c.kind == "element"), None)
    if out.method == "xml" and root is not None and root.local.lower() == "html" and not root.ns:
        out = replace(out, method="html", declaration=False)
    return serialize(result, out), {k: serialize(v, sheet.output) for k, v in run.results.items()}, run.messages
