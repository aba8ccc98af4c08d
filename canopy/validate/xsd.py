"""XSD: schemas compiled on the driver, documents validated row by row with paths and kinds of issues.

Covered: simple types with facets, lists and unions; complex types with sequence, choice, all, groups, wildcards, extension and restriction of
content, simple content, attributes and attribute groups; global references, substitution groups, xsi:type, nillable; key, unique, keyref; assertions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from canopy.functions.library import cast, compile_regex
from canopy.model import Node
from canopy.plans.rowlocal import Context, Untyped, evaluate, truth
from canopy.plans.xpath import XPathError, compile_xpath
from canopy.sources.xml import parse

XS = "http://www.w3.org/2001/XMLSchema"
XSI = "http://www.w3.org/2001/XMLSchema-instance"


class SchemaError(ValueError):
    """A schema that can't be compiled."""


@dataclass
class Simple:
    """A simple type: its primitive, facets, and list or union members."""

    base: str = "string"
    facets: list[tuple[str, object]] = field(default_factory=list)
    item: Simple | None = None
    members: list[Simple] = field(default_factory=list)
    space: str = "collapse"

    def problem(self, value: str) -> str | None:
        """What is wrong with a lexical value, or None."""
        if self.space != "preserve" and self.base not in ("string",):
            value = re.sub(r"[ \t\r\n]", " ", value)
            value = value if self.base == "normalizedString" else " ".join(value.split())
        elif self.space == "collapse" and self.base != "string":
            value = " ".join(value.split())
        if self.members:
            if all(m.problem(value) for m in self.members):
                return f"TypeMismatch: {value!r} fits no member type"
        elif self.item is not None:
            for v in value.split():
                if wrong := self.item.problem(v):
                    return wrong
        elif self.base not in ("anySimpleType", "string"):
            if wrong := _lexical(value, self.base):
                return wrong
        for kind, limit in self.facets:
            if not self.facet(kind, limit, value):
                return f"FacetViolation: {value!r} violates {kind}"
        return None

    def facet(self, kind: str, limit, value: str) -> bool:
        size = len(value.split()) if self.item is not None else len(value) // 2 if self.base == "hexBinary" else len(value)
        if kind in ("length", "minLength", "maxLength"):
            return {"length": size == limit, "minLength": size >= limit, "maxLength": size <= limit}[kind]
        if kind == "pattern":
            return any(compile_regex(p, "", True).match(value) for p in limit)
        if kind == "enumeration":
            return value in limit
        if kind in ("totalDigits", "fractionDigits"):
            whole, _, fraction = value.lstrip("+-").partition(".")
            fraction = fraction.rstrip("0")
            return len(fraction) <= limit if kind == "fractionDigits" else len(whole.lstrip("0")) + len(fraction) <= limit
        if kind == "explicitTimezone":
            zoned = bool(re.search(r"(Z|[+-]\d\d:\d\d)$", value))
            return zoned == (limit == "required") or limit == "optional"
        a, b = _value(value, self.base), _value(limit, self.base)
        return {"minInclusive": lambda: a >= b, "maxInclusive": lambda: a <= b, "minExclusive": lambda: a > b, "maxExclusive": lambda: a < b}.get(kind, lambda: True)()


def _lexical(value: str, base: str) -> str | None:
    if base in ("NMTOKEN", "Name", "NCName", "ID", "IDREF", "ENTITY", "language"):
        pattern = {"NMTOKEN": r"\c+", "Name": r"\i\c*", "language": r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*"}.get(base, r"[\i-[:]][\c-[:]]*")
        return None if compile_regex(pattern, "", True).match(value) else f"TypeMismatch: {value!r} is no xs:{base}"
    if base in ("QName", "NOTATION"):
        parts = value.split(":")
        return None if len(parts) < 3 and not any(_lexical(p, "NCName") for p in parts) else f"TypeMismatch: {value!r} is no xs:{base}"
    if base == "anyURI" and (" " in value or re.search(r"%(?![0-9A-Fa-f]{2})", value) or re.search(r"[<>{}|\\^`\"]", value)):
        return f"TypeMismatch: {value!r} is no xs:{base}"
    if base in ("time", "dateTime", "dateTimeStamp") and (at := re.search(r"(\d\d):(\d\d):(\d\d)(\.\d+)?(Z|[+-]\d\d:\d\d)?$", value)):
        midnight = at[1] == "24" and at[2] == at[3] == "00" and not (at[4] or "").strip(".0")
        if not midnight and (int(at[1]) > 23 or int(at[2]) > 59 or int(at[3]) > 59):
            return f"TypeMismatch: {value!r} is no xs:{base}"
    if base in ("dayTimeDuration", "yearMonthDuration"):
        parts = r"-?P(?=.)(\d+Y)?(\d+M)?" if base == "yearMonthDuration" else r"-?P(?=.)(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?"
        return None if re.fullmatch(parts, value) else f"TypeMismatch: {value!r} is no xs:{base}"
    if base == "error":
        return "TypeMismatch: no value is valid"
    if base == "dateTimeStamp" and not re.search(r"(Z|[+-]\d\d:\d\d)$", value):
        return f"TypeMismatch: {value!r} has no time zone"
    if base in ("gYear", "gMonth", "gDay", "gYearMonth", "gMonthDay"):
        zone = r"(Z|[+-]\d\d:\d\d)?"
        if base == "gMonthDay" and (at := re.match(r"--(\d\d)-(\d\d)", value)) and int(at[2]) > {2: 29, 4: 30, 6: 30, 9: 30, 11: 30}.get(int(at[1]), 31):
            return f"TypeMismatch: {value!r} is no xs:{base}"
        pattern = {"gYear": r"-?\d{4,}", "gMonth": r"--(0[1-9]|1[0-2])", "gDay": r"---(0[1-9]|[12]\d|3[01])", "gYearMonth": r"-?\d{4,}-(0[1-9]|1[0-2])", "gMonthDay": r"--(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"}[base]
        return None if re.fullmatch(pattern + zone, value) else f"TypeMismatch: {value!r} is no xs:{base}"
    try:
        cast([value], base)
        return None
    except XPathError:
        return f"TypeMismatch: {value!r} is no xs:{base}"


def _value(value, base: str):
    try:
        return cast([value], base)[0] if base in ("date", "time", "dateTime", "duration") else Decimal(str(value)) if str(value) not in ("INF", "-INF", "NaN") else float(str(value).replace("INF", "inf"))
    except (XPathError, InvalidOperation):
        return str(value)


@dataclass
class Particle:
    """element, any, sequence, choice or all with its occurrence."""

    kind: str
    low: int = 1
    high: int | None = 1
    children: list[Particle] = field(default_factory=list)
    element: Element | None = None
    namespaces: str = "##any"
    process: str = "strict"
    target: str = ""


@dataclass
class Complex:
    """A complex type."""

    particle: Particle | None = None
    simple: Simple | None = None
    mixed: bool = False
    attributes: dict[tuple[str, str], tuple[Simple, bool, str | None]] = field(default_factory=dict)
    any_attribute: bool = False
    asserts: list[str] = field(default_factory=list)
    abstract: bool = False
    base: str = ""
    anything: bool = False


@dataclass
class Element:
    """An element declaration; its type is resolved when first needed."""

    name: str
    ns: str
    node: Node | None = None
    nillable: bool = False
    abstract: bool = False
    fixed: str | None = None
    type: Simple | Complex | None = None
    constraints: list[tuple[str, str, str, str, list[str]]] = field(default_factory=list)


class Schema:
    """A compiled schema."""

    def __init__(self, source: str, loader: dict[str, str] | None = None):
        self.loader = loader or {}
        self.nodes: dict[tuple[str, str], tuple[Node, str, bool]] = {}
        self.elements: dict[str, Element] = {}
        self.substitutes: dict[str, list[str]] = {}
        self.made: dict[int, object] = {}
        self.loaded: set[str] = set()
        self.load(source, None)

    def load(self, source: str, target: str | None) -> None:
        parsed = parse(source)
        if parsed.errors or not parsed.document.elements() or parsed.document.elements()[0].ns != XS:
            raise SchemaError(parsed.errors[0][1] if parsed.errors else "no schema")
        root = parsed.document.elements()[0]
        target = root.get("targetNamespace") or target or ""
        qualified = root.get("elementFormDefault") == "qualified"
        for n in root.elements():
            if n.local in ("include", "import", "redefine", "override"):
                href = n.get("schemaLocation") or ""
                if href in self.loader and href not in self.loaded:
                    self.loaded.add(href)
                    self.load(self.loader[href], target if n.local != "import" else None)
            elif n.get("name"):
                self.nodes[n.local, f"{{{target}}}{n.get('name')}"] = (n, target, qualified)
        for (kind, name), (n, t, q) in list(self.nodes.items()):
            if kind == "element" and name not in self.elements:
                self.elements[name] = self.element(n, t, q, True)
                if head := n.get("substitutionGroup"):
                    self.substitutes.setdefault(self.qname(head, n), []).append(name)

    def qname(self, s: str, node: Node) -> str:
        prefix, _, local = s.rpartition(":")
        return f"{{{node.ns_map.get(prefix, '')}}}{local}"

    def find(self, kind: str, name: str) -> tuple[Node, str, bool]:
        if (kind, name) not in self.nodes:
            raise SchemaError(f"no {kind} {name}")
        return self.nodes[kind, name]

    def element(self, node: Node, target: str, qualified: bool, top: bool = False) -> Element:
        form = node.get("form")
        ns = target if top or form == "qualified" or qualified and form != "unqualified" else ""
        made = Element(node.get("name") or "", ns, node, node.get("nillable") == "true", node.get("abstract") == "true", node.get("fixed"))
        for c in node.elements():
            if c.local in ("key", "unique", "keyref"):
                selector = next(x.get("xpath") or "" for x in c.elements() if x.local == "selector")
                fields = [x.get("xpath") or "" for x in c.elements() if x.local == "field"]
                made.constraints.append((c.local, c.get("name") or "", (c.get("refer") or "").rpartition(":")[2], selector, fields))
        self.made[id(made)] = (target, qualified)
        return made

    def type_of(self, element: Element) -> Simple | Complex:
        if element.type is None:
            node = element.node
            target, qualified = self.made[id(element)]
            if said := node.get("type"):
                element.type = self.named(self.qname(said, node))
            else:
                inner = next((c for c in node.elements() if c.local in ("simpleType", "complexType")), None)
                if inner is None and node.get("substitutionGroup"):
                    element.type = self.type_of(self.elements[self.qname(node.get("substitutionGroup"), node)])
                else:
                    element.type = Complex(mixed=True, any_attribute=True, anything=True) if inner is None else self.simple(inner) if inner.local == "simpleType" else self.complex(inner, target, qualified)
        return element.type

    def named(self, name: str) -> Simple | Complex:
        if name.startswith(f"{{{XS}}}"):
            local = name.partition("}")[2]
            if local == "anyType":
                return Complex(mixed=True, any_attribute=True, anything=True)
            plural = {"NMTOKENS": "NMTOKEN", "IDREFS": "IDREF", "ENTITIES": "ENTITY"}
            return Simple(item=Simple(plural[local]), facets=[("minLength", 1)]) if local in plural else Simple("anySimpleType" if local in ("anySimpleType", "anyAtomicType") else local)
        if ("simpleType", name) in self.nodes:
            return self.simple(self.find("simpleType", name)[0])
        node, target, qualified = self.find("complexType", name)
        if id(node) not in self.made:
            made = Complex()
            self.made[id(node)] = made
            made.__dict__.update(self.complex(node, target, qualified).__dict__)
            made.base = made.base or name
        return self.made[id(node)]

    def simple(self, node: Node) -> Simple:
        inner = node.elements()
        inner = [c for c in inner if c.local in ("restriction", "list", "union")]
        if not inner:
            raise SchemaError("empty simpleType")
        how = inner[0]
        nested = [self.simple(c) for c in how.elements() if c.local == "simpleType"]
        if how.local == "list":
            item = self.named(self.qname(how.get("itemType"), how)) if how.get("itemType") else nested[0]
            return Simple("string", item=item)
        if how.local == "union":
            return Simple("string", members=[self.named(self.qname(m, how)) for m in (how.get("memberTypes") or "").split()] + nested)
        base = self.named(self.qname(how.get("base"), how)) if how.get("base") else nested[0]
        base = base.simple if isinstance(base, Complex) else base
        return self.restricted(base or Simple(), how)

    def restricted(self, base: Simple, how: Node) -> Simple:
        facets: list[tuple[str, object]] = list(base.facets)
        patterns, values, space = [], [], base.space
        for c in how.elements():
            said = c.get("value") or ""
            if c.local == "pattern":
                patterns.append(said)
            elif c.local == "enumeration":
                values.append(said)
            elif c.local == "whiteSpace":
                space = said
            elif c.local in ("length", "minLength", "maxLength", "totalDigits", "fractionDigits"):
                facets.append((c.local, int(said)))
            elif c.local in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "explicitTimezone"):
                facets.append((c.local, said))
        facets += [("pattern", patterns)] * bool(patterns) + [("enumeration", values)] * bool(values)
        return Simple(base.base, facets, base.item, base.members, space)

    def complex(self, node: Node, target: str, qualified: bool) -> Complex:
        made = Complex(mixed=node.get("mixed") == "true", abstract=node.get("abstract") == "true")
        content = next((c for c in node.elements() if c.local in ("simpleContent", "complexContent")), None)
        holder = node
        if content is not None:
            holder = content.elements()[0]
            base = self.named(self.qname(holder.get("base") or "xs:anyType", holder))
            made.mixed = made.mixed or content.get("mixed") == "true"
            if isinstance(base, Complex):
                made.attributes, made.any_attribute, made.asserts = dict(base.attributes), base.any_attribute, list(base.asserts)
                made.base = base.base
                if holder.local == "extension" and not base.anything:
                    made.mixed = made.mixed or base.mixed
            if content.local == "simpleContent":
                inner = base.simple if isinstance(base, Complex) else base
                made.simple = self.restricted(inner or Simple(), holder) if holder.local == "restriction" else inner
        own = next((self.particle(c, target, qualified) for c in holder.elements() if c.local in ("sequence", "choice", "all", "group")), None)
        if content is not None and content.local == "complexContent" and holder.local == "extension" and isinstance(base, Complex) and base.particle is not None:
            own = Particle("sequence", children=[base.particle] + ([own] if own else []))
        made.particle = own
        self.attributes(holder, made, target)
        made.asserts += [c.get("test") or "" for c in holder.elements() if c.local == "assert"]
        return made

    def attributes(self, holder: Node, made: Complex, target: str) -> None:
        for c in holder.elements():
            if c.local == "anyAttribute":
                made.any_attribute = True
            elif c.local == "attributeGroup":
                group, t, _ = self.find("attributeGroup", self.qname(c.get("ref"), c))
                self.attributes(group, made, t)
            elif c.local == "attribute":
                node, ns = c, target if c.get("form") == "qualified" else ""
                if c.get("ref"):
                    name = self.qname(c.get("ref"), c)
                    if name.startswith("{http://www.w3.org/XML/1998/namespace}"):
                        made.attributes[name.partition("}")[2], "http://www.w3.org/XML/1998/namespace"] = (Simple(), c.get("use") == "required", None)
                        continue
                    node, ns, _ = self.find("attribute", name)
                key = (node.get("name") or "", ns)
                if c.get("use") == "prohibited":
                    made.attributes.pop(key, None)
                    continue
                inner = next((x for x in node.elements() if x.local == "simpleType"), None)
                kind = self.simple(inner) if inner is not None else self.named(self.qname(node.get("type"), node)) if node.get("type") else Simple("anySimpleType")
                made.attributes[key] = (kind, c.get("use") == "required", c.get("fixed"))

    def particle(self, node: Node, target: str, qualified: bool) -> Particle:
        low = int(node.get("minOccurs") or 1)
        high = None if node.get("maxOccurs") == "unbounded" else int(node.get("maxOccurs") or 1)
        if node.local == "element":
            return Particle("element", low, high, element=self.reference(node) if node.get("ref") else self.element(node, target, qualified))
        if node.local == "any":
            return Particle("any", low, high, namespaces=node.get("namespace") or "##any", process=node.get("processContents") or "strict", target=target)
        if node.local == "group":
            group, t, q = self.find("group", self.qname(node.get("ref"), node)) if node.get("ref") else (node, target, qualified)
            inner = next(c for c in group.elements() if c.local in ("sequence", "choice", "all"))
            return Particle("sequence", low, high, [self.particle(inner, t, q)])
        return Particle(node.local, low, high, [self.particle(c, target, qualified) for c in node.elements() if c.local in ("element", "any", "sequence", "choice", "group", "all")])

    def reference(self, node: Node) -> Element:
        name = self.qname(node.get("ref"), node)
        if name not in self.elements:
            n, t, q = self.find("element", name)
            self.elements[name] = self.element(n, t, q, True)
        return self.elements[name]

    def accepts(self, p: Particle, node: Node) -> Element | bool:
        """The declaration under which a leaf particle takes an element; True for a wildcard, False if it doesn't."""
        if p.kind == "any":
            ok = p.namespaces == "##any" or p.namespaces == "##other" and node.ns not in ("", p.target) or any(node.ns == {"##targetNamespace": p.target, "##local": ""}.get(n, n) for n in p.namespaces.split() if n != "##other")
            return (self.elements.get(f"{{{node.ns}}}{node.local}") or True) if ok and p.process != "skip" else ok
        e = p.element
        if (node.local, node.ns) == (e.name, e.ns) and not e.abstract:
            return e
        stack, seen = list(self.substitutes.get(f"{{{e.ns}}}{e.name}", [])), set()
        while stack:
            name = stack.pop()
            if name in seen:
                continue
            seen.add(name)
            s = self.elements[name]
            if (node.local, node.ns) == (s.name, s.ns) and not s.abstract:
                return s
            stack += self.substitutes.get(name, [])
        return False

    def match(self, p: Particle, nodes: list[Node], starts: frozenset[int], taken: dict[int, Element | bool]) -> frozenset[int]:
        """All places at which the particle can end, from any of the starts."""
        ends: set[int] = set(starts) if p.low == 0 else set()
        now, count, seen = starts, 0, set()
        while now and (p.high is None or count < p.high):
            now = self.once(p, nodes, now, taken)
            count += 1
            if count >= p.low:
                if p.high is None and now <= seen:
                    break
                seen |= now
                ends |= now
            elif not now:
                break
            elif count > len(nodes) + 1:  # only empty matches are left
                ends |= now
                break
        return frozenset(ends)

    def once(self, p: Particle, nodes: list[Node], starts: frozenset[int], taken: dict) -> frozenset[int]:
        if p.kind in ("element", "any"):
            out = set()
            for i in starts:
                if i < len(nodes) and (hit := self.accepts(p, nodes[i])):
                    taken[i] = hit
                    out.add(i + 1)
            return frozenset(out)
        if p.kind == "sequence":
            for c in p.children:
                starts = self.match(c, nodes, starts, taken)
            return starts
        if p.kind == "choice":
            return frozenset(x for c in p.children for x in self.match(c, nodes, starts, taken))
        out = set()
        for i in starts:  # all
            counts, j = [0] * len(p.children), i
            while j < len(nodes):
                k = next((k for k, c in enumerate(p.children) if (c.high is None or counts[k] < c.high) and self.accepts(c, nodes[j])), None)
                if k is None:
                    break
                taken[j] = self.accepts(p.children[k], nodes[j])
                counts[k] += 1
                j += 1
            if all(n >= c.low for n, c in zip(counts, p.children)):
                out.add(j)
        return frozenset(out)

    def furthest(self, p: Particle, nodes: list[Node]) -> int:
        taken: dict = {}
        self.match(p, nodes, frozenset([0]), taken)
        return max(taken, default=-1) + 1

    def validate(self, document: Node, fail_fast: bool = False) -> list[dict]:
        """Issues of a document as (path, kind, message)."""
        issues: list[dict] = []
        roots = document.elements() if document.kind == "document" else [document]
        root = roots[0] if roots else None
        declared = self.elements.get(f"{{{root.ns}}}{root.local}") if root is not None else None
        if declared is None:
            return [{"path": f"/{root.name if root is not None else ''}", "kind": "UnexpectedElement", "message": "the root element is not declared"}]
        ids: dict = {}
        self.check(root, declared, f"/{root.name}", issues, ids)
        return issues[:1] if fail_fast else issues

    def check(self, node: Node, declared: Element, path: str, issues: list, ids: dict) -> None:
        def report(kind: str, message: str) -> None:
            issues.append({"path": path, "kind": kind, "message": message})

        kind = self.type_of(declared)
        if said := node.get("type", XSI):
            try:
                kind = self.named(self.qname(said, node))
            except SchemaError:
                report("TypeMismatch", f"xsi:type {said} is unknown")
        if isinstance(kind, Complex) and kind.abstract:
            report("TypeMismatch", "the type is abstract")
        nil = (node.get("nil", XSI) or "").strip() in ("true", "1")
        if nil and not declared.nillable:
            report("NillableViolation", "xsi:nil is not allowed")
        if nil and (node.elements() or node.string()):
            report("NillableViolation", "a nilled element must be empty")
        if isinstance(kind, Simple):
            for a in node.attributes:
                if a.ns != XSI:
                    report("UnexpectedAttribute", f"attribute {a.name} is not allowed")
            if node.elements():
                report("UnexpectedElement", f"{node.elements()[0].name} is not allowed in a simple type")
            elif not nil:
                self.value(kind, node.string(), report)
        else:
            self.check_complex(node, kind, nil, path, report, issues, ids)
        if declared.fixed is not None and not nil and node.string() != declared.fixed:
            report("FacetViolation", f"the value must be {declared.fixed}")
        self.identity(node, declared, path, report)

    def value(self, kind: Simple, text: str, report) -> None:
        if wrong := kind.problem(text):
            name, _, message = wrong.partition(": ")
            report(name, message)

    def check_complex(self, node: Node, kind: Complex, nil: bool, path: str, report, issues: list, ids: dict) -> None:
        for a in node.attributes:
            found = kind.attributes.get((a.local, a.ns))
            if found is not None:
                self.value(found[0], a.value, report)
                if found[2] is not None and a.value != found[2]:
                    report("FacetViolation", f"attribute {a.name} must be {found[2]}")
            elif a.ns != XSI and not kind.any_attribute:
                report("UnexpectedAttribute", f"attribute {a.name} is not allowed")
        for (name, ns), (_, required, _) in kind.attributes.items():
            if required and node.get(name, ns) is None:
                report("MissingRequiredAttribute", f"attribute {name} is required")
        kids = node.elements()
        if kind.simple is not None:
            if kids:
                report("UnexpectedElement", f"{kids[0].name} is not allowed in simple content")
            elif not nil:
                self.value(kind.simple, node.string(), report)
        elif not nil:
            if not kind.mixed and any(c.kind in ("text", "cdata") and c.value.strip(" \t\r\n") for c in node.children):
                report("Other", "text is not allowed here")
            taken: dict[int, Element | bool] = {}
            if kind.anything:
                taken = {i: self.elements.get(f"{{{k.ns}}}{k.local}") or True for i, k in enumerate(kids)}
            else:
                p = kind.particle or Particle("sequence")
                if len(kids) not in self.match(p, kids, frozenset([0]), taken):
                    at = self.furthest(p, kids)
                    report(*(("UnexpectedElement", f"{kids[at].name} is not expected here") if at < len(kids) else ("MissingRequiredElement", "content is incomplete")))
            seen: dict[str, int] = {}
            for i, k in enumerate(kids):
                seen[k.name] = seen.get(k.name, 0) + 1
                if isinstance(taken.get(i), Element):
                    self.check(k, taken[i], f"{path}/{k.name}[{seen[k.name]}]", issues, ids)
        for test in kind.asserts:
            try:
                holds = truth(evaluate(compile_xpath(test), Context(item=node, namespaces=node.ns_map, compat=False, variables={"value": [Untyped(node.string())]})))
            except XPathError:
                holds = False
            if not holds:
                report("AssertionViolation", test)

    def identity(self, node: Node, declared: Element, path: str, report) -> None:
        tables: dict[str, set] = {}
        for kind, name, refer, selector, fields in sorted(declared.constraints, key=lambda c: c[0] == "keyref"):
            scope = Context(namespaces=declared.node.ns_map, compat=False)
            rows: set = set()
            for target in evaluate(compile_xpath(selector), scope.focus(node)):
                values = []
                for f in fields:
                    found = evaluate(compile_xpath(f), scope.focus(target))
                    values.append(" ".join(found[0].string().split()) if found else None)
                if None in values:
                    if kind == "key":
                        report("KeyNotUnique", f"key {name} lacks a field")
                    continue
                row = tuple(values)
                if kind == "keyref":
                    if row not in tables.get(refer, set()):
                        report("KeyRefDangling", f"keyref {name}: {row}")
                elif row in rows:
                    report("KeyNotUnique", f"{kind} {name}: {row}")
                rows.add(row)
            tables[name] = rows


def struct_type(schema: Schema, element: str):
    """A Spark StructType for ``from_xml``, from a global element."""
    from pyspark.sql import types as T

    simple = {"integer": T.DecimalType(38, 0), "int": T.IntegerType(), "long": T.LongType(), "short": T.ShortType(), "byte": T.ByteType(), "decimal": T.DecimalType(38, 18), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "date": T.DateType(), "dateTime": T.TimestampType()}

    def of(kind, depth: int):
        if isinstance(kind, Simple):
            return T.ArrayType(of(kind.item, depth)) if kind.item else simple.get(kind.base, T.StringType())
        fields = [T.StructField(f"_{n}", of(k, depth)) for (n, _), (k, _, _) in kind.attributes.items()]
        stack = [(kind.particle, False)] if kind.particle else []
        while stack:
            p, many = stack.pop(0)
            many = many or p.high is None or p.high > 1
            if p.kind == "element" and depth < 16:
                inner = of(schema.type_of(p.element), depth + 1)
                fields.append(T.StructField(p.element.name, T.ArrayType(inner) if many else inner))
            stack[:0] = [(c, many) for c in p.children]
        if kind.simple is not None:
            fields.append(T.StructField("_VALUE", of(kind.simple, depth)))
        return T.StructType(fields) if fields else T.StringType()

    return of(schema.type_of(next(e for n, e in schema.elements.items() if e.name == element)), 0)
