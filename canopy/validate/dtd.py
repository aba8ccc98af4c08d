"""DTD validation: content models, attributes, IDs and IDREFs; defaults."""

from __future__ import annotations

import re

from canopy.model import Node
from canopy.sources.xml import Parsed

# expat's model types and quantifiers.
EMPTY, ANY, MIXED, NAME, CHOICE, SEQ = 1, 2, 3, 4, 5, 6
QUANTIFIERS = {0: "", 1: "?", 2: "*", 3: "+"}


def content_regex(model: tuple) -> str:
    """A content model as a regular expression over names that each end in a space."""
    kind, quantifier, name, children = model
    if kind == NAME:
        body = re.escape(name) + " "
    else:
        body = ("|" if kind in (CHOICE, MIXED) else "").join(content_regex(c) for c in children)
    return f"(?:{body}){QUANTIFIERS[quantifier]}"


def validate(parsed: Parsed) -> list[dict]:
    """All violations of a document's own DTD as (path, kind, message)."""
    dtd, found, ids, refs = parsed.dtd, [], {}, []

    def report(path: str, kind: str, message: str) -> None:
        found.append({"path": path, "kind": kind, "message": message})

    def visit(node: Node, path: str) -> None:
        model = dtd["elements"].get(node.name)
        if model is None:
            report(path, "UnexpectedElement", f"element {node.name} is not declared")
        else:
            names = "".join(f"{c.name} " for c in node.elements())
            text = any(c.kind in ("text", "cdata") and c.value.strip() for c in node.children)
            if model[0] == EMPTY and node.children:
                report(path, "UnexpectedElement", f"{node.name} must be empty")
            elif model[0] == MIXED:
                allowed = {c[2] for c in model[3]}
                for c in node.elements():
                    if c.name not in allowed:
                        report(path, "UnexpectedElement", f"{c.name} is not allowed in {node.name}")
            elif model[0] not in (EMPTY, ANY):
                if text:
                    report(path, "Other", f"text is not allowed in {node.name}")
                if not re.fullmatch(content_regex(model), names):
                    report(path, "UnexpectedElement", f"content of {node.name} does not match its model")
        declared = dtd["attributes"].get(node.name, {})
        for a in node.attributes:
            if a.name not in declared and not a.name.startswith("xml:"):
                report(path, "UnexpectedAttribute", f"attribute {a.name} is not declared")
        for name, (kind, default, required) in declared.items():
            value = next((a.value for a in node.attributes if a.name == name), None)
            if value is None:
                if required and default is None:
                    report(path, "MissingRequiredAttribute", f"attribute {name} is required")
                continue
            if default is not None and required and value != default:
                report(path, "FacetViolation", f"attribute {name} must be {default}")
            if kind.startswith(("(", "NOTATION")) and value not in re.findall(r"[^|()\s]+", kind.removeprefix("NOTATION")):
                report(path, "FacetViolation", f"{value} is not one of {kind}")
            elif kind == "ID":
                if value in ids:
                    report(path, "KeyNotUnique", f"ID {value} occurs twice")
                ids[value] = path
            elif kind in ("IDREF", "IDREFS"):
                refs.extend((path, v) for v in value.split())
            elif kind in ("NMTOKEN", "NMTOKENS") and not all(re.fullmatch(r"[\w.:·-]+", v) for v in value.split() or [""]):
                report(path, "TypeMismatch", f"{value} is no name token")
            elif kind in ("ENTITY", "ENTITIES"):
                for v in value.split():
                    if v not in dtd["unparsed"]:
                        report(path, "KeyRefDangling", f"{v} is no unparsed entity")
        seen: dict[str, int] = {}
        for c in node.elements():
            seen[c.name] = seen.get(c.name, 0) + 1
            visit(c, f"{path}/{c.name}[{seen[c.name]}]")

    root = next(iter(parsed.document.elements()), None)
    if root is not None:
        if dtd["doctype"] and dtd["doctype"][0] != root.name:
            report(f"/{root.name}", "Other", f"the root must be {dtd['doctype'][0]}")
        visit(root, f"/{root.name}")
    for path, v in refs:
        if v not in ids:
            report(path, "KeyRefDangling", f"IDREF {v} has no ID")
    return found


def inject_defaults(parsed: Parsed) -> Node:
    """Adds declared defaults to elements that lack the attribute."""
    for n in parsed.document.descendants():
        for name, (_, default, _) in parsed.dtd["attributes"].get(n.name, {}).items() if n.kind == "element" else ():
            if default is not None and not any(a.name == name for a in n.attributes):
                prefix, _, local = name.rpartition(":")
                n.set(local, default, n.ns_map.get(prefix, "") if prefix else "", prefix)
    return parsed.document
