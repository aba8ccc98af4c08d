"""Command line: lint, format, xpath, xslt, validate, repair, stats, c14n and diff over files. Exit code 0: ok, 1: negative, 2: error."""

from __future__ import annotations

import argparse
import json
import sys
from collections import Counter
from pathlib import Path

from canopy.api import RESULTS
from canopy.model import Node
from canopy.plans.rowlocal import run
from canopy.plans.xslt import transform
from canopy.sinks.serialize import Output, canonicalize, serialize
from canopy.sources.xml import Options, parse


def statistics(document: Node) -> dict[str, int]:
    """Counts by kind, depth and text bytes."""
    kinds, depth, size = Counter(), 0, 0
    stack = [(c, 1) for c in document.children]
    while stack:
        n, d = stack.pop()
        kinds[n.kind] += 1
        kinds["attribute"] += len(n.attributes)
        if n.kind == "element":
            depth = max(depth, d)
            stack += [(c, d + 1) for c in n.children]
        elif n.kind in ("text", "cdata"):
            size += len(n.value.encode())
    return {**dict(sorted(kinds.items())), "max_depth": depth, "text_bytes": size}


def difference(a: Node, b: Node, path: str = "") -> list[tuple[str, str]]:
    """(change, path) of two trees, child by child."""
    out: list[tuple[str, str]] = []
    if (a.kind, a.name, a.value) != (b.kind, b.name, b.value) or {(x.name, x.value) for x in a.attributes} != {(x.name, x.value) for x in b.attributes}:
        out.append(("change", path or "/"))
    for i in range(max(len(a.children), len(b.children))):
        here = f"{path}/{i + 1}"
        if i >= len(a.children) or i >= len(b.children):
            out.append(("add" if i >= len(a.children) else "delete", here))
        else:
            out += difference(a.children[i], b.children[i], here)
    return out


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="canopy")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name in ("lint", "format", "xpath", "xslt", "validate", "repair", "stats", "c14n", "diff"):
        p = verbs.add_parser(name)
        if name in ("xpath", "xslt"):
            p.add_argument("what")
        p.add_argument("files", nargs="+")
        for option in {"format": ["--pretty", "--check", "--in-place"], "xpath": ["--count", "--exists", "--nodes"], "validate": ["--json"], "c14n": ["--exclusive", "--comments"]}.get(name, []):
            p.add_argument(option, action="store_true")
        if name == "validate":
            p.add_argument("--schema")
            p.add_argument("--schematron")
            p.add_argument("--relaxng")
        if name == "xpath":
            p.add_argument("--separator", default="\n")
        if name == "xslt":
            p.add_argument("--param", action="append", default=[])
    said = top.parse_args(args)
    try:
        return max([_one(said, f) for f in said.files], default=0) if said.verb != "diff" else _diff(said.files)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


def _diff(files: list[str]) -> int:
    found = difference(*(parse(Path(f).read_bytes()).document for f in files[:2]))
    for change, path in found:
        print(f"{change} {path}")
    return int(bool(found))


def _one(said: argparse.Namespace, name: str) -> int:
    data = Path(name).read_bytes()
    parsed = parse(data, Options(recover=said.verb == "repair"))
    for code, message, line, column in parsed.errors if said.verb in ("lint", "repair") else parsed.errors[:1]:
        print(f"{name}:{line}:{column}: {code}: {message}", file=sys.stderr)
    if said.verb == "lint":
        return int(bool(parsed.errors))
    if said.verb == "repair":
        print(serialize(parsed.document))
        return 0
    if parsed.errors:
        return 2
    document = parsed.document
    if said.verb == "format":
        made = serialize(document, Output(indent=said.pretty))
        if said.check:
            return int(made.encode() != data.rstrip(b"\n"))
        if said.in_place:
            Path(name).write_text(made, encoding="utf-8")
        else:
            print(made)
    elif said.verb == "xpath":
        found = run(said.what, document, namespaces=document.elements()[0].ns_map)
        if said.exists:
            return int(not RESULTS["boolean"][1](found))
        print(len(found) if said.count else said.separator.join(RESULTS["nodes" if said.nodes else "strings"][1](found)))
    elif said.verb == "xslt":
        print(transform(data.decode(), Path(said.what).read_text(encoding="utf-8"), dict(p.split("=", 1) for p in said.param))[0])
    elif said.verb == "validate":
        from canopy.validate import dtd, relaxng, schematron, xsd

        issues = (
            xsd.Schema(Path(said.schema).read_text()).validate(document) if said.schema else schematron.Schematron(Path(said.schematron).read_text()).run(document) if said.schematron
            else relaxng.Grammar(Path(said.relaxng).read_text()).validate(document) if said.relaxng else dtd.validate(parsed)
        )
        print(json.dumps(issues) if said.json else "\n".join(f"{name}: {i['path']}: {i['kind']}: {i['message']}" for i in issues))
        return int(bool(issues))
    elif said.verb == "stats":
        print(json.dumps(statistics(document)))
    elif said.verb == "c14n":
        print(canonicalize(document, said.exclusive, said.comments), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
