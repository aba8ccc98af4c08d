"""Verbs over DataFrames of documents: query, transform, validate, repair, format, canonicalize, include, select and stream.

Everything row-local runs in Arrow batches with one document at a time; an error in a document gives an ``error`` in its row and never fails the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.model import Node
from canopy.functions.library import text as string_value
from canopy.plans.rowlocal import Context, atomize, evaluate, text_of, to_number, to_text, truth
from canopy.plans.xpath import compile_xpath
from canopy.sinks.serialize import Output, canonicalize, serialize
from canopy.sources.html import parse_html
from canopy.sources.xml import Options, parse

KINDS = {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}


def map_documents(text: Column, kind: str, run: Callable[[Any], Any]) -> Column:
    """struct(value, error) of a function of each document's text; a null text gives a null value."""

    @F.arrow_udf(f"struct<value: {kind}, error: string>")
    def mapped(texts: pa.Array) -> pa.Array:
        values, errors = [], []
        for t in texts:
            try:
                values.append(run(t.as_py()) if t.is_valid else None)
                errors.append(None)
            except Exception as e:  # noqa: BLE001  a document's own failure belongs in its row
                values.append(None)
                errors.append(f"{type(e).__name__}: {e}"[:1000])
        return pa.StructArray.from_arrays([pa.array(values, KINDS[kind]), pa.array(errors, pa.string())], ["value", "error"])

    return mapped(text)


def _document(text: Any, html: bool, options: Options) -> Node:
    if html:
        return parse_html(text).document
    parsed = parse(text, options)
    if parsed.errors and not options.recover:
        raise ValueError(parsed.errors[0][1])
    return parsed.document


RESULTS: dict[str, tuple[str, Callable[[list], Any]]] = {
    "string": ("string", text_of), "boolean": ("boolean", truth), "number": ("double", lambda v: to_number(v[0]) if v else float("nan")), "count": ("long", len),
    "strings": ("array<string>", lambda v: [to_text(x) if not isinstance(x, Node) else x.string() for x in (v if all(isinstance(y, Node) for y in v) else atomize(v))]),
    "nodes": ("array<string>", lambda v: [serialize(x) if isinstance(x, Node) else to_text(x) for x in v]),
}


def xpath_query(
    df: DataFrame, text: str, expression: str, output: str = "strings", html: bool = False, namespaces: dict[str, str] | None = None, variables: dict[str, list] | None = None, functions: dict | None = None, options: Options = Options(), into: str = "result",
) -> DataFrame:
    """df with struct(value, error) of an XPath expression. output: string, boolean, number, count, strings or nodes. ``functions`` maps (name, arity) to callables of (context, *sequences)."""
    tree = compile_xpath(expression)  # static errors come before any job
    kind, project = RESULTS[output]

    def run(source: Any) -> Any:
        ctx = Context(item=_document(source, html, options), namespaces=namespaces or {}, variables=variables or {}, functions=functions or {})
        return project(evaluate(tree, ctx))

    return df.withColumn(into, map_documents(F.col(text), kind, run))


def xpath_columns(df: DataFrame, text: str, expressions: dict[str, str], separator: str = ",", namespaces: dict[str, str] | None = None, into: str = "result") -> DataFrame:
    """df with struct(value, error): the string values of each expression's items, joined, in the order of the expressions; all from one parse of the document."""
    trees = [compile_xpath(f"({e})") for e in expressions.values()]
    bound = namespaces or {}

    def run(source: Any) -> list[str]:
        ctx = Context(item=_document(source, False, Options()), namespaces=bound)
        return [separator.join([x.string() if isinstance(x, Node) else string_value([x]) for x in evaluate(t, ctx)]) for t in trees]

    return df.withColumn(into, map_documents(F.col(text), "array<string>", run))


def xslt_transform(df: DataFrame, text: str, stylesheet: str, params: dict | None = None, loader: dict[str, str] | None = None, documents: dict[str, str] | None = None, into: str = "result") -> DataFrame:
    """df with struct(value, error, secondary, messages): a stylesheet's output, its result documents by href and its messages; the stylesheet is compiled once here and once a worker."""
    from canopy.plans.xslt import compile_stylesheet, transform

    compile_stylesheet(stylesheet, loader)
    built: list = []

    @F.arrow_udf("struct<value: string, error: string, secondary: map<string,string>, messages: array<string>>")
    def run(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(compile_stylesheet(stylesheet, loader))
        rows = []
        for t in texts:
            try:
                rows.append((*([None] * 4),) if not t.is_valid else (lambda out, more, said: (out, None, list(more.items()), list(said)))(*transform(t.as_py(), built[0], params, documents)))
            except Exception as e:  # noqa: BLE001  a document's own failure belongs in its row
                rows.append((None, f"{type(e).__name__}: {e}"[:1000], None, None))
        kinds = pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["value", "error", "secondary", "messages"])

    return df.withColumn(into, run(F.col(text)))


def validate(df: DataFrame, text: str, kind: str, schema: str = "", loader: dict[str, str] | None = None, phase: str | None = None) -> DataFrame:
    """df with issues, an array of (path, kind, message). kind: dtd, xsd, relaxng or schematron; malformed documents give one issue."""
    built: list = []

    def build():
        from canopy.validate import dtd, relaxng, schematron, xsd

        if kind == "dtd":
            return dtd.validate
        if kind == "xsd":
            made = xsd.Schema(schema, loader)
            return lambda p: made.validate(p.document)
        if kind == "relaxng":
            grammar = relaxng.Grammar(schema)
            return lambda p: grammar.validate(p.document)
        rules = schematron.Schematron(schema, loader)
        return lambda p: [{"path": f["path"], "kind": f["kind"], "message": f["message"]} for f in rules.run(p.document, phase)]

    build()  # errors of the schema come before any job

    @F.arrow_udf("array<struct<path: string, kind: string, message: string>>")
    def issues(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(build())
        out = []
        for t in texts:
            parsed = parse(t.as_py())
            try:
                found = [{"path": "", "kind": "Malformed", "message": parsed.errors[0][1]}] if parsed.errors else built[0](parsed)
            except Exception as e:  # noqa: BLE001
                found = [{"path": "", "kind": "Other", "message": f"{type(e).__name__}: {e}"[:1000]}]
            out.append([{k: f[k] for k in ("path", "kind", "message")} for f in found])
        return pa.array(out, pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("message", pa.string())])))

    return df.withColumn("issues", issues(F.col(text)))


def repair(df: DataFrame, text: str, into: str = "repaired") -> DataFrame:
    """df with the document parsed in recovery mode and written again."""
    return df.withColumn(into, map_documents(F.col(text), "string", lambda s: serialize(parse(s, Options(recover=True)).document)))


def reformat(df: DataFrame, text: str, output: Output | None = None, html: bool = False, into: str = "formatted") -> DataFrame:
    """df with the document written again under output properties."""
    out = output or Output(indent=True)
    return df.withColumn(into, map_documents(F.col(text), "string", lambda s: serialize(_document(s, html, Options()), out)))


def c14n(df: DataFrame, text: str, exclusive: bool = False, comments: bool = False, into: str = "canonical") -> DataFrame:
    """df with canonical XML."""
    return df.withColumn(into, map_documents(F.col(text), "string", lambda s: canonicalize(_document(s, False, Options()), exclusive, comments)))


def deep_hash(df: DataFrame, text: str, into: str = "tree_hash") -> DataFrame:
    """df with a digest that is the same for deep-equal documents (canonical form without comments)."""
    return df.withColumn(into, map_documents(F.col(text), "string", lambda s: hashlib.sha256(canonicalize(_document(s, False, Options())).encode()).hexdigest()))


# --- selectors ---


def css_to_xpath(selector: str) -> str:
    """tag * .class #id [a] [a=v] with descendant and child combinators, as XPath."""
    import re

    path, axis = "", "//"
    for part in re.findall(r">|[^\s>]+(?:\[[^\]]*\])?", selector.strip()):
        if part == ">":
            axis = "/"
            continue
        tag = re.match(r"[A-Za-z][\w-]*|\*", part)
        tests = [f"[@id='{m}']" for m in re.findall(r"#([\w-]+)", part)]
        tests += [f"[contains(concat(' ', normalize-space(@class), ' '), ' {m} ')]" for m in re.findall(r"\.([\w-]+)", re.sub(r"\[[^\]]*\]", "", part))]
        for name, _, value in re.findall(r"""\[([\w:-]+)(?:\s*(=)\s*["']?([^"'\]]*)["']?)?\]""", part):
            tests.append(f"[@{name}='{value}']" if _ else f"[@{name}]")
        path += f"{axis if path or axis == '//' else '/'}{tag[0] if tag else '*'}{''.join(tests)}"
        axis = "//"
    return path


# --- catalogs and inclusion ---


def resolve_catalog(uris: DataFrame, uri: str, catalog: DataFrame) -> DataFrame:
    """OASIS catalog lookup. catalog: entry_type (uri, system, public, rewrite), name, target. Exact entries win, then the longest rewritten prefix.

    Exact entries meet in a hash join. For rewrites every prefix of the URI that is as long as some entry is a join key, so no theta join arises.
    """
    exact = catalog.where(F.col("entry_type").isin("uri", "system", "public")).groupBy(F.col("name").alias(uri)).agg(F.min("target").alias("_exact"))
    rewrite = catalog.where("entry_type = 'rewrite'").select(F.col("name").alias("_prefix"), F.col("target").alias("_to"))
    lengths = sorted(r[0] for r in rewrite.select(F.char_length("_prefix")).distinct().collect())
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.col(uri).substr(1, n).alias("_prefix")) for n in lengths]) if lengths else F.expr("cast(array() as array<struct<n:int,_prefix:string>>)")
    probes = uris.select(uri).distinct().select(uri, F.explode(keys).alias("k")).select(uri, "k.n", "k._prefix").join(rewrite, "_prefix")
    best = probes.groupBy(uri).agg(F.max_by(F.struct("_to", "n"), "n").alias("_best"))
    joined = uris.join(exact, uri, "left").join(best, uri, "left")
    rest = F.concat(F.col("_best._to"), F.call_function("substring", F.col(uri), F.col("_best.n") + 1))
    return joined.withColumn("resolved", F.coalesce("_exact", rest, uri)).drop("_exact", "_best")


def xinclude(df: DataFrame, uri: str, text: str, max_depth: int = 16) -> DataFrame:
    """df with xi:include elements replaced by the documents (or texts) of the same table, level by level; cycles and missing targets without a fallback stay as they are.

    Each level is a join on the href, so no task ever holds more than one document and what it includes.
    """
    ns = "http://www.w3.org/2001/XInclude"

    def hrefs(source: str) -> list[str]:
        return sorted({n.get("href") or "" for n in parse(source).document.descendants() if n.kind == "element" and n.ns == ns and n.local == "include" and n.get("done") is None})

    @F.arrow_udf("string")
    def replaced(sources: pa.Array, targets: pa.Array) -> pa.Array:
        out = []
        for s, t in zip(sources.to_pylist(), targets.to_pylist()):
            if s is None:
                out.append(None)
                continue
            document, known = parse(s).document, {x["href"]: x["text"] for x in t or []}
            for n in [x for x in document.descendants() if x.kind == "element" and x.ns == ns and x.local == "include"]:
                found, new = known.get(n.get("href") or ""), None
                if found is not None:
                    new = [Node("text", value=found)] if n.get("parse") == "text" else parse(found).document.children
                else:
                    fallback = [c for c in n.elements() if c.ns == ns and c.local == "fallback"]
                    new = fallback[0].children if fallback else None
                if new is None:
                    n.set("done", "missing")
                    continue
                at = next(i for i, c in enumerate(n.parent.children) if c is n)
                for c in new:
                    c.parent = n.parent
                n.parent.children[at : at + 1] = new
            out.append(serialize(document))
        return pa.array(out, pa.string())

    table = df.select(F.col(uri).alias("_href"), F.col(text).alias("_text"))
    current = df
    for _ in range(max_depth):
        wanted = current.withColumn("_hrefs", map_documents(F.col(text), "array<string>", hrefs)["value"])
        pending = wanted.where(F.size("_hrefs") > 0)
        if pending.limit(1).count() == 0:
            break
        pairs = pending.select(uri, F.explode("_hrefs").alias("_href")).join(table, "_href").where(F.col("_href") != F.col(uri))
        given = pairs.groupBy(uri).agg(F.collect_list(F.struct(F.col("_href").alias("href"), F.col("_text").alias("text"))).alias("_given"))
        joined = wanted.join(given, uri, "left")
        current = joined.withColumn(text, F.when(F.size("_hrefs") > 0, replaced(text, "_given")).otherwise(F.col(text))).select(*df.columns)
    return current


def typed_rows(df: DataFrame, text: str, schema: str, into: str = "row") -> DataFrame:
    """df with the document as a struct: attributes are fields named ``@name``, text beside them is ``$text``; a document that does not parse gives nulls."""
    return df.withColumn(into, F.from_xml(F.col(text), schema, {"attributePrefix": "@", "valueTag": "$text"}))
