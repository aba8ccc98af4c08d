"""XPath paths compiled to DataFrame plans over the node table.

Leading steps from the root without predicates become one filter on the stored path, which reaches the scan. Every further step is a
join on doc_id and an axis condition; predicates become semi-joins or window numbers, general comparisons
joins to the operand's values, and nothing runs in Python. What this subset lacks is evaluated by ``canopy.plans.rowlocal``.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.model import path_name
from canopy.plans.xpath import REVERSE_AXES, XPathError, compile_xpath

NODE = ["pre", "size", "level", "parent", "kind", "name", "prefix", "local", "ns", "value", "sib", "elem_sib", "owner", "path"]
COMPARE = {"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge", "eq": "eq", "ne": "ne", "lt": "lt", "le": "le", "gt": "gt", "ge": "ge"}
FLIP = {"eq": "eq", "ne": "ne", "lt": "gt", "le": "ge", "gt": "lt", "ge": "le"}


def number(text: Column) -> Column:
    """XPath's number(): NaN for what is no number."""
    return F.coalesce(text.try_cast("double"), F.lit(float("nan")))


def compared(op: str, left: Column, right: Column) -> Column:
    """A comparison in which NaN is unequal to all."""
    if op == "eq":
        return left == right
    if op == "ne":
        return left != right
    return {"lt": left < right, "le": left <= right, "gt": left > right, "ge": left >= right}[op]


class Paths:
    """Compiles paths over one node table."""

    def __init__(self, nodes: DataFrame, namespaces: dict[str, str] | None = None):
        # A node table that lies by doc_id joins on (doc_id, ...) where it lies.
        nodes.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.nodes, self.namespaces = nodes.select("doc_id", *NODE), namespaces or {}

    # --- entry points ---

    def select(self, expression: str) -> DataFrame:
        """doc_id and node columns of the selected nodes, each once, in no order (``in_order`` sorts)."""
        return self.evaluate(compile_xpath(expression)).drop("origin")

    def strings(self, expression: str) -> DataFrame:
        """(doc_id, pre, text): the string values of the selected nodes."""
        return self.with_text(self.evaluate(compile_xpath(expression)).drop("origin")).select("doc_id", "pre", "text")

    def count(self, expression: str) -> DataFrame:
        """(doc_id, n) for every document, 0 included."""
        found = self.select(expression).groupBy("doc_id").agg(F.count("*").alias("n"))
        return self.documents().join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))

    def exists(self, expression: str) -> DataFrame:
        """(doc_id, found) for every document."""
        found = self.select(expression).select("doc_id").distinct().withColumn("found", F.lit(True))
        return self.documents().join(found, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("found"))

    def aggregate(self, expression: str, how: str) -> DataFrame:
        """(doc_id, value) of sum, avg, min or max over the selected nodes as numbers; sum of none is 0, the others are null; a non-number gives NaN."""
        values = self.strings(expression).select("doc_id", number(F.col("text")).alias("v"))
        made = getattr(F, how)("v")
        found = values.groupBy("doc_id").agg(F.when(F.bool_or(F.isnan("v")), F.lit(float("nan"))).otherwise(made).alias("value"))
        return self.documents().join(found, "doc_id", "left").select("doc_id", F.coalesce("value", F.lit(0.0)).alias("value") if how == "sum" else "value")

    def documents(self) -> DataFrame:
        return self.nodes.where("pre = 0").select("doc_id")

    # --- paths ---

    def evaluate(self, tree: tuple, context: DataFrame | None = None) -> DataFrame:
        """Rows (doc_id, origin, node columns), each once for an origin (the context node's pre)."""
        kind = tree[0]
        if kind == "paren":
            return self.evaluate(tree[1], context)
        if kind == "context" and context is not None:
            return context
        if kind == "binary" and tree[1] in ("union", "intersect", "except"):
            left, right = self.evaluate(tree[2], context), self.evaluate(tree[3], context)
            key = ["doc_id", "origin", "pre"]
            if tree[1] == "union":
                return left.unionByName(right).dropDuplicates(key)
            return left.join(right.select(*key), key, "left_semi" if tree[1] == "intersect" else "left_anti")
        if kind == "filter":
            rows = self.evaluate(tree[1], context)
            return self.predicate(rows.withColumn("ctx", F.col("origin")), tree[2], False).drop("ctx")
        if kind != "path":
            raise XPathError("UNSUPPORTED", f"{kind} is not a path")
        start, steps = tree[1], tree[2]
        if start == ("root",):
            if context is None:
                rows, steps = self.anchored(steps)
            else:
                roots = self.nodes.where("pre = 0")
                rows = context.select("doc_id", "origin").distinct().join(roots, "doc_id")
        elif start == ("context",):
            if context is None:
                rows = self.nodes.where("pre = 0").withColumn("origin", F.lit(0).cast("long"))
            else:
                rows = context
        else:
            rows = self.evaluate(start, context)
        i = 0
        while i < len(steps):
            step = steps[i]
            if step[0] != "axis":
                raise XPathError("UNSUPPORTED", "only axis steps have a relational plan")
            follows = steps[i + 1] if i + 1 < len(steps) else None
            if step[1:] == ("descendant-or-self", ("kind", "node", None), []) and follows and follows[0] == "axis" and follows[1] == "child" and not self.positional(follows[3]):
                step, i = ("axis", "descendant", follows[2], follows[3]), i + 1  # //x without positions is descendant::x
            rows = self.step(rows, step)
            i += 1
        return rows

    def anchored(self, steps: list[tuple]) -> tuple[DataFrame, list[tuple]]:
        """Leading name steps without predicates as one filter on the stored path."""
        pattern, used, deep, last, kind, uri = "", 0, False, None, "element", self.namespaces.get("", "")
        for step in steps:
            if step[0] != "axis" or step[3] and step[1] != "child":
                break
            axis, test = step[1], step[2]
            if axis == "descendant-or-self" and test == ("kind", "node", None):
                deep, used = True, used + 1
                continue
            plain = test[0] == "name" and (test[1] is None or test[1] == ("default",))
            if axis not in ("child", "attribute") or not plain or step[3]:
                break
            name = "[^/@]+" if test[2] == "*" else re.escape(path_name(uri if axis == "child" else "", test[2]))
            pattern += ("(/[^/]+)*" if deep else "") + ("/@" if axis == "attribute" else "/") + name
            deep, used, last = False, used + 1, test
            if axis == "attribute":
                kind = axis
                break
        if deep:
            used -= 1
        origin = F.lit(0).cast("long").alias("origin")
        if last is None:
            return self.nodes.where("pre = 0").select("doc_id", origin, *NODE), steps
        rows = self.nodes.where(F.col("kind") == kind).where(F.col("path").rlike(f"^{pattern}$"))
        if last[2] != "*":
            rows = rows.where((F.col("local") == last[2]) & (F.col("ns") == (uri if kind == "element" else "")))
        return rows.select("doc_id", origin, *NODE), steps[used:]

    def test(self, test: tuple, axis: str) -> Column:
        """Condition on a node n under a node test."""
        principal = axis if axis in ("attribute", "namespace") else "element"
        if test[0] == "kind":
            name = test[1]
            if name == "node":
                return F.lit(True)
            if name == "processing-instruction" and test[2]:
                return (F.col("n.kind") == name) & (F.col("n.local") == test[2])
            if name in ("element", "attribute") and test[2] and test[2] != "*":
                return (F.col("n.kind") == name) & (F.col("n.name") == test[2])
            kinds = {"text": ["text", "cdata"], "document-node": ["document"]}.get(name, [name])
            return F.col("n.kind").isin(kinds)
        found = F.col("n.kind") == principal
        if test[2] != "*":
            found = found & (F.col("n.local") == test[2])
        if isinstance(test[1], tuple) and test[1][0] in ("prefix", "uri"):
            uri = test[1][1] if test[1][0] == "uri" else self.namespaces.get(test[1][1])
            if uri is None:
                raise XPathError("XPST0081", f"prefix {test[1][1]} is not bound")
            found = found & (F.col("n.ns") == uri)
        elif test[1] == ("default",):
            found = found & (F.col("n.ns") == self.namespaces.get("", "") if axis not in ("attribute", "namespace") else F.col("n.ns") == "")
        return found

    def step(self, rows: DataFrame, step: tuple) -> DataFrame:
        axis, test, predicates = step[1], step[2], step[3]
        c, n = (lambda x: F.col(f"c.{x}")), (lambda x: F.col(f"n.{x}"))
        plain = ~n("kind").isin("attribute", "namespace")
        inside = (n("pre") > c("pre")) & (n("pre") <= c("pre") + c("size")) & plain
        within = (c("pre") > n("pre")) & (c("pre") <= n("pre") + n("size"))
        tree_node = ~c("kind").isin("attribute", "namespace")
        on = {
            "child": (n("parent") == c("pre")) & plain,
            "attribute": (n("parent") == c("pre")) & (n("kind") == "attribute"),
            "namespace": (n("parent") == c("pre")) & (n("kind") == "namespace"),
            "parent": n("pre") == c("parent"),
            "self": n("pre") == c("pre"),
            "descendant": inside,
            "descendant-or-self": inside | (n("pre") == c("pre")),
            "ancestor": within,
            "ancestor-or-self": within | (n("pre") == c("pre")),
            "following-sibling": (n("parent") == c("parent")) & (n("sib") > c("sib")) & plain & tree_node,
            "preceding-sibling": (n("parent") == c("parent")) & (n("sib") < c("sib")) & plain & tree_node,
            "following": (n("pre") > c("pre") + c("size")) & plain,
            "preceding": (n("pre") + n("size") < c("pre")) & plain,
        }[axis]
        joined = rows.alias("c").join(self.nodes.alias("n"), (c("doc_id") == n("doc_id")) & on & self.test(test, axis))
        found = joined.select(c("doc_id").alias("doc_id"), c("origin").alias("origin"), c("pre").alias("ctx"), *[n(x).alias(x) for x in NODE])
        for p in predicates:
            found = self.predicate(found, p, axis in REVERSE_AXES)
        found = found.drop("ctx")
        # A node has one parent, so these axes can't reach it twice from different contexts.
        return found if axis in ("child", "attribute", "namespace", "self") else found.dropDuplicates(["doc_id", "origin", "pre"])

    # --- predicates ---

    def positional(self, predicates: list[tuple]) -> bool:
        def uses(tree) -> bool:
            if isinstance(tree, tuple):
                if tree[:2] in (("call", "position"), ("call", "last")):
                    return True
                return tree[0] != "path" and any(uses(x) for x in tree[1:])
            return isinstance(tree, list) and any(uses(x) for x in tree)

        return any(p[0] in ("literal", "binary") and (p[0] == "literal" or uses(p)) or uses(p) for p in predicates)

    def predicate(self, rows: DataFrame, tree: tuple, reverse: bool) -> DataFrame:
        if tree[0] == "literal" and not isinstance(tree[1], str):
            tree = ("binary", "=", ("call", "position", []), tree)
        elif tree == ("call", "last", []):
            tree = ("binary", "=", ("call", "position", []), tree)
        columns = rows.columns
        if self.positional([tree]):
            focus = Window.partitionBy("doc_id", "origin", "ctx")
            rows = rows.withColumn("_position", F.row_number().over(focus.orderBy(F.col("pre").desc() if reverse else F.col("pre")))).withColumn("_last", F.count("*").over(focus))
        rows, test = self.boolean(rows, tree)
        return rows.where(test).select(*columns)

    def boolean(self, rows: DataFrame, tree: tuple) -> tuple[DataFrame, Column]:
        """rows with what the condition needs joined on, and the condition."""
        kind = tree[0]
        if kind == "paren":
            return self.boolean(rows, tree[1])
        if kind == "binary" and tree[1] in ("and", "or"):
            rows, left = self.boolean(rows, tree[2])
            rows, right = self.boolean(rows, tree[3])
            return rows, (left & right if tree[1] == "and" else left | right)
        if kind == "call" and tree[1] in ("not", "exists", "empty", "boolean"):
            rows, inner = self.boolean(rows, tree[2][0])
            return rows, (~inner if tree[1] in ("not", "empty") else inner)
        if kind == "call" and tree[1] in ("true", "false"):
            return rows, F.lit(tree[1] == "true")
        if kind == "call" and tree[1] in ("contains", "starts-with", "ends-with"):
            rows, a = self.scalar(rows, tree[2][0])
            rows, b = self.scalar(rows, tree[2][1])
            return rows, getattr(F, {"contains": "contains", "starts-with": "startswith", "ends-with": "endswith"}[tree[1]])(a, b)
        if kind == "binary" and tree[1] in COMPARE:
            return self.comparison(rows, COMPARE[tree[1]], tree[2], tree[3])
        sub = self.evaluate(tree, self.contexts(rows)).select("doc_id", F.col("origin").alias("pre")).distinct()
        flag = f"_f{len(rows.columns)}"
        return rows.join(sub.withColumn(flag, F.lit(True)), ["doc_id", "pre"], "left"), F.coalesce(F.col(flag), F.lit(False))

    def contexts(self, rows: DataFrame) -> DataFrame:
        """The distinct nodes of rows, each the origin of its own evaluation."""
        return rows.select("doc_id", *NODE).dropDuplicates(["doc_id", "pre"]).withColumn("origin", F.col("pre"))

    def is_path(self, tree: tuple) -> bool:
        return tree[0] in ("path", "context") or tree[0] in ("paren", "filter") and self.is_path(tree[1]) or tree[0] == "binary" and tree[1] in ("union", "intersect", "except")

    def comparison(self, rows: DataFrame, op: str, left: tuple, right: tuple) -> tuple[DataFrame, Column]:
        if self.is_path(right) and not self.is_path(left):
            left, right, op = right, left, FLIP[op]
        if not self.is_path(left):
            rows, a = self.scalar(rows, left)
            rows, b = self.scalar(rows, right)
            return rows, compared(op, a, b)
        flag = f"_f{len(rows.columns)}"
        values = self.with_text(self.evaluate(left, self.contexts(rows))).select("doc_id", F.col("origin").alias("pre"), F.col("text").alias("_a"))
        as_numbers = op in ("lt", "le", "gt", "ge")
        if self.is_path(right):
            other = self.with_text(self.evaluate(right, self.contexts(rows))).select("doc_id", F.col("origin").alias("pre"), F.col("text").alias("_b"))
            pairs = values.join(other, ["doc_id", "pre"])
            hit = pairs.where(compared(op, number(F.col("_a")), number(F.col("_b"))) & ~F.isnan(number(F.col("_a"))) & ~F.isnan(number(F.col("_b"))) if as_numbers else compared(op, F.col("_a"), F.col("_b")))
        else:
            numeric = as_numbers or not (right[0] == "literal" and isinstance(right[1], str)) and not (right[0] == "call" and right[1] in ("string", "concat"))
            a = number(F.col("_a")) if numeric else F.col("_a")
            rows, b = self.scalar(rows, right)
            b = number(b.cast("string")) if numeric and right[0] == "literal" and isinstance(right[1], str) else b
            if right[0] == "literal":
                hit = values.where(compared(op, a, b) & ~F.isnan(a) if numeric else compared(op, a, b))
            else:
                keyed = rows.select("doc_id", "pre", b.alias("_b")).distinct()
                pairs = values.join(keyed, ["doc_id", "pre"])
                hit = pairs.where(compared(op, a, F.col("_b")) & ~F.isnan(a) if numeric else compared(op, a, F.col("_b")))
        hit = hit.select("doc_id", "pre").distinct().withColumn(flag, F.lit(True))
        return rows.join(hit, ["doc_id", "pre"], "left"), F.coalesce(F.col(flag), F.lit(False))

    def scalar(self, rows: DataFrame, tree: tuple) -> tuple[DataFrame, Column]:
        """rows and a single value for each of them."""
        kind = tree[0]
        if kind == "paren":
            return self.scalar(rows, tree[1])
        if kind == "literal":
            return rows, F.lit(float(tree[1]) if isinstance(tree[1], Decimal) else tree[1])
        if kind == "call" and tree[1] in ("position", "last"):
            return rows, F.col(f"_{tree[1]}")
        if kind == "call" and tree[1] in ("local-name", "name", "namespace-uri") and not tree[2]:
            return rows, F.col({"local-name": "local", "name": "name", "namespace-uri": "ns"}[tree[1]])
        if kind == "binary" and tree[1] in ("+", "-", "*", "div", "mod", "idiv"):
            rows, a = self.scalar(rows, tree[2])
            rows, b = self.scalar(rows, tree[3])
            if tree[1] == "div":
                return rows, F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))).otherwise(F.try_divide(a, b))
            return rows, {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "mod": lambda: F.try_mod(a, b), "idiv": lambda: F.call_function("div", a.cast("long"), b.cast("long"))}[tree[1]]()
        column = f"_s{len(rows.columns)}"
        if kind == "call" and tree[1] == "count":
            found = self.evaluate(tree[2][0], self.contexts(rows)).groupBy("doc_id", F.col("origin").alias("pre")).agg(F.count("*").alias(column))
            return rows.join(found, ["doc_id", "pre"], "left"), F.coalesce(F.col(column), F.lit(0))
        if kind == "call" and tree[1] in ("sum", "avg", "min", "max"):
            values = self.with_text(self.evaluate(tree[2][0], self.contexts(rows))).withColumn("_v", number(F.col("text")))
            found = values.groupBy("doc_id", F.col("origin").alias("pre")).agg(getattr(F, tree[1])("_v").alias(column))
            return rows.join(found, ["doc_id", "pre"], "left"), F.coalesce(F.col(column), F.lit(0.0)) if tree[1] == "sum" else F.col(column)
        if kind == "call" and tree[1] in ("string", "string-length", "number", "normalize-space", "upper-case", "lower-case"):
            rows, text = self.scalar(rows, tree[2][0] if tree[2] else ("context",))
            made = {
                "string": lambda x: x, "string-length": F.char_length, "number": number, "upper-case": F.upper, "lower-case": F.lower,
                "normalize-space": lambda x: F.trim(F.regexp_replace(x, "[ \t\r\n]+", " ")),
            }[tree[1]]
            return rows, made(text)
        if kind == "call" and tree[1] == "concat":
            parts = []
            for x in tree[2]:
                rows, part = self.scalar(rows, x)
                parts.append(F.coalesce(part.cast("string"), F.lit("")))
            return rows, F.concat(*parts)
        if self.is_path(tree):  # the first node's string
            texts = self.with_text(self.evaluate(tree, self.contexts(rows)))
            found = texts.groupBy("doc_id", F.col("origin").alias("_o")).agg(F.min_by("text", texts["pre"]).alias(column)).withColumnRenamed("_o", "pre")
            return rows.join(found, ["doc_id", "pre"], "left"), F.coalesce(F.col(column), F.lit(""))
        raise XPathError("UNSUPPORTED", f"no relational plan for {tree[:2]}")

    # --- values ---

    def with_text(self, rows: DataFrame) -> DataFrame:
        """rows plus text, the string value of each node."""
        texts = self.nodes.where(F.col("kind").isin("text", "cdata")).select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("value").alias("_t"))
        inner = rows.where(F.col("kind").isin("element", "document")).select("doc_id", "pre", "size").distinct()
        pairs = inner.join(texts, (F.col("doc_id") == F.col("_d")) & (F.col("_p") > F.col("pre")) & (F.col("_p") <= F.col("pre") + F.col("size")))
        whole = pairs.groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]), "").alias("_whole"))
        return rows.join(whole, ["doc_id", "pre"], "left").withColumn("text", F.coalesce("_whole", "value", F.lit(""))).drop("_whole")


def in_order(rows: DataFrame) -> DataFrame:
    """Document order; costs a global sort, so it is left to who needs it."""
    return rows.orderBy("doc_id", "pre")
