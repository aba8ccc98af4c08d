"""Relational tables viewed as documents, by arithmetic on row numbers alone: no parsing, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def publish(df: DataFrame, doc: str, order: list[str], root: str, row: str, fields: list[str]) -> DataFrame:
    """Node table of one document for each value of ``doc``: root / row* / field* / text().

    Rows are in the given order within their document, which is also the unit of distribution.
    A null field has no element.
    """
    numbered = df.withColumn("_i", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).withColumn("_doc", F.col(doc).cast("long"))
    texts = [F.col(f).cast("string") for f in fields]
    present = [t.isNotNull().cast("int") for t in texts]
    width = sum(present[1:], present[0]) * 2 + 1
    by_doc = Window.partitionBy("_doc")
    numbered = numbered.withColumn("_w", width).withColumn("_end", F.sum("_w").over(by_doc.orderBy("_i")))
    numbered = numbered.withColumn("_total", F.sum("_w").over(by_doc)).withColumn("_pre", F.lit(2) + F.col("_end") - F.col("_w"))

    def node(pre: Column, size, level: int, parent, kind: str, name: str, value, sib, path: str, elem_sib=None, when=None) -> Column:
        parts = [("pre", pre.cast("long")), ("size", F.lit(size).cast("long") if isinstance(size, int) else size.cast("long")), ("level", F.lit(level))]
        parts += [("parent", (F.lit(parent) if parent is None or isinstance(parent, int) else parent).cast("long")), ("kind", F.lit(kind)), ("name", F.lit(name)), ("prefix", F.lit("")), ("local", F.lit(name)), ("ns", F.lit(""))]
        parts += [("value", (F.lit(value) if value is None else value).cast("string")), ("sib", (F.lit(sib) if isinstance(sib, int) else sib).cast("int")), ("elem_sib", (F.lit(sib) if isinstance(sib, int) else sib).cast("int") if elem_sib is None else F.lit(elem_sib))]
        parts += [("owner", F.lit(None).cast("long")), ("path", F.lit(path))]
        made = F.struct(*[c.alias(n) for n, c in parts])
        return made if when is None else F.when(when, made)

    own = F.col("_pre")
    found = [node(own, F.col("_w") - 1, 2, 1, "element", row, None, F.col("_i"), f"/{root}/{row}")]
    before = F.lit(0)
    for name, text, there in zip(fields, texts, present):
        at = own + 1 + before * 2
        found.append(node(at, 1, 3, own, "element", name, None, before + 1, f"/{root}/{row}/{name}", when=text.isNotNull()))
        found.append(node(at + 1, 0, 4, at, "text", "", text, 1, f"/{root}/{row}/{name}/text()", 0, when=text.isNotNull()))
        before = before + there
    first = F.col("_i") == 1
    found.append(node(F.lit(0), F.col("_total") + 1, 0, None, "document", "", None, 0, "", when=first))
    found.append(node(F.lit(1), F.col("_total"), 1, 0, "element", root, None, 1, f"/{root}", when=first))
    return numbered.select(F.col("_doc").alias("doc_id"), F.explode(F.filter(F.array(*found), lambda n: n.isNotNull())).alias("n")).select("doc_id", "n.*")


def escape(text: Column, attribute: bool = False) -> Column:
    """Escaped character data."""
    made = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(made, F.lit('"'), F.lit("&quot;")) if attribute else made


def to_xml(row: str, attributes: dict[str, Column], elements: dict[str, Column]) -> Column:
    """One row as XML text; null attributes and elements are left out."""
    parts = [F.coalesce(F.concat(F.lit(f' {n}="'), escape(c.cast("string"), True), F.lit('"')), F.lit("")) for n, c in attributes.items()]
    inner = [F.coalesce(F.concat(F.lit(f"<{n}>"), escape(c.cast("string")), F.lit(f"</{n}>")), F.lit("")) for n, c in elements.items()]
    return F.concat(F.lit(f"<{row}"), *parts, F.lit(">"), *inner, F.lit(f"</{row}>"))
