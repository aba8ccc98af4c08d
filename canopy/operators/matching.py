"""Joins, identity, comparison of versions and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical_key(value: Column, kind: str = "text") -> Column:
    """Keys that are equal by value have one text: numbers lose their notation, dates their time zone's."""
    if kind == "number":
        return F.coalesce(value.try_cast("double"), F.lit(float("nan"))).cast("string")
    if kind == "dateTime":
        return F.date_format(value.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return value.cast("string")


def key_lookup(index: DataFrame, value: Column, probes: DataFrame, probe: Column, scope: list[str] | None = None) -> DataFrame:
    """xsl:key and key(): inner join of probes to the indexed rows, within ``scope`` columns of both. The join strategy is left to the optimiser."""
    left = probes.withColumn("_key", probe)
    right = index.withColumn("_key", value)
    return left.join(right, [*(scope or []), "_key"]).drop("_key")


def dangling(refs: DataFrame, ref: Column, keys: DataFrame, key: Column, split: bool = False) -> DataFrame:
    """keyref and IDREF checks: references without a key; ``split`` takes white-space separated lists."""
    left = refs.withColumn("_key", F.explode(F.filter(F.split(ref, r"[ \t\r\n]+"), lambda x: x != "")) if split else ref)
    return left.join(keys.select(key.alias("_key")).distinct(), "_key", "left_anti").withColumnRenamed("_key", "value")


def duplicate_keys(df: DataFrame, scope: list[str], fields: list[str], key: bool = False) -> DataFrame:
    """unique (or key) violations: tuples that occur more than once, and for a key those with a missing field."""
    present = None
    for f in fields:
        present = F.col(f).isNotNull() if present is None else present & F.col(f).isNotNull()
    twice = df.where(present).groupBy(*scope, *fields).agg(F.count("*").alias("n")).where("n > 1").withColumn("kind", F.lit("KeyNotUnique"))
    if not key:
        return twice
    missing = df.where(~present).groupBy(*scope, *fields).agg(F.count("*").alias("n")).withColumn("kind", F.lit("KeyMissing"))
    return twice.unionByName(missing)


def diff(left: DataFrame, right: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Structural diff by position key: change is add, delete or change; equal rows are left out."""
    a = left.select(*key, F.struct(*values).alias("_a"))
    b = right.select(*key, F.struct(*values).alias("_b"))
    joined = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "change")
    out = [F.col(f"_a.{v}").alias(f"old_{v}") for v in values] + [F.col(f"_b.{v}").alias(f"new_{v}") for v in values]
    return joined.select(*key, change.alias("change"), *out).where("change IS NOT NULL")


def statistics(nodes: DataFrame) -> DataFrame:
    """Counts by kind, depth and text bytes of each document."""
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    text = F.sum(F.when(F.col("kind").isin("text", "cdata"), F.octet_length("value")).otherwise(0))
    return nodes.groupBy("doc_id").agg(
        count("element").alias("elements"), count("attribute").alias("attributes"), count("text").alias("texts"), count("cdata").alias("cdatas"),
        count("comment").alias("comments"), count("processing-instruction").alias("pis"), F.max(F.when(F.col("kind") == "element", F.col("level"))).alias("max_depth"), text.alias("text_bytes"),
    )


def distinct_first(df: DataFrame, within: list[str], value: str, order: list[str]) -> DataFrame:
    """set:distinct: the first node of each string value."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*within, value).orderBy(*order))).where("_n = 1").drop("_n")


def extremes(df: DataFrame, within: list[str], value: Column, highest: bool = True) -> DataFrame:
    """math:highest and math:lowest: all tied nodes, none if any value is no number."""
    v = F.coalesce(value.try_cast("double"), F.lit(float("nan")))
    focus = Window.partitionBy(*within)
    marked = df.withColumn("_v", v).withColumn("_bad", F.max(F.isnan("_v").cast("int")).over(focus)).withColumn("_top", (F.max if highest else F.min)("_v").over(focus))
    return marked.where("_bad = 0 AND _v = _top").drop("_v", "_bad", "_top")


def resolve_dispatch(matches: DataFrame, node: list[str]) -> DataFrame:
    """Template dispatch: of each node's matching rules the best by import precedence, priority and place."""
    order = [F.col("precedence").desc(), F.col("priority").desc(), F.col("position").desc()]
    return matches.withColumn("conflict_rank", F.row_number().over(Window.partitionBy(*node).orderBy(*order)))
