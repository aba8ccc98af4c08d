"""Sorting, numbering, running values and early exit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sort_key(key: Column, data_type: str = "text", descending: bool = False, collation: str = "codepoint") -> list[Column]:
    """Order columns of one xsl:sort: numbers put non-numbers first in both directions; html-ascii-ci folds A-Z only."""
    if data_type == "number":
        value = F.coalesce(key.try_cast("double"), F.lit(float("nan")))
        return [F.isnan(value).desc(), value.desc() if descending else value.asc()]
    text = F.coalesce(key.cast("string"), F.lit(""))
    if collation == "html-ascii-ci":
        text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [text.desc() if descending else text.asc()]


def sort(df: DataFrame, keys: list[list[Column]], position: str, within: list[str] | None = None) -> DataFrame:
    """xsl:sort, stable by position: adds ``rank``. Inside ``within`` it is a window; without, a range-partitioned sort with offsets would be needed for global ranks, so rows come ordered and unranked."""
    order = [c for k in keys for c in k] + [F.col(position)]
    if within:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    return df.orderBy(*order)


def top(df: DataFrame, within: list[str], order: list[Column], k: int) -> DataFrame:
    """[position() <= k] in each focus."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("position") <= k)


def number_single(df: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """xsl:number level=single: place among siblings."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(*parent).orderBy(*order)))


def number_any(df: DataFrame, document: list[str], order: list[str], count: Column, since: Column | None = None) -> DataFrame:
    """xsl:number level=any: matches up to the node, restarted after each ``since`` match."""
    focus = Window.partitionBy(*document).orderBy(*order)
    upto = Window.unboundedPreceding
    if since is not None:
        df = df.withColumn("_reset", F.sum(since.cast("int")).over(focus.rowsBetween(upto, 0)))
        focus = Window.partitionBy(*document, "_reset").orderBy(*order)
    return df.withColumn("number", F.sum(F.coalesce(count, F.lit(False)).cast("int")).over(focus.rowsBetween(upto, 0))).drop("_reset")


def number_multiple(df: DataFrame, levels: list[tuple[list[str], list[str]]], separator: str = ".") -> DataFrame:
    """xsl:number level=multiple over nested keys: each level (parent keys, order keys) gives one ordinal."""
    parts = [F.dense_rank().over(Window.partitionBy(*parent).orderBy(*order)).cast("string") for parent, order in levels]
    return df.withColumn("number", F.concat_ws(separator, *parts))


def accumulator(df: DataFrame, document: list[str], order: list[str], value: Column, how: str = "sum") -> DataFrame:
    """accumulator-before and -after of an associative rule (sum, count, max, min) in document order."""
    focus = Window.partitionBy(*document).orderBy(*order)
    run = getattr(F, how)
    return df.withColumn("before", run(value).over(focus.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", run(value).over(focus.rowsBetween(Window.unboundedPreceding, 0)))


def iterate_until(df: DataFrame, document: list[str], order: list[str], value: Column, stop: float, inclusive: bool = True) -> DataFrame:
    """xsl:iterate with a running sum and xsl:break once it has reached ``stop``; the item that reaches it is processed if inclusive."""
    found = accumulator(df, document, order, value)
    limit = F.col("before") if inclusive else F.col("after")
    return found.where(F.coalesce(limit, F.lit(0)) < stop).withColumnRenamed("after", "running").drop("before")


def iterate(df: DataFrame, document: list[str], items: Column, start: Column, step, finish=None) -> DataFrame:
    """General xsl:iterate over the items (an array) of a row: a JVM-side fold."""
    return df.withColumn("result", F.aggregate(items, start, step, finish) if finish else F.aggregate(items, start, step))


def set_leading(df: DataFrame, document: list[str], order: list[str], in_second: Column) -> DataFrame:
    """set:leading: nodes before the first one that the second set holds."""
    focus = Window.partitionBy(*document).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_seen", F.sum(in_second.cast("int")).over(focus)).where("_seen = 0").drop("_seen")


def set_trailing(df: DataFrame, document: list[str], order: list[str], in_second: Column) -> DataFrame:
    """set:trailing: nodes after the last one that the second set holds."""
    focus = Window.partitionBy(*document).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_seen", F.sum(in_second.cast("int")).over(focus)).where("_seen = 0").drop("_seen")
