"""xsl:for-each-group and xsl:merge as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def group_by(df: DataFrame, key: Column, order: str, aggregates: dict[str, Column], multi: bool = False) -> DataFrame:
    """group-by: one row a distinct key with ``grouping_key``, ``first`` (place of its first item, the order of groups) and the aggregates.

    With ``multi`` the key is an array and an item joins a group for each of its distinct keys. Aggregates combine on the map side.
    """
    keyed = df.withColumn("grouping_key", F.explode(F.array_distinct(key)) if multi else key)
    return keyed.groupBy("grouping_key").agg(F.min(order).alias("first"), *[c.alias(n) for n, c in aggregates.items()])


def _runs(df: DataFrame, within: list[str], order: list[str], starts: Column, aggregates: dict[str, Column]) -> DataFrame:
    focus = Window.partitionBy(*within).orderBy(*order)
    numbered = df.withColumn("_start", starts).withColumn("group_no", F.sum(F.col("_start").cast("int")).over(focus.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*within, "group_no").agg(*[c.alias(n) for n, c in aggregates.items()])


def group_adjacent(df: DataFrame, within: list[str], order: list[str], key: Column, aggregates: dict[str, Column]) -> DataFrame:
    """Runs of items with equal keys, numbered from 1 inside each ``within``; a null key is an error in XSLT and a value of its own here."""
    focus = Window.partitionBy(*within).orderBy(*order)
    df = df.withColumn("_key", key)
    first = F.row_number().over(focus) == 1
    return _runs(df, within, order, first | ~F.col("_key").eqNullSafe(F.lag("_key").over(focus)), aggregates)


def group_starting_with(df: DataFrame, within: list[str], order: list[str], match: Column, aggregates: dict[str, Column]) -> DataFrame:
    """A matching item starts a group; leading items form their own."""
    focus = Window.partitionBy(*within).orderBy(*order)
    return _runs(df, within, order, F.coalesce(match, F.lit(False)) | (F.row_number().over(focus) == 1), aggregates)


def group_ending_with(df: DataFrame, within: list[str], order: list[str], match: Column, aggregates: dict[str, Column]) -> DataFrame:
    """A matching item ends its group; trailing items are kept."""
    focus = Window.partitionBy(*within).orderBy(*order)
    df = df.withColumn("_match", F.coalesce(match, F.lit(False)))
    return _runs(df, within, order, F.coalesce(F.lag("_match").over(focus), F.lit(True)), aggregates)


def merge(sources: dict[str, tuple[DataFrame, Column]], aggregates: Callable[[str], list[Column]]) -> DataFrame:
    """xsl:merge: sources (name: rows, key) grouped on equal keys. ``aggregates(name)`` gives aggregate columns over that source's rows, the column ``is_<name>`` marking them."""
    parts = None
    names = list(sources)
    for name, (df, key) in sources.items():
        part = df.withColumn("merge_key", key)
        for other in names:
            part = part.withColumn(f"is_{other}", F.lit(other == name))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts.groupBy("merge_key").agg(*[a for n in names for a in aggregates(n)])
