"""Exact dedup by skew-safe combining.

1. Every input partition combines its own equal texts (map-side aggregation).
2. What is left meets by (digest, salt), the salt being the number of the input partition
   modulo ``salts``: a hot group is spread over that many tasks, with one row from each input partition.
3. The winners of the salts meet by digest.
Each stage groups by the normalised text itself next to its digest, so texts are compared in full.

Defined cases: a null text counts as empty; texts are equal when they are identical after each run of ASCII
whitespace became one space; of equal texts the smallest doc_id stays (null ids come last); rows
that repeat a doc_id as well as a text give one kept row; an empty table gives an empty
result; further columns are carried through, and one that has the name of a result column
gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.common import lookup, shared_table, shielded

SALTS = 32


def normalised(text: Column) -> Column:
    """Each run of ASCII whitespace becomes one space; single spaces are left alone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digest_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, n_bytes, keep_id, group_size) of every group of two or more equal texts."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("norm")).select(
        "doc_id", "norm", F.sha2("norm", 256).alias("digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    )
    salted = text.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return winners.where("group_size > 1").select("digest", F.octet_length("norm").alias("n_bytes"), "keep_id", "group_size")


def mark(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256 (of the normalised text)."""
    return shielded(docs, ["doc_id", "text"], lambda d: _mark(d, salts))


def _mark(docs: DataFrame, salts: int) -> DataFrame:
    groups = shared_table(digest_groups(docs, salts), "exact-groups")
    rows = docs.withColumn("_norm", normalised(F.col("text")))
    rows = rows.withColumn("digest", F.sha2("_norm", 256)).withColumn("n_bytes", F.octet_length("_norm")).drop("_norm")
    found = lookup(rows, groups, ["digest", "n_bytes"], "group_size", docs.count(), [F.col("doc_id")])
    # Rows of one group and doc_id already lie together; the first of them stays.
    nth = F.row_number().over(Window.partitionBy("digest", "n_bytes", "_deal", "doc_id").orderBy("doc_id"))
    single = F.col("group_size").isNull()
    return found.withColumn("_nth", nth).select(
        *docs.columns,
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"))
    kept = mark(rows, salts).where("kept")
    return kept.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
