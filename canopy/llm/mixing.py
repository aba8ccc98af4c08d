"""Mixing sources to target weights by systematic sampling.

Sizes are words. Each source gets a target of words from its weight, at most ``MAX_COPIES`` times its size, the excess going to the others by weight.
A document is expected target / source size times; within a source these expectations are summed up along the documents in order of size, one
random offset is added, and a document is emitted once for each whole number its interval crosses. As sums along the order stay within one copy of what is
expected, the words taken from a source differ from its target by no more than the size of its largest document.

All expectations of a source are equal, so the prefix sums are row numbers times the expectation. Rows are numbered over all sources by one range-partitioned sort, which splits any source and any size;
sources are a table of any length, ranked alike, and their targets come from rounds of sums over it. Order and offset come from
hashes with a seed, so reruns agree and nothing depends on how rows are partitioned.

Defined cases: null and blank texts have size 0 and are never short-changed: they take 0 words; a null source is a source of its own, listed last; a source
of size 0 has target 0; rows that repeat a doc_id and size are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import emit, lookup, numbered, row_key, shared_table, word_count

WEIGHTS, MAX_COPIES, SEED = (1, 2, 3), 3, "mix-1"


def unit_hash(*parts: Column) -> Column:
    """32 bits of MD5 as long, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """sources (source, source_size) with target: the words to take from each, all words shared by weight, none above ``most`` times its size.

    What a full source leaves is reshared: a round sums up what full sources take and the weights of the others, until no more are full.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int")).cast("long")
    listed = numbered(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_i").drop("_last")
    listed = listed.select(*sources.columns, weight.alias("_w"), (F.col("source_size") * most).alias("_cap"))
    whole = lambda value, digits: (F.lit(str(value)) if isinstance(value, int) else value).cast(f"decimal({digits},0)")
    total, of = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    left, n_full = total, 0
    while True:
        full = whole(left, 19) * whole(F.col("_w"), 18) >= whole(F.col("_cap"), 19) * whole(of, 18)
        n, taken, rest = listed.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0))).first()
        if n == n_full or not rest:
            break
        left, of, n_full = total - taken, rest, n
    shared = (F.lit(left).cast("long") * F.col("_w")).cast("double") / F.lit(max(1, of)).cast("double")
    return listed.select(*sources.columns, F.when(full, F.col("_cap").cast("double")).otherwise(shared).alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sized (doc_id, source, size, ...) with source_size, target and copies."""
    named = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    order = unit_hash(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = numbered(sized.withColumns({"_src": named, "_h": order}), ["_src", "size", "_h", "doc_id"], "_at")
    known = shared_table(rows.groupBy("_src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("_n"), F.min("_at").alias("_start")), "sources")
    goal = targets(known, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = unit_hash(F.lit(SEED), F.col("_src")) / F.lit(float(1 << 32))
    goal = shared_table(goal.select("_src", "source_size", "target", "_n", "_start", rate.alias("_rate"), offset.alias("_offset")), "targets")
    found = lookup(rows, goal, ["_src"], "_n", rows.count(), [F.col("_at")])
    place = F.col("_at") - F.col("_start")
    copies = F.floor(F.col("_rate") * (place + 1) + F.col("_offset")) - F.floor(F.col("_rate") * place + F.col("_offset"))
    return found.withColumn("copies", copies).select(*sized.columns, "source_size", "target", "copies")


def mark(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of docs."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return plan(sized, weights).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    k1, k2 = row_key()
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), k1.alias("_k1"), k2.alias("_k2"))
    return emit(docs, plan(sized, weights))
