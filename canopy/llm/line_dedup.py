"""Line dedup by a distributed suffix array over line-ID sequences.

Texts are split at LF. Lines that occur once separate; the others form sequences of line IDs, one or more a document.
Ranks of the suffixes by their first 1, 2, 4, ... lines come from prefix doubling: a suffix is sorted by its rank and
the rank of the suffix 2^k lines on, every round being a range-partitioned sort whose rank offsets are
summed up over partitions. The last of these sorts is the suffix array, cut at the greatest depth that counts. The longest-common-prefix interval of depth d around a suffix, all suffixes that share its first d
lines, is the set with the same two ranks at 2^k <= d < 2^(k+1), at its start and d - 2^k lines on.

A line is deleted if it lies in a run of consecutive lines with at least ``MIN_WORDS`` words that occurs earlier (by doc_id, then line). Any such run, maximal ones too, is covered
by the shortest runs of so many words that start with one of its lines or end with one of them and lie within it, so only the intervals of these depths matter: in each the
earliest occurrence stays, and the lines of all later ones are deleted; consecutive occurrences with one offset to
their first copy are one run. Doubling stops when the deepest of these depths is reached.

Hot lines and passages: all rankings are sorts with the position as last key, so equal keys spread over partitions;
counts combine on the map side; and rows learn about their group by ``common.lookup``.

Defined cases: a null text has no lines and stays null; rows that repeat a doc_id and text are one document and give equal rows;
null ids come last, ids of any type are in their order; a run within one document counts too; an empty table gives an empty result. Lines are equal when two 64-bit hashes of them are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.common import lookup, numbered, row_key, shared_table, shielded, word_count

MIN_WORDS = 50
_LINE_BITS = 31


def _numbered(batches, keys: list[str]):
    """Adds to sorted rows: the partition, the row's number in it and that of the first row with the same keys."""
    part, n, run, last = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        values = np.stack([np.asarray(batch.column(k)) for k in keys])
        new = np.ones(rows, bool)
        new[1:] = (values[:, 1:] != values[:, :-1]).any(axis=0)
        new[0] = last is None or bool((values[:, 0] != last).any())
        runs = np.maximum.accumulate(np.where(new, np.arange(n, n + rows), run))
        columns = [*batch.columns, pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(n, n + rows)), pa.array(runs)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_at", "_run"])
        n, run, last = n + rows, int(runs[-1]), values[:, -1]


def ranked(rows: DataFrame, keys: list[str], ties: list[str], name: str) -> DataFrame:
    """Stored table: rows plus column ``name``, the number of rows with smaller keys (longs). Ties spread equal keys over partitions."""
    ordered = rows.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys, *ties)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    stored = shared_table(ordered.mapInArrow(lambda b: _numbered(b, keys), f"{fields}, _part int, _at long, _run long"), "ranked")
    key = F.struct(*keys)
    parts = stored.groupBy("_part").agg(F.count("*").alias("n"), F.max("_run").alias("run"), F.min_by(key, "_at").alias("first"), F.max_by(key, "_at").alias("last"))
    found = sorted(parts.collect(), key=lambda r: r["_part"])  # one row for each partition
    size = found[-1]["_part"] + 1 if found else 1
    offset, carried, before, at, last_rank = [0] * size, [0] * size, None, 0, 0
    for r in found:
        offset[r["_part"]] = at
        carried[r["_part"]] = last_rank if r["first"] == before else at
        last_rank = at + r["run"] if r["run"] else carried[r["_part"]]
        at, before = at + r["n"], r["last"]
    pick = lambda values: F.from_json(F.lit(str(values)), "array<bigint>")[F.col("_part")]
    rank = F.when(F.col("_run") == 0, pick(carried)).otherwise(pick(offset) + F.col("_run"))
    return stored.select(*rows.columns, rank.alias(name))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, _k1, _k2, line, h1, h2, words) of the lines that occur more than once; line counts from 0."""
    k1, k2 = row_key()
    lines = docs.select("doc_id", k1.alias("_k1"), k2.alias("_k2"), F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    lines = lines.select("doc_id", "_k1", "_k2", "line", F.xxhash64("content").alias("h1"), F.xxhash64(F.lit("line"), "content").alias("h2"), word_count(F.col("content")).alias("words"))
    lines = shared_table(lines, "lines")
    often = shared_table(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    found = lookup(lines, often, ["h1", "h2"], "n", lines.count(), [F.col("_k1"), F.col("line")])
    return shared_table(found.where("n IS NOT NULL").select(*lines.columns).dropDuplicates(["_k1", "_k2", "line"]), "candidates")


def sequences(lines: DataFrame, min_words: int) -> DataFrame:
    """Stored (d, line, h1, h2, left, need, back): the documents numbered in order, the lines to the end of the sequence, and the depths that count, of the shortest runs of enough words that start or end with the line (null: none)."""
    docs = lines.groupBy("_k1", "_k2").agg(F.min("doc_id").alias("doc_id"))
    docs = numbered(docs.withColumn("_null", F.col("doc_id").isNull()), ["_null", "doc_id", "_k1", "_k2"], "d").select("_k1", "_k2", "d")
    doc = Window.partitionBy("_k1", "_k2")
    rows = lines.withColumn("g", F.col("line") - F.row_number().over(doc.orderBy("line")))
    run = Window.partitionBy("_k1", "_k2", "g")
    rows = rows.withColumn("upto", F.sum("words").over(run.orderBy("line"))).withColumn("left", F.max("line").over(run) - F.col("line") + 1)
    # Lines and wanted totals in one order: the last line seen is the first, or last, that reaches the total.
    kinds = [
        ("need", F.col("upto"), F.col("upto") - F.col("words") + min_words, run.orderBy(F.col("key").desc(), F.col("mark").desc(), F.col("line").desc())),
        ("back", F.col("upto") - F.col("words"), F.col("upto") - min_words, run.orderBy(F.col("key"), F.col("mark").desc(), F.col("line"))),
    ]
    for name, reached, wanted, order in kinds:
        both = F.array(F.struct(reached.alias("key"), F.lit(True).alias("mark")), F.struct(wanted.alias("key"), F.lit(False).alias("mark")))
        found = F.last(F.when(F.col("mark"), F.col("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.select("*", F.inline(both)).withColumn("found", found).where(~F.col("mark"))
        # A depth below one can't be: a total is reached by the line itself at the earliest.
        depth = F.col("found") - F.col("line") if name == "need" else F.col("line") - F.col("found")
        rows = rows.withColumn(name, F.when(F.col("found").isNotNull(), F.greatest(depth + 1, F.lit(1)))).drop("found", "key", "mark")
    return shared_table(rows.join(docs, ["_k1", "_k2"]).select("d", "line", "_k1", "_k2", "h1", "h2", "left", "need", "back"), "sequences")


def suffix_ranks(rows: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """rows with the ranks r0, r1, ... of each suffix by its first 1, 2, 4, ... lines, up to the given depth."""
    rows, level = ranked(rows, ["h1", "h2"], ["d", "line"], "r0").drop("h1", "h2"), 0
    while 2 << level <= depth:
        step = 1 << level
        ahead = F.lead(f"r{level}", step).over(Window.partitionBy("d").orderBy("line"))
        rows = rows.withColumn("_next", F.when(F.col("left") > step, ahead).otherwise(-1).cast("long"))
        rows = ranked(rows, [f"r{level}", "_next"], ["d", "line"], f"r{level + 1}").drop("_next")
        level += 1
    return rows, level


def later_copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame | None:
    """(_k1, _k2, line, need, offset) of every start of a later occurrence; offset is the distance to the first."""
    depth = rows.agg(F.max(F.greatest("need", "back"))).first()[0]
    if depth is None:
        return None
    ranks, levels = suffix_ranks(rows, depth)
    level = F.length(F.bin(F.col("need").cast("long"))) - 1
    every = F.array(*[F.col(f"r{i}") for i in range(levels + 1)])
    at = ["d", "line", "_k1", "_k2"]
    runs = ranks.where("need IS NOT NULL").select(*at, "need", every.alias("here"))
    ends = ranks.where("back IS NOT NULL").select("d", (F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("need"))
    # A run that ends with a line and is not the shortest that starts with its first one is looked at as well.
    first = ranks.select(*at, F.col("need").alias("own"), every.alias("here"))
    runs = runs.unionByName(ends.join(first, ["d", "line"]).where("need > own").drop("own"))
    starts = runs.select(*at, "need", level.alias("k"), F.col("here")[level].alias("a"))
    starts = starts.withColumn("other", F.col("line") + F.col("need") - F.call_function("shiftleft", F.lit(1), F.col("k")))
    ends = ranks.select("d", F.col("line").alias("other"), every.alias("ranks"))
    place = F.call_function("shiftleft", F.col("d"), F.lit(_LINE_BITS)) + F.col("line")
    starts = starts.join(ends, ["d", "other"]).select("_k1", "_k2", "line", "need", "a", F.col("ranks")[F.col("k")].alias("b"), place.alias("place"))
    starts = shared_table(starts, "starts")
    intervals = starts.groupBy("need", "a", "b").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = lookup(starts, shared_table(intervals, "intervals"), ["need", "a", "b"], "n", starts.count(), [F.col("place")])
    return shared_table(found.where("place <> first").select("_k1", "_k2", "line", "need", (F.col("place") - F.col("first")).alias("offset")), "later")


def maximal_runs(later: DataFrame) -> DataFrame:
    """(_k1, _k2, start, end): occurrences with one offset on consecutive lines are one run; ends are inclusive."""
    near = Window.partitionBy("_k1", "_k2", "offset").orderBy("line")
    rows = later.groupBy("_k1", "_k2", "line", "offset").agg(F.max("need").alias("need"))
    rows = rows.withColumn("g", F.col("line") - F.row_number().over(near))
    return rows.groupBy("_k1", "_k2", "offset", "g").agg(F.min("line").alias("start"), F.max(F.col("line") + F.col("need") - 1).alias("end")).drop("offset", "g")


def _merged(runs: Column) -> Column:
    """Sorted (start, end) structs with those that overlap or touch made one."""
    grow = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] + 1 >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(runs), F.expr("cast(array() as array<struct<start:int,end:int>>)"), grow)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text freed of later copies, and n_lines, n_deleted and deleted (runs as start:end from 0, inclusive, comma-joined)."""
    return shielded(docs, ["doc_id", "text"], lambda d: _dedup(d, min_words))


def _dedup(docs: DataFrame, min_words: int) -> DataFrame:
    later = later_copies(sequences(repeated_lines(docs.select("doc_id", "text")), min_words), min_words)
    lines = F.split("text", "\n", -1)
    if later is None:
        n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        return docs.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"), "n_deleted": F.lit(0).cast("long"), "deleted": F.lit("")})
    runs = maximal_runs(later).groupBy("_k1", "_k2").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("runs"))
    runs = shared_table(runs.select("_k1", "_k2", _merged(F.col("runs")).alias("_runs")), "runs")
    k1, k2 = row_key()
    # The runs grow with the corpus, so their join shuffles at any size rather than turn from a broadcast into a shuffle.
    found = docs.withColumns({"_k1": k1, "_k2": k2}).join(runs.hint("merge"), ["_k1", "_k2"], "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    found = found.withColumn("_runs", F.coalesce("_runs", none)).withColumn("_lines", F.coalesce(lines, F.expr("cast(array() as array<string>)")))
    gone = F.aggregate("_runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"] + 1)
    # What stays lies between one run's end and the next one's start.
    ends = F.concat(F.array(F.lit(-1)), F.transform("_runs", lambda r: r["end"]))
    begins = F.concat(F.transform("_runs", lambda r: r["start"]), F.array(F.size("_lines")))
    kept = F.flatten(F.zip_with(ends, begins, lambda e, b: F.slice("_lines", e + 2, F.greatest(b - e - 1, F.lit(0)))))
    text = F.when(F.size("_runs") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    said = F.array_join(F.transform("_runs", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    own = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return found.select(*own, F.size("_lines").cast("long").alias("n_lines"), gone.alias("n_deleted"), said.alias("deleted"))
