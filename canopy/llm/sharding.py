"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed by their text into ``SLOTS`` slots, so equal texts share a slot. Rows and bytes are aggregated per slot, and the slots are
placed on shards by size, largest first, each on the shard that holds the fewest bytes. A slot that alone would fill more than half of a shard's fair share (of 8 shards: more than a sixteenth of all bytes) is
hashed once more, by doc_id, into that many ``parts``, as a group of copies can be any size; only there equal texts may lie in different shards. The map (version, slot, part, shard) is a
small stored table, from which every assignment is read; ``rebalance`` edits it for new sizes or another number of shards, moving as few slots as
it can, and gives the next version. The law is ``bytes``: shards are near equal in size.

Within a shard the records are numbered without gaps from 0: all records are numbered by one range-partitioned sort by shard, slot and part, which splits any slot, less the first number of
their shard. All steps on records are DataFrame functions; the driver only sees the slot table, whose size is fixed.

Defined cases: a null text has size 1 and the checksum of an empty text; records without an id are dealt to the parts of a split slot in turn; repeated rows are placed alike and
numbered apart; an empty table gives an empty result; further columns are carried through, and one with the name of a result column gives way to it.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import literal_table, numbered, shared_dir

SLOTS, SHARDS = 4096, 8
MAP_SCHEMA = "version int, slot int, part int, shard int"

Place = dict[tuple[int, int], int]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _size, _crc and _slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_size": F.octet_length(text).cast("long") + 1, "_crc": F.crc32(text), "_slot": F.pmod(F.xxhash64(text), F.lit(SLOTS)).cast("int")})


def slot_sizes(docs: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes by slot; at most SLOTS entries."""
    found = keyed(docs).groupBy("_slot").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes")).collect()
    return {r["_slot"]: (r["n"], r["bytes"]) for r in found}


def parts_of(sizes: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """Into how many parts each slot is split: one, unless it exceeds half of a shard's fair share."""
    bound = max(1, sum(b for _, b in sizes.values()) // (2 * shards))
    return {s: -(-sizes[s][1] // bound) if s in sizes and sizes[s][1] > bound else 1 for s in range(SLOTS)}


def _weights(sizes: dict[int, tuple[int, int]], parts: dict[int, int]) -> dict[tuple[int, int], float]:
    return {(s, p): sizes.get(s, (0, 0))[1] / n for s, n in parts.items() for p in range(n)}


def place(sizes: dict[int, tuple[int, int]], shards: int) -> Place:
    """A first map: parts by size, largest first, each to the smallest shard."""
    return _fill({}, _weights(sizes, parts_of(sizes, shards)), shards)


def _fill(kept: Place, weights: dict[tuple[int, int], float], shards: int) -> Place:
    held = [0.0] * shards
    for key, shard in kept.items():
        held[shard] += weights[key]
    heap = [(b, i) for i, b in enumerate(held)]
    heapq.heapify(heap)
    out = dict(kept)
    for key in sorted(weights.keys() - kept.keys(), key=lambda k: (-weights[k], k)):
        bytes_held, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (bytes_held + weights[key], shard))
    return out


def rebalance(old: Place, sizes: dict[int, tuple[int, int]], shards: int) -> Place:
    """The map edited for new sizes and number of shards: shards over their fair share give up their smallest parts until they fit; only these and parts without a shard move."""
    weights = _weights(sizes, parts_of(sizes, shards))
    fair = sum(weights.values()) / shards
    kept: Place = {}
    held = [0.0] * shards
    for key in sorted(weights, key=lambda k: (-weights[k], k)):
        shard = old.get(key, shards)
        if shard < shards and held[shard] + weights[key] <= fair:
            kept[key] = shard
            held[shard] += weights[key]
    return _fill(kept, weights, shards)


def map_table(spark: SparkSession, placed: Place, version: int = 1) -> DataFrame:
    """The map as a table, to be stored and versioned."""
    rows = [(version, slot, part, shard) for (slot, part), shard in sorted(placed.items())]
    return literal_table(spark, rows, "version int, slot int, part int, shard int")


def save_map(spark: SparkSession, placed: Place, path: str, version: int) -> None:
    """Appends a version to the stored map."""
    map_table(spark, placed, version).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, Place]:
    """A version of the stored map, the latest by default."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = version if version is not None else stored.agg(F.max("version")).first()[0]
    return version, {(r["slot"], r["part"]): r["shard"] for r in stored.where(F.col("version") == version).collect()}


def current_map(spark: SparkSession, sizes: dict[int, tuple[int, int]], shards: int, path: str) -> tuple[int, Place]:
    """The stored map that holds for these sizes: the latest version at path if it fits, else the next version, edited from it; the first one where there is none."""
    try:
        version, old = load_map(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        save_map(spark, place(sizes, shards), path, 1)
        return load_map(spark, path)
    new = rebalance(old, sizes, shards)
    if new != old:
        save_map(spark, new, path, version + 1)
    return load_map(spark, path)


def _ints(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<int>")


RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot")


def assign(docs: DataFrame, shards: int = SHARDS, map_path: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot (the number within the shard), grown_shard (null) and virtual_slot, under the map stored at map_path (by default a new one)."""
    spark = docs.sparkSession
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    carried = [c for c in docs.columns if c != "doc_id" and c.lower() not in RESULT and (keep_text or c != "text")]
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    rows = numbered(_placed(docs.select("doc_id", "text", rest.alias("_rest")), shards, path), ["_shard", "_slot", "_part", "_crc", "_size", "doc_id"], "_at")
    firsts = {r["_shard"]: r["first"] for r in rows.groupBy("_shard").agg(F.min("_at").alias("first")).collect()}  # one row for each shard
    start = F.from_json(F.lit(str([firsts.get(s, 0) for s in range(shards)])), "array<bigint>")[F.col("_shard")]
    own = [F.col("doc_id") if c == "doc_id" else F.col(f"_rest.c{carried.index(c)}").alias(c) for c in docs.columns if c == "doc_id" or c in carried]
    made = [F.col("_size"), F.col("_crc"), F.lit("bytes"), F.col("_shard"), F.col("_at") - start, F.lit(None).cast("int"), F.col("_slot")]
    return rows.select(*own, *[m.alias(name) for m, name in zip(made, RESULT, strict=True)])


def _placed(docs: DataFrame, shards: int, path: str) -> DataFrame:
    """docs (doc_id, text, _rest) with _size, _crc, _slot, _part and _shard in place of text."""
    _, placed = current_map(docs.sparkSession, slot_sizes(docs), shards, path)
    parts = [0] * SLOTS
    for s, _ in placed:
        parts[s] += 1
    firsts, flat = [0] * SLOTS, []
    for s in range(SLOTS):
        firsts[s] = len(flat)
        flat += [placed[s, p] for p in range(parts[s])]
    by_id = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id", F.lit("part")))
    rows = keyed(docs).withColumn("_part", F.pmod(by_id, _ints(parts)[F.col("_slot")]).cast("int")).drop("text")
    return rows.withColumn("_shard", _ints(flat)[_ints(firsts)[F.col("_slot")] + F.col("_part")])
