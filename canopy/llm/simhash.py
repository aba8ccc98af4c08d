"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits (an even number) share a variant within radius / 2 bits of
both. Every distinct fingerprint therefore emits all variants within that distance (65 for the default
radius 2), the variants are shuffled, and fingerprints that meet on one are candidates, verified by
counting their differing bits. At most C(64, <= radius / 2) distinct fingerprints can meet on one
variant, and any two that do differ in at most ``radius`` bits, so linking each to the smallest of them loses no
connection; equal fingerprints are one class and never expanded into pairs.

Defined cases: a null or blank text has no words and fingerprint zero, linked like any other; fewer words than
a shingle make one shingle; repeated shingles count as often as they occur; repeated rows share their class.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.common import emit, lookup, row_key, shared_table
from canopy.llm.graph import components

SHINGLE_WORDS, RADIUS, SEED = 3, 2, 42
#: Shingles whose hashes are summed at once: bounds the memory a very long text takes.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of one text (UTF-8)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - words_in_shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    stops = ends[len(words) - n :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist())
        hashes = np.array([digest(line[a:b], SEED) for a, b in pairs], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_column(text: Column, words_in_shingle: int = SHINGLE_WORDS) -> Column:
    """Fingerprints of whole texts as signed longs."""

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, words_in_shingle) for x in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return hashed(text)


def variant_masks(distance: int) -> list[int]:
    """Every signed 64-bit mask with at most ``distance`` bits set."""
    masks = [sum(1 << b for b in bits) for k in range(distance + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b) that connect all fingerprints (distinct, column fp) within the radius."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: half of it is spent on either side")
    masks = F.from_json(F.lit(str(variant_masks(radius // 2))), "array<bigint>")
    balls = prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    head = F.first("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = balls.withColumn("head", head).where("head <> fp")
    return met.where(F.bit_count(F.col("head").bitwiseXOR(F.col("fp"))) <= radius).select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct()


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Stored table (fp, n, component_id) of the fingerprints that have more than one row or a link."""
    counted = shared_table(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "prints")
    label = shared_table(components(links(counted.select("fp"), radius)).withColumnRenamed("node", "fp"), "labels")
    joined = counted.join(label, "fp", "left").where("n > 1 OR component IS NOT NULL")
    joined = shared_table(joined.withColumn("component", F.coalesce("component", "fp")), "members")
    heads = joined.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("uses"))
    found = lookup(joined, shared_table(heads, "heads"), ["component"], "uses", joined.count(), [F.col("fp")])
    return shared_table(found.select("fp", "n", "component_id"), "classes")


def mark(docs: DataFrame, radius: int = RADIUS, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, _k1, _k2, fp, component_id) for every row of docs; component_id is the smallest doc_id reachable."""
    k1, k2 = row_key()
    prints = docs.select("doc_id", k1.alias("_k1"), k2.alias("_k2"), fingerprint_column(F.col("text"), words_in_shingle).alias("fp"))
    prints = shared_table(prints, "fingerprints")
    found = lookup(prints, classes(prints, radius), ["fp"], "n", prints.count(), [F.col("_k1")])
    return found.select("doc_id", "_k1", "_k2", "fp", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id. Rows without a doc_id or linked to none that has one stay once per key."""
    marked = mark(docs, radius, words_in_shingle)
    kept = marked.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Repeated rows share a key and their one copy.
    first = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1")) == 1
    return emit(docs, kept.withColumn("copies", F.when(first, 1).otherwise(0)))
