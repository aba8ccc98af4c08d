"""Near dedup by SimHash and exact Jaccard similarity of word shingles.

A text is the set of its ``SHINGLE_WORDS``-word shingles. In order of doc_id a text stays unless one that stays has a similarity of
at least 0.8 to it, so every dropped text has a near copy among the kept ones and no two kept texts are near copies.

The first candidates are those of the SimHash operator (``simhash.classes``: ball hashing and components) on ``SHINGLE_WORDS``-word fingerprints: every text against the lowest of its component.
Near copies can differ in more bits than any ball holds, so a second search finds the rest, and every candidate of either is checked by its exact similarity.

The second search cannot miss a pair: two sets of that similarity share at least four fifths of either, so under any one order of all shingles they share
one of the first n - ceil(0.8 n) + 1 of each (the prefix). The order puts shingles that are common in a sample of the texts last; the sample
decides what the search costs, never what it finds. Texts with a prefix shingle in common form a bucket. The first shingle two texts share has all others they share behind
it, so they meet there only if neither place leaves too few; texts that differ too much, such as the outer ones of a large group of copies, hold their own rare shingles first and do not meet at the group's.
Rows that can meet nobody in their bucket leave it. In each round the lowest texts of a bucket, its heads,
meet all others of it, which is linear in the bucket; texts that are heads wherever they are can be decided, the rest go on with twice as many heads until none is undecided.
Pairs are thinned by two bounds that no near copy exceeds, on the sizes and on the bits in which parity sketches (two bits a shingle or more) differ, then verified
by counting equal shingles, those that SimHash links and those with the lowest candidate of a text first; what they settle needs no other check.

Shingles that are hot in the sample are dealt over ``DEALS`` tasks, and their heads found among those of the tasks; texts in many pairs are
copied to as many tasks as their pairs are dealt to. Nothing is broadcast or collected but a filter of bounded size.

Defined cases: words and short texts as for SimHash; texts without words are equal to each other; equal sets are one class, never expanded into pairs; null ids come last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm import simhash
from canopy.llm.common import emit, lookup, row_key, shared_table

SHINGLE_WORDS, SEED = 5, 42
#: Texts of a bucket that meet all others of it in the first round.
HEADS = 8
#: Texts and shingles behind the order of shingles; they bear on cost only.
SAMPLE_TEXTS, COMMON_SHINGLES = 10_000, 50_000
#: A shingle in more than one of HOT texts of the sample is dealt over DEALS tasks.
HOT, DEALS = 200, 32
#: Words whose hashes a worker keeps, and the most bits of the filter of wanted texts (beyond, it only lets more texts pass).
CACHED_WORDS, FILTER_BITS = 50_000, 1 << 26
FACTOR, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_hashes = _Hashes()


def shingles(text: bytes | None, words_in_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of one text's shingles (UTF-8), each made of the hashes of its words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > CACHED_WORDS:
        _hashes.clear()
    hashed = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    length = min(words_in_shingle, len(words))
    n = len(words) - length + 1
    out = np.full(n, length, np.uint64)
    for k in range(length):
        out = out * FACTOR + hashed[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * MIXER
    return np.unique(out ^ (out >> np.uint64(29)))


def sketch(own: np.ndarray) -> bytes:
    """Parity of the number of shingles at each of a power of two of places, two a shingle or more."""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_near(a: bytes, b: bytes, an: int, bn: int) -> bool:
    """False only for sets that differ in more shingles than near copies do: no more bits differ than shingles. The longer sketch is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * 9 <= an + bn


def _bytes(x) -> bytes | None:
    return x.as_buffer().to_pybytes() if x.is_valid else None


def _lists(parts: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([*parts, np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(values))


def shingle_column(text: Column) -> Column:
    """The shingles of whole texts as arrays of signed longs."""

    @F.arrow_udf("array<bigint>")
    def hashed(texts: pa.Array) -> pa.Array:
        return _lists([shingles(_bytes(x)).view(np.int64) for x in texts])

    return hashed(text)


def described(text: Column, common: np.ndarray, counts: np.ndarray, hot_at: int) -> Column:
    """Of whole texts: a 128-bit key of the set, its size, parity sketch, SimHash fingerprint and prefix, apart from it the shingles of the prefix with ``hot_at`` counts or more. ``common`` is sorted; shingles outside count as rarest."""

    @F.arrow_udf("struct<s1: bigint, s2: bigint, n: int, sketch: binary, fp: bigint, prefix: array<bigint>, hot: array<bigint>>")
    def told(texts: pa.Array) -> pa.Array:
        keys, sizes, sketches, prints, prefixes, hots = [], [], [], [], [], []
        for x in texts:
            own = shingles(text := _bytes(x))
            prints.append(simhash.fingerprint(text, SHINGLE_WORDS))
            keys.append(np.frombuffer(xxhash.xxh128_digest(own.tobytes(), SEED), np.int64))
            sizes.append(len(own))
            sketches.append(sketch(own))
            often = np.zeros(len(own), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                often = np.where(common[at] == own, counts[at], 0)
            first = np.argsort(often, kind="stable")[: len(own) - (4 * len(own) + 4) // 5 + 1]
            hot = often[first] >= hot_at
            prefixes.append(own[first[~hot]].view(np.int64))
            hots.append(own[first[hot]].view(np.int64))
        keys = np.array(keys, np.int64).reshape(-1, 2)
        columns = [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), _lists(prefixes), _lists(hots)]
        return pa.StructArray.from_arrays(columns, names=["s1", "s2", "n", "sketch", "fp", "prefix", "hot"])

    return told(text)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles found in more than one text of a sample, sorted, and in how many; and the count from which one is hot."""
    share = max(1, docs.count() // SAMPLE_TEXTS)
    some = docs.where(F.pmod(row_key()[0], F.lit(share)) == 0).select("text")
    counted = some.select(F.explode(shingle_column(F.col("text"))).alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    found = counted.orderBy(F.col("n").desc(), "s").limit(COMMON_SHINGLES).toArrow()
    values, counts = np.asarray(found["s"]).astype(np.int64).view(np.uint64), np.asarray(found["n"]).astype(np.int64)
    order = np.argsort(values)
    return values[order], counts[order], max(2, SAMPLE_TEXTS // HOT)


def linked_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored pairs (a < b): each set that SimHash links to others, with the lowest of its component."""
    prints = rows.select("row", "fp").join(sets.select("row", "id"), "row").select(F.col("id").alias("doc_id"), "fp")
    prints = shared_table(prints, "prints")
    found = lookup(prints, simhash.classes(prints), ["fp"], "n", prints.count(), [F.col("doc_id")]).where("component_id < doc_id")
    return shared_table(found.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")), "linked")


# --- buckets ---------------------------------------------------------------------------------------------------------

PAIR, CARRIED, HOT_ROW = 0, 1, 2
MET = "kind tinyint, s long, a long, b long, n int, reach int"


def _reach(n: Column, place: Column) -> Column:
    """The size of the largest set that can be a near copy of one of n shingles if the first they share is at this place (from 0) of it: 9 (n - place) >= 4 (n + reach)."""
    return F.floor((n * 5 - place * 9) / 4).cast("int")


def _idle(s: np.ndarray, n: np.ndarray, reach: np.ndarray, begun: bool) -> np.ndarray:
    """Rows (sorted by s) that can meet nobody: the shorter of a pair reaches its own size, and no such row of the bucket lies within their reach.
    The last bucket, and the first if it had begun before, may be incomplete and keep all rows."""
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    bucket, first = np.cumsum(new) - 1, np.flatnonzero(new)
    shorter = reach >= n
    low = np.minimum.reduceat(np.where(shorter, n, np.iinfo(np.int64).max), first)
    high = np.maximum.reduceat(np.where(shorter, reach, -1), first)
    whole = np.ones(len(first), bool)
    whole[-1] = False
    whole[0] &= not begun
    return whole[bucket] & ~shorter & ((low[bucket] > reach) | (high[bucket] < n))


def _met(batches, heads: int):
    """Meetings in rows (s, id, n, reach, hot) sorted by s and id: pairs (a < b) of a head and a later row of its bucket within reach of each other; all rows of buckets
    with more rows than heads, to be carried on (a: whether the row is no head); and hot rows as they are (a: the number of rows before)."""
    last, before, held_id, held_n, held_reach = None, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        s, ids, n, reach = (np.asarray(batch.column(c)).astype(np.int64) for c in ("s", "id", "n", "reach"))
        hot = np.asarray(batch.column("hot")).astype(bool)
        live = hot | ~_idle(s, n, reach, last is not None and s[0] == last)
        s, ids, n, reach, hot = (x[live] for x in (s, ids, n, reach, hot))
        rows = len(s)
        new = np.ones(rows, bool)
        new[1:] = s[1:] != s[:-1]
        new[0] = last is None or s[0] != last
        at = np.arange(rows)
        start = np.maximum.accumulate(np.where(new, at, -1))
        going = start < 0  # the bucket began in an earlier batch
        place = np.where(going, at + before, at - start)
        all_id, all_n, all_reach = (np.concatenate(x) for x in ((held_id, ids), (held_n, n), (held_reach, reach)))
        first = np.where(going, 0, start + len(held_id))  # of the row's bucket, in all_id
        out = [(np.full(hot.sum(), HOT_ROW), s[hot], place[hot], ids[hot], n[hot], reach[hot])]
        for j in range(min(heads, int(place.max()))):
            i = np.flatnonzero((place > j) & ~hot)
            h = first[i] + j
            near = (n[i] <= all_reach[h]) & (all_n[h] <= reach[i])
            i, h = i[near], h[near]
            out.append((np.full(len(i), PAIR), np.zeros(len(i), np.int64), all_id[h], ids[i], n[i], reach[i]))
        over = np.flatnonzero((place >= heads) & ~hot)
        out.append((np.full(len(over), CARRIED), s[over], np.ones(len(over), np.int64), ids[over], n[over], reach[over]))
        for j in range(heads):
            i = over[place[over] == heads]
            h = first[i] + j
            out.append((np.full(len(i), CARRIED), s[i], np.zeros(len(i), np.int64), all_id[h], all_n[h], all_reach[h]))
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int8, np.int64, np.int64, np.int64, np.int32, np.int32))], names=["kind", "s", "a", "b", "n", "reach"])
        last, f = s[-1], int(first[-1])
        before = int(place[-1]) + 1
        held_id, held_n, held_reach = (x[f:][:heads].copy() for x in (all_id, all_n, all_reach))


def _meet(members: DataFrame, heads: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of members (s, id, n, reach, hot): the distinct pairs met (a, b); the members to carry on; and the ids (id) that are no heads somewhere."""
    dealt = members.repartition("s", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(DEALS))).otherwise(0)).sortWithinPartitions("s", "id")
    met = shared_table(dealt.mapInArrow(lambda b: _met(b, heads), MET), "met")
    pairs = met.where(F.col("kind") == PAIR).select("a", "b")
    carried = met.where(F.col("kind") == CARRIED).select("s", F.col("b").alias("id"), "n", "reach", F.lit(False).alias("hot"), (F.col("a") == 1).alias("later"))
    rows = met.where(F.col("kind") == HOT_ROW)
    if not rows.isEmpty():
        rows = rows.withColumn("deal", F.pmod(F.xxhash64("b"), F.lit(DEALS)))
        # No more than ``heads`` rows of each task can be among the heads of a bucket.
        lists = F.slice(F.sort_array(F.collect_list(F.when(F.col("a") < heads, F.struct("b", "n", "reach")))), 1, heads)
        shorter = F.col("reach") >= F.col("n")
        lists = rows.groupBy("s").agg(lists.alias("heads"), F.min(F.when(shorter, F.col("n"))).alias("low"), F.max(F.when(shorter, F.col("reach"))).alias("high"))
        lists = lists.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
        rows = shared_table(rows.select("s", F.col("b").alias("id"), "n", "reach", "deal").join(lists.hint("merge"), ["s", "deal"]), "hot")
        met_by = F.filter("heads", lambda h: (h["b"] < F.col("id")) & (F.col("n") <= h["reach"]) & (h["n"] <= F.col("reach")))
        found = rows.select("id", F.explode(met_by).alias("h"))
        pairs = pairs.unionByName(found.select(F.col("h.b").alias("a"), F.col("id").alias("b")))
        later = F.col("id") > F.element_at("heads", -1)["b"]
        live = shorter | F.coalesce((F.col("low") <= F.col("reach")) & (F.col("high") >= F.col("n")), F.lit(False))
        carried = carried.unionByName(rows.where(live & (F.size("heads") == heads)).select("s", "id", "n", "reach", F.lit(True).alias("hot"), later.alias("later")))
    carried = shared_table(carried, "carried")
    return shared_table(pairs.distinct(), "pairs"), carried.drop("later"), shared_table(carried.where("later").select("id").distinct(), "later")


# --- verification ----------------------------------------------------------------------------------------------------


def _with_both(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with columns of the sets on either side, as ax, bx, ... Pairs are dealt by their other side, and a set goes once to each task that has pairs of it."""
    for side, other in (("a", "b"), ("b", "a")):
        pairs = pairs.withColumn("_deal", F.pmod(F.xxhash64(other), F.lit(DEALS)))
        own = sets.select(F.col("id").alias(side), *[F.col(c).alias(side + c) for c in columns])
        copies = pairs.select(side, "_deal").distinct().join(own.hint("shuffle_hash"), side)
        pairs = pairs.join(copies.hint("merge"), [side, "_deal"]).drop("_deal")
    return pairs


def _thinned(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Stored pairs without those whose sketches differ too much for near copies."""

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array, an: pa.Array, bn: pa.Array) -> pa.Array:
        return pa.array([may_be_near(_bytes(x), _bytes(y), n, m) for x, y, n, m in zip(a, b, an.to_pylist(), bn.to_pylist())], pa.bool_())

    found = _with_both(pairs, sketches, ["n", "sketch"])
    return shared_table(found.where(near(F.col("asketch"), F.col("bsketch"), F.col("an"), F.col("bn"))).select("a", "b"), "thinned")


def _near(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Stored pairs whose similarity is 0.8 or more."""
    found = _with_both(pairs, arrays, ["x"])
    both = F.size(F.array_intersect("ax", "bx"))
    return shared_table(found.where(both * 9 >= (F.size("ax") + F.size("bx")) * 4).select("a", "b"), "near")


def _arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored (id, x) of the wanted sets (id, _k1, _k2), x being their shingles. A bit filter of their keys spares most other texts the hashing and all of them the shuffle."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.col("_k1"), F.lit(bits))
    words = wanted.groupBy(F.floor(place / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("v")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[np.asarray(words["w"]).astype(np.int64)] = np.asarray(words["v"]).astype(np.int64)
    held = held.view(np.uint64)

    @F.arrow_udf("array<bigint>")
    def listed(keys: pa.Array, texts: pa.Array) -> pa.Array:
        at = np.mod(np.asarray(keys).astype(np.int64), bits).astype(np.uint64)
        passed = (held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        return _some(texts, passed.astype(bool))

    k1, k2 = row_key()
    # Not deterministic to the optimizer, which else would evaluate it in the filter and once more after it, in a second Python worker.
    x = listed.asNondeterministic()(F.col("_k1"), F.col("text"))
    found = docs.select(k1.alias("_k1"), k2.alias("_k2"), "text").withColumn("x", x).drop("text").where("x IS NOT NULL")
    return shared_table(wanted.join(found.hint("merge"), ["_k1", "_k2"]).select("id", "x").dropDuplicates(["id"]), "shingles")


def _some(texts: pa.Array, passed: np.ndarray) -> pa.Array:
    """The shingles of the texts that passed, null for the others."""
    parts = [shingles(_bytes(x)).view(np.int64) if p else np.zeros(0, np.int64) for x, p in zip(texts, passed)]
    offsets = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32(), mask=np.concatenate((~passed, [False])))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


# --- decisions -------------------------------------------------------------------------------------------------------


def _gone(edges: DataFrame, blocked: DataFrame, later: DataFrame) -> DataFrame:
    """Stored (id): what has a near copy below it that stays, one that is a head everywhere and has no candidate below it left."""
    free = edges.select("a").distinct().join(blocked.select(F.col("b").alias("a")), "a", "left_anti").join(later.select(F.col("id").alias("a")), "a", "left_anti")
    return shared_table(edges.join(free, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "gone")


def _without(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(gone.select(F.col("id").alias(side)), side, "left_anti")
    return pairs.select("a", "b")


def _decided(docs: DataFrame, sets: DataFrame, candidates: DataFrame, linked: DataFrame | None, edges: DataFrame, later: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) between near copies that can't be decided yet, and tables (id) of the sets that go. linked are candidates to check first, edges come from the round before."""
    dropped: list[DataFrame] = []
    if not candidates.isEmpty():
        ids = candidates.select(F.col("a").alias("id")).unionByName(candidates.select(F.col("b").alias("id"))).distinct()
        arrays = _arrays(docs, shared_table(sets.join(ids, "id", "left_semi").select("id", "_k1", "_k2"), "wanted"))
        first = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        if linked is not None:
            first = shared_table(first.unionByName(candidates.join(linked, ["a", "b"], "left_semi")).distinct(), "first")
        dropped.append(_gone(_near(first, arrays), candidates.unionByName(edges), later))
        rest = shared_table(_without(candidates, dropped[0]), "rest")
        found = _near(rest, arrays) if not rest.isEmpty() else rest
        edges = shared_table(_without(edges, dropped[0]).unionByName(found).distinct(), "edges")
    while not edges.isEmpty():
        gone = _gone(edges, edges, later)
        if gone.isEmpty():
            break
        dropped.append(gone)
        edges = shared_table(_without(edges, gone), "edges")
    return edges, dropped


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_copies(docs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Table (id) of the sets that go, None where there are none."""
    spread = lambda name, hot: (F.posexplode(name).alias("place", "s"), F.lit(hot).alias("hot"))
    listed = rows.select("row", "n", "prefix", "hot").join(sets.select("row", "id").hint("merge"), "row")
    # Hot shingles are the last ones of a prefix.
    members = listed.select("id", "n", F.lit(0).alias("before"), *spread("prefix", False)).unionByName(listed.select("id", "n", F.size("prefix").alias("before"), *spread("hot", True)))
    members = members.select("s", "id", "n", _reach(F.col("n"), F.col("before") + F.col("place")).alias("reach"), "hot")
    sketches = rows.select("row", "n", "sketch").join(sets.select("row", "id"), "row").select("id", "n", "sketch")
    linked = linked_pairs(rows, sets)
    edges, heads, dropped = None, HEADS, []
    while True:
        pairs, carried, later = _meet(members, heads)
        if edges is None:
            edges = pairs.where("false")
            pairs = shared_table(pairs.unionByName(linked).distinct(), "pairs")
        candidates = _thinned(pairs, sketches) if not pairs.isEmpty() else pairs
        edges, gone = _decided(docs, sets, candidates, linked, edges, later)
        dropped += gone
        linked = None
        if carried.isEmpty():
            return _union(dropped) if dropped else None
        going = later.unionByName(edges.select(F.col("a").alias("id"))).unionByName(edges.select(F.col("b").alias("id"))).distinct()
        going = going.join(_union(gone), "id", "left_anti") if gone else going
        members, heads = shared_table(carried.join(going, "id", "left_semi"), "members"), 2 * heads


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the texts that have a similarity of 0.8 or more to a kept one of smaller doc_id. Of equal sets the first row stays."""
    k1, k2 = row_key()
    common, counts, hot_at = common_shingles(docs)
    rows = docs.select("doc_id", k1.alias("_k1"), k2.alias("_k2"), described(F.col("text"), common, counts, hot_at).alias("told"))
    rows = shared_table(rows.select("doc_id", "_k1", "_k2", "told.*", F.monotonically_increasing_id().alias("row")), "described")
    order = [F.col("doc_id").isNull().alias("null"), "doc_id", "_k1", "_k2", "row"]
    sets = rows.groupBy("s1", "s2").agg(F.min(F.struct(*order)).alias("f")).select("f.*")
    order = ["null", "doc_id", "_k1", "_k2", "row"]
    # Ids that rise along the range partitions and within each.
    sets = sets.repartitionByRange(*order).sortWithinPartitions(*order).select("_k1", "_k2", "row", F.monotonically_increasing_id().alias("id"))
    sets = shared_table(sets, "sets")
    dropped = near_copies(docs, rows, sets)
    kept = sets.join(dropped, "id", "left_anti") if dropped is not None else sets
    marked = rows.select("_k1", "_k2").join(kept.select("_k1", "_k2"), ["_k1", "_k2"])
    # Repeated rows share a key and their one copy.
    nth = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1")) == 1
    return emit(docs, marked.withColumn("copies", F.when(nth, 1).otherwise(0)))
