"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Each benchmark item gives its windows of 13 consecutive words (an item of fewer words is one window). Windows of one length m
share three tables over blocks of two words: how far the search may jump when a block ends at the current
word (m - 1 if no window has the block), the windows that end with the block, and, within those, the first block.
Where the jump is zero, the windows of the bucket are compared with the document's words one by one.

The benchmark is read in blocks of at most about ``BLOCK_BYTES`` of text, so a matcher has a bounded size. With more than
one block the documents are read once for each, only hits are kept, and joined with the documents in the end. Whole texts are searched.

Defined cases: a null or wordless text has no words and no hits; an item without words has no window; items that repeat an
item_id count once; a null item_id is listed as an empty string; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import lookup, row_key, shared_table

WINDOW, BLOCK_WORDS, BLOCK_BYTES = 13, 2, 8 << 20
RESULT = "struct<spans: array<long>, items: array<string>>"

#: Bytes of words after lower-casing: ASCII letters and digits, and all beyond ASCII. Others become spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return (text or b"").translate(_TABLE).split()


class Matcher:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], length: int):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.default = length - self.block + 1
        self.jump: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[list[bytes], set[str]]]]] = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                self.jump[key] = min(self.jump.get(key, self.default), length - end)
            suffix, prefix = window[length - self.block :], window[: self.block]
            self.buckets.setdefault(suffix, {}).setdefault(prefix, []).append((list(window), items))

    def search(self, words: list[bytes]):
        """(start, items) of every occurrence of a window, in order."""
        length, block, default, jump, buckets = self.length, self.block, self.default, self.jump.get, self.buckets
        at, n = length, len(words)
        while at <= n:
            key = tuple(words[at - block : at])
            step = jump(key, default)
            if step:
                at += step
                continue
            start = at - length
            for window, items in buckets[key].get(tuple(words[start : start + block]), ()):
                if words[start:at] == window:
                    yield start, items
            at += 1


class Matchers:
    """All windows of a block of benchmark items, by length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            length = min(window, len(words))
            for i in range(len(words) - length + 1 if words else 0):
                by_length.setdefault(length, {}).setdefault(tuple(words[i : i + length]), set()).add(item)
        self.each = [Matcher(windows, length) for length, windows in sorted(by_length.items())]

    def scan(self, words: list[bytes]) -> tuple[list[int], list[str]]:
        """Merged spans (start, end, start, end, ...) and sorted item ids of the hits."""
        found: list[int] = []
        named: set[str] = set()
        for matcher in self.each:
            for start, hit in matcher.search(words):
                if found and found[-2] <= start <= found[-1]:  # matches of one length come in order
                    found[-1] = max(found[-1], start + matcher.length)
                else:
                    found += [start, start + matcher.length]
                named |= hit
        return merged([found]), sorted(named)


def merged(parts: list[list[int]]) -> list[int]:
    """The union of some spans, in order."""
    out: list[int] = []
    for start, end in sorted((p[i], p[i + 1]) for p in parts for i in range(0, len(p), 2)):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _hits(rows: list[tuple[list[int], list[str]]]) -> pa.Array:
    kinds = pa.list_(pa.int64()), pa.list_(pa.string())
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(2)], ["spans", "items"])


def _scanned(block: list[tuple[str, bytes]], window: int, text: Column) -> Column:
    built: list[Matchers] = []  # filled once in each Python worker

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(Matchers(block, window))
        return _hits([built[0].scan(words_of(x.as_buffer().to_pybytes() if x.is_valid else None)) for x in texts])

    return scan(text)


def _word_count(text: Column) -> Column:
    """Number of words of whole texts, by the matcher's own split."""

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([len(words_of(x.as_buffer().to_pybytes() if x.is_valid else None)) for x in texts], pa.int64())

    return counted(text)


def _joined(parts: Column) -> Column:
    """One result of those of several blocks."""

    @F.arrow_udf(RESULT)
    def join(lists: pa.Array) -> pa.Array:
        return _hits([(merged([p["spans"] for p in x]), sorted({i for p in x for i in p["items"]})) for x in lists.to_pylist()])

    return join(parts)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with column ``_hits``: spans (merged word ranges that occurring windows cover) and items."""
    listed = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).distinct()
    size = listed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    listed = listed.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    each = lambda b: [(r["item"], bytes(r["text"] or b"")) for r in listed.where(F.col("block") == b).collect()]
    if blocks == 1:
        return docs.withColumn("_hits", _scanned(each(0), window, F.col("text")))
    own = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)]
    k1, k2 = row_key("text", "text")
    rows = docs.select(*own, "text").withColumns({"_k1": k1, "_k2": k2})
    parts = [shared_table(rows.select("_k1", "_k2", _scanned(each(b), window, F.col("text")).alias("h")).where(F.size("h.items") > 0).groupBy("_k1", "_k2").agg(F.first("h").alias("h"), F.count("*").alias("n")), "hits") for b in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("_k1", "_k2").agg(F.collect_list("h").alias("h"), F.max("n").alias("n")).select("_k1", "_k2", "n", _joined(F.col("h")).alias("_hits"))
    spread = [F.monotonically_increasing_id()]
    marked = lookup(rows.drop("text"), shared_table(found, "all-hits"), ["_k1", "_k2"], "n", docs.count(), spread)
    none = F.expr("named_struct('spans', cast(array() as array<long>), 'items', cast(array() as array<string>))")
    return marked.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)], F.coalesce("_hits", none).alias("_hits"))


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated (5% of the words or more are hit)."""
    n_hit = F.expr("aggregate(sequence(1, size(_hits.spans) div 2), 0L, (a, i) -> a + _hits.spans[2 * i - 1] - _hits.spans[2 * i - 2])")
    n_hit = F.when(F.size("_hits.spans") == 0, F.lit(0).cast("long")).otherwise(n_hit)
    found = scan(docs, benchmark, window).withColumn("n_words", _word_count(F.col("text"))).withColumn("n_hit", n_hit)
    found = found.withColumn("n_items", F.size("_hits.items").cast("long"))
    found = found.withColumn("items_sha256", F.sha2(F.array_join("_hits.items", ","), 256))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).drop("_hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with all their columns. One whole passage is enough, however long the text around it."""
    own = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)]
    clean = scan(docs.select("text", *own), benchmark, window).where(F.size("_hits.items") == 0)
    return clean.select(*[F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)])
