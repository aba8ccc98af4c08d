"""URL filters: a blocked Bloom filter of the listed URLs before an exact hash join.

A rule is a host and a path prefix, written together (``example.com/en/``), with a verdict. The candidates of a URL are its host's
suffixes at dots, each with every prefix of its path that is as long as some rule's path. Candidates are tested inside the
row against a split-block Bloom filter (blocks of eight 64-bit words, one bit in each); only those that pass are
joined with the rules on the exact key, which removes false positives. The longest rule wins.

The filter has ``BITS_PER_RULE`` bits a rule up to ``MAX_FILTER_BYTES``, is built by aggregation and shipped as a literal array; a longer list
fills it more, so that more candidates pass on to the join. The rules are broadcast only when their keys stay under
``MAX_BROADCAST_BYTES``; otherwise the join shuffles, with common keys looked up skew-safely and URLs without a candidate spread. All steps are DataFrame functions.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; so has an empty path under rules whose path is not empty; verdict
``allow`` holds where no rule fits; repeated rows are judged each; a null rule is ignored, an empty list allows all; of repeated rules the verdict ``allow`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import lookup, shared_table, shielded

BITS_PER_RULE, MAX_FILTER_BYTES, MAX_BROADCAST_BYTES = 16, 8 << 20, 8 << 20
WORDS = 8


def _rest(url: Column) -> Column:
    """What follows the first ://, null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), upper, lower), F.lit(""))


def path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bit(key: Column, lane: int) -> Column:
    """The bit of a key in one word of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(lane)), F.lit(64)).cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


class BlockedBloom:
    """Split-block Bloom filter over the keys of a table."""

    def __init__(self, keys: DataFrame, column: str = "key"):
        spark_keys = keys.select(F.col(column).alias("key")).where("key IS NOT NULL").distinct()
        n = spark_keys.count()
        self.blocks = max(1, min(-(-n * BITS_PER_RULE // (64 * WORDS)), MAX_FILTER_BYTES // (8 * WORDS)))
        bits = [F.bit_or(_bit(F.col("key"), lane)).alias(f"w{lane}") for lane in range(WORDS)]
        filled = spark_keys.groupBy(_block(F.col("key"), self.blocks).alias("block")).agg(*bits)
        words = [0] * (self.blocks * WORDS)
        for row in filled.collect():  # bounded by MAX_FILTER_BYTES
            words[row["block"] * WORDS : (row["block"] + 1) * WORDS] = [row[f"w{lane}"] for lane in range(WORDS)]
        self.words = F.from_json(F.lit(str(words)), "array<bigint>")

    def may_hold(self, key: Column) -> Column:
        """False only for keys that are not listed."""
        at = _block(key, self.blocks) * WORDS
        passed = F.lit(True)
        for lane in range(WORDS):
            bit = _bit(key, lane)
            passed = passed & (self.words[at + lane].bitwiseAND(bit) == bit)
        return passed


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every key under which a rule could fit: host suffixes times path prefixes of the listed lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.from_json(F.lit(str(path_lengths)), "array<int>"), lambda n: n <= F.char_length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))


def _looked_up(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Left join of candidates to any number of rules: a key that many rows have is spread, as are rows without one."""
    uses = hits.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("_uses"))
    keyed = hits.withColumn("key", F.coalesce("key", F.concat(F.lit("\0"), F.col("_row").cast("string"))))  # no host has such a character
    found = lookup(keyed, shared_table(rules.join(uses, "key"), "rules"), ["key"], "_uses", hits.count(), [F.col("_row")])
    return found.drop("_uses", "_deal")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (with column url) plus host, path, rule and verdict. rules: host, path, verdict."""
    return shielded(pages, ["url"], lambda p: _judge(p, rules))


def _judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.concat("host", "path").alias("key"), F.char_length("path").alias("n_path"), F.char_length("host").alias("n_host"), "verdict")
    lengths = sorted(r[0] for r in rules.select("n_path").distinct().collect())  # no more than the longest path has characters
    rules = rules.groupBy("key").agg(F.min("verdict").alias("rule_verdict"), F.max("n_host").alias("n_host"))
    bloom = BlockedBloom(rules)
    size = rules.agg(F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0))).first()[0]
    own = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(pages.columns)]
    rows = pages.select(*own, F.monotonically_increasing_id().alias("_row"), host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"))
    possible = F.filter(candidates(F.col("_host"), F.col("_path"), lengths), bloom.may_hold)
    hits = rows.withColumn("key", F.explode_outer(F.when(F.col("_host") != "", possible)))
    exact = hits.join(F.broadcast(rules), "key", "left") if size <= MAX_BROADCAST_BYTES else _looked_up(hits, rules)
    # A row's own columns are the same in all its hits; the longest key that is really listed wins.
    hit = F.when(F.col("rule_verdict").isNotNull(), F.struct(F.char_length("key").alias("n"), "n_host", "key", "rule_verdict"))
    firsts = [F.first(f"_own_{i}").alias(f"_own_{i}") for i in range(len(pages.columns))]
    best = exact.groupBy("_row").agg(*firsts, F.first("_host").alias("host"), F.first("_path").alias("path"), F.max(hit).alias("_hit"))
    back = [F.col(f"_own_{i}").alias(c) for i, c in enumerate(pages.columns)]
    return best.select(*back, "host", "path", F.col("_hit.key").alias("rule"), F.coalesce("_hit.rule_verdict", F.lit("allow")).alias("verdict"))
