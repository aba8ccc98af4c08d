"""Shared tools of the corpus operators: shared storage, skew-safe lookups, words.

Tables handed from one Spark job to the next are written below the folder that
``spark.checkpoint.dir`` names, so that they outlive lost executors and cut the
lineage. Nothing here depends on a driver-local or executor-local file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The whitespace of all word contracts: space, tab, LF, VT, FF and CR.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds at least one row in HOT_SHARE; there are at most HOT_SHARE such keys.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else (local mode only) one below /tmp."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return "file:///tmp/checkpoints/canopy"
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the table that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(df: DataFrame, needs: list[str], operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operate`` on the columns it needs, with all others carried along out of its sight.

    The result has the columns of df and those that operate adds; of two with one name the added one stays.
    """
    rest = [c for c in df.columns if c not in needs]
    hidden = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("_rest")] if rest else []
    out = operate(df.select(*needs, *hidden))
    added = [c for c in out.columns if c not in (*needs, "_rest")]
    taken = {c.lower() for c in added}
    back = [F.col(c) if c in needs else F.col(f"_rest.c{rest.index(c)}").alias(c) for c in df.columns if c.lower() not in taken]
    return out.select(*back, *added)


def literal_table(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A table of a few rows that the plan itself holds; no Python runs on the executors. fields: ``name type, ...``."""
    names = [f.split()[0] for f in fields.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    kind = ", ".join(": ".join(f.split()) for f in fields.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def word_count(text: Column) -> Column:
    """Number of words (runs without the six ASCII spaces) as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], n_col: str, total: int, spread: list[Column]) -> DataFrame:
    """Left join of rows to groups (one row a key) that no hot key can overload.

    ``groups`` must be a stored table, have non-null unique keys and in ``n_col`` the
    number of rows of each key; ``total`` is the number of all rows. Keys with at least one row in
    HOT_SHARE number at most HOT_SHARE, which bounds their broadcast; all other keys hold
    fewer rows than that share and meet in a shuffle join, where rows that have already found
    their hot key are dealt out by ``spread``. The result has the columns of rows and the values of groups
    (null where the key is missing), and column ``_deal``, by which (with the keys) the rows now lie together.
    """
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(n_col) * HOT_SHARE >= F.lit(total)).select(*keys, F.struct(*values).alias("_hot"))
    cold = groups.where(F.col(n_col) * HOT_SHARE < F.lit(total)).select(*keys, F.lit(0).alias("_deal"), F.struct(*values).alias("_cold"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_deal", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    )
    found = dealt.join(cold, [*keys, "_deal"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return found.select(*rows.columns, "_deal", *[F.col(f"_found.{c}").alias(c) for c in values])


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Stored table: rows plus column ``name``, their numbers from 0 in the order of keys (nulls first). Rows equal in all keys are numbered in any order, over several partitions."""
    order = [*keys, "_tie"]
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    stored = shared_table(ordered.drop("_tie").withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.call_function("shiftright", F.col("_id"), F.lit(33)).cast("int")  # ids hold the partition above 33 bits of the row's number in it
    counts = sorted(stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row for each partition
    starts, at = [0] * (counts[-1]["part"] + 1 if counts else 1), 0
    for r in counts:
        starts[r["part"]] = at
        at += r["n"]
    start = F.from_json(F.lit(str(starts)), "array<bigint>")[part]
    return stored.withColumn(name, start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """128 bits of (doc_id, text), never null; rows that share them are interchangeable."""
    return F.xxhash64(F.col(doc_id), F.col(text)), F.xxhash64(F.lit("canopy"), F.col(text), F.col(doc_id))


def emit(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of docs, each as often as decided.

    ``decisions`` has (_k1, _k2, copies), a row for each row of docs. Rows that repeat a
    doc_id and text share the sum of their copies as evenly as whole numbers allow. docs is shuffled once, by keys
    that differ between copies of a text.
    """
    wanted = decisions.groupBy("_k1", "_k2").agg(F.sum("copies").alias("_total"), F.count("*").alias("_n")).where("_total > 0")
    k1, k2 = row_key()
    own = [F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, k1.alias("_k1"), k2.alias("_k2")).join(wanted, ["_k1", "_k2"])
    nth = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1")).cast("long")
    share = F.floor(F.col("_total") * F.col("_nth") / F.col("_n")) - F.floor(F.col("_total") * (F.col("_nth") - 1) / F.col("_n"))
    rows = rows.withColumn("_nth", nth).withColumn("_share", share.cast("int")).where("_share > 0")
    back = [F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_share")))).select(*back)
