"""A corpus pipeline of five operators: quality, near duplicates, benchmark overlap, mix and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import classifier, decontaminate, mixing, near_dedup as jaccard, sharding
from canopy.llm.common import shared_table, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return classifier.drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those at a five-word-shingle similarity of 0.8 or more to a kept one of smaller doc_id; SimHash's candidates come first, a search without loss adds the rest."""
    return jaccard.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every emitted document with its shard and its place there."""
    return sharding.assign(docs.select("doc_id", "text"), keep_text=False)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix", mix), ("shards", shards)]

#: Hashes and learned weights are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is stored in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
