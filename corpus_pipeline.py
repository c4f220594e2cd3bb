"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns the columns of documents; the last adds each document's shard.

Defined results: rows are judged each for itself, by id and text, so null and repeated ids
are no one's fault but their own; null and empty texts are neither toxic, near copies
nor contaminated, and are never taken by the mix; of rows equal in id and text the second
stage keeps one; ties between near copies go to the smallest id, null last; texts of any
length are read whole; empty tables give an empty result with the same columns; columns
beyond those of documents pass through whatever their names, and a column called shard
makes the new one shard_.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from condensa.llm._kit import durable
from condensa.llm.decontaminate import clean_documents
from condensa.llm.mixing import mixed_documents
from condensa.llm.ngram_jaccard import keep_one
from condensa.llm.sharding import assign_shards
from condensa.llm.toxicity import keep_civil


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents predicted toxic go."""
    return keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 with five words and similarity 0.8: the smallest id of each group stays."""
    return keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents overlapping a benchmark item go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents come as often as the mix takes them (not at all, once or twice)."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document's shard of 16."""
    return assign_shards(docs, 16)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: Learned scores, set similarity over all pairs and seeded draws are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
