"""From raw documents to a sharded training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
before the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.decontaminate import without_benchmark
from riskloom.llm.mixing import mix_sources
from riskloom.llm.neardup import first_of_each
from riskloom.llm.quality import score_quality
from riskloom.llm.scratch import fresh, materialise
from riskloom.llm.sharding import shard_by_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Labels come from the labels table; no rows give no rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = fresh(docs, "quality")
    return score_quality(docs, labels, name=name).filter(F.col(f"{name}.kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one of smallest id.

    Five-word shingles, similarity 0.8. Documents without words are no
    duplicates and stay. Documents are told apart by id and text, so an id may
    have several texts; a null id is after all others. Of rows that repeat the
    kept id and text the one of the least other columns stays.
    """
    return first_of_each(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor an edited copy of one."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1, repeating; a row for each copy taken."""
    return mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 16 contiguous shards of near equal bytes, with shard and slot."""
    return shard_by_bytes(docs, 16)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The first stages fit models and search by hashes, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
