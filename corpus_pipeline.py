"""A training corpus from ``documents``: five stages, each one of the operators, each written before the next reads it.

Toxic documents go, one document of each near-duplicate group stays, documents with benchmark passages go,
sources are mixed to their targets (rows repeat by epoch), and what is left is dealt into shards.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pmspark.llm.common import shared_folder, table
from pmspark.llm.mixing import mix_documents
from pmspark.llm.sharding import sharded
from pmspark.llm.simhash import near_copies, one_of_each
from pmspark.llm.tiling import decontaminated
from pmspark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that op3's fingerprints link, within 3 bits by BK-trees, or that share 0.8 of their shingles of five words."""
    return one_of_each(docs, near_copies(docs, radius=3))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with the shard and the slot in it."""
    out = sharded(docs, carry=tuple(docs.columns))
    return out.select(*(F.col("_carried")[c].alias(c) for c in docs.columns), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
#: SQL expresses neither the classifier nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
