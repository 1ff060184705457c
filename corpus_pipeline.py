"""From raw documents to training shards, by five of the llm operators.

Each stage reads what the one before it has kept, as Parquet, and all but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cutweave.llm import mixing, positional_index, quality, sharding, simhash
from cutweave.llm.common import delete, scratch, shared_root

SEED = 42
N_SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant does not reject."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the smallest id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark windows hit less than a twentieth."""
    return positional_index.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as a Poisson draw with its source's rate says;
    sources weigh by the square root of their documents."""
    return mixing.replicate(docs, seed=SEED).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, copies of a text together."""
    return sharding.shard_documents(docs, N_SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: SimHash of XXH64 shingles and a fitted model are beyond SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared
    folder; what a stage stored on its way, and its input, go once it is written."""
    docs = _table(spark, sf_dir, "documents")
    root = f"{shared_root(spark)}/cutweave/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if k:
            delete(spark, f"{root}/{k - 1}")
        docs = spark.read.parquet(path)
    return docs
