"""Corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again.

ORACLE_SQL is None: training, fingerprint walks and string tiling have no SQL form.
tests/llm compares each stage with a brute-force version instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontaminate, mixing, sharding, simhash, spread, toxicity


def _civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, distance=simhash.DISTANCE)


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def _shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", _civil),
    ("simhash_near_dedup", _distinct),
    ("decontamination", _clean),
    ("mixing", _mixed),
    ("sharding", _shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of all documents that the stages keep; one row for each copy the mix takes."""
    folder = f"{spread.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # nothing reads a stage's rows once the next one is written
            spread.remove(spark, f"{folder}/{before}")
        before = name
    return docs
