"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet and reads back as the next stage's docs.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import stages
from quern.llm._scratch import new_path

STAGES = [
    ("quality classifier", stages.quality),
    ("minhash near-dedup", stages.near_dedup),
    ("substring dedup", stages.substring_dedup),
    ("source mixing", stages.mixing_stage),
    ("sentencepiece", stages.sentencepiece),
]

#: SQL expresses neither the classifier nor the piece lattice; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
