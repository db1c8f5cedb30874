"""Intermediate tables and folders: below the shared folder where one is named."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not shared and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='quern-')).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and its lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
