"""Tables and the shared folder.

Intermediate tables are written to the folder that ``spark.checkpoint.dir``
names, which driver and executors share, so a lost executor never takes the
only copy of an intermediate result with it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local one is made only where none is set and all work is done on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the folder's owner clears it
            return


def unclashing(columns: list[str], *own: str) -> None:
    """Refuses a table whose columns, case folded, are those that an operator adds or works with."""
    if clash := {c.lower() for c in columns} & {c.lower() for c in own}:
        raise ValueError(f"the table already has columns {sorted(clash)}")


def row_key(*cols: str) -> list:
    """Two 64-bit hashes of a row's columns, null-safe, as key columns k1, k2."""
    given = [F.col(c) for c in cols]
    return [F.xxhash64(*given).alias("k1"), F.xxhash64(F.lit("second"), *given).alias("k2")]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
