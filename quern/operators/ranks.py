"""Row numbers of hot keys: ranges are numbered on their own, then shifted by what stands before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import kept


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "nth", parts: int | None = None) -> DataFrame:
    """rows with ``name``: their number (from 1) within keys by ``order``, which must tell all rows of a key apart.

    Rows are range-sorted by keys and order and written, which fixes the ranges; a key of half the rows fills many of them. Each
    range numbers its own rows of a key, and the counts of the ranges before it are added: a row a key and range.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *keys, *order)
    held = kept(sorted_.withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range", *keys)
    counts = held.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row a range
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = held.withColumn("_own", F.row_number().over(own.orderBy(*order))).alias("h").join(before.alias("b"), [F.col("h._range") == F.col("b._range"), *same])
    return joined.select(*[F.col(f"h.{c}") for c in rows.columns], (F.col("_own") + F.col("_before")).cast("int").alias(name))
