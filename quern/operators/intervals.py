"""Sequences and intervals: gaps, slices, streaks, overlaps and free time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(at: Column) -> Column:
    """A timestamp without zone as seconds, zone UTC."""
    return F.unix_micros(at.cast("timestamp")) / 1_000_000


def gap_sessions(rows: DataFrame, key: str, at: str, order: list[str], gap: float) -> DataFrame:
    """Rows with ``session``, numbered from 0: a new one begins where the gap is reached."""
    w = Window.partitionBy(key).orderBy(at, *order)
    begins = (seconds(F.col(at)) - F.lag(seconds(F.col(at))).over(w) >= gap).cast("int")
    return rows.withColumn("_new", F.coalesce(begins, F.lit(0))).withColumn("session", F.sum("_new").over(w)).drop("_new")


def anchored_slices(rows: DataFrame, key: str, at: str, width: int, slide: int, least: int) -> DataFrame:
    """(key, slice, n): overlapping windows counted from each key's first row; those with ``least`` rows at least."""
    first = rows.groupBy(key).agg(F.min(at).alias("_first"))
    off = F.floor(seconds(F.col(at)) - seconds(F.col("_first")))
    slices = F.sequence(F.greatest(F.lit(0), F.floor((off - width) / slide) + 1), F.floor(off / slide))
    return rows.join(first, key).select(key, F.explode(slices).alias("slice")).groupBy(key, "slice").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def islands(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows with ``island``: neighbouring rows of one value share it."""
    w = Window.partitionBy(key).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return rows.withColumn("_new", changed).withColumn("island", F.sum("_new").over(w)).drop("_new")


def overlaps(rows: DataFrame, key: str, ident: str, start: str, end: str, bucket: float) -> DataFrame:
    """(a, b), a < b, of a key's intervals that overlap; each pair meets in the bucket where its overlap begins."""
    cut = F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))
    x = rows.withColumn("_b", F.explode(cut))
    y = x.select(key, "_b", *[F.col(c).alias(f"_{c}") for c in (ident, start, end)])
    meets = (F.col(start) < F.col(f"_{end}")) & (F.col(f"_{start}") < F.col(end)) & (F.col(ident) < F.col(f"_{ident}"))
    once = F.floor(F.greatest(F.col(start), F.col(f"_{start}")) / bucket) == F.col("_b")
    return x.join(y, [key, "_b"]).where(meets & once).select(key, F.col(ident).alias("a"), F.col(f"_{ident}").alias("b"))


def free_blocks(rows: DataFrame, key: str, start: str, end: str, least: float) -> DataFrame:
    """(key, n): gaps of at least so much between a key's busy intervals."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_gap", F.col(start) - F.max(end).over(w)).groupBy(key).agg(F.count_if(F.col("_gap") >= least).alias("n"))


def trailing_run(rows: DataFrame, key: str, order: str, mine: Column) -> DataFrame:
    """(key, pending, last): rows behind the last one that is mine, where there are any."""
    seen = rows.groupBy(key).agg(F.max(F.when(mine, F.col(order))).alias("_mine"), F.max(order).alias("last"))
    pending = rows.join(seen, key).where(F.col("_mine").isNull() | (F.col(order) > F.col("_mine")))
    return pending.groupBy(key).agg(F.count("*").alias("pending"), F.max("last").alias("last"))
