"""What the vector searches share: which vectors take part, and streams of groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: str) -> Column:
    """Not null, not empty, and all components finite."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, ok), F.lit(False))


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, dim) of the distinct sound rows (vec_id, embedding, ...) that have an id."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull())
    return rows.where(sound("v")).distinct().withColumn("dim", F.size("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as a matrix."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def groups(batches, keys: list[str]):
    """(key, batch) for each run of rows with equal keys in a sorted stream."""
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(len(batch) - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cut = (np.flatnonzero(change) + 1).tolist()
        for i, j in zip([0, *cut], [*cut, len(batch)], strict=True):
            yield tuple(int(c[i]) for c in columns), batch.slice(i, j - i)


def ranked(found: DataFrame, k: int, best_first: Column, *more: str) -> DataFrame:
    """(query_id, rank, vec_id, score, and the columns asked for): the k best of each query, ties to smaller vec_id."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id", "query").orderBy(best_first, "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *more)
