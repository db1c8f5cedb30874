"""Dense and lexical search, rank fusion, and what is done to ranked rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF_K = 60  # a parameter: fusion engines differ in it


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def dense(rows: DataFrame, vector: list[float], limit: int, keep: Column | None = None) -> DataFrame:
    """rows with ``dense``, nearest first; the filter runs before the search."""
    q = F.lit(vector).cast("array<double>")
    rows = rows if keep is None else rows.where(keep)
    return rows.withColumn("dense", F.round(cosine(F.col("embedding"), q), 9)).orderBy(F.desc("dense"), "id").limit(limit)


def terms(docs: DataFrame) -> DataFrame:
    """(id, term, tf, size): lower-cased words; counted per document before any shuffle is needed beyond it."""
    words = docs.select("id", F.filter(F.split(F.lower("text"), r"[^\p{L}0-9]+"), lambda w: w != "").alias("w"))
    return words.select("id", F.size("w").alias("size"), F.explode("w").alias("term")).groupBy("id", "term", "size").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query_terms: list[str], limit: int) -> DataFrame:
    """(id, sparse), best first: only the query's terms leave the scan; sizes and the mean are one aggregate."""
    words = docs.select("id", F.filter(F.split(F.lower("text"), r"[^\p{L}0-9]+"), lambda w: w != "").alias("w")).select("id", F.size("w").alias("size"), F.filter("w", lambda x: x.isin(*query_terms)).alias("w"))
    whole = words.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    tf = words.where(F.size("w") > 0).select("id", "size", F.explode("w").alias("term")).groupBy("id", "size", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row a query term
    rows = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return rows.groupBy("id").agg(F.round(F.sum(score), 9).alias("sparse")).orderBy(F.desc("sparse"), "id").limit(limit)


def fused(legs: list[tuple[DataFrame, str]], k: int = RRF_K) -> DataFrame:
    """(id, fused): reciprocal ranks of bounded legs (id, score), summed."""
    ranked = None
    for leg, score in legs:
        one = leg.select("id", (1.0 / (k + F.row_number().over(Window.orderBy(F.desc(score), "id")))).alias("r"))  # a leg is a top k
        ranked = one if ranked is None else ranked.union(one)
    return ranked.groupBy("id").agg(F.round(F.sum("r"), 9).alias("fused"))


def capped(rows: DataFrame, group: str, order: list[Column], cap: int, limit: int) -> DataFrame:
    """At most ``cap`` rows a group in rank order; what is left over fills up to the limit."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_nth", nth).orderBy((F.col("_nth") > cap).cast("int"), *order).limit(limit).drop("_nth")


def degraded(base: Column, recency: Column, importance: Column) -> Column:
    """The final score without a reranker."""
    return base * (1 + 0.15 * recency) * (1 + 0.10 * (F.coalesce(importance, F.lit(0.5)) - 0.5))


def reranked(score: Column, recency: Column, importance: Column) -> Column:
    return score + recency + 0.5 * (F.coalesce(importance, F.lit(0.5)) - 0.5)


def dealt(rows: DataFrame, queries: DataFrame, use: Callable, read: Callable, schema: str, block: int) -> DataFrame:
    """What ``use`` makes of each block of queries and each batch of rows, tables of the same columns with an ``id``.

    Queries are dealt into blocks of about ``block``, however many there are, and rows into as many chunks as there are
    shuffle partitions; a task holds one block and streams the rows of one chunk past it. ``read`` makes lists or arrays
    of a batch; those of a block are strung together.
    """
    chunks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    by_id = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    blocks = F.broadcast(queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("_blocks")))  # one row
    given = [F.col(c) for c in rows.columns]
    asking = queries.crossJoin(blocks).select(spread(F.lit(chunks)).alias("_chunk"), by_id(F.col("_blocks")).alias("_block"), F.lit(0).alias("_kind"), *given)
    both = asking.union(rows.crossJoin(blocks).select(by_id(F.lit(chunks)).alias("_chunk"), spread(F.col("_blocks")).alias("_block"), F.lit(1).alias("_kind"), *given))

    def strung(parts: list):
        return np.concatenate(parts) if isinstance(parts[0], np.ndarray) else [x for p in parts for x in p]

    def run(batches):
        key, held, block_of = None, [], None
        for batch in batches:
            places = np.stack([np.asarray(batch.column(i)) for i in range(3)], axis=1)
            cut = (np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist() if len(batch) else []
            for i, j in zip([0, *cut], [*cut, len(batch)], strict=True) if len(batch) else ():
                part = read(batch.slice(i, j - i))
                if tuple(places[i, :2]) != key:
                    key, held, block_of = tuple(places[i, :2]), [], None
                if places[i, 2] == 0:
                    held.append(part)
                elif held:
                    block_of = block_of or [strung(x) for x in zip(*held, strict=True)]
                    yield from use(block_of, part)

    return both.repartition("_chunk", "_block").sortWithinPartitions("_chunk", "_block", "_kind").mapInArrow(run, schema)


def blocked(rows: DataFrame, queries: DataFrame, use: Callable, schema: str, block: int = 2048) -> DataFrame:
    """``dealt`` over (id, v, label), vectors as unit rows of matrices."""
    given = lambda d: d.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))

    def read(part: pa.RecordBatch):
        v = part.column(part.schema.get_field_index("v"))
        x = np.asarray(v.flatten()).reshape(len(v), -1)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.asarray(part.column(part.schema.get_field_index("id"))), unit, np.asarray(part.column(part.schema.get_field_index("label")))

    return dealt(given(rows), given(queries), use, read, schema, block)


def nearest_labels(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, wanted, id, label, score, rank): the k nearest rows of each query but itself, by cosine; a block keeps its k best before anything is shuffled."""

    def best(asked, held):
        (q, x, wanted), (ids, y, labels) = asked, held
        s = np.round(x @ y.T, 9)
        s[q[:, None] == ids[None]] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        at = np.repeat(np.arange(len(q)), order.shape[1])
        of = order.ravel()
        keep = np.isfinite(s[at, of])
        at, of = at[keep], of[keep]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q[at], wanted[at], ids[of], labels[of], s[at, of])], ["q", "wanted", "id", "label", "score"])

    found = blocked(rows, queries, best, "q long, wanted long, id long, label long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def own_rank(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, rank) of each query (id, v) among all rows by its own vector, ties to smaller ids."""

    def counted(asked, held):
        (q, x, _), (ids, y, _) = asked, held
        s, own = np.round(x @ y.T, 9), np.round((x * x).sum(axis=1), 9)[:, None]
        nearer = (s > own) | ((s == own) & (ids[None] < q[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(nearer.sum(axis=1))], ["id", "n"])

    return blocked(rows, queries, counted, "id long, n long").groupBy("id").agg((F.sum("n") + 1).alias("rank"))


def with_facts(entities: DataFrame, key: str, edges: DataFrame, limit: int) -> DataFrame:
    """entities with their first ``limit`` facts (id, src, dst) by id, in either direction; entities without facts stay.

    ``entities`` is a search's result, so it is sent to the facts.
    """
    both = lambda own, other, direction: edges.select(F.col(own).alias(key), "id", F.col(other).alias("other"), F.lit(direction).alias("direction"))
    facts = both("src", "dst", "outgoing").union(both("dst", "src", "incoming")).join(F.broadcast(entities.select(key)), key)  # a search's result
    first = facts.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("id", "direction"))).where(F.col("_nth") <= limit).drop("_nth")
    return entities.join(first, key, "left")
