"""Exact top-k by inner product with KD-trees.

A coarse tree of median splits, fitted to at most ``SAMPLE`` vectors, deals all
vectors into shards of about ``SHARD`` rows by place; shards that still hold
more (equal vectors) are split by hash.  Each shard builds a KD-tree: median
splits of the widest dimension, with the tight bounding box of every node.  A
query visits nodes best bound first (the greatest inner product that a box
allows) until no bound reaches its kth score.

Queries travel in three rounds and take their kth score along: first to the
shard where they lie, then to the ``NEXT`` shards whose boxes promise most, at
last to all others whose boxes still reach the kth score found.  The boxes that
decide this are those of at most ``BOXES`` nodes of the coarse tree, so they are
small whatever the data.  In a shard queries are dealt into blocks, a task each.

Components are floor(256 * x) and scores integers, computed exactly.

Cases: vectors null, empty, or with null or non-finite components take no part,
nor do rows without vec_id; rows repeated in full count once; all rows of the
query's vec_id are its own; vectors only meet vectors of their dimension; an
empty table gives no rows; other columns are not read. Scores must fit a long:
components stay below 2^25 or so.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from .vectors import groups, matrix, ranked, vectors

SHARD = 16384
LEAF = 64
SAMPLE = 20_000
NEXT = 4
BOXES = 4096
BLOCK = 4096
LEAST = 2048  # rows of a shard that is small for the sake of more tasks


class Tree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order, low, high, child, span = np.arange(len(rows)), [], [], [], []
        todo = [(0, len(rows), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = rows[order[a:b]]
            at = len(low)
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            child.append([-1, -1])
            span.append((a, b))
            if parent >= 0:
                child[parent][side] = at
            wide = int((high[at].astype(float) - low[at]).argmax())
            if b - a > LEAF and high[at][wide] > low[at][wide]:
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, wide], half)]
                todo += [(a, a + half, at, 0), (a + half, b, at, 1)]
        self.low, self.high, self.child, self.span = np.array(low), np.array(high), child, span
        self.ids, self.rows = ids[order], rows[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): the greatest inner product a box allows."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def best(self, query: np.ndarray, own: int, k: int, bounds: np.ndarray, floor=None) -> list[tuple]:
        """The k best (score, id) not below floor, best first, ties to smaller ids."""
        top: list[tuple] = []  # a heap of (score, -id), worst first
        heap = [(-bounds[0], 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            least = top[0][0] if len(top) == k else floor
            if least is not None and -bound < least:
                break
            if self.child[at][0] >= 0:
                for c in self.child[at]:
                    if least is None or bounds[c] >= least:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            a, b = self.span[at]
            scores = self.rows[a:b] @ query
            near = np.arange(b - a) if least is None else np.flatnonzero(scores >= least)
            for s, i in zip(scores[near].tolist(), self.ids[a:b][near].tolist(), strict=True):
                if i == own:
                    continue
                if len(top) < k:
                    heapq.heappush(top, (s, -i))
                elif (s, -i) > top[0]:
                    heapq.heapreplace(top, (s, -i))
        return [(int(s), -i) for s, i in sorted(top, reverse=True)]


def numbers(*parts: np.ndarray) -> type:
    """float64 where its sums of products are exact, else Python's integers."""
    most = [int(np.abs(p).max(initial=0)) for p in parts]
    return np.float64 if most[0] * most[-1] * parts[0].shape[1] < 1 << 53 else object


def _searched(k: int):
    def run(batches):
        key, held, tree, rows = None, [], None, None
        for (dim, shard, block, kind), part in groups(batches, ["dim", "shard", "block", "kind"]):
            if (dim, shard, block) != key:
                key, held, tree = (dim, shard, block), [], None
            if kind == 0:
                held.append(part)
                continue
            if not held:
                continue
            if tree is None:
                table = pa.Table.from_batches(held).combine_chunks()
                rows = matrix(table["v"].combine_chunks())
                tree = Tree(np.asarray(table["id"]), rows.astype(np.float64))
            queries = matrix(part.column("v"))
            exact = numbers(queries, rows)
            if exact is object:
                ids = np.asarray(pa.Table.from_batches(held)["id"])
                tree = Tree(ids, rows.astype(object))
            q = queries.astype(exact)
            out = []
            for a in range(0, len(q), 256):
                bounds = tree.bounds(q[a : a + 256])
                for i, own, floor in zip(range(a, len(q)), part.column("id").slice(a, 256).to_pylist(), part.column("floor").slice(a, 256).to_pylist(), strict=False):
                    out += [(own, part.column("query")[i].as_py(), v, s) for s, v in tree.best(q[i], own, k, bounds[i - a], floor)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query_id", "query", "vec_id", "score"])

    return run


class Planes:
    """A coarse tree of median splits: depth levels, nodes in heap order; a row falls to one of 2 ** depth leaves."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        held = {0: sample}
        for node in range(len(self.axis)):
            rows = held.pop(node)
            if len(rows):
                self.axis[node] = int(np.ptp(rows, axis=0).argmax())
                self.cut[node] = np.median(rows[:, self.axis[node]])
            right = rows[:, self.axis[node]] >= self.cut[node]
            held |= {2 * node + 1: rows[~right], 2 * node + 2: rows[right]}

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.cut[node])
        return node - ((1 << self.depth) - 1)


def _placed(planes: dict):
    def run(batches):
        for (dim,), part in groups(batches, ["dim"]):
            leaf = planes[dim].leaf(matrix(part.column("v")))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf)], [*part.schema.names, "leaf"])

    return run


def _boxes(shift: dict):
    """The box of each task's rows of a node: (dim, node, low, high)."""

    def run(batches):
        found: dict = {}
        for (dim,), part in groups(batches, ["dim"]):
            x, node = matrix(part.column("v")), np.asarray(part.column("leaf")) >> shift[dim]
            for n in np.unique(node).tolist():
                own = x[node == n]
                low, high = own.min(axis=0), own.max(axis=0)
                if (dim, n) in found:
                    low, high = np.minimum(low, found[dim, n][0]), np.maximum(high, found[dim, n][1])
                found[dim, n] = (low, high)
        if found:
            keys = list(found)
            lists = [pa.array([found[k][i].tolist() for k in keys], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), *lists], ["dim", "node", "low", "high"])

    return run


def _sent(boxes: dict, subs: dict, shift: dict, last: bool):
    """A row for each query and shard that it goes to: those of its best boxes, or (``last``) the others that reach its kth score; never its own."""

    def run(batches):
        for (dim,), part in groups(batches, ["dim"]):
            nodes, low, high = boxes[dim]
            x = matrix(part.column("v")).astype(float)
            bound = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T
            rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
            floor, home = part.column("floor").to_pylist(), np.asarray(part.column("shard"))
            to, at = [], []
            for i in range(len(x)):
                near = rank[i] < NEXT
                # a bound in floats may fall short of the exact one by its rounding
                reach = np.ones(len(nodes), bool) if floor[i] is None else bound[i] >= floor[i] - 1e-9 * (np.abs(bound[i]) + abs(floor[i]))
                for n in nodes[(~near if last else near) & reach].tolist():
                    own = subs[dim][n]
                    own = own[own != home[i]]
                    to.append(own)
                    at.append(np.full(len(own), i))
            if to:
                at = pa.array(np.concatenate(at))
                kept = [part.column(part.schema.get_field_index(c)).take(at) for c in ("vec_id", "query", "v", "dim", "floor")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(to))], ["vec_id", "query", "v", "dim", "floor", "shard"])

    return run


def top_k(entries: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for each query row; both tables: (vec_id, embedding, ...)."""
    coded = lambda rows: vectors(rows).select("vec_id", F.transform("v", lambda x: F.floor(x * 256)).alias("v"), "dim").distinct()
    shape = "vec_id long, v array<long>, dim int"
    rows, asked = written(coded(entries), "entries"), written(coded(queries).withColumn("query", F.xxhash64("v")), "queries")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a dimension
    asked, blocks = asked.where(F.col("dim").isin(list(sizes))), max(1, -(-asked.count() // BLOCK))
    planes = {}
    for dim, n in sizes.items():
        got = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").toArrow()
        shards = max(-(-n // SHARD), min(16, n // LEAST), 1)
        planes[dim] = Planes(matrix(got["v"].combine_chunks()), (shards - 1).bit_length())
    placed = written(rows.mapInArrow(_placed(planes), shape + ", leaf long"), "placed")
    shift = {dim: max(0, p.depth - BOXES.bit_length() + 1) for dim, p in planes.items()}
    # leaves with more rows than a shard (equal vectors) are split by hash: a row a leaf on the driver, one in SHARD rows of the table
    split = [(r["dim"], r["leaf"], -(-r["n"] // (2 * SHARD))) for r in placed.groupBy("dim", "leaf").agg(F.count("*").alias("n")).collect()]
    spread = F.broadcast(entries.sparkSession.createDataFrame(split, "dim int, leaf long, subs long"))
    subs: dict = {dim: {} for dim in planes}
    for dim, leaf, n in split:
        subs[dim].setdefault(leaf >> shift[dim], []).extend((leaf << 20) + s for s in range(n))
    subs = {dim: {node: np.array(x) for node, x in own.items()} for dim, own in subs.items()}
    cells = placed.mapInArrow(_boxes(shift), "dim int, node long, low array<long>, high array<long>").select("dim", "node", F.posexplode(F.arrays_zip("low", "high")).alias("i", "x"))
    cells = cells.groupBy("dim", "node", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    boxes: dict = {dim: {} for dim in planes}
    for r in cells.groupBy("dim", "node").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("b")).collect():  # BOXES rows a dimension at most
        boxes[r["dim"]][r["node"]] = [(b["low"], b["high"]) for b in r["b"]]
    boxes = {dim: (np.array(list(own)), *np.array(list(own.values()), float).transpose(2, 0, 1)) for dim, own in boxes.items()}

    block = F.pmod("query", F.lit(blocks))
    home = lambda key: ((F.col("leaf") * (1 << 20)) + F.pmod(key, F.col("subs"))).alias("shard")
    shards = placed.join(spread, ["dim", "leaf"]).select("dim", home(F.xxhash64("vec_id", "v")), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("query"), "v", F.lit(None).cast("long").alias("floor"))

    def searched(asking: DataFrame, name: str) -> DataFrame:
        both = shards.join(asking.select("dim", "shard", block.alias("block")).distinct(), ["dim", "shard", "block"], "left_semi")
        both = both.select(shards.columns).union(asking.select("dim", "shard", block, F.lit(1), F.col("vec_id"), "query", "v", "floor"))
        both = both.repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "kind")
        return written(both.mapInArrow(_searched(k), "query_id long, query long, vec_id long, score long"), name)

    def floored(found: DataFrame) -> DataFrame:
        """The queries at home with the kth score found up to now."""
        best = ranked(found, k, F.desc("score"), "query").groupBy("query_id", "query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        best = best.select(F.col("query_id").alias("vec_id"), "query", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
        return at_home.drop("floor").join(best, ["vec_id", "query"], "left").select("vec_id", "query", "v", "dim", "floor", "shard")

    if not sizes:
        return ranked(shards.select(F.col("id").alias("query_id"), "query", F.col("id").alias("vec_id"), F.col("floor").alias("score")), k, F.desc("score"))
    own = asked.mapInArrow(_placed(planes), shape + ", query long, leaf long").join(spread, ["dim", "leaf"], "left").withColumn("subs", F.coalesce("subs", F.lit(1).cast("long")))
    at_home = written(own.select("vec_id", "query", "v", "dim", F.lit(None).cast("long").alias("floor"), home(F.col("query"))), "home")
    asking = "vec_id long, query long, v array<long>, dim int, floor long, shard long"
    found = searched(at_home, "first")
    if sum(len(x) for dim in subs.values() for x in dim.values()) > 1:
        for last in (False, True):
            sent = written(floored(found).mapInArrow(_sent(boxes, subs, shift, last), asking), "sent")
            found = found.union(searched(sent, "others" if last else "next"))
    return ranked(found, k, F.desc("score"))
