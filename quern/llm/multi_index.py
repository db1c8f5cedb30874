"""Approximate nearest neighbours by an inverted multi-index.

Vectors are turned by a fixed random rotation, which spreads what tells them
apart over both halves.  The halves are quantised on their own, so K centroids
a half make K * K cells.  A query walks centroid pairs by the sum of the two
distances with a heap (each pair is pushed when its neighbour is taken):

* first until the cells it has passed hold ``FIRST`` entries for each neighbour
  wanted; reranked by exact distance, these give a kth distance;
* then on, and once more with the kth distance found by then, until all cells
  left are expected to hold no more than ``MIDWAY`` (at last ``missed``) times k
  entries nearer than that.  Entries lie about their centroids
  with a known mean square (measured when the codebooks are fitted), from which
  the distances of a cell's entries and their deviation follow.

So the share of entries that a search passes follows the data: small where
vectors cluster, large where they have no structure.

The codebooks are fitted on the driver to at most ``sample`` vectors (those of
least hash); every row is indexed.  The driver also holds one count a cell,
K * K at most.  The cells of one left centroid make a shelf; a query goes to
each shelf that it visits once a walk, with the cells it wants there.  Shelves
are split into parts of about ``PART`` rows, so that no task holds a large one.

Cases: vectors null, empty, all zero, or with null or non-finite components
take no part, nor do rows without vec_id; rows repeated in full count once; all
rows of the query's vec_id are its own; vectors only meet vectors of their
dimension, and one dimension has a single half; an empty table gives no rows;
other columns are not read.  Where a walk has not found k candidates, it goes
on through all cells.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import parts, written
from .vectors import groups, matrix, ranked, vectors

PART = 8192
FIRST = 64
MIDWAY, MISSED = 4.0, 0.25  # so many times k neighbours are expected beyond the second and the last walk


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared, between all rows of x and y."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)[None], 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 4) -> np.ndarray:
    """k-means; an emptied centroid takes the place of the farthest point."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = distances(x, c)
        near = d.argmin(axis=1)
        far = np.argsort(-d[np.arange(len(x)), near])
        for j in range(len(c)):
            own = near == j
            c[j] = x[own].mean(axis=0) if own.any() else x[far[j % len(far)]]
    return c


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: float, reach: float = np.inf) -> list[int]:
    """Cells (i * len(b) + j) in the order of a[i] + b[j] until ``enough`` entries are passed or a sum exceeds ``reach``; empty cells are left out."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b, oa, ob = a[oa].tolist(), b[ob].tolist(), oa.tolist(), ob.tolist()
    width, held = len(b), counts.tolist() if isinstance(counts, np.ndarray) else counts
    heap, out, passed = [(a[0] + b[0], 0, 0)], [], 0
    while heap and passed < enough:
        sum_, i, j = heapq.heappop(heap)
        if sum_ > reach:
            break
        cell = oa[i] * width + ob[j]
        if held[cell]:
            out.append(cell)
            passed += held[cell]
        # each pair has one parent: (i, j - 1), or (i - 1, 0) in the first column
        if j + 1 < width:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 26.2.17), to 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z >= 0, 1 - tail, tail)


def reach(a: np.ndarray, b: np.ndarray, counts: np.ndarray, books: Books, kth: float, missed: float) -> float:
    """The sum a[i] + b[j] up to which cells must be passed so that beyond it no more than ``missed`` entries nearer than ``kth`` are expected.

    The squared distance of an entry in a cell at sum s is s + spread on average; its variance is that of the part which
    depends on the direction, 4 * s * spread / dim, and scatter ** 2, that of the entries about their centroids.
    """
    s = (a[:, None] + b[None]).ravel()
    some = np.flatnonzero(counts)
    order = some[np.argsort(s[some], kind="stable")]
    s = s[order]
    hope = counts[order] * below((kth * kth - s - books.spread) / np.sqrt(4 * s * books.spread / books.dim + books.scatter**2 + 1e-300))
    beyond = hope.sum() - np.cumsum(hope)  # expected behind each cell
    at = int(np.searchsorted(-beyond, -missed))  # the first cell with few enough behind it
    return float(s[min(at, len(s) - 1)]) if len(s) else 0.0


def rotation(dim: int, seed: int = 4) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


class Books:
    """Both codebooks of one dimension, with the mean square of what they leave and its deviation."""

    def __init__(self, x: np.ndarray, cells: int) -> None:
        self.dim, self.turn = x.shape[1], rotation(x.shape[1])
        x, h = x @ self.turn, max(1, x.shape[1] // 2)
        self.left, self.right = codebook(x[:, :h], cells), codebook(x[:, h:], cells) if self.dim > 1 else np.zeros((1, 0))
        a, b = self.distances(x @ self.turn.T)
        left = a.min(axis=1) + b.min(axis=1)
        self.spread = float(left.mean()) * len(x) / max(1, len(x) - cells)  # fitted points lie a little too near
        self.scatter = float(left.std())

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, h = x @ self.turn, self.left.shape[1]
        return distances(x[:, :h], self.left), distances(x[:, h:], self.right)


def _celled(books: dict):
    def run(batches):
        for (dim,), part in groups(batches, ["dim"]):
            a, b = books[dim].distances(matrix(part.column("v")))
            cell = a.argmin(axis=1) * b.shape[1] + b.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), part.column("dim"), pa.array(cell.astype(np.int64))], ["vec_id", "v", "dim", "cell"])

    return run


def _walked(books: dict, counts: dict, enough: dict, missed: list[float]):
    """A row for each query and shelf that it visits, with the right halves of its cells there.

    ``kth`` lists the kth distances found by the walks before, one for each of ``missed``; what these have passed is left out.
    """
    lists = {dim: c.tolist() for dim, c in counts.items()}

    def run(batches):
        for (dim,), part in groups(batches, ["dim"]):
            own = books[dim]
            a, b = own.distances(matrix(part.column("v")))
            kths = part.column("kth").to_pylist()
            for i in range(len(a)):
                cells, done = walk(a[i], b[i], lists[dim], enough[dim]), 0
                for kth, most in zip(kths[i], missed, strict=True):
                    done = max(done, len(cells))
                    cells = walk(a[i], b[i], lists[dim], np.inf, np.inf if kth is None else reach(a[i], b[i], counts[dim], own, kth, most))
                cells = np.sort(np.array(cells[done:], np.int64))
                if not len(cells):
                    continue
                shelf, first = np.unique(cells // b.shape[1], return_index=True)
                at = pa.array(np.full(len(shelf), i))
                wanted = pa.ListArray.from_arrays(np.append(first, len(cells)).astype(np.int32), (cells % b.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(at), part.column("query").take(at), part.column("v").take(at), part.column("dim").take(at), pa.array(shelf), wanted], ["vec_id", "query", "v", "dim", "shelf", "cells"])

    return run


def _reranked(k: int):
    def run(batches):
        key, held, rows, ids, cell = None, [], None, None, None
        for (dim, shelf, sub, kind), part in groups(batches, ["dim", "shelf", "sub", "kind"]):
            if (dim, shelf, sub) != key:
                key, held, rows = (dim, shelf, sub), [], None
            if kind == 0:
                held.append(part)
                continue
            if not held:
                continue
            if rows is None:
                table = pa.Table.from_batches(held).combine_chunks()
                rows, ids, cell = matrix(table["v"].combine_chunks()), np.asarray(table["id"]), np.asarray(table["cells"].combine_chunks().flatten())
            asked, own, name = matrix(part.column("v")), np.asarray(part.column("id")), np.asarray(part.column("query"))
            out = []
            for i in range(len(asked)):
                some = np.flatnonzero(np.isin(cell, np.asarray(part.column("cells")[i].values)) & (ids != own[i]))
                d = rows[some] - asked[i]
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                near = near[np.lexsort((ids[some[near]], d[near]))][:k]
                out.append((np.full(len(near), own[i]), np.full(len(near), name[i]), ids[some[near]], d[near]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "query", "vec_id", "score"])

    return run


def nearest(entries: DataFrame, queries: DataFrame, k: int = 10, missed: float = MISSED, sample: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k nearest entries by Euclidean distance; both tables: (vec_id, embedding, ...)."""
    some = F.exists("v", lambda x: x != 0)
    rows, asked = written(vectors(entries).where(some), "entries"), vectors(queries).where(some).withColumn("query", F.xxhash64("v"))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a dimension
    books = {}
    for dim, n in sizes.items():
        got = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "v")).limit(sample).select("v").toArrow()
        books[dim] = Books(matrix(got["v"].combine_chunks()), int(np.clip(np.sqrt(n) / 1.6, 4, 256)))
    placed = written(rows.mapInArrow(_celled(books), "vec_id long, v array<double>, dim int, cell long"), "cells")
    counts = {dim: np.zeros(len(b.left) * len(b.right), np.int64) for dim, b in books.items()}
    for r in placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect():  # K * K rows a dimension at most
        counts[r["dim"]][r["cell"]] = r["n"]
    enough = {dim: FIRST * k for dim in sizes}
    split = []
    for dim, b in books.items():
        for shelf, n in enumerate(counts[dim].reshape(len(b.left), len(b.right)).sum(axis=1).tolist()):
            if n:
                split.append((dim, shelf, -(-n // PART)))
    split = F.broadcast(entries.sparkSession.createDataFrame(split, "dim int, shelf long, subs long"))  # K rows a dimension at most
    wide = F.create_map(*[F.lit(x) for dim, b in books.items() for x in (dim, len(b.right))]) if books else F.create_map(F.lit(0), F.lit(1))
    shelved = placed.withColumn("right", wide[F.col("dim")]).withColumn("shelf", F.expr("cell div right")).join(split, ["dim", "shelf"])
    dealt = shelved.select("dim", "shelf", F.pmod(F.xxhash64("vec_id", "v"), "subs").alias("sub"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("query"), "v", F.array((F.col("cell") % F.col("right")).cast("int")).alias("cells"))
    # a walk is long: as many tasks as there are partitions
    dealt_out = lambda rows: rows.repartition(parts(entries.sparkSession), "query")
    known = written(dealt_out(asked.where(F.col("dim").isin(list(sizes))).withColumn("kth", F.array().cast("array<double>"))), "queries")
    found, stops = None, [MIDWAY * k, missed * k]
    for n in range(len(stops) + 1):
        walked = known.mapInArrow(_walked(books, counts, enough, stops[:n]), "vec_id long, query long, v array<double>, dim int, shelf long, cells array<int>")
        asking = walked.join(split, ["dim", "shelf"]).withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
        both = dealt.union(asking.select("dim", "shelf", "sub", F.lit(1), "vec_id", "query", "v", "cells")).repartition("dim", "shelf", "sub").sortWithinPartitions("dim", "shelf", "sub", "kind")
        near = written(both.mapInArrow(_reranked(k), "query_id long, query long, vec_id long, score double"), "near")
        found = near if found is None else found.union(near)
        best = ranked(found, k, F.asc("score"), "query").groupBy("query_id", "query").agg(F.when(F.count("*") >= k, F.max("score")).alias("d"))
        best = best.select(F.col("query_id").alias("vec_id"), "query", "d")
        known = dealt_out(known.join(best, ["vec_id", "query"], "left").withColumn("kth", F.concat("kth", F.array("d"))).drop("d"))
    return ranked(found, k, F.asc("score"))
