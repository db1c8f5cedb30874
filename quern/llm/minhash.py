"""Near-duplicate documents by min-max hashing.

Each document is the set of its distinct word shingles.  Every permutation
yields the least and the greatest hash of the set, so ``permutations`` hash
evaluations fill a signature twice as long.  Rows of the signature form bands;
documents that share a band are candidates, and every link is confirmed on the
full sets.  With 64 permutations in 32 bands of 4, a pair at a similarity of
exactly 0.75 goes unseen with a probability of 6e-6, a closer one with less.

Candidates are not spread into all pairs.  Documents with equal sets are one
node.  First each node meets one hub, the least node that it shares most buckets
with, and what this confirms is contracted.  Buckets that still hold nodes of different components
are cut into blocks, and pairs of blocks are compared inside a task: first the
signatures (a pair agreeing in less than 0.55 of 128 values is at 0.75 with a
probability of 1e-7), then the full sets of the nodes that have a plausible
partner.  Only links that join two components come out, so no pair is ever a
row, and no task holds more than two blocks.

Cases: a null or blank text has no shingles, links with nothing and is its own
component; a text of fewer words than a shingle is one shingle; rows with the
same id and text are all kept or all dropped together; a null id is never the
smallest, so such a row stays only if its component has no other id; ids are
whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import unclashing, written
from ._words import Words, mix, pieces, shingles
from .components import components, roots
from .vectors import groups


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(all sets' sorted distinct hashes, offsets) of a batch of texts."""
    w = Words(column, lower=True)
    h, all_ = w.hashes(), None
    all_ = shingles(h, n)
    sets, sizes = [], np.zeros(len(column) + 1, np.int64)
    for i in range(len(column)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= n:
            s = np.sort(all_[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif b > a:
            s = shingles(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            continue
        sets.append(s)
        sizes[i + 1] = len(s)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(sizes)


def signatures(h: np.ndarray, first: np.ndarray, permutations: int, seed: int = 10) -> np.ndarray:
    """(sets, 2 * permutations): minima and maxima; every set must have an element."""
    rng = np.random.default_rng(seed)
    by = rng.integers(0, 1 << 63, (permutations, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(first) - 1, 2 * permutations), np.uint64)
    step = 1 << 15
    i = 0
    while i < len(first) - 1:  # blocks that stay in cache
        j = max(i + 1, int(np.searchsorted(first, first[i] + step, "right")) - 1)
        part, at = h[first[i] : first[j]], (first[i:j] - first[i]).astype(np.intp)
        v = np.empty_like(part)
        for k in range(permutations):
            np.bitwise_xor(part, by[k, 0], out=v)
            v *= by[k, 1]
            out[i:j, 2 * k] = np.minimum.reduceat(v, at)
            out[i:j, 2 * k + 1] = np.maximum.reduceat(v, at)
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands) keys; a band takes its rows from different permutations."""
    n, width = signature.shape
    rows = width // bands
    order = np.arange(width).reshape(rows, bands)  # row r of band b: r * bands + b
    keys = np.empty((n, bands), np.uint64)
    for b in range(bands):
        key = np.full(n, np.uint64(b + 1))
        for r in range(rows):
            key *= np.uint64(0xD6E8FEB86659FD93)
            key += signature[:, order[r, b]]
        keys[:, b] = mix(key)
    return keys


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _describe(n: int, permutations: int, bands: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                h, first = shingle_sets(part.column("text"), n)
                size = np.diff(first)
                full = np.flatnonzero(size)
                starts = np.append(first[:-1][full], first[-1])
                fp = np.zeros((2, len(part)), np.uint64)
                keys, brief = np.zeros((0, bands), np.uint64), [None] * len(part)
                if len(full):
                    fp[0, full] = np.add.reduceat(mix(h.copy()), starts[:-1])
                    fp[1, full] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF)), starts[:-1])
                    sig = signatures(h, starts, permutations)
                    keys = band_keys(sig, bands)
                    low = (sig >> np.uint64(20)).astype(np.uint8)
                    for i, row in zip(full, low, strict=True):
                        brief[i] = row.tobytes()
                ends = np.zeros(len(part) + 1, np.int32)
                ends[1:] = np.cumsum(np.where(size > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tkey"), pa.array(size), pa.array(_signed(fp[0])), pa.array(_signed(fp[1])), pa.ListArray.from_arrays(ends, _signed(keys.ravel())), pa.array(brief, pa.binary())],
                    ["doc_id", "tkey", "n_shingles", "fp1", "fp2", "bands", "brief"],
                )

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                h, first = shingle_sets(part.column("text"), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([h[first[i] : first[i + 1]].tobytes() for i in range(len(part))], pa.binary())], ["node", "set"]
                )

    return run


def _confirm(similarity: int):
    def run(batches):
        for batch in batches:
            x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("set_x", "set_y"))
            keep = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                p, q = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                both = np.sort(np.concatenate([p, q]))
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * same >= similarity * (len(p) + len(q) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep))

    return run


def _joined(batches, use):
    """use(rows) for the rows of each (key, p, q), gathered over batches."""
    key, held = None, []
    for now, part in groups(batches, ["key", "p", "q"]):
        if now != key and held:
            yield from use(key, pa.Table.from_batches(held).combine_chunks())
            held = []
        key = now
        held.append(part)
    if held:
        yield from use(key, pa.Table.from_batches(held).combine_chunks())


def _fits(n: np.ndarray, m: np.ndarray, similarity: int) -> np.ndarray:
    return np.minimum(n[:, None], m[None]) * 100 >= np.maximum(n[:, None], m[None]) * similarity


def _plausible(similarity: int):
    """Rows of nodes that agree enough with one of another component."""

    def use(key, rows):
        node, own, n, block = (np.asarray(rows[c]) for c in ("node", "component", "n", "block"))
        brief = np.frombuffer(b"".join(rows["brief"].to_pylist()), np.uint8).reshape(len(node), -1)
        x, y = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        need = int(0.55 / 0.75 * similarity / 100 * brief.shape[1])
        hit_x, hit_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for a in range(0, len(x), 64):
            part = x[a : a + 64]
            same = (brief[part][:, None] == brief[y][None]).sum(axis=2)
            good = (same >= need) & (own[part][:, None] != own[y][None]) & _fits(n[part], n[y], similarity)
            hit_x[a : a + 64] |= good.any(axis=1)
            hit_y |= good.any(axis=0)
        found = np.union1d(x[hit_x], y[hit_y])
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key[0])), pa.array(node[found]), pa.array(own[found]), pa.array(n[found]), pa.array(np.asarray(rows["m"])[found])], ["key", "node", "component", "n", "m"])

    return lambda batches: _joined(batches, use)


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sets x with sets y."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [a, a + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[i:j], column[i:j] - a] = 1
        out += dense[x] @ dense[y].T
    return out.astype(np.int64)


def _crossing(similarity: int):
    """Links (a, b) between different components (root_a, root_b), as many as it takes to join them."""

    def use(key, rows):
        node, own, n, block = (np.asarray(rows[c]) for c in ("node", "component", "n", "block"))
        sets = [np.frombuffer(s, np.uint64) for s in rows["set"].to_pylist()]
        x, y = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        both = overlaps(sets, x, y)
        good = (100 * both >= similarity * (n[x][:, None] + n[y][None] - both)) & (own[x][:, None] != own[y][None])
        up: dict[int, int] = {}

        def root(c):
            while up.get(c, c) != c:
                c = up[c]
            return c

        out = []
        for i, j in zip(*np.nonzero(good), strict=True):
            p, q = root(int(own[x[i]])), root(int(own[y[j]]))
            if p != q:
                up[p] = q
                out.append((int(node[x[i]]), int(node[y[j]]), int(own[x[i]]), int(own[y[j]])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "root_a", "root_b"])

    return lambda batches: _joined(batches, use)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (key, node, m, ...) dealt out as pairs p <= q of blocks of their key; ``block`` is a row's own, ``m`` how many rows the key has."""
    cut = rows.withColumn("blocks", F.expr(f"(m + {size - 1}) div {size}")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), *[c for c in cut.columns if c != "blocks"])
    return spread.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def _links(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The (x, y) pairs whose full sets are similar enough, as edges (a, b)."""
    rows = pairs.join(sets.select(F.col("node").alias("y"), F.col("set").alias("set_y")), "y").join(sets.select(F.col("node").alias("x"), F.col("set").alias("set_x")), "x")
    return rows.select("x", "y", "set_x", "set_y").mapInArrow(_confirm(similarity), "x long, y long").select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(docs: DataFrame, n: int = 5, similarity: int = 75, permutations: int = 64, bands: int = 32) -> DataFrame:
    """(doc_id, tkey, n_shingles, component_id, kept) for each row of docs (doc_id, text, ...).

    ``similarity`` is in hundredths; ``tkey`` is xxhash64 of the text.
    """
    return _grouped(docs, n, similarity, permutations, bands).drop("component")


def _grouped(docs: DataFrame, n: int = 5, similarity: int = 75, permutations: int = 64, bands: int = 32) -> DataFrame:
    """near_duplicates with ``component``, the group's own number (null for a text without words)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("tkey", F.xxhash64("text"))
    rows = written(docs.mapInArrow(_describe(n, permutations, bands), "doc_id long, tkey long, n_shingles long, fp1 long, fp2 long, bands array<long>, brief binary"), "signatures")
    some = rows.where("n_shingles > 0")
    nodes = some.groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("r"), F.first("bands").alias("bands"), F.first("brief").alias("brief"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "fp1", "fp2", "n_shingles", "r.doc_id", "r.tkey", "bands", "brief"), "nodes")
    spread = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min(F.struct("node", "n")).alias("low"), F.count("*").alias("c")).where("c > 1").select("key", F.col("low.node").alias("hub"), F.col("low.n").alias("hub_n"))
    buckets = written(spread.join(shared, "key"), "buckets")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "doc_id", "tkey"), "node")
    texts = docs.join(wanted.select("node", F.col("doc_id").alias("d"), F.col("tkey").alias("tkey")), "tkey").where("d <=> doc_id").select("node", "text").dropDuplicates(["node"])
    sets = written(texts.mapInArrow(_sets(n), "node long, set binary"), "sets", compression="uncompressed")

    # one hub for each node: the one it shares most buckets with
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * similarity
    best = buckets.where("node <> hub").where(fits).groupBy("node", "hub").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "hub")).alias("m"))
    links = _links(best.select(F.col("m.hub").alias("x"), F.col("node").alias("y")), sets, similarity)
    owner = roots(links.select(F.col("b").alias("node"), F.col("a").alias("parent")))

    # what is left: nodes of different components in one bucket
    held = buckets.select("key", "node", "n").join(owner, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    several = held.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("m")).where("p < q").select("key", "m")
    held = held.join(several, "key").join(nodes.select("node", "brief"), "node")
    near = written(_blocks(held, 1024).mapInArrow(_plausible(similarity), "key long, node long, component long, n long, m long").distinct(), "plausible")
    more = _blocks(near.join(sets, "node"), 512).mapInArrow(_crossing(similarity), "a long, b long, root_a long, root_b long")
    more = written(more, "crossing").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    merged = components(more)
    owner = owner.join(merged.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("node", F.coalesce("whole", "component").alias("component")).union(merged)

    placed = nodes.select("node", "fp1", "fp2", F.col("n_shingles").alias("size"), "doc_id").join(owner, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(least, "component").select("fp1", "fp2", F.col("size").alias("n_shingles"), "component_id", "component")
    joined = some.drop("bands").join(placed, ["fp1", "fp2", "n_shingles"]).select("doc_id", "tkey", "n_shingles", "component_id", "component")
    empty = rows.where("n_shingles = 0").select("doc_id", "tkey", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return joined.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row of docs for each group, of its least doc_id (null ids last), and each text without words once; all columns stay.

    Columns named _t, _d or _n are refused.
    """
    from pyspark.sql import Window

    unclashing(docs.columns, "_t", "_d", "_n")
    rows = _grouped(docs, **how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("r")
    kept = rows.where("component is not null").groupBy("component").agg(first).select("r.doc_id", "r.tkey").union(rows.where("component is null").select("doc_id", "tkey"))
    kept = kept.select(F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")).distinct()
    keyed = docs.withColumn("_t", F.xxhash64(F.col("text").cast("string")))
    rows = keyed.join(kept, "_t").where("_d <=> doc_id")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("_t", "_d").orderBy(*[F.col(c) for c in docs.columns if c != "text"]))).where("_n = 1").select(*docs.columns)
