"""Near-duplicate documents by SimHash fingerprints and pivot distance tables.

A document's word shingles, repeats included, are hashed to 64 bits; a bit of
its fingerprint is set where over half the hashes have it.  Documents whose
fingerprints differ in ``REACH`` bits at most are linked, and groups are what
links connect.  Only distinct fingerprints are compared, so exact copies cost
one row each.

1. Tables.  Every distinct fingerprint gets its Hamming distances to ``PIVOTS``
   fixed reference fingerprints, once.  By the triangle inequality the tables
   of a linked pair differ by REACH at most in every place.
2. Buckets.  Tables alone would have every pair looked at, as distances to any
   reference lie close together.  So the bits are cut into five spans; a pair
   within three bits agrees in two spans at least and meets in one of ten
   buckets, each keyed by about 26 bits.
3. Sweeps.  In a bucket, rows are sorted by their first distance and swept until
   these differ by more than REACH; pairs whose tables differ by more anywhere
   are discarded, and survivors are verified bit by bit.  Only links that join
   what is not joined yet come out, so a dense bucket of m rows yields m - 1 at
   most.
4. Large buckets, of over ``BLOCK`` rows, are contracted first: fingerprints
   equal outside three neighbouring bits are linked for certain, which takes a
   grouped minimum.  Those that still hold several groups are cut into blocks,
   and pairs of blocks are swept, so no task holds more than two blocks.

Cases: a null, empty or blank text has the fingerprint zero, which is linked
like any other; a text of fewer words than a shingle is one shingle; repeated
rows are all returned; a null id is never the smallest, so a group without any
other has a null component; ids are whole numbers; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from ._words import Words, pieces
from .components import components

SEED = 42
REACH = 3
PIVOTS = 32
BLOCK = 1024
SPANS = (13, 13, 13, 13, 12)  # bits
REFERENCES = np.random.default_rng(11).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(12).integers(0, 2, PIVOTS, dtype=np.uint64)
STEP = 1 << 16  # hashes whose bits are laid out at a time


def shingle_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' shingles, offsets of the texts in them)."""
    words = w.counts()
    size = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(w.first[:-1] - first[:-1], size) + np.arange(first[-1])
    last = at + np.repeat(np.minimum(words, n), size) - 1
    data, digest = w.buf.tobytes(), xxhash.xxh64_intdigest
    return np.array([digest(data[a:b], SEED) for a, b in zip(w.start[at].tolist(), (w.start[last] + w.length[last]).tolist(), strict=True)], np.uint64), first


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each text; one without hashes has zero."""
    ones = np.zeros((len(first) - 1, 64), np.int64)
    for a in range(0, len(h), STEP):
        b = min(a + STEP, len(h))
        bits = np.unpackbits(h[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero((first[:-1] < b) & (first[1:] > a) & (first[1:] > first[:-1]))
        ones[some] += np.add.reduceat(bits, np.maximum(first[some] - a, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(first)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _described(n: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                made = fingerprints(*shingle_hashes(Words(part.column("text"), lower=True), n))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return run


def _tabled(batches):
    for batch in batches:
        fp = np.asarray(batch.column("fp")).view(np.uint64)
        table = np.bitwise_count(fp[:, None] ^ REFERENCES[None])
        yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("doc_id"), pa.array(table[:, 0].astype(np.int32)), pa.array([row.tobytes() for row in table], pa.binary())], ["fp", "doc_id", "near", "table"])


def _whole_buckets(batches, keys: list[str]):
    """Tables of whole buckets, about a batch each, of a stream sorted by ``keys``."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        now = [np.asarray(batch.column(k)) for k in keys]
        new = np.flatnonzero(reduce(np.logical_or, [c[1:] != c[:-1] for c in now])) + 1
        if held and any(c[0].item() != held[-1].column(k)[len(held[-1]) - 1].as_py() for k, c in zip(keys, now, strict=True)):
            new = np.append(0, new)  # the bucket held so far has ended
        if len(new):
            if held or new[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
            held = []
        held.append(batch.slice(int(new[-1]) if len(new) else 0))
    if held:
        yield pa.Table.from_batches(held)


def sweep(key: np.ndarray, side: np.ndarray, fp: np.ndarray, table: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows of one bucket (key) and different groups, as few as join what is within REACH.

    Rows are sorted by (key, table[:, 0]); side: 0 meets all rows of its bucket, 1 and 2 only meet each other.
    """
    group, out = group.copy(), []
    i, d = np.arange(len(key)), 0
    while len(i):
        d += 1
        i = i[i + d < len(key)]
        i = i[(key[i] == key[i + d]) & (table[i + d, 0] - table[i, 0] <= REACH)]
        j = i + d
        k = (group[i] != group[j]) & ((side[i] != side[j]) | (side[i] == 0))
        a, b = i[k], j[k]
        for p in range(1, table.shape[1], 4):
            near = (np.abs(table[a, p : p + 4] - table[b, p : p + 4]) <= REACH).all(axis=1)
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= REACH
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            if group[x] != group[y]:
                out.append((x, y))
                low, high = np.searchsorted(key, [key[x], key[x] + 1])
                own = group[low:high]
                own[own == group[y]] = group[x]
    return out


def _swept(batches):
    """(a, b): links between the rows of each (key, p, q)."""
    for rows in _whole_buckets(batches, ["bucket", "part", "p", "q"]):
        cols = {c: rows[c].to_numpy() for c in ("bucket", "part", "p", "q", "block", "fp", "component")}
        table = np.frombuffer(b"".join(rows["table"].to_pylist()), np.uint8).reshape(rows.num_rows, -1).astype(np.int8)
        new = np.zeros(rows.num_rows, np.int64)
        new[1:] = reduce(np.logical_or, [cols[k][1:] != cols[k][:-1] for k in ("bucket", "part", "p", "q")])
        side = np.where(cols["p"] == cols["q"], 0, np.where(cols["block"] == cols["p"], 1, 2))
        found = sweep(np.cumsum(new), side, cols["fp"].view(np.uint64), table, cols["component"])
        if found:
            x, y = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(cols["fp"][x]), pa.array(cols["fp"][y])], ["a", "b"])


def _and(column: str, bits: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(bits - (1 << 64) if bits >> 63 else bits))


def _masks() -> list[int]:
    at = np.concatenate([[0], np.cumsum(SPANS)]).tolist()
    spans = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(at, at[1:], strict=False)]
    return [x | y for x, y in combinations(spans, 2)]


def _certain(some: DataFrame) -> DataFrame:
    """(a, b): fingerprints equal but for REACH neighbouring bits, each with the least of its kind."""
    masks = [((1 << 64) - 1) ^ (((1 << REACH) - 1) << at & ((1 << 64) - 1)) for at in range(0, 64, REACH)]
    spread = some.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("mask"), _and("fp", m).alias("rest")) for n, m in enumerate(masks)])).alias("k")).select("fp", "k.*")
    least = spread.groupBy("mask", "rest").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").drop("most")
    return spread.join(least, ["mask", "rest"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (bucket, part, c, ...) as pairs p <= q of blocks of their bucket, sorted for the sweep."""
    cut = rows.withColumn("blocks", F.expr(f"(c + {BLOCK - 1}) div {BLOCK}")).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    keys = ["bucket", "part", "p", "q"]
    return spread.select(*keys, "block", "fp", "near", "table", "component").repartition(*keys).sortWithinPartitions(*keys, "near")


def near_duplicates(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text, ...); fp: the fingerprint as a signed long."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(docs.mapInArrow(_described(n), "doc_id long, fp long"), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).mapInArrow(_tabled, "fp long, doc_id long, near int, table binary"), "pivots")

    kinds = F.array(*[F.struct(F.lit(b).alias("bucket"), _and("fp", m).alias("part")) for b, m in enumerate(_masks())])
    spread = nodes.select("fp", F.explode(kinds).alias("k")).select("fp", "k.*")
    counts = spread.groupBy("bucket", "part").agg(F.count("*").alias("c")).where("c > 1")
    buckets = written(spread.join(counts, ["bucket", "part"]), "buckets")
    swept = lambda held: _dealt(held).mapInArrow(_swept, "a long, b long")
    tabled = lambda held: held.join(nodes.select("fp", "near", "table"), "fp")
    small = swept(tabled(buckets.where(F.col("c") <= BLOCK)).withColumn("component", F.col("fp")))

    hot = buckets.where(F.col("c") > BLOCK)
    certain = written(_certain(hot.select("fp").distinct()), "certain")
    owner = components(certain)
    held = hot.join(owner.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    several = held.groupBy("bucket", "part").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket", "part")
    large = swept(tabled(held.join(several, ["bucket", "part"])))

    links = written(small.union(large).union(certain), "links")
    grouped = nodes.select("fp", "doc_id").join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(grouped.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
