"""Spelling variants: words one edit apart, grouped under the commonest form.

1. Counts.  Tasks count runs of letters in whole texts; one run in ``SLIP`` of
   those of a document, by its hash, loses a letter (the contract's slips).
2. Tries.  The words kept are range-sorted and cut into shards of ``SHARD`` words
   at most.  A shard is a compact trie: a byte a node for its letter, four for its
   first child, eight for its count.  There is a second set of shards over the
   words written backwards.
3. Walks.  Shards are broadcast in waves of ``WAVE_BYTES`` at most.  A word's
   distance-one Levenshtein automaton is intersected with every shard depth
   first.  Before the edit it has a single live state, so it goes down one path;
   at each node it may replace, insert or drop a letter, after which the rest
   of the word must follow.  Two near words differ first in the latter half of
   the one that asks, and are found forwards with the former half fixed, or in
   the former half, and are found backwards with the latter half fixed.  So the
   automaton is dead at once in any shard without its fixed half, a wave is only
   shown the words whose fixed half lies in its range, and work grows with the
   words, not with words times shards.  Each near word is emitted once.
4. Reduce.  Each walk yields a word's count of near words and the best of them;
   these are summed over waves.  Forms are followed to their end by pointer
   jumping: counts at least double with each step, so there are no circles.

Letters are those of ``LETTERS`` (one byte each in Latin-1), whose byte order is
their code-point order.

Cases: null and empty texts have no runs; a null doc_id hashes as an empty one;
repeated rows count each; a word without near words has n_near 0 and is its own
root; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import parts, written
from ._words import pieces
from .components import roots

SLIP = 97
SHARD = 1 << 15  # words
WAVE_BYTES = 16 << 20
LETTERS = re.compile(rb"[a-z\xc0-\xff]+")
OTHER = re.compile(rb"[^a-z\xc0-\xff]")
LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))
SLICE = 1 << 20  # bytes of a text matched at a time
HELD = 200_000  # distinct words that a task holds before it hands them on


def runs(text: str) -> Counter:
    """Lower-cased runs of letters (Latin-1) of a text with their counts."""
    data = text.encode("latin-1", "replace").translate(LOWER)
    found: Counter = Counter()
    a = 0
    while a < len(data):
        cut = OTHER.search(data, a + SLICE)
        b = cut.start() if cut else len(data)
        found.update(LETTERS.findall(data, a, b))
        a = b
    return found


def slipped(run: bytes, start: int) -> bytes:
    """The run, or what is left of it if its hash says that it loses a letter; start: crc32 of the document's prefix."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    return run if h % SLIP else run[: (at := h % len(run))] + run[at + 1 :]


def _counted(least: int):
    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for part in pieces(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    start = crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                    for word, n in runs(text or "").items():
                        word = slipped(word, start)
                        if len(word) >= least:
                            held[word] += n
                if len(held) > HELD:
                    yield _rows(held)
                    held = Counter()
        yield _rows(held)

    return run


def _rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def packed(words: list[bytes], counts: list[int]) -> bytes:
    """A trie of sorted distinct words: its nodes by level, children of a node side by side in the order of their letters."""
    letter, first, count = bytearray(b"\0"), array("I"), array("q")
    level = [(0, len(words))]
    depth, size = 0, 1
    while level:
        below = []
        for a, b in level:
            first.append(size)
            own = a < b and len(words[a]) == depth
            count.append(counts[a] if own else 0)
            a += own
            while a < b:
                c, z = words[a][depth], a + 1
                while z < b and words[z][depth] == c:
                    z += 1
                letter.append(c)
                below.append((a, z))
                size += 1
                a = z
        level, depth = below, depth + 1
    first.append(size)
    return len(letter).to_bytes(4, "little") + bytes(letter) + first.tobytes() + count.tobytes()


class Trie:
    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.letter = blob[4 : 4 + size]
        self.first, self.count = array("I"), array("q")
        self.first.frombytes(blob[4 + size : 8 + 5 * size])
        self.count.frombytes(blob[8 + 5 * size :])

    def down(self, node: int, word: bytes, at: int) -> int:
        """The node that word[at:] leads to from node, or 0."""
        letter, first = self.letter, self.first
        for i in range(at, len(word)):
            node = letter.find(word[i], first[node], first[node + 1])
            if node < 0:
                return 0
        return node

    def near(self, word: bytes, fixed: int):
        """(near word, count) of each word one edit away that starts with word[:fixed] and first differs behind it."""
        letter, first, count = self.letter, self.first, self.count
        node = self.down(0, word[:fixed], 0)
        if fixed and not node:
            return
        for i in range(fixed, len(word) + 1):
            own = word[i] if i < len(word) else -1
            for child in range(first[node], first[node + 1]):
                if (c := letter[child]) == own:
                    continue
                # replaced, then inserted; a letter equal to the next one would be the same word inserted later
                if own >= 0 and (end := self.down(child, word, i + 1)) and count[end]:
                    yield word[:i] + bytes((c,)) + word[i + 1 :], count[end]
                if (end := self.down(child, word, i)) and count[end]:
                    yield word[:i] + bytes((c,)) + word[i:], count[end]
            if own < 0:
                return
            if (i + 1 == len(word) or word[i + 1] != own) and (end := self.down(node, word, i + 1)) and count[end]:
                yield word[:i] + word[i + 1 :], count[end]
            node = letter.find(own, first[node], first[node + 1])
            if node < 0:
                return


def _sharded(batches):
    """A row a shard: (low, high, blob) of sorted rows (key, n)."""

    def shard(keys, counts):
        words = [k.encode("latin-1") for k in keys]
        return pa.RecordBatch.from_arrays([pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([packed(words, counts)], pa.binary())], ["low", "high", "blob"])

    keys, counts = [], []
    for batch in batches:
        keys += batch.column("key").to_pylist()
        counts += batch.column("n").to_pylist()
        while len(keys) >= SHARD:
            yield shard(keys[:SHARD], counts[:SHARD])
            keys, counts = keys[SHARD:], counts[SHARD:]
    if keys:
        yield shard(keys, counts)


def _walked(wave, backwards: bool):
    """(word, n_near, best): the near words in the wave's shards of each word shown, and the best of them."""

    def run(batches):
        shards = wave.value
        trie = lru_cache(2)(lambda s: Trie(shards[s][2]))
        for batch in batches:
            out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
            rows = sorted(zip(batch.column("fixed").to_pylist(), batch.column("word").to_pylist(), strict=True))
            at = 0
            for fixed, word in rows:
                plain = word.encode("latin-1")
                asked, half = plain[::-1] if backwards else plain, len(fixed)
                while at < len(shards) and shards[at][1] < fixed and not shards[at][1].startswith(fixed):
                    at += 1
                number, best_n, best = 0, 0, b""
                for s in range(at, len(shards)):
                    if shards[s][0] > fixed and not shards[s][0].startswith(fixed):
                        break
                    for near, n in trie(s).near(asked, half):
                        if backwards:
                            near = near[::-1]
                            if near[: len(plain) // 2] == plain[: len(plain) // 2]:
                                continue  # found forwards
                        number += 1
                        if n > best_n or (n == best_n and near < best):
                            best_n, best = n, near
                if number:
                    for name, value in zip(out, (word, number, best_n, best.decode("latin-1")), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["word"], pa.string()), pa.array(out["n_near"], pa.int64()), pa.array(out["best_n"], pa.int64()), pa.array(out["best"], pa.string())], list(out))

    return run


def _waves(shards: DataFrame):
    """Lists of neighbouring shards (low, high, blob) of WAVE_BYTES at most (one shard at least); the driver holds one partition of shards and one wave."""
    wave, size = [], 0
    for r in shards.toLocalIterator():
        if wave and size + len(r["blob"]) > WAVE_BYTES:
            yield wave
            wave, size = [], 0
        wave.append((r["low"], r["high"], bytes(r["blob"])))
        size += len(r["blob"])
    if wave:
        yield wave


def _near(words: DataFrame, backwards: bool) -> DataFrame:
    """(word, n_near, best_n, best) partial rows: the near words found in this direction."""
    spark = words.sparkSession
    half = F.expr("char_length(word) div 2")
    key = F.reverse("word") if backwards else F.col("word")
    size = F.char_length("word") - half if backwards else half
    keyed = words.select(key.alias("key"), "word", "n").withColumn("fixed", F.substring("key", F.lit(1), size))
    way = "backwards" if backwards else "forwards"
    keyed = written(keyed.repartitionByRange("key").sortWithinPartitions("key"), f"words-{way}")
    shards = written(keyed.select("key", "n").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_sharded, "low string, high string, blob binary"), f"tries-{way}", compression="uncompressed")
    found = None
    for wave in _waves(shards.orderBy("low")):
        low, high = wave[0][0], wave[-1][1]
        shown = keyed.where((F.col("fixed") <= high) & ((F.col("fixed") >= low) | F.lit(low).startswith(F.col("fixed"))))
        shown = shown.select("fixed", "word").repartition(parts(spark), F.xxhash64("word"))
        held = spark.sparkContext.broadcast(wave)  # WAVE_BYTES at most
        one = written(shown.mapInArrow(_walked(held, backwards), "word string, n_near long, best_n long, best string"), f"near-{way}")
        held.unpersist()
        found = one if found is None else found.union(one)
    return found


def variants(docs: DataFrame, least: int = 5, seen: int = 3, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of docs (doc_id, text, ...) of ``least`` letters and ``seen`` occurrences at least.

    form: the near word of largest count, if that is ``times`` the word's own at least.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = docs.mapInArrow(_counted(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)
    words = written(words, "words")
    found = [x for x in (_near(words, False), _near(words, True)) if x is not None]
    if not found:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"), F.col("word").alias("root"))
    near = found[0] if len(found) == 1 else found[0].union(found[1])
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("best"))
    formed = -F.col("best.less") >= times * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    rows = written(rows, "forms")
    ends = roots(rows.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("parent")))
    return rows.join(ends.select(F.col("node").alias("word"), F.col("component").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))
