"""Substring dedup: passages that recur anywhere in the corpus.

A window is ``window`` consecutive words of one document; a window recurs if
its word sequence starts at two places at least.

1. Anchors.  The phrase (``PHRASE`` words) of least hash in a window is its
   anchor.  Equal windows have equal anchors at equal offsets, so a window can
   only recur if its anchor phrase does.  Neighbouring windows mostly share an
   anchor: about one phrase in sixteen is one.  The windows of one anchor
   occurrence are its segment.
2. Confirming.  Phrases are counted over the whole corpus, with the least and
   greatest hash of their segments.  Where these agree, all windows of the
   segment recur; where they differ, the windows are counted one by one.
3. Locating.  Documents are dealt into bundles of bounded bytes.  Each bundle
   gets the recurring phrases that occur in it, compiles them into one
   Aho-Corasick automaton and streams its documents through that.  The sum of
   all automata is bounded by the number of anchors, so the cost stays linear,
   where automata of all phrases for all documents would grow as the square.
4. Removing.  Every word covered by a recurring window goes.

Segments are compared by 64-bit hashes within one phrase, windows by two such hashes
(128 bits) of their words, phrases by
their bytes.  Cases: null, blank and short texts have no window; repeated rows
are occurrences like any other; windows judged are those of the input; an empty
table gives no rows; columns that clash with those added are refused, whatever
their case.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import row_key, unclashing, written
from ._words import Words, mix, pieces, shingles

PHRASE = 4
BUNDLE_BYTES = 2 << 20
HOT, HOT_KEYS = 5_000, 100_000
PIECE = 2 << 20  # bytes of text at a time


class Anchors:
    """Anchor occurrences of a batch: at[i] is the first word of the phrase; its windows start at low[i] to high[i]."""

    def __init__(self, w: Words, window: int, sure: bool = False) -> None:
        h = w.hashes()
        span = window - PHRASE + 1
        none = np.zeros(0, np.int64)
        self.at = self.low = self.high = none
        self.segment = self.windows = self.second = np.zeros(0, np.uint64)
        if len(h) < window:
            return
        best, pos = shingles(h, PHRASE), None
        pos = np.arange(len(best))
        have = 1
        while have < span:  # leftmost minimum of span phrases, by doubling
            step = min(have, span - have)
            left, right = slice(0, len(best) - step), slice(step, None)
            pos = np.where(best[right] < best[left], pos[right], pos[left])
            best = np.minimum(best[left], best[right])
            have += step
        self.windows = shingles(h, window)
        if sure:
            self.second = shingles(mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF)), window)
        count = np.maximum(w.counts() - window + 1, 0)
        total = int(count.sum())
        if not total:
            return
        starts = np.repeat(w.first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
        p = pos[starts]
        new = np.empty(total, bool)
        new[0] = True
        np.not_equal(p[1:], p[:-1], out=new[1:])
        head = np.flatnonzero(new)
        self.at, self.low = p[head], starts[head]
        self.high = starts[np.append(head[1:], total) - 1]
        self.segment = np.add.reduceat(mix(self.windows[starts] + (p - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), head)


def gathered(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The byte ranges as a binary array."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buf[index])])


def _anchor_rows(window: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                w = Words(part.column("text"))
                a = Anchors(w, window)
                if not len(a.at):
                    continue
                last = a.at + PHRASE - 1
                phrase = gathered(w.buf, w.start[a.at], w.start[last] + w.length[last] - w.start[a.at]).dictionary_encode()
                doc = np.searchsorted(w.first, a.at, "right") - 1
                bundle = np.asarray(part.column("bundle"))[doc]
                code = np.asarray(phrase.indices).astype(np.int64)
                order = np.lexsort((bundle, code))
                code, bundle, seg = code[order], bundle[order], a.segment[order].view(np.int64)
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (bundle[1:] != bundle[:-1])
                head = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [phrase.dictionary.take(pa.array(code[head])), pa.array(bundle[head]), pa.array(np.diff(np.append(head, len(code)))), pa.array(np.minimum.reduceat(seg, head)), pa.array(np.maximum.reduceat(seg, head))],
                    ["phrase", "bundle", "n", "low", "high"],
                )

    return run


def _packed(batches):
    """Documents as one space-joined, compressed value each."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in pieces(batch, "text", PIECE):
            w = Words(part.column("text"))
            data = [pack(w.span(w.first[i], w.first[i + 1])) for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([part.column("bundle"), part.column("k1"), part.column("k2"), pa.array(data, pa.binary())], ["bundle", "k1", "k2", "data"])


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges [a, b)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    head = np.flatnonzero(new)
    return a[head], b[np.append(head[1:], len(a)) - 1]


def _located(window: int):
    """Rows sorted by bundle, phrases first: what the automaton of each bundle finds in its documents."""

    def search(automaton, rows):
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(x.as_buffer()) for x in rows.column("data")]
        w = Words(pa.array(texts, pa.binary()))
        a = Anchors(w, window, sure=True)
        ends = w.start + w.length
        out = []
        for i, text in enumerate(texts):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            if hi - lo < window:
                continue
            found = list(automaton.iter(" " + text.decode("latin-1") + " "))
            if not found:
                continue
            end, split = np.array(found, np.int64).T
            word = lo + np.searchsorted(ends[lo:hi] - w.start[lo] + 1, end)
            p = word - PHRASE + 1
            k = np.searchsorted(a.at, p)
            good = (k < len(a.at)) & (a.at[np.minimum(k, len(a.at) - 1)] == p)
            k, split = k[good], split[good].astype(bool)
            if not len(k):
                continue
            whole, open_ = k[~split], k[split]
            x, y = merged(a.low[whole] - lo, a.high[whole] + window - lo) if len(whole) else (whole, whole)
            starts = np.concatenate([np.arange(a.low[j], a.high[j] + 1) for j in open_]) if len(open_) else open_
            out.append((rows.column("k1")[i], rows.column("k2")[i], np.stack([x, y]).astype("<i8").tobytes(), a.windows[starts].view(np.int64), a.second[starts].view(np.int64), starts - lo))
        if out:
            k1, k2, whole, hashes, seconds, starts = zip(*out, strict=True)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in hashes])]).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(ends, np.concatenate(x).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in k1], pa.int64()), pa.array([x.as_py() for x in k2], pa.int64()), pa.array(whole, pa.binary()), listed(hashes), listed(seconds), listed(starts)], ["k1", "k2", "whole", "hashes", "seconds", "starts"])

    def run(batches):
        bundle, automaton, ready = None, None, False
        for batch in batches:
            if not len(batch):
                continue
            b, kind = np.asarray(batch.column("bundle")), np.asarray(batch.column("kind"))
            cut = np.flatnonzero((b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(b)], strict=True):
                if b[i] != bundle:
                    bundle, automaton, ready = b[i], ahocorasick.Automaton(), False
                rows = batch.slice(i, j - i)
                if kind[i] == 0:
                    for phrase, split in zip(rows.column("data").to_pylist(), rows.column("split").to_pylist(), strict=True):
                        automaton.add_word(f" {phrase.decode('latin-1')} ", int(split))
                elif len(automaton):
                    if not ready:
                        automaton.make_automaton()
                        ready = True
                    for k in range(0, len(rows), 256):
                        yield from search(automaton, rows.slice(k, 256))

    return run


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """(k1, k2, whole, starts) for documents with a recurring window: merged word ranges, and starts of further windows."""
    if window < PHRASE + 1:
        raise ValueError(f"a window has more than {PHRASE} words")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bundles = max(1, -(-total // BUNDLE_BYTES))
    keyed = docs.select(*row_key("doc_id", "text"), "text").withColumn("bundle", F.pmod("k1", F.lit(bundles)))
    counted = keyed.select("bundle", "text").mapInArrow(_anchor_rows(window), "phrase binary, bundle long, n long, low long, high long")
    by = "PARTITION BY phrase"
    phrases = (
        counted.repartition("phrase").groupBy("phrase", "bundle").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .selectExpr("phrase", "bundle", f"sum(n) OVER ({by}) AS n", f"min(low) OVER ({by}) <> max(high) OVER ({by}) AS split").where("n > 1")
    )
    packed = keyed.select("bundle", "k1", "k2", "text").mapInArrow(_packed, "bundle long, k1 long, k2 long, data binary")
    both = phrases.select("bundle", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("phrase").alias("data"), "split").union(
        packed.select("bundle", F.lit(1), "k1", "k2", "data", F.lit(False))
    )
    dealt = both.repartition("bundle").sortWithinPartitions("bundle", "kind")
    found = written(dealt.mapInArrow(_located(window), "k1 long, k2 long, whole binary, hashes array<long>, seconds array<long>, starts array<long>"), "located")
    key = ["hashes", "seconds"]
    windows = found.where("size(hashes) > 0").select("k1", "k2", F.explode(F.arrays_zip("hashes", "seconds", "starts")).alias("x")).select("k1", "k2", "x.hashes", "x.seconds", "x.starts")
    again = written(windows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "again")
    # windows that recur so often that they would fill a task go by broadcast: no more than HOT_KEYS can
    often = max(HOT, (again.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(again.where(F.col("n") >= often).select(*key, F.lit(True).alias("hot")))
    told = windows.join(hot, key, "left")
    some = told.where("hot is null").join(again.where(F.col("n") < often).select(*key), key)
    marks = told.where("hot").select("k1", "k2", "starts").union(some.select("k1", "k2", "starts")).select("k1", "k2", F.lit(None).cast("binary").alias("whole"), F.col("starts").alias("start"))
    return found.select("k1", "k2", "whole", F.lit(None).cast("long").alias("start")).union(marks).groupBy("k1", "k2").agg(F.max("whole").alias("whole"), F.collect_set("start").alias("starts"))


def _removed(window: int, fields: list[str]):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                col = part.column("text")
                w = Words(col)
                gone = np.zeros(w.n + 1, np.int64)
                for i, (whole, starts) in enumerate(zip(part.column("whole"), part.column("starts"), strict=True)):
                    lo = w.first[i]
                    if whole.is_valid:
                        x, y = np.frombuffer(whole.as_buffer(), "<i8").reshape(2, -1)
                        np.add.at(gone, lo + x, 1)
                        np.add.at(gone, lo + y, -1)
                    if starts.is_valid and len(starts):
                        x = np.asarray(starts.values)
                        np.add.at(gone, lo + x, 1)
                        np.add.at(gone, lo + x + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                upto = np.concatenate([[0], np.cumsum(gone)])
                removed = np.diff(upto[w.first])
                keep = w.buf[np.repeat(~gone, w.length + 1)]
                ends = np.concatenate([[0], np.cumsum(np.where(gone, 0, w.length + 1))])[w.first]
                kept = [keep[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(f)) for f in fields), pa.array(w.counts()), pa.array(removed), pa.array(kept, pa.binary())], [*fields, "n_words", "n_removed", "kept_words"]
                )

    return run


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_removed and kept_words: what is left, joined by single spaces."""
    unclashing(docs.columns, "n_words", "n_removed", "kept_words", "k1", "k2", "whole", "starts")
    text = docs.withColumn("text", F.col("text").cast("string"))
    marks = repeated_spans(text.select("doc_id", "text"), window)
    rows = text.select("*", *row_key("doc_id", "text")).join(marks, ["k1", "k2"], "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text.schema) + ", n_words long, n_removed long, kept_words binary"
    out = rows.select(*text.columns, "whole", "starts").mapInArrow(_removed(window, text.columns), schema)
    return out.withColumn("kept_words", F.col("kept_words").cast("string"))
