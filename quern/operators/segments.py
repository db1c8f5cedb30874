"""Segments of texts between pauses, and which segment a chunk comes from."""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_right
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: how times stand in lines of messages
SAID_AT = re.compile(r"\*\*[^*]+\*\*\s*\((?:[\d/]+ )?(\d{1,2}):(\d{2})\s*([AaPp])[Mm]\)")
DATED = re.compile(r"date:\s*(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})")
DAY = 24 * 60


def minute(line: str) -> int | None:
    """The time that a line tells, in minutes: of an unnamed day, or since 1900."""
    if m := SAID_AT.search(line):
        hour, past = int(m[1]), int(m[2])
        return hour % 12 * 60 + past + (DAY // 2 if m[3] in "Pp" else 0) if 1 <= hour <= 12 and past < 60 else None
    if m := DATED.search(line):
        year, month, day, hour, past = map(int, m.groups())
        try:
            at = dt.datetime(year, month, day, hour, past)
        except ValueError:
            return None
        return int((at - dt.datetime(1900, 1, 1)).total_seconds()) // 60
    return None


def cut(text: str, gap: int = 120) -> list[str]:
    """The parts of a text between messages ``gap`` minutes or more apart.

    A time before the last one is of the next day. Blank and comment lines in front of a message go with it. A text with
    fewer than two times, or without a pause, is one part as it is.
    """
    lines = text.split("\n")
    told = [(i, at) for i, line in enumerate(lines) if (at := minute(line)) is not None]
    bounds = [0]
    for (_, before), (i, at) in pairwise(told):
        if (at - before if at >= before else at - before + DAY) >= gap:
            while i > bounds[-1] and (not (above := lines[i - 1].strip()) or above.startswith("<!--")):
                i -= 1
            bounds.append(i)
    if len(bounds) == 1:
        return [text]
    parts = ["\n".join(lines[a:b]).strip() for a, b in pairwise([*bounds, len(lines)])]
    return [p for p in parts if p] or [text]


def segments(docs: DataFrame, key: str, text: str, gap: int = 120) -> DataFrame:
    """(key, segment, segment_text) of each text, by a table function; null texts have none."""

    class Cut:
        def eval(self, said: str, minutes: int):
            if said is not None:
                yield from enumerate(cut(said, minutes))

    made = F.udtf(Cut, returnType="segment int, segment_text string")
    return docs.select(key, text).lateralJoin(made(F.col(text).outer(), F.lit(gap))).select(key, "segment", "segment_text")


# which segment a chunk comes from

HEAD = 200  # characters of a chunk that are looked for
GRAM = 12
LEVELS = (200, 64, 24)  # a chunk shorter than the last is looked up as a whole


def anchors(text: str, width: int) -> dict[int, int]:
    """{place: hash} of the GRAMs that are the least of some ``width`` characters; of equal ones the leftmost."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(code) - GRAM + 1
    span = width - GRAM + 1
    if n < span:
        return {}
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    best, at, have = h, np.arange(n), 1
    while have < span:  # the leftmost least of span grams, by doubling
        step = min(have, span - have)
        at = np.where(best[step:] < best[:-step], at[step:], at[:-step])
        best = np.minimum(best[step:], best[:-step])
        have += step
    return {int(p): int(h[p].view(np.int64)) for p in np.unique(at)}


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("hash", T.LongType())])))
def _anchors(texts: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([[{"place": p, "hash": h} for p, h in anchors(t, w).items()] for t, w in zip(texts, widths, strict=True)])


def holding(chunks: DataFrame, parts: DataFrame, key: str | None = "doc") -> DataFrame:
    """(key, chunk, segment): the first segment of parts (key, segment, segment_text) that holds the first HEAD characters of a chunk (key, chunk, chunk_text).

    Equal strings have equal anchors at equal distances, so heads and segments are joined on these and confirmed by their
    characters; heads under the shortest level are joined with all pieces of their length. Both grow with the texts, not
    with chunks times segments. Without a key, chunks are looked for in all parts.
    """
    own = [key] if key else []
    # what is asked for: by key, or a few widths and lengths for all parts
    wanted = lambda rows, asked, *c: rows.join(asked.select(*own, *c).distinct(), own) if own else rows.crossJoin(F.broadcast(asked.select(*c).distinct()))
    head = chunks.select(*own, "chunk", F.substring("chunk_text", 1, HEAD).alias("head")).withColumn("size", F.char_length("head"))
    level = F.coalesce(*[F.when(F.col("size") >= w, w) for w in LEVELS])
    asked = head.withColumn("width", level).where("width is not null")
    asked = asked.withColumn("a", F.get(_anchors(F.expr("substring(head, 1, width)"), F.col("width")), F.lit(0)))
    held = wanted(parts.where("segment_text is not null"), asked, "width").withColumn("a", F.explode(_anchors("segment_text", "width")))
    near = asked.select(*own, "chunk", "head", "size", "width", F.col("a.hash").alias("hash"), F.col("a.place").alias("place")).join(held.select(*own, "segment", "width", F.col("a.hash").alias("hash"), F.col("a.place").alias("at")), [*own, "width", "hash"])
    # texts come back for the pairs that met: beside each anchor they would fill the disk
    near = near.where("at >= place").join(parts.select(*own, "segment", "segment_text"), [*own, "segment"])
    near = near.where((F.col("at") >= F.col("place")) & (F.col("segment_text").substr(F.col("at") - F.col("place") + 1, F.col("size")) == F.col("head"))).select(*own, "chunk", "segment")
    tiny = head.where(f"size < {LEVELS[-1]} and size > 0")
    pieces = wanted(parts, tiny, "size").where("char_length(segment_text) >= size")
    pieces = pieces.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("segment_text") - F.col("size") + 1)))
    whole = pieces.select(*own, "segment", F.expr("substring(segment_text, at, size)").alias("head")).distinct().join(tiny.select(*own, "chunk", "head"), [*own, "head"]).select(*own, "chunk", "segment")
    first = parts.groupBy(*own).agg(F.min("segment").alias("segment"))
    empty = head.where("size = 0").select(*own, "chunk")
    none = (empty.join(first, own) if own else empty.crossJoin(F.broadcast(first))).select(*own, "chunk", "segment")  # one row without a key
    return near.union(whole).union(none).groupBy(*own, "chunk").agg(F.min("segment").alias("segment"))


#: fixed values: what parts words, and what is cut off at both ends before (blanks, as DuckDB's trim has them)
BETWEEN = re.compile(r"[\t\n\f\r ]+")
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SCANNED = 1 << 28  # characters that heads are looked for in, one by one; beyond, places are hashed
BLOCK = 1 << 20
HELD = -1_000_000  # the rank of a segment that holds the head; of others it is minus the shared words


def _hashes(code: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` characters; equal runs have equal ones."""
    power = np.full(len(code), 0x9E3779B97F4A7C15, np.uint64)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    back = np.full(len(code), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
    back[:1] = 1
    back = np.multiply.accumulate(back)
    # spread, as letters lie close together
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) * power)])
    return (sums[size:] - sums[:-size]) * back[: len(code) - size + 1]


def places(whole: str, heads: set[str]) -> dict[str, int]:
    """Where each head that stands in a text stands first, however long the text and however many the heads."""
    if len(whole) * len(heads) <= SCANNED:
        return {h: at for h in heads if (at := whole.find(h)) >= 0}
    codes = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    wanted: dict[int, dict[int, list[str]]] = {}
    for h in heads:
        if h:
            wanted.setdefault(len(h), {}).setdefault(int(_hashes(codes(h), len(h))[0]), []).append(h)
    out = {"": 0} if "" in heads else {}
    for begin in range(0, len(whole), BLOCK):
        code = codes(whole[begin : begin + BLOCK + max(wanted, default=1) - 1])
        for size, asked in wanted.items():
            if len(code) < size or not asked:
                continue
            h = _hashes(code, size)[:BLOCK]
            hits = np.flatnonzero(np.isin(h, np.fromiter(asked, np.uint64, len(asked))))
            values, first = np.unique(h[hits], return_index=True)
            for value, i in zip(values.tolist(), hits[first].tolist(), strict=True):
                for head in asked.pop(value):  # the rare other text of equal hash is looked for plainly
                    at = begin + i if whole.startswith(head, begin + i) else whole.find(head)
                    out |= {head: at} if at >= 0 else {}
    return out


def which(chunks: list[str | None], parts: list[str | None]) -> list[tuple[int, int]]:
    """(rank, place) of the part that each chunk belongs to; the texts of one document, which has a part at least.

    The first that holds the chunk's first HEAD characters, else the first of those that share most words, else the first.
    Words are the first 50 of a chunk and the first 200 of a part.
    """
    heads = [None if c is None else c[:HEAD] for c in chunks]
    mark = "\ud800" if any("\0" in x for x in (*heads, *parts) if x) else "\0"  # stands in no head
    starts = list(accumulate((len(p or "") + 1 for p in parts), initial=0))
    at = places(mark.join(p or "" for p in parts), {h for h in heads if h is not None})
    found = [(HELD, bisect_right(starts, at[h]) - 1) if h in at else None for h in heads]
    if all(found):
        return found
    words = lambda x, n: set() if x is None else set(BETWEEN.split(x.strip(BLANKS), n)[:n])
    asked = {i: words(chunks[i], 50) for i, f in enumerate(found) if f is None}
    own = [words(p, 200) for p in parts]
    if len(asked) * len(own) < 4096:
        for i, w in asked.items():
            shared = [len(w & o) for o in own]
            found[i] = (-max(shared), shared.index(max(shared)))
        return found
    lists: dict[str, list[int]] = {w: [] for v in asked.values() for w in v}
    for k, o in enumerate(own):
        for w in o & lists.keys():
            lists[w].append(k)
    having = {w: np.array(v, np.int64) for w, v in lists.items()}
    for i, w in asked.items():
        shared = np.zeros(len(own), np.int32)
        for x in w:
            shared[having[x]] += 1
        found[i] = (-int(shared.max()), int(shared.argmax()))
    return found


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("place", T.IntegerType())])))
def _which(chunks: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([[{"rank": r, "place": p} for r, p in which(list(c), list(s))] if len(s) else None for c, s in zip(chunks, parts, strict=True)], dtype="object")


def best_of(rows: DataFrame) -> DataFrame:
    """(doc, chunk, segment) of documents (doc, chunks: (chunk, chunk_text), parts in order: (segment, segment_text)), a row each."""
    rows = rows.where("doc is not null").withColumn("found", _which("chunks.chunk_text", "parts.segment_text"))
    # of chunks of one number, the best counts
    best = lambda f: F.struct(f["rank"].alias("rank"), F.get("parts.segment", f["place"]).alias("segment"))
    found = rows.select("doc", F.zip_with("chunks.chunk", F.transform("found", best), lambda c, b: F.struct(c.alias("chunk"), b.alias("best"))).alias("x"))
    numbers = F.array_distinct("x.chunk")
    once = F.when(F.size(numbers) == F.size("x"), F.col("x")).otherwise(F.transform(numbers, lambda n: F.array_min(F.filter("x", lambda y: y["chunk"] == n))))
    return found.select("doc", F.explode(once).alias("x")).select("doc", "x.chunk", "x.best.segment")


def best_segment(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc, chunk, segment) of chunks (doc, chunk, chunk_text) and parts (doc, segment, segment_text), as ``which`` has it.

    A document's texts come together in one row, whose pieces are looked up in each other there.
    """
    one = lambda rows, name, *c: rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    return best_of(one(chunks, "chunks", "chunk", "chunk_text").join(one(parts, "parts", "segment", "segment_text"), "doc"))
