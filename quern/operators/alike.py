"""Lossless joins on the sequence ratio 2 * M / (|a| + |b|).

M, the length of the matching blocks, is a common subsequence, so it is at most
the number of characters (with repeats) that both texts share, and at most
either length.  A ratio of ``least`` therefore needs

* need(m, n) = ceil(least * (m + n) / 2) shared characters, and
* lengths with need(m, n) <= min(m, n).

``character_index`` turns this into an inverted index.  Tokens are (character,
how manieth), put in one order, the rarest first.  Two sets of m and n tokens
that share ``need`` share ``level`` of the first m - need + level of one and
n - need + level of the other, so both texts write down every combination of
``level`` tokens among these and meet in one of them.  A text does so once a
level, with the least ``need`` of all lengths that the level is used with.
Levels depend on the longer length alone: long texts have too many combinations
otherwise.

``scanned`` is for texts so long that any two share most characters: a stated
set of queries goes past all rows in blocks, bounded first by length and by
shared characters, as matrices.
"""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKED = 4096  # characters whose counts decide the order; rarer ones come first, by code point
LEVELS = ((16, 3), (40, 2))  # (longer length up to, tokens in a key); 1 beyond
CLASSES = 64  # of characters, in the bound of a scan


def need(m: int, n: int, least: float) -> int:
    """Characters that texts of m and n characters must share for a ratio of ``least``; one part in 10**9 is rounding."""
    return max(1, math.ceil(least * (m + n) / 2 - 1e-9))


@lru_cache(1 << 12)
def plan(m: int, least: float) -> tuple[tuple[int, int], ...]:
    """(level, how many tokens of the order are combined) of a text of m characters, for all lengths that it can match."""
    fewest: dict[int, int] = {}
    n = max(1, math.ceil(m * least / (2 - least) - 1e-9))
    while need(m, n, least) <= min(m, n):
        level = min(next((v for top, v in LEVELS if max(m, n) <= top), 1), need(m, n, least))
        fewest[level] = min(fewest.get(level, n), need(m, n, least), m)
        n += 1
    return tuple((level, m - k + level) for level, k in fewest.items())


def keys(text: str, rank: dict[str, int], least: float) -> set[str]:
    """What a text writes down in the index."""
    seen: Counter = Counter()
    tokens = []
    for c in text:
        seen[c] += 1
        tokens.append((rank.get(c, -1), c, seen[c]))
    tokens.sort(key=lambda x: (x[0] - 4 * x[2] if x[0] >= 0 else -1 << 20, x[1], x[2]))  # repeats are rarer than the character
    named = [f"{c}{k}" for _, c, k in tokens]
    return {f"{level}|" + "|".join(some) for level, size in plan(len(text), least) for some in combinations(named[:size], level)}


def character_ranks(rows: DataFrame, text: str) -> dict[str, int]:
    """Places of the commonest characters, the rarest first: RANKED at most come to the driver."""
    each = rows.select(F.explode(F.split(text, "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    found = each.orderBy(F.desc("n"), "c").limit(RANKED).collect()
    return {r["c"]: len(found) - i for i, r in enumerate(found)}


def character_index(rows: DataFrame, text: str, rank: dict[str, int], least: float) -> DataFrame:
    """rows with ``key``, a row for each key of the text; empty and null texts have none."""

    @F.pandas_udf("array<string>")
    def written(column: pd.Series) -> pd.Series:
        return pd.Series([sorted(keys(x, rank, least)) if x else [] for x in column])

    return rows.withColumn("key", F.explode(written(F.col(text))))


def fits(a: str, b: str, least: float) -> Column:
    """Whether the lengths allow the ratio."""
    m, n = F.char_length(a), F.char_length(b)
    return F.ceil(F.lit(least) * (m + n) / 2 - 1e-9) <= F.least(m, n)


def near_texts(left: DataFrame, right: DataFrame, least: float, rank: dict[str, int] | None = None) -> DataFrame:
    """(a, b): distinct pairs of texts of left (a) and right (b) whose ratio may be ``least``; no such pair is lost.

    Texts that stand for many rows should come once. ``rank`` are right's ``character_ranks``, where they are known. Pairs are
    small and what is done with them is not, so they lie in as many partitions as a shuffle has.
    """
    rank = character_ranks(right, "b") if rank is None else rank
    x, y = character_index(left.select("a"), "a", rank, least), character_index(right.select("b"), "b", rank, least)
    return x.join(y, "key").where(fits("a", "b", least)).select("a", "b").repartition(spread(right), "a", "b").distinct()


def spread(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of texts where the words of one are all among the other's.

    The shorter one's rarest word is looked up among all words of the longer one, so no word is too common.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.col(c), " "), lambda w: w != ""))
    x, y = left.select("a", F.explode(words("a")).alias("w")), right.select("b", F.explode(words("b")).alias("w"))
    often = y.groupBy("w").agg(F.count("*").alias("n"))
    rarest = lambda rows, c: rows.join(often, "w", "left").groupBy(c).agg(F.min_by("w", F.struct(F.coalesce("n", F.lit(0)), "w")).alias("w"))
    pairs = rarest(x, "a").join(y, "w").select("a", "b").union(x.join(rarest(y, "b"), "w").select("a", "b"))
    inside = lambda p, q: F.size(F.array_except(words(p), words(q))) == 0
    return pairs.where(inside("a", "b") | inside("b", "a")).distinct()


def bags(texts: list[str]) -> np.ndarray:
    """(texts, CLASSES) counts of characters; characters share classes, which only loosens the bound."""
    out = np.zeros((len(texts), CLASSES), np.int32)
    for i, t in enumerate(texts):
        code = np.frombuffer(t.encode("utf-32-le"), np.uint32) % CLASSES
        out[i] = np.bincount(code, minlength=CLASSES)
    return out


def scanned(queries: DataFrame, rows: DataFrame, score, least: float, block: int = 512) -> DataFrame:
    """(id, match, score) of queries and rows (id, text, tokens) that reach ``least`` by score(query, row, ratio); ids differ.

    ``score`` gets (text, tokens) twice and the ratio, None where it can't reach ``least``. Queries are dealt into blocks
    of about ``block``; a task holds one and streams rows past it.
    """
    from .retrieval import dealt

    def use(asked, held):
        (q, texts, tokens), (ids, others, words) = asked, held
        size, long = np.array([len(t) for t in texts]), np.array([len(t) for t in others])
        mine, theirs = bags(texts), bags(others)
        sets, other_sets = [frozenset(w) for w in tokens], [frozenset(w) for w in words]
        found = []
        for i in range(len(q)):
            shared = np.minimum(mine[i], theirs).sum(axis=1)
            may = 2 * shared >= least * (size[i] + long) - 1e-9
            matcher = SequenceMatcher(None, "", texts[i]) if may.any() else None
            for j in np.flatnonzero(may | np.array([not sets[i].isdisjoint(w) for w in other_sets])).tolist():
                if ids[j] == q[i]:
                    continue
                ratio = None
                if may[j]:
                    # the ratio is not symmetric: the query comes first
                    matcher.set_seqs(texts[i], others[j])
                    ratio = matcher.ratio() if matcher.real_quick_ratio() >= least - 1e-9 and matcher.quick_ratio() >= least - 1e-9 else None
                s = score((texts[i], sets[i]), (others[j], other_sets[j]), ratio)
                if s >= least:
                    found.append((q[i], ids[j], s))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["id", "match", "score"])

    given = lambda d: d.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    lists = lambda part: tuple(part.column(c).to_pylist() for c in ("id", "text", "tokens"))
    return dealt(given(rows), given(queries), use, lists, "id long, match long, score double", block)
