"""Who is who and what is the same: similarities, tiers, duplicate groups.

The sequence ratio is Python's; it runs, batch by batch, on pairs that bounds
of the ratio leave (``alike``). No pair at a threshold is lost.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import kept
from . import alike

#: fixed values
MERGE, REVIEW, SAME_TASK, SUBSET, PARTNER = 0.96, 0.75, 0.72, 0.85, 0.03


def names_alike(a: str, b: str) -> float:
    """1 for equal names (case and space folded); a name of a part of the other's words is 0.85 at least."""
    x, y = " ".join(a.lower().split()), " ".join(b.lower().split())
    if x == y:
        return 1.0
    p, q = set(x.split()), set(y.split())
    part = SUBSET if p and q and (p <= q or q <= p) else 0.0
    return max(SequenceMatcher(None, x, y).ratio(), part)


def shared_tokens(p: set[str], q: set[str]) -> float:
    """The better of Jaccard and weighted containment."""
    both = len(p & q)
    return max(both / len(p | q), SUBSET * both / min(len(p), len(q))) if p and q else 0.0


def texts_alike(a: str, b: str, p: set[str], q: set[str]) -> float:
    """The best of sequence ratio, Jaccard and containment of the token sets."""
    return max(SequenceMatcher(None, a, b).ratio(), shared_tokens(p, q))


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([names_alike(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def tier(score: Column) -> Column:
    return F.when(score >= MERGE, "merge").when(score >= REVIEW, "review").otherwise("create")


def candidates(fresh: DataFrame, known: DataFrame, top: int = 3) -> DataFrame:
    """(id, match, score) of fresh tasks (id, counterparty, text, tokens) with open known ones: the ``top`` best.

    Fresh tasks are the stated queries. All known ones are compared, whoever owns them; the same counterparty adds a
    little. Empty texts match nothing.

    Tasks of one text and token set are a class, and classes are compared, each pair once. Of the members of a class only the
    first ``top`` ids can be among the best of a task besides itself, and the first ``top`` with its counterparty.
    """
    least = SAME_TASK - PARTNER - 0.0005  # before the score is rounded

    def score(a, b, ratio):
        (_, p), (_, q) = a, b
        return max(ratio or 0.0, shared_tokens(p, q)) if a[0] and b[0] else 0.0

    said = ("text", "tokens")
    given = lambda d: d.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.lower(F.trim(F.col("counterparty").cast("string"))).alias("p")).where("text <> ''")
    # even numbers for fresh classes and odd ones for known ones: a class may match itself
    numbered = lambda d, odd: kept(d.select(*said).distinct().withColumn("c", 2 * F.monotonically_increasing_id() + odd), "classes")
    asked, held = kept(given(fresh), "fresh"), kept(given(known), "known")
    mine, theirs = numbered(asked, 0), numbered(held, 1)
    found = kept(alike.scanned(mine.withColumnRenamed("c", "id"), theirs.withColumnRenamed("c", "id"), score, least).select(F.col("id").alias("c"), F.col("match").alias("o"), "score"), "alike")
    first = lambda d, by, n, *order: d.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    best = (F.desc("score"), F.asc("match"))
    members = kept(held.join(theirs, [*said]).select(F.col("c").alias("o"), F.col("id").alias("match"), F.col("p").alias("q")), "members")
    queries = kept(asked.join(mine, [*said]).select("id", "c", "p"), "queries")
    plain = found.withColumn("score", F.round("score", 3)).where(F.col("score") >= SAME_TASK).join(first(members, ["o"], top + 1, "match"), "o").select("c", "match", "q", "score")
    plain = first(plain, ["c"], top + 1, *best)
    partners = first(members.where("q <> ''"), ["o", "q"], top + 1, "match")
    close = found.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + PARTNER), 3)).where(F.col("score") >= SAME_TASK)
    wanted = queries.select("c", F.col("p").alias("q")).distinct()
    close = first(close.join(wanted, "c").join(partners, ["o", "q"]).select("c", "q", "match", "score"), ["c", "q"], top + 1, *best)
    pairs = queries.join(plain, "c").select("id", "match", "score").union(queries.join(close.withColumnRenamed("q", "p"), ["c", "p"]).select("id", "match", "score"))
    pairs = pairs.where("id <> match").groupBy("id", "match").agg(F.max("score").alias("score"))  # the counterparty adds
    return first(pairs, ["id"], top, *best).select("id", "match", "score")


def stars(ids: list, alike) -> list[list]:
    """Groups around the first unused item: those alike to it, not to one another."""
    out, used = [], set()
    for i in ids:
        if i in used:
            continue
        group = [i] + [j for j in ids if j not in used and j != i and alike(i, j)]
        if len(group) > 1:
            used.update(group)
            out.append(group)
    return out


def duplicate_groups(tasks: DataFrame) -> DataFrame:
    """(owner, counterparty, keep, cancel): the oldest of a group stays. Order matters, so a bucket is one call; buckets are small by nature."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["created", "id"])
        by = {r.id: (r.text, set(r.tokens)) for r in pdf.itertuples()}
        rows = []
        for group in stars(list(pdf["id"]), lambda a, b: texts_alike(by[a][0], by[b][0], by[a][1], by[b][1]) >= SAME_TASK):
            rows += [(pdf["owner"].iloc[0], pdf["counterparty"].iloc[0], group[0], other) for other in group[1:]]
        return pd.DataFrame(rows, columns=["owner", "counterparty", "keep", "cancel"])

    kind = tasks.schema["id"].dataType.simpleString()
    own, other = (tasks.schema[c].dataType.simpleString() for c in ("owner", "counterparty"))
    return tasks.groupBy("owner", "counterparty").applyInPandas(run, f"owner {own}, counterparty {other}, keep {kind}, cancel {kind}")


def folded(name: str) -> Column:
    """Case and space folded, as names are compared."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


@lru_cache(1 << 16)
def _read(name: str) -> tuple[str, Counter, frozenset[str]]:
    x = " ".join(name.lower().split())
    return x, Counter(x), frozenset(x.split())


def similar(least: float):
    """``name_similarity`` where it may reach ``least``, else null: shared characters bound the ratio."""

    def score(a: str, b: str) -> float | None:
        (x, m, p), (y, n, q) = _read(a), _read(b)
        shared = sum(min(k, n[c]) for c, k in m.items())
        return names_alike(a, b) if p <= q or q <= p or 2 * shared >= least * (len(x) + len(y)) - 1e-9 else None

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


#: near_names looks for the best from the top: a name that is found at one of these is not looked for below it
STEPS = (0.95, 0.9, SUBSET, 0.8)


def near_names(names: DataFrame, known: DataFrame, least: float = REVIEW) -> DataFrame:
    """(id, known, score): the best of known ones (known, known_name) for each name (id, name) that reaches ``least``, ties to the smaller known.

    Equal folded names are compared once, on either side. Equal ones are found first; the rest is looked for at falling bounds.
    At each, all pairs that reach it are scored, so the best of a name that has one is final and the name drops out. Else
    a name would be scored with all that are a little like it.
    """
    a, b = names.withColumn("a", folded("name")).where("a <> ''"), known.withColumn("b", folded("known_name")).where("b <> ''")
    left, right = kept(a.select("a").distinct(), "names"), kept(b.groupBy("b").agg(F.min("known").alias("known")).repartition(alike.spread(known)), "known")
    best = kept(left.join(right, left["a"] == right["b"]).select("a", F.lit(-1.0).alias("less"), "known"), "near")
    rank = alike.character_ranks(right, "b")
    for bound in (*[x for x in STEPS if x > least], least):
        open_ = kept(left.join(best, "a", "left_anti"), "open")
        pairs = alike.near_texts(open_, right, bound, rank)
        if bound <= SUBSET:  # by words a pair reaches SUBSET
            pairs = pairs.union(alike.near_words(open_, right)).repartition(alike.spread(right), "a", "b").distinct()
        scored = pairs.withColumn("score", similar(bound)("a", "b")).where(F.col("score") >= bound)
        more = kept(scored.join(right, "b").groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("less"), "known")).alias("m")).select("a", "m.less", "m.known"), "near")
        best = best.union(more)
    return a.join(best, "a").select("id", "known", F.round(-F.col("less"), 6).alias("score"))


def placed(names: DataFrame, known: DataFrame) -> DataFrame:
    """(id, known, score, tier) of names (id, name) against all known ones (known, known_name): the best at REVIEW or more, else create."""
    return names.select("id").join(near_names(names, known), "id", "left").withColumn("tier", F.coalesce(tier(F.col("score")), F.lit("create")))


def registered(names: DataFrame, known: DataFrame, aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, person, known): names (id, name, kind) of persons that the registry's aliases (alias, person) know for one person only.

    known: that person's first node by nodes (person, known, at) that still is among ``known``; null where there is none.
    """
    people = names.where(F.lower(F.trim("kind")) == "person").select("id", F.lower(F.trim("name")).alias("n"))
    one = aliases.select(F.lower("alias").alias("n"), "person").distinct().groupBy("n").agg(F.min("person").alias("person"), F.count("*").alias("k")).where("k = 1").drop("k")
    first = nodes.join(known.select("known"), "known", "left_semi").groupBy("person").agg(F.min_by("known", F.struct("at", "known")).alias("known"))
    return people.join(one, "n").join(first, "person", "left").select("id", "person", "known")


def entity_actions(names: DataFrame, known: DataFrame, aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, action, known, score, person, links) of names (id, name, kind) to be written to a graph.

    The registry comes first: a person it knows by a node that exists is that node. Others go by similarity:
    updated_existing (1), merged_high_similarity (MERGE or more), queued_for_review (REVIEW or more: nothing is written),
    created. ``links`` says that the registry learns the node of a person it knows.
    """
    by_registry = registered(names, known, aliases, nodes)
    rows = names.select("id").join(by_registry.select("id", "person", F.col("known").alias("_r")), "id", "left").join(near_names(names, known), "id", "left")
    score = F.when(F.col("_r").isNull(), F.col("score"))
    action = (
        F.when(F.col("_r").isNotNull(), "resolved_via_registry").when(score == 1, "updated_existing").when(score >= MERGE, "merged_high_similarity")
        .when(score >= REVIEW, "queued_for_review").otherwise("created")
    )
    links = F.col("_r").isNull() & F.col("person").isNotNull() & (F.coalesce(score, F.lit(0.0)) >= MERGE) | F.col("_r").isNull() & F.col("person").isNotNull() & score.isNull()
    return rows.select("id", action.alias("action"), F.coalesce("_r", "known").alias("known"), score.alias("score"), "person", links.alias("links"))
