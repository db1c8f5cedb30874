"""Mixing sources to target weights.

Temperature mixing: the weight of a source is its share of all tokens to the
power of an exponent.  The exponent is bisected until the weights have a given
entropy (in nats), or until the source repeated most is repeated a given
number of times.  The weights then become budgets of tokens, and these become
blocks: each source's documents are permuted anew in every epoch and follow
one another until the budget is spent, every block takes an equal part of each
source's budget, and the documents of a block are permuted again.

Without a budget the one used is the largest that repeats nothing needlessly:
the source that the weights favour least appears exactly once, in full.

Positions come from prefix sums in two steps (over slices of a source, then
within a slice), so no source, however large, is ordered in one task; a block
is bounded by its tokens.  The shares of all sources are the only thing that
the driver gathers: one number for each source.

Cases: tokens are words, and a document without words (null, blank) has no
share and takes no part; null is a source of its own; repeated rows are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import row_key, unclashing, written

WORD = r"[^\x20\x09-\x0D]+"
SLICE_DOCS = 50_000
SEED = "quern"


def bisected(f, target: float, low: float, high: float, steps: int = 100) -> float:
    """Where the monotone f meets target between low and high, or the nearer end."""
    rising = f(high) > f(low)
    for _ in range(steps):
        mid = (low + high) / 2
        if (f(mid) < target) == rising:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def weights(tokens: list[int], exponent: float) -> list[float]:
    total, most = sum(tokens), max(tokens)
    raw = [(t / most) ** exponent for t in tokens]
    del total
    return [r / sum(raw) for r in raw]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x)


def exponent_for(tokens: list[int], target_entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> float:
    """The exponent, to six decimals. Exactly one target is given."""
    if (target_entropy is None) == (repeats is None):
        raise ValueError("give either an entropy or a number of repeats")
    if target_entropy is not None:
        return round(bisected(lambda a: entropy(weights(tokens, a)), target_entropy, 0.0, 8.0), 6)
    if repeats < 1:
        raise ValueError("a source is repeated once at least")

    def most(a: float) -> float:
        w = weights(tokens, a)
        times = [x / t for x, t in zip(w, tokens, strict=True)]
        return max(times) * budget if budget else max(times) / min(times)

    if most(1.0) > repeats * (1 + 1e-9):
        raise ValueError("the budget needs more repeats than that whatever the weights")
    return round(bisected(most, repeats, 0.0, 1.0), 6)


def quotas(tokens: list[int], exponent: float, budget: int | None = None) -> list[int]:
    """Tokens taken of each source."""
    if budget:
        return [int(x * budget) for x in weights(tokens, exponent)]
    times = [(t / max(tokens)) ** (exponent - 1) for t in tokens]
    least = min(times)
    return [int(t * (x / least)) for t, x in zip(tokens, times, strict=True)]


def mixture(docs: DataFrame, target_entropy: float | None = None, repeats: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20) -> DataFrame:
    """(k1, k2, doc_id, source, n_tokens, weight, epoch, block, position) for each appearance of a document.

    ``position`` orders a block from 1; docs: (doc_id, text, source, ...).
    """
    one = docs.select(*row_key("doc_id", "text"), "doc_id", F.col("source").alias("source"), F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long").alias("n_tokens"))
    one = written(one.where("n_tokens > 0").withColumn("skey", F.to_json(F.struct("source"))), "tokens")
    found = one.groupBy("skey").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).orderBy("skey").collect()  # a row a source
    shape = "skey string, weight double, quota long, total long, part long"
    if not found:
        plan, nb, digits = [], 1, 1
    else:
        tokens = [r["t"] for r in found]
        a = exponent_for(tokens, target_entropy, repeats, budget)
        w, q = weights(tokens, a), quotas(tokens, a, budget)
        nb = max(1, -(-sum(q) // block_tokens))
        digits = max(1, math.ceil(math.log(max(r["n"] for r in found) / SLICE_DOCS, 16))) if max(r["n"] for r in found) > SLICE_DOCS else 1
        plan = [(r["skey"], x, y, r["t"], max(1, -(-y // nb))) for r, x, y in zip(found, w, q, strict=True)]
    plan = docs.sparkSession.createDataFrame(plan, shape)
    spread = one.join(F.broadcast(plan), "skey").where("quota > 0")  # a row a source: as small as the list of sources
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.expr("cast((quota - 1) div total as int)"))).alias("epoch"))
    spread = spread.withColumn("lot", F.md5(F.concat_ws("|", F.lit(SEED), "epoch", "doc_id", "n_tokens")))
    spread = spread.withColumn("slice", F.substring("lot", 1, digits))
    sums = spread.groupBy("skey", "epoch", "slice").agg(F.sum("n_tokens").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("skey", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    within = Window.partitionBy("skey", "epoch", "slice").orderBy("lot", "n_tokens", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.join(before, ["skey", "epoch", "slice"]).withColumn("start", F.col("epoch") * F.col("total") + F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    placed = placed.where("start < quota").withColumn("block", F.expr("start div part"))
    order = Window.partitionBy("block").orderBy(F.md5(F.concat_ws("|", F.lit(SEED), "block", "epoch", "doc_id", "n_tokens")), "k1", "k2")
    return placed.withColumn("position", F.row_number().over(order).cast("long")).select("k1", "k2", "doc_id", "source", "n_tokens", "weight", "epoch", "block", "position")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs as the mixture has them: a row for each appearance, with the columns of docs.

    Columns named k1, k2, _0, _1, _times, _same, _nth, _own or _copy are refused.
    """
    names = docs.columns
    unclashing(names, "k1", "k2", "_0", "_1", "_times", "_same", "_nth", "_own", "_copy")
    once = mixture(docs, **how).groupBy("k1", "k2").agg(F.count("*").alias("_times"))  # of all repeated rows together
    keyed = docs.select("*", *[c.alias(f"_{i}") for i, c in enumerate(row_key("doc_id", "text"))])
    same = F.count("*").over(Window.partitionBy("_0", "_1"))
    nth = F.row_number().over(Window.partitionBy("_0", "_1").orderBy(*[F.col(c) for c in names if c != "text"]))
    rows = keyed.join(once, (F.col("_0") == F.col("k1")) & (F.col("_1") == F.col("k2"))).withColumn("_same", same).withColumn("_nth", nth)
    # repeated rows share their appearances evenly
    rows = rows.withColumn("_own", F.expr("cast(_times div _same + if(_nth <= _times % _same, 1, 0) as int)")).where("_own > 0")
    return rows.select(*names, F.explode(F.sequence(F.lit(1), F.col("_own"))).alias("_copy")).select(*names)
