"""Incremental state: diffs of keyed snapshots, merges, watermarks and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, changed, same or deleted, by content hash."""
    a = old.select(F.col(key), F.col(digest).alias("_was"), F.lit(True).alias("_old"))
    b = new.select(F.col(key), F.col(digest).alias("_is"), F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_was").eqNullSafe(F.col("_is")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def round_robin(rows: DataFrame, source: str, key: str) -> DataFrame:
    """Rows with their turn: the first of each source, then the second of each, and so on."""
    return ranks.numbered(rows, [source], [F.col(key)], "turn")


def replaced(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored with all rows of the keys in fresh replaced by these."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def merged(disk: DataFrame, dirty: DataFrame, deleted: DataFrame, key: str, value: str) -> DataFrame:
    """Only dirty keys win over what is on disk; explicit deletes go."""
    own = dirty.select(key, F.col(value).alias("_mine"), F.lit(True).alias("_dirty"))
    rows = disk.join(own, key, "full_outer").select(key, F.when(F.col("_dirty"), F.col("_mine")).otherwise(F.col(value)).alias(value))
    return rows.join(deleted.select(key), key, "left_anti")


def since(rows: DataFrame, at: str, mark: Column, overlap_days: int, done: DataFrame, key: str) -> DataFrame:
    """Rows from some days behind the high-water mark on that aren't done yet."""
    return rows.where(F.col(at) >= mark - F.make_interval(days=F.lit(overlap_days))).join(done.select(key), key, "left_anti")


def moves(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(was, now, change) of keys that vanished or are new: moved where the same content did both, else pruned or new.

    Copies of one content pair up in the order of their keys; what is left over is pruned or new.
    """
    nth = F.row_number().over(Window.partitionBy(digest).orderBy(key))
    gone = old.join(new.select(key), key, "left_anti").select(digest, F.col(key).alias("was"), nth.alias("nth"))
    come = new.join(old.select(key), key, "left_anti").select(digest, F.col(key).alias("now"), nth.alias("nth"))
    change = F.when(F.col("now").isNull(), "pruned").when(F.col("was").isNull(), "new").otherwise("moved")
    return gone.join(come, [digest, "nth"], "full_outer").select("was", "now", change.alias("change"))


def late_days(stored: DataFrame, fresh: DataFrame, at: str) -> DataFrame:
    """All rows of the days that fresh rows touch: these are computed anew as a whole."""
    days = fresh.select(F.to_date(at).alias("day")).distinct()
    return stored.unionByName(fresh).withColumn("day", F.to_date(at)).join(days, "day", "left_semi")


def edits(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Changes between an export and its edited form (key, status, due, note), one row each."""
    b = after.select(key, *[F.col(c).alias(f"n_{c}") for c in ("status", "due", "note")])
    rows = before.join(b, key)
    closed, reopened = F.col("n_status").isin("done", "cancelled"), F.col("status").isin("done", "cancelled")
    one = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("change"), value.cast("string").alias("value")))
    found = F.array(
        one((F.col("n_status") == "done") & ~reopened, "complete", F.lit(None)),
        one((F.col("n_status") == "cancelled") & ~reopened, "cancel", F.lit(None)),
        one(reopened & ~closed, "reopen", F.lit(None)),
        one(F.col("due").isNull() & F.col("n_due").isNotNull(), "set_due", F.col("n_due")),
        one(F.col("due") != F.col("n_due"), "reschedule", F.col("n_due")),
        one(F.col("due").isNotNull() & F.col("n_due").isNull(), "clear_due", F.lit(None)),
        one(F.coalesce(F.col("n_note"), F.lit("")) != F.coalesce(F.col("note"), F.lit("")), "add_note", F.col("n_note")),
    )
    return rows.select(key, F.explode(F.array_compact(found)).alias("x")).select(key, "x.change", "x.value")
