"""Streams that remember: a watch over budgets, and a consumer with a durable cursor."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..tables import exists

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOOK = "key string, kind string, at timestamp, fresh long, cached long, bytes long, users long"
ALERT = "key string, at timestamp, why string, amount long"
MEMORY = "at timestamp, fresh long, cached long, users long, told_fresh long, told_cached long, told_bytes long"


class Limits(NamedTuple):
    """Caps hold for tasks, growth from one look to the next for all; ``active`` seconds without a look end a memory."""

    fresh: int
    cached: int
    bytes: int
    growth: int
    cached_growth: int
    active: int


def watched(memory: tuple | None, look, limits: Limits) -> tuple[tuple, tuple[str, int] | None]:
    """(memory, alert) after a look. A cap alerts again only beyond the value last told; a breached cap hides growth."""
    if memory is not None and (look.at - memory[0]).total_seconds() > limits.active:
        memory = None
    at, fresh, cached, users, *told = memory or (None, None, None, None, None, None, None)
    alert, breached = None, False
    if look.kind == "task":
        for i, (why, now, most) in enumerate((("fresh", look.fresh, limits.fresh), ("cached", look.cached, limits.cached), ("bytes", look.bytes, limits.bytes))):
            if now > most:
                breached = True
                if told[i] is None or now > told[i]:
                    told[i], alert = now, (why, now)
                break
    if not breached and at is not None and look.users <= users:
        if look.fresh - fresh > limits.growth:
            alert = ("growth", look.fresh - fresh)
        elif look.cached - cached > limits.cached_growth:
            alert = ("cached growth", look.cached - cached)
    return (look.at, look.fresh, look.cached, look.users, *told), alert


class BudgetWatch(StatefulProcessor):
    """A value state for each key; an event-time timer clears it once the watermark has passed its active time."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", MEMORY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        memory = self.memory.get() if self.memory.exists() else None
        memory = tuple(None if pd.isna(x) else x for x in memory) if memory is not None else None
        out = []
        for look in pd.concat(list(rows)).sort_values("at").itertuples():
            if memory is not None and look.at <= pd.Timestamp(memory[0]):
                continue  # an older look says nothing new
            memory, alert = watched(memory, look, self.limits)
            if alert:
                out.append((key[0], look.at, *alert))
        if memory is not None:
            self.memory.update(memory)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(memory[0]).timestamp() * 1000) + 1000 * self.limits.active + 1)
        yield pd.DataFrame(out, columns=["key", "at", "why", "amount"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memory.clear()
        yield pd.DataFrame([], columns=["key", "at", "why", "amount"])

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """Value states need this store; the session's own choice comes back at the end."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def budget_alerts(looks: DataFrame, limits: Limits, late: str = "10 minutes") -> DataFrame:
    """ALERT rows of a stream of LOOK rows; looks of a key that come out of order across batches are left out. Run it within ``rocks``."""
    return looks.withWatermark("at", late).groupBy("key").transformWithStateInPandas(BudgetWatch(limits), ALERT, "append", "eventTime")


def budget_alerts_of(looks: DataFrame, limits: Limits) -> DataFrame:
    """The same of a table of looks, by windows: memories are runs of looks without a longer gap; what was told last is the most breached so far."""
    by = Window.partitionBy("key").orderBy("at")
    seconds = lambda c: F.unix_micros(c) / 1_000_000
    fresh_start = seconds(F.col("at")) - seconds(F.lag("at").over(by)) > limits.active
    rows = looks.withColumn("life", F.sum(F.coalesce(fresh_start, F.lit(True)).cast("int")).over(by))
    within = Window.partitionBy("key", "life").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    task = F.col("kind") == "task"
    over: list[tuple[str, Column]] = []
    free = task
    for name, most in (("fresh", limits.fresh), ("cached", limits.cached), ("bytes", limits.bytes)):
        over.append((name, free & (F.col(name) > most)))
        free = free & ~(F.col(name) > most)
    grown = {c: F.col(c) - F.lag(c).over(within) for c in ("fresh", "cached", "users")}
    steady = ~F.coalesce(task & ~free, F.lit(False)) & (grown["users"] <= 0)
    one = lambda when, why, amount: F.when(when, F.struct(F.lit(why).alias("why"), amount.cast("long").alias("amount")))
    told = [one(c & (F.col(n) > F.coalesce(F.max(F.when(c, F.col(n))).over(before), F.lit(-1))), n, F.col(n)) for n, c in over]
    growth = [one(steady & (grown["fresh"] > limits.growth), "growth", grown["fresh"]), one(steady & (grown["cached"] > limits.cached_growth), "cached growth", grown["cached"])]
    return rows.withColumn("x", F.coalesce(*told, *growth)).where("x is not null").select("key", "at", "x.why", "x.amount")


# a consumer with a cursor of its own

CURSOR = "file string, seq long, ts timestamp"


def cursor_of(spark: SparkSession, path: str) -> DataFrame:
    """The last row delivered of each file; none where nothing was delivered yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], CURSOR)
    rows = spark.read.schema(CURSOR).option("recursiveFileLookup", "true").parquet(path)
    return rows.groupBy("file").agg(F.max_by(F.struct("seq", "ts"), "seq").alias("m")).select("file", "m.seq", "m.ts")


def positioned(rows: DataFrame, cursor: DataFrame, cutoff) -> DataFrame:
    """(file, head, upto) for the files of rows (file, seq, ts): what a returning consumer has of them.

    Rows beyond ``head`` are new. Of the others, those beyond ``upto`` are replayed if they are not older than ``cutoff``.
    History is skipped (upto is head) without a cursor, with one whose newest row is older than the cutoff, and where the
    file of that newest row is gone or begins behind the row that should come next.
    """
    files = rows.groupBy("file").agg(F.min("seq").alias("first"), F.max("seq").alias("head"))
    newest = cursor.agg(F.max(F.struct("ts", "file", "seq")).alias("n")).select("n.*")  # one row
    at = newest.join(files, "file", "left").select((F.coalesce(F.col("ts") >= F.lit(cutoff), F.lit(False)) & F.coalesce(F.col("first") <= F.col("seq") + 1, F.lit(False))).alias("replays"))
    held = cursor.select("file", F.col("seq").alias("done"))
    upto = F.when(F.col("replays"), F.coalesce("done", F.lit(-1))).otherwise(F.col("head"))
    return files.join(held, "file", "left").crossJoin(F.broadcast(at)).select("file", "head", upto.alias("upto"))  # one row


def consume(stream: DataFrame, rows: DataFrame, out: str, cursor: str, checkpoint: str, now, hours: float = 2, emit: Callable[[DataFrame, str], None] | None = None):
    """Deliver a stream of (file, seq, ts, ...) and, after each batch, keep the cursor; ``rows`` is the same as a table.

    A batch goes to a folder of its own run and number and its cursor to another, so a batch that is run again after a
    failure between both replaces what it had written: nothing is lost or repeated. A run is told by its checkpoint; one with
    a new checkpoint takes up where the cursor is, ``positioned``.
    """
    spark = stream.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    cutoff = pd.Timestamp(now) - pd.Timedelta(hours=hours)
    begin = f"{checkpoint}-begin"
    if not exists(spark, f"{begin}/_SUCCESS"):
        positioned(rows, cursor_of(spark, cursor), cutoff).write.mode("overwrite").parquet(begin)
    start = spark.read.schema("file string, head long, upto long").parquet(begin)
    emit = emit or (lambda batch, path: batch.write.mode("overwrite").parquet(path))

    def each(batch: DataFrame, number: int) -> None:
        known = batch.join(start, "file", "left")
        fresh = known.where(F.col("head").isNull() | (F.col("seq") > F.col("head")) | ((F.col("seq") > F.col("upto")) & (F.col("ts") >= F.lit(cutoff)))).select(*batch.columns)
        emit(fresh, f"{out}/run={run}/batch={number}")
        delivered = fresh.groupBy("file").agg(F.max_by(F.struct("seq", "ts"), "seq").alias("m")).select("file", "m.seq", "m.ts")
        delivered.write.mode("overwrite").parquet(f"{cursor}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(spark: SparkSession, out: str, schema) -> DataFrame:
    """All that consumers have delivered to ``out``."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
