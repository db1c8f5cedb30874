"""Streams that remember: restarts, failures between delivery and cursor, and the batch form."""

import datetime as dt
import random
import time
from types import SimpleNamespace

import pytest

from quern.streaming import events, stateful

LIMITS = stateful.Limits(fresh=1000, cached=500, bytes=2000, growth=100, cached_growth=60, active=3600)
T0 = dt.datetime(2024, 3, 1, 12)


def looks(seed=3, keys=6, n=30):
    rng = random.Random(seed)
    out = []
    for k in range(keys):
        at, fresh, cached, size, users = T0 + dt.timedelta(seconds=k), 0, 0, 0, 0
        for _ in range(n):
            at += dt.timedelta(minutes=rng.choice([5, 10, 50, 61, 90]))
            fresh += rng.choice([0, 20, 99, 101, 250])
            cached += rng.choice([0, 10, 59, 61])
            size += rng.choice([0, 100, 300])
            users += rng.random() < 0.2
            out.append((f"k{k}", "task" if k % 2 else "session", at, fresh, cached, size, int(users)))
    return sorted(out, key=lambda r: r[2])


def by_hand(rows):
    memories, out = {}, set()
    for r in rows:
        look = SimpleNamespace(**dict(zip(("key", "kind", "at", "fresh", "cached", "bytes", "users"), r, strict=True)))
        memories[r[0]], alert = stateful.watched(memories.get(r[0]), look, LIMITS)
        if alert:
            out.add((r[0], r[2], *alert))
    return out


def test_rules_of_the_watch():
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [
        ("t", "task", at(0), 900, 0, 0, 1), ("t", "task", at(5), 1100, 0, 0, 1), ("t", "task", at(10), 1100, 0, 0, 1), ("t", "task", at(15), 1200, 0, 0, 1),  # a cap, told once, then grown
        ("s", "session", at(0), 5000, 0, 0, 1), ("s", "session", at(5), 5101, 0, 0, 1), ("s", "session", at(10), 5300, 0, 0, 2), ("s", "session", at(12), 5300, 61, 0, 2), ("s", "session", at(80), 9000, 900, 0, 2),  # growth, steered, cached growth, forgotten
        ("b", "task", at(0), 0, 0, 2001, 0), ("b", "task", at(5), 500, 0, 2001, 0),  # a breached cap hides growth
    ]
    assert by_hand(rows) == {("t", at(5), "fresh", 1100), ("t", at(15), "fresh", 1200), ("s", at(5), "growth", 101), ("s", at(12), "cached growth", 61), ("b", at(0), "bytes", 2001)}


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, kind string, at timestamp, fresh long, cached long, bytes long, users long")


def naive(rows):
    return {(r["key"], r["at"].replace(tzinfo=None), r["why"], r["amount"]) for r in rows}


def test_batch_equals_the_rules(spark):
    rows = looks()
    want = by_hand(rows)
    assert naive(stateful.budget_alerts_of(table(spark, rows).repartition(3), LIMITS).collect()) == want and len(want) > 30


def test_stream_over_two_restarts(spark, tmp_path):
    rows = looks()
    want = by_hand(rows)
    source, sink, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    with stateful.rocks(spark):
        for part in (rows[:60], rows[60:130], rows[130:]):
            table(spark, part).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(stateful.LOOK).parquet(source)
            events.run_all(stateful.budget_alerts(stream, LIMITS), sink, checkpoint)
    assert naive(spark.read.parquet(sink).collect()) == want


SCHEMA = "file string, seq long, ts timestamp"


class Consumer:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/queue")

    def run(self, name, now, emit=None):
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/queue")
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/queue")
        stateful.consume(stream, rows, f"{self.folder}/out", f"{self.folder}/cursor", f"{self.folder}/{name}", now, 2, emit).awaitTermination()

    def got(self):
        return sorted((r["file"], r["seq"]) for r in stateful.delivered(self.spark, f"{self.folder}/out", SCHEMA).collect())


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_nothing_is_lost_or_repeated_between_delivery_and_cursor(spark, tmp_path):
    c = Consumer(spark, tmp_path)
    c.add(*[("a", i, at(0)) for i in range(5)])
    c.run("first", at(0))
    assert c.got() == []  # without a cursor, history is skipped
    c.add(("a", 5, at(0.1)), ("a", 6, at(0.2)))

    def broken(batch, path):
        batch.write.mode("overwrite").parquet(path)
        raise RuntimeError("lost its power before the cursor was kept")

    with pytest.raises(Exception, match="lost its power"):
        c.run("first", at(0.2), broken)
    assert c.got() == [("a", 5), ("a", 6)]
    c.run("first", at(0.2))
    assert c.got() == [("a", 5), ("a", 6)]
    c.add(("a", 7, at(0.3)))
    c.run("first", at(0.3))
    c.add(("a", 8, at(1)), ("a", 9, at(1.5)), ("b", 0, at(1.6)))
    c.run("second", at(2))  # a new consumer takes up behind the cursor, new files are taken whole
    assert c.got() == [("a", i) for i in range(5, 10)] + [("b", 0)]
    c.run("second", at(2))
    assert len(c.got()) == 6


def test_replay_is_bounded_and_rotation_is_seen(spark, tmp_path):
    old = Consumer(spark, tmp_path / "old")
    old.add(("a", 0, at(0)))
    old.spark.createDataFrame([("a", 0, at(0))], SCHEMA).write.parquet(f"{old.folder}/cursor/run=x")
    old.add(("a", 1, at(0.5)), ("a", 2, at(2.4)))
    old.run("late", at(2.5))  # the cursor is over two hours old
    assert old.got() == []
    some = Consumer(spark, tmp_path / "some")
    some.add(("a", 0, at(0)), ("a", 1, at(0.4)), ("a", 2, at(2.4)))
    some.spark.createDataFrame([("a", 0, at(1))], SCHEMA).write.parquet(f"{some.folder}/cursor/run=x")
    some.run("late", at(2.5))  # rows older than two hours are not replayed
    assert some.got() == [("a", 2)]
    gone = Consumer(spark, tmp_path / "gone")
    gone.add(("a", 5, at(2.3)), ("a", 6, at(2.4)))
    gone.spark.createDataFrame([("a", 3, at(2.2))], SCHEMA).write.parquet(f"{gone.folder}/cursor/run=x")
    gone.run("late", at(2.5))  # row 4 has rotated away
    assert gone.got() == []


def test_polling_goes_on_until_it_is_stopped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    q = events.run_every(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", 1)
    try:
        for n in (3, 5):
            until = time.time() + 60
            while time.time() < until:
                q.processAllAvailable()
                if spark.read.schema("id long").parquet(f"{tmp_path}/out").count() == n:
                    break
            assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(n))
            spark.range(3, 5).write.mode("append").parquet(f"{tmp_path}/in") if n == 3 else None
        assert q.isActive
    finally:
        q.stop()
    assert not q.isActive
