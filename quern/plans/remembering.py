"""Streams that remember, and texts cut at pauses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import segments
from ..streaming import events as e
from ..streaming import stateful as s
from ..tables import new_folder
from .registry import query

LIMITS = s.Limits(fresh=900, cached=400, bytes=1200, growth=160, cached_growth=40, active=2 * 86400)

_LOOKS = """l AS (SELECT user_id, ts, CASE WHEN user_id % 2 = 0 THEN 'task' ELSE 'session' END AS kind, sum(CAST(floor(value) AS BIGINT)) OVER w AS fresh, sum(event_id % 50) OVER w AS cached, 100 * count(*) OVER w AS bytes, count(*) FILTER (event_type = 'purchase') OVER w AS users FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT *, sum(CASE WHEN epoch(ts) - epoch(before) > 172800 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS life FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM l)),
  b AS (SELECT *, kind = 'task' AND fresh > 900 AS f, kind = 'task' AND fresh <= 900 AND cached > 400 AS c, kind = 'task' AND fresh <= 900 AND cached <= 400 AND bytes > 1200 AS z,
        fresh - lag(fresh) OVER v AS df, cached - lag(cached) OVER v AS dc, users - lag(users) OVER v AS du FROM g WINDOW v AS (PARTITION BY user_id, life ORDER BY ts)),
  t AS (SELECT *, max(CASE WHEN f THEN fresh END) OVER p AS tf, max(CASE WHEN c THEN cached END) OVER p AS tc, max(CASE WHEN z THEN bytes END) OVER p AS tz FROM b WINDOW p AS (PARTITION BY user_id, life ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  x AS (SELECT CAST(user_id AS VARCHAR) AS key, ts AS "at", CASE WHEN f THEN CASE WHEN fresh > coalesce(tf, -1) THEN 'fresh' END WHEN c THEN CASE WHEN cached > coalesce(tc, -1) THEN 'cached' END WHEN z THEN CASE WHEN bytes > coalesce(tz, -1) THEN 'bytes' END WHEN du <= 0 AND df > 160 THEN 'growth' WHEN du <= 0 AND dc > 40 THEN 'cached growth' END AS why, fresh, cached, bytes, df, dc FROM t)
  SELECT key, "at", why, CAST(CASE why WHEN 'fresh' THEN fresh WHEN 'cached' THEN cached WHEN 'bytes' THEN bytes WHEN 'growth' THEN df ELSE dc END AS BIGINT) AS amount FROM x WHERE why IS NOT NULL"""


def looks(t):
    """What is seen of each user at each event: cumulative counters."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select(
        F.col("user_id").cast("string").alias("key"), F.when(F.col("user_id") % 2 == 0, "task").otherwise("session").alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.sum(F.floor("value")).over(w).alias("fresh"),
        F.sum(F.col("event_id") % 50).over(w).alias("cached"), (100 * F.count("*").over(w)).alias("bytes"), F.sum((F.col("event_type") == "purchase").cast("long")).over(w).alias("users"),
    )


@query(f"WITH {_LOOKS}")
def budget_watch(t):
    """Alerts of a table of looks."""
    return s.budget_alerts_of(looks(t), LIMITS).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"WITH {_LOOKS}")
def budget_stream(t):
    """The same alerts of a stream that keeps what it has seen and told of each key."""
    source, sink = new_folder(t.spark, "looks"), new_folder(t.spark, "alerts")
    looks(t).write.parquet(source)
    with s.rocks(t.spark):
        e.run_all(s.budget_alerts(t.spark.readStream.schema(s.LOOK).parquet(source), LIMITS), sink, sink + "-checkpoint")
    return t.spark.read.schema(s.ALERT).parquet(sink).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT event_id FROM events WHERE event_id > 500 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def replayed_rows(t):
    """What a returning consumer gets: rows behind its kept cursor that are not too old, and its cursor moves on."""
    source, sink, cursor = (new_folder(t.spark, n) for n in ("queue", "delivered", "cursor"))
    rows = t.events.select(F.lit("log").alias("file"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(source)
    newest = rows.agg(F.max("ts")).first()[0]  # the clock: one row
    t.spark.createDataFrame([("log", 500, newest)], s.CURSOR).write.parquet(f"{cursor}/run=before")
    schema = "file string, seq long, ts timestamp"
    s.consume(t.spark.readStream.schema(schema).parquet(source), t.spark.read.schema(schema).parquet(source), sink, cursor, sink + "-checkpoint", newest, 48).awaitTermination()
    return s.delivered(t.spark, sink, schema).select(F.col("seq").alias("event_id"))


_SEGMENTED = """m AS (SELECT user_id, event_id, ts, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS at_ FROM events), d AS (SELECT *, at_ - lag(at_) OVER w AS d FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, CAST(sum(CASE WHEN CASE WHEN d < 0 THEN d + 1440 ELSE d END >= 120 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment FROM d)"""


@query(f"WITH {_SEGMENTED} SELECT user_id, segment, count(*) AS messages, 1 AS headed FROM n GROUP BY 1, 2")
def text_segments(t):
    """A log of messages with times of day only, cut at pauses of two hours; the mark above a message goes with it."""
    said = F.concat(F.lit("<!-- id "), F.col("event_id").cast("string"), F.lit(" -->\n**User** ("), F.date_format("ts", "h:mm a"), F.lit("): "), "event_type", F.lit("\n"))
    logs = t.events.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", said.alias("said")))), lambda x: x["said"]), "\n").alias("log"))  # one text each
    parts = segments.segments(logs, "user_id", "log", 120)
    headed = F.col("segment_text").startswith("<!-- id").cast("int")
    return parts.select("user_id", "segment", F.size(F.regexp_extract_all("segment_text", F.lit(r"\*\*User\*\*"), F.lit(0))).cast("long").alias("messages"), headed.alias("headed"))
