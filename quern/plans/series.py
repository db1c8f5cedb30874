"""Windows, streaks, slices and intervals over events, conversations and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, ranks, tasks
from .registry import query


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_id, user_id, n FROM r WHERE n <= 20""")
def latest_per_key(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.select("event_id", "user_id", F.row_number().over(w).cast("long").alias("n")).where("n <= 20")


@query("""WITH r AS (SELECT user_id, ts AS t0, CASE event_type WHEN 'error' THEN 'cancelled' WHEN 'purchase' THEN 'ok' ELSE 'failed' END AS status FROM events),
          w AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t0 DESC RANGE UNBOUNDED PRECEDING) AS broken FROM r WHERE status <> 'cancelled')
          SELECT user_id, count(*) AS streak, min(t0) AS since, max(t0) AS latest FROM w WHERE broken = 0 GROUP BY 1
          HAVING count(*) >= 2 AND date_diff('day', CAST(max(t0) AS DATE), DATE '2024-01-30') <= 7""")
def failure_streak(t):
    status = F.when(F.col("event_type") == "error", "cancelled").when(F.col("event_type") == "purchase", "ok").otherwise("failed")
    runs = t.events.select("user_id", F.col("ts").alias("at"), status.alias("status"))
    return tasks.failure_streaks(runs, "user_id", F.desc("at"), F.lit("2024-01-30").cast("date"))


@query("""WITH s AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS mine, max(turn) AS last FROM conversations GROUP BY 1)
          SELECT conv_id, count(*) AS pending, max(last) AS last FROM conversations JOIN s USING (conv_id) WHERE mine IS NULL OR turn > mine GROUP BY 1""")
def unanswered(t):
    return intervals.trailing_run(t.conversations, "conv_id", "turn", F.col("role") == "assistant")


@query("""WITH c AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents)
          SELECT doc_id, source FROM c WHERE n <= 2 ORDER BY n_chars DESC, doc_id LIMIT 10""")
def capped_per_source(t):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    rows = t.documents.withColumn("n", F.row_number().over(w)).where("n <= 2")
    return rows.orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "source")


@query("""WITH f AS (SELECT user_id, CAST(floor(epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id))) AS BIGINT) AS off FROM events),
          s AS (SELECT user_id, unnest(range(greatest(0, CAST(floor((off - 36000) / 18000.0) AS BIGINT) + 1), off // 18000 + 1)) AS slice FROM f)
          SELECT user_id, slice, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 3""")
def anchored_slices(t):
    return intervals.anchored_slices(t.events, "user_id", "ts", 36000, 18000, 3)


@query("""WITH l AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 7200 AS new FROM events),
          s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM l)
          SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS began, max(ts) AS ended FROM s GROUP BY 1, 2""")
def gap_sessions(t):
    rows = intervals.gap_sessions(t.events, "user_id", "ts", ["event_id"], 7200)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


@query("""WITH l AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS new FROM conversations),
          s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM l)
          SELECT conv_id, CAST(island AS BIGINT) AS island, min(role) AS role, count(*) AS turns, min(turn) AS first_turn FROM s GROUP BY 1, 2""")
def turn_merge(t):
    rows = intervals.islands(t.conversations, "conv_id", "turn", "role")
    return rows.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at FROM events GROUP BY 1")
def latest_status(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"))


_MEET = """m AS (SELECT event_id AS id, user_id, epoch(ts) AS s, epoch(ts) + 1800 + value * 60 AS e FROM events WHERE event_type = 'view')"""


def _meetings(t):
    at = intervals.seconds(F.col("ts"))
    return t.events.where("event_type = 'view'").select(F.col("event_id").alias("id"), "user_id", at.alias("s"), (at + 1800 + F.col("value") * 60).alias("e"))


@query(f"WITH {_MEET} SELECT x.user_id, x.id AS a, y.id AS b FROM m x JOIN m y ON x.user_id = y.user_id AND x.id < y.id AND x.s < y.e AND y.s < x.e")
def interval_overlaps(t):
    return intervals.overlaps(_meetings(t), "user_id", "id", "s", "e", 86400.0)


@query(f"""WITH {_MEET}, g AS (SELECT user_id, s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM m)
           SELECT user_id, CAST(count(*) FILTER (gap >= 2700) AS BIGINT) AS n FROM g GROUP BY 1""")
def free_blocks(t):
    return intervals.free_blocks(_meetings(t), "user_id", "s", "e", 2700)


@query(f"""WITH {_MEET} SELECT user_id, CAST(make_timestamp(CAST(s * 1000000 AS BIGINT)) AS DATE) AS day, round(sum(e - s) / 3600, 4) AS hours FROM m GROUP BY 1, 2""")
def meeting_hours(t):
    day = F.to_date(F.timestamp_seconds("s"))
    return _meetings(t).groupBy("user_id", day.alias("day")).agg(F.round(F.sum(F.col("e") - F.col("s")) / 3600, 4).alias("hours"))


@query("""WITH r AS (SELECT o_custkey, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
          SELECT o_custkey FROM r WHERE n <= 4 GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') >= 2 AND count(DISTINCT CAST(o_orderdate AS DATE)) >= 3""")
def zombie_series(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = t.orders.withColumn("n", F.row_number().over(w)).where("n <= 4")
    found = last.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("c"), F.count_distinct(F.to_date("o_orderdate")).alias("d"))
    return found.where("c >= 2 and d >= 3").select("o_custkey")


@query(f"""WITH {_MEET}, i AS (SELECT epoch(TIMESTAMP '2024-01-15 12:00:00') AS now)
           SELECT u.user_id, (SELECT min(id) FROM m WHERE m.user_id = u.user_id AND s <= now AND e > now) AS current_id,
                  (SELECT arg_min(id, s) FROM m WHERE m.user_id = u.user_id AND s > now) AS next_id FROM (SELECT DISTINCT user_id FROM m) u, i""")
def current_and_next(t):
    now = F.lit(1705320000.0)
    on = (F.col("s") <= now) & (F.col("e") > now)
    return _meetings(t).groupBy("user_id").agg(F.min(F.when(on, F.col("id"))).alias("current_id"), F.min_by(F.col("id"), F.when(F.col("s") > now, F.col("s"))).alias("next_id"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS hits FROM events GROUP BY 1, 2),
          m AS (SELECT *, quantile_cont(hits, 0.5) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS med FROM d)
          SELECT event_type, day, hits, med FROM m WHERE med - hits >= 2""")
def regression_alarm(t):
    d = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("hits"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-5, -1)
    return d.withColumn("med", F.expr("percentile(hits, 0.5)").over(w)).where("med - hits >= 2").select("event_type", "day", "hits", "med")


@query("""WITH b AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_id FROM b WHERE p IS NULL OR epoch(ts) - epoch(p) > 3600""")
def ttl_dedup(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    before = F.lag(intervals.seconds(F.col("ts"))).over(w)
    return t.events.withColumn("p", before).where(F.col("p").isNull() | (intervals.seconds(F.col("ts")) - F.col("p") > 3600)).select("event_id")


@query("""WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_id FROM r WHERE n > 14""")
def beyond_newest(t):
    rows = t.events.select("event_type", "ts", "event_id")
    return ranks.numbered(rows, ["event_type"], [F.desc("ts"), F.desc("event_id")], "n").where("n > 14").select("event_id")
