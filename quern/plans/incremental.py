"""Change detection and merges over documents, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change
from .registry import query

#: yesterday's snapshot: two ids in ten absent, one in ten with other content
_OLD = "SELECT doc_id, source, md5(CASE WHEN doc_id % 10 = 3 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 < 8"
_NEW = "SELECT doc_id, source, md5(text) AS h FROM documents WHERE doc_id % 10 > 0"


def _snapshots(t):
    d = t.documents
    old = d.where("doc_id % 10 < 8").select("doc_id", "source", F.md5(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"))
    new = d.where("doc_id % 10 > 0").select("doc_id", "source", F.md5("text").alias("h"))
    return old, new


_DIFF = """SELECT doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS change
           FROM o FULL JOIN n USING (doc_id)"""


@query(f"WITH o AS ({_OLD}), n AS ({_NEW}) {_DIFF}")
def hash_diff(t):
    return change.diff(*_snapshots(t), "doc_id", "h")


@query(f"WITH o AS ({_OLD} AND source IN ('src1', 'src2')), n AS ({_NEW} AND source IN ('src1', 'src2')) {_DIFF}")
def hash_diff_of_sources(t):
    old, new = (x.where(F.col("source").isin("src1", "src2")) for x in _snapshots(t))
    return change.diff(old, new, "doc_id", "h")


@query("SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS turn FROM documents")
def round_robin_order(t):
    return change.round_robin(t.documents.select("doc_id", "source"), "source", "doc_id")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0
          UNION ALL SELECT o_orderkey, 'R' FROM orders WHERE o_orderkey % 5 = 0""")
def upsert_by_key(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return change.replaced(rows, rows.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("R")), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
          FROM orders WHERE o_orderkey % 7 <> 0""")
def merge_save(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    dirty = rows.where("o_orderkey % 4 = 1").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return change.merged(rows, dirty, rows.where("o_orderkey % 7 = 0"), "o_orderkey", "o_totalprice")


@query("""SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY
          AND event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20')""")
def overlap_relist(t):
    mark = F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    return change.since(t.events, "ts", mark, 7, t.events.where(F.col("ts") < mark), "event_id").select("event_id")


@query("""WITH m AS (SELECT user_id, max(ts) AS mark FROM events WHERE event_type <> 'purchase' GROUP BY 1)
          SELECT event_id, user_id FROM events LEFT JOIN m USING (user_id) WHERE mark IS NULL OR ts > mark""")
def high_water_mark(t):
    marks = t.events.where("event_type <> 'purchase'").groupBy("user_id").agg(F.max("ts").alias("mark"))
    return t.events.join(marks, "user_id", "left").where("mark is null or ts > mark").select("event_id", "user_id")


@query("""WITH o AS (SELECT doc_id AS k, md5(text) AS h FROM documents),
          n AS (SELECT doc_id + CASE WHEN doc_id % 6 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN doc_id % 18 = 0 THEN 'edited' ELSE md5(text) END AS h FROM documents),
          g AS (SELECT h, k AS was, row_number() OVER (PARTITION BY h ORDER BY k) AS nth FROM o WHERE k NOT IN (SELECT k FROM n)),
          c AS (SELECT h, k AS now, row_number() OVER (PARTITION BY h ORDER BY k) AS nth FROM n WHERE k NOT IN (SELECT k FROM o))
          SELECT was, now, CASE WHEN now IS NULL THEN 'pruned' WHEN was IS NULL THEN 'new' ELSE 'moved' END AS change FROM g FULL JOIN c ON g.nth = c.nth AND g.h IS NOT DISTINCT FROM c.h""")
def move_detection(t):
    d = t.documents
    old = d.select(F.col("doc_id").alias("k"), F.md5("text").alias("h"))
    new = d.select((F.col("doc_id") + F.when(F.col("doc_id") % 6 == 0, 1000000).otherwise(0)).alias("k"), F.when(F.col("doc_id") % 18 == 0, "edited").otherwise(F.md5("text")).alias("h"))
    return change.moves(old, new, "k", "h")


@query("""WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_id % 997 = 0)
          SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE CAST(ts AS DATE) IN (SELECT day FROM days) GROUP BY 1""")
def late_day_recompute(t):
    late = F.col("event_id") % 997 == 0
    return change.late_days(t.events.where(~late), t.events.where(late), "ts").groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_EDIT = """WITH b AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS status,
             CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS due, '' AS note FROM orders),
           a AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'done' WHEN id % 5 = 1 THEN 'open' WHEN id % 5 = 2 THEN 'cancelled' ELSE status END AS n_status,
             CASE WHEN id % 2 = 0 THEN DATE '1998-09-01' WHEN id % 7 = 0 THEN NULL ELSE due END AS n_due, CASE WHEN id % 11 = 0 THEN 'call' ELSE note END AS n_note FROM b),
           j AS (SELECT *, status IN ('done', 'cancelled') AS was FROM b JOIN a USING (id))"""


@query(_EDIT + """
  SELECT id, 'complete' AS change, NULL AS value FROM j WHERE n_status = 'done' AND NOT was
  UNION ALL SELECT id, 'cancel', NULL FROM j WHERE n_status = 'cancelled' AND NOT was
  UNION ALL SELECT id, 'reopen', NULL FROM j WHERE was AND n_status NOT IN ('done', 'cancelled')
  UNION ALL SELECT id, 'set_due', CAST(n_due AS VARCHAR) FROM j WHERE due IS NULL AND n_due IS NOT NULL
  UNION ALL SELECT id, 'reschedule', CAST(n_due AS VARCHAR) FROM j WHERE due <> n_due
  UNION ALL SELECT id, 'clear_due', NULL FROM j WHERE due IS NOT NULL AND n_due IS NULL
  UNION ALL SELECT id, 'add_note', n_note FROM j WHERE n_note <> note""")
def edit_events(t):
    b = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"),
        F.when(F.col("o_orderkey") % 3 > 0, F.to_date("o_orderdate")).alias("due"),
        F.lit("").alias("note"),
    )
    a = b.select(
        "id",
        F.when(F.col("id") % 5 == 0, "done").when(F.col("id") % 5 == 1, "open").when(F.col("id") % 5 == 2, "cancelled").otherwise(F.col("status")).alias("status"),
        F.when(F.col("id") % 2 == 0, F.lit("1998-09-01").cast("date")).when(F.col("id") % 7 == 0, None).otherwise(F.col("due")).alias("due"),
        F.when(F.col("id") % 11 == 0, "call").otherwise(F.col("note")).alias("note"),
    )
    return change.edits(b, a, "id")


@query("""SELECT doc_id FROM documents WHERE source NOT LIKE 'src1%' AND doc_id NOT IN (SELECT item_id FROM benchmark)""")
def prune_by_prefix_or_list(t):
    listed = t.benchmark.select(F.col("item_id").alias("doc_id"))
    return t.documents.where(~F.col("source").startswith("src1")).join(listed, "doc_id", "left_anti").select("doc_id")


@query("""SELECT c_custkey, CAST(m AS DATE) AS month FROM customer, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-01' + INTERVAL 1 MONTH * CAST(c_custkey % 4 AS INTEGER), INTERVAL 1 MONTH)) AS x(m)""")
def month_windows(t):
    start = F.lit("2024-01-01").cast("date")
    months = F.sequence(start, F.add_months(start, (F.col("c_custkey") % 4).cast("int")), F.expr("interval 1 month"))
    return t.customer.select("c_custkey", F.explode(months).alias("month"))
