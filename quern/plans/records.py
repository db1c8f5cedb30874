"""Joins, filters and aggregates: tasks are orders, people are customers, calls and visits are events.

The clock is a literal in every query ("today" is 1998-07-29, a Wednesday, for orders).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import desk, tasks
from .registry import query

TODAY = "1998-07-29"
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'waiting' ELSE 'open' END"
_TASKS = f"""tasks AS (SELECT o_orderkey AS id, {_STATUS} AS status, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END AS due,
             o_orderpriority AS priority, o_custkey AS owner, o_totalprice AS price, o_orderdate AS created,
             CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 1340 END AS completed FROM orders)"""


def _tasks(t):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "waiting").otherwise("open")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        status.alias("status"),
        F.when(F.col("o_orderkey") % 5 > 0, F.to_date("o_orderdate")).alias("due"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").alias("owner"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("created"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), 1340)).alias("completed"),
    )


def _today():
    return F.lit(TODAY).cast("date")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("""SELECT c_custkey, n_name, r_name, o_orderkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
          LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'""")
def left_join_chain(t):
    held = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.join(held, "c_custkey", "left").select("c_custkey", "n_name", "r_name", "o_orderkey")


@query("""WITH j AS (SELECT coalesce(CASE WHEN event_id % 9 > 0 THEN CAST(event_id % 4000 AS VARCHAR) END, CAST(ts AS DATE) || '-' || user_id) AS k, event_id, ts FROM events),
          r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS n FROM j) SELECT k, event_id FROM r WHERE n = 1""")
def first_of_fan_out(t):
    key = F.coalesce(F.when(F.col("event_id") % 9 > 0, (F.col("event_id") % 4000).cast("string")), F.concat(F.to_date("ts").cast("string"), F.lit("-"), F.col("user_id").cast("string")))
    rows = t.events.select(key.alias("k"), "event_id", "ts")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("ts", "event_id"))).where("n = 1").select("k", "event_id")


@query("""SELECT o_orderkey, array_to_string(list_sort(list(l_partkey)), ',') AS parts, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def attached_list(t):
    # a list for one order: as long as the order
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_partkey")).alias("l"), F.count("l_partkey").alias("n"))
    rows = t.orders.select("o_orderkey").join(lists, "o_orderkey", "left")
    return rows.select("o_orderkey", F.array_join("l", ",").alias("parts"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_join(t):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_join(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT event_id, coalesce(CASE event_type WHEN 'view' THEN 'Viewing' WHEN 'click' THEN 'Clicking' END, CASE substr(event_type, 1, 1) WHEN 'p' THEN 'P-group' END, event_type) AS label FROM events""")
def map_lookup(t):
    two = t.spark.createDataFrame([("view", "Viewing"), ("click", "Clicking")], "event_type string, a string")  # fixed lists
    one = t.spark.createDataFrame([("p", "P-group")], "i string, b string")
    rows = t.events.withColumn("i", F.substring("event_type", 1, 1)).join(F.broadcast(two), "event_type", "left").join(F.broadcast(one), "i", "left")
    return rows.select("event_id", F.coalesce("a", "b", "event_type").alias("label"))


@query("""WITH p AS (SELECT c_custkey, lower(c_name) AS name, right('0000000000' || c_custkey, 10) AS phone FROM customer),
          q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper('Customer#' || right('000000000' || s_suppkey, 9)) ELSE '+1' || right('0000000000' || s_suppkey, 10) END AS handle FROM supplier)
          SELECT s_suppkey, coalesce(CAST(a.c_custkey AS VARCHAR), CAST(b.c_custkey AS VARCHAR), handle) AS who
          FROM q LEFT JOIN p a ON a.name = lower(handle) LEFT JOIN p b ON b.phone = regexp_replace(handle, '^\\+1', '')""")
def identity_fallbacks(t):
    people = t.customer.select("c_custkey", F.lower("c_name").alias("name"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("phone"))
    key = F.col("s_suppkey").cast("string")
    handle = F.when(F.col("s_suppkey") % 2 == 0, F.upper(F.concat(F.lit("Customer#"), F.lpad(key, 9, "0")))).otherwise(F.concat(F.lit("+1"), F.lpad(key, 10, "0")))
    rows = t.supplier.select("s_suppkey", handle.alias("handle"), F.lower(handle).alias("name"), F.regexp_replace(handle, r"^\+1", "").alias("phone"))
    rows = rows.join(people.select("name", F.col("c_custkey").alias("a")), "name", "left").join(people.select("phone", F.col("c_custkey").alias("b")), "phone", "left")
    return rows.select("s_suppkey", F.coalesce(F.col("a").cast("string"), F.col("b").cast("string"), "handle").alias("who"))


@query("""WITH u AS (SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS only_type FROM part WHERE p_size < 10 GROUP BY 1)
          SELECT p_partkey, only_type FROM part LEFT JOIN u USING (p_brand)""")
def unique_only_resolution(t):
    u = t.part.where("p_size < 10").groupBy("p_brand").agg(F.when(F.count_distinct("p_type") == 1, F.min("p_type")).alias("only_type"))
    return t.part.join(u, "p_brand", "left").select("p_partkey", "only_type")


@query("""WITH e AS (SELECT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = 7)
          SELECT DISTINCT 'out' AS direction, l_suppkey AS node, o_custkey AS other FROM e UNION ALL SELECT DISTINCT 'in', o_custkey, l_suppkey FROM e""")
def neighbours_both_ways(t):
    e = t.orders.join(t.lineitem.where("l_suppkey = 7"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    out = e.select(F.lit("out").alias("direction"), F.col("l_suppkey").alias("node"), F.col("o_custkey").alias("other"))
    return out.union(e.select(F.lit("in"), "o_custkey", "l_suppkey"))


def _mode(mode, where):
    @query(f"WITH {_TASKS} SELECT id FROM tasks WHERE {where}")
    def f(t):
        return _tasks(t).where(tasks.in_mode(mode, F.col("status"), F.col("due"), _today())).select("id")

    return f


def _named():
    from .registry import ORACLE_SQL, QUERIES

    for mode, where in {
        "open": "status IN ('open', 'in_progress', 'waiting')",
        "due": f"due <= DATE '{TODAY}' AND status NOT IN ('done', 'cancelled')",
        "overdue": f"due < DATE '{TODAY}' AND status NOT IN ('done', 'cancelled')",
        "due_today": f"due = DATE '{TODAY}'",
        "due_this_week": f"due BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + CAST(7 - isodow(DATE '{TODAY}') AS INTEGER) AND status NOT IN ('done', 'cancelled')",
        "done": "status = 'done'",
        "all": "true",
    }.items():
        _mode(mode, where)
        QUERIES[f"tasks_{mode}"], ORACLE_SQL[f"tasks_{mode}"] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_named()


@query(f"""WITH {_TASKS}, o AS (SELECT * FROM tasks WHERE status <> 'done')
           SELECT id, due, (SELECT count(*) FROM o) AS total FROM o ORDER BY due NULLS LAST, created DESC, id LIMIT 50 OFFSET 50""")
def task_page(t):
    return tasks.page(_tasks(t).where("status <> 'done'"), 50, 50).select("id", "due", "total")


@query(f"""WITH {_TASKS} SELECT id, date_diff('day', due, DATE '{TODAY}') AS age, CASE WHEN due < DATE '{TODAY}' THEN 'OVERDUE' WHEN due = DATE '{TODAY}' THEN 'DUE TODAY' ELSE '' END AS mark FROM tasks""")
def due_marks(t):
    return _tasks(t).select("id", F.datediff(_today(), "due").cast("long").alias("age"), tasks.due_mark(F.col("due"), _today()).alias("mark"))


_LIVE = "status NOT IN ('done', 'cancelled', 'waiting', 'blocked', 'scheduled')"
_BUCKETS = {
    "overdue": f"due < DATE '{TODAY}' AND {_LIVE}", "due_today": f"due = DATE '{TODAY}' AND {_LIVE}", "this_week": f"due > DATE '{TODAY}' AND due <= DATE '1998-08-02' AND {_LIVE}",
    "next_week": f"due > DATE '1998-08-02' AND due <= DATE '1998-08-09' AND {_LIVE}", "needs_date": f"due IS NULL AND {_LIVE}", "blocked": "status IN ('waiting', 'blocked', 'scheduled')",
    "recently_done": f"status = 'done' AND completed >= DATE '{TODAY}' - 7",
}


@query(f"WITH {_TASKS} SELECT " + ", ".join(f"CAST(count(*) FILTER ({w}) AS BIGINT) AS {n}" for n, w in _BUCKETS.items()) + " FROM tasks")
def task_dashboard(t):
    return tasks.dashboard(_tasks(t), _today())


@query(f"""WITH {_TASKS}, a AS (SELECT owner, date_diff('day', due, DATE '{TODAY}') AS age FROM tasks WHERE status <> 'done' AND due <= DATE '{TODAY}')
           SELECT CASE WHEN age <= 7 THEN 'watch' WHEN age <= 21 THEN 'chase' ELSE 'stale' END AS stage, count(*) AS n, count(DISTINCT owner) AS owners, min(age) AS youngest, max(age) AS oldest FROM a GROUP BY 1""")
def commitment_aging(t):
    a = _tasks(t).where("status <> 'done'").where(F.col("due") <= _today()).select("owner", F.datediff(_today(), "due").cast("long").alias("age"))
    return a.groupBy(tasks.aging(F.col("age")).alias("stage")).agg(F.count("*").alias("n"), F.count_distinct("owner").alias("owners"), F.min("age").alias("youngest"), F.max("age").alias("oldest"))


@query(f"""WITH {_TASKS}, r AS (SELECT id, priority, due, row_number() OVER (ORDER BY priority, coalesce(due, DATE '9999-12-31'), id) AS rank FROM tasks WHERE status = 'open') SELECT id, rank FROM r WHERE rank <= 100""")
def rank_sort(t):
    top = _tasks(t).where("status = 'open'").orderBy("priority", F.coalesce("due", F.lit("9999-12-31").cast("date")), "id").limit(100)
    return top.select("id", F.row_number().over(Window.orderBy("priority", F.coalesce("due", F.lit("9999-12-31").cast("date")), "id")).cast("long").alias("rank"))


@query("""SELECT o_orderkey, CAST(d + 1 AS DATE) AS daily, CAST(d + CAST(CASE WHEN isodow(d) >= 4 THEN 11 - isodow(d) ELSE 4 - isodow(d) END AS INTEGER) AS DATE) AS thursday,
          CAST(CASE WHEN date_trunc('month', d) + INTERVAL 14 DAY > d THEN date_trunc('month', d) + INTERVAL 14 DAY ELSE date_trunc('month', d) + INTERVAL 1 MONTH + INTERVAL 14 DAY END AS DATE) AS monthly
          FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def recurrence(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", tasks.next_daily(d).alias("daily"), tasks.next_weekly(d, "THU").alias("thursday"), tasks.next_monthly(d, 15).alias("monthly"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_key(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_join_count(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT label, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS label FROM part) GROUP BY 1")
def multi_label_count(t):
    return t.part.select(F.explode(F.split("p_type", " ")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT CAST(ts AS DATE) AS day, user_id, round(sum(value), 4) AS total FROM events WHERE value > 0 GROUP BY 1, 2),
          r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, user_id) AS n, round(sum(total) OVER (PARTITION BY day), 2) AS day_total FROM a)
          SELECT day, user_id AS top_user, total AS top_total, day_total FROM r WHERE n = 1""")
def usage_by_day(t):
    a = t.events.where("value > 0").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    top = F.max_by(F.struct("user_id", "total"), F.struct("total", -F.col("user_id")))
    return a.groupBy("day").agg(top.alias("t"), F.round(F.sum("total"), 2).alias("day_total")).select("day", F.col("t.user_id").alias("top_user"), F.col("t.total").alias("top_total"), "day_total")


@query("""SELECT CAST(ts AS DATE) AS day, event_type, min(event_id) AS first_id, count(*) AS visits, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2""")
def day_dedup_with_counts(t):
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("visits"), F.count_distinct("user_id").alias("users"))


@query("""WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v, arg_max(event_id, event_id) AS e FROM events GROUP BY 1, 2)
          SELECT user_id, round(sum(v), 4) AS fresh, round(max(v), 4) AS peak, count(*) AS messages FROM l GROUP BY 1""")
def usage_last_wins(t):
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    return last.groupBy("user_id").agg(F.round(F.sum("v"), 4).alias("fresh"), F.round(F.max("v"), 4).alias("peak"), F.count("*").alias("messages"))


@query("""WITH a AS (SELECT event_type, list_sort(list(value)) AS v, sum(value) AS s FROM events WHERE value IS NOT NULL GROUP BY 1)
          SELECT event_type, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT) + 1] AS p50, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS BIGINT) + 1] AS p90, v[CAST(round_even(0.99 * (len(v) - 1), 0) AS BIGINT) + 1] AS p99 FROM a""")
def nearest_rank_percentiles(t):
    rank = lambda p: lambda n: F.bround(F.lit(p) * (n - 1), 0).cast("long")
    return desk.at_ranks(t.events, ["event_type"], "value", {"p50": rank(0.5), "p90": rank(0.9), "p99": rank(0.99)})


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_burners(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).orderBy(F.desc("total"), "l_suppkey").limit(10)


@query("""WITH i AS (SELECT doc_id, source FROM documents WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id + 5000000, source FROM documents WHERE doc_id % 50 = 0),
          j AS (SELECT coalesce(d.source, i.source) AS source, d.doc_id AS a, i.doc_id AS b FROM documents d FULL JOIN i ON d.doc_id = i.doc_id)
          SELECT source, count(a) AS disk, CAST(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS indexed, CAST(count(*) FILTER (b IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (a IS NULL) AS BIGINT) AS orphan,
                 CASE WHEN count(a) = 0 THEN 100.0 ELSE round(100.0 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(a), 1) END AS pct FROM j GROUP BY 1""")
def coverage_by_source(t):
    d = t.documents.select("doc_id", "source")
    i = d.where("doc_id % 4 > 0").union(d.where("doc_id % 50 = 0").select(F.col("doc_id") + 5000000, "source")).select(F.col("doc_id").alias("b"), F.col("source").alias("s"))
    j = d.join(i, F.col("doc_id") == F.col("b"), "full_outer").groupBy(F.coalesce("source", "s").alias("source"))
    both = F.count_if(F.col("doc_id").isNotNull() & F.col("b").isNotNull())
    pct = F.when(F.count("doc_id") == 0, 100.0).otherwise(F.round(F.lit(100.0) * both / F.count("doc_id"), 1))
    return j.agg(F.count("doc_id").alias("disk"), both.alias("indexed"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("doc_id").isNull()).alias("orphan"), pct.alias("pct"))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 3) AS mean FROM documents GROUP BY GROUPING SETS ((source), ())")
def totals_row(t):
    return t.documents.rollup("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 3).alias("mean"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), l AS (SELECT day, n, lag(n) OVER (ORDER BY day) AS before FROM d)
          SELECT day, n, before FROM l WHERE n < 0.8 * before""")
def day_over_day_drop(t):
    d = t.events.where("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("before", F.lag("n").over(Window.orderBy("day"))).where("n < 0.8 * before").select("day", "n", "before")  # a row a day


@query("""SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(length(text)) AS chars FROM conversations GROUP BY 1""")
def speaker_stats(t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("chars"))


@query("SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def hour_buckets(t):
    return t.events.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS nodes, count(c_mktsegment) AS with_segment, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS negative FROM customer""")
def provenance_coverage(t):
    return t.customer.agg(F.count("*").alias("nodes"), F.count("c_mktsegment").alias("with_segment"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))


@query("""SELECT event_type, CAST(count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) < 50) AS BIGINT) AS dropped, CAST(count(*) FILTER (NOT CAST(json_extract_string(props, '$.k') AS BIGINT) < 50) AS BIGINT) AS delivered FROM events GROUP BY 1""")
def dropped_and_delivered(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.count_if(k < 50).alias("dropped"), F.count_if(~(k < 50)).alias("delivered"))
