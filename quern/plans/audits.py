"""Audits, plans of action and lookups: ordered decisions over joined sides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query


@query("""WITH box AS (SELECT n_nationkey AS k, n_name, n_nationkey * 400 AS c FROM nation)
          SELECT c_custkey, coalesce(arg_min(n_name, k), printf('%.2f', c_acctbal)) AS place FROM customer LEFT JOIN box ON c_acctbal BETWEEN c - 150 AND c + 150 GROUP BY c_custkey, c_acctbal""")
def box_lookup(t):
    """The first known place in reach, else the value itself. The list of places is fixed: 25."""
    box = t.nation.select(F.col("n_nationkey").alias("k"), "n_name", (F.col("n_nationkey") * 400).alias("at"))
    near = (F.col("c_acctbal") >= F.col("at") - 150) & (F.col("c_acctbal") <= F.col("at") + 150)
    rows = t.customer.join(F.broadcast(box), near, "left").groupBy("c_custkey", "c_acctbal").agg(F.min_by("n_name", "k").alias("place"))
    return rows.select("c_custkey", F.coalesce("place", F.format_string("%.2f", F.bround("c_acctbal", 2))).alias("place"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS z FROM events)
          SELECT user_id, day, event_id, 'own' AS part FROM d UNION ALL SELECT user_id, CAST(day + 1 AS DATE), event_id, 'before' FROM d WHERE z <= 2 UNION ALL SELECT user_id, CAST(day - 1 AS DATE), event_id, 'after' FROM d WHERE a <= 2""")
def adjacent_days(t):
    """Each day with the last two rows before it and the first two behind it, in one pass over the days."""
    first = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    last = Window.partitionBy("user_id", "day").orderBy(F.desc("ts"), F.desc("event_id"))
    d = t.events.withColumn("day", F.to_date("ts")).withColumn("a", F.row_number().over(first)).withColumn("z", F.row_number().over(last))
    shown = F.array_compact(F.array(F.struct(F.lit(0).alias("off"), F.lit("own").alias("part")), F.when(F.col("z") <= 2, F.struct(F.lit(1).alias("off"), F.lit("before").alias("part"))), F.when(F.col("a") <= 2, F.struct(F.lit(-1).alias("off"), F.lit("after").alias("part")))))
    return d.select("user_id", "day", "event_id", F.explode(shown).alias("x")).select("user_id", F.date_add("day", F.col("x.off")).alias("day"), "event_id", "x.part")


@query("""WITH a AS (SELECT doc_id AS k, md5(text) AS h, doc_id % 100 AS m FROM documents WHERE doc_id % 6 > 0), b AS (SELECT doc_id AS k, md5(text || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END) AS h, doc_id % 70 AS m FROM documents WHERE doc_id % 9 > 0)
          SELECT k, CASE WHEN b.h IS NULL THEN 'copy' WHEN a.h IS NULL THEN 'only there' WHEN a.h = b.h THEN 'same' WHEN b.m > a.m THEN 'newer there' ELSE 'copy' END AS action FROM a FULL JOIN b USING (k)""")
def two_sided_sync(t):
    d, k = t.documents, F.col("doc_id")
    a = d.where(k % 6 > 0).select(k.alias("k"), F.md5("text").alias("h"), (k % 100).alias("m"))
    b = d.where(k % 9 > 0).select(k.alias("k"), F.md5(F.concat("text", F.when(k % 4 == 0, "x").otherwise(""))).alias("g"), (k % 70).alias("n"))
    action = F.when(F.col("g").isNull(), "copy").when(F.col("h").isNull(), "only there").when(F.col("h") == F.col("g"), "same").when(F.col("n") > F.col("m"), "newer there").otherwise("copy")
    return a.join(b, "k", "full_outer").select("k", action.alias("action"))


@query("""WITH m AS (SELECT o_custkey, min(o_orderkey) AS mk FROM orders GROUP BY 1), x AS (SELECT m.o_custkey, o.o_orderpriority AS p FROM m JOIN orders o ON o.o_orderkey = m.mk)
          SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN nullif(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END, '') END, p) AS priority FROM orders LEFT JOIN x USING (o_custkey)""")
def inherited_fields(t):
    """What an occurrence leaves out comes from its series: here the first order of a customer."""
    master = t.orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"))
    own = F.when(F.col("o_orderkey") % 3 > 0, F.nullif(F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")), F.lit("")))
    return t.orders.join(master, "o_custkey", "left").select("o_orderkey", F.coalesce(own, "p").alias("priority"))


@query("""SELECT 'phone' AS facet, c_custkey AS id FROM customer WHERE contains(right('0000000000' || c_custkey, 10), '0000012') UNION ALL SELECT 'name', c_custkey FROM customer WHERE contains(lower(c_name), '0012') UNION ALL SELECT 'nation', c_custkey FROM customer WHERE c_nationkey = 12""")
def contact_lookup(t):
    c = t.customer
    hit = lambda facet, where: c.where(where).select(F.lit(facet).alias("facet"), F.col("c_custkey").alias("id"))
    phone = hit("phone", F.lpad(F.col("c_custkey").cast("string"), 10, "0").contains("0000012"))
    return phone.unionByName(hit("name", F.lower("c_name").contains("0012"))).unionByName(hit("nation", F.col("c_nationkey") == 12))


@query("""WITH d AS (SELECT source, count(*) AS chunks, count(*) FILTER (n_chars < 200) AS broken, count(*) FILTER (lang = 'de') AS intentional FROM documents GROUP BY 1)
          SELECT source, chunks, CAST(broken AS BIGINT) AS broken, CAST(intentional AS BIGINT) AS intentional, round(broken * 4.0 / 1000, 6) AS cost FROM d""")
def context_survey(t):
    d = t.documents.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if(F.col("n_chars") < 200).alias("broken"), F.count_if(F.col("lang") == "de").alias("intentional"))
    return d.withColumn("cost", F.round(F.col("broken") * 4.0 / 1000, 6))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
          SELECT r.user_id, event_type AS usual, t.types FROM r JOIN (SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY 1) t USING (user_id) WHERE k = 1""")
def usual_and_all(t):
    """The commonest value, ties to the first in order, and the set of all: five values at most."""
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    usual = F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("usual")
    return c.groupBy("user_id").agg(usual, F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
          SELECT conv_id, right(string_agg(text, chr(10) ORDER BY turn), 500) AS tail FROM r WHERE n <= 3 GROUP BY 1""")
def last_messages(t):
    """The last three turns, and of these the last 500 characters."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = t.conversations.withColumn("n", F.row_number().over(w)).where("n <= 3")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return last.groupBy("conv_id").agg(F.right(joined, F.lit(500)).alias("tail"))


@query("""SELECT source, doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'fr') EXCEPT SELECT source, doc_id FROM documents WHERE n_chars > 3000""")
def set_difference(t):
    fr = t.documents.where("lang = 'fr'").select("source").distinct()
    return t.documents.join(fr, "source", "left_semi").select("source", "doc_id").subtract(t.documents.where("n_chars > 3000").select("source", "doc_id"))
