"""Retrieval and graph queries. Document ids and vector ids are paired by number only."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import recency
from ..operators import postings
from ..operators import retrieval as r
from ..tables import exists
from .registry import query

TERMS = ["the", "and", "of", "der", "que"]  # fixed query terms
_VECTOR = "q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)"
_DENSE = "SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 9) AS dense FROM embeddings, q"
_WORDS = r"w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}0-9]+'), lambda x: x <> '') AS w FROM documents)"
_BM25 = f"""{_WORDS}, s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
  f AS (SELECT id, len(w) AS size, unnest(w) AS term FROM w), tf AS (SELECT id, size, term, count(*) AS tf FROM f WHERE term IN ({", ".join(f"'{x}'" for x in TERMS)}) GROUP BY 1, 2, 3),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  b AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS sparse FROM tf JOIN df USING (term), s GROUP BY 1)"""


def _vector(t) -> list[float]:
    return t.embeddings.orderBy("vec_id").limit(1).first()["embedding"]


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


_INDEXES: dict[tuple, str] = {}  # of this session, by application and table: an index is written once and read by term


def _indexed(t, name: str, rows, fields: list[str]) -> postings.Postings:
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _INDEXES or not exists(t.spark, f"{_INDEXES[key]}/fields/_SUCCESS"):
        _INDEXES[key] = postings.written(rows(), fields)
    return postings.opened(t.spark, _INDEXES[key])


def _texts(t) -> postings.Postings:
    return _indexed(t, "documents", lambda: t.documents.select(F.col("doc_id").alias("id"), "text"), ["text"])


def _facts(t) -> postings.Postings:
    """Order lines between a customer and a supplier are facts: a name and what it says."""
    return _indexed(t, "facts", lambda: _edges(t).select("id", "name", "fact"), ["name", "fact"])


def _edges(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 25).cast("long").alias("dst"), F.lower("o_orderpriority").alias("name"), F.concat_ws(" ", F.lit("order of"), F.date_format("o_orderdate", "yyyy MM"), F.lit("status"), "o_orderstatus").alias("fact"))


def _nodes(t) -> postings.Postings:
    return _indexed(t, "nodes", lambda: t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("summary")), ["name", "summary"])


@query(f"WITH {_VECTOR} {_DENSE} ORDER BY dense DESC, id LIMIT 20")
def dense_search(t):
    return r.dense(_vectors(t), _vector(t), 20).select("id", "dense")


@query(f"WITH {_VECTOR} {_DENSE} WHERE label IN (1, 3) AND vec_id >= 100 ORDER BY dense DESC, id LIMIT 20")
def dense_search_filtered(t):
    return r.dense(_vectors(t), _vector(t), 20, F.col("label").isin(1, 3) & (F.col("id") >= 100)).select("id", "dense")


@query(f"WITH {_BM25} SELECT id, sparse FROM b ORDER BY sparse DESC, id LIMIT 20")
def bm25_search(t):
    return postings.search(_texts(t), TERMS, 20, "sparse")


_SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}0-9]+'), lambda x: x <> '')"


def _bm25_twin(source: str, fields: list[str], terms: list[str], limit: int) -> str:
    """BM25 summed over the fields of a table (id, ...)."""
    each = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {_SPLIT.format(f'coalesce({f}, {chr(39) * 2})')} AS w FROM e" for f in fields)
    return f"""WITH e AS ({source}), w AS ({each}), s AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM w GROUP BY 1), x AS (SELECT id, field, len(w) AS size, unnest(w) AS term FROM w),
      tf AS (SELECT id, field, size, term, count(*) AS tf FROM x WHERE term IN ({", ".join(f"'{v}'" for v in terms)}) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL)
      SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score FROM tf JOIN df USING (field, term) JOIN s USING (field) GROUP BY 1 ORDER BY score DESC, id LIMIT {limit}"""


_EDGES = "SELECT o_orderkey AS id, lower(o_orderpriority) AS name, 'order of ' || strftime(o_orderdate, '%Y %m') || ' status ' || o_orderstatus AS fact FROM orders"
_PARTS = "SELECT p_partkey AS id, p_name AS name, p_type || ' ' || p_brand || ' ' || p_name AS summary FROM part"


@query(_bm25_twin(_EDGES, ["name", "fact"], ["urgent", "1997", "05"], 25))
def fact_search(t):
    """Facts by the words of their name and text."""
    return postings.search(_facts(t), ["Urgent", "1997", "05"], 25)


@query(f"""SELECT 'node' AS kind, * FROM ({_bm25_twin(_PARTS, ["name", "summary"], ["economy", "widget"], 10)}) UNION ALL SELECT 'fact', * FROM ({_bm25_twin(_EDGES, ["name", "fact"], ["economy", "widget"], 10)})""")
def node_search(t):
    """Nodes by name and summary, and the facts that the same words find."""
    one = lambda index, kind: postings.search(index, ["economy", "widget"], 10).select(F.lit(kind).alias("kind"), "id", "score")
    return one(_nodes(t), "node").union(one(_facts(t), "fact"))


@query(r"""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}0-9]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
  q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}0-9]+'), lambda x: x <> '')) AS term FROM benchmark), x AS (SELECT id, len(w) AS size, unnest(w) AS term FROM w),
  tf AS (SELECT id, size, term, count(*) AS tf FROM x SEMI JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  b AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM b) SELECT * FROM k WHERE rank <= 3""")
def benchmark_search(t):
    """The three best documents for each benchmark item, by its words."""
    return postings.search_each(_texts(t), t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 3)


_HYBRID = f"""WITH {_VECTOR}, {_BM25}, d AS ({_DENSE} ORDER BY dense DESC, id LIMIT 30), p AS (SELECT id, sparse FROM b ORDER BY sparse DESC, id LIMIT 30),
  l AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY dense DESC, id)) AS r FROM d UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY sparse DESC, id)) FROM p),
  u AS (SELECT id, round(sum(r), 9) AS fused FROM l GROUP BY 1),
  j AS (SELECT u.id, fused, dense, source, CASE WHEN source = 'src3' THEN fused * 1.15 ELSE fused END AS boosted, CASE WHEN u.id % 10 = 0 THEN NULL ELSE DATE '2024-01-01' - CAST(u.id % 365 AS INTEGER) END AS day FROM u LEFT JOIN d USING (id) JOIN documents ON doc_id = u.id),
  k AS (SELECT *, round(boosted, 12) AS primary_score, boosted * (1 + 0.15 * CASE WHEN day IS NULL THEN 0.5 ELSE pow(0.5, greatest(0, DATE '2024-01-01' - day) / 90.0) END) * (1 + 0.10 * (0.5 - 0.5)) AS final FROM j WHERE dense IS NULL OR dense >= 0.05),
  c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY primary_score DESC, id) AS nth FROM k), picked AS (SELECT * FROM c ORDER BY CASE WHEN nth > 2 THEN 1 ELSE 0 END, primary_score DESC, id LIMIT 10)"""


@query(f"{_HYBRID} SELECT id, source, fused, dense, round(final, 9) AS final, row_number() OVER (ORDER BY round(final, 9) DESC, id) AS place FROM picked")
def hybrid_search(t):
    """Both legs, fused by rank; a favoured source boosted, weak vectors cut, two a source. Recency and importance only reorder what is selected."""
    near, lexical = r.dense(_vectors(t), _vector(t), 30).select("id", "dense"), postings.search(_texts(t), TERMS, 30, "sparse")
    rows = r.fused([(near, "dense"), (lexical, "sparse")]).join(near, "id", "left").join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id")
    boosted = F.when(F.col("source") == "src3", F.col("fused") * 1.15).otherwise(F.col("fused"))
    today = F.lit("2024-01-01").cast("date")
    day = F.when(F.col("id") % 10 != 0, F.date_sub(today, (F.col("id") % 365).cast("int")))
    rows = rows.where("dense is null or dense >= 0.05").withColumn("boosted", boosted).withColumn("primary", F.round("boosted", 12))
    picked = r.capped(rows, "source", [F.desc("primary"), F.asc("id")], 2, 10)
    final = F.round(r.degraded(F.col("boosted"), recency(day, today), F.lit(None).cast("double")), 9)
    place = F.row_number().over(Window.orderBy(F.desc("final"), "id")).cast("long")  # ten rows
    return picked.withColumn("final", final).select("id", "source", "fused", "dense", "final", place.alias("place"))


@query(f"WITH {_VECTOR}, d AS ({_DENSE} ORDER BY dense DESC, id LIMIT 20) SELECT max(dense) AS best, max(dense) < 0.65 AS no_strong_match FROM d WHERE id > 0")
def no_strong_match(t):
    top = r.dense(_vectors(t), _vector(t), 20).where("id > 0")
    return top.agg(F.max("dense").alias("best"), (F.max("dense") < 0.65).alias("no_strong_match"))


@query("""WITH s AS (SELECT a.vec_id AS q, a.label AS wanted, a.label = b.label AS hit, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score, b.vec_id AS id
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
          r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s),
          m AS (SELECT q, wanted, min(CASE WHEN hit THEN rank END) AS first_hit, max(score) AS best FROM r WHERE rank <= 8 GROUP BY 1, 2)
          SELECT CAST(count(*) FILTER (wanted <> 9) AS BIGINT) AS queries, CAST(count(*) FILTER (wanted <> 9 AND first_hit <= 3) AS BIGINT) AS hit3, CAST(count(*) FILTER (wanted <> 9 AND first_hit <= 8) AS BIGINT) AS hit8,
                 CAST(count(*) FILTER (wanted = 9) AS BIGINT) AS negatives, CAST(count(*) FILTER (wanted = 9 AND best < 0.65) AS BIGINT) AS negatives_passed FROM m""")
def graded_eval(t):
    """Every row with an id divisible by 20 against all rows; label 9 stands for queries that nothing should answer well."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    top = r.nearest_labels(rows, rows.where("id % 20 = 0"), 8)
    m = top.groupBy("q", "wanted").agg(F.min(F.when(F.col("label") == F.col("wanted"), F.col("rank"))).alias("f"), F.max("score").alias("best"))
    real = F.col("wanted") != 9
    return m.agg(
        F.count_if(real).alias("queries"), F.count_if(real & (F.col("f") <= 3)).alias("hit3"), F.count_if(real & (F.col("f") <= 8)).alias("hit8"),
        F.count_if(~real).alias("negatives"), F.count_if(~real & (F.col("best") < 0.65)).alias("negatives_passed"),
    )


# graph: customers and suppliers are nodes, an order line is a fact between them


@query("""SELECT c_custkey, c_name, CASE WHEN lower(c_name) = 'customer#000000012' THEN 0 WHEN lower(c_name) LIKE 'customer#00000001%' THEN 1 ELSE 2 END AS tier FROM customer
          WHERE contains(lower(c_name), '00000001') ORDER BY tier, length(c_name), c_custkey LIMIT 5""")
def entity_lookup(t):
    name = F.lower("c_name")
    tier = F.when(name == "customer#000000012", 0).when(name.startswith("customer#00000001"), 1).otherwise(2)
    return t.customer.where(name.contains("00000001")).select("c_custkey", "c_name", tier.alias("tier")).orderBy("tier", F.length("c_name"), "c_custkey").limit(5)


_LOOKED = """e AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY CASE WHEN lower(c_name) = 'customer#000000012' THEN 0 WHEN lower(c_name) LIKE 'customer#00000001%' THEN 1 ELSE 2 END, length(c_name), c_custkey) AS place FROM customer WHERE contains(lower(c_name), '00000001') QUALIFY place <= 5),
  r AS (SELECT o_custkey AS n, o_orderkey AS id, o_orderkey % 25 AS other, 'outgoing' AS direction FROM orders UNION ALL SELECT o_orderkey % 25, o_orderkey, o_custkey, 'incoming' FROM orders),
  k AS (SELECT e.c_custkey, place, id, other, direction, row_number() OVER (PARTITION BY e.c_custkey ORDER BY id, direction) AS nth FROM e LEFT JOIN r ON r.n = e.c_custkey)"""


@query(f"WITH {_LOOKED} SELECT c_custkey, CAST(place AS INTEGER) AS place, id, other, direction FROM k WHERE nth <= 20")
def entity_relationships(t):
    """The entities that a name finds, each with twenty facts at most, in either direction."""
    name = F.lower("c_name")
    tier = F.when(name == "customer#000000012", 0).when(name.startswith("customer#00000001"), 1).otherwise(2)
    found = t.customer.where(name.contains("00000001")).select("c_custkey", tier.alias("tier"), F.length("c_name").alias("size")).orderBy("tier", "size", "c_custkey").limit(5)
    found = found.select("c_custkey", F.row_number().over(Window.orderBy("tier", "size", "c_custkey")).alias("place"))  # five rows
    return r.with_facts(found, "c_custkey", _edges(t), 20).select("c_custkey", "place", "id", "other", "direction")


_FACTS = "f AS (SELECT o_custkey AS src, o_orderkey AS id, o_orderdate AS created, o_orderpriority AS fact FROM orders)"


@query(f"""WITH {_FACTS}, c AS (SELECT *, lag(lower(trim(fact))) OVER (PARTITION BY src ORDER BY created, id) AS before FROM f),
          k AS (SELECT * FROM c WHERE before IS DISTINCT FROM lower(trim(fact))) SELECT src, id, fact, created AS valid_at, lead(created) OVER (PARTITION BY src ORDER BY created, id) AS invalid_at, lead(id) OVER (PARTITION BY src ORDER BY created, id) AS superseded_by FROM k""")
def superseded_facts(t):
    """Each new text of a fact supersedes the one before; the same text again is none."""
    w = Window.partitionBy("src").orderBy("created", "id")
    f = t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("fact"))
    kept = f.withColumn("text", F.lower(F.trim("fact"))).withColumn("before", F.lag("text").over(w)).where("not before <=> text")
    return kept.select("src", "id", "fact", F.col("created").alias("valid_at"), F.lead("created").over(w).alias("invalid_at"), F.lead("id").over(w).alias("superseded_by"))


@query(f"""WITH {_FACTS}, v AS (SELECT src, id, fact, created AS valid_at, lead(created) OVER (PARTITION BY src ORDER BY created, id) AS invalid_at FROM f)
          SELECT src, id, fact FROM v WHERE valid_at <= TIMESTAMP '1996-06-01' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1996-06-01')""")
def as_of_view(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    at = F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00'")
    v = t.orders.withColumn("invalid_at", F.lead("o_orderdate").over(w)).where((F.col("o_orderdate") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)))
    return v.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("fact"))


@query("""WITH m AS (SELECT c_custkey AS was, c_custkey - 1 AS survivor FROM customer WHERE c_custkey % 100 = 1 AND c_custkey > 1)
          SELECT o_orderkey, coalesce(survivor, o_custkey) AS src, survivor IS NOT NULL AS rewritten FROM orders LEFT JOIN m ON was = o_custkey
          UNION ALL SELECT o_orderkey, o_custkey, NULL FROM orders JOIN m ON was = o_custkey""")
def merged_entities(t):
    """Facts of a merged node move to its survivor; the originals stay, stamped."""
    m = t.customer.where("c_custkey % 100 = 1 and c_custkey > 1").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") - 1).alias("survivor"))
    rows = t.orders.select("o_orderkey", "o_custkey").join(m, "o_custkey", "left")
    moved = rows.select("o_orderkey", F.coalesce("survivor", "o_custkey").alias("src"), F.col("survivor").isNotNull().alias("rewritten"))
    return moved.union(rows.where("survivor is not null").select("o_orderkey", "o_custkey", F.lit(None).cast("boolean")))


@query("""SELECT 'customer' AS type, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'line', count(*) FROM lineitem""")
def graph_stats(t):
    parts = [d.agg(F.lit(n).alias("type"), F.count("*").alias("n")) for n, d in (("customer", t.customer), ("supplier", t.supplier), ("line", t.lineitem))]
    return parts[0].union(parts[1]).union(parts[2])
