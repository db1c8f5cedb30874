"""Text functions over documents, pages, customers and parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as x
from ..tables import kept
from .registry import query


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS h FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|tr|h1|h2|h3)>', chr(10), 'g'), '(?i)<li[^>]*>', '- ', 'g'), '<[^>]+>', '', 'g') AS h FROM a),
  c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM b)
  SELECT page_id, trim(regexp_replace(regexp_replace(h, '[ ' || chr(9) || ']+', ' ', 'g'), '\n *(\n *)+', chr(10) || chr(10), 'g')) AS text FROM c""")
def html_to_text(t):
    return t.pages.select("page_id", x.html_text(F.col("html")).alias("text"))


_URL = "(CASE page_id % 7 WHEN 0 THEN 'CHROME://settings' WHEN 1 THEN url || '?state=abc' WHEN 2 THEN 'http://localhost:8080/x' ELSE url END)"


@query("SELECT page_id FROM pages WHERE NOT (" + " OR ".join([f"coalesce({_URL}, '') = ''", f"length({_URL}) > 500", *(f"starts_with(lower({_URL}), '{p}')" for p in x.NOISE_PREFIXES), *(f"contains(lower({_URL}), '{p}')" for p in x.NOISE_PARTS)]) + ")")
def url_noise(t):
    k = F.col("page_id") % 7
    url = F.when(k == 0, "CHROME://settings").when(k == 1, F.concat("url", F.lit("?state=abc"))).when(k == 2, "http://localhost:8080/x").otherwise(F.col("url"))
    return t.pages.where(~x.noise_url(url)).select("page_id")


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pages),
  s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 OR t = '' THEN host ELSE t END AS t FROM u), k AS (SELECT page_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 37) || '...' ELSE t END AS t FROM s)
  SELECT page_id, replace(replace(replace(t, '|', '\|'), '[', '\['), ']', '\]') AS title FROM k""")
def page_titles(t):
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return t.pages.select("page_id", x.page_title(title, F.col("url"), 40).alias("title"))


_SUBJECT = "CASE c_custkey % 4 WHEN 0 THEN 'Re: ' WHEN 1 THEN 'Fwd:  RE: ' WHEN 2 THEN 're: ' ELSE '' END || c_name"


@query(rf"SELECT c_custkey, regexp_replace({_SUBJECT}, '^(Re|RE|Fw|FW|Fwd|FWD):\s*', '') AS subject FROM customer")
def subjects(t):
    mark = F.when(F.col("c_custkey") % 4 == 0, "Re: ").when(F.col("c_custkey") % 4 == 1, "Fwd:  RE: ").when(F.col("c_custkey") % 4 == 2, "re: ").otherwise("")
    return t.customer.select("c_custkey", x.subject(F.concat(mark, "c_name")).alias("subject"))


@query(r"""WITH p AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '(212) 555-' || right('0000' || c_custkey, 4) || ' ext. 12' WHEN 1 THEN '1-212-555-' || right('0000' || c_custkey, 4)
    WHEN 2 THEN '+44 20 7946 0' || right('000' || c_custkey, 3) WHEN 3 THEN '555-' || right('0000' || c_custkey, 4) ELSE '011 49 30 901820 x7' END AS raw FROM customer),
  d AS (SELECT c_custkey, raw, regexp_replace(regexp_replace(raw, '(?i)\s*(x|ext\.?)\s*\d+$', ''), '\D', '', 'g') AS n FROM p)
  SELECT c_custkey, CASE WHEN length(n) = 10 THEN '+1' || n WHEN length(n) = 11 AND n LIKE '1%' THEN '+' || n WHEN length(n) > 11 THEN '+' || n ELSE raw END AS phone, 'customer' || c_custkey || '@mail.example' AS mail FROM d""")
def phones(t):
    k = F.col("c_custkey")
    last = lambda n: F.right(F.concat(F.lit("0000"), k.cast("string")), F.lit(n))
    raw = F.when(k % 5 == 0, F.concat(F.lit("(212) 555-"), last(4), F.lit(" ext. 12"))).when(k % 5 == 1, F.concat(F.lit("1-212-555-"), last(4)))
    raw = raw.when(k % 5 == 2, F.concat(F.lit("+44 20 7946 0"), last(3))).when(k % 5 == 3, F.concat(F.lit("555-"), last(4))).otherwise("011 49 30 901820 x7")
    mail = F.concat(F.lit("  Customer"), k.cast("string"), F.lit("@Mail.Example "))
    return t.customer.select("c_custkey", x.phone(raw).alias("phone"), x.mail_address(mail).alias("mail"))


@query(r"""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN 'Canceled:  ' ELSE '' END || p_name || '   ' || p_type, '(?i)^(canceled|cancelled):\s*', ''), '\s+', ' ', 'g'))) AS title FROM part""")
def titles(t):
    mark = F.when(F.col("p_partkey") % 3 == 0, "Canceled:  ").otherwise("")
    return t.part.select("p_partkey", x.title(F.concat(mark, "p_name", F.lit("   "), "p_type")).alias("title"))


@query("""WITH s AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS n FROM events)
          SELECT event_id, CASE WHEN n IS NULL OR n <= 0 THEN '0s' WHEN n >= 3600 THEN (n // 3600) || 'h' || CASE WHEN n % 3600 >= 60 THEN ' ' || (n % 3600 // 60) || 'm' ELSE '' END WHEN n >= 60 THEN (n // 60) || 'm' || CASE WHEN n % 60 > 0 THEN ' ' || (n % 60) || 's' ELSE '' END ELSE n || 's' END AS duration,
                 CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm' ELSE (n // 3600) || 'h' || CASE WHEN n % 3600 >= 60 THEN ' ' || (n % 3600 // 60) || 'm' ELSE '' END END AS usage FROM s""")
def durations(t):
    n = F.floor(F.col("value") * 100)
    return t.events.select("event_id", x.duration(n).alias("duration"), x.usage(n).alias("usage"))


@query("SELECT doc_id, substr(sha1(CAST(doc_id AS VARCHAR)), 1, 16) AS short, md5(text) AS content, substr(sha256(text), 1, 32) AS long_hash FROM documents")
def short_ids(t):
    return t.documents.select("doc_id", x.short_id(F.col("doc_id").cast("string")).alias("short"), F.md5("text").alias("content"), F.substring(F.sha2("text", 256), 1, 32).alias("long_hash"))


_NOISY = "' Pay $1,000 by 2024-05-06 or March 9th, March 9 (pm-0af3) 80k  -- '"


@query("SELECT item_id, " + reduce(lambda c, n: f"trim(regexp_replace({c}, '{n[0]}', '{n[1]}', 'g'))", x.TASK_NOISE, f"lower(text || {_NOISY})") + " AS norm FROM benchmark")
def task_texts(t):
    return t.benchmark.select("item_id", x.task_text(F.concat("text", F.lit(_NOISY.strip("'")))).alias("norm"))


_SET = """list_sort(list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ('the','a','an','to','for','of','and','or','in','on','with','is'))))"""


@query(f"SELECT item_id, array_to_string({_SET.format('text')}, ' ') AS tokens FROM benchmark")
def token_sets(t):
    return t.benchmark.select("item_id", F.array_join(x.token_set(F.col("text")), " ").alias("tokens"))


@query(f"""WITH s AS (SELECT p_partkey, p_brand, p_size, {_SET.format("p_type || ' ' || p_name")} AS w FROM part)
           SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS score FROM s a JOIN s b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def blocked_jaccard(t):
    """All pairs of a block. Rows of one token set are scored once, in numbers; a pair of rows looks its score up."""
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    part = t.part.select("p_partkey", "p_brand", "p_size", F.struct("p_type", "p_name").alias("of"))
    named = part.select("of").distinct().withColumn("w", x.token_set(F.concat_ws(" ", "of.p_type", "of.p_name")))
    sets = kept(named.select("w").distinct().withColumn("c", F.monotonically_increasing_id()), "sets")
    s = kept(part.join(named.join(sets, "w").select("of", "c"), "of").select("p_partkey", "p_brand", "p_size", "c").repartition(n, "p_brand", "p_size"), "rows")
    held = s.select("p_brand", "p_size", "c").distinct()
    met = held.join(held.withColumnRenamed("c", "d"), ["p_brand", "p_size"]).where("c <= d").select("c", "d").distinct()
    v = sets.select(F.col("c").alias("d"), F.col("w").alias("v"))
    scores = kept(met.join(sets.select("c", "w"), "c").join(v, "d").select("c", "d", F.round(x.jaccard(F.col("w"), F.col("v")), 6).alias("score")), "scores")
    o = s.select(F.col("p_partkey").alias("b"), "p_brand", "p_size", F.col("c").alias("d"))
    pairs = s.join(o, ["p_brand", "p_size"]).where("p_partkey < b").select(F.col("p_partkey").alias("a"), "b", F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d"))
    return pairs.join(scores, ["c", "d"]).select("a", "b", "score")


@query(f"""SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '{x.CUT_MARK[0]}' || (length(text) - 200) || '{x.CUT_MARK[1]}' ELSE text END AS snippet,
          CASE WHEN length(text) <= 6 THEN repeat('*', length(text)) ELSE substr(text, 1, 4) || repeat('*', length(text) - 6) || right(text, 2) END AS redacted FROM documents""")
def snippets(t):
    return t.documents.select("doc_id", x.snippet(F.col("text"), 200).alias("snippet"), x.redacted(F.col("text")).alias("redacted"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
  SELECT doc_id, CASE WHEN length(t) <= 110 THEN t ELSE regexp_replace(regexp_replace(substr(t, 1, 110), ' [^ ]*$', ''), '[,;:]+$', '') || ' ...' END AS cut FROM f""")
def word_cuts(t):
    return t.documents.select("doc_id", x.at_word(F.col("text"), 110).alias("cut"))


@query("SELECT doc_id, regexp_replace(replace(replace(coalesce(text, ''), ',', ' \u2014'), '. ', '\u2013 '), '\\s*[\u2014\u2013]\\s*', ' -- ', 'g') AS text FROM documents")
def dashes(t):
    marked = F.replace(F.replace(F.col("text"), F.lit(","), F.lit(" \u2014")), F.lit(". "), F.lit("\u2013 "))
    return t.documents.select("doc_id", x.plain_dashes(marked).alias("text"))


@query("""WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part), n AS (SELECT p_partkey, c, count(*) AS k, sum(count(*)) OVER (PARTITION BY p_partkey) AS n FROM c GROUP BY 1, 2)
          SELECT p_partkey, round(-sum(k / n * log2(k / n)), 9) AS bits FROM n GROUP BY 1""")
def entropies(t):
    return t.part.select("p_partkey", F.round(x.entropy(F.col("p_name")), 9).alias("bits"))


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 10 = 0 THEN 0.5 ELSE pow(0.5, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-01-01')) / 90.0) END, 9) AS recency,
          round(least(1.0, greatest(0.0, o_totalprice / 200000)), 9) AS importance FROM orders""")
def recency_and_importance(t):
    day = F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate"))
    return t.orders.select("o_orderkey", F.round(x.recency(day, F.lit("1997-01-01").cast("date")), 9).alias("recency"), F.round(x.unit(F.col("o_totalprice") / 200000), 9).alias("importance"))


_SIZE = "CASE WHEN {n} >= 1048576 THEN printf('%.1f MB', {n} / 1048576) WHEN {n} >= 1024 THEN printf('%.0f KB', {n} / 1024) ELSE printf('%d B', {n}) END"


@query(f"""SELECT doc_id, {_SIZE.format(n="(n_chars * 100)")} AS size,
           '[attachment: ' || concat_ws(', ', CASE WHEN doc_id % 3 = 0 THEN 'attachment' ELSE source END, nullif(lang, 'de'), CASE WHEN doc_id % 4 > 0 THEN {_SIZE.format(n="n_chars")} END) || ']' AS attachment FROM documents""")
def size_labels(t):
    k = F.col("doc_id")
    shown = x.attachment(F.when(k % 3 > 0, F.col("source")), F.when(F.col("lang") != "de", F.col("lang")), F.when(k % 4 > 0, F.col("n_chars")).otherwise(0))
    return t.documents.select("doc_id", x.size_label(F.col("n_chars") * 100).alias("size"), shown.alias("attachment"))


@query(r"""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'mail/2024-03/x.md' WHEN 1 THEN 'notes/2024-05-06-plan.md' WHEN 2 THEN 'misc/readme.md' ELSE 'mail/2024-03/2024-03-09.md' END AS path, CASE WHEN doc_id % 5 = 0 THEN '2023-12-31T10:00:00Z' WHEN doc_id % 7 = 0 THEN '2023-11-30' END AS stated FROM documents)
  SELECT doc_id, coalesce(CAST(substr(stated, 1, 10) AS DATE), TRY_CAST(nullif(regexp_extract(path, '(?:^|/)(\d{4}-\d{2}-\d{2})[^/]*$', 1), '') AS DATE), TRY_CAST(CASE WHEN regexp_extract(path, '/(\d{4}-\d{2})/[^/]*$', 1) <> '' THEN regexp_extract(path, '/(\d{4}-\d{2})/[^/]*$', 1) || '-01' END AS DATE)) AS day FROM p""")
def path_dates(t):
    k = F.col("doc_id") % 4
    path = F.when(k == 0, "mail/2024-03/x.md").when(k == 1, "notes/2024-05-06-plan.md").when(k == 2, "misc/readme.md").otherwise("mail/2024-03/2024-03-09.md")
    # of a note's dates the first that is stated: date, updated, modified, created
    stated = F.coalesce(F.when(F.col("doc_id") % 5 == 0, "2023-12-31T10:00:00Z"), F.lit(None).cast("string"), F.when(F.col("doc_id") % 7 == 0, "2023-11-30"))
    return t.documents.select("doc_id", x.path_date(path, stated).alias("day"))


@query(r"""SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents""")
def line_slices(t):
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(lines).cast("long").alias("lines"), F.array_join(F.slice(lines, 2, 3), "\n").alias("part"))


@query("SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS core, make_timestamp(epoch_us(ts)) AS webkit FROM events")
def time_encodings(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    core, webkit = F.floor(at / 1_000_000) - 978307200, at + 11644473600000000
    return t.events.select("event_id", F.timestamp_seconds(core + 978307200).cast("timestamp_ntz").alias("core"), F.timestamp_micros(webkit - F.lit(11644473600000000)).cast("timestamp_ntz").alias("webkit"))
