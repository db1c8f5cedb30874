"""Sources, sinks, chunks and streams as queries: what is written goes to the shared folder and is read back."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import chunks
from ..sources import blobs, connectors, files, trees
from ..streaming import events as e
from ._folder import new_folder
from .registry import query

# streams


def _stream(t, name):
    """A table as a stream."""
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/{name}.parque[t]")  # a pattern, so the table may be a file or a folder


def _ran(t, stream, mode="append"):
    path = new_folder(t.spark, "stream")
    e.run_all(stream, path, path + "-checkpoint", mode)
    return t.spark.read.schema(stream.schema).parquet(path)


def _events(t):
    return _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'hello' WHEN 1 THEN 'plain ' || event_type ELSE '{"type":"x"}' END AS content, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'webhook' ELSE 'x' END AS event_type, CASE event_id % 3 WHEN 0 THEN 'mail' ELSE 'hooks/' || user_id END AS source FROM events""")
def stream_received(t):
    """Posted bodies, JSON or plain; empty strings count as absent."""
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.concat(F.lit('{"message":"","content":"hello","event_type":"'), "event_type", F.lit('","source":"mail"}'))).when(k == 1, F.concat(F.lit("plain "), "event_type")).otherwise('{"type":"x"}')
    posted = _events(t).select("ts", F.concat(F.lit("/hooks/"), F.col("user_id").cast("string")).alias("path"), body.alias("body"), "event_id")
    return _ran(t, e.received(posted, "event_id")).select("event_id", "content", "event_type", "source")


@query("""SELECT CAST(user_id % 3 AS VARCHAR) AS job, CAST(count(*) FILTER (event_type = 'view' AND user_id % 3 = 1) AS BIGINT) AS dropped, CAST(count(*) FILTER (NOT (event_type = 'view' AND user_id % 3 = 1)) AS BIGINT) AS delivered FROM events GROUP BY 1""")
def stream_fates(t):
    """Known noise is dropped, anything else delivered; both are counted by job."""
    meta = F.create_map(F.lit("job"), (F.col("user_id") % 3).cast("string"), F.lit("event_type"), F.lit("job_complete"), F.lit("status"), F.lit("ok"))
    rows = _events(t).select(F.col("event_id").alias("seq"), "ts", F.concat("event_type", F.lit(" nothing new")).alias("content"), meta.alias("meta"))
    got = _ran(t, e.fates(rows, {"1": "^view nothing"}).select(F.col("meta")["job"].alias("job"), "fate"))
    return got.groupBy("job").agg(F.count_if(F.col("fate") == "dropped").alias("dropped"), F.count_if(F.col("fate") == "delivered").alias("delivered"))


@query("""WITH w AS (SELECT user_id % 2 AS user_id, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * o AS start FROM events, (SELECT unnest([0, 1]) AS o)), g AS (SELECT user_id, start, count(*) AS n FROM w GROUP BY 1, 2)
          SELECT user_id, start, n FROM g WHERE n >= 3 AND start + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_slices(t):
    """Windows of ten minutes every five with three rows or more, once the watermark has passed them."""
    return _ran(t, e.slices(_events(t).withColumn("user_id", F.col("user_id") % 2), "user_id")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOUR AS new FROM events), s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM l),
          g AS (SELECT user_id, k, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, start, last, n FROM g WHERE last + INTERVAL 2 HOUR < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_sessions(t):
    """Sessions that a gap of two hours ends, once the watermark has passed them."""
    got = _ran(t, e.sessions(_events(t), "user_id"))
    return got.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "last")], "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once(t):
    """The first row of each key; here all rows come within one batch."""
    rows = _events(t).withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return _ran(t, e.once(rows, "key", ttl="60 days").select("user_id", "event_type"))


@query("SELECT event_id FROM events WHERE event_id % 9 = 0 OR ts >= TIMESTAMP '2024-01-23 00:00:00'")
def pruned_queue(t):
    """A queue without entries older than a week; unparseable ones stay."""
    line = F.when(F.col("event_id") % 9 == 0, "not json").otherwise(F.to_json(F.struct(F.col("ts").cast("string").alias("ts"))))
    rows = t.events.select("event_id", line.alias("value"))
    return e.pruned(rows, dt.datetime(2024, 1, 30)).select("event_id")


_LINE = "octet_length(encode(event_type || '|' || CAST(event_id AS VARCHAR))) + 1"
_LOG = f"""b AS (SELECT event_id, user_id % 5 AS log, coalesce(sum({_LINE}) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events), f AS (SELECT event_id, log, CAST(before // 1000 AS BIGINT) AS file FROM b), q AS (SELECT *, row_number() OVER (PARTITION BY log, file ORDER BY event_id) - 1 AS seq FROM f)"""


def _log(t):
    rows = t.events.select("event_id", (F.col("user_id") % 5).alias("log"), F.concat_ws("|", "event_type", "event_id").alias("line"))
    return e.numbered(rows, ["event_id"], "line", 1000)


@query(f"WITH {_LOG} SELECT event_id, log, file, seq FROM q")
def rotated_log(t):
    """Sequence numbers of a log that rotates by size and then counts anew."""
    return _log(t).select("event_id", "log", "file", "seq")


@query(f"WITH {_LOG} SELECT event_id, file, seq FROM q WHERE log = 0 AND NOT (file = 0 AND seq <= 10)")
def tailed_log(t):
    """What a tail has not emitted yet; a rotated file is taken from its beginning."""
    last = t.spark.createDataFrame([(0, 10)], "file long, seq long")
    return e.unseen(_log(t).where("log = 0"), last).select("event_id", "file", "seq")


@query("""WITH l AS (SELECT user_id % 20 AS queue, arg_max(event_type, (ts, event_type)) AS holder, max(ts) AS "at" FROM events GROUP BY 1) SELECT queue, holder, floor(epoch(TIMESTAMP '2024-01-30 22:00:00')) - floor(epoch("at")) <= 7200 AS live FROM l""")
def queue_leases(t):
    """Who holds each queue, and whether the lease still lives."""
    beats = t.events.select((F.col("user_id") % 20).alias("queue"), F.col("event_type").alias("holder"), F.col("ts").alias("at"))
    return e.leases(beats, "2024-01-30 22:00:00", 7200)


# sources and sinks


@query("""SELECT date_trunc('day', ts) AS day, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1, 2""")
def day_sink(t):
    """Rows written by month and day; a day written again is replaced whole."""
    path = new_folder(t.spark, "days")
    rows = t.events.select("event_id", "ts")
    files.by_day(rows, path, "ts")
    files.by_day(rows.where(F.to_date("ts") == F.lit("2024-01-05").cast("date")), path, "ts")
    back = t.spark.read.schema("event_id long, ts timestamp_ntz, month string, day string").parquet(path)
    return back.groupBy(F.col("day").cast("date").cast("timestamp_ntz").alias("day"), "month").agg(F.count("*").alias("n"))


@query("""SELECT '@memory/' || source || '/2024-0' || (doc_id % 9 + 1) || '/' || doc_id || '.md' AS file_path, 'Note ' || doc_id AS title, source, length(trim(text, chr(10))) AS chars, DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS day FROM documents WHERE doc_id % 10 > 0 AND source NOT LIKE 'src1%'""")
def markdown_scan(t):
    """A tree of notes written whole file by whole file, and scanned: hidden files, globs and prefixes left out, a namespace in front."""
    k = F.col("doc_id").cast("string")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int"))
    name = F.concat(F.when(F.col("doc_id") % 10 == 0, F.when(F.col("doc_id") % 20 == 0, ".").otherwise("draft-")).otherwise(""), k, F.lit(".md"))
    path = F.concat(F.col("source"), F.lit("/2024-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("/"), name)
    text = F.concat(F.lit("---\ntitle: Note "), k, F.lit("\ndate: "), day.cast("string"), F.lit("\n---"), F.coalesce(F.concat(F.lit("\n"), F.trim(F.col("text"), F.lit("\n"))), F.lit("")))
    root = new_folder(t.spark, "notes")
    files.write_whole(t.documents.select(path.alias("file_path"), text.alias("text")), root)
    rows = files.documents(files.markdown(t.spark, root, skip=("src1",), globs=("*draft-*",), namespace="@memory/"))
    chars = F.when(~F.col("text").rlike(r"\A---\ntitle: [^\n]*\ndate: [^\n]*\n---\z"), F.length("body"))  # no line after the front matter, no text
    return rows.select("file_path", "title", F.split("file_path", "/")[1].alias("source"), chars.alias("chars"), F.to_date(F.col("frontmatter")["date"]).alias("day"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'o365-mail' WHEN 1 THEN 'calls' ELSE 'default' END AS source, CASE p_partkey % 3 WHEN 0 THEN 'o365' WHEN 1 THEN 'calls' ELSE 'misc' END AS connector, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE NULL END AS channel FROM part""")
def path_sources(t):
    """Source by the first two parts of a path, then the first; connector; channel where the source has one."""
    k = F.col("p_partkey") % 3
    path = F.when(k == 0, "o365/mail/x.md").when(k == 1, "calls/2024-01/x.md").otherwise("misc/x.md")
    return t.part.select("p_partkey", *[c.alias(n) for n, c in files.path_parts(path, {"o365/mail": "o365-mail", "calls": "calls"}, {"o365-teams": 2, "imessage": 1}).items()])


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 8 > 0""")
def tolerant_json(t):
    """JSON lines written as text and read back without the malformed ones."""
    path = new_folder(t.spark, "lines")
    line = F.when(F.col("event_id") % 8 == 0, '{"id": 1, "k"').otherwise(F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"k":'), F.get_json_object("props", "$.k"), F.lit("}")))
    t.events.select(line.alias("value")).write.text(path)
    return files.json_lines(t.spark, path, "id long, k long").select(F.col("id").alias("event_id"), "k")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN n_chars > 0 WHEN 2 THEN false ELSE false END AS binary FROM documents""")
def binary_sniff(t):
    k = F.col("doc_id") % 4
    plain = F.regexp_replace("text", r"[^\x20-\x7e\n]", "")
    content = F.when(k == 0, F.concat(plain.cast("binary"), F.lit(b"\0"))).when(k == 1, F.repeat(F.lit("ä"), F.least(F.col("n_chars"), F.lit(100)).cast("int")).cast("binary")).when(k == 2, plain.cast("binary")).otherwise(F.lit(b""))
    first = F.when(k == 0, F.concat(F.lit(b"\0"), content)).otherwise(content)
    return t.documents.select("doc_id", files.is_binary(first).alias("binary"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sqlite_scan(t):
    """Two tables of a SQLite file, read by row ranges and joined. The file is a small one made from two fixed tables."""
    path = new_folder(t.spark, "sqlite").removeprefix("file://") + ".db"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE nation (k INTEGER, name TEXT, r INTEGER)")
    db.execute("CREATE TABLE region (r INTEGER, name TEXT)")
    db.executemany("INSERT INTO nation VALUES (?, ?, ?)", [(n["n_nationkey"], n["n_name"], n["n_regionkey"]) for n in t.nation.collect()])  # 25 rows
    db.executemany("INSERT INTO region VALUES (?, ?)", [(n["r_regionkey"], n["r_name"]) for n in t.region.collect()])  # 5 rows
    db.commit()
    db.close()
    connectors.register(t.spark)
    read = lambda table, schema: t.spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", table).load()
    nations = read("nation", "k int, name string, r int").select(F.col("k").alias("n_nationkey"), F.col("name").alias("n_name"), "r")
    return nations.join(read("region", "r int, name string").withColumnRenamed("name", "r_name"), "r").select("n_nationkey", "n_name", "r_name")


@query("""SELECT 'r' || n_regionkey AS resource, CAST(n_nationkey AS VARCHAR) AS id, n_nationkey % 7 = 0 AS removed FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, NULL FROM region""")
def paged_scan(t):
    """Resources by pages; one comes with a token that is gone and so is read from its beginning."""
    root = new_folder(t.spark, "pages")
    fs, base = pafs.FileSystem.from_uri(root)
    nations = t.nation.collect()  # 25 rows
    for r in range(5):
        own = [n for n in nations if n["n_regionkey"] == r]
        pages = [own[i : i + 2] for i in range(0, len(own), 2)] or [[]]
        fs.create_dir(f"{base}/r{r}")
        for i, page in enumerate(pages):
            last = i == len(pages) - 1
            body = {"value": [{"id": n["n_nationkey"], "name": n["n_name"], "removed": n["n_nationkey"] % 7 == 0} for n in page]} | ({"delta": f"after-{r}"} if last else {"next": f"page-{i + 1}.json"})
            with fs.open_output_stream(f"{base}/r{r}/page-{i}.json") as f:
                f.write(json.dumps(body).encode())
    with fs.open_output_stream(f"{base}/r0/stale.json") as f:
        f.write(b'{"gone": true}')
    connectors.register(t.spark)
    rows = t.spark.read.format("paged_resource").option("root", root).option("resources", "r0,r1,r2,r3,r4").option("delta.r0", "stale.json").load()
    return rows.select("resource", "id", "removed")


@query("""SELECT doc_id, trim(regexp_replace(text, '[^ -~]', '', 'g')) AS text FROM documents""")
def office_texts(t):
    """Whole texts put into office bodies of five kinds and got back."""
    plain = F.trim(F.regexp_replace("text", "[^ -~]", ""))
    kinds = F.array(*[F.lit(k) for k in ("docx", "pptx", "xlsx", "rtf", "pdf", "txt")])
    rows = t.documents.select("doc_id", plain.alias("text"), F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("kind"))
    return rows.select("doc_id", blobs.office_text(blobs.packed(F.col("text"), F.col("kind")), F.col("kind")).alias("text"))


@query("""SELECT doc_id, 'Note ' || doc_id || ' about it' AS note, 'Hi ' || doc_id || ' there' AS message FROM documents""")
def blob_texts(t):
    """Compressed notes and attributed strings."""
    k = F.col("doc_id").cast("string")
    note, message = F.concat(F.lit("Note "), k, F.lit(" about it")), F.concat(F.lit("Hi "), k, F.lit(" there"))
    return t.documents.select("doc_id", blobs.note_text(blobs.packed(note, F.lit("note"))).alias("note"), blobs.attributed_text(blobs.packed(message, F.lit("attributed"))).alias("message"))


@query("""SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || 'see **' || p_brand || '** and [it](http://x.io)' || chr(10) || chr(10) || '- a' || chr(10) || '- ' || p_type AS markdown, '# ' || p_name || chr(10) || chr(10) || 'see **' || p_brand || '**' AS page FROM part""")
def rich_trees(t):
    """Document trees and storage pages as Markdown."""
    text = lambda c, **more: F.struct(F.lit("text").alias("type"), c.alias("text"), *[v.alias(k) for k, v in more.items()])
    node = lambda kind, *content: F.to_json(F.struct(F.lit(kind).alias("type"), F.array(*content).alias("content")))
    raw = lambda kind, *parts: F.concat(F.lit('{"type":"' + kind + '","content":['), F.concat_ws(",", *parts), F.lit("]}"))
    bold, link = F.array(F.struct(F.lit("strong").alias("type"))), F.array(F.struct(F.lit("link").alias("type"), F.struct(F.lit("http://x.io").alias("href")).alias("attrs")))
    line = raw("paragraph", F.to_json(text(F.lit("see "))), F.to_json(text(F.col("p_brand"), marks=bold)), F.to_json(text(F.lit(" and "))), F.to_json(text(F.lit("it"), marks=link)))
    item = lambda c: raw("listItem", node("paragraph", text(c)))
    tree = raw("doc", node("heading", text(F.col("p_name"))), line, raw("bulletList", item(F.lit("a")), item(F.col("p_type"))))
    page = F.concat(F.lit("<h1>"), "p_name", F.lit("</h1><p>see <strong>"), "p_brand", F.lit("</strong></p><style>x</style>"))
    return t.part.select("p_partkey", trees.markdown_of_tree(tree).alias("markdown"), trees.markdown_of_storage(page).alias("page"))


@query("""SELECT p_partkey, 0 AS depth, 'heading1' AS type, NULL AS speaker, p_name AS content FROM part UNION ALL SELECT p_partkey, 1, 'blockquote', 'You', p_brand FROM part UNION ALL SELECT p_partkey, 1, 'blockquote', 'Ann', p_type FROM part""")
def lifelog_rows(t):
    """Typed nodes of a tree, depth first."""
    q = lambda who, c: F.concat(F.lit('{"type":"blockquote",' + who + ',"content":"'), c, F.lit('"}'))
    tree = F.concat(F.lit('[{"type":"heading1","content":"'), "p_name", F.lit('","children":['), q('"speakerIdentifier":"user","speakerName":"Me"', F.col("p_brand")), F.lit(","), q('"speakerName":"Ann"', F.col("p_type")), F.lit("]}]"))
    return t.part.select("p_partkey", F.explode(trees.flattened(tree)).alias("x")).select("p_partkey", "x.depth", "x.type", "x.speaker", "x.content")


# chunks


@query(None)
def line_chunks(t):
    """Texts packed by lines with overlap; the carried overlap has no SQL."""
    return chunks.chunked(t.documents, "doc_id", "text")


@query(None)
def dispatched_chunks(t):
    """Each source by its own strategy and size."""
    rows = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "sessions").when(F.col("doc_id") % 3 == 1, "fireflies").otherwise("calls").alias("source"))
    return chunks.dispatched(rows, "doc_id", "text", "source")


@query("""WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), s AS (SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS line FROM w) SELECT doc_id, CAST(n + 1 AS INTEGER) AS part, '## Turn ' || (n + 1) || chr(10) || line AS chunk FROM s WHERE true""")
def turn_pieces(t):
    """Texts cut where a turn begins; each turn is a piece."""
    lines = t.documents.select("doc_id", F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("## Turn "), (i + 1).cast("string"), F.lit("\n"), x)).alias("l"))
    whole = lines.select("doc_id", F.array_join("l", "\n").alias("text"))
    parts = F.split("text", r"\n(?=## Turn \d+)")
    return whole.select("doc_id", F.posexplode(parts).alias("n", "chunk")).select("doc_id", (F.col("n") + 1).alias("part"), "chunk")


@query(None)
def message_parts(t):
    """Texts in parts to deliver."""
    return chunks.delivered(t.documents, "doc_id", "text", 500)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) || text ELSE text END AS embed_text FROM documents""")
def context_texts(t):
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ").alias("context"), "text")
    return chunks.with_context(rows, "context", "text").select("doc_id", "embed_text")


_PHRASES = ("plans last week", "what did we do 3 days ago", "notes from May", "in the last 7 days", "the June report", "yesterday, the price", "budget since June 15", "talks on Monday")


@query(None)
def time_ranges(t):
    """Search phrases with a time as ranges, on a fixed clock; expected values are in the tests."""
    asked = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("event_id") % len(_PHRASES) + 1).cast("int"))
    r = temporal.time_range(asked, dt.datetime(2026, 7, 2, 22, tzinfo=dt.timezone(dt.timedelta(hours=-4))))
    return t.events.select("event_id", r.alias("r")).select("event_id", "r.rest", "r.date_from", "r.date_to")
