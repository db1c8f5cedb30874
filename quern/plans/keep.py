"""Keeping archives: schedules, queues, snapshots, calendars' rows, attachments, audits and document checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import keep, rules
from .registry import query


@query("""WITH s AS (SELECT event_id AS job, event_id % 3 = 0 AS daily, event_id % 13 = 0 AS forced, hour(ts) + minute(ts) / 60.0 AS h, isodow(ts) - 1 AS wd, event_id % 24 AS at_hour, event_id % 5 = 0 AS ran, CASE WHEN event_id % 7 > 0 THEN 15 END AS work, CASE WHEN event_id % 4 > 0 THEN 60 END AS off, CASE WHEN event_id % 11 > 0 THEN CAST(floor(value) AS BIGINT) END AS minutes FROM events),
  i AS (SELECT *, CASE WHEN wd < 5 AND h >= 6 AND h < 20.5 THEN work ELSE off END AS every FROM s)
  SELECT job, CASE WHEN forced THEN 'forced' WHEN daily THEN CASE WHEN ran THEN 'ran today' WHEN h >= at_hour THEN 'due' ELSE 'not yet' END WHEN every IS NULL THEN 'not scheduled' WHEN minutes IS NULL THEN 'never synced' WHEN minutes >= every THEN 'due' ELSE 'wait' END AS state FROM i""")
def schedule_due(t):
    k = F.col("event_id")
    hour = F.hour("ts") + F.minute("ts") / 60.0
    state = keep.due(
        F.when(k % 3 == 0, "daily").otherwise("interval"), k % 13 == 0, hour, F.weekday("ts"), k % 24, k % 5 == 0, F.when(k % 7 > 0, 15), F.when(k % 4 > 0, 60), F.when(k % 11 > 0, F.floor("value"))
    )
    return t.events.select(k.alias("job"), state.alias("state"))


@query("""SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'error') THEN 'not retried' WHEN event_id % 5 = 0 THEN 'permanent' WHEN event_id % 4 >= 3 THEN 'exhausted' ELSE 'retry' END AS verdict FROM events""")
def retry_verdicts(t):
    error = F.when(F.col("event_id") % 5 == 0, "HTTP 403 Forbidden").otherwise("timeout")
    return t.events.select("event_id", keep.retry(F.col("event_type"), error, F.col("event_id") % 4, ["view", "click", "error"], 3).alias("verdict"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 20 >= 7 ELSE true END AS probe FROM customer""")
def denied_resources(t):
    """Resources that were denied are asked again after a week."""
    now = F.lit("2024-01-30").cast("date")
    denied = t.customer.where("c_custkey % 3 = 0").select("c_custkey", F.date_sub(now, (F.col("c_custkey") % 20).cast("int")).alias("denied_at"))
    return keep.probed(t.customer.select("c_custkey"), denied, "c_custkey", now, 7).select("c_custkey", "probe")


@query("SELECT source, count(*) AS chunks, source IN ('src1', 'src2') AS rebuild FROM documents GROUP BY 1")
def model_guard(t):
    """Sources whose index was made by another model, or at another size, are made anew."""
    states = {"src1": {"model": "old", "size": 2048}, "src2": {"model": "new", "size": 1024}, "src3": {"model": "new", "size": 2048}}
    changed = [s for s, state in states.items() if keep.model_changed(state, "new", 2048)]
    return t.documents.groupBy("source").agg(F.count("*").alias("chunks")).withColumn("rebuild", F.col("source").isin(*changed))


@query("""WITH s AS (SELECT doc_id AS key, source, doc_id % 3 = 0 AS context FROM documents), o AS (SELECT key, source FROM s WHERE NOT context AND key % 7 > 0 AND key % 5 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key) AS turn FROM o) SELECT key, source, CAST(turn AS INTEGER) AS turn FROM r ORDER BY turn, source LIMIT 50""")
def backfill_queue(t):
    """What still lacks its context, exists and is not queued, a source at a time."""
    k = F.col("key")
    state = t.documents.select(F.col("doc_id").alias("key"), "source", (F.col("doc_id") % 3 == 0).alias("context"))
    return keep.backfill_queue(state, state.where(k % 7 > 0), state.where(k % 5 == 0), 50)


@query("""WITH c AS (SELECT count(*) AS before FROM documents), r AS (SELECT count(*) AS after FROM documents WHERE source NOT LIKE 'src1%' AND doc_id NOT IN (SELECT item_id FROM benchmark)) SELECT before, after, before - after AS pruned FROM c, r""")
def prune_counts(t):
    """Rows before and after a prune by prefix or list, in one pass."""
    listed = t.benchmark.select(F.col("item_id").alias("doc_id")).distinct().withColumn("listed", F.lit(True))
    gone = F.col("source").startswith("src1") | F.coalesce("listed", F.lit(False))
    rows = t.documents.select("doc_id", "source").join(listed, "doc_id", "left")
    return rows.agg(F.count("*").alias("before"), F.count_if(~gone).alias("after"), F.count_if(gone).alias("pruned"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE 'forced' END AS change FROM documents WHERE doc_id % 10 <> 9""")
def forced_diff(t):
    """A forced run takes what has not changed as well."""
    from ..operators import change

    d = t.documents
    old, new = (d.where(w).select("doc_id", F.md5("text").alias("h")) for w in ("doc_id % 10 > 0", "doc_id % 10 <> 9"))
    found = change.diff(old, new, "doc_id", "h").where("change <> 'deleted'")
    return found.withColumn("change", F.when(F.col("change") == "same", "forced").otherwise(F.col("change")))


@query(None)
def byte_budgets(t):
    """The newest documents of each source that fit: the fold has no SQL."""
    files = t.documents.select("source", F.col("doc_id").alias("modified"), F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("bytes"))
    return keep.greedy_within(files, "source", 20, 3000, 10_000)


_FILES = """f AS (SELECT doc_id, doc_id % 3 > 0 AS dated, doc_id % 17 = 0 AS excluded, doc_id % 120 AS age, source = 'src2' AS dated_only, doc_id % 13 = 0 AS exempt, doc_id % 5 > 0 AS mirrored, doc_id % 7 > 0 AS same, doc_id % 11 = 0 AS taken FROM documents)"""


@query(f"""WITH {_FILES} SELECT doc_id, CASE WHEN exempt THEN 'exempt' WHEN NOT mirrored THEN 'one-sided' WHEN NOT same THEN 'sides differ' WHEN taken THEN 'collision' ELSE 'move' END AS plan FROM f WHERE NOT excluded AND (NOT dated_only OR dated) AND age > 30""")
def archive_plan(t):
    k = F.col("doc_id")
    plan = keep.archive_skip(F.col("source") == "src2", k % 3 > 0, k % 17 == 0, k % 120, F.lit(30), k % 13 == 0, k % 5 > 0, k % 7 > 0, k % 11 == 0)
    return t.documents.select("doc_id", plan.alias("plan")).where("plan is not null")


_NOTES = """m AS (SELECT o_orderkey AS id, o_orderkey % 23 > 0 AS parses, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 400 END AS until, o_orderkey % 7 = 0 AS volatile, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS audited, o_orderkey % 19 = 0 AS superseded, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 1 - o_orderkey % 2 * 100000000 END AS link FROM orders),
  i AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 > 0)"""


@query(f"""WITH {_NOTES} SELECT id, 'PARSE' AS state FROM m WHERE NOT parses UNION ALL SELECT id, 'EXPIRED' FROM m WHERE until < DATE '1997-06-01' UNION ALL SELECT id, 'AGING' FROM m WHERE volatile AND date_diff('day', audited, DATE '1997-06-01') > 90
  UNION ALL SELECT id, 'UNAUDITED' FROM m WHERE audited IS NULL UNION ALL SELECT id, 'SUPERSEDED' FROM m WHERE superseded UNION ALL SELECT id, 'DANGLING' FROM m WHERE link IS NOT NULL AND link NOT IN (SELECT id FROM m)
  UNION ALL SELECT id, 'INDEX' FROM m WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT id, 'INDEX' FROM i WHERE id NOT IN (SELECT id FROM m)""")
def memory_audit(t):
    """Each state of each note, and the index against the notes both ways."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = t.orders.select(
        k.alias("id"), (k % 23 > 0).alias("parses"), F.when(k % 3 == 0, F.date_add(day, 400)).alias("until"), (k % 7 == 0).alias("volatile"), F.when(k % 4 > 0, day).alias("audited"), (k % 19 == 0).alias("superseded"),
        F.when(k % 11 == 0, F.array(k + 1 - k % 2 * 100000000)).otherwise(F.array().cast("array<bigint>")).alias("links"),
    )
    return keep.memory_states(rows, t.orders.where("o_orderkey % 5 > 0").select(k.alias("id")), F.lit("1997-06-01").cast("date"))


@query("""WITH m AS (SELECT user_id, max(ts) AS "at" FROM events WHERE event_type = 'purchase' GROUP BY 1), h AS (SELECT *, (epoch(TIMESTAMP '2024-02-01') - floor(epoch("at"))) / 3600 AS hours, CASE WHEN user_id % 3 = 0 THEN DATE '2024-01-25' WHEN user_id % 3 = 1 THEN DATE '2024-01-10' END AS dismissed FROM m)
  SELECT user_id, CASE WHEN hours <= 2 * 24 THEN 'OK' WHEN dismissed IS NULL THEN 'STALE' WHEN date_diff('day', dismissed, DATE '2024-02-01') > 14 THEN 'ALERT' ELSE 'triaged' END AS state FROM h""")
def connector_freshness(t):
    k = F.col("user_id")
    latest = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("at"))
    dismissed = F.when(k % 3 == 0, "2024-01-25").when(k % 3 == 1, "2024-01-10").cast("date")
    return keep.freshness(latest, F.lit("2024-02-01").cast("timestamp_ntz"), F.lit(24), dismissed).select("user_id", "state")


_CHECKS = [
    ("file_exists", "", {}), ("file_fresh", "", {"max_age_hours": 30}), ("min_lines", "", {"min": 6}), ("max_lines", "", {"max": 40}), ("frontmatter_parses", "note", {}),
    ("frontmatter_fields", "note", {"required": ["date", "count"], "value_patterns": {"count": r"\d+"}}), ("date_matches_filename", "note", {}), ("section_present", "note", {"pattern": "^## Items"}),
    ("sections_in_order", "note", {"patterns": ["^# Note", "^## Items"]}), ("regex_present", "", {"pattern": r"^\d+\. ", "min_count": 2}), ("regex_all", "", {"patterns": ["Note", "Items"]}), ("regex_absent", "", {"pattern": "TODO"}),
    ("no_em_dashes", "", {}), ("no_truncation_markers", "", {}), ("counts_equal", "note", {"pattern_a": r"^\d+\. ", "pattern_b": r"^- \[.\]"}), ("frontmatter_count_matches", "note", {"field": "count", "pattern": r"^\d+\. "}),
    ("numbered_list_max", "note", {"section": "## Items", "max": 3}), ("checkbox_states_valid", "", {}), ("json_parses", "json", {"required_keys": ["k"]}), ("jsonl_parses", "json", {}),
    ("jsonl_schema_fields", "json", {"required": ["k"], "enums": {"v": ["1", "2"]}}), ("report_parses", "report", {}), ("report_field_valid", "report", {"field": "STATUS", "allowed": ["ok", "partial"]}), ("report_artifact_exists", "report", {}),
    ("zero_requires_no_artifact", "report", {"field": "FOUND"}),
]


@query(None)
def document_checks(t):
    """All 25 checks over literal documents of three kinds, varied by the number of a document; expected verdicts are in the tests."""
    n = F.col("doc_id") % 6
    num = n.cast("string")
    items = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.concat(i.cast("string"), F.lit(". item\n- [x] done"))))
    note = F.concat(F.lit("---\ndate: 2024-01-0"), num, F.lit("\ncount: "), num, F.lit("\n---\n# Note\n## Items\n"), items, F.when(n == 4, "\nTODO — later [truncated]\n- [?] odd").otherwise(""))
    lines = F.concat(F.lit('{"k": 1, "v": "'), num, F.lit('"}'), F.when(n == 5, "\nnot json").otherwise(""))
    report = F.concat(F.lit("SKILL_COMPLETE: brief\nSTATUS: "), F.when(n == 3, "lost").otherwise("ok"), F.lit("\nFOUND: "), n.cast("string"), F.lit("\nARTIFACT: "), F.when(n == 0, "none").when(n == 1, "a.md").otherwise("b.md"))
    kind = F.when(F.col("doc_id") % 3 == 0, "note").when(F.col("doc_id") % 3 == 1, "json").otherwise("report")
    files = t.documents.select(
        F.concat(F.lit("2024-01-01-"), F.col("doc_id").cast("string")).alias("name"), F.when(kind == "note", note).when(kind == "json", lines).otherwise(report).alias("content"), (F.col("doc_id") % 48).alias("age_hours"),
        F.array(F.lit("a.md")).alias("artifacts"), kind.alias("kind"),
    )
    return keep.checked(files, _CHECKS, "kind")


@query("""WITH p AS (SELECT p_partkey, 'Pay the ' || CASE WHEN p_size > 25 THEN 'deploy server' WHEN p_size > 15 THEN 'ask the board' WHEN p_size > 8 THEN 'review the budget' ELSE 'send ' || p_type END AS d FROM part)
          SELECT p_partkey, CASE WHEN contains(d, 'board') THEN 'principal-only' WHEN contains(d, 'server') THEN 'infra' WHEN regexp_matches(lower(d), '\\b(?:draft|agenda)\\b') THEN 'pre' WHEN regexp_matches(lower(d), '\\b(?:review|send|check)\\b') AND regexp_matches(lower(d), '\\b(?:budget|steel|copper)\\b') THEN 'team' WHEN contains(lower(d), 'tin') THEN 'post' ELSE 'default' END AS class FROM p""")
def work_classes(t):
    """Work by the first rule that holds; the team's needs a verb and its domain."""
    size = F.col("p_size")
    d = F.concat(F.lit("Pay the "), F.when(size > 25, "deploy server").when(size > 15, "ask the board").when(size > 8, "review the budget").otherwise(F.concat(F.lit("send "), "p_type")))
    low = F.lower(d)
    team = low.rlike(r"\b(?:review|send|check)\b") & low.rlike(r"\b(?:budget|steel|copper)\b")
    found = rules.first_rule([("principal-only", d.contains("board")), ("infra", d.contains("server")), ("pre", low.rlike(r"\b(?:draft|agenda)\b")), ("team", team), ("post", low.contains("tin"))], "default")
    return t.part.select("p_partkey", found.alias("class"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'credential' WHEN 2 THEN 'machine_specific' WHEN 3 THEN 'binary_unverified' WHEN 4 THEN 'person_name' ELSE 'user_path' END AS class,
   CASE doc_id % 6 WHEN 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'noreply@corp.io' ELSE 'ann@corp.io' END WHEN 1 THEN CASE WHEN doc_id % 4 = 1 THEN 'key = os.environ' ELSE 'key=Ab3dE6gH9jK2' END WHEN 3 THEN CASE WHEN doc_id % 4 = 3 THEN 'x.png' ELSE 'x.db' END ELSE 'Ann' END AS found, doc_id % 12 = 4 AS licence, CASE WHEN doc_id % 3 = 0 THEN 'low' ELSE 'high' END AS severity FROM documents),
  n AS (SELECT *, CASE class WHEN 'email' THEN found LIKE 'noreply%' WHEN 'credential' THEN contains(found, 'os.') WHEN 'binary_unverified' THEN found LIKE '%.png' WHEN 'person_name' THEN licence ELSE false END AS noise FROM f)
  SELECT doc_id, noise, NOT noise AND (severity = 'high' OR class = 'machine_specific') AS gates FROM n""")
def gate_noise(t):
    """The sanctioned noise of a scan, and what gates: high severity, and some classes always."""
    k = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(c) for c in ("email", "credential", "machine_specific", "binary_unverified", "person_name", "user_path")]), (k % 6 + 1).cast("int"))
    found = F.when(k % 6 == 0, F.when(k % 4 == 0, "noreply@corp.io").otherwise("ann@corp.io")).when(k % 6 == 1, F.when(k % 4 == 1, "key = os.environ").otherwise("key=Ab3dE6gH9jK2")).when(k % 6 == 3, F.when(k % 4 == 3, "x.png").otherwise("x.db")).otherwise("Ann")
    heuristic = F.lit("Secret-like key=value assignment")
    rows = t.documents.select("doc_id", kind.alias("class"), heuristic.alias("rule"), found.alias("found"), F.when(k % 12 == 4, "LICENSE").otherwise("a.md").alias("file"), F.lit("Copyright Ann").alias("context"), F.when(k % 3 == 0, "low").otherwise("high").alias("severity"))
    return rows.select("doc_id", rules.noise().alias("noise"), rules.gates().alias("gates"))


# small ones


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN make_timestamp(epoch_us(ts) // 1000 * 1000) ELSE ts END AS "at" FROM events""")
def implausible_dates(t):
    """A date over a year ahead gives way to the field in epoch milliseconds."""
    claimed = F.when(F.col("event_id") % 5 == 0, F.expr("TIMESTAMP_NTZ '2031-01-01 00:00:00'")).otherwise(F.col("ts"))
    millis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    limit = F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00' + interval 365 days")
    return t.events.select("event_id", F.when(claimed > limit, F.timestamp_millis(millis).cast("timestamp_ntz")).otherwise(claimed).alias("at"))


@query("SELECT event_id FROM events WHERE event_type <> 'signup' AND NOT (event_type = 'error' AND value > 50) AND event_id % 17 <> 0")
def dropped_masters(t):
    """Rows of a calendar without series masters, cancelled and removed ones."""
    return t.events.where((F.col("event_type") != "signup") & ~((F.col("event_type") == "error") & (F.col("value") > 50)) & (F.col("event_id") % 17 != 0)).select("event_id")


@query("SELECT user_id, max(ts) AS edge, max(ts) IS NULL OR max(ts) < TIMESTAMP '2024-01-16' + INTERVAL 14 DAY AS reanchor FROM events GROUP BY 1")
def window_reanchor(t):
    """A delta window is opened anew where its edge is unknown or within two weeks."""
    edge = t.events.groupBy("user_id").agg(F.max("ts").alias("edge"))
    return edge.withColumn("reanchor", F.col("edge").isNull() | (F.col("edge") < F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00' + interval 14 days")))


@query("""SELECT conv_id, coalesce(CASE WHEN conv_id % 4 = 0 THEN 'Team ' || conv_id END, CASE WHEN conv_id % 4 = 1 THEN 'group-' || conv_id END, arg_min(role, turn) FILTER (role <> 'assistant' AND conv_id % 4 = 2), CASE WHEN conv_id % 8 = 3 THEN string_agg(DISTINCT role, ', ' ORDER BY role) END, 'chat-' || conv_id) AS name FROM conversations GROUP BY 1""")
def conversation_names(t):
    """The name shown, else the group's, the first other sender, the members, the id."""
    k = F.col("conv_id")
    rows = t.conversations.groupBy("conv_id").agg(F.min_by("role", F.when(F.col("role") != "assistant", F.col("turn"))).alias("sender"), F.array_join(F.sort_array(F.collect_set("role")), ", ").alias("members"))  # three roles
    text = k.cast("string")
    name = F.coalesce(F.when(k % 4 == 0, F.concat(F.lit("Team "), text)), F.when(k % 4 == 1, F.concat(F.lit("group-"), text)), F.when(k % 4 == 2, F.col("sender")), F.when(k % 8 == 3, F.col("members")), F.concat(F.lit("chat-"), text))
    return rows.select("conv_id", name.alias("name"))


@query("""SELECT event_id, '{"speaker":"u' || user_id || '","start":' || CAST(epoch(date_trunc('second', ts)) AS BIGINT) || ',"kind":"' || event_type || '"}' AS sidecar FROM events""")
def diarisation_sidecar(t):
    row = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("speaker"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"), F.col("event_type").alias("kind"))
    return t.events.select("event_id", F.to_json(row).alias("sidecar"))


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(CASE WHEN event_type = 'error' THEN NULL ELSE value END, event_id) AS v FROM events GROUP BY 1, 2) SELECT user_id, day, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day) AS gauge FROM (SELECT user_id, day, (SELECT e.value FROM events e WHERE e.user_id = g.user_id AND CAST(e.ts AS DATE) = g.day AND e.event_type <> 'error' ORDER BY e.event_id DESC LIMIT 1) AS v FROM g)""")
def gauge_carry(t):
    """The gauge of a scope by day; a day of errors alone carries the last good one on."""
    day = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("value", F.when(F.col("event_type") != "error", F.col("event_id"))).alias("v"))
    return day.select("user_id", "day", F.last("v", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("day")).alias("gauge"))


@query("SELECT page_id, replace(replace(url, 'https://', '/sandbox/'), 'http://', '/sandbox/') AS path FROM pages")
def path_rewrite(t):
    return t.pages.select("page_id", F.replace(F.replace("url", F.lit("https://"), F.lit("/sandbox/")), F.lit("http://"), F.lit("/sandbox/")).alias("path"))


@query("""WITH d AS (SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS sender, max(event_id) AS last FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1) SELECT user_id, n, sender FROM d ORDER BY last DESC LIMIT 10""")
def day_snapshot(t):
    """Messages of a day a chat, with the last sender; the ten latest."""
    d = t.events.where(F.to_date("ts") == F.lit("2024-01-15").cast("date")).groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", "event_id").alias("sender"), F.max("event_id").alias("last"))
    return d.orderBy(F.desc("last")).limit(10).select("user_id", "n", "sender")


@query("""WITH r AS (SELECT doc_id % 40 AS rec, CASE doc_id % 4 WHEN 0 THEN 'transcript' WHEN 1 THEN 'summary' WHEN 2 THEN 'outline' ELSE 'other' END AS kind, doc_id % 3 = 0 AS inline, lang AS speaker, doc_id FROM documents)
  SELECT rec, coalesce(max(doc_id) FILTER (kind = 'transcript' AND inline), max(doc_id) FILTER (kind = 'transcript')) AS transcript, coalesce(max(doc_id) FILTER (kind = 'summary' AND inline), max(doc_id) FILTER (kind = 'summary')) AS summary, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM r GROUP BY 1""")
def recording_assembly(t):
    """A recording's parts by type; what is inline goes before what must be fetched."""
    k = F.col("doc_id")
    r = t.documents.select((k % 40).alias("rec"), F.when(k % 4 == 0, "transcript").when(k % 4 == 1, "summary").when(k % 4 == 2, "outline").otherwise("other").alias("kind"), (k % 3 == 0).alias("inline"), F.col("lang").alias("speaker"), "doc_id")
    of = lambda kind: F.coalesce(F.max(F.when((F.col("kind") == kind) & F.col("inline"), F.col("doc_id"))), F.max(F.when(F.col("kind") == kind, F.col("doc_id")))).alias(kind)
    return r.groupBy("rec").agg(of("transcript"), of("summary"), F.array_join(F.sort_array(F.collect_set("speaker")), ",").alias("speakers"))  # four languages


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'verify/create ' WHEN 1 THEN 'MK: get ' ELSE '+ the ' END || p_type AS d, p_type FROM part) SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'verifying/creating ' WHEN 1 THEN 'getting ' ELSE 'the ' END || p_type AS topic FROM p""")
def nudge_topics(t):
    """What to ask about: names and signs in front go, a leading verb becomes a gerund."""
    d = F.concat(F.when(F.col("p_partkey") % 3 == 0, "verify/create ").when(F.col("p_partkey") % 3 == 1, "MK: get ").otherwise("+ the "), "p_type")
    return t.part.select("p_partkey", x.topic(d).alias("topic"))


@query(r"""SELECT c_custkey, regexp_replace('a+b (' || c_name || ')?', '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped, substr(trim(regexp_replace('x/y: ' || c_name || '?', '[\\/:*?"<>|\x00-\x1f]+', '_', 'g')), 1, 80) AS file_name FROM customer""")
def escaped_names(t):
    return t.customer.select("c_custkey", x.lucene(F.concat(F.lit("a+b ("), "c_name", F.lit(")?"))).alias("escaped"), x.file_name(F.concat(F.lit("x/y: "), "c_name", F.lit("?"))).alias("file_name"))


@query("""SELECT doc_id, date_diff('day', greatest(coalesce(CASE WHEN doc_id % 3 > 0 THEN DATE '2024-01-01' + CAST(doc_id % 20 AS INTEGER) END, DATE '1970-01-01'), coalesce(CASE WHEN doc_id % 2 = 0 THEN DATE '2024-01-05' END, DATE '1970-01-01'), DATE '2024-01-03'), DATE '2024-01-30') AS age FROM documents""")
def file_ages(t):
    """Days since the latest of a file's dates; missing ones do not count."""
    k = F.col("doc_id")
    named = F.when(k % 3 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 20).cast("int")))
    return t.documents.select("doc_id", F.datediff(F.lit("2024-01-30").cast("date"), F.greatest(named, F.when(k % 2 == 0, F.lit("2024-01-05").cast("date")), F.lit("2024-01-03").cast("date"))).cast("long").alias("age"))


@query("""SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS open_n, CAST(count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 > 0) AS BIGINT) AS merged_n, CAST(count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS BIGINT) AS declined_n,
          CAST(count(*) FILTER (o_orderstatus = 'O' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-07-29') > 7) AS BIGINT) AS aging, CAST(count(*) FILTER (o_orderstatus = 'O' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-07-29') > 30) AS BIGINT) AS critical FROM orders GROUP BY 1""")
def review_report(t):
    """Reviews by author: open, merged, declined, over a week, over a month."""
    status, age = F.col("o_orderstatus"), F.datediff(F.lit("1998-07-29").cast("date"), F.to_date("o_orderdate"))
    live, declined = status == "O", F.col("o_orderkey") % 3 == 0
    return t.orders.groupBy("o_custkey").agg(F.count_if(live).alias("open_n"), F.count_if((status == "F") & ~declined).alias("merged_n"), F.count_if((status == "F") & declined).alias("declined_n"), F.count_if(live & (age > 7)).alias("aging"), F.count_if(live & (age > 30)).alias("critical"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, sum(value) AS total FROM events WHERE value > 0 GROUP BY 1, 2, 3) SELECT user_id, day, event_type, round(total, 4) AS seconds, round(sum(total) OVER (PARTITION BY user_id, day), 4) AS day_total FROM d QUALIFY total >= 5""")
def usage_display(t):
    """Uses of under five seconds count for the day but are not shown."""
    d = t.events.where("value > 0").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.sum("value").alias("total"))
    rows = d.withColumn("day_total", F.round(F.sum("total").over(Window.partitionBy("user_id", "day")), 4))
    return rows.where("total >= 5").select("user_id", "day", "event_type", F.round("total", 4).alias("seconds"), "day_total")


@query("""WITH r AS (SELECT source AS suite, CASE WHEN n_chars < 500 THEN 'SKIP' WHEN doc_id % 4 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM documents) SELECT suite, CAST(count(*) FILTER (verdict = 'PASS') AS BIGINT) AS passed, CAST(count(*) FILTER (verdict = 'FAIL') AS BIGINT) AS failed, CAST(count(*) FILTER (verdict = 'SKIP') AS BIGINT) AS skipped,
          round(count(*) FILTER (verdict = 'PASS') / nullif(count(*) FILTER (verdict <> 'SKIP'), 0), 6) AS fraction FROM r GROUP BY 1""")
def suite_results(t):
    """Verdicts by suite; what was skipped is no part of the fraction."""
    v = F.when(F.col("n_chars") < 500, "SKIP").when(F.col("doc_id") % 4 == 0, "FAIL").otherwise("PASS")
    n = lambda name: F.count_if(F.col("verdict") == name)
    r = t.documents.select(F.col("source").alias("suite"), v.alias("verdict")).groupBy("suite")
    return r.agg(n("PASS").alias("passed"), n("FAIL").alias("failed"), n("SKIP").alias("skipped"), F.round(n("PASS") / F.nullif(n("PASS") + n("FAIL"), F.lit(0)), 6).alias("fraction"))


@query("""WITH r AS (SELECT user_id AS topic, event_id AS n, value / 300 AS novelty, row_number() OVER (PARTITION BY user_id ORDER BY event_id) / 60.0 AS coverage, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS spent, lag(value / 300) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
  s AS (SELECT *, CASE WHEN novelty < 0.15 AND before < 0.15 THEN 'saturated' WHEN coverage >= 0.80 THEN 'covered' WHEN spent > 2000 THEN 'budget' END AS why FROM r WHERE (novelty < 0.15 AND before < 0.15) OR coverage >= 0.80 OR spent > 2000) SELECT topic, min(n) AS stops_at, arg_min(why, n) AS why FROM s GROUP BY 1""")
def research_stops(t):
    """Where a search ends, and why: two rounds without news, coverage, or its budget."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    novelty = F.col("value") / 300
    r = t.events.select("user_id", "event_id", novelty.alias("novelty"), F.lag(novelty).over(w).alias("before"), (F.row_number().over(w) / 60.0).alias("coverage"), F.sum("value").over(w).alias("spent"))
    why = F.when((F.col("novelty") < 0.15) & (F.col("before") < 0.15), "saturated").when(F.col("coverage") >= 0.80, "covered").when(F.col("spent") > 2000, "budget")
    s = r.withColumn("why", why).where("why is not null")
    return s.groupBy(F.col("user_id").alias("topic")).agg(F.min("event_id").alias("stops_at"), F.min_by("why", "event_id").alias("why"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate AS s, l_shipdate + INTERVAL 1 HOUR * CAST(l_quantity AS INTEGER) AS e FROM lineitem), p AS (SELECT l_orderkey, l_linenumber, s, e, unnest(range(0, CAST(ceil(epoch(e - s) / 7200) AS BIGINT))) AS n FROM l)
          SELECT l_orderkey, l_linenumber, CAST(n + 1 AS INTEGER) AS part, s + INTERVAL 2 HOUR * CAST(n AS INTEGER) AS begins, least(s + INTERVAL 2 HOUR * CAST(n + 1 AS INTEGER), e) AS ends FROM p""")
def split_ranges(t):
    """Pieces of two hours at most, numbered; the last may be short."""
    hours = F.col("l_quantity").cast("int")
    at = lambda n: F.col("l_shipdate") + F.make_dt_interval(F.lit(0), n)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", hours.alias("h"), F.explode(F.sequence(F.lit(1), F.ceil(hours / 2).cast("int"))).alias("part"))
    return rows.select("l_orderkey", "l_linenumber", "part", at((F.col("part") - 1) * 2).alias("begins"), at(F.least(F.col("part") * 2, F.col("h"))).alias("ends"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders), p AS (SELECT *, (n - 1) // 100 AS page FROM m), c AS (SELECT min(page) AS last FROM p WHERE o_orderdate < TIMESTAMP '1998-01-01')
          SELECT month, count(*) AS commits FROM p, c WHERE page <= last GROUP BY 1""")
def months_until_cutoff(t):
    """Newest first by pages of a hundred, until a page holds something older than the cutoff; rows are counted by month."""
    cutoff = F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    fresh = t.orders.where(F.col("o_orderdate") >= cutoff).agg(F.count("*").alias("n"))
    # the first page that holds an older row ends the listing: so many rows in all
    want = fresh.select(((F.floor(F.col("n") / 100) + 1) * 100).alias("want"))
    older = t.orders.where(F.col("o_orderdate") < cutoff).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)  # never more than a page
    rank = F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey"))  # a hundred rows
    few = older.withColumn("k", rank).crossJoin(F.broadcast(want.crossJoin(fresh))).where("k + n <= want").select("o_orderdate")
    rows = t.orders.where(F.col("o_orderdate") >= cutoff).select("o_orderdate").union(few)
    return rows.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("commits"))
