"""Keeping archives: schedules, retries, guards, budgets of bytes, archive and audit decisions, checks of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: what ends retrying at once
PERMANENT = r"(?i)401|403|unauthorized|forbidden|invalid_grant|not found"


def due(kind: Column, forced: Column, hour: Column, weekday: Column, daily_at: Column, ran_today: Column, work: Column, off: Column, minutes: Column, begins: float = 6, ends: float = 20.5) -> Column:
    """Why a job runs or waits. Daily ones run once a day from their hour on; others by the interval of work or off hours (Monday is 0)."""
    at_work = (weekday < 5) & (hour >= begins) & (hour < ends)
    interval = F.when(at_work, work).otherwise(off)
    daily = F.when(ran_today, "ran today").when(hour >= daily_at, "due").otherwise("not yet")
    often = F.when(interval.isNull(), "not scheduled").when(minutes.isNull(), "never synced").when(minutes >= interval, "due").otherwise("wait")
    return F.when(forced, "forced").when(kind == "daily", daily).otherwise(often)


def retry(job: Column, error: Column, attempts: Column, allowed: list[str], most: int) -> Column:
    """What follows a failed run."""
    return F.when(~job.isin(*allowed), "not retried").when(error.rlike(PERMANENT), "permanent").when(attempts >= most, "exhausted").otherwise("retry")


def probed(rows: DataFrame, denied: DataFrame, key: str, now: Column, days: int) -> DataFrame:
    """rows with ``probe``: resources denied less than some days ago are left alone."""
    age = F.datediff(now, F.col("denied_at"))
    return rows.join(denied.select(key, "denied_at"), key, "left").withColumn("probe", F.col("denied_at").isNull() | (age >= days))


def model_changed(state: dict, model: str, size: int) -> bool:
    """Whether an index was made by another model or at another size, and so must be made anew."""
    return bool(state) and (state.get("model"), state.get("size")) != (model, size)


def backfill_queue(state: DataFrame, files: DataFrame, queued: DataFrame, limit: int) -> DataFrame:
    """(key, source, turn): files without context that exist and are not queued yet, dealt round robin over sources."""
    open_ = state.where("not context").join(files.select("key"), "key", "left_semi").join(queued.select("key"), "key", "left_anti")
    turn = F.row_number().over(Window.partitionBy("source").orderBy("key"))
    return open_.select("key", "source").withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", "source").limit(limit)


def greedy_within(files: DataFrame, group: str, newest: int, each: int, total: int) -> DataFrame:
    """Of the newest of each group those that fit: one over ``each`` bytes is skipped, and one that would break the running total, while later smaller ones may fit.

    Order matters, so a group is folded as one list; it holds ``newest`` files at most.
    """
    order = Window.partitionBy(group).orderBy(F.desc("modified"), "name")
    few = files.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= newest)
    listed = few.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_n", "name", "bytes"))).alias("l"))
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, f: Column) -> Column:
        fits = (f["bytes"] <= each) & (acc["sum"] + f["bytes"] <= total)
        return F.when(fits, F.struct((acc["sum"] + f["bytes"]).alias("sum"), F.concat(acc["kept"], F.array(f["name"].cast("string"))).alias("kept"))).otherwise(acc)

    return listed.withColumn("r", F.aggregate("l", empty, step)).select(group, F.col("r.sum").alias("bytes"), F.array_join("r.kept", ",").alias("kept"))


def archive_skip(dated_only: Column, dated: Column, excluded: Column, age: Column, limit: Column, exempt: Column, mirrored: Column, same: Column, taken: Column) -> Column:
    """Null where a file is no candidate; else why it stays, in order, or that it moves."""
    candidate = ~excluded & (~dated_only | dated) & (age > limit)
    reason = F.when(exempt, "exempt").when(~mirrored, "one-sided").when(~same, "sides differ").when(taken, "collision").otherwise("move")
    return F.when(candidate, reason)


def memory_states(rows: DataFrame, indexed: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """(id, state) of notes (id, parses, until, volatile, audited, superseded, links): every state that holds, and INDEX for what the index lists alone.

    PARSE, EXPIRED, AGING (volatile, not audited for some days), UNAUDITED, SUPERSEDED, DANGLING (a link to no note), INDEX (not indexed).
    """
    known = rows.select(F.col("id").alias("link"), F.lit(True).alias("there"))
    dangling = rows.select("id", F.explode("links").alias("link")).join(known, "link", "left").where("there is null").select("id").distinct().withColumn("dangling", F.lit(True))
    held = indexed.select("id").distinct().withColumn("listed", F.lit(True))
    found = rows.join(dangling, "id", "left").join(held, "id", "left")
    age = F.datediff(now, "audited")
    tests = {
        "PARSE": ~F.col("parses"), "EXPIRED": F.col("until") < now, "AGING": F.col("volatile") & (age > days), "UNAUDITED": F.col("audited").isNull(),
        "SUPERSEDED": F.col("superseded"), "DANGLING": F.col("dangling"), "INDEX": F.col("listed").isNull(),
    }
    states = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests.items()]))
    own = found.select("id", F.explode(states).alias("state"))
    return own.union(held.join(rows.select("id"), "id", "left_anti").select("id", F.lit("INDEX")))


def freshness(latest: DataFrame, now: Column, cadence: Column, dismissed: Column, expires: int = 14) -> DataFrame:
    """latest (key, at) with ``state``: stale beyond twice its cadence (hours); a dismissal holds for some days, then it is an ALERT."""
    hours = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))) / 3600
    since = F.datediff(now, dismissed)
    state = F.when(hours <= 2 * cadence, "OK").when(dismissed.isNull(), "STALE").when(since > expires, "ALERT").otherwise("triaged")
    return latest.withColumn("state", state)


# checks of documents: name -> (content, parameters) -> whether it holds

_lines = lambda c: F.size(F.filter(F.split(F.regexp_replace(c, "\n$", ""), "\n"), lambda x: x.isNotNull()))
_count = lambda c, p: F.size(F.regexp_extract_all(c, F.lit(f"(?m){p}"), F.lit(0)))
_front = lambda c: F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---", 1)
_field = lambda c, k: F.trim(F.regexp_extract(_front(c), rf"(?m)^{k}:\s*(.*)$", 1))
_report = lambda c, k: F.trim(F.regexp_extract(c, rf"(?m)^{k}:\s*(.*)$", 1))
_every = lambda tests: reduce(lambda a, b: a & b, tests, F.lit(True))
_place = lambda c, p: F.length(F.regexp_extract(c, rf"(?sm)\A(.*?){p}", 1))
_jsonl = lambda c, ok: F.forall(F.split(c, "\n"), lambda x: (F.trim(x) == "") | ok(x))
_json = lambda x: F.get_json_object(x, "$").isNotNull()
_section = lambda c, p: F.regexp_extract(c, rf"(?sm)^{p}[^\n]*\n(.*?)(?=^#|\z)", 1)

#: fixed values: marks of a text that was cut
TRUNCATED = r"\[truncated\]|\[TRUNCATED\]|\.\.\.\s*\(truncated|…\s*\(truncated"

CHECKS = {
    "file_exists": lambda f, p: F.coalesce(F.length(f["content"]) > 0, F.lit(False)),
    "file_fresh": lambda f, p: f["age_hours"] <= p["max_age_hours"],
    "min_lines": lambda f, p: _lines(f["content"]) >= p["min"],
    "max_lines": lambda f, p: _lines(f["content"]) <= p["max"],
    "frontmatter_parses": lambda f, p: _front(f["content"]).rlike(r"(?m)^[\w-]+:"),
    "frontmatter_fields": lambda f, p: _every([_front(f["content"]).rlike(rf"(?m)^{k}:") for k in p["required"]] + [_field(f["content"], k).rlike(f"^(?:{v})$") for k, v in p.get("value_patterns", {}).items()]),
    "date_matches_filename": lambda f, p: (_field(f["content"], "date") != "") & f["name"].contains(_field(f["content"], "date")),
    "section_present": lambda f, p: f["content"].rlike(f"(?m){p['pattern']}"),
    "sections_in_order": lambda f, p: _every([f["content"].rlike(f"(?m){x}") for x in p["patterns"]] + [_place(f["content"], a) <= _place(f["content"], b) for a, b in zip(p["patterns"], p["patterns"][1:], strict=False)]),
    "regex_present": lambda f, p: _count(f["content"], p["pattern"]) >= p.get("min_count", 1),
    "regex_all": lambda f, p: _every([f["content"].rlike(f"(?m){x}") for x in p["patterns"]]),
    "regex_absent": lambda f, p: ~f["content"].rlike(f"(?m){p['pattern']}"),
    "no_em_dashes": lambda f, p: ~f["content"].contains("—"),
    "no_truncation_markers": lambda f, p: ~f["content"].rlike(p.get("pattern", TRUNCATED)),
    "counts_equal": lambda f, p: _count(f["content"], p["pattern_a"]) == _count(f["content"], p["pattern_b"]),
    "frontmatter_count_matches": lambda f, p: F.coalesce(_field(f["content"], p["field"]).try_cast("int") == _count(f["content"], p["pattern"]), F.lit(False)),
    "numbered_list_max": lambda f, p: f["content"].rlike(f"(?m)^{p['section']}") & (_count(_section(f["content"], p["section"]), r"^\d+\.\s") <= p["max"]),
    "checkbox_states_valid": lambda f, p: _count(f["content"], r"^\s*[-*] \[[^ xX]\]") == 0,
    "json_parses": lambda f, p: _every([_json(f["content"])] + [F.get_json_object(f["content"], f"$.{k}").isNotNull() for k in p.get("required_keys", [])]),
    "jsonl_parses": lambda f, p: _jsonl(f["content"], _json),
    "jsonl_schema_fields": lambda f, p: _jsonl(f["content"], lambda x: _every([F.get_json_object(x, f"$.{k}").isNotNull() for k in p["required"]] + [F.coalesce(F.get_json_object(x, f"$.{k}").isin(*v), F.lit(True)) for k, v in p.get("enums", {}).items()])),
    "report_parses": lambda f, p: _every([_report(f["content"], k) != "" for k in ("SKILL_COMPLETE", *p.get("required_fields", ("STATUS",)))]),
    "report_field_valid": lambda f, p: _report(f["content"], p["field"]).isin(*p["allowed"]),
    "report_artifact_exists": lambda f, p: F.lower(_report(f["content"], "ARTIFACT")).rlike("^(?:none|n/a)") | F.array_contains(f["artifacts"], _report(f["content"], "ARTIFACT")),
    "zero_requires_no_artifact": lambda f, p: F.when(F.regexp_extract(_report(f["content"], p["field"]), r"^(\d+)", 1) == "", False)
    .when(F.regexp_extract(_report(f["content"], p["field"]), r"^(\d+)", 1).try_cast("int") == 0, F.lower(_report(f["content"], "ARTIFACT")).rlike("^(?:none|n/a)"))
    .otherwise(F.array_contains(f["artifacts"], _report(f["content"], "ARTIFACT"))),
}


def checked(files: DataFrame, checks: list[tuple[str, str, dict]], kind: str) -> DataFrame:
    """(name, check, verdict) of files (name, content, age_hours, artifacts, kind): PASS, FAIL, or SKIP where a check is meant for another kind ("" for all)."""
    f = {c: F.col(c) for c in ("name", "content", "age_hours", "artifacts")}
    found = [F.struct(F.lit(n).alias("check"), F.when((F.lit(of) != "") & (F.col(kind) != of), "SKIP").when(F.coalesce(CHECKS[n](f, p), F.lit(False)), "PASS").otherwise("FAIL").alias("verdict")) for n, of, p in checks]
    return files.select("name", F.explode(F.array(*found)).alias("x")).select("name", "x.check", "x.verdict")
