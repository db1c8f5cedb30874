"""Rules of the desk: calendars, plans, journals, budgets, commitments and watchdogs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, tasks

HOUR, DAY = 3600.0, 86400.0
#: fixed values: what says that something waits for a commitment
GATING = r"(?i)gated on|blocked by|waiting on"


def work_overlaps(meetings: DataFrame) -> DataFrame:
    """(who, a, b) of meetings (who, id, s, e, work) that overlap, one of them at least for work."""
    pairs = intervals.overlaps(meetings, "who", "id", "s", "e", DAY)
    work = meetings.select("who", "id", "work")
    rows = pairs.join(work.select("who", F.col("id").alias("a"), F.col("work").alias("x")), ["who", "a"]).join(work.select("who", F.col("id").alias("b"), F.col("work").alias("y")), ["who", "b"])
    return rows.where("x or y").select("who", "a", "b")


def prep_gaps(meetings: DataFrame, before: float, limit: float) -> DataFrame:
    """(id, busy_minutes, unprepared) of work meetings: the clips of others in the time before them, joined by the hours they touch."""
    hours = lambda a, b: F.explode(F.sequence(F.floor(a / HOUR), F.floor(b / HOUR)))
    asked = meetings.where("work").select("who", "id", F.col("s").alias("at"), hours(F.col("s") - before, F.col("s")).alias("hour"))
    busy = meetings.select("who", F.col("id").alias("other"), "s", "e", hours(F.col("s"), F.col("e")).alias("hour"))
    near = asked.join(busy, ["who", "hour"]).where((F.col("id") != F.col("other")) & (F.col("s") < F.col("at")) & (F.col("e") > F.col("at") - before))
    # a pair that shares several hours counts in the first of them
    first = F.greatest(F.floor((F.col("at") - before) / HOUR), F.floor(F.col("s") / HOUR))
    clips = near.where(F.col("hour") == first).groupBy("id").agg(F.sum(F.least("at", "e") - F.greatest(F.col("at") - before, "s")).alias("t"))
    minutes = F.coalesce(F.col("t") / 60, F.lit(0.0))
    return meetings.where("work").select("id").join(clips, "id", "left").select("id", F.round(minutes, 4).alias("busy_minutes"), (minutes >= limit).alias("unprepared"))


def out_of_hours(meetings: DataFrame, opens: int, closes: int) -> DataFrame:
    """meetings with ``why``: early, late or weekend; others are left out."""
    hour, day = F.floor(F.col("s") / HOUR) % 24, F.weekday(F.to_date(F.timestamp_seconds("s")))
    return meetings.withColumn("why", F.when(hour < opens, "early").when(hour >= closes, "late").when(day >= 5, "weekend")).where("why is not null")


def finding(excluded: Column, crowd: Column, work: Column, minutes: Column) -> Column:
    """The first of: excluded, large forum, delegate, worth it?, keep."""
    return F.when(excluded, "excluded").when((crowd >= 3) & (minutes > 60), "large forum").when(~work & (minutes > 75), "delegate").when(minutes > 90, "worth it?").otherwise("keep")


RECURRING, ZOMBIE_WINDOW, ZOMBIE_CANCELLED, LARGE = 3, 4, 2, 8


def series_history(past: DataFrame) -> DataFrame:
    """(who, title, dates, cancelled) of past instances (who, title, day, cancelled): how many dates a series had, and how many of the last four were cancelled.

    A date counts as cancelled if all its instances are.
    """
    days = past.groupBy("who", "title", "day").agg(F.bool_and("cancelled").alias("off"))
    nth = F.row_number().over(Window.partitionBy("who", "title").orderBy(F.desc("day")))
    return days.withColumn("n", nth).groupBy("who", "title").agg(F.count("*").alias("dates"), F.count_if(F.col("off") & (F.col("n") <= ZOMBIE_WINDOW)).alias("cancelled"))


def worthiness(meetings: DataFrame, history: DataFrame, principal: str, lanes: tuple, never: tuple = (), organizers: tuple = ()) -> DataFrame:
    """(who, title, id, finding, to, cancelled): at most one advice a series of the meetings ahead (who, title, id, day, s, organizer, attendees, work, all_day, cancelled).

    Titles with one of ``never`` and meetings of ``organizers`` get none. A series of three dates or more of which two of the last four
    were cancelled is a zombie: kill it if one ahead is cancelled already, else skip it. Then, by the earliest meeting for which
    one holds: delegate what the principal organises in somebody's lane (pattern, who) and that recurs; confirm a recurring
    forum of eight attendees or more that somebody else organises. Only timed work meetings that aren't cancelled count for
    all but the first.
    """
    known = history.select("who", "title", "dates", F.col("cancelled").alias("gone"))
    rows = meetings.join(known, ["who", "title"], "left").withColumns({"dates": F.coalesce("dates", F.lit(0)), "gone": F.coalesce("gone", F.lit(0))})
    spared = F.coalesce(F.col("organizer").isin(*organizers), F.lit(False))
    for pattern in never:
        spared = spared | F.col("title").contains(pattern)
    recurs, zombie = F.col("dates") >= RECURRING, (F.col("dates") >= RECURRING) & (F.col("gone") >= ZOMBIE_CANCELLED)
    active = ~F.col("cancelled") & F.col("work") & ~F.col("all_day")
    own = F.coalesce(F.col("organizer") == principal, F.lit(False))
    lane = F.coalesce(*[F.when(F.col("title").rlike(pattern), who) for pattern, who in lanes], F.lit(None).cast("string"))
    one = lambda when, place, finding, to=None: F.when(when, F.struct(F.lit(place).alias("place"), F.lit(finding).alias("finding"), (F.lit(None) if to is None else to).cast("string").alias("to")))
    advice = F.coalesce(
        one(F.col("cancelled") & zombie, 0, "kill the series"), one(active & zombie, 1, "skip or kill the series"), one(active & own & recurs & lane.isNotNull(), 1, "delegate", lane),
        one(active & recurs & (F.col("attendees") >= LARGE) & ~own, 1, "confirm or send a delegate"),
    )
    found = rows.where(~spared).withColumn("a", advice).where("a is not null")
    first = found.groupBy("who", "title").agg(F.min_by(F.struct("id", "a.finding", "a.to", "gone"), F.struct("a.place", "day", "s", "id")).alias("f"))
    return first.select("who", "title", "f.id", "f.finding", "f.to", F.col("f.gone").alias("cancelled"))


def mirrored(primary: DataFrame, mirror: DataFrame) -> DataFrame:
    """(title, at, id, mirror_only, cancelled) of two calendars (title, at, id, cancelled), one row for title and minute."""
    one = lambda rows, a, b: rows.groupBy("title", "at").agg(F.min("id").alias(a), F.bool_or("cancelled").alias(b))
    rows = one(primary, "p", "p_off").join(one(mirror, "m", "m_off"), ["title", "at"], "full_outer")
    active = F.col("p").isNotNull() & ~F.coalesce("p_off", F.lit(False))
    off = (F.coalesce("m_off", F.lit(False)) & ~active) | F.coalesce("p_off", F.lit(False))
    return rows.select("title", "at", F.coalesce("p", "m").alias("id"), F.col("p").isNull().alias("mirror_only"), off.alias("cancelled"))


def _headed(lines: DataFrame, key: str, n: str, line: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(n)
    head = F.when(F.col(line).startswith("## "), F.substring(line, 4, 1 << 30))
    return lines.withColumn("group", F.last(head, ignorenulls=True).over(w)).withColumn("group_no", F.count(head).over(w))


def checkboxes(lines: DataFrame, key: str, n: str, line: str) -> DataFrame:
    """Lines that begin with a checkbox in the first column, with heading, its number and whether they are done."""
    rows = _headed(lines, key, n, line).where(F.col(line).rlike(r"^- \[[ xX]\] "))
    return rows.withColumn("done", F.substring(line, 4, 1).isin("x", "X"))


def frontier(boxes: DataFrame, key: str) -> DataFrame:
    """The open rows of the first group that has any."""
    first = boxes.where("not done").groupBy(key).agg(F.min("group_no").alias("group_no"))
    return boxes.where("not done").join(first, [key, "group_no"])


def bullets(lines: DataFrame, key: str, n: str, line: str, sections: list[str]) -> DataFrame:
    """(key, section, item) of the bullets under the named headings."""
    rows = _headed(lines, key, n, line).where(F.col("group").isin(*sections)).where(F.col(line).rlike(r"^\s*[-*]\s+"))
    return rows.select(key, F.col("group").alias("section"), F.trim(F.regexp_replace(line, r"^\s*[-*]\s+", "")).alias("item"))


def folded(journal: DataFrame, now: Column, ticked: Column, grace: float = 900, expiry: float = DAY) -> DataFrame:
    """(task, last, failures, decision) of a journal (task, n, at, status)."""
    rows = journal.groupBy("task").agg(F.max_by("status", F.struct("at", "n")).alias("last"), F.max("at").alias("at"), F.count_if(F.col("status") == "failed").alias("failures"))
    age, last = now - F.col("at"), F.col("last")
    decision = F.when(ticked | (last == "done"), "done").when((F.col("failures") >= 2) & (last == "failed"), "quarantined")
    decision = decision.when(((last == "issued") & (age <= grace)) | ((last == "running") & (age <= expiry)), "in flight").when(last.isin("issued", "running"), "expired").otherwise("retry")
    return rows.select("task", "last", "failures", decision.alias("decision"))


def utilised(sessions: DataFrame, window: int, now: Column, share: float = 0.7, idle: int = 60) -> DataFrame:
    """(session, used, idle, decision) of sessions (session, peak, last, captured)."""
    minutes = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.date_trunc("minute", "last").cast("timestamp"))) / 60)
    decision = F.when(F.col("captured"), "already captured").when(F.col("peak") >= share * window, "wake").when(minutes >= idle, "capture idle").otherwise("skip")
    return sessions.select("session", F.round(F.col("peak") / window, 6).alias("used"), minutes.cast("long").alias("idle"), decision.alias("decision"))


def direction(incoming: Column, answered: Column, seconds: Column) -> Column:
    """missed only without answer and without a second."""
    return F.when(~answered & (seconds == 0), "missed").when(incoming, "in").otherwise("out")


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], bins: int = 4096) -> DataFrame:
    """(keys, and a column a name): the values at ranks (from 0) of the ordered values of each key.

    Values are counted in ``bins`` ranges of each key; only the ranges that hold a rank are ordered, so no task orders all
    values of a key.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, value)
    span = rows.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_n"))
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_low")) / F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0) * bins)).cast("int")
    binned = rows.join(span, keys).withColumn("_bin", place)
    counted = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"))
    upto = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin")))  # bins rows a key
    asked = span.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("_n")).alias("_at")) for name, rank in ranks.items()])).alias("_x")).select(*keys, "_x.*")
    wanted = upto.join(asked, keys).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c"))).select(*keys, "_name", "_bin", (F.col("_at") - F.col("_upto") + F.col("_c")).alias("_skip"))
    inside = binned.join(wanted, [*keys, "_bin"]).groupBy(*keys, "_name", "_skip", value).agg(F.count("*").alias("_c"))
    ranked = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy(value)))
    found = ranked.where((F.col("_skip") < F.col("_upto")) & (F.col("_skip") >= F.col("_upto") - F.col("_c")))
    return found.groupBy(*keys).pivot("_name", list(ranks)).agg(F.first(value))


def at_rank(rows: DataFrame, keys: list[str], value: str, rank: Callable[[Column], Column], name: str, bins: int = 4096) -> DataFrame:
    """(keys, name): the value at one rank."""
    return at_ranks(rows, keys, value, {name: rank}, bins)


def spent(rows: DataFrame, key: str, day: str, cost: str) -> DataFrame:
    """(key, day, cost, month_to_date)."""
    daily = rows.groupBy(key, day).agg(F.sum(cost).alias("sum"))
    w = Window.partitionBy(key, F.trunc(day, "month")).orderBy(day)
    return daily.select(key, day, F.round("sum", 2).alias("cost"), F.round(F.sum("sum").over(w), 2).alias("month_to_date"))


def _aged(items: DataFrame, today: Column) -> DataFrame:
    gating = (F.col("priority") == "1-URGENT") | F.col("note").rlike(GATING)
    return items.withColumn("age", F.datediff(today, "due").cast("long")).withColumn("gating", gating)


def ledger(items: DataFrame, today: Column) -> DataFrame:
    """(id, bucket, gating, owed_by, ask) of items (id, due, priority, note, mine): the ask counts weeks since it fell due."""
    age = F.col("age")
    bucket = F.when(age <= 0, "not due").otherwise(tasks.aging(age))
    ask = F.when(age > 0, F.floor(age / 7) + 1).otherwise(0).cast("long")
    return _aged(items, today).select("id", bucket.alias("bucket"), "gating", F.when(F.col("mine"), "me").otherwise("others").alias("owed_by"), ask.alias("ask"))


def split_ledger(items: DataFrame, today: Column, stale: int = 21) -> DataFrame:
    """items with age and ``side``: all that others owe and is due; of the principal's own only the stale."""
    rows = _aged(items, today).withColumn("side", F.when(F.col("mine"), "principal").otherwise("others"))
    return rows.where((~F.col("mine") & (F.col("age") > 0)) | (F.col("mine") & (F.col("age") > stale)))


def woken(items: DataFrame, today: Column) -> DataFrame:
    """items with ``woken``; open deferred ones whose day has come are intentions."""
    due = F.coalesce((F.col("status") == "open") & (F.col("type") == "deferred") & (F.col("due") <= today), F.lit(False))
    return items.withColumn("woken", due).withColumn("type", F.when(F.col("woken"), "intention").otherwise(F.col("type")))


def instantiated(templates: DataFrame, held: DataFrame, today: Column) -> DataFrame:
    """Active templates (id, rule, weekday, monthday, active) without a held instance, each with its next due day."""
    weekday = F.call_function("next_day", today, F.col("weekday"))
    due = F.when(F.col("rule") == "DAILY", tasks.next_daily(today)).when(F.col("rule") == "WEEKLY", weekday).otherwise(tasks.next_monthly(today, F.col("monthday")))
    return templates.where("active").join(held.select("id").distinct(), "id", "left_anti").withColumn("due", due)


def verdict(base: Column, ablated: Column, n: Column, tolerance: float, loss: float, least: int) -> Column:
    return F.when(n < least, "INCONCLUSIVE").when(ablated >= base - tolerance, "RETIRE").when(ablated < base - loss, "KEEP").otherwise("REVIEW")


GRACE, SLACK = 180, 30  # minutes


def last_fire(now: Column) -> Column:
    """The last run that a schedule (kind, hours, minute, weekday) expected three hours before ``now`` or earlier; null for intervals.

    daily and weekdays (Saturday and Sunday go back to Friday) fire at hours[0]:minute, weekly on ``weekday`` (0 is Monday),
    times at each of hours.
    """
    cutoff = now - F.make_dt_interval(mins=F.lit(GRACE))
    day = F.date_trunc("day", cutoff).cast("timestamp_ntz")
    fire = lambda hour: day + F.make_dt_interval(F.lit(0), hour, F.coalesce("minute", F.lit(0)))
    back = lambda at, days: at - F.make_dt_interval(days)
    by_cutoff = lambda at: F.when(at > cutoff, back(at, F.lit(1))).otherwise(at)
    daily = by_cutoff(fire(F.get("hours", F.lit(0))))
    weekly = back(daily, F.pmod(F.weekday(daily) - F.col("weekday"), F.lit(7)))
    times = F.array_max(F.transform("hours", lambda h: by_cutoff(day + F.make_dt_interval(F.lit(0), h))))
    return (
        F.when(F.col("kind") == "daily", daily).when(F.col("kind") == "weekdays", back(daily, F.greatest(F.weekday(daily) - 4, F.lit(0))))
        .when(F.col("kind") == "weekly", weekly).when(F.col("kind") == "times", times)
    )


def watched(jobs: DataFrame, made: DataFrame, fed: DataFrame, now: str) -> DataFrame:
    """(job, kind, expected, state) of jobs (job, kind, hours, minute, weekday, every, gated), their newest artefacts (job, made) and the days (job, day) with input.

    missing without any artefact, stale if the newest is older than the last expected run less half an hour, or than twice
    ``every`` hours and the grace for an interval. A gated job without input on the expected day is ok.
    """
    at = F.lit(now).cast("timestamp_ntz")
    rows = jobs.withColumn("expected", last_fire(at)).join(made, "job", "left").withColumn("_day", F.to_date("expected"))
    rows = rows.join(fed.select("job", F.col("day").alias("_day"), F.lit(True).alias("_fed")).distinct(), ["job", "_day"], "left")
    age = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("made").cast("timestamp"))) / 3.6e9
    excused = F.coalesce(F.col("gated"), F.lit(False)) & F.col("expected").isNotNull() & F.col("_fed").isNull()
    late = F.when(F.col("kind") == "interval", age > 2 * F.col("every") + GRACE / 60).otherwise(F.col("made") < F.col("expected") - F.make_dt_interval(mins=F.lit(SLACK)))
    state = F.when(F.col("made").isNull(), F.when(excused, "ok").otherwise("missing")).when(late & ~excused, "stale").otherwise("ok")
    return rows.select("job", "kind", "expected", state.alias("state"))


def budget_alerts(looks: DataFrame, key: str, at: str, used: str, capped: Column, cap: int, least: int) -> DataFrame:
    """(key, at, why): the cumulative cap holds for tasks (``capped``), growth for all; an alert repeats only beyond the last one."""
    w = Window.partitionBy(key).orderBy(at)
    rows = looks.withColumn("upto", F.sum(used).over(w)).withColumn("before", F.lag(used, 1, 0).over(w))
    over = capped & (F.col("upto") > cap)
    rows = rows.withColumn("over", over).withColumn("raised", F.col("over") | ((F.col(used) > F.col("before")) & (F.col(used) > least)))
    rows = rows.withColumn("top", F.max(F.when(F.col("raised"), F.col(used))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.where(F.col("raised") & (F.col(used) > F.coalesce("top", F.lit(0)))).select(key, at, F.when(F.col("over"), "cap").otherwise("growth").alias("why"))
