"""What an overnight run does next, by its plan and its journal; asks that are counted over runs; rules and states kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRACE, EXPIRY, FAILURES, REPLANS = 900.0, 86400.0, 2, 2


def journal_state(journal: DataFrame, now: Column, ticked: DataFrame) -> DataFrame:
    """(plan, kind, task, last, failures, completed, note, surfaced, flying) of a journal (plan, kind, task, n, at, status, note).

    The last word on each decides. What was issued is in flight for GRACE seconds, what is spawned for EXPIRY, unless its box is
    ticked; ``note`` is that of the last failure.
    """
    failed = F.col("status") == "failed"
    rows = journal.groupBy("plan", "kind", "task").agg(
        F.max_by(F.struct("status", "at"), F.struct("at", "n")).alias("l"), F.count_if(failed).alias("failures"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.max_by("note", F.when(failed, F.struct("at", "n"))).alias("note"), F.bool_or(F.col("status") == "surfaced").alias("surfaced"),
    )
    age = now - F.col("l.at")
    flying = ((F.col("l.status") == "issued") & (age <= GRACE)) | ((F.col("l.status") == "spawned") & (age <= EXPIRY))
    rows = rows.join(ticked.select("plan", "task", F.lit(True).alias("_ticked")), ["plan", "task"], "left")
    return rows.select("plan", "kind", "task", F.col("l.status").alias("last"), "failures", "completed", "note", "surfaced", (flying & F.col("_ticked").isNull()).alias("flying"))


def heartbeat(plans: DataFrame, tasks: DataFrame, journal: DataFrame, now: Column) -> DataFrame:
    """(plan, action, group, tasks): what each plan does at a heartbeat.

    plans (plan, active, stop_at, written) with times in seconds, tasks (plan, group, nth, task, ticked) in the order of nth,
    journal as in ``journal_state`` with kinds task, planner, replanner and winddown. The first that holds:

    * noop: not active, wound down already, or anything in flight;
    * log_winddown: no stop time, or past it;
    * without a written plan, spawn_planner, or surface once it has failed FAILURES times;
    * surface: open tasks that failed FAILURES times and were not surfaced yet, with these tasks;
    * spawn_tasks: the open tasks of the first group that has any which are not quarantined; one that failed before is a retry (``task!``);
    * surface, once the replanner has failed FAILURES times or completed REPLANS times; else spawn_replanner.
    """
    state = journal_state(journal, now, tasks.where("ticked").select("plan", "task"))
    own = lambda kind, what, name: state.where(F.col("kind") == kind).groupBy("plan").agg(what.alias(name))
    rows = plans
    for kind, what, name in (
        ("planner", F.max("failures"), "_planner"), ("replanner", F.max("failures"), "_replanner"), ("replanner", F.max("completed"), "_replanned"), ("winddown", F.count("*"), "_down"),
    ):
        rows = rows.join(own(kind, what, name), "plan", "left")
    rows = rows.join(state.where("flying and kind in ('task', 'planner', 'replanner')").groupBy("plan").agg(F.lit(True).alias("_flying")), "plan", "left")
    told = state.where("kind = 'task'").select("plan", "task", "failures", "surfaced")
    open_ = tasks.where("not ticked").join(told, ["plan", "task"], "left").withColumn("_bad", F.coalesce(F.col("failures") >= FAILURES, F.lit(False)))
    listed = lambda name: F.array_sort(F.collect_list(F.struct("nth", F.col(name).alias("v"))))  # noqa: E731  one plan's own tasks
    named = lambda c: F.transform(c, lambda x: x["v"])
    loud = open_.where(F.col("_bad") & ~F.coalesce("surfaced", F.lit(False))).groupBy("plan").agg(listed("task").alias("_loud"))
    good = open_.where("not _bad").withColumn("shown", F.concat("task", F.when(F.col("failures") > 0, "!").otherwise("")))
    first = good.withColumn("_least", F.min("nth").over(Window.partitionBy("plan", "group"))).withColumn("_first", F.min("nth").over(Window.partitionBy("plan"))).where("_least = _first")
    first = first.groupBy("plan").agg(F.first("group").alias("_group"), listed("shown").alias("_next"))
    rows = rows.join(loud, "plan", "left").join(first, "plan", "left")
    has = lambda c, n: F.coalesce(F.col(c) >= n, F.lit(False))
    ended = F.col("stop_at").isNull() | (now >= F.col("stop_at"))
    rules = (
        (~F.coalesce("active", F.lit(False)), "noop"), (ended & has("_down", 1), "noop"), (ended, "log_winddown"), (F.col("_flying").isNotNull(), "noop"),
        (~F.col("written") & has("_planner", FAILURES), "surface"), (~F.col("written"), "spawn_planner"), (F.col("_loud").isNotNull(), "surface"), (F.col("_next").isNotNull(), "spawn_tasks"),
        (has("_replanner", FAILURES) | has("_replanned", REPLANS), "surface"),
    )
    action = F.coalesce(*[F.when(c, a) for c, a in rules], F.lit("spawn_replanner"))
    rows = rows.withColumn("action", action)
    spawns, loudly = F.col("action") == "spawn_tasks", (F.col("action") == "surface") & F.col("written")
    return rows.select("plan", "action", F.when(spawns, F.col("_group")).alias("group"), F.when(spawns, named(F.col("_next"))).when(loudly, named(F.col("_loud"))).alias("tasks"))


def asked(first_seen: DataFrame, chased: DataFrame, today: Column) -> DataFrame:
    """(id, seen, ask): the counter state (id, seen) after a run with items ``chased`` (id): those that left are pruned, so that they begin anew when they return.

    The first week's ask is 1, and each week that an item stays adds one.
    """
    rows = chased.select("id").distinct().join(first_seen, "id", "left").withColumn("seen", F.coalesce("seen", today))
    return rows.withColumn("ask", (F.floor(F.datediff(today, "seen") / 7) + 1).cast("int"))


def classified(items: DataFrame, text: str, rules: DataFrame, other: str) -> DataFrame:
    """items with ``rule`` and ``bucket`` by rules (place, rule, bucket, verbs, pattern): the first by place whose pattern, and verbs where it asks for any, are found.

    Rules are a small table of patterns, sent to all tasks.
    """
    holds = lambda r: F.regexp_like(F.col(text), r["pattern"]) & (r["verbs"].isNull() | F.regexp_like(F.col(text), r["verbs"]))
    found = F.array_min(F.transform(F.filter("_rules", holds), lambda r: F.struct(r["place"], r["rule"], r["bucket"])))
    whole = F.broadcast(rules.agg(F.collect_list(F.struct("place", "rule", "bucket", "verbs", "pattern")).alias("_rules")))  # one row of rules
    rows = items.crossJoin(whole).withColumn("_r", found)
    return rows.select(*items.columns, F.coalesce("_r.rule", F.lit("unmatched")).alias("rule"), F.coalesce("_r.bucket", F.lit(other)).alias("bucket"))


def model_states(states: DataFrame, sources: DataFrame, model: str, size: int) -> DataFrame:
    """(source, rebuild, why) of sources against the kept states (source, model, size): new ones are built, changed ones built anew."""
    why = F.when(F.col("model").isNull(), "new").when(F.col("model") != model, "other model").when(F.col("size") != size, "other size")
    rows = sources.select("source").distinct().join(states, "source", "left")
    return rows.select("source", why.isNotNull().alias("rebuild"), why.alias("why"))


CUT, TAIL = 3000, 500


def tails(messages: DataFrame, last: int = 3, cut: int = CUT, most: int = TAIL) -> DataFrame:
    """(conv, tail) of messages (conv, turn, role, text): the last ones that say something, long ones of the assistant cut with a mark, and of these the last characters."""
    said = F.when((F.col("role") == "assistant") & (F.length("text") > cut), F.concat(F.substring("text", 1, cut), F.lit("\n[truncated for summarization]"))).otherwise(F.col("text"))
    rows = messages.where(F.trim("text") != "").withColumn("said", F.trim(said)).withColumn("_n", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("turn")))).where(F.col("_n") <= last)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"]), "\n\n")  # ``last`` messages
    return rows.groupBy("conv").agg(F.right(joined, F.lit(most)).alias("tail"))
