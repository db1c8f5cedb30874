"""Task lists over (due, status, created, ...): filters, marks, order, recurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: the statuses that each list mode goes by
OPEN = ("open", "in_progress", "waiting")
CLOSED = ("done", "cancelled")


#: fixed values: what a dashboard counts as blocked rather than due
BLOCKED = ("waiting", "blocked", "scheduled")


def week_end(today: Column) -> Column:
    """The Sunday of the week."""
    return F.next_day(F.date_sub(today, 1), "SUN")


def dashboard(tasks: DataFrame, today: Column) -> DataFrame:
    """One row of counts over (status, due, completed): what is due in its seven buckets; the week ends on the next Sunday."""
    due, live = F.col("due"), ~F.col("status").isin(*CLOSED, *BLOCKED)
    sunday = F.next_day(today, "SUN")
    buckets = {
        "overdue": (due < today) & live,
        "due_today": (due == today) & live,
        "this_week": (due > today) & (due <= sunday) & live,
        "next_week": (due > sunday) & (due <= F.date_add(sunday, 7)) & live,
        "needs_date": due.isNull() & live,
        "blocked": F.col("status").isin(*BLOCKED),
        "recently_done": (F.col("status") == "done") & (F.col("completed") >= F.date_sub(today, 7)),
    }
    return tasks.agg(*[F.count_if(where).alias(name) for name, where in buckets.items()])


def in_mode(mode: str, status: Column, due: Column, today: Column) -> Column:
    """Rows of one list: open, due, overdue, due_today, due_this_week, done or all. due_today takes closed tasks too."""
    active = ~status.isin(*CLOSED)
    return {
        "open": status.isin(*OPEN),
        "due": (due <= today) & active,
        "overdue": (due < today) & active,
        "due_today": due == today,
        "due_this_week": due.between(today, week_end(today)) & active,
        "done": status == "done",
        "all": F.lit(True),
    }[mode]


def due_mark(due: Column, today: Column) -> Column:
    return F.when(due < today, "OVERDUE").when(due == today, "DUE TODAY").otherwise("")


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """By due date, undated last, newest first within a day, with the total of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(F.asc_nulls_last("due"), F.desc("created"), "id").offset(offset).limit(limit)
    return top.crossJoin(F.broadcast(total))  # one row


def next_daily(after: Column, interval: int = 1) -> Column:
    return F.date_add(after, interval)


def next_weekly(after: Column, day: str) -> Column:
    """The first such weekday strictly after."""
    return F.next_day(after, day)


def next_monthly(after: Column, day: int) -> Column:
    """The given day of this month or the next, strictly after; short months end it early."""
    of = lambda d: F.least(F.date_add(F.trunc(d, "month"), day - 1), F.last_day(d))
    return F.when(of(after) > after, of(after)).otherwise(of(F.add_months(F.trunc(after, "month"), 1)))


def aging(age: Column, watch: int = 7, chase: int = 21) -> Column:
    return F.when(age <= watch, "watch").when(age <= chase, "chase").otherwise("stale")


def failure_streaks(runs: DataFrame, key: str, newest: Column, now: Column, days: int = 7) -> DataFrame:
    """Runs (key, at, status) whose newest ones failed twice or more in a row; cancelled ones are looked through."""
    w = Window.partitionBy(key).orderBy(newest)
    rows = runs.where("status <> 'cancelled'").withColumn("broken", F.sum((F.col("status") != "failed").cast("int")).over(w))
    found = rows.where("broken = 0").groupBy(key).agg(F.count("*").alias("streak"), F.min("at").alias("since"), F.max("at").alias("latest"))
    return found.where((F.col("streak") >= 2) & (F.datediff(now, "latest") <= days))
