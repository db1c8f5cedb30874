import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.functions import temporal, text
from quern.operators import resolve

NOW = dt.datetime(2026, 7, 2, 22, tzinfo=dt.timezone(dt.timedelta(hours=-4)))
D = dt.date.fromisoformat
CASES = [
    ("budget review last week", "2026-06-22", "2026-06-28"), ("budget this week", "2026-06-29", "2026-07-05"), ("what did ann say yesterday?", "2026-07-01", "2026-07-01"),
    ("meetings today", "2026-07-02", "2026-07-02"), ("invoices last month", "2026-06-01", "2026-06-30"), ("changes recently", "2026-06-18", "2026-07-02"),
    ("hires in June", "2026-06-01", "2026-06-30"), ("hires in August", "2025-08-01", "2025-08-31"), ("call on Monday", "2026-06-29", "2026-06-29"), ("call 3 days ago", "2026-06-29", "2026-06-29"),
    ("mail since June 15", "2026-06-15", None), ("mail since last week", "2026-06-22", None), ("mail in the last 7 days", "2026-06-25", "2026-07-02"), ("Yesterday, what was decided", "2026-07-01", "2026-07-01"),
]
CASES += [
    ("lunch on Thursday", "2026-07-02", "2026-07-02"), ("lunch last Thursday", "2026-06-25", "2026-06-25"), ("lunch a day ago", "2026-07-01", "2026-07-01"), ("sales 2 weeks ago", "2026-06-15", "2026-06-21"),
    ("sales over the past 2 months", "2026-05-03", "2026-07-02"), ("sales last 3 days", "2026-06-29", "2026-07-02"), ("sales during early Feb 2024", "2024-02-01", "2024-02-29"), ("sales this month", "2026-07-01", "2026-07-31"),
    ("mail since Friday", "2026-06-26", None), ("mail since this month", "2026-07-01", None), ("mail since 2026-01-31", "2026-01-31", None), ("mail since Nov 3rd, 2025", "2025-11-03", None),
    ("mail tonight", "2026-07-02", "2026-07-02"), ("mail lately", "2026-06-18", "2026-07-02"), ("this week: open questions", "2026-06-29", "2026-07-05"), ("paid (last month)", "2026-06-01", "2026-06-30"),
]
NONE = ["last week's menu", "yesterday's call log", "the May summary", "last week about the bridge", "yesterday", "recently opened files list", "since the move", "ok today", "", None]


@pytest.mark.parametrize(("query", "start", "end"), CASES)
def test_phrases(query, start, end):
    assert temporal.rewritten(query, NOW.date())[1:] == (D(start), end and D(end))


@pytest.mark.parametrize("query", NONE)
def test_no_phrase(query):
    assert temporal.rewritten(query, NOW.date()) is None


def test_range_column(spark):
    rows = spark.createDataFrame([("plans last week",), (None,), ("plans",)], "q string").select(temporal.time_range(F.col("q"), NOW).alias("r")).collect()
    assert rows[0]["r"]["rest"] == "plans" and rows[0]["r"]["date_from"] == D("2026-06-22") and rows[1]["r"]["rest"] is None and rows[2]["r"]["date_to"] is None


def test_names():
    assert resolve.names_alike("Kim", "Kim Osei") == 0.85
    assert resolve.names_alike("Kim", "Kim Oyelaran") == 0.85
    assert round(resolve.names_alike("Mara Voss", "Marta Voss"), 4) == 0.9474  # 2 * 9 / 19
    assert round(resolve.names_alike("Ivo Kern", "Ida Kerr"), 4) == 0.625  # 2 * 5 / 16
    assert resolve.names_alike(" ann  LEE", "Ann Lee") == 1.0


def test_groups_are_stars():
    near = {(1, 2), (2, 3), (4, 5)}
    assert resolve.stars([1, 2, 3, 4, 5], lambda a, b: (a, b) in near or (b, a) in near) == [[1, 2], [4, 5]]


def test_tasks(spark):
    said = [(1, "send the quarterly report to ann"), (2, "send quarterly report to ann 2024-05-06"), (3, "book flights to oslo"), (4, "send the quarterly report to ann lee")]
    rows = spark.createDataFrame([(i, "me", "ann", s, i) for i, s in said] + [(5, "me", "bob", said[0][1], 5)], "id long, owner string, counterparty string, raw string, created long")
    rows = rows.withColumn("text", text.task_text(F.col("raw"))).withColumn("tokens", text.token_set(F.col("text")))
    got = {(r["keep"], r["cancel"]) for r in resolve.duplicate_groups(rows).collect()}
    assert got == {(1, 2), (1, 4)}
    found = resolve.candidates(rows.where("id = 2"), rows).collect()
    assert {r["match"] for r in found} == {1, 4, 5} and all(r["score"] <= 1 for r in found)
    names = spark.createDataFrame([("Ann Lee", "ann lee"), ("Ann", "Bo"), (None, "x")], "a string, b string").select(resolve.name_similarity("a", "b").alias("s")).withColumn("tier", resolve.tier(F.col("s")))
    assert [r["tier"] for r in names.collect()] == ["merge", "create", "create"]
