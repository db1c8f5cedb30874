"""What to write to somebody who owes something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FRONT_MARKS, at_word, lead_verbs

#: fixed values: where the first clause of a description ends, how its front may name the ower, and what waits for what
CLAUSE_END = r"\s+--\s+|[;\n]|(?<=[a-z0-9\)])\.\s"
AFTER_NAME = r"(?i)^\s*[:,]?\s*(?:to\s+|owes\s+|will\s+|and\s+\S+\s+(?:to\s+)?)?"

WAITS = r"(?i)^(.{5,140}?)\s+(?:is|are)\s+(?:gated on|blocked on|waiting on|contingent on)\s+(.{5,160})"
#: fixed values: the question by the number of asks, the last for all further ones
ASKS = ("Where do we stand on {topic}?", "Still on my list: {topic}. Where are we?", "{nth} on {topic}. What's blocking it?")
NTH = ("First ask", "Second ask", "Third ask")


def clause(text: Column) -> Column:
    return F.trim(F.get(F.split(text, CLAUSE_END, 2), F.lit(0)))


def without_name(text: Column, *names: Column) -> Column:
    """The text without the first of the names that it begins with, whatever its case, and what leads on from there."""
    off = [F.when((n != "") & F.lower(text).startswith(F.lower(n)), F.regexp_replace(F.substr(text, F.length(n) + 1), AFTER_NAME, "")) for n in names]
    return F.coalesce(*off, text)


def nudges(items: DataFrame, today: Column) -> DataFrame:
    """(id, topic, stakes, message) of items (id, description, ower, asks, gating, gates, due); ower is null for nobody.

    The topic is the first clause without the ower's name and other marks in front, its leading verbs as gerunds. The stakes are what
    waits for it, if the clause says so of a gating item (then the topic is what it waits for), else the gates unless
    they begin like the clause, else the day that it was due. The question goes by the number of asks.
    """
    whole, first = F.coalesce("ower", F.lit("")), F.substring_index(F.coalesce("ower", F.lit("")), " ", 1)
    said = clause(F.col("description"))
    plain = without_name(said, whole, first)
    for mark in FRONT_MARKS:
        plain = F.regexp_replace(plain, mark, "")
    own = at_word(F.regexp_replace(lead_verbs(F.trim(plain)), r"\.+$", ""), 100)
    rows = items.select("id", "asks", "due", "gating", "gates", "ower", said.alias("said"), own.alias("own"), F.regexp_extract(said, WAITS, 1).alias("stake"), F.regexp_extract(said, WAITS, 2).alias("thing"))
    waits = F.coalesce(F.col("gating") & (F.col("stake") != ""), F.lit(False))
    thing = at_word(F.regexp_replace(F.trim("thing"), r"\.+$", ""), 100)
    thing = F.when((first != "") & F.lower(thing).startswith(F.lower(first)), F.trim(F.substr(thing, F.length(first) + 1))).otherwise(thing)
    gate = F.regexp_replace("gates", r"\.+$", "")
    begins = lambda a, b: F.lower(a).startswith(F.substring(F.lower(b), 1, 30))
    gated = F.coalesce(F.col("gating") & (F.col("gates") != "") & (F.col("gates") != "priority: critical") & ~begins(gate, F.col("said")) & ~begins(F.col("said"), gate), F.lit(False))
    overdue = F.coalesce(F.col("due") < today, F.lit(False))
    stakes = (
        F.when(waits, F.concat(at_word(F.trim("stake"), 90), F.lit(" is waiting on it."))).when(gated, F.concat(gate, F.lit(".")))
        .when(overdue, F.concat(F.lit("Due was "), F.date_format("due", "M/d"), F.lit("."))).otherwise("")
    )
    rows = rows.select("id", "asks", F.when(waits, thing).otherwise(F.col("own")).alias("topic"), stakes.alias("stakes"))
    nth = F.coalesce(F.get(F.array(*[F.lit(x) for x in NTH]), F.col("asks") - 1), F.concat(F.lit("Ask #"), F.col("asks").cast("string")), F.lit(""))
    filled = lambda form: F.replace(F.replace(F.lit(form), F.lit("{topic}"), F.col("topic")), F.lit("{nth}"), nth)
    question = F.when(F.coalesce(F.col("asks") <= 1, F.lit(True)), filled(ASKS[0])).when(F.col("asks") == 2, filled(ASKS[1])).otherwise(filled(ASKS[2]))
    return rows.select("id", "topic", "stakes", F.rtrim(F.concat_ws(" ", question, F.nullif("stakes", F.lit("")))).alias("message"))
