"""Time phrases at the ends of a search query, as date ranges.

A phrase counts only at the very end of a query, or at its start before a
comma, colon or semicolon; a possessive is no phrase, and what is left must
say something.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Range = tuple[dt.date, dt.date | None]

#: fixed values: names of months, whole and short, and of days
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "sept": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
DAYS = {d: i for i, d in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())}
RECENT_DAYS = 14
_MONTH, _DAY = "|".join(sorted(MONTHS, key=len, reverse=True)), "|".join(DAYS)


def _ago(today: dt.date, n: int) -> dt.date:
    return today - dt.timedelta(days=n)


def _begin(name: str, year: str | None, today: dt.date) -> dt.date:
    """The first day of that month: of the year given, else the latest that has begun."""
    month = MONTHS[name]
    return dt.date(int(year) if year else today.year - (month > today.month), month, 1)


def _whole(first: dt.date) -> Range:
    return first, (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)


def _week(today: dt.date, back: int) -> Range:
    monday = _ago(today, today.weekday() + 7 * back)
    return monday, _ago(monday, -6)


def _months_back(today: dt.date) -> dt.date:
    return _ago(today.replace(day=1), 1).replace(day=1)


def _weekday(today: dt.date, name: str, same: bool) -> dt.date:
    """The latest such day; today counts only where ``same`` is set."""
    back = (today.weekday() - DAYS[name]) % 7
    return _ago(today, back if back or same else 7)


def _one(day: dt.date) -> Range:
    return day, day


_SINCE_MONTH = re.compile(rf"({_MONTH})(?:\s+(\d{{1,2}})(?:st|nd|rd|th)?)?(?:,?\s+(\d{{4}}))?")


def _since(today: dt.date, what: str) -> Range | None:
    what = what.strip()
    known = {"yesterday": lambda: _ago(today, 1), "this week": lambda: _week(today, 0)[0], "last week": lambda: _week(today, 1)[0], "this month": lambda: today.replace(day=1), "last month": lambda: _months_back(today)}
    if what in known:
        return known[what](), None
    if what in DAYS:
        return _weekday(today, what, False), None
    try:
        if m := _SINCE_MONTH.fullmatch(what):
            return _begin(m[1], m[3], today).replace(day=int(m[2] or 1)), None
        return dt.date.fromisoformat(what), None
    except ValueError:
        return None


_SPAN = {"day": 1, "week": 7, "month": 30}
#: in order: the first rule that holds decides; one that finds no clean date lets the next ones try
RULES: list[tuple[str, Callable[..., Range | None]]] = [
    (r"since\s+([a-z]{3,9} ?\d{0,2}(?:st|nd|rd|th)?(?:,? ?\d{4})?|[a-z]+ [a-z]+|\d{4}-\d{2}-\d{2})", _since),
    (r"(?:(\d{1,3})|a|one)\s+days?\s+ago", lambda t, n: _one(_ago(t, int(n or 1)))),
    (r"(?:(\d{1,2})|a|one)\s+weeks?\s+ago", lambda t, n: _week(t, int(n or 1))),
    (r"(?:(?:in|over|during|from)\s+)?(?:the\s+)?(?:last|past)\s+(\d{1,3})\s+(day|week|month)s?", lambda t, n, unit: (_ago(t, int(n) * _SPAN[unit]), t)),
    (rf"(?:in|during|from|throughout)\s+(?:(?:early|mid|late)[- ])?({_MONTH})(?:\s+(\d{{4}}))?", lambda t, m, y: _whole(_begin(m, y, t))),
    (rf"(on|last)\s+({_DAY})", lambda t, how, d: _one(_weekday(t, d, how == "on"))),
    (r"(?:from\s+)?this\s+week", lambda t: _week(t, 0)),
    (r"(?:from\s+)?last\s+week", lambda t: _week(t, 1)),
    (r"(?:from\s+)?this\s+month", lambda t: _whole(t.replace(day=1))),
    (r"(?:from\s+)?last\s+month", lambda t: _whole(_months_back(t))),
    (r"(?:from\s+)?yesterday", lambda t: _one(_ago(t, 1))),
    (r"(?:from\s+)?today|this\s+(?:morning|afternoon|evening)|tonight", _one),
    (r"recently|lately|in\s+the\s+(?:last|past)\s+few\s+days", lambda t: (_ago(t, RECENT_DAYS), t)),
]
_COMPILED = [(re.compile(rf"[\s,;:(](?:{p})[\s?!.)]*$", re.I), re.compile(rf"^(?:{p})[,:;]\s*", re.I), f) for p, f in RULES]


def rewritten(query: str | None, today: dt.date) -> tuple[str, dt.date, dt.date | None] | None:
    """(what is left, from, to) or None."""
    text = query or ""
    for at_end, at_start, resolve in _COMPILED:
        if m := at_end.search(text):
            rest = text[: m.start()].strip()
        elif m := at_start.search(text):
            rest = text[m.end() :].strip()
        else:
            continue
        if sum(c.isalnum() for c in rest) < 3:
            continue
        found = resolve(today, *(g and g.lower() for g in m.groups()))
        if found is not None:
            return rest, *found
    return None


def time_range(query: Column, now: dt.datetime, zone: str = "America/New_York") -> Column:
    """struct<rest, date_from, date_to> of each query, all null without a phrase; weeks begin on Monday in ``zone``."""
    today = now.astimezone(ZoneInfo(zone)).date()

    @F.pandas_udf("rest string, date_from date, date_to date")
    def apply(queries: pd.Series) -> pd.DataFrame:
        rows = [rewritten(q, today) or (None, None, None) for q in queries]
        return pd.DataFrame(rows, columns=["rest", "date_from", "date_to"])

    return apply(query)
