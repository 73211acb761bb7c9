"""Filters as columns: eligibility, validity, authority, admission, safety, partitions and calendar windows."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T

#: Months by name and the days of a month's parts.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
PARTS = {"early": (1, 10), "mid": (11, 20), "late": (21, 31)}
#: Ordered categories of unsafe requests and what betrays them.
UNSAFE = (("minors", r"\b(child|minor)s?\b.*\bsexual"), ("physical", r"\b(build|make)\b.*\b(bomb|explosive)s?\b"), ("malware", r"\b(ransomware|keylogger|botnet)\b"), ("personal", r"\b(ssn|social security number|credit card number)\b"))


def eligible(scope_id: int, session_id: str | None = None) -> Column:
    """In scope, and in the session where one is asked for."""
    out = F.col("scope_id") == scope_id
    return out if session_id is None else out & (F.col("session_id") == session_id)


def valid_at(time: Column) -> Column:
    return (F.col("valid_from") <= time) & (F.col("valid_until").isNull() | (time < F.col("valid_until")))


def within(x: Column, low: float | None, high: float | None, low_open: bool = False, high_open: bool = False) -> Column:
    """x inside bounds that are open or closed; a bound that is None is none."""
    out = x.isNotNull()
    if low is not None:
        out &= (x > low) if low_open else (x >= low)
    if high is not None:
        out &= (x < high) if high_open else (x <= high)
    return out


def speaker_role(role: Column, text: Column) -> Column:
    """The role, or the one in brackets that the text begins with."""
    return F.coalesce(role, F.nullif(F.lower(F.regexp_extract(text, r"^\[([^\]]*)\]", 1)), F.lit("")))


def admitted(text: Column) -> Column:
    """Statements worth keeping: no question, and a number, a capitalised word after the first, or two different words."""
    words = T.tokens(text)
    return ~F.contains(text, F.lit("?")) & (text.rlike("[0-9]") | text.rlike(r"\S\s+\p{Lu}") | (F.size(F.array_distinct(words)) >= 2))


def activated(text: Column, keywords: list[str]) -> Column:
    """Whole-word match of any keyword."""
    return T.has_any(T.tokens(text), tuple(k.lower() for k in keywords))


def safety(text: Column) -> Column:
    """The first category that a text falls into; null for none."""
    out = F.lit(None).cast("string")
    low = F.lower(text)
    for name, pattern in reversed(UNSAFE):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def safe_routes(df: DataFrame, route: str, text: str) -> DataFrame:
    """Rows of routes in which no text is unsafe: one unsafe text stops its whole route."""
    bad = df.filter(safety(F.col(text)).isNotNull()).select(route).distinct()
    return df.join(bad, route, "left_anti")


def partition_id(mode: str, scope: Column, session: Column | None = None, goals: Column | None = None, entities: Column | None = None, source: Column | None = None) -> Column:
    """A digest of what a partition mode keeps apart: none, scope_session, scope_goal or scope_goal_entity_source."""
    sorted_ = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), "\x1e")
    parts = {"none": [F.lit("all")], "scope_session": [scope, session], "scope_goal": [scope, goals], "scope_goal_entity_source": [scope, goals, entities, source]}[mode]
    cast = [sorted_(p) if p is goals or p is entities else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("\x1f", F.lit(mode), *cast), 256)


def calendar_interval(question: str) -> tuple[dt.date, dt.date] | None:
    """The days that a question names: a date, a month or a part of one, or a range of months; None where it is ambiguous or open."""
    low = question.lower()
    if re.search(r"\b(as of|since|before|after|until)\b", low):
        return None
    months = "|".join(MONTHS)
    between = re.findall(rf"\b({months}) (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b", low)
    try:
        days = [dt.date(int(y), MONTHS.index(m) + 1, int(d)) for m, d, y in between] + [dt.date.fromisoformat(x) for x in re.findall(r"\b\d{4}-\d{2}-\d{2}\b", low)]
    except ValueError:
        return None
    if len(days) == 1:
        return days[0], days[0]
    if len(days) == 2 and re.search(r"\b(from|between)\b", low):
        return min(days), max(days)
    if days:
        return None
    named = re.findall(rf"\b(?:(early|mid|late)[ -])?({months}) (\d{{4}})\b", low)
    spans = []
    for part, month, year in named:
        first, last = PARTS.get(part, (1, 31))
        m = MONTHS.index(month) + 1
        end = (dt.date(int(year) + m // 12, m % 12 + 1, 1) - dt.timedelta(1)).day
        spans.append((dt.date(int(year), m, first), dt.date(int(year), m, min(last, end))))
    if len(spans) == 1:
        return spans[0]
    if len(spans) == 2 and re.search(r"\b(from|between)\b", low):
        return spans[0][0], spans[1][1]
    return None


def relative_window(question: str, today: dt.date) -> tuple[dt.date, dt.date] | None:
    """The days of `N days/weeks/months ago` (give or take 0, 1 or 3 days), yesterday, last week and the past weekend."""
    low = question.lower()
    if "yesterday" in low:
        return today - dt.timedelta(1), today - dt.timedelta(1)
    if m := re.search(r"\b(\d+|a|an|one|two|three|four|five|six) (day|week|month)s? ago\b", low):
        n = int(m[1]) if m[1].isdigit() else {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}[m[1]]
        if m[2] == "month":
            total = today.year * 12 + today.month - 1 - n
            year, month = divmod(total, 12)
            last = (dt.date(year + (month + 1) // 12, (month + 1) % 12 + 1, 1) - dt.timedelta(1)).day
            day, slack = dt.date(year, month + 1, min(today.day, last)), 3
        else:
            day, slack = today - dt.timedelta(n * (7 if m[2] == "week" else 1)), 1 if m[2] == "week" else 0
        return day - dt.timedelta(slack), day + dt.timedelta(slack)
    if "last week" in low:
        monday = today - dt.timedelta(today.weekday() + 7)
        return monday, monday + dt.timedelta(6)
    if re.search(r"\b(past|last) weekend\b", low):
        saturday = today - dt.timedelta((today.weekday() - 5) % 7 or 7)
        return saturday, saturday + dt.timedelta(1)
    return None


def visible(recorded_at: Column, delay: Column, clock: Column) -> Column:
    return recorded_at + delay <= clock


def opportunity(events: DataFrame, by: list[str], reachable: Column, prepared: Column, done: Column) -> DataFrame:
    """Of what was possible, prepared for and done: taken, missed, unprepared or out of reach."""
    outcome = F.when(~reachable, "out_of_reach").when(~prepared, "unprepared").when(done, "taken").otherwise("missed")
    return events.groupBy(*by, outcome.alias("outcome")).agg(F.count("*").alias("n"))
