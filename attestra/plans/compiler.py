"""Questions into programs: a rule names an operator and its operands, and a question that fits two operators is not answered."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from attestra.operators.predicates import calendar_interval, relative_window

#: What a question says and the operator that it asks for.
RULES = (
    ("COUNT_DISTINCT", r"\bhow many (?:different|distinct)\b"),
    ("SUM", r"\b(?:how much|how many \w+) (?:\w+ )*?in total\b|\btotal (?:amount|value|number) of\b"),
    ("LOOKUP", r"\b(?:current|latest|most recent)\b|\bwhat (?:is|was) the (?:state|value|status) of\b"),
    ("INTERVAL", r"\bhow (?:long|many days|many weeks) (?:\w+ )*?between\b"),
    ("EXPLAIN_CAUSE", r"\bwhy did\b|\bwhat caused\b"),
    ("EXISTS", r"\b(?:is|was|were|are) there (?:any|ever)\b|\bdid \w+ ever\b"),
    ("ARGMAX", r"\b(?:last|final) time\b"),
    ("ARGMIN", r"\bfirst time\b"),
)
UNITS = {"cents": "cent", "cent": "cent", "days": "day", "day": "day", "weeks": "week", "week": "week", "seconds": "sec", "second": "sec", "dollars": "USD", "euros": "EUR"}


@dataclass(frozen=True)
class Program:
    """state: compiled, unsupported (no rule fits) or abstain (more than one does)."""

    state: str
    operator: str | None = None
    subject: str | None = None
    predicates: tuple[str, ...] = ()
    unit: str = ""
    at_time: int | None = None
    days: tuple[dt.date, dt.date] | None = None
    reason: str = ""


def compile_question(question: str, predicates: tuple[str, ...], today: dt.date | None = None) -> Program:
    """predicates: the names that a question may use, as declared by the data. A subject is written `kind:key`."""
    low = question.lower()
    fits = [name for name, pattern in RULES if re.search(pattern, low)]
    if not fits:
        return Program("unsupported", reason="no_rule_fits")
    if len(fits) > 1:
        return Program("abstain", reason="ambiguous_operator:" + ",".join(fits))
    named = tuple(sorted((p for p in predicates if re.search(rf"\b{re.escape(p.lower())}s?\b", low)), key=lambda p: low.index(p.lower())))
    if not named or len(named) > (2 if fits[0] == "INTERVAL" else 1) or fits[0] == "INTERVAL" and len(named) != 2:
        return Program("abstain", fits[0], reason="operands_not_unique")
    subject = re.search(r"\b([a-z]+:[a-z0-9_-]+)\b", low)
    unit = next((u for word, u in UNITS.items() if re.search(rf"\b{word}\b", low)), "")
    bound = re.search(r"\bas of (\d{4}-\d{2}-\d{2})\b", low)
    at = int(dt.datetime.fromisoformat(bound[1]).replace(tzinfo=dt.UTC).timestamp()) + 86399 if bound else None
    window = None if bound else calendar_interval(question) or (relative_window(question, today) if today else None)
    return Program("compiled", fits[0], subject[1] if subject else None, named, unit, at, window)
