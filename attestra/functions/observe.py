"""Observed columns: charges that a rewrite may not lose, guards of rewrites, clocks and calendar shifts, an observer's weight, canonical digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions import text as T

NUMBER = r"\$?[0-9][0-9,]*(?:\.[0-9]+)?%?"
#: Words that carry no detail of a statement.
FUNCTION_WORDS = ("the", "and", "for", "with", "that", "this", "was", "were", "are", "has", "have", "had", "from", "into", "its", "but")


def _named(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def numbers(text: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def negations(text: Column) -> Column:
    return F.array_sort(F.filter(T.tokens(text), lambda w: w.isin(*T.NEGATIONS)))


def charges(text: Column) -> Column:
    """Sorted distinct atoms whose loss changes a statement: negations, numbers, tags and quotes."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), lambda q: F.array_join(T.tokens(q), " "))
    found = [_named("neg:", negations(text)), _named("num:", numbers(text)), _named("tag:", F.regexp_extract_all(F.lower(text), F.lit("#([a-z0-9_]+)"), F.lit(1))), _named("quote:", F.filter(quoted, lambda q: q != ""))]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def details(text: Column) -> Column:
    return F.array_sort(F.filter(T.tokens(text), lambda w: (F.char_length(w) >= 3) & ~w.isin(*FUNCTION_WORDS)))


def names(text: Column) -> Column:
    """Capitalised words that do not begin the text."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"\s([A-Z][A-Za-z]+)"), F.lit(1)))


def rewrite_verdict(certified: Column, candidate: Column, growth: float = 2.0) -> Column:
    """Why a rewrite may not be shown, or that it may: first emptiness and growth, then numbers, polarity, names and details, in that order."""
    size = F.octet_length(candidate)
    return (
        F.when((F.trim(certified) == "") | (F.trim(candidate) == ""), "empty_text")
        .when(size > F.least(F.lit(24576), F.greatest(F.lit(512), (F.octet_length(certified) * growth).cast("int"))), "rewrite_expanded")
        .when(numbers(certified) != numbers(candidate), "numeric_literals_changed")
        .when(negations(certified) != negations(candidate), "polarity_changed")
        .when(names(certified) != names(candidate), "named_literals_changed")
        .when(details(certified) != details(candidate), "protected_details_changed")
        .otherwise("protected_literals_preserved")
    )


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of the first `h:mm am` or `pm`; null where there is none."""
    pattern = r"(?i)\b(1[0-2]|0?[1-9]):([0-5][0-9]) ?([ap])m\b"
    hour = F.regexp_extract(text, pattern, 1).try_cast("int") % 12
    return hour * 60 + F.regexp_extract(text, pattern, 2).try_cast("int") + F.when(F.lower(F.regexp_extract(text, pattern, 3)) == "p", 720).otherwise(0)


def months_before(day: Column, months: Column) -> Column:
    """The day so many months before, the month's last day where it is too short."""
    return F.add_months(day, -months)


def observed_weight(event_time: Column, target: float, scale: float, path: Column, ideal: float, path_scale: float, cost: Column, phase: Column) -> Column:
    """An event's weight for an observer: a Gaussian of its distance in time and path, less for costly transport, by the cosine of its phase."""
    t, p = (event_time - target) / scale, (path - ideal) / path_scale
    return F.exp(-(t * t + p * p)) / (1 + cost) * F.cos(phase)


def canonical_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with its keys in order, nulls written out and no spaces."""
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"}), 256)
