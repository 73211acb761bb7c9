"""Answers over dated observations: replays, choices, intervals, consecutive days, frequencies and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_set(transitions: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """transitions: by, entity, action (add or remove). Counts entities whose last action adds."""
    last = transitions.groupBy(*by, "entity").agg(F.max_by("action", F.struct(*order, "action")).alias("action"))
    return last.groupBy(*by).agg(F.count_if(F.col("action") == "add").alias("active"), F.count("*").alias("entities"))


def choice(observations: DataFrame, by: list[str], earliest: bool) -> DataFrame:
    """observations: by, choice, event_time, fact_id. The choice with the earliest (or latest) witness; a tie abstains."""
    pick = F.min if earliest else F.max
    first = observations.groupBy(*by, "choice").agg(pick(F.struct("event_time", "fact_id")).alias("w"))
    best = first.groupBy(*by).agg(pick("w.event_time").alias("t"))
    at_best = first.join(best, by).filter(F.col("w.event_time") == F.col("t"))
    found = at_best.groupBy(*by).agg(F.count("*").alias("n"), F.min("choice").alias("choice"), F.min_by("w.fact_id", "choice").alias("fact_id"))
    tie = F.col("n") > 1
    return found.select(*by, F.when(tie, "abstain").otherwise("resolved").alias("state"), F.when(~tie, F.col("choice")).alias("value"), F.when(tie, "tied_choice_clock").otherwise("unique_choice_clock").alias("reason"), F.when(~tie, F.col("fact_id")).alias("fact_id"))


def consecutive_pairs(days: DataFrame, by: list[str]) -> DataFrame:
    """days: by, day. The only pair of neighbouring days, else nothing is resolved."""
    unique = days.select(*by, "day").distinct()
    pairs = unique.withColumn("next", F.lead("day").over(Window.partitionBy(*by).orderBy("day")))
    found = pairs.groupBy(*by).agg(F.count_if(F.col("next") - F.col("day") == 1).alias("pairs"), F.min(F.when(F.col("next") - F.col("day") == 1, F.col("day"))).alias("day"))
    state = F.when(F.col("pairs") == 1, "resolved").when(F.col("pairs") == 0, "abstain").otherwise("contested")
    return found.select(*by, state.alias("state"), F.when(F.col("pairs") == 1, F.col("day")).alias("day"), "pairs")


def weighted_frequency(mentions: DataFrame, by: list[str]) -> DataFrame:
    """mentions: by, label, weight. The label with the greatest total; equal totals at the top abstain."""
    totals = mentions.groupBy(*by, "label").agg(F.sum("weight").alias("total"))
    found = totals.groupBy(*by).agg(F.max(F.struct("total", "label")).alias("hi"), F.slice(F.sort_array(F.collect_list("total"), asc=False), 1, 2).alias("two"))
    tie = (F.size("two") > 1) & (F.get("two", F.lit(0)) == F.get("two", F.lit(1)))
    return found.select(*by, F.when(tie, "abstain").otherwise("resolved").alias("state"), F.when(~tie, F.col("hi.label")).alias("value"), F.col("hi.total").alias("total"), F.when(tie, "tied_frequency_fiber").otherwise("unique_frequency_maximum").alias("reason"))


def chronology(observations: DataFrame, by: list[str], required: int, latest: bool = False) -> DataFrame:
    """observations: by, label, event_time. Labels in the order of their first (or last) time, where all `required` are there."""
    pick = F.max if latest else F.min
    first = observations.groupBy(*by, "label").agg(pick("event_time").alias("t"))
    found = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "label"))), lambda x: x["label"]), " > ").alias("order"), F.count("*").alias("n"), F.count_distinct("t").alias("times"))
    state = F.when(F.col("n") < required, "abstain").when(F.col("times") < F.col("n"), "contested").otherwise("resolved")
    return found.select(*by, state.alias("state"), F.when((F.col("n") >= required) & (F.col("times") == F.col("n")), F.col("order")).alias("value"))


def latest_scalar(observations: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last explicit value; its witnesses are all observations."""
    found = observations.groupBy(*by).agg(F.max_by("value", F.struct(*order)).alias("value"), F.count("*").alias("witnesses"))
    return found.select(*by, F.lit("resolved").alias("state"), "value", "witnesses")


def elapsed(then: Column, now: Column, unit: str) -> Column:
    """Whole days, weeks (two days over at most) or months (borrowing by day of month); else null."""
    days = F.date_diff(now, then)
    if unit == "day":
        return days
    if unit == "week":
        return F.when(days % 7 <= 2, F.floor(days / 7).cast("int"))
    months = (F.year(now) - F.year(then)) * 12 + F.month(now) - F.month(then) - F.when(F.day(now) < F.day(then), 1).otherwise(0)
    return F.when(days >= 0, months.cast("int"))


def monotone_count(reports: DataFrame, by: list[str], order: str) -> DataFrame:
    """reports: by, value. The last of cumulative counts; one that falls contests the series."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy(order))
    found = reports.withColumn("fell", F.col("value") < before).groupBy(*by).agg(F.coalesce(F.max("fell"), F.lit(False)).alias("fell"), F.max_by("value", order).alias("last"))
    return found.select(*by, F.when(F.col("fell"), "contested").otherwise("resolved").alias("state"), F.when(~F.col("fell"), F.col("last")).alias("value"))


def temporal_gauge(observations: DataFrame, by: list[str], origin: Column, past: bool) -> DataFrame:
    """observations: by, label, event_time. The observation nearest to an origin on one side of it."""
    gap = (origin - F.col("event_time")) if past else (F.col("event_time") - origin)
    near = observations.withColumn("gap", gap).filter("gap >= 0")
    return near.groupBy(*by).agg(F.min(F.struct("gap", "fact_id", "label")).alias("n")).select(*by, "n.gap", "n.label", "n.fact_id")
