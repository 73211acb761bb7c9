"""Measurements written in text: atoms with units, and the sums, differences, averages and products that they settle.

Atoms come out of one scan by a pattern without look-around. What is dropped (questions, hedges, other roles) is
flagged, not lost, so an aggregate can say that it is not executable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.outcome import plain
from attestra.functions.units import number, singular, unit_table

PATTERN = r"(?:[0-9][0-9,]*(?:\.[0-9]+)?|\$[0-9][0-9,]*(?:\.[0-9]+)?) ?(?:[A-Za-z]+)?"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "


def atoms(docs: DataFrame, keep: list[str] | None = None, dimension: str | None = None) -> DataFrame:
    """(fact_id, keep, sentence, position, value, unit, dimension, base_value, hedged, negative, question) of every number with a known unit,
    or with one of a dimension.

    Outer explodes, since inner ones are planned with a filter that runs the patterns once more. A match is cut into amount and unit without
    a pattern, and amounts are read only where the unit is wanted.
    """
    units = unit_table(docs.sparkSession)
    if dimension is not None:
        units = units.filter(F.col("dimension") == dimension)
    rows = docs.select("fact_id", *(keep or []), F.posexplode_outer(T.sentences(F.col("text"))).alias("sentence", "said"))
    numeric = F.col("said").rlike("[0-9]")
    words = T.tokens(F.when(numeric, F.col("said")))
    flagged = rows.select("*", T.has_any(words, T.HEDGES).alias("hedged"), T.has_any(words, T.NEGATIONS).alias("negative"), F.col("said").endswith("?").alias("question"), F.when(numeric, F.regexp_extract_all("said", F.lit(PATTERN), F.lit(0))).alias("matches"))
    found = flagged.select("*", F.posexplode_outer("matches").alias("position", "match")).drop("matches")
    amount = F.translate("match", LETTERS, "")
    cut = found.filter("match IS NOT NULL").withColumn("amount", amount).withColumn("_unit", F.lower(F.ltrim(F.substr("match", F.char_length("amount") + 1))))
    named = cut.withColumn("unit", F.when(F.col("amount").startswith("$"), F.lit("USD")).otherwise(singular(F.col("_unit")))).drop("_unit")
    known = named.join(F.broadcast(units), "unit")
    known = known.withColumn("value", number(F.ltrim("amount", F.lit("$"))))
    return known.withColumn("base_value", (F.col("value") * F.col("factor")).cast("decimal(38,8)")).drop("factor", "match", "amount")


def convert(rows: DataFrame, target: str) -> DataFrame:
    """Atoms of the target's dimension with `converted`."""
    one = unit_table(rows.sparkSession).filter(F.col("unit") == target).select(F.col("dimension"), F.col("factor").alias("target_factor"))
    return rows.join(F.broadcast(one), "dimension").withColumn("converted", (F.col("base_value") / F.col("target_factor")).cast("decimal(28,6)"))


def collapse(rows: DataFrame, by: list[str], near: list[str]) -> DataFrame:
    """One atom of each (by, near) identity, the first by id and place: repeated reports of one thing count once."""
    first = rows.groupBy(*by, *near).agg(F.min(F.struct("fact_id", "sentence", "position", "converted")).alias("f"))
    return first.select(*by, *near, "f.*")


def settle_sum(rows: DataFrame, by: list[str], unit: str) -> DataFrame:
    """Sum of converted atoms; hedged ones make it abstain, none at all make it unsupported."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("hedged").alias("unsure"), F.sum(F.when(~F.col("hedged") & ~F.col("negative") & ~F.col("question"), F.col("converted"))).alias("sum"), F.count_if(~F.col("hedged") & ~F.col("negative") & ~F.col("question")).alias("used"))
    state = F.when(F.col("unsure") > 0, "abstain").when(F.col("used") == 0, "unsupported").otherwise("resolved")
    return found.select(*by, state.alias("state"), F.when(state == "resolved", plain(F.col("sum"))).alias("value"), F.lit(unit).alias("unit"), "used")


def slice_certificate(rows: DataFrame, by: list[str], unit: str, required: list[str]) -> DataFrame:
    """How many atoms of a scope a numeric question uses, and why the others do not count."""
    words = T.tokens(F.col("said"))
    has = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), words)) == 0 if required else F.lit(True)
    unit_ok = F.col("unit") == unit
    open_ = ~F.col("hedged") & ~F.col("negative") & ~F.col("question")
    return rows.groupBy(*by).agg(
        F.count("*").alias("scope_atoms"), F.count_if(unit_ok & has & open_).alias("eligible"), F.count_if(~unit_ok).alias("other_unit"), F.count_if(unit_ok & ~has).alias("other_terms"), F.count_if(unit_ok & has & ~open_).alias("uncertain")
    )


def convergent_sum(rows: DataFrame, terms: list[str], by: list[str]) -> DataFrame:
    """Sums over the atoms that share at least 1, 2, ... terms; all thresholds must agree on value and witnesses (compared by their number and
    the sum of their digests, so that no list of them is gathered)."""
    asked = F.array(*[F.lit(t) for t in terms])
    scored = rows.withColumn("overlap", F.size(F.array_intersect(T.tokens(F.col("said")), asked))).filter("overlap > 0")
    worlds = scored.withColumn("threshold", F.explode(F.sequence(F.lit(1), F.lit(len(terms))))).filter("overlap >= threshold")
    each = worlds.groupBy(*by, "threshold").agg(F.sum("converted").alias("sum"), F.struct(F.count("*"), F.sum(F.xxhash64("fact_id", "sentence", "position").cast("decimal(38,0)"))).alias("ids"))
    found = each.groupBy(*by).agg(F.count_distinct(F.struct("sum", "ids")).alias("worlds"), F.max_by("sum", -F.col("threshold")).alias("sum"))
    return found.select(*by, F.when(F.col("worlds") == 1, "resolved").otherwise("contested").alias("state"), F.when(F.col("worlds") == 1, plain(F.col("sum"))).alias("value"), "worlds")


def product_sum(lines: DataFrame, by: list[str], count: Column, price: Column) -> DataFrame:
    """Exact sum of count times unit price."""
    return lines.groupBy(*by).agg(F.sum((count.cast("decimal(18,2)") * price.cast("decimal(18,2)")).cast("decimal(38,4)")).alias("total"), F.count("*").alias("lines"))


def average_closed(rows: DataFrame, by: list[str], role: str, required: list[str], value: str) -> DataFrame:
    """The mean over a closed set of roles, each of which must be there exactly once."""
    in_set = rows.filter(F.col(role).isin(*required))
    found = in_set.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(role).alias("kinds"), F.sum(F.col(value).cast("decimal(28,6)")).alias("sum"))
    ok = (F.col("n") == len(required)) & (F.col("kinds") == len(required))
    return found.select(*by, F.when(ok, "resolved").otherwise("abstain").alias("state"), F.when(ok, F.round((F.col("sum") / len(required)).cast("double"), 6).cast("string")).alias("value"), F.when(ok, "closed_role_mean").otherwise("role_not_unique").alias("reason"))


def margin(rows: DataFrame, by: list[str], side: str, left: str, right: str, value: str) -> DataFrame:
    """left - right, each side present once and no negative margin."""
    found = rows.groupBy(*by).agg(*[part for s in (left, right) for part in (F.count_if(F.col(side) == s).alias(f"n_{s}"), F.sum(F.when(F.col(side) == s, F.col(value).cast("decimal(28,6)"))).alias(f"v_{s}"))])
    gap = F.col(f"v_{left}") - F.col(f"v_{right}")
    state = F.when((F.col(f"n_{left}") != 1) | (F.col(f"n_{right}") != 1), "abstain").when(gap < 0, "contested").otherwise("resolved")
    return found.select(*by, state.alias("state"), F.when(state == "resolved", plain(gap)).alias("value"))


def closed_score(records: DataFrame, by: list[str], value: str, made: Column) -> DataFrame:
    """made, missed, attempts, sum, longest and average of a record set; `agrees` where reports of one record agree."""
    return records.groupBy(*by).agg(
        F.count_if(made).alias("made"), F.count_if(~made).alias("missed"), F.count("*").alias("attempts"), F.sum(F.when(made, F.col(value)).otherwise(0)).alias("sum"), F.max(F.when(made, F.col(value))).alias("longest"), F.round(F.avg(F.when(made, F.col(value))), 6).alias("average")
    )


def complement(parts: DataFrame, by: list[str], share: str) -> DataFrame:
    """What is left to one hundred per cent after the listed parts; over a hundred is contested."""
    found = parts.groupBy(*by).agg(F.sum(F.col(share).cast("decimal(18,4)")).alias("sum"))
    over = F.col("sum") > 100
    return found.select(*by, F.when(over, "contested").otherwise("resolved").alias("state"), F.when(~over, plain((F.lit(100) - F.col("sum")).cast("decimal(18,4)"))).alias("value"))


def converge(answers: DataFrame, by: list[str]) -> DataFrame:
    """answers: by, operator, state, value, unit. A contested operator contests all; resolved ones must agree."""
    signature = F.struct(F.lower(F.trim("value")).alias("v"), F.coalesce("unit", F.lit("")).alias("u"))
    on = F.col("state") == "resolved"
    found = answers.groupBy(*by).agg(F.count_if(F.col("state") == "contested").alias("bad"), F.count_distinct(F.when(on, signature)).alias("kinds"), F.min(F.when(on, signature)).alias("one"), F.count_if(on).alias("agree"))
    state = F.when((F.col("bad") > 0) | (F.col("kinds") > 1), "contested").when(F.col("kinds") == 0, "abstain").otherwise("resolved")
    return found.select(*by, state.alias("state"), F.when(state == "resolved", F.col("one.v")).alias("value"), "agree")
