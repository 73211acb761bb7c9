"""Answers that passages spell out: membership, spans of years, listed and classed amounts, tenures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.outcome import plain
from attestra.functions.units import number
from attestra.operators.graphs import materialize
from attestra.operators.retrieval import similar_pairs


def absent(docs: DataFrame, identifiers: DataFrame) -> DataFrame:
    """identifiers: identifier. Which no text of the corpus holds as a token: one scan for all of them."""
    words = docs.select(F.explode(T.tokens(F.col("text"))).alias("identifier")).join(identifiers, "identifier", "left_semi").distinct()
    return identifiers.join(words.withColumn("_seen", F.lit(True)), "identifier", "left").select("identifier", F.col("_seen").isNull().alias("absent"))


def year_interval(docs: DataFrame, by: list[str], start_terms: tuple[str, ...], end_terms: tuple[str, ...]) -> DataFrame:
    """Years from the only year of sentences with a start term to the only one of those with an end term; an end before its start is contested."""
    rows = docs.select(*by, F.explode(T.sentences(F.col("text"))).alias("said"))
    words = T.tokens(F.col("said"))
    years = rows.select(*by, T.has_any(words, start_terms).alias("start"), T.has_any(words, end_terms).alias("end"), F.explode(F.regexp_extract_all("said", F.lit(r"\b(1[89][0-9]{2}|20[0-9]{2})\b"), F.lit(1))).alias("year"))
    years = years.withColumn("year", F.col("year").cast("int"))
    found = years.groupBy(*by).agg(*[part for s in ("start", "end") for part in (F.count_distinct(F.when(F.col(s), F.col("year"))).alias(f"n_{s}"), F.min(F.when(F.col(s), F.col("year"))).alias(f"y_{s}"))])
    state = F.when((F.col("n_start") != 1) | (F.col("n_end") != 1), "abstain").when(F.col("y_end") < F.col("y_start"), "contested").otherwise("resolved")
    return found.select(*by, state.alias("state"), F.when(state == "resolved", (F.col("y_end") - F.col("y_start")).cast("string")).alias("value"))


def coordinated_count(lists: DataFrame, by: list[str], said: str) -> DataFrame:
    """Sum of the leading counts of a list's members (`two cats, a dog and three birds`); a member without a count abstains, and the same
    list told twice counts once."""
    members = F.filter(F.transform(F.split(F.lower(said), r",\s*|\s+and\s+"), lambda m: F.trim(m)), lambda m: m != "")
    counted = F.transform(members, lambda m: F.when(F.split(m, " ")[0].isin("a", "an", "my", "one"), F.lit(1).cast("decimal(28,6)")).otherwise(number(F.split(m, " ")[0])))
    rows = lists.select(*by, members.alias("m"), counted.alias("n")).distinct()
    found = rows.groupBy(*by).agg(F.max(F.exists("n", lambda x: x.isNull())).alias("odd"), F.sum(F.aggregate("n", F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("decimal(38,6)"))).alias("sum"))
    return found.select(*by, F.when(F.col("odd"), "abstain").otherwise("resolved").alias("state"), F.when(~F.col("odd"), plain(F.col("sum"))).alias("value"))


def classed_sum(atoms: DataFrame, by: list[str], terms: list[str]) -> DataFrame:
    """Sum of the money of sentences that hold all class terms; two currencies contest it. Equal sentences of one group count once."""
    words = T.tokens(F.col("said"))
    rows = atoms.filter(F.col("dimension").startswith("currency") & (F.size(F.array_except(F.array(*[F.lit(t) for t in terms]), words)) == 0) & ~F.col("hedged") & ~F.col("question"))
    once = rows.select(*by, "said", "position", "unit", "value").distinct()
    found = once.groupBy(*by).agg(F.count_distinct("unit").alias("kinds"), F.min("unit").alias("unit"), F.sum("value").alias("sum"), F.count("*").alias("atoms"))
    one = F.col("kinds") == 1
    return found.select(*by, F.when(one, "resolved").otherwise("contested").alias("state"), F.when(one, plain(F.col("sum"))).alias("value"), F.when(one, F.col("unit")).otherwise("").alias("unit"), "atoms")


def tenure(total_months: Column, prior_months: Column) -> Column:
    """What is left of a total after a prior span, as years and months; null where it is negative."""
    left = total_months - prior_months
    return F.when(left >= 0, F.concat(F.floor(left / 12).cast("string"), F.lit(" years "), (left % 12).cast("int").cast("string"), F.lit(" months")))


def share_of(rate_percent: Column, amount: Column) -> Column:
    return (rate_percent.cast("decimal(18,4)") * amount.cast("decimal(18,4)") / 100).cast("decimal(28,6)")


def ledger_count(events: DataFrame, by: list[str], key: str, unresolved: DataFrame | None = None) -> DataFrame:
    """Distinct event keys of a group; a group with an unresolved report abstains."""
    found = events.groupBy(*by).agg(F.count_distinct(key).alias("n"))
    if unresolved is None:
        return found.select(*by, F.lit("resolved").alias("state"), F.col("n").cast("string").alias("value"))
    joined = found.join(unresolved.select(*by).distinct().withColumn("_open", F.lit(True)), by, "left")
    open_ = F.coalesce(F.col("_open"), F.lit(False))
    return joined.select(*by, F.when(open_, "abstain").otherwise("resolved").alias("state"), F.when(~open_, F.col("n").cast("string")).alias("value"))


def ledger_sum(measures: DataFrame, by: list[str], key: str, value: str, near: float = 0.6) -> DataFrame:
    """measures: by, key, value, said. Sum of each key's first measure; two keys of equal value whose texts are near copies make it abstain. The
    pairs that are compared share their group, their value and a rare word; the first measures, which are read four times, are written."""
    first = measures.groupBy(*by, key).agg(F.min(F.struct("said", value)).alias("f")).select(*by, key, F.col("f.said").alias("said"), F.col(f"f.{value}").alias(value))
    first = materialize(first, "first")
    words = F.array_distinct(T.tokens(F.col("said")))
    twins = similar_pairs(first.select(*by, value, key, words.alias("_words")), [*by, value], key, "_words", near).select(*by).distinct().withColumn("_twin", F.lit(True))
    found = first.groupBy(*by).agg(F.sum(F.col(value).cast("decimal(28,6)")).alias("sum"), F.count("*").alias("events")).join(twins, by, "left")
    twin = F.coalesce(F.col("_twin"), F.lit(False))
    return found.select(*by, F.when(twin, "abstain").otherwise("resolved").alias("state"), F.when(~twin, plain(F.col("sum"))).alias("value"), "events")
