"""Programs over role-labelled event records, one fiber (scope, predicate) or one group of it at a time.

Absence and aggregates are only as good as the claim that a fiber is complete: they need a certificate of the fiber's current
generation. All aggregates combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.outcome import ladder, no_ids, plain

FIBER = ["scope", "predicate"]
SCALARS = ("event_id", "predicate", "event_time", "report_time", "version", "polarity", "modality")
#: Exact calendar units in days.
UNIT_DAYS = {"day": 1, "days": 1, "week": 7, "weeks": 7}


def constrained(records: DataFrame, constraints: dict[str, str]) -> DataFrame:
    """Equality on role:<name>, polarity, modality or event_id; an unknown field matches nothing."""
    out = records
    for field, value in sorted(constraints.items()):
        if field.startswith("role:"):
            out = out.filter(F.col("roles")[field.removeprefix("role:")] == value)
        elif field in ("polarity", "modality", "event_id"):
            out = out.filter(F.col(field) == value)
        else:
            out = out.filter(F.lit(False))
    return out


def project(field: str) -> Column:
    """role:<name>, quantity:<kind> or a scalar field as a string; anything else is null."""
    if field.startswith("role:"):
        return F.col("roles")[field.removeprefix("role:")]
    if field.startswith("quantity:"):
        return quantity(field.removeprefix("quantity:"))["value"].cast("string")
    return F.col(field).cast("string") if field in SCALARS else F.lit(None).cast("string")


def quantity(kind: str) -> Column:
    """The first quantity of a kind."""
    return F.get(F.filter("quantities", lambda q: q["kind"] == kind), F.lit(0))


def certify(records: DataFrame, by: list[str] = FIBER) -> DataFrame:
    """(by, generation, event_count, event_ids_sha256): the fiber's ids in order, joined by the unit separator, digested.

    The digest runs over every id of a fiber in order, so the ids meet in one row of the result: this is the one
    aggregate here that a fiber's size bounds.
    """
    ids = F.array_sort(F.collect_list("event_id"))
    return records.groupBy(*by).agg(F.count("*").alias("generation"), F.count("*").alias("event_count"), F.sha2(F.array_join(ids, "\x1f"), 256).alias("event_ids_sha256"))


def _with_certificate(found: DataFrame, certificates: DataFrame | None, by: list[str], generation: DataFrame) -> DataFrame:
    """Adds `certified`: a certificate of the current generation exists."""
    if certificates is None:
        return found.withColumn("certified", F.lit(False))
    current = generation.groupBy(*by).agg(F.count("*").alias("_now"))
    valid = certificates.join(current, by).filter(F.col("generation") == F.col("_now")).select(*by, F.lit(True).alias("_ok"))
    return found.join(valid, by, "left").withColumn("certified", F.coalesce(F.col("_ok"), F.lit(False)))


def _ids() -> Column:
    return F.array_sort(F.collect_list("fact_id"))


MISSING = "missing_completeness_certificate"


def count_distinct(records: DataFrame, certificates: DataFrame | None, constraints: dict[str, str] | None = None, field: str = "event_id", by: list[str] = FIBER) -> DataFrame:
    rows = constrained(records, constraints or {}).withColumn("key", project(field))
    found = rows.groupBy(*by).agg(F.count_distinct("key").alias("n"), F.count_if(F.col("key").isNull()).alias("gaps"), _ids().alias("ids"))
    found = _with_certificate(found, certificates, by, records)
    return ladder(found, by, [(~F.col("certified"), "abstain", MISSING), (F.col("gaps") > 0, "abstain", "missing_distinct_key")], F.col("n"), F.lit("count"), F.col("ids"), "closed_fiber_count")


def total(records: DataFrame, certificates: DataFrame | None, kind: str, unit: str, constraints: dict[str, str] | None = None, by: list[str] = FIBER) -> DataFrame:
    """Exact sum of one kind of quantity; days and weeks convert into each other, other units only match themselves."""
    rows = constrained(records, constraints or {}).withColumn("q", quantity(kind))
    days = F.create_map(*[x for u, d in UNIT_DAYS.items() for x in (F.lit(u), F.lit(d))])
    factor = F.when(F.col("q.unit") == unit, F.lit(1).cast("decimal(10,0)"))
    if unit in UNIT_DAYS:
        factor = F.coalesce(factor, F.try_element_at(days, F.col("q.unit")).cast("decimal(10,0)"))
        same = F.col("q.unit") == unit
        number = F.when(same, F.col("q.value")).otherwise((F.col("q.value") * factor / F.lit(UNIT_DAYS[unit])).cast("decimal(38,6)"))
    else:
        number = F.when(factor.isNotNull(), F.col("q.value"))
    found = rows.withColumn("number", number).groupBy(*by).agg(F.sum("number").alias("sum"), F.count_if(F.col("number").isNull()).alias("gaps"), _ids().alias("ids"))
    found = _with_certificate(found, certificates, by, records)
    return ladder(found, by, [(~F.col("certified"), "abstain", MISSING), (F.col("gaps") > 0, "abstain", "missing_or_inconvertible_quantity")], plain(F.col("sum")), F.lit(unit), F.col("ids"), "closed_fiber_exact_sum")


def extreme(records: DataFrame, certificates: DataFrame | None, field: str, greatest: bool, clock: str = "event_time", constraints: dict[str, str] | None = None, by: list[str] = FIBER) -> DataFrame:
    """The record with the greatest or least clock; ties go to the greatest or least event_id. Its field is the value."""
    pick = F.max if greatest else F.min
    rows = constrained(records, constraints or {})
    best = pick(F.struct(clock, "event_id", "fact_id", project(field).alias("shown"))).alias("best")
    found = rows.filter(F.col(clock).isNotNull()).groupBy(*by).agg(best)
    gaps = rows.groupBy(*by).agg(F.count_if(F.col(clock).isNull()).alias("gaps"))
    found = _with_certificate(gaps.join(found, by, "left"), certificates, by, records)
    cases = [(~F.col("certified"), "abstain", MISSING), ((F.col("gaps") > 0) | F.col("best").isNull(), "abstain", "missing_event_clock"), (F.col("best.shown").isNull(), "unsupported", "unknown_projection")]
    return ladder(found, by, cases, F.col("best.shown"), F.lit(""), F.array("best.fact_id"), "unique_clock_extreme")


def only(records: DataFrame, field: str, constraints: dict[str, str] | None = None, by: list[str] = FIBER) -> DataFrame:
    """The field of a group's only record."""
    rows = constrained(records, constraints or {})
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("event_id", "fact_id", project(field).alias("shown"))).alias("one"))
    cases = [(F.col("n") > 1, "abstain", "ambiguous_event"), (F.col("one.shown").isNull(), "unsupported", "unknown_projection")]
    return ladder(found, by, cases, F.col("one.shown"), F.lit(""), F.array("one.fact_id"), "unique_event_projection")


def exists(records: DataFrame, asked: DataFrame, certificates: DataFrame | None, constraints: dict[str, str] | None = None, by: list[str] = FIBER) -> DataFrame:
    """For every asked key: true with a witness, false only where the fiber is certified complete."""
    rows = constrained(records, constraints or {}).groupBy(*by).agg(_ids().alias("ids"))
    fiber = [c for c in FIBER if c in by] or by
    found = _with_certificate(asked.join(rows, by, "left"), certificates, fiber, records)
    seen = F.col("ids").isNotNull()
    out = ladder(found.withColumn("seen", seen), by, [(~F.col("seen") & ~F.col("certified"), "abstain", "missing_negative_completeness_certificate")], F.col("seen").cast("string"), F.lit(""), F.coalesce("ids", no_ids()), "positive_witness_exists")
    return out.withColumn("reason", F.when(F.col("value") == "false", "closed_fiber_absence").otherwise(F.col("reason")))


def difference(records: DataFrame, left: dict[str, str], right: dict[str, str], unit: str, by: list[str], clock: str = "event_time") -> DataFrame:
    """Signed clock difference right - left of two unique records of a group, in days or weeks."""
    sides = []
    for name, constraints in (("l", left), ("r", right)):
        sides.append(constrained(records, constraints).groupBy(*by).agg(F.count("*").alias(f"{name}_n"), F.min(F.struct("event_id", clock, "fact_id")).alias(name)))
    found = sides[0].join(sides[1], by, "full")
    reason = F.concat_ws(":", *[F.when(F.coalesce(F.col(f"{s}_n"), F.lit(0)) == 0, "missing_unique_event").when(F.col(f"{s}_n") > 1, "ambiguous_event").otherwise("unique_event") for s in ("l", "r")])
    bad = (F.coalesce(F.col("l_n"), F.lit(0)) != 1) | (F.coalesce(F.col("r_n"), F.lit(0)) != 1)
    exact = F.col(f"l.{clock}").isNull() | F.col(f"r.{clock}").isNull() | F.lit(unit not in UNIT_DAYS)
    number = ((F.col(f"r.{clock}") - F.col(f"l.{clock}")).cast("decimal(20,6)") / UNIT_DAYS.get(unit, 1)).cast("decimal(20,6)")
    out = ladder(found.withColumn("pair_reason", reason), [*by, "pair_reason"], [(bad, "abstain", "pair"), (exact, "abstain", "missing_or_inexact_clock")], plain(number), F.lit(unit), F.array("l.fact_id", "r.fact_id"), "exact_clock_difference")
    return out.withColumn("reason", F.when(F.col("reason") == "pair", F.col("pair_reason")).otherwise(F.col("reason"))).drop("pair_reason")
