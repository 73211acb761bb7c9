"""Typed programs over versioned facts, for every fiber at once.

A fiber is one (scope, subject, predicate). Reports of one thing share an orbit; the latest report of an orbit stands for it. Two clocks
differ on purpose: states compare (version, event_time, observed_at), orbits (version, observed_at). Ties are part of the
meaning, so the latest rows are found by one aggregation with map-side combine that keeps the greatest and least digest of
what they say: no window holds a fiber's rows, and no fiber meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.outcome import ladder, plain

FIBER = ["scope", "subject", "predicate"]
ORBIT_CLOCK = ["version", "observed_at"]
STATE_CLOCK = ["version", "event_time", "observed_at"]


def orbit() -> Column:
    return F.coalesce(F.when(F.col("event_id") != "", F.col("event_id")), F.concat(F.lit("fact:"), F.col("fact_id").cast("string")))


def as_of(facts: DataFrame, at_time: int | None) -> DataFrame:
    """Facts observed by then; all of them without a time."""
    return facts if at_time is None else facts.filter(F.col("observed_at") <= at_time)


def _digest(columns: list[str]) -> Column:
    """64 bits of some columns, nulls told apart from values."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def latest(facts: DataFrame, by: list[str], clock: list[str], signature: list[str], carry: list[str]) -> DataFrame:
    """(by, first, clash, orbits_differ): of the rows with the greatest clock, the first by id, and whether they disagree.

    Rows agree when the greatest and the least digest among those of the greatest clock are one; the least is found as the
    greatest complement, so one aggregation with map-side combine does it all.
    """
    rows = facts.select("*", _digest(signature).alias("_s"), _digest(["orbit"]).alias("_o"))
    top = lambda *more: F.max(F.struct(*clock, *more))
    found = rows.groupBy(*by).agg(
        top((-F.col("fact_id")).alias("back"), *carry).alias("first"),
        top(F.col("_s").alias("x")).alias("s1"),
        top(F.bitwise_not("_s").alias("x")).alias("s2"),
        top(F.col("_o").alias("x")).alias("o1"),
        top(F.bitwise_not("_o").alias("x")).alias("o2"),
    )
    return found.select(
        *by,
        F.struct((-F.col("first.back")).alias("fact_id"), *[F.col(f"first.{c}") for c in carry]).alias("first"),
        (F.col("s1.x") != F.bitwise_not("s2.x")).alias("clash"),
        (F.col("o1.x") != F.bitwise_not("o2.x")).alias("orbits_differ"),
    )


def collapse_orbits(facts: DataFrame, by: list[str] = FIBER, at_time: int | None = None) -> DataFrame:
    """The latest report of every orbit, with `conflict` where its latest reports disagree."""
    rows = as_of(facts, at_time).withColumn("orbit", orbit())
    carry = ["value", "unit", "polarity", "asserted", "event_time", "causes"]
    found = latest(rows, [*by, "orbit"], ORBIT_CLOCK, carry, [c for c in carry if c not in ORBIT_CLOCK])
    return found.select(*by, "orbit", "first.*", F.col("clash").alias("conflict"))


def lookup(facts: DataFrame, by: list[str] = FIBER, at_time: int | None = None) -> DataFrame:
    """Each fiber's latest state; ties that disagree, uncertain and negative states abstain."""
    rows = as_of(facts, at_time).withColumn("orbit", orbit())
    said = ["value", "unit", "polarity", "asserted"]
    found = latest(rows, by, STATE_CLOCK, said, said)
    return ladder(
        found,
        by,
        [
            (F.col("clash") & ~F.col("orbits_differ"), "abstain", "conflicting_latest_orbit"),
            (F.col("clash"), "abstain", "contested_latest_state"),
            (~F.col("first.asserted"), "abstain", "uncertain_fact"),
            (F.col("first.polarity") < 0, "abstain", "latest_state_is_negative"),
        ],
        F.col("first.value"),
        F.col("first.unit"),
        F.array("first.fact_id"),
        "unique_latest_state",
    )


def _selected(facts: DataFrame, by: list[str], at_time: int | None, value: str | None) -> DataFrame:
    """Orbits with `chosen`: the value filter comes after the collapse, so a state that has changed is not taken for current."""
    rows = collapse_orbits(facts, by, at_time)
    return rows.withColumn("chosen", F.lit(True) if value is None else F.col("value") == value)


def _gates(extra: list[tuple[Column, str, str]]) -> list[tuple[Column, str, str]]:
    return [(F.col("any_conflict"), "abstain", "conflicting_latest_orbit"), (F.col("n") == 0, "abstain", "no_matching_fact"), (F.col("any_unsure"), "abstain", "uncertain_fact"), *extra]


def _flags() -> list[Column]:
    return [F.max("conflict").alias("any_conflict"), F.count_if("chosen").alias("n"), F.coalesce(F.max(F.col("chosen") & ~F.col("asserted")), F.lit(False)).alias("any_unsure")]


ACTIVE = "chosen and polarity > 0"


def _active_ids() -> Column:
    return F.array_sort(F.collect_list(F.when(F.expr(ACTIVE), F.col("fact_id"))))


def count_distinct(facts: DataFrame, by: list[str] = FIBER, at_time: int | None = None, value: str | None = None, closed_world: bool = False) -> DataFrame:
    """Distinct values of a fiber's positive orbits; only a closed world can be counted."""
    rows = _selected(facts, by, at_time, value)
    found = rows.groupBy(*by).agg(*_flags(), F.count_distinct(F.when(F.expr(ACTIVE), F.col("value"))).alias("kinds"), _active_ids().alias("ids"))
    return ladder(found, by, _gates([(F.lit(not closed_world), "unsupported", "closed_world_required")]), F.col("kinds"), F.lit("count"), F.col("ids"), "closed_world_distinct_count")


def total(facts: DataFrame, unit: str, by: list[str] = FIBER, at_time: int | None = None, value: str | None = None, closed_world: bool = False) -> DataFrame:
    """Exact sum of a fiber's positive orbits, all in the asked unit."""
    rows = _selected(facts, by, at_time, value).withColumn("number", F.col("value").try_cast("decimal(28,6)"))
    on = F.expr(ACTIVE)
    found = rows.groupBy(*by).agg(
        *_flags(),
        F.count_if(on).alias("m"),
        F.count_if(on & (F.col("unit") != unit)).alias("foreign"),
        F.count_if(on & F.col("number").isNull()).alias("odd"),
        F.sum(F.when(on, F.col("number"))).alias("sum"),
        _active_ids().alias("ids"),
    )
    cases = [
        (F.lit(not closed_world), "unsupported", "closed_world_required"),
        (F.col("m") == 0, "abstain", "no_positive_measurements"),
        ((F.col("foreign") > 0) | F.lit(not unit), "abstain", "unit_not_conserved"),
        (F.col("odd") > 0, "abstain", "non_numeric_measurement"),
    ]
    return ladder(found, by, _gates(cases), plain(F.col("sum")), F.lit(unit), F.col("ids"), "closed_world_exact_sum")


def interval(facts: DataFrame, left: str, right: str, unit: str = "tick", at_time: int | None = None) -> DataFrame:
    """Per subject, the clock distance of two predicates' facts, each of which must be a single positive asserted orbit."""
    rows = facts.filter(F.col("predicate").isin(left, right))
    orbits = collapse_orbits(rows, FIBER, at_time)
    sides = orbits.groupBy("scope", "subject").agg(
        *[
            part
            for name, p in (("l", left), ("r", right))
            for part in (
                F.count_if(F.col("predicate") == p).alias(f"{name}_n"),
                F.count_if((F.col("predicate") == p) & (F.col("conflict") | ~F.col("asserted") | (F.col("polarity") < 0))).alias(f"{name}_bad"),
                F.min(F.when(F.col("predicate") == p, F.struct("event_time", "fact_id"))).alias(name),
            )
        ]
    )
    bad = (F.col("l_n") != 1) | (F.col("r_n") != 1) | (F.col("l_bad") > 0) | (F.col("r_bad") > 0)
    return ladder(sides, ["scope", "subject"], [(bad, "abstain", "temporal_operand_not_unique")], F.abs(F.col("r.event_time") - F.col("l.event_time")), F.lit(unit), F.array("l.fact_id", "r.fact_id"), "exact_causal_clock_difference")


def explain_cause(facts: DataFrame, by: list[str] = FIBER, at_time: int | None = None) -> DataFrame:
    """The values of the causes of a fiber's only positive orbit, in the order that it names them."""
    orbits = _selected(facts, by, at_time, None)
    effects = orbits.groupBy(*by).agg(*_flags(), F.count_if(F.expr(ACTIVE)).alias("m"), F.max_by(F.struct("fact_id", "causes"), F.expr(ACTIVE)).alias("effect"))
    named = effects.filter("m = 1").select(*by, F.posexplode("effect.causes").alias("at", "cause"))
    known = facts.select(F.col("fact_id").alias("cause"), F.col("value").alias("cause_value"), F.col("observed_at").alias("seen"), (~F.col("asserted") | (F.col("polarity") < 0)).alias("weak"))
    joined = named.join(known, "cause", "left")
    late = F.lit(False) if at_time is None else F.col("seen") > at_time
    gathered = joined.groupBy(*by).agg(F.max(late).alias("late"), F.max("weak").alias("weak"), F.transform(F.array_sort(F.collect_list(F.struct("at", "cause", "cause_value"))), lambda x: x).alias("list"))
    found = effects.join(gathered, by, "left")
    cases = [
        ((F.col("m") != 1) | F.col("list").isNull(), "abstain", "unique_causal_edge_required"),
        (F.col("late"), "abstain", "cause_outside_light_cone"),
        (F.col("weak"), "abstain", "cause_not_authoritative"),
    ]
    ids = F.concat(F.array("effect.fact_id"), F.transform("list", lambda x: x["cause"]))
    return ladder(found, by, _gates(cases), F.array_join(F.transform("list", lambda x: x["cause_value"]), " | "), F.lit(""), ids, "explicit_causal_hyperedge")


def certified(result: DataFrame, certificates: DataFrame, keys: list[str]) -> DataFrame:
    """A result that needs completeness, only where a certificate covers it: (keys, generation) must match what is current."""
    have = certificates.select(*keys, F.lit(True).alias("_have"))
    joined = result.join(have, keys, "left")
    ok = F.coalesce(F.col("_have"), F.lit(False))
    lost = ~ok & (F.col("state") == "resolved")
    return joined.select(
        *keys,
        F.when(lost, "abstain").otherwise(F.col("state")).alias("state"),
        F.when(~lost, F.col("value")).alias("value"),
        F.when(lost, "").otherwise(F.col("unit")).alias("unit"),
        F.when(lost, "missing_completeness_certificate").otherwise(F.col("reason")).alias("reason"),
        F.when(lost, F.expr("cast(array() as array<bigint>)")).otherwise(F.col("fact_ids")).alias("fact_ids"),
    )
