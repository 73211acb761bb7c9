"""Literal expectations for typed programs and event programs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestra.operators import events, facts

SCHEMA = "fact_id long, scope string, subject string, predicate string, value string, unit string, polarity int, asserted boolean, observed_at long, event_time long, version long, event_id string, causes array<bigint>"


def fact(i, value="x", at=1, version=1, unit="", subject="doc", predicate="status", polarity=1, asserted=True, event_id="", event_time=None, causes=()):
    return (i, "s", subject, predicate, value, unit, polarity, asserted, at, at if event_time is None else event_time, version, event_id, list(causes))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_lookup_takes_the_latest_version(spark):
    r = one(facts.lookup(frame(spark, fact(10, "draft"), fact(20, "released", at=9, version=2))))
    assert (r.state, r.value, r.fact_ids) == ("resolved", "released", [20])


def test_lookup_as_of_sees_only_what_was_observed(spark):
    r = one(facts.lookup(frame(spark, fact(10, "draft"), fact(20, "released", at=9, version=2)), at_time=5))
    assert r.value == "draft"


def test_same_orbit_and_clock_with_different_values_abstains(spark):
    r = one(facts.lookup(frame(spark, fact(1, "a", event_id="e"), fact(2, "b", event_id="e"))))
    assert (r.state, r.reason, r.fact_ids) == ("abstain", "conflicting_latest_orbit", [])


def test_different_orbits_at_one_clock_are_contested(spark):
    r = one(facts.lookup(frame(spark, fact(1, "a"), fact(2, "b"))))
    assert r.reason == "contested_latest_state"


@pytest.mark.parametrize(("row", "reason"), [(fact(1, asserted=False), "uncertain_fact"), (fact(1, polarity=-1), "latest_state_is_negative")])
def test_uncertain_and_negative_states_abstain(spark, row, reason):
    assert one(facts.lookup(frame(spark, row))).reason == reason


def test_sum_needs_a_closed_world(spark):
    r = one(facts.total(frame(spark, fact(1, "4", unit="USD")), "USD"))
    assert (r.state, r.reason) == ("unsupported", "closed_world_required")


def test_orbits_collapse_before_summing(spark):
    rows = frame(spark, fact(1, "4", unit="USD", event_id="p"), fact(2, "4", unit="USD", event_id="p", at=2), fact(3, "6.50", unit="USD"))
    r = one(facts.total(rows, "USD", closed_world=True))
    assert (r.value, r.unit, r.fact_ids) == ("10.5", "USD", [2, 3])


def test_units_are_conserved_and_numbers_needed(spark):
    assert one(facts.total(frame(spark, fact(1, "4", unit="EUR")), "USD", closed_world=True)).reason == "unit_not_conserved"
    assert one(facts.total(frame(spark, fact(1, "four", unit="USD")), "USD", closed_world=True)).reason == "non_numeric_measurement"


def test_the_value_filter_comes_after_the_collapse(spark):
    rows = frame(spark, fact(1, "user", event_id="role"), fact(2, "admin", event_id="role", version=2))
    assert one(facts.count_distinct(rows, value="user", closed_world=True)).reason == "no_matching_fact"


def test_interval_and_cause(spark):
    rows = frame(spark, fact(1, "a", predicate="left", event_time=3), fact(2, "b", predicate="right", event_time=10))
    assert one(facts.interval(rows, "left", "right", "day")).value == "7"
    caused = frame(spark, fact(1, "rain", subject="sky"), fact(2, "wind", subject="air"), fact(3, "flood", causes=[2, 1]))
    r = one(facts.explain_cause(caused).filter("subject = 'doc'"))
    assert (r.value, r.fact_ids) == ("wind | rain", [3, 2, 1])


def test_a_late_cause_is_outside_the_light_cone(spark):
    caused = frame(spark, fact(1, "rain", subject="sky", at=9), fact(3, "flood", causes=[1]))
    assert one(facts.explain_cause(caused, at_time=5).filter("subject = 'doc'")).reason == "cause_outside_light_cone"


RECORD = "event_id string, scope string, predicate string, roles map<string,string>, fact_id long, event_time long, report_time long, version long, polarity string, modality string, quantities array<struct<kind:string,value:decimal(38,6),unit:string>>"


def record(i, day=1, who="ann", quantity=("length", 2, "day")):
    from decimal import Decimal

    return (f"e{i}", "s", "trip", {"who": who}, i, day, day, 1, "positive", "asserted", [(quantity[0], Decimal(quantity[1]), quantity[2])])


def test_counts_need_a_certificate_of_the_current_generation(spark):
    rows = spark.createDataFrame([record(1), record(2, who="bob")], RECORD)
    assert one(events.count_distinct(rows, None)).reason == "missing_completeness_certificate"
    certificates = events.certify(rows)
    assert one(events.count_distinct(rows, certificates)).value == "2"
    more = rows.union(spark.createDataFrame([record(3)], RECORD))
    assert one(events.count_distinct(more, certificates)).state == "abstain"


def test_unknown_constraint_fields_match_nothing(spark):
    rows = spark.createDataFrame([record(1)], RECORD)
    assert events.constrained(rows, {"colour": "red"}).count() == 0


def test_weeks_and_days_convert(spark):
    rows = spark.createDataFrame([record(1, quantity=("length", 2, "week")), record(2, quantity=("length", 7, "day"))], RECORD)
    assert one(events.total(rows, events.certify(rows), "length", "week")).value == "3"


def test_extremes_break_ties_by_id(spark):
    rows = spark.createDataFrame([record(1), record(2)], RECORD)
    c = events.certify(rows)
    assert one(events.extreme(rows, c, "event_id", True)).value == "e2"
    assert one(events.extreme(rows, c, "event_id", False)).value == "e1"


def test_absence_needs_a_certificate(spark):
    rows = spark.createDataFrame([record(1)], RECORD).withColumn("who", F.col("roles")["who"])
    asked = spark.createDataFrame([("s", "trip", "ann"), ("s", "trip", "cy")], "scope string, predicate string, who string")
    by = ["scope", "predicate", "who"]
    open_ = {r.who: r for r in events.exists(rows, asked, None, by=by).collect()}
    assert open_["ann"].value == "true" and open_["cy"].reason == "missing_negative_completeness_certificate"
    closed = {r.who: r for r in events.exists(rows, asked, events.certify(rows), by=by).collect()}
    assert (closed["cy"].value, closed["cy"].reason) == ("false", "closed_fiber_absence")


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert facts.lookup(none).count() == facts.total(none, "USD").count() == 0
    assert dt.date(2024, 1, 1).toordinal() == 738886
