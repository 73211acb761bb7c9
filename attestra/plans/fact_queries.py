"""Registered queries over typed facts and event records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.outcome import shown
from attestra.operators import events, facts
from attestra.plans.tables import FACTS, RECORDS
from attestra.plans import tables

MIDDLE = 1705276800  # 2024-01-15
FIBER = "scope, subject, predicate"


def _case(*cases: tuple[str, str, str], value: str, unit: str, ids: str, reason: str, keys: str, source: str) -> str:
    """The outcome ladder in SQL."""
    state = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in cases) + " ELSE 'resolved' END"
    why = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in cases) + f" ELSE '{reason}' END"
    if not cases:
        state, why = "'resolved'", f"'{reason}'"
    return f"""SELECT {keys}, state, CASE WHEN state = 'resolved' THEN v::VARCHAR END AS value, CASE WHEN state = 'resolved' THEN u ELSE '' END AS unit, reason, CASE WHEN state = 'resolved' THEN i ELSE '' END AS fact_ids
FROM (SELECT {keys}, {state} AS state, {why} AS reason, {value} AS v, {unit} AS u, {ids} AS i FROM {source})"""


PLAIN = "CASE WHEN contains({0}, '.') THEN regexp_replace(regexp_replace({0}, '0+$', ''), '\\.$', '') ELSE {0} END"


def _orbits(at: int | None = None) -> str:
    """facts, then the latest report of every orbit."""
    when = f"WHERE observed_at <= {at}" if at else ""
    return f"""WITH {FACTS}, ranked AS (SELECT *, rank() OVER (PARTITION BY {FIBER}, orbit ORDER BY version DESC, observed_at DESC) AS k FROM facts {when}),
orbits AS (SELECT {FIBER}, orbit, min(fact_id) AS fact_id, arg_min(value, fact_id) AS value, arg_min(unit, fact_id) AS unit, arg_min(polarity, fact_id) AS polarity, arg_min(asserted, fact_id) AS asserted,
  arg_min(event_time, fact_id) AS event_time, arg_min(coalesce(cause, -1), fact_id) AS cause, count(DISTINCT (value, unit, polarity, asserted, event_time, coalesce(cause, -1))) > 1 AS conflict FROM ranked WHERE k = 1 GROUP BY {FIBER}, orbit)"""


def _chosen(value: str | None = None) -> str:
    """orbits, then each fiber's flags."""
    on = "true" if value is None else f"value = '{value}'"
    return f""", chosen AS (SELECT *, {on} AS chosen, {on} AND polarity > 0 AS active, try_cast(value AS DECIMAL(28,6)) AS number FROM orbits),
fibers AS (SELECT {FIBER}, bool_or(conflict) AS any_conflict, count(*) FILTER (WHERE chosen) AS n, bool_or(chosen AND NOT asserted) AS any_unsure, count(*) FILTER (WHERE active) AS m,
  count(DISTINCT value) FILTER (WHERE active) AS kinds, count(*) FILTER (WHERE active AND unit <> 'cent') AS alien, count(*) FILTER (WHERE active AND number IS NULL) AS odd, sum(number) FILTER (WHERE active) AS total,
  coalesce(string_agg(fact_id::VARCHAR, ',' ORDER BY fact_id) FILTER (WHERE active), '') AS ids FROM chosen GROUP BY {FIBER})"""


GATES = (("any_conflict", "abstain", "conflicting_latest_orbit"), ("n = 0", "abstain", "no_matching_fact"), ("any_unsure", "abstain", "uncertain_fact"))


def lookup_asof(spark: SparkSession, folder: str) -> DataFrame:
    return shown(facts.lookup(tables.facts(spark, folder), at_time=MIDDLE))


def lookup_latest(spark: SparkSession, folder: str) -> DataFrame:
    return shown(facts.lookup(tables.facts(spark, folder)))


def _lookup_sql(at: int | None) -> str:
    when = f"WHERE observed_at <= {at}" if at else ""
    source = f"""(SELECT {FIBER}, count(DISTINCT (value, unit, polarity, asserted)) > 1 AS clash, count(DISTINCT orbit) AS orbits, any_value(value) AS value, any_value(unit) AS unit, any_value(polarity) AS polarity, any_value(asserted) AS asserted, min(fact_id) AS fact_id
  FROM (SELECT *, rank() OVER (PARTITION BY {FIBER} ORDER BY version DESC, event_time DESC, observed_at DESC) AS k FROM facts {when}) WHERE k = 1 GROUP BY {FIBER})"""
    cases = (("clash AND orbits = 1", "abstain", "conflicting_latest_orbit"), ("clash", "abstain", "contested_latest_state"), ("NOT asserted", "abstain", "uncertain_fact"), ("polarity < 0", "abstain", "latest_state_is_negative"))
    return f"WITH {FACTS} " + _case(*cases, value="value", unit="unit", ids="fact_id::VARCHAR", reason="unique_latest_state", keys=FIBER, source=source)


def orbit_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return facts.collapse_orbits(tables.facts(spark, folder)).select(*facts.FIBER, "orbit", "fact_id", "value", "unit", "polarity", "asserted", "event_time", "conflict")


def count_distinct_closed(spark: SparkSession, folder: str) -> DataFrame:
    return shown(facts.count_distinct(tables.facts(spark, folder), closed_world=True))


def count_distinct_open(spark: SparkSession, folder: str) -> DataFrame:
    return shown(facts.count_distinct(tables.facts(spark, folder), at_time=MIDDLE))


def count_current_value(spark: SparkSession, folder: str) -> DataFrame:
    """Orbits whose latest value is plan1: the value filter after the collapse."""
    rows = tables.facts(spark, folder).filter(F.col("predicate") == "signup")
    return shown(facts.count_distinct(rows, value="plan1", closed_world=True))


def sum_closed_units(spark: SparkSession, folder: str) -> DataFrame:
    return shown(facts.total(tables.facts(spark, folder), "cent", closed_world=True))


def interval_two_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """Days between the first signup and the first purchase orbit seen on the first two days."""
    return shown(facts.interval(tables.facts(spark, folder), "signup", "purchase", "day", at_time=1704067200 + 2 * 86400))


INTERVAL_SQL = (
    _orbits(1704067200 + 2 * 86400)
    + ", sides AS (SELECT scope, subject, "
    + ", ".join(
        f"count(*) FILTER (WHERE predicate = '{p}') AS {n}_n, count(*) FILTER (WHERE predicate = '{p}' AND (conflict OR NOT asserted OR polarity < 0)) AS {n}_bad, min(event_time) FILTER (WHERE predicate = '{p}') AS {n}_t, arg_min(fact_id, (event_time, fact_id)) FILTER (WHERE predicate = '{p}') AS {n}_f"
        for n, p in (("l", "signup"), ("r", "purchase"))
    )
    + " FROM orbits WHERE predicate IN ('signup', 'purchase') GROUP BY scope, subject) "
    + _case(("l_n <> 1 OR r_n <> 1 OR l_bad > 0 OR r_bad > 0", "abstain", "temporal_operand_not_unique"), value="abs(r_t - l_t)", unit="'day'", ids="l_f || ',' || r_f", reason="exact_causal_clock_difference", keys="scope, subject", source="sides")
)


def explain_cause(spark: SparkSession, folder: str) -> DataFrame:
    return shown(facts.explain_cause(tables.facts(spark, folder), at_time=1704067200 + 2 * 86400))


CAUSE_SQL = (
    _orbits(1704067200 + 2 * 86400)
    + _chosen()
    + f", effects AS (SELECT {FIBER}, min(fact_id) AS effect, nullif(min(cause), -1) AS cause FROM chosen WHERE active GROUP BY {FIBER} HAVING count(*) = 1)"
    + f", found AS (SELECT fibers.*, e.effect, e.cause, f.value AS cause_value, f.observed_at > {1704067200 + 2 * 86400} AS late, NOT f.asserted OR f.polarity < 0 AS weak FROM fibers LEFT JOIN effects e USING ({FIBER}) LEFT JOIN facts f ON f.fact_id = e.cause) "
    + _case(*GATES, ("m <> 1 OR cause IS NULL", "abstain", "unique_causal_edge_required"), ("late", "abstain", "cause_outside_light_cone"), ("weak", "abstain", "cause_not_authoritative"), value="cause_value", unit="''", ids="effect || ',' || cause", reason="explicit_causal_hyperedge", keys=FIBER, source="found")
)


# --- event records -----------------------------------------------------------------------------------------------


def _certificates(spark: SparkSession, folder: str) -> DataFrame:
    """All fibers but `error` are certified."""
    return events.certify(tables.records(spark, folder).filter(F.col("predicate") != "error"))


def completeness_digest(spark: SparkSession, folder: str) -> DataFrame:
    return events.certify(tables.records(spark, folder))


def event_count_distinct(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.records(spark, folder)
    return shown(events.count_distinct(rows, _certificates(spark, folder), {"polarity": "positive", "role:bucket": "3"}, "role:user"))


def event_sum_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.records(spark, folder)
    return shown(events.total(rows, _certificates(spark, folder), "length", "week", {"role:user": "8"}))


def event_sum_foreign_unit(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.records(spark, folder)
    return shown(events.total(rows, _certificates(spark, folder), "amount", "day", {"role:user": "8"}))


def event_argmax(spark: SparkSession, folder: str) -> DataFrame:
    return shown(events.extreme(tables.records(spark, folder), _certificates(spark, folder), "role:user", True))


def event_argmin(spark: SparkSession, folder: str) -> DataFrame:
    return shown(events.extreme(tables.records(spark, folder), _certificates(spark, folder), "event_id", False, "report_time", {"role:bucket": "2"}))


def event_project(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.records(spark, folder).filter("event_time = 19723").withColumn("user", F.col("roles")["user"])
    return shown(events.only(rows, "quantity:amount", by=["predicate", "user"]))


def event_exists_certificate(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.records(spark, folder).withColumn("user", F.col("roles")["user"])
    asked = rows.select("user").distinct().crossJoin(rows.select("scope", "predicate").distinct())
    return shown(events.exists(rows.filter("event_time = 19723"), asked, events.certify(rows.filter("event_time = 19723 and predicate != 'error'")), by=["scope", "predicate", "user"]))


def event_diff(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.records(spark, folder).filter("event_time in (19723, 19731)").withColumn("user", F.col("roles")["user"])
    late = rows.withColumn("modality", F.when(F.col("event_time") == 19731, "late").otherwise("early"))
    return shown(events.difference(late.filter("predicate = 'view'"), {"modality": "early"}, {"modality": "late"}, "week", ["user"]))


_CERTIFIED = "predicate <> 'error'"

QUERIES = {
    "lookup_asof": (lookup_asof, _lookup_sql(MIDDLE)),
    "lookup_latest": (lookup_latest, _lookup_sql(None)),
    "orbit_collapse": (orbit_collapse, _orbits() + f" SELECT {FIBER}, orbit, fact_id, value, unit, polarity, asserted, event_time, conflict FROM orbits"),
    "count_distinct_closed": (count_distinct_closed, _orbits() + _chosen() + _case(*GATES, value="kinds", unit="'count'", ids="ids", reason="closed_world_distinct_count", keys=FIBER, source="fibers")),
    "count_distinct_open": (count_distinct_open, _orbits(MIDDLE) + _chosen() + _case(*GATES, ("true", "unsupported", "closed_world_required"), value="kinds", unit="'count'", ids="ids", reason="closed_world_distinct_count", keys=FIBER, source="fibers")),
    "count_current_value": (count_current_value, _orbits() + _chosen("plan1") + _case(*GATES, value="kinds", unit="'count'", ids="ids", reason="closed_world_distinct_count", keys=FIBER, source="(SELECT * FROM fibers WHERE predicate = 'signup')")),
    "sum_closed_units": (
        sum_closed_units,
        _orbits()
        + _chosen()
        + _case(*GATES, ("m = 0", "abstain", "no_positive_measurements"), ("alien > 0", "abstain", "unit_not_conserved"), ("odd > 0", "abstain", "non_numeric_measurement"), value=PLAIN.format("total::VARCHAR"), unit="'cent'", ids="ids", reason="closed_world_exact_sum", keys=FIBER, source="fibers"),
    ),
    "interval_two_selectors": (interval_two_selectors, INTERVAL_SQL),
    "explain_cause": (explain_cause, CAUSE_SQL),
    "completeness_digest": (completeness_digest, f"WITH {RECORDS} SELECT scope, predicate, count(*) AS generation, count(*) AS event_count, sha256(string_agg(event_id, chr(31) ORDER BY event_id)) AS event_ids_sha256 FROM records GROUP BY 1, 2"),
    "event_count_distinct": (
        event_count_distinct,
        f"WITH {RECORDS} "
        + _case((f"NOT ({_CERTIFIED})", "abstain", "missing_completeness_certificate"), value="n", unit="'count'", ids="ids", reason="closed_fiber_count", keys="scope, predicate", source="(SELECT scope, predicate, count(DISTINCT role_user) AS n, string_agg(fact_id::VARCHAR, ',' ORDER BY fact_id) AS ids FROM records WHERE polarity = 'positive' AND role_bucket = '3' GROUP BY 1, 2)"),
    ),
    "event_sum_units": (
        event_sum_units,
        f"WITH {RECORDS} "
        + _case((f"NOT ({_CERTIFIED})", "abstain", "missing_completeness_certificate"), value=PLAIN.format("n::VARCHAR"), unit="'week'", ids="ids", reason="closed_fiber_exact_sum", keys="scope, predicate", source="(SELECT scope, predicate, sum(CASE WHEN length_unit = 'week' THEN length ELSE round(length / 7, 6)::DECIMAL(38,6) END) AS n, string_agg(fact_id::VARCHAR, ',' ORDER BY fact_id) AS ids FROM records WHERE role_user = '8' GROUP BY 1, 2)"),
    ),
    "event_sum_foreign_unit": (
        event_sum_foreign_unit,
        f"WITH {RECORDS} "
        + _case((f"NOT ({_CERTIFIED})", "abstain", "missing_completeness_certificate"), ("true", "abstain", "missing_or_inconvertible_quantity"), value="n", unit="'day'", ids="ids", reason="closed_fiber_exact_sum", keys="scope, predicate", source="(SELECT scope, predicate, 1 AS n, '' AS ids FROM records WHERE role_user = '8' GROUP BY 1, 2)"),
    ),
    "event_argmax": (
        event_argmax,
        f"WITH {RECORDS} "
        + _case((f"NOT ({_CERTIFIED})", "abstain", "missing_completeness_certificate"), value="v", unit="''", ids="ids", reason="unique_clock_extreme", keys="scope, predicate", source="(SELECT scope, predicate, arg_max(role_user, (event_time, event_id)) AS v, arg_max(fact_id, (event_time, event_id))::VARCHAR AS ids FROM records GROUP BY 1, 2)"),
    ),
    "event_argmin": (
        event_argmin,
        f"WITH {RECORDS} "
        + _case((f"NOT ({_CERTIFIED})", "abstain", "missing_completeness_certificate"), value="v", unit="''", ids="ids", reason="unique_clock_extreme", keys="scope, predicate", source="(SELECT scope, predicate, arg_min(event_id, (report_time, event_id)) AS v, arg_min(fact_id, (report_time, event_id))::VARCHAR AS ids FROM records WHERE role_bucket = '2' GROUP BY 1, 2)"),
    ),
    "event_project": (
        event_project,
        f"WITH {RECORDS} "
        + _case(("n > 1", "abstain", "ambiguous_event"), value="v", unit="''", ids="ids", reason="unique_event_projection", keys='predicate, "user"', source="(SELECT predicate, role_user AS \"user\", count(*) AS n, min(amount)::VARCHAR AS v, min(fact_id)::VARCHAR AS ids FROM records WHERE event_time = 19723 GROUP BY 1, 2)"),
    ),
    "event_exists_certificate": (
        event_exists_certificate,
        f"""WITH {RECORDS}, asked AS (SELECT * FROM (SELECT DISTINCT role_user AS "user" FROM records), (SELECT DISTINCT scope, predicate FROM records)),
seen AS (SELECT scope, predicate, role_user AS "user", string_agg(fact_id::VARCHAR, ',' ORDER BY fact_id) AS ids FROM records WHERE event_time = 19723 GROUP BY 1, 2, 3)
SELECT a.scope, a.predicate, a."user", CASE WHEN ids IS NULL AND a.predicate = 'error' THEN 'abstain' ELSE 'resolved' END AS state, CASE WHEN ids IS NOT NULL THEN 'true' WHEN a.predicate <> 'error' THEN 'false' END AS value, '' AS unit,
  CASE WHEN ids IS NOT NULL THEN 'positive_witness_exists' WHEN a.predicate = 'error' THEN 'missing_negative_completeness_certificate' ELSE 'closed_fiber_absence' END AS reason, coalesce(ids, '') AS fact_ids
FROM asked a LEFT JOIN seen s ON a.scope = s.scope AND a.predicate = s.predicate AND a."user" = s."user" """,
    ),
    "event_diff": (
        event_diff,
        f"""WITH {RECORDS}, l AS (SELECT role_user AS "user", count(*) AS n, min(fact_id) AS f FROM records WHERE event_time = 19723 AND predicate = 'view' GROUP BY 1),
r AS (SELECT role_user AS "user", count(*) AS n, min(fact_id) AS f FROM records WHERE event_time = 19731 AND predicate = 'view' GROUP BY 1),
p AS (SELECT coalesce(l."user", r."user") AS "user", coalesce(l.n, 0) AS ln, coalesce(r.n, 0) AS rn, l.f AS lf, r.f AS rf FROM l FULL JOIN r ON l."user" = r."user")
SELECT "user", CASE WHEN ln = 1 AND rn = 1 THEN 'resolved' ELSE 'abstain' END AS state, CASE WHEN ln = 1 AND rn = 1 THEN '1.142857' END AS value, CASE WHEN ln = 1 AND rn = 1 THEN 'week' ELSE '' END AS unit,
  CASE WHEN ln = 1 AND rn = 1 THEN 'exact_clock_difference' ELSE (CASE ln WHEN 0 THEN 'missing_unique_event' WHEN 1 THEN 'unique_event' ELSE 'ambiguous_event' END) || ':' || (CASE rn WHEN 0 THEN 'missing_unique_event' WHEN 1 THEN 'unique_event' ELSE 'ambiguous_event' END) END AS reason,
  CASE WHEN ln = 1 AND rn = 1 THEN lf || ',' || rf ELSE '' END AS fact_ids FROM p""",
    ),
}
