"""Registered queries that begin with a question."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.outcome import shown
from attestra.plans import tables
from attestra.plans.answer import ask, evidence
from attestra.plans.tables import TURNS
from attestra.plans.text_queries import TOK, _bm25_sql
from attestra.plans.fact_queries import GATES, PLAIN, _case, _chosen, _lookup_sql, _orbits

FIBER = "scope, subject, predicate"


def ask_latest(spark: SparkSession, folder: str) -> DataFrame:
    return shown(ask(tables.facts(spark, folder), "what is the latest signup as of 2024-01-14?"))


def ask_total(spark: SparkSession, folder: str) -> DataFrame:
    return shown(ask(tables.facts(spark, folder), "what is the total amount of purchase in cents for user:12?"))


def ask_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return shown(ask(tables.facts(spark, folder), "how many different clicks were there in early January 2024?"))


def ask_ambiguous(spark: SparkSession, folder: str) -> DataFrame:
    return shown(ask(tables.facts(spark, folder), "how many different values has the latest view?", dt.date(2024, 1, 30)))


def ask_first_time(spark: SparkSession, folder: str) -> DataFrame:
    return shown(ask(tables.facts(spark, folder), "when was the first time of an error?"))


FIRST_SQL = _orbits() + ", f AS (SELECT scope, subject, min(event_time) AS t, arg_min(fact_id, (event_time, fact_id)) AS f FROM orbits WHERE predicate = 'error' AND asserted AND polarity > 0 AND NOT conflict GROUP BY 1, 2) SELECT scope, subject, 'resolved' AS state, t::VARCHAR AS value, 'day' AS unit, 'unique_clock_extreme' AS reason, f::VARCHAR AS fact_ids FROM f"


def evidence_pack(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.turns(spark, folder).select("fact_id", "text")
    found = evidence(docs, tables.query_texts(spark, folder))
    return shown(found.withColumn("evidence", F.sha2("evidence", 256)))


PACK_SQL = f"""WITH RECURSIVE {TURNS}, docs AS (SELECT fact_id, text FROM turns), asked AS (SELECT item_id::BIGINT AS query_id, text FROM benchmark), {_bm25_sql(digits=9)},
b AS (SELECT query_id, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS k FROM scored) WHERE k <= 8),
ss AS (SELECT fact_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[^.!?\\n]|[.][0-9])+[.!?]?'), lambda s: trim(s)), lambda s: s <> '') AS l FROM docs), cl AS (SELECT fact_id, unnest(l) AS text, unnest(range(len(l))) AS claim FROM ss),
aq AS (SELECT query_id, list_distinct({TOK}) AS ws FROM asked), sc AS (SELECT query_id, fact_id, claim, cl.text, len(list_intersect(list_distinct(regexp_extract_all(lower(cl.text), '[\\p{{L}}\\p{{N}}]+')), ws)) AS s FROM b JOIN cl USING (fact_id) JOIN aq USING (query_id) WHERE length(cl.text) >= 12),
rk AS (SELECT *, strlen(text) AS cost, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fact_id, claim) AS rank FROM sc WHERE s > 0), top AS (SELECT * FROM rk WHERE rank <= 12),
f AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT query_id FROM top) UNION ALL SELECT f.query_id, top.rank, CASE WHEN f.used + top.cost <= 4096 THEN f.used + top.cost ELSE f.used END, CASE WHEN f.used + top.cost <= 4096 THEN list_append(f.kept, top.rank) ELSE f.kept END FROM f JOIN top ON top.query_id = f.query_id AND top.rank = f.rank + 1),
done AS (SELECT query_id, arg_max(used, rank) AS used, arg_max(kept, rank) AS kept FROM f GROUP BY 1)
SELECT query_id, array_to_string(list_sort(list_distinct(list(fact_id))), ',') AS fact_ids, any_value(used) AS used, sha256(string_agg(text, chr(10) ORDER BY rank)) AS evidence FROM done JOIN top USING (query_id) WHERE list_contains(kept, rank) GROUP BY 1"""


_EARLY = _orbits().replace("FROM facts ),", "FROM facts WHERE event_time BETWEEN 19723 AND 19732),")

QUERIES = {
    "ask_latest": (ask_latest, f"SELECT scope, subject, state, value, unit, reason, fact_ids FROM ({_lookup_sql(1705276799)}) WHERE predicate = 'signup'"),
    "ask_total": (
        ask_total,
        "SELECT scope, subject, state, value, unit, reason, fact_ids FROM ("
        + _orbits()
        + _chosen()
        + _case(*GATES, ("m = 0", "abstain", "no_positive_measurements"), ("alien > 0", "abstain", "unit_not_conserved"), ("odd > 0", "abstain", "non_numeric_measurement"), value=PLAIN.format("total::VARCHAR"), unit="'cent'", ids="ids", reason="closed_world_exact_sum", keys=FIBER, source="fibers")
        + ") WHERE predicate = 'purchase' AND subject = 'user:12'",
    ),
    "ask_distinct": (ask_distinct, "SELECT scope, subject, state, value, unit, reason, fact_ids FROM (" + _EARLY + _chosen() + _case(*GATES, value="kinds", unit="'count'", ids="ids", reason="closed_world_distinct_count", keys=FIBER, source="fibers") + ") WHERE predicate = 'click'"),
    "ask_ambiguous": (ask_ambiguous, "SELECT NULL::VARCHAR AS scope, NULL::VARCHAR AS subject, 'abstain' AS state, NULL::VARCHAR AS value, '' AS unit, 'ambiguous_operator:COUNT_DISTINCT,LOOKUP' AS reason, '' AS fact_ids"),
    "ask_first_time": (ask_first_time, FIRST_SQL),
    "evidence_pack": (evidence_pack, PACK_SQL),
}
