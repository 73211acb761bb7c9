"""Registered queries over observed columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import observe
from attestra.functions.outcome import shown
from attestra.plans import tables

_S = "CAST({} AS STRING)"
CERTIFIED = "'The North crew did not load ' || " + _S.format("q") + " || ' crates #dock' || " + _S.format("l") + " || ' and said \"Never Again\" in ' || CASE WHEN l % 2 = 0 THEN 'Dover' ELSE 'Kent' END || '.'"
CANDIDATE = "CASE WHEN k % 6 = 0 THEN ' ' WHEN k % 6 = 1 THEN replace(t, 'not ', '') WHEN k % 6 = 2 THEN replace(t, 'Dover', 'Deal') WHEN k % 6 = 3 THEN replace(t, 'load', 'carry') WHEN k % 6 = 4 THEN replace(t, '1', '2') ELSE t END"
BASE = f"WITH b AS (SELECT l_orderkey AS k, l_linenumber AS l, l_quantity::INT AS q, {CERTIFIED} AS t FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_linenumber AS l, l_quantity::INT AS q FROM lineitem))"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_quantity").cast("int").alias("q"))
    return li.withColumn("t", F.expr(CERTIFIED))


def text_charges(spark: SparkSession, folder: str) -> DataFrame:
    return shown(_lines(spark, folder).select("k", "l", observe.charges(F.col("t")).alias("charges")))


CHARGES_SQL = BASE + r""", c AS (SELECT k, l, list_concat(list_transform(list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), lambda w: w IN ('not', 'never', 'no', 'without', 'cannot')), lambda w: 'neg:' || w), list_concat(list_transform(regexp_extract_all(t, '\$?[0-9][0-9,]*(?:\.[0-9]+)?%?'), lambda w: 'num:' || w), list_concat(list_transform(regexp_extract_all(lower(t), '#([a-z0-9_]+)', 1), lambda w: 'tag:' || w), list_transform(regexp_extract_all(lower(t), '"([^"]+)"', 1), lambda w: 'quote:' || w)))) AS x FROM b)
SELECT k, l, array_to_string(list_sort(list_distinct(x)), ',') AS charges FROM c"""


def rewrite_guard(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lines(spark, folder).withColumn("c", F.expr(CANDIDATE))
    return rows.select("k", "l", observe.rewrite_verdict(F.col("t"), F.col("c")).alias("verdict"))


GUARD_SQL = BASE + r""", c AS (SELECT k, l, t, """ + CANDIDATE + r""" AS c FROM b), n AS (SELECT *, list_sort(regexp_extract_all(t, '\$?[0-9][0-9,]*(?:\.[0-9]+)?%?')) AS na, list_sort(regexp_extract_all(c, '\$?[0-9][0-9,]*(?:\.[0-9]+)?%?')) AS nb, list_sort(list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), lambda w: w IN ('not', 'never'))) AS ga, list_sort(list_filter(regexp_extract_all(lower(c), '[\p{L}\p{N}]+'), lambda w: w IN ('not', 'never'))) AS gb, list_sort(regexp_extract_all(t, '\s([A-Z][A-Za-z]+)', 1)) AS pa, list_sort(regexp_extract_all(c, '\s([A-Z][A-Za-z]+)', 1)) AS pb FROM c)
SELECT k, l, CASE WHEN trim(c) = '' THEN 'empty_text' WHEN na <> nb THEN 'numeric_literals_changed' WHEN ga <> gb THEN 'polarity_changed' WHEN pa <> pb THEN 'named_literals_changed' WHEN t <> c THEN 'protected_details_changed' ELSE 'protected_literals_preserved' END AS verdict FROM n"""


def clock_and_months(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's clock out of a sentence, and the day some months before its date."""
    o = tables.table(spark, folder, "orders")
    k = F.col("o_orderkey")
    said = F.concat(F.lit("We met at "), (k % 12 + 1).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.when(k % 2 == 0, " am").otherwise("pm"), F.lit(" today"))
    return o.select("o_orderkey", observe.clock_minutes(F.when(k % 10 != 0, said).otherwise(F.lit("later"))).alias("minutes"), F.date_format(observe.months_before(F.to_date("o_orderdate"), (k % 14).cast("int")), "yyyy-MM-dd").alias("before"))


def observer_weights(spark: SparkSession, folder: str) -> DataFrame:
    f = tables.facts(spark, folder)
    w = observe.observed_weight(F.col("event_time"), 19730.0, 10.0, F.col("version"), 2.0, 1.5, F.col("fact_id") % 3, F.col("fact_id") % 7 / 7)
    return f.select("fact_id", F.round(w, 9).alias("weight"))


def program_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of events as programs in canonical JSON."""
    e = tables.table(spark, folder, "events")
    fields = {"scope": F.lit("app"), "predicate": F.col("event_type"), "operator": F.when(F.col("event_id") % 2 == 0, "count"), "clock": F.col("user_id")}
    return e.select("event_id", observe.canonical_digest(fields).alias("digest"))


QUERIES = {
    "text_charges": (text_charges, CHARGES_SQL),
    "rewrite_guard": (rewrite_guard, GUARD_SQL),
    "clock_and_months": (clock_and_months, "SELECT o_orderkey, (CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey % 12 + 1) % 12 * 60 + o_orderkey % 60 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 720 END END)::INT AS minutes, strftime(o_orderdate::DATE - to_months((o_orderkey % 14)::INT), '%Y-%m-%d') AS before FROM orders"),
    "observer_weights": (observer_weights, f"WITH {tables.FACTS} SELECT fact_id, round(exp(-(((event_time - 19730.0) / 10.0) * ((event_time - 19730.0) / 10.0) + ((version - 2.0) / 1.5) * ((version - 2.0) / 1.5))) / (1 + fact_id % 3) * cos((fact_id % 7) / 7), 9) AS weight FROM facts"),
    "program_digests": (program_digests, """SELECT event_id, sha256('{"clock":' || user_id || ',"operator":' || CASE WHEN event_id % 2 = 0 THEN '"count"' ELSE 'null' END || ',"predicate":"' || event_type || '","scope":"app"}') AS digest FROM events"""),
}
