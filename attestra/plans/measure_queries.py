"""Registered queries over measurements in text, sources, predicates and windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.outcome import plain
from attestra.operators import measures, predicates
from attestra.plans import tables
from attestra.sources import adapters, mapping
from attestra.streaming import epochs, windows


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with measurements, one note for each line item."""
    li = tables.table(spark, folder, "lineitem")
    q = F.col("l_quantity").cast("int")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"),
        (F.col("l_suppkey") % 20).alias("topic"),
        F.when(q % 23 == 0, F.concat(F.lit("Maybe it took "), q, F.lit(" hours.")))
        .when(q % 17 == 0, F.concat(F.lit("Did it take "), q, F.lit(" hours?")))
        .otherwise(F.concat(F.lit("Loading took "), q, F.lit(" minutes and driving took "), (q % 7 + 1).cast("int"), F.lit(" hours. It cost $"), (q * 3).cast("int"), F.lit(".50 for "), (q % 5).cast("int"), F.lit(" kilograms.")))
        .alias("text"),
    )


NOTES = """li AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_suppkey % 20 AS topic, l_quantity::INT AS q FROM lineitem)
, a AS (SELECT fact_id, topic, q::DECIMAL(28,6) AS v, 'hour' AS unit, 3600 AS factor, true AS hedged, false AS question, 0 AS sentence FROM li WHERE q % 23 = 0
 UNION ALL SELECT fact_id, topic, q, 'hour', 3600, false, true, 0 FROM li WHERE q % 23 <> 0 AND q % 17 = 0
 UNION ALL SELECT fact_id, topic, q, 'minute', 60, false, false, 0 FROM li WHERE q % 23 <> 0 AND q % 17 <> 0
 UNION ALL SELECT fact_id, topic, q % 7 + 1, 'hour', 3600, false, false, 0 FROM li WHERE q % 23 <> 0 AND q % 17 <> 0
 UNION ALL SELECT fact_id, topic, q * 3 + 0.5, 'USD', 1, false, false, 1 FROM li WHERE q % 23 <> 0 AND q % 17 <> 0
 UNION ALL SELECT fact_id, topic, q % 5, 'kilogram', 1000, false, false, 1 FROM li WHERE q % 23 <> 0 AND q % 17 <> 0)"""


def numeric_atoms(spark: SparkSession, folder: str) -> DataFrame:
    found = measures.atoms(_notes(spark, folder), ["topic"])
    return found.groupBy("topic", "unit", "dimension").agg(F.count("*").alias("atoms"), plain(F.sum("value")).alias("value"), plain(F.sum("base_value")).alias("base"), F.count_if("hedged").alias("hedged"), F.count_if("question").alias("questions"))


_P = "CASE WHEN contains({0}, '.') THEN regexp_replace(regexp_replace({0}, '0+$', ''), '\\.$', '') ELSE {0} END"
ATOMS_SQL = f"""WITH {NOTES} SELECT topic, unit, CASE unit WHEN 'USD' THEN 'currency:USD' WHEN 'kilogram' THEN 'mass' ELSE 'time' END AS dimension, count(*) AS atoms, {_P.format('sum(v)::VARCHAR')} AS value, {_P.format('sum(v * factor)::DECIMAL(38,8)::VARCHAR')} AS base,
count(*) FILTER (WHERE hedged) AS hedged, count(*) FILTER (WHERE question) AS questions FROM a GROUP BY 1, 2, 3"""


def unit_conversion_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Hours of each topic's notes, minutes converted; topics with a hedge abstain."""
    rows = measures.convert(measures.atoms(_notes(spark, folder), ["topic"], "time"), "minute")
    return measures.settle_sum(rows.filter("topic % 2 = 0 or not hedged"), ["topic"], "minute")


CONVERT_SQL = f"""WITH {NOTES}, g AS (SELECT topic, count(*) FILTER (WHERE hedged) AS unsure, sum(v * factor / 60) FILTER (WHERE NOT hedged AND NOT question) AS s, count(*) FILTER (WHERE NOT hedged AND NOT question) AS used FROM a WHERE unit IN ('hour', 'minute') AND (topic % 2 = 0 OR NOT hedged) GROUP BY 1)
SELECT topic, CASE WHEN unsure > 0 THEN 'abstain' WHEN used = 0 THEN 'unsupported' ELSE 'resolved' END AS state, CASE WHEN unsure = 0 AND used > 0 THEN {_P.format('round(s, 6)::DECIMAL(28,6)::VARCHAR')} END AS value, 'minute' AS unit, used FROM g"""


def numeric_slice_certificate(spark: SparkSession, folder: str) -> DataFrame:
    return measures.slice_certificate(measures.atoms(_notes(spark, folder), ["topic"]), ["topic"], "hour", ["driving"])


SLICE_SQL = f"WITH {NOTES} SELECT topic, count(*) AS scope_atoms, count(*) FILTER (WHERE unit = 'hour' AND NOT hedged AND NOT question) AS eligible, count(*) FILTER (WHERE unit <> 'hour') AS other_unit, count(*) FILTER (WHERE unit = 'hour' AND (hedged OR question)) AS other_terms, 0::BIGINT AS uncertain FROM a GROUP BY 1"


def convergent_threshold_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's hours under every threshold of shared terms; second lines tell of packing, so orders that have one and others are contested."""
    notes = _notes(spark, folder).withColumn("order", F.floor(F.col("fact_id") / 10))
    notes = notes.withColumn("text", F.when(F.col("fact_id") % 10 == 2, F.replace("text", F.lit("Loading"), F.lit("Packing"))).otherwise(F.col("text")))
    rows = measures.convert(measures.atoms(notes, ["order"], "time"), "hour").filter("not hedged and not question")
    return measures.convergent_sum(rows, ["loading", "driving", "took"], ["order"])


CONVERGE_SQL = f"""WITH {NOTES}, o AS (SELECT fact_id // 10 AS "order", fact_id, unit, CASE WHEN unit = 'minute' THEN round(v / 60, 6) ELSE v END AS v, CASE WHEN fact_id % 10 = 2 THEN 2 ELSE 3 END AS overlap FROM a WHERE unit IN ('hour', 'minute') AND NOT hedged AND NOT question),
e AS (SELECT "order", t, sum(v)::DECIMAL(38,6) AS s, list((fact_id, unit) ORDER BY fact_id, unit) AS ids FROM o, range(1, 4) r(t) WHERE overlap >= t GROUP BY 1, 2), w AS (SELECT "order", count(DISTINCT (s, ids)) AS worlds, arg_min(s, t) AS s FROM e GROUP BY 1)
SELECT "order", CASE WHEN worlds = 1 THEN 'resolved' ELSE 'contested' END AS state, CASE WHEN worlds = 1 THEN {_P.format('s::VARCHAR')} END AS value, worlds FROM w"""


def product_sum(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem").join(tables.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return measures.product_sum(li, ["p_brand"], F.col("l_quantity"), F.col("p_retailprice")).withColumn("total", F.col("total").cast("decimal(38,2)").cast("string"))


def average_closed_roles(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem").withColumn("line", F.col("l_linenumber").cast("string"))
    return measures.average_closed(li, ["l_orderkey"], "line", ["1", "2"], "l_quantity")


def binary_difference_margin(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem").filter("l_linenumber in (1, 2)").withColumn("line", F.concat(F.lit("s"), F.col("l_linenumber")))
    return measures.margin(li, ["l_orderkey"], "line", "s1", "s2", "l_quantity")


def closed_score_universe(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    return measures.closed_score(li, ["l_suppkey"], "l_quantity", F.col("l_returnflag") == "N")


def percentage_complement(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem").filter("l_returnflag = 'R'")
    return measures.complement(li, ["l_orderkey"], "l_quantity")


def operator_convergence(spark: SparkSession, folder: str) -> DataFrame:
    """Each line item's verdict on its order's status, converged."""
    li = tables.table(spark, folder, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") == 0.1, "contested").when(F.col("l_tax") > 0.05, "abstain").otherwise("resolved").alias("state"), F.concat(F.lit(" "), F.col("l_linestatus")).alias("value"), F.lit("").alias("unit"))
    return measures.converge(rows, ["l_orderkey"])


# --- predicates --------------------------------------------------------------------------------------------------


def eligibility_filter(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents(spark, folder).filter(predicates.eligible(1, "fr")).select("fact_id", "source")


def validity_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Orders open on a day: ordered by then, and not yet shipped in full."""
    o = tables.table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("valid_from"))
    last = tables.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("valid_until"))
    return o.join(last, "o_orderkey", "left").filter(predicates.valid_at(F.lit("1999-06-01").cast("date"))).select("o_orderkey")


def calendar_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of the days that a question names."""
    low, high = predicates.calendar_interval("what was ordered in late March 1998?")
    o = tables.table(spark, folder, "orders")
    return o.filter(F.to_date("o_orderdate").between(F.lit(low), F.lit(high))).select("o_orderkey")


def relative_filter(spark: SparkSession, folder: str) -> DataFrame:
    low, high = predicates.relative_window("what did I see two weeks ago?", dt.date(2024, 1, 29))
    e = tables.table(spark, folder, "events")
    return e.filter(F.to_date("ts").between(F.lit(low), F.lit(high)) & (F.col("event_type") == "view")).select("event_id")


def partition_ids(spark: SparkSession, folder: str) -> DataFrame:
    d = tables.documents(spark, folder)
    key = predicates.partition_id("scope_session", F.col("scope_id"), F.col("session_id"))
    return d.groupBy(key.alias("partition")).agg(F.count("*").alias("documents"))


def admission(spark: SparkSession, folder: str) -> DataFrame:
    t = tables.turns(spark, folder)
    return t.select("fact_id", predicates.admitted(F.col("text")).alias("admitted"), predicates.activated(F.col("text"), ["the", "que"]).alias("activated"), F.coalesce(predicates.safety(F.col("text")), F.lit("safe")).alias("safety"))


ADMISSION_SQL = f"""WITH {tables.TURNS}, w AS (SELECT fact_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM turns)
SELECT fact_id, NOT contains(text, '?') AND (regexp_matches(text, '[0-9]') OR regexp_matches(text, '\\S\\s+\\p{{Lu}}') OR len(list_distinct(ws)) >= 2) AS admitted, list_has_any(ws, ['the', 'que']) AS activated, 'safe' AS safety FROM w"""


def opportunity_gates(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    return predicates.opportunity(li, ["l_linestatus"], F.col("l_quantity") > 10, F.col("l_discount") > 0.02, F.col("l_returnflag") == "N")


# --- sources -----------------------------------------------------------------------------------------------------


def json_pointer_extract(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.table(spark, folder, "events")
    return e.select("event_id", adapters.json_value(F.col("props"), "/k").alias("value"))


def json_pointer_spans(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.table(spark, folder, "events")
    return adapters.json_facts(e, "event_id", "props", "/k").select("event_id", "value", "start", "end", "state")


def regex_log_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Values and clocks out of log lines, one log for each user."""
    e = tables.table(spark, folder, "events")
    line = F.concat_ws(" ", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), "event_type", F.concat(F.lit("n="), F.col("event_id").cast("string")))
    logs = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))
    found = adapters.log_facts(logs, "user_id", "log", r"^(\S+) error n=([0-9]+)$", 2, 1)
    return found.select("user_id", F.col("line").cast("int").alias("line"), F.col("start").cast("int").alias("start"), "value", F.unix_seconds("clock").alias("clock"))


LOG_SQL = """WITH l AS (SELECT user_id, event_id, event_type, floor(epoch(ts))::BIGINT AS clock, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || event_type || ' n=' || event_id AS line FROM events),
n AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(sum(length(line) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, i::INT AS line, start::INT AS start, event_id::VARCHAR AS value, clock FROM n WHERE event_type = 'error'"""


def record_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation rows mapped to documents by a suggested mapping."""
    c = tables.table(spark, folder, "conversations").withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    found = mapping.map_records(c, mapping.suggest("chat", c.columns))
    return found.select("fact_id", "session_id", "sequence", "role", "source_primary_key", "content_sha256", F.coalesce("rejected", F.lit("")).alias("rejected"))


MAPPING_SQL = """SELECT (('0x' || substr(sha256('chat' || chr(31) || 's:' || conv_id || '-' || turn), 1, 16))::UBIGINT % 4611686018427387904)::BIGINT AS fact_id, conv_id::VARCHAR AS session_id, turn::BIGINT AS sequence, role, 's:' || conv_id || '-' || turn AS source_primary_key, sha256(text) AS content_sha256,
CASE WHEN trim(text) = '' THEN 'missing_text' ELSE '' END AS rejected FROM conversations"""


def connector_detection(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.table(spark, folder, "pages")
    uri = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("postgresql://h/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/data/"), F.col("page_id").cast("string"), F.lit(".duckdb"))).when(F.col("page_id") % 4 == 2, F.col("url")).otherwise(F.lit("rediss://h:1/0"))
    return p.select("page_id", F.coalesce(mapping.detect(uri), F.lit("ambiguous")).alias("kind"))


def evidence_block(spark: SparkSession, folder: str) -> DataFrame:
    """All pages, eight to a block."""
    p = tables.table(spark, folder, "pages")
    found = adapters.evidence_block(p.withColumn("g", F.floor(F.col("page_id") / 8)), ["g"], ["page_id"], "html")
    return found.select("g", F.sha2("block", 256).alias("digest"), F.char_length("block").alias("chars"))


def ledger_hash_chain(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.table(spark, folder, "events")
    return adapters.hash_chain(e, ["user_id"], "event_id", "event_type")


CHAIN_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT user_id, event_id, i, sha256('|' || event_id || '|' || event_type) AS digest FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, sha256(c.digest || '|' || e.event_id || '|' || e.event_type) FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)
SELECT user_id, event_id, digest FROM c"""


def html_text_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and link counts of pages, by patterns on the scan."""
    p = tables.table(spark, folder, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).alias("links"), F.char_length("html").alias("chars"))


# --- windows -----------------------------------------------------------------------------------------------------


def _clicks(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.table(spark, folder, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def tumbling_window(spark: SparkSession, folder: str) -> DataFrame:
    found = windows.tumbling(_clicks(spark, folder), "ts", "1 hour", ["event_type"], "cents")
    return found.select(F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "event_type", "n", "total")


def sliding_window(spark: SparkSession, folder: str) -> DataFrame:
    found = windows.sliding(_clicks(spark, folder), "ts", "6 hours", "2 hours", ["event_type"], "cents")
    return found.select(F.unix_seconds("start").alias("start"), "event_type", "n", "total")


def session_window(spark: SparkSession, folder: str) -> DataFrame:
    found = windows.sessions(_clicks(spark, folder), "ts", "6 hours", ["user_id"], "cents")
    return found.select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "user_id", "n", "total")


SESSION_SQL = """WITH e AS (SELECT epoch_us(ts) AS t, user_id, round(value * 100)::BIGINT AS cents FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER w < 21600000000 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT min(t) AS start, max(t) + 21600000000 AS "end", user_id, count(*) AS n, sum(cents)::BIGINT AS total FROM s GROUP BY user_id, s.s"""


def epoch_boundary(spark: SparkSession, folder: str) -> DataFrame:
    """Three epochs of signed evidence folded one after the other."""
    e = tables.table(spark, folder, "events")
    rows = e.select(F.col("event_type").alias("scope"), (F.col("user_id") % 25).cast("string").alias("canonical"), F.col("event_id").alias("fact_id"), (F.col("value") - 40).alias("amplitude"), (F.col("value") > 485).alias("hard_negative"), (F.col("event_id") % 3).alias("epoch"))
    boundary = spark.createDataFrame([], epochs.BOUNDARY)
    for k in range(3):
        boundary = epochs.fold(boundary, rows.filter(F.col("epoch") == k))
    return epochs.settle(boundary)


EPOCH_SQL = """WITH s AS (SELECT event_type AS scope, (user_id % 25)::VARCHAR AS canonical, sum(value - 40) AS amplitude, count(*) FILTER (WHERE value > 40) AS witnesses, bool_or(value > 485) AS hard FROM events GROUP BY 1, 2)
SELECT scope, canonical, round(amplitude, 6) AS amplitude, witnesses, CASE WHEN hard THEN 'excluded' WHEN witnesses < 2 THEN 'abstain' WHEN amplitude < 0.5 THEN 'contested' ELSE 'resolved' END AS state FROM s"""


def epoch_silence(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.table(spark, folder, "events")
    rows = e.select(F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("canonical"), F.to_date("ts").alias("day"))
    return epochs.silence(rows.select("scope", "canonical").distinct(), rows.filter("day = date'2024-01-10'"))


def group_by_max_limit(spark: SparkSession, folder: str) -> DataFrame:
    """The metadata query: maxima of five columns by two keys, ordered and limited."""
    li = tables.table(spark, folder, "lineitem")
    found = li.groupBy("l_suppkey", "l_returnflag").agg(*[F.max(c).alias(f"max_{c}") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")])
    return found.orderBy("l_suppkey", "l_returnflag").limit(200)


QUERIES = {
    "numeric_atoms": (numeric_atoms, ATOMS_SQL),
    "unit_conversion_sum": (unit_conversion_sum, CONVERT_SQL),
    "numeric_slice_certificate": (numeric_slice_certificate, SLICE_SQL),
    "convergent_threshold_sum": (convergent_threshold_sum, CONVERGE_SQL),
    "product_sum": (product_sum, "SELECT p_brand, sum(l_quantity::DECIMAL(18,2) * p_retailprice::DECIMAL(18,2))::DECIMAL(38,2)::VARCHAR AS total, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "average_closed_roles": (
        average_closed_roles,
        "WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS k, avg(l_quantity) AS a FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1) SELECT l_orderkey, CASE WHEN n = 2 AND k = 2 THEN 'resolved' ELSE 'abstain' END AS state, CASE WHEN n = 2 AND k = 2 THEN round(a, 6)::VARCHAR END AS value, CASE WHEN n = 2 AND k = 2 THEN 'closed_role_mean' ELSE 'role_not_unique' END AS reason FROM g",
    ),
    "binary_difference_margin": (
        binary_difference_margin,
        "WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 1) AS a, count(*) FILTER (WHERE l_linenumber = 2) AS b, coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = 1), 0) - coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = 2), 0) AS gap FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1) SELECT l_orderkey, CASE WHEN a <> 1 OR b <> 1 THEN 'abstain' WHEN gap < 0 THEN 'contested' ELSE 'resolved' END AS state, CASE WHEN a = 1 AND b = 1 AND gap >= 0 THEN gap::BIGINT::VARCHAR END AS value FROM g",
    ),
    "closed_score_universe": (
        closed_score_universe,
        "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'N') AS made, count(*) FILTER (WHERE l_returnflag <> 'N') AS missed, count(*) AS attempts, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS sum, max(l_quantity) FILTER (WHERE l_returnflag = 'N') AS longest, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS average FROM lineitem GROUP BY 1",
    ),
    "percentage_complement": (percentage_complement, "WITH g AS (SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l_orderkey, CASE WHEN s > 100 THEN 'contested' ELSE 'resolved' END AS state, CASE WHEN s <= 100 THEN (100 - s)::BIGINT::VARCHAR END AS value FROM g"),
    "operator_convergence": (
        operator_convergence,
        "WITH r AS (SELECT l_orderkey, CASE WHEN l_discount = 0.1 THEN 'contested' WHEN l_tax > 0.05 THEN 'abstain' ELSE 'resolved' END AS state, lower(l_linestatus) AS v FROM lineitem), g AS (SELECT l_orderkey, count(*) FILTER (WHERE state = 'contested') AS bad, count(DISTINCT v) FILTER (WHERE state = 'resolved') AS kinds, min(v) FILTER (WHERE state = 'resolved') AS one, count(*) FILTER (WHERE state = 'resolved') AS agree FROM r GROUP BY 1) SELECT l_orderkey, CASE WHEN bad > 0 OR kinds > 1 THEN 'contested' WHEN kinds = 0 THEN 'abstain' ELSE 'resolved' END AS state, CASE WHEN bad = 0 AND kinds = 1 THEN one END AS value, agree FROM g",
    ),
    "eligibility_filter": (eligibility_filter, "SELECT doc_id AS fact_id, source FROM documents WHERE lang = 'fr'"),
    "validity_interval": (validity_interval, "WITH l AS (SELECT l_orderkey, max(l_shipdate::DATE) AS u FROM lineitem GROUP BY 1) SELECT o_orderkey FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderdate::DATE <= DATE '1999-06-01' AND (u IS NULL OR DATE '1999-06-01' < u)"),
    "calendar_filter": (calendar_filter, "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-03-21' AND DATE '1998-03-31'"),
    "relative_filter": (relative_filter, "SELECT event_id FROM events WHERE event_type = 'view' AND ts::DATE BETWEEN DATE '2024-01-14' AND DATE '2024-01-16'"),
    "partition_ids": (partition_ids, "SELECT sha256('scope_session' || chr(31) || '1' || chr(31) || lang) AS partition, count(*) AS documents FROM documents GROUP BY 1"),
    "admission_gates": (admission, ADMISSION_SQL),
    "opportunity_gates": (opportunity_gates, "SELECT l_linestatus, CASE WHEN NOT l_quantity > 10 THEN 'out_of_reach' WHEN NOT l_discount > 0.02 THEN 'unprepared' WHEN l_returnflag = 'N' THEN 'taken' ELSE 'missed' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "json_pointer_extract": (json_pointer_extract, "SELECT event_id, props->>'$.k' AS value FROM events"),
    "json_pointer_spans": (json_pointer_spans, "SELECT event_id, props->>'$.k' AS value, 6::BIGINT AS start, (6 + length(props->>'$.k'))::BIGINT AS \"end\", 'resolved' AS state FROM events"),
    "regex_log_extract": (regex_log_extract, LOG_SQL),
    "record_mapping": (record_mapping, MAPPING_SQL),
    "connector_detection": (connector_detection, "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'postgresql' WHEN 1 THEN 'duckdb' WHEN 2 THEN 'ambiguous' ELSE 'redis' END AS kind FROM pages"),
    "evidence_block": (
        evidence_block,
        "WITH b AS (SELECT page_id // 8 AS g, string_agg('<evidence>' || replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</evidence>', chr(10) ORDER BY page_id) AS block FROM pages GROUP BY 1) SELECT g, sha256(block) AS digest, length(block)::INT AS chars FROM b",
    ),
    "ledger_hash_chain": (ledger_hash_chain, CHAIN_SQL),
    "html_text_scan": (html_text_scan, "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href='))::INT AS links, length(html)::INT AS chars FROM pages"),
    "tumbling_window": (tumbling_window, "SELECT floor(epoch(ts))::BIGINT // 3600 * 3600 AS start, floor(epoch(ts))::BIGINT // 3600 * 3600 + 3600 AS \"end\", event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2, 3"),
    "sliding_window": (sliding_window, "SELECT floor(epoch(ts))::BIGINT // 7200 * 7200 - 7200 * k AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events, range(3) r(k) GROUP BY 1, 2"),
    "session_window": (session_window, SESSION_SQL),
    "epoch_boundary": (epoch_boundary, EPOCH_SQL),
    "epoch_silence": (epoch_silence, "SELECT DISTINCT event_type AS scope, user_id::VARCHAR AS canonical FROM events EXCEPT SELECT event_type, user_id::VARCHAR FROM events WHERE ts::DATE = DATE '2024-01-10'"),
    "group_by_max_limit": (group_by_max_limit, "SELECT l_suppkey, l_returnflag, max(l_quantity) AS max_l_quantity, max(l_extendedprice) AS max_l_extendedprice, max(l_discount) AS max_l_discount, max(l_tax) AS max_l_tax, max(l_linenumber) AS max_l_linenumber FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 200"),
}
