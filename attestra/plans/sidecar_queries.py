"""Registered queries over authorized facts and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import measures, passages, sidecar
from attestra.plans import tables
from attestra.plans.measure_queries import NOTES, _notes


def _declared(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each event's props as a source that declares its number; some spans, schemas and sources are wrong."""
    e = tables.table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    end = F.lit(6) + F.char_length(k)
    declarations = e.select(
        F.col("event_id").alias("fact_id"), F.when(F.col("event_id") % 101 == 0, -1).otherwise(F.col("event_id")).alias("source_id"), F.when(F.col("event_id") % 7 == 0, "raw").otherwise("json").alias("adapter_id"),
        F.when(F.col("event_id") % 13 == 0, "old").otherwise("v1").alias("schema_sha256"), F.lit("app").alias("scope"), F.col("event_type").alias("predicate"), k.alias("value"), F.lit(6).alias("span_start"), (end - F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)).cast("int").alias("span_end"),
    )
    sources = e.select(F.col("event_id").alias("source_id"), F.col("props").alias("content"), F.sha2("props", 256).alias("source_sha256"))
    authorities = spark.createDataFrame([("json", "v1", ["app"], ["view", "click", "purchase", "signup"])], "adapter_id string, schema_sha256 string, scopes array<string>, predicates array<string>")
    return declarations, sources, authorities


def sidecar_admission(spark: SparkSession, folder: str) -> DataFrame:
    found = sidecar.admit(*_declared(spark, folder))
    return found.select("fact_id", "value", F.coalesce("rejected", F.lit("APPLIED")).alias("status"))


ADMIT_SQL = """SELECT event_id AS fact_id, props->>'$.k' AS value, CASE WHEN event_id % 101 = 0 THEN 'unknown_source' WHEN event_id % 7 = 0 THEN 'unknown_adapter' WHEN event_id % 13 = 0 THEN 'schema_mismatch' WHEN event_type = 'error' THEN 'predicate_not_allowed' WHEN event_id % 17 = 0 THEN 'span_mismatch' ELSE 'APPLIED' END AS status FROM events"""


def _lineage(spark: SparkSession, folder: str) -> DataFrame:
    f = tables.facts(spark, folder)
    before = F.when(F.col("fact_id") % 4 == 0, F.get("causes", F.lit(0)))
    return f.select("fact_id", F.col("subject").alias("orbit"), before.alias("supersedes"), F.col("event_time").alias("valid_from"), F.when(F.col("fact_id") % 3 == 0, F.col("event_time") + 5).alias("valid_until"), "predicate")


def sidecar_active(spark: SparkSession, folder: str) -> DataFrame:
    return sidecar.active(_lineage(spark, folder), 19735).groupBy("predicate", "lineage").agg(F.count("*").alias("facts"))


ACTIVE_SQL = f"""WITH {tables.FACTS}, l AS (SELECT *, CASE WHEN fact_id % 4 = 0 THEN cause END AS supersedes FROM facts) SELECT predicate, 'ok' AS lineage, count(*) AS facts FROM l WHERE fact_id NOT IN (SELECT supersedes FROM l WHERE supersedes IS NOT NULL) AND event_time <= 19735 AND (fact_id % 3 <> 0 OR 19735 < event_time + 5) GROUP BY 1"""


def sidecar_purge(spark: SparkSession, folder: str) -> DataFrame:
    f = tables.facts(spark, folder).withColumn("source_id", F.col("fact_id") % 50)
    kept = sidecar.purge(f, spark.createDataFrame([(3,), (17,)], "source_id long"))
    return kept.groupBy("predicate").agg(F.count("*").alias("facts"))


PURGE_SQL = f"WITH {tables.FACTS} SELECT predicate, count(*) AS facts FROM facts WHERE fact_id % 50 NOT IN (3, 17) AND (cause IS NULL OR cause % 50 NOT IN (3, 17)) GROUP BY 1"


def corpus_nonmembership(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the benchmark's words no document holds."""
    words = tables.query_texts(spark, folder).select(F.explode(T.tokens(F.col("text"))).alias("identifier")).distinct()
    return passages.absent(tables.documents(spark, folder), words)


ABSENT_SQL = "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS identifier FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS identifier FROM documents) SELECT identifier, identifier NOT IN (SELECT identifier FROM d) AS absent FROM w"


def year_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Years from each customer's only order year to the last one, as sentences tell them."""
    o = tables.table(spark, folder, "orders")
    year = F.year("o_orderdate").cast("string")
    said = o.select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("It began in "), year, F.lit("."))).otherwise(F.concat(F.lit("It closed in "), year, F.lit("."))).alias("text"))
    return passages.year_interval(said, ["o_custkey"], ("began",), ("closed",))


YEAR_SQL = """WITH g AS (SELECT o_custkey, count(DISTINCT year(o_orderdate)) FILTER (WHERE o_orderstatus = 'F') AS a, count(DISTINCT year(o_orderdate)) FILTER (WHERE o_orderstatus <> 'F') AS b, min(year(o_orderdate)) FILTER (WHERE o_orderstatus = 'F') AS s, min(year(o_orderdate)) FILTER (WHERE o_orderstatus <> 'F') AS e FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN a <> 1 OR b <> 1 THEN 'abstain' WHEN e < s THEN 'contested' ELSE 'resolved' END AS state, CASE WHEN a = 1 AND b = 1 AND e >= s THEN (e - s)::VARCHAR END AS value FROM g"""


def coordinated_count(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    said = li.select("l_orderkey", F.concat(F.lit("a box, "), q, F.lit(" bolts and "), F.when(F.col("l_linenumber") == 7, F.lit("some nuts")).otherwise(F.lit("two nuts"))).alias("said"))
    return passages.coordinated_count(said, ["l_orderkey"], "said")


COORDINATED_SQL = "WITH d AS (SELECT DISTINCT l_orderkey, l_quantity::INT AS q, l_linenumber = 7 AS odd FROM lineitem) SELECT l_orderkey, CASE WHEN bool_or(odd) THEN 'abstain' ELSE 'resolved' END AS state, CASE WHEN NOT bool_or(odd) THEN sum(q + 3)::BIGINT::VARCHAR END AS value FROM d GROUP BY 1"


def classed_money(spark: SparkSession, folder: str) -> DataFrame:
    found = measures.atoms(_notes(spark, folder), ["topic"])
    return passages.classed_sum(found, ["topic"], ["cost"])


CLASSED_SQL = f"WITH {NOTES}, d AS (SELECT DISTINCT topic, q FROM li WHERE q % 23 <> 0 AND q % 17 <> 0) SELECT topic, 'resolved' AS state, regexp_replace(sum(q * 3 + 0.5)::DECIMAL(18,1)::VARCHAR, '\\.0$', '') AS value, 'USD' AS unit, count(*) AS atoms FROM d GROUP BY 1"


def tenure_months(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.table(spark, folder, "part")
    return p.select("p_partkey", F.coalesce(passages.tenure(F.col("p_size") * 3, F.col("p_partkey") % 60), F.lit("abstain")).alias("tenure"))


def cashback(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem").filter("l_linenumber = 1")
    return li.groupBy("l_suppkey").agg(F.sum(passages.share_of(F.col("l_discount") * 100, F.col("l_extendedprice"))).cast("decimal(28,4)").cast("string").alias("cashback"))


def ledger_month_count(spark: SparkSession, folder: str) -> DataFrame:
    o = tables.table(spark, folder, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_custkey", "o_orderstatus")
    return passages.ledger_count(o, ["o_orderpriority", "month"], "o_custkey", o.filter("o_orderstatus = 'P' and o_custkey % 50 = 0"))


LEDGER_SQL = "WITH o AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, o_custkey, o_orderstatus = 'P' AND o_custkey % 50 = 0 AS bad FROM orders) SELECT o_orderpriority, month, CASE WHEN bool_or(bad) THEN 'abstain' ELSE 'resolved' END AS state, CASE WHEN NOT bool_or(bad) THEN count(DISTINCT o_custkey)::VARCHAR END AS value FROM o GROUP BY 1, 2"


def ledger_sum_veto(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals by customer; two orders of one price and nearly one text abstain."""
    li = tables.table(spark, folder, "lineitem")
    rows = li.select("l_suppkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("key"), F.col("l_quantity").alias("value"), F.concat_ws(" ", F.lit("sold lot"), F.col("l_orderkey").cast("string"), F.lit("of part"), F.col("l_partkey").cast("string")).alias("said"))
    return passages.ledger_sum(rows, ["l_suppkey"], "key", "value", 0.75)


VETO_SQL = """WITH r AS (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem), f AS (SELECT l_suppkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS key, min(l_quantity) AS v, any_value(l_orderkey) AS o, any_value(l_partkey) AS p FROM r GROUP BY 1, 2),
w AS (SELECT *, list_distinct(['sold', 'lot', 'of', 'part', o::VARCHAR, p::VARCHAR]) AS ws FROM f), t AS (SELECT DISTINCT a.l_suppkey FROM w a JOIN w b ON a.l_suppkey = b.l_suppkey AND a.v = b.v AND a.key < b.key WHERE len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) >= 0.75)
SELECT l_suppkey, CASE WHEN l_suppkey IN (SELECT l_suppkey FROM t) THEN 'abstain' ELSE 'resolved' END AS state, CASE WHEN l_suppkey NOT IN (SELECT l_suppkey FROM t) THEN sum(v)::BIGINT::VARCHAR END AS value, count(*) AS events FROM f GROUP BY 1"""

QUERIES = {
    "sidecar_admission": (sidecar_admission, ADMIT_SQL),
    "sidecar_active": (sidecar_active, ACTIVE_SQL),
    "sidecar_purge": (sidecar_purge, PURGE_SQL),
    "corpus_nonmembership": (corpus_nonmembership, ABSENT_SQL),
    "year_interval": (year_interval, YEAR_SQL),
    "coordinated_count": (coordinated_count, COORDINATED_SQL),
    "classed_money": (classed_money, CLASSED_SQL),
    "tenure_months": (tenure_months, "SELECT p_partkey, CASE WHEN p_size * 3 >= p_partkey % 60 THEN ((p_size * 3 - p_partkey % 60) // 12) || ' years ' || ((p_size * 3 - p_partkey % 60) % 12) || ' months' ELSE 'abstain' END AS tenure FROM part"),
    "cashback_share": (cashback, "SELECT l_suppkey, sum((l_discount * 100)::DECIMAL(18,4) * l_extendedprice::DECIMAL(18,4) / 100)::DECIMAL(28,4)::VARCHAR AS cashback FROM lineitem WHERE l_linenumber = 1 GROUP BY 1"),
    "ledger_month_count": (ledger_month_count, LEDGER_SQL),
    "ledger_sum_veto": (ledger_sum_veto, VETO_SQL),
}
