"""The engine's data model over the parquet tables in a folder, with the same views in SQL.

Every view is a narrow projection, so scans read only the columns that a query uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Typed facts from `events`: a reported value of (user, kind) with versions, orbits, polarity and causes."""
    e = table(spark, folder, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    cents = F.round(F.col("value") * 100).cast("bigint")
    subject = F.concat(F.lit("user:"), F.col("user_id").cast("string"))
    day = F.floor(at / 86400).cast("bigint")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(
        F.col("event_id").alias("fact_id"),
        F.lit("app").alias("scope"),
        subject.alias("subject"),
        F.col("event_type").alias("predicate"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("plan"), (cents % 4).cast("string"))).otherwise(cents.cast("string")).alias("value"),
        F.when(F.col("event_type") == "signup", "").when((F.col("event_type") == "view") & (F.col("event_id") % 97 == 0), "msec").when(F.col("event_type") == "view", "sec").otherwise("cent").alias("unit"),
        F.when(F.col("event_id") % 11 == 0, -1).otherwise(1).cast("int").alias("polarity"),
        (F.col("event_id") % 53 != 0).alias("asserted"),
        at.alias("observed_at"),
        day.alias("event_time"),
        (1 + F.col("event_id") % 3).alias("version"),
        F.concat_ws(":", subject, "event_type", F.floor(day / 2).cast("bigint").cast("string")).alias("event_id"),
        F.when(before.isNull(), F.expr("cast(array() as array<bigint>)")).otherwise(F.array(before)).alias("causes"),
    )


FACTS = """facts AS (
  SELECT event_id AS fact_id, 'app' AS scope, 'user:' || user_id AS subject, event_type AS predicate,
    CASE WHEN event_type = 'signup' THEN 'plan' || (cents % 4) ELSE cents::VARCHAR END AS value,
    CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'view' AND event_id % 97 = 0 THEN 'msec' WHEN event_type = 'view' THEN 'sec' ELSE 'cent' END AS unit,
    CASE WHEN event_id % 11 = 0 THEN -1 ELSE 1 END AS polarity, event_id % 53 <> 0 AS asserted, sec AS observed_at, sec // 86400 AS event_time, 1 + event_id % 3 AS version,
    'user:' || user_id || ':' || event_type || ':' || (sec // 86400 // 2) AS orbit,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS cause
  FROM (SELECT *, round(value * 100)::BIGINT AS cents, floor(epoch(ts))::BIGINT AS sec FROM events)
)"""


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Role-labelled event records from `events`, with the number in `props` as a second quantity."""
    e = table(spark, folder, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"),
        F.lit("app").alias("scope"),
        F.col("event_type").alias("predicate"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("bucket"), (F.col("user_id") % 7).cast("string")).alias("roles"),
        F.col("event_id").alias("fact_id"),
        F.floor(at / 86400).cast("bigint").alias("event_time"),
        at.alias("report_time"),
        F.lit(1).cast("bigint").alias("version"),
        F.when(F.col("event_id") % 11 == 0, "negative").otherwise("positive").alias("polarity"),
        F.when(F.col("event_id") % 53 == 0, "hedged").otherwise("asserted").alias("modality"),
        F.array(
            F.struct(F.lit("amount").alias("kind"), F.round(F.col("value") * 100).cast("decimal(38,6)").alias("value"), F.lit("cent").alias("unit")),
            F.struct(F.lit("length").alias("kind"), k.cast("decimal(38,6)").alias("value"), F.when(F.col("event_id") % 5 == 0, "week").otherwise("day").alias("unit")),
        ).alias("quantities"),
    )


RECORDS = """records AS (
  SELECT lpad(event_id::VARCHAR, 12, '0') AS event_id, 'app' AS scope, event_type AS predicate, user_id::VARCHAR AS role_user, (user_id % 7)::VARCHAR AS role_bucket, event_id AS fact_id,
    floor(epoch(ts))::BIGINT // 86400 AS event_time, floor(epoch(ts))::BIGINT AS report_time,
    CASE WHEN event_id % 11 = 0 THEN 'negative' ELSE 'positive' END AS polarity, CASE WHEN event_id % 53 = 0 THEN 'hedged' ELSE 'asserted' END AS modality,
    round(value * 100)::DECIMAL(38,6) AS amount, (props->>'$.k')::DECIMAL(38,6) AS length, CASE WHEN event_id % 5 = 0 THEN 'week' ELSE 'day' END AS length_unit
  FROM events
)"""


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Text documents with their scope and session from `documents`."""
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("fact_id"), "text", F.lit(1).cast("bigint").alias("scope_id"), F.col("lang").alias("session_id"), F.lit(1).cast("bigint").alias("version"), "source")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as documents: the session is the conversation, the sequence its turn."""
    c = table(spark, folder, "conversations")
    return c.select((F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("fact_id"), F.col("text"), F.lit(1).cast("bigint").alias("scope_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("bigint").alias("sequence"), F.col("role"))


TURNS = """turns AS (
  SELECT (1000000000 + conv_id * 1000 + turn)::BIGINT AS fact_id, text, conv_id::VARCHAR AS session_id, turn::BIGINT AS sequence, role FROM conversations
)"""


def query_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark's items as questions to retrieve for."""
    return table(spark, folder, "benchmark").select(F.col("item_id").cast("bigint").alias("query_id"), "text")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Binary relations as authorized facts: customer and supplier in nation, nation in region."""
    parts = [
        table(spark, folder, "nation").select(F.lit("in_region").alias("predicate"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("a0"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("a1"), F.col("n_nationkey").cast("bigint").alias("fact_id")),
        table(spark, folder, "customer").select(F.lit("customer_of").alias("predicate"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("a0"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("a1"), (F.lit(1_000_000) + F.col("c_custkey")).cast("bigint").alias("fact_id")),
        table(spark, folder, "supplier").select(F.lit("supplier_of").alias("predicate"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("a0"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("a1"), (F.lit(2_000_000_000) + F.col("s_suppkey")).cast("bigint").alias("fact_id")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


EDGES = """edges AS (
  SELECT 'in_region' AS predicate, 'nation:' || n_nationkey AS a0, 'region:' || n_regionkey AS a1, n_nationkey::BIGINT AS fact_id FROM nation
  UNION ALL SELECT 'customer_of', 'customer:' || c_custkey, 'nation:' || c_nationkey, (1000000 + c_custkey)::BIGINT FROM customer
  UNION ALL SELECT 'supplier_of', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, (2000000000 + s_suppkey)::BIGINT FROM supplier
)"""


def op_log(spark: SparkSession, folder: str) -> DataFrame:
    """A key-value operation log from `events`: seq, op, key, version, value 0..255 and a client's operation id, some repeated."""
    e = table(spark, folder, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return e.select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"),
        (F.col("user_id") * 5 + F.col("event_id") % 5).alias("fact_id"),
        (1 + F.floor(F.col("event_id") / 400) + F.col("event_id") % 2).cast("bigint").alias("version"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(cents % 4).cast("bigint").alias("value"),
        F.when(F.col("event_id") % 17 == 0, F.floor(F.col("event_id") / 34) * 34).otherwise(F.col("event_id")).cast("bigint").alias("operation_id"),
    )


OP_LOG = """op_log AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, user_id * 5 + event_id % 5 AS fact_id,
    (1 + event_id // 400 + event_id % 2)::BIGINT AS version, CASE WHEN event_type = 'error' THEN NULL ELSE round(value * 100)::BIGINT % 4 END AS value,
    CASE WHEN event_id % 17 = 0 THEN event_id // 34 * 34 ELSE event_id END AS operation_id
  FROM events
)"""
