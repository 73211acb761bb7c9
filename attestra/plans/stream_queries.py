"""Registered queries that run as streams: the events table is read as a stream to its end, and the result equals the batch's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators.graphs import shared_folder
from attestra.plans import measure_queries, tables
from attestra.streaming import epochs, windows


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = tables.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _run(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there into a table of the shared folder; a complete result is written whole by each batch, and the last one counts."""
    name = f"attestra_{uuid.uuid4().hex}"
    root = f"{shared_folder(spark).rstrip('/')}/{name}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{root}/rows").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/rows")
    last: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={epoch}")
        last[:] = [epoch]

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/rows/batch={last[0]}") if last else spark.createDataFrame([], df.schema)


def _clocked(events: DataFrame) -> DataFrame:
    return events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def stream_tumbling_window(spark: SparkSession, folder: str) -> DataFrame:
    found = windows.tumbling(_clocked(_stream(spark, folder)), "ts", "1 hour", ["event_type"], "cents", "2 hours")
    return _run(spark, found, "complete").select(F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "event_type", "n", "total")


def stream_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """First rows of each event id, with ids remembered for as long as the watermark allows."""
    found = windows.deduplicated(_clocked(_stream(spark, folder)), "ts", ["event_id"], "1 hour")
    return _run(spark, found.select("event_id", "event_type"), "append")


def stream_ordered_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Per user, values of a clock that may not stand still: equal seconds of one user are rejected but for the first."""
    rows = _clocked(_stream(spark, folder)).select("user_id", F.floor(F.unix_seconds("ts") / 3600).cast("bigint").alias("hour"), F.col("event_id").cast("double").alias("value"))
    found = _run(spark, epochs.ordered_ingest(rows, "user_id", "hour", "value"), "append")
    return found.groupBy("user_id", "state").agg(F.count("*").alias("n"))


ORDERED_SQL = "WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 3600 ORDER BY event_id) AS k FROM events) SELECT user_id, CASE WHEN k = 1 THEN 'accepted' ELSE 'rejected_out_of_order' END AS state, count(*) AS n FROM r GROUP BY 1, 2"


def stream_epoch_boundary(spark: SparkSession, folder: str) -> DataFrame:
    """Signed evidence folded epoch by epoch through foreachBatch; the last boundary, settled."""
    e = _stream(spark, folder)
    rows = e.select(F.col("event_type").alias("scope"), (F.col("user_id") % 25).cast("string").alias("canonical"), F.col("event_id").alias("fact_id"), (F.col("value") - 40).alias("amplitude"), (F.col("value") > 485).alias("hard_negative"))
    root = f"{shared_folder(spark).rstrip('/')}/attestra_{uuid.uuid4().hex}"
    last: list[int] = []
    fold = epochs.boundary_writer(spark, f"{root}/boundary")

    def write(batch: DataFrame, epoch: int) -> None:
        fold(batch, epoch)
        last[:] = [epoch]

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return epochs.settle(epochs.boundary(spark, f"{root}/boundary", last[0] if last else 0))


QUERIES = {
    "stream_tumbling_window": (stream_tumbling_window, measure_queries.QUERIES["tumbling_window"][1]),
    "stream_deduplicated": (stream_deduplicated, "SELECT event_id, event_type FROM events"),
    "stream_ordered_ingest": (stream_ordered_ingest, ORDERED_SQL),
    "stream_epoch_boundary": (stream_epoch_boundary, measure_queries.EPOCH_SQL),
}
