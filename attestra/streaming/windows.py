"""Windows over event time. Each function takes a batch or a stream; a stream gets a watermark, so state is dropped once late data are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _clocked(df: DataFrame, clock: str, late: str | None) -> DataFrame:
    return df.withWatermark(clock, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, clock: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    found = _clocked(df, clock, late).groupBy(F.window(clock, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sliding(df: DataFrame, clock: str, width: str, step: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    found = _clocked(df, clock, late).groupBy(F.window(clock, width, step), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, clock: str, gap: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    found = _clocked(df, clock, late).groupBy(F.session_window(clock, gap), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n", "total")


def deduplicated(df: DataFrame, clock: str, keys: list[str], late: str) -> DataFrame:
    """First rows of each key; on a stream, keys are remembered as long as the watermark allows."""
    return df.withWatermark(clock, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
