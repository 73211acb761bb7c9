"""Every registered query with its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestra.plans import answer_queries, diary_queries, discourse_queries, fact_queries, log_queries, measure_queries, observe_queries, proof_queries, search_queries, sidecar_queries, stream_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
#: name: (query, SQL or None)
ALL: dict[str, tuple[Query, str | None]] = {**fact_queries.QUERIES, **log_queries.QUERIES, **text_queries.QUERIES, **measure_queries.QUERIES, **discourse_queries.QUERIES, **answer_queries.QUERIES, **sidecar_queries.QUERIES, **proof_queries.QUERIES, **search_queries.QUERIES, **diary_queries.QUERIES, **observe_queries.QUERIES, **stream_queries.QUERIES}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return ALL["lookup_latest"][0](spark, folder)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
