"""Databases as Spark sources.

JDBC kinds read in parallel by ranges of a numeric key. For databases without a driver on the class path, and for document
stores, a Python data source reads pages by keyset: every page asks for what follows the last key, so resuming and
partitioning never skip or repeat rows. Client libraries are imported where they are used.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

JDBC_KINDS = ("postgresql", "mysql", "sqlite", "duckdb")
PAGE = 256
SECRET_WORDS = ("password", "token", "secret", "apikey")


def jdbc(spark: SparkSession, kind: str, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """Read-only JDBC scan; with a numeric key and its bounds, one range of keys for each partition."""
    if kind not in JDBC_KINDS:
        raise ValueError(f"not a JDBC kind: {kind}")
    if any(w in url.lower() for w in SECRET_WORDS):
        raise ValueError("secrets belong in properties, not in the url")
    if key and bounds:
        return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


class KeyRange(InputPartition):
    def __init__(self, low: Any, high: Any) -> None:
        self.low, self.high = low, high


class PagedReader(DataSourceReader):
    """Pages of a keyed collection; subclasses give bounds and pages."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.fields = [f.name for f in schema.fields]
        self.options = options
        self.key = options["key"]

    def bounds(self) -> tuple[int, int] | None:
        return None

    def page(self, after: Any, high: Any, size: int) -> list[dict]:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        found = self.bounds()
        n = int(self.options.get("partitions", "4"))
        if not found:
            return [KeyRange(None, None)]
        low, high = found
        width = max(1, -(-(high - low + 1) // n))
        return [KeyRange(a - 1, min(a + width - 1, high)) for a in range(low, high + 1, width)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        last, size = partition.low, int(self.options.get("page", str(PAGE)))
        while True:
            rows = self.page(last, partition.high, size)
            for row in rows:
                yield tuple(row.get(f) for f in self.fields)
            if len(rows) < size:
                return
            if rows[-1][self.key] == last:
                raise RuntimeError("a page made no progress")
            last = rows[-1][self.key]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqlPages(PagedReader):
    """A table of a database file, by a connection that `connect` opens read-only."""

    def connect(self):
        raise NotImplementedError

    def _rows(self, sql: str, values: list) -> list[dict]:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(sql, values)
            names = [d[0] for d in cursor.description]
            return [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]
        finally:
            connection.close()

    def bounds(self) -> tuple[int, int] | None:
        row = self._rows(f"SELECT min({_quoted(self.key)}) AS low, max({_quoted(self.key)}) AS high FROM {_quoted(self.options['table'])}", [])[0]
        return (row["low"], row["high"]) if isinstance(row["low"], int) and isinstance(row["high"], int) else None

    def page(self, after: Any, high: Any, size: int) -> list[dict]:
        where, values = [], []
        if after is not None:
            where.append(f"{_quoted(self.key)} > ?")
            values.append(after)
        if high is not None:
            where.append(f"{_quoted(self.key)} <= ?")
            values.append(high)
        columns = ", ".join(_quoted(c) for c in dict.fromkeys([*self.fields, self.key]))
        return self._rows(f"SELECT {columns} FROM {_quoted(self.options['table'])} {'WHERE ' + ' AND '.join(where) if where else ''} ORDER BY {_quoted(self.key)} LIMIT {int(size)}", values)


class SqliteReader(SqlPages):
    def connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)


class DuckdbReader(SqlPages):
    def connect(self):
        import duckdb

        return duckdb.connect(self.options["path"], read_only=True)


class MongoReader(PagedReader):
    def page(self, after: Any, high: Any, size: int) -> list[dict]:
        import pymongo

        with pymongo.MongoClient(self.options["uri"]) as client:
            found = client[self.options["database"]][self.options["table"]].find({self.key: {"$gt": after}} if after is not None else {}, {f: 1 for f in [*self.fields, self.key]}).sort(self.key, 1).limit(size)
            return [dict(row) for row in found]


class ElasticReader(PagedReader):
    def page(self, after: Any, high: Any, size: int) -> list[dict]:
        import urllib.request

        body: dict[str, Any] = {"size": size, "query": {"match_all": {}}, "sort": [{self.key: "asc"}], "_source": sorted({*self.fields, self.key})}
        if after is not None:
            body["search_after"] = [after]
        request = urllib.request.Request(f"{self.options['uri']}/{self.options['table']}/_search", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=60) as answer:
            return [hit["_source"] for hit in json.load(answer)["hits"]["hits"]]


class SpacetimeReader(PagedReader):
    def page(self, after: Any, high: Any, size: int) -> list[dict]:
        import urllib.request

        where = f" WHERE {_quoted(self.key)} > {json.dumps(after)}" if after is not None else ""
        sql = f"SELECT * FROM {_quoted(self.options['table'])}{where} ORDER BY {_quoted(self.key)} LIMIT {int(size)}"
        with urllib.request.urlopen(urllib.request.Request(f"{self.options['uri']}/sql", sql.encode()), timeout=60) as answer:
            return json.load(answer)[0]["rows"]


class DynamoReader(PagedReader):
    """Scans by segment; the service's own position resumes a page."""

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", "4"))
        return [KeyRange(k, n) for k in range(n)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        import boto3

        table, start, before = boto3.resource("dynamodb").Table(self.options["table"]), None, object()
        while True:
            answer = table.scan(Segment=partition.low, TotalSegments=partition.high, Limit=PAGE, **({"ExclusiveStartKey": start} if start else {}))
            for item in answer["Items"]:
                yield tuple(item.get(f) for f in self.fields)
            start = answer.get("LastEvaluatedKey")
            if not start:
                return
            if start == before:
                raise RuntimeError("a page made no progress")
            before = start


class RedisReader(PagedReader):
    """String values under a key prefix; a SCAN may repeat keys, so they are told apart here."""

    def partitions(self) -> list[InputPartition]:
        return [KeyRange(None, None)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        import redis

        client, cursor, seen = redis.Redis.from_url(self.options["uri"]), 0, set()
        while True:
            cursor, keys = client.scan(cursor=cursor, match=f"{self.options.get('prefix', '')}*", count=PAGE)
            for key in keys:
                if key not in seen:
                    seen.add(key)
                    value = client.get(key)
                    if value is not None:
                        row = {self.key: key.decode(), "value": value.decode()}
                        yield tuple(row.get(f) for f in self.fields)
            if cursor == 0:
                return


READERS = {"sqlite": SqliteReader, "duckdb": DuckdbReader, "mongodb": MongoReader, "elasticsearch": ElasticReader, "spacetimedb": SpacetimeReader, "dynamodb": DynamoReader, "redis": RedisReader}


class PagedSource(DataSource):
    """format("attestra_pages"), options kind, path or uri, table, key, page, partitions; the schema is the caller's."""

    @classmethod
    def name(cls) -> str:
        return "attestra_pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return READERS[self.options["kind"]](schema, dict(self.options))


def pages(spark: SparkSession, kind: str, schema: str, **options: str) -> DataFrame:
    """A paged source as a DataFrame."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of source: {kind}")
    spark.dataSource.register(PagedSource)
    return spark.read.format("attestra_pages").schema(schema).options(kind=kind, **options).load()


def sample(df: DataFrame, rows: int = 50) -> DataFrame:
    """A preview of a source."""
    return df.limit(min(rows, 50))


def after(df: DataFrame, key: str, last: Any) -> DataFrame:
    """What a resumed sync still has to read."""
    return df if last is None else df.filter(df[key] > last)
