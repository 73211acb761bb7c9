"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record's score in shard s is ln(u) / weight(s), u in (0, 1) from a digest of its key and s; it goes where the score is
highest. With one more shard only the records whose new score is the highest move, all of them into that shard. Everything
is DataFrame expressions; the shard depends on the key, the shard numbers and the weights alone.

Slots number a shard's records from 0 without gaps, by key: the records are scored once and written to the shared folder, range-partitioned
by shard, key and reading position, so that even a single key with a large share of all rows is split over tasks, written
again, and a small table of where each shard's part of a partition begins turns positions into slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import materialize

OVERHEAD = 16


def score(key: Column, shard: Column, weight: Column | float = 1.0) -> Column:
    """52 bits of the digest of `key:shard` as the middle of a cell of (0, 1), then ln(u) / weight."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", key, shard.cast("string"))), 1, 13), 16, 10).cast("bigint")
    return F.log((drawn + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def place(key: Column, weights: Sequence[float]) -> Column:
    """Struct (score, shard) of the best shard; equal scores go to the higher number."""
    held = F.array(*[F.lit(float(w)) for w in weights])
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda s: F.struct(score(key, s, F.get(held, s)).alias("score"), s.alias("shard"))))


def shard_rows(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0, columns: Sequence[str] = ()) -> DataFrame:
    """(key, *columns, size, text_crc32, law, shard, slot, grown_shard) for every row of df.

    size is the text's UTF-8 bytes (null: none) plus 16, and the checksum of a null text is that of an empty one. Rows
    without a key use their text's digest in its place. Repeated rows share a shard and take neighbouring slots. An empty
    table gives no rows; texts of any length are measured whole; at least one shard and positive weights are needed. `columns` names further columns to carry,
    none of them called like a result.
    """
    if not weights or min(*weights, grown_weight) <= 0:
        raise ValueError("shards need positive weights")
    n = len(weights)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("k"),
        *columns,
        (F.octet_length(content).cast("long") + F.lit(OVERHEAD)).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(key).cast("string"), F.concat(F.lit("#"), F.md5(content))).alias("name"),
    )
    rows = rows.withColumn("best", place(F.col("name"), weights))
    more = score(F.col("name"), F.lit(n), grown_weight)
    rows = rows.withColumn("shard", F.col("best.shard")).withColumn("grown_shard", F.when(more >= F.col("best.score"), F.lit(n)).otherwise(F.col("shard")))
    # ranges are drawn from a sample of the rows: what is written is not scored again for it
    rows = materialize(rows.drop("best", "name").withColumn("read", F.monotonically_increasing_id()), "scored")
    parts = rows.repartitionByRange("shard", "k", "read").sortWithinPartitions("shard", "k", "read").withColumn("at", F.monotonically_increasing_id())
    placed = materialize(parts.drop("read"), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    begins = placed.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = begins.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # as many rows as there are partitions and shards together, whatever the number of records
    out = placed.join(F.broadcast(begins), ["part", "shard"])
    return out.select(F.col("k").alias(key), *columns, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")


#: The same rows in DuckDB: 40 equal shards over documents.
SQL = """
WITH RECURSIVE polynomial AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))
), docs AS (
  SELECT doc_id, coalesce(text, '') AS content, row_number() OVER () AS rid FROM documents
), scored AS (
  SELECT rid, s, ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '#' || md5(content)) || ':' || s), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS score
  FROM docs, range(41) r(s)
), best AS (
  SELECT rid, arg_max(s, score) FILTER (WHERE s < 40) AS shard, arg_max(s, score) AS grown FROM scored GROUP BY rid
)
SELECT d.doc_id, (strlen(content) + 16)::BIGINT AS size,
  xor(CASE WHEN content = '' THEN 4294967295 ELSE list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(content)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, p.t[(xor(c, b) & 255) + 1])) END, 4294967295)::BIGINT AS text_crc32,
  'key' AS law, b.shard::INT AS shard, (row_number() OVER (PARTITION BY b.shard ORDER BY d.doc_id, d.rid) - 1)::BIGINT AS slot, b.grown::INT AS grown_shard
FROM docs d JOIN best b USING (rid), polynomial p
"""
