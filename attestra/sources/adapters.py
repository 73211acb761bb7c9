"""Adapters from JSON, logs, JSON lines and files to typed facts and documents, and the sinks that write them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pointer_path(pointer: str) -> str:
    """A JSON pointer (RFC 6901) as a JSON path."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer begins with a slash")
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)


def json_value(content: Column, pointer: str) -> Column:
    """The leaf that a pointer names, as text; null where there is none."""
    return F.get_json_object(content, pointer_path(pointer))


def _no_duplicates(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("duplicate key")
    return out


def json_facts(df: DataFrame, key: str, content: str, pointer: str, unit_pointer: str | None = None) -> DataFrame:
    """(key, value, unit, start, end, state): a leaf with its exact span of code points. Malformed content, duplicate keys, a
    missing leaf and a leaf that is no scalar are states of their own, not errors."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]
    unit_steps = [s.replace("~1", "/").replace("~0", "~") for s in unit_pointer.split("/")[1:]] if unit_pointer else None

    def walk(doc, path):
        for s in path:
            doc = doc[int(s)] if isinstance(doc, list) else doc[s]
        return doc

    def skip(text: str, at: int) -> int:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        return at

    def span(text: str) -> tuple[int, int]:
        """Follows the pointer through the text itself, value by value."""
        scan, at = json.JSONDecoder(), skip(text, 0)
        for s in steps:
            inside, index = text[at] == "{", 0
            at = skip(text, at + 1)
            while True:
                if inside:
                    name, at = scan.raw_decode(text, at)
                    at = skip(text, skip(text, at) + 1)
                if (name == s) if inside else (index == int(s)):
                    break
                _, at = scan.raw_decode(text, at)
                at = skip(text, skip(text, at) + 1)
                index += 1
        _, end = scan.raw_decode(text, at)
        return (at + 1, end - 1) if text[at] == '"' else (at, end)

    def one(text: str | None) -> tuple:
        try:
            doc = json.loads(text, object_pairs_hook=_no_duplicates)
            leaf = walk(doc, steps)
            if isinstance(leaf, (dict, list)) or leaf is None:
                return None, None, None, None, "not_a_scalar"
            a, b = span(text)
            return text[a:b], str(walk(doc, unit_steps)) if unit_steps else "", a, b, "resolved"
        except (KeyError, IndexError):
            return None, None, None, None, "missing_leaf"
        except (ValueError, TypeError) as problem:
            return None, None, None, None, "duplicate_key" if "duplicate" in str(problem) else "malformed"

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(t) for t in pdf[content]]
            yield pd.DataFrame({key: pdf[key].to_numpy(), **{name: pd.Series([r[i] for r in rows], dtype=kind) for i, (name, kind) in enumerate((("value", "object"), ("unit", "object"), ("start", "Int64"), ("end", "Int64"), ("state", "object")))}})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInPandas(over, f"`{key}` {kind}, value string, unit string, start long, end long, state string")


def log_facts(lines: DataFrame, key: str, content: str, pattern: str, value_group: int, clock_group: int | None = None, max_matches: int | None = None) -> DataFrame:
    """(key, line, start, value, clock) of each line that a pattern matches; start: the line's place in its content."""
    rows = lines.select(key, F.posexplode(F.split(content, "\n")).alias("line", "said"), F.col(content).alias("whole"))
    sizes = F.transform(F.slice(F.split("whole", "\n"), F.lit(1), F.col("line")), lambda x: F.char_length(x) + 1)
    hits = rows.filter(F.col("said").rlike(pattern)).select(key, "line", F.aggregate(sizes, F.lit(0), lambda a, x: a + x).alias("start"), F.regexp_extract("said", pattern, value_group).alias("value"), (F.regexp_extract("said", pattern, clock_group).try_cast("timestamp") if clock_group else F.lit(None).cast("timestamp")).alias("clock"))
    if max_matches is None:
        return hits
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("line"))).filter(F.col("_k") <= max_matches).drop("_k")


def jsonl_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, text, lines): JSON lines with unique `_id`; `lines` over 1 shows a repeated one."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    return rows.groupBy(F.col("_id").alias("external_id")).agg(F.min(F.concat_ws(" ", "title", "text")).alias("text"), F.count("*").alias("lines"))


def file_chunks(spark: SparkSession, path: str, size: int = 4096) -> DataFrame:
    """(path, sha256, start, chunk): byte ranges of files with their file's digest."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"), "length")
    starts = files.select("path", "sha256", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("bigint"))).alias("start"))
    return starts.select("path", "sha256", "start", F.expr(f"substring(content, cast(start + 1 as int), {size})").alias("chunk"))


def declared(df: DataFrame, content: str, start: str, end: str, value: str) -> DataFrame:
    """Declarations whose span of the content is exactly the declared value."""
    return df.filter(F.expr(f"substring({content}, {start} + 1, {end} - {start})") == F.col(value))


def evidence_block(df: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """Each group's texts as one guarded block: angle brackets and ampersands are written as references."""
    safe = F.replace(F.replace(F.replace(F.col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = df.select(*by, F.struct(*order, safe.alias("_t")).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(F.lit("<evidence>"), s["_t"], F.lit("</evidence>")))
    return rows.groupBy(*by).agg(F.array_join(listed, "\n").alias("block"))


def hash_chain(df: DataFrame, by: list[str], order: str, payload: str) -> DataFrame:
    """(by, order, digest): each record's digest covers the one before it in its ledger. A fold over a ledger's ordered records."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(payload).alias("p")))).alias("xs"))
    start = F.struct(F.lit("").alias("last"), F.expr("cast(array() as array<string>)").alias("all"))
    step = lambda acc, x: F.sha2(F.concat_ws("|", acc["last"], x["o"].cast("string"), x["p"]), 256)
    chained = rows.withColumn("c", F.aggregate("xs", start, lambda acc, x: F.struct(step(acc, x).alias("last"), F.concat(acc["all"], F.array(step(acc, x))).alias("all"))))
    return chained.select(*by, F.explode(F.arrays_zip(F.col("xs.o").alias("o"), F.col("c.all").alias("d"))).alias("z")).select(*by, F.col("z.o").alias(order), F.col("z.d").alias("digest"))


def managed_namespace(df: DataFrame, path: str, granted: bool) -> None:
    """Appends documents to a managed table, with an explicit grant only."""
    if not granted:
        raise PermissionError("writing needs an explicit grant")
    columns = ["fact_id", "text", "source", "session_id", "sequence", "event_time", "role", "speaker", "version"]
    df.select(*columns, F.sha2("text", 256).alias("sha256"), F.current_timestamp().alias("created_at")).write.mode("append").parquet(path)


def content_addressed(df: DataFrame, blob: str) -> DataFrame:
    """Each distinct blob once, under its digest."""
    return df.groupBy(F.sha2(blob, 256).alias("path")).agg(F.first(blob).alias("blob"))
