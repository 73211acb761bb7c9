"""From source rows to documents: which connector a uri means, which columns mean what, and the row mapping itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TEXT_BYTES = 128 * 1024
ROLES = ("user", "assistant", "system", "tool")
#: What a uri's scheme or a file's ending says about its connector. Plain http says nothing.
SCHEMES = {
    "sqlite": "sqlite", "duckdb": "duckdb", "postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mariadb": "mysql", "mongodb": "mongodb", "mongodb+srv": "mongodb",
    "redis": "redis", "rediss": "redis", "dynamodb": "dynamodb", "elasticsearch": "elasticsearch", "opensearch": "elasticsearch", "spacetimedb": "spacetimedb",
}
ENDINGS = {".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite", ".duckdb": "duckdb", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".log": "log", ".parquet": "parquet"}
#: Column names that suggest a meaning, most telling first; the last ones of a field are further spellings.
HINTS = {
    "id_field": ("id", "_id", "uuid", "key", "pk", "message_id", "doc_id"), "text_field": ("text", "content", "message", "body", "value", "description"), "source_field": ("source", "source_id", "origin", "channel"),
    "session_field": ("session", "session_id", "thread_id", "conversation_id", "conv_id"), "sequence_field": ("sequence", "seq", "turn_index", "turn", "position", "index"), "event_time_field": ("event_time", "timestamp", "created_at", "date", "ts"),
    "role_field": ("role", "author_role", "sender_type"), "speaker_field": ("speaker", "author", "user_name", "name", "sender"), "version_field": ("version", "revision", "rev"),
}


def detect(uri: Column) -> Column:
    """The connector kind of a uri; null where it is ambiguous."""
    low = F.lower(F.trim(uri))
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*)://", 1)
    out = F.lit(None).cast("string")
    for ending, kind in reversed(ENDINGS.items()):
        out = F.when(low.endswith(ending) & ~scheme.isin("http", "https"), kind).otherwise(out)
    for name, kind in reversed(SCHEMES.items()):
        out = F.when(scheme == name, kind).otherwise(out)
    return out


@dataclass(frozen=True)
class Mapping:
    """Which column of a source is which field of a document."""

    namespace: str
    id_field: str
    text_field: str
    source_field: str | None = None
    session_field: str | None = None
    sequence_field: str | None = None
    event_time_field: str | None = None
    role_field: str | None = None
    speaker_field: str | None = None
    version_field: str | None = None


def suggest(namespace: str, columns: list[str], primary_keys: list[str] = ()) -> Mapping | None:
    """A mapping by column names; None where an id or a text cannot be told, which needs a user's choice."""
    low = {c.lower(): c for c in columns}
    found = {field: next((low[h] for h in hints if h in low), None) for field, hints in HINTS.items()}
    if len(primary_keys) == 1:
        found["id_field"] = primary_keys[0]
    if not found["id_field"] or not found["text_field"]:
        return None
    return Mapping(namespace, **found)


def typed_key(df: DataFrame, field: str) -> Column:
    """A key with its type, so that 1 and '1' never are one record."""
    kind = df.schema[field].dataType.simpleString()
    tag = "i" if kind in ("tinyint", "smallint", "int", "bigint") else "s" if kind == "string" else "b" if kind == "binary" else "f" if kind in ("float", "double") or kind.startswith("decimal") else "o"
    value = F.base64(field) if kind == "binary" else F.col(field).cast("string")
    return F.concat(F.lit(f"{tag}:"), value)


def event_day(df: DataFrame, field: str) -> Column:
    """The UTC day as a proleptic ordinal, from an ISO text, a timestamp, a date or Unix seconds."""
    kind = df.schema[field].dataType.simpleString()
    if kind == "string":
        day = F.to_date(F.coalesce(F.col(field).try_cast("timestamp"), F.col(field).try_cast("date").cast("timestamp")))
    elif kind in ("int", "bigint", "double", "float", "smallint"):
        day = F.to_date(F.timestamp_seconds(F.col(field)))
    else:
        day = F.to_date(F.col(field))
    return (F.date_diff(day, F.lit("0001-01-01").cast("date")) + 1).cast("bigint")


def map_records(df: DataFrame, mapping: Mapping, scope_id: int = 1) -> DataFrame:
    """Documents of the mapped rows: a stable 62-bit id of namespace and typed key, exact text, its digest and what else is mapped.
    `rejected` says why a row is none: no key, no text, too long, a wrong role."""
    take = lambda field, kind: F.col(field).cast(kind) if field else F.lit(None).cast(kind)
    key = typed_key(df, mapping.id_field)
    text = F.col(mapping.text_field).cast("string")
    digest = F.sha2(F.concat_ws("\x1f", F.lit(mapping.namespace), key), 256)
    fact_id = (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(1 << 62).cast("decimal(20,0)")).cast("bigint")
    role = F.lower(take(mapping.role_field, "string"))
    why = (
        F.when(F.col(mapping.id_field).isNull(), "missing_key")
        .when(text.isNull() | (F.trim(text) == ""), "missing_text")
        .when(F.octet_length(text) > MAX_TEXT_BYTES, "text_too_long")
        .when(role.isNotNull() & ~role.isin(*ROLES), "unknown_role")
    )
    return df.select(
        fact_id.alias("fact_id"), text.alias("text"), F.lit(scope_id).cast("bigint").alias("scope_id"), F.coalesce(take(mapping.session_field, "string"), F.lit(mapping.namespace)).alias("session_id"),
        F.coalesce(take(mapping.version_field, "bigint"), F.lit(1).cast("bigint")).alias("version"), F.coalesce(take(mapping.source_field, "string"), F.lit(mapping.namespace)).alias("source"), take(mapping.sequence_field, "bigint").alias("sequence"),
        role.alias("role"), (event_day(df, mapping.event_time_field) if mapping.event_time_field else F.lit(None).cast("bigint")).alias("event_time"), take(mapping.speaker_field, "string").alias("speaker"),
        key.alias("source_primary_key"), F.sha2(text, 256).alias("content_sha256"), why.alias("rejected"),
    )


def collisions(batch: DataFrame) -> DataFrame:
    """Ids that one batch maps from different keys: an error for a sync."""
    return batch.groupBy("fact_id").agg(F.count_distinct("source_primary_key").alias("keys")).filter("keys > 1")
