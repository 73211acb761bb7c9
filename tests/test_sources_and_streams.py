"""Connectors over real files, adapters, and streams run to their end."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from attestra.sources import adapters, databases, mapping
from attestra.streaming import epochs, windows


def test_sqlite_pages_read_every_row_once(spark, tmp_path):
    path = str(tmp_path / "x.sqlite")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "note" (id INTEGER PRIMARY KEY, body TEXT)')
        con.executemany("INSERT INTO note VALUES (?, ?)", [(i * 3, f"n{i}") for i in range(1000)])
    df = databases.pages(spark, "sqlite", "id long, body string", path=path, table="note", key="id", page="64")
    assert sorted((r.id, r.body) for r in df.collect()) == [(i * 3, f"n{i}") for i in range(1000)]
    assert databases.after(df, "id", 2900).count() == 33
    assert databases.sample(df, 500).count() == 50


def test_duckdb_pages_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "x.duckdb")
    con = duckdb.connect(path)
    con.execute("CREATE TABLE t AS SELECT i AS id, i * i AS sq FROM range(10) r(i)")
    con.execute("CREATE TABLE none (id BIGINT, sq BIGINT)")
    con.close()
    assert databases.pages(spark, "duckdb", "id long, sq long", path=path, table="t", key="id").agg(F.sum("sq")).first()[0] == 285
    assert databases.pages(spark, "duckdb", "id long, sq long", path=path, table="none", key="id").count() == 0


def test_unknown_kinds_and_secrets_are_refused(spark):
    with pytest.raises(ValueError):
        databases.pages(spark, "floppy", "id long")
    with pytest.raises(ValueError):
        databases.jdbc(spark, "mysql", "jdbc:mysql://h/d?password=x", "t")


def test_keys_of_different_types_never_alias(spark):
    chosen = mapping.Mapping("n", "id", "text")
    a = mapping.map_records(spark.createDataFrame([(1, "x")], "id long, text string"), chosen).first()
    b = mapping.map_records(spark.createDataFrame([("1", "x")], "id string, text string"), chosen).first()
    assert a.fact_id != b.fact_id and len(a.content_sha256) == 64 and 0 <= a.fact_id < 1 << 62


def test_rows_that_are_no_documents_say_why(spark):
    df = spark.createDataFrame([(None, "x", "user"), (1, None, "user"), (2, "x" * 200_000, "user"), (3, "x", "king"), (4, "x", "User")], "id long, text string, role string")
    found = mapping.map_records(df, mapping.suggest("n", df.columns))
    assert [r.rejected for r in found.collect()] == ["missing_key", "missing_text", "text_too_long", "unknown_role", None]


def test_event_days_from_offsets_and_seconds(spark):
    iso = spark.createDataFrame([("2024-01-01T23:30:00-02:00",)], "d string")
    assert iso.select(mapping.event_day(iso, "d")).first()[0] == 738887
    unix = spark.createDataFrame([(0,)], "d long")
    assert unix.select(mapping.event_day(unix, "d")).first()[0] == 719163


def test_mappings_need_an_id_and_a_text():
    assert mapping.suggest("n", ["a", "b"]) is None
    assert mapping.suggest("n", ["uuid", "body", "turn"]).sequence_field == "turn"


def test_json_leaves_keep_their_span(spark):
    rows = [(1, '{"a": {"b": [1, 42]}, "u": "C"}'), (2, '{"a": 1, "a": 2}'), (3, "{"), (4, '{"a": {}}'), (5, None), (6, '{"a": {"b": [0, {"c": 1}]}}')]
    found = {r.k: r for r in adapters.json_facts(spark.createDataFrame(rows, "k long, c string"), "k", "c", "/a/b/1", "/u").collect()}
    assert (found[1].value, found[1].unit, rows[0][1][found[1].start : found[1].end]) == ("42", "C", "42")
    assert [found[k].state for k in (2, 3, 4, 5, 6)] == ["duplicate_key", "malformed", "missing_leaf", "malformed", "not_a_scalar"]


def test_json_lines_and_file_chunks(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "a", "text": "x"}\n{"_id": "b", "title": "t", "text": "y"}\n{"_id": "a", "text": "x"}\n')
    found = {r.external_id: (r.text, r.lines) for r in adapters.jsonl_corpus(spark, str(tmp_path / "c.jsonl")).collect()}
    assert found == {"a": ("x", 2), "b": ("t y", 1)}
    (tmp_path / "f.bin").write_bytes(b"abcdefghij")
    chunks = adapters.file_chunks(spark, str(tmp_path / "f.bin"), 4).orderBy("start").collect()
    assert [bytes(c.chunk) for c in chunks] == [b"abcd", b"efgh", b"ij"]


def test_writing_needs_a_grant(spark):
    with pytest.raises(PermissionError):
        adapters.managed_namespace(spark.range(1).toDF("fact_id"), "/nowhere", False)


def _stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_a_windowed_stream_gives_the_batch_result(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    expected = {(r.start, r.event_type): r.n for r in windows.tumbling(events, "ts", "1 day", ["event_type"], "value").collect()}
    path = str(tmp_path / "in")
    events.coalesce(1).write.parquet(path)
    _run(windows.tumbling(spark.readStream.schema(events.schema).parquet(path), "ts", "1 day", ["event_type"], "value", "1 hour"), tmp_path, "daily", "complete")
    assert {(r.start, r.event_type): r.n for r in spark.table("daily").collect()} == expected


def test_rows_out_of_order_are_rejected(spark, tmp_path):
    stream = _stream(spark, tmp_path, [("a", 1, 10.0), ("a", 2, 11.0), ("a", 2, 12.0), ("b", 5, 1.0)], "key string, at long, value double")
    _run(epochs.ordered_ingest(stream, "key", "at", "value"), tmp_path, "ordered")
    assert sorted((r.key, r.at, r.state) for r in spark.table("ordered").collect()) == [("a", 1, "accepted"), ("a", 2, "accepted"), ("a", 2, "rejected_out_of_order"), ("b", 5, "accepted")]


def test_epochs_fold_once_even_if_one_is_written_again(spark, tmp_path):
    root = str(tmp_path / "boundary")
    write = epochs.boundary_writer(spark, root)
    rows = lambda *x: spark.createDataFrame(list(x), "scope string, canonical string, fact_id long, amplitude double, hard_negative boolean")
    write(rows(("s", "c", 1, 1.0, False)), 0)
    write(rows(("s", "c", 1, 1.0, False), ("s", "c", 2, 0.5, False)), 1)
    write(rows(("s", "c", 1, 1.0, False), ("s", "c", 2, 0.5, False)), 1)
    r = epochs.settle(epochs.boundary(spark, root, 1)).first()
    assert (r.amplitude, r.witnesses, r.state) == (1.5, 2, "resolved")
    assert epochs.settle(epochs.boundary(spark, root, 0)).first().amplitude == 1.0
    for k in (*range(2, 2 * epochs.COMPACT + 2), epochs.COMPACT):  # a base is written twice
        write(rows(("s", "c", k + 1, 0.25, False)), k)
    for k in (epochs.COMPACT - 1, epochs.COMPACT, 2 * epochs.COMPACT + 1):
        r = epochs.settle(epochs.boundary(spark, root, k)).first()
        assert (r.amplitude, r.witnesses) == (1.5 + 0.25 * (k - 1), k + 1)
