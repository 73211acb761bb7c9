"""Versioned key-value semantics over an operation log (seq, op, fact_id, version, value, operation_id).

Later versions win; an equal version is idempotent when it says the same as the first one did and a conflict otherwise; lower
versions are stale; a delete is terminal at its version. An operation id seen before is a replay, or a conflict of ids if it
says something else; neither changes anything. States and snapshots are map-side aggregates, so hot keys are folded where
they are read; only the audit of every single operation needs a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAID = ["op", "fact_id", "version", "value"]


def originals(log: DataFrame) -> DataFrame:
    """(operation_id, first_seq, said): the first operation of every id."""
    return log.groupBy("operation_id").agg(F.min(F.struct("seq", F.struct(*SAID).alias("said"))).alias("o")).select("operation_id", F.col("o.seq").alias("first_seq"), F.col("o.said").alias("said"))


def replays(log: DataFrame) -> DataFrame:
    """(seq, operation_id, first_seq, state): fresh, DEDUP_REPLAY or TXID_CONFLICT for every operation."""
    joined = log.join(originals(log), "operation_id")
    same = F.struct(*SAID).eqNullSafe(F.col("said"))
    return joined.select("seq", "operation_id", "first_seq", F.when(F.col("seq") == F.col("first_seq"), "fresh").when(same, "DEDUP_REPLAY").otherwise("TXID_CONFLICT").alias("state"))


def effective(log: DataFrame) -> DataFrame:
    """First operations only."""
    return originals(log).select(F.col("first_seq").alias("seq"), "operation_id", "said.*")


def snapshot(log: DataFrame, read_seq: int | None = None) -> DataFrame:
    """(fact_id, version, op, value, seq): each key's state at a read sequence, tombstones included."""
    rows = effective(log)
    if read_seq is not None:
        rows = rows.filter(F.col("seq") <= read_seq)
    best = rows.groupBy("fact_id").agg(F.max(F.struct("version", (-F.col("seq")).alias("back"), "op", "value")).alias("b"))
    return best.select("fact_id", "b.version", "b.op", "b.value", (-F.col("b.back")).alias("seq"))


def get(log: DataFrame, keys: DataFrame, read_seq: int | None = None) -> DataFrame:
    """(fact_id, state, value, version) of the asked keys: PRESENT, DELETED or NOT_FOUND."""
    joined = keys.select("fact_id").join(snapshot(log, read_seq), "fact_id", "left")
    state = F.when(F.col("op").isNull(), "NOT_FOUND").when(F.col("op") == "DELETE", "DELETED").otherwise("PRESENT")
    return joined.select("fact_id", state.alias("state"), F.when(F.col("op") == "PUT", F.col("value")).alias("value"), "version")


def audit(log: DataFrame) -> DataFrame:
    """(seq, state) of every operation, in the order of the log."""
    order = Window.partitionBy("fact_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = effective(log)
    before = F.max(F.struct("version", (-F.col("seq")).alias("back"), "op", "value")).over(order)
    judged = rows.withColumn("b", before)
    state = (
        F.when(F.col("b").isNull() | (F.col("version") > F.col("b.version")), "APPLIED")
        .when(F.col("version") < F.col("b.version"), "STALE_REJECTED")
        .when((F.col("op") == F.col("b.op")) & F.col("value").eqNullSafe(F.col("b.value")), "IDEMPOTENT")
        .otherwise("VERSION_CONFLICT")
    )
    again = replays(log).filter("state != 'fresh'").select("seq", "state")
    return judged.select("seq", state.alias("state")).union(again)


def compact(base: DataFrame, log: DataFrame) -> DataFrame:
    """A new generation: a base snapshot and the log after it, folded by the same rule."""
    rows = base.select("fact_id", "version", "op", "value", "seq").union(effective(log).select("fact_id", "version", "op", "value", "seq"))
    best = rows.groupBy("fact_id").agg(F.max(F.struct("version", (-F.col("seq")).alias("back"), "op", "value")).alias("b"))
    return best.select("fact_id", "b.version", "b.op", "b.value", (-F.col("b.back")).alias("seq"))


def export(state: DataFrame) -> DataFrame:
    """Live keys with a checksum of each line."""
    live = state.filter("op = 'PUT'")
    return live.select("fact_id", "value", F.sha2(F.concat_ws("|", "fact_id", "value", F.lit("log"), F.lit("present")), 256).alias("checksum"))


def unreachable(objects: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects that no live root names: what collection may quarantine."""
    return objects.join(roots.select("object_id").distinct(), "object_id", "left_anti")


def ledger(state: DataFrame) -> DataFrame:
    """Rows and bytes by class."""
    kind = F.when(F.col("op") == "DELETE", "tombstone").otherwise("value")
    return state.groupBy(kind.alias("class")).agg(F.count("*").alias("keys"), F.sum(F.octet_length(F.coalesce(F.col("value").cast("string"), F.lit(""))) + 8).cast("bigint").alias("bytes"))
