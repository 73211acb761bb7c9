"""Authorized facts from declared sources: attestation, lineage, lifetime and completeness.

Declarations are admitted where an authority covers their adapter, schema, scope and predicate, and where the declared span of the
source is exactly the value. A replacement must name the active report of its own orbit. Queries check every proof again
when they answer: what has expired or lost its authority makes the answer abstain, it is never silently dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def admit(declarations: DataFrame, sources: DataFrame, authorities: DataFrame) -> DataFrame:
    """declarations: fact_id, source_id, adapter_id, schema_sha256, scope, predicate, value, span_start, span_end; sources: source_id, content,
    source_sha256; authorities: adapter_id, schema_sha256, scopes, predicates. Every declaration with `rejected`: null, or why not."""
    known = sources.select("source_id", "content", "source_sha256")
    power = authorities.select("adapter_id", F.col("schema_sha256").alias("_schema"), "scopes", "predicates")
    rows = declarations.join(known, "source_id", "left").join(power, "adapter_id", "left")
    said = F.expr("substring(content, span_start + 1, span_end - span_start)")
    why = (
        F.when(F.col("content").isNull(), "unknown_source")
        .when(F.sha2("content", 256) != F.col("source_sha256"), "source_digest_mismatch")
        .when(F.col("_schema").isNull(), "unknown_adapter")
        .when(F.col("_schema") != F.col("schema_sha256"), "schema_mismatch")
        .when(~F.array_contains("scopes", F.col("scope")), "scope_not_allowed")
        .when(~F.array_contains("predicates", F.col("predicate")), "predicate_not_allowed")
        .when((F.col("span_end") <= F.col("span_start")) | (said != F.col("value")), "span_mismatch")
    )
    return rows.select(*declarations.columns, why.alias("rejected"))


def collisions(admitted: DataFrame) -> DataFrame:
    """Ids that say different things: (fact_id, kinds)."""
    return admitted.filter("rejected is null").groupBy("fact_id").agg(F.count_distinct(F.struct("source_id", "scope", "predicate", "value")).alias("kinds")).filter("kinds > 1")


def active(facts: DataFrame, at_time: int | None = None) -> DataFrame:
    """facts: fact_id, orbit, supersedes, valid_from, valid_until. Facts that nothing replaces and that are in force, with `lineage`: ok, or
    what is wrong with what a fact says it replaces (foreign_orbit, unknown_fact)."""
    own = facts.select(F.col("fact_id").alias("supersedes"), F.col("orbit").alias("_orbit"))
    checked = facts.join(own, "supersedes", "left").withColumn("lineage", F.when(F.col("supersedes").isNull(), "ok").when(F.col("_orbit").isNull(), "unknown_fact").when(F.col("_orbit") != F.col("orbit"), "foreign_orbit").otherwise("ok")).drop("_orbit")
    replaced = checked.filter("lineage = 'ok' and supersedes is not null").select(F.col("supersedes").alias("fact_id")).distinct()
    now = checked.join(replaced, "fact_id", "left_anti")
    if at_time is not None:
        now = now.filter((F.col("valid_from") <= at_time) & (F.col("valid_until").isNull() | (F.lit(at_time) < F.col("valid_until"))))
    return now


def complete(population: DataFrame, declared: DataFrame, by: list[str]) -> DataFrame:
    """population: by, fact_id; declared: by, fact_ids. Whether a certificate lists exactly the facts in force."""
    now = population.groupBy(*by).agg(F.array_sort(F.collect_set("fact_id")).alias("now"))
    joined = declared.join(now, by, "full")
    same = F.coalesce(F.array_sort("fact_ids"), F.expr("cast(array() as array<bigint>)")) == F.coalesce("now", F.expr("cast(array() as array<bigint>)"))
    return joined.select(*by, same.alias("complete"))


def recheck(answers: DataFrame, facts: DataFrame, at_time: int) -> DataFrame:
    """answers: keys, state, value, fact_ids. A resolved answer whose proofs are not all in force at a time abstains."""
    keys = [c for c in answers.columns if c not in ("state", "value", "unit", "reason", "fact_ids")]
    good = facts.filter((F.col("valid_from") <= at_time) & (F.col("valid_until").isNull() | (F.lit(at_time) < F.col("valid_until")))).select(F.col("fact_id").alias("_id"), F.lit(True).alias("_good"))
    lost = answers.filter("state = 'resolved'").select(*keys, F.explode("fact_ids").alias("_id")).join(good, "_id", "left").filter("_good is null").select(*keys).distinct().withColumn("_lost", F.lit(True))
    joined = answers.join(lost, keys, "left")
    gone = F.coalesce(F.col("_lost"), F.lit(False))
    return joined.select(*keys, F.when(gone, "abstain").otherwise(F.col("state")).alias("state"), F.when(~gone, F.col("value")).alias("value"), F.when(gone, "proof_not_in_force").otherwise(F.col("reason")).alias("reason"))


def purge(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts without those of purged sources, and without what only stood on them as causes."""
    gone = sources.select("source_id").distinct()
    kept = facts.join(gone, "source_id", "left_anti")
    lost = facts.join(gone, "source_id", "left_semi").select(F.col("fact_id").alias("cause"))
    orphans = kept.select("fact_id", F.explode("causes").alias("cause")).join(lost, "cause", "left_semi").select("fact_id").distinct()
    return kept.join(orphans, "fact_id", "left_anti")
