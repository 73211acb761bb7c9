"""Discourse over facts of a group: which pairs cause, contrast, follow or join, in what order a group tells them, and its citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(facts: DataFrame, group: str) -> DataFrame:
    """facts: group, fact_id, subject, predicate, value, clock, causes. (group, first, second, relation) of every related pair of a group: a
    cause, a changed value of one fiber, a later report of it, or a shared subject. Pairs come from equi-joins on what relates them."""
    left = facts.select(group, *[F.col(c).alias(f"l_{c}") for c in ("fact_id", "subject", "predicate", "value", "clock")])
    right = facts.select(group, *[F.col(c).alias(f"r_{c}") for c in ("fact_id", "subject", "predicate", "value", "clock")])
    caused = facts.select(group, F.col("fact_id").alias("second"), F.explode("causes").alias("first")).join(facts.select(group, F.col("fact_id").alias("first")), [group, "first"], "left_semi").select(group, "first", "second", F.lit("CAUSE").alias("relation"))
    mates = left.join(right, [left[group] == right[group], F.col("l_subject") == F.col("r_subject"), F.col("l_fact_id") < F.col("r_fact_id")]).drop(right[group])
    same = F.col("l_predicate") == F.col("r_predicate")
    swap = same & ((F.col("r_clock") < F.col("l_clock")))
    relation = F.when(same & (F.col("l_value") != F.col("r_value")), "CONTRAST").when(same & (F.col("l_clock") != F.col("r_clock")), "SEQUENCE").otherwise("JOINT")
    related = mates.select(group, F.when(swap, F.col("r_fact_id")).otherwise(F.col("l_fact_id")).alias("first"), F.when(swap, F.col("l_fact_id")).otherwise(F.col("r_fact_id")).alias("second"), relation.alias("relation"))
    undirected = lambda d: d.select(group, F.least("first", "second").alias("_a"), F.greatest("first", "second").alias("_b"))
    free = related.withColumn("_a", F.least("first", "second")).withColumn("_b", F.greatest("first", "second")).join(undirected(caused).distinct(), [group, "_a", "_b"], "left_anti").drop("_a", "_b")
    return caused.union(free)


def current_value(facts: DataFrame, group: str) -> DataFrame:
    """(group, subject, predicate, fact_id, value): the last report of a fiber with a value, where the fiber was revised at all."""
    order = F.struct("clock", "fact_id")
    found = facts.filter(F.col("value") != "").groupBy(group, "subject", "predicate").agg(F.max_by(F.struct("fact_id", "value"), order).alias("c"), F.count_distinct("value").alias("kinds"))
    return found.filter("kinds > 1").select(group, "subject", "predicate", "c.fact_id", "c.value")


def told(facts: DataFrame, group: str, by_layer: DataFrame, text: Column) -> DataFrame:
    """Each group's facts in order of layer, clock and id, joined to one text; by_layer: node, layer."""
    rows = facts.join(by_layer.withColumnRenamed("node", "fact_id"), "fact_id")
    listed = F.array_sort(F.collect_list(F.struct("layer", "clock", "fact_id", text.alias("t"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("story"), F.count_if(F.col("layer").isNull()).alias("unordered"))


def citations(sentences: DataFrame) -> DataFrame:
    """sentences: fact_id, claim, text. A digest for every sentence, and one for its document's sentences in order."""
    one = sentences.select("fact_id", "claim", F.sha2("text", 256).alias("digest"))
    whole = one.groupBy("fact_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim", "digest"))), lambda x: x["digest"]), ""), 256).alias("document_digest"), F.count("*").alias("sentences"))
    return whole


def shared_bindings(bindings: DataFrame) -> DataFrame:
    """bindings: claim, binding. (a, b, shared): claims linked by what they bind in common."""
    once = bindings.select("claim", "binding").distinct()
    a, b = once.select(F.col("claim").alias("a"), "binding"), once.select(F.col("claim").alias("b"), "binding")
    return a.join(b, "binding").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def best_sentence(sentences: DataFrame, score: str) -> DataFrame:
    """The best sentence of each document by score, then place."""
    return sentences.groupBy("fact_id").agg(F.max_by(F.struct("claim", "text"), F.struct(F.col(score), -F.col("claim"))).alias("s")).select("fact_id", "s.claim", "s.text")


def previous_sentence(sentences: DataFrame) -> DataFrame:
    """Each sentence with the one before it in its document."""
    return sentences.withColumn("before", F.lag("text").over(Window.partitionBy("fact_id").orderBy("claim")))
