"""Entry points: a question over typed facts, and a question over documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.outcome import no_ids
from attestra.operators import facts as F_
from attestra.operators import ranking, retrieval
from attestra.plans.compiler import Program, compile_question

COLUMNS = ["scope", "subject", "state", "value", "unit", "reason", "fact_ids"]


def execute(facts: DataFrame, program: Program, closed_world: bool = True) -> DataFrame:
    """(scope, subject, state, value, unit, reason, fact_ids): the program's answer for its subject, or for every subject that has its predicates."""
    if program.state != "compiled":
        one = facts.sparkSession.range(1)
        return one.select(F.lit(None).cast("string").alias("scope"), F.lit(program.subject).cast("string").alias("subject"), F.lit(program.state).alias("state"), F.lit(None).cast("string").alias("value"), F.lit("").alias("unit"), F.lit(program.reason).alias("reason"), no_ids().alias("fact_ids"))
    rows = facts.filter(F.col("predicate").isin(*program.predicates)) if program.operator != "EXPLAIN_CAUSE" else facts
    if program.subject and program.operator != "EXPLAIN_CAUSE":
        rows = rows.filter(F.lower("subject") == program.subject)
    if program.days:
        low, high = ((d - dt.date(1970, 1, 1)).days for d in program.days)
        rows = rows.filter(F.col("event_time").between(low, high))
    if program.operator == "LOOKUP":
        found = F_.lookup(rows, at_time=program.at_time)
    elif program.operator == "COUNT_DISTINCT":
        found = F_.count_distinct(rows, at_time=program.at_time, closed_world=closed_world)
    elif program.operator == "SUM":
        found = F_.total(rows, program.unit, at_time=program.at_time, closed_world=closed_world)
    elif program.operator == "INTERVAL":
        found = F_.interval(rows, *program.predicates, unit=program.unit or "tick", at_time=program.at_time)
    elif program.operator == "EXPLAIN_CAUSE":
        found = F_.explain_cause(rows, at_time=program.at_time).filter(F.col("predicate").isin(*program.predicates))
        found = found.filter(F.lower("subject") == program.subject) if program.subject else found
    elif program.operator == "EXISTS":
        seen = F_.collapse_orbits(rows, at_time=program.at_time).filter("asserted and polarity > 0 and not conflict")
        found = seen.groupBy("scope", "subject").agg(F.array_sort(F.collect_list("fact_id")).alias("fact_ids"))
        found = found.select("scope", "subject", F.lit("resolved").alias("state"), F.lit("true").alias("value"), F.lit("").alias("unit"), F.lit("positive_witness_exists").alias("reason"), "fact_ids")
    else:
        pick = F.max if program.operator == "ARGMAX" else F.min
        seen = F_.collapse_orbits(rows, at_time=program.at_time).filter("asserted and polarity > 0 and not conflict")
        found = seen.groupBy("scope", "subject").agg(pick(F.struct("event_time", "fact_id")).alias("w"))
        found = found.select("scope", "subject", F.lit("resolved").alias("state"), F.col("w.event_time").cast("string").alias("value"), F.lit("day").alias("unit"), F.lit("unique_clock_extreme").alias("reason"), F.array("w.fact_id").alias("fact_ids"))
    return found.select(*COLUMNS)


def ask(facts: DataFrame, question: str, today: dt.date | None = None) -> DataFrame:
    """A question over facts; the predicates that may be named are those of the data."""
    names = tuple(sorted(r["predicate"] for r in facts.select("predicate").distinct().collect()))  # a declared vocabulary, few names
    return execute(facts, compile_question(question, names, today))


def evidence(docs: DataFrame, queries: DataFrame, documents: int = 8, sentences: int = 12, budget: int = 4096) -> DataFrame:
    """(query_id, fact_ids, used, evidence): for every query the best sentences of its best documents, as many as fit into so many bytes."""
    best = retrieval.bm25(docs, queries, documents).select("query_id", "fact_id")
    said = retrieval.claims(docs.join(best.select("fact_id").distinct(), "fact_id", "left_semi")).join(best, "fact_id")
    asked = queries.select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("asked"))
    shared = said.join(asked, "query_id").withColumn("score", F.size(F.array_intersect(T.tokens(F.col("text")), F.col("asked"))).cast("double")).filter("score > 0")
    ranked = ranking.top_k(shared.withColumn("place", F.struct("fact_id", "claim")), sentences, ["query_id"], "score", "place")
    costs = ranked.withColumn("cost", F.octet_length("text"))
    kept = ranking.budget_fold(costs, ["query_id"], "cost", budget, "rank")
    shown = kept.select("query_id", "used", F.explode("fact_ids").alias("rank")).join(ranked, ["query_id", "rank"])
    listed = F.array_sort(F.collect_list(F.struct("rank", "fact_id", "text")))
    return shown.groupBy("query_id", "used").agg(listed.alias("x")).select("query_id", F.array_sort(F.array_distinct(F.transform("x", lambda r: r["fact_id"]))).alias("fact_ids"), "used", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("evidence"))
