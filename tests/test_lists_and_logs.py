"""Literal expectations for rankings, logs, conjunctive programs, calendars and scoring."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import competition, conjunctive, kv, predicates, ranking


def test_fusion_breaks_ties_by_best_rank_then_order(spark):
    rows = [("q", "a", i, r) for r, i in enumerate((3, 1, 2), 1)] + [("q", "b", i, r) for r, i in enumerate((2, 1, 4), 1)]
    found = ranking.fuse(spark.createDataFrame(rows, "q string, channel string, fact_id long, rank long"), ["q"], ["a", "b"])
    assert [r.fact_id for r in found.orderBy("rank").collect()] == [2, 1, 3, 4]


@pytest.mark.parametrize(
    ("primary", "reserve_order", "quota", "reserve", "expected"),
    [(list(range(1, 11)), [9, 8, 20, 21], 8, 2, [1, 2, 3, 4, 5, 6, 9, 8]), ([1, 2, 3], [1, 2, 4], 3, 1, [1, 2, 4])],
)
def test_protected_merge(spark, primary, reserve_order, quota, reserve, expected):
    df = spark.createDataFrame([(primary, reserve_order)], "a array<long>, b array<long>")
    assert df.select(ranking.protected_merge(F.col("a"), F.col("b"), quota, reserve).alias("m")).first().m[:quota] == expected


def test_a_budget_skips_and_a_prefix_stops(spark):
    df = spark.createDataFrame([("q", k, k, c) for k, c in enumerate((5, 9, 3, 4), 1)], "q string, fact_id long, rank long, cost long")
    folded = ranking.budget_fold(df, ["q"], "cost", 10).first()
    assert (folded.fact_ids, folded.used) == ([1, 3], 8)
    assert [r.fact_id for r in ranking.prefix_within(df, ["q"], "cost", 10).collect()] == [1]


def test_cover_prefers_new_tokens_for_their_cost(spark):
    df = spark.createDataFrame([("q", 1, ["a", "b"], 10), ("q", 2, ["a", "b", "c"], 10), ("q", 3, ["d"], 2)], "q string, fact_id long, tokens array<string>, cost long")
    assert [r.fact_id for r in ranking.max_cover(df, "q", 12).orderBy("position").collect()] == [3, 2]


LOG = "seq long, op string, fact_id long, version long, value long, operation_id long"


def test_log_states(spark):
    rows = [(1, "PUT", 7, 1, 5, 1), (2, "PUT", 7, 1, 5, 2), (3, "PUT", 7, 1, 6, 3), (4, "DELETE", 7, 3, None, 4), (5, "PUT", 7, 2, 9, 5), (6, "PUT", 7, 1, 5, 1), (7, "PUT", 7, 9, 5, 1)]
    log = spark.createDataFrame(rows, LOG)
    assert {r.seq: r.state for r in kv.audit(log).collect()} == {1: "APPLIED", 2: "IDEMPOTENT", 3: "VERSION_CONFLICT", 4: "APPLIED", 5: "STALE_REJECTED", 6: "DEDUP_REPLAY", 7: "TXID_CONFLICT"}
    assert kv.get(log, spark.createDataFrame([(7,), (8,)], "fact_id long")).orderBy("fact_id").select("state").collect() == [("DELETED",), ("NOT_FOUND",)]
    assert kv.get(log, spark.createDataFrame([(7,)], "fact_id long"), 3).first().value == 5


def test_alias_counts_are_those_of_the_walked_forms(spark):
    rng = random.Random(5)
    pairs = [(f"p{i}", f"g{rng.randrange(4)}") for i in range(30)] + [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(10)] + [("p1", "g9"), ("n2", "g1"), ("x", "y"), ("v", "u"), ("s", "s")]
    links = spark.createDataFrame(pairs + pairs[:3], "left string, right string")
    start = spark.createDataFrame([(i, x) for i, x in enumerate(sorted({x for p in pairs for x in p}))] + [(90, "p2"), (90, "p3"), (90, "g1"), (91, "absent"), (92, "x"), (92, "y"), (0, "n1")], "query long, form string")
    for hops in (1, 2, 3, 4):
        walked = conjunctive.alias_closure(start, links, hops).groupBy("query", "hop").agg(F.count("*").alias("forms"))
        assert sorted(conjunctive.alias_counts(start, links, hops).collect()) == sorted(walked.collect())


def test_alias_counts_of_a_large_group_keep_a_row_for_each_query(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(conjunctive, "materialize", lambda df, name: kept.append(df.cache()) or kept[-1])
    links = spark.createDataFrame([(f"p{i}", "g") for i in range(2000)], "left string, right string")
    found = conjunctive.alias_counts(links.select(F.col("left").alias("query"), F.col("left").alias("form")), links)
    assert found.groupBy("hop", "forms").count().orderBy("hop").collect() == [(0, 1, 2000), (1, 1, 2000), (2, 1999, 2000)]
    assert max(df.count() for df in kept) == 2000


EDGE = "predicate string, a0 string, a1 string, fact_id long"


def test_conjunctive_provenance_and_nogoods(spark):
    rows = spark.createDataFrame([("p", "a", "b", 1), ("p", "a", "c", 2), ("q", "b", "x", 3), ("q", "c", "x", 4)], EDGE)
    goals = [("p", ("a", "?m")), ("q", ("?m", "?o"))]
    r = conjunctive.query(rows, goals, ["o"]).first()
    assert (r.o, r.monomials, r.support) == ("x", [[1, 3], [2, 4]], 2)
    nogoods = spark.createDataFrame([([1, 3],)], "nogood array<long>")
    assert conjunctive.query(rows, goals, ["o"], nogoods).first().monomials == [[2, 4]]


def test_goals_that_share_nothing_are_refused(spark):
    with pytest.raises(ValueError):
        conjunctive.order_goals([("p", ("?a", "?b")), ("q", ("?c", "?d"))])


def test_transport_tells_ends_cycles_and_conflicts(spark):
    arrows = spark.createDataFrame([("a", "b"), ("c", "d"), ("d", "c"), ("e", "f"), ("e", "g")], "src string, dst string")
    start = spark.createDataFrame([(x, x) for x in "ace"], "query string, node string")
    assert {r.query: r.state for r in conjunctive.transport(start, arrows).collect()} == {"a": "resolved", "c": "cycle", "e": "conflict"}


def test_calendar_questions():
    assert predicates.calendar_interval("what happened in February 2024?") == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert predicates.calendar_interval("on March 3rd, 2023") == (dt.date(2023, 3, 3), dt.date(2023, 3, 3))
    assert predicates.calendar_interval("from May 2023 to June 2023") == (dt.date(2023, 5, 1), dt.date(2023, 6, 30))
    assert predicates.calendar_interval("as of May 2023") is None
    assert predicates.calendar_interval("May 2023 or June 2023?") is None


def test_relative_questions():
    today = dt.date(2024, 3, 31)
    assert predicates.relative_window("yesterday", today) == (dt.date(2024, 3, 30),) * 2
    assert predicates.relative_window("a month ago", today) == (dt.date(2024, 2, 26), dt.date(2024, 3, 3))
    assert predicates.relative_window("last week", today) == (dt.date(2024, 3, 18), dt.date(2024, 3, 24))
    assert predicates.relative_window("whenever", today) is None


def test_wilson_bound(spark):
    df = spark.createDataFrame([(0, 0), (9, 10)], "s long, n long")
    low = [r[0] for r in df.select(competition.wilson(F.col("s"), F.col("n"))).collect()]
    assert low[0] == 0.0 and low[1] == pytest.approx(0.5958, abs=1e-3)


def test_a_fact_counts_once_however_many_edges_cite_it(spark):
    rows = [("s", "deploy", 1, 1.0, False), ("s", "deploy", 1, 1.0, False), ("s", "deploy", 2, 1.0, False)]
    df = spark.createDataFrame(rows, "scope string, canonical string, fact_id long, amplitude double, hard_negative boolean")
    r = competition.interference(df, ["scope"], 0.5).first()
    assert (r.state, r.value, r.amplitude, r.witnesses) == ("resolved", "deploy", 2.0, 2)
