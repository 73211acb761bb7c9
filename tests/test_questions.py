"""Questions, programs and evidence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attestra.operators import graphs, narrative, retrieval, strategy
from attestra.plans import answer_queries, tables
from attestra.plans.answer import evidence
from attestra.plans.compiler import compile_question

NAMES = ("signup", "purchase", "view")


@pytest.mark.parametrize(
    ("question", "operator", "predicates"),
    [
        ("how many different views?", "COUNT_DISTINCT", ("view",)),
        ("What is the total amount of purchase in cents for user:7?", "SUM", ("purchase",)),
        ("the latest signup as of 2024-01-02", "LOOKUP", ("signup",)),
        ("how many days passed between signup and purchase?", "INTERVAL", ("signup", "purchase")),
        ("why did view fail", "EXPLAIN_CAUSE", ("view",)),
    ],
)
def test_rules_name_operators(question, operator, predicates):
    p = compile_question(question, NAMES)
    assert (p.state, p.operator, p.predicates) == ("compiled", operator, predicates)


def test_operands_are_read(question="What is the total amount of purchase in cents for user:7 as of 2024-01-02?"):
    p = compile_question(question, NAMES)
    assert (p.subject, p.unit) == ("user:7", "cent")
    assert p.at_time == int(dt.datetime(2024, 1, 2, 23, 59, 59, tzinfo=dt.UTC).timestamp())


@pytest.mark.parametrize(("question", "state"), [("hello", "unsupported"), ("how many different latest views", "abstain"), ("the latest thing", "abstain"), ("how long between signup and now", "abstain")])
def test_what_does_not_compile_says_so(question, state):
    assert compile_question(question, NAMES).state == state


def test_evidence_fits_its_budget_and_holds_the_best_sentence(spark):
    docs = spark.createDataFrame([(1, "Nothing of note here. The red fox crossed the frozen river."), (2, "Rivers are long and wide. A blue bird sang."), (3, None), (4, "")], "fact_id long, text string")
    asked = spark.createDataFrame([(9, "which river did the fox cross"), (8, "zebra")], "query_id long, text string")
    found = evidence(docs, asked, budget=45).collect()
    assert [(r.query_id, r.fact_ids, r.evidence) for r in found] == [(9, [1], "The red fox crossed the frozen river.")]
    assert found[0].used <= 45


def test_components_and_layers(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7), (6, None)], "a long, b long")
    assert {(r.node, r.root) for r in graphs.connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert graphs.connected_components(chain).select("root").distinct().collect() == [(0,)]
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    arrows = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "d")], "src string, dst string")
    layers = {r.node: r.layer for r in graphs.layers(nodes, arrows, 6).collect()}
    assert (layers["a"], layers["b"], layers["c"]) == (0, 1, 2) and layers["d"] is None and layers["e"] is None
    assert graphs.connected_components(edges.limit(0)).count() == 0


def test_evidence_is_packed_for_every_item_of_the_benchmark(spark, folder):
    asked = tables.query_texts(spark, folder)
    found = {r.query_id: r.evidence for r in answer_queries.evidence_pack(spark, folder).collect()}
    plain = evidence(tables.turns(spark, folder).select("fact_id", "text"), asked)
    assert found == {r.query_id: r.e for r in plain.select("query_id", F.sha2("evidence", 256).alias("e")).collect()}
    assert set(found) == {r.query_id for r in asked.collect()}


def test_pairs_prefer_causes(spark):
    rows = [("g", 1, "s", "p", "a", 1, []), ("g", 2, "s", "p", "b", 2, [1]), ("g", 3, "s", "q", "c", 3, [])]
    df = spark.createDataFrame(rows, "g string, fact_id long, subject string, predicate string, value string, clock long, causes array<long>")
    assert {(r.first, r.second, r.relation) for r in narrative.pairs(df, "g").collect()} == {(1, 2, "CAUSE"), (1, 3, "JOINT"), (2, 3, "JOINT")}


def test_a_guarded_answer_must_hold_in_every_world(spark):
    facts = spark.createDataFrame([("k", "a", "1"), ("k", "b", "1"), ("m", "a", "2")], "k string, guard string, value string")
    worlds = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "world long, holds array<string>")
    assert {(r.k, r.state, r.value) for r in strategy.guarded(facts, worlds, ["k"]).collect()} == {("k", "resolved", "1"), ("m", "abstain", None)}


def test_retrieval_never_leaves_the_given_documents_and_ties_by_id(spark):
    docs = spark.createDataFrame([(2, "alpha beta"), (1, "alpha beta"), (3, "gamma"), (4, None)], "fact_id long, text string")
    asked = spark.createDataFrame([(1, "Alpha"), (2, "delta"), (3, None)], "query_id long, text string")
    assert [(r.query_id, r.fact_id, r["rank"]) for r in retrieval.bm25(docs, asked, 5).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]
    assert retrieval.bm25(docs.limit(0), asked, 5).count() == 0
    assert retrieval.claims(docs).count() == 0
    assert retrieval.dense(docs, asked.filter(F.col("query_id") == 1), 5).select("fact_id").orderBy("rank").collect() == [(1,), (2,)]
