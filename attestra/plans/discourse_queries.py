"""Registered queries over discourse, strategies, graphs and woven retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import graphs, narrative, retrieval, strategy
from attestra.plans import tables
from attestra.plans.text_queries import DOCS, TOK, _bm25_sql, _ranked
from attestra.plans.tables import TURNS


def _discourse(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of one user on one day as a group to tell."""
    f = tables.facts(spark, folder)
    group = F.concat_ws("@", "subject", F.col("event_time").cast("string"))
    return f.select(group.alias("group"), "fact_id", "subject", "predicate", "value", F.col("observed_at").alias("clock"), "causes")


_GROUPED = f"{tables.FACTS}, g AS (SELECT subject || '@' || event_time AS \"group\", fact_id, subject, predicate, value, observed_at AS clock, cause FROM facts)"
PAIRS = f"""WITH {_GROUPED}, c AS (SELECT a."group", a.cause AS first, a.fact_id AS second, 'CAUSE' AS relation FROM g a JOIN g b ON a.cause = b.fact_id AND a."group" = b."group"),
p AS (SELECT a."group", CASE WHEN a.predicate = b.predicate AND b.clock < a.clock THEN b.fact_id ELSE a.fact_id END AS first, CASE WHEN a.predicate = b.predicate AND b.clock < a.clock THEN a.fact_id ELSE b.fact_id END AS second,
  CASE WHEN a.predicate = b.predicate AND a.value <> b.value THEN 'CONTRAST' WHEN a.predicate = b.predicate AND a.clock <> b.clock THEN 'SEQUENCE' ELSE 'JOINT' END AS relation FROM g a JOIN g b ON a."group" = b."group" AND a.subject = b.subject AND a.fact_id < b.fact_id),
rel AS (SELECT * FROM c UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c."group" = p."group" AND least(c.first, c.second) = least(p.first, p.second) AND greatest(c.first, c.second) = greatest(p.first, p.second)))"""


def narrative_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return narrative.pairs(_discourse(spark, folder), "group")


def narrative_current_value(spark: SparkSession, folder: str) -> DataFrame:
    return narrative.current_value(_discourse(spark, folder), "group")


def narrative_components(spark: SparkSession, folder: str) -> DataFrame:
    """How many facts hang together through causes across all groups."""
    f = tables.facts(spark, folder)
    edges = f.select(F.col("fact_id").alias("a"), F.explode("causes").alias("b")).join(f.select(F.col("fact_id").alias("b")), "b", "left_semi")
    return graphs.connected_components(edges).groupBy("root").agg(F.count("*").alias("facts"))


COMPONENT_SQL = f"""WITH {tables.FACTS}, f AS (SELECT * FROM facts), l AS (SELECT a.subject, a.fact_id, a.cause FROM f a JOIN f b ON a.cause = b.fact_id)
SELECT min(cause) AS root, count(DISTINCT x) AS facts FROM (SELECT subject, cause, fact_id AS x FROM l UNION ALL SELECT subject, cause, cause FROM l) GROUP BY subject"""


def narrative_order(spark: SparkSession, folder: str) -> DataFrame:
    """Layers of all facts by their causes, eight at most; longer chains are named, not followed."""
    f = tables.facts(spark, folder)
    arrows = f.select(F.explode("causes").alias("src"), F.col("fact_id").alias("dst"))
    found = graphs.layers(f.select(F.col("fact_id").alias("node")), arrows, 8)
    return found.groupBy(F.coalesce(F.col("layer").cast("string"), F.lit("beyond")).alias("layer")).agg(F.count("*").alias("facts"))


LAYER_SQL = f"WITH {tables.FACTS}, k AS (SELECT row_number() OVER (PARTITION BY subject ORDER BY fact_id) - 1 AS layer FROM facts) SELECT CASE WHEN layer <= 8 THEN layer::VARCHAR ELSE 'beyond' END AS layer, count(*) AS facts FROM k GROUP BY 1"


def microcitations(spark: SparkSession, folder: str) -> DataFrame:
    return narrative.citations(retrieval.claims(tables.turns(spark, folder), 1))


CITE_SQL = f"WITH {TURNS}, s AS (SELECT fact_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[^.!?\\n]|[.][0-9])+[.!?]?'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM turns) SELECT fact_id, sha256(array_to_string(list_transform(ss, lambda s: sha256(s)), '')) AS document_digest, len(ss)::BIGINT AS sentences FROM s WHERE len(ss) > 0"


def claim_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers linked by the parts of orders they share, small bindings only."""
    li = tables.table(spark, folder, "lineitem")
    return narrative.shared_bindings(li.select(F.col("l_suppkey").alias("claim"), F.col("l_orderkey").alias("binding"))).filter("shared >= 4")


def survival_pressure(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    rows = li.select((F.col("l_suppkey") % 12).alias("agent"), F.col("l_orderkey").alias("task"), (F.col("l_returnflag") == "N").alias("correct"), (F.col("l_quantity") > 20).alias("verified"), F.col("l_tax").alias("cost"))
    return strategy.survival(rows, "agent", "task")


SURVIVAL_SQL = """WITH s AS (SELECT l_suppkey % 12 AS agent, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 20) AS sound, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity <= 20) AS lucky, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_quantity > 20) AS fa, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_quantity <= 20) AS rj, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
r AS (SELECT *, -(sound / n * log2(sound / n) + lucky / n * log2(lucky / n) + fa / n * log2(fa / n) + rj / n * log2(rj / n)) AS risk FROM s), f AS (SELECT *, (sound + 0.25 * lucky - 2.0 * fa) / n - 0.1 * risk AS fitness FROM r), w AS (SELECT *, exp(fitness - max(fitness) OVER ()) AS w FROM f)
SELECT agent, sound, lucky, fa AS false_accepts, round(risk, 6) AS risk, round(fitness, 6) AS fitness, round(w / sum(w) OVER (), 6) AS share FROM w"""


def ideal_coalition(spark: SparkSession, folder: str) -> DataFrame:
    s = tables.table(spark, folder, "supplier")
    agents = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("ideal"), (F.abs("s_acctbal") / 10000).alias("strength"), (F.lit(0.5) + F.col("s_suppkey") % 5 / 10).alias("reliability"), (F.col("s_suppkey") % 4).alias("cost"), F.array((F.col("s_suppkey") % 3).cast("string"), (F.col("s_suppkey") % 7 + 3).cast("string")).alias("abilities"))
    return strategy.coalitions(agents, "ideal", 0.8, -0.6, 4)


COALITION_SQL = """WITH a AS (SELECT s_suppkey AS id, s_nationkey AS ideal, abs(s_acctbal) / 10000 AS st, 0.5 + (s_suppkey % 5) / 10 AS re, s_suppkey % 4 AS cost, s_suppkey % 3 AS x, s_suppkey % 7 + 3 AS y FROM supplier WHERE abs(s_acctbal) / 10000 < 0.8),
p AS (SELECT a.ideal, a.id AS first, b.id AS second, (a.x = b.x)::INT + (a.y = b.y)::INT AS both, round(sqrt(a.st * b.st) * (1 + 1 - ((a.x = b.x)::INT + (a.y = b.y)::INT) / (4 - ((a.x = b.x)::INT + (a.y = b.y)::INT))) * sqrt(a.re * b.re), 6) AS score FROM a JOIN a b ON a.ideal = b.ideal AND a.id < b.id AND a.cost + b.cost <= 4)
SELECT ideal, first, second, score FROM (SELECT *, row_number() OVER (PARTITION BY ideal ORDER BY score DESC, first, second) AS k FROM p WHERE score >= 0.8 - 0.6) WHERE k = 1"""


def flow_regulation(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    q = F.col("l_quantity") / 50
    rows = li.groupBy("l_suppkey", "l_linenumber").agg(F.avg(q).alias("p1"), F.avg("l_discount").alias("p2"), F.max(q).alias("p3"), F.min(q).alias("p4"), F.avg(1 - q / 2).alias("s1"), F.max("l_tax").alias("s2"), F.avg(F.col("l_discount") * 10).alias("s3"), (F.count("*") % 7 == 0).alias("contradiction"), F.count("*").alias("coverage"), F.lit(0.0).alias("error"))
    return strategy.regulate(rows, ["l_suppkey"], "l_linenumber")


FLOW_SQL = """WITH r AS (SELECT l_suppkey, l_linenumber, avg(l_quantity / 50) AS p1, avg(l_discount) AS p2, max(l_quantity / 50) AS p3, min(l_quantity / 50) AS p4, avg(1 - l_quantity / 50 / 2) AS s1, max(l_tax) AS s2, avg(l_discount * 10) AS s3, count(*) % 7 = 0 AS bad, count(*) AS coverage FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, round(sqrt((p1 * p1 + p2 * p2 + p3 * p3 + p4 * p4) / 4), 6) AS challenge, round(pow(s1 * s2 * s3, 1.0 / 3), 6) AS skill, coalesce(coverage < lag(coverage) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber), false) AS worse FROM r)
SELECT l_suppkey, l_linenumber, challenge, skill, CASE WHEN bad THEN 'abstain' WHEN worse THEN 'recruit' WHEN challenge - skill > 0.15 THEN 'anxiety' WHEN challenge - skill < -0.15 THEN 'boredom' ELSE 'flow' END AS regime FROM c"""


def counterfactual_choice(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    rows = li.select((F.col("l_partkey") % 30).alias("goal"), (F.col("l_suppkey") % 5).alias("option"), F.col("l_returnflag").alias("world"), F.col("l_quantity").alias("value"), (F.col("l_suppkey") % 5).alias("cost"))
    return strategy.strategist(rows, ["goal"], "option", "world", "value", 0.6, "cost")


STRATEGY_SQL = """WITH r AS (SELECT l_partkey % 30 AS goal, l_suppkey % 5 AS option, min(l_quantity) AS worst, avg(l_quantity) AS mean, count(DISTINCT l_returnflag) AS w FROM lineitem GROUP BY 1, 2), n AS (SELECT l_partkey % 30 AS goal, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1),
s AS (SELECT goal, option, worst, round(mean, 6) AS mean, round(0.6 * worst + (1 - 0.6) * mean - option, 6) AS score FROM r JOIN n USING (goal) WHERE w = n) SELECT goal, option, worst, mean, score FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY score DESC, option) AS k FROM s) WHERE k = 1"""


def guarded_worlds(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    rows = li.select("l_orderkey", F.col("l_returnflag").alias("guard"), F.col("l_linestatus").alias("value"))
    worlds = spark.createDataFrame([("w1", ["A", "N"]), ("w2", ["N", "R"])], "world string, holds array<string>")
    return strategy.guarded(rows, worlds, ["l_orderkey"])


GUARD_SQL = """WITH w(world, guard) AS (VALUES ('w1', 'A'), ('w1', 'N'), ('w2', 'N'), ('w2', 'R')), p AS (SELECT l_orderkey, world, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS a FROM lineitem JOIN w ON guard = l_returnflag GROUP BY 1, 2), g AS (SELECT l_orderkey, count(*) AS w, count(DISTINCT a) AS k, min(a) AS a FROM p GROUP BY 1)
SELECT l_orderkey, CASE WHEN w = 2 AND k = 1 AND length(a) = 1 THEN 'resolved' WHEN w < 2 THEN 'abstain' ELSE 'contested' END AS state, CASE WHEN w = 2 AND k = 1 AND length(a) = 1 THEN a END AS value FROM g"""


def reachability_partition(spark: SparkSession, folder: str) -> DataFrame:
    c = tables.table(spark, folder, "customer").select(F.col("c_custkey").alias("node"))
    o = tables.table(spark, folder, "orders")
    return graphs.reachability(c, o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("node")), o.select(F.col("o_custkey").alias("node"))).groupBy("part").agg(F.count("*").alias("nodes"))


def gauge_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that suppliers of every seed class deliver."""
    li = tables.table(spark, folder, "lineitem")
    return graphs.consensus(li.select(F.col("l_partkey").alias("part"), (F.col("l_suppkey") % 5).alias("seed")), "part", "seed", 5)


def causal_weave(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.weave(tables.turns(spark, folder), tables.query_texts(spark, folder), 8)


WEAVE_SQL = f"""WITH {TURNS}, docs AS (SELECT fact_id, text FROM turns), asked AS (SELECT item_id::BIGINT AS query_id, text FROM benchmark), {_bm25_sql(name='bt')},
sess AS (SELECT session_id, string_agg(coalesce(text, ''), chr(10) ORDER BY sequence NULLS LAST, fact_id) AS text, min(sequence) AS start FROM turns GROUP BY 1), sids AS (SELECT session_id, row_number() OVER (ORDER BY session_id) AS fact_id, text FROM sess),
bs AS (WITH {_bm25_sql(docs='sids', name='b2')} SELECT query_id, session_id, score FROM b2 JOIN sids USING (fact_id)),
sr AS (SELECT a.query_id, s.session_id, coalesce(b.score, 0) AS ss, row_number() OVER (PARTITION BY a.query_id ORDER BY round(coalesce(b.score, 0), 9) DESC, s.start NULLS LAST, s.session_id) AS sk FROM asked a CROSS JOIN sess s LEFT JOIN bs b ON a.query_id = b.query_id AND s.session_id = b.session_id),
own AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY session_id) AS us FROM turns) WHERE role = 'user' OR us = 0), f AS (SELECT session_id, fact_id, row_number() OVER (PARTITION BY session_id ORDER BY sequence NULLS LAST, fact_id) AS k FROM own),
head AS (SELECT * FROM (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY sk, k) AS p FROM sr JOIN f USING (session_id) WHERE sk <= 3 AND k <= 2) WHERE p <= 6),
sc AS (SELECT sr.query_id, t2.fact_id, t2.sequence, coalesce(bt.score, 0) AS ts, ss FROM sr JOIN turns t2 USING (session_id) LEFT JOIN bt ON bt.query_id = sr.query_id AND bt.fact_id = t2.fact_id), nm AS (SELECT *, max(ts) OVER (PARTITION BY query_id) AS mt, max(ss) OVER (PARTITION BY query_id) AS ms FROM sc),
tl AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY round(ts / CASE WHEN mt > 0 THEN mt ELSE 1 END + 0.5 * ss / CASE WHEN ms > 0 THEN ms ELSE 1 END, 9) DESC, sequence NULLS LAST, fact_id) AS r FROM nm WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.query_id = nm.query_id AND h.fact_id = nm.fact_id)),
u AS (SELECT query_id, fact_id, 0 AS part, p AS o FROM head UNION ALL SELECT query_id, fact_id, 1, r FROM tl WHERE r <= 8)
SELECT query_id, fact_id, rank FROM (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY part, o) AS rank FROM u) WHERE rank <= 8"""


def temporal_weave(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the very day that a question names."""
    e = tables.table(spark, folder, "events")
    turns = e.select(F.col("event_id").alias("fact_id"), F.col("event_id").alias("sequence"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("event_time"))
    asked = spark.createDataFrame([(1, "what did I do 3 days ago?", 20), (2, "o que fiz 10 dias atras", 20), (3, "what did I do?", 20)], "query_id long, text string, event_time long")
    return retrieval.days_ago(turns, asked, 12)


DAYS_SQL = "WITH e AS (SELECT event_id AS fact_id, (ts::DATE - DATE '2024-01-01') AS d FROM events), q(query_id, d) AS (VALUES (1::BIGINT, 17), (2::BIGINT, 10)) SELECT query_id, fact_id, rank FROM (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY fact_id) AS rank FROM q JOIN e USING (d)) WHERE rank <= 12"


def verified_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked documents that the current key-value state holds at the version asked for."""
    docs = tables.documents(spark, folder).select("fact_id", "text")
    ranked = retrieval.bm25(docs, tables.query_texts(spark, folder), 20).withColumn("version", F.lit(1).cast("bigint"))
    state = docs.select("fact_id", F.when(F.col("fact_id") % 7 == 0, 2).otherwise(1).cast("bigint").alias("version"), F.when(F.col("fact_id") % 5 == 0, "DELETE").otherwise("PUT").alias("op"))
    return retrieval.verified(ranked, state).select("query_id", "fact_id", "rank")


VERIFIED_SQL = f"WITH {DOCS}, {_bm25_sql(digits=9)}, r AS ({_ranked('score', 20)}) SELECT query_id, fact_id, rank FROM r WHERE fact_id % 7 <> 0 AND fact_id % 5 <> 0"


def sentence_context(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a sentence shares with the one before it."""
    s = narrative.previous_sentence(retrieval.claims(tables.turns(spark, folder)))
    return s.select("fact_id", "claim", F.size(F.array_intersect(T.tokens(F.col("text")), T.tokens(F.col("before")))).alias("shared"))


CONTEXT_SQL = f"WITH {TURNS}, s AS (SELECT fact_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[^.!?\\n]|[.][0-9])+[.!?]?'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM turns), c AS (SELECT fact_id, unnest(ss) AS text, unnest(range(len(ss)))::INT AS claim FROM s), k AS (SELECT * FROM c WHERE length(text) >= 12), l AS (SELECT fact_id, claim, {TOK} AS ws, lag({TOK}) OVER (PARTITION BY fact_id ORDER BY claim) AS bs FROM k) SELECT fact_id, claim, len(list_intersect(ws, coalesce(bs, [])))::INT AS shared FROM l"

QUERIES = {
    "narrative_pairs": (narrative_pairs, PAIRS + ' SELECT "group", first, second, relation FROM rel'),
    "narrative_current_value": (narrative_current_value, f"WITH {_GROUPED} SELECT \"group\", subject, predicate, arg_max(fact_id, (clock, fact_id)) AS fact_id, arg_max(value, (clock, fact_id)) AS value FROM g WHERE value <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1"),
    "narrative_components": (narrative_components, COMPONENT_SQL),
    "narrative_order": (narrative_order, LAYER_SQL),
    "microcitations": (microcitations, CITE_SQL),
    "claim_edges": (claim_edges, "WITH l AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS o FROM lineitem) SELECT a.s AS a, b.s AS b, count(*) AS shared FROM l a JOIN l b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 4"),
    "survival_pressure": (survival_pressure, SURVIVAL_SQL),
    "ideal_coalition": (ideal_coalition, COALITION_SQL),
    "flow_regulation": (flow_regulation, FLOW_SQL),
    "counterfactual_choice": (counterfactual_choice, STRATEGY_SQL),
    "guarded_worlds": (guarded_worlds, GUARD_SQL),
    "reachability_partition": (reachability_partition, "WITH x AS (SELECT c_custkey, bool_or(o_orderstatus = 'F') AS r, count(o_custkey) > 0 AS d FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT CASE WHEN coalesce(r, false) THEN 'reachable' WHEN d THEN 'deferred' ELSE 'unreachable' END AS part, count(*) AS nodes FROM x GROUP BY 1"),
    "gauge_consensus": (gauge_consensus, "SELECT l_partkey AS part, count(DISTINCT l_suppkey % 5) AS seeds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 5) = 5"),
    "causal_weave": (causal_weave, WEAVE_SQL),
    "temporal_weave": (temporal_weave, DAYS_SQL),
    "verified_candidates": (verified_candidates, VERIFIED_SQL),
    "sentence_context": (sentence_context, CONTEXT_SQL),
}

#: Ranks are ints here; row numbers are wider in SQL.
for _name in ("causal_weave", "temporal_weave", "verified_candidates"):
    _query, _sql = QUERIES[_name]
    QUERIES[_name] = (_query, f"SELECT * REPLACE (rank::INT AS rank) FROM ({_sql})")
