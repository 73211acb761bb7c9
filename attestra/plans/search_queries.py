"""Registered queries over proof-bounded searches, joins of metadata, evaluation tallies and single predicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import conjunctive, narrative, predicates, retrieval, search
from attestra.plans import recall, tables
from attestra.plans.tables import TURNS
from attestra.plans.text_queries import DOCS, SEEDS, TOK, _bm25_sql, _docs, _ranked
from attestra.sources import adapters


def authorized_route(spark: SparkSession, folder: str) -> DataFrame:
    """Each nation's name and a segment as a question over customers as facts of their nation; names that share a word abstain."""
    n = tables.table(spark, folder, "nation")
    c = tables.table(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    facts = c.select(F.col("c_custkey").alias("fact_id"), F.col("n_name").alias("subject"), F.col("c_mktsegment").alias("predicate"), F.char_length("c_name").alias("cost"))
    asked = n.select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.concat(F.lit("who buys for building or machinery in "), F.col("n_name")).alias("text"))
    return search.fiber_route(facts, asked, 20)


ROUTE_SQL = f"""WITH keys AS (SELECT DISTINCT n_name AS subject, unnest(list_concat([lower(n_name)], regexp_extract_all(lower(n_name), '[\\p{{L}}\\p{{N}}]+'))) AS key FROM nation JOIN customer ON c_nationkey = n_nationkey),
q AS (SELECT n_nationkey::BIGINT AS query_id, regexp_extract_all(lower('who buys for building or machinery in ' || n_name), '[\\p{{L}}\\p{{N}}]+') AS ws FROM nation),
m AS (SELECT query_id, count(DISTINCT subject) AS n, min(subject) AS subject FROM (SELECT query_id, unnest(ws) AS key FROM q) JOIN keys USING (key) GROUP BY 1),
r AS (SELECT query_id, n_name AS subject, c_custkey AS fact_id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(q.ws, regexp_extract_all(lower(c_mktsegment), '[\\p{{L}}\\p{{N}}]+'))) DESC, length(c_name), c_custkey) AS rank FROM q JOIN m USING (query_id) JOIN nation ON n_name = m.subject JOIN customer ON c_nationkey = n_nationkey WHERE m.n = 1)
SELECT query_id, CASE WHEN rank IS NULL THEN 'abstain' ELSE 'routed' END AS state, subject, fact_id, rank FROM q LEFT JOIN (SELECT * FROM r WHERE rank <= 20) USING (query_id)"""


def coherent_fiber(spark: SparkSession, folder: str) -> DataFrame:
    """For every part the first supplier whose lines are all final, or that has a line which contradicts."""
    li = tables.table(spark, folder, "lineitem")
    rows = li.select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("rank"), (F.col("l_returnflag") == "N").alias("closed"), ((F.col("l_discount") > 0.095) & (F.col("l_tax") > 0.075)).alias("conflict"))
    return search.coherent_fiber(rows, ["l_partkey"], "l_suppkey", "rank")


COHERENT_SQL = """WITH e AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_at, count(*) FILTER (WHERE l_returnflag <> 'N') AS open, count(*) FILTER (WHERE l_returnflag = 'N') AS shut, bool_or(l_discount > 0.095 AND l_tax > 0.075) AS bad FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY NOT (bad OR open = 0), CASE WHEN bad OR open = 0 THEN first_at ELSE open END, CASE WHEN bad OR open = 0 THEN 0 ELSE -shut END, l_suppkey) AS k FROM e)
SELECT l_partkey, l_suppkey, CASE WHEN bad THEN 'conflict' WHEN open = 0 THEN 'ready' ELSE 'incomplete' END AS state, open FROM f WHERE k = 1"""


def hypothesis_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that are sold by many, returned by some and never taxed high."""
    li = tables.table(spark, folder, "lineitem")
    many = li.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n")).filter("n >= 4")
    return search.survivors([many, li.filter("l_returnflag = 'R'"), li.groupBy("l_partkey").agg(F.max("l_tax").alias("t")).filter("t < 0.085")], "l_partkey")


def feedback_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The best six documents of every item by BM25, filled to ten by those that the dense ranking adds."""
    docs, asked = _docs(spark, folder), tables.query_texts(spark, folder)
    base = retrieval.bm25(docs, asked, 6)
    return search.conservative_tail(base, retrieval.tfidf(docs, asked, 32), 10, 32)


TAIL_SQL = f"""WITH {DOCS}, {_bm25_sql(digits=9)}, b AS (SELECT query_id, fact_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM scored) WHERE rank <= 6),
tw AS (SELECT query_id, fact_id, sum(tf * ln((n + 1) / (df + 1))) AS score FROM tf JOIN qt USING (token) JOIN df USING (token), st GROUP BY 1, 2), f AS (SELECT query_id, fact_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fact_id) AS rank FROM tw WHERE score > 0) WHERE rank <= 32),
u AS (SELECT query_id, fact_id, rank, false AS added FROM b UNION ALL SELECT query_id, fact_id, rank, true FROM f WHERE (query_id, fact_id) NOT IN (SELECT query_id, fact_id FROM b))
SELECT query_id, fact_id, place, added FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY added, rank, fact_id) AS place FROM u) WHERE place <= 10"""


def witness_bridges(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations whose every turn shares a long word with the turn before it."""
    t = tables.turns(spark, folder)
    long = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda w: F.char_length(w) >= 3))
    rows = t.select("session_id", F.col("sequence").alias("obligation"), F.when(F.col("sequence") > 0, F.col("sequence") - 1).alias("needs"), F.col("sequence").alias("turn"), long.alias("charges"))
    return search.bridges(rows, "session_id", 1)


BRIDGE_SQL = f"WITH {TURNS}, w AS (SELECT session_id, sequence, list_filter({TOK}, lambda w: length(w) >= 3) AS ws FROM turns) SELECT a.session_id, count(*) AS links, count(*) FILTER (WHERE list_has_any(a.ws, b.ws)) AS bridged, count(*) = count(*) FILTER (WHERE list_has_any(a.ws, b.ws)) AS kept FROM w a JOIN w b ON a.session_id = b.session_id AND a.sequence = b.sequence + 1 GROUP BY 1"


def message_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as messages with their returned lines as runs, if any, and the parts of those as sources."""
    o = tables.table(spark, folder, "orders").select(F.col("o_orderkey").alias("message"), "o_orderstatus")
    runs = tables.table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("message"), "l_partkey", "l_linenumber")
    sources = tables.table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return o.join(runs, "message", "left").join(sources, "l_partkey", "left").groupBy("message", "o_orderstatus").agg(F.count("l_linenumber").alias("runs"), F.count_distinct("p_brand").alias("sources"))


def outbox_either(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and suppliers that share a number or a nation, counted by nation of the customer."""
    c = tables.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    s = tables.table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return search.either_count(c, s, ("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey"), ["c_nationkey"])


def speaker_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Each item's best eight turns, those of the assistant first."""
    t = tables.turns(spark, folder)
    best = t.select("fact_id", "role").join(F.broadcast(retrieval.bm25(t.select("fact_id", "text"), tables.query_texts(spark, folder), 8)), "fact_id")
    return search.speakers_first(best, F.col("role") == "assistant").select("query_id", "fact_id", "place")


SPEAKER_SQL = f"WITH {SEEDS.replace('rank <= 3', 'rank <= 8')} SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY role = 'assistant' DESC, rank) AS place FROM seeds JOIN turns USING (fact_id)"


def paired_arms(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as queries that four arms answer; the last one missed some."""
    arms = F.explode(F.array(*[F.lit(a) for a in ("none", "sparse", "dense", "late")])).alias("arm")
    o = tables.table(spark, folder, "orders").select("o_orderkey", arms).filter("arm != 'late' OR o_orderkey % 100 != 0")
    k = F.col("o_orderkey") + F.char_length("arm")
    rows = o.select("o_orderkey", "arm", (k % 3 != 0).alias("supported"), (k % 4 != 0).alias("correct"), (k % 5 == 0).alias("abstained"), (F.col("o_orderkey") % 2 == 0).alias("negative"))
    return search.paired_arms(rows, "o_orderkey", "arm")


ARMS_SQL = """WITH a AS (SELECT o_orderkey, arm, o_orderkey + length(arm) AS k FROM orders, (VALUES ('none'), ('sparse'), ('dense'), ('late')) v(arm) WHERE arm <> 'late' OR o_orderkey % 100 <> 0)
SELECT arm, count(DISTINCT o_orderkey) AS queries, count(*) FILTER (WHERE k % 3 <> 0 AND k % 4 <> 0) AS correct_supported, count(*) FILTER (WHERE k % 3 <> 0 AND k % 4 = 0) AS wrong_supported, count(*) FILTER (WHERE k % 3 = 0 AND k % 4 <> 0) AS correct_unsupported, count(*) FILTER (WHERE o_orderkey % 2 = 0 AND k % 5 = 0) AS rightly_abstained,
count(*) = count(DISTINCT o_orderkey) AND count(DISTINCT o_orderkey) = (SELECT count(DISTINCT o_orderkey) FROM a) AS paired FROM a GROUP BY 1"""


def median_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of the median balance of each nation's customers, from 100 resamples."""
    return search.median_interval(tables.table(spark, folder, "customer"), ["c_nationkey"], "c_acctbal", 100)


MEDIAN_SQL = """WITH r AS (SELECT c_nationkey, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) - 1 AS pos FROM customer), n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
d AS (SELECT c_nationkey, n, x.draw, unnest(range(n)) AS i FROM n, range(100) x(draw)), e AS (SELECT c_nationkey, draw, ('0x' || substr(md5(draw || ':' || i), 1, 8))::BIGINT % n AS pos FROM d),
m AS (SELECT c_nationkey, draw, median(v) AS m FROM e JOIN r USING (c_nationkey, pos) GROUP BY 1, 2), o AS (SELECT c_nationkey, list_sort(list(m)) AS ms FROM m GROUP BY 1) SELECT c_nationkey, round(ms[3], 6) AS low, round(ms[97], 6) AS high FROM o"""


def proof_pressure_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Each item's turns by the words that they newly close, from the best 32 by words and by trigrams."""
    t, asked = tables.turns(spark, folder), tables.query_texts(spark, folder)
    docs = t.select("fact_id", "text")
    ranked = None
    for mode, features in (("direct", T.tokens), ("sublexical", T.trigrams)):
        part = retrieval.lexical_top(docs, asked, 32, features).select("query_id", F.lit(mode).alias("mode"), (F.col("rank") - 1).alias("rank"), "fact_id")
        ranked = part if ranked is None else ranked.union(part)
    held = docs.select("fact_id", F.octet_length("text").alias("cost"), F.array_distinct(T.tokens(F.col("text"))).alias("keys"))
    owed = asked.select("query_id", F.explode_outer(T.tokens(F.col("text"))).alias("key")).filter("key IS NOT NULL").groupBy("query_id", "key").agg(F.count("*").alias("n"))
    owed = owed.select("query_id", "key", F.when(F.col("key").rlike("^[0-9]+$"), 3.0).otherwise(1.0 + F.least(F.lit(0.5), 0.15 * (F.col("n") - 1))).alias("weight"))
    return search.pressure(held.join(F.broadcast(ranked), "fact_id"), owed, 12, 20000)


def numeric_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by whether their quantity lies in each of three kinds of bounds."""
    q = F.col("l_quantity")
    li = tables.table(spark, folder, "lineitem")
    return li.groupBy("l_suppkey").agg(F.count_if(predicates.within(q, 10, 20)).alias("closed"), F.count_if(predicates.within(q, 10, 20, True, True)).alias("open"), F.count_if(predicates.within(q, None, 20, high_open=True)).alias("below"), F.count_if(predicates.within(q, 10, None)).alias("above"))


def speaker_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of turns, read from a bracket where the column is empty; those of authority."""
    t = tables.turns(spark, folder).withColumn("said", F.when(F.col("sequence") % 3 == 0, F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.col("text"))).otherwise(F.col("text")))
    role = predicates.speaker_role(F.when(F.col("sequence") % 3 != 0, F.col("role")), F.col("said"))
    return t.groupBy(F.coalesce(role, F.lit("-")).alias("speaker")).agg(F.count("*").alias("turns"), F.count_if(role.isin("user")).alias("authoritative"))


def visibility_cone(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that an observer with a delay of a day sees at a clock, by predicate."""
    f = tables.facts(spark, folder).withColumn("recorded_at", F.col("observed_at"))
    return f.filter(F.col("recorded_at") + 86400 <= 1705276800).groupBy("predicate").agg(F.count("*").alias("visible"))


def hard_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of supplier and part that no returned line forbids."""
    li = tables.table(spark, folder, "lineitem")
    return conjunctive.hard_excluded(li.select("l_suppkey", "l_partkey").distinct(), li.filter("l_returnflag = 'R'").select("l_suppkey", "l_partkey"), ["l_suppkey", "l_partkey"]).groupBy("l_suppkey").agg(F.count("*").alias("pairs"))


def best_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn's longest sentence, the first of equals."""
    rows = retrieval.claims(tables.turns(spark, folder), 1).withColumn("score", F.char_length("text"))
    return narrative.best_sentence(rows, "score").select("fact_id", F.col("claim").cast("int").alias("claim"), F.sha2("text", 256).alias("digest"))


BEST_SQL = f"WITH {TURNS}, s AS (SELECT fact_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[^.!?\\n]|[.][0-9])+[.!?]?'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM turns), c AS (SELECT fact_id, unnest(ss) AS t, unnest(range(len(ss)))::INT AS claim FROM s) SELECT fact_id, claim, sha256(t) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY length(t) DESC, claim) AS k FROM c) WHERE k = 1"


def blob_store(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the digest of their text, each distinct text once."""
    found = adapters.content_addressed(tables.documents(spark, folder).select(F.coalesce("text", F.lit("")).alias("text")), "text")
    return found.select("path", F.octet_length("blob").cast("bigint").alias("bytes"))


def text_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs and UTF-8 prefixes of documents."""
    d = tables.documents(spark, folder).select("fact_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("fact_id", F.size(T.paragraphs(F.col("text"))).alias("paragraphs"))


def recall_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return recall.cascade(tables.turns(spark, folder), tables.query_texts(spark, folder))


QUERIES = {
    "recall_cascade": (recall_cascade, None),
    "authorized_route": (authorized_route, ROUTE_SQL),
    "coherent_fiber": (coherent_fiber, COHERENT_SQL),
    "hypothesis_survivors": (hypothesis_survivors, "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 4 AND bool_or(l_returnflag = 'R') AND max(l_tax) < 0.085"),
    "feedback_tail": (feedback_tail, TAIL_SQL),
    "witness_bridges": (witness_bridges, BRIDGE_SQL),
    "message_runs": (message_runs, "SELECT o_orderkey AS message, o_orderstatus, count(l_linenumber) AS runs, count(DISTINCT p_brand) AS sources FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"),
    "outbox_either": (outbox_either, "SELECT c_nationkey, count(*) AS pairs FROM customer JOIN supplier ON c_custkey = s_suppkey OR c_nationkey = s_nationkey GROUP BY 1"),
    "speaker_partition": (speaker_partition, SPEAKER_SQL),
    "paired_arms": (paired_arms, ARMS_SQL),
    "median_interval": (median_interval, MEDIAN_SQL),
    "proof_pressure_topk": (proof_pressure_topk, None),
    "numeric_bounds": (numeric_bounds, "SELECT l_suppkey, count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 20) AS closed, count(*) FILTER (WHERE l_quantity > 10 AND l_quantity < 20) AS open, count(*) FILTER (WHERE l_quantity < 20) AS below, count(*) FILTER (WHERE l_quantity >= 10) AS above FROM lineitem GROUP BY 1"),
    "speaker_roles": (speaker_roles, "SELECT coalesce(role, '-') AS speaker, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS authoritative FROM conversations GROUP BY 1"),
    "visibility_cone": (visibility_cone, f"WITH {tables.FACTS} SELECT predicate, count(*) AS visible FROM facts WHERE observed_at + 86400 <= 1705276800 GROUP BY 1"),
    "hard_exclusions": (hard_exclusions, "SELECT l_suppkey, count(*) AS pairs FROM (SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING NOT bool_or(l_returnflag = 'R')) GROUP BY 1"),
    "best_sentences": (best_sentences, BEST_SQL),
    "blob_store": (blob_store, "SELECT sha256(text) AS path, strlen(any_value(text)) AS bytes FROM (SELECT coalesce(text, '') AS text FROM documents) GROUP BY 1"),
    "text_shapes": (text_shapes, "SELECT doc_id AS fact_id, len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n+'), lambda s: trim(s)), lambda s: length(s) > 0))::INT AS paragraphs FROM documents"),
}
