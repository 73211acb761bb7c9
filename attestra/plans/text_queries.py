"""Registered queries over documents and conversations: retrieval, fusion, budgets and text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.outcome import shown
from attestra.operators import ranking, retrieval
from attestra.operators.graphs import materialize
from attestra.plans import tables
from attestra.plans.tables import TURNS

TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
DOCS = "docs AS (SELECT doc_id AS fact_id, text FROM documents), asked AS (SELECT item_id::BIGINT AS query_id, text FROM benchmark)"
TERMS = f"qt AS (SELECT DISTINCT query_id, unnest({TOK}) AS token FROM asked)"


def _ranked(score: str, k: int, extra: str = "") -> str:
    return f"SELECT query_id, fact_id, {score} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM scored) WHERE rank <= {k} {extra}"


def _bm25_sql(docs: str = "docs", features: str = TOK, terms: str = TERMS, name: str = "scored", digits: int | None = None, x: str = "") -> str:
    """x: a prefix of the common table names, for a second use in one statement."""
    shown_ = "sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)))"
    return f"""{terms}, {x}t AS (SELECT fact_id, {features} AS ws FROM {docs}), {x}st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM {x}t),
{x}p AS (SELECT fact_id, len(ws) AS length, unnest(ws) AS token FROM {x}t), {x}tf AS (SELECT fact_id, length, token, count(*) AS tf FROM {x}p WHERE token IN (SELECT token FROM {x}qt) GROUP BY 1, 2, 3), {x}df AS (SELECT token, count(*) AS df FROM {x}tf GROUP BY 1),
{name} AS (SELECT query_id, fact_id, {shown_ if digits is None else f'round({shown_}, {digits})'} AS score FROM {x}tf JOIN {x}qt USING (token) JOIN {x}df USING (token), {x}st GROUP BY 1, 2)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.documents(spark, folder).select("fact_id", "text")


def _stable(scored: DataFrame, k: int) -> DataFrame:
    """Ranks by scores to nine digits, so that sums in another order rank alike."""
    return ranking.top_k(scored.withColumn("score", F.round("score", 9)), k, ["query_id"])


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(retrieval.bm25(_docs(spark, folder), tables.query_texts(spark, folder), 10))


def bm25_plus_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(retrieval.bm25(_docs(spark, folder), tables.query_texts(spark, folder), 10, delta=0.5))


def tfidf_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(retrieval.tfidf(_docs(spark, folder), tables.query_texts(spark, folder), 10))


TFIDF = f"""{TERMS}, t AS (SELECT fact_id, {TOK} AS ws FROM docs), st AS (SELECT count(*) AS n FROM t), p AS (SELECT fact_id, unnest(ws) AS token FROM t),
tf AS (SELECT fact_id, token, count(*) AS tf FROM p WHERE token IN (SELECT token FROM qt) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT query_id, fact_id, round(sum(tf * ln((n + 1) / (df + 1))), 9) AS score FROM tf JOIN qt USING (token) JOIN df USING (token), st GROUP BY 1, 2 HAVING sum(tf * ln((n + 1) / (df + 1))) > 0)"""

_BYTE = "('0x' || substr(h, {0}, 2))::INT"
HASHED = f"""hashed AS (SELECT k, b, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS w FROM (SELECT k, {_BYTE.format(1)} + 256 * {_BYTE.format(3)} AS b, sum(CASE WHEN {_BYTE.format(9)} % 2 = 1 THEN -1 ELSE 1 END * tf)::DOUBLE AS v
  FROM (SELECT k, token, sha256(token) AS h, count(*) AS tf FROM (SELECT k, unnest({TOK}) AS token FROM (SELECT 'd' || fact_id AS k, text FROM docs UNION ALL SELECT 'q' || query_id, text FROM asked)) GROUP BY 1, 2) GROUP BY 1, 2 HAVING sum(CASE WHEN {_BYTE.format(9)} % 2 = 1 THEN -1 ELSE 1 END * tf) <> 0)),
scored AS (SELECT substr(q.k, 2)::BIGINT AS query_id, substr(d.k, 2)::BIGINT AS fact_id, round(sum(q.w * d.w), 9) AS score FROM hashed q JOIN hashed d USING (b) WHERE q.k LIKE 'q%' AND d.k LIKE 'd%' GROUP BY 1, 2 HAVING round(sum(q.w * d.w), 12) > 0)"""


def dense_hash_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(retrieval.dense(_docs(spark, folder), tables.query_texts(spark, folder), 10))


def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(retrieval.hybrid(_docs(spark, folder), tables.query_texts(spark, folder), 10))


def embedding_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every twentieth vector against all, self included."""
    v = tables.table(spark, folder, "embeddings")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ranking.cosine_top(v, asked, 5).withColumn("score", F.round("score", 5)).select("query_id", "vec_id", "rank")


def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Three rankings of parts by price, size and name, for each brand."""
    p = tables.table(spark, folder, "part").select("p_brand", F.col("p_partkey").alias("fact_id"), "p_retailprice", "p_size", "p_name")
    parts = []
    for name, order in (("price", F.desc("p_retailprice")), ("size", F.desc("p_size")), ("name", F.asc("p_name"))):
        parts.append(p.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(order, "fact_id"))).filter("rank <= 20").select("p_brand", F.lit(name).alias("channel"), "fact_id", "rank"))
    return _rounded(ranking.fuse(parts[0].union(parts[1]).union(parts[2]), ["p_brand"], ["price", "size", "name"], 60, 12))


RRF_SQL = """WITH r AS (SELECT p_brand, p_partkey AS fact_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r0, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r1, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS r2 FROM part),
c AS (SELECT p_brand, fact_id, CASE WHEN r0 <= 20 THEN r0 ELSE 1000000000000000000 END AS a, CASE WHEN r1 <= 20 THEN r1 ELSE 1000000000000000000 END AS b, CASE WHEN r2 <= 20 THEN r2 ELSE 1000000000000000000 END AS c FROM r WHERE r0 <= 20 OR r1 <= 20 OR r2 <= 20),
s AS (SELECT *, (CASE WHEN a <= 20 THEN 1.0::DOUBLE / (60 + a) ELSE 0 END) + (CASE WHEN b <= 20 THEN 1.0::DOUBLE / (60 + b) ELSE 0 END) + (CASE WHEN c <= 20 THEN 1.0::DOUBLE / (60 + c) ELSE 0 END) AS score FROM c)
SELECT p_brand, fact_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(score, 12) DESC, least(a, b, c), a, b, c, fact_id) AS rank FROM s) WHERE rank <= 12"""


def protected_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Of each supplier's cheapest and largest parts: eight places, two of them for the second list."""
    li = tables.table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct().join(tables.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lists = li.groupBy("l_suppkey").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("p_retailprice", "p_partkey"))), lambda x: x["p_partkey"]), 1, 12).alias("a"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p_size")).alias("s"), "p_partkey"))), lambda x: x["p_partkey"]), 1, 12).alias("b"),
    )
    return lists.select("l_suppkey", F.array_join(F.slice(ranking.protected_merge(F.col("a"), F.col("b"), 8, 2), 1, 8).cast("array<string>"), ",").alias("merged"))


PROTECTED_SQL = """WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), j AS (SELECT l_suppkey, p_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_retailprice, p_partkey) AS ra, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_size DESC, p_partkey) AS rb FROM l JOIN part ON l_partkey = p_partkey),
h AS (SELECT l_suppkey, p_partkey, ra AS pos FROM j WHERE ra <= 6), x AS (SELECT l_suppkey, p_partkey, 6 + row_number() OVER (PARTITION BY l_suppkey ORDER BY rb) AS pos FROM j WHERE rb <= 12 AND ra > 6 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY rb) <= 2)
SELECT l_suppkey, string_agg(p_partkey::VARCHAR, ',' ORDER BY pos) AS merged FROM (SELECT * FROM h UNION ALL SELECT * FROM x) GROUP BY 1"""


def claim_sentences(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.claims(tables.turns(spark, folder))
    return found.groupBy("fact_id").agg(F.count("*").alias("claims"), F.max("claim").alias("last"), F.sum(F.char_length("text")).alias("chars"))


CLAIMS_SQL = f"WITH {TURNS}, s AS (SELECT fact_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[^.!?\\n]|[.][0-9])+[.!?]?'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM turns), c AS (SELECT fact_id, unnest(ss) AS t, unnest(range(len(ss)))::INT AS i FROM s) SELECT fact_id, count(*) AS claims, max(i) AS last, sum(length(t))::BIGINT AS chars FROM c WHERE length(t) >= 12 GROUP BY 1"


def channel_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted word, trigram and word-pair channels over conversation turns, for every benchmark item."""
    asked = tables.query_texts(spark, folder)
    found = retrieval.channels_top(tables.turns(spark, folder).select("fact_id", "text"), asked, 10, (0.5, 0.3, 0.2))
    return _rounded(found).select("query_id", "fact_id", "score", "rank")


_PAIRS = "list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
_GRAMS = f"list_distinct(flatten(list_transform({TOK}, lambda w: list_transform(range(1, greatest(length(w), 1) + 1), lambda i: substr('^' || w || '$', i, 3)))))"
CHANNEL_SQL = f"""WITH {TURNS}, docs AS (SELECT fact_id, text FROM turns), asked AS (SELECT item_id::BIGINT AS query_id, text FROM benchmark), {_bm25_sql(name='lex')}, {_bm25_sql(features=_GRAMS, terms=f'gqt AS (SELECT DISTINCT query_id, unnest({_GRAMS}) AS token FROM asked)', name='sub', x='g')},
qp AS (SELECT query_id, unnest({_PAIRS}) AS pair FROM (SELECT query_id, {TOK} AS ws FROM asked)), dp AS (SELECT fact_id, unnest({_PAIRS}) AS pair FROM t), rel AS (SELECT query_id, fact_id, count(*)::DOUBLE AS r FROM qp JOIN dp USING (pair) GROUP BY 1, 2),
c AS (SELECT query_id, fact_id, coalesce(lex.score, 0) AS l, coalesce(sub.score, 0) AS s, coalesce(r, 0) AS r FROM lex FULL JOIN sub USING (query_id, fact_id) FULL JOIN rel USING (query_id, fact_id)), m AS (SELECT query_id, max(l) AS ml, max(s) AS ms, max(r) AS mr FROM c GROUP BY 1),
scored AS (SELECT query_id, fact_id, round(0.5 * l / CASE WHEN ml > 0 THEN ml ELSE 1 END + 0.3 * s / CASE WHEN ms > 0 THEN ms ELSE 1 END + 0.2 * r / CASE WHEN mr > 0 THEN mr ELSE 1 END, 9) AS score FROM c JOIN m USING (query_id))
{_ranked('round(score, 6)', 10)}"""


def conformal_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose BM25 score is credible against the scores of the queries set apart for calibration (a quarter), at most ten for each other query."""
    asked = tables.query_texts(spark, folder)
    found = retrieval.conformal_top(_docs(spark, folder), asked.filter("query_id % 4 != 0"), asked.filter("query_id % 4 = 0"), 0.9, 10)
    return found.select("query_id", "fact_id", "rank", F.round("p_value", 6).alias("p_value"))


CONFORMAL_SQL = f"""WITH {DOCS}, {_bm25_sql(digits=9)}, u AS (SELECT score, query_id, fact_id, 0 AS n FROM scored WHERE query_id % 4 <> 0 UNION ALL SELECT score, NULL, NULL, 1 FROM scored WHERE query_id % 4 = 0),
pv AS (SELECT query_id, fact_id, score, (1.0 + sum(n) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING)) / (sum(n) OVER () + 1.0) AS p_value FROM u)
SELECT query_id, fact_id, rank, round(p_value::DOUBLE, 6) AS p_value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM pv WHERE query_id IS NOT NULL AND p_value > 0.9) WHERE rank <= 10"""


def _turn_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25(tables.turns(spark, folder).select("fact_id", "text"), tables.query_texts(spark, folder), 3)


SEEDS = f"{TURNS}, docs AS (SELECT fact_id, text FROM turns), asked AS (SELECT item_id::BIGINT AS query_id, text FROM benchmark), {_bm25_sql(digits=9)}, seeds AS ({_ranked('score', 3)}), placed AS (SELECT fact_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY sequence, fact_id) AS place FROM turns)"


def session_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.neighbours(_turn_seeds(spark, folder), tables.turns(spark, folder), 1)


NEIGHBOUR_SQL = f"""WITH {SEEDS}, n AS (SELECT s.query_id, b.fact_id, s.rank, abs(b.place - a.place) AS distance, b.place > a.place AS after FROM seeds s JOIN placed a USING (fact_id) JOIN placed b ON a.session_id = b.session_id AND abs(a.place - b.place) <= 1),
m AS (SELECT query_id, fact_id, rank, distance, after, row_number() OVER (PARTITION BY query_id, fact_id ORDER BY rank, distance, after) AS k FROM n)
SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, distance, after, fact_id) AS rank, distance::INT AS distance FROM m WHERE k = 1"""


def cavity_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.cavity(_turn_seeds(spark, folder), tables.turns(spark, folder), 2, 0.5).withColumn("incoming", F.round("incoming", 6))


CAVITY_SQL = f"WITH {SEEDS} SELECT s.query_id, b.fact_id, round(max(s.score * pow(0.5, abs(b.place - a.place) - 1)), 6) AS incoming FROM seeds s JOIN placed a USING (fact_id) JOIN placed b ON a.session_id = b.session_id AND abs(a.place - b.place) BETWEEN 1 AND 2 GROUP BY 1, 2"


def feedback_terms(spark: SparkSession, folder: str) -> DataFrame:
    docs, asked = _docs(spark, folder), tables.query_texts(spark, folder)
    best = retrieval.bm25(docs, asked, 5)
    return retrieval.feedback_terms(best, docs, asked)


FEEDBACK_SQL = f"""WITH {DOCS}, {_bm25_sql(digits=9)}, best AS ({_ranked('score', 5)}), dt AS (SELECT fact_id, unnest(list_distinct(ws)) AS token FROM t), alld AS (SELECT token, count(*) AS df FROM dt GROUP BY 1),
f AS (SELECT query_id, token, count(*) AS documents FROM best JOIN dt USING (fact_id) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT f.query_id, f.token, documents, alld.df FROM f JOIN alld USING (token), st WHERE NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = f.query_id AND qt.token = f.token) AND alld.df <= greatest(10.0, 0.2 * n)"""


def jaccard_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of one conversation with an eighth of their words in common."""
    return retrieval.near_pairs(tables.turns(spark, folder), "fact_id", 0.12, F.col("session_id"))


JACCARD_SQL = f"WITH {TURNS}, w AS (SELECT fact_id, session_id, list_distinct({TOK}) AS ws FROM turns), p AS (SELECT a.fact_id AS a, b.fact_id AS b, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) + len(b.ws) AS s FROM w a JOIN w b ON a.session_id = b.session_id AND a.fact_id < b.fact_id) SELECT a, b, round(i / (s - i), 6) AS jaccard FROM p WHERE s > 0 AND i / (s - i) >= 0.12"


def set_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each benchmark item's words every document covers that holds one of them."""
    return retrieval.set_coverage(_docs(spark, folder), tables.query_texts(spark, folder))


COVERAGE_SQL = f"""WITH {DOCS}, w AS (SELECT DISTINCT fact_id AS doc, unnest({TOK}) AS token FROM docs), q AS (SELECT DISTINCT query_id, unnest({TOK}) AS token FROM asked), n AS (SELECT count(DISTINCT doc) AS n FROM w), df AS (SELECT token, count(*) AS df FROM w GROUP BY 1),
x AS (SELECT query_id, token, ln((n + 1) / (coalesce(df, 0) + 1)) AS w FROM q LEFT JOIN df USING (token), n), a AS (SELECT query_id, sum(w) AS a FROM x GROUP BY 1), h AS (SELECT query_id, doc, sum(x.w) AS w, count(*) AS support FROM w JOIN x USING (token) GROUP BY 1, 2)
SELECT query_id, doc, round(h.w / a, 6) AS coverage, support, round(h.w / a * (1 + 0.05 * ln(1 + support)), 6) AS score FROM h JOIN a USING (query_id)"""


def budget_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Each query's ten best documents, as far as they fit into 6000 bytes, skipping what does not."""
    docs = _docs(spark, folder)
    best = retrieval.bm25(docs, tables.query_texts(spark, folder), 10)
    costs = docs.select("fact_id", F.octet_length("text").alias("cost")).join(F.broadcast(best), "fact_id")
    return shown(ranking.budget_fold(costs, ["query_id"], "cost", 6000))


BUDGET_SQL = f"""WITH RECURSIVE {DOCS}, {_bm25_sql(digits=9)}, best AS ({_ranked('score', 10)}), c AS (SELECT query_id, rank, fact_id, strlen(text) AS cost FROM best JOIN docs USING (fact_id)),
f AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, '' AS ids FROM (SELECT DISTINCT query_id FROM c) UNION ALL SELECT f.query_id, c.rank, CASE WHEN f.used + c.cost <= 6000 THEN f.used + c.cost ELSE f.used END, CASE WHEN f.used + c.cost <= 6000 THEN f.ids || CASE WHEN f.ids = '' THEN '' ELSE ',' END || c.fact_id ELSE f.ids END FROM f JOIN c ON c.query_id = f.query_id AND c.rank = f.rank + 1)
SELECT query_id, arg_max(ids, rank) AS fact_ids, arg_max(used, rank) AS used FROM f GROUP BY 1"""


def prefix_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    best = retrieval.bm25(docs, tables.query_texts(spark, folder), 10)
    costs = docs.select("fact_id", F.octet_length("text").cast("bigint").alias("cost")).join(F.broadcast(best), "fact_id")
    return ranking.prefix_within(costs, ["query_id"], "cost", 9000).select("query_id", "fact_id", "rank", "used")


PREFIX_SQL = f"WITH {DOCS}, {_bm25_sql(digits=9)}, best AS ({_ranked('score', 10)}), c AS (SELECT query_id, fact_id, rank, sum(strlen(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM best JOIN docs USING (fact_id)) SELECT * FROM c WHERE used <= 9000"


def max_cover(spark: SparkSession, folder: str) -> DataFrame:
    """A greedy cover of each query's words by its ten best documents."""
    docs, asked = _docs(spark, folder), tables.query_texts(spark, folder)
    best = retrieval.bm25(docs, asked, 10)
    words = docs.select("fact_id", F.array_distinct(T.tokens(F.col("text"))).alias("words"), F.octet_length("text").alias("cost"))
    wanted = asked.select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("asked"))
    rows = words.join(F.broadcast(best), "fact_id").join(wanted, "query_id").select("query_id", "fact_id", F.array_intersect("words", "asked").alias("tokens"), "cost")
    return ranking.max_cover(rows, "query_id", 20000)


def interleave_modes(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.table(spark, folder, "part")
    parts = []
    for name, order in (("cheap", F.asc("p_retailprice")), ("large", F.desc("p_size"))):
        parts.append(p.withColumn("rank", F.row_number().over(Window.partitionBy("p_type").orderBy(order, "p_partkey"))).filter("rank <= 10").select("p_type", F.lit(name).alias("mode"), F.col("p_partkey").alias("fact_id"), "rank"))
    return ranking.interleave(parts[0].union(parts[1]), ["p_type"], "mode")


INTERLEAVE_SQL = """WITH r AS (SELECT p_type, p_partkey AS fact_id, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS a, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS b FROM part),
m AS (SELECT p_type, fact_id, a AS rank, 'cheap' AS mode FROM r WHERE a <= 10 UNION ALL SELECT p_type, fact_id, b, 'large' FROM r WHERE b <= 10), f AS (SELECT p_type, fact_id, arg_min(mode, (rank, mode)) AS mode, min(rank) AS rank FROM m GROUP BY 1, 2)
SELECT p_type, fact_id, row_number() OVER (PARTITION BY p_type ORDER BY rank, mode, fact_id) AS position FROM f"""


def union_best(spark: SparkSession, folder: str) -> DataFrame:
    """Two candidate lists in one, each document once at its best score."""
    docs, asked = _docs(spark, folder), tables.query_texts(spark, folder)
    a = materialize(retrieval.bm25(docs, asked, 20), "best").select("query_id", "fact_id", "score", F.lit("words").alias("namespace"))
    b = a.filter("fact_id % 2 = 0").withColumn("score", F.col("score") * 1.5).withColumn("namespace", F.lit("even"))
    return _rounded(ranking.union_best([a, b], ["query_id", "fact_id"]))


UNION_SQL = f"WITH docs AS (SELECT doc_id AS fact_id, text FROM documents), asked AS (SELECT item_id::BIGINT AS query_id, text FROM benchmark), {_bm25_sql(digits=9)}, best AS ({_ranked('score', 20)}) SELECT query_id, fact_id, round(CASE WHEN fact_id % 2 = 0 THEN score * 1.5 ELSE score END, 6) AS score, CASE WHEN fact_id % 2 = 0 THEN 'even' ELSE 'words' END AS namespace FROM best"


def text_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Scalar text functions over every turn."""
    t = tables.turns(spark, folder)
    words = T.tokens(F.col("text"))
    return t.select("fact_id", F.size(words).alias("words"), F.size(T.sentences(F.col("text"))).alias("sentences"), F.size(F.array_distinct(words)).alias("kinds"), T.stable_id(F.col("text")).alias("stable_id"), F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("bytes"), F.size(T.bigrams(words)).alias("pairs"))


TEXT_SQL = f"WITH {TURNS}, w AS (SELECT fact_id, text, {TOK} AS ws FROM turns) SELECT fact_id, len(ws)::INT AS words, len(list_filter(list_transform(regexp_extract_all(text, '(?:[^.!?\\n]|[.][0-9])+[.!?]?'), lambda s: trim(s)), lambda s: s <> ''))::INT AS sentences, len(list_distinct(ws))::INT AS kinds, (('0x' || substr(sha256(text), 1, 16))::UBIGINT % 4611686018427387904)::BIGINT AS stable_id, sha256(text) AS digest, strlen(text)::INT AS bytes, len({_PAIRS})::INT AS pairs FROM w"


def stems(spark: SparkSession, folder: str) -> DataFrame:
    """How often each stem occurs."""
    words = _docs(spark, folder).select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"))


_STEM = " ".join(f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 4 THEN substr(w, 1, length(w) - {len(e)}) || '{i}'" for e, i in (("ingly", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("ies", "y"), ("es", ""), ("s", "")))
STEM_SQL = f"WITH w AS (SELECT unnest({TOK}) AS w FROM documents) SELECT CASE {_STEM} ELSE w END AS stem, count(*) AS n FROM w GROUP BY 1"

QUERIES = {
    "bm25_topk": (bm25_topk, f"WITH {DOCS}, {_bm25_sql(digits=9)} {_ranked('round(score, 6)', 10)}"),
    "bm25_plus_topk": (bm25_plus_topk, f"WITH {DOCS}, {_bm25_sql(digits=9).replace('ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))', 'ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) + 0.5)')} {_ranked('round(score, 6)', 10)}"),
    "tfidf_topk": (tfidf_topk, f"WITH {DOCS}, {TFIDF} {_ranked('round(score, 6)', 10)}"),
    "dense_hash_topk": (dense_hash_topk, f"WITH {DOCS}, {HASHED} {_ranked('round(score, 6)', 10)}"),
    "hybrid_rrf": (
        hybrid_rrf,
        f"WITH {DOCS}, {TFIDF}, lex AS ({_ranked('score', 32)}), den AS (WITH {HASHED} {_ranked('score', 32)}), c AS (SELECT query_id, fact_id, coalesce(l.rank, 1000000000000000000) AS a, coalesce(d.rank, 1000000000000000000) AS b, coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0) AS score FROM lex l FULL JOIN den d USING (query_id, fact_id)) SELECT query_id, fact_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, least(a, b), a, b, fact_id) AS rank FROM c) WHERE rank <= 10",
    ),
    "embedding_cosine_topk": (
        embedding_cosine_topk,
        "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5",
    ),
    "rrf_fuse": (rrf_fuse, RRF_SQL),
    "protected_merge": (protected_merge, PROTECTED_SQL),
    "claim_sentences": (claim_sentences, CLAIMS_SQL),
    "linear_channel_score": (channel_scores, CHANNEL_SQL),
    "conformal_filter": (conformal_filter, CONFORMAL_SQL),
    "session_neighbors": (session_neighbors, NEIGHBOUR_SQL),
    "cavity_neighbors": (cavity_neighbors, CAVITY_SQL),
    "feedback_terms": (feedback_terms, FEEDBACK_SQL),
    "jaccard_near_dup": (jaccard_near_dup, JACCARD_SQL),
    "set_coverage": (set_coverage, COVERAGE_SQL),
    "budget_fold": (budget_fold, BUDGET_SQL),
    "prefix_cutoff": (prefix_cutoff, PREFIX_SQL),
    "max_cover": (max_cover, None),
    "interleave_modes": (interleave_modes, INTERLEAVE_SQL),
    "union_best": (union_best, UNION_SQL),
    "text_columns": (text_columns, TEXT_SQL),
    "stem_counts": (stems, STEM_SQL),
}

#: Places in a list are ints here; row numbers are wider in SQL.
for _name, _column in [(n, "rank") for n in ("bm25_topk", "bm25_plus_topk", "tfidf_topk", "dense_hash_topk", "hybrid_rrf", "embedding_cosine_topk", "rrf_fuse", "linear_channel_score", "conformal_filter", "session_neighbors", "prefix_cutoff")] + [("interleave_modes", "position")]:
    _query, _sql = QUERIES[_name]
    QUERIES[_name] = (_query, f"SELECT * REPLACE ({_column}::INT AS {_column}) FROM ({_sql})")
