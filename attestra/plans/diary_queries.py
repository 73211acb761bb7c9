"""Registered queries over statements of a diary, one for each line item and one diary for each order, and their SQL over the same sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import diary, retrieval
from attestra.plans import tables
from attestra.plans.tables import TURNS
from attestra.plans.text_queries import TOK, _bm25_sql

_S = "CAST({} AS STRING)"
#: Statements in SQL that Spark and the oracle both read; l: the line's number, q: its quantity, p: its part, k: its order.
STATEMENT = (
    "CASE WHEN l = 1 THEN 'I repaired the old boat at Port ' || CASE WHEN k % 3 = 0 THEN 'Arthur' ELSE 'Henry' END || '.'"
    " WHEN l = 2 THEN CASE WHEN k % 4 = 0 THEN 'I met them at Bay City.' WHEN k % 4 = 1 THEN 'It is worth two times what I paid.' ELSE 'We spent ' || " + _S.format("q") + " || ' hours jogging in the park.' END"
    " WHEN l = 3 THEN CASE WHEN k % 5 = 0 THEN 'I repaired the boat in Dover.' WHEN k % 5 = 1 THEN 'The clock is worth three times what I paid.' ELSE 'I usually spend ' || " + _S.format("q") + " || ' hours jogging.' END"
    " WHEN l = 4 THEN CASE WHEN q % 2 = 0 THEN 'I went camping for ' || " + _S.format("q % 9 + 1") + " || ' days in Utah.' ELSE 'I went camping in Utah on May ' || " + _S.format("q % 28 + 1") + " || '.' END"
    " WHEN l = 5 THEN CASE WHEN q % 3 = 0 THEN 'I spent about ' || " + _S.format("q") + " || ' minutes jogging with my spaniel.' ELSE 'I walked my young tabby and my car broke.' END"
    " WHEN l = 6 THEN CASE WHEN q % 4 = 0 THEN 'I attended the wedding of Anna and with Ben.' WHEN q % 4 = 1 THEN 'I went to the wedding of Ben.' WHEN q % 4 = 2 THEN 'I went to the wedding of Zoe.' ELSE 'I finished a 1/72 scale spitfire kit.' END"
    " ELSE CASE WHEN q % 3 = 0 THEN 'I attended the wedding of Zoe.' WHEN q % 3 = 1 THEN 'I built a corvette model.' ELSE 'The flight took ' || " + _S.format("q") + " || ' hours.' END END"
)
D = f"d AS (SELECT k, k * 10 + l AS fact_id, {STATEMENT} AS text FROM (SELECT l_orderkey AS k, l_linenumber AS l, l_quantity::INT AS q, l_partkey AS p FROM lineitem))"
NOT_DONE = r"\b(usually|always|every|plan|planning|will|want|would|might|hope|going to)\b"
ONTOLOGY = (("spaniel", "dog"), ("dog", "pet"), ("tabby", "cat"), ("cat", "pet"), ("pet", "animal"), ("car", "vehicle"))
TOKS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_TIMES = rf"t AS (SELECT k, fact_id, text, regexp_matches(lower(text), '\b(about|around|nearly|almost)\b') AS soft, unnest(regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)? (?:hour|minute|day)s?\b')) AS m FROM d WHERE NOT regexp_matches(lower(text), '{NOT_DONE}')), x AS (SELECT k, fact_id, text, soft, regexp_extract(m, '^([0-9.]+)', 1)::DECIMAL(18,4) * CASE WHEN contains(m, 'hour') THEN 3600 WHEN contains(m, 'minute') THEN 60 ELSE 86400 END AS seconds FROM t)"
_PLAIN = "CASE WHEN contains({0}, '.') THEN regexp_replace(regexp_replace({0}, '0+$', ''), '\\.$', '') ELSE {0} END"


def _diary(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_quantity").cast("int").alias("q"), F.col("l_partkey").alias("p"))
    return li.select("k", (F.col("k") * 10 + F.col("l")).alias("fact_id"), F.expr(STATEMENT).alias("text"))


def convergent_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """For every item the turn that shares the most words with it, at least two; several best turns must say the same."""
    asked = tables.query_texts(spark, folder).select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("asked"))
    held = tables.turns(spark, folder).select("fact_id", F.coalesce("text", F.lit("")).alias("text"))
    words = held.select("fact_id", F.explode_outer(F.array_distinct(T.tokens(F.col("text")))).alias("w")).filter("w IS NOT NULL")
    shared = words.join(asked.select("query_id", F.explode("asked").alias("w")), "w").groupBy("query_id", "fact_id").agg(F.count("*").alias("overlap")).join(held, "fact_id")
    return diary.convergent_lookup(shared.withColumn("signature", F.sha2(F.lower("text"), 256)), ["query_id"], "overlap", "signature", F.col("overlap") >= 2)


LOOKUP_SQL = f"WITH {TURNS}, w AS (SELECT DISTINCT fact_id, unnest({TOK}) AS w FROM turns), q AS (SELECT DISTINCT item_id::BIGINT AS query_id, unnest({TOK}) AS w FROM benchmark), o AS (SELECT query_id, fact_id, count(*) AS overlap FROM w JOIN q USING (w) GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT o.*, sha256(lower(coalesce(text, ''))) AS s, rank() OVER (PARTITION BY query_id ORDER BY overlap DESC) AS k FROM o JOIN turns USING (fact_id)) SELECT query_id, CASE WHEN count(DISTINCT s) = 1 THEN 'resolved' ELSE 'contested' END AS state, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS value, max(overlap) AS score, count(*) AS witnesses FROM b WHERE k = 1 GROUP BY 1"


def assistant_line(spark: SparkSession, folder: str) -> DataFrame:
    """The second sentence of the assistant turn that answers each item best and follows one of its best user turns."""
    t, asked = tables.turns(spark, folder), tables.query_texts(spark, folder)
    rank = lambda role: retrieval.bm25(t.filter(F.col("role") == role).select("fact_id", "text"), asked, 8)
    order = Window.partitionBy("session_id").orderBy(F.asc_nulls_last("sequence"), "fact_id")
    after = t.withColumn("then", F.lead("fact_id").over(order)).withColumn("by", F.lead("role").over(order)).filter("by = 'assistant'").select("fact_id", "then")
    following = rank("user").join(after, "fact_id").select("query_id", F.col("then").alias("fact_id"))
    found = diary.assistant_line(rank("assistant").select("query_id", "fact_id", "rank"), following, t, 2)
    return found.select("query_id", "fact_id", F.sha2("line", 256).alias("digest"))


def _role_sql(role: str, x: str) -> str:
    return f"{x}docs AS (SELECT fact_id, text FROM turns WHERE role = '{role}'), {_bm25_sql(docs=f'{x}docs', terms=f'{x}qt AS (SELECT DISTINCT query_id, unnest({TOK}) AS token FROM asked)', name=f'{x}scored', digits=9, x=x)}, {x}best AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS rank FROM {x}scored)"


LINE_SQL = f"""WITH {TURNS}, asked AS (SELECT item_id::BIGINT AS query_id, text FROM benchmark), {_role_sql('user', 'u')}, {_role_sql('assistant', 'r')},
n AS (SELECT fact_id, lead(fact_id) OVER w AS nxt, lead(role) OVER w AS who FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY sequence, fact_id)), f AS (SELECT query_id, nxt AS fact_id FROM ubest JOIN n USING (fact_id) WHERE rank <= 8 AND who = 'assistant'),
b AS (SELECT query_id, arg_min(fact_id, rank) AS fact_id FROM rbest WHERE rank <= 8 AND (query_id, fact_id) IN (SELECT query_id, fact_id FROM f) GROUP BY 1),
l AS (SELECT query_id, fact_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[^.!?\\n]|[.][0-9])+[.!?]?'), lambda s: trim(s)), lambda s: s <> '')[2] AS line FROM b JOIN turns USING (fact_id))
SELECT query_id, fact_id, sha256(line) AS digest FROM l WHERE line IS NOT NULL"""


def owned_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return diary.owned_kinds(_diary(spark, folder), spark.createDataFrame(list(ONTOLOGY), "child string, parent string"), ["k"], "animal")


_HAS = "len(list_intersect({0}, [{1}])) = {2}"
QUERIES = {
    "convergent_lookup": (convergent_lookup, LOOKUP_SQL),
    "assistant_line": (assistant_line, LINE_SQL),
    "place_of": (
        lambda s, f: diary.place_of(_diary(s, f), ["k"], "repaired", ("boat",)),
        rf"WITH {D}, a AS (SELECT k, fact_id AS anchor FROM d WHERE {_HAS.format(TOKS, chr(39) + 'repaired' + chr(39) + ', ' + chr(39) + 'boat' + chr(39), 2)}), n AS (SELECT k, fact_id, unnest(regexp_extract_all(text, '\b(?:at|in|from|to) ((?:[A-Z][a-z]+)(?: [A-Z][a-z]+)*)', 1)) AS name FROM d), v AS (SELECT k, lower(name) AS name FROM a JOIN n USING (k) WHERE abs(n.fact_id - anchor) <= 2 GROUP BY 1, 2 HAVING bool_or(n.fact_id = anchor) OR count(DISTINCT n.fact_id) >= 2), g AS (SELECT k, count(name) AS c, min(name) AS one FROM (SELECT DISTINCT k FROM a) LEFT JOIN v USING (k) GROUP BY 1) SELECT k, CASE WHEN c = 0 THEN 'abstain' WHEN c = 1 THEN 'resolved' ELSE 'contested' END AS state, CASE WHEN c = 1 THEN one END AS value FROM g",
    ),
    "relative_value": (
        lambda s, f: diary.relative_value(_diary(s, f), ["k"]),
        rf"WITH {D}, v AS (SELECT k, nullif(regexp_extract(lower(text), '\bworth (\w+ times) what i paid\b', 1), '') AS v FROM d) SELECT k, CASE WHEN count(DISTINCT v) = 0 THEN 'abstain' WHEN count(DISTINCT v) = 1 THEN 'resolved' ELSE 'contested' END AS state, CASE WHEN count(DISTINCT v) = 1 THEN 'it is worth ' || max(v) END AS value FROM v GROUP BY 1",
    ),
    "activity_total": (
        lambda s, f: diary.activity_total(_diary(s, f), ["k"], ("spent", "jogging")),
        f"WITH {D}, {_TIMES}, y AS (SELECT DISTINCT k, lower(text) AS said, seconds, soft FROM x WHERE {_HAS.format(TOKS, chr(39) + 'spent' + chr(39) + ', ' + chr(39) + 'jogging' + chr(39), 2)}), z AS (SELECT k, {_PLAIN.format('round(sum(seconds) / 3600, 2)::DECIMAL(18,2)::VARCHAR')} AS v, bool_or(soft) AS soft, count(*) AS atoms FROM y GROUP BY 1) SELECT k, CASE WHEN soft THEN 'around ' || v || ' hours' ELSE v END AS value, atoms FROM z",
    ),
    "scoped_days": (
        lambda s, f: diary.scoped_total(_diary(s, f), ["k"], "camping", "utah"),
        rf"WITH {D}, y AS (SELECT DISTINCT k, lower(text) AS said FROM d WHERE contains(lower(text), 'camping') AND contains(lower(text), 'utah') AND NOT regexp_matches(lower(text), '{NOT_DONE}')) SELECT k, sum(CASE WHEN regexp_matches(said, '\b[0-9]+ days?\b') THEN regexp_extract(said, '\b([0-9]+) days?\b', 1)::INT WHEN regexp_matches(said, '\bon (?:[a-z]+ [0-9]+|the [0-9]+)') THEN 1 ELSE 0 END)::BIGINT AS days, count(*) AS statements FROM y GROUP BY 1",
    ),
    "owned_kinds": (
        owned_kinds,
        rf"WITH {D}, m AS (SELECT DISTINCT k, unnest(regexp_extract_all(lower(text), '\bmy (?:[a-z]+ )?([a-z]+)', 1)) AS kind FROM d WHERE NOT regexp_matches(lower(text), '{NOT_DONE}')) SELECT k, count(kind) AS n FROM (SELECT DISTINCT k FROM d) LEFT JOIN (SELECT * FROM m WHERE kind IN ('spaniel', 'dog', 'tabby', 'cat', 'pet')) USING (k) GROUP BY 1",
    ),
    "attended_events": (
        lambda s, f: diary.attended(_diary(s, f), ["k"], "wedding"),
        rf"WITH {D}, r AS (SELECT k, fact_id, unnest(list_distinct(regexp_extract_all(text, '\b(?:with|of) ((?:[A-Z][a-z]+))', 1))) AS name FROM d WHERE regexp_matches(lower(text), '\b(attended|went to)\b.*\bwedding\b')), f AS (SELECT k, fact_id, min(name) AS root FROM r GROUP BY 1, 2), m AS (SELECT k, name, min(root) AS root FROM r JOIN f USING (k, fact_id) GROUP BY 1, 2), e AS (SELECT k, fact_id, min(root) AS event, count(DISTINCT root) AS t FROM r JOIN m USING (k, name) GROUP BY 1, 2) SELECT k, CASE WHEN max(t) > 1 THEN 'contested' ELSE 'resolved' END AS state, CASE WHEN max(t) = 1 THEN count(DISTINCT event)::VARCHAR END AS value FROM e GROUP BY 1",
    ),
    "artifact_count": (
        lambda s, f: diary.artifacts(_diary(s, f), ["k"]),
        rf"WITH {D}, r AS (SELECT k, regexp_extract(lower(text), '\b(?:1/[0-9]+ (?:scale )?)?([a-z0-9]+(?: [a-z0-9]+)?) (?:model|kit)\b', 1) AS label FROM d WHERE regexp_matches(lower(text), '\b(finished|built|completed|assembled)\b') AND NOT regexp_matches(lower(text), '{NOT_DONE}')) SELECT k, count(DISTINCT regexp_replace(label, '^(?:a|an|the|my) ', '')) AS n FROM r WHERE label <> '' GROUP BY 1",
    ),
    "never_said": (
        lambda s, f: diary.never_said(_diary(s, f), ["k"], ("jogging",), ("flight",)),
        f"WITH {D}, {_TIMES} SELECT k, 'not mentioned' AS value, min(fact_id) FILTER (WHERE list_contains({TOKS}, 'flight')) AS witness FROM x GROUP BY 1 HAVING NOT bool_or(list_contains({TOKS}, 'jogging')) AND witness IS NOT NULL",
    ),
}
