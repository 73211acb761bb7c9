"""Registered queries over passages that tell results, shares and dates, one for each order, and their SQL, which parses the same passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import proofs
from attestra.plans import tables

#: A passage in SQL that Spark and the oracle both read: a result (two for some, none for some), field goals with and without quarters, shares of
#: households and of people, and two dated events (one date for some).
_N = "CAST({} AS STRING)"
PASSAGE = (
    f"CASE WHEN k % 11 = 0 THEN '' ELSE 'The Reds beat the Blues ' || {_N.format('8 + k % 31')} || '-' || {_N.format('k % 17')} || '. ' END"
    f" || CASE WHEN k % 13 = 0 THEN 'Others say the score was ' || {_N.format('9 + k % 31')} || '-' || {_N.format('k % 17')} || '. ' ELSE '' END"
    f" || CASE WHEN k % 7 = 0 THEN 'Early on Jones hit a 33-yard field goal. ' ELSE '' END"
    f" || 'In the first quarter, Smith hit a ' || {_N.format('20 + k % 35')} || '-yard field goal. '"
    f" || CASE WHEN k % 3 = 0 THEN 'He added a ' || {_N.format('25 + k % 20')} || '-yard field goal. ' ELSE '' END"
    f" || CASE WHEN k % 4 = 0 THEN 'In the third quarter, Jones missed a 50-yard field goal. ' ELSE '' END"
    f" || {_N.format('10 + k % 50')} || '.5% of the households were couples. ' || {_N.format('5 + k % 60')} || '% of the households were singles. '"
    f" || CASE WHEN k % 19 = 0 THEN '3% of the households were couples. ' ELSE '' END"
    f" || {_N.format('k % 90')} || '% of the people were young. '"
    f" || 'The company was founded on 19' || lpad({_N.format('50 + k % 50')}, 2, '0') || '-03-0' || {_N.format('1 + k % 9')} || '. '"
    f" || CASE WHEN k % 17 = 0 THEN '' ELSE 'The factory opened on 20' || lpad({_N.format('k % 20')}, 2, '0') || '-11-1' || {_N.format('k % 9')} || '.' END"
)
ASKED = f"'If one has ' || {_N.format('k % 40')} || ' miles and another ' || {_N.format('k % 29')} || CASE WHEN k % 5 = 0 THEN ' tons' ELSE ' miles' END || ', what is the difference?'"
P = f"p AS (SELECT k, {PASSAGE} AS text FROM (SELECT o_orderkey AS k FROM orders))"
SENTENCES = r"s AS (SELECT k, unnest(regexp_extract_all(text, '(?:[^.!?\n]|[.][0-9])+[.!?]?')) AS said, unnest(range(len(regexp_extract_all(text, '(?:[^.!?\n]|[.][0-9])+[.!?]?')))) AS place FROM p)"
BASE = f"WITH {P}, {SENTENCES}"
_PLAIN = "CASE WHEN contains({0}, '.') THEN regexp_replace(regexp_replace({0}, '0+$', ''), '\\.$', '') ELSE {0} END"


def _passages(spark: SparkSession, folder: str, text: str = PASSAGE) -> DataFrame:
    return tables.table(spark, folder, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.expr(text).alias("text"))


def _verdict(found: str, value: str, bad: str = "n > 1") -> str:
    return f"SELECT k, CASE WHEN coalesce(n, 0) = 0 THEN 'abstain' WHEN {bad} THEN 'contested' ELSE 'resolved' END AS state, CASE WHEN coalesce(n, 0) > 0 AND NOT ({bad}) THEN {value} END AS value FROM p LEFT JOIN ({found}) USING (k)"


_SCORES = r"SELECT k, count(DISTINCT x) AS n, min(x) AS x FROM (SELECT k, [regexp_extract(said, '\b([0-9]{1,3})-([0-9]{1,3})\b', 1)::INT, regexp_extract(said, '\b([0-9]{1,3})-([0-9]{1,3})\b', 2)::INT] AS x FROM s WHERE regexp_matches(said, '\b(beat|won|score)\b') AND regexp_matches(said, '\b([0-9]{1,3})-([0-9]{1,3})\b')) GROUP BY 1"
_GOALS = r"""q AS (SELECT *, last_value(nullif(list_position(['first', 'second', 'third', 'fourth'], regexp_extract(lower(said), '\b(first|second|third|fourth) quarter\b', 1)), 0) IGNORE NULLS) OVER (PARTITION BY k ORDER BY place) AS quarter FROM s),
g AS (SELECT k, quarter, NOT regexp_matches(said, '\b(missed|blocked|no good)\b') AS good, unnest(regexp_extract_all(said, '\b([0-9]{1,3})-yard field goal\b', 1))::INT AS yards FROM q)"""
_SHARES = r"""h AS (SELECT DISTINCT k, regexp_extract(m, '% of the ([a-z]+)', 1) AS carrier, regexp_extract(m, 'were ([a-z]+)', 1) AS label, regexp_extract(m, '^([0-9.]+)', 1)::DECIMAL(18,4) AS share FROM (SELECT k, unnest(regexp_extract_all(lower(said), '\b[0-9]+(?:\.[0-9]+)?% of the [a-z]+ were [a-z]+')) AS m FROM s))"""
_EVENTS = r"""d AS (SELECT k, place, said, try_cast(regexp_extract(said, '\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b', 1) AS DATE) AS dt, regexp_extract_all(lower(said), '[\p{L}\p{N}]+') AS ws FROM s WHERE regexp_matches(said, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')),
e(side, ws) AS (VALUES ('left', ['company', 'was', 'founded']), ('right', ['new', 'factory', 'opened'])),
r AS (SELECT k, side, dt, place, len(list_intersect(e.ws, d.ws)) AS hit, row_number() OVER w AS i, coalesce(lead(len(list_intersect(e.ws, d.ws))) OVER w, 0) AS nxt FROM d, e WINDOW w AS (PARTITION BY k, side ORDER BY len(list_intersect(e.ws, d.ws)) DESC, place)),
b AS (SELECT k, max(dt) FILTER (WHERE side = 'left') AS l, max(dt) FILTER (WHERE side = 'right') AS r, max(place) FILTER (WHERE side = 'left') AS lp, max(place) FILTER (WHERE side = 'right') AS rp FROM r WHERE i = 1 AND hit > nxt AND hit >= 1.5 GROUP BY 1)"""


def _goals(spark: SparkSession, folder: str) -> DataFrame:
    return proofs.field_goals(_passages(spark, folder), ["k"])


def _with_shares(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = _passages(spark, folder)
    return docs, proofs.shares(docs, ["k"])


def _interval(spark: SparkSession, folder: str, **options) -> DataFrame:
    docs = _passages(spark, folder)
    docs = docs.select("k", "text", F.array(F.lit("the company was founded")).alias("left"), F.array(F.lit("new factory opened")).alias("right"))
    return proofs.interval_of(docs, ["k"], **options)


# the company's sentence has all four words of its event, so the oracle may leave out `the`, which both sentences have
_DAYS = "SELECT k, 1 AS n, {0} AS gap FROM b WHERE l IS NOT NULL AND r IS NOT NULL AND lp <> rp AND {0} > 0"

QUERIES = {
    "final_score_sum": (lambda s, f: proofs.score_sum(_passages(s, f), ["k"]), f"{BASE} {_verdict(_SCORES, '(x[1] + x[2])::VARCHAR')}"),
    "final_score_margin": (lambda s, f: proofs.score_margin(_passages(s, f), ["k"]), f"{BASE} {_verdict(_SCORES, 'abs(x[1] - x[2])::VARCHAR')}"),
    "terminal_score_margin": (lambda s, f: proofs.score_margin(_passages(s, f), ["k"], True), f"{BASE} {_verdict(_SCORES, '(x[1] - x[2])::VARCHAR', 'n > 1 OR x[1] <= x[2]')}"),
    "field_goal_extremes": (lambda s, f: proofs.goal_summary(_goals(s, f), ["k"]), f"{BASE}, {_GOALS} SELECT k, count(*) FILTER (WHERE good) AS made, min(yards) FILTER (WHERE good) AS shortest, max(yards) FILTER (WHERE good) AS longest FROM g GROUP BY 1"),
    "field_goal_quarters": (
        lambda s, f: proofs.goals_by_quarter(_goals(s, f), ["k"]),
        f"{BASE}, {_GOALS}, c AS (SELECT k, count(*) FILTER (WHERE good AND quarter IS NULL) AS loose, array_to_string([count(*) FILTER (WHERE good AND quarter = 1), count(*) FILTER (WHERE good AND quarter = 2), count(*) FILTER (WHERE good AND quarter = 3), count(*) FILTER (WHERE good AND quarter = 4)], ':') AS v FROM g GROUP BY 1) SELECT k, CASE WHEN loose > 0 THEN 'abstain' ELSE 'resolved' END AS state, CASE WHEN loose = 0 THEN v END AS value FROM c",
    ),
    "percentage_lookup": (lambda s, f: proofs.share_lookup(*_with_shares(s, f), ["k"], "couples"), f"{BASE}, {_SHARES} {_verdict('SELECT k, count(*) AS n, min(share) AS v FROM h WHERE label = ' + chr(39) + 'couples' + chr(39) + ' GROUP BY 1', _PLAIN.format('v::VARCHAR'))}"),
    "carrier_complement": (lambda s, f: proofs.share_lookup(*_with_shares(s, f), ["k"], "young", rest=True), f"{BASE}, {_SHARES} {_verdict('SELECT k, count(*) AS n, min(share) AS v FROM h WHERE label = ' + chr(39) + 'young' + chr(39) + ' GROUP BY 1', _PLAIN.format('(100 - v)::DECIMAL(18,4)::VARCHAR'))}"),
    "household_complement": (
        lambda s, f: proofs.partition_rest(*_with_shares(s, f), ["k"], "households"),
        f"{BASE}, {_SHARES} {_verdict('SELECT k, 1 AS n, count(*) AS c, count(DISTINCT label) AS l, sum(share) AS v FROM h WHERE carrier = ' + chr(39) + 'households' + chr(39) + ' GROUP BY 1', _PLAIN.format('(100 - v)::DECIMAL(18,4)::VARCHAR'), 'c <> l OR v > 100')}",
    ),
    "partition_filter_count": (
        lambda s, f: proofs.filter_count(*_with_shares(s, f), ["k"], "households", 20, 45, low_open=True),
        f"{BASE}, {_SHARES} {_verdict('SELECT k, 1 AS n, count(*) AS c, count(DISTINCT label) AS l, count(*) FILTER (WHERE share > 20 AND share <= 45) AS v FROM h WHERE carrier = ' + chr(39) + 'households' + chr(39) + ' GROUP BY 1', 'v::VARCHAR', 'c <> l')}",
    ),
    "passage_difference": (
        lambda s, f: proofs.bound_difference(*_with_shares(s, f), ["k"], "couples", "singles"),
        f"{BASE}, {_SHARES} {_verdict('SELECT k, greatest(count(*) FILTER (WHERE label = ' + chr(39) + 'couples' + chr(39) + '), count(*) FILTER (WHERE label = ' + chr(39) + 'singles' + chr(39) + ')) AS n, max(share) FILTER (WHERE label = ' + chr(39) + 'couples' + chr(39) + ') AS l, max(share) FILTER (WHERE label = ' + chr(39) + 'singles' + chr(39) + ') AS r FROM h GROUP BY 1 HAVING l IS NOT NULL AND r IS NOT NULL', _PLAIN.format('abs(l - r)::DECIMAL(18,4)::VARCHAR'))}",
    ),
    "event_date_interval": (lambda s, f: _interval(s, f), f"{BASE}, {_EVENTS} {_verdict(_DAYS.format('(r - l)'), 'gap::VARCHAR')}"),
    "event_year_interval": (lambda s, f: _interval(s, f, unit="year", closed=True), f"{BASE}, {_EVENTS} {_verdict(_DAYS.format('(year(r) - year(l) + 1)'), 'gap::VARCHAR')}"),
    "homogeneous_difference": (
        lambda s, f: proofs.homogeneous_difference(_passages(s, f, ASKED), ["k"]),
        f"WITH a AS (SELECT k, {ASKED} AS text FROM (SELECT o_orderkey AS k FROM orders)), x AS (SELECT k, regexp_extract_all(lower(text), '\\b([0-9]+(?:\\.[0-9]+)?) ([a-z]+)', 1) AS x, regexp_extract_all(lower(text), '\\b([0-9]+(?:\\.[0-9]+)?) ([a-z]+)', 2) AS u FROM a), y AS (SELECT k, u[1] AS u, len(x) = 2 AND u[1] = u[2] AND x[1]::DECIMAL(18,4) >= x[2]::DECIMAL(18,4) AS ok, (x[1]::DECIMAL(18,4) - x[2]::DECIMAL(18,4))::DECIMAL(18,4)::VARCHAR AS v FROM x) SELECT k, CASE WHEN ok THEN 'resolved' ELSE 'abstain' END AS state, CASE WHEN ok THEN {_PLAIN.format('v')} || ' ' || u END AS value FROM y",
    ),
}
