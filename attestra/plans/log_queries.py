"""Registered queries over operation logs, timelines, scoring tables and conjunctive programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators import competition, conjunctive, kv, timeline
from attestra.plans import tables
from attestra.plans.tables import EDGES, OP_LOG

READ_SEQ = 6000

_ORIGINAL = OP_LOG + ", firsts AS (SELECT operation_id, min(seq) AS first_seq FROM op_log GROUP BY 1), fresh AS (SELECT o.* FROM op_log o JOIN firsts f ON o.seq = f.first_seq AND o.operation_id = f.operation_id)"


def _texted(df: DataFrame, *columns: str) -> DataFrame:
    """Numbers that may be null as text, so results compare by value whatever reads them."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def kv_current_state(spark: SparkSession, folder: str) -> DataFrame:
    return _texted(kv.snapshot(tables.op_log(spark, folder)), "value")


def kv_snapshot_asof(spark: SparkSession, folder: str) -> DataFrame:
    return _texted(kv.snapshot(tables.op_log(spark, folder), READ_SEQ), "value")


def _snapshot_sql(where: str) -> str:
    return f"WITH {_ORIGINAL} SELECT fact_id, version, op, value::VARCHAR AS value, seq FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY version DESC, seq) AS k FROM fresh {where}) WHERE k = 1"


def kv_get(spark: SparkSession, folder: str) -> DataFrame:
    asked = spark.range(0, 900, 1, 4).select(F.col("id").alias("fact_id"))
    return _texted(kv.get(tables.op_log(spark, folder), asked, READ_SEQ), "value", "version")


def kv_dedup_replay(spark: SparkSession, folder: str) -> DataFrame:
    return kv.replays(tables.op_log(spark, folder))


def kv_conflict_audit(spark: SparkSession, folder: str) -> DataFrame:
    return kv.audit(tables.op_log(spark, folder))


AUDIT_SQL = f"""WITH {_ORIGINAL}, ranked AS (SELECT *, max(version) OVER w AS top FROM fresh WINDOW w AS (PARTITION BY fact_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
winners AS (SELECT fact_id, version, arg_min(op, seq) AS wop, arg_min(coalesce(value, -1), seq) AS wvalue FROM fresh GROUP BY 1, 2)
SELECT r.seq, CASE WHEN top IS NULL OR r.version > top THEN 'APPLIED' WHEN r.version < top THEN 'STALE_REJECTED' WHEN r.op = w.wop AND coalesce(r.value, -1) = w.wvalue THEN 'IDEMPOTENT' ELSE 'VERSION_CONFLICT' END AS state
FROM ranked r JOIN winners w ON r.fact_id = w.fact_id AND r.version = w.version
UNION ALL SELECT o.seq, CASE WHEN (o.op, o.fact_id, o.version, coalesce(o.value, -1)) = (p.op, p.fact_id, p.version, coalesce(p.value, -1)) THEN 'DEDUP_REPLAY' ELSE 'TXID_CONFLICT' END
FROM op_log o JOIN firsts f USING (operation_id) JOIN op_log p ON p.seq = f.first_seq WHERE o.seq <> f.first_seq"""


def kv_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """A base at a read sequence and the log after it, folded into a new generation."""
    log = kv.effective(tables.op_log(spark, folder))
    base = kv.snapshot(log, READ_SEQ)
    return _texted(kv.compact(base, log.filter(F.col("seq") > READ_SEQ)), "value")


def kv_export(spark: SparkSession, folder: str) -> DataFrame:
    return kv.export(kv.snapshot(tables.op_log(spark, folder)))


def kv_storage_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return kv.ledger(kv.snapshot(tables.op_log(spark, folder)))


def kv_unreachable(spark: SparkSession, folder: str) -> DataFrame:
    """Log entries that no current state stands on."""
    log = tables.op_log(spark, folder)
    return kv.unreachable(log.select(F.col("seq").alias("object_id")), kv.snapshot(log).select(F.col("seq").alias("object_id")))


# --- timelines ---------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = tables.table(spark, folder, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), at.alias("at"), F.floor(at / 86400).cast("bigint").alias("day"))


E = "e AS (SELECT event_id, user_id, event_type, round(value * 100)::BIGINT AS cents, floor(epoch(ts))::BIGINT AS sec, floor(epoch(ts))::BIGINT // 86400 AS day FROM events)"


def active_set_replay(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).filter("event_type in ('signup', 'error')").select("user_id", (F.col("cents") % 9).alias("entity"), F.when(F.col("event_type") == "signup", "add").otherwise("remove").alias("action"), "at", "event_id")
    return timeline.active_set(rows, ["user_id"], ["at", "event_id"])


def choice_earliest(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select("user_id", F.col("event_type").alias("choice"), F.col("day").alias("event_time"), F.col("event_id").alias("fact_id"))
    return _texted(timeline.choice(rows, ["user_id"], True), "fact_id")


def choice_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select("user_id", F.col("event_type").alias("choice"), F.col("day").alias("event_time"), F.col("event_id").alias("fact_id"))
    return _texted(timeline.choice(rows, ["user_id"], False), "fact_id")


def _choice_sql(pick: str) -> str:
    return f"""WITH {E}, f AS (SELECT user_id, event_type AS choice, {pick}(day) AS t, arg_{pick}(event_id, (day, event_id)) AS fact_id FROM e GROUP BY 1, 2),
b AS (SELECT user_id, {pick}(t) AS t FROM f GROUP BY 1), g AS (SELECT user_id, count(*) AS n, min(choice) AS choice, arg_min(fact_id, choice) AS fact_id FROM f JOIN b USING (user_id, t) GROUP BY 1)
SELECT user_id, CASE WHEN n > 1 THEN 'abstain' ELSE 'resolved' END AS state, CASE WHEN n = 1 THEN choice END AS value, CASE WHEN n > 1 THEN 'tied_choice_clock' ELSE 'unique_choice_clock' END AS reason, CASE WHEN n = 1 THEN fact_id::VARCHAR END AS fact_id FROM g"""


def consecutive_days(spark: SparkSession, folder: str) -> DataFrame:
    return _texted(timeline.consecutive_pairs(_events(spark, folder).filter("event_type = 'purchase'").select("user_id", "day"), ["user_id"]), "day")


def weighted_frequency_tie(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select("user_id", F.col("event_type").alias("label"), F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", 2).otherwise(1).alias("weight"))
    return timeline.weighted_frequency(rows, ["user_id"])


def chronological_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select("user_id", F.col("event_type").alias("label"), F.col("at").alias("event_time"))
    return timeline.chronology(rows, ["user_id"], 5)


def latest_scalar(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).filter("event_type = 'view'").select("user_id", F.col("cents").alias("value"), "at", "event_id")
    return timeline.latest_scalar(rows, ["user_id"], ["at", "event_id"])


def reference_interval(spark: SparkSession, folder: str) -> DataFrame:
    o = tables.table(spark, folder, "orders")
    then, now = F.to_date("o_orderdate"), F.lit("2001-08-15").cast("date")
    return o.select("o_orderkey", timeline.elapsed(then, now, "day").alias("days"), timeline.elapsed(then, now, "week").cast("string").alias("weeks"), timeline.elapsed(then, now, "month").alias("months"))


def monotone_acquisitions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).filter("event_type = 'click'").select("user_id", (F.floor(F.col("event_id") / 1000) * 10 + F.when(F.col("cents") % 211 == 0, -15).otherwise(0)).cast("bigint").alias("value"), "event_id")
    return _texted(timeline.monotone_count(rows, ["user_id"], "event_id"), "value")


def temporal_gauge(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).select("user_id", F.col("event_type").alias("label"), F.col("at").alias("event_time"), F.col("event_id").alias("fact_id"))
    return timeline.temporal_gauge(rows, ["user_id"], F.lit(1705276800).cast("bigint"), True)


# --- scoring tables ----------------------------------------------------------------------------------------------


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    return li.select((F.col("l_partkey") % 40).alias("ability"), (F.col("l_suppkey") % 7).alias("agent"), (F.col("l_returnflag") == "N").cast("int").alias("correct"), (F.col("l_returnflag") == "R").cast("int").alias("wrong"), (F.col("l_returnflag") == "A").cast("int").alias("missed"))


def wilson_tournament(spark: SparkSession, folder: str) -> DataFrame:
    return competition.tournament(_outcomes(spark, folder), "ability", "agent", 0.01).withColumn("winner", F.col("winner").cast("string"))


def evolution_fitness(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    rows = li.select((F.col("l_suppkey") % 50).alias("agent"), F.col("l_orderkey").alias("task"), (F.col("l_returnflag") == "N").alias("correct"), F.col("l_linenumber").alias("at"))
    return competition.fitness(rows, "agent", "task")


def entropy_choice(spark: SparkSession, folder: str) -> DataFrame:
    return competition.entropy_choice(tables.table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


def trajectory_median(spark: SparkSession, folder: str) -> DataFrame:
    return competition.trajectory(_events(spark, folder).withColumn("at", F.col("event_id")), ["user_id"], "at", "cents")


def shell_closure(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    return competition.shell_closure(li.select("l_suppkey", "l_quantity", F.lit(1).alias("cost")), ["l_suppkey"], "l_quantity", "cost", 100)


def quantize_levels(spark: SparkSession, folder: str) -> DataFrame:
    p = tables.table(spark, folder, "part")
    bounds = p.agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    rows = p.crossJoin(F.broadcast(bounds))
    return rows.groupBy(competition.quantize(F.col("p_retailprice"), F.col("low"), F.col("high"), 16).alias("level")).agg(F.count("*").alias("parts"))


def drive_winner(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    rows = li.select((F.col("l_orderkey") % 200).alias("slot"), (F.col("l_suppkey") % 9).alias("agent"), (F.col("l_partkey") % 4).alias("layer"), F.col("l_quantity").alias("strength"), ((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08)).alias("contradiction"))
    return competition.drive_winner(rows, ["slot"], "agent", 4, 10.0, 0.02).withColumn("winner", F.col("winner").cast("string"))


def interference_resolve(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    rows = li.select((F.col("l_orderkey") % 300).alias("slot"), F.col("l_shipdate").cast("date").cast("string").substr(1, 4).alias("canonical"), F.col("l_suppkey").alias("fact_id"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("amplitude"), (F.col("l_quantity") == 49).alias("hard_negative"))
    return competition.interference(rows, ["slot"], 0.5)


def observer_projection(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem")
    rows = li.select("l_suppkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("v"))
    return competition.orbit_average(rows, ["l_suppkey"], "l_linenumber", "v")


# --- conjunctive programs ----------------------------------------------------------------------------------------

GOALS = [("supplier_of", ("?supplier", "?nation")), ("in_region", ("?nation", "?region")), ("customer_of", ("customer:7", "?nation"))]


def conjunctive_join_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers in the nation of customer 7, and that nation's region, with the facts behind each."""
    found = conjunctive.query(tables.edges(spark, folder), GOALS, ["supplier", "region"])
    return found.select("supplier", "region", F.array_join(F.transform("monomials", lambda m: F.array_join(m.cast("array<string>"), "*")), "+").alias("provenance"), F.col("support").cast("bigint").alias("support"))


def conjunctive_answer(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's region, resolved or not, and how many answers there are."""
    found = conjunctive.environments(tables.edges(spark, folder), [("customer_of", ("?customer", "?nation")), ("in_region", ("?nation", "?region"))])
    return conjunctive.answer(found, ["customer"], "region")


def conjunctive_region_suppliers(spark: SparkSession, folder: str) -> DataFrame:
    found = conjunctive.environments(tables.edges(spark, folder), [("supplier_of", ("?supplier", "?nation")), ("in_region", ("?nation", "?region"))])
    return conjunctive.answer(found, ["region"], "supplier")


def _constraints(spark: SparkSession, folder: str) -> list[DataFrame]:
    n = tables.table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    s = tables.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"))
    r = tables.table(spark, folder, "region").select(F.col("r_regionkey").alias("region")).filter("region != 2")
    return [n, s, r]


def csp_worlds(spark: SparkSession, folder: str) -> DataFrame:
    return conjunctive.certain(conjunctive.worlds(_constraints(spark, folder)), ["nation"])


def csp_arc_consistency(spark: SparkSession, folder: str) -> DataFrame:
    pruned = conjunctive.arc_consistent(_constraints(spark, folder), 2)
    return pruned[0].select(F.lit("nation").alias("relation"), F.col("nation").cast("bigint").alias("k")).union(pruned[1].select(F.lit("supplier"), F.col("supplier"))).union(pruned[2].select(F.lit("region"), F.col("region").cast("bigint")))


def mediator_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Nations linked through a shared market segment of different customers, unless in one region."""
    c = tables.table(spark, folder, "customer")
    edges = c.select(F.concat(F.lit("n"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("src"), F.col("c_mktsegment").alias("dst"), F.col("c_custkey").alias("fact_id"))
    both = edges.union(edges.select(F.col("dst"), F.col("src"), "fact_id"))
    n = tables.table(spark, folder, "nation").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("k"), "n_regionkey")
    pairs = n.alias("x").join(n.alias("y"), "n_regionkey").select(F.col("x.k").alias("left"), F.col("y.k").alias("right"))
    return conjunctive.mediators(both, pairs).filter(F.col("left").startswith("n"))


def alias_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Parts reachable from one over shared names and brands in at most three hops."""
    p = tables.table(spark, folder, "part")
    links = p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("left"), F.concat_ws(":", "p_brand", "p_type", F.col("p_size").cast("string")).alias("right"))
    start = p.select(F.col("p_partkey").alias("query"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("form"))
    return conjunctive.alias_counts(start, links)


ALIAS_SQL = """WITH RECURSIVE links AS (SELECT 'part:' || p_partkey AS a, p_brand || ':' || p_type || ':' || p_size AS b FROM part), arcs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
w AS (SELECT p_partkey AS query, 'part:' || p_partkey AS form, 0 AS hop FROM part UNION SELECT w.query, arcs.b, w.hop + 1 FROM w JOIN arcs ON w.form = arcs.a WHERE w.hop < 3)
SELECT query, hop, count(*) AS forms FROM (SELECT query, form, min(hop) AS hop FROM w GROUP BY 1, 2) GROUP BY 1, 2"""


def gauge_transport(spark: SparkSession, folder: str) -> DataFrame:
    """Where walks over a rewriting of nation keys end."""
    n = tables.table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    arrows = n.filter("k % 5 != 0").select(F.col("k").alias("src"), F.when(F.col("k") == 13, 14).otherwise(F.when(F.col("k") == 14, 13).otherwise(F.floor(F.col("k") / 2))).cast("bigint").alias("dst"))
    return conjunctive.transport(n.select(F.col("k").alias("query"), F.col("k").alias("node")), arrows)


TRANSPORT_SQL = """WITH RECURSIVE a AS (SELECT n_nationkey::BIGINT AS src, CASE n_nationkey WHEN 13 THEN 14 WHEN 14 THEN 13 ELSE n_nationkey // 2 END::BIGINT AS dst FROM nation WHERE n_nationkey % 5 <> 0),
w AS (SELECT n_nationkey::BIGINT AS query, n_nationkey::BIGINT AS node, [n_nationkey::BIGINT] AS path, false AS back FROM nation UNION ALL SELECT query, dst, list_append(path, dst), list_contains(path, dst) FROM w JOIN a ON node = src WHERE NOT back AND len(path) <= 8),
e AS (SELECT query, node, back, len(path) > 8 AND NOT back AND src IS NOT NULL AS deep, src IS NULL AND NOT back AS done FROM w LEFT JOIN (SELECT DISTINCT src FROM a) ON node = src),
g AS (SELECT query, bool_or(back) AS cycle, bool_or(deep) AS deep, count(DISTINCT node) FILTER (WHERE done) AS ends, min(node) FILTER (WHERE done) AS node FROM e GROUP BY 1)
SELECT query, CASE WHEN cycle THEN 'cycle' WHEN deep THEN 'depth_exceeded' WHEN ends = 1 THEN 'resolved' ELSE 'conflict' END AS state, CASE WHEN NOT cycle AND NOT deep AND ends = 1 THEN node END AS value FROM g"""


def semi_join_intents(spark: SparkSession, folder: str) -> DataFrame:
    li = tables.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat_ws("", "l_returnflag", "l_linestatus").alias("term"))
    required = tables.table(spark, folder, "region").limit(0).select(F.col("r_name").alias("term")).union(spark.range(1).select(F.explode(F.array(F.lit("NO"), F.lit("RF"))).alias("term")))
    return conjunctive.intents_within(li, required)


def anti_join_supersession(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that no later report of their orbit replaces."""
    f = tables.facts(spark, folder)
    replaced = f.join(f.groupBy("event_id").agg(F.max("version").alias("top")), "event_id").filter("version < top").select(F.col("fact_id").alias("replaces"))
    return conjunctive.supersede(f.select("fact_id", "subject", "predicate", "version"), replaced)


SUPERSEDE_SQL = f"WITH {tables.FACTS} SELECT fact_id, subject, predicate, version FROM facts f WHERE NOT EXISTS (SELECT 1 FROM facts g WHERE g.orbit = f.orbit AND g.version > f.version)"


def operand_pair_margin(spark: SparkSession, folder: str) -> DataFrame:
    """The customer of each nation with the best balance, if it leads by 100."""
    c = tables.table(spark, folder, "customer").select("c_nationkey", F.col("c_acctbal").alias("score"), F.col("c_name").alias("name"))
    return conjunctive.best_unique(c, ["c_nationkey"], "score", "name", 0.0, 100.0).withColumn("score", F.round("score", 2))


QUERIES = {
    "kv_current_state": (kv_current_state, _snapshot_sql("")),
    "kv_snapshot_asof": (kv_snapshot_asof, _snapshot_sql(f"WHERE seq <= {READ_SEQ}")),
    "kv_get": (
        kv_get,
        f"WITH s AS ({_snapshot_sql(f'WHERE seq <= {READ_SEQ}')}) SELECT k.i AS fact_id, CASE WHEN op IS NULL THEN 'NOT_FOUND' WHEN op = 'DELETE' THEN 'DELETED' ELSE 'PRESENT' END AS state, CASE WHEN op = 'PUT' THEN value END AS value, version::VARCHAR AS version FROM range(900) k(i) LEFT JOIN s ON s.fact_id = k.i",
    ),
    "kv_dedup_replay": (
        kv_dedup_replay,
        f"WITH {OP_LOG}, firsts AS (SELECT operation_id, min(seq) AS first_seq FROM op_log GROUP BY 1) SELECT o.seq, o.operation_id, first_seq, CASE WHEN o.seq = first_seq THEN 'fresh' WHEN (o.op, o.fact_id, o.version, coalesce(o.value, -1)) = (p.op, p.fact_id, p.version, coalesce(p.value, -1)) THEN 'DEDUP_REPLAY' ELSE 'TXID_CONFLICT' END AS state FROM op_log o JOIN firsts f USING (operation_id) JOIN op_log p ON p.seq = first_seq",
    ),
    "kv_conflict_audit": (kv_conflict_audit, AUDIT_SQL),
    "kv_compaction": (kv_compaction, _snapshot_sql("")),
    "kv_export": (kv_export, f"WITH s AS ({_snapshot_sql('')}) SELECT fact_id, value::BIGINT AS value, sha256(fact_id || '|' || value || '|log|present') AS checksum FROM s WHERE op = 'PUT'"),
    "kv_storage_ledger": (kv_storage_ledger, f"WITH s AS ({_snapshot_sql('')}) SELECT CASE WHEN op = 'DELETE' THEN 'tombstone' ELSE 'value' END AS class, count(*) AS keys, sum(length(coalesce(value::VARCHAR, '')) + 8)::BIGINT AS bytes FROM s GROUP BY 1"),
    "kv_unreachable": (kv_unreachable, f"WITH s AS ({_snapshot_sql('')}) SELECT event_id AS object_id FROM events WHERE event_id NOT IN (SELECT seq FROM s)"),
    "active_set_replay": (
        active_set_replay,
        f"WITH {E}, l AS (SELECT user_id, cents % 9 AS entity, arg_max(event_type, (sec, event_id)) AS last FROM e WHERE event_type IN ('signup', 'error') GROUP BY 1, 2) SELECT user_id, count(*) FILTER (WHERE last = 'signup') AS active, count(*) AS entities FROM l GROUP BY 1",
    ),
    "choice_earliest": (choice_earliest, _choice_sql("min")),
    "choice_latest": (choice_latest, _choice_sql("max")),
    "consecutive_days": (
        consecutive_days,
        f"WITH {E}, d AS (SELECT DISTINCT user_id, day FROM e WHERE event_type = 'purchase'), p AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM d), g AS (SELECT user_id, count(*) FILTER (WHERE nxt - day = 1) AS pairs, min(day) FILTER (WHERE nxt - day = 1) AS day FROM p GROUP BY 1) SELECT user_id, CASE pairs WHEN 1 THEN 'resolved' WHEN 0 THEN 'abstain' ELSE 'contested' END AS state, CASE WHEN pairs = 1 THEN day::VARCHAR END AS day, pairs FROM g",
    ),
    "weighted_frequency_tie": (
        weighted_frequency_tie,
        f"WITH {E}, t AS (SELECT user_id, event_type AS label, sum(CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 2 ELSE 1 END)::BIGINT AS total FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, label DESC) AS k, lead(total) OVER (PARTITION BY user_id ORDER BY total DESC, label DESC) AS nxt FROM t) SELECT user_id, CASE WHEN total = nxt THEN 'abstain' ELSE 'resolved' END AS state, CASE WHEN nxt IS NULL OR total <> nxt THEN label END AS value, total, CASE WHEN total = nxt THEN 'tied_frequency_fiber' ELSE 'unique_frequency_maximum' END AS reason FROM r WHERE k = 1",
    ),
    "chronological_order": (
        chronological_order,
        f"WITH {E}, f AS (SELECT user_id, event_type AS label, min(sec) AS t FROM e GROUP BY 1, 2), g AS (SELECT user_id, string_agg(label, ' > ' ORDER BY t, label) AS o, count(*) AS n, count(DISTINCT t) AS times FROM f GROUP BY 1) SELECT user_id, CASE WHEN n < 5 THEN 'abstain' WHEN times < n THEN 'contested' ELSE 'resolved' END AS state, CASE WHEN n >= 5 AND times = n THEN o END AS value FROM g",
    ),
    "latest_scalar": (latest_scalar, f"WITH {E} SELECT user_id, 'resolved' AS state, arg_max(cents, (sec, event_id)) AS value, count(*) AS witnesses FROM e WHERE event_type = 'view' GROUP BY 1"),
    "reference_interval": (
        reference_interval,
        "WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS t, DATE '2001-08-15' AS n FROM orders), x AS (SELECT *, (n - t)::INT AS days FROM d) SELECT o_orderkey, days, CASE WHEN days % 7 <= 2 THEN floor(days / 7)::INT::VARCHAR END AS weeks, CASE WHEN days >= 0 THEN ((year(n) - year(t)) * 12 + month(n) - month(t) - CASE WHEN day(n) < day(t) THEN 1 ELSE 0 END)::INT END AS months FROM x",
    ),
    "monotone_acquisitions": (
        monotone_acquisitions,
        f"WITH {E}, v AS (SELECT user_id, event_id, (event_id // 1000) * 10 + CASE WHEN cents % 211 = 0 THEN -15 ELSE 0 END AS value FROM e WHERE event_type = 'click'), l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM v), g AS (SELECT user_id, coalesce(bool_or(value < b), false) AS fell, arg_max(value, event_id) AS last FROM l GROUP BY 1) SELECT user_id, CASE WHEN fell THEN 'contested' ELSE 'resolved' END AS state, CASE WHEN NOT fell THEN last::VARCHAR END AS value FROM g",
    ),
    "temporal_gauge": (
        temporal_gauge,
        f"WITH {E} SELECT user_id, gap, label, fact_id FROM (SELECT user_id, 1705276800 - sec AS gap, event_type AS label, event_id AS fact_id, row_number() OVER (PARTITION BY user_id ORDER BY 1705276800 - sec, event_id) AS k FROM e WHERE sec <= 1705276800) WHERE k = 1",
    ),
    "wilson_tournament": (
        wilson_tournament,
        """WITH r AS (SELECT l_partkey % 40 AS ability, l_suppkey % 7 AS agent, sum((l_returnflag = 'N')::INT)::DOUBLE AS s, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT ability, agent, (s / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(s / n * (1 - s / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) AS bound FROM r),
k AS (SELECT *, row_number() OVER w AS k, lead(bound) OVER w AS nxt FROM b WINDOW w AS (PARTITION BY ability ORDER BY bound DESC, agent DESC))
SELECT ability, CASE WHEN bound - coalesce(nxt, 0) >= 0.01 THEN agent::VARCHAR END AS winner, round(bound, 6) AS bound, round(bound - coalesce(nxt, 0), 6) AS lead FROM k WHERE k = 1""",
    ),
    "evolution_fitness": (
        evolution_fitness,
        """WITH s AS (SELECT l_orderkey AS task, l_suppkey % 50 AS agent, min(l_linenumber) AS t FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2), p AS (SELECT task, count(*) AS n, arg_min(agent, (t, agent)) AS first FROM s GROUP BY 1),
y AS (SELECT agent, count(*) AS solved, count(*) FILTER (WHERE n = 1) AS alone, count(*) FILTER (WHERE first = agent) AS firsts FROM s JOIN p USING (task) GROUP BY 1), z AS (SELECT *, solved + 2 * alone + firsts AS score FROM y), w AS (SELECT *, exp((score - max(score) OVER ()) / 10.0) AS w FROM z)
SELECT agent, solved, alone, firsts, round(w / sum(w) OVER (), 6) AS share FROM w""",
    ),
    "entropy_choice": (
        entropy_choice,
        """WITH l AS (SELECT 'l_returnflag' AS field, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem), c AS (SELECT field, v, count(*) AS c FROM l GROUP BY 1, 2)
SELECT field, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy, count(*) AS "values" FROM c GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1""",
    ),
    "trajectory_median": (
        trajectory_median,
        f"""WITH {E}, s AS (SELECT user_id, event_id - lag(event_id) OVER w AS dt, cents - lag(cents) OVER w AS dv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), t AS (SELECT * FROM s WHERE dt IS NOT NULL), m AS (SELECT user_id, median(dt) AS i, median(dv) AS st, count(*) AS n FROM t GROUP BY 1)
SELECT user_id, n, round(i, 6) AS interval, round(st, 6) AS step, round(avg(abs(dv - st)), 6) AS error FROM t JOIN m USING (user_id) GROUP BY user_id, n, i, st""",
    ),
    "shell_closure": (
        shell_closure,
        """WITH s AS (SELECT l_suppkey, l_quantity, count(*) AS c FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM s)
SELECT l_suppkey, count(*) AS shells, sum(c)::BIGINT AS members, max(running) AS cost FROM r WHERE running <= 100 GROUP BY 1""",
    ),
    "quantize_levels": (quantize_levels, "WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT round_even((p_retailprice - lo) / ((hi - lo) / 15), 0)::INT AS level, count(*) AS parts FROM part, b GROUP BY 1"),
    "drive_winner": (
        drive_winner,
        """WITH p AS (SELECT l_orderkey % 200 AS slot, l_suppkey % 9 AS agent, l_partkey % 4 AS layer, max(l_quantity) AS st, bool_or(l_discount = 0.1 AND l_tax = 0.08) AS bad FROM lineitem GROUP BY 1, 2, 3),
d AS (SELECT slot, agent, CASE WHEN bool_or(bad) OR count(*) < 4 THEN 0.0 ELSE exp(avg(ln(st))) END AS drive FROM p GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS k, lead(drive) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY slot ORDER BY drive DESC, agent DESC))
SELECT slot, CASE WHEN drive >= 10 AND drive - coalesce(nxt, 0) >= 0.02 * drive THEN agent::VARCHAR END AS winner, round(drive, 6) AS drive FROM k WHERE k = 1""",
    ),
    "interference_resolve": (
        interference_resolve,
        """WITH w AS (SELECT l_orderkey % 300 AS slot, substr(l_shipdate::DATE::VARCHAR, 1, 4) AS canonical, l_suppkey AS fact_id, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS a, l_quantity = 49 AS hard FROM lineitem),
o AS (SELECT slot, canonical, fact_id, a > 0 AS up, max(abs(a)) AS a, bool_or(hard) AS hard FROM w GROUP BY 1, 2, 3, 4), s AS (SELECT slot, canonical, sum(CASE WHEN up THEN a ELSE -a END) AS amplitude, count(DISTINCT fact_id) FILTER (WHERE up) AS witnesses, bool_or(hard) AS hard FROM o GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER x AS k, lead(amplitude) OVER x AS nxt FROM s WHERE NOT hard WINDOW x AS (PARTITION BY slot ORDER BY amplitude DESC, canonical DESC))
SELECT slot, CASE WHEN witnesses < 2 THEN 'abstain' WHEN amplitude - coalesce(nxt, 0) < 0.5 THEN 'contested' ELSE 'resolved' END AS state, canonical AS value, round(amplitude, 6) AS amplitude, witnesses FROM k WHERE k = 1""",
    ),
    "observer_projection": (
        observer_projection,
        """WITH p AS (SELECT l_suppkey, l_linenumber, arg_max(v, (abs(v), v)) AS v FROM (SELECT l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS v FROM lineitem) GROUP BY 1, 2)
SELECT l_suppkey, CASE WHEN abs(avg(v)) < 1e-12 THEN 0.0 ELSE round(avg(v), 6) END AS mean, count(*) AS paths FROM p GROUP BY 1""",
    ),
    "conjunctive_join_provenance": (
        conjunctive_join_provenance,
        f"""WITH {EDGES}, env AS (SELECT s.a0 AS supplier, r.a1 AS region, array_to_string(list_sort([s.fact_id, r.fact_id, c.fact_id]), '*') AS m FROM edges c JOIN edges s ON s.predicate = 'supplier_of' AND s.a1 = c.a1 JOIN edges r ON r.predicate = 'in_region' AND r.a0 = c.a1 WHERE c.predicate = 'customer_of' AND c.a0 = 'customer:7')
SELECT supplier, region, string_agg(DISTINCT m, '+' ORDER BY m) AS provenance, count(DISTINCT m) AS support FROM env GROUP BY 1, 2""",
    ),
    "conjunctive_answer": (
        conjunctive_answer,
        f"WITH {EDGES}, g AS (SELECT c.a0 AS customer, count(DISTINCT r.a1) AS answers, min(r.a1) AS one FROM edges c JOIN edges r ON r.predicate = 'in_region' AND r.a0 = c.a1 WHERE c.predicate = 'customer_of' GROUP BY 1) SELECT customer, CASE WHEN answers = 1 THEN 'resolved' ELSE 'contested' END AS state, CASE WHEN answers = 1 THEN one END AS value, answers, CASE WHEN answers = 1 THEN 'all_complete_environments_agree' ELSE 'complete_authorized_environments_disagree' END AS reason FROM g",
    ),
    "conjunctive_region_suppliers": (
        conjunctive_region_suppliers,
        f"WITH {EDGES}, g AS (SELECT r.a1 AS region, count(DISTINCT c.a0) AS answers, min(c.a0) AS one FROM edges c JOIN edges r ON r.predicate = 'in_region' AND r.a0 = c.a1 WHERE c.predicate = 'supplier_of' GROUP BY 1) SELECT region, CASE WHEN answers = 1 THEN 'resolved' ELSE 'contested' END AS state, CASE WHEN answers = 1 THEN one END AS value, answers, CASE WHEN answers = 1 THEN 'all_complete_environments_agree' ELSE 'complete_authorized_environments_disagree' END AS reason FROM g",
    ),
    "csp_worlds": (csp_worlds, "SELECT n_nationkey AS nation, count(*) AS worlds, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'contested' END AS state FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY 1"),
    "csp_arc_consistency": (
        csp_arc_consistency,
        "WITH w AS (SELECT n_nationkey, s_suppkey, n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey <> 2) SELECT DISTINCT 'nation' AS relation, n_nationkey::BIGINT AS k FROM w UNION ALL SELECT DISTINCT 'supplier', s_suppkey FROM w UNION ALL SELECT DISTINCT 'region', n_regionkey::BIGINT FROM w",
    ),
    "mediator_paths": (
        mediator_paths,
        """WITH c AS (SELECT 'n' || lpad(c_nationkey::VARCHAR, 2, '0') AS n, c_mktsegment AS m, c_custkey AS f FROM customer)
SELECT a.n AS "left", b.n AS "right", count(DISTINCT a.m) AS mediators, count(*) AS paths FROM c a JOIN c b ON a.m = b.m AND a.n < b.n AND a.f <> b.f JOIN nation x ON 'n' || lpad(x.n_nationkey::VARCHAR, 2, '0') = a.n JOIN nation y ON 'n' || lpad(y.n_nationkey::VARCHAR, 2, '0') = b.n WHERE x.n_regionkey <> y.n_regionkey GROUP BY 1, 2""",
    ),
    "alias_closure": (alias_closure, ALIAS_SQL),
    "gauge_transport": (gauge_transport, TRANSPORT_SQL),
    "semi_join_intents": (semi_join_intents, "SELECT l_orderkey AS doc FROM lineitem WHERE l_returnflag || l_linestatus IN ('NO', 'RF') GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) = 2"),
    "anti_join_supersession": (anti_join_supersession, SUPERSEDE_SQL),
    "operand_pair_margin": (
        operand_pair_margin,
        "WITH k AS (SELECT c_nationkey, c_name, c_acctbal, row_number() OVER w AS k, lead(c_acctbal) OVER w AS nxt FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name)) SELECT c_nationkey, CASE WHEN c_acctbal >= 0 AND c_acctbal - coalesce(nxt, 0) >= 100 THEN 'resolved' ELSE 'abstain' END AS state, CASE WHEN c_acctbal >= 0 AND c_acctbal - coalesce(nxt, 0) >= 100 THEN c_name END AS value, round(c_acctbal, 2) AS score FROM k WHERE k = 1",
    ),
}
