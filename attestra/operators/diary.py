"""Answers that a speaker's own statements settle: unique best claims, places, values, durations, owned and attended things, and what was never said.

A statement is a row (by, fact_id, text). What a pattern reads from each statement is a column; agreement, identity and vetoes are aggregates over
the statements of a group, so a group of any size is combined where it is read. Texts are read in lower case where names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions.outcome import plain

#: Words that make a statement habitual or prospective, so that it reports nothing done.
NOT_DONE = r"(?i)\b(?:usually|always|every|plan|planning|will|want|would|might|hope|going to)\b"
PLACE = r"\b(?:at|in|from|to) ((?:[A-Z][a-z]+)(?: [A-Z][a-z]+)*)"
HOURS = r"\b([0-9]+(?:\.[0-9]+)?) (hour|minute|day)s?\b"
SECONDS = {"hour": 3600, "minute": 60, "day": 86400}


def _settled(found: DataFrame, by: list[str], kinds: str, value: Column) -> DataFrame:
    state = F.when(F.col(kinds) == 0, "abstain").when(F.col(kinds) == 1, "resolved").otherwise("contested")
    return found.select(*by, state.alias("state"), F.when(state == "resolved", value).alias("value"))


def convergent_lookup(candidates: DataFrame, by: list[str], score: str, signature: str, required: Column | None = None) -> DataFrame:
    """Of the candidates that meet what is required, those of the greatest score; they must say one thing."""
    kept = candidates if required is None else candidates.filter(required)
    best = kept.withColumn("_k", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score)))).filter("_k = 1")
    found = best.groupBy(*by).agg(F.count_distinct(signature).alias("kinds"), F.min(signature).alias("one"), F.max(score).alias("score"), F.count("*").alias("witnesses"))
    state = F.when(F.col("kinds") == 1, "resolved").otherwise("contested")
    return found.select(*by, state.alias("state"), F.when(state == "resolved", F.col("one")).alias("value"), "score", "witnesses")


def place_of(statements: DataFrame, by: list[str], action: str, terms: tuple[str, ...], reach: int = 2) -> DataFrame:
    """Where something happened: names after at, in, from or to in the statements that hold the action and all terms, and in their neighbours up to
    `reach` fact ids away; a neighbour's name counts if two statements or the anchor have it. One name resolves."""
    words = T.tokens(F.col("text"))
    anchors = statements.filter(F.size(F.array_except(F.array(*[F.lit(w) for w in (action, *terms)]), words)) == 0).select(*by, F.col("fact_id").alias("anchor"))
    named = statements.select(*by, "fact_id", F.explode_outer(F.regexp_extract_all("text", F.lit(PLACE), F.lit(1))).alias("name")).filter("name IS NOT NULL")
    near = anchors.select(*by, "anchor", F.explode(F.sequence(F.col("anchor") - reach, F.col("anchor") + reach)).alias("fact_id")).join(named, [*by, "fact_id"])
    votes = near.groupBy(*by, F.lower("name").alias("name")).agg(F.max(F.col("fact_id") == F.col("anchor")).alias("own"), F.count_distinct("fact_id").alias("facts")).filter("own OR facts >= 2")
    kinds = anchors.select(*by).distinct().join(votes.groupBy(*by).agg(F.count("*").alias("kinds"), F.min("name").alias("one")), by, "left").fillna(0, ["kinds"])
    return _settled(kinds, by, "kinds", F.col("one"))


def relative_value(statements: DataFrame, by: list[str]) -> DataFrame:
    """`worth three times what I paid`: all such spans of a group must agree."""
    span = F.regexp_extract(F.lower("text"), r"\bworth (\w+ times) what i paid\b", 1)
    found = statements.groupBy(*by).agg(F.count_distinct(F.nullif(span, F.lit(""))).alias("kinds"), F.max(F.nullif(span, F.lit(""))).alias("one"))
    return _settled(found, by, "kinds", F.concat(F.lit("it is worth "), F.col("one")))


def durations(statements: DataFrame, by: list[str]) -> DataFrame:
    """(by, fact_id, text, seconds, soft) of every time amount of a statement that reports something done."""
    rows = statements.filter(~F.col("text").rlike(NOT_DONE)).select(*by, "fact_id", "text", F.col("text").rlike(r"(?i)\b(?:about|around|nearly|almost)\b").alias("soft"), F.explode_outer(F.regexp_extract_all("text", F.lit(HOURS), F.lit(0))).alias("m")).filter("m IS NOT NULL")
    factor = F.create_map(*[x for k, v in SECONDS.items() for x in (F.lit(k), F.lit(v))])
    return rows.select(*by, "fact_id", "text", "soft", (F.regexp_extract("m", HOURS, 1).cast("decimal(18,4)") * F.element_at(factor, F.regexp_extract("m", HOURS, 2))).cast("decimal(28,4)").alias("seconds"))


def activity_total(statements: DataFrame, by: list[str], terms: tuple[str, ...], unit: str = "hour") -> DataFrame:
    """The time spent on an activity: amounts of the statements that name it, a repeated statement once; a softened one makes the total approximate."""
    words = T.tokens(F.col("text"))
    rows = durations(statements, by).filter(F.size(F.array_except(F.array(*[F.lit(t) for t in terms]), words)) == 0).select(*by, F.lower("text").alias("said"), "seconds", "soft").distinct()
    found = rows.groupBy(*by).agg(F.sum("seconds").alias("s"), F.max("soft").alias("soft"), F.count("*").alias("atoms"))
    value = plain((F.col("s") / SECONDS[unit]).cast("decimal(18,2)"))
    return found.select(*by, F.when(F.col("soft"), F.concat_ws(" ", F.lit("around"), value, F.lit(f"{unit}s"))).otherwise(value).alias("value"), "atoms")


def scoped_total(statements: DataFrame, by: list[str], mode: str, scope: str) -> DataFrame:
    """Days of an activity in one scope: the amounts of its statements, and a day for a dated one without an amount; other scopes do not count."""
    low = F.lower("text")
    done = statements.filter(~F.col("text").rlike(NOT_DONE) & F.contains(low, F.lit(mode)) & F.contains(low, F.lit(scope))).select(*by, low.alias("said")).distinct()
    days = F.regexp_extract("said", r"\b([0-9]+) days?\b", 1)
    n = F.when(days != "", days.cast("int")).when(F.col("said").rlike(r"\bon (?:[a-z]+ [0-9]+|the [0-9]+)"), 1).otherwise(0)
    return done.groupBy(*by).agg(F.sum(n).cast("bigint").alias("days"), F.count("*").alias("statements"))


def owned_kinds(statements: DataFrame, kinds: DataFrame, by: list[str], target: str, depth: int = 3) -> DataFrame:
    """How many different things below `target` in an ontology (kinds: child, parent) a group calls its own (`my ...`). The ontology's levels below the
    target are walked at most `depth` deep; what is only wished for does not count."""
    front = kinds.filter(F.col("parent") == target).select(F.col("child").alias("kind"))
    below = front
    for _ in range(depth - 1):
        front = kinds.join(front, kinds["parent"] == front["kind"]).select(F.col("child").alias("kind"))
        below = below.union(front)
    mine = statements.filter(~F.col("text").rlike(NOT_DONE)).select(*by, F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"\bmy (?:[a-z]+ )?([a-z]+)"), F.lit(1))).alias("kind"))
    own = mine.join(below.distinct(), "kind").select(*by, "kind").distinct()
    return statements.select(*by).distinct().join(own.groupBy(*by).agg(F.count("*").alias("n")), by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"))


def attended(statements: DataFrame, by: list[str], event: str) -> DataFrame:
    """How many events a group attended: statements of attendance are one event if they name a participant in common; one that names participants of two
    events contests the count, and one that names nobody is left out."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:with|of) ((?:[A-Z][a-z]+))"), F.lit(1)))
    rows = statements.filter(F.lower("text").rlike(rf"\b(?:attended|went to)\b.*\b{event}\b")).select(*by, "fact_id", names.alias("names")).filter(F.size("names") > 0)
    each = rows.select(*by, "fact_id", F.explode("names").alias("name"))
    # an event is told by its least name among statements that share one; two different ones in a statement's names contest
    first = each.groupBy(*by, "fact_id").agg(F.min("name").alias("root"))
    mapped = each.join(first, [*by, "fact_id"]).groupBy(*by, "name").agg(F.min("root").alias("root"))
    final = each.join(mapped, [*by, "name"]).groupBy(*by, "fact_id").agg(F.min("root").alias("event"), F.count_distinct("root").alias("touched"))
    return final.groupBy(*by).agg(F.count_distinct("event").alias("n"), F.max("touched").alias("t")).select(*by, F.when(F.col("t") > 1, "contested").otherwise("resolved").alias("state"), F.when(F.col("t") == 1, F.col("n").cast("string")).alias("value"))


def artifacts(statements: DataFrame, by: list[str]) -> DataFrame:
    """Different model kits that a group finished: the label before `kit` or `model`, without its scale, of statements with a completed action."""
    low = F.lower("text")
    rows = statements.filter(low.rlike(r"\b(?:finished|built|completed|assembled)\b") & ~F.col("text").rlike(NOT_DONE))
    label = F.regexp_extract(low, r"\b(?:1/[0-9]+ (?:scale )?)?([a-z0-9]+(?: [a-z0-9]+)?) (?:model|kit)\b", 1)
    return rows.select(*by, label.alias("label")).filter("label != ''").groupBy(*by).agg(F.count_distinct(F.regexp_replace("label", r"^(?:a|an|the|my) ", "")).alias("n"))


def never_said(statements: DataFrame, by: list[str], terms: tuple[str, ...], other: tuple[str, ...]) -> DataFrame:
    """`How long did ...` where no time amount stands with the asked terms but one stands with others: the fixed text, and the witness; groups that tell
    it, or tell no time at all, have no row."""
    words = T.tokens(F.col("text"))
    has = lambda ts: F.size(F.array_except(F.array(*[F.lit(t) for t in ts]), words)) == 0
    found = durations(statements, by).groupBy(*by).agg(F.max(has(terms)).alias("told"), F.min(F.when(has(other), F.col("fact_id"))).alias("witness"))
    return found.filter("NOT told AND witness IS NOT NULL").select(*by, F.lit("not mentioned").alias("value"), "witness")


def assistant_line(parents: DataFrame, successors: DataFrame, turns: DataFrame, ordinal: int) -> DataFrame:
    """parents: query_id, fact_id, rank of assistant turns; successors: query_id, fact_id of the assistant turns after the best user turns. The
    ordinal-th sentence of the best turn that both name: (query_id, fact_id, line)."""
    both = parents.join(successors.distinct(), ["query_id", "fact_id"], "left_semi")
    best = both.groupBy("query_id").agg(F.min(F.struct("rank", "fact_id")).alias("b")).select("query_id", "b.fact_id")
    said = best.join(turns.select("fact_id", "text"), "fact_id").withColumn("line", F.get(T.sentences(F.col("text")), F.lit(ordinal - 1)))
    return said.filter("line IS NOT NULL").select("query_id", "fact_id", "line")
