"""Searches that stop when a proof is closed: exact subject routes, coherent fibers, pressure on open obligations, bounded feedback, bridges
between witnesses. Candidate lists are bounded per query before anything is gathered."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T


def fiber_route(facts: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """facts: fact_id, subject, predicate, cost; queries: query_id, text. A query whose words name exactly one subject is routed to its facts:
    those whose predicate shares the most words first, then cheap ones, then by id; any other query abstains with no fact.

    A subject is named by itself in lower case or by any of its words; a word that two subjects share names both."""
    subjects = facts.select("subject").distinct()
    keys = subjects.select("subject", F.explode(F.array_union(F.array(F.lower("subject")), T.tokens(F.col("subject")))).alias("key"))
    asked = queries.select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("asked"))
    named = asked.select("query_id", F.explode_outer("asked").alias("key")).join(keys, "key").groupBy("query_id").agg(F.count_distinct("subject").alias("n"), F.min("subject").alias("subject"))
    routed = asked.join(named.filter("n = 1").drop("n"), "query_id").join(facts, "subject")
    overlap = F.size(F.array_intersect("asked", F.array_distinct(T.tokens(F.col("predicate")))))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "cost", "fact_id")
    best = routed.withColumn("overlap", overlap).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "subject", "fact_id", "rank")
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", F.when(F.col("rank").isNull(), "abstain").otherwise("routed").alias("state"), "subject", "fact_id", "rank")


def coherent_fiber(closures: DataFrame, by: list[str], fiber: str, rank: str) -> DataFrame:
    """closures: by, fiber, rank, closed, conflict, a row for each obligation of each fiber. The first fiber in retrieval order whose obligations
    all close, or that holds a conflict; without one the fiber with the fewest open obligations, then the most closed ones, then the least key, is
    `incomplete`."""
    each = closures.groupBy(*by, fiber).agg(F.min(rank).alias("at"), F.count_if(~F.col("closed")).alias("open"), F.count_if("closed").alias("shut"), F.max("conflict").alias("conflict"))
    ends = F.col("conflict") | (F.col("open") == 0)
    state = F.when(F.col("conflict"), "conflict").when(F.col("open") == 0, "ready").otherwise("incomplete")
    choice = F.struct((~ends).alias("late"), F.when(ends, F.col("at")).otherwise(F.col("open")).alias("x"), F.when(ends, F.lit(0)).otherwise(-F.col("shut")).alias("y"), F.col(fiber).alias("fiber"), state.alias("state"), F.col("open").alias("open"))
    return each.groupBy(*by).agg(F.min(choice).alias("c")).select(*by, F.col("c.fiber").alias(fiber), "c.state", "c.open")


def survivors(candidates: list[DataFrame], key: str) -> DataFrame:
    """What every hypothesis keeps: semi-joins, one after another."""
    out = candidates[0].select(key).distinct()
    for c in candidates[1:]:
        out = out.join(c.select(key), key, "left_semi")
    return out


def conservative_tail(base: DataFrame, feedback: DataFrame, limit: int, frontier: int) -> DataFrame:
    """base, feedback: query_id, fact_id, rank. The base list as it is, and what feedback adds in its own order where places are left."""
    head = base.filter(F.col("rank") <= limit).select("query_id", "fact_id", F.lit(0).alias("part"), "rank")
    more = feedback.filter(F.col("rank") <= frontier).join(head.select("query_id", "fact_id"), ["query_id", "fact_id"], "left_anti").select("query_id", "fact_id", F.lit(1).alias("part"), "rank")
    order = Window.partitionBy("query_id").orderBy("part", "rank", "fact_id")
    return head.union(more).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "fact_id", "place", (F.col("part") == 1).alias("added"))


def bridges(witnesses: DataFrame, environment: str, max_hops: int) -> DataFrame:
    """witnesses: environment, obligation, needs (the obligation it depends on, or null), turn, charges. (environment, links, bridged, kept): how
    many dependent pairs an environment has, how many share a charge within the hops, and whether all do.

    The pairs meet by what they depend on, each obligation having one witness in an environment."""
    left = witnesses.select(environment, F.col("obligation").alias("needs"), F.col("turn").alias("lt"), F.col("charges").alias("lc"))
    pairs = witnesses.filter("needs IS NOT NULL").join(left, [environment, "needs"])
    gap = F.col("turn") - F.col("lt")
    good = gap.between(0, max_hops) & F.arrays_overlap("charges", "lc")
    found = pairs.groupBy(environment).agg(F.count("*").alias("links"), F.count_if(F.coalesce(good, F.lit(False))).alias("bridged"))
    return found.select(environment, "links", "bridged", (F.col("links") == F.col("bridged")).alias("kept"))


def either_key(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """left joined to right where either pair of keys is equal, each pair of rows once: two equi-joins, the second without what the first found."""
    a = left.join(right, F.col(first[0]) == F.col(first[1]))
    b = left.join(right, F.col(second[0]) == F.col(second[1])).filter(~F.coalesce(F.col(first[0]) == F.col(first[1]), F.lit(False)))
    return a.union(b)


def either_count(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], by: list[str]) -> DataFrame:
    """(by, pairs): how many pairs either_key gives for each `by` of left, from counts of keys, without the pairs. Groups without a pair have no row."""

    def met(keys: list[tuple[str, str]]) -> DataFrame:
        own, other = list(dict.fromkeys([*by, *[k for k, _ in keys]])), [k for _, k in keys]
        a = left.groupBy(*own).agg(F.count("*").alias("_a"))
        b = right.groupBy(*other).agg(F.count("*").alias("_b"))
        both = F.lit(True)
        for x, y in keys:
            both = both & (F.col(x) == F.col(y))
        return a.join(b, both).select(*by, (F.col("_a") * F.col("_b")).alias("pairs"))

    twice = met([first, second]).select(*by, (-F.col("pairs")).alias("pairs"))
    return met([first]).union(met([second])).union(twice).groupBy(*by).agg(F.sum("pairs").alias("pairs"))


def pressure(candidates: DataFrame, obligations: DataFrame, limit: int, budget: int | None = None) -> DataFrame:
    """candidates: query_id, mode, rank (from 0), fact_id, cost, keys; obligations: query_id, key, weight. Each query's greedy order by the
    weight of obligations that a candidate newly closes, then by gain (that weight, the reciprocal of its rank and a little less for its
    cost), then cheap ones, then rank, mode and id, until nothing closes anything: (query_id, fact_id, position, closed).

    A frontier is bounded for each query and mode, so that a query is one small group; queries share nothing."""

    def order(keys: tuple, rows: pd.DataFrame, owed: pd.DataFrame) -> pd.DataFrame:
        weight = dict(zip(owed["key"], owed["weight"], strict=True))
        left = [(r.mode, int(r.rank), int(r.fact_id), int(r.cost), frozenset(r.keys_) & weight.keys()) for r in rows.itertuples()]
        shut: set[str] = set()
        picked: list[tuple[int, int]] = []
        used = 0
        while left and len(picked) < limit:
            best = None
            for mode, rank, fact, cost, held in left:
                closure = math.fsum(weight[k] for k in held - shut)
                gain = closure + 1.0 / (1.0 + rank) - math.log2(1 + cost) / 100.0
                choice = (round(closure, 9), round(gain, 9), -cost, -rank, mode, -fact)
                if (budget is None or used + cost <= budget) and (best is None or choice > best[0]):
                    best = choice, fact, cost, held
            if best is None or best[0][0] <= 0:
                break
            _, fact, cost, held = best
            picked.append((fact, len(held - shut)))
            shut |= held
            used += cost
            left = [c for c in left if c[2] != fact]
        query = keys[0]
        return pd.DataFrame({"query_id": [query] * len(picked), "fact_id": [p[0] for p in picked], "position": range(1, len(picked) + 1), "closed": [p[1] for p in picked]})

    rows = candidates.select("query_id", "mode", "rank", "fact_id", "cost", F.col("keys").alias("keys_"))
    return rows.groupBy("query_id").cogroup(obligations.select("query_id", "key", "weight").groupBy("query_id")).applyInPandas(order, "query_id long, fact_id long, position int, closed int")


def speakers_first(ranked: DataFrame, matched: Column) -> DataFrame:
    """Matches move to the front of each query's ranking, which else keeps its order; where nothing matches it stays."""
    order = Window.partitionBy("query_id").orderBy(F.desc(matched), "rank")
    return ranked.withColumn("place", F.row_number().over(order))


def paired_arms(trials: DataFrame, query: str, arm: str) -> DataFrame:
    """trials: query, arm, supported, correct, abstained, negative. Each arm's tally, and whether it judged the very queries of all arms, each once."""
    every = trials.agg(F.count_distinct(query).alias("every"))
    tally = {
        "correct_supported": F.col("supported") & F.col("correct"), "wrong_supported": F.col("supported") & ~F.col("correct"), "correct_unsupported": ~F.col("supported") & F.col("correct"), "rightly_abstained": F.col("negative") & F.col("abstained"),
    }
    found = trials.groupBy(arm).agg(F.count("*").alias("rows"), F.count_distinct(query).alias("queries"), *[F.count_if(c).alias(n) for n, c in tally.items()])
    return found.crossJoin(F.broadcast(every)).select(arm, "queries", *tally, ((F.col("rows") == F.col("queries")) & (F.col("queries") == F.col("every"))).alias("paired"))


def median_interval(samples: DataFrame, by: list[str], value: str, resamples: int, confidence: float = 0.95) -> DataFrame:
    """Bootstrap interval of each group's median. Draws are digests of (resample, place), so a run repeats exactly.

    Values in order have their median at the median of their places, so a resample needs its places alone: a task computes a resample's
    digests once for all groups and finds the middle places, which alone meet the values. It holds a few numbers for each row of
    the largest group. Nulls come last and count in no median."""
    place = Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_last())
    ranked = samples.select(*by, F.col(value).cast("double").alias("v")).withColumn("at", (F.row_number().over(place) - 1).cast("long"))
    sizes = samples.groupBy(*by).agg(F.count("*").alias("n"), F.count(value).alias("known")).select(F.struct(*by).alias("g"), "n", "known")
    tasks = sizes.select("g", "n", "known", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("draw")).repartition(resamples, "draw").sortWithinPartitions("draw", F.desc("n"))

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, held = None, np.empty(0, np.int64)
        for batch in batches:
            low, high = [], []
            for n, known, draw in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if draw != drawn:  # the first group of a resample is its largest
                    drawn, held = draw, np.fromiter((int.from_bytes(md5(b"%d:%d" % (draw, i)).digest()[:4], "big") for i in range(n)), np.int64, n)
                at = held[:n] % n
                at = at[at < known]
                if len(at):
                    middles = (len(at) - 1) // 2, len(at) // 2
                    at.partition(middles)
                low.append(int(at[middles[0]]) if len(at) else None)
                high.append(int(at[middles[1]]) if len(at) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["g", "draw", "low", "high"])

    kind = tasks.schema["g"].dataType.simpleString()
    middles = tasks.mapInArrow(middle, f"g {kind}, draw int, low long, high long").select("g.*", "draw", F.explode(F.array("low", "high")).alias("at"))
    medians = middles.join(ranked, [*by, "at"]).groupBy(*by, "draw").agg(F.avg("v").alias("m"))
    ordered = medians.groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("ms"))  # as many as there are resamples
    low, high = int((1 - confidence) / 2 * resamples), int((1 + confidence) / 2 * resamples) - 1
    return ordered.select(*by, F.round(F.get("ms", F.lit(low)), 6).alias("low"), F.round(F.get("ms", F.lit(high)), 6).alias("high"))
