"""Competing strategies: survival pressure, coalitions, regulation and counterfactual choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.graphs import materialize


def survival(attempts: DataFrame, agent: str, task: str) -> DataFrame:
    """attempts: agent, task, correct, verified, cost. Verified and unverified successes, false acceptances, the risk of an agent's mix in bits,
    and its share of the next round."""
    sums = attempts.groupBy(agent).agg(
        F.count_if(F.col("correct") & F.col("verified")).alias("sound"), F.count_if(F.col("correct") & ~F.col("verified")).alias("lucky"), F.count_if(~F.col("correct") & F.col("verified")).alias("false_accepts"), F.count_if(~F.col("correct") & ~F.col("verified")).alias("rejected"), F.sum("cost").alias("cost"), F.count_distinct(task).alias("tasks")
    )
    n = F.col("sound") + F.col("lucky") + F.col("false_accepts") + F.col("rejected")
    part = lambda c: F.when(F.col(c) > 0, -F.col(c) / n * F.log2(F.col(c) / n)).otherwise(0.0)
    risk = part("sound") + part("lucky") + part("false_accepts") + part("rejected")
    fit = (F.col("sound") + 0.25 * F.col("lucky") - 2.0 * F.col("false_accepts")) / n - 0.1 * risk
    scored = sums.withColumn("risk", risk).withColumn("fitness", fit)
    top = scored.agg(F.max("fitness").alias("top"))
    powered = scored.crossJoin(F.broadcast(top)).withColumn("w", F.exp(F.col("fitness") - F.col("top")))
    total = powered.agg(F.sum("w").alias("all"))
    return powered.crossJoin(F.broadcast(total)).select(agent, "sound", "lucky", "false_accepts", F.round("risk", 6).alias("risk"), F.round("fitness", 6).alias("fitness"), F.round(F.col("w") / F.col("all"), 6).alias("share"))


def coalitions(agents: DataFrame, ideal: str, champion: float, margin: float, cost_limit: float) -> DataFrame:
    """agents: id, ideal, strength, reliability, cost, abilities. Per ideal, the best pair of challengers, each below the champion, whose joint
    cost fits and whose abilities differ: sqrt of strengths, times one plus complementarity, times sqrt of reliabilities."""
    weak = agents.filter(F.col("strength") < champion)

    def scored(left: DataFrame, right: DataFrame, met: Column) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        both = a.join(b, (F.col(f"a.{ideal}") == F.col(f"b.{ideal}")) & met & (F.col("a.cost") + F.col("b.cost") <= cost_limit))
        union = F.size(F.array_union("a.abilities", "b.abilities"))
        differ = 1 - F.size(F.array_intersect("a.abilities", "b.abilities")) / F.greatest(union, F.lit(1))
        score = F.sqrt(F.col("a.strength") * F.col("b.strength")) * (1 + differ) * F.sqrt(F.col("a.reliability") * F.col("b.reliability"))
        return both.select(F.col(f"a.{ideal}").alias(ideal), F.col("a.id").alias("first"), F.col("b.id").alias("second"), F.round(score, 6).alias("score")).filter(F.col("score") >= champion + margin)

    # among agents alike in all but strength the strongest make the best partners: two of each kind, for one may be the agent itself
    alike = Window.partitionBy(ideal, "reliability", "cost", "abilities").orderBy(F.desc("strength"), "id")
    partners = weak.withColumn("_k", F.row_number().over(alike)).filter("_k <= 2").drop("_k")
    spread = weak.repartition(int(weak.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")  # a small file makes many candidates
    own = scored(spread, partners, F.col("a.id") != F.col("b.id")).groupBy(ideal, "first").agg(F.max("score").alias("own"))
    own = materialize(own, "own")
    best = own.groupBy(ideal).agg(F.max("own").alias("own"))
    # both agents of a best pair have its score as their best one, so ties are settled among few
    last = weak.join(own.join(best, [ideal, "own"]).select(ideal, F.col("first").alias("id")), [ideal, "id"], "left_semi")
    chosen = scored(last, last, F.col("a.id") < F.col("b.id")).groupBy(ideal).agg(F.min(F.struct((-F.col("score")).alias("s"), "first", "second")).alias("c"))
    return chosen.select(ideal, "c.first", "c.second", (-F.col("c.s")).alias("score"))


def regulate(rounds: DataFrame, by: list[str], clock: str) -> DataFrame:
    """rounds: by, clock, four pressures p1..p4, three skills s1..s3, contradiction, coverage, error. Challenge (root mean square) against
    skill (geometric mean): abstain on contradiction, recruit when coverage falls or error rises, else flow, anxiety or boredom."""
    challenge = F.sqrt(sum((F.col(f"p{i}") * F.col(f"p{i}") for i in range(1, 5)), F.lit(0.0)) / 4)
    skill = F.pow(F.col("s1") * F.col("s2") * F.col("s3"), F.lit(1.0 / 3))
    order = Window.partitionBy(*by).orderBy(clock)
    worse = (F.col("coverage") < F.lag("coverage").over(order)) | (F.col("error") > F.lag("error").over(order))
    rows = rounds.withColumn("challenge", F.round(challenge, 6)).withColumn("skill", F.round(skill, 6)).withColumn("worse", F.coalesce(worse, F.lit(False)))
    gap = F.col("challenge") - F.col("skill")
    regime = F.when(F.col("contradiction"), "abstain").when(F.col("worse"), "recruit").when(gap > 0.15, "anxiety").when(gap < -0.15, "boredom").otherwise("flow")
    return rows.select(*by, clock, "challenge", "skill", regime.alias("regime"))


def strategist(outcomes: DataFrame, by: list[str], option: str, world: str, value: str, weight: Column | float, cost: str) -> DataFrame:
    """outcomes: by, option, world, value, cost. The option with an outcome in every world that is best by weight * worst + (1 - weight) * mean - cost;
    ties go to the smaller option."""
    n = outcomes.groupBy(*by).agg(F.count_distinct(world).alias("_n"))
    per = outcomes.groupBy(*by, option).agg(F.min(value).alias("worst"), F.avg(value).alias("mean"), F.count_distinct(world).alias("worlds"), F.max(cost).alias("c"))
    full = per.join(n, by).filter(F.col("worlds") == F.col("_n"))
    scored = full.withColumn("score", F.round(weight * F.col("worst") + (1 - weight) * F.col("mean") - F.col("c"), 6))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), option)
    return scored.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select(*by, option, "worst", F.round("mean", 6).alias("mean"), "score")


def guarded(facts: DataFrame, worlds: DataFrame, by: list[str]) -> DataFrame:
    """facts: by, guard, value; worlds: world, holds (array of guards). What every world settles alike: a fact counts in a world that holds its guard."""
    active = facts.select(*by, "guard", "value").distinct().join(F.broadcast(worlds.select("world", F.explode("holds").alias("guard"))), "guard")
    per_world = active.groupBy(*by, "world").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    n = worlds.agg(F.count_distinct("world").alias("n"))
    found = per_world.groupBy(*by).agg(F.count("*").alias("w"), F.count("low").alias("told"), F.min("low").alias("low"), F.max("high").alias("high")).crossJoin(F.broadcast(n))
    alike = (F.col("w") == F.col("n")) & (F.col("told") == F.col("n")) & F.coalesce(F.col("low") == F.col("high"), F.lit(False))
    return found.select(*by, F.when(alike, "resolved").when(F.col("w") < F.col("n"), "abstain").otherwise("contested").alias("state"), F.when(alike, F.col("low")).alias("value"))
