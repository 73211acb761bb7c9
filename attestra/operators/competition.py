"""Scoring tables: reliability, fitness, entropy, trajectories, shells and allocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """Lower bound of a success rate; 0 without trials."""
    p = successes / trials
    bound = (p + z * z / (2 * trials) - z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))) / (1 + z * z / trials)
    return F.when(trials > 0, bound).otherwise(F.lit(0.0))


def tournament(outcomes: DataFrame, ability: str, agent: str, margin: float) -> DataFrame:
    """outcomes: ability, agent, correct, wrong, missed. The best agent of each ability by lower bound, if it leads by a margin."""
    rate = outcomes.groupBy(ability, agent).agg(F.sum("correct").alias("s"), F.sum(F.col("correct") + F.col("wrong") + F.col("missed")).alias("n"))
    scored = rate.withColumn("bound", wilson(F.col("s"), F.col("n")))
    found = scored.groupBy(ability).agg(F.max(F.struct("bound", agent)).alias("hi"), F.slice(F.sort_array(F.collect_list("bound"), asc=False), 1, 2).alias("two"))
    lead = F.when(F.size("two") > 1, F.get("two", F.lit(0)) - F.get("two", F.lit(1))).otherwise(F.get("two", F.lit(0)))
    return found.select(ability, F.when(lead >= margin, F.col(f"hi.{agent}")).alias("winner"), F.round("hi.bound", 6).alias("bound"), F.round(lead, 6).alias("lead"))


def entropy(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, entropy, values) of each field's values, in bits."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("c"))
    n = F.sum("c")
    return counts.groupBy("field").agg((F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("entropy"), F.count("*").alias("values"))


def entropy_choice(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The field whose value tells most; ties go to more values, then the earlier name."""
    return entropy(rows, fields).withColumn("e", F.round("entropy", 9)).orderBy(F.desc("e"), F.desc("values"), "field").limit(1).select("field", F.round("entropy", 6).alias("entropy"), "values")


def fitness(attempts: DataFrame, agent: str, task: str) -> DataFrame:
    """attempts: agent, task, correct, at. Solved tasks, tasks nobody else solved, tasks solved first, and a softmax share."""
    solved = attempts.filter("correct").groupBy(task, agent).agg(F.min("at").alias("at"))
    per_task = solved.groupBy(task).agg(F.count("*").alias("n"), F.min(F.struct("at", agent)).alias("first"))
    tally = solved.join(per_task, task).groupBy(agent).agg(F.count("*").alias("solved"), F.count_if(F.col("n") == 1).alias("alone"), F.count_if(F.col(f"first.{agent}") == F.col(agent)).alias("firsts"))
    score = F.col("solved") + 2 * F.col("alone") + F.col("firsts")
    scored = tally.withColumn("score", score)
    top = scored.agg(F.max("score").alias("top"))
    powered = scored.crossJoin(F.broadcast(top)).withColumn("w", F.exp((F.col("score") - F.col("top")) / 10.0))
    total = powered.agg(F.sum("w").alias("sum"))
    return powered.crossJoin(F.broadcast(total)).select(agent, "solved", "alone", "firsts", F.round(F.col("w") / F.col("sum"), 6).alias("share"))


def trajectory(points: DataFrame, by: list[str], clock: str, value: str) -> DataFrame:
    """Median step of clock and value, and the mean error of predicting each value by the median step."""
    order = Window.partitionBy(*by).orderBy(clock)
    steps = points.withColumn("dt", F.col(clock) - F.lag(clock).over(order)).withColumn("dv", F.col(value) - F.lag(value).over(order)).filter("dt is not null")
    middle = steps.groupBy(*by).agg(F.median("dt").alias("interval"), F.median("dv").alias("step"), F.count("*").alias("n"))
    errors = steps.join(middle, by).groupBy(*by).agg(F.avg(F.abs(F.col("dv") - F.col("step"))).alias("error"))
    return middle.join(errors, by).select(*by, "n", F.round("interval", 6).alias("interval"), F.round("step", 6).alias("step"), F.round("error", 6).alias("error"))


def shell_closure(ranked: DataFrame, by: list[str], score: str, cost: str, budget: float) -> DataFrame:
    """Whole groups of equal score, best first, while their running cost fits; a group is never split and the first that does not fit ends it."""
    shells = ranked.groupBy(*by, score).agg(F.sum(cost).alias("shell_cost"), F.count("*").alias("members"))
    running = F.sum("shell_cost").over(Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0))
    kept = shells.withColumn("running", running).filter(F.col("running") <= budget)
    return kept.groupBy(*by).agg(F.count("*").alias("shells"), F.sum("members").alias("members"), F.max("running").alias("cost"))


def quantize(x: Column, low: Column, high: Column, levels: int) -> Column:
    """Level 0 .. levels - 1 of x in its range, halves to even."""
    step = (high - low) / (levels - 1)
    return F.when(high > low, F.bround((x - low) / step, 0)).otherwise(F.lit(0.0)).cast("int")


def drive_winner(layers: DataFrame, by: list[str], agent: str, needed: int, least: float, margin: float) -> DataFrame:
    """layers: by, agent, layer, strength, contradiction. Geometric mean of the layers' best strengths; 0 with a contradiction or a layer
    missing; the winner needs a least drive and a relative margin over the next."""
    per_layer = layers.groupBy(*by, agent, "layer").agg(F.max("strength").alias("strength"), F.max("contradiction").alias("bad"))
    drive = per_layer.groupBy(*by, agent).agg(F.exp(F.avg(F.log("strength"))).alias("mean"), F.max("bad").alias("bad"), F.count("*").alias("n"), F.min("strength").alias("weakest"))
    drive = drive.withColumn("drive", F.when(F.col("bad") | (F.col("n") < needed) | (F.col("weakest") <= 0), F.lit(0.0)).otherwise(F.col("mean")))
    found = drive.groupBy(*by).agg(F.max(F.struct("drive", agent)).alias("hi"), F.slice(F.sort_array(F.collect_list("drive"), asc=False), 1, 2).alias("two"))
    next_ = F.coalesce(F.get("two", F.lit(1)), F.lit(0.0))
    wins = (F.col("hi.drive") >= least) & (F.col("hi.drive") - next_ >= margin * F.col("hi.drive"))
    return found.select(*by, F.when(wins, F.col(f"hi.{agent}")).alias("winner"), F.round("hi.drive", 6).alias("drive"))


def interference(waves: DataFrame, by: list[str], margin: float, least: int = 2) -> DataFrame:
    """waves: by, canonical, fact_id, amplitude, hard_negative. Each fact counts once for a canonical and sign, by its greatest amplitude; the
    canonical with the greatest sum resolves if two facts support it, nothing forbids it and it leads by a margin."""
    once = waves.groupBy(*by, "canonical", "fact_id", (F.col("amplitude") > 0).alias("up")).agg(F.max(F.abs("amplitude")).alias("a"), F.max("hard_negative").alias("hard"))
    sums = once.groupBy(*by, "canonical").agg(
        F.sum(F.when(F.col("up"), F.col("a")).otherwise(-F.col("a"))).alias("amplitude"), F.count_distinct(F.when(F.col("up"), F.col("fact_id"))).alias("witnesses"), F.max("hard").alias("hard")
    )
    open_ = sums.filter(~F.col("hard"))
    found = open_.groupBy(*by).agg(F.max(F.struct("amplitude", "canonical", "witnesses")).alias("hi"), F.slice(F.sort_array(F.collect_list("amplitude"), asc=False), 1, 2).alias("two"))
    lead = F.col("hi.amplitude") - F.coalesce(F.get("two", F.lit(1)), F.lit(0.0))
    state = F.when(F.col("hi.witnesses") < least, "abstain").when(lead < margin, "contested").otherwise("resolved")
    return found.select(*by, state.alias("state"), F.col("hi.canonical").alias("value"), F.round("hi.amplitude", 6).alias("amplitude"), F.col("hi.witnesses").alias("witnesses"))


def orbit_average(projections: DataFrame, by: list[str], path: str, value: str) -> DataFrame:
    """The mean over paths of each path's value of greatest size; what cancels is zero."""
    strongest = projections.groupBy(*by, path).agg(F.max_by(value, F.struct(F.abs(value), value)).alias("v"))
    mean = strongest.groupBy(*by).agg(F.avg("v").alias("m"), F.count("*").alias("paths"))
    return mean.select(*by, F.when(F.abs("m") < 1e-12, 0.0).otherwise(F.round("m", 6)).alias("mean"), "paths")
