"""Conjunctive queries with why-provenance, possible worlds of finite constraints, and bounded graph walks.

A goal is a predicate with arguments; `?x` is a variable. Goals become equi-joins on shared variables, so Catalyst orders and
distributes them; goals without a shared variable would be a cross product and are refused unless one side is a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.graphs import materialize

Goal = tuple[str, tuple[str, ...]]


def is_variable(term: str) -> bool:
    return term.startswith("?")


def goal_rows(facts: DataFrame, goal: Goal, k: int) -> DataFrame:
    """facts: predicate, a0, a1, ..., fact_id. The goal's rows with a column for each variable and its fact in `_f<k>`."""
    predicate, terms = goal
    rows = facts.filter(F.col("predicate") == predicate)
    seen: dict[str, str] = {}
    for i, term in enumerate(terms):
        if not is_variable(term):
            rows = rows.filter(F.col(f"a{i}") == term)
        elif term in seen:
            rows = rows.filter(F.col(f"a{i}") == F.col(seen[term]))
        else:
            seen[term] = f"a{i}"
    return rows.select(*[F.col(c).alias(v[1:]) for v, c in seen.items()], F.col("fact_id").alias(f"_f{k}"))


def order_goals(goals: Sequence[Goal]) -> list[int]:
    """Constants first, then always a goal that shares a variable with what is joined already."""
    left = sorted(range(len(goals)), key=lambda k: (sum(is_variable(t) for t in goals[k][1]), k))
    out, bound = [left.pop(0)], set()
    while left:
        bound |= {t for t in goals[out[-1]][1] if is_variable(t)}
        linked = [k for k in left if bound & set(goals[k][1])]
        if not linked:
            raise ValueError("goals without a shared variable would be a cross product")
        best = min(linked, key=lambda k: (-sum(t in bound or not is_variable(t) for t in goals[k][1]), k))
        left.remove(best)
        out.append(best)
    return out


def environments(facts: DataFrame, goals: Sequence[Goal]) -> DataFrame:
    """Every complete assignment, with the facts that support it as a sorted set."""
    joined: DataFrame | None = None
    for k in order_goals(goals):
        rows = goal_rows(facts, goals[k], k)
        if joined is None:
            joined = rows
        else:
            joined = joined.join(rows, [c for c in rows.columns if c in joined.columns])
    ids = [c for c in joined.columns if c.startswith("_f")]
    return joined.select(*[c for c in joined.columns if c not in ids], F.array_sort(F.array_distinct(F.array(*ids))).alias("monomial"))


def query(facts: DataFrame, goals: Sequence[Goal], outputs: Sequence[str], nogoods: DataFrame | None = None) -> DataFrame:
    """(outputs, monomials, support): each output with its why-provenance; derivations that use a whole nogood are dropped."""
    found = environments(facts, goals)
    if nogoods is not None:
        hit = F.size(F.array_except("nogood", "monomial")) == 0
        found = found.join(nogoods, hit, "left_anti")
    grouped = found.groupBy(*outputs).agg(F.array_sort(F.collect_set("monomial")).alias("monomials"))
    return grouped.withColumn("support", F.size("monomials"))


def answer(found: DataFrame, keys: Sequence[str], output: str) -> DataFrame:
    """Per key: resolved when all complete environments agree on the output, contested otherwise."""
    grouped = found.groupBy(*keys).agg(F.count_distinct(output).alias("answers"), F.min(output).alias("one"))
    one = F.col("answers") == 1
    return grouped.select(*keys, F.when(one, "resolved").otherwise("contested").alias("state"), F.when(one, F.col("one")).alias("value"), "answers", F.when(one, "all_complete_environments_agree").otherwise("complete_authorized_environments_disagree").alias("reason"))


def worlds(constraints: Sequence[DataFrame]) -> DataFrame:
    """The natural join of constraint relations: each row is a world."""
    out, left = constraints[0], list(constraints[1:])
    while left:
        linked = next((c for c in left if set(c.columns) & set(out.columns)), None)
        if linked is None:
            raise ValueError("constraints without a shared variable")
        left.remove(linked)
        out = out.join(linked, sorted(set(out.columns) & set(linked.columns)))
    return out.distinct()


def arc_consistent(constraints: Sequence[DataFrame], rounds: int) -> list[DataFrame]:
    """Each relation less the rows that no neighbour supports, for so many rounds of semi-joins."""
    now = list(constraints)
    for _ in range(rounds):
        for i, c in enumerate(now):
            for j, other in enumerate(constraints):
                shared = sorted(set(c.columns) & set(other.columns))
                if i != j and shared:
                    now[i] = now[i].join(now[j].select(*shared).distinct(), shared, "left_semi")
    return now


def certain(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values that a world set settles: (keys, values, state)."""
    return found.groupBy(*keys).agg(F.count("*").alias("worlds"), F.when(F.count("*") == 1, "resolved").otherwise("contested").alias("state"))


def mediators(edges: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """edges: src, dst, fact_id, both ways. Two-hop paths left - mediator - right by two different facts, left < right,
    that no exclusion forbids. Facts are counted for each end and mediator before ends are paired, so a hub costs the pairs of its neighbours,
    not those of its facts; a path whose two facts are one is taken off again."""
    out = edges.groupBy(F.col("src").alias("left"), F.col("dst").alias("mediator")).agg(F.count("fact_id").alias("nl"))
    back = edges.groupBy(F.col("src").alias("mediator"), F.col("dst").alias("right")).agg(F.count("fact_id").alias("nr"))
    pairs = out.join(back, "mediator").filter(F.col("left") < F.col("right"))
    a = edges.select(F.col("src").alias("left"), F.col("dst").alias("mediator"), "fact_id")
    b = edges.select(F.col("src").alias("mediator"), F.col("dst").alias("right"), "fact_id")
    same = a.join(b, ["mediator", "fact_id"]).filter(F.col("left") < F.col("right")).groupBy("left", "right", "mediator").agg(F.count("*").alias("same"))
    paths = pairs.join(same, ["left", "right", "mediator"], "left").withColumn("paths", F.col("nl") * F.col("nr") - F.coalesce("same", F.lit(0)))
    found = paths.filter("paths > 0").groupBy("left", "right").agg(F.count("*").alias("mediators"), F.sum("paths").alias("paths"))
    return found if forbidden is None else found.join(forbidden, ["left", "right"], "left_anti")


def alias_closure(start: DataFrame, aliases: DataFrame, hops: int = 3) -> DataFrame:
    """start: query, form; aliases: left, right. Forms reachable in at most so many hops, with the least hop."""
    both = aliases.select(F.col("left").alias("form"), F.col("right").alias("next")).union(aliases.select(F.col("right").alias("form"), F.col("left").alias("next"))).distinct()
    found = start.select("query", "form").distinct().withColumn("hop", F.lit(0))
    front = found
    for h in range(1, hops + 1):
        front = front.join(both, "form").select("query", F.col("next").alias("form")).distinct().join(found.select("query", "form"), ["query", "form"], "left_anti").withColumn("hop", F.lit(h))
        found = found.union(front)
    return found


def alias_counts(start: DataFrame, aliases: DataFrame, hops: int = 3) -> DataFrame:
    """(query, hop, forms): how many forms alias_closure finds at each hop, without a row for each. A null is no form.

    A form with one neighbour only is a leaf of it, and the leaves of a form are all reached one hop after it. So walks visit forms that are no leaves,
    and leaves are counted, less those that the query starts from: forms with many leaves cost a row, not a row for each pair of leaves."""
    both = aliases.select(F.col("left").alias("form"), F.col("right").alias("next")).union(aliases.select(F.col("right").alias("form"), F.col("left").alias("next"))).filter("form != next").distinct()
    ends = both.groupBy("form").agg(F.count("*").alias("n"), F.min("next").alias("next")).filter("n = 1").select("form", "next")
    back = ends.select(F.col("form").alias("next"), F.col("next").alias("back"))
    # of two forms that have only each other, the lesser is no leaf
    leaves = materialize(ends.join(back, "next", "left").filter(~(F.col("back").eqNullSafe(F.col("form")) & (F.col("form") < F.col("next")))).select("form", "next"), "leaves")
    held = leaves.groupBy(F.col("next").alias("form")).agg(F.count("*").alias("leaves"))
    inner = both.join(leaves.select("form"), "form", "left_anti").join(leaves.select(F.col("form").alias("next")), "next", "left_anti").select("form", "next")
    inner = materialize(inner, "inner")
    placed = materialize(start.select("query", "form").distinct().join(leaves, "form", "left"), "placed")
    front = placed.filter("next IS NULL").select("query", "form")
    found = front.withColumn("hop", F.lit(0))
    own = placed.filter("next IS NOT NULL").groupBy("query", F.col("next").alias("form")).agg(F.count("*").alias("own"))
    for h in range(1, hops + 1):
        step = front.join(inner, "form").select("query", F.col("next").alias("form"))
        if h == 1:
            step = step.union(own.select("query", "form"))
        front = materialize(step.distinct().join(found.select("query", "form"), ["query", "form"], "left_anti"), f"hop{h}")
        found = found.union(front.withColumn("hop", F.lit(h)))
    beyond = found.filter(F.col("hop") < hops).join(held, "form").join(own, ["query", "form"], "left").select("query", (F.col("hop") + 1).alias("hop"), (F.col("leaves") - F.coalesce("own", F.lit(0))).alias("forms"))
    each = beyond.union(found.select("query", "hop", F.lit(1).cast("bigint"))).union(placed.filter("next IS NOT NULL").select("query", F.lit(0), F.lit(1).cast("bigint")))
    return each.groupBy("query", "hop").agg(F.sum("forms").alias("forms")).filter("forms > 0")


def transport(start: DataFrame, arrows: DataFrame, depth: int = 8) -> DataFrame:
    """start: query, node; arrows: src, dst. Terminal nodes of directed walks: resolved with one, conflict with more,
    cycle if a walk returns, depth if one does not end."""
    front = start.select("query", "node", F.array("node").alias("path"))
    ends = []
    for _ in range(depth):
        step = front.join(arrows, front["node"] == arrows["src"], "left")
        ends.append(step.filter("src is null").select("query", "node", F.lit("terminal").alias("kind")))
        moved = step.filter("src is not null")
        back = F.array_contains("path", F.col("dst"))
        ends.append(moved.filter(back).select("query", F.col("dst").alias("node"), F.lit("cycle").alias("kind")))
        front = moved.filter(~back).select("query", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
    ends.append(front.join(arrows, front["node"] == arrows["src"], "left_semi").select("query", "node", F.lit("depth").alias("kind")))
    ends.append(front.join(arrows, front["node"] == arrows["src"], "left_anti").select("query", "node", F.lit("terminal").alias("kind")))
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    found = out.groupBy("query").agg(F.count_distinct(F.when(F.col("kind") == "terminal", F.col("node"))).alias("terminals"), F.min(F.when(F.col("kind") == "terminal", F.col("node"))).alias("node"), F.max(F.col("kind") == "cycle").alias("cycle"), F.max(F.col("kind") == "depth").alias("deep"))
    state = F.when(F.col("cycle"), "cycle").when(F.col("deep"), "depth_exceeded").when(F.col("terminals") == 1, "resolved").otherwise("conflict")
    return found.select("query", state.alias("state"), F.when(state == "resolved", F.col("node")).alias("value"))


def supersede(facts: DataFrame, retractions: DataFrame) -> DataFrame:
    """Facts that nothing replaces: an anti-join on the replaced ids."""
    return facts.join(retractions.select(F.col("replaces").alias("fact_id")).distinct(), "fact_id", "left_anti")


def hard_excluded(candidates: DataFrame, forbidden: DataFrame, on: Sequence[str]) -> DataFrame:
    return candidates.join(forbidden.select(*on).distinct(), list(on), "left_anti")


def intents_within(candidates: DataFrame, required: DataFrame) -> DataFrame:
    """candidates: doc, term; required: term. Documents that hold every required term."""
    n = required.select("term").distinct().agg(F.count("*").alias("n"))
    have = candidates.select("doc", "term").distinct().join(required.select("term").distinct(), "term", "left_semi").groupBy("doc").agg(F.count("*").alias("have"))
    return have.join(F.broadcast(n), F.col("have") == F.col("n")).select("doc")


def best_unique(pairs: DataFrame, by: Sequence[str], score: str, payload: str, floor: Column | float, margin: float) -> DataFrame:
    """The payload of the best score of each group, if it reaches a floor and leads the next by a margin."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), payload)
    ranked = pairs.withColumn("_k", F.row_number().over(order)).withColumn("_next", F.lead(score).over(order)).filter("_k = 1")
    wins = (F.col(score) >= floor) & (F.col(score) - F.coalesce(F.col("_next"), F.lit(0.0)) >= margin)
    return ranked.select(*by, F.when(wins, "resolved").otherwise("abstain").alias("state"), F.when(wins, F.col(payload)).alias("value"), score)
