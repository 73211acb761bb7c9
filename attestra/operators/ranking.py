"""Ranked lists: fusion, protected merges, budgets and covers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEVER = 10**18


class Best:
    """The k best of each of n lists by (score down, key up), of rows that come in blocks; it holds n * k rows."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.floor = k, np.full(n, -np.inf)
        self.lists, self.keys, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def offer(self, keys: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each key, a column for each list; minus infinity is none."""
        if not scores.size:
            return
        most = scores.max(axis=0)
        at = np.flatnonzero((most >= self.floor) & (most > -np.inf))
        if not len(at):
            return
        mine, least = scores[:, at], self.floor[at]
        if len(mine) > self.k:
            least = np.maximum(least, np.partition(mine, len(mine) - self.k, axis=0)[len(mine) - self.k])
        row, column = np.nonzero((mine >= least) & (mine > -np.inf))
        lists, held, score = np.concatenate([self.lists, at[column]]), np.concatenate([self.keys, keys[row]]), np.concatenate([self.scores, mine[row, column]])
        order = np.lexsort((held, -score, lists))
        lists, held, score = lists[order], held[order], score[order]
        rank = np.arange(len(lists)) - np.searchsorted(lists, lists)
        last = rank == self.k - 1
        self.floor[lists[last]] = score[last]
        kept = rank < self.k
        self.lists, self.keys, self.scores = lists[kept], held[kept], score[kept]


def top_k(scored: DataFrame, k: int, by: list[str], score: str = "score", item: str = "fact_id") -> DataFrame:
    """The k best of each group by (score down, item up), with `rank`."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuse(rankings: DataFrame, by: list[str], channels: list[str], k: int = 60, limit: int | None = None) -> DataFrame:
    """rankings: by, channel, fact_id, rank. Reciprocal rank fusion; ties go to the least rank, then the ranks in channel order, then the id."""
    ranks = [F.coalesce(F.min(F.when(F.col("channel") == c, F.col("rank"))), F.lit(NEVER)).alias(f"_r{i}") for i, c in enumerate(channels)]
    summed = rankings.groupBy(*by, "fact_id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"), F.min("rank").cast("bigint").alias("_best"), *ranks)
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 12)), "_best", *[f"_r{i}" for i in range(len(channels))], "fact_id")
    out = summed.withColumn("rank", F.row_number().over(order)).select(*by, "fact_id", "score", "rank")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def protected_merge(primary: Column, reserve_order: Column, quota: int, reserve: int) -> Column:
    """Of two arrays: the primary's first quota - reserve, then the reserve's until the quota is full, then the rest of both."""
    if quota < 1 or not 0 <= reserve < quota:
        raise ValueError("the reserve must fit in the quota")
    width = quota - reserve
    head = F.slice(primary, 1, width)
    extra = F.array_except(reserve_order, head)
    filled = F.concat(head, F.slice(extra, 1, F.greatest(F.lit(quota) - F.size(head), F.lit(0))))
    return F.array_distinct(F.concat(filled, primary, reserve_order))


def stable_partition(matched: Column, rank: Column) -> list[Column]:
    """Sort keys that move matches to the front and keep the order otherwise."""
    return [F.desc(matched), F.asc(rank)]


def budget_fold(ranked: DataFrame, by: list[str], cost: str, budget: int, item: str = "fact_id", rank: str = "rank") -> DataFrame:
    """What fits, best first: an item that does not fit is skipped and later ones may still fit. One fold over a ranking, which a
    limit has bounded before."""
    ordered = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).cast("bigint").alias("r"), F.col(item).alias("i"), F.col(cost).cast("bigint").alias("c")))).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.expr("cast(array() as array<bigint>)").alias("kept"))
    fold = F.aggregate("xs", start, lambda acc, x: F.when(acc["used"] + x["c"] <= budget, F.struct((acc["used"] + x["c"]).alias("used"), F.concat(acc["kept"], F.array(x["i"].cast("bigint"))).alias("kept"))).otherwise(acc))
    return ordered.withColumn("f", fold).select(*by, F.col("f.kept").alias("fact_ids"), F.col("f.used").alias("used"))


def prefix_within(ranked: DataFrame, by: list[str], cost: str, budget: int, rank: str = "rank") -> DataFrame:
    """What fits up to the first that does not."""
    running = F.sum(cost).over(Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", running).filter(F.col("used") <= budget)


def interleave(ranked: DataFrame, by: list[str], mode: str, item: str = "fact_id", rank: str = "rank") -> DataFrame:
    """Round robin over modes in order of name, each item once, at its earliest turn."""
    slots = ranked.groupBy(*by, item).agg(F.min(F.struct(rank, mode)).alias("s"))
    order = Window.partitionBy(*by).orderBy(F.col(f"s.{rank}"), F.col(f"s.{mode}"), item)
    return slots.select(*by, item, F.row_number().over(order).alias("position"))


def max_cover(candidates: DataFrame, by: str, budget: int) -> DataFrame:
    """candidates: by, fact_id, tokens, cost. Greedy cover of each group: the most new tokens per cost first, ties by id, while it fits.

    Each group is a bounded candidate list of one query.
    """

    def cover(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left = {int(i): (frozenset(t), int(c)) for i, t, c in zip(pdf["fact_id"], pdf["tokens"], pdf["cost"], strict=True)}
        seen: set[str] = set()
        used, picked = 0, []
        while True:
            best = max(((len(t - seen) / max(c, 1), -i) for i, (t, c) in left.items() if used + c <= budget and t - seen), default=None)
            if best is None:
                return pd.DataFrame({by: [keys[0]] * len(picked), "fact_id": [p[0] for p in picked], "position": range(1, len(picked) + 1), "gain": [p[1] for p in picked]})
            chosen = -best[1]
            tokens, cost = left.pop(chosen)
            picked.append((chosen, len(tokens - seen)))
            seen |= tokens
            used += cost

    kind = candidates.schema[by].dataType.simpleString()
    return candidates.select(by, "fact_id", "tokens", "cost").groupBy(by).applyInPandas(cover, f"{by} {kind}, fact_id long, position int, gain int")


def union_best(lists: list[DataFrame], key: list[str], score: str = "score") -> DataFrame:
    """One row of each key: the best score, ties to the earlier list."""
    out = None
    for k, df in enumerate(lists):
        part = df.withColumn("_list", F.lit(k))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c not in (*key, "_list")]
    best = out.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col("_list"))).alias("b"))
    return best.select(*key, "b.*")


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = 8192, slice_: int = 2048, width: int = 1024) -> DataFrame:
    """(query_id, key, score): exact cosine of stated queries against all vectors. Queries come in blocks of about so many rows, one scan of
    the vectors for each, so what is sent to executors is bounded; a task scores slices of both and keeps the k best of each query. Scores are
    rounded to twelve digits, so that copies tie in whatever slice they are scored."""
    asked = queries.select("query_id", vector)
    n = max(1, -(-asked.count() // block))
    kind = vectors.schema[key].dataType.simpleString()

    def near(part: list) -> DataFrame:
        ids = [r["query_id"] for r in part]
        matrix = np.array([r[vector] for r in part], np.float64)
        if len(ids):
            matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)
        sent = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, against = sent.value
            best = [Best(len(against[low : low + width]), k) for low in range(0, len(names), width)]
            for batch in batches:
                for at in range(0, batch.num_rows if names else 0, slice_):
                    part = batch.slice(at, slice_)
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    rows = np.array(part.column(1).to_pylist(), np.float64)
                    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
                    for low, held in zip(range(0, len(names), width), best, strict=True):
                        held.offer(keys, np.round(rows @ against[low : low + width].T, 12))
            for low, held in zip(range(0, len(names), width), best, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[low + held.lists]), pa.array(held.keys), pa.array(held.scores)], names=["query_id", key, "score"])

        return vectors.select(key, vector).mapInArrow(score, f"query_id long, {key} long, score double").withColumn(key, F.col(key).cast(kind))

    out = None
    for b in range(n):
        part = near(sorted(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).collect(), key=lambda r: r["query_id"]))
        out = part if out is None else out.union(part)
    return top_k(out, k, ["query_id"], "score", key)
