"""The conversational recall cascade: one candidate list for each question out of several rankings, each stage bounded by its depth.

    words and pressure   reciprocal rank fusion of BM25 and of the order in which turns close the question's words
    context              fused with the cavity ranking: turns near strong turns of their session
    speakers             a reserve for turns of the speakers that the question names, in cavity order
    sessions             a reserve for the woven order of sessions
    neighbours           the turns around the first seeds, then the rest

Rankings are tables (query_id, fact_id, rank), those that several stages read written to the shared folder; lists of one question are arrays only where two of them are merged, and hold `depth` ids at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import ranking, retrieval, search
from attestra.operators.graphs import materialize


def _ranked(scored: DataFrame, depth: int, score: str = "score") -> DataFrame:
    return ranking.top_k(scored.withColumn(score, F.round(score, 9)), depth, ["query_id"], score).select("query_id", "fact_id", "rank", F.col(score).alias("score"))


def _listed(ranked: DataFrame, name: str) -> DataFrame:
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "fact_id"))), lambda x: x["fact_id"]).alias(name))


def _unlisted(lists: DataFrame, name: str) -> DataFrame:
    return lists.select("query_id", F.posexplode_outer(name).alias("rank", "fact_id")).filter("fact_id IS NOT NULL").withColumn("rank", F.col("rank") + 1)


def merged(primary: DataFrame, reserve_order: DataFrame, quota: int, reserve: int) -> DataFrame:
    """The protected merge of two rankings of each question."""
    both = _listed(primary, "p").join(_listed(reserve_order, "r"), "query_id", "full")
    empty = F.expr("cast(array() as array<bigint>)")
    lists = both.select("query_id", ranking.protected_merge(F.coalesce("p", empty), F.coalesce("r", empty), quota, reserve).alias("m"))
    return _unlisted(lists, "m").select("query_id", "fact_id", "rank")


def pressed(turns: DataFrame, queries: DataFrame, direct: DataFrame, depth: int) -> DataFrame:
    """Turns in the order in which they close the question's words, from the best by words and by trigrams."""
    docs = turns.select("fact_id", "text")
    far = retrieval.lexical_top(docs, queries, depth, T.trigrams)
    modes = direct.select("query_id", F.lit("direct").alias("mode"), (F.col("rank") - 1).alias("rank"), "fact_id").union(far.select("query_id", F.lit("sublexical"), F.col("rank") - 1, "fact_id"))
    held = docs.select("fact_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("cost"), F.array_distinct(T.tokens(F.col("text"))).alias("keys"))
    owed = queries.select("query_id", F.explode_outer(T.tokens(F.col("text"))).alias("key")).filter("key IS NOT NULL").groupBy("query_id", "key").agg((1.0 + F.least(F.lit(0.5), 0.15 * (F.count("*") - 1))).alias("weight"))
    return search.pressure(held.join(F.broadcast(modes), "fact_id"), owed, depth).select("query_id", "fact_id", F.col("position").alias("rank"))


def cascade(turns: DataFrame, queries: DataFrame, depth: int = 16, person: tuple[int, int] = (12, 3), session: tuple[int, int] = (14, 3), seeds: int = 4, radius: int = 1) -> DataFrame:
    """turns: fact_id, session_id, sequence, role (the speaker), text; queries: query_id, text. (query_id, fact_id, rank), at most `depth` a question.

    A question without a word of any turn has no list; null texts hold no word."""
    direct = materialize(retrieval.bm25(turns.select("fact_id", "text"), queries, depth).select("query_id", "fact_id", "rank", "score"), "direct")
    channel = lambda df, name: df.select("query_id", F.lit(name).alias("channel"), "fact_id", F.col("rank").cast("int").alias("rank"))
    fused = ranking.fuse(channel(direct, "words").union(channel(pressed(turns, queries, direct, depth), "pressure")), ["query_id"], ["words", "pressure"], 60, depth)
    cavity = materialize(_ranked(retrieval.cavity(direct, turns, 3, 0.75).withColumnRenamed("incoming", "score"), depth), "cavity")
    context = ranking.fuse(channel(fused, "fused").union(channel(cavity, "cavity")), ["query_id"], ["fused", "cavity"], 60, depth)
    named = cavity.join(turns.select("fact_id", "role"), "fact_id").join(queries.select("query_id", T.tokens(F.col("text")).alias("asked")), "query_id")
    speakers = search.speakers_first(named, F.coalesce(F.array_contains("asked", F.lower("role")), F.lit(False))).select("query_id", "fact_id", F.col("place").alias("rank"))
    people = materialize(merged(context, speakers, *person), "people")
    woven = retrieval.weave(turns, queries.join(direct.select("query_id").distinct(), "query_id", "left_semi"), depth, boundary=0.0)
    addressed = materialize(merged(people, woven, *session), "addressed")
    near = retrieval.neighbours(addressed.filter(F.col("rank") <= seeds), turns, radius).select("query_id", "fact_id", F.lit(0).alias("part"), F.col("rank").cast("int").alias("rank"))
    rest = addressed.join(near.select("query_id", "fact_id"), ["query_id", "fact_id"], "left_anti").select("query_id", "fact_id", F.lit(1).alias("part"), "rank")
    order = Window.partitionBy("query_id").orderBy("part", "rank", "fact_id")
    return near.union(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth).select("query_id", "fact_id", "rank")
