"""Graph operators that cut lineage through tables in the shared folder: components, orders, reachability."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one that goes with the process, but
    only for a local master: on a cluster each executor would write to its own disk, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if master not in _OWN:
        made = tempfile.mkdtemp(prefix="attestra-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _OWN[master] = f"file://{made}"
    return _OWN[master]


_OWN: dict[str, str] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/attestra-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge table (a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps (every node hooks its larger, then its smaller neighbours to the least
    one it sees) until the edge set is a forest of stars. Each step is an aggregation with map-side minima and one
    equi-join that adaptive execution can split, so a component of any size never meets in one task; each round is
    written to the shared folder. Self loops and null ends are ignored; an empty input gives an empty result. An edge set that has not settled
    after `max_rounds` (the rounds needed grow with the logarithm of the nodes) is an error, not a result.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        """e: every link of a node (a) to another (b)."""
        least = e.groupBy("a").agg(F.min("b").alias("low"))
        least = least.select("a", F.least("a", "low").alias("m"))
        kept = e.filter(F.col("b") > F.col("a")) if large else e
        out = kept.join(least, "a")
        if large:
            return out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s")).select("s.*")

    def clean(e: DataFrame) -> DataFrame:
        return e.filter(F.col("a") != F.col("b")).distinct()

    def down(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    links, before = materialize(clean(down(edges)), "links"), None
    for k in range(max_rounds):
        # the small step reads the large one's rows twice: they are written, and are few by then
        wide = materialize(down(clean(star(both(links), large=True))), f"large{k}")
        links = materialize(clean(star(wide, large=False)), f"round{k}")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def layers(nodes: DataFrame, arrows: DataFrame, depth: int) -> DataFrame:
    """nodes: node; arrows: src, dst. (node, layer): the length of the longest walk that ends in a node; null where a cycle
    of at most `depth` steps or a longer walk leaves no order."""
    now = nodes.select("node", F.lit(0).alias("layer"))
    for _ in range(depth):
        step = now.join(arrows, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.max("layer") + 1).alias("up"))
        now = materialize(now.join(step, "node", "left").select("node", F.greatest("layer", F.coalesce("up", F.lit(0))).alias("layer")), "layers")
    late = now.join(arrows, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.max("layer") + 1).alias("up"))
    return now.join(late, "node", "left").select("node", F.when(F.coalesce("up", F.lit(0)) <= F.col("layer"), F.col("layer")).alias("layer"))


def reachability(nodes: DataFrame, reached: DataFrame, deferred: DataFrame) -> DataFrame:
    """Every node as reachable, deferred or unreachable."""
    a = reached.select("node").distinct().withColumn("_r", F.lit(True))
    b = deferred.select("node").distinct().withColumn("_d", F.lit(True))
    joined = nodes.select("node").join(a, "node", "left").join(b, "node", "left")
    return joined.select("node", F.when(F.col("_r"), "reachable").when(F.col("_d"), "deferred").otherwise("unreachable").alias("part"))


def consensus(votes: DataFrame, item: str, seed: str, seeds: int) -> DataFrame:
    """Items that every seed names."""
    return votes.groupBy(item).agg(F.count_distinct(seed).alias("seeds")).filter(F.col("seeds") == seeds)
