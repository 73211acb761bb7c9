"""Epochs: signed evidence is staged in micro-batches and folded into immutable boundaries.

Each epoch writes what it alone folds to, one directory in the shared folder, so its cost is that of its batch; every COMPACT epochs the
boundary so far is written as a base, so a read folds one base and a few epochs. Folding takes greatest values, so it may be done
in any grouping; an epoch written twice after a failure overwrites itself, and every boundary is the fold of all epochs up to it exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COMPACT = 16
BOUNDARY = "scope string, canonical string, fact_id bigint, positive double, negative double, hard boolean"


def fold(boundary: DataFrame, staged: DataFrame, proof_width: int | None = None) -> DataFrame:
    """staged: scope, canonical, fact_id, amplitude, hard_negative. The boundary with each fact's greatest amplitude of either sign;
    with a proof width, only the strongest facts of each canonical stay."""
    new = staged.select("scope", "canonical", "fact_id", F.when(F.col("amplitude") > 0, F.col("amplitude")).otherwise(0.0).alias("positive"), F.when(F.col("amplitude") < 0, -F.col("amplitude")).otherwise(0.0).alias("negative"), F.col("hard_negative").alias("hard"))
    out = boundary.unionByName(new).groupBy("scope", "canonical", "fact_id").agg(F.max("positive").alias("positive"), F.max("negative").alias("negative"), F.max("hard").alias("hard"))
    if proof_width is None:
        return out
    from attestra.operators.ranking import top_k

    return top_k(out.withColumn("_size", F.greatest("positive", "negative")), proof_width, ["scope", "canonical"], "_size").drop("_size", "rank")


def settle(boundary: DataFrame, margin: float = 0.5) -> DataFrame:
    """(scope, canonical, amplitude, witnesses, state) of every canonical of a boundary."""
    sums = boundary.groupBy("scope", "canonical").agg((F.sum("positive") - F.sum("negative")).alias("amplitude"), F.count_if(F.col("positive") > 0).alias("witnesses"), F.max("hard").alias("hard"))
    state = F.when(F.col("hard"), "excluded").when(F.col("witnesses") < 2, "abstain").when(F.col("amplitude") < margin, "contested").otherwise("resolved")
    return sums.select("scope", "canonical", F.round("amplitude", 6).alias("amplitude"), "witnesses", state.alias("state"))


def silence(expected: DataFrame, staged: DataFrame) -> DataFrame:
    """Expected (scope, canonical) that an epoch heard nothing of."""
    return expected.join(staged.select("scope", "canonical").distinct(), ["scope", "canonical"], "left_anti")


def _epochs(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """What is written of one kind (epoch or base), with its number; none where the folder is not there yet."""
    files = spark.read.schema(BOUNDARY).option("ignoreMissingFiles", "true").option("basePath", root)
    try:
        return files.parquet(f"{root}/{kind}=*").withColumn("_at", F.regexp_extract(F.col("_metadata.file_path"), rf"/{kind}=([0-9]+)/", 1).cast("int"))
    except AnalysisException:
        return spark.createDataFrame([], f"{BOUNDARY}, _at int")


def boundary(spark: SparkSession, root: str, upto: int, proof_width: int | None = None) -> DataFrame:
    """The boundary after an epoch: the last base before it and the epochs since."""
    base = upto // COMPACT * COMPACT if upto >= COMPACT else 0
    columns = [c.split()[0] for c in BOUNDARY.split(", ")]
    since = _epochs(spark, root, "epoch").filter((F.col("_at") >= base) & (F.col("_at") <= upto)).select(*columns)
    before = _epochs(spark, root, "base").filter(F.col("_at") == base).select(*columns) if base else spark.createDataFrame([], BOUNDARY)
    both = before.unionByName(since)
    return fold(both, spark.createDataFrame([], "scope string, canonical string, fact_id bigint, amplitude double, hard_negative boolean"), proof_width)


def boundary_writer(spark: SparkSession, root: str, proof_width: int | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes what a micro-batch folds to, and a base (all epochs before this one) every COMPACT epochs."""

    def write(batch: DataFrame, epoch: int) -> None:
        if epoch and epoch % COMPACT == 0:
            boundary(spark, root, epoch - 1, proof_width).write.mode("overwrite").parquet(f"{root}/base={epoch}")
        fold(spark.createDataFrame([], BOUNDARY), batch, proof_width).write.mode("overwrite").parquet(f"{root}/epoch={epoch}")

    return write


def ordered_ingest(stream: DataFrame, key: str, clock: str, value: str) -> DataFrame:
    """(key, clock, value, state) of a stream: a row is accepted if its clock is later than all before of its key, else rejected."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([clock, value])
        said = []
        for at in rows[clock]:
            ok = last is None or at > last
            said.append("accepted" if ok else "rejected_out_of_order")
            last = at if ok else last
        state.update((int(last),))
        yield pd.DataFrame({key: rows[key].to_numpy(), clock: rows[clock].to_numpy(), value: rows[value].to_numpy(), "state": said})

    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, clock, value)}
    schema = f"{key} {kinds[key]}, {clock} {kinds[clock]}, {value} {kinds[value]}, state string"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)
