"""What every evidence operator returns: state, value, unit, reason and the ids of the rows that prove it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def no_ids() -> Column:
    return F.expr("cast(array() as array<bigint>)")


def ladder(df: DataFrame, keys: list[str], cases: list[tuple[Column, str, str]], value: Column, unit: Column, ids: Column, reason: str) -> DataFrame:
    """(keys, state, value, unit, reason, fact_ids): the first case (condition, state, reason) that holds, else resolved."""
    state = F.lit("resolved")
    why = F.lit(reason)
    for condition, name, text in reversed(cases):
        held = F.coalesce(condition, F.lit(False))
        state = F.when(held, F.lit(name)).otherwise(state)
        why = F.when(held, F.lit(text)).otherwise(why)
    out = df.withColumn("_state", state).withColumn("_why", why)
    open_ = F.col("_state") == "resolved"
    return out.select(
        *keys,
        F.col("_state").alias("state"),
        F.when(open_, value.cast("string")).alias("value"),
        F.when(open_, unit).otherwise("").alias("unit"),
        F.col("_why").alias("reason"),
        F.when(open_, ids).otherwise(no_ids()).alias("fact_ids"),
    )


def plain(number: Column) -> Column:
    """A decimal without trailing zeros, and without a point where nothing follows it."""
    text = number.cast("string")
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def shown(df: DataFrame) -> DataFrame:
    """Arrays as comma-joined text, for results that are compared by value."""
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])
