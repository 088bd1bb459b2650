"""Average ranks and tie counts without a global window.

Rows are pre-aggregated to (value, count); only distinct values are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.columns import num, quoted
from gaugewell.plans.joins import null_safe_join
from gaugewell.plans.ordering import running


def rank_table(df: DataFrame, value: str, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """keys…, ``_x`` (distinct value), ``_ties`` (its count), ``avg_rank`` (1-based, ties averaged)."""
    counted = (
        df.select(*[quoted(k) for k in keys], num(value).alias("_x"))
        .where(F.col("_x").isNotNull())
        .groupBy(*keys, "_x")
        .agg(F.count(F.lit(1)).alias("_ties"))
    )
    upto = running(counted, ["_x"], list(keys), sums={"_upto": F.col("_ties")}, buckets=buckets)
    return upto.withColumn("avg_rank", F.col("_upto") - (F.col("_ties") - 1) / 2.0).drop("_upto")


def with_rank(df: DataFrame, value: str, out: str, keys: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Rows with the average rank of ``value``; rows with a null value get a null rank."""
    table = rank_table(df, value, keys, buckets).select(*keys, F.col("_x").alias("_rx"), F.col("avg_rank").alias(out))
    left = df.withColumn("_rx", num(value))
    return null_safe_join(left, table, [*keys, "_rx"], "left").drop("_rx")
