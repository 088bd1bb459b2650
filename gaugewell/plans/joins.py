"""Joins of many rows with a table of one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.session import cut_lineage, shuffle_partitions

BROADCAST_GROUPS = 100_000
#: A key is hot above this share of the rows, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 0.001


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches null keys; right key columns are dropped.

    A key that is null on neither side is compared plainly, so that rows dealt
    out by the keys before are not dealt out again.
    """
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        plain = not (left.schema[c].nullable or right.schema[c].nullable)
        term = left[c] == renamed[f"_r_{c}"] if plain else left[c].eqNullSafe(renamed[f"_r_{c}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def join_groups(rows: DataFrame, table: DataFrame, keys: Sequence[str], broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Inner join on few keys, null ones included, whatever share of the rows a key holds.

    The group table is stored and counted: up to ``broadcast_groups`` rows are
    broadcast and the rows stay where they are.  A larger table is shuffled;
    its hot keys (counted, at most a thousand) are repeated for each salt.
    """
    held = cut_lineage(table)
    if held.count() <= broadcast_groups:
        return null_safe_join(rows, F.broadcast(held), keys)
    counts = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("_n") > F.lit(total * HOT_SHARE)).select(*keys, F.lit(True).alias("_hot")))
    salts = shuffle_partitions(rows)
    place = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    left = null_safe_join(rows, hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), place).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = null_safe_join(held, hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return null_safe_join(left, right, [*keys, "_salt"]).drop("_salt")
