"""Indexed series and numpy work on bounded, overlapping blocks of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.columns import num, quoted
from gaugewell.functions.parsing import parse_timestamp
from gaugewell.plans.joins import join_groups
from gaugewell.plans.ordering import halo_blocks, with_position
from gaugewell.session import cut_lineage

MIN_POINTS = 10


def to_series(
    df: DataFrame, time: str, columns: Sequence[str], keys: Sequence[str] = (), tie: Sequence[str] = (), min_points: int = MIN_POINTS
) -> DataFrame:
    """(keys…, series, t, value, idx, n, mean): time-ordered positions of every non-null value.

    Kept on shared storage, since the tests and fits below read it repeatedly.
    """
    t = quoted(time)
    if isinstance(df.schema[time].dataType, T.StringType):
        t = parse_timestamp(time)
    cells = F.array(*[F.struct(F.lit(c).alias("series"), num(c).alias("value")) for c in columns])
    long = (
        df.select(*[quoted(k) for k in keys], t.alias("t"), *[quoted(c).alias(f"_tie{i}") for i, c in enumerate(tie)], F.inline(cells))
        .where(F.col("value").isNotNull() & F.col("t").isNotNull())
    )
    by = [*keys, "series"]
    placed = with_position(long, ["t", *[f"_tie{i}" for i in range(len(tie))]], by)
    stats = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).where(F.col("n") >= min_points)
    return cut_lineage(join_groups(placed, stats, by).select(*by, "t", "value", "idx", "n", "mean"))


def series_keys(series: DataFrame) -> list[str]:
    names = series.columns
    return names[: names.index("series") + 1]


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def block_apply(
    series: DataFrame, before: int, after: int, fn: Callable[[pd.DataFrame, int, int], pd.DataFrame | None], schema: str, size: int | None = None
) -> DataFrame:
    """``fn(rows, first, last)`` on each block: rows in order, core rows at positions first…last-1.

    ``schema`` describes fn's columns; the series keys are put in front.
    """
    keys = series_keys(series)
    spread = halo_blocks(series, "idx", before, after, size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["_core"].any():
            return pd.DataFrame()
        rows = pdf.sort_values("idx", ignore_index=True)
        core = np.flatnonzero(rows["_core"].to_numpy())
        out = fn(rows, int(core[0]), int(core[-1]) + 1)
        if out is None or not len(out):
            return pd.DataFrame()
        for i, k in enumerate(keys):
            out.insert(i, k, rows[k].iloc[0])
        return out

    return spread.groupBy(*keys, "_block").applyInPandas(run, key_schema(series, keys) + ", " + schema)


def block_sums(series: DataFrame, before: int, after: int, fn: Callable[[pd.DataFrame, int, int], np.ndarray], size: int | None = None) -> DataFrame:
    """(keys…, series, v): element-wise sum over blocks of the vectors ``fn`` returns."""
    keys = series_keys(series)

    def one(rows: pd.DataFrame, first: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({"v": [np.asarray(fn(rows, first, last), dtype=float).tolist()]})

    parts = block_apply(series, before, after, one, "v array<double>", size)
    flat = parts.select(*keys, F.posexplode("v").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return flat.groupBy(*keys).agg(ordered.alias("v")).withColumn("v", F.col("v.x"))


def series_info(series: DataFrame) -> DataFrame:
    keys = series_keys(series)
    return series.groupBy(*keys).agg(F.first("n").alias("n"), F.first("mean").alias("mean"))


def longest(series: DataFrame) -> int:
    return int(series.agg(F.max("n")).first()[0] or 0)


def per_series(table: DataFrame, fn: Callable[[pd.Series], dict | list[dict]], schema: str, keys: Sequence[str]) -> DataFrame:
    """``fn`` on every one-row-per-series record; keys are carried along."""

    def run(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                got = fn(row)
                for g in got if isinstance(got, list) else [got]:
                    out.append({**{k: row[k] for k in keys}, **g})
            if out:
                yield pd.DataFrame(out)

    return table.mapInPandas(run, key_schema(table, keys) + ", " + schema)
