"""Per-column outlier detection; nothing is removed here, rows are flagged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.columns import count_if, num, pick_numeric, quoted, unfold
from gaugewell.plans.quantiles import wide_quantiles


def iqr_fences(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float, float, float]]:
    """column → (q1, q3, lower, upper); columns without values are left out."""
    found = wide_quantiles(df, list(columns), [0.25, 0.75])
    out = {}
    for c, (q1, q3) in zip(columns, found):
        if q1 is not None:
            out[c] = (q1, q3, q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def _outside(c: str, bounds) -> Column:
    return (num(c) < F.lit(bounds[2])) | (num(c) > F.lit(bounds[3]))


def iqr_table(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    cols = pick_numeric(df, columns)
    fences = iqr_fences(df, cols, k)
    cols = [c for c in cols if c in fences]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(num(c)).alias(f"n{i}"), count_if(_outside(c, fences[c])).alias(f"o{i}")]
    rows = []
    for i, c in enumerate(cols):
        q1, q3, lo, hi = fences[c]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("count"),
                F.col(f"o{i}").alias("outlier_count"),
                (F.col(f"o{i}") / F.col(f"n{i}") * 100).alias("outlier_percentage"),
                F.lit(q1).alias("q1"),
                F.lit(q3).alias("q3"),
                F.lit(q3 - q1).alias("iqr"),
                F.lit(lo).alias("lower_bound"),
                F.lit(hi).alias("upper_bound"),
            )
        )
    return unfold(df.agg(*aggs), rows)


def _z_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(num(c)).alias(f"m{i}"), F.stddev_pop(num(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols) if row[f"m{i}"] is not None}


def z_score(c: str, mean: float, std: float) -> Column:
    """Absolute z with the population deviation; a constant column never stands out."""
    if not std:
        return F.when(num(c).isNotNull(), F.lit(0.0))
    return F.abs((num(c) - F.lit(mean)) / F.lit(std))


def zscore_table(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    cols = pick_numeric(df, columns)
    stats = _z_stats(df, cols)
    cols = [c for c in cols if c in stats]
    aggs = []
    for i, c in enumerate(cols):
        z = z_score(c, *stats[c])
        aggs += [F.count(num(c)).alias(f"n{i}"), count_if(z > threshold).alias(f"o{i}"), F.max(z).alias(f"z{i}")]
    rows = []
    for i, c in enumerate(cols):
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("count"),
                F.col(f"o{i}").alias("outlier_count"),
                (F.col(f"o{i}") / F.col(f"n{i}") * 100).alias("outlier_percentage"),
                F.lit(stats[c][0]).alias("mean"),
                F.lit(stats[c][1]).alias("std"),
                F.col(f"z{i}").alias("max_z_score"),
            )
        )
    return unfold(df.agg(*aggs), rows)


def outlier_rows(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str] | None = None,
    method: str = "iqr",
    threshold: float = 3.0,
    k: float = 1.5,
) -> DataFrame:
    """One row per flagged cell: key…, column, value."""
    cols = pick_numeric(df, columns, key)
    if method == "iqr":
        fences = iqr_fences(df, cols, k)
        flags = {c: _outside(c, fences[c]) for c in cols if c in fences}
    elif method == "zscore":
        stats = _z_stats(df, cols)
        flags = {c: z_score(c, *stats[c]) > threshold for c in cols if c in stats}
    elif method == "isolation_forest":
        from gaugewell.operators.anomaly import isolation_forest

        out = None
        for c in cols:
            scored = isolation_forest(df.where(num(c).isNotNull()), key, [c], contamination=None)
            part = (
                scored.where(F.col("label") == -1)
                .join(df.select(*[quoted(k_) for k_ in key], num(c).alias("value")), list(key))
                .select(*[quoted(k_) for k_ in key], F.lit(c).alias("column"), "value")
            )
            out = part if out is None else out.unionByName(part)
        return out
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    cells = [
        F.when(flag, F.struct(F.lit(c).alias("column"), num(c).alias("value"))) for c, flag in flags.items()
    ]
    return df.select(*[quoted(k_) for k_ in key], F.inline(F.array_compact(F.array(*cells))))


def outlier_summary(table: DataFrame) -> DataFrame:
    """Totals over an ``iqr_table`` or ``zscore_table``."""
    return table.agg(
        F.sum("outlier_count").alias("total_outliers"),
        count_if(F.col("outlier_count") > 0).alias("columns_affected"),
        F.avg("outlier_percentage").alias("mean_outlier_percentage"),
    )
