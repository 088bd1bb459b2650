"""Descriptive statistics and profiles (one aggregate for all columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.columns import melt, num, pick_numeric, quoted, temporal_columns, unfold
from gaugewell.plans.joins import null_safe_join
from gaugewell.plans.quantiles import group_quantiles, wide_quantiles

PERCENTILES = (0.25, 0.5, 0.75, 0.95, 0.99)


def percentile_name(p: float) -> str:
    return f"percentile_{round(p * 100)}"


def _with_median(percentiles: Sequence[float]) -> list[float]:
    return sorted({*percentiles, 0.5})


def describe(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    percentiles: Sequence[float] = PERCENTILES,
    exact: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per numeric column: count, moments, extremes and percentiles.

    Columns without a value are left out.  ``exact=False`` answers the
    percentiles from the sketch in the same single pass.
    """
    cols = pick_numeric(df, columns, [*exclude, *by])
    if by:
        return _describe_by(df, cols, list(by), percentiles)
    probs = _with_median(percentiles)
    aggs = []
    for i, c in enumerate(cols):
        x = num(c)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            F.var_samp(x).alias(f"var{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
            F.skewness(x).alias(f"skew{i}"),
            F.kurtosis(x).alias(f"kurt{i}"),
        ]
        if not exact:
            aggs.append(F.percentile_approx(x, list(probs), 10_000).alias(f"q{i}"))
    stats = df.agg(*aggs)
    if exact:
        # One small row; the quantile passes reuse its counts.
        row = stats.first()
        quant = wide_quantiles(df, cols, probs, counts=[row[f"n{i}"] for i in range(len(cols))])
        records = []
        for i, c in enumerate(cols):
            if not row[f"n{i}"]:
                continue
            q = dict(zip(probs, quant[i]))
            records.append(
                (c, row[f"n{i}"], *[row[f"{k}{i}"] for k in ("mean", "std", "min", "max")], q[0.5],
                 *[row[f"{k}{i}"] for k in ("var", "skew", "kurt")], *[q[p] for p in percentiles])
            )
        fields = ["column string", "count bigint"]
        fields += [f"{k} double" for k in ("mean", "std", "min", "max", "median", "variance", "skewness", "kurtosis")]
        fields += [f"{percentile_name(p)} double" for p in percentiles]
        return df.sparkSession.createDataFrame(records, ", ".join(fields))
    rows = []
    for i, c in enumerate(cols):
        at = {p: F.col(f"q{i}")[j] for j, p in enumerate(probs)}
        rows.append(_stat_struct(c, i, at, percentiles))
    return unfold(stats, rows).where(F.col("count") > 0)


def _stat_struct(c: str, i: int, at: dict[float, Column], percentiles: Sequence[float]) -> Column:
    return F.struct(
        F.lit(c).alias("column"),
        F.col(f"n{i}").alias("count"),
        F.col(f"mean{i}").alias("mean"),
        F.col(f"std{i}").alias("std"),
        F.col(f"min{i}").alias("min"),
        F.col(f"max{i}").alias("max"),
        at[0.5].alias("median"),
        F.col(f"var{i}").alias("variance"),
        F.col(f"skew{i}").alias("skewness"),
        F.col(f"kurt{i}").alias("kurtosis"),
        *[at[p].alias(percentile_name(p)) for p in percentiles],
    )


def _describe_by(df: DataFrame, cols: list[str], by: list[str], percentiles: Sequence[float]) -> DataFrame:
    probs = _with_median(percentiles)
    long = melt(df, cols, keep=by)
    keys = [*by, "column"]
    stats = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.var_samp("value").alias("variance"),
        F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
    )
    quant = group_quantiles(long, keys, "value", probs)
    joined = null_safe_join(stats, quant.drop("n"), keys)
    at = {p: F.col(f"q{j}") for j, p in enumerate(probs)}
    return joined.select(
        *keys, "count", "mean", "std", "min", "max", at[0.5].alias("median"), "variance", "skewness", "kurtosis",
        *[at[p].alias(percentile_name(p)) for p in percentiles],
    )


def spread(described: DataFrame) -> DataFrame:
    """Range, inter-quartile range and coefficient of variation of a describe table."""
    return described.select(
        "column",
        (F.col("max") - F.col("min")).alias("range"),
        (F.col("percentile_75") - F.col("percentile_25")).alias("iqr"),
        F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).alias("cv"),
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each column, as text; ties go to the smallest value.

    Counted by a shuffle on (column, value), so a column with many values never
    sits in one aggregation buffer.
    """
    out = None
    for c in columns:
        counted = (
            df.select(quoted(c).alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        )
        best = counted.agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v"))).alias("b"))
        part = best.select(
            F.lit(c).alias("column"),
            F.col("b.v").cast("string").alias("mode"),
            (-F.col("b.neg")).alias("frequency"),
        ).where(F.col("frequency").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def describe_summary(described: DataFrame) -> DataFrame:
    """Columns analysed, mean of the means, mean of the standard deviations."""
    return described.agg(
        F.count(F.lit(1)).alias("columns_analyzed"), F.avg("mean").alias("mean_of_means"), F.avg("std").alias("mean_of_stds")
    )


def corrected_shape(described: DataFrame) -> DataFrame:
    """Bias-corrected skewness (G1) and excess kurtosis (G2) from the population ones."""
    n = F.col("count").cast("double")
    g1 = F.when(F.col("count") > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("skewness"))
    g2 = F.when(F.col("count") > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("kurtosis") + 6))
    return described.select("column", g1.alias("skewness_corrected"), g2.alias("kurtosis_corrected"))


TIME_NAMES = ("datetime", "timestamp", "time", "date", "tagtime")


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, nulls, distinct count, three sample values, time flag and name hygiene per column."""
    names = df.columns
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = quoted(f.name)
        text = c.cast("string") if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(c)
        aggs.append(F.count(_present(f)).alias(f"n{i}"))
        aggs.append((F.lit(None).cast("bigint") if exact else F.approx_count_distinct(text, 0.01)).alias(f"d{i}"))
        aggs.append(F.min(text).alias(f"lo{i}"))
        aggs.append(F.max(text).alias(f"hi{i}"))
    stats = df.agg(*aggs)
    times = set(temporal_columns(df))
    rows = []
    for i, f in enumerate(df.schema.fields):
        low = f.name.lower()
        is_time = f.name in times or any(w in low for w in TIME_NAMES)
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                F.when(F.col("rows") > 0, (F.col("rows") - F.col(f"n{i}")) / F.col("rows") * 100).otherwise(0.0).alias("null_percentage"),
                F.col(f"d{i}").alias("distinct_count"),
                F.array_compact(F.array(F.col(f"lo{i}"), F.col(f"hi{i}"))).alias("sample_values"),
                F.lit(is_time).alias("is_time"),
                F.lit(bool(f.name) and f.name == f.name.strip() and names.count(f.name) == 1).alias("name_ok"),
            )
        )
    table = unfold(stats, rows)
    if not exact:
        return table
    counts = distinct_counts(df)
    return table.drop("distinct_count").join(counts, "column").select(*table.columns)


def _present(field: T.StructField) -> Column:
    c = quoted(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return num(field.name)
    return c


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct non-null values per column.

    The cells are spread as (column, value hash) pairs and de-duplicated by one
    shuffle; nothing column-sized lands in a single task.
    """
    cols = list(columns) if columns is not None else df.columns
    fields = {f.name: f for f in df.schema.fields}
    cells = []
    for c in cols:
        f = fields[c]
        v = F.to_json(quoted(c)) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else _present(f).cast("string")
        cells.append(F.struct(F.lit(c).alias("column"), v.alias("v")))
    pairs = df.select(F.inline(F.array(*cells))).groupBy("column", "v").agg(F.lit(1).alias("one"))
    return pairs.groupBy("column").agg(F.count("v").alias("distinct_count"))


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, columns by kind, missing cells and their share."""
    present = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(_present(f)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)])
    width = len(df.columns)
    filled = sum((F.col(f"n{i}") for i in range(width)), F.lit(0))
    missing = F.col("rows") * width - filled
    kinds = df.schema.fields
    return present.select(
        "rows",
        F.lit(width).cast("long").alias("columns"),
        F.lit(sum(isinstance(f.dataType, T.NumericType) for f in kinds)).cast("long").alias("numeric_columns"),
        F.lit(sum(isinstance(f.dataType, T.StringType) for f in kinds)).cast("long").alias("text_columns"),
        F.lit(len(temporal_columns(df))).cast("long").alias("time_columns"),
        missing.cast("long").alias("missing_cells"),
        F.when(F.col("rows") * width > 0, missing / (F.col("rows") * width) * 100).otherwise(0.0).alias("missing_percentage"),
    )


