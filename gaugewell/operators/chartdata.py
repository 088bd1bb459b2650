"""The aggregates behind the plots; drawing is left to the caller."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.columns import count_if, num, pick_numeric, quoted, unfold
from gaugewell.operators.correlate import pearson
from gaugewell.operators.outliers import iqr_fences
from gaugewell.plans.ordering import with_position

BINS = 30
POINT_LIMIT = 10_000
FINE_PER_WIDTH = 32  # bins of a kernel width


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """Equal-width bins from min to max, the last one closed, empty bins included."""
    cols = pick_numeric(df, columns)
    ends = df.agg(*[e for i, c in enumerate(cols) for e in (F.min(num(c)).alias(f"a{i}"), F.max(num(c)).alias(f"b{i}"))]).first()
    span = {}
    for i, c in enumerate(cols):
        lo, hi = ends[f"a{i}"], ends[f"b{i}"]
        if lo is not None:
            span[c] = (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5)
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), _bin(num(c), *span[c], bins).alias("bin")) for c in span]
    )
    counted = df.select(F.inline(cells)).where(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    edges = df.sparkSession.createDataFrame([(c, float(lo), float((hi - lo) / bins)) for c, (lo, hi) in span.items()], "column string, lo double, width double")
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("right_edge"), F.coalesce("count", F.lit(0)).alias("count"),
    )


def _bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    width = (hi - lo) / bins or 1.0
    return F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int"))


def box(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (most extreme points within the fences) and flier counts."""
    from gaugewell.plans.quantiles import wide_quantiles

    cols = pick_numeric(df, columns)
    medians = dict(zip(cols, (q[0] for q in wide_quantiles(df, cols, [0.5]))))
    fences = iqr_fences(df, cols, k)
    aggs, rows = [], []
    for i, (c, (q1, q3, lo, hi)) in enumerate(fences.items()):
        x = num(c)
        inside = F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), x)
        aggs += [F.min(inside).alias(f"a{i}"), F.max(inside).alias(f"b{i}"), count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"f{i}")]
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(medians[c]).alias("median"), F.lit(q3).alias("q3"),
                F.col(f"a{i}").alias("whisker_low"), F.col(f"b{i}").alias("whisker_high"), F.col(f"f{i}").alias("fliers"),
            )
        )
    return unfold(df.agg(*aggs), rows)


def heatmap(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation cells with two-decimal labels."""
    return pearson(df, columns).select("column_a", "column_b", "correlation", F.format_string("%.2f", F.col("correlation")).alias("label"))


def thinned(df: DataFrame, order: Sequence[str], limit: int = POINT_LIMIT) -> DataFrame:
    """At most ``limit`` rows at evenly spaced positions, first and last included.

    Position p is kept when it equals ⌊i·(n−1)/(limit−1)⌋ for some i, which holds
    if a multiple of n−1 lies in [p·(limit−1), (p+1)·(limit−1)): integer
    arithmetic on the row itself.
    """
    n = df.count()
    placed = with_position(df, order)
    if n <= limit:
        return placed
    if limit < 2:
        raise ValueError("thinning keeps the first and the last row")
    kind = "bigint" if (n - 1) * (limit - 1) < 2**63 else "decimal(38,0)"
    p, span, steps = F.col("idx").cast(kind), F.lit(n - 1).cast(kind), F.lit(limit - 1).cast(kind)
    return placed.where(F.pmod(-(p * steps), span) < steps)


def bars(df: DataFrame, category: str, value: str, how: str = "sum") -> DataFrame:
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}[how]
    return df.groupBy(quoted(category).alias("category")).agg(agg(num(value)).alias("value"))


def comparison(df: DataFrame, category: str, group: str, value: str, groups: Sequence[str], how: str = "sum") -> DataFrame:
    """One row per category, one value column per group."""
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}[how]
    return df.groupBy(quoted(category).alias("category")).pivot(group, list(groups)).agg(agg(num(value)))


def time_line(df: DataFrame, time: str, value: str, unit: str = "day", how: str = "mean") -> DataFrame:
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}[how]
    return df.groupBy(F.date_trunc(unit, quoted(time)).alias("at")).agg(agg(num(value)).alias("value"))


def span_selection(df: DataFrame, bounds: Mapping[str, tuple]) -> DataFrame:
    """Rows inside an x-span, or inside a box for two columns."""
    out = df
    for c, (lo, hi) in bounds.items():
        out = out.where(quoted(c).between(F.lit(lo), F.lit(hi)))
    return out


def density(df: DataFrame, column: str, points: int = 100, per_width: int = FINE_PER_WIDTH) -> DataFrame:
    """Gaussian kernel density on a grid (Scott's bandwidth), summed over fine bins instead of rows.

    Bins are a fixed part of the kernel's width, however far single values lie
    apart, and stand at their rows' mean; empty ones do not exist.
    """
    x = num(column)
    n, lo, hi, dev = df.agg(F.count(x), F.min(x), F.max(x), F.stddev_samp(x)).first()
    spark = df.sparkSession
    if not n or not dev:
        return spark.createDataFrame([], "x double, density double")
    h = dev * n ** (-0.2)
    place = F.floor((x - F.lit(lo)) / F.lit(h / per_width))
    counts = df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.avg(x).alias("centre"))
    step = (hi - lo + 2 * h) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.lit(step) + F.lit(lo - h))
    z = (F.col("x") - F.col("centre")) / F.lit(h)
    kernel = F.col("c") * F.exp(-0.5 * z * z) / F.lit(n * h * math.sqrt(2 * math.pi))
    return counts.withColumn("x", F.explode(grid)).groupBy("x").agg(F.sum(kernel).alias("density"))


def pair_bins(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """All rows of every column pair as counts on a grid: (column_a, column_b, bin_a, bin_b, count).

    Bins have equal width between a column's extremes, the last one holds the
    largest value; a constant column has one bin.
    """
    ends = df.agg(*[f(num(c)) for c in columns for f in (F.min, F.max)]).first()
    place = {c: _bin(num(c), ends[2 * i], ends[2 * i + 1], bins) if ends[2 * i] is not None else F.lit(None).cast("int") for i, c in enumerate(columns)}
    cells = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), place[a].cast("int").alias("bin_a"), place[b].cast("int").alias("bin_b"))
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    rows = df.select(F.inline(F.array(*cells))).where(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
    return rows.groupBy("column_a", "column_b", "bin_a", "bin_b").agg(F.count(F.lit(1)).alias("count"))


def pair_points(df: DataFrame, columns: Sequence[str], order: Sequence[str], limit: int = POINT_LIMIT) -> DataFrame:
    """Thinned points of every column pair: (column_a, column_b, x, y)."""
    few = thinned(df, order, limit)
    cells = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), num(a).alias("x"), num(b).alias("y"))
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return few.select(F.inline(F.array(*cells))).where(F.col("x").isNotNull() & F.col("y").isNotNull())
