"""Correlation matrices in long form (one row per ordered pair of columns)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.columns import correlation, melt, num, pick_numeric, unfold
from gaugewell.functions.tails import t_two_sided
from gaugewell.plans.concordance import concordance
from gaugewell.plans.iterate import array_sum
from gaugewell.plans.ranks import rank_table, with_rank
from gaugewell.session import cut_lineage

PAIRS_PER_PASS = 120
WIDE_COLUMNS = 24


def _matrix(df: DataFrame, names: Sequence[str], values: Sequence[Column], extra: bool = False) -> DataFrame:
    """Pairwise-complete Pearson matrix; one aggregate per ``PAIRS_PER_PASS`` pairs, or one batch pass when wide."""
    xs = df.select(*[v.alias(f"x{i}") for i, v in enumerate(values)])
    if len(names) > WIDE_COLUMNS:
        return _wide_matrix(xs, names)
    pairs = list(combinations(range(len(names)), 2))
    tables = []
    for start in range(0, max(len(pairs), 1), PAIRS_PER_PASS):
        part = pairs[start : start + PAIRS_PER_PASS]
        aggs = []
        for i, j in part:
            both = F.col(f"x{i}").isNotNull() & F.col(f"x{j}").isNotNull()
            aggs += [correlation(F.col(f"x{i}"), F.col(f"x{j}")).alias(f"r{i}_{j}"), F.count(F.when(both, 1)).alias(f"n{i}_{j}")]
        if start == 0:
            for i in range(len(names)):
                aggs += [F.var_pop(f"x{i}").alias(f"v{i}"), F.count(f"x{i}").alias(f"n{i}")]
        rows = []
        for i, j in part:
            r = F.col(f"r{i}_{j}")
            for a, b in ((i, j), (j, i)):
                rows.append(_cell(names[a], names[b], r, F.col(f"n{i}_{j}")))
        if start == 0:
            for i, c in enumerate(names):
                rows.append(_cell(c, c, F.when(F.col(f"v{i}") > 0, F.lit(1.0)), F.col(f"n{i}")))
        tables.append(unfold(xs.agg(*aggs), rows))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _wide_matrix(xs: DataFrame, names: Sequence[str]) -> DataFrame:
    """All pairs from four p×p sums over Arrow batches, columns shifted by their means first."""
    p = len(names)
    cols = [f"x{i}" for i in range(p)]
    means = np.array([m if m is not None else 0.0 for m in xs.agg(*[F.avg(c) for c in cols]).first()])

    def sums(x: np.ndarray) -> np.ndarray:
        have = ~np.isnan(x)
        d = np.where(have, x - means, 0.0)
        m = have.astype(float)
        return np.concatenate([(m.T @ m).ravel(), (d.T @ m).ravel(), ((d * d).T @ m).ravel(), (d.T @ d).ravel()])

    n, s, q, c = array_sum(xs, cols, sums, 4 * p * p).reshape(4, p, p)
    rows = []
    for i in range(p):
        for j in range(p):
            k = n[i, j]
            vx = q[i, j] - s[i, j] ** 2 / k if k else 0.0
            vy = q[j, i] - s[j, i] ** 2 / k if k else 0.0
            both = vx > 1e-14 * q[i, j] and vy > 1e-14 * q[j, i]
            r = (c[i, j] - s[i, j] * s[j, i] / k) / math.sqrt(vx * vy) if both else None
            rows.append((names[i], names[j], 1.0 if i == j and both else None if r is None else float(min(1.0, max(-1.0, r))), int(k)))
    return xs.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double, n bigint")


def _cell(a: str, b: str, value: Column, n: Column) -> Column:
    return F.struct(
        F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), value.alias("correlation"), n.cast("long").alias("n")
    )


def pearson(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    cols = pick_numeric(df, columns, exclude)
    return _matrix(df, cols, [num(c) for c in cols])


def spearman(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Pearson on average ranks.

    Ranks are taken over each column's own non-null values when the columns are
    complete; with nulls every pair is ranked over its common rows.
    """
    cols = pick_numeric(df, columns, exclude)
    src = df.select(*[num(c).alias(f"x{i}") for i, c in enumerate(cols)])
    gaps = src.agg(F.count(F.lit(1)), *[F.count(f"x{i}") for i in range(len(cols))]).first()
    if all(g == gaps[0] for g in gaps):
        names = [f"x{i}" for i in range(len(cols))]
        ranks = cut_lineage(rank_table(melt(src, names), "value", ["column"]))
        ranked = src
        for i, x in enumerate(names):
            one = ranks.where(F.col("column") == x).select(F.col("_x").alias(x), F.col("avg_rank").alias(f"k{i}"))
            ranked = ranked.join(one, x)
        return _matrix(ranked, cols, [F.col(f"k{i}") for i in range(len(cols))])
    out = None
    for i, j in combinations(range(len(cols)), 2):
        pair = src.select(f"x{i}", f"x{j}").na.drop()
        pair = with_rank(with_rank(pair, f"x{i}", "a"), f"x{j}", "b")
        part = _matrix(pair, [cols[i], cols[j]], [F.col("a"), F.col("b")]).where(F.col("column_a") != F.col("column_b"))
        out = part if out is None else out.unionByName(part)
    diagonal = _matrix(src, cols, [F.col(f"x{i}") for i in range(len(cols))]).where(F.col("column_a") == F.col("column_b"))
    return diagonal if out is None else diagonal.unionByName(out)


def kendall(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Tie-corrected tau-b for every pair, counted exactly without forming row pairs."""
    cols = pick_numeric(df, columns, exclude)
    spark = df.sparkSession
    rows = []
    for c in cols:
        stat = df.agg(F.count(num(c)), F.var_pop(num(c))).first()
        rows.append((c, c, 1.0 if stat[1] else None, stat[0]))
    for a, b in combinations(cols, 2):
        k = concordance(df, a, b)
        rows += [(a, b, k.tau_b, k.n), (b, a, k.tau_b, k.n)]
    return spark.createDataFrame(rows, "column_a string, column_b string, correlation double, n bigint")


METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def correlate(df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown correlation method {method!r}")
    return METHODS[method](df, columns, exclude)


def lookup(matrix: DataFrame, a: str, b: str) -> DataFrame:
    return matrix.where((F.col("column_a") == a) & (F.col("column_b") == b))


def high_pairs(matrix: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Unordered pairs at or over the threshold, strongest first."""
    return (
        matrix.where((F.col("column_a") < F.col("column_b")) & (F.abs("correlation") >= threshold))
        .select("column_a", "column_b", "correlation")
        .orderBy(F.abs("correlation").desc(), "column_a", "column_b")
    )


def summary(matrix: DataFrame, threshold: float = 0.1) -> DataFrame:
    size = F.abs("correlation")
    return matrix.where(F.col("column_a") < F.col("column_b")).agg(
        F.count("correlation").alias("total_pairs"),
        F.max(size).alias("max_correlation"),
        F.min(size).alias("min_correlation"),
        F.avg(size).alias("mean_correlation"),
        F.count(F.when(size >= threshold, 1)).alias("high_correlations_count"),
    )


def significance(matrix: DataFrame, alpha: float = 0.05) -> DataFrame:
    """t statistic, p-value and significance flag of each pair."""
    r, dof = F.col("correlation"), (F.col("n") - 2).cast("double")
    t = F.when((F.abs(r) < 1) & (dof > 0), r * F.sqrt(dof / (1 - r * r)))
    p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_two_sided(t, dof))
    return (
        matrix.where(F.col("column_a") < F.col("column_b"))
        .withColumn("t", t)
        .withColumn("p_value", p)
        .withColumn("significant", F.col("p_value") < alpha)
    )
