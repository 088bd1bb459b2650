"""Multivariate statistics on the moment matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.functions import tails
from gaugewell.functions.columns import num, quoted
from gaugewell.operators.regress import complete, linear_form, quadratic_form
from gaugewell.plans.moments import Moments, moments


def mahalanobis(df: DataFrame, columns: Sequence[str], m: Moments | None = None, out: str = "distance_sq") -> DataFrame:
    """Squared Mahalanobis distance of every complete row (sample covariance)."""
    rows = complete(df, columns)
    m = m or moments(rows, columns)
    return rows.withColumn(out, quadratic_form(columns, m.mean, np.linalg.inv(m.cov)))


def mardia(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mardia's skewness and kurtosis; skewness by p³ third moments instead of n² pairs.

    Tasks sum the moments of their rows as matrix products; the sums are added
    up one slice of p² moments at a time, in two steps.
    """
    rows = complete(df, columns)
    m = moments(rows, columns)
    p, n = len(columns), m.n
    values, vectors = np.linalg.eigh(m.cov_pop)
    white, mean = vectors / np.sqrt(values), np.asarray(m.mean)

    def sums(batches):
        third, fourth = np.zeros((p, p * p)), 0.0
        for pdf in batches:
            z = (pdf.to_numpy(dtype=float) - mean) @ white
            for at in range(0, len(z), 1_000):
                part = z[at : at + 1_000]
                third += part.T @ (part[:, :, None] * part[:, None, :]).reshape(len(part), p * p)
            fourth += float(((z**2).sum(axis=1) ** 2).sum())
        yield pd.DataFrame({"i": range(p), "v": list(third), "k": [fourth] + [0.0] * (p - 1)})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1].to_numpy(), "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)], "k": [pdf["k"].sum()]})

    schema = "i int, v array<double>, k double"
    parts = rows.select(*[num(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInPandas(sums, schema)
    some = parts.groupBy("i", F.pmod(F.spark_partition_id(), F.lit(32))).applyInPandas(added, schema)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / n) * (x / n))
    skew, kurt = some.groupBy("i").applyInPandas(added, schema).agg(F.sum(square), F.sum("k") / n).first()
    dof = p * (p + 1) * (p + 2) / 6
    s_stat = n * skew / 6
    k_stat = (kurt - p * (p + 2)) / math.sqrt(8 * p * (p + 2) / n)
    rows_out = [
        ("skewness", n, skew, s_stat, dof, tails.chi2_sf(s_stat, dof)),
        ("kurtosis", n, kurt, k_stat, None, tails.normal_two_sided(k_stat)),
    ]
    return df.sparkSession.createDataFrame(rows_out, "measure string, n bigint, value double, statistic double, df double, p_value double")


def hotelling(df: DataFrame, columns: Sequence[str], mu0: Sequence[float] | None = None) -> DataFrame:
    m = moments(complete(df, columns), columns)
    p, n = len(columns), m.n
    d = m.mean - (np.zeros(p) if mu0 is None else np.asarray(mu0, dtype=float))
    t2 = float(n * d @ np.linalg.solve(m.cov, d))
    f = (n - p) * t2 / (p * (n - 1))
    row = (n, t2, f, float(p), float(n - p), tails.f_sf(f, p, n - p))
    return df.sparkSession.createDataFrame([row], "n bigint, statistic double, f double, df1 double, df2 double, p_value double")


def manova(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """One-way Wilks' lambda with its F approximation.

    Between-group scatter is summed from the per-group means on the cluster, so
    many groups never reach the driver.
    """
    rows = df.select(quoted(group).alias("g"), *[num(c).alias(f"x{i}") for i, c in enumerate(columns)]).na.drop()
    p = len(columns)
    total = moments(rows, [f"x{i}" for i in range(p)])
    per = rows.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)])
    d = [F.col(f"m{i}") - F.lit(float(total.mean[i])) for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = per.agg(F.count(F.lit(1)), *[F.sum(F.col("n") * d[i] * d[j]) for i, j in pairs]).first()
    k = got[0]
    between = np.zeros((p, p))
    for (i, j), v in zip(pairs, got[1:]):
        between[i, j] = between[j, i] = v
    within = total.scatter - between
    wilks = float(np.linalg.det(within) / np.linalg.det(total.scatter))
    df1, df2 = p * (k - 1), total.n - k - p + 1
    f = (1 - wilks) / wilks * (df2 / df1)
    row = (total.n, k, wilks, f, float(df1), float(df2), tails.f_sf(f, df1, df2))
    return df.sparkSession.createDataFrame([row], "n bigint, groups bigint, wilks_lambda double, f double, df1 double, df2 double, p_value double")


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns flipped so that the largest loading is positive."""
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def ordered_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    return np.clip(values[order], 0.0, None), signed(vectors[:, order])


def component_table(spark, columns: Sequence[str], values: np.ndarray, vectors: np.ndarray, total: float | None = None) -> DataFrame:
    """One row per component: eigenvalue, share, running share and loadings by column."""
    total = float(values.sum()) if total is None else total
    rows, run = [], 0.0
    for i, v in enumerate(values):
        share = float(v) / total if total else 0.0
        run += share
        rows.append((i + 1, float(v), share, run, {c: float(vectors[j, i]) for j, c in enumerate(columns)}))
    return spark.createDataFrame(rows, "component int, eigenvalue double, explained_ratio double, cumulative_ratio double, loadings map<string,double>")


def pca_covariance(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Components of the covariance matrix, and rows with their scores pc1, pc2, …"""
    rows = complete(df, columns)
    m = moments(rows, columns)
    values, vectors = ordered_eigen(m.cov)
    scores = {f"pc{i + 1}": linear_form(columns, vectors[:, i], -float(m.mean @ vectors[:, i])) for i in range(len(columns))}
    return component_table(df.sparkSession, columns, values, vectors), rows.withColumns(scores)
