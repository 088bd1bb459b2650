"""Means and scatter matrices: one distributed pass, p×p algebra afterwards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.columns import num

SQL_LIMIT = 20


@dataclass
class Moments:
    columns: list[str]
    n: int
    mean: np.ndarray
    scatter: np.ndarray  # sum of (x - mean)(x - mean)'

    @property
    def cov(self) -> np.ndarray:
        return self.scatter / max(self.n - 1, 1)

    @property
    def cov_pop(self) -> np.ndarray:
        return self.scatter / max(self.n, 1)

    @property
    def corr(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.scatter))
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.scatter / np.outer(d, d)

    @property
    def raw(self) -> np.ndarray:
        """Uncentred sum of x x'."""
        return self.scatter + self.n * np.outer(self.mean, self.mean)

    def at(self, names: Sequence[str]) -> np.ndarray:
        return np.array([self.columns.index(c) for c in names])


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Over rows complete in ``columns``."""
    cols = list(columns)
    rows = df.select(*[num(c).alias(f"x{i}") for i, c in enumerate(cols)]).na.drop()
    p = len(cols)
    if p > SQL_LIMIT:
        return _wide(rows, cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)],
        *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    n = row["n"]
    mean = np.array([row[f"m{i}"] if n else np.nan for i in range(p)], dtype=float)
    scatter = np.zeros((p, p))
    for i, j in pairs:
        scatter[i, j] = scatter[j, i] = (row[f"c{i}_{j}"] or 0.0) * n
    return Moments(cols, n, mean, scatter)


def merge(parts: Iterator[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray | None, np.ndarray | None]:
    """Stable pairwise update of (n, mean, scatter)."""
    n, mean, scatter = 0.0, None, None
    for m, mu, s in parts:
        if not m:
            continue
        if mean is None:
            n, mean, scatter = m, mu.copy(), s.copy()
            continue
        delta = mu - mean
        total = n + m
        scatter += s + np.outer(delta, delta) * (n * m / total)
        mean += delta * (m / total)
        n = total
    return n, mean, scatter


def _wide(rows: DataFrame, cols: list[str]) -> Moments:
    p = len(cols)
    schema = "n double, mean array<double>, scatter array<double>"

    def partial(batches):
        def each():
            for pdf in batches:
                x = pdf.to_numpy(dtype=float)
                if len(x):
                    mu = x.mean(axis=0)
                    d = x - mu
                    yield float(len(x)), mu, d.T @ d

        n, mean, scatter = merge(each())
        if n:
            yield pd.DataFrame({"n": [n], "mean": [mean.tolist()], "scatter": [scatter.ravel().tolist()]})

    def combine(batches):
        def each():
            for pdf in batches:
                for n, mu, s in zip(pdf["n"], pdf["mean"], pdf["scatter"]):
                    yield n, np.asarray(mu, dtype=float), np.asarray(s, dtype=float).reshape(p, p)

        n, mean, scatter = merge(each())
        if n:
            yield pd.DataFrame({"n": [n], "mean": [mean.tolist()], "scatter": [scatter.ravel().tolist()]})

    parts = rows.mapInPandas(partial, schema)
    mids = parts.repartition(max(1, int(rows.sparkSession.sparkContext.defaultParallelism))).mapInPandas(combine, schema)
    out = mids.repartition(1).mapInPandas(combine, schema).first()
    if out is None:
        return Moments(cols, 0, np.full(p, np.nan), np.zeros((p, p)))
    return Moments(cols, int(out["n"]), np.array(out["mean"]), np.array(out["scatter"]).reshape(p, p))
