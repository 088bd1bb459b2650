"""Nearest-neighbour information against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewell.operators import select


def psi(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, n))


def brute(x, y, k=3):
    keep = [i for i in range(len(x)) if y[i] is not None and sum(v == y[i] for v in y) > 1]
    x, y = np.array([x[i] for i in keep]), np.array([y[i] for i in keep])
    parts = []
    for i in range(len(x)):
        gap = np.abs(x - x[i])
        own = np.sort(np.delete(gap, i)[np.delete(y, i) == y[i]])
        kk = min(k, len(own))
        r = own[kk - 1]
        m = int(((gap < r) | (gap == 0)).sum())
        parts.append(psi(kk) - psi(len(own) + 1) - psi(m))
    return max(0.0, psi(len(x)) + float(np.mean(parts))) if parts else None


def test_digamma(spark):
    got = [r["p"] for r in spark.range(1, 200).select(select.digamma(F.col("id")).alias("p")).collect()]
    assert np.allclose(got, [psi(n) for n in range(1, 200)], atol=1e-12)


@pytest.mark.parametrize("parts", [1, 6])
def test_information_equals_all_pairs(spark, parts):
    rng = np.random.default_rng(11)
    y = rng.choice(["a", "b", "c"], 300, p=[0.7, 0.25, 0.05]).tolist() + ["once", None, None, "two", "two"]
    n = len(y)
    tells = np.array([{"a": 0, "b": 3}.get(v, 6) for v in y]) + rng.normal(size=n)
    pdf = pd.DataFrame({"tells": tells.round(3), "noise": rng.normal(size=n).astype("float32").astype(float), "ties": rng.integers(0, 4, n).astype(float), "y": y})
    pdf = pdf.assign(**{c: (pdf[c] * 1024).round() / 1024 for c in ("tells", "noise")})  # differences are exact
    df = spark.createDataFrame(pdf).repartition(parts)
    got = {r["feature"]: r for r in select.knn_information(df, "y", ["tells", "noise", "ties"], k=1).collect()}
    for c in ("tells", "noise", "ties"):
        assert abs(got[c]["score"] - brute(pdf[c].tolist(), y)) < 1e-9
    assert got["tells"]["selected"] and not got["noise"]["selected"]


def test_information_of_nothing(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, None)], "x double, y string")
    assert select.knn_information(df, "y", ["x"]).count() == 0
    assert select.knn_information(df.limit(0), "y", ["x"]).count() == 0
