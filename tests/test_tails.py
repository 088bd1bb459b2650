"""Column forms of the usual distributions."""

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from gaugewell.functions import tails


def test_normal_quantile_column(spark):
    p = [1e-300, 1e-40, 1e-12, 1e-5, 0.01, 0.074, 0.075, 0.076, 0.3, 0.5, 0.7, 0.925, 0.926, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(v,) for v in [*p, 0.0, 1.0, 1.5, None]], "p double").coalesce(1)
    out = df.select(tails.z_quantile(F.col("p")).alias("z"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = [r["z"] for r in out.collect()]
    assert np.allclose(got[: len(p)], [NormalDist().inv_cdf(v) for v in p], rtol=1e-12, atol=1e-14)
    assert got[-4:-2] == [-math.inf, math.inf] and math.isnan(got[-2]) and got[-1] is None
