"""Tails, tests, regression, selection and reduction against published values and identities."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewell.functions import tails
from gaugewell.operators import hypothesis as h
from gaugewell.operators import multivar, regress, robust, select
from gaugewell.operators import reduce as red


def test_published_quantiles():
    assert math.isclose(tails.normal_ppf(0.975), 1.959963984540054, rel_tol=1e-12)
    assert math.isclose(tails.t_ppf(0.975, 10), 2.228138851964939, rel_tol=1e-9)
    assert math.isclose(tails.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-10)
    assert math.isclose(tails.f_sf(4.964602743730711, 1, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.t_sf(1.812461122811676, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.beta_inc(2, 3, 0.5), 0.6875, rel_tol=1e-12)


def test_fisher_tea_tasting():
    assert math.isclose(h.fisher_p(3, 1, 1, 3), 0.48571428571428565, rel_tol=1e-9)
    assert math.isclose(h.fisher_p(3, 1, 1, 3, "greater"), 0.24285714285714283, rel_tol=1e-9)
    brute = sum(p for p in (math.comb(9, k) * math.comb(11, 8 - k) / math.comb(20, 8) for k in range(9)) if p <= math.comb(9, 1) * math.comb(11, 7) / math.comb(20, 8) * (1 + 1e-7))
    assert math.isclose(h.fisher_p(1, 8, 7, 4), brute, rel_tol=1e-9)


def test_exact_rank_tails():
    assert math.isclose(h.u_tail(9, 3, 3), 1 / 20)
    assert math.isclose(h.wilcoxon_tail(0, 5), 1 / 32)


def test_shapiro_published_example(spark):
    # Weights of eleven men, Shapiro and Wilk 1965: W = 0.79.
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = h.shapiro_wilk(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").first()
    assert abs(row["statistic"] - 0.7888) < 5e-4 and abs(row["p_value"] - 0.0067) < 5e-4


def test_shapiro_invariant_to_partitions(spark):
    x = np.random.default_rng(0).normal(size=200)
    got = [h.shapiro_wilk(spark.createDataFrame(pd.DataFrame({"v": x})).repartition(p), "v").first()["statistic"] for p in (1, 8)]
    assert math.isclose(got[0], got[1], rel_tol=1e-9) and got[0] > 0.97


def test_mann_whitney_small_exact(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    row = h.mann_whitney_u(df, "v", "g", "a", "b").first()
    assert row["statistic"] == 0 and math.isclose(row["p_value"], 0.1) and row["effect_size"] == 1.0


def test_wilcoxon_and_paired(spark):
    df = spark.createDataFrame([(float(i), float(i) - d) for i, d in enumerate([1, 2, 3, 4, 5, 6])], "x double, y double")
    w = h.wilcoxon_signed_rank(df, "x", "y").first()
    assert w["statistic"] == 0 and math.isclose(w["p_value"], 2 / 64)
    t = h.t_test_paired(df, "x", "y").first()
    assert math.isclose(t["statistic"], 3.5 / (math.sqrt(3.5) / math.sqrt(6)), rel_tol=1e-9)


def test_p_value_adjustment(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    got = h.adjust_p_values(spark.createDataFrame([(v,) for v in p], "p_value double")).orderBy("p_value").collect()
    assert np.allclose([r["p_holm"] for r in got], [0.02, 0.03, 0.06, 0.06])
    assert np.allclose([r["p_fdr_bh"] for r in got], [0.02, 0.02, 0.04, 0.04])


def test_kendall_test_matches_known(spark):
    df = spark.createDataFrame([(12.0, 1.0), (2.0, 4.0), (1.0, 7.0), (12.0, 1.0), (2.0, 0.0)], "x double, y double")
    assert math.isclose(h.kendall_test(df, "x", "y").first()["statistic"], -0.47140452079103173, rel_tol=1e-9)


@pytest.fixture(scope="module")
def plane(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = 1 + x @ [2.0, -1.0, 0.0] + rng.normal(scale=0.3, size=400)
    pdf = pd.DataFrame(np.c_[x, y], columns=["a", "b", "c", "y"])
    pdf["count"] = rng.poisson(np.exp(0.3 + 0.5 * pdf["a"]))
    pdf["flag"] = (pdf["y"] > 1).astype(int)
    pdf["id"] = np.arange(400)
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def test_regressions(plane):
    pdf, df = plane
    x = np.c_[np.ones(400), pdf[["a", "b", "c"]]]
    w = np.linalg.lstsq(x, pdf["y"], rcond=None)[0]
    f = regress.ols(df, ["a", "b", "c"], "y")
    assert np.allclose(np.r_[f.intercept, f.coefficients], w) and 0.9 < f.quality["r_squared"] < 1
    xc = pdf[["a", "b", "c"]] - pdf[["a", "b", "c"]].mean()
    yc = pdf["y"] - pdf["y"].mean()
    ridge = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ yc)
    assert np.allclose(regress.ridge(df, ["a", "b", "c"], "y", 10.0).coefficients, ridge)
    lasso = regress.lasso(df, ["a", "b", "c"], "y", 0.1)
    g = (xc.T @ (yc - xc @ lasso.coefficients)) / 400
    active = lasso.coefficients != 0
    assert np.allclose(g[active], 0.1 * np.sign(lasso.coefficients[active]), atol=1e-8) and (np.abs(g[~active]) <= 0.1 + 1e-9).all()


def test_link_models_reach_stationary_points(plane):
    pdf, df = plane
    f = regress.poisson(df, ["a"], "count", alpha=0.5)
    mu = np.exp(f.intercept + f.coefficients[0] * pdf["a"])
    assert abs((mu - pdf["count"]).mean()) < 1e-7 and abs(((mu - pdf["count"]) * pdf["a"]).mean() + 0.5 * f.coefficients[0]) < 1e-7
    g = regress.logistic(df, ["a", "c"], "flag")
    p = 1 / (1 + np.exp(-(g.intercept + pdf[["a", "c"]] @ g.coefficients)))
    grad = (pdf[["a", "c"]].T @ (p - pdf["flag"])).to_numpy() + g.coefficients
    assert np.abs(grad).max() < 1e-5 and abs((p - pdf["flag"]).sum()) < 1e-5


def test_theil_sen_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 25, 80).astype(float), rng.normal(size=80)
    y += 0.7 * x
    s = np.array([(y[j] - y[i]) / (x[j] - x[i]) for i in range(80) for j in range(i) if x[i] != x[j]])
    row = robust.theil_sen(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(3), "x", "y").first()
    assert abs(row["slope"] - np.median(s)) < 1e-8 and row["ci_low"] < row["slope"] < row["ci_high"]


def test_mahalanobis_sum_and_diagnostics(plane):
    pdf, df = plane
    total = multivar.mahalanobis(df, ["a", "b", "c"]).agg(F.sum("distance_sq")).first()[0]
    assert math.isclose(total, 3 * 399, rel_tol=1e-9)
    lev = regress.diagnostics(df, ["a", "b"], "y").agg(F.sum("leverage")).first()[0]
    assert math.isclose(lev, 3.0, rel_tol=1e-9)


def test_mardia_matches_pairs(plane):
    pdf, df = plane
    x = pdf[["a", "b"]].to_numpy()
    d = (x - x.mean(axis=0)) @ np.linalg.inv(np.cov(x.T, ddof=0)) @ (x - x.mean(axis=0)).T
    got = {r["measure"]: r["value"] for r in multivar.mardia(df, ["a", "b"]).collect()}
    assert np.isclose(got["skewness"], (d**3).mean()) and np.isclose(got["kurtosis"], (np.diag(d) ** 2).mean())


def test_reductions(plane):
    pdf, df = plane
    table, scores = red.pca(df, ["a", "b", "c"], 3)
    rows = table.collect()
    assert np.isclose(rows[-1]["cumulative_ratio"], 1.0) and all(max(r["loadings"].values(), key=abs) > 0 for r in rows)
    z = (pdf[["a", "b", "c"]] - pdf[["a", "b", "c"]].mean()) / pdf[["a", "b", "c"]].std(ddof=0)
    assert np.isclose(scores.agg(F.var_samp("pc1")).first()[0], np.linalg.eigvalsh(z.cov())[-1])
    near = red.mds(df.limit(150), ["id"], ["a", "b"], 2, landmarks=150).join(df.limit(150), "id").toPandas()
    got = np.linalg.norm(near[["dim1", "dim2"]].to_numpy()[:, None] - near[["dim1", "dim2"]].to_numpy()[None], axis=2)
    want = np.linalg.norm(near[["a", "b"]].to_numpy()[:, None] - near[["a", "b"]].to_numpy()[None], axis=2)
    assert np.allclose(got, want, atol=1e-6)


def test_ica_separates_uniform_sources(spark):
    rng = np.random.default_rng(4)
    s = rng.uniform(-1, 1, (3000, 2))
    x = s @ np.array([[1.0, 0.4], [0.3, 1.0]])
    _, rows = red.fast_ica(spark.createDataFrame(pd.DataFrame(np.c_[x, s], columns=["a", "b", "s1", "s2"])), ["a", "b"], 2)
    c = rows.toPandas()[["ic1", "ic2", "s1", "s2"]].corr().abs().loc[["ic1", "ic2"], ["s1", "s2"]].to_numpy()
    assert c.max(axis=1).min() > 0.97


def test_selection(plane):
    _, df = plane
    wide = df.withColumn("twin", F.col("a") * 1.0001)
    kept = {r["feature"]: r["selected"] for r in select.correlation_filter(wide, ["a", "twin", "b"]).collect()}
    assert kept == {"a": False, "twin": True, "b": True}
    vif = {r["feature"]: r["selected"] for r in select.vif_filter(wide, ["a", "twin", "b"]).collect()}
    assert sum(vif.values()) == 2 and vif["b"]
    best = select.univariate_f(df, "y", ["a", "b", "c"], k=1).where("selected").first()["feature"]
    assert best == "a"
    rank = {r["feature"]: r["rank"] for r in select.rfe(df.select("a", "b", "c", "y"), "y", ["a", "b", "c"], keep=1, trees=10).collect()}
    assert rank["a"] == 1 and rank["c"] == 3
    with pytest.raises(ValueError):
        select.select_features(df, "univariate")
