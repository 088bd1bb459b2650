"""Regression: distributed moments, p×p solves, row-level fits as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions import tails
from gaugewell.functions.columns import num, nz, quoted
from gaugewell.plans.moments import Moments, moments
from gaugewell.session import held


def complete(df: DataFrame, features: Sequence[str], target: str | None = None) -> DataFrame:
    """Rows without a missing feature or target, as doubles under their own names."""
    wanted = [*features, *([target] if target else [])]
    rest = [c for c in df.columns if c not in wanted]
    return df.select(*[quoted(c) for c in rest], *[num(c).alias(c) for c in wanted]).na.drop("any", subset=list(wanted))


def linear_form(features: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    return reduce(lambda acc, cw: acc + quoted(cw[0]) * F.lit(float(cw[1])), zip(features, weights), F.lit(float(intercept)))


@dataclass
class Fit:
    """A fitted linear model: coefficients, quality figures and what the t tests need."""

    kind: str
    features: list[str]
    coefficients: np.ndarray
    intercept: float
    n: int
    quality: dict[str, float | None] = field(default_factory=dict)
    std_errors: np.ndarray | None = None

    def predict(self) -> Column:
        return linear_form(self.features, self.coefficients, self.intercept)

    def table(self, spark) -> DataFrame:
        """One row per term, with t and p where standard errors exist."""
        names = ["intercept", *self.features]
        values = [self.intercept, *map(float, self.coefficients)]
        rows = []
        for i, (name, v) in enumerate(zip(names, values)):
            se = float(self.std_errors[i]) if self.std_errors is not None else None
            t = v / se if se else None
            dof = self.quality.get("df")
            p = tails.one_or_two_sided(tails.t_sf(t, dof), "two-sided") if t is not None and dof else None
            rows.append((name, float(v), se, t, p))
        return spark.createDataFrame(rows, "term string, coefficient double, std_error double, t double, p_value double")

    def summary(self, spark) -> DataFrame:
        names = list(self.quality)
        row = (self.kind, self.n, *[None if self.quality[k] is None else float(self.quality[k]) for k in names])
        return spark.createDataFrame([row], "model string, n bigint, " + ", ".join(f"{k} double" for k in names))


def _quality(df: DataFrame, target: str, predicted: Column, n: int, total: float, p: int) -> dict:
    """R², adjusted R², RMSE and MAE; the residual pass is one aggregate."""
    e = quoted(target) - predicted
    sse, sae = df.agg(F.sum(e * e), F.sum(F.abs(e))).first()
    r2 = 1 - sse / total if total else None
    return {
        "r_squared": r2,
        "adj_r_squared": 1 - (1 - r2) * (n - 1) / (n - p) if r2 is not None and n > p else None,
        "rmse": math.sqrt(sse / n),
        "mae": sae / n,
        "sse": sse,
    }


def simple_linear(df: DataFrame, x: str, y: str) -> Fit:
    rows = complete(df, [x], y)
    n, slope, icept, sxx, syy, r2 = rows.agg(
        F.count(F.lit(1)), F.regr_slope(y, x), F.regr_intercept(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_r2(y, x)
    ).first()
    fit = Fit("simple_linear", [x], np.array([slope]), icept, n)
    q = _quality(rows, y, fit.predict(), n, syy, 2)
    s2 = max(syy - slope * slope * sxx, 0.0) / (n - 2)
    mean_x = rows.agg(F.avg(x)).first()[0]
    se = math.sqrt(s2 / sxx)
    fit.std_errors = np.array([math.sqrt(s2 * (1 / n + mean_x * mean_x / sxx)), se])
    t = slope / se if se else math.inf
    q.update({"r": math.copysign(math.sqrt(r2), slope), "t": t, "df": n - 2.0, "p_value": 2 * tails.t_sf(abs(t), n - 2) if se else 0.0})
    fit.quality = q
    return fit


def ols(df: DataFrame, features: Sequence[str], y: str, intercept: bool = True, kind: str = "multiple_linear") -> Fit:
    """Least squares from one moment pass."""
    rows = complete(df, features, y)
    m = moments(rows, [*features, y])
    k = len(features)
    if intercept:
        a, b = m.scatter[:k, :k], m.scatter[:k, k]
    else:
        raw = m.raw
        a, b = raw[:k, :k], raw[:k, k]
    inv = np.linalg.pinv(a)
    w = inv @ b
    b0 = float(m.mean[k] - m.mean[:k] @ w) if intercept else 0.0
    fit = Fit(kind, list(features), w, b0, m.n)
    p = k + int(intercept)
    q = _quality(rows, y, fit.predict(), m.n, float(m.scatter[k, k]), p)
    dof = m.n - p
    s2 = q["sse"] / dof if dof > 0 else math.nan
    var = s2 * np.diag(inv)
    v0 = s2 * (1 / m.n + m.mean[:k] @ inv @ m.mean[:k]) if intercept else math.nan
    fit.std_errors = np.sqrt(np.r_[v0, var])
    loglik = -m.n / 2 * (math.log(2 * math.pi) + math.log(q["sse"] / m.n) + 1) if q["sse"] > 0 else math.inf
    q.update({"aic": 2 * p - 2 * loglik, "bic": p * math.log(m.n) - 2 * loglik, "df": float(dof)})
    fit.quality = q
    return fit


def powers(df: DataFrame, x: str, degree: int) -> tuple[DataFrame, list[str]]:
    names = [f"{x}_pow{d}" for d in range(1, degree + 1)]
    return df.withColumns({n: F.pow(num(x), d) for d, n in enumerate(names, 1)}), names


def polynomial(df: DataFrame, x: str, y: str, degree: int = 2) -> Fit:
    wide, names = powers(df, x, degree)
    return ols(wide, names, y, kind="polynomial")


def _centred(df: DataFrame, features: Sequence[str], y: str) -> tuple[DataFrame, Moments]:
    rows = complete(df, features, y)
    return rows, moments(rows, [*features, y])


def _shrunk(rows: DataFrame, m: Moments, features: Sequence[str], y: str, w: np.ndarray, kind: str) -> Fit:
    k = len(features)
    fit = Fit(kind, list(features), w, float(m.mean[k] - m.mean[:k] @ w), m.n)
    fit.quality = _quality(rows, y, fit.predict(), m.n, float(m.scatter[k, k]), k + 1)
    return fit


def ridge(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> Fit:
    """min ‖y − Xw‖² + α‖w‖², intercept unpenalised."""
    rows, m = _centred(df, features, y)
    k = len(features)
    w = np.linalg.solve(m.scatter[:k, :k] + alpha * np.eye(k), m.scatter[:k, k])
    return _shrunk(rows, m, features, y, w, "ridge")


def coordinate_descent(gram: np.ndarray, xy: np.ndarray, l1: float, l2: float, tol: float = 1e-12, max_iter: int = 100_000) -> np.ndarray:
    """min ½ w'Gw − w'b + l1‖w‖₁ + ½ l2‖w‖² on the p×p matrix."""
    w = np.zeros(len(xy))
    for _ in range(max_iter):
        worst = 0.0
        for j in range(len(xy)):
            rho = xy[j] - gram[j] @ w + gram[j, j] * w[j]
            scale = gram[j, j] + l2
            new = math.copysign(max(abs(rho) - l1, 0.0), rho) / scale if scale else 0.0
            worst = max(worst, abs(new - w[j]) * math.sqrt(max(scale, 0.0)))
            w[j] = new
        if worst < tol:
            break
    return w


def elastic_net(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, l1_ratio: float = 0.5, kind: str = "elastic_net") -> Fit:
    """min 1/(2n)‖y − Xw‖² + α·l1_ratio‖w‖₁ + ½α(1 − l1_ratio)‖w‖²."""
    rows, m = _centred(df, features, y)
    k = len(features)
    w = coordinate_descent(m.scatter[:k, :k] / m.n, m.scatter[:k, k] / m.n, alpha * l1_ratio, alpha * (1 - l1_ratio))
    return _shrunk(rows, m, features, y, w, kind)


def lasso(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> Fit:
    return elastic_net(df, features, y, alpha, 1.0, "lasso")


def _newton(rows: DataFrame, features: Sequence[str], y: str, link, l2: float):
    with held(rows.select(*[quoted(c) for c in [*features, y]])) as kept:
        return _newton_steps(kept, features, y, link, l2)


def _newton_steps(rows: DataFrame, features: Sequence[str], y: str, link, l2: float, steps: int = 25, tol: float = 1e-10):
    """Newton on mean loss + ½ l2‖w‖²; one aggregate of gradient and Hessian per step.

    ``link(eta)`` gives (mean, variance weight) columns of the canonical family.
    """
    k = len(features)
    stats = rows.agg(F.count(F.lit(1)), F.avg(quoted(y)), *[F.avg(quoted(c)) for c in features], *[F.stddev_pop(quoted(c)) for c in features]).first()
    n, mean_y = stats[0], stats[1]
    centre = np.array(stats[2 : 2 + k], dtype=float)
    scale = np.array([s or 1.0 for s in stats[2 + k :]], dtype=float)
    # Standardised columns for the solve only; the penalty stays on the raw weights.
    xs = [(quoted(c) - F.lit(float(a))) / F.lit(float(s)) for c, a, s in zip(features, centre, scale)]
    penalty = np.r_[0.0, l2 / scale**2]
    w = np.zeros(k + 1)
    w[0] = math.log(mean_y) if link is poisson_link else math.log(mean_y / (1 - mean_y))
    loss = None
    for _ in range(steps):
        eta = reduce(lambda acc, p: acc + p[0] * F.lit(float(p[1])), zip(xs, w[1:]), F.lit(float(w[0])))
        base = rows.select(quoted(y).alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(xs)], eta.alias("eta"))
        mu, weight = link(F.col("eta"))
        work = base.withColumn("e", mu - F.col("y")).withColumn("h", weight)
        cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(k)]]
        aggs = [F.avg(F.col("e") * c) for c in cols]
        aggs += [F.avg(F.col("h") * cols[i] * cols[j]) for i in range(k + 1) for j in range(i, k + 1)]
        got = work.agg(*aggs).first()
        grad = np.array(got[: k + 1], dtype=float) + penalty * w
        hess = np.zeros((k + 1, k + 1))
        at = k + 1
        for i in range(k + 1):
            for j in range(i, k + 1):
                hess[i, j] = hess[j, i] = got[at]
                at += 1
        step = np.linalg.solve(hess + np.diag(penalty) + 1e-12 * np.eye(k + 1), grad)
        # Damping keeps the exponential from running away on the first steps.
        w = w - step * min(1.0, 5.0 / max(1e-300, float(np.abs(step).max())))
        loss = float(np.abs(step).max())
        if loss < tol:
            break
    raw = w[1:] / scale
    return raw, float(w[0] - raw @ centre), n, mean_y


def poisson_link(eta: Column) -> tuple[Column, Column]:
    return F.exp(eta), F.exp(eta)


def logit_link(eta: Column) -> tuple[Column, Column]:
    p = 1 / (1 + F.exp(-eta))
    return p, p * (1 - p)


def poisson(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> Fit:
    """Log link, mean half-deviance + ½α‖w‖²; deviance pseudo-R²."""
    rows = complete(df, features, y)
    w, b, n, mean = _newton(rows, features, y, poisson_link, alpha)
    fit = Fit("poisson", list(features), w, b, n)
    mu = F.exp(fit.predict())
    t = quoted(y)
    part = lambda m: 2 * (F.when(t > 0, t * F.log(t / m)).otherwise(0.0) - (t - m))
    dev, null = rows.agg(F.sum(part(mu)), F.sum(part(F.lit(float(mean))))).first()
    fit.quality = {"deviance": dev, "pseudo_r_squared": 1 - dev / null if null else None}
    return fit


def logistic(df: DataFrame, features: Sequence[str], y: str, c: float = 1.0) -> Fit:
    """L2-penalised (1/(nC)) logistic regression; McFadden pseudo-R²."""
    rows = complete(df, features, y)
    n = rows.count()
    w, b, n, mean = _newton(rows, features, y, logit_link, 1.0 / (n * c))
    fit = Fit("logistic", list(features), w, b, n)
    eta = fit.predict()
    ll, right = rows.agg(
        F.sum(quoted(y) * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))),
        F.avg(((eta > 0) == (quoted(y) == 1)).cast("double")),
    ).first()
    null = n * (mean * math.log(mean) + (1 - mean) * math.log(1 - mean))
    fit.quality = {"log_likelihood": ll, "pseudo_r_squared": 1 - ll / null, "accuracy": right}
    return fit


def fitted(df: DataFrame, fit: Fit, y: str | None = None) -> DataFrame:
    """Rows with ``fitted`` (probability or mean for the link models) and ``residual``."""
    eta = fit.predict()
    value = {"logistic": 1 / (1 + F.exp(-eta)), "poisson": F.exp(eta)}.get(fit.kind, eta)
    out = df.withColumn("fitted", value)
    return out.withColumn("residual", quoted(y) - F.col("fitted")) if y else out


def diagnostics(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Per row: residual, leverage, standardised residual and Cook's distance of the OLS fit."""
    rows, m = _centred(df, features, y)
    k = len(features)
    inv = np.linalg.pinv(m.scatter[:k, :k])
    fit = ols(rows, features, y)
    s2 = fit.quality["sse"] / (m.n - k - 1)
    lever = F.lit(1.0 / m.n) + quadratic_form(features, m.mean[:k], inv)
    out = fitted(rows, fit, y).withColumn("leverage", lever)
    h, e = F.col("leverage"), F.col("residual")
    return out.withColumn("standardized_residual", e / nz(F.sqrt(F.lit(s2) * (1 - h)))).withColumn(
        "cooks_distance", e * e * h / nz(F.lit((k + 1) * s2) * (1 - h) * (1 - h))
    )


def quadratic_form(columns: Sequence[str], centre: Sequence[float], matrix: np.ndarray) -> Column:
    """(x − c)' M (x − c) as a column; with many columns over arrays, so that the expression stays small."""
    d = [num(c) - F.lit(float(a)) for c, a in zip(columns, centre)]
    if len(d) > 8:
        row = lambda i: F.array(*[F.lit(float(v)) for v in matrix[i]])
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
        lines = F.array(*[row(i) for i in range(len(d))])
        whole = F.transform(F.array(F.array(*d)), lambda x: dot(x, F.transform(lines, lambda line: dot(line, x))))
        return whole[0]
    total = F.lit(0.0)
    for i in range(len(d)):
        for j in range(i, len(d)):
            total = total + d[i] * d[j] * F.lit(float(matrix[i, j]) * (1.0 if i == j else 2.0))
    return total
