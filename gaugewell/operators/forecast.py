"""ARIMA, seasonal ARIMA, exponential smoothing and STL forecasts.

All models are fitted for all series together by damped Gauss–Newton on the
conditional sum of squares: each pass computes residuals and a numeric Jacobian
block by block, sums the normal equations per series, and updates the small
parameter table.  Blocks run from their true states (``plans/recursion.py``),
so the series length is not bounded by one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.functions import tails
from gaugewell.functions.columns import nz
from gaugewell.operators.series import decompose_stl, seasonal_period
from gaugewell.plans.blocks import per_series, series_keys
from gaugewell.plans.joins import null_safe_join
from gaugewell.plans.recursion import block_runs, packed
from gaugewell.session import cut_lineage

ROUNDS = 15


@dataclass(frozen=True)
class Arima:
    """(p,d,q)(P,D,Q)s by its lag polynomials, with an optional constant."""

    order: tuple[int, int, int] = (1, 1, 1)
    seasonal: tuple[int, int, int] = (0, 0, 0)
    period: int = 0
    constant: bool | None = None

    @property
    def has_constant(self) -> bool:
        return self.constant if self.constant is not None else self.order[1] + self.seasonal[1] == 0

    @property
    def start(self) -> list[float]:
        p, _, q = self.order
        big_p, _, big_q = self.seasonal
        return [0.1] * p + [0.1] * q + [0.1] * big_p + [0.1] * big_q + ([0.0] if self.has_constant else [])

    @property
    def candidates(self) -> list[list[float]]:
        """Starting points screened before the search (the constant keeps its guess)."""
        p, _, q = self.order
        big_p, _, big_q = self.seasonal
        out = []
        for a, b in product((-0.5, 0.1, 0.6) if p else (0.0,), (-0.8, -0.3, 0.3) if q else (0.0,)):
            for c, d in ((0.1, -0.3), (-0.3, -0.7)) if big_p + big_q else ((0.0, 0.0),):
                out.append([a, *[0.0] * (p - 1)][:p] + [b, *[0.0] * (q - 1)][:q] + [c, *[0.0] * (big_p - 1)][:big_p] + [d, *[0.0] * (big_q - 1)][:big_q])
        return out

    @property
    def limits(self) -> tuple[list[float], list[float]]:
        k = len(self.start) - int(self.has_constant)
        top = [0.995] * k + ([math.inf] if self.has_constant else [])
        return [-t for t in top], top

    @property
    def lost(self) -> int:
        return self.order[1] + self.seasonal[1] * self.period

    @property
    def skip(self) -> int:
        return self.lost + self.order[0] + self.seasonal[0] * self.period

    affine = True

    def polynomials(self, theta: Sequence[float]) -> tuple[np.ndarray, np.ndarray, float]:
        """Coefficients of w_{t−i} (i ≥ 1) and e_{t−j} (j ≥ 1), and the constant (mean of w)."""
        p, _, q = self.order
        big_p, _, big_q = self.seasonal
        theta = list(theta)
        ar, ma = theta[:p], theta[p : p + q]
        sar, sma = theta[p + q : p + q + big_p], theta[p + q + big_p : p + q + big_p + big_q]
        c = theta[-1] if self.has_constant else 0.0
        return -_times(ar, sar, self.period, -1.0)[1:], _times(ma, sma, self.period, 1.0)[1:], c

    def differences(self, y: np.ndarray) -> np.ndarray:
        w = y
        for _ in range(self.order[1]):
            w = w[1:] - w[:-1]
        for _ in range(self.seasonal[1]):
            w = w[self.period :] - w[: -self.period]
        return w

    def inputs(self, y: np.ndarray, theta: Sequence[float], halo: int) -> np.ndarray:
        """What the autoregressive side leaves of each row past the halo; differences and lags before the series' start are zero."""
        a, _, c = self.polynomials(theta)
        w = self.differences(y) - c
        u = w.copy()
        for i in np.flatnonzero(a):
            lag = i + 1
            u[lag:] -= a[i] * w[:-lag]
        return np.r_[np.zeros(len(y) - len(u)), u][halo:]

    def first_state(self, y: np.ndarray, theta: Sequence[float]) -> np.ndarray:
        return np.zeros(self.order[2] + self.seasonal[2] * self.period)

    def steps(self, inputs: np.ndarray, state: np.ndarray, theta: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """The state holds the last errors, the latest one last."""
        _, b, _ = self.polynomials(theta)
        d, rows = len(state), len(inputs)
        lags = [(int(j) + 1, float(b[j])) for j in np.flatnonzero(b)]
        if not lags:
            return inputs, np.vstack((state, inputs))[rows:]
        if inputs.shape[1] == 1:
            run = state[:, 0].tolist()
            for t, v in enumerate(inputs[:, 0].tolist(), d):
                for lag, coef in lags:
                    v -= coef * run[t - lag]
                run.append(v)
            e = np.array(run)[:, None]
        else:
            e = np.vstack((state, inputs))
            for t in range(d, d + rows):
                for lag, coef in lags:
                    e[t] -= coef * e[t - lag]
        return e[d:], e[rows:]

    def ahead(self, y: np.ndarray, errors: np.ndarray, state: np.ndarray, n: int, theta: Sequence[float], steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean forecasts and variance factors, from the last values and errors."""
        a, b, c = self.polynomials(theta)
        e = errors.tolist()
        full = _differenced(a, self.order[1], self.seasonal[1], self.period)
        gain = c * (1.0 - a.sum())
        past, out = y.tolist(), []
        for h in range(steps):
            v = gain + sum(f * past[-1 - i] for i, f in enumerate(full) if i < len(past))
            v += sum(m * e[-1 - j] for j, m in enumerate(b) if j < len(e))
            past.append(v)
            e.append(0.0)
            out.append(v)
        psi = [1.0]
        for h in range(1, steps):
            psi.append(sum(full[i] * psi[h - 1 - i] for i in range(min(h, len(full)))) + (b[h - 1] if h - 1 < len(b) else 0.0))
        return np.array(out), np.cumsum(np.square(psi))


def _times(short: Sequence[float], long: Sequence[float], period: int, sign: float) -> np.ndarray:
    """Product of (1 ± Σ short B^i) and (1 ± Σ long B^{is})."""
    x = np.r_[1.0, [sign * v for v in short]]
    z = np.zeros(len(long) * period + 1)
    z[0] = 1.0
    for i, v in enumerate(long, 1):
        z[i * period] = sign * v
    return np.convolve(x, z)


def _differenced(a: np.ndarray, d: int, big_d: int, period: int) -> np.ndarray:
    """Coefficients of past y once differencing is multiplied into the AR side."""
    poly = np.r_[1.0, -a]
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(big_d):
        poly = np.convolve(poly, np.r_[1.0, np.zeros(period - 1), -1.0])
    return -poly[1:]


@dataclass(frozen=True)
class Smoothing:
    """Exponential smoothing: level, optional additive trend (damped), optional season."""

    trend: bool = True
    season: str | None = None  # None, add, mul
    period: int = 0
    damped: bool = False

    @property
    def start(self) -> list[float]:
        return [0.3] + ([0.1] if self.trend else []) + ([0.1] if self.season else []) + ([0.95] if self.damped else [])

    @property
    def candidates(self) -> list[list[float]]:
        betas = (0.01, 0.2) if self.trend else (None,)
        gammas = (0.05, 0.3) if self.season else (None,)
        tail = [0.9] if self.damped else []
        return [[v for v in combo if v is not None] + tail for combo in product((0.05, 0.3, 0.8), betas, gammas)]

    @property
    def limits(self) -> tuple[list[float], list[float]]:
        k = len(self.start) - int(self.damped)
        return [1e-4] * k + ([0.8] if self.damped else []), [0.9999] * k + ([0.98] if self.damped else [])

    @property
    def skip(self) -> int:
        return 2 * self.period if self.season else 2

    @property
    def affine(self) -> bool:
        return self.season != "mul"

    def _unpack(self, theta: Sequence[float]) -> tuple[float, float, float, float]:
        it = iter(theta)
        alpha = next(it)
        beta = next(it) if self.trend else 0.0
        gamma = next(it) if self.season else 0.0
        return alpha, beta, gamma, next(it) if self.damped else 1.0

    def inputs(self, y: np.ndarray, theta: Sequence[float], halo: int) -> np.ndarray:
        return y[halo:]

    def first_state(self, y: np.ndarray, theta: Sequence[float]) -> np.ndarray:
        """Level, slope and one season (that of row t at t modulo the period) from the first rows."""
        s = self.period if self.season else 0
        if not s:
            return np.array([y[0], y[1] - y[0] if self.trend and len(y) > 1 else 0.0])
        first, second = y[:s].mean(), y[s : 2 * s].mean() if len(y) >= 2 * s else y[:s].mean()
        head = np.r_[y[:s], np.full(max(0, s - len(y)), first)]
        around = head / first if self.season == "mul" and first else head - first
        return np.r_[first, (second - first) / s if self.trend else 0.0, around]

    def steps(self, inputs: np.ndarray, state: np.ndarray, theta: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        alpha, beta, gamma, phi = self._unpack(theta)
        s = self.period if self.season else 0
        if inputs.shape[1] == 1:
            return self._one(inputs[:, 0], state[:, 0], theta)
        level, slope, around = state[0], state[1], state[2:].copy()
        errors = np.empty_like(inputs)
        for t, v in enumerate(inputs):
            base = level + phi * slope
            e = v - base - around[t % s] if s else v - base
            errors[t] = e
            level = base + alpha * e
            if self.trend:
                slope = phi * slope + beta * alpha * e
            if s:
                around[t % s] += gamma * e
        return errors, np.vstack((level, slope, around))

    def _one(self, y: np.ndarray, state: np.ndarray, theta: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """One stretch in plain numbers; the multiplicative season divides."""
        alpha, beta, gamma, phi = self._unpack(theta)
        s = self.period if self.season else 0
        mul = self.season == "mul"
        level, slope, *around = state.tolist()
        errors = []
        for t, v in enumerate(y.tolist()):
            base = level + phi * slope
            if mul:
                now = around[t % s]
                errors.append(v - base * now)
                new = alpha * (v / now if now else v) + (1 - alpha) * base
                around[t % s] = gamma * (v / base if base else 1.0) + (1 - gamma) * now
            else:
                e = v - base - around[t % s] if s else v - base
                errors.append(e)
                new = base + alpha * e
                if s:
                    around[t % s] += gamma * e
            slope = phi * slope + beta * (new - base) if self.trend else 0.0
            level = new
        return np.array(errors)[:, None], np.array([level, slope, *around])[:, None]

    def ahead(self, y: np.ndarray, errors: np.ndarray, state: np.ndarray, n: int, theta: Sequence[float], steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean forecasts and variance factors, from the state after the last of ``n`` rows."""
        alpha, beta, gamma, phi = self._unpack(theta)
        level, slope, *around = state.tolist()
        out, damp, var, total = [], 0.0, [], 1.0
        s = self.period if self.season else 0
        for h in range(1, steps + 1):
            damp += phi**h
            base = level + damp * slope
            now = around[(n + h - 1) % s] if s else 0.0
            out.append(base * now if self.season == "mul" else base + now)
            var.append(total)
            c = alpha * (1 + beta * damp) + (gamma * (1 - alpha) if s and h % s == 0 else 0.0)
            total += c * c
        return np.array(out), np.array(var)


@dataclass
class Fitted:
    """Model, parameter table (keys…, series, theta, sse, m, aic, bic, mse), the series it was fitted on and their blocks."""

    model: Arima | Smoothing
    table: DataFrame
    series: DataFrame
    blocks: DataFrame
    extra: dict = field(default_factory=dict)


def _counted(model, row: dict, y: np.ndarray) -> slice:
    """The rows of a block past the model's start-up, as places among its errors."""
    return slice(max(0, model.skip - int(row["first"])), len(y) - int(row["halo"]))


def fit(series: DataFrame, model: Arima | Smoothing, rounds: int = ROUNDS, size: int | None = None) -> Fitted:
    keys = series_keys(series)
    k = len(model.start)
    low, high = (np.array(v) for v in model.limits)
    long_enough = series.where(F.col("n") >= model.skip + k + 3)
    blocks = packed(long_enough, model.skip, model.period, size)
    begin = F.array(*[F.lit(float(v)) for v in model.start])
    ends = long_enough.groupBy(*keys).agg(
        F.first("mean").alias("mean"), F.first("n").alias("n"), F.max_by("value", "idx").alias("z"), F.min_by("value", "idx").alias("a"), F.stddev_pop("value").alias("sd")
    )
    if isinstance(model, Arima) and model.has_constant:
        guess = F.col("mean") if model.lost == 0 else (F.col("z") - F.col("a")) / (F.col("n") - 1)
        begin = F.concat(F.slice(begin, 1, k - 1), F.array(guess if model.lost <= 1 else F.lit(0.0)))
    free = [isinstance(model, Arima) and model.has_constant and j == k - 1 for j in range(k)]
    scale = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    state = ends.select(*keys, begin.alias("trial"), scale.alias("scale"))
    state = state.select(*keys, "trial", "scale", F.col("trial").alias("best"), F.array().cast("array<double>").alias("stats"), F.lit(0.1).alias("lam"), F.lit(False).alias("done"))
    schema = "trial array<double>, scale double, best array<double>, stats array<double>, lam double, done boolean"
    state = cut_lineage(_screened(blocks, cut_lineage(state), model, schema))

    def shifts(row: dict) -> list[float]:
        return [1e-5 * (float(row["scale"]) if f else 1.0) for f in free]

    def variants(row: dict) -> list[np.ndarray]:
        theta = np.asarray(row["trial"], dtype=float)
        return [theta] + [theta + h * np.eye(k)[j] for j, h in enumerate(shifts(row))]

    def evaluate(row: dict, y: np.ndarray, runs) -> dict:
        """m, SSE, Σ|e|, J'e, J'J."""
        own = _counted(model, row, y)
        e = runs[0][0][own]
        jac = np.column_stack([(moved[own] - e) / h for (moved, _, _), h in zip(runs[1:], shifts(row))])
        with np.errstate(all="ignore"):
            v = np.r_[len(e), e @ e, np.abs(e).sum(), jac.T @ e, (jac.T @ jac).ravel()]
        return {"v": np.nan_to_num(v, nan=1e300, posinf=1e300, neginf=-1e300).tolist()}

    def update(row: pd.Series) -> dict:
        got = np.asarray(row["v"], dtype=float)
        old = np.asarray(row["stats"], dtype=float)
        lam = float(row["lam"])
        best = np.asarray(row["best"], dtype=float)
        trial = np.asarray(row["trial"], dtype=float)
        better = len(old) == 0 or got[1] < old[1]
        settled = len(old) > 0 and abs(got[1] - old[1]) <= 1e-9 * max(old[1], 1e-300)
        if better:
            best, old, lam = trial, got, max(lam / 5, 1e-9)
        else:
            lam = min(lam * 8, 1e9)
        grad, hess = old[3 : 3 + k], old[3 + k :].reshape(k, k)
        damp = hess + lam * np.diag(np.maximum(np.diag(hess), 1e-12))
        move = np.linalg.lstsq(damp, -grad, rcond=None)[0]
        bounded = np.isfinite(high)
        move = np.where(bounded, np.clip(move, -0.4, 0.4), move)
        nxt = np.clip(best + move, low, high)
        small = bool(np.all(np.abs(nxt - best) <= 1e-7 * (1 + np.abs(best))))
        return {"trial": nxt.tolist(), "scale": row["scale"], "best": best.tolist(), "stats": old.tolist(), "lam": lam, "done": bool(settled or small or lam >= 1e9)}

    finished = None
    for _ in range(rounds):
        live = state.where("not done")
        params = live.select(*keys, "trial", "scale")
        sums = _sum_vectors(block_runs(model, blocks, params, variants, evaluate, "v array<double>"), keys)
        state = cut_lineage(per_series(null_safe_join(live, sums, keys), update, schema, keys))
        ready = state.where("done")
        finished = ready if finished is None else finished.unionByName(ready)
        if state.where("not done").isEmpty():
            break
    finished = finished.unionByName(state.where("not done"))
    m, sse = F.col("stats")[0], F.col("stats")[1]
    sigma2 = F.greatest(sse / nz(m), F.lit(1e-300))
    loglik = -m / 2 * (F.log(F.lit(2 * math.pi) * sigma2) + 1)
    table = finished.select(
        *keys, F.col("best").alias("theta"), m.cast("long").alias("m"), sse.alias("sse"), (F.col("stats")[2] / nz(m)).alias("mae"),
        (sse / nz(m)).alias("mse"), (2.0 * (k + 1) - 2 * loglik).alias("aic"), (F.log(m) * (k + 1) - 2 * loglik).alias("bic"),
    )
    return Fitted(model, cut_lineage(table), long_enough, blocks)


def at(series: DataFrame, model: Arima | Smoothing, theta: Sequence[float], size: int | None = None) -> Fitted:
    """The model with given parameters on every series long enough for it; no search."""
    keys = series_keys(series)
    long_enough = series.where(F.col("n") > model.skip)
    blocks = packed(long_enough, model.skip, model.period, size)
    params = long_enough.select(*keys).distinct().withColumn("theta", F.array(*[F.lit(float(v)) for v in theta]))

    def squares(row: dict, y: np.ndarray, runs) -> dict:
        e = runs[0][0][_counted(model, row, y)]
        return {"v": [float(len(e)), float(e @ e), float(np.abs(e).sum())]}

    sums = _sum_vectors(block_runs(model, blocks, params, _theta, squares, "v array<double>"), keys)
    v = F.col("v")
    table = null_safe_join(params, sums, keys).select(*keys, "theta", v[0].cast("long").alias("m"), v[1].alias("sse"), (v[2] / nz(v[0])).alias("mae"), (v[1] / nz(v[0])).alias("mse"))
    return Fitted(model, cut_lineage(table), long_enough, blocks)


def _theta(row: dict) -> list[np.ndarray]:
    return [np.asarray(row["theta"], dtype=float)]


def _screened(blocks: DataFrame, state: DataFrame, model, schema: str) -> DataFrame:
    """Every series starts from the candidate with the smallest sum of squares (one pass for all)."""
    keys = [c for c in state.columns if c not in ("trial", "scale", "best", "stats", "lam", "done")]
    options = model.candidates

    def variants(row: dict) -> list[np.ndarray]:
        return [np.r_[o, np.asarray(row["trial"], dtype=float)[len(o) :]] for o in options]

    def squares(row: dict, y: np.ndarray, runs) -> dict:
        own = _counted(model, row, y)
        with np.errstate(all="ignore"):
            return {"v": np.nan_to_num([float(e[own] @ e[own]) for e, _, _ in runs], nan=1e300, posinf=1e300).tolist()}

    def choose(row: pd.Series) -> dict:
        best = variants(row)[int(np.argmin(row["v"]))].tolist()
        return {"trial": best, "scale": row["scale"], "best": best, "stats": [], "lam": 0.1, "done": False}

    sums = _sum_vectors(block_runs(model, blocks, state.select(*keys, "trial"), variants, squares, "v array<double>"), keys)
    return per_series(null_safe_join(state, sums, keys), choose, schema, keys)


def _sum_vectors(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    flat = parts.select(*keys, F.posexplode("v").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("x"))
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).withColumn("v", F.col("v.x"))


def predict(f: Fitted, steps: int = 12, alpha: float = 0.05) -> DataFrame:
    """Forecasts with intervals from the block that holds the series' last row."""
    model, keys = f.model, series_keys(f.series)
    z = tails.normal_ppf(1 - alpha / 2)

    def last_block(row: dict, y: np.ndarray, runs) -> dict | None:
        errors, start, end = runs[0]
        if row["first"] + len(errors) < row["n"]:
            return None
        known = np.r_[start, errors] if isinstance(model, Arima) else errors
        mean, var = model.ahead(y, known, end, int(row["n"]), np.asarray(row["theta"], dtype=float), steps)
        half = z * np.sqrt(float(row["mse"]) * var)
        return {"v": [[float(m), float(m - h), float(m + h)] for m, h in zip(mean, half)]}

    params = f.table.select(*keys, "theta", "mse")
    rows = block_runs(model, f.blocks, params, _theta, last_block, "v array<array<double>>")
    return rows.select(*keys, F.posexplode("v").alias("at", "x")).select(*keys, (F.col("at") + 1).alias("step"), F.col("x")[0].alias("forecast"), F.col("x")[1].alias("lower"), F.col("x")[2].alias("upper"))


def residuals(f: Fitted) -> DataFrame:
    """Rows with their one-step fit and error (null during the model's start-up)."""
    model, keys = f.model, series_keys(f.series)

    def each(row: dict, y: np.ndarray, runs) -> dict:
        return {"begin": int(row["first"]), "v": runs[0][0].tolist()}

    errors = block_runs(model, f.blocks, f.table.select(*keys, "theta"), _theta, each, "begin long, v array<double>")
    errors = errors.select(*keys, "begin", F.posexplode("v").alias("at", "e")).select(*keys, (F.col("begin") + F.col("at")).alias("idx"), "e")
    known = F.col("idx") >= model.skip
    return null_safe_join(f.series, errors, [*keys, "idx"]).select(*keys, "t", "value", "idx", F.when(known, F.col("value") - F.col("e")).alias("fitted"), F.when(known, F.col("e")).alias("resid"))


# ---- entry points ----------------------------------------------------------


def arima(series: DataFrame, steps: int = 12, order: tuple[int, int, int] = (1, 1, 1), constant: bool | None = None, alpha: float = 0.05) -> tuple[DataFrame, Fitted]:
    f = fit(series, Arima(order, constant=constant))
    return predict(f, steps, alpha), f


def _periods(series: DataFrame, period: int | None) -> list[tuple[int | None, DataFrame]]:
    """The series split by their (given or detected) period."""
    if period is not None:
        return [(period, series)]
    keys = series_keys(series)
    found = cut_lineage(seasonal_period(series).select(*keys, "period"))
    parts: list[tuple[int | None, DataFrame]] = []
    for row in found.select("period").distinct().orderBy("period").collect():
        same = found.where(F.col("period").eqNullSafe(F.lit(row[0]).cast("int"))).select(*keys)
        parts.append((row[0], series.join(same, keys, "left_semi")))
    return parts


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def sarima(series: DataFrame, steps: int = 12, order=(1, 1, 1), seasonal=(1, 1, 1), period: int | None = None, alpha: float = 0.05) -> tuple[DataFrame, list[Fitted]]:
    """Seasonal ARIMA at the detected period; series without one get the plain model."""
    outs, fits = [], []
    for p, part in _periods(series, period):
        model = Arima(order) if not p else Arima(order, seasonal, p)
        fits.append(fit(part, model))
        outs.append(predict(fits[-1], steps, alpha))
    return _union(outs), fits


def holt_winters(series: DataFrame, steps: int = 12, trend: bool = True, season: str | None = "add", period: int | None = None, damped: bool = False, alpha: float = 0.05) -> tuple[DataFrame, list[Fitted]]:
    """Level, trend and season; series without a detected period drop the season."""
    outs, fits = [], []
    for p, part in _periods(series, period if season else 0):
        model = Smoothing(trend, season if p else None, p or 0, damped and trend)
        fits.append(fit(part, model))
        outs.append(predict(fits[-1], steps, alpha))
    return _union(outs), fits


def simple_smoothing(series: DataFrame, steps: int = 12) -> tuple[DataFrame, list[Fitted]]:
    return holt_winters(series, steps, trend=False, season=None)


def double_smoothing(series: DataFrame, steps: int = 12, damped: bool = False) -> tuple[DataFrame, list[Fitted]]:
    return holt_winters(series, steps, trend=True, season=None, damped=damped)


def triple_smoothing(series: DataFrame, steps: int = 12, period: int | None = None, season: str = "add") -> tuple[DataFrame, list[Fitted]]:
    return holt_winters(series, steps, trend=True, season=season, period=period)


def stl_forecast(series: DataFrame, steps: int = 12, period: int | None = None, order=(1, 1, 0), alpha: float = 0.05) -> DataFrame:
    """ARIMA with drift on the deseasonalised values plus the last seasonal cycle; series without a period have none to add."""
    outs = []
    for p, part in _periods(series, period):
        keys = series_keys(part)
        if not p:
            outs.append(predict(fit(part, Arima(order, constant=True)), steps, alpha).select(*keys, "step", "forecast", "lower", "upper"))
            continue
        split = cut_lineage(decompose_stl(part, p))
        level = split.groupBy(*keys).agg(F.avg(F.col("value") - F.col("seasonal")).alias("mean"))
        flat = split.select(*keys, "t", (F.col("value") - F.col("seasonal")).alias("value"), "idx", "n").join(level, keys)
        f = fit(cut_lineage(flat.select(*keys, "t", "value", "idx", "n", "mean")), Arima(order, constant=True))
        ahead = predict(f, steps, alpha)
        cycle = split.where(F.col("idx") >= F.col("n") - p).select(*keys, (F.col("idx") - (F.col("n") - p)).cast("int").alias("_at"), "seasonal")
        joined = ahead.withColumn("_at", F.pmod(F.col("step") - 1, F.lit(p))).join(cycle, [*keys, "_at"])
        outs.append(joined.select(*keys, "step", *[(F.col(c) + F.col("seasonal")).alias(c) for c in ("forecast", "lower", "upper")]))
    return _union(outs)


METHODS = {"arima": arima, "sarima": sarima, "holt_winters": holt_winters, "simple": simple_smoothing, "double": double_smoothing, "triple": triple_smoothing, "stl": stl_forecast}


def forecast(series: DataFrame, method: str = "arima", steps: int = 12, **options):
    if method not in METHODS:
        raise ValueError(f"unknown forecast method {method!r}")
    return METHODS[method](series, steps, **options)


