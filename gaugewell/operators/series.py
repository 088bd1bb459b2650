"""Time-series tests, trend, seasonality and decomposition over many series at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions import tails
from gaugewell.functions.columns import correlation, nz
from gaugewell.plans.blocks import block_apply, block_sums, longest, per_series, series_info, series_keys, to_series
from gaugewell.plans.ordering import halo_blocks, halo_window
from gaugewell.plans.quantiles import group_quantiles
from gaugewell.session import cut_lineage

# MacKinnon's 1994 response surface (constant, one series) and 2010 critical values.
ADF_BOUNDS = (-18.83, -1.61, 2.74)  # smallest, switch, largest statistic
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# Kwiatkowski et al. 1992, level stationarity.
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)
CORE_LAGS = 12
SEASON_LAGS = (7, 30, 365)
SEASON_CUT = 0.3
ALPHA = 0.05


# ---- unit-root tests -------------------------------------------------------


def adf_p_value(stat: float) -> float:
    low, switch, high = ADF_BOUNDS
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    coef = ADF_SMALL_P if stat <= switch else ADF_LARGE_P
    return tails.normal_sf(-sum(c * stat**i for i, c in enumerate(coef)))


def adf_critical(nobs: int) -> dict[str, float]:
    return {k: sum(c / nobs**i for i, c in enumerate(v)) for k, v in ADF_CRITICAL.items()}


def _lag_rows(y: np.ndarray, ts: np.ndarray, k: int) -> np.ndarray:
    """Rows (Δy_t, 1, y_{t−1}, Δy_{t−1}, …, Δy_{t−k}) for positions ts of y."""
    dy = lambda j: y[ts - j] - y[ts - j - 1]
    return np.column_stack([dy(0), np.ones(len(ts)), y[ts - 1], *[dy(j) for j in range(1, k + 1)]])


def _adf_solve(gram: np.ndarray, lags: int) -> tuple[float, float, float, int]:
    """(AIC, t of the level term, coefficient, observations) of the regression on ``lags`` differences."""
    use = [1, 2, *range(3, 3 + lags)]
    nobs = int(round(gram[1, 1]))
    a, b = gram[np.ix_(use, use)], gram[use, 0]
    inv = np.linalg.pinv(a)
    w = inv @ b
    sse = max(float(gram[0, 0] - b @ w), 0.0)
    p = len(use)
    if nobs <= p:
        return math.inf, math.nan, math.nan, nobs
    se = math.sqrt(max(sse / (nobs - p) * inv[1, 1], 0.0))
    loglik = -nobs / 2 * (math.log(2 * math.pi) + math.log(max(sse / nobs, 1e-300)) + 1)
    return -2 * loglik + 2 * p, float(w[1]) / se if se else math.nan, float(w[1]), nobs


def adf(series: DataFrame, max_lag: int | None = CORE_LAGS) -> DataFrame:
    """Augmented Dickey–Fuller with a constant; lags by AIC up to ``max_lag`` (None: Schwert's rule).

    One pass sums the moment matrix for the largest lag; the few rows at the
    head that smaller lag orders add come along as a short array.
    """
    keys = series_keys(series)
    schwert = lambda n: int(math.ceil(12.0 * (n / 100.0) ** 0.25))
    top = max_lag if max_lag is not None else schwert(longest(series))

    def partial(rows: pd.DataFrame, first: int, last: int) -> np.ndarray:
        y = rows["value"].to_numpy(dtype=float) - rows["mean"].iloc[0]
        ts = np.arange(first, last)
        ts = ts[rows["idx"].to_numpy()[ts] >= top + 1]
        m = _lag_rows(y, ts, top)
        return (m.T @ m).ravel()

    grams = block_sums(series, top + 1, 0, partial)
    head = series.where(F.col("idx") <= top).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("h"), F.first("n").alias("n"), F.first("mean").alias("mean")
    )
    table = grams.join(head.withColumn("h", F.col("h.value")), keys)

    def solve(row: pd.Series) -> dict:
        n = int(row["n"])
        own = max_lag if max_lag is not None else schwert(n)
        own = max(0, min(own, top, n // 2 - 2))
        y = np.asarray(row["h"], dtype=float) - row["mean"]
        tail = np.asarray(row["v"], dtype=float).reshape(top + 3, top + 3)

        def gram(lags: int) -> np.ndarray:
            ts = np.arange(lags + 1, min(top + 1, n))
            out = tail[: lags + 3, : lags + 3].copy()
            if len(ts):
                m = _lag_rows(y, ts, lags)
                out += m.T @ m
            return out

        widest = gram(own)
        best = min(range(own + 1), key=lambda k: (_adf_solve(widest[: k + 3, : k + 3], k)[0], k))
        aic, t, _, nobs = _adf_solve(gram(best), best)
        if not t == t:
            return {"statistic": None, "p_value": None, "used_lag": best, "nobs": nobs, "is_stationary": None, **dict.fromkeys(("critical_1", "critical_5", "critical_10"))}
        p = adf_p_value(t)
        crit = adf_critical(nobs)
        return {
            "statistic": t, "p_value": p, "used_lag": best, "nobs": nobs, "is_stationary": bool(p < ALPHA),
            "critical_1": crit["1%"], "critical_5": crit["5%"], "critical_10": crit["10%"],
        }

    schema = "statistic double, p_value double, used_lag int, nobs long, is_stationary boolean, critical_1 double, critical_5 double, critical_10 double"
    return per_series(table, solve, schema, keys)


def kpss_p_value(stat: float) -> float:
    return float(np.interp(stat, KPSS_CRITICAL, KPSS_P))


def _autocovariances(series: DataFrame, lags: int) -> DataFrame:
    """v[l] = Σ e_t e_{t−l} for l = 0…lags, e centred by the series mean."""

    def partial(rows: pd.DataFrame, first: int, last: int) -> np.ndarray:
        e = rows["value"].to_numpy(dtype=float) - rows["mean"].iloc[0]
        out = np.zeros(lags + 1)
        for lag in range(lags + 1):
            start = max(first, lag)
            if start < last:
                out[lag] = e[start:last] @ e[start - lag : last - lag]
        return out

    return block_sums(series, lags, 0, partial)


def kpss(series: DataFrame, lags: int | None = CORE_LAGS) -> DataFrame:
    """Level stationarity; Bartlett long-run variance with ``lags`` (None: Hobijn et al.'s choice).

    Partial sums run inside blocks; the offset of a block enters its sum of
    squares in closed form, so no series-wide window is needed.
    """
    keys = series_keys(series)

    def partial(rows: pd.DataFrame, first: int, last: int) -> pd.DataFrame:
        e = rows["value"].to_numpy(dtype=float)[first:last] - rows["mean"].iloc[0]
        c = np.cumsum(e)
        return pd.DataFrame({"b": [int(rows["_block"].iloc[0])], "m": [float(len(e))], "s": [float(e.sum())], "c1": [float(c.sum())], "c2": [float(c @ c)]})

    parts = block_apply(series, 0, 0, partial, "b long, m double, s double, c1 double, c2 double")
    before = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("s").over(before), F.lit(0.0))
    squares = parts.withColumn("o", offset).groupBy(*keys).agg(F.sum(F.col("m") * F.col("o") * F.col("o") + 2 * F.col("o") * F.col("c1") + F.col("c2")).alias("eta"))
    n_max = longest(series)
    info = series_info(series)

    def auto(n: int, v: np.ndarray) -> int:
        reach = int(n ** (2.0 / 9.0))
        s0, s1 = v[0] / n, 0.0
        for i in range(1, reach + 1):
            prod = 2.0 * v[i] / n
            s0 += prod
            s1 += i * prod
        gamma = 1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0) if s0 else 0.0
        return min(int(gamma * n ** (1.0 / 3.0)), n - 1)

    if lags is None:
        reach = int(n_max ** (2.0 / 9.0)) if n_max else 0
        first = _autocovariances(series, max(reach, 1)).join(info, keys)
        chosen = per_series(first, lambda r: {"lag": auto(int(r["n"]), np.asarray(r["v"]))}, "lag int", keys)
        chosen = cut_lineage(chosen)
        deepest = int(chosen.agg(F.max("lag")).first()[0] or 0)
    else:
        chosen = info.select(*keys, F.least(F.lit(lags).cast("long"), F.col("n") - 1).cast("int").alias("lag"))
        deepest = lags
    table = squares.join(_autocovariances(series, deepest), keys).join(info.select(*keys, "n"), keys).join(chosen, keys)

    def solve(row: pd.Series) -> dict:
        n, lag, v = int(row["n"]), int(row["lag"]), np.asarray(row["v"], dtype=float)
        s2 = (v[0] + 2 * sum((1 - i / (lag + 1)) * v[i] for i in range(1, lag + 1))) / n
        stat = row["eta"] / n**2 / s2 if s2 > 0 else None
        p = kpss_p_value(stat) if stat is not None else None
        return {"statistic": stat, "p_value": p, "lags": lag, "is_stationary": None if p is None else bool(p > ALPHA)}

    return per_series(table, solve, "statistic double, p_value double, lags int, is_stationary boolean", keys)


def stationarity(series: DataFrame, library_defaults: bool = False) -> DataFrame:
    """ADF and KPSS side by side; the verdict is what both say, or the only one that ran."""
    keys = series_keys(series)
    a = adf(series, None if library_defaults else CORE_LAGS)
    k = kpss(series, None if library_defaults else CORE_LAGS)
    both = a.select(*keys, F.col("statistic").alias("adf_statistic"), F.col("p_value").alias("adf_p_value"), "used_lag", F.col("is_stationary").alias("adf_stationary")).join(
        k.select(*keys, F.col("statistic").alias("kpss_statistic"), F.col("p_value").alias("kpss_p_value"), "lags", F.col("is_stationary").alias("kpss_stationary")), keys, "full"
    )
    x, y = F.col("adf_stationary"), F.col("kpss_stationary")
    return both.withColumn("is_stationary", F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x & y))


# ---- trend -----------------------------------------------------------------


def linear_trend(series: DataFrame) -> DataFrame:
    """OLS of the value on the position, per series."""
    keys = series_keys(series)
    y, x = F.col("value"), F.col("idx").cast("double")
    s = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r_squared"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"),
    )
    dof = (F.col("n") - 2).cast("double")
    rest = F.greatest(F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"), F.lit(0.0))
    se = F.sqrt(rest / nz(dof) / nz(F.col("_sxx")))
    t = F.when(F.col("std_err") > 0, F.col("slope") / F.col("std_err"))
    p = tails.t_two_sided(F.col("_t"), dof)
    return (
        s.withColumn("std_err", se)
        .withColumn("_t", t)
        .withColumn("p_value", F.coalesce(p, F.when(F.col("slope") != 0, 0.0).otherwise(1.0)))
        .withColumn("direction", F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("flat"))
        .withColumn("significant", F.col("p_value") < ALPHA)
        .drop("_sxx", "_syy", "_t")
    )


def trend_direction(slope: Column) -> Column:
    return F.when(F.abs(slope) < 1e-6, "none").when(slope > 0, "up").otherwise("down")


def fitted_trend(series: DataFrame) -> DataFrame:
    """Rows with the straight line through their series."""
    keys = series_keys(series)
    line = linear_trend(series).select(*keys, "slope", "intercept")
    return series.join(line, keys).withColumn("trend", F.col("intercept") + F.col("slope") * F.col("idx"))


def moving_average(series: DataFrame, window: int | None = None) -> DataFrame:
    """Centred mean (an even window reaches one row further back); edges stay null.

    ``window=None`` takes min(n // 4, 12) per series.
    """
    keys = series_keys(series)
    widths = [window] if window else list(range(1, 13))
    back, ahead = max(w // 2 for w in widths), max((w - 1) // 2 for w in widths)
    blocks = halo_blocks(series, "idx", back, ahead)
    base = halo_window(keys)
    own = F.lit(window) if window else F.least(F.floor(F.col("n") / 4), F.lit(12)).cast("int")
    trend = F.lit(None).cast("double")
    for w in widths:
        frame = base.rowsBetween(-(w // 2), (w - 1) // 2)
        mean = F.when(F.count("value").over(frame) == w, F.avg("value").over(frame))
        trend = F.when(own == w, mean).otherwise(trend)
    return blocks.withColumn("trend", trend).where("_core").drop("_block", "_core")


def trend_slope(smoothed: DataFrame) -> DataFrame:
    """Slope of a smoothed trend over its non-null positions, with the direction word."""
    keys = series_keys(smoothed)
    have = F.col("trend").isNotNull()
    s = smoothed.groupBy(*keys).agg(
        F.count(F.when(have, 1)).alias("points"), F.regr_slope("trend", F.when(have, F.col("idx").cast("double"))).alias("slope")
    )
    slope = F.when(F.col("points") > 2, F.col("slope")).otherwise(0.0)
    return s.withColumn("slope", slope).withColumn("direction", trend_direction(F.col("slope")))


# ---- seasonality -----------------------------------------------------------


def lag_correlations(series: DataFrame, lags: Sequence[int]) -> DataFrame:
    """(keys…, series, lag, autocorrelation, n): correlation of the values with themselves ``lag`` rows back."""
    keys = series_keys(series)
    blocks = halo_blocks(series, "idx", max(lags), 0)
    w = halo_window(keys)
    lagged = blocks.withColumns({f"l{k}": F.lag("value", k).over(w) for k in lags}).where("_core")
    s = lagged.groupBy(*keys).agg(F.first("n").alias("n"), *[correlation(F.col("value"), F.col(f"l{k}")).alias(f"c{k}") for k in lags])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("autocorrelation")) for k in lags])
    return s.select(*keys, "n", F.inline(cells))


def seasonality_flags(series: DataFrame) -> DataFrame:
    """Lags 7, 30 and 365 where the series is long enough; seasonal over 0.3 in size."""
    table = lag_correlations(series, SEASON_LAGS)
    lag, n = F.col("lag"), F.col("n")
    long_enough = (n >= 24) & (n >= 2 * lag) & ((lag == 7) | (n >= lag))
    return table.where(long_enough).withColumn("is_seasonal", F.coalesce(F.abs("autocorrelation") > SEASON_CUT, F.lit(False)))


def _pair_sums(series: DataFrame, lags: int) -> DataFrame:
    """Per lag: count, Σx, Σy, Σxx, Σyy, Σxy of (value, value lag rows back), centred by the mean."""

    def partial(rows: pd.DataFrame, first: int, last: int) -> np.ndarray:
        e = rows["value"].to_numpy(dtype=float) - rows["mean"].iloc[0]
        out = np.zeros((lags + 1, 6))
        for lag in range(1, lags + 1):
            start = max(first, lag)
            if start < last:
                x, y = e[start:last], e[start - lag : last - lag]
                out[lag] = (len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y)
        return out.ravel()

    return block_sums(series, lags, 0, partial)


def _correlation(s: np.ndarray) -> float:
    n, sx, sy, sxx, syy, sxy = s
    if n < 2:
        return math.nan
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return (sxy - sx * sy / n) / math.sqrt(vx * vy) if vx > 0 and vy > 0 else math.nan


def seasonal_period(series: DataFrame, max_period: int | None = None) -> DataFrame:
    """Lag with the largest absolute autocorrelation, if over 0.3; null otherwise."""
    keys = series_keys(series)
    cap = max_period or 365
    top = max(2, min(cap, longest(series) // 2))
    table = _pair_sums(series, top).join(series_info(series), keys)

    def solve(row: pd.Series) -> dict:
        n = int(row["n"])
        v = np.asarray(row["v"], dtype=float).reshape(-1, 6)
        best, size = None, 0.0
        limit = min(min(cap, n // 2) + 1, n // 2)
        if n >= 20:
            for lag in range(2, limit):
                c = abs(_correlation(v[lag]))
                if c == c and c > size:
                    best, size = lag, c
        found = best is not None and size > SEASON_CUT
        return {"n": n, "period": best if found else None, "strength": size if best is not None else None}

    return per_series(table, solve, "n long, period int, strength double", keys)


def acf(series: DataFrame, lags: int = 40) -> DataFrame:
    """Autocorrelation (Σ e_t e_{t−k} / Σ e²) and partial autocorrelation by Durbin–Levinson."""
    keys = series_keys(series)

    def solve(row: pd.Series) -> list[dict]:
        v = np.asarray(row["v"], dtype=float)
        r = v / v[0] if v[0] else np.zeros(len(v))
        pacf, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            gap = 1 - phi @ r[1:k] if k > 1 else 1.0
            a = (r[k] - (phi @ r[k - 1 : 0 : -1] if k > 1 else 0.0)) / gap if gap else 0.0
            phi = np.r_[phi - a * phi[::-1], a]
            pacf.append(float(a))
        return [{"lag": k, "acf": float(r[k]), "pacf": pacf[k]} for k in range(len(r))]

    return per_series(_autocovariances(series, lags), solve, "lag int, acf double, pacf double", keys)


# ---- decomposition ---------------------------------------------------------


def decompose_classical(series: DataFrame, period: int) -> DataFrame:
    """Additive: centred moving-average trend (ends extrapolated), phase means, residual."""
    if period < 2:
        raise ValueError("decomposition needs a period of at least 2")
    keys = series_keys(series)
    half = period // 2
    blocks = halo_blocks(series, "idx", half, half)
    w = halo_window(keys)
    full = F.count("value").over(w.rowsBetween(-half, half)) == 2 * half + 1
    if period % 2:
        mean = F.avg("value").over(w.rowsBetween(-half, half))
    else:
        inner = F.sum("value").over(w.rowsBetween(-half + 1, half - 1))
        ends = F.first("value").over(w.rowsBetween(-half, half)) + F.last("value").over(w.rowsBetween(-half, half))
        mean = (inner + ends / 2) / period
    smooth = blocks.withColumn("trend", F.when(full, mean)).where("_core").drop("_block", "_core")
    smooth = cut_lineage(smooth)
    x = F.col("idx").cast("double")
    front = F.when(F.col("idx").between(half, half + period - 1), x)
    back = F.when(F.col("idx").between(F.col("n") - half - period, F.col("n") - half - 1), x)
    lines = smooth.where(F.col("trend").isNotNull()).groupBy(*keys).agg(
        F.regr_slope("trend", front).alias("_fs"), F.regr_intercept("trend", front).alias("_fi"),
        F.regr_slope("trend", back).alias("_bs"), F.regr_intercept("trend", back).alias("_bi"),
    )
    filled = smooth.join(lines, keys).withColumn(
        "trend",
        F.coalesce("trend", F.when(F.col("idx") < half, F.col("_fi") + F.col("_fs") * x).otherwise(F.col("_bi") + F.col("_bs") * x)),
    )
    # Phase means come from the rows whose trend is filled or measured alike.
    phased = filled.withColumn("phase", (F.col("idx") % period).cast("int"))
    means = phased.groupBy(*keys, "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("_m"))
    level = means.groupBy(*keys).agg(F.avg("_m").alias("_level"))
    seasonal = means.join(level, keys).select(*keys, "phase", (F.col("_m") - F.col("_level")).alias("seasonal"))
    return (
        phased.join(seasonal, [*keys, "phase"])
        .withColumn("resid", F.col("value") - F.col("trend") - F.col("seasonal"))
        .select(*keys, "t", "value", "idx", "n", "mean", "trend", "seasonal", "resid")
    )


def loess(y: np.ndarray, q: int, at: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Local linear fit with tricube weights on equally spaced points; q nearest points per fit."""
    n = len(y)
    x = np.arange(n, dtype=float)
    at = x if at is None else at
    take = min(q, n)
    out = np.empty(len(at))
    step = max(1, 2_000_000 // max(take, 1))
    for s in range(0, len(at), step):
        p = at[s : s + step]
        left = np.clip(np.round(p).astype(int) - (take - 1) // 2, 0, n - take)
        cols = left[:, None] + np.arange(take)
        d = np.abs(cols - p[:, None])
        reach = d.max(axis=1) + (max(0, (q - n) // 2) if q > n else 0)
        reach = np.where(reach > 0, reach, 1.0)[:, None]
        u = d / reach
        w = np.where(u <= 0.001, 1.0, np.where(u >= 0.999, 0.0, (1 - u**3) ** 3))
        if weight is not None:
            w = w * weight[cols]
        total = w.sum(axis=1)
        safe = np.where(total > 0, total, 1.0)
        xm = (w * cols).sum(axis=1) / safe
        ym = (w * y[cols]).sum(axis=1) / safe
        dx = cols - xm[:, None]
        sxx = (w * dx * dx).sum(axis=1)
        slope = np.where(sxx > 1e-9 * n, (w * dx * y[cols]).sum(axis=1) / np.where(sxx > 0, sxx, 1.0), 0.0)
        out[s : s + step] = np.where(total > 0, ym + slope * (p - xm), y[np.clip(np.round(p).astype(int), 0, n - 1)])
    return out


def _mean_run(x: np.ndarray, width: int) -> np.ndarray:
    c = np.cumsum(np.r_[0.0, x])
    return (c[width:] - c[:-width]) / width


def _odd(v: float) -> int:
    k = int(math.ceil(v))
    return k if k % 2 else k + 1


def stl_windows(period: int, seasonal: int = 7, trend: int | None = None) -> tuple[int, int, int]:
    return seasonal, trend or _odd(1.5 * period / (1 - 1.5 / seasonal)), _odd(period + 1) if period % 2 == 0 else period + 2


def stl_arrays(y: np.ndarray, period: int, seasonal: int, trend: int, low: int, inner: int, outer: int) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal of one block."""
    n = len(y)
    t, s = np.zeros(n), np.zeros(n)
    rho = None
    for round_ in range(outer + 1):
        for _ in range(inner):
            d = y - t
            cycle = np.empty(n + 2 * period)
            for ph in range(min(period, n)):
                sub = d[ph::period]
                at = np.arange(-1, len(sub) + 1, dtype=float)
                cycle[ph :: period][: len(at)] = loess(sub, seasonal, at, None if rho is None else rho[ph::period])
            smooth = _mean_run(_mean_run(_mean_run(cycle, period), period), 3)
            s = cycle[period : period + n] - loess(smooth, low)
            t = loess(y - s, trend, None, rho)
        if round_ < outer:
            r = np.abs(y - t - s)
            h = 6 * np.median(r)
            rho = np.clip(1 - (r / h) ** 2, 0, None) ** 2 if h > 0 else None
            if rho is not None:
                rho = np.where(r <= 0.001 * h, 1.0, np.where(r >= 0.999 * h, 0.0, rho))
    return t, s


def decompose_stl(series: DataFrame, period: int, seasonal: int = 7, trend: int | None = None, robust: bool = False) -> DataFrame:
    """Seasonal-trend decomposition by loess on overlapping blocks.

    The overlap covers the reach of all inner loops, so block results equal the
    whole-series ones; the robust weights take their scale from the block.
    """
    if period < 2:
        raise ValueError("decomposition needs a period of at least 2")
    ns, nt, nl = stl_windows(period, seasonal, trend)
    inner, outer = (2, 15) if robust else (5, 0)
    reach = ((ns // 2 + 2) * period + period + nl + nt) * inner
    halo = math.ceil(reach / period) * period

    def split(rows: pd.DataFrame, first: int, last: int) -> pd.DataFrame:
        y = rows["value"].to_numpy(dtype=float)
        tr, se = stl_arrays(y, period, ns, nt, nl, inner, outer)
        out = rows[["t", "value", "idx", "n", "mean"]].iloc[first:last].reset_index(drop=True)
        out["trend"], out["seasonal"] = tr[first:last], se[first:last]
        out["resid"] = out["value"] - out["trend"] - out["seasonal"]
        return out

    kind = dict(series.dtypes)["t"]
    schema = f"t {kind}, value double, idx long, n long, mean double, trend double, seasonal double, resid double"
    return block_apply(series.where(F.col("n") >= 2 * period), halo, halo, split, schema)


def stl_trend(series: DataFrame, period: int | None = None) -> DataFrame:
    """Trend of the STL split for seasonal series, of the centred moving average for the others."""
    keys = series_keys(series)
    if period:
        return decompose_stl(series, period).drop("seasonal", "resid")
    found = cut_lineage(seasonal_period(series).select(*keys, "period"))
    plain = moving_average(series.join(found.where("period is null").select(*keys), keys, "left_semi"))
    out = plain
    periods = [r[0] for r in found.where("period is not null").select("period").distinct().orderBy("period").collect()]
    for p in periods:
        part = series.join(found.where(F.col("period") == p).select(*keys), keys, "left_semi")
        out = out.unionByName(decompose_stl(part, p).drop("seasonal", "resid"))
    return out


def seasonal_strength(decomposed: DataFrame) -> DataFrame:
    """Var(S)/(Var(S)+Var(R)), and whether the season grows with the level."""
    keys = series_keys(decomposed)
    s = decomposed.groupBy(*keys).agg(
        F.var_pop("seasonal").alias("_s"), F.var_pop("resid").alias("_r"), correlation(F.col("value"), F.abs("seasonal")).alias("level_correlation")
    )
    strength = F.when(F.col("_r") > 0, F.col("_s") / (F.col("_s") + F.col("_r"))).otherwise(1.0)
    kind = F.when(F.col("level_correlation") > 0.3, "multiplicative").otherwise("additive")
    return s.select(*keys, strength.alias("strength"), "level_correlation", kind.alias("seasonality"))


def anomaly_flags(decomposed: DataFrame, k: float = 3.0) -> DataFrame:
    """Rows whose residual lies more than k·MAD from the series' median residual."""
    keys = series_keys(decomposed)
    rows = decomposed.where(F.col("resid").isNotNull())
    med = group_quantiles(rows, keys, "resid", [0.5]).select(*keys, F.col("q0").alias("_med"))
    far = rows.join(med, keys).withColumn("_dev", F.abs(F.col("resid") - F.col("_med")))
    mad = group_quantiles(far, keys, "_dev", [0.5]).select(*keys, F.col("q0").alias("mad"))
    return far.join(mad, keys).withColumn("is_anomaly", F.col("_dev") > k * F.col("mad")).drop("_med", "_dev")


# ---- reports ---------------------------------------------------------------


def analyze_series(df: DataFrame, time: str, columns: Sequence[str], keys: Sequence[str] = (), tie: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Stationarity, trend and seasonality tables of the numeric columns over a time column."""
    s = to_series(df, time, columns, keys, tie)
    return {"series": s, "stationarity": stationarity(s), "trend": linear_trend(s), "seasonality": seasonality_flags(s)}


def series_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """How many series there are, and which are stationary, trending, seasonal."""
    st, tr, se = tables["stationarity"], tables["trend"], tables["seasonality"]
    names = lambda df, cond: df.where(cond).select("series").distinct().agg(F.sort_array(F.collect_set("series")).alias("names"))
    parts = [("stationary", names(st, F.col("is_stationary"))), ("trending", names(tr, F.col("significant"))), ("seasonal", names(se, F.col("is_seasonal")))]
    out = tr.agg(F.lit("analyzed").alias("kind"), F.sort_array(F.collect_set("series")).alias("names"))
    for kind, part in parts:
        out = out.unionByName(part.select(F.lit(kind).alias("kind"), "names"))
    return out.withColumn("count", F.size("names"))
