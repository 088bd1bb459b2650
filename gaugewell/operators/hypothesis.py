"""Hypothesis tests on long tables; every test also runs per group (``by``).

Statistics are aggregates over all rows; only the one-row-per-test results meet
the scalar tail functions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions import tails
from gaugewell.functions.columns import correlation, num, nz, quoted
from gaugewell.plans.concordance import concordance
from gaugewell.plans.ordering import running, with_position
from gaugewell.plans.joins import join_groups
from gaugewell.plans.quantiles import group_quantiles
from gaugewell.plans.ranks import with_rank

ALPHA = 0.05


def _values(df: DataFrame, by: Sequence[str], **named: str) -> DataFrame:
    """by… plus the named numeric columns, rows with a missing one dropped."""
    out = df.select(*[quoted(b) for b in by], *[num(c).alias(n) for n, c in named.items()])
    return out.na.drop("any", subset=list(named))


def _finish(table: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return table.withColumn("significant", F.col("p_value") < alpha)


def _join(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join on the grouping; without one, ``b`` is a global aggregate of exactly one row and is broadcast."""
    if by:
        return join_groups(a, b, list(by))
    return a.withColumn("_one", F.lit(1)).join(F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")


# ---- t tests ---------------------------------------------------------------


def t_test_one_sample(df: DataFrame, value: str, popmean: float = 0.0, by: Sequence[str] = (), alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    agg = _values(df, by, x=value).groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    dof = (F.col("n") - 1).cast("double")
    sem = F.col("std") / F.sqrt("n")
    half = tails.t_quantile(1 - alpha / 2, F.col("df")) * sem
    return _finish(
        agg.withColumn("df", dof)
        .withColumn("statistic", (F.col("mean") - popmean) / nz(sem))
        .withColumn("p_value", tails.sided(tails.t_upper(F.col("statistic"), F.col("df")), alternative))
        .withColumn("effect_size", (F.col("mean") - popmean) / nz(F.col("std")))
        .withColumn("_half", half)
        .withColumn("ci_low", F.col("mean") - F.col("_half"))
        .withColumn("ci_high", F.col("mean") + F.col("_half"))
        .drop("_half"),
        alpha,
    )


def t_test_independent(df: DataFrame, value: str, group: str, first, second, equal_var: bool = True, by: Sequence[str] = (), alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    """Student's (pooled) or Welch's test between two values of the group column."""
    g = quoted(group)
    rows = df.select(*[quoted(b) for b in by], g.alias("g"), num(value).alias("x")).where(F.col("x").isNotNull())
    a = F.when(F.col("g") == F.lit(first), F.col("x"))
    b = F.when(F.col("g") == F.lit(second), F.col("x"))
    s = rows.groupBy(*by).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"),
        F.var_samp(a).alias("var1"), F.var_samp(b).alias("var2"),
    )
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("var1"), F.col("var2")
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / nz(n1 + n2 - 2)
    if equal_var:
        se, dof = F.sqrt(pooled * (1 / nz(n1) + 1 / nz(n2))), (n1 + n2 - 2).cast("double")
    else:
        se = F.sqrt(v1 / nz(n1) + v2 / nz(n2))
        dof = F.pow(v1 / nz(n1) + v2 / nz(n2), 2) / nz(F.pow(v1 / nz(n1), 2) / nz(n1 - 1) + F.pow(v2 / nz(n2), 2) / nz(n2 - 1))
    diff = F.col("mean1") - F.col("mean2")
    return _finish(
        s.withColumn("statistic", diff / nz(se))
        .withColumn("df", dof)
        .withColumn("p_value", tails.sided(tails.t_upper(F.col("statistic"), F.col("df")), alternative))
        .withColumn("effect_size", diff / nz(F.sqrt(pooled))),
        alpha,
    )


def t_test_paired(df: DataFrame, before: str, after: str, by: Sequence[str] = (), alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    pairs = _values(df, by, a=before, b=after).withColumn("_diff", F.col("a") - F.col("b"))
    return t_test_one_sample(pairs, "_diff", 0.0, by, alternative, alpha)


# ---- rank tests ------------------------------------------------------------


def mann_whitney_u(df: DataFrame, value: str, group: str, first, second, by: Sequence[str] = (), alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    """U of the first group; tie-corrected normal p (exact up to 8 per group without ties)."""
    g = quoted(group)
    rows = df.select(*[quoted(b) for b in by], g.alias("g"), num(value).alias("x")).where(
        F.col("x").isNotNull() & F.col("g").isin(first, second)
    )
    counted = rows.groupBy(*by, "x").agg(
        F.count(F.when(F.col("g") == F.lit(first), 1)).alias("c1"), F.count(F.when(F.col("g") == F.lit(second), 1)).alias("c2")
    )
    t = (F.col("c1") + F.col("c2")).cast("double")
    ranked = running(counted, ["x"], list(by), sums={"upto": F.col("c1") + F.col("c2")})
    rank = F.col("upto") - (t - 1) / 2
    s = ranked.groupBy(*by).agg(
        F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.sum(F.col("c1") * rank).alias("r1"), F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / nz(n * (n - 1))))
    u = {"two-sided": F.greatest(F.col("statistic"), n1 * n2 - F.col("statistic")), "greater": F.col("statistic"), "less": n1 * n2 - F.col("statistic")}[alternative]
    z = (u - n1 * n2 / 2 - 0.5) / nz(sd)
    upper = tails.z_upper(F.col("_z"))
    exact = _exact_u(u, F.col("n1"), F.col("n2"))
    small = (F.col("n1") <= 8) & (F.col("n2") <= 8) & (F.col("ties") == 0)
    tail = F.when(small, exact).otherwise(upper)
    out = (
        s.withColumn("statistic", u1)
        .withColumn("_z", z)
        .withColumn("p_value", F.least(F.lit(1.0), tail * (2 if alternative == "two-sided" else 1)))
        .withColumn("effect_size", 1 - 2 * F.col("statistic") / nz(n1 * n2))
        .drop("_z", "r1", "ties")
    )
    med = group_quantiles(rows, [*by, "g"], "x", [0.5])
    sides = med.groupBy(*by).agg(
        F.max(F.when(F.col("g") == F.lit(first), F.col("q0"))).alias("median1"),
        F.max(F.when(F.col("g") == F.lit(second), F.col("q0"))).alias("median2"),
    )
    return _finish(_join(out, sides, by), alpha)


def u_tail(u: float, n1: int, n2: int) -> float:
    """P(U ≥ u) without ties, by counting arrangements."""
    n1, n2 = int(n1), int(n2)
    if n1 > 8 or n2 > 8:
        return math.nan
    ways = {(0, j): {0: 1} for j in range(n2 + 1)}
    for i in range(1, n1 + 1):
        ways[(i, 0)] = {0: 1}
        for j in range(1, n2 + 1):
            cell: dict[int, int] = {}
            for k, v in ways[(i - 1, j)].items():
                cell[k + j] = cell.get(k + j, 0) + v
            for k, v in ways[(i, j - 1)].items():
                cell[k] = cell.get(k, 0) + v
            ways[(i, j)] = cell
    dist = ways[(n1, n2)]
    return sum(v for k, v in dist.items() if k >= u) / sum(dist.values())


def _exact_u(u: Column, n1: Column, n2: Column) -> Column:
    return tails._column(u_tail, 3)(u.cast("double"), n1.cast("double"), n2.cast("double"))


def wilcoxon_tail(w: float, n: float) -> float:
    """P(W ≤ w) of the signed-rank statistic without ties, n ≤ 50."""
    n = int(n)
    if n > 50:
        return math.nan
    counts = [1] + [0] * (n * (n + 1) // 2)
    for i in range(1, n + 1):
        for k in range(len(counts) - 1, i - 1, -1):
            counts[k] += counts[k - i]
    return sum(counts[: int(math.floor(w)) + 1]) / 2.0**n


def wilcoxon_signed_rank(df: DataFrame, x: str, y: str | None = None, by: Sequence[str] = (), alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    """Zeros dropped; W = min(W+, W−) two-sided, else W+."""
    if y is None:
        rows = _values(df, by, d=x)
    else:
        rows = _values(df, by, a=x, b=y).select(*by, (F.col("a") - F.col("b")).alias("d"))
    totals = rows.groupBy(*by).agg(F.count("d").alias("n"), F.count(F.when(F.col("d") == 0, 1)).alias("zeros"))
    counted = (
        rows.where(F.col("d") != 0)
        .groupBy(*by, F.abs("d").alias("m"))
        .agg(F.count(F.when(F.col("d") > 0, 1)).alias("up"), F.count(F.when(F.col("d") < 0, 1)).alias("down"))
    )
    t = (F.col("up") + F.col("down")).cast("double")
    rank = F.col("upto") - (t - 1) / 2
    s = running(counted, ["m"], list(by), sums={"upto": F.col("up") + F.col("down")}).groupBy(*by).agg(
        F.sum(F.col("up") * rank).alias("w_plus"), F.sum(F.col("down") * rank).alias("w_minus"), F.sum(t * t * t - t).alias("ties"),
    )
    both = _join(totals, s, by)
    m = (F.col("n") - F.col("zeros")).cast("double")
    mean = m * (m + 1) / 4
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    stat = F.least("w_plus", "w_minus") if alternative == "two-sided" else F.col("w_plus")
    lower = F.least("w_plus", "w_minus") if alternative == "two-sided" else (F.col("w_minus") if alternative == "greater" else F.col("w_plus"))
    exact = tails._column(wilcoxon_tail, 2)(lower.cast("double"), m)
    normal = tails.z_upper((mean - lower) / nz(sd))
    tail = F.when((m <= 50) & (F.col("ties") == 0) & (F.col("zeros") == 0), exact).otherwise(normal)
    n = F.col("n").cast("double")
    z = (F.col("statistic") - n * (n + 1) / 4) / nz(F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return _finish(
        both.withColumn("statistic", stat)
        .withColumn("p_value", F.least(F.lit(1.0), tail * (2 if alternative == "two-sided" else 1)))
        .withColumn("effect_size", z / nz(F.sqrt(n)))
        .drop("ties"),
        alpha,
    )


def _pooled_ranks(rows: DataFrame, by: Sequence[str], value: str = "x") -> tuple[DataFrame, DataFrame]:
    """(by, g, x, c, rank) per distinct cell and (by, ties) for the pooled sample."""
    cells = rows.groupBy(*by, "g", value).agg(F.count(F.lit(1)).alias("c"))
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("t"))
    ranked = running(counted, [value], list(by), sums={"upto": F.col("t")}).withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2.0)
    t = F.col("t").cast("double")
    ties = counted.groupBy(*by).agg(F.sum(t * t * t - t).alias("ties"))
    return cells.join(ranked.select(*by, value, "rank"), [*by, value]), ties


def _grouped(df: DataFrame, value: str, group: str, by: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(b) for b in by], quoted(group).alias("g"), num(value).alias("x")).na.drop("any", subset=["g", "x"])


def kruskal_wallis(df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    rows = _grouped(df, value, group, by)
    cells, ties = _pooled_ranks(rows, by)
    per = cells.groupBy(*by, "g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    s = per.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("rr"))
    n = F.col("n").cast("double")
    h = (12 / nz(n * (n + 1)) * F.col("rr") - 3 * (n + 1)) / nz(1 - F.col("ties") / nz(n * n * n - n))
    return _finish(
        _join(s, ties, by)
        .withColumn("statistic", h)
        .withColumn("df", (F.col("k") - 1).cast("double"))
        .withColumn("p_value", tails.chi2_upper(F.col("statistic"), F.col("df")))
        .withColumn("effect_size", (F.col("statistic") - F.col("k") + 1) / nz(n - F.col("k")))
        .drop("rr", "ties"),
        alpha,
    )


def group_medians(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    rows = _grouped(df, value, group, by)
    return group_quantiles(rows, [*by, "g"], "x", [0.5]).select(*by, F.col("g").alias("group"), "n", F.col("q0").alias("median"))


# ---- normality -------------------------------------------------------------

# Coefficients of Royston's 1995 approximation.
LAST_WEIGHT = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT_WEIGHT = (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coef: Sequence[float], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coef))


def shapiro_from_sums(n: int, smm: float, smx: float, ss: float, ends: Sequence[float]) -> tuple[float, float]:
    """W and p from n, Σm², Σm·x, Σ(x−x̄)² and the two smallest and two largest values."""
    if n < 3 or not ss:
        return (1.0, 1.0) if n >= 3 else (math.nan, math.nan)
    x1, x2, y2, y1 = ends
    score = lambda i: tails.normal_ppf((i - 0.375) / (n + 0.25))
    m1, m2 = score(n), score(n - 1)
    u = 1.0 / math.sqrt(n)
    if n == 3:
        top = math.sqrt(0.5) * (y1 - x1)
    else:
        a1 = m1 / math.sqrt(smm) + u * _poly(LAST_WEIGHT, u)
        if n > 5:
            a2 = m2 / math.sqrt(smm) + u * _poly(NEXT_WEIGHT, u)
            phi = (smm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * a1**2 - 2 * a2**2)
            inner = smx - m1 * (y1 - x1) - m2 * (y2 - x2)
            top = inner / math.sqrt(phi) + a1 * (y1 - x1) + a2 * (y2 - x2)
        else:
            phi = (smm - 2 * m1**2) / (1 - 2 * a1**2)
            top = (smx - m1 * (y1 - x1)) / math.sqrt(phi) + a1 * (y1 - x1)
    w = min(1.0, top * top / ss)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    rest = math.log(max(1.0 - w, 1e-300))
    if n <= 11:
        gamma = _poly(SMALL_GAMMA, n)
        if rest >= gamma:
            return w, 0.0
        z = (-math.log(gamma - rest) - _poly(SMALL_MEAN, n)) / math.exp(_poly(SMALL_LOG_SD, n))
    else:
        u = math.log(n)
        z = (rest - _poly(LARGE_MEAN, u)) / math.exp(_poly(LARGE_LOG_SD, u))
    return w, tails.normal_sf(z)


def shapiro_wilk(df: DataFrame, value: str, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """W over all rows: expected normal scores by global position, sums per group.

    The p-value approximation is calibrated up to 5 000 rows (``calibrated``).
    """
    rows = _values(df, by, x=value)
    placed = with_position(rows, ["x"], by)
    size = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("ss"))
    both = placed.join(size, list(by)) if by else _join(placed, size, by)
    n, i = F.col("n"), F.col("idx") + 1
    scored = both.withColumn("_m", tails.z_quantile((i - 0.375) / (n + 0.25)))
    at = lambda k: F.max(F.when(F.col("idx") == k, F.col("x")))
    sums = scored.groupBy(*by).agg(
        F.first("n").alias("n"),
        F.first("ss").alias("ss"),
        F.sum(F.col("_m") * F.col("_m")).alias("smm"),
        F.sum(F.col("_m") * (F.col("x") - F.col("mean"))).alias("smx"),
        F.array(at(F.lit(0)), at(F.lit(1)), at(n - 2), at(n - 1)).alias("ends"),
    )

    @F.pandas_udf("statistic double, p_value double")
    def final(n: pd.Series, smm: pd.Series, smx: pd.Series, ss: pd.Series, ends: pd.Series) -> pd.DataFrame:
        got = [shapiro_from_sums(int(a), b, c, d, e) if a >= 3 else (None, None) for a, b, c, d, e in zip(n, smm, smx, ss, ends)]
        return pd.DataFrame(got, columns=["statistic", "p_value"], dtype="float64")

    out = sums.withColumn("_r", final("n", "smm", "smx", "ss", "ends"))
    return _finish(out.select(*by, "n", "_r.*", (F.col("n") <= 5000).alias("calibrated")), alpha)


def _shape(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return _values(df, by, x=value).groupBy(*by).agg(F.count("x").alias("n"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis"))


def jarque_bera(df: DataFrame, value: str, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    jb = F.col("n") / 6.0 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4)
    return _finish(_shape(df, value, by).withColumn("statistic", jb).withColumn("p_value", F.exp(-F.col("statistic") / 2)), alpha)


def normal_test(df: DataFrame, value: str, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """D'Agostino and Pearson's K² from n, skewness and kurtosis."""
    n = F.col("n").cast("double")
    y = F.col("skewness") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    ratio = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(ratio + F.sqrt(ratio * ratio + 1)) / F.sqrt(0.5 * F.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("kurtosis") + 3 - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denom = 1 + x * F.sqrt(2 / (a - 4))
    third = F.signum(denom) * F.cbrt((1 - 2 / a) / F.abs(denom))
    z2 = (1 - 2 / (9 * a) - third) / F.sqrt(2 / (9 * a))
    return _finish(
        _shape(df, value, by)
        .withColumn("z_skewness", F.when(F.col("n") >= 8, z1))
        .withColumn("z_kurtosis", F.when(F.col("n") >= 8, z2))
        .withColumn("statistic", F.col("z_skewness") * F.col("z_skewness") + F.col("z_kurtosis") * F.col("z_kurtosis"))
        .withColumn("p_value", F.exp(-F.col("statistic") / 2)),
        alpha,
    )


# ---- equal variances -------------------------------------------------------


def _centred(df: DataFrame, value: str, group: str, by: Sequence[str]) -> DataFrame:
    rows = _grouped(df, value, group, by)
    med = group_quantiles(rows, [*by, "g"], "x", [0.5]).select(*by, "g", "q0")
    return join_groups(rows, med, [*by, "g"]).select(*by, "g", F.abs(F.col("x") - F.col("q0")).alias("z"))


def anova(per_group: DataFrame, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """One-way F from (by…, n, mean, var) rows."""
    n, m, v = F.col("n").cast("double"), F.col("mean"), F.col("var")
    s = per_group.groupBy(*by).agg(
        F.sum(n).alias("_n"), F.count(F.lit(1)).alias("k"), F.sum(n * m).alias("_s"), F.sum(n * m * m).alias("_q"),
        F.sum((n - 1) * F.coalesce(v, F.lit(0.0))).alias("within"),
    )
    total, k = F.col("_n"), F.col("k").cast("double")
    between = F.col("_q") - F.col("_s") * F.col("_s") / nz(total)
    return _finish(
        s.withColumn("df1", k - 1)
        .withColumn("df2", total - k)
        .withColumn("statistic", (between / nz(F.col("df1"))) / nz(F.col("within") / nz(F.col("df2"))))
        .withColumn("p_value", tails.f_upper(F.col("statistic"), F.col("df1"), F.col("df2")))
        .select(*by, total.cast("long").alias("n"), "k", "statistic", "df1", "df2", "p_value"),
        alpha,
    )


def levene(df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Median-centred (Brown–Forsythe)."""
    per = _centred(df, value, group, by).groupBy(*by, "g").agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.var_samp("z").alias("var"))
    return anova(per, by, alpha)


def bartlett(df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    per = _grouped(df, value, group, by).groupBy(*by, "g").agg(F.count("x").alias("n"), F.var_samp("x").alias("v"))
    n, v = F.col("n").cast("double"), F.col("v")
    s = per.groupBy(*by).agg(
        F.sum(n).alias("_n"), F.count(F.lit(1)).alias("k"), F.sum((n - 1) * v).alias("_p"),
        F.sum((n - 1) * F.log(v)).alias("_l"), F.sum(1 / nz(n - 1)).alias("_i"),
    )
    dof, k = F.col("_n") - F.col("k"), F.col("k").cast("double")
    stat = (dof * F.log(F.col("_p") / nz(dof)) - F.col("_l")) / nz(1 + (F.col("_i") - 1 / nz(dof)) / nz(3 * (k - 1)))
    return _finish(
        s.withColumn("statistic", stat)
        .withColumn("df", k - 1)
        .withColumn("p_value", tails.chi2_upper(F.col("statistic"), F.col("df")))
        .select(*by, F.col("_n").cast("long").alias("n"), "k", "statistic", "df", "p_value"),
        alpha,
    )


def fligner(df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Normal scores of the pooled ranks of |x − group median|."""
    rows = _centred(df, value, group, by)
    cells, _ = _pooled_ranks(rows, by, "z")
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    both = cells.join(total, list(by)) if by else _join(cells, total, by)
    scored = both.withColumn("a", tails.z_quantile(0.5 + F.col("rank") / (2.0 * (F.col("n") + 1))))
    per = scored.groupBy(*by, "g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("a")).alias("sa"), F.sum(F.col("c") * F.col("a") * F.col("a")).alias("saa"))
    n = F.col("n").cast("double")
    s = per.groupBy(*by).agg(
        F.sum(n).alias("_n"), F.count(F.lit(1)).alias("k"), F.sum("sa").alias("_sa"), F.sum("saa").alias("_saa"),
        F.sum(F.col("sa") * F.col("sa") / n).alias("_b"),
    )
    between = F.col("_b") - F.col("_sa") * F.col("_sa") / nz(F.col("_n"))
    var = (F.col("_saa") - F.col("_sa") * F.col("_sa") / nz(F.col("_n"))) / nz(F.col("_n") - 1)
    return _finish(
        s.withColumn("statistic", between / nz(var))
        .withColumn("df", (F.col("k") - 1).cast("double"))
        .withColumn("p_value", tails.chi2_upper(F.col("statistic"), F.col("df")))
        .select(*by, F.col("_n").cast("long").alias("n"), "k", "statistic", "df", "p_value"),
        alpha,
    )


# ---- counts ----------------------------------------------------------------


def chi_square_fit(df: DataFrame, category: str, expected: Mapping | None = None, by: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Goodness of fit to equal counts, or to given shares per category; one that occurs without a share fits with nothing (infinite)."""
    counts = df.where(quoted(category).isNotNull()).groupBy(*by, quoted(category).alias("category")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    if expected is None:
        s = counts.groupBy(*by).agg(F.sum("o").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("o") * F.col("o")).alias("_oo"))
        stat = F.col("k") * F.col("_oo") / nz(F.col("n")) - F.col("n")
    else:
        total = float(sum(expected.values()))
        shares = F.create_map(*[x for c, w in expected.items() for x in (F.lit(c), F.lit(w / total))])
        known = counts.withColumn("w", shares[F.col("category")])
        s = known.groupBy(*by).agg(
            F.sum("o").alias("n"), F.lit(len(expected)).cast("long").alias("k"),
            F.sum(F.when(F.col("w") > 0, F.col("o") * F.col("o") / F.col("w")).otherwise(F.lit(float("inf")))).alias("_oo"),
        )
        stat = F.col("_oo") / nz(F.col("n")) - F.col("n")
    return _finish(
        s.withColumn("statistic", stat)
        .withColumn("df", (F.col("k") - 1).cast("double"))
        .withColumn("p_value", F.when(F.col("statistic") == float("inf"), 0.0).otherwise(tails.chi2_upper(F.col("statistic"), F.col("df"))))
        .select(*by, F.col("n").cast("long").alias("n"), "k", "statistic", "df", "p_value"),
        alpha,
    )


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected count of every cell that occurs.

    Margins are joined on their own key; no cell is paired with another.
    """
    cells = df.select(quoted(a).alias("a"), quoted(b).alias("b")).na.drop().groupBy("a", "b").agg(F.count(F.lit(1)).alias("observed"))
    rows = cells.groupBy("a").agg(F.sum("observed").alias("row_total"))
    cols = cells.groupBy("b").agg(F.sum("observed").alias("column_total"))
    total = _join(cells.join(rows, "a").join(cols, "b"), cells.agg(F.sum("observed").alias("n")), ())
    return total.withColumn("expected", F.col("row_total").cast("double") * F.col("column_total") / F.col("n"))


def chi_square_independence(df: DataFrame, a: str, b: str, alpha: float = ALPHA) -> DataFrame:
    """χ² over the crosstab; 2×2 tables get Yates' correction."""
    t = contingency(df, a, b)
    o, e, n = F.col("observed").cast("double"), F.col("expected"), F.col("n").cast("double")
    s = t.agg(
        F.max(n).alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"), F.sum(o * o / e).alias("_q"),
        F.max(F.abs(o - e)).alias("_d"), F.min("row_total").cast("double").alias("_r"), F.min("column_total").cast("double").alias("_c"),
    )
    gap = F.greatest(F.col("_d") - 0.5, F.lit(0.0))
    r2, c2 = n - F.col("_r"), n - F.col("_c")
    yates = gap * gap * n * n * n / nz(F.col("_r") * r2 * F.col("_c") * c2)
    dof = ((F.col("r") - 1) * (F.col("c") - 1)).cast("double")
    return _finish(
        s.withColumn("df", dof)
        .withColumn("statistic", F.when(F.col("df") == 1, yates).otherwise(F.col("_q") - n))
        .withColumn("p_value", tails.chi2_upper(F.col("statistic"), F.col("df")))
        .select(F.col("n").cast("long").alias("n"), "statistic", "df", "p_value"),
        alpha,
    )


def fisher_p(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> float:
    """Hypergeometric tail; terms are summed outward until they no longer matter."""
    n, r1, c1 = a + b + c + d, a + b, a + c
    low, high = max(0, c1 - (n - r1)), min(r1, c1)

    def log_p(k: int) -> float:
        lf = math.lgamma
        return (
            lf(r1 + 1) + lf(n - r1 + 1) + lf(c1 + 1) + lf(n - c1 + 1) - lf(n + 1)
            - lf(k + 1) - lf(r1 - k + 1) - lf(c1 - k + 1) - lf(n - r1 - c1 + k + 1)
        )

    def tail(start: int, step: int) -> float:
        total, k = 0.0, start
        while low <= k <= high:
            term = math.exp(log_p(k))
            total += term
            if term < total * 1e-17 and (k - mode) * step > 0:
                break
            k += step
        return total

    mode = max(low, min(high, (r1 + 1) * (c1 + 1) // (n + 2)))
    if alternative == "greater":
        return min(1.0, tail(a, 1) if a >= mode else 1.0 - tail(a - 1, -1))
    if alternative == "less":
        return min(1.0, tail(a, -1) if a <= mode else 1.0 - tail(a + 1, 1))
    level = log_p(a) + 1e-7
    if a == mode or log_p(mode) <= level:
        return 1.0
    side = 1 if a > mode else -1
    lo, hi = (low, mode) if side == 1 else (mode, high)
    # The far side is monotone: find where its probability drops to the observed one.
    if side == 1:
        if log_p(low) > level:
            return min(1.0, tail(a, 1))
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if log_p(mid) <= level else (lo, mid)
        return min(1.0, tail(a, 1) + tail(lo, -1))
    if log_p(high) > level:
        return min(1.0, tail(a, -1))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if log_p(mid) <= level else (mid, hi)
    return min(1.0, tail(a, -1) + tail(hi, 1))


def fisher_exact(df: DataFrame, row: Column, column: Column, alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    """2×2 table of two boolean columns: odds ratio and exact p."""
    r, c = row.cast("boolean"), column.cast("boolean")
    s = df.agg(
        F.count(F.when(r & c, 1)).alias("a"), F.count(F.when(r & ~c, 1)).alias("b"),
        F.count(F.when(~r & c, 1)).alias("c"), F.count(F.when(~r & ~c, 1)).alias("d"),
    )

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_p(*map(int, t), alternative) for t in zip(a, b, c, d)], dtype="float64")

    odds = F.when(F.col("b") * F.col("c") > 0, F.col("a").cast("double") * F.col("d") / (F.col("b").cast("double") * F.col("c")))
    return _finish(s.withColumn("statistic", odds).withColumn("p_value", tail("a", "b", "c", "d")), alpha)


# ---- correlation tests -----------------------------------------------------


def _r_test(s: DataFrame, alternative: str) -> DataFrame:
    r = F.col("statistic")
    dof = (F.col("n") - 2).cast("double")
    t = r * F.sqrt(dof / (1 - r * r))
    exact = F.when(r > 0, F.lit(0.0)).otherwise(1.0)
    upper = F.when(F.abs(r) >= 1, exact).otherwise(tails.t_upper(F.col("t"), F.col("df")))
    return s.withColumn("df", dof).withColumn("t", F.when(F.abs(r) < 1, t)).withColumn("p_value", tails.sided(upper, alternative))


def pearson_test(df: DataFrame, x: str, y: str, by: Sequence[str] = (), alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    """r, p and the Fisher-z confidence interval."""
    s = _values(df, by, a=x, b=y).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("a"), F.col("b")).alias("statistic"))
    z = F.atanh("statistic")
    half = tails.normal_ppf(1 - alpha / 2) / nz(F.sqrt(F.col("n") - 3))
    return _finish(_r_test(s, alternative).withColumn("ci_low", F.tanh(z - half)).withColumn("ci_high", F.tanh(z + half)), alpha)


def spearman_test(df: DataFrame, x: str, y: str, by: Sequence[str] = (), alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    pairs = _values(df, by, a=x, b=y)
    ranked = with_rank(with_rank(pairs, "a", "ra", by), "b", "rb", by)
    s = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("ra"), F.col("rb")).alias("statistic"))
    return _finish(_r_test(s, alternative), alpha)


def kendall_test(df: DataFrame, x: str, y: str, alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    """τ-b with the tie-corrected normal approximation."""
    k = concordance(df, x, y)
    n = k.n
    z = p = None
    if k.tau_b is not None and n > 2:
        pairs = n * (n - 1)
        var = (pairs * (2 * n + 5) - k.moments_x[2] - k.moments_y[2]) / 18
        var += 2.0 * k.ties_x * k.ties_y / pairs + k.moments_x[1] * k.moments_y[1] / (9.0 * pairs * (n - 2))
        z = k.score / math.sqrt(var)
        p = tails.one_or_two_sided(tails.normal_sf(z), alternative)
    out = df.sparkSession.createDataFrame([(n, k.tau_b, z, p)], "n bigint, statistic double, z double, p_value double")
    return _finish(out, alpha)


# ---- many tests ------------------------------------------------------------


def adjust_p_values(results: DataFrame, p: str = "p_value", alpha: float = ALPHA) -> DataFrame:
    """Bonferroni, Holm and Benjamini–Hochberg columns next to the raw p-value."""
    rows = results.where(quoted(p).isNotNull())
    m = rows.count()
    ranked = with_position(rows, [p], out="_i")
    x = num(p)
    holm = (F.lit(m) - F.col("_i")) * x
    bh = x * F.lit(float(m)) / (F.col("_i") + 1)
    done = running(ranked, ["_i"], [], maxs={"_holm": holm}, mins_ahead={"_bh": bh})
    return (
        done.withColumn("p_bonferroni", F.least(F.lit(1.0), x * F.lit(m)))
        .withColumn("p_holm", F.least(F.lit(1.0), F.col("_holm")))
        .withColumn("p_fdr_bh", F.least(F.lit(1.0), F.col("_bh")))
        .withColumn("reject_fdr_bh", F.col("p_fdr_bh") < alpha)
        .drop("_i", "_holm", "_bh")
    )
