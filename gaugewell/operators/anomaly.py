"""Row-level anomaly detection: key, label (−1 anomaly, 1 normal), score (higher is odder)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.columns import impute_mean, num, numeric_columns, quoted
from gaugewell.operators.cluster import dbscan_points
from gaugewell.operators.learn import FourierFeatures, fit_scaler, scale_gamma
from gaugewell.operators.outliers import iqr_fences
from gaugewell.operators.regress import quadratic_form
from gaugewell.plans.iterate import array_sum
from gaugewell.plans.moments import moments
from gaugewell.plans.neighbors import point_neighbors, points_of
from gaugewell.plans.quantiles import wide_quantiles
from gaugewell.session import ROWS_PER_TASK, cut_lineage, held, spread

SEED = 42
EPS = float(np.finfo(float).eps)


def prepared(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """key… and numeric columns, gaps filled by the column mean."""
    cols = list(columns) if columns is not None else numeric_columns(df, key)
    return impute_mean(df.select(*[quoted(k) for k in key], *[quoted(c) for c in cols if c not in key]), cols), cols


def _labelled(rows: DataFrame, key: Sequence[str], flag: Column, score: Column) -> DataFrame:
    return rows.select(*[quoted(k) for k in key], F.when(flag, -1).otherwise(1).alias("label"), score.alias("score"))


def _greatest(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.greatest(*parts)


def zscore_rows(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    rows, cols = prepared(df, key, columns)
    s = fit_scaler(rows, cols)
    z = _greatest([F.abs((num(c) - F.lit(m)) / F.lit(d)) for c, m, d in zip(cols, s.mean, s.std)])
    return _labelled(rows, key, z > threshold, z)


def iqr_rows(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Score: how far beyond a fence the worst column lies."""
    rows, cols = prepared(df, key, columns)
    fences = iqr_fences(rows, cols, k)
    beyond = _greatest([F.greatest(F.lit(fences[c][2]) - num(c), num(c) - F.lit(fences[c][3]), F.lit(0.0)) for c in cols])
    return _labelled(rows, key, beyond > 0, beyond)


def modified_zscore_rows(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, threshold: float = 3.5) -> DataFrame:
    """0.6745·|x − median| / MAD, the worst column."""
    rows, cols = prepared(df, key, columns)
    medians = [q[0] for q in wide_quantiles(rows, cols, [0.5])]
    mads = [q[0] for q in wide_quantiles(rows, [F.abs(num(c) - F.lit(m)) for c, m in zip(cols, medians)], [0.5])]
    z = _greatest([F.lit(0.6745) * F.abs(num(c) - F.lit(m)) / F.lit(d if d else EPS) for c, m, d in zip(cols, medians, mads)])
    return _labelled(rows, key, z > threshold, z)


def _by_threshold(scored: DataFrame, key: Sequence[str], contamination: float | None, fixed: float | None) -> DataFrame:
    """Labels the rows above the (1 − contamination) quantile of the score, or above a fixed score."""
    if contamination is None:
        cut = fixed
    else:
        # The quantile search reads the scores several times: compute them once.
        scored = cut_lineage(scored)
        cut = wide_quantiles(scored, ["score"], [1.0 - contamination])[0][0]
    return _labelled(scored, key, F.col("score") > F.lit(cut), F.col("score"))


# ---- isolation forest ------------------------------------------------------


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, split, left, right, leaf path length); feature −1 marks a leaf."""
    nodes: list = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        span = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(span) == 0:
            nodes[at] = (-1, 0.0, 0, 0, depth + average_path(len(rows)))
            return at
        f = int(rng.choice(span))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        side = rows[:, f] < cut
        left, right = grow(rows[side], depth + 1), grow(rows[~side], depth + 1)
        nodes[at] = (f, cut, left, right, 0.0)
        return at

    grow(x, 0)
    return nodes


def _tree_samples(rows: DataFrame, key: Sequence[str], trees: int, size: int, seed: int) -> DataFrame:
    """About ``size`` rows per tree, drawn for each tree independently by key hashes, so reruns draw the same rows.

    One hash says, by the binomial distribution, how many trees draw a row:
    nearly all rows of a large table stop there.  The others choose their trees
    by a hash for each.
    """
    share = min(1.0, size / max(rows.count(), 1))
    at_most, term = [], (1.0 - share) ** trees
    for k in range(trees):  # P(at most k of the trees)
        at_most.append(term + (at_most[-1] if at_most else 0.0))
        term *= (trees - k) / (k + 1) * share / (1.0 - share) if share < 1.0 else 0.0
    hashed = rows.withColumn("_h", F.xxhash64(*[quoted(k) for k in key], F.lit(seed)))
    uniform = F.pmod("_h", F.lit(1 << 52)) / float(1 << 52)
    drawn = hashed.where(uniform >= F.lit(at_most[0]))
    some = F.size(F.filter(F.array(*[F.lit(p) for p in at_most]), lambda p: p <= uniform))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64(F.col("_h"), t).alias("h"), t.alias("t"))))
    return drawn.withColumn("tree", F.explode(F.slice(order, F.lit(1), some)["t"])).drop("_h")


def fit_forest(rows: DataFrame, key: Sequence[str], cols: Sequence[str], trees: int, size: int, seed: int) -> list[np.ndarray]:
    limit = max(1, math.ceil(math.log2(max(2, size))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        ordered = pdf.sort_values(list(key))
        nodes = grow_tree(ordered[cols].to_numpy(dtype=float), np.random.default_rng([seed, t]), limit)
        out = pd.DataFrame(nodes, columns=["f", "cut", "l", "r", "len"])
        out.insert(0, "tree", t)
        out.insert(1, "node", range(len(out)))
        return out

    grown = _tree_samples(rows, key, trees, size, seed).groupBy("tree").applyInPandas(build, "tree int, node int, f int, cut double, l int, r int, len double")
    got = grown.toPandas()
    return [g.sort_values("node")[["f", "cut", "l", "r", "len"]].to_numpy(dtype=float) for _, g in got.groupby("tree")]


def forest_scores(x: np.ndarray, forest: list[np.ndarray], size: int) -> np.ndarray:
    total = np.zeros(len(x))
    seat, flat = np.arange(len(x)) * x.shape[1], np.ascontiguousarray(x).ravel()
    for t in forest:
        feature, cut, length = t[:, 0].astype(int), t[:, 1], t[:, 4]
        leaf = feature < 0
        feature, stay = np.where(leaf, 0, feature), np.arange(len(t))
        # the node after each one: left, right; a leaf leads to itself
        after = np.c_[np.where(leaf, stay, t[:, 2]), np.where(leaf, stay, t[:, 3])].astype(int).ravel()
        at = np.zeros(len(x), dtype=int)
        inner = not leaf[0]
        while inner:
            at = after[2 * at + ~(flat[seat + feature[at]] < cut[at])]
            inner = not leaf[at].all()
        total += length[at]
    return 2.0 ** (-(total / max(len(forest), 1)) / max(average_path(size), EPS))


def isolation_forest(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, contamination: float | None = 0.1, trees: int = 100, size: int = 256, seed: int = SEED) -> DataFrame:
    """Trees grow from small hash-drawn samples in parallel; the bounded forest scores all rows.

    ``contamination=None`` flags scores over 0.5.
    """
    rows, cols = prepared(df, key, columns)
    n = rows.count()
    forest = fit_forest(rows, key, cols, trees, min(size, n), seed)
    used = min(size, n)
    rows = spread(rows, ROWS_PER_TASK)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(cols)))
        return pd.Series(forest_scores(m, forest, used))

    scored = rows.select(*[quoted(k) for k in key], score(F.array(*[num(c) for c in cols])).alias("score"))
    return _by_threshold(scored, key, contamination, 0.5)


# ---- one-class SVM ---------------------------------------------------------


def one_class_svm(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, nu: float = 0.1, width: int = 100, steps: int = 40, seed: int = SEED) -> DataFrame:
    """RBF one-class SVM in Fourier features (approximate kernel), full-batch subgradient on the cluster."""
    rows, cols = prepared(df, key, columns)
    rows = spread(rows)
    lift = FourierFeatures(cols, scale_gamma(rows, cols), width, seed)
    n = rows.count()
    mean = array_sum(rows, cols, lambda x: lift.matrix(x).sum(axis=0), width) / n
    w = mean / max(float(np.linalg.norm(mean)), EPS) ** 2
    rho = 1.0
    with held(rows.select(*[quoted(c) for c in cols])) as kept:
        for t in range(1, steps + 1):
            current, level = w.copy(), rho

            def grad(x: np.ndarray) -> np.ndarray:
                z = lift.matrix(x)
                hit = z @ current < level
                return np.r_[z[hit].sum(axis=0), hit.sum()]

            g = array_sum(kept, cols, grad, width + 1) / (nu * n)
            rate = 0.5 / math.sqrt(t)
            w = w - rate * (w - g[:-1])
            rho = rho - rate * (g[-1] - 1.0)
    final = w.copy()

    @F.pandas_udf("double")
    def value(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(cols)))
        return pd.Series(-(lift.matrix(m) @ final))

    scored = rows.select(*[quoted(k) for k in key], value(F.array(*[num(c) for c in cols])).alias("score"))
    # rho is pinned to the nu quantile, its value at the optimum.
    return _by_threshold(scored, key, nu, None)


# ---- local outlier factor --------------------------------------------------


def local_outlier_factor(df: DataFrame, key: str, columns: Sequence[str] | None = None, k: int = 20, contamination: float | None = 0.1) -> DataFrame:
    """Exact neighbours by pivot tiles, then two equi-joins for reach distances and densities."""
    rows, cols = prepared(df, [key], columns)
    id_type = dict(rows.dtypes)[key]
    points = cut_lineage(points_of(rows, key, cols))
    near = cut_lineage(point_neighbors(points, k, id_type))
    kdist = near.groupBy("qid").agg(F.max("distance").alias("kd"))
    reach = near.join(kdist.select(F.col("qid").alias("pid"), "kd"), "pid").withColumn("reach", F.greatest("distance", "kd"))
    density = cut_lineage(reach.groupBy("qid").agg((1.0 / (F.sum(F.col("reach") * F.col("mult")) / F.sum("mult") + 1e-10)).alias("lrd")))
    peers = near.join(density.select(F.col("qid").alias("pid"), F.col("lrd").alias("peer")), "pid")
    mean = peers.groupBy("qid").agg((F.sum(F.col("peer") * F.col("mult")) / F.sum("mult")).alias("m"))
    lof = mean.join(density, "qid").select(F.col("qid").alias("pid"), (F.col("m") / F.col("lrd")).alias("score"))
    vec = F.array(*[num(c) for c in cols])
    scored = rows.select(quoted(key), vec.alias("vec")).join(points.select("vec", "pid"), "vec").join(lof, "pid").select(quoted(key), "score")
    return _by_threshold(scored, [key], contamination, 1.5)


# ---- elliptic envelope -----------------------------------------------------


def _distance2(cols: Sequence[str], centre: np.ndarray, matrix: np.ndarray) -> Column:
    """(x − c)' M (x − c); with many columns as one matrix product a batch."""
    if len(cols) <= 8:
        return quadratic_form(cols, centre, matrix)

    @F.pandas_udf("double")
    def product(x: pd.Series) -> pd.Series:
        e = (np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(cols)))) - centre
        return pd.Series(((e @ matrix) * e).sum(axis=1))

    return product(F.array(*[num(c) for c in cols]))


def elliptic_envelope(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, contamination: float = 0.1, support: float | None = None, max_steps: int = 30) -> DataFrame:
    """Mahalanobis² under a robust covariance from concentration steps.

    Starts from median and scaled MAD; each step keeps the ``support`` share of
    rows nearest the current centre and re-estimates, until the determinant
    stops falling.
    """
    rows, cols = prepared(df, key, columns)
    p, n = len(cols), rows.count()
    share = support or min(1.0, math.ceil((n + p + 1) / 2) / n)
    medians = [q[0] for q in wide_quantiles(rows, cols, [0.5])]
    mads = [q[0] for q in wide_quantiles(rows, [F.abs(num(c) - F.lit(m)) for c, m in zip(cols, medians)], [0.5])]
    centre = np.array(medians)
    cov = np.diag([(1.4826 * (d or 1.0)) ** 2 for d in mads])
    last = math.inf
    with held(rows.select(*[quoted(c) for c in cols])) as kept:
        for _ in range(max_steps):
            # the quantile reads the distances several times: they are computed once a step
            with held(kept.withColumn("_d2", _distance2(cols, centre, np.linalg.pinv(cov)))) as near:
                cut = wide_quantiles(near, ["_d2"], [share])[0][0]
                m = moments(near.where(F.col("_d2") <= F.lit(cut)), cols)
            centre, cov = m.mean, m.cov_pop
            det = float(np.linalg.slogdet(cov)[1])
            if not det < last - 1e-9:
                break
            last = det
    scored = rows.withColumn("score", _distance2(cols, centre, np.linalg.pinv(cov)))
    return _by_threshold(scored.select(*[quoted(k) for k in key], "score"), key, contamination, None)


# ---- density noise ---------------------------------------------------------


def dbscan_noise(df: DataFrame, key: str, columns: Sequence[str] | None = None, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Noise rows of the density clustering; score = distance to the nearest core point."""
    from gaugewell.plans.neighbors import nearest_points

    rows, cols = prepared(df, [key], columns)
    id_type = dict(rows.dtypes)[key]
    points = cut_lineage(points_of(rows, key, cols))
    marked = cut_lineage(dbscan_points(points, eps, min_samples, id_type))
    known = points.join(marked, "pid")
    cores = known.where("core").select("vec", "pid", "mult")
    noise = known.where("cluster is null").select(F.col("pid").alias("qid"), "vec", F.lit(None).cast(id_type).alias("own"))
    if cores.isEmpty():
        far = noise.select(F.col("qid").alias("pid"), F.lit(None).cast("double").alias("score"))
    else:
        far = nearest_points(noise, cores, 1, id_type).select(F.col("qid").alias("pid"), F.col("distance").alias("score"))
    scores = known.select("vec", "pid", F.when(F.col("cluster").isNull(), -1).otherwise(1).alias("label"), "core_distance").join(far, "pid", "left")
    vec = F.array(*[num(c) for c in cols])
    return (
        rows.select(quoted(key), vec.alias("vec"))
        .join(scores, "vec")
        .select(quoted(key), "label", F.coalesce("score", "core_distance").alias("score"))
    )


METHODS = {
    "zscore": zscore_rows, "iqr": iqr_rows, "modified_zscore": modified_zscore_rows, "isolation_forest": isolation_forest,
    "one_class_svm": one_class_svm, "lof": local_outlier_factor, "elliptic_envelope": elliptic_envelope, "dbscan": dbscan_noise,
}


def detect_anomalies(df: DataFrame, key, method: str = "isolation_forest", columns: Sequence[str] | None = None, **options) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown anomaly method {method!r}")
    single = method in ("lof", "dbscan")
    k = key if isinstance(key, str) == single else (key[0] if single else [key])
    return METHODS[method](df, k, columns, **options)
