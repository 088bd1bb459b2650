"""Dimension reduction: component tables and rows with their coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.columns import impute_mean, numeric_columns, quoted
from gaugewell.operators.multivar import component_table, ordered_eigen, signed
from gaugewell.operators.regress import linear_form
from gaugewell.plans.iterate import array_sum
from gaugewell.plans.moments import Moments, moments
from gaugewell.session import cut_lineage, held, spread


def _filled(df: DataFrame, columns: Sequence[str] | None, key: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    cols = list(columns) if columns is not None else numeric_columns(df, key)
    return impute_mean(df, cols), cols


def _scales(m: Moments) -> np.ndarray:
    """Population deviations; a constant column scales by one."""
    s = np.sqrt(np.diag(m.cov_pop))
    return np.where(s > 0, s, 1.0)


def _project(rows: DataFrame, cols: Sequence[str], weights: np.ndarray, centre: np.ndarray, prefix: str) -> DataFrame:
    """Adds ``prefix1…`` = (x − centre) @ weights as plain column arithmetic."""
    return rows.withColumns(
        {f"{prefix}{i + 1}": linear_form(cols, weights[:, i], -float(centre @ weights[:, i])) for i in range(weights.shape[1])}
    )


def pca(df: DataFrame, columns: Sequence[str] | None = None, components: int = 2, whiten: bool = False) -> tuple[DataFrame, DataFrame]:
    """PCA of the standardised columns."""
    rows, cols = _filled(df, columns)
    m = moments(rows, cols)
    s = _scales(m)
    cov = m.cov / np.outer(s, s)
    values, vectors = ordered_eigen(cov)
    kept = vectors[:, :components]
    w = kept / s[:, None]
    if whiten:
        w = w / np.sqrt(np.where(values[:components] > 0, values[:components], 1.0))
    table = component_table(df.sparkSession, cols, values[:components], kept, float(values.sum()))
    return table, _project(rows, cols, w, m.mean, "pc")


def factor_em(corr: np.ndarray, k: int, n: int, max_iter: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum-likelihood loadings and noise variances by EM on the covariance alone."""
    p = len(corr)
    values, vectors = ordered_eigen(corr)
    load = vectors[:, :k] * np.sqrt(np.maximum(values[:k] - values[k:].mean() if p > k else values[:k], 1e-3))
    noise = np.maximum(np.diag(corr) - (load**2).sum(axis=1), 1e-3)
    last = -math.inf
    loglik = last
    for _ in range(max_iter):
        sigma = load @ load.T + np.diag(noise)
        inv = np.linalg.inv(sigma)
        loglik = -n / 2 * (p * math.log(2 * math.pi) + np.linalg.slogdet(sigma)[1] + np.trace(inv @ corr))
        if abs(loglik - last) < tol * abs(loglik):
            break
        last = loglik
        beta = load.T @ inv
        ezz = np.eye(k) - beta @ load + beta @ corr @ beta.T
        load = corr @ beta.T @ np.linalg.inv(ezz)
        noise = np.maximum(np.diag(corr - load @ beta @ corr), 1e-9)
    return signed(load), noise, float(loglik)


def factor_analysis(df: DataFrame, columns: Sequence[str] | None = None, components: int = 2) -> tuple[DataFrame, DataFrame]:
    """Loadings per column with noise variance and log-likelihood; rows with factor scores."""
    rows, cols = _filled(df, columns)
    m = moments(rows, cols)
    s = _scales(m)
    cov = m.cov_pop / np.outer(s, s)
    load, noise, loglik = factor_em(cov, components, m.n)
    posterior = np.linalg.inv(np.eye(components) + load.T @ (load / noise[:, None])) @ load.T / noise
    table = df.sparkSession.createDataFrame(
        [(c, [float(v) for v in load[i]], float(noise[i]), loglik) for i, c in enumerate(cols)],
        "column string, loadings array<double>, noise_variance double, log_likelihood double",
    )
    return table, _project(rows, cols, posterior.T / s[:, None], m.mean, "factor")


def truncated_svd(df: DataFrame, columns: Sequence[str] | None = None, components: int = 2) -> tuple[DataFrame, DataFrame]:
    """Uncentred singular vectors from the raw moment matrix."""
    rows, cols = _filled(df, columns)
    m = moments(rows, cols)
    values, vectors = ordered_eigen(m.raw)
    kept = vectors[:, :components]
    total = float(np.trace(m.cov_pop))
    lines = []
    for i in range(components):
        var = float(kept[:, i] @ m.cov_pop @ kept[:, i])
        lines.append((i + 1, math.sqrt(values[i]), var / total if total else 0.0, {c: float(kept[j, i]) for j, c in enumerate(cols)}))
    table = df.sparkSession.createDataFrame(lines, "component int, singular_value double, explained_ratio double, loadings map<string,double>")
    return table, _project(rows, cols, kept, np.zeros(len(cols)), "svd")


def fast_ica(df: DataFrame, columns: Sequence[str] | None = None, components: int = 2, max_iter: int = 200, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Symmetric fixed-point ICA (log-cosh), each step one sum over all rows."""
    rows, cols = _filled(df, columns)
    m = moments(rows, cols)
    s = _scales(m)
    values, vectors = ordered_eigen(m.cov_pop / np.outer(s, s))
    k = components
    white = vectors[:, :k] / np.sqrt(values[:k])
    names = [f"_w{i}" for i in range(k)]
    flat = _project(rows, cols, white / s[:, None], m.mean, "_z").select(*[F.col(f"_z{i + 1}").alias(n) for i, n in enumerate(names)])
    w = np.eye(k)

    def decorrelate(a: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(a)
        return u @ v

    with held(spread(flat)) as kept:
        for _ in range(max_iter):
            current = w.copy()

            def step(z: np.ndarray) -> np.ndarray:
                g = np.tanh(z @ current.T)
                return np.r_[(g.T @ z).ravel(), (1 - g * g).sum(axis=0)]

            got = array_sum(kept, names, step, k * k + k) / m.n
            new = decorrelate(got[: k * k].reshape(k, k) - got[k * k :, None] * w)
            change = float(np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1)))
            w = new
            if change < tol:
                break
    unmix = signed((white / s[:, None]) @ w.T)
    table = df.sparkSession.createDataFrame(
        [(i + 1, {c: float(unmix[j, i]) for j, c in enumerate(cols)}) for i in range(k)], "component int, unmixing map<string,double>"
    )
    return table, _project(rows, cols, unmix, m.mean, "ic")


def landmarks_of(rows: DataFrame, cols: Sequence[str], key: Sequence[str], count: int, seed: int) -> np.ndarray:
    """``count`` rows picked by a hash of the key (a bounded set for the driver)."""
    h = F.xxhash64(*[quoted(k) for k in key], F.lit(seed))
    picked = rows.select(h.alias("_h"), *[quoted(c) for c in cols]).orderBy("_h").limit(count).select(*cols).collect()
    return np.array([[float(v) for v in r] for r in picked])


def classical_placement(distances_sq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Landmark matrix of squared distances → (projection, column means) for row placement."""
    n = len(distances_sq)
    centre = np.eye(n) - 1.0 / n
    values, vectors = ordered_eigen(-0.5 * centre @ distances_sq @ centre)
    scale = np.sqrt(np.where(values[:k] > 1e-12, values[:k], 1.0))
    return vectors[:, :k] / scale, distances_sq.mean(axis=0)


def mds(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, components: int = 2, landmarks: int = 200, seed: int = 42) -> DataFrame:
    """Landmark MDS: every row is placed from its distances to a bounded landmark set.

    Equals classical scaling when the landmarks are all rows.
    """
    rows, cols = _filled(df, columns, key)
    marks = landmarks_of(rows, cols, key, landmarks, seed)
    between = ((marks[:, None, :] - marks[None, :, :]) ** 2).sum(axis=2)
    proj, mean = classical_placement(between, components)

    def place(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            d2 = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ marks.T + (marks**2).sum(axis=1), 0.0)
            y = -0.5 * (d2 - mean) @ proj
            out = pdf[list(key)].copy()
            for i in range(components):
                out[f"dim{i + 1}"] = y[:, i]
            yield out

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in key] + [f"dim{i + 1} double" for i in range(components)])
    return rows.select(*[quoted(c) for c in [*key, *cols]]).mapInPandas(place, schema)


def nmf_weights(x: np.ndarray, h: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative row weights for a fixed basis, by multiplicative updates."""
    hh = h @ h.T
    w = np.full((len(x), len(h)), x.mean() / max(h.mean() * len(h), 1e-12))
    top = x @ h.T
    for _ in range(steps):
        w *= top / np.maximum(w @ hh, 1e-12)
    return w


def nmf(df: DataFrame, columns: Sequence[str] | None = None, components: int = 2, max_iter: int = 30, tol: float = 1e-5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Alternating updates: row weights follow from the broadcast basis, so only k×p sums travel."""
    rows, cols = _filled(df, columns)
    low = min(rows.agg(*[F.min(quoted(c)) for c in cols]).first())
    shift = -float(low) + 1e-6 if low < 0 else 0.0
    shifted = rows.withColumns({c: quoted(c) + F.lit(shift) for c in cols}) if shift else rows
    n, p, k = rows.count(), len(cols), components
    means = np.array(shifted.agg(*[F.avg(quoted(c)) for c in cols]).first(), dtype=float)
    h = np.random.default_rng(seed).uniform(0.5, 1.5, (k, p)) * means
    error = last = math.inf
    with held(spread(shifted.select(*[quoted(c) for c in cols]))) as kept:
        for _ in range(max_iter):
            basis = h.copy()

            def step(x: np.ndarray) -> np.ndarray:
                w = nmf_weights(x, basis)
                e = x - w @ basis
                return np.r_[(w.T @ w).ravel(), (w.T @ x).ravel(), (e * e).sum()]

            got = array_sum(kept, cols, step, k * k + k * p + 1)
            ww, wx, error = got[: k * k].reshape(k, k), got[k * k : -1].reshape(k, p), math.sqrt(got[-1] / max(n, 1))
            for _ in range(50):
                h *= wx / np.maximum(ww @ h, 1e-12)
            if abs(last - error) < tol * max(error, 1e-12):
                break
            last = error
    basis = h.copy()

    def weigh(batches):
        for pdf in batches:
            w = nmf_weights(pdf[cols].to_numpy(dtype=float), basis)
            out = pdf.copy()
            for i in range(k):
                out[f"nmf{i + 1}"] = w[:, i]
            yield out

    schema = ", ".join([f"`{c}` {t}" for c, t in shifted.dtypes] + [f"nmf{i + 1} double" for i in range(k)])
    table = df.sparkSession.createDataFrame(
        [(i + 1, error, {c: float(h[i, j]) for j, c in enumerate(cols)}) for i in range(k)], "component int, rmse double, basis map<string,double>"
    )
    return table, shifted.mapInPandas(weigh, schema)


def lda_topics(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, topics: int = 2, max_iter: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Topic mixture of the columns read as rounded absolute counts; perplexity per run."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows, cols = _filled(df, columns, key)
    counts = rows.select(*[quoted(k) for k in key], *[F.round(F.abs(quoted(c))).alias(c) for c in cols])
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(counts)
    model = LDA(k=topics, maxIter=max_iter, seed=seed, optimizer="online").fit(vec)
    weights = model.topicsMatrix().toArray()
    quality = (float(model.logLikelihood(vec)), float(model.logPerplexity(vec)))
    table = df.sparkSession.createDataFrame(
        [(i + 1, *quality, {c: float(weights[j, i]) for j, c in enumerate(cols)}) for i in range(topics)],
        "topic int, log_likelihood double, log_perplexity double, weights map<string,double>",
    )
    scored = model.transform(vec).select(*[quoted(k) for k in key], vector_to_array("topicDistribution").alias("topics"))
    return table, scored


def isomap(df: DataFrame, key: str, columns: Sequence[str] | None = None, components: int = 2, k: int = 20, landmarks: int = 30, max_hops: int | None = None, seed: int = 42) -> DataFrame:
    """Landmark Isomap: kNN graph, geodesics from the landmarks by relaxation joins, then placement.

    Relaxation goes on until no distance changes; a given ``max_hops`` that does
    not suffice is an error.  Rows in another component of the neighbour graph
    than a landmark have no distance to it and get null coordinates.
    """
    from gaugewell.plans.neighbors import point_links

    rows, cols = _filled(df, columns, [key])
    near = point_links(rows, key, cols, k)
    one_way = near.select(F.col("key").alias("a"), F.col("neighbor").alias("b"), "distance")
    edges = cut_lineage(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).groupBy("a", "b").agg(F.min("distance").alias("w")))
    h = F.xxhash64(quoted(key), F.lit(seed))
    marks = [r[0] for r in rows.select(quoted(key), h.alias("_h")).orderBy("_h", quoted(key)).limit(landmarks).collect()]
    marks = list(dict.fromkeys(marks))
    spark = df.sparkSession
    kind = dict(rows.dtypes)[key]
    names = [f"d{i}" for i in range(len(marks))]  # a node's distances side by side: an edge is one row for all landmarks
    dist = spark.createDataFrame([(m, *[0.0 if j == i else None for j in range(len(marks))]) for i, m in enumerate(marks)], ", ".join([f"node {kind}", *[f"{c} double" for c in names]]))
    reached = (0, 0.0)
    hops = 0
    known = [F.sum(F.when(F.col(c).isNotNull(), 1).otherwise(0)) for c in names]
    while True:
        if max_hops is not None and hops >= max_hops:
            raise RuntimeError(f"distances did not settle within {max_hops} hops")
        hops += 1
        steps = dist.join(edges, dist["node"] == edges["a"]).groupBy("b").agg(*[F.min(F.col(c) + F.col("w")).alias(f"_{c}") for c in names])
        both = dist.join(steps, dist["node"] == steps["b"], "full")
        dist = cut_lineage(both.select(F.coalesce("node", "b").alias("node"), *[F.least(c, f"_{c}").alias(c) for c in names]))
        found = dist.agg(*known, *[F.sum(c) for c in names]).first()
        count, total = sum(v or 0 for v in found[: len(names)]), math.fsum(v or 0.0 for v in found[len(names) :])
        if count == reached[0] and abs(total - reached[1]) <= 1e-12 * max(1.0, abs(total)):
            break
        reached = (count, total)
    full = dist.select("node", F.array(*names).alias("d")).where(~F.exists("d", lambda v: v.isNull()))
    at = {r["node"]: r["d"] for r in full.where(F.col("node").isin(marks)).collect()}
    used = [i for i, m in enumerate(marks) if m in at]
    between = np.array([[at[marks[i]][j] for j in used] for i in used]) ** 2
    proj, mean = classical_placement((between + between.T) / 2, components)

    @F.pandas_udf("array<double>")
    def place(d: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(v, dtype=float)[used] for v in d]) ** 2 if len(d) else np.zeros((0, len(used)))
        return pd.Series(list(-0.5 * (m - mean) @ proj))

    placed = full.select(F.col("node").alias(key), place("d").alias("_y"))
    return rows.select(quoted(key)).join(placed, key, "left").select(key, *[F.col("_y")[i].alias(f"dim{i + 1}") for i in range(components)])


SCALED = ("pca", "factor_analysis", "ica")
METHODS = {"pca": pca, "factor_analysis": factor_analysis, "svd": truncated_svd, "ica": fast_ica, "mds": mds, "isomap": isomap, "nmf": nmf, "lda": lda_topics}


def reduce_dimensions(df: DataFrame, method: str = "pca", **options):
    """Dispatch; PCA, factor analysis and ICA standardise the columns first, the others take them as they are."""
    if method not in METHODS:
        raise ValueError(f"unknown reduction method {method!r}")
    return METHODS[method](df, **options)
