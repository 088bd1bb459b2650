"""Feature selection: one table of (feature, score, selected) per method."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions import tails
from gaugewell.functions.columns import correlation, impute_mean, melt, num, numeric_columns, nz, quoted, unfold
from gaugewell.operators.hypothesis import anova
from gaugewell.plans.joins import join_groups
from gaugewell.plans.moments import moments
from gaugewell.plans.ordering import halo_blocks, halo_window, running, with_position
from gaugewell.plans.quantiles import wide_quantiles
from gaugewell.session import cut_lineage, gathered, held, spread

CLASS_LIMIT = 10
CELLS_PER_TASK = 1_000_000  # rows times features


def features_of(df: DataFrame, target: str | None = None, features: Sequence[str] | None = None) -> list[str]:
    return list(features) if features is not None else numeric_columns(df, [target] if target else [])


def is_classification(df: DataFrame, target: str) -> bool:
    """At most ten distinct targets (an eleventh ends the look)."""
    return df.select(quoted(target)).distinct().limit(CLASS_LIMIT + 1).count() <= CLASS_LIMIT


def _ranked(table: DataFrame, k: int) -> DataFrame:
    """Top ``k`` by score flagged; one row per feature, so the window is small."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc_nulls_last(), "feature")
    return table.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= k)


def variance_threshold(df: DataFrame, features: Sequence[str] | None = None, threshold: float = 0.0) -> DataFrame:
    cols = features_of(df, None, features)
    filled = impute_mean(df, cols)
    stats = filled.agg(*[F.var_pop(num(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("score"), (F.col(f"v{i}") > threshold).alias("selected")) for i, c in enumerate(cols)]
    return unfold(stats, rows)


def univariate_f(df: DataFrame, target: str, features: Sequence[str] | None = None, k: int = 10, task: str = "auto") -> DataFrame:
    """ANOVA F for class targets, F of the correlation otherwise."""
    cols = features_of(df, target, features)
    rows = impute_mean(df, cols).where(quoted(target).isNotNull())
    classes = is_classification(rows, target) if task == "auto" else task == "classification"
    if classes:
        long = melt(rows.withColumn("_g", quoted(target).cast("string")), cols, keep=["_g"])
        per = long.groupBy("column", "_g").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
        scores = anova(per, ["column"]).select(F.col("column").alias("feature"), F.col("statistic").alias("score"), "p_value")
    else:
        n = rows.agg(F.count(F.lit(1)).alias("n"), *[correlation(num(c), num(target)).alias(f"r{i}") for i, c in enumerate(cols)])
        dof = F.col("n") - 2.0
        cells = []
        for i, c in enumerate(cols):
            r2 = F.col(f"r{i}") * F.col(f"r{i}")
            cells.append(F.struct(F.lit(c).alias("feature"), F.when(r2 >= 1, F.lit(math.inf)).otherwise(r2 / nz(1 - r2) * dof).alias("score"), dof.alias("_d")))
        scores = unfold(n, cells).withColumn("p_value", tails.f_upper(F.col("score"), F.lit(1.0), F.col("_d"))).drop("_d")
    return _ranked(scores, k)


def quantile_bin(c: str, edges: Sequence[float]) -> Column:
    """Bin number by inner edges, upper-open; JVM-side comparisons only."""
    x = num(c)
    return sum(((x >= F.lit(float(e))).cast("int") for e in edges), F.lit(0))


def mutual_information(df: DataFrame, target: str, features: Sequence[str] | None = None, k: int = 10, bins: int = 10, task: str = "auto") -> DataFrame:
    """Binned estimator Σ p log(p / (p_x p_y)) with quantile bins (see ``knn_information`` for neighbours)."""
    cols = features_of(df, target, features)
    rows = impute_mean(df, cols).where(quoted(target).isNotNull())
    classes = is_classification(rows, target) if task == "auto" else task == "classification"
    inner = [i / bins for i in range(1, bins)]
    cuts = wide_quantiles(rows, [*cols, *([] if classes else [target])], inner)
    y = quoted(target).cast("string") if classes else quantile_bin(target, sorted(set(cuts[-1]))).cast("string")
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), quantile_bin(c, sorted(set(cuts[i]))).alias("x")) for i, c in enumerate(cols)]
    )
    joint = rows.select(y.alias("y"), F.inline(cells)).groupBy("feature", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("o"))
    over = lambda *by: Window.partitionBy(*by)
    tables = joint.withColumns({"px": F.sum("o").over(over("feature", "x")), "py": F.sum("o").over(over("feature", "y")), "n": F.sum("o").over(over("feature"))})
    gain = F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("px") * F.col("py")))
    return _ranked(tables.groupBy("feature").agg(F.greatest(F.sum(gain), F.lit(0.0)).alias("score")), k)


def digamma(n: Column) -> Column:
    """ψ of a positive number: ten steps up, then the asymptotic series."""
    z = n.cast("double") + 10.0
    q = 1.0 / (z * z)
    return F.log(z) - 0.5 / z - q * (1 / 12.0 - q * (1 / 120.0 - q * (1 / 252.0 - q / 240.0))) - sum((1.0 / (n + F.lit(float(j))) for j in range(10)), F.lit(0.0))


def knn_information(df: DataFrame, target: str, features: Sequence[str] | None = None, k: int = 10, neighbors: int = 3) -> DataFrame:
    """Nearest-neighbour mutual information of numbers with a class target (Ross 2014), features side by side.

    A row's radius is the distance to its ``neighbors``-th nearest value within
    its class (the class's last one if it is smaller); rows of any class strictly
    inside it are counted, and at radius zero the copies.  Classes of one row and
    rows without a class are left out.  Values are ordered by the order kernel,
    so neither a class nor a feature is gathered in a task.
    """
    cols = features_of(df, target, features)
    y = F.coalesce(quoted(target).cast("string"), F.lit(""))  # not null by its type either
    dealt = spread(df.select(*map(quoted, dict.fromkeys([target, *cols]))), max(1, CELLS_PER_TASK // max(1, len(cols))))
    rows = impute_mean(dealt, cols).where(quoted(target).isNotNull()).withColumn("_y", y)
    sizes = rows.groupBy("_y").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    wide = cut_lineage(join_groups(rows, sizes, ["_y"]).select("_y", "_n", *map(quoted, cols)))
    long = melt(wide, cols, keep=["_y", "_n"], name="feature", value="v")
    series = ["feature", "_y"]
    placed = halo_blocks(with_position(long, ["v"], series), "idx", neighbors, neighbors)
    w = halo_window(series)
    gaps = [F.col("v") - F.lag("v", j).over(w) for j in range(1, neighbors + 1)] + [F.lead("v", j).over(w) - F.col("v") for j in range(1, neighbors + 1)]
    k_own = F.least(F.lit(neighbors), F.col("_n") - 1).cast("int")
    near = placed.withColumn("_gaps", F.array(*gaps)).where("_core").withColumn("_k", k_own)
    radius = F.element_at(F.array_sort(F.filter("_gaps", lambda g: g.isNotNull())), F.col("_k"))
    points = cut_lineage(near.select(*series, "idx", "v", "_n", "_k", radius.alias("r")))

    # Values and both ends of every radius in one order: 0 before the values equal to it, 2 after them.
    inside = F.col("r") > 0
    event = lambda at, rank, sign: F.struct(at.alias("at"), rank.cast("int").alias("rank"), F.lit(sign).alias("sign"))
    low = event(F.col("v") - F.col("r"), F.when(inside, 2).otherwise(0), -1)
    high = event(F.col("v") + F.col("r"), F.when(inside, 0).otherwise(2), 1)
    events = points.select(*series, "idx", "_n", "_k", F.inline(F.array(event(F.col("v"), F.lit(1), 0), low, high)))
    counted = running(events, ["at", "rank"], ["feature"], sums={"seen": (F.col("rank") == 1).cast("long")})
    ends = counted.where("sign <> 0").groupBy(*series, "idx").agg(F.sum(F.col("seen") * F.col("sign")).alias("m"), F.first("_n").alias("_n"), F.first("_k").alias("_k"))
    means = ends.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.avg(digamma(F.col(c))).alias(f"p{c}") for c in ("_k", "_n", "m")])
    gain = digamma(F.col("n")) + F.col("p_k") - F.col("p_n") - F.col("pm")
    return _ranked(means.select("feature", F.greatest(gain, F.lit(0.0)).alias("score")), k)


def chi_square_score(df: DataFrame, target: str, features: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Class sums of the columns shifted above zero against their expected share."""
    cols = features_of(df, target, features)
    rows = impute_mean(df, cols).where(quoted(target).isNotNull())
    lows = rows.agg(*[F.min(num(c)) for c in cols]).first()
    shifted = rows.select(quoted(target).cast("string").alias("g"), *[(num(c) - F.lit(float(lo)) + F.lit(1e-6)).alias(c) for c, lo in zip(cols, lows)])
    per = shifted.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(quoted(c)).alias(f"s{i}") for i, c in enumerate(cols)])
    long = per.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s")) for i, c in enumerate(cols)])))
    s = long.groupBy("feature").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("s").alias("t"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))
    scored = s.select("feature", (F.col("q") * F.col("n") / nz(F.col("t")) - F.col("t")).alias("score"), (F.col("classes") - 1.0).alias("_d"))
    return _ranked(scored.withColumn("p_value", tails.chi2_upper(F.col("score"), F.col("_d"))).drop("_d"), k)


def _forest(classes: bool, trees: int, seed: int):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    kind = RandomForestClassifier if classes else RandomForestRegressor
    return kind(featuresCol="_v", labelCol="_y", numTrees=trees, seed=seed)


def _prepared(df: DataFrame, target: str, cols: Sequence[str], task: str) -> tuple[DataFrame, bool]:
    from gaugewell.operators.learn import label_encoded

    rows = impute_mean(df, cols).where(quoted(target).isNotNull())
    classes = is_classification(rows, target) if task == "auto" else task == "classification"
    labelled = label_encoded(rows, target, "_y")[0] if classes else rows.withColumn("_y", num(target))
    return labelled.select("_y", *[quoted(c) for c in cols]), classes


def _assembled(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(cols), outputCol="_v").transform(rows).select("_y", "_v")


def forest_importance(rows: DataFrame, cols: Sequence[str], classes: bool, trees: int = 100, seed: int = 42) -> np.ndarray:
    model = _forest(classes, trees, seed).fit(_assembled(rows, cols))
    return model.featureImportances.toArray()


def rfe(df: DataFrame, target: str, features: Sequence[str] | None = None, keep: int = 10, trees: int = 100, task: str = "auto", seed: int = 42) -> DataFrame:
    """Forest importances, one feature dropped per round; rank 1 = kept."""
    cols = features_of(df, target, features)
    rows, classes = _prepared(df, target, cols, task)
    left, rank = list(cols), {}
    with held(gathered(rows)) as kept:
        while len(left) > keep:
            weights = forest_importance(kept, left, classes, trees, seed)
            worst = left[int(np.argmin(weights))]
            rank[worst] = len(left) - keep + 1
            left.remove(worst)
    out = [(c, rank.get(c, 1), c in left) for c in cols]
    return df.sparkSession.createDataFrame(out, "feature string, rank int, selected boolean")


def rfecv(df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None = None, folds: int = 5, trees: int = 100, task: str = "auto", seed: int = 42) -> DataFrame:
    """RFE whose size is the one with the best mean held-out score."""
    from gaugewell.operators.learn import fold_number, score_of

    cols = features_of(df, target, features)
    tagged = df.withColumn("_fold", fold_number(key, folds, seed))
    rows, classes = _prepared(tagged, target, ["_fold", *cols], task)
    scores: dict[int, list[float]] = {}
    with held(gathered(rows)) as kept:
        for f in range(folds):
            train, test = kept.where(F.col("_fold") != f), kept.where(F.col("_fold") == f)
            left = list(cols)
            while left:
                model = _forest(classes, trees, seed).fit(_assembled(train, left))
                got = score_of(model.transform(_assembled(test, left)), "_y", "prediction", classes)
                scores.setdefault(len(left), []).append(got)
                left.remove(left[int(np.argmin(model.featureImportances.toArray()))])
    best = max(scores, key=lambda s: (float(np.mean(scores[s])), -s))
    chosen = rfe(df, target, cols, best, trees, task, seed)
    return chosen.withColumn("optimal_features", F.lit(best)).withColumn("cv_score", F.lit(float(np.mean(scores[best]))))


def select_from_forest(df: DataFrame, target: str, features: Sequence[str] | None = None, trees: int = 100, task: str = "auto", seed: int = 42) -> DataFrame:
    """Features whose importance reaches the mean importance."""
    cols = features_of(df, target, features)
    rows, classes = _prepared(df, target, cols, task)
    weights = forest_importance(rows, cols, classes, trees, seed)
    out = [(c, float(w), bool(w >= weights.mean())) for c, w in zip(cols, weights)]
    return df.sparkSession.createDataFrame(out, "feature string, score double, selected boolean")


def correlation_filter(df: DataFrame, features: Sequence[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """Of each pair over the threshold the smaller-variance column goes; score = mean |r| to the others."""
    cols = features_of(df, None, features)
    m = moments(impute_mean(df, cols), cols)
    r, var = m.corr, np.diag(m.cov_pop)
    gone = set()
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            if abs(r[i, j]) > threshold:
                gone.add(cols[j] if var[i] >= var[j] else cols[i])
    out = []
    for i, c in enumerate(cols):
        others = [abs(r[i, j]) for j in range(len(cols)) if j != i]
        out.append((c, float(np.mean(others)) if others else None, c not in gone))
    return df.sparkSession.createDataFrame(out, "feature string, score double, selected boolean")


def vif_filter(df: DataFrame, features: Sequence[str] | None = None, threshold: float = 5.0) -> DataFrame:
    """Drops the largest variance-inflation factor until all are under the threshold; one data pass."""
    cols = features_of(df, None, features)
    m = moments(impute_mean(df, cols), cols)
    left, found = list(range(len(cols))), {}
    while left:
        vif = {}
        for i in left:
            others = [j for j in left if j != i]
            if not others or m.scatter[i, i] == 0:
                vif[i] = 1.0
                continue
            a, b = m.scatter[np.ix_(others, others)], m.scatter[others, i]
            r2 = float(b @ np.linalg.pinv(a) @ b / m.scatter[i, i])
            vif[i] = math.inf if r2 >= 0.999 else 1 / (1 - r2)
        top = max(vif, key=vif.get)
        if vif[top] <= threshold:
            found.update(vif)
            break
        found[top] = vif[top]
        left.remove(top)
    out = [(c, float(found[i]), i in left) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(out, "feature string, score double, selected boolean")


SUPERVISED = {"univariate": univariate_f, "mutual_information": mutual_information, "chi_square": chi_square_score, "rfe": rfe, "rfecv": rfecv, "model": select_from_forest}
UNSUPERVISED = {"variance": variance_threshold, "correlation": correlation_filter, "vif": vif_filter}


def select_features(df: DataFrame, method: str = "univariate", target: str | None = None, **options) -> DataFrame:
    if method in UNSUPERVISED:
        return UNSUPERVISED[method](df, **options)
    if method not in SUPERVISED:
        raise ValueError(f"unknown selection method {method!r}")
    if target is None:
        raise ValueError(f"{method} needs a target column")
    return SUPERVISED[method](df, target, **options)
