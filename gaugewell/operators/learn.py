"""Supervised models and clustering runs on ``pyspark.ml`` and distributed sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.columns import num, nz, quoted
from gaugewell.operators import regress
from gaugewell.operators.select import univariate_f
from gaugewell.plans.iterate import array_sum
from gaugewell.plans.neighbors import nearest_points, points_of
from gaugewell.plans.joins import join_groups
from gaugewell.plans.ordering import with_position
from gaugewell.session import cut_lineage, gathered, held, spread

SEED = 42
CLASS_MAX = 1_000


# ---- preparation -----------------------------------------------------------


def default_features(df: DataFrame, target: str, key: Sequence[str] = ()) -> list[str]:
    kinds = (T.LongType, T.DoubleType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in {target, *key}]


def prepare(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """key…, features as doubles and the target, complete rows only."""
    cols = [quoted(k) for k in key] + [num(c).alias(c) for c in features] + [quoted(target)]
    return df.select(*cols).na.drop("any", subset=[*features, target])


def label_encoded(df: DataFrame, target: str, out: str = "label") -> tuple[DataFrame, list]:
    """Class numbers in sorted order (the class list is checked to stay small)."""
    classes = [r[0] for r in df.select(quoted(target)).distinct().limit(CLASS_MAX + 1).collect() if r[0] is not None]
    if len(classes) > CLASS_MAX:
        raise ValueError(f"{target} has over {CLASS_MAX} classes")
    classes.sort()
    code = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return df.withColumn(out, code[quoted(target)]), classes


def train_test(df: DataFrame, key: Sequence[str], test_share: float = 0.2, stratify: str | None = None, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: the rows with the smallest key hashes, ``test_share`` of each class."""
    tagged = df.withColumn("_h", F.xxhash64(*[quoted(k) for k in key], F.lit(seed)))
    by = [stratify] if stratify else []
    placed = with_position(tagged, ["_h", *key], by, out="_i")
    sizes = df.groupBy(*by).agg(F.round(F.count(F.lit(1)) * F.lit(test_share)).cast("long").alias("_n"))
    joined = join_groups(placed, sizes, by) if by else placed.withColumn("_n", F.lit(sizes.first()[0]))
    return joined.withColumn("is_test", F.col("_i") < F.col("_n")).drop("_h", "_i", "_n")


def fold_number(key: Sequence[str], folds: int, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(*[quoted(k) for k in key], F.lit(seed + 1)), F.lit(folds)).cast("int")


@dataclass
class Scaler:
    columns: list[str]
    mean: list[float]
    std: list[float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (num(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.mean, self.std)})


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Mean and population deviation; constant columns are only centred."""
    row = df.agg(*[F.avg(num(c)) for c in columns], *[F.stddev_pop(num(c)) for c in columns]).first()
    k = len(columns)
    return Scaler(list(columns), [float(v) for v in row[:k]], [float(v) if v else 1.0 for v in row[k:]])


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


# ---- models ----------------------------------------------------------------


class FourierFeatures:
    """Random Fourier features of the RBF kernel exp(−γ‖x − y‖²)."""

    def __init__(self, columns: Sequence[str], gamma: float, width: int = 200, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.columns = list(columns)
        self.omega = rng.normal(0.0, math.sqrt(2 * gamma), (len(columns), width))
        self.phase = rng.uniform(0.0, 2 * math.pi, width)

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return math.sqrt(2.0 / len(self.phase)) * np.cos(x @ self.omega + self.phase)

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        @F.pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            m = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(self.columns)))
            return pd.Series(list(self.matrix(m.astype(float))))

        return df.withColumn(out, array_to_vector(lift(F.array(*[num(c) for c in self.columns]))))


def scale_gamma(df: DataFrame, columns: Sequence[str]) -> float:
    """1 / (p · variance of all cells)."""
    s, ss, n = df.agg(
        sum((F.sum(num(c)) for c in columns[1:]), F.sum(num(columns[0]))),
        sum((F.sum(num(c) * num(c)) for c in columns[1:]), F.sum(num(columns[0]) * num(columns[0]))),
        F.count(F.lit(1)) * len(columns),
    ).first()
    var = ss / n - (s / n) ** 2
    return 1.0 / (len(columns) * var) if var > 0 else 1.0


#: Trees grow until their leaves are pure or Spark's limit is reached.
MAX_DEPTH = 30


def classifier(name: str, n: int, classes: int, seed: int = SEED, **options):
    """The estimator behind a model name (features in ``features``, class in ``label``)."""
    if name == "random_forest":
        return RandomForestClassifier(numTrees=options.get("trees", 100), maxDepth=options.get("max_depth", MAX_DEPTH), seed=seed)
    if name == "logistic":
        return LogisticRegression(maxIter=1000, regParam=1.0 / (max(n, 1) * options.get("c", 1.0)), standardization=False)
    if name == "naive_bayes":
        return NaiveBayes(modelType="gaussian")
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=options.get("max_depth", MAX_DEPTH), seed=seed)
    if name == "gradient_boosting":
        boost = GBTClassifier(maxIter=options.get("rounds", 100), stepSize=0.1, maxDepth=3, seed=seed)
        return boost if classes == 2 else OneVsRest(classifier=boost)
    if name == "svm":
        svc = LinearSVC(regParam=1.0 / (max(n, 1) * options.get("c", 1.0)), maxIter=options.get("max_iter", 100))
        return svc if classes == 2 else OneVsRest(classifier=svc)
    raise ValueError(f"unknown classifier {name!r}")


#: Rows times trees that one fit grows: the nodes, some for every few rows, are on the driver.
GROWN = 10_000_000


def grown_in_parts(train: DataFrame, test: DataFrame, cols: Sequence[str], n: int, trees: int, classes: int, seed: int, **options) -> tuple[DataFrame, np.ndarray]:
    """(test rows with probability and prediction, importances) of a forest whose trees are grown some at a time.

    A part's trees vote on the test rows and are given up before the next part is
    grown, so the driver never holds the whole forest.
    """
    size = max(1, GROWN // n)
    data = assemble(train, cols).select("features", "label")
    voted, weights = assemble(test, cols).withColumn("_votes", F.array_repeat(F.lit(0.0), classes)), np.zeros(len(cols))
    with held(data) as kept:
        for at in range(0, trees, size):
            est = classifier("random_forest", n, classes, seed + at, **{**options, "trees": min(size, trees - at)})
            fit = est.setCacheNodeIds(True).fit(kept)
            weights += sum(t.featureImportances.toArray() for t in fit.trees)
            more = F.zip_with("_votes", vector_to_array("rawPrediction"), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
            voted = cut_lineage(fit.transform(voted).select(*[quoted(c) for c in test.columns], "features", more.alias("_votes")))
    # ties go to the smallest class, as the forest's own prediction
    top = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
    share = F.transform("_votes", lambda v: v / F.lit(float(trees)))
    return voted.select(*[quoted(c) for c in test.columns], array_to_vector(share).alias("probability"), top.alias("prediction")), weights / (weights.sum() or 1.0)


def _kernel_rows(train: DataFrame, columns: Sequence[str], seed: int, width: int = 200) -> FourierFeatures:
    return FourierFeatures(columns, scale_gamma(train, columns), width, seed)


def epsilon_svr(train: DataFrame, columns: Sequence[str], target: str, c: float = 1.0, epsilon: float = 0.1, width: int = 100, steps: int = 60, seed: int = SEED):
    """RBF support-vector regression in Fourier features (approximate kernel).

    Full-batch subgradient steps on ½λ‖w‖² + mean ε-insensitive loss; every
    step is one vector sum over the cluster.
    """
    lift = _kernel_rows(train, columns, seed, width)
    n, mean, dev = train.agg(F.count(F.lit(1)), F.avg(num(target)), F.stddev_pop(num(target))).first()
    dev = dev or 1.0
    rows = train.select(*[num(x).alias(f"x{i}") for i, x in enumerate(columns)], ((num(target) - F.lit(mean)) / F.lit(dev)).alias("y"))
    names = [*[f"x{i}" for i in range(len(columns))], "y"]
    lam = 1.0 / (c * max(n, 1))
    w, avg = np.zeros(width + 1), np.zeros(width + 1)
    with held(spread(rows)) as kept:
        for t in range(1, steps + 1):
            current = w.copy()

            def grad(m: np.ndarray) -> np.ndarray:
                z = np.c_[lift.matrix(m[:, :-1]), np.ones(len(m))]
                e = z @ current - m[:, -1]
                return z.T @ np.where(np.abs(e) > epsilon / dev, np.sign(e), 0.0)

            g = array_sum(kept, names, grad, width + 1) / n
            g[:-1] += lam * w[:-1]
            w = w - g * (4.0 / math.sqrt(t))
            avg += (w - avg) * (2.0 / (t + 1))
    final = avg.copy()

    @F.pandas_udf("double")
    def predict(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(columns)))
        return pd.Series(np.c_[lift.matrix(m), np.ones(len(m))] @ final * dev + mean)

    return lambda df: df.withColumn("prediction", predict(F.array(*[num(x) for x in columns])))


def knn_predict(train: DataFrame, test: DataFrame, key: str, columns: Sequence[str], target: str, k: int = 5, classes: bool = True) -> DataFrame:
    """key → prediction from the k nearest training rows (vote, ties to the smallest class; or mean).

    Training copies collapse to one point that carries its class counts, so a
    hot vector costs one candidate.
    """
    id_type = dict(train.dtypes)[key]
    points = cut_lineage(points_of(train, key, columns))
    vec = F.array(*[num(c) for c in columns])
    tagged = train.select(vec.alias("vec"), quoted(target).alias("y")).join(points.select("vec", "pid"), "vec")
    queries = test.select(quoted(key).alias("qid"), vec.alias("vec"), F.lit(None).cast(id_type).alias("own"))
    near = nearest_points(queries, points, k, id_type).select("qid", "pid", "mult")
    if classes:
        votes = tagged.groupBy("pid", "y").agg(F.count(F.lit(1)).alias("c"))
        size = points.select("pid", F.col("mult").alias("all"))
        share = near.join(votes, "pid").join(size, "pid").withColumn("v", F.col("c") * F.col("mult") / F.col("all"))
        tally = share.groupBy("qid", "y").agg(F.sum("v").alias("v"))
        best = tally.groupBy("qid").agg(F.min(F.struct((-F.col("v")).alias("neg"), F.col("y"))).alias("b"))
        return best.select(F.col("qid").alias(key), F.col("b.y").alias("prediction"))
    value = tagged.groupBy("pid").agg(F.avg(F.col("y").cast("double")).alias("y"))
    out = near.join(value, "pid").groupBy("qid").agg((F.sum(F.col("y") * F.col("mult")) / F.sum("mult")).alias("prediction"))
    return out.select(F.col("qid").alias(key), "prediction")


# ---- metrics ---------------------------------------------------------------


def confusion(predicted: DataFrame, truth: str, prediction: str) -> DataFrame:
    return predicted.groupBy(quoted(truth).cast("string").alias("actual"), quoted(prediction).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(predicted: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Accuracy and macro precision, recall and F1 (a class never predicted scores zero)."""
    c = confusion(predicted, truth, prediction)
    sides = c.select("n", F.inline(F.array(F.struct(F.col("actual").alias("k"), F.lit("a").alias("side"), F.col("predicted").alias("o")), F.struct(F.col("predicted").alias("k"), F.lit("p").alias("side"), F.col("actual").alias("o")))))
    per = sides.groupBy("k").agg(
        F.sum(F.when((F.col("side") == "a") & (F.col("k") == F.col("o")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("actual"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("actual") > 0, F.col("tp") / F.col("actual")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return per.agg(
        (F.sum("tp") / nz(F.sum("actual"))).alias("accuracy"), F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f1).alias("f1_score")
    )


def regression_metrics(predicted: DataFrame, truth: str, prediction: str) -> DataFrame:
    e = num(truth) - num(prediction)
    return predicted.agg(
        (1 - F.sum(e * e) / nz(F.var_pop(num(truth)) * F.count(e))).alias("r2"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
    )


def score_of(predicted: DataFrame, truth: str, prediction: str, classes: bool) -> float:
    if classes:
        return float(predicted.agg(F.avg((quoted(truth) == quoted(prediction)).cast("double"))).first()[0] or 0.0)
    return float(regression_metrics(predicted, truth, prediction).first()["r2"] or 0.0)


def importance(model, features: Sequence[str], spark) -> DataFrame:
    """Tree importances, else mean absolute coefficients."""
    if hasattr(model, "featureImportances"):
        w = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        w = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        got = model.coefficients
        w = np.abs(got.toArray() if hasattr(got, "toArray") else np.asarray(got))
    elif hasattr(model, "models") and hasattr(model.models[0], "featureImportances"):
        w = np.mean([m.featureImportances.toArray() for m in model.models], axis=0)
    else:
        return spark.createDataFrame([], "feature string, importance double")
    if len(w) != len(features):
        return spark.createDataFrame([], "feature string, importance double")
    return spark.createDataFrame([(c, float(v)) for c, v in zip(features, w)], "feature string, importance double")


# ---- runs ------------------------------------------------------------------


@dataclass
class Run:
    """Result tables of one supervised run."""

    predictions: DataFrame
    metrics: DataFrame
    cross_validation: DataFrame
    importance: DataFrame
    features: list[str] = field(default_factory=list)
    model: object = None


def _scored_folds(rows: DataFrame, key, folds, seed, fit_predict, truth, classes) -> DataFrame:
    spark = rows.sparkSession
    tagged = rows.withColumn("_fold", fold_number(key, folds, seed))
    out = []
    for f in range(folds):
        train, test = tagged.where(F.col("_fold") != f), tagged.where(F.col("_fold") == f)
        out.append((f, score_of(fit_predict(train, test), truth, "prediction", classes)))
    return spark.createDataFrame(out, "fold int, score double")


def _chosen(train: DataFrame, target: str, cols: list[str], k: int | None, task: str) -> list[str]:
    if not k or len(cols) <= k:
        return cols
    keep = {r["feature"] for r in univariate_f(train, target, cols, k, task).where("selected").collect()}
    return [c for c in cols if c in keep]


def run_classification(
    df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None = None, model: str = "random_forest",
    test_share: float = 0.2, folds: int = 5, select_k: int | None = 10, seed: int = SEED, **options,
) -> Run:
    """Prepare, split, scale, select, fit, predict, cross-validate on the training part, score."""
    cols = list(features) if features is not None else default_features(df, target, key)
    rows, classes = label_encoded(prepare(df, target, cols, key), target)
    rows = cut_lineage(train_test(rows, key, test_share, "label", seed))
    train, test = rows.where(~F.col("is_test")), rows.where(F.col("is_test"))
    scaler = fit_scaler(train, cols)
    train, test = scaler.apply(train), scaler.apply(test)
    cols = _chosen(train, "label", cols, select_k, "classification")
    spark, n = df.sparkSession, train.count()
    fitted: dict = {}

    def fit_predict(tr: DataFrame, te: DataFrame) -> DataFrame:
        if model == "knn":
            got = knn_predict(tr, te, key[0], cols, "label", options.get("k", 5))
            return te.join(got, key[0])
        if model == "svm":
            lift = _kernel_rows(tr, cols, seed, options.get("width", 200))
            fit = classifier(model, n, len(classes), seed, **options).fit(lift.transform(tr).select("features", "label"))
            return fit.transform(lift.transform(te))
        if model == "random_forest":
            tr = gathered(tr)
            trees = options.get("trees", 100)
            if n * trees > GROWN:
                got, fitted["weights"] = grown_in_parts(tr, te, cols, n, trees, len(classes), **{"seed": seed, **{k: v for k, v in options.items() if k != "trees"}})
                return got
        fit = classifier(model, n, len(classes), seed, **options).fit(assemble(tr, cols).select("features", "label"))
        fitted["model"] = fit
        return fit.transform(assemble(te, cols))

    cv = _scored_folds(train, key, folds, seed, fit_predict, "label", True) if folds > 1 else spark.createDataFrame([], "fold int, score double")
    predicted = fit_predict(train, test)
    names = F.array(*[F.lit(str(c)) for c in classes])
    shown = predicted.select(
        *[quoted(k) for k in key], F.get(names, F.col("label").cast("int")).alias("actual"), F.get(names, F.col("prediction").cast("int")).alias("predicted"),
        *(["probability"] if "probability" in predicted.columns else []),
    )
    if "weights" in fitted:
        weights = spark.createDataFrame([(c, float(v)) for c, v in zip(cols, fitted["weights"])], "feature string, importance double")
    else:
        weights = importance(fitted["model"], cols, spark) if "model" in fitted else spark.createDataFrame([], "feature string, importance double")
    return Run(shown, classification_metrics(shown, "actual", "predicted"), cv, weights, cols, fitted.get("model"))


def run_regression(
    df: DataFrame, target: str, key: Sequence[str], features: Sequence[str] | None = None, model: str = "random_forest",
    test_share: float = 0.2, folds: int = 5, select_k: int | None = 10, seed: int = SEED, **options,
) -> Run:
    cols = list(features) if features is not None else default_features(df, target, key)
    rows = prepare(df, target, cols, key).withColumn("label", num(target))
    rows = cut_lineage(train_test(rows, key, test_share, None, seed))
    train, test = rows.where(~F.col("is_test")), rows.where(F.col("is_test"))
    scaler = fit_scaler(train, cols)
    train, test = scaler.apply(train), scaler.apply(test)
    cols = _chosen(train, "label", cols, select_k, "regression")
    spark = df.sparkSession
    fitted: dict = {}

    def fit_predict(tr: DataFrame, te: DataFrame) -> DataFrame:
        if model in ("linear", "ridge", "lasso"):
            fit = {"linear": regress.ols, "ridge": regress.ridge, "lasso": regress.lasso}[model](tr, cols, "label", **options)
            fitted["model"] = fit
            return te.withColumn("prediction", fit.predict())
        if model == "svm":
            return epsilon_svr(tr, cols, "label", seed=seed, **options)(te)
        if model == "knn":
            return te.join(knn_predict(tr, te, key[0], cols, "label", options.get("k", 5), classes=False), key[0])
        if model == "random_forest":
            est = RandomForestRegressor(numTrees=options.get("trees", 100), maxDepth=options.get("max_depth", MAX_DEPTH), seed=seed)
        elif model == "decision_tree":
            est = DecisionTreeRegressor(maxDepth=options.get("max_depth", MAX_DEPTH), seed=seed)
        else:
            raise ValueError(f"unknown regressor {model!r}")
        fit = est.fit(assemble(tr, cols).select("features", "label"))
        fitted["model"] = fit
        return fit.transform(assemble(te, cols))

    cv = _scored_folds(train, key, folds, seed, fit_predict, "label", False) if folds > 1 else spark.createDataFrame([], "fold int, score double")
    predicted = fit_predict(train, test)
    shown = predicted.select(*[quoted(k) for k in key], F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    weights = importance(fitted["model"], cols, spark) if "model" in fitted else spark.createDataFrame([], "feature string, importance double")
    return Run(shown, regression_metrics(shown, "actual", "predicted"), cv, weights, cols, fitted.get("model"))


GRIDS = {
    "random_forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2]},
    "logistic": {"regParam": [1.0, 0.1, 0.01], "elasticNetParam": [0.0, 1.0]},
    "svm": {"regParam": [1.0, 0.1, 0.01]},
}


def grid_search(df: DataFrame, target: str, key: Sequence[str], features: Sequence[str], model: str = "random_forest", grid: dict | None = None, folds: int = 3, seed: int = SEED, parallelism: int = 4) -> DataFrame:
    """Mean held-out accuracy of every parameter combination, best first; folds are key hashes."""
    rows, classes = label_encoded(prepare(df, target, features, key), target)
    data = assemble(fit_scaler(rows, features).apply(rows), features).withColumn("fold", fold_number(key, folds, seed)).select("features", "label", "fold")
    data = cut_lineage(data)
    est = classifier(model, data.count(), 2 if model == "svm" and len(classes) == 2 else len(classes), seed)
    inner = est.getClassifier() if isinstance(est, OneVsRest) else est
    maps = ParamGridBuilder()
    for name, values in (grid or GRIDS[model]).items():
        maps = maps.addGrid(inner.getParam(name), values)
    built = maps.build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=built, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, foldCol="fold", parallelism=parallelism)
    fit = cv.fit(data)
    rows_out = [({p.name: str(v) for p, v in m.items()}, float(a), i == int(np.argmax(fit.avgMetrics))) for i, (m, a) in enumerate(zip(built, fit.avgMetrics))]
    return df.sparkSession.createDataFrame(rows_out, "parameters map<string,string>, accuracy double, best boolean").orderBy(F.col("accuracy").desc())


def gaussian_nb_table(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Prior, mean and variance per class and feature."""
    rows = prepare(df, target, features)
    per = rows.groupBy(quoted(target).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(features)], *[F.var_pop(quoted(c)).alias(f"v{i}") for i, c in enumerate(features)]
    )
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(features)]
    return per.select("class", "n", F.inline(F.array(*cells)))
