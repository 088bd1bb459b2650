"""Forests on many small partitions, and forests whose trees are grown some at a time."""

import numpy as np
import pandas as pd
import pytest

from gaugewell.operators import learn, select


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    pdf = pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(400), y=np.where(x[:, 0] + 0.3 * rng.normal(size=400) > 0, "up", "down"))
    return spark.createDataFrame(pdf).repartition(24)


class Spy:
    def __init__(self, estimator, seen):
        self.estimator, self.seen = estimator, seen

    def fit(self, df):
        self.seen.append(df.rdd.getNumPartitions())
        return self.estimator.fit(df)


def test_rfecv_and_rfe_fit_on_as_many_partitions_as_cores(spark, rows, monkeypatch):
    seen, real = [], select._forest
    monkeypatch.setattr(select, "_forest", lambda *a: Spy(real(*a), seen))
    got = select.rfecv(rows, "y", ["id"], ["a", "b"], folds=2, trees=5).toPandas()
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism
    assert set(got["feature"]) == {"a", "b"} and got.set_index("feature").loc["a", "selected"]


def test_a_forest_grown_in_parts_has_all_its_trees(spark, rows, monkeypatch):
    whole = learn.run_classification(rows, "y", ["id"], list("abc"), folds=0, trees=20)
    grown, real = [], learn.classifier

    def watched(name, n, classes, seed, **options):
        grown.append((options["trees"], seed))
        return real(name, n, classes, seed, **options)

    monkeypatch.setattr(learn, "classifier", watched)
    monkeypatch.setattr(learn, "GROWN", 7 * 320)
    parts = learn.run_classification(rows, "y", ["id"], list("abc"), folds=0, trees=20)
    assert grown == [(7, 42), (7, 49), (6, 56)]
    assert parts.predictions.dtypes == whole.predictions.dtypes and parts.predictions.count() == 80
    chance = parts.predictions.toPandas()
    assert all(abs(p.toArray().sum() - 1) < 1e-9 and p.size == 2 for p in chance["probability"])
    assert all((p[1] > p[0]) == (c == "up") for p, c in zip(chance["probability"], chance["predicted"]) if p[0] != p[1])
    a, b = whole.metrics.first()["accuracy"], parts.metrics.first()["accuracy"]
    assert abs(a - b) <= 0.08
    w = {r["feature"]: r["importance"] for r in parts.importance.collect()}
    v = {r["feature"]: r["importance"] for r in whole.importance.collect()}
    assert abs(sum(w.values()) - 1) < 1e-9 and all(abs(w[c] - v[c]) < 0.1 for c in "abc")
