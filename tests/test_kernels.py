"""Quantiles, order, ranks, moments, concordance and neighbours against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugewell.plans import concordance as cc
from gaugewell.plans.moments import moments
from gaugewell.plans.neighbors import knn, nearest_points, points_of
from gaugewell.plans.ordering import bucketed, halo_blocks, halo_window, running, with_position
from gaugewell.plans.quantiles import group_quantiles, wide_quantiles
from gaugewell.plans.ranks import rank_table, with_rank

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def average_ranks(x):
    return pd.Series(x).rank().to_numpy()


@pytest.mark.parametrize("direct", [10, 10_000_000])
def test_quantiles_both_routes(spark, direct):
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000)
    y = np.round(rng.exponential(3, 20_000))  # heavy ties
    z = np.where(rng.random(20_000) < 0.4, 7.0, rng.normal(size=20_000))  # one hot value
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z})).repartition(7)
    got = wide_quantiles(df, ["x", "y", "z"], PROBS, direct_rows=direct)
    for g, v in zip(got, (x, y, z)):
        assert np.allclose(g, np.quantile(v, PROBS), atol=1e-9)


def test_quantiles_empty_single_and_nan(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (2.0, None, 3.0)], "a double, b double, c double")
    a, b, c = wide_quantiles(df, ["a", "b", "c"], [0.5])
    assert a == [1.5] and b == [None] and c == [3.0]


@pytest.mark.parametrize("small", [5, 20_000])
def test_group_quantiles(spark, small):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 30_000, p=[0.8, 0.15, 0.05]), "v": rng.normal(size=30_000)})
    if small == 5:  # the bracket needs room for neighbouring ranks
        small = 3_000
    got = group_quantiles(spark.createDataFrame(pdf).repartition(5), ["g"], "v", [0.25, 0.5], small=max(small, 15_000)).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert got.loc[g, "n"] == len(part)
        assert np.allclose(got.loc[g, ["q0", "q1"]].astype(float), np.quantile(part["v"], [0.25, 0.5]))


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_positions_follow_the_order(spark, parts):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "t": rng.integers(0, 40, 500), "id": rng.permutation(500)})
    pdf.loc[:200, "t"] = 5  # one hot order value
    got = with_position(spark.createDataFrame(pdf).repartition(parts), ["t", "id"], ["k"], buckets=8).toPandas()
    want = pdf.sort_values(["t", "id"])
    want["idx"] = want.groupby("k").cumcount()
    merged = got.merge(want, on=["k", "t", "id"])
    assert len(merged) == 500 and (merged["idx_x"] == merged["idx_y"]).all()


def test_positions_over_text(spark):
    words = ["b", "a", "", "zebra", "zebr", "ä", "数据", "aa", "abcdefgh", "abcdefgi"] * 3
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i int").repartition(3)
    got = [r["w"] for r in with_position(df, ["w", "i"], buckets=5).orderBy("idx").collect()]
    assert got == sorted(words, key=lambda w: w.encode())


def test_hot_order_value_is_cut_by_the_tie(spark):
    df = spark.range(1000).select(F.lit(1.0).alias("t"), F.col("id"))
    sizes = bucketed(df, ["t", "id"], "b", 8).groupBy("b").count().toPandas()["count"]
    assert len(sizes) >= 4 and sizes.max() <= 400


def test_running_values(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"t": rng.permutation(300).astype(float), "v": rng.normal(size=300)})
    pdf.loc[rng.random(300) < 0.5, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = (
        running(df, ["t"], [], sums={"s": F.col("v")}, lasts={"l": F.col("v")}, firsts={"f": F.col("v")}, maxs={"x": F.col("v")}, mins_ahead={"m": F.col("v")}, buckets=6)
        .toPandas().sort_values("t", ignore_index=True)
    )
    w = pdf.sort_values("t", ignore_index=True)["v"]
    assert np.allclose(got["s"], w.fillna(0).cumsum())
    for col, want in (("l", w.ffill()), ("f", w.bfill()), ("x", w.cummax().ffill()), ("m", w[::-1].cummin().ffill()[::-1])):
        assert np.allclose(got[col].astype(float), want, equal_nan=True), col


def test_halo_windows_equal_global_windows(spark):
    n = 200
    df = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    w = halo_window([])
    got = halo_blocks(df, "idx", 3, 2, size=10).withColumn("m", F.avg("v").over(w.rowsBetween(-3, 2))).where("_core").toPandas().sort_values("idx")
    v = np.arange(n) * 7 % 13
    want = [v[max(0, i - 3) : i + 3].mean() for i in range(n)]
    assert len(got) == n and np.allclose(got["m"], want)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.sampled_from([1, 3, 8]))
def test_ranks_property(spark, values, parts):
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, id int").repartition(parts)
    got = with_rank(df, "v", "r").toPandas().sort_values("id")["r"].to_numpy()
    assert np.allclose(got, average_ranks(values))


def test_rank_table_ties(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,), (2.0,)], "v double")
    rows = {r["_x"]: (r["_ties"], r["avg_rank"]) for r in rank_table(df, "v").collect()}
    assert rows == {1.0: (2, 1.5), 2.0: (1, 3.0)}


def test_moments_routes_agree(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 1, (400, 24))
    cols = [f"c{i}" for i in range(24)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols)).repartition(6)
    wide, narrow = moments(df, cols), moments(df, cols[:6])
    assert wide.n == 400 and np.allclose(wide.cov, np.cov(x.T), atol=1e-8)
    assert np.allclose(narrow.cov, np.cov(x[:, :6].T), atol=1e-8)


def brute_score(x, y):
    return sum(int(np.sign((a - c) * (b - d))) for (a, b), (c, d) in itertools.combinations(list(zip(x, y)), 2))


@pytest.mark.parametrize("buckets", [1, 2, 5])
def test_concordance_exact_with_ties_and_hot_values(spark, buckets):
    rng = np.random.default_rng(6)
    x = np.where(rng.random(150) < 0.35, 4, rng.integers(0, 30, 150)).astype(float)
    y = np.where(rng.random(150) < 0.35, 2, rng.integers(0, 12, 150)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(4)
    got = cc.concordance(df, "x", "y", buckets)
    assert got.n == 150 and got.score == brute_score(x, y)
    assert got.ties_x == sum(a == b for a, b in itertools.combinations(x, 2))


def test_crowded_buckets_are_cut_again(spark, monkeypatch):
    """Tasks of at most 40 cells: three levels and more below the first grid, whatever the buckets there."""
    rng = np.random.default_rng(12)
    x = np.r_[rng.integers(0, 400, 1500), np.full(300, 7)].astype(float)
    y = np.r_[rng.normal(size=1200).round(1), np.zeros(300), rng.integers(0, 3, 300) * 1e9]
    want = int((np.sign(x[:, None] - x) * np.sign(y[:, None] - y)).sum()) // 2
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(3)
    for buckets, per_task, fan in ((1, 40, 3), (3, 100, 32)):
        monkeypatch.setattr(cc, "FAN", fan)
        assert cc.concordance(df, "x", "y", buckets, per_task).score == want


def test_signed_pairs_small():
    a, b = np.array([1.0, 2.0, 3.0, 3.0]), np.array([4.0, 1.0, 2.0, 2.0])
    w = np.array([1, 2, 1, 3])
    pairs = itertools.combinations(range(4), 2)
    want = sum(w[i] * w[j] * np.sign((a[i] - a[j]) * (b[i] - b[j])) for i, j in pairs)
    assert cc.signed_pairs(a, b, w) == want


def test_slope_counts(spark):
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 15, 60).astype(float), rng.normal(size=60)
    slopes = [(y[j] - y[i]) / (x[j] - x[i]) for i, j in itertools.combinations(range(60), 2) if x[i] != x[j]]
    cells = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "w": 1}))
    got = cc.slope_counts(cells, [-0.1, 0.0, 0.25], len(slopes))
    assert got == {m: sum(s < m for s in slopes) for m in (-0.1, 0.0, 0.25)}


def test_neighbours_exact_with_copies(spark, monkeypatch):
    from gaugewell.plans import neighbors as nb

    monkeypatch.setattr(nb, "ROWS_PER_PIVOT", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    x[100:200] = x[0]  # a third of the rows are copies
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["id"] = np.arange(300)
    df = spark.createDataFrame(pdf).repartition(5)
    points = points_of(df, "id", ["a", "b", "c"])
    assert points.count() == 200
    q = df.where("id < 100 and id > 0").select(F.col("id").alias("qid"), F.array("a", "b", "c").alias("vec"), F.col("id").alias("own"))
    got = nearest_points(q, points, 4, "bigint").toPandas()
    uniq = np.r_[np.arange(100), np.arange(200, 300)]
    for i in range(1, 100, 7):
        d = np.linalg.norm(x[uniq] - x[i], axis=1)
        order = [j for j in np.argsort(d) if uniq[j] != i]
        need, want = 4, []
        for j in order:
            m = 101 if uniq[j] == 0 else 1
            want.append((int(uniq[j]), min(m, need)))
            need -= min(m, need)
            if not need:
                break
        have = got[got["qid"] == i].sort_values("distance")
        assert list(zip(have["pid"], have["mult"])) == want


def test_crowded_cells_are_split_level_by_level(spark, monkeypatch):
    from gaugewell.operators.cluster import dbscan_points
    from gaugewell.plans import neighbors as nb

    rng = np.random.default_rng(13)
    x = np.r_[rng.normal(size=(250, 3)), rng.normal(size=(250, 3)) * 0.01 + 4, rng.uniform(-9, 9, (60, 3))]
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["id"] = np.arange(len(x))
    points = points_of(spark.createDataFrame(pdf).repartition(5), "id", ["a", "b", "c"]).cache()
    q = points.where("pid % 7 = 0").select(F.col("pid").alias("qid"), "vec", F.col("pid").alias("own"))
    for split, each, most in ((8_000, 1_000, 1_000), (60, 10, 4)):
        monkeypatch.setattr(nb, "SPLIT", split)
        monkeypatch.setattr(nb, "ROWS_PER_PIVOT", each)
        monkeypatch.setattr(nb, "MAX_PIVOTS", most)
        tree = nb.plant(points, 5)
        cells = tree.members.groupBy("cell").count().toPandas()
        assert cells["count"].sum() == len(x) and cells["count"].max() <= split
        assert split > 100 or cells["cell"].str.count("/").max() >= 2
        got = nearest_points(q, points, 5, "bigint").toPandas()
        for i in range(0, len(x), 7):
            d = np.linalg.norm(x - x[i], axis=1)
            d[i] = np.inf
            assert got[got["qid"] == i].sort_values("distance")["pid"].tolist() == np.argsort(d)[:5].tolist()
        found = dbscan_points(points, 0.6, 4, "bigint").toPandas().set_index("pid")
        d = np.linalg.norm(x[:, None] - x, axis=2) <= 0.6
        assert (found["core"].sort_index().to_numpy() == (d.sum(axis=1) >= 4)).all()


def test_knn_skips_itself(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(20)], "id long, a double, b double")
    got = knn(df, "id", ["a", "b"], 2).where("key = 0").toPandas()
    assert sorted(got["neighbor"]) == [1, 2] and math.isclose(got["distance"].max(), 2.0)
