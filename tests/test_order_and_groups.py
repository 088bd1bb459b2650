"""Order by whole tuples, null groups, quantile ends and joins on few keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewell.operators import clean, describe, hypothesis
from gaugewell.plans import joins
from gaugewell.plans.joins import join_groups
from gaugewell.plans.ordering import bucketed, with_position
from gaugewell.plans.quantiles import wide_quantiles


def named(spark, n=2000):
    return spark.range(n).select("id", F.concat(F.lit("name-with-a-long-start-"), F.lpad((n - F.col("id")).cast("string"), 6, "0")).alias("name")).repartition(5)


def test_texts_with_a_common_start_keep_their_order(spark):
    got = with_position(named(spark), ["name", "id"], buckets=16).orderBy("idx").toPandas()
    assert (got["id"] == np.arange(1999, -1, -1)).all()
    filled = clean.fill_along(named(spark).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id"))), ["name"], ["v"]).toPandas().set_index("id")["v"]
    assert all(filled[i] == i + i % 2 for i in range(1998))


def test_large_integers_and_times_are_not_rounded(spark):
    top = 2**60
    df = spark.range(200).select((F.col("id") + top).alias("k"), F.timestamp_micros(F.col("id") + 1_577_836_800_000_000).alias("t")).repartition(4)
    for order in (["k"], ["t"]):
        got = with_position(df, order, buckets=8).orderBy("k").toPandas()
        assert (got["idx"] == np.arange(200)).all()


def test_jobs_do_not_grow_with_the_values(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(values):
        group = f"order-{values}"
        spark.sparkContext.setJobGroup(group, group)
        bucketed(spark.range(6000).select((F.col("id") % values).alias("x"), "id"), ["x", "id"], "b", 64)
        return len(tracker.getJobIdsForGroup(group))

    try:
        few, many = jobs(3), jobs(600)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert few == many <= 6


def test_complete_ties_are_cut(spark):
    sizes = bucketed(spark.range(1000).select(F.lit("same").alias("x"), "id"), ["x"], "b", 8).groupBy("b").count().toPandas()["count"]
    assert len(sizes) >= 4 and sizes.max() <= 400


def test_order_along_text_cannot_be_interpolated(spark):
    with pytest.raises(ValueError, match="interpolate"):
        clean.interpolate(named(spark).withColumn("v", F.col("id").cast("double")), ["name"], ["v"])


def test_null_groups_stay(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"part": rng.choice(["a", "b", None], 900), "k": rng.choice(["x", "y"], 900), "v": rng.normal(size=900)})
    df = spark.createDataFrame(pdf).repartition(3)
    got = describe.describe(df, ["v"], by=["part"]).toPandas()
    assert len(got) == 3 and np.isclose(got[got["part"].isna()]["median"].iloc[0], pdf[pdf["part"].isna()]["v"].median())
    assert hypothesis.mann_whitney_u(df, "v", "k", "x", "y", by=["part"]).count() == 3
    assert hypothesis.levene(df, "v", "k", by=["part"]).count() == 3


def test_group_join_beyond_the_broadcast(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("g"), "id").repartition(4)
    table = rows.groupBy("g").agg(F.count("*").alias("n"))
    want = join_groups(rows, table, ["g"]).orderBy("id").toPandas()
    assert len(want) == 3000
    pd.testing.assert_frame_equal(join_groups(rows, table, ["g"], broadcast_groups=0).orderBy("id").select(*want.columns).toPandas(), want)
    monkeypatch.setattr(joins, "HOT_SHARE", 0.5)
    pd.testing.assert_frame_equal(join_groups(rows, table, ["g"], broadcast_groups=0).orderBy("id").select(*want.columns).toPandas(), want)


def test_ends_of_a_long_column(spark):
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_000).cast("double").alias("x"))
    assert wide_quantiles(df, ["x"], [0.0, 0.5, 0.9999, 1.0], direct_rows=100) == [[0.0, 19999.5, pytest.approx(39995.0001), 39999.0]]


def test_plan_settings(spark):
    df = spark.createDataFrame([(i, float(i % 5) if i != 3 else None, "a" if i != 4 else None) for i in range(40)] + [(40, 900.0, "b")], "id long, v double, t string")
    plan = dict(retype=False, trim=False, duplicates=False, downcast=False)
    filled = clean.clean(df, clean.CleaningPlan(missing="auto", order=("id",), **plan))[0].toPandas().set_index("id")
    assert filled.loc[3, "v"] == 2.0 and filled.loc[4, "t"] == "a"
    with pytest.raises(ValueError, match="row_key"):
        clean.clean(df, clean.CleaningPlan(missing="auto", outliers="isolation_forest", **plan))
    kept = clean.clean(df, clean.CleaningPlan(missing="auto", outliers="isolation_forest", row_key=("id",), **plan))[0]
    assert 30 <= kept.count() < 41


def test_unexpected_categories_do_not_fit(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5 + [("c",)], "k string")
    row = hypothesis.chi_square_fit(df, "k", {"a": 1, "b": 1}).first()
    assert row["n"] == 11 and row["statistic"] == float("inf") and row["p_value"] == 0.0
