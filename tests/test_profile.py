"""Describe, correlation, outliers, cleaning, validation and time detection on small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugewell.functions.columns import NoNumericColumns
from gaugewell.operators import analysis, clean, correlate, outliers, timecol, validate
from gaugewell.operators import describe as d


def by_column(df, key="column"):
    return {r[key]: r for r in df.collect()}


def test_quartiles_of_one_to_hundred(spark):
    row = d.describe(spark.range(1, 101).toDF("v")).first()
    assert (row["percentile_25"], row["median"], row["percentile_75"]) == (25.75, 50.5, 75.25)
    assert row["count"] == 100 and row["mean"] == 50.5


def test_describe_matches_pandas(sensor_df, sensor):
    got = by_column(d.describe(sensor_df, ["temperature", "wind_speed"]))
    for c in ("temperature", "wind_speed"):
        x = sensor[c]
        z = (x - x.mean()) / x.std(ddof=0)
        assert np.isclose(got[c]["std"], x.std()) and np.isclose(got[c]["variance"], x.var())
        assert np.isclose(got[c]["skewness"], (z**3).mean()) and np.isclose(got[c]["kurtosis"], (z**4).mean() - 3)
        assert np.isclose(got[c]["percentile_95"], x.quantile(0.95))


def test_describe_large_values_keep_precision(spark):
    row = d.describe(spark.createDataFrame([(1e9,), (1e10,), (1e11,)], "v double")).first()
    assert abs(row["mean"] - 3.7e10) / 3.7e10 < 1e-10


def test_describe_edges(spark):
    df = spark.createDataFrame([(float("nan"), None, 5.0), (1.0, None, 5.0)], "a double, b double, c double")
    got = by_column(d.describe(df))
    assert set(got) == {"a", "c"} and got["a"]["count"] == 1 and got["c"]["std"] == 0
    with pytest.raises(NoNumericColumns):
        d.describe(spark.createDataFrame([("x",)], "s string"))
    assert d.describe(df.limit(0)).count() == 0


def test_describe_sketch_close(sensor_df):
    exact, sketch = by_column(d.describe(sensor_df, ["pressure"])), by_column(d.describe(sensor_df, ["pressure"], exact=False))
    assert abs(exact["pressure"]["median"] - sketch["pressure"]["median"]) < 0.5


def test_corrected_shape(sensor_df, sensor):
    got = by_column(d.corrected_shape(d.describe(sensor_df, ["humidity"])))["humidity"]
    assert np.isclose(got["skewness_corrected"], sensor["humidity"].skew()) and np.isclose(got["kurtosis_corrected"], sensor["humidity"].kurt())


def test_profile_columns_with_nested_and_odd_names(spark):
    df = spark.createDataFrame([(1, [1.0], " x"), (None, [1.0], "y")], "`a.b` int, arr array<double>, ` s` string")
    got = by_column(d.profile_columns(df))
    assert got["a.b"]["null_count"] == 1 and got["arr"]["distinct_count"] == 1 and not got[" s"]["name_ok"]


def test_correlations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"x": x, "y": 2 * x + 1, "sq": np.arange(300.0) ** 2, "i": np.arange(300.0), "k": 3.0})
    df = spark.createDataFrame(pdf).repartition(4)
    p = {(r[0], r[1]): r[2] for r in correlate.pearson(df).collect()}
    assert np.isclose(p[("x", "y")], 1.0) and p[("k", "k")] is None and p[("k", "x")] is None
    s = {(r[0], r[1]): r[2] for r in correlate.spearman(df, ["sq", "i"]).collect()}
    assert np.isclose(s[("sq", "i")], 1.0) and p[("i", "sq")] < 1.0


def test_wide_and_narrow_correlations_agree(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(1e5, 1.0, (200, 26))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 25] = 4.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(26)])
    got = {(r[0], r[1]): (r[2], r[3]) for r in correlate.pearson(spark.createDataFrame(pdf).repartition(4)).collect()}
    want = pdf.corr()
    assert all(np.isclose(got[(a, b)][0], want.loc[a, b]) for a in pdf.columns[:25] for b in pdf.columns[:25])
    assert got[("c25", "c0")][0] is None and got[("c0", "c1")][1] == int((pdf["c0"].notna() & pdf["c1"].notna()).sum())


def test_spearman_and_kendall_with_gaps_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.integers(0, 8, 120).astype(float), "b": rng.normal(size=120)})
    pdf["b"] += pdf["a"] / 4
    pdf.loc[::9, "a"] = np.nan
    df = spark.createDataFrame(pdf).repartition(3)
    pair = lambda t: t.where("column_a = 'a' and column_b = 'b'").first()["correlation"]
    both = pdf.dropna()
    ranks = both.rank()
    assert np.isclose(pair(correlate.spearman(df)), ranks["a"].corr(ranks["b"]))
    s = [np.sign((both["a"].iloc[i] - both["a"].iloc[j])) * np.sign(both["b"].iloc[i] - both["b"].iloc[j]) for i in range(len(both)) for j in range(i)]
    u = sum(both["a"].iloc[i] != both["a"].iloc[j] for i in range(len(both)) for j in range(i))
    v = sum(both["b"].iloc[i] != both["b"].iloc[j] for i in range(len(both)) for j in range(i))
    assert np.isclose(pair(correlate.kendall(df)), sum(s) / np.sqrt(u * v))


def test_outliers_flagged(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*range(1, 11), 100])], "id int, v double")
    assert [r["value"] for r in outliers.outlier_rows(df, ["id"], ["v"]).collect()] == [100.0]
    counts = [outliers.zscore_table(df, ["v"], t).first()["outlier_count"] for t in (0.5, 1.0, 2.0, 3.5)]
    assert counts == sorted(counts, reverse=True)
    assert outliers.zscore_table(spark.createDataFrame([(1.0,), (1.0,)], "c double")).first()["outlier_count"] == 0


# ---- cleaning --------------------------------------------------------------


def test_retype_share_and_failures(spark):
    rows = [(str(i), "x" if i < 3 else str(i), "2024-01-%02d" % (i + 1), "1d") for i in range(10)]
    out = clean.retype(spark.createDataFrame(rows, "n string, patchy string, day string, odd string"))
    kinds = dict(out.dtypes)
    assert kinds == {"n": "double", "patchy": "string", "day": "timestamp", "odd": "string"}


def test_text_cleaning_unicode(spark):
    df = spark.createDataFrame([("　 数据 café! a_1 ",), (None,)], "s string")
    out = [r[0] for r in clean.clean_text(df, strip_special=True, lowercase=True).collect()]
    assert out == ["数据 café a_1", None]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_fills(spark, parts):
    pdf = pd.DataFrame({"t": np.arange(40), "v": np.where(np.arange(40) % 3 == 0, np.arange(40.0), np.nan)})
    pdf.loc[0, "v"] = np.nan
    df = spark.createDataFrame(pdf).repartition(parts)
    get = lambda x: x.orderBy("t").toPandas()["v"].to_numpy(dtype=float)
    assert np.array_equal(get(clean.fill_along(df, ["t"], ["v"])), pdf["v"].ffill().to_numpy(), equal_nan=True)
    assert np.array_equal(get(clean.fill_along(df, ["t"], ["v"], direction="backward")), pdf["v"].bfill().to_numpy(), equal_nan=True)
    assert np.allclose(get(clean.interpolate(df, ["t"], ["v"]))[3:40], np.arange(3.0, 40.0), equal_nan=True)


def test_dedupe_keep_sides(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "t int, v string")
    assert sorted(clean.drop_duplicates(df, ["t"], "first").collect()) == [(1, "a"), (3, "b")]
    assert sorted(clean.drop_duplicates(df, ["t"], "last").collect()) == [(2, "a"), (3, "b")]


def test_filters_keep_nulls_and_constant_scaling(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(20), 500]] + [(None,)], "v double").withColumn("c", F.lit(2.0))
    kept = [r["v"] for r in clean.filter_iqr(df, ["v"]).collect()]
    assert 500.0 not in kept and None in kept
    scaled = clean.standardize(df, ["v", "c"]).agg(F.avg("v"), F.stddev_samp("v"), F.min("c"), F.max("c")).first()
    assert abs(scaled[0]) < 1e-9 and np.isclose(scaled[1], 1.0) and scaled[2] == scaled[3] == 2.0


def test_downcast_limits(spark):
    df = spark.createDataFrame([(127, 128, 2**31, 1), (-128, -1, 0, 2)], "a long, b long, c long, d long")
    assert dict(clean.downcast(df).dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint", "d": "tinyint"}


def test_pipeline_steps(spark):
    rows = [("1", " a ", 1.0), ("2", "b", 2.0), ("2", "b", 2.0), ("3", None, 3.0), ("4", "c", 4.0), ("5", "d", 5.0)]
    out, log = clean.clean(spark.createDataFrame(rows, "n string, s string, x double"))
    assert [r["step"] for r in log.orderBy("position").collect()][:3] == ["input", "retype", "text"]
    assert out.count() == 4 and dict(out.dtypes)["n"] == "double"


# ---- validation ------------------------------------------------------------


def test_validation_levels_and_score(spark):
    rows = [(1, "a", 20, "x@y.z"), (1, "", -5, "bad"), (3, None, 200, None), (4, "d", 30, "")]
    df = spark.createDataFrame(rows, "id int, name string, age int, email string")
    issues = validate.validate(df, ["no_null_values", "duplicate_check"], {"age": {"min_value": 0, "max_value": 120}, "email": {"pattern": r"^\S+@\S+$"}, "gone": {}})
    got = {(r["rule"], r["column"]): r for r in issues.collect()}
    assert got[("no_null_values", "name")]["level"] == "error"
    assert got[("regex_pattern", "email")]["count"] == 2 and ("column_exists", "gone") in got
    assert sum(k[0] == "numeric_range" for k in got) == 1 or len([r for r in issues.collect() if r["rule"] == "numeric_range"]) == 2
    score = validate.quality_score(issues).first()
    assert score["is_valid"] and score["quality_score"] == 100 - 15 * 3 - 5 * 3


def test_clean_table_scores_high_and_empty_is_critical(spark):
    good = spark.createDataFrame([(i, f"n{i}", 20 + i, 80 + i) for i in range(5)], "id int, name string, age int, score int")
    assert validate.quality_score(validate.validate(good)).first()["quality_score"] > 80
    empty = validate.validate(good.limit(0))
    assert validate.has_critical(empty) and not validate.quality_score(empty).first()["is_valid"]


def test_column_names(spark):
    got = {r["column"]: r["problem"] for r in validate.column_name_issues(["a", " b", "", "c", "c"], spark).collect()}
    assert got == {"a": None, " b": "surrounding blanks", "": "empty", "c": "duplicate"}


# ---- time columns ----------------------------------------------------------


def test_detection_fixture(spark):
    rows = [
        (i, f"n{i}", f"2023-01-0{i} 10:00:00", f"199{i}-05-01", f"2023-01-0{i}T10:00:00Z", 1672531200 + i, "abc")
        for i in range(1, 6)
    ]
    df = spark.createDataFrame(rows, "id int, name string, created_at string, birth_date string, tagtime string, timestamp long, random_text string")
    got = by_column(timecol.detect(df))
    assert {c for c, r in got.items() if r["is_time_column"]} == {"created_at", "birth_date", "tagtime", "timestamp"}
    assert got["tagtime"]["time_type"] == "tagtime" and got["timestamp"]["time_type"] == "timestamp" and got["birth_date"]["time_type"] == "date"
    assert timecol.primary(timecol.detect(df)).first()["column"] == "tagtime"


def test_bare_names_decide(spark):
    rows = [(f"2023-01-0{i} 10:00:00", f"2023-01-0{i}") for i in range(1, 6)]
    got = by_column(timecol.detect(spark.createDataFrame(rows, "plain string, other string")))
    assert np.isclose(got["plain"]["confidence"], 0.63) and np.isclose(got["other"]["confidence"], 0.595) and not got["other"]["is_time_column"]


def test_full_analysis_survives_a_failing_part(spark, sensor_df):
    a = analysis.analyze(sensor_df.select("temperature", "humidity"), correlation_method="nope")
    assert "correlation" in a.errors and {"describe", "outliers"} <= set(a.tables)
    whole = analysis.analyze(sensor_df.select("datetime", "temperature", "pressure"), "datetime")
    assert not whole.errors and whole.tables["stationarity"].count() == 2
    assert dt.datetime(2023, 1, 1) == sensor_df.agg(F.min("datetime")).first()[0]
