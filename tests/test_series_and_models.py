"""Series tests and forecasts by recovery, models, clusters, anomalies, log, files, registry."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaugewell.operators import anomaly, chartdata, cluster, learn, runlog
from gaugewell.operators import forecast as fc
from gaugewell.operators import series as ts
from gaugewell.plans.blocks import block_apply
from gaugewell.sources import files, readers, sinks
from gaugewell.streaming import rules


def series_of(spark, **columns):
    n = len(next(iter(columns.values())))
    pdf = pd.DataFrame({"t": [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)], **columns})
    return ts.to_series(spark.createDataFrame(pdf).repartition(4), "t", list(columns))


@pytest.fixture(scope="module")
def noise_and_walk(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=500)
    return series_of(spark, noise=e, walk=np.cumsum(rng.normal(size=500))), e


def test_unit_root_tests(noise_and_walk):
    s, _ = noise_and_walk
    got = {r["series"]: r for r in ts.stationarity(s).collect()}
    assert got["noise"]["is_stationary"] and not got["walk"]["is_stationary"]
    assert got["noise"]["adf_p_value"] < 0.01 and got["walk"]["adf_p_value"] > 0.05 and got["walk"]["kpss_p_value"] < 0.05


def test_adf_equals_direct_regression(noise_and_walk):
    s, y = noise_and_walk
    row = ts.adf(s.where("series = 'noise'"), 3).first()
    k = row["used_lag"]
    dy = np.diff(y)
    t = np.arange(k, len(dy))
    x = np.column_stack([np.ones(len(t)), y[t], *[dy[t - j] for j in range(1, k + 1)]])
    w, res = np.linalg.lstsq(x, dy[t], rcond=None)[:2]
    se = np.sqrt(res[0] / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert row["nobs"] == len(t) and np.isclose(row["statistic"], w[1] / se)


def test_critical_values_published():
    assert np.isclose(ts.adf_critical(10**9)["5%"], -2.86154, atol=1e-5)
    assert abs(ts.adf_p_value(-2.86154) - 0.05) < 0.002 and ts.kpss_p_value(0.463) == 0.05


def test_blocks_agree_with_whole_series(noise_and_walk, monkeypatch):
    s, y = noise_and_walk
    from gaugewell.plans import ordering

    whole = ts.kpss(s).collect()
    real = ordering.halo_blocks
    from gaugewell.plans import blocks

    monkeypatch.setattr(blocks, "halo_blocks", lambda d, i, b, a, size=None: real(d, i, b, a, 60))
    cut = ts.kpss(s).collect()
    assert np.allclose(sorted(r["statistic"] for r in whole), sorted(r["statistic"] for r in cut))
    a, b = ts.adf(s, 5).collect(), None
    monkeypatch.undo()
    b = ts.adf(s, 5).collect()
    assert np.allclose(sorted(r["statistic"] for r in a), sorted(r["statistic"] for r in b))
    assert block_apply(s, 0, 0, lambda r, f, l: pd.DataFrame({"m": [l - f]}), "m long").agg(F.sum("m")).first()[0] == 1000


def test_season_and_decompositions(spark, monkeypatch):
    n = 240
    i = np.arange(n)
    wave = 10 * np.sin(2 * np.pi * i / 12)
    s = series_of(spark, v=50 + 0.1 * i + wave)
    assert ts.seasonal_period(s).first()["period"] % 12 == 0
    c = ts.decompose_classical(s, 12).toPandas().sort_values("idx")
    assert np.abs(c["resid"]).max() < 1e-6 and np.allclose(c["seasonal"], wave, atol=1e-6)
    t = ts.decompose_stl(s, 12).toPandas().sort_values("idx")
    assert np.abs(t["resid"]).max() < 0.2 and ts.seasonal_strength(ts.decompose_classical(s, 12)).first()["strength"] > 0.99
    flags = ts.linear_trend(s).first()
    assert flags["significant"] and flags["direction"] == "increasing"


def test_stl_blocks_equal_whole(spark, monkeypatch):
    rng = np.random.default_rng(1)
    s = series_of(spark, v=rng.normal(size=900) + 5 * np.sin(np.arange(900) * 2 * np.pi / 7))
    whole = ts.decompose_stl(s, 7).toPandas().sort_values("idx")
    from gaugewell.plans import blocks, ordering

    real = ordering.halo_blocks
    monkeypatch.setattr(blocks, "halo_blocks", lambda d, i, b, a, size=None: real(d, i, b, a, 300))
    cut = ts.decompose_stl(s, 7).toPandas().sort_values("idx")
    assert np.allclose(whole["trend"], cut["trend"], atol=1e-6) and np.allclose(whole["seasonal"], cut["seasonal"], atol=1e-6)


def test_arima_recovers_parameters(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=1500)
    w = np.zeros(1500)
    for i in range(1, 1500):
        w[i] = 0.6 * w[i - 1] + e[i] + 0.3 * e[i - 1]
    ahead, f = fc.arima(series_of(spark, v=np.cumsum(w)), 3)
    phi, theta = f.table.first()["theta"]
    assert abs(phi - 0.6) < 0.08 and abs(theta - 0.3) < 0.1 and abs(f.table.first()["mse"] - 1) < 0.12
    assert ahead.count() == 3


def test_smoothing_follows_a_line_and_season(spark):
    i = np.arange(120)
    s = series_of(spark, v=10 + 2.0 * i)
    out = fc.double_smoothing(s, 4)[0].orderBy("step").toPandas()
    assert np.allclose(out["forecast"], 10 + 2 * (120 + np.arange(4)), atol=0.5)
    seasonal = series_of(spark, v=100 + i + 8 * np.sin(2 * np.pi * i / 6))
    got = fc.triple_smoothing(seasonal, 6, period=6)[0].orderBy("step").toPandas()
    want = 100 + (120 + np.arange(6)) + 8 * np.sin(2 * np.pi * (120 + np.arange(6)) / 6)
    assert np.abs(got["forecast"] - want).max() < 1.5
    stl = fc.stl_forecast(seasonal, 6, period=6).orderBy("step").toPandas()
    assert np.abs(stl["forecast"] - want).max() < 2.0


def plain_smoothing(y, alpha, beta, gamma, phi, s, mul=False):
    """Level, slope and season row by row."""
    first, second = (np.mean(y[:s]), np.mean(y[s : 2 * s])) if s else (y[0], y[1])
    level, slope = first, (second - first) / (s or 1)
    around = [v / first if mul else v - first for v in y[:s]]
    out = []
    for t, v in enumerate(y):
        base, now = level + phi * slope, around[t % s] if s else 0.0
        e = v - (base * now if mul else base + now)
        out.append(e)
        level = alpha * v / now + (1 - alpha) * base if mul else base + alpha * e
        if s:
            around[t % s] = gamma * v / base + (1 - gamma) * now if mul else now + gamma * e
        slope = phi * slope + beta * (level - base)
    return np.array(out)


def plain_arima(y, ar, ma, sar, sma, s, d, big_d, c):
    """Errors by the definition, nothing known before the first difference."""
    w = np.diff(y, d)
    for _ in range(big_d):
        w = w[s:] - w[:-s]
    w = w - c
    left = np.convolve(np.r_[1, -np.array(ar)], np.r_[1, np.zeros(s - 1), -sar] if s else [1])
    right = np.convolve(np.r_[1, np.array(ma)], np.r_[1, np.zeros(s - 1), sma] if s else [1])
    e = []
    for t in range(len(w)):
        e.append(sum(k * w[t - i] for i, k in enumerate(left) if i <= t) - sum(k * e[t - j] for j, k in enumerate(right) if 0 < j <= t))
    return np.r_[np.zeros(len(y) - len(e)), e]


@pytest.mark.parametrize(
    "model,theta",
    [
        (fc.Smoothing(), [1e-4, 1e-4]),
        (fc.Smoothing(True, "add", 12, True), [1e-4, 1e-4, 1e-4, 0.98]),
        (fc.Arima((1, 1, 1)), [0.5, -0.995]),
        (fc.Arima((2, 0, 0)), [0.5, 0.2, 3.0]),
        (fc.Arima((1, 0, 2), (1, 1, 1), 12), [0.3, 0.4, 0.3, 0.2, -0.9]),
    ],
)
def test_blocks_run_from_their_true_states(spark, monkeypatch, model, theta):
    from gaugewell.plans import recursion

    monkeypatch.setattr(recursion, "FAN", 2)
    size, n = 300, 3000
    rng = np.random.default_rng(4)
    y = 100 + 0.01 * np.arange(n) + 5 * np.sin(np.arange(n) * 2 * np.pi / 12) + rng.normal(size=n)
    f = fc.at(series_of(spark, v=y), model, theta, size)
    got = fc.residuals(f).toPandas().sort_values("idx")
    if isinstance(model, fc.Smoothing):
        alpha, beta, gamma, phi = model._unpack(theta)
        want = plain_smoothing(y, alpha, beta, gamma, phi, model.period if model.season else 0)
    else:
        p, d, q = model.order
        big = model.seasonal
        c = theta[-1] if model.has_constant else 0.0
        want = plain_arima(y, theta[:p], theta[p : p + q], *(theta[p + q : p + q + 2] if big[0] else (0.0, 0.0)), model.period, d, big[1], c)
    known = got["idx"].to_numpy() >= model.skip
    assert np.allclose(got["resid"][known], want[known], rtol=0, atol=1e-9) and got["resid"][~known].isna().all()
    assert len(got) == n and np.isclose(f.table.first()["sse"], (want[known] ** 2).sum(), rtol=1e-9)
    ahead = fc.predict(f, 5).orderBy("step").toPandas()
    monkeypatch.undo()
    once = fc.predict(fc.at(series_of(spark, v=y), model, theta), 5).orderBy("step").toPandas()
    assert np.allclose(ahead[["forecast", "lower"]], once[["forecast", "lower"]], rtol=0, atol=1e-8)


def test_multiplicative_season_sweeps_to_the_whole(spark):
    rng = np.random.default_rng(6)
    n = 1500
    y = (50 + 0.02 * np.arange(n)) * (1 + 0.2 * np.sin(np.arange(n) * np.pi / 3)) + rng.normal(size=n)
    model, theta = fc.Smoothing(True, "mul", 6), [0.01, 0.001, 0.02]
    want = plain_smoothing(y, 0.01, 0.001, 0.02, 1.0, 6, True)
    got = fc.residuals(fc.at(series_of(spark, v=y), model, theta, 240)).toPandas().sort_values("idx")
    assert np.allclose(got["resid"][12:], want[12:], rtol=0, atol=1e-9)


def test_fits_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(7)
    s = series_of(spark, v=np.cumsum(rng.normal(size=900)) + 50, w=rng.normal(size=900) + 3)
    whole, cut = (fc.fit(s, fc.Arima((1, 0, 1)), 3, size).table.toPandas().sort_values("series") for size in (None, 100))
    assert np.allclose(whole["sse"], cut["sse"], rtol=1e-8) and np.allclose(whole["theta"].tolist(), cut["theta"].tolist(), atol=1e-6)


# ---- models ----------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 0.3, (80, 2)), rng.normal(4, 0.3, (80, 2)), rng.normal([0, 5], 0.3, (80, 2))]
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf["y"] = np.repeat(["p", "q", "r"], 80)
    pdf["id"] = np.arange(240)
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


@pytest.mark.parametrize("model,options", [("logistic", {}), ("naive_bayes", {}), ("knn", {}), ("decision_tree", {})])
def test_classifiers_separate_blobs(blobs, model, options):
    _, df = blobs
    run = learn.run_classification(df, "y", ["id"], ["a", "b"], model=model, folds=0, **options)
    assert run.metrics.first()["accuracy"] > 0.95 and run.predictions.count() == 48


def test_split_is_stable_and_stratified(blobs):
    _, df = blobs
    tags = [{r["id"] for r in learn.train_test(df.repartition(p), ["id"], 0.25, "y").where("is_test").collect()} for p in (1, 6)]
    assert tags[0] == tags[1] and len(tags[0]) == 60


@pytest.mark.parametrize("model", ["kmeans", "dbscan", "hierarchical"])
def test_clusters_find_blobs(blobs, model):
    pdf, df = blobs
    summary, labels = cluster.run_clustering(df, "id", ["a", "b"], model, **({"restarts": 2} if model == "kmeans" else {}))
    got = labels.toPandas().merge(pdf, on="id")
    assert summary.first()["clusters"] == 3 and (got[got["cluster"] >= 0].groupby("cluster")["y"].nunique() == 1).all()
    assert got.loc[got["id"] == 0, "cluster"].iloc[0] == 0


def test_dbscan_equals_brute_force(spark, monkeypatch):
    from gaugewell.plans import neighbors as nb

    monkeypatch.setattr(nb, "ROWS_PER_PIVOT", 30)
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 3, (250, 2))
    x[200:] = x[3]  # copies count as neighbours
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf["id"] = np.arange(250)
    got = cluster.dbscan(spark.createDataFrame(pdf).repartition(5), "id", ["a", "b"], 0.22, 5, scale=False).toPandas().sort_values("id")
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.22
    core = near.sum(axis=1) >= 5
    label = np.where(core, np.arange(250), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[near[i] & core].min()
        if (new == label).all():
            break
        label = new
    assert (got["core"].to_numpy() == core).all()
    c = got["cluster"].to_numpy()
    assert len({(a, b) for a, b in zip(c[core], label[core])}) == len(set(label[core])) == len(set(c[core]))
    assert ((c == -1) == ~(near[:, core].any(axis=1))).all()


def test_hot_copies_do_not_break_lof(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 2))
    x[100:] = 0.0
    x[7] = 30.0
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf["id"] = np.arange(150)
    out = anomaly.local_outlier_factor(spark.createDataFrame(pdf), "id", ["a", "b"], 10).toPandas()
    assert len(out) == 150 and np.allclose(out[out["id"] >= 100]["score"], 1.0)
    alone = np.delete(x, np.s_[100:], axis=0)
    got = anomaly.local_outlier_factor(spark.createDataFrame(pdf[:100]), "id", ["a", "b"], 10).toPandas().set_index("id")["score"].sort_index()
    d = np.linalg.norm(alone[:, None] - alone[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    kd = np.take_along_axis(d, near, 1).max(axis=1)
    lrd = 1 / (np.maximum(kd[near], np.take_along_axis(d, near, 1)).mean(axis=1) + 1e-10)
    assert np.allclose(got, lrd[near].mean(axis=1) / lrd) and got.idxmax() == 7


@pytest.mark.parametrize("method", ["isolation_forest", "one_class_svm", "elliptic_envelope", "modified_zscore"])
def test_anomaly_methods_find_the_far_point(spark, method):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    x[11] = [25.0, -25.0]
    pdf = pd.DataFrame(x, columns=["a", "b"])
    pdf["id"] = np.arange(300)
    out = anomaly.detect_anomalies(spark.createDataFrame(pdf).repartition(3), "id", method, ["a", "b"]).toPandas().set_index("id")
    assert out.loc[11, "label"] == -1 and (method == "one_class_svm" or out["score"].idxmax() == 11)


def test_forest_is_the_same_for_any_partitioning(spark, sensor_df):
    one = anomaly.isolation_forest(sensor_df.repartition(1), ["id"], ["temperature"], trees=20).orderBy("id").toPandas()
    many = anomaly.isolation_forest(sensor_df.repartition(7), ["id"], ["temperature"], trees=20).orderBy("id").toPandas()
    assert np.allclose(one["score"], many["score"])


# ---- charts, log, files ----------------------------------------------------


def test_thinning_matches_linspace(spark):
    n, k = 2537, 100
    got = [r["idx"] for r in chartdata.thinned(spark.range(n), ["id"], k).orderBy("idx").collect()]
    assert got == sorted({i * (n - 1) // (k - 1) for i in range(k)}) and len(got) == k


def test_histogram_and_density(spark, sensor_df, sensor):
    got = chartdata.histogram(sensor_df, ["pressure"]).orderBy("bin").toPandas()
    assert list(got["count"]) == list(np.histogram(sensor["pressure"], 30)[0])
    flat = chartdata.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double")).agg(F.sum("count")).first()[0]
    assert flat == 2
    curve = chartdata.density(sensor_df, "pressure", 200).orderBy("x").toPandas()
    assert abs(np.trapezoid(curve["density"], curve["x"]) - 1) < 0.05


def test_run_log_lifecycle(spark, tmp_path):
    log = runlog.new_record(spark, id=1, analysis_id="x", file_name="a.csv", file_hash="h", analysis_type="comprehensive", analysis_config={"correlation_method": "pearson", "outlier_method": "iqr", "outlier_threshold": 3.0})
    path = str(tmp_path / "log")
    runlog.append(log, path)
    runlog.append(runlog.start(runlog.latest(runlog.read(spark, path))), path)
    runlog.append(runlog.complete(runlog.latest(runlog.read(spark, path)), 1200), path)
    now = runlog.read(spark, path)
    row = runlog.latest(now).first()
    assert row["status"] == "completed" and row["version"] == 2 and row["completed_at"] is not None
    config = {"correlation_method": "pearson", "outlier_method": "iqr", "outlier_threshold": 3.0}
    assert runlog.find_existing(now, "h", config).count() == 1
    assert runlog.find_existing(now, "h", {**config, "outlier_threshold": 2.0}).count() == 0
    assert runlog.statistics(now).first()["completed"] == 1 and runlog.retained(now).count() == 3
    runlog.export_record(now, "x", str(tmp_path / "one"))
    assert json.loads(spark.read.text(str(tmp_path / "one")).first()[0])["status"] == "completed"


def test_text_forms(spark):
    df = spark.createDataFrame([(512, 250), (800000, 6550), (1536, 90000), (3 * 2**30, 0)], "b long, ms long")
    got = df.select(runlog.size_text(F.col("b")), runlog.duration_text(F.col("ms"))).collect()
    assert [r[0] for r in got] == ["512B", "781.2KB", "1.5KB", "3.0GB"]
    assert [r[1] for r in got] == ["250ms", f"{6.55:.1f}s", "1.5min", "unknown"]


def test_files_and_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, s string")
    sinks.write_csv(df, str(tmp_path / "t.csv"))
    assert sorted(readers.read_table(spark, str(tmp_path / "t.csv")).collect()) == sorted(df.collect())
    (tmp_path / "arr.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_table(spark, str(tmp_path / "arr.json"), multiline=True).agg(F.sum("a")).first()[0] == 3
    with pytest.raises(readers.UnsupportedFormat):
        readers.read_table(spark, "x.txt")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.txt").write_text("x")
    (tmp_path / "in" / "ok.csv").write_text("a\n1\n")
    got = {r["file_name"]: r["is_valid"] for r in files.inventory(spark, str(tmp_path / "in")).collect()}
    assert got == {"bad.txt": False, "ok.csv": True}
    (tmp_path / "skip.csv").write_text("note\nmore\na,b\n1,x\n2,y\n")
    back = readers.read_csv(spark, str(tmp_path / "skip.csv"), skip_rows=2)
    assert back.dtypes == [("a", "double"), ("b", "string")] and back.count() == 2
    for orient in ("records", "values", "index", "table"):
        sinks.write_json(df, str(tmp_path / orient), orient, metadata=True, order=["id"])
    assert json.loads(spark.read.text(str(tmp_path / "values")).orderBy("value").first()[0]) == [1, "a,b"]
    assert json.loads(spark.read.text(str(tmp_path / "index")).orderBy("value").first()[0]) == {"0": {"id": 1, "s": "a,b"}}


def test_sampling_is_repeatable(spark):
    df = spark.range(5000)
    a = {r[0] for r in readers.sample_rows(df, 200, ["id"]).collect()}
    b = {r[0] for r in readers.sample_rows(df.repartition(9), 200, ["id"]).collect()}
    assert a == b and len(a) == 200
    assert readers.sample_rows(df, 9999, ["id"]).count() == 5000
    first, second = files.table_fingerprint(df).first(), files.table_fingerprint(df.repartition(3)).first()
    assert first == second


def test_stream_flags_and_rules(spark, tmp_path, sensor):
    folder = str(tmp_path / "in")
    table = spark.createDataFrame(sensor[["id", "temperature"]])
    table.write.parquet(folder)
    fences = rules.frozen_fences(table, ["temperature"])
    stream = spark.readStream.schema(table.schema).parquet(folder)
    q = rules.validate_stream(rules.flag_stream(stream, fences), ["not_empty"], {"temperature": {"max_value": 60}}, str(tmp_path / "issues"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "issues")).agg(F.sum("count")).first()[0] == 6


def test_registry_and_entry(spark):
    names, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(names) and len(names) >= 200
    assert entry.entry(spark).count() == 4
