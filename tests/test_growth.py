"""Work that must grow no faster than the rows."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gaugewell.catalog.shared import document_features
from gaugewell.operators import anomaly, chartdata, clean, cluster, reduce, select
from gaugewell.plans import neighbors as nb
from gaugewell.plans.concordance import _grid_score
from gaugewell.plans.ordering import _not_above, _with_bucket, bucketed, running, with_position
from gaugewell.session import spread


def _plan(df):
    return df._jdf.queryExecution().toString().lower()


def test_values_ahead_use_no_frame_computed_anew_for_every_row(spark):
    rng = np.random.default_rng(3)
    n = 3_000
    pdf = pd.DataFrame({"id": np.arange(n), "t": rng.permutation(n), "v": rng.normal(size=n), "k": rng.integers(0, 3, n)})
    pdf.loc[rng.random(n) < 0.7, "v"] = np.nan
    df = spark.createDataFrame(pdf)
    ordered = pdf.sort_values("t")
    for keys in ([], ["k"]):
        filled = clean.fill_along(df, ["t"], ["v"], keys, direction="backward")
        least = running(df.na.replace(float("nan"), None, ["v"]), ["t"], keys, mins_ahead={"m": clean.num("v")}, buckets=5)
        for done in (filled, least, clean.interpolate(df, ["t"], ["v"], keys)):
            assert "currentrow$(), unboundedfollowing$()" not in _plan(done)
        by = (lambda s: s.groupby(ordered["k"])) if keys else (lambda s: s)
        want = by(ordered["v"]).bfill().reindex(pdf.index)
        got = filled.toPandas().set_index("id")["v"].astype(float).reindex(pdf["id"])
        np.testing.assert_allclose(got, want)
        back = ordered["v"][::-1]
        want = (back.groupby(ordered["k"][::-1]).cummin() if keys else back.cummin()).reindex(pdf.index)
        want = (want.reindex(ordered.index)[::-1].groupby(ordered["k"][::-1]).ffill() if keys else want.reindex(ordered.index)[::-1].ffill()).reindex(pdf.index)
        got = least.toPandas().set_index("id")["m"].astype(float).reindex(pdf["id"])
        np.testing.assert_allclose(got, want)


def test_document_features_read_the_texts_once(spark, tmp_path):
    texts = ["A1 b22\n\nC", "  lead AB\tÄÖ 3٣", "none", "\n", "X9" * 50, "tail \n"]
    docs = [(i, t, len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    got = document_features(lambda table: spark.read.parquet(f"{tmp_path}/{table}"))
    assert "text" not in _plan(got) and "parquet" not in _plan(got)  # a model's passes never reach the texts
    for r in got.collect():
        t = texts[r["doc_id"]]
        assert r["n_words"] == len(re.split(r"[ \t\n\x0B\f\r]+", t)) and r["n_lines"] == t.count("\n") + 1
        assert r["digit_share"] == len(re.findall("[0-9]", t)) / len(t) and r["upper_share"] == len(re.findall("[A-Z]", t)) / len(t)
    assert got.count() == len(texts)


def test_python_work_is_dealt_out_by_rows(spark):
    rows = spark.range(2_000).repartition(8)
    sizes = [r["count"] for r in spread(rows, 50).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_000 and max(sizes) <= 100
    assert spread(rows).rdd.getNumPartitions() == 8 and spread(rows, 500).rdd.getNumPartitions() == 8


def test_envelope_distances_are_stored_before_their_quantile(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 10))
    x[:20] += 9
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *[f"c{j}" for j in range(10)]])
    asked = []
    real = anomaly.wide_quantiles
    monkeypatch.setattr(anomaly, "wide_quantiles", lambda d, columns, probs, **k: asked.append((columns, d.is_cached)) or real(d, columns, probs, **k))
    got = anomaly.elliptic_envelope(df, ["id"]).toPandas().set_index("id").sort_index()
    steps = asked[2:-1]  # after medians and deviations, before the threshold
    assert steps and all(isinstance(c, str) and cached for columns, cached in steps for c in columns)
    centre, cov, last, h = np.median(x, axis=0), None, np.inf, int(np.ceil((300 + 11) / 2)) / 300
    cov = np.diag((1.4826 * np.median(np.abs(x - centre), axis=0)) ** 2)
    far = lambda: np.einsum("ij,jk,ik->i", x - centre, np.linalg.pinv(cov), x - centre)
    for _ in range(30):
        d = far()
        near = x[d <= np.quantile(d, h)]
        centre, cov = near.mean(axis=0), np.cov(near.T, bias=True)
        det = np.linalg.slogdet(cov)[1]
        if not det < last - 1e-9:
            break
        last = det
    np.testing.assert_allclose(got["score"], far(), rtol=1e-6)
    assert (got["label"][:20] == -1).all()


def test_grid_sums_use_no_frame_computed_anew_for_every_cell(spark):
    rng = np.random.default_rng(9)
    w = rng.integers(0, 4, (6, 8))
    rows = [(0, float(i), float(j), int(w[i, j])) for i in range(6) for j in range(8) if w[i, j]]
    scores = _grid_score(spark.createDataFrame(rows, "lane int, bx double, by double, w long"), 8, ["lane"])
    assert "rowframe, 1, unboundedfollowing$()" not in _plan(scores)
    want = sum(w[i, j] * (w[:i, :j].sum() - w[i + 1 :, :j].sum()) for i in range(6) for j in range(8))
    assert int(scores.agg(F.sum("score")).first()[0]) == want


def _points(spark, x):
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "pid long, vec array<double>, mult long").repartition(3)


def test_a_query_is_sent_once_for_a_block_and_not_for_every_cell(spark, monkeypatch):
    monkeypatch.setattr(nb, "ROWS_PER_PIVOT", 10)
    x = np.random.default_rng(2).normal(size=(300, 6))
    points = _points(spark, x)
    queries = points.select(F.col("pid").alias("qid"), "vec")
    sizes = lambda q, m: pd.DataFrame({"q": [len(q)], "m": [len(m)]})
    got = nb.tiles(queries, nb.plant(points, 3), 1e9, sizes, "q long, m long").toPandas()
    assert (got["m"] == 300).all() and got["q"].sum() == 300
    monkeypatch.setattr(nb, "BLOCK", 100)
    near = nb.nearest_points(queries.withColumn("own", F.col("qid")), points, 4, "bigint").toPandas()
    d = np.linalg.norm(x[:, None] - x, axis=2)
    np.fill_diagonal(d, np.inf)
    for i, some in near.groupby("qid"):
        assert some.sort_values("distance")["pid"].tolist() == np.argsort(d[i])[:4].tolist()
        np.testing.assert_allclose(np.sort(some["distance"]), np.sort(d[i])[:4], rtol=1e-13)


def test_pairs_of_one_group_are_not_measured_again(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=(900, 3)) * 0.05, rng.normal(size=(300, 3)) * 0.3 + 3]
    frame = pd.DataFrame({"vec": list(x), "cell": np.repeat([f"{i:02d}" for i in range(12)], 100)})
    tile, eps = nb.Near.of(frame, frame), 0.25
    measured = []
    real = nb.Near.pieces
    monkeypatch.setattr(nb.Near, "pieces", lambda t, rows, a, b: measured.append(len(rows) * (b - a)) or real(t, rows, a, b))
    group = cluster._tile_groups(tile, eps, (np.arange(len(x)), np.arange(len(x))))
    assert sum(measured) < len(x) ** 2 / 3
    near = np.linalg.norm(x[:, None] - x, axis=2) <= eps
    want = np.arange(len(x))
    while not np.array_equal(want, new := np.where(near, want, len(x)).min(axis=1)):
        want = new
    assert np.array_equal(group[: len(x)], want) and np.array_equal(group[len(x) :], want)
    gap = frame.head(200).copy()
    gap.at[150, "vec"] = np.full(3, np.nan)  # is near nothing and hides no other
    lists = nb.covering(gap.assign(own=-1, within=np.inf), gap.assign(pid=np.arange(200), mult=1), 2)
    assert np.array_equal(np.bincount(lists[0], minlength=200), np.where(np.arange(200) == 150, 0, 2)) and 150 not in lists[1]
    for rows, hit in tile.within(eps, np.arange(len(x)), 0, 100):
        assert np.array_equal(hit, near[rows, :100])


def test_isomap_keeps_one_row_of_distances_for_a_node(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(40, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", "a", "b", "c"])
    stored = []
    real = reduce.cut_lineage
    monkeypatch.setattr(reduce, "cut_lineage", lambda d: stored.append(real(d)) or stored[-1])
    placed = reduce.isomap(df, "id", ["a", "b", "c"], k=4, landmarks=5)
    assert placed.count() == 40 and "d4" in stored[-1].columns
    last = stored[-1].toPandas()
    assert len(last) == last["node"].nunique()
    d = np.linalg.norm(x[:, None] - x, axis=2)
    seats = np.argsort(d, axis=1)[:, 1:5]
    way = np.full((40, 40), np.inf)
    for i in range(40):
        way[i, seats[i]] = way[seats[i], i] = d[i, seats[i]]
    np.fill_diagonal(way, 0.0)
    for m in range(40):
        way = np.minimum(way, way[:, [m]] + way[[m]])
    last = last.set_index("node")
    for c in range(5):
        mark = last.index[last[f"d{c}"] == 0.0][0]
        np.testing.assert_allclose(last[f"d{c}"].reindex(range(40)).fillna(np.inf), way[mark], rtol=1e-12)


def test_buckets_by_binary_search_equal_whole_comparisons(spark):
    big = 2**60
    values = [None, float("-inf"), -2.5, -0.0, 0.0, 1.0, 1.0000000000000002, 7.0, float("inf"), float("nan")]
    doubles = spark.createDataFrame([(v, t) for v in values for t in range(4)], "v double, t int")
    longs = spark.createDataFrame([(v, t) for v in (None, -3, 0, big, big + 1, big + 2, 9) for t in range(4)], "v long, t int")
    for df in (doubles, longs, longs.selectExpr("cast(v as decimal(20,1)) + 0.3 as v", "t")):
        rows = [tuple(r) for r in df.orderBy("v", "t").collect()]
        columns = [F.col("v"), F.col("t")]
        here = F.struct(F.col("v").alias("o0"), F.col("t").alias("o1"))
        for points in (rows[2::3], rows[::7], rows[:3], rows[-3:]):
            want = _not_above(points, [df.dtypes[0][1], "int"], here)
            got = _with_bucket(df, points, columns, "b").select("b", want.cast("long").alias("w")).collect()
            assert len(got) == len(rows) and all(r["b"] == r["w"] for r in got)


def test_rows_find_their_bucket_by_binary_search(spark):
    assert "bucketizer" in _plan(bucketed(spark.range(500), ["id"], "b", 6))


def test_positions_shuffle_the_rows_once(spark):
    plan = _plan(with_position(spark.range(500), ["id"], buckets=6))
    assert "coalesce(_bucket" not in plan and "<=>" not in plan  # the rows' own buckets are the join's


def test_thinning_is_whole_number_arithmetic(spark):
    df = spark.range(1_003).withColumn("x", F.col("id") * 2.0).withColumn("y", -F.col("id").cast("double")).repartition(5)
    for limit in (2, 3, 97, 502, 1_002):
        few = chartdata.thinned(df, ["id"], limit)
        assert "decimal" not in _plan(few)
        assert {r["idx"] for r in few.collect()} == {i * 1_002 // (limit - 1) for i in range(limit)}
    assert {r["x"] for r in chartdata.pair_points(df, ["x", "y"], ["id"], 97).collect()} == {i * 1_002 // 96 * 2.0 for i in range(97)}


def test_values_of_few_input_splits_are_ordered_on_every_core(spark, monkeypatch):
    seen = []

    def watched(df, *args, **more):
        seen.append((df.rdd.getNumPartitions(), _plan(df)))
        return with_position(df, *args, **more)

    monkeypatch.setattr(select, "with_position", watched)
    df = spark.range(300).coalesce(1).selectExpr("id % 7 * 1.0 as a", "id * 1.0 as b", "id % 2 as y")
    got = select.knn_information(df, "y", ["a", "b"], k=1).collect()
    assert [r["rank"] for r in got] and len(got) == 2
    [(parts, plan)] = seen
    assert parts >= spark.sparkContext.defaultParallelism
    assert "range (0, 300" not in plan  # the input is not read again for every pass over its values
