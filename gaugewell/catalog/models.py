"""Supervised models, clustering and row-level anomalies."""

from pyspark.sql import functions as F

from gaugewell.catalog.registry import query, r
from gaugewell.catalog.shared import distance_sql, document_features, embedding_columns, embedding_sql
from gaugewell.functions.columns import tidy
from gaugewell.operators import anomaly, cluster, learn
from gaugewell.plans.neighbors import knn

E8 = [f"e{i}" for i in range(8)]
E64 = [f"e{i}" for i in range(64)]
DOC = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share"]


def _rounded(df, digits=6):
    return df.select(*[tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- preparation -----------------------------------------------------------


@query("feature_preparation", "select p_partkey, p_size::double as p_size, p_retailprice, (dense_rank() over (order by p_type) - 1)::double as label from part")
def feature_preparation(load):
    rows = learn.prepare(load("part"), "p_type", ["p_size", "p_retailprice"], ["p_partkey"])
    return learn.label_encoded(rows, "p_type")[0].drop("p_type")


@query("impute_mean", f"with t as (select event_id, case when event_type <> 'error' then value end v from events) select event_id, {r('coalesce(v,(select avg(v) from t))')} as v from t")
def impute_mean(load):
    df = load("events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    rows, _ = anomaly.prepared(df, ["event_id"], ["v"])
    return _rounded(rows)


@query("train_test_split", "select label::varchar as label, count(*)::bigint as n, round(count(*)*0.2)::bigint as n_test from (select event_type as label from events) group by 1")
def train_test_split(load):
    df = learn.train_test(load("events").select("event_id", F.col("event_type").alias("label")), ["event_id"], 0.2, "label")
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_test"), 1)).alias("n_test"))


@query("feature_scaling", f"select event_id, {r('(value-m)/s')} as value from events, (select avg(value) m, stddev_pop(value) s from events)")
def feature_scaling(load):
    df = load("events")
    return _rounded(learn.fit_scaler(df, ["value"]).apply(df).select("event_id", "value"))


# ---- supervised ------------------------------------------------------------


def _classify(load, model, **options):
    run = learn.run_classification(document_features(load), "quality", ["doc_id"], DOC, model=model, folds=0, **options)
    return run.predictions.select("doc_id", "actual", "predicted")


@query("random_forest_classifier")
def random_forest_classifier(load):
    return _classify(load, "random_forest", trees=100)


@query("logistic_classifier")
def logistic_classifier(load):
    return _classify(load, "logistic")


@query("svm_classifier")
def svm_classifier(load):
    return _classify(load, "svm")


@query("naive_bayes_classifier")
def naive_bayes_classifier(load):
    return _classify(load, "naive_bayes")


@query(
    "naive_bayes_table",
    f"with t as ({embedding_sql(3, True)}) " + " union all ".join(f"select label as class, count(*)::bigint as n, 'e{i}' as feature, {r(f'avg(e{i})')} as mean, {r(f'var_pop(e{i})')} as variance from t group by label" for i in range(3)),
)
def naive_bayes_table(load):
    return _rounded(learn.gaussian_nb_table(embedding_columns(load, 3, True), "label", ["e0", "e1", "e2"]))


@query("decision_tree_classifier")
def decision_tree_classifier(load):
    return _classify(load, "decision_tree")


@query("gradient_boosting_classifier")
def gradient_boosting_classifier(load):
    return _classify(load, "gradient_boosting")


def _nearest_sql(k, train, test, value):
    return f"""d as (select s.key, t.key tk, {value} y, abs(s.x - t.x) d from {test} s, {train} t), k as (select *, row_number() over (partition by key order by d, tk) rn from d qualify rn <= {k})"""


_KNN_TABLES = "s as (select s_suppkey key, s_acctbal x from supplier), t as (select c_custkey key, c_acctbal x, c_mktsegment seg, c_nationkey nat from customer)"


def _train(load):
    return load("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").cast("double").alias("nat"))


def _test(load):
    return load("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("x"))


@query(
    "knn_classifier",
    f"with {_KNN_TABLES}, {_nearest_sql(5, 't', 's', 't.seg')}, v as (select key, y, count(*) c from k group by 1,2) select key, arg_min(y, (-c, y)) as prediction from (select *, {{'a': -c, 'b': y}} o from v) group by key".replace("arg_min(y, (-c, y))", "min(o).b"),
)
def knn_classifier(load):
    return learn.knn_predict(_train(load), _test(load), "key", ["x"], "seg", 5)


@query("knn_regressor", f"with {_KNN_TABLES}, {_nearest_sql(5, 't', 's', 't.nat')} select key, {r('avg(y)')} as prediction from k group by key")
def knn_regressor(load):
    return _rounded(learn.knn_predict(_train(load), _test(load), "key", ["x"], "nat", 5, classes=False))


@query(
    "nearest_neighbors",
    f"with t as ({embedding_sql(64)}), d as (select a.vec_id as key, b.vec_id as neighbor, {distance_sql(64)} as distance from t a join t b on a.vec_id <> b.vec_id) select key, neighbor, {r('distance',5)} as distance from d qualify row_number() over (partition by key order by distance) <= 5",
)
def nearest_neighbors(load):
    return _rounded(knn(embedding_columns(load, 64), "vec_id", [f"e{i}" for i in range(64)], 5), 5)


def _part(load):
    return load("part").withColumn("brand_no", F.regexp_extract("p_brand", r"(\d+)", 1).cast("double"))


def _run(load, model, **options):
    run = learn.run_regression(_part(load), "p_retailprice", ["p_partkey"], ["p_size", "brand_no"], model=model, folds=0, **options)
    return run.predictions


@query("random_forest_regressor")
def random_forest_regressor(load):
    return _run(load, "random_forest")


@query("linear_regressor")
def linear_regressor(load):
    return _run(load, "linear")


@query("ridge_regressor")
def ridge_regressor(load):
    return _run(load, "ridge")


@query("lasso_regressor")
def lasso_regressor(load):
    return _run(load, "lasso", alpha=0.1)


@query("svm_regressor")
def svm_regressor(load):
    return _run(load, "svm")


@query("decision_tree_regressor")
def decision_tree_regressor(load):
    return _run(load, "decision_tree")


@query("grid_search")
def grid_search(load):
    return learn.grid_search(document_features(load), "quality", ["doc_id"], DOC, "logistic")


@query("cross_validation")
def cross_validation(load):
    return learn.run_classification(document_features(load), "quality", ["doc_id"], DOC, model="logistic", folds=5).cross_validation


@query("feature_importance")
def feature_importance(load):
    return learn.run_classification(document_features(load), "quality", ["doc_id"], DOC, model="random_forest", folds=0).importance


@query("classification_run")
def classification_run(load):
    return learn.run_classification(document_features(load), "quality", ["doc_id"], DOC, model="naive_bayes", folds=3).metrics


@query("regression_run")
def regression_run(load):
    return learn.run_regression(_part(load), "p_retailprice", ["p_partkey"], ["p_size", "brand_no"], model="linear", folds=3).metrics


_PRED = "select quality::varchar as a, (case when length(text) > 1000 then 1 else 0 end)::varchar as p from documents join labels using (doc_id)"


def _rule(load):
    """Length as a stand-in prediction of quality: metrics with an SQL twin."""
    return load("documents").join(load("labels"), "doc_id").select("quality", (F.length("text") > 1000).cast("int").alias("p"))


@query("confusion_counts", f"select a as actual, p as predicted, count(*)::bigint as n from ({_PRED}) group by 1,2")
def confusion_counts(load):
    return learn.confusion(_rule(load), "quality", "p")


@query(
    "classification_metrics",
    f"""with t as ({_PRED}), k as (select distinct a c from t union select distinct p from t), m as (select c, (select count(*) from t where a=c and p=c)::double tp, (select count(*) from t where a=c)::double ac, (select count(*) from t where p=c)::double pc from k),
    f as (select *, case when pc>0 then tp/pc else 0 end pr, case when ac>0 then tp/ac else 0 end re from m)
    select {r('sum(tp)/sum(ac)')} as accuracy, {r('avg(pr)')} as "precision", {r('avg(re)')} as recall, {r('avg(case when pr+re>0 then 2*pr*re/(pr+re) else 0 end)')} as f1_score from f""",
)
def classification_metrics(load):
    return _rounded(learn.classification_metrics(_rule(load), "quality", "p"))


@query(
    "regression_metrics",
    f"with t as (select l_extendedprice/1000 y, l_quantity*2 p from lineitem) select {r('1-sum(pow(y-p,2))/(var_pop(y)*count(*))')} as r2, {r('avg(pow(y-p,2))',4)} as mse, {r('sqrt(avg(pow(y-p,2)))',5)} as rmse, {r('avg(abs(y-p))',5)} as mae from t",
)
def regression_metrics(load):
    df = load("lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 2).alias("p"))
    m = learn.regression_metrics(df, "y", "p")
    return m.select(tidy(F.col("r2")).alias("r2"), tidy(F.col("mse"), 4).alias("mse"), tidy(F.col("rmse"), 5).alias("rmse"), tidy(F.col("mae"), 5).alias("mae"))


# ---- clustering ------------------------------------------------------------


@query("kmeans")
def kmeans(load):
    return cluster.kmeans(embedding_columns(load, 64), "vec_id", E64, 3)[1]


def _grid2(load):
    return load("part").select("p_partkey", "p_size", "p_retailprice")


_SC = "select p_partkey k, (p_size - avg(p_size) over ())/stddev_pop(p_size) over () x, (p_retailprice - avg(p_retailprice) over ())/stddev_pop(p_retailprice) over () y from part"
_CORE = f"with t as ({_SC}), n as (select a.k, count(*) c from t a join t b on pow(a.x-b.x,2)+pow(a.y-b.y,2) <= 0.0081 group by a.k), c as (select t.* from t join n using (k) where c >= 5)"


@query("dbscan_core_and_noise", _CORE + ", e as (select distinct t.k from t join c on pow(t.x-c.x,2)+pow(t.y-c.y,2) <= 0.0081) select t.k as p_partkey, (c.k is not null) as core, (e.k is null) as noise from t left join c using (k) left join e using (k)")
def dbscan_core_and_noise(load):
    out = cluster.dbscan(_grid2(load), "p_partkey", ["p_size", "p_retailprice"], eps=0.09)
    return out.select("p_partkey", "core", (F.col("cluster") < 0).alias("noise"))


@query("dbscan_embeddings")
def dbscan_embeddings(load):
    return cluster.dbscan(embedding_columns(load, 4), "vec_id", ["e0", "e1", "e2", "e3"], eps=0.5)


@query("hierarchical")
def hierarchical(load):
    return cluster.hierarchical(embedding_columns(load, 64), "vec_id", E64, 3)


@query("clustering_run")
def clustering_run(load):
    return cluster.run_clustering(embedding_columns(load, 64), "vec_id", E64, "kmeans", k=3)[0]


# ---- anomalies -------------------------------------------------------------


_AN = "(select avg(value) m, stddev_pop(value) s, avg(user_id) mu, stddev_pop(user_id) su from events)"


@query("anomaly_zscore", f"select event_id, case when greatest(abs(value-m)/s, abs(user_id-mu)/su) > 3 then -1 else 1 end::integer as label, {r('greatest(abs(value-m)/s, abs(user_id-mu)/su)',5)} as score from events, {_AN}")
def anomaly_zscore(load):
    return _rounded(anomaly.detect_anomalies(load("events"), "event_id", "zscore", ["value", "user_id"]), 5)


@query(
    "anomaly_iqr",
    f"""with q as (select quantile_cont(value,0.25) a, quantile_cont(value,0.75) b, quantile_cont(user_id,0.25) c, quantile_cont(user_id,0.75) d from events),
    s as (select event_id, greatest(a-1.5*(b-a)-value, value-b-1.5*(b-a), c-1.5*(d-c)-user_id, user_id-d-1.5*(d-c), 0.0) s from events, q)
    select event_id, case when s > 0 then -1 else 1 end::integer as label, {r('s',5)} as score from s""",
)
def anomaly_iqr(load):
    return _rounded(anomaly.detect_anomalies(load("events"), "event_id", "iqr", ["value", "user_id"]), 5)


@query(
    "anomaly_modified_zscore",
    f"""with q as (select median(value) a, mad(value) b, median(user_id) c, mad(user_id) d from events), s as (select event_id, greatest(0.6745*abs(value-a)/b, 0.6745*abs(user_id-c)/d) s from events, q)
    select event_id, case when s > 3.5 then -1 else 1 end::integer as label, {r('s',8)} as score from s""",
)
def anomaly_modified_zscore(load):
    return _rounded(anomaly.detect_anomalies(load("events"), "event_id", "modified_zscore", ["value", "user_id"]), 8)


@query("anomaly_isolation_forest")
def anomaly_isolation_forest(load):
    return anomaly.isolation_forest(load("lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), ["key"], ["l_quantity", "l_extendedprice", "l_discount"])


@query("outliers_isolation_forest")
def outliers_isolation_forest(load):
    from gaugewell.operators.outliers import outlier_rows

    return outlier_rows(load("events"), ["event_id"], ["value"], method="isolation_forest")


@query("anomaly_one_class_svm")
def anomaly_one_class_svm(load):
    return anomaly.one_class_svm(load("events"), ["event_id"], ["value", "user_id"])


_LOF_K = 20


@query(
    "anomaly_lof",
    f"""with t as ({embedding_sql(8)}), d as (select a.vec_id i, b.vec_id j, {distance_sql(8)} d from t a join t b on a.vec_id <> b.vec_id),
    k as (select i, j, d from d qualify row_number() over (partition by i order by d, j) <= {_LOF_K}), kd as (select i, max(d) kd from k group by i),
    lr as (select k.i, 1/(avg(greatest(k.d, kd.kd))+1e-10) lrd from k join kd on kd.i = k.j group by k.i), l as (select k.i, avg(o.lrd)/any_value(s.lrd) lof from k join lr o on o.i = k.j join lr s on s.i = k.i group by k.i)
    select i as vec_id, case when lof > (select quantile_cont(lof, 0.9) from l) then -1 else 1 end::integer as label, {r('lof',5)} as score from l""",
)
def anomaly_lof(load):
    return _rounded(anomaly.local_outlier_factor(embedding_columns(load, 8), "vec_id", E8, _LOF_K), 5)


@query("anomaly_elliptic_envelope")
def anomaly_elliptic_envelope(load):
    return anomaly.elliptic_envelope(embedding_columns(load, 64), ["vec_id"], E64)


_NOISE = f"with t as ({embedding_sql(3)}), n as (select a.vec_id i, count(*) c from t a join t b on {distance_sql(3)} <= 0.08 group by 1), c as (select t.* from t join n on n.i = t.vec_id where c >= 5)"


@query("anomaly_dbscan", _NOISE + f", m as (select a.vec_id, min({distance_sql(3)}) d, bool_or(a.vec_id = b.vec_id) core from t a, c b group by 1) select vec_id, case when d > 0.08 then -1 else 1 end::integer as label, {r('d',6)} as score from m")
def anomaly_dbscan(load):
    return _rounded(anomaly.dbscan_noise(embedding_columns(load, 3), "vec_id", ["e0", "e1", "e2"], eps=0.08))
