"""Regression and multivariate statistics."""

from pyspark.sql import functions as F

from gaugewell.catalog.registry import query, r
from gaugewell.catalog.shared import document_features, embedding_columns, embedding_sql
from gaugewell.functions.columns import tidy
from gaugewell.operators import multivar, regress, robust


def _rounded(df, digits=6):
    return df.select(*[tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_XY = "select l_quantity x, l_extendedprice/1000 y, l_tax z from lineitem"


def _xy(load):
    return load("lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_tax").alias("z"), F.col("l_discount").alias("d"))


@query(
    "simple_linear",
    f"""with t as ({_XY}), s as (select count(*) n, regr_slope(y,x) b, regr_intercept(y,x) a, regr_r2(y,x) r2 from t),
    e as (select avg(abs(y-a-b*x)) mae, sqrt(avg(pow(y-a-b*x,2))) rmse from t, s)
    select n::bigint as n, {r('b')} as slope, {r('a')} as intercept, {r('r2',8)} as r_squared, {r('1-(1-r2)*(n-1)/(n-2)',8)} as adj_r_squared, {r('rmse')} as rmse, {r('mae')} as mae from s, e""",
)
def simple_linear(load):
    fit = regress.simple_linear(_xy(load), "x", "y")
    s = fit.summary(load("region").sparkSession)
    return s.select(
        "n", tidy(F.lit(float(fit.coefficients[0]))).alias("slope"), tidy(F.lit(fit.intercept)).alias("intercept"),
        tidy(F.col("r_squared"), 8).alias("r_squared"), tidy(F.col("adj_r_squared"), 8).alias("adj_r_squared"), tidy(F.col("rmse")).alias("rmse"), tidy(F.col("mae")).alias("mae"),
    )


@query("simple_linear_fitted", f"with t as (select l_orderkey, l_quantity x, l_extendedprice/1000 y from lineitem), s as (select regr_slope(y,x) b, regr_intercept(y,x) a from t) select l_orderkey, {r('a+b*x',5)} as fitted, {r('y-a-b*x',5)} as residual from t, s")
def simple_linear_fitted(load):
    df = _xy(load)
    fit = regress.simple_linear(df, "x", "y")
    return _rounded(regress.fitted(df, fit, "y").select("l_orderkey", "fitted", "residual"), 5)


_TWO = """s as (select count(*)::double n, avg(x) mx, avg(z) mz, avg(y) my, covar_pop(x,x) xx, covar_pop(z,z) zz, covar_pop(x,z) xz, covar_pop(x,y) xy, covar_pop(z,y) zy, var_pop(y) yy from t),
 b as (select *, (xy*zz-zy*xz)/(xx*zz-xz*xz) b1, (zy*xx-xy*xz)/(xx*zz-xz*xz) b2 from s), c as (select *, my-b1*mx-b2*mz b0 from b),
 e as (select avg(abs(y-b0-b1*x-b2*z)) mae, sum(pow(y-b0-b1*x-b2*z,2)) sse from t, c)"""


@query("multiple_linear", f"with t as ({_XY}), {_TWO} select 'intercept' as term, {r('b0',5)} as coefficient from c union all select 'x', {r('b1',5)} from c union all select 'z', {r('b2',5)} from c")
def multiple_linear(load):
    df = _xy(load)
    return regress.ols(df, ["x", "z"], "y").table(df.sparkSession).select("term", tidy(F.col("coefficient"), 5).alias("coefficient"))


@query(
    "multiple_linear_quality",
    f"""with t as ({_XY}), {_TWO} select n::bigint as n, {r('1-sse/(n*yy)',8)} as r_squared, {r('1-(sse/(n*yy))*(n-1)/(n-3)',8)} as adj_r_squared, {r('sqrt(sse/n)',5)} as rmse, {r('mae',5)} as mae,
    {r('6+n*(ln(2*pi())+ln(sse/n)+1)',2)} as aic, {r('3*ln(n)+n*(ln(2*pi())+ln(sse/n)+1)',2)} as bic from c, e""",
)
def multiple_linear_quality(load):
    df = _xy(load)
    s = regress.ols(df, ["x", "z"], "y").summary(df.sparkSession)
    digits = {"r_squared": 8, "adj_r_squared": 8, "rmse": 5, "mae": 5, "aic": 2, "bic": 2}
    return s.select("n", *[tidy(F.col(c), d).alias(c) for c, d in digits.items()])


@query("polynomial_regression", f"with t as (select x, x*x z, y from ({_XY})), {_TWO} select 'intercept' as term, {r('b0',4)} as coefficient from c union all select 'x_pow1', {r('b1',5)} from c union all select 'x_pow2', {r('b2',6)} from c")
def polynomial_regression(load):
    df = _xy(load)
    t = regress.polynomial(df, "x", "y").table(df.sparkSession)
    v = F.col("coefficient")
    return t.select("term", F.when(F.col("term") == "intercept", tidy(v, 4)).when(F.col("term") == "x_pow1", tidy(v, 5)).otherwise(tidy(v, 6)).alias("coefficient"))


@query(
    "ridge",
    f"""with t as ({_XY}), s as (select count(*)::double n, avg(x) mx, avg(z) mz, avg(y) my, covar_pop(x,x)*count(*)+100 xx, covar_pop(z,z)*count(*)+100 zz, covar_pop(x,z)*count(*) xz, covar_pop(x,y)*count(*) xy, covar_pop(z,y)*count(*) zy from t),
    b as (select *, (xy*zz-zy*xz)/(xx*zz-xz*xz) b1, (zy*xx-xy*xz)/(xx*zz-xz*xz) b2 from s)
    select 'intercept' as term, {r('my-b1*mx-b2*mz',5)} as coefficient from b union all select 'x', {r('b1',5)} from b union all select 'z', {r('b2',5)} from b""",
)
def ridge(load):
    df = _xy(load)
    return regress.ridge(df, ["x", "z"], "y", alpha=100.0).table(df.sparkSession).select("term", tidy(F.col("coefficient"), 5).alias("coefficient"))


@query(
    "lasso_one_feature",
    f"""with t as ({_XY}), s as (select avg(x) mx, avg(y) my, var_pop(x) xx, covar_pop(x,y) xy from t), b as (select *, sign(xy)*greatest(abs(xy)-0.5,0)/xx b1 from s)
    select 'intercept' as term, {r('my-b1*mx',5)} as coefficient from b union all select 'x', {r('b1',5)} from b""",
)
def lasso_one_feature(load):
    df = _xy(load)
    return regress.lasso(df, ["x"], "y", alpha=0.5).table(df.sparkSession).select("term", tidy(F.col("coefficient"), 5).alias("coefficient"))


@query("lasso")
def lasso(load):
    df = _xy(load)
    return regress.lasso(df, ["x", "z", "d"], "y", alpha=0.01).table(df.sparkSession)


@query(
    "elastic_net_one_feature",
    f"""with t as ({_XY}), s as (select avg(x) mx, avg(y) my, var_pop(x) xx, covar_pop(x,y) xy from t), b as (select *, sign(xy)*greatest(abs(xy)-0.25,0)/(xx+0.25) b1 from s)
    select 'intercept' as term, {r('my-b1*mx',5)} as coefficient from b union all select 'x', {r('b1',5)} from b""",
)
def elastic_net_one_feature(load):
    df = _xy(load)
    return regress.elastic_net(df, ["x"], "y", alpha=0.5).table(df.sparkSession).select("term", tidy(F.col("coefficient"), 5).alias("coefficient"))


@query("logistic_regression")
def logistic_regression(load):
    df = document_features(load)
    return regress.logistic(df, ["n_words", "digit_share", "upper_share"], "quality").table(df.sparkSession)


@query("logistic_probabilities")
def logistic_probabilities(load):
    df = document_features(load)
    fit = regress.logistic(df, ["n_words", "digit_share", "upper_share"], "quality")
    return regress.fitted(df, fit, "quality").select("doc_id", "fitted", (F.col("fitted") > 0.5).cast("int").alias("predicted"))


@query("poisson_regression")
def poisson_regression(load):
    per_user = load("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_share"))
    return regress.poisson(per_user, ["mean_value", "error_share"], "n", alpha=0.01).table(per_user.sparkSession)


@query(
    "regression_diagnostics",
    f"""with t as (select l_orderkey, l_linenumber, l_partkey, l_quantity x, l_extendedprice/1000 y from lineitem), s as (select count(*)::double n, avg(x) mx, regr_sxx(y,x) sxx, regr_slope(y,x) b, regr_intercept(y,x) a from t),
    e as (select *, y-a-b*x e, 1/n+pow(x-mx,2)/sxx h from t, s), v as (select sum(e*e)/(any_value(n)-2) s2 from e)
    select l_orderkey, l_linenumber, l_partkey, {r('e',4)} as residual, {r('h',8)} as leverage, {r('e/sqrt(s2*(1-h))',6)} as standardized_residual, {r('e*e*h/(2*s2*(1-h)*(1-h))',8)} as cooks_distance from e, v""",
)
def regression_diagnostics(load):
    df = load("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    d = regress.diagnostics(df, ["x"], "y")
    digits = {"residual": 4, "leverage": 8, "standardized_residual": 6, "cooks_distance": 8}
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *[tidy(F.col(c), n).alias(c) for c, n in digits.items()])


@query(
    "theil_sen",
    f"""with m as (select median((b.p_retailprice-a.p_retailprice)/(b.p_size-a.p_size)) s from part a join part b on a.p_size < b.p_size)
    select count(*)::bigint as n, {r('any_value(s)',6)} as slope, {r('median(p_retailprice)-any_value(s)*median(p_size)',4)} as intercept from part, m""",
)
def theil_sen(load):
    out = robust.theil_sen(load("part"), "p_size", "p_retailprice")
    return out.select("n", tidy(F.col("slope"), 6).alias("slope"), tidy(F.col("intercept"), 4).alias("intercept"))


@query("theil_sen_lineitem")
def theil_sen_lineitem(load):
    return robust.theil_sen(load("lineitem"), "l_quantity", "l_extendedprice")


@query(
    "mahalanobis",
    f"""with t as (select vec_id, e0 x, e1 z from ({embedding_sql(2)})), s as (select avg(x) mx, avg(z) mz, var_samp(x) xx, var_samp(z) zz, covar_samp(x,z) xz from t)
    select vec_id, {r('(pow(x-mx,2)*zz-2*(x-mx)*(z-mz)*xz+pow(z-mz,2)*xx)/(xx*zz-xz*xz)',5)} as distance_sq from t, s""",
)
def mahalanobis(load):
    d = multivar.mahalanobis(embedding_columns(load, 2), ["e0", "e1"])
    return _rounded(d.select("vec_id", "distance_sq"), 5)


_MARDIA = f"""with t as (select e0 as x, e1 as z from ({embedding_sql(2)})), c as (select count(*)::double as n, avg(x) as mx, avg(z) as mz, var_pop(x) as xx, var_pop(z) as zz, covar_pop(x, z) as xz from t),
 w as (select x - mx as x, z - mz as z, xx, zz, xz, xx * zz - xz * xz as det, n from t, c),
 g as (select pow((a.x * b.x * a.zz - (a.x * b.z + a.z * b.x) * a.xz + a.z * b.z * a.xx) / a.det, 3) as g from w a, w b),
 k as (select avg(pow((x * x * zz - 2 * x * z * xz + z * z * xx) / det, 2)) as k, any_value(n) as n from w)"""


@query("mardia_all_pairs", f"{_MARDIA} select 'skewness' as measure, n::bigint as n, {r('s', 5)} as value, {r('n * s / 6', 4)} as statistic from k, (select avg(g) as s from g) union all select 'kurtosis', n::bigint, {r('k', 5)}, {r('(k - 8) / sqrt(64 / n)', 4)} from k")
def mardia_all_pairs(load):
    """Two dimensions next to the n² pairs of the definition."""
    out = multivar.mardia(embedding_columns(load, 2), ["e0", "e1"])
    return out.select("measure", "n", tidy(F.col("value"), 5).alias("value"), tidy(F.col("statistic"), 4).alias("statistic"))


@query("multivariate_normality")
def multivariate_normality(load):
    return multivar.mardia(embedding_columns(load, 64), [f"e{i}" for i in range(64)])


@query(
    "hotelling",
    f"""with t as (select e0 x, e1 z from ({embedding_sql(2)})), s as (select count(*)::double n, avg(x) mx, avg(z) mz, var_samp(x) xx, var_samp(z) zz, covar_samp(x,z) xz from t),
    q as (select *, n*(mx*mx*zz-2*mx*mz*xz+mz*mz*xx)/(xx*zz-xz*xz) t2 from s) select n::bigint as n, {r('t2',5)} as statistic, {r('(n-2)*t2/(2*(n-1))',5)} as f, {r('2')} as df1, {r('n-2')} as df2 from q""",
)
def hotelling(load):
    return _rounded(multivar.hotelling(embedding_columns(load, 2), ["e0", "e1"]).drop("p_value"), 5)


@query(
    "manova",
    f"""with t as (select label g, e0 x, e1 z from ({embedding_sql(2, True)})), a as (select count(*) n, var_pop(x)*count(*) xx, var_pop(z)*count(*) zz, covar_pop(x,z)*count(*) xz from t),
    w as (select sum(xx) xx, sum(zz) zz, sum(xz) xz, count(*) k from (select var_pop(x)*count(*) xx, var_pop(z)*count(*) zz, covar_pop(x,z)*count(*) xz from t group by g)),
    l as (select a.n, w.k, (w.xx*w.zz-w.xz*w.xz)/(a.xx*a.zz-a.xz*a.xz) wl from a, w)
    select n::bigint as n, k::bigint as "groups", {r('wl',6)} as wilks_lambda, {r('(1-wl)/wl*((n-k-2+1)/(2.0*(k-1)))',4)} as f, {r('2*(k-1)')} as df1, {r('n-k-1')} as df2 from l""",
)
def manova(load):
    out = multivar.manova(embedding_columns(load, 2, True), ["e0", "e1"], "label").drop("p_value")
    return out.select("n", "groups", tidy(F.col("wilks_lambda"), 6).alias("wilks_lambda"), tidy(F.col("f"), 4).alias("f"), tidy(F.col("df1")).alias("df1"), tidy(F.col("df2")).alias("df2"))


@query(
    "pca_covariance",
    f"""with t as (select e0 x, e1 z from ({embedding_sql(2)})), s as (select var_samp(x) a, var_samp(z) b, covar_samp(x,z) c from t),
    l as (select (a+b)/2+sqrt(pow((a-b)/2,2)+c*c) l1, (a+b)/2-sqrt(pow((a-b)/2,2)+c*c) l2 from s)
    select 1::integer as component, {r('l1')} as eigenvalue, {r('l1/(l1+l2)')} as explained_ratio, {r('l1/(l1+l2)')} as cumulative_ratio from l union all select 2, {r('l2')}, {r('l2/(l1+l2)')}, {r('1')} from l""",
)
def pca_covariance(load):
    table, _ = multivar.pca_covariance(embedding_columns(load, 2), ["e0", "e1"])
    return _rounded(table.drop("loadings"))


_PC = f"""with t as (select vec_id, e0 as x, e1 as z from ({embedding_sql(2)})), c as (select avg(x) as mx, avg(z) as mz, var_samp(x) as xx, var_samp(z) as zz, covar_samp(x, z) as xz from t),
 e as (select *, (xx + zz) / 2 + sqrt(pow((xx - zz) / 2, 2) + xz * xz) as top from c), v as (select mx, mz, xz / sqrt(xz * xz + pow(top - xx, 2)) as a, (top - xx) / sqrt(xz * xz + pow(top - xx, 2)) as b from e)"""


@query("pca_score_sizes", f"{_PC} select vec_id, {r('abs((x - mx) * a + (z - mz) * b)', 5)} as pc1, {r('abs((z - mz) * a - (x - mx) * b)', 5)} as pc2 from t, v")
def pca_score_sizes(load):
    """Two dimensions, where the eigenvectors have a closed form; signs are free."""
    out = multivar.pca_covariance(embedding_columns(load, 2), ["e0", "e1"])[1]
    return out.select("vec_id", tidy(F.abs("pc1"), 5).alias("pc1"), tidy(F.abs("pc2"), 5).alias("pc2"))


@query("pca_scores")
def pca_scores(load):
    return multivar.pca_covariance(embedding_columns(load, 64), [f"e{i}" for i in range(64)])[1].select("vec_id", "pc1", "pc2")
