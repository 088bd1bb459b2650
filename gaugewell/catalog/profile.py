"""Descriptive statistics, correlation and per-column outliers."""

from pyspark.sql import functions as F

from gaugewell.catalog.registry import query, r
from gaugewell.catalog.shared import embedding_columns
from gaugewell.functions.columns import tidy
from gaugewell.operators import correlate, outliers
from gaugewell.operators import describe as d
from gaugewell.plans.quantiles import wide_quantiles

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(df, digits=6, keep=()):
    keep = set(keep)
    return df.select(*[tidy(F.col(c), digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _desc_sql(col, table, where="", group=""):
    m = f"select *, avg({col}) over () as m, var_pop({col}) over () as v from {table} {where}"
    return f"""select '{col}' as "column", count({col})::bigint as "count", {r(f'avg({col})',4)} as mean, {r(f'stddev_samp({col})',4)} as std,
    {r(f'min({col})',4)} as "min", {r(f'max({col})',4)} as "max", {r(f'quantile_cont({col},0.5)',4)} as median,
    {r(f'var_samp({col})/pow(10, 2*floor(log10(avg(abs({col}))+1e-9)))',4)} as variance,
    {r(f'avg(pow({col}-m,3))/pow(any_value(v),1.5)',4)} as skewness, {r(f'kurtosis_pop({col})',4)} as kurtosis,
    {r(f'quantile_cont({col},0.25)',4)} as percentile_25, {r(f'quantile_cont({col},0.5)',4)} as percentile_50,
    {r(f'quantile_cont({col},0.75)',4)} as percentile_75, {r(f'quantile_cont({col},0.95)',4)} as percentile_95,
    {r(f'quantile_cont({col},0.99)',4)} as percentile_99 from ({m})"""


def _desc_out(table):
    scale = F.pow(F.lit(10.0), 2 * F.floor(F.log10(F.col("abs_mean") + 1e-9)))
    return table, scale


@query("describe", " union all ".join(_desc_sql(c, "lineitem") for c in LINE))
def describe_lineitem(load):
    df = load("lineitem")
    out = d.describe(df, LINE)
    # Means are positive here, so the mean scales the variance before rounding.
    unit = F.pow(F.lit(10.0), 2 * F.floor(F.log10(F.col("mean") + 1e-9)))
    return _rounded(out.withColumn("variance", F.col("variance") / unit), 4)


@query(
    "describe_by_group",
    f"""select event_type, 'value' as "column", count(value)::bigint as "count", {r('avg(value)',4)} as mean, {r('stddev_samp(value)',4)} as std,
    {r('min(value)',4)} as "min", {r('max(value)',4)} as "max", {r('quantile_cont(value,0.5)',4)} as median,
    {r('quantile_cont(value,0.95)',4)} as percentile_95 from events group by 1""",
)
def describe_by_group(load):
    out = d.describe(load("events"), ["value"], by=["event_type"])
    return _rounded(out.select("event_type", "column", "count", "mean", "std", "min", "max", "median", "percentile_95"), 4)


@query(
    "describe_by_nullable_group",
    f"""select nullif(event_type, 'error') as kind, 'value' as "column", count(value)::bigint as "count", {r('avg(value)',4)} as mean,
    {r('quantile_cont(value,0.5)',4)} as median, {r('quantile_cont(value,0.95)',4)} as percentile_95 from events group by 1""",
)
def describe_by_nullable_group(load):
    rows = load("events").withColumn("kind", F.nullif(F.col("event_type"), F.lit("error")))
    return _rounded(d.describe(rows, ["value"], by=["kind"]).select("kind", "column", "count", "mean", "median", "percentile_95"), 4)


@query(
    "describe_percentiles_ends",
    f"select {r('min(l_extendedprice)',3)} as lowest, {r('quantile_cont(l_extendedprice,0.5)',3)} as middle, {r('max(l_extendedprice)',3)} as highest from lineitem",
)
def describe_percentiles_ends(load):
    """The ends and the middle by brackets, however few rows there are."""
    df = load("lineitem")
    [(low, mid, high)] = wide_quantiles(df, ["l_extendedprice"], [0.0, 0.5, 1.0], direct_rows=1000)
    return _rounded(df.sparkSession.createDataFrame([(low, mid, high)], "lowest double, middle double, highest double"), 3)


@query(
    "describe_percentiles",
    f"""select {r('quantile_cont(o_totalprice,0.01)',3)} as percentile_1, {r('quantile_cont(o_totalprice,0.1)',3)} as percentile_10,
    {r('quantile_cont(o_totalprice,0.29)',3)} as percentile_29, {r('quantile_cont(o_totalprice,0.9)',3)} as percentile_90 from orders""",
)
def describe_percentiles(load):
    out = d.describe(load("orders"), ["o_totalprice"], percentiles=(0.01, 0.1, 0.29, 0.9))
    return _rounded(out.select("percentile_1", "percentile_10", "percentile_29", "percentile_90"), 3)


@query(
    "describe_spread",
    " union all ".join(
        f"""select '{c}' as "column", {r(f'max({c})-min({c})',4)} as "range", {r(f'quantile_cont({c},0.75)-quantile_cont({c},0.25)',4)} as iqr,
        {r(f'case when avg({c})<>0 then stddev_samp({c})/abs(avg({c})) end',6)} as cv from lineitem"""
        for c in LINE
    ),
)
def describe_spread(load):
    s = d.spread(d.describe(load("lineitem"), LINE))
    return s.select("column", tidy(F.col("range"), 4).alias("range"), tidy(F.col("iqr"), 4).alias("iqr"), tidy(F.col("cv"), 6).alias("cv"))


@query(
    "modes",
    " union all ".join(
        f"""(select '{c}' as "column", cast({c} as varchar) as mode, count(*)::bigint as frequency from {t} where {c} is not null group by {c} order by 3 desc, {c} limit 1)"""
        for t, c in (("part", "p_brand"), ("part", "p_size"), ("part", "p_type"))
    ),
)
def modes(load):
    return d.modes(load("part"), ["p_brand", "p_size", "p_type"])


@query(
    "describe_summary",
    f"""with s as ({' union all '.join(f'select avg({c}) m, stddev_samp({c}) s from lineitem' for c in LINE)})
    select count(*)::bigint as columns_analyzed, {r('avg(m)',3)} as mean_of_means, {r('avg(s)',3)} as mean_of_stds from s""",
)
def describe_summary(load):
    return _rounded(d.describe_summary(d.describe(load("lineitem"), LINE)), 3)


@query(
    "corrected_shape",
    " union all ".join(
        f"""select '{c}' as "column", {r(f'skewness({c})',5)} as skewness_corrected, {r(f'kurtosis({c})',5)} as kurtosis_corrected from {t}"""
        for t, c in (("events", "value"),)
    ),
)
def corrected_shape(load):
    return _rounded(d.corrected_shape(d.describe(load("events"), ["value"])), 5)


@query(
    "profile_columns",
    " union all ".join(
        f"""select '{c}' as "column", (count(*)-count({c}))::bigint as null_count, count(distinct {c})::bigint as distinct_count,
        {str(c == 'ts').lower()} as is_time from events"""
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
)
def profile_columns(load):
    return d.profile_columns(load("events")).select("column", "null_count", "distinct_count", "is_time")


@query(
    "profile_table",
    """select count(*)::bigint as "rows", 6::bigint as columns, 3::bigint as numeric_columns, 2::bigint as text_columns, 1::bigint as time_columns,
    sum((case when value is null then 1 else 0 end)+(case when event_type is null then 1 else 0 end))::bigint as missing_cells from events""",
)
def profile_table(load):
    return d.profile_table(load("events")).drop("missing_percentage")


def _corr_sql(cols, table, fn="corr({a},{b})"):
    parts = []
    for a in cols:
        for b in cols:
            v = "1.0" if a == b else fn.format(a=a, b=b)
            parts.append(f"select '{a}' as column_a, '{b}' as column_b, {r(v, 6)} as correlation, count(case when {a} is not null and {b} is not null then 1 end)::bigint as n from {table}")
    return " union all ".join(parts)


@query("pearson_matrix", _corr_sql(LINE, "lineitem"))
def pearson_matrix(load):
    return _rounded(correlate.pearson(load("lineitem"), LINE))


@query(
    "pearson_with_nulls",
    "with t as (select nullif(l_discount, 0.0) as discount, nullif(l_tax, 0.0) as tax, l_quantity as quantity from lineitem) "
    + _corr_sql(["discount", "tax", "quantity"], "t"),
)
def pearson_with_nulls(load):
    df = load("lineitem").select(
        F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"), F.col("l_quantity").alias("quantity")
    )
    return _rounded(correlate.pearson(df))


@query(
    "pearson_wide",
    f"""with u as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings)
    select 'e' || a.i as column_a, 'e' || b.i as column_b, {r('corr(a.v, b.v)', 5)} as correlation, count(*)::bigint as n from u a join u b using (vec_id) group by a.i, b.i""",
)
def pearson_wide(load):
    """All 64 embedding columns, through the batch kernel."""
    df = embedding_columns(load, 64).drop("vec_id")
    return _rounded(correlate.pearson(df), 5)


def _rank(c):
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1)/2.0"


@query(
    "spearman_matrix",
    f"with t as (select {', '.join(f'{_rank(c)} as {c}' for c in LINE)} from lineitem) " + _corr_sql(LINE, "t"),
)
def spearman_matrix(load):
    return _rounded(correlate.spearman(load("lineitem"), LINE))


@query(
    "kendall_matrix",
    f"""with p as (select p_size as x, p_retailprice as y from part),
    k as (select sum(sign(a.x-b.x)*sign(a.y-b.y)) s, sum(abs(sign(a.x-b.x))) u, sum(abs(sign(a.y-b.y))) v from p a, p b),
    t as (select {r('s/sqrt(u*v)')} as tau, (select count(*) from p)::bigint as n from k)
    select 'p_size' as column_a, 'p_retailprice' as column_b, tau as correlation, n from t union all
    select 'p_retailprice', 'p_size', tau, n from t union all
    select 'p_size', 'p_size', 1.0, n from t union all select 'p_retailprice', 'p_retailprice', 1.0, n from t""",
)
def kendall_matrix(load):
    return _rounded(correlate.kendall(load("part"), ["p_size", "p_retailprice"]))


@query("correlation_lookup", f"select 'l_quantity' as column_a, 'l_extendedprice' as column_b, {r('corr(l_quantity,l_extendedprice)')} as correlation, count(*)::bigint as n from lineitem")
def correlation_lookup(load):
    return _rounded(correlate.lookup(correlate.pearson(load("lineitem"), LINE), "l_quantity", "l_extendedprice"))


PART = ["p_partkey", "p_size", "p_retailprice"]


@query(
    "high_correlations",
    f"""with m as ({_corr_sql(PART, 'part')}) select column_a, column_b, correlation from m where column_a < column_b and abs(correlation) >= 0.1""",
)
def high_correlations(load):
    return _rounded(correlate.high_pairs(correlate.pearson(load("part"), PART)))


@query(
    "correlation_summary",
    f"""with m as ({_corr_sql(LINE, 'lineitem')}) select count(*)::bigint as total_pairs, {r('max(abs(correlation))',5)} as max_correlation,
    {r('min(abs(correlation))',5)} as min_correlation, {r('avg(abs(correlation))',5)} as mean_correlation,
    count(case when abs(correlation)>=0.1 then 1 end)::bigint as high_correlations_count from m where column_a < column_b""",
)
def correlation_summary(load):
    return _rounded(correlate.summary(correlate.pearson(load("lineitem"), LINE)), 5)


@query("correlation_significance")
def correlation_significance(load):
    return _rounded(correlate.significance(correlate.pearson(load("lineitem"), LINE)))


def _t_sql(a, b):
    c = f"corr({a}, {b})"
    return f"select '{a}' as column_a, '{b}' as column_b, count(*)::bigint as n, {r(c)} as correlation, {r(f'{c} * sqrt((count(*) - 2) / (1 - {c} * {c}))', 4)} as t from lineitem"


@query("correlation_t", " union all ".join(_t_sql(a, b) for i, a in enumerate(sorted(LINE)) for b in sorted(LINE)[i + 1 :]))
def correlation_t(load):
    out = correlate.significance(correlate.pearson(load("lineitem"), LINE))
    return out.select("column_a", "column_b", F.col("n").cast("long").alias("n"), tidy(F.col("correlation"), 6).alias("correlation"), tidy(F.col("t"), 4).alias("t"))


def _iqr_sql(c, table):
    return f"""select '{c}' as "column", count(*)::bigint as "count", sum(case when {c} < lo or {c} > hi then 1 else 0 end)::bigint as outlier_count,
    {r(f'100.0*sum(case when {c} < lo or {c} > hi then 1 else 0 end)/count(*)',5)} as outlier_percentage, {r('any_value(q1)',4)} as q1, {r('any_value(q3)',4)} as q3,
    {r('any_value(q3-q1)',4)} as iqr, {r('any_value(lo)',4)} as lower_bound, {r('any_value(hi)',4)} as upper_bound
    from (select {c}, q1, q3, q1-1.5*(q3-q1) as lo, q3+1.5*(q3-q1) as hi from {table},
      (select quantile_cont({c},0.25) q1, quantile_cont({c},0.75) q3 from {table}))"""


IQR_SQL = _iqr_sql("value", "events") + " union all " + _iqr_sql("user_id", "events")


@query("outliers_iqr", IQR_SQL)
def outliers_iqr(load):
    t = outliers.iqr_table(load("events"), ["value", "user_id"])
    return t.select(*[tidy(F.col(c), 5 if c == "outlier_percentage" else 4).alias(c) if k == "double" else c for c, k in t.dtypes])


@query(
    "outliers_zscore",
    f"""with s as (select avg(value) m, stddev_pop(value) s from events)
    select 'value' as "column", count(*)::bigint as "count", sum(case when abs(value-m)/s > 3 then 1 else 0 end)::bigint as outlier_count,
    {r('100.0*sum(case when abs(value-m)/s > 3 then 1 else 0 end)/count(*)',5)} as outlier_percentage, {r('any_value(m)',5)} as mean, {r('any_value(s)',5)} as std,
    {r('max(abs(value-m)/s)',5)} as max_z_score from events, s""",
)
def outliers_zscore(load):
    return _rounded(outliers.zscore_table(load("events"), ["value"]), 5)


@query(
    "outlier_rows",
    f"""with f as (select quantile_cont(value,0.25) q1, quantile_cont(value,0.75) q3 from events)
    select event_id, 'value' as "column", {r('value',4)} as value from events, f where value < q1-1.5*(q3-q1) or value > q3+1.5*(q3-q1)""",
)
def outlier_rows(load):
    return _rounded(outliers.outlier_rows(load("events"), ["event_id"], ["value"]), 4)


@query(
    "outlier_summary",
    f"""with t as ({IQR_SQL}) select sum(outlier_count)::bigint as total_outliers, count(case when outlier_count>0 then 1 end)::bigint as columns_affected,
    {r('avg(outlier_percentage)',4)} as mean_outlier_percentage from t""",
)
def outlier_summary(load):
    return _rounded(outliers.outlier_summary(outliers.iqr_table(load("events"), ["value", "user_id"])), 4)
