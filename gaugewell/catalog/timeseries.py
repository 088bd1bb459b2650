"""Time-series tests, trend, decomposition and forecasts."""

from pyspark.sql import functions as F

from gaugewell.catalog.registry import query, r
from gaugewell.functions.columns import tidy
from gaugewell.operators import forecast as fc
from gaugewell.operators import series as ts


def _rounded(df, digits=6):
    return df.select(*[tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def hourly(load):
    """Per event type, hourly sums of value: one series per type."""
    per = load("events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("total"))
    return ts.to_series(per, "h", ["total"], ["event_type"])


HOURLY = """p as (select event_type, date_trunc('hour', ts) h, sum(value) total from events group by 1,2),
 s as (select event_type, 'total' as series, h, total as value, row_number() over (partition by event_type order by h) - 1 as idx, count(*) over (partition by event_type) n, avg(total) over (partition by event_type) mean from p
   qualify count(*) over (partition by event_type) >= 10)"""


def daily(load):
    """Order value per day, one series."""
    per = load("orders").groupBy(F.date_trunc("day", "o_orderdate").alias("d")).agg(F.sum(F.col("o_totalprice") / 1e6).alias("total"))
    return ts.to_series(per, "d", ["total"])


DAILY = """p as (select date_trunc('day', o_orderdate) d, sum(o_totalprice/1e6) total from orders group by 1), s as (select 'total' as series, d, total as value, row_number() over (order by d) - 1 as idx, count(*) over () n, avg(total) over () mean from p)"""


@query("series_extraction", f"with {HOURLY} select event_type, series, idx::bigint as idx, n::bigint as n, {r('value',4)} as value from s")
def series_extraction(load):
    return _rounded(hourly(load).select("event_type", "series", "idx", "n", "value"), 4)


@query(
    "series_nullable_key",
    f"""with t as (select nullif(event_type, 'error') as kind, event_id, ts, value from events)
    select kind, event_id, (row_number() over (partition by kind order by ts, event_id) - 1)::bigint as idx, (count(*) over (partition by kind))::bigint as n from t""",
)
def series_nullable_key(load):
    rows = load("events").select(F.nullif(F.col("event_type"), F.lit("error")).alias("kind"), "ts", "event_id", F.col("event_id").cast("double").alias("id"))
    return ts.to_series(rows, "ts", ["id"], keys=["kind"], tie=["event_id"]).select("kind", F.col("value").cast("bigint").alias("event_id"), "idx", "n")


@query("series_raw_events", f"select event_id, (row_number() over (order by ts, event_id) - 1)::bigint as idx, {r('value',4)} as value from events")
def series_raw_events(load):
    """Every event of the table as one long series."""
    s = ts.to_series(load("events"), "ts", ["value"], tie=["event_id"])
    keyed = load("events").select("event_id", F.col("ts").alias("t"), "value")
    return _rounded(s.select("idx", "t", "value").join(keyed, ["t", "value"]).select("event_id", "idx", "value"), 4)


@query("adf_test")
def adf_test(load):
    return ts.adf(hourly(load))


@query("adf_schwert")
def adf_schwert(load):
    return ts.adf(daily(load), None)


@query(
    "kpss_test",
    f"""with {HOURLY}, e as (select *, value - mean as e, sum(value - mean) over (partition by event_type order by idx) as c from s),
    g as (select event_type, """ + ", ".join(f"sum(e * l{k}) g{k}" for k in range(1, 13)) + ", sum(e*e) g0, sum(c*c) eta, any_value(n)::double n from (select *, " + ", ".join(f"lag(e,{k}) over (partition by event_type order by idx) l{k}" for k in range(1, 13)) + f""" from e) group by 1)
    select event_type, 'total' as series, {r('eta/(n*n)/((g0 + 2*(' + ' + '.join(f'(1-{k}/13.0)*g{k}' for k in range(1, 13)) + '))/n)')} as statistic, 12::integer as lags from g""",
)
def kpss_test(load):
    return _rounded(ts.kpss(hourly(load)).select("event_type", "series", "statistic", "lags"))


@query("kpss_auto")
def kpss_auto(load):
    return ts.kpss(daily(load), None)


@query("stationarity_verdict")
def stationarity_verdict(load):
    return ts.stationarity(hourly(load))


@query("stationarity_report")
def stationarity_report(load):
    return ts.stationarity(daily(load), library_defaults=True)


@query(
    "linear_trend",
    f"""with {HOURLY}, g as (select event_type, count(*)::double n, regr_slope(value, idx) b, regr_intercept(value, idx) a, regr_r2(value, idx) r2, regr_sxx(value, idx) sxx, regr_syy(value, idx) syy from s group by 1)
    select event_type, n::bigint as n, {r('b')} as slope, {r('a',4)} as intercept, {r('r2')} as r_squared, {r('sqrt((syy-b*b*sxx)/(n-2)/sxx)')} as std_err, case when b > 0 then 'increasing' when b < 0 then 'decreasing' else 'flat' end as direction from g""",
)
def linear_trend(load):
    t = ts.linear_trend(hourly(load)).drop("p_value", "significant", "series")
    return t.select(*[tidy(F.col(c), 4 if c == "intercept" else 6).alias(c) if k == "double" else c for c, k in t.dtypes])


@query("fitted_trend", f"with {HOURLY}, g as (select event_type, regr_slope(value, idx) b, regr_intercept(value, idx) a from s group by 1) select event_type, idx::bigint as idx, {r('a+b*idx',4)} as trend from s join g using (event_type)")
def fitted_trend(load):
    return _rounded(ts.fitted_trend(hourly(load)).select("event_type", "idx", "trend"), 4)


@query(
    "moving_average_trend",
    f"with {HOURLY} select event_type, idx::bigint as idx, case when count(*) over w = 12 then {r('avg(value) over w',4)} end as trend from s window w as (partition by event_type order by idx rows between 6 preceding and 5 following)",
)
def moving_average_trend(load):
    return _rounded(ts.moving_average(hourly(load)).select("event_type", "idx", "trend"), 4)


@query("trend_slope", f"with {HOURLY}, m as (select event_type, idx, case when count(*) over w = 12 then avg(value) over w end as trend from s window w as (partition by event_type order by idx rows between 6 preceding and 5 following)) select event_type, count(trend)::bigint as points, {r('regr_slope(trend, idx)')} as slope, case when abs(regr_slope(trend, idx)) < 1e-6 then 'none' when regr_slope(trend, idx) > 0 then 'up' else 'down' end as direction from m group by 1")
def trend_slope(load):
    return _rounded(ts.trend_slope(ts.moving_average(hourly(load))).drop("series"))


@query("stl_trend")
def stl_trend(load):
    return ts.stl_trend(hourly(load)).select("event_type", "idx", "trend")


def _lag_sql(table, part, k):
    return f"select {'event_type, ' if part else ''}{k}::integer as lag, {r(f'corr(value, l)')} as autocorrelation, any_value(n) n from (select *, lag(value, {k}) over ({part} order by idx) l from s) {'group by 1' if part else ''}"


@query(
    "seasonality_flags",
    f"with {HOURLY}, c as (" + " union all ".join(_lag_sql("s", "partition by event_type", k) for k in (7, 30, 365)) + ") select event_type, lag, autocorrelation, abs(autocorrelation) > 0.3 as is_seasonal from c where n >= 24 and n >= 2*lag",
)
def seasonality_flags(load):
    return _rounded(ts.seasonality_flags(hourly(load)).select("event_type", "lag", "autocorrelation", "is_seasonal"))


@query(
    "seasonality_daily",
    f"with {DAILY}, c as (" + " union all ".join(_lag_sql("s", "", k) for k in (7, 30, 365)) + ") select lag, autocorrelation, abs(autocorrelation) > 0.3 as is_seasonal from c where n >= 24 and n >= 2*lag",
)
def seasonality_daily(load):
    return _rounded(ts.seasonality_flags(daily(load)).select("lag", "autocorrelation", "is_seasonal"))


_PERIOD = f"""with {DAILY}, l as (select unnest(range(2, least(least(365, any_value(n) // 2) + 1, any_value(n) // 2)))::int as lag from s),
 c as (select lag, abs(corr(a.value, b.value)) as size from l, s a join s b on true where b.idx = a.idx - lag group by lag),
 w as (select arg_max(lag, size) as lag, max(size) as size from c)"""


@query("seasonal_period", f"{_PERIOD} select 'total' as series, (select any_value(n) from s)::bigint as n, case when size > 0.3 then lag end as period, {r('size')} as strength from w")
def seasonal_period(load):
    return _rounded(ts.seasonal_period(daily(load)))


_ACF = "select {k}::integer as lag, sum(e * l)/any_value(g0) as acf from (select e, lag(e, {k}) over (order by idx) l, sum(e*e) over () g0 from (select idx, value - mean as e from s))"


@query("acf", f"with {DAILY} select 0::integer as lag, 1.0::double as acf union all " + " union all ".join(f"select lag, {r('acf')} as acf from ({_ACF.format(k=k)})" for k in range(1, 11)))
def acf(load):
    return _rounded(ts.acf(daily(load), 10).select("lag", "acf"))


@query("pacf")
def pacf(load):
    return ts.acf(hourly(load), 24)


_DEC = f"""with {HOURLY}, t as (select *, case when count(*) over f = 25 then (sum(value) over i + (first_value(value) over f + last_value(value) over f)/2)/24 end as trend from s
   window f as (partition by event_type order by idx rows between 12 preceding and 12 following), i as (partition by event_type order by idx rows between 11 preceding and 11 following)),
 l as (select event_type, regr_slope(trend, idx) filter (idx between 12 and 35) fs, regr_intercept(trend, idx) filter (idx between 12 and 35) fi, regr_slope(trend, idx) filter (idx between n-36 and n-13) bs, regr_intercept(trend, idx) filter (idx between n-36 and n-13) bi from t group by 1),
 f as (select t.* exclude (trend), coalesce(trend, case when idx < 12 then fi + fs*idx else bi + bs*idx end) as trend from t join l using (event_type)),
 m as (select event_type, idx % 24 as ph, avg(value - trend) m from f group by 1,2), c as (select *, m - avg(m) over (partition by event_type) as seasonal from m),
 d as (select f.event_type, f.idx, f.value, f.trend, c.seasonal, f.value - f.trend - c.seasonal as resid from f join c on f.event_type = c.event_type and f.idx % 24 = c.ph)"""


@query("classical_decomposition", _DEC + f" select event_type, idx::bigint as idx, {r('trend')} as trend, {r('seasonal')} as seasonal, {r('resid')} as resid from d")
def classical_decomposition(load):
    return _rounded(ts.decompose_classical(hourly(load), 24).select("event_type", "idx", "trend", "seasonal", "resid"))


@query("seasonal_strength", _DEC + f" select event_type, {r('var_pop(seasonal)/(var_pop(seasonal)+var_pop(resid))')} as strength, {r('corr(value, abs(seasonal))')} as level_correlation, case when corr(value, abs(seasonal)) > 0.3 then 'multiplicative' else 'additive' end as seasonality from d group by 1")
def seasonal_strength(load):
    return _rounded(ts.seasonal_strength(ts.decompose_classical(hourly(load), 24)).drop("series"))


@query("series_anomalies", _DEC + ", q as (select event_type, median(resid) md, mad(resid) mad from d group by 1) select event_type, idx::bigint as idx from d join q using (event_type) where abs(resid - md) > 3*mad")
def series_anomalies(load):
    return ts.anomaly_flags(ts.decompose_classical(hourly(load), 24)).where("is_anomaly").select("event_type", "idx")


@query("stl_decomposition")
def stl_decomposition(load):
    return ts.decompose_stl(hourly(load), 24).select("event_type", "idx", "trend", "seasonal", "resid")


@query("series_summary")
def series_summary(load):
    per = load("events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean_value"))
    return ts.series_summary(ts.analyze_series(per, "h", ["total", "events", "mean_value"]))


@query("arima_forecast")
def arima_forecast(load):
    return fc.arima(hourly(load))[0]


@query("arima_parameters")
def arima_parameters(load):
    return fc.arima(daily(load))[1].table


@query("arima_residuals")
def arima_residuals(load):
    return fc.residuals(fc.arima(hourly(load))[1]).select("event_type", "idx", "fitted", "resid")


_HOLT = f"""with recursive {HOURLY},
 b as (select event_type, -1::bigint as idx, max(value) filter (idx = 0) as level, max(value) filter (idx = 1) - max(value) filter (idx = 0) as slope, null::double as fitted, null::double as resid from s group by 1),
 f as (select * from b union all
       select event_type, idx, base + 0.3 * e, slope + 0.03 * e, base, e from (select s.event_type, s.idx::bigint as idx, f.level + f.slope as base, f.slope, s.value - f.level - f.slope as e from f join s on s.event_type = f.event_type and s.idx = f.idx + 1))"""


@query("smoothing_at_parameters", f"{_HOLT} select event_type, idx, case when idx >= 2 then {r('fitted', 4)} end as fitted, case when idx >= 2 then {r('resid', 4)} end as resid from f where idx >= 0")
def smoothing_at_parameters(load):
    """Level weight 0.3, slope weight 0.1 on every row."""
    got = fc.residuals(fc.at(hourly(load), fc.Smoothing(), [0.3, 0.1]))
    return _rounded(got.select("event_type", "idx", "fitted", "resid"), 4)


_ARMA = f"""with recursive {HOURLY},
 u as (select event_type, idx::bigint as idx, value, value - 5 - 0.4 * coalesce(lag(value) over (partition by event_type order by idx) - 5, 0) as u from s),
 f as (select event_type, idx, value, u as resid from u where idx = 0 union all
       select u.event_type, u.idx, u.value, u.u + 0.7 * f.resid from f join u on u.event_type = f.event_type and u.idx = f.idx + 1)"""


@query("arma_at_parameters", f"{_ARMA} select event_type, idx, case when idx >= 1 then {r('value - resid', 4)} end as fitted, case when idx >= 1 then {r('resid', 4)} end as resid from f")
def arma_at_parameters(load):
    """phi 0.4, theta -0.7 and mean 5 on every row."""
    got = fc.residuals(fc.at(hourly(load), fc.Arima((1, 0, 1)), [0.4, -0.7, 5.0]))
    return _rounded(got.select("event_type", "idx", "fitted", "resid"), 4)


_SEASONAL = f"""with recursive {HOURLY},
 g as (select event_type, avg(value) filter (idx < 24) as a, avg(value) filter (idx between 24 and 47) as b, list(value order by idx) filter (idx < 24) as head from s where n >= 49 group by 1),
 f as (select event_type, -1::bigint as idx, a as level, (b - a) / 24 as slope, list_transform(head, lambda x: x - a) as around, null::double as resid from g union all
       select event_type, idx, base + 0.2 * e, slope + 0.01 * e, list_concat(around[2:], [around[1] + 0.1 * e]), e
       from (select s.event_type, s.idx::bigint as idx, f.level + f.slope as base, f.slope, around, s.value - f.level - f.slope - around[1] as e from f join s on s.event_type = f.event_type and s.idx = f.idx + 1))"""


@query("seasonal_smoothing_errors", f"{_SEASONAL} select event_type, count(*) as m, {r('sum(resid * resid)', 3)} as sse, {r('avg(abs(resid))', 6)} as mae from f where idx >= 48 group by 1")
def seasonal_smoothing_errors(load):
    """Sums over all rows at level, slope and season weights 0.2, 0.05 and 0.1, period 24."""
    fitted = fc.at(hourly(load), fc.Smoothing(True, "add", 24), [0.2, 0.05, 0.1])
    return fitted.table.select("event_type", "m", F.round("sse", 3).alias("sse"), F.round("mae", 6).alias("mae"))


@query("sarima_forecast")
def sarima_forecast(load):
    return fc.sarima(hourly(load), 24, period=24)[0]


@query("stl_forecast")
def stl_forecast(load):
    return fc.stl_forecast(hourly(load), 24, period=24)


@query("holt_winters_forecast")
def holt_winters_forecast(load):
    return fc.holt_winters(hourly(load), 24, period=24)[0]


@query("simple_smoothing")
def simple_smoothing(load):
    return fc.simple_smoothing(hourly(load))[0]


@query("double_smoothing")
def double_smoothing(load):
    return fc.double_smoothing(hourly(load), damped=True)[0]


@query("triple_smoothing")
def triple_smoothing(load):
    return fc.triple_smoothing(hourly(load), 24, period=24, season="mul")[0]
