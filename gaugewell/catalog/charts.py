"""Chart data, the whole analysis and the run log."""

from pyspark.sql import functions as F

from gaugewell.catalog.registry import query, r
from gaugewell.functions.columns import tidy
from gaugewell.operators import analysis, chartdata, runlog
from gaugewell.session import scratch_path


def _rounded(df, digits=6):
    return df.select(*[tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _hist(c, t):
    return f"""select '{c}' as "column", g.bin::integer as bin, {r('lo + g.bin*w',4)} as left_edge, {r('lo + (g.bin+1)*w',4)} as right_edge, coalesce(k.c, 0)::bigint as "count"
    from (select unnest(range(30)) as bin) g, (select min({c})::double lo, (max({c})-min({c}))::double/30 w from {t}) m
    left join (select least(floor(({c}-lo)/w), 29) b, count(*) c from {t}, (select min({c})::double lo, (max({c})-min({c}))::double/30 w from {t}) group by 1) k on k.b = g.bin"""


@query("histogram", _hist("value", "events") + " union all " + _hist("user_id", "events"))
def histogram(load):
    return _rounded(chartdata.histogram(load("events"), ["value", "user_id"]), 4)


def _box(c, t):
    return f"""select '{c}' as "column", {r('any_value(q1)',4)} as q1, {r('any_value(md)',4)} as median, {r('any_value(q3)',4)} as q3, {r(f'min(case when {c} >= lo then {c} end)',4)} as whisker_low,
    {r(f'max(case when {c} <= hi then {c} end)',4)} as whisker_high, sum(case when {c} < lo or {c} > hi then 1 else 0 end)::bigint as fliers
    from (select {c}, q1, md, q3, q1-1.5*(q3-q1) lo, q3+1.5*(q3-q1) hi from {t}, (select quantile_cont({c},0.25) q1, median({c}) md, quantile_cont({c},0.75) q3 from {t}))"""


@query("box_statistics", _box("value", "events") + " union all " + _box("user_id", "events"))
def box_statistics(load):
    return _rounded(chartdata.box(load("events"), ["value", "user_id"]), 4)


_H = ("l_quantity", "l_extendedprice", "l_discount")


@query("heatmap", " union all ".join(f"select '{a}' as column_a, '{b}' as column_b, {r(f'corr({a},{b})' if a != b else 'max(1.0)')} as correlation from lineitem" for a in _H for b in _H))
def heatmap(load):
    return _rounded(chartdata.heatmap(load("lineitem"), list(_H)).drop("label"))


@query(
    "thinned_points",
    """with t as (select *, row_number() over (order by o_orderdate, o_orderkey) - 1 as idx, count(*) over () n from orders), k as (select distinct (i*(n-1))//9999 as idx from (select unnest(range(10000)) i), (select any_value(n) n from t))
    select o_orderkey, t.idx::bigint as idx from t join k using (idx)""",
)
def thinned_points(load):
    return chartdata.thinned(load("orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "idx")


@query("bars", f"select l_returnflag as category, {r('sum(l_quantity)',2)} as value from lineitem group by 1")
def bars(load):
    return _rounded(chartdata.bars(load("lineitem"), "l_returnflag", "l_quantity"), 2)


@query("comparison_bars", f"select l_returnflag as category, {r(chr(39).join(['sum(case when l_linestatus=','F',' then l_quantity end)']),2)} as \"F\", {r(chr(39).join(['sum(case when l_linestatus=','O',' then l_quantity end)']),2)} as \"O\" from lineitem group by 1")
def comparison_bars(load):
    return _rounded(chartdata.comparison(load("lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"]), 2)


@query("time_line", f"select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, {r('avg(value)',5)} as value from events group by 1")
def time_line(load):
    t = chartdata.time_line(load("events"), "ts", "value")
    return t.select(F.date_format("at", "yyyy-MM-dd").alias("day"), tidy(F.col("value"), 5).alias("value"))


@query("box_selection", "select count(*)::bigint as n from orders where o_totalprice between 100000 and 200000 and o_orderdate between timestamp '1996-01-01' and timestamp '1998-12-31'")
def box_selection(load):
    import datetime as dt

    return chartdata.span_selection(load("orders"), {"o_totalprice": (100000.0, 200000.0), "o_orderdate": (dt.datetime(1996, 1, 1), dt.datetime(1998, 12, 31))}).agg(F.count(F.lit(1)).alias("n"))


_DENSITY = """with q as (select count(value)::double as n, min(value) as lo, max(value) as hi, stddev_samp(value) * pow(count(value), -0.2) as h from events),
 b as (select floor((value - lo) / (h / 32)) as bin, count(*) as c, avg(value) as centre from events, q where value is not null group by 1),
 g as (select i * ((hi - lo + 2 * h) / 99) + lo - h as x from range(100) t(i), q)"""


@query("density_curve", f"{_DENSITY} select {r('x', 4)} as x, {r('sum(c * exp(-0.5 * pow((x - centre) / h, 2))) / any_value(n * h * sqrt(2 * pi()))', 8)} as density from g, b, q group by x")
def density_curve(load):
    return chartdata.density(load("events"), "value").select(tidy(F.col("x"), 4).alias("x"), tidy(F.col("density"), 8).alias("density"))


def _pair_sql(a, b, bins=50):
    place = lambda c: f"least(floor(({c} - (select min({c}) from lineitem)) / (((select max({c}) from lineitem) - (select min({c}) from lineitem)) / {bins})), {bins - 1})::int"
    return f"select '{a}' as column_a, '{b}' as column_b, {place(a)} as bin_a, {place(b)} as bin_b, count(*)::bigint as \"count\" from lineitem group by all"


@query("pair_bins", " union all ".join([_pair_sql("l_quantity", "l_extendedprice"), _pair_sql("l_quantity", "l_discount"), _pair_sql("l_extendedprice", "l_discount")]))
def pair_bins(load):
    return chartdata.pair_bins(load("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("pair_points")
def pair_points(load):
    return chartdata.pair_points(load("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


# ---- whole analysis --------------------------------------------------------


@query(
    "full_analysis_summary",
    f"""with d as (select avg(value) m, stddev_samp(value) s, avg(user_id) m2, stddev_samp(user_id) s2, corr(value, user_id) c from events)
    select 'describe' as part, 'columns_analyzed' as metric, 2.0::double as value union all select 'describe','mean_of_means',{r('(m+m2)/2',4)} from d union all select 'describe','mean_of_stds',{r('(s+s2)/2',4)} from d
    union all select 'correlation','total_pairs',1.0 union all select 'correlation','max_correlation',{r('abs(c)',4)} from d union all select 'correlation','min_correlation',{r('abs(c)',4)} from d
    union all select 'correlation','mean_correlation',{r('abs(c)',4)} from d union all select 'correlation','high_correlations_count',case when abs(c)>=0.1 then 1.0 else 0.0 end from d""",
)
def full_analysis_summary(load):
    a = analysis.analyze(load("events").select("value", "user_id"))
    s = analysis.overall_summary(a).where(F.col("part").isin("describe", "correlation"))
    return _rounded(s, 4)


@query("full_analysis_series")
def full_analysis_series(load):
    per = load("events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("events"))
    return analysis.overall_summary(analysis.analyze(per, "h"))


# ---- run log ---------------------------------------------------------------


def run_records(load):
    """Every event read as a version of its user's analysis record."""
    e = load("events")
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "purchase", "completed").when(kind == "signup", "pending").when(kind == "click", "running").otherwise("cancelled")
    number = F.get_json_object("props", "$.k").cast("int")
    config = F.to_json(F.struct(F.when(number < 50, "pearson").otherwise("spearman").alias("correlation_method"), F.lit("iqr").alias("outlier_method"), F.lit(3.0).alias("outlier_threshold")))
    message = F.when(kind == "error", F.when(number < 30, "FileNotFoundError: no such file").when(number < 60, "java: Out of Memory").otherwise("unexpected"))
    at = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("analysis_id"), F.concat(kind, F.lit(".csv")).alias("file_name"),
        F.concat(F.lit("/data/"), kind, F.lit("/"), number.cast("string")).alias("file_path"), (number * 100000).cast("bigint").alias("file_size"), F.md5(kind).alias("file_hash"),
        config.alias("analysis_config"), F.lit("comprehensive").alias("analysis_type"), F.lit(None).cast("string").alias("time_column"), status.alias("status"), message.alias("error_message"),
        F.round(F.col("value") * 1000).cast("bigint").alias("execution_time_ms"), F.lit(None).cast("string").alias("result_summary"), at.alias("created_at"), at.alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), F.lit(None).cast("string").alias("result_file_path"), F.lit(None).cast("string").alias("chart_files"), F.col("event_id").alias("version"),
    )


_K = "cast(json_extract_string(props, '$.k') as int)"
_LOG = f"""l as (select event_id as id, 'run-' || user_id as analysis_id, event_type || '.csv' as file_name, '/data/' || event_type || '/' || {_K} as file_path, {_K}::bigint*100000 as file_size, md5(event_type) as file_hash,
 case when {_K} < 50 then 'pearson' else 'spearman' end as method, case event_type when 'error' then 'failed' when 'purchase' then 'completed' when 'signup' then 'pending' when 'click' then 'running' else 'cancelled' end as status,
 case when event_type = 'error' then case when {_K} < 30 then 'f' when {_K} < 60 then 'm' else 'u' end end as err, round(value*1000)::bigint as ms, ts as created_at from events),
 v as (select * from l qualify row_number() over (partition by analysis_id order by id desc) = 1)"""


@query("run_latest", f"with {_LOG} select id, analysis_id, file_name, status from v")
def run_latest(load):
    return runlog.latest(run_records(load)).select("id", "analysis_id", "file_name", "status")


@query("run_append", f"with {_LOG} select id, analysis_id, status from v")
def run_append(load):
    log = run_records(load)
    path = scratch_path(log.sparkSession, "runs")
    runlog.append(log, path)
    return runlog.latest(runlog.read(log.sparkSession, path)).select("id", "analysis_id", "status")


@query("run_lifecycle", f"with {_LOG} select analysis_id, 'completed' as status, (id + 2)::bigint as version, 1500::bigint as execution_time_ms from v where status = 'pending' union all select analysis_id, status, id::bigint, ms from v where status <> 'pending'")
def run_lifecycle(load):
    """Starts and completes the pending runs; their new versions win."""
    log = run_records(load)
    waiting = runlog.latest(log).where("status = 'pending'")
    running = runlog.start(waiting)
    done = runlog.complete(running, 1500)
    return runlog.latest(log.unionByName(running).unionByName(done)).select("analysis_id", "status", "version", "execution_time_ms")


@query("run_list", f"with {_LOG} select id, analysis_id, status from v where status = 'completed' order by created_at desc, analysis_id limit 5 offset 2")
def run_list(load):
    return runlog.list_records(run_records(load), "completed", 5, 2).select("id", "analysis_id", "status")


@query("run_lookup", f"with {_LOG} select id, analysis_id, file_path from v where analysis_id = 'run-7'")
def run_lookup(load):
    return runlog.by_analysis_id(run_records(load), "run-7").select("id", "analysis_id", "file_path")


@query("run_search", f"with {_LOG} select id, file_name from v where file_name ilike '%PURCH%' or file_path ilike '%PURCH%' or analysis_id ilike '%PURCH%' order by created_at desc, analysis_id limit 100")
def run_search(load):
    return runlog.search(run_records(load), "PURCH").select("id", "file_name")


@query("run_reuse", f"with {_LOG} select id, analysis_id from v where status = 'completed' and file_hash = md5('purchase') and method = 'pearson'")
def run_reuse(load):
    import hashlib

    config = {"correlation_method": "pearson", "outlier_method": "iqr", "outlier_threshold": 3.0}
    return runlog.find_existing(run_records(load), hashlib.md5(b"purchase").hexdigest(), config).select("id", "analysis_id")


@query("run_reuse_join", f"with {_LOG}, n as (select file_hash, method, arg_max(analysis_id, (created_at, analysis_id)) a from v where status='completed' group by 1,2) select v.analysis_id, n.a as existing_analysis_id from v left join n using (file_hash, method)".replace("arg_max(analysis_id, (created_at, analysis_id))", "max({'x': created_at, 'y': analysis_id}).y"))
def run_reuse_join(load):
    log = run_records(load)
    asked = runlog.latest(log).select("analysis_id", "file_hash", "analysis_type", "time_column", "analysis_config")
    return runlog.reusable(log, asked).select("analysis_id", "existing_analysis_id")


@query("run_statistics", f"with {_LOG} select count(*)::bigint as total, " + ", ".join(f"count(case when status='{s}' then 1 end)::bigint as {s}" for s in runlog.STATUSES) + f", strftime(max(created_at), '%Y-%m-%d %H:%M:%S') as last_created, {r(chr(39).join(['avg(case when status=','completed',' then ms end)']),3)} as mean_execution_ms from v")
def run_statistics(load):
    s = runlog.statistics(run_records(load))
    return s.withColumn("last_created", F.date_format("last_created", "yyyy-MM-dd HH:mm:ss")).withColumn("mean_execution_ms", tidy(F.col("mean_execution_ms"), 3))


@query("run_status_counts", f"with {_LOG} select status, count(*)::bigint as n from v group by 1")
def run_status_counts(load):
    return runlog.status_counts(run_records(load))


@query("run_this_week", f"with {_LOG} select id, analysis_id from v where created_at >= date_trunc('week', (select max(created_at) from l))")
def run_this_week(load):
    log = run_records(load)
    now = log.agg(F.max("created_at")).first()[0]
    return runlog.in_period(log, "week", F.lit(now)).select("id", "analysis_id")


@query("run_retention", f"with {_LOG} select count(*)::bigint as n, count(distinct analysis_id)::bigint as runs from l where analysis_id in (select analysis_id from v where created_at >= cast((select max(created_at) from l) as date) - 1) and analysis_id <> 'run-7'")
def run_retention(load):
    log = run_records(load)
    now = log.agg(F.max("created_at")).first()[0]
    kept = runlog.retained(runlog.without(log, ["run-7"]), 1, F.lit(now))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("analysis_id").alias("runs"))


@query("run_export")
def run_export(load):
    log = run_records(load)
    spark = log.sparkSession
    path = scratch_path(spark, "record")
    runlog.export_record(log, "run-7", path)
    return spark.read.text(path)


@query("run_texts", f"""with {_LOG} select id, case when file_size < 1024 then file_size || 'B' when file_size < 1048576 then printf('%.1fKB', file_size/1024.0) else printf('%.1fMB', file_size/1048576.0) end as size,
 case when ms = 0 then 'unknown' when ms < 1000 then ms || 'ms' when ms < 60000 then printf('%.1fs', ms/1000.0) else printf('%.1fmin', ms/60000.0) end as duration from l where true""")
def run_texts(load):
    return run_records(load).select("id", runlog.size_text(F.col("file_size")).alias("size"), runlog.duration_text(F.col("execution_time_ms")).alias("duration"))


@query("run_error_kinds", f"with {_LOG} select case err when 'f' then 'file_not_found' when 'm' then 'memory_error' else 'other' end as kind, count(*)::bigint as n from l where err is not null group by 1")
def run_error_kinds(load):
    kinds = run_records(load).where("error_message is not null").select(F.coalesce(runlog.error_kind(F.col("error_message")), F.lit("other")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
