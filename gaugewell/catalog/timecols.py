"""Time-column detection over whole columns."""

from pyspark.sql import functions as F

from gaugewell.catalog.registry import query, r
from gaugewell.functions.columns import tidy
from gaugewell.operators import timecol as t


def _mixed(load):
    """Text columns in several time formats, derived from the given order dates."""
    o = F.col("o_orderdate")
    return load("orders").select(
        "o_orderkey",
        F.date_format(o, "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.date_format(o, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("tagtime"),
        F.when(F.col("o_orderstatus") != "P", F.date_format(o, "yyyy-MM-dd")).alias("birth_date"),
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").cast("string").alias("epoch"),
        F.date_format(o, "MM/dd/yyyy").alias("us_day"),
        "o_orderpriority",
    )


_MIXED = """with m as (select o_orderkey::varchar as o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as created_at, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as tagtime,
  case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m-%d') end as birth_date, cast(epoch(o_orderdate)::bigint as varchar) as epoch,
  strftime(o_orderdate, '%m/%d/%Y') as us_day, o_orderpriority from orders),
 l as (select * from m unpivot include nulls (v for col in (o_orderkey, created_at, tagtime, birth_date, epoch, us_day, o_orderpriority)))"""

# Unix times also match as whole numbers up to these values.
_TOPS = {"timestamp_unix": t.LAST_SECOND, "timestamp_ms": 1000 * t.LAST_SECOND}


def _hit(regex, top):
    test = f"regexp_matches(v, '{regex}')"
    return test if top is None else f"({test} or coalesce(regexp_matches(v, '^-?\\d+$') and try_cast(v as hugeint) between 0 and {top}, false))"


_SCORES = _MIXED + ", s as (" + " union all ".join(
    f"select col, {i} as no, '{kind}' as pattern, '{fmt}' as format, 1.0*count(case when v is not null and trim(v) <> '' and {_hit('^' + regex, _TOPS.get(kind))} then 1 end)/count(v) as ratio, {w} as weight from l group by col"
    for i, (kind, regex, fmt, w) in enumerate(t.VALUE_PATTERNS)
) + ")"


@query("time_name_scores", """select * from (values ('o_orderkey',0.0::double,'unknown'),('created_at',0.6::double,'datetime'),('tagtime',0.8::double,'tagtime'),('birth_date',0.6::double,'date'),
 ('epoch',0.0::double,'unknown'),('us_day',0.0::double,'unknown'),('o_orderpriority',0.0::double,'unknown')) v("column", name_score, name_type)""")
def time_name_scores(load):
    return t.detect(_mixed(load), sample_size=None).select("column", "name_score", "name_type")


@query("time_pattern_scores", _SCORES + f" select col as \"column\", no::integer as pattern_no, pattern, format, {r('ratio')} as match_ratio, {r('ratio*weight')} as score from s")
def time_pattern_scores(load):
    out = t.pattern_scores(t.column_evidence(_mixed(load)))
    return out.select("column", "pattern_no", "pattern", "format", tidy(F.col("match_ratio")).alias("match_ratio"), tidy(F.col("score")).alias("score"))


_STATS = f"""select col as "column", count(*)::bigint as total_samples, count(v)::bigint as non_empty_count, {r('1.0*(count(*)-count(v))/count(*)')} as empty_ratio,
 count(distinct v)::bigint as unique_count, {r('avg(length(v))')} as avg_length, min(length(v))::integer as min_length, max(length(v))::integer as max_length,
 {r('1.0*count(try_cast(v as double))/count(v)')} as numeric_ratio, {r('min(try_cast(v as double))',1)} as numeric_min, {r('max(try_cast(v as double))',1)} as numeric_max,
 {r('avg(try_cast(v as double))/1e6',4)} as numeric_avg from l group by col"""


@query("time_sample_statistics", f"{_MIXED} {_STATS}")
def time_sample_statistics(load):
    e = t.column_evidence(_mixed(load)).drop("match_ratios").withColumn("numeric_avg", F.col("numeric_avg") / 1e6)
    digits = {"numeric_min": 1, "numeric_max": 1, "numeric_avg": 4}
    return e.select(*[tidy(F.col(c), digits.get(c, 6)).alias(c) if k == "double" else c for c, k in e.dtypes])


_DETECT = _SCORES + f""", st as ({_STATS}), b as (select * from (select *, row_number() over (partition by col order by ratio*weight desc, no) rn from s) where rn = 1),
 n as (select * from (values ('o_orderkey',0.0,'unknown'),('created_at',0.6,'datetime'),('tagtime',0.8,'tagtime'),('birth_date',0.6,'date'),('epoch',0.0,'unknown'),('us_day',0.0,'unknown'),('o_orderpriority',0.0,'unknown')) v(col, ns, nt)),
 f as (select st."column", nt, pattern, format, round(cast((ratio*weight*0.7 + ns*0.3) as double) * (case when empty_ratio > 0.5 then 0.5 else 1.0 end)::double * (case when 1.0*unique_count/non_empty_count < 0.1 then 0.3 else 1.0 end)::double
   * (case when avg_length < 4 or avg_length > 30 then 0.7 else 1.0 end)::double, 8) as confidence, empty_ratio, unique_count, non_empty_count, min_length, max_length
   from st join b on st."column" = b.col join n on n.col = b.col),
 d as (select *, confidence >= 0.6 as is_time_column, case when confidence < 0.6 then 'unknown' when nt = 'tagtime' then 'tagtime' when pattern = 'date_only' then 'date'
   when pattern in ('timestamp_unix','timestamp_ms') then 'timestamp' else 'datetime' end as time_type from f)"""


@query("time_detection", _DETECT + ' select "column", confidence, is_time_column, time_type, pattern, format from d')
def time_detection(load):
    out = t.detect(_mixed(load), sample_size=None)
    return out.select("column", F.round("confidence", 8).alias("confidence"), "is_time_column", "time_type", "pattern", "format")


@query(
    "time_suggestions",
    _DETECT
    + """ select "column", case when not is_time_column then 'not a time column' else coalesce(nullif(concat_ws('; ', case when empty_ratio > 0.3 then 'many empty values: clean the column' end,
    case when 1.0*unique_count/non_empty_count > 0.8 then 'scattered time formats: standardise them' end, case when max_length-min_length > 5 then 'uneven text lengths: use one format' end), ''), 'time format is fine') end as advice from d""",
)
def time_suggestions(load):
    s = t.suggestions(t.detect(_mixed(load), sample_size=None))
    return s.select("column", F.array_join("suggestions", "; ").alias("advice"))


@query("time_primary", _DETECT + ' select "column", time_type, format, confidence from d where is_time_column order by confidence desc, "column" desc limit 1')
def time_primary(load):
    p = t.primary(t.detect(_mixed(load), sample_size=None))
    return p.withColumn("confidence", F.round("confidence", 8))


@query("time_parse_check", _MIXED + " select count(birth_date)::bigint as checked, count(try_strptime(birth_date, '%Y-%m-%d'))::bigint as parsed, true as ok from m")
def time_parse_check(load):
    return t.parse_check(_mixed(load), "birth_date", "%Y-%m-%d", sample_size=None)


@query(
    "time_quick_detection",
    _MIXED
    + f""", q as (select col, 1.0*count(case when regexp_matches(v, '^[0-9]{{10,}}$') then 1 end)/count(v) as st,
      1.0*count(case when not regexp_matches(v, '^[0-9]{{10,}}$') and coalesce(try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y')) is not null then 1 end)/count(v) as dt from l group by col),
    n as (select * from (values ('o_orderkey',0.0,'unknown'),('created_at',0.6,'datetime'),('tagtime',0.8,'tagtime'),('birth_date',0.6,'datetime'),('epoch',0.0,'unknown'),('us_day',0.0,'unknown'),('o_orderpriority',0.0,'unknown')) v(col, ns, nt)),
    h as (select *, greatest(ns, st, dt) as sc from q join n using (col))
    select col as "column", sc >= 0.6 as is_time_column, case when sc < 0.6 then nt when st > dt then 'timestamp' when nt = 'unknown' then 'datetime' else nt end as time_type, {r('case when sc >= 0.6 then sc else 0 end')} as confidence from h""",
)
def time_quick_detection(load):
    return t.quick_detect(_mixed(load), sample_size=None).withColumn("confidence", tidy(F.col("confidence")))


@query("time_preview_detection", """select * from (values ('o_orderkey',false,null::varchar),('created_at',true,'%Y-%m-%d %H:%M:%S'),('tagtime',true,null),('birth_date',true,'%Y-%m-%d'),('epoch',false,null),('us_day',true,null),('o_orderpriority',false,null)) v("column", is_time, format)
 where "column" <> 'us_day' union all select 'us_day', true, case when cast(substr(d, 1, 2) as int) <= 12 and cast(substr(d, 4, 2) as int) <= 12 then '%d/%m/%Y' else '%m/%d/%Y' end from (select strftime(o_orderdate, '%m/%d/%Y') d from orders order by o_orderkey limit 1)""")
def time_preview_detection(load):
    return t.preview_detect(_mixed(load), order=["o_orderkey"])
