"""Validation rules, issue tables and scores."""

from pyspark.sql import functions as F

from gaugewell.catalog.registry import query, r
from gaugewell.functions.columns import tidy
from gaugewell.operators import validate as v


def _rounded(df, digits=6):
    return df.select(*[tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _brief(issues):
    return _rounded(issues.select("rule", "level", "column", "count", "percentage"))


_STAT = "select '{c}' as \"column\", count(*)::bigint as \"rows\", (count(*)-count({c}))::bigint as null_count, {a} as \"min\", {b} as \"max\", {m} as mean, {s} as std from events"


@query(
    "basic_statistics",
    " union all ".join(
        _STAT.format(c=c, a=r(f"min({c})", 4), b=r(f"max({c})", 4), m=r(f"avg({c})", 4), s=r(f"stddev_samp({c})", 4))
        if c in ("event_id", "user_id", "value")
        else _STAT.format(c=c, a="null::double", b="null::double", m="null::double", s="null::double")
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
)
def basic_statistics(load):
    return _rounded(v.basic_statistics(load("events")).drop("dtype"), 4)


@query("rule_not_empty", "select 'not_empty' as rule, 'critical' as level, null::varchar as \"column\", 0::bigint as \"count\", 100.0::double as percentage where not exists (select * from events where value < 0)")
def rule_not_empty(load):
    return _brief(v.validate(load("events").where("value < 0"), ["not_empty"]))


_GAPS = "select l_orderkey, nullif(l_discount, 0.0) as discount, case when l_quantity <= 20 then l_quantity end as quantity, case when l_quantity <= 3 then l_tax end as tax, nullif(l_returnflag, 'R') as flag from lineitem"


def _gaps(load):
    return load("lineitem").select(
        "l_orderkey",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.when(F.col("l_quantity") <= 20, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_quantity") <= 3, F.col("l_tax")).alias("tax"),
        F.nullif("l_returnflag", F.lit("R")).alias("flag"),
    )


def _null_sql(c):
    return f"""select 'no_null_values' as rule, case when p >= 50 then 'critical' when p >= 20 then 'error' when p >= 5 then 'warning' else 'info' end as level, '{c}' as "column",
    n as "count", {r('p')} as percentage from (select (count(*)-count({c}))::bigint n, 100.0*(count(*)-count({c}))/count(*) p from t) where n > 0"""


_NULLS = f"with t as ({_GAPS}) " + " union all ".join(_null_sql(c) for c in ("l_orderkey", "discount", "quantity", "tax", "flag"))


@query("rule_null_values", _NULLS)
def rule_null_values(load):
    return _brief(v.validate(_gaps(load), ["no_null_values"]))


@query(
    "rule_data_type",
    f"""select 'data_type' as rule, 'warning' as level, c as "column", 1::bigint as "count", {r('p')} as percentage from
    (select 'price' c, 100.0*avg(case when try_cast(p as double) is not null then 1 else 0 end) p from (select cast(o_totalprice as varchar) p from orders)
     union all select 'prio', 100.0*avg(case when try_cast(o_orderpriority as double) is not null then 1 else 0 end) from orders) where p > 80""",
)
def rule_data_type(load):
    df = load("orders").select(F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("prio"))
    return _brief(v.validate(df, ["data_type"]))


@query(
    "rule_duplicates",
    f"""with t as (select l_returnflag, l_linestatus, l_quantity from lineitem), s as (select (select count(*) from t) n, (select count(*) from (select distinct * from t)) u)
    select 'duplicate_check' as rule, case when 100.0*(n-u)/n < 10 then 'warning' else 'error' end as level, null::varchar as "column", (n-u)::bigint as "count", {r('100.0*(n-u)/n')} as percentage from s where n > u""",
)
def rule_duplicates(load):
    return _brief(v.validate(load("lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), ["duplicate_check"]))


def _outlier_sql(c, t):
    return f"""select 'outlier_check' as rule, case when 100.0*n/m < 5 then 'info' else 'warning' end as level, '{c}' as "column", n as "count", {r('100.0*n/m')} as percentage
    from (select count(*) m, sum(case when {c} < a-1.5*(b-a) or {c} > b+1.5*(b-a) then 1 else 0 end)::bigint n from {t}, (select quantile_cont({c},0.25) a, quantile_cont({c},0.75) b from {t})) where n > 0"""


@query("rule_outliers", _outlier_sql("value", "events") + " union all " + _outlier_sql("user_id", "events") + " union all " + _outlier_sql("event_id", "events"))
def rule_outliers(load):
    return _brief(v.validate(load("events"), ["outlier_check"]))


@query(
    "rule_unique_values",
    f"""with t as (select l_quantity, l_linestatus, nullif(l_returnflag,'R') as flag, l_orderkey from lineitem) """
    + " union all ".join(
        f"""select 'unique_values' as rule, 'warning' as level, '{c}' as "column", u as "count", {r('100.0*u/n')} as percentage from
        (select count(*) n, (count(distinct {c}) + max(case when {c} is null then 1 else 0 end))::bigint u from t) where n > 100 and 1.0*u/n < 0.01"""
        for c in ("l_quantity", "l_linestatus", "flag", "l_orderkey")
    ),
)
def rule_unique_values(load):
    df = load("lineitem").select("l_quantity", "l_linestatus", F.nullif("l_returnflag", F.lit("R")).alias("flag"), "l_orderkey")
    return _brief(v.validate(df, ["unique_values"]))


_RULES = {
    "o_totalprice": {"min_value": 50000, "max_value": 400000},
    "o_orderpriority": {"min_length": 6, "max_length": 10, "pattern": "^[1-3]-"},
    "o_orderdate": {"min_date": "1996-01-01", "max_date": "2000-12-31"},
    "no_such": {"min_value": 0},
}


def _col_sql(rule, c, bad):
    return f"""select '{rule}' as rule, 'warning' as level, '{c}' as "column", n as "count", {r('100.0*n/m')} as percentage from (select count(*) m, sum(case when {bad} then 1 else 0 end)::bigint n from orders) where n > 0"""


_COLUMN_SQL = " union all ".join(
    [
        _col_sql("numeric_range", "o_totalprice", "o_totalprice < 50000"),
        _col_sql("numeric_range", "o_totalprice", "o_totalprice > 400000"),
        _col_sql("string_length", "o_orderpriority", "length(o_orderpriority) < 6"),
        _col_sql("string_length", "o_orderpriority", "length(o_orderpriority) > 10"),
        _col_sql("regex_pattern", "o_orderpriority", "not regexp_matches(o_orderpriority, '^[1-3]-')"),
        _col_sql("date_range", "o_orderdate", "o_orderdate < timestamp '1996-01-01'"),
        _col_sql("date_range", "o_orderdate", "o_orderdate > timestamp '2000-12-31'"),
        "select 'column_exists', 'error', 'no_such', 1::bigint, 100.0::double",
    ]
)


@query("column_rules", _COLUMN_SQL)
def column_rules(load):
    return _brief(v.validate(load("orders"), [], _RULES))


@query("column_rules_text", """select 'string_length' as rule, 'warning' as level, 'text' as "column", sum(case when length(text) < 200 then 1 else 0 end)::bigint as "count" from documents
    union all select 'string_length', 'warning', 'text', sum(case when length(text) > 5000 then 1 else 0 end)::bigint from documents
    union all select 'regex_pattern', 'warning', 'lang', sum(case when not regexp_matches(lang, '^(en|fr)$') then 1 else 0 end)::bigint from documents""")
def column_rules_text(load):
    rules = {"text": {"min_length": 200, "max_length": 5000}, "lang": {"pattern": "^(en|fr)$"}}
    return v.validate(load("documents"), [], rules).select("rule", "level", "column", "count")


def _all_issues(load):
    return v.validate(load("orders"), [*v.DEFAULT_RULES, "no_null_values"], _RULES)


_ALL = f"with i as ({_outlier_sql('o_totalprice', 'orders')} union all {_outlier_sql('o_custkey', 'orders')} union all {_outlier_sql('o_orderkey', 'orders')} union all {_COLUMN_SQL})"


@query("validation_run", _ALL + " select * from i")
def validation_run(load):
    return _brief(_all_issues(load))


@query("quality_score", _ALL + " select greatest(0.0, 100.0 - sum(case level when 'critical' then 30 when 'error' then 15 when 'warning' then 5 else 1 end))::double as quality_score, (count(case when level='critical' then 1 end) = 0) as is_valid from i")
def quality_score(load):
    return v.quality_score(_all_issues(load))


@query("issue_summary", _ALL + " select level, count(*)::bigint as issues from i group by level")
def issue_summary(load):
    return v.issue_summary(_all_issues(load))


@query("issue_filter", _ALL + " select rule, level, \"column\" from i where level = 'warning' and \"column\" = 'o_totalprice'")
def issue_filter(load):
    return v.issues_for(_all_issues(load), "warning", "o_totalprice").select("rule", "level", "column")


@query(
    "column_names",
    """with c as (select * from (values (0, 'n_nationkey'), (1, ' n_name'), (2, 'n_regionkey'), (3, 'n_regionkey'), (4, ' '), (5, 'rows_' || (select count(*) from nation))) t(position, name))
    select position, name as "column", problem is null as ok, problem from (select *, case when trim(name) = '' then 'empty' when trim(name) <> name then 'surrounding blanks' when count(*) over (partition by name) > 1 then 'duplicate' end as problem from c)""",
)
def column_names(load):
    """Names that a careless export of nation gives, the last one from its row count."""
    nation = load("nation")
    key, name, region = nation.columns[:3]
    return v.column_name_issues([key, f" {name}", region, region, " ", f"rows_{nation.count()}"], nation.sparkSession)
