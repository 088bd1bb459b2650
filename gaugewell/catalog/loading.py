"""Sources, sinks, samples and load-quality figures."""

import pandas as pd
from pyspark.sql import functions as F

from gaugewell.catalog.registry import query, r
from gaugewell.functions.columns import tidy
from gaugewell.operators import describe as d
from gaugewell.session import scratch_path
from gaugewell.sources import files, readers, sinks

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
EVENTS_SQL = f"select event_id, user_id, event_type, {r('value',4)} as value, props from events"


def _plain(df):
    return df.select("event_id", "user_id", "event_type", tidy(F.col("value"), 4).alias("value"), "props")


@query("csv_round_trip", EVENTS_SQL)
def csv_round_trip(load):
    df = load("events")
    path = scratch_path(df.sparkSession, "events") + ".csv"
    sinks.write_csv(df, path)
    return _plain(readers.read_csv(df.sparkSession, path, schema=EVENTS))


@query("csv_inferred_types", "select 'event_id' as \"column\", 'int' as dtype union all select 'ts','timestamp' union all select 'user_id','int' union all select 'event_type','string' union all select 'value','double' union all select 'props','string'")
def csv_inferred_types(load):
    df = load("events")
    path = scratch_path(df.sparkSession, "events") + ".csv"
    sinks.write_csv(df, path)
    return readers.column_info(readers.read_csv(df.sparkSession, path)).select("column", "dtype")


@query("csv_skip_rows", "select c_custkey, c_name, c_nationkey, c_mktsegment from customer")
def csv_skip_rows(load):
    """Two comment lines before the header of every file."""
    df = load("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    spark = df.sparkSession
    path = scratch_path(spark, "customer") + ".csv"
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns])
    lead = ["# exported", "# by hand", ",".join(df.columns)]

    def headed(batches):
        yield pd.DataFrame({"value": lead})
        yield from batches

    df.select(line.alias("value")).mapInPandas(headed, "value string").write.text(path)
    rows = readers.read_csv(spark, path, skip_rows=2, schema="c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string")
    return rows


@query("parquet_round_trip", EVENTS_SQL)
def parquet_round_trip(load):
    df = load("events")
    path = scratch_path(df.sparkSession, "events") + ".parquet"
    sinks.write_parquet(df, path)
    return _plain(readers.read_table(df.sparkSession, path))


@query("json_round_trip", EVENTS_SQL)
def json_round_trip(load):
    df = load("events")
    path = scratch_path(df.sparkSession, "events") + ".json"
    sinks.write_json(df, path)
    return _plain(readers.read_table(df.sparkSession, path, schema=EVENTS))


@query("json_values_lines", "select '[' || c_custkey || ',\"' || c_name || '\",' || c_nationkey || ']' as value from customer")
def json_values_lines(load):
    return sinks.json_lines(load("customer").select("c_custkey", "c_name", "c_nationkey"), "values")


@query(
    "json_index_lines",
    """select '{"' || (row_number() over (order by c_custkey) - 1) || '":{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}}' as value from customer""",
)
def json_index_lines(load):
    return sinks.json_lines(load("customer").select("c_custkey", "c_mktsegment"), "index", ["c_custkey"])


@query("format_dispatch", "select 'supplier' as table_name, count(*)::bigint as n from supplier union all select 'customer', count(*)::bigint from customer")
def format_dispatch(load):
    out = None
    for t, kind in (("supplier", "csv"), ("customer", "json")):
        df = load(t)
        path = scratch_path(df.sparkSession, t) + "." + kind
        sinks.WRITERS[kind](df, path)
        one = readers.read_table(df.sparkSession, path).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("sample_exact_rows")
def sample_exact_rows(load):
    return readers.sample_rows(load("lineitem"), 5_000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("sample_exact_counts", "select least(5000, count(*))::bigint as n, least(5000, count(*))::bigint as known from lineitem")
def sample_exact_counts(load):
    """Rows of the sample, and those that are rows of the table."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    got = readers.sample_rows(load("lineitem"), 5_000, key).select(*key)
    known = got.join(load("lineitem").select(*key).distinct(), key, "left_semi")
    return got.agg(F.count(F.lit(1)).alias("n")).crossJoin(known.agg(F.count(F.lit(1)).alias("known")))


@query("sample_fraction")
def sample_fraction(load):
    return readers.sample_fraction(load("lineitem"), 0.1)


@query("head_rows", "select c_custkey, c_name from customer order by c_custkey limit 10")
def head_rows(load):
    return readers.head_rows(load("customer").select("c_custkey", "c_name"), ["c_custkey"])


_COLS = "l_returnflag, l_linestatus, l_quantity, l_discount"


@query(
    "load_quality",
    f"""with t as (select l_returnflag, l_linestatus, l_quantity, nullif(l_discount, 0.0) as l_discount from lineitem),
    u as (select count(*) n from (select distinct * from t)), s as (select count(*)::bigint n, sum(case when l_discount is null then 1 else 0 end)::bigint m from t)
    select s.n as total_rows, 4::bigint as total_columns, s.m as missing_values, (s.n - u.n)::bigint as duplicate_rows,
    {r('100.0*s.m/(4*s.n)')} as missing_percentage, {r('100.0*(s.n-u.n)/s.n')} as duplicate_percentage from s, u""",
)
def load_quality(load):
    df = load("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    q = readers.load_quality(df).drop("memory_mb")
    return q.withColumns({c: tidy(F.col(c)) for c in ("missing_percentage", "duplicate_percentage")})


def _folder(load):
    """The folder the given tables lie in."""
    file = load("region").inputFiles()[0]
    return load("region").sparkSession, file.rsplit("/", 1)[0]


@query("file_inventory")
def file_inventory(load):
    spark, folder = _folder(load)
    return files.inventory(spark, folder).drop("modificationTime")


@query("file_fingerprints")
def file_fingerprints(load):
    spark, folder = _folder(load)
    whole = files.file_fingerprints(spark, folder)
    head = files.file_fingerprints(spark, folder, head_only=True).withColumnRenamed("md5", "md5_head")
    return whole.join(head, "path")


@query("table_fingerprint")
def table_fingerprint(load):
    return files.table_fingerprint(load("lineitem"))


@query(
    "summary_export",
    f"""select 'describe' as part, count(*)::bigint as entries from (values (1),(2)) union all select 'spread', 2""",
)
def summary_export(load):
    described = d.describe(load("events"), ["value", "user_id"])
    spark = described.sparkSession
    path = scratch_path(spark, "summary")
    sinks.export_summary({"describe": described, "spread": d.spread(described)}, path)
    back = readers.read_json(spark, path, schema="part string, rows string")
    return back.select("part", F.json_array_length("rows").cast("long").alias("entries"))


@query(
    "summary_flattened",
    f"select {r('avg(value)',4)} as stats_value_mean, count(*)::bigint as stats_value_n, {r('max(user_id)',4)} as stats_user_top from events",
)
def summary_flattened(load):
    nested = load("events").agg(
        F.struct(
            F.struct(tidy(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n")).alias("value"),
            F.struct(tidy(F.max("user_id"), 4).alias("top")).alias("user"),
        ).alias("stats")
    )
    return sinks.flatten(nested)


@query("report_export")
def report_export(load):
    described = d.describe(load("events"), ["value", "user_id"])
    folder = scratch_path(described.sparkSession, "report")
    return sinks.export_report({"describe": described, "spread": d.spread(described)}, folder, ("parquet", "csv", "json")).select("part", "format", "status")


_SUMMARY_SQL = " || ',' || ".join(f"max(case when n_nationkey = {i} then n_name end)" for i in range(3))


@query("summary_csv_rows", f"select {_SUMMARY_SQL} as names, count(*)::bigint as n from nation")
def summary_csv_rows(load):
    """A part of several rows and one of a single row in one flattened line."""
    df = load("nation")
    path = scratch_path(df.sparkSession, "summary") + ".csv"
    sinks.export_summary({"first": df.where("n_nationkey < 3").select("n_nationkey", "n_name"), "total": df.agg(F.count(F.lit(1)).alias("n"))}, path, "csv")
    line = readers.read_csv(df.sparkSession, path)
    return line.select(F.concat_ws(",", *[f"first_{i}_n_name" for i in range(3)]).alias("names"), F.col("total_n").cast("bigint").alias("n"))
