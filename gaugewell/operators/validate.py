"""Data-quality rules: every rule answers with issue rows, one aggregate for all counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.columns import count_if, num, numeric_columns, nz, quoted, string_columns, unfold
from gaugewell.functions.parsing import parse_double
from gaugewell.operators.clean import duplicate_stats
from gaugewell.operators.describe import distinct_counts
from gaugewell.operators.outliers import iqr_fences

DEFAULT_RULES = ("not_empty", "data_type", "duplicate_check", "outlier_check")
TABLE_RULES = (*DEFAULT_RULES, "no_null_values", "unique_values")
ISSUE = "rule string, level string, column string, message string, count bigint, percentage double, details map<string,string>"
PENALTY = {"critical": 30, "error": 15, "warning": 5, "info": 1}


def _issue(when: Column, rule: str, level: Column | str, column: str | None, message: Column, count: Column, share: Column, details: dict[str, Column]) -> Column:
    entries = []
    for k, v in details.items():
        entries += [F.lit(k), v.cast("string")]
    return F.when(
        when,
        F.struct(
            F.lit(rule).alias("rule"),
            (F.lit(level) if isinstance(level, str) else level).alias("level"),
            F.lit(column).cast("string").alias("column"),
            message.alias("message"),
            count.cast("long").alias("count"),
            share.cast("double").alias("percentage"),
            (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("details"),
        ),
    )


def null_level(percentage: Column) -> Column:
    return (
        F.when(percentage >= 50, "critical").when(percentage >= 20, "error").when(percentage >= 5, "warning").otherwise("info")
    )


def basic_statistics(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls and, for numbers, min, max, mean, std."""
    numbers = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        if f.name in numbers:
            x = num(f.name)
            aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
        else:
            aggs.append(F.count(quoted(f.name)).alias(f"n{i}"))
    rows = []
    for i, f in enumerate(df.schema.fields):
        has = f.name in numbers
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("rows").alias("rows"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                *[(F.col(f"{k}{i}") if has else F.lit(None).cast("double")).alias(n) for k, n in (("a", "min"), ("b", "max"), ("m", "mean"), ("s", "std"))],
            )
        )
    return unfold(df.agg(*aggs), rows)


def _counters(df: DataFrame, rules: Sequence[str], column_rules: Mapping[str, Mapping]) -> tuple[list[Column], list[Column]]:
    """Aggregates (named) and the issue structs computed from them, for all rules that need only counts."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    issues: list[Column] = []
    rows = F.col("rows")

    def counted(expr: Column) -> Column:
        name = f"c{len(aggs)}"
        aggs.append(expr.alias(name))
        return F.col(name)

    def share(n: Column) -> Column:
        return F.when(rows > 0, n / rows * 100).otherwise(0.0)

    if "not_empty" in rules:
        issues.append(_issue(rows == 0, "not_empty", "critical", None, F.lit("the table has no rows"), F.lit(0), F.lit(100.0), {}))
        issues.append(_issue(F.lit(len(df.columns) == 0), "not_empty", "critical", None, F.lit("the table has no columns"), F.lit(0), F.lit(100.0), {}))
    if "no_null_values" in rules:
        for f in df.schema.fields:
            c = num(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else quoted(f.name)
            n = counted(count_if(c.isNull()))
            issues.append(_issue(n > 0, "no_null_values", null_level(share(n)), f.name, F.format_string(f"column '{f.name}' has %d nulls", n), n, share(n), {"null_count": n, "total_rows": rows}))
    if "data_type" in rules:
        for c in string_columns(df):
            present, parsed = counted(F.count(quoted(c))), counted(F.count(parse_double(c)))
            ratio = parsed / nz(present)
            issues.append(_issue((present > 0) & (ratio > 0.8), "data_type", "warning", c, F.lit(f"column '{c}' looks numeric"), F.lit(1), ratio * 100, {"current_dtype": F.lit("string"), "suggested_dtype": F.lit("double")}))
    if "outlier_check" in rules:
        cols = numeric_columns(df)
        fences = iqr_fences(df, cols) if cols else {}
        for c, (_, _, lo, hi) in fences.items():
            n = counted(count_if((num(c) < F.lit(lo)) | (num(c) > F.lit(hi))))
            level = F.when(share(n) < 5, "info").otherwise("warning")
            issues.append(_issue(n > 0, "outlier_check", level, c, F.format_string(f"column '{c}' has %d outliers", n), n, share(n), {"outlier_count": n}))
    for c, spec in column_rules.items():
        if c not in df.columns:
            issues.append(_issue(F.lit(True), "column_exists", "error", c, F.lit(f"column '{c}' does not exist"), F.lit(1), F.lit(100.0), {}))
            continue
        for name, bad, bound in _column_checks(df, c, spec):
            n = counted(count_if(bad))
            issues.append(_issue(n > 0, name, "warning", c, F.concat(F.lit(f"column '{c}': "), n.cast("string"), F.lit(f" values break {name} {bound}")), n, share(n), {"bound": F.lit(str(bound)), "violations": n}))
    return aggs, issues


def _column_checks(df: DataFrame, c: str, spec: Mapping):
    """(rule, violation, bound) per setting; each end of a range is its own issue."""
    col = quoted(c)
    if spec.get("min_value") is not None:
        yield "numeric_range", num(c) < F.lit(float(spec["min_value"])), spec["min_value"]
    if spec.get("max_value") is not None:
        yield "numeric_range", num(c) > F.lit(float(spec["max_value"])), spec["max_value"]
    if spec.get("min_length") is not None:
        yield "string_length", F.length(col) < spec["min_length"], spec["min_length"]
    if spec.get("max_length") is not None:
        yield "string_length", F.length(col) > spec["max_length"], spec["max_length"]
    if spec.get("pattern") is not None:
        yield "regex_pattern", ~col.rlike(spec["pattern"]), spec["pattern"]
    if spec.get("min_date") is not None:
        yield "date_range", col.cast("timestamp_ntz") < F.lit(spec["min_date"]).cast("timestamp_ntz"), spec["min_date"]
    if spec.get("max_date") is not None:
        yield "date_range", col.cast("timestamp_ntz") > F.lit(spec["max_date"]).cast("timestamp_ntz"), spec["max_date"]


def validate(
    df: DataFrame, rules: Sequence[str] = DEFAULT_RULES, column_rules: Mapping[str, Mapping] | None = None
) -> DataFrame:
    """Issue rows of the table rules and the per-column rules.

    ``column_rules`` maps a column to any of min_value, max_value, min_length,
    max_length, pattern, min_date, max_date.
    """
    unknown = set(rules) - set(TABLE_RULES)
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    parts = []
    aggs, issues = _counters(df, rules, column_rules or {})
    if issues:
        parts.append(df.agg(*aggs).select(F.inline(F.array_compact(F.array(*issues)))))
    if "duplicate_check" in rules and df.columns:
        parts.append(_duplicate_issues(df))
    if "unique_values" in rules and df.columns:
        parts.append(_unique_issues(df))
    if not parts:
        return df.sparkSession.createDataFrame([], ISSUE)
    return reduce(DataFrame.unionByName, parts)


def _duplicate_issues(df: DataFrame) -> DataFrame:
    n = F.col("duplicate_count")
    share = F.col("duplicate_ratio") * 100
    issue = _issue(n > 0, "duplicate_check", F.when(share < 10, "warning").otherwise("error"), None, F.format_string("%d duplicate rows", n), n, share, {"duplicate_count": n, "total_rows": F.col("rows_before")})
    return duplicate_stats(df).select(F.inline(F.array_compact(F.array(issue))))


def _unique_issues(df: DataFrame) -> DataFrame:
    """Distinct values (a null counts as one) under 1 % of more than 100 rows."""
    present = basic_statistics(df).select("column", "rows", (F.col("null_count") > 0).cast("int").alias("extra"))
    joined = distinct_counts(df).join(present, "column")
    n = F.col("distinct_count") + F.col("extra")
    ratio = n / F.col("rows")
    rule = F.struct(
        F.lit("unique_values").alias("rule"),
        F.lit("warning").alias("level"),
        F.col("column"),
        F.format_string("column '%s' has only %d distinct values", F.col("column"), n).alias("message"),
        n.cast("long").alias("count"),
        (ratio * 100).alias("percentage"),
        F.create_map(F.lit("unique_count"), n.cast("string"), F.lit("total_rows"), F.col("rows").cast("string")).alias("details"),
    )
    return joined.where((F.col("rows") > 100) & (ratio < 0.01)).select(F.inline(F.array(rule)))


def quality_score(issues: DataFrame) -> DataFrame:
    """100 minus the level penalties, floor 0; valid when nothing is critical."""
    cost = reduce(lambda acc, kv: F.when(F.col("level") == kv[0], kv[1]).otherwise(acc), PENALTY.items(), F.lit(0))
    total = F.coalesce(F.sum(cost), F.lit(0))
    return issues.agg(
        F.greatest(F.lit(0.0), 100.0 - total).alias("quality_score"),
        (F.coalesce(count_if(F.col("level") == "critical"), F.lit(0)) == 0).alias("is_valid"),
    )


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("level").agg(F.count(F.lit(1)).alias("issues"))


def issues_for(issues: DataFrame, level: str | None = None, column: str | None = None) -> DataFrame:
    out = issues
    if level is not None:
        out = out.where(F.col("level") == level)
    if column is not None:
        out = out.where(F.col("column") == column)
    return out


def has_critical(issues: DataFrame) -> bool:
    return not issues.where(F.col("level") == "critical").isEmpty()


def column_name_issues(names: Sequence[str], spark) -> DataFrame:
    """Name hygiene: non-empty, unique, no blanks around."""
    rows = []
    for i, n in enumerate(names):
        if not n or not n.strip():
            problem = "empty"
        elif n != n.strip():
            problem = "surrounding blanks"
        elif list(names).count(n) > 1:
            problem = "duplicate"
        else:
            problem = None
        rows.append((i, n, problem is None, problem))
    return spark.createDataFrame(rows, "position int, column string, ok boolean, problem string")
