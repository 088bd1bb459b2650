"""Projection, retyping, missing values, duplicates, row filters, scaling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.columns import num, numeric_columns, pick_numeric, quoted, string_columns, unfold
from gaugewell.functions.parsing import (
    INTEGER,
    TRUE_WORDS,
    is_boolean_text,
    is_datetime_text,
    parse_double,
    parse_timestamp,
    text,
    trimmed,
)
from gaugewell.operators.outliers import iqr_fences
from gaugewell.plans.ordering import order_value, running
from gaugewell.plans.quantiles import wide_quantiles
from gaugewell.session import cut_lineage

RETYPE_SHARE = 0.8


def numeric_only(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Numeric columns minus the excluded ones; an error when none is left."""
    return df.select(*[quoted(c) for c in pick_numeric(df, None, exclude)])


# ---- types -----------------------------------------------------------------


def parse_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """column → share of all rows that parse as number, as timestamp."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count(parse_double(c)).alias(f"n{i}"))
        aggs.append(F.count(F.when(parse_double(c).isNull(), parse_timestamp(c))).alias(f"t{i}"))
    row = df.agg(*aggs).first()
    total = row["rows"] or 1
    return {c: (row[f"n{i}"] / total, row[f"t{i}"] / total) for i, c in enumerate(columns)}


def retype(df: DataFrame, share: float = RETYPE_SHARE, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns become double, else timestamp, where more than ``share`` of the rows parse."""
    cols = list(columns) if columns is not None else string_columns(df)
    if not cols:
        return df
    shares = parse_shares(df, cols)
    changed = {}
    for c in cols:
        as_number, as_time = shares[c]
        if as_number > share:
            changed[c] = parse_double(c)
        elif as_time > share:
            changed[c] = parse_timestamp(c)
    return df.withColumns(changed) if changed else df


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Inferred label per column: integer, float, datetime, boolean, string, null or unknown.

    Numbers are tested first (so 0/1 is integer), at 80 % of the non-null
    values; date formats need 60 %, boolean words 80 %.
    """
    cols = list(columns) if columns is not None else df.columns
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        t = trimmed(c)
        whole = t.rlike(INTEGER)
        aggs += [
            F.count(t).alias(f"n{i}"),
            F.count(F.when(whole, 1)).alias(f"i{i}"),
            F.count(F.when(~whole & parse_double(c).isNotNull(), 1)).alias(f"f{i}"),
            F.count(F.when(is_datetime_text(c), 1)).alias(f"d{i}"),
            F.count(F.when(is_boolean_text(c), 1)).alias(f"b{i}"),
        ]
    rows = []
    for i, c in enumerate(cols):
        n = F.col(f"n{i}")
        label = (
            F.when(F.col("rows") == 0, "unknown")
            .when(n == 0, "null")
            .when((F.col(f"i{i}") + F.col(f"f{i}")) / n >= 0.8, F.when(F.col(f"f{i}") == 0, "integer").otherwise("float"))
            .when(F.col(f"d{i}") / n >= 0.6, "datetime")
            .when(F.col(f"b{i}") / n >= 0.8, "boolean")
            .otherwise("string")
        )
        rows.append(F.struct(F.lit(c).alias("column"), label.alias("inferred_type"), n.alias("non_null")))
    return unfold(df.agg(*aggs), rows)


def convert(df: DataFrame, column: str, target: str) -> DataFrame:
    """Typed value next to the untouched text (``<column>_raw``); failures are null."""
    if target == "integer":
        typed = parse_double(column).try_cast("long")
    elif target == "float":
        typed = parse_double(column)
    elif target == "boolean":
        word = F.lower(trimmed(column))
        typed = F.when(word.isNotNull(), word.isin(*TRUE_WORDS))
    elif target == "datetime":
        typed = parse_timestamp(column)
    else:
        typed = text(column)
    return df.withColumn(f"{column}_raw", quoted(column)).withColumn(column, typed)


# ---- text ------------------------------------------------------------------


def clean_text(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    trim: bool = True,
    strip_special: bool = False,
    lowercase: bool = False,
) -> DataFrame:
    cols = list(columns) if columns is not None else string_columns(df)
    changed = {}
    for c in cols:
        v = quoted(c)
        if trim:
            v = trimmed(v)
        if strip_special:
            v = F.regexp_replace(v, r"(?U)[^\w\s]", "")
        if lowercase:
            v = F.lower(v)
        changed[c] = v
    return df.withColumns(changed) if changed else df


# ---- missing values --------------------------------------------------------


def _value(f: T.StructField) -> Column:
    return num(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else quoted(f.name)


def missing_profile(df: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.count(_value(f)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)]
    rows = []
    for i, f in enumerate(df.schema.fields):
        gone = F.col("rows") - F.col(f"n{i}")
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                gone.alias("null_count"),
                F.when(F.col("rows") > 0, gone / F.col("rows")).otherwise(0.0).alias("missing_ratio"),
            )
        )
    return unfold(df.agg(*aggs), rows)


def drop_sparse_columns(df: DataFrame, max_missing: float = 0.5) -> DataFrame:
    ratios = {row["column"]: row["missing_ratio"] for row in missing_profile(df).collect()}
    return df.select(*[quoted(c) for c in df.columns if ratios[c] <= max_missing])


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def fill_constant(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Fills columns whose type fits the value."""
    return df.na.fill(value, subset=list(columns) if columns else None)


def fill_along(
    df: DataFrame, order: Sequence[str], columns: Sequence[str], keys: Sequence[str] = (), direction: str = "forward"
) -> DataFrame:
    """Forward or backward fill along an explicit order, per key or over the whole table."""
    fields = {f.name: f for f in df.schema.fields}
    seek = {f"_fill_{c}": _value(fields[c]) for c in columns}
    if direction == "forward":
        done = running(df, order, keys, lasts=seek)
    else:
        done = running(df, order, keys, firsts=seek)
    return done.withColumns({c: F.col(f"_fill_{c}") for c in columns}).select(*[quoted(c) for c in df.columns])


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = pick_numeric(df, columns)
    row = df.agg(*[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return _fill_values(df, {c: row[i] for i, c in enumerate(cols)})


def fill_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = pick_numeric(df, columns)
    return _fill_values(df, {c: q[0] for c, q in zip(cols, wide_quantiles(df, cols, [0.5]))})


def _fill_values(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(num(c), F.lit(float(v))) for c, v in values.items() if v is not None})


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value of non-numeric columns; ties go to the smallest."""
    numbers = set(numeric_columns(df))
    cols = list(columns) if columns is not None else [c for c in df.columns if c not in numbers]
    changed = {}
    for c in cols:
        counted = df.where(quoted(c).isNotNull()).groupBy(quoted(c).alias("v")).agg((-F.count(F.lit(1))).alias("neg"))
        best = counted.agg(F.min(F.struct("neg", "v"))).first()[0]
        if best is not None:
            changed[c] = F.coalesce(quoted(c), F.lit(best["v"]))
    return df.withColumns(changed) if changed else df


def interpolate(
    df: DataFrame, order: Sequence[str], columns: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Linear interpolation along the order key between the nearest known values; ends stay null."""
    at = order_value(df, order[0])
    lasts, firsts = {}, {}
    for c in columns:
        known = F.when(num(c).isNotNull(), F.struct(at.alias("t"), num(c).alias("v")))
        lasts[f"_p_{c}"] = known
        firsts[f"_n_{c}"] = known
    near = running(df, order, keys, lasts=lasts, firsts=firsts)
    changed = {}
    for c in columns:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        gap = n["t"] - p["t"]
        blend = F.when(gap > 0, p["v"] + (n["v"] - p["v"]) * (at - p["t"]) / gap).when(gap == 0, (p["v"] + n["v"]) / 2)
        changed[c] = F.coalesce(num(c), blend)
    return near.withColumns(changed).select(*[quoted(c) for c in df.columns])


# ---- duplicates ------------------------------------------------------------


def drop_duplicates(df: DataFrame, order: Sequence[str] = (), keep: str = "first") -> DataFrame:
    """One row per distinct content; ``order`` columns decide which copy stays.

    An aggregate, not a window: copies collapse before the shuffle, however
    many a row has.
    """
    if not order:
        return df.dropDuplicates()
    content = [c for c in df.columns if c not in set(order)]
    rank = F.struct(*[quoted(o) for o in order])
    pick = F.min(rank) if keep == "first" else F.max(rank)
    kept = df.groupBy(*[quoted(c) for c in content]).agg(pick.alias("_kept"))
    return kept.select(*[F.col("_kept")[c].alias(c) if c in set(order) else quoted(c) for c in df.columns])


def duplicate_stats(df: DataFrame) -> DataFrame:
    copies = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    return copies.agg(total.alias("rows_before"), F.count(F.lit(1)).alias("rows_after")).select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("duplicate_count"),
        F.when(F.col("rows_before") > 0, (F.col("rows_before") - F.col("rows_after")) / F.col("rows_before"))
        .otherwise(0.0)
        .alias("duplicate_ratio"),
    )


# ---- row filters -----------------------------------------------------------


def _keep_between(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """All bounds at once on the original rows; nulls are kept."""
    out = df
    for c, (lo, hi) in bounds.items():
        out = out.where(F.coalesce(num(c).between(F.lit(lo), F.lit(hi)), F.lit(True)))
    return out


def filter_iqr(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    cols = pick_numeric(df, columns)
    return _keep_between(df, {c: (b[2], b[3]) for c, b in iqr_fences(df, cols, k).items()})


def filter_zscore(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    cols = pick_numeric(df, columns)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(num(c)).alias(f"m{i}"), F.stddev_samp(num(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    out = df
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if s:
            out = out.where(F.coalesce(F.abs((num(c) - F.lit(m)) / F.lit(s)) <= threshold, F.lit(True)))
    return out


def filter_percentile(df: DataFrame, columns: Sequence[str] | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    cols = pick_numeric(df, columns)
    found = wide_quantiles(df, cols, [low, high])
    return _keep_between(df, {c: (lo, hi) for c, (lo, hi) in zip(cols, found) if lo is not None})


def filter_isolation_forest(
    df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, contamination: float = 0.1, **kwargs
) -> DataFrame:
    from gaugewell.operators.anomaly import isolation_forest

    scored = isolation_forest(df, key, columns, contamination=contamination, **kwargs)
    return df.join(scored.where(F.col("label") == 1).select(*key), list(key), "left_semi")


# ---- scaling and downcast --------------------------------------------------


def min_max(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x − min)/(max − min); a constant column stays as it is."""
    cols = pick_numeric(df, columns)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(num(c)).alias(f"a{i}"), F.max(num(c)).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    changed = {}
    for i, c in enumerate(cols):
        a, b = row[f"a{i}"], row[f"b{i}"]
        if a is not None and b > a:
            changed[c] = (num(c) - F.lit(a)) / F.lit(b - a)
    return df.withColumns(changed) if changed else df


def standardize(df: DataFrame, columns: Sequence[str] | None = None, ddof: int = 1) -> DataFrame:
    """(x − mean)/std; a constant column stays as it is."""
    cols = pick_numeric(df, columns)
    dev = F.stddev_samp if ddof else F.stddev_pop
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(num(c)).alias(f"m{i}"), dev(num(c)).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    changed = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if s:
            changed[c] = (num(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(changed) if changed else df


INTEGER_RANGES = (("tinyint", -(2**7), 2**7 - 1), ("smallint", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1))


def downcast(df: DataFrame, integers: bool = True, floats: bool = False) -> DataFrame:
    """Integers to the smallest type that holds their range; doubles to float on request."""
    kinds = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)] if integers else []
    changed = {}
    if whole:
        aggs = []
        for i, c in enumerate(whole):
            aggs += [F.min(quoted(c)).alias(f"a{i}"), F.max(quoted(c)).alias(f"b{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(whole):
            lo, hi = row[f"a{i}"], row[f"b{i}"]
            fit = next((t for t, a, b in INTEGER_RANGES if lo is not None and a <= lo and hi <= b), None)
            if fit and fit != df.schema[c].dataType.simpleString():
                changed[c] = quoted(c).cast(fit)
    if floats:
        changed.update({f.name: quoted(f.name).cast("float") for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})
    return df.withColumns(changed) if changed else df


# ---- pipeline --------------------------------------------------------------


@dataclass
class CleaningPlan:
    """Which steps run, in their fixed order, and with what settings."""

    retype: bool = True
    trim: bool = True
    strip_special: bool = False
    lowercase: bool = False
    max_missing: float = 0.5
    missing: str | None = "drop"  # drop, constant, forward, backward, mean, median, mode, auto (median for numbers, mode for the rest), interpolate, None
    fill_value: object = None
    duplicates: bool = True
    keep: str = "first"
    outliers: str | None = None  # iqr, zscore, percentile, isolation_forest, None
    outlier_threshold: float = 3.0
    iqr_factor: float = 1.5
    percentiles: tuple[float, float] = (0.01, 0.99)
    min_max: bool = False
    standardize: bool = False
    downcast: bool = True
    order: tuple[str, ...] = field(default_factory=tuple)
    keys: tuple[str, ...] = field(default_factory=tuple)
    row_key: tuple[str, ...] = field(default_factory=tuple)  # columns that tell rows apart


def _fill_missing(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    free = [c for c in df.columns if c not in {*plan.order, *plan.keys}]
    numbers = [c for c in numeric_columns(df) if c in free]
    how = plan.missing
    if how == "drop":
        return drop_null_rows(df)
    if how == "constant":
        return fill_constant(df, 0 if plan.fill_value is None else plan.fill_value)
    if how in ("forward", "backward"):
        return fill_along(df, plan.order, free, plan.keys, how)
    if how == "mean":
        return fill_mean(df, numbers) if numbers else df
    if how == "median":
        return fill_median(df, numbers) if numbers else df
    if how == "mode":
        return fill_mode(df, [c for c in free if c not in numbers])
    if how == "auto":
        filled = fill_median(df, numbers) if numbers else df
        return fill_mode(filled, [c for c in free if c not in numbers])
    if how == "interpolate":
        return interpolate(df, plan.order, numbers, plan.keys)
    if how is None:
        return df
    raise ValueError(f"unknown missing-value method {how!r}")


def _filter_outliers(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    cols = [c for c in numeric_columns(df) if c not in {*plan.order, *plan.keys}]
    if not cols or plan.outliers is None:
        return df
    if plan.outliers == "iqr":
        return filter_iqr(df, cols, plan.iqr_factor)
    if plan.outliers == "zscore":
        return filter_zscore(df, cols, plan.outlier_threshold)
    if plan.outliers == "percentile":
        return filter_percentile(df, cols, *plan.percentiles)
    if plan.outliers == "isolation_forest":
        key = plan.row_key or plan.order
        if not key:
            raise ValueError("the isolation forest draws rows by key: set row_key (or order) in the plan")
        return filter_isolation_forest(df, key, [c for c in cols if c not in key])
    raise ValueError(f"unknown outlier method {plan.outliers!r}")


def _scale(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    cols = [c for c in numeric_columns(df) if c not in {*plan.order, *plan.keys}]
    if not cols:
        return df
    if plan.min_max:
        return min_max(df, cols)
    return standardize(df, cols) if plan.standardize else df


def clean(
    df: DataFrame, plan: CleaningPlan | None = None, keep: Callable[[DataFrame], DataFrame] | None = cut_lineage
) -> tuple[DataFrame, DataFrame]:
    """Runs the steps in fixed order; returns the cleaned rows and a log (step, rows, columns).

    ``keep`` stores the rows after the parsing steps and after the shuffle of
    the duplicate step, whose results later steps and the log read again; with
    ``None`` everything stays lazy and is recomputed instead.
    """
    plan = plan or CleaningPlan()
    steps: list[tuple[str, bool, Callable[[DataFrame], DataFrame]]] = [
        ("retype", plan.retype, retype),
        ("text", plan.trim or plan.strip_special or plan.lowercase,
         lambda d: clean_text(d, None, plan.trim, plan.strip_special, plan.lowercase)),
        ("missing_columns", plan.missing == "drop", lambda d: drop_sparse_columns(d, plan.max_missing)),
        ("missing", plan.missing is not None, lambda d: _fill_missing(d, plan)),
        ("duplicates", plan.duplicates, lambda d: drop_duplicates(d, plan.order, plan.keep)),
        ("outliers", plan.outliers is not None, lambda d: _filter_outliers(d, plan)),
        ("scale", plan.min_max or plan.standardize, lambda d: _scale(d, plan)),
        ("downcast", plan.downcast, downcast),
    ]
    current = df
    log = current.agg(F.lit(0).alias("position"), F.lit("input").alias("step"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))
    done = 0
    for name, wanted, step in steps:
        if not wanted:
            continue
        done += 1
        current = step(current)
        if keep is not None and name in ("text", "duplicates"):
            current = keep(current)
        log = log.unionByName(
            current.agg(F.lit(done).alias("position"), F.lit(name).alias("step"), F.count(F.lit(1)).alias("rows"), F.lit(len(current.columns)).alias("columns"))
        )
    return current, log
