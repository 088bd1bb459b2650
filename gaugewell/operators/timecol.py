"""Time-column detection by column name and value patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.columns import nz, quoted
from gaugewell.functions.parsing import DATETIME_FORMATS, INTEGER, format_shape, is_datetime_text, parse_double, text, trimmed

# The words that make a column name look like a time column.
TIME_KEYWORDS = (
    "time", "date", "datetime", "timestamp", "created", "updated",
    "modified", "start", "end", "begin", "finish", "birth", "death",
    "时间", "日期", "创建", "更新", "修改", "开始", "结束",
)
TAG_TIME_KEYWORDS = ("tagtime", "tag_time", "tag-time", "tagging_time", "tag时间", "tag_时间")

# Fixed values: (kind, regular expression, format, weight), in order of preference on ties.
VALUE_PATTERNS = (
    ("iso_datetime", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?", "%Y-%m-%dT%H:%M:%S", 0.95),
    ("standard_datetime", r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?", "%Y-%m-%d %H:%M:%S", 0.90),
    ("date_only", r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d", 0.85),
    ("timestamp_unix", r"\d{10}$", "timestamp", 0.80),
    ("timestamp_ms", r"\d{13}$", "timestamp_ms", 0.80),
    ("custom", r"\d{2}/\d{2}/\d{4}", "%m/%d/%Y", 0.75),
    ("custom", r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}", "%m/%d/%Y %H:%M:%S", 0.80),
    ("custom", r"\d{4}/\d{2}/\d{2}", "%Y/%m/%d", 0.75),
)
LAST_SECOND = 4102444800  # 2100-01-01

# Names, and formats in order of preference, of the preview detector.
PREVIEW_NAMES = ("datetime", "timestamp", "time", "date", "tagtime")
PREVIEW_FORMATS = (
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"),
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%Y/%m/%d", "yyyy/M/d"),
    ("%d-%m-%Y", "d-M-yyyy"),
    ("%m-%d-%Y", "M-d-yyyy"),
)

# Words in column names, and the passing score, of the quick detector.
QUICK_TAGTIME = ("tagtime", "tag_time")
QUICK_TIME = ("time", "date", "timestamp", "created", "updated", "modified")
PASS_SCORE = 0.6


def name_score(column: str) -> tuple[float, str]:
    low = column.lower()
    if any(k in low for k in TAG_TIME_KEYWORDS):
        return 0.8, "tagtime"
    if any(k in low for k in TIME_KEYWORDS):
        return 0.6, "date" if "date" in low and "time" not in low else "datetime"
    return 0.0, "unknown"


def name_scores(df: DataFrame) -> DataFrame:
    rows = [(c, *name_score(c)) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, name_score double, name_type string")


def sample_of(df: DataFrame, sample_size: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The rows detection looks at; ``None`` means the whole column."""
    if sample_size is None:
        return df
    ordered = df.orderBy(*[quoted(o) for o in order]) if order else df
    return ordered.limit(sample_size)


def value_text(df: DataFrame, column: str) -> Column:
    """Cell text; timestamps print with seconds, dates as year-month-day."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(quoted(column), "yyyy-MM-dd HH:mm:ss")
    return text(column)


def _cells(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """(column, value) of every scalar cell, as text."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    names = list(columns) if columns is not None else [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]
    cells = [F.struct(F.lit(c).alias("column"), value_text(df, c).alias("value")) for c in names]
    return df.select(F.inline(F.array(*cells)))


def _matches(v: Column, kind: str, regex: str) -> Column:
    hit = v.rlike(f"^(?:{regex})")
    if kind == "timestamp_unix":
        hit = hit | (v.rlike(INTEGER) & v.try_cast("decimal(38,0)").between(0, LAST_SECOND))
    elif kind == "timestamp_ms":
        hit = hit | (v.rlike(INTEGER) & v.try_cast("decimal(38,0)").between(0, LAST_SECOND * 1000))
    return F.coalesce(hit, F.lit(False))


def column_evidence(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: match ratio of each pattern and the sample statistics.

    Values are first counted per (column, value): repeated values are matched
    against the patterns once, and the distinct count falls out of the same
    shuffle.
    """
    cells = _cells(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("times"))
    v = trimmed("value")
    filled = F.col("value").isNotNull() & (v != "")
    w = F.when(filled, F.col("times")).otherwise(0)
    size = F.length("value")
    number = F.when(filled, parse_double("value"))
    hits = [
        F.sum(F.when(filled & _matches(v, kind, regex), F.col("times")).otherwise(0)).alias(f"hit{i}")
        for i, (kind, regex, _, _) in enumerate(VALUE_PATTERNS)
    ]
    n = F.col("non_empty_count")
    per = cells.groupBy("column").agg(
        F.sum("times").alias("total_samples"),
        F.sum(w).alias("non_empty_count"),
        F.count(F.when(filled, 1)).alias("unique_count"),
        F.sum(w * size).alias("_len"),
        F.min(F.when(filled, size)).alias("min_length"),
        F.max(F.when(filled, size)).alias("max_length"),
        F.sum(F.when(number.isNotNull(), F.col("times")).otherwise(0)).alias("_numbers"),
        F.min(number).alias("numeric_min"),
        F.max(number).alias("numeric_max"),
        F.sum(number * F.col("times")).alias("_nsum"),
        *hits,
    )
    ratio = F.array(*[F.when(n > 0, F.col(f"hit{i}") / n).otherwise(0.0) for i in range(len(VALUE_PATTERNS))])
    return per.select(
        "column",
        "total_samples",
        n,
        ((F.col("total_samples") - n) / F.col("total_samples")).alias("empty_ratio"),
        "unique_count",
        F.when(n > 0, F.col("_len") / n).otherwise(0.0).alias("avg_length"),
        F.coalesce("min_length", F.lit(0)).alias("min_length"),
        F.coalesce("max_length", F.lit(0)).alias("max_length"),
        F.when(n > 0, F.col("_numbers") / n).otherwise(0.0).alias("numeric_ratio"),
        "numeric_min",
        "numeric_max",
        F.when(F.col("_numbers") > 0, F.col("_nsum") / F.col("_numbers")).alias("numeric_avg"),
        ratio.alias("match_ratios"),
    )


def pattern_scores(evidence: DataFrame) -> DataFrame:
    """One row per (column, pattern): match ratio and weighted score."""
    cells = [
        F.struct(
            F.lit(i).alias("pattern_no"),
            F.lit(kind).alias("pattern"),
            F.lit(fmt).alias("format"),
            F.col("match_ratios")[i].alias("match_ratio"),
            (F.col("match_ratios")[i] * weight).alias("score"),
        )
        for i, (kind, _, fmt, weight) in enumerate(VALUE_PATTERNS)
    ]
    return evidence.select("column", F.inline(F.array(*cells)))


def detect(
    df: DataFrame, sample_size: int | None = None, order: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """Confidence, type and format per column, most likely time column first."""
    evidence = column_evidence(sample_of(df, sample_size, order), columns)
    # Highest score; ties keep list order.
    scored = F.array(
        *[
            F.struct(
                (F.col("match_ratios")[i] * weight).alias("score"),
                F.lit(-i).alias("rank"),
                F.lit(kind).alias("kind"),
                F.lit(fmt).alias("format"),
            )
            for i, (kind, _, fmt, weight) in enumerate(VALUE_PATTERNS)
        ]
    )
    n = F.col("non_empty_count")
    adjust = (
        F.when(F.col("empty_ratio") > 0.5, 0.5).otherwise(1.0)
        * F.when((n > 0) & (F.col("unique_count") / nz(n) < 0.1), 0.3).otherwise(1.0)
        * F.when((F.col("avg_length") < 4) | (F.col("avg_length") > 30), 0.7).otherwise(1.0)
    )
    named = evidence.join(F.broadcast(name_scores(df)), "column").withColumn("_best", F.array_max(scored))
    score = (F.col("_best.score") * 0.7 + F.col("name_score") * 0.3) * adjust
    kind = F.col("_best.kind")
    is_time = F.col("confidence") >= PASS_SCORE
    time_type = (
        F.when(~is_time, "unknown")
        .when(F.col("name_type") == "tagtime", "tagtime")
        .when(n == 0, "unknown")
        .when(kind == "date_only", "date")
        .when(kind.isin("timestamp_unix", "timestamp_ms"), "timestamp")
        .otherwise("datetime")
    )
    return (
        named.withColumn("confidence", F.round(score, 12))
        .withColumn("is_time_column", is_time)
        .withColumn("time_type", time_type)
        .withColumn("pattern", F.when(n > 0, kind))
        .withColumn("format", F.when(n > 0, F.col("_best.format")))
        .drop("_best", "match_ratios")
        .orderBy(F.col("confidence").desc(), "column")
    )


def suggestions(detected: DataFrame) -> DataFrame:
    """Advice per column from its sample statistics."""
    n = F.greatest(F.col("non_empty_count"), F.lit(1))
    tips = F.array_compact(
        F.array(
            F.when(F.col("empty_ratio") > 0.3, "many empty values: clean the column"),
            F.when(F.col("unique_count") / n > 0.8, "scattered time formats: standardise them"),
            F.when(F.col("max_length") - F.col("min_length") > 5, "uneven text lengths: use one format"),
        )
    )
    advice = (
        F.when(~F.col("is_time_column"), F.array(F.lit("not a time column")))
        .when(F.size(tips) == 0, F.array(F.lit("time format is fine")))
        .otherwise(tips)
    )
    return detected.select("column", advice.alias("suggestions"))


def primary(detected: DataFrame) -> DataFrame:
    """The most confident time column; ties go to the first name."""
    best = F.max_by(F.struct("column", "time_type", "format", "confidence"), F.struct("confidence", F.col("column")))
    return detected.where("is_time_column").agg(best.alias("b")).where(F.col("b").isNotNull()).select("b.*")


def parse_check(df: DataFrame, column: str, fmt: str, sample_size: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Counts values that parse with ``fmt``; fine from 80 %."""
    v = trimmed("v")
    rows = sample_of(df, sample_size, order).select(value_text(df, column).alias("v")).where(v != "")
    if fmt == "timestamp":
        ok = v.rlike(INTEGER) & v.try_cast("decimal(38,0)").between(-62135596800, 253402300799)
    elif fmt == "timestamp_ms":
        ok = v.rlike(INTEGER) & (v.try_cast("decimal(38,0)") / 1000).between(-62135596800, 253402300799)
    else:
        java = dict((*DATETIME_FORMATS, *PREVIEW_FORMATS, ("%Y-%m-%dT%H:%M:%S", "yyyy-M-d'T'H:m:s"), ("%m/%d/%Y %H:%M:%S", "M/d/yyyy H:m:s"))).get(fmt, fmt)
        ok = F.try_to_timestamp(v, F.lit(java)).isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(ok, 1)).alias("parsed")).withColumn(
        "ok", F.when(F.col("checked") > 0, F.col("parsed") / F.col("checked") >= 0.8).otherwise(False)
    )


def quick_detect(df: DataFrame, sample_size: int | None = None, order: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Name or value score, whichever is higher, must reach 0.6."""
    names = list(columns) if columns is not None else df.columns
    cells = _cells(sample_of(df, sample_size, order), names).groupBy("column", "value").agg(F.count(F.lit(1)).alias("times"))
    v = trimmed("value")
    digits = v.rlike(r"^[0-9]{10,}$")
    per = cells.where(F.col("value").isNotNull()).groupBy("column").agg(
        F.sum("times").alias("n"),
        F.sum(F.when(digits, F.col("times")).otherwise(0)).alias("stamps"),
        F.sum(F.when(~digits & is_datetime_text("value"), F.col("times")).otherwise(0)).alias("dates"),
    )
    rows = []
    for c in names:
        low = c.lower()
        if any(k in low for k in QUICK_TAGTIME):
            rows.append((c, 0.8, "tagtime"))
        elif any(k in low for k in QUICK_TIME):
            rows.append((c, 0.6, "datetime"))
        else:
            rows.append((c, 0.0, "unknown"))
    named = df.sparkSession.createDataFrame(rows, "column string, name_score double, name_type string")
    score = F.greatest(F.col("name_score"), F.greatest("dates", "stamps") / F.col("n"))
    kind = (
        F.when(F.col("stamps") > F.col("dates"), "timestamp")
        .when(F.col("name_type") == "unknown", "datetime")
        .otherwise(F.col("name_type"))
    )
    hit = F.coalesce(score, F.lit(0.0)) >= PASS_SCORE
    return named.join(per, "column", "left").select(
        "column",
        hit.alias("is_time_column"),
        F.when(hit, kind).otherwise(F.col("name_type")).alias("time_type"),
        F.when(hit, score).otherwise(0.0).alias("confidence"),
    )


def preview_detect(df: DataFrame, columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """By name, by type, or because the first value parses; and the first format that fits it."""
    names = list(columns) if columns is not None else df.columns
    aggs, rows = [], []
    for i, c in enumerate(names):
        v = trimmed(value_text(df, c))
        if order:
            first = F.min_by(v, F.when(v.isNotNull(), F.struct(*[quoted(o) for o in order])))
        else:
            first = F.min(v)
        aggs.append(first.alias(f"v{i}"))
        first_value = F.col(f"v{i}")
        fmt = F.coalesce(
            *[F.when(F.when(first_value.rlike(format_shape(py)), F.try_to_timestamp(first_value, F.lit(j))).isNotNull(), py) for py, j in PREVIEW_FORMATS]
        )
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        typed = isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        by_name = any(k in c.lower() for k in PREVIEW_NAMES)
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                (F.lit(by_name or typed) | (F.lit(is_text) & fmt.isNotNull())).alias("is_time"),
                (fmt if is_text else F.lit(None).cast("string")).alias("format"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
