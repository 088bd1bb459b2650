"""Analysis history as an append-only table of record versions; the latest version wins."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.functions.columns import quoted

SCHEMA = (
    "id bigint, analysis_id string, file_name string, file_path string, file_size bigint, file_hash string, "
    "analysis_config string, analysis_type string, time_column string, status string, error_message string, "
    "execution_time_ms bigint, result_summary string, created_at timestamp, started_at timestamp, completed_at timestamp, "
    "result_file_path string, chart_files string, version bigint"
)
STATUSES = ("pending", "running", "completed", "failed", "cancelled")
# Error patterns, tried in order without regard to case.
ERROR_PATTERNS = (
    (r"FileNotFoundError|No such file", "file_not_found"),
    (r"PermissionError|Permission denied", "permission_error"),
    (r"UnicodeDecodeError|codec can't decode", "encoding_error"),
    (r"MemoryError|out of memory", "memory_error"),
    (r"ValueError.*could not convert|invalid literal", "data_type_error"),
    (r"TypeError.*unsupported operand", "data_type_error"),
    (r"ModuleNotFoundError|No module named", "dependency_missing"),
    (r"ImportError", "dependency_missing"),
)
CONFIG_KEYS = ("correlation_method", "outlier_method", "outlier_threshold")


def new_record(spark: SparkSession, **fields) -> DataFrame:
    """One pending record; ``analysis_config`` may be a dict."""
    row = {"status": "pending", "created_at": datetime.now(), "version": 0, **fields}
    for k in ("analysis_config", "result_summary", "chart_files"):
        if isinstance(row.get(k), (dict, list)):
            row[k] = json.dumps(row[k], sort_keys=True, ensure_ascii=False)
    names = [p.split()[0] for p in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(row.get(n) for n in names)], SCHEMA)


def conformed(records: DataFrame) -> DataFrame:
    """The log's columns in their types and order."""
    return records.select(*[quoted(n).cast(t).alias(n) for n, t in (p.split() for p in SCHEMA.split(", "))])


def append(records: DataFrame, path: str) -> None:
    conformed(records).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """Newest version of every analysis: an aggregate, so a much-updated record stays cheap."""
    rest = [c for c in log.columns if c != "analysis_id"]
    newest = F.max_by(F.struct(*[quoted(c) for c in rest]), F.struct("version", "id"))
    return log.groupBy("analysis_id").agg(newest.alias("r")).select(*[F.col("r")[c].alias(c) if c != "analysis_id" else F.col(c) for c in log.columns])


def transition(records: DataFrame, status: str, at: Column | None = None, **changes) -> DataFrame:
    """The records' next version in a new state, with its time stamp."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    now = F.current_timestamp() if at is None else at
    out = records.withColumns({"status": F.lit(status), "version": F.col("version") + 1})
    if status == "running":
        out = out.withColumn("started_at", now)
    elif status != "pending":
        out = out.withColumn("completed_at", now)
    return conformed(out.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in changes.items()}))


def start(records: DataFrame, at: Column | None = None) -> DataFrame:
    return transition(records, "running", at)


def complete(records: DataFrame, execution_time_ms, summary: str | Column | None = None, at: Column | None = None) -> DataFrame:
    return transition(records, "completed", at, execution_time_ms=execution_time_ms, result_summary=summary)


def fail(records: DataFrame, message: str | Column, execution_time_ms=None, at: Column | None = None) -> DataFrame:
    return transition(records, "failed", at, error_message=message, execution_time_ms=execution_time_ms)


def cancel(records: DataFrame, at: Column | None = None) -> DataFrame:
    return transition(records, "cancelled", at)


def list_records(log: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0, order_by: str = "created_at", descending: bool = True) -> DataFrame:
    out = latest(log)
    if status is not None:
        out = out.where(F.col("status") == status)
    first = F.col(order_by).desc() if descending else F.col(order_by).asc()
    return out.orderBy(first, "analysis_id").offset(offset).limit(limit)


def recent(log: DataFrame, limit: int = 10) -> DataFrame:
    return list_records(log, limit=limit)


def completed(log: DataFrame, limit: int = 50) -> DataFrame:
    return list_records(log, "completed", limit)


def by_id(log: DataFrame, record_id: int) -> DataFrame:
    return latest(log).where(F.col("id") == record_id)


def by_analysis_id(log: DataFrame, analysis_id: str) -> DataFrame:
    return latest(log.where(F.col("analysis_id") == analysis_id))


def search(log: DataFrame, words: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Substring of file name, path or analysis id, ignoring case; newest first."""
    like = "%" + words.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.col("file_name").ilike(like) | F.col("file_path").ilike(like) | F.col("analysis_id").ilike(like)
    return latest(log).where(hit).orderBy(F.col("created_at").desc(), "analysis_id").offset(offset).limit(limit)


def config_values(config: Column) -> list[Column]:
    return [F.get_json_object(config, f"$.{k}") for k in CONFIG_KEYS]


def find_existing(log: DataFrame, file_hash: str, config: Mapping, analysis_type: str = "comprehensive", time_column: str | None = None) -> DataFrame:
    """Completed runs on the same content, type, time column and settings, newest first."""
    out = latest(log).where(
        (F.col("status") == "completed")
        & (F.col("file_hash") == file_hash)
        & (F.col("analysis_type") == analysis_type)
        & F.col("time_column").eqNullSafe(F.lit(time_column).cast("string"))
    )
    for k, got in zip(CONFIG_KEYS, config_values(F.col("analysis_config"))):
        want = config.get(k)
        if isinstance(want, (int, float)) and not isinstance(want, bool):
            out = out.where(got.cast("double").eqNullSafe(F.lit(float(want))))
        else:
            out = out.where(got.eqNullSafe(F.lit(want).cast("string")))
    return out.orderBy(F.col("created_at").desc(), "analysis_id")


def reusable(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Join form of ``find_existing``: requests (file_hash, analysis_type, time_column, analysis_config) with the newest matching run."""
    mark = lambda df: df.withColumn("_c", F.sha2(F.to_json(F.array(*config_values(F.col("analysis_config")))), 256))
    done = mark(latest(log).where("status = 'completed'"))
    newest = done.groupBy("file_hash", "analysis_type", F.coalesce("time_column", F.lit("")).alias("_t"), "_c").agg(
        F.max_by("analysis_id", F.struct("created_at", "analysis_id")).alias("existing_analysis_id")
    )
    asked = mark(requests).withColumn("_t", F.coalesce("time_column", F.lit("")))
    return asked.join(newest, ["file_hash", "analysis_type", "_t", "_c"], "left").drop("_t", "_c")


def statistics(log: DataFrame) -> DataFrame:
    rows = latest(log)
    done = F.when(F.col("status") == "completed", F.col("execution_time_ms"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES],
        F.max("created_at").alias("last_created"), F.avg(done).alias("mean_execution_ms"),
    )


def status_counts(log: DataFrame) -> DataFrame:
    return latest(log).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def in_period(log: DataFrame, period: str, now: Column | None = None) -> DataFrame:
    """Records created today, this week (from Monday) or this month."""
    moment = F.current_timestamp() if now is None else now
    unit = {"today": "day", "week": "week", "month": "month"}[period]
    return latest(log).where(F.col("created_at") >= F.date_trunc(unit, moment))


def without(log: DataFrame, analysis_ids: Sequence[str]) -> DataFrame:
    return log.where(~F.col("analysis_id").isin(list(analysis_ids)))


def retained(log: DataFrame, days: int = 30, now: Column | None = None) -> DataFrame:
    """All versions of the analyses created within the last ``days`` days."""
    moment = F.current_timestamp() if now is None else now
    keep = latest(log).where(F.col("created_at") >= F.date_sub(moment.cast("date"), days).cast("timestamp"))
    return log.join(keep.select("analysis_id"), "analysis_id", "left_semi").select(*log.columns)


def rewrite(log: DataFrame, path: str) -> None:
    """Stores a reduced log in a new folder (the old one is still being read)."""
    log.write.mode("errorifexists").parquet(path)


def export_record(log: DataFrame, analysis_id: str, path: str) -> None:
    """Record as JSON, configuration and summary unpacked when they parse."""
    row = by_analysis_id(log, analysis_id)
    nested = {c: F.try_parse_json(F.col(c)) for c in ("analysis_config", "result_summary")} if hasattr(F, "try_parse_json") else {}
    row.withColumns(nested).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def one_decimal(x: Column) -> Column:
    """Non-negative double with one decimal, rounded by its exact binary value, ties to even.

    The product 10·x is split into its rounded part and its exact error, which
    decides the cases that look like a tie.
    """
    p = x * 10.0
    big = x * 134217729.0
    high = big - (big - x)
    err = (high * 10.0 - p) + (x - high) * 10.0
    n = F.floor(p).cast("bigint")
    part = p - n
    up = (part > 0.5) | ((part == 0.5) & ((err > 0) | ((err == 0) & (n % 2 == 1))))
    tenths = n + up.cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def size_text(size: Column) -> Column:
    s = size.cast("double")
    return (
        F.when(s < 1024, F.concat(size.cast("string"), F.lit("B")))
        .when(s < 1024**2, F.concat(one_decimal(s / 1024.0), F.lit("KB")))
        .when(s < 1024**3, F.concat(one_decimal(s / 1024.0**2), F.lit("MB")))
        .otherwise(F.concat(one_decimal(s / 1024.0**3), F.lit("GB")))
    )


def duration_text(ms: Column) -> Column:
    d = ms.cast("double")
    return (
        F.when(ms.isNull() | (ms == 0), "unknown")
        .when(d < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(d < 60000, F.concat(one_decimal(d / 1000.0), F.lit("s")))
        .otherwise(F.concat(one_decimal(d / 60000.0), F.lit("min")))
    )


def status_text(status: Column) -> Column:
    words = {"pending": "waiting", "running": "running", "completed": "completed", "failed": "failed", "cancelled": "cancelled"}
    out = F.lit("unknown")
    for k, v in words.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def error_kind(message: Column, exception: Column | None = None) -> Column:
    full = message if exception is None else F.when(exception.isNotNull(), F.concat(exception, F.lit(": "), message)).otherwise(message)
    out = None
    for pattern, kind in ERROR_PATTERNS:
        hit = full.rlike(f"(?i){pattern}")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out
