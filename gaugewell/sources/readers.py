"""Reading tables, samples and load-quality figures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.columns import num, quoted

# File suffix to kind.
KINDS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".xlsx": "excel", ".xls": "excel"}


class UnsupportedFormat(ValueError):
    """The suffix names no readable table format."""


def kind_of(path: str) -> str:
    low = path.rstrip("/").lower()
    for suffix, kind in KINDS.items():
        if low.endswith(suffix):
            return kind
    raise UnsupportedFormat(f"unsupported file type: {path}")


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    encoding: str = "utf-8",
    quote: str = '"',
    header: bool = True,
    skip_rows: int = 0,
    schema: str | T.StructType | None = None,
    infer: bool = True,
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """CSV scan.  A given schema saves the inference pass over the files."""
    if skip_rows:
        return _csv_after(spark, path, sep, encoding, quote, header, skip_rows, schema, infer)
    reader = spark.read.options(sep=sep, encoding=encoding, quote=quote, header=header, mode=mode, escape=quote)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.csv(path, inferSchema=infer)


def _csv_after(spark, path, sep, encoding, quote, header, skip, schema, infer) -> DataFrame:
    """Drops the first lines of every file, then parses line by line.

    Only lines of a file's first split are numbered; the others pass through.
    """
    lines = (
        spark.read.option("encoding", encoding)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    lead = skip + (1 if header else 0)
    head = lines.where(F.col("start") == 0)
    numbered = head.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    body = numbered.where(F.col("line") > lead).select("value").unionByName(lines.where(F.col("start") > 0).select("value"))
    body = body.where(F.trim("value") != "")
    options = {"sep": sep, "quote": quote, "escape": quote}
    if schema is None:
        first = numbered.where(F.col("line") == (lead if header else skip + 1)).orderBy("file").select("value").first()
        width_line = first[0] if first else ""
        import csv

        cells = next(csv.reader([width_line], delimiter=sep, quotechar=quote), [])
        names = cells if header else [f"_c{i}" for i in range(len(cells))]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = body.select(F.from_csv("value", ddl, options).alias("r")).select("r.*")
    if infer and not isinstance(schema, str) and all(isinstance(f.dataType, T.StringType) for f in schema.fields):
        from gaugewell.operators.clean import retype

        return retype(rows)
    return rows


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[quoted(c) for c in columns]) if columns else df


def read_json(spark: SparkSession, path: str, multiline: bool = False, schema: str | None = None) -> DataFrame:
    """JSON lines, or one JSON array per file with ``multiline``."""
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader chosen by the suffix."""
    kind = kind_of(path)
    readers = {"csv": read_csv, "parquet": read_parquet, "json": read_json}
    if kind not in readers:
        raise UnsupportedFormat(f"{kind} files are not readable: {path}")
    return readers[kind](spark, path, **options)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), chosen by a hash of the key, the same on every run.

    A hash cut-off keeps the final top-n small however many partitions there are.
    """
    total = df.count()
    if total <= n:
        return df
    mixed = F.xxhash64(*[quoted(k) for k in key], F.lit(seed))
    tagged = df.withColumn("_h", mixed)
    share = min(1.0, (n + 10 * math.sqrt(n) + 10) / total)
    cutoff = int(-(2**63) + share * (2**64 - 1))
    near = tagged.where(F.col("_h") <= cutoff) if share < 1.0 else tagged
    if share < 1.0 and near.count() < n:  # repeated keys can thin out one hash range
        near = tagged
    return near.orderBy("_h", *[quoted(k) for k in key]).limit(n).drop("_h")


def column_info(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, nullable boolean")


def head_rows(df: DataFrame, key: Sequence[str], n: int = 10, max_columns: int | None = None) -> DataFrame:
    return df.orderBy(*[quoted(k) for k in key]).limit(n).select(*[quoted(c) for c in df.columns[:max_columns]])


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def load_quality(df: DataFrame) -> DataFrame:
    """Rows, columns, null cells, repeated rows and their shares.

    One shuffle: copies are counted per distinct row, and null cells are summed
    over the distinct rows weighted by their copies.
    """
    width = len(df.columns)
    gaps = F.lit(0)
    for f in df.schema.fields:
        c = num(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else quoted(f.name)
        gaps = gaps + c.isNull().cast("int")
    copies = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    stats = copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(gaps * F.col("_n")), F.lit(0)).cast("long").alias("missing_values"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    rows = F.col("total_rows")
    return stats.select(
        rows,
        F.lit(width).cast("long").alias("total_columns"),
        "missing_values",
        "duplicate_rows",
        F.when(rows * width > 0, F.col("missing_values") / (rows * width) * 100).otherwise(0.0).alias("missing_percentage"),
        F.when(rows > 0, F.col("duplicate_rows") / rows * 100).otherwise(0.0).alias("duplicate_percentage"),
        F.lit(estimated_bytes(df) / (1024.0 * 1024.0)).alias("memory_mb"),
    )
