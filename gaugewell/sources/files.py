"""File listings, checks and fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.functions.columns import quoted
from gaugewell.sources.splits import HEAD_BYTES, chained_md5, head_md5

SUPPORTED = ("csv", "parquet", "xlsx", "json")
#: Files up to this size, that of a usual split, are read whole by one task.
WHOLE_BYTES = 128 * 1024 * 1024


def inventory(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """One row per file under the path: name, size, kind and whether it may be loaded.

    Only metadata columns are selected, so file contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kind = (
        F.when(suffix == "csv", "csv")
        .when(suffix == "parquet", "parquet")
        .when(suffix.isin("xlsx", "xls"), "excel")
        .when(suffix == "json", "json")
        .otherwise("unknown")
    )
    error = F.when(~suffix.isin(*SUPPORTED), F.concat(F.lit("unsupported file type: ."), suffix))
    if max_bytes is not None:
        error = error.when(F.col("length") > max_bytes, F.format_string("file too large: %.1fMB", F.col("length") / 1048576.0))
    return files.select(
        "path", name.alias("file_name"), F.col("length").alias("file_size"), "modificationTime", kind.alias("file_type"),
        error.isNull().alias("is_valid"), error.alias("error_message"),
    )


def file_fingerprints(spark: SparkSession, path: str, head_only: bool = False, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """MD5 of each file, whole or of its first megabyte.

    Files over ``whole_bytes`` are read split by split, or only their first
    megabyte, by jobs that run at once; those that Spark does not split (a
    compressed file's suffix) are read whole like the others.
    """
    reader = spark.read.format("binaryFile")
    files = reader.option("recursiveFileLookup", "true").load(path)
    large = dict(files.where(F.col("length") > whole_bytes).select("path", "length").collect())
    found = (head_md5 if head_only else chained_md5)(spark, large)
    content = F.substring("content", 1, HEAD_BYTES) if head_only else F.col("content")
    prints = files.where(F.col("length") <= whole_bytes).select("path", F.md5(content).alias("md5"))
    if refused := sorted(large.keys() - found.keys()):
        rest = reader.load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in refused])
        prints = prints.unionByName(rest.select("path", F.md5(content).alias("md5")))
    return prints.unionByName(spark.createDataFrame(list(found.items()), prints.schema)) if found else prints


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free content hash; equal tables agree whatever their partitioning."""
    row = F.xxhash64(*[quoted(c) for c in df.columns])
    wide = row.cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(wide), F.lit(0)).cast("string").alias("hash_sum"), F.bit_xor(row).alias("hash_xor"))
