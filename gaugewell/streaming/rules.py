"""The row-wise and per-batch operators on a stream: thresholds are learned in batch and frozen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugewell.functions.columns import num
from gaugewell.operators.outliers import iqr_fences
from gaugewell.operators.validate import validate


def frozen_fences(history: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Outlier bounds of a finished table, as plain numbers."""
    return {c: (b[2], b[3]) for c, b in iqr_fences(history, columns, k).items()}


def flag_stream(stream: DataFrame, fences: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Adds ``<column>_outlier``; stateless, so it runs on ``readStream`` as on a table."""
    return stream.withColumns({f"{c}_outlier": F.coalesce(~num(c).between(F.lit(lo), F.lit(hi)), F.lit(False)) for c, (lo, hi) in fences.items()})


def validate_stream(stream: DataFrame, rules: Sequence[str], column_rules: Mapping[str, Mapping], issues_path: str, checkpoint: str) -> StreamingQuery:
    """Checks every micro-batch and appends its issue rows, tagged with the batch number."""

    def check(batch: DataFrame, number: int) -> None:
        issues = validate(batch, rules, column_rules).withColumn("batch", F.lit(number))
        # One folder per batch: a repeated batch replaces its own rows.
        issues.write.mode("overwrite").parquet(f"{issues_path}/batch={number}")

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
