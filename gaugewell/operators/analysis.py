"""The whole analysis of a table in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ArithmeticException, IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.functions.columns import numeric_columns, quoted
from gaugewell.operators.correlate import correlate, summary
from gaugewell.operators.describe import PERCENTILES, describe, describe_summary
from gaugewell.operators.outliers import iqr_table, zscore_table
from gaugewell.operators.series import analyze_series
from gaugewell.session import cut_lineage, held


@dataclass
class Analysis:
    """Result tables; a part that failed is missing and its error is kept."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def analyze(
    df: DataFrame, time_column: str | None = None, exclude: Sequence[str] = (), percentiles: Sequence[float] = PERCENTILES,
    correlation_method: str = "pearson", outlier_method: str = "iqr", outlier_threshold: float = 3.0,
) -> Analysis:
    """Describe, correlate, find outliers and test the series; one part failing leaves the others."""
    skip = [*exclude, *([time_column] if time_column else [])]
    cols = numeric_columns(df, skip)
    out = Analysis()
    narrow = df.select(*[quoted(c) for c in [*cols, *([time_column] if time_column else [])]])
    with held(narrow) as rows:
        parts = {
            "describe": lambda: {"describe": describe(rows, cols, percentiles=percentiles)},
            "correlation": lambda: {"correlation": correlate(rows, correlation_method, cols)},
            "outliers": lambda: {"outliers": iqr_table(rows, cols) if outlier_method == "iqr" else zscore_table(rows, cols, outlier_threshold)},
        }
        if time_column:
            parts["series"] = lambda: {k: v for k, v in analyze_series(rows, time_column, cols).items() if k != "series"}
        for name, build in parts.items():
            try:
                # Result tables are small; storing them frees the held input.
                out.tables.update({k: cut_lineage(v) for k, v in build().items()})
            except (AnalysisException, ArithmeticException, IllegalArgumentException, ValueError) as e:  # what the data cannot give; lost executors and the like are raised
                out.errors[name] = f"{type(e).__name__}: {e}"
    return out


def overall_summary(analysis: Analysis) -> DataFrame:
    """(part, metric, value) over the parts that ran."""
    t = analysis.tables
    rows = None

    def add(part: str, table: DataFrame) -> None:
        nonlocal rows
        cells = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(c).alias("metric"), quoted(c).cast("double").alias("value")) for c in table.columns])
        more = table.select(F.inline(cells))
        rows = more if rows is None else rows.unionByName(more)

    if "describe" in t:
        add("describe", describe_summary(t["describe"]))
    if "correlation" in t:
        add("correlation", summary(t["correlation"]))
    if "outliers" in t:
        from gaugewell.operators.outliers import outlier_summary

        add("outliers", outlier_summary(t["outliers"]))
    if "stationarity" in t:
        add("series", t["stationarity"].agg(F.count(F.lit(1)).alias("series"), F.count(F.when(F.col("is_stationary"), 1)).alias("stationary")))
    if rows is None:
        raise ValueError(f"no part of the analysis ran: {analysis.errors}")
    return rows
