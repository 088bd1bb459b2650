"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NoNumericColumns(ValueError):
    """The table has no column an analysis could use."""


def quoted(name: str) -> Column:
    """Column by exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(name: str | Column) -> Column:
    """Double value with NaN read as null."""
    c = (quoted(name) if isinstance(name, str) else name).cast("double")
    return F.when(~F.isnan(c), c)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def temporal_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def pick_numeric(df: DataFrame, columns: Sequence[str] | None = None, exclude: Iterable[str] = ()) -> list[str]:
    cols = list(columns) if columns is not None else numeric_columns(df, exclude)
    if not cols:
        raise NoNumericColumns("no numeric column to analyse")
    return cols


def nz(c: Column) -> Column:
    """Null in place of zero: a safe denominator under ANSI arithmetic."""
    return F.nullif(c.cast("double"), F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson r over the rows where both are present; null when either is constant there."""
    both = a.isNotNull() & b.isNotNull()
    spread = F.var_pop(F.when(both, a)) * F.var_pop(F.when(both, b))
    r = F.covar_pop(a, b) / nz(F.sqrt(spread))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def unfold(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """One output row per struct in ``rows`` (turns a wide aggregate into a tidy table)."""
    return df.select(F.inline(F.array(*rows)))


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "column", value: str = "value") -> DataFrame:
    """Long form (keep…, name, value) of numeric columns, nulls dropped."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), num(c).alias(value)) for c in columns])
    return df.select(*[quoted(k) for k in keep], F.inline(cells)).where(F.col(value).isNotNull())


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero, for comparable result tables."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and NaN cells of the columns replaced by the column mean (one aggregate)."""
    means = df.agg(*[F.avg(num(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    fill = {c: means[i] if means[i] is not None else 0.0 for i, c in enumerate(columns)}
    return df.withColumns({c: F.coalesce(num(c), F.lit(fill[c])) for c in columns})
