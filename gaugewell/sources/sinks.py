"""Writing tables, summaries and report bundles."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.functions.columns import quoted


def write_csv(df: DataFrame, path: str, separator: str = ",", header: bool = True, quote: str = '"', null_value: str = "", mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, sep=separator, header=header, quote=quote, escape=quote, nullValue=null_value, emptyValue="")


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def write_json(df: DataFrame, path: str, orient: str = "records", metadata: bool = False, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """Line-delimited JSON in one of four shapes.

    ``records``: an object per line; ``index``: row number → object; ``values``:
    an array per line; ``table``: records plus a schema line in ``<path>_schema``.
    ``metadata`` adds row count and column names in ``<path>_metadata``.
    """
    spark = df.sparkSession
    if orient in ("records", "table"):
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif orient in ("index", "values"):
        json_lines(df, orient, order).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown orient {orient!r}")
    if orient == "table":
        fields = [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]
        spark.createDataFrame([(json.dumps({"fields": fields}, ensure_ascii=False),)], "value string").write.mode(mode).text(path + "_schema")
    if metadata:
        info = df.agg(
            F.current_timestamp().cast("string").alias("export_time"),
            F.count(F.lit(1)).alias("row_count"),
            F.lit(len(df.columns)).alias("column_count"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        )
        info.write.mode(mode).json(path + "_metadata")


def json_lines(df: DataFrame, orient: str, order: list[str] | None = None) -> DataFrame:
    """One text line per row: ``values`` arrays or ``index`` objects."""
    keep = {"ignoreNullFields": "false"}
    if orient == "values":
        cells = [F.coalesce(_cell(f), F.lit("null")) for f in df.schema.fields]
        return df.select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("value"))
    from gaugewell.plans.ordering import with_position

    if not order:
        raise ValueError("orient 'index' numbers the rows and needs an order")
    placed = with_position(df, order, out="_row")
    record = F.to_json(F.struct(*[quoted(c) for c in df.columns]), keep)
    return placed.select(F.concat(F.lit('{"'), F.col("_row").cast("string"), F.lit('":'), record, F.lit("}")).alias("value"))


def _cell(f: T.StructField) -> Column:
    """JSON text of one cell, taken out of a one-field object."""
    boxed = F.to_json(F.struct(quoted(f.name).alias("v")), {"ignoreNullFields": "false"})
    return F.regexp_extract(boxed, r'(?s)^\{"v":(.*)\}$', 1)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs to flat ``a_b_c`` columns."""

    def walk(schema: T.StructType, path: tuple[str, ...]):
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here))

    return df.select(*walk(df.schema, ()))


def summary_document(parts: Mapping[str, DataFrame], max_rows: int = 100_000) -> DataFrame:
    """One JSON row holding each result table as an array of objects.

    Result tables have a row per column, pair or test; row-level tables belong
    in ``export_report`` and are refused here.
    """
    out = None
    for name, table in parts.items():
        if table.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"{name} has over {max_rows} rows: export it as its own table")
        one = table.agg(F.to_json(F.array_sort(F.collect_list(F.to_json(F.struct("*"))))).alias("rows")).select(
            F.lit(name).alias("part"), "rows"
        )
        out = one if out is None else out.unionByName(one)
    return out


def export_summary(parts: Mapping[str, DataFrame], path: str, kind: str = "json", mode: str = "overwrite", max_rows: int = 1_000) -> None:
    """All parts as JSON, or side by side as a flattened CSV line.

    A part of one row gives columns part_column, one of several rows
    part_number_column, the rows numbered from 0 in the order of their columns.
    Parts over ``max_rows`` rows are no summary and are refused.
    """
    if kind == "json":
        summary_document(parts).write.mode(mode).json(path)
        return
    rows: dict = {}
    for name, table in parts.items():
        flat = flatten(table)
        found = flat.orderBy(*[quoted(c) for c in flat.columns]).limit(max_rows + 1).collect()
        if len(found) > max_rows:
            raise ValueError(f"{name} has over {max_rows} rows: export it as its own table")
        for i, row in enumerate(found):
            lead = name if len(found) == 1 else f"{name}_{i}"
            rows.update({f"{lead}_{k}": v for k, v in row.asDict().items()})
    spark = next(iter(parts.values())).sparkSession
    write_csv(spark.createDataFrame([tuple(str(v) if v is not None else None for v in rows.values())], ", ".join(f"`{k}` string" for k in rows)), path, mode=mode)


WRITERS = {"csv": write_csv, "parquet": write_parquet, "json": write_json}


def export_report(parts: Mapping[str, DataFrame], folder: str, formats: tuple[str, ...] = ("parquet",)) -> DataFrame:
    """Writes every part in every format and returns (and stores) the manifest."""
    spark = next(iter(parts.values())).sparkSession
    lines = []
    for name, table in parts.items():
        for kind in formats:
            path = f"{folder}/{name}.{kind}"
            try:
                WRITERS[kind](table, path)
                lines.append((name, kind, path, "ok", None))
            except (AnalysisException, ValueError) as e:  # a part that cannot be written must not stop the others
                lines.append((name, kind, path, "failed", str(e)[:500]))
    manifest = spark.createDataFrame(lines, "part string, format string, path string, status string, error string")
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest
