"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.session import cut_lineage, scratch_path, shared_folder, shuffle_partitions

__all__ = ["cut_lineage", "hot_keys", "join_totals", "label_hash", "low_hash", "map_batches", "packed", "row_key", "salted_join", "scratch_path", "shared_folder", "shuffle_partitions"]

#: A key is hot if it holds over 1/SHARE of all rows, HOT_ROWS and two even partitions: never over SHARE keys.
SHARE, HOT_ROWS = 1000, 256


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of columns (lists, numpy or Arrow arrays)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for out in fn(batches):
            columns = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def packed(df: DataFrame) -> Column:
    """Whole rows as one struct, so that added columns never clash with the caller's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """md5 of id and text; rows that repeat both share it."""
    ident, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), ident), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))).cast("binary")))


def label_hash(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id has the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def low_hash(column: Column, wanted: int, total: int) -> Column:
    """Whether a hash is among about the ``wanted`` smallest of ``total`` (somewhat more, all if there are no more): a filter, no sort."""
    share = (wanted + 10 * math.sqrt(wanted) + 10) / max(total, 1)
    return F.lit(True) if share >= 1 else column <= F.lit(int(-(2**63) + share * 2**64))


def hot_keys(rows: DataFrame, totals: DataFrame, keys: Sequence[str], size: str) -> DataFrame | None:
    """The keys of ``totals`` (one row for each key) whose ``size`` rows fill more than twice an even partition, None if there are none.

    They hold over 1/SHARE of all rows as well, so there are at most SHARE.
    """
    every, largest = totals.agg(F.sum(size), F.max(size)).first()
    least = max(HOT_ROWS, 2 * (every or 0) // shuffle_partitions(rows), (every or 0) // SHARE)
    return totals.filter(F.col(size) > least).select(*keys) if (largest or 0) > least else None


def join_totals(rows: DataFrame, totals: DataFrame, keys: Sequence[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``totals``, which has one row for each key and says in ``size`` how many rows hold it.

    Keys are not null.  The hot ones (at most 1000, the bound of what is
    broadcast) are dealt over all partitions: their row of ``totals`` is
    repeated for each salt, their rows take a salt by their place in their
    partition.
    """
    hot = hot_keys(rows, totals, keys, size)
    return rows.join(totals, list(keys), how) if hot is None else salted_join(rows, totals, keys, hot, how)


def salted_join(rows: DataFrame, other: DataFrame, keys: Sequence[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """An equi-join in which the rows of the ``hot`` keys (at most SHARE of them) are dealt over all partitions and the other side is repeated there."""
    salts = shuffle_partitions(rows)
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    left = rows.join(marked, list(keys), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = other.join(marked, list(keys), "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
