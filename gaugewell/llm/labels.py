"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import label_hash, low_hash


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str, folds: int, held_out: int, per_class: int, max_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """(y, text) of at most ``per_class`` ids of each label outside the held-out fold, and how many ids each label has.

    Ids are taken by the order of their hash, below a cut-off that leaves little
    to sort however many labels there are.  Null ids and labels are left
    out, of an id with several labels the largest counts.  Texts over
    ``max_bytes`` are no training rows (they are scored like all others).
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("id is not null and y is not null")
    known = known.filter(label_hash(F.col("id"), folds) != held_out).groupBy("id").agg(F.max("y").alias("y"))
    totals = {r["y"]: r["n"] for r in known.filter("y in (0, 1)").groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.filter((F.col("y") == y) & low_hash(F.xxhash64("id"), per_class, totals.get(y, 0))).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= max_bytes)
    return rows.join(F.broadcast(chosen), "id").select("id", "y", "text"), totals
