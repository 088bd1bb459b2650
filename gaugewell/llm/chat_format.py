"""Dialogues seen from every participant, with column functions only.

For each participant the dialogue is rendered with that speaker as assistant,
everyone else as a named user and narrators (system) as they are; the mask
covers what the assistant says.  A dialogue is cut into parts by ranges of turn
numbers, so a part is bounded however long the dialogue is; in a part with very
many rows each turn is a part of its own, and rows that share a turn are dealt
into slices by a digest that is also their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugewell.llm.common import HOT_ROWS, SHARE, cut_lineage, join_totals, salted_join

TURNS, ROWS = 64, 1024
LAST = (1 << 62) - 1  # the place of a null turn
END = "<|end|>"


def escaped(text: Column) -> Column:
    """A text cannot hold a marker: ``<|`` becomes ``<\\|``."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def digest(speaker: Column, text: Column) -> Column:
    return F.md5(F.concat(speaker, F.lit(" "), text).cast("binary"))


def _turns(df: DataFrame, conv: str, turn: str, speaker: str, text: str) -> DataFrame:
    c = lambda name: F.col(f"`{name}`")
    rows = df.select(c(conv).alias("conv"), F.coalesce(c(turn).cast("long"), F.lit(LAST)).alias("turn"), escaped(F.coalesce(c(speaker).cast("string"), F.lit("unknown"))).alias("speaker"), escaped(F.coalesce(c(text).cast("string"), F.lit(""))).alias("said"))
    rows = rows.withColumn("anonymous", F.col("conv").isNull()).withColumn("order", digest(F.col("speaker"), F.col("said")))
    return rows.distinct().withColumn("part", F.floor(F.col("turn") / TURNS))


def _sliced(rows: DataFrame) -> DataFrame:
    """Adds own (turn, in a crowded part) and slice."""
    counts = cut_lineage(rows.groupBy("key", "part", "turn").agg(F.count("*").alias("n")))
    counts = counts.withColumn("all", F.sum("n").over(W.partitionBy("key", "part")))
    crowded = counts.filter(F.col("all") > ROWS)
    if crowded.isEmpty():
        return rows.withColumn("own", F.lit(None).cast("long")).withColumn("slice", F.lit(0))
    joined = join_totals(rows, counts, ["key", "part", "turn"], "n")
    slices = F.ceil(F.col("n") * 2 / ROWS)
    place = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * slices / F.lit(float(1 << 32))).cast("int")
    return joined.withColumn("own", F.when(F.col("all") > ROWS, F.col("turn"))).withColumn("slice", F.when((F.col("all") > ROWS) & (F.col("n") > ROWS), place).otherwise(0))


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrators: Sequence[str] = ("system",)) -> DataFrame:
    """conv, participant, part, own, slice, turns, text, mask (array of start, end in characters) for each participant and part.

    Parts in the order of (part, own, slice) make the dialogue up; ``own`` and
    ``slice`` are null and 0 unless a part has over 1024 rows.  Rows that
    repeat all four columns count once; others that share a turn follow each
    other by the digest of speaker and text.  A null turn comes last, a null
    speaker is named ``unknown``, a null text is empty, rows with a null
    dialogue form one.  A dialogue of narrators alone has no participant and
    gives no rows; so does an empty table.  Extra columns are ignored.
    """
    rows = _turns(df, conv, turn, speaker, text).withColumn("key", F.struct("anonymous", F.coalesce("conv", F.lit(0).cast(df.schema[conv].dataType) if df.schema[conv].dataType.typeName() != "string" else F.lit(""))))
    people = rows.filter(~F.col("speaker").isin(*narrators)).groupBy("key", F.col("speaker").alias("participant")).agg(F.count("*").alias("n"))
    parts = _sliced(rows).groupBy("key", "part", "own", "slice").agg(F.first("conv", ignorenulls=True).alias("conv"), F.sort_array(F.collect_list(F.struct("turn", "order", "speaker", "said"))).alias("all"))
    sizes = cut_lineage(people.groupBy("key").agg(F.sum("n").alias("n")))
    every = sizes.agg(F.sum("n")).first()[0] or 0
    hot = sizes.filter((F.col("n") >= HOT_ROWS) & (F.col("n") * SHARE > F.lit(every))).select("key")
    pairs = parts.join(people.drop("n"), "key") if hot.isEmpty() else salted_join(parts, people.drop("n"), ["key"], hot)

    def lead(t: Column) -> Column:
        user = F.concat(F.lit("<|user:"), t["speaker"], F.lit("|>\n"))
        return F.when(t["speaker"] == F.col("participant"), F.lit("<|assistant|>\n")).when(t["speaker"].isin(*narrators), F.concat(F.lit("<|"), t["speaker"], F.lit("|>\n"))).otherwise(user)

    pieces = F.transform("all", lambda t: F.struct(lead(t).alias("lead"), F.concat(t["said"], F.lit(END)).alias("body"), (t["speaker"] == F.col("participant")).alias("mine")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(done: Column, p: Column) -> Column:
        first = done["at"] + F.length(p["lead"])
        last = first + F.length(p["body"])
        return F.struct((last + 1).alias("at"), F.when(p["mine"], F.concat(done["mask"], F.array(F.struct(first.alias("start"), last.alias("end"))))).otherwise(done["mask"]).alias("mask"))

    made = pairs.withColumn("pieces", pieces)
    spoken = F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"], F.lit("\n"))), "")
    return made.select(F.col("conv").alias(conv), "participant", "part", "own", "slice", F.size("all").alias("turns"), spoken.alias("text"), F.aggregate("pieces", start, step, lambda done: done["mask"]).alias("mask"))


def whole_parts(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What :func:`rotate` gives with one row for each conv, participant and part: pieces in the order of own and slice, masks counted in the whole text."""
    ordered = F.sort_array(F.collect_list(F.struct("own", "slice", "turns", "text", "mask")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(done: Column, p: Column) -> Column:
        moved = F.transform(p["mask"], lambda m: F.struct((m["start"] + done["at"]).alias("start"), (m["end"] + done["at"]).alias("end")))
        return F.struct((done["at"] + F.length(p["text"])).alias("at"), F.concat(done["mask"], moved).alias("mask"))

    joined = pieces.groupBy(F.col(f"`{conv}`"), "participant", "part").agg(F.sum("turns").alias("turns"), ordered.alias("pieces"))
    text = F.array_join(F.col("pieces.text"), "")
    return joined.select(F.col(f"`{conv}`"), "participant", "part", "turns", text.alias("text"), F.aggregate("pieces", start, step, lambda done: done["mask"]).alias("mask"))
