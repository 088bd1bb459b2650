"""Ordered-row kernels: global positions, running values and halo blocks.

A window without a bounded partition would send a whole series to one task.
Instead rows are cut into buckets by split points, which are whole tuples of
the order columns taken from a sorted sample (literals in the plan, so a
recomputed task lands in the same bucket).  Windows run inside a bucket, and a
small per-bucket summary carries totals across the edges.  Two jobs find the
split points, whatever the values are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions.columns import quoted
from gaugewell.plans.joins import null_safe_join
from gaugewell.session import shuffle_partitions

ROWS_PER_BUCKET = 2_000_000
SAMPLE_PER_BUCKET = 100
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def order_value(df: DataFrame, name: str) -> Column:
    """The order column as a number; text has none."""
    kind = dict(df.dtypes)[name]
    c = quoted(name)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind in ("string", "binary") or kind.startswith(("array", "struct", "map")):
        raise ValueError(f"{name} is no number or time to interpolate along")
    return c.cast("double")


def _exact(df: DataFrame, name: str) -> Column:
    """The order column in a type whose values can be written into a plan, nothing lost."""
    kind = dict(df.dtypes)[name]
    c = quoted(name)
    if kind == "date":
        return F.unix_date(c)
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    return c


def _cut(df: DataFrame, source: str, points: Sequence[float], out: str) -> DataFrame:
    if not points:
        return df.withColumn(out, F.lit(0.0))
    splits = [-math.inf, *points, math.inf]
    return Bucketizer(splits=splits, inputCol=source, outputCol=out, handleInvalid="keep").transform(df)


def split_points(df: DataFrame, order: Sequence[Column], buckets: int | None = None) -> list[tuple]:
    """Tuples of the order columns that cut the rows into about equal parts; a heavy tuple comes several times."""
    n = df.count()
    if buckets is None:
        buckets = max(shuffle_partitions(df), math.ceil(n / ROWS_PER_BUCKET))
    if n == 0 or buckets < 2:
        return []
    names = [f"o{i}" for i in range(len(order))]
    rows = df.select(*[c.alias(x) for c, x in zip(order, names)])
    share = min(1.0, SAMPLE_PER_BUCKET * buckets / n)
    sample = rows if share == 1.0 else rows.sample(False, share, seed=1)
    values = [tuple(r) for r in sample.orderBy(*names).collect()]
    return [values[i * len(values) // buckets] for i in range(1, buckets)] if values else []


def _not_above(points: Sequence[tuple], kinds: Sequence[str], here: Column) -> Column:
    """How many of the sorted points are not above ``here``: first among every √n-th point, then among those between."""
    literals = [F.struct(*[F.lit(v).cast(k).alias(f"o{i}") for i, (v, k) in enumerate(zip(p, kinds))]) for p in points]
    step = max(1, math.isqrt(len(literals)))
    groups = [literals[i : i + step] for i in range(0, len(literals), step)]
    coarse = F.size(F.filter(F.array(*[g[0] for g in groups]), lambda p: p <= here))
    within = F.element_at(F.array(*[F.array(*g) for g in groups]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(within, lambda p: p <= here)))


def _with_bucket(df: DataFrame, points: Sequence[tuple], columns: Sequence[Column], out: str) -> DataFrame:
    """Adds how many of the sorted points are not above the row.

    If the leading column is a number, a binary search among doubles decides;
    whole tuples are compared only where it equals a point's or is not finite.
    """
    names = [f"o{i}" for i in range(len(columns))]
    kinds = [f.dataType.simpleString() for f in df.select(*[c.alias(x) for c, x in zip(columns, names)]).schema]
    whole = _not_above(points, kinds, F.struct(*[c.alias(x) for c, x in zip(columns, names)]))
    if kinds[0].split("(")[0] not in NUMBERS:
        return df.withColumn(out, _number(whole))
    leads = Counter(-math.inf if p[0] is None else float(p[0]) + 0.0 for p in points)  # nulls come first
    edges = sorted(x for x in leads if math.isfinite(x))
    upto = list(accumulate([leads[-math.inf], *[leads[e] for e in edges]]))
    led = _cut(df.withColumn("_lead", columns[0].cast("double") + F.lit(0.0)), "_lead", edges, "_cell")
    lead, at = F.col("_lead"), F.col("_cell").cast("int") + 1
    edge = F.element_at(F.array(*map(F.lit, [-math.inf, *edges])), at)
    clear = (F.abs(lead) < F.lit(math.inf)) & (lead != edge)
    return led.withColumn(out, _number(F.when(clear, F.element_at(F.array(*map(F.lit, upto)), at)).otherwise(whole))).drop("_lead", "_cell")


def _number(bucket: Column) -> Column:
    """A bucket number, never null by its type either."""
    return F.coalesce(bucket.cast("long"), F.lit(0).cast("long"))


def bucketed(df: DataFrame, order: Sequence[str], out: str = "_bucket", buckets: int | None = None) -> DataFrame:
    """Adds a bucket number that follows the order of ``order``, nulls first."""
    return _bucketed(df, order, out, buckets)[0]


def _bucketed(df: DataFrame, order: Sequence[str], out: str, buckets: int | None) -> tuple[DataFrame, list[Column]]:
    """The buckets and the order inside them.

    If whole tuples repeat so often that they fill buckets, a digest of the row
    is added to the order, so that ties are cut as well.
    """
    columns, inside = [_exact(df, o) for o in order], [quoted(o) for o in order]
    points = split_points(df, columns, buckets)
    if len(set(points)) < len(points):
        flat = [quoted(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
        digest = F.xxhash64(*flat)
        columns, inside = [*columns, digest], [*inside, digest]
        points = split_points(df, columns, buckets)
    points = list(dict.fromkeys(points))
    if not points:
        return df.withColumn(out, F.lit(0).cast("long")), inside
    return _with_bucket(df, points, columns, out), inside


def with_position(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), out: str = "idx", buckets: int | None = None
) -> DataFrame:
    """Adds the 0-based position of each row inside its series (``keys``), exact and global."""
    cut, cols = _bucketed(df, order, "_bucket", buckets)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*cols)
    across = Window.partitionBy(*keys).orderBy("_bucket") if keys else Window.partitionBy(F.lit(0)).orderBy("_bucket")
    sizes = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_start", F.sum("_size").over(across.rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "_bucket", F.coalesce("_start", F.lit(0)).alias("_start"))
    )
    placed = cut.withColumn("_rn", F.row_number().over(local))
    return (
        null_safe_join(placed, sizes, [*keys, "_bucket"])
        .withColumn(out, F.col("_start") + F.col("_rn") - 1)
        .drop("_start", "_rn", "_bucket")
    )


def running(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    firsts: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    mins_ahead: dict[str, Column] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Running sums and maxima, last non-null so far, next non-null and minimum still to come.

    Two phases: inside each bucket by a window, across buckets by a carry table
    with one row per (series, bucket).
    """
    sums, lasts, firsts = sums or {}, lasts or {}, firsts or {}
    maxs, mins = maxs or {}, mins_ahead or {}
    cut, cols = _bucketed(df, order, "_bucket", buckets)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*cols)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    # Backwards along the same order: a frame that starts at the row and has no end is computed anew for every row.
    onward = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_seat").desc()).rowsBetween(Window.unboundedPreceding, 0)
    key_struct = F.struct(*cols)
    totals = [F.sum(e).alias(f"_s_{n}") for n, e in sums.items()]
    totals += [F.max_by(e, F.when(e.isNotNull(), key_struct)).alias(f"_l_{n}") for n, e in lasts.items()]
    totals += [F.min_by(e, F.when(e.isNotNull(), key_struct)).alias(f"_f_{n}") for n, e in firsts.items()]
    totals += [F.max(e).alias(f"_x_{n}") for n, e in maxs.items()]
    totals += [F.min(e).alias(f"_m_{n}") for n, e in mins.items()]
    across = Window.partitionBy(*keys).orderBy("_bucket") if keys else Window.partitionBy(F.lit(0)).orderBy("_bucket")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_bucket").desc())
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.groupBy(*keys, "_bucket").agg(*totals)
    carry = carry.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_cs_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in lasts],
        *[F.last(f"_f_{n}", ignorenulls=True).over(after).alias(f"_cf_{n}") for n in firsts],
        *[F.max(f"_x_{n}").over(before).alias(f"_cx_{n}") for n in maxs],
        *[F.min(f"_m_{n}").over(after).alias(f"_cm_{n}") for n in mins],
    )
    inner = cut.withColumns(
        {
            **{f"_ws_{n}": F.sum(e).over(upto) for n, e in sums.items()},
            **{f"_wl_{n}": F.last(e, ignorenulls=True).over(upto) for n, e in lasts.items()},
            **{f"_wx_{n}": F.max(e).over(upto) for n, e in maxs.items()},
            **({"_seat": F.row_number().over(local)} if firsts or mins else {}),
        }
    )
    if firsts or mins:
        inner = inner.withColumns(
            {
                **{f"_wf_{n}": F.last(e, ignorenulls=True).over(onward) for n, e in firsts.items()},
                **{f"_wm_{n}": F.min(e).over(onward) for n, e in mins.items()},
            }
        )
    joined = null_safe_join(inner, carry, [*keys, "_bucket"])
    done = joined.withColumns(
        {
            **{n: F.col(f"_cs_{n}") + F.coalesce(F.col(f"_ws_{n}"), F.lit(0)) for n in sums},
            **{n: F.coalesce(f"_wl_{n}", f"_cl_{n}") for n in lasts},
            **{n: F.coalesce(f"_wf_{n}", f"_cf_{n}") for n in firsts},
            **{n: F.greatest(f"_wx_{n}", f"_cx_{n}") for n in maxs},
            **{n: F.least(f"_wm_{n}", f"_cm_{n}") for n in mins},
        }
    )
    drop = ["_bucket", "_seat"]
    for tag, names in (("s", sums), ("l", lasts), ("f", firsts), ("x", maxs), ("m", mins)):
        for n in names:
            drop += [f"_c{tag}_{n}", f"_w{tag}_{n}"]
    return done.drop(*drop)


def halo_blocks(
    df: DataFrame, idx: str, before: int, after: int, size: int | None = None, out: str = "_block"
) -> DataFrame:
    """Cuts positions into equal blocks, each with copies of its neighbours' edge rows.

    Windows partitioned by (series, ``_block``) with frames inside
    [-before, +after] are then exact on rows where ``_core`` is true.
    """
    size = size or max(50_000, 8 * (before + after))
    i = F.col(idx)
    first = F.floor(F.greatest(i - after, F.lit(0)) / size).cast("long")
    last = F.floor((i + before) / size).cast("long")
    spread = df.withColumn(out, F.explode(F.sequence(first, last)))
    return spread.withColumn("_core", F.col(out) == F.floor(i / size).cast("long"))


def halo_window(keys: Sequence[str], idx: str = "idx", block: str = "_block"):
    return Window.partitionBy(*keys, block).orderBy(idx)
