"""Exact quantiles without gathering a column in one place.

Spark's ``percentile`` keeps one map entry per distinct value in the final
aggregation buffer, which does not hold for a continuous column of many rows.
Here a sketch (``percentile_approx``) only brackets each wanted rank; counts
verify the bracket, and the exact selection runs on the few rows inside it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions.columns import num, quoted
from gaugewell.plans.joins import join_groups

ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY
DIRECT_ROWS = 100_000
DIRECT_CELLS = 1_000_000
MAX_PASSES = 8


@dataclass
class _Target:
    column: int
    prob: float
    rank: int
    part: float
    low: float
    high: float
    below: int = 0
    inside: int = 0
    margin: float = MARGIN
    settled: bool = False


def wide_quantiles(
    df: DataFrame,
    columns: Sequence[str | Column],
    probs: Sequence[float],
    counts: Sequence[int] | None = None,
    direct_rows: int | None = None,
) -> list[list[float | None]]:
    """Linear-interpolation quantiles: one list per column, one value per prob.

    ``counts`` (non-null rows per column) saves a pass when already known.
    """
    xs = [num(c) for c in columns]
    if counts is None:
        row = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)]).first()
        counts = [row[i] for i in range(len(xs))]
    longest = max(counts, default=0)
    if longest <= (direct_rows or DIRECT_ROWS) or (direct_rows is None and longest * len(xs) <= DIRECT_CELLS):
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        row = df.agg(*[F.percentile(x, wanted).alias(f"q{i}") for i, x in enumerate(xs)]).first()
        return [list(row[i]) if row[i] is not None else [None] * len(probs) for i in range(len(xs))]

    ends = df.agg(*[f(x) for x in xs for f in (F.min, F.max)]).first() if {0.0, 1.0} & set(map(float, probs)) else None
    targets = []
    found = {(i, p): ends[2 * i + (p == 1)] for i in range(len(xs)) for p in probs if p in (0, 1)} if ends else {}
    for i, n in enumerate(counts):
        for p in probs:
            if (i, p) in found:
                continue
            place = p * (n - 1) if n else 0.0
            rank = int(math.floor(place))
            targets.append(_Target(i, p, rank, place - rank, -math.inf, math.inf, 0, n))
    live = [t for t in targets if counts[t.column]]
    for _ in range(MAX_PASSES):
        open_ = [t for t in live if not t.settled and t.inside > (direct_rows or DIRECT_ROWS)]
        if not open_:
            break
        _narrow(df, xs, open_)
    if any(t.margin > MARGIN and not t.settled and t.inside > (direct_rows or DIRECT_ROWS) for t in live):
        raise RuntimeError("no bracket covers its rank")
    _select(df, xs, live)
    found |= {(t.column, t.prob): t.low for t in live}
    return [[found.get((i, p)) for p in probs] for i in range(len(xs))]


def _within(x: Column, t: _Target) -> Column:
    cond = F.lit(True)
    if t.low != -math.inf:
        cond = cond & (x >= F.lit(t.low))
    if t.high != math.inf:
        cond = cond & (x <= F.lit(t.high))
    return F.when(cond, x)


def _narrow(df: DataFrame, xs: list[Column], targets: list[_Target]) -> None:
    # Targets that still share a bracket share one sketch.
    groups: dict[tuple, list[int]] = {}
    for j, t in enumerate(targets):
        groups.setdefault((t.column, t.low, t.high), []).append(j)
    sketches = []
    for i, members in enumerate(groups.values()):
        ends = []
        for j in members:
            t = targets[j]
            local = (t.rank - t.below + 0.5) / t.inside
            ends += [F.lit(max(0.0, local - t.margin)), F.lit(min(1.0, local + t.margin))]
        first = targets[members[0]]
        sketches.append(F.percentile_approx(_within(xs[first.column], first), F.array(*ends), ACCURACY).alias(f"s{i}"))
    row = df.agg(*sketches).first()
    bounds: dict[int, tuple[float, float]] = {}
    for i, members in enumerate(groups.values()):
        for place, j in enumerate(members):
            bounds[j] = (row[i][2 * place], row[i][2 * place + 1])
    checks = []
    for j, t in enumerate(targets):
        lo, hi = bounds[j]
        x = xs[t.column]
        checks.append(F.count(F.when(x < F.lit(lo), 1)).alias(f"b{j}"))
        checks.append(F.count(F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), 1)).alias(f"i{j}"))
    got = df.agg(*checks).first()
    for j, t in enumerate(targets):
        lo, hi = bounds[j]
        below, inside = got[2 * j], got[2 * j + 1]
        last = t.rank + (1 if t.part else 0)
        if not below <= t.rank <= last < below + inside:
            t.margin *= 4  # the sketch was off: look wider in the next pass
        elif inside < t.inside:
            t.low, t.high, t.below, t.inside = lo, hi, below, inside
            t.settled = lo == hi
        else:
            # Heavy ties: the bracket cannot shrink further, its distinct values are few.
            t.settled = True


def _select(df: DataFrame, xs: list[Column], targets: list[_Target]) -> None:
    picks, waiting = [], []
    for t in targets:
        if t.low == t.high and t.inside:
            continue
        share = 0.0 if t.inside <= 1 else (t.rank - t.below + t.part) / (t.inside - 1)
        picks.append(F.percentile(_within(xs[t.column], t), F.lit(min(1.0, share))).alias(f"v{len(picks)}"))
        waiting.append(t)
    if picks:
        row = df.agg(*picks).first()
        for j, t in enumerate(waiting):
            t.low = row[j]


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], small: int = 20_000
) -> DataFrame:
    """Lazy exact quantiles per group: columns keys…, ``n``, ``q0``, ``q1``, …

    Groups over ``small`` rows are bracketed first, so a group that holds a
    third of the table sends only a sliver of its rows into the ranking window.
    """
    src = df.select(*[quoted(k) for k in keys], num(value).alias("_x")).where(F.col("_x").isNotNull())
    ends = []
    for p in probs:
        ends += [max(0.0, p - 2 * MARGIN), min(1.0, p + 2 * MARGIN)]
    base = src.groupBy(*keys).agg(
        F.count("_x").alias("n"),
        F.percentile_approx("_x", F.array(*[F.lit(e) for e in ends]), ACCURACY).alias("_e"),
    )
    targets = base.select(
        *keys,
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(j).alias("_j"),
                        F.when(F.col("n") > small, F.col("_e")[2 * j]).otherwise(F.lit(float("-inf"))).alias("_lo"),
                        F.when(F.col("n") > small, F.col("_e")[2 * j + 1]).otherwise(F.lit(float("inf"))).alias("_hi"),
                        (F.lit(float(p)) * (F.col("n") - 1)).alias("_place"),
                    )
                    for j, p in enumerate(probs)
                ]
            )
        ),
    )
    bounds = targets.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("_j", "_lo", "_hi", "_place"))).alias("_t"),
    )
    joined = join_groups(src, bounds, list(keys)) if keys else src.join(F.broadcast(bounds))
    per = joined.select(
        *keys, "n", "_x", F.inline(F.transform("_t", lambda t: F.struct(t["_j"].alias("_j"), t["_lo"].alias("_lo"), t["_hi"].alias("_hi"), t["_place"].alias("_place"))))
    ).where(F.col("_x") <= F.col("_hi"))
    tallied = (
        per.select(*keys, "n", "_j", "_place", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_x"))
        .groupBy(*keys, "n", "_j", "_place", "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    order = Window.partitionBy(*keys, "_j").orderBy(F.col("_x").asc_nulls_first())
    ranked = tallied.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    floor = F.floor("_place")
    lower = F.min(F.when(F.col("_upto") > floor, F.col("_x")))
    upper = F.min(F.when(F.col("_upto") > F.ceil("_place"), F.col("_x")))
    under = F.max(F.when(F.col("_x").isNull(), F.col("_upto")).otherwise(0))
    one = ranked.groupBy(*keys, "n", "_j", "_place").agg(lower.alias("_a"), upper.alias("_b"), under.alias("_under"))
    missed = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_under") > floor)
    one = one.withColumn("_a", F.when(missed, F.raise_error(F.lit("no bracket covers its rank")).cast("double")).otherwise(F.col("_a")))
    blend = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - floor)
    return one.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_j") == j, blend)).alias(f"q{j}") for j in range(len(probs))])
