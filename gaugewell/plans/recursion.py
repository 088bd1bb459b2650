"""Recursions along series of any length, exact from block to block.

A series is cut into blocks, each a row with its values.  A recursion with
constant coefficients maps the state before a block to the state after it by an
affine map: the homogeneous part depends on the parameters and the number of
rows alone, the rest is the block's end from a zero start.  So one pass gives
every block's end from zero, the maps are composed per series (in groups, a
level up for each factor of the fan), and the next pass runs every block from
its true state.  Inside a block the same is done with short stretches, which
run side by side as one numpy vector for each step.

Recursions that are not affine start from a guess and sweep: every block hands
its end to the next one until no state changes any more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.plans.blocks import key_schema, series_keys
from gaugewell.plans.joins import join_groups, null_safe_join
from gaugewell.plans.ordering import halo_blocks
from gaugewell.session import cut_lineage

BLOCK = 50_000
FAN = 512  # block summaries of a series that one task composes
SETTLED = 1e-13  # relative change of a state that counts as none


class Recursion(Protocol):
    """What a model needs for its errors to be computed block by block."""

    affine: bool
    period: int
    skip: int  # rows before a block that its inputs read

    def inputs(self, y: np.ndarray, theta: Sequence[float], halo: int) -> np.ndarray: ...

    def first_state(self, y: np.ndarray, theta: Sequence[float]) -> np.ndarray: ...

    def steps(self, inputs: np.ndarray, state: np.ndarray, theta: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """Errors and the state after them, for inputs (rows × stretches) and states (size × stretches)."""


def packed(series: DataFrame, before: int, period: int, size: int | None = None) -> DataFrame:
    """(keys…, series, _block, first, n, halo, y): a row for each block, ``halo`` of its values being rows of the block before.

    Block lengths are multiples of the period.
    """
    keys = series_keys(series)
    size = size or max(BLOCK, 8 * before)
    size = max(1, math.ceil(size / max(period, 1))) * max(period, 1)
    dealt = halo_blocks(series, "idx", before, 0, size)
    rows = dealt.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("r"), F.min(F.when(F.col("_core"), F.col("idx"))).alias("first"), F.first("n").alias("n"))
    rows = rows.where(F.col("first").isNotNull())
    return cut_lineage(rows.select(*keys, "_block", "first", "n", (F.col("first") - F.col("r")[0]["idx"]).cast("int").alias("halo"), F.col("r.value").alias("y")))


def _stretch(model: Recursion, rows: int) -> int:
    """Rows of a stretch: about the root of the block's, a multiple of the period."""
    period = max(model.period, 1)
    return max(1, round(math.sqrt(rows) / period)) * period


def transition(model: Recursion, theta: Sequence[float], rows: int, size: int) -> np.ndarray:
    """The matrix that takes a state over ``rows`` rows without input."""
    length = _stretch(model, rows)
    eye = np.eye(size)
    over = np.linalg.matrix_power(model.steps(np.zeros((length, size)), eye, theta)[1], rows // length)
    rest = rows % length
    return model.steps(np.zeros((rest, size)), over, theta)[1] if rest else over


def run_block(model: Recursion, theta: Sequence[float], inputs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Errors of a block and the state after it."""
    size, rows = len(state), len(inputs)
    length = _stretch(model, rows)
    several = rows // length
    if not model.affine or several < 8 or size > 4 * length:
        errors, end = model.steps(inputs[:, None], state[:, None], theta)
        return errors[:, 0], end[:, 0]
    if size == 0:
        return model.steps(inputs[:, None], state[:, None], theta)[0][:, 0], state
    cut = several * length
    alone, ends = model.steps(np.ascontiguousarray(inputs[:cut].reshape(several, length).T), np.zeros((size, several)), theta)
    answer, over = model.steps(np.zeros((length, size)), np.eye(size), theta)
    starts = np.empty((size, several))
    for k in range(several):
        starts[:, k] = state
        state = over @ state + ends[:, k]
    errors = (alone + answer @ starts).T.ravel()
    if cut < rows:
        rest, end = model.steps(inputs[cut:, None], state[:, None], theta)
        return np.r_[errors, rest[:, 0]], end[:, 0]
    return errors, state


def _records(rows: DataFrame, keys: Sequence[str], fn: Callable[[dict[str, Any]], dict | None], schema: str) -> DataFrame:
    """``fn`` on every row; its columns follow the keys."""
    names = [*keys, *[c.split()[0].strip("`") for c in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                got = fn(row)
                if got is not None:
                    out.append({**{k: row[k] for k in keys}, **got})
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, key_schema(rows, keys) + ", " + schema)


def _nested(states: list[np.ndarray]) -> list[list[float]]:
    return [[float(x) for x in np.nan_to_num(s, nan=1e300, posinf=1e300, neginf=-1e300)] for s in states]


def block_runs(
    model: Recursion, blocks: DataFrame, params: DataFrame, variants: Callable[[dict], list[np.ndarray]],
    fn: Callable[[dict, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]], dict | None], schema: str, fan: int | None = None,
) -> DataFrame:
    """``fn(row, y, runs)`` on every block, run from its true state.

    ``params`` has one row for each series; ``variants(row)`` gives the
    parameter vectors, ``runs`` the errors, the start and the end for each.
    """
    keys = [c for c in blocks.columns if c not in ("_block", "first", "n", "halo", "y")]
    rows = join_groups(blocks, params, keys)

    def runs(row: dict, starts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        y, halo = np.asarray(row["y"], dtype=float), int(row["halo"])
        out = []
        with np.errstate(all="ignore"):
            for i, theta in enumerate(variants(row)):
                if starts is None:
                    start = model.first_state(y[halo:], theta)
                    start = start if row["_block"] == 0 or not model.affine else np.zeros_like(start)
                else:
                    start = np.asarray(starts[i], dtype=float)
                errors, end = run_block(model, theta, model.inputs(y, theta, halo), start)
                out.append((errors, start, end))
        return out

    def end_of(row: dict) -> dict | None:
        if row["first"] + len(row["y"]) - row["halo"] >= row["n"]:
            return None  # the last block of its series
        return {"_at": int(row["_block"]), "rows": len(row["y"]) - int(row["halo"]), "reset": row["_block"] == 0, "v": _nested([e for _, _, e in runs(row, row.get("start"))])}

    ends_schema = "_at long, rows long, reset boolean, v array<array<double>>"
    starts = None
    if not blocks.where("_block > 0").isEmpty():
        ends = cut_lineage(_records(rows, keys, end_of, ends_schema))
        if model.affine:
            starts = cut_lineage(_composed(model, join_groups(ends, params, keys), keys, variants, fan or FAN))
        else:
            starts = _swept(rows, keys, ends, end_of, ends_schema)
        rows = null_safe_join(rows, starts, [*keys, "_block"], "left")

    def done(row: dict) -> dict | None:
        start = row.get("start")
        return fn(row, np.asarray(row["y"], dtype=float), runs(row, start))

    return _records(rows, keys, done, schema)


def _after(ends: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return ends.select(*keys, (F.col("_at") + 1).alias("_block"), F.col(value).alias("start"))


def _composed(model: Recursion, ends: DataFrame, keys: Sequence[str], variants: Callable[[dict], list[np.ndarray]], fan: int) -> DataFrame:
    """(keys…, _block, start) from the blocks' own ends (keys…, _at, rows, reset, v, parameters…): s after block k is M(rows) s before it + v."""
    kept = [c for c in ends.columns if c not in (*keys, "_at", "rows", "reset", "v", "_group", "start")]
    kinds = dict(ends.dtypes)

    def fold(pdf: pd.DataFrame, state):
        """(rows so far, whether a start of a series was met, states after each row)."""
        pdf = pdf.sort_values("_at")
        first = pdf.iloc[0].to_dict()
        thetas, held = variants(first), {}
        after, total, reset = [], 0, False
        for n, new, v in zip(pdf["rows"], pdf["reset"], pdf["v"]):
            ends_of = [np.asarray(x, dtype=float) for x in v]
            if not new and state is not None:
                if n not in held:
                    held[n] = [transition(model, t, int(n), len(s)) for t, s in zip(thetas, ends_of)]
                ends_of = [m @ s + x for m, s, x in zip(held[n], state, ends_of)]
            reset = reset or bool(new)
            state, total = ends_of, total + int(n)
            after.append(_nested(state))
        return pdf, total, reset, after

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["start"].iloc[0] if "start" in pdf else None
        pdf, _, _, after = fold(pdf, None if start is None else [np.asarray(s, dtype=float) for s in start])
        out = pdf[[*keys]].copy()
        out["_block"], out["start"] = pdf["_at"] + 1, after
        return out

    schema = key_schema(ends, keys) + ", _block long, start array<array<double>>"
    if (ends.agg(F.max("_at")).first()[0] or 0) < fan:
        return ends.groupBy(*keys).applyInPandas(each, schema)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, total, reset, after = fold(pdf, None)
        out = pdf[[*keys, *kept]].iloc[:1].copy()
        out["_at"], out["rows"], out["reset"], out["v"] = pdf["_group"].iloc[0], total, reset, [after[-1]]
        return out

    grouped = ends.withColumn("_group", F.expr(f"_at div {fan}"))
    shape = key_schema(ends, keys) + "".join(f", `{c}` {kinds[c]}" for c in kept) + ", _at long, rows long, reset boolean, v array<array<double>>"
    above = cut_lineage(_composed(model, cut_lineage(grouped.groupBy(*keys, "_group").applyInPandas(whole, shape)), keys, variants, fan))
    joined = null_safe_join(grouped, above.withColumnRenamed("_block", "_group"), [*keys, "_group"], "left")
    return joined.groupBy(*keys, "_group").applyInPandas(each, schema)


def _swept(rows: DataFrame, keys: Sequence[str], ends: DataFrame, end_of: Callable, schema: str) -> DataFrame:
    """Starts for a recursion that is not affine: ends are handed on until they stay as they are; at most as many sweeps as blocks."""
    old = ends
    while True:
        starts = _after(old, keys, "v")
        new = cut_lineage(_records(null_safe_join(rows, starts, [*keys, "_block"], "left"), keys, end_of, schema))
        both = null_safe_join(new.select(*keys, "_at", F.flatten("v").alias("new")), old.select(*keys, "_at", F.flatten("v").alias("old")), [*keys, "_at"])
        moved = F.exists(F.zip_with("new", "old", lambda a, b: F.abs(a - b) > SETTLED * F.greatest(F.abs(a), F.abs(b))), lambda x: x)
        if both.where(moved).isEmpty():
            return cut_lineage(_after(new, keys, "v"))
        old = new
