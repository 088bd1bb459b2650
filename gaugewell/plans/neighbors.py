"""Exact neighbour search by a tree of pivot cells and bounded tiles.

Distinct points are assigned to their nearest pivot; a cell with too many of
them gets pivots of its own, level by level, all crowded cells together.  The
triangle inequality tells which cells can hold a neighbour of a point, and the
point is sent only there and on to the cells below.  Only the first level's
pivots are on the driver.  Neighbouring cells lie together in blocks and a
tile is one block against one chunk of queries from one block, so a vector is
shuffled once for a block and not for every cell, and a tile has bounded size.
A tile answers with its best k or with counts, never with all pairs.  Identical
rows are collapsed to one point with a multiplicity beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions.columns import num, quoted
from gaugewell.plans.joins import join_groups
from gaugewell.session import cut_lineage

EPS = float(np.finfo(float).eps)
CHUNK = 16_000  # queries of a tile
BLOCK = 48_000  # members of a tile
PIECE = 1_000_000  # distances held at once in a tile
MAX_PIVOTS = 1_000  # of the first level, and of a cell below
ROWS_PER_PIVOT = 1_000
SPLIT = 8_000  # points of a cell that is not split again


@dataclass
class Cells:
    pivots: np.ndarray
    count: np.ndarray  # distinct points per cell
    low: np.ndarray  # smallest distance of a member to the pivot
    high: np.ndarray  # largest
    kth: np.ndarray  # distance within which the cell holds the wanted multiplicity


@dataclass
class Tree:
    """Points with the path of their cell, the first level, and the cells below it."""

    members: DataFrame  # pid, vec, mult, cell
    top: Cells
    nodes: DataFrame | None  # parent, cell, pivot, n, low, high, kth


def points_of(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(vec, pid, mult): distinct vectors; ``pid`` is the smallest key among the copies."""
    vec = F.array(*[num(c) for c in columns])
    return df.select(quoted(key).alias("_k"), vec.alias("vec")).groupBy("vec").agg(F.min("_k").alias("pid"), F.count(F.lit(1)).alias("mult"))


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; direct differences in low dimension, where cancellation would show."""
    if a.shape[1] <= 16 and a.shape[0] * b.shape[0] * a.shape[1] <= 2**23:
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    d2 = (a**2).sum(axis=1)[:, None] - 2.0 * a @ b.T + (b**2).sum(axis=1)
    return np.sqrt(np.maximum(d2, 0.0))


def choose_pivots(points: DataFrame, seed: int = 42) -> np.ndarray:
    n = points.count()
    want = min(MAX_PIVOTS, max(1, math.ceil(n / ROWS_PER_PIVOT)))
    picked = points.select("vec", F.xxhash64("vec", F.lit(seed)).alias("h")).orderBy("h").limit(want).collect()
    return _matrix([r["vec"] for r in picked])


def assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell`` (nearest pivot) and ``to_pivot``."""

    @F.pandas_udf("cell int, to_pivot double")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        d = distances(_matrix(vec), pivots) if len(vec) else np.zeros((0, len(pivots)))
        cell = d.argmin(axis=1) if len(vec) else np.zeros(0, dtype=int)
        return pd.DataFrame({"cell": cell.astype("int32"), "to_pivot": d[np.arange(len(d)), cell]})

    return points.withColumn("_n", nearest("vec")).select(*points.columns, "_n.cell", "_n.to_pivot")


def cell_stats(assigned: DataFrame, pivots: np.ndarray, k: int) -> Cells:
    p = len(pivots)
    count, low, high, kth = np.zeros(p, dtype=int), np.full(p, np.inf), np.zeros(p), np.full(p, np.inf)
    for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("to_pivot").alias("lo"), F.max("to_pivot").alias("hi")).collect():
        count[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["lo"], r["hi"]
    if k:
        # Upper bound of the distance holding k+1 members, from a sketch per cell (rounded up).
        share = F.percentile_approx("to_pivot", F.array(*[F.lit(i / 64) for i in range(1, 65)]), 1000)
        for r in assigned.groupBy("cell").agg(share.alias("q"), F.count(F.lit(1)).alias("n")).collect():
            need = (k + 1) / r["n"] + 2e-3
            if need <= 1.0:
                kth[r["cell"]] = r["q"][min(63, math.ceil(need * 64))]
            elif r["n"] >= k + 1:
                kth[r["cell"]] = high[r["cell"]]
    return Cells(pivots, count, low, high, kth)


def plant(points: DataFrame, k: int) -> Tree:
    """The tree of the points; ``k`` neighbours are wanted (0 if searches go by radius)."""
    pivots = choose_pivots(points)
    assigned = cut_lineage(assign(points, pivots))
    top = cell_stats(assigned, pivots, k)
    members = assigned.select("pid", "vec", "mult", F.col("cell").cast("string").alias("cell"))
    if not len(top.count) or top.count.max() <= SPLIT:
        return Tree(members, top, None)
    nodes, done, level = None, None, 0
    while True:
        sizes = cut_lineage(members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT))
        if sizes.isEmpty():
            break
        level += 1
        ready = members.join(sizes, "cell", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        lower, below = _split(join_groups(members, sizes, ["cell"]), k, level)
        members = lower
        nodes = below if nodes is None else nodes.unionByName(below)
    return Tree(cut_lineage(members if done is None else done.unionByName(members)), top, None if nodes is None else cut_lineage(nodes))


def _split(crowded: DataFrame, k: int, level: int) -> tuple[DataFrame, DataFrame]:
    """The members (pid, vec, mult, cell, n) of crowded cells in cells of their own pivots, and these cells."""
    want = F.greatest(F.lit(2), F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("n") / ROWS_PER_PIVOT)))
    h = F.xxhash64("vec", F.lit(42 + level))
    share = (want + 5 * F.sqrt(want) + 10) / F.col("n")
    drawn = crowded.withColumns({"_h": h, "_want": want}).where(F.pmod("_h", F.lit(1 << 52)) / float(1 << 52) < share)
    seat = F.row_number().over(Window.partitionBy("cell").orderBy("_h", "pid"))
    pivots = cut_lineage(drawn.withColumn("sub", seat).where("sub <= _want").select("cell", "n", "sub", F.col("vec").alias("pivot")))
    step = 2 * CHUNK
    parts = F.ceil(F.col("n") / step).cast("int")
    left = crowded.withColumn("part", F.pmod(F.xxhash64("pid", F.lit(level)), parts)).select("cell", "part", "pid", "vec", "mult")
    right = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("cell", "part", "sub", "pivot")
    left, right = _fresh(left), _fresh(right)
    kinds = dict(crowded.dtypes)

    def nearest(_key, m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(m):
            return pd.DataFrame()
        y, subs = _matrix(p["pivot"]), p["sub"].to_numpy()
        seats, far = [], []
        for at in range(0, len(m), 2_000):
            d = distances(_matrix(m["vec"].iloc[at : at + 2_000]), y)
            best = d.argmin(axis=1)
            seats.append(subs[best])
            far.append(d[np.arange(len(d)), best])
        out = m[["pid", "vec", "mult"]].copy()
        out["parent"] = m["cell"]
        out["sub"], out["to_pivot"] = np.concatenate(seats), np.concatenate(far)
        return out

    keys = ["cell", "part"]
    schema = f"pid {kinds['pid']}, vec array<double>, mult long, parent string, sub int, to_pivot double"
    placed = cut_lineage(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, schema))
    q = F.percentile_approx("to_pivot", F.array(*[F.lit(i / 64) for i in range(1, 65)]), 1000)
    stats = placed.groupBy("parent", "sub").agg(F.count(F.lit(1)).alias("n"), F.min("to_pivot").alias("low"), F.max("to_pivot").alias("high"), q.alias("q"))
    need = F.lit(float(k + 1)) / F.col("n") + F.lit(2e-3)
    within = F.when(need <= 1.0, F.element_at("q", F.least(F.lit(64), F.ceil(need * 64).cast("int") + 1)))
    kth = F.coalesce(within, F.when(F.col("n") >= k + 1, F.col("high")), F.lit(math.inf)) if k else F.lit(math.inf)
    path = F.concat_ws("/", "parent", "sub")
    named = stats.join(pivots.select(F.col("cell").alias("parent"), "sub", "pivot"), ["parent", "sub"])
    return placed.select("pid", "vec", "mult", path.alias("cell")), named.select("parent", path.alias("cell"), "pivot", "n", "low", "high", kth.alias("kth"))


def _fresh(df: DataFrame) -> DataFrame:
    """Fresh names: both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _reach(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance of a cell's members, a little less for rounding."""
    return np.maximum(np.maximum(d - high, low - d) - 1e-9 * (1.0 + np.abs(d)), 0.0)


def _routed(queries: DataFrame, tree: Tree, radius: float | str | None, chunk: int) -> DataFrame:
    """Queries with ``cell``, once for each lowest cell that can hold a wanted neighbour.

    ``radius`` is a distance, a column of distances, or nothing if the wanted
    number of neighbours bounds the search.
    """
    top, columns = tree.top, queries.columns
    limit = F.col(radius) if isinstance(radius, str) else F.lit(radius).cast("double")

    @F.pandas_udf("bound double, cells array<struct<cell:int,reach:double>>")
    def first(vec: pd.Series, limit: pd.Series) -> pd.DataFrame:
        if not len(vec) or not len(top.count):
            return pd.DataFrame({"bound": np.zeros(len(vec)), "cells": [[] for _ in vec]})
        d = distances(_matrix(vec), top.pivots)
        bound = limit.to_numpy(dtype=float) if radius is not None else (d + top.kth).min(axis=1)
        reach = _reach(d, top.low, top.high)
        near = (reach <= bound[:, None]) & (top.count > 0)
        cells = [[{"cell": int(c), "reach": float(r[c])} for c in np.flatnonzero(n)] for r, n in zip(reach, near)]
        return pd.DataFrame({"bound": bound, "cells": cells})

    rows = queries.withColumn("_f", first("vec", limit)).select(*columns, F.col("_f.bound").alias("bound"), F.explode("_f.cells").alias("_c"))
    rows = cut_lineage(rows.select(*columns, "bound", F.col("_c.cell").cast("string").alias("cell"), F.col("_c.reach").alias("reach")))
    if tree.nodes is None:
        return rows.drop("bound", "reach")
    parents = cut_lineage(tree.nodes.select(F.col("parent").alias("cell")).distinct())
    kinds = dict(queries.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", bound double, cell string, reach double"

    def down(_key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame()
        pivots, paths = _matrix(c["pivot"]), c["cell"].to_numpy()
        low, high, kth = (c[n].to_numpy() for n in ("low", "high", "kth"))
        out = []
        for at in range(0, len(q), 1_000):
            part = q.iloc[at : at + 1_000]
            d = distances(_matrix(part["vec"]), pivots)
            bound = part["bound"].to_numpy()
            if radius is None:
                bound = np.minimum(bound, (d + kth).min(axis=1))
            reach = _reach(d, low, high)
            at_row, at_cell = np.nonzero(reach <= bound[:, None])
            found = part[columns].iloc[at_row].copy()
            found["bound"], found["cell"], found["reach"] = bound[at_row], paths[at_cell], reach[at_row, at_cell]
            out.append(found)
        return pd.concat(out)

    while True:
        inner = cut_lineage(rows.join(parents, "cell", "left_semi"))
        if inner.isEmpty():
            return rows.drop("bound", "reach")
        load = inner.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
        load = cut_lineage(load)
        left = join_groups(inner, load, ["cell"]).withColumn("part", F.pmod(F.xxhash64("qid", F.lit(5)), F.col("parts"))).select(*columns, "bound", F.col("cell").alias("_at"), "part")
        right = tree.nodes.join(load.withColumnRenamed("cell", "parent"), "parent").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = right.select(F.col("parent").alias("_at"), "part", "cell", "pivot", "low", "high", "kth")
        left, right = _fresh(left), _fresh(right)
        lower = left.groupBy("_at", "part").cogroup(right.groupBy("_at", "part")).applyInPandas(down, schema)
        rows = cut_lineage(rows.join(parents, "cell", "left_anti").select(*columns, "bound", "cell", "reach").unionByName(lower))
        if radius is None:  # the best bound any cell gave holds for all
            best = rows.groupBy("qid").agg(F.min("bound").alias("_best"))
            rows = cut_lineage(rows.join(best, "qid").where("reach <= _best").select(*columns, F.col("_best").alias("bound"), "cell", "reach"))


def _along(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order that keeps near ones together: halves along the widest direction."""
    todo, out = [np.arange(len(pivots))], []
    while todo:
        some = todo.pop()
        if len(some) < 3:
            out.extend(some)
            continue
        x = np.nan_to_num(pivots[some])
        x = x - x.mean(axis=0)
        at = np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")
        todo += [some[at[len(some) // 2 :]], some[at[: len(some) // 2]]]
    return np.array(out, dtype=int)


def _blocks(tree: Tree, block: int) -> tuple[DataFrame, np.ndarray, DataFrame | None]:
    """Members with their block, the block of every first cell, and that of the lowest cells if there are levels."""
    order, total = _along(tree.top.pivots), int(tree.top.count.sum())
    group = np.zeros(len(order), dtype=int)
    size = tree.top.count[order]
    group[order] = ((np.cumsum(size) - size / 2) / max(total, 1) * math.ceil(total / block)).astype(int)
    spot = F.element_at(F.array(*[F.lit(int(g)).cast("long") for g in group]), F.split("cell", "/")[0].cast("int") + 1) if len(group) else F.lit(0).cast("long")
    if tree.nodes is None:
        return tree.members.withColumn("block", spot), group, None
    leaves = tree.members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("_g", spot)
    before = F.sum("n").over(Window.partitionBy("_g").orderBy("cell")) - F.col("n")
    leaves = cut_lineage(leaves.select("cell", (F.col("_g") * F.lit(1 << 32) + F.floor(before / block)).cast("long").alias("block")))
    return join_groups(tree.members, leaves, ["cell"]), group, leaves


def _sent(queries: DataFrame, tree: Tree, radius: float | str | None, chunk: int, group: np.ndarray, leaves: DataFrame | None) -> DataFrame:
    """Queries with ``home``, the block of their nearest cell, and ``blocks``, those that can matter."""
    top, columns = tree.top, queries.columns
    limit = F.col(radius) if isinstance(radius, str) else F.lit(radius).cast("double")
    names = np.unique(group)

    @F.pandas_udf("home long, blocks array<long>")
    def route(vec: pd.Series, limit: pd.Series) -> pd.DataFrame:
        home, blocks = [], []
        for at in range(0, len(vec) if len(names) else 0, 2_000):
            d = distances(_matrix(vec.iloc[at : at + 2_000]), top.pivots)
            most = limit.iloc[at : at + 2_000].to_numpy(dtype=float) if radius is not None else (d + top.kth).min(axis=1)
            near = (_reach(d, top.low, top.high) <= most[:, None]) & (top.count > 0)
            hit = np.stack([near[:, group == g].any(axis=1) for g in names], axis=1)
            home += group[np.where(top.count > 0, d, np.inf).argmin(axis=1)].tolist()
            blocks += [names[h] for h in hit]
        return pd.DataFrame({"home": home or [0] * len(vec), "blocks": blocks or [[]] * len(vec)})

    placed = queries.withColumn("_r", route("vec", limit))
    if leaves is None:
        return cut_lineage(placed.select(*columns, "_r.home", "_r.blocks"))
    rows = _routed(placed.select(*columns, F.col("_r.home").alias("home")), tree, radius, chunk)
    found = join_groups(rows, leaves, ["cell"])
    return cut_lineage(found.groupBy(*columns, "home").agg(F.collect_set("block").alias("blocks")))


def tiles(queries: DataFrame, tree: Tree, radius: float | str | None, tile: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, chunk: int | None = None, at_home: bool = False) -> DataFrame:
    """Applies ``tile(queries, members)`` to every (query chunk, member block) that can matter.

    ``queries`` need qid, vec.  Chunks hold queries of one home block, so a
    block is copied only to chunks near it.  ``at_home``: every query meets its
    home block alone (not with a tree of several levels).
    """
    members, group, leaves = _blocks(tree, BLOCK)
    sent = _sent(queries, tree, radius, chunk or CHUNK, group, leaves)
    if at_home:
        sent = sent.withColumn("blocks", F.array("home"))
    load = cut_lineage(sent.groupBy("home").agg(F.count(F.lit(1)).alias("_n")))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    total = load.agg(F.sum("_n")).first()[0] or 0
    most = min(chunk or CHUNK, max(1_000, math.ceil(total / cores)))
    load = load.select("home", F.ceil(F.col("_n") / most).cast("int").alias("parts"))
    plan = cut_lineage(sent.select("home", F.explode("blocks").alias("block")).distinct().join(F.broadcast(load), "home"))
    count = max(1, min(4_000, 2 * (plan.agg(F.sum("parts")).first()[0] or 0)))
    left = sent.join(F.broadcast(load), "home").withColumn("part", F.pmod(F.xxhash64("qid", "vec"), F.col("parts")).cast("int"))
    left = left.select(*queries.columns, "home", "part", F.explode("blocks").alias("block"))
    right = join_groups(members, plan, ["block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select(*tree.members.columns, "home", "part", "block")
    keys = ["home", "part", "block"]
    # A given number of partitions: small ones would be put together, though the work of a tile is not its size.
    left, right = _fresh(left).repartition(count, *keys), _fresh(right).repartition(count, *keys)

    def run(_key, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame()
        return tile(q, m)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


@dataclass
class Near:
    """Queries and members of a tile, centred, the members cell by cell: (from, to, centre, radius)."""

    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    yy: np.ndarray
    members: pd.DataFrame
    cells: list[tuple[int, int]]
    centre: np.ndarray
    radius: np.ndarray

    @classmethod
    def of(cls, q: pd.DataFrame, m: pd.DataFrame) -> Near:
        m = m.sort_values("cell", kind="stable", ignore_index=True)
        x, y = _matrix(q["vec"]), _matrix(m["vec"])
        whole = np.isfinite(y).all(axis=1)  # a vector with a gap is near nothing
        middle = y[whole].mean(axis=0) if whole.any() else np.zeros(y.shape[1])
        x, y = x - middle, y - middle
        edge = np.r_[0, np.flatnonzero(m["cell"].to_numpy()[1:] != m["cell"].to_numpy()[:-1]) + 1, len(m)]
        cells = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        full = [y[a:b][whole[a:b]] for a, b in cells]
        centre = np.stack([f.mean(axis=0) if len(f) else np.zeros(y.shape[1]) for f in full])
        radius = np.array([np.sqrt(((f - c) ** 2).sum(axis=1)).max(initial=0.0) for f, c in zip(full, centre)])
        return cls(x, y, (x**2).sum(axis=1), (y**2).sum(axis=1), m, cells, centre, radius)

    def to_centres(self) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the cells' centres and what rounding may have changed."""
        cc = (self.centre**2).sum(axis=1)
        size = self.xx[:, None] + cc
        return size - 2.0 * self.x @ self.centre.T, self.slack(size)

    def slack(self, size: np.ndarray) -> np.ndarray:
        return 4 * EPS * (self.x.shape[1] + 4) * size

    def pieces(self, rows: np.ndarray, a: int, b: int):
        """(rows, squared distances, rounding of a row) for some of the queries and the members a to b."""
        ya, most = -2.0 * self.y[a:b].T, np.fmax.reduce(self.yy[a:b], initial=0.0)
        step = max(1, PIECE // (b - a))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            d2 = self.x[r] @ ya
            d2 += self.yy[a:b]
            d2 += self.xx[r, None]
            yield r, d2, self.slack(self.xx[r] + most)

    def within(self, eps: float, rows: np.ndarray, a: int, b: int):
        """(rows, whether a member is at most ``eps`` away); doubtful pairs are computed again by differences."""
        for r, d2, loose in self.pieces(rows, a, b):
            hit = d2 <= eps**2
            at = np.flatnonzero(np.abs(d2 - eps**2) <= (loose + 8 * EPS * eps**2)[:, None])
            if len(at):
                hit.ravel()[at] = self.exact(r[at // (b - a)], a + at % (b - a)) <= eps
            yield r, hit

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest distance of a query to the members of a cell, rounding allowed for."""
        d2, slack = self.to_centres()
        low = np.sqrt(np.maximum(d2 - slack, 0.0)) * (1 - 1e-12) - self.radius * (1 + 1e-12)
        return low, np.sqrt(np.maximum(d2 + slack, 0.0)) * (1 + 1e-12) + self.radius * (1 + 1e-12)

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of pairs by differences, where no cancellation shows."""
        return np.concatenate([np.zeros(0), *(np.sqrt(((self.x[i[at : at + PIECE // 16]] - self.y[j[at : at + PIECE // 16]]) ** 2).sum(axis=1)) for at in range(0, len(i), PIECE // 16))])


def _kept(row: np.ndarray, seat: np.ndarray, d: np.ndarray, bound: np.ndarray, pid: np.ndarray, mult: np.ndarray, k: int):
    """The candidates that cover the k nearest rows of a query, ties by pid; tightens ``bound``."""
    order = np.lexsort((pid[seat], d, row))
    row, seat, d = row[order], seat[order], d[order]
    m = mult[seat]
    upto = np.cumsum(m)
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, dtype=bool)
    before = upto - m
    before = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(row)]))
    keep = before < k
    last = keep & (before + m >= k)
    bound[row[last]] = np.minimum(bound[row[last]], d[last])
    return row[keep], seat[keep], d[keep]


def covering(q: pd.DataFrame, m: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]:
    """(query rows, member seats, distances, bounds, members): the members covering the k nearest rows ``within`` a distance."""
    t = Near.of(q, m)
    pid, mult, own = t.members["pid"].to_numpy(), t.members["mult"].to_numpy(), q["own"].to_numpy()
    bound = q["within"].to_numpy(dtype=float).copy()
    d2, low = t.to_centres()[0], t.reach()[0]
    home = d2.argmin(axis=1)
    for c, (a, b) in enumerate(t.cells):  # a first bound from the nearest cell
        if b - a > k:
            for r, piece, loose in t.pieces(np.flatnonzero((home == c) & np.isinf(bound)), a, b):
                edge = np.sqrt(np.maximum(np.partition(piece, k, axis=1)[:, k] + 2 * loose, 0.0)) * (1 + 1e-12)
                bound[r] = np.where(np.isnan(edge), np.inf, edge)
    found = (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))
    fresh, held = [], 0
    for c in np.argsort(np.nan_to_num(d2).mean(axis=0)):
        a, b = t.cells[c]
        for r, piece, loose in t.pieces(np.flatnonzero(~(low[:, c] > bound)), a, b):
            hit = np.flatnonzero(piece <= (bound[r] ** 2 * (1 + 1e-12) + loose)[:, None])
            i, j = r[hit // (b - a)], a + hit % (b - a)
            d = t.exact(i, j)
            good = (d <= bound[i]) & (pid[j] != own[i])
            fresh.append((i[good], j[good], d[good]))
            held += int(good.sum())
            if held > 2 * PIECE:
                found, fresh, held = _kept(*(np.concatenate(v) for v in zip(found, *fresh)), bound, pid, mult, k), [], 0
    found = _kept(*(np.concatenate(v) for v in zip(found, *fresh)), bound, pid, mult, k)
    return *found, bound, t.members


def nearest_points(queries: DataFrame, points: DataFrame, k: int, id_type: str) -> DataFrame:
    """(qid, pid, distance, mult): for every query the points covering its k nearest rows.

    ``queries``: qid, vec, and ``own`` = the pid to leave out (null keeps all).
    The block around a query gives the distance that its neighbours lie within,
    then all blocks that can hold one are searched.  Lists are cut where the
    running multiplicity reaches k; ties by pid.
    """
    tree = plant(points, k)
    kinds = dict(queries.dtypes)
    wide = queries.select("qid", "vec", "own", F.lit(math.inf).alias("within"))

    def around(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = q[["qid", "vec", "own"]].copy()
        out["within"] = covering(q, m, k)[3]
        return out

    def tile(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        rows, seats, d, _, m = covering(q, m, k)
        return pd.DataFrame({"qid": q["qid"].to_numpy()[rows], "pid": m["pid"].to_numpy()[seats], "distance": d, "mult": m["mult"].to_numpy()[seats]})

    radius = None
    if tree.nodes is None:
        wide = cut_lineage(tiles(wide, tree, 0.0, around, f"qid {kinds['qid']}, vec array<double>, own {kinds['own']}, within double", at_home=True))
        radius = "within"
    found = tiles(wide, tree, radius, tile, f"qid {kinds['qid']}, pid {id_type}, distance double, mult long")
    order = Window.partitionBy("qid").orderBy("distance", "pid")
    before = F.coalesce(F.sum("mult").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = found.withColumn("_b", before).where(F.col("_b") < k)
    return cut.select("qid", "pid", "distance", F.least(F.col("mult"), F.lit(k) - F.col("_b")).alias("mult"))


def point_neighbors(points: DataFrame, k: int, id_type: str) -> DataFrame:
    """Neighbour lists of distinct points; a point with copies counts them as neighbours at distance 0."""
    queries = points.select(F.col("pid").alias("qid"), "vec", F.col("pid").alias("own"), (F.col("mult") - 1).alias("twins"))
    own = queries.where(F.col("twins") > 0).select("qid", F.col("qid").alias("pid"), F.lit(0.0).alias("distance"), "twins")
    far = nearest_points(queries.select("qid", "vec", "own"), points, k, id_type)
    twins = own.select("qid", F.least("twins", F.lit(k)).alias("_t"))
    room = far.join(twins, "qid", "left")
    order = Window.partitionBy("qid").orderBy("distance", "pid")
    before = F.coalesce(F.sum("mult").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("_t", F.lit(0))
    cut = room.withColumn("_b", before).where(F.col("_b") < k)
    others = cut.select("qid", "pid", "distance", F.least(F.col("mult"), F.lit(k) - F.col("_b")).alias("mult"))
    return others.unionByName(own.select("qid", "pid", "distance", F.least("twins", F.lit(k)).cast("long").alias("mult")))


def point_links(df: DataFrame, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """(key, neighbor, distance) between distinct points, named by their smallest key; every row is linked to its point."""
    id_type = dict(df.dtypes)[key]
    points = cut_lineage(points_of(df, key, columns))
    near = point_neighbors(points, k, id_type).where(F.col("qid") != F.col("pid"))
    links = near.select(F.col("qid").alias("key"), F.col("pid").alias("neighbor"), "distance")
    vec = F.array(*[num(c) for c in columns])
    copies = df.select(quoted(key).alias("key"), vec.alias("vec")).join(points.where("mult > 1").select("vec", "pid"), "vec")
    same = copies.where(F.col("key") != F.col("pid")).select("key", F.col("pid").alias("neighbor"), F.lit(0.0).alias("distance"))
    return links.unionByName(same)


def knn(df: DataFrame, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """(key, neighbor, distance): the ``k`` nearest rows of other keys, ties by neighbor.

    Copies are neighbours like all others, at distance 0.  The search runs over
    distinct vectors, whose weight is their number of keys; then each point gives
    a list of names, which its rows share and leave their own key out of.  Rows of
    one key compete for its ``k`` places.  Rows without a key, and vectors with a
    gap, are near nothing.
    """
    vec = F.array(*[num(c) for c in columns])
    rows = df.select(quoted(key).alias("key"), vec.alias("vec")).where("key is not null")
    each = cut_lineage(rows.groupBy("key", "vec").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n")))
    each = each.where(F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < math.inf)))
    seats = each.groupBy("vec").agg(F.min("key").alias("_first"), F.count(F.lit(1)).alias("mult")).orderBy("_first", "vec")
    points = cut_lineage(seats.select(F.monotonically_increasing_id().alias("pid"), "vec", "mult"))
    placed = cut_lineage(join_groups(each, points.select("vec", "pid"), ["vec"]).select("key", "n", "pid"))
    # A key that leaves d points out needs d - 1 more; keys go by powers of two of d.
    spots = placed.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    grade = F.ceil(F.log2(F.col("d").cast("double"))).cast("int")
    several = cut_lineage(placed.join(spots, "key").groupBy("pid").agg(F.max(grade).alias("_grade")))
    graded = cut_lineage(points.join(several, "pid", "left").withColumn("_grade", F.coalesce("_grade", F.lit(0))))
    near = graded.select(F.col("pid").alias("at"), "pid", F.lit(0.0).alias("distance"))
    for (g,) in sorted(graded.select("_grade").distinct().collect()):
        want = k + (1 << g) - 1
        queries = graded.where((F.col("_grade") == g) & (F.col("mult") <= want)).select(F.col("pid").alias("qid"), "vec", F.col("pid").alias("own"))
        near = near.unionByName(nearest_points(queries, points, want, "bigint").select(F.col("qid").alias("at"), "pid", "distance"))
    first = F.row_number().over(Window.partitionBy("pid").orderBy("key"))
    names = placed.withColumn("_i", first).where(F.col("_i") <= k + 1).groupBy("pid").agg(F.collect_list(F.struct(F.col("key").alias("neighbor"), "n")).alias("names"))
    found = join_groups(near, names, ["pid"]).select("at", "distance", F.inline("names"))
    lists = found.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor", "n"))).alias("near"))
    most = F.lit(k) + F.pow(F.lit(2.0), F.col("_grade")).cast("int")
    lists = lists.join(graded.select(F.col("pid").alias("at"), "_grade"), "at").select(F.col("at").alias("pid"), F.slice("near", F.lit(1), most).alias("near"))
    pairs = join_groups(placed.withColumnRenamed("n", "_own"), lists, ["pid"]).select("key", "_own", F.inline("near")).where("neighbor <> key")
    order = Window.partitionBy("key").orderBy("distance", "neighbor")
    pairs = pairs.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= k).withColumn("n", F.col("n") * F.col("_own"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = pairs.withColumn("_b", before).where(F.col("_b") < k)
    times = F.least(F.col("n"), F.lit(k) - F.col("_b")).cast("int")
    return cut.select("key", "neighbor", "distance", F.explode(F.array_repeat(F.lit(1), times))).select("key", "neighbor", "distance")
