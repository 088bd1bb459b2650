"""The trie of conversation beginnings, screened by a count-min sketch.

A node is a sequence of first turns that some conversations share.  Turns
become 128-bit digests, a prefix is the exclusive or of its turns' digests with
their places, so prefixes come from running windows in bounded blocks, however
long a conversation is.  A count-min sketch of all prefixes, of a fixed size,
is sent to every task: an estimate of one proves that no other conversation has
the prefix, and all longer ones are emitted where they are.  Only prefixes that
may be shared, and the first one after them, are shuffled and counted exactly.

Sums over subtrees run along chains: a node belongs to the member of the least
hashed id, whose nodes are the lower end of its path.  The hash makes chains
nest only logarithmically deep, and each round folds one level into the next.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, join_totals, map_batches, shuffle_partitions
from gaugewell.plans.ordering import with_position

LONG_FROM = 50_000  # turns of a conversation that are ranked in one window
BLOCK = 1024  # places of a running window
HASHES, LEAST_WIDTH, MOST_WIDTH = 4, 1 << 12, 1 << 25  # two bits a cell: 32 MB at most
CHUNK = 1 << 16  # cells sent in a row
PIECE = 1 << 20  # bytes of listed ids that travel together
NODE = ["depth", "d1", "d2"]


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_from: int = LONG_FROM) -> DataFrame:
    """conv, pos (from 1), said (digest of role and text), size (code points of the text) of every turn.

    Turns are ordered by their number, nulls first, ties by the digest; null
    roles and texts are empty.  Repeated rows are turns of their own.  Rows
    without a conversation belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), said.alias("said"), F.length(text).cast("long").alias("size")).filter("conv is not null")
    rows = cut_lineage(rows)
    counts = rows.groupBy("conv").agg(F.count("*").alias("n"))
    sized = join_totals(rows, counts, ["conv"], "n")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "said"))
    out = sized.filter(F.col("n") <= long_from).select("conv", rank.cast("long").alias("pos"), "said", "size")
    long = sized.filter(F.col("n") > long_from)
    if not counts.filter(F.col("n") > long_from).isEmpty():
        placed = with_position(long, ["conv", "turn", "said"], ["conv"], out="pos")
        out = out.unionByName(placed.select("conv", (F.col("pos") + 1).cast("long").alias("pos"), "said", "size"))
    return cut_lineage(out)


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns with length, conversations with length) after conversation c takes its first h turns from conversation c - c % ``group``.

    h is the crc32 of the decimal c modulo ``most``; all turns are taken if
    there are fewer, none if the conversation is absent; c's own turns after
    its first h follow.
    """
    counts = turns.groupBy("conv").agg(F.count("*").alias("n"))
    heads = turns.filter((F.col("conv") % group == 0) & (F.col("pos") < most)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "said", "size"))).alias("head"))
    own = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = counts.select("conv", "n", own.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")).join(heads, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce(F.size("head"), F.lit(0))).cast("long"))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv", "n", "h", "taken", "length", F.when(F.col("taken") > 0, F.slice("head", 1, F.greatest("taken", F.lit(1)).cast("int"))).alias("head"))
    convs = cut_lineage(convs)
    rest = join_totals(turns, convs.drop("head"), ["conv"], "n").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "said", "size", "length")
    first = convs.filter("taken > 0").select("conv", "length", F.explode("head").alias("t")).select("conv", "t.pos", "t.said", "t.size", "length")
    return rest.unionByName(first), convs.select("conv", "length")


class Fold(NamedTuple):
    """An associative total of a column, two totals put together, and one taken out of another."""

    total: Callable[[str], Column]
    plus: Callable[[Column, Column], Column]
    minus: Callable[[Column, Column], Column]


XOR = Fold(F.bit_xor, lambda a, b: a.bitwiseXOR(b), lambda a, b: a.bitwiseXOR(b))
SUM = Fold(F.sum, lambda a, b: a + b, lambda a, b: a - b)


def running(df: DataFrame, key: str, at: str, values: Sequence[str], fold: Fold, backwards: bool = False, block: int = BLOCK) -> DataFrame:
    """``df`` with each of ``values`` folded over the rows of its key up to its own place ``at`` (from 0; distinct), in windows of at most ``block`` places.

    Totals of blocks are folded in the same way, one level up for each factor
    of ``block``; a block's rows then take the total of the blocks before.
    """
    order = F.desc(at) if backwards else F.asc(at)
    top = df.agg(F.max(at)).first()[0]
    if top is None or top < block:
        window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({v: fold.total(v).over(window) for v in values})
    part = f"_of_{at}"
    cut = df.withColumn(part, F.expr(f"`{at}` div {block}"))
    window = Window.partitionBy(key, part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut_lineage(cut.groupBy(key, part).agg(*[fold.total(v).alias(v) for v in values], *[fold.total(v).alias(f"_own_{v}") for v in values]))
    carried = running(totals, key, part, values, fold, backwards, block)
    before = carried.select(key, part, *[fold.minus(F.col(v), F.col(f"_own_{v}")).alias(f"_before_{v}") for v in values])
    both = cut.withColumns({v: fold.total(v).over(window) for v in values}).join(before, [key, part])
    return both.withColumns({v: fold.plus(F.col(v), F.col(f"_before_{v}")) for v in values}).drop(part, *[f"_before_{v}" for v in values])


def prefixes(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, depth, d1, d2, p1, p2 (digests of the prefix and of its parent), size (of its last text), length: all prefixes, the empty one included."""
    hashed = turns.select("conv", "pos", "size", "length", F.xxhash64(F.lit(1), "pos", "said").alias("h1"), F.xxhash64(F.lit(2), "pos", "said").alias("h2"))
    hashed = hashed.withColumns({"d1": F.col("h1"), "d2": F.col("h2")})
    folded = running(hashed, "conv", "pos", ["d1", "d2"], XOR, block=block)
    rows = folded.select("conv", F.col("pos").alias("depth"), "d1", "d2", F.col("d1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("h2")).alias("p2"), "size", "length")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), none.alias("p1"), none.alias("p2"), zero.alias("size"), "length")
    return rows.unionByName(roots)


def sketch_width(total: int) -> int:
    return min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (2 * max(total, 1) - 1).bit_length()))


def cells(d1: np.ndarray, d2: np.ndarray, width: int) -> list[np.ndarray]:
    """A cell for each hash: the four halves of the digests."""
    mask = np.uint64(width - 1)
    return [(d >> np.uint64(shift)) & mask for d in (d1.view(np.uint64), d2.view(np.uint64)) for shift in (0, 32)]


def _add(counts: np.ndarray, at: np.ndarray) -> None:
    """Counts up to two."""
    where, n = np.unique(at, return_counts=True)
    counts[where] = np.minimum(counts[where] + np.minimum(n, 2), 2)


def _sketch(width: int):
    """Digests of one task to the touched chunks (hash and chunk number, packed) of its own sketch."""

    def run(batches):
        counts = np.zeros((HASHES, width), np.uint8)
        for batch in batches:
            d1, d2 = (np.asarray(batch.column(i)).astype(np.int64) for i in range(2))
            for row, at in zip(counts, cells(d1, d2, width)):
                _add(row, at)
        step = min(width, CHUNK)
        for h in range(HASHES):
            for k in range(0, width, step):
                chunk = counts[h, k : k + step]
                if chunk.any():
                    yield {"chunk": [h * (width // step) + k // step], "counts": [zlib.compress(chunk.tobytes(), 1)]}

    return run


def _merge(width: int):
    step = min(width, CHUNK)

    def run(batches):
        now, counts = None, None
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(zlib.decompress(packed), np.uint8)
                if chunk != now:
                    if now is not None:
                        yield {"chunk": [now], "counts": [zlib.compress(counts.tobytes(), 1)]}
                    now, counts = chunk, np.zeros(step, np.uint8)
                counts = np.minimum(counts + more, 2)
        if now is not None:
            yield {"chunk": [now], "counts": [zlib.compress(counts.tobytes(), 1)]}

    return run


def shared_bits(rows: DataFrame, width: int) -> np.ndarray:
    """The merged sketch of all prefixes: for each hash the packed bits of the cells that counted two or more (16 MB at most)."""
    parts = map_batches(rows.select("d1", "d2"), _sketch(width), "chunk long, counts binary")
    merged = map_batches(parts.repartition("chunk").sortWithinPartitions("chunk"), _merge(width), "chunk long, counts binary")
    bits = np.zeros((HASHES, width // 8), np.uint8)
    step = min(width, CHUNK)
    for row in merged.toLocalIterator():  # HASHES × width cells, whatever the input
        h, k = divmod(row["chunk"], width // step)
        bits[h, k * step // 8 : (k + 1) * step // 8] = np.packbits(np.frombuffer(zlib.decompress(row["counts"]), np.uint8) > 1)
    return bits


SCREENED = "conv long, depth long, d1 long, d2 long, p1 long, p2 long, size long, length long, tail boolean"


def _screen(sketch, width: int):
    """``tail``: the parent has an estimate of one, so that it and all below are this conversation's alone."""

    def alone(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(d1), bool)
        for bits, at in zip(sketch.value, cells(d1, d2, width)):
            at = at.astype(np.int64)
            out |= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1) == 0
        return out

    def run(batches):
        for batch in batches:
            p1, p2 = (np.asarray(batch.column(i).fill_null(0)).astype(np.int64) for i in (4, 5))
            depth = np.asarray(batch.column(1))
            yield {name: batch.column(i) for i, name in enumerate(batch.schema.names)} | {"tail": alone(p1, p2) & (depth >= 2)}

    return run


def screened(rows: DataFrame, width: int | None = None) -> DataFrame:
    """``rows`` and whether the sketch proves their parent to be a singleton; an estimate is never too low, so no shared node is a tail."""
    below = rows.filter("depth > 0")
    width = width or sketch_width(below.count())
    sketch = rows.sparkSession.sparkContext.broadcast(shared_bits(below, width))
    return map_batches(rows, _screen(sketch, width), SCREENED)


def _pieces(batches):
    """Sorted (depth, d1, d2, conv) to comma-joined ids in pieces of bounded size."""
    now, first, ids, weight = None, None, [], 0
    out: dict[str, list] = {c: [] for c in (*NODE, "first", "ids")}

    def put():
        for c, v in zip(out, (*now, first, ",".join(ids))):
            out[c].append(v)

    for batch in batches:
        for *node, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if node != now or weight > PIECE:
                if now is not None:
                    put()
                now, first, ids, weight = node, conv, [], 0
            ids.append(str(conv))
            weight += len(ids[-1]) + 1
        if sum(map(len, out["ids"])) > PIECE or len(out["ids"]) > 10_000:
            yield out
            out = {c: [] for c in out}
    if now is not None:
        put()
    yield out


def _ends(batches):
    """Pieces sorted by node and first id to the digest of all ids of a node, streamed."""
    now, sha = None, None
    out: dict[str, list] = {c: [] for c in (*NODE, "ends")}

    def put():
        for c, v in zip(out, (*now, sha.hexdigest())):
            out[c].append(v)

    for batch in batches:
        for *node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if node != now:
                if now is not None:
                    put()
                now, sha = node, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(out["ends"]) > 10_000:
            yield out
            out = {c: [] for c in out}
    if now is not None:
        put()
    yield out


def end_digests(rows: DataFrame) -> DataFrame:
    """depth, d1, d2, ends: SHA-256 of the ids that end at a node, ascending, comma-joined.

    Listing is spread over range partitions and done in pieces; only the
    digest of one node's pieces is taken in order.
    """
    last = rows.filter("depth = length").select(*NODE, "conv")
    pieces = map_batches(last.repartitionByRange(shuffle_partitions(rows), *NODE, "conv").sortWithinPartitions(*NODE, "conv"), _pieces, "depth long, d1 long, d2 long, first long, ids string")
    return map_batches(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first"), _ends, "depth long, d1 long, d2 long, ends string")


def _subtree_sums(shared: DataFrame, block: int) -> DataFrame:
    """owner, depth, leaves, saved: sums over the subtree of each shared node (owner, depth, powner, leaf, save)."""
    base = cut_lineage(shared.select("owner", "depth", "powner", F.col("leaf").alias("leaves"), F.col("save").alias("saved")))
    tops = base.filter("powner is not null and powner <> owner").select("owner", "depth", "powner")
    tops = cut_lineage(tops)

    def folded(values: DataFrame) -> DataFrame:
        return cut_lineage(running(values.select("owner", "depth", "leaves", "saved"), "owner", "depth", ["leaves", "saved"], SUM, backwards=True, block=block))

    def state(sums: DataFrame) -> tuple:
        return tuple(sums.agg(F.sum(F.col("leaves").cast("decimal(38,0)")), F.sum(F.col("saved").cast("decimal(38,0)"))).first())

    sums = folded(base)
    if tops.isEmpty():
        return sums
    before = state(sums)
    while True:
        below = tops.join(sums, ["owner", "depth"]).groupBy(F.col("powner").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        zero = F.lit(0)
        values = base.join(below, ["owner", "depth"], "left").select("owner", "depth", (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved"))
        sums = folded(values)
        now = state(sums)
        if now == before:
            return sums
        before = now


def prefix_nodes(turns: DataFrame, convs: DataFrame, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each distinct sequence of first turns, the empty one included.

    ``turns`` has conv, pos (1 to length), said, size and length, ``convs``
    each conversation with its length, those without turns as well.  Columns:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, each node's members but one times
    the code points of its last text) and ends_sha256 (the members that end
    there, in ascending order, comma-joined).  Prefixes are equal when their
    128-bit digests and depths are.  No conversations: no rows.  ``width``
    fixes the cells of the sketch; a narrow one only makes more prefixes shuffle.
    """
    rows = cut_lineage(prefixes(turns, convs, block))
    marked = screened(rows, width)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    alone = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = marked.filter("tail").select(
        F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("depth") == F.col("length"), alone).otherwise(empty).alias("ends_sha256"),
    )
    maybe = cut_lineage(marked.filter("not tail").drop("tail"))
    nodes = cut_lineage(
        maybe.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.min(F.xxhash64("conv")).alias("owner"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("size").alias("size"), F.max("length").alias("length"))
    )  # xxhash64 of one long is a permutation: owners are conversations
    child_of = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")]
    children = nodes.filter("depth > 0").select(*child_of, "n").groupBy(*NODE).agg(F.count("*").alias("children"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
    shared = nodes.filter("n > 1").join(children, NODE, "left")
    shared = cut_lineage(shared.withColumns({"children": F.coalesce("children", zero), "leaf": F.when(F.col("children").isNull(), one).otherwise(F.col("single")), "save": (F.col("n") - 1) * F.col("size")}))
    up = shared.filter("children > 0").select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("pconv"), F.col("owner").alias("powner"), "children")
    linked = cut_lineage(join_totals(nodes.filter("depth > 0"), up, ["depth", "p1", "p2"], "children", "left").select(*NODE, "pconv", "powner"))
    shared = cut_lineage(shared.join(linked, NODE, "left"))
    sums = _subtree_sums(shared, block)
    ends = end_digests(maybe)
    totals = shared.join(sums, ["owner", "depth"]).select(*NODE, "conv", "pconv", "n", "children", "leaves", "saved")
    single = nodes.filter("n = 1").join(linked, NODE, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("pconv", "conv"))
    single = single.select(*NODE, "conv", parent.alias("pconv"), "n", (F.col("depth") < F.col("length")).cast("long").alias("children"), one.alias("leaves"), zero.alias("saved"))
    exact = totals.unionByName(single).join(ends, NODE, "left")
    exact = exact.select(F.col("conv").alias("conv_id"), "depth", F.col("pconv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", empty).alias("ends_sha256"))
    return exact.unionByName(tails)


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **how) -> DataFrame:
    """``prefix_nodes`` of the conversations as they are."""
    turns = ordered_turns(df, conv_col, turn_col, role_col, text_col)
    convs = turns.groupBy("conv").agg(F.count("*").alias("length"))
    return prefix_nodes(join_totals(turns, convs, ["conv"], "length"), convs, **how)


def shared_head_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long_from: int = LONG_FROM, **how) -> DataFrame:
    """``prefix_nodes`` of the conversations after ``with_shared_heads``."""
    return prefix_nodes(*with_shared_heads(ordered_turns(df, conv_col, turn_col, role_col, text_col, long_from)), **how)
