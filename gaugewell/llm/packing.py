"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Only the number of pieces of each length matters for the plan, so the driver
sees one count per length (``length`` of them, whatever the data).  The
reduction fixes sets that dominate every other set with the same longest piece:
a length with its exact complement, a piece nothing fits beside, a pair where
only one more fits, a triple where two more fit and none better exist.  Best
fit decreasing packs the rest, whole groups of equal sequences at a time.  The
plan is a list of ranges: the pieces of one length, ranks lo to hi, go to so
many equal sequences at this offset.  Ranks come from the scan's own counters
and one table of counts per task and length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, map_batches

#: Fixed value: the split of byte-level BPE (``ByteLevel`` with its own pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_SPACE = re.compile(r"\s+")
RUN = 100_000  # characters of white space; tiktoken stops at a million


@lru_cache(maxsize=4)
def encoder(path: str, added: bool = False):
    """text → token ids as little-endian unsigned 32-bit numbers, by the tokenizers file at ``path``.

    Strings of added tokens in a text are these tokens if ``added``, else
    ordinary text.  A plain byte-level BPE file whose ids follow its merges has
    the same ids in tiktoken, which is several times as fast; any other file,
    texts with added tokens and texts with very long runs of white space are
    run by tokenizers itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _ranks(spec)

    @lru_cache(maxsize=1)
    def tokenizer():
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        if not added:
            found.encode_special_tokens = True
        return found

    whole = lambda text: tokenizer().encode(text, add_special_tokens=False).ids
    ordinary = whole
    if ranks:
        import tiktoken

        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        tokens = [t["content"] for t in spec.get("added_tokens", [])] if added else []

        def ordinary(text):
            if any(t in text for t in tokens) or len(text) >= RUN and any(m.end() - m.start() >= RUN for m in _SPACE.finditer(text)):
                return whole(text)
            return fast(text)

    return lambda text: np.asarray(array("I", ordinary(text)), "<u4").tobytes()


def _ranks(spec: dict) -> dict[bytes, int] | None:
    model, split = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    if not plain or spec.get("normalizer") or any(odd):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    for i, merge in enumerate(model["merges"]):
        if model["vocab"].get("".join(merge.split(" ") if isinstance(merge, str) else merge)) != 256 + i:
            return None
    return ranks


def reduce_instance(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Takes dominating sets out of ``counts`` (pieces of each length, index 0 unused): [([(length, copies)], sequences)]."""
    room = len(counts) - 1
    fixed = []

    def fix(sizes: list[int], times: int) -> None:
        fixed.append(([(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)], times))
        for s in sizes:
            counts[s] -= times

    if counts[room]:
        fix([room], int(counts[room]))
    for s in range((room + 1) // 2, room):
        times = min(counts[s], counts[room - s]) if 2 * s != room else counts[s] // 2
        if times:
            fix([s, room - s], int(times))
    changed = True
    while changed:
        changed = False
        for j in range(room, 0, -1):
            while counts[j]:
                chosen = _dominating(counts, j, room - j)
                if chosen is None:
                    break
                sizes = [j, *chosen]
                fix(sizes, min(int(counts[s]) // sizes.count(s) for s in set(sizes)))
                changed = True
            short = np.flatnonzero(counts)[:3]
            small = np.repeat(short, np.minimum(counts[short], 3))[:3]
            if len(small) == 3 and small[-1] < j and small.sum() <= room - j:
                break  # beside this and all shorter ones go three others
    return fixed


def _dominating(counts: np.ndarray, j: int, rest: int) -> list[int] | None:
    """What goes with a piece of length j into a set that dominates all others with it; None if that is not known."""
    counts[j] -= 1
    try:
        fits = np.flatnonzero(counts[: rest + 1])
        if len(fits) == 0:
            return []
        small = np.repeat(fits[:3], np.minimum(counts[fits[:3]], 3))[:3]
        k = int(fits[-1])
        if len(small) < 2 or small[0] + small[1] > rest:
            return [k]
        if len(small) > 2 and small.sum() <= rest:
            return None
        total, a, b = max(((int(x + y), int(x), int(y)) for x in fits if (y := _partner(counts, fits, int(x), rest)) is not None), default=(0, 0, 0))
        if k >= total:
            return [k]
        if a != k:
            return None
        counts[a] -= 1
        above = np.flatnonzero(counts[b + 1 : rest + 1]) + b + 1
        pair = np.repeat(above[:2], np.minimum(counts[above[:2]], 2))[:2]
        counts[a] += 1
        return [a, b] if len(pair) < 2 or pair.sum() > rest else None
    finally:
        counts[j] += 1


def _partner(counts: np.ndarray, fits: np.ndarray, x: int, rest: int) -> int | None:
    """The longest y <= x beside x."""
    at = int(np.searchsorted(fits, min(x, rest - x), "right")) - 1
    while at >= 0:
        y = int(fits[at])
        if y != x or counts[x] > 1:
            return y
        at -= 1
    return None


def best_fit(counts: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing over counts per length: [([(length, copies)], sequences)]."""
    room = len(counts) - 1
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    gaps: list[int] = []
    done = []

    def put(gap: int, group) -> None:
        if gap == 0:
            done.append(group)
            return
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append(group)

    for s in range(room, 0, -1):
        left = int(counts[s])
        while left:
            at = bisect.bisect_left(gaps, s)
            if at < len(gaps):
                gap = gaps[at]
                content, bins = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            else:
                gap, content, bins = room, [], left
            each = gap // s
            full = min(bins, left // each)
            if full:
                put(gap - s * each, ([*content, (s, each)], full))
                left -= full * each
                bins -= full
            elif left:
                put(gap - s * left, ([*content, (s, left)], 1))
                left, bins = 0, bins - 1
            if bins and content:
                put(gap, (content, bins))
    for groups in open_.values():
        done += groups
    return done


def make_plan(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Ranges of ranks, sorted by (size, lo): size, lo, per (pieces of that size in a sequence), sequence, offset."""
    counts = counts.astype(np.int64).copy()
    groups = reduce_instance(counts) + best_fit(counts)
    taken = np.zeros(len(counts), np.int64)
    rows, sequence = [], 0
    for content, times in groups:
        offset = 0
        for size, copies in content:
            rows.append((size, int(taken[size]), copies, sequence, offset))
            taken[size] += copies * times
            offset += size * copies
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("size", "lo", "per", "sequence", "offset"), table.T))


def place(plan: dict[str, np.ndarray], size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank among the pieces of that length."""
    first, last = np.searchsorted(plan["size"], size, "left"), np.searchsorted(plan["size"], size, "right")
    low, high = first, last - 1
    while (low < high).any():  # the last range that starts at or before the rank
        middle = (low + high + 1) // 2
        right = plan["lo"][middle] <= rank
        low, high = np.where((low < high) & right, middle, low), np.where((low < high) & ~right, middle - 1, high)
    within = rank - plan["lo"][low]
    return plan["sequence"][low] + within // plan["per"][low], plan["offset"][low] + size * (within % plan["per"][low])


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Token pieces of every row with their rank among the task's pieces of that length (checkpointed)."""
    kind = df.schema[id_col].dataType.simpleString()
    tail = end_id.to_bytes(4, "little")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode = encoder(tokenizer, added=True)
        seen = [0] * (length + 1)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("id", "piece", "start", "length", "crc", "local", "task", "ids")}
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + tail
                total = len(ids) // 4
                end = (total - 1) % length + 1
                start = 0
                for piece in range(-(-total // length)):
                    part = ids[4 * start : 4 * end]
                    size = end - start
                    for c, v in zip(out, (ident, piece, start, size, zlib.crc32(part), seen[size], task, part if with_ids else None)):
                        out[c].append(v)
                    seen[size] += 1
                    start, end = end, end + length
            yield out

    return cut_lineage(map_batches(rows, run, f"id {kind}, piece int, start long, length long, crc long, local long, task int, ids binary"))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and ``end_id``; only one longer than ``length``
    is cut, all its pieces but the first being full.  The string of an added
    token in a text is that token, as tokenizers has it.  Null and empty texts are
    one piece of one token.  Null and repeated ids are packed like others;
    other columns are ignored; no rows give no rows.
    """
    spark = df.sparkSession
    cut = pieces(df, tokenizer, id_col, text_col, length, end_id, with_ids)
    sizes = cut_lineage(cut.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = np.zeros(length + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(make_plan(counts))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("local") + F.coalesce("before", F.lit(0)))

    def run(batches):
        for batch in batches:
            sequence, offset = place(plan.value, batch.column(3).to_numpy(), batch.column(6).to_numpy())
            yield {"id": batch.column(0), "piece": batch.column(1), "start": batch.column(2), "length": batch.column(3), "ids_crc32": batch.column(4), "ids": batch.column(5), "sequence_id": sequence, "offset": offset}

    kind = df.schema[id_col].dataType.simpleString()
    out = map_batches(ranked.select("id", "piece", "start", "length", "crc", "ids", "rank"), run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
    out = out.withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, tokens, ids (little-endian) of the sequences of ``pack(..., with_ids=True)``; each holds ``length`` tokens at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), joined.alias("ids"))
