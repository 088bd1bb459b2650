"""Benchmark passages in training text, found by spaced-seed hashing.

A mask names the word positions that count in a window; the others may differ.
The four masks below find every passage of 11 to 25 words with a fifth of them
replaced (rounded down), so every longer one too: it can be cut into passages
of 13 to 25 words, one of which has the share of equal words.  An item shorter
than the masks is cut into one part more than words may be replaced.  Hashes of all windows of the benchmark are joined with those of all
windows of the corpus inside the scan: a bitmap throws out nearly all windows,
a binary search settles the rest.  Each hit fixes how the two texts lie against
each other; around it the words are compared, and the longest stretch with the
wanted share of equal words counts.

The benchmark is the stated query set.  It is split into blocks of a bounded
number of words, and each block is broadcast to one pass over the corpus, which
moves no text.  Nothing is grouped, so common passages are no hot keys.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, map_batches

#: Fixed masks: weight 6, proved by enumeration in the tests.
MASKS = ("1110111", "111001011", "110100111", "11010001011")
MIN_WORDS, SIMILARITY = 13, 0.8
BLOCK_WORDS = 1 << 19  # of the benchmark in one pass: about 50 MB of hashes
SEGMENT, OVERLAP = 2048, 64  # a longer benchmark text is cut into overlapping parts
CHUNK = 1 << 20  # corpus words hashed at once
CACHE = 1 << 18
BITMAP_BITS = 24
MIX = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"\w+")
_cache: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """XXH64 of each lower-cased word; a bounded memo spares most of the calls."""
    import xxhash

    words = _WORD.findall(text.lower())
    try:
        return np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(_cache) > CACHE:
            _cache.clear()
        for w in set(words):
            if w not in _cache:
                _cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))


def _positions(masks: tuple[str, ...]) -> list[list[int]]:
    return [[i for i, c in enumerate(m) if c == "1"] for m in masks]


def short_parts(n: int, share: float) -> list[list[int]]:
    """Positions of the parts of an item of ``n`` words, one of which stays whole if the item has the share of equal words."""
    cuts = np.linspace(0, n, min(n, math.floor(n * (1 - share) + 1e-9) + 1) + 1).round().astype(int).tolist()
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]


def window_hashes(words: np.ndarray, positions: list[int], number: int) -> np.ndarray:
    """A hash for each window; ``number`` keeps masks apart."""
    n = len(words) - positions[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, number, np.uint64)
    factor = 0xD6E8FEB86659FD93
    for p in positions:
        factor = factor * 0x5851F42D4C957F2D + 0x14057B7EF767814F & 0xFFFFFFFFFFFFFFFF
        total += words[p : p + n] * np.uint64(factor | 1)
    total ^= total >> np.uint64(32)
    return total * MIX


#: Windows of a text times places of the benchmark with one hash: beyond this they are taken as stretches.
OFTEN = 256


class Block:
    """Hashes and words of one part of the benchmark; travels as a broadcast."""

    def __init__(self, items: list[tuple], masks: tuple[str, ...], share: float = SIMILARITY):
        self.ids = [i for i, _, _ in items]
        self.starts = [s for _, s, _ in items]
        self.words = [np.frombuffer(w, np.uint64) for _, _, w in items]
        span = max(map(len, masks))
        short = sorted({len(w) for w in self.words if 0 < len(w) < span})
        parts = [(n, part) for n in short for part in short_parts(n, share)]
        self.masks = _positions(masks) + [part for _, part in parts]
        own = [None] * len(masks) + [n for n, _ in parts]
        hashes, item, place = [], [], []
        for k, (positions, exact) in enumerate(zip(self.masks, own)):
            for i, w in enumerate(self.words):
                if exact in (None, len(w)):
                    h = window_hashes(w, positions, k)
                    hashes.append(h)
                    item.append(np.full(len(h), i, np.int32))
                    place.append(np.arange(len(h), dtype=np.int32))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        h = join(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.place = h[order], join(item, np.int32)[order], join(place, np.int32)[order]
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[self.hashes >> np.uint64(64 - BITMAP_BITS)] = True

    def hits(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[tuple[int, int, int, int]]]:
        """(item, offset of the item's first word in ``words``), each once, and for windows that often repeat (item, first offset, step, count)."""
        found, ranges = set(), set()
        for k, positions in enumerate(self.masks):
            h = window_hashes(words, positions, k)
            at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - BITMAP_BITS)])
            if len(at) == 0:
                continue
            low = np.searchsorted(self.hashes, h[at], "left")
            high = np.searchsorted(self.hashes, h[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            first, one, times = np.unique(low, return_index=True, return_counts=True)
            often = first[times * (high[one] - first) > OFTEN]
            many = np.isin(low, often)
            for p, a, b in zip(at[~many].tolist(), low[~many].tolist(), high[~many].tolist()):
                found.update(zip(self.item[a:b].tolist(), (p - self.place[a:b]).tolist()))
            for a in often.tolist():
                here = at[low == a]
                b = int(high[low == a][0])
                for item in np.unique(self.item[a:b]).tolist():
                    ranges |= {(item, *r) for r in offset_ranges(here, np.sort(self.place[a:b][self.item[a:b] == item]))}
        return sorted(found, key=lambda x: (x[1], x[0])), ranges


def progressions(places: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, step, count): sorted places as stretches of equal distances; neighbouring stretches share an end."""
    if len(places) == 1:
        return [(int(places[0]), 1, 1)]
    gaps = np.diff(places.astype(np.int64))
    cuts = np.concatenate(([0], np.flatnonzero(gaps[1:] != gaps[:-1]) + 1, [len(gaps)]))
    return [(int(places[a]), int(gaps[a]), int(b - a + 1)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def offset_ranges(text: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, step, count): all differences of a place in the text and one in the item, as stretches."""
    parts = progressions(item)
    for p, p_step, p_count in progressions(text):
        for q, q_step, q_count in parts:
            if p_count == 1 or q_count == 1 or p_step == q_step:
                step = p_step if p_count > 1 else q_step
                yield p - q - step * (q_count - 1), step, p_count + q_count - 1
            elif p_count <= q_count:
                yield from ((p + p_step * i - q - q_step * (q_count - 1), q_step, q_count) for i in range(p_count))
            else:
                yield from ((p - q - q_step * j, p_step, p_count) for j in range(q_count))


def longest_stretch(equal: np.ndarray, share: float) -> tuple[int, int]:
    """(start, end) of the longest stretch that starts and ends on equal words and has the share of them."""
    best = (0, 0)
    places = np.flatnonzero(equal)
    if len(places) == 0:
        return best
    if len(places) == len(equal):
        return 0, len(equal)
    balance = np.concatenate(([0], np.cumsum(np.where(equal, 1 - share, -share)))) + 0.0
    ends = np.maximum.accumulate(balance[::-1])[::-1]
    for a in places.tolist():
        if len(equal) - a <= best[1] - best[0]:
            break
        # the last end at which the balance is not below its value at a
        b = int(np.searchsorted(-ends, -(balance[a] - 1e-9), "right")) - 1
        while b > a and not equal[b - 1]:
            b -= 1
        if b - a > best[1] - best[0]:
            best = (a, b)
    return best


def overlaps(block: Block, texts: list[str], min_words: int, share: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, item, first word in the text, words, equal words, first word in the item) of each verified overlap."""
    at = 0
    while at < len(texts):
        parts, lengths, total = [], [], 0
        first = at
        while at < len(texts) and (total < CHUNK or not parts):
            parts.append(word_hashes(texts[at] or ""))
            lengths.append(len(parts[-1]))
            total += lengths[-1]
            at += 1
        words = np.concatenate(parts)
        ends = np.cumsum(lengths)
        seen, breaks = set(), {}

        def verified(item: int, offset: int) -> Iterator[tuple[int, int, int, int, int, int]]:
            """What is new; a window may lie over two texts, each part is compared inside its own."""
            wanted = block.words[item]
            doc = int(np.searchsorted(ends, max(offset, 0), "right"))
            while doc < len(lengths) and ends[doc] - lengths[doc] < offset + len(wanted):
                a, b = max(offset, ends[doc] - lengths[doc]), min(offset + len(wanted), ends[doc])
                if b > a:
                    equal = words[a:b] == wanted[a - offset : b - offset]
                    x, y = longest_stretch(equal, share)
                    key = (doc, item, int(a + x), int(a + y))
                    if y - x >= min(min_words, len(wanted)) and key not in seen:
                        seen.add(key)
                        yield first + doc, item, int(a + x - (ends[doc] - lengths[doc])), y - x, int(equal[x:y].sum()), int(a + x - offset)
                doc += 1

        def repeats(item: int, offset: int, step: int) -> int:
            """How many further steps show the same words of the same text."""
            length = len(block.words[item])
            doc = int(np.searchsorted(ends, max(offset, 0), "right"))
            if offset < 0 or doc == len(lengths) or offset < ends[doc] - lengths[doc] or offset + length > ends[doc]:
                return 0
            if step not in breaks:
                breaks[step] = np.flatnonzero(words[:-step] != words[step:])
            k = int(np.searchsorted(breaks[step], offset))
            end = min(int(breaks[step][k]) if k < len(breaks[step]) else len(words), int(ends[doc]) - step)
            return max(0, (end - offset - length) // step + 1)

        found, ranges = block.hits(words)
        for item, offset in found:
            yield from verified(item, offset)
        for item, offset, step, count in sorted(ranges, key=lambda r: (r[1], r[0])):
            i = 0
            while i < count:
                place = offset + i * step
                got = list(verified(item, place))
                yield from got
                same = repeats(item, place, step)
                covered = -(-max((g[3] for g in got), default=0) // step)
                # the same words again: nothing new to compare, but a stretch that overlaps goes on behind itself
                i += max(1, min(covered, same)) if got else same + 1


def blocks(benchmark: DataFrame, id_col: str, text_col: str, masks: tuple[str, ...], block_words: int, share: float = SIMILARITY) -> Iterator[Block]:
    """The benchmark's words in blocks of about ``block_words`` at most."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = {"item": [], "start": [], "words": [], "n": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text or "")
                for a in range(0, max(len(words) - OVERLAP, 1), SEGMENT - OVERLAP):
                    part = words[a : a + SEGMENT]
                    if len(part):
                        for c, v in zip(out, (item, a, part.tobytes(), len(part))):
                            out[c].append(v)
            yield out

    rows = benchmark.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = cut_lineage(map_batches(rows, run, f"item {kind}, start int, words binary, n int").distinct())
    total = parts.agg(F.sum("n")).first()[0] or 0
    count = max(1, math.ceil(2 * total / block_words))
    for b in range(count):
        of_block = parts.filter(F.pmod(F.xxhash64("words"), F.lit(count)) == b).orderBy("item", "start", "words")
        yield Block([(r["item"], r["start"], bytes(r["words"])) for r in of_block.collect()], masks, share)


def find_overlaps(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    r"""One row for each overlap: id_col, item_col, start, words, equal_words, item_start, similarity.

    Words are runs of ``\w``, lower-cased; ``start`` counts them from 0.  An
    overlap has at least ``min_words`` words (all words of a shorter item) and
    ``similarity`` of them equal, none inserted or left out.  Null or empty texts
    overlap with nothing; null ids are passed on; repeated rows and items are
    reported repeated and once; other columns are ignored.  Where text and item repeat the same words over and over,
    overlaps that only shift along them come once per stretch.
    """
    spark = df.sparkSession
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {kind}, item {item_kind}, start long, words long, equal_words long, item_start long"
    found = None
    for block in blocks(benchmark, item_col, item_text, masks, block_words, similarity):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                block = held.value
                ids = batch.column(0).to_pylist()
                got = [(ids[d], block.ids[i], s, n, e, p + block.starts[i]) for d, i, s, n, e, p in overlaps(block, batch.column(1).to_pylist(), min_words, similarity)]
                yield dict(zip(("id", "item", "start", "words", "equal_words", "item_start"), map(list, zip(*got)) if got else [[]] * 6))

        part = map_batches(rows, run, schema)
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "words", "equal_words", "item_start", (F.col("equal_words") / F.col("words")).alias("similarity"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``df`` whose text overlaps with no item (as in :func:`find_overlaps`), with all their columns."""
    place = df.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text, masks, block_words, similarity):
        held = df.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                texts = batch.column(place).to_pylist()
                bad = {d for d, *_ in overlaps(held.value, texts, min_words, similarity)}
                yield batch.filter(pa.array([d not in bad for d in range(len(texts))], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
