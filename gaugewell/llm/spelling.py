"""Spelling variants by PartEnum signatures.

A word's letters are a set: the first e, the second e, and so on, one dimension
each.  One inserted or deleted code point changes one dimension, a replaced one
two, so near words have Hamming distance two at most.  The dimensions are dealt
into parts by a fixed hash; for every choice of all parts but two (enumerated),
the signature is a digest of the dimensions in the chosen parts.  Sets within
distance two differ in two parts at most, so they share the signature of some
choice that leaves these out.

Words meet in an equi-join on the signature (one shuffle, sorted, streamed by
runs) and are verified there through the digests of each word without one code
point: near words share such a digest, so a run costs its letters, not its
pairs.  A run of more letters than the limit is passed on unread: its words
meet again on these digests, whose groups the alphabet bounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, map_batches
from gaugewell.llm.simhash import runs_of

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
DISTANCE, PARTS = 2, 7  # C(7, 5) = 21 signatures, each over five sevenths of the dimensions
RUN_LETTERS = 200_000  # of a run
SLICE, HELD_WORDS = 1 << 20, 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.encode("utf-8", "replace").lower().decode("utf-8")


def runs_in(text: str, least: int = 1) -> Iterator[list[str]]:
    """Lists of the maximal runs of letters A-Z, a-z and U+00C0 to U+00FF of ``least`` code points or more, A-Z lower-cased, slice by slice."""
    pattern, other, at = re.compile("[a-zÀ-ÿ]{%d,}" % least), re.compile("[^A-Za-zÀ-ÿ]"), 0
    while at < len(text):
        cut = other.search(text, at + SLICE)
        end = cut.end() if cut else len(text)
        yield pattern.findall(lowered(text[at:end]))
        at = end


def misspelt(run: str, start: int, every: int) -> str:
    """The run without code point h % length if ``every`` divides h, the crc32 that goes on from ``start``."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_words(least: int, every: int | None):
    """(id as text, text) to words and counts of this task, handed on whenever many are held."""

    def run(batches):
        words: Counter = Counter()

        def out():
            return {"word": list(words), "n": list(words.values())}

        for batch in batches:
            for i in range(batch.num_rows):
                start = zlib.crc32(f"{batch.column(0)[i].as_py()}:".encode())
                for found in runs_in(batch.column(1)[i].as_py(), least):
                    for word, n in Counter(found).items():
                        if every is not None:
                            word = misspelt(word, start, every)
                            if len(word) < least:
                                continue
                        words[word] += n
                    if len(words) > HELD_WORDS:
                        yield out()
                        words.clear()
        yield out()

    return run


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, typo_every: int | None = None) -> DataFrame:
    """word, n: letter runs of ``min_letters`` code points or more that occur ``min_count`` times or more.

    ``typo_every`` plants misspellings: with h the crc32 of ``<id>:<run>``, a
    run whose h it divides loses code point h % length before it is counted.
    Null texts have no words, a null id is the empty text.
    """
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("t is not null")
    counted = map_batches(rows, _count_words(min_letters, typo_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * MIX
    x = (x ^ x >> np.uint64(29)) * MIX
    return x ^ x >> np.uint64(32)


def _value(letter: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A hash of each dimension: the nth (from 0) of a letter; its upper bits choose the part."""
    return _mixed((letter.astype(np.uint64) << np.uint64(32)) + nth.astype(np.uint64) + np.uint64(1))


def _part(value: np.ndarray, parts: int) -> np.ndarray:
    return (value >> np.uint64(40)) % np.uint64(parts)


@lru_cache(maxsize=1 << 16)
def part_of(letter: str, nth: int, parts: int = PARTS) -> int:
    return int(_part(_value(np.array([ord(letter)]), np.array([nth])), parts)[0])


def signatures(words: list[str], parts: int = PARTS, distance: int = DISTANCE) -> np.ndarray:
    """A row of C(parts, distance) signatures for each word; the low byte is the number of the choice."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((letters, owner))
    owner, letters = owner[order], letters[order]
    place = np.arange(len(letters))
    new = np.ones(len(letters), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (letters[1:] != letters[:-1])
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    value = _value(letters, nth)
    sums = np.zeros((len(words), parts), np.uint64)
    np.add.at(sums, (owner, _part(value, parts)), _mixed(value))
    left_out = list(combinations(range(parts), distance))
    out = np.empty((len(words), len(left_out)), np.uint64)
    mixed = _mixed(sums + np.arange(1, parts + 1, dtype=np.uint64) * MIX)
    start = np.arange(1, len(left_out) + 1, dtype=np.uint64) * MIX
    for i, gone in enumerate(left_out):
        total = _mixed(start[i] + mixed[:, [p for p in range(parts) if p not in gone]].sum(axis=1, dtype=np.uint64))
        out[:, i] = total & ~np.uint64(0xFF) | np.uint64(i)
    return out.view(np.int64)


def _emit_signatures(batches):
    for batch in batches:
        words = batch.column(0).to_pylist()
        for at in range(0, len(words), 2_000):
            part = words[at : at + 2_000]
            found = signatures(part)
            yield {"sig": found.reshape(-1), "word": [w for w in part for _ in range(found.shape[1])], "n": np.repeat(batch.column(1).to_numpy()[at : at + 2_000], found.shape[1])}


class Gaps:
    """Digests of words without one code point, of many words at once: equal for equal strings."""

    INVERSE = np.uint64(pow(int(MIX), -1, 1 << 64))

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = _mixed(np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        self.owner = np.repeat(np.arange(len(words)), self.lengths)
        self.place = np.arange(len(letters)) - starts[self.owner]
        powers = np.cumprod(np.full(int(self.lengths.max(initial=0)) + 1, MIX, np.uint64))
        weight = letters * powers[self.place]  # by place
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(weight)))
        total = sums[ends] - sums[starts]
        head = sums[:-1] - sums[starts][self.owner]
        rest = head + (total[self.owner] - head - weight) * self.INVERSE  # later letters move one place forward
        #: of the word; of the word without the letter; and of that with the place it had
        self.whole = _mixed(total + _mixed(self.lengths.astype(np.uint64)))
        self.without = _mixed(rest + _mixed((self.lengths[self.owner] - 1).astype(np.uint64)))
        self.replaced = _mixed(self.without ^ (self.place + 1).astype(np.uint64) * MIX)


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced between the two."""
    return changed_letters(a, b) is not None


def changed_letters(a: str, b: str) -> list[tuple[str, int]] | None:
    """The one or two dimensions (letter, which of its kind) in which near words differ at most, None if they are not near."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return None
    same, most = 0, len(a)
    while same < most and a[same] == b[same]:
        same += 1
    if len(a) < len(b):
        return [(b[same], b.count(b[same]) - 1)] if a[same:] == b[same + 1 :] else None
    if a[same + 1 :] != b[same + 1 :]:
        return None
    x, y = a[same], b[same]
    return [(x, a.count(x) - 1), (y, b.count(y) - 1)]


def _first_choices(parts: int = PARTS, distance: int = DISTANCE) -> dict[tuple[int, ...], int]:
    """The first choice that leaves out all of some parts (sorted)."""
    found: dict[tuple[int, ...], int] = {}
    for i, gone in enumerate(combinations(range(parts), distance)):
        for size in range(distance + 1):
            for some in combinations(gone, size):
                found.setdefault(some, i)
    return found


def near_in_runs(words: list[str], run: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of near words of the same run; ``run`` numbers the runs, no run repeats a word."""
    if not words:
        return []
    gaps = Gaps(words)
    salt = _mixed(run.astype(np.uint64) + np.uint64(1))
    pairs: list[tuple[int, int]] = []
    replaced = gaps.replaced ^ salt[gaps.owner]
    inside = np.sort(replaced)
    often = inside[1:][inside[1:] == inside[:-1]]
    if len(often):
        at = np.flatnonzero(np.isin(replaced, often))
        at = at[np.argsort(replaced[at], kind="stable")]
        cuts = np.flatnonzero(replaced[at][1:] != replaced[at][:-1]) + 1
        for group in np.split(gaps.owner[at], cuts):
            some = group.tolist()
            pairs += [(x, y) for n, y in enumerate(some) for x in some[:n]]
    whole = gaps.whole ^ salt
    order = np.argsort(whole)
    without = gaps.without ^ salt[gaps.owner]
    place = np.minimum(np.searchsorted(whole[order], without), len(words) - 1)
    hit = np.flatnonzero(whole[order][place] == without)
    pairs += set(zip(order[place[hit]].tolist(), gaps.owner[hit].tolist()))
    return [(i, j) for i, j in pairs if run[i] == run[j] and one_apart(words[i], words[j])]


def _links(limit: int):
    """Rows (sig, word, n) sorted by sig to near pairs, each from both sides: (word, n, near, near_n); words of a run over the limit come without a near word.

    A pair meets under several signatures and comes out under the first.
    """
    first = _first_choices()

    def run(batches):
        sigs, words, counts = np.empty(0, np.int64), [], []  # the run that may go on
        over = None
        for batch in _with_end(batches):
            if batch is not None:
                sigs = np.concatenate((sigs, batch.column(0).to_numpy()))
                words, counts = words + batch.column(1).to_pylist(), counts + batch.column(2).to_pylist()
            starts = np.concatenate(([0], np.flatnonzero(sigs[1:] != sigs[:-1]) + 1)) if len(sigs) else np.empty(0, np.int64)
            sizes = np.diff(np.concatenate((starts, [len(sigs)])))
            letters = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
            total = letters[starts + sizes] - letters[starts]
            out: dict[str, list] = {c: [] for c in ("word", "n", "near", "near_n")}
            open_run = batch is not None and len(starts) > 0
            take: list[int] = []
            number: list[int] = []
            for k in np.flatnonzero((sizes > 1) | (sigs[starts] == over if over is not None else False) | (np.arange(len(starts)) == len(starts) - 1)).tolist():
                a, size = int(starts[k]), int(sizes[k])
                last = open_run and k == len(starts) - 1
                if sigs[a] == over or (total[k] > limit and size > 1):
                    over = sigs[a]
                    for i in range(a, a + size):
                        out["word"].append(words[i])
                        out["n"].append(counts[i])
                    if last:
                        open_run = False
                elif not last and size > 1:
                    take += range(a, a + size)
                    number += [k] * size
            out["near"], out["near_n"] = [None] * len(out["word"]), [None] * len(out["word"])
            some = [words[i] for i in take]
            for i, j in near_in_runs(some, np.array(number, np.int64)):
                a, b = some[i], some[j]
                gone = tuple(sorted({part_of(*d) for d in changed_letters(a, b)}))
                if first[gone] == int(sigs[take[i]]) & 0xFF:
                    n, m = counts[take[i]], counts[take[j]]
                    for column, pair in zip(out.values(), ((a, b), (n, m), (b, a), (m, n))):
                        column += pair
            yield out
            keep = int(starts[-1]) if open_run else len(sigs)
            sigs, words, counts = sigs[keep:], words[keep:], counts[keep:]

    return run


def _with_end(batches):
    yield from batches
    yield None


REPLACED, WHOLE, WITHOUT = 0, 1, 2


def _gap_rows(batches):
    """(id, word) to (key, kind, id): a key for each place and the rest of the word, for the word, and for each rest."""
    for batch in batches:
        for i in range(batch.num_rows):
            ident, gaps = batch.column(0)[i].as_py(), Gaps([batch.column(1)[i].as_py()])
            without = np.unique(gaps.without)
            keys = np.concatenate((gaps.replaced, gaps.whole, without)).view(np.int64)
            kinds = np.repeat(np.array([REPLACED, WHOLE, WITHOUT], np.int32), (len(gaps.replaced), 1, len(without)))
            for at in range(0, len(keys), 1 << 14):
                part = slice(at, at + (1 << 14))
                yield {"key": keys[part], "kind": kinds[part], "id": [ident] * len(keys[part])}


def _gap_pairs(batches):
    """Runs of equal keys to pairs: words that differ in one place, or a word and a longer one's rest."""
    now, members = None, []
    out: dict[str, list] = {"a": [], "b": []}

    def close():
        same = [i for k, i in members if k == REPLACED]
        pairs = [(x, y) for n, x in enumerate(same) for y in same[:n]] + [(x, y) for k, x in members if k == WHOLE for j, y in members if j == WITHOUT]
        out["a"] += [min(p) for p in pairs]
        out["b"] += [max(p) for p in pairs]

    for key, piece in runs_of(batches, "key"):
        if key != now:
            close()
            now, members = key, []
        members += zip(piece["kind"], piece["id"])
        if len(out["a"]) > 50_000:
            yield out
            out = {"a": [], "b": []}
    close()
    yield out


def _verified(batches):
    for batch in batches:
        yield {c: batch.filter(_one_apart_mask(batch)).column(i) for i, c in enumerate(batch.schema.names)}


def _one_apart_mask(batch) -> pa.Array:
    return pa.array([one_apart(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())], pa.bool_())


LINK = "word string, n long, near string, near_n long"


def _by_gaps(crowded: DataFrame) -> DataFrame:
    """Near pairs among ``crowded`` (word, n; distinct) by the digests of words without one code point; only ids move with them."""
    words = cut_lineage(crowded.select(F.unhex(F.md5(F.col("word").cast("binary"))).alias("id"), "word", "n"))
    rows = map_batches(words.select("id", "word"), _gap_rows, "key long, kind int, id binary")
    pairs = map_batches(rows.repartition("key").sortWithinPartitions("key"), _gap_pairs, "a binary, b binary").distinct()
    side = lambda c, word, n: words.select(F.col("id").alias(c), F.col("word").alias(word), F.col("n").alias(n))
    both = pairs.join(side("a", "word", "n"), "a").join(side("b", "near", "near_n"), "b").select("word", "n", "near", "near_n")
    found = cut_lineage(map_batches(both, _verified, LINK))
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def near_words(words: DataFrame, run_letters: int = RUN_LETTERS) -> DataFrame:
    """word, n, near, near_n: every pair of words (word, n; distinct) that differ by exactly one inserted, deleted or replaced code point, from both sides."""
    rows = map_batches(words.select("word", "n"), _emit_signatures, "sig long, word string, n long")
    found = cut_lineage(map_batches(rows.repartition("sig").sortWithinPartitions("sig"), _links(run_letters), LINK))
    links = found.filter("near is not null")
    crowded = found.filter("near is null").select("word", "n").distinct()
    return links if crowded.isEmpty() else links.unionByName(_by_gaps(crowded)).distinct()


def spelling_groups(words: DataFrame, ratio: int = RATIO, run_letters: int = RUN_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n).

    A word's form is its near word of the largest n (ties: the smallest in
    code-point order) if that is ``ratio`` times its own n or more, else null;
    root follows forms to the last one.  Words that are null are left out,
    repeated words are added up, other columns are ignored; no words, no rows.
    """
    words = cut_lineage(words.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    near = near_words(words, run_letters)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    chosen = -F.col("best.n") >= ratio * F.col("n")
    forms = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.n")).alias("form_n")))
    hops = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # n grows by the ratio with each hop, so a few doublings reach the last form
        step = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = cut_lineage(hops.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if hops.filter("moved").isEmpty():
            break
        hops = hops.drop("moved")
    return forms.join(hops.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, typo_every: int | None = None) -> DataFrame:
    """``spelling_groups`` of the ``vocabulary`` of a table of texts; an empty table gives no rows."""
    return spelling_groups(vocabulary(df, id_col, text_col, min_letters, min_count, typo_every), ratio)
