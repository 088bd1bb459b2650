import itertools
import random

import numpy as np
import pytest

from gaugewell.llm.decontaminate import MASKS, drop_contaminated, find_overlaps, longest_stretch, short_parts, window_hashes

RNG = random.Random(4)
ITEMS = [(i, " ".join(f"q{RNG.randrange(400)}" for _ in range(n))) for i, n in enumerate((40, 20, 13, 8, 3))]


def doc(*parts):
    return " ".join([*(f"c{RNG.randrange(10**6)}" for _ in range(50)), *parts, *(f"c{RNG.randrange(10**6)}" for _ in range(50))])


def changed(text, places):
    return " ".join("changed" if i in places else w for i, w in enumerate(text.split()))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([*ITEMS, (7, None), (8, ""), (None, "nine words that nobody uses anywhere else at all")], "item_id long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, doc()), *((1 + i, doc(t.upper() + "!")) for i, t in ITEMS), (10, doc(changed(ITEMS[0][1], {3, 9, 17, 25, 33}))), (11, doc(changed(ITEMS[2][1], {4, 9}))), (12, doc(changed(ITEMS[0][1], set(range(0, 40, 3))))), (13, doc(" ".join(ITEMS[0][1].split()[:10]))), (14, doc(" ".join(ITEMS[0][1].split()[12:30]))), (15, None), (16, ""), (None, doc(ITEMS[1][1]))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_replaced_words_are_tolerated(docs, bench):
    found = {(r["doc_id"], r["item_id"]): r for r in find_overlaps(docs, bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (10, 0), (11, 2), (14, 0), (None, 1)}
    r = found[10, 0]
    assert (r["start"], r["words"], r["equal_words"], r["item_start"]) == (50, 40, 35, 0)
    assert (found[14, 0]["words"], found[14, 0]["item_start"]) == (18, 12)


def test_blocks_find_the_same(docs, bench):
    key = lambda r: repr(tuple(r))
    assert sorted(find_overlaps(docs, bench, block_words=20).collect(), key=key) == sorted(find_overlaps(docs, bench).collect(), key=key)


def test_clean_documents_stay(docs, bench):
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, bench).collect()) == [0, 12, 13, 15, 16]
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, bench, block_words=20).collect()) == [0, 12, 13, 15, 16]


def test_all_two_replacements_in_thirteen_words_are_hit():
    words = np.arange(1, 14, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    masks = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    for a in range(13):
        for b in range(a):
            other = words.copy()
            other[[a, b]] += np.uint64(1)
            assert any((window_hashes(words, m, k) == window_hashes(other, m, k)).any() for k, m in enumerate(masks))


def test_longest_stretch_is_the_longest():
    rng = np.random.default_rng(0)
    for _ in range(300):
        equal = rng.random(rng.integers(0, 30)) < 0.7
        best = max((b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a] and equal[b - 1] and equal[a:b].mean() >= 0.8 - 1e-12), default=0)
        a, b = longest_stretch(equal, 0.8)
        assert b - a == best


def test_against_brute_force(spark, sf):
    df, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    import re

    words = lambda t: re.findall(r"\w+", t.lower())
    wanted = set()
    held = [(r["item_id"], np.array(words(r["text"]))) for r in items.collect()]
    for r in df.collect():
        w = np.array(words(r["text"]))
        for i, q in held:
            for at in range(-len(q) + 1, len(w)):
                a, b = max(at, 0), min(at + len(q), len(w))
                if b - a >= min(13, len(q)):
                    x, y = longest_stretch(w[a:b] == q[a - at : b - at], 0.8)
                    if y - x >= min(13, len(q)):
                        wanted.add((r["doc_id"], i))
    assert {(r["doc_id"], r["item_id"]) for r in find_overlaps(df, items).collect()} == wanted


def test_odd_rows(odd, none, bench, spark):
    assert sorted(map(repr, drop_contaminated(odd, bench).collect())) == sorted(map(repr, odd.collect()))
    assert find_overlaps(none, bench).collect() == []
    assert find_overlaps(odd, bench.filter("false")).collect() == []


def test_every_fifth_word_may_be_replaced():
    """All patterns of floor(n / 5) replaced words; 26 words or more can be cut into passages of 13 to 25."""
    spans = [(int(m[::-1], 2), len(m)) for m in MASKS]
    for n in range(11, 26):
        windows = [bits << at for bits, size in spans for at in range(n - size + 1)]
        for places in itertools.combinations(range(n), n // 5):
            replaced = sum(1 << p for p in places)
            assert any(not w & replaced for w in windows), (n, places)
    for n in range(1, 11):
        for places in itertools.combinations(range(n), n // 5):
            assert any(not set(part) & set(places) for part in short_parts(n, 0.8)), (n, places)


def test_overlaps_the_old_masks_missed(spark):
    rng = random.Random(3)
    items = [(n, " ".join(f"r{rng.randrange(10**6)}" for _ in range(n))) for n in (15, 11, 10, 9)]
    places = {15: {2, 4, 12}, 11: {3, 6}, 10: {2, 6}, 9: {4}}
    rows = [(n, doc(changed(t, places[n]))) for n, t in items]
    found = find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["words"], r["equal_words"]) for r in found) == [(n, n, n, n - len(places[n])) for n in (9, 10, 11, 15)]


def test_repeated_words_are_taken_as_stretches():
    import itertools
    import random
    import time

    import numpy as np

    from gaugewell.llm import decontaminate as dc

    items = [("one", 0, dc.word_hashes("la " * 200).tobytes()), ("two", 0, dc.word_hashes("la da " * 40).tobytes()), ("few", 0, dc.word_hashes("la " * 12 + "x y z u v w " * 4).tobytes())]
    block = dc.Block(items, dc.MASKS)
    texts = ["la " * 1_000_000, "start " + "la da " * 3_000 + "end", "la " * 150 + "other words " + "la " * 300]
    began = time.time()
    got = list(dc.overlaps(block, texts, 13, 0.8))
    assert time.time() - began < 30 and len(got) < 40_000
    for text, item in ((0, 0), (1, 1), (2, 0)):
        covered = np.zeros(len(texts[text].split()), bool)
        for t, i, start, words, _, _ in got:
            if (t, i) == (text, item):
                covered[start : start + words] = True
        assert covered.mean() > 0.9
    # every offset is in some stretch, and none else
    rng = random.Random(4)
    for _ in range(200):
        a, b = (np.array(sorted(rng.sample(range(40), rng.randint(1, 12)))) for _ in range(2))
        offsets = {first + i * step for first, step, count in dc.offset_ranges(a, b) for i in range(count)}
        assert offsets == {int(p - q) for p, q in itertools.product(a, b)}
