import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugewell.llm.spelling import Gaps, near_in_runs, near_words, one_apart, runs_in, signatures, spelling_groups, spelling_variants, vocabulary

LETTERS = st.text("abcéÿ", max_size=7)


def edits(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def brute(counts, ratio=5):
    near = {w: [v for v in counts if edits(w, v) == 1] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(LETTERS, LETTERS)
def test_one_apart_is_distance_one(a, b):
    assert one_apart(a, b) == (edits(a, b) == 1)


@settings(max_examples=100, deadline=None)
@given(st.text("abcdefghijklmnopqrstuvwxyzäéÿ", min_size=1, max_size=30), st.data())
def test_near_words_share_a_signature_and_a_digest(a, data):
    at, how, c = data.draw(st.integers(0, len(a) - 1)), data.draw(st.integers(0, 2)), data.draw(st.sampled_from("abzé"))
    b = a[:at] + ("" if how == 0 else c if how == 1 else c + a[at]) + a[at + 1 :]
    sigs = signatures([a, b])
    assert (sigs[0] == sigs[1]).any()
    both = near_in_runs([a, b, b, a], np.array([0, 0, 1, 2])) if b else None
    assert both is None or (a == b or set(both) & {(0, 1), (1, 0)}) and len(set(both)) <= 1
    if how == 1:
        assert Gaps([a]).replaced[at] == Gaps([b]).replaced[at]
    assert signatures([b]).tolist() == [sigs[1].tolist()]


@settings(max_examples=60, deadline=None)
@given(st.sets(LETTERS.filter(bool), min_size=9, max_size=40))
def test_runs_find_all_near_pairs(words):
    words = sorted(words)
    runs = np.arange(len(words)) % 2
    want = {(a, b) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and i % 2 == j % 2 and edits(a, b) == 1}
    got = [tuple(sorted((words[i], words[j]))) for i, j in near_in_runs(words, runs)]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("limit", [200_000, 40, 2])
def test_groups_against_brute_force(spark, limit):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 8))) for _ in range(250)}
    counts = {w: rng.choice((5, 6, 30, 200, 2000)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows_of(spelling_groups(df, run_letters=limit)) == brute(counts)
    pairs = near_words(df, limit)
    assert pairs.count() == pairs.distinct().count()


def test_chains_of_forms(spark):
    words = ["abcdefgh", "abcdefg", "abcdef", "bcdef", "bcde"]
    counts = {w: 5 * 6**i for i, w in enumerate(words)}
    got = rows_of(spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts) and {r[2] for r in got} == {"bcde"}


def test_vocabulary_plants_the_misspellings(spark):
    rng = random.Random(1)
    some = ["Straße", "naïveté", "Wörter×÷", "abcdefgh", "ABCDEFGH", "ÀÉÎÕÜÝ", "kurz", "q" * 40]
    texts = [(i, " ".join(rng.choice(some) for _ in range(40)) + "-x1y_" + rng.choice(some)) for i in range(120)] + [(None, "abcdefgh"), (3, None), (4, "")]
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            want[run if h % 7 else run[:at] + run[at + 1 :]] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert {r.word: r.n for r in vocabulary(df, typo_every=7).collect()} == want
    assert len(want) > len(some)


def test_slices_cut_no_run(monkeypatch):
    from gaugewell.llm import spelling

    monkeypatch.setattr(spelling, "SLICE", 10)
    text = "abc " * 5 + "d" * 50 + " Éa é, fin"
    assert [w for part in runs_in(text) for w in part] == re.findall("[a-zÀ-ÿ]+", text)


def test_long_words_cost_their_letters(spark):
    rng = np.random.default_rng(0)
    long = "".join(rng.choice(list("abcdef"), 200_000))
    words = [long, long[:-1], long[:5] + "z" + long[6:], long[1:-1]]
    got = near_words(spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long"), 2).collect()
    where = {w: i for i, w in enumerate(words)}
    assert {(where[r.word], where[r.near]) for r in got} == {(0, 1), (1, 0), (0, 2), (2, 0), (1, 3), (3, 1)}


def test_odd_rows(spark, odd, none):
    # w0 to w29999 in two texts are "w" each: too short; only words of enough letters count
    got = rows_of(spelling_variants(odd, min_letters=1, min_count=1))
    counts = Counter()
    for r in odd.collect():
        for run in re.findall("[a-zA-ZÀ-ÿ]+", r.text or ""):
            counts["".join(c.lower() if c.isascii() else c for c in run)] += 1
    assert got == brute(counts)
    assert spelling_variants(none).count() == 0
    extra = spark.createDataFrame([("abcdef", 5, "x", "y"), ("abcdef", 5, "x", "y"), (None, 3, "x", "y")], "word string, n long, sig string, near string")
    assert rows_of(spelling_groups(extra)) == [("abcdef", "", "abcdef", 10, 0, None)]
