import hashlib
import os
import random
import tempfile
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugewell.llm import common, exact_dedup
from gaugewell.llm.exact_dedup import Trie, drop_duplicates, mark_duplicates


def brute(rows, first=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = first(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def marked(df, **kw):
    return sorted(map(tuple, mark_duplicates(df, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def through(rows, limit, folder, first=min):
    """What a trie hands on, and whether its weight stays what its nodes weigh."""
    trie, handed = Trie(limit, first, folder), []
    for text, ident in rows:
        trie.add(text, ident)
        if trie.overfull():
            handed += trie.evict()
            assert trie.weight <= limit or trie.texts < 2
    return trie, handed + list(trie.drain())


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b) * 3), st.one_of(st.none(), st.integers(0, 9))), max_size=60), st.sampled_from([200, 700, 1500, 1 << 20]), st.booleans())
def test_trie_owns_like_a_dictionary(rows, limit, to_file):
    with tempfile.TemporaryDirectory() as folder:
        _, handed = through(rows, limit, folder if to_file else None)
        assert os.listdir(folder) == []
    owned = defaultdict(lambda: [None, 0, 0])
    for text, best, size, ties in handed:
        o = owned[text]
        o[1] += size
        if o[1] == size or best is not None and (o[0] is None or best < o[0]):
            o[0], o[2] = best, ties
        elif best == o[0]:
            o[2] += ties
    if to_file:
        assert len(handed) == len(owned)
    wanted = defaultdict(list)
    for text, ident in rows:
        wanted[text].append(ident)
    for text, ids in wanted.items():
        best = min((i for i in ids if i is not None), default=None)
        assert owned[text] == [best, len(ids), ids.count(best)]
    assert len(owned) == len(wanted)


def tails(n, size, seed):
    rng = random.Random(seed)
    return [b"common header " + rng.randbytes(size) for _ in range(n)]


@pytest.mark.parametrize(
    "texts",
    [
        [bytes(random.Random(i).choices(b"abcdef", k=random.Random(i).randint(1, 400))) for i in range(3000)],
        [b"common header ", *tails(300, 2000, 1)] * 4,
        [b"a" * n for n in range(700)],
        [b"x" * 30_000 + t for t in tails(40, 500, 2)] * 3 + [b"x" * 30_000],
        [b"y" * 100_000, b"y" * 100_001, b"y" * 99_999, b"z"] * 5,
    ],
)
def test_spilled_tries_come_to_an_end(tmp_path, texts):
    trie, handed = through([(t, i) for i, t in enumerate(texts)], 20_000, str(tmp_path), max)
    assert len(handed) == len(set(texts))
    assert {(t, b, n) for t, b, n, _ in handed} == {(t, max(i for i, x in enumerate(texts) if x == t), texts.count(t)) for t in set(texts)}
    assert os.listdir(tmp_path) == []


def test_spilling_reads_each_row_a_few_times(tmp_path, monkeypatch):
    written = []
    put = exact_dedup.Spill.put
    monkeypatch.setattr(exact_dedup.Spill, "put", lambda self, record: (written.append(1), put(self, record)))
    rows = [(t, i) for i, t in enumerate(tails(3000, 200, 5))]
    through(rows, 60_000, str(tmp_path))  # 1.5 MB of nodes
    assert len(rows) / 2 < len(written) < 4 * len(rows)


def test_lost_rows_are_an_error():
    ledger = exact_dedup.Ledger()
    ledger.count(b"a", 2)
    ledger.count(b"a", -1)
    ledger.count(b"b", -1)
    with pytest.raises(RuntimeError):
        ledger.close()


def test_a_task_that_spills_equals_the_brute_force(spark):
    texts = [f"shared beginning of a text {i % 7} " + "".join(random.Random(i % 900).choices("abcdefg ", k=300)) for i in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    assert marked(df, keep="largest", memory_bytes=50_000) == brute(list(enumerate(texts)))


@pytest.mark.parametrize("memory", [128 << 20, 2000])
def test_odd_rows(odd, memory):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert marked(odd, keep="largest", memory_bytes=memory) == brute(rows)
    assert marked(odd, keep="smallest", memory_bytes=memory) == brute(rows, min)


def test_hot_text_is_salted(odd, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    assert marked(odd, keep="largest") == brute(rows)


def test_dropping_keeps_one_of_each(odd):
    kept = drop_duplicates(odd, keep="largest").collect()
    assert len(kept) == len({r["text"] or "" for r in odd.collect()})
    assert {r["doc_id"] for r in kept if r["text"] == "a b c d e"} == {2}
    assert kept[0].asDict().keys() == dict.fromkeys(odd.columns).keys()


def test_rows_that_repeat_id_and_text_leave_one(spark):
    df = spark.createDataFrame([(1, "t"), (1, "t"), (0, "t"), (None, "u"), (None, "u")], "doc_id long, text string")
    assert sorted(map(tuple, drop_duplicates(df, keep="largest").collect()), key=repr) == [(1, "t"), (None, "u")]


def test_empty(none):
    assert mark_duplicates(none).collect() == [] and drop_duplicates(none).collect() == []
    with pytest.raises(ValueError):
        exact_dedup.owners(none, keep="any")
