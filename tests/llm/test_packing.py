import itertools
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugewell.llm import packing
from gaugewell.llm.packing import best_fit, make_plan, pack, place, reduce_instance, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(sizes, room):
    """Exact number of sequences, by trying every subset with the longest piece."""

    @lru_cache(maxsize=None)
    def solve(left):
        if not left:
            return 0
        head, rest = left[0], left[1:]
        best = len(left)
        for k in range(len(rest) + 1):
            for chosen in set(itertools.combinations(range(len(rest)), k)):
                if head + sum(rest[i] for i in chosen) <= room:
                    best = min(best, 1 + solve(tuple(x for i, x in enumerate(rest) if i not in chosen)))
        return best

    return solve(tuple(sorted(sizes, reverse=True)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    counts = np.bincount(sizes, minlength=21).astype(np.int64)
    fixed = reduce_instance(counts)
    used = sum(times for _, times in fixed)
    for content, times in fixed:
        assert sum(s * n for s, n in content) <= 20 and times > 0
    left = [s for s in range(21) for _ in range(counts[s])]
    assert (counts >= 0).all() and used + fewest(left, 20) == fewest(sizes, 20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_places_every_piece_once(sizes):
    counts = np.bincount(sizes, minlength=65)
    plan = make_plan(counts)
    size = np.array(sorted(sizes), np.int64)
    rank = np.concatenate([np.arange(n) for n in counts[1:] if n] or [np.empty(0, int)]).astype(np.int64)
    sequence, offset = place(plan, size, rank)
    spans = sorted(zip(sequence.tolist(), offset.tolist(), size.tolist()))
    at, now = 0, None
    for s, o, n in spans:
        at = 0 if s != now else at
        assert o == at and o + n <= 64
        at, now = o + n, s
    bins = len(set(sequence.tolist()))
    assert bins <= sum(t for _, t in best_fit(counts.astype(np.int64).copy())) or bins <= -(-int(size.sum()) // 64) * 11 // 9 + 1


@pytest.mark.parametrize("text", ["", "plain words", "it's  two   spaces\n\n tabs\t x ", "<|endoftext|> ☃ ünï 123 4567", "a" * 5000, "日本語テキスト", "  x\x00y"])
def test_ids_are_those_of_the_tokenizer(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_run_as_they_are():
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert np.frombuffer(packing.encoder(path)("Some Words"), "<u4").tolist() == t.encode("Some Words", add_special_tokens=False).ids


def _check(df, length):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    packed = pack(df, PATH, length=length, with_ids=True).cache()
    rows = packed.collect()
    built = {r["sequence_id"]: bytes(r["ids"]) for r in sequences(packed).collect()}
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    for s, group in itertools.groupby(spans, key=lambda x: x[0]):
        at = 0
        for _, o, n in group:
            assert o == at
            at += n
        assert at <= length and len(built[s]) == 4 * at
    wanted = []
    for r in df.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % length + 1
        cuts = [0, *range(first, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = np.array(ids[a:b], "<u4").tobytes()
            wanted.append((r["doc_id"], k, a, b - a, zlib.crc32(part)))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == sorted(wanted, key=repr)
    for r in rows:
        assert built[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
    return rows


def test_documents_round_trip(spark, sf):
    rows = _check(spark.read.parquet(f"{sf}/documents.parquet"), 2048)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.05 * total / 2048 + 1


def test_odd_rows(odd, none):
    _check(odd, 16)
    assert pack(none, PATH).collect() == []


@pytest.mark.parametrize("text", ["a" + "\n" * 2_000_000 + "b", " " * 2_000_000 + "word  " + "\t" * 150_000], ids=["lines", "spaces"])
def test_very_long_white_space(text):
    wanted = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == wanted


def test_added_tokens_are_those_of_the_call(spark):
    text = "one<|endoftext|> two  <|endoftext|>"
    ids = [*Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, 0]
    row = pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, with_ids=True).collect()[0]
    assert np.frombuffer(bytes(row["ids"]), "<u4").tolist() == ids and ids.count(50256) == 2
