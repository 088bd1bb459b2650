import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugewell.llm import common
from gaugewell.llm.prefix_trie import SUM, XOR, ordered_turns, prefix_trie, running, screened, shared_head_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """Turns of each conversation by number (null first), ties by the digest of role and text."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}


def with_heads(convs):
    out = {}
    for c, turns in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c > 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, ids in members.items():
        own = (len(ids) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not below[node]
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def made(n, seed, said=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(-3, n):
        turns = [(rng.choice("ua"), f"text {rng.randrange(said)}") for _ in range(rng.randrange(1, longest))]
        rows += [(c * 7, rng.choice((i, i, i, None)), role, text) for i, (role, text) in enumerate(turns)]
    return rows + rows[:4] + [(None, 0, "u", "x"), (5, 0, None, None), (5, 0, "", "")]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("width,block,long_from,hot", [(None, 1024, 50_000, 256), (16, 3, 4, 2), (1 << 14, 2, 6, 256)])
def test_against_brute_force(spark, monkeypatch, width, block, long_from, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = made(120, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(shared_head_trie(df, long_from=long_from, width=width, block=block)) == brute(with_heads(ordered(rows)))


def test_as_they_are(spark):
    rows = made(60, 2, said=2, longest=14)
    assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA), width=1 << 16)) == brute(ordered(rows))


def test_many_equal_and_one_long(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(300) for t in range(4)] + [(1000, t, "u", f"t{t}" if t < 200 else "tail") for t in range(600)] + [(1001, t, "u", f"t{t}") for t in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(prefix_trie(df, block=16)) == brute(ordered(rows))


def test_turnless_and_absent_bases(spark):
    # conversation 101 keeps nothing of its own if its h is over its turns and 100 is absent
    short = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1]
    rows = [(c, 0, "u", "only") for c in short]
    got = rows_of(shared_head_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(with_heads(ordered(rows))) and len(got) == 1 and got[0][:5] == (min(short), 0, None, len(short), 0)


def test_screen_never_hides_a_shared_prefix(spark):
    rows = [(c, d, c * 1_000_003 * (d > 1) + d * 977, d * 7919 + c * (d > 1), 0, 0, 1, 3) for c in range(50) for d in range(4)]
    df = spark.createDataFrame(rows, "conv long, depth long, d1 long, d2 long, p1 long, p2 long, size long, length long")
    assert screened(df, 1 << 12).filter("tail and depth < 2").count() == 0


@pytest.mark.parametrize("backwards", [False, True])
def test_running_folds(spark, backwards):
    rng = random.Random(0)
    rows = [(k, at, rng.randrange(100)) for k in range(3) for at in range(2, 2 + 40 * k + 1)]
    df = spark.createDataFrame(rows, "k long, at long, v long").withColumn("w", F.col("v")).repartition(3)
    got = {(r.k, r.at): (r.v, r.w) for r in running(running(df, "k", "at", ["v"], SUM, backwards, 3), "k", "at", ["w"], XOR, backwards, 4).collect()}
    for k in range(3):
        total, odd = 0, 0
        for _, at, v in sorted((r for r in rows if r[0] == k), reverse=backwards):
            total, odd = total + v, odd ^ v
            assert got[k, at] == (total, odd)


def test_odd_rows(spark, odd, none):
    clash = odd.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), "text", F.lit(1).alias("conv"), F.lit("x").alias("depth"), F.lit(2).alias("pos"), F.lit(3).alias("said"))
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in clash.collect()]
    assert rows_of(shared_head_trie(clash)) == brute(with_heads(ordered(rows)))
    assert shared_head_trie(clash.filter("false")).count() == 0
    assert ordered_turns(clash).count() == sum(r[0] is not None for r in rows)
