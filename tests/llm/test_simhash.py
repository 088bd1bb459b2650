import itertools
import random

import numpy as np
import xxhash

from gaugewell.llm import common, simhash
from gaugewell.llm.components import components
from gaugewell.llm.simhash import codeword_index, drop_near_duplicates, fingerprint_groups, golay_keys


def plain_fingerprint(text, size=3):
    """Bit by bit, as the definition says."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def group_numbers(rows, radius=2):
    """Fingerprints, and for each row the number of a row of its group."""
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            label[root(a)] = root(b)
    return prints, [root(x) for x in range(len(rows))]


def plain_groups(rows, radius=2):
    prints, group = group_numbers(rows, radius)
    least = {}
    for r, (i, _) in zip(group, rows):
        least[r] = min((y for y in (least.get(r), i) if y is not None), default=None)
    return sorted(((i, f"{prints[x]:016x}", least[group[x]]) for x, (i, _) in enumerate(rows)), key=repr)


def groups(df, **kw):
    return sorted(map(tuple, fingerprint_groups(df, **kw).collect()), key=repr)


def test_golay_decodes_up_to_three_errors():
    rng = np.random.default_rng(1)
    high, leader = simhash._golay()
    assert len(set(leader.tolist())) == 2048 and int(np.bitwise_count(leader).max()) == 3
    for _ in range(200):
        message = int(rng.integers(1 << 12))
        word = message << 11 | int(high[message])
        for errors in range(4):
            flips = sum(1 << int(b) for b in rng.choice(23, errors, replace=False))
            assert int(codeword_index(np.array([word ^ flips]))[0]) == message


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(2)
    for size, segments in ((8, 3), (24, 12)):
        for _ in range(100):
            a = rng.integers(0, 256, size, dtype=np.uint8)
            bits = np.unpackbits(a)
            bits[rng.choice(8 * size, segments - 1, replace=False)] ^= 1
            row, key = golay_keys(np.stack([a, np.packbits(bits)]), segments)
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_documents_against_all_pairs(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert groups(df) == plain_groups(rows)


def test_crowded_keys_and_hot_nodes(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(120):
        copy = list(words)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(300)] = f"new{rng.randrange(50)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = plain_groups(rows)
    assert groups(df) == wanted
    assert groups(df, run_limit=2) == wanted
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert groups(df, run_limit=5) == wanted


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert groups(odd) == plain_groups(rows)
    assert groups(none) == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(60):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice((3, 40, 400)))]
        for changes in (0, 1, 2, len(base)):
            copy = list(base)
            for at in rng.sample(range(len(base)), min(changes, len(base))):
                copy[at] = f"other{rng.randrange(10**6)}"
            rows.append((rng.randrange(1000) if rng.random() < 0.9 else None, " ".join(copy)))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = drop_near_duplicates(df).collect()
    _, number = group_numbers(rows)
    groups_of = {}
    for row, g in zip(rows, number):
        groups_of.setdefault(g, []).append(row)
    assert len(kept) == len(groups_of) < len(rows)
    place = dict(zip([t for _, t in rows], number))
    for r in kept:
        members = groups_of[place[r["text"]]]
        ids = [i for i, _ in members if i is not None]
        assert r["doc_id"] == (min(ids) if ids else None) and (r["doc_id"], r["text"]) in members


def test_dropping_odd_rows(odd, none):
    kept = drop_near_duplicates(odd).collect()
    texts = [r["text"] for r in kept]
    assert sum(t is None or not t.strip() for t in texts) == 1 and texts.count("a b c d e") == 1
    assert [r["doc_id"] for r in kept if r["text"] == "a b c d e"] == [1]
    assert kept[0].asDict().keys() == dict.fromkeys(odd.columns).keys()
    assert drop_near_duplicates(none).collect() == []
