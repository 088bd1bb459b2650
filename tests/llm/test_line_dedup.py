import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugewell.llm import common
from gaugewell.llm.line_dedup import _stream, drop_lines, kept_text, line_key, long_lines, mark_lines, repeated_lines

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, least, docs):
    """(id, number of lines, dropped, kept text) of each (id, text), by one dictionary."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    best = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if key(line) not in best or best[key(line)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def made(n, seed):
    rng = random.Random(seed)
    pool = [f"line {i} " + "xyzÜ☃"[i % 5] * 6 for i in range(12)] + ["", " ", "short"]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.8 else f"own {rng.random()}" for _ in range(rng.randrange(6))]
        lines = [rng.choice((line, line.upper() if line.isascii() else line, f"\t{line} \r")) for line in lines]
        rows.append((rng.choice((None, i, i, i, i // 2)), "\n".join(lines)))
    return rows + [(1, None), (2, ""), *rows[:5]]


def digests(rows):
    return sorted(((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in rows), key=str)


@pytest.mark.parametrize("waiting,hot", [(20_000, 256), (0, 2)])
def test_against_brute_force(spark, monkeypatch, waiting, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = made(400, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = mark_lines(df, min_length=10, min_docs=4, waiting=waiting).collect()
    assert sorted((tuple(r) for r in got), key=str) == digests(brute(rows, 10, 4))
    kept = drop_lines(df, min_length=10, min_docs=4, waiting=waiting).collect()
    assert sorted(((r.doc_id, r.text or "") for r in kept), key=str) == sorted(((i, t) for i, _, _, t in brute(rows, 10, 4)), key=str)
    assert [r.doc_id for r in kept if r.text is None] == [1]


def test_one_line_fills_all_partitions(spark):
    line = "the very same licence line that all documents hold"
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{line}\nown line number "), "id", F.lit(f"\n  {line.upper()}\t")).alias("text"))
    got = mark_lines(df, waiting=50).groupBy("n_dropped").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 1), (2, 2999)]


def test_stream_leaves_edges_open():
    import pyarrow as pa

    rows = [(h, 0, i, b"r%d" % i, 1, b"l") for h, ids in ((1, (9, 8)), (2, (7, 6, 5, 5, 4)), (3, (3,)), (4, (9, 8, 7))) for i in ids]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["hi", "lo", "id", "row", "n_lines", "lines"])
    out = [r for part in _stream(3, 100)(iter([batch.slice(0, 4), batch.slice(4)])) for r in zip(part["hi"], part["id"], part["open"], part["lines"])]
    assert [r for r in out if r[0] == 1] == [(1, 9, True, b"l"), (1, 8, True, b"l")]  # the first run may have begun before
    assert [r for r in out if r[0] == 2] == [(2, 6, False, b"l"), (2, 5, False, b"l"), (2, 5, False, b"l"), (2, 4, False, b"l")]
    assert [r for r in out if r[0] == 3] == []
    assert [r for r in out if r[0] == 4] == [(4, 8, False, b"l"), (4, 7, False, b"l"), (4, 9, True, None), (4, 8, True, None), (4, 7, True, None)]


def test_keys_count_code_points():
    assert line_key(b" \x0b A\xc3\x84b \r") == "aÄb".encode()
    assert long_lines("\n".join(["ä" * 39, "ä" * 40, "a" * 39 + " ", "a" * 40]).encode(), 40)[1].values().__len__() == 2
    assert kept_text(b"a\nb", None) == b"a\nb"


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in mark_lines(odd, min_length=3, min_docs=2).collect()), key=str) == digests(brute(rows, 3, 2))
    kept = drop_lines(odd, min_length=3, min_docs=2)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert mark_lines(none).count() == 0 and drop_lines(none).count() == 0 and repeated_lines(none).count() == 0
