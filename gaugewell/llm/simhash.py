"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint is cut into segments.  If two fingerprints differ in fewer bits
than there are segments, some segment is equal and the next one (cyclically)
differs in two bits at most: were each equal segment followed by one with three
errors or more, the errors would reach the number of segments.  Two words
within two bits have a word within one bit of both, so decoding a segment and
all its one-bit neighbours with the perfect [23, 12] Golay code gives sets of
codeword indices that meet.  A key is (segment number, its bits, one codeword
index of the next segment): several keys for each fingerprint, and every pair
within the radius shares one.

Equal fingerprints are one node.  Keys are sorted, a task streams over the runs
of equal keys and verifies the members of a run against each other while they
are few; a run that grows beyond ``run_limit`` is passed on unread, and its
members are linked through the words within one bit of them, of which no word
has more than bits + 1 owners.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, join_totals, map_batches, packed, row_key
from gaugewell.llm.components import components

GENERATOR = 0b110001110101  # x^11+x^10+x^6+x^5+x^4+x^2+1
SLICE = 1 << 15  # shingles whose bits are counted at once


def shingles(raw: bytes, size: int) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, ``size`` at a time; fewer words: all of them; none: none."""
    words = raw.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends - 1)[size - 1 :].tolist())]


def fingerprint(raw: bytes, size: int, seed: int = 42) -> bytes:
    """64 bits: a bit is set if it is in over half the hashes of the shingles, repeats included."""
    import xxhash

    parts = shingles(raw, size)
    digest = partial(xxhash.xxh64_digest, seed=seed)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(parts), SLICE):
        hashes = np.frombuffer(b"".join(map(digest, parts[at : at + SLICE])), np.uint8)
        counts += np.unpackbits(hashes).reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(parts)).tobytes()


def fingerprints(df: DataFrame, id_col: str, text_col: str, size: int, seed: int) -> DataFrame:
    """id, row_key, fp (big-endian bytes) of every row; null and empty texts have all bits zero."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield {"id": batch.column(0), "row_key": batch.column(1), "fp": [fingerprint(t, size, seed) for t in batch.column(2).to_pylist()]}

    rows = df.select(F.col(f"`{id_col}`").alias("id"), row_key(df, id_col, text_col).alias("row_key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("t"))
    return map_batches(rows, run, f"id {kind}, row_key binary, fp binary")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each 12 high bits, coset leader of each syndrome); the 11 low bits are their own syndrome."""
    high = np.arange(1 << 12, dtype=np.uint32) << 11
    for bit in range(22, 10, -1):
        high = np.where(high >> bit & 1, high ^ (GENERATOR << bit - 11), high)
    leader = np.zeros(1 << 11, np.uint32)
    ones = [1 << i for i in range(23)]
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                e = ones[a] | ones[b] | ones[c]
                leader[int(high[e >> 11]) ^ e & 0x7FF] = e
    return high, leader


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the Golay codeword within three bits of each 23-bit word."""
    high, leader = _golay()
    words = words.astype(np.uint32)
    return (words ^ leader[high[words >> 11] ^ (words & 0x7FF)]) >> 11


def segment_values(prints: np.ndarray, segments: int) -> tuple[list[np.ndarray], list[int]]:
    """The segments of an n × bytes matrix as numbers, and their widths (23 bits at most)."""
    bits = np.unpackbits(prints, axis=1)
    cuts = np.linspace(0, bits.shape[1], segments + 1).round().astype(int)
    widths = np.diff(cuts).tolist()
    if max(widths) > 23 or min(widths) < 1:
        raise ValueError("segments must have 1 to 23 bits")
    values = [bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a - 1, -1, -1, dtype=np.int64)) for a, b in zip(cuts[:-1], cuts[1:])]
    return values, widths


def golay_keys(prints: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every distinct key of each fingerprint."""
    values, widths = segment_values(prints, segments)
    rows, keys = [], []
    for i in range(segments):
        j = (i + 1) % segments
        flips = np.concatenate(([0], 1 << np.arange(widths[j], dtype=np.int64)))
        index = np.sort(codeword_index(values[j][:, None] ^ flips[None, :]).astype(np.int64), axis=1)
        new = np.concatenate((np.ones((len(index), 1), bool), np.diff(index, axis=1) != 0), axis=1)
        row, place = np.nonzero(new)
        rows.append(row)
        keys.append((np.int64(i) << 35 | values[i][row]) << 12 | index[row, place])
    return np.concatenate(rows), np.concatenate(keys)


def _matrix(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)


def _words(prints: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(prints).view(">u8").astype(np.uint64)


def _emit_keys(segments: int) -> Callable:
    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_pylist()
            if prints:
                row, key = golay_keys(_matrix(prints), segments)
                for at in range(0, len(row), 1 << 18):
                    yield {"key": key[at : at + (1 << 18)], "fp": [prints[r] for r in row[at : at + (1 << 18)].tolist()]}

    return run


def runs_of(batches: Iterator, key: str) -> Iterator[tuple[object, list[dict]]]:
    """(key, pieces) of each run in batches sorted by key; a run comes in pieces of one batch each."""
    for batch in batches:
        columns = batch.to_pydict()
        keys = np.asarray(columns[key])
        if len(keys) == 0:
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            yield keys[a], {c: v[a:b] for c, v in columns.items()}


def _links_of(members: list[bytes], radius: int) -> list[tuple[bytes, bytes]]:
    """(member, smallest member of its component) inside one run."""
    members = sorted(set(members))
    n = len(members)
    if n < 2:
        return []
    words = _words(_matrix(members))
    near = np.empty((n, n), bool)
    for at in range(0, n, 256):
        near[at : at + 256] = np.bitwise_count(words[at : at + 256, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int32) <= radius
    labels = np.arange(n)
    while True:
        least = np.where(near, labels[None, :], n).min(axis=1)
        if (least == labels).all():
            break
        labels = least
    return [(members[i], members[x]) for i, x in enumerate(labels.tolist()) if x != i]


def _emit_links(radius: int, limit: int) -> Callable:
    """Sorted (key, fp) to links (a, b); members of a run over the limit come out as (key, a, null)."""

    def run(batches):
        now, members, over, out = None, [], False, ([], [], [])

        def put(key, a, b):
            for column, value in zip(out, (key, a, b)):
                column.append(value)

        def close():
            for a, b in _links_of(members, radius):
                put(now, a, b)

        for key, piece in runs_of(batches, "key"):
            if key != now:
                close()
                now, members, over = key, [], False
            members += piece["fp"]
            if over or len(members) > limit:
                over = True
                for m in members:
                    put(now, m, None)
                members = []
            if len(out[0]) >= 50_000:
                yield dict(zip(("key", "a", "b"), out))
                out = ([], [], [])
        close()
        yield dict(zip(("key", "a", "b"), out))

    return run


def _run_links(keys: DataFrame, radius: int, limit: int) -> DataFrame:
    return map_batches(keys.repartition("key").sortWithinPartitions("key"), _emit_links(radius, limit), "key long, a binary, b binary")


def _midpoints(batches):
    """(word, fp) for a fingerprint and its one-bit neighbours."""
    for batch in batches:
        prints = batch.column(0).to_pylist()
        for p in prints:
            value, size = int.from_bytes(p, "big"), len(p)
            words = [p, *((value ^ 1 << i).to_bytes(size, "big") for i in range(8 * size))]
            yield {"word": words, "fp": [p] * len(words)}


def link_fingerprints(prints: DataFrame, radius: int = 2, segments: int | None = None, run_limit: int = 256) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) whose components are those of all pairs within ``radius`` bits (2 at most)."""
    if radius not in (0, 2):
        raise ValueError("the exact way for crowded keys is for radius 2")
    found = cut_lineage(_run_links(map_batches(prints.select("fp"), _emit_keys(segments or radius + 1), "key long, fp binary"), radius, run_limit))
    links = found.filter("b is not null").select("a", "b")
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if radius == 0 or crowded.isEmpty():
        return links
    owners = map_batches(crowded, _midpoints, "word binary, fp binary")
    stars = owners.groupBy("word").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    return links.unionByName(stars.select(F.explode("all").alias("a"), "b").filter("a != b").distinct())


def fingerprint_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42, radius: int = 2, run_limit: int = 256) -> DataFrame:
    """id_col, fingerprint (lower-case hex), component_id of every row.

    Documents link when their fingerprints differ in ``radius`` bits or fewer;
    component_id is the smallest id reachable.  Null and empty texts have
    fingerprint zero and link like any other.  Null ids take part, they only
    count as smallest where a whole component has no other id.  Repeated rows
    come out repeated; other columns are ignored; no rows give no rows.
    """
    prints = cut_lineage(fingerprints(df, id_col, text_col, size, seed).select("id", "fp"))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    roots = cut_lineage(components(link_fingerprints(nodes, radius, run_limit=run_limit)))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sums = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = cut_lineage(join_totals(rooted, sums, ["root"], "members").select("fp", "n", "component_id"))
    return join_totals(prints, named, ["fp"], "n").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42, radius: int = 2, run_limit: int = 256) -> DataFrame:
    """One row of each group of ``fingerprint_groups``, with all columns: that of the smallest id.

    Of several rows with that id the one whose id and text have the smallest
    digest stays, repeated rows leave one; a group without ids keeps the
    smallest digest.  Null and empty texts are one group.  An empty table
    stays empty.
    """
    prints = cut_lineage(fingerprints(df, id_col, text_col, size, seed))
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row_key").alias("row_key"))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min(first).alias("first")))
    roots = components(link_fingerprints(nodes, radius, run_limit=run_limit))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.row_key")
    copies = prints.groupBy("row_key").agg(F.count("*").alias("n"))
    chosen = cut_lineage(chosen.join(copies, "row_key"))
    rows = df.select(packed(df).alias("row"), row_key(df, id_col, text_col).alias("row_key"))
    kept = join_totals(rows, chosen, ["row_key"], "n")
    if chosen.filter("n > 1").isEmpty():
        return kept.select("row.*")
    several = kept.filter("n > 1").groupBy("row_key").agg(F.first("row").alias("row"))
    return kept.filter("n = 1").select("row").unionByName(several.select("row")).select("row.*")
