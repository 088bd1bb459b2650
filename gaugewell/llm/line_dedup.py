"""Repeated lines by range-partitioned hashes.

Each document sends, for each of its long lines, the hash of the line's key
with the document and the line numbers; no text moves.  Rows are range
partitioned on (hash, document), so a line that very many documents hold covers
several partitions, and sorted there by hash, document and position.  A task
streams over the runs of equal hashes: the first document of a run keeps its
lines, the others lose theirs as soon as the run has enough documents.  Runs
that touch an edge of their partition, or wait for too many rows, are left open
and settled by a count over the open rows alone.  What comes out are
compressed bitmaps of the lines that each document keeps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, hot_keys, map_batches, packed, row_key, salted_join, shuffle_partitions

BLANKS = b" \t\n\x0b\x0c\r"
MIN_LENGTH, MIN_DOCS = 40, 5
WAITING = 20_000  # rows of a run held in memory until it has enough documents
EMIT_ROWS = 50_000


def line_key(line: bytes) -> bytes:
    """The line without ASCII blanks around it, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def _long(key: bytes, least: int) -> bool:
    """Whether a key has ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def long_lines(raw: bytes, least: int = MIN_LENGTH) -> tuple[int, dict[bytes, list[int]]]:
    """(number of lines, the 128-bit hash of each long line's key with the numbers of its lines)."""
    import xxhash

    lines = raw.split(b"\n")
    found: dict[bytes, list[int]] = {}
    for number, line in enumerate(lines):
        if len(line) >= least and _long(key := line_key(line), least):
            found.setdefault(xxhash.xxh3_128_digest(key), []).append(number)
    return len(lines), found


def _hash_rows(least: int):
    """id, row, text to (hi, lo, id, row, n_lines, lines); rows that repeat id and text leave a task once."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            digests, source, counts, lines = [], [], [], []
            rows = batch.column(1).to_pylist()

            def out(digests=digests, source=source, counts=counts, lines=lines, batch=batch):
                words = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                take = pa.array(source, pa.int64())
                return {"hi": words[:, 0], "lo": words[:, 1], "id": batch.column(0).take(take), "row": batch.column(1).take(take), "n_lines": counts, "lines": lines}

            for i, row in enumerate(rows):
                if row in seen:
                    continue
                seen.add(row)
                n, found = long_lines(batch.column(2)[i].as_py(), least)
                digests += found
                source += [i] * len(found)
                counts += [n] * len(found)
                lines += [np.array(v, "<u4").tobytes() for v in found.values()]
                if len(digests) >= EMIT_ROWS:
                    yield out()
                    for column in (digests, source, counts, lines):
                        column.clear()
            yield out()

    return run


COLUMNS = ("hi", "lo", "id", "row", "n_lines", "lines")


def _stream(min_docs: int, waiting: int):
    """Sorted rows to rows that are dropped (``open`` false) and rows not settled here (``open`` true).

    An open row without ``lines`` only says that the document holds the line.
    """

    def run(batches) -> Iterator[dict]:
        out: dict[str, list] = {c: [] for c in (*COLUMNS, "open")}

        def put(row, is_open):
            for c, v in zip(COLUMNS, row):
                out[c].append(v)
            out["open"].append(is_open)

        now, first, ids, held, state = None, None, [], [], "open"  # the partition's first run is open from the start
        runs = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for row in zip(*columns):
                if row[:2] != now:
                    # the run before is complete: too few documents, nothing goes
                    now, first, held, ids = row[:2], row[2], [], [row[2]]
                    runs += 1
                    state = "open" if runs == 1 else "waiting"
                elif len(ids) < min_docs and row[2] != ids[-1]:
                    ids.append(row[2])
                if state == "open":
                    put(row, True)
                    continue
                if state == "waiting":
                    held.append(row)
                    if len(ids) >= min_docs:
                        state = "dropping"
                        for r in held:
                            if r[2] != first:
                                put(r, False)
                        held = []
                    elif len(held) > waiting:
                        state = "open"
                        for r in held:
                            put(r, True)
                        held = []
                elif row[2] != first:
                    put(row, False)
            if len(out["open"]) >= EMIT_ROWS:
                yield out
                out = {c: [] for c in out}
        if state == "waiting":
            for r in held:
                put(r, True)
        elif state == "dropping":  # goes on in the next partition, perhaps
            for i in ids:
                put((*now, i, None, None, None), True)
        yield out

    return run


def _bitmaps(batches):
    for batch in batches:
        out: dict[str, list] = {"row": batch.column(0), "n_dropped": [], "keep": []}
        for n, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(lines), "<u4")] = False
            out["n_dropped"].append(int(n - keep.sum()))
            out["keep"].append(zlib.compress(np.packbits(keep).tobytes()))
        yield out


def _content(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, waiting: int = WAITING) -> DataFrame:
    """row (digest of id and text), n_dropped, keep (zlib of packed bits, a bit for each line) of every document that loses lines.

    A line's key is the line without ASCII blanks at its ends, A-Z lower-cased.
    A key of ``min_length`` code points or more that ``min_docs`` documents hold
    stays in the document of the largest id only, with all its lines there.
    Documents are told apart by their id: rows of one id and different texts
    are parts of one document, rows that repeat id and text have one bitmap,
    rows without an id are one document that comes after all others.  Null and
    empty texts have one empty line, which is never long.  Other columns are
    ignored, an empty table gives an empty result.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), row_key(df, id_col, text_col).alias("row"), _content(F.col(f"`{text_col}`")).alias("t"))
    hashed = map_batches(rows, _hash_rows(min_length), f"hi long, lo long, id {kind}, row binary, n_lines int, lines binary")
    order = ["hi", "lo", F.desc_nulls_last("id")]
    dealt = hashed.repartitionByRange(shuffle_partitions(df), *order, "row").sortWithinPartitions(*order, "row")
    settled = cut_lineage(map_batches(dealt, _stream(min_docs, waiting), f"hi long, lo long, id {kind}, row binary, n_lines int, lines binary, open boolean"))
    left = settled.filter("open")
    docs = left.groupBy("hi", "lo", "id").agg(F.count("lines").alias("n"))
    sums = docs.groupBy("hi", "lo").agg(F.count("*").alias("docs"), F.max("id").alias("best"), F.sum("n").alias("n")).filter(F.col("docs") >= min_docs)
    sums = cut_lineage(sums)
    open_rows = left.filter("lines is not null")
    hot = hot_keys(open_rows, sums, ["hi", "lo"], "n")
    joined = open_rows.join(sums, ["hi", "lo"]) if hot is None else salted_join(open_rows, sums, ["hi", "lo"], hot)
    later = joined.filter(~F.col("id").eqNullSafe(F.col("best")))
    dropped = settled.filter("not open").select("row", "n_lines", "lines").unionByName(later.select("row", "n_lines", "lines"))
    grouped = dropped.groupBy("row").agg(F.first("n_lines").alias("n_lines"), F.collect_set("lines").alias("lines"))
    return map_batches(grouped, _bitmaps, "row binary, n_dropped long, keep binary")


def kept_text(raw: bytes, keep: bytes | None) -> bytes:
    """The lines whose bit is set, joined by line ends; no bitmap keeps all."""
    if keep is None:
        return raw
    lines = raw.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return b"\n".join([line for line, bit in zip(lines, bits.tolist()) if bit])


def _with_bitmaps(df: DataFrame, id_col: str, text_col: str, rows: DataFrame, **how) -> DataFrame:
    """``rows`` (with a column row) and the columns n_dropped and keep, null where nothing goes; rows that repeat very often are salted."""
    maps = cut_lineage(repeated_lines(df, id_col, text_col, **how))
    copies = df.select(row_key(df, id_col, text_col).alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    hot = hot_keys(rows, copies, ["row"], "n")
    return rows.join(maps, "row", "left") if hot is None else salted_join(rows, maps, ["row"], hot, "left")


def mark_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id_col, n_lines (before dropping), n_dropped, kept_sha256 (of the lines that stay, joined) of every row; see ``repeated_lines``."""
    import hashlib

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield {
                id_col: batch.column(0),
                "n_lines": [t.count(b"\n") + 1 for t in texts],
                "n_dropped": batch.column(2).fill_null(0),
                "kept_sha256": [hashlib.sha256(kept_text(t, k)).hexdigest() for t, k in zip(texts, batch.column(3).to_pylist())],
            }

    rows = df.select(F.col(f"`{id_col}`").alias("id"), row_key(df, id_col, text_col).alias("row"), _content(F.col(f"`{text_col}`")).alias("t"))
    joined = _with_bitmaps(df, id_col, text_col, rows, **how)
    return map_batches(joined.select("id", "t", "n_dropped", "keep"), run, f"`{id_col}` {kind}, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All rows with all their columns, the text without the dropped lines; a null text stays null."""
    rows = df.select(packed(df).alias("all"), row_key(df, id_col, text_col).alias("row"), F.col(f"`{text_col}`").cast("string").alias("t"))
    joined = _with_bitmaps(df, id_col, text_col, rows, **how)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, keeps: pd.Series) -> pd.Series:
        return texts.combine(keeps, lambda t, k: t if t is None or k is None else kept_text(t.encode(), bytes(k)).decode())

    text = F.when(F.col("keep").isNull(), F.col("t")).otherwise(kept("t", "keep"))
    names = [F.col("text").alias(c) if c == text_col else F.col(f"all.`{c}`").alias(c) for c in df.columns]
    return joined.withColumn("text", text).select(*names)
