"""MD5 of files too large for one task: splits are read in order, each task hands the digest's state on."""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Callable, Iterator
from ctypes.util import find_library
from functools import cache

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import RDD
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 1024 * 1024
#: Spark's line reader leaves it out at the start of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


class _Context(ctypes.Structure):
    """MD5_CTX of OpenSSL's md5.h."""

    _fields_ = [("abcd", ctypes.c_uint32 * 4), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint)]


@cache
def openssl() -> ctypes.CDLL | None:
    """The OpenSSL behind Python's hashlib; None if its MD5 cannot be called."""
    for name in (getattr(sys.modules.get("_hashlib"), "__file__", None), find_library("crypto")):
        try:
            lib = ctypes.CDLL(name) if name else None
        except OSError:
            continue
        if all(hasattr(lib, f) for f in ("MD5_Init", "MD5_Update", "MD5_Final")):
            lib.MD5_Update.argtypes = [ctypes.POINTER(_Context), ctypes.c_char_p, ctypes.c_size_t]
            return lib
    return None


class ResumableMd5:
    """MD5 that goes on from another one's state, which hashlib does not give away."""

    def __init__(self, state: bytes | None = None):
        self._context = _Context.from_buffer_copy(state) if state else _Context()
        if not state:
            openssl().MD5_Init(ctypes.byref(self._context))

    def update(self, data: bytes) -> None:
        openssl().MD5_Update(ctypes.byref(self._context), data, len(data))

    def state(self) -> bytes:
        return bytes(self._context)

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(16)
        openssl().MD5_Final(out, ctypes.byref(self._context))
        return out.raw.hex()


def of_head(spark: SparkSession, path: str, length: int, of: Callable):
    """A function of the first megabyte of a file of this length; at most its first split is read.

    None for names that Spark does not split (suffixes of compressed files) or takes for several.
    """
    if any(c in path for c in ",{}[]*?\\"):
        return None
    try:
        return spark.sparkContext.binaryRecords(path, min(length, HEAD_BYTES)).map(of).first()
    except Py4JJavaError:
        return None


def head_md5(spark: SparkSession, files: dict[str, int]) -> dict[str, str]:
    """MD5 of the first megabyte of files (path → length); names that Spark does not split are missing."""
    found = {p: of_head(spark, p, n, lambda b: hashlib.md5(b).hexdigest()) for p, n in files.items()}
    return {p: md5 for p, md5 in found.items() if md5}


def _shape(head: bytes) -> tuple[bytes, bytes]:
    """The byte order mark if there is one, and the byte to split at: a line feed, without one the commonest of ASCII."""
    counts = np.bincount(np.frombuffer(head, np.uint8), minlength=256)[:128]
    mark = BYTE_ORDER_MARK if head.startswith(BYTE_ORDER_MARK) else b""
    return mark, b"\n" if counts[ord("\n")] else bytes([counts.argmax()])


def _pieces(spark: SparkSession, path: str, at: bytes) -> RDD:
    """(start of the first line's block, of the last one's, lines in one piece), a partition for each split."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch["start"].to_numpy()
            if len(starts):
                if np.any(np.diff(starts) < 0):
                    raise RuntimeError("blocks of a file come out of order")
                piece = at.join(batch["line"].to_pylist())
                yield pa.RecordBatch.from_pydict({"first": starts[:1], "last": starts[-1:], "piece": pa.array([piece], pa.binary())})

    lines = spark.read.option("lineSep", at.decode()).text(path)
    lines = lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("start"))
    return lines.mapInArrow(joined, "first long, last long, piece binary").rdd


def _advanced(states: dict[int, tuple]) -> Callable:
    """For partition number → (byte between lines, digest state, bytes so far, start of the last block): the last three after that partition."""

    def run(number, pieces):
        at, state, size, block = states[number]
        md5 = ResumableMd5(state)
        for first, last, piece in pieces:
            if first < block:
                raise RuntimeError("splits of a file come out of order")
            if block >= 0:
                md5.update(at)
                size += 1
            md5.update(bytes(piece))
            size, block = size + len(piece), last
        yield number, (md5.state(), size, block)

    return run


def chained_md5(spark: SparkSession, files: dict[str, int]) -> dict[str, str]:
    """MD5 of large files (path → length), all files side by side and each one split after split.

    An MD5 is taken in order, so a file takes as long as one core needs for it,
    but no task reads more than a split (``spark.sql.files.maxPartitionBytes``,
    longer if a line is).  Only a state of 92 bytes for each file passes the
    driver.  Files that Spark does not split, or whose lines do not add up to
    their length, are missing in the answer.
    """
    shapes = {p: of_head(spark, p, n, _shape) for p, n in files.items()} if openssl() else {}
    parts = {p: _pieces(spark, p, shape[1]) for p, shape in shapes.items() if shape}
    if not parts:
        return {}
    states, ends, total = {}, {}, 0
    for path, rdd in parts.items():
        mark, md5 = shapes[path][0], ResumableMd5()
        md5.update(mark)
        states[path] = (total, (md5.state(), len(mark), -1))
        total += rdd.getNumPartitions()
        ends[path] = total
    every = spark.sparkContext.union(list(parts.values()))
    while now := {number: path for path, (number, _) in states.items() if number < ends[path]}:
        step = every.mapPartitionsWithIndex(_advanced({number: (shapes[path][1], *states[path][1]) for number, path in now.items()}))
        for number, state in spark.sparkContext.runJob(step, list, sorted(now)):
            states[now[number]] = (number + 1, state)
    found = {}
    for path, (_, (state, size, _)) in states.items():
        md5 = ResumableMd5(state)
        if size + 1 == files[path]:  # the last line is ended
            md5.update(shapes[path][1])
            size += 1
        if size == files[path]:
            found[path] = md5.hexdigest()
    return found
