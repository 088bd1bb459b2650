"""Exact duplicates by compressed radix tries.

Rows are dealt out by text length and content hash.  A task inserts the whole
byte strings of its rows into a Patricia trie whose terminal nodes hold the
owner's identifier and a count.  The same trie runs before the shuffle, so a
text that a third of all rows share leaves each map task once.

A trie over its memory limit spills by subtree: the deepest node that holds
over half the limit, or else the root's heaviest children.  Before the shuffle
the subtree is handed on as it is (the other side adds it up), after it the
subtree goes to a file of the task and leaves a stub, to whose file later rows
below it are appended.  At the end each file gets a trie of its own that begins
where the stub ended, one after the other; its prefix is longer than that of
the trie it came from, so the files come to an end.  Rows and texts that went
in are compared with those that come out.
"""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, join_totals, map_batches, packed

NODE_BYTES = 300  # of a node besides its label
HELD_BYTES = 1 << 14  # of a spill file's records before they are written
EMIT_ROWS, EMIT_BYTES = 5_000, 16 << 20


class Node:
    __slots__ = ("best", "children", "label", "size", "spill", "ties")

    def __init__(self, label: bytes):
        self.label, self.children, self.spill = label, {}, None
        self.best, self.size, self.ties = None, 0, 0

    def merge(self, best, size: int, ties: int, first: Callable) -> None:
        if self.size == 0 or self.best is None and best is not None:
            self.best, self.ties = best, ties
        elif best == self.best:
            self.ties += ties
        elif best is not None and first(best, self.best) != self.best:
            self.best, self.ties = best, ties
        self.size += size


class Spill:
    """A file of records (text, best, size, ties) whose texts share their first ``skip`` bytes; it is open only while it is written to or read."""

    def __init__(self, folder: str, skip: int):
        self.path, self.skip, self.held = os.path.join(folder, uuid.uuid4().hex), skip, bytearray()

    def put(self, record: tuple) -> None:
        self.held += pickle.dumps(record)
        if len(self.held) > HELD_BYTES:
            self.flush()

    def flush(self) -> None:
        with open(self.path, "ab") as file:
            file.write(self.held)
        self.held = bytearray()

    def take(self) -> Iterator[tuple]:
        """All records; the file goes."""
        self.flush()
        with open(self.path, "rb") as file:
            os.unlink(self.path)
            while True:
                try:
                    yield pickle.load(file)
                except EOFError:
                    return


class Trie:
    """Owners of byte strings that begin with ``prefix``, which is not stored.

    ``evict`` writes subtrees to files in ``folder``, or yields their records
    if there is none.
    """

    def __init__(self, limit: int, first: Callable, folder: str | None, prefix: bytes = b""):
        self.root, self.limit, self.first, self.folder, self.prefix = Node(b""), limit, first, folder, prefix
        self.weight = self.texts = 0  # of what is held in memory
        self.spills: list[Spill] = []

    def add(self, text: bytes, best, size: int = 1, ties: int = 1) -> None:
        node, at, end = self.root, len(self.prefix), len(text)
        while at < end:
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.weight += end - at + NODE_BYTES
                node = child
                break
            if not text.startswith(child.label, at):
                shared = _shared(child.label, text, at)
                middle = Node(child.label[:shared])
                child.label = child.label[shared:]
                middle.children[child.label[0]] = child
                self.weight += NODE_BYTES + (shared if child.spill else 0)  # a stub weighs nothing, what is cut off it does
                node.children[text[at]] = child = middle
            elif child.spill is not None:
                child.spill.put((text, best, size, ties))
                return
            at += len(child.label)
            node = child
        self.texts += node.size == 0
        node.merge(best, size, ties, self.first)

    def overfull(self) -> bool:
        """One text is not cut further, however long it is."""
        return self.weight > self.limit and self.texts > 1

    def evict(self) -> Iterator[tuple]:
        """Spills subtrees until the trie is within its limit or holds one text."""
        while self.overfull():
            yield from self._evict_heaviest()

    def _evict_heaviest(self) -> Iterator[tuple]:
        weights: dict[int, int] = {}
        for node, _, done in _walk(self.root, b""):
            if done:
                weights[id(node)] = 0 if node.spill else len(node.label) + NODE_BYTES + sum(weights[id(c)] for c in node.children.values())

        def live(node):
            return sorted((c for c in node.children.values() if c.spill is None), key=lambda c: -weights[id(c)])

        parent, node, before = None, self.root, self.prefix
        while (below := live(node)) and weights[id(below[0])] > self.limit // 2:
            before = before + node.label
            parent, node = node, below[0]
        victims = [node] if parent else live(self.root)
        for victim in victims:
            if self.weight <= self.limit // 2:
                break
            self.weight -= weights[id(victim)]
            yield from self._spill(parent or self.root, victim, before)

    def _spill(self, parent: Node, victim: Node, before: bytes) -> Iterator[tuple]:
        old, stub = [], None
        if self.folder is not None:
            stub = Node(victim.label if victim.children else victim.label[:1])
            stub.spill = Spill(self.folder, len(before) + len(stub.label))
        for n, text, done in _walk(victim, before):
            if not done and n.spill is not None:
                old.append(n.spill)
            elif not done and n.size:
                self.texts -= 1
                record = (text, n.best, n.size, n.ties)
                if stub is None:
                    yield record
                else:
                    stub.spill.put(record)
        if stub is None:
            del parent.children[victim.label[0]]
            return
        for spill in old:
            self.spills.remove(spill)
            for record in spill.take():
                stub.spill.put(record)
        parent.children[victim.label[0]] = stub
        self.spills.append(stub.spill)

    def terminals(self) -> Iterator[tuple]:
        for node, text, done in _walk(self.root, self.prefix):
            if not done and node.size:
                yield text, node.best, node.size, node.ties

    def drain(self) -> Iterator[tuple]:
        """All owners; spilled subtrees come after, each from a trie of its own that may spill again."""
        yield from self.terminals()
        pending, self.root = self.spills, Node(b"")
        self.spills, self.weight, self.texts = [], 0, 0
        while pending:
            spill, part = pending.pop(), None
            for record in spill.take():
                part = part or Trie(self.limit, self.first, self.folder, record[0][: spill.skip])
                part.add(*record)
                if part.overfull():
                    for _ in part.evict():
                        pass
            if part is not None:
                yield from part.terminals()
                pending += part.spills


class Ledger:
    """Rows and texts that went into tries, less those that came out."""

    def __init__(self):
        self.rows = self.digest = 0

    def count(self, text: bytes, size: int) -> None:
        import xxhash

        self.rows += size
        self.digest += size * xxhash.xxh3_64_intdigest(text)

    def close(self) -> None:
        if self.rows or self.digest:
            raise RuntimeError(f"a trie lost rows or texts: {self.rows} rows, digest {self.digest}")


def _walk(top: Node, prefix: bytes) -> Iterator[tuple[Node, bytes, bool]]:
    """(node, its whole string, False) before and (node, b"", True) after its children, without recursion."""
    stack = [(top, prefix, False)]
    while stack:
        node, before, done = stack.pop()
        if done:
            yield node, b"", True
            continue
        text = before + node.label
        yield node, text, False
        stack.append((node, b"", True))
        stack += [(c, text, False) for c in node.children.values()]


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Length of the common start of ``label`` and ``text[at:]``, which is not all of ``label``."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def _first(keep: str) -> Callable:
    return min if keep == "smallest" else max


def _trie_pass(keep: str, limit: int, merged: bool) -> Callable:
    """Rows (length, sha, text, best[, size, ties]) to owners; ``merged``: after the shuffle, texts are not passed on."""

    def run(batches):
        import hashlib

        ledger = Ledger()

        def out(records):
            rows: list[tuple] = []
            weight = 0
            for text, best, size, ties in records:
                ledger.count(text, -size)
                rows.append((len(text), hashlib.sha256(text).digest(), None if merged else text, best, size, ties))
                weight += len(text)
                if len(rows) >= EMIT_ROWS or weight >= EMIT_BYTES:
                    yield dict(zip(("length", "sha", "text", "best", "size", "ties"), map(list, zip(*rows))))
                    rows, weight = [], 0
            if rows:
                yield dict(zip(("length", "sha", "text", "best", "size", "ties"), map(list, zip(*rows))))

        with tempfile.TemporaryDirectory() if merged else nullcontext() as folder:
            trie = Trie(limit, _first(keep), folder)
            for batch in batches:
                columns = batch.to_pydict()
                counts = zip(columns["size"], columns["ties"]) if merged else ((1, 1) for _ in columns["best"])
                for text, best, (size, ties) in zip(columns["text"], columns["best"], counts):
                    ledger.count(text, size)
                    trie.add(text, best, size, ties)
                    if trie.overfull():
                        yield from out(trie.evict())
            yield from out(trie.drain())
        ledger.close()

    return run


def _content(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memory_bytes: int = 128 << 20) -> DataFrame:
    """One row per distinct text: length, sha (of its UTF-8), keep_id, group_size, ties (rows that hold keep_id)."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(_content(F.col(f"`{text_col}`")).cast("binary").alias("text"), F.col(f"`{id_col}`").alias("best"))
    schema = f"length long, sha binary, text binary, best {kind}, size long, ties long"
    local = map_batches(rows, _trie_pass(keep, memory_bytes, False), schema)
    dealt = local.repartition("length", "sha").select("text", "best", "size", "ties")
    merged = map_batches(dealt, _trie_pass(keep, memory_bytes, True), schema)
    return cut_lineage(merged.select("length", "sha", F.col("best").alias("keep_id"), F.col("size").alias("group_size"), "ties"))


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memory_bytes: int = 128 << 20) -> DataFrame:
    """Every row's owner: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty.
    The smallest (or largest) id of equal texts owns them, nulls come last: a
    group has a null keep_id only if all its ids are null, and then each of its
    rows is kept.  Rows that repeat an id and a text are each marked.  Other
    columns are ignored, an empty table gives an empty result.
    """
    owned = owners(df, id_col, text_col, keep, memory_bytes)
    content = _content(F.col(f"`{text_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.octet_length(content).cast("long").alias("length"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("sha"))
    joined = join_totals(rows, owned, ["length", "sha"], "group_size")
    return joined.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memory_bytes: int = 128 << 20) -> DataFrame:
    """The rows that own their text, with all columns of ``df``; of rows that repeat id and text one stays."""
    owned = owners(df, id_col, text_col, keep, memory_bytes)
    content = _content(F.col(f"`{text_col}`"))
    rows = df.select(packed(df).alias("row"), F.col(f"`{id_col}`").alias("_id"), F.octet_length(content).cast("long").alias("length"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("sha"))
    kept = join_totals(rows, owned, ["length", "sha"], "group_size").filter(F.col("_id").eqNullSafe(F.col("keep_id")))
    if owned.filter("ties > 1").isEmpty():
        return kept.select("row.*")
    several = kept.filter("ties > 1").groupBy("length", "sha").agg(F.first("row").alias("row"))
    return kept.filter("ties = 1").select("row").unionByName(several.select("row")).select("row.*")
