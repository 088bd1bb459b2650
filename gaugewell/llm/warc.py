"""WARC archives with a Zstandard dictionary.

The dictionary is trained on a bounded sample of the records.  Every archive
starts with a skippable frame that holds the dictionary (compressed), then each
record is a frame of its own, so one can be read without the others.  Tasks
write archives of a bounded size to a folder all machines reach; only those
that the written manifest names count, files of failed attempts are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import struct
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.common import cut_lineage, join_totals, low_hash, map_batches, scratch_path

MAGIC = 0x184D2A5D  # skippable frame of a dictionary
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space of URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 800, 32 << 10, 110 << 10
ARCHIVE_BYTES = 256 << 20
EPOCH = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record_uri(ident: str | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{ident} {sha1}')}>"


def record(ident: str | None, url: str | None, payload: bytes, sha1: str, refers_to: str | None, revisit: bool, date: str = EPOCH) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_uri(ident, sha1)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if ident is not None:
        lines.append(f"WARC-Page-ID: {_clean(ident)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to, sha1)}", f"WARC-Refers-To-Page-ID: {_clean(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; from too few samples to train on, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[: 64 << 10]


def dictionary_frame(dictionary: bytes) -> bytes:
    import zstandard

    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", MAGIC, len(body)) + body


def read_dictionary(file) -> bytes:
    import zstandard

    magic, size = struct.unpack("<II", file.read(8))
    if magic != MAGIC:
        raise ValueError("the archive does not start with a dictionary frame")
    return zstandard.ZstdDecompressor().decompress(file.read(size))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _typed(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """id, url, payload, size, sha (hex), owner (smallest id of that payload) and whether a row revisits it."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload")).withColumn("mix", F.xxhash64("payload"))
    owners = cut_lineage(rows.groupBy("size", "sha", "mix").agg(F.min("id").alias("owner"), F.count("*").alias("n")))
    revisit = (F.col("size") >= least_bytes) & F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))
    return join_totals(rows, owners, ["size", "sha", "mix"], "n").withColumn("revisit", revisit)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, level: int = 6, archive_bytes: int = ARCHIVE_BYTES, date: str = EPOCH) -> DataFrame:
    """Writes a record for every row and returns the manifest: file, records, bytes.

    A row whose payload (at least ``least_bytes`` long) is also that of a
    smaller id is a revisit of the smallest, any other a response; rows that
    repeat the smallest id are responses, and so is a payload's every row if
    all its ids are null.  A null id beside others revisits.  A null payload is
    empty, a null url is ``about:blank``.  Other columns are ignored; no rows
    write no archive.
    """
    spark = pages.sparkSession
    typed = _typed(pages, id_col, url_col, payload_col, least_bytes)
    chosen = pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    chosen = chosen.filter(F.octet_length("payload") <= SAMPLE_BYTES).withColumn("h", F.xxhash64("id", "url"))
    chosen = chosen.filter(low_hash(F.col("h"), SAMPLE_RECORDS, pages.count()))
    chosen = chosen.groupBy("h").agg(F.first("id").alias("id"), F.first("url").alias("url"), F.first("payload").alias("payload")).orderBy("h").limit(SAMPLE_RECORDS)
    samples = [record(r["id"], r["url"], body := r["payload"].encode(), digest(body), None, False, date) for r in chosen.collect()]
    dictionary = spark.sparkContext.broadcast(train_dictionary(samples))

    def run(batches):
        import zstandard

        fs, top = _filesystem(folder)
        fs.create_dir(top, recursive=True)
        words = zstandard.ZstdCompressionDict(dictionary.value)
        packer = zstandard.ZstdCompressor(level=level, dict_data=words)
        file, name, records, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            columns = batch.to_pydict()
            for ident, url, payload, sha, owner, revisit in zip(*(columns[c] for c in ("id", "url", "payload", "sha", "owner", "revisit"))):
                if file is None:
                    name, records, size = f"part-{uuid.uuid4().hex}.warc.zst", 0, 0
                    file = fs.open_output_stream(posixpath.join(top, name), compression=None)
                    size += file.write(dictionary_frame(dictionary.value))
                sha1 = base64.b32encode(bytes.fromhex(sha)).decode()
                size += file.write(packer.compress(record(ident, url, payload, sha1, owner, revisit, date)))
                records += 1
                if size >= archive_bytes:
                    file.close()
                    done.append((name, records, size))
                    file = None
        if file is not None:
            file.close()
            done.append((name, records, size))
        yield dict(zip(("file", "records", "bytes"), map(list, zip(*done)) if done else [[]] * 3))

    rows = typed.select(F.col("id").cast("string").alias("id"), "url", "payload", "sha", F.col("owner").cast("string").alias("owner"), "revisit")
    return cut_lineage(map_batches(rows, run, "file string, records long, bytes long"))


def parse(stream) -> "list[tuple[dict[str, str], bytes]]":
    """(headers, block) of each record of an unpacked archive."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it says")
        yield headers, block


def read_archives(manifest: DataFrame, folder: str, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits) of each record of the manifest's archives.

    The digest of every response is computed anew; a difference is an error.
    """

    def run(batches):
        import zstandard

        fs, top = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(posixpath.join(top, name), compression=None) as file:
                    words = zstandard.ZstdCompressionDict(read_dictionary(file))
                    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=words).stream_reader(file, read_across_frames=True), 1 << 20)
                    out: dict[str, list] = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
                    weight = 0
                    for headers, block in parse(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        kind, sha1 = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (len(payload) != length or digest(payload) != sha1):
                            raise ValueError(f"{name}: the payload of {headers['WARC-Record-ID']} has another digest")
                        for c, v in zip(out, (headers.get("WARC-Page-ID"), length, sha1, kind, headers.get("WARC-Refers-To-Page-ID"), payload if with_payload and kind == "response" else None)):
                            out[c].append(v)
                        weight += len(block)
                        if weight >= 16 << 20:
                            yield out
                            out, weight = {c: [] for c in out}, 0
                    yield out

    files = manifest.select("file")
    found = map_batches(files.repartition(max(1, min(files.count(), 10_000)), "file"), run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    found = found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
    return found if with_payload else found.drop("payload")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives to the cluster's shared folder and reads them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, id_col, url_col, payload_col)
    return read_archives(manifest, folder, pages.schema[id_col].dataType.simpleString()).withColumnRenamed("page_id", id_col)
