import gzip
import hashlib
import random

import pytest

from gaugewell.sources import files, splits

NOISE = random.Random(5).randbytes(400_000)
MARK = b"\xef\xbb\xbf"
#: Files over the length that may be read whole.
LARGE = {
    "noise.bin": NOISE,
    "mark.bin": MARK + NOISE[:120_000],
    "mark_alone.bin": MARK + b"\n" + NOISE[:90_000] + b"\n",
    "ended.txt": "añb\r\n".encode() * 20_000,
    "not_ended.txt": b"abc\n" * 25_000 + b"x",
    "feeds.txt": b"\n" * 60_000 + b"\r\r",
    "one_line.json": b'{"a": 1}, ' * 9_000,
    "sub dir/p %20 é.bin": NOISE[7:100_000],
}
SMALL = {"a.bin": NOISE[:20_000], "a,[1].bin": NOISE[3:25_000], "zip.csv.gz": gzip.compress(NOISE[:24_000]), "b.csv.gz": b"a,b\n" * 6_000}


@pytest.fixture
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "40000", "spark.sql.files.openCostInBytes": "0", "spark.sql.sources.binaryFile.maxLength": "30000"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_files_over_what_a_task_reads(spark, tmp_path, small_splits):
    """No file over 30 000 bytes may be read whole; those Spark does not split are, up to that."""
    given = LARGE | SMALL
    for name, content in given.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for head_only, whole_bytes in ((False, 25_000), (True, 25_000), (False, 10_000), (True, 10_000)):
        rows = files.file_fingerprints(spark, str(tmp_path), head_only, whole_bytes).collect()
        got = {r["path"].removeprefix(f"file:{tmp_path}/"): r["md5"] for r in rows}
        assert len(rows) == len(given) and got == {k: hashlib.md5(v).hexdigest() for k, v in given.items()}
    sizes = splits._pieces(spark, f"file:{tmp_path}/noise.bin", b"\n").mapPartitions(lambda rows: [sum(len(r["piece"]) for r in rows)]).collect()
    assert len(sizes) >= 10 and max(sizes) < 45_000


def test_head_is_one_megabyte(spark, tmp_path):
    content = NOISE * 6
    (tmp_path / "x.bin").write_bytes(content)
    for whole_bytes in (files.WHOLE_BYTES, 1_000):
        (row,) = files.file_fingerprints(spark, str(tmp_path), True, whole_bytes).collect()
        assert row["md5"] == hashlib.md5(content[: 1 << 20]).hexdigest()


def test_resumable_md5():
    state = None
    for i in range(0, len(NOISE), 777):
        md5 = splits.ResumableMd5(state)
        md5.update(NOISE[i : i + 777])
        state = md5.state()
    assert len(state) == 92 and splits.ResumableMd5(state).hexdigest() == hashlib.md5(NOISE).hexdigest()
    assert splits.ResumableMd5().hexdigest() == hashlib.md5().hexdigest()
