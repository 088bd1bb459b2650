import base64
import hashlib
import io
import os

import pytest
import zstandard

from gaugewell.llm import common
from gaugewell.llm.warc import MAGIC, archive_pages, parse, read_archives, read_dictionary, write_archives

PAGES = [(i, f"http://h/{i}", f"<html>{'page ' * (i % 7)}{i % 9}</html>") for i in range(200)] + [(500, None, None), (501, "a\nb ☃", ""), (None, "u", "<html>lonely</html>"), (None, "u", "<html>lonely</html>"), (None, "u", PAGES_TEXT := "<html>0</html>"), (7, "again", "ünï\r\n\r\nWARC/1.1\r\n"), (502, "x", "long " * 50_000), (3, "http://h/3", "<html>page page page 3</html>")]


def brute(rows):
    least = {}
    for i, _, t in rows:
        least[t or ""] = min((x for x in (least.get(t or ""), i) if x is not None), default=None)
    out = []
    for i, _, t in rows:
        body, owner = (t or "").encode(), least[t or ""]
        own = owner is None or i == owner
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else owner))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in PAGES], "page_id long, url string, html string, size string, owner string").repartition(3)


def test_round_trip(pages, monkeypatch):
    wanted = brute(PAGES)
    for hot in (10_000, 3):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        assert sorted(map(tuple, archive_pages(pages).collect()), key=repr) == wanted
    assert archive_pages(pages.filter("false")).collect() == []


def test_payloads_and_frames(pages, tmp_path):
    folder = str(tmp_path)
    manifest = write_archives(pages, folder, archive_bytes=20_000)
    rows = manifest.collect()
    assert sum(r["records"] for r in rows) == len(PAGES) and len(rows) > 2
    back = read_archives(manifest, folder, with_payload=True)
    assert {bytes(r["payload"]).decode() for r in back.filter("record_type = 'response'").collect()} == {t or "" for _, _, t in PAGES}
    for r in rows:
        raw = open(os.path.join(folder, r["file"]), "rb").read()
        assert len(raw) == r["bytes"] and int.from_bytes(raw[:4], "little") == MAGIC
        file = io.BytesIO(raw)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(read_dictionary(file)))
        rest, frames = raw[file.tell() :], 0
        while rest:  # each frame alone is one whole record
            one = unpack.decompressobj()
            assert len(list(parse(io.BytesIO(one.decompress(rest))))) == 1
            rest, frames = one.unused_data, frames + 1
        assert frames == r["records"]


def test_short_payloads_are_all_responses(pages, tmp_path):
    manifest = write_archives(pages, str(tmp_path), least_bytes=20)
    back = read_archives(manifest, str(tmp_path)).collect()
    assert {r["record_type"] for r in back if r["payload_bytes"] < 20} == {"response"}
    assert "revisit" in {r["record_type"] for r in back}


def test_a_changed_payload_is_an_error(spark, pages, tmp_path):
    manifest = write_archives(pages.filter('page_id = 0'), str(tmp_path))
    name = os.path.join(tmp_path, manifest.first()["file"])
    raw = open(name, "rb").read()
    file = io.BytesIO(raw)
    words = zstandard.ZstdCompressionDict(read_dictionary(file))
    text = zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(raw[file.tell() :])
    with open(name, "wb") as f:
        f.write(raw[: file.tell()] + zstandard.ZstdCompressor(dict_data=words).compress(text.replace(b"<html>", b"<HTML>")))
    with pytest.raises(Exception, match="digest"):
        read_archives(manifest, str(tmp_path)).collect()
